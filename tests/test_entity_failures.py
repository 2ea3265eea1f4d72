"""A failure while entities are sought is no result, and odd texts don't fail."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lanthorn.functions.vocab import Vocabulary
from lanthorn.operators.entities import Context, Recogniser, proposed
from lanthorn.plans.scan import scan

PIECES = ["Mr", "Dr. ", "John", "Smith", "'s", "’", "-", " ", "\n", "\r\n", " ", " ", "\x85", "\x00", "İ", "ſ", "ǅ", "😀", "﷐", "Ltd", "GmbH", "Acme", "12 Long Road", "London", "the ", "from the sales team", ", manager", "(", ")", "@", "a.b@c.de", ".", "is our largest customer", "NDA", "O'Neil", "É", "ß", "X9-Y", "said", "﻿"]


@pytest.mark.parametrize("kind", [ValueError, IndexError])
def test_a_failure_fails_the_query(spark, kind):
    class Broken(frozenset):
        def __contains__(self, word):
            raise kind("broken list")

        def __reduce__(self):
            return Broken, ()

    df = spark.createDataFrame([(1, "we met John Smith")], "doc_id long, text string")
    with pytest.raises(Exception, match="broken list"):
        scan(df, vocabulary=replace(Vocabulary(), given_names=Broken())).select(F.size("findings")).collect()


def test_odd_texts_do_not_fail():
    rnd, parts = random.Random(4), (Recogniser(Vocabulary()), Context(Vocabulary()))
    for _ in range(20_000):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 12)))
        a, b = sorted(rnd.randint(0, len(text)) for _ in range(2))
        for row in proposed(text, [(a, b), (0, b)], ["", "@", "a.b@c.de", text], *parts):
            assert text[row[1] : row[2]] == row[7]
