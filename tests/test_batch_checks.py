"""Matches of a batch are placed and checked in columns, as single matches are."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lanthorn.operators.rules import RULES, Batch, Search

PIECES = ["version ", "v", "at ", "10.0.0.1", "255.256.1.2", "4111 1111 1111 1111", "4111-1111-1111-1112", "8001015009087", "sql-01", "Web-Prod", "ABCD-1234-EFGH-IJKL", "GB29 NWBK 6016 1331 9268 19", " ", "\n", ".", "+1 555 123 4567", "123456789", "2024-01-02 1234", 'password: "abc"', "token = abcdefgh12", "Project Plan", "http://a.b/c?!.", "é", "😀"]


@pytest.mark.parametrize("name", list(RULES))
def test_many_matches_are_judged_as_each(name):
    rnd, search = random.Random(name), Search.of(RULES[name][1])
    texts = ["".join(rnd.choice(PIECES) for _ in range(25)) for _ in range(200)]
    held = np.array([search.pattern.search(t) is not None for t in texts])
    rows, values, starts = search.matches_of(pa.array(texts).filter(pa.array(held)), np.flatnonzero(held), Batch(pa.array(texts)))
    assert list(zip(rows.tolist(), values.to_pylist(), starts.tolist())) == [(k, v, at) for k, t in enumerate(texts) for v, at in search.matches(t)]
