"""The last step of the second look takes time that follows the number of findings."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from lanthorn.operators.confirm import one_answer
from lanthorn.operators.resolve import FINDING

ROW = (
    f"cast(struct(concat('f', i) as id, i as ord, if(i % 3 = 0, 'PERSON', 'LOCATION') as category, concat('Name', i div 2) as value, 10 * (n - i) as start, 10 * (n - i) + 5 as end, 'entity' as layer, 'r' as rule, 0.5D as base, "
    f"false as unresolved, false as single, 0.6D + (i % 5) / 100D as confidence, 'medium' as tier, true as enabled, cast(null as string) as confirmed_by, cast(array() as array<struct<id:string,weight:double,note:string>>) as signals) as {FINDING})"
)


def _of(spark, n):
    df = spark.range(1).select(F.expr(f"transform(sequence(1, {n}), i -> {ROW.replace('n - i', f'{n} - i')})").alias("findings"))
    began = time.time()
    got = df.select(one_answer(F.col("findings")).alias("f")).select("f.start", "f.category").collect()[0]
    return time.time() - began, got


def test_many_findings_are_settled_once(spark):
    _of(spark, 10)
    took, got = _of(spark, 1500)
    assert got["start"] == sorted(got["start"]) and len(got["start"]) == 1500
    # Both mentions of a value have the category of the surer one, the first of equals.
    sure = {}
    for i in range(1, 1501):
        sure[i // 2] = max(sure.get(i // 2, (-1.0, 0)), (i % 5, -i))
    assert got["category"] == ["PERSON" if -sure[i // 2][1] % 3 == 0 else "LOCATION" for i in range(1500, 0, -1)]
    assert took < 15
