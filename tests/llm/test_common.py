"""The lookup that spares a task the rows of a hot key, against a plain join."""

import pytest
from pyspark.sql import functions as F

from lectern.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_of_hot_keys_equals_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = spark.range(400).select((F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 90)).cast("bigint").alias("k"), F.col("id").alias("v"))
    table = spark.range(0, 90, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x")).union(spark.createDataFrame([(7, 70)], "k bigint, x bigint"))
    rows, table = common.materialise(rows, "rows"), common.materialise(table, "table")
    got = common.looked_up(rows, table, "k", how, limit=0)
    want = rows.join(table, "k", how)
    assert sorted(map(str, got.select("k", "v", "x").collect())) == sorted(map(str, want.select("k", "v", "x").collect())) and got.count()


def test_lean_workers_give_the_same_batches(spark):
    from lectern.llm.common import lean

    def twice(batches):
        for batch in batches:
            yield batch
            yield batch

    rows = spark.range(1000)
    assert sorted(r.id for r in rows.mapInArrow(lean(twice), "id bigint").collect()) == sorted([*range(1000)] * 2)
    trimmed = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(common, "trim", lambda: trimmed.append(1))
        assert list(common.lean(iter)([])) == [] and len(trimmed) == 2
        with pytest.raises(ZeroDivisionError):
            list(common.lean(lambda batches: (1 // b for b in batches))([0]))
    assert len(trimmed) == 4
