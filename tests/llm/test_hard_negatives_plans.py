from pyspark.sql import functions as F

from tallymap.llm import hard_negatives
from tallymap.llm.hard_negatives import Settings

SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(spark, n):
    rows = [(i, [((i * 7 + k * 13) % 17) / 17 - 0.4 for k in range(6)], i % 3) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_side_of_a_join_goes_to_the_driver(spark, monkeypatch):
    plans = []

    def staged(frame, name, write=hard_negatives.staged):
        plans.append(plan_of(frame))
        return write(frame, name)

    monkeypatch.setattr(hard_negatives, "staged", staged)
    found = hard_negatives.hard_negatives(vectors(spark, 60), F.col("vec_id") % 10 == 0, Settings(block_rows=16))
    plans.append(plan_of(found))
    assert sum(p.count("SortMergeJoin") for p in plans) == 4
    assert not any("Broadcast" in p for p in plans)
    assert found.collect()
    assert "Broadcast" not in plan_of(found)  # as it ran


def test_copies_are_no_more_than_blocks_ask_for(spark, monkeypatch):
    asked = []

    def pairs(blocks, chunks, groups, made=hard_negatives._pairs):
        asked.append((blocks.count(), groups))
        return made(blocks, chunks, groups)

    monkeypatch.setattr(hard_negatives, "_pairs", pairs)
    monkeypatch.setattr(hard_negatives, "partitions", lambda spark: 600)
    rows = vectors(spark, 60)
    is_anchor = F.col("vec_id") % 10 == 0
    got = hard_negatives.hard_negatives(rows, is_anchor, Settings(block_rows=16)).collect()
    assert [groups for _, groups in asked] == [2 * n for n, _ in asked]
    monkeypatch.setattr(hard_negatives, "partitions", lambda spark: 1)
    assert sorted(got) == sorted(hard_negatives.hard_negatives(rows, is_anchor, Settings(block_rows=16)).collect())
    assert got
