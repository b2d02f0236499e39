import json
import os
import random

import pytest

from crestline.operators import lines as L


def test_no_key_is_held_as_an_array(spark):
    """A key of many batches beside small ones and null gives what a plain fold gives."""
    rows = spark.range(50_000).selectExpr("IF(id % 10 < 8, 1, IF(id % 10 = 8, id % 7 + 2, NULL)) AS k", "id AS o", "CAST(id * 7919 % 5000 + id / 10 AS DOUBLE) AS v")
    got = L.throttled(rows, "k", "o", "v")
    assert "collect_list" not in got._jdf.queryExecution().toString()
    last, want = {}, set()
    for r in rows.orderBy("o").collect():
        if r.v - last.get(r.k, -10.0) >= 10:
            last[r.k] = r.v
            want.add((r.k, r.o, r.v))
    assert {tuple(r) for r in got.collect()} == want and len({k for k, _, _ in want}) == 9


def folded(rows, step=10.0):
    last, out = {}, []
    for k, o, v in sorted((r for r in rows if r[2] is not None and r[2] == r[2]), key=lambda r: (str(r[0]), r[1], r[2])):
        if v - last.get(k, -10.0) >= step:
            last[k] = v
            out.append((k, o, v))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_ties_nulls_and_ranges(spark, seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, float("nan"), rng.uniform(-30, 120), float(rng.randrange(0, 100, 10))])
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(60), value()) for _ in range(400)]
    frame = spark.createDataFrame(rows, "k string, o long, v double").repartition(5)
    assert sorted(map(tuple, L.throttled(frame, "k", "o", "v").collect()), key=str) == folded(rows)


def test_a_hot_key_is_spread(spark):
    """One key has nearly all rows; its ranges lie in several tasks, and few rows of it are folded."""
    frame = spark.range(0, 200_000, 1, 8).selectExpr("IF(id % 50 = 0, id % 7, -1) AS k", "id AS o", "CAST(hash(id) % 100000 / 1000 AS DOUBLE) AS v")
    rows = L.numbers(frame, "k", "o", "v").repartitionByRange(4, "k", "o")
    held = [r.n for r in rows.where("k = -1").selectExpr("spark_partition_id() AS p").groupBy("p").agg({"*": "count"}).toDF("p", "n").collect()]
    assert len(held) >= 3 and max(held) < 100_000
    few = rows.sortWithinPartitions("k", "o", "v").mapInArrow(L.rising, rows.schema)
    assert few.count() < 1_000
    assert sorted(map(tuple, L.throttled(frame, "k", "o", "v").collect())) == sorted(folded([tuple(r) for r in frame.collect()]))


def test_step_must_be_positive(spark):
    with pytest.raises(ValueError, match="positive"):
        L.throttled(spark.range(1).selectExpr("id AS k", "id AS o", "0.0 AS v"), "k", "o", "v", step=0)


def test_stream_over_batches_and_a_restart(spark, tmp_path):
    """Files come between runs from one checkpoint: the state goes on where it was."""
    from crestline.streaming.levels import throttle_stream

    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", "c"]), i, rng.choice([None, float("nan"), i / 5 + rng.uniform(-20, 20)])) for i in range(600)]
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.schema("k string, o long, v double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        throttle_stream(stream, "k", "o", "v").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    for i in range(0, 600, 100):
        lines = [json.dumps({"k": k, "o": o, "v": v} if v == v else {"k": k, "o": o}) for k, o, v in rows[i : i + 100]]
        (tmp_path / "in" / f"{i:03}.json").write_text("\n".join(lines))
        os.utime(tmp_path / "in" / f"{i:03}.json", (1_000_000 + i, 1_000_000 + i))
        if i in (200, 500):
            run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == folded(rows)
