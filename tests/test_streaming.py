"""Streams, over files that arrive one by one."""

import random

from quern.streaming import capture


def test_coverage_is_that_of_a_set():
    rng = random.Random(5)
    held, seen = capture.Coverage(), set()
    for _ in range(3000):
        n = rng.randint(-2, 400)
        known = n in seen
        got = held.take(n)
        assert (got == "duplicate") == known and (got == "refused") == (n < 1)
        if n >= 1:
            seen.add(n)
        missing = set(range(1, held.head + 1)) - seen
        assert {x for low, high in held.gaps for x in range(low, high + 1)} == missing
        assert held.contiguous_through == (min(missing) - 1 if missing else held.head)
    few = capture.Coverage()
    assert [few.take(n, most=1) for n in (3, 5, 1, 2, 5)] == ["ahead", "refused", "late", "late", "ahead"]


def test_stream_keeps_coverage_over_batches_and_restarts(spark, tmp_path):
    schema = "producer long, sequence long"
    batches = [[(1, 1), (2, 3)], [(1, 4), (2, 3), (None, 1)], [(1, 2), (1, 1), (2, None)], [(1, 3), (2, 1)]]

    def run(count):
        for i, rows in enumerate(batches[:count]):
            if not (tmp_path / f"in/b={i}").exists():
                spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
                stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/b=*")
                capture.append_once(capture.coverage(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("producer", "sequence", "outcome").collect())

    run(2)
    assert run(4) == sorted([(1, 1, "next"), (2, 3, "ahead"), (1, 4, "ahead"), (2, 3, "duplicate"), (1, 2, "late"), (1, 1, "duplicate"), (1, 3, "late"), (2, 1, "late")])
