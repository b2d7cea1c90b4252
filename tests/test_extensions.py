"""Parts that a user may replace."""

from pyspark.sql import functions as F

from quern import extensions as x
from quern.operators import scans


def test_models_fall_back_and_outputs_are_checked(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "do fail. Then more"), (3, None), (4, '{"a": true, "b": 2, "b": 3}')], "id long, p string")
    out = {r.id: r for r in x.complete(rows, "p", x.Echo(), x.StrictJson(a="integer", c="string?")).collect()}
    assert (out[1].source, out[1].faults) == ("model", []) and (out[2].source, out[2].answer) == ("fallback", "do fail")
    assert out[3].faults == ["not JSON"] and out[4].faults == ["b: twice", "b: unknown", "a: not integer"]
    assert x.StrictJson(a="string").faults("[]") == ["not an object"] and x.StrictJson(a="string").faults("{}") == ["a: missing"]
    x.audit(x.complete(rows, "p", x.Echo()), f"file://{tmp_path}/audit")
    assert spark.read.parquet(f"file://{tmp_path}/audit").count() == 4


def test_scores_tokens_wire_and_clocks(spark):
    rows = spark.createDataFrame([("g", 2, 900, "a_b, c!"), ("g", 1, 5, "x")], "g string, id int, u int, t string")
    got = rows.select("id", x.PARTS["scorer"].score(F.col("u"), F.lit(1), F.lit(10)).alias("s"), x.PARTS["tokens"].count(F.col("t")).alias("n")).collect()
    assert {r.id: (r.s, r.n) for r in got} == {2: (1800, 4), 1: (None, 1)}
    assert x.JsonEncoder().encode(rows.drop("u"), "g").first().wire == '[{"id":1,"t":"x"},{"id":2,"t":"a_b, c!"}]'
    assert x.FixedClock(5).now() == 5 and x.SystemClock().now() > 1_600_000_000_000_000


def test_a_store_of_keys_keeps_its_snapshots(spark, tmp_path):
    kv = x.KeyValue(spark, f"file://{tmp_path}/kv")
    put = lambda *rows: kv.commit(spark.createDataFrame(list(rows), "key string, op string, value string"))
    put(("a/1", "put", "x"), ("a/2", "put", "y"), ("b", "put", "z"))
    put(("a/1", "delete", None), ("a/2", "put", "w"))
    assert [tuple(r) for r in kv.prefix("a/").collect()] == [("a/2", "w")] and kv.get("a/1").count() == 0
    assert sorted(r.key for r in kv.snapshot(1).collect()) == ["a/1", "a/2", "b"]


def test_exported_rows_are_a_source_and_calls_reconcile(spark, tmp_path):
    rows = spark.createDataFrame([("1", "k", "one"), ("2", None, "two\n")], "id string, kind string, text string")
    scans.export_rows(rows, f"file://{tmp_path}/rows")
    x.register(spark, clock=x.FixedClock(1))
    back = spark.read.format("quern_rows").load(f"{tmp_path}/rows")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str) and x.PARTS["clock"].now() == 1
    calls = x.reconcile(rows.select("id"), spark.createDataFrame([("1", True)], "id string, ok boolean"), "id")
    assert {r.id: r.state for r in calls.collect()} == {"1": "done", "2": "unknown"}
    assert x.prepare([lambda d: d.where("id = '1'"), lambda d: d.select("text")], rows).first().text == "one"
