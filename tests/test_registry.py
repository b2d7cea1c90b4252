"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from quern.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


def test_forbidden_rows_change_nothing(spark):
    """Authorization comes before candidates: rows that the principal may not see leave scores as they are."""
    from pyspark.sql import functions as F

    from quern.operators import policy, retrieval
    from quern.sources.tables import documents

    docs = documents(spark, SF)
    p = registry.PRINCIPAL
    more = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000_000).withColumn("workspace", F.lit(2).cast("bigint")))
    score = lambda d: sorted(map(tuple, retrieval.bm25(d.where(policy.allows(p)), ["of", "the"]).collect()))
    assert score(docs) == score(more) != []


def test_whole_reads_take_every_event(spark, duck):
    events = duck.execute("SELECT count(*), count(DISTINCT (user_id, event_type)) FROM events").fetchone()
    got = {n: registry.queries()[f"{n}_whole"](spark, SF) for n in ("timeline_revisions", "asof_revision", "pending_tail")}
    assert (got["timeline_revisions"].count(), got["asof_revision"].count()) == events
    assert sum(r.n for r in got["pending_tail"].collect()) == events[0]


def test_a_digest_depends_on_all_events_before_it(spark):
    from quern.operators import capture

    chain = lambda first: {(r.user_id, r.event_id): r.link for r in capture.digest_chain(spark.createDataFrame([(u, i, first if (u, i) == (1, 0) else f"{u} {i}") for u in (1, 2, None) for i in range(6)], "user_id long, event_id long, record string")).collect()}
    one, other = chain("a"), chain("b")
    assert len(one) == 18 and {k for k in one if one[k] != other[k]} == {(1, i) for i in range(6)}
    assert "record_digest_chain" in registry.queries() and "hash_chain" not in registry.queries()


def test_queries_without_sql_are_few_and_tested():
    """Order-dependent folds and greedy choices; each is held against a plain loop in test_folds.py."""
    assert registry.queries().keys() - registry.oracle_sql().keys() == {"compile_pack", "greedy_density", "minimal_evidence", "partitioned_vector_search", "circuit_breaker", "work_scheduler", "lease_ticks"}


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= registry.queries().keys()
    assert __spark_entry__.entry(spark).count() > 0
