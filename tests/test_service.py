"""The service's calls over a folder of tables."""

import hashlib

import pytest

from quern.service import Denied, MemoryService, Reader


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    return MemoryService(spark, f"file://{tmp_path_factory.mktemp('store')}/s", b"k" * 32)


ANN, BOB, EVE = Reader("ann", groups=("team",)), Reader("bob", groups=("team",)), Reader("eve")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_what_is_remembered_is_recalled_by_those_who_may(service):
    service.remember(ANN, "m1", "claim", "the bar in japan was small")
    service.remember(ANN, "m2", "claim", "a bar of chocolate", audience=["team"])
    service.remember(BOB, "m3", "boundary", "never call japan")
    page, token = service.recall(ANN, "bar japan", 1)
    assert ids(page) == ["m1"] and ids(service.continue_recall(ANN, token)[0]) == ["m2"]
    with pytest.raises(ValueError):
        service.continue_recall(EVE, token)
    assert ids(service.recall(BOB, "bar")[0]) == ["m2"] and ids(service.recall(EVE, "bar")[0]) == []
    assert [k for k, _ in service.recall_stream(ANN, "bar", 1)] == ["started", "page", "page", "completed"]
    assert {r.stage: r["count"] for r in service.explain_recall(BOB, "bar").collect()} == {"authorized": "few", "alias": "zero", "lexical": "one"}
    assert ids(service.compile_context(ANN, "bar", 7)) == ["m1"] and ids(service.before_turn(ANN, "s", "do you remember the bar")) == ["m1", "m2"]
    assert service.preflight(BOB, "I never call japan at night") == "deny" and service.preflight(ANN, "call") == "allow"
    assert ids(service.handoff(ANN, BOB)) == ["m2"]
    with pytest.raises(Denied):
        service.handoff(ANN, EVE)


def test_corrections_and_policies_change_reads_at_once(service):
    before = service.head()
    service.correct(ANN, "m1", "m4", {"text": "the bar in japan was large"})
    assert ids(service.recall(ANN, "japan")[0]) == ["m4"] and ids(service.get_node(ANN, "m1")) == [] and ids(service.get_node(ANN, "m1", before)) == []
    assert ids(service.get_evidence(ANN, "m4")) == [] and [r.lifecycle for r in service.explain_memory(ANN, "m4").collect()] == ["active"]
    with pytest.raises(Denied):
        service.forget(BOB, "m4")
    with pytest.raises(Denied):
        service.change_audience(ANN, "m4", ["*"])
    service.publish_to_shared_memory(ANN, "m4", "team")
    assert ids(service.recall_shared_history(BOB, "team")) == ["m2", "m4"]
    service.revoke_shared_memory(ANN, "m4", "team")
    service.pin(ANN, "m4")
    assert ids(service.recall_shared_history(BOB, "team")) == ["m2"] and [r.id for r in service.bootstrap(ANN, 6).collect()] == ["m4"]
    service.remember(ANN, "e1", "episode", "an evening", links=["m4"])
    assert {r.node: r.hop for r in service.traverse(ANN, ["m4"], 3).collect()} == {"m4": 0, "e1": 1} and ids(service.get_evidence(ANN, "e1")) == ["m4"]
    service.remember(ANN, "m5", "claim", "the bar in japan was red")
    assert service.get_conflict(ANN, "ann").count() == 3
    service.suppress(ANN, "m5")
    assert len(service.get_timeline(ANN, "m4").collect()) == 4 and ids(service.resolve_referent(BOB, "BOB")) == ["m3"]
    assert {r.id for r in service.subscribe(ANN, before).collect()} >= {"m4", "e1"} and service.subscribe(EVE, 0).count() == 0
    with pytest.raises(NotImplementedError):
        service.change_retention(ANN, "m4", "2030")
    with pytest.raises(ValueError):
        service._commit([("retract", "m4", None, None)], base=0)


def test_observations_turns_and_artifacts(service, tmp_path):
    out = lambda df: {r.key: r.outcome for r in df.collect()}
    assert out(service.observe([("a", "x", "ann"), ("b", "y", "ann")])) == {"a": "applied", "b": "applied"}
    assert [out(o) for o in service.observe_stream([[("a", "x", "ann")], [("a", "z", "ann")]])] == [{"a": "replay"}, {"a": "conflict"}]
    assert out(service.ingest_snapshot("c", ["p", "q"], hashlib.sha256(b"pq").hexdigest(), "ann")) == {"c": "applied"}
    with pytest.raises(ValueError):
        service.ingest_snapshot("d", ["p"], "0", "ann")
    assert [service.after_turn("s1", "user", "hi"), service.checkpoint("s1", {"n": 1}, 1), service.postflight("s1", "call", "ok")] == [1, 2, 3]
    with pytest.raises(ValueError):
        service.checkpoint("s1", {}, 1)
    state, behind = service.resume("s1")
    assert state == {"n": 1} and [r.turn for r in behind.collect()] == [3] and service.end_session("s1").first().turns == 3
    service.ingest_artifact("f", "text", "one\ntwo\nthree")
    service.add_derived_representation("f", "summary", "text", "numbers")
    service.attach_artifact_to_episode(ANN, "f", "e1")
    assert service.add_evidence_selector("f", "lines", 2, 3).first().selected == "two\nthree" and service.get_artifact_metadata("f").count() == 2
    assert service.delete_artifact_lineage("f").count() == 2 and service.get_artifact_metadata("f").count() == 0


def test_stores_move_whole(service, spark, tmp_path):
    service.create_memory_subject(ANN, "dora")
    service.create_relationship_space(ANN, "ours", ["bob"])
    service.update_configured_role(ANN, "guide")
    service.migrate_agent_runtime(ANN, "v2")
    assert {r.kind for r in service.get_continuity_profile(ANN).collect()} >= {"subject", "relationship", "role", "runtime"}
    service.export(f"file://{tmp_path}/out")
    other = MemoryService(spark, f"file://{tmp_path}/new", b"k" * 32)
    other.import_(f"file://{tmp_path}/out")
    same = lambda s: sorted(map(tuple, s.get_status().collect()))
    assert same(other) == same(service) and other.verify().where("faults > 0").count() == 0
    with pytest.raises(ValueError):
        other.import_(f"file://{tmp_path}/out")
    before = sorted(map(tuple, other.records(ANN).select("id", "text").collect()))
    other.compact()
    assert sorted(map(tuple, other.records(ANN).select("id", "text").collect())) == before
    assert other.reindex().where("term = 'japan'").count() >= 1 and other.consolidate(other.head() - 1).count() == 3 and other.reflect(0).count() >= 1
    service.export_subject(ANN, "ann", f"file://{tmp_path}/ann")
    new = MemoryService(spark, f"file://{tmp_path}/third", b"k" * 32)
    new.import_subject(ANN, f"file://{tmp_path}/ann")
    assert ids(new.list_subject_memories(ANN, "ann")) == ids(service.list_subject_memories(ANN, "ann")) and new.migrate_format(1, 2) == ["v1-v2"]
