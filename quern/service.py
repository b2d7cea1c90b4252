"""The service as Python calls over tables in a folder: what is written is appended as rows of one commit, what is read is a DataFrame.

`mutations` (commit, ordinal, op, id, successor, value) is the log that all records come from; `observations`, `turns` and `artifacts` are appended
beside it. A record is the JSON of a mutation's value: kind, subject, text, links, owners, audience, purposes. Every read asks the reader's
predicate before anything is scored, and a commit number, so that a page goes on in the snapshot it began in.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numbers, text, values
from .operators import graph, recall, revisions, scans
from .sources.steps import settle

SCHEMAS = {
    "mutations": "commit long, ordinal int, op string, id string, successor string, value string",
    "observations": "commit long, key string, digest string, content string, subject string",
    "turns": "commit long, session string, turn long, role string, text string",
    "artifacts": "commit long, id string, part string, kind string, parent string, locator string, content string",
}
RECORD = "kind string, subject string, text string, links array<string>, owners array<string>, audience array<string>, purposes array<string>, pinned boolean"


class Denied(PermissionError):
    """The reader may not do this, or there is nothing that they may see: both look alike."""


@dataclass(frozen=True)
class Reader:
    subject: str
    purpose: str = "recall"
    groups: tuple[str, ...] = field(default=())

    def allows(self):
        """Owners, everyone, the subject and its groups; no purposes are all purposes."""
        who = F.arrays_overlap(F.coalesce("audience", F.array().cast("array<string>")), F.array(*map(F.lit, (self.subject, "*", *self.groups)))) | F.array_contains(F.coalesce("owners", F.array().cast("array<string>")), self.subject)
        none = F.array().cast("array<string>")
        return who & ((F.size(F.coalesce("purposes", none)) == 0) | F.array_contains(F.coalesce("purposes", none), self.purpose))


class MemoryService:
    """All calls of the service's surface. `root` is a folder that driver and executors share, `key` the secret of its tokens."""

    def __init__(self, spark: SparkSession, root: str, key: bytes):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    # Tables.

    def _table(self, name: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def _append(self, name: str, rows: list[tuple] | DataFrame) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1)
        df.write.mode("append").parquet(f"{self.root}/{name}")

    def head(self) -> int:
        """The last commit, 0 before the first."""
        return max((self._table(t).agg(F.max("commit").alias("c")).first().c or 0) for t in SCHEMAS)

    def _commit(self, changes: Iterable[tuple], base: int | None = None) -> int:
        at = self.head()
        if base is not None and base != at:
            raise ValueError(f"the head is {at}, not {base}")
        self._append("mutations", [(at + 1, i, *c) for i, c in enumerate(changes)])
        return at + 1

    def revisions(self, commit: int | None = None) -> DataFrame:
        """All revisions up to a commit, with the fields of their records."""
        log = self._table("mutations")
        log = log if commit is None else log.where(F.col("commit") <= commit)
        return revisions.fold(log).withColumn("r", F.from_json("value", RECORD)).select("id", "revision", "tx_from", "tx_to", "lifecycle", "value", "r.*")

    def records(self, reader: Reader, commit: int | None = None, kind: str | None = None) -> DataFrame:
        """Active records at a commit that the reader may see, then and by the present policy."""
        now = self.revisions(None).where("tx_to is null and lifecycle = 'active'").where(reader.allows()).select("id")
        seen = self.revisions(commit).where("tx_to is null and lifecycle = 'active'").where(reader.allows())
        return (seen if kind is None else seen.where(F.col("kind") == kind)).join(now, "id", "left_semi")

    def _own(self, reader: Reader, id_: str) -> dict:
        rows = self.records(reader).where((F.col("id") == id_) & F.array_contains("owners", reader.subject)).select("value").collect()
        if not rows:
            raise Denied(id_)
        return json.loads(rows[0].value)

    def _put(self, id_: str, record: dict) -> tuple:
        return ("put", id_, None, json.dumps(record, sort_keys=True))

    # Observations.

    def observe(self, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
        """Observations (key, content, subject): a key's first is written; the same again replays, another content conflicts. Returns key, outcome."""
        at = self.head() + 1
        new = self.spark.createDataFrame([(at, k, hashlib.sha256(c.encode()).hexdigest(), c, s) for k, c, s in rows], SCHEMAS["observations"]).dropDuplicates(["key", "digest"])
        known = self._table("observations").select("key", F.col("digest").alias("had")).dropDuplicates(["key"])
        told = settle(new.join(known, "key", "left").withColumn("outcome", F.when(F.col("had").isNull(), "applied").when(F.col("had") == F.col("digest"), "replay").otherwise("conflict")), "observe")
        self._append("observations", told.where("outcome = 'applied'").select("commit", "key", "digest", "content", "subject"))
        return told.select("key", "outcome")

    def observe_stream(self, batches: Iterable[list[tuple[str, str, str]]]) -> Iterator[DataFrame]:
        """An acknowledgement for each batch, in order."""
        for batch in batches:
            yield self.observe(batch)

    def ingest_snapshot(self, key: str, parts: list[str], digest: str, subject: str) -> DataFrame:
        """Parts that are one observation together; their digest must be the manifest's."""
        whole = "".join(parts)
        if hashlib.sha256(whole.encode()).hexdigest() != digest:
            raise ValueError("the parts are not what the manifest says")
        return self.observe([(key, whole, subject)])

    def correct(self, reader: Reader, target: str, successor: str, record: dict) -> int:
        old = self._own(reader, target)
        if successor == target:
            raise ValueError("a correction needs an id of its own")
        return self._commit([("correct", target, successor, json.dumps({**old, **record, "links": [*(record.get("links") or []), target]}, sort_keys=True))])

    def forget(self, reader: Reader, target: str) -> int:
        self._own(reader, target)
        return self._commit([("retract", target, None, None)])

    # Recall and context.

    def _scored(self, reader: Reader, query: str, commit: int) -> DataFrame:
        docs = self.records(reader, commit)
        return docs.withColumn("score", text.overlap_score(query, "text")).where("score is not null")

    def recall(self, reader: Reader, query: str, most: int = 10) -> tuple[DataFrame, str]:
        """A page (id, score, text) of the best records, and a token that goes on."""
        return self._page(reader, query, self.head(), 0, most)

    def _page(self, reader: Reader, query: str, commit: int, offset: int, most: int) -> tuple[DataFrame, str]:
        page = self._scored(reader, query, commit).orderBy(F.desc("score"), "id").offset(offset).limit(most).select("id", "score", "text")
        return page, scans.encode_cursor(self.key, query=query, subject=reader.subject, purpose=reader.purpose, commit=commit, offset=offset + most)

    def continue_recall(self, reader: Reader, token: str, most: int = 10) -> tuple[DataFrame, str]:
        at = scans.decode_cursor(self.key, token, subject=reader.subject, purpose=reader.purpose)
        return self._page(reader, at["query"], at["commit"], at["offset"], most)

    def recall_stream(self, reader: Reader, query: str, most: int = 10) -> Iterator[tuple[str, list]]:
        """started, then pages, then completed."""
        yield "started", []
        page, token = self.recall(reader, query, most)
        while rows := page.collect():
            yield "page", rows
            page, token = self.continue_recall(reader, token, most)
        yield "completed", []

    def explain_recall(self, reader: Reader, query: str) -> DataFrame:
        """Stages with coarse counts of what the reader may see; nothing else is told."""
        docs = self.records(reader)
        counts = docs.agg(F.count("*").alias("authorized"), F.count(text.overlap_score(query, "text")).alias("lexical"), F.count_if(F.contains(F.lit(query.lower()), F.lower("subject"))).alias("alias"))
        stages = F.array(*(F.struct(F.lit(s).alias("stage"), numbers.count_bucket(s).alias("count")) for s in ("authorized", "alias", "lexical")))
        return counts.select(F.explode(stages).alias("s")).select("s.*")

    def compile_context(self, reader: Reader, query: str, tokens: int) -> DataFrame:
        """Records in order of their scores while they fit: id, score, cost, used."""
        w = Window.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
        best = self._scored(reader, query, self.head()).orderBy(F.desc("score"), "id").limit(1000).withColumn("cost", text.token_count("text"))
        return best.withColumn("used", F.sum("cost").over(w)).where(F.col("used") <= tokens).select("id", "score", "cost", "used")

    # Archives, backups, maintenance.

    def export(self, path: str) -> None:
        for name in SCHEMAS:
            scans.export_rows(self._table(name), f"{path}/{name}")

    def import_(self, path: str) -> None:
        """An export into an empty store; refused where it isn't empty, or the log has faults."""
        if self.head():
            raise ValueError("the store isn't empty")
        for name, schema in SCHEMAS.items():
            self._append(name, scans.import_rows(self.spark, f"{path}/{name}", schema))
        if self.verify().where("faults > 0").count():
            raise ValueError("the export has faults")

    create_backup, restore_backup = export, import_

    def migrate_format(self, start: int, goal: int) -> list[str]:
        """The readers that lead from one version of the format to another; this store's own is 1."""
        return revisions.migrate({(1, 2): "v1-v2"}, start, goal)

    def verify(self) -> DataFrame:
        """rule, faults: one open head for each id, values in JSON, digests that hold."""
        r = self.revisions()
        heads = r.where("tx_to is null").groupBy("id").agg(F.count("*").alias("n")).where("n <> 1").agg(F.count("*").alias("faults")).select(F.lit("open_heads").alias("rule"), "faults")
        spoilt = r.where("value is not null and kind is null").agg(F.count("*").alias("faults")).select(F.lit("values").alias("rule"), "faults")
        digest = self._table("observations").where(F.sha2("content", 256) != F.col("digest")).agg(F.count("*").alias("faults")).select(F.lit("digests").alias("rule"), "faults")
        return heads.unionByName(spoilt).unionByName(digest)

    def get_status(self) -> DataFrame:
        parts = [self._table(t).agg(F.lit(t).alias("table"), F.count("*").alias("rows"), F.max("commit").alias("head")) for t in SCHEMAS]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    def compact(self) -> None:
        """Each table's rows in fewer files, beside the old ones; the folder's rows stay the same."""
        for name in SCHEMAS:
            old = self._table(name)
            rows = settle(old, "compact")
            if rows.limit(1).count():
                rows.coalesce(8).write.mode("overwrite").parquet(f"{self.root}/{name}")

    def reindex(self) -> DataFrame:
        """term, id, n: the postings of all active records."""
        now = self.revisions().where("tx_to is null and lifecycle = 'active'")
        return revisions.postings(now, "id", text.all_tokens("text"))

    def consolidate(self, since: int) -> DataFrame:
        """id, work: what changed records leave to do."""
        changed = self._table("mutations").where(F.col("commit") > since).select(F.explode(F.array_compact(F.array("id", "successor"))).alias("id")).distinct()
        return changed.select("id", F.explode(F.array(*map(F.lit, ("index", "vector", "hierarchy")))).alias("work"))

    def reflect(self, since: int) -> DataFrame:
        """subject, changed, open: what is to be thought over again."""
        r = self.revisions()
        return r.groupBy("subject").agg(F.count_if(F.col("tx_from") > since).alias("changed"), F.count_if(F.col("tx_to").isNull() & (F.col("lifecycle") == "active")).alias("open")).where("changed > 0")

    # Events.

    def subscribe(self, reader: Reader, after: int, most: int = 100) -> DataFrame:
        """commit, id, lifecycle of changes behind a commit that the reader may see, in order."""
        return self.revisions().where((F.col("tx_from") > after) & reader.allows()).select(F.col("tx_from").alias("commit"), "id", "lifecycle").orderBy("commit", "id").limit(most)

    # Records.

    def get_node(self, reader: Reader, id_: str, commit: int | None = None) -> DataFrame:
        return self.records(reader, commit).where(F.col("id") == id_)

    def get_timeline(self, reader: Reader, id_: str, most: int = 100) -> DataFrame:
        now = self.records(reader).where(F.col("id") == id_).select("id")
        return self.revisions().join(now, "id", "left_semi").orderBy("revision").limit(most).select("id", "revision", "tx_from", "tx_to", "lifecycle", "text")

    def get_evidence(self, reader: Reader, id_: str) -> DataFrame:
        """The records that a record is linked to, as far as the reader may see them."""
        seen = self.records(reader)
        links = seen.where(F.col("id") == id_).select(F.explode("links").alias("id"))
        return seen.join(links, "id", "left_semi").select("id", "kind", "text")

    def get_conflict(self, reader: Reader, subject: str) -> DataFrame:
        """Texts of a subject's claims that differ, with who says them."""
        c = self.records(reader, kind="claim").where(F.col("subject") == subject).groupBy("text").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        return c.withColumn("alternatives", F.count("*").over(Window.partitionBy())).where("alternatives > 1")

    def traverse(self, reader: Reader, starts: list[str], hops: int) -> DataFrame:
        """node, hop over links between records that the reader may see, starts included."""
        seen = self.records(reader)
        ids = seen.select(F.col("id").alias("child"))
        links = seen.select(F.col("id").alias("parent"), F.explode("links").alias("child")).join(ids, "child", "left_semi")
        begin = self.spark.createDataFrame([(s,) for s in starts], "node string").join(ids.withColumnRenamed("child", "node"), "node", "left_semi")
        return graph.reach(links, begin, hops, "both", include_starts=True)

    # Runs of agents and conversations.

    def begin_session(self, session: str) -> int:
        return (self._table("turns").where(F.col("session") == session).agg(F.max("turn").alias("t")).first().t or 0) + 1

    def after_turn(self, session: str, role: str, said: str) -> int:
        """The turn written, with its number."""
        turn = self.begin_session(session)
        self._append("turns", [(self.head() + 1, session, turn, role, said)])
        return turn

    def before_turn(self, reader: Reader, session: str, query: str, tokens: int = 500) -> DataFrame:
        """A pack if the gate asks for memory; else, and if nothing is found, no rows."""
        run = self.spark.range(1).select(recall.gate(F.lit(query))["run"].alias("run")).first().run
        pack = self.compile_context(reader, query, tokens)
        return pack if run else pack.limit(0)

    def end_session(self, session: str) -> DataFrame:
        return self._table("turns").where(F.col("session") == session).groupBy("session").agg(F.count("*").alias("turns"), F.max("turn").alias("head"))

    def resolve_referent(self, reader: Reader, name: str) -> DataFrame:
        """The records whose subject is named: exactly one is a resolution, more are candidates."""
        n = self.records(reader).where(text.normalize("subject") == text.normalize(F.lit(name))).select("id", "subject")
        return n.withColumn("resolved", F.count("*").over(Window.partitionBy()) == 1)

    def recall_shared_history(self, reader: Reader, group: str, most: int = 20) -> DataFrame:
        return self.records(reader).where(F.array_contains("audience", group)).orderBy(F.desc("tx_from"), "id").limit(most).select("id", "text")

    def bootstrap(self, reader: Reader, tokens: int = 500) -> DataFrame:
        """What an agent begins with: pinned records first, then the newest, while they fit."""
        w = Window.orderBy(F.desc("first"), F.desc("tx_from"), "id").rowsBetween(Window.unboundedPreceding, 0)
        rows = self.records(reader).withColumn("first", F.coalesce("pinned", F.lit(False))).orderBy(F.desc("first"), F.desc("tx_from"), "id").limit(1000).withColumn("cost", text.token_count("text"))
        return rows.withColumn("used", F.sum("cost").over(w)).where(F.col("used") <= tokens).select("id", "text", "used")

    bootstrap_subject = bootstrap

    def preflight(self, reader: Reader, action: str) -> str:
        """deny if a boundary names the action, else allow."""
        hit = self.records(reader, kind="boundary").where(F.contains(F.lit(action.lower()), F.lower("text"))).limit(1).count()
        return "deny" if hit else "allow"

    def postflight(self, session: str, action: str, outcome: str) -> int:
        return self.after_turn(session, "tool", values_json(action=action, outcome=outcome))

    def checkpoint(self, session: str, state: dict, expected: int) -> int:
        """A run's state, if its head is still the expected turn."""
        if self.begin_session(session) - 1 != expected:
            raise ValueError("the run has gone on")
        return self.after_turn(session, "checkpoint", json.dumps(state, sort_keys=True))

    def resume(self, session: str) -> tuple[dict, DataFrame]:
        """The last checkpoint's state and the turns behind it."""
        turns = self._table("turns").where(F.col("session") == session)
        last = turns.where("role = 'checkpoint'").orderBy(F.desc("turn")).limit(1).collect()
        at, state = (last[0].turn, json.loads(last[0].text)) if last else (0, {})
        return state, turns.where(F.col("turn") > at).orderBy("turn")

    def handoff(self, reader: Reader, to: Reader) -> DataFrame:
        """What both may see; Denied if that is nothing."""
        both = settle(self.records(reader).join(self.records(to).select("id"), "id", "left_semi").select("id", "text"), "handoff")
        if not both.limit(1).count():
            raise Denied("handoff")
        return both

    # Control.

    def remember(self, reader: Reader, id_: str, kind: str, said: str, **record) -> int:
        return self._commit([self._put(id_, {"kind": kind, "subject": reader.subject, "text": said, "owners": [reader.subject], "audience": [], "purposes": [], "links": [], **record})])

    def suppress(self, reader: Reader, id_: str) -> int:
        return self.forget(reader, id_)

    def pin(self, reader: Reader, id_: str) -> int:
        return self._commit([self._put(id_, {**self._own(reader, id_), "pinned": True})])

    def change_retention(self, reader: Reader, id_: str, until: str) -> int:
        raise NotImplementedError("records have no retention that a caller may change")

    def change_audience(self, reader: Reader, id_: str, audience: list[str]) -> int:
        """A smaller audience; a wider one is refused."""
        old = self._own(reader, id_)
        if not set(audience) <= set(old.get("audience") or []):
            raise Denied("an audience can only be narrowed")
        return self._commit([self._put(id_, {**old, "audience": sorted(audience)})])

    def publish_to_shared_memory(self, reader: Reader, id_: str, group: str) -> int:
        """To a group that the owner is in."""
        old = self._own(reader, id_)
        if group not in reader.groups:
            raise Denied(group)
        return self._commit([self._put(id_, {**old, "audience": sorted({*(old.get("audience") or []), group})})])

    def revoke_shared_memory(self, reader: Reader, id_: str, group: str) -> int:
        old = self._own(reader, id_)
        return self._commit([self._put(id_, {**old, "audience": sorted({*(old.get("audience") or [])} - {group})})])

    def explain_memory(self, reader: Reader, id_: str) -> DataFrame:
        return self.get_timeline(reader, id_).select("revision", "lifecycle", "tx_from")

    def list_subject_memories(self, reader: Reader, subject: str) -> DataFrame:
        return self.records(reader).where(F.col("subject") == subject).select("id", "kind", "text")

    def export_subject(self, reader: Reader, subject: str, path: str) -> None:
        scans.export_rows(self.list_subject_memories(reader, subject), path)

    def import_subject(self, reader: Reader, path: str) -> int:
        rows = scans.import_rows(self.spark, path, "id string, kind string, text string").collect()  # one subject's memories
        return self._commit([self._put(r.id, {"kind": r.kind, "subject": reader.subject, "text": r.text, "owners": [reader.subject], "audience": [], "purposes": [], "links": []}) for r in rows])

    # Subjects and relationships.

    def create_memory_subject(self, reader: Reader, subject: str) -> int:
        return self.remember(reader, f"subject:{subject}", "subject", subject)

    def create_relationship_space(self, reader: Reader, space: str, members: list[str]) -> int:
        return self.remember(reader, f"space:{space}", "relationship", space, audience=sorted(members))

    def get_continuity_profile(self, reader: Reader) -> DataFrame:
        return self.records(reader).groupBy("kind").agg(F.count("*").alias("records"), F.max("tx_from").alias("head"))

    def update_configured_role(self, reader: Reader, role: str) -> int:
        return self.remember(reader, f"role:{reader.subject}", "role", role)

    def migrate_agent_runtime(self, reader: Reader, runtime: str) -> int:
        return self.remember(reader, f"runtime:{reader.subject}", "runtime", runtime)

    # Artifacts.

    def ingest_artifact(self, id_: str, kind: str, content: str) -> int:
        at = self.head() + 1
        self._append("artifacts", [(at, id_, "original", kind, None, hashlib.sha256(content.encode()).hexdigest(), content)])
        return at

    def add_derived_representation(self, id_: str, part: str, kind: str, content: str) -> int:
        at = self.head() + 1
        self._append("artifacts", [(at, id_, part, kind, "original", hashlib.sha256(content.encode()).hexdigest(), content)])
        return at

    def attach_artifact_to_episode(self, reader: Reader, id_: str, episode: str) -> int:
        old = self._own(reader, episode)
        return self._commit([self._put(episode, {**old, "links": sorted({*(old.get("links") or []), f"artifact:{id_}"})})])

    def add_evidence_selector(self, id_: str, kind: str, *at) -> DataFrame:
        """What the selector points at in the original."""
        return self._artifacts().where((F.col("id") == id_) & (F.col("part") == "original")).select("id", values.select(kind, "content", *at).alias("selected"))

    def _artifacts(self) -> DataFrame:
        """Artifacts that are not deleted: a row of kind `deleted` takes all parts, those written later, too."""
        a = self._table("artifacts")
        return a.where("kind <> 'deleted'").join(a.where("kind = 'deleted'").select("id"), "id", "left_anti")

    def get_artifact_metadata(self, id_: str) -> DataFrame:
        return self._artifacts().where(F.col("id") == id_).select("id", "part", "kind", "parent", "locator")

    def delete_artifact_lineage(self, id_: str) -> DataFrame:
        """The locators of what goes."""
        gone = settle(self._artifacts().where(F.col("id") == id_).select("locator").distinct(), "deleted")
        self._append("artifacts", [(self.head() + 1, id_, "tombstone", "deleted", None, None, None)])
        return gone


def values_json(**fields) -> str:
    return json.dumps(fields, sort_keys=True)
