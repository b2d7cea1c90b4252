"""The operators on small tables: brute force, and nulls, empties, repeats, ties, long texts, clashing columns."""

import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quern.llm import cell_dedup, components, dart_minhash, graph_ann, language_id, line_dedup, linking, nnls_packing, piece_roundtrip, queries, ring, token_count, warc

WORD, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))
DDL = "doc_id long, text string, lang string, score string, size string, n_removed string"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 300)
    near = base.split()
    near[50] = "changed"
    rows = [(1, base, "en"), (2, base, "en"), (3, " ".join(near), "fr"), (4, None, None), (5, "", "en"), (6, prose(2, 200), "fr"), (None, prose(3, 40), "en"), (7, "a b", "de"), (7, "a b", "de"), (8, prose(4, 9000), "en"), (9, "123 !!", "en")]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DDL).repartition(3)


def test_maps_and_shards_take_every_row(spark, docs):
    empty = docs.limit(0)
    tokens = token_count.count_tokens(docs, WORD).collect()
    assert len(tokens) == 11 and {r.doc_id: r.n_tokens for r in tokens}[4] == 0
    assert token_count.count_tokens(empty, WORD).count() == 0
    assert {r.doc_id: r.n_tokens for r in piece_roundtrip.digests(docs, PIECE).collect()}[5] == 1
    decoded = {r.doc_id: r.decoded for r in piece_roundtrip.encode_decode(docs, PIECE).collect()}
    assert decoded[8] == prose(4, 9000)
    placed = ring.shard(docs, 4).collect()
    assert sorted(Counter(r.shard for r in placed).values()) == [2, 3, 3, 3]
    assert all(sorted(r.slot for r in placed if r.shard == s) == list(range(n)) for s, n in Counter(r.shard for r in placed).items())
    assert ring.shard(empty).count() == 0


def test_near_duplicate_documents(spark, docs):
    found = {(r.doc_id, r.component_id, r.kept) for r in dart_minhash.near_duplicates(docs).collect()}
    assert {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 6, True), (None, None, True), (7, 7, True)} <= found
    assert dart_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies_is_one_group(spark):
    words = prose(9, 200).split()
    rows = []
    for i in range(60):
        w = list(words)
        w[(i * 3) % 200] = f"edit{i}"
        rows.append((i, " ".join(w)))
    out = dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in out.collect()} == {0}


def test_lines(spark, docs):
    line = "the quick brown fox jumps over the lazy dog again and again today"
    rows = [(1, f"{line}\nshort one\nother words that stand here all alone now"), (2, f"{line.upper()}!\nshort one"), (3, None), (4, ""), (None, line), (2, "something else that is not repeated anywhere here"), (5, " ".join([line] * 40)), (6, " ".join([line] * 40) + " extra")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_removed string")
    out = [tuple(r) for r in line_dedup.dedup_lines(table).select("doc_id", "text", "n_lines", "n_removed").collect()]
    assert (1, rows[0][1], 3, 0) in out and (2, "short one", 2, 1) in out and (3, None, 0, 0) in out and (4, "", 1, 0) in out
    assert (None, "", 1, 1) in out and (5, rows[6][1], 1, 0) in out and (6, "", 1, 1) in out
    assert line_dedup.dedup_lines(table.limit(0)).count() == 0
    narrow = line_dedup.dedup_lines(table.withColumn("doc_id", table.doc_id.cast("int"))).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(repr, map(tuple, narrow))) == sorted(map(repr, out))


def test_short_and_unspaced_lines(spark, tmp_path):
    han, thai, near = "天地玄黄宇宙洪荒日月盈昃辰宿列张", "สวัสดีชาวโลกทุกคนวันนี้", "天地玄黄宇宙洪荒日月盈昃辰宿列開"
    rows = [(1, f"Read more\n----\n\n{han}\n{thai}"), (2, f"read MORE!\n ---- \n\n{near}\n{thai}"), (3, "====\nread less\n\n  ")]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/sf/documents.parquet")
    out = queries.op4_line_dedup(spark, f"{tmp_path}/sf").select("doc_id", "n_lines", "n_removed", "kept_chars").collect()
    assert sorted(map(tuple, out)) == [(1, 5, 0, len(rows[0][1])), (2, 5, 4, 0), (3, 4, 0, len(rows[2][1]))]


def test_a_crowded_phrase_hides_no_pair(spark):
    """Similar lines that share only a phrase of 60 lines are compared as they are where it has two."""
    rows = []
    for i in range(30):
        tail = [f"t{i}x{k}" for k in range(10)]
        near = [f"u{i}x{k}" if k % 3 == 0 else w for k, w in enumerate(tail)]
        rows += [(2 * i + e, " ".join([*(f"h{k}" for k in range(10)), *end])) for e, end in enumerate((tail, near))]
    gone = lambda some: {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(some, "doc_id long, text string")).where("n_removed = 1").collect()}
    assert gone(rows[:2]) == {1} and gone(rows) == set(range(1, 60, 2))


def test_all_similar_lines_are_found(spark):
    """Every pair of word edit similarity 0.8 or more, in lines of all lengths that crowd around common phrases."""
    rng = np.random.default_rng(11)
    common, rare = [f"c{i}" for i in range(6)], iter(f"w{i}" for i in range(100_000))
    lines = []
    for n in [*range(5, 34), 60, 100]:
        for kind in range(3):
            base = [*(common[: min(4, n // 3)] if kind else []), *(next(rare) if rng.random() < 0.8 else str(rng.choice(common)) for _ in range(n))][:n]
            other = list(base)
            for at in sorted(rng.choice(n, n // 5, replace=False), reverse=True):
                if kind < 2 or rng.random() < 0.5:
                    other[at] = next(rare)
                elif rng.random() < 0.5:
                    other.insert(at, next(rare))
                else:
                    del other[at]
            lines += [base, other]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    similar = lambda a, b: min(len(a), len(b)) >= 5 and edits(a, b) <= max(len(a), len(b)) // 5
    root = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j in range(i):
            if 4 * max(len(a), len(lines[j])) <= 5 * min(len(a), len(lines[j])) and similar(lines[j], a):
                least, most = sorted((root[i], root[j]))
                root = [least if r == most else r for r in root]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(table).where("n_removed = 1").collect()}
    assert gone == {i for i, r in enumerate(root) if r != i} and len(gone) > 80


def test_near_copies_cost_a_few_pairs_each(spark, monkeypatch):
    """Copies with changes of their own, many of them too far from each other to link, and lines just too far from any: groups are whole, pairs few."""
    rng = np.random.default_rng(3)
    fresh = iter(f"w{i}" for i in range(100_000))
    base, lines = [next(fresh) for _ in range(80)], []
    for i in range(600):
        line = list(base)
        for at in rng.choice(range(5, 80), 9 if i < 400 else 14, replace=False):
            line[at] = next(fresh)
        lines.append(line)
    codes = np.array([[hash(w) for w in line] for line in lines])
    root = np.arange(len(lines))
    for i in range(len(lines)):
        for j in np.flatnonzero((codes[i] != codes[:i]).sum(axis=1) <= 16):
            root[root == max(root[i], root[j])] = min(root[i], root[j])
    compared, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(table).where("n_removed = 1").collect()}
    assert gone == {i for i, r in enumerate(root) if r != i} and len(gone) > 300
    assert sum(compared) < 40 * len(lines)


def test_buckets_of_the_same_members_are_compared_once(spark, monkeypatch):
    same = [(b, i) for b in range(40) for i in (1, 2, 3)] + [(100 + b, i) for b in range(40) for i in (4, 5)]
    members = spark.createDataFrame([*same, *((200, i) for i in (3, 4, 6)), *((201, i) for i in (3, 5, 6))], "bucket long, id long")
    facts = spark.createDataFrame([(i, 7) for i in range(1, 7)], "id long, n long")
    wrote, tried, cut = [], [], linking.cut
    monkeypatch.setattr(linking, "cut", lambda df, name="step": wrote.append((name, (out := cut(df, name)).count())) or out)
    verify = lambda pairs: tried.extend(map(tuple, pairs.collect())) or pairs.where("a = 1 or a = 4 or (a = 5 and b = 6)")
    out = {tuple(r) for r in linking.linked(members, facts, verify, lambda x, y: x("n") == y("n")).collect()}
    assert out == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)}
    assert len(tried) == len(set(tried)) and {(1, 2), (1, 3), (4, 5), (3, 4), (3, 6), (3, 5)} <= set(tried)
    assert max(n for name, n in wrote if name in ("members", "labels")) == 9


def test_lines_of_few_words_again_and_again_are_told_apart_by_their_counts(spark, monkeypatch):
    """Each word an even number of times leaves no odd bit: such lines that share a phrase aren't compared, near copies of one are."""
    lines = []
    for i in range(60):
        own = [f"w{i}x{k}" for k in range(6)] * 18
        lines += [[*own, "so", "it", "is", "said"], [*own[:50], "new", *own[51:80], *own[81:], "so", "it", "is", "said", f"at{i}"]]
    compared, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(table).where("n_removed = 1").collect()}
    assert gone == set(range(1, len(lines), 2))
    assert sum(compared) < 2 * len(lines)


def test_lines_that_share_only_a_phrase_are_not_compared_with_all_others(spark, monkeypatch):
    """A phrase of 300 lines, and 40 similar pairs among them that share nothing else in a row of four words: all are found, by a few comparisons each."""
    rows = []
    for i in range(150):
        tail = [f"t{i}x{k}" for k in range(10)]
        near = [f"u{i}x{k}" if k % 3 == 0 else w for k, w in enumerate(tail)] if i < 40 else [f"v{i}x{k}" for k in range(10)]
        rows += [(2 * i + e, " ".join([*(f"h{k}" for k in range(10)), *end])) for e, end in enumerate((tail, near))]
    looks, cut = [], linking.cut

    def count(df, name="step"):
        out = cut(df, name)
        if name == "labels":
            looks.append(sum(r["count"] ** 2 for r in out.groupBy("bucket").count().collect()))
        return out

    monkeypatch.setattr(linking, "cut", count)
    gone = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 1").collect()}
    assert gone == set(range(1, 80, 2))
    assert looks[-1] < 10 * len(rows)


def test_similar_lines_share_a_part(spark):
    """Lines with as many edits as are allowed, of many and of few different words, have one of their rarest pairs of words in common."""
    rng = np.random.default_rng(9)
    texts, pairs = [], []
    for n in [*range(5, 45), 99, 100, 104]:
        for words in (3, 12, 20_000):
            for _ in range(4):
                a = [int(w) for w in rng.integers(words, size=n)]
                b, grown = list(a), 0
                for _ in range(int(rng.integers(n // 5 + 1)) if n % 5 < 4 else (n + 1) // 5):
                    at, how = int(rng.integers(len(b))), rng.integers(3)
                    if (how == 0 or (n % 5 == 4 and not grown)) and len(b) < (n + 1) // 5 * 5:
                        b.insert(at, int(rng.integers(words)))
                        grown += 1
                    elif how == 1 and len(b) > n:
                        del b[at]
                    else:
                        b[at] = int(rng.integers(words))
                pairs.append((len(texts), len(texts) + 1))
                texts += [(len(texts), len(a), a), (len(texts) + 1, len(b), b)]
    table = spark.createDataFrame(texts, "key long, n int, words array<int>")
    parts = {}
    for r in line_dedup._parts(table, table.select(table.key.alias("id")), line_dedup.SIMILARITY).collect():
        parts.setdefault(r.id, set()).add(r.bucket)
    assert all(parts[a] & parts[b] for a, b in pairs)
    assert all(len(parts[i]) <= 2 * ((n + 1) // 5) + 1 for i, n, _ in texts)


def test_splitting_takes_only_the_runs_that_edits_can_break(spark, monkeypatch):
    """Of 60 lines of 40 words, 17 runs each at most are dealt out, not all 39; a line alone has no part, even if its runs repeat."""
    texts = [(i, 40, [*range(10), *range(100 + 30 * i, 130 + 30 * i)]) for i in range(60)] + [(60, 40, [*range(10), *range(100, 125), *range(9000, 9005)]), (61, 20, [19_001, 19_002] * 10)]
    dealt, shared = [], line_dedup.shared_members
    monkeypatch.setattr(line_dedup, "shared_members", lambda entries: dealt.append(entries.count()) or shared(entries))
    table = spark.createDataFrame(texts, "key long, n int, words array<int>")
    parts = line_dedup._parts(table, table.select(table.key.alias("id")), line_dedup.SIMILARITY).collect()
    assert dealt and dealt[0] <= 61 * 17 + 2
    assert {r.id for r in parts} == {0, 60}


def test_lines_that_meet_by_chance_go_before_their_texts_are_read(spark, monkeypatch):
    """Of 200 lines that share a run of four words, and pairs of which 20 are similar, only those have their texts read; with a bucket too large for looks at each, all have."""
    rows = []
    for i in range(100):
        own = [f"a{i}x{k}" for k in range(26)]
        near = [f"b{i}x{k}" if k % 7 == 0 or i >= 20 else w for k, w in enumerate(own)]
        rows += [(2 * i + e, " ".join(["one", "run", "of", "all", *line])) for e, line in enumerate((own, near))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    read, cut = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df, name="step": ((out := cut(df, name)), read.append(out.count()) if name == "line-texts" else None)[0])
    gone = lambda: {r.doc_id for r in line_dedup.dedup_lines(table).where("n_removed = 1").collect()}
    assert gone() == set(range(1, 40, 2)) and read.pop() <= 50
    monkeypatch.setattr(linking, "CROWD", 1)
    assert gone() == set(range(1, 40, 2)) and read.pop() >= 150


def test_no_pair_is_ruled_out_by_odd_words(spark):
    """Lines with as many edits as are allowed, repeated words included, may link by their lengths and odd words."""
    rng, pairs = np.random.default_rng(21), []
    for n in [*range(5, 45), 60, 100, 200]:
        for words in (3, 12, 20_000):
            a = [f"w{w}" for w in rng.integers(words, size=n)]
            b = list(a)
            for _ in range(n // 5):
                at, how = int(rng.integers(len(b))), rng.integers(3)
                if how == 0 and len(b) > n:
                    del b[at]
                elif how == 1:
                    b.insert(at, f"w{rng.integers(words)}")
                else:
                    b[at] = f"w{rng.integers(words)}"
            pairs.append((a, b, len(a), len(b)))
    table = spark.createDataFrame(pairs, "a array<string>, b array<string>, n_x int, n_y int").withColumns({"odd_x": line_dedup._odd(F.col("a")), "odd_y": line_dedup._odd(F.col("b"))})
    assert table.where(line_dedup._might(line_dedup.SIMILARITY)(lambda c: F.col(f"{c}_x"), lambda c: F.col(f"{c}_y"))).count() == len(pairs)


def test_words_are_coded_without_a_list_in_the_plan(spark):
    table = spark.createDataFrame([([0, 1, 7, 19_999, 7],)], "words array<int>").select(line_dedup._codes(F.col("words")).alias("codes"))
    assert [ord(c) - ord(table.first().codes[0]) for c in table.first().codes] == [0, 1, 7, 19_999, 7]
    assert len(table._jdf.queryExecution().toString()) < 20_000


def test_a_bucket_is_split_only_if_that_costs_less_than_its_pairs(spark):
    members = spark.createDataFrame([(1, i) for i in range(130)], "bucket long, id long")
    asked = []
    for n in (5, 60):
        facts = spark.createDataFrame([(i, n) for i in range(130)], "id long, n long")
        split = lambda ids, n=n: asked.append(n) or ids.select((ids.id % 65).alias("bucket"), "id")
        out = linking.linked(members, facts, lambda pairs: pairs.where("b - a = 65"), lambda x, y: x("n") == y("n"), split=(split, "n"))
        assert {tuple(r) for r in out.collect()} == {(i, i % 65) for i in range(130)}
    assert asked == [5]


def test_a_word_is_hashed_once_for_all_its_runs(spark, monkeypatch):
    """Only one expression reads the words of a line, one by one: longer runs are made up of shorter ones."""
    plans, cut = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df, name="step": plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df, name))
    same = "one line of twenty words that is long enough for runs of four and no longer than it has to be here now"
    rows = [(1, f"{same}\na short line of six words"), (2, f"{same.replace('twenty', 'some')}\na short line of seven words"), (3, f"{same.replace('now', '')}\nnothing that is like it")]
    gone = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, gone)) == [(1, 0), (2, 2), (3, 1)]
    plan = dict(plans)["lines"]
    assert plan.count("lambdafunction(hash(") == plan.count("transform(words") == 1


def test_facts_and_components_are_joined_to_ids_not_to_each_of_their_buckets(spark, monkeypatch):
    """140 ids in six buckets, split into parts of which each has five: no join on ids makes more rows than there are ids, on the way to the same components."""
    members = spark.createDataFrame([(b, i) for b in range(6) for i in range(140) if b == 0 or i % 50 != b], "bucket long, id long")
    facts = spark.createDataFrame([(i, 5) for i in range(140)], "id long, n long")
    split = lambda ids: ids.select(F.explode(F.array(*((ids.id % 70) * 5 + F.lit(k) for k in range(5)))).alias("bucket"), "id")
    made, join = [], type(members).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "id":
            made.append(out.count())
        return out

    monkeypatch.setattr(type(members), "join", counted)
    out = linking.linked(members, facts, lambda pairs: pairs.where("b - a = 70"), lambda x, y: x("n") == y("n"), split=(split, "n"))
    assert {tuple(r) for r in out.collect()} == {(i, i % 70) for i in range(140)}
    assert len(made) >= 4 and max(made) <= 140


def test_packing(spark, docs):
    rows = nnls_packing.pack(docs, WORD).collect()
    for doc_id, n in Counter(r.doc_id for r in rows if r.doc_id not in (None, 7)).items():
        own = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == doc_id)
        assert sum(x[1] for x in own) == own[0][2] and own[0][0] == 0 and len(own) == n
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert nnls_packing.pack(docs.limit(0), WORD).count() == 0


def test_language(spark, docs):
    rows = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs).collect()}
    assert {(4, "und"), (5, "und"), (9, "und")} <= rows and len(rows) == 10
    assert language_id.identify(docs.limit(0)).count() == 0
    kept = language_id.predict(docs, None)
    assert kept.columns.count("score") == 1 and {r.lang_pred for r in kept.collect()} == {"und"}


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[50:80] = x[10] + rng.normal(size=(30, 8)) * 0.15
    x[90:120] = x[11]
    rows = [(i, v.tolist(), int(i % 3 and 1)) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1100, [0.0] * 8, 1), (1200, [float("nan")] + [1.0] * 7, 1), (1300, [None] + [1.0] * 7, 1), (1400, x[10].tolist(), None), (1500, [float("inf")] * 8, 1)]
    return x, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rank string")


def test_neighbours_find_what_brute_force_finds(spark, vectors):
    x, table = vectors
    x = np.vstack([x, x[10]])
    ids = [*range(300), 1400]
    got = graph_ann.nearest(table, every=20, shard=100).collect()
    hit = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        want = [i for _, i in sorted((s, i) for s, i in zip(d, ids) if i != q)][:10]
        own = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [r for r, _ in own] == list(range(1, 11))
        hit, total = hit + len({i for _, i in own} & set(want)), total + 10
    assert hit / total >= 0.95
    assert graph_ann.nearest(table.limit(0)).count() == 0
    assert graph_ann.nearest(table.where("vec_id < 4"), every=2).count() == 6


def test_embedding_groups_are_those_of_brute_force(spark, vectors):
    x, table = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([int(i % 3 and 1) for i in range(300)])
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    group = list(range(300))
    for _ in range(300):
        for a, b in zip(*np.nonzero(near)):
            group[a] = group[b] = min(group[a], group[b])
    got = {r.vec_id: r for r in cell_dedup.near_duplicates(table).collect()}
    assert len(got) == 306
    for i in range(300):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), group[i], group[i] == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(1000, 1501, 100))
    assert cell_dedup.near_duplicates(table.limit(0)).count() == 0


def test_cells_lose_no_link():
    rng = np.random.default_rng(3)
    u = cell_dedup.unit(np.repeat(rng.normal(size=(60, 6)), 10, axis=0) + rng.normal(size=(600, 6)) * 0.2)
    row, cell, home = cell_dedup.visits(u, cell_dedup.fit(u, 12), 0.93)
    cells = {}
    for r, c, h in zip(row, cell, home):
        cells.setdefault(c, []).append((r, h))
    met = {frozenset((a, b)) for rows in cells.values() for (a, ha), (b, hb) in itertools.combinations(rows, 2) if ha or hb}
    assert all(frozenset(p) in met for p in zip(*np.nonzero(np.triu(u @ u.T >= 0.93, 1))))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (250, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 250: 200, 300: 200}


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ü", "x" * 200), (2, "http://b", "x" * 200), (3, None, None), (4, "u", "short"), (5, "v", "short"), (None, "w", "x" * 200), (6, "z", "é" * 90_000)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.archive_pages(pages, f"file://{tmp_path}").collect()}
    assert len(got) == 7 and all(r.gap is None for r in got.values())
    assert (got[2].record_type, got[2].refers_to, got[2].payload_bytes) == ("revisit", 1, 200) and got[1].record_type == "response"
    assert (got[None].record_type, got[None].refers_to) == ("revisit", 1)
    assert got[3].payload_bytes == 0 and got[5].record_type == "response" and got[6].payload_bytes == 180_000
    assert bytes(got[6].payload).decode() == "é" * 90_000
    assert warc.archive_pages(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    (tmp_path / "sf").mkdir()
    line = prose(5, 30)
    rows = [(i, f"{prose(100 + i, 120)}\n{line}", "en", "s", 1) for i in range(12)] + [(50, "12345", "en", "s", 1), (51, f"{prose(100, 120)}\n{line}", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/sf/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/sf").collect()
    assert {r.doc_id for r in out} == set(range(12))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "packing"]


def test_pipeline_keeps_one_of_rows_that_share_an_id_or_have_none(spark, tmp_path):
    import corpus_pipeline

    a, b, c, e = (f"{prose(300 + i, 60)}" for i in range(4))
    rows = [(1, a), (1, a), (1, b), (2, c), (None, c), (None, e), (None, e)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = sorted([(1, a), (1, b), (2, c), (None, e)], key=repr)
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_lines):
        assert sorted(((r.doc_id, r.text) for r in stage(spark, docs, "").collect()), key=repr) == want
