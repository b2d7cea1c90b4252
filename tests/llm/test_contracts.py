"""The queries' results against plain loops and the libraries: whole rings, all pairs, ids and digests, extremes, spoilt archives, odd rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quern.llm import cell_dedup, common, dart_minhash, graph_ann, language_id, line_dedup, nnls_packing, piece_roundtrip, ring, shingles, token_count, warc, word_bpe

WORD, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def test_words_of_every_letter_are_the_library_s(tokenizer):
    """All code points, alone and beside letters and signs: no version of Unicode but the library's own counts."""
    counter = word_bpe.counter(WORD)
    ids = nnls_packing.ids_of(WORD)
    letters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(letters), 4000):
        some = letters[at : at + 4000]
        texts = [f"a{c} :{c} {c}é{c}b" for c in some]
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [counter.count(t) for t in texts] == list(map(len, want))
        if at % 40_000 == 0:
            assert ids.encode(texts) == [np.array(w, "<u4").tobytes() for w in want]


def test_token_counts_of_rows(spark, tokenizer):
    texts = ["", None, "héllo <|endoftext|> wörld", "a\x1cb c　d", "x" * 5000, "the " * 2049, "the " * 2048]
    rows = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_count.count_tokens(rows, WORD).collect()}
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        r = got[i if i else None]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 2048)


def test_pieces_hold_the_library_s_ids(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "hello there"), (7, None), (9_000, "ab " * 9000)], "doc_id long, text string"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"))
    pieces = {}
    for r in nnls_packing.pack(docs, WORD).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for doc_id, all_ids in texts.items():
        crcs = Counter((zlib.crc32(ids[s : s + 4096].tobytes()), s, len(ids[s : s + 4096]), len(ids)) for ids in all_ids for s in range(0, len(ids), 4096))
        assert Counter((r.ids_crc32, r.start, r.length, r.doc_tokens) for r in pieces[doc_id]) == crcs
    used = Counter()
    for rows in pieces.values():
        for r in rows:
            used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096


def test_digests_are_the_library_s(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).unionByName(spark.createDataFrame([(5_000, None, None, None, None), (5_001, "​ ﬁ \x00 \t", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    got = {r.doc_id: r for r in piece_roundtrip.digests(docs, PIECE).collect()}
    for r in docs.collect():
        ids = [*sp.encode(r.text or ""), sp.eos_id()]
        own = got[r.doc_id]
        assert own.n_tokens == len(ids) and own.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_the_ring_walked_row_by_row(spark):
    """Homes are those of the next point clockwise; bounds hold; a row leaves its home only if that is full; few move with one more shard."""
    rows = [(i, "t" * (i % 7)) for i in range(900)] + [(None, "n")] * 300 + [(None, f"m{i}") for i in range(40)] + [(5, "again")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    places = {(r.doc_id, r.place) for r in docs.select("doc_id", F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long"))).alias("place")).distinct().collect()}
    homes = {}
    for n in (6, 7):
        points = ring._points(n, 128)
        own = {d: next((s for p, s in points if p >= at), points[0][1]) for d, at in places}
        placed = ring.shard(docs, n).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in placed) == Counter((d, len(t) + 1, zlib.crc32(t.encode())) for d, t in rows)
        counts = Counter(r.shard for r in placed)
        assert max(counts.values()) - min(counts.values()) <= 1 and all(r.home_shard == own[r.doc_id] for r in placed)
        for s in range(n):
            assert sorted(r.slot for r in placed if r.shard == s) == list(range(counts[s]))
        wanted = Counter(r.home_shard for r in placed)
        stay = Counter(r.shard for r in placed if r.shard == r.home_shard)
        assert all(stay[s] == min(wanted[s], counts[s]) for s in range(n))
        homes[n] = own
    moved = [d for d in homes[6] if homes[6][d] != homes[7][d]]
    assert all(homes[7][d] == 6 for d in moved) and len(moved) < 0.3 * len(homes[6])


def test_document_groups_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(25):
        base = rng.choice(words, int(rng.integers(30, 200))).tolist()
        for k in range(int(rng.integers(1, 6))):
            own = list(base)
            for at in rng.choice(len(own), int(rng.integers(0, 4)), replace=False):
                own[at] = f"x{rng.integers(10**6)}"
            texts.append(" ".join(own))
    texts += ["one two", "one two", "a b c d e f"]
    doc, element, count, _, _ = shingles.shingles(texts)
    part = [(element[doc == i], count[doc == i]) for i in range(len(texts))]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if shingles.similarity(part[i], part[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in dart_minhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < len(root) - 20


def test_parities_rule_no_similar_pair_out(spark):
    """The bound on differing parities holds for counted shingles, at the threshold and beyond."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        base = [f"v{rng.integers(50)}" for _ in range(300)]
        other = list(base)
        for at in rng.choice(300, int(rng.integers(1, 12)), replace=False):
            other[at] = "edited"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = {r.doc_id: r for r in dart_minhash._sign(docs, 20, 4).collect()}
    doc, element, count, _, _ = shingles.shingles([t for _, t in rows])
    for i in range(60):
        a, b = signed[2 * i], signed[2 * i + 1]
        s = shingles.similarity((element[doc == 2 * i], count[doc == 2 * i]), (element[doc == 2 * i + 1], count[doc == 2 * i + 1]))
        apart = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(a.parities, b.parities))
        assert apart <= (a.size + b.size) * (1 - s) / (1 + s) + 1e-6


def test_rows_that_repeat_an_id_go_by_their_own_texts(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a), (1, b), (2, b), (3, a), (4, c), (None, c), (1, None)]
    got = sorted(map(tuple, dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, None, True), (1, 1, True)], key=repr)


def test_most_similar_lines_are_found_wherever_the_edits_are(spark):
    """Word edit similarity of exactly 0.8 and 0.9: at random places nearly all are found, at even ones (the worst case) over 0.85."""
    rng = np.random.default_rng(6)
    rows, kinds = [], {}
    for n in (10, 20, 40, 100):
        for share in (10, 5):
            for how in ("random", "even"):
                for _ in range(40):
                    a = [f"w{rng.integers(10**7)}" for _ in range(n)]
                    b = list(a)
                    many = n // share
                    for p in rng.choice(n, many, replace=False) if how == "random" else [int((i + 0.5) * n / many) for i in range(many)]:
                        b[p] = f"x{rng.integers(10**7)}"
                    kinds[len(rows) + 1] = (share, how)
                    rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    gone = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 1").collect()}
    assert gone <= kinds.keys()
    found, of = Counter(kinds[g] for g in gone), Counter(kinds.values())
    assert all(found[k] / of[k] >= (0.85 if k == (5, "even") else 0.98) for k in of)


@pytest.mark.parametrize("scale, offset", [(1.0, 3000.0), (1e20, 0.0), (1e-20, 0.0), (1e200, 0.0)])
def test_neighbours_of_extreme_vectors(scale, offset):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16)) * scale + offset
    g = graph_ann.Graph(x)
    found, _ = g.search(x[:40], 64)
    hit = 0
    for i in range(40):
        order = np.argsort(((x / scale - x[i] / scale) ** 2).sum(axis=1))[:11]
        hit += len(set(order) & set(found[i]))
    assert hit / 440 >= 0.95
    assert np.isfinite(graph_ann.distances(x, x[0])).all()


def test_neighbours_with_repeated_ids_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph_ann, "BLOCK", 3)
    rows = [(i, [float(i), 0.0]) for i in range(40)] + [(7, [7.5, 0.0]), (41, [3.0, 0.0]), (42, [3.0, 0.0]), (43, [1.0])]
    got = graph_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=4, k=4, shard=16).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(by) == list(range(4, 40, 4))  # the zero vector takes no part
    assert [v for _, v, _ in sorted(by[4])] == [3, 5, 41, 42] and [v for _, v, _ in sorted(by[8])] == [7, 7, 9, 6]
    assert all([r for r, _, _ in sorted(v)] == [1, 2, 3, 4] and [s for _, _, s in sorted(v)] == sorted(s for _, _, s in v) for v in by.values())


def test_vectors_that_share_an_id_and_many_cells(spark, monkeypatch):
    monkeypatch.setattr(cell_dedup, "CELL", 8)
    monkeypatch.setattr(cell_dedup, "BLOCK", 4)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(20, 6)), 6, axis=0) + rng.normal(size=(120, 6)) * 0.12
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)] + [(3, x[3].tolist(), 1), (3, [1e300, 0.0, 0.0, 0.0, 0.0, 0.0], 1)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    got = {}
    for r in cell_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect():
        got.setdefault(r.vec_id, []).append(r)
    assert len(got[3]) == 3 and sum(map(len, got.values())) == 122
    for i in range(120):
        assert any(r.n_links == near[i].sum() - 1 + bool(near[i][3]) for r in got[i])


def test_a_spoilt_archive_is_read_around(spark, tmp_path):
    """A damaged record in the middle is a gap with its bytes; all others come back, through Spark."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 40) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(pages, f"file://{tmp_path}")
    path = archives.first().archive.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    members = [i for i in range(len(data) - 2) if data[i : i + 3] == bytes([31, 139, 8])]
    at = members[len(members) // 2] + 20
    data[at : at + 8] = bytes(8)
    open(path, "wb").write(bytes(data))
    got = warc.read_archives(archives).collect()
    read, gaps = [r for r in got if r.gap is None], [r for r in got if r.gap is not None]
    assert len(gaps) == 1 and len(read) == 29 and len({r.page_id for r in read}) == 29
    assert gaps[0].start <= at < gaps[0].start + gaps[0].length


def test_unlabelled_and_repeated_rows_learn_and_predict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    many = docs.limit(3)
    for _ in range(4):
        many = many.unionByName(many)
    rows = docs.unionByName(many).unionByName(spark.createDataFrame([(None, "hello", "en"), (10**6, "bonjour", None), (10**6 + 1, "...", "fr")], "doc_id long, text string, lang string"))
    got = language_id.identify(rows).collect()
    assert len(got) == rows.count() and {r.lang_pred for r in got} <= {r.lang for r in docs.select("lang").distinct().collect()} | {"und"}
    assert [r.lang_pred for r in got if r.doc_id == 10**6 + 1] == ["und"] and all(0 <= r.score <= 1 for r in got)


def test_stages_take_nulls_blanks_and_empty_tables(spark):
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(50))
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_lines string"
    rows = [(1, text, "en", None, None, "k", "l"), (2, None, None, None, None, None, None), (3, "", "en", "s", 0, "k", "l"), (None, text, "en", "s", 3, "k", "l"), (4, "\n \n", None, "s", 3, "k", "l")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0
        if name != "packing":
            assert out.columns == docs.columns == empty.columns
        ids = Counter(r.doc_id for r in out.collect())
        assert ids == {"language_id": Counter({1: 1, None: 1}), "line_dedup": Counter({1: 1, 2: 1, 3: 1, 4: 1}), "near_dedup": Counter({1: 1, 2: 1, 3: 1, 4: 1}), "packing": Counter({1: 1, 2: 1, 3: 1, 4: 1, None: 1})}[name]


def test_tables_between_steps_are_deleted(spark, tmp_path, monkeypatch):
    with pytest.raises(RuntimeError):
        common.shared_dir(_Far())
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    docs = spark.createDataFrame([(i, f"some words of line {i % 3} here\nand one more line that is number {i}") for i in range(9)], "doc_id long, text string")
    line_dedup.dedup_lines(docs).count()
    dart_minhash.near_duplicates(docs).count()
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["quern-near_duplicates", "quern-removed_lines"]


class _Far:
    class conf:
        get = staticmethod(lambda *a: None)

    class sparkContext:
        master = "yarn"

        @staticmethod
        def getConf():
            return {}
