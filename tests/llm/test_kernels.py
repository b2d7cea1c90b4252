"""The numpy and Python kernels against the libraries and plain definitions."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import byte_gru, dart_minhash, nnls_packing, piece_bpe, ring, shingles, warc, word_bpe

WORD, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))
TEXT = st.text(st.one_of(st.sampled_from("abz'sÉßΣİ 1½<|>\n\t\x1c\x85  ▁한"), st.characters(codec="utf-8")), max_size=60)
ODD = ["", "<|endoftext|> a<|startoftext|>b", "don't ''s !'s ΑΣ Σ İ", "\x1cx\x1f", "a  b ", " ", "▁x", "a\n\n b", "=" * 77, "aaaa" * 40, "the" + "́" * 4, "x" * 3000, "😀 ퟿"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def test_counts_and_ids_are_the_library_s(tokenizer, pieces):
    @settings(max_examples=150, deadline=None)
    @given(TEXT)
    def check(text):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert word_bpe.counter(WORD).count(text) == len(ids)
        assert nnls_packing.ids_of(WORD).encode([text, text])[1] == np.array(ids, "<u4").tobytes()
        own = piece_bpe.encoder(PIECE)
        assert own.encode(text) == [*pieces.encode(text), 2]
        assert own.decode(own.written(text)) == pieces.decode([*pieces.encode(text), 2])

    check()
    for text in ODD:
        check.hypothesis.inner_test(text)
    assert word_bpe.counter(WORD).count(None) == 0 and piece_bpe.encoder(PIECE).encode(None) == [2]


def test_plan_uses_every_piece_once_and_pads_little():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.lognormal(6.2, 1.0, 20_000).astype(int) + 1)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    planned = nnls_packing.plan(histogram)
    used = {}
    for n, use in planned:
        assert sum(x * m for x, m in use) <= 4096
        for x, m in use:
            used[x] = used.get(x, 0) + n * m
    assert used == histogram
    assert lengths.sum() / (4096 * sum(n for n, _ in planned)) > 0.97
    assert nnls_packing.plan({}) == []


def test_nnls_finds_an_exact_solution():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    assert np.allclose(a @ nnls_packing.nnls(a, np.array([4.0, 3.0])), [4, 3])


def test_ring_flow_fills_all_shards_evenly():
    runs = ring.flow([100, 0, 3, 7], [0, 1, 2, 1], 3)
    rows = {}
    for arc, first, last, shard, slot in runs:
        rows.setdefault(shard, []).extend(range(slot, slot + last - first + 1))
    assert sorted(map(len, rows.values())) == [36, 37, 37]
    assert all(sorted(r) == list(range(len(r))) for r in rows.values())


def test_signatures_estimate_weighted_similarity():
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-40] + [f"z{i}" for i in range(40)])]
    doc, element, count, _, _ = shingles.shingles(texts)
    edge = np.searchsorted(doc, [0, 1, 2])
    part = [(element[edge[i] : edge[i + 1]], count[edge[i] : edge[i + 1]]) for i in range(2)]
    s = dart_minhash.signatures(doc, element, count * 1.5, 2, 1000)
    assert abs((s[0] == s[1]).mean() - shingles.similarity(*part)) < 0.06
    assert shingles.similarity(*part) == pytest.approx(356 / (396 * 2 - 356))


def test_gradients_agree_with_differences():
    net = byte_gru.Gru(["a", "b", "c"])
    x, y, mask = np.random.default_rng(0).integers(0, 255, (6, 3)), np.array([0, 1, 2]), np.ones((6, 3))
    net.w = {k: w.astype(np.float64) for k, w in net.w.items()}
    _, grads = net.gradients(x, y, mask)
    for k, i in (("uf", (1, 2)), ("ub", (3, 9)), ("v", (1, 2)), ("ef", (int(x[2, 1]), 3))):
        losses = []
        for step in (1e-3, -2e-3):
            net.w[k][i] += step
            losses.append(net.gradients(x, y, mask)[0])
        net.w[k][i] += 1e-3
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(grads[k][i], abs=1e-5)


def records(n=6):
    return [warc.record("response", i, f"http://x/{i}", b"payload %d " % i * 30, __import__("hashlib").sha256(b"payload %d " % i * 30).hexdigest(), None) for i in range(n)]


@pytest.mark.parametrize("pack", [warc.gzipped, bytes])
def test_salvage_recovers_later_records_and_logs_gaps(pack):
    parts = [pack(r) for r in records()]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = parts[0] + parts[1] + bytes(broken) + b"junk" * 9 + b"".join(parts[3:5]) + parts[5][:-20]
    found = list(warc.salvage(io.BytesIO(data)))
    assert [warc._id(h["warc-record-id"]) for _, _, h, _, _ in found if h] == [0, 1, 3, 4]
    assert len([1 for *_, why in found if why]) == 2
    at = 0
    for start, length, *_ in found:
        assert start == at
        at += length
    assert at == len(data)
    assert list(warc.salvage(io.BytesIO(b""))) == []
    assert zlib.crc32(found[0][3]) == zlib.crc32(b"payload 0 " * 30)


def test_salvage_of_foreign_archives():
    import base64
    import hashlib

    def foreign(i, version="1.0", digest=None, kind="text/html", block=b"a payload"):
        extra = f"WARC-Payload-Digest: {digest}\r\n" if digest else ""
        return f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Type: {kind}\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nbody"
    good = [foreign(0), foreign(1, "1.1"), foreign(2, digest=sha1(b"a payload")), foreign(3, digest="blake3:00"), foreign(4, digest=sha1(b"body"), kind="application/http; msgtype=response", block=http)]
    bad = foreign(9, digest=sha1(b"another"))
    ids = lambda data: [h and warc._id(h["warc-record-id"]) for _, _, h, _, _ in warc.salvage(io.BytesIO(data))]
    assert ids(b"".join(good)) == ids(warc.gzipped(b"".join(good))) == ids(b"".join(map(warc.gzipped, good))) == [0, 1, 2, 3, 4]
    data = warc.gzipped(good[0] + bad + good[1]) + warc.gzipped(bad) + warc.gzipped(good[2] + good[3])
    assert ids(data) == [0, None, 1, None, 2, 3]
    assert sum(n for _, n, _, _, _ in warc.salvage(io.BytesIO(data))) == len(data)
