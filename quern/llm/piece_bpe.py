"""SentencePiece BPE by a merge-type prefix table, and decoding.

For every prefix of a unit the last token of its encoding is unique. A token that ends at a place (found by
an automaton over the vocabulary) is that last token if it follows the last token of the prefix before it
without their merging otherwise: the pair, encoded by itself, must give just these two tokens. The table of
last tokens is filled from left to right and the ids are read from its end backwards. Pair tests are small
and are kept.

A text is cut into units first: no piece holds a space mark after another character, so merges never cross
the start of a run of space marks; and no merge crosses two neighbouring characters that no piece holds side
by side. Characters that are no piece become byte pieces.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import ahocorasick
import sentencepiece

#: Entries that a worker keeps of words (dear), of mixed units and their parts, and of pair tests; a full table starts anew.
KEEP_WORDS, KEEP_MIXED, KEEP_PAIRS = 700_000, 150_000, 300_000
SPACE = "▁"
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Pieces:
    """The vocabulary of a model file with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.control = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.byte_of = [int(self.piece[i][1:-1], 16) if sp.is_byte(i) else -1 for i in range(n)]
        self.byte_id = {b: i for i, b in enumerate(self.byte_of) if b >= 0}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        self.score = {self.piece[i]: sp.get_score(i) for i in range(n) if not (self.control[i] or self.byte_of[i] >= 0)}
        self.id = {self.piece[i]: i for i in range(n) if self.piece[i] in self.score}
        self.side_by_side = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) > 1:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()


def merge(pieces: Pieces, text: str) -> list[str]:
    """The tokens of a short text by plain merging: best score first, then leftmost."""
    score, n = pieces.score, len(text)
    symbols, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-score[p], i, len(p)) for i in range(n - 1) if (p := text[i : i + 2]) in score]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (p := symbols[i] + symbols[k]) in score:
                heapq.heappush(heap, (-score[p], i, len(p)))
        if (h := before[i]) >= 0 and (p := symbols[h] + symbols[i]) in score:
            heapq.heappush(heap, (-score[p], h, len(p)))
    return [s for s in symbols if s]


class _Words(dict):
    """Ids of words, each with a space mark before it."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> str:
        if not word.isalpha():
            return self.encoder.unit(SPACE + word)
        if len(self) >= KEEP_WORDS:
            self.clear()
        out = self[word] = self.encoder._ids(SPACE + word)
        return out


class Encoder:
    """Encodes and decodes whole texts. Ids are kept in decimal, joined by single spaces."""

    def __init__(self, path: str):
        self.pieces = p = Pieces(path)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = _Words(self)
        self.mixed: dict[str, str] = {}
        surface = lambda i: p.piece[i].replace(SPACE, " ")
        #: Text of each id, but for bytes that may be part of a longer character.
        self.surface = {str(i): "" if i != p.unknown and p.control[i] else " ⁇ " if i == p.unknown else chr(p.byte_of[i]) if p.byte_of[i] >= 0 else surface(i) for i in range(len(p.piece)) if p.byte_of[i] < 128}

    def _follows(self, a: str, b: str) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= KEEP_PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = (a[-1] + b[0]) not in self.pieces.side_by_side or merge(self.pieces, a + b) == [a, b]
        return ok

    def last_tokens(self, s: str) -> list[str]:
        """For each prefix of `s`, the last token of its encoding; a character that is no piece stands for itself."""
        last, settled, pairs = list(s), -1, self.pairs
        for end, token in self.pieces.automaton.iter(s):  # at each end the longest first
            if end == settled:
                continue
            start = end + 1 - len(token)
            if start == 0 or ((ok := pairs.get((last[start - 1], token))) is None and self._follows(last[start - 1], token)) or ok:
                last[end], settled = token, end
        return last

    def _ids(self, s: str) -> str:
        last, pieces, back, i = self.last_tokens(s), self.pieces, [], len(s)
        while i:
            token = last[i - 1]
            if (t := pieces.id.get(token)) is not None:
                back.append(t)
            else:
                back += [pieces.byte_id.get(b, pieces.unknown) for b in reversed(token.encode("utf-8", "surrogatepass"))] if pieces.byte_id else [pieces.unknown]
            i -= len(token)
        return " ".join(map(str, reversed(back)))

    def unit(self, s: str) -> str:
        """Ids of a unit, of any length, cut where no piece holds the two neighbouring characters."""
        out = self.mixed.get(s)
        if out is None:
            side, start, parts = self.pieces.side_by_side, 0, []
            for i in range(1, len(s) + 1):
                if i == len(s) or s[i - 1 : i + 1] not in side:
                    part = s[start:i]
                    parts.append(self.words[part[1:]] if part[0] == SPACE and part[1:].isalpha() else self._ids(part))
                    start = i
            if len(self.mixed) >= KEEP_MIXED:
                self.mixed.clear()
            out = self.mixed[s] = " ".join(parts)
        return out

    def written(self, text: str | None) -> str:
        """Ids in decimal, the end id last, joined by single spaces; null counts as empty."""
        end = str(self.pieces.end)
        if not text:
            return end
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return " ".join([*map(self.unit, _UNITS.findall(SPACE + text.replace(" ", SPACE))), end])
        return " ".join([*map(self.words.__getitem__, text.split(" ")), end])

    def encode(self, text: str | None) -> list[int]:
        """Ids with the end id."""
        return list(map(int, self.written(text).split(" ")))

    def decode(self, written: str) -> str:
        """Text of ids in decimal: the first space mark goes, control pieces are nothing, bytes are read as UTF-8."""
        ids = written.split(" ")
        try:
            text = "".join(map(self.surface.__getitem__, ids))
        except KeyError:  # bytes over 127
            out, raw = [], bytearray()
            for i in ids:
                if (b := self.pieces.byte_of[int(i)]) >= 128:
                    raw.append(b)
                    continue
                if raw:
                    out.append(utf8(bytes(raw)))
                    raw.clear()
                out.append(self.surface[i])
            text = "".join([*out, utf8(bytes(raw))])
        return text[1:] if self.pieces.piece[int(ids[0])].startswith(SPACE) else text


def utf8(raw: bytes) -> str:
    """UTF-8, each byte that belongs to no whole character read as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[: e.start].decode() + "�" + utf8(raw[e.start + 1 :])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    return Encoder(path)
