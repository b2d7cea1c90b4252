"""Token counts by heap-and-linked-list byte-pair merging, for tokenizer files with word ends.

A text is normalised and cut into words as the tokenizer file says (NFC, white space, lower case; letters,
single digits and runs of other signs; letters and numbers by the tables of the tokenizer's library). A word starts as one symbol a byte, the last with a word end. A heap
holds the rank and place of each adjacent pair that may merge; the lowest rank, then the leftmost, is popped,
checked against the linked list and merged. The count is the number of initial symbols less the merges; no
identifiers are made. Words repeat, so each worker keeps their counts in a table of bounded size.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from functools import lru_cache

#: Entries that a worker keeps of words, none longer than LONG characters; a full table starts anew.
KEEP_WORDS, LONG = 450_000, 48
# Fixed values of the tokenizer file's format: how words are found and what ends them.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Letters and other number signs below U+0180, in lower case below it, too, which no version of Unicode has moved; texts of these signs need no library.
_LETTERS, _NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff\u0100-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+").findall
#: White space of Python's alone, a capital that becomes two signs, and all signs from U+0180 on but common punctuation.
_ODD = re.compile("[\x1c-\x1f\u0130\u0180-\u200a\u200b-\u200f\u202a-\u202e\u2030-\U0010ffff]").search


class Splitter:
    """The words of whole texts, normalised, as the tokenizer file says: plain texts by one pattern, others by the library's own tables."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self._normal = self.tok.normalizer.normalize_str
        self._split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True).pre_tokenize_str

    def words(self, text: str) -> list[str]:
        if _ODD(text) is None:
            return _PLAIN(text.lower())
        return [w for w, _ in self._split(self._normal(text))]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in set(plain))
    return [chr(c) for _, c in sorted([(b, b) for b in plain] + [(b, 256 + i) for i, b in enumerate(rest)])]


class Merger:
    """Counts of single words."""

    def __init__(self, spec: dict):
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.final = [ids[c + WORD_END] for c in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {ids[a] << 20 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]

    def count(self, word: str) -> int:
        data = word.encode("utf-8", "surrogatepass")
        n = len(data)
        if n < 2:
            return n
        inner, rank_of, merged, push, pop = self.inner, self.ranks.get, self.merged, heapq.heappush, heapq.heappop
        symbols = [inner[b] for b in data]
        symbols[-1] = self.final[data[-1]]
        heap = []  # rank and place in one number
        a = symbols[0]
        for i in range(1, n):
            b = symbols[i]
            if (rank := rank_of(a << 20 | b)) is not None:
                heap.append(rank << 32 | i - 1)
            a = b
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        left = n
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 20 | symbols[j]) != top >> 32:
                continue  # one of the two has been merged since
            symbols[i] = new = merged[top >> 32]
            symbols[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(new << 20 | symbols[k])) is not None:
                    push(heap, rank << 32 | i)
            h = before[i]
            if h >= 0 and (rank := rank_of(symbols[h] << 20 | new)) is not None:
                push(heap, rank << 32 | h)
        return left


class _Words(dict):
    def __init__(self, merger: Merger):
        self.merger = merger

    def __missing__(self, word: str) -> int:
        n = self.merger.count(word)
        if len(word) <= LONG:
            if len(self) >= KEEP_WORDS:
                self.clear()
            self[word] = n
        return n


class Counter:
    """Token counts of whole texts under one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.find = Splitter(path).words
        self.words = _Words(Merger(spec))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = [s[:2] for s in special]

    def _plain(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.find(text)))

    def count(self, text: str | None) -> int:
        """Tokens of the text; null counts as empty. A special token's string in the text is one token."""
        if not text:
            return 0
        if self.special and any(m in text for m in self.marks) and (parts := self.special.split(text))[1:]:
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each file and worker process."""
    return Counter(path)
