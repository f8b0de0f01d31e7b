"""Encoding of a corpus with a public byte-level BPE vocabulary, in linear time per word.

The vocabulary's byte strings are mapped to Latin-1, so that one pyahocorasick automaton over them finds, in
one pass over a word, the longest token that starts at each byte. The encoder takes longest tokens and backtracks:
a token may follow another only if merging by rank would keep their boundary. That test looks at two tokens
alone, so its answers are memoised; a failed position is never tried again, which bounds the work by the length.
The result equals that of merging pairs in rank order.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that splits a text into words before the merges of this vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Entries of the word cache of one Python worker; it is emptied when full, which changes no result.
CACHE_WORDS = 400_000


class Encoder:
    """Exact byte-level BPE over a rank file (base64 token and rank on each line)."""

    def __init__(self, path: str = DEFAULT_VOCABULARY, pattern: str = WORDS):
        import ahocorasick

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(t).decode("latin-1"): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.text = {r: t for t, r in self.rank.items()}
        self.size = {r: len(t) for t, r in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self._learn_merges()
        self.find = regex.compile(pattern).findall
        self.runs = re.compile(r"\s (?:\s|$)").search
        self.words = _Cache(lambda word: self.encode_word(word))
        self.segments = _Cache(lambda segment: self._encode_words(" " + segment))

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        known = self.shorter.get(token)
        if known is None:
            s = self.text[token]
            known = next((self.rank[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.rank), -1)
            self.shorter[token] = known
        return known

    def _learn_merges(self) -> None:
        """Recover each token's two halves: the pair of lower ranks whose boundary survives its own merges."""
        for token in sorted(self.text):
            s = self.text[token]
            left = self._prefix(token) if len(s) > 1 else -1
            while left >= 0:
                right = self.rank.get(s[self.size[left] :])
                if right is not None and left < token and right < token and self._boundary(left, right):
                    self.joined[left, right] = token
                    self.parts[token] = (left, right)
                    break
                left = self._prefix(left)
            else:
                self.parts[token] = (token, token)

    def _boundary(self, a: int, b: int) -> bool:
        """Whether rank-order merging leaves ``a`` and ``b`` as two tokens when their bytes meet."""
        limit = 1 << 62
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            if a > b:
                limit = a
                a = self.parts[a][1]
                if a == limit:
                    limit = b + 1
                    b = self.parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = self.parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = self.parts[a][1]
                    if a == limit:
                        return True

    def _may_follow(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[a, b] = self._boundary(a, b)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (no pre-splitting)."""
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.rank.get(raw)
        if whole is not None:
            return [whole]
        size, n = self.size, len(raw)
        longest = [-1] * n
        for end, token in self.automaton.iter(raw):
            start = end + 1 - size[token]
            if longest[start] < 0 or size[token] > size[longest[start]]:
                longest[start] = token
        open_at, out, pos, token = bytearray(b"\1") * (n + 1), [], 0, longest[0]
        while pos < n:
            last = out[-1] if out else -1
            while True:
                end = pos + size[token]
                if open_at[end] and (last < 0 or self._may_follow(last, token)):
                    out.append(token)
                    pos = end
                    token = longest[pos] if pos < n else -1
                    break
                token = self._prefix(token)
                if token < 0:  # nothing fits after ``last``: give it up and try a shorter one in its place
                    open_at[pos] = 0
                    out.pop()
                    pos -= size[last]
                    token = last
                    break
        return out

    def _encode_words(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.find(text))))

    def _ids(self, text: str) -> Iterator[int]:
        """A word never spans a space that is followed by something else, so a text may be cut before its spaces
        and each segment looked up whole, unless white space stands on both sides of a space."""
        if self.runs(text):
            return chain.from_iterable(map(self.words.__getitem__, self.find(text)))
        first, *rest = text.split(" ")
        return chain(self._encode_words(first), chain.from_iterable(map(self.segments.__getitem__, rest)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for null and for the empty text."""
        return list(self._ids(text)) if text else []

    def encode_batch(self, texts: list[str | None]) -> pa.ListArray:
        flat: list[np.ndarray] = []
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        total = 0
        for i, text in enumerate(texts):
            if text:
                ids = np.fromiter(self._ids(text), dtype=np.int32)
                flat.append(ids)
                total += len(ids)
            offsets[i + 1] = total
        values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


class _Cache(dict):
    """Ids by string, computed on first use."""

    def __init__(self, compute: Callable[[str], list[int]]):
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> list[int]:
        ids = self.compute(key)
        if len(key) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[key] = ids
        return ids


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str = DEFAULT_VOCABULARY, pattern: str = WORDS) -> Encoder:
    """The encoder of this process, built once."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_column`` and ``ids`` of every row: the token ids of its text, without special tokens.

    Null and empty texts give an empty list; blank texts are encoded as they stand; strings that look like
    special tokens are ordinary text; repeated rows stay. Other columns are not read. No shuffle.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 512):  # bounds the memory of one output batch
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), e.encode_batch(part.column(1).to_pylist())], [id_column, "ids"])

    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
