"""Encoding of text by a public byte-pair tokenizer.

The text is split into words by the tokenizer's pattern; distinct words are encoded once
per task and looked up after that. New words are walked in sorted order, which is a
depth-first walk of their trie: the states of a prefix shared with the word before are
kept, only the rest is computed. The state of a prefix is the last token of its encoding.
The last token of a longer prefix is the one of its suffixes in the vocabulary that may
follow the last token of what precedes it, and exactly one may: a pair of tokens may
stand together if the merges of their joined bytes give the pair back. So a word costs
one step per byte beyond its shared prefix, whatever its length.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import spread

#: Where the public vocabulary files lie; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words that a task remembers.
REMEMBERED = 400_000
#: Documents worked on at once within a batch.
STEP = 256

_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{L}\p{N}" + _WHITE + r"]+|["
    + _WHITE + r"]+(?![^" + _WHITE + r"])|[" + _WHITE + r"]+"
)
_ASCII_WORDS = re.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


class PrefixEncoder(dict):
    """Word -> tuple of token ids, filled by ``learn``."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import regex

        super().__init__()
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.longest = max(map(len, self.ranks))
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.may: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.words = regex.compile(_WORDS)

    def split(self, text: str) -> list[str]:
        return (_ASCII_WORDS if text.isascii() else self.words).findall(text)

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of a short piece by its merges, lowest rank first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [ranks[p] for p in parts]

    def _reached(self, token: int) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        known = self.may.get((a, b))
        if known is None:
            known = self.may[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def learn(self, words: Iterable[str]) -> None:
        """Encodes distinct words by one walk of their trie."""
        ranks, longest = self.ranks, self.longest
        before = b""
        last: list[tuple[int, int]] = [(-1, 0)]  # per prefix length: last token, its bytes
        for word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            data, text = word
            n = len(data)
            d = 0
            for d in range(min(n, len(before)) + 1):
                if d == n or d == len(before) or data[d] != before[d]:
                    break
            del last[d + 1 :]
            for end in range(d + 1, n + 1):
                for start in range(max(0, end - longest), end):
                    token = ranks.get(data[start:end])
                    if token is None or not self._reached(token):
                        continue
                    if start == 0 or self._may_follow(last[start][0], token):
                        last.append((token, end - start))
                        break
            ids, end = [], n
            while end:
                token, size = last[end]
                ids.append(token)
                end -= size
            self[text] = tuple(reversed(ids))
            before = data

    def encode(self, texts: list[str | None]) -> Iterator[list[str]]:
        """The words of each text, after learning those that are new; None is empty."""
        for k in range(0, len(texts), STEP):
            split = [self.split(t) if t else [] for t in texts[k : k + STEP]]
            new = set(chain.from_iterable(split)).difference(self)
            if len(self) + len(new) > REMEMBERED:
                self.clear()
                self.may.clear()
                new = set(chain.from_iterable(split))
            self.learn(new)
            yield from split


def token_ids(docs: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of every row: the token ids of its text, without special tokens;
    strings that look like special tokens are ordinary text. Null and empty texts have
    no ids: an empty list. Repeated rows stay repeated; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PrefixEncoder(vocabulary)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for words in encoder.encode(batch.column(1).to_pylist()):
                flat.extend(chain.from_iterable(map(encoder.__getitem__, words)))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return spread(docs.select(F.col(doc).cast("long"), text)).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of every row; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PrefixEncoder(vocabulary)
        for batch in batches:
            n = [sum(map(len, map(encoder.__getitem__, words))) for words in encoder.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return spread(docs.select(F.col(doc).cast("long"), text)).mapInArrow(run, "doc_id long, n_tokens long")
