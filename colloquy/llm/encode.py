"""Encoding and decoding of a corpus with a public byte-level BPE vocabulary.

The encoder is a backtracking one: Aho-Corasick gives the longest token at each byte, and a token is only accepted
beside its left neighbour if the pair could survive the merge order; otherwise the next shorter token, then a step back,
is tried. That yields exactly the ids of the merge loop in time linear in the bytes. Decoding reads one byte blob through
an offset table.

An empty text gives an empty list, a null text gives null. Lone surrogates can't occur in Parquet strings. Special
tokens are never produced: their strings are encoded as ordinary text.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import ahocorasick
import numpy as np
import pyspark.sql.functions as F
import regex
from pyspark.sql import DataFrame

from colloquy.functions.lazy import arrow
from colloquy.session import spread

#: Where the public vocabularies lie; a parameter, as the files are never part of the repository.
VOCABULARIES = os.environ.get("COLLOQUY_TOKENIZERS", "/opt/tokenizers")
#: How byte_bpe_50k cuts a text before merging (fixed value, from the vocabulary's own description).
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker keeps, and the longest piece kept. These bound memory, not results.
KEPT, KEPT_BYTES = 200_000, 64


class Vocabulary:
    """Tables of one vocabulary of ranks: token bytes, how each token splits, and its longest proper prefix token."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ranks = ranks
        self.lengths = [len(t) for t in self.tokens]
        self.shorter = [self._prefix(t) for t in self.tokens]
        self.split: list[tuple[int, int]] = [(i, i) for i in range(len(self.tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for rank, token in enumerate(self.tokens):
            if token:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        for rank, token in sorted((r, t) for t, r in ranks.items() if len(t) > 1):
            # The last merge that builds a token joins the two tokens that its bytes reduce to with lower ranks only.
            pair = self._halves(token, rank)
            self.split[rank] = pair
            self.merged[pair] = rank
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.blob = b"".join(self.tokens)
        self._seen: dict[str, list[int]] = {}

    def _prefix(self, token: bytes) -> int:
        for end in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:end])) is not None:
                return rank
        return -1

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best = min((self.merged.get((a, b), rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] >= rank:
                raise ValueError(f"token {rank} can't be built by merges")
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts[0], parts[1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` can stand side by side, i.e. no earlier merge would have crossed their border."""
        limit = len(self.tokens)
        merged, split = self.merged, self.split
        while True:
            joint = merged.get((left, right))
            if joint is not None and joint < limit:
                return False
            if left > right:
                limit = left
                left = split[left][1]
                if left == limit:
                    limit = right + 1
                    right = split[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = split[right][0]
                if right + 1 == limit:
                    limit = left
                    left = split[left][1]
                    if left == limit:
                        return True

    def piece(self, data: str) -> list[int]:
        """Ids of one piece, given as a string of its bytes."""
        n = len(data)
        longest, sizes = [-1] * n, [0] * n
        lengths, shorter = self.lengths, self.shorter
        for end, rank in self.automaton.iter(data):
            start = end + 1 - lengths[rank]
            if lengths[rank] > sizes[start]:
                sizes[start], longest[start] = lengths[rank], rank
        if sizes[0] == n:
            return [longest[0]]
        open_, out, at, token = bytearray(b"\x01" * (n + 1)), [], 0, longest[0]
        while True:
            end = at + lengths[token]
            if open_[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_[at] = 0
                token = out.pop()
                at -= lengths[token]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        seen = self._seen
        for cut in _cut().findall(text):
            found = seen.get(cut)
            if found is None:
                data = cut.encode().decode("latin-1")
                found = self.piece(data)
                if len(data) <= KEPT_BYTES:
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen[cut] = found
            ids += found
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        starts, ends = self.offsets[ids], self.offsets[ids + 1]
        blob = self.blob
        return b"".join([blob[a:b] for a, b in zip(starts.tolist(), ends.tolist())])


@lru_cache(1)
def _cut() -> regex.Pattern:
    return regex.compile(CUT)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and path."""
    return Vocabulary(path)


def encoded(df: DataFrame, text: str = "text", ids: str = "ids", path: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``df`` with a column of ids; one pass, no shuffle. Other columns go through untouched, clashing ``ids`` is replaced."""

    @arrow("array<int>")
    def each(texts: list) -> list:
        encode = vocabulary(path).encode
        return [None if t is None else encode(t) for t in texts]

    return df.withColumn(ids, each(F.col(text)))


def decoded(df: DataFrame, ids: str = "ids", text: str = "text", path: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The inverse: null for null, bytes that are no UTF-8 (cut id lists) are replaced."""

    @arrow("string")
    def each(lists: list) -> list:
        decode = vocabulary(path).decode
        return [None if i is None else decode(np.asarray(i, dtype=np.int64)).decode("utf-8", "replace") for i in lists]

    return df.withColumn(text, each(F.col(ids)))


def ids_of(documents: DataFrame, path: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids) of each document."""
    return encoded(spread(documents.select("doc_id", "text")), path=path).select("doc_id", "ids")
