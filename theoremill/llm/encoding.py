"""Encoding of texts by a public byte-level BPE vocabulary.

Texts are cut into pre-tokens by the vocabulary's pattern; a pre-token is encoded with a rank queue: for
each merge rank a bucket of positions in the linked list of its symbols, and a bitmap of three levels over
the ranks, in which find-first-set gives the lowest rank with a waiting pair. An entry whose pair has gone
is stale and skipped. The cost is n log n in the pre-token's length, so one "word" of megabytes is no
trouble. Frequent pre-tokens are kept in a bounded table.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.llm.workers import once

#: Where the vocabulary files lie; a parameter of every function that needs one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pre-token pattern of the vocabulary (contractions, letters, digits, others, white space).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens kept per Python worker, and the longest one that is kept.
KEPT, KEPT_LENGTH = 300_000, 64


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Byte strings and their ids (also the merge ranks) of a vocabulary file."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


class RankSet:
    """Set of ranks below ``limit``: bitmaps of 64 bits in levels; a bit above says a word below is not 0."""

    def __init__(self, limit: int) -> None:
        self.levels = []
        while True:
            limit = (limit + 63) >> 6
            self.levels.append([0] * limit)
            if limit == 1:
                break

    def add(self, rank: int) -> None:
        for words in self.levels:
            at, bit = rank >> 6, 1 << (rank & 63)
            if words[at] & bit:
                return
            words[at] |= bit
            rank = at

    def remove(self, rank: int) -> None:
        for words in self.levels:
            at = rank >> 6
            words[at] &= ~(1 << (rank & 63))
            if words[at]:
                return
            rank = at

    def first(self) -> int:
        """The lowest rank, -1 if there is none."""
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:
                return -1
            at = (at << 6) | ((word & -word).bit_length() - 1)
        return at


class Encoder:
    """Encodes texts with ``ranks``; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.waiting = RankSet(max(ranks.values()) + 1)
        self.buckets: dict[int, list[int]] = {}
        self.kept: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked pair merges first, of equal ones the leftmost."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, ranks, buckets, waiting = len(piece), self.ranks, self.buckets, self.waiting
        # Symbol i spans piece[i : end[i]]; before[i] is the symbol in front of it, end[i] the next one.
        end, before, alive = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1") * n

        def offer(i: int) -> None:
            if end[i] < n and (rank := ranks.get(piece[i : end[end[i]]])) is not None:
                bucket = buckets.get(rank)
                if bucket:
                    heapq.heappush(bucket, i)
                else:
                    buckets[rank] = [i]
                    waiting.add(rank)

        for i in range(n - 1):
            offer(i)
        while (rank := waiting.first()) >= 0:
            bucket = buckets[rank]
            i = heapq.heappop(bucket)
            if not bucket:
                waiting.remove(rank)
                del buckets[rank]
            if not alive[i] or end[i] >= n or ranks.get(piece[i : end[end[i]]]) != rank:
                continue  # stale
            j = end[i]
            end[i], alive[j] = end[j], 0
            if end[i] < n:
                before[end[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out, i, single = [], 0, self.single
        while i < n:
            out.append(single[piece[i]] if end[i] == i + 1 else ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text`` without special tokens; their strings are ordinary text; null and '' give []."""
        out: list[int] = []
        kept = self.kept
        for piece in self.split(text) if text else ():
            ids = kept.get(piece)
            if ids is None:
                ids = self.merge(piece.encode())
                if len(piece) <= KEPT_LENGTH:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out


def encode(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(``key``, ids): the ids of each row's text, in full; null and empty texts give an empty list.

    One pass without a shuffle. The driver reads the vocabulary once and broadcasts it (its size is fixed).
    Rows with a null key are kept; an empty table gives an empty result.
    """
    shared, name = texts.sparkSession.sparkContext.broadcast(read_ranks(vocabulary)), uuid.uuid4().hex
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(name, lambda: Encoder(shared.value))
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
