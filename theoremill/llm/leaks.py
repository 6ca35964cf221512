"""Evaluation texts inside training texts, by greedy string tiling.

Every test text gives Karp–Rabin hashes of its windows of SEED words (of all its words if it has fewer).
Documents are scanned once; where a window's hash is among the seeds, document and test text are tiled:
matching windows are extended along diagonals to maximal matches, the longest is marked, overlapping ones
are trimmed and queued again, until none of SEED words is left. The longest tile finds verbatim passages,
the share of the test text that tiles cover finds reordered ones.

Test texts are a stated query set. Equal ones are looked for once. While they fit a block they are broadcast and
documents never move; more of them become a table of seeds, and documents, still scanned once, pass on what hits a
bitmap of all seeds.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.runtime import BROADCAST_ROWS, cut, lookup, row_index, salted_join

#: Words of a seed, and the least length of a tile.
SEED = 8

#: Different test texts and their characters that are broadcast, after they have been counted.
BLOCK_ITEMS, BLOCK_CHARS = 50_000, 32_000_000
#: Bits of the bitmap of seeds, as a power of two.
BITMAP = 27
#: Matching windows of a document and a test text that are listed, besides four for each window they have; texts
#: with more are tiled in linear memory.
MOST_MATCHES = 200_000

_WORD = re.compile(rb"[a-z0-9]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Word hashes kept per Python worker.
_KEPT = 1_000_000


class Words:
    """Turns texts into arrays of 64-bit word hashes; words are runs of ASCII letters and digits."""

    def __init__(self) -> None:
        self.kept: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
        kept = self.kept
        if len(kept) > _KEPT:
            kept.clear()
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = kept.get(w)
            if h is None:
                h = kept[w] = xxhash.xxh64_intdigest(w)
            out[i] = h
        return out


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """Karp–Rabin hash of each run of ``length`` words."""
    n = len(words) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        with np.errstate(over="ignore"):
            for k in range(length):
                out = out * _BASE + words[k : k + n]
    return out


def tile(doc: np.ndarray, item: np.ndarray, least: int, hashes: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length) of non-overlapping matches of at least
    ``least`` words, the longest first (of equal ones the first in the item, then in the document).

    ``hashes``: the document's windows of ``least`` words, if they are known.
    """
    a, b = windows(item, least), windows(doc, least) if hashes is None else hashes
    order = np.argsort(a, kind="stable")
    left, right = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    counts = right - left
    total = int(counts.sum())
    if not total:
        return []
    if total > MOST_MATCHES + 4 * (len(a) + len(b)):
        return _tile_repetitive(doc, item, least)
    j = np.repeat(np.arange(len(b)), counts)
    i = order[np.repeat(left, counts) + np.arange(len(j)) - np.repeat(np.cumsum(counts) - counts, counts)]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    breaks = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (np.diff(i) != 1), True])
    queue = [(-(int(z - s) + least - 1), int(i[s]), int(j[s])) for s, z in zip(breaks, breaks[1:])]
    heapq.heapify(queue)
    used_item, used_doc, tiles = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while queue:
        length, at, start = heapq.heappop(queue)
        length = -length
        taken = used_item[at : at + length] | used_doc[start : start + length]
        if not taken.any():
            if np.array_equal(item[at : at + length], doc[start : start + length]):
                used_item[at : at + length] = used_doc[start : start + length] = True
                tiles.append((start, at, length))
            continue
        edges = np.flatnonzero(np.diff(np.r_[1, taken, 1].astype(np.int8)))
        for s, z in zip(edges[::2], edges[1::2]):
            if z - s >= least:
                heapq.heappush(queue, (-int(z - s), at + int(s), start + int(s)))
    return tiles


def _tile_repetitive(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The same tiles for texts whose windows recur so often that their matches can't be listed: the longest
    common run of unmarked words is found by bisection over its length, in memory linear in the texts.

    Hashes of runs of 2^k words, two of which cover a run of any length, are made once.
    """
    powers = [np.r_[item, doc].astype(np.uint64)]
    with np.errstate(over="ignore"):
        while 2 << (len(powers) - 1) <= len(item):
            h, w = powers[-1], 1 << (len(powers) - 1)
            powers.append(h[: len(h) - w] * _BASE ^ (h[w:] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7)) + h[w:])
    free = np.ones(len(item) + len(doc), bool)
    tiles = []

    def runs(length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of unmarked words in the item and in the document; runs with marked ones get
        numbers of their own."""
        k = length.bit_length() - 1
        h, shift = powers[k], length - (1 << k)
        with np.errstate(over="ignore"):
            whole = h[: len(h) - shift] * _BASE ^ h[shift:]
        n = len(item) + len(doc) - length + 1
        blocked = np.r_[0, np.cumsum(~free)]
        clear = blocked[length:] == blocked[:n]
        of_item = np.flatnonzero(clear[: max(len(item) - length + 1, 0)])
        of_doc = len(item) + np.flatnonzero(clear[len(item) :])
        return np.c_[whole[of_item], of_item.astype(np.uint64)], np.c_[whole[of_doc], of_doc.astype(np.uint64)]

    def common(length: int) -> bool:
        mine, theirs = runs(length)
        return bool(np.isin(mine[:, 0], theirs[:, 0]).any())

    most = min(len(item), len(doc))
    while most >= least and common(least):
        low, high = least, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        # All tiles of this length, the longest there is; what they leave is shorter.
        mine, theirs = runs(low)
        theirs = theirs[np.argsort(theirs[:, 0], kind="stable")]
        ahead = np.searchsorted(theirs[:, 0], mine[:, 0])
        for (h, at), k in zip(mine.tolist(), ahead.tolist()):
            while k < len(theirs) and theirs[k, 0] == h and free[at : at + low].all():
                start = int(theirs[k, 1])
                if free[start : start + low].all() and np.array_equal(item[at : at + low], doc[start - len(item) : start - len(item) + low]):
                    free[at : at + low] = free[start : start + low] = False
                    tiles.append((start - len(item), at, low))
                k += 1
        most = low - 1
    return tiles


_ROW = "text_id long, longest int, covered int, tiles int, words int"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]


def _described(text_id: int, tiles: list[tuple[int, int, int]], words: int) -> tuple:
    return text_id, tiles[0][2], sum(t[2] for t in tiles), len(tiles), words


def _pass(documents: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """One scan of ``documents`` against all test texts (text_id, words), which fit a broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast([tuple(r) for r in texts.select("text_id", "words").collect()])  # at most BLOCK_ITEMS rows and BLOCK_CHARS characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = Words()
        items = [(i, w) for i, t in shared.value if len(w := words_of(t))]
        seeds: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for k, (_, w) in enumerate(items):
            length = min(SEED, len(w))
            for h in windows(w, length).tolist():
                seeds[length][h].add(k)
        sets = {length: np.array(sorted(hashes), np.uint64) for length, hashes in seeds.items()}
        for batch in batches:
            rows: list[tuple] = []
            docs = [words_of(t) for t in batch.column(1).to_pylist()]
            flat = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
            starts = np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int64)
            of = np.repeat(np.arange(len(docs)), np.diff(starts))
            hits: set[tuple[int, int, int]] = set()
            hashed = {}
            for length, known in sets.items():
                h = hashed[length] = windows(flat, length)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                found = np.flatnonzero((known[at] == h) & (of[: len(h)] == of[length - 1 :])) if len(h) else []
                for p in found:
                    hits.update((int(of[p]), length, k) for k in seeds[length][int(h[p])])
            for d, length, k in sorted(hits):
                i, w = items[k]
                if tiles := tile(docs[d], w, length, hashed[length][starts[d] : starts[d + 1] - length + 1]):
                    rows.append((d, *_described(i, tiles, len(w))))
            columns = list(zip(*rows)) or [[]] * 6
            made = [pa.array(c, t) for c, t in zip(columns[1:], _KINDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *made], ["doc", *[f.split()[0] for f in _ROW.split(", ")]])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter("text is not null").mapInArrow(run, f"doc {kind}, {_ROW}")


def _joined(documents: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """The same for any number of test texts. The documents are scanned once against a bitmap of all seeds,
    whose size is fixed; those with a hit pass on their words and hits, which meet the seeds in a join."""
    sc = documents.sparkSession.sparkContext

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = Words()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(t)
                if len(w):
                    length = min(SEED, len(w))
                    h = np.unique(windows(w, length))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), length, np.int32)), pa.array(np.full(len(h), i, np.int64))], ["hash", "length", "text_id"])

    seeds = cut(texts.select("text_id", "words").mapInArrow(seeds_of, "hash long, length int, text_id long"))
    lengths = [r.length for r in seeds.select("length").distinct().collect()]  # at most SEED rows
    bits = 1 << BITMAP
    # Each task sets the bits of its seeds; few bitmaps of fixed size are or-ed on the driver.
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1))
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["bitmap"])

    held = np.zeros(bits // 8, np.uint8)
    for row in seeds.select("hash").coalesce(8).mapInArrow(mark, "bitmap binary").toLocalIterator():
        held |= np.frombuffer(row.bitmap, np.uint8)
    shared = sc.broadcast(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, known = Words(), shared.value
        for batch in batches:
            at, own, hits = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                w = words_of(t)
                h = np.unique(np.concatenate([windows(w, length) for length in lengths])) if lengths else w[:0]
                bit = h & np.uint64(bits - 1)
                h = h[(known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                if len(h):
                    at.append(i)
                    own.append(w.view(np.int64))
                    hits.append(h.view(np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(own, kind), pa.array(hits, kind)], ["doc", "own", "hits"])

    kind = documents.schema[key].dataType.simpleString()
    held_docs = cut(documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter("text is not null").mapInArrow(scan, f"doc {kind}, own array<long>, hits array<long>"))
    pairs = cut(salted_join(held_docs.select("doc", F.explode("hits").alias("hash")), seeds.select("hash", "text_id"), "hash").select("doc", "text_id").distinct())
    wide = lookup(lookup(pairs, held_docs.select("doc", "own"), "doc"), texts.select("text_id", "words"), "text_id")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = Words()
        for batch in batches:
            rows = []
            for k, (i, t) in enumerate(zip(batch.column("text_id").to_pylist(), batch.column("words").to_pylist())):
                w = words_of(t)
                if tiles := tile(batch.column("own")[k].values.to_numpy().view(np.uint64), w, min(SEED, len(w))):
                    rows.append((k, *_described(i, tiles, len(w))))
            columns = list(zip(*rows)) or [[]] * 6
            made = [pa.array(c, t) for c, t in zip(columns[1:], _KINDS)]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(columns[0], pa.int64())), *made], ["doc", *[f.split()[0] for f in _ROW.split(", ")]])

    return wide.select("doc", "own", "text_id", "words").mapInArrow(tiled, f"doc {kind}, {_ROW}")


def leaks(documents: DataFrame, items: DataFrame, verbatim: int = 12, share: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, part, longest, covered, tiles, words, verbatim): test texts found in documents.

    ``items`` has item_id, query and passage. A row stands for a document that holds ``verbatim``
    consecutive words of the passage, or all words of the query in one run (verbatim = true), or whose
    tiles cover ``share`` of the text in any order. Null and empty texts, and those without words, match
    nothing; rows with a null item_id are left out; repeated rows give one row.
    """
    parts = cut(items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.posexplode(F.array("passage", "query")).alias("part", "words")).filter("words <> ''").distinct())
    # Equal test texts are looked for once, by the least item that has them.
    named = F.xxhash64("words", F.lit(0)), F.xxhash64(F.lit(1), "words")
    marked = parts.withColumns({"h": named[0], "g": named[1]})
    texts = cut(row_index(marked.groupBy("h", "g").agg(F.min("words").alias("words")), ["h", "g"], "text_id"))
    n, chars = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    search = _pass if n <= BLOCK_ITEMS and chars <= BLOCK_CHARS else _joined
    found = search(documents, texts, key, text)
    owners = cut(marked.join(texts.select("h", "g", "text_id"), ["h", "g"]).select("text_id", "item_id", "part"))
    whole = F.when(F.col("part") == 0, F.col("longest") >= verbatim).otherwise(F.col("longest") == F.col("words"))
    kept = found.filter((F.col("longest") >= F.least(F.lit(verbatim), "words")) | (F.col("covered") >= share * F.col("words")))
    side = F.broadcast(owners) if owners.count() <= BROADCAST_ROWS else None
    joined = kept.join(side, "text_id") if side is not None else salted_join(kept, owners, "text_id")
    return (
        joined.withColumn("verbatim", whole)
        .filter(F.col("verbatim") | (F.col("covered") >= share * F.col("words")))
        .withColumn("part", F.when(F.col("part") == 0, "passage").otherwise("query"))
        .select(F.col("doc").alias(key), "item_id", "part", "longest", "covered", "tiles", "words", "verbatim")
        .distinct()
    )
