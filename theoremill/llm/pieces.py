"""Splitting of oversized items at natural boundaries, by balanced targets.

The least possible number of pieces is computed, equally long targets are placed, each is moved to the
strongest boundary near it, and pieces are added until every one keeps the limit. A piece repeats the last
``overlap`` tokens of the one before. Tokens are runs of characters other than blank, tab, CR and LF; an
item's pieces are slices of its own text, so nothing between their tokens is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.runtime import latest

_TOKEN = re.compile(r"[^ \t\r\n]+")
#: Ends of a sentence and of a clause, also before closing quotes and brackets.
_SENTENCE = re.compile(r"[.!?。！？…][\"'”’»)\]]*$")
_CLAUSE = re.compile(r"[,;:，；：、—–][\"'”’»)\]]*$")
_HEADING = re.compile(r"(?:#+|[-*+•]|\d+[.)]|\(\*\*?)$")


def boundary(text: str, left: tuple[int, int], right: tuple[int, int]) -> int:
    """How natural a cut between two neighbouring tokens (start, end) of ``text`` is, from 0 to 6."""
    gap = text[left[1] : right[0]].replace("\r\n", "\n").replace("\r", "\n")
    last = text[max(left[0], left[1] - 8) : left[1]]
    lines = gap.count("\n")
    if lines > 1:
        return 6
    if lines and _HEADING.search(text[right[0] : min(right[1], right[0] + 8)]):
        return 5
    if _SENTENCE.search(last):
        return 4 + (lines > 0)
    if lines:
        return 3
    return 2 if _CLAUSE.search(last) else 0


def cut_ends(n: int, strength, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces of ``n`` tokens; ``strength(i)`` rates a cut in front of token i.

    Piece k holds the tokens from the end before minus ``overlap`` to its own end.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than the limit")
    if n <= limit:
        return [n]
    count = -(-(n - overlap) // (limit - overlap))
    while True:
        step = (n - overlap) / count
        reach, ends, last = int(step // 4), [], overlap
        for k in range(1, count):
            target = round(overlap + k * step)
            options = range(max(last + 1, target - reach), min(n - 1, target + reach) + 1)
            last = max(options, key=lambda i: (strength(i), -abs(i - target), i), default=target)
            ends.append(last)
        ends.append(n)
        starts = [0, *(e - overlap for e in ends[:-1])]
        if all(0 < e - s <= limit for s, e in zip(starts, ends)) and all(a < b for a, b in zip(ends, ends[1:])):
            return ends
        if step <= 4:  # no room to move left: the plain cuts keep every limit
            plain = [*range(limit, n, limit - overlap), n]
            return plain
        count += 1


def split_text(text: str, limit: int = 400, overlap: int = 40) -> list[tuple[int, int, int, int]]:
    """(first token, end token, first character, end character) of each piece of ``text``."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if not spans:
        return []
    rated: dict[int, int] = {}

    def strength(i: int) -> int:
        if i not in rated:
            rated[i] = boundary(text, spans[i - 1], spans[i])
        return rated[i]

    ends = cut_ends(len(spans), strength, limit, overlap)
    starts = [0, *(e - overlap for e in ends[:-1])]
    return [(s, e, spans[s][0], spans[e - 1][1]) for s, e in zip(starts, ends)]


def split_items(items: DataFrame, limit: int = 400, overlap: int = 40, with_text: bool = True) -> DataFrame:
    """Pieces of the items (chunk_id, item_no, section_path, item) that hold more than ``limit`` tokens.

    Columns chunk_id, item_no, section_path, piece_no (from 0), first_token, n_tokens and piece (null
    unless ``with_text``). Null, empty and blank items, and those within the limit, give no row; other
    columns are ignored. One Python pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            for i, text in enumerate(batch.column("item").to_pylist()):
                found = split_text(text, limit, overlap)
                if len(found) > 1:
                    keep += [i] * len(found)
                    rows += [(k, s, e - s, text[a:z] if with_text else None) for k, (s, e, a, z) in enumerate(found)]
            at = pa.array(np.array(keep, dtype=np.int64))
            columns = list(zip(*rows)) or [[]] * 4
            kept = [batch.column(c).take(at) for c in ("chunk_id", "item_no", "section_path")]
            made = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays(kept + made, ["chunk_id", "item_no", "section_path", "piece_no", "first_token", "n_tokens", "piece"])

    # More than limit tokens need more than 2 * limit characters; shorter items needn't leave the JVM.
    return (
        items.filter(F.length("item") > 2 * limit)
        .select(F.col("chunk_id").cast("long"), F.col("item_no").cast("int"), "section_path", "item")
        .mapInArrow(run, "chunk_id long, item_no int, section_path array<string>, piece_no int, first_token int, n_tokens int, piece string")
    )


def chunk_items(chunks: DataFrame) -> DataFrame:
    """(chunk_id, item_no, item, section_path): item 0 is the text, item i the i-th code block, nulls counted.

    Of rows with one id the latest built_at counts; rows with a null id are left out.
    """
    rows = latest(chunks.select("id", "text", "code_blocks", "section_path", "built_at"), "id", ["built_at"])
    blocks = F.coalesce("code_blocks", F.array().cast("array<string>"))
    return rows.select(F.col("id").alias("chunk_id"), "section_path", F.posexplode(F.concat(F.array("text"), blocks)).alias("item_no", "item"))


def chunk_pieces(chunks: DataFrame, limit: int = 400, overlap: int = 40, with_text: bool = True) -> DataFrame:
    """:func:`split_items` over all texts and code blocks of ``chunks``, each piece with its section_path."""
    return split_items(chunk_items(chunks), limit, overlap, with_text)
