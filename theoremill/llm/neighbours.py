"""The most similar vectors of every vector, through learned partitions.

The vectors are read once and kept as unit half floats; equal ones are found by their hashes and stand for
one, so a third of all rows may be copies. Partitions and router (:mod:`theoremill.llm.partitions`) are fitted
in a task on a bounded sample; then every vector is indexed under its most probable part and asks the most
probable ones. Where parts would be larger than a block, because there are more vectors than MAX_PARTS parts
can take or because they lie dense, such a part gets a router of its own for a second level. What is still
larger is cut into blocks by id; queries are copied to every block of a part they ask. One shuffle brings the
vectors to their blocks, which are scanned by matrix products; a second one merges the few best of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from theoremill.llm.partitions import Router, balanced_parts, fit_router, neighbour_graph, top, unit
from theoremill.runtime import BROADCAST_ROWS, cut, latest, lookup, release

#: Vectors of a part, greatest number of parts of one router, parts that a vector asks on each level.
PART_ROWS, MAX_PARTS, PROBES = 1_200, 1_024, 4
#: The sample for fitting a router: so many vectors for each part, between these bounds.
SAMPLE_PER_PART, SAMPLE_LEAST, SAMPLE_MOST = 32, 8_192, 24_576
#: Indexed vectors of a block; a part with more gets a second level, and blocks if that isn't enough.
BLOCK_ROWS = 20_000
#: Queries that are multiplied with a block at once.
QUERY_ROWS = 1_024
#: Cosines of half floats this near to a bound are computed again from the floats.
HALF_ERROR = 5e-4


def _sound(rows: DataFrame, key: str, vector: str, order: str, width: int) -> DataFrame:
    """(id, at, vector) of the rows with a key and a usable vector."""
    return rows.select(F.col(key).cast("long").alias("id"), F.col(order).alias("at"), F.col(vector).alias("vector")).filter(
        F.col("id").isNotNull() & (F.size("vector") == width) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    )


def valid_vectors(rows: DataFrame, key: str, vector: str, order: str, width: int) -> DataFrame:
    """(id, vector): one per key; null, zero, short or long vectors and those with NaN or infinite entries
    take no part. Of valid rows with one key the one latest by ``order`` counts (of equal ones the one with the
    greatest hashes); null keys are left out."""
    sound = _sound(rows, key, vector, order, width).withColumns({"h": F.xxhash64("vector"), "g": F.xxhash64(F.lit(1), "vector")})
    return latest(sound, "id", ["at", "h", "g"]).select("id", "vector")


def unit_vectors(rows: DataFrame, key: str, vector: str, order: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(id, h, g, v) of :func:`valid_vectors`: two hashes of the vector, and the vector as unit half floats; and
    the written table they come from. The input is read once; what follows reads the columns it needs of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            v = [x.tobytes() for x in unit(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)).astype(np.float16)] if len(lists) else []
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("id", "at", "h", "g")), pa.array(v, pa.binary())], ["id", "at", "h", "g", "v"])

    sound = _sound(rows, key, vector, order, width)
    hashed = sound.select("id", "at", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g"), "vector")
    kept = cut(hashed.mapInArrow(run, f"id long, at {sound.schema['at'].dataType.simpleString()}, h long, g long, v binary"))
    return latest(kept, "id", ["at", "h", "g"]).select("id", "h", "g", "v"), kept


def _copies(vectors: DataFrame) -> DataFrame:
    """(id, rep) of the ids whose vector another id has too; ``rep`` is the smallest of these."""
    keys = vectors.select("id", F.concat_ws(":", "h", "g").alias("hg"))
    several = keys.groupBy("hg").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).filter("n > 1").select("hg", "rep")
    return cut(lookup(keys, cut(several), "hg").select("id", "rep"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Half floats of a binary column as rows of float32."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)


def _power(parts: float, most: int) -> int:
    """The least power of two that is at least ``parts``, but at most ``most``."""
    return min(most, 1 << max(0, math.ceil(math.log2(max(parts, 1)))))


def _train(x: np.ndarray, parts: int) -> Router:
    graph = neighbour_graph(x, 10, block=256)
    return fit_router(x, graph, balanced_parts(x, graph, parts), parts)


def fit(vectors: DataFrame, n: int) -> Router:
    """Router fitted on a sample whose size is bounded by SAMPLE_MOST, in one task; only the router, at most
    width x MAX_PARTS floats, comes to the driver."""
    parts = _power(n / PART_ROWS, MAX_PARTS)
    nothing = Router(np.zeros((0, 0), np.float32), np.zeros(1, np.float32))
    if parts == 1:
        return nothing
    size = min(SAMPLE_MOST, max(SAMPLE_LEAST, SAMPLE_PER_PART * parts))
    share = int((1 << 30) * min(1.0, 1.1 * size / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_matrix(b.column(0)) for b in batches if b.num_rows]
        if sum(map(len, held)) < 4 * parts:
            return
        router = _train(unit(np.concatenate(held)), parts)
        yield pa.RecordBatch.from_arrays([pa.array([router.weights.tobytes()]), pa.array([router.bias.tobytes()])], ["weights", "bias"])

    picked = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select("v").limit(size)
    row = picked.repartition(1).mapInArrow(run, "weights binary, bias binary").first()
    if row is None:
        return nothing
    return Router(np.frombuffer(row.weights, np.float32).reshape(-1, parts), np.frombuffer(row.bias, np.float32))


def _ask(router: Router, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(home, asked) for rows of ``x``: the most probable part, and the ``probes`` most probable ones."""
    scores = router.scores(x)
    asked = top(scores, probes)
    return np.take_along_axis(asked, np.take_along_axis(scores, asked, 1).argmax(1)[:, None], 1)[:, 0], asked


def _lists(asked: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(asked) + 1, dtype=np.int32) * asked.shape[1]), pa.array(asked.astype(np.int64).ravel()))


def _place(vectors: DataFrame, probes: int, n: int) -> DataFrame:
    """(id, home, asked, v): the part that each vector is indexed under, and those it asks."""
    router = vectors.sparkSession.sparkContext.broadcast(fit(vectors, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: Router = router.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                home, asked = _ask(r, x, probes) if r.weights.size else (np.zeros(len(x), np.int64), np.zeros((len(x), 1), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(home, pa.int64()), _lists(asked), batch.column("v")], ["id", "home", "asked", "v"])

    return cut(vectors.select("id", "v").mapInArrow(run, "id long, home long, asked array<long>, v binary"))


def _place_again(placed: DataFrame, dense: DataFrame, probes: int) -> DataFrame:
    """``placed`` with a second level for the parts in ``dense`` (part, n): each gets a router, fitted in a task
    on a bounded sample of its own vectors, and its vectors get parts of it, numbered above all of the first
    level's. Routers travel to the vectors of their part, never to the driver."""
    shares = dense.select(F.col("part").alias("home"), (F.lit(1.1) * F.greatest(F.lit(SAMPLE_LEAST), F.least(F.lit(SAMPLE_MOST), F.col("n") * SAMPLE_PER_PART / PART_ROWS)) / F.col("n")).alias("share"), F.col("n").alias("rows"))
    picked = placed.select("home", "id", "v").join(F.broadcast(shares), "home").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < (1 << 30) * F.col("share"))  # at most MAX_PARTS rows

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, held = None, 0, []

        def done() -> Iterator[pa.RecordBatch]:
            parts = _power(rows / PART_ROWS, MAX_PARTS)
            x = np.concatenate(held)[:SAMPLE_MOST] if held else np.zeros((0, 1))
            if parts > 1 and len(x) >= 4 * parts:
                router = _train(unit(x), parts)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.vstack([router.weights, router.bias[None]]).tobytes()])], ["part", "router"])

        for batch in batches:
            homes = batch.column("home").to_numpy()
            edges = np.flatnonzero(np.r_[True, np.diff(homes) != 0, True])
            for s, e in zip(edges, edges[1:]):
                if homes[s] != part:
                    if part is not None:
                        yield from done()
                    part, rows, held = int(homes[s]), batch.column("rows")[int(s)].as_py(), []
                if sum(map(len, held)) < SAMPLE_MOST:
                    held.append(_matrix(batch.column("v").slice(s, e - s)))
        if part is not None:
            yield from done()

    routers = cut(picked.select("home", "rows", "v").repartition("home").sortWithinPartitions("home").mapInArrow(learn, "part long, router binary"))
    # Vectors meet the router of a part in slices of about a block, the router in front.
    slices = F.broadcast(dense.select("part", F.ceil(F.col("n") * probes / BLOCK_ROWS).cast("int").alias("slices")).join(routers.select("part"), "part"))  # at most MAX_PARTS rows
    each = placed.select("id", "home", F.explode("asked").alias("part"), "v")
    asks = each.join(slices, "part").select("part", F.pmod(F.xxhash64("id"), "slices").cast("int").alias("slice"), "id", (F.col("part") == F.col("home")).alias("own"), "v")
    ahead = routers.join(slices, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("long").alias("id"), F.lit(False).alias("own"), F.col("router").alias("v"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, at = None, None
        for batch in batches:
            parts, ids = batch.column("part").to_numpy(), batch.column("id")
            fresh = ids.is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (np.diff(parts) != 0) | fresh[1:] | fresh[:-1], True])
            for s, e in zip(edges, edges[1:]):
                if fresh[s]:
                    router, at = np.frombuffer(batch.column("v")[int(s)].as_py(), np.float32), int(parts[s])
                    continue
                x = _matrix(batch.column("v").slice(s, e - s))
                table = router.reshape(x.shape[1] + 1, -1)
                home, asked = _ask(Router(table[:-1], table[-1]), x, probes)
                shift = (at + 1) * MAX_PARTS
                yield pa.RecordBatch.from_arrays([ids.slice(s, e - s), batch.column("own").slice(s, e - s), pa.array(shift + home), _lists(shift + asked)], ["id", "own", "home", "asked"])

    routed = cut(asks.unionByName(ahead).repartition("part", "slice").sortWithinPartitions("part", "slice", F.col("id").isNotNull()).select("part", "id", "own", "v").mapInArrow(route, "id long, own boolean, home long, asked array<long>"))
    finer = routed.groupBy("id").agg(F.max(F.when(F.col("own"), F.col("home"))).alias("_home"), F.flatten(F.collect_list("asked")).alias("_asked"))
    split = F.broadcast(routers.agg(F.collect_list("part").alias("_split")))  # one row of at most MAX_PARTS numbers
    rest = F.array_except("asked", "_split")
    return cut(
        placed.crossJoin(split).join(finer, "id", "left").select("id", F.coalesce("_home", "home").alias("home"), F.concat(rest, F.coalesce("_asked", F.array().cast("array<bigint>"))).alias("asked"), "v"),
        replaces=placed,
    )


def _best(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = top(sim, k)
    return ids[at], np.take_along_axis(sim, at, 1)


def search(vectors: DataFrame, k: int, probes: int = PROBES, spent: DataFrame | None = None) -> DataFrame:
    """(id, near): for each of ``vectors`` (id, v; no two equal) its ``k`` most similar others, an array of
    (cos, neg), neg being minus their id, the best first; equal cosines by smaller id.

    With ``probes`` as great as the number of parts the result is exact. ``spent``: a table of :func:`cut` that
    nothing but ``vectors`` reads; it is deleted as soon as they are placed.
    """
    n = vectors.count()
    placed = _place(vectors, probes, n)
    if spent is not None:
        release(spent)
    sizes = cut(placed.groupBy(F.col("home").alias("part")).agg(F.count(F.lit(1)).alias("n")))
    dense = cut(sizes.filter(F.col("n") > BLOCK_ROWS))
    if not dense.isEmpty():
        placed = _place_again(placed, dense, probes)
        sizes = cut(placed.groupBy(F.col("home").alias("part")).agg(F.count(F.lit(1)).alias("n")))
    large = cut(sizes.filter(F.col("n") > BLOCK_ROWS).select("part", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
    indexed = placed.select(F.col("home").alias("part"), F.lit(0).alias("asks"), "id", "v")
    asking = placed.select(F.explode("asked").alias("part"), F.lit(1).alias("asks"), "id", "v")
    if large.isEmpty():
        rows = indexed.unionByName(asking).withColumn("block", F.lit(0))
    else:
        own = lookup(indexed, large, "part", "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int"))
        every = lookup(asking, large, "part", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        rows = own.drop("blocks").unionByName(every.drop("blocks"))
    # Few parts to a task, whatever the size of the table: with more tasks than parts few of them meet in one.
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-3 * n // PART_ROWS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held, index, known = None, [], [], None, None
        for batch in batches:
            parts, blocks, asks = (batch.column(c).to_numpy() for c in ("part", "block", "asks"))
            edges = np.flatnonzero(np.r_[True, (np.diff(parts) != 0) | (np.diff(blocks) != 0) | (np.diff(asks) != 0), True])
            for s, e in zip(edges, edges[1:]):
                if (parts[s], blocks[s]) != at:
                    at, ids, held, index = (parts[s], blocks[s]), [], [], None
                run = batch.slice(s, e - s)
                own = run.column("id").to_numpy()
                if not asks[s]:
                    ids.append(own)
                    held.append(_matrix(run.column("v")))
                    continue
                if held:
                    index, known, ids, held = np.concatenate(held), np.concatenate(ids), [], []
                if index is None:
                    continue
                for q in range(0, len(own), QUERY_ROWS):
                    mine = own[q : q + QUERY_ROWS]
                    near, sims = _best(_matrix(run.column("v").slice(q, len(mine))) @ index.T, known, k + 1)
                    keep = near != mine[:, None]
                    offsets = np.r_[0, np.cumsum(keep.sum(1))].astype(np.int32)
                    pairs = pa.StructArray.from_arrays([pa.array(sims[keep].astype(np.float32)), pa.array(-near[keep])], ["cos", "neg"])
                    yield pa.RecordBatch.from_arrays([pa.array(mine), pa.ListArray.from_arrays(pa.array(offsets), pairs)], ["id", "near"])

    found = rows.repartition(tasks, "part", "block").sortWithinPartitions("part", "block", "asks").mapInArrow(scan, "id long, near array<struct<cos:float,neg:long>>")
    return found.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near")), asc=False), 1, k).alias("near"))


def nearest(rows: DataFrame, k: int = 10, key: str = "chunk_id", vector: str = "vector", order: str = "embedded_at", width: int = 384, probes: int = PROBES) -> DataFrame:
    """(id, neighbour, cosine): for each key the ``k`` others whose vectors are most similar, but for those
    that no asked part holds (recall is measured in the tests). Fewer vectors than k give fewer rows; equal
    cosines are ordered by id, so of more than k copies the smallest ids are named."""
    vectors, kept = unit_vectors(rows, key, vector, order, width)
    copies = _copies(vectors)
    doubles = copies.filter("id <> rep").select("id")
    n = doubles.count()
    if not n:
        found = search(vectors, k, probes, kept)
        return found.select("id", F.explode("near").alias("m")).select("id", (-F.col("m.neg")).alias("neighbour"), F.col("m.cos").alias("cosine"))
    side = F.broadcast(doubles) if n <= BROADCAST_ROWS else doubles
    found = cut(search(vectors.join(side, "id", "left_anti"), k, probes, kept).withColumnRenamed("id", "rep"))
    # Members of each class of copies: the k + 1 smallest suffice to answer anyone.
    ranked = copies.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).filter(F.col("r") <= k + 1)
    firsts = cut(ranked.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("members")))
    own = found.join(firsts.select("rep", F.lit(True).alias("several")), "rep", "left")
    near = F.when(F.col("several"), F.concat(F.array(F.struct(F.lit(1.0).cast("float").alias("cos"), (-F.col("rep")).alias("neg"))), "near")).otherwise(F.col("near"))
    lists = own.select("rep", near.alias("near"))
    single = lists.join(firsts, "rep", "left_anti").select(F.col("rep").alias("id"), "near")
    shared = lookup(copies, lists, "rep").select("id", "near")
    pairs = single.unionByName(shared).select("id", F.explode("near").alias("m")).select("id", (-F.col("m.neg")).alias("rep"), F.col("m.cos").alias("cosine"))
    wide = lookup(pairs, firsts, "rep", "left").select("id", "cosine", F.explode(F.coalesce("members", F.array("rep"))).alias("neighbour")).filter("id <> neighbour")
    best = F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return wide.withColumn("r", best).filter(F.col("r") <= k).select("id", "neighbour", "cosine")


def similar_pairs(rows: DataFrame, least: float = 0.85, k: int = 10, key: str = "chunk_id", vector: str = "vector", order: str = "embedded_at", width: int = 384) -> DataFrame:
    """(a, b), a < b: pairs of keys with a cosine of at least ``least``, one among the ``k`` nearest of the other.

    Pairs whose half-float cosine is within HALF_ERROR of the bound are decided by their floats.
    """
    near = cut(
        nearest(rows, k, key, vector, order, width)
        .filter(F.col("cosine") >= least - HALF_ERROR)
        .groupBy(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"))
        .agg(F.max("cosine").alias("cosine"))
    )
    sure, close = near.filter(F.col("cosine") >= least + HALF_ERROR), near.filter(F.col("cosine") < least + HALF_ERROR)
    ids = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    n = ids.count()
    if not n:
        return sure.select("a", "b")
    side = F.broadcast(ids) if n <= BROADCAST_ROWS else ids
    floats = cut(valid_vectors(rows.join(side.withColumnRenamed("id", key), key, "left_semi"), key, vector, order, width))
    x, y = (floats.select(F.col("id").alias(c), F.transform("vector", lambda v: v.cast("double")).alias(f"v{c}")) for c in "ab")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    exact = close.join(x, "a").join(y, "b").filter(dot("va", "vb") >= least * F.sqrt(dot("va", "va") * dot("vb", "vb")))
    return sure.select("a", "b").unionByName(exact.select("a", "b"))
