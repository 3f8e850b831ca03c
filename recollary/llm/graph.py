"""Most similar vectors for every vector, by robust-pruned directed graphs on overlapping shards.

A coarse quantiser is fitted to a bounded sample; every vector belongs to the shards of its few nearest
cells, so two vectors meet wherever they share one of them. Each shard gets a directed graph: the first
points are compared with one another, the others are inserted in doubling batches; a greedy search proposes
each point's neighbours, relaxed distance pruning keeps the diverse ones, back edges are pruned the same way. A beam search from every point's own place in
the graph then finds its neighbours in the shard; the best over all shards remain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollary.session import cut

DEGREE, BEAM, EXPAND, ALPHA = 16, 24, 4, 1.2
# vectors a cell on average; cells at most; vectors that one task holds; sampled vectors a cell; cells fitted at once
CELL, MAX_CELLS, MAX_SHARD, PER_CELL, TOP_CELLS = 256, 65_536, 16_384, 24, 2048
BLOCK, PAIRS = 1024, 4096
# points with which a graph begins
FIRST = 512
# the key of no point, and the bits of a key below its distance
NONE, LOW = np.int64(2**63 - 1), np.int64(0xFFFFFFFF)


def blocks(n: int, size: int = BLOCK) -> Iterator[slice]:
    return (slice(i, min(n, i + size)) for i in range(0, n, size))


def distances(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """1 - dot product of vector ids[i] and query rows[i], in parts that stay in the processor's cache."""
    out = np.empty(len(ids), dtype=np.float32)
    for part in blocks(len(ids), PAIRS):
        np.einsum("ij,ij->i", vectors.take(ids[part], axis=0), queries.take(rows[part], axis=0), out=out[part])
    return 1 - out


def packed(far: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys that order as the distances do: the distance, the id and a free lowest bit in one integer."""
    keys = np.maximum(far, 0).astype(np.float32).view(np.int32).astype(np.int64)
    keys <<= 32
    keys |= ids.astype(np.int64) << 1
    return keys


def unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1 where there is none) and distances of keys."""
    used = keys < NONE
    return np.where(used, (keys & LOW) >> 1, -1), np.where(used, (keys >> 32).astype(np.int32).view(np.float32), np.float32(np.inf))


def nearest_keys(vectors: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int = BEAM, expand: int = EXPAND) -> np.ndarray:
    """The beam in which each query's greedy search ends, as keys in order, NONE where a place is unused.

    starts holds the points at which each query begins (one row a query, or one for all). edges holds -1
    where a point has fewer neighbours. In every round the best few points of each beam that have not been
    expanded (lowest bit 0) are, all queries in step; a query and a point are compared once.
    """
    n, b = len(vectors), len(queries)
    width = n + 1  # the last place is where -1 points
    links = np.full((width, edges.shape[1]), n, dtype=np.int64)
    links[:n] = np.where(edges < 0, n, edges)
    seen = np.zeros(b * width, dtype=bool)
    seen[n::width] = True
    last_met = np.empty(b * width, dtype=np.int32)
    keys = np.full((b, beam), NONE)
    worst = np.full(b, NONE)
    live = np.arange(b)
    met = (live[:, None] * width + starts).ravel()  # query * width + point
    while True:
        if len(met):
            count = np.arange(len(met), dtype=np.int32)
            last_met[met] = count
            met = met[last_met[met] == count]
            seen[met] = True
            row = met // width
            point = met - row * width
            key = packed(distances(vectors, point, queries, row), point)
            better = np.flatnonzero(key < worst[row])
            if len(better):
                row, key = row[better], key[better]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                held = np.diff(first, append=len(row))
                some = row[first]
                wide = np.full((len(some), beam + int(held.max())), NONE)
                wide[:, :beam] = keys[some]
                wide[np.repeat(np.arange(len(some)), held), beam + np.arange(len(row)) - np.repeat(first, held)] = key
                wide.partition(beam - 1, axis=1)
                keys[some], worst[some] = wide[:, :beam], wide[:, beam - 1]
        mine = keys[live]
        near = np.where(mine & 1, NONE, mine)
        if beam > expand:
            near.partition(expand - 1, axis=1)
            near = near[:, :expand]
        some = np.flatnonzero(near.min(axis=1) < NONE)
        if not len(some):
            break
        live, mine, near = live[some], mine[some], near[some]
        fresh = near < NONE
        keys[live] = mine | (mine <= np.where(fresh, near, 0).max(axis=1)[:, None])
        met = (links.take((near[fresh] & LOW) >> 1, axis=0) + (live[np.nonzero(fresh)[0]] * width)[:, None]).ravel()
        met = met[~seen.take(met)]
    keys.sort(axis=1)
    return keys


def beam_search(vectors: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int = BEAM, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities, best first, of the beam in which each query's greedy search ends. Unused places have id -1."""
    ids, far = unpacked(nearest_keys(vectors, edges, starts, queries, beam, expand))
    return ids, np.where(ids >= 0, 1 - far, np.float32(-2))


def diverse(vectors: np.ndarray, keys: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """The diverse neighbours among each row of keys in order: the nearest is kept, and whatever is alpha
    times nearer to a kept one than to the point is dropped, until degree are kept."""
    pool, far = unpacked(keys)
    candidates = vectors.take(np.maximum(pool, 0), axis=0)
    # squared distances of unit vectors: alpha applies to distances
    drops = (1 - np.matmul(candidates, candidates.transpose(0, 2, 1))) * (alpha * alpha) <= far[:, None, :]
    # all points in step: candidate, candidate, point
    drops = np.ascontiguousarray(drops.transpose(1, 2, 0))
    alive = np.ascontiguousarray((pool >= 0).T)
    for j in range(len(alive) - 1):
        alive[j + 1 :] &= ~(alive[j] & drops[j, j + 1 :])
    place = np.cumsum(alive.T, axis=1) - 1
    row, column = np.nonzero(alive.T & (place < degree))
    kept = np.full((len(keys), degree), NONE)
    kept[row, place[row, column]] = keys[row, column]
    return kept


def robust_prune(vectors: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Ids of the diverse neighbours of each point among its pool (ids, -1 where unused)."""
    row, column = np.nonzero((pool >= 0) & (pool != points[:, None]))
    keys = np.full(pool.shape, NONE)
    keys[row, column] = packed(distances(vectors, pool[row, column], vectors, points[row]), pool[row, column])
    keys.sort(axis=1)
    return unpacked(diverse(vectors, keys, degree, alpha))[0]


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 5) -> np.ndarray:
    """Edges [n, degree] of the graph."""
    n = len(vectors)
    order = np.random.default_rng(seed).permutation(n)
    links = np.full((n, degree), NONE)  # keys, lowest bit 1
    entries = order[: min(n, 16)]
    at = 0
    while at < n:
        if at == 0:  # the first points, few, are compared with one another
            batch = order[:FIRST]
            keys = packed(1 - vectors[batch] @ vectors[batch].T, np.broadcast_to(batch, (len(batch), len(batch))))
            np.fill_diagonal(keys, NONE)
            if len(batch) > beam:
                keys = np.partition(keys, beam - 1, axis=1)[:, :beam]
            keys.sort(axis=1)
            pools = [keys[part] | 1 for part in blocks(len(batch))]
        else:
            batch = order[at : min(n, 2 * at)]
            edges = unpacked(links)[0]
            # searched before any of the batch is linked; in blocks, so that their pools stay small in memory
            pools = [nearest_keys(vectors, edges, entries, vectors[batch[part]], beam) | 1 for part in blocks(len(batch))]
        for part, pool in zip(blocks(len(batch)), pools):
            links[batch[part]] = diverse(vectors, pool, degree, alpha)
        # back edges: every kept neighbour gets the point as a candidate beside the neighbours it has
        row, column = np.nonzero(links[batch] < NONE)
        key = links[batch[row], column]
        target, back = (key & LOW) >> 1, (key & ~LOW) | batch[row] << 1 | 1
        by = np.lexsort((back, target))
        target, back = target[by], back[by]
        heads, firsts, counts = np.unique(target, return_index=True, return_counts=True)
        # those of like numbers of new edges together; of a point much linked to the nearest are candidates
        rank = np.argsort(counts, kind="stable")
        for part in blocks(len(rank)):
            some = rank[part]
            held = np.minimum(counts[some], 2 * degree)
            which = np.repeat(np.arange(len(some)), held)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(held) - held, held)
            wide = np.full((len(some), degree + int(held.max())), NONE)
            wide[:, :degree] = links[heads[some]]
            wide[which, degree + nth] = back[firsts[some][which] + nth]
            wide.sort(axis=1)
            links[heads[some]] = diverse(vectors, wide, degree, alpha)
        at += len(batch)
    return unpacked(links)[0]


def neighbours(vectors: np.ndarray, k: int, degree: int = DEGREE, beam: int = BEAM, least: float = -2.0) -> tuple[np.ndarray, np.ndarray]:
    """(of, found): places of every vector and of its k nearest others by graph, at least as similar as least."""
    edges = build(vectors, degree, beam)
    of, found = [], []
    for part in blocks(len(vectors)):
        own = np.arange(part.start, part.stop)
        ids, sims = beam_search(vectors, edges, own[:, None], vectors[part], max(beam, k + 1))
        good = (ids >= 0) & (ids != own[:, None]) & (sims >= least)
        good &= np.cumsum(good, axis=1) <= k
        row, column = np.nonzero(good)
        of.append(own[row])
        found.append(ids[row, column])
    return np.concatenate(of), np.concatenate(found)


def fit_cells(sample: np.ndarray, n_cells: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """Unit centroids of spherical k-means over the sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:n_cells]].copy()
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        centres[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return centres


def nearest_cells(x: np.ndarray, centres: np.ndarray, number: int) -> np.ndarray:
    """The cells [len(x), number] of the nearest centres: a maximum at a time, cheaper than a partition for a few."""
    near = np.empty((len(x), number), dtype=np.int32)
    for part in blocks(len(x)):
        sims = x[part] @ centres.T
        for p in range(number):
            near[part, p] = sims.argmax(axis=1)
            sims[np.arange(len(sims)), near[part, p]] = -np.inf
    return near


def flat(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """A list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)), pa.array(matrix.ravel()))


def unit_vectors(items: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """id, print (hash of the vector), unit (normalised) of the rows with size finite numbers, not all zero."""
    rows = items.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v")).where((F.size("v") == size) & F.col("id").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = flat(batch["v"], size).astype(np.float64)
            norm = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            unit = (x[good] / norm[good, None]).astype(np.float32)
            prints = pa.array([hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in unit], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"].filter(pa.array(good)), prints, lists(unit)], ["id", "print", "unit"])

    return rows.mapInArrow(run, f"id {kind}, print binary, unit array<float>")


def fit_quantiser(distinct: DataFrame, number: int, n_cells: int, size: int, top_cells: int = TOP_CELLS) -> np.ndarray:
    """Centres of about n_cells cells, fitted to a sample of 24 vectors a cell.

    Up to top_cells the driver fits them (at most 98,304 sampled vectors, 25 MB). More are fitted in two
    levels: the driver fits the square root of the number, the sample is divided among these and each part
    gets its cells in a task; only centres come back (16 MB for 65,536 cells).
    """
    first = n_cells if n_cells <= top_cells else int(np.ceil(np.sqrt(n_cells)))

    def sampled(cells: int) -> DataFrame:
        return distinct.where(F.pmod(F.xxhash64("print"), F.lit(1_000_000)) < F.lit(int(1.2e6 * cells * PER_CELL / max(1, number)) + 1)).select("unit")

    picked = sampled(first).limit(2 * first * PER_CELL).toArrow()
    sample = flat(picked["unit"], size) if picked.num_rows else np.zeros((1, size), dtype=np.float32)
    centres = fit_cells(sample, min(first, len(sample)))
    if n_cells <= top_cells:
        return centres

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (flat(batch["unit"], size) @ centres.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch["unit"]], ["top", "unit"])

    def fit(part: pa.Table) -> pa.Table:
        x = flat(part["unit"], size)
        return pa.table({"unit": lists(fit_cells(x, max(1, len(x) // PER_CELL)))})

    parts = sampled(n_cells).mapInArrow(assign, "top int, unit array<float>").groupBy("top").applyInArrow(fit, "unit array<float>")
    return flat(parts.toArrow()["unit"], size)


def most_similar(
    items: DataFrame, key: str = "chunk_id", vector: str = "embedding", size: int = 64, k: int = 5, min_similarity: float | None = None,
    shards: int = 3, degree: int = DEGREE, beam: int = BEAM, cell: int = CELL, max_cells: int = MAX_CELLS, max_shard: int = MAX_SHARD, top_cells: int = TOP_CELLS,
) -> DataFrame:
    """key, neighbour, similarity, rank (from 1): the k most similar others of every usable vector.

    Usable: size finite numbers, not all zero, key not null. Rows of equal key are taken once (any one of
    them, where they differ). Ties go to the smaller key. min_similarity leaves out what is less similar.
    Equal vectors enter the index once and share its answers; of their copies no more than k + 1 are
    ranked, which are all that can be among anyone's k. Every vector joins the shards of its nearest cells.
    A shard of more than max_shard vectors is divided at random into parts of half that, and every two parts
    meet in a task, so no task holds more and none of its vectors misses another. An empty table gives no rows.
    """
    spark = items.sparkSession
    rows = unit_vectors(items, key, vector, size)
    kind = rows.schema["id"].dataType.simpleString()
    # only ids and prints are grouped by id; the vectors are shuffled once, by print
    ids = cut(rows.groupBy("id").agg(F.min("print").alias("print")))
    ranked = ids.withColumn("place", F.row_number().over(Window.partitionBy("print").orderBy("id")))
    distinct = cut(rows.groupBy("print").agg(F.first("unit").alias("unit")).join(ids.select("print").distinct(), "print", "left_semi"))
    number = distinct.count()
    centres = fit_quantiser(distinct, number, int(np.clip(number // cell, 1, max_cells)), size, top_cells)
    shards = min(shards, len(centres))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = flat(batch["unit"], size)
            near = nearest_cells(x, centres, shards)
            for p in range(shards):
                yield pa.RecordBatch.from_arrays([pa.array(near[:, p]), batch["print"], batch["unit"]], ["cell", "print", "unit"])

    routed = distinct.mapInArrow(route, "cell int, print binary, unit array<float>")
    large = {}
    if number > max_shard:  # else no shard can be too large
        held = routed.groupBy("cell").agg(F.count("*").alias("held")).where(F.col("held") > max_shard)
        large = {r["cell"]: -(-2 * r["held"] // max_shard) for r in held.collect()}  # at most max_cells numbers
    if large:
        table = spark.createDataFrame(list(large.items()), "cell int, parts long")
        routed = routed.join(F.broadcast(table), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
        own = F.pmod(F.xxhash64("print"), F.col("parts"))
        # part p meets every other part: the pair (p, q) is one task
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: q != own)
        meetings = F.when(F.col("parts") > 1, F.transform(others, lambda q: F.least(q, own) * F.col("parts") + F.greatest(q, own))).otherwise(F.array(F.lit(0).cast("long")))
        routed = routed.select("cell", F.explode(meetings).alias("part"), "print", "unit")
    else:
        routed = routed.withColumn("part", F.lit(0).cast("long"))
    least = -2.0 if min_similarity is None else min_similarity - 1e-4

    def search(shard: pa.Table) -> pa.Table:
        names = shard["print"].combine_chunks()
        x = np.ascontiguousarray(flat(shard["unit"], size))
        of, found = neighbours(x, k, degree, beam, least)
        exact = (x[of].astype(np.float64) * x[found]).sum(axis=1)
        return pa.table({"a": names.take(pa.array(of)), "b": names.take(pa.array(found)), "similarity": exact})

    pairs = routed.groupBy("cell", "part").applyInArrow(search, "a binary, b binary, similarity double")
    # what one of two finds is known to the other
    both = pairs.select(F.explode(F.array(F.struct("a", "b", "similarity"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))).alias("p")).select("p.*")
    both = both.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    few = ranked.where(F.col("place") <= k + 1)
    # copies of the same vector come first, at similarity 1
    copies = few.select(F.col("print").alias("a"), F.col("id").alias("neighbour"), F.lit(1.0).alias("similarity"))
    several = ranked.where("place = 2").select(F.col("print").alias("a"))
    copies = copies.join(several, "a", "left_semi")
    others = both.join(few.select(F.col("print").alias("b"), F.col("id").alias("neighbour")), "b").select("a", "neighbour", "similarity")
    if min_similarity is not None:
        others = others.where(F.col("similarity") >= min_similarity)
    best = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "neighbour")
    lines = copies.unionByName(others).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    full = ranked.select("id", F.col("print").alias("a")).join(lines, "a").where(F.col("id") != F.col("neighbour"))
    mine = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour")
    return (
        full.withColumn("rank", F.row_number().over(mine))
        .where(F.col("rank") <= k)
        .select(F.col("id").cast(kind).alias(key), F.col("neighbour").cast(kind).alias("neighbour"), "similarity", "rank")
    )
