"""Approximate nearest neighbours by inner product, on robust-pruned directed graphs.

Distinct vectors are dealt to shards of bounded size. A shard is one graph: points are
added in growing batches; a greedy beam search over the graph so far proposes neighbours
for each, and relaxed distance pruning keeps those that no nearer kept one makes
redundant. Queries go in blocks to every shard, where a beam search over the graph finds
candidates; these are scored in double precision, and the best of all shards are kept.
A task loads a shard once and lets its blocks stream past.

How wide a beam must be depends on the vectors: unstructured ones need a wider one than
clusters. So a bounded sample of the queries is first answered exactly, and the beam is
doubled until the graphs find enough of those answers. A beam as wide as a shard is an
exact scan, which ends the doubling at the latest.

Inner products become distances by one more component per vector, which brings all of a
shard's vectors to the same length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from edgelytics.llm.common import stored

SHARD_ROWS = 8192
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 160
RELAX = 1.2
SAMPLE_QUERIES = 64  # answered exactly to choose the beam
RECALL = 0.95  # of the sample's answers
_COPY_BLOCKS = 32  # blocks of queries that one copy of a shard answers
_BLOCK = 256  # searches that run side by side in a task


# Graph


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors whose order by distance to a query (with 0 as its last component) is
    the order by inner product."""
    wide = vectors.astype(np.float64)
    wide /= max(np.abs(wide).max(initial=0.0), 1e-300)
    squares = (wide * wide).sum(1)
    most = squares.max(initial=1e-300)
    rest = np.sqrt(np.maximum(0.0, 1.0 - squares / most))
    return np.column_stack([wide / np.sqrt(most), rest]).astype(np.float32)


class Graph:
    """Points with at most `degree` outgoing edges each, and where searches enter."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, entries: np.ndarray):
        self.points, self.edges, self.entries = points, edges, entries

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest points met from the entries on, nearest first, and their distances.

        All queries advance together: each opens its nearest unopened point, whose edges
        join the beam. -1 and infinity fill beams that are not full.
        """
        n, count = len(self.points), len(queries)
        ids = np.full((count, beam), -1, np.int64)
        far = np.full((count, beam), np.inf, np.float32)
        opened = np.ones((count, beam), bool)
        seen = np.zeros((count, n + 1), bool)
        seen[:, n] = True  # where missing edges lead
        fresh = np.broadcast_to(self.entries, (count, len(self.entries)))
        rows = np.arange(count)
        active = rows
        while len(active):
            new = ~seen[active[:, None], fresh]
            # an edge list may name a point twice only through entries; those are distinct
            seen[active[:, None], fresh] = True
            safe = np.minimum(fresh, n - 1)
            gap = self.points[safe] - queries[active][:, None, :]
            distance = np.where(new, np.einsum("qrd,qrd->qr", gap, gap), np.inf)
            all_far = np.concatenate([far[active], distance], axis=1)
            all_ids = np.concatenate([ids[active], np.where(new, fresh, -1)], axis=1)
            all_opened = np.concatenate([opened[active], ~new], axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[active] = np.take_along_axis(all_far, best, 1)
            ids[active] = np.take_along_axis(all_ids, best, 1)
            opened[active] = np.take_along_axis(all_opened, best, 1)
            left = ~opened[active]
            more = left.any(axis=1)
            active = active[more]
            at = left[more].argmax(axis=1)
            opened[active, at] = True
            fresh = self.edges[ids[active, at]]
        return ids, far


def prune(points: np.ndarray, near: np.ndarray, ids: np.ndarray, distance: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each row the candidates to keep: the nearest, then again the nearest of those
    that are not `relax` times nearer to one kept than to the row's own point.

    `ids` (rows x candidates, -1 for none) lie at squared `distance` from the rows' points.
    """
    n = len(points)
    out = np.full((len(near), degree), n, np.int64)
    for begin in range(0, len(near), 128):
        part = slice(begin, begin + 128)
        own, gap = ids[part], np.where(ids[part] >= 0, distance[part], np.inf)
        vectors = points[np.maximum(own, 0)]
        between = 2.0 - 2.0 * np.matmul(vectors, vectors.transpose(0, 2, 1))  # points are unit vectors
        rows = np.arange(len(own))
        for place in range(degree):
            pick = gap.argmin(axis=1)
            found = np.isfinite(gap[rows, pick])
            if not found.any():
                break
            out[part][found, place] = own[rows, pick][found]
            covered = relax * relax * between[rows, pick] <= gap
            covered[rows, pick] = True
            gap[covered & found[:, None]] = np.inf
    return out


def _without_repeats(ids: np.ndarray, distance: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates sorted by distance with repeats and the row's own point taken out."""
    order = np.argsort(ids, axis=1, kind="stable")
    ranked = np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, bool)
    np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
    drop = again | (ids == own[:, None]) | (ids < 0)
    return np.where(drop, -1, ids), np.where(drop, np.inf, distance)


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 1) -> Graph:
    n = len(points)
    edges = np.full((n, degree), n, np.int64)
    middle = points.mean(axis=0)
    start = int(((points - middle) ** 2).sum(1).argmin())
    graph = Graph(points, edges, np.array([start]))
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        batch = order[at : at + size]
        for begin in range(0, len(batch), _BLOCK):
            own = batch[begin : begin + _BLOCK]
            found, gap = graph.search(points[own], beam)
            current = edges[own]
            ids = np.concatenate([found, np.where(current < n, current, -1)], axis=1)
            apart = points[np.minimum(current, n - 1)] - points[own][:, None, :]
            gap = np.concatenate([gap, np.einsum("qrd,qrd->qr", apart, apart)], axis=1)
            ids, gap = _without_repeats(ids, gap, own)
            edges[own] = prune(points, own, ids, gap, degree, relax)
        _add_reverse(points, edges, batch, degree, relax)
        at += len(batch)
        size = min(2 * size, 1024)
    graph.entries = _entries(edges, start)
    return graph


def _add_reverse(points: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int, relax: float) -> None:
    """Edges back from each new neighbour; a list that would grow too long is pruned."""
    n = len(points)
    source = np.repeat(batch, degree)
    target = edges[batch].ravel()
    source, target = source[target < n], target[target < n]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.empty(0, np.int64)
    counts = np.diff(np.r_[first, len(target)])
    while len(first):  # a target with many new edges takes them `degree` at a time
        now = np.minimum(counts, degree)
        own = target[first]
        offered = np.full((len(own), degree), -1, np.int64)
        rank = np.arange(int(now.sum())) - np.repeat(np.cumsum(now) - now, now)
        offered[np.repeat(np.arange(len(own)), now), rank] = source[np.repeat(first, now) + rank]
        present = np.where(edges[own] < n, edges[own], -1)
        ids = np.concatenate([present, offered], axis=1)
        apart = points[np.maximum(ids, 0)] - points[own][:, None, :]
        ids, gap = _without_repeats(ids, np.einsum("qrd,qrd->qr", apart, apart), own)
        room = (ids >= 0).sum(1) <= degree
        packed = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), 1)[:, :degree]
        edges[own[room]] = np.where(packed[room] >= 0, packed[room], n)
        if (~room).any():
            edges[own[~room]] = prune(points, own[~room], ids[~room], gap[~room], degree, relax)
        keep = counts > degree
        first, counts = (first + now)[keep], (counts - now)[keep]


def _entries(edges: np.ndarray, start: int) -> np.ndarray:
    """Where to enter so that every point can be reached: the start, and a point of each part it misses."""
    n = len(edges)
    reached = np.zeros(n + 1, bool)
    reached[n] = True
    entries, front = [start], np.array([start])
    while True:
        reached[front] = True
        while len(front):
            front = np.unique(edges[front])
            front = front[~reached[front]]
            reached[front] = True
        missing = np.flatnonzero(~reached)
        if not len(missing):
            return np.array(entries)
        entries.append(int(missing[0]))
        front = missing[:1]


# Tables


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame, top: int) -> DataFrame:
    """(vector, ids): each vector once with its least top + 1 distinct ids, ascending, each
    as often as it occurs, up to `top` times.

    More cannot appear in a result of `top` rows without the query's own id, which is one of
    them. Repeated rows are counted and the limit is applied before the shuffle by vector,
    so a vector of a third of all rows sends few.
    """
    counted = vectors.groupBy("vector", "id").agg(F.least(F.count(F.lit(1)), F.lit(top)).cast("int").alias("_n"))
    rank = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    least = counted.withColumn("_rank", rank).filter(F.col("_rank") <= top + 1)
    return least.groupBy("vector").agg(F.sort_array(F.flatten(F.collect_list(F.expr("array_repeat(id, _n)")))).alias("ids"))


_INDEX = "dim int, shard int, vectors binary, edges binary, entries binary, ids binary, owners binary"


def build_index(distinct: DataFrame, shard_rows: int, degree: int, beam: int, relax: float) -> DataFrame:
    """One row per dimension and shard: its vectors, graph and the ids behind each vector."""
    shards = max(1, -(-distinct.count() // shard_rows))
    dealt = distinct.select(
        F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), "vector", "ids"
    )

    def run(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        vectors = _matrix(group["vector"], dim)
        graph = build_graph(lifted(vectors), degree, beam, relax)
        ids = group["ids"].combine_chunks()
        owners = np.repeat(np.arange(len(vectors), dtype="<i4"), np.diff(ids.offsets.to_numpy()))
        return pa.table(
            {
                "dim": group["dim"].slice(0, 1),
                "shard": group["shard"].slice(0, 1),
                "vectors": pa.array([vectors.astype("<f8").tobytes()], pa.binary()),
                "edges": pa.array([graph.edges.astype("<i4").tobytes()], pa.binary()),
                "entries": pa.array([graph.entries.astype("<i4").tobytes()], pa.binary()),
                "ids": pa.array([ids.flatten().to_numpy().astype("<i8").tobytes()], pa.binary()),
                "owners": pa.array([owners.tobytes()], pa.binary()),
            }
        )

    # a partition per shard: building is heavy, whatever the size in bytes
    return dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(run, _INDEX)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """(dim, block, queries, asked): queries packed into so many blocks of each dimension."""
    dealt = queries.select(
        F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vector"
    )

    def run(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        return pa.table(
            {
                "dim": group["dim"].slice(0, 1),
                "block": group["block"].slice(0, 1),
                "queries": pa.array([group["id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                "asked": pa.array([_matrix(group["vector"], dim).astype("<f8").tobytes()], pa.binary()),
            }
        )

    return dealt.groupBy("dim", "block").applyInArrow(run, "dim int, block int, queries binary, asked binary")


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(vectors))
    for k in range(vectors.shape[1]):
        total += vectors[:, k] * query[k]
    return total


class Shard:
    """A row of the index, ready to be searched."""

    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, self.dim)
        edges = np.frombuffer(row["edges"], "<i4").reshape(len(self.vectors), -1).astype(np.int64)
        self.graph = Graph(lifted(self.vectors), edges, np.frombuffer(row["entries"], "<i4").astype(np.int64))
        self.ids = np.frombuffer(row["ids"], "<i8")
        owners = np.frombuffer(row["owners"], "<i4")
        self.begin = np.searchsorted(owners, np.arange(len(self.vectors) + 1))

    def best(self, queries: np.ndarray, asked: np.ndarray, beam: int, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, scores): the best found for each query; a beam as wide as the shard finds all."""
        exact = beam >= len(self.vectors)
        largest = np.abs(asked).max(axis=1, keepdims=True)
        unit = asked / largest
        unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
        unit = np.column_stack([unit, np.zeros(len(unit))]).astype(np.float32)
        for at in range(0, len(queries), _BLOCK):
            part = range(at, min(at + _BLOCK, len(queries)))
            found = None if exact else self.graph.search(unit[part.start : part.stop], beam)[0]
            for place in part:
                if exact:
                    value = scores(self.vectors, asked[place])
                    # one point may hold no id but the query's own
                    bar = np.partition(value, -top - 1)[-top - 1] if len(value) > top + 1 else -np.inf
                    own = np.flatnonzero(value >= bar)
                    value = value[own]
                else:
                    own = found[place - at]
                    own = own[own >= 0]
                    value = scores(self.vectors[own], asked[place])
                copies = self.begin[own + 1] - self.begin[own]
                before = np.cumsum(copies) - copies
                members = np.repeat(self.begin[own] - before, copies) + np.arange(int(copies.sum()))
                named, value = self.ids[members], np.repeat(value, copies)
                other = named != queries[place]
                named, value = named[other], value[other]
                order = np.lexsort((named, -value))[:top]
                yield int(queries[place]), named[order], value[order]


def search_shards(index: DataFrame, asked: DataFrame, beam: int, top: int, block_rows: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the best `top` that beams of this width find in all shards.

    A shard's row comes first in its partition and the blocks of queries after it, so it is
    shipped and prepared once for `_COPY_BLOCKS` blocks. More blocks get further copies.
    """
    blocks = max(1, -(-asked.count() // block_rows))
    copies = -(-blocks // _COPY_BLOCKS)
    packed = query_blocks(asked, blocks)
    names = ["dim", "shard", "copy", "block", "vectors", "edges", "entries", "ids", "owners", "queries", "asked"]
    shards = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("block", F.lit(-1))
    spread = packed.withColumn("copy", F.col("block") % copies).join(index.select("dim", "shard"), "dim")
    lined = shards.unionByName(spread, allowMissingColumns=True).select(*names)
    lined = lined.repartition(max(1, copies * index.count()), "dim", "shard", "copy")
    lined = lined.sortWithinPartitions("dim", "shard", "copy", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["block"] < 0:
                    shard = Shard(row)
                    continue
                queries = np.frombuffer(row["queries"], "<i8")
                out = list(shard.best(queries, np.frombuffer(row["asked"], "<f8").reshape(-1, shard.dim), beam, top))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([o[0] for o in out], pa.int64()),
                        pa.array([o[1] for o in out], pa.list_(pa.int64())),
                        pa.array([o[2] for o in out], pa.list_(pa.float64())),
                    ],
                    ["query_id", "ids", "scores"],
                )

    parts = lined.mapInArrow(run, "query_id long, ids array<long>, scores array<double>")
    each = parts.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("r"))
    each = each.select("query_id", F.col("r.ids").alias("vec_id"), F.col("r.scores").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def exact_bars(distinct: DataFrame, sample: list[tuple[int, list[float]]], top: int) -> DataFrame:
    """(query_id, bar, n): for each query of a small sample the least score of its exact
    answer and the answer's length, by one pass over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, ids = batch.column(0), batch.column(1)
            sizes, lists = np.diff(vectors.offsets.to_numpy()), ids.to_pylist()
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                wide = _matrix(vectors.take(pa.array(rows)), dim)
                for query, asked in sample:
                    if len(asked) != dim:
                        continue
                    value = scores(wide, np.array(asked))
                    order = np.argsort(-value, kind="stable")[: top + 1]
                    own = [float(value[k]) for k in order for i in lists[rows[k]] if i != query][:top]
                    yield pa.RecordBatch.from_arrays([pa.array([query] * len(own), pa.int64()), pa.array(own, pa.float64())], ["query_id", "score"])

    found = distinct.select("vector", "ids").mapInArrow(run, "query_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc())
    ranked = found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= top)
    return ranked.groupBy("query_id").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("n"))


def choose_beam(index: DataFrame, distinct: DataFrame, asked: DataFrame, beam: int, widest: int, top: int, block_rows: int, sample_queries: int, recall: float) -> int:
    """The least of beam, 2 * beam, 4 * beam and so on that finds `recall` of the exact answers to the
    `sample_queries` queries first by a hash of their ids; `widest` if none below it does."""
    chosen = asked.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(sample_queries)
    sample = stored(chosen, "sample-queries")
    rows = [(r["id"], r["vector"]) for r in sample.collect()]
    bars = {r["query_id"]: (r["bar"], r["n"]) for r in exact_bars(distinct, rows, top).collect()}
    wanted = sum(n for _, n in bars.values())
    while beam < widest:
        # a query id that repeats with several vectors has one bar, the least of the best
        found = search_shards(index, sample, beam, top, block_rows).select("query_id", "score").collect()
        if sum(r["score"] >= bars[r["query_id"]][0] for r in found) >= recall * wanted:
            return beam
        beam *= 2
    return widest


def nearest(
    vectors: DataFrame,
    queries: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    top: int = 20,
    shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE,
    build_beam: int = BUILD_BEAM,
    search_beam: int = SEARCH_BEAM,
    relax: float = RELAX,
    block_rows: int = 1024,
    sample_queries: int = SAMPLE_QUERIES,
    recall: float = RECALL,
) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` rows found with the largest inner product.

    `queries` is a condition on `vectors`; every row is indexed, and all but the query's
    own id are candidates. Ranks run from 1, ties go to the smaller id; a query with fewer
    candidates gets them all. Rows with a null id, a null, empty or zero vector, or a null
    or non-finite component take no part. Vectors of several lengths meet only their like.
    A repeated row is one query, and its copies have the same id, so they are not its own
    neighbours; other queries may get each copy. Other columns are not read.

    Beams begin at `search_beam` and are widened until `recall` of the exact answers to
    `sample_queries` queries is found, by an exact scan of each shard if nothing less does.
    Index and search cover every row; only the choice of the beam rests on the sample.
    """
    clean = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("_asked"))
    clean = clean.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    distinct = stored(distinct_vectors(clean.select("id", "vector"), top), "distinct-vectors")
    index = stored(build_index(distinct, shard_rows, degree, build_beam, relax), "graphs")
    asked = stored(clean.filter("_asked").select("id", "vector").dropDuplicates(), "queries")
    beam = choose_beam(index, distinct, asked, search_beam, shard_rows, top, block_rows, sample_queries, recall)
    if beam == shard_rows:
        beam = 1 << 31  # shards are of about that many rows: wider than any
    return search_shards(index, asked, beam, top, block_rows)
