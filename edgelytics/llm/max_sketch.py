"""Ranked lexical search with hashed max-sketches.

The index holds a sketch of each document: its terms' impacts (what a term may add to a
score) hashed to coordinates, each coordinate the largest of them. The sum of a query's
coordinates is therefore never below the document's score. A search looks all queries up
in all sketches, rescores the documents with the highest bounds exactly, and goes down the
bounds until none reaches the score of the last of the best so far. Only rescored
documents are tokenised again; copies of a text are rescored once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelytics.llm.common import as_bytes, most_frequent, slices, stored, text_column

#: ASCII that is neither letter nor digit parts terms; A-Z are lower-cased.
_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_SCALE = 1_000_000_000
#: Impacts are rounded up to multiples of this, so that any has 16 bits.
_STEP = 1 << 19

COORDINATES = 4096
#: Terms whose weights travel to all tasks; others count with the weight of a single document.
FREQUENT_TERMS = 50_000
FREQUENT_BYTES = 64
#: Queries looked up together: at most so many, of so many distinct terms in all.
BLOCK_ITEMS = 256
BLOCK_TERMS = 1 << 18


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERMS).split()


def _weights(docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)


def _parts(tf: np.ndarray, norm: np.ndarray | int) -> np.ndarray:
    """What a term adds to a score, but for its weight."""
    return _SCALE * tf // (1000 * tf + 12 * norm)


def text_hash(column: Column) -> list[Column]:
    """128 bits of a text, as Spark computes them."""
    return [F.xxhash64(column).alias("h1"), F.xxhash64(F.concat(column, F.lit("\x01"))).alias("h2")]


@dataclass(frozen=True)
class Index:
    """`sketches`: (doc_id, h1, h2, sketch), one row per document with a term; `frequencies`:
    (term, df); `docs` and `length`: documents with a term, and terms in all of them."""

    sketches: DataFrame
    frequencies: DataFrame
    docs: int
    length: int


def _norm(n: int, docs: int, length: int) -> int:
    return 75 + (25 * n * docs) // length


def _place(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term, 7) % COORDINATES


def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(text_column(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{key}`").alias("doc_id"), body.alias("_text"))


def _document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df, tf) over all documents; the null term counts documents with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            df: Counter = Counter()
            total = held = 0
            for text in as_bytes(batch.column(0)):
                found = terms(text)
                df.update(set(found))
                total += len(found)
                held += bool(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*df, None], pa.binary()),
                    pa.array([*df.values(), held], pa.int64()),
                    pa.array([0] * len(df) + [total], pa.int64()),
                ],
                ["term", "df", "total"],
            )

    found = docs.select("_text").mapInArrow(run, "term binary, df long, total long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Count the terms of all documents, then sketch each document.

    The most frequent terms' weights go to every task; any other term counts as if it were
    in one document only, which is an upper bound of its weight.
    """
    read = _read(docs, key, text)
    counted = stored(_document_frequencies(read), "terms")
    totals = counted.filter("term is null").first()
    held, length = (totals["df"], totals["total"]) if totals else (0, 0)
    frequencies = counted.filter("term is not null").select("term", "df")
    short = frequencies.filter(F.length("term") <= FREQUENT_BYTES)
    listed, _ = most_frequent(short, "df", FREQUENT_TERMS)
    dfs = np.array([r["df"] for r in listed], np.int64)
    weights = dict(zip([bytes(r["term"]) for r in listed], _weights(held, dfs).tolist(), strict=True))
    largest = int(_weights(held, np.array([1]))[0])
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[bytes, tuple[int, int]] = {t: (_place(t), w) for t, w in weights.items()}
        for batch in slices(batches, "_text"):
            sketches: list[bytes | None] = []
            for text in as_bytes(batch.column(3)):
                counts = Counter(terms(text))
                if not counts:
                    sketches.append(None)
                    continue
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                known = [places.get(t) or (_place(t), largest) for t in counts]
                place, weight = np.array(known, np.int64).T
                impact = -(-(weight * _parts(tf, _norm(int(tf.sum()), held, length))) // _STEP)
                folded = np.zeros(COORDINATES, np.uint16)
                np.maximum.at(folded, place, impact.astype(np.uint16))
                used = np.flatnonzero(folded)
                sketches.append(np.stack([used.astype("<u2"), folded[used].astype("<u2")]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sketches, pa.binary())], ["doc_id", "h1", "h2", "sketch"]
            )

    hashed = read.select("doc_id", *text_hash(F.col("_text")), "_text")
    sketches = hashed.mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, sketch binary").filter("sketch is not null")
    return Index(stored(sketches, "sketches"), frequencies, held, length)


@dataclass(frozen=True)
class _Block:
    """Some queries: per term its weight and which queries hold it how often, and the same
    by coordinate of the sketches."""

    queries: int
    held: dict[bytes, tuple[int, list[tuple[int, int]]]]  # term: weight, [(query, times)]
    first: np.ndarray  # of the entries of each coordinate
    query: np.ndarray
    times: np.ndarray


def _block(found: list[Counter], index: Index) -> _Block:
    asked = sorted({t for counts in found for t in counts})
    spark = index.sketches.sparkSession
    table = spark.createDataFrame([(bytearray(t),) for t in asked], "term binary")
    # the block's terms are bounded by BLOCK_TERMS, or one query's text
    rows = index.frequencies.join(F.broadcast(table), "term").collect()
    df = {bytes(r["term"]): r["df"] for r in rows}
    known = sorted(df)
    weight = dict(zip(known, _weights(index.docs, np.array([df[t] for t in known], np.int64)).tolist(), strict=True))
    held = {t: (w, []) for t, w in weight.items()}
    entries: Counter = Counter()
    for number, counts in enumerate(found):
        for term, times in counts.items():
            if term in held:
                held[term][1].append((number, times))
                entries[_place(term), number] += times
    listed = sorted(entries.items())
    places = np.array([p for (p, _), _ in listed], np.int64)
    return _Block(
        len(found),
        held,
        np.searchsorted(places, np.arange(COORDINATES + 1)),
        np.array([q for (_, q), _ in listed], np.int64),
        np.array([n for _, n in listed], np.int64),
    )


def _bounds(sketches: list[bytes], block: _Block) -> np.ndarray:
    """(documents, queries): an upper bound of each score, exact in doubles."""
    data = [np.frombuffer(s, "<u2").reshape(2, -1) for s in sketches]
    place, value = (np.concatenate([d[k] for d in data]).astype(np.int64) for k in (0, 1))
    row = np.repeat(np.arange(len(data)), [d.shape[1] for d in data])
    n = block.first[place + 1] - block.first[place]
    entry = np.repeat(block.first[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    cell = np.repeat(row, n) * block.queries + block.query[entry]
    added = np.repeat(value, n) * block.times[entry]
    return np.bincount(cell, added, len(data) * block.queries).reshape(len(data), -1) * float(_STEP)


_CANDIDATE = "query int, h1 long, h2 long, doc_id {0}, bound double"


def _looked_up(index: Index, block: _Block, least: np.ndarray, most: int | None) -> DataFrame:
    """Texts whose bound is above 0 and at least the query's `least`: of each task all of
    them, or the `most` highest per query. Copies in a task are listed once."""
    kind = index.sketches.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[tuple[int, int], tuple]] = {}
        listed: dict[tuple[int, int, int], None] = {}
        floor, key_kind = least.copy(), None
        for whole in batches:
            key_kind = whole.schema.field(0).type
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                bounds = _bounds(batch.column(3).to_pylist(), block)
                rows, queries = np.nonzero((bounds >= floor) & (bounds > 0))
                if not len(rows):
                    continue
                values = bounds[rows, queries]
                ids, h1, h2 = (batch.column(k).take(pa.array(rows)).to_pylist() for k in range(3))
                if most is None:
                    out = [[], [], [], [], []]
                    for row in zip(queries.tolist(), h1, h2, ids, values.tolist(), strict=True):
                        if row[:3] not in listed:
                            if len(listed) < 1 << 18:  # what a task remembers; a copy listed again is dropped later
                                listed[row[:3]] = None
                            for column, v in zip(out, row, strict=True):
                                column.append(v)
                    yield _candidates(out, key_kind)
                    continue
                for q, a, b, key, value in zip(queries.tolist(), h1, h2, ids, values.tolist(), strict=True):
                    own = best.setdefault(q, {})
                    own.setdefault((a, b), (value, key))
                    if len(own) >= 4 * most:
                        own = best[q] = dict(sorted(own.items(), key=lambda e: -e[1][0])[:most])
                        floor[q] = max(floor[q], min(v for v, _ in own.values()))
        if best:
            out = [[], [], [], [], []]
            for q, own in best.items():
                for (a, b), (value, key) in sorted(own.items(), key=lambda e: -e[1][0])[:most]:
                    for column, v in zip(out, (q, a, b, key, value), strict=True):
                        column.append(v)
            yield _candidates(out, key_kind)

    found = index.sketches.select("doc_id", "h1", "h2", "sketch").mapInArrow(run, _CANDIDATE.format(kind))
    # one row per text: a copy in another task may have another key, and the same bound
    return found.groupBy("query", "h1", "h2").agg(F.max("bound").alias("bound"), F.min("doc_id").alias("doc_id"))


def _candidates(columns: list[list], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), kind, pa.float64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query", "h1", "h2", "doc_id", "bound"]
    )


def _rescored(read: DataFrame, chosen: DataFrame, block: _Block, index: Index) -> DataFrame:
    """(query, h1, h2, score): the exact scores of the chosen texts. Of copies only those
    with the chosen key are read."""
    wanted = chosen.groupBy("h1", "h2", "doc_id").agg(F.collect_list("query").alias("queries"))
    hashed = read.select("doc_id", *text_hash(F.col("_text")), "_text")
    docs, length = index.docs, index.length
    same = (hashed.h1 == wanted.h1) & (hashed.h2 == wanted.h2) & hashed.doc_id.eqNullSafe(wanted.doc_id)
    met = hashed.join(wanted, same).select(hashed.h1, hashed.h2, "_text", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            out: list[list] = [[], [], [], []]
            h1, h2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, (text, asked) in enumerate(zip(as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                counts = Counter(terms(text))
                norm = _norm(sum(counts.values()), docs, length)
                scores: Counter = Counter()
                for term in counts.keys() & block.held.keys():
                    weight, queries = block.held[term]
                    tf = counts[term]
                    impact = weight * (_SCALE * tf // (1000 * tf + 12 * norm))
                    for query, times in queries:
                        scores[query] += times * impact
                for query in asked:
                    for column, v in zip(out, (query, h1[row], h2[row], scores[query]), strict=True):
                        column.append(v)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["query", "h1", "h2", "score"]
            )

    return met.mapInArrow(run, "query int, h1 long, h2 long, score long").filter("score > 0").distinct()


def _search_block(read: DataFrame, index: Index, block: _Block, top: int, first: int) -> DataFrame:
    """(query, rank, doc_id, score) of a block's queries."""
    by_score = W.partitionBy("query").orderBy(F.desc("score"), "h1", "h2")
    by_bound = W.partitionBy("query").orderBy(F.desc("bound"), "h1", "h2")
    nothing = np.zeros(block.queries)

    def best(scored: DataFrame) -> DataFrame:
        return scored.withColumn("_place", F.row_number().over(by_score)).filter(F.col("_place") <= top)

    def threshold(scored: DataFrame) -> np.ndarray:
        """The score of each query's last place; 0 while places are free."""
        least = nothing.copy()
        for r in best(scored).filter(F.col("_place") == top).collect():  # one number per query
            least[r["query"]] = r["score"]
        return least

    start = _looked_up(index, block, nothing, first)
    start = start.withColumn("_place", F.row_number().over(by_bound)).filter(F.col("_place") <= first)
    scored = stored(_rescored(read, start.drop("_place"), block, index), "scored")
    # everything that may still belong to the best, highest bounds first, each round with
    # sixteen times as many as the one before
    left = stored(_looked_up(index, block, threshold(scored), None), "candidates")
    left = stored(left.withColumn("_place", F.row_number().over(by_bound)), "ordered")
    spark, done, until = read.sparkSession, 0, 16 * first
    while True:
        limits = spark.createDataFrame([(q, float(v)) for q, v in enumerate(threshold(scored))], "query int, least double")
        reach = left.filter(F.col("_place") > done).join(F.broadcast(limits), "query").filter("bound >= least")
        chosen = reach.filter(F.col("_place") <= until).select("query", "h1", "h2", "doc_id")
        if reach.isEmpty():
            break
        more = _rescored(read, chosen, block, index)
        scored = stored(scored.union(more).distinct(), "scored")
        done, until = until, 16 * until
    # ties at the last place stay; copies of a text take a place each, by doc_id
    ranked = scored.withColumn("_rank", F.rank().over(W.partitionBy("query").orderBy(F.desc("score"))))
    texts = ranked.filter(F.col("_rank") <= top).drop("_rank")
    copies = index.sketches.select("h1", "h2", "doc_id").join(texts, ["h1", "h2"])
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = copies.withColumn("rank", F.row_number().over(order))
    return placed.filter(F.col("rank") <= top).select("query", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", first: int = 64) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `top` best documents with a score above 0.

    Equal scores rank by ascending doc_id, a null one last. Every row of `items` is a
    query of its own, also where ids or texts repeat; every row of `docs` is a document, so
    repeated rows take a place each. Null and empty texts have no terms: such items get no
    rows, such documents no place. Empty tables give no rows. Items are read in blocks.
    `first` is how many documents per query are rescored before the first threshold; it
    does not change the result.
    """
    index = build_index(docs, key, text)
    read = _read(docs, key, text)
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType.simpleString()
    schema = f"query int, item_id {kind}"
    results = []

    def flush(ids: list, found: list[Counter]) -> None:
        if not found or not index.length:
            return
        numbered = spark.createDataFrame(list(enumerate(ids)), schema)
        ranked = _search_block(read, index, _block(found, index), top, first)
        results.append(stored(ranked.join(F.broadcast(numbered), "query").select("item_id", "rank", "doc_id", "score"), "ranked"))

    ids: list = []
    found: list[Counter] = []
    size = 0
    asked = items.select(F.col(f"`{item_key}`").alias("item_id"), text_column(f"`{item_text}`").alias("_text"))
    for row in asked.toLocalIterator():  # one partition at a time, a block kept
        counts = Counter(terms((row["_text"] or "").encode()))
        if not counts:
            continue
        if len(found) == BLOCK_ITEMS or (found and size + len(counts) > BLOCK_TERMS):
            flush(ids, found)
            ids, found, size = [], [], 0
        ids.append(row["item_id"])
        found.append(counts)
        size += len(counts)
    flush(ids, found)
    empty = f"item_id {kind}, rank int, doc_id {docs.schema[key].dataType.simpleString()}, score long"
    out = spark.createDataFrame([], empty)
    for part in results:
        out = out.union(part)
    return out.withColumnsRenamed({"item_id": item_key, "doc_id": key})
