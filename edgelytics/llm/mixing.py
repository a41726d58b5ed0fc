"""Mixing sources to target weights, by blocks of a fixed number of words.

The words of a source form one line, cut into blocks of equal length. Output shards draw
how many blocks each source gives, multinomially from what the sources still owe, so the
sums come out exact. The draws of a source are numbered slots; a pseudorandom permutation
of the source's block numbers, another for each pass over the source, says which block a
slot takes. Blocks are then joined by number. Nothing is sorted or counted as a whole: a
source's line is laid out by buckets, so a source of a third of all words is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from edgelytics.llm.common import as_bytes, slices, stored, text_column

WEIGHTS = (5, 2, 1)


def whole_row(docs: DataFrame) -> Column:
    """A hash of all columns and of which are null."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema]
    # maps have no hash
    told = [c.cast("string") if "map<" in f.dataType.simpleString() else c for c, f in zip(columns, docs.schema, strict=True)]
    return F.xxhash64(*told, *[c.isNull() for c in columns])


def word_counts(docs: DataFrame, key: str, source: str, text: str, whole: bool = False) -> DataFrame:
    """(key, source, row, whole, size): words of each text, a hash of key and text, and, if
    asked for, whole_row (else 0)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sizes = [len((t or b"").split()) for t in as_bytes(batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64())], ["_key", "source", "row", "whole", "size"])

    read = docs.select(
        F.col(key).alias("_key"), F.col(source).cast("string").alias("source"),
        F.xxhash64(F.col(key), text_column(text)).alias("row"),
        (whole_row(docs) if whole else F.lit(0).cast("long")).alias("whole"), text_column(text).alias("_text"),
    )
    return read.mapInArrow(run, f"_key {kind}, source string, row long, whole long, size long").withColumnRenamed("_key", key)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_no, source_size, target): one row per source.

    Sources in code point order, null last, take the weights in turn and share all words.
    A target stops at `most` times the source's size; the excess goes to the others by
    weight, until none is above: targets are least(most * size, level * weight), and the
    level follows from the sources in the order in which they reach their stop. Windows
    here see one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("source_no", (F.row_number().over(order) - 1).cast("int"))
    turn = F.col("source_no") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    stop = (most * F.col("source_size")).cast("double")
    rows = ranked.withColumn("w", weight).withColumn("stop", stop).withColumn("level", F.col("stop") / F.col("w"))
    by_level = W.orderBy("level", "source_no")
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    earlier = by_level.rowsBetween(W.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("stopped", F.coalesce(F.sum("stop").over(earlier), F.lit(0.0)))
        .withColumn("waiting", F.sum("w").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("at_stop", F.col("stopped") + F.col("level") * F.col("waiting") <= F.col("total"))
    )
    stops = F.sum(F.when(F.col("at_stop"), F.col("stop")).otherwise(0.0)).over(everything)
    others = F.sum(F.when(F.col("at_stop"), 0.0).otherwise(F.col("w"))).over(everything)
    share = F.when(F.col("at_stop"), F.col("stop")).otherwise((F.col("total") - stops) / others * F.col("w"))
    return rows.select("source", "source_no", "source_size", share.alias("target"))


# Slots


def permuted(numbers: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0 to size - 1, taken at `numbers`: four Feistel rounds
    over the least even number of bits, repeated for values that fall outside."""
    half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    x = numbers.astype(np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = x[todo] >> shift, x[todo] & low
            for turn in range(4):
                mixed = (right + np.uint64((seed * 4 + turn) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((mixed >> np.uint64(31)) & low)
            x[todo] = (left << shift) | right
            todo = todo[x[todo] >= size]
    return x.astype(np.int64)


def draw_counts(owed: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """counts[shard, source]: multinomial draws from what is still owed, without putting
    back, so every column adds up to `owed`; shards hold equally many, the last ones one less."""
    generator = np.random.default_rng(seed)
    left, total = owed.astype(np.int64).copy(), int(owed.sum())
    counts = np.zeros((shards, len(owed)), np.int64)
    for shard in range(shards):
        size = total // shards + (shard < total % shards)
        # one source after the other: how many of this shard's draws are its own
        rest, draws = int(left.sum()), size
        for source in range(len(left)):
            own = int(left[source])
            taken = _hypergeometric(generator, own, rest - own, draws)
            counts[shard, source] = taken
            left[source] -= taken
            rest -= own
            draws -= taken
    return counts


def _hypergeometric(generator: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not good or not draws:
        return 0
    if not bad:
        return draws
    if max(good, bad) < 10**9:
        return int(generator.hypergeometric(good, bad, draws))
    mean = draws * good / (good + bad)  # beyond the generator's range: its normal limit
    spread = (mean * (bad / (good + bad)) * ((good + bad - draws) / (good + bad - 1))) ** 0.5
    return int(min(good, draws, max(0, draws - bad, round(generator.normal(mean, spread)))))


_CHUNK = 1 << 16


def draw_slots(sources: DataFrame, block_words: int, shards: int, seed: int) -> DataFrame:
    """(shard, place, source_no, block): which block stands where in the mix.

    The driver sees one row per source and one number per source and shard; slots are
    made in chunks on the executors.
    """
    spark = sources.sparkSession
    rows = [r for r in sources.collect() if r["source_size"]]  # one row per source
    blocks = [-(-r["source_size"] // block_words) for r in rows]
    owed = np.array([round(r["target"] * n / r["source_size"]) for r, n in zip(rows, blocks, strict=True)], np.int64)
    counts = draw_counts(owed, shards, seed) if rows else np.zeros((0, 0), np.int64)
    chunks, first = [], np.zeros(len(rows), np.int64)
    for shard in range(len(counts)):
        place = 0
        for at, row in enumerate(rows):
            count = int(counts[shard, at])
            if count:
                chunks.append((shard, place, row["source_no"], blocks[at], int(first[at]), count))
            first[at] += count
            place += count
    schema = "shard int, place long, source_no int, blocks long, first long, count long"
    given = spark.createDataFrame(chunks, schema)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(_CHUNK).cast("long"))).alias("skip")
    cut = given.select("*", starts).select(
        "shard", (F.col("place") + F.col("skip")).alias("place"), "source_no", "blocks",
        (F.col("first") + F.col("skip")).alias("first"), F.least(F.lit(_CHUNK), F.col("count") - F.col("skip")).alias("count"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, place, source, size, start, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slot = np.arange(start, start + count)
                turn, within = slot // size, slot % size
                block = np.empty(count, np.int64)
                for t in np.unique(turn).tolist():
                    own = turn == t
                    block[own] = permuted(within[own], size, (seed << 32) + (source << 8) + t)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(count, shard, np.int32)),
                        pa.array(np.arange(place, place + count)),
                        pa.array(np.full(count, source, np.int32)),
                        pa.array(block),
                    ],
                    ["shard", "place", "source_no", "block"],
                )

    spread = cut.repartition(F.col("source_no"), F.col("first"))
    return spread.mapInArrow(run, "shard int, place long, source_no int, block long")


# Blocks


def lay_out(sizes: DataFrame, sources: DataFrame, key: str, bucket_rows: int) -> DataFrame:
    """`sizes` with source_no, source_size, target and `start`, the row's place in its source's line.

    A source is dealt to buckets by hash; rows are summed within a bucket, buckets within
    a source. `sources` has one row per source.
    """
    buckets = max(1, -(-sizes.count() // bucket_rows))
    dealt = _with_source(sizes, sources).withColumn("_bucket", F.pmod("row", F.lit(buckets)).cast("int"))
    within = W.partitionBy("source_no", "_bucket").orderBy("row", key, "size", "whole").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_sum"))
    before = W.partitionBy("source_no").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("source_no", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    run = F.coalesce(F.sum("size").over(within), F.lit(0))
    return dealt.withColumn("_run", run).join(starts, ["source_no", "_bucket"]).withColumn(
        "start", F.col("_before") + F.col("_run")
    ).drop("_bucket", "_run", "_before")


def _with_source(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    given = sources.withColumnRenamed("source", "_source")
    return sizes.join(given, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def block_pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """One row per document and block it reaches into: block, from and upto, the words of
    the document that lie there. A document without words has one row and no block."""
    first = F.floor(F.col("start") / block_words)
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    blocks = F.when(F.col("size") > 0, F.sequence(first, last))
    cut = placed.select("*", F.explode_outer(blocks).alias("block"))
    begin = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size"))
    return cut.withColumn("from", begin).withColumn("upto", end)


def taken_pieces(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    block_words: int = 64,
    shards: int = 64,
    seed: int = 5,
    bucket_rows: int = 5_000,
    whole: bool = False,
) -> DataFrame:
    """block_pieces with `times`, how often the mix takes the piece.

    Slots are counted per block before they meet the pieces.
    """
    sizes = stored(word_counts(docs, key, source, text, whole), "word-counts")
    sources = stored(source_targets(sizes), "sources")
    slots = draw_slots(sources, block_words, shards, seed)
    counts = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    pieces = block_pieces(lay_out(sizes, sources, key, bucket_rows), block_words)
    # the slots come out of a few short rows, from which Spark would take them for few too
    joined = pieces.join(counts.hint("merge"), ["source_no", "block"], "left")
    return joined.withColumn("times", F.coalesce("times", F.lit(0)).cast("long"))


def mix_sizes(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:  # noqa: ANN003
    """key, source, size, source_size, target, taken: one row per document.

    `taken` counts the document's words in the mix, repeats included, at most three times
    its size, since no block is drawn more often. A null text has no words; a null source
    is a source, the last; with no words at all every target is 0. Rows alike in all of
    key, source and text are told apart by their place in the source's line. Reruns over
    the same rows agree. Other columns are not read.
    """
    pieces = taken_pieces(docs, key, **options)
    words = F.coalesce(F.col("upto") - F.col("from"), F.lit(0)) * F.col("times")
    empty = F.col("size") == 0  # these share their place
    some = pieces.filter(~empty).groupBy(key, "source", "row", "start", "size", "source_size", "target").agg(F.sum(words).alias("taken"))
    none = pieces.filter(empty).withColumn("taken", F.lit(0).cast("long"))
    columns = [key, "source", "size", "source_size", "target", "taken"]
    return some.select(columns).union(none.select(columns))


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """The mix as rows of `docs`, all columns kept: for each pass over its source a document
    gives one row with the words that this pass takes, in their order and with the blanks
    between them. A document of which nothing is taken gives none. Rows alike in key and
    text keep their own source and other columns."""
    pieces = taken_pieces(docs, key, text=text, whole=True, **options).filter("times > 0")
    # rows alike in all columns have a place each
    spans = pieces.groupBy("source_no", F.col("whole").alias("row"), "start").agg(F.collect_list(F.struct("from", "upto", "times")).alias("_spans"))
    columns = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = columns.index(text)
    named = docs.withColumn("_row", whole_row(docs)).dropDuplicates(["_row"])
    joined = named.join(spans, F.col("_row") == F.col("row"))
    out = joined.select(*[F.col(f"`{c}`") for c in columns], "_spans", text_column(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            rows, texts = [], []
            found = batch.column(len(columns)).to_pylist()
            for row, value in enumerate(as_bytes(batch.column(len(columns) + 1))):
                for turn in range(max(x["times"] for x in found[row])):
                    rows.append(row)
                    texts.append(cut_words(value, [(x["from"], x["upto"]) for x in found[row] if x["times"] > turn]))
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(columns)]]
            taken[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(taken, columns)

    return out.mapInArrow(run, kinds)


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The words of the spans with what stands before each word, except before the first."""
    ends, starts, at = [], [], 0
    for word in text.split():
        at = text.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    parts = []
    for begin, end in sorted(spans):
        lead = ends[begin - 1] if parts and begin else starts[begin]
        parts.append(text[lead : ends[end - 1]])
    return b"".join(parts).decode()
