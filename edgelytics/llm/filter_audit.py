"""What each of several document filters removes, in every order they may be applied.

The filters do not depend on each other, so a document is fully described by the set of
filters it fails. Documents are counted once by (part, failed set); everything else is
read from the lattice of applied sets: a state is a set of filters already applied, an
edge adds one filter and removes the documents that fail it and no filter applied before.
An order is a path from the empty state to the full one. Forward counts say how many
orders reach a state, backward counts how many leave it, and their product is how many
orders use an edge: summed over a filter's edges these weights give its Shapley numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelytics.llm.common import as_bytes, slices, stored, text_column

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_NOT_SIGNS = bytes(c for c in range(256) if c not in b"#$%&*|")

FILTERS = "ABCDE"
LEAST_WORDS = 50
#: Filters that look at a text alone; E compares texts.
_OWN = "ABCD"


def own_failures(text: bytes, code_points: int) -> int:
    """The filters A to D that a text fails, as bits 0 to 3.

    A: under 50 words. B: fewer than 65 distinct words in 100. C: more than 5 of 100 code
    points are A-Z. D: a character of `#$%&*|`.
    """
    words = text.split()
    failed = int(len(words) < LEAST_WORDS)
    failed |= (100 * len(set(words)) < 65 * len(words)) << 1
    failed |= (100 * (len(text) - len(text.translate(None, _CAPITALS))) > 5 * code_points) << 2
    return failed | (len(text.translate(None, _NOT_SIGNS)) > 0) << 3


def judge_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(_key, part, failed, h1, h2) for each row: its bits for A to D and a 128-bit hash of its text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            lengths = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
            failed, h1, h2 = [], [], []
            for data, points in zip(as_bytes(batch.column(2)), lengths, strict=True):
                data = data or b""
                failed.append(own_failures(data, points))
                digest = xxhash.xxh3_128_digest(data)
                h1.append(int.from_bytes(digest[:8], "little", signed=True))
                h2.append(int.from_bytes(digest[8:], "little", signed=True))
            made = [pa.array(failed, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *made], ["_key", "part", "failed", "h1", "h2"]
            )

    part_name = F.coalesce(F.col(f"`{part}`").cast("string"), F.lit(""))
    read = docs.select(F.col(f"`{key}`").alias("_key"), part_name.alias("part"), text_column(f"`{text}`").alias("_text"))
    return read.mapInArrow(run, f"_key {kind}, part string, failed int, h1 long, h2 long")


def failure_cube(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, failed, docs, good, toxic): documents by part and set of failed filters.

    `failed` has a bit for each letter of FILTERS. A row is good (toxic) if a label row of
    its key has quality (toxic) 1. Copies are combined before any shuffle that depends on
    their text alone, and rows of one key and text before the join with the labels.
    """
    named = ["h1", "h2", "failed", "part"]
    rows = stored(judge_texts(docs, key, text, part).groupBy(*named, "_key").agg(F.count(F.lit(1)).alias("n")), "judged")
    marks = labels.groupBy(F.col(f"`{key}`").alias("_key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    marks = marks.filter("good or toxic")
    marked = rows.join(marks, "_key", "left").na.fill(False, ["good", "toxic"])
    # per text: what has its smallest key, and all of it
    alike = stored(
        marked.groupBy(*named, "good", "toxic").agg(
            F.sum("n").alias("n"),
            F.min("_key").alias("first"),
            F.min_by("n", "_key").alias("n_first"),
            F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("n"))), F.lit(0)).alias("n_unnamed"),
        ),
        "texts",
    )
    firsts = alike.groupBy("h1", "h2").agg(F.min("first").alias("least"))
    later = alike.join(firsts, ["h1", "h2"]).withColumn(
        "n_later",
        F.col("n") - F.col("n_unnamed") - F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0),
    )
    copy = 1 << FILTERS.index("E")
    split = F.array(
        F.struct(F.col("failed").alias("failed"), (F.col("n") - F.col("n_later")).alias("docs")),
        F.struct(F.col("failed").bitwiseOR(copy).alias("failed"), F.col("n_later").alias("docs")),
    )
    spread = later.select("part", "good", "toxic", F.inline(split)).filter("docs > 0")
    return spread.groupBy("part", "failed").agg(
        F.sum("docs").alias("docs"),
        F.sum(F.when(F.col("good"), F.col("docs")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("docs")).otherwise(0)).alias("toxic"),
    )


# The lattice of applied sets: states are bit sets, an edge (state, filter) adds a filter.


@cache
def path_counts(filters: int) -> tuple[list[int], list[int]]:
    """How many orders reach each state from the empty one, and leave it for the full one."""
    states = 1 << filters
    forward, backward = [1] + [0] * (states - 1), [0] * (states - 1) + [1]
    for state in range(states):  # an edge leads to a larger number
        for added in range(filters):
            if not state >> added & 1:
                forward[state | 1 << added] += forward[state]
    for state in reversed(range(states)):
        for added in range(filters):
            if not state >> added & 1:
                backward[state] += backward[state | 1 << added]
    return forward, backward


def edges_table(filters: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders): each edge and how many orders use it."""
    forward, backward = path_counts(filters)
    return [
        (state, added, forward[state] * backward[state | 1 << added])
        for state in range(1 << filters)
        for added in range(filters)
        if not state >> added & 1
    ]


def steps_table(filters: Sequence[str]) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, state, filter): the edge that each step of each order takes."""
    rows = []
    for order in permutations(range(len(filters))):
        state = 0
        for step, added in enumerate(order, start=1):
            rows.append(("".join(filters[i] for i in order), step, state, added))
            state |= 1 << added
    return rows


def lattice_edges(cube: DataFrame, filters: int) -> DataFrame:
    """Per part and edge: kept, removed, redundant, unique_fails, good_lost, toxic_lost, and
    shapley, the filter's removals summed over all orders.

    Each cube row meets each of the fixed number of edges once; what is left is one combined
    aggregation, so a part's cost does not depend on how many documents it has.
    """
    mine = F.expr("shiftright(failed, filter) & 1 = 1")
    before = F.col("failed").bitwiseAND(F.col("state")) == 0
    only = F.col("failed") == F.expr("shiftleft(1, filter)")

    def total(condition: Column, what: str) -> Column:
        return F.sum(F.when(condition, F.col(what)).otherwise(0))

    states = cube.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit((1 << filters) - 1))))
    met = states.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(filters - 1))))
    met = met.filter("shiftright(state, filter) & 1 = 0")
    found = met.groupBy("part", "state", "filter").agg(
        total(before & ~mine, "docs").alias("kept"),
        total(before & mine, "docs").alias("removed"),
        total(~before & mine, "docs").alias("redundant"),
        total(only, "docs").alias("unique_fails"),
        total(before & mine, "good").alias("good_lost"),
        total(before & mine, "toxic").alias("toxic_lost"),
    )
    edges = cube.sparkSession.createDataFrame(edges_table(filters), "state int, filter int, orders long")
    found = found.join(F.broadcast(edges), ["state", "filter"])  # 80 rows for five filters
    shares = found.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    return found.join(shares, ["part", "filter"])


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step.

    Columns: part, filter_order, step (1-5), kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley; zeros are listed. A null text is an empty one; a null
    part is the part "". Rows that repeat count as often as they occur and are copies of
    each other only if their keys differ; a null key is neither copy nor original. Several
    label rows of a key count as one with the largest values. Other columns are not read.
    An empty table has no part, so no rows.
    """
    spark = docs.sparkSession
    cube = failure_cube(docs, labels, key, text, part)
    edges = stored(lattice_edges(cube, len(FILTERS)), "lattice")
    steps = spark.createDataFrame(steps_table(FILTERS), "filter_order string, step int, state int, filter int")
    return edges.join(F.broadcast(steps), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
