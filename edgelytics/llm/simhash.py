"""Near-duplicates by SimHash, found through a hierarchical index in Gray order.

Distinct fingerprints are sorted by Gray rank, so that neighbours differ in few bits, and
cut into groups. A group is described by its mask, the bits on which all its members
agree, and their pattern; groups of groups are described the same way, so what members
share is kept once, in an upper node. Two nodes whose patterns differ in more than the
allowed bits within both masks hold no link, whatever is below them, and are dropped
whole; the others are opened, level by level, adding the differences that show up there.

The upper levels are opened by joins on the node number. A pair of groups that is left is
opened further inside one task, down to single fingerprints. The task returns a spanning
forest of the links it finds, at most one row per member, never the links of a dense
group; components of the forests are components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from edgelytics.llm.common import as_bytes, slices, stored, text_column
from edgelytics.llm.components import components

BITS = 64
SEED = 42


# Fingerprints


def shingles(text: bytes | None, width: int) -> list[bytes]:
    """The word sequences of `width` words, repeats included; a shorter text gives its whole sequence."""
    words = (text or b"").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))


def _hash(gram: bytes) -> int:
    return xxhash.xxh64_intdigest(gram, SEED)


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows of 64-bit words set each bit, for each word.

    Three rows of a weight become one of that weight and one of twice it, as a full adder
    does, until few are left to be counted singly.
    """
    ones = np.zeros((rows.shape[1], BITS), np.int64)
    todo = [(1, rows)]
    while todo:
        weight, part = todo.pop()
        third = len(part) // 3
        if third < 256:
            bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
            ones += weight * bits.sum(0, dtype=np.int64).reshape(ones.shape)
            continue
        a, b, c = part[:third], part[third : 2 * third], part[2 * third : 3 * third]
        half = a ^ b
        todo.append((weight, np.concatenate([half ^ c, part[3 * third :]])))
        todo.append((2 * weight, (a & b) | (half & c)))
    return ones


def signature(text: bytes | None, width: int, words: int = 1) -> np.ndarray:
    """`words` 64-bit words of the bits set in more than half of the shingles' hashes, 0 if
    there are none. The first is the fingerprint; the others come from the hashes mixed anew."""
    grams = shingles(text, width)
    if not grams:
        return np.zeros(words, np.uint64)
    ones = np.zeros((words, BITS), np.int64)
    for at in range(0, len(grams), 1 << 16):
        part = grams[at : at + (1 << 16)]
        hashes = np.fromiter(map(_hash, part), np.uint64, len(part))
        rows = np.empty((len(part), words), np.uint64)
        rows[:, 0] = hashes
        with np.errstate(over="ignore"):
            for k in range(1, words):
                mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
                rows[:, k] = mixed ^ (mixed >> np.uint64(32))
                hashes = rows[:, k]
        ones += bit_counts(rows)
    return np.packbits(2 * ones > len(grams), axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    return int(signature(text, width)[0])


def signatures(docs: DataFrame, key: str, text: str, width: int, words: int) -> DataFrame:
    """The key and `sig` of every row, the words as signed longs. A null text has no words."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            rows = [signature(t, width, words).view(np.int64) for t in as_bytes(batch.column(1))]
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
            offsets = pa.array(np.arange(0, words * len(rows) + 1, words, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["_key", "sig"])

    read = docs.select(F.col(key).alias("_key"), text_column(text).alias("_text"))
    return read.mapInArrow(run, f"_key {kind}, sig array<long>").withColumnRenamed("_key", key)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """The key and `fp` of every row, the 64 bits as a signed long."""
    return signatures(docs, key, text, width, 1).select(F.col(key), F.col("sig")[0].alias("fp"))


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# The index


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in the reflected Gray code, as a signed long in the same order."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(2**63)))


_GROUP = pa.schema([("mask", pa.int64()), ("pattern", pa.int64()), ("members", pa.binary())])


def gray_groups(entries: DataFrame, group_rows: int) -> DataFrame:
    """One row per run of entries in Gray order of `fp`: node, mask, pattern, members.

    `members` packs the entries' columns, all longs, one after the other. Runs are the
    partitions of a range partitioning by Gray rank, cut every `group_rows` rows, so no
    task sorts more than its range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None

        def row(begin: int, end: int) -> pa.RecordBatch:
            members = left[0][begin:end]
            ones, some = np.bitwise_and.reduce(members), np.bitwise_or.reduce(members)
            data = b"".join(c[begin:end].astype("<i8").tobytes() for c in left)
            return pa.RecordBatch.from_pylist([{"mask": int(~(ones ^ some)), "pattern": int(ones), "members": data}], _GROUP)

        for batch in batches:
            more = [c.to_numpy() for c in batch.columns]
            left = more if left is None else [np.concatenate(x) for x in zip(left, more, strict=True)]
            while len(left[0]) >= 2 * group_rows:
                yield row(0, group_rows)
                left = [c[group_rows:] for c in left]
        if left is not None and len(left[0]):
            cuts = np.linspace(0, len(left[0]), -(-len(left[0]) // group_rows) + 1).astype(int).tolist()
            for begin, end in zip(cuts, cuts[1:], strict=False):
                yield row(begin, end)

    ranked = entries.select("*", gray_rank(F.col("fp")).alias("rank"))
    spread = ranked.repartitionByRange("rank").sortWithinPartitions("rank").select(entries.columns)
    groups = spread.mapInArrow(run, "mask long, pattern long, members binary")
    return groups.withColumn("node", F.monotonically_increasing_id())


def _parents(nodes: DataFrame, fan: int) -> DataFrame:
    """The nodes of a level dealt to parents, `fan` neighbours in Gray order each, by node number.

    The numbers are dense, so that parents are equal runs whatever the partitions were.
    """
    return nodes.withColumn("parent", F.floor(F.col("node") / F.lit(fan)).cast("long"))


def _level_above(nodes: DataFrame) -> DataFrame:
    """A parent shares the bits that are shared by all children with the same value."""
    both = F.bit_and("pattern").alias("_ones"), F.bit_or("pattern").alias("_any"), F.bit_and("mask").alias("_all")
    rolled = nodes.groupBy(F.col("parent").alias("node")).agg(*both)
    mask = F.col("_all").bitwiseAND(F.bitwise_not(F.col("_ones").bitwiseXOR(F.col("_any"))))
    return rolled.select("node", mask.alias("mask"), F.col("_ones").bitwiseAND(mask).alias("pattern"))


def _near(a: str, b: str, bits: int) -> Column:
    differ = F.col(f"{a}.pattern").bitwiseXOR(F.col(f"{b}.pattern"))
    shared = F.col(f"{a}.mask").bitwiseAND(F.col(f"{b}.mask"))
    return F.bit_count(differ.bitwiseAND(shared)) <= bits


def candidate_groups(groups: DataFrame, bits: int, fan: int = 16) -> DataFrame:
    """Pairs (a, b), a <= b, of groups that may hold a link, found from the root down."""
    levels = [groups.select("node", "mask", "pattern")]
    size = levels[0].count()
    while size > 1:
        levels[-1] = _parents(levels[-1], fan)
        above = stored(_level_above(levels[-1]), "gray-level")
        levels.append(above)
        size = -(-size // fan)
    top = levels.pop().select(F.col("node").alias("a"), F.col("node").alias("b"))
    pairs = top
    while levels:
        children = levels.pop()
        left = children.select(F.col("parent").alias("a"), F.struct("node", "mask", "pattern").alias("x"))
        right = children.select(F.col("parent").alias("b"), F.struct("node", "mask", "pattern").alias("y"))
        opened = pairs.join(left, "a").join(right, "b")
        pairs = opened.filter(F.col("x.node") <= F.col("y.node")).filter(_near("x", "y", bits))
        pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return pairs


# Inside a pair of groups


class _Tree:
    """A group's own upper nodes: runs of 1, 2, 4, ... members in Gray order, with mask and pattern."""

    def __init__(self, members: np.ndarray):
        n = len(members)
        self.members = members
        full = np.uint64(2**64 - 1)
        self.levels = [(np.full(n, full, np.uint64), members)]
        while len(self.levels[-1][0]) > 1:
            mask, pattern = self.levels[-1]
            if len(mask) % 2:  # the odd one out stands for itself
                mask, pattern = np.append(mask, mask[-1]), np.append(pattern, pattern[-1])
            agree = mask[::2] & mask[1::2] & ~(pattern[::2] ^ pattern[1::2])
            self.levels.append((agree, pattern[::2] & agree))

    def __len__(self) -> int:
        return len(self.members)


def _links(x: _Tree, y: _Tree, bits: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of member index pairs within `bits`, by opening both trees together.

    Candidates are opened in blocks of `most`, deepest first, which bounds the memory.
    """
    top = max(len(x.levels), len(y.levels)) - 1
    todo = [(top, np.zeros(1, np.int32), np.zeros(1, np.int32))]
    while todo:
        level, a, b = todo.pop()
        if len(a) > most:
            half = len(a) // 2
            todo += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        mx, px = x.levels[min(level, len(x.levels) - 1)]
        my, py = y.levels[min(level, len(y.levels) - 1)]
        near = np.bitwise_count((px[a] ^ py[b]) & mx[a] & my[b]) <= bits
        a, b = a[near], b[near]
        if not len(a):
            continue
        if level == 0:
            yield a, b
            continue
        # a tree that is lower than the other waits until its own top level is due
        open_x, open_y = level < len(x.levels), level < len(y.levels)
        nx, ny = len(x.levels[level - 1][0]) if open_x else 0, len(y.levels[level - 1][0]) if open_y else 0
        parts = []
        for i in (0, 1) if open_x else (0,):
            for j in (0, 1) if open_y else (0,):
                ca, cb = (2 * a + i if open_x else a), (2 * b + j if open_y else b)
                ok = np.ones(len(ca), bool)
                if open_x:
                    ok &= ca < nx
                if open_y:
                    ok &= cb < ny
                if x is y:
                    ok &= ca <= cb
                parts.append((ca[ok], cb[ok]))
        todo.append((level - 1, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels after merging along a - b, and the links that merged something."""
    used_a, used_b = [], []
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        # one link per larger label: to its least partner
        order = np.lexsort((low, high))
        first = np.r_[True, high[order][1:] != high[order][:-1]]
        chosen = order[first]
        used_a.append(a[chosen])
        used_b.append(b[chosen])
        step = np.arange(len(label), dtype=label.dtype)
        step[high[chosen]] = low[chosen]
        while True:  # every chain of steps ends at a smaller label
            further = step[step]
            if np.array_equal(further, step):
                break
            step = further
        label = step[label]
    nothing = np.empty(0, np.int64)
    return label, np.concatenate([nothing, *used_a]), np.concatenate([nothing, *used_b])


def _columns(members: bytes, count: int) -> list[np.ndarray]:
    return list(np.frombuffer(members, "<u8").reshape(count, -1))


def forest(
    x: list[np.ndarray], y: list[np.ndarray] | None, bits: int, check_bits: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links within `bits` connect, between x and y (or inside x).

    x and y are the fingerprints, the names to return for them and, if there are further
    columns, the words of whole signatures: these may then differ in `check_bits` bits. What
    fails that never merges labels, so it cannot stand in for a link that passes.
    """
    tree_x = _Tree(x[0])
    tree_y = tree_x if y is None else _Tree(y[0])
    shift = 0 if y is None else len(x[0])
    value, name, *check = x if y is None else [np.concatenate(c) for c in zip(x, y, strict=True)]
    label = np.arange(len(value), dtype=np.int64)
    found_a, found_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for a, b in _links(tree_x, tree_y, bits):
        a, b = a.astype(np.int64), b.astype(np.int64) + shift
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        differ = np.zeros(len(a), np.int64)
        for word in check:
            differ += np.bitwise_count(word[a] ^ word[b])
            near = differ <= check_bits
            a, b, differ = a[near], b[near], differ[near]
        label, used_a, used_b = _joined(label, a, b)
        found_a.append(name[used_a])
        found_b.append(name[used_b])
    return np.concatenate(found_a), np.concatenate(found_b)


def index_links(entries: DataFrame, bits: int, group_rows: int, check_bits: int | None = None) -> DataFrame:
    """(a, b): links of a spanning forest per pair of groups; their components are those of
    all links between entries whose `fp` differ in at most `bits` bits (and, with further
    columns, a name and the words of a signature, pass forest's second test)."""
    width = len(entries.columns)
    raw = stored(gray_groups(entries, group_rows), "gray-groups")
    # dense numbers in Gray order; one narrow row per group passes here
    numbers = raw.select("node", (F.row_number().over(W.orderBy("node")) - 1).cast("long").alias("dense"))
    groups = stored(raw.join(numbers, "node").select(F.col("dense").alias("node"), "mask", "pattern", "members"), "groups")
    pairs = stored(candidate_groups(groups, bits), "group-pairs")
    left = groups.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = groups.select(F.col("node").alias("b"), F.col("members").alias("y"))
    tasks = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b, x, y = (batch.column(i)[row].as_py() for i in range(4))
                own, other = _columns(x, width), None if a == b else _columns(y, width)
                if width == 1:
                    own, other = own * 2, other and other * 2
                found = forest(own, other, bits, check_bits)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in found], ["a", "b"])

    return tasks.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def fingerprint_links(fps: DataFrame, bits: int = 3, group_rows: int = 4096) -> DataFrame:
    """index_links of distinct fingerprints, named by themselves; null ones add nothing."""
    return index_links(fps.select("fp").filter("fp is not null").distinct(), bits, group_rows)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = 3, group_rows: int = 4096
) -> DataFrame:
    """key, fp, component: every row with its 64-bit SimHash and its group's least key.

    Documents link if their fingerprints differ in at most `bits` bits; groups are the
    connected components, exact and complete. Texts without words, null ones included,
    have fingerprint 0 and link like any other. Rows with a null key are kept; the group's
    least key ignores them (null if there is no other). Repeated rows are kept. Other
    columns are not read.
    """
    marked = stored(fingerprints(docs, key, text, width), "fingerprints")
    links = stored(fingerprint_links(marked, bits, group_rows), "fingerprint-links")
    labels = components(links, "a", "b").withColumnsRenamed({"node": "fp", "component": "label"})
    # least key per fingerprint first, so that thousands of copies are one row
    least = marked.groupBy("fp").agg(F.min(key).alias("_least"))
    named = stored(least.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labels")
    group = named.groupBy("label").agg(F.min("_least").alias("component"))
    per_fp = named.join(group, "label").select("fp", "component")
    return marked.join(per_fp, "fp").select(F.col(key), "fp", "component")


# Copies with more changes


def view_of(number: int, view_bits: int) -> Column:
    """`view_bits` bits of the signature `sig`, below a code of the view's number in which
    any two views differ in at least four bits, so that views never link to each other."""
    word, shift = divmod(number * view_bits, BITS)
    low = F.shiftrightunsigned(F.col("sig")[word], shift)
    if shift + view_bits > BITS:
        low = low.bitwiseOR(F.shiftleft(F.col("sig")[word + 1], BITS - shift))
    code = sum(((number >> k & 1) * 0b1111) << 4 * k for k in range((BITS - view_bits) // 4))
    whole = low.bitwiseAND(F.lit((1 << view_bits) - 1)).bitwiseOR(F.shiftleft(F.lit(code).cast("long"), view_bits))
    return whole.cast("long")


def near_copies(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    views: int = 12,
    view_bits: int = 40,
    bits: int = 3,
    words: int = 8,
    group_rows: int = 1 << 17,
) -> DataFrame:
    """key, component: groups of texts whose shingles are alike by `similarity` or more.

    One 64-bit fingerprint within three bits only finds copies that differ in a few
    shingles in a hundred. Here a text has a signature of `words` such words. The Gray
    index holds several views of it, `view_bits` bits each, with the whole signature beside
    each view; what meets in any view links by the whole signature alone, whose share of
    differing bits measures the similarity:
    shingle sets alike by s differ in acos(2s / (1 + s)) / pi of all bits. A pair at 0.8
    meets in one of 12 views of 40 bits in four of five cases, a pair at 0.9 nearly always.
    Null keys, null texts and repeated rows as in near_duplicates.
    """
    marked = stored(signatures(docs, key, text, width, words), "signatures")
    classes = marked.groupBy("sig").agg(F.min(key).alias("least"))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "signature-classes")
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    whole = [F.col("sig")[k].alias(f"word{k}") for k in range(words)]
    entries = nodes.select(F.explode(F.array(*[view_of(k, view_bits) for k in range(views)])).alias("fp"), "node", *whole)
    links = stored(index_links(entries, bits, group_rows, math.ceil(share * words * BITS)).distinct(), "view-links")
    labels = components(links, "a", "b").withColumnsRenamed({"component": "label"})
    group = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    group = stored(group.select("sig", "least", "label"), "signature-labels")
    least = group.groupBy("label").agg(F.min("least").alias("component"))
    return marked.join(group.join(least, "label").select("sig", "component"), "sig").select(key, "component")
