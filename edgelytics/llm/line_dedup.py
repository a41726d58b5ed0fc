"""Lines that many documents share, dropped by way of sharded minimal perfect hashes.

1. Each document gives its distinct line keys as 128-bit hashes; they are counted.
2. The distinct hashes are dealt to shards of bounded size. A shard becomes one row: a
   minimal perfect hash (bit arrays in levels), an array of fingerprints and an array of
   counts, all by slot.
3. Documents probe the arrays. Probes and array rows of a shard meet in one sorted
   partition; the task holds one shard's arrays and streams the probes past them. Within
   a batch of documents a hash is probed once, and the probes of a shard go to several
   copies of its arrays, so a line of a third of all documents does not pile up.
4. The hashes found frequent return to their documents, which drop those lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelytics.llm.common import as_bytes, slices, stored, text_column

_BLANK_BYTES = b" \t\n\x0b\x0c\r"
GAMMA = 2  # bits per key on each level
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANK_BYTES).lower()


def _hash(key: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(key)
    return digest >> 64, digest & 0xFFFFFFFFFFFFFFFF


def _mixed(low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash of the key for each level."""
    with np.errstate(over="ignore"):
        x = low ^ (high * np.uint64(2 * level + 1)) ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: n keys get the slots 0 to n - 1.

    Each level has GAMMA bits per remaining key; a key alone on its bit stays there, the
    others go on to the next level. The slot is the number of set bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bytes of packed bits
        self.before = []
        start = 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.before.append(start + np.concatenate([[0], np.cumsum(ones)[:-1]]))
            start += int(ones.sum())
        self.size = start

    @classmethod
    def of(cls, low: np.ndarray, high: np.ndarray) -> PerfectHash:
        levels = []
        while len(low):
            wide = (max(64, GAMMA * len(low)) + 7) // 8 * 8
            at = _mixed(low, high, len(levels)) % np.uint64(wide)
            alone = np.bincount(at.astype(np.int64), minlength=wide) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            rest = ~alone[at.astype(np.int64)]
            low, high = low[rest], high[rest]
            if len(levels) > 400:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys that were not built in, any slot or -1."""
        out = np.full(len(low), -1, np.int64)
        left = np.arange(len(low))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (_mixed(low[left], high[left], level) % np.uint64(8 * len(bits))).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            found = (bits[byte] >> bit) & 1 == 1
            below = bits[byte[found]] & ((np.uint8(1) << bit[found]) - np.uint8(1))
            out[left[found]] = self.before[level][byte[found]] + np.bitwise_count(below)
            left = left[~found]
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        return head + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        count = int(np.frombuffer(data, "<u4", 1)[0])
        sizes = np.frombuffer(data, "<u4", count, 4)
        at, levels = 4 + 4 * count, []
        for size in sizes.tolist():
            levels.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        return cls(levels)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


_LINES = "hi long, lo long, docs binary, n long"


def _document_lines(texts: DataFrame, least_length: int) -> DataFrame:
    """(hi, lo, docs, n): per batch of documents each distinct key once, with the packed
    numbers of its documents, and how many rows it has there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found: dict[bytes, list[int]] = {}
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                for key in {line_key(x) for x in (text or b"").split(b"\n")}:
                    if len(key) >= least_length and (least_length < 2 or len(key.decode()) >= least_length):
                        found.setdefault(key, []).append(doc)
            pairs = [_hash(key) for key in found]
            hi = np.array([p[0] for p in pairs], np.uint64)
            lo = np.array([p[1] for p in pairs], np.uint64)
            docs = [np.array(x, "<i8").tobytes() for x in found.values()]
            yield pa.RecordBatch.from_arrays(
                [_signed(hi), _signed(lo), pa.array(docs, pa.binary()), pa.array(map(len, found.values()), pa.int64())],
                ["hi", "lo", "docs", "n"],
            )

    return texts.mapInArrow(run, _LINES)


def _build(counts: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the packed perfect hash, fingerprints and counts by slot."""

    def run(group: pa.Table) -> pa.Table:
        hi, lo = _unsigned(group["hi"].combine_chunks()), _unsigned(group["lo"].combine_chunks())
        n = group["n"].to_numpy()
        perfect = PerfectHash.of(lo, hi)
        slot = perfect.slots(lo, hi)
        marks, counts = np.zeros(perfect.size, "<u4"), np.zeros(perfect.size, "<u4")
        marks[slot] = (hi >> np.uint64(32)).astype("<u4")
        counts[slot] = np.minimum(n, 2**32 - 1)
        return pa.table(
            {
                "shard": group["shard"].slice(0, 1),
                "perfect": pa.array([perfect.pack()], pa.binary()),
                "marks": pa.array([marks.tobytes()], pa.binary()),
                "counts": pa.array([counts.tobytes()], pa.binary()),
            }
        )

    dealt = counts.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(run, "shard int, perfect binary, marks binary, counts binary")


class _Arrays:
    """One shard's arrays, as a task holds them."""

    def __init__(self, perfect: bytes, marks: bytes, counts: bytes):
        self.perfect = PerfectHash.unpack(perfect)
        self.marks, self.counts = np.frombuffer(marks, "<u4"), np.frombuffer(counts, "<u4")

    def frequency(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        slot = self.perfect.slots(lo, hi)
        known = slot >= 0
        known &= self.marks[slot] == (hi >> np.uint64(32))
        return np.where(known, self.counts[slot], 0)


def _probe(lines: DataFrame, arrays: DataFrame, shards: int, copies: int, least: int) -> DataFrame:
    """(doc, hi, lo) for each distinct line of a document that at least `least` documents have."""
    none = [F.lit(None).cast("binary").alias(c) for c in ("perfect", "marks", "counts")]
    probes = lines.select(
        F.pmod("hi", F.lit(shards)).cast("int").alias("shard"),
        F.pmod(F.xxhash64("docs"), F.lit(copies)).cast("int").alias("copy"),
        F.lit(1).alias("kind"), "hi", "lo", "docs", *none,
    )
    held = arrays.select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"),
        F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("hi"),
        F.lit(None).cast("long").alias("lo"),
        F.lit(None).cast("binary").alias("docs"),
        "perfect", "marks", "counts",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Arrays | None = None
        at = (-1, -1)
        for batch in batches:
            shard, copy, kind = (batch.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (copy[1:] != copy[:-1]) | (kind[1:] != kind[:-1])])
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if kind[start] == 0:
                    own = _Arrays(*(batch.column(i)[start].as_py() for i in (6, 7, 8)))
                    at = (shard[start], copy[start])
                    continue
                assert own is not None and at == (shard[start], copy[start])
                part = batch.slice(start, end - start)
                hi, lo = _unsigned(part.column(3)), _unsigned(part.column(4))
                often = np.flatnonzero(own.frequency(hi, lo) >= least)
                if not len(often):
                    continue
                docs = [np.frombuffer(x, "<i8") for x in part.column(5).take(pa.array(often)).to_pylist()]
                times = [len(x) for x in docs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(docs)), _signed(np.repeat(hi[often], times)), _signed(np.repeat(lo[often], times))],
                    ["doc", "hi", "lo"],
                )

    # two columns and no count: what shares (shard, copy) shares a partition, array row first
    together = held.union(probes).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    return together.mapInArrow(run, "doc long, hi long, lo long")


SCHEMA = "n_lines long, n_dropped long, kept_sha256 string, kept_text string"


def drop_shared_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_documents: int = 10,
    least_length: int = 1,
    shard_keys: int = 500_000,
    copies: int = 4,
    keep: list[str] | None = None,
    with_text: bool = True,
) -> DataFrame:
    """The columns `keep` of `docs` (all), the text without shared lines, and what was dropped.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least
    `least_length` code points in at least `least_documents` rows of `docs` lose all their
    lines everywhere. Adds n_lines, n_dropped, kept_sha256 and kept_text. A null or empty
    text is one empty line. Without `with_text` kept_text is null. Repeated rows count as documents of their own; rows with the
    same or no key value are served alike, since what is dropped depends on the line only.
    Columns of `docs` named like an added one are replaced.

    `shard_keys`: distinct lines in a shard, on average; `copies`: of each shard's arrays.
    """
    added = {f.split()[0] for f in SCHEMA.split(", ")}
    kept_columns = [c for c in (docs.columns if keep is None else keep) if c not in added]
    # any key type; rows that share the name have the same lines, and are served together
    name = F.xxhash64(F.col(key), text_column(text)).alias("_doc")
    lines = stored(_document_lines(docs.select(name, text_column(text).alias("_text")), least_length), "lines")
    counts = lines.groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    shards = max(1, -(-lines.count() // shard_keys))
    frequent = _probe(lines, _build(counts, shards), shards, copies, least_documents)
    # per document its frequent lines, no more than it has lines
    per_doc = frequent.groupBy("doc").agg(F.collect_set(F.struct("hi", "lo")).alias("_drop"))
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept_columns]
    joined = docs.select(*[F.col(f"`{c}`") for c in kept_columns], text_column(text).alias("_text"), name).join(per_doc, F.col("_doc") == F.col("doc"), "left")
    wanted = [F.col(f"`{c}`") for c in kept_columns]
    return _without(joined.select(*wanted, F.col("_text"), "_drop"), kept_columns, kinds, with_text)


def _without(joined: DataFrame, columns: list[str], kinds: list[str], with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            n_lines, n_dropped, digest, kept = [], [], [], []
            texts, drops = as_bytes(batch.column(len(columns))), batch.column(len(columns) + 1)
            for row, value in enumerate(texts):
                lines = (value or b"").split(b"\n")
                n_lines.append(len(lines))
                if drops[row].is_valid:
                    unwanted = {(x["hi"], x["lo"]) for x in drops[row].as_py()}
                    left = [x for x in lines if _signed_hash(line_key(x)) not in unwanted]
                else:
                    left = lines
                n_dropped.append(len(lines) - len(left))
                rest = b"\n".join(left)
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode() if with_text else None)
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "n_lines", "n_dropped", "kept_sha256", "kept_text"])

    return joined.mapInArrow(run, ", ".join([*kinds, SCHEMA]))


def _signed_hash(key: bytes) -> tuple[int, int]:
    hi, lo = _hash(key)
    return hi - (hi >> 63 << 64), lo - (lo >> 63 << 64)
