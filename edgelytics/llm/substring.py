"""Passages that occur more than once, found by doubling the length of candidate windows.

A window is `window` consecutive words. At the first level only short word sequences are
compared: of each window its least one by hash, so equal windows pick the same one. Where
that sequence occurs once, the window cannot repeat; the others are judged again at twice
the length, and so on, until the length is the window itself or no candidate survives.

A level is one shuffle. A task packs its sequences into one row per target partition;
sequences that repeat inside a batch are decided there and go on once, so a passage that
a third of all documents share sends one entry per batch. What survives is kept per text
as runs of window starts. Texts are named by their 64-bit hash: exact copies share it,
and with it their result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelytics.llm.common import as_bytes, slices, stored, text_column

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_BASE2 = np.uint64(0xD6E8FEB86659FD93)
_PART_BYTES = 32 << 20  # text per partition of a level


def level_lengths(window: int, first: int) -> list[int]:
    lengths = [min(first, window)]
    while lengths[-1] < window:
        lengths.append(min(2 * lengths[-1], window))
    return lengths


# Hashes of word sequences


class _Powers:
    """Powers of an odd base and of its inverse, grown as texts need them."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 2**64))
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                size = max(n, 2 * len(self.up))
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.base)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.inverse)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers(_BASE), _Powers(_BASE2)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sequence_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of the `length` words from each place on."""
    n = len(words)
    if n < length:
        return np.empty(0, np.uint64)
    up, down = _POWERS[which].get(n)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_finished(words) * up, dtype=np.uint64)])
        return _finished((total[length:] - total[:-length]) * down[: n - length + 1])


def chosen(words: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the place of its least sequence, and the hashes of all sequences."""
    hashes = sequence_hashes(words, length)
    starts = len(words) - window + 1
    if starts < 1:
        return np.empty(0, np.int64), hashes
    if length == window:
        return np.arange(starts), hashes
    view = np.lib.stride_tricks.sliding_window_view(hashes, window - length + 1)
    at = np.empty(starts, np.int64)
    for k in range(0, starts, 1 << 18):
        at[k : k + (1 << 18)] = view[k : k + (1 << 18)].argmin(axis=1)
    return at + np.arange(starts), hashes


# Runs of places


def to_runs(places: np.ndarray) -> np.ndarray:
    """Sorted distinct places as rows (first, number)."""
    if not len(places):
        return np.empty((0, 2), np.int64)
    breaks = np.flatnonzero(np.diff(places) != 1) + 1
    first = places[np.r_[0, breaks]]
    return np.stack([first, np.diff(np.r_[0, breaks, len(places)])], axis=1)


def from_runs(runs: np.ndarray) -> np.ndarray:
    times = runs[:, 1]
    total = int(times.sum())
    begun = np.repeat(np.cumsum(times) - times, times)
    return np.repeat(runs[:, 0], times) + np.arange(total) - begun


def _pack_runs(places: np.ndarray) -> bytes:
    return to_runs(places).astype("<i4").tobytes()


def _places(data: bytes) -> np.ndarray:
    return from_runs(np.frombuffer(data, "<i4").reshape(-1, 2).astype(np.int64))


# One level


_PROBE, _KNOWN = 0, 1


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def _split(values: bytes, kinds: list[str]) -> list[np.ndarray]:
    data = zstandard.decompress(values)
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


_PLACE_KINDS = ["<i8", "<i4"]  # text, place
_PROBE_KINDS = ["<u8", "<u4", "<i8", "<i4", "?"]  # hash, second hash, text, place, decided already


def _candidates(texts: DataFrame, length: int, window: int, parts: int, has_runs: bool) -> DataFrame:
    """(part, kind, data): the sequences that stand for candidate windows, packed by target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            rows = _batch_sequences(batch, length, window, has_runs)
            if rows is None:
                continue
            hashes, second, keys, places, decided = rows
            out: list[tuple[int, int, bytes]] = []
            # what repeats inside the batch is decided here; one entry goes on for the others
            order = np.lexsort((second, hashes))
            sorted_h, sorted_c = hashes[order], second[order]
            new = np.r_[True, (sorted_h[1:] != sorted_h[:-1]) | (sorted_c[1:] != sorted_c[:-1])]
            group = np.cumsum(new) - 1
            often = np.bincount(group)[group] > 1
            known = np.zeros(len(hashes), bool)
            known[order[often]] = True
            known |= decided
            sent = np.zeros(len(hashes), bool)
            sent[order[new]] = True
            if known.any():
                k, p = keys[known], places[known]
                out.append((int(k[0] % parts), _KNOWN, _pack(k, p.astype("<i4"))))
            part = (hashes % np.uint64(parts)).astype(np.int64)
            pick = np.flatnonzero(sent)
            pick = pick[np.argsort(part[pick], kind="stable")]
            for start, end in _equal(part[pick]):
                at = pick[start:end]
                data = _pack(hashes[at], second[at], keys[at], places[at].astype("<i4"), known[at])
                out.append((int(part[at[0]]), _PROBE, data))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())],
                ["part", "kind", "data"],
            )

    return texts.mapInArrow(run, "part int, kind int, data binary")


def _batch_sequences(batch: pa.RecordBatch, length: int, window: int, has_runs: bool) -> tuple | None:
    times: dict[int, int] = {}
    rows: dict[int, int] = {}
    for row, key in enumerate(batch.column(0).to_pylist()):
        times[key] = times.get(key, 0) + 1
        rows.setdefault(key, row)
    texts = as_bytes(batch.column(1))
    found: list[tuple[np.ndarray, ...]] = []
    for key, row in rows.items():
        words = (texts[row] or b"").split()
        if len(words) < window:
            continue
        numbers = word_hashes(words)
        places, hashes = chosen(numbers, length, window)
        if has_runs:
            places = places[_places(batch.column(2)[row].as_py())]
        places = np.unique(places)
        second = (sequence_hashes(numbers, length, 1)[places] >> np.uint64(32)).astype("<u4")
        decided = np.full(len(places), times[key] > 1)
        found.append((hashes[places], second, np.full(len(places), key, "<i8"), places, decided))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else None


def _repeated(packed: DataFrame, parts: int) -> DataFrame:
    """(part, data): the sequences that occur more than once, packed anew by their text's partition."""

    def run(group: pa.Table) -> pa.Table:
        probes, known = [], []
        for kind, data in zip(group["kind"].to_pylist(), group["data"].to_pylist(), strict=True):
            (known if kind == _KNOWN else probes).append(data)
        keys, places = [np.empty(0, "<i8")], [np.empty(0, "<i4")]
        for data in known:
            k, p = _split(data, _PLACE_KINDS)
            keys.append(k)
            places.append(p)
        if probes:
            hashes, second, k, p, done = (np.concatenate(x) for x in zip(*(_split(d, _PROBE_KINDS) for d in probes), strict=True))
            order = np.lexsort((second, hashes))
            new = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (second[order][1:] != second[order][:-1])]
            group_of = np.cumsum(new) - 1
            often = (np.bincount(group_of)[group_of] > 1) & ~done[order]  # decided ones are among the known
            keys.append(k[order[often]])
            places.append(p[order[often]])
        key, place = _distinct(np.concatenate(keys), np.concatenate(places))
        part = key % parts
        order = np.argsort(part, kind="stable")
        rows = []
        for start, end in _equal(part[order]):
            at = order[start:end]
            rows.append({"part": int(part[at[0]]), "data": _pack(key[at], place[at])})
        return pa.Table.from_pylist(rows, pa.schema([("part", pa.int32()), ("data", pa.binary())]))

    return packed.groupBy("part").applyInArrow(run, "part int, data binary")


def _equal(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(values):
        return []
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist()
    return list(zip(starts, [*starts[1:], len(values)], strict=True))


def _distinct(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs once each, sorted."""
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])] if len(key) else np.empty(0, bool)
    return key[new], place[new]


def _by_text(packed: DataFrame) -> DataFrame:
    """(key, places): one row per text, its places as runs. Each text has its places once
    from each partition, so what meets here is bounded by the texts, not by their copies."""

    def run(group: pa.Table) -> pa.Table:
        found = [_split(data, _PLACE_KINDS) for data in group["data"].to_pylist()]
        key, place = _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
        texts = _equal(key)
        data = [_pack_runs(place[a:b].astype(np.int64)) for a, b in texts]
        return pa.table({"key": pa.array([key[a] for a, _ in texts], pa.int64()), "places": pa.array(data, pa.binary())})

    return packed.groupBy("part").applyInArrow(run, "key long, places binary")


def _windows(survivors: DataFrame, texts: DataFrame, length: int, window: int) -> DataFrame:
    """The windows of `texts` whose chosen sequence of `length` words is among the survivors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            out = []
            for row, text in enumerate(as_bytes(batch.column(1))):
                places, _ = chosen(word_hashes((text or b"").split()), length, window)
                good = np.zeros(len(places) + window, bool)
                good[_places(batch.column(2)[row].as_py())] = True
                out.append(_pack_runs(np.flatnonzero(good[places])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["key", "_text", "runs"])

    return texts.join(survivors, "key").select("key", "_text", "places").mapInArrow(run, "key long, _text string, runs binary")


def repeated_windows(texts: DataFrame, window: int, first: int) -> DataFrame:
    """(key, places): per text the starts of windows that start anywhere else too.

    `texts` has key, the hash of the text, and _text; copies are rows with the same key.
    """
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = 1 + size // _PART_BYTES
    survivors = None
    for level, length in enumerate(lengths := level_lengths(window, first)):
        source = texts if survivors is None else _windows(survivors, texts, lengths[level - 1], window)
        packed = _candidates(source, length, window, parts, survivors is not None)
        survivors = stored(_by_text(_repeated(packed, parts)), f"repeats-{length}")
        if survivors.isEmpty():
            break
    return survivors


SCHEMA = "n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,words:int>>, kept_text string"


def drop_repeated_passages(
    docs: DataFrame,
    text: str = "text",
    window: int = 35,
    first: int = 18,
    keep: list[str] | None = None,
    with_text: bool = True,
) -> DataFrame:
    """The columns `keep` of `docs` (all), without each word that a repeated window covers.

    Adds n_words, n_removed, kept_sha256, spans (the removed stretches, as first word and
    number) and kept_text: the kept words joined by one space, null unless `with_text`.
    Windows that overlap inside one document count as repeats of each other; all are judged
    on the input. A null text has no words; texts shorter than a window keep all of them.
    Repeated rows are copies, so each loses its windows. Columns named like an added one
    are replaced.
    """
    added = {"n_words", "n_removed", "kept_sha256", "spans", "kept_text"}
    columns = [c for c in (docs.columns if keep is None else keep) if c not in added]
    whole = F.coalesce(text_column(text), F.lit(""))
    key = F.xxhash64(whole)
    texts = docs.select(key.alias("key"), whole.alias("_text"))
    repeats = repeated_windows(texts, window, first)
    wanted = [F.col(f"`{c}`") for c in columns]
    joined = docs.select(*wanted, whole.alias("_text"), key.alias("_key")).join(
        repeats.withColumnRenamed("key", "_key"), "_key", "left"
    )
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            out: dict[str, list] = {name: [] for name in ("n", "gone", "digest", "spans", "kept")}
            found = batch.column(len(columns) + 1)
            for row, value in enumerate(as_bytes(batch.column(len(columns)))):
                words, spans = value.split(), []
                left = words
                if found[row].is_valid:
                    covered = np.zeros(len(words) + 1, np.int64)
                    runs = np.frombuffer(found[row].as_py(), "<i4").reshape(-1, 2)
                    np.add.at(covered, runs[:, 0], 1)
                    np.add.at(covered, runs[:, 0] + runs[:, 1] - 1 + window, -1)
                    gone = np.cumsum(covered[:-1]) > 0
                    left = [words[i] for i in np.flatnonzero(~gone).tolist()]
                    spans = [{"first": a, "words": n} for a, n in to_runs(np.flatnonzero(gone)).tolist()]
                rest = b" ".join(left)
                out["n"].append(len(words))
                out["gone"].append(len(words) - len(left))
                out["digest"].append(hashlib.sha256(rest).hexdigest())
                out["spans"].append(spans)
                out["kept"].append(rest.decode() if with_text else None)
            arrays = [batch.column(i) for i in range(len(columns))]
            kinds_of = [pa.int64(), pa.int64(), pa.string(), spans_type, pa.string()]
            arrays += [pa.array(v, k) for v, k in zip(out.values(), kinds_of, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    return joined.select(*wanted, "_text", "places").mapInArrow(run, ", ".join([*kinds, SCHEMA]))
