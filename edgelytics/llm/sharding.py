"""Sharding through fixed virtual slots, with DataFrame functions only.

Records hash into a fixed number of slots; bytes are summed per slot; a versioned table
says which shard owns a slot. Rebalancing edits that table and appends the edit as a new
version: slots move, records are never hashed anew. The table has `slots` rows whatever
the number of records, so it is planned in the driver and broadcast.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from edgelytics.llm.common import stored

SLOTS = 4096
#: Parts that the copies of one row are dealt in: sixteen to each slot, so that slots stay even.
COPY_PARTS = 65_536
MAP = T.StructType(
    [
        T.StructField("version", T.IntegerType(), False),
        T.StructField("vslot", T.IntegerType(), False),
        T.StructField("shard", T.IntegerType(), False),
    ]
)


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes of the text plus 1; a null text has none."""
    return (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 1).cast("long")


def crc_of(text: str = "text") -> Column:
    """The unsigned CRC-32 of the UTF-8 text; 0 for a null or empty one."""
    return F.coalesce(F.crc32(F.col(text).cast("string").cast("binary")), F.lit(0)).cast("long")


def virtual_slot(*keys: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """Records and bytes per slot in use; `slots` rows at most, combined before the shuffle."""
    bytes_held = F.sum(F.col("size") * F.col("copies"))
    return records.groupBy("vslot").agg(F.sum("copies").alias("records"), bytes_held.alias("bytes"))


def even_map(shards: int, slots: int = SLOTS) -> list[tuple[int, int]]:
    """Version 0: slots dealt to shards in turn, before anything is known of their sizes."""
    return [(slot, slot % shards) for slot in range(slots)]


def rebalanced(owner: list[tuple[int, int]], weight: dict[int, int], shards: int) -> list[tuple[int, int]]:
    """The edited map: slots leave the shard with the most bytes for the one with the least.

    Each edit moves the largest slot that lowers the larger of the two shards, or, where
    none is small enough, exchanges a slot for a smaller one. Ends when the extremes
    cannot be brought closer. Bounded by the number of slots, not of records.
    """
    shard_of = dict(owner)
    held: dict[int, set[int]] = {s: set() for s in range(shards)}
    total = dict.fromkeys(range(shards), 0)
    for slot, shard in owner:
        shard_of[slot] = shard = shard % shards
        held[shard].add(slot)
        total[shard] += weight.get(slot, 0)
    # a first pass in bulk: what stands above the mean is dealt again, largest first
    mean = sum(total.values()) / shards
    loose = []
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (weight.get(s, 0), s)):
            if total[shard] <= mean:
                break
            loose.append(slot)
            held[shard].remove(slot)
            total[shard] -= weight.get(slot, 0)
    heap = [(total[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-weight.get(s, 0), s)):
        _, shard = heapq.heappop(heap)
        held[shard].add(slot)
        shard_of[slot] = shard
        total[shard] += weight.get(slot, 0)
        heapq.heappush(heap, (total[shard], shard))
    for _ in range(len(owner)):
        low = min(total, key=lambda s: (total[s], s))
        high = max(total, key=lambda s: (total[s], -s))
        gap = total[high] - total[low]
        best = None  # what the move takes from the high shard, nearest to half the gap
        give = [(weight.get(s, 0), s) for s in held[high] if weight.get(s, 0)]
        take = [(0, None)] + [(weight.get(s, 0), s) for s in held[low] if weight.get(s, 0)]
        take.sort(key=lambda x: x[0])
        for out, slot in sorted(give):
            # the smaller slot that comes back: nearest to out - gap / 2
            lo, hi = 0, len(take)
            want = out - gap / 2
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if take[mid][0] < want else (lo, mid)
            for at in (lo - 1, lo):
                if 0 <= at < len(take) and 0 < out - take[at][0] < gap:
                    key = abs(2 * (out - take[at][0]) - gap)
                    if best is None or key < best[0]:
                        best = (key, slot, take[at][1], out - take[at][0])
        if best is None:
            break
        _, slot, back, change = best
        held[high].remove(slot)
        held[low].add(slot)
        shard_of[slot] = low
        if back is not None:
            held[low].remove(back)
            held[high].add(back)
            shard_of[back] = high
        total[high] -= change
        total[low] += change
    return sorted(shard_of.items())


def grown(owner: list[tuple[int, int]], weight: dict[int, int], shards: int) -> list[tuple[int, int]]:
    """One more shard: it takes slots from the fullest shards until it holds its share;
    no slot moves between the shards there were."""
    shard_of, total = dict(owner), dict.fromkeys(range(shards + 1), 0)
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    for slot, shard in sorted(owner):
        total[shard] += weight.get(slot, 0)
        held[shard].append((weight.get(slot, 0), slot))
    share = sum(total.values()) / (shards + 1)
    for own in held.values():
        own.sort()
    heap = [(-total[s], s) for s in range(shards)]
    heapq.heapify(heap)
    while heap and total[shards] < share:
        _, high = heapq.heappop(heap)
        if not held[high]:
            continue
        size, slot = held[high].pop()
        if total[shards] + size <= share or not total[shards]:
            shard_of[slot] = shards
            total[shards] += size
            total[high] -= size
        heapq.heappush(heap, (-total[high], high))
    return sorted(shard_of.items())


def write_map(spark: SparkSession, owner: list[tuple[int, int]], version: int, path: str) -> DataFrame:
    """Store one version of the map beside the earlier ones; existing versions stay."""
    rows = [(version, slot, shard) for slot, shard in owner]
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{path}/version={version}")
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/version={version}")


def equal_records(docs: DataFrame, slots: int = SLOTS, parts: int = COPY_PARTS) -> DataFrame:
    """(doc_id, size, text_crc32, copies, vslot): the records of `docs`, rows alike in
    doc_id and text counted once each, in up to `parts` equal parts with a slot of their own.

    A slot must not weigh what one frequent row weighs, so copies beyond the first hash
    with the number of their part. The text is read once and leaves the first step.
    """
    text = F.col("text").cast("string")
    read = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        size_of().alias("size"),
        crc_of().alias("text_crc32"),
        F.xxhash64("text").alias("_h1"),
        F.xxhash64(F.concat("text", F.lit("\x01"))).alias("_h2"),
    )
    named = ["doc_id", "size", "text_crc32", "_h1", "_h2"]
    alike = read.groupBy(*named).agg(F.count(F.lit(1)).alias("_n"))
    each = F.expr(f"greatest(1, ceil(_n / {parts}))").cast("long")
    split = alike.withColumn("_each", each).select(
        "*", F.explode(F.expr("sequence(0L, (_n - 1) div _each)")).alias("_part")
    )
    return split.select(
        "doc_id", "size", "text_crc32",
        F.least("_each", F.col("_n") - F.col("_part") * F.col("_each")).alias("copies"),
        virtual_slot("doc_id", "_h1", "_h2", "_part", slots=slots).alias("vslot"),
    )


def place_records(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """`equal_records` with `shard` and `slot`, a gapless place in the shard, one row per copy.

    A place is the records in the shard's earlier slots plus those before it in its own
    slot, so no task sorts a whole shard, and copies are written out last. Both tables that
    are joined have one row per slot.
    """
    counts = slot_bytes(records).join(F.broadcast(slot_map), "vslot")
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("vslot", "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("_start"))
    own = W.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32", "copies").rowsBetween(W.unboundedPreceding, -1)
    placed = records.withColumn("_before", F.coalesce(F.sum("copies").over(own), F.lit(0))).join(F.broadcast(starts), "vslot")
    first = F.col("_start") + F.col("_before")
    copy = F.explode(F.expr("sequence(0L, copies - 1)")).alias("_copy")
    return placed.select("doc_id", "size", "text_crc32", "vslot", "shard", first.alias("_first"), copy).select(
        "doc_id", "size", "text_crc32", "vslot", "shard", (F.col("_first") + F.col("_copy")).cast("long").alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """Documents dealt to `shards` shards of near equal bytes by way of a stored slot map.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under
    this law) and vslot. Version 0 of the map under `path` is the even one, version 1 the
    one edited for the bytes of these documents. A record hashes by doc_id and text, so
    null or repeated ids spread; rows alike in both are told apart by number and spread
    too, whatever their share of all rows. An empty table gives no rows, a null text counts
    as none. Of the input only doc_id and text are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    records = stored(equal_records(docs, slots), "records")
    weight = {r["vslot"]: int(r["bytes"]) for r in slot_bytes(records).collect()}  # `slots` rows at most
    first = even_map(shards, slots)
    write_map(spark, first, 0, path)
    current = write_map(spark, rebalanced(first, weight, shards), 1, path)
    placed = place_records(records, current.select("vslot", "shard"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )
