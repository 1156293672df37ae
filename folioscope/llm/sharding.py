"""Sharding by fixed virtual slots: records hash into thousands of slots, bytes are summed per slot, and a versioned
table says which shard holds which slot. Rebalancing edits that table; records are never hashed anew.

Law: ``bytes``. Slots go to shards largest first, each to the lightest shard, so shard sizes differ by about the size of
one of the lightest slots, unless one slot alone outweighs a fair share. The number of slots is a parameter, so the map
and the sums per slot are bounded whatever the input; they are all the driver sees and all that is broadcast.

Null text weighs as an empty one. A record without a key hashes by its text. Records with one key share a slot. Ties in
size go to the smaller slot and the smaller shard. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioscope.llm.store import materialize, table
from folioscope.session import run_dir

SLOTS = 8_192
SHARDS = 24
RECORD_BYTES = 8
MAP_SCHEMA = "slot int, shard int, bytes long, rows long"

SlotMap = list[tuple[int, int, int, int]]


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, checksum and slot of every record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64("doc_id"))
    return docs.select(
        "doc_id", (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"), F.crc32(text).alias("text_crc32"),
        F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) for each of the ``slots`` slots, empty ones too."""
    found = records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    known = {r.virtual_slot: (r.b, r.n) for r in found}
    return [(s, *known.get(s, (0, 0))) for s in range(slots)]


def first_map(sizes: Iterable[tuple[int, int, int]], shards: int) -> SlotMap:
    """Largest slot first, each to the shard with the fewest bytes so far; empty slots are dealt evenly."""
    load = [(0, 0, k) for k in range(shards)]
    placed = []
    for slot, size, rows in sorted(sizes, key=lambda s: (-s[1], s[0])):
        used, held, shard = heapq.heappop(load)
        placed.append((slot, shard, size, rows))
        heapq.heappush(load, (used + size, held + 1, shard))
    return sorted(placed)


def rebalanced(old: SlotMap, sizes: Iterable[tuple[int, int, int]], shards: int, tolerance: float = 0.05) -> SlotMap:
    """The map edited for new sizes or another number of shards; only slots that must move change their shard.

    Slots of shards that no longer exist are placed first. Then the heaviest shard gives the lightest one its largest
    slot that fits into half of their difference, until they differ by no more than ``tolerance`` of a fair share.
    """
    now = {slot: (size, rows) for slot, size, rows in sizes}
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard, *_ in old:
        (held[shard] if shard < shards else homeless).append((now.get(slot, (0, 0))[0], slot))
    load = [sum(b for b, _ in h) for h in held]
    for size, slot in sorted(homeless, key=lambda s: (-s[0], s[1])):
        k = min(range(shards), key=lambda j: (load[j], j))
        held[k].append((size, slot))
        load[k] += size
    while True:
        high, low = max(range(shards), key=lambda j: (load[j], -j)), min(range(shards), key=lambda j: (load[j], j))
        fits = [s for s in held[high] if 0 < s[0] <= (load[high] - load[low]) // 2]
        if not fits or load[high] - load[low] <= tolerance * sum(load) / shards:
            break
        size, slot = max(fits, key=lambda s: (s[0], -s[1]))
        held[high].remove((size, slot))
        held[low].append((size, slot))
        load[high] -= size
        load[low] += size
    return sorted((slot, k, *now.get(slot, (0, 0))) for k, h in enumerate(held) for _, slot in h)


def write_map(spark: SparkSession, slot_map: SlotMap, folder: str, version: int) -> None:
    """Store one version of the map; a version that exists is never replaced."""
    spark.createDataFrame(slot_map, MAP_SCHEMA).coalesce(1).write.mode("error").parquet(f"{folder.rstrip('/')}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{folder.rstrip('/')}/version={version}")


def placed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their shard and their place in it, from 0 without gaps.

    Places are counted per virtual slot and moved up by the rows of the slots before it in its shard, so that no task
    sorts a whole shard. The map is as long as there are slots and is broadcast.
    """
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    start = slot_map.select(F.col("slot").alias("virtual_slot"), "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    ranked = records.withColumn("_rank", F.row_number().over(order) - 1)
    return ranked.join(F.broadcast(start), "virtual_slot").withColumn("slot", F.col("_start") + F.col("_rank")).drop("_start", "_rank")


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = materialize(slotted(table(spark, sf_dir, "documents")), "slotted")
    folder = run_dir(spark, "slot-map")
    write_map(spark, first_map(slot_sizes(records), SHARDS), folder, 1)
    return placed(records, read_map(spark, folder, 1)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
