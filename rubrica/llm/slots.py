"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots; bytes are summed per slot; a versioned
map says which shard holds each slot.  Rebalancing edits the map: it moves slots, never
single records.  The map has one row a slot, whatever the size of the data.

Defined cases: null text has no bytes; a null id is spread by its text and place in the
input; repeated rows are rows of their own; an empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm.ranks import numbered, offsets
from rubrica.llm.shared import crc_of, cut_lineage, text_or_empty

SLOTS = 16_384
ROW_BYTES = 16


@dataclass
class SlotMap:
    """Which shard holds each slot; ``version`` grows by one with every edit."""

    shards: int
    shard_of: list[int]
    version: int = 0
    moved: list[tuple[int, int, int]] = field(default_factory=list)

    @classmethod
    def even(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(shards, [s % shards for s in range(slots)])

    def rebalanced(self, slot_bytes: dict[int, int], shards: int | None = None) -> SlotMap:
        """Edit the map: slots leave shards above the mean for the emptiest ones.

        A slot stays where it is while its shard has room below the mean; the rest, largest
        first, go to the shard with the fewest bytes.  Then single slots move from the
        fullest to the emptiest shard while that brings the two closer.
        """
        shards = shards or self.shards
        total = sum(slot_bytes.values())
        load = [0] * shards
        shard_of = list(self.shard_of)
        free = []
        for slot in sorted(range(len(shard_of)), key=lambda s: (-slot_bytes.get(s, 0), s)):
            size, at = slot_bytes.get(slot, 0), shard_of[slot]
            if at < shards and (load[at] + size) * shards <= total:
                load[at] += size
            else:
                free.append(slot)
        heap = [(n, s) for s, n in enumerate(load)]
        heapq.heapify(heap)
        for slot in free:
            size, (n, shard) = slot_bytes.get(slot, 0), heap[0]
            if size == 0 and shard_of[slot] < shards:
                continue
            heapq.heapreplace(heap, (n + size, shard))
            load[shard] += size
            shard_of[slot] = shard
        members: dict[int, list[int]] = {}
        for slot, shard in enumerate(shard_of):
            members.setdefault(shard, []).append(slot)
        for _ in range(4 * shards):
            low, high = min(range(shards), key=load.__getitem__), max(range(shards), key=load.__getitem__)
            gap = load[high] - load[low]
            fit = [s for s in members.get(high, []) if 0 < slot_bytes.get(s, 0) < gap]
            if not fit:
                break
            slot = min(fit, key=lambda s: (abs(gap - 2 * slot_bytes[s]), s))
            members[high].remove(slot)
            members.setdefault(low, []).append(slot)
            load[high] -= slot_bytes[slot]
            load[low] += slot_bytes[slot]
            shard_of[slot] = low
        moved = [(s, a, b) for s, (a, b) in enumerate(zip(self.shard_of, shard_of)) if a != b]
        return SlotMap(shards, shard_of, self.version + 1, moved)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, s, shard) for s, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, vslot int, shard int")

    def store(self, spark: SparkSession, folder: str) -> None:
        """Write this version beside the earlier ones; a version that is there is replaced by itself."""
        self.frame(spark).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """A stored version, by default the newest."""
        stored = spark.read.parquet(folder)
        if version is None:
            version = stored.agg(F.max("version")).first()[0]
        rows = stored.filter(F.col("version") == version).orderBy("vslot").collect()
        if not rows:
            raise ValueError(f"no version {version} in {folder}")
        return cls(rows[0]["shards"], [r["shard"] for r in rows], int(version))


def sized_records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of every record."""
    text = F.col(text_col)
    place = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    crc = crc_of(text_or_empty(text_col))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col).cast("long"), crc, place), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes of every slot: at most as many rows as there are slots."""
    return {r["vslot"]: r["n"] for r in records.groupBy("vslot").agg(F.sum("size").alias("n")).collect()}


def assign_shards(
    docs: DataFrame,
    shards: int,
    slots: int = SLOTS,
    current: SlotMap | None = None,
    map_folder: str | None = None,
) -> tuple[DataFrame, SlotMap]:
    """Records with shard and gapless place in it, and the map they follow.

    Starts from ``current`` (or the even map) and rebalances it by the bytes found; with
    ``map_folder`` both versions are stored there.
    """
    spark = docs.sparkSession
    records = cut_lineage(sized_records(docs, slots))
    before = current or SlotMap.even(shards, slots)
    after = before.rebalanced(slot_bytes(records), shards)
    if map_folder:
        before.store(spark, map_folder)
        after.store(spark, map_folder)
    slot_map = after.frame(spark).select("vslot", "shard")
    placed = records.join(F.broadcast(slot_map), "vslot")
    rows, counts = numbered(placed, "shard", ["vslot", "doc_id", "text_crc32", "size"])
    starts = spark.createDataFrame(
        [(p, k, n) for (p, k), n in offsets(counts).items()], "part int, shard long, start long"
    )
    out = rows.join(F.broadcast(starts), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", "vslot", F.col("shard").cast("int"), (F.col("start") + F.col("place")).alias("slot")
    )
    return out, after
