"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots (thousands, whatever the number of shards). The bytes of each
slot are summed, and a versioned map, kept as a table in the shared folder, says which shard holds which slot. The map is
all that the driver handles: its length is the number of slots, not of records. Where the latest version is still even
enough for the bytes counted now, it is used as it is; otherwise it is edited and stored as the next version: an overfull
shard gives slots away, or exchanges them for smaller ones, as few as it can, and a new shard takes slots and nothing else
moves. Records are placed by what the stored version says.

Law ``bytes``: shards hold nearly equal sums of record sizes. Defined results: a null text counts as empty (size 16,
crc 0); records are hashed by key and text, so that a key of many records spreads over slots; repeated rows are numbered
like any others; rows equal in both share a virtual slot, but not the task that numbers them: each is numbered with those
of its lane, the task that first read it; an empty table gives an empty result; columns named like a result are
replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch
from .common import table, written

N_SLOTS = 4096
RECORD_OVERHEAD = 16
#: Gap between the fullest and the emptiest shard beyond which a map is edited, as a share of a shard's mean.
TOLERANCE = 0.002
#: Records of a virtual slot that one task numbers.
PART_ROWS = 250_000
MAP_DDL = "version int, n_shards int, slot int, shard int"


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot, at a version."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def balanced(cls, n_slots: int, n_shards: int, slot_bytes: dict[int, int]) -> SlotMap:
        """Largest slot first, each to the shard with the fewest bytes, then the fewest slots."""
        heap = [(0, 0, s) for s in range(n_shards)]
        shard_of = [0] * n_slots
        for slot in sorted(range(n_slots), key=lambda x: (-slot_bytes.get(x, 0), x)):
            held, count, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (held + slot_bytes.get(slot, 0), count + 1, shard))
        return cls(1, n_shards, tuple(shard_of))

    def _loads(self, slot_bytes: dict[int, int], n_shards: int) -> tuple[list[int], list[list[int]]]:
        held: list[int] = [0] * n_shards
        slots: list[list[int]] = [[] for _ in range(n_shards)]
        for slot, shard in enumerate(self.shard_of):
            held[shard] += slot_bytes.get(slot, 0)
            slots[shard].append(slot)
        for own in slots:
            own.sort(key=lambda x: (slot_bytes.get(x, 0), -x))
        return held, slots

    def grown(self, slot_bytes: dict[int, int]) -> SlotMap:
        """One more shard: it takes slots from the fullest shards until it has its share; no other slot moves."""
        held, slots = self._loads(slot_bytes, self.n_shards + 1)
        new, share, shard_of = self.n_shards, sum(held) / (self.n_shards + 1), list(self.shard_of)
        while held[new] < share:
            giver = max(range(new), key=lambda s: (held[s], -s))
            room = share - held[new]
            slot = next((x for x in reversed(slots[giver]) if 0 < slot_bytes.get(x, 0) <= room), None)
            if slot is None or held[giver] <= share:
                break
            slots[giver].remove(slot)
            shard_of[slot] = new
            held[giver] -= slot_bytes[slot]
            held[new] += slot_bytes[slot]
        return SlotMap(self.version + 1, self.n_shards + 1, tuple(shard_of))

    def rebalanced(self, slot_bytes: dict[int, int], tolerance: float = 0.02) -> SlotMap:
        """Moves slots from the fullest to the emptiest shard while that narrows a gap beyond the tolerance."""
        held, slots = self._loads(slot_bytes, self.n_shards)
        shard_of, share = list(self.shard_of), sum(held) / self.n_shards
        of = lambda x: slot_bytes.get(x, 0)
        for _ in range(len(shard_of)):
            full = max(range(self.n_shards), key=lambda s: (held[s], -s))
            empty = min(range(self.n_shards), key=lambda s: (held[s], s))
            gap = held[full] - held[empty]
            if gap <= tolerance * share:
                break
            # One slot, or one in exchange for a smaller one, that brings both as near to their mean as can be.
            small = [(0, None), *((of(y), y) for y in slots[empty])]
            sizes = [b for b, _ in small]
            best = None
            for x in slots[full]:
                k = bisect.bisect_left(sizes, of(x) - gap / 2)
                for b, y in small[max(k - 1, 0) : k + 1]:
                    moved = of(x) - b
                    if 0 < moved < gap and (best is None or abs(gap - 2 * moved) < best[0]):
                        best = (abs(gap - 2 * moved), x, y)
            if best is None:
                break
            for slot, old, new in ((best[1], full, empty), (best[2], empty, full)):
                if slot is not None:
                    slots[old].remove(slot)
                    bisect.insort(slots[new], slot, key=lambda x: (of(x), -x))
                    shard_of[slot] = new
                    held[old] -= of(slot)
                    held[new] += of(slot)
        return SlotMap(self.version + 1, self.n_shards, tuple(shard_of))

    def uneven(self, slot_bytes: dict[int, int]) -> float:
        """The gap between the fullest and the emptiest shard, as a share of a shard's mean."""
        held, _ = self._loads(slot_bytes, self.n_shards)
        return (max(held) - min(held)) * self.n_shards / (sum(held) or 1)

    def rows(self) -> list[tuple[int, int, int, int]]:
        return [(self.version, self.n_shards, slot, shard) for slot, shard in enumerate(self.shard_of)]

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the map's table. A version is written once: if it is there, or another writer was faster, this
        is an error. It is written beside the table and moved there as a whole, so readers never see half a version."""
        jvm = spark.sparkContext._jvm
        at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        own, staging = at(f"version={self.version}"), at(f"_staging-{uuid.uuid4().hex}")
        files = own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if files.exists(own):
            raise FileExistsError(f"version {self.version} of {path}")
        spark.createDataFrame(self.rows(), MAP_DDL).drop("version").coalesce(1).write.parquet(staging.toString())
        # A folder that appeared meanwhile would take this one in, under a name that readers pass over.
        if not files.rename(staging, own) or SlotMap.load(spark, path, self.version) != self:
            raise FileExistsError(f"version {self.version} of {path}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version of the map, by default the latest."""
        rows = spark.read.schema(MAP_DDL).parquet(path)
        version = version if version is not None else rows.agg(F.max("version")).first()[0]
        found = rows.where(F.col("version") == version).orderBy("slot").collect()
        return cls(version, found[0].n_shards, tuple(r.shard for r in found))


    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The latest version, or None where there is no map yet."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
        latest = spark.read.schema(MAP_DDL).parquet(path).agg(F.max("version")).first()[0] if there else None
        return None if latest is None else cls.load(spark, path, latest)


def hashed(records: DataFrame, key: str, text: str, n_slots: int = N_SLOTS) -> DataFrame:
    """Adds ``size``, ``text_crc32``, ``virtual_slot`` and ``__lane``, which is to be written before records are numbered."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        records.withColumn("size", (F.octet_length(whole) + RECORD_OVERHEAD).cast("long"))
        .withColumn("text_crc32", F.crc32(whole.cast("binary")))
        .withColumn("virtual_slot", F.pmod(F.xxhash64(F.col(key), whole), F.lit(n_slots)).cast("int"))
        .withColumn("__lane", F.spark_partition_id())
    )


def slot_bytes_of(slotted: DataFrame) -> dict[int, int]:
    """Bytes of each virtual slot: at most as many rows as there are slots."""
    return {r.virtual_slot: r.b for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect()}


def current_map(spark: SparkSession, folder: str, n_shards: int, slot_bytes: dict[int, int], n_slots: int = N_SLOTS, tolerance: float = TOLERANCE) -> SlotMap:
    """The stored map in ``folder``, after it was made or edited for these bytes where that is needed.

    An edit is stored as the next version only if it makes shards more even. A folder with a map of fewer shards gets its
    map grown one shard after the other.
    """
    found = SlotMap.stored(spark, folder)
    if found is None:
        SlotMap.balanced(n_slots, n_shards, slot_bytes).save(spark, folder)
        return SlotMap.load(spark, folder)
    if found.n_shards > n_shards or len(found.shard_of) != n_slots:
        raise ValueError("the stored map has more shards, or other slots")
    while found.n_shards < n_shards:
        found = found.grown(slot_bytes)
        found.save(spark, folder)
    if found.uneven(slot_bytes) > tolerance:
        edited = found.rebalanced(slot_bytes, tolerance)
        if edited.uneven(slot_bytes) < found.uneven(slot_bytes):
            edited.save(spark, folder)
    return SlotMap.load(spark, folder)


def sharded(slotted: DataFrame, slot_map: SlotMap, order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Adds ``shard`` and ``slot``, the place of a record in its shard (gapless from 0).

    Records are numbered inside parts of their virtual slot, of some ``part_rows`` records each; the parts of a slot and
    the slots of a shard follow each other, so no task sees a whole shard, and only the map comes from the driver. Records
    are dealt to parts by their ``order`` columns and their ``__lane``, where there is one. Columns of these names are replaced.
    """
    spark = slotted.sparkSession
    slotted = slotted.drop("shard", "slot", "base", "__part", "__n")
    parts = max(1, -(-slotted.count() // (len(slot_map.shard_of) * part_rows)))
    lane = ["__lane"] if "__lane" in slotted.columns else []
    slotted = slotted.withColumn("__part", F.pmod(F.xxhash64(*order, *lane, F.lit(parts)), F.lit(parts)).cast("int"))
    counts = slotted.groupBy("virtual_slot", "__part").agg(F.count(F.lit(1)).alias("__n"))
    slots = spark.createDataFrame([(slot, shard) for _, _, slot, shard in slot_map.rows()], "virtual_slot int, shard int")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "__part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.join(F.broadcast(slots), "virtual_slot").select("virtual_slot", "__part", "shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("virtual_slot", "__part").orderBy(*order)
    numbered = slotted.withColumn("__n", F.row_number().over(own) - 1)
    return numbered.join(places, ["virtual_slot", "__part"]).withColumn("slot", F.col("base") + F.col("__n")).drop("base", "__n", "__part", "__lane")


def map_folder(spark: SparkSession, sf_dir: str, n_shards: int) -> str:
    """Where the map of a folder of tables lies unless another place is named: in the shared folder, for all applications."""
    return f"{scratch.shared_dir(spark)}/slot-maps/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}-{n_shards}"


def op6_sharding(spark: SparkSession, sf_dir: str, n_shards: int = 40, folder: str | None = None) -> DataFrame:
    """folder: of the map, by default ``map_folder``; a later run, of any application, finds it there and edits it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    slotted = written(hashed(docs, "doc_id", "text").drop("text"), "slotted")
    slot_map = current_map(spark, folder or map_folder(spark, sf_dir, n_shards), n_shards, slot_bytes_of(slotted))
    return sharded(slotted, slot_map, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version")
    )
