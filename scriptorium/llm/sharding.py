"""Sharding by fixed virtual slots.

Every record hashes into one of thousands of virtual slots by its id. Bytes and rows are summed per slot, and a small
versioned map says which shard owns which slot. The map is a table: each version is appended to it, the latest is read
back, and rebalancing edits that one and appends the next. Records keep their slot; what moves are whole
slots. Only the per-slot sums (at most ``n_slots`` rows) reach the driver.

An id whose records have more bytes, or are more, than a slot has on average would make its slot too heavy for any shard. Such heavy ids, of
which there can be no more than twice the number of slots, are part of the map, and their records alone are dealt over all slots, by id, text, and
number among equal records: a key that goes with the record, wherever it lies in the input. No other id of the slot moves, and an id stays heavy in
all later versions; one that becomes heavy as the data grow is dealt from the version on that names it.

Defined results: null text counts as no text (16 bytes); records without a doc_id share the id null, and are dealt when they are many; repeated
rows are separate records with places of their own; a very long text is
one record of its size, which no law can cut; an empty table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import numbered

N_SLOTS = 4096
OVERHEAD = 16
#: Rows of the map name a slot and its shard, or a heavy id by its hash.
MAP_SCHEMA = "version int, n_shards int, vslot int, shard int, first_place long, slot_bytes long, slot_rows long, heavy long"


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard map; bytes and rows are what the slots held when it was made."""

    version: int
    n_shards: int
    shard: dict[int, int]
    bytes: dict[int, int] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)
    heavy: frozenset[int] = frozenset()

    def load(self) -> list[int]:
        total = [0] * self.n_shards
        for slot, shard in self.shard.items():
            total[shard] += self.bytes.get(slot, 0)
        return total

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table to store: one row per slot, with the place in its shard where the slot's rows begin, and one per heavy id."""
        begin, rows = [0] * self.n_shards, []
        for slot in sorted(self.shard):
            s = self.shard[slot]
            rows.append((self.version, self.n_shards, slot, s, begin[s], self.bytes.get(slot, 0), self.rows.get(slot, 0), None))
            begin[s] += self.rows.get(slot, 0)
        rows += [(self.version, self.n_shards, None, None, None, None, None, h) for h in sorted(self.heavy)]
        return spark.createDataFrame(rows, MAP_SCHEMA)


def store(owner: SlotMap, spark: SparkSession, path: str) -> None:
    """Append a version to the table of maps."""
    owner.frame(spark).coalesce(1).write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the map from its table, the latest if none is named."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    found = table.where(F.col("version") == version).collect()  # a row for each slot and heavy id
    rows = [r for r in found if r.vslot is not None]
    heavy = frozenset(r.heavy for r in found if r.vslot is None)
    return SlotMap(version, found[0].n_shards, {r.vslot: r.shard for r in rows}, {r.vslot: r.slot_bytes for r in rows}, {r.vslot: r.slot_rows for r in rows}, heavy)


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, id_hash, text_hash) of each row; the text itself goes no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("doc_id").cast("string")).alias("id_hash"), F.xxhash64(text).alias("text_hash"),
    )


def heavy_ids(rows: DataFrame, n_slots: int = N_SLOTS) -> frozenset[int]:
    """The hashes of ids with several records that exceed a slot's mean, by bytes or by rows: at most 2 * n_slots."""
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    ids = rows.groupBy("id_hash").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    found = ids.where((F.col("bytes") * n_slots > F.lit(total.bytes or 0)) | (F.col("rows") * n_slots > F.lit(2 * total.rows)))
    return frozenset(r.id_hash for r in found.select("id_hash").collect())


def slotted(rows: DataFrame, heavy: frozenset[int], n_slots: int = N_SLOTS) -> DataFrame:
    """The records with their slot: by id, or for heavy ids by id, text and number among equals."""
    plain = F.pmod(F.col("id_hash"), F.lit(n_slots)).cast("int")
    if not heavy:
        return rows.withColumn("vslot", plain)
    names = rows.sparkSession.createDataFrame([(h,) for h in sorted(heavy)], "id_hash long")  # at most 2 * n_slots
    light = rows.join(F.broadcast(names), "id_hash", "left_anti").withColumn("vslot", plain)
    many = numbered(rows.join(F.broadcast(names), "id_hash", "left_semi"), ["id_hash", "text_hash", "size"], [], "_nth")
    dealt = many.withColumn("vslot", F.pmod(F.xxhash64("id_hash", "text_hash", "_nth"), F.lit(n_slots)).cast("int"))
    return light.select(*rows.columns, "vslot").unionByName(dealt.select(*rows.columns, "vslot"))


def slot_map(rows: DataFrame, n_shards: int, heavy: frozenset[int] = frozenset(), n_slots: int = N_SLOTS) -> SlotMap:
    """The first version, of slotted rows: the heaviest slots first, each to the shard that has the fewest bytes so far."""
    sums = {r[0]: (r[1], r[2]) for r in rows.groupBy("vslot").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    heap = [(0, shard) for shard in range(n_shards)]
    owner = {}
    for slot in sorted(range(n_slots), key=lambda s: (-sums.get(s, (0, 0))[0], s)):
        held, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (held + sums.get(slot, (0, 0))[0], shard))
    return SlotMap(1, n_shards, owner, *({s: sums.get(s, (0, 0))[k] for s in range(n_slots)} for k in (0, 1)), heavy)


def rebalance(old: SlotMap, n_shards: int | None = None, slack: float = 0.005) -> SlotMap:
    """The next version: slots move from shards over the mean to those below it, until all are within the slack, as far as whole slots can do that.

    No shard both gives and takes, and none that stays gives more than leaves it within the slack.
    """
    n = n_shards or old.n_shards
    owner, size = dict(old.shard), old.bytes
    load = [0] * max(n, old.n_shards)
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(len(load))}
    for slot, shard in owner.items():
        load[shard] += size.get(slot, 0)
        held[shard].append((size.get(slot, 0), slot))
    for slots in held.values():
        slots.sort()
    mean = sum(load) / n
    takers = [s for s in range(n) if load[s] < mean]
    givers = [s for s in range(n) if load[s] >= mean]

    def move(k: int, giver: int, taker: int) -> None:
        weight, slot = held[giver].pop(k)
        insort(held[taker], (weight, slot))
        owner[slot] = taker
        load[giver] -= weight
        load[taker] += weight

    for giver in range(n, len(load)):  # shards that are no more give all
        while held[giver]:
            move(len(held[giver]) - 1, giver, min(range(n), key=lambda s: (load[s], s)))
    moved = True
    while moved and takers:
        moved = False
        taker = min(takers, key=lambda s: (load[s], s))
        givers.sort(key=lambda s: (-load[s], s))
        if givers and (load[taker] < mean * (1 - slack) or load[givers[0]] > mean * (1 + slack)):
            # first what keeps a giver at the mean, and if that is no slot any more, what keeps it within the slack
            for least, giver in ((m, g) for m in (mean, mean * (1 - slack)) for g in givers):
                room = min(load[giver] - least, mean * (1 + slack) - load[taker])
                k = bisect_right(held[giver], (room, len(owner))) - 1
                if k >= 0 and held[giver][k][0] > 0:
                    move(k, giver, taker)
                    moved = True
                    break
    return SlotMap(old.version + 1, n, owner, old.bytes, old.rows, old.heavy)


def assign(rows: DataFrame, owner: SlotMap) -> DataFrame:
    """Each slotted record's shard and its place there; rows are numbered inside their slot, over range partitions."""
    placed = numbered(rows, ["vslot"], ["doc_id", "text_hash", "size"], "nth")
    owners = F.broadcast(owner.frame(rows.sparkSession).where("vslot is not null").select("vslot", "shard", "first_place"))  # at most n_slots rows
    return placed.join(owners, "vslot").withColumn("slot", F.col("first_place") + F.col("nth") - 1)
