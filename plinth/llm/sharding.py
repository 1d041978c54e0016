"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A document stands on the ring at the hash of its doc_id; its home is the shard of the next virtual node clockwise. A
shard takes its home documents up to its bound; those beyond go on clockwise to the next shard that still has room.
Bounds are the even shares of all rows, so the law is `rows`: shard counts differ by one at most, and only what
overflows has moved from its home.

The ring is cut into a fixed number of arcs. The driver sees the count of each arc (fixed by a parameter, not by the
corpus) and decides which ranks of an arc go to which shard; documents find their rank within their arc. Within an arc
they stand in the order of a hash of doc_id, size and checksum, so an arc that many documents share (a doc_id, or null,
that a third of all rows has) is ranked in cells, one a task, and equal rows are counted before they meet: they are one
row until their slots are dealt out, COPIES at a time. Cells change no result.

Defined cases: null text has size 1; a null doc_id has a place on the ring like any value; documents of equal doc_ids
stand on one arc; repeated rows are counted each; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm import common

SHARDS = 16
VIRTUAL_NODES = 64
ARC_BITS = 14
#: Rows of an arc that are ranked in one task, unless 1 / MOST_CELLS of all rows is more.
CELL_ROWS, MOST_CELLS = 50_000, 4096
#: Equal rows that get their slots together.
COPIES = 1 << 16


def ring(shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, arc_bits: int = ARC_BITS) -> list[tuple[int, int]]:
    """Virtual nodes as (arc, shard), clockwise."""
    return sorted((xxhash.xxh64_intdigest(f"{s}/{v}") >> 64 - arc_bits, s) for s in range(shards) for v in range(virtual_nodes))


def allot(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks of each arc go where: (arc, from rank, below rank, home, shard, first slot)."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    out, over, node = [], [], 0
    for arc in sorted(counts):
        while node < len(nodes) and nodes[node][0] < arc:
            node += 1
        home = nodes[node % len(nodes)][1]
        stay = min(counts[arc], room[home] - filled[home])
        if stay:
            out.append((arc, 0, stay, home, home, filled[home]))
            filled[home] += stay
        if stay < counts[arc]:
            over.append((arc, stay, counts[arc], home, node))
    for arc, low, high, home, node in over:
        step = node
        while low < high:
            shard = nodes[step % len(nodes)][1]
            take = min(high - low, room[shard] - filled[shard])
            if take:
                out.append((arc, low, low + take, home, shard, filled[shard]))
                filled[shard] += take
                low += take
            step += 1
    return out


def _cells(keys: DataFrame, counts: dict[int, int]) -> tuple[DataFrame, dict[int, list[tuple[int, int]]]]:
    """keys with _cell, and per arc of several cells (cell, rows) in order. An arc has a cell for every CELL_ROWS rows, or
    for every 1 / MOST_CELLS of all rows if that is more, so cells are few whatever the corpus."""
    spark = keys.sparkSession
    size = max(CELL_ROWS, sum(counts.values()) // MOST_CELLS)
    hot = [(arc, -(-n // size)) for arc, n in counts.items() if n > size]
    if not hot:
        return keys.withColumn("_cell", F.lit(0)), {}
    split = spark.createDataFrame(hot, "_arc int, _cells int")
    cell = F.shiftright(F.shiftrightunsigned("_mix", 33) * F.coalesce("_cells", F.lit(1)), 31).cast("int")
    out = keys.join(F.broadcast(split), "_arc", "left").withColumn("_cell", cell).drop("_cells")  # MOST_CELLS arcs at most
    found: dict[int, list[tuple[int, int]]] = {}
    for r in out.where(F.col("_arc").isin([a for a, _ in hot])).groupBy("_arc", "_cell").agg(F.sum("n").alias("n")).orderBy("_arc", "_cell").collect():  # 2 * MOST_CELLS rows at most
        found.setdefault(r._arc, []).append((r._cell, r.n))
    return out, found


def _by_cell(plan: list[tuple[int, int, int, int, int, int]], cells: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Ranges of allot() with ranks counted within cells: (arc, cell, from rank, below rank, home, shard, first slot)."""
    out = []
    for arc, low, high, home, shard, slot in plan:
        before = 0
        for cell, n in cells.get(arc, [(0, high)]):
            a, b = max(low, before), min(high, before + n)
            if a < b:
                out.append((arc, cell, a - before, b - before, home, shard, slot + a - low))
            before += n
    return out


def shard(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, arc_bits: int = ARC_BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, home_shard."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - arc_bits).cast("int").alias("_arc"),
    )
    keys = common.cut(rows.groupBy("_arc", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), "ring-keys").withColumn("_mix", F.xxhash64("doc_id", "size", "text_crc32"))
    arcs = keys.groupBy("_arc").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()  # 2**arc_bits rows at most
    celled, cells = _cells(keys, {r._arc: r.n for r in arcs})
    plan = _by_cell(allot({r._arc: r.n for r in arcs}, ring(shards, virtual_nodes, arc_bits), shards), cells)
    names = ["_arc", "_cell", "_low", "_high", "home_shard", "shard", "_slot"]
    ranges = spark.createDataFrame(pd.DataFrame(plan, columns=names, dtype="int64"), "_arc int, _cell int, _low long, _high long, home_shard int, shard int, _slot long")
    order = Window.partitionBy("_arc", "_cell").orderBy(F.shiftrightunsigned("_mix", 33), "_mix", "doc_id", "size", "text_crc32")
    ranked = celled.withColumn("_end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_begin", F.col("_end") - F.col("n"))
    first, last = F.greatest("_begin", "_low"), F.least("_end", "_high")
    taken = (
        ranked.join(F.broadcast(ranges), ["_arc", "_cell"])  # 2**arc_bits + virtual nodes + 2 * MOST_CELLS rows at most
        .where(first < last)
        .select("doc_id", "size", "text_crc32", "shard", "home_shard", (F.col("_slot") + first - F.col("_low")).alias("_from"), (last - first).alias("_take"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_take") - 1, F.lit(COPIES).cast("long"))).alias("_at"))
    )
    if max((r.most for r in arcs), default=0) > COPIES:
        taken = taken.repartition(common.partitions(spark), "doc_id", "_from", "_at")
    slots = F.sequence(F.col("_from") + F.col("_at"), F.col("_from") + F.least(F.col("_at") + COPIES, F.col("_take")) - 1)
    return taken.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.explode(slots).alias("slot"), "home_shard")
