"""Minimax contiguous sharding of groups of equal texts; DataFrame functions only.

Groups stand in the order of their smallest doc_id and are never cut. The least
capacity for which a greedy fill needs no more shards than asked is found by
binary search. Within that capacity each cut is the one nearest to an equal share of what
is left, so no shard stays empty while there are groups.

The driver sees sums of blocks of consecutive groups, not groups: first one sum for
each range partition, then finer sums of the few blocks in which a cut can lie, at
most ``FAN`` a block, until those are single groups. So what it holds is bounded by
partitions and shards, at any input size.

Defined results: a null text has no bytes and equals an empty one; its crc32 is 0. A
null doc_id sorts before all others. Repeated rows are rows of one group. An empty
table gives no rows. Extra columns are ignored. A group larger than an equal share
sets the capacity by itself.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinefield.llm import common

#: Finer blocks that one block is split into.
FAN = 256
_ROW_BITS = 33  # of monotonically_increasing_id


def greedy(prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Item positions at which each next shard begins, or None if shards run out.

    ``prefix[i]``: the size of the items before i.
    """
    cuts, at, n = [], 0, len(prefix) - 1
    while True:
        to = bisect_right(prefix, prefix[at] + capacity) - 1
        if to >= n:
            return cuts
        if to == at or len(cuts) + 1 == shards:
            return None
        cuts.append(to)
        at = to


def least_capacity(prefix: list[int], shards: int, low: int) -> int:
    """The smallest capacity, ``low`` at least, that fills no more than ``shards`` shards."""
    high = prefix[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy(prefix, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


Block = tuple[int, int, int, int]  # first place, bytes, groups, bytes of the largest


def even_cuts(items: list[Block], capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """Items at which shards 1, 2, ... begin, and items that a cut may have to go through.

    Each shard has at most ``capacity`` (which must be feasible), a group if there is one,
    and else about an equal share of what is left for it and the shards after it.
    """
    prefix = [0, *accumulate(s for _, s, *_ in items)]
    groups = [0, *accumulate(n for _, _, n, _ in items)]
    total, split = prefix[-1], set()

    def place(size: int) -> int:
        """The first item not before ``size``; an item around it is to be split."""
        k = bisect_left(prefix, size)
        if k < len(prefix) and prefix[k] != size and items[k - 1][2] > 1:
            split.add(k - 1)
        return k

    # What begins at least[k] just fits into shards k, k + 1, ...
    least, end = [0] * shards, total
    for k in range(shards - 1, 0, -1):
        least[k] = place(end - capacity) if end > capacity else 0
        end = prefix[least[k]]
    cuts, at = [], 0
    for k in range(1, shards):
        if at + 1 >= len(items) and (at >= len(items) or items[at][2] == 1):
            break
        share = prefix[at] + (total - prefix[at]) // (shards - k + 1)
        to = place(share)
        to -= to > at + 1 and prefix[to] - share > share - prefix[to - 1]
        room = prefix[at] + capacity
        if prefix[to] > room:
            to = bisect_right(prefix, room) - 1
            if prefix[to] < room and items[to][2] > 1:
                split.add(to)
        to = max(to, least[k], at + 1)
        # A group for each shard after this one, if there are as many.
        if groups[-1] - groups[to] < shards - k and to > at + 1:
            to = max(at + 1, bisect_right(groups, groups[-1] - (shards - k)) - 1)
        if to == at + 1 and items[at][2] > 1 and groups[-1] - groups[to] < shards - k:
            split.add(at)
        if to >= len(items):
            break
        cuts.append(to)
        at = to
    return cuts, split


def _finer(groups: DataFrame, items: list[Block], split: set[int]) -> list[Block]:
    """The items, those in ``split`` cut into ``FAN`` parts at most."""
    wanted = [(items[k][0], items[k][0] + items[k][2], -(-items[k][2] // FAN)) for k in sorted(split)]
    ranges = groups.sparkSession.createDataFrame(wanted, "first long, last long, step long")
    # Ranges of places don't overlap and lie within one partition, which is the key.
    found = (
        groups.withColumn("part", F.shiftright("place", _ROW_BITS))
        .join(F.broadcast(ranges.withColumn("part", F.shiftright("first", _ROW_BITS))), "part")
        .filter("place >= first and place < last")
        .groupBy("first", F.expr("(place - first) div step").alias("sub"))
        .agg(F.min("place").alias("p"), F.sum("bytes").alias("s"), F.count("*").alias("n"), F.max("bytes").alias("m"))
    )
    finer = [(r["p"], r["s"], r["n"], r["m"]) for r in found.collect()]
    return sorted([x for k, x in enumerate(items) if k not in split] + finer)


def _cut_places(groups: DataFrame, shards: int) -> list[int]:
    """Places (see ``minimax_shards``) at which shards 1, 2, ... begin."""
    rows = groups.groupBy(F.shiftright("place", _ROW_BITS).alias("b")).agg(
        F.min("place").alias("p"), F.sum("bytes").alias("s"), F.count("*").alias("n"), F.max("bytes").alias("m")
    )
    items = sorted((r["p"], r["s"], r["n"], r["m"]) for r in rows.collect())
    if not items:
        return []
    floor = max(max(m for *_, m in items), -(-sum(s for _, s, *_ in items) // shards))
    while True:
        prefix = [0, *accumulate(s for _, s, *_ in items)]
        low, high = floor, least_capacity(prefix, shards, floor)
        # Cuts move on with the capacity: those for low..high lie within these bounds.
        split, lowest, highest = set(), 0, 0
        for _ in range(shards):
            lowest = prefix[bisect_right(prefix, lowest + low) - 1]
            highest = min(prefix[-1], highest + high)
            a, b = bisect_right(prefix, lowest) - 1, bisect_right(prefix, highest) - 1
            split.update(k for k in range(a, min(b + 1, len(items))) if items[k][2] > 1)
        if not split:
            break
        items = _finer(groups, items, split)
    while True:
        cuts, split = even_cuts(items, high, shards)
        if not split:
            return [items[k][0] for k in cuts]
        items = _finer(groups, items, split)


def minimax_shards(documents: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row."""
    spark = documents.sparkSession
    scratch = common.Scratch(spark, "shards")
    parts = 2 * common.partitions(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.table(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"),
        ),
        "rows",
    )
    groups = rows.groupBy("same").agg(F.min("doc_id").alias("least"), F.sum("size").alias("bytes"))
    # A group's place: range partition and row in it, so places follow (least, same).
    groups = scratch.table(
        groups.repartitionByRange(parts, "least", "same")
        .sortWithinPartitions("least", "same")
        .withColumn("place", F.monotonically_increasing_id()),
        "groups",
    )
    shard = F.lit(0)
    for place in _cut_places(groups.select("place", "bytes"), shards):
        shard = shard + (F.col("place") >= place).cast("int")
    placed = rows.join(groups.select("same", shard.alias("shard")), "same").drop("same")
    order = ["shard", "doc_id", "text_crc32", "size"]
    placed = scratch.table(
        placed.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()),
        "placed",
    )
    part = F.shiftright("place", _ROW_BITS).alias("part")
    # One row for each partition and shard in it: partitions + shards rows at most.
    runs = placed.groupBy("shard", part).agg(F.min("place").alias("first"), F.count("*").alias("n")).collect()
    base, table = {}, []
    for r in sorted(runs, key=lambda r: (r["shard"], r["part"])):
        table.append((r["shard"], r["part"], base.get(r["shard"], 0) - r["first"]))
        base[r["shard"]] = base.get(r["shard"], 0) + r["n"]
    shifts = spark.createDataFrame(table, "shard int, part long, shift long")
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(shifts), ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("place") + F.col("shift")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
