"""Stream order: parameter sets, pictures, display order, reference lists.

Streams are partitioned by ``video``; a video's rows are ordered by ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(order: str = "seq", partition: tuple[str, ...] = ("video",)):
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def resolve_parameters(units: DataFrame) -> DataFrame:
    """Slices with the latest parameter set of their id before them; others are dropped.

    ``units``: video, seq, kind (set or slice), id, value (of sets).
    """
    last = F.last(F.when(F.col("kind") == "set", F.col("value")), ignorenulls=True)
    found = units.withColumn("resolved", last.over(_before(partition=("video", "id"))))
    return found.filter("kind = 'slice' and resolved is not null").drop("kind", "value")


def assemble_pictures(slices: DataFrame) -> DataFrame:
    """Slices with their picture's number; one begins where first_mb is 0. Earlier ones go."""
    running = Window.partitionBy("video").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum((F.col("first_mb") == 0).cast("int")).over(running) - 1
    return slices.withColumn("frame", number.cast("int")).filter("frame >= 0")


def group_slices(slices: DataFrame) -> DataFrame:
    """One row for each picture: its slices in order."""
    rows = slices.groupBy("video", "frame").agg(F.array_sort(F.collect_list("seq")).alias("slices"))
    return rows.withColumn("n_slices", F.size("slices"))


def display_order(pictures: DataFrame, bits: int | Column, anchor: Column | None = None, restart: Column | None = None) -> DataFrame:
    """Display counts from their low bits (lsb); ``anchor``: pictures that are counted from.

    For HEVC, anchors are pictures of temporal id 0, and counting starts anew at ``restart``:
    IDR pictures and those after a broken link, whose high part is dropped.

    A count that falls by half the range or more from the anchor before it has wrapped up,
    one that rises by more has wrapped down. Without ``restart`` counting starts anew at each ``idr``.
    """
    bits = F.lit(bits) if isinstance(bits, int) else bits
    top, half = (F.call_function("shiftleft", F.lit(1), b) for b in (bits, bits - 1))
    anchor = F.col("is_ref") if anchor is None else anchor
    restart = F.col("idr") if restart is None else restart
    epoch = F.sum(restart.cast("int")).over(Window.partitionBy("video").orderBy("seq"))
    rows = pictures.withColumns({"_epoch": epoch, "_anchor": anchor, "_restart": restart})
    part = ("video", "_epoch")
    low = F.coalesce(F.last(F.when(F.col("_anchor"), F.col("lsb")), ignorenulls=True).over(_before(partition=part)), F.lit(0))
    up = F.when((F.col("lsb") < low) & (low - F.col("lsb") >= half), top)
    step = up.when((F.col("lsb") > low) & (F.col("lsb") - low > half), -top).otherwise(0)
    rows = rows.withColumn("_step", F.when(F.col("_restart"), 0).otherwise(step))
    # A step lasts only if an anchor takes it.
    base = F.coalesce(F.sum(F.when(F.col("_anchor"), F.col("_step"))).over(_before(partition=part)), F.lit(0))
    return rows.withColumn("poc", (base + F.col("_step") + F.col("lsb")).cast("int")).drop("_epoch", "_anchor", "_restart", "_step")


def reference_list(first: Column, second: Column, n: Column) -> Column:
    """Both arrays in turn, repeated to n entries; empty if both are."""
    both = F.concat(first, second)
    cycle = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(both, (i % F.size(both)).cast("int")))
    return F.when((F.size(both) > 0) & (n > 0), cycle).otherwise(F.slice(both, 1, 0))


def last_references(pictures: DataFrame, keep: int = 16) -> DataFrame:
    """Each picture with the last ``keep`` reference pictures before it, oldest first.

    References are numbered, and a frame over the numbers holds ``keep`` of them, however
    long the video is.
    """
    ref = F.col("is_ref").cast("int")
    rank = F.sum(ref).over(Window.partitionBy("video").orderBy("seq"))
    rows = pictures.withColumn("_rank", rank - ref)
    last = Window.partitionBy("video").orderBy("_rank").rangeBetween(-keep, -1)
    held = F.collect_list(F.when(F.col("is_ref"), F.struct("frame", "poc"))).over(last)
    return rows.withColumn("dpb", held).drop("_rank")


def collocated(pictures: DataFrame, keep: int = 16, n0: Column | None = None, n1: Column | None = None) -> DataFrame:
    """The head of list 1: the nearest later reference in display order, else the nearest earlier one.

    Of the last ``keep`` references before each picture; pictures without one are dropped.
    ``n0`` and ``n1``: entries of both lists (1 where not given). Where both lists come out
    equal and longer than one, as all references lie on one side and the lists are of one
    length, list 1 has its first two swapped, so the second nearest is taken.

    References are numbered, so the candidates come from an equi-join on their numbers and
    a picture has ``keep`` of them at most.
    """
    running = Window.partitionBy("video").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.col("is_ref").cast("int")).over(running), F.lit(0))
    one = F.lit(1)
    sizes = {"_n0": F.greatest(one if n0 is None else n0, one), "_n1": F.greatest(one if n1 is None else n1, one)}
    rows = pictures.withColumns({"_seen": seen, **sizes})
    refs = rows.filter("is_ref").select("video", F.col("_seen").alias("_no"), F.col("frame").alias("col_frame"), F.col("poc").alias("col_poc"))
    wanted = rows.filter("_seen > 0").withColumn(
        "_no", F.explode(F.sequence(F.greatest(F.col("_seen") - keep, F.lit(0)), F.col("_seen") - 1))
    )
    near = wanted.join(refs, ["video", "_no"]).filter("col_poc <> poc")
    past = F.col("col_poc") < F.col("poc")
    key = F.struct(past.alias("past"), F.abs(F.col("col_poc") - F.col("poc")).alias("far"), (-F.col("_no")).alias("late"), "col_frame", "col_poc")
    held = near.groupBy("video", "frame", "poc", "_n0", "_n1").agg(F.array_sort(F.collect_list(key)).alias("_held"))
    # Sorted, the first is of the past only if all are.
    one_side = F.element_at("_held", 1)["past"] == F.element_at("_held", -1)["past"]
    swapped = one_side & (F.col("_n0") == F.col("_n1")) & (F.col("_n1") > 1) & (F.size("_held") > 1)
    best = held.withColumn("_b", F.element_at("_held", F.when(swapped, 2).otherwise(1)))
    return best.select("video", "frame", "poc", F.col("_b.col_frame").alias("col_frame"), F.col("_b.col_poc").alias("col_poc"))
