"""Filters, thinning, reduction and export of motion-vector rows.

Rows of one picture have a total order ``seq``; what depends on order says so. Windows
are partitioned by picture, which has a bounded number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinefield.functions.exprs import div, wrap_i16


def export(blocks: DataFrame, codec: str) -> DataFrame:
    """Pixel end points from block centres (cx, cy) and quarter-pel vectors (mv_x, mv_y).

    H.264 puts the block into dst and truncates; HEVC puts it into src and floors.
    """
    if codec == "hevc":
        moved = [F.col(f"c{a}") + F.shiftright(f"mv_{a}", 2) for a in "xy"]
        src, dst = [F.col("cx"), F.col("cy")], moved
    else:
        src, dst = [F.col(f"c{a}") + div(F.col(f"mv_{a}"), 4) for a in "xy"], [F.col("cx"), F.col("cy")]
    ends = dict(zip(("src_x", "src_y", "dst_x", "dst_y"), [*src, *dst], strict=True))
    return blocks.withColumns({k: v.cast("int") for k, v in ends.items()})


def zero_size() -> Column:
    """Both end points equal; NaN equals nothing."""
    same = (F.col("src_x") == F.col("dst_x")) & (F.col("src_y") == F.col("dst_y"))
    return same & ~F.isnan(F.col("src_x").cast("double")) & ~F.isnan(F.col("src_y").cast("double"))


def drop_zero(rows: DataFrame) -> DataFrame:
    return rows.filter(~zero_size())


def list0_only(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("source") <= 0)


def squared_length() -> Column:
    """In doubles, so long vectors don't overflow."""
    dx, dy = (F.col(f"dst_{a}").cast("double") - F.col(f"src_{a}").cast("double") for a in "xy")
    return dx * dx + dy * dy


def min_size(rows: DataFrame, n: int) -> DataFrame:
    """Vectors of length n at least; n <= 0 keeps all."""
    return rows if n <= 0 else rows.filter(squared_length() >= n * n)


def grid(rows: DataFrame, n: int, picture: tuple[str, ...] = ("frame",), centre: tuple[str, str] = ("cx", "cy")) -> DataFrame:
    """The first row in each n x n cell of a picture; n <= 0 keeps all."""
    if n <= 0:
        return rows
    cells = [div(F.col(c), n) for c in centre]
    first = Window.partitionBy(*picture, *cells).orderBy("seq")
    return rows.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def decimate(pictures: DataFrame, n: int) -> DataFrame:
    """All pictures but each n-th, counted from the first; n <= 1 keeps all."""
    return pictures if n <= 1 else pictures.filter(F.col("frame") % n != 0)


def filter_chain(rows: DataFrame, l0_only: bool = False, size: int = 0, cell: int = 0, picture: tuple[str, ...] = ("frame",)) -> DataFrame:
    rows = drop_zero(rows)
    return grid(min_size(list0_only(rows) if l0_only else rows, size), cell, picture)


def of_frame(rows: DataFrame, n: int) -> DataFrame:
    return rows.filter(F.col("frame") == n)


def max_frame(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.max("frame"), F.lit(0)).alias("max_frame"))


def reduce_vectors(rows: DataFrame, k: int, picture: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Of each picture's vectors longer than 2 pixels the k longest, ranked in ``place``.

    A picture with k or fewer keeps its order; else length falls, and of equal ones the
    earlier row comes first.
    """
    length = squared_length()
    rows = rows.filter((length > 4) & ~F.isnan(length))
    per = Window.partitionBy(*picture)
    ranked = rows.withColumns(
        {
            "_n": F.count("*").over(per),
            "_rank": F.row_number().over(per.orderBy(length.desc(), "seq")),
            "_seat": F.row_number().over(per.orderBy("seq")),
        }
    ).filter(F.col("_rank") <= k)
    return ranked.withColumn("place", F.when(F.col("_n") <= k, F.col("_seat")).otherwise(F.col("_rank"))).drop("_n", "_rank", "_seat")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of all pictures in the order of pictures, then of their blocks."""
    return rows.orderBy("video", "frame", "seq")


def summary(pictures: DataFrame, rows: DataFrame, printed: bool = True) -> DataFrame:
    """One row (frames, mvs); vectors count only where they are ``printed``."""
    frames = pictures.agg(F.count("*").alias("n"), F.lit("frames").alias("what"))
    found = frames.unionByName((rows if printed else rows.limit(0)).agg(F.count("*").alias("n"), F.lit("mvs").alias("what")))
    return found.agg(*(F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in ("frames", "mvs")))


def sized(rows: DataFrame) -> DataFrame:
    """Wide rows whose block has a width and a height; others are no vectors."""
    return rows.filter((F.col("w") != 0) & (F.col("h") != 0))


def compact(rows: DataFrame) -> DataFrame:
    """The compact layout: end points narrowed to 16 bits, wrapping."""
    return rows.select("frame", "source", *(wrap_i16(F.col(c)).alias(c) for c in ("src_x", "src_y", "dst_x", "dst_y")))


#: Block shapes. Rows are (centre x, centre y, width, height, partition).
SHAPES = {
    "16x16": [(8, 8, 16, 16, 0)],
    "16x8": [(8, 4, 16, 8, 0), (8, 12, 16, 8, 1)],
    "8x16": [(4, 8, 8, 16, 0), (12, 8, 8, 16, 1)],
    "8x8": [(4, 4, 8, 8, 0), (12, 4, 8, 8, 1), (4, 12, 8, 8, 2), (12, 12, 8, 8, 3)],
}


def expand(blocks: DataFrame) -> DataFrame:
    """Rows of each macroblock's partitions: (mbx, mby, shape, parts) to centres and vectors.

    ``parts``: array<struct<l0, l1 boolean, x0, y0, x1, y1 int>>, one for each partition. A
    list is exported for all partitions if one uses it, with zero where one doesn't. 16x8
    and 8x16 export all of list 0 first; 8x8 takes the lists in turn for each quadrant.
    A shape that isn't known, such as intra, has no rows.
    """

    def any_of(name: str) -> Column:
        return F.exists("parts", lambda p: p[name])

    def vector(part: int, used: str, x: str, y: str) -> list[Column]:
        p = F.get("parts", F.lit(part))
        return [F.when(p[used], p[c]).otherwise(0).cast("int").alias(n) for c, n in ((x, "mv_x"), (y, "mv_y"))]

    whens = None
    for shape, rows in SHAPES.items():
        lists = []
        for cx, cy, w, h, part in rows:
            for source, used, x, y in ((-1, "l0", "x0", "y0"), (1, "l1", "x1", "y1")):
                turn = part * 2 + (source > 0) if shape == "8x8" else part + len(rows) * (source > 0)
                lists.append(
                    (
                        turn,
                        F.struct(
                            F.lit(turn).alias("turn"),
                            any_of(used).alias("there"),
                            (F.col("mbx") * 16 + cx).alias("cx"),
                            (F.col("mby") * 16 + cy).alias("cy"),
                            F.lit(w).alias("w"),
                            F.lit(h).alias("h"),
                            F.lit(source).alias("source"),
                            *vector(part, used, x, y),
                        ),
                    )
                )
        array = F.array(*(s for _, s in sorted(lists, key=lambda t: t[0])))
        is_shape = F.col("shape") == shape
        whens = F.when(is_shape, array) if whens is None else whens.when(is_shape, array)
    rest = [c for c in blocks.columns if c != "parts"]
    rows = blocks.select(*rest, F.explode(F.filter(whens, lambda s: s["there"])).alias("_row"))
    return rows.select(*rest, *(F.col(f"_row.{c}").alias(c) for c in ("turn", "cx", "cy", "w", "h", "source", "mv_x", "mv_y")))
