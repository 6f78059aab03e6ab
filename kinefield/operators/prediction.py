"""Motion prediction over decoded blocks, as joins of each block with its neighbours.

Blocks: frame, bx, by_, ref, mvx, mvy. Given final vectors, predictors of whole blocks are
a set operation; while decoding they are a recursion.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinefield.functions.exprs import median3

#: Reference -2 is a neighbour that isn't there.
MISSING = -2


def with_neighbours(blocks: DataFrame) -> DataFrame:
    """Left (a), top (b) and diagonal (c: top right, else top left) neighbours of blocks.

    A block is sent to the four that may need it, so one shuffle by place brings them
    together; each place has five rows at most.
    """
    sent = [("o", 0, 0), ("a", 1, 0), ("b", 0, 1), ("r", -1, 1), ("l", 1, 1)]
    moved = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(x).alias("x"), F.lit(y).alias("y")) for n, x, y in sent)))
    rows = blocks.select("*", moved.alias("to")).withColumns({"bx": F.col("bx") + F.col("to.x"), "by_": F.col("by_") + F.col("to.y")})
    value = F.struct("ref", "mvx", "mvy")
    keys = ["frame", "bx", "by_"]
    other = [c for c in blocks.columns if c not in keys]
    picks = [F.max(F.when(F.col("to.n") == n, value)).alias(f"_{n}") for n, *_ in sent[1:]]
    own = F.max(F.when(F.col("to.n") == "o", F.struct(*other))).alias("_o")
    rows = rows.groupBy(*keys).agg(own, *picks).filter("_o is not null")
    none = F.struct(F.lit(MISSING).alias("ref"), F.lit(0).alias("mvx"), F.lit(0).alias("mvy"))
    return rows.select(
        *keys,
        "_o.*",
        F.coalesce("_a", none).alias("a"),
        F.coalesce("_b", none).alias("b"),
        F.coalesce("_r", "_l", none).alias("c"),
    )


def _median(axis: str):
    return median3(F.col(f"a.{axis}"), F.col(f"b.{axis}"), F.col(f"c.{axis}"))


def _predicted(axis: str, ref):
    a, b, c = (F.col(f"{n}.ref") == ref for n in "abc")
    matches = a.cast("int") + b.cast("int") + c.cast("int")
    one = F.when(a, F.col(f"a.{axis}")).when(b, F.col(f"b.{axis}")).otherwise(F.col(f"c.{axis}"))
    left = (F.col("b.ref") == MISSING) & (F.col("c.ref") == MISSING) & (F.col("a.ref") != MISSING)
    return F.when(matches == 1, one).when((matches == 0) & left, F.col(f"a.{axis}")).otherwise(_median(axis))


def median_prediction(blocks: DataFrame) -> DataFrame:
    """Predicted vectors (px, py) and what is left to code (dx, dy)."""
    rows = with_neighbours(blocks)
    rows = rows.withColumns({"px": _predicted("mvx", F.col("ref")), "py": _predicted("mvy", F.col("ref"))})
    return rows.withColumns({"dx": F.col("mvx") - F.col("px"), "dy": F.col("mvy") - F.col("py")})


def directional_prediction(blocks: DataFrame, side: str) -> DataFrame:
    """The top (16x8), left or diagonal (8x16) neighbour if its reference matches, else the rest."""
    rows = with_neighbours(blocks)
    n = {"top": "b", "left": "a", "diagonal": "c"}[side]
    match = F.col(f"{n}.ref") == F.col("ref")
    return rows.withColumns(
        {p: F.when(match, F.col(f"{n}.{v}")).otherwise(_predicted(v, F.col("ref"))) for p, v in (("px", "mvx"), ("py", "mvy"))}
    )


def skip_prediction(blocks: DataFrame) -> DataFrame:
    """Vectors of skipped blocks: zero by a missing or resting neighbour, else as for ref 0."""
    rows = with_neighbours(blocks)

    def stops(n: str):
        rests = (F.col(f"{n}.ref") == 0) & (F.col(f"{n}.mvx") == 0) & (F.col(f"{n}.mvy") == 0)
        return (F.col(f"{n}.ref") == MISSING) | rests

    zero = stops("a") | stops("b")
    return rows.withColumns(
        {p: F.when(zero, 0).otherwise(_predicted(v, F.lit(0))) for p, v in (("px", "mvx"), ("py", "mvy"))}
    )


def runs(blocks: DataFrame, value: str) -> DataFrame:
    """Maximal runs of equal ``value`` along rows of blocks: (frame, by_, bx, width, value)."""
    row = Window.partitionBy("frame", "by_").orderBy("bx")
    goes_on = (F.lag(value).over(row) == F.col(value)) & (F.lag("bx").over(row) == F.col("bx") - 1)
    number = F.sum(F.when(goes_on, 0).otherwise(1)).over(row)
    rows = blocks.withColumn("_run", number)
    return rows.groupBy("frame", "by_", "_run").agg(
        F.min("bx").alias("bx"), F.count("*").cast("int").alias("width"), F.first(value).alias(value)
    ).drop("_run")


def rectangles(blocks: DataFrame, value: str, most: int = 255) -> DataFrame:
    """Greedy rectangles of equal ``value``: (frame, bx, by_, width, height, value).

    Blocks are taken in raster order; each grows to the right, then down by whole rows, to
    ``most`` blocks. Earlier choices bind later ones, so a picture, whose blocks are
    bounded, is one group. Blocks with a null value are in no rectangle.
    """
    import pandas as pd

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, values = pd.factorize(pdf[value])  # null is -1
        xs, ys = pdf["bx"].to_numpy(), pdf["by_"].to_numpy()
        x0, y0 = int(xs.min()), int(ys.min())
        grid = np.full((int(ys.max()) - y0 + 1, int(xs.max()) - x0 + 1), -1, np.int64)
        grid[ys - y0, xs - x0] = codes
        out = []
        for y, x in zip(*(k.tolist() for k in np.nonzero(grid >= 0)), strict=True):
            v = grid[y, x]
            if v < 0:
                continue
            differ = grid[y, x : x + most] != v
            w = int(differ.argmax()) if differ.any() else len(differ)
            whole = (grid[y : y + most, x : x + w] == v).all(axis=1)
            h = len(whole) if whole.all() else int(whole.argmin())
            grid[y : y + h, x : x + w] = -1
            out.append((pdf["frame"].iloc[0], x + x0, y + y0, w, h, values[v]))
        return pd.DataFrame(out, columns=["frame", "bx", "by_", "width", "height", value])

    kind = blocks.schema[value].dataType.simpleString()
    return blocks.select("frame", "bx", "by_", value).groupBy("frame").applyInPandas(
        merge, f"frame int, bx int, by_ int, width int, height int, `{value}` {kind}"
    )


def merged_vectors(blocks: DataFrame, min_block: int = 4) -> DataFrame:
    """Vectors of merged blocks of an HEVC picture: (frame, seq, source, cx, cy, mv_x, mv_y).

    ``blocks``: frame, bx, by_ (in blocks of ``min_block`` pixels) and, for each list, l0 or
    l1 (whether it is used), ref0 or ref1, x0, y0 or x1, y1. Blocks merge where all of these
    are equal, also those of a list that isn't used; blocks that use none are left out. A
    rectangle over 255 pixels has no rows. List 0 comes before list 1, and a source is the
    reference number plus 1, negative for list 0. Zero vectors are still there.
    """
    fields = ("l0", "ref0", "x0", "y0", "l1", "ref1", "x1", "y1")
    code = F.concat_ws(",", *(F.col(c).cast("int").cast("string") for c in fields))
    found = rectangles(blocks.withColumn("code", F.when(F.col("l0") | F.col("l1"), code)), "code", 255 // min_block)
    width, height = F.col("width") * min_block, F.col("height") * min_block
    found = found.filter((width <= 255) & (height <= 255)).withColumn("v", F.transform(F.split("code", ","), lambda x: x.cast("int")))
    lists = F.array(
        *(
            F.struct(
                F.lit(k).alias("list"),
                F.get("v", F.lit(4 * k)).alias("used"),
                ((F.get("v", F.lit(4 * k + 1)) + 1) * (2 * k - 1)).alias("source"),
                F.get("v", F.lit(4 * k + 2)).alias("mv_x"),
                F.get("v", F.lit(4 * k + 3)).alias("mv_y"),
            )
            for k in (0, 1)
        )
    )
    rows = found.withColumn("row", F.explode(F.filter(lists, lambda r: r["used"] == 1)))
    return rows.select(
        "frame",
        F.struct("by_", "bx", "row.list").alias("seq"),
        "row.source",
        (F.col("bx") * min_block + F.floor(width / 2)).cast("int").alias("cx"),
        (F.col("by_") * min_block + F.floor(height / 2)).cast("int").alias("cy"),
        *("row.mv_x", "row.mv_y"),
    )
