"""Motion-vector text files, wide and compact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefield.functions.exprs import format_flags, parse_double, parse_flags, saturated_int, short_text

REQUIRED = ("frame", "src_x", "src_y")
FULL = ("frame", "source", "w", "h", "src_x", "src_y", "dst_x", "dst_y", "flags", "motion_x", "motion_y", "motion_scale")
COMPACT = ("frame", "source", "src_x", "src_y", "dst_x", "dst_y")


def _once(x: Column) -> Column:
    """x as a generated column, which later projections and filters don't compute again."""
    return F.explode(F.array(x))


def typed(rows: DataFrame) -> DataFrame:
    """Rows of text columns, named as in a header, as wide rows; other columns stay.

    A row whose required values aren't numbers is dropped. Missing values are 0; a missing
    end point is derived from the motion where its scale is positive, else the start.
    """
    names = {c.strip(): c for c in rows.columns}
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

    numbers = [c for c in FULL if c != "flags"]
    kept = [F.col(f"`{c}`") for n, c in names.items() if n not in FULL]
    flags = parse_flags(F.col(f"`{names['flags']}`")) if "flags" in names else F.lit(None)
    texts = F.array(*(F.col(f"`{names[c]}`") if c in names else F.lit(None).cast("string") for c in numbers))
    # One lambda over all fields keeps the generated code small.
    parsed = rows.select(
        *kept,
        _once(F.transform(texts, parse_double)).alias("_numbers"),
        F.coalesce(flags.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).alias("_flags"),
    )
    parsed = parsed.select(*kept, "_flags", *(F.get("_numbers", F.lit(k)).alias(f"_{c}") for k, c in enumerate(numbers)))
    parsed = parsed.filter("_frame is not null and _src_x is not null and _src_y is not null")
    scale = F.col("_motion_scale")
    ends = {}
    for a in "xy":
        start, motion = F.col(f"_src_{a}"), F.coalesce(f"_motion_{a}", F.lit(0.0))
        derived = F.when((scale > 0) & ~F.isnan(scale), start + F.try_divide(motion, scale)).otherwise(start)
        ends[f"dst_{a}"] = F.coalesce(F.col(f"_dst_{a}"), derived)
    return parsed.select(
        *kept,
        *(F.coalesce(saturated_int(F.col(f"_{c}")), F.lit(0)).alias(c) for c in ("frame", "source", "w", "h")),
        F.col("_src_x").alias("src_x"),
        F.col("_src_y").alias("src_y"),
        *(v.alias(k) for k, v in ends.items()),
        F.col("_flags").alias("flags"),
        *(F.coalesce(f"_{c}", F.lit(0.0)).alias(c) for c in ("motion_x", "motion_y", "motion_scale")),
    )


def parse_lines(lines: DataFrame, header: str, column: str = "value") -> DataFrame:
    """Lines of text under a header as wide rows; no quoting, blank lines are skipped."""
    names = [n.strip() for n in header.split(",")]
    rest = [F.col(c) for c in lines.columns if c != column]
    rows = lines.select(*rest, _once(F.col(column)).alias("_line")).filter(F.trim("_line") != "")
    rows = rows.select(*rest, _once(F.split("_line", ",")).alias("_fields"))
    return typed(rows.select(*rest, *(F.get("_fields", F.lit(k)).alias(n) for k, n in enumerate(names))))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of files, each with a header of the same columns.

    ``seq`` orders the rows: by file, part of the file and place in it.
    """
    rows = spark.read.csv(path, header=True, quote="", escape="", inferSchema=False)
    if not rows.columns:
        raise ValueError(f"{path}: no header")
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return typed(rows.select("*", place.alias("seq")))


def _float(x: Column) -> Column:
    """The text of a double that reads back as the same, with .0 for whole numbers."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e16) & (x != 0)
    return F.when(whole, F.concat(x.cast("long").cast("string"), F.lit(".0"))).otherwise(short_text(x))


def wide_text(rows: DataFrame) -> DataFrame:
    return rows.select(
        *("frame", "source", "w", "h"),
        *(_float(F.col(c)).alias(c) for c in ("src_x", "src_y", "dst_x", "dst_y")),
        format_flags(F.col("flags")).alias("flags"),
        *(_float(F.col(c)).alias(c) for c in ("motion_x", "motion_y", "motion_scale")),
    )


def write(rows: DataFrame, path: str, layout: str = "compact") -> int:
    """Write a folder of files with headers; the count of rows."""
    from pyspark.sql import Observation

    seen = Observation()
    counted = rows.observe(seen, F.count("*").alias("n"))
    out = wide_text(counted) if layout == "full" else counted.select(*COMPACT)
    out.write.mode("overwrite").csv(path, header=True, quote="")
    return seen.get["n"]
