"""Bag-wise comparison of two sets of motion vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinefield.functions.exprs import plain_text, saturated_long
from kinefield.sources import mvcsv

KEY = ["frame", "k_src_x", "k_src_y", "k_dst_x", "k_dst_y", "source"]
_FIELDS = ["src_x", "src_y", "dst_x", "dst_y"]
#: Fixed value: the report of two equal sets.
NO_DIFFERENCES = "No differences found in frames in all frames."


def _side(rows: DataFrame, name: str) -> DataFrame:
    """Rows with their key, truncated towards zero, and their number in it."""
    doubles = {c: F.col(c).cast("double") for c in _FIELDS}
    zero = (doubles["src_x"] == doubles["dst_x"]) & (doubles["src_y"] == doubles["dst_y"])
    nan = F.isnan(doubles["src_x"]) | F.isnan(doubles["src_y"])
    rows = rows.filter(~zero | nan)
    keys = {f"k_{c}": saturated_long(v) for c, v in doubles.items()}
    rows = rows.withColumns({**keys, **{f"{name}_{c}": v for c, v in doubles.items()}})
    order = Window.partitionBy(*KEY).orderBy("seq")
    return rows.select(*KEY, F.row_number().over(order).alias("row"), *(f"{name}_{c}" for c in _FIELDS))


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """(key columns, row, turn, message): one row for each difference.

    Both have frame, source, end points and ``seq``. Vectors of no size are left out. Rows
    of one key are paired in order; a key of one side only is told once.
    """
    a = _side(first, "a").withColumn("in_a", F.lit(True))
    b = _side(second, "b").withColumn("in_b", F.lit(True))
    both = a.join(b, [*KEY, "row"], "full_outer")
    key = Window.partitionBy(*KEY)
    both = both.withColumns({f"any_{s}": F.max(F.coalesce(f"in_{s}", F.lit(False))).over(key) for s in "ab"})
    shown = F.format_string("Frame %d src=(%d,%d) dst=(%d,%d) source=%d", *KEY)
    index = (F.col("row") - 1).cast("string")
    # The forms of messages.
    found = [
        F.when(~F.col("any_b") & (F.col("row") == 1), F.concat(shown, F.lit(": missing in second file"))),
        F.when(~F.col("any_a") & (F.col("row") == 1), F.concat(shown, F.lit(": missing in first file"))),
        F.when(F.col("any_a") & F.col("in_a").isNull(), F.concat(shown, F.lit(": extra row in second file (index "), index, F.lit(")"))),
        F.when(F.col("any_b") & F.col("in_b").isNull(), F.concat(shown, F.lit(": extra row in first file (index "), index, F.lit(")"))),
    ]
    for c in _FIELDS:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        differ = F.col("in_a") & F.col("in_b") & ((x != y) | F.isnan(x) | F.isnan(y))
        found.append(
            F.when(differ, F.concat(shown, F.lit(f": '{c}' differs (first="), plain_text(x), F.lit(", second="), plain_text(y), F.lit(")")))
        )
    told = F.array(*(F.struct(F.lit(k).alias("turn"), m.alias("message")) for k, m in enumerate(found)))
    rows = both.select(*KEY, "row", F.explode(F.filter(told, lambda s: s["message"].isNotNull())).alias("d"))
    return rows.select(*KEY, "row", F.col("d.turn").alias("turn"), F.col("d.message").alias("message"))


def report(differences: DataFrame) -> DataFrame:
    """Lines in order of the keys, or one line if there are none."""
    lines = differences.orderBy(*KEY, "row", "turn").select("message")
    empty = differences.limit(1).agg(F.count("*").alias("n")).filter("n = 0")
    return lines.unionByName(empty.select(F.lit(NO_DIFFERENCES).alias("message")))


def write_report(differences: DataFrame, path: str) -> None:
    """The report as a folder of text files; their names follow the order of lines."""
    report(differences).write.mode("overwrite").text(path)


def compare_files(spark: SparkSession, first: str, second: str) -> DataFrame:
    """``compare`` for two files (or folders of files) of vectors."""
    return compare(mvcsv.read(spark, first), mvcsv.read(spark, second))
