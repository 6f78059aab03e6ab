"""From video files to vectors, run counters and a summary, by options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefield.functions import exprs as X
from kinefield.operators import vectors as V
from kinefield.operators.pictures import assemble_pictures
from kinefield.plans import pictures as P
from kinefield.sources import mvcsv, video
from kinefield.sources.cabac import Tables, read_tables

#: Columns of the counters that are counts, and their order; others are of a sequence.
COUNTS = (
    "frames", "cavlc_decoded", "cabac_decoded", "b_skipped", "b_decoded", "incomplete", "parse_errors",
    "i_slices", "p_slices", "b_slices", "dependent", "unsupported", "bad_header", "sync_attempt", "sync_ok",
)
#: Fixed value: the least QP where there is no slice.
NO_QP = 999


@dataclass(frozen=True)
class Options:
    """What a run decodes, keeps and writes.

    ``skip_every``: each such picture, from the first, isn't decoded, but is counted.
    ``min_size`` and ``grid`` in pixels; 0 is off. ``printed``: without it no vector is
    told or counted. ``layout``: compact or full. ``tables``: a file of the arithmetic
    codes' tables (``sources.cabac.read_tables``), without which such slices aren't decoded.
    ``b_slices``: B slices are, which needs ``tables``.
    """

    printed: bool = True
    layout: str = "compact"
    l0_only: bool = False
    min_size: int = 0
    grid: int = 0
    skip_every: int = 0
    tables: str | None = None
    b_slices: bool = False

    def __post_init__(self):
        if self.layout not in ("compact", "full"):
            raise ValueError(f"layout {self.layout}: compact or full")
        if self.b_slices and not self.tables:
            raise ValueError("B slices need tables")

    def known_tables(self) -> Tables | None:
        return read_tables(self.tables) if self.tables else None


def extract(units: DataFrame, options: Options = Options()) -> DataFrame:
    """Vectors of all H.264 files: video, frame, seq and the columns of the layout.

    HEVC files have pictures and counters but no vectors yet. Rows aren't in order;
    ``operators.vectors.in_order`` sorts them.
    """
    rows = P.h264_vectors(P.h264_slices(units), options.skip_every, options.known_tables(), options.b_slices)
    rows = V.filter_chain(rows, options.l0_only, options.min_size, options.grid, ("video", "frame"))
    if not options.printed:
        rows = rows.limit(0)
    if options.layout == "compact":
        return rows.select("video", "frame", "seq", "source", *(X.wrap_i16(F.col(c)).alias(c) for c in mvcsv.COMPACT[2:]))
    return rows.select(
        *("video", "frame", "seq", "source", "w", "h"),
        *(F.col(c).cast("double").alias(c) for c in ("src_x", "src_y", "dst_x", "dst_y")),
        F.lit(0).cast("decimal(20,0)").alias("flags"),
        F.col("mv_x").cast("double").alias("motion_x"),
        F.col("mv_y").cast("double").alias("motion_y"),
        F.lit(4.0).alias("motion_scale"),
    )


def _h264(units: DataFrame, options: Options) -> DataFrame:
    slices = P.h264_slices(units)
    placed = V.decimate(assemble_pictures(slices.withColumn("first_mb", F.col("head.first_mb"))), options.skip_every)
    is_b = F.col("head.slice_type") == "B"
    heads = slices.groupBy("video").agg(
        F.count_if(F.col("head.first_mb") == 0).alias("frames"),
        F.count_if(is_b & F.lit(not options.b_slices)).alias("b_skipped"),
        *(F.count_if(F.col("head.slice_type") == t).alias(f"{t.lower()}_slices") for t in "IPB"),
        F.min("head.slice_qp").alias("qp_min"),
        F.max("head.slice_qp").alias("qp_max"),
        F.max_by(F.col("sps.width_in_mbs") * 16, "seq").alias("width"),
        F.max_by(X.mb_height(F.col("sps.height_in_map_units"), F.col("sps.frame_mbs_only")) * 16, "seq").alias("height"),
        F.max_by("sps.profile_idc", "seq").alias("profile_idc"),
    )
    tables = options.known_tables()
    left_out = F.col("unsupported").isNotNull() | (F.col("pps.cabac") == 1) & F.lit(tables is None)
    left = placed.filter(~is_b | F.lit(options.b_slices)).groupBy("video").agg(F.count_if(left_out).alias("unsupported"))
    if options.b_slices:
        motion = P.h264_sequences(slices, tables, options.skip_every)
    else:
        motion = P.h264_motion(slices, options.skip_every, tables=tables)
    coded_b = F.col("slice_type") == "B"
    done = motion.groupBy("video").agg(
        F.count_if((F.col("cabac") == 0) & ~coded_b).alias("cavlc_decoded"),
        F.count_if((F.col("cabac") == 1) & ~coded_b).alias("cabac_decoded"),
        F.count_if(coded_b).alias("b_decoded"),
        F.count_if(F.col("first_mb") + F.col("motion.n_mbs") != F.col("n_pic_mbs")).alias("incomplete"),
        F.count_if(~F.col("motion.complete")).alias("parse_errors"),
    )
    whole = heads.unionByName(left, allowMissingColumns=True).unionByName(done, allowMissingColumns=True)
    return whole.withColumn("hevc", F.lit(False))


def _hevc(units: DataFrame) -> DataFrame:
    slices = P.hevc_slices(units)
    qp = F.col("head.slice_qp")
    whole = F.col("unsupported").isNull()
    found = slices.groupBy("video").agg(
        F.count_if(F.col("head.first_in_picture") == 1).alias("frames"),
        *(F.count_if(F.col("head.slice_type") == t).alias(f"{t.lower()}_slices") for t in "IPB"),
        F.count_if(F.col("head.slice_type").isNull()).alias("dependent"),
        F.min(qp).alias("qp_min"),
        F.max(qp).alias("qp_max"),
        F.count_if(F.col("head.several_streams") == 1).alias("unsupported"),
        F.count_if((F.col("head.data_byte") > F.col("bytes")) | ~qp.between(0, 51)).alias("bad_header"),
        F.count_if(whole).alias("sync_attempt"),
        F.max_by("sps.width", "seq").alias("width"),
        F.max_by("sps.height", "seq").alias("height"),
        F.max_by(F.call_function("shiftleft", F.lit(1), F.col("sps.log2_ctb")), "seq").alias("ctb"),
        F.max_by("sps.profile_idc", "seq").alias("profile_idc"),
    )
    return found.withColumn("hevc", F.lit(True))


def counters(units: DataFrame, options: Options = Options()) -> DataFrame:
    """One row for each file that has slices: its counts, sizes and range of QP.

    ``unsupported`` counts slices that can't be decoded with these options, but for B
    slices, which are ``b_skipped`` where they aren't asked for. ``frames`` counts all pictures, decoded or not. HEVC slices
    that could be decoded are ``sync_attempt``; none is decoded yet.
    """
    parts = _h264(units, options).unionByName(_hevc(units), allowMissingColumns=True)
    held = set(parts.columns)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)) if c in held else F.lit(0).cast("long")
    return parts.groupBy("video").agg(
        F.max("hevc").alias("hevc"),
        *(count(c).alias(c) for c in COUNTS),
        *(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("width", "height", "ctb", "profile_idc")),
        F.coalesce(F.min("qp_min"), F.lit(NO_QP)).alias("qp_min"),
        F.coalesce(F.max("qp_max"), F.lit(0)).alias("qp_max"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """Counters of several runs or files as one row."""
    return parts.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS),
        F.coalesce(F.min("qp_min"), F.lit(NO_QP)).alias("qp_min"),
        F.coalesce(F.max("qp_max"), F.lit(0)).alias("qp_max"),
    )


def run(spark: SparkSession, path: str, output: str | None = None, options: Options = Options()) -> tuple[int, int]:
    """Write the vectors of the files at ``path``; the counts of pictures and of vectors.

    Files are read and split once for the vectors and once for the count of pictures. The
    folder's files follow each other in the order of videos, pictures and blocks.
    """
    units = video.read(spark, path)
    frames = counters(units, options).agg(F.coalesce(F.sum("frames"), F.lit(0))).first()[0]
    if output is None or not options.printed:
        return frames, 0
    return frames, mvcsv.write(V.in_order(extract(units, options)), output, options.layout)
