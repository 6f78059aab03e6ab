"""From NAL units to slices and pictures, and of H.264 video to vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinefield.functions import exprs as X
from kinefield.operators.pictures import assemble_pictures, collocated, display_order, reference_list, resolve_parameters
from kinefield.operators.vectors import decimate, expand, export
from kinefield.sources import cabac, cavlc, syntax
from kinefield.sources.cabac import Tables

_SLICES = (1, 5)


def unsupported() -> Column:
    """Why a slice can't be decoded, or null."""
    head, sps, pps = F.col("head"), F.col("sps"), F.col("pps")
    return (
        F.when((head["field_pic"] == 1) | (sps["mb_adaptive"] == 1), "field")
        .when(pps["num_slice_groups"] > 1, "slice groups")
        .when(sps["chroma_format_idc"] == 3, "4:4:4")
        .when(head["slice_type"].isin("SP", "SI"), "switching slice")
        .when((head["slice_type"] == "B") & (pps["cabac"] == 0), "B without CABAC")
        .when((head["slice_type"] == "B") & (head["direct_spatial"] == 0), "temporal direct")
        .when((head["slice_type"] == "B") & (sps["direct_8x8_inference"] == 0), "direct without 8x8 inference")
        .when((head["slice_type"] == "B") & (sps["poc_type"] != 0), "display order type")
    )


def _with_sets(rows: DataFrame, sps_type: str, pps_type: str, keep: tuple[str, ...]) -> DataFrame:
    """Slices with the parameter sets of their ids before them in their file, as ``sps`` and ``pps``.

    ``rows``: ``keep``, _sps and _pps (null but in units that hold them), _id (of a slice's
    picture set).
    """
    is_sps, is_pps = F.col("_sps").isNotNull(), F.col("_pps").isNotNull()
    role = F.when(is_sps | is_pps, "set").otherwise("slice").alias("kind")
    none = F.lit(None)
    picture_sets = rows.filter(~is_sps).select(*keep, role, F.coalesce("_pps.pps_id", "_id").alias("id"), F.col("_pps").alias("value"))
    with_pps = resolve_parameters(picture_sets).withColumnRenamed("resolved", "pps")
    slices = with_pps.select(*keep, F.lit("slice").alias("kind"), F.col("pps.sps_id").alias("id"), none.cast(sps_type).alias("value"), "pps")
    sets = rows.filter(is_sps).select(*keep, role, F.col("_sps.sps_id").alias("id"), F.col("_sps").alias("value"), none.cast(pps_type).alias("pps"))
    return resolve_parameters(slices.unionByName(sets)).withColumnRenamed("resolved", "sps")


def h264_slices(units: DataFrame) -> DataFrame:
    """video, seq, packet, idr, is_ref, head, sps, pps, unsupported, payload of each slice.

    ``units``: as ``sources.video.units`` gives them. A slice takes the latest parameter
    sets of its ids before it in its file; slices without them are dropped.
    """
    kind, payload = F.col("nal_type"), F.col("payload")
    rows = units.filter((F.col("codec") == "h264") & kind.isin(7, 8, *_SLICES)).select(
        F.col("path").alias("video"),
        F.col("nal_no").alias("seq"),
        *("packet", "nal_type", "ref_idc"),
        F.when(kind.isin(*_SLICES), payload).alias("payload"),
        syntax.h264_sps(F.when(kind == 7, payload)).alias("_sps"),
        syntax.h264_pps(F.when(kind == 8, payload)).alias("_pps"),
        syntax.h264_slice_start(F.when(kind.isin(*_SLICES), payload))["pps_id"].alias("_id"),
    )
    keep = ("video", "seq", "packet", "nal_type", "ref_idc", "payload")
    found = _with_sets(rows, syntax.H264_SPS_TYPE, syntax.H264_PPS_TYPE, keep)
    head = syntax.h264_slice(F.col("payload"), F.col("nal_type"), F.col("ref_idc"), F.col("sps"), F.col("pps"))
    return found.withColumn("head", head).select(
        *("video", "seq", "packet"),
        (F.col("nal_type") == 5).alias("idr"),
        (F.col("ref_idc") > 0).alias("is_ref"),
        *("head", "sps", "pps"),
        unsupported().alias("unsupported"),
        "payload",
    )


def _numbered(slices: DataFrame) -> DataFrame:
    return assemble_pictures(slices.withColumn("first_mb", F.col("head.first_mb")))


def h264_motion(slices: DataFrame, skip_every: int = 0, kinds: tuple[str, ...] = ("I", "P"), tables: Tables | None = None) -> DataFrame:
    """Decoded slices: video, frame, seq, slice_type, cabac, first_mb, n_pic_mbs, width_mbs, motion.

    Every ``skip_every``-th picture, from the first, isn't decoded (0 and 1 decode all);
    arithmetic-coded slices are where there are ``tables``. I and P slices need no other one, so
    they are dealt over all tasks before they are decoded. For B slices see ``h264_sequences``.
    """
    numbered = decimate(_numbered(slices), skip_every).filter(_decodable(kinds, tables))
    found = numbered.select("video", "frame", "seq", "payload", "head", "sps", "pps")
    return h264_motion_of(found.repartition("video", "seq"), kinds, tables)


def _decodable(kinds: tuple[str, ...], tables: Tables | None) -> Column:
    known = unsupported().isNull() & F.col("head.slice_type").isin(*kinds)
    return known if tables else known & (F.col("pps.cabac") == 0)


def _layout() -> list[Column]:
    width = F.col("sps.width_in_mbs")
    height = X.mb_height(F.col("sps.height_in_map_units"), F.col("sps.frame_mbs_only"))
    return [F.col("head.slice_type"), F.col("pps.cabac"), F.col("head.first_mb"), (width * height).alias("n_pic_mbs"), width.alias("width_mbs")]


def h264_motion_of(found: DataFrame, kinds: tuple[str, ...] = ("I", "P"), tables: Tables | None = None) -> DataFrame:
    """As ``h264_motion``, of slices with their pictures' numbers."""
    fields = map(F.col, ("payload", "head", "sps", "pps"))
    make = lambda raw, head, sps, pps: cabac.slice_of(raw, head, sps, pps, tables)
    return found.filter(_decodable(kinds, tables)).select("video", "frame", "seq", *_layout(), cavlc.motion(*fields, make).alias("motion"))


def h264_sequences(slices: DataFrame, tables: Tables, skip_every: int = 0) -> DataFrame:
    """As ``h264_motion``, with B slices.

    A B slice needs the motion of its collocated picture, so the pictures from an IDR
    picture to the next one are a group, in order, if one of them has a B slice; other
    slices are groups of their own. B slices without an earlier reference are left out.
    """
    numbered = _numbered(slices)
    is_b = F.col("unsupported").isNull() & (F.col("head.slice_type") == "B")
    first = F.struct("idr", "is_ref", F.col("head.poc_lsb").alias("lsb"), F.greatest("sps.log2_max_poc_lsb", F.lit(4)).alias("_bits"), "sps.poc_type")
    sizes = F.struct(F.col("head.num_ref_l0").alias("n0"), F.col("head.num_ref_l1").alias("n1"))
    pictures = numbered.groupBy("video", "frame").agg(
        F.min("seq").alias("seq"), F.min_by(first, "seq").alias("_f"), F.min_by(sizes, F.when(is_b, F.col("seq"))).alias("_n"), F.max(is_b).alias("_b")
    )
    pictures = display_order(pictures.select("video", "frame", "seq", "_f.*", "_n", "_b"), F.col("_bits"))
    in_order = Window.partitionBy("video").orderBy("seq")
    pictures = decimate(pictures.withColumn("_epoch", F.sum(F.col("idr").cast("int")).over(in_order)), skip_every)
    whole = F.max("_b").over(Window.partitionBy("video", "_epoch"))
    places = pictures.select("video", "frame", "_epoch", whole.alias("_whole"))
    known = pictures.filter("poc_type = 0").withColumn("video", F.struct("video", F.col("_epoch").alias("epoch")))
    col = collocated(known, n0=F.coalesce("_n.n0", F.lit(1)), n1=F.coalesce("_n.n1", F.lit(1))).select("video.video", "frame", "col_frame")
    rows = numbered.filter(_decodable(("I", "P", "B"), tables)).join(places, ["video", "frame"]).join(col, ["video", "frame"], "left")
    rows = rows.filter((F.col("head.slice_type") != "B") | F.col("col_frame").isNotNull())
    rows = rows.select(
        *("video", "frame", "seq", *_layout(), "_epoch", F.when(F.col("_whole"), -1).otherwise(F.col("seq")).alias("_alone")),
        *("col_frame", "is_ref", "payload", "head", "sps", "pps"),
    )
    out = rows.select("video", "frame", "seq", "slice_type", "cabac", "first_mb", "n_pic_mbs", "width_mbs").schema.add("motion", T.DataType.fromDDL(cavlc.MOTION_TYPE))

    def run(table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        found = cabac.decode_sequence(sorted(table.to_pylist(), key=lambda r: r["seq"]), tables)
        return pa.Table.from_pylist([{n: r[n] for n in out.names} for r in found], schema=to_arrow_schema(out))

    return rows.groupBy("video", "_epoch", "_alone").applyInArrow(run, out)


def h264_vectors(slices: DataFrame, skip_every: int = 0, tables: Tables | None = None, b_slices: bool = False) -> DataFrame:
    """Vectors: video, frame, seq, source, w, h, cx, cy, mv_x, mv_y and end points.

    Of P slices with variable-length codes; with ``tables`` of all P slices, and of B slices
    if ``b_slices``. ``seq`` orders a picture's rows; vectors of no length are among them.
    """
    if b_slices and tables:
        return vectors_of(h264_sequences(slices, tables, skip_every))
    return vectors_of(h264_motion(slices, skip_every, ("P",), tables))


def vectors_of(found: DataFrame, kept: tuple[str, ...] = ("video", "frame")) -> DataFrame:
    """Rows of decoded slices' partitions, with the columns ``kept`` of their slices."""
    blocks = found.select(*kept, "width_mbs", F.explode("motion.blocks").alias("_b")).select(*kept, "width_mbs", "_b.*")
    place = {"mbx": F.col("mb") % F.col("width_mbs"), "mby": F.floor(F.col("mb") / F.col("width_mbs")).cast("int")}
    rows = expand(blocks.withColumns(place).drop("width_mbs"))
    rows = rows.withColumn("seq", F.col("mb") * 8 + F.col("turn"))
    return export(rows.select(*kept, "seq", "source", "w", "h", "cx", "cy", "mv_x", "mv_y"), "h264")


def h264_pictures(slices: DataFrame) -> DataFrame:
    """One row for each picture, with the fields of its first slice and its slices' counts.

    ``poc`` is null where the display order isn't coded by low bits.
    """
    rows = assemble_pictures(slices.withColumn("first_mb", F.col("head.first_mb")))
    of_type = lambda t: F.count_if(F.col("head.slice_type") == t)
    pictures = rows.groupBy("video", "frame").agg(
        F.min("seq").alias("seq"),
        F.min_by(F.struct("idr", "is_ref", F.col("head.poc_lsb").alias("lsb"), "sps.poc_type", "sps.log2_max_poc_lsb"), "seq").alias("_first"),
        F.count("*").alias("n_slices"),
        *(of_type(t).alias(f"n_{t.lower()}") for t in "IPB"),
        F.min("head.slice_qp").alias("qp_min"),
        F.max("head.slice_qp").alias("qp_max"),
        F.count("unsupported").alias("n_unsupported"),
    )
    pictures = pictures.select("*", "_first.*").drop("_first")
    ordered = display_order(pictures, F.greatest("log2_max_poc_lsb", F.lit(4)))
    return ordered.withColumn("poc", F.when(F.col("poc_type") == 0, F.col("poc"))).drop("poc_type", "log2_max_poc_lsb")


def hevc_slices(units: DataFrame) -> DataFrame:
    """video, seq, packet, nal_type, temporal_id, head, sps, pps, bytes, unsupported of each segment.

    As ``h264_slices``; the payload isn't kept, only its size in ``bytes``. ``unsupported``
    is set for tiles, wavefronts and dependent segments.
    """
    kind, payload = F.col("nal_type"), F.col("payload")
    coded = X.is_vcl(kind, "hevc")
    # A header begins with a flag, a second one in pictures to begin with, and the set's id.
    start = F.lpad(F.conv(F.hex(F.substring(payload, 1, 4)), 16, 2), 8 * F.least(F.length(payload), F.lit(4)), F.lit("0"))
    code = F.substr(start, F.when(X.is_irap(kind), 3).otherwise(2))
    zeros = F.length(code) - F.length(F.ltrim(code, F.lit("0")))
    rows = units.filter((F.col("codec") == "hevc") & (kind.isin(33, 34) | coded)).select(
        F.col("path").alias("video"),
        F.col("nal_no").alias("seq"),
        *("packet", "nal_type", "temporal_id"),
        F.when(coded, payload).alias("payload"),
        syntax.hevc_sps(F.when(kind == 33, payload)).alias("_sps"),
        syntax.hevc_pps(F.when(kind == 34, payload)).alias("_pps"),
        F.when(coded, X.ue_value(F.substr(code, F.lit(1), 2 * zeros + 1))).alias("_id"),
    )
    keep = ("video", "seq", "packet", "nal_type", "temporal_id", "payload")
    found = _with_sets(rows, syntax.HEVC_SPS_TYPE, syntax.HEVC_PPS_TYPE, keep)
    found = found.withColumn("head", syntax.hevc_slice(F.col("payload"), F.col("nal_type"), F.col("sps"), F.col("pps")))
    why = F.when(F.col("head.several_streams") == 1, "tiles or wavefronts").when(F.col("head.slice_type").isNull(), "dependent segment")
    return found.select(*keep[:-1], "head", "sps", "pps", F.length("payload").alias("bytes"), why.alias("unsupported"))


def hevc_pictures(slices: DataFrame) -> DataFrame:
    """One row for each picture: its first segment's fields, display count, lists and collocated count.

    ``l0`` and ``l1`` hold display counts of the pictures that the set of the first segment
    marks as used, nearest first, in turn from before and after; ``col_poc`` is the entry that temporal
    vectors come from, else null. Counts begin anew at IDR pictures and broken links.
    """
    rows = assemble_pictures(slices.withColumn("first_mb", 1 - F.col("head.first_in_picture")))
    first = F.struct("nal_type", "temporal_id", "head", F.col("sps.log2_max_poc_lsb").alias("_bits"))
    pictures = rows.groupBy("video", "frame").agg(F.min("seq").alias("seq"), F.min_by(first, "seq").alias("_first"), F.count("*").alias("n_slices"))
    pictures = pictures.select("video", "frame", "seq", "n_slices", "_first.*").withColumn("lsb", F.coalesce("head.poc_lsb", F.lit(0)))
    idr, broken = X.is_idr(F.col("nal_type"), "hevc"), X.is_bla(F.col("nal_type"))
    ordered = display_order(pictures, F.col("_bits"), anchor=F.col("temporal_id") == 0, restart=idr | broken)
    used = F.filter(F.arrays_zip("head.delta", "head.used"), lambda d: d["used"])
    side = lambda keep: F.transform(F.filter(used, keep), lambda d: F.col("poc") + d["delta"])
    # Sets are sorted; the nearest picture comes first on either side.
    before, after = F.reverse(side(lambda d: d["delta"] < 0)), side(lambda d: d["delta"] >= 0)
    size = lambda k: F.coalesce(F.col(f"head.refs_l{k}"), F.lit(0))
    listed = ordered.withColumns({"l0": reference_list(before, after, size(0)), "l1": reference_list(after, before, size(1))})
    entries = F.when(F.col("head.collocated_list") == 1, F.col("l1")).otherwise(F.col("l0"))
    col = F.when(F.col("head.uses_temporal_mvp") == 1, F.get(entries, F.coalesce("head.collocated_ref", F.lit(0))))
    return listed.select("video", "frame", "seq", "n_slices", "nal_type", "head.slice_type", "poc", "l0", "l1", col.alias("col_poc"))
