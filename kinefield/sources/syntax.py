"""Parameter sets, slice headers and configuration records of H.264 and HEVC.

Syntax is held as tables, in the order of the published standards. A row of a table is a
name, a kind and, where the element is optional, a condition over the fields read so far.
Kinds: ``u<n>`` n bits, ``f`` a flag, ``ue`` and ``se`` Exp-Golomb codes, or a function of
(reader, fields). Names that begin with ``_`` are read and not returned.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinefield.sources.nal import BitReader, rbsp_bytes

Fields = dict

#: Profiles whose parameter sets have chroma and bit-depth fields.
CHROMA_PROFILES = (44, 83, 86, 100, 110, 118, 122, 128, 134, 135, 138, 139, 244)
#: Slice types by code modulo 5 (H.264) and by code (HEVC).
H264_TYPES = ("P", "B", "I", "SP", "SI")
HEVC_TYPES = ("B", "P", "I")
#: More entries than any valid stream has; a damaged count ends the parse there.
MOST = 1024


def read(table: list, reader: BitReader, known: Fields | None = None) -> Fields:
    """Fields of a syntax table; ``known`` are fields that conditions may also use."""
    f = dict(known or {})
    for name, kind, *when in table:
        if when and not when[0](f):
            f.setdefault(name, 0)
        elif callable(kind):
            f[name] = kind(reader, f)
        elif kind in ("ue", "se"):
            f[name] = getattr(reader, kind)()
        else:
            f[name] = reader.read(1 if kind == "f" else int(kind[1:]))
    return f


def repeat(table: list, count: Callable[[Fields], int]) -> Callable:
    """A kind: ``count`` times the table."""

    def run(reader: BitReader, f: Fields) -> list[Fields]:
        out = []
        for _ in range(min(count(f), MOST)):
            if reader.pos >= reader.size:
                break
            out.append(read(table, reader, f))
        return out

    return run


def plus(n: int, kind: str = "ue") -> Callable:
    """A kind: a code that stands for n more than it says."""
    return lambda reader, f: getattr(reader, kind)() + n


def _h264_scaling(reader: BitReader, f: Fields) -> None:
    for k in range(12 if f["chroma_format_idc"] == 3 else 8):
        if not reader.read(1):
            continue
        scale = 8
        for _ in range(16 if k < 6 else 64):
            following = (scale + reader.se()) % 256
            if not following:
                break  # the rest of the list repeats the last scale and isn't coded
            scale = following


def _high(f: Fields) -> bool:
    return f["profile_idc"] in CHROMA_PROFILES


H264_SPS = [
    ("profile_idc", "u8"),
    ("_constraints", "u8"),
    ("_level", "u8"),
    ("sps_id", "ue"),
    ("chroma_format_idc", lambda r, f: r.ue() if _high(f) else 1),
    ("separate_colour_plane", "f", lambda f: _high(f) and f["chroma_format_idc"] == 3),
    ("_depth_luma", "ue", _high),
    ("_depth_chroma", "ue", _high),
    ("_bypass", "f", _high),
    ("_has_scaling", "f", _high),
    ("_scaling", _h264_scaling, lambda f: f["_has_scaling"]),
    ("log2_max_frame_num", plus(4)),
    ("poc_type", "ue"),
    ("log2_max_poc_lsb", plus(4), lambda f: f["poc_type"] == 0),
    ("delta_poc_always_zero", "f", lambda f: f["poc_type"] == 1),
    ("_offset_non_ref", "se", lambda f: f["poc_type"] == 1),
    ("_offset_bottom", "se", lambda f: f["poc_type"] == 1),
    ("_cycle", "ue", lambda f: f["poc_type"] == 1),
    ("_offsets", repeat([("_offset", "se")], lambda f: f["_cycle"])),
    ("max_num_ref_frames", "ue"),
    ("_gaps", "f"),
    ("width_in_mbs", plus(1)),
    ("height_in_map_units", plus(1)),
    ("frame_mbs_only", "f"),
    ("mb_adaptive", "f", lambda f: not f["frame_mbs_only"]),
    ("direct_8x8_inference", "f"),
]

H264_PPS = [
    ("pps_id", "ue"),
    ("sps_id", "ue"),
    ("cabac", "f"),
    ("bottom_poc_present", "f"),
    ("num_slice_groups", plus(1)),
    ("num_ref_l0", plus(1)),
    ("num_ref_l1", plus(1)),
    ("weighted_pred", "f"),
    ("weighted_bipred_idc", "u2"),
    ("pic_init_qp", plus(26, "se")),
    ("_init_qs", "se"),
    ("_chroma_offset", "se"),
    ("deblocking_control_present", "f"),
    ("_constrained_intra", "f"),
    ("redundant_pic_cnt_present", "f"),
    ("transform_8x8_mode", lambda r, f: r.read(1) if r.more_data() else 0),
]


def _list_changes(reader: BitReader, f: Fields) -> None:
    if reader.read(1):
        while reader.pos < reader.size and reader.ue() != 3:
            reader.ue()


def _weights(reader: BitReader, f: Fields) -> None:
    chroma = f["chroma_format_idc"] != 0 and not f["separate_colour_plane"]
    reader.ue()
    if chroma:
        reader.ue()
    for n in (f["num_ref_l0"], f["num_ref_l1"] if _b(f) else 0):
        for _ in range(min(n, MOST)):
            for coded, numbers in ((True, 2), (chroma, 4)):
                if coded and reader.read(1):
                    for _ in range(numbers):
                        reader.se()


#: How many numbers follow each memory management operation.
_MARKING = {1: 1, 2: 1, 3: 2, 4: 1, 5: 0, 6: 1}


def _marking(reader: BitReader, f: Fields) -> None:
    if f["is_idr"]:
        reader.read(2)
    elif reader.read(1):
        while reader.pos < reader.size and (op := reader.ue()):
            for _ in range(_MARKING.get(op, 0)):
                reader.ue()


def _b(f: Fields) -> bool:
    return f["slice_type"] == "B"


def _inter(f: Fields) -> bool:
    return f["slice_type"] in ("P", "SP", "B")


def _weighted(f: Fields) -> bool:
    return bool(f["weighted_pred"]) if f["slice_type"] in ("P", "SP") else _b(f) and f["weighted_bipred_idc"] == 1


def _bottom(f: Fields) -> bool:
    return bool(f["bottom_poc_present"]) and not f["field_pic"]


#: Read with the fields of both parameter sets, ``is_idr`` and ``ref_idc``.
H264_SLICE = [
    ("first_mb", "ue"),
    ("slice_type", lambda r, f: H264_TYPES[r.ue() % 5]),
    ("_pps", "ue"),
    ("_plane", "u2", lambda f: f["separate_colour_plane"]),
    ("frame_num", lambda r, f: r.read(f["log2_max_frame_num"])),
    ("field_pic", "f", lambda f: not f["frame_mbs_only"]),
    ("bottom_field", "f", lambda f: f["field_pic"]),
    ("idr_pic_id", "ue", lambda f: f["is_idr"]),
    ("poc_lsb", lambda r, f: r.read(f["log2_max_poc_lsb"]), lambda f: f["poc_type"] == 0),
    ("_delta_bottom", "se", lambda f: f["poc_type"] == 0 and _bottom(f)),
    ("_delta0", "se", lambda f: f["poc_type"] == 1 and not f["delta_poc_always_zero"]),
    ("_delta1", "se", lambda f: f["poc_type"] == 1 and not f["delta_poc_always_zero"] and _bottom(f)),
    ("_redundant", "ue", lambda f: f["redundant_pic_cnt_present"]),
    ("direct_spatial", "f", _b),
    ("_override", "f", _inter),
    ("num_ref_l0", plus(1), lambda f: f["_override"]),
    ("num_ref_l1", plus(1), lambda f: f["_override"] and _b(f)),
    ("_changes0", _list_changes, _inter),
    ("_changes1", _list_changes, _b),
    ("_weights", _weights, _weighted),
    ("_marking", _marking, lambda f: f["ref_idc"]),
    ("cabac_init_idc", "ue", lambda f: f["cabac"] and _inter(f)),
    ("slice_qp", lambda r, f: f["pic_init_qp"] + r.se()),
    ("_switch", "f", lambda f: f["slice_type"] == "SP"),
    ("_qs", "se", lambda f: f["slice_type"] in ("SP", "SI")),
    ("disable_deblocking", "ue", lambda f: f["deblocking_control_present"]),
    ("_alpha", "se", lambda f: f["deblocking_control_present"] and f["disable_deblocking"] != 1),
    ("_beta", "se", lambda f: f["deblocking_control_present"] and f["disable_deblocking"] != 1),
    ("data_bit", lambda r, f: r.pos),
]


def _profile(reader: BitReader, f: Fields) -> int:
    """Profile, tier and level: 96 bits in all, then what sub-layers say."""
    reader.read(3)
    idc = reader.read(5)
    reader.read(88)
    layers = f["_sub_layers"]
    present = [reader.read(2) for _ in range(layers)]
    if layers:
        reader.read(2 * (8 - layers))
    for p in present:
        reader.read(88 * (p >> 1) + 8 * (p & 1))
    return idc


def _hevc_scaling(reader: BitReader, f: Fields) -> None:
    for size in range(4):
        for _ in range(0, 6, 3 if size == 3 else 1):
            if not reader.read(1):
                reader.ue()
                continue
            if size > 1:
                reader.se()
            for _ in range(min(64, 16 << 2 * size)):
                reader.se()


def short_term_set(reader: BitReader, earlier: list[dict], index: int, in_slice: bool = False) -> dict:
    """(delta, used) of a short-term reference picture set, sorted by delta.

    A predicted set shifts each delta of an earlier set, and that set's own picture (delta
    0), by one distance; deltas that come out as 0 or aren't kept fall away.
    """
    if index and reader.read(1):
        back = reader.ue() + 1 if in_slice else 1
        sign = -1 if reader.read(1) else 1
        shift = sign * (reader.ue() + 1)
        base = earlier[index - back] if 0 <= index - back < len(earlier) else {"delta": [], "used": []}
        # Coded in the order of the earlier set: nearest negatives first, then positives.
        order = sorted((d for d in base["delta"] if d < 0), reverse=True) + [d for d in base["delta"] if d > 0] + [0]
        found = {}
        for d in order:
            used = reader.read(1)
            kept = used or reader.read(1)
            if kept and d + shift:
                found[d + shift] = bool(used)
    else:
        counts = reader.ue(), reader.ue()
        found = {}
        for sign, n in zip((-1, 1), counts):
            at = 0
            for _ in range(min(n, 16)):
                at += sign * (reader.ue() + 1)
                found[at] = bool(reader.read(1))
    deltas = sorted(found)
    return {"delta": deltas, "used": [found[d] for d in deltas]}


def _short_term_sets(reader: BitReader, f: Fields) -> list[dict]:
    sets = []
    for k in range(min(reader.ue(), 64)):
        sets.append(short_term_set(reader, sets, k))
    return sets


HEVC_SPS = [
    ("_vps", "u4"),
    ("_sub_layers", "u3"),
    ("_nesting", "f"),
    ("profile_idc", _profile),
    ("sps_id", "ue"),
    ("chroma_format_idc", "ue"),
    ("separate_colour_plane", "f", lambda f: f["chroma_format_idc"] == 3),
    ("width", "ue"),
    ("height", "ue"),
    ("_window", "f"),
    ("_edges", repeat([("_edge", "ue")], lambda f: 4 * f["_window"])),
    ("_depth_luma", "ue"),
    ("_depth_chroma", "ue"),
    ("log2_max_poc_lsb", plus(4)),
    ("_ordering", "f"),
    ("_orders", repeat([("_a", "ue"), ("_b", "ue"), ("_c", "ue")], lambda f: f["_sub_layers"] + 1 if f["_ordering"] else 1)),
    ("log2_min_cb", plus(3)),
    ("log2_ctb", lambda r, f: f["log2_min_cb"] + r.ue()),
    ("log2_min_tb", plus(2)),
    ("log2_max_tb", lambda r, f: f["log2_min_tb"] + r.ue()),
    ("depth_inter", "ue"),
    ("depth_intra", "ue"),
    ("scaling_list", "f"),
    ("_own_scaling", "f", lambda f: f["scaling_list"]),
    ("_scaling", _hevc_scaling, lambda f: f["_own_scaling"]),
    ("amp", "f"),
    ("sao", "f"),
    ("pcm", "f"),
    ("_pcm_depths", "u8", lambda f: f["pcm"]),
    ("log2_min_pcm", plus(3), lambda f: f["pcm"]),
    ("log2_max_pcm", lambda r, f: f["log2_min_pcm"] + r.ue(), lambda f: f["pcm"]),
    ("_pcm_filter", "f", lambda f: f["pcm"]),
    ("short_term_sets", _short_term_sets),
    ("long_term", "f"),
    ("num_long_term", "ue", lambda f: f["long_term"]),
    ("_long", repeat([("_lsb", lambda r, f: r.read(f["log2_max_poc_lsb"])), ("_used", "f")], lambda f: f["num_long_term"])),
    ("temporal_mvp", "f"),
]

HEVC_PPS = [
    ("pps_id", "ue"),
    ("sps_id", "ue"),
    ("dependent_slices", "f"),
    ("output_flag_present", "f"),
    ("extra_header_bits", "u3"),
    ("sign_hiding", "f"),
    ("cabac_init_present", "f"),
    ("num_ref_l0", plus(1)),
    ("num_ref_l1", plus(1)),
    ("init_qp", plus(26, "se")),
    ("_intra", "f"),
    ("transform_skip", "f"),
    ("cu_qp_delta", "f"),
    ("cu_qp_delta_depth", "ue", lambda f: f["cu_qp_delta"]),
    ("cb_offset", "se"),
    ("cr_offset", "se"),
    ("chroma_offsets_present", "f"),
    ("weighted_pred", "f"),
    ("weighted_bipred", "f"),
    ("transquant_bypass", "f"),
    ("tiles", "f"),
    ("wavefront", "f"),
    ("tile_columns", lambda r, f: r.ue() + 1 if f["tiles"] else 1),
    ("tile_rows", lambda r, f: r.ue() + 1 if f["tiles"] else 1),
    ("_uniform", "f", lambda f: f["tiles"]),
    ("_sizes", repeat([("_size", "ue")], lambda f: f["tile_columns"] + f["tile_rows"] - 2), lambda f: f["tiles"] and not f["_uniform"]),
    ("_across_tiles", "f", lambda f: f["tiles"]),
    ("filter_across_slices", "f"),
    ("deblocking_control_present", "f"),
    ("deblocking_override", "f", lambda f: f["deblocking_control_present"]),
    ("deblocking_disabled", "f", lambda f: f["deblocking_control_present"]),
    ("_beta", "se", lambda f: f["deblocking_control_present"] and not f["deblocking_disabled"]),
    ("_tc", "se", lambda f: f["deblocking_control_present"] and not f["deblocking_disabled"]),
    ("_has_scaling", "f"),
    ("_scaling", _hevc_scaling, lambda f: f["_has_scaling"]),
    ("lists_modification", "f"),
    ("log2_parallel_merge", plus(2)),
    ("header_extension", "f"),
]

#: Most candidates of a merge, IDR types, and the first and last type of random access.
MOST_MERGED, HEVC_IDR, HEVC_ACCESS = 5, (19, 20), (16, 23)


def _count_bits(n: int) -> int:
    """Bits that tell n things apart."""
    return max(n - 1, 0).bit_length()


def _ctbs(f: Fields) -> int:
    return (-(-f["width"] >> f["log2_ctb"])) * (-(-f["height"] >> f["log2_ctb"]))


def _slice_set(reader: BitReader, f: Fields) -> dict:
    sets = f["short_term_sets"]
    if not reader.read(1):
        return short_term_set(reader, sets, len(sets), in_slice=True)
    index = reader.read(_count_bits(len(sets)))
    return sets[index] if index < len(sets) else {"delta": [], "used": []}


def _long_term(reader: BitReader, f: Fields) -> int:
    """How many long-term pictures the slice may use; those of the parameter set all count."""
    known = reader.ue() if f["num_long_term"] else 0
    own, used = reader.ue(), 0
    for k in range(min(known + own, MOST)):
        if k < known:
            reader.read(_count_bits(f["num_long_term"]))
            used += 1
        else:
            reader.read(f["log2_max_poc_lsb"])
            used += reader.read(1)
        if reader.read(1):
            reader.ue()
    return used


def _list_entries(reader: BitReader, f: Fields) -> None:
    bits = _count_bits(_usable(f))
    for n in (f["refs_l0"], *([f["refs_l1"]] if _b(f) else [])):
        if reader.read(1):
            reader.read(bits * min(n, 16))


def _usable(f: Fields) -> int:
    return (sum(map(bool, f["_set"]["used"])) if f["_set"] else 0) + f["_long_used"]


def _hevc_weights(reader: BitReader, f: Fields) -> None:
    chroma = f["chroma_format_idc"] != 0 and not f["separate_colour_plane"]
    reader.ue()
    if chroma:
        reader.se()
    for n in (f["refs_l0"], *([f["refs_l1"]] if _b(f) else [])):
        n = min(n, 16)
        luma = [reader.read(1) for _ in range(n)]
        colour = [reader.read(1) for _ in range(n)] if chroma else [0] * n
        for a, b in zip(luma, colour):
            for _ in range(2 * a + 4 * b):
                reader.se()


def _entries(reader: BitReader, f: Fields) -> None:
    if n := reader.ue():
        size = reader.ue() + 1
        for _ in range(n):
            if reader.pos >= reader.size:
                break
            reader.read(size)


def _whole(f: Fields) -> bool:
    return not f["dependent"]


def _hevc_inter(f: Fields) -> bool:
    return f["slice_type"] in ("P", "B")


def _not_idr(f: Fields) -> bool:
    return _whole(f) and f["nal_type"] not in HEVC_IDR


def _overrides(f: Fields) -> bool:
    return bool(f["_override_deblocking"])


def _several(f: Fields) -> bool:
    return bool(f["tiles"] or f["wavefront"])


#: Read with the fields of both parameter sets and ``nal_type``.
HEVC_SLICE = [
    ("first_in_picture", "f"),
    ("_no_output", "f", lambda f: HEVC_ACCESS[0] <= f["nal_type"] <= HEVC_ACCESS[1]),
    ("_pps", "ue"),
    ("dependent", "f", lambda f: not f["first_in_picture"] and f["dependent_slices"]),
    ("address", lambda r, f: r.read(_count_bits(_ctbs(f))), lambda f: not f["first_in_picture"]),
    ("_extra", lambda r, f: r.read(f["extra_header_bits"]), _whole),
    ("slice_type", lambda r, f: (HEVC_TYPES[c] if (c := r.ue()) < 3 else "I") if _whole(f) else None),
    ("_output", "f", lambda f: _whole(f) and f["output_flag_present"]),
    ("_plane", "u2", lambda f: _whole(f) and f["separate_colour_plane"]),
    ("poc_lsb", lambda r, f: r.read(f["log2_max_poc_lsb"]), _not_idr),
    ("_set", _slice_set, _not_idr),
    ("delta", lambda r, f: [int(d) for d in f["_set"]["delta"]] if f["_set"] else []),
    ("used", lambda r, f: [bool(u) for u in f["_set"]["used"]] if f["_set"] else []),
    ("_long_used", _long_term, lambda f: _not_idr(f) and f["long_term"]),
    ("uses_temporal_mvp", "f", lambda f: _not_idr(f) and f["temporal_mvp"]),
    ("sao_luma", "f", lambda f: _whole(f) and f["sao"]),
    ("sao_chroma", "f", lambda f: _whole(f) and f["sao"] and f["chroma_format_idc"] and not f["separate_colour_plane"]),
    ("_override", "f", _hevc_inter),
    ("refs_l0", lambda r, f: r.ue() + 1 if f["_override"] else f["num_ref_l0"], _hevc_inter),
    ("refs_l1", lambda r, f: r.ue() + 1 if f["_override"] else f["num_ref_l1"], _b),
    ("_entries_of_lists", _list_entries, lambda f: _hevc_inter(f) and f["lists_modification"] and _usable(f) > 1),
    ("mvd_l1_zero", "f", _b),
    ("cabac_init", "f", lambda f: _hevc_inter(f) and f["cabac_init_present"]),
    ("collocated_list", lambda r, f: 1 - r.read(1), lambda f: _b(f) and f["uses_temporal_mvp"]),
    ("collocated_ref", "ue", lambda f: _hevc_inter(f) and f["uses_temporal_mvp"] and f["refs_l1" if f["collocated_list"] else "refs_l0"] > 1),
    ("_weights", _hevc_weights, lambda f: f["weighted_pred"] if f["slice_type"] == "P" else _b(f) and f["weighted_bipred"]),
    ("max_merge", lambda r, f: MOST_MERGED - (r.ue() if _hevc_inter(f) else 0)),
    ("slice_qp", lambda r, f: f["init_qp"] + (r.se() if _whole(f) else 0)),
    ("_cb", "se", lambda f: _whole(f) and f["chroma_offsets_present"]),
    ("_cr", "se", lambda f: _whole(f) and f["chroma_offsets_present"]),
    ("_override_deblocking", "f", lambda f: _whole(f) and f["deblocking_override"]),
    ("no_deblocking", lambda r, f: r.read(1) if _overrides(f) else f["deblocking_disabled"]),
    ("_beta", "se", lambda f: _overrides(f) and not f["no_deblocking"]),
    ("_tc", "se", lambda f: _overrides(f) and not f["no_deblocking"]),
    ("_across", "f", lambda f: _whole(f) and f["filter_across_slices"] and (f["sao_luma"] or f["sao_chroma"] or not f["no_deblocking"])),
    ("_entry_points", _entries, _several),
    ("several_streams", lambda r, f: int(f["tile_columns"] > 1 or f["tile_rows"] > 1 or bool(f["wavefront"]))),
    ("_extension", lambda r, f: r.read(8 * min(r.ue(), 256)), lambda f: f["header_extension"]),
    ("data_byte", lambda r, f: r.pos // 8 + 1),
]

_SETS = "array<struct<delta:array<int>,used:array<boolean>>>"
_H264_SPS_COLS = [n for n, *_ in H264_SPS if n[0] != "_"]
_H264_PPS_COLS = [n for n, *_ in H264_PPS if n[0] != "_"]
_H264_SLICE_COLS = [n for n, *_ in H264_SLICE if n[0] != "_"]
_HEVC_SPS_COLS = [n for n, *_ in HEVC_SPS if n[0] != "_"]
_HEVC_PPS_COLS = [n for n, *_ in HEVC_PPS if n[0] != "_"]
_HEVC_SLICE_COLS = [n for n, *_ in HEVC_SLICE if n[0] != "_"]


def _type(names: list[str]) -> str:
    kinds = {"slice_type": "string", "short_term_sets": _SETS, "delta": "array<int>", "used": "array<boolean>"}
    return "struct<" + ",".join(f"{n}:{kinds.get(n, 'int')}" for n in names) + ">"


H264_SPS_TYPE, H264_PPS_TYPE = _type(_H264_SPS_COLS), _type(_H264_PPS_COLS)
H264_SLICE_TYPE = _type(_H264_SLICE_COLS)
HEVC_SLICE_TYPE = _type(_HEVC_SLICE_COLS)
HEVC_SPS_TYPE, HEVC_PPS_TYPE = _type(_HEVC_SPS_COLS), _type(_HEVC_PPS_COLS)


def _parser(table: list, names: list[str], kind: str) -> Callable[[Column], Column]:
    def one(raw):
        if raw is None:
            return []
        found = read(table, BitReader(bytes(raw)))
        return [{n: found[n] for n in names}]

    def column(payload: Column) -> Column:
        # A list of one, since a null payload has a null struct.
        @F.pandas_udf(f"array<{kind}>")
        def parse(payloads: pd.Series) -> pd.Series:
            return pd.Series([one(x) for x in payloads])

        return F.get(parse(payload), F.lit(0))

    return column


h264_sps = _parser(H264_SPS, _H264_SPS_COLS, H264_SPS_TYPE)
h264_pps = _parser(H264_PPS, _H264_PPS_COLS, H264_PPS_TYPE)
hevc_sps = _parser(HEVC_SPS, _HEVC_SPS_COLS, HEVC_SPS_TYPE)
hevc_pps = _parser(HEVC_PPS, _HEVC_PPS_COLS, HEVC_PPS_TYPE)


#: The fields before those that depend on parameter sets.
H264_START = [("first_mb", "ue"), ("slice_code", "ue"), ("pps_id", "ue")]
h264_slice_start = _parser(H264_START, [n for n, _ in H264_START], _type([n for n, _ in H264_START]))


def h264_slice(payload: Column, nal_type: Column, ref_idc: Column, sps: Column, pps: Column) -> Column:
    """Slice header fields; null where the payload or a parameter set is null.

    ``data_bit`` is the place of the slice data in the payload.
    """

    @F.pandas_udf(f"array<{H264_SLICE_TYPE}>")
    def parse(raws: pd.Series, kinds: pd.Series, refs: pd.Series, s: pd.DataFrame, p: pd.DataFrame) -> pd.Series:
        s, p = s[_H264_SPS_COLS].to_dict("records"), p[_H264_PPS_COLS].to_dict("records")
        out = []
        for raw, kind, ref, a, b in zip(raws, kinds, refs, s, p):
            if raw is None or pd.isna(a["sps_id"]) or pd.isna(b["pps_id"]):
                out.append([])
                continue
            known = {k: int(v) for k, v in (a | b).items()}
            found = read(H264_SLICE, BitReader(bytes(raw)), known | {"is_idr": kind == 5, "ref_idc": ref})
            out.append([{n: found[n] for n in _H264_SLICE_COLS}])
        return pd.Series(out)

    return F.get(parse(payload, nal_type, ref_idc, sps, pps), F.lit(0))


def hevc_slice(payload: Column, nal_type: Column, sps: Column, pps: Column) -> Column:
    """HEVC slice header fields; null where the payload or a parameter set is null.

    A dependent segment has no type of its own. ``data_byte`` is the place of the slice data
    in the payload, ``several_streams`` whether they are tiles or wavefronts.
    """

    @F.pandas_udf(f"array<{HEVC_SLICE_TYPE}>")
    def parse(raws: pd.Series, kinds: pd.Series, s: pd.DataFrame, p: pd.DataFrame) -> pd.Series:
        s, p = s[_HEVC_SPS_COLS].to_dict("records"), p[_HEVC_PPS_COLS].to_dict("records")
        out = []
        for raw, kind, a, b in zip(raws, kinds, s, p):
            if raw is None or pd.isna(a["sps_id"]) or pd.isna(b["pps_id"]):
                out.append([])
                continue
            sets = a.pop("short_term_sets")
            known = {k: int(v) for k, v in (a | b).items()} | {"short_term_sets": sets, "nal_type": int(kind)}
            found = read(HEVC_SLICE, BitReader(bytes(raw)), known)
            out.append([{n: found[n] for n in _HEVC_SLICE_COLS}])
        return pd.Series(out)

    return F.get(parse(payload, nal_type, sps, pps), F.lit(0))


def _records(raw: bytes, at: int, count: int) -> tuple[list[bytes], int, bool]:
    """Units after 16-bit lengths: those that are whole, where they end, and if all are."""
    found = []
    for _ in range(count):
        end = at + 2 + int.from_bytes(raw[at : at + 2], "big")
        if at + 2 > len(raw) or end > len(raw):
            return found, at, False
        found.append(raw[at + 2 : end])
        at = end
    return found, at, True


def h264_record(raw: bytes) -> dict | None:
    """Length size and parameter sets of an avcC record; None if it isn't one.

    A cut sequence set voids the record; a cut picture set ends it.
    """
    if len(raw) < 7 or raw[0] != 1:
        return None
    sets, at, whole = _records(raw, 6, raw[5] & 31)
    if not whole:
        return None
    if at < len(raw):
        sets += _records(raw, at + 1, raw[at])[0]
    return {"length_size": (raw[4] & 3) + 1, "units": sets}


def hevc_record(raw: bytes) -> dict | None:
    """Length size and parameter sets of an hvcC record, as far as it goes."""
    if len(raw) < 23 or raw[0] != 1:
        return None
    sets, at = [], 23
    for _ in range(raw[22]):
        if at + 3 > len(raw):
            break
        some, at, whole = _records(raw, at + 3, int.from_bytes(raw[at + 1 : at + 3], "big"))
        sets += some
        if not whole:
            break
    return {"length_size": (raw[21] & 3) + 1, "units": sets}


def extradata(records: DataFrame, column: str = "extradata", codec: str = "h264") -> DataFrame:
    """(other columns, length_size, unit, nal_type, payload): parameter sets of each record.

    Records that are null or of another kind give no row; so do empty units and those
    with the forbidden bit.
    """
    head, parse = (2, hevc_record) if codec == "hevc" else (1, h264_record)

    @F.pandas_udf("array<struct<length_size:int,unit:int,nal_type:int,payload:binary>>")
    def split(raws: pd.Series) -> pd.Series:
        def one(raw):
            found = parse(bytes(raw)) if raw is not None else None
            if not found:
                return []
            kept = [u for u in found["units"] if len(u) >= head and not u[0] & 0x80]
            kind = (lambda u: u[0] >> 1 & 63) if head == 2 else (lambda u: u[0] & 31)
            return [
                {"length_size": found["length_size"], "unit": k, "nal_type": kind(u), "payload": rbsp_bytes(u[head:])}
                for k, u in enumerate(kept)
            ]

        return raws.map(one)

    rest = [c for c in records.columns if c != column]
    return records.select(*rest, F.explode(split(F.col(column))).alias("_u")).select(*rest, "_u.*")
