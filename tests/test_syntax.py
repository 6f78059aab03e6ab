import pytest

from kinefield.sources import syntax as S
from kinefield.sources.nal import BitReader


def ue(n):
    bits = bin(n + 1)[2:]
    return "0" * (len(bits) - 1) + bits


def se(n):
    return ue(2 * n - 1 if n > 0 else -2 * n)


def pack(*bits):
    text = "".join(bits) + "1"
    text = text.ljust(-(-len(text) // 8) * 8, "0")
    return int(text, 2).to_bytes(len(text) // 8, "big")


def reader(*bits):
    return BitReader(pack(*bits))


def test_high_profile_scaling_lists_are_skipped():
    flat = [se(-8)]  # the second scale would be 0: the list ends
    coded = [se(1)] + [se(0)] * 15
    lists = ["1", *flat, "1", *coded, *["0"] * 6]
    head = [f"{100:08b}", "0" * 16, ue(3), ue(1), ue(0), ue(0), "0", "1", *lists]
    found = S.read(S.H264_SPS, reader(*head, ue(2), ue(2), ue(4), "0", ue(9), ue(7), "0", "1", "1"))
    names = ("sps_id", "log2_max_frame_num", "max_num_ref_frames", "width_in_mbs", "height_in_map_units", "frame_mbs_only", "mb_adaptive", "direct_8x8_inference")
    assert [found[n] for n in names] == [3, 6, 4, 10, 8, 0, 1, 1]


def test_picture_set_extension_only_if_data_remain():
    bits = [ue(1), ue(0), "10", ue(0), ue(2), ue(0), "000", se(-3), se(0), se(0), "100"]
    assert S.read(S.H264_PPS, reader(*bits))["transform_8x8_mode"] == 0
    found = S.read(S.H264_PPS, reader(*bits, "1", "0", se(0)))
    assert (found["transform_8x8_mode"], found["pic_init_qp"], found["num_ref_l0"], found["cabac"]) == (1, 23, 3, 1)


def test_b_slice_with_weights_and_marking():
    sps = S.read(S.H264_SPS, reader(f"{66:08b}", "0" * 16, ue(0), ue(0), ue(0), ue(0), ue(2), "0", ue(3), ue(3), "1", "1"))
    pps = S.read(S.H264_PPS, reader(ue(0), ue(0), "10", ue(0), ue(0), ue(0), "0", "01", se(0), se(0), se(0), "100"))
    bits = [
        *(ue(0), ue(6), ue(0), "0101", "0011", "1", "1", ue(1), ue(0)),  # direct, override to 2 and 1
        *("1", ue(0), ue(4), ue(3), "0"),  # changes of list 0
        *(ue(2), ue(2), "1", se(1), se(2), "0", "0", "1", *[se(1)] * 4, "0", "0"),  # weights
        *("1", ue(1), ue(5), ue(3), ue(0), ue(1), ue(0)),  # marking
        *(ue(2), se(4), ue(0), se(1), se(-1)),
    ]
    found = S.read(S.H264_SLICE, reader(*bits), sps | pps | {"is_idr": False, "ref_idc": 1})
    names = ("slice_type", "frame_num", "poc_lsb", "direct_spatial", "num_ref_l0", "num_ref_l1", "cabac_init_idc", "slice_qp", "data_bit")
    assert [found[n] for n in names] == ["B", 5, 3, 1, 2, 1, 2, 30, sum(map(len, bits))]


def _hevc_sps(sets):
    profile = ["00", "0", f"{1:05b}", "0" * 80, f"{93:08b}", "10", "0" * 14, "0" * 88]
    size = [ue(0), ue(1), ue(1920), ue(1080), "1", ue(0), ue(0), ue(0), ue(4), ue(0), ue(0), ue(4)]
    blocks = ["0", ue(4), ue(2), ue(0), ue(0), ue(3), ue(0), ue(3), ue(1), ue(2), "0", "1", "1", "0"]
    return ["0000", "001", "1", *profile, *size, *blocks, *sets, "0", "1", "0"]


def test_hevc_sequence_set():
    # -1 and -3; then that set moved by -1 with the middle entry kept but unused.
    first = [ue(2), ue(0), ue(0), "1", ue(1), "1"]
    second = ["1", "1", ue(0), "1", "01", "1"]
    found = S.read(S.HEVC_SPS, reader(*_hevc_sps([ue(2), *first, *second])))
    assert (found["width"], found["height"], found["log2_max_poc_lsb"], found["log2_ctb"], found["log2_max_tb"]) == (1920, 1080, 8, 6, 5)
    assert (found["amp"], found["sao"], found["pcm"], found["temporal_mvp"], found["profile_idc"]) == (1, 1, 0, 1, 1)
    assert found["short_term_sets"] == [{"delta": [-3, -1], "used": [True, True]}, {"delta": [-4, -2, -1], "used": [False, True, True]}]


def test_hevc_picture_set():
    bits = [ue(2), ue(1), "0", "0", "010", "1", "1", ue(1), ue(0), se(2), "0", "0", "1", ue(1), se(1), se(-1), "0000", "1", "0"]
    bits += [ue(1), ue(2), "0", ue(5), ue(6), ue(7), "1", "1", "1", "0", "0", se(0), se(0), "0", "1", ue(3), "1"]
    found = S.read(S.HEVC_PPS, reader(*bits))
    names = ("pps_id", "extra_header_bits", "init_qp", "cu_qp_delta_depth", "cr_offset", "tile_columns", "tile_rows", "lists_modification", "log2_parallel_merge", "header_extension")
    assert [found[n] for n in names] == [2, 2, 28, 1, -1, 2, 3, 1, 5, 1]


def _hevc_sets():
    sets = [ue(2), ue(2), ue(0), ue(0), "1", ue(1), "1", "0", ue(1), ue(1), ue(1), "1", ue(0), "1"]
    sps = S.read(S.HEVC_SPS, reader(*_hevc_sps(sets)))
    bits = [ue(0), ue(0), "1", "1", "010", "1", "1", ue(1), ue(0), se(2), "0", "0", "0", se(1), se(-1), "1", "1", "1", "0", "0", "0"]
    return sps, S.read(S.HEVC_PPS, reader(*bits, "1", "1", "1", "0", se(0), se(0), "0", "1", ue(3), "1"))


def test_hevc_b_slice():
    sps, pps = _hevc_sets()
    assert pps["lists_modification"] and pps["weighted_bipred"] and pps["deblocking_override"]
    bits = [
        *("0", ue(0), "0", f"{100:09b}", "11", ue(0), "1", "00001111"),  # second segment, extra bits, type, output, low bits
        *("0", "0", ue(1), ue(1), ue(2), "1", ue(4), "0"),  # a set of its own: -3 used, 5 unused
        *("1", "1", "0", "1", ue(1), ue(1)),  # temporal vectors, offsets, two entries in each list
        *("0", "1", "0"),  # one usable picture, so no list entries: zero differences, initial states, list 1
        *(ue(0), ue(3), se(0), "10", "01", se(1), se(2), *[se(1)] * 4, "00", "00"),  # collocated entry, weights
        *(ue(2), se(4), se(1), se(1), "1", "0", se(1), se(-1), "1"),
        *(ue(2), "00000000" * 2),  # extension
    ]
    found = S.read(S.HEVC_SLICE, reader(*bits), sps | pps | {"nal_type": 1})
    names = ("first_in_picture", "dependent", "address", "slice_type", "poc_lsb", "delta", "used", "refs_l0", "refs_l1", "mvd_l1_zero", "cabac_init")
    assert [found[n] for n in names] == [0, 0, 100, "B", 15, [-3, 5], [True, False], 2, 2, 0, 1]
    names = ("uses_temporal_mvp", "collocated_list", "collocated_ref", "max_merge", "slice_qp", "no_deblocking", "several_streams", "data_byte")
    assert [found[n] for n in names] == [1, 1, 0, 3, 32, 0, 0, sum(map(len, bits)) // 8 + 1]


def test_hevc_dependent_segment_and_idr():
    sps, pps = _hevc_sets()
    found = S.read(S.HEVC_SLICE, reader("0", ue(0), "1", f"{7:09b}", ue(0)), sps | pps | {"nal_type": 1})
    assert (found["dependent"], found["address"], found["slice_type"], found["slice_qp"], found["delta"]) == (1, 7, None, 28, [])
    idr = S.read(S.HEVC_SLICE, reader("1", "0", ue(0), "00", ue(2), "1", "11", se(-2), se(0), se(0), "0", "1", ue(0)), sps | pps | {"nal_type": 19})
    assert (idr["slice_type"], idr["poc_lsb"], idr["refs_l0"], idr["slice_qp"], idr["sao_luma"]) == ("I", 0, 0, 26, 1)


@pytest.mark.parametrize("seed", range(20))
def test_damaged_hevc_slices_end(seed):
    import random

    sps, pps = _hevc_sets()
    raw = random.Random(seed).randbytes(seed * 7)
    assert S.read(S.HEVC_SLICE, BitReader(raw), sps | pps | {"nal_type": seed})["data_byte"] > 0


def _sized(*units):
    return b"".join(len(u).to_bytes(2, "big") + u for u in units)


def test_records(spark):
    sps, pps = b"\x67\x42\x00", b"\x68\xce"
    whole = b"\x01\x42\x00\x1e\xff\xe1" + _sized(sps) + b"\x01" + _sized(pps)
    assert S.h264_record(whole) == {"length_size": 4, "units": [sps, pps]}
    assert S.h264_record(whole[:-1])["units"] == [sps]
    assert S.h264_record(whole[:9]) is None and S.h264_record(b"\x00" + whole[1:]) is None
    hevc = b"\x01" + bytes(20) + b"\x03\x02" + b"\x20\x00\x01" + _sized(b"\x40\x01\x0c") + b"\x21\x00\x01" + _sized(b"\x42\x01\xaa")
    assert [u[0] for u in S.hevc_record(hevc)["units"]] == [0x40, 0x42]
    assert [u[0] for u in S.hevc_record(hevc[:-1])["units"]] == [0x40]
    rows = spark.createDataFrame([(1, bytearray(whole)), (2, None), (3, bytearray())], "id int, extradata binary")
    assert [(r.id, r.length_size, r.nal_type, r.payload.hex()) for r in S.extradata(rows).collect()] == [(1, 4, 7, "4200"), (1, 4, 8, "ce")]


@pytest.mark.parametrize("table", [S.H264_SPS, S.H264_PPS, S.HEVC_SPS, S.HEVC_PPS])
@pytest.mark.parametrize("raw", [b"", b"\x00" * 40, b"\xff" * 40, bytes(range(256))])
def test_damaged_sets_end(table, raw):
    S.read(table, BitReader(raw))


def test_null_sets(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(None,)], "p binary")
    sets = rows.select("p", S.h264_sps(F.col("p")).alias("s"), S.h264_pps(F.col("p")).alias("q"), S.h264_slice_start(F.col("p")).alias("b"))
    row = sets.select("s", "q", "b", S.h264_slice(F.col("p"), F.lit(1), F.lit(1), F.col("s"), F.col("q")).alias("h")).first()
    assert (row.s, row.q, row.h, row.b) == (None, None, None, None)
