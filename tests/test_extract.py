"""Options, counters, HEVC pictures and segments of a stream, on written streams."""

import random

import pytest

from kinefield.operators import vectors as V
from kinefield.plans import extract as E
from kinefield.plans.pictures import h264_pictures, h264_slices, h264_vectors, hevc_pictures, hevc_slices
from kinefield.sources import video
from kinefield.streaming import segments
from tests.test_cavlc import PPS, SPS, Writer, _escaped
from tests.test_syntax import _hevc_sps, pack, se, ue


def pictures(n=6, seed=3):
    """Units of n pictures of 3 x 3 macroblocks, in two slices each."""
    rng, units = random.Random(seed), []
    for frame in range(n):
        for first, count in ((0, 4), (4, 5)):
            idr = frame == 0
            start = [ue(first), ue(7 if idr else 5), ue(0), f"{frame % 16:04b}", ue(0) if idr else "", f"{frame * 2 % 16:04b}", "" if idr else "00", "00" if idr else "0", se(first)]
            lead = "".join(start)
            writer = Writer(rng, 3, 3, first, 1, 1, 0, inter=not idr)
            units.append(bytes([0x65 if idr else 0x61]) + pack(lead + writer.write(count, len(lead))))
    return units


def stream(units):
    return b"".join(b"\0\0\1" + _escaped(u) for u in units)


def files(spark, *rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


@pytest.fixture(scope="module")
def units(spark):
    cut = pictures(4, 8)
    cut[3] = cut[3][: len(cut[3]) // 2]
    b_slice = b"\x01" + pack(ue(0), ue(6), ue(0), "0010", "0010")
    return video.units(files(spark, ("a.264", stream([SPS, PPS, *pictures()])), ("b.264", stream([SPS, PPS, *cut, b_slice])))).cache()


def test_options(spark, units):
    rows = h264_vectors(h264_slices(units))
    every = E.extract(units)
    assert every.count() == V.drop_zero(rows).count() > 20
    assert {r.frame for r in E.extract(units, E.Options(skip_every=2)).select("frame").distinct().collect()} <= {1, 3, 5}
    want = V.drop_zero(rows).filter("frame % 2 = 1").count()
    assert E.extract(units, E.Options(skip_every=2)).count() == want
    full = E.extract(units, E.Options(layout="full", min_size=2, grid=32))
    assert full.columns[3:] == ["source", "w", "h", "src_x", "src_y", "dst_x", "dst_y", "flags", "motion_x", "motion_y", "motion_scale"]
    cells = [(r.video, r.frame, int(r.dst_x) // 32, int(r.dst_y) // 32) for r in full.collect()]
    assert len(cells) == len(set(cells)) > 0
    assert all((r.src_x - r.dst_x) ** 2 + (r.src_y - r.dst_y) ** 2 >= 4 for r in full.collect())
    assert E.extract(units, E.Options(printed=False)).count() == 0
    with pytest.raises(ValueError):
        E.Options(layout="wide")


def test_counters(spark, units):
    a, b = E.counters(units).orderBy("video").collect()
    assert (a.frames, a.cavlc_decoded, a.parse_errors, a.incomplete, a.i_slices, a.p_slices) == (6, 12, 0, 6, 2, 10)
    assert (a.qp_min, a.qp_max, a.width, a.height, a.profile_idc, a.hevc) == (26, 30, 48, 48, 66, False)
    assert (b.frames, b.b_skipped, b.b_slices, b.cavlc_decoded, b.cabac_decoded) == (5, 1, 1, 8, 0)
    assert b.parse_errors == 1
    skipped = E.counters(units, E.Options(skip_every=2)).orderBy("video").first()
    assert (skipped.frames, skipped.cavlc_decoded) == (6, 6)
    both = E.merged(E.counters(units)).first()
    assert (both.frames, both.cavlc_decoded, both.qp_min) == (11, 20, 26)
    none = E.counters(units.limit(0))
    assert none.count() == 0 and E.merged(none).first().qp_min == E.NO_QP


def test_run_writes_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.264").write_bytes(stream([SPS, PPS, *pictures()]))
    out = str(tmp_path / "out")
    frames, n = E.run(spark, str(tmp_path / "in"), out)
    rows = spark.read.csv(out, header=True, inferSchema=True)
    assert frames == 6 and n == rows.count() > 10
    assert rows.columns == ["frame", "source", "src_x", "src_y", "dst_x", "dst_y"]
    assert E.run(spark, str(tmp_path / "in")) == (6, 0)


def hevc_units():
    sets = [ue(2), ue(2), ue(0), ue(0), "1", ue(1), "1", "0", ue(1), ue(1), ue(1), "1", ue(0), "1"]
    sps = b"\x42\x01" + pack(*_hevc_sps(sets))
    # One slice type field, no extra bits: the plainest picture set.
    pps = b"\x44\x01" + pack(ue(0), ue(0), "0", "0", "000", "0", "0", ue(0), ue(0), se(0), "0", "0", "0", se(0), se(0), "0", "0", "0", "0", "0", "0", "0", "0", "0", "0", ue(0), "0")
    return sps, pps


def hevc_slice(kind, lsb=None, code=2, first=True, own=(), used=1):
    """A segment; its own set has the differences ``own`` before it, one after another."""
    bits = ["1" if first else "0"]
    if 16 <= kind <= 23:
        bits.append("0")
    bits += [ue(0)] + ([] if first else [f"{100:09b}"]) + [ue(code)]
    if kind not in (19, 20):
        bits += [f"{lsb:08b}", "0", "0", ue(len(own)), ue(0)]
        bits += [b for d in own for b in (ue(d - 1), str(used))]
        bits += ["0"]  # temporal vectors
    bits += ["00"]  # SAO of both
    if code < 2:
        bits += ["0"] + (["0"] if code == 0 else []) + [ue(0)]
    bits += [se(3), "0"]
    return bytes([kind << 1, 1]) + pack(*bits, "1" * 40)


def test_hevc_pictures(spark):
    sps, pps = hevc_units()
    coded = [
        *(hevc_slice(19), hevc_slice(1, 4, 1, own=(4,)), hevc_slice(1, 4, 1, first=False, own=(4,)), hevc_slice(1, 130, 1, own=(126, 4))),
        *(hevc_slice(1, 2, 0, own=(128,)), hevc_slice(16, 7), hevc_slice(1, 9, 1, own=(2,), used=0)),
    ]
    found = hevc_slices(video.units(files(spark, ("v.265", stream([sps, pps, *coded])))))
    rows = hevc_pictures(found).orderBy("frame").collect()
    assert [r.n_slices for r in rows] == [1, 2, 1, 1, 1, 1]
    assert [r.slice_type for r in rows] == ["I", "P", "P", "B", "I", "P"]
    # 2 is half the range below 130, so it has wrapped; the broken link counts anew.
    assert [r.poc for r in rows] == [0, 4, 130, 258, 7, 9]
    assert [r.l0 for r in rows] == [[], [0], [4], [130], [], []]
    assert [r.l1 for r in rows] == [[], [], [], [130], [], []]
    got = E.counters(video.units(files(spark, ("v.265", stream([sps, pps, *coded]))))).first()
    assert (got.hevc, got.frames, got.i_slices, got.p_slices, got.b_slices, got.dependent) == (True, 6, 2, 4, 1, 0)
    assert (got.width, got.height, got.ctb, got.qp_min, got.qp_max) == (1920, 1080, 64, 29, 29)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_segments_give_the_vectors_of_the_whole(spark, tmp_path, order):
    """Pictures over three segments, parameter sets in the first alone, in any order."""
    coded = pictures(20)
    want = video.units(files(spark, ("v", stream([SPS, PPS, *coded]))))
    parts = [stream([SPS, PPS, *coded[:11]]), stream(coded[11:24]), stream(coded[24:])]
    folder = tmp_path / "in" / "v"
    folder.mkdir(parents=True)
    for k in order:
        (folder / f"{k}.264").write_bytes(parts[k])
        found = segments.slices(segments.read(spark, str(tmp_path / "in"), 1))
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).start().awaitTermination(120)
    rows = spark.read.schema(segments.SLICES).parquet(str(tmp_path / "out"))
    slices = h264_slices(want)
    pocs = {r.frame: r.poc for r in h264_pictures(slices).collect()}
    assert {r.frame: r.poc for r in rows.collect()} == pocs and len(pocs) == 20
    last = rows.filter("frame = 19").first()
    assert [h.frame for h in last.held] == list(range(3, 19)) and rows.filter("frame = 0").first().held == []
    columns = ["frame", "seq", "cx", "cy", "mv_x", "mv_y"]
    assert sorted(segments.vectors(rows).select(columns).collect()) == sorted(h264_vectors(slices).select(columns).collect())


def test_missing_segments(spark):
    known = segments.Sequence()
    assert known.unit(1, 1, pack(ue(0), ue(5), ue(0))) is None
    again = segments.Sequence(known.dump())
    assert (again.next, again.frame, again.held, again.waiting) == (0, -1, [], {})
