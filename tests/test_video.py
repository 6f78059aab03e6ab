import pytest

from kinefield.plans.pictures import h264_pictures, h264_slices
from kinefield.sources import video
from tests.test_syntax import _sized, pack, se, ue

SPS = b"\x67" + pack(f"{66:08b}", "0" * 16, ue(0), ue(0), ue(0), ue(0), ue(2), "0", ue(3), ue(3), "1", "1")
PPS = b"\x68" + pack(ue(0), ue(0), "00", ue(0), ue(0), ue(0), "000", se(0), se(0), se(0), "000")


def _slice(lsb, first=0, idr=False, ref=True, qp=0):
    start = [ue(first), ue(7 if idr else 5), ue(0), "0001", ue(0) if idr else "", f"{lsb:04b}", "" if idr else "00"]
    marking = ("00" if idr else "0") if ref else ""
    return bytes([(0x60 if ref else 0) | (5 if idr else 1)]) + pack(*start, marking, se(qp))


#: Two sequences; the low bits wrap up and, in display order, back.
UNITS = [_slice(0, idr=True), _slice(6), _slice(6, first=8, qp=4), _slice(12), _slice(2), _slice(0, ref=False), _slice(4), _slice(0, idr=True), _slice(8, ref=False)]
POCS = [0, 6, 12, 18, 16, 20, 0, 8]


def _box(kind, *content):
    body = b"".join(content)
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def _u32(*numbers):
    return b"".join(n.to_bytes(4, "big") for n in numbers)


def mp4(samples, per_chunk=2, kind=b"vide", long=False):
    record = b"\x01\x42\x00\x1e\xff\xe1" + _sized(SPS) + b"\x01" + _sized(PPS)
    coded = [_u32(len(s)) + s for s in samples]
    start, at, places = _box(b"ftyp", b"isom"), 0, []
    for k, s in enumerate(coded):
        if k % per_chunk == 0:
            places.append(at)
        at += len(s)
    base = len(start) + 8
    places = [p + base for p in places]
    offsets = _box(b"co64", _u32(0, len(places)), *(p.to_bytes(8, "big") for p in places)) if long else _box(b"stco", _u32(0, len(places), *places))
    entry = _box(b"avc1", bytes(78), _box(b"avcC", record))
    last = len(coded) % per_chunk
    runs = [1, per_chunk, 1] + ([len(places), last, 1] if last else [])
    table = _box(b"stbl", _box(b"stsd", _u32(0, 1), entry), _box(b"stsz", _u32(0, 0, len(coded), *map(len, coded))), _box(b"stsc", _u32(0, len(runs) // 3, *runs)), offsets)
    media = _box(b"mdia", _box(b"hdlr", _u32(0, 0), kind, bytes(12)), _box(b"minf", table))
    sound = _box(b"trak", _box(b"mdia", _box(b"hdlr", _u32(0, 0), b"soun", bytes(12))))
    return start + _box(b"mdat", *coded) + _box(b"moov", sound, _box(b"trak", media))


def annexb():
    return b"".join(b"\0\0\0\1" + u for u in (SPS, PPS, *UNITS))


def _files(spark, *rows):
    return spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")


@pytest.mark.parametrize("per_chunk, long", [(1, False), (2, True), (4, False)])
def test_container_gives_the_units_of_the_stream(spark, per_chunk, long):
    files = _files(spark, ("a.264", annexb()), ("b.mp4", mp4(UNITS, per_chunk, long=long)), ("c", None))
    rows = video.units(files).orderBy("path", "nal_no").collect()
    by = {p: [(r.codec, r.nal_no, r.nal_type, r.ref_idc, bytes(r.payload)) for r in rows if r.path == p] for p in ("a.264", "b.mp4", "c")}
    assert by["a.264"] == by["b.mp4"] and len(by["a.264"]) == len(UNITS) + 2 and not by["c"]


def test_files_without_video(spark):
    cut = mp4(UNITS)[:60]
    files = _files(spark, ("a", b""), ("b", b"text that is no video"), ("c", mp4(UNITS, kind=b"text")), ("d", cut), ("e", annexb()))
    assert {r.path for r in video.units(files, strict=False).collect()} == {"e"}
    for raw in (b"", cut):
        with pytest.raises(ValueError):
            list(video.packets("x", raw))


def test_pictures(spark):
    rows = video.units(_files(spark, ("a", annexb()), ("b", mp4(UNITS))))
    slices = h264_slices(rows)
    assert slices.filter("unsupported is null").count() == 2 * len(UNITS)
    for name in "ab":
        found = h264_pictures(slices.filter(f"video = '{name}'")).orderBy("frame").collect()
        assert [r.poc for r in found] == POCS
        assert [r.n_slices for r in found] == [1, 2, 1, 1, 1, 1, 1, 1]
        assert (found[0].n_i, found[1].n_p, found[1].qp_min, found[1].qp_max) == (1, 2, 26, 30)


def test_slices_before_their_sets_are_dropped(spark):
    early = b"".join(b"\0\0\1" + u for u in (UNITS[0], SPS, UNITS[0], PPS, UNITS[0], UNITS[1]))
    assert [r.seq for r in h264_slices(video.units(_files(spark, ("a", early)))).orderBy("seq").collect()] == [4, 5]
