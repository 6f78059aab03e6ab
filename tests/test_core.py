import math
import random
import time
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinefield.functions import exprs as X
from kinefield.operators import compare as C
from kinefield.operators import pictures as P
from kinefield.operators import prediction as M
from kinefield.operators import vectors as V
from kinefield.sources import mvcsv, nal

WIDE = "frame int, source int, w int, h int, src_x double, src_y double, dst_x double, dst_y double, flags decimal(20,0), motion_x double, motion_y double, motion_scale double, seq int"


def test_texts_of_doubles(spark):
    cases = [
        (1.0, "1", "1.0"), (-0.0, "-0", "-0.0"), (0.0, "0", "0.0"), (12345678.5, "12345678.5", "12345678.5"),
        (1e16, "10000000000000000", "1e16"), (1.25e20, "125000000000000000000", "1.25e20"), (123456789012345.0, "123456789012345", "123456789012345.0"),
        (0.00025, "0.00025", "0.00025"), (-1.5e-7, "-0.00000015", "-1.5e-7"), (math.inf, "inf", "inf"), (-math.inf, "-inf", "-inf"), (math.nan, "NaN", "NaN"),
    ]
    df = spark.createDataFrame([(k, v) for k, (v, *_) in enumerate(cases)], "k int, v double")
    got = {r.k: (r.p, r.s, r.c) for r in df.select("k", X.plain_text(F.col("v")).alias("p"), X.short_text(F.col("v")).alias("s"), mvcsv._float(F.col("v")).alias("c")).collect()}
    assert got == {k: (p, s, s) for k, (_, p, s) in enumerate(cases)}


def test_files_compare_end_to_end(spark, tmp_path):
    row = (0, -1, 16, 16, 0.5, 1.25, 12345678.5, 2.0, 18446744073709551615, 1e20, -0.0, 4.0)
    rows = [(*row, 0), (1, 1, 8, 8, math.inf, 3.0, 4.0, math.nan, 7, 0.0, 0.0, 0.0, 1), (2, 1, 8, 8, 1.0, 1.0, 1.0, 1.0, 0, 0.0, 0.0, 0.0, 2)]
    rows = [(*r[:8], Decimal(r[8]), *r[9:]) for r in rows]
    first = spark.createDataFrame(rows, WIDE)
    second = first.withColumn("dst_y", F.when(F.col("frame") == 0, 2.75).otherwise(F.col("dst_y"))).filter("frame < 2")
    a, b = (f"{tmp_path}/{n}" for n in "ab")
    assert mvcsv.write(first.coalesce(1), a, "full") == 3 and mvcsv.write(second.coalesce(1), b, "full") == 2
    back = mvcsv.read(spark, a).orderBy("seq").collect()
    assert len(back) == 3 and back[0].flags == 18446744073709551615 and back[0].motion_x == 1e20
    assert back[1].src_x == math.inf and math.isnan(back[1].dst_y)
    assert [r.message for r in C.report(C.compare_files(spark, a, a)).collect()] == [
        "Frame 1 src=(9223372036854775807,3) dst=(4,0) source=1: 'dst_y' differs (first=NaN, second=NaN)"
    ]
    found = [r.message for r in C.report(C.compare_files(spark, a, b)).collect()]
    assert found[0] == "Frame 0 src=(0,1) dst=(12345678,2) source=-1: 'dst_y' differs (first=2, second=2.75)" and len(found) == 2
    same = first.filter("frame = 0")
    C.write_report(C.compare(same, same), f"{tmp_path}/r")
    assert [r.value for r in spark.read.text(f"{tmp_path}/r").collect()] == [C.NO_DIFFERENCES]


def test_long_and_odd_vectors(spark):
    rows = [(0, 1, 0, 0, 64000, 64000), (0, 2, 5, 5, 5, 5)]
    df = spark.createDataFrame(rows, "frame int, seq int, src_x int, src_y int, dst_x int, dst_y int")
    assert V.min_size(df, 90000).count() == 1 and V.reduce_vectors(df, 1).count() == 1 and V.drop_zero(df).count() == 1
    nan = df.selectExpr("frame", "seq", *(f"double('nan') as {c}" for c in ("src_x", "src_y", "dst_x", "dst_y")))
    assert V.drop_zero(nan).count() == 2
    made = V.summary(df.select("frame").distinct(), df).first()
    assert (made.frames, made.mvs) == (1, 2) and V.summary(df, df, printed=False).first().mvs == 0
    assert V.sized(spark.sql("select 1 as w, 0 as h union all select 4, 4")).count() == 1


def test_display_order_after_a_broken_link(spark):
    rows = [(0, 0, True, 0, True), (0, 1, False, 12, True), (0, 2, False, 3, True), (0, 3, False, 5, True), (0, 4, False, 6, False)]
    df = spark.createDataFrame(rows, "video int, seq int, idr boolean, lsb int, is_ref boolean")
    plain = [r.poc for r in P.display_order(df, 4).orderBy("seq").collect()]
    assert plain == [0, -4, 3, 5, 6]
    broken = P.display_order(df, 4, restart=F.col("idr") | (F.col("seq") == 1))
    assert [r.poc for r in broken.orderBy("seq").collect()] == [0, 12, 19, 21, 22]


def test_rectangles_of_a_picture(spark):
    # The third row is broken by c, so the first rectangle has two.
    text = ["aab", "aab", "ac."]
    rows = [(0, x, y, None if c == "." else c) for y, line in enumerate(text) for x, c in enumerate(line)]
    df = spark.createDataFrame(rows, "frame int, bx int, by_ int, v string")
    got = sorted((r.by_, r.bx, r.width, r.height, r.v) for r in M.rectangles(df, "v").collect())
    assert got == [(0, 0, 2, 2, "a"), (0, 2, 1, 2, "b"), (2, 0, 1, 1, "a"), (2, 1, 1, 1, "c")]
    narrow = sorted((r.by_, r.bx, r.width, r.height) for r in M.rectangles(df.filter("v = 'a'"), "v", 1).collect())
    assert narrow == [(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1), (2, 0, 1, 1)]


def test_merged_vectors(spark):
    # Two equal blocks, one that differs only in a list it doesn't use, one that uses none.
    kind = "frame int, bx int, by_ int, l0 boolean, ref0 int, x0 int, y0 int, l1 boolean, ref1 int, x1 int, y1 int"
    rows = [(0, k, 0, True, 1, 9, -9, False, -1, 0, 0) for k in (0, 1)]
    rows += [(0, 2, 0, True, 1, 9, -9, False, -1, 0, 1), (0, 3, 0, False, -1, 9, 9, False, -1, 0, 0), (0, 4, 0, True, 0, 4, 0, True, 2, 0, 8)]
    out = V.export(M.merged_vectors(spark.createDataFrame(rows, kind), 4), "hevc").orderBy("seq")
    got = [(r.source, r.src_x, r.src_y, r.dst_x, r.dst_y) for r in out.collect()]
    assert got == [(-2, 4, 2, 6, -1), (-2, 10, 2, 12, -1), (-1, 18, 2, 19, 2), (3, 18, 2, 18, 4)]


def test_small_functions(spark):
    rows = spark.range(64).select("id", F.col("id").cast("int").alias("k"))
    rows = rows.withColumn("xy", X.block_xy(F.col("k") % 16))
    assert rows.filter(X.morton(F.col("xy.x"), F.col("xy.y"), 2) != F.col("k") % 16).count() == 0
    k = F.col("k")
    of = lambda c: {r.k for r in rows.filter(c).collect()}
    assert of(X.is_vcl(k)) == set(range(1, 6)) and of(X.is_vcl(k, "hevc")) == set(range(32))
    assert of(X.is_idr(k)) == {5} and of(X.is_idr(k, "hevc")) == {19, 20}
    assert of(X.is_irap(k)) == set(range(16, 24)) and of(X.is_bla(k)) == {16, 17, 18}
    one = rows.filter("k = 3").select(
        X.units_across(k + 62, 6).alias("a"), X.units_across(k + 61, 6).alias("b"), X.mb_height(k, F.lit(0)).alias("h"),
        X.chroma_blocks(F.lit(1))["down"].alias("c"), X.chroma_blocks(F.lit(2))["down"].alias("d"),
        X.clamp(k, 5, 9).alias("e"), X.least_non_negative(F.lit(-1), k, F.lit(7)).alias("f"), X.least_non_negative(F.lit(-1), F.lit(-2), F.lit(-1)).alias("g"),
    ).first()
    assert tuple(one) == (2, 1, 6, 2, 4, 5, 3, -1)


@pytest.mark.parametrize("size", [0, 1, 7, 4096])
def test_bits_against_text(size):
    rng = random.Random(size)
    data = bytes(rng.choice([0, 0, 1, 3, 255, rng.randrange(256)]) for _ in range(size))
    text, reader, at = "".join(f"{b:08b}" for b in data), nal.BitReader(data), 0
    assert reader.stop == max(text.rfind("1"), 0)
    while at < len(text):
        n = rng.randrange(0, 40)
        assert reader.read(n) == int((text[at : at + n]).ljust(n, "0") or "0", 2)
        at += n


def _read_signed(data):
    reader, out = nal.BitReader(data or b""), []
    while reader.more_data():
        out.append(reader.se())
    return out


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_signed_codes_of_odd_streams(block, monkeypatch):
    monkeypatch.setattr(nal, "_BLOCK", block)
    rng = random.Random(block)
    streams = [None, b"", b"\0", b"\0" * 9, b"\x80", b"\1", b"\0" * 40 + b"\1", b"\xff" * 20, "a b\n\u00e9".encode()]
    for _ in range(300):
        some = rng.choice([[0, 1, 255], [0, 0, 0, 0, 0, 0, 1], [0, 0, 0, 0, 128], range(256)])
        streams.append(bytes(rng.choice(some) for _ in range(rng.randrange(60))))
    for _ in range(100):  # prefixes of about 32 zeros, beyond which a code is 0
        text = "".join("0" * rng.randrange(28, 36) + "1" for _ in range(rng.randrange(1, 9)))
        streams.append(int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big"))
    found = [_read_signed(raw) for raw in streams]
    assert nal.decode_signed(streams).to_pylist() == found
    assert max(map(max, filter(None, found))) > 1 << 28 and min(map(min, filter(None, found))) < -1 << 28


def test_signed_codes_of_a_column(spark):
    streams = [None, b"", b"\xa6", b"\0\0\0\0\1", b"word " * 9000]
    rows = spark.createDataFrame(list(enumerate(streams)), "id int, data binary").repartition(2)
    found = rows.select("id", nal.signed_codes(F.col("data")).alias("codes")).collect()
    assert {r.id: r.codes for r in found} == {k: _read_signed(raw) for k, raw in enumerate(streams)}


def test_signed_codes_come_in_bounded_arrays():
    texts = [b"some words " * 20_000] * 30
    arrays = list(nal.signed_batches(iter([pa.array(texts[:29]), pa.array(texts[29:])])))
    assert [len(a) for a in arrays] == [5, 5, 5, 5, 5, 4, 1]
    assert all(a[-1:].equals(arrays[0][:1]) for a in arrays)


def test_signed_codes_take_little_time():
    """At least five times less than bit by bit; about fifty were measured."""
    data = b"some words " * 20_000

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    assert 5 * min(seconds(lambda: nal.decode_signed([data])) for _ in range(3)) < seconds(lambda: _read_signed(data))


def test_emulation_bytes():
    def slow(data):
        out, zeros = bytearray(), 0
        for k, b in enumerate(data):
            if zeros >= 2 and b == 3 and k + 1 < len(data) and data[k + 1] <= 3:
                zeros = 0
                continue
            out.append(b)
            zeros = zeros + 1 if b == 0 else 0
        return bytes(out)

    rng = random.Random(1)
    for _ in range(3000):
        data = bytes(rng.choice([0, 0, 0, 1, 3, 3, 9]) for _ in range(rng.randrange(14)))
        assert nal.rbsp_bytes(data) == slow(data), data
