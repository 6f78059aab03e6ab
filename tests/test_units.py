import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinefield.functions import exprs as X
from kinefield.operators import compare as C
from kinefield.operators import vectors as V
from kinefield.sources import mvcsv, nal


def bits(text):
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_bit_order():
    r = nal.BitReader(b"\xb2")
    assert (r.read(4), r.read(4)) == (11, 2)


@pytest.mark.parametrize("code, n", [("1", 0), ("010", 1), ("011", 2), ("00100", 3), ("00111", 6), ("0001000", 7)])
def test_ue(code, n):
    assert nal.BitReader(bits(code)).ue() == n


@pytest.mark.parametrize("code, n", [("1", 0), ("010", 1), ("011", -1), ("00100", 2), ("00101", -2), ("00110", 3)])
def test_se(code, n):
    assert nal.BitReader(bits(code)).se() == n


@pytest.mark.parametrize("raw, out", [("00000301", "000001"), ("00000300000302", "0000000002"), ("010304", "010304")])
def test_emulation(raw, out):
    assert nal.rbsp_bytes(bytes.fromhex(raw)).hex() == out


def _escaped(data):
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.lists(st.sampled_from([0, 1, 2, 3, 9]), max_size=30))
def test_emulation_round_trip(a, b):
    data = a + bytes(b)
    assert nal.rbsp_bytes(_escaped(data)) == data


def test_splits():
    stream = bytes.fromhex("000000016742000000 0168ce".replace(" ", ""))
    assert [u[0] & 31 for u in nal.split_annexb(stream)] == [7, 8]
    assert [u.hex() for u in nal.split_lengths(bytes.fromhex("0000000361aabb"), 4)] == ["61aabb"]
    assert list(nal.split_lengths(bytes.fromhex("0000000961aabb"), 4)) == []
    hevc = bytes.fromhex("0000000140010c000001420101")
    assert [u[0] >> 1 & 63 for u in nal.split_annexb(hevc)] == [32, 33]


def test_units_of_null_and_empty(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray())], "id int, data binary")
    assert nal.units(rows).count() == 0


def test_context_state(spark):
    row = spark.range(1).select(X.context_state(F.lit(0), F.lit(56), F.lit(26)).alias("s")).first()
    assert row.s == 2 * (63 - 56)


def _mv(spark, rows):
    return spark.createDataFrame(rows, "seq long, frame int, source int, src_x double, src_y double, dst_x double, dst_y double")


def test_reduce_keeps_order_of_few(spark):
    rows = _mv(spark, [(1, 0, -1, 0.0, 0.0, 3.0, 0.0), (2, 0, -1, 0.0, 0.0, 9.0, 0.0), (3, 0, -1, 0.0, 0.0, 2.0, 0.0)])
    assert {r.seq: r.place for r in V.reduce_vectors(rows, 2).collect()} == {1: 1, 2: 2}
    assert {r.seq: r.place for r in V.reduce_vectors(rows, 1).collect()} == {2: 1}


def test_compare_of_equal_sets(spark):
    rows = _mv(spark, [(1, 0, -1, 0.0, 0.0, 3.0, 0.0), (2, 0, -1, 5.0, 5.0, 5.0, 5.0)])
    assert [r.message for r in C.report(C.compare(rows, rows)).collect()] == [C.NO_DIFFERENCES]


def test_compare_messages(spark):
    a = _mv(spark, [(1, 0, -1, 0.25, 0.0, 3.0, 0.0), (2, 1, 1, 0.0, 0.0, 1.0, 1.0), (3, 1, 1, 0.0, 0.0, 1.0, 1.0)])
    b = _mv(spark, [(1, 0, -1, 0.75, 0.0, 3.0, 0.0), (2, 1, 1, 0.0, 0.0, 1.0, 1.0)])
    assert [r.message for r in C.report(C.compare(a, b)).collect()] == [
        "Frame 0 src=(0,0) dst=(3,0) source=-1: 'src_x' differs (first=0.25, second=0.75)",
        "Frame 1 src=(0,0) dst=(1,1) source=1: extra row in first file (index 1)",
    ]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("src_x,frame,src_y,flags,junk\n1.5,3.7,2,0x1F,q\n\nnan,1e1,inf,0xZZ,\nx,1,2,3,4\n1.0d,1,2,3,4\n")
    rows = {r.frame: r for r in mvcsv.read(spark, str(tmp_path / "a.csv")).collect()}
    assert sorted(rows) == [3, 10]
    assert (rows[3].src_x, rows[3].dst_x, int(rows[3].flags), rows[3].w) == (1.5, 1.5, 31, 0)
    assert (rows[10].src_y, int(rows[10].flags)) == (float("inf"), 0)
    (tmp_path / "b.csv").write_text("frame,src_x\n1,2\n")
    with pytest.raises(ValueError):
        mvcsv.read(spark, str(tmp_path / "b.csv"))


def test_csv_write(spark, tmp_path):
    rows = spark.createDataFrame([(1, -1, 2, 3, 4, 5)], "frame int, source int, src_x int, src_y int, dst_x int, dst_y int")
    assert mvcsv.write(rows, str(tmp_path / "out")) == 1
    back = mvcsv.read(spark, str(tmp_path / "out")).first()
    assert (back.frame, back.source, back.dst_y) == (1, -1, 5.0)


def test_entry_imports_without_the_corpus_part():
    import __spark_entry__ as e

    assert "mv_frame_summary" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
