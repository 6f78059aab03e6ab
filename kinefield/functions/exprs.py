"""Column expressions of the bitstream and motion arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, n: int) -> Column:
    """Integer division that truncates towards zero."""
    return F.when(a >= 0, F.floor(a / n)).otherwise(F.ceil(a / n)).cast("int")


def wrap_i16(x: Column) -> Column:
    """Narrowed to 16 bits, wrapping."""
    return (((x + 32768).bitwiseAND(65535)) - 32768).cast("short")


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def least_non_negative(*xs: Column) -> Column:
    """The least value that isn't negative; -1 if all are."""
    return F.coalesce(F.array_min(F.filter(F.array(*xs), lambda x: x >= 0)), F.lit(-1))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ceil_log2(n: Column) -> Column:
    return F.when(n <= 1, 0).otherwise(F.length(F.bin((n - 1).cast("long")))).cast("int")


def ue_bits(n: Column) -> Column:
    """The unsigned Exp-Golomb code of n as text of 0 and 1."""
    bits = F.bin((n + 1).cast("long"))
    return F.concat(F.repeat(F.lit("0"), F.length(bits) - 1), bits)


def se_bits(n: Column) -> Column:
    """The signed Exp-Golomb code of n as text of 0 and 1."""
    return ue_bits(F.when(n > 0, 2 * n - 1).otherwise(-2 * n))


def fixed_bits(n: Column, width: Column | int) -> Column:
    return F.lpad(F.bin(n.cast("long")), F.lit(width) if isinstance(width, int) else width, F.lit("0"))


def packed(bits: Column) -> Column:
    """Bytes of text of 0 and 1, with a stop bit and zeros after them."""
    ended = F.concat(bits, F.lit("1"))
    last = F.floor((F.length(ended) - 1) / 8).cast("int")
    byte = lambda k: F.lpad(F.conv(F.rpad(F.substr(ended, k * 8 + 1, F.lit(8)), 8, "0"), 2, 16), 2, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), last), byte), ""))


def ue_value(bits: Column) -> Column:
    """The number that an unsigned Exp-Golomb code stands for."""
    return (F.conv(F.ltrim(bits, F.lit("0")), 2, 10).cast("long") - 1).cast("int")


def se_value(code: Column) -> Column:
    """Signed value of an unsigned code: 0, 1, -1, 2, -2, ..."""
    k = F.shiftright(code + 1, 1)
    return F.when(code % 2 == 1, k).otherwise(-k)


def morton(x: Column, y: Column, bits: int = 4) -> Column:
    """Bits of x and y interleaved, x lowest."""
    out = F.lit(0)
    for k in range(bits):
        out = out + F.shiftleft(F.shiftright(x, k).bitwiseAND(1), 2 * k) + F.shiftleft(F.shiftright(y, k).bitwiseAND(1), 2 * k + 1)
    return out


def block_xy(index: Column) -> Column:
    """(x, y) of a 4x4 block of a macroblock, in blocks; ``morton`` of them is the index."""
    bit = lambda k: F.shiftright(index, k).bitwiseAND(1)
    return F.struct((bit(0) + 2 * bit(2)).alias("x"), (bit(1) + 2 * bit(3)).alias("y"))


def units_across(size: Column, log2: int) -> Column:
    """How many blocks of 2**log2 cover a size."""
    return F.shiftright((size + ((1 << log2) - 1)).cast("int"), log2)


def mb_height(map_units: Column, frame_mbs_only: Column) -> Column:
    """Macroblock rows of a picture; map units are pairs of rows where fields may be coded."""
    return (2 - frame_mbs_only.cast("int")) * map_units


def chroma_blocks(format_idc: Column) -> Column:
    """4x4 blocks (across, down) of one chroma plane of a macroblock."""
    across = F.when(format_idc == 3, 4).when(format_idc == 0, 0).otherwise(2)
    down = F.when(format_idc == 1, 2).when(format_idc == 0, 0).otherwise(4)
    return F.struct(across.alias("across"), down.alias("down"))


def context_state(m: Column, n: Column, qp: Column) -> Column:
    """The first state of an arithmetic decoder's context: twice the index, plus the bit."""
    pre = F.least(F.greatest(F.shiftright(m * F.least(F.greatest(qp, F.lit(0)), F.lit(51)), 4) + n, F.lit(1)), F.lit(126))
    return F.when(pre <= 63, 2 * (63 - pre)).otherwise(2 * (pre - 64) + 1)


def scale_by_distance(mv: Column, td: Column, tb: Column) -> Column:
    """A vector over td scaled to tb, both display distances; td isn't 0."""
    td, tb = (F.least(F.greatest(x, F.lit(-128)), F.lit(127)) for x in (td, tb))
    tx = _trunc(16384 + _trunc(F.abs(td), F.lit(2)), td)
    factor = F.least(F.greatest(F.shiftright((tb * tx + 32).cast("int"), 6), F.lit(-4096)), F.lit(4095))
    product = factor * mv
    size = F.shiftright((F.abs(product) + 127).cast("int"), 8)
    return F.least(F.greatest(F.signum(product).cast("int") * size, F.lit(-32768)), F.lit(32767))


def _trunc(a: Column, b: Column) -> Column:
    """a / b, truncated towards zero."""
    return (F.floor(F.abs(a) / F.abs(b)) * F.signum(a) * F.signum(b)).cast("int")


def neighbour_count(left: Column, top: Column) -> Column:
    """Expected coefficient count from neighbours; a missing one counts 64."""
    both = left + top
    return F.when(both < 64, F.shiftright(both + 1, 1)).otherwise(both.bitwiseAND(31))


def h264_nal(byte: Column) -> Column:
    """(forbidden, ref_idc, type) of a one-byte NAL header."""
    return F.struct(
        F.shiftright(byte, 7).alias("forbidden"),
        F.shiftright(byte, 5).bitwiseAND(3).alias("ref_idc"),
        byte.bitwiseAND(31).alias("type"),
    )


def hevc_nal(first: Column, second: Column) -> Column:
    """(type, layer, temporal id plus 1) of a two-byte NAL header."""
    return F.struct(
        F.shiftright(first, 1).bitwiseAND(63).alias("type"),
        (F.shiftleft(first.bitwiseAND(1), 5) + F.shiftright(second, 3)).alias("layer"),
        second.bitwiseAND(7).alias("temporal"),
    )


def is_vcl(kind: Column, codec: str = "h264") -> Column:
    return kind < 32 if codec == "hevc" else kind.between(1, 5)


def is_idr(kind: Column, codec: str = "h264") -> Column:
    return kind.isin(19, 20) if codec == "hevc" else kind == 5


def is_irap(kind: Column) -> Column:
    """HEVC pictures from which decoding can begin."""
    return kind.between(16, 23)


def is_bla(kind: Column) -> Column:
    """HEVC pictures after a broken link: the high part of the display count is dropped."""
    return kind.between(16, 18)


def h264_slice_type(code: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in ("P", "B", "I", "SP", "SI"))), (code % 5 + 1).cast("int"))


def hevc_slice_type(code: Column) -> Column:
    return F.when(code == 0, "B").when(code == 1, "P").otherwise("I")


def parse_double(text: Column) -> Column:
    """A float of the usual forms, also inf and nan; null for anything else."""
    text = F.lower(F.trim(text))
    infinite = [w for n in ("inf", "infinity") for w in (n, f"+{n}", f"-{n}")]
    named = F.when(text.isin(infinite), F.when(text.startswith("-"), float("-inf")).otherwise(float("inf")))
    named = named.when(text.isin("nan", "+nan", "-nan"), F.lit(float("nan")))
    plain = F.translate(text, "0123456789+-.e", "") == ""
    return F.when(plain, text.try_cast("double")).otherwise(named)


def _digits(x: Column) -> tuple[Column, Column]:
    """Digits of a finite number other than 0, and where the point stands: 0.digits * 10**point."""
    text = F.regexp_replace(x.cast("string"), "^-", "")
    whole = F.substring_index(text, "E", 1)
    power = F.coalesce(F.get(F.split(text, "E"), F.lit(1)).cast("int"), F.lit(0))
    plain = F.regexp_replace(whole, r"\.", "")
    found = F.ltrim(plain, F.lit("0"))
    point = F.length(F.substring_index(whole, ".", 1)) - (F.length(plain) - F.length(found)) + power
    return F.rtrim(found, F.lit("0")), point


def _named(x: Column, zero: str, other: Column) -> Column:
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    out = F.when(F.isnan(x), "NaN").when(x.isin(float("inf"), float("-inf")), F.concat(sign, F.lit("inf")))
    return out.when(x == 0, F.concat(sign, F.lit(zero))).otherwise(F.concat(sign, other))


def plain_text(x: Column) -> Column:
    """A double in digits without an exponent, however long; whole numbers without a point."""
    d, point = _digits(x)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), d)
    split = F.concat(F.substr(d, F.lit(1), point), F.lit("."), F.substr(d, point + 1))
    return _named(x, "0", F.when(point <= 0, small).when(point >= F.length(d), F.rpad(d, point, F.lit("0"))).otherwise(split))


def short_text(x: Column) -> Column:
    """A double with a point, or an exponent beyond 16 digits before or 5 after the point."""
    d, point = _digits(x)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), d)
    whole = F.concat(F.rpad(d, point, F.lit("0")), F.lit(".0"))
    split = F.concat(F.substr(d, F.lit(1), point), F.lit("."), F.substr(d, point + 1))
    tail = F.when(F.length(d) > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise("")
    power = F.concat(F.substr(d, F.lit(1), F.lit(1)), tail, F.lit("e"), (point - 1).cast("string"))
    text = F.when((point > 16) | (point <= -5), power).when(point <= 0, small)
    return _named(x, "0.0", text.when(point >= F.length(d), whole).otherwise(split))


def saturated_long(x: Column) -> Column:
    """A double as a 64-bit integer: truncated, clamped, NaN as 0."""
    top = 9.223372036854775807e18
    whole = F.when(x >= top, F.lit((1 << 63) - 1)).when(x <= -top, F.lit(-(1 << 63))).otherwise(x.cast("long"))
    return F.when(F.isnan(x), F.lit(0).cast("long")).otherwise(whole)


def saturated_int(x: Column) -> Column:
    """A double as a 32-bit integer: truncated, clamped, NaN as 0."""
    clamped = F.least(F.greatest(x, F.lit(-2147483648.0)), F.lit(2147483647.0))
    return F.when(F.isnan(x), 0).when(x.isNotNull(), clamped.cast("int"))


def parse_flags(text: Column) -> Column:
    """0x and hex digits, or decimal digits, of 64 bits; 0 for anything else."""
    text = F.trim(text)
    hexa = F.when(text.rlike("^0[xX][0-9a-fA-F]{1,16}$"), F.conv(F.substr(text, F.lit(3)), 16, 10))
    number = F.coalesce(hexa, F.when(text.rlike(r"^\+?\d{1,20}$"), text)).try_cast("decimal(20,0)")
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number).otherwise(F.lit(0).cast("decimal(20,0)"))


def format_flags(flags: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.conv(flags.cast("string"), 10, 16)))
