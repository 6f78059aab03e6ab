"""A writer of slices with predictors of its own, and what is read back."""

import random

import pytest

from kinefield.plans.pictures import h264_slices, h264_vectors
from kinefield.sources import cavlc as C
from kinefield.sources.nal import BitReader
from kinefield.sources import video
from tests.test_syntax import pack, se, ue

CODES = [(C.token_codes, n, 16) for n in (0, 2, 4, 8)] + [(C.token_codes, 0, 4), (C.token_codes, 0, 8)]
CODES += [(C.zero_codes, t, most) for most in (4, 8, 15, 16) for t in range(1, most)] + [(C.run_codes, n) for n in range(1, 16)]


@pytest.mark.parametrize("make, args", [(c[0], c[1:]) for c in CODES])
def test_codes_are_free_of_prefixes(make, args):
    codes = sorted(make(*args))
    assert all(not b.startswith(a) for a, b in zip(codes, codes[1:]))
    assert sum(2.0 ** -len(c) for c in codes) <= 1


@pytest.mark.parametrize("most", [4, 8, 16])
def test_zeros_leave_no_code_free(most):
    for total in range(1, most):
        codes = C.zero_codes(total, most)
        assert len(codes) == most - total + 1
        assert sum(2.0 ** -len(c) for c in codes) == (1 - 2.0**-9 if (total, most) == (1, 16) else 1)


def test_tokens_are_all_there():
    for near, most, top in ((0, 16, 16), (2, 16, 16), (4, 16, 16), (8, 16, 16), (0, 4, 4), (0, 8, 8)):
        wanted = {(t, o) for t in range(top + 1) for o in range(min(t, 3) + 1)}
        assert sorted(C.token_codes(near, most).values()) == sorted(wanted)


# Examples of the standard's tables and of a published worked example.
@pytest.mark.parametrize("bits, near, most, total, used", [("1100000000", 0, 16, 0, 1), ("01011111", 0, 16, 1, 4), ("000010001110010111101101", 1, 16, 5, 24), ("000011", 8, 16, 0, 6)])
def test_known_blocks(bits, near, most, total, used):
    reader = BitReader(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big"))
    assert (C.residual(reader, near, most), reader.pos) == (total, used)


def _code(codes, symbol):
    return next(c for c, s in codes.items() if s == symbol)


def write_block(rng, near, most):
    """(bits, count) of a block with random coefficients, as the standard says to write them."""
    total = rng.choice([0, 0, 1, 2, 3, rng.randint(0, most), most])
    levels = [rng.choice([1, -1, 1, -1, 2, -3, 9, -40, 700, -5000]) for _ in range(total)]
    ones = 0
    while ones < min(3, total) and abs(levels[ones]) == 1:
        ones += 1
    group = next(g for g in (8, 4, 2, 0) if near >= g) if most > 8 else 0
    out = [_code(C.token_codes(group, 16 if most > 8 else most), (total, ones))]
    if not total:
        return out[0], 0
    out += ["1" if v < 0 else "0" for v in levels[:ones]]
    width = 1 if total > 10 and ones < 3 else 0
    for k, v in enumerate(levels[ones:]):
        code = 2 * v - 2 if v > 0 else -2 * v - 1
        code -= 2 if k == 0 and ones < 3 else 0
        if width == 0 and code < 14:
            out.append("0" * code + "1")
        elif width == 0 and code < 30:
            out.append("0" * 14 + "1" + f"{code - 14:04b}")
        elif width and code < 15 << width:
            out.append("0" * (code >> width) + "1" + f"{code % (1 << width):0{width}b}")
        else:
            rest, prefix = code - (15 << width) - (0 if width else 15), 15
            while rest >= 1 << prefix - 3:
                rest -= 1 << prefix - 3
                prefix += 1
            out.append("0" * prefix + "1" + f"{rest:0{prefix - 3}b}")
        width = width or 1
        width += abs(v) > 3 * 2 ** (width - 1) and width < 6
    left = 0
    if total < most:
        left = rng.randint(0, most - total)
        out.append(_code(C.zero_codes(total, most), left))
    for _ in range(total - 1):
        if not left:
            break
        run = rng.randint(0, left)
        out.append(_code(C.run_codes(left), run))
        left -= run
    return "".join(out), total


@pytest.mark.parametrize("most", [4, 8, 15, 16])
def test_blocks_are_read_to_their_end(most):
    rng = random.Random(most)
    for _ in range(600):
        near = rng.randint(0, 16) if most > 8 else 0
        bits, total = write_block(rng, near, most)
        reader = BitReader(pack(bits))
        assert (C.residual(reader, near, most), reader.pos) == (total, len(bits))


class Writer:
    """Bits of a slice with random macroblocks, by places in samples of four."""

    def __init__(self, rng, width, height, first, chroma, refs, t8, inter=True):
        self.rng, self.w, self.h, self.first, self.refs, self.t8, self.inter = rng, width, height, first, refs, t8, inter
        self.rows = {0: 0, 1: 2, 2: 4}[chroma]
        self.motion, self.counts, self.bits, self.want, self.skips = {}, {}, [], [], 0

    def neighbours(self, x, y, w):
        a, b, c = (self.motion.get(p) for p in ((x - 1, y), (x, y - 1), (x + w, y - 1)))
        return a, b, c if c is not None else self.motion.get((x - 1, y - 1))

    def predict(self, x, y, w, ref, only=None):
        near = self.neighbours(x, y, w)
        if only is not None and near[only] and near[only][0] == ref:
            return near[only][1]
        if near[1] is None and near[2] is None and near[0] is not None:
            near = (near[0],) * 3
        hits = [n[1] for n in near if n and n[0] == ref]
        if len(hits) == 1:
            return hits[0]
        vs = [n[1] if n else (0, 0) for n in near]
        return tuple(sorted(v[k] for v in vs)[1] for k in (0, 1))

    def fill(self, x, y, w, h, ref, v):
        self.motion.update({(x + i, y + j): (ref, v) for i in range(w) for j in range(h)})

    def part(self, x, y, w, h, ref, only=None):
        v = (self.rng.randint(-90, 90), self.rng.randint(-90, 90)) if self.rng.random() < 0.7 else self.predict(x, y, w, ref, only)
        p = self.predict(x, y, w, ref, only)
        self.bits += [se(v[0] - p[0]), se(v[1] - p[1])]
        self.fill(x, y, w, h, ref, v)
        return v

    def ref(self):
        r = self.rng.randrange(self.refs)
        self.bits.append("" if self.refs == 1 else str(1 - r) if self.refs == 2 else ue(r))
        return r

    def block(self, plane, x, y, most, keep=True):
        near = [self.counts.get((plane, *p)) for p in ((x - 1, y), (x, y - 1))]
        there = [n for n in near if n is not None]
        bits, total = write_block(self.rng, (sum(there) + 1) // 2 if len(there) == 2 else sum(there), most)
        self.bits.append(bits)
        if keep:
            self.counts[plane, x, y] = total

    def residual(self, mx, my, pattern, apart=False):
        if apart:
            self.block("y", 4 * mx, 4 * my, 16, keep=False)
        for q in range(4):
            for k in range(4):
                if pattern & 1 << q:
                    self.block("y", 4 * mx + q % 2 * 2 + k % 2, 4 * my + q // 2 * 2 + k // 2, 15 if apart else 16)
        if pattern & 48:
            self.bits += [write_block(self.rng, 0, 2 * self.rows)[0] for _ in range(2)]
        if pattern & 32:
            for plane in "uv":
                for k in range(2 * self.rows):
                    self.block(plane, 2 * mx + k % 2, self.rows * my + k // 2, 15)

    def all_counts(self, mx, my, n):
        self.counts.update({("y", 4 * mx + i, 4 * my + j): n for i in range(4) for j in range(4)})
        self.counts.update({(c, 2 * mx + i, self.rows * my + j): n for c in "uv" for i in range(2) for j in range(self.rows)})

    def macroblock(self, mb):
        rng, mx, my = self.rng, mb % self.w, mb // self.w
        x, y = 4 * mx, 4 * my
        self.all_counts(mx, my, 0)
        kind = rng.choice(["skip", "skip", 0, 1, 2, 3, 4, "i16", "i4", "pcm"]) if self.inter else rng.choice(["i16", "i4", "pcm"])
        if kind == "skip":
            a, b = self.motion.get((x - 1, y)), self.motion.get((x, y - 1))
            still = a is None or b is None or (0, (0, 0)) in (a, b)
            v = (0, 0) if still else self.predict(x, y, 4, 0)
            self.fill(x, y, 4, 4, 0, v)
            self.skips += 1
            self.want.append((mb, "16x16", [v]))
            return
        if self.inter:
            self.bits.append(ue(self.skips))
            self.skips = 0
        base = 5 if self.inter else 0
        if kind in ("i16", "i4", "pcm"):
            self.fill(x, y, 4, 4, -1, (0, 0))
        if kind == "pcm":
            self.bits.append(ue(base + 25))
            size = len("".join(self.bits))
            self.bits += ["0" * (-(size + self.offset) % 8), "10110101" * (256 + 64 * self.rows)]
            self.all_counts(mx, my, 16)
        elif kind == "i16":
            luma, chroma = rng.choice([0, 15]), rng.randrange(3) if self.rows else 0
            self.bits += [ue(base + 1 + rng.randrange(4) + 4 * chroma + 12 * (luma > 0)), ue(rng.randrange(4)) if self.rows else "", se(rng.randint(-3, 3))]
            self.residual(mx, my, luma + 16 * chroma, apart=True)
        elif kind == "i4":
            large = self.t8 and rng.random() < 0.5
            self.bits += [ue(base), "01"[large] if self.t8 else ""]
            self.bits += [rng.choice(["1", "0101"]) for _ in range(4 if large else 16)]
            self.bits.append(ue(rng.randrange(4)) if self.rows else "")
            self.coded(mx, my, C.INTRA_PATTERNS if self.rows else C.INTRA_PATTERNS_GREY, False)
        else:
            self.bits.append(ue(kind))
            whole = True
            if kind < 3:
                parts = [[(0, 0, 4, 4, None)], [(0, 0, 4, 2, 1), (0, 2, 4, 2, 0)], [(0, 0, 2, 4, 0), (2, 0, 2, 4, 2)]][kind]
                refs = [self.ref() for _ in parts]
                vs = [self.part(x + dx, y + dy, w, h, r, only) for (dx, dy, w, h, only), r in zip(parts, refs)]
            else:
                subs = [rng.randrange(4) if rng.random() < 0.6 else 0 for _ in range(4)]
                whole = not any(subs)
                self.bits += map(ue, subs)
                refs = [0 if kind == 4 else self.ref() for _ in subs]
                vs = []
                for q, (sub, r) in enumerate(zip(subs, refs)):
                    w, h = [(2, 2), (2, 1), (1, 2), (1, 1)][sub]
                    vs.append([self.part(x + q % 2 * 2 + i, y + q // 2 * 2 + j, w, h, r) for j in range(0, 2, h) for i in range(0, 2, w)][0])
            self.want.append((mb, ["16x16", "16x8", "8x16", "8x8", "8x8"][kind], vs))
            self.coded(mx, my, C.INTER_PATTERNS if self.rows else C.INTER_PATTERNS_GREY, self.t8 and whole)

    def coded(self, mx, my, patterns, flag):
        code = self.rng.randrange(len(patterns))
        self.bits += [ue(code), self.rng.choice("01") if flag and patterns[code] & 15 else ""]
        if patterns[code]:
            self.bits.append(se(self.rng.randint(-3, 3)))
            self.residual(mx, my, patterns[code])

    def write(self, count, offset):
        self.offset = offset
        for mb in range(self.first, self.first + count):
            self.macroblock(mb)
        if self.skips:
            self.bits.append(ue(self.skips))
        return "".join(self.bits)


@pytest.mark.parametrize("seed", range(60))
def test_random_slices(seed):
    rng = random.Random(seed)
    w, h, chroma, refs, t8 = rng.randint(1, 5), rng.randint(1, 5), seed % 3, rng.choice([1, 2, 3]), seed % 2
    first = rng.randrange(w * h) if seed % 4 == 0 else 0
    count = rng.randint(1, w * h - first) if seed % 3 == 0 else w * h - first
    writer = Writer(rng, w, h, first, chroma, refs, t8, inter=seed % 10 != 9)
    lead = "1" * rng.randrange(16)
    payload = pack(lead + writer.write(count, len(lead)))
    head = {"data_bit": len(lead), "slice_type": "P" if writer.inter else "I", "num_ref_l0": refs, "first_mb": first}
    sps = {"width_in_mbs": w, "height_in_map_units": h, "frame_mbs_only": 1, "chroma_format_idc": chroma}
    found = C.Slice(payload, head, sps, {"transform_8x8_mode": t8})
    assert found.decode() == (True, count)
    assert found.blocks == writer.want


@pytest.mark.parametrize("seed", range(40))
def test_damaged_slices_end(seed):
    rng = random.Random(seed)
    head = {"data_bit": 0, "slice_type": "PI"[seed % 2], "num_ref_l0": 1 + seed % 3, "first_mb": seed % 5}
    sps = {"width_in_mbs": 4, "height_in_map_units": 4, "frame_mbs_only": 1, "chroma_format_idc": seed % 3}
    payload = rng.randbytes(rng.choice([0, 1, 40, 3000]))
    complete, n = C.Slice(payload, head, sps, {"transform_8x8_mode": 0}).decode()
    assert isinstance(complete, bool) and 0 <= n <= 16


SPS = b"\x67" + pack(f"{66:08b}", "0" * 16, ue(0), ue(0), ue(0), ue(0), ue(2), "0", ue(2), ue(2), "1", "1")
PPS = b"\x68" + pack(ue(0), ue(0), "00", ue(0), ue(0), ue(0), "000", se(0), se(0), se(0), "000")
CENTRES = {"16x16": [(8, 8)], "16x8": [(8, 4), (8, 12)], "8x16": [(4, 8), (12, 8)], "8x8": [(4, 4), (12, 4), (4, 12), (12, 12)]}


def _escaped(data):
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def test_stream_to_vectors(spark):
    """Three pictures of two slices each, in a stream with start codes."""
    rng, units, want = random.Random(5), [SPS, PPS], []
    for frame in range(3):
        for first, count in ((0, 4), (4, 5)):
            idr = frame == 0
            start = [ue(first), ue(7 if idr else 5), ue(0), "0001", ue(0) if idr else "", f"{frame * 2:04b}", "" if idr else "00", "00" if idr else "0", se(0)]
            lead = "".join(start)
            writer = Writer(rng, 3, 3, first, 1, 1, 0, inter=not idr)
            units.append(bytes([0x65 if idr else 0x61]) + pack(lead + writer.write(count, len(lead))))
            for mb, shape, vs in writer.want:
                for (cx, cy), v in zip(CENTRES[shape], vs):
                    want.append((frame, 16 * (mb % 3) + cx, 16 * (mb // 3) + cy, *v))
    stream = b"".join(b"\0\0\1" + _escaped(u) for u in units)
    files = spark.createDataFrame([("a.264", stream)], "path string, content binary")
    rows = h264_vectors(h264_slices(video.units(files))).orderBy("frame", "seq")
    assert [tuple(r) for r in rows.select("frame", "cx", "cy", "mv_x", "mv_y").collect()] == want and len(want) > 20
