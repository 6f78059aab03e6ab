"""H.264 slices coded with variable-length codes, to the vectors of their macroblocks.

Neighbours count only within their slice, and an I or P slice takes nothing from other
pictures' vectors, so each slice is decoded by itself. Residuals are read for their length
alone. Samples have eight bits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinefield.sources.nal import BitReader

# The code tables of the published standard. A row of tokens has the codes of
# one count of coefficients, from 0, by how many of them are trailing ones, from 0.
_TOKENS_0 = """
1
000101 01
00000111 000100 001
000000111 00000110 0000101 00011
0000000111 000000110 00000101 000011
00000000111 0000000110 000000101 0000100
0000000001111 00000000110 0000000101 00000100
0000000001011 0000000001110 00000000101 000000100
0000000001000 0000000001010 0000000001101 0000000100
00000000001111 00000000001110 0000000001001 00000000100
00000000001011 00000000001010 00000000001101 0000000001100
000000000001111 000000000001110 00000000001001 00000000001100
000000000001011 000000000001010 000000000001101 00000000001000
0000000000001111 000000000000001 000000000001001 000000000001100
0000000000001011 0000000000001110 0000000000001101 000000000001000
0000000000000111 0000000000001010 0000000000001001 0000000000001100
0000000000000100 0000000000000110 0000000000000101 0000000000001000
"""
_TOKENS_2 = """
11
001011 10
000111 00111 011
0000111 001010 001001 0101
00000111 000110 000101 0100
00000100 0000110 0000101 00110
000000111 00000110 00000101 001000
00000001111 000000110 000000101 000100
00000001011 00000001110 00000001101 0000100
000000001111 00000001010 00000001001 000000100
000000001011 000000001110 000000001101 00000001100
000000001000 000000001010 000000001001 00000001000
0000000001111 0000000001110 0000000001101 000000001100
0000000001011 0000000001010 0000000001001 0000000001100
0000000000111 00000000001011 0000000000110 0000000001000
00000000001001 00000000001000 00000000001010 0000000000001
00000000000111 00000000000110 00000000000101 00000000000100
"""
_TOKENS_4 = """
1111
001111 1110
001011 01111 1101
001000 01100 01110 1100
0001111 01010 01011 1011
0001011 01000 01001 1010
0001001 001110 001101 1001
0001000 001010 001001 1000
00001111 0001110 0001101 01101
00001011 00001110 0001010 001100
000001111 00001010 00001101 0001100
000001011 000001110 00001001 00001100
000001000 000001010 000001101 00001000
0000001101 000000111 000001001 000001100
0000001001 0000001100 0000001011 0000001010
0000000101 0000001000 0000000111 0000000110
0000000001 0000000100 0000000011 0000000010
"""
#: Of the two-by-two and two-by-four blocks of chroma means.
_TOKENS_CHROMA = {
    4: """
01
000111 1
000100 000110 001
000011 0000011 0000010 000101
000010 00000011 00000010 0000000
""",
    8: """
1
0001111 01
0001110 0001101 001
000000111 0001100 0001011 00001
000000110 000000101 0001010 000001
0000000111 0000000110 000000100 0001001
00000000111 00000000110 0000000101 0001000
000000000111 000000000110 00000000101 0000000100
0000000000111 000000000101 000000000100 00000000100
""",
}
# Zeros before the last coefficient, from 0; a row for each count of coefficients, from 1.
_ZEROS = {
    16: """
1 011 010 0011 0010 00011 00010 000011 000010 0000011 0000010 00000011 00000010 000000011 000000010 000000001
111 110 101 100 011 0101 0100 0011 0010 00011 00010 000011 000010 000001 000000
0101 111 110 101 0100 0011 100 011 0010 00011 00010 000001 00001 000000
00011 111 0101 0100 110 101 100 0011 011 0010 00010 00001 00000
0101 0100 0011 111 110 101 100 011 0010 00001 0001 00000
000001 00001 111 110 101 100 011 010 0001 001 000000
000001 00001 101 100 011 11 010 0001 001 000000
000001 0001 00001 011 11 10 010 001 000000
000001 000000 0001 11 10 001 01 00001
00001 00000 001 11 10 01 0001
0000 0001 001 010 1 011
0000 0001 01 1 001
000 001 1 01
00 01 1
0 1
""",
    4: """
1 01 001 000
1 01 00
1 0
""",
    8: """
1 010 011 0010 0011 0001 00001 00000
000 01 001 100 101 110 111
000 001 01 10 110 111
110 00 01 10 111
00 01 10 11
00 01 1
0 1
""",
}
# Zeros before a coefficient, from 0; a row for each count of zeros left, from 1, the last for more.
_RUNS = """
1 0
1 01 00
11 10 01 00
11 10 01 001 000
11 10 011 010 001 000
11 000 001 011 010 101 100
111 110 101 100 011 010 001 0001 00001 000001 0000001 00000001 000000001 0000000001 00000000001
"""
#: Coded block patterns by code, of inter and intra macroblocks, with and without chroma.
INTER_PATTERNS = (
    0, 16, 1, 2, 4, 8, 32, 3, 5, 10, 12, 15, 47, 7, 11, 13, 14, 6, 9, 31, 35, 37, 42, 44, 33, 34, 36, 40, 39, 43, 45, 46, 17, 18,
    20, 24, 19, 21, 26, 28, 23, 27, 29, 30, 22, 25, 38, 41,
)
INTRA_PATTERNS = (
    47, 31, 15, 0, 23, 27, 29, 30, 7, 11, 13, 14, 39, 43, 45, 46, 16, 3, 5, 10, 12, 19, 21, 26, 28, 35, 37, 42, 44, 1, 2, 4, 8, 17,
    18, 20, 24, 6, 9, 22, 25, 32, 33, 34, 36, 40, 38, 41,
)
INTER_PATTERNS_GREY = (0, 1, 2, 4, 8, 3, 5, 10, 12, 15, 7, 11, 13, 14, 6, 9)
INTRA_PATTERNS_GREY = (15, 0, 7, 11, 13, 14, 3, 5, 10, 12, 1, 2, 4, 8, 6, 9)
#: Parts (x, y, width, height in blocks of four) of macroblocks and of their quarters, by type.
PARTS = (("16x16", ((0, 0, 4, 4),)), ("16x8", ((0, 0, 4, 2), (0, 2, 4, 2))), ("8x16", ((0, 0, 2, 4), (2, 0, 2, 4))))
#: Neighbours whose vectors the parts take first: left 0, above 1, diagonal 2.
SIDES = ((None,), (1, 0), (0, 2))
QUARTERS = (
    ((0, 0, 2, 2),),
    ((0, 0, 2, 1), (0, 1, 2, 1)),
    ((0, 0, 1, 2), (1, 0, 1, 2)),
    ((0, 0, 1, 1), (1, 0, 1, 1), (0, 1, 1, 1), (1, 1, 1, 1)),
)
#: References of blocks that aren't there and of intra blocks.
MISSING, INTRA = -2, -1


class Broken(ValueError):
    """Bits that no code stands for."""


class Codes:
    """A prefix code, looked up by as many bits as its longest code has."""

    def __init__(self, codes: dict[str, object]):
        self.longest = max(map(len, codes))
        self.found = [None] * (1 << self.longest)
        for code, symbol in codes.items():
            free = self.longest - len(code)
            first = int(code, 2) << free
            self.found[first : first + (1 << free)] = [(symbol, len(code))] * (1 << free)

    def read(self, reader: BitReader):
        hit = self.found[reader.peek(self.longest)]
        if hit is None:
            raise Broken
        reader.pos += hit[1]
        return hit[0]


def _rows(text: str) -> list[list[str]]:
    return [line.split() for line in text.strip().splitlines()]


def token_codes(near: int, most: int) -> dict[str, tuple[int, int]]:
    """(coefficients, trailing ones) by code, for the coefficients ``near`` a block."""
    if most > 8 and near >= 8:
        # Six bits: one coefficient fewer than there are, then the ones; 3 stands for none.
        pairs = {v: ((v >> 2) + 1, v & 3) for v in range(64) if v & 3 <= (v >> 2) + 1}
        return {f"{v:06b}": p for v, p in (pairs | {3: (0, 0)}).items()}
    text = _TOKENS_CHROMA[most] if most <= 8 else _TOKENS_0 if near < 2 else _TOKENS_2 if near < 4 else _TOKENS_4
    return {code: (total, ones) for total, row in enumerate(_rows(text)) for ones, code in enumerate(row)}


def zero_codes(total: int, most: int) -> dict[str, int]:
    return {code: n for n, code in enumerate(_rows(_ZEROS[min(most + most % 2, 16)])[total - 1])}


def run_codes(left: int) -> dict[str, int]:
    return {code: n for n, code in enumerate(_rows(_RUNS)[min(left, 7) - 1])}


@cache
def _tokens(group: int, most: int) -> Codes:
    return Codes(token_codes((0, 2, 4, 8)[group], most))


@cache
def _zeros(total: int, most: int) -> Codes:
    return Codes(zero_codes(total, most))


@cache
def _runs(left: int) -> Codes:
    return Codes(run_codes(left))


def residual(reader: BitReader, near: int, most: int) -> int:
    """Reads a block of up to ``most`` coefficients and tells how many it has."""
    group = (near >= 2) + (near >= 4) + (near >= 8) if most > 8 else 0
    total, ones = _tokens(group, 16 if most > 8 else most).read(reader)
    if total > most:
        raise Broken
    if not total:
        return 0
    reader.pos += ones  # their signs
    _levels(reader, total, ones)
    left = _zeros(total, most).read(reader) if total < most else 0
    if left > most - total:
        raise Broken
    for _ in range(total - 1):
        if left <= 0:
            break
        left -= _runs(min(left, 7)).read(reader)
    return total


def _levels(reader: BitReader, total: int, ones: int) -> None:
    """Reads what isn't a trailing one; each size tells how many bits the next one ends with."""
    width = int(total > 10 and ones < 3)
    for k in range(total - ones):
        zeros = 32 - reader.peek(32).bit_length()
        if zeros > 31:
            raise Broken
        reader.pos += zeros + 1
        size = zeros - 3 if zeros > 14 else 4 if zeros == 14 and not width else width
        code = (min(zeros, 15) << width) + (reader.read(size) if size else 0)
        code += 15 * (zeros > 14 and not width) + ((1 << zeros - 3) - 4096 if zeros > 15 else 0)
        magnitude = (code + 2 * (k == 0 and ones < 3)) // 2 + 1
        width = max(width, 1)
        if width < 6 and magnitude > 3 << width - 1:
            width += 1


class Slice:
    """What a slice has decoded so far: references, vectors and coefficient counts of blocks.

    Blocks have a border of missing ones above and at both sides.
    """

    def __init__(self, payload: bytes, head: dict, sps: dict, pps: dict):
        self.reader = BitReader(payload)
        self.reader.pos = head["data_bit"]
        self.inter, self.references = head["slice_type"] == "P", head["num_ref_l0"]
        self.transform_8x8 = pps["transform_8x8_mode"]
        self.width = sps["width_in_mbs"]
        self.height = sps["height_in_map_units"] * (2 - sps["frame_mbs_only"])
        self.chroma = {1: 2, 2: 4}.get(sps["chroma_format_idc"], 0)  # rows of blocks a macroblock
        self.first = head["first_mb"]
        self.row, self.chroma_row = 4 * self.width + 2, 2 * self.width + 1
        size = self.row * (4 * self.height + 1)
        self.ref, self.vector, self.counts = [MISSING] * size, [(0, 0)] * size, [-1] * size
        self.chroma_counts = [[-1] * (self.chroma_row * (self.chroma * self.height + 1)) for _ in range(2 if self.chroma else 0)]
        self.blocks: list[tuple[int, str, list[tuple[int, int]]]] = []
        self.end = self.first

    def decode(self) -> tuple[bool, int]:
        """Whether all of it could be read, and how many macroblocks were."""
        mb, end, reader = self.first, self.width * self.height, self.reader
        try:
            while mb < end:
                if self.inter:
                    run = reader.ue()
                    for _ in range(min(run, end - mb)):
                        self._start(mb)
                        self._skip(mb)
                        mb += 1
                    if mb == end or (run and not reader.more_data()):
                        break
                self._start(mb)
                self._macroblock(mb)
                if reader.pos > reader.size:
                    raise Broken
                mb += 1
                if not reader.more_data():
                    break
            complete = True
        except Broken:
            complete = False
        self.end = mb
        return complete, mb - self.first

    def rows(self) -> list[tuple[int, str, list[tuple]]]:
        """(macroblock, shape, parts); a part is (list 0 used, list 1 used, x0, y0, x1, y1)."""
        return [(mb, shape, [(True, False, x, y, 0, 0) for x, y in vectors]) for mb, shape, vectors in self.blocks]

    def lists(self) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """References and vectors of the lists in use, by block."""
        return [(self.ref, self.vector)]

    def corners(self) -> dict[int, list[tuple]]:
        """(ref, x, y) in each list in use of the outer blocks of quarters, by macroblock."""
        out = {}
        for mb in range(self.first, self.end):
            y, x = divmod(mb, self.width)
            at = (4 * y + 1) * self.row + 4 * x + 1
            places = (at, at + 3, at + 3 * self.row, at + 3 * self.row + 3)
            out[mb] = [[(refs[p], *vectors[p]) for refs, vectors in self.lists()] for p in places]
        return out

    def _start(self, mb: int) -> None:
        y, x = divmod(mb, self.width)
        self.at = (4 * y + 1) * self.row + 4 * x + 1
        self.chroma_at = (self.chroma * y + 1) * self.chroma_row + 2 * x + 1
        self._count_all(0)

    def _count_all(self, n: int) -> None:
        for k in range(4):
            a = self.at + k * self.row
            self.counts[a : a + 4] = [n] * 4
        for counts in self.chroma_counts:
            for k in range(self.chroma):
                a = self.chroma_at + k * self.chroma_row
                counts[a : a + 2] = [n] * 2

    def _fill(self, at: int, w: int, h: int, ref: int, vector: tuple[int, int]) -> None:
        for a in range(at, at + h * self.row, self.row):
            self.ref[a : a + w] = [ref] * w
            self.vector[a : a + w] = [vector] * w

    def _near(self, at: int, w: int) -> tuple[int, int, int]:
        """Places at the left, above, and above the right end or else the left one."""
        above = at - self.row
        right = above + w
        return at - 1, above, right if self.ref[right] != MISSING else above - 1

    def _predicted(self, at: int, w: int, ref: int) -> tuple[int, int]:
        near = self._near(at, w)
        same = [p for p in near if self.ref[p] == ref]
        if len(same) == 1:
            return self.vector[same[0]]
        left, *rest = near
        if all(self.ref[p] == MISSING for p in rest):
            return self.vector[left]
        xs, ys = zip(*(self.vector[p] for p in near))
        return sorted(xs)[1], sorted(ys)[1]

    def _directed(self, at: int, w: int, ref: int, side: int | None) -> tuple[int, int]:
        """The vector at a side (0 left, 1 above, 2 diagonal) if its reference is the same."""
        if side is not None and self.ref[p := self._near(at, w)[side]] == ref:
            return self.vector[p]
        return self._predicted(at, w, ref)

    def _skip(self, mb: int) -> None:
        left, above, _ = self._near(self.at, 4)
        rests = any(self.ref[p] == MISSING or (self.ref[p] == 0 and self.vector[p] == (0, 0)) for p in (left, above))
        vector = (0, 0) if rests else self._predicted(self.at, 4, 0)
        self._fill(self.at, 4, 4, 0, vector)
        self.blocks.append((mb, "16x16", [vector]))

    def _macroblock(self, mb: int) -> None:
        kind = self.reader.ue()
        if not self.inter:
            self._intra(kind)
        elif kind >= 5:
            self._intra(kind - 5)
        else:
            self._inter(mb, kind)

    def _reference(self, x: int, y: int, w: int, h: int) -> int:
        if self.references <= 1:
            return 0
        return 1 - self.reader.read(1) if self.references == 2 else self.reader.ue()

    def _part(self, x: int, y: int, w: int, h: int, ref: int, side: int | None = None) -> tuple[int, int]:
        at = self.at + y * self.row + x
        px, py = self._directed(at, w, ref, side)
        dx, dy = self._difference(at, w, h)
        self._fill(at, w, h, ref, (px + dx, py + dy))
        return px + dx, py + dy

    def _difference(self, at: int, w: int, h: int) -> tuple[int, int]:
        return self.reader.se(), self.reader.se()

    def _quarter(self) -> int:
        kind = self.reader.ue()
        if kind > 3:
            raise Broken
        return kind

    def _inter(self, mb: int, kind: int) -> None:
        whole = True
        if kind < 3:
            shape, parts = PARTS[kind]
            refs = [self._reference(*p) for p in parts]
            vectors = [self._part(*p, ref, side) for p, ref, side in zip(parts, refs, SIDES[kind])]
        else:
            shape, vectors = "8x8", []
            kinds = [self._quarter() for _ in range(4)]
            whole = not any(kinds)
            places = [(2 * (k % 2), 2 * (k // 2)) for k in range(4)]
            refs = [0 if kind == 4 else self._reference(x, y, 2, 2) for x, y in places]
            for sub, ref, (x, y) in zip(kinds, refs, places):
                # A quarter is exported with the vector of its first part.
                vectors.append([self._part(x + dx, y + dy, w, h, ref) for dx, dy, w, h in QUARTERS[sub]][0])
        self.blocks.append((mb, shape, vectors))
        self._coded(whole)

    def _coded(self, whole: bool) -> None:
        """What follows the vectors; ``whole``: no part is smaller than a quarter."""
        pattern = self._pattern(INTER_PATTERNS if self.chroma else INTER_PATTERNS_GREY)
        if self.transform_8x8 and pattern & 15 and whole:
            self.reader.read(1)
        if pattern:
            self.reader.se()
            self._residuals(pattern)

    def _pattern(self, patterns: tuple[int, ...]) -> int:
        code = self.reader.ue()
        if code >= len(patterns):
            raise Broken
        return patterns[code]

    def _intra(self, kind: int) -> None:
        reader = self.reader
        self._fill(self.at, 4, 4, INTRA, (0, 0))
        if kind > 25:
            raise Broken
        if kind == 25:
            reader.pos = -(-reader.pos // 8) * 8 + 8 * (256 + 64 * self.chroma)
            self._count_all(16)
        elif kind:
            if self.chroma:
                reader.ue()
            reader.se()
            self._residuals(15 * (kind > 12) + 16 * ((kind - 1) // 4 % 3), apart=True)
        else:
            large = self.transform_8x8 and reader.read(1)
            for _ in range(4 if large else 16):
                if not reader.read(1):
                    reader.read(3)
            if self.chroma:
                reader.ue()
            pattern = self._pattern(INTRA_PATTERNS if self.chroma else INTRA_PATTERNS_GREY)
            if pattern:
                reader.se()
                self._residuals(pattern)

    def _block(self, counts: list[int], at: int, row: int, most: int) -> int:
        left, above = counts[at - 1], counts[at - row]
        near = (left + above + 1) >> 1 if min(left, above) >= 0 else max(left, above, 0)
        return residual(self.reader, near, most)

    def _residuals(self, pattern: int, apart: bool = False) -> None:
        """``apart``: the means of luma blocks come first, in a block of their own."""
        if apart:
            self._block(self.counts, self.at, self.row, 16)
        for k in range(16):
            if pattern >> k // 4 & 1:
                x, y = k // 4 % 2 * 2 + k % 2, k // 8 * 2 + k // 2 % 2
                at = self.at + y * self.row + x
                self.counts[at] = self._block(self.counts, at, self.row, 15 if apart else 16)
        if pattern >> 4 and not self.chroma:
            raise Broken
        if pattern >> 4:
            for _ in range(2):
                residual(self.reader, 0, 2 * self.chroma)
        if pattern >> 5:
            for counts in self.chroma_counts:
                for k in range(2 * self.chroma):
                    at = self.chroma_at + k // 2 * self.chroma_row + k % 2
                    counts[at] = self._block(counts, at, self.chroma_row, 15)


PART = "struct<l0:boolean,l1:boolean,x0:int,y0:int,x1:int,y1:int>"
MOTION_TYPE = f"struct<complete:boolean,n_mbs:int,blocks:array<struct<mb:int,shape:string,parts:array<{PART}>>>>"
_PART_NAMES = ("l0", "l1", "x0", "y0", "x1", "y1")


def told(found: Slice) -> dict:
    """``MOTION_TYPE`` of a slice, which is decoded here."""
    complete, n = found.decode()
    parts = lambda ps: [dict(zip(_PART_NAMES, p)) for p in ps]
    return {"complete": complete, "n_mbs": n, "blocks": [{"mb": mb, "shape": shape, "parts": parts(ps)} for mb, shape, ps in found.rows()]}


def motion(payload: Column, head: Column, sps: Column, pps: Column, make: Callable[..., Slice] = Slice) -> Column:
    """``MOTION_TYPE`` of I and P slices; damaged ones give what comes before the damage.

    Sub-partitions of a quarter stand for it with their first vector. Null fields raise.
    ``make``: from the payload and the fields to a slice that can be decoded.
    """

    @F.pandas_udf(MOTION_TYPE)
    def run(raws: pd.Series, heads: pd.DataFrame, s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        fields = zip(raws, *(x.to_dict("records") for x in (heads, s, p)))
        out = [told(make(bytes(raw), *rest)) for raw, *rest in fields]
        return pd.DataFrame(out, columns=["complete", "n_mbs", "blocks"])

    return run(payload, head, sps, pps)
