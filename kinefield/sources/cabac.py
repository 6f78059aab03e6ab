"""H.264 slices coded with context-adaptive arithmetic codes, to the vectors of their macroblocks.

Only what the arithmetic codes and B slices add to ``sources.cavlc``. Contexts' first states
and the ranges of the least probable bin are large tables of the published standard, so they
are a parameter, read from a text file (``read_tables``).

A B slice takes the collocated picture's motion for direct macroblocks; it is decoded with
spatial direct prediction, 8x8 inference and short-term references alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter
from pathlib import Path

from kinefield.sources.cavlc import INTRA, MISSING, PARTS, QUARTERS, SIDES, Broken, Slice, told

# Fixed values of the published standard: states after a least probable bin, by state, and
# places of coefficients' contexts in blocks of 8x8.
AFTER_LEAST = (
    0, 0, 1, 2, 2, 4, 4, 5, 6, 7, 8, 9, 9, 11, 11, 12, 13, 13, 15, 15, 16, 16, 18, 18, 19, 19, 21, 21, 22, 22, 23, 24,
    24, 25, 26, 26, 27, 27, 28, 29, 29, 30, 30, 30, 31, 32, 32, 33, 33, 33, 34, 34, 35, 35, 35, 36, 36, 36, 37, 37, 37, 38, 38, 63,
)
LARGE_PRESENT = (
    0, 1, 2, 3, 4, 5, 5, 4, 4, 3, 3, 4, 4, 4, 5, 5, 4, 4, 4, 4, 3, 3, 6, 7, 7, 7, 8, 9, 10, 9, 8, 7,
    7, 6, 11, 12, 13, 11, 6, 7, 8, 9, 14, 10, 9, 8, 6, 11, 12, 13, 11, 6, 9, 14, 10, 9, 11, 12, 13, 11, 14, 10, 12,
)
LARGE_LAST = (0, *[1] * 15, *[2] * 16, *[3] * 8, *[4] * 8, *[5] * 4, *[6] * 4, *[7] * 4, *[8] * 3)
#: First contexts, by kind of block (luma means, their rest, luma, chroma means, their rest,
#: luma of 8x8): whether it has coefficients, which, where they end, and their sizes.
CODED, PRESENT, LAST, SIZES = (
    (85, 89, 93, 97, 101),
    (105, 120, 134, 149, 152, 402),
    (166, 181, 195, 210, 213, 417),
    (227, 237, 247, 257, 266, 426),
)
#: Bins of B macroblock types and of their quarters' types, by type from 0; bins of intra ones.
B_TYPES = (
    "0 100 101 110000 110001 110010 110011 110100 110101 110110 110111 111110 1110000 1110001 1110010 1110011 1110100 1110101 "
    "1110110 1110111 1111000 1111001 111111"
).split()
B_QUARTERS = "0 100 101 11000 11001 11010 11011 111000 111001 111010 111011 11110 11111".split()
B_INTRA, B_SPLIT = "111101", 22
#: Lists (0, 1 or 2 for both) of the two parts, by pairs of types from 4: one above the other, then side by side.
B_PAIRS = ((0, 0), (1, 1), (0, 1), (1, 0), (0, 2), (1, 2), (2, 0), (2, 1), (2, 2))
#: (Split of ``QUARTERS``, list) of quarters' types, from 1.
B_QUARTER_KINDS = ((0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (1, 1), (2, 1), (1, 2), (2, 2), (3, 0), (3, 1), (3, 2))
N_CONTEXTS, N_STATES = 1024, 64
DIRECT = -1


@dataclass(frozen=True)
class Tables:
    """``contexts``: (m, n) by context, for I slices and the three kinds of others;
    ``ranges``: of the least probable bin, by state and quarter of the range."""

    contexts: tuple[tuple[tuple[int, int], ...], ...]
    ranges: tuple[tuple[int, ...], ...]

    def states(self, inter: bool, kind: int, qp: int) -> list[int]:
        """Twice a context's state, plus its likelier bin."""
        qp, out = min(max(qp, 0), 51), []
        for m, n in self.contexts[1 + min(kind, 2) if inter else 0]:
            pre = min(max((m * qp >> 4) + n, 1), 126)
            out.append(2 * (63 - pre) if pre < 64 else 2 * (pre - 64) + 1)
        return out


def parse_tables(text: str) -> Tables:
    """Lines ``context,<number>,<m>,<n>`` (m and n four times: I slices, then kinds 0 to 2)
    and ``range,<state>,<four ranges>``; contexts that aren't told are 0, 0."""
    contexts = [[(0, 0)] * N_CONTEXTS for _ in range(4)]
    ranges: list[tuple[int, ...] | None] = [None] * N_STATES
    for line in filter(None, map(str.strip, text.splitlines())):
        what, *numbers = line.split(",")
        place, *values = map(int, numbers)
        if what == "context" and len(values) == 8:
            for k in range(4):
                contexts[k][place] = (values[2 * k], values[2 * k + 1])
        elif what == "range" and len(values) == 4:
            ranges[place] = tuple(values)
        else:
            raise ValueError(f"neither a context nor a range: {line}")
    if None in ranges[:-1]:
        raise ValueError("ranges of some states are missing")
    return Tables(tuple(map(tuple, contexts)), tuple(r or (2, 2, 2, 2) for r in ranges))


def read_tables(path: str) -> Tables:
    """Tables of a text file that the driver can open."""
    return parse_tables(Path(path).read_text())


class Coder:
    """An arithmetic decoder over bytes; zeros follow their end."""

    def __init__(self, data: bytes, start: int, states: list[int], ranges: tuple[tuple[int, ...], ...]):
        self.data, self.size, self.states, self.ranges = data, 8 * len(data), states, ranges
        self.restart(start)

    def restart(self, start: int) -> None:
        self.at, self.held, self.buffer = start, 0, 0
        self.range, self.offset = 510, self._bits(9)

    @property
    def pos(self) -> int:
        return 8 * self.at - self.held

    def _bits(self, n: int) -> int:
        if self.held < n:
            more = self.data[self.at : self.at + 8].ljust(8, b"\0")
            self.buffer = (self.buffer & ((1 << self.held) - 1)) << 64 | int.from_bytes(more, "big")
            self.at += 8
            self.held += 64
        self.held -= n
        return self.buffer >> self.held & ((1 << n) - 1)

    def get(self, context: int) -> int:
        state = self.states[context]
        bit, least = state & 1, self.ranges[state >> 1][self.range >> 6 & 3]
        self.range -= least
        if self.offset >= self.range:
            self.offset -= self.range
            self.range = least
            # The likelier bin changes where both were equally likely.
            self.states[context] = 2 * AFTER_LEAST[state >> 1] | (bit ^ (state < 2))
            bit ^= 1
        elif state < 124:
            self.states[context] = state + 2
        if self.range < 256:
            n = 9 - self.range.bit_length()
            self.range <<= n
            self.offset = self.offset << n | self._bits(n)
        return bit

    def even(self) -> int:
        """A bin without a context."""
        self.offset = self.offset << 1 | self._bits(1)
        if self.offset < self.range:
            return 0
        self.offset -= self.range
        return 1

    def ended(self) -> bool:
        self.range -= 2
        if self.offset >= self.range:
            return True
        if self.range < 256:
            self.range <<= 1
            self.offset = self.offset << 1 | self._bits(1)
        return False


@dataclass
class Known:
    """What contexts of later macroblocks ask of one."""

    skip: bool = False
    direct: bool = False
    large_intra: bool = False  # predicted as a whole, or raw
    raw: bool = False
    pattern: int = 0
    means: int = 0  # bits: luma, two of chroma
    mode: int = 0
    transform: int = 0


@dataclass
class Collocated:
    """Motion of a picture, by macroblock: outer blocks of quarters, and shapes."""

    corners: dict[int, list] = field(default_factory=dict)
    shapes: dict[int, str] = field(default_factory=dict)

    def add(self, found: Slice) -> None:
        self.corners |= found.corners()
        self.shapes |= {mb: shape for mb, shape, _ in found.blocks}

    def rests(self, mb: int, quarter: int) -> bool:
        """Whether a quarter's outer block moves by at most a step from its first reference."""
        for ref, x, y in self.corners[mb][quarter] if mb in self.corners else ():
            if ref >= 0:
                return ref == 0 and abs(x) <= 1 and abs(y) <= 1
        return False


class ArithmeticSlice(Slice):
    """``collocated``: motion of the picture that a B slice's direct macroblocks look at."""

    def __init__(self, payload: bytes, head: dict, sps: dict, pps: dict, tables: Tables, collocated: Collocated | None = None):
        super().__init__(payload, head, sps, pps)
        self.payload, self.collocated = payload, collocated
        self.two_way = head["slice_type"] == "B"
        states = tables.states(head["slice_type"] != "I", head["cabac_init_idc"] or 0, head["slice_qp"])
        self.coder = Coder(payload, -(-head["data_bit"] // 8), states, tables.ranges)
        self.get = self.coder.get
        size = len(self.ref)
        first = (self.ref, self.vector, bytearray(size), [(0, 0)] * size, head["num_ref_l0"])
        self.used = [first]
        if self.two_way:
            self.used.append(([MISSING] * size, [(0, 0)] * size, bytearray(size), [(0, 0)] * size, head["num_ref_l1"]))
        self._use(0)
        self.known: dict[int, Known] = {}
        self.changed = 0  # whether the last macroblock changed QP

    def _use(self, k: int) -> None:
        self.ref, self.vector, self.beyond, self.moved, self.references = self.used[k]

    def lists(self) -> list[tuple[list[int], list[tuple[int, int]]]]:
        return [u[:2] for u in self.used]

    def rows(self) -> list[tuple[int, str, list[tuple]]]:
        return self.blocks if self.two_way else super().rows()

    def decode(self) -> tuple[bool, int]:
        mb, last = self.first, self.width * self.height
        complete = True
        try:
            while mb < last:
                self._start(mb)
                self._macroblock(mb)
                if self.coder.pos > self.coder.size:
                    raise Broken
                self.known[mb] = self.now
                mb += 1
                if mb == last or self.coder.ended():
                    break
        except Broken:
            complete = False
            self.blocks = [b for b in self.blocks if b[0] < mb]
        self.end = mb
        return complete, mb - self.first

    def _start(self, mb: int) -> None:
        super()._start(mb)
        self.now = Known()
        self.left = self.known.get(mb - 1) if mb % self.width else None
        self.above = self.known.get(mb - self.width)
        self.near = [n for n in (self.left, self.above) if n]

    def _macroblock(self, mb: int) -> None:
        get, now = self.get, self.now
        if self.two_way or self.inter:
            if get((24 if self.two_way else 11) + sum(not n.skip for n in self.near)):
                now.skip, self.changed = True, 0
                self._direct_whole(mb) if self.two_way else self._skip(mb)
            elif self.two_way:
                self._two_way(mb)
            elif get(14):
                self._intra(self._intra_kind(17, 0))
            elif get(15):
                self._inter(mb, 2 - get(17))
            else:
                self._inter(mb, 3 * get(16))
        else:
            first = sum(n.large_intra for n in self.near)
            self._intra(self._intra_kind(5, 1) if get(3 + first) else 0)

    def _intra_kind(self, base: int, apart: int) -> int:
        """A type from 1 (0 if a bin before tells so); ``apart``: bins have contexts of their own."""
        get = self.get
        if not apart and not get(base):
            return 0
        if self.coder.ended():
            return 25
        kind = 1 + 12 * get(base + 1)
        if get(base + 2):
            kind += 4 + 4 * get(base + 2 + apart)
        kind += 2 * get(base + 3 + apart)
        return kind + get(base + 3 + 2 * apart)

    def _quarter(self) -> int:
        if self.get(21):
            return 0
        if not self.get(22):
            return 1
        return 2 if self.get(23) else 3

    def _reference(self, x: int, y: int, w: int, h: int) -> int:
        if self.references <= 1:
            return 0
        at, ref = self.at + y * self.row + x, 0
        context = 54 + self.beyond[at - 1] + 2 * self.beyond[at - self.row]
        while self.get(context):
            ref += 1
            context = 58 if ref == 1 else 59
            if ref > 31:
                raise Broken
        if ref:
            for a in range(at, at + h * self.row, self.row):
                self.beyond[a : a + w] = b"\1" * w
        return ref

    def _difference(self, at: int, w: int, h: int) -> tuple[int, int]:
        found = []
        for axis, base in ((0, 40), (1, 47)):
            around = self.moved[at - 1][axis] + self.moved[at - self.row][axis]
            found.append(self._step(base, (around > 2) + (around > 32)))
        sizes = tuple(map(abs, found))
        for a in range(at, at + h * self.row, self.row):
            self.moved[a : a + w] = [sizes] * w
        return found[0], found[1]

    def _step(self, base: int, first: int) -> int:
        size, context = 0, base + first
        while size < 9 and self.get(context):
            size += 1
            context = base + min(2 + size, 6)
        if size == 9:
            size += self._exponential(3)
        return (-size if self.coder.even() else size) if size else 0

    def _exponential(self, k: int) -> int:
        """An Exp-Golomb code of order k in bins without contexts."""
        even, value = self.coder.even, 0
        while even():
            value += 1 << k
            k += 1
            if k > 24:
                raise Broken
        for j in reversed(range(k)):
            value += even() << j
        return value

    def _coded(self, whole: bool) -> None:
        pattern = self.now.pattern = self._bits_pattern()
        if self.transform_8x8 and pattern & 15 and whole:
            self.now.transform = self._transform()
        if pattern:
            self._qp()
            self._blocks(pattern, intra=0)
        else:
            self.changed = 0

    def _transform(self) -> int:
        return self.get(399 + sum(n.transform for n in self.near))

    def _bits_pattern(self) -> int:
        left, above = (n.pattern if n else 15 for n in (self.left, self.above))
        out = 0
        for k in range(4):
            # The bit beside it and the one above it; those of this macroblock come first.
            beside = out >> k - 1 if k % 2 else left >> k + 1
            over = out >> k - 2 if k > 1 else above >> k + 2
            out |= self.get(73 + (not beside & 1) + 2 * (not over & 1)) << k
        if self.chroma:
            a, b = (n.pattern >> 4 if n else 0 for n in (self.left, self.above))
            if self.get(77 + (a > 0) + 2 * (b > 0)):
                out |= 16 << self.get(81 + (a > 1) + 2 * (b > 1))
        return out

    def _qp(self) -> None:
        context, n = 60 + self.changed, 0
        while self.get(context):
            n += 1
            context = 62 if n == 1 else 63
            if n > 200:
                raise Broken
        self.changed = int(n > 0)

    def _intra(self, kind: int) -> None:
        get, now = self.get, self.now
        for k in reversed(range(len(self.used))):
            self._use(k)
            self._fill(self.at, 4, 4, INTRA, (0, 0))
        if kind == 25:
            start = -(-self.coder.pos // 8) + 256 + 64 * self.chroma
            if start > len(self.payload):
                raise Broken
            self.coder.restart(start)
            self._count_all(1)
            now.raw = now.large_intra = True
            now.pattern, now.means, self.changed = 15 + 32 * bool(self.chroma), 7, 0
            return
        if kind:
            now.large_intra = True
        else:
            now.transform = self._transform() if self.transform_8x8 else 0
            for _ in range(4 if now.transform else 16):
                if not get(68):
                    get(69), get(69), get(69)
        if self.chroma:
            while now.mode < 3 and get(67 if now.mode else 64 + sum(n.mode > 0 for n in self.near)):
                now.mode += 1
        pattern = now.pattern = 15 * (kind > 12) + 16 * ((kind - 1) // 4 % 3) if kind else self._bits_pattern()
        if pattern or kind:
            self._qp()
            self._blocks(pattern, intra=1, apart=kind > 0)
        else:
            self.changed = 0

    def _flag(self, kind: int, left: int, above: int, intra: int) -> int:
        """Whether a block has coefficients; those that aren't there count as the macroblock is."""
        a, b = (intra if n < 0 else n for n in (left, above))
        return self.get(CODED[kind] + a + 2 * b)

    def _mean(self, kind: int, bit: int, intra: int) -> None:
        left, above = (n.means >> bit & 1 if n else -1 for n in (self.left, self.above))
        if self._flag(kind, left, above, intra):
            self.now.means |= 1 << bit
            self._levels(kind, 2 * self.chroma if kind == 3 else 16)

    def _blocks(self, pattern: int, intra: int, apart: bool = False) -> None:
        if apart:
            self._mean(0, 0, intra)
        for k in range(16):
            if not pattern >> k // 4 & 1:
                continue
            x, y = k // 4 % 2 * 2 + k % 2, k // 8 * 2 + k // 2 % 2
            at = self.at + y * self.row + x
            if self.now.transform:
                if k % 4 == 0:
                    self._levels(5, 64)
                self.counts[at] = 1
            elif self._flag(1 if apart else 2, self.counts[at - 1], self.counts[at - self.row], intra):
                self._levels(1 if apart else 2, 15 if apart else 16)
                self.counts[at] = 1
        if pattern >> 4 and not self.chroma:
            raise Broken
        if pattern >> 4:
            self._mean(3, 1, intra)
            self._mean(3, 2, intra)
        if pattern >> 5:
            for counts in self.chroma_counts:
                for k in range(2 * self.chroma):
                    at = self.chroma_at + k // 2 * self.chroma_row + k % 2
                    if self._flag(4, counts[at - 1], counts[at - self.chroma_row], intra):
                        self._levels(4, 15)
                        counts[at] = 1

    def _levels(self, kind: int, most: int) -> None:
        get, even, present, last = self.get, self.coder.even, PRESENT[kind], LAST[kind]
        total = 0
        for k in range(most - 1):
            p, q = (LARGE_PRESENT[k], LARGE_LAST[k]) if kind == 5 else (min(2 * k // self.chroma, 2),) * 2 if kind == 3 else (k, k)
            if get(present + p):
                total += 1
                if get(last + q):
                    break
        else:
            total += 1  # the last one, which no bin tells of
        ones = larger = 0
        base, most_larger = SIZES[kind] + 5, 3 if kind == 3 else 4
        for _ in range(total):
            if get(base - 5 + (0 if larger else min(4, 1 + ones))):
                size, context = 1, base + min(most_larger, larger)
                while size < 14 and get(context):
                    size += 1
                if size == 14:
                    self._exponential(0)
                larger += 1
            else:
                ones += 1
            even()

    # B slices -----------------------------------------------------------------------------

    def _code(self, codes: list[str], contexts) -> str:
        """Bins up to one of the codes; ``contexts``: of the next bin by those before it."""
        bins = ""
        while bins not in codes:
            bins += str(self.get(contexts(bins)))
        return bins

    def _two_way(self, mb: int) -> None:
        first = 27 + sum(not n.direct for n in self.near)
        bins = self._code(
            [*B_TYPES, B_INTRA], lambda b: first if not b else 30 if len(b) == 1 else 31 if len(b) == 2 and b[1] == "1" else 32
        )
        if bins == B_INTRA:
            return self._intra(self._intra_kind(32, 0))
        kind = B_TYPES.index(bins)
        if kind == 0:
            self._direct_whole(mb)
            return self._coded(True)
        if kind == B_SPLIT:
            return self._quarters(mb)
        if kind < 4:
            (shape, parts), sides, used = PARTS[0], SIDES[0], (kind - 1,)
        else:
            (shape, parts), sides, used = PARTS[1 + kind % 2], SIDES[1 + kind % 2], B_PAIRS[(kind - 4) // 2]
        pieces = [(p, u, [(*p, side)]) for p, u, side in zip(parts, used, sides)]
        self._pieces(mb, shape, pieces, None)
        self._coded(True)

    def _quarters(self, mb: int) -> None:
        contexts = lambda b: 36 if not b else 37 if len(b) == 1 else 38 if len(b) == 2 and b[1] == "1" else 39
        kinds = [B_QUARTERS.index(self._code(B_QUARTERS, contexts)) for _ in range(4)]
        direct = self._direct(mb) if 0 in kinds else None
        pieces = []
        for k, kind in enumerate(kinds):
            x, y = 2 * (k % 2), 2 * (k // 2)
            split, used = B_QUARTER_KINDS[kind - 1] if kind else (0, DIRECT)
            pieces.append(((x, y, 2, 2), used, [(x + dx, y + dy, w, h, None) for dx, dy, w, h in QUARTERS[split]]))
        self._pieces(mb, "8x8", pieces, direct)
        self._coded(all(k == 0 or B_QUARTER_KINDS[k - 1][0] == 0 for k in kinds))

    def _pieces(self, mb: int, shape: str, pieces: list, direct: tuple | None) -> None:
        """Pieces (place, list, parts with the neighbour they take first): references of both lists, then vectors."""
        refs = [[], []]
        for k in (0, 1):
            self._use(k)
            refs[k] = [self._reference(*place) if used in (k, 2) else INTRA for place, used, _ in pieces]
        found = [[False, False, 0, 0, 0, 0] for _ in pieces]
        for k in (0, 1):
            self._use(k)
            for q, (place, used, parts) in enumerate(pieces):
                if used == DIRECT:
                    ref, vector = direct[0][k], direct[1][q][k]
                    self._fill(self.at + place[1] * self.row + place[0], *place[2:], ref, vector)
                elif used in (k, 2):
                    ref = refs[k][q]
                    vector = [self._part(*part[:4], ref, part[4]) for part in parts][0]
                else:
                    ref, vector = INTRA, (0, 0)
                    self._fill(self.at + place[1] * self.row + place[0], *place[2:], ref, vector)
                if ref >= 0:
                    found[q][k], found[q][2 + 2 * k : 4 + 2 * k] = True, vector
        self.blocks.append((mb, shape, [tuple(f) for f in found]))

    def _direct(self, mb: int) -> tuple[list[int], list[list[tuple[int, int]]]]:
        """References by list, and vectors by quarter and list."""
        refs, vectors = [], []
        for k in (0, 1):
            self._use(k)
            ref = min((self.ref[p] for p in self._near(self.at, 4) if self.ref[p] >= 0), default=INTRA)
            refs.append(ref)
            vectors.append(self._predicted(self.at, 4, ref) if ref >= 0 else (0, 0))
        if max(refs) < 0:
            refs = [0, 0]
        quarters = []
        for q in range(4):
            rests = self.collocated is not None and self.collocated.rests(mb, q)
            quarters.append([(0, 0) if rests and ref == 0 else v for ref, v in zip(refs, vectors)])
        return refs, quarters

    def _direct_whole(self, mb: int) -> None:
        """Told as one block where all quarters are equal, else by the collocated one's shape."""
        self.now.direct = True
        refs, quarters = self._direct(mb)
        for k in (0, 1):
            self._use(k)
            for q in range(4):
                self._fill(self.at + q // 2 * 2 * self.row + q % 2 * 2, 2, 2, refs[k], quarters[q][k])
        parts = [(refs[0] >= 0, refs[1] >= 0, *v0, *v1) for v0, v1 in quarters]
        shape = self.collocated.shapes.get(mb, "16x16") if self.collocated else "16x16"
        if all(p == parts[0] for p in parts):
            self.blocks.append((mb, "16x16", parts[:1]))
        elif shape == "16x8":
            self.blocks.append((mb, shape, [parts[0], parts[2]]))
        elif shape == "8x16":
            self.blocks.append((mb, shape, parts[:2]))
        else:
            self.blocks.append((mb, "8x8", parts))


def slice_of(payload: bytes, head: dict, sps: dict, pps: dict, tables: Tables | None, collocated: Collocated | None = None) -> Slice:
    """A slice of either kind of codes, to be decoded."""
    if pps["cabac"]:
        return ArithmeticSlice(payload, head, sps, pps, tables, collocated)
    return Slice(payload, head, sps, pps)


#: Reference pictures whose motion is held.
HELD = 16


def decode_sequence(rows: list[dict], tables: Tables) -> list[dict]:
    """Slices in order, with ``motion``; ``col_frame``: the picture that a B slice looks at."""
    held: dict[int, Collocated] = {}
    for frame, group in groupby(rows, key=itemgetter("frame")):
        own = Collocated()
        for r in group:
            found = slice_of(r["payload"], r["head"], r["sps"], r["pps"], tables, held.get(r["col_frame"]))
            r["motion"] = told(found)
            own.add(found)
        if r["is_ref"]:
            held[frame] = own
            if len(held) > HELD:
                del held[next(iter(held))]
    return rows
