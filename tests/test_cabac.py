"""Arithmetic-coded slices: an encoder and a writer with contexts and predictors of their own."""

import random

import pytest

from kinefield.plans import extract as E
from kinefield.plans.pictures import h264_slices, h264_vectors
from kinefield.sources import cabac as A
from kinefield.sources import video
from tests.test_cavlc import CENTRES, Writer, _escaped
from tests.test_syntax import pack, se, ue


def table_text(seed=1):
    """Made-up tables; an encoder and a decoder need only have the same."""
    rng = random.Random(seed)
    lines = [f"context,{k}," + ",".join(f"{rng.randint(-30, 30)},{rng.randint(0, 100)}" for _ in range(4)) for k in range(A.N_CONTEXTS)]
    lines += [f"range,{s}," + ",".join(str(max(6, int(0.5 * 0.949**s * (256 + 64 * q)))) for q in range(4)) for s in range(63)]
    return "\n".join(lines)


TABLES = A.parse_tables(table_text())


class Encoder:
    """The encoder of the published standard."""

    def __init__(self, states):
        self.states = [[s >> 1, s & 1] for s in states]
        self.bits = []
        self.restart()

    def restart(self):
        self.low, self.range, self.first, self.waiting = 0, 510, True, 0

    def put(self, b):
        if not self.first:
            self.bits.append(b)
        self.first = False
        self.bits += [1 - b] * self.waiting
        self.waiting = 0

    def renorm(self):
        while self.range < 256:
            if self.low >= 512:
                self.low -= 512
                self.put(1)
            elif self.low < 256:
                self.put(0)
            else:
                self.low -= 256
                self.waiting += 1
            self.range *= 2
            self.low *= 2

    def bin(self, ctx, b):
        state, likely = self.states[ctx]
        least = TABLES.ranges[state][(self.range >> 6) & 3]
        self.range -= least
        if b != likely:
            self.low += self.range
            self.range = least
            self.states[ctx] = [A.AFTER_LEAST[state], likely if state else 1 - likely]
        else:
            self.states[ctx][0] = min(state + 1, 62)
        self.renorm()

    def even(self, b):
        self.low = 2 * self.low + b * self.range
        if self.low >= 1024:
            self.put(1)
            self.low -= 1024
        elif self.low < 512:
            self.put(0)
        else:
            self.low -= 512
            self.waiting += 1

    def end(self, b):
        self.range -= 2
        if b:
            self.low += self.range
            self.range = 2
            self.renorm()
            self.put(self.low >> 9 & 1)
            self.bits += [self.low >> 8 & 1, 1]
        else:
            self.renorm()


SPLITS = [[(0, 0, 2, 2)], [(0, 0, 2, 1), (0, 1, 2, 1)], [(0, 0, 1, 2), (1, 0, 1, 2)], [(i, j, 1, 1) for j in (0, 1) for i in (0, 1)]]


class Arithmetic(Writer):
    def __init__(self, rng, w, h, first, chroma, refs, t8, kind="P", qp=26, init=0, col=None):
        super().__init__(rng, w, h, first, chroma, refs[0], t8, kind != "I")
        self.kind, self.n, self.col = kind, refs, col
        self.e = Encoder(TABLES.states(kind != "I", init, qp))
        self.bin = self.e.bin
        self.motions, self.diffs, self.mbs, self.cbf, self.dqp = [{}, {}], [{}, {}], {}, {}, 0
        self.use(0)

    def use(self, k):
        self.motion, self.diff, self.k = self.motions[k], self.diffs[k], k

    def around(self, mb):
        return self.mbs.get(mb - 1) if mb % self.w else None, self.mbs.get(mb - self.w)

    # Elements -------------------------------------------------------------------------

    def text(self, bits, contexts):
        for k, b in enumerate(bits):
            self.bin(contexts[min(k, len(contexts) - 1)], int(b))

    def golomb(self, v, k):
        while v >= 1 << k:
            self.e.even(1)
            v -= 1 << k
            k += 1
        self.e.even(0)
        for j in reversed(range(k)):
            self.e.even(v >> j & 1)

    def write_ref(self, x, y, w, h, r):
        if self.n[self.k] > 1:
            near = [self.refs_at.get((self.k, *p), 0) > 0 for p in ((x - 1, y), (x, y - 1))]
            self.text("1" * r + "0", [54 + near[0] + 2 * near[1], 58, 59])
        self.refs_at.update({(self.k, x + i, y + j): r for i in range(w) for j in range(h)})

    def part(self, x, y, w, h, ref, only=None):
        p = self.predict(x, y, w, ref, only)
        v = p if self.rng.random() < 0.3 else tuple(c + self.rng.choice([self.rng.randint(-4, 4), self.rng.randint(-900, 900)]) for c in p)
        d = [v[0] - p[0], v[1] - p[1]]
        for axis, base in ((0, 40), (1, 47)):
            total = sum(abs(self.diff.get(q, (0, 0))[axis]) for q in ((x - 1, y), (x, y - 1)))
            size = abs(d[axis])
            prefix = "1" * min(size, 9) + "0" * (size < 9)
            self.text(prefix, [base + (total > 2) + (total > 32), base + 3, base + 4, base + 5, base + 6])
            if size >= 9:
                self.golomb(size - 9, 3)
            if size:
                self.e.even(int(d[axis] < 0))
        self.diff.update({(x + i, y + j): d for i in range(w) for j in range(h)})
        self.fill(x, y, w, h, ref, v)
        return v

    def write_pattern(self, mb, pattern):
        cell = lambda x, y: self.patterns.get((x, y))  # noqa: E731  bits of quarters, by place
        bx, by = 2 * (mb % self.w), 2 * (mb // self.w)
        for k in range(4):
            x, y = bx + k % 2, by + k // 2
            a, b = cell(x - 1, y), cell(x, y - 1)
            self.bin(73 + (a == 0) + 2 * (b == 0), pattern >> k & 1)
            self.patterns[x, y] = pattern >> k & 1
        if self.rows:
            a, b = ((n["cbp"] >> 4 if n else 0) for n in self.around(mb))
            self.bin(77 + (a > 0) + 2 * (b > 0), int(pattern > 15))
            if pattern > 15:
                self.bin(81 + (a == 2) + 2 * (b == 2), int(pattern > 31))

    def write_dqp(self):
        n = self.rng.choice([0, 0, 1, 2, 5])
        self.text("1" * n + "0", [60 + self.dqp, 62, 63])
        self.dqp = int(n > 0)

    def coefficients(self, cat, most):
        rng = self.rng
        there = sorted(rng.sample(range(most), rng.choice([1, 1, 2, min(5, most), most])))
        for i in range(most - 1):
            p, q = (A.LARGE_PRESENT[i], A.LARGE_LAST[i]) if cat == 5 else (i, i)
            if cat == 3:
                p = q = min(i if self.rows == 2 else i // 2, 2)
            self.bin(A.PRESENT[cat] + p, int(i in there))
            if i in there:
                self.bin(A.LAST[cat] + q, int(i == there[-1]))
                if i == there[-1]:
                    break
        ones = larger = 0
        for _ in there:
            v = rng.choice([1, 1, 2, 3, 9, 14, 15, 16, 400])
            first = A.SIZES[cat] + (0 if larger else min(4, 1 + ones))
            rest = A.SIZES[cat] + 5 + min(4 - (cat == 3), larger)
            self.text("1" * min(v - 1, 14) + "0" * (v < 15), [first, rest])
            if v >= 15:
                self.golomb(v - 15, 0)
            ones, larger = ones + (v == 1), larger + (v > 1)
            self.e.even(rng.randrange(2))

    def flagged(self, cat, key, near, intra, most):
        flags = [intra if n is None else n for n in near]
        b = int(self.rng.random() < 0.6)
        self.bin(A.CODED[cat] + flags[0] + 2 * flags[1], b)
        if b:
            self.coefficients(cat, most)
        self.cbf[key] = b

    def mean(self, mb, cat, plane, intra, most):
        near = [None if n is None else self.cbf.get(("dc", plane, m), 0) for n, m in zip(self.around(mb), (mb - 1, mb - self.w))]
        self.flagged(cat, ("dc", plane, mb), near, intra, most)

    def rest(self, mb, pattern, intra, t8=False, apart=False):
        mx, my = mb % self.w, mb // self.w
        if apart:
            self.mean(mb, 0, "y", intra, 16)
        for q in range(4):
            if not pattern >> q & 1:
                continue
            if t8:
                self.coefficients(5, 64)
            for k in range(4):
                x, y = 4 * mx + q % 2 * 2 + k % 2, 4 * my + q // 2 * 2 + k // 2
                if t8:
                    self.cbf["y", x, y] = 1
                else:
                    self.flagged(1 if apart else 2, ("y", x, y), [self.cbf.get(("y", *p)) for p in ((x - 1, y), (x, y - 1))], intra, 15 if apart else 16)
        for plane in "uv" if pattern > 15 else "":
            self.mean(mb, 3, plane, intra, 2 * self.rows)
        for plane in "uv" if pattern > 31 else "":
            for k in range(2 * self.rows):
                x, y = 2 * mx + k % 2, self.rows * my + k // 2
                self.flagged(4, (plane, x, y), [self.cbf.get((plane, *p)) for p in ((x - 1, y), (x, y - 1))], intra, 15)

    def all_flags(self, mx, my, n):
        self.cbf.update({("y", 4 * mx + i, 4 * my + j): n for i in range(4) for j in range(4)})
        self.cbf.update({(c, 2 * mx + i, self.rows * my + j): n for c in "uv" for i in range(2) for j in range(self.rows)})

    # Macroblocks ----------------------------------------------------------------------

    def random_pattern(self):
        return self.rng.randrange(16) + 16 * (self.rng.randrange(3) if self.rows else 0)

    def inter_rest(self, mb, whole):
        pattern = self.random_pattern() if self.rng.random() < 0.7 else 0
        self.write_pattern(mb, pattern)
        t8 = False
        if self.t8 and pattern & 15 and whole:
            t8 = self.write_t8(mb)
        if pattern:
            self.write_dqp()
            self.rest(mb, pattern, 0, t8)
        else:
            self.dqp = 0
        self.now |= {"cbp": pattern, "t8": t8}

    def write_t8(self, mb):
        t8 = self.rng.random() < 0.5
        self.bin(399 + sum(bool(n and n["t8"]) for n in self.around(mb)), int(t8))
        return t8

    def intra(self, mb, base):
        """``base``: None in an I slice, else the context of the first bin after the prefix."""
        rng, mx, my = self.rng, mb % self.w, mb // self.w
        kind = rng.choice(["i4", "i16", "pcm"])
        for k in (1, 0) if self.kind == "B" else (0,):
            self.use(k)
            self.fill(4 * mx, 4 * my, 4, 4, -1, (0, 0))
        first = base if base else 3 + sum(bool(n and n["whole"]) for n in self.around(mb))
        self.bin(first, int(kind != "i4"))
        self.now |= {"whole": kind != "i4"}
        if kind != "i4":
            self.e.end(int(kind == "pcm"))
        if kind == "pcm":
            bits = self.e.bits
            bits += [0] * (-len(bits) % 8) + [rng.randrange(2) for _ in range(8 * (256 + 64 * self.rows))]
            self.e.restart()
            self.all_flags(mx, my, 1)
            self.cbf.update({("dc", c, mb): 1 for c in "yuv"})
            self.patterns.update({(2 * mx + i, 2 * my + j): 1 for i in (0, 1) for j in (0, 1)})
            self.now |= {"cbp": 47 if self.rows else 15}
            self.dqp = 0
            return
        if kind == "i16":
            luma, chroma, mode = rng.choice([0, 15]), rng.randrange(3) if self.rows else 0, rng.randrange(4)
            c = [base + k for k in (1, 2, 2, 3, 3)] if base else [6, 7, 8, 9, 10]
            self.bin(c[0], int(luma > 0))
            self.bin(c[1], int(chroma > 0))
            if chroma:
                self.bin(c[2], chroma - 1)
            self.bin(c[3], mode >> 1)
            self.bin(c[4], mode & 1)
            pattern, t8 = luma + 16 * chroma, False
            self.patterns.update({(2 * mx + i, 2 * my + j): luma & 1 for i in (0, 1) for j in (0, 1)})
        else:
            t8 = self.write_t8(mb) if self.t8 else False
            for _ in range(4 if t8 else 16):
                self.text(rng.choice(["1", "0101"]), [68, 69])
        if self.rows:
            mode = rng.randrange(4)
            self.text("1" * mode + "0" * (mode < 3), [64 + sum(bool(n and n["mode"]) for n in self.around(mb)), 67])
            self.now["mode"] = mode
        if kind == "i4":
            pattern = self.random_pattern() if rng.random() < 0.7 else 0
            self.write_pattern(mb, pattern)
        self.now |= {"cbp": pattern, "t8": t8}
        if pattern or kind == "i16":
            self.write_dqp()
            self.rest(mb, pattern, 1, t8, kind == "i16")
        else:
            self.dqp = 0

    def macroblock(self, mb):
        rng, mx, my = self.rng, mb % self.w, mb // self.w
        x, y = 4 * mx, 4 * my
        self.all_flags(mx, my, 0)
        self.now = {"skip": False, "direct": False, "whole": False, "cbp": 0, "t8": False, "mode": 0}
        if self.kind == "I":
            self.intra(mb, None)
        else:
            kind = rng.choice(["skip", "inter", "inter", "inter", "intra"] + ["direct"] * (self.kind == "B"))
            near = self.around(mb)
            self.bin((24 if self.kind == "B" else 11) + sum(bool(n and not n["skip"]) for n in near), int(kind == "skip"))
            if kind == "skip":
                self.now |= {"skip": True, "direct": True}
                self.dqp = 0
                if self.kind == "B":
                    self.direct_whole(mb)
                else:
                    a, b = self.motion.get((x - 1, y)), self.motion.get((x, y - 1))
                    v = (0, 0) if a is None or b is None or (0, (0, 0)) in (a, b) else self.predict(x, y, 4, 0)
                    self.fill(x, y, 4, 4, 0, v)
                    self.want.append((mb, "16x16", [(True, False, *v, 0, 0)]))
            elif self.kind == "B":
                self.two_way(mb, kind, 27 + sum(bool(n and not n["direct"]) for n in near))
            elif kind == "intra":
                self.bin(14, 1)
                self.intra(mb, 17)
            else:
                self.one_way(mb)
        for i in (0, 1):
            for j in (0, 1):
                self.patterns.setdefault((2 * mx + i, 2 * my + j), 0)
        self.mbs[mb] = self.now

    def one_way(self, mb):
        rng, x, y = self.rng, 4 * (mb % self.w), 4 * (mb // self.w)
        kind, whole = rng.randrange(4), True
        self.text(("000", "011", "010", "001")[kind], [14, 15, 17 if kind in (1, 2) else 16])
        if kind < 3:
            parts = [[(0, 0, 4, 4, None)], [(0, 0, 4, 2, 1), (0, 2, 4, 2, 0)], [(0, 0, 2, 4, 0), (2, 0, 2, 4, 2)]][kind]
            refs = [rng.randrange(self.n[0]) for _ in parts]
            for (dx, dy, w, h, _), r in zip(parts, refs):
                self.write_ref(x + dx, y + dy, w, h, r)
            vs = [self.part(x + dx, y + dy, w, h, r, only) for (dx, dy, w, h, only), r in zip(parts, refs)]
        else:
            subs = [rng.choice([0, 0, 1, 2, 3]) for _ in range(4)]
            whole = not any(subs)
            for s in subs:
                self.text(("1", "00", "011", "010")[s], [21, 22, 23])
            refs = [rng.randrange(self.n[0]) for _ in subs]
            for q, r in enumerate(refs):
                self.write_ref(x + q % 2 * 2, y + q // 2 * 2, 2, 2, r)
            vs = [[self.part(x + q % 2 * 2 + i, y + q // 2 * 2 + j, w, h, r) for i, j, w, h in SPLITS[s]][0] for q, (s, r) in enumerate(zip(subs, refs))]
        self.want.append((mb, ["16x16", "16x8", "8x16", "8x8"][kind], [(True, False, *v, 0, 0) for v in vs]))
        self.inter_rest(mb, whole)

    # Both lists -----------------------------------------------------------------------

    def direct(self, mb):
        x, y = 4 * (mb % self.w), 4 * (mb // self.w)
        refs, vs = [], []
        for k in (0, 1):
            self.use(k)
            near = self.neighbours(x, y, 4)
            r = min((n[0] for n in near if n and n[0] >= 0), default=-1)
            refs.append(r)
            vs.append(self.predict(x, y, 4, r) if r >= 0 else (0, 0))
        refs = [0, 0] if refs == [-1, -1] else refs
        out = []
        for q in range(4):
            (r0, *v0), (r1, *v1) = self.col[0][mb][q] if mb in self.col[0] else ((-1, 0, 0), (-1, 0, 0))
            v = v0 if r0 >= 0 else v1
            still = (r0 == 0 or (r0 < 0 and r1 == 0)) and max(abs(v[0]), abs(v[1])) <= 1
            out.append([(0, 0) if still and refs[k] == 0 else vs[k] for k in (0, 1)])
        return refs, out

    def direct_whole(self, mb):
        self.now["direct"] = True
        refs, vs = self.direct(mb)
        for k in (0, 1):
            self.use(k)
            for q in range(4):
                self.fill(4 * (mb % self.w) + q % 2 * 2, 4 * (mb // self.w) + q // 2 * 2, 2, 2, refs[k], vs[q][k])
        rows = [(refs[0] >= 0, refs[1] >= 0, *a, *b) for a, b in vs]
        shape = "16x16" if len(set(rows)) == 1 else {"16x8": "16x8", "8x16": "8x16"}.get(self.col[1].get(mb, "16x16"), "8x8")
        self.want.append((mb, shape, {"16x16": rows[:1], "16x8": rows[::2], "8x16": rows[:2], "8x8": rows}[shape]))

    def bins_of(self, bits, first):
        self.bin(first, int(bits[0]))
        for k, b in enumerate(bits[1:], 1):
            self.bin(30 if k == 1 else 31 if k == 2 and bits[1] == "1" else 32, int(b))

    def two_way(self, mb, kind, first):
        rng, x, y = self.rng, 4 * (mb % self.w), 4 * (mb // self.w)
        if kind == "intra":
            self.bins_of("111101", first)
            return self.intra(mb, 32)
        if kind == "direct":
            self.bins_of("0", first)
            self.direct_whole(mb)
            return self.inter_rest(mb, True)
        kind = rng.choice([*range(1, 22), 22, 22, 22])
        self.bins_of(A.B_TYPES[kind], first)
        direct, whole = None, True
        if kind == 22:
            subs = [rng.choice([0, 1, 2, 3, *range(13)]) for _ in range(4)]
            for s in subs:
                bits = A.B_QUARTERS[s]
                for k, b in enumerate(bits):
                    self.bin((36, 37, 38 if bits[1:2] == "1" else 39)[k] if k < 3 else 39, int(b))
            if 0 in subs:
                direct = self.direct(mb)
            names = "- 8x8:0 8x8:1 8x8:2 8x4:0 4x8:0 8x4:1 4x8:1 8x4:2 4x8:2 4x4:0 4x4:1 4x4:2".split()
            pieces, shape = [], "8x8"
            for q, s in enumerate(subs):
                size, _, used = names[s].partition(":")
                split = SPLITS[("8x8", "8x4", "4x8", "4x4").index(size)] if s else SPLITS[0]
                whole &= size in ("-", "8x8")
                qx, qy = x + q % 2 * 2, y + q // 2 * 2
                pieces.append(((qx, qy, 2, 2), int(used) if s else -1, [(qx + i, qy + j, w, h, None) for i, j, w, h in split]))
        elif kind < 4:
            shape, pieces = "16x16", [((x, y, 4, 4), kind - 1, [(x, y, 4, 4, None)])]
        else:
            pair = ("00", "11", "01", "10", "02", "12", "20", "21", "22")[kind // 2 - 2]
            shape = "8x16" if kind % 2 else "16x8"
            places = [(x, y, 2, 4, 0), (x + 2, y, 2, 4, 2)] if kind % 2 else [(x, y, 4, 2, 1), (x, y + 2, 4, 2, 0)]
            pieces = [(p[:4], int(u), [p]) for p, u in zip(places, pair)]
        refs = {}
        for k in (0, 1):
            self.use(k)
            for q, (place, used, _) in enumerate(pieces):
                if used in (k, 2):
                    refs[q, k] = rng.randrange(self.n[k])
                    self.write_ref(*place, refs[q, k])
        rows = [[used in (0, 2), used in (1, 2), 0, 0, 0, 0] for _, used, _ in pieces]
        for k in (0, 1):
            self.use(k)
            for q, (place, used, parts) in enumerate(pieces):
                if used == -1:
                    self.fill(*place, direct[0][k], direct[1][q][k])
                    if direct[0][k] >= 0:
                        rows[q][k], rows[q][2 + 2 * k : 4 + 2 * k] = True, direct[1][q][k]
                elif used in (k, 2):
                    rows[q][2 + 2 * k : 4 + 2 * k] = [self.part(*p[:4], refs[q, k], p[4]) for p in parts][0]
                else:
                    self.fill(*place, -1, (0, 0))
        self.want.append((mb, shape, [tuple(r) for r in rows]))
        self.inter_rest(mb, whole)

    def write(self, count):
        self.refs_at, self.patterns = {}, {}
        for mb in range(self.first, self.first + count):
            self.macroblock(mb)
            if mb < self.w * self.h - 1:
                self.e.end(int(mb == self.first + count - 1))
        if self.first + count == self.w * self.h:
            self.e.end(1)
        bits = self.e.bits + [0] * (-len(self.e.bits) % 8)
        return bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))

    def corners(self):
        out = {}
        for mb in self.mbs:
            x, y = 4 * (mb % self.w), 4 * (mb // self.w)
            places = [(x + i, y + j) for j in (0, 3) for i in (0, 3)]
            out[mb] = [[(m[p][0], *m[p][1]) if p in m else (-1, 0, 0) for m in self.motions] for p in places]
        return out


def random_motion(rng, n):
    """Corners and shapes of a picture, some macroblocks missing."""
    entry = lambda: (rng.choice([-1, 0, 0, 1]), rng.randint(-2, 2), rng.randint(-2, 2))
    mbs = [m for m in range(n) if rng.random() < 0.9]
    shapes = {m: rng.choice(["16x16", "16x8", "8x16", "8x8"]) for m in mbs if rng.random() < 0.8}
    return {m: [[entry(), entry()] for _ in range(4)] for m in mbs}, shapes


def fields(kind, w, h, chroma, refs, t8, first=0, at=0, qp=26, init=0):
    head = {"data_bit": at, "slice_type": kind, "num_ref_l0": refs[0], "num_ref_l1": refs[1], "first_mb": first, "slice_qp": qp, "cabac_init_idc": init}
    sps = {"width_in_mbs": w, "height_in_map_units": h, "frame_mbs_only": 1, "chroma_format_idc": chroma}
    return head, sps, {"transform_8x8_mode": t8}


@pytest.mark.parametrize("seed", range(120))
def test_random_slices(seed):
    rng = random.Random(seed)
    w, h, chroma, refs, t8, kind = rng.randint(1, 5), rng.randint(1, 5), seed % 3, (rng.randint(1, 4), rng.randint(1, 4)), seed % 2, "IPBB"[seed % 4]
    first = rng.randrange(w * h) if seed % 5 == 0 else 0
    count = rng.randint(1, w * h - first) if seed % 3 == 0 else w * h - first
    qp, init = rng.randrange(52), rng.randrange(3)
    col = random_motion(rng, w * h)
    writer = Arithmetic(rng, w, h, first, chroma, refs, t8, kind, qp, init, col)
    payload = b"\xff" * 3 + writer.write(count)
    found = A.ArithmeticSlice(payload, *fields(kind, w, h, chroma, refs, t8, first, 19, qp, init), TABLES, A.Collocated(*col))
    assert found.decode() == (True, count)
    assert found.rows() == writer.want
    want = writer.corners()
    assert found.corners() == {m: [c[: len(found.lists())] for c in want[m]] for m in want}


@pytest.mark.parametrize("seed", range(40))
def test_damaged_slices_end(seed):
    rng = random.Random(seed)
    payload = rng.randbytes(rng.choice([0, 1, 40, 3000]))
    args = fields("PIB"[seed % 3], 4, 4, seed % 3, (1 + seed % 3, 2), seed % 2, seed % 5)
    complete, n = A.ArithmeticSlice(payload, *args, TABLES).decode()
    assert isinstance(complete, bool) and 0 <= n <= 16


def test_tables(tmp_path):
    (tmp_path / "t").write_text(table_text())
    assert A.read_tables(str(tmp_path / "t")) == TABLES
    assert TABLES.states(False, 0, 0)[7] == (lambda n: 2 * (63 - n) if n < 64 else 2 * (n - 64) + 1)(min(max(TABLES.contexts[0][7][1], 1), 126))
    for bad in ("context,1,2", "range,1,1,1,1", "other,1"):
        with pytest.raises(ValueError):
            A.parse_tables(bad)


def stream(rng, n=9):
    """Pictures of two slices (IDR at 0 and 5, B at odd places but the last), and their vectors.

    Each B picture, which no other one refers to, comes after the P picture that it precedes.
    """
    sps = b"\x67" + pack(f"{77:08b}", "0" * 16, ue(0), ue(0), ue(0), ue(0), ue(2), "0", ue(2), ue(2), "1", "1")
    pps = b"\x68" + pack(ue(0), ue(0), "10", ue(0), ue(0), ue(0), "000", se(0), se(0), se(0), "000")
    units, want, held = [sps, pps], [], {}
    for frame in range(n):
        base = 0 if frame < 5 else 5
        kind = "I" if frame == base else "PB"[(frame - base) % 2 == 0]
        poc = 0 if kind == "I" else 2 * (frame - base + 1) if kind == "P" else 2 * (frame - base - 1)
        if kind == "I":
            held = {}
        later, earlier = sorted(p for p in held if p > poc), sorted((p for p in held if p < poc), reverse=True)
        near = (later + earlier + [None])[0]
        motion, shapes = {}, {}
        for first, count in ((0, 4), (4, 5)):
            writer = Arithmetic(rng, 3, 3, first, 1, (2, 1), 0, kind, 26, 0, held.get(near, ({}, {})))
            ref = kind != "B"
            bits = [ue(first), ue({"I": 7, "P": 5, "B": 6}[kind]), ue(0), f"{frame - base:04b}", ue(0) if kind == "I" else "", f"{poc:04b}"]
            bits += ["1"] if kind == "B" else []
            bits += ["1", ue(1), ue(0) if kind == "B" else ""] if kind != "I" else []
            bits += ["0"] * (0 if kind == "I" else 2 if kind == "B" else 1)
            bits += ["00" if kind == "I" else "0"] if ref else []
            bits += [ue(0)] if kind != "I" else []
            lead = "".join([*bits, se(0)])
            lead += "1" * (-len(lead) % 8)
            data = int(lead, 2).to_bytes(len(lead) // 8, "big") + writer.write(count)
            units.append(bytes([0x65 if kind == "I" else 0x61 if ref else 0x01]) + data)
            motion |= writer.corners()
            shapes |= {mb: shape for mb, shape, _ in writer.want}
            for mb, shape, parts in writer.want:
                for k in (0, 1):
                    if any(p[k] for p in parts):
                        centres = zip(CENTRES[shape], parts)
                        want += [(frame, 16 * (mb % 3) + x, 16 * (mb // 3) + y, 2 * k - 1, *p[2 + 2 * k : 4 + 2 * k]) for (x, y), p in centres]
        if kind != "B":
            held[poc] = (motion, shapes)
    return b"".join(b"\0\0\1" + _escaped(u) for u in units), want


def test_stream_with_b_slices(spark, tmp_path):
    data, want = stream(random.Random(7))
    units = video.units(spark.createDataFrame([("a.264", bytearray(data)), ("b.264", bytearray(data))], "path string, content binary")).cache()
    slices = h264_slices(units)
    got = h264_vectors(slices, tables=TABLES, b_slices=True).filter("video = 'b.264'")
    got = sorted(tuple(r) for r in got.select("frame", "cx", "cy", "source", "mv_x", "mv_y").collect())
    assert got == sorted(want) and {w[0] for w in want} == {1, 2, 3, 4, 6, 7, 8}
    one_way = sorted(w for w in want if w[0] in (1, 3, 6, 8))
    got = h264_vectors(slices, tables=TABLES).filter("video = 'a.264'")
    assert sorted(tuple(r) for r in got.select("frame", "cx", "cy", "source", "mv_x", "mv_y").collect()) == one_way
    (tmp_path / "t").write_text(table_text())
    counted = E.counters(units, E.Options(tables=str(tmp_path / "t"), b_slices=True)).first()
    assert (counted.frames, counted.cabac_decoded, counted.b_decoded, counted.parse_errors, counted.unsupported) == (9, 12, 6, 0, 0)
    counted = E.counters(units).first()
    assert (counted.cabac_decoded, counted.b_skipped, counted.unsupported) == (0, 6, 12)
    rows = E.extract(units, E.Options(tables=str(tmp_path / "t"), b_slices=True, l0_only=True))
    assert {r.source for r in rows.select("source").distinct().collect()} == {-1}
    with pytest.raises(ValueError):
        E.Options(b_slices=True)
