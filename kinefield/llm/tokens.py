"""Token ids of whole texts, cut at safe places so that repeated units are encoded once.

A byte-level vocabulary first cuts a text by a fixed pattern: runs of letters, of digits
or of other signs, each with the one space before it, and white space. Some ends of
matches can be told from two neighbours alone: before a single space between solid
characters, around a single line end between them, and between letters and signs (but
the apostrophe, which starts contractions). Texts are cut there into units; a unit's ids
depend on nothing else. A bounded table in numpy, looked up by hash for all units of a
batch at once, keeps the ids of units met before; a unit takes them only if its code points
are those of the unit kept. All ids come from the tokenizers library; texts that hold an added token, and vocabularies with another pattern, are
encoded whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from kinefield.llm import common

#: Units kept by one Python worker: the first met.
KEEP_UNITS = 1 << 19
#: Characters encoded at once; a longer text is a batch alone.
BATCH_CHARS = 1 << 19

OTHER, LETTER, SIGN, SPACE, LINE, BLANK = range(6)


@lru_cache
def _classes() -> np.ndarray:
    """The class of each code point; letters beyond U+024F count as OTHER."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in map(chr, range(0x250)):
        if c.isalpha():
            out[ord(c)] = LETTER
        elif c.isascii() and c.isprintable() and not c.isalnum() and c not in " '":
            out[ord(c)] = SIGN
    # White space by any definition, and some characters that might count as such.
    doubtful = (*range(0x21), *range(0x7F, 0xA1), 0xAD, 0x1680, 0x180E, *range(0x2000, 0x2010))
    for c in (*doubtful, 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF):
        out[c] = BLANK
    out[32], out[10] = SPACE, LINE
    return out


@lru_cache
def _byte_alphabet() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class UnitTable:
    """hash -> number, for a bounded count of hashes, by open addressing."""

    def __init__(self, keep: int):
        self.keep, self.count = keep, 0
        self.mask = np.uint64(2 * keep - 1)
        self.keys = np.zeros(2 * keep, np.uint64)
        self.numbers = np.full(2 * keep, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        slot = (hashes & self.mask).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            number = self.numbers[slot]
            hit = self.keys[slot] == hashes[left]
            hit &= number >= 0
            out[left[hit]] = number[hit]
            more = ~hit & (number >= 0)
            left, slot = left[more], (slot[more] + 1) & int(self.mask)
        return out

    def add(self, hashes: np.ndarray) -> int:
        """Number distinct new hashes in order; how many of them fitted."""
        n = min(len(hashes), self.keep - self.count)
        left = np.arange(n)
        slot = (hashes[:n] & self.mask).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.numbers[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]] = hashes[left[won]]
            self.numbers[slot[won]] = self.count + left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & int(self.mask)
        self.count += n
        return n


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after another."""
    done = np.cumsum(size)
    return np.repeat(start - (done - size), size) + np.arange(done[-1] if len(done) else 0)


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of ``size`` (1 at least) from ``at`` in a and ``bt`` in b are equal."""
    if not len(size):
        return np.zeros(0, bool)
    same = a[_spread(at, size)] == b[_spread(bt, size)]
    return np.logical_and.reduceat(same, np.cumsum(size) - size)


def _grown(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` from place ``used`` on, with room to grow."""
    if used + len(more) > len(held):
        held = np.concatenate([held[:used], np.zeros(max(used, len(more)) + len(more), held.dtype)])
    held[used : used + len(more)] = more
    return held


class Encoder:
    def __init__(self, path: str, keep: int = KEEP_UNITS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        first = made["pre_tokenizer"] or {}
        self.whole = (
            made["normalizer"] is not None
            or made["model"]["type"] != "BPE"
            or first.get("type") != "ByteLevel"
            or bool(first.get("add_prefix_space"))
            or not first.get("use_regex")
        )
        self.table = UnitTable(keep)
        self.ends = np.zeros(keep + 1, np.int64)
        self.kept = np.zeros(1 << 16, np.uint32)
        # Code points of the kept units, by which a unit is told from one of equal hash.
        self.spelt_ends = np.zeros(keep + 1, np.int64)
        self.spelt = np.zeros(1 << 16, np.uint32)

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def unit(self, unit: str) -> list[int]:
        if unit[unit[0] == " " :].isalpha():  # one match of the pattern
            shown = unit.encode().decode("latin-1").translate(_byte_alphabet())
            return [t.id for t in self.model.tokenize(shown)]
        return self.plain(unit)

    def _alone(self, text: str) -> bool:
        return self.whole or any(t in text for t in self.added)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (and end)."""
        ids, ends, at = [], [np.zeros(1, np.int64)], 0
        for a, b in self._batches(texts):
            got, stops = self._batch(texts[a:b])
            ids.append(got)
            ends.append(stops + at)
            at += len(got)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(ends)

    def _batches(self, texts):
        at = size = 0
        for k, text in enumerate(texts):
            alone = self._alone(text)
            if k > at and (size + len(text) > BATCH_CHARS or alone):
                yield at, k
                at, size = k, 0
            size += len(text)
            if alone:
                yield k, k + 1
                at, size = k + 1, 0
        if at < len(texts):
            yield at, len(texts)

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) == 1 and self._alone(texts[0]):
            ids = np.array(self.plain(texts[0]), np.uint32)
            return ids, np.array([len(ids)], np.int64)
        big = "".join(texts)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not big:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(big.encode("utf-32-le"), "<u4")
        starts = self._cuts(points, bounds)
        ends = np.append(starts[1:], len(points))
        hashes = common.span_hashes(points.view(np.uint8), 4 * starts, 4 * ends)
        size = ends - starts
        number = self.table.find(hashes)
        known = np.flatnonzero(number >= 0)
        begin = self.spelt_ends[number[known]]
        right = self.spelt_ends[number[known] + 1] - begin == size[known]
        right[right] = _equal(points, starts[known[right]], self.spelt, begin[right], size[known[right]])
        strange = known[~right]  # of a kept unit's hash, but not that unit
        missing = np.flatnonzero(number < 0)
        flat, stops = self.kept, self.ends
        if len(missing) or len(strange):
            new, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            where = missing[first]
            right = size[where[which]] == size[missing]
            right[right] = _equal(points, starts[missing[right]], points, starts[where[which[right]]], size[missing[right]])
            strange = np.concatenate([strange, missing[~right]])
            each = np.concatenate([where, strange])
            found = [self.unit(big[s:e]) for s, e in zip(starts[each].tolist(), ends[each].tolist(), strict=True)]
            lens = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((x for f in found for x in f), np.uint32, int(lens.sum()))
            base = self.table.count
            number[missing] = base + which  # also those that aren't kept
            number[strange] = base + len(where) + np.arange(len(strange))
            used = int(self.ends[base])
            more = used + np.cumsum(lens)
            stops = np.concatenate([self.ends[: base + 1], more])
            flat = np.concatenate([self.kept[:used], ids])
            n = self.table.add(new)
            if n:
                self.ends[base + 1 : base + n + 1] = more[:n]
                self.kept = _grown(self.kept, used, ids[: int(more[n - 1]) - used])
                spelt = int(self.spelt_ends[base])
                self.spelt_ends[base + 1 : base + n + 1] = spelt + np.cumsum(size[where[:n]])
                self.spelt = _grown(self.spelt, spelt, points[_spread(starts[where[:n]], size[where[:n]])])
        begin = stops[number]
        count = stops[number + 1] - begin
        done = np.cumsum(count)
        out = flat[_spread(begin, count)]
        # The ids before each text's end are those of the units that begin before it.
        return out, np.concatenate([[0], done])[np.searchsorted(starts, bounds[1:])]

    @staticmethod
    def _cuts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of units; also at each text's start."""
        kind = _classes()[points]
        n = len(kind)
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        solid = kind <= SIGN
        lone = np.zeros(n, bool)  # a space or line end between solid characters of one text
        lone[1:-1] = (solid[:-2] & solid[2:]) & ~(first[1 : n - 1] | first[2:n])
        line = lone & (kind == LINE)
        cut = first[:n] | (lone & (kind == SPACE)) | line
        cut[1:] |= line[:-1]
        letter, sign = kind == LETTER, kind == SIGN
        cut[1:] |= (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
        return np.flatnonzero(cut)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)
