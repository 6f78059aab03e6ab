"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are normalised to letters, digits and single blanks, A-Z in lower case. An item is
sought as a whole, or by overlapping windows if it is long. A place where a window of
length m occurs with at most e edits shares at least m + 1 - q * (e + 1) q-grams with it,
on diagonals that differ by e at most. So q-grams that a document shares with a window are
counted in overlapping bands of diagonals, bands that reach the bound are kept, and an
alignment within the band decides.

Items with fewer than ``exact_bytes`` normalised bytes are too short for that: they are
sought as they are, between blanks or text ends, by hash and comparison.

The benchmark goes to all tasks, in groups of bounded size. Each group is a pass of its own
over the documents, written before the next one, so the driver and a task hold one group at
a time. Documents aren't shuffled.

Defined results: null and empty texts are clean. Items that are null or have no letter or
digit are no evidence and are left out. Rows are judged one by one, so repeated rows and
null ids are no matter. Repeated items (equal item_id and text) are found once. A very long
text is scanned alone. With an empty benchmark all is clean. Extra columns are ignored, or
kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinefield.llm import common

_FILTER_BITS = 22
#: Pairs of a document's gram and a window's that are held at once.
PAIRS = 1 << 22

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
for _k in range(128):
    if not chr(_k).isalnum():
        _PLAIN[_k] = 32


def _bytes(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: The UTF-8 bytes that end signs, by the bytes before them.
_SIGNS = {
    b"\xc2": _bytes((0xA0, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF)),
    b"\xe2\x80": _bytes((0x80, 0xBF)),
    b"\xe2\x81": _bytes((0x80, 0xAF)),
    b"\xe3\x80": _bytes((0x80, 0x83), (0x88, 0xA0)),
    b"\xef\xbc": _bytes((0x81, 0x8F), (0x9A, 0xA0), (0xBB, 0xBF)),
}


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of rows, the rows' offsets in them, and each byte's original place.

    Signs of ASCII, Latin-1, and of the general, CJK and full-width punctuation are blanks.
    """
    plain = _PLAIN[data]
    for lead, signs in _SIGNS.items():
        size = len(lead)
        at = np.flatnonzero(data[: len(data) - size] == lead[0]) if len(data) > size else np.zeros(0, np.int64)
        for k in range(1, size):
            at = at[data[at + k] == lead[k]]
        at = at[signs[data[at + size]]]
        for k in range(size + 1):
            plain[at + k] = 32
    keep = plain != 32
    if len(plain) > 1:
        keep[1:] |= plain[:-1] != 32  # the first blank of a run stays
    begin = offsets[:-1][offsets[:-1] < len(data)]
    keep[begin] = plain[begin] != 32  # but not at a text's start
    at = np.flatnonzero(keep)
    return plain[at], np.searchsorted(at, offsets), at


def aligned(pattern: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[int, int]:
    """Least edits of ``pattern`` against a part of ``text``, and that part's end.

    Only cells on diagonals (text place less pattern place) low..low+width-1 count.
    """
    n, far = len(text), 1 << 20
    steps = np.arange(width)
    place = low + steps  # the text place that a cell of row 0 has passed
    cells = np.where((place >= 0) & (place <= n), 0, far)
    padded = np.full(n + len(pattern) + 2 * width + 4, 256, np.int16)
    shift = max(0, -low) + 1
    padded[shift : shift + n] = text
    for i, c in enumerate(pattern.tolist()):
        seen = padded[shift + low + i : shift + low + i + width]
        new = cells + (seen != c)
        new[:-1] = np.minimum(new[:-1], cells[1:] + 1)
        place = place + 1
        new[(place < 0) | (place > n)] = far
        cells = np.minimum.accumulate(new - steps) + steps
        cells[(place < 0) | (place > n)] = far
    best = int(cells.argmin())
    return int(cells[best]), int(place[best])


class Scanner:
    """Finds windows of a group of items in normalised text."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float, window: int, exact_bytes: int = 24):
        self.q = q
        self.short: dict[int, list[tuple]] = {}  # by size: (item, bytes)
        self.windows: list[tuple] = []  # (item, bytes, edits, least shared grams)
        for item, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            plain, _, _ = normalised(data, np.array([0, len(data)]))
            plain = plain[: len(plain) - 1] if len(plain) and plain[-1] == 32 else plain
            n = len(plain)
            if n < max(exact_bytes, 2 * q):
                if n:
                    self.short.setdefault(n, []).append((item, plain))
                continue
            # An excerpt of window + window // 6 - 1 bytes holds a window. Shorter items are
            # sought as a whole, too, since that allows more edits.
            size = min(n, window)
            spans = [(s, size) for s in (*range(0, n - size, window // 6), n - size)]
            for s, size in [(0, n)] * (window < n < 1.5 * window) + spans:
                edits = min(int(rate * size), size // q - 1)
                self.windows.append((item, plain[s : s + size], edits, size + 1 - q * (edits + 1)))
        hashes, owner, place = [], [], []
        for k, (_, data, _, _) in enumerate(self.windows):
            got = self._hash(data)
            hashes.append(got)
            owner.append(np.full(len(got), k))
            place.append(np.arange(len(got)))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owner = np.concatenate(owner)[order] if hashes else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if hashes else np.zeros(0, np.int64)
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.marks = np.zeros(1 << _FILTER_BITS, bool)
        self.marks[(self.grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.edits = np.array([w[2] for w in self.windows], np.int64)
        self.needed = np.array([w[3] for w in self.windows], np.int64)
        self.reach = max((len(w[1]) + w[2] for w in self.windows), default=0)
        self.fewest = int(self.needed.min()) if len(self.needed) else 0

    def _hash(self, data: np.ndarray) -> np.ndarray:
        sums, n = common.prefix_sums(data), max(0, len(data) - self.q + 1)
        _, down = common.powers(n or 1)
        return common.mix((sums[self.q : self.q + n] - sums[:n]) * down[:n])

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of found windows, in bytes of normalised ``data``."""
        found = self._whole(data, offsets)
        if self.windows and len(data) >= self.q:
            found |= self._near(data, offsets)
        return [(*k, v) for k, v in sorted(found.items(), key=repr)]

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> dict:
        """Places of short items, between blanks or ends of texts."""
        found: dict = {}
        if not self.short or not len(data):
            return found
        blank = data == 32
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        stop = edge.copy()
        stop[:-1] |= blank
        start = np.flatnonzero(edge[:-1] | np.concatenate([[True], blank[:-1]]))
        row = np.searchsorted(offsets, start, side="right") - 1
        for size, items in self.short.items():
            fits = start + size <= offsets[row + 1]
            fits[fits] = stop[start[fits] + size]
            at, of = start[fits], row[fits]
            here = common.span_hashes(data, at, at + size)
            each = np.array([common.span_hashes(b, np.zeros(1, np.int64), np.full(1, size))[0] for _, b in items])
            order = np.argsort(each, kind="stable")
            low, high = np.searchsorted(each[order], here), np.searchsorted(each[order], here, side="right")
            for k in np.flatnonzero(high > low).tolist():
                for item, pattern in (items[j] for j in order[low[k] : high[k]].tolist()):
                    if (data[at[k] : at[k] + size] == pattern).all():
                        found[int(of[k]), item, int(at[k]), int(at[k]) + size] = 0
        return found

    def _pairs(self, hits: np.ndarray, known: np.ndarray, parts: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """(hit, entry of owner and place) for windows of this turn, made in bounded blocks."""
        count = self.first[known + 1] - self.first[known]
        total = np.concatenate([[0], np.cumsum(count)])
        out, a = [], 0
        while a < len(hits):
            b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, side="right")) - 1)
            many = count[a:b]
            entry = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - self.first[known[a:b]], many)
            where = np.repeat(hits[a:b], many)
            if parts > 1:
                mine = self.owner[entry] % parts == turn
                where, entry = where[mine], entry[mine]
            out.append((where, entry))
            a = b
        where, entry = zip(*out, strict=True)
        return np.concatenate(where), np.concatenate(entry)

    def _near(self, data: np.ndarray, offsets: np.ndarray) -> dict:
        """Places of windows with few edits."""
        grams = self._hash(data)
        hits = np.flatnonzero(self.marks[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        known = np.searchsorted(self.grams, grams[hits])
        known = np.minimum(known, len(self.grams) - 1)
        row = np.searchsorted(offsets, hits, side="right") - 1
        real = (self.grams[known] == grams[hits]) & (hits + self.q <= offsets[row + 1])
        hits, known = hits[real], known[real]
        # A found window has ``fewest`` of these grams within its reach.
        need = self.fewest
        if len(hits) < need:
            return {}
        dense = np.flatnonzero(hits[need - 1 :] - hits[: len(hits) - need + 1] <= self.reach)
        delta = np.zeros(len(hits) + 1, np.int64)
        np.add.at(delta, dense, 1)
        np.add.at(delta, dense + need, -1)
        near = np.cumsum(delta)[:-1] > 0
        hits, known = hits[near], known[near]
        found: dict = {}
        if len(hits):
            # A phrase that many items share makes many pairs: windows then take turns.
            parts = 1 + int((self.first[known + 1] - self.first[known]).sum()) // PAIRS
            for turn in range(parts):
                self._align(data, offsets, *self._pairs(hits, known, parts, turn), found)
        return found

    def _align(self, data: np.ndarray, offsets: np.ndarray, where: np.ndarray, entry: np.ndarray, found: dict) -> None:
        """Add to ``found`` what the bands that hold enough grams have."""
        if not len(where):
            return
        owner = self.owner[entry]
        step = self.edits[owner] + 1
        diagonal = where - self.place[entry] + self.reach  # not negative
        band = diagonal // step
        # Each shared gram lies in two bands of two steps: (band - 1) and (band).
        key = np.concatenate([band, np.maximum(band - 1, 0)]) * len(self.windows) + np.concatenate([owner, owner])
        keys, first, counts = np.unique(key, return_index=True, return_counts=True)
        full = counts >= self.needed[keys % len(self.windows)]
        first = first[full] % len(where)
        for k, at, exact in zip(
            keys[full].tolist(), where[first].tolist(), (diagonal[first] - self.reach).tolist(), strict=True
        ):
            window = k % len(self.windows)
            item, pattern, edits, _ = self.windows[window]
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            low, high = int(offsets[row]), int(offsets[row + 1])
            if exact >= low and exact + len(pattern) <= high and (data[exact : exact + len(pattern)] == pattern).all():
                found[row, item, exact, exact + len(pattern)] = 0  # nothing is left to align
                continue
            start = (k // len(self.windows)) * (edits + 1) - self.reach  # the least diagonal
            a, b = max(low, start - edits), min(high, start + 2 * (edits + 1) + len(pattern) + edits)
            if b - a < len(pattern) - edits:
                continue
            width = 2 * (edits + 1) + 2 * edits
            cost, end = aligned(pattern, data[a:b], start - edits - a, width)
            if cost <= edits:
                back, size = aligned(pattern[::-1], data[a : a + end][::-1], -edits, 2 * edits + 1)
                size = size if back <= edits else min(len(pattern), end)
                found[row, item, a + end - size, a + end] = cost


def _judge(scanner: Scanner, texts: pa.Array) -> list[list[dict]]:
    """Found places of each text, in characters of the original."""
    data, offsets = common.text_bytes(texts)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for a, b in common.chunks(offsets):
        part, raw = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        plain, bounds, place = normalised(raw, part)
        for row, item, start, end, edits in scanner.find(plain, bounds):
            base = int(part[row])
            head = bytes(raw[base : int(place[start])]).decode(errors="ignore")
            body = bytes(raw[int(place[start]) : int(place[end - 1]) + 1]).decode(errors="ignore")
            out[a + row].append({"item_id": item, "start": len(head), "end": len(head) + len(body), "edits": edits})
    return out


def scanners(
    benchmark: DataFrame, q: int = 12, rate: float = 0.05, window: int = 120, exact_bytes: int = 24, group_bytes: int = 8 << 20
) -> Iterator[Scanner]:
    """Scanners for groups of items, one after another; a group has about ``group_bytes`` bytes of text."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text")).filter("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = 1 + size // group_bytes
    for k in range(groups):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == k) if groups > 1 else items
        yield Scanner(sorted(some.collect(), key=lambda r: (r[0] is None, r)), q, rate, window, exact_bytes)


_PLACES = "places array<struct<item_id: long, start: int, end: int, edits: int>>"


def _passes(df: DataFrame, benchmark: DataFrame, one_pass, options: dict) -> DataFrame:
    """``one_pass(df, scanner)`` for each scanner in turn; all but the last are written."""
    scratch, held = common.Scratch(df.sparkSession, "scans"), None
    for k, scanner in enumerate(scanners(benchmark, **options)):
        if held is not None:
            df = scratch.table(one_pass(df, held), f"pass-{k}")
        held = scanner
    return one_pass(df, held)


def find_contamination(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, items, places) of each row.

    ``places``: array of item_id, start and end in characters, and edits.
    """

    def one_pass(df: DataFrame, scanner: Scanner) -> DataFrame:
        def run(batch):
            texts = batch.column("text")
            places = [x + y for x, y in zip(batch.column("places").to_pylist(), _judge(scanner, texts), strict=True)]
            yield {"doc_id": batch.column("doc_id"), "text": texts, "places": places}

        return common.map_arrow(df, run, f"doc_id long, text string, {_PLACES}")

    rows = documents.select(F.col("doc_id").cast("long"), "text", F.expr(f"cast(array() as {_PLACES.removeprefix('places ')})").alias("places"))
    found = _passes(rows, benchmark, one_pass, options)
    ids = F.array_compact(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["item_id"]))))
    return found.select("doc_id", (F.size("places") > 0).alias("contaminated"), ids.alias("items"), "places")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with their own columns, in which no item is found."""

    def one_pass(df: DataFrame, scanner: Scanner) -> DataFrame:
        def run(batches):
            for batch in common.released(batches):
                for k in range(0, batch.num_rows, common.BATCH_ROWS):
                    part = batch.slice(k, common.BATCH_ROWS)
                    gone = [bool(x) for x in _judge(scanner, part.column("text"))]
                    yield part.filter(pa.array(~np.array(gone, bool)))

        return df.mapInArrow(run, df.schema)

    common.small_batches(documents.sparkSession)
    return _passes(documents, benchmark, one_pass, options)
