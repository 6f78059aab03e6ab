"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds the modular prefix sums of a text's code points. The hash of any span
comes from two of them, so spans compare in constant time, and the longest common
extension of two places is found by binary search. A text that shares a head with another
takes over that part of its arrays.

A fingerprint is the length, the hash of the whole text to two bases modulo 2**31 - 1,
and the smallest hashes of its windows of ``WINDOW`` code points. The likeness of two
fingerprints estimates the Jaccard likeness of the texts' windows from those.

Defined results: a null text is empty. Equal texts, also empty ones, have likeness 1 and
equal fingerprints; an empty and another text have 0. Texts shorter than a window have one
window. Rows stand in the order of doc_id (null first), then of a hash of the text; the
row after the last is the first, which may be the same row. A very long text takes some 50
bytes a code point of one task's memory. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinefield.llm import common

PRIME = (1 << 31) - 1
BASES = (911_382_323, 1_402_024_111)
WINDOW, KEEP = 8, 64
_P = np.uint64(PRIME)
_LOW = -(1 << 63)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x < 2**62."""
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    return np.where(x >= _P, x - _P, x)


class _Powers:
    """Powers of a base and of its inverse, as far as texts need them."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, PRIME))
        self.rows = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __call__(self, n: int, which: int) -> np.ndarray:
        row = self.rows[which]
        while len(row) < n:
            step = np.uint64(pow(self.bases[which], len(row), PRIME))
            row = np.concatenate([row, _mod(row * step)])
        self.rows[which] = row
        return row[:n]


_POWERS = [_Powers(b) for b in BASES]


class Prefixes:
    """Prefix sums of a text: sum of (code point + 1) * base**i modulo the prime."""

    def __init__(self, text: str, head: Prefixes | None = None, shared: int = 0):
        """``head``: a text whose first ``shared`` code points are this text's too."""
        self.n = len(text)
        points = np.frombuffer(text[shared:].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.sums = []
        for k, power in enumerate(_POWERS):
            sums = np.empty(self.n + 1, np.uint64)
            sums[: shared + 1] = head.sums[k][: shared + 1] if head else 0
            terms = _mod(points * power(self.n, 0)[shared:])
            np.cumsum(terms, out=sums[shared + 1 :])
            sums[shared + 1 :] = _mod(sums[shared + 1 :] + sums[shared])
            self.sums.append(sums)
        self._windows = None
        if head is not None and shared >= WINDOW and head._windows is not None:
            count = shared - WINDOW + 1
            self._windows = np.concatenate([head._windows[:count], self._spans(count)])

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Hashes of text[start:end] to all bases; equal spans have equal ones anywhere."""
        return tuple(
            (int(s[end]) - int(s[start])) * int(p(start + 1, 1)[start]) % PRIME for s, p in zip(self.sums, _POWERS, strict=True)
        )

    def same(self, start: int, other: Prefixes, at: int, size: int) -> bool:
        """Whether ``size`` code points from ``start`` equal those of ``other`` from ``at``."""
        if start + size > self.n or at + size > other.n:
            return False
        return self.span(start, start + size) == other.span(at, at + size)

    def extension(self, start: int, other: Prefixes, at: int) -> int:
        """The longest size for which ``same`` holds, by binary search."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(start, other, at, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def _spans(self, first: int = 0) -> np.ndarray:
        """Mixed hashes of the windows from ``first`` on."""
        size = min(WINDOW, self.n)
        sums, down = self.sums[0], _POWERS[0](self.n + 1, 1)
        count = self.n - size + 1
        gap = sums[first + size :] + _P - sums[first:count]
        spans = _mod(_mod(gap) * down[first:count])
        return common.mix(spans * common.BASE + np.uint64(size)) >> np.uint64(32)

    def windows(self) -> np.ndarray:
        if self._windows is None:
            self._windows = self._spans()
        return self._windows

    def least(self) -> np.ndarray:
        """The ``KEEP`` smallest distinct window hashes, or all."""
        if not self.n:
            return np.zeros(0, np.uint64)
        all_ = self.windows()
        share = 4 * KEEP / len(all_)
        while share < 1:
            some = np.unique(all_[all_ < np.uint64(share * 2**32)])
            if len(some) >= KEEP:
                return some[:KEEP]
            share *= 4
        return np.unique(all_)[:KEEP]

    def fingerprint(self) -> str:
        whole = "".join(f"{x:08x}" for x in self.span(0, self.n))
        return f"{self.n:x}:{whole}:{self.least().astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Estimated share of windows that both texts have, of those that either has."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition(":")[2]), ">u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)
    if len(x) == KEEP or len(y) == KEEP:
        union = union[:KEEP]
    both = np.intersect1d(x, y, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def in_order(documents: DataFrame) -> tuple[DataFrame, int]:
    """Rows (part, guest, doc_id, text) so that each row's successor is in its partition.

    Partitions are ranges of doc_id; the first row of each is also a guest at the end of
    the one before. The driver sees one doc_id for each partition.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    parts = common.partitions(spark)
    known = F.coalesce("doc_id", F.lit(_LOW))
    ids = rows.select(known.alias("k")).repartitionByRange(parts, "k")
    firsts = np.array(
        sorted(r["k"] for r in ids.groupBy(F.spark_partition_id()).agg(F.min("k").alias("k")).collect()), np.int64
    )

    def place(batch):
        key = batch.column("doc_id").fill_null(_LOW).to_numpy(zero_copy_only=False)
        part = np.searchsorted(firsts, key, side="right") - 1
        head = np.flatnonzero(firsts[part] == key)
        order = np.concatenate([np.arange(len(key)), head])
        yield {
            "part": np.concatenate([part, (part[head] - 1) % len(firsts)]).astype(np.int32),
            "guest": np.concatenate([np.zeros(len(key), bool), np.ones(len(head), bool)]),
            "doc_id": batch.column("doc_id").take(pa.array(order)),
            "text": batch.column("text").take(pa.array(order)),
        }

    placed = common.map_arrow(rows, place, "part int, guest boolean, doc_id long, text string")
    count = max(1, len(firsts))
    return placed.repartitionById(count, "part").sortWithinPartitions("guest", "doc_id", F.xxhash64("text")), count


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, head_edited, head_next).

    The edited text has its last quarter replaced by the beginning of the next row's text.
    ``head_edited`` and ``head_next``: the longest common beginning of the text with the
    edited and the next one, by binary search over span hashes.
    """
    ordered, _ = in_order(documents)

    def run(batches):
        out: list[tuple] = []
        held = None  # (doc_id, text, prefixes, fingerprint)

        def finish(text: str, own: Prefixes, print_: str):
            doc, last, prefixes, fingerprint = held
            cut = len(last) - len(last) // 4
            edited = last[:cut] + text[: len(last) // 4]
            changed = Prefixes(edited, prefixes, cut)
            edited_print = changed.fingerprint()
            out.append(
                (
                    doc,
                    len(last),
                    hashlib.sha256(edited.encode()).hexdigest(),
                    fingerprint,
                    edited_print,
                    likeness(fingerprint, edited_print),
                    likeness(fingerprint, print_),
                    prefixes.extension(0, changed, 0),
                    prefixes.extension(0, own, 0),
                )
            )

        def flush():
            columns = list(zip(*out, strict=True))
            out.clear()
            names = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next head_edited head_next".split()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        done = False
        for batch in common.released(batches):
            for doc, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest")), strict=True):
                if done or (guest and held is None):
                    continue
                text = text or ""
                own = Prefixes(text)
                print_ = own.fingerprint()
                if held is not None:
                    finish(text, own, print_)
                held, done = (doc, text, own, print_), guest
                if len(out) >= common.BATCH_ROWS:
                    yield flush()
        if out:
            yield flush()

    return ordered.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, head_edited long, head_next long",
    )
