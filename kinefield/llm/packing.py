"""Sum-of-squares online packing of documents into token windows.

A document's ids, with an end id, first fill whole windows; the rest of it is one item.
Each item goes to the open fill level (or a new window) that minimises the sum of the
squared counts of partially filled windows over all levels, from a level array.

Where ``open_ids`` ids are held in open windows, and at the end of a partition, these are
settled: the fullest windows stay as they were packed and their gaps are filled with cuts
from the emptiest, until one window is open. That one stays open, and at the end is cut
into windows of powers of two, so nothing is padded.

Each input partition is packed alone, in its row order: there is no shuffle, and a task
that runs again gives the same sequences. Sequence ids begin with the partition's number.

Defined results: a null text is empty and so one end id. Null and repeated doc_ids are
packed as rows of their own. A very long text is encoded alone. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinefield.llm import common

_SEQUENCE_BITS = 40


class SumOfSquares:
    """Open windows by fill level. Pieces: (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # of open windows; 0 and window stay 0
        self.open: list[list[list]] = [[] for _ in range(window)]

    @property
    def held(self) -> int:
        """Ids in open windows."""
        return int(self.counts @ np.arange(self.window + 1))

    def level(self, size: int) -> int:
        """The fill level to add to; 0 is a new window."""
        top = self.window - size
        here, there = self.counts[1 : top + 1], self.counts[1 + size : self.window + 1]
        # Change of the sum of squares: (there+1)^2 - there^2 + (here-1)^2 - here^2, and
        # no new count at all where the window is full.
        change = 2 * (there - here) + 2
        if top:
            change[-1] = 1 - 2 * here[-1]
            change[here == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if change[best] < 2 * self.counts[size] + 1:
                return best + 1
        return 0

    def put(self, piece: tuple) -> list | None:
        """Add a piece shorter than the window; the pieces of the window that it fills."""
        size = len(piece[2]) >> 2
        at = self.level(size)
        if at:
            held = self.open[at].pop()
            self.counts[at] -= 1
        else:
            held = []
        held.append(piece)
        if at + size == self.window:
            return held
        self.open[at + size].append(held)
        self.counts[at + size] += 1
        return None

    def settle(self):
        """Fill the fullest windows from the emptiest; one window at most stays open."""
        held = [w for level in self.open for w in level]  # by fill, emptiest first
        fills = [n for n, level in enumerate(self.open) for _ in level]
        self.counts[:] = 0
        self.open = [[] for _ in range(self.window)]
        low, high = 0, len(held) - 1
        while low < high:
            gap = self.window - fills[high]
            while gap and low < high:
                doc, start, ids, whole = held[low].pop()
                size = len(ids) >> 2
                take = min(gap, size)
                if take < size:  # the end of the piece goes; its beginning stays
                    held[low].append((doc, start, ids[: 4 * (size - take)], whole))
                held[high].append((doc, start + size - take, ids[4 * (size - take) :], whole))
                fills[low] -= take
                gap -= take
                low += not fills[low]
            if gap:
                fills[high] = self.window - gap
                break
            yield held[high]
            high -= 1
        if low == high and fills[low]:
            self.open[fills[low]].append(held[low])
            self.counts[fills[low]] = 1

    def rest(self):
        """Settle, and cut the window that stays open into powers of two."""
        yield from self.settle()
        for fill, level in enumerate(self.open):
            for pieces in level:
                held, left = [], fill
                room = 1 << (left.bit_length() - 1)
                for doc, start, ids, whole in pieces:
                    at = 0
                    while at < len(ids):
                        take = min(4 * room, len(ids) - at)
                        held.append((doc, start + (at >> 2), ids[at : at + take], whole))
                        at += take
                        room -= take >> 2
                        left -= take >> 2
                        if room == 0:
                            yield held
                            held, room = [], 1 << (left.bit_length() - 1) if left else 0


def pack(documents: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, open_ids: int = 1 << 22) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), one row for each piece.

    ``ids``: little-endian unsigned 32-bit numbers. ``window``: at least 2. ``open_ids``:
    open windows that hold more are settled, so a task's memory is bounded.
    """

    def run(batches):
        from kinefield.llm.tokens import encoder

        import pyarrow as pa

        out: list[tuple] = []
        state = {"next": TaskContext.get().partitionId() << _SEQUENCE_BITS}
        packer = SumOfSquares(window)
        end = np.array([end_id], "<u4").tobytes()

        def close(held):
            at = 0
            for doc, start, ids, whole in held:
                out.append((doc, start, len(ids) >> 2, ids, whole, state["next"], at))
                at += len(ids) >> 2
            state["next"] += 1

        def flush():
            if out:
                columns = list(zip(*out, strict=True))
                out.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(columns)],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

        for batch in common.released(batches):
            for k in range(0, batch.num_rows, common.BATCH_ROWS):
                part = batch.slice(k, common.BATCH_ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                flat, ends = encoder(vocabulary).encode(texts)
                raw = memoryview(flat.astype("<u4").tobytes())
                for doc, a, b in zip(part.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    ids = bytes(raw[4 * a : 4 * b]) + end
                    whole, at = b - a + 1, 0
                    while whole - at >= window:
                        close([(doc, at, ids[4 * at : 4 * (at + window)], whole)])
                        at += window
                    if at < whole:
                        full = packer.put((doc, at, ids[4 * at :], whole))
                        if full:
                            close(full)
                if packer.held > open_ids:
                    for held in packer.settle():
                        close(held)
                yield from flush()
        for held in packer.rest():
            close(held)
            if len(out) >= common.BATCH_ROWS:
                yield from flush()
        yield from flush()

    common.small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
