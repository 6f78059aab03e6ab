"""Token id shards with a minimal perfect hash index.

A shard is two files. ``<name>.ids`` holds the ids of its rows one after another, in 2
or 4 bytes each, little-endian. ``<name>.idx`` begins with the length of a JSON header (8
bytes, little-endian) and the header, which names the sections after it and where they lie:

- ``bits``: bit levels of a minimal perfect hash over the distinct keys, in blocks of 512,
  and ``ranks``: the set bits before each block;
- by the hash's values ``prints`` (32-bit fingerprints of the keys), ``first`` and
  ``counts`` (the key's first row and its count of rows);
- ``ends``: by row, the ids up to its end;
- ``keys`` and ``valid``: by row, the key and whether there is one. A lookup doesn't read
  these; they tell a reader of the whole shard what to look up.

``Shard.get`` reads the header once and then a few bytes of a few sections for each key,
however many keys there are. A key that isn't there is told by its fingerprint but for one
in 2**32.

Rows are range partitioned by doc_id and sorted, so shards follow each other in doc_id
order; a shard ends at a bound of ids. Writers give files names of their own for each
attempt, and only names in the written manifest count, so a lost or repeated task leaves
no wrong row.

Defined results: a null text is empty and so one end id. Rows with a null doc_id come
first and have no key. Rows that share a doc_id stand together, by a hash of their text. A
very long text is encoded alone. An empty table gives an empty manifest. Extra columns are
ignored.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinefield.llm import common

#: Slots of a level for each key that it still has to place.
LOAD = 2.0


class MinimalHash:
    """A minimal perfect hash: distinct 64-bit keys to 0..n-1.

    On each level every key left has a slot; slots that one key alone wants are set, and
    the other keys go on to the next, smaller level. A key's value is the rank of its slot.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in levels])]).astype(np.int64)
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        self.ranks = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = common.mix(keys ^ np.uint64((level + 1) * int(common.BASE) % (1 << 64)))
        return ((mixed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalHash:
        levels, left = [], keys
        while len(left):
            size = int(LOAD * len(left)) + 1
            slot = cls.slots(left, len(levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[slot]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1 or any value for keys that weren't built in."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            slot = self.slots(keys[left], level, len(bits))
            hit = bits[slot]
            out[left[hit]] = self.ranks[self.starts[level] + slot[hit]]
            left = left[~hit]
        return out


def _hashed(keys: np.ndarray) -> np.ndarray:
    return common.mix(keys.astype(np.int64).view(np.uint64) + common.BASE)


def _fingerprints(hashed: np.ndarray) -> np.ndarray:
    return (common.mix(hashed + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)


def file_system(path: str):
    """The file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


#: Bits of a block of the hash's levels.
BLOCK = 512


class Shard:
    """A written shard, opened for reading."""

    def __init__(self, path: str):
        store, at = file_system(path)
        self.index = store.open_input_file(at + ".idx")
        size = int.from_bytes(self._bytes(self.index, 0, 8), "little")
        self.head = json.loads(self._bytes(self.index, 8, size))
        self.base, self.width, self.rows = 8 + size, self.head["width"], self.head["rows"]
        self.starts = np.concatenate([[0], np.cumsum(self.head["levels"])]).astype(np.int64)
        self.file = store.open_input_file(at + ".ids")

    @staticmethod
    def _bytes(file, at: int, size: int) -> bytes:
        file.seek(at)
        return file.read(size)

    def part(self, name: str, at: int = 0, count: int | None = None) -> np.ndarray:
        """Items of a section, all from ``at`` on or ``count`` of them."""
        kind, offset, n = self.head["sections"][name]
        kind = np.dtype(kind)
        count = n - at if count is None else count
        return np.frombuffer(self._bytes(self.index, self.base + offset + at * kind.itemsize, count * kind.itemsize), kind)

    def get(self, key: int) -> tuple[int, int]:
        """The first row and the count of rows of a key, by a few short reads; or -1 and 0."""
        hashed = _hashed(np.array([key]))
        for level, size in enumerate(self.head["levels"]):
            bit = int(self.starts[level] + MinimalHash.slots(hashed, level, size)[0])
            block = np.unpackbits(self.part("bits", bit // BLOCK * (BLOCK // 8), BLOCK // 8))
            if block[bit % BLOCK]:
                value = int(self.part("ranks", bit // BLOCK, 1)[0]) + int(block[: bit % BLOCK].sum())
                if self.part("prints", value, 1)[0] != _fingerprints(hashed)[0]:
                    return -1, 0
                return int(self.part("first", value, 1)[0]), int(self.part("counts", value, 1)[0])
        return -1, 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``get`` for many keys at once, from the whole index."""
        bits = np.unpackbits(self.part("bits")).astype(bool)
        made = MinimalHash([bits[a:b] for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)])
        hashed = _hashed(keys)
        value = made.find(hashed)
        known = value >= 0
        known[known] = self.part("prints")[value[known]] == _fingerprints(hashed[known])
        row, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        row[known], count[known] = self.part("first")[value[known]], self.part("counts")[value[known]]
        return row, count

    def ids(self, row: int) -> np.ndarray:
        ends = self.part("ends", max(row - 1, 0), 1 + (row > 0)).tolist()
        return self.between(ends[0] if row else 0, ends[-1])

    def between(self, a: int, b: int) -> np.ndarray:
        raw = self._bytes(self.file, a * self.width, (b - a) * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")


class _Writer:
    def __init__(self, folder: str, width: int):
        self.name = f"{folder}/{uuid.uuid4().hex}"
        self.store, self.at = file_system(self.name)
        if hasattr(self.store, "create_dir"):
            self.store.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.file = self.store.open_output_stream(self.at + ".ids")
        self.width, self.ids = width, 0
        self.keys: list = []
        self.ends: list[np.ndarray] = []

    def add(self, keys: list, flat: np.ndarray, ends: np.ndarray) -> None:
        self.file.write(flat.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.keys += keys
        self.ends.append(ends + self.ids)
        self.ids += len(flat)

    def close(self) -> tuple:
        self.file.close()
        valid = np.array([k is not None for k in self.keys], bool)
        keys = np.array([k or 0 for k in self.keys], np.int64)
        there = np.flatnonzero(valid)
        distinct, first, counts = np.unique(keys[there], return_index=True, return_counts=True)
        hashed = _hashed(distinct)
        made = MinimalHash.build(hashed)
        value = made.find(hashed)
        prints, rows, many = np.zeros(len(value), "<u4"), np.zeros(len(value), "<i8"), np.zeros(len(value), "<i8")
        prints[value], rows[value], many[value] = _fingerprints(hashed), there[first], counts
        bits = np.concatenate(made.levels) if made.levels else np.zeros(0, bool)
        bits = np.concatenate([bits, np.zeros(-len(bits) % BLOCK, bool)])
        ranks = np.cumsum(np.concatenate([[0], bits.reshape(-1, BLOCK).sum(axis=1)]))[:-1]
        sections, offset, blob = {}, 0, []
        for name, part in {
            "bits": np.packbits(bits), "ranks": ranks.astype("<i8"), "prints": prints, "first": rows, "counts": many,
            "ends": np.concatenate(self.ends).astype("<i8"), "keys": keys.astype("<i8"), "valid": valid.astype("u1"),
        }.items():
            sections[name] = [part.dtype.str, offset, len(part)]
            blob.append(part.tobytes())
            offset += len(blob[-1])
        head = {"width": self.width, "rows": len(keys), "levels": [len(x) for x in made.levels], "sections": sections}
        data = json.dumps(head).encode()
        with self.store.open_output_stream(self.at + ".idx") as f:
            f.write(len(data).to_bytes(8, "little") + data)
            for part in blob:
                f.write(part)
        known = keys[there]
        return self.name, len(keys), self.ids, *((int(known.min()), int(known.max())) if len(known) else (None, None))


def write_shards(
    documents: DataFrame, folder: str, vocabulary: str, end_id: int = 2, shard_ids: int = 1 << 23
) -> DataFrame:
    """Write all documents; the manifest (part, shard, path, rows, ids, low, high), lazily.

    Materialise the manifest before use: only the files that it names count.
    ``shard_ids``: a shard ends when it has so many. ``low`` and ``high``: its keys' bounds.
    """
    spark = documents.sparkSession

    def run(batches):
        from pyspark import TaskContext

        from kinefield.llm.tokens import encoder

        part, number, writer = TaskContext.get().partitionId(), 0, None
        for batch in common.released(batches):
            for k in range(0, batch.num_rows, common.BATCH_ROWS):
                rows = batch.slice(k, common.BATCH_ROWS)
                coder = encoder(vocabulary)
                flat, ends = coder.encode([t or "" for t in rows.column("text").to_pylist()])
                # The end id goes after each document's ids.
                flat, ends = np.insert(flat, ends[1:], end_id), ends[1:] + np.arange(1, len(ends))
                if writer is None:
                    size = max(coder.tokenizer.get_vocab_size(), end_id + 1)
                    writer = _Writer(folder, 2 if size <= 1 << 16 else 4)
                writer.add(rows.column("doc_id").to_pylist(), flat, ends)
                if writer.ids >= shard_ids:
                    yield _manifest(part, number, writer)
                    number, writer = number + 1, None
        if writer is not None:
            yield _manifest(part, number, writer)

    ordered = (
        documents.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(common.partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    manifest = ordered.mapInArrow(run, "part int, shard int, path string, rows long, ids long, low long, high long")
    # A row for each shard: gathered, so that the manifest is a few files.
    return manifest.repartition(1 + common.partitions(spark) // 64)


def _manifest(part: int, number: int, writer: _Writer) -> pa.RecordBatch:
    path, *rest = writer.close()
    names = ["part", "shard", "path", "rows", "ids", "low", "high"]
    values = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([path])]
    return pa.RecordBatch.from_arrays([*values, *(pa.array([x], pa.int64()) for x in rest)], names=names)


def read_shards(manifest: DataFrame, task_ids: int = 1 << 23) -> DataFrame:
    """(doc_id, start, ids) of all rows, each read where its key's index entry says.

    ``start``: the ids of all documents before it. The driver gets a sum for each partition
    that wrote, not a row for each shard. ``task_ids``: ids that a task reads, about.
    """
    spark = manifest.sparkSession
    listed, before = [], 0
    for r in sorted(manifest.groupBy("part").agg(F.sum("ids").alias("ids")).collect()):
        listed.append((r["part"], before))
        before += r["ids"]

    def run(batches):
        for batch in common.released(batches):
            for path, base in zip(*(batch.column(c).to_pylist() for c in ("path", "base")), strict=True):
                shard = Shard(path)
                valid, keys = shard.part("valid").astype(bool), shard.part("keys")
                ends = np.concatenate([[0], shard.part("ends")])
                row, count = shard.find(keys[valid])
                # Rows of one key stand together: the i-th takes the i-th of its entry.
                turn = np.arange(len(row)) - np.searchsorted(keys[valid], keys[valid])
                if (turn >= count).any():
                    raise ValueError(f"{path}: the index doesn't agree with its keys")
                # Rows without a key come first.
                rows = np.concatenate([np.flatnonzero(~valid), row + turn])
                known = np.concatenate([np.full(int((~valid).sum()), -1), np.flatnonzero(valid)])
                for a in range(0, len(rows), common.BATCH_ROWS):
                    some, of = rows[a : a + common.BATCH_ROWS], known[a : a + common.BATCH_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[of], mask=of < 0),
                            pa.array(base + ends[some]),
                            pa.array([shard.between(*ends[r : r + 2].tolist()).tobytes() for r in some], pa.binary()),
                        ],
                        names=["doc_id", "start", "ids"],
                    )

    schema = "doc_id long, start long, ids binary"
    if not listed:
        return spark.createDataFrame([], schema)
    bases = F.broadcast(spark.createDataFrame(listed, "part int, before long"))
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("before") + F.coalesce(F.sum("ids").over(earlier), F.lit(0))
    shards = manifest.join(bases, "part").select("path", base.alias("base"))
    return shards.repartition(max(1, min(before // task_ids + 1, 10_000))).mapInArrow(run, schema)


def lookup(manifest: DataFrame, keys: list[int]) -> DataFrame:
    """(doc_id, ids) of the rows of some keys; only shards whose bounds hold one are opened.

    The driver gets the key bounds of each partition that wrote.
    """
    spark = manifest.sparkSession
    bounds = manifest.groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low is not null").collect()
    wanted = [(r["part"], k) for r in bounds for k in sorted(set(keys)) if r["low"] <= k <= r["high"]]

    def run(batches):
        for batch in common.released(batches):
            for path, key in zip(*(batch.column(c).to_pylist() for c in ("path", "key")), strict=True):
                shard = Shard(path)
                row, count = shard.get(key)
                found = [shard.ids(k).tobytes() for k in range(row, row + count)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * count, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    asked = spark.createDataFrame(wanted, "part int, key long")
    return manifest.join(asked, "part").filter("key between low and high").select("path", "key").mapInArrow(run, "doc_id long, ids binary")
