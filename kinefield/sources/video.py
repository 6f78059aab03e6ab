"""Video files to NAL units: MP4 containers and raw streams with start codes.

A file is one row of Spark's binary source, so it must fit in an executor's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from kinefield.sources.nal import rbsp_bytes, split_annexb, split_lengths
from kinefield.sources.syntax import h264_record, hevc_record

#: Sample entries with HEVC pictures, and names of raw HEVC files.
HEVC_ENTRIES = (b"hvc1", b"hev1")
HEVC_ENDINGS = (".265", ".h265", ".hevc")
UNITS = "path string, codec string, packet int, nal_no int, nal_type int, ref_idc int, temporal_id int, payload binary"
#: Rows of a file that are sent on at once.
_CHUNK = 256


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the content of each box; a cut box ends the walk."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def _inside(data: bytes, span: tuple[int, int], *path: bytes) -> tuple[int, int] | None:
    """The first box at a path of types."""
    for name in path:
        span = next(((a, b) for kind, a, b in boxes(data, *span) if kind == name), None)
        if span is None:
            return None
    return span


def _numbers(data: bytes, at: int, count: int, size: int = 4) -> list[int]:
    return [int.from_bytes(data[k : k + size], "big") for k in range(at, at + count * size, size)]


def _count(data: bytes, at: int, end: int, size: int) -> int:
    """The count at a place, but no more than the box has room for."""
    return min(int.from_bytes(data[at : at + 4], "big"), (end - at - 4) // size)


def video_track(data: bytes) -> tuple[str, bytes, list[tuple[int, int]]] | None:
    """Codec, configuration record and (start, size) of samples of the first video track."""
    movie = _inside(data, (0, len(data)), b"moov")
    for kind, *track in boxes(data, *movie) if movie else ():
        handler = _inside(data, track, b"mdia", b"hdlr") if kind == b"trak" else None
        if handler is None or data[handler[0] + 8 : handler[0] + 12] != b"vide":
            continue
        table = _inside(data, track, b"mdia", b"minf", b"stbl")
        found = {k: (a, b) for k, a, b in boxes(data, *table)} if table else {}
        entry = next(boxes(data, found[b"stsd"][0] + 8, found[b"stsd"][1]), None) if b"stsd" in found else None
        if entry is None:
            return None
        # A visual sample entry has 78 bytes of its own before further boxes.
        own = {k: data[a:b] for k, a, b in boxes(data, entry[1] + 78, entry[2])}
        codec = "hevc" if entry[0] in HEVC_ENTRIES else "h264"
        return codec, own.get(b"hvcC" if codec == "hevc" else b"avcC", b""), _samples(data, found)
    return None


def _samples(data: bytes, found: dict) -> list[tuple[int, int]]:
    """Places of samples: sizes dealt over chunks, as many a chunk as the runs say."""
    if b"stsz" not in found or b"stsc" not in found or not (found.keys() & {b"stco", b"co64"}):
        return []
    at, end = found[b"stsz"]
    same, count = _numbers(data, at + 4, 2)
    sizes = [same] * min(count, len(data)) if same else _numbers(data, at + 12, _count(data, at + 8, end, 4))
    width = 4 if b"stco" in found else 8
    at, end = found.get(b"stco") or found[b"co64"]
    chunks = _numbers(data, at + 8, _count(data, at + 4, end, width), width)
    at, end = found[b"stsc"]
    flat = _numbers(data, at + 8, 3 * _count(data, at + 4, end, 12))
    runs = list(zip(flat[::3], flat[1::3]))
    out, run = [], -1
    for number, place in enumerate(chunks, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= number:
            run += 1
        for size in sizes[len(out) : len(out) + (runs[run][1] if run >= 0 else 0)]:
            out.append((place, size))
            place += size
    return [(a, n) for a, n in out if a + n <= len(data)]


def packets(path: str, data: bytes) -> Iterator[tuple[str, int, list[bytes]]]:
    """(codec, packet, units) in file order; packet -1 has a container's parameter sets.

    Raises ValueError for a file that is neither a stream with start codes nor a container
    with a video track.
    """
    if data[:3] == b"\0\0\1" or data[:4] == b"\0\0\0\1":
        yield "hevc" if path.lower().endswith(HEVC_ENDINGS) else "h264", 0, list(split_annexb(data))
        return
    track = video_track(data)
    if track is None:
        raise ValueError(f"{path}: no video track")
    codec, extra, samples = track
    record = (hevc_record if codec == "hevc" else h264_record)(extra)
    if record:
        yield codec, -1, record["units"]
    for k, (at, size) in enumerate(samples):
        sample = data[at : at + size]
        yield codec, k, list(split_lengths(sample, record["length_size"]) if record else split_annexb(sample))


def units(files: DataFrame, strict: bool = True) -> DataFrame:
    """Units of (path, content) rows, numbered in file order.

    ``ref_idc`` is null in HEVC, ``temporal_id`` in H.264.

    Null contents give no row. Other files without video raise if ``strict``, else give none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in UNITS.split(", ")]
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"]):
                rows, number = [], 0
                try:
                    for codec, packet, found in packets(path, bytes(data)) if data is not None else ():
                        head = 2 if codec == "hevc" else 1
                        for u in found:
                            if len(u) < head or u[0] & 0x80:
                                continue
                            kind, ref, layer = (u[0] >> 1 & 63, None, (u[1] & 7) - 1) if head == 2 else (u[0] & 31, u[0] >> 5 & 3, None)
                            rows.append((path, codec, packet, number, kind, ref, layer, rbsp_bytes(u[head:])))
                            number += 1
                        if len(rows) >= _CHUNK:
                            yield pd.DataFrame(rows, columns=names).astype({"ref_idc": "Int32", "temporal_id": "Int32"})
                            rows = []
                except ValueError:
                    if strict:
                        raise
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"ref_idc": "Int32", "temporal_id": "Int32"})

    return files.select("path", "content").mapInPandas(run, UNITS)


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return units(spark.read.format("binaryFile").load(path), strict)
