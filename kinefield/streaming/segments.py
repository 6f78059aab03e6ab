"""Video that arrives in segments: files of a stream, each with some of a video's packets.

A segment is a file ``<video>/<number>.<ending>``. A video's segments may arrive in any
order; they are taken by number, from 0, and later ones wait for those before them. State
by video: parameter sets, the count of pictures, the anchor of display order and the last
reference pictures. So what a query holds for a video is bounded but for segments that
wait, and more than ``waiting`` of these are an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefield.plans.pictures import h264_motion_of, vectors_of
from kinefield.sources import syntax, video
from kinefield.sources.nal import BitReader

#: Reference pictures that are held.
HELD = 16
SLICES = (
    "video string, segment int, nal_no int, nal_type int, ref_idc int, frame int, poc int, "
    "held array<struct<frame:int,poc:int>>, payload binary, sps_raw binary, pps_raw binary"
)
_COLUMNS = [c.split()[0] for c in SLICES.replace("struct<frame:int,poc:int>", "x").split(", ")]


class Sequence:
    """What is known of a video so far. ``sps``, ``pps``: raw payloads by id."""

    def __init__(self, text: str | None = None):
        self.next, self.frame, self.anchor = 0, -1, (0, 0)
        self.poc: int | None = None
        self.held: list[list[int]] = []
        self.last: list | None = None  # frame and count of a reference picture still open
        self.sps: dict[int, bytes] = {}
        self.pps: dict[int, bytes] = {}
        self.waiting: dict[int, list[tuple]] = {}
        if text:
            self._load(json.loads(text))

    def _load(self, d: dict) -> None:
        self.next, self.frame, self.poc, self.held, self.last = (d[k] for k in ("next", "frame", "poc", "held", "last"))
        self.anchor = tuple(d["anchor"])
        self.sps, self.pps = ({int(k): bytes.fromhex(v) for k, v in d[n].items()} for n in ("sps", "pps"))
        self.waiting = {int(k): [(*u[:-1], bytes.fromhex(u[-1])) for u in v] for k, v in d["waiting"].items()}

    def dump(self) -> str:
        plain = {k: getattr(self, k) for k in ("next", "frame", "poc", "held", "last", "anchor")}
        sets = {n: {k: v.hex() for k, v in getattr(self, n).items()} for n in ("sps", "pps")}
        return json.dumps({**plain, **sets, "waiting": {k: [(*u[:-1], u[-1].hex()) for u in v] for k, v in self.waiting.items()}})

    def unit(self, kind: int, ref: int, payload: bytes) -> tuple | None:
        """(frame, poc, held, sps, pps) of a slice that has its sets, else None."""
        if kind == 7:
            self.sps[syntax.read(syntax.H264_SPS, BitReader(payload))["sps_id"]] = payload
        elif kind == 8:
            self.pps[syntax.read(syntax.H264_PPS, BitReader(payload))["pps_id"]] = payload
        elif kind in (1, 5):
            start = syntax.read(syntax.H264_START, BitReader(payload))
            raw = self.pps.get(start["pps_id"])
            pps = syntax.read(syntax.H264_PPS, BitReader(raw)) if raw is not None else {}
            own = self.sps.get(pps.get("sps_id", -1))
            if own is None:
                return None
            if start["first_mb"] == 0:
                sps = syntax.read(syntax.H264_SPS, BitReader(own))
                head = syntax.read(syntax.H264_SLICE, BitReader(payload), sps | pps | {"is_idr": kind == 5, "ref_idc": ref})
                self._picture(sps, head["poc_lsb"], kind == 5, ref > 0)
            if self.frame >= 0:
                return self.frame, self.poc, list(self.held), own, raw
        return None

    def _picture(self, sps: dict, lsb: int, idr: bool, is_ref: bool) -> None:
        if self.last is not None:
            self.held = [*self.held, self.last][-HELD:]
        self.frame += 1
        high, low = (0, 0) if idr else self.anchor
        span = 1 << max(sps["log2_max_poc_lsb"], 4)
        if not idr and low - lsb >= span // 2:
            high += span
        elif not idr and lsb - low > span // 2:
            high -= span
        if is_ref:
            self.anchor = (high, lsb)
        self.poc = high + lsb if sps["poc_type"] == 0 else None
        self.last = [self.frame, self.poc] if is_ref else None


def read(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The stream of files at ``path``, a folder with a folder for each video."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return source.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path)


def slices(files: DataFrame, waiting: int = 256) -> DataFrame:
    """Slices of H.264 segments (``SLICES``), each with its sets, picture and references.

    A slice without its sets and slices before the first picture are dropped; ``poc`` is
    null where display order isn't coded by low bits. Files without video and those whose
    name has no number raise.
    """
    units = video.units(files).select(
        F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("video"),
        F.regexp_extract("path", r"([0-9]+)\.[^./]*$", 1).cast("int").alias("segment"),
        *("nal_no", "nal_type", "ref_idc", "payload"),
    )

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = Sequence(state.get[0] if state.exists else None)
        for frame in frames:
            if frame["segment"].isna().any():
                raise ValueError(f"{key[0]}: a segment without a number")
            columns = (frame[c].tolist() for c in ("segment", "nal_no", "nal_type", "ref_idc", "payload"))
            for segment, no, kind, ref, payload in zip(*columns, strict=True):
                if int(segment) >= known.next:
                    known.waiting.setdefault(int(segment), []).append((int(no), int(kind), int(ref), bytes(payload)))
        out = []
        while known.next in known.waiting:
            for no, kind, ref, payload in sorted(known.waiting.pop(known.next)):
                found = known.unit(kind, ref, payload)
                if found:
                    place, poc, held, sps, pps = found
                    held = [{"frame": f, "poc": p} for f, p in held]
                    out.append((key[0], known.next, no, kind, ref, place, poc, held, payload, sps, pps))
            known.next += 1
        if len(known.waiting) > waiting:
            raise ValueError(f"{key[0]}: segment {known.next} is missing and {len(known.waiting)} wait for it")
        state.update((known.dump(),))
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"poc": "Int32"})

    return units.groupBy("video").applyInPandasWithState(run, SLICES, "known string", "append", "NoTimeout")


def vectors(found: DataFrame) -> DataFrame:
    """Vectors of P slices without CABAC of ``slices``, as ``plans.pictures.h264_vectors``."""
    sets = found.withColumns({"sps": syntax.h264_sps(F.col("sps_raw")), "pps": syntax.h264_pps(F.col("pps_raw"))})
    heads = sets.withColumn("head", syntax.h264_slice(*map(F.col, ("payload", "nal_type", "ref_idc", "sps", "pps"))))
    return vectors_of(h264_motion_of(heads.withColumn("seq", F.col("nal_no")), ("P",)))
