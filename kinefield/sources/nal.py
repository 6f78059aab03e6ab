"""Byte streams to NAL units, and bits to numbers, over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def rbsp_bytes(data: bytes) -> bytes:
    """Payload without emulation bytes: a 3 after two zeros and before a byte up to 3."""
    out, begin, at = [], 0, data.find(b"\x00\x00\x03")
    while at >= 0:
        if at + 3 < len(data) and data[at + 3] <= 3:
            out.append(data[begin : at + 2])
            begin = at + 3
        at = data.find(b"\x00\x00\x03", at + 3)
    return b"".join([*out, data[begin:]]) if out else data


def split_annexb(data: bytes) -> Iterator[bytes]:
    """Units between three-byte start codes; zeros before the next code aren't theirs."""
    places = [m.start() for m in re.finditer(b"\x00\x00\x01", data)]
    for k, at in enumerate(places):
        last = k + 1 == len(places)
        unit = data[at + 3 :] if last else data[at + 3 : places[k + 1]].rstrip(b"\x00")
        if unit and not unit[0] & 0x80:
            yield unit


def split_lengths(data: bytes, size: int) -> Iterator[bytes]:
    """Units after big-endian lengths of ``size`` bytes, up to a zero or overrunning one."""
    at = 0
    while at + size <= len(data):
        n = int.from_bytes(data[at : at + size], "big")
        at += size
        if n == 0 or at + n > len(data):
            return
        if not data[at] & 0x80:
            yield data[at : at + n]
        at += n


class BitReader:
    """Bits from the highest of each byte; zeros beyond the end.

    Each read looks at the few bytes that it needs, so a payload takes linear time.
    """

    def __init__(self, data: bytes):
        self.data, self.size, self.pos = data, 8 * len(data), 0
        ended = data.rstrip(b"\x00")
        self.stop = 8 * len(ended) - (ended[-1] & -ended[-1]).bit_length() if ended else 0

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.pos += n
        return value

    def peek(self, n: int) -> int:
        first, end = self.pos >> 3, self.pos + n
        last = (end + 7) >> 3
        held = int.from_bytes(self.data[first:last], "big") << 8 * max(0, last - max(first, len(self.data)))
        return (held >> (8 * last - end)) & ((1 << n) - 1)

    def ue(self) -> int:
        zeros = 32 - self.peek(32).bit_length()
        if zeros > 31 or self.pos + zeros >= self.size:
            self.pos = min(self.pos + zeros, self.size)
            return 0
        self.pos += zeros + 1
        return (1 << zeros) - 1 + (self.read(zeros) if zeros else 0)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)

    def more_data(self) -> bool:
        """Whether payload stands before the stop bit."""
        return self.pos < self.stop


@F.pandas_udf(T.BinaryType())
def rbsp(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else rbsp_bytes(bytes(b)))


def units(streams: DataFrame, column: str = "data", length_size: int = 0, codec: str = "h264") -> DataFrame:
    """(other columns, unit, nal_type, payload) of each unit of each stream.

    ``length_size``: bytes of the lengths before units; 0 for start codes.
    """
    head = 2 if codec == "hevc" else 1

    @F.pandas_udf("array<struct<unit:int,nal_type:int,payload:binary>>")
    def split(data: pd.Series) -> pd.Series:
        def one(raw):
            if raw is None:
                return []
            raw = bytes(raw)
            found = split_lengths(raw, length_size) if length_size else split_annexb(raw)
            found = [u for u in found if len(u) >= head]
            kind = (lambda u: u[0] >> 1 & 63) if head == 2 else (lambda u: u[0] & 31)
            return [{"unit": k, "nal_type": kind(u), "payload": rbsp_bytes(u[head:])} for k, u in enumerate(found)]

        return data.map(one)

    rest = [c for c in streams.columns if c != column]
    return streams.select(*rest, F.explode(split(F.col(column))).alias("_u")).select(*rest, "_u.*")


def _code_tables() -> tuple[list[bytes], np.ndarray]:
    """By state and byte: the state after it, and the bits of it at which codes begin.

    States 0 to 31 have read so many zeros of a code, 32 to 62 have 1 to 31 bits left to read.
    """
    state, byte, begins = np.repeat(np.arange(63), 256), np.tile(np.arange(256), 63), 0
    for k in range(7, -1, -1):
        begins = begins | (state == 0) << k
        prefix = np.where(byte >> k & 1, np.where(state == 0, 0, state + 31), (state + 1) % 32)
        state = np.where(state < 32, prefix, np.where(state == 32, 0, state - 1))
    return [row.tobytes() for row in state.astype(np.uint8).reshape(63, 256)], begins.astype(np.uint8)


_AFTER, _BEGINS = _code_tables()
# Its zeros are what is read beyond the end; its ones end any code, so that the next stream begins one.
_PAD = bytes(8) + b"\xff" * 4
_BLOCK, _PIECE = 1 << 15, 1 << 20


def decode_signed(streams: list[bytes | None]) -> pa.ListArray:
    """All signed Exp-Golomb values of each stream's payload, as BitReader reads them.

    A walk over bytes finds where codes begin, then all codes of a block are read at once;
    time and memory are linear in the bytes. Codes that begin at or after a stop bit are left out.
    """
    ended = [(raw or b"").rstrip(b"\x00") for raw in streams]
    sizes = np.array([len(raw) for raw in ended], np.int64)
    first = 8 * (np.cumsum(sizes + len(_PAD)) - sizes - len(_PAD))
    stop = first + 8 * sizes - [(raw[-1] & -raw[-1]).bit_length() if raw else 0 for raw in ended]
    edges = np.column_stack([first, stop]).ravel()
    data = b"".join(part for raw in ended for part in (raw, _PAD))
    windows = np.ndarray(len(data), ">u8", data + bytes(7), strides=(1,))
    inside, counts, values = np.arange(len(edges)) % 2 == 1, np.zeros(len(edges), np.int64), []
    state, last, after = 0, np.empty(0, np.int64), _AFTER
    for at in range(0, len(data), _BLOCK):
        block, entered = data[at : at + _BLOCK], state
        states = bytes([state := after[state][byte] for byte in block])
        before = np.frombuffer(bytes([entered]) + states[:-1], np.uint8).astype(np.uint16)
        begins = _BEGINS[before << 8 | np.frombuffer(block, np.uint8)]
        places = np.concatenate([last, np.flatnonzero(np.unpackbits(begins).view(bool)) + 8 * at])
        last = places[-1:]
        # A code of n bits has (n - 1) / 2 zeros, then its number plus 1; one of 32 bits is all zeros and 0.
        zeros, places = np.diff(places) - 1 >> 1, places[:-1]
        # Between edges, codes of a stream take turns with those in pads; after the last edge are pads.
        below = np.searchsorted(places, edges)
        taken = np.flatnonzero(np.repeat(inside, np.diff(below, prepend=0)))
        counts += below
        zeros = zeros[taken]
        places = places[taken] + zeros
        number = windows[places >> 3].astype(np.uint64) << (places & 7).astype(np.uint64) >> (63 - zeros).astype(np.uint64)
        sign = -(number & 1).astype(np.int32)
        values.append(((number >> 1).astype(np.int32) ^ sign) - sign)
    found = np.concatenate([*values, np.empty(0, np.int32)])
    offsets = np.concatenate([[0], np.cumsum(counts[1::2] - counts[::2])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))


def signed_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Signed codes of the streams, in their order, in arrays for about 1 MB of streams or one."""
    for batch in batches:
        streams, size = [], 0
        for raw in batch:
            streams.append(raw.as_py())
            size += len(streams[-1] or b"")
            if size >= _PIECE:
                yield decode_signed(streams)
                streams, size = [], 0
        if streams:
            yield decode_signed(streams)


def signed_codes(bits: Column) -> Column:
    """All signed Exp-Golomb values of a stream's payload; none for a null."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return signed_batches(batches)

    return run(bits)
