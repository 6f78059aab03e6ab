"""Removal of repeated passages by hashing units of text.

A text's units are its lines or paragraphs, or its lines and the sentences in them. A unit
is normalised to its words, A-Z in lower case, with one blank between, and digested to 128
bits. Units are grouped by digest over all documents; the earliest in rank (doc_id, then
hash of the text, then place in it) stays. Whole lines (or paragraphs) that an earlier one
equals go, however short. Later sentences also go where they form a passage: an unbroken
run of repeated units of one text that has ``min_words`` words at least. Short sentences
that recur within other lines are so left alone. What goes is told as spans of the
original text.

Units are made twice rather than written: once to count digests by hash aggregation over
fixed-width columns, once to meet the digests that several have. Only digests and places
are shuffled; texts stay where they are, unless more spans than a broadcast may hold are
found.

Defined results: a null text stays null, an empty one empty; both have no units. A row is
known by doc_id and a hash of its text, so rows that share a doc_id have spans of their
own. Repeated rows (equal doc_id and text) are one occurrence and all stay. Null doc_ids
rank first. A very long text is one numpy pass and its spans one array. An empty table
gives no rows. Extra columns stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinefield.llm import common

_STOPS = np.zeros(256, bool)
_STOPS[[33, 46, 63]] = True  # ! . ?
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin in the bytes of rows; a unit ends where the next one begins."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    if n > 1:
        line = data[:-1] == 10
        if unit == "paragraph":
            line[1:] &= data[:-2] == 10
            line[0] = False
        elif unit == "sentence":
            line |= _STOPS[data[:-1]] & _BLANK[data[1:]]
        first[1:n] |= line
    return np.flatnonzero(first[:n])


_NULL_RANK = -(1 << 63)
_TEXT_HASH = F.xxhash64


def _later(owner: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Whether an earlier unit of the same owner has the same digest."""
    key = common.mix(digest[:, 0] + owner.astype(np.uint64) * common.BASE)
    order = np.argsort(key, kind="stable")  # places stay in order
    one, two = order[:-1], order[1:]
    out = np.zeros(len(owner), bool)
    out[two] = (owner[one] == owner[two]) & (digest[one] == digest[two]).all(axis=1)
    return out


def units(documents: DataFrame, unit: str) -> DataFrame:
    """(doc_id, row, x, y, words, start, end, place, whole, again, again_line), one for each unit with words.

    ``row``: hash of the text. ``x`` and ``y``: the digest. ``start`` and ``end``: byte
    offsets in the text. ``place``: which of the text's units with words it is; null for a
    line of several sentences, which comes besides them. ``whole``: a line or paragraph; it
    ends with its line end. ``again``: an earlier unit of this text equals it;
    ``again_line``: an earlier whole one does.
    """
    import xxhash

    def run(batch):
        data, offsets = common.text_bytes(batch.column("text"))
        for a, b in common.chunks(offsets):
            base = offsets[a]
            part, bytes_ = offsets[a : b + 1] - base, data[base : offsets[b]]
            begin, end, _ = common.words(bytes_, part)
            if not len(begin):
                continue
            starts = unit_starts(bytes_, part, unit)
            stops = np.append(starts[1:], len(bytes_))
            low = np.searchsorted(begin, starts)
            high = np.append(low[1:], len(begin))
            some = high > low
            starts, stops, low, high = starts[some], stops[some], low[some], high[some]
            doc = np.searchsorted(part, starts, side="right") - 1
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            whole = np.ones(len(doc), bool)
            if unit == "sentence":
                lines = unit_starts(bytes_, part, "line")
                line = np.searchsorted(lines, starts, side="right") - 1
                _, head, count = np.unique(line, return_index=True, return_counts=True)
                whole = np.repeat(count == 1, count)
                ends = np.append(lines[1:], len(bytes_))
                stops = np.where(whole, ends[line], stops)
                # Lines of several sentences, after the sentences.
                head, tail = head[count > 1], (head + count - 1)[count > 1]
                starts, stops = np.append(starts, starts[head]), np.append(stops, ends[line[head]])
                low, high, doc = np.append(low, low[head]), np.append(high, high[tail]), np.append(doc, doc[head])
                place, whole = np.append(place, np.full(len(head), -1)), np.append(whole, np.ones(len(head), bool))
            digest = _digests(bytes_, begin, end, low, high, xxhash.xxh3_128_digest)
            order = np.argsort(starts, kind="stable")
            again, again_line = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
            again[order] = _later(doc[order], digest[order])
            if again.any():
                order = order[whole[order]]
                again_line[order] = _later(doc[order], digest[order])
            own = pa.array(doc)
            yield {
                "doc_id": batch.column("doc_id").slice(a, b - a).take(own),
                "row": batch.column("row").slice(a, b - a).take(own),
                "x": digest[:, 0].view(np.int64),
                "y": digest[:, 1].view(np.int64),
                "words": (high - low).astype(np.int32),
                "start": (starts - part[doc]).astype(np.int32),
                "end": (stops - part[doc]).astype(np.int32),
                "place": pa.array(place.astype(np.int32), mask=place < 0),
                "whole": whole,
                "again": again,
                "again_line": again_line,
            }

    return common.map_arrow(
        documents.select(F.col("doc_id").cast("long"), _TEXT_HASH("text").alias("row"), "text"),
        run,
        "doc_id long, row long, x long, y long, words int, start int, end int, place int, "
        "whole boolean, again boolean, again_line boolean",
    )


def _digests(data, begin, end, low, high, digest) -> np.ndarray:
    """Two 64-bit halves of the digest of words low..high-1 of each unit."""
    plain = common.lowered(data)
    keep = np.zeros(len(data) + 1, bool)
    np.logical_not(_BLANK[data], out=keep[:-1])
    after = end[~keep[end]]  # the first blank after each word parts it from the next one
    keep[after] = True
    plain = np.append(plain, np.uint8(32))
    plain[after] = 32
    at = np.concatenate([[0], np.cumsum(keep)])
    view = memoryview(plain[keep])
    got = [digest(view[i:j]) for i, j in zip(at[begin[low]].tolist(), at[end[high - 1]].tolist(), strict=True)]
    return np.frombuffer(b"".join(got), "<u8").reshape(-1, 2)


def _runs(found: list[dict], min_words: int) -> list[tuple[int, int]]:
    """Spans of the repeated units of one text: whole ones, and runs of enough words."""
    spans = [(u["start"], u["end"]) for u in found if u["gone"]]
    run: list[dict] = []

    def close():
        if sum(u["words"] for u in run) >= min_words:
            spans.append((run[0]["start"], run[-1]["end"]))

    for u in sorted((u for u in found if u["place"] is not None), key=lambda u: u["place"]):
        # Blanks and blank lines between two units that follow each other go with them.
        if run and u["place"] > run[-1]["place"] + 1:
            close()
            run = []
        if not run or u["place"] > run[-1]["place"]:
            run.append(u)
    if run:
        close()
    return sorted(spans)


def repeated_spans(documents: DataFrame, unit: str, min_words: int, scratch: common.Scratch) -> DataFrame:
    """(doc_id, row, spans of bytes) of rows from which passages go."""
    found = units(documents, unit)
    rank = F.coalesce("doc_id", F.lit(_NULL_RANK))
    groups = found.groupBy("x", "y").agg(
        F.count("*").alias("n"), F.min(rank).alias("low"), F.min(F.when(F.col("whole"), rank)).alias("line")
    )
    # Written apart, so that the join with it can split the rows of a common unit.
    groups = scratch.table(groups.filter("n > 1").drop("n"), "groups")
    met = found.join(groups, ["x", "y"])
    later = (rank > F.col("low")) | F.col("again")
    gone = (rank > F.col("line")) | F.col("again_line")
    # Texts that share a doc_id are told apart by their hash; few have to be.
    texts = documents.select(F.col("doc_id").cast("long"), _TEXT_HASH("text").alias("row")).filter(F.col("text").isNotNull())
    ties = texts.groupBy("doc_id").agg(F.min("row").alias("a"), F.max("row").alias("b")).filter("a < b")
    ties = scratch.table(ties.select(F.coalesce("doc_id", F.lit(_NULL_RANK)).alias("tie")).distinct(), "ties")
    if not ties.isEmpty():
        tied = met.join(ties, rank == F.col("tie"), "left_semi")
        first = tied.groupBy("x", "y").agg(
            F.min(F.when(rank == F.col("low"), F.col("row"))).alias("first"),
            F.min(F.when(F.col("whole") & (rank == F.col("line")), F.col("row"))).alias("first_line"),
        )
        met = met.join(scratch.table(first, "first"), ["x", "y"], "left")
        later |= (rank == F.col("low")) & F.coalesce(F.col("row") > F.col("first"), F.lit(False))
        gone |= (rank == F.col("line")) & F.coalesce(F.col("row") > F.col("first_line"), F.lit(False))
    gone = (F.col("whole") & F.coalesce(gone, F.lit(False))).alias("gone")
    met = met.filter(later & (gone | F.col("place").isNotNull())).select("doc_id", "row", "start", "end", "words", "place", gone)
    texts = (
        met.groupBy("doc_id", "row")
        .agg(
            F.collect_set(F.struct("start", "end", "words", "place", "gone")).alias("found"),
            F.max("gone").alias("any"),
            F.sum("words").alias("words"),
        )
        .filter(F.col("any") | (F.col("words") >= min_words))
        .select("doc_id", "row", "found")
    )

    def run(batch):
        spans = [_runs(f, min_words) for f in batch.column("found").to_pylist()]
        some = np.flatnonzero([bool(x) for x in spans])
        yield {
            "doc_id": batch.column("doc_id").take(pa.array(some)),
            "row": batch.column("row").take(pa.array(some)),
            "spans": [[{"start": a, "end": b} for a, b in spans[k]] for k in some.tolist()],
        }

    made = common.map_arrow(texts, run, "doc_id long, row long, spans array<struct<start: int, end: int>>")
    return scratch.table(made, "spans")


def _merged(spans: list, raw: bytes) -> list[dict]:
    """Sorted spans less overlaps; one that begins within a line leaves its last line end."""
    out: list[dict] = []
    for s in spans:
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append({"start": s["start"], "end": s["end"]})
    for s in out:
        if s["start"] and raw[s["start"] - 1] != 10 and raw[s["end"] - 1] == 10:
            s["end"] -= 1
    return out


def remove_repeats(
    documents: DataFrame, unit: str = "sentence", min_words: int = 10, broadcast_spans: int = 20_000
) -> DataFrame:
    """The documents, with their own columns, less repeated passages in ``text``.

    A column ``removed`` (array of start and end, in characters of the original text)
    comes last; an input column of that name gives way. ``broadcast_spans``: more rows and
    spans than so many, of about 16 bytes each, are joined by shuffle.
    """
    scratch = common.Scratch(documents.sparkSession, "repeats")
    spans = repeated_spans(documents.select("doc_id", "text"), unit, min_words, scratch)
    size = spans.agg(F.sum(F.size("spans") + 1)).first()[0] or 0
    scratch.drop("groups")
    plain = documents.drop("removed")
    doc, row, cut = common.fresh(plain.columns, "doc", "row", "cut")
    spans = spans.toDF(doc, row, cut)
    on = plain["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (_TEXT_HASH(plain["text"]) == F.col(row))
    joined = plain.join(F.broadcast(spans) if size <= broadcast_spans else spans, on, "left").drop(doc, row)

    def run(batches):
        for batch in common.released(batches):
            for k in range(0, batch.num_rows, common.BATCH_ROWS):
                part = batch.slice(k, common.BATCH_ROWS)
                texts, gone = part.column("text").to_pylist(), []
                for i, spans in enumerate(part.column(cut).to_pylist()):
                    gone.append([])
                    if not spans or not texts[i]:
                        continue
                    raw = texts[i].encode()
                    kept, at, chars = [], 0, 0
                    for s in _merged(spans, raw):
                        kept.append(raw[at : s["start"]].decode())
                        chars += len(kept[-1])
                        size = len(raw[s["start"] : s["end"]].decode())
                        gone[i].append({"start": chars, "end": chars + size})
                        chars, at = chars + size, s["end"]
                    texts[i] = "".join(kept) + raw[at:].decode()
                names = [name for name in part.schema.names if name != cut]
                columns = [pa.array(texts, pa.string()) if name == "text" else part.column(name) for name in names]
                removed = pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*columns, removed], names=[*names, "removed"])

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*plain.schema.fields, T.StructField("removed", T.ArrayType(span))])
    return joined.mapInArrow(run, schema)
