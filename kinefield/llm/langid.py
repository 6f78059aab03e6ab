"""Language identification: averaged hashed subword embeddings and a linear softmax.

Texts are lower-cased letters with single blanks for all else; their 1- to 3-grams are
hashed to rows of an embedding table, averaged over the whole text, and classified by a
softmax layer. Both are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows and on short pieces of them. As both are linear, prediction adds
one row of logits for each gram. A temperature and the score under which a text is
rejected are set on a part of the sample kept out of training.

Defined results: a text that is null or has no letter is ``und``, score 0, rejected. With
no labelled rows every text is. Rows with a null doc_id or label aren't learned from.
Rows are predicted one by one, so repeated rows get equal results. Extra columns are
ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinefield.llm import common

BITS = 16
_ORDERS = (1, 2, 3)
_BLANKS = " " * (max(_ORDERS) - 1)


@lru_cache
def _letters() -> np.ndarray:
    """The lower-case letter of each code point; 32 for all that isn't a letter."""
    out = np.full(0x110000, 32, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each gram of all texts, first gram of each text, letters in each text.

    Each text has a gram at least. Bucket 0 is for grams without a letter.
    """
    big = _BLANKS + _BLANKS.join(texts) + _BLANKS
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    # Grams of a text start from the last blank before it to its last character.
    begin = len(_BLANKS) - 1 + np.concatenate([[0], np.cumsum(lens + len(_BLANKS))])[:-1]
    letter = _letters()[np.frombuffer(big.encode("utf-32-le"), "<u4")]
    solid = letter != 32
    n = len(letter) - max(_ORDERS) + 1
    rows, code, some = [], np.zeros(n, np.uint32), np.zeros(n, bool)
    for k in _ORDERS:
        code = code * np.uint32(0x01000193) + letter[k - 1 : k - 1 + n] + np.uint32(1)
        some = some | solid[k - 1 : k - 1 + n]
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        rows.append(np.where(some, 1 + (mixed >> np.uint32(32 - BITS)), 0).astype(np.int32))
    at = np.stack(rows, axis=1).ravel()
    counted = np.concatenate([[0], np.cumsum(solid)])
    ends = np.minimum(begin + 1 + lens, len(solid))
    return at, begin * len(_ORDERS), counted[ends] - counted[np.minimum(begin + 1, ends)]


class Model:
    """Logits of each bucket, the languages, a temperature and the least accepted score."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray):
        self.langs, self.table, self.bias = langs, table, bias
        self.temperature, self.least = 1.0, 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and letters of each text."""
        at, begin, letters = grams(texts)
        if not texts:
            return np.zeros((0, len(self.langs))), letters
        stop = np.append(begin[1:], len(at))
        # Blanks between texts belong to bucket 0, which has no logits and isn't counted.
        total = np.add.reduceat(self.table[at], begin, axis=0, dtype=np.float64)
        real = np.concatenate([[0], np.cumsum(at > 0)])
        return total / np.maximum(real[stop] - real[begin], 1)[:, None] + self.bias, letters

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        logits, letters = self.logits(texts)
        scores = self.scores(logits)
        none = letters == 0
        best = scores.argmax(axis=1) if len(scores) else np.zeros(0, int)
        langs = ["und" if x else self.langs[k] for k, x in zip(best.tolist(), none.tolist(), strict=True)]
        top = np.where(none, 0.0, scores.max(axis=1) if len(scores) else 0.0)
        return langs, top, none | (top < self.least)


def train(
    rows: list[tuple[str, str]], seed: int = 1, width: int = 16, epochs: int = 12, rate: float = 0.5, lost: float = 0.001
) -> Model | None:
    """A model from (text, language) rows; ``lost``: the part of kept-out rows to reject."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    rows = [rows[k] for k in rng.permutation(len(rows))]
    kept_out = rows[: len(rows) // 5]
    learned = rows[len(rows) // 5 :]
    samples = []
    for text, lang in learned:
        samples.append((text, lang))
        words = text.split()
        for size in (1, 3, 8, 20):  # short pieces, as short texts are to be told too
            if len(words) > size:
                at = int(rng.integers(0, len(words) - size))
                samples.append((" ".join(words[at : at + size]), lang))
    count = 1 + (1 << BITS)
    emb = rng.normal(0, 0.1, (count, width)).astype(np.float32)
    emb[0] = 0
    out, bias = np.zeros((width, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    bags = []
    for k in range(0, len(samples), 256):
        at, begin, _ = grams([t for t, _ in samples[k : k + 256]])
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(at)], strict=True):
            bucket, many = np.unique(at[a:b], return_counts=True)
            real = bucket > 0
            bags.append((bucket[real], (many[real] / max(1, many[real].sum())).astype(np.float32)))
    label = np.array([langs.index(lang) for _, lang in samples])
    for epoch in range(epochs):
        order = rng.permutation(len(samples))
        step = rate * (1 - epoch / epochs) + 0.01
        for a in range(0, len(order), 16):
            some = order[a : a + 16]
            ids = np.concatenate([bags[k][0] for k in some])
            wts = np.concatenate([bags[k][1] for k in some])
            doc = np.repeat(np.arange(len(some)), [len(bags[k][0]) for k in some])
            hidden = np.zeros((len(some), width), np.float32)
            np.add.at(hidden, doc, emb[ids] * wts[:, None])
            z = hidden @ out + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(some)), label[some]] -= 1
            back = z @ out.T
            out -= step * (hidden.T @ z)
            bias -= step * z.sum(axis=0) / len(some)
            # Rows of one text are distinct, so texts are taken one by one.
            np.subtract.at(emb, ids, (10 * step) * wts[:, None] * back[doc])
    model = Model(langs, (emb @ out).astype(np.float32), bias.astype(np.float64))
    _calibrate(model, kept_out, lost)
    return model


def _calibrate(model: Model, rows: list[tuple[str, str]], lost: float) -> None:
    rows = [(t, lang) for t, lang in rows if lang in model.langs and t]
    if not rows:
        return
    logits, letters = model.logits([t for t, _ in rows])
    truth = np.array([model.langs.index(lang) for _, lang in rows])

    def loss(temperature: float) -> float:
        z = logits / temperature
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    model.temperature = min((2.0**k for k in np.arange(-3, 3.25, 0.25)), key=loss)
    top = model.scores(logits).max(axis=1)[letters > 0]
    if len(top):
        # A score that a random guess would have is never asked to be exceeded by much.
        model.least = float(min(np.quantile(top, lost), 0.4))


def held_out(doc_id: Column) -> Column:
    """Documents that a model isn't trained on: crc32 of the id's text modulo 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, rows_per_language: int = 400, chars: int = 50_000) -> Model | None:
    """Train on rows (doc_id, text, lang).

    A bounded sample is enough: about ``rows_per_language`` rows of each language, picked
    by a hash of doc_id, with texts of at most ``chars`` characters.
    """
    labelled = labelled.filter("doc_id is not null and lang is not null and text is not null").select(
        "doc_id", "text", "lang"
    )
    short = labelled.filter(F.length("text") <= chars)
    counts = {r["lang"]: r["count"] for r in short.groupBy("lang").count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, rows_per_language / n))))
    picked = short.filter(draw < F.element_at(share, F.col("lang")))
    by_lang: dict[str, list] = {}
    for r in picked.collect():
        by_lang.setdefault(r["lang"], []).append((r["doc_id"], r["text"]))
    rows = []
    for lang, found in sorted(by_lang.items()):
        rows += [(text, lang) for _, text in sorted(found)[: 2 * rows_per_language]]
    return train(rows)


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of the whole text of each row."""

    def run(batch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        langs, scores, rejected = [], [], []
        for a, b in _pieces(texts):
            got = _predict(model, texts[a:b])
            langs += got[0]
            scores.append(got[1])
            rejected.append(got[2])
        yield {
            "doc_id": batch.column("doc_id"),
            "lang_pred": langs,
            "score": np.concatenate(scores),
            "rejected": pa.array(np.concatenate(rejected)),
        }

    return common.map_arrow(
        documents.select(F.col("doc_id").cast("long"), "text"),
        run,
        "doc_id long, lang_pred string, score double, rejected boolean",
    )


def _predict(model: Model | None, texts: list[str]):
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    return model.predict(texts)


def _pieces(texts: list[str]):
    """Ranges of about 2**18 characters, or one text."""
    at = size = 0
    for k, text in enumerate(texts):
        if k > at and size + len(text) > 1 << 18:
            yield at, k
            at, size = k, 0
        size += len(text)
    yield at, len(texts)


def keep_identified(documents: DataFrame, model: Model | None) -> DataFrame:
    """The documents, with their own columns, that aren't rejected."""
    def run(batches):
        for batch in common.released(batches):
            for k in range(0, batch.num_rows, common.BATCH_ROWS):
                part = batch.slice(k, common.BATCH_ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                gone = np.concatenate([_predict(model, texts[a:b])[2] for a, b in _pieces(texts)])
                yield part.filter(pa.array(~gone))

    common.small_batches(documents.sparkSession)
    return documents.mapInArrow(run, documents.schema)
