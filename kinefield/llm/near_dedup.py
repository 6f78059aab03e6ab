"""MinHash near-duplicate groups.

One permutation hashing with optimal densification gives each distinct shingle
set a signature; bands of it are buckets. Each bucket offers star edges from its
members to one centre, so the pairs offered are at most buckets times members,
never all pairs of a bucket. Offered edges are confirmed on the full sets.

Links are sought in rounds. The first centre of a bucket is its smallest id. Later
rounds take only buckets that still hold several components, and offer only edges
between components: first to the member with most confirmed links, then to several
centres, which are all members of a bucket with no more than so many and else drawn by a
hash that differs each round. The late rounds end when one joins nothing. What stars can't
tell is then told exactly: the texts of larger buckets that still hold several components
are joined on the rarest of their shingles (prefix and
position filter), which offers every pair that may be a link between components.

Defined results: null or blank text has an empty set, is linked with nothing and
stands for itself. Rows that share a doc_id are one document with any of its
texts. A null doc_id stays unlinked (component_id null, kept). Repeated rows and
equal sets are linked through one representative, the smallest doc_id. Extra
input columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinefield.llm import common
from kinefield.llm.components import joined

_SEED = 20_241


class OnePermutation:
    """Signatures of ``bands * rows`` bins and their band keys."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(_SEED)
        # ranks[i, j]: when bin i probes bin j. An empty bin takes the value of the
        # first filled bin of its own probe order (optimal densification).
        self.ranks = rng.permuted(np.tile(np.arange(self.bins, dtype=np.uint16), (self.bins, 1)), axis=1)
        self.mults = rng.integers(1, 1 << 63, self.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.places = common.mix(np.arange(self.bins, dtype=np.uint64) + np.uint64(self.bins))
        self.salts = common.mix(np.arange(1, bands + 1, dtype=np.uint64) * common.BASE)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """``shingles``: sorted distinct 64-bit hashes, one at least."""
        where = ((shingles >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        filled = where[first].astype(np.int64)
        out = np.empty(self.bins, np.uint64)
        out[filled] = shingles[first]
        if len(filled) < self.bins:
            empty = np.ones(self.bins, bool)
            empty[filled] = False
            empty = np.flatnonzero(empty)
            out[empty] = out[filled[self.ranks[np.ix_(empty, filled)].argmin(axis=1)]]
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band of each signature row."""
        parts = common.mix(signatures).reshape(len(signatures), self.bands, self.rows)
        return common.mix((parts * self.mults).sum(axis=2, dtype=np.uint64) + self.salts)


    def sketch(self, signatures: np.ndarray) -> np.ndarray:
        """One bit of each bin, in 64-bit words."""
        bits = np.packbits((common.mix(signatures ^ self.places) & np.uint64(1)).astype(np.uint8), axis=1)
        words = np.zeros((len(bits), 8 * self.words), np.uint8)
        words[:, : bits.shape[1]] = bits
        return words.view(np.int64)

    @property
    def words(self) -> int:
        return -(-self.bins // 64)

    def far(self, percent: int) -> int:
        """More differing bits than a pair at the least similarity has: six deviations."""
        share = (1 - percent / 100) / 2
        return int(self.bins * share + 6 * (self.bins * share * (1 - share)) ** 0.5) + 1


@lru_cache
def permutation(bands: int, rows: int) -> OnePermutation:
    return OnePermutation(bands, rows)


def shingle_sets(batch: pa.RecordBatch, width: int):
    """(row, sorted distinct shingle hashes) of each row of a (doc_id, text) batch."""
    data, offsets = common.text_bytes(batch.column("text"))
    for a, b in common.chunks(offsets):
        part = offsets[a : b + 1] - offsets[a]
        hashes, begin = common.shingle_hashes(data[offsets[a] : offsets[b]], part, width)
        for k in range(b - a):
            yield a + k, np.unique(hashes[begin[k] : begin[k + 1]])


def signatures(documents: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys, sketch)."""
    import xxhash

    def run(batch):
        opm = permutation(bands, rows)
        sets = [s for _, s in shingle_sets(batch, width)]
        full = [k for k, s in enumerate(sets) if len(s)]
        keys = np.zeros((len(sets), bands), np.uint64)
        bits = np.zeros((len(sets), opm.words), np.int64)
        if full:
            made = np.stack([opm.signature(sets[k]) for k in full])
            keys[full], bits[full] = opm.keys(made), opm.sketch(made)
        yield {
            "doc_id": batch.column("doc_id"),
            "n_shingles": np.array([len(s) for s in sets], np.int64),
            "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            "bands": _lists(keys.view(np.int64)),
            "bits": _lists(bits),
        }

    return common.map_arrow(
        documents.select(F.col("doc_id").cast("long"), "text"),
        run,
        "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>",
    )


def _lists(rows: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))


def sets_of(documents: DataFrame, ids: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """(id, shingles) of the documents in ``ids``."""
    small = ids.limit(broadcast_rows + 1).count() <= broadcast_rows
    wanted = documents.select(F.col("doc_id").cast("long"), "text").join(
        F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("id"), "left_semi"
    )

    def run(batch):
        ids = batch.column("doc_id")
        for a in range(0, batch.num_rows, 64):
            sets = [s for _, s in shingle_sets(batch.slice(a, 64), width)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate(sets).view(np.int64))
            yield {"id": ids.slice(a, 64), "shingles": pa.ListArray.from_arrays(ends, flat)}

    return common.map_arrow(wanted, run, "id long, shingles array<long>")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) with 100 * intersection >= percent * union on the full sets.

    ``hub`` (a or b) may have many edges: its set comes to them last, once for each task
    that has some, and isn't shuffled with each.
    """
    member = sets.select(F.col("id").alias("member"), F.col("shingles").alias("own"))
    hub = sets.select(F.col("id").alias("hub"), F.col("shingles").alias("other"))
    both = F.size(F.array_intersect("own", "other")).cast("long")
    union = F.size("own") + F.size("other") - both
    return (
        edges.select("a", "b", "hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"))
        .join(member, "member")
        .join(hub, "hub")
        .filter(100 * both >= percent * union)
        .select("a", "b")
    )


def _may_link(star: Column, percent: int, far: int) -> Column:
    """Whether a row's text (n, bits, label) and a centre may be a link between components."""
    differ = F.aggregate(
        F.zip_with("bits", star["bits"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y
    )
    small, large = F.least("n", star["n"]), F.greatest("n", star["n"])
    return (F.col("label") != star["label"]) & (100 * small >= percent * large) & (differ <= far)


def _rest(members: DataFrame, labels: DataFrame | None, sets: DataFrame, percent: int, scratch: common.Scratch) -> DataFrame:
    """Pairs (a, b) that may be links between components that share a bucket of ``members``.

    Shingles are ordered by how many of these texts have them, rarest first. The first one
    that a linked pair shares leaves as many behind it, in either set, as the pair must
    share; so sets are joined on shingles with enough behind them.
    """
    pool = members.select("key", "id", "n").withColumn("label", F.col("id"))
    if labels is not None:
        pool = members.select("key", "id", "n").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    buckets = pool.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
    buckets = scratch.table(buckets.filter("_low < _high").select("key"), "open")
    texts = scratch.table(pool.join(buckets, "key").select("id", "n", "label").distinct(), "open-texts")
    grams = scratch.table(texts.join(sets, "id").select("id", "n", "label", F.explode("shingles").alias("g")), "open-grams")
    # A shingle that one component alone has comes first, too, but meets nothing.
    shared = grams.groupBy("g").agg(F.count("*").alias("df"), F.min("label").alias("_low"), F.max("label").alias("_high"))
    shared = scratch.table(shared.filter("df > 1").select("g", "df", (F.col("_low") < F.col("_high")).alias("across")), "shared")
    ranked = grams.join(shared, "g").groupBy("id").agg(
        F.first("n").alias("n"), F.first("label").alias("label"),
        F.array_sort(F.collect_list(F.struct("df", "g", "across"))).alias("order"),
    )
    place = F.col("n") - F.size("order") + F.col("k")
    heads = (
        ranked.select("id", "n", "label", "order", F.posexplode("order").alias("k", "s"))
        .withColumn("left", (F.col("n") - place).cast("long"))
        .filter(F.col("s.across") & (100 * F.col("left") >= percent * F.col("n")))
        .select("id", "n", "label", "left", F.col("s.g").alias("g"))
    )
    heads = scratch.table(heads, "heads")
    # Pairs within a shingle's commonest component are never made: one of two is of another.
    per = heads.groupBy("g", "label").agg(F.count("*").alias("c"))
    most = per.groupBy("g").agg(F.max(F.struct("c", "label"))["label"].alias("most"), F.count("*").alias("labels"))
    most = scratch.table(most.filter("labels > 1").select("g", "most"), "most")
    heads = scratch.table(heads.join(most, "g").withColumn("minor", F.col("label") != F.col("most")).drop("most"), "met")
    x, y = heads.filter("minor").alias("x"), heads.alias("y")
    need = percent * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(
        y,
        (F.col("x.g") == F.col("y.g"))
        & (F.col("x.label") != F.col("y.label"))
        & (~F.col("y.minor") | (F.col("x.id") < F.col("y.id")))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & ((100 + percent) * F.least("x.left", "y.left") >= need),
    )
    return pairs.groupBy(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).agg(F.min("y.id").alias("hub"))


def near_duplicates(
    documents: DataFrame,
    width: int = 5,
    percent: int = 80,
    bands: int = 50,
    rows: int = 7,
    centres: int = 12,
    rounds: int = 4,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each document row.

    ``percent``: the least similarity of a link; ``bands`` x ``rows`` bins find a pair
    at 0.8 with all but about one in 100,000. ``centres``: of a bucket, in a late round.
    ``rounds``: late rounds at most, before the rest is told exactly. ``broadcast_rows``: more ids are joined by shuffle.
    """
    scratch = common.Scratch(documents.sparkSession, "near")
    far = permutation(bands, rows).far(percent)
    sig = scratch.table(signatures(documents, width, bands, rows), "signatures")
    classes = scratch.table(
        sig.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
            F.first("bits").alias("bits"),
        ),
        "classes",
    )
    members = classes.select("id", "n", F.explode("bands").alias("key"))
    crowded = members.groupBy("key").agg(F.min("id").alias("_low"), F.max("id").alias("_high"), F.count("*").alias("size"))
    # Written apart, so that a join with it can split the rows of a common key.
    crowded = scratch.table(crowded.filter("_low < _high").select("key", "size"), "crowded")
    # Only buckets with two texts at least; all later rounds read this table.
    members = scratch.table(members.join(crowded, "key").join(classes.select("id", "bits"), "id"), "members")
    ids = scratch.table(members.select("id").distinct(), "ids")
    sets = scratch.table(sets_of(documents, ids, width, broadcast_rows), "sets")

    labels = None  # (id, label) of texts in components of several
    tried = degree = None
    for turn in range(2 + rounds):
        pool = members.withColumn("label", F.col("id"))
        if labels is not None:
            pool = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        if turn > 2:
            pool = pool.filter(F.col("size") > centres)
        if turn == 0:
            orders = [F.lit(0)]
        elif turn == 1:
            pool = pool.join(degree, "id", "left")
            orders = [-F.coalesce("degree", F.lit(0))]
        else:
            orders = [F.xxhash64("id", F.lit(100 * turn + k)) for k in range(centres)]
        picked = [F.min("label").alias("_low"), F.max("label").alias("_high")]
        for k, o in enumerate(orders):
            picked.append(F.min(F.struct(o.cast("long").alias("o"), "id", "n", "label", "bits")).alias(f"c{k}"))
        listed = F.array(*(f"c{k}" for k in range(len(orders)))).alias("stars")
        stars = pool.groupBy("key").agg(*picked).filter("_low < _high").select("key", listed)
        if turn == 2:
            # All members of a small bucket are centres, so no later round has to see it.
            few = pool.filter(F.col("size") <= centres).groupBy("key")
            every = F.collect_list(F.struct(F.lit(0).cast("long").alias("o"), "id", "n", "label", "bits")).alias("stars")
            few = few.agg(F.min("label").alias("_low"), F.max("label").alias("_high"), every).filter("_low < _high")
            large = pool.filter(F.col("size") > centres).groupBy("key").agg(*picked).filter("_low < _high")
            stars = few.select("key", "stars").unionByName(large.select("key", listed))
        stars = scratch.table(stars, f"stars-{turn}")
        # Sizes or sketches that no pair at the least similarity has need no full sets.
        offered = (
            pool.join(stars, "key")
            .select("id", F.explode(F.filter(F.array_distinct("stars"), lambda s: _may_link(s, percent, far))).alias("star"))
            .groupBy(F.least("id", "star.id").alias("a"), F.greatest("id", "star.id").alias("b"))
            .agg(F.min("star.id").alias("hub"))
        )
        if tried is not None:
            offered = offered.join(tried, ["a", "b"], "left_anti")
        offered = scratch.table(offered, f"offered-{turn}")
        found = scratch.table(confirmed(offered, sets, percent), f"found-{turn}")
        tried = offered.select("a", "b") if tried is None else tried.unionByName(offered.select("a", "b"))
        if turn == 0:
            ends = found.select(F.explode(F.array("a", "b")).alias("id"))
            degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
        if found.isEmpty():
            if turn > 1:
                break
            continue
        labels = joined(labels, found, scratch, f"labels-{turn}")
    # A star holds all pairs of a bucket of two, and all were centres in small buckets.
    left = members.filter(F.col("size") > (centres if rounds > 0 else 2))
    offered = _rest(left, labels, sets, percent, scratch).join(tried, ["a", "b"], "left_anti")
    found = scratch.table(confirmed(scratch.table(offered, "offered-rest"), sets, percent), "found-rest")
    if not found.isEmpty():
        labels = joined(labels, found, scratch, "labels-rest")
    scratch.drop("members")
    scratch.drop("sets")
    return _grouped(sig, classes, labels)


def _grouped(sig: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    owner = classes.select("digest", "id")
    if labels is None:
        owner = owner.withColumn("component_id", F.col("id"))
    else:
        # Components may share classes through a doc_id with several texts.
        owner = owner.join(labels, "id", "left").withColumn("component_id", F.coalesce("label", "id"))
    owner = owner.select(F.col("digest").alias("_digest"), "component_id")
    full = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = sig.select("doc_id", "n_shingles", "digest").join(
        owner, (F.col("digest") == F.col("_digest")) & full, "left"
    )
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(documents: DataFrame, broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """One document of each group, with its own columns; the smallest doc_id stays.

    Of rows that share a doc_id all stay or go together. Null doc_ids stay.
    """
    scratch = common.Scratch(documents.sparkSession, "kept")
    (name,) = common.fresh(documents.columns, "gone")
    gone = near_duplicates(documents, **options).filter(~F.col("kept")).select(F.col("doc_id").alias(name))
    gone = scratch.table(gone.distinct(), "gone")
    small = gone.limit(broadcast_rows + 1).count() <= broadcast_rows
    return documents.join(
        F.broadcast(gone) if small else gone, documents["doc_id"].cast("long") == F.col(name), "left_anti"
    )
