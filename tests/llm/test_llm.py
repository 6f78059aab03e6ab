import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinefield.llm import chat, common, decontam, fingerprints, langid, near_dedup, packing, sharding, substring, tokenfile, warc
from kinefield.llm.common import Scratch
from kinefield.llm.components import connected
from kinefield.llm.queries import ORACLES, QUERIES
from kinefield.llm.tokens import Encoder, public_vocabulary
from tests.compare import both

VOCABULARY = public_vocabulary()
DOCS = "doc_id long, text string, digest string, label int"
#: Nulls, blanks, a tie of ids, a repeated row, long and short texts, clashing columns.
ODD = [
    (1, "the cat sat on the mat and then it went home", "x", 1),
    (2, "the cat sat on the mat and then it went home", None, None),
    (2, "the cat sat on the mat and then it went home", None, None),
    (3, None, "x", 1),
    (4, "", "x", 1),
    (5, " \n\t", "x", 1),
    (None, "the cat sat on the mat and then it went home", "x", 1),
    (6, "word", "x", 1),
    (7, "Wörter ßtraße 12 + 'it's 日本語 \U0001f600 end", "x", 1),
    (7, "another text under the same id", "x", 1),
    (8, "long words " * 5000, "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# SQL where it can say it -----------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    mine, theirs = both(spark, QUERIES[name], ORACLES[name])
    assert mine == theirs and mine


# 1. Chat ---------------------------------------------------------------------------------


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", None, 5.0),
        (1, 4, 3, "user", "</s> <\\s>", 1.0), (2, 1, 9, None, "orphan", 0.0), (3, 1, 2, "user", "cycle", 0.0),
        (3, 2, 1, "user", "cycle", 0.0), (None, 1, None, "a\nb\\n", "x", 0.0),
    ]
    df = spark.createDataFrame(rows, "tree long, msg long, parent long, role string, text string, score double")
    made = chat.format_threads(df, top=2).withColumn("turns", chat.read_turns(F.col("formatted")))
    got = {(r.tree, r.branch): [tuple(t) for t in r.turns] for r in made.collect()}
    assert got == {
        (1, 1): [("user", "a"), ("assistant", ""), ("user", "</s> <\\s>")],
        (1, 2): [("user", "a"), ("assistant", "b")],
        (2, 1): [("", "orphan")],
        (None, 1): [("a\nb\\n", "x")],
    }
    assert chat.format_threads(df.filter("tree = 99")).count() == 0


def test_control_strings_never_stay(spark):
    texts = ["<|im_end|>", "<\\|im_end|>", "[INST][/INST]<<SYS>>", "a<b>[c]\\", "<s></s><\\\\s>", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df = df.select("t", chat.escaped(F.col("t")).alias("e")).withColumn("back", chat.unescaped(F.col("e")))
    for r in df.collect():
        assert r.back == r.t and not any(c in r.e for c in ("<|im_end|>", "</s>", "<s>", "[INST]", "<<SYS>>"))


def test_linear_conversations(spark):
    """A very long text, repeated rows and turns, nulls, and columns named as internal ones."""
    long = "x<|im_end|>\n" * 20_000
    rows = [
        (1, 0, "user", long, "a", 1), (1, 1, "assistant", "</s>", "a", 1), (1, 1, "assistant", "</s>", "a", 1),
        (2, None, None, None, None, None), (None, 0, "assistant", "y", "b", 2),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, msg string, tree int")
    made = chat.format_threads(chat.conversation_messages(df))
    found = made.select("tree", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l"))
    got = {r.tree: ([tuple(t) for t in r.t], r.l) for r in found.collect()}
    assert got == {
        1: ([("user", long), ("assistant", "</s>"), ("assistant", "</s>")], "</s></s>"),
        2: ([("", "")], ""),
        None: ([("assistant", "y")], "y"),
    }
    assert chat.format_threads(chat.conversation_messages(df.limit(0))).count() == 0


# 2. WARC ---------------------------------------------------------------------------------


def test_streams_inflate_in_pieces(monkeypatch):
    """Highly packed members, one after another, with pieces smaller than records."""
    records = [warc.record(k, None, (b"x" * 5000 if k % 2 else b"") + str(k).encode(), None) for k in range(30)]
    for cut in (1, 7, 30):
        data = b"".join(gzip.compress(b"".join(records[k : k + cut])) for k in range(0, 30, cut))
        for size in (1 << 20, 100, 3):
            monkeypatch.setattr(warc, "_BLOCK", size)
            assert all(len(p) <= size for p in warc._inflated(io.BytesIO(data)))
            assert list(warc.read_stream(io.BytesIO(data))) == records
            with pytest.raises(ValueError):
                list(warc.read_stream(io.BytesIO(gzip.compress(records[0][:-1]))))


def test_archives(spark, tmp_path):
    pages = [(1, "http://a/é x", "same"), (5, None, "same"), (3, "u", "same"), (4, "u", None), (6, "u", "ü" * 3000), (None, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    scratch = Scratch(spark, "t")
    written = scratch.table(warc.write_archives(df, scratch.path("w"), scratch, min_bytes=1, archive_bytes=900), "m")
    normal = scratch.table(warc.normalise(written, scratch.path("normal")), "n")
    rows = {r.page_id: r for r in warc.read_records(normal).collect()}
    assert {k: r.refers_to for k, r in rows.items()} == {1: 5, 3: 5, None: 5, 4: None, 5: None, 6: None}
    assert rows[6].payload_bytes == 6000 and rows[1].payload_digest == warc.digest(b"same")
    empty = scratch.table(warc.write_archives(df.filter("page_id = 99"), scratch.path("w2"), scratch), "m2")
    assert warc.read_records(empty).count() == 0


def test_archives_of_odd_rows(spark):
    """Repeated rows of the largest page_id, a very long page, columns named as internal ones."""
    long = "ab" * 2_000_000
    pages = [(1, "u", "same", "x", 1), (9, "u", "same", "x", 1), (9, "u", "same", "x", 1), (2, None, long, None, None), (3, "u", "", "x", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, refers_to string, rp int")
    scratch = Scratch(spark, "t")
    written = scratch.table(warc.write_archives(df, scratch.path("w"), scratch), "m")
    rows = warc.read_records(scratch.table(warc.normalise(written, scratch.path("normal")), "n")).collect()
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows if r.page_id != 1)
    assert got == [(2, 4_000_000, "response", None), (3, 0, "response", None), (9, 4, "response", None), (9, 4, "response", None)]
    assert [(r.record_type, r.refers_to) for r in rows if r.page_id == 1] == [("revisit", 9)]


# 3. Fingerprints -------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=60), st.text("ab", max_size=60), st.data())
def test_prefix_hashes(a, b, data):
    x, y = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    size = 0
    while i + size < len(a) and j + size < len(b) and a[i + size] == b[j + size]:
        size += 1
    assert x.extension(i, y, j) == size
    cut = len(a) // 2
    assert fingerprints.Prefixes(a[:cut] + b, x, cut).fingerprint() == fingerprints.Prefixes(a[:cut] + b).fingerprint()


def test_edited_texts(odd, none):
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == len(rows) and fingerprints.fingerprints(none).count() == 0
    by_id = {r.doc_id: r for r in got}
    text = ODD[0][1]
    edited = text[: len(text) - len(text) // 4] + text[: len(text) // 4]
    assert by_id[1].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert by_id[1].near_next == 1.0 and by_id[1].fingerprint == by_id[2].fingerprint
    assert by_id[3].n_chars == 0 and all(0 <= r.near_edited <= 1 for r in got)


# 4. Near duplicates ----------------------------------------------------------------------


def test_near_duplicates_by_brute_force(spark, odd, none):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    sets = [{tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dedup.near_duplicates(df, width=2).collect()}
    assert got == {k: (label[k], len(sets[k])) for k in got} and len(got) == len(texts)
    rows = near_dedup.near_duplicates(odd, width=2).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert {r.n_shingles for r in rows if r.doc_id in (3, 4, 5)} == {0} and near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 7, 8]


def test_near_duplicates_of_a_template(spark):
    # Pairs share the template and some words more: 0.816. Others share the template: 0.795.
    template, texts = [f"t{k}" for k in range(350)], []
    for k in range(600):
        own = [f"p{k // 2}x{j}" for j in range(6)] + [f"o{k}x{j}" for j in range(39)]
        texts.append(" ".join(template + own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert like(0, 1) >= 0.8 > max(like(0, b) for b in range(2, 600))
    # One centre a bucket and no late round: what the stars leave must be told exactly.
    for options in ({"centres": 1, "rounds": 0}, {}):
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, width=2, **options).collect()}
        assert got == {k: k - k % 2 for k in range(600)}


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r.id: r.label for r in connected(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100}


# 5. Language -----------------------------------------------------------------------------


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.filter(~out), rows_per_language=100)
    found = langid.identify(docs.filter(out), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [got[k].lang_pred for k in (3, 4, 5)] == ["und"] * 3 and got[3].score == 0 and got[6].lang_pred != "und"
    assert langid.fit(none.withColumn("lang", F.lit("x"))) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.keep_identified(odd, model).columns == odd.columns


# 6 and 7. Token ids ----------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t ab'sé.,1　\x85ß", "<|endoftext|>"]), max_size=25).map("".join), max_size=4))
def test_units_give_the_library_ids(texts):
    coder = test_units_give_the_library_ids.coder
    flat, ends = coder.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [coder.plain(t) for t in texts]


test_units_give_the_library_ids.coder = Encoder(VOCABULARY, 64)


def thue_morse(size):
    """Two texts of which polynomial hashes modulo 2**64 are equal, whatever the base."""
    text = "a"
    while len(text) < size:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1024, 2048])
def test_texts_of_like_structure_are_told_apart(spark, size):
    pair = thue_morse(size)
    flat, ends = Encoder(VOCABULARY, 64).encode([*pair, *pair])
    assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [test_units_give_the_library_ids.coder.plain(t) for t in pair] * 2
    rows = [(k, f"{t}. own{k} b c d e f") for k, t in enumerate(pair)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(df, width=2).collect()} == {0, 1}
    assert [r.text for r in substring.remove_repeats(df, min_words=1).orderBy("doc_id").collect()] == [t for _, t in rows]


def test_units_are_compared_where_hashes_are_equal(monkeypatch):
    monkeypatch.setattr(common, "span_hashes", lambda data, start, end, seed=0: ((end - start) % 3).astype(np.uint64))
    rng, coder = random.Random(1), Encoder(VOCABULARY, 16)
    for _ in range(4):
        texts = [" ".join(rng.choice(["ab", "cd", "longer", "zz", "1,2", "é"]) for _ in range(30)) for _ in range(5)]
        flat, ends = coder.encode(texts)
        assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [coder.plain(t) for t in texts]


def test_packing(odd, none):
    window = 64
    rows = packing.pack(odd, VOCABULARY, window).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)
    coder = Encoder(VOCABULARY, 64)
    for doc, text in ((6, "word"), (8, ODD[-1][1]), (3, "")):
        ids = coder.plain(text) + [0]
        assert sum((p for _, p in sorted(by_doc[doc, len(ids)])), []) == ids
    assert packing.pack(none, VOCABULARY).count() == 0


def test_sum_of_squares_takes_the_best_level():
    rng, packer = random.Random(1), packing.SumOfSquares(32)
    for _ in range(500):
        size = rng.randrange(1, 32)
        n = packer.counts
        cost = {0: (n[size] + 1) ** 2 - n[size] ** 2}
        for h in range(1, 33 - size):
            if n[h]:
                after = 0 if h + size == 32 else (n[h + size] + 1) ** 2 - n[h + size] ** 2
                cost[h] = after + (n[h] - 1) ** 2 - n[h] ** 2
        assert cost[packer.level(size)] == min(cost.values())
        packer.put((0, 0, bytes(4 * size), size))


def test_windows_settle():
    rng, packer, out, total = random.Random(1), packing.SumOfSquares(64), [], 0
    for k in range(3000):
        size = rng.randrange(1, 64)
        total += size
        full = packer.put((k, 0, np.full(size, k, "<u4").tobytes(), size))
        out += [full] if full else []
        if packer.held > 5000:
            out += list(packer.settle())
            assert packer.held < 64
    placed = len(out)
    out += list(packer.rest())
    fills = [sum(len(p[2]) // 4 for p in held) for held in out]
    assert sum(fills) == total and all(n == 64 or n & (n - 1) == 0 for n in fills) and placed > 0.9 * len(out)
    pieces = {}
    for held in out:
        for doc, start, ids, size in held:
            pieces.setdefault((doc, size), []).append((start, len(ids) // 4))
            assert set(np.frombuffer(ids, "<u4").tolist()) == {doc}
    for (_, size), found in pieces.items():
        ends = np.cumsum([0] + [n for _, n in sorted(found)]).tolist()
        assert ends[-1] == size and [a for a, _ in sorted(found)] == ends[:-1]


def test_token_files(spark, odd, none):
    scratch = Scratch(spark, "t")
    manifest = scratch.table(tokenfile.write_shards(odd, scratch.path("files"), VOCABULARY, 2, shard_ids=200), "m")
    rows = sorted(tokenfile.read_shards(manifest).collect(), key=lambda r: r.start)
    coder, at = Encoder(VOCABULARY, 64), 0
    ids = {t or "": coder.plain(t or "") + [2] for _, t, *_ in ODD}
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 7, 8]
    wanted = sorted((d or -1, ids[t or ""]) for d, t, *_ in ODD)
    assert sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == wanted
    for r in rows:
        assert r.start == at
        at += len(r.ids) // 4
    found = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in tokenfile.lookup(manifest, [6, 2, 99, 6]).collect())
    assert found == [(2, ids[ODD[1][1]])] * 2 + [(6, ids["word"])] and tokenfile.lookup(manifest, []).count() == 0
    empty = scratch.table(tokenfile.write_shards(none, scratch.path("s2"), VOCABULARY), "m2")
    assert tokenfile.read_shards(empty).count() == 0


def test_minimal_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    values = tokenfile.MinimalHash.build(keys).find(keys)
    assert sorted(values.tolist()) == list(range(len(keys)))


# 8. Decontamination ----------------------------------------------------------------------


def _edits(a, b):
    """Least edits of a against any part of b."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        row = _next(row, i, c, b)
    return min(row)


def _next(row, i, c, b):
    new = [i]
    for j, d in enumerate(b, 1):
        new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
    return new


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 4))
def test_edited_passages_are_found(seed, edits):
    rng = random.Random(seed)
    item = "".join(rng.choice("abcdefgh ") for _ in range(100)).strip().replace("  ", " x")
    copy = list(item)
    for _ in range(edits):
        copy[rng.randrange(len(copy))] = rng.choice("xyz")
    head, tail = ("".join(rng.choice("mnopq ") for _ in range(50)) for _ in range(2))
    scanner = decontam.Scanner([(1, item)], 12, 0.05, 120, 24)
    data = np.frombuffer(f"{head} {''.join(copy)} {tail}".encode(), np.uint8)
    plain, bounds, _ = decontam.normalised(data, np.array([0, len(data)]))
    found = scanner.find(plain, bounds)
    pattern = scanner.windows[0][1].tobytes().decode()
    best = _edits(pattern, plain.tobytes().decode())
    assert bool(found) == (best <= scanner.windows[0][2])


def test_excerpts_are_found():
    rng = random.Random(5)
    for size in (179, 400):
        item = "".join(rng.choice("abcdefghij") for _ in range(size))
        scanner = decontam.Scanner([(1, item)], 12, 0.05, 120, 24)
        for at in range(size - 139 + 1):
            text = np.frombuffer(f"own text {item[at : at + 139]} more".encode(), np.uint8)
            assert scanner.find(text, np.array([0, len(text)]))


def test_short_items_and_signs(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PAIRS", 50)
    long = "the “long” item — with typographic signs… that is sought by grams and alignment"
    bench = spark.createDataFrame([(1, "Blue whale!"), (2, "x1"), (3, long), (4, "..."), (5, long), (5, long)], "item_id long, text string")
    texts = [
        "a blue   WHALE, swims", "blue whales", "ablue whale", "blue whale", "no x12", "(x1)",
        'see: the "long" item - with typographic signs... that is sought by grams and alignment', "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {0: [1], 1: [], 2: [], 3: [1], 4: [], 5: [2], 6: [3, 5], 7: []}
    for options in ({}, {"group_bytes": 40}):
        rows = decontam.find_contamination(df, bench, **options).collect()
        assert {r.doc_id: r["items"] for r in rows} == want
        assert {texts[0][p.start : p.end] for r in rows if r.doc_id == 0 for p in r.places} == {"blue   WHALE"}
        kept = decontam.drop_contaminated(df, bench, **options)
        assert sorted(r.doc_id for r in kept.collect()) == [k for k, x in want.items() if not x]


def test_contamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, ODD[0][1]), (2, None), (3, "shortest")], "item_id long, text string")
    got = decontam.find_contamination(odd, bench).collect()
    assert sorted(r.doc_id or 0 for r in got if r.contaminated) == [0, 1, 2, 2] and len(got) == len(ODD)
    assert decontam.find_contamination(none, bench).count() == 0
    assert decontam.drop_contaminated(odd, bench.limit(0)).count() == len(ODD)
    assert decontam.drop_contaminated(odd, bench).columns == odd.columns


# 9. Repeated passages --------------------------------------------------------------------


def test_passages(spark, odd, none):
    passage = " ".join(f"p{k}" for k in range(40)) + "."
    rows = [(2, f"Own start. {passage} Own end ü."), (1, f"ü first. {passage}"), (3, f"{passage}\nOwn. {passage}"), (4, "Own. Own."), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("clash"))
    got = {r.doc_id: r for r in substring.remove_repeats(df, min_words=30).collect()}
    assert got[1].text == rows[1][1] and got[4].text == "Own. Own." and got[5].text is None
    assert passage not in got[2].text and passage not in got[3].text
    s = got[2].removed[0]
    assert rows[0][1][: s.start] + rows[0][1][s.end :] == got[2].text
    out = substring.remove_repeats(odd, min_words=5)
    assert out.count() == len(ODD) and out.columns == [*odd.columns, "removed"]
    assert substring.remove_repeats(none).count() == 0


def test_passages_of_short_lines(spark):
    lines = [f"Line {k} of the same passage ends in a full stop." for k in range(6)]
    passage = "\n".join(lines[:3]) + "\n\n \n" + "\n\n".join(lines[3:])
    rows = [(1, f"First.\n{passage}\n"), (2, f"Own head.\n{passage}\nOwn end."), (3, f"{lines[0]} Own.\n{lines[2]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # By lines of the text alone, none of which has 30 words.
    got = {r.doc_id: r for r in substring.remove_repeats(df, min_words=30).collect()}
    assert got[1].text == rows[0][1]
    assert got[2].text.split() == ["Own", "head.", "Own", "end."] and len(got[2].removed) == 1
    assert "Own." in got[3].text


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from(["line", "paragraph"]))
def test_units_by_brute_force(spark, seed, unit):
    rng, parted = random.Random(seed), "\n" if unit == "line" else "\n\n"
    line = lambda: rng.choice(["A b. c", "a  B. C ", "x", "ü 1", "", " \t", "d. e. f"])
    rows = [(rng.choice([None, 1, 2, 3]), parted.join(line() for _ in range(rng.randrange(6)))) for _ in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.remove_repeats(df, unit=unit).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    hashed = df.select("doc_id", "text", F.xxhash64("text").alias("h")).distinct().collect()
    seen, want = set(), {}
    for doc, text, _ in sorted(hashed, key=key):
        kept, pieces = "", [p + parted for p in text.split(parted)]
        pieces[-1] = pieces[-1][: -len(parted)]
        for piece in pieces:
            words = tuple(piece.lower().split())
            if not words or words not in seen:
                kept += piece
            seen.add(words)
        want[doc, text] = kept
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(repr((d, want[d, t])) for d, t in rows)


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 6, 10]))
def test_runs_by_brute_force(spark, seed, least):
    """Texts of one line that begins with a sentence of their own; runs of later sentences go."""
    rng = random.Random(seed)
    pool = [" ".join(f"w{k}{j}" for j in range(rng.randrange(1, 9))) + "." for k in range(6)]
    texts = {k: [f"Own{k}.", *(rng.choice([*pool, f"n{k}x{j} b."]) for j in range(rng.randrange(9)))] for k in range(7)}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.text.split() for r in substring.remove_repeats(df, min_words=least).collect()}
    seen = set()
    for k, parts in texts.items():
        kept, run = [], []
        for part in [*parts, None]:
            if part in seen:
                run.append(part)
                continue
            if sum(len(p.split()) for p in run) < least:
                kept += run
            run = []
            if part is not None:
                kept.append(part)
                seen.add(part)
        assert got[k] == " ".join(kept).split()


def test_passage_cut_within_sentences(spark):
    """Of a passage of over 50 words whose ends stand within other sentences, the inner sentence goes."""
    ends, inner = [" ".join(f"{c}{k}" for k in range(20)) for c in "ab"], " ".join(f"i{k}" for k in range(12)) + "."
    passage = f"{ends[0]}. {inner} {ends[1]}"
    df = spark.createDataFrame([(1, f"One {passage} one."), (2, f"Two {passage} two.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring.remove_repeats(df).collect()}
    assert got == {1: f"One {passage} one.", 2: f"Two {ends[0]}. {ends[1]} two."}


def test_clashing_names(spark):
    df = spark.createDataFrame(ODD, DOCS)
    for name in ("gone", "_gone", "doc", "row", "cut", "removed", "x", "y", "low", "line", "member", "hub", "key", "component_id"):
        df = df.withColumn(name, F.lit(name))
    assert near_dedup.drop_near_duplicates(df).columns == df.columns and near_dedup.drop_near_duplicates(df).count() == 9
    out = substring.remove_repeats(df, min_words=3)
    assert sorted(out.columns) == sorted(df.columns) and out.count() == len(ODD)
    assert {r.cut for r in out.select("cut").collect()} == {"cut"}


def test_repeated_lines(spark):
    line = "This work is free. Copy it ü."
    rows = [(1, f"One.\n{line}\nTwo."), (2, f"Three.\n{line}\n\nFour. {line}\nShort line\n"), (3, "short  LINE\nFive."), (4, f"Six.\n{line}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring.remove_repeats(df).collect()}
    # Whole lines go; within another line, a short sentence stays.
    assert got == {1: rows[0][1], 2: f"Three.\n\nFour. {line}\nShort line\n", 3: "Five.", 4: "Six.\n"}


# 10. Sharding ----------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.integers(1, 5))
def test_least_capacity(sizes, shards):
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)

    def fits(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards

    want = next(c for c in range(1, sum(sizes) + 1) if fits(c))
    assert sharding.least_capacity(prefix, shards, max(sizes)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=25), st.integers(1, 8), st.data())
def test_even_cuts(sizes, shards, data):
    prefix = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
    capacity = sharding.least_capacity(prefix, shards, max(max(sizes), -(-sum(sizes) // shards)))
    blocks, at = [], 0
    while at < len(sizes):
        part = sizes[at : at + data.draw(st.integers(1, 4))]
        blocks.append((at, sum(part), len(part), max(part)))
        at += len(part)
    while (found := sharding.even_cuts(blocks, capacity, shards))[1]:
        cut = [(p + k, sizes[p + k], 1, sizes[p + k]) for p, _, n, _ in (blocks[i] for i in found[1]) for k in range(n)]
        blocks = sorted([x for i, x in enumerate(blocks) if i not in found[1]] + cut)
    bounds = [0, *(blocks[k][0] for k in found[0]), len(sizes)]
    filled = [sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert max(filled) <= capacity and len(filled) == min(shards, len(sizes)) and min(filled) > 0


def test_shards(spark, odd, none, monkeypatch):
    monkeypatch.setattr(sharding, "FAN", 2)
    rng = random.Random(2)
    texts = ["x" * rng.randrange(200) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.minimax_shards(df, 4).collect()
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault(t, [k, 0])[1] += len(t) + 1
    prefix = [0]
    for _, size in sorted(groups.values()):
        prefix.append(prefix[-1] + size)
    want = sharding.least_capacity(prefix, 4, max(s for _, s in groups.values()))
    sums, slots, where = {}, {}, {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert max(sums.values()) == want and all(len(x) == 1 for x in where.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    rows = sharding.minimax_shards(odd, 8).collect()
    assert len(rows) == len(ODD) and {r.text_crc32 for r in rows if r.doc_id == 6} == {zlib.crc32(b"word")}
    assert sharding.minimax_shards(none).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scratch, known = Scratch(spark, "t"), docs
    for name, stage in pipeline.STAGES[:-1]:
        after = scratch.table(stage(spark, known, "/root/testdata/sf0.001"), name)
        assert after.columns == docs.columns and 0 < after.count() <= known.count()
        known = after
    rows = pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.select("doc_id").distinct().count() == known.count()
