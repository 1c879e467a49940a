"""Packing, near-duplicate groups, components and the pipeline."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.llm import neardup, packing
from timberline.llm.components import connected_components
from timberline.llm.queries import tokenizer_file

# --- packing ---


def best_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins[bins.index(min(fits))] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=200))))
def test_the_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    histogram = collections.Counter(lengths)
    place, used = {}, collections.defaultdict(list)
    for length, first, n, per_bin, first_bin, offset in packing.plan_best_fit(histogram, capacity):
        for k in range(n):
            assert (length, first + k) not in place
            place[length, first + k] = True
            used[first_bin + k // per_bin].append((offset + k % per_bin * length, length))
    assert set(place) == {(n, k) for n, c in histogram.items() for k in range(c)}
    left = []
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        left.append(capacity - at)
    assert sorted(left) == best_fit_decreasing(lengths, capacity)


def test_capacity_tree_finds_the_tightest():
    tree = packing.CapacityTree(100)
    rng = random.Random(1)
    held = set()
    for _ in range(2000):
        c = rng.randint(0, 100)
        tree.set(c, c not in held)
        held ^= {c}
        n = rng.randint(0, 100)
        assert tree.tightest(n) == min((x for x in held if x >= n), default=None)


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD_TEXTS = ["a </s> <|endoftext|> b", "x<|startoftext|><|endoftext|>\ty", "<|EndOfText|> <| endoftext |>", "", "plain words, and more!", "İstanbul ΑΣ’s don't 12 <|endoftext|>x", "a\x1cb c", "日本語 text   é 'stuff's", "''s 'll&'s  \t\n\r x", "été ﬁn", "x" * 5000, "\n\n \n"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_ids_equal_the_tokenizers(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ODD_TEXTS
    own = packing.WordTokenizer(tokenizer_file()).ids(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in own] == reference_ids(texts)


def test_special_tokens_inside_long_texts(spark):
    text = "some words <|endoftext|> and more<|startoftext|>x " * 40_000
    (ids,) = reference_ids([text])
    ids = [*ids, packing.END_ID]
    got = packing.tokenized_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer_file()).orderBy("piece").collect()
    want = [ids[at : at + 4096] for at in range(0, len(ids), 4096)]
    assert [(r["length"], r["ids_crc32"]) for r in got] == [(len(w), zlib.crc32(np.array(w, dtype="<u4").tobytes())) for w in want]


def test_text_parts_join_to_the_text():
    text = " ".join(str(i) for i in range(3000))
    assert "".join(packing.text_parts(text, 100)) == text
    assert list(packing.text_parts("x" * 500, 100)) == ["x" * 500]


def test_packed_pieces(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma,"]) for _ in range(n)) for n in [0, 1, 50, 5000, 9000, 300, 300, 300]]
    rows = [*enumerate(texts), (None, "no id"), (7, texts[7]), (50, None), *((100 + i, t) for i, t in enumerate(ODD_TEXTS))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = packing.pack_documents(df, tokenizer_file()).toPandas()
    want = collections.Counter()
    for (doc_id, text), ids in zip(rows, reference_ids([t or "" for _, t in rows]), strict=True):
        ids = [*ids, packing.END_ID]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[doc_id, piece, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    have = collections.Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert have == want
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == [0, *np.cumsum(one.length)[:-1]] and one.length.sum() <= 4096
    assert got.sequence_id.nunique() == len(best_fit_decreasing(got.length.tolist(), 4096))
    assert packing.pack_documents(df.limit(0), tokenizer_file()).count() == 0


# --- near duplicates ---


def shingle_sets(rows):
    out = {}
    for d, t in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def groups(rows):
    sets = shingle_sets(rows)
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def near_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 80, 200]))]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy) if family % 2 else "\t".join(copy).upper())
    rows += [" ".join([rng.choice(vocabulary) for _ in range(40)] + passage) for _ in range(40)]
    rows += ["", "  \n", None, "one", "ONE", "two words", "É é", "é É"]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_groups_against_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).repartition(5)
    want, sizes = groups(rows)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert {d: r["n_shingles"] for d, r in got.items()} == sizes
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_crowded_regions_are_cut_and_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWDED", 4)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 5)
    rows = near_rows()
    want, _ = groups(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_a_family_of_thousands_that_is_alike_to_its_base_only(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for d in range(1, 2001):  # about 0.757 alike to the base, 0.6 to each other
        copy = list(base)
        for at in rng.sample(range(0, 400, 5), 11):
            copy[at] = f"x{d}-{at}"
        rows.append((d, " ".join(copy)))
    want, _ = groups(rows[:40])
    assert set(want.values()) == {0}
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).groupBy("component_id").count().collect()
    assert [tuple(r) for r in got] == [(0, 2001)]


def test_crowded_regions_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWDED", 1)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng, rows = random.Random(11), []
    for _ in range(100):
        text = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        changed = list(text)
        changed[0], changed[30] = "other", "another"
        rows += [" ".join(text), " ".join(changed)]
    rows = list(enumerate(rows))
    want, _ = groups(rows)
    assert len(set(want.values())) == 100
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, None), (3, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["component_id"], r["kept"], r["n_shingles"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(-1, None, True, 0), (-1, None, True, 2), (1, 1, True, 2), (1, 1, True, 2), (2, 2, True, 0), (3, 3, True, 26)], key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "p q r s t u v"), (3, "a b c d e f g")]
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(500, i) for i in range(501, 560)]
    links = chain + star + [(7, 7), (None, 3), (8, 9), (9, 8)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 500 for i in range(500, 560)}, 8: 8, 9: 8}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- the pipeline ---


def test_stages_keep_clean_documents_and_their_columns(spark):
    import corpus_pipeline
    from timberline.llm.tables import materialize, table

    data = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "minhash_neardup", "benchmark_decontamination", "best_fit_packing"]
    docs = table(spark, data, "documents").withColumn("score", F.lit("mine"))
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = materialize(stage(spark, docs, data), name)
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and left <= set(given)
        if name == "minhash_neardup":
            want, _ = groups(given.items())
            assert left == {d for d, c in want.items() if c == d}
    assert docs.where("score = 'mine'").count() == docs.count() > 0.5 * before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_empty_and_odd_documents(spark, empty):
    import corpus_pipeline

    rows = [] if empty else [(1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").collect(), docs.schema)
    assert docs.count() == len(rows)
