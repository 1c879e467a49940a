"""Quality, toxicity, language and nearest neighbours: held-out accuracy, recall and edge cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timberline.llm import grams, language, neighbours, quality, toxicity

DATA = "/root/testdata/sf0.01"
ODD = [(None, "x"), (1, None), (2, ""), (3, "   \n"), (4, "!!!"), (5, "word " * 200_000), (6, "same"), (6, "same")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash"))


def test_parts_of_long_texts_hold_every_ngram():
    column = pa.array(["abcdefghij" * 5, None, "", "xyz"])
    for size in (12, 1 << 20):
        found = set()
        for rows, starts, stops, data in grams.chunks(column, 3, size):
            owner = grams.owners(starts, stops, 4, len(data) - 3)
            found |= {(int(rows[o]), bytes(data[i : i + 4])) for i, o in enumerate(owner) if o >= 0 and b" " not in bytes(data[i : i + 4])}
        assert found == {(0, ("abcdefghij" * 5).encode()[i : i + 4]) for i in range(47)}


def test_lower_case_of_latin_letters():
    text = "AZaz ÀÉÜ×ß Ø"
    assert bytes(grams.lower(np.frombuffer(text.encode(), dtype=np.uint8))).decode() == text.lower()


def test_estimated_accuracies_of_known_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    accuracy = [0.95, 0.9, 0.8, 0.7, 0.9]
    votes = np.stack([np.where(rng.random(len(truth)) < a, truth, ~truth).astype(int) for a in accuracy], axis=1)
    votes[rng.random(votes.shape) < 0.2] = quality.NOTHING
    pattern, count = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(pattern, count.astype(float))
    assert np.allclose(model.accuracy(), accuracy, atol=0.03) and abs(model.prior - 0.8) < 0.03


def test_quality_agrees_with_labels_it_never_saw(docs, labels):
    _, scorer = quality.train(docs)
    got = quality.score(docs, scorer, ["doc_id"]).join(labels, "doc_id").select("quality", (F.col("score") >= quality.THRESHOLD).alias("kept")).toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.kept.mean() > 0.98 and (~bad.kept).mean() > 0.7


def test_quality_of_odd_rows_and_empty_tables(docs, odd):
    _, scorer = quality.train(odd)
    out = quality.score(odd, scorer)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == len(ODD)
    assert out.where("score between 0 and 1").count() == len(ODD)
    labels, scorer = quality.train(odd.limit(0))
    assert labels.prior == 0.5 and quality.score(odd, scorer).where("score = 0.5").count() == len(ODD)


def test_toxicity_on_held_out_rows(docs, labels):
    own = labels.select("doc_id", F.col("toxic").alias("label"))
    held = toxicity.remainder(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, own.where(~held))
    got = toxicity.score(docs, model, ["doc_id"]).join(own.where(held), "doc_id").toPandas()
    said = got.score >= toxicity.THRESHOLD
    assert (said & (got.label == 0)).sum() <= 1
    assert said[got.label == 1].mean() > 0.6  # about twenty toxic texts to learn from


MIX, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def plain_bucket(gram: bytes, bits: int) -> int:
    """The bucket of an n-gram, number by number."""
    key = (int.from_bytes(gram, "little") + len(gram)) & MASK
    key = key * MIX & MASK
    key = (key ^ (key >> 29)) * MIX & MASK
    return key >> (64 - bits)


def plain_lower(text: str, letters: bool) -> bytes:
    out = bytearray()
    for b in text.encode():
        small = b + 32 if 65 <= b <= 90 else b
        white = b in (9, 10, 11, 12, 13) or letters and b < 128 and not 97 <= small <= 122
        after = bool(out) and out[-1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97
        out.append(32 if white else small | 0x20 if after else small)
    return bytes(out)


TEXTS = ["", None, "a", "Some WORDS, and Ärger über ÉTÉ!", "x" * 700, "tiny\ttext\nof lines " * 40, "ab cd", "été\x0bß ×"]


def test_quality_scores_against_a_plain_computation(spark):
    rng = np.random.default_rng(4)
    scorer = quality.Scorer(rng.normal(size=1 << quality.BITS), 0.3)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(df, scorer, ["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        data = b" " + (t or "").encode() + b" "
        each = [scorer.weights[plain_bucket(data[k : k + 3], quality.BITS)] for k in range(len(data) - 2)]
        z = sum(each) / max(len(each), 1) + scorer.bias
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), rel=1e-9)


def test_toxicity_scores_against_a_plain_computation(spark):
    rng = np.random.default_rng(5)
    held = {}
    for i, t in enumerate(TEXTS):
        data = b" " + plain_lower(t or "", True) + b" "
        held[i] = {plain_bucket(data[k : k + n], toxicity.BITS) for n in toxicity.ORDERS for k in range(len(data) - n + 1)}
    buckets = np.array(sorted(set().union(*held.values()))[::2], dtype=np.int64)
    model = toxicity.Model(buckets, rng.normal(size=len(buckets)) / 10, -0.2)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model, ["doc_id"]).collect()}
    weight = dict(zip(buckets.tolist(), model.weights, strict=True))
    for i in held:
        z = sum(weight.get(b, 0.0) for b in held[i]) + model.bias
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)


def test_toxic_texts_with_a_known_sign_are_caught(docs, labels):
    """Some labelled texts hold no sign that any clean text lacks; of the others none may pass."""
    signs = "trash pathetic idiot worthless disgusting stupid clown scum loser moron".split()
    own = labels.select("doc_id", F.col("toxic").alias("label"))
    held = toxicity.remainder(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, own.where(~held))
    clear = F.lit(False)
    for w in signs:
        clear = clear | F.lower("text").contains(w)
    scored = toxicity.score(docs.withColumn("clear", clear), model, ["doc_id", "clear"]).join(own.where(held), "doc_id").toPandas()
    caught = scored[(scored.label == 1) & scored.clear].score >= toxicity.THRESHOLD
    assert len(caught) and caught.mean() >= 0.9


def test_window_chances_against_a_plain_network():
    rng = np.random.default_rng(6)
    net = language.train_network(rng.integers(0, 27, (80, language.WINDOW)), rng.integers(0, 3, 80), ["a", "b", "c"], epochs=1)
    kinds = rng.integers(0, language.KINDS, (5, language.WINDOW))
    got = language.log_chances(net, language._pair_tables(net), kinds)
    for row, answer in zip(kinds, got, strict=True):
        pooled = []
        for width, filters, bias in zip(language.WIDTHS, net.filters, net.biases, strict=True):
            every = [np.concatenate([net.embedding[k] for k in row[at : at + width]]) @ filters for at in range(language.WINDOW - width + 1)]
            pooled.append(np.maximum(np.max(every, axis=0) + bias, 0))
        z = np.concatenate(pooled) @ net.out + net.out_bias
        assert np.allclose(answer, z - np.log(np.exp(z - z.max()).sum()) - z.max(), atol=1e-4)


def test_toxicity_without_two_classes_and_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 0), (6, 0), (6, None), (None, 1)], "doc_id long, label int")
    model = toxicity.fit(odd, labels)
    out = toxicity.score(odd, model)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == len(ODD)
    assert out.where("score >= 0.7").count() == 0
    both = toxicity.fit(odd, spark.createDataFrame([(5, 0), (6, 1)], "doc_id long, label int"))
    assert toxicity.score(odd, both).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.score(odd.limit(0), both).count() == 0


def test_language_on_held_out_rows(docs):
    held = toxicity.remainder(F.col("doc_id"), 5) == 0
    net = language.fit(docs.where(~held).select("text", "lang"))
    got = language.identify(docs.where(held), net, ["doc_id", "lang"]).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    again = language.fit(docs.where(~held).select("text", "lang").repartition(7))
    assert np.array_equal(net.out, again.out)  # the same network however the table is dealt


def test_language_of_odd_rows(spark, odd):
    net = language.fit(spark.createDataFrame([("aaa bbb", "x"), ("ccc ddd", "y"), (None, "x"), ("eee", None), ("1 2", "z")], "text string, lang string"))
    assert net.languages == ["x", "y"]
    out = language.identify(odd.drop("score"), net)
    got = {r["doc_id"]: r["lang_pred"] for r in out.collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == ["und"] * 4 and got[5] in ("x", "y")
    assert out.count() == len(ODD)
    none = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert none is None and language.identify(odd, none).where("lang_pred = 'und'").count() == len(ODD)


def test_windows_cover_every_byte():
    text = "".join(chr(97 + i % 26) for i in range(5000))
    for size in (600, 1 << 20):
        grams_seen = set()
        for _, kinds in language.windows(pa.array([text]), size):
            for w in kinds:
                grams_seen |= {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
        want = [ord(c) - 96 for c in text]
        assert {tuple(want[i : i + 4]) for i in range(len(want) - 3)} <= grams_seen


def test_the_network_learns_by_the_right_gradient():
    rng = np.random.default_rng(0)
    kinds = rng.integers(1, 27, (200, language.WINDOW))
    labels = rng.integers(0, 2, 200)
    kinds[labels == 1, 50:53] = [3, 1, 20]
    net = language.train_network(kinds, labels, ["a", "b"], epochs=30)
    said = language.log_chances(net, language._pair_tables(net), kinds).argmax(axis=1)
    assert (said == labels).mean() > 0.95


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_recall_against_brute_force(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = df.toPandas()
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), dtype=float)
    got = neighbours.search(df, df.where(F.col("vec_id") % 20 == 0)).toPandas()
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    hits = sum(len(set(g.vec_id) & {v for v, _ in want[q]}) for q, g in got.groupby("query_id"))
    assert hits / sum(map(len, want.values())) > 0.9


def test_graph_recall_with_unequal_lengths():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.2, 2, (3000, 1))
    lift = np.sqrt((x**2).sum(axis=1).max() - (x**2).sum(axis=1))
    graph = neighbours.Graph(np.column_stack((x, lift)))
    q = x[:100]
    found, _ = graph.search(np.column_stack((q, np.zeros(100))).astype(np.float32), neighbours.SEARCH_BEAM)
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(best, found, strict=True)]) > 0.9
    assert (graph.edges >= 0).sum(axis=1).max() <= neighbours.DEGREE


def test_odd_vectors_ties_and_few_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [nan, 1.0]), (6, [0.0, 0.0]), (7, [1.0, None]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = neighbours.search(df, df.where(F.col("vec_id") % 20 == 0), 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5), (20, 1, 3, 0.5), (20, 2, 0, 0.0), (20, 3, 1, 0.0)]
    assert neighbours.search(df.limit(0), df, 3).count() == 0
    again = spark.createDataFrame([(20, [1.0, 0.0])] * 30 + [(i, [1.0, 0.0]) for i in range(1, 6)] + [(1, [1.0, 0.0])] * 4, "vec_id long, embedding array<double>")
    got = neighbours.search(again, again.where("vec_id = 20").limit(1), 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0)] * 3
    large = spark.createDataFrame([(0, [1e150, 1e150]), (1, [1e149, 0.0]), (2, [-1e150, 1.0]), (3, [1e-200, 1e-200])], "vec_id long, embedding array<double>")
    got = neighbours.search(large, large.where("vec_id = 0"), 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 3, 2] and got[0]["score"] == pytest.approx(1e299)
    many = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    got = neighbours.search(many, many.where("vec_id % 20 = 0"), 20).where("query_id = 20").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [*range(20)]


def test_equal_vectors_tie_whatever_their_place(spark):
    """Nineteen equal vectors of random components have one score and come by id; so do nine rows of ten of a table."""
    rng = np.random.default_rng(12)
    for width, copies in ((48, 19), (96, 14)):
        one = rng.normal(size=width).tolist()
        rows = [(k, one) for k in range(1, copies + 1)] + [(20, rng.normal(size=width).tolist())] + [(100 + k, rng.normal(size=width).tolist()) for k in range(30)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = neighbours.search(df, df.where("vec_id = 20"), 60).orderBy("rank").collect()
        same = [r for r in got if r["vec_id"] <= copies]
        assert [r["vec_id"] for r in same] == list(range(1, copies + 1)) and len({r["score"] for r in same}) == 1
        assert [r["rank"] for r in same] == list(range(same[0]["rank"], same[0]["rank"] + copies))
    hot = spark.range(900).select(F.col("id").alias("vec_id"), F.array(*[F.lit(float(v)) for v in one]).alias("embedding"))
    hot = hot.unionByName(spark.createDataFrame([(1000 + k, rng.normal(size=96).tolist()) for k in range(100)], hot.schema))
    got = neighbours.search(hot, hot.where("vec_id = 40"), 20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(20))


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_SIZE", 500)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = neighbours.search(df, df.where("vec_id % 60 = 0")).toPandas()
    scores = x[::60] @ x.T
    scores[np.arange(50), np.arange(0, 3000, 60)] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    hits = sum(len(set(best[q // 60]) & set(g["vec_id"])) for q, g in found.groupby("query_id"))
    assert hits / (50 * 20) >= 0.95
