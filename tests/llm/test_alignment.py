"""Token alignment against whole-text tokenization and plain overlap search."""

import collections
import hashlib

import public_tokenizers as files
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.llm import alignment

A, B = files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def plain_groups(tokenizers, text):
    """Groups as pairs of id lists, from the definition: cut where both lists end."""
    a, b = tokenizers
    signs = alignment.byte_signs()
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return []
    ends = []
    for parts in (bytes_a, bytes_b):
        at, here = 0, []
        for p in parts:
            at += len(p)
            here.append(at)
        ends.append(here)
    out, lo_a, lo_b = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        hi_a, hi_b = ends[0].index(end) + 1, ends[1].index(end) + 1
        out.append((ids_a[lo_a:hi_a], ids_b[lo_b:hi_b]))
        lo_a, lo_b = hi_a, hi_b
    return out


def plain(tokenizers, rows):
    groups = [plain_groups(tokenizers, t) for _, t in rows]
    links = [collections.Counter((x, y) for g in gs for x in g[0] for y in g[1]) for gs in groups]
    count = collections.Counter(p for each in links for p in each)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (doc, _), gs, each in zip(rows, groups, links, strict=True):
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in gs)
        out.append(
            (
                doc,
                sum(len(x) for x, _ in gs),
                sum(len(y) for _, y in gs),
                len(gs),
                sum(each.values()),
                sum(n for p, n in each.items() if count[p] == best[p[0]]),
                sum(n * count[p] for p, n in each.items()),
                hashlib.sha256(written.encode()).hexdigest() if gs else "",
            )
        )
    return out


def order(rows):
    return sorted(map(str, rows))


ODD = [
    "", None, " ", "  ", "a", " a", "a ", "  a  b ", "a \n b\n\n c", "\t x", "don't  we'll", "<|endoftext|> <s> </s> <0x0A>", "▁x y", "x ▁", "naïve café", "ﬁne",
    "日本語のテキスト", "👍🏽 👩‍👩‍👧", "a b   c", "a\x1c b", "x" * 3000, "=" * 777 + " " + "-" * 63, "a\x00b", "1234567 89", "é́ 　", "hello hello hello",
]


def test_odd_texts_repeats_nulls_and_other_columns(spark, tokenizers):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "hello there"), (3, "hello there"), (3, "hello there")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs = docs.select("*", F.lit(1).alias("n_a"), F.lit("x").alias("slice"), F.lit(2).alias("codes"))
    got = alignment.align_documents(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert order(map(tuple, got.collect())) == order(plain(tokenizers, rows))


def test_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_documents_over_several_slices(spark, tokenizers, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = order(plain(tokenizers, rows))
    assert order(map(tuple, alignment.align_documents(docs, A, B).collect())) == want
    # every document in a slice of its own: slices are cut in workers, which read the module's bound
    aligned = alignment.align_documents(docs.repartition(40, "doc_id"), A, B)
    assert order(map(tuple, aligned.collect())) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab'1 \n\t é▁.日", max_size=24).filter(bool), min_size=1, max_size=6))
def test_pieces_give_the_tokens_of_whole_texts(tokenizers, aligner, texts):
    for _ in range(2):  # the second time from what is kept
        numbers, digests, owner, codes, weights = aligner.align(texts)
        for k, text in enumerate(texts):
            gs = plain_groups(tokenizers, text)
            pairs = collections.Counter((x, y) for g in gs for x in g[0] for y in g[1])
            assert numbers[k].tolist() == [sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), sum(pairs.values())]
            here = owner == k
            found = {divmod(int(c), 32000): int(w) for c, w in zip(codes[here], weights[here], strict=True)}
            assert found == pairs
            assert (digests[k] == "") == (not gs)


def test_wide_groups_count_distinct_ids():
    """One token of A over many of B, and many of A under one of B, each id often."""
    import numpy as np

    vocabulary = alignment.Vocabulary([b"a", b"b" * 1000], [b"a" * 1000, b"b"])
    ids_a, ids_b = np.array([0] * 1000 + [1]), np.array([0] + [1] * 1000)
    narrow = alignment.Links(ids_a, ids_b, np.array([1000, 2000]), vocabulary)
    wide_before = alignment.WIDE
    alignment.WIDE = 10
    try:
        wide = alignment.Links(ids_a, ids_b, np.array([1000, 2000]), vocabulary)
    finally:
        alignment.WIDE = wide_before
    assert narrow.n_links.tolist() == wide.n_links.tolist() == [1000, 1000]
    for x in (narrow, wide):
        assert x.codes.tolist() == [0, 3] and x.weights.tolist() == [1000, 1000] and x.sizes.tolist() == [1, 1]
        assert x.written[1] == "1|" + ",".join(["1"] * 1000) + ";"


def test_pieces_beyond_what_is_kept(tokenizers, monkeypatch):
    """Nothing depends on which pieces are kept."""
    monkeypatch.setattr(alignment, "CACHED_PIECES", 3)
    own = alignment.Aligner(A, B)
    texts = ["one two three four five", "six one \n seven", "eight nine ten one", "▁ one", "one " * 50 + "y" * 100]
    for _ in range(3):
        for text in texts:
            numbers, digests, _, codes, weights = own.align([text])
            gs = plain_groups(tokenizers, text)
            pairs = collections.Counter((x, y) for g in gs for x in g[0] for y in g[1])
            assert numbers[0].tolist()[2:] == [len(gs), sum(pairs.values())] and (digests[0] == "") == (not gs)
            assert {divmod(int(c), 32000): int(w) for c, w in zip(codes, weights, strict=True)} == pairs


def test_weights_beyond_32_bits_are_dealt_to_several_entries():
    import numpy as np

    owner, codes, weights = alignment._narrow(np.array([0, 1, 1]), np.array([5, 6, 7]), np.array([1, (1 << 33) + 9, 3]))
    assert weights.max() < 1 << 31 and weights[codes == 6].sum() == (1 << 33) + 9 and set(owner[codes == 6]) == {1}
    assert weights[codes != 6].tolist() == [1, 3]
