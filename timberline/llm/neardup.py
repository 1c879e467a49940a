"""Near-duplicate groups by an LSH forest of MinHash signatures.

Every tree of the forest orders the texts by a signature of its own.  Texts
whose signatures start alike form a region of the order; a region that is too
crowded is also cut again by a longer prefix, down to regions that are small.
Texts of one region are candidates of each other, in four steps: first each
with the region's first text; then, of those not yet known to be connected,
neighbours in the tree's order, which share the longest prefixes; then each of
those still not connected with all others of its small regions; and last, what
that left apart, with all others of its crowded regions.  So every pair with a
common prefix of the least length is compared or known to be connected.  Every
link is confirmed on the texts' full shingle sets.  Groups are the connected
components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.components import connected_components
from timberline.llm.shingles import mixed, shingle_set, words
from timberline.llm.tables import materialize

#: Orders of the forest and the prefix lengths at which regions may end.  Two
#: texts of similarity 0.75 share a prefix of 3 in one of 16 orders with
#: probability 0.9998.
TREES = 16
DEPTHS = (3, 4, 6, 8)
#: Texts up to which a region is compared before its texts are cut by a longer prefix.
CROWDED = 256
#: A link needs 100 * common >= 75 * all.
PERCENT = 75
#: Signature values of 128 (two bits of each) that must agree for a pair to be
#: read: a pair of similarity 0.75 has 104 on average, and fewer than this with
#: probability 0.0001, half of what the forest itself may miss.
AGREE = 88
#: Row numbers of so many documents are sent to all tasks at most; more are joined by shuffling.
BROADCAST_IDS = 200_000

_HASHES = TREES * max(DEPTHS)
_SEEDS = np.arange(1, 2 * _HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_A = (mixed(_SEEDS[:_HASHES]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mixed(_SEEDS[_HASHES:]) >> np.uint64(32)).astype(np.uint32)

_SIGNATURES = "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>, sketch array<long>"


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The signature of a shingle set: the least value of each hash function, uint32."""
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(_HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(small), 2048):
        np.minimum(out, (small[None, at : at + 2048] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def _keys(signatures: np.ndarray) -> np.ndarray:
    """(texts, TREES * len(DEPTHS)): a hash of each prefix of each tree's part."""
    parts = signatures.reshape(len(signatures), TREES, max(DEPTHS)).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), parts.shape[:2]).copy()
    out = []
    for k in range(max(DEPTHS)):
        total = mixed(total * np.uint64(0xA0761D6478BD642F) + parts[:, :, k] + np.uint64(k))
        if k + 1 in DEPTHS:
            out.append(total)
    return np.stack(out, axis=2).reshape(len(signatures), TREES * len(DEPTHS)).view(np.int64)


def _sketches(signatures: np.ndarray) -> np.ndarray:
    """(texts, 4): two bits of each signature value, the low ones in words 0-1, the others in 2-3."""
    bits = mixed(signatures.astype(np.uint64))
    planes = np.stack([bits & np.uint64(1), (bits >> np.uint64(1)) & np.uint64(1)], axis=1).astype(np.uint8)
    packed = np.packbits(planes.reshape(len(signatures), 2, 2, 64), axis=3, bitorder="little")
    return packed.reshape(len(signatures), 4, 8).view(np.int64)[:, :, 0]


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, fp1, fp2, keys, sketch`` of every row of ``docs(doc_id, text)``.

    ``fp1, fp2`` are a fingerprint of the whole shingle set: equal sets have
    equal ones.  Texts without words have null fingerprints and keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                rows, counts, prints, values = [], np.zeros(batch.num_rows, dtype=np.int64), [], []
                for row, each in words(batch.column(1)):
                    found = shingle_set(each)
                    rows.append(row)
                    counts[row] = len(found)
                    prints.append((mixed(found).sum(dtype=np.uint64), mixed(found + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                    values.append(minhash(found))
                known = np.zeros(batch.num_rows, dtype=bool)
                known[rows] = True
                place = np.cumsum(known) - 1
                take = pa.array(np.where(known, place, 0), mask=~known)
                sig = np.stack(values) if values else np.zeros((0, _HASHES), dtype=np.uint32)
                fp = np.array(prints, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                keys, sketch = _keys(sig), _sketches(sig)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (keys, sketch)]
                columns = [pa.array(fp[:, 0]), pa.array(fp[:, 1]), *lists]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), *[c.take(take) for c in columns]], ["doc_id", "n_shingles", "fp1", "fp2", "keys", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SIGNATURES)


def _agreement(a: str, b: str) -> Column:
    """Signature values that agree, of 128, from two sketches of four longs each."""
    differ = [f"bit_count(({a}{k} ^ {b}{k}) | ({a}{k + 2} ^ {b}{k + 2}))" for k in (0, 1)]
    return F.expr(f"{_HASHES} - {differ[0]} - {differ[1]}")


def regions(reps: DataFrame) -> DataFrame:
    """``region, n, id, s0..s3, deep, wide``: the regions of ``n`` texts, two or more, of all trees.

    ``deep`` holds the keys of longer prefixes; rows sorted by it stand in the
    tree's order within a region.  ``wide`` regions are the crowded ones of the
    shortest prefix; the texts of each stand in longer ones too, as far as
    these hold two.
    """
    levels = len(DEPTHS)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = reps.select("id", "keys", "sketch", tree).select(
        "id",
        *[F.col("keys")[F.col("tree") * levels + k].alias(f"k{k}") for k in range(levels)],
        *[F.col("sketch")[k].alias(f"s{k}") for k in range(4)],
    )
    done = []
    for k in range(levels):
        counts = rows.groupBy(f"k{k}").agg(F.count("*").alias("n")).where("n > 1")
        rows = materialize(rows.join(counts, f"k{k}"), f"regions-{k}")
        first, last = k == 0, k == levels - 1
        kept = rows if first or last else rows.where(F.col("n") <= CROWDED)
        wide = (F.col("n") > CROWDED) if first else F.lit(False)
        deep = F.array(*[F.col(f"k{j}") for j in range(k + 1, levels)]).cast("array<bigint>").alias("deep")
        done.append(kept.select(F.col(f"k{k}").alias("region"), "n", "id", "s0", "s1", "s2", "s3", deep, wide.alias("wide")))
        rows = rows.where(F.col("n") > CROWDED).drop("n")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` with (``left_semi``) or without (``left_anti``) the ``doc_id`` of ``ids``.

    Few ids, as counted, go to every task; more are shuffled.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are at least PERCENT alike."""
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "read")
    texts = materialize(by_ids(docs.select("doc_id", "text"), ids, "left_semi").distinct(), "texts")
    full = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    full = full.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [{row: shingle_set(each) for row, each in words(batch.column(c))} for c in (2, 3)]
                keep = []
                for row in sets[0].keys() & sets[1].keys():
                    x, y = sets[0][row], sets[1][row]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= PERCENT * (len(x) + len(y) - common):
                        keep.append(row)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(sorted(keep), pa.int64())) for c in batch.columns[:2]], ["a", "b"])

    return full.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs(doc_id, text)``.

    Rows that share a ``doc_id`` are one document.  A document without words is
    linked with nothing.  A null id is linked with nothing, has a null
    ``component_id`` and is kept.  Equal shingle sets are linked without
    reading them again; other links are confirmed on the full sets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(signatures(docs), "signatures")
    usable = signed.where(F.col("fp1").isNotNull() & F.col("doc_id").isNotNull())
    classes = usable.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("keys", "sketch"), "doc_id").alias("s"))
    classes = materialize(classes.select("fp1", "fp2", "id", "s.keys", "s.sketch"), "classes")
    region = materialize(regions(classes), "regions")

    # first step: each text of a region with the region's first text
    first = region.groupBy("region").agg(F.min(F.struct("id", "s0", "s1", "s2", "s3")).alias("f"))
    first = first.select("region", F.col("f.id").alias("a"), *[F.col(f"f.s{k}").alias(f"t{k}") for k in range(4)])
    stars = region.join(first, "region").where((F.col("id") != F.col("a")) & (_agreement("s", "t") >= AGREE))
    stars = materialize(stars.select("a", F.col("id").alias("b")).distinct(), "stars")
    # rows of one document whose texts differ are linked as they are
    same = usable.groupBy("doc_id", "fp1", "fp2").agg(F.lit(1).alias("one")).join(classes.select("fp1", "fp2", "id"), ["fp1", "fp2"]).where(F.col("doc_id") != F.col("id"))
    same = same.join(same.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "doc_id", "left_semi")
    links = materialize(confirmed(stars, docs).unionByName(same.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))), "confirmed")
    component = materialize(connected_components(links), "components")

    # the other steps: within regions, whatever is not connected yet
    small, wide = region.where(~F.col("wide")), region.where(F.col("wide"))
    for candidates, within in ((_in_order, region), (_linked_in_regions, small), (_linked_in_regions, wide)):
        labelled = within.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        more = materialize(candidates(_mixed(labelled), docs), "confirmed")
        if more.limit(1).count():
            links = links.unionByName(more)
            component = materialize(connected_components(links), "components")

    groups = classes.select("fp1", "fp2", "id").join(component.select(F.col("node").alias("id"), "component"), "id", "left")
    groups = groups.select("fp1", "fp2", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "fp1", "fp2").join(groups, ["fp1", "fp2"], "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


#: Texts of a block; a region's texts are compared block by block.
BLOCK = 512


def _parts() -> Column:
    """Blocks of a region; one, but for crowded regions."""
    return F.ceil(F.col("n") / BLOCK).cast("int")


def _part() -> Column:
    return F.pmod(F.xxhash64("id"), _parts()).cast("int")


def _mixed(labelled: DataFrame) -> DataFrame:
    """The rows of regions that hold more than one component ``c``."""
    several = labelled.groupBy("region").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("region")
    return materialize(labelled.join(several, "region"), "labelled")


def _in_order(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links ``a, b`` between neighbours in a region's order that lie in different components."""
    order = Window.partitionBy("region", "part").orderBy("deep", "id")
    names = ["id", "c", "s0", "s1", "s2", "s3"]
    before = rows.withColumn("part", _part()).select(*names, F.lag(F.struct(*names)).over(order).alias("p"))
    pairs = before.where("p is not null and p.c <> c").select("id", F.col("p.id").alias("other"), *[f"s{k}" for k in range(4)], *[F.col(f"p.s{k}").alias(f"t{k}") for k in range(4)])
    pairs = pairs.where(_agreement("s", "t") >= AGREE).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return confirmed(materialize(pairs, "pairs"), docs)


def _linked_in_regions(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links ``a, b`` that connect components of one region, of all its texts.

    A text takes part if its sketch is like that of a text of another component
    in the region; of two such texts, one is outside the region's largest
    component, so texts inside it are not compared with each other.  The texts that take part are compared in blocks, so a task
    holds two blocks whatever the region's size, and gives back only links that
    join components it has not joined yet: no pair of texts is ever a row.
    """
    largest = rows.groupBy("region", "c").agg(F.count("*").alias("m")).groupBy("region").agg(F.max_by("c", F.struct("m", "c")).alias("top"))
    rows = materialize(rows.join(largest, "region"), "ranked")

    def like(these: DataFrame, those: DataFrame) -> DataFrame:
        spread = F.explode(F.sequence(F.lit(0), _parts() - 1))
        left = these.select("region", "n", "id", "c", *[f"s{k}" for k in range(4)], spread.alias("part"))
        right = those.select("region", _part().alias("part"), F.col("c").alias("d"), *[F.col(f"s{k}").alias(f"t{k}") for k in range(4)])
        met = (left["region"] == right["region"]) & (left["part"] == right["part"]) & (F.col("c") != F.col("d")) & (_agreement("s", "t") >= AGREE)
        return materialize(left.join(right, met, "left_semi").drop("part").distinct(), "asked")

    outside = like(rows.where("c <> top"), rows)
    asked = outside.unionByName(like(rows.where("c = top"), outside)).select("region", "id", "c")
    ids = materialize(asked.select(F.col("id").alias("doc_id")).distinct(), "read")
    texts = by_ids(docs.select("doc_id", "text"), ids, "left_semi").distinct().select(F.col("doc_id").alias("id"), "text")

    sizes = asked.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = asked.join(sizes, "region").withColumn("own", F.pmod(F.xxhash64("id", "region"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = own.select("region", "id", "c", "own", other).select("region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "c")
    dealt = dealt.join(texts, "id").select("region", "i", "j", "id", "c", "text")
    dealt = dealt.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, labels, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            found = list(_joining(ids, labels, sets))
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            own_ids, own_labels = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for row, each in words(batch.column(5)):
                if keys[row] != key:
                    if len(ids) > 1:
                        yield links()
                    key, ids, labels, sets = keys[row], [], [], []
                ids.append(own_ids[row])
                labels.append(own_labels[row])
                sets.append(shingle_set(each))
        if len(ids) > 1:
            yield links()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _joining(ids: list[int], labels: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links between sets of different labels, each joining two labels not joined before."""
    root = {c: c for c in labels}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    sizes = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    for i, own in enumerate(sets):
        lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(100 * common >= PERCENT * (sizes[i] + sizes - common)):
            if j < i and find(labels[i]) != find(labels[j]):
                root[find(labels[i])] = find(labels[j])
                yield ids[i], ids[j]
