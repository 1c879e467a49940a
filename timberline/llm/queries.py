"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import alignment, chat, decontamination, hard_negatives, language, licenses, mixing, neardup, neighbours, packing, quality, sharding, toxicity
from timberline.llm.tables import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", " AND ").alias("licenses"),
        "n_unmatched",
    )


#: Conversation -7 of the contract.
CONTROL_CONVERSATION = """
    SELECT * FROM VALUES
      (-7L, 0L, 'user', '</s>[INST] ok [/INST]'),
      (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)
"""


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL_CONVERSATION))
    out = chat.format_turns(chat.canonical_turns(chat.records_of_rows(rows)))
    read = out.select(
        "conv_id",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    _, scorer = quality.train(docs)
    return quality.score(docs, scorer, ["doc_id"]).withColumn("kept", F.col("score") >= quality.THRESHOLD)


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learnt from."""
    labels = table(spark, sf_dir, "labels", "doc_id", F.col("toxic").alias("label"))
    return labels.where(toxicity.remainder(F.col("doc_id"), 3) != 1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, toxic_labels(spark, sf_dir))
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id",
        (toxicity.remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    net = language.fit(docs.where(toxicity.remainder(F.col("doc_id"), 5) != 0).select("text", "lang"))
    out = language.identify(docs.select("doc_id", "text"), net, ["doc_id"])
    return out.select("doc_id", (toxicity.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents", "doc_id", "source"), "doc_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings", "vec_id", label, "embedding"), F.col("vec_id") % 50 == 0)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return alignment.align_documents(docs, files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_chat_format": op2_chat_format,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_id": op7_language_id,
    "op8_minhash_neardup": op8_minhash_neardup,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_mixing": op12_source_mixing,
    "op13_token_alignment": op13_token_alignment,
}


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    known = licenses.known_sentences()
    rows = ", ".join(f"({_sql_text(s)}, {_sql_text(i)})" for s, i in known.items())

    def normal(x: str) -> str:
        out = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
        for pattern, by in licenses.VARIABLE:
            out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
        return out

    text = "text"
    for pattern, by in licenses.ABBREVIATED:
        text = f"regexp_replace({text}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    ctes = [
        f"known(s, i) AS (VALUES {rows})",
        f"""blocks AS (SELECT rowid AS r, b.block, b.pos FROM docs,
            LATERAL (SELECT unnest(regexp_split_to_array({text}, '{licenses.SENTENCE_END}')) AS block,
                     unnest(range(len(regexp_split_to_array({text}, '{licenses.SENTENCE_END}')))) AS pos) b
            WHERE regexp_matches(lower(text), '{"|".join(licenses.ANCHORS)}'))""",
        f"whole AS (SELECT r, pos, 0 AS line, i FROM blocks JOIN known ON s = {normal('block')})",
        f"""lines AS (SELECT r, pos, line, i FROM (
              SELECT r, pos, unnest(string_split(block, chr(10))) AS t, unnest(range(len(string_split(block, chr(10))))) AS line
              FROM blocks ANTI JOIN whole USING (r, pos)) JOIN known ON s = {normal('t')})""",
        "found AS (SELECT r, string_agg(i, ',' ORDER BY pos, line) AS ids FROM (SELECT * FROM whole UNION ALL SELECT * FROM lines) GROUP BY r)",
        "step0 AS (SELECT r, ids, '<' || replace(ids, ',', '><') || '>' AS rest, CAST([] AS VARCHAR[]) AS names FROM found)",
    ]
    for n, (name, ids) in enumerate(licenses.RULES):
        mark = "".join(f"<{i}>" for i in ids)
        ctes.append(
            f"step{n + 1} AS (SELECT r, ids, replace(rest, '{mark}', '#') AS rest, "
            f"CASE WHEN contains(rest, '{mark}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM step{n})"
        )
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS rowid, doc_id, coalesce(text, '') AS text FROM documents), {", ".join(ctes)}
        SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(names, ' AND '), '') AS licenses,
               CAST(coalesce(length(rest) - length(replace(rest, '<', '')), 0) AS INTEGER) AS n_unmatched
        FROM docs LEFT JOIN step{len(licenses.RULES)} ON rowid = r
    """


def _chat_sql() -> str:
    pattern = chat.PATTERN
    return rf"""
        WITH rows_in AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        grouped AS (
          SELECT conv_id, count(*) AS n_turns,
            string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
            coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
            CAST(sum(length(regexp_replace(replace(replace(role, '\', '\s'), chr(10), '\n'), '{pattern}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '{pattern}', '\1\\\2\3', 'g')) + {len(chat.TURN) + len(chat.END) + 2}) AS BIGINT) AS formatted_chars
          FROM rows_in GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM grouped
    """


def _sharding_sql(n: int = sharding.SHARDS, size: int = sharding.TABLE_SIZE) -> str:
    digest = lambda x, at=1: f"CAST('0x' || substr(md5({x}), {at}, 15) AS BIGINT)"
    name = "'shard-' || CAST(i AS VARCHAR)"
    return f"""
        WITH RECURSIVE prefs AS (
          SELECT i, list(CAST((s + j * t) % {size} AS INTEGER) ORDER BY j) AS slots FROM (
            SELECT i, {digest(name)} % {size} AS s, {digest(name, 17)} % {size - 1} + 1 AS t FROM range({n}) r(i)), range({size}) q(j) GROUP BY i),
        fill(turn, shard, slot, taken) AS (
          SELECT 0, 0, slots[1], [slots[1]] FROM prefs WHERE i = 0
          UNION ALL
          SELECT turn + 1, CAST(i AS INTEGER), free, list_append(taken, free) FROM (
            SELECT turn, i, taken, list_extract(list_filter(slots, lambda x: NOT list_contains(taken, x)), 1) AS free
            FROM fill JOIN prefs ON i = (turn + 1) % {n} WHERE turn + 1 < {size}))
        SELECT doc_id, source, CAST(f.slot AS INTEGER) AS slot, CAST(f.shard AS INTEGER) AS shard
        FROM documents JOIN fill f ON f.slot = {digest("coalesce(CAST(doc_id AS VARCHAR), '')")} % {size}
    """


def _mixing_sql(block: int = mixing.BLOCK, most: int = mixing.MOST, seed: str = mixing.SEED) -> str:
    digest = lambda x: f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"
    steps = lambda j: f"(({j}) * quota + off) // greatest(n, 1)"
    weights = ", ".join(map(str, mixing.WEIGHTS))

    def seats(share: str, seats: str, parties: str, cap: str) -> str:
        x, slack = f"({share}) * CAST({seats} AS DOUBLE)", f"(({share}) * CAST({parties} AS DOUBLE) + 2.0)"
        return f"least(greatest(0, CAST(floor({x} - {slack}) AS BIGINT)), {cap}) AS low, least(CAST(ceil({x} + {slack}) AS BIGINT), {cap}) AS high"

    def upto(word: str) -> str:
        inside = f"greatest({word} - first * b, 0)"
        j = f"({inside} // b)"
        return f"({steps(j)} * b + ({inside} - {j} * b) * ({steps(j + ' + 1')} - {steps(j)}))"

    return f"""
        WITH words AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS BIGINT) AS size FROM documents),
        conf AS (
          SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total,
            greatest(1, least({block}, CAST(coalesce(sum(size), 0) AS BIGINT) // {mixing.LEAST_BLOCKS})) AS b,
            greatest({mixing.LEAST_SHARDS}, CAST(ceil(count(*) / {mixing.SHARD_ROWS}) AS BIGINT)) AS shards FROM words),
        docs AS (
          SELECT doc_id, source, size, place, place % shards AS shard FROM conf, (
            SELECT *, {digest(f"'{seed}/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || CAST(size AS VARCHAR)")} AS place FROM words)),
        caps AS (
          SELECT *, source_size * {most} AS cap, CAST(list_extract([{weights}], CAST(idx % {len(mixing.WEIGHTS)} AS INTEGER) + 1) AS BIGINT) AS weight FROM (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM docs GROUP BY source)),
        filling AS (
          SELECT *, (CAST(total AS DOUBLE) - CAST(caps_before AS DOUBLE)) * CAST(weight AS DOUBLE)
              > CAST(cap AS DOUBLE) * (CAST(all_weight AS DOUBLE) - CAST(weights_before AS DOUBLE)) AS full_up
          FROM conf, (SELECT *, sum(weight) OVER () AS all_weight,
              sum(cap) OVER o - cap AS caps_before, sum(weight) OVER o - weight AS weights_before
            FROM caps WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, idx ROWS UNBOUNDED PRECEDING))),
        level AS (
          SELECT CAST(any_value(total) - sum(CASE WHEN full_up THEN cap ELSE 0 END) AS DOUBLE)
            / CAST(sum(CASE WHEN full_up THEN 0 ELSE weight END) AS DOUBLE) AS level FROM filling),
        goals AS (
          SELECT source, source_size, idx, total, b, CAST(ceil(source_size / b) AS BIGINT) AS blocks,
            CASE WHEN full_up THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), level * weight) END AS target FROM filling, level),
        windows AS (
          SELECT *, {seats("target / wanted", "(total // b)", "parties", f"blocks * {most}")} FROM goals,
            (SELECT CASE WHEN sum(target) = 0 THEN 1.0 ELSE sum(target) END AS wanted, count(*) FILTER (WHERE target > 0) AS parties FROM goals)),
        extra AS (
          SELECT idx, count(*) AS more FROM (
            SELECT idx, row_number() OVER (ORDER BY target / CAST(2 * seat + 1 AS DOUBLE) DESC, idx) AS r
            FROM (SELECT idx, target, unnest(range(low, high)) AS seat FROM windows))
          WHERE r <= (SELECT any_value(total // b) - sum(low) FROM windows) GROUP BY idx),
        shares AS (SELECT source, source_size, idx, target, b, blocks, low + coalesce(more, 0) AS seats FROM windows LEFT JOIN extra USING (idx)),
        bases AS (
          SELECT *, CAST(ceil(base / b) AS BIGINT) AS first, CAST(ceil((base + size) / b) AS BIGINT) - CAST(ceil(base / b) AS BIGINT) AS n FROM (
            SELECT s.*, shard, size, CAST(sum(size) OVER (PARTITION BY idx ORDER BY shard) - size AS BIGINT) AS base FROM shares s JOIN (
              SELECT source, shard, CAST(sum(size) AS BIGINT) AS size FROM docs GROUP BY ALL) c ON s.source IS NOT DISTINCT FROM c.source)),
        cells AS (
          SELECT *, {seats("CASE WHEN blocks > 0 THEN CAST(n AS DOUBLE) / CAST(blocks AS DOUBLE) ELSE 0 END", "seats", "parties", f"n * {most}")}
          FROM (SELECT *, count(*) FILTER (WHERE n > 0) OVER (PARTITION BY idx) AS parties FROM bases)),
        cell_extra AS (
          SELECT idx, shard, count(*) AS more FROM (
            SELECT idx, shard, free, row_number() OVER (PARTITION BY idx ORDER BY CAST(n AS DOUBLE) / CAST(2 * seat + 1 AS DOUBLE) DESC, shard) AS r
            FROM (SELECT idx, shard, n, free, unnest(range(low, high)) AS seat FROM (SELECT *, seats - sum(low) OVER (PARTITION BY idx) AS free FROM cells)))
          WHERE r <= free GROUP BY ALL),
        quotas AS (
          SELECT *, CASE WHEN n > 0 THEN {digest(f"'{seed}/' || idx || '/' || shard")} % greatest(n, 1) ELSE 0 END AS off
          FROM (SELECT c.*, low + coalesce(more, 0) AS quota FROM cells c LEFT JOIN cell_extra USING (idx, shard))),
        carried AS (
          SELECT *, coalesce(last_value(CASE WHEN n > 0 THEN {steps("n")} - {steps("n - 1")} END IGNORE NULLS) OVER (
            PARTITION BY idx ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS carry FROM quotas),
        placed AS (
          SELECT d.doc_id, d.size, c.* EXCLUDE (size), c.base + d.before AS x, c.base + d.before + d.size AS y FROM (
            SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before FROM docs) d
          JOIN carried c ON d.source IS NOT DISTINCT FROM c.source AND d.shard = c.shard)
        SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0
            THEN {upto("y")} - {upto("x")} + (least(y, first * b) - least(x, first * b)) * carry ELSE 0 END AS BIGINT) AS taken
        FROM placed
    """


#: Every pair of an anchor and a row: for the sizes of tests only.
HARD_NEGATIVES_SQL = """
    WITH usable AS (
      SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (
      SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
      FROM usable a JOIN usable r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
      vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scores USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


ORACLE: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op2_chat_format": _chat_sql(),
    "op10_sharding": _sharding_sql(),
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
    "op12_source_mixing": _mixing_sql(),
}
