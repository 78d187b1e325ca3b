"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_ann(spark, sf_dir):
    from pyspark.sql import functions as F

    from rankjobs.llm import ann

    return ann.search(ann.index(table(spark, sf_dir, "embeddings")), F.pmod("vec_id", F.lit(50)) == 0, k=5)


def op9_jaccard(spark, sf_dir):
    from rankjobs.llm import jaccard

    found = jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", "n_links", "kept")


def op10_mixing(spark, sf_dir):
    from rankjobs.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS mix_key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
    CAST(sum(source_size) OVER () AS BIGINT) AS total FROM totals),
filled AS (  -- capped sources come first by size over weight; k of them are capped
  SELECT *, row_number() OVER o AS k, CAST(sum(3 * source_size) OVER o AS BIGINT) AS capped,
    sum(w) OVER () - sum(w) OVER o AS free FROM weighted WINDOW o AS (ORDER BY source_size / w, source IS NULL, source)),
level AS (
  SELECT CAST(total - below AS DOUBLE) AS rest, CAST(weight AS DOUBLE) AS weight FROM (
    SELECT total, capped - 3 * source_size AS below, free + w AS weight, source_size, w, k FROM filled)
  WHERE (w * CAST(total - below AS DOUBLE)) / weight <= 3 * source_size ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least((w * rest) / weight, 3.0::DOUBLE * source_size) END AS target
  FROM weighted CROSS JOIN level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM targets),
sums AS (
  SELECT p.source, p.target - p.passes * p.source_size AS budget, mix_key, sum(size) AS g,
    sum(sum(size)) OVER (PARTITION BY p.source ORDER BY mix_key) AS upto
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source WHERE p.source_size > 0
  GROUP BY p.source, p.target, p.passes, p.source_size, mix_key),
taken AS (
  SELECT source, mix_key FROM sums
  WHERE upto <= budget OR (upto - g <= budget AND upto - budget < budget - (upto - g)))
SELECT s.doc_id, s.source, s.mix_key, s.size, p.source_size, p.target,
  CAST(p.passes AS INTEGER) + CASE WHEN t.mix_key IS NULL THEN 0 ELSE 1 END AS copies,
  s.size * (CAST(p.passes AS INTEGER) + CASE WHEN t.mix_key IS NULL THEN 0 ELSE 1 END) AS taken
FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
LEFT JOIN taken t ON t.source IS NOT DISTINCT FROM s.source AND t.mix_key = s.mix_key
"""

def op1_pii(spark, sf_dir):
    from pyspark.sql import functions as F

    from rankjobs.llm import pii

    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE_KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(count(k) for k in pii.BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op2_secrets(spark, sf_dir):
    from pyspark.sql import functions as F

    from rankjobs.llm import secrets

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets.scan(docs, secrets.fit(docs))
    spans = F.transform("secrets", lambda x: F.concat_ws(":", x["start"], x["end"]))
    top = F.array_max(F.transform("secrets", lambda x: x["score"]))
    return found.select(
        "doc_id", F.size("secrets").cast("bigint").alias("n_secrets"), F.array_join(spans, ",").alias("spans"), top.alias("top_score")
    )


def op3_exact_dedup(spark, sf_dir):
    from rankjobs.llm import exact_dedup

    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM normal WINDOW w AS (PARTITION BY t)
"""


def op4_toxicity(spark, sf_dir):
    from pyspark.sql import functions as F

    from rankjobs.llm import toxicity
    from rankjobs.llm.labels import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    detector = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, detector).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_quality(spark, sf_dir):
    from pyspark.sql import functions as F

    from rankjobs.llm import quality
    from rankjobs.llm.labels import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_sentencepiece(spark, sf_dir):
    from pyspark.sql import functions as F

    from rankjobs.llm import sentencepiece_fst

    model = sentencepiece_fst.read_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_fst.encode_and_decode(docs, model)
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(sentencepiece_fst.MARK), F.lit(" "))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", (F.col("decoded") == plain).alias("round_trip"))


def op7_sharding(spark, sf_dir):
    from pyspark.sql import functions as F

    from rankjobs.llm import sharding

    shards = sharding.kd_shards(table(spark, sf_dir, "documents"), 24)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_whitening(spark, sf_dir):
    from rankjobs.llm import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_divergence(spark, sf_dir):
    from rankjobs.llm import divergence

    return divergence.divergences(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents),
words AS (
  SELECT doc, lang, source,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, s.v,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS n_group,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS n_lang,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS n_all
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, n,
    CAST(1 + (1000000000::HUGEINT * (n + 2)) // (n_group + 2 * v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (n_lang + 2)) // (n_all + 2 * v) AS BIGINT) AS q
  FROM grid),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
scored AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM scored)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op13_perplexity(spark, sf_dir):
    from rankjobs.llm import perplexity

    rules = perplexity.quality_rules(table(spark, sf_dir, "documents"))
    return rules.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity"
    )


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_pii": (op1_pii, None),
    "op2_secrets": (op2_secrets, None),
    "op3_exact_dedup": (op3_exact_dedup, OP3_SQL),
    "op4_toxicity": (op4_toxicity, None),
    "op5_quality": (op5_quality, None),
    "op6_sentencepiece": (op6_sentencepiece, None),
    "op7_sharding": (op7_sharding, None),
    "op8_ann": (op8_ann, None),
    "op9_jaccard": (op9_jaccard, None),
    "op10_mixing": (op10_mixing, OP10_SQL),
    "op11_whitening": (op11_whitening, None),
    "op12_divergence": (op12_divergence, OP12_SQL),
    "op13_perplexity": (op13_perplexity, None),
}
