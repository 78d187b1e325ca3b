"""The given tables read as bugs, test cases and links, for Spark and for SQL.

- bug: a document with its order. The first line is the title, the rest of the text
  the description, so that the two hold the whole text.
- test case: a part. Its id starts at 10^9, which keeps the two id ranges apart.
- raw link: a line item, written from order to part on odd lines and the other way
  round on even ones. Orders without a document dangle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankjobs.functions import text as tx
from rankjobs.operators import bm25, embed, links
from rankjobs.plans import recommend as rec
from rankjobs.sources.artifacts import stage

TESTCASE_BASE = 1_000_000_000
VECTOR_DIM = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a table of fewer splits than cores to all cores; a larger table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    lines = F.split("text", "\n", 2)
    missing = F.lit(None).cast("string")
    return (
        documents(spark, sf_dir)
        .join(orders, F.col("doc_id") == F.col("o_orderkey"))
        .select(
            F.col("doc_id").alias("bug_id"),
            F.nullif(tx.strip(lines[0]), F.lit("")).alias("bug_title"),
            F.try_element_at(lines, F.lit(2)).alias("bug_description"),
            F.concat("lang", F.lit("; "), "source").alias("bug_tags"),
            F.col("o_orderpriority").alias("priority"),
            F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("severity"),
            missing.alias("area_path"),
            missing.alias("iteration_path"),
            F.col("o_orderstatus").alias("state"),
            F.col("o_orderdate").alias("created"),
        )
    )


def testcases(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.lit(None).cast("string")
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + TESTCASE_BASE).alias("testcase_id"),
        F.concat("p_name", F.lit(" "), "p_brand").alias("testcase_title"),
        F.col("p_type").alias("testcase_description"),
        missing.alias("test_steps"),
        missing.alias("expected_results"),
        missing.alias("preconditions"),
    )


def raw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey") + TESTCASE_BASE
    odd = F.col("l_linenumber") % 2 == 1
    return table(spark, sf_dir, "lineitem").select(
        F.when(odd, F.col("l_orderkey")).otherwise(part).alias("WorkItemId"),
        F.when(odd, part).otherwise(F.col("l_orderkey")).alias("LinkedWorkItemId"),
        F.col("l_returnflag").alias("LinkedType"),
    )


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.build_master(raw_links(spark, sf_dir), bugs(spark, sf_dir), testcases(spark, sf_dir))


def vote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (bug, test case, title); no bug text is touched on the way."""
    found = links.resolve_links(
        raw_links(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("bug_id")), testcases(spark, sf_dir)
    )
    titles = testcases(spark, sf_dir).select("testcase_id", "testcase_title")
    return found.select("bug_id", "testcase_id").distinct().join(titles, "testcase_id").select("bug_id", "testcase_id", "testcase_title")


def linked_bugs(spark: SparkSession, sf_dir: str, links_table: DataFrame) -> DataFrame:
    """Bugs with a link, which are the ones that history can say something about."""
    return bugs(spark, sf_dir).join(links_table.select("bug_id").distinct(), "bug_id", "left_semi")


def label_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector linked to its label as if that were a test case."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("bug_id"),
        F.col("label").cast("bigint").alias("testcase_id"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("testcase_title"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.unit_vectors(table(spark, sf_dir, "embeddings"), "vec_id")


def history(spark: SparkSession, sf_dir: str, words: bool = True) -> tuple[DataFrame, rec.Corpus]:
    """Linked bugs with their enriched text, and the corpus made of them.

    Everything here is read several times later on, so it is staged. Without ``words``
    there is no BM25 index, which dense retrieval does not need.
    """
    links_table = stage(vote_links(spark, sf_dir), "links")
    meta = stage(rec.bug_metadata(linked_bugs(spark, sf_dir, links_table)), "metadata")
    found = rec.Corpus(
        vectors=stage(embed.token_hash_vectors(meta, "bug_id", "bug_text_enriched", dim=VECTOR_DIM), "vectors"),
        index=bm25.build_index(meta) if words else None,
        links=links_table,
    )
    return meta, found


def vectorize_queries(queries: DataFrame) -> DataFrame:
    return embed.token_hash_vectors(queries, "query_id", "query_text", dim=VECTOR_DIM, as_query=True)


# --- the same in SQL -------------------------------------------------------------

_S = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def sql_text(x: str) -> str:
    return f"coalesce({sql_strip(x)}, '')"


def sql_collapse(x: str) -> str:
    no_tags = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    return f"nullif({sql_strip(f"regexp_replace({no_tags}, '{_S}+', ' ', 'g')")}, '')"


def sql_clean(x: str) -> str:
    """Markup cleaning for the entities that occur in the given tables."""
    for entity, letter in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{entity}', '{letter}', 'g')"
    return sql_collapse(x)


def sql_title(x: str, mode: str = "a") -> str:
    text = f"lower({sql_text(x)})"
    if mode == "b":
        runs = rf"regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
        blanked = rf"list_transform({runs}, lambda r: CASE WHEN regexp_full_match(r, '\p{{Nd}}+') THEN ' ' ELSE r END)"
        text = f"array_to_string({blanked}, '')"
    token = (
        r"CASE WHEN regexp_full_match(t, '\p{Nd}+') THEN ''"
        r" WHEN regexp_matches(t, '\p{Nd}') AND regexp_matches(t, '[a-z]') THEN regexp_replace(t, '\p{Nd}+', '', 'g')"
        r" ELSE t END"
    )
    tokens = f"list_transform(regexp_split_to_array({text}, '{_S}+'), lambda t: {token})"
    return f"array_to_string(list_filter({tokens}, lambda t: t <> ''), ' ')"


def sql_meta_tokens(tags: str, severity: str) -> str:
    sev = sql_text(severity)
    names = f"list_filter(list_transform(string_split({sql_text(tags)}, ','), lambda t: {sql_strip('t')}), lambda t: t <> '')"
    tag_tokens = f"list_transform({names}, lambda t: concat('[TAG_', replace(upper(t), ' ', '_'), ']'))"
    head = f"CASE WHEN {sev} <> '' THEN [concat('[SEV_', replace(upper({sev}), ' ', '_'), ']')] ELSE []::VARCHAR[] END"
    return f"array_to_string(list_concat({head}, {tag_tokens}), ' ')"


def sql_enriched(title: str, tags: str, severity: str, description: str, mode: str = "a", normalized: bool = True, tokens: bool = True) -> str:
    first = sql_title(title, mode) if normalized else f"lower({sql_text(title)})"
    lines = [
        f"'Normalized Title: ' || {first}",
        f"'Original Title: ' || {sql_text(title)}",
        f"'Tags: ' || {sql_text(tags)}",
        f"'Severity: ' || {sql_text(severity)}",
        f"'Description: ' || {sql_text(description)}",
    ]
    if tokens:
        lines.append(f"nullif({sql_meta_tokens(tags, severity)}, '')")
    return f"concat_ws(chr(10), {', '.join(lines)})"


BUG_FIELDS_SQL = ("bug_title", "bug_tags", "severity", "bug_description")

# name -> (names it needs, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "bugs": (
        (),
        f"""SELECT d.doc_id AS bug_id, nullif({sql_strip("split_part(d.text, chr(10), 1)")}, '') AS bug_title,
            CASE WHEN position(chr(10) IN d.text) > 0 THEN substr(d.text, position(chr(10) IN d.text) + 1) END AS bug_description,
            concat(d.lang, '; ', d.source) AS bug_tags, o.o_orderpriority AS priority,
            nullif(o.o_orderpriority, '4-NOT SPECIFIED') AS severity, NULL::VARCHAR AS area_path,
            NULL::VARCHAR AS iteration_path, o.o_orderstatus AS state, o.o_orderdate AS created
            FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey""",
    ),
    "testcases": (
        (),
        f"""SELECT p_partkey + {TESTCASE_BASE} AS testcase_id, concat(p_name, ' ', p_brand) AS testcase_title,
            p_type AS testcase_description, NULL::VARCHAR AS test_steps, NULL::VARCHAR AS expected_results,
            NULL::VARCHAR AS preconditions FROM part""",
    ),
    "raw_links": (
        (),
        f"""SELECT CASE WHEN l_linenumber % 2 = 1 THEN l_orderkey ELSE l_partkey + {TESTCASE_BASE} END AS from_id,
            CASE WHEN l_linenumber % 2 = 1 THEN l_partkey + {TESTCASE_BASE} ELSE l_orderkey END AS to_id,
            l_returnflag AS link_type FROM lineitem""",
    ),
    "links": (
        ("bugs", "testcases", "raw_links"),
        """SELECT DISTINCT bug_id, testcase_id, link_type FROM (
            SELECT from_id AS bug_id, to_id AS testcase_id, link_type FROM raw_links
            UNION ALL SELECT to_id, from_id, link_type FROM raw_links)
            WHERE bug_id IN (SELECT bug_id FROM bugs) AND testcase_id IN (SELECT testcase_id FROM testcases)""",
    ),
    "master": (
        ("links",),
        """SELECT DISTINCT l.bug_id, b.bug_title, b.bug_description, b.bug_tags, b.priority, b.severity,
            l.testcase_id, t.testcase_title, t.testcase_description, t.test_steps
            FROM links l JOIN bugs b USING (bug_id) JOIN testcases t USING (testcase_id)""",
    ),
    "vote_links": (
        ("links",),
        "SELECT DISTINCT l.bug_id, l.testcase_id, t.testcase_title FROM links l JOIN testcases t USING (testcase_id)",
    ),
    "metadata": (
        ("bugs", "vote_links"),
        f"""SELECT *, {sql_enriched(*BUG_FIELDS_SQL)} AS bug_text_enriched FROM bugs
            WHERE bug_id IN (SELECT bug_id FROM vote_links)""",
    ),
    "label_links": (
        (),
        "SELECT vec_id AS bug_id, label::BIGINT AS testcase_id, concat('label ', label) AS testcase_title FROM embeddings",
    ),
    "vectors": (
        (),
        """SELECT vec_id AS id, list_transform(embedding, lambda x: (x::DOUBLE / n)::FLOAT)::DOUBLE[] AS v FROM (
            SELECT vec_id, embedding, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""",
    ),
}


def with_ctes(names: tuple[str, ...], extra: dict[str, str], final: str) -> str:
    """A statement over shared CTEs, in order of need, and its own ones."""
    chosen: dict[str, str] = {}

    def add(name: str) -> None:
        needs, body = CTES[name]
        for need in needs:
            add(need)
        chosen.setdefault(name, body)

    for name in names:
        add(name)
    chosen.update(extra)
    materialized = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in chosen.items())
    return f"WITH {materialized}\n{final}" if chosen else final


def sql_hash_vectors(name: str, source: str) -> dict[str, str]:
    """CTE ``name(id, v)``: hashed token counts of unit length of ``source(id, text)``."""
    return {
        f"{name}_cells": f"""SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {VECTOR_DIM} AS bucket, count(*)::DOUBLE AS n FROM (
            SELECT id, lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS t FROM {source}) GROUP BY ALL""",
        f"{name}_norms": f"SELECT id, sqrt(sum(n * n)) AS norm FROM {name}_cells GROUP BY id",
        name: f"""SELECT g.id, list(coalesce(c.n / m.norm, 0)::FLOAT::DOUBLE ORDER BY g.bucket) AS v
            FROM (SELECT id, unnest(range({VECTOR_DIM})) AS bucket FROM {source}) g
            LEFT JOIN {name}_norms m ON m.id = g.id LEFT JOIN {name}_cells c ON c.id = g.id AND c.bucket = g.bucket GROUP BY g.id""",
    }


def sql_dense(name: str, queries: str, corpus_name: str, k: int) -> dict[str, str]:
    """CTE ``name(query_id, bug_id, dense_score, raw_rank)``."""
    return {
        f"{name}_pairs": f"""SELECT q.id AS query_id, c.id AS bug_id, round(list_inner_product(q.v, c.v), 9) AS dense_score
            FROM {queries} q, {corpus_name} c""",
        name: f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, bug_id) AS raw_rank
            FROM {name}_pairs) WHERE raw_rank <= {k}""",
    }


def sql_without_self(source: str, k: int) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_rank) AS dense_rank
        FROM {source} WHERE raw_rank <= {k} AND bug_id <> query_id"""


def sql_bm25_stats(prefix: str, source: str) -> dict[str, str]:
    """Statistics of ``source(id, text)``: postings, lengths, sizes, idf."""
    return {
        f"{prefix}_tf": f"""SELECT id, t, count(*) AS tf FROM (
            SELECT id, lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS t FROM {source}) GROUP BY ALL""",
        f"{prefix}_len": f"""SELECT s.id, coalesce(l.n, 0) AS n FROM {source} s
            LEFT JOIN (SELECT id, sum(tf) AS n FROM {prefix}_tf GROUP BY id) l ON l.id = s.id""",
        f"{prefix}_size": f"SELECT count(*)::DOUBLE AS n, sum(n) / count(*) AS mean_length FROM {prefix}_len",
        f"{prefix}_df": f"SELECT t, count(*) AS df FROM {prefix}_tf GROUP BY t",
        f"{prefix}_raw": f"SELECT t, df, ln(s.n - df + 0.5) - ln(df + 0.5) AS raw FROM {prefix}_df, {prefix}_size s",
        f"{prefix}_mean": f"SELECT round(sum(raw * n) / sum(n), 12) AS mean_idf FROM (SELECT raw, count(*) AS n FROM {prefix}_raw GROUP BY raw)",
        f"{prefix}_idf": f"SELECT t, df, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf FROM {prefix}_raw, {prefix}_mean",
    }


def sql_bm25(name: str, prefix: str, queries: str, k: int, exclude_self: bool) -> dict[str, str]:
    """CTE ``name(query_id, bug_id, bm25_score, bm25_rank)`` for ``queries(id, text)``."""
    skip = "WHERE q.id <> p.id" if exclude_self else ""
    return {
        f"{name}_qtf": f"""SELECT id, t, count(*) AS qtf FROM (
            SELECT id, lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS t FROM {queries}) GROUP BY ALL""",
        f"{name}_weights": f"""SELECT p.id, p.t, i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.n / s.mean_length)) AS w
            FROM {prefix}_tf p JOIN {prefix}_idf i ON i.t = p.t JOIN {prefix}_len l ON l.id = p.id, {prefix}_size s""",
        f"{name}_scores": f"""SELECT q.id AS query_id, p.id AS bug_id, round(sum(q.qtf * p.w), 6) AS bm25_score
            FROM {name}_qtf q JOIN {name}_weights p ON p.t = q.t {skip} GROUP BY ALL""",
        name: f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, bug_id) AS bm25_rank
            FROM {name}_scores WHERE bm25_score <> 0) WHERE bm25_rank <= {k}""",
    }


def sql_rrf(name: str, near: str, words: str, k: int) -> dict[str, str]:
    """CTE ``name`` with ``hybrid_score`` and ``hybrid_rank``."""
    return {
        f"{name}_all": f"""SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.bug_id, b.bug_id) AS bug_id,
            d.dense_score, d.dense_rank, b.bm25_score, b.bm25_rank,
            1.0::DOUBLE / (60 + coalesce(d.dense_rank, 1000000000)) + 1.0::DOUBLE / (60 + coalesce(b.bm25_rank, 1000000000)) AS hybrid_score
            FROM {near} d FULL OUTER JOIN {words} b ON b.query_id = d.query_id AND b.bug_id = d.bug_id""",
        name: f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC,
            dense_score DESC NULLS LAST, bm25_score DESC NULLS LAST, bug_id) AS hybrid_rank FROM {name}_all) WHERE hybrid_rank <= {k}""",
    }


def sql_vote_position(name: str, neighbours: str, link_rel: str, k: int = 10) -> dict[str, str]:
    return {
        f"{name}_sums": f"""SELECT n.query_id, l.testcase_id, l.testcase_title, round(sum(n.hybrid_score), 9) AS similarity_sum,
            count(DISTINCT n.bug_id) AS support_count, round(sum(1.0::DOUBLE / n.hybrid_rank), 9) AS rank_bonus
            FROM {neighbours} n JOIN {link_rel} l ON l.bug_id = n.bug_id WHERE l.testcase_title IS NOT NULL GROUP BY ALL""",
        f"{name}_final": f"""SELECT *, round(0.7::DOUBLE * similarity_sum + 0.2::DOUBLE * support_count + 0.1::DOUBLE * rank_bonus, 12) AS final_score
            FROM {name}_sums""",
        name: f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, similarity_sum DESC,
            support_count DESC, testcase_id) AS rank FROM {name}_final) WHERE rank <= {k}""",
    }


def sql_vote_score(name: str, neighbours: str, link_rel: str, k: int = 10, score: str = "hybrid_score") -> dict[str, str]:
    return {
        f"{name}_sums": f"""SELECT n.query_id, l.testcase_id, l.testcase_title, round(sum(n.{score}), 9) AS aggregated_score,
            count(DISTINCT n.bug_id) AS supporting_bug_count
            FROM {neighbours} n JOIN {link_rel} l ON l.bug_id = n.bug_id WHERE l.testcase_title IS NOT NULL GROUP BY ALL""",
        name: f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY aggregated_score DESC,
            supporting_bug_count DESC, testcase_id) AS rank FROM {name}_sums) WHERE rank <= {k}""",
    }
