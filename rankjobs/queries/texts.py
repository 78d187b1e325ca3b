"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankjobs.functions import numeric as num
from rankjobs.functions import text as tx
from rankjobs.plans import diagnose
from rankjobs.queries import model as m


def clean_html(spark, sf):
    return m.spread(m.table(spark, sf, "pages").select("page_id", "html")).select("page_id", tx.clean_html("html").alias("text"))


def tags_normalized(spark, sf):
    messy = F.concat(F.lit(" "), F.col("lang"), F.lit(";; "), F.col("source"), F.lit(" ;"))
    return m.table(spark, sf, "documents").select("doc_id", tx.normalize_tags(messy).alias("tags"))


def title_norm(mode):
    def run(spark, sf):
        return m.documents(spark, sf).select("doc_id", tx.normalize_title("text", mode).alias("title"))

    return run


def plain_text(spark, sf):
    return m.bugs(spark, sf).select("bug_id", tx.plain_text("bug_title", "bug_tags", "severity", "bug_description").alias("text"))


def enriched_text(**options):
    def run(spark, sf):
        text = tx.enriched_text("bug_title", "bug_tags", "severity", "bug_description", **options)
        return m.bugs(spark, sf).select("bug_id", text.alias("text"))

    return run


def metadata_tokens(spark, sf):
    tags = F.concat("lang", F.lit(", "), "source", F.lit(" x"))
    orders = m.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return (
        m.table(spark, sf, "documents")
        .select("doc_id", tags.alias("tags"))
        .join(orders, F.col("doc_id") == F.col("o_orderkey"))
        .select("doc_id", tx.metadata_tokens("tags", "o_orderpriority").alias("tokens"))
    )


def query_text(spark, sf):
    return m.table(spark, sf, "benchmark").select(
        "item_id", tx.query_text(tx.enriched_text("text", F.lit(None).cast("string"), F.lit(""), F.lit(""))).alias("text")
    )


def tokens(spark, sf):
    found = tx.tokenize("text")
    return m.documents(spark, sf).select(
        "doc_id", F.size(found).cast("bigint").alias("n_tokens"), F.array_join(found, " ").alias("tokens")
    )


def top_title_tokens(spark, sf):
    return diagnose.title_tokens(m.bugs(spark, sf), 20)


def id_lists(spark, sf):
    listed = (
        m.table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(tx.format_id_list(F.array_sort(F.collect_set("l_partkey"))).alias("id_text"))
    )
    ids = tx.parse_id_list("id_text")
    return listed.select(
        "l_orderkey",
        "id_text",
        F.size(ids).cast("bigint").alias("n"),
        F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
    )


def numeric_ids(spark, sf):
    raw = m.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.when(F.col("l_returnflag") == "N", "x").otherwise("")).alias(
            "cell"
        ),
    )
    return raw.select("l_orderkey", "l_linenumber", num.to_id("cell").alias("id")).dropna(subset=["id"])


def min_max_scores(spark, sf):
    items = m.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        F.round(num.min_max("l_extendedprice", ["l_orderkey"]), 6).alias("scaled"),
        F.round(num.sigmoid(F.col("l_extendedprice") / 100000), 6).alias("squashed"),
    )


_BUG = m.BUG_FIELDS_SQL
_TOKENS = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda t: lower(t))"

QUERIES = {
    "clean_html": (clean_html, f"SELECT page_id, {m.sql_clean('html')} AS text FROM pages"),
    "tags_normalized": (tags_normalized, "SELECT doc_id, concat(lang, '; ', source) AS tags FROM documents"),
    "title_norm_a": (title_norm("a"), f"SELECT doc_id, {m.sql_title('text')} AS title FROM documents"),
    "title_norm_b": (title_norm("b"), f"SELECT doc_id, {m.sql_title('text', 'b')} AS title FROM documents"),
    "plain_text": (
        plain_text,
        m.with_ctes(
            ("bugs",),
            {},
            f"""SELECT bug_id, concat_ws(chr(10), 'Title: ' || {m.sql_text('bug_title')}, 'Tags: ' || {m.sql_text('bug_tags')},
            'Severity: ' || {m.sql_text('severity')}, 'Description: ' || {m.sql_text('bug_description')}) AS text FROM bugs""",
        ),
    ),
    "enriched_text": (enriched_text(), m.with_ctes(("bugs",), {}, f"SELECT bug_id, {m.sql_enriched(*_BUG)} AS text FROM bugs")),
    "enriched_text_original": (
        enriched_text(title_mode="b", normalized_title=False, with_tokens=False),
        m.with_ctes(("bugs",), {}, f"SELECT bug_id, {m.sql_enriched(*_BUG, 'b', False, False)} AS text FROM bugs"),
    ),
    "enriched_text_plain_lines": (
        enriched_text(title_mode="b", with_tokens=False),
        m.with_ctes(("bugs",), {}, f"SELECT bug_id, {m.sql_enriched(*_BUG, 'b', True, False)} AS text FROM bugs"),
    ),
    "metadata_tokens": (
        metadata_tokens,
        """SELECT doc_id, concat('[SEV_', replace(upper(o_orderpriority), ' ', '_'), '] [TAG_', upper(lang), '] [TAG_', upper(source), '_X]')
        AS tokens FROM documents JOIN orders ON doc_id = o_orderkey""",
    ),
    "query_text": (
        query_text,
        f"SELECT item_id, 'query: ' || {m.sql_strip(m.sql_enriched('text', 'NULL', chr(39) * 2, chr(39) * 2))} AS text FROM benchmark",
    ),
    "tokens": (
        tokens,
        f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens
        FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)""",
    ),
    "top_title_tokens": (
        top_title_tokens,
        m.with_ctes(
            ("bugs",),
            {},
            f"""SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS.format("coalesce(bug_title, '')")}) AS token FROM bugs)
            WHERE length(token) > 2 GROUP BY token ORDER BY n DESC, token LIMIT 20""",
        ),
    ),
    "id_lists": (
        id_lists,
        """SELECT l_orderkey, '[' || string_agg(l_partkey::VARCHAR, ', ' ORDER BY l_partkey) || ']' AS id_text, count(*) AS n,
        sum(l_partkey)::BIGINT AS total FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey""",
    ),
    "numeric_ids": (
        numeric_ids,
        "SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::BIGINT AS id FROM lineitem WHERE l_returnflag <> 'N'",
    ),
    "min_max_scores": (
        min_max_scores,
        """SELECT l_orderkey, l_linenumber, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 1.0 END, 6) AS scaled,
        round(1.0::DOUBLE / (1 + exp(-x / 100000)), 6) AS squashed FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS x,
        min(l_extendedprice) OVER (PARTITION BY l_orderkey) AS lo, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS hi FROM lineitem)""",
    ),
}
