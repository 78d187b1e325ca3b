"""Golden rows of the text functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rankjobs.functions import numeric as num
from rankjobs.functions import text as tx


def one(spark, expression, **cells):
    schema = ", ".join(f"{name} string" for name in cells)
    return spark.createDataFrame([tuple(cells.values())], schema).select(expression.alias("r")).first().r


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        ("<p>a&nbsp;&nbsp;b</p>", "a b"),
        ("<br/> ", None),
        (None, None),
        ("x < y and z > w", "x w"),
        ("&lt;p&gt;a&amp;nbsp;&amp;nbsp;b&lt;/p&gt;", "a&nbsp;&nbsp;b"),
        (" a\x1cb c ", "a b c"),
        ("no markup", "no markup"),
    ],
)
def test_clean_html(spark, raw, cleaned):
    assert one(spark, tx.clean_html("x"), x=raw) == cleaned


def test_clean_html_twice_resolves_double_escapes(spark):
    assert one(spark, tx.clean_html(tx.clean_html("x")), x="&lt;p&gt;a&amp;nbsp;&amp;nbsp;b&lt;/p&gt;") == "a b"


@pytest.mark.parametrize("raw, tags", [(" a;; b ;", "a; b"), (";;", None), (None, None), ("a", "a")])
def test_normalize_tags(spark, raw, tags):
    assert one(spark, tx.normalize_tags("x"), x=raw) == tags


@pytest.mark.parametrize(
    "mode, raw, title",
    [
        ("a", "66804 TC123 fails 7.5", "tc fails 7.5"),
        ("a", "tc-123 66804: a1b 7.5", "tc- 66804: ab 7.5"),
        ("b", "tc-123 66804: a1b 7.5", "tc- : ab ."),
        ("a", None, ""),
        ("b", "123", ""),
        ("a", "é5 Äpfel9 ok", "é5 pfel ok".replace("pfel", "äpfel")),
    ],
)
def test_normalize_title(spark, mode, raw, title):
    assert one(spark, tx.normalize_title("x", mode), x=raw) == title


def test_unknown_title_mode():
    with pytest.raises(ValueError, match="unknown title mode"):
        tx.normalize_title("x", "c")


def test_tokenize(spark):
    assert one(spark, tx.tokenize("x"), x="Äpfel tc_12, x-x") == ["äpfel", "tc_12", "x", "x"]
    assert one(spark, tx.tokenize("x", longer_than=2), x="Äpfel tc_12, x-x") == ["äpfel", "tc_12"]
    assert one(spark, tx.tokenize("x"), x=None) == []


def test_metadata_tokens(spark):
    tokens = tx.metadata_tokens("t", "s")
    assert one(spark, tokens, t="a b,c", s="2 - High") == "[SEV_2_-_HIGH] [TAG_A_B] [TAG_C]"
    assert one(spark, tokens, t="a; b", s=None) == "[TAG_A;_B]"
    assert one(spark, tx.metadata_tokens("t", "s", tag_separator=";"), t="a; b", s="") == "[TAG_A] [TAG_B]"
    assert one(spark, tokens, t=None, s=" ") == ""


def test_enriched_text(spark):
    text = tx.enriched_text("a", "b", "c", "d")
    assert one(spark, text, a="TC1 x", b=None, c=None, d="y") == (
        "Normalized Title: tc x\nOriginal Title: TC1 x\nTags: \nSeverity: \nDescription: y"
    )
    assert one(spark, text, a=None, b="t", c="1", d=None).endswith("Description: \n[SEV_1] [TAG_T]")
    original = tx.enriched_text("a", "b", "c", "d", normalized_title=False, with_tokens=False)
    assert one(spark, original, a="TC1 X", b="t", c="s", d=None).startswith("Normalized Title: tc1 x\nOriginal Title: TC1 X\n")
    nan = tx.enriched_text("a", "b", "c", "d", null_word="nan")
    assert one(spark, nan, a="x", b="t", c=None, d="y").endswith("[SEV_NAN] [TAG_T]")


def test_plain_text(spark):
    assert one(spark, tx.plain_text("a", "b", "c", "d"), a=" x ", b=None, c="s", d="") == "Title: x\nTags: \nSeverity: s\nDescription: "


@pytest.mark.parametrize(
    "text, ids", [("[1, 2]", [1, 2]), ("(1,2)", [1, 2]), ("1, 2", [1, 2]), ("7", [7]), ("  ", []), (None, []), ("[]", [])]
)
def test_parse_id_list(spark, text, ids):
    assert one(spark, tx.parse_id_list("x"), x=text) == ids


def test_format_id_list(spark):
    df = spark.createDataFrame([([3, 1],)], "ids array<bigint>")
    assert df.select(tx.format_id_list("ids").alias("r")).first().r == "[3, 1]"


@pytest.mark.parametrize("raw, number", [("12", 12), ("7.9", 7), ("x", None), (None, None), ("-1.5", -1)])
def test_to_id(spark, raw, number):
    assert one(spark, num.to_id("x"), x=raw) == number


@pytest.mark.parametrize("values, scaled", [([5.0], [1.0]), ([2.0, 2.0], [1.0, 1.0]), ([1.0, 3.0], [0.0, 1.0]), ([], [])])
def test_min_max(spark, values, scaled):
    df = spark.createDataFrame([(1, v) for v in values], "q bigint, v double")
    assert [r.s for r in df.orderBy("v").select(num.min_max("v", ["q"]).alias("s")).collect()] == scaled


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    rows = [r.n for r in df.select(num.l2_normalize("v").alias("n")).collect()]
    assert rows[0] == pytest.approx([0.6, 0.8]) and rows[1] == [0.0, 0.0]


def test_is_blank(spark):
    df = spark.createDataFrame([(None,), (" \t",), ("x",), (" ",)], "x string")
    assert [r.b for r in df.select(tx.is_blank("x").alias("b")).collect()] == [True, True, False, True]


def test_tag_list_without_markup_pass(spark):
    assert one(spark, tx.normalize_tag_list(F.col("x")), x="a ; b") == "a; b"
