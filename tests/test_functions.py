import pytest
from pyspark.sql import functions as F

from factloom.functions import classify, compare, jsonrepair
from factloom.functions import text as T

LITERALS = [
    ("9,079*** (1,864)", 9079.0, 1864.0, None), ("-4.89 (4.90)", -4.89, 4.90, None), ("0.84** (0.43)", 0.84, 0.43, None), ("311** (119) [0.01]", 311.0, 119.0, None),
    ("13.93*** (--)", 13.93, None, None), ("Total labor hours", None, None, None), ("-8.6%*", None, None, None), ("n = 500", None, None, 500), (", (1)", None, 1.0, None), (None, None, None, None),
]


def test_literal_text(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LITERALS)], "i int, t string")
    got = df.select("i", T.parsed_effect(F.col("t")), T.parsed_se(F.col("t")), T.parsed_observations(F.col("t"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [x[1:] for x in LITERALS]


CASES = [
    ("numeric", None, None, True, "both_null"), ("numeric", None, "1", False, "llm_missing"), ("numeric", "1", None, False, "human_missing"), ("numeric", "100.5", "100", True, "numeric_match"),
    ("numeric", "102", "100", False, "numeric_diff_0.020"), ("numeric", "1", "0", False, "numeric_diff_zero_base"), ("numeric", "0", "0", True, "numeric_match"), ("numeric", "abc", "1", False, "numeric_parse_error"),
    ("categorical", "Malawi ", "malawi", True, "exact_match"), ("categorical", "unclear", "NR", True, "both_unclear"), ("categorical", "Ghana", "Vietnam", False, "categorical_mismatch"), ("categorical", "", "x", False, "categorical_mismatch"),
    ("component", "Yes", "1", True, "content_match"), ("component", "Not mentioned", "0", False, "component_diff_not_mentioned_vs_no"),
    ("text", "total food consumption", "food consumption total value", True, "word_overlap_0.75"), ("text", "asset index", "savings", False, "text_content_mismatch"),
]


@pytest.mark.parametrize("kind,a,b,match,reason", CASES)
def test_comparators(spark, kind, a, b, match, reason):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(compare.COMPARATORS[kind](F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert (r["is_match"], r["reason"]) == (match, reason)


def test_categorical_compat(spark):
    r = spark.createDataFrame([("Ghana", "Vietnam")], "a string, b string").select(compare.categorical(F.col("a"), F.col("b"), compat=True).alias("r")).first()["r"]
    assert tuple(r) == (True, "both_unclear")


@pytest.mark.parametrize("raw", ['{"a": 1}', 'Sure:\n```json\n{"a": 1}\n```', '```\n{"a": 1}\n```', 'Result {"a": 1}', 'x {"a": 1} and more'])
def test_json_recovery(spark, raw):
    got = spark.createDataFrame([(raw,)], "t string").select(F.get_json_object(jsonrepair.recovered(F.col("t")), "$.a"), jsonrepair.as_map(F.lit("{'k': None, 'x': 'y'}"))).first()
    assert got[0] == "1" and got[1]["x"] == "y"


def test_json_hopeless(spark):
    df = spark.createDataFrame([("no json",), (None,), ("{broken",)], "t string")
    assert [r[0] for r in df.select(jsonrepair.recovered(F.col("t"))).collect()] == [None] * 3


def test_scores(spark):
    captions = [("", 0.5), (None, 0.5), ("Figure 1: effects", -999.0), ("Table 2: demographic balance", 0.1), ("Impact of treatment", 0.9), ("Income", 0.7), ("Misc", 0.5)]
    df = spark.createDataFrame([(c,) for c, _ in captions], "c string")
    assert [r[0] for r in df.select(classify.caption_score(F.col("c"))).collect()] == [s for _, s in captions]
    compat = df.where("c LIKE '%demographic%'").select(classify.caption_score(F.col("c"), compat=True)).first()[0]
    assert compat == -999.0  # "graph" within "demographic"
    heads = spark.createDataFrame([("(1) (2) (3)",), ("coef",), ("name",)], "h string")
    assert [r[0] for r in heads.select(classify.header_score(F.col("h"))).collect()] == [0.9, 0.7, 0.3]


def test_contexts_overlap(spark):
    text = "a table 1 b table 1 c"
    got = spark.createDataFrame([(text,)], "t string").select(classify.contexts(F.col("t"), "table 1", 3), classify.context_score(F.col("t"), classify.table_markers(1))).first()
    assert got[0] == ["a table 1 b ", " b table 1 c"] and got[1] == 0.4


def test_small_texts(spark):
    x = spark.createDataFrame([("/d/ABC.tei.xml", "12_34", "Table 4. Effects\nTable 5: More")], "p string, i string, t string")
    got = x.select(T.file_key(F.col("p")), T.id_base(F.col("i")), T.table_number(F.col("t")), T.table_titles(F.col("t")), T.p_from_stars(F.lit("1.2**")), T.p_display(F.lit("None")), T.label(F.lit("a"), {"a": "A"}, "?"), T.ellipsis(F.lit("x" * 90), 80)).first()
    assert got[0] == "ABC" and got[1] == "12" and got[2] == 4 and [tuple(p) for p in got[3]] == [("4", "Effects"), ("5", "More")]
    assert (got[4], got[5], got[6], len(got[7])) == (0.05, "Non sig.", "A", 83)
