"""Use cases out of responses."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import extract

DEFAULT = ("Data-Driven Decision Making", "Implement a framework for making decisions based on data insights.", "High", "Medium")


def cases(spark, *texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = extract.extract_cases(df, **options).orderBy("id", "case_no").collect()
    return [(r["id"], r["case_no"], r["title"], r["description"], r["impact"], r["effort"], r["source"]) for r in rows]


def one(spark, text, **options):
    return [c[2:] for c in cases(spark, text, **options)]


def test_json_list_in_prose(spark):
    text = 'Sure:\n[{"title": "A", "description": "d", "impact": "High", "effort": "Low"},\n {"title": "B", "n": 1}]\nBye'
    assert one(spark, text) == [("A", "d", "High", "Low", "json"), ("B", None, None, None, "json")]
    assert one(spark, text, fill_json=True)[1] == ("B", "No description provided", "Medium", "Medium", "json")


@pytest.mark.parametrize(
    "text",
    [
        "[ no end",
        "] wrong way [",
        '[{"title": "A"}] and [2]',
        "[{'title': 'A'}]",
        '[{"title": "A"},',
        '["a", "b"]',
        "",
        "nothing to see",
    ],
)
def test_text_without_a_case_gives_the_default(spark, text):
    assert one(spark, text) == [(*DEFAULT, "default")]


def test_null_text_and_empty_list(spark):
    assert one(spark, None) == [(*DEFAULT, "default")]
    assert cases(spark, "[]") == []


def test_numbered_list(spark):
    text = """Here is what I found

      1. Review pay
         Compare units: yearly
         Impact: High, effort follows
         Effort: low
      2) not a title
      12. Grow team
      Impact: medium
      Description of it: hire: three
      Implementation effort: High
      3. Stop"""
    assert one(spark, text) == [
        ("Review pay", "yearly", "High", "Low", "lines"),
        ("Grow team", "hire: three", "Medium", "High", "lines"),
        ("Stop", "No description provided", "Medium", "Medium", "lines"),
    ]


def test_first_line_below_a_title_is_its_description_whatever_it_says(spark):
    assert one(spark, "1. T\nImpact: High") == [("T", "High", "Medium", "Medium", "lines")]


def test_labels_before_the_first_title_belong_to_the_first_case(spark):
    text = "Impact: high\nDescription: early\n1. A\nImpact: allow\n2. B\nplain"
    assert one(spark, text) == [("A", "early", "Low", "Medium", "lines"), ("B", "plain", "Medium", "Medium", "lines")]


def test_later_lines_win_and_levels_are_found_in_order(spark):
    text = "1. A\nx\nimpact low\nimpact medium to high\nimpact none\neffort impact high\neffort medium\neffort unclear\ndescription one\ndescription two"
    assert one(spark, text) == [("A", "description two", "High", "Medium", "lines")]


def test_titles_need_a_digit_and_an_early_dot(spark):
    assert one(spark, "123. late dot\nx") == [(*DEFAULT, "default")]
    assert one(spark, "1st. A. B\nx")[0][:2] == (*DEFAULT[:2],)
    assert one(spark, "9.5 points. more\nx")[0][:2] == ("5 points. more", "x")


def test_a_long_document_is_read_to_its_end(spark):
    text = "1. A\n" + "word " * 200000 + "\n" + "filler line\n" * 5000 + "Impact: high"
    assert one(spark, text)[0][2] == "High"


def test_no_shuffle_of_texts(spark):
    df = spark.createDataFrame([(1, "1. A\nx")], "id int, text string")
    plan = extract.extract_cases(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_join_and_count(spark):
    df = spark.createDataFrame([({"a": "x", "b": "y"},)], "m map<string,string>")
    assert df.select(extract.join_texts(F.map_values("m"))).first()[0] == "x\n\ny"
    rows = spark.createDataFrame([("High", "Low"), ("High", "Low"), ("Low", "Low")], "impact string, effort string")
    assert sorted(tuple(r) for r in extract.tag_counts(rows).collect()) == [("High", "Low", 2), ("Low", "Low", 1)]
