"""One odd answer must not end a job or empty a row."""

from pyspark.sql import functions as F

from scorecraft.functions import sqltext as S
from scorecraft.functions import text as T
from scorecraft.operators import prompts as P
from scorecraft.sources.files import _folder


def test_year_buckets_of_odd_numbers(spark):
    cases = {"1985": "1900", " 1985.7 ": "1900", "-5": "-100", "1900d": "0", "1900F": "0", "1e30": "0", "1e400": "0", "Infinity": "0",
             "NaN": "0", "9" * 20: "0", "": "0", "x": "0", "1.9e3": "1900", None: "0"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    rows = df.select("t", T.year_bucket("t", 100).alias("a"), F.expr(S.bucket("t", 100)).alias("b")).collect()
    assert {r.t: r.a for r in rows} == cases
    assert {r.t: r.b for r in rows} == cases


def test_centuries_of_any_length(spark):
    numbers = ["19", "0", "00", "1", "01", "10", "100", "1000", "9" * 37, "1" + "0" * 40, "12345678901234567890123456789012345678901234"]
    cases = {f"the {n}th century, 2nd century": f"the {(int(n) - 1) * 100}, 100" for n in numbers}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    rows = df.select("t", T.century_to_year("t").alias("a"), F.expr(S.century("t")).alias("b")).collect()
    assert {r.t: r.a for r in rows} == cases
    assert {r.t: r.b for r in rows} == cases


def test_prompt_without_annotation(spark):
    df = spark.createDataFrame([("Who?", None, None), ("By [author] in [year]?", None, 1900), ("By [author]?", "A_B", None)],
                               "p string, author string, year int")
    got = [r[0] for r in df.select(P.fill_prompt("p", "author", "year")).collect()]
    assert got == ["Who?", "By  in 1900?", "By A B?"]


def test_every_response_has_content_or_error(spark):
    cases = {'{"choices":[]}': "empty_choices", '{"choices":null}': "empty_choices", '{"choices":[{"message":{}}]}': "no_content",
             '{"choices":[{"message":{"content":null}}]}': "no_content", '{"error":{}}': "no_choices", "not json": "invalid_json",
             '{"choices":[{"message":{"content":"a"}}]}': None, '{"choices":[{"message":{"content":""}}]}': None}
    rows = P.ingest_responses(spark.createDataFrame([(k,) for k in cases], "body string")).collect()
    assert {r.body: r.error for r in rows} == cases
    assert all((r.content is None) == (r.error is not None) for r in rows)


def test_folder_names_are_decoded(spark):
    df = spark.createDataFrame([("file:/a/My%20Set_author_CLIP/r.csv",), ("/a/x+y_style_CLIP/r.csv",), ("/a/50%_style_CLIP/r.csv",)], "p string")
    assert [r[0] for r in df.select(_folder(F.col("p"))).collect()] == ["My Set_author_CLIP", "x+y_style_CLIP", "50%_style_CLIP"]
