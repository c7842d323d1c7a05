"""Column builders for answer cleaning: hand-computed cases and invariants."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorecraft.functions import text as T
from scorecraft.operators.rules import clean_predictions


def one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).first()["o"]


def col_over(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    out = df.select("i", build(F.col("s")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in out]


# --- fixed edge cases ------------------------------------------------------

def test_llava_year_chain(spark):
    df = spark.createDataFrame([
        (0, "USER:  \nWhen was this painting made?\nASSISTANT: The painting was made in the early 20th century."),
        (1, "USER:  \nWhen?\nASSISTANT: The painting was made in the 1950s."),
        (2, "USER:  \nWhen?\nASSISTANT: This is a very old painting."),
        (3, None),
    ], "i int, preds string").select("i", "preds", F.lit("LLaVA").alias("model"), F.lit("year").alias("attribute"),
                                     F.lit("When was this painting made?").alias("prompt"))
    out = clean_predictions(df).select("i", T.find_year("pred_clean").alias("y")).orderBy("i").collect()
    assert [r["y"] for r in out] == ["1900", "1950", "0", "0"]


def test_two_centuries(spark):
    assert one(spark, T.century_to_year(F.col("s")), "9th century 19th century") == "800 1800"
    assert one(spark, T.century_to_year(F.col("s")), "the 21st century and 1st century") == "the 2000 and 0"


def test_remove_author(spark):
    assert one(spark, T.remove_author(F.col("s")), "this painting by Pablo Picasso is cubism") == \
        "this painting is cubism"
    assert one(spark, T.remove_author(F.col("s")), "a by Raphael is") == "a by Raphael is"


def test_sentences_and_years_by_hand(spark):
    cases = {"The STYLE is odd. Then more.": "The STYLE is odd", "no such word": "no such word", "": "",
             "a. b style . c style": "b style", " lifestyle ": "lifestyle"}
    assert col_over(spark, list(cases), lambda c: T.sentence_with(c, "Style")) == list(cases.values())
    cases = {"12345": "1234", "in 19051 or 1887": "1905", "99 and 100": "0", "": "0", "x1887y1905": "1887"}
    assert col_over(spark, list(cases), T.find_year) == list(cases.values())


def test_null_to_empty(spark):
    assert one(spark, T.null_to_empty(F.col("s")), None) == ""


def test_sentence_with(spark):
    t = "Hello there. This painting belongs to the Baroque period. Fine."
    assert one(spark, T.sentence_with(F.col("s"), "BELONGS"), t) == "This painting belongs to the Baroque period"
    assert one(spark, T.sentence_with(F.col("s"), "absent"), t) == t


def test_split_equivalents(spark):
    assert one(spark, T.keep_before(F.col("s"), ", which"), "Cubism, which is new") == "Cubism"
    assert one(spark, T.keep_before(F.col("s"), "zz"), "Cubism") == "Cubism"
    assert one(spark, T.keep_after_last(F.col("s"), "to the "), "to the a to the b") == "b"


def test_year_bucket(spark):
    vals = ["1987", "abc", None, "1987.5", "0"]
    assert col_over(spark, vals, lambda c: T.year_bucket(c, 100)) == ["1900", "0", "0", "1900", "0"]
    assert col_over(spark, vals, lambda c: T.year_bucket(c, 10)) == ["1980", "0", "0", "1980", "0"]


def test_assistant_and_fewshot(spark):
    assert one(spark, T.assistant_extract(F.col("s")), "USER: q\nASSISTANT: Baroque\nart") == "Baroqueart"
    assert one(spark, T.assistant_extract(F.col("s")), "no marker") == "no marker"
    shot = "<image>p Cubism.<|endofchunk|><image>p Realism.<|endofchunk|><image>p Rococo"
    assert one(spark, T.fewshot_tail(F.col("s")), shot) == "p Rococo"
    assert one(spark, T.fewshot_tail(F.col("s")), "<image>only one") == ""


def test_normalise(spark):
    assert one(spark, T.normalise_label(F.col("s")), "Post_Impressionism") == "post impressionism"
    assert one(spark, T.report_key_underscore(F.col("s")), "Pop Art") == "pop_art"


# --- invariants on random texts ----------------------------------------------

words = st.sampled_from(["the", "style", "Period", "belongs", "painting", "19th century", "9th century",
                         "1st century", "by", "Pablo", "Picasso", "is", "1905", "12345", ".", " ", "  ", "\t",
                         "Art", "van", "Gogh", "x"])
texts = st.lists(words, min_size=0, max_size=14).map(lambda ws: " ".join(ws))


@settings(max_examples=3, deadline=None)
@given(st.lists(texts, min_size=60, max_size=60))
def test_invariants(spark, batch):
    for text, found in zip(batch, col_over(spark, batch, lambda c: T.sentence_with(c, "Style")), strict=True):
        assert found == text if "style" not in text.lower() else found in text and "style" in found.lower()
    for text, years in zip(batch, col_over(spark, batch, T.century_to_year), strict=True):
        assert "century" not in years and years.count("1800") == text.count("19th century")
    for text, year in zip(batch, col_over(spark, batch, T.find_year), strict=True):
        assert year == "0" if not {"1905", "12345"} & set(text.split()) else year in ("1905", "1234") and year in text
    for text, rest in zip(batch, col_over(spark, batch, T.remove_author), strict=True):
        assert rest.split(" ") == (rest.split() or [""]) and len(rest) <= len(text)
        assert "by" in text.split() or rest.split() == text.split()
    assert col_over(spark, batch, T.collapse_ws) == [" ".join(t.split()) for t in batch]
    assert col_over(spark, batch, lambda c: T.keep_before(c, " style")) == [t.split(" style")[0] for t in batch]
    assert col_over(spark, batch, lambda c: T.keep_after_last(c, "belongs")) == \
        [t.split("belongs")[-1] for t in batch]


rule_texts = st.lists(st.sampled_from([
    "USER: q\nASSISTANT: ", "<image>", "This painting belongs to the ", "Baroque", " style", " period", ".",
    "The art style of this painting is ", ", which was ", "art", "the ", "by Pablo Picasso ", "made in 1905 ",
    "19th century", "9th century", "**", '"', "\t", "The author of this painting is ", "1887", " ", "Rococo"]),
    min_size=0, max_size=12).map("".join)


@settings(max_examples=3, deadline=None)
@given(st.lists(rule_texts, min_size=80, max_size=80))
def test_sql_text_rules_equal_column_rules(spark, batch):
    """The one-expression SQL form of every rule list equals the Column form."""
    from scorecraft.functions import sqltext as Q
    from scorecraft.operators.rules import MODELS, fold_rules, rules_for
    seqs = {tuple(rules_for(m, a, ha, hy)) for m in MODELS for a in ("art_style", "period", "author", "year")
            for ha in (False, True) for hy in (False, True)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, x string")
    cols = []
    for j, seq in enumerate(sorted(seqs)):
        cols.append(fold_rules(F.col("x"), seq).alias(f"c{j}"))
        cols.append(F.expr(Q.fold("x", seq)).alias(f"s{j}"))
    for r in df.select(*cols).collect():
        for j in range(len(seqs)):
            assert r[f"c{j}"] == r[f"s{j}"]


def test_missing_profile_fails_loudly(spark):
    import pytest
    df = spark.createDataFrame([("GPT-4o", "art_style", "Q?", "This painting belongs to the Baroque period.")],
                               "model string, attribute string, prompt string, preds string")
    ok = clean_predictions(df, profiles=["GPT-4o|art_style|false|false"]).first()["pred_clean"]
    assert ok == "Baroque period"
    with pytest.raises(Exception):
        clean_predictions(df, profiles=["LLaVA|art_style|false|false"]).collect()


def test_strict_first_row_decides_for_the_run(spark):
    nl = chr(10)
    rows = [("r1", 0, f"USER: q{nl}ASSISTANT: Baroque"), ("r1", 1, "plain answer"),
            ("r2", 0, "plain first"), ("r2", 1, f"USER: q{nl}ASSISTANT: Rococo")]
    df = (spark.createDataFrame(rows, "run string, row_idx int, preds string")
          .withColumn("model", F.lit("CLIP")).withColumn("attribute", F.lit("author"))
          .withColumn("prompt", F.lit("")))
    per_row = {(r["run"], r["row_idx"]): r["pred_clean"] for r in clean_predictions(df).collect()}
    strict = {(r["run"], r["row_idx"]): r["pred_clean"]
              for r in clean_predictions(df, strict_first_row=True).collect()}
    assert per_row[("r1", 1)] == "plain answer" and strict[("r1", 1)] == ""
    assert strict[("r1", 0)] == "Baroque"
    assert per_row[("r2", 1)] == "Rococo" and strict[("r2", 1)] == f"USER: q{nl}ASSISTANT: Rococo"
