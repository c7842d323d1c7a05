"""Answer-cleaning queries bound to ``part``, ``supplier`` and ``orders``.

The synthetic tables hold no model answers, so each query builds answer
texts from table columns (identically in Spark and in the SQL oracle) and
then runs the cleaning operators over every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.functions import text as T
from scorecraft.operators.rules import STYLE_KEYWORDS, clean_predictions, fold_rules
from scorecraft.plans import sqlgen as S
from scorecraft.plans.registry import register, table

NL, TAB = "\n", "\t"
_MODELS4 = ["LLaVA", "OpenFlamingo", "GPT-4o", "CLIP"]


def _cap(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


_CAP_SQL = "(upper(substr(p_name, 1, 1)) || substr(p_name, 2))"


# --- TXT1 --------------------------------------------------------------------

def _chat_answers(part: DataFrame) -> DataFrame:
    r = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Answer: "), F.col("p_type"))).otherwise(F.concat(
        F.lit(f"USER:  {NL}What is the art style of this painting?{NL}ASSISTANT: The art style of this painting is "),
        F.lower("p_type"), F.lit(f".{NL}It shows a "), F.col("p_name"), F.lit(".")))
    return part.select("p_partkey", r.alias("r"))


_CHAT_SQL = ("CASE WHEN p_partkey % 3 = 0 THEN 'Answer: ' || p_type ELSE 'USER:  ' || chr(10) || "
             "'What is the art style of this painting?' || chr(10) || "
             "'ASSISTANT: The art style of this painting is ' || lower(p_type) || '.' || chr(10) || "
             "'It shows a ' || p_name || '.' END")


@register("assistant_extract", "TXT1 PRJ5", sql=f"""
WITH a AS (SELECT p_partkey, {_CHAT_SQL} AS r FROM part)
SELECT p_partkey, {S.pre_clean('r')} AS answer FROM a""")
def assistant_extract(spark: SparkSession, sf: str) -> DataFrame:
    a = _chat_answers(table(spark, sf, "part"))
    return a.select("p_partkey", T.assistant_extract(T.null_to_empty("r")).alias("answer"))


# --- TXT2 --------------------------------------------------------------------

_SHOT = "<image>The art style of this painting is "
_FEWSHOT_SQL = (f"CASE p_partkey % 4 WHEN 0 THEN '{_SHOT}Cubism.<|endofchunk|>{_SHOT}' || p_type "
                f"WHEN 1 THEN 'No tags here: ' || p_name "
                f"ELSE '{_SHOT}Cubism.<|endofchunk|>{_SHOT}Realism.<|endofchunk|>{_SHOT}' || lower(p_type) || ' ' "
                f"|| p_name END")


def _fewshot_answers(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey") % 4
    r = (F.when(k == 0, F.concat(F.lit(f"{_SHOT}Cubism.<|endofchunk|>{_SHOT}"), F.col("p_type")))
          .when(k == 1, F.concat(F.lit("No tags here: "), F.col("p_name")))
          .otherwise(F.concat(F.lit(f"{_SHOT}Cubism.<|endofchunk|>{_SHOT}Realism.<|endofchunk|>{_SHOT}"),
                              F.lower("p_type"), F.lit(" "), F.col("p_name"))))
    return part.select("p_partkey", r.alias("r"))


@register("fewshot_tail", "TXT2", sql=f"""
WITH a AS (SELECT p_partkey, {_FEWSHOT_SQL} AS r FROM part)
SELECT p_partkey, {S.fewshot('r')} AS answer FROM a""")
def fewshot_tail(spark: SparkSession, sf: str) -> DataFrame:
    a = _fewshot_answers(table(spark, sf, "part"))
    return a.select("p_partkey", T.fewshot_tail("r").alias("answer"))


# --- TXT3 --------------------------------------------------------------------

_SENT_SQL = ("CASE WHEN p_partkey % 3 = 0 THEN 'The ' || p_name || ' shows nothing. Brand ' || p_brand "
             "ELSE 'The ' || p_name || ' is on display.  This painting BELONGS to ' || p_type || ' art. ' "
             "|| p_brand || ' made it.' END")


@register("sentence_with_keyword", "TXT3", sql=f"""
WITH a AS (SELECT p_partkey, {_SENT_SQL} AS r FROM part)
SELECT p_partkey, {S.sentence('r', 'belongs')} AS sentence FROM a""")
def sentence_with_keyword(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    r = F.when(F.col("p_partkey") % 3 == 0,
               F.concat(F.lit("The "), F.col("p_name"), F.lit(" shows nothing. Brand "), F.col("p_brand"))
               ).otherwise(F.concat(F.lit("The "), F.col("p_name"), F.lit(" is on display.  This painting BELONGS to "),
                                    F.col("p_type"), F.lit(" art. "), F.col("p_brand"), F.lit(" made it.")))
    return p.select("p_partkey", T.sentence_with(r, "belongs").alias("sentence"))


# --- TXT4 --------------------------------------------------------------------

_CASCADE_SQL = ("CASE p_size % 4 "
                "WHEN 0 THEN 'I think so. This painting belongs to the ' || p_type || ' period. It is a ' || p_name || '.' "
                "WHEN 1 THEN 'Well. The art style of this painting is ' || lower(p_type) || ' style. Nice ' || p_name || '.' "
                "WHEN 2 THEN 'It has a ' || p_name || ' in the period of ' || p_type || '. Done.' "
                "ELSE 'Nothing to say about ' || p_name || '.' END")


def _cascade_answers(part: DataFrame) -> DataFrame:
    k = F.col("p_size") % 4
    r = (F.when(k == 0, F.concat(F.lit("I think so. This painting belongs to the "), F.col("p_type"),
                                 F.lit(" period. It is a "), F.col("p_name"), F.lit(".")))
          .when(k == 1, F.concat(F.lit("Well. The art style of this painting is "), F.lower("p_type"),
                                 F.lit(" style. Nice "), F.col("p_name"), F.lit(".")))
          .when(k == 2, F.concat(F.lit("It has a "), F.col("p_name"), F.lit(" in the period of "),
                                 F.col("p_type"), F.lit(". Done.")))
          .otherwise(F.concat(F.lit("Nothing to say about "), F.col("p_name"), F.lit("."))))
    return part.select("p_partkey", r.alias("r"))


def _cascade_sql() -> str:
    ctes, last = S.chain("k", "a", "r", STYLE_KEYWORDS)
    return (f"WITH a AS (SELECT p_partkey, {_CASCADE_SQL} AS r FROM part), " + ", ".join(ctes)
            + f" SELECT p_partkey, r AS answer FROM {last}")


@register("keyword_cascade", "TXT4 TXT3", sql=_cascade_sql())
def keyword_cascade(spark: SparkSession, sf: str) -> DataFrame:
    a = _cascade_answers(table(spark, sf, "part"))
    return a.select("p_partkey", fold_rules(F.col("r"), STYLE_KEYWORDS).alias("answer"))


# --- TXT11-13, TXT17: multi-run style cleaning ---------------------------------

_STYLE_R_SQL = (
    "CASE p_partkey % 5 "
    "WHEN 0 THEN 'USER: <image>' || chr(10) || 'Q' || chr(10) || 'ASSISTANT: The art style of this painting is ' "
    "|| lower(p_type) || ', which was popular in the ' || p_name || ' era.' "
    f"WHEN 1 THEN 'This painting by Master ' || {_CAP_SQL} || ' is from the ' || p_type || "
    "' period. It was made in 1990 and is nice.' "
    "WHEN 2 THEN '**' || p_type || '** is an art style that shows ' || p_name || '. This painting belongs to the ' "
    "|| lower(p_type) || ' movement.' "
    "WHEN 3 THEN '<image>The art style of this painting is Cubism.<|endofchunk|><image>The art style of this painting "
    "is Realism.<|endofchunk|><image>The art style of this painting is ' || chr(9) || lower(p_type) || '.' "
    "ELSE 'The painting you provided is a classic example of ' || p_type || ' art style, known as ' || p_name || '.' "
    "END")
_STYLE_MODEL_SQL = "CASE p_size % 4 WHEN 0 THEN 'LLaVA' WHEN 1 THEN 'OpenFlamingo' WHEN 2 THEN 'GPT-4o' ELSE 'CLIP' END"
_STYLE_ATTR_SQL = "CASE p_partkey % 3 WHEN 0 THEN 'style' WHEN 1 THEN 'period' ELSE 'art_style' END"
_STYLE_PROMPT_SQL = ("CASE p_size % 5 WHEN 0 THEN 'What is the style of this painting by [author]?' "
                     "WHEN 1 THEN 'What style is this [year] painting?' "
                     "ELSE 'What is the art style of this painting?' END")


def _style_answers(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey") % 5
    shot = "<image>The art style of this painting is "
    r = (F.when(k == 0, F.concat(F.lit(f"USER: <image>{NL}Q{NL}ASSISTANT: The art style of this painting is "),
                                 F.lower("p_type"), F.lit(", which was popular in the "), F.col("p_name"),
                                 F.lit(" era.")))
          .when(k == 1, F.concat(F.lit("This painting by Master "), _cap(F.col("p_name")), F.lit(" is from the "),
                                 F.col("p_type"), F.lit(" period. It was made in 1990 and is nice.")))
          .when(k == 2, F.concat(F.lit("**"), F.col("p_type"), F.lit("** is an art style that shows "),
                                 F.col("p_name"), F.lit(". This painting belongs to the "), F.lower("p_type"),
                                 F.lit(" movement.")))
          .when(k == 3, F.concat(F.lit(f"{shot}Cubism.<|endofchunk|>{shot}Realism.<|endofchunk|>{shot}{TAB}"),
                                 F.lower("p_type"), F.lit(".")))
          .otherwise(F.concat(F.lit("The painting you provided is a classic example of "), F.col("p_type"),
                              F.lit(" art style, known as "), F.col("p_name"), F.lit("."))))
    m = F.col("p_size") % 4
    model = (F.when(m == 0, "LLaVA").when(m == 1, "OpenFlamingo").when(m == 2, "GPT-4o").otherwise("CLIP"))
    a = F.col("p_partkey") % 3
    attr = F.when(a == 0, "style").when(a == 1, "period").otherwise("art_style")
    s = F.col("p_size") % 5
    prompt = (F.when(s == 0, "What is the style of this painting by [author]?")
               .when(s == 1, "What style is this [year] painting?")
               .otherwise("What is the art style of this painting?"))
    return part.select("p_partkey", model.alias("model"), attr.alias("attribute"), prompt.alias("prompt"),
                       r.alias("preds"))


def _profiles(models, attrs, flags=((False, False), (True, False), (False, True))):
    return [(m, a, ha, hy) for m in models for a in attrs for ha, hy in flags]


def _profile_keys(profiles) -> list[str]:
    return [f"{m}|{a}|{str(ha).lower()}|{str(hy).lower()}" for m, a, ha, hy in profiles]


def _style_sql() -> str:
    base = (f"a AS (SELECT p_partkey, {_STYLE_MODEL_SQL} AS model, {_STYLE_ATTR_SQL} AS attribute, "
            f"{_STYLE_PROMPT_SQL} AS prompt, {_STYLE_R_SQL} AS preds FROM part), "
            f"b AS (SELECT p_partkey, model, attribute, "
            f"{S.profile_sql('model', 'attribute', 'prompt')} AS profile, "
            f"{S.fewshot(S.pre_clean('preds'))} AS x FROM a)")
    ctes, last = S.dispatch("b", "x", _profiles(_MODELS4, ["art_style", "period"]))
    return (f"WITH {base}, " + ", ".join(ctes)
            + f" SELECT p_partkey, model, attribute, x AS pred_clean FROM {last}")


@register("style_rules", "TXT11 TXT12 TXT13 TXT17 TXT4 TXT5 TXT6", sql=_style_sql())
def style_rules(spark: SparkSession, sf: str) -> DataFrame:
    a = _style_answers(table(spark, sf, "part"))
    # The binding's run profiles are known (as a manifest table would give them).
    return clean_predictions(a, profiles=_profile_keys(_profiles(_MODELS4, ["art_style", "period"]))).select(
        "p_partkey", "model", "attribute", "pred_clean")


# --- TXT14 -------------------------------------------------------------------

_AUTHOR_R_SQL = ("CASE s_suppkey % 3 WHEN 0 THEN 'Hmm. The author of this painting is ' || s_name || '. It is old.' "
                 "WHEN 1 THEN 'The author of this painting is ' || replace(s_name, '#', ' ') "
                 "ELSE 'Unknown painter ' || s_name END")


def _author_sql() -> str:
    base = (f"a AS (SELECT s_suppkey, 'OpenFlamingo|author|false|false' AS profile, "
            f"{S.fewshot(S.pre_clean(_AUTHOR_R_SQL))} AS x FROM supplier)")
    ctes, last = S.dispatch("a", "x", [("OpenFlamingo", "author", False, False)])
    return f"WITH {base}, " + ", ".join(ctes) + f" SELECT s_suppkey, x AS pred_clean FROM {last}"


@register("author_rules", "TXT14 TXT3", sql=_author_sql())
def author_rules(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey") % 3
    r = (F.when(k == 0, F.concat(F.lit("Hmm. The author of this painting is "), F.col("s_name"), F.lit(". It is old.")))
          .when(k == 1, F.concat(F.lit("The author of this painting is "), F.replace("s_name", F.lit("#"), F.lit(" "))))
          .otherwise(F.concat(F.lit("Unknown painter "), F.col("s_name"))))
    a = s.select("s_suppkey", F.lit("OpenFlamingo").alias("model"), F.lit("author").alias("attribute"),
                 F.lit("Who is the author of this painting?").alias("prompt"), r.alias("preds"))
    return clean_predictions(a, profiles=["OpenFlamingo|author|false|false"]).select("s_suppkey", "pred_clean")


# --- TXT5 / TXT7 --------------------------------------------------------------

_REMOVE_AUTHOR_SQL = (f"'This painting by ' || CASE p_size % 3 WHEN 0 THEN 'Master ' || {_CAP_SQL} "
                      f"WHEN 1 THEN {_CAP_SQL} || ' van Dyck' ELSE 'Raphael' END || ' is ' || lower(p_type) || ' art.'")


@register("remove_author", "TXT5 TXT7", sql=f"""
SELECT p_partkey, {S.op(_REMOVE_AUTHOR_SQL, ('no_author', ''))} AS answer FROM part""")
def remove_author(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_size") % 3
    who = (F.when(k == 0, F.concat(F.lit("Master "), _cap(F.col("p_name"))))
            .when(k == 1, F.concat(_cap(F.col("p_name")), F.lit(" van Dyck"))).otherwise(F.lit("Raphael")))
    r = F.concat(F.lit("This painting by "), who, F.lit(" is "), F.lower("p_type"), F.lit(" art."))
    return p.select("p_partkey", T.remove_author(r).alias("answer"))


# --- TXT6 / TXT7 --------------------------------------------------------------

_REMOVE_YEAR_SQL = ("'It was  made in ' || CAST(year(o_orderdate) AS VARCHAR) || ' by a painter ' || "
                    "CASE WHEN o_orderkey % 2 = 0 THEN 'in ' || o_orderpriority ELSE '' END || '  now.'")


@register("remove_year", "TXT6 TXT7", sql=f"""
SELECT o_orderkey, {S.op(_REMOVE_YEAR_SQL, ('no_year', ''))} AS answer FROM orders""")
def remove_year(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    r = F.concat(F.lit("It was  made in "), F.year("o_orderdate").cast("string"), F.lit(" by a painter "),
                 F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("in "), F.col("o_orderpriority")))
                  .otherwise(F.lit("")), F.lit("  now."))
    return o.select("o_orderkey", T.remove_year(r).alias("answer"))


# --- TXT8-10, TXT15-16, DOM3 ---------------------------------------------------

def _ordinal_sql(n: str) -> str:
    return (f"(CAST({n} AS VARCHAR) || CASE WHEN {n} % 100 IN (11, 12, 13) THEN 'th' WHEN {n} % 10 = 1 THEN 'st' "
            f"WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END)")


def _ordinal(n: Column) -> Column:
    suf = (F.when((n % 100).isin(11, 12, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd")
            .when(n % 10 == 3, "rd").otherwise("th"))
    return F.concat(n.cast("string"), suf)


_C = "(CAST(floor(year(o_orderdate) / 100) AS BIGINT) + 1)"
_YEAR_R_SQL = (
    "CASE o_orderkey % 4 "
    f"WHEN 0 THEN 'The painting was made in the ' || {_ordinal_sql(_C + ' - 1')} || ' century, after the ' || "
    f"{_ordinal_sql(_C + ' - 11')} || ' century.' "
    "WHEN 1 THEN 'Made in ' || CAST(year(o_orderdate) AS VARCHAR) || '.' "
    "WHEN 2 THEN 'From the ' || CAST(CAST(floor(year(o_orderdate) / 10) AS BIGINT) * 10 AS VARCHAR) || 's.' "
    "ELSE 'A very old painting.' END")
_YEAR_MODEL_SQL = "CASE o_orderkey % 3 WHEN 0 THEN 'LLaVA' WHEN 1 THEN 'OpenFlamingo' ELSE 'CLIP' END"


def _year_answers(orders: DataFrame) -> DataFrame:
    y = F.year("o_orderdate")
    c = (F.floor(y / 100) + 1).cast("bigint")
    k = F.col("o_orderkey") % 4
    r = (F.when(k == 0, F.concat(F.lit("The painting was made in the "), _ordinal(c - 1),
                                 F.lit(" century, after the "), _ordinal(c - 11), F.lit(" century.")))
          .when(k == 1, F.concat(F.lit("Made in "), y.cast("string"), F.lit(".")))
          .when(k == 2, F.concat(F.lit("From the "), (F.floor(y / 10) * 10).cast("string"), F.lit("s.")))
          .otherwise(F.lit("A very old painting.")))
    m = F.col("o_orderkey") % 3
    model = F.when(m == 0, "LLaVA").when(m == 1, "OpenFlamingo").otherwise("CLIP")
    return orders.select("o_orderkey", y.alias("year"), model.alias("model"), r.alias("preds"))


@register("century_to_year", "TXT8", sql=f"""
WITH a AS (SELECT o_orderkey, {_YEAR_R_SQL} AS r FROM orders)
SELECT o_orderkey, {S.century('r')} AS answer FROM a""")
def century_to_year(spark: SparkSession, sf: str) -> DataFrame:
    a = _year_answers(table(spark, sf, "orders"))
    return a.select("o_orderkey", T.century_to_year("preds").alias("answer"))


@register("find_year", "TXT9 TXT8", sql=f"""
WITH a AS (SELECT o_orderkey, {_YEAR_R_SQL} AS r FROM orders)
SELECT o_orderkey, {S.first_year(S.century('r'))} AS year_text FROM a""")
def find_year(spark: SparkSession, sf: str) -> DataFrame:
    a = _year_answers(table(spark, sf, "orders"))
    return a.select("o_orderkey", T.find_year(T.century_to_year("preds")).alias("year_text"))


@register("year_bucket", "TXT10 TXT9 TXT8", sql=f"""
WITH a AS (SELECT o_orderkey, year(o_orderdate) AS y, {S.first_year(S.century(_YEAR_R_SQL))} AS t FROM orders)
SELECT o_orderkey, {S.bucket('t', 100)} AS century, {S.bucket('t', 10)} AS decade,
       {S.bucket('CAST(y AS VARCHAR)', 100)} AS gt_century,
       {S.bucket('t', 100)} = {S.bucket('CAST(y AS VARCHAR)', 100)} AS correct FROM a""")
def year_bucket(spark: SparkSession, sf: str) -> DataFrame:
    a = _year_answers(table(spark, sf, "orders"))
    t = T.find_year(T.century_to_year("preds"))
    out = a.select("o_orderkey", "year", t.alias("t"))
    return out.select("o_orderkey", T.year_bucket("t", 100).alias("century"), T.year_bucket("t", 10).alias("decade"),
                      T.year_bucket("year", 100).alias("gt_century"),
                      (T.year_bucket("t", 100) == T.year_bucket("year", 100)).alias("correct"))


def _year_pipeline_sql(final: str) -> str:
    base = (f"a AS (SELECT o_orderkey, year(o_orderdate) AS y, {_YEAR_MODEL_SQL} AS model, "
            f"{_YEAR_R_SQL} AS preds FROM orders), "
            f"b AS (SELECT o_orderkey, y, model, {S.profile_sql('model', chr(39) + 'year' + chr(39), 'NULL')} "
            f"AS profile, {S.fewshot(S.pre_clean('preds'))} AS x FROM a)")
    ctes, last = S.dispatch("b", "x", [(m, "year", False, False) for m in ("LLaVA", "OpenFlamingo", "CLIP")])
    return (f"WITH {base}, " + ", ".join(ctes)
            + f", p AS (SELECT o_orderkey, model, x AS pred_clean, {S.bucket(S.first_year('x'), 100)} AS pred_year, "
              f"{S.bucket('CAST(y AS VARCHAR)', 100)} AS gt FROM {last}) " + final)


def _year_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    a = _year_answers(table(spark, sf, "orders")).withColumn("attribute", F.lit("year")) \
        .withColumn("prompt", F.lit(None).cast("string"))
    c = clean_predictions(a, profiles=[f"{m}|year|false|false" for m in ("LLaVA", "OpenFlamingo", "CLIP")])
    return c.select("o_orderkey", "model", "pred_clean",
                    T.year_bucket(T.find_year("pred_clean"), 100).alias("pred_year"),
                    T.year_bucket("year", 100).alias("gt"))


@register("year_pipeline", "TXT15 TXT16 TXT8 TXT9 TXT10",
          sql=_year_pipeline_sql("SELECT o_orderkey, model, pred_clean, pred_year, gt, pred_year = gt AS correct FROM p"))
def year_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    p = _year_pipeline(spark, sf)
    return p.withColumn("correct", F.col("pred_year") == F.col("gt"))


@register("year_domain", "DOM3", sql=_year_pipeline_sql(
    "SELECT CAST((c - 1400) / 100 AS INTEGER) AS class_idx, CAST(c AS VARCHAR) AS class, "
    "count(p.pred_year) AS n FROM range(1400, 2100, 100) AS t(c) "
    "LEFT JOIN p ON p.pred_year = CAST(c AS VARCHAR) GROUP BY c "
    "UNION ALL SELECT NULL, NULL, count(*) FROM p WHERE pred_year IS NULL OR pred_year NOT IN "
    "(SELECT CAST(c AS VARCHAR) FROM range(1400, 2100, 100) AS t(c))"))
def year_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Answers per class of the year domain, and one row without a class for those outside it: the counts add up to the answers."""
    from scorecraft.operators.domains import year_domain as dom3
    dom = dom3(spark, 100).select(F.col("class_idx").cast("int").alias("class_idx"), "class")
    # Answers are counted first; the cleaning runs once, in that pass alone.
    counts = _year_pipeline(spark, sf).groupBy("pred_year").agg(F.count(F.lit(1)).alias("n"))
    found = counts.join(F.broadcast(dom), counts["pred_year"] == dom["class"], "left").select("class_idx", "class", "n")
    zero = dom.select("class_idx", "class", F.lit(0).cast("bigint").alias("n"))
    rest = spark.range(1).select(F.lit(None).cast("int").alias("class_idx"), F.lit(None).cast("string").alias("class"), F.lit(0).cast("bigint").alias("n"))
    return (found.unionByName(zero).unionByName(rest).groupBy("class_idx", "class").agg(F.sum("n").cast("bigint").alias("n")))


# --- TXT1 / PRM4 on whole chat transcripts ---------------------------------------

@register("chat_transcripts", "TXT1 PRM4 JN1", sql=f"""
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
c AS (SELECT u.conv_id, u.turn, 'USER: <image>' || chr(10) || u.text || chr(10) || 'ASSISTANT:' AS prompt,
             'USER: <image>' || chr(10) || u.text || chr(10) || 'ASSISTANT: ' || a.text AS chat, a.text AS reply
      FROM u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)
SELECT conv_id, turn, length(prompt) AS prompt_chars, {S.pre_clean('chat')} AS answer,
       {S.pre_clean('chat')} = replace(reply, chr(10), '') AS matches
FROM c""")
def chat_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn with the assistant reply that follows it, as one chat text.

    The prompt is wrapped as a chat turn, the reply extracted back with the
    assistant marker rule; ``matches`` checks the round trip on whole texts.
    The self-join is an equi-join on (conversation, turn): unique keys, so a
    long conversation cannot concentrate rows in one task.
    """
    c = table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user_text"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("reply"))
    j = u.join(a, ["conv_id", "turn"])
    from scorecraft.operators.prompts import chat_wrap
    prompt = chat_wrap(F.col("user_text"))
    chat = F.concat(prompt, F.lit(" "), F.col("reply"))
    ans = T.assistant_extract(chat)
    return j.select("conv_id", "turn", F.length(prompt).cast("bigint").alias("prompt_chars"), ans.alias("answer"),
                    (ans == F.replace("reply", F.lit(NL), F.lit(""))).alias("matches"))
