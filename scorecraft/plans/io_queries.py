"""Domains, prompts, joins, request/response batches, text vectors and audits.

Bindings: ``part``/``orders``/``customer``/``supplier`` for labels, domains and
prompts; ``documents``/``labels``/``benchmark`` for scoring, text vectors and
audits; ``pages``/``events`` for request and response batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.functions import text as T
from scorecraft.operators import audit as A
from scorecraft.operators import domains as D
from scorecraft.operators import metrics as M
from scorecraft.operators import prompts as P
from scorecraft.operators.encode import token_nearest
from scorecraft.plans.evaluate import attach_manifest
from scorecraft.plans.registry import register, table
from scorecraft.session import bounded_broadcast
from scorecraft.sources.files import run_identity

# Parameters of the bindings below.
PART_TYPE_ORDER = ["SMALL", "MEDIUM", "LARGE", "ECONOMY", "STANDARD", "PROMO"]
FILL_TEMPLATE = "Is this painting by [author] from [year]?"
SECOND_EXAMPLE = "Realism_David_Marat_1793.jpg"
CLASS_PROMPT = "the art style of the painting is "
PLACEHOLDER_PROMPT = "a painting in the [art_style] style"
REQUEST_TEXT = "Describe this page: "
LIMIT_N = 100


def _norm_sql(c: str) -> str:
    return f"lower(replace(CAST({c} AS VARCHAR), '_', ' '))"


# --- PRJ1 / PRJ2 ---------------------------------------------------------------

@register("normalise_label", "PRJ1 PRJ2", sql=f"""
WITH u AS (SELECT 'p_type' AS source, p_type AS raw FROM part
           UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders
           UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer
           UNION ALL SELECT 's_name', replace(s_name, '#', '_') FROM supplier)
SELECT source, raw, {_norm_sql('raw')} AS normalised, count(*) AS n FROM u GROUP BY source, raw""")
def normalise_label(spark: SparkSession, sf: str) -> DataFrame:
    u = (table(spark, sf, "part").select(F.lit("p_type").alias("source"), F.col("p_type").alias("raw"))
         .unionByName(table(spark, sf, "orders").select(F.lit("o_orderpriority").alias("source"),
                                                          F.col("o_orderpriority").alias("raw")))
         .unionByName(table(spark, sf, "customer").select(F.lit("c_mktsegment").alias("source"),
                                                            F.col("c_mktsegment").alias("raw")))
         .unionByName(table(spark, sf, "supplier").select(F.lit("s_name").alias("source"),
                                                            F.replace("s_name", F.lit("#"), F.lit("_")).alias("raw"))))
    return (u.groupBy("source", "raw").agg(F.count(F.lit(1)).alias("n"))
             .select("source", "raw", T.normalise_label("raw").alias("normalised"), "n"))


# --- DOM1 / DOM2 / DOM5 ----------------------------------------------------------

@register("class_domain", "DOM1 DOM2 DOM5 SRT1", sql=f"""
WITH a AS (SELECT DISTINCT {_norm_sql('p_type')} AS c FROM part),
b AS (SELECT DISTINCT {_norm_sql('o_orderpriority')} AS c FROM orders UNION SELECT 'unknown')
SELECT 'p_type' AS domain, CAST(row_number() OVER (ORDER BY c) - 1 AS INTEGER) AS class_idx, c AS class FROM a
UNION ALL
SELECT 'o_orderpriority+unknown', CAST(row_number() OVER (ORDER BY c) - 1 AS INTEGER), c FROM b""")
def class_domain(spark: SparkSession, sf: str) -> DataFrame:
    a = D.sorted_domain(table(spark, sf, "part"), "p_type").withColumn("domain", F.lit("p_type"))
    b = D.domain_with_unknown(table(spark, sf, "orders"), "o_orderpriority") \
        .withColumn("domain", F.lit("o_orderpriority+unknown"))
    return a.unionByName(b).select("domain", "class_idx", "class")


# --- DOM4 --------------------------------------------------------------------

def _values_sql(items: list[str]) -> str:
    return ", ".join(f"({i}, '{s}')" for i, s in enumerate(items))


@register("class_order", "DOM4", sql=f"""
WITH o AS (SELECT * FROM (VALUES {_values_sql(PART_TYPE_ORDER)}) AS v(pos, label)),
c AS (SELECT {_norm_sql('p_type')} AS class, count(*) AS n FROM part GROUP BY ALL)
SELECT CAST(o.pos AS INTEGER) AS class_idx, {_norm_sql('o.label')} AS class, coalesce(c.n, 0) AS n
FROM o LEFT JOIN c ON c.class = {_norm_sql('o.label')}""")
def class_order(spark: SparkSession, sf: str) -> DataFrame:
    dom = D.ordered_domain(spark, "part", {"part": PART_TYPE_ORDER})
    counts = (table(spark, sf, "part").select(T.normalise_label("p_type").alias("class"))
              .join(F.broadcast(dom.select("class")), "class", "left_semi")
              .groupBy("class").agg(F.count(F.lit(1)).alias("n")))
    return (dom.join(counts, "class", "left")
               .select("class_idx", "class", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


# --- PRM2 / PRM3 -------------------------------------------------------------

@register("class_prompts", "PRM2 PRM3", sql=f"""
WITH a AS (SELECT DISTINCT {_norm_sql('p_type')} AS class FROM part)
SELECT CAST(row_number() OVER (ORDER BY class) - 1 AS INTEGER) AS class_idx, class,
       '{CLASS_PROMPT}' || class AS prompt_suffix,
       replace('{PLACEHOLDER_PROMPT}', '[art_style]', class) AS prompt_placeholder
FROM a""")
def class_prompts(spark: SparkSession, sf: str) -> DataFrame:
    dom = D.sorted_domain(table(spark, sf, "part"), "p_type")
    a = D.class_prompts(dom, CLASS_PROMPT).withColumnRenamed("class_prompt", "prompt_suffix")
    return D.class_prompts(a, PLACEHOLDER_PROMPT, "art_style") \
        .withColumnRenamed("class_prompt", "prompt_placeholder") \
        .select("class_idx", "class", "prompt_suffix", "prompt_placeholder")


# --- JN1 / PRM1 / PRM4 -------------------------------------------------------------

def _orders_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation join: every order with its customer (equi-join on the key).

    The customer side is broadcast only when its row count is proven small;
    beyond that Spark shuffles both sides on the key (customer keys are unique,
    so the join itself cannot be skewed by a hot customer on that side).
    """
    cust, _ = bounded_broadcast(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.join(cust, o["o_custkey"] == cust["c_custkey"])


@register("annotation_join", "JN1 PRJ2", sql=f"""
SELECT o_orderkey, c_name, {_norm_sql('c_mktsegment')} AS gt
FROM orders JOIN customer ON o_custkey = c_custkey""")
def annotation_join(spark: SparkSession, sf: str) -> DataFrame:
    j = _orders_customers(spark, sf)
    return j.select("o_orderkey", "c_name", T.normalise_label("c_mktsegment").alias("gt"))


@register("prompt_fill", "PRM1 PRM4", sql=f"""
SELECT o_orderkey,
       'USER: <image>' || chr(10) ||
       replace(replace('{FILL_TEMPLATE}', '[author]', replace(replace(c_name, '#', '_'), '_', ' ')),
               '[year]', CAST(year(o_orderdate) AS VARCHAR)) || chr(10) || 'ASSISTANT:' AS prompt
FROM orders JOIN customer ON o_custkey = c_custkey""")
def prompt_fill(spark: SparkSession, sf: str) -> DataFrame:
    j = _orders_customers(spark, sf)
    filled = P.fill_prompt(F.lit(FILL_TEMPLATE), F.replace("c_name", F.lit("#"), F.lit("_")), F.year("o_orderdate"))
    return j.select("o_orderkey", P.chat_wrap(filled).alias("prompt"))


# --- SRC7 / PRM5 -----------------------------------------------------------------

_FILE_SQL = ("p_type || '_' || replace(p_brand, '#', '') || '_' || replace(p_name, ' ', '-') || '_' || "
             "CAST(1990 + p_size AS VARCHAR) || '.jpg'")


def _example_file(c: Column | None = None) -> Column:
    return F.concat(F.col("p_type"), F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_"),
                    F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"),
                    (F.lit(1990) + F.col("p_size")).cast("string"), F.lit(".jpg"))


def _fields_sql(f: str) -> tuple[str, str, str]:
    return (f"split_part({f}, '_', 1)", f"split_part({f}, '_', 2)",
            f"split_part(string_split({f}, '_')[-1], '.jpg', 1)")


@register("filename_fields", "SRC7", sql=f"""
WITH a AS (SELECT p_partkey, {_FILE_SQL} AS f FROM part)
SELECT p_partkey, f AS file, {_fields_sql('f')[0]} AS style, {_fields_sql('f')[1]} AS author,
       {_fields_sql('f')[2]} AS year FROM a""")
def filename_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", _example_file().alias("file"))
    fields = P.example_fields("file")
    return p.select("p_partkey", "file", *[v.alias(k) for k, v in fields.items()])


_ATTR_PROMPTS = {"art_style": "The art style of this painting is ", "author": "The author of this painting is ",
                 "year": "This painting was made in "}


def _fewshot_sql() -> str:
    s1, a1, y1 = _fields_sql("f")
    s2, a2, y2 = _fields_sql(f"'{SECOND_EXAMPLE}'")
    p = ("CASE attribute WHEN 'art_style' THEN '{0}' WHEN 'author' THEN '{1}' ELSE '{2}' END"
         .format(*_ATTR_PROMPTS.values()))
    e1 = f"CASE attribute WHEN 'art_style' THEN {s1} WHEN 'author' THEN {a1} ELSE {y1} END"
    e2 = f"CASE attribute WHEN 'art_style' THEN {s2} WHEN 'author' THEN {a2} ELSE {y2} END"
    return f"""
WITH a AS (SELECT p_partkey, {_FILE_SQL} AS f,
                  CASE p_partkey % 3 WHEN 0 THEN 'art_style' WHEN 1 THEN 'author' ELSE 'year' END AS attribute
           FROM part),
b AS (SELECT p_partkey, attribute, {p} AS p, {e1} AS e1, {e2} AS e2 FROM a)
SELECT p_partkey, attribute,
       '<image>' || p || e1 || '.<|endofchunk|>' || '<image>' || p || e2 || '.<|endofchunk|>' || '<image>' || p AS prompt
FROM b"""


@register("few_shot_prompt", "PRM5 SRC7", sql=_fewshot_sql())
def few_shot_prompt(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    attr = F.when(k == 0, "art_style").when(k == 1, "author").otherwise("year")
    p = table(spark, sf, "part").select("p_partkey", _example_file().alias("f"), attr.alias("attribute"))

    def by_attr(values: dict[str, Column]) -> Column:
        a = F.col("attribute")
        return F.when(a == "art_style", values["art_style"]).when(a == "author", values["author"]) \
            .otherwise(values["year"])

    prompt = by_attr({k: F.lit(v) for k, v in _ATTR_PROMPTS.items()})
    ex1 = by_attr({a: P.example_for("f", a) for a in _ATTR_PROMPTS})
    ex2 = by_attr({a: P.example_for(F.lit(SECOND_EXAMPLE), a) for a in _ATTR_PROMPTS})
    return p.select("p_partkey", "attribute", P.two_shot(prompt, ex1, ex2).alias("prompt"))


# --- SRC6 / JN4 / AU4 ----------------------------------------------------------

_FOLDER_SQL = ("replace(p_brand, 'Brand#', 'DS') || '_' || CASE p_size % 4 WHEN 0 THEN 'style' "
               "WHEN 1 THEN 'styleGivenAuthor' WHEN 2 THEN 'styleGivenAuthorAndYear' ELSE 'year' END || '_' || "
               "CASE p_size % 3 WHEN 0 THEN 'LLaVa' WHEN 1 THEN 'CLIP' ELSE 'GPT-4o' END")


def _folder() -> Column:
    a, m = F.col("p_size") % 4, F.col("p_size") % 3
    attr = (F.when(a == 0, "style").when(a == 1, "styleGivenAuthor").when(a == 2, "styleGivenAuthorAndYear")
             .otherwise("year"))
    model = F.when(m == 0, "LLaVa").when(m == 1, "CLIP").otherwise("GPT-4o")
    return F.concat_ws("_", F.replace("p_brand", F.lit("Brand#"), F.lit("DS")), attr, model)


def _manifest_attr(raw: Column, dataset: Column) -> Column:
    """What a run's manifest declares (one dataset deliberately contradicts its folders)."""
    return (F.when((raw == "year") & (dataset == "DS13"), "art_style")
             .when(raw.startswith("style"), "art_style").otherwise(raw))


@register("run_identity", "SRC6 JN4 AU4", sql=f"""
WITH r AS (SELECT {_FOLDER_SQL} AS run FROM part),
p AS (SELECT run, split_part(run, '_', 1) AS dataset,
             split_part(regexp_extract(run, '^[^_]*_(.*)_[^_]*$', 1), 'Given', 1) AS attribute_raw,
             split_part(regexp_extract(run, '^[^_]*_(.*)_[^_]*$', 1), 'Given', 2) AS given,
             string_split(run, '_')[-1] AS model_raw, count(*) AS n
      FROM r GROUP BY run),
m AS (SELECT DISTINCT run, CASE WHEN attribute_raw = 'year' AND dataset = 'DS13' THEN 'art_style'
                               WHEN starts_with(attribute_raw, 'style') THEN 'art_style' ELSE attribute_raw END
                           AS manifest_attribute FROM p)
SELECT p.run, dataset, attribute_raw,
       CASE attribute_raw WHEN 'style' THEN 'art_style' ELSE attribute_raw END AS attribute,
       contains(given, 'Author') AS given_author, contains(given, 'Year') AS given_year,
       CASE lower(model_raw) WHEN 'clip' THEN 'CLIP' WHEN 'llava' THEN 'LLaVA' WHEN 'openflamingo' THEN 'OpenFlamingo'
            WHEN 'gpt-4o' THEN 'GPT-4o' ELSE model_raw END AS model,
       m.manifest_attribute,
       m.manifest_attribute <> CASE attribute_raw WHEN 'style' THEN 'art_style' ELSE attribute_raw END
         AS attribute_mismatch,
       n
FROM p JOIN m ON m.run = p.run""")
def run_identity_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(_folder().alias("run"))
    per_run = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    ident = run_identity("run")
    parsed = per_run.select("n", *[v.alias(k) for k, v in ident.items()])
    manifests = parsed.select("run", _manifest_attr(F.col("attribute_raw"), F.col("dataset"))
                              .alias("manifest_attribute")).distinct()
    manifests, _ = bounded_broadcast(manifests)
    j = attach_manifest(parsed, manifests.withColumn("prompt", F.lit(None).cast("string")))
    # one row a run: the audit's findings, joined back as a flag
    drift = A.manifest_attribute_drift(j).select("run", F.lit(True).alias("_drift"))
    return j.join(drift, "run", "left").select(
        "run", "dataset", "attribute_raw", "attribute", "given_author", "given_year", "model",
        "manifest_attribute", F.coalesce("_drift", F.lit(False)).alias("attribute_mismatch"), "n")


# --- AGG2 / LIM1 / PRJ5 ----------------------------------------------------------

@register("accuracy_all", "AGG2", sql="""
WITH s AS (SELECT CAST(d.n_chars > 1000 AS INTEGER) AS gt, l.quality AS pred
           FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
t AS (SELECT count(*) AS n_total FROM documents)
SELECT t.n_total, count(*) AS n_scored,
       CAST(sum(CASE WHEN gt IS NOT NULL AND pred IS NOT DISTINCT FROM gt THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(100.0 * sum(CASE WHEN gt IS NOT NULL AND pred IS NOT DISTINCT FROM gt THEN 1 ELSE 0 END) / count(*), 6)
         AS accuracy_scored,
       round(100.0 * sum(CASE WHEN gt IS NOT NULL AND pred IS NOT DISTINCT FROM gt THEN 1 ELSE 0 END) / t.n_total, 6)
         AS accuracy_all
FROM s, t GROUP BY t.n_total""")
def accuracy_all(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    scored = docs.join(labels, "doc_id").select((F.col("n_chars") > 1000).cast("int").alias("gt"),
                                               F.col("quality").alias("pred"))
    acc = M.accuracy_over(M.pair_counts(scored, []), [], docs.agg(F.count(F.lit(1)).alias("n_total")))
    return acc.select("n_total", F.col("n").cast("bigint").alias("n_scored"),
                      F.col("correct").cast("bigint").alias("correct"),
                      F.round("accuracy", 6).alias("accuracy_scored"),
                      F.round("accuracy_all", 6).alias("accuracy_all"))


@register("limit_n", "LIM1 PRJ5", sql=f"""
WITH t AS (SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT {LIMIT_N})
SELECT t.doc_id, CAST(t.n_chars > 1000 AS INTEGER) AS gt, coalesce(CAST(l.quality AS VARCHAR), '') AS pred
FROM t LEFT JOIN labels l ON l.doc_id = t.doc_id""")
def limit_n(spark: SparkSession, sf: str, n: int = LIMIT_N) -> DataFrame:
    """First ``n`` documents in key order (``n = -1``: all), with their labels.

    The limit runs first (``first_n``: top-k for small n, a range-partitioned
    cut for large n); for a small n the labels are cut to those keys with a
    broadcast semi-join, so no full join of the two tables happens.
    """
    from scorecraft.operators.ordering import first_n
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    top = first_n(docs, "doc_id", n)
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    if 0 <= n <= 100_000:
        labels = labels.join(F.broadcast(top.select("doc_id")), "doc_id", "left_semi")
    return (top.join(labels, "doc_id", "left")
               .select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("gt"),
                       T.null_to_empty("quality").alias("pred")))


@register("null_preds", "PRJ5", sql="""
SELECT coalesce(CAST(l.quality AS VARCHAR), '') AS pred_clean, count(*) AS n
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL""")
def null_preds(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return (docs.join(labels, "doc_id", "left")
                .groupBy(T.null_to_empty("quality").alias("pred_clean")).agg(F.count(F.lit(1)).alias("n")))


# --- VEC1 ----------------------------------------------------------------------

_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+', 0)"


@register("text_vectors", "VEC1 VEC3 VEC4 VEC5", sql=f"""
WITH dt AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
dtf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM dtf GROUP BY doc_id),
bt AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
btf AS (SELECT item_id, term, count(*) AS tf FROM bt GROUP BY ALL),
bn AS (SELECT item_id, sqrt(sum(tf * tf)) AS norm FROM btf GROUP BY item_id),
pairs AS (SELECT d.doc_id, b.item_id, sum(d.tf * b.tf) AS dot FROM dtf d JOIN btf b USING (term) GROUP BY ALL),
cos AS (SELECT p.doc_id, p.item_id, p.dot / (dn.norm * bn.norm) AS cosine
        FROM pairs p JOIN dn USING (doc_id) JOIN bn USING (item_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(cosine, 9) DESC, item_id) AS rn FROM cos)
SELECT d.doc_id, b.item_id, round(coalesce(b.cosine, 0.0), 6) AS cosine
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.rn = 1""")
def text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    bench = table(spark, sf, "benchmark").select("item_id", "text")
    best = token_nearest(docs, "doc_id", "text", bench, "item_id", "text")
    return best.select("doc_id", "item_id", F.round("cosine", 6).alias("cosine"))


# --- REQ1 / RSP1 ---------------------------------------------------------------

@register("request_batch", "REQ1", sql=f"""
WITH u AS (SELECT page_id, url, 'data:image/jpeg;base64,' || to_base64(encode(html)) AS data_url FROM pages)
SELECT page_id, 'gpt-4o' AS model, 300 AS max_tokens, '{REQUEST_TEXT}' || url AS text,
       length(data_url) AS url_len, md5(data_url) AS url_md5
FROM u""")
def request_batch(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    req = P.request_batch(pages, F.concat(F.lit(REQUEST_TEXT), F.col("url")), F.col("html").cast("binary"),
                          ["page_id"])
    j = F.col("request_json")
    url = F.get_json_object(j, "$.messages[0].content[1].image_url.url")
    return req.select("page_id", F.get_json_object(j, "$.model").alias("model"),
                      F.get_json_object(j, "$.max_tokens").cast("int").alias("max_tokens"),
                      F.get_json_object(j, "$.messages[0].content[0].text").alias("text"),
                      F.length(url).cast("bigint").alias("url_len"), F.md5(url).alias("url_md5"))


_BODY_SQL = ("CASE event_id % 3 WHEN 0 THEN '{\"choices\":[{\"message\":{\"content\":\"' || event_type || ':' || "
             "coalesce(json_extract_string(props, '$.k'), '') || '\"}}]}' "
             "WHEN 1 THEN '{\"error\":{\"message\":\"rate limit\",\"code\":' || CAST(user_id AS VARCHAR) || '}}' "
             "ELSE 'not json ' || CAST(event_id AS VARCHAR) END")


@register("response_ingest", "RSP1", sql=f"""
WITH b AS (SELECT event_id, {_BODY_SQL} AS body FROM events)
SELECT event_id,
       CASE WHEN json_valid(body) THEN json_extract_string(body, '$.choices[0].message.content') END AS content,
       CASE WHEN NOT json_valid(body) THEN 'invalid_json'
            WHEN json_extract(body, '$.choices') IS NULL THEN 'no_choices' END AS error
FROM b""")
def response_ingest(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    k = F.col("event_id") % 3
    body = (F.when(k == 0, F.concat(F.lit('{"choices":[{"message":{"content":"'), F.col("event_type"), F.lit(":"),
                                    F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), F.lit('"}}]}')))
             .when(k == 1, F.concat(F.lit('{"error":{"message":"rate limit","code":'),
                                    F.col("user_id").cast("string"), F.lit("}}")))
             .otherwise(F.concat(F.lit("not json "), F.col("event_id").cast("string"))))
    out = P.ingest_responses(ev.select("event_id", body.alias("body")))
    return out.select("event_id", "content", "error")


# --- AU1 -----------------------------------------------------------------------

@register("audit_unmatched", "AU1", sql="""
SELECT 'documents_without_label' AS side,
       (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS n
UNION ALL
SELECT 'labels_without_document',
       (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id))""")
def audit_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    found = A.unmatched_files(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "doc_id")
    names = F.when(F.col("side") == "results_only", "documents_without_label").otherwise("labels_without_document")
    zero = spark.createDataFrame([("documents_without_label", 0), ("labels_without_document", 0)], "side string, n long")
    counts = found.groupBy(names.alias("side")).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(zero).groupBy("side").agg(F.sum("n").alias("n"))


# --- AU2 / AU3 / JN4 -------------------------------------------------------------

@register("gt_disagreements", "AU2", sql="""
SELECT CAST(p_partkey AS VARCHAR) AS images, CASE WHEN p_partkey % 7 = 0 THEN 'Brand 99' WHEN p_partkey % 11 = 0 THEN NULL
       ELSE replace(p_brand, '#', '_') END AS gt, lower(replace(p_brand, '#', ' ')) AS annotated
FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0""")
def gt_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    """Stored ground truths (some altered, some missing) that differ from the annotated brand once both are normalised."""
    p, key = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    gt = F.when(F.col("p_partkey") % 7 == 0, "Brand 99").when(F.col("p_partkey") % 11 == 0, None).otherwise(F.replace("p_brand", F.lit("#"), F.lit("_")))
    results = p.select(key.alias("images"), gt.alias("gt"))
    annotations = p.select(key.alias("file"), F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"))
    return A.gt_disagreements(results, annotations, "brand").select("images", "gt", "annotated")


@register("runs_without_results", "AU3", sql=f"""
WITH r AS (SELECT {_FOLDER_SQL} AS run, p_retailprice FROM part)
SELECT DISTINCT run FROM r WHERE run NOT IN (SELECT run FROM r WHERE p_retailprice % 100 > 60 AND run NOT LIKE 'DS13%')""")
def runs_without_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's run has a manifest, only some parts have a stored answer."""
    rows = table(spark, sf, "part").select(_folder().alias("run"), "p_retailprice")
    results = rows.where((F.col("p_retailprice") % 100 > 60) & ~F.col("run").startswith("DS13"))
    return A.runs_without_results(rows, results)


@register("manifest_join", "JN4", sql=f"""
WITH r AS (SELECT {_FOLDER_SQL} AS run, p_partkey, p_size FROM part),
m AS (SELECT DISTINCT run, 'Which style? (' || run || ')' AS prompt, split_part(run, '_', 2) AS manifest_attribute FROM r WHERE run NOT LIKE '%GPT-4o')
SELECT r.run, r.p_partkey, m.prompt, m.manifest_attribute FROM r LEFT JOIN m USING (run)""")
def manifest_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows joined to the manifest of their run; one model's runs have none."""
    rows = table(spark, sf, "part").select(_folder().alias("run"), "p_partkey")
    manifests = rows.where(~F.col("run").endswith("GPT-4o")).select("run").distinct().select(
        "run", F.concat(F.lit("Which style? ("), "run", F.lit(")")).alias("prompt"), F.split_part("run", F.lit("_"), F.lit(2)).alias("manifest_attribute"))
    return attach_manifest(rows, manifests).select("run", "p_partkey", "prompt", "manifest_attribute")
