"""Prompt construction and chat request / response batches.

The model call itself is external; these operators build the request table
(JSON-lines ready) and ingest the response table, both row-local and
shuffle-free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorecraft.functions.text import ColumnOrName, _c

# Chat wrapping and few-shot markers.
CHAT_PREFIX = "USER: <image>\n"
CHAT_SUFFIX = "\nASSISTANT:"
END_OF_CHUNK = ".<|endofchunk|>"
IMAGE_TAG = "<image>"
REQUEST_MODEL = "gpt-4o"
REQUEST_MAX_TOKENS = 300
DATA_URL_PREFIX = "data:image/jpeg;base64,"


def fill_prompt(template: ColumnOrName, author: ColumnOrName | None = None,
                year: ColumnOrName | None = None) -> Column:
    """Replace ``[author]`` (underscores -> spaces) and ``[year]`` per row.

    A placeholder is only filled when the annotation column is given; a NULL
    annotation fills it with nothing.
    """
    out = _c(template)
    if author is not None:
        out = F.replace(out, F.lit("[author]"), F.replace(F.coalesce(_c(author).cast("string"), F.lit("")), F.lit("_"), F.lit(" ")))
    if year is not None:
        out = F.replace(out, F.lit("[year]"), F.coalesce(_c(year).cast("string"), F.lit("")))
    return out


def chat_wrap(prompt: ColumnOrName) -> Column:
    return F.concat(F.lit(CHAT_PREFIX), _c(prompt), F.lit(CHAT_SUFFIX))


def two_shot(prompt: ColumnOrName, example1: ColumnOrName, example2: ColumnOrName) -> Column:
    """``<image>p+ex1.<|endofchunk|><image>p+ex2.<|endofchunk|><image>p``."""
    p = _c(prompt)
    return F.concat(F.lit(IMAGE_TAG), p, _c(example1), F.lit(END_OF_CHUNK),
                    F.lit(IMAGE_TAG), p, _c(example2), F.lit(END_OF_CHUNK),
                    F.lit(IMAGE_TAG), p)


def example_fields(file: ColumnOrName) -> dict[str, Column]:
    """Fields of an example file named ``Style_Author_Title_Year.jpg``."""
    f = _c(file)
    return {
        "style": F.split_part(f, F.lit("_"), F.lit(1)),
        "author": F.split_part(f, F.lit("_"), F.lit(2)),
        "year": F.substring_index(F.substring_index(f, "_", -1), ".jpg", 1),
    }


def example_for(file: ColumnOrName, attribute: str) -> Column:
    fields = example_fields(file)
    key = {"art_style": "style", "period": "style", "style": "style",
           "author": "author", "year": "year"}[attribute]
    return fields[key]


def base64_text(b: ColumnOrName) -> Column:
    """Unchunked base64 regardless of the session's chunking setting."""
    return F.replace(F.base64(_c(b)), F.lit("\r\n"), F.lit(""))


REQUEST_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()),
        T.StructField("content", T.ArrayType(T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("image_url", T.StructType([T.StructField("url", T.StringType())])),
        ]))),
    ]))),
    T.StructField("max_tokens", T.IntegerType()),
])


def chat_request(prompt: ColumnOrName, payload: ColumnOrName, model: str = REQUEST_MODEL,
                 max_tokens: int = REQUEST_MAX_TOKENS) -> Column:
    """Nested chat request struct with the payload as a base64 data URL."""
    text_part = F.struct(F.lit("text").alias("type"), _c(prompt).alias("text"),
                         F.lit(None).cast("struct<url:string>").alias("image_url"))
    image_part = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
                          F.struct(F.concat(F.lit(DATA_URL_PREFIX), base64_text(payload)).alias("url"))
                          .alias("image_url"))
    msg = F.struct(F.lit("user").alias("role"), F.array(text_part, image_part).alias("content"))
    return F.struct(F.lit(model).alias("model"), F.array(msg).alias("messages"),
                    F.lit(max_tokens).alias("max_tokens"))


def request_batch(df: DataFrame, prompt: ColumnOrName, payload: ColumnOrName,
                  keys: list[str]) -> DataFrame:
    """``(keys..., request_json)``; write with ``.write.text`` or ``.json``."""
    return df.select(*keys, F.to_json(chat_request(prompt, payload)).alias("request_json"))


RESPONSE_SCHEMA = "choices array<struct<message:struct<content:string>>>, error struct<message:string>"


def response_content(body: ColumnOrName) -> DataFrame | Column:
    """``choices[0].message.content``; NULL when absent or when the body is not JSON."""
    parsed = F.from_json(_c(body), RESPONSE_SCHEMA, {"mode": "PERMISSIVE"})
    return F.get(parsed["choices"], 0)["message"]["content"]


def ingest_responses(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``content`` and ``error``: ``invalid_json``, ``no_choices``, ``empty_choices``, ``no_content``, else NULL.

    Without an error there is a content.
    """
    b = F.col(body)
    # Spark's JSON parser returns a struct of NULLs for non-JSON input in
    # PERMISSIVE mode; json_object_keys is NULL exactly when the body is not
    # a JSON object.
    keys = F.json_object_keys(b)
    return (df.withColumn("content", response_content(b))
              .withColumn("error", F.when(keys.isNull(), F.lit("invalid_json"))
                          .when(~F.array_contains(keys, "choices"), F.lit("no_choices"))
                          .when(F.get_json_object(b, "$.choices[0]").isNull(), F.lit("empty_choices"))
                          .when(F.col("content").isNull(), F.lit("no_content"))))


def image_requests(annotations: DataFrame, images: DataFrame, prompt: ColumnOrName,
                   keys: list[str] | None = None) -> DataFrame:
    """Request batch for annotated images: annotations joined to image bytes on ``file``.

    ``images`` is the ``binaryFile`` table (``file``, ``content``).  The join is
    an equi-join on the file key; Spark picks broadcast or shuffle from sizes,
    and files without an annotation (or the reverse) produce no request.
    """
    keys = keys or ["file"]
    cols = keys if "file" in keys else ["file", *keys]
    ann = annotations.select(*cols, _c(prompt).alias("_prompt"))
    joined = ann.join(images.select("file", "content"), "file")
    return request_batch(joined, F.col("_prompt"), F.col("content"), keys)
