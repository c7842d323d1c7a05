"""I-Match fingerprints: the terms of a document within a band of inverse document frequency, sorted and hashed.

DataFrame operations only.  Document frequencies are counted over all documents.
Terms that are neither everyday nor nearly unique make the lexicon; each of
several random subsets of it, drawn at several rates, gives one hash of a
document's sorted distinct terms in the subset.  A subset of a low rate
seldom holds one of the terms in which two documents differ, so the share of equal hashes
tells near copies from texts that only share a part.

Each text is shuffled once, to the bucket of its doc_id in ascending order, where it meets the text
that follows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorecraft.llm.common import stored
from scorecraft.session import bounded_broadcast, suggested_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms are runs of ASCII letters, digits and all code points beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Of ln(N / df) / ln(N): 0 for a term of all documents, 1 for a term of one.
BAND = (0.1, 0.9)
#: (number of subsets, one in how many terms).  The first is the whole lexicon; the low rates tell long texts apart.
RATES = ((1, 1), (6, 2), (6, 8), (6, 32), (6, 128), (6, 512), (6, 2048))
# A lexicon of up to so many terms is broadcast, as pairs of numbers (about 32 bytes each, so 64 MB).
MAX_LEXICON = 2_000_000
# So many of the terms below the band are taken out of a text before its terms are looked up; the look-up would drop them too.
EVERYDAY = 1_000
# From so many equal rows (doc_id and text) on, a group is collapsed before the texts are shuffled.
HOT_ROWS = 10_000


def terms(text: Column) -> Column:
    """Distinct terms of a text, A-Z lower-cased."""
    # lower() does the same to ASCII, byte by byte; translate() looks every code point up
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_distinct(F.array_remove(F.split(low, BETWEEN), ""))


def subset_rates(rates: tuple = RATES) -> list[int]:
    return [rate for n, rate in rates for _ in range(n)]


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df, known): documents that hold each term, and its inverse document frequency from 0 (all) to 1 (one)."""
    total = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    # explode_outer: for explode the optimizer would work out the terms once more in a filter
    df = docs.select(F.explode_outer(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = total.scalar()
    return df.where("term IS NOT NULL").withColumn("known", F.when(n > 1, F.log(n / F.col("df")) / F.log(n)).otherwise(F.lit(0.0)))


def lexicon(frequencies: DataFrame, band: tuple[float, float] = BAND, rates: tuple = RATES) -> DataFrame:
    """(code, subsets): terms within the band by their 64-bit hash, and the subsets (63 at most) that hold each, as bits of a number.

    Subset k holds one in ``rate`` terms: those whose md5 of ``k|term``, read as a number from its first 8 hex digits, is divisible by the rate.
    """
    kept = frequencies.where((F.col("known") >= band[0]) & (F.col("known") <= band[1]))
    mask = F.lit(0).cast("long")
    for k, rate in enumerate(subset_rates(rates)):
        drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}|"), F.col("term"))), 1, 8), 16, 10).cast("long") % rate == 0
        mask = mask.bitwiseOR(F.when(F.lit(rate == 1) | drawn, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return kept.select(F.xxhash64("term").alias("code"), mask.alias("subsets"))


def rare_subsets(rates: tuple) -> list[list[int]]:
    """Subsets that are looked for among a part of the terms only: those of a rate of 8 or more, of 32 or more, and of 128 or more."""
    listed = list(enumerate(subset_rates(rates)))
    return [[k for k, rate in listed if least <= rate < most] for least, most in ((8, 32), (32, 128), (128, 1 << 62))]


def _any_of(subsets: list[int]) -> Callable[[Column], Column]:
    return lambda t: t["subsets"].bitwiseAND(F.lit(sum(1 << k for k in subsets)).cast("long")) != 0


def _hashes(side: str, rates: tuple) -> Column:
    """One hash per subset of the sorted (term, subsets, in) in column ``side``; empty where a subset holds none of them.

    Columns ``side``_0, ``side``_1 and ``side``_2 hold its terms that are in any of the rare subsets of each kind.
    A document without a term of the lexicon takes column ``side``_bare, the hash of all its terms, for every subset.
    """
    rare = {k: f"{side}_{i}" for i, ks in enumerate(rare_subsets(rates)) for k in ks}
    n_subsets = len(subset_rates(rates))
    held = [F.col(side) if rate == 1 else F.filter(rare.get(k, side), _any_of([k])) for k, rate in enumerate(subset_rates(rates))]
    joined = F.array(*[F.array_join(h["term"], " ") for h in held])
    of = F.transform(joined, lambda j: F.when(j == "", "").otherwise(F.substring(F.md5(j), 1, 8)))
    return F.when(F.size(side) > 0, of).otherwise(F.array_repeat(F.col(f"{side}_bare"), n_subsets))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either document has a term; 1 for equal fingerprints."""
    either = F.zip_with(a, b, lambda x, y: (x != "") | (y != ""))
    same = F.zip_with(a, b, lambda x, y: (x == y) & (x != ""))
    count = lambda c: F.size(F.filter(c, lambda x: x))
    return count(same) / F.greatest(count(either), F.lit(1))


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, tail, doc_id, h, m, text): every text in the bucket of its place by (doc_id, md5 of the text), NULL ids first.

    Each bucket also holds the first text of the next one (the last bucket that of the first) with ``tail`` true, so that
    whatever follows a text lies in its bucket.  ``m`` is the number of equal rows that a row stands for.
    """
    light = docs.select("doc_id", F.md5("text").alias("h"))
    # several buckets a partition: they are dealt out by hash, which evens out their sizes
    n, parts = 6 * suggested_partitions(docs), 2 * suggested_partitions(docs)
    classes = stored(light.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("m")).repartitionByRange(n, "doc_id", "h")
                     .withColumn("part", F.spark_partition_id()), "imatch-order")
    firsts = [r["s"] for r in classes.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("s"))
              .orderBy("part").collect()]  # one row per range, a number chosen above
    schema = "known boolean, doc_id long, h string"
    edges = docs.sparkSession.createDataFrame([tuple(f) for f in firsts], schema).agg(
        F.sort_array(F.collect_list(F.struct("known", "doc_id", "h"))).alias("edges"))
    edge = edges.scalar()
    own = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")
    # binary search for the last edge that is not beyond the row
    steps = max(1, len(firsts).bit_length())
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    n_edges = max(1, len(firsts))

    hot, _ = bounded_broadcast(classes.where(F.col("m") > HOT_ROWS).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("m").alias("_m")))
    rows = docs.select("doc_id", "text", F.md5("text").alias("h")).join(
        hot, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    cold = rows.where("_m IS NULL").select("doc_id", "h", F.lit(1).cast("long").alias("m"), "text")
    warm = rows.where("_m IS NOT NULL").groupBy("doc_id", "h").agg(F.max("_m").alias("m"), F.first("text").alias("text"))
    every = cold.unionByName(warm).withColumn("edges", edge).withColumn("own", own)
    at = F.aggregate(powers, F.lit(0), lambda a, p: F.when(
        (a + p <= n_edges) & (F.element_at("edges", F.least(a + p, F.lit(n_edges))) <= F.col("own")), a + p).otherwise(a))
    placed = every.withColumn("at", F.greatest(at, F.lit(1)) - 1)
    # of equal rows any one may stand as the next bucket's tail: they have the same text
    leads = F.element_at("edges", F.col("at") + 1) == F.col("own")
    before = F.when(leads, F.pmod(F.col("at") - 1, F.lit(n_edges)))
    both = F.array_compact(F.array(F.struct(F.col("at").alias("bucket"), F.lit(False).alias("tail")),
                                   F.when(leads, F.struct(before.alias("bucket"), F.lit(True).alias("tail")))))
    return (placed.select("doc_id", "h", "m", "text", F.explode(both).alias("p")).select("p.bucket", "p.tail", "doc_id", "h", "m", "text")
            .repartition(parts, "bucket"))


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND, rates: tuple = RATES, max_lexicon: int = MAX_LEXICON) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs`` (doc_id, text).

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the
    next document in ascending order of doc_id (after the last: the first); it is made, hashed and fingerprinted whole.
    A fingerprint is a row of hashes joined by ``-``, one a subset, empty where the subset holds none of the document's terms.

    A NULL text counts as empty.  Texts without a term of the lexicon are hashed by all their terms; those without any term are alike.
    NULL doc_ids come first; rows of one doc_id follow each other by the md5 of their text, equal rows after one another;
    a single row is followed by itself.  Repeated rows stay, an empty table gives no rows, other columns are not read.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    frequencies = stored(term_frequencies(whole), "imatch-terms")
    listed, _ = bounded_broadcast(stored(lexicon(frequencies, band, rates), "imatch-lexicon"), max_lexicon)
    below = frequencies.where(F.col("known") < band[0]).orderBy(F.desc("df"), "term").limit(EVERYDAY).agg(F.collect_list("term").alias("t")).scalar()

    order = Window.partitionBy("bucket").orderBy("tail", F.asc_nulls_first("doc_id"), "h")
    rows = in_order(whole).withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    # a row that stands for m equal ones is followed by itself m - 1 times
    turns = F.when((F.col("m") > 1) & ~F.col("tail"), F.array(F.struct(F.lit(0).alias("turn"), (F.col("m") - 1).alias("times"), F.col("text").alias("next")),
                                                            F.struct(F.lit(1).alias("turn"), F.lit(1).cast("long").alias("times"), F.col("next").alias("next"))))
    one = F.array(F.struct(F.lit(1).alias("turn"), F.lit(1).cast("long").alias("times"), F.col("next").alias("next")))
    rows = rows.withColumn("t", F.explode_outer(F.coalesce(turns, one))).select("bucket", "place", "tail", "doc_id", "text", "t.*")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)))
    rows = rows.select("bucket", "place", "turn", "times", "tail", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       terms(F.col("text")).alias("own"), F.when(~F.col("tail"), terms(F.col("edited"))).otherwise(F.array().cast("array<string>")).alias("new"))
    bare = lambda c: F.substring(F.md5(F.array_join(F.sort_array(c), " ")), 1, 8)
    rest = lambda c: F.array_except(c, F.coalesce(below, F.array().cast("array<string>")))
    key = ["bucket", "place", "turn"]
    # all else a text's row says, in one string: it goes along as the entry of a term, marked 0
    said = ("times", "tail", "doc_id", "n_chars", "edited_sha256", "own_bare", "new_bare")
    rows = rows.withColumn("own_bare", bare("own")).withColumn("new_bare", bare("new")).select(
        *key, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in said]).alias("said"), rest("own").alias("own"), rest("new").alias("new"))
    # 1 marks a term of the own text, 2 of the edited one, 3 of both
    marked = lambda where, these: F.struct(F.lit(where).alias("in"), these.alias("terms"))
    both = F.array(marked(0, F.array("said")), marked(3, F.array_intersect("own", "new")),
                   marked(1, F.array_except("own", "new")), marked(2, F.array_except("new", "own")))
    # worked out in a step of its own: beside the explode it would be for every term; for a plain explode also once more in a filter
    each = rows.select(*key, both.alias("both")).select(*key, F.explode_outer("both").alias("b")).select(
        *key, "b.in", F.explode("b.terms").alias("term")).select(*key, "term", "in", F.when(F.col("in") > 0, F.xxhash64("term")).alias("code"))
    kept = each.join(listed, "code", "left").groupBy(*key).agg(
        F.split(F.max(F.when(F.col("in") == 0, F.col("term"))), r"\|").alias("s"),
        F.sort_array(F.collect_list(F.when(F.col("subsets").isNotNull(), F.struct("term", "subsets", "in")))).alias("held"))
    types = {"times": "long", "tail": "boolean", "n_chars": "long"}
    kept = kept.select(*key, *[(F.nullif(F.col("s")[i], F.lit("")).cast("long") if c == "doc_id" else F.col("s")[i].cast(types.get(c, "string"))).alias(c)
                               for i, c in enumerate(said)],
                       F.filter("held", lambda t: t["in"] != 2).alias("own"), F.filter("held", lambda t: t["in"] != 1).alias("new"))
    few, fewer, fewest = rare_subsets(rates)
    for side in ("own", "new"):
        kept = kept.withColumn(f"{side}_0", F.filter(side, _any_of(few))).withColumn(f"{side}_1", F.filter(side, _any_of(fewer + fewest)))
    kept = kept.select("*", *[F.filter(f"{side}_1", _any_of(fewest)).alias(f"{side}_2") for side in ("own", "new")])
    made = kept.select(*key, "times", "tail", "doc_id", "n_chars", "edited_sha256", _hashes("own", rates).alias("own"), _hashes("new", rates).alias("new"))
    follow = Window.partitionBy("bucket").orderBy("place", "turn")
    out = made.withColumn("after", F.when(F.col("turn") == 0, F.col("own")).otherwise(F.lead("own").over(follow))).where(~F.col("tail"))
    out = out.select("doc_id", "n_chars", "edited_sha256", F.array_join("own", "-").alias("fingerprint"), F.array_join("new", "-").alias("edited_fingerprint"),
                     likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"), "times")
    return out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_", "times")
