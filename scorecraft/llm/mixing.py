"""Mixing sources to target weights by hierarchical budgeting.

Sources are the leaves of a domain - language - source tree.  A token budget is
handed down from the root: siblings share their parent's budget by weight; a
sibling that cannot use its share (it has no more tokens in the epochs allowed)
leaves the rest to its siblings, and only what all siblings together cannot use
goes back to the level above.  Each leaf then takes whole epochs of its
documents and a token-prefix of one more epoch in seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorecraft.llm.common import stored

#: Target weights; a key that is not listed has weight 1.
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "code": 2, "news": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 2}
BUDGET_PERCENT = 60
MAX_EPOCHS = 3
SEED = 11
# An epoch's order is by a 60-bit hash; its first bits are the bin of a document in its leaf,
# found in two steps of at most 4096 bins a leaf each.
HASH_BITS = 60
ORDER_BITS = (12, 24)
LEVELS = ("domain", "lang", "source")
# The plan (a few numbers a leaf) is broadcast up to this many leaves, and joined by a shuffle beyond.
MAX_BROADCAST_LEAVES = 100_000


def domain_of(source: Column) -> Column:
    """Domain of a source by the last digits of its name, modulo 4: 0 web, 1 books, 2 code, 3 news; else web."""
    digits = F.substring(F.regexp_extract(source, "([0-9]+)$", 1), -9, 9)
    n = F.coalesce(digits.try_cast("long"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, ("web", "books", "code", "news"))), (n % 4 + 1).cast("int"))


def word_count(text: Column) -> Column:
    """Number of words between blanks, tabs and line ends; NULL and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _weight(column: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for key, w in weights.items():
        out = F.when(column == key, F.lit(int(w))).otherwise(out)
    return out.cast("double")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split ``budget`` of each parent among its nodes by ``weight``, none above its ``room``.

    Siblings in rising order of room per weight: those that fill up before the
    level is reached get their room, the others their share of what is left.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("room") / F.col("weight")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    rest = F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = nodes.withColumn("_rest", rest).withColumn("_left", weight)
    full = F.col("room") * F.col("_left") <= F.col("_rest") * F.col("weight")
    level = level.withColumn("_full", full).withColumn("_row", F.row_number().over(order))
    # the first sibling that does not fill up fixes what all later ones share
    first = F.min(F.when(~F.col("_full"), F.struct("_row", "_rest", "_left"))).over(whole)
    level = level.withColumn("_first", first)
    got = F.when(F.col("_first").isNull() | (F.col("_row") < F.col("_first._row")), F.col("room")).otherwise(
        F.floor(F.col("_first._rest") * F.col("weight") / F.col("_first._left")).cast("double"))
    return level.withColumn("budget", got).drop("_rest", "_left", "_full", "_row", "_first")


def budgets(leaves: DataFrame, percent: int = BUDGET_PERCENT, epochs: int = MAX_EPOCHS,
            domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS, lang_weights: Mapping[str, int] = LANG_WEIGHTS,
            source_weights: Mapping[str, int] = SOURCE_WEIGHTS) -> DataFrame:
    """domain, lang, source, avail, budget (whole tokens) of each leaf, from (domain, lang, source, avail).

    The root's budget is ``percent`` of all tokens.  Keys may be NULL.  Works on
    one row per leaf; all numbers are whole and below 2**53, so doubles are exact.
    """
    room = (F.col("avail") * epochs).cast("double")
    leaf = leaves.withColumn("room", room)
    langs = leaf.groupBy("domain", "lang").agg(F.sum("room").alias("room"))
    domains = langs.groupBy("domain").agg(F.sum("room").alias("room"))
    total = leaf.agg(F.floor(F.coalesce(F.sum("avail"), F.lit(0)) * percent / 100).cast("double").alias("budget"))
    top = domains.withColumn("budget", total.scalar()).withColumn("_root", F.lit(0))
    out = _share(top.withColumn("weight", _weight(F.col("domain"), domain_weights)), ["_root"], "domain")
    for names, nodes, weights in ((["domain"], langs, lang_weights), (["domain", "lang"], leaf, source_weights)):
        below = "lang" if len(names) == 1 else "source"
        up = out.select(*[F.col(n).alias(f"_{n}") for n in names], "budget")
        same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
        out = nodes.join(up, same[0] if len(same) == 1 else same[0] & same[1]).drop(*[f"_{n}" for n in names])
        out = _share(out.withColumn("weight", _weight(F.col(below), weights)), names, below)
    return out.select(*LEVELS, "avail", F.col("budget").cast("long").alias("budget"))


def order_hash(seed: int, epoch: Column, doc_id: Column, digest: Column) -> Column:
    """Place of a document in an epoch: 60 bits of MD5 of (seed, epoch, doc_id, MD5 of the text)."""
    key = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), digest)
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _same(prefix: str) -> Column:
    """Equal leaves, NULL keys included: a row's own columns and a side's with ``prefix``."""
    domain, lang, source = (F.col(c).eqNullSafe(F.col(prefix + c)) for c in LEVELS)
    return domain & lang & source


def _bin(bits: int) -> Column:
    return F.shiftright("_hash", HASH_BITS - bits)


def _prefix_ends(rows: DataFrame, few: bool) -> DataFrame:
    """_end_<leaf>, _end_bin, _end_start: the finest bin in which a leaf's prefix ends, and the tokens before it.

    Each step sums the tokens of the bins inside the bin of the step before, so
    that a window holds at most 4096 sums of a leaf, however many documents it has.
    """
    leaf = [f"_{c}" for c in LEVELS]
    ends, wider = None, 0
    for bits in ORDER_BITS:
        here = rows.withColumn("_bin", _bin(bits))
        if ends is None:
            here = here.withColumn("_from", F.lit(0).cast("long"))
        else:
            here = here.join(F.broadcast(ends) if few else ends, _same("_end_")).where(_bin(wider) == F.col("_end_bin"))
            here = here.withColumn("_from", F.col("_end_start"))
        bins = here.groupBy(*leaf, "_part", "_from", "_bin").agg(F.sum("n_tokens").alias("_in"))
        upto = Window.partitionBy(*leaf).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("_start", F.col("_from") + F.sum("_in").over(upto) - F.col("_in"))
        # it starts before the prefix ends and reaches that end
        hit = bins.where((F.col("_start") < F.col("_part")) & (F.col("_start") + F.col("_in") >= F.col("_part")))
        ends = stored(hit.select(*[F.col(c).alias(f"_end{c}") for c in leaf], F.col("_bin").alias("_end_bin"),
                                 F.col("_start").alias("_end_start")), "mixing-ends")
        wider = bits
    return ends


def mix_sources(docs: DataFrame, percent: int = BUDGET_PERCENT, epochs: int = MAX_EPOCHS, seed: int = SEED,
                carry: bool = False, **weights: Mapping[str, int]) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epochs_full, part_tokens, used_tokens: one row per document row.

    ``epochs_full`` counts the whole epochs of its leaf; ``part_tokens`` is how
    much of the document the last, partial epoch takes (the document at the end
    of the prefix may be taken in part).  ``carry`` returns all columns of
    ``docs`` besides, in a struct ``doc``.

    Tokens are words.  NULL and empty texts have none and take part with 0;
    NULL languages and sources are leaves of their own (a NULL source is in domain
    web); repeated rows share one place in the order, in any order among
    themselves; an empty table gives no rows; extra columns do not matter.  A leaf
    with a third of all rows is summed before the shuffle, and only the
    documents of the bin at the end of its prefix are sorted.
    """
    read = [F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang"), F.col("source").alias("_source"), F.col("text").alias("_text")]
    keep = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []

    def counted(extra: list[Column]) -> DataFrame:
        return docs.select(*read, *extra).select(
            "doc_id", domain_of(F.col("_source")).alias("domain"), "lang", F.col("_source").alias("source"),
            word_count(F.col("_text")).alias("n_tokens"), F.md5(F.coalesce(F.col("_text"), F.lit(""))).alias("_digest"),
            *(["doc"] if extra else []))

    counts = stored(counted([]), "mixing-counts")  # the steps before the last read no texts
    leaves = counts.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("avail"))
    plan = budgets(leaves, percent, epochs, **weights)
    avail = F.greatest(F.col("avail"), F.lit(1))
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], F.floor(F.col("budget") / avail).cast("long").alias("epochs_full"),
                       (F.col("budget") % avail).alias("_part"))
    # one row per leaf of the tree, written once: every later step reads these rows
    plan = stored(plan, "mixing")
    few = plan.count() <= MAX_BROADCAST_LEAVES
    side = F.broadcast(plan) if few else plan

    def placed(base: DataFrame) -> DataFrame:
        place = order_hash(seed, F.col("epochs_full") + 1, F.col("doc_id"), F.col("_digest"))
        return base.join(side, _same("_"), "left").withColumn("_hash", place).drop("_digest")

    ends = _prefix_ends(placed(counts), few)
    rows = placed(counted(keep) if carry else counts).withColumn("_bin", _bin(ORDER_BITS[-1]))
    rows = rows.join(F.broadcast(ends) if few else ends, _same("_end_"), "left")
    inside = F.col("_bin") == F.col("_end_bin")
    whole = rows.where(~F.coalesce(inside, F.lit(False))).withColumn(
        "part_tokens", F.when(F.col("_bin") < F.col("_end_bin"), F.col("n_tokens")).otherwise(F.lit(0)).cast("long"))
    order = Window.partitionBy(*[f"_{c}" for c in LEVELS]).orderBy("_hash", "doc_id")
    upto = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens") + F.col("_end_start")
    cut = rows.where(inside).withColumn("_before", upto).withColumn(
        "part_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("_part") - F.col("_before"))).cast("long")).drop("_before")
    out = ["doc_id", *LEVELS, "n_tokens", "epochs_full", "part_tokens"]
    used = (F.col("epochs_full") * F.col("n_tokens") + F.col("part_tokens")).alias("used_tokens")
    return whole.unionByName(cut).select(*out, used, *(["doc"] if carry else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as mixed, columns unchanged: one row per epoch that takes a document.

    Documents without tokens are kept once.  A document that the prefix ends in
    is taken whole.
    """
    rows = mix_sources(docs, carry=True, **options)
    times = F.when(F.col("n_tokens") == 0, F.lit(1)).otherwise(F.col("epochs_full") + (F.col("part_tokens") > 0).cast("long"))
    rows = rows.where(times > 0).select("doc", F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("_epoch"))
    return rows.select("doc.*")
