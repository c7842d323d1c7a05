"""Ordered cleaning rules for free-text answers, folded into one Column.

A rule is ``(op, arg)``; ``op`` is one of

* ``sentence``   -- keep the first '.'-sentence containing ``arg`` (else all)
* ``before``     -- keep the text before the first ``arg``
* ``after_last`` -- keep the text after the last ``arg``
* ``delete``     -- delete every ``arg``
* ``no_author`` / ``no_year`` -- drop the author / year phrase
* ``century``    -- rewrite ordinal centuries as years
* ``first_year`` -- first four-digit number, else 0
* ``bucket``     -- floor the number to the year precision

Rule order is semantic (``delete 'art'`` also cuts inside words), so the
tables below keep the reference's order.  Which rule list applies to a row
is decided from the row's run columns (model, attribute, prompt), so one
plan cleans a table holding many runs.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.functions import sqltext as Q
from scorecraft.functions import text as T

Rule = tuple[str, str]

# ---------------------------------------------------------------------------
# Rule texts that must equal the reference's, in its order.
# ---------------------------------------------------------------------------

STYLE_KEYWORDS: list[Rule] = [
    ("sentence", "This painting belongs to"),
    ("sentence", "painting belongs to "),
    ("sentence", "The art style of this painting"),
    ("sentence", "style"),
    ("sentence", "period"),
]

LLAVA_STYLE: list[Rule] = [
    ("delete", "by William H. Johnson "),
    ("delete", "The art style of this painting is "),
    ("delete", "The art style of this painting "),
    ("before", ", which was "),
    ("before", " which is a "),
    ("before", " which was created "),
    ("before", ", which is characterized"),
    ("delete", "the art style of "),
    ("after_last", "painting belongs to"),
    ("before", " style"),
    ("before", " period"),
    ("before", " era, as "),
    ("delete", "art"),
    ("delete", "the"),
    ("delete", "characterized by a combination of "),
    ("delete", "a combination of "),
    ("delete", "can be described as a mix of "),
    ("delete", "considered to be "),
    ("delete", "by André Bauchant is "),
    ("delete", "known as "),
    ("delete", "a mix of "),
]

GPT4O_STYLE: list[Rule] = [
    ("sentence", "a notable example of Venetian Renaissance art"),
    ("sentence", "This painting belongs to the "),
    ("sentence", "The painting belongs to the "),
    ("sentence", "The painting appears to belong to the"),
    ("sentence", "is an example of "),
    ("sentence", "belongs to the "),
    ("sentence", "is an art movement"),
    ("sentence", "period"),
    ("sentence", "art style"),
    ("sentence", "example of "),
    ("before", " is an art style that"),
    ("after_last", "is an example of "),
    ("before", " is an art movement"),
    ("after_last", "belongs to the "),
    ("after_last", "appears to belong to the "),
    ("after_last", "This painting belongs to the art style of "),
    ("after_last", "The painting you provided belongs to the "),
    ("after_last", "This painting belongs to the "),
    ("after_last", "This painting is characteristic of the "),
    ("after_last", "painting appears to belong to the "),
    ("before", ", which is"),
    ("after_last", "example of the "),
    ("after_last", "a notable example of "),
    ("after_last", ", typical of the "),
    ("after_last", "The painting in question is The Tempest by Giorgione, a notable example of "),
    ("after_last", "The painting you provided is a classic example of "),
    ("delete", "This painting is characteristic of the "),
    ("delete", "This painting exhibits characteristics of the "),
    ("delete", "This painting is associated with the"),
    ("delete", "This drawing, dated 1920, bears a "),
    ("delete", "The painting in question is The Tempest by Giorgione, a notable example of "),
    ("delete", "The painting you have posted belongs to "),
    ("delete", ", a phase that lasted from 1901 to 1904"),
    ("delete", "This painting appears to belong to the "),
    ("delete", "art style known as "),
    ("delete", "art style"),
    ("delete", "**"),
    ("delete", '"'),
]

FLAMINGO_STYLE: list[Rule] = [
    ("delete", "The art period of this painting is"),
    ("delete", "The art style of this painting is"),
    ("delete", "\t"),
]

FLAMINGO_AUTHOR: list[Rule] = [
    ("sentence", "The author of this painting is"),
    ("delete", "The author of this painting is "),
]

FLAMINGO_YEAR: list[Rule] = [
    ("sentence", "This painting was made in"),
    ("century", ""),
    ("first_year", ""),
    ("bucket", ""),
]

LLAVA_YEAR: list[Rule] = [
    ("delete", "The painting was made in "),
    ("delete", "the "),
]

# Canonical model names and attribute aliases.
MODELS = ("CLIP", "LLaVA", "OpenFlamingo", "GPT-4o")
ATTRIBUTE_ALIASES = {"style": "art_style", "art_style": "art_style", "period": "period",
                     "author": "author", "year": "year"}


# ---------------------------------------------------------------------------

def apply_rule(c: Column, rule: Rule, year_precision: int | Column = 100) -> Column:
    op, arg = rule
    if op == "sentence":
        return T.sentence_with(c, arg)
    if op == "before":
        return T.keep_before(c, arg)
    if op == "after_last":
        return T.keep_after_last(c, arg)
    if op == "delete":
        return T.delete(c, arg)
    if op == "no_author":
        return T.remove_author(c)
    if op == "no_year":
        return T.remove_year(c)
    if op == "century":
        return T.century_to_year(c)
    if op == "first_year":
        return T.find_year(c)
    if op == "bucket":
        return T.year_bucket(c, year_precision)
    raise ValueError(f"unknown rule op {op!r}")


def fold_rules(c: Column, rules: Sequence[Rule], year_precision: int | Column = 100) -> Column:
    return reduce(lambda acc, r: apply_rule(acc, r, year_precision), rules, c)


def rules_for(model: str, attribute: str, has_author: bool, has_year: bool) -> list[Rule]:
    """The cleaning sequence of one run profile (model, attribute, prompt placeholders)."""
    seq: list[Rule] = []
    styled = attribute == "period" or (attribute == "art_style" and model != "GPT-4o")
    if styled:
        if has_author:
            seq.append(("no_author", ""))
        if has_year:
            seq.append(("no_year", ""))
        seq += STYLE_KEYWORDS
    if attribute in ("art_style", "period"):
        if model == "LLaVA":
            seq += LLAVA_STYLE
        elif model == "OpenFlamingo":
            seq += FLAMINGO_STYLE
    if model == "OpenFlamingo" and attribute == "author":
        seq += FLAMINGO_AUTHOR
    if model == "OpenFlamingo" and attribute == "year":
        seq += FLAMINGO_YEAR
    if attribute == "year" and model != "CLIP":
        seq.append(("century", ""))
    if attribute == "year" and model == "LLaVA":
        seq += LLAVA_YEAR
    if attribute == "year" and model == "CLIP":
        seq.append(("bucket", ""))
    if model == "GPT-4o":
        seq += GPT4O_STYLE
    return seq


def _lookup(table: dict[str, str], key: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(m, key)


def canonical_model(c: Column) -> Column:
    """Model name with canonical case (``LLaVa`` -> ``LLaVA``); unknown names unchanged."""
    return F.coalesce(_lookup({m.lower(): m for m in MODELS}, F.lower(c)), c)


def canonical_attribute(c: Column) -> Column:
    """``style`` -> ``art_style``; other names unchanged."""
    return F.coalesce(_lookup(ATTRIBUTE_ALIASES, c), c)


MAX_PROFILES = 1000


def run_profiles(df: DataFrame, key: Column) -> list[str] | None:
    """Distinct run profiles present in ``df`` (bounded: at most MAX_PROFILES).

    Only the small set of profile keys reaches the driver, so that the plan
    carries the rule branches that can fire instead of all of them.
    """
    rows = df.select(key.alias("k")).distinct().limit(MAX_PROFILES + 1).collect()
    return None if len(rows) > MAX_PROFILES else [r["k"] for r in rows]


def clean_predictions(df: DataFrame, pred: str = "preds", model: str = "model",
                      attribute: str = "attribute", prompt: str = "prompt",
                      year_precision: int | Column = 100, out: str = "pred_clean",
                      profiles: list[str] | None = None, detect_profiles: bool = True,
                      strict_first_row: bool = False, run: str = "run", order: str = "row_idx",
                      extract_markers: bool = True) -> DataFrame:
    """Clean raw answers of any mix of runs in one narrow projection.

    Rows are dispatched on ``(model, attribute, '[author]' in prompt,
    '[year]' in prompt)``; profiles that share a rule list share a branch.
    Chat and few-shot markers are decided per row.  ``profiles`` (keys
    ``model|attribute|has_author|has_year``) limits the branches compiled
    into the plan; by default they are detected from the data.

    ``strict_first_row=True`` reproduces the original behaviour instead: the
    first row of each run (smallest ``order``) decides whether the chat /
    few-shot extraction applies to the whole run, and rows of such a run
    without the marker become empty.  The per-run decision is a small
    aggregate (one row per run) joined back by broadcast.
    """
    if strict_first_row:
        return _clean_strict(df, pred, model, attribute, prompt, year_precision, out, profiles,
                             detect_profiles, run, order)
    m = canonical_model(F.col(model))
    a = canonical_attribute(F.col(attribute))
    p = F.coalesce(F.col(prompt), F.lit(""))
    key = F.concat_ws("|", m, a, F.contains(p, F.lit("[author]")).cast("string"),
                      F.contains(p, F.lit("[year]")).cast("string"))

    if profiles is None and detect_profiles:
        profiles = run_profiles(df, key)
    wanted = None if profiles is None else set(profiles)
    branches: dict[tuple[Rule, ...], list[str]] = {}
    skipped: list[str] = []
    for mm in MODELS:
        for aa in sorted(set(ATTRIBUTE_ALIASES.values())):
            for ha in (False, True):
                for hy in (False, True):
                    k = f"{mm}|{aa}|{str(ha).lower()}|{str(hy).lower()}"
                    seq = tuple(rules_for(mm, aa, ha, hy))
                    if seq and (wanted is None or k in wanted):
                        branches.setdefault(seq, []).append(k)
                    elif seq:
                        skipped.append(k)

    if not isinstance(year_precision, Column):
        # One Spark SQL expression for the whole dispatch: a single call into
        # the JVM instead of thousands while the plan is built.
        pre_sql = Q.null_to_empty(Q.col(pred))
        if extract_markers:
            pre_sql = Q.fewshot_tail(Q.assistant_extract(pre_sql))

        def dispatch_sql(v: str) -> str:
            whens = [f"WHEN _profile IN ({', '.join(Q.q(k) for k in keys)}) THEN {Q.fold(v, seq, year_precision)}"
                     for seq, keys in branches.items()]
            if skipped:
                # A row whose profile has rules that were not compiled in would
                # silently stay uncleaned: fail loudly instead.
                whens.append(f"WHEN _profile IN ({', '.join(Q.q(k) for k in skipped)}) THEN "
                             f"raise_error(concat('rule profile not among the given profiles: ', _profile))")
            return f"CASE {' '.join(whens)} ELSE {v} END" if whens else v

        return (df.withColumn("_profile", key)
                  .withColumn(out, F.expr(Q.let(pre_sql, dispatch_sql)))
                  .drop("_profile"))

    pre = T.null_to_empty(pred)
    if extract_markers:
        pre = T.fewshot_tail(T.assistant_extract(pre))

    def dispatch(x: Column) -> Column:
        k = F.col("_profile")
        expr = None
        for seq, keys in branches.items():
            cond = k.isin(keys)
            branch = fold_rules(x, seq, year_precision)
            expr = F.when(cond, branch) if expr is None else expr.when(cond, branch)
        return x if expr is None else expr.otherwise(x)

    return (df.withColumn("_profile", key)
              .withColumn(out, T.let(pre, dispatch))
              .drop("_profile"))


def _clean_strict(df: DataFrame, pred: str, model: str, attribute: str, prompt: str,
                  year_precision: int | Column, out: str, profiles: list[str] | None,
                  detect_profiles: bool, run: str, order: str) -> DataFrame:
    from scorecraft.session import bounded_broadcast
    first = (df.groupBy(run).agg(F.min_by(F.coalesce(F.col(pred).cast("string"), F.lit("")), F.col(order))
                                 .alias("_first")))
    flags = first.select(run, F.contains("_first", F.lit(T.ASSISTANT_MARKER)).alias("_asst"),
                         F.contains("_first", F.lit(T.IMAGE_MARKER)).alias("_img"))
    flags, _ = bounded_broadcast(flags)
    x = T.null_to_empty(pred)
    x = F.when(F.col("_asst"), F.coalesce(
        F.get(F.split(F.replace(x, F.lit("\n"), F.lit("")), T.ASSISTANT_MARKER, -1), 1), F.lit(""))).otherwise(x)
    x = T.let(x, lambda v: F.when(F.col("_img"), F.coalesce(F.get(F.split(v, T.IMAGE_MARKER, -1), 3), F.lit("")))
              .otherwise(v))
    staged = df.join(flags, run, "left").withColumn("_strict_pre", x)
    cleaned = clean_predictions(staged, "_strict_pre", model, attribute, prompt, year_precision, out,
                                profiles, detect_profiles, extract_markers=False)
    return cleaned.drop("_asst", "_img", "_strict_pre")
