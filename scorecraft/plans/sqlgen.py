"""DuckDB SQL text for the cleaning rules (used by the oracle only).

Each rule op has an independent DuckDB formulation; a rule list becomes a
chain of CTEs (one per step) so that ops that read their input twice do not
blow up the SQL text.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from scorecraft.functions.text import AUTHOR_PHRASE, CENTURY, FOUR_DIGITS, YEAR_PHRASE
from scorecraft.operators.rules import ATTRIBUTE_ALIASES, MODELS, Rule, rules_for

_CTRL = {"\n": "chr(10)", "\t": "chr(9)", "\r": "chr(13)"}


def lit(s: str) -> str:
    """SQL string literal; control characters become chr() calls."""
    parts, buf = [], ""
    for ch in s:
        if ch in _CTRL:
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(_CTRL[ch])
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"regexp_replace({strip(x)}, '\s+', ' ', 'g')"


def sentence(x: str, word: str) -> str:
    w = lit(word.lower())
    return (f"coalesce({strip(f'list_filter(string_split({x}, {lit(chr(46))}), lambda s: contains(lower(s), {w}))[1]')}, "
            f"{x})")


def century(x: str) -> str:
    found = f"list_distinct(regexp_extract_all({x}, '{CENTURY}', 0))"
    keyed = f"list_reverse_sort(list_transform({found}, lambda m: lpad(CAST(length(m) AS VARCHAR), 6, '0') || m))"
    ordered = f"list_transform({keyed}, lambda k: k[7:])"
    year = "CAST((CAST(regexp_extract(m, '^[0-9]+', 0) AS DECIMAL(38,0)) - 1) * 100 AS VARCHAR)"
    return f"list_reduce({ordered}, lambda acc, m: replace(acc, m, {year}), {x})"


def first_year(x: str) -> str:
    return f"coalesce(nullif(regexp_extract({x}, '{FOUR_DIGITS}', 0), ''), '0')"


def bucket(x: str, p: int) -> str:
    v = f"coalesce(TRY_CAST({x} AS DOUBLE), 0)"
    return f"CAST(CAST(floor(CASE WHEN isnan({v}) THEN 0 ELSE {v} END / {p}) * {p} AS BIGINT) AS VARCHAR)"


def op(x: str, rule: Rule, year_precision: int = 100) -> str:
    kind, arg = rule
    if kind == "sentence":
        return sentence(x, arg)
    if kind == "before":
        return f"split_part({x}, {lit(arg)}, 1)"
    if kind == "after_last":
        return f"string_split({x}, {lit(arg)})[-1]"
    if kind == "delete":
        return f"replace({x}, {lit(arg)}, '')"
    if kind == "no_author":
        return collapse(f"regexp_replace({x}, '{AUTHOR_PHRASE}', '', 'g')")
    if kind == "no_year":
        return collapse(f"regexp_replace({x}, '{YEAR_PHRASE}', '', 'g')")
    if kind == "century":
        return century(x)
    if kind == "first_year":
        return first_year(x)
    if kind == "bucket":
        return bucket(x, year_precision)
    raise ValueError(kind)


def pre_clean(x: str) -> str:
    """NULL -> '', chat marker and few-shot tail decided per row."""
    x0 = f"coalesce({x}, '')"
    x1 = (f"CASE WHEN contains({x0}, 'ASSISTANT: ') THEN "
          f"split_part(replace({x0}, chr(10), ''), 'ASSISTANT: ', 2) ELSE {x0} END")
    return x1


def fewshot(x: str) -> str:
    return f"CASE WHEN contains({x}, '<image>') THEN coalesce(string_split({x}, '<image>')[4], '') ELSE {x} END"


def chain(prefix: str, source: str, col: str, rules: Sequence[Rule], year_precision: int = 100) -> tuple[list[str], str]:
    """CTEs applying ``rules`` to ``col`` of ``source``; returns (ctes, last name)."""
    ctes, prev = [], source
    for i, r in enumerate(rules):
        name = f"{prefix}_{i}"
        ctes.append(f"{name} AS (SELECT * REPLACE ({op(col, r, year_precision)} AS {col}) FROM {prev})")
        prev = name
    return ctes, prev


def model_sql(m: str) -> str:
    cases = " ".join(f"WHEN lower({m}) = {lit(x.lower())} THEN {lit(x)}" for x in MODELS)
    return f"(CASE {cases} ELSE {m} END)"


def attribute_sql(a: str) -> str:
    cases = " ".join(f"WHEN {a} = {lit(k)} THEN {lit(v)}" for k, v in ATTRIBUTE_ALIASES.items())
    return f"(CASE {cases} ELSE {a} END)"


def dispatch(source: str, col: str, profiles: Iterable[tuple[str, str, bool, bool]],
             year_precision: int = 100, prefix: str = "r") -> tuple[list[str], str]:
    """Clean ``col`` of ``source`` (which has a ``profile`` column) per profile.

    ``profiles`` lists the (model, attribute, has_author, has_year) values
    the source can hold; rows of other profiles pass through unchanged.
    """
    groups: dict[tuple[Rule, ...], list[str]] = {}
    for m, a, ha, hy in profiles:
        seq = tuple(rules_for(m, a, ha, hy))
        groups.setdefault(seq, []).append(f"{m}|{a}|{str(ha).lower()}|{str(hy).lower()}")
    ctes, finals, handled = [], [], []
    for gi, (seq, keys) in enumerate(groups.items()):
        inlist = ", ".join(lit(k) for k in keys)
        base = f"{prefix}{gi}_in"
        ctes.append(f"{base} AS (SELECT * FROM {source} WHERE profile IN ({inlist}))")
        c, last = chain(f"{prefix}{gi}", base, col, seq, year_precision)
        ctes += c
        finals.append(f"SELECT * FROM {last}")
        handled += keys
    inlist = ", ".join(lit(k) for k in handled) or "''"
    finals.append(f"SELECT * FROM {source} WHERE profile NOT IN ({inlist})")
    ctes.append(f"{prefix}_out AS ({' UNION ALL '.join(finals)})")
    return ctes, f"{prefix}_out"


def profile_sql(model: str, attribute: str, prompt: str) -> str:
    p = f"coalesce({prompt}, '')"
    return (f"{model_sql(model)} || '|' || {attribute_sql(attribute)} || '|' || "
            f"CAST(contains({p}, '[author]') AS VARCHAR) || '|' || CAST(contains({p}, '[year]') AS VARCHAR)")
