"""Spark SQL text for the answer-cleaning builders.

The same rules as :mod:`scorecraft.functions.text`, emitted as one Spark SQL
expression string.  A long rule chain built from ``Column`` objects costs
thousands of Python-to-JVM calls while the plan is being built; the same chain
as text is handed to Spark in one ``F.expr`` call.  Tests check that both
forms give identical results.
"""

from __future__ import annotations

import itertools
from typing import Callable, Sequence

from scorecraft.functions.text import AUTHOR_PHRASE, CENTURY, FOUR_DIGITS, LARGEST, LAST_NONZERO, NUMBER, YEAR_PHRASE

_ids = itertools.count()
_WS = r"(?U)\s"


def q(s: str) -> str:
    """Spark SQL string literal."""
    out = s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
    return f"'{out}'"


def col(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _var() -> str:
    return f"v{next(_ids)}"


def let(x: str, body: Callable[[str], str]) -> str:
    v = _var()
    return f"get(transform(array({x}), {v} -> {body(v)}), 0)"


def null_to_empty(x: str) -> str:
    return f"coalesce(cast({x} AS STRING), '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{_WS}+|{_WS}+$')}, '')"


def collapse(x: str) -> str:
    return f"regexp_replace({strip(x)}, {q(f'{_WS}+')}, ' ')"


def assistant_extract(x: str) -> str:
    return let(x, lambda v: f"CASE WHEN contains({v}, 'ASSISTANT: ') THEN "
                            f"get(split(replace({v}, {q(chr(10))}, ''), 'ASSISTANT: ', -1), 1) ELSE {v} END")


def fewshot_tail(x: str) -> str:
    return let(x, lambda v: f"CASE WHEN contains({v}, '<image>') THEN "
                            f"coalesce(get(split({v}, '<image>', -1), 3), '') ELSE {v} END")


def sentence(x: str, word: str) -> str:
    w = q(word.lower())

    def body(v: str) -> str:
        s = _var()
        found = (f"coalesce({strip(f'get(filter(split({v}, {q(chr(92) + chr(46))}, -1), {s} -> contains(lower({s}), {w})), 0)')}, "
                 f"{v})")
        if not word.lower().isascii():
            return found
        return f"CASE WHEN contains(lower({v}), {w}) THEN {found} ELSE {v} END"
    return let(x, body)


def before(x: str, d: str) -> str:
    return f"substring_index({x}, {q(d)}, 1)"


def after_last(x: str, d: str) -> str:
    return f"substring_index({x}, {q(d)}, -1)"


def delete(x: str, s: str) -> str:
    return f"replace({x}, {q(s)}, '')"


def no_author(x: str) -> str:
    return collapse(f"regexp_replace({x}, {q(AUTHOR_PHRASE)}, '')")


def no_year(x: str) -> str:
    return collapse(f"regexp_replace({x}, {q(YEAR_PHRASE)}, '')")


def _first_year_of(digits: str) -> str:
    def body(d: str) -> str:
        head, last, zeros = (f"regexp_extract({d}, {q(LAST_NONZERO)}, {i})" for i in (1, 2, 3))
        less = f"concat({head}, translate({last}, '123456789', '012345678'), replace({zeros}, '0', '9'), '00')"
        return f"CASE WHEN {d} RLIKE '^0*$' THEN '-100' ELSE regexp_replace({less}, '^0+(?=[0-9])', '') END"
    return let(digits, body)


def century(x: str) -> str:
    def body(v: str) -> str:
        a, b, acc, m = _var(), _var(), _var(), _var()
        found = f"array_distinct(regexp_extract_all({v}, {q(CENTURY)}, 0))"
        ordered = f"array_sort({found}, ({a}, {b}) -> length({b}) - length({a}))"
        year = _first_year_of(f"regexp_extract({m}, '^[0-9]+', 0)")
        return (f"CASE WHEN contains({v}, ' century') THEN "
                f"aggregate({ordered}, {v}, ({acc}, {m}) -> replace({acc}, {m}, {year})) ELSE {v} END")
    return let(x, body)


def first_year(x: str) -> str:
    return f"coalesce(nullif(regexp_extract({x}, {q(FOUR_DIGITS)}, 0), ''), '0')"


def bucket(x: str, precision: int) -> str:
    def body(v: str) -> str:
        n = f"try_cast({v} AS DOUBLE)"
        n = f"CASE WHEN {v} RLIKE {q(NUMBER)} AND abs({n}) < {LARGEST!r}D THEN {n} ELSE 0D END"
        return f"cast(cast(floor({n} / {int(precision)}) * {int(precision)} AS BIGINT) AS STRING)"
    return let(f"cast({x} AS STRING)", body)


def rule(x: str, r: tuple[str, str], precision: int = 100) -> str:
    op, arg = r
    if op == "sentence":
        return sentence(x, arg)
    if op == "before":
        return before(x, arg)
    if op == "after_last":
        return after_last(x, arg)
    if op == "delete":
        return delete(x, arg)
    if op == "no_author":
        return no_author(x)
    if op == "no_year":
        return no_year(x)
    if op == "century":
        return century(x)
    if op == "first_year":
        return first_year(x)
    if op == "bucket":
        return bucket(x, precision)
    raise ValueError(f"unknown rule op {op!r}")


def fold(x: str, rules: Sequence[tuple[str, str]], precision: int = 100) -> str:
    for r in rules:
        x = rule(x, r, precision)
    return x
