"""Reusable expressions written as SQL text.

A chain of a few hundred functions is slow to put together call by call and is copied wherever
it is used. Here it is written once as a lambda in SQL, parsed once per session and applied to any
column, a lambda variable included.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

_names = itertools.count()


def raw(pattern: str) -> str:
    """A regular expression as a raw SQL literal; a single quote is written as ``\\x27``."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def literal(text: str) -> str:
    return "'" + "".join(f"\\u{ord(ch):04x}" for ch in text) + "'"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of ``value``, evaluated once: a lambda variable holds it."""
    name = f"v{next(_names)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


_parsed: dict[tuple, Column] = {}


def column_function(body: Callable[..., str]) -> Callable[..., Column]:
    """Turn a function from SQL text to SQL text into one from column to column."""
    text_of = functools.cache(lambda *args: f"x -> {body('x', *args)}")

    @functools.wraps(body)
    def apply(c: Column | str, *args) -> Column:
        text = text_of(*args)
        key = (text, id(SparkContext._active_spark_context))
        if key not in _parsed:
            _parsed[key] = F.expr(text)
        value = F.col(c) if isinstance(c, str) else c
        return F.call_function("transform", F.array(value), _parsed[key])[0]

    return apply
