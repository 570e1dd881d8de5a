"""Small column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def any_in(c: Column, words: Iterable[str]) -> Column:
    """True if one of the words is a substring."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c worked out once for each row however often use reads it."""
    return F.get(F.transform(F.array(c), use), 0)


def first_true(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first case that holds."""
    (test, value), *rest = cases
    out = F.when(test, value)
    for test, value in rest:
        out = out.when(test, value)
    return out.otherwise(otherwise)


def ordered_distinct(items: Column, key=lambda x: F.lower(x)) -> Column:
    """Items whose key has not come before, in order; null and blank items go. Linear in the items."""
    kept = F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != ""))
    first = lambda kept, keys: F.filter(kept, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return bound(kept, lambda k: bound(F.transform(k, key), lambda keys: first(k, keys)))
