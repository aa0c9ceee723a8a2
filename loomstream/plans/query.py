"""A declarative query: predicates that all hold, sorts in the order given, at most one limit."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _list(values: Any) -> list:
    return list(values) if isinstance(values, Iterable) and not isinstance(values, str) else [values]


def _resolve(df: DataFrame, path: str) -> tuple[str | None, str, T.DataType]:
    """(array column the path goes through or None, path, type of the value)."""
    at: T.DataType = df.schema
    parts = path.split(".")
    array = None
    for i, part in enumerate(parts):
        if isinstance(at, T.ArrayType):
            array = i if array is None else array
            at = at.elementType
        if not isinstance(at, T.StructType) or part not in at.fieldNames():
            raise ValueError(f"no such field: {path}")
        at = at[part].dataType
    return (None, path, at) if array is None else (".".join(parts[:array]), ".".join(parts[array:]), at)


@dataclass(frozen=True)
class Query:
    """where_* methods add predicates, all of which must hold; a predicate of None is ignored.

    A dotted path through an array of structs asks for any element (for the negated predicates: no element).
    dialect 'sql' drops nulls from negated predicates, 'document' keeps rows that miss the field and takes an empty
    array for null. Empty value lists match nothing; negated ones match everything. Every ordering ends with the
    `key` column, so results are the same on every run.
    """

    dialect: str = "sql"
    key: str | None = None
    predicates: tuple = ()
    sorts: tuple = ()
    count: int | None = None
    skip: int = 0
    extra: tuple = field(default=())

    def _add(self, path: str, test, negated: bool = False) -> Query:
        return replace(self, predicates=(*self.predicates, (path, test, negated)))

    def where_equals(self, path: str, values: Any) -> Query:
        vs = _list(values)
        return self._add(path, lambda c: c.isin(vs) if vs else F.lit(False))

    def where_not_equals(self, path: str, values: Any) -> Query:
        vs = _list(values)
        return self._add(path, lambda c: c.isin(vs), True) if vs else self

    def where_equals_ignore_case(self, path: str, values: Any) -> Query:
        vs = [v.lower() for v in _list(values)]
        return self._add(path, lambda c: F.lower(c).isin(vs) if vs else F.lit(False))

    def where_greater(self, path: str, v: Any) -> Query:
        return self._add(path, lambda c: c > v)

    def where_at_least(self, path: str, v: Any) -> Query:
        return self._add(path, lambda c: c >= v)

    def where_less(self, path: str, v: Any) -> Query:
        return self._add(path, lambda c: c < v)

    def where_at_most(self, path: str, v: Any) -> Query:
        return self._add(path, lambda c: c <= v)

    def where_like(self, path: str, pattern: str) -> Query:
        return self._add(path, lambda c: c.like(pattern))

    def where_ilike(self, path: str, pattern: str) -> Query:
        return self._add(path, lambda c: c.ilike(pattern))

    def where_not_like(self, path: str, pattern: str) -> Query:
        return self._add(path, lambda c: c.like(pattern), True)

    def where_not_ilike(self, path: str, pattern: str) -> Query:
        return self._add(path, lambda c: c.ilike(pattern), True)

    def where_true(self, path: str) -> Query:
        return self._add(path, lambda c: c.eqNullSafe(F.lit(True)))

    def where_false(self, path: str) -> Query:
        return self._add(path, lambda c: c.eqNullSafe(F.lit(False)))

    def where_not_true(self, path: str) -> Query:
        return self._add(path, lambda c: ~c.eqNullSafe(F.lit(True)))

    def where_not_false(self, path: str) -> Query:
        return self._add(path, lambda c: ~c.eqNullSafe(F.lit(False)))

    def where_null(self, path: str) -> Query:
        return self._add(path, "null")

    def where_not_null(self, path: str) -> Query:
        return self._add(path, "not null")

    def where(self, option: Query | None) -> Query:
        """The predicates, sorts and limit of another query as well; None changes nothing."""
        if option is None:
            return self
        if self.count is not None and option.count is not None:
            raise ValueError("a query has at most one limit")
        limits = {} if option.count is None else {"count": option.count, "skip": option.skip}
        return replace(self, predicates=self.predicates + option.predicates, sorts=self.sorts + option.sorts, extra=self.extra + option.extra, **limits)

    def ascending(self, path: str) -> Query:
        return replace(self, sorts=(*self.sorts, (path, True)))

    def descending(self, path: str) -> Query:
        return replace(self, sorts=(*self.sorts, (path, False)))

    def limit(self, n: int, offset: int = 0) -> Query:
        if n <= 0 or offset < 0:
            raise ValueError("a limit is positive and an offset is not negative")
        if self.count is not None:
            raise ValueError("a query has at most one limit")
        return replace(self, count=n, skip=offset)

    def with_constant(self, name: str, value: Any) -> Query:
        return replace(self, extra=(*self.extra, (name, value)))

    def condition(self, df: DataFrame) -> Column:
        out = F.lit(True)
        for path, test, negated in self.predicates:
            array, rest, kind = _resolve(df, path)
            if test in ("null", "not null"):
                c = F.col(path)
                missing = c.isNull()
                if isinstance(kind, T.ArrayType) and array is None:
                    missing = missing | (F.size(c) == 0) if self.dialect == "document" else missing
                one = missing if test == "null" else ~missing
            elif array is not None:
                one = F.coalesce(F.exists(F.col(array), _element_test(rest, test)), F.lit(False))
                one = ~one if negated else one
            else:
                one = test(F.col(path))
                if negated:
                    one = ~one | F.col(path).isNull() if self.dialect == "document" else ~one
            out = out & one
        return out

    def order(self) -> list[Column]:
        keys = [F.asc_nulls_first(p) if up else F.desc_nulls_last(p) for p, up in self.sorts]
        return [*keys, F.asc(self.key)] if keys and self.key and all(p != self.key for p, _ in self.sorts) else keys

    def run(self, df: DataFrame) -> DataFrame:
        out = df.filter(self.condition(df)) if self.predicates else df
        if self.sorts:
            out = out.orderBy(*self.order())
        if self.skip:
            out = out.offset(self.skip)
        if self.count is not None:
            out = out.limit(self.count)
        for name, value in self.extra:
            out = out.withColumn(name, F.lit(value))
        return out

    def first(self, df: DataFrame) -> DataFrame:
        """One row at most: a limit is replaced by 1, its offset stays."""
        return replace(self, count=1).run(df)

    def size(self, df: DataFrame) -> DataFrame:
        return df.filter(self.condition(df)).agg(F.count("*").alias("n"))


def _element_test(path: str, test):
    return lambda x: F.coalesce(test(_dig(x, path)), F.lit(False))


def _dig(c: Column, path: str) -> Column:
    for part in path.split(".") if path else []:
        c = c[part]
    return c
