"""Access to payload values: a path into a JSON payload, or a column that holds a field.

A field has any number of values. A condition on it holds if it holds for one of them; an array counts by its elements.
What is missing or of another type doesn't match: a condition is then false, or null where that lets it reach the scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Test = Callable[[Column], Column]

_STEP = re.compile(r'\.?"((?:[^"\\]|\\.)*)"|\.?([\w\-]+)|\[(\d*)\]')
_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?\s?(Z|z|[+-]\d{2}(:?\d{2})?)?$"


def parse_path(path: str) -> list[str | int | None]:
    """Steps of a payload path: keys, positions, and None for all elements of an array."""
    steps: list[str | int | None] = []
    at = 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or (at == 0 and (m[3] is not None or path[0] == ".")):
            raise ValueError(f"no payload path: {path!r}")
        steps.append(json.loads(f'"{m[1]}"') if m[1] is not None else m[2] if m[2] is not None else int(m[3]) if m[3] else None)
        at = m.end()
    if not steps:
        raise ValueError("an empty payload path")
    return steps


def _spark_path(steps: list[str | int]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else "['" + s.replace("'", "\\'") + "']" for s in steps)


def parse_time(text: Column) -> Column:
    """Microseconds since 1970 in UTC of a date or time in one of the accepted forms, else null."""
    text = F.regexp_replace(text, r"^(.{10}[T ]\d{2}:\d{2})(?=$|[Zz+ -])", "$1:00")
    zoned = F.when(text.rlike(r"(Z|z|:\d{2}\s?[+-]\d{2}(:?\d{2})?|\d\s?[+-]\d{4})$") | text.rlike(r"T.*[+-]\d{2}(:?\d{2})?$"), text).otherwise(F.concat(text, F.when(F.length(text) == 10, F.lit("T00:00:00Z")).otherwise(F.lit("Z"))))
    return F.when(text.rlike(_TIME), F.unix_micros(zoned.try_cast("timestamp")))


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _some(items: Column, test: Test) -> Column:
    return F.exists(items, lambda x: is_true(test(x)))


def _getter(path: str) -> Test:
    return lambda x: F.try_variant_get(x, path, "variant")


def _array(v: Column) -> Column:
    return v.try_cast("array<variant>")


class Values:
    """The interface of both kinds of fields."""

    def string(self, test: Test) -> Column:
        raise NotImplementedError

    def integer(self, test: Test) -> Column:
        raise NotImplementedError

    def boolean(self, test: Test) -> Column:
        raise NotImplementedError

    def number(self, test: Test) -> Column:
        raise NotImplementedError

    def time(self, test: Test) -> Column:
        return self.string(lambda s: test(parse_time(s)))

    def place(self, test: Callable[[Column, Column], Column]) -> Column:
        raise NotImplementedError

    def other_than(self, strings: list[str], integers: list[int]) -> Column:
        raise NotImplementedError

    def count(self, test: Test) -> Column:
        raise NotImplementedError

    def all_empty(self) -> Column:
        raise NotImplementedError

    def any_null(self, inside: bool) -> Column:
        raise NotImplementedError

    def missing(self) -> Column:
        raise NotImplementedError

    def nested(self, test: Callable[[Column], Column]) -> Column:
        raise NotImplementedError

    def point(self) -> tuple[Column, Column]:
        """Longitude and latitude of the first value that is a place, else null."""
        raise NotImplementedError

    def strings(self) -> Column:
        """All values that are texts, as an array; empty if there are none."""
        return F.coalesce(self.scalars("keyword"), F.array().cast("array<string>"))

    def scalars(self, kind: str) -> Column:
        """All values of a kind, as an array: keyword, integer, float, bool, datetime (microseconds)."""
        raise NotImplementedError


class JsonValues(Values):
    """Values at a path of a variant."""

    def __init__(self, root: Column, path: str):
        steps = parse_path(path)
        first = steps.index(None) if None in steps else len(steps)
        items = F.filter(F.array(F.try_variant_get(root, _spark_path(steps[:first]), "variant")), lambda x: x.isNotNull())
        rest: list = steps[first:]
        while rest:
            items = F.flatten(F.transform(items, lambda x: F.coalesce(_array(x), F.array().cast("array<variant>"))))
            stop = next((n for n, s in enumerate(rest[1:], 1) if s is None), len(rest))
            inner = rest[1:stop]
            if inner:
                items = F.filter(F.transform(items, _getter(_spark_path(inner))), lambda x: x.isNotNull())
            rest = rest[stop:]
        self.items = items

    @property
    def elements(self) -> Column:
        return F.flatten(F.transform(self.items, lambda x: F.coalesce(_array(x), F.array(x))))

    def string(self, test: Test) -> Column:
        return _some(self.elements, lambda x: (F.schema_of_variant(x) == "STRING") & test(x.try_cast("string")))

    def integer(self, test: Test) -> Column:
        return _some(self.elements, lambda x: (F.schema_of_variant(x) == "BIGINT") & test(x.try_cast("long")))

    def boolean(self, test: Test) -> Column:
        return _some(self.elements, lambda x: (F.schema_of_variant(x) == "BOOLEAN") & test(x.try_cast("boolean")))

    def number(self, test: Test) -> Column:
        return _some(self.elements, lambda x: F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)") & test(x.try_cast("double")))

    def place(self, test: Callable[[Column, Column], Column]) -> Column:
        def at(x: Column) -> Column:
            lon, lat = (F.try_variant_get(x, f"$.{k}", "double") for k in ("lon", "lat"))
            return lon.between(-180, 180) & lat.between(-90, 90) & test(lon, lat)

        return _some(self.elements, at)

    def other_than(self, strings: list[str], integers: list[int]) -> Column:
        def other(x: Column) -> Column:
            kind = F.schema_of_variant(x)
            listed = F.lit(False)
            if strings:
                listed = (kind == "STRING") & x.try_cast("string").isin(strings)
            elif integers:
                listed = (kind == "BIGINT") & x.try_cast("long").isin(integers)
            return (kind != "VOID") & ~is_true(listed)

        return _some(self.elements, other)

    def _sizes(self) -> Column:
        return F.transform(self.items, lambda x: F.when(F.is_variant_null(x), 0).otherwise(F.coalesce(F.size(_array(x)), F.lit(1))))

    def count(self, test: Test) -> Column:
        return F.when(F.size(self.items) == 0, is_true(test(F.lit(0)))).otherwise(_some(self._sizes(), test))

    def all_empty(self) -> Column:
        return F.forall(self._sizes(), lambda n: n == 0)

    def any_null(self, inside: bool) -> Column:
        return _some(self.elements if inside else self.items, F.is_variant_null)

    def missing(self) -> Column:
        return F.size(self.items) == 0

    def nested(self, test: Callable[[Column], Column]) -> Column:
        lists = F.flatten(F.transform(self.items, lambda x: F.coalesce(_array(x), F.array().cast("array<variant>"))))
        return _some(lists, lambda x: F.schema_of_variant(x).startswith("OBJECT") & test(x))

    def point(self) -> tuple[Column, Column]:
        first = F.get(self.elements, F.lit(0))
        return F.try_variant_get(first, "$.lon", "double"), F.try_variant_get(first, "$.lat", "double")

    def scalars(self, kind: str) -> Column:
        pattern, to = {"keyword": ("^STRING", "string"), "uuid": ("^STRING", "string"), "datetime": ("^STRING", "string"), "integer": ("^BIGINT", "long"), "float": ("^(BIGINT|DOUBLE|DECIMAL|FLOAT)", "double"), "bool": ("^BOOLEAN", "boolean")}[kind]
        found = F.transform(F.filter(self.elements, lambda x: F.schema_of_variant(x).rlike(pattern)), lambda x: x.try_cast(to))
        return F.filter(F.transform(found, parse_time), lambda x: x.isNotNull()) if kind == "datetime" else found


class ColumnValues(Values):
    """A typed column; an array of it holds several values, null is a missing field. Conditions on it reach the scan."""

    def __init__(self, column: Column, kind: T.DataType):
        self.many = isinstance(kind, T.ArrayType)
        self.column, self.kind = column, kind.elementType if isinstance(kind, T.ArrayType) else kind

    def _some(self, test: Test) -> Column:
        return F.exists(self.column, lambda x: is_true(test(x))) if self.many else test(self.column)

    def _if(self, kinds: tuple, test: Test) -> Column:
        return self._some(test) if isinstance(self.kind, kinds) else F.lit(False)

    def string(self, test: Test) -> Column:
        return self._if((T.StringType,), test)

    def integer(self, test: Test) -> Column:
        return self._if((T.ByteType, T.ShortType, T.IntegerType, T.LongType), test)

    def boolean(self, test: Test) -> Column:
        return self._if((T.BooleanType,), test)

    def number(self, test: Test) -> Column:
        return self._if((T.NumericType,), test)

    def time(self, test: Test) -> Column:
        if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return self._some(lambda x: test(F.unix_micros(x.cast("timestamp"))))
        return super().time(test)

    def place(self, test: Callable[[Column, Column], Column]) -> Column:
        return self._if((T.StructType,), lambda x: test(x["lon"], x["lat"]))

    def other_than(self, strings: list[str], integers: list[int]) -> Column:
        fits = isinstance(self.kind, T.StringType) if strings else isinstance(self.kind, T.IntegralType)
        listed: list = strings or integers
        return self._some(lambda x: x.isNotNull() & (~x.isin(listed) if fits and listed else F.lit(True)))

    def strings(self) -> Column:
        if not isinstance(self.kind, T.StringType):
            return F.array().cast("array<string>")
        return F.filter(F.coalesce(self.column, F.array().cast("array<string>")) if self.many else F.array(self.column), lambda x: x.isNotNull())

    def _size(self) -> Column:
        return F.coalesce(F.size(self.column), F.lit(0)) if self.many else F.when(self.column.isNull(), 0).otherwise(1)

    def count(self, test: Test) -> Column:
        return is_true(test(self._size()))

    def all_empty(self) -> Column:
        return self._size() == 0

    def any_null(self, inside: bool) -> Column:
        return is_true(F.exists(self.column, lambda x: x.isNull())) if self.many and inside else F.lit(False)

    def missing(self) -> Column:
        return self.column.isNull()

    def nested(self, test: Callable[[Column], Column]) -> Column:
        return F.lit(False)

    def point(self) -> tuple[Column, Column]:
        first = F.get(self.column, F.lit(0)) if self.many else self.column
        return first["lon"], first["lat"]

    def scalars(self, kind: str) -> Column:
        items = F.coalesce(self.column, F.array().cast(T.ArrayType(self.kind))) if self.many else F.when(self.column.isNull(), F.array().cast(T.ArrayType(self.kind))).otherwise(F.array(self.column))
        if kind == "datetime":
            return F.transform(items, (lambda x: parse_time(x)) if isinstance(self.kind, T.StringType) else (lambda x: F.unix_micros(x.cast("timestamp"))))
        return items
