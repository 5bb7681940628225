"""A collection: a table of points with what is known about its vectors and payload."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import Scope, compile_filter
from .functions.metrics import DISTANCES
from .functions.text import TextIndex
from .functions.values import ColumnValues, JsonValues, Values, is_true


@dataclass(frozen=True)
class Dense:
    """A named vector: its column, size and distance; multi if a point has several, compared by their best matches."""

    column: str
    size: int
    distance: str = "Cosine"
    multi: bool = False

    def __post_init__(self):
        if self.distance not in DISTANCES or self.size < 1:
            raise ValueError(f"a vector needs a size and one of the distances {DISTANCES}")


@dataclass(frozen=True)
class Sparse:
    """A named sparse vector, a struct of indices and values; idf if rare indices of a query weigh more."""

    column: str
    idf: bool = False


@dataclass(frozen=True)
class Collection:
    """df has a column of ids, one for each vector, and payload fields: as a JSON text, as columns, or both.

    fields names columns that hold a payload field of another name; index declares a field's kind: keyword, integer,
    float, bool, datetime, uuid, geo, or a TextIndex, which changes what matching a text means. shard_key: the column by which
    requests choose points.
    """

    df: DataFrame
    id: str = "id"
    vectors: dict[str, Dense] = field(default_factory=dict)
    sparse: dict[str, Sparse] = field(default_factory=dict)
    payload: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    index: dict[str, TextIndex | str] = field(default_factory=dict)
    shard_key: str | None = None

    def with_df(self, df: DataFrame) -> Collection:
        return replace(self, df=df)

    def values(self, key: str) -> Values:
        column = self.fields.get(key) or (key if self.payload is None and key in self.df.columns else None)
        if column:
            return ColumnValues(F.col(column), self.df.schema[column].dataType)
        if self.payload is None:
            raise ValueError(f"no field {key!r}")
        return JsonValues(F.try_parse_json(F.col(self.payload)), key)

    def scope(self) -> Scope:
        named = {n: F.col(v.column) for n, v in {**self.vectors, **self.sparse}.items()}
        return Scope(self.values, self.index.get, F.col(self.id), named)

    def condition(self, spec: dict | None) -> Column:
        """Whether each point meets a filter, never null."""
        return is_true(compile_filter(spec, self.scope()))

    def where(self, spec: dict | None) -> DataFrame:
        return self.df.where(compile_filter(spec, self.scope())) if spec else self.df

    def vector(self, name: str = "") -> Dense | Sparse:
        found = self.vectors.get(name) or self.sparse.get(name)
        if found is None:
            raise ValueError(f"no vector named {name!r}")
        return found
