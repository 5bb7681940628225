"""Formulas that give a new score from earlier scores and payload values, as a column in double precision."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..filters import Scope, compile_condition
from . import geo
from .values import is_true, parse_time

_SCORE = re.compile(r"\$score(?:\[(\d+)\])?$")


def _wrong(text: str) -> Column:
    return F.raise_error(F.lit(text)).cast("double")


def _finite(c: Column, what: str) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull(), _wrong(f"the result of {what} is no finite number")).otherwise(c)


class Formula:
    """Compiles an expression. scores: the columns of earlier scores; defaults: values of variables that are missing."""

    def __init__(self, scope: Scope, scores: Callable[[int], Column | None], defaults: dict | None = None):
        self.scope, self.scores, self.defaults = scope, scores, defaults or {}

    def column(self, e) -> Column:
        if isinstance(e, bool):
            raise ValueError("a truth value is no expression")
        if isinstance(e, (int, float)):
            return F.lit(float(e))
        if isinstance(e, str):
            return self._variable(e)
        if len(e) != 1 or "key" in e or set(e) & {"must", "should", "must_not", "min_should"}:
            return is_true(compile_condition(e, self.scope)).cast("double")
        ((kind, x),) = e.items()
        plain = getattr(self, f"_{kind}", None)
        if plain is None:
            return is_true(compile_condition(e, self.scope)).cast("double")
        return plain(x)

    def _variable(self, name: str) -> Column:
        default = self.defaults.get(name)
        if m := _SCORE.match(name):
            score = self.scores(int(m[1] or 0))
            other = F.lit(float(default if default is not None else 0.0))
            return other if score is None else F.coalesce(score, other)
        values = self.scope.field(name).scalars("float")
        found = F.when(F.size(values) == 1, F.get(values, F.lit(0)).cast("double"))
        found = F.when(F.size(values) > 1, _wrong(f"{name} has several values")).otherwise(found)
        return F.coalesce(found, F.lit(float(default)) if isinstance(default, (int, float)) else _wrong(f"{name} has no value"))

    def _sum(self, xs: list) -> Column:
        return reduce(lambda a, b: a + b, map(self.column, xs), F.lit(0.0))

    def _mult(self, xs: list) -> Column:
        """A factor of zero ends it, so that later factors can't fail."""
        result = F.lit(1.0)
        for x in reversed(xs):
            c = self.column(x)
            result = F.when(c == 0, F.lit(0.0)).otherwise(c * result)
        return result

    def _neg(self, x) -> Column:
        return -self.column(x)

    def _abs(self, x) -> Column:
        return F.abs(self.column(x))

    def _div(self, x: dict) -> Column:
        left, right, default = self.column(x["left"]), self.column(x["right"]), x.get("by_zero_default")
        zero = _wrong("division by zero") if default is None else F.lit(float(default))
        return F.when(left == 0, F.lit(0.0)).when(right == 0, zero).otherwise(left / F.when(right == 0, F.lit(1.0)).otherwise(right))

    def _sqrt(self, x) -> Column:
        return _finite(F.sqrt(self.column(x)), "sqrt")

    def _pow(self, x: dict) -> Column:
        return _finite(F.pow(self.column(x["base"]), self.column(x["exponent"])), "pow")

    def _exp(self, x) -> Column:
        return _finite(F.exp(self.column(x)), "exp")

    def _ln(self, x) -> Column:
        return _finite(F.log(self.column(x)), "ln")

    def _log10(self, x) -> Column:
        return _finite(F.log10(self.column(x)), "log10")

    def _geo_distance(self, x: dict) -> Column:
        origin, field = x["origin"], self.scope.field(x["to"])
        lon, lat = field.point()
        default = self.defaults.get(x["to"])
        other = geo.haversine(F.lit(float(default["lon"])), F.lit(float(default["lat"])), origin["lon"], origin["lat"]) if default else _wrong(f"{x['to']} has no value")
        return F.coalesce(geo.haversine(lon, lat, origin["lon"], origin["lat"]), other)

    def _datetime(self, x: str) -> Column:
        return parse_time(F.lit(x)) / 1e6

    def _datetime_key(self, x: str) -> Column:
        found = F.get(self.scope.field(x).scalars("datetime"), F.lit(0)) / 1e6
        default = self.defaults.get(x)
        return F.coalesce(found, parse_time(F.lit(default)) / 1e6 if isinstance(default, str) else _wrong(f"{x} has no value"))

    def _decay(self, x: dict) -> tuple[Column, float, float]:
        away = self.column(x["x"]) - (self.column(x["target"]) if x.get("target") is not None else F.lit(0.0))
        scale, middle = float(x.get("scale") or 1.0), float(x.get("midpoint") or 0.5)
        if scale <= 0 or not 0 < middle < 1:
            raise ValueError("a decay has a scale above 0 and a midpoint between 0 and 1")
        return away, scale, middle

    def _exp_decay(self, x: dict) -> Column:
        away, scale, middle = self._decay(x)
        return F.exp(math.log(middle) / scale * F.abs(away))

    def _gauss_decay(self, x: dict) -> Column:
        away, scale, middle = self._decay(x)
        return F.exp(math.log(middle) / (scale * scale) * away * away)

    def _lin_decay(self, x: dict) -> Column:
        away, scale, middle = self._decay(x)
        return F.greatest(F.lit(0.0), 1 - (1 - middle) / scale * F.abs(away))
