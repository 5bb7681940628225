"""JSON text reduced to a form in which equal values have equal text."""

from __future__ import annotations

import json


class Number:
    """A JSON number by its exact decimal value, whatever its size or spelling."""

    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = normal_number(text)


def normal_number(text: str) -> str:
    """Sign, digits without outer zeros, and a power of ten: 10, 10.0 and 1e1 give '1e1'."""
    sign, body = ("-", text[1:]) if text[0] == "-" else ("", text)
    mantissa, _, power = body.replace("E", "e").partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    short = digits.rstrip("0")
    if not short:
        return "0"
    return f"{sign}{short}e{int(power or 0) - len(part) + len(digits) - len(short)}"


def _refuse(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_refuse).decode
_quote = json.encoder.encode_basestring_ascii


def canonical(value) -> str:
    """Text of a decoded value; object keys in order, escapes in one way."""
    kind = type(value)
    if kind is str:
        return _quote(value)
    if kind is Number:
        return value.text
    if kind is dict:
        return "{" + ",".join([f"{_quote(k)}:{canonical(value[k])}" for k in sorted(value)]) + "}"
    if kind is list:
        return "[" + ",".join([canonical(x) for x in value]) + "]"
    return "null" if value is None else "true" if value else "false"


def top_level(text: str | None) -> list[tuple[str, str]] | None:
    """Canonical value by key of an object, in key order; [] of null; None of what isn't a JSON object."""
    if text is None:
        return []
    try:
        value = _decode(text)
        return [(k, canonical(value[k])) for k in sorted(value)] if type(value) is dict else None
    except (ValueError, RecursionError):
        return None
