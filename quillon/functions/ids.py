"""Stable ids: a prefix and 16 hex digits of a SHA-1 over sorted JSON components (SCL1, FLT8)."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

PRINTABLE = r"^[\x20-\x7E]*\z"


# What JSON writes for these characters.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _escaped(x: Column) -> Column:
    """A character as JSON in ASCII: itself, a short escape, or its UTF-16 units in hexadecimal."""
    point = F.ascii(x)
    unit = lambda v: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(v), 4, "0")))
    beyond = point - 0x10000
    pair = F.concat(unit(F.lit(0xD800) + F.shiftright(beyond, 10)), unit(F.lit(0xDC00) + beyond.bitwiseAND(0x3FF)))
    short = F.when(point.between(32, 126) & ~x.isin('"', "\\"), x)
    for char, escape in SHORT.items():
        short = short.when(x == char, escape)
    return short.when(point < 0x10000, unit(point)).otherwise(pair)


def json_text(c: Column, any_text: bool = True) -> Column:
    """A string column as JSON, `null` for null, with every code point beyond ASCII escaped.

    Printable ASCII takes two replacements; other texts go character by character. any_text=False: the caller
    knows that values are printable ASCII.
    """
    plain = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    if not any_text:
        return F.coalesce(plain, F.lit("null"))
    escaped = F.concat(F.lit('"'), F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), _escaped), ""), F.lit('"'))
    return F.coalesce(F.when(F.regexp_like(c, F.lit(PRINTABLE)), plain).otherwise(escaped), F.lit("null"))


def digest_id(prefix: str, json_values: dict[str, Column | str]) -> Column:
    """The id of components whose values are JSON text already; usable inside lambdas."""
    parts: list[Column] = []
    for k, name in enumerate(sorted(json_values)):
        v = json_values[name]
        parts += [F.lit(("{" if k == 0 else ", ") + json.dumps(name) + ": "), F.lit(v) if isinstance(v, str) else v]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat(*parts, F.lit("}")).cast("binary")), 1, 16))


def stable_id(prefix: str, components: dict[str, Column | int | None], any_text: bool = True) -> Column:
    return digest_id(prefix, {k: json.dumps(v) if v is None or isinstance(v, int) else json_text(v, any_text) for k, v in components.items()})


def stable_id_sql(prefix: str, components: dict[str, str | int | None]) -> str:
    """The same as SQL text for printable ASCII values; strings are SQL expressions."""
    parts = []
    for k, name in enumerate(sorted(components)):
        v = components[name]
        parts.append("'" + ("{" if k == 0 else ", ") + json.dumps(name) + ": '")
        parts.append(f"'{json.dumps(v)}'" if v is None or isinstance(v, int) else f"coalesce('\"' || {v} || '\"', 'null')")
    return f"'{prefix}_' || substr(sha1({' || '.join(parts)} || '}}'), 1, 16)"


def assertion_id(image_id: Column, attribute: Column, phrase: Column, label: Column) -> Column:
    padded = lambda i, n: F.when(i < 10 ** (n - 1), F.lpad(i.cast("string"), n, "0")).otherwise(i.cast("string"))
    return F.concat_ws("::", F.lit("ci_attr"), F.coalesce(image_id, F.lit("unknown_image")), padded(attribute, 4), padded(phrase, 3), padded(label, 3))
