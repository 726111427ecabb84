"""Boolean filters over JSON payloads: a small tree, read from three JSON dialects, compiled to one Column.

The logic is two-valued: a leaf that can't be decided is false, and a null payload fails every filter, negations included. Keys
are flat: ``a.b`` is the key of that name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F

from ..errors import InvalidInput
from ..functions.vector import haversine

CLAUSES = ("must", "should", "must_not", "min_should")
_NUMBER = "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"


@dataclass(frozen=True)
class Clause:
    kind: str
    parts: tuple
    least: int = 0


@dataclass(frozen=True)
class Leaf:
    kind: str
    key: str
    args: Any = None


def parse(spec: dict) -> Clause | Leaf:
    """A filter from JSON: ``{"must": [...]}`` and the other clauses, which may be combined and nested (``{"filter": ...}`` too), or ``{key: value}``."""
    if not isinstance(spec, dict):
        raise InvalidInput(f"not a filter: {spec!r}")
    found = [k for k in CLAUSES if k in spec]
    if not found:
        return Clause("must", tuple(Leaf("match", k, v) for k, v in spec.items()))
    parts = []
    for k in found:
        body = spec[k]
        if k == "min_should":
            parts.append(Clause(k, tuple(map(_condition, body["conditions"])), int(body["min_count"])))
        else:
            parts.append(Clause(k, tuple(map(_condition, body if isinstance(body, list) else [body]))))
    return parts[0] if len(parts) == 1 else Clause("must", tuple(parts))


def _condition(c: dict) -> Clause | Leaf:
    if "filter" in c and isinstance(c["filter"], dict):
        return parse(c["filter"])
    if any(k in c for k in CLAUSES):
        return parse(c)
    (kind, body), *more = c.items()
    if more or not isinstance(body, dict) or "key" not in body:
        raise InvalidInput(f"not a condition: {c!r}")
    args = {k: v for k, v in body.items() if k != "key"}
    if kind == "match":
        kind, args = ("match_any", args["any"]) if "any" in args else ("match_text", args["text"]) if "text" in args else ("match", args.get("value"))
    elif kind == "match_any":
        args = args.get("any", args.get("values"))
    elif kind == "match_text":
        args = args.get("text")
    elif kind == "range":
        args = args.get("range", args)
    elif kind == "geo_radius":
        args = args | (args.pop("center", None) or {})
    if kind not in _LEAVES:
        raise InvalidInput(f"unknown condition: {kind}")
    return Leaf(kind, body["key"], args)


def compile_filter(spec: dict | Clause | Leaf, metadata: Column) -> Column:
    """A boolean Column, never null, over a payload in JSON text."""
    tree = parse(spec) if isinstance(spec, dict) else spec
    v = F.try_parse_json(metadata)
    return F.coalesce(v.isNotNull() & _column(tree, v), F.lit(False))


def _column(node: Clause | Leaf, v: Column) -> Column:
    if isinstance(node, Leaf):
        path = '$["' + node.key.replace("\\", "\\\\").replace('"', '\\"') + '"]'
        return F.coalesce(_LEAVES[node.kind](v, path, node.args), F.lit(False))
    parts = [_column(p, v) for p in node.parts]
    if node.kind == "must":
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    if node.kind == "min_should":
        return sum((p.cast("int") for p in parts), F.lit(0)) >= node.least
    some = reduce(lambda a, b: a | b, parts, F.lit(False))
    return ~some if node.kind == "must_not" else some


def _value(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def _equals(v: Column, path: str, want: Any) -> Column:
    """Equal and of the same JSON type: 3.0 and "3" aren't the integer 3."""
    x = _value(v, path)
    if isinstance(want, bool):
        return (_kind(x) == "BOOLEAN") & (F.try_variant_get(v, path, "boolean") == want)
    if isinstance(want, int):
        return (_kind(x) == "BIGINT") & (F.try_variant_get(v, path, "bigint") == want)
    if isinstance(want, str):
        return (_kind(x) == "STRING") & (F.try_variant_get(v, path, "string") == want)
    raise InvalidInput(f"a keyword is text, an integer or a boolean, not {want!r}")


def _bounds(x: Column, args: dict) -> Column:
    ops = {"gte": x.__ge__, "gt": x.__gt__, "lte": x.__le__, "lt": x.__lt__}
    return reduce(lambda a, b: a & b, (ops[k](b) for k, b in args.items() if k in ops and b is not None), F.lit(True))


def _number(v: Column, path: str) -> Column:
    return F.when(_kind(_value(v, path)).rlike(_NUMBER), F.try_variant_get(v, path, "double"))


def _range(v, path, args):
    x = _number(v, path)
    return x.isNotNull() & _bounds(x, args)


def _text(v, path, text):
    return (_kind(_value(v, path)) == "STRING") & (F.instr(F.lower(F.try_variant_get(v, path, "string")), text.lower()) > 0)


def _radius(v, path, a):
    lat, lon = _number(v, path + ".lat"), _number(v, path + ".lon")
    return haversine(F.lit(float(a["lat"])), F.lit(float(a["lon"])), lat, lon) <= float(a.get("radius_meters", a.get("radius")))


def _box(v, path, a):
    lat, lon = _number(v, path + ".lat"), _number(v, path + ".lon")
    return lat.between(a["bottom_right"]["lat"], a["top_left"]["lat"]) & lon.between(a["top_left"]["lon"], a["bottom_right"]["lon"])


def _array(v, path):
    return F.when(_kind(_value(v, path)).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def _count(v, path, args):
    a = _array(v, path)
    return a.isNotNull() & _bounds(F.size(a), args)


def _empty(v, path, _):
    return (F.size(_array(v, path)) == 0) | ((_kind(_value(v, path)) == "STRING") & (F.try_variant_get(v, path, "string") == ""))


_LEAVES = {
    "match": _equals,
    "match_any": lambda v, path, wants: reduce(lambda a, b: a | b, (F.coalesce(_equals(v, path, w), F.lit(False)) for w in wants), F.lit(False)),
    "match_text": _text,
    "range": _range,
    "geo_radius": _radius,
    "geo_bounding_box": _box,
    "values_count": _count,
    "is_empty": _empty,
    "is_null": lambda v, path, _: F.is_variant_null(_value(v, path)),
}
