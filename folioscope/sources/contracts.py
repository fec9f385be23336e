"""Validation of VARIANT documents against a contract given as a tree of schemas."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.columns import let
from folioscope.functions.variants import elements, kind, members

_FOUND = "array<struct<path:string,violation:string>>"
_TYPES = ("object", "array", "string", "boolean", "number", "integer", "null")
_ALTERNATIVES = ("oneOf", "anyOf")


def _one(path: Column, violation: Column) -> Column:
    return F.array(F.struct(path.alias("path"), violation.alias("violation")))


def _fits(k: Column, wanted: str | list) -> Column:
    """Whether a value's kind is one of the wanted types; whole numbers are numbers, and an unknown type fits everything."""
    names = [wanted] if isinstance(wanted, str) else list(wanted)
    if any(n not in _TYPES for n in names):
        return F.lit(True)
    return k.isin(*names, *(["integer"] if "number" in names else []))


def _literal(x: object) -> str:
    return json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def violations(value: Column, schema: Mapping, path: Column) -> Column:
    """All violations of one value, as an array of (path, violation).

    A schema may have ``type`` (a name or a list of names), ``enum``, ``oneOf`` and ``anyOf`` (each: at least one alternative
    holds), for objects ``required`` and ``properties``, for lists ``items``. A value of a wrong type has no further
    violations. Members that the schema does not name are no violation. The tree of schemas becomes one
    Column; lists of any length and nesting are walked by the rows' own elements.
    """
    present = F.coalesce(value, F.parse_json(F.lit("null")))
    return let(F.struct(present.alias("v"), kind(present).alias("k")), lambda bound: _judged(bound["v"], bound["k"], schema, path))


def _judged(v: Column, k: Column, schema: Mapping, path: Column) -> Column:
    """Violations of a value whose kind is known; alternatives are judged by the same kind."""
    none = F.array().cast(_FOUND)
    parts = []
    if "enum" in schema:
        allowed = [_literal(x) for x in schema["enum"]]
        parts.append(F.when(~F.to_json(v).isin(*allowed), _one(path, F.concat(F.lit("enum:"), F.to_json(v)))))
    for combiner in _ALTERNATIVES:
        if combiner in schema:
            fits = F.lit(False)
            for other in schema[combiner]:
                fits = fits | (F.size(_judged(v, k, other, path)) == 0)
            parts.append(F.when(~fits, _one(path, F.lit(combiner))))
    if schema.get("required") or schema.get("properties"):
        parts.append(F.when(k == "object", let(members(v), lambda m: _members(m, schema, path))))
    if "items" in schema:
        walk = F.transform(elements(v), lambda x, i: violations(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        parts.append(F.when(k == "array", F.flatten(walk)))
    found = F.concat(*[F.coalesce(p, none) for p in parts]) if parts else none
    if "type" not in schema:
        return found
    wrong = _one(path, F.concat(F.lit("type:"), k))
    return F.when(_fits(k, schema["type"]), found).otherwise(wrong)


def _members(named: Column, schema: Mapping, path: Column) -> Column:
    """Violations of an object's members: required ones that are absent, then those of the members that the schema knows."""
    none = F.array().cast(_FOUND)
    missing = [F.when(~F.map_contains_key(named, name), _one(path, F.lit(f"missing:{name}"))).otherwise(none) for name in schema.get("required", ())]
    known = schema.get("properties", {}).items()
    found = [F.when(F.map_contains_key(named, name), violations(F.try_element_at(named, F.lit(name)), sub, F.concat(path, F.lit(f".{name}")))).otherwise(none) for name, sub in known]
    return F.concat(*missing, *found)


def conformance(docs: DataFrame, schema: Mapping, key: str = "doc_key", content: str = "doc") -> DataFrame:
    """(key, path, violation) of every violation in a column of VARIANT documents; paths read ``$.a[3].b``.

    A document that is no JSON (null) has one violation, ``no_json``.
    """
    doc = F.col(content)
    found = F.when(doc.isNull(), _one(F.lit("$"), F.lit("no_json"))).otherwise(violations(doc, schema, F.lit("$")))
    return docs.select(key, F.inline(found))
