"""JSON-schema documents compiled to column expressions over VARIANT.

``compile_schema`` turns a document into one expression that gives every violation of a JSON text with its path,
so that checking a table of documents is a projection: no Python runs on the rows. Keywords: type, enum, const, required,
properties, additionalProperties, propertyNames, minProperties, maxProperties, items, minItems, maxItems,
uniqueItems, minLength, maxLength, pattern, format (date-time, date, uuid), minimum, maximum, exclusiveMinimum,
exclusiveMaximum, allOf, anyOf, oneOf, not, if/then/else, and $ref into the same document ($defs may not
be recursive). Another keyword that constrains values is refused when the schema is compiled.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that say nothing about values.
NOTES = {"$schema", "$id", "title", "description", "$defs", "$comment", "default", "examples"}
FORMATS = {
    "date-time": r"^\d{4}-\d{2}-\d{2}[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "uuid": r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
}
_NONE = "array<struct<path:string,rule:string>>"


class SchemaError(ValueError):
    """The document uses a keyword that isn't known here, or uses one in a way that can't be compiled."""


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kind(v: Column) -> Column:
    """The JSON type of a value: null, boolean, integer, number, string, array or object."""
    named = {"VOID": "null", "BOOLEAN": "boolean", "STRING": "string", "ARRAY": "array", "OBJECT": "object", "BIGINT": "integer"}
    number = F.try_variant_get(v, "$", "double")
    other = F.when(F.floor(number) == number, "integer").otherwise("number")
    return _let(F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0), lambda name: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), name), other))


def _violation(when: Column, path: Column, rule: str) -> Column:
    one = F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))
    return F.when(F.coalesce(when, F.lit(False)), one).otherwise(F.array().cast(_NONE))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _member(v: Column, name: str) -> Column:
    """A member of an object, null if there is none (a member that is null is a value)."""
    if "'" in name or "\\" in name:
        return F.element_at(_members(v), F.lit(name))
    return F.try_variant_get(v, f"$['{name}']", "variant")


class _Compiler:
    def __init__(self, root: dict) -> None:
        self.root = root

    def _of(self, ref: str) -> dict:
        if not ref.startswith("#"):
            raise SchemaError(f"$ref {ref} leaves the document")
        at = self.root
        for part in filter(None, ref[1:].split("/")):
            at = at[part.replace("~1", "/").replace("~0", "~")]
        return at

    def compile(self, schema: dict | bool, v: Column, path: Column, depth: int, refs: tuple[str, ...] = ()) -> Column:
        """Violations of ``schema`` by the value ``v`` at ``path``; ``v`` must not be a missing value."""
        if schema is True or schema == {}:
            return F.array().cast(_NONE)
        if schema is False:
            return _violation(F.lit(True), path, "false")
        of = lambda x: F.struct(x.alias("v"), _kind(x).alias("kind"))
        return _let(v, lambda x: _let(of(x), lambda both: self._body(schema, both["v"], both["kind"], path, depth, refs)))

    def _body(self, schema: dict, v: Column, kind: Column, path: Column, depth: int, refs: tuple[str, ...]) -> Column:
        found = []
        for word in schema:
            if word in NOTES or word in ("then", "else"):
                continue
            if word == "$ref":
                ref = schema[word]
                if ref in refs:
                    raise SchemaError(f"$ref {ref} is recursive")
                found.append(self.compile(self._of(ref), v, path, depth, (*refs, ref)))
                continue
            rule: Callable | None = getattr(self, f"_{word}", None)
            if rule is None:
                raise SchemaError(f"keyword {word} is not known")
            found.append(rule(schema[word], schema, v, kind, path, depth, refs))
        return reduce(F.concat, found) if found else F.array().cast(_NONE)

    def _fails(self, schema, v, path, depth, refs) -> Column:
        return F.size(self.compile(schema, v, path, depth, refs)) > 0

    # Any value

    def _type(self, types, schema, v, kind, path, depth, refs):
        wanted = [types] if isinstance(types, str) else list(types)
        if "number" in wanted:
            wanted.append("integer")
        return _violation(~kind.isin(*wanted), path, "type")

    def _enum(self, values, schema, v, kind, path, depth, refs):
        if any(isinstance(x, (dict, list)) for x in values):
            raise SchemaError("enum of objects or arrays")
        kinds = {str: "string", bool: "boolean", type(None): "null", int: "number", float: "number"}
        alike = [self._equals(x, kinds[type(x)], v, kind) for x in values]
        return _violation(~reduce(lambda a, b: a | b, alike), path, "enum")

    def _equals(self, value, of: str, v, kind) -> Column:
        if of == "null":
            return kind == "null"
        if of == "number":
            return kind.isin("integer", "number") & (F.try_variant_get(v, "$", "double") == float(value))
        return (kind == of) & (_text(v) == (json.dumps(value) if of == "boolean" else value))

    def _const(self, value, schema, v, kind, path, depth, refs):
        if isinstance(value, (dict, list)):
            raise SchemaError("const of an object or array")
        found = self._enum([value], schema, v, kind, path, depth, refs)
        return F.transform(found, lambda x: F.struct(x["path"].alias("path"), F.lit("const").alias("rule")))

    # Texts

    def _string(self, when: Column, kind: Column, path: Column, rule: str) -> Column:
        return _violation((kind == "string") & when, path, rule)

    def _minLength(self, n, schema, v, kind, path, depth, refs):
        return self._string(F.length(_text(v)) < n, kind, path, "minLength")

    def _maxLength(self, n, schema, v, kind, path, depth, refs):
        return self._string(F.length(_text(v)) > n, kind, path, "maxLength")

    def _pattern(self, pattern, schema, v, kind, path, depth, refs):
        return self._string(~_text(v).rlike(pattern), kind, path, "pattern")

    def _format(self, name, schema, v, kind, path, depth, refs):
        if name not in FORMATS:
            raise SchemaError(f"format {name} is not known")
        text = _text(v)
        ok = text.rlike(FORMATS[name])
        if name != "uuid":  # the pattern lets days through that are not in the calendar
            ok = ok & F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull()
        return self._string(~ok, kind, path, "format")

    # Numbers

    def _number(self, when: Callable[[Column], Column], v, kind, path, rule) -> Column:
        return _violation(kind.isin("integer", "number") & when(F.try_variant_get(v, "$", "double")), path, rule)

    def _minimum(self, n, schema, v, kind, path, depth, refs):
        return self._number(lambda x: x < n, v, kind, path, "minimum")

    def _maximum(self, n, schema, v, kind, path, depth, refs):
        return self._number(lambda x: x > n, v, kind, path, "maximum")

    def _exclusiveMinimum(self, n, schema, v, kind, path, depth, refs):
        return self._number(lambda x: x <= n, v, kind, path, "exclusiveMinimum")

    def _exclusiveMaximum(self, n, schema, v, kind, path, depth, refs):
        return self._number(lambda x: x >= n, v, kind, path, "exclusiveMaximum")

    # Arrays

    def _items(self, of, schema, v, kind, path, depth, refs):
        one = lambda x, k: self.compile(of, x, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")), depth + 1, refs)
        checked = F.flatten(F.transform(F.coalesce(_items(v), F.array().cast("array<variant>")), one))
        return F.when(kind == "array", checked).otherwise(F.array().cast(_NONE))

    def _size(self, when: Callable[[Column], Column], v, kind, path, rule) -> Column:
        return _violation((kind == "array") & when(F.size(_items(v))), path, rule)

    def _minItems(self, n, schema, v, kind, path, depth, refs):
        return self._size(lambda x: x < n, v, kind, path, "minItems")

    def _maxItems(self, n, schema, v, kind, path, depth, refs):
        return self._size(lambda x: x > n, v, kind, path, "maxItems")

    def _uniqueItems(self, wanted, schema, v, kind, path, depth, refs):
        texts = F.transform(_items(v), lambda x: F.to_json(x))
        return _violation((kind == "array") & (F.size(F.array_distinct(texts)) < F.size(texts)), path, "uniqueItems") if wanted else F.array().cast(_NONE)

    # Objects

    def _keys(self, v) -> Column:
        return F.coalesce(F.map_keys(_members(v)), F.array().cast("array<string>"))

    def _required(self, names, schema, v, kind, path, depth, refs):
        told = [_violation((kind == "object") & _member(v, n).isNull(), F.concat(path, F.lit(f".{n}")), "required") for n in names]
        return reduce(F.concat, told) if told else F.array().cast(_NONE)

    def _properties(self, of, schema, v, kind, path, depth, refs):
        found = []
        for name, inner in of.items():
            value = _member(v, name)
            checked = self.compile(inner, value, F.concat(path, F.lit(f".{name}")), depth + 1, refs)
            found.append(F.when(value.isNotNull(), checked).otherwise(F.array().cast(_NONE)))
        return reduce(F.concat, found) if found else F.array().cast(_NONE)

    def _additionalProperties(self, of, schema, v, kind, path, depth, refs):
        if of is True:
            return F.array().cast(_NONE)
        named = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
        more = F.array_sort(F.filter(self._keys(v), lambda n: ~F.array_contains(named, n)))
        if of is False:
            told = F.transform(more, lambda n: F.struct(F.concat(path, F.lit("."), n).alias("path"), F.lit("additionalProperties").alias("rule")))
        else:
            members = _members(v)
            told = F.flatten(F.transform(more, lambda n: self.compile(of, F.element_at(members, n), F.concat(path, F.lit("."), n), depth + 1, refs)))
        return F.when(kind == "object", told).otherwise(F.array().cast(_NONE))

    def _propertyNames(self, of, schema, v, kind, path, depth, refs):
        name = lambda n: F.variant_get(F.parse_json(F.to_json(F.array(n))), "$[0]", "variant")  # noqa: E731  a member's name as a value
        one = lambda n: self.compile(of, name(n), F.concat(path, F.lit("."), n), depth + 1, refs)
        return F.when(kind == "object", F.flatten(F.transform(F.array_sort(self._keys(v)), one))).otherwise(F.array().cast(_NONE))

    def _minProperties(self, n, schema, v, kind, path, depth, refs):
        return _violation((kind == "object") & (F.size(self._keys(v)) < n), path, "minProperties")

    def _maxProperties(self, n, schema, v, kind, path, depth, refs):
        return _violation((kind == "object") & (F.size(self._keys(v)) > n), path, "maxProperties")

    # Several schemas

    def _allOf(self, of, schema, v, kind, path, depth, refs):
        return reduce(F.concat, [self.compile(x, v, path, depth, refs) for x in of])

    def _anyOf(self, of, schema, v, kind, path, depth, refs):
        return _violation(reduce(lambda a, b: a & b, [self._fails(x, v, path, depth, refs) for x in of]), path, "anyOf")

    def _oneOf(self, of, schema, v, kind, path, depth, refs):
        passed = reduce(lambda a, b: a + b, [F.when(self._fails(x, v, path, depth, refs), 0).otherwise(1) for x in of])
        return _violation(passed != 1, path, "oneOf")

    def _not(self, of, schema, v, kind, path, depth, refs):
        return _violation(~self._fails(of, v, path, depth, refs), path, "not")

    def _if(self, of, schema, v, kind, path, depth, refs):
        fails = self._fails(of, v, path, depth, refs)
        sides = [self.compile(schema.get(side, True), v, path, depth, refs) for side in ("then", "else")]
        return F.when(fails, sides[1]).otherwise(sides[0])


def compile_schema(schema: dict | bool) -> Callable[[Column], Column]:
    """A function of a column of JSON texts that gives an array of (path, rule), empty for a sound document.

    A null text, or one that is no JSON (or names a member of an object twice), has the one violation ("$", "json").
    Paths are ``$``, then .name and [number]; violations come in the order of the schema's keywords.
    """
    compiler = _Compiler(schema if isinstance(schema, dict) else {})

    def violations(text: Column) -> Column:
        none = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule"))).cast(_NONE)
        return _let(F.try_parse_json(text), lambda v: F.when(v.isNull(), none).otherwise(compiler.compile(schema, v, F.lit("$"), 0)))

    violations(F.lit("{}"))  # unknown keywords are told now
    return violations
