"""JSON Schema compiled to Spark expressions over VARIANT.

``schema_errors(c, schema)`` gives the errors of each text as an array of ERROR structs; the schema is a Python dict that is
read once, on the driver.  Checks inside array items are reported once, at the array.  ``expected`` is the keyword's
value as JSON, ``actual`` a scalar's JSON or a container's kind.

A schema that refers to itself is unrolled ``ref_depth`` times, since an expression has no recursion; a value nested deeper has the error
``$ref`` (inside ``anyOf``, ``not`` and the like it counts as one that does not match).  The expression grows with that depth as a power of the
number of places that refer back.
What a part of the schema needs of a value (``_FACTS``) is worked out once for each value and bound, and so is each member that has a schema;
``conforms_each`` parses once for any number of schemas.
Parsing needs unique keys unless ``spark.sql.variant.allowDuplicateKeys`` is set; a text that cannot be parsed has
the one error "Invalid JSON".
"""

from __future__ import annotations

import json
from collections.abc import Callable
from collections import Counter
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexical import let
from .scalars import quote_json, type_name
from .validity import is_valid

ERROR = "array<struct<message:string,instance_path:string,keyword:string,schema_path:string,expected:string,actual:string>>"
REF_DEPTH = 8
#: What each failing keyword says.
MESSAGES = {
    "type": "Expected type does not match",
    "minLength": "String too short",
    "maxLength": "String too long",
    "format": "String format validation failed",
    "minimum": "Number below minimum",
    "maximum": "Number above maximum",
    "exclusiveMinimum": "Number not above exclusive minimum",
    "exclusiveMaximum": "Number not below exclusive maximum",
    "multipleOf": "Number is not a multiple of constraint",
    "integer": "Expected integer, got decimal",
    "$ref": "Nested deeper than references are followed",
}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
FORMATS: dict[str, Callable[[Column], Column]] = {
    "email": lambda s: F.contains(s, F.lit("@")) & (F.octet_length(s) > 3),
    "uri": lambda s: s.rlike("^https?://"),
    "uuid": lambda s: (F.octet_length(s) == 36) & (F.substring(s, 9, 1) == "-") & (F.substring(s, 14, 1) == "-"),
    "date": lambda s: (F.octet_length(s) == 10) & (F.substring(s, 5, 1) == "-") & (F.substring(s, 8, 1) == "-"),
    "date-time": lambda s: (F.octet_length(s) >= 19) & F.contains(s, F.lit("T")),
    "ipv4": lambda s: s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "ipv6": lambda s: F.contains(s, F.lit(":")) & (F.octet_length(s) >= 2),
}


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


#: What is known of a value: the type by name, and null for other types the text, number, items and members.
_FACTS: dict[str, Callable[[Column], Column]] = {
    "kind": F.schema_of_variant,
    "text": lambda v: F.try_variant_get(v, "$", "string"),
    "number": lambda v: F.try_variant_get(v, "$", "double"),
    "items": lambda v: F.try_variant_get(v, "$", "array<variant>"),
    "members": lambda v: F.try_variant_get(v, "$", "map<string,variant>"),
}
_TEXT, _NUMBER, _ITEMS, _MEMBERS = ("kind", "text"), ("kind", "number"), ("items",), ("members",)
#: The facts that types and keywords need; all other types need the kind.
_TYPE_NEEDS = {"any": (), "integer": _NUMBER, "array": _ITEMS, "object": _MEMBERS}
_NEEDS = (
    dict.fromkeys(("minLength", "maxLength", "pattern", "format"), _TEXT)
    | dict.fromkeys(("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "enum", "const"), _NUMBER)
    | dict.fromkeys(("minItems", "maxItems", "uniqueItems", "prefixItems", "items"), _ITEMS)
    | dict.fromkeys(("minProperties", "maxProperties", "propertyNames", "required", "properties", "patternProperties", "additionalProperties"), _MEMBERS)
)


def _type_names(schema: dict) -> list[str]:
    names = schema.get("type", [])
    return names if isinstance(names, list) else [names]


class _Check(NamedTuple):
    """One test of a value that is there: whether it passes, and what is said if not."""

    ok: Column
    message: str
    instance_path: str
    keyword: str
    schema_path: str
    expected: Any
    value: Column

    def error(self) -> Column:
        actual = F.when(F.schema_of_variant(self.value).rlike("^(?:ARRAY|OBJECT)"), type_name(self.value)).otherwise(F.to_json(self.value))
        texts = {
            "message": self.message, "instance_path": self.instance_path, "keyword": self.keyword, "schema_path": self.schema_path,
            "expected": json.dumps(self.expected, separators=(",", ":"), ensure_ascii=False),
        }
        return F.struct(*(F.lit(text).alias(name) for name, text in texts.items()), actual.alias("actual"))


class _Compiler:
    def __init__(self, root: dict, length_unit: str, validate_formats: bool, ref_depth: int):
        self.root, self.formats, self.ref_depth = root, validate_formats, ref_depth
        self.length = F.length if length_unit == "chars" else F.octet_length
        self.open: Counter[int] = Counter()

    def resolve(self, ref: str) -> dict:
        node = self.root
        if not ref.startswith("#"):
            raise ValueError(f"only local references are supported: {ref}")
        for part in ref[1:].split("/")[1:]:
            node = node[part.replace("~1", "/").replace("~0", "~")]
        return node

    def type_is(self, f: Column, name: str) -> Column:
        if name in ("array", "object"):
            return f["items" if name == "array" else "members"].isNotNull()
        if name == "any":
            return F.lit(True)
        s = f["kind"]
        number = ~s.isin("VOID", "BOOLEAN", "STRING") & ~F.startswith(s, F.lit("ARRAY")) & ~F.startswith(s, F.lit("OBJECT"))
        if name == "integer":
            return number & (F.floor(f["number"]) == f["number"])
        return number if name == "number" else s == {"null": "VOID", "boolean": "BOOLEAN", "string": "STRING"}[name]

    def with_facts(self, v: Column, schemas: list[dict | bool], body: Callable[[Column, Column | None], Column]) -> Column:
        """``body`` of ``v`` and a struct of what ``schemas`` need of it.

        The struct holds ``v`` too: Spark does not find a Python function whose argument has a lambda that uses another lambda's variable.
        """
        plain = [s for s in schemas if isinstance(s, dict)]
        needs = {n for s in plain for t in _type_names(s) for n in _TYPE_NEEDS.get(t, ("kind",))} | {n for s in plain for k in s for n in _NEEDS.get(k, ())}
        known = F.struct(v.alias("value"), *(of(v).alias(name) for name, of in _FACTS.items() if name in needs))
        return let(known, lambda f: body(f["value"], f)) if needs else body(v, None)

    def walk(self, v: Column, schema: dict | bool, path: str = "", where: str = "#", report: bool = False, facts: Column | None = None) -> Column:
        """Whether ``v``, which is there, passes; or, to ``report``, an array with an error or null for each check.  ``where`` leads to ``schema``."""
        if schema is True or schema == {}:
            return self.all_of([], report)
        if schema is False:
            return self.all_of([_Check(F.lit(False), "No value is allowed", path or "/", "false", where, False, v)], report)
        if "$ref" in schema:
            target = self.resolve(schema["$ref"])
            if self.open[id(target)] >= self.ref_depth:
                return self.all_of([_Check(F.lit(False), MESSAGES["$ref"], path or "/", "$ref", f"{where}/$ref", schema["$ref"], v)], report)
            self.open[id(target)] += 1
            try:
                return self.walk(v, target, path, schema["$ref"], report)
            finally:
                self.open[id(target)] -= 1
        of = lambda value, f: self.all_of(self.checks(value, f, schema, path, where, report), report)
        return self.with_facts(v, [schema], of) if facts is None else of(v, facts)

    def all_of(self, parts: list[_Check | Column], report: bool) -> Column:
        """Checks, and what ``walk`` gave for the parts of a value, as one."""
        if not report:
            return _all([F.coalesce(x.ok, F.lit(False)) if isinstance(x, _Check) else x for x in parts])
        failed = [F.array(F.when(~F.coalesce(x.ok, F.lit(False)), x.error())) if isinstance(x, _Check) else x for x in parts]
        return F.concat(*failed) if failed else F.array().cast(ERROR)

    def checks(self, v: Column, f: Column | None, schema: dict, path: str, where: str, report: bool) -> list[_Check | Column]:
        """The checks of ``v``, of which the facts ``f`` are known, and the outcomes of its members."""
        out: list[_Check | Column] = []

        def add(keyword: str, ok: Column, message: str | None = None) -> None:
            named = "type" if keyword == "integer" else keyword
            out.append(_Check(ok, message or MESSAGES.get(keyword, f"{keyword} failed"), path or "/", keyword, f"{where}/{named}", schema.get(named), v))

        def by_keyword(kind: str, tests: dict[str, Callable]) -> None:
            for keyword, ok in tests.items():
                if keyword in schema:
                    add(keyword, ~self.type_is(f, kind) | ok(schema[keyword]))

        if "type" in schema:
            names = _type_names(schema)
            if names == ["integer"]:
                add("type", self.type_is(f, "number"))
                add("integer", ~self.type_is(f, "number") | self.type_is(f, "integer"))
            else:
                add("type", _any([self.type_is(f, n) for n in names]))
        by_keyword("string", {
            "minLength": lambda x: self.length(f["text"]) >= x,
            "maxLength": lambda x: self.length(f["text"]) <= x,
            "pattern": lambda x: f["text"].rlike(x),
        })
        if self.formats and schema.get("format") in FORMATS:
            add("format", ~self.type_is(f, "string") | FORMATS[schema["format"]](f["text"]))
        by_keyword("number", {
            "minimum": lambda x: f["number"] >= x,
            "maximum": lambda x: f["number"] <= x,
            "exclusiveMinimum": lambda x: f["number"] > x,
            "exclusiveMaximum": lambda x: f["number"] < x,
            "multipleOf": lambda x: F.pmod(f["number"], F.lit(float(x))) == 0,
        })
        for keyword, values in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
            if values is not None:
                plain = [x for x in values if isinstance(x, bool) or not isinstance(x, (int, float))]
                numbers = [float(x) for x in values if not isinstance(x, bool) and isinstance(x, (int, float))]
                tests = [self.type_is(f, "number") & f["number"].isin(*numbers)] if numbers else []
                if plain:
                    tests.append(F.to_json(v).isin(*[json.dumps(x, separators=(",", ":"), ensure_ascii=False, sort_keys=True) for x in plain]))
                add(keyword, _any(tests))
        by_keyword("array", {"minItems": lambda x: F.size(f["items"]) >= x, "maxItems": lambda x: F.size(f["items"]) <= x})
        if schema.get("uniqueItems"):
            texts = F.transform(f["items"], lambda x: F.to_json(x))
            add("uniqueItems", ~self.type_is(f, "array") | (F.size(F.array_distinct(texts)) == F.size(f["items"])))
        fixed = schema.get("prefixItems", [])
        for k, sub in enumerate(fixed):
            add("prefixItems", ~self.type_is(f, "array") | (F.size(f["items"]) <= k) | let(F.get(f["items"], F.lit(k)), lambda x: self.walk(x, sub)))  # noqa: B023
        if "items" in schema:
            rest = F.slice(f["items"], F.lit(len(fixed) + 1), F.greatest(F.size(f["items"]), F.lit(0))) if fixed else f["items"]
            add("items", ~self.type_is(f, "array") | F.forall(rest, lambda x: self.walk(x, schema["items"])))
        by_keyword("object", {
            "minProperties": lambda x: F.size(f["members"]) >= x,
            "maxProperties": lambda x: F.size(f["members"]) <= x,
            "propertyNames": lambda x: F.forall(F.map_keys(f["members"]), lambda k: let(F.try_parse_json(quote_json(k)), lambda name: self.walk(name, x))),
        })
        for name in schema.get("required", []):
            ok = ~self.type_is(f, "object") | f["members"][name].isNotNull()
            out.append(_Check(ok, f"Missing required property {name}", f"{path}/{name}", "required", f"{where}/required", name, v))
        properties = schema.get("properties", {})
        for name, sub in properties.items():
            if sub is not True and sub != {}:
                own = lambda x: F.when(x.isNull(), self.all_of([], report)).otherwise(self.walk(x, sub, f"{path}/{name}", f"{where}/properties/{name}", report))  # noqa: B023, E731
                out.append(let(f["members"][name], own))
        patterns = list(schema.get("patternProperties", {}).items())
        for pattern, sub in patterns:
            add("patternProperties", ~self.type_is(f, "object") | self.members_match(f["members"], pattern, sub))
        if "additionalProperties" in schema and schema["additionalProperties"] is not True:
            known = lambda k: _any([k.isin(*properties)] * bool(properties) + [k.rlike(p) for p, _ in patterns])
            sub = schema["additionalProperties"]
            ok = F.forall(F.map_keys(f["members"]), known) if sub is False else F.forall(F.map_entries(f["members"]), lambda e: known(e["key"]) | self.walk(e["value"], sub))
            add("additionalProperties", ~self.type_is(f, "object") | ok)
        if "allOf" in schema:
            add("allOf", _all([self.walk(v, s) for s in schema["allOf"]]))
        if "anyOf" in schema:
            add("anyOf", _any([self.walk(v, s) for s in schema["anyOf"]]))
        if "oneOf" in schema:
            add("oneOf", reduce(lambda a, b: a + b, [self.walk(v, s).cast("int") for s in schema["oneOf"]]) == 1)
        if "not" in schema:
            add("not", ~self.walk(v, schema["not"]))
        if "if" in schema:
            test = self.walk(v, schema["if"])
            add("if", F.when(test, self.walk(v, schema.get("then", True))).otherwise(self.walk(v, schema.get("else", True))))
        return out

    def members_match(self, members: Column, pattern: str, schema: dict | bool) -> Column:
        return F.forall(F.map_entries(members), lambda e: ~e["key"].rlike(pattern) | self.walk(e["value"], schema))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _parsed(c: Column) -> Column:
    return F.try_parse_json(F.when(is_valid(c), c))  # the parser alone would pass over data behind the value


def schema_errors(
    c: Column, schema: dict, *, max_errors: int = 100, fail_fast: bool = False, length_unit: str = "chars", validate_formats: bool = True, ref_depth: int = REF_DEPTH
) -> Column:
    """Errors of each text, in the schema's order, ``max_errors`` (or, with ``fail_fast``, one) at most; null for null."""

    def of(v: Column) -> Column:
        found = F.filter(_Compiler(schema, length_unit, validate_formats, ref_depth).walk(v, schema, report=True), lambda e: e.isNotNull())
        kept = F.slice(found, F.lit(1), F.lit(1 if fail_fast else max_errors))
        return F.when(v.isNull(), F.array(_Check(F.lit(False), "Invalid JSON", "/", "parse", "#", None, v).error())).otherwise(kept)

    return F.when(c.isNotNull(), let(_parsed(c), of))


def conforms(c: Column, schema: dict, *, length_unit: str = "chars", validate_formats: bool = True, ref_depth: int = REF_DEPTH) -> Column:
    """Whether a text has no ``schema_errors``; checks stop at the first that fails, and no error is built.  Null for null."""
    return conforms_each(c, {"ok": schema}, length_unit=length_unit, validate_formats=validate_formats, ref_depth=ref_depth)["ok"]


def conforms_each(c: Column, schemas: dict[str, dict], *, length_unit: str = "chars", validate_formats: bool = True, ref_depth: int | dict[str, int] = REF_DEPTH) -> Column:
    """struct: ``conforms`` by each named schema, from one parse; ``ref_depth`` may differ by name.  Null for null."""
    depths = ref_depth if isinstance(ref_depth, dict) else dict.fromkeys(schemas, ref_depth)
    each = {name: _Compiler(schema, length_unit, validate_formats, depths.get(name, REF_DEPTH)) for name, schema in schemas.items()}

    def of(v: Column, f: Column | None) -> Column:
        return F.struct(*((v.isNotNull() & one.walk(v, schemas[name], facts=f)).alias(name) for name, one in each.items()))

    return F.when(c.isNotNull(), let(_parsed(c), lambda v: next(iter(each.values())).with_facts(v, [*schemas.values()], of)))


# Lookups.


def property_schema(schema: dict, name: str) -> dict | bool | None:
    return schema.get("properties", {}).get(name)


def required_properties(schema: dict) -> list[str]:
    return list(schema.get("required", []))


def is_property_required(schema: dict, name: str) -> bool:
    return name in schema.get("required", [])


# Builders.


def string_schema(**keywords) -> dict:
    return {"type": "string", **keywords}


def number_schema(**keywords) -> dict:
    return {"type": "number", **keywords}


def object_schema(properties: dict | None = None, required: list[str] | None = None, **keywords) -> dict:
    return {"type": "object", "properties": dict(properties or {}), "required": list(required or []), **keywords}


def optimization_hints(schema: dict, path: str = "") -> list[tuple[str, str, float]]:
    """(path, hint, confidence) for a schema's parts; fixed confidences."""
    kind, out = schema.get("type"), []
    if 1 <= len(schema.get("enum", ())) <= 10:
        out.append((path or "/", "UseEnumLookup", 0.9))
    if kind == "string" and schema.get("maxLength", 100) < 100:
        out.append((path or "/", "PreallocateBuffer", 0.9))
    if kind == "string" and "pattern" in schema:
        out.append((path or "/", "UsePatternMatch", 0.8))
    fixed = {"array": ("PreallocateBuffer", 0.7), "number": ("UseFastPath", 0.8), "integer": ("UseFastPath", 0.8), "object": ("UseFastPath", 0.6), "boolean": ("SkipValidation", 0.95)}
    if kind in fixed:
        out.append((path or "/", *fixed[kind]))
    for name, sub in schema.get("properties", {}).items():
        out += optimization_hints(sub, f"{path}/{name}")
    return out + (optimization_hints(schema["items"], f"{path}/items") if isinstance(schema.get("items"), dict) else [])
