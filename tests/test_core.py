"""JSON operators: golden cases, an invalid corpus, properties against CPython's json, and the registered queries."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import sparkjson.functions as J
from sparkjson.functions import repair_escapes
from sparkjson.functions.rewrite import filter_fields, map_lexemes, pretty, sort_keys, split_array
from sparkjson.functions.schema import conforms, conforms_each, is_property_required, number_schema, object_schema, optimization_hints, property_schema, required_properties, schema_errors, string_schema
from sparkjson.operators.diagnostics import container_root, duplicate_keys, findings, lenient_valid
from sparkjson.operators.metrics import observed, prometheus_text
from sparkjson.operators.policy import apply_policy, error_report, quarantine
from sparkjson.operators.tokens import array_chunks, framed, token_rows
from sparkjson.plans import Engine, Transform, convert, custom, filtered, formatted, minified, plugin, plugins, validated
from sparkjson.sources import minified_files, minify_files, read_documents, read_lines, validated_files

VALID = [
    "0", '""', "{}", "[]", "true", "false", "null", "-0", "9223372036854775807", "-9223372036854775808", "1.7976931348623157e+308", "1e+100", "0.000000000000001",
    '{"a":1,"a":2}', '"\\u0000"', '"\\uD800"', '"\\/"', '"😀漢字"', "[[[[1]]]]", ' { "a" : [ 1 , 2.50 , "x  y" ] } ', "[1,\n\t2]\r\n", '{"k":{"n":null}}',
]
INVALID = {
    "{": "UnterminatedObject", "[": "UnterminatedArray", "}": "UnexpectedClosing", "]": "UnexpectedClosing", '{"a" 1}': "ExpectedColon", '{"a":}': "MismatchedBrackets", '{"a":1,}': "TrailingComma",
    "{,}": "ExpectedString", "{1:2}": "ExpectedString", "[1,]": "TrailingComma", "[1 2]": "ExpectedCommaOrCloseBracket", '{"a":1 "b":2}': "ExpectedCommaOrCloseBrace", "[,1]": "InvalidCharacter",
    "[1}": "MismatchedBrackets", "tru": "InvalidLiteral", "True": "InvalidLiteral", "nulll": "InvalidLiteral", "NaN": "InvalidLiteral", "-": "InvalidNumber", "01": "InvalidNumber", "1.": "InvalidNumber",
    "1e": "InvalidNumber", "1e+": "InvalidNumber", "1.2.3": "InvalidNumber", "+1": "InvalidNumber", ".5": "InvalidNumber", '"\\x"': "InvalidEscapeSequence", '"\\u12"': "InvalidUnicodeEscape",
    '"abc': "UnterminatedString", '"a\nb"': "UnescapedControlCharacter", "@": "InvalidCharacter", "": "UnexpectedEndOfInput", " \n": "UnexpectedEndOfInput", "1 2": "TrailingData", "{} {}": "TrailingData",
}


def values(spark, texts, *columns):
    """Rows of ``columns`` for each text, in order."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, j string")
    return [r[1:] if len(columns) > 1 else r[1] for r in df.select("k", *columns).orderBy("k").collect()]


def test_minify_keeps_every_byte_outside_blanks(spark):
    texts = [*VALID, '{"a\\"b" : "x \\\\" }', '[ "  " ]', "", None, '{ "long" : "' + "y " * 200_000 + '" }']
    blank = lambda t: None if t is None else re.sub(r'("[^"\\]*(?:\\.[^"\\]*)*")|[ \t\n\r]+', lambda m: m[1] or "", t)
    want = [blank(t) for t in texts]
    for mode in ("eco", "sport", "turbo"):
        assert values(spark, texts, J.minify(F.col("j"), mode)) == want


def test_modes_differ_on_invalid_texts(spark):
    deep = "[" * 40 + "]" * 40
    texts = ["[1, 2,]", '{"a": 1,}', deep]
    assert values(spark, texts, J.minify(F.col("j"), "eco")) == [None] * 3
    assert values(spark, texts, J.minify(F.col("j"), "turbo")) == ["[1,2,]", '{"a":1,}', deep]
    assert values(spark, texts, J.minify(F.col("j"), "sport", strict=True)) == [None, None, deep]
    with pytest.raises(ValueError):
        J.minify(F.col("j"), "fast")


def test_validity_and_error_names(spark):
    assert values(spark, VALID, J.is_valid(F.col("j"))) == [True] * len(VALID)
    got = dict(zip(INVALID, values(spark, list(INVALID), J.validate(F.col("j"))["error"]), strict=True))
    assert got == INVALID
    assert values(spark, [None], J.is_valid(F.col("j"))) == [None]
    assert values(spark, ["[" * 5 + "]" * 5], J.validate(F.col("j"), 4)["error"]) == ["DepthLimitExceeded"]


def test_error_places(spark):
    got = values(spark, ['{"a": 1,\n "b": tru}', "[1\n", '{"a":1}'], J.validate(F.col("j")))
    assert [tuple(r) for r in got] == [(False, "InvalidLiteral", 15, 2, 7), (False, "UnterminatedArray", 3, 2, 1), (True, None, None, None, None)]


def generated(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 4:
        return [rng.randrange(-99, 99), rng.random() * 1e6, None, 'q"\\é\n'][kind]
    if kind < 5:
        return rng.random() < 0.5
    items = [generated(rng, depth + 1) for _ in range(rng.randrange(4))]
    return items if kind == 5 else {f"k{k} {rng.randrange(9)}": v for k, v in enumerate(items)}


def test_properties_against_cpython(spark):
    rng, texts = random.Random(5), []
    for _ in range(300):
        t = json.dumps(generated(rng), indent=rng.choice([None, 1, 3]), ensure_ascii=rng.random() < 0.5)
        texts.append(t)
        cut = list(t)
        cut[rng.randrange(len(cut))] = rng.choice('{}[],:"0x\\ ')
        texts.append("".join(cut))

    def parses(t):
        def no(_):
            raise ValueError

        try:
            json.loads(t, parse_constant=no)
        except ValueError:
            return False
        return True

    c = F.col("j")
    rows = values(spark, texts, J.is_valid(c), J.minify(c, "eco"), J.minify(J.minify(c, "eco")), pretty(c), sort_keys(c), J.is_minified(J.minify(c)))
    for t, (ok, small, again, wide, ordered, stable) in zip(texts, rows, strict=True):
        assert ok == parses(t), t
        assert stable
        if ok:
            assert small == again and len(small) <= len(t) and json.loads(small) == json.loads(t) == json.loads(wide) == json.loads(ordered)
        else:
            assert small is wide is ordered is None


def test_pretty_options(spark):
    t = '{"b":[1,{}],"a":"é😀"}'
    c = F.col("j")
    assert values(spark, [t], pretty(c)) == ['{\n  "b": [\n    1,\n    {}\n  ],\n  "a": "é😀"\n}']
    assert values(spark, [t], pretty(c, tabs=True, sort_keys=True, ascii_only=True, trailing_comma=True)) == ['{\n\t"a": "\\u00e9\\ud83d\\ude00",\n\t"b": [\n\t\t1,\n\t\t{},\n\t],\n}']


@pytest.mark.parametrize(
    ("text", "options", "want"),
    [
        ('{"name":"A","age":3,"email":"e","address":{"city":"C"}}', {"include": ["name", "email"]}, '{"name":"A","email":"e"}'),
        ('{"id":1,"password":"p","api_key":"k","email":"e"}', {"exclude": ["password", "api_key"]}, '{"id":1,"email":"e"}'),
        ('{"user":{"profile":{"name":"N","age":1,"preferences":{"theme":"d"}},"credentials":{}},"metadata":{"created":1,"updated":2}}',
         {"include": ["user.profile.name", "user.profile.preferences", "metadata.created"]}, '{"user":{"profile":{"name":"N","preferences":{"theme":"d"}}},"metadata":{"created":1}}'),
        ('{"user_id":1,"user_name":"n","admin_level":2,"app_version":"v"}', {"include": ["user_*", "app_*"]}, '{"user_id":1,"user_name":"n","app_version":"v"}'),
        ('{"users":[{"id":1,"password":"a"},{"id":2,"password":"b"}],"count":2}', {"exclude": ["users.password"]}, '{"users":[{"id":1},{"id":2}],"count":2}'),
        ('{"UserName":"a","userEmail":"b","USER_ID":3}', {"include": ["username", "useremail"], "case_sensitive": False}, '{"UserName":"a","userEmail":"b"}'),
        ('{"users":[{"email":"x","n":1}],"email":"y"}', {"include": ["users.*.email"]}, '{"users":[{"email":"x"}]}'),
        ('{"a":{"b":1},"c":2}', {"include": ["a.*"]}, '{"a":{"b":1}}'),
        ('{"a":{"b":1},"c":2}', {"include": ["a", "c"], "exclude": ["a.b"]}, '{"a":{},"c":2}'),
        ("3", {"include": ["a"]}, "3"),
        ("[1,", {}, None),
    ],
)
def test_filter_fields(spark, text, options, want):
    assert values(spark, [text], filter_fields(F.col("j"), **options)) == [want]


def test_schema_keywords(spark):
    schema = object_schema({"name": string_schema(minLength=1, maxLength=5), "age": number_schema(minimum=0, exclusiveMaximum=150)}, ["name", "age"])
    texts = ['{"name":"A","age":1}', '{"name":"","age":150}', '{"age":-1}', "[]", "{", '{"name":"ABCDEF","age":"x"}', None]
    got = values(spark, texts, schema_errors(F.col("j"), schema))
    assert [None if g is None else [(e.keyword, e.instance_path) for e in g] for g in got] == [
        [], [("minLength", "/name"), ("exclusiveMaximum", "/age")], [("required", "/name"), ("minimum", "/age")], [("type", "/")], [("parse", "/")], [("maxLength", "/name"), ("type", "/age")], None,
    ]


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"type": "integer"}, ["1", "1.0", "-3e2"], ["1.5", '"1"']),
        ({"enum": ["a", 2, None]}, ['"a"', "2", "null"], ['"b"', "3"]),
        ({"items": {"type": "string"}, "minItems": 1, "uniqueItems": True}, ['["a","b"]', "{}"], ["[]", "[1]", '["a","a"]']),
        ({"prefixItems": [{"type": "number"}], "items": {"type": "string"}}, ["[1]", '[1,"a"]', "[]"], ['["a"]', "[1,2]"]),
        ({"additionalProperties": False, "properties": {"a": {}}, "patternProperties": {"^x": {"type": "null"}}}, ['{"a":1,"x1":null}'], ['{"b":1}', '{"x":1}']),
        ({"minProperties": 1, "maxProperties": 2}, ['{"a":1}'], ["{}", '{"a":1,"b":2,"c":3}']),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ['"x"', "7"], ["3"]),
        ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, ["4", "9"], ["6", "7"]),
        ({"allOf": [{"minimum": 1}, {"maximum": 3}], "not": {"const": 2}}, ["1", "3"], ["2", "4"]),
        ({"if": {"type": "string"}, "then": {"pattern": "^a"}, "else": {"type": "number"}}, ['"ab"', "1"], ['"b"', "null"]),
        ({"$ref": "#/$defs/t", "$defs": {"t": {"type": ["null", "boolean"]}}}, ["null", "true"], ["0"]),
        ({"format": "ipv4"}, ['"192.168.1.1"', "5"], ['"999.999.999.999"']),
        ({"format": "email"}, ['"user@example.com"'], ['"invalid-email"']),
        ({"format": "uri"}, ['"https://example.com"'], ['"not-a-uri"']),
        ({"format": "uuid"}, ['"123e4567-e89b-12d3-a456-426614174000"'], ['"invalid-uuid"']),
        ({"format": "date"}, ['"2023-12-25"'], ['"invalid-date"']),
        ({"format": "hostname"}, ['"anything"'], []),
    ],
)
def test_schema_cases(spark, schema, good, bad):
    assert values(spark, good + bad, conforms(F.col("j"), schema)) == [True] * len(good) + [False] * len(bad)


def test_schema_options_and_hints(spark):
    c = F.col("j")
    two = {"minimum": 5, "multipleOf": 2}
    assert values(spark, ["3"], F.size(schema_errors(c, two)), F.size(schema_errors(c, two, fail_fast=True)), F.size(schema_errors(c, two, max_errors=1))) == [(2, 1, 1)]
    assert values(spark, ['"é"'], conforms(c, {"maxLength": 1}), conforms(c, {"maxLength": 1}, length_unit="bytes")) == [(True, False)]
    assert values(spark, ['"x"'], conforms(c, {"format": "uri"}, validate_formats=False)) == [True]
    hints = optimization_hints(object_schema({"id": {"type": "integer"}, "s": string_schema(maxLength=9, pattern="a"), "e": {"enum": [1]}}))
    assert ("/s", "UsePatternMatch", 0.8) in hints and ("/e", "UseEnumLookup", 0.9) in hints and ("/", "UseFastPath", 0.6) in hints


def test_scalars(spark):
    c = F.col("j")
    text = '{"a":[1,{"b":"}}]"}]}'
    assert values(spark, [text, ""], J.json_depth(c)) == [3, 0]
    assert tuple(values(spark, [text], J.structure_counts(c))[0]) == (2, 1, 3, 1, 0, 0, 21)
    assert values(spark, ['"a\\u0041\\n"'], J.json_string_value(c)) == ["aA\n"]
    assert values(spark, ['a"b\n'], J.quote_json(c)) == ['"a\\"b\\n"']
    assert values(spark, ["null", "1", "1.5", "true", '"x"', "[]", "{}"], J.type_name(F.parse_json(c))) == ["null", "number", "number", "boolean", "string", "array", "object"]
    assert values(spark, ["ab\ncd"], J.line_column(c, F.lit(4))) == [(2, 2)]
    assert values(spark, ["x"], J.format_bytes(F.lit(1536)), J.format_duration(F.lit(2500.0)), J.error_message(F.lit(-3)), J.severity_label(F.lit(3))) == [("1.5 KB", "2.50 s", "Invalid mode", "fatal")]
    assert values(spark, [" \t x"], J.skip_whitespace(c)) == ["x"]
    assert re.match(J.glob_to_regex("a*b?").replace(r"\Q", "").replace(r"\E", ""), "aXXbc")
    assert values(spark, ["abcdefghij"], J.context_snippet(c, F.lit(5), 2)) == ["defg"]
    assert values(spark, ['{"a":1,"a":2}', '{"a":1}', "[]"], J.has_duplicate_keys(c)) == [True, False, False]
    assert values(spark, ['{"a":[1]}', "[}", '"', "]["], J.balanced(c)) == [True, False, False, True]
    assert values(spark, ["x"], J.memory_estimate(F.lit(10_000), "sport"), J.reduction_percent(F.lit(10), F.lit(5)), J.compression_ratio(F.lit(0), F.lit(5))) == [(100, 50.0, None)]


def test_policies(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, "[1,]"), (3, '["\\q"]'), (4, None)], "id int, j string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(apply_policy(df, "j", "drop")) == [1, 4]
    assert {r.id: r.error and r.error.error for r in apply_policy(df, "j", "repair").collect()} == {1: None, 2: "TrailingComma", 3: None, 4: None}
    with pytest.raises(Exception, match="Invalid JSON: TrailingComma|InvalidEscapeSequence"):
        apply_policy(df, "j", "fail").collect()
    good, bad = quarantine(df, "j")
    assert ids(good) == [1, 4] and ids(bad) == [2, 3]
    assert {tuple(r) for r in error_report(df, "j").collect()} == {("TrailingComma", 1, False, "keep"), ("InvalidEscapeSequence", 1, False, "repair")}


def test_token_tables(spark):
    df = spark.createDataFrame([(1, ' {"a":\n [1, "x"]} '), (2, ""), (3, None)], "id int, j string")
    got = [tuple(r)[1:] for r in token_rows(df, "id", "j").orderBy("id", "pos").collect()]
    assert got[0] == (0, "{", "{", 1, 2, 1, 2, 0) and got[3] == (3, "[", "[", 8, 9, 2, 2, 1) and got[6] == (6, "string", '"x"', 12, 15, 2, 6, 2) and len(got) == 9
    pieces = array_chunks(spark.createDataFrame([(1, "[1,[2,3],{}]"), (2, "[]"), (3, "5"), (4, "[")], "id int, j string"), "id", "j", 2)
    assert sorted(map(tuple, pieces.collect())) == [(1, 0, "[1,[2,3]]"), (1, 1, "[{}]"), (2, 0, "[]"), (3, 0, "5")]
    parts = framed(spark.createDataFrame([(1, '{"a":1}[2] 3 "x"{')], "id int, j string"), "id", "j")
    assert [r.json for r in parts.orderBy("part").collect()] == ['{"a":1}', "[2]", "3", '"x"']
    assert values(spark, ["[" + ",".join("1" * 450) + "]"], F.size(split_array(F.col("j")))) == [3]


def test_diagnostics(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":[{"a":2,"a":3},{"a":4}],"a":{"b":5}}'), (2, '["a","a"]')], "id int, j string")
    assert sorted(map(tuple, duplicate_keys(df, "id", "j").collect())) == [(1, 0, '"a"', 2, 1), (1, 8, '"a"', 2, 1)]
    c = F.col("j")
    texts = ["[1,]", '{"a":1,}', "[,]", "[1,,]", '["x,]",]', "// c\n[1]", '["' + "y" * 20 + '"]']
    assert values(spark, texts, lenient_valid(c, allow_trailing_commas=True, max_string_length=10)) == [True, True, False, False, True, False, False]
    assert values(spark, texts[5:6], lenient_valid(c, allow_comments=True)) == [True]
    got = values(spark, ["[" + "9" * 101 + "]", "[" + "{}," * 1001 + "{}]", "[1", None], findings(c))
    assert got[2][0].context == "[1" and got[0][0].context is None
    assert [None if g is None else [tuple(x)[:3] for x in g] for g in got] == [[(1, "Long number", "1")], [(1, "Many objects", "1002")], [(2, "UnterminatedArray", "2")], None]
    assert values(spark, [" [1]", "5", ""], container_root(c)) == [True, False, False]


def test_engine(spark):
    df = spark.createDataFrame([(1, '{ "important" : 1, "extra" : 2 }')], "id int, j string")
    run = lambda e: [r.j for r in e.run(df, "j").collect()]
    assert run(Engine()) == ['{"important":1,"extra":2}']
    engine = Engine().add(minified(priority=2)).add(filtered(include=["important"], priority=1))
    assert run(engine) == ['{"important":1}']
    assert run(engine.remove(1).add(custom(str.upper))) == ['{"IMPORTANT":1,"EXTRA":2}']
    assert run(engine.clear().add(formatted(indent=1, enabled=False)).add(convert())) == ['{"important":1,"extra":2}']
    assert run(Engine([validated({"required": ["x"]})])) == [None]
    assert run(Engine([validated({"required": ["x"]}, mode="lenient")])) == ['{ "important" : 1, "extra" : 2 }']
    with pytest.raises(NotImplementedError):
        convert("bson")

    @plugin("shout")
    def shout():
        return Transform("shout", lambda d, c: d.withColumn(c, F.upper(c)))

    assert run(Engine([plugins["shout"]()])) == ['{ "IMPORTANT" : 1, "EXTRA" : 2 }']
    assert values(spark, ['{"a":1}'], map_lexemes(F.col("j"), lambda x: None if x == ":" else x)) == ['{"a"']


def test_observed_counters(spark):
    df = spark.createDataFrame([('{ "a": 1 }',), ("[1,]",)], "j string").withColumn("m", J.minify(F.col("j"), "eco"))
    out, seen = observed(df, "j", "m", "t1")
    out.collect()
    assert seen.get == {"documents": 2, "input_bytes": 14, "output_bytes": 7, "errors": 1}
    assert "sparkjson_documents 2" in prometheus_text(seen.get)


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.json").write_text('{ "a" :\n 1 }')
    (tmp_path / "in" / "sub" / "b.json").write_text("[ 2 ]")
    (tmp_path / "in" / "c.txt").write_text("x")
    docs = read_documents(spark, str(tmp_path / "in"), "*.json")
    assert sorted(r.json for r in docs.collect()) == ["[ 2 ]", '{ "a" :\n 1 }']
    assert read_documents(spark, str(tmp_path / "in"), include="/sub/").count() == 1
    assert read_documents(spark, str(tmp_path / "in"), exclude="/sub/").count() == 2
    minify_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), glob="*.json")
    assert sorted(r.json for r in read_lines(spark, str(tmp_path / "out")).collect()) == ["[2]", '{"a":1}']


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_queries_against_duckdb(spark):
    import duckdb

    from sparkjson.queries import QUERIES

    con = duckdb.connect()
    for name in ("nation", "region", "customer", "part", "orders", "lineitem", "events", "documents"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, (run, sql) in QUERIES.items():
        df = run(spark, SF)
        columns = sorted(df.columns)
        got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
        picked = ", ".join(f'"{c}"' for c in columns)
        assert got == sorted(map(repr, con.sql(f"SELECT {picked} FROM ({sql})").fetchall())), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rewrites_reach_the_depth_limit(spark):
    n = 1000
    deep = '{"b": 1, "a": ' * (n - 1) + "[]" + "}" * (n - 1)
    rows = spark.createDataFrame([(deep,), ("[" * n + "]" * n,)], "j string")
    got = rows.select(sort_keys(F.col("j")).alias("s"), pretty(F.col("j"), indent=0).alias("p"), filter_fields(F.col("j"), exclude=["a." * (n - 2) + "b"]).alias("f"), filter_fields(F.col("j"), include=["b"]).alias("i")).collect()
    assert got[0].s == '{"a":' * (n - 1) + "[]" + ',"b":1}' * (n - 1) and got[0].p.replace("\n", "").replace(" ", "") == deep.replace(" ", "")
    assert got[0].f == ('{"b":1,"a":' * (n - 2)) + '{"a":[]' + "}" * (n - 1) and got[0].i == '{"b":1}'
    assert got[1].s == "[" * n + "]" * n == got[1].f == got[1].p.replace("\n", "")


def test_filter_leaves_no_empty_ancestors(spark):
    text = '{"a": {"id": 1, "x": 2}, "b": {"x": {"y": []}}, "c": [{"x": 1}], "d": [{"id": {}}, {"x": 3}, 4], "e": {}, "id": []}'
    got = spark.createDataFrame([(text,)], "j string").select(filter_fields(F.col("j"), include=["*.id"]).alias("f"), filter_fields(F.col("j"), include=["b.z", "e"]).alias("g")).first()
    assert got.f == '{"a":{"id":1},"d":[{"id":{}},{},4]}' and got.g == '{"e":{}}'


def test_schemas_refuse_trailing_data_and_compare_numbers(spark):
    docs = ["2", "2.0", "2e0", "2 x", "[2.0]", '"2"', "true", None]
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, j string").orderBy("k")
    got = [(r.a, r.b) for r in rows.select(conforms(F.col("j"), {"enum": [2.0, True]}).alias("a"), conforms(F.col("j"), {}).alias("b")).collect()]
    assert got == [(True, True), (True, True), (True, True), (False, False), (False, True), (False, True), (True, True), (None, None)]


def test_tokens_and_frames_of_rows_that_share_a_key(spark):
    rows = spark.createDataFrame([(1, "[1]{"), (1, '{"a":\n2} 7'), (None, "[3]"), (2, ""), (3, None)], "k long, j string")
    assert sorted(map(tuple, framed(rows, "k", "j").collect()), key=str) == sorted([(1, 0, "[1]"), (1, 0, '{"a":2}'), (1, 1, "7"), (None, 0, "[3]")], key=str)
    places = {(r.value, r.start, r.end, r.line, r.col, r.depth, r.type) for r in token_rows(rows, "k", "j").where("value = '2'").collect()}
    assert places == {("2", 6, 7, 2, 1, 1, "number")}
    assert "Exchange" not in framed(rows, "k", "j")._jdf.queryExecution().toString()


def test_repairs_stay_inside_strings(spark):
    cases = {r'{"a":1} \q': r'{"a":1} \q', r'["\q", "\u12", "\\q"] \u': r'["?", "\uFFFD", "\\q"] \u', "plain": "plain", None: None}
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, j string").orderBy("k")
    assert [r.x for r in rows.select(repair_escapes(F.col("j")).alias("x")).collect()] == list(cases.values())


def test_files_keep_their_paths(spark, tmp_path):
    (tmp_path / "a.json").write_text("[ 1 ]")
    (tmp_path / "b.json").write_text("[ 1 ")
    name = lambda r: r.path.rsplit("/", 1)[1]
    assert {name(r): (r.json, r.ok) for r in minified_files(spark, str(tmp_path), "eco").collect()} == {"a.json": ("[1]", True), "b.json": (None, False)}
    assert {name(r): (r.valid, r.error) for r in validated_files(spark, str(tmp_path)).collect()} == {"a.json": (True, None), "b.json": (False, "UnterminatedArray")}
    with pytest.raises(Exception, match="Invalid JSON"):
        minified_files(spark, str(tmp_path), "eco", fail_on_error=True).collect()


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a":1} "bc', '{"a":1}'), ('"a b" 1', '"a b" 1'), ('{"a":"]}"} [1', '{"a":"]}"}'), ("}{}", ""), ("{} ]{}", "{}"), (" [1]  ", " [1]"), ('["a', ""), ("", ""), (None, None)],
)
def test_complete_prefix(spark, text, want):
    assert values(spark, [text], J.complete_prefix(F.col("j"))) == [want]


def test_skip_invalid(spark):
    texts = [r'{"a": "x\qy"}', r'["\u12", "\u00e9", "\\q", "\n"]', "[01, 2]", '@{"a": tru}', '{"a": 1} ', '["a\tb"]', '"cut', "", None]
    assert values(spark, texts, J.skip_invalid(F.col("j"))) == [
        '{"a": "xy"}', r'["12", "\u00e9", "\\q", "\n"]', "[, 2]", '{"a": }', '{"a": 1}', '["ab"]', "", "", None,
    ]


def test_skip_policy(spark):
    rows = spark.createDataFrame([(1, r'["\q1"]'), (2, "[01]"), (3, "[1,]"), (4, None)], "id int, j string")
    got = {r["id"]: (r["j"], r["error"] and r["error"]["error"]) for r in apply_policy(rows, "j", "skip").collect()}
    assert got == {1: ('["1"]', None), 2: ("[]", None), 3: ("[1,]", "TrailingComma"), 4: (None, None)}


def test_length_profile(spark):
    texts = ['{"ab": "xyz", "c\\"" : ["", ": "], "": 1}', "[1]", "", None]
    got = values(spark, texts, J.length_profile(F.col("j")))
    assert [g and tuple(g) for g in got] == [(3, 5 / 3, 3, 5 / 3), (0, None, 0, None), (0, None, 0, None), None]


def test_size_limit(spark):
    assert values(spark, ["[ 1 ]", "[ 12 ]", None], J.minify(F.col("j"), max_bytes=5)) == ["[1]", None, None]


def test_escape_value(spark):
    assert values(spark, ["n", '"', "\\", "q", None], J.escape_value(F.col("j"))) == ["\n", '"', "\\", None, None]


def test_recursive_schema(spark):
    node = {"type": "object", "properties": {"next": {"anyOf": [{"type": "null"}, {"$ref": "#"}]}, "v": {"maximum": 9}}}
    chain = lambda n, v: '{"next":' * n + f'{{"v":{v}}}' + "}" * n
    texts = [chain(0, 1), chain(3, 9), chain(3, 10), chain(8, 1), chain(9, 1), '{"next":{"next":null}}', '{"next":{"next":3}}', None]
    assert values(spark, texts, conforms(F.col("j"), node)) == [True, True, False, True, False, True, False, None]
    direct = {"properties": {"next": {"$ref": "#"}, "v": {"maximum": 9}}}
    got = values(spark, [chain(1, 10), chain(3, 1)], schema_errors(F.col("j"), direct, ref_depth=2))
    assert [[(e.keyword, e.instance_path) for e in g] for g in got] == [[("maximum", "/next/v")], [("$ref", "/next/next/next")]]


def test_schema_error_details(spark):
    schema = {"required": ["a"], "properties": {"b": {"enum": ["x", 1]}, "c": {"type": "integer"}, "d": {"maxItems": 1}}}
    got = values(spark, ['{"b":"\u00fc","c":1.5,"d":[1,2]}', "{"], schema_errors(F.col("j"), schema))
    assert [[(e.schema_path, e.expected, e.actual) for e in g] for g in got] == [
        [("#/required", '"a"', "object"), ("#/properties/b/enum", '["x",1]', '"\u00fc"'), ("#/properties/c/type", '"integer"', "1.5"), ("#/properties/d/maxItems", "1", "array")],
        [("#", "null", None)],
    ]
    assert (property_schema(schema, "b"), required_properties(schema), is_property_required(schema, "b")) == ({"enum": ["x", 1]}, ["a"], False)


def test_validity_agrees_with_the_fold(spark):
    deep = ["[" * n + "]" * m for n in (2, 31, 32, 33, 34) for m in (n - 1, n, n + 1)]
    texts = [*deep, '["a""b"]', '["a\\t,\\n"]', '["\\\\q"]', '[",1]', "[1{}]", '[{}"a"]', "{{}:1}", "[1 2]", "[-{}]", '{"a":"}', "[1\u2028]", ' {"a\\\\"" : [ ] , "b":-1.5e+3}\n', "t", "", " "]
    for depth in (2, 32, 33, 1000):
        got = values(spark, texts, J.is_valid(F.col("j"), depth), J.validate(F.col("j"), depth)["valid"])
        assert [t for t, (a, b) in zip(texts, got, strict=True) if a != b] == [] and sum(a for a, _ in got) == {2: 3, 32: 5, 33: 6, 1000: 7}[depth]
    assert values(spark, ["[1\u2028]"], J.is_valid(F.col("j"))) == [False]


def test_filters_deal_their_rows(spark):
    from sparkjson.queries import filter_exclude, filter_include

    for query in (filter_include, filter_exclude):  # the file has one row group
        assert "hashpartitioning(c_custkey" in query(spark, SF)._jdf.queryExecution().toString()


def test_schemas_share_one_parse(spark):
    node = {"properties": {"a": {"$ref": "#"}, "b'": {"type": "integer"}}}
    rows = spark.createDataFrame([('{"a": {"a": {}}}',), ('{"b\'": 1.5}',), ("[1",), (None,)], "j string")
    got = rows.select(conforms_each(F.col("j"), {"one": node, "two": node, "any": {}}, ref_depth={"one": 1}).alias("r")).collect()
    assert [r.r and tuple(r.r) for r in got] == [(False, True, True), (False, False, True), (False, False, False), None]


def test_nested_lambdas_under_python_functions(spark):
    schema = {"properties": {"a": {"anyOf": [{"minimum": 1}, {"not": {"type": "integer"}}]}}}
    rows = spark.createDataFrame([('{"a": 1, "b": [ ]}',), ('{"a": 0}',)], "j string")
    got = Engine([validated(schema), filtered(exclude=["a"])]).run(rows, "j").collect()
    assert [r.j for r in got] == ['{"b":[]}', None]
