"""Registered queries of the JSON operators over the synthetic tables, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as J
from .functions.rewrite import filter_fields, map_lexemes, pretty, sort_keys
from .functions.schema import conforms_each, object_schema, schema_errors
from .operators.diagnostics import container_root, duplicate_keys, findings, lenient_valid
from .operators.metrics import run_summary, structure_totals
from .operators.policy import apply_policy, error_report, resilient_minify
from .operators.tokens import array_chunks, array_rows, framed, token_rows
from .plans import Engine, custom, filtered, minified, validated
from .scratch import scratch_path
from .streaming import document_stream, run_available


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _dealt(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """A table dealt over all cores by its key: a file of few row groups would leave the work on its rows to few tasks."""
    return _table(spark, sf_dir, name, key, *columns).repartition(2 * spark.sparkContext.defaultParallelism, key)


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number and a name for each customer."""
    return _table(spark, sf_dir, "customer", "c_custkey", "c_name").toDF("n_nationkey", "n_name")


#: By o_orderkey % 6: two valid documents, then four broken ones.
_MIXED = """CASE pmod(o_orderkey, 6)
 WHEN 0 THEN concat('{ "id" : ', o_orderkey, ' , "p" : "', o_orderpriority, '" }')
 WHEN 1 THEN concat('[ 1 , { "k" : [ ] } , -0.50e+1 , "a  b" , ', o_orderkey, ' ] ')
 WHEN 2 THEN concat('{"id": ', o_orderkey, ',}')
 WHEN 3 THEN concat('{"id" ', o_orderkey, '}')
 WHEN 4 THEN concat('[', o_orderkey, ', 01]')
 ELSE concat('{"id": [', o_orderkey, ']') END"""
_MIXED_SQL = _MIXED.replace("pmod(o_orderkey, 6)", "o_orderkey % 6")
_WS_SQL = r"""regexp_replace({}, '("(?:[^"\\]|\\.)*")|[ \t\n\r]+', '\1', 'g')"""


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", F.expr(_MIXED).alias("j"))


_NESTED = """concat('{{"user": {{"name": "', c_name, '", "seg": "', c_mktsegment, '", "profile": {{"theme": "dark", "n": ', c_custkey, '}}}}, "meta": {{"created": 1, "updated": 2}}, "list": [{{"id": ', c_custkey, ', "secret": "s"}}, {{"id": 2, "secret": "t"}}], "user_id": ', c_custkey, ', "App_V": 1.50}}')""".format()


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").select("c_custkey", F.expr(_NESTED).alias("j"))


def minify_events(spark, sf_dir):
    out = _table(spark, sf_dir, "events", "event_id", "props").withColumn("minified", J.minify(F.col("props"), "sport"))
    n_in, n_out = F.octet_length("props"), F.octet_length("minified")
    return out.select("event_id", "minified", n_in.alias("in_bytes"), n_out.alias("out_bytes"), J.compression_ratio(n_in, n_out).alias("ratio"))


def minify_modes(spark, sf_dir):
    c = F.col("j")
    return mixed(spark, sf_dir).select("o_orderkey", J.minify(c, "eco").alias("eco"), J.minify(c, "sport").alias("sport"), J.minify(c, "turbo").alias("turbo"), resilient_minify(c).alias("resilient"))


def validate_flags(spark, sf_dir):
    v = J.validate(F.col("j"))
    out = mixed(spark, sf_dir).select("o_orderkey", v.alias("v"), J.is_minified(F.col("j")).alias("is_minified"))
    return out.select("o_orderkey", "v.valid", "v.error", "v.offset", "v.line", "v.column", "is_minified")


def structure(spark, sf_dir):
    return nested(spark, sf_dir).select("c_custkey", J.structure_counts(F.col("j")).alias("s"), J.json_depth(F.col("j")).alias("depth")).select("c_custkey", "s.*", "depth")


def structure_sum(spark, sf_dir):
    return structure_totals(mixed(spark, sf_dir), "j")


def characteristics(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    out = docs.select("doc_id", J.characteristics(F.col("text")).alias("c"), J.estimate_size(F.col("text")).alias("estimate"), J.estimate_size(F.col("text"), "buffer").alias("buffer"))
    return out.select("doc_id", "c.size", "c.whitespace_ratio", "c.structural_density", "estimate", "buffer", J.memory_estimate(F.col("c.size"), "sport").alias("sport_memory"))


def filter_include(spark, sf_dir):
    return nested(spark, sf_dir).select("c_custkey", filter_fields(F.col("j"), include=["user.name", "user.profile", "meta.created"]).alias("out"))


def filter_exclude(spark, sf_dir):
    return nested(spark, sf_dir).select("c_custkey", filter_fields(F.col("j"), exclude=["list.secret", "user.profile", "meta.*"]).alias("out"))


def filter_glob(spark, sf_dir):
    return nested(spark, sf_dir).select("c_custkey", filter_fields(F.col("j"), include=["user_*", "app_?", "list.*.id"], case_sensitive=False).alias("out"))


def pretty_print(spark, sf_dir):
    rows = _named(spark, sf_dir).select("n_nationkey", F.expr("""concat('{"k":', n_nationkey, ',"n":["', n_name, '",{}]}')""").alias("j"))
    return rows.select("n_nationkey", pretty(F.col("j")).alias("out"))


def sorted_keys(spark, sf_dir):
    rows = _named(spark, sf_dir).select("n_nationkey", F.expr("""concat('{"z":1.0, "b": {"y": 2, "x": "', n_name, '"}, "a": -0}')""").alias("j"))
    return rows.select("n_nationkey", sort_keys(F.col("j")).alias("out"))


def split_arrays(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    item = F.struct("l_linenumber", F.expr("""concat('{"n": ', l_linenumber, ', "p": ', l_partkey, '}')""").alias("s"))
    arrays = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    docs = arrays.select("l_orderkey", F.concat(F.lit("[ "), F.array_join(F.transform("xs", lambda x: x["s"]), " , "), F.lit(" ]")).alias("j"))
    return array_chunks(docs, "l_orderkey", "j", 3)


def tokens(spark, sf_dir):
    rows = _named(spark, sf_dir).select("n_nationkey", F.expr("""concat('{ "k": ', n_nationkey, ',\n  "n": ["', n_name, '"] }')""").alias("j"))
    return token_rows(rows, "n_nationkey", "j")


def frames(spark, sf_dir):
    rows = _named(spark, sf_dir).select("n_nationkey", F.expr("""concat('{"k": ', n_nationkey, '} ["', n_name, '"]\n3 {"cut": ')""").alias("j"))
    return framed(rows, "n_nationkey", "j")


def errors(spark, sf_dir):
    return error_report(mixed(spark, sf_dir), "j")


def policies(spark, sf_dir):
    rows = mixed(spark, sf_dir)
    dropped = apply_policy(rows, "j", "drop").select("o_orderkey", F.lit("drop").alias("policy"), F.lit(True).alias("valid"))
    kept = apply_policy(rows, "j", "keep").select("o_orderkey", F.lit("keep").alias("policy"), F.col("error").isNull().alias("valid"))
    mended = apply_policy(rows, "j", lambda c: F.regexp_replace(c, r",(?=[}\]])", "")).select("o_orderkey", F.lit("mend").alias("policy"), F.col("error").isNull().alias("valid"))
    return dropped.unionByName(kept).unionByName(mended)


def repaired(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.expr(r"""concat('{"a": "x', r'\q', '", "b": "', r'\u12', '", "c": "', r'\\n', o_orderkey, '"}')""").alias("j"))
    return rows.select("o_orderkey", J.repair_escapes(F.col("j")).alias("out"), J.is_valid(J.repair_escapes(F.col("j"))).alias("valid"))


def uppercase(spark, sf_dir):
    upper = lambda x: x.upper() if x[0] == '"' else x
    return _table(spark, sf_dir, "events", "event_id", "props").select("event_id", map_lexemes(F.col("props"), upper).alias("out"))


def composed(spark, sf_dir):
    engine = Engine([minified(priority=5), filtered(exclude=["list", "user"], priority=1), custom(lambda x: None, enabled=False)])
    return engine.run(nested(spark, sf_dir), "j").select("c_custkey", F.col("j").alias("out"))


_PART = object_schema(
    {"key": {"type": "integer", "minimum": 1}, "name": {"type": "string", "minLength": 3, "maxLength": 12}, "size": {"type": "number", "exclusiveMaximum": 40, "multipleOf": 2}, "brand": {"enum": ["Brand#11", "Brand#12", "Brand#13"]}},
    ["key", "brand"],
)
_PART_JSON = """concat('{"key": ', p_partkey, ', "name": "', p_name, '", "size": ', p_size, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE concat(', "brand": "', p_brand, '"') END, '}')"""


def schema_check(spark, sf_dir):
    rows = _dealt(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_brand").select("p_partkey", F.expr(_PART_JSON).alias("j"))
    checked = rows.select("p_partkey", schema_errors(F.col("j"), _PART).alias("e"))
    return checked.select("p_partkey", F.size("e").alias("n"), F.array_join(F.transform("e", lambda e: F.concat(e["keyword"], F.lit("@"), e["instance_path"])), " ").alias("errors"))


def schema_pipeline(spark, sf_dir):
    rows = _dealt(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_brand").select("p_partkey", F.expr(_PART_JSON).alias("j"))
    return Engine([validated(_PART), minified(priority=1)]).run(rows, "j").select("p_partkey", F.col("j").alias("out"))


#: Schemas for documents {"k", "xs", "t"} with a fourth member in each fourth one and data behind each eleventh.
_RULES: dict[str, tuple[dict, str]] = {
    "unique": ({"properties": {"xs": {"uniqueItems": True}}}, "p_size <> p_size % 5 AND p_size <> 3 AND p_size % 5 <> 3"),
    "min_items": ({"properties": {"xs": {"minItems": 4}}}, "false"),
    "max_items": ({"properties": {"xs": {"maxItems": 3}}}, "true"),
    "items": ({"properties": {"xs": {"type": "array", "items": {"type": "integer", "maximum": 40}}}}, "p_size <= 40"),
    "prefix": ({"properties": {"xs": {"prefixItems": [{"minimum": 10}]}}}, "p_size >= 10"),
    "any_of": ({"properties": {"k": {"anyOf": [{"maximum": 100}, {"multipleOf": 7}]}}}, "p_partkey <= 100 OR p_partkey % 7 = 0"),
    "all_of": ({"properties": {"k": {"allOf": [{"minimum": 20}, {"multipleOf": 7}]}}}, "p_partkey >= 20 AND p_partkey % 7 = 0"),
    "one_of": ({"properties": {"k": {"oneOf": [{"maximum": 100}, {"multipleOf": 7}]}}}, "(p_partkey <= 100) <> (p_partkey % 7 = 0)"),
    "negated": ({"properties": {"k": {"not": {"exclusiveMinimum": 150}}}}, "p_partkey <= 150"),
    "branch": ({"properties": {"k": {"if": {"maximum": 100}, "then": {"multipleOf": 2}, "else": {"multipleOf": 3}}}}, "CASE WHEN p_partkey <= 100 THEN p_partkey % 2 = 0 ELSE p_partkey % 3 = 0 END"),
    "pattern": ({"properties": {"t": {"pattern": "^Brand#1"}}}, "starts_with(p_brand, 'Brand#1')"),
    "constant": ({"properties": {"k": {"const": 7.0}}}, "p_partkey = 7"),
    "one_value": ({"properties": {"k": {"enum": ["7", 8.0, 9]}}}, "p_partkey IN (8, 9)"),
    "closed": ({"properties": {"k": True, "xs": True, "t": True}, "additionalProperties": False}, "p_partkey % 4 <> 0"),
    "most": ({"maxProperties": 3}, "p_partkey % 4 <> 0"),
    "least": ({"minProperties": 4}, "p_partkey % 4 = 0"),
    "names": ({"propertyNames": {"maxLength": 2}}, "p_partkey % 4 <> 0"),
    "by_name": ({"patternProperties": {"^z": {"type": "string"}, "^k$": {"maximum": 1500}}}, "p_partkey % 4 <> 0 AND p_partkey <= 1500"),
    "referred": ({"$defs": {"small": {"maximum": 100}}, "properties": {"k": {"$ref": "#/$defs/small"}}}, "p_partkey <= 100"),
    "kinds": ({"properties": {"k": {"type": ["string", "null"]}, "t": {"type": "string"}}}, "false"),
}


def schema_rules(spark, sf_dir):
    text = """concat('{"k": ', p_partkey, ', "xs": [', p_size, ', ', p_size % 5, ', 3], "t": "', p_brand, '"', CASE WHEN p_partkey % 4 = 0 THEN ', "zzz": 1}' ELSE '}' END, CASE WHEN p_partkey % 11 = 0 THEN ' x' ELSE '' END)"""
    rows = _dealt(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand").select("p_partkey", F.expr(text).alias("j"))
    return rows.select("p_partkey", conforms_each(F.col("j"), {name: rule for name, (rule, _) in _RULES.items()}).alias("r")).select("p_partkey", "r.*")


_TREE = {"$defs": {"node": {"type": "object", "properties": {"v": {"type": "integer", "maximum": 30}, "sub": {"type": "array", "items": {"$ref": "#/$defs/node"}}}, "required": ["v"]}}, "$ref": "#/$defs/node"}


def schema_recursive(spark, sf_dir):
    """Trees of three levels whose last leaf is wrong where the size is over 30, and lacks its value in each fifth one."""
    text = """concat('{"v": 1, "sub": [{"v": 2, "sub": []}, {"v": 3, "sub": [{', CASE WHEN p_partkey % 5 = 0 THEN '"w"' ELSE '"v"' END, ': ', p_size, '}]}]}')"""
    rows = _dealt(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", F.expr(text).alias("j"))
    return rows.select("p_partkey", conforms_each(F.col("j"), {"ok": _TREE, "ok_at_two": _TREE}, ref_depth={"ok_at_two": 2}).alias("r")).select("p_partkey", "r.*")


def schema_details(spark, sf_dir):
    """Each error with where it stands in text and schema, and what was wanted and found."""
    rows = _dealt(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_brand").select("p_partkey", F.expr(_PART_JSON).alias("j"))
    schema = {"properties": {"size": {"maximum": 30}, "key": {"type": "string"}}, "required": ["brand"]}
    errors = rows.select("p_partkey", F.explode(schema_errors(F.col("j"), schema)).alias("e"))
    return errors.select("p_partkey", "e.keyword", "e.schema_path", "e.expected", "e.actual")


def key_lengths(spark, sf_dir):
    return nested(spark, sf_dir).select("c_custkey", J.length_profile(F.col("j")).alias("p")).select("c_custkey", "p.keys", "p.avg_key_length", "p.strings")


def skipped(spark, sf_dir):
    text = r"""concat('{"a": "x', r'\q', 'y", @"n": ', CASE WHEN pmod(o_orderkey, 2) = 0 THEN '7' ELSE '[01, 2]' END, '}')"""
    rows = _table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.expr(text).alias("j"))
    return apply_policy(rows, "j", "skip").select("o_orderkey", F.col("j").alias("out"), F.col("error.error").alias("error"))


def prefixes(spark, sf_dir):
    """What is complete in documents that were cut, and array elements as rows."""
    rows = _named(spark, sf_dir).select("n_nationkey", F.expr("""concat('{"a": ["', n_name, '", ', n_nationkey, ']} [1, "]', n_name)""").alias("j"))
    head = rows.select("n_nationkey", J.complete_prefix(F.col("j")).alias("json"), J.is_utf8(F.col("j").cast("binary")).alias("utf8"))
    return array_rows(head, "n_nationkey", "json", "a").join(head.select("n_nationkey", "utf8"), "n_nationkey")


def schema_formats(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.expr("""CASE pmod(c_custkey, 4) WHEN 0 THEN '"192.168.1.1"' WHEN 1 THEN '"999.999.999.999"' WHEN 2 THEN '"2023-12-25"' ELSE '"user@example.com"' END""").alias("j"))
    ok = lambda f: (F.size(schema_errors(F.col("j"), {"type": "string", "format": f})) == 0).alias(f)
    return rows.select("c_custkey", ok("ipv4"), ok("date"), ok("email"), ok("uri"))


def equal_texts(spark, sf_dir):
    rows = _named(spark, sf_dir)
    pair = rows.select("n_nationkey", F.expr("""concat('{"a": ', n_nationkey, ', "b": "', n_name, '"}')""").alias("x"), F.expr("""concat('{"b":"', n_name, '","a":', n_nationkey + n_nationkey % 2, '}')""").alias("y"))
    return pair.select("n_nationkey", J.semantic_equals(F.col("x"), F.col("y")).alias("equal"))


def comments(spark, sf_dir):
    rows = _named(spark, sf_dir).select("n_nationkey", F.expr("""concat('{"a": "//', n_name, '", /* x */ "b": 1 } // end')""").alias("j"))
    return rows.select("n_nationkey", J.minify(J.comment_free(F.col("j"))).alias("out"))


def duplicates(spark, sf_dir):
    rows = _named(spark, sf_dir).select("n_nationkey", F.expr("""concat('{"a": [{"k": 1, "k": ', n_nationkey, '}], "b": {"a": 0},\n "a": "', n_name, '", "k": 2}')""").alias("j"))
    return duplicate_keys(rows, "n_nationkey", "j")


def diagnosed(spark, sf_dir):
    c = F.col("j")
    out = mixed(spark, sf_dir).select("o_orderkey", findings(c).alias("f"), lenient_valid(c, allow_trailing_commas=True).alias("lenient"), container_root(c).alias("container"))
    return out.select("o_orderkey", F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["severity"].cast("string"), x["code"], x["detail"])), " ").alias("findings"), "lenient", "container")


def summary(spark, sf_dir):
    rows = mixed(spark, sf_dir).withColumn("out", J.minify(F.col("j"), "eco"))
    return run_summary(rows, "j", "out").select("documents", "input_bytes", "output_bytes", "errors", "ratio_min", "ratio_max")


def streamed(spark, sf_dir):
    """Lines staged as files, minified by a stream, read back."""
    folder = scratch_path(spark, "stream")
    _table(spark, sf_dir, "events", "props").select(F.col("props").alias("value")).write.text(f"{folder}/in")
    run_available(document_stream(spark, f"{folder}/in"), Engine([minified()]), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy(F.col("json").alias("minified")).agg(F.count(F.lit(1)).alias("n"))


_N = r"""'{"user": {"name": "' || c_name || '", "seg": "' || c_mktsegment || '", "profile": {"theme": "dark", "n": ' || c_custkey || '}}, "meta": {"created": 1, "updated": 2}, "list": [{"id": ' || c_custkey || ', "secret": "s"}, {"id": 2, "secret": "t"}], "user_id": ' || c_custkey || ', "App_V": 1.50}'"""
_OK = "o_orderkey % 6 < 2"
_ERROR = "CASE o_orderkey % 6 WHEN 2 THEN 'TrailingComma' WHEN 3 THEN 'ExpectedColon' WHEN 4 THEN 'InvalidNumber' WHEN 5 THEN 'UnterminatedObject' END"
_PART_ERRORS = """concat_ws(' ', CASE WHEN p_partkey < 1 THEN 'minimum@/key' END, CASE WHEN length(p_name) < 3 THEN 'minLength@/name' END, CASE WHEN length(p_name) > 12 THEN 'maxLength@/name' END,
  CASE WHEN p_size >= 40 THEN 'exclusiveMaximum@/size' END, CASE WHEN p_size % 2 <> 0 THEN 'multipleOf@/size' END)"""
_PART_SQL = f"""SELECT *, concat_ws(' ', CASE WHEN p_partkey % 10 = 0 THEN 'required@/brand' END, nullif({_PART_ERRORS}, ''),
  CASE WHEN p_partkey % 10 <> 0 AND p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'enum@/brand' END) AS errors FROM part"""

QUERIES = {
    "minify_sport_events": (minify_events, f"""SELECT event_id, m AS minified, strlen(props) AS in_bytes, strlen(m) AS out_bytes, strlen(m) / strlen(props) AS ratio
        FROM (SELECT *, {_WS_SQL.format("props")} AS m FROM events)"""),
    "minify_modes_mixed": (minify_modes, f"""SELECT o_orderkey, CASE WHEN {_OK} THEN m END AS eco, m AS sport, m AS turbo, m AS resilient
        FROM (SELECT *, {_WS_SQL.format("j")} AS m FROM (SELECT *, {_MIXED_SQL} AS j FROM orders))"""),
    "validate_flags": (validate_flags, f"""SELECT o_orderkey, {_OK} AS valid, {_ERROR} AS error, CAST(o AS INT) AS "offset", CASE WHEN o IS NOT NULL THEN 1 END AS line, CAST(o + 1 AS INT) AS "column", o_orderkey % 6 = -1 AS is_minified
        FROM (SELECT *, CASE o_orderkey % 6 WHEN 2 THEN length(j) - 1 WHEN 3 THEN 6 WHEN 4 THEN length(j) - 3 WHEN 5 THEN length(j) END AS o FROM (SELECT *, {_MIXED_SQL} AS j FROM orders))"""),
    "structure_counts": (structure, f"""SELECT c_custkey, CAST(6 AS BIGINT) AS objects, CAST(1 AS BIGINT) AS arrays, CAST(21 AS BIGINT) AS strings, CAST(7 AS BIGINT) AS numbers, CAST(0 AS BIGINT) AS booleans,
        CAST(0 AS BIGINT) AS nulls, CAST(strlen({_N}) AS BIGINT) AS bytes, 3 AS depth FROM customer"""),
    "structure_totals": (structure_sum, f"""SELECT CAST(sum(CASE o_orderkey % 6 WHEN 4 THEN 0 ELSE 1 END) AS BIGINT) AS objects, CAST(sum(CASE o_orderkey % 6 WHEN 1 THEN 2 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE 0 END) AS BIGINT) AS arrays,
        CAST(sum(CASE o_orderkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 4 THEN 0 ELSE 1 END) AS BIGINT) AS strings, CAST(sum(CASE o_orderkey % 6 WHEN 1 THEN 3 ELSE 1 END) AS BIGINT) AS numbers,
        CAST(0 AS BIGINT) AS booleans, CAST(0 AS BIGINT) AS nulls, CAST(sum(strlen({_MIXED_SQL})) AS BIGINT) AS bytes, count(*) FILTER (NOT ({_OK})) AS invalid FROM orders"""),
    "characteristics": (characteristics, r"""SELECT doc_id, CAST(s AS INT) AS size, CASE WHEN s > 0 THEN (length(text) - length(regexp_replace(text, '[ \t\n\r]', '', 'g'))) / s ELSE 0 END AS whitespace_ratio,
        CASE WHEN s > 0 THEN (length(text) - length(regexp_replace(text, '[{}\[\]:,]', '', 'g'))) / s ELSE 0 END AS structural_density,
        CAST(greatest(floor(s * CAST(0.7 AS DOUBLE)), 1) AS BIGINT) AS estimate, CAST(s + 1024 AS BIGINT) AS buffer, CAST(least(floor(sqrt(s)), 16777216) AS BIGINT) AS sport_memory
        FROM (SELECT *, strlen(text) AS s FROM documents)"""),
    "filter_include": (filter_include, """SELECT c_custkey, '{"user":{"name":"' || c_name || '","profile":{"theme":"dark","n":' || c_custkey || '}},"meta":{"created":1}}' AS out FROM customer"""),
    "filter_exclude": (filter_exclude, """SELECT c_custkey, '{"user":{"name":"' || c_name || '","seg":"' || c_mktsegment || '"},"list":[{"id":' || c_custkey || '},{"id":2}],"user_id":' || c_custkey || ',"App_V":1.50}' AS out FROM customer"""),
    "filter_glob": (filter_glob, """SELECT c_custkey, '{"list":[{"id":' || c_custkey || '},{"id":2}],"user_id":' || c_custkey || ',"App_V":1.50}' AS out FROM customer"""),
    "pretty_print": (pretty_print, """SELECT n_nationkey, '{' || chr(10) || '  "k": ' || n_nationkey || ',' || chr(10) || '  "n": [' || chr(10) || '    "' || n_name || '",' || chr(10) || '    {}' || chr(10) || '  ]' || chr(10) || '}' AS out FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer)"""),
    "sort_keys": (sorted_keys, """SELECT n_nationkey, '{"a":-0,"b":{"x":"' || n_name || '","y":2},"z":1.0}' AS out FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer)"""),
    "split_array": (split_arrays, """SELECT l_orderkey, CAST((r - 1) // 3 AS INT) AS chunk, '[' || string_agg('{"n":' || l_linenumber || ',"p":' || l_partkey || '}', ',' ORDER BY r) || ']' AS json
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, '{"n": ' || l_linenumber || ', "p": ' || l_partkey || '}') AS r FROM lineitem) GROUP BY l_orderkey, (r - 1) // 3"""),
    "tokenize": (tokens, """WITH t AS (SELECT n_nationkey, length(CAST(n_nationkey AS VARCHAR)) AS w, length(n_name) AS m, n_name, CAST(n_nationkey AS VARCHAR) AS k FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer)),
        u AS (SELECT n_nationkey, unnest([{'pos': 0, 'type': '{', 'value': '{', 'start': 0, 'line': 1, 'col': 1, 'depth': 0}, {'pos': 1, 'type': 'string', 'value': '"k"', 'start': 2, 'line': 1, 'col': 3, 'depth': 1},
          {'pos': 2, 'type': ':', 'value': ':', 'start': 5, 'line': 1, 'col': 6, 'depth': 1}, {'pos': 3, 'type': 'number', 'value': k, 'start': 7, 'line': 1, 'col': 8, 'depth': 1},
          {'pos': 4, 'type': ',', 'value': ',', 'start': 7 + w, 'line': 1, 'col': 8 + w, 'depth': 1}, {'pos': 5, 'type': 'string', 'value': '"n"', 'start': 11 + w, 'line': 2, 'col': 3, 'depth': 1},
          {'pos': 6, 'type': ':', 'value': ':', 'start': 14 + w, 'line': 2, 'col': 6, 'depth': 1}, {'pos': 7, 'type': '[', 'value': '[', 'start': 16 + w, 'line': 2, 'col': 8, 'depth': 1},
          {'pos': 8, 'type': 'string', 'value': '"' || n_name || '"', 'start': 17 + w, 'line': 2, 'col': 9, 'depth': 2}, {'pos': 9, 'type': ']', 'value': ']', 'start': 19 + w + m, 'line': 2, 'col': 11 + m, 'depth': 1},
          {'pos': 10, 'type': '}', 'value': '}', 'start': 21 + w + m, 'line': 2, 'col': 13 + m, 'depth': 0}]) AS x FROM t)
        SELECT n_nationkey, CAST(x.pos AS INT) AS pos, x."type" AS "type", x."value" AS "value", CAST(x."start" AS INT) AS "start", CAST(x."start" + length(x."value") AS INT) AS "end", CAST(x.line AS INT) AS line, CAST(x.col AS INT) AS col, CAST(x.depth AS INT) AS depth FROM u"""),
    "frame_concatenated": (frames, """SELECT n_nationkey, 0 AS part, '{"k":' || n_nationkey || '}' AS json FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer) UNION ALL SELECT n_nationkey, 1, '["' || n_name || '"]' FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer) UNION ALL SELECT n_nationkey, 2, '3' FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer)"""),
    "error_report": (errors, f"""SELECT e AS error_type, count(*) AS n, e = 'UnterminatedObject' AS fatal, CASE e WHEN 'InvalidNumber' THEN 'drop' ELSE 'keep' END AS policy FROM (SELECT {_ERROR} AS e FROM orders) WHERE e IS NOT NULL GROUP BY e"""),
    "error_policies": (policies, f"""SELECT o_orderkey, 'drop' AS policy, true AS valid FROM orders WHERE {_OK} UNION ALL SELECT o_orderkey, 'keep', {_OK} FROM orders UNION ALL SELECT o_orderkey, 'mend', o_orderkey % 6 < 3 FROM orders"""),
    "repair_escapes": (repaired, r"""SELECT o_orderkey, '{"a": "x?", "b": "\uFFFD", "c": "\\n' || o_orderkey || '"}' AS out, true AS valid FROM orders"""),
    "custom_uppercase": (uppercase, f"""SELECT event_id, upper({_WS_SQL.format("props")}) AS out FROM events"""),
    "compose_filter_minify": (composed, """SELECT c_custkey, '{"meta":{"created":1,"updated":2},"user_id":' || c_custkey || ',"App_V":1.50}' AS out FROM customer"""),
    "schema_keywords": (schema_check, f"""SELECT p_partkey, CASE WHEN errors = '' THEN 0 ELSE CAST(len(string_split(errors, ' ')) AS INT) END AS n, errors FROM ({_PART_SQL})"""),
    "schema_strict_pipeline": (schema_pipeline, f"""SELECT p_partkey, CASE WHEN errors = '' THEN '{{"key":' || p_partkey || ',"name":"' || p_name || '","size":' || p_size || ',"brand":"' || p_brand || '"}}' END AS out FROM ({_PART_SQL})"""),
    "schema_rules": (schema_rules, "SELECT p_partkey, " + ", ".join(f"(p_partkey % 11 <> 0 AND ({ok})) AS {name}" for name, (_, ok) in _RULES.items()) + " FROM part"),
    "complete_prefix": (prefixes, """SELECT n_nationkey, CAST(0 AS INT) AS pos, '"' || n_name || '"' AS json, true AS utf8 FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer)
        UNION ALL SELECT c_custkey, 1, CAST(c_custkey AS VARCHAR), true FROM customer"""),
    "schema_recursive": (schema_recursive, "SELECT p_partkey, p_partkey % 5 <> 0 AND p_size <= 30 AS ok, false AS ok_at_two FROM part"),
    "schema_error_details": (schema_details, """SELECT p_partkey, 'required' AS keyword, '#/required' AS schema_path, '"brand"' AS expected, 'object' AS actual FROM part WHERE p_partkey % 10 = 0
        UNION ALL SELECT p_partkey, 'maximum', '#/properties/size/maximum', '30', CAST(p_size AS VARCHAR) FROM part WHERE p_size > 30
        UNION ALL SELECT p_partkey, 'type', '#/properties/key/type', '"string"', CAST(p_partkey AS VARCHAR) FROM part"""),
    "key_lengths": (key_lengths, f"""SELECT c_custkey, CAST(len(k) AS BIGINT) AS "keys", CAST(list_sum(list_transform(k, lambda x: length(x))) AS DOUBLE) / len(k) AS avg_key_length, CAST(len(s) - len(k) AS BIGINT) AS strings
        FROM (SELECT c_custkey, regexp_extract_all(j, '"([^"]*)":', 1) AS k, regexp_extract_all(j, '"[^"]*"') AS s FROM (SELECT c_custkey, {_N} AS j FROM customer))"""),
    "skip_policy": (skipped, """SELECT o_orderkey, '{"a": "xy", "n": ' || CASE o_orderkey % 2 WHEN 0 THEN '7}' ELSE '[, 2]}' END AS out, CASE o_orderkey % 2 WHEN 1 THEN 'InvalidCharacter' END AS error FROM orders"""),
    "schema_formats": (schema_formats, """SELECT c_custkey, c_custkey % 4 = 0 AS ipv4, c_custkey % 4 = 2 AS "date", c_custkey % 4 = 3 AS email, false AS uri FROM customer"""),
    "semantic_equal": (equal_texts, "SELECT n_nationkey, n_nationkey % 2 = 0 AS equal FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer)"),
    "strip_comments": (comments, """SELECT n_nationkey, '{"a":"//' || n_name || '","b":1}' AS out FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer)"""),
    "duplicate_keys": (duplicates, """SELECT n_nationkey, 0 AS object, '"a"' AS name, CAST(2 AS BIGINT) AS n, 2 AS line FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer) UNION ALL SELECT n_nationkey, 4, '"k"', 2, 1 FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer)"""),
    "diagnostics": (diagnosed, f"""SELECT o_orderkey, CASE WHEN {_OK} THEN '' ELSE '2:' || {_ERROR} || ':' || CASE o_orderkey % 6 WHEN 2 THEN length(j) - 1 WHEN 3 THEN 6 WHEN 4 THEN length(j) - 3 WHEN 5 THEN length(j) END END AS findings,
        o_orderkey % 6 < 3 AS lenient, true AS container FROM (SELECT *, {_MIXED_SQL} AS j FROM orders)"""),
    "run_summary": (summary, f"""SELECT count(*) AS documents, CAST(sum(strlen(j)) AS BIGINT) AS input_bytes, CAST(coalesce(sum(strlen(m)), 0) AS BIGINT) AS output_bytes, count(*) FILTER (m IS NULL) AS errors,
        min(strlen(m) / strlen(j)) AS ratio_min, max(strlen(m) / strlen(j)) AS ratio_max FROM (SELECT *, CASE WHEN {_OK} THEN {_WS_SQL.format("j")} END AS m FROM (SELECT *, {_MIXED_SQL} AS j FROM orders))"""),
    "stream_minify": (streamed, f"SELECT {_WS_SQL.format('props')} AS minified, count(*) AS n FROM events GROUP BY 1"),
}
