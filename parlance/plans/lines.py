"""Queries on lines, canonical JSON, manifests and differences of JSON values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.canonical import canonical_row
from ..operators import manifest as M
from ..operators import values as V
from ..operators.schema import schema_violations
from ..sources import files, sinks
from ..sources.scratch import shared_folder
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return put


@add("written_lines", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn)::bigint AS at, sha256(to_json({'conv_id': conv_id, 'role': role, 'text': text, 'turn': turn})::varchar) AS sha256 FROM conversations")
def written_lines(spark, d):
    """Turns written as canonical lines in a total order over many files, and read again with their numbers and hashes."""
    path = shared_folder(spark, "lines")
    sinks.write_jsonl(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path, ["conv_id", "turn"], single=False)
    lines = files.running_lines(files.parsed_lines(files.read_lines(spark, path), "conv_id long, turn long"))
    return lines.select("record.conv_id", "record.turn", "at", "sha256")


NESTED = "{'attributes': {'kind': event_type, 'user': user_id}, 'id': event_id, 'list': [{'a': value, 'b': NULL}, {'a': NULL, 'b': event_type}], 'map': MAP {'x': event_id % 7, 'y': NULL}, 'on': event_id % 2 = 0}"


@add("canonical_json_hash", f"SELECT event_id, sha256(to_json({NESTED})::varchar) AS sha256 FROM events")
def canonical_json_hash(spark, d):
    """Structs, arrays and maps, declared in another order than that of their keys."""
    e = table(spark, d, "events")
    pair = lambda b, a: F.struct(b.cast("string").alias("b"), a.cast("double").alias("a"))
    x = e.select(
        F.col("event_id").alias("id"), (F.pmod("event_id", F.lit(2)) == 0).alias("on"), F.create_map(F.lit("y"), F.lit(None).cast("long"), F.lit("x"), F.pmod("event_id", F.lit(7)).cast("long")).alias("map"),
        F.array(pair(F.lit(None), F.col("value")), pair(F.col("event_type"), F.lit(None))).alias("list"), F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("attributes"),
    )
    return x.select(F.col("id").alias("event_id"), F.sha2(canonical_row(x), 256).alias("sha256"))


def _tree(bits: int) -> str:
    parts = [f"l{bits} AS (SELECT lang, spot, sha256(coalesce(n || ':' || a || ':' || b, '{M.EMPTY}')) AS h FROM ((SELECT DISTINCT lang FROM r) CROSS JOIN (SELECT unnest(range({1 << bits})) AS spot)) LEFT JOIN g USING (lang, spot))"]
    parts += [f"l{k - 1} AS (SELECT lang, spot // 2 AS spot, sha256(string_agg(h, '' ORDER BY spot)) AS h FROM l{k} GROUP BY lang, spot // 2)" for k in range(bits, 0, -1)]
    return ", ".join(parts)


@add("dataset_manifest", f"""WITH r AS (SELECT lang, sha256(to_json({{'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text}})::varchar) AS s FROM documents),
    g AS (SELECT lang, ('0x' || s[1:1])::int AS spot, count(*)::varchar AS n, sum(('0x' || s[1:15])::bigint)::varchar AS a, sum(('0x' || s[16:30])::bigint)::varchar AS b FROM r GROUP BY 1, 2), {_tree(4)}
    SELECT lang, t.n, h AS root FROM l0 JOIN (SELECT lang, count(*)::bigint AS n FROM r GROUP BY lang) t USING (lang)""")
def dataset_manifest(spark, d):
    """Rows and root of each language's documents, whatever files they are in."""
    return M.manifest(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), by=("lang",), bits=4)


#: By kind of change (event_id modulo 8; 0 is none, 4 another order of keys, 7 a value that goes): where the values differ.
_DIFFER = {
    1: [('$["n"]', "integer", "1", "number", "1.0")], 2: [('$["n"]', "integer", "1", "boolean", "true")], 3: [('$["n"][1]["x"]', "null", "", "integer", "0")], 4: [], 5: [('$["a"]', "array", "", "object", "")], 6: [("$[2]", "integer", "3", None, None)],
}


def _differences_sql() -> str:
    q = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    rows = " UNION ALL ".join(f"SELECT {k}, {', '.join(map(q, r))}" for k, found in _DIFFER.items() for r in found)
    # a value that is missing on one side: the whole of the other's, taken apart by the other engine's own reader
    whole = """SELECT event_id, '$' AS path, 'object' AS left_type, '' AS left_value, 'missing' AS right_type, '' AS right_value FROM events WHERE event_id % 8 = 7
      UNION ALL SELECT event_id, '$["' || t.key || '"]', CASE WHEN t.type IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN t.type = 'DOUBLE' THEN 'number' WHEN t.type = 'VARCHAR' THEN 'string' WHEN t.type = 'BOOLEAN' THEN 'boolean' ELSE lower(t.type) END, coalesce(json_extract_string(t.value, '$'), ''), NULL, NULL
        FROM events, json_each(props) t WHERE event_id % 8 = 7"""
    return f"SELECT event_id, c.path, c.left_type, c.left_value, c.right_type, c.right_value FROM events JOIN ({rows}) c(k, path, left_type, left_value, right_type, right_value) ON event_id % 8 = c.k UNION ALL {whole}"


@add("json_differences", _differences_sql())
def json_differences(spark, d):
    """Properties of events before and after a change of one kind each, and where the values differ."""
    e = table(spark, d, "events").select("event_id", "props", F.pmod("event_id", F.lit(8)).alias("k"))
    cut = F.expr("substring(props, 1, length(props) - 1)")
    tail = lambda s: F.concat(cut, F.lit(s))
    old = {1: tail(', "n": 1}'), 2: tail(', "n": 1}'), 3: tail(', "n": [1, {"x": null}]}'), 4: F.lit('{"a": 1, "b": [true, "1"]}'), 5: F.lit('{"a": []}'), 6: F.lit("[1, 2, 3]")}
    new = {1: tail(', "n": 1.0}'), 2: tail(', "n": true}'), 3: tail(', "n": [1, {"x": 0}]}'), 4: F.lit('{"b":[true,"1"],"a":1}'), 5: F.lit('{"a": {}}'), 6: F.lit("[1, 2]"), 7: F.lit(None).cast("string")}

    def changed(by):
        out = F.when(F.lit(False), F.col("props"))
        for k, v in by.items():
            out = out.when(F.col("k") == k, v)
        return e.select("event_id", out.otherwise(F.col("props")).alias("props"))

    return V.differences(changed(old), changed(new), "event_id", "props")


RECORD = {
    "type": "object", "required": ["id", "kind", "n", "tags"], "not": {"required": ["secret"]}, "if": {"properties": {"n": {"const": 5}}}, "then": {"required": ["why"]},
    "properties": {
        "id": {"anyOf": [{"type": "string", "pattern": "^e[0-9]+$"}, {"type": "string", "pattern": "^old-"}]}, "kind": {"type": "string", "minLength": 1}, "n": {"type": "integer", "minimum": 1, "maximum": 5},
        "tags": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "string", "minLength": 1}}, "who": {"type": ["object", "null"], "additionalProperties": False, "properties": {"name": {"type": "string"}}},
    },
}
#: kind of fault (event_id modulo 16) -> part of the document that has it, and what must be found.
_FAULTS = {
    1: ("kind", "", "$.kind: required"), 2: ("n", '"n":0,', "$.n: minimum"), 3: ("n", '"n":true,', "$.n: type"), 4: ("tags", '"tags":["a","a"],', "$.tags: uniqueItems"), 5: ("tags", '"tags":["a",""],', "$.tags[]: minLength"),
    6: ("who", '"who":{"name":"x","age":1}', "$.who: additionalProperties"), 7: ("id", '"id":"x",', "$.id: anyOf"), 8: ("kind", '"kind":"a","secret":null,', "$: not"), 9: ("n", '"n":5,', "$: if"), 10: ("who", '"who":', "not strict JSON"), 11: ("id", '"id":"e1","id":"e1",', "not strict JSON"),
}


@add("schema_report", f"SELECT 'V2' AS rule_id, event_id::varchar AS record_id, detail FROM events JOIN (VALUES {', '.join(f'({k}, {chr(39)}{d}{chr(39)})' for k, (_, _, d) in _FAULTS.items())}) f(k, detail) ON event_id % 16 = f.k")
def schema_report(spark, d):
    """A JSON document for each event, some with a fault, under a schema that is compiled."""
    e = table(spark, d, "events").select("event_id", "event_type", F.pmod("event_id", F.lit(16)).alias("k"))
    i = F.col("event_id").cast("string")
    n = F.pmod("event_id", F.lit(4)) + 1
    sound = {"id": F.concat(F.lit('"id":"e'), i, F.lit('",')), "kind": F.concat(F.lit('"kind":"'), "event_type", F.lit('",')), "n": F.concat(F.lit('"n":'), n.cast("string"), F.lit(",")), "tags": F.lit('"tags":["a","b"],'), "who": F.lit('"who":null')}
    for k, (part, text, _) in _FAULTS.items():
        sound[part] = F.when(F.col("k") == k, F.lit(text)).otherwise(sound[part])
    doc = F.concat(F.lit("{"), *sound.values(), F.lit("}"))
    return schema_violations(e.select("event_id", doc.alias("doc")), F.col("event_id"), F.col("doc"), RECORD)
