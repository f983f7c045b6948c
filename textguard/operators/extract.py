"""Text fields of nested JSON payloads: out to rows, and back in."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.functions.regex import sql_string

# Which fields hold text.
TEXT_KEYS = (
    "content", "text", "input", "output", "result", "results", "system", "developer", "instructions",
    "prompt", "completion", "arguments", "metadata", "summary", "description",
)
CONTEXT_KEYS = ("metadata", "tool_result", "tool_results", "mcp", "annotations")
JSON_STRING_KEYS = ("arguments", "input", "metadata", "content", "output", "result")
CONVERSATION_KEYS = ("conversation_id", "thread_id", "session_id", "request_id")

PATH_TYPE = "array<struct<key:string,pos:int>>"
DEFAULT_DEPTH = 8


def parse_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``_json`` (variant) and ``malformed``: not JSON, or not an object."""
    is_object = F.col("_json").isNotNull() & F.rlike(payload, F.lit(r"^\s*+\{"))
    return df.withColumn("_json", strict_json(F.col(payload))).withColumn(
        "malformed", ~F.coalesce(is_object, F.lit(False))
    )


def extract_items(
    parsed: DataFrame,
    key: str = "request_id",
    depth: int = DEFAULT_DEPTH,
    array_strings: bool = False,
) -> DataFrame:
    """``(key, path, text, json_encoded)``: one row per text field of each payload.

    A string counts if it is an object's value under a text key, or anywhere below a context key.
    Every level is one ``variant_explode`` (no shuffle, one scan); values already at a leaf pass
    through. The rare containers below ``depth`` go through an Arrow UDF. With ``array_strings``,
    strings directly inside arrays count like their array.
    """
    query = f"""SELECT {key}, _json AS v, CAST(array() AS {PATH_TYPE}) AS path, CAST(NULL AS STRING) AS field,
                       false AS context, false AS in_array FROM {{parsed}} WHERE NOT malformed"""
    for _ in range(depth):
        query = _one_level_down(key, query)
    level = parsed.sparkSession.sql(query, parsed=parsed)
    kind = F.schema_of_variant("v")
    deep = kind.startswith("OBJECT<") | kind.startswith("ARRAY<")
    # Leaves as they are; containers as the leaves below them.
    leaf = F.struct(
        "path", F.try_variant_get("v", "$", "string").alias("text"), "field", "context", "in_array"
    )
    below = F.transform(
        leaves_below(F.when(F.col("deep"), F.to_json("v"))),
        lambda d: F.struct(
            F.concat("path", d["path"]).alias("path"),
            d["text"].alias("text"),
            F.coalesce(d["field"], F.col("field")).alias("field"),
            (F.col("context") | F.exists(d["path"], lambda p: F.coalesce(p["key"].isin(*CONTEXT_KEYS), F.lit(False)))).alias("context"),
            d["in_array"].alias("in_array"),
        ),
    )
    counts = F.col("field").isin(*TEXT_KEYS) | F.col("context")
    if not array_strings:
        counts = counts & ~F.col("in_array")
    return (
        level.withColumn("deep", deep)
        .where(F.col("deep") | (kind == "STRING"))
        .select(key, F.inline(F.when(F.col("deep"), below).otherwise(F.array(leaf))))
        .where(counts)
        .withColumn(
            "json_encoded",
            F.coalesce(F.col("field").isin(*JSON_STRING_KEYS) & is_json_text(F.col("text")), F.lit(False)),
        )
        .select(key, "path", "text", "json_encoded")
    )


def items_of(parts: Column, array_strings: bool = False) -> Column:
    """``array<struct<at, path, text, json_encoded>>``: the text fields of one payload, in the order of the text, from its tokens.

    The same fields as ``extract_items`` finds, without leaving the row.
    """
    from textguard.operators.jsontext import string_leaves

    def field(leaf: Column) -> Column:
        return F.try_element_at(F.filter(leaf["path"], lambda p: p["key"].isNotNull()), F.lit(-1))["key"]

    def counts(leaf: Column) -> Column:
        context = F.exists(leaf["path"], lambda p: F.coalesce(p["key"].isin(*CONTEXT_KEYS), F.lit(False)))
        test = F.coalesce(field(leaf).isin(*TEXT_KEYS), F.lit(False)) | context
        in_array = F.coalesce(F.try_element_at(leaf["path"], F.lit(-1))["pos"].isNotNull(), F.lit(True))
        return test if array_strings else test & ~in_array

    def item(leaf: Column) -> Column:
        encoded = F.coalesce(field(leaf).isin(*JSON_STRING_KEYS) & is_json_text(leaf["text"]), F.lit(False))
        return F.struct(leaf["at"].alias("at"), leaf["path"].alias("path"), leaf["text"].alias("text"), encoded.alias("json_encoded"))

    return F.transform(F.filter(string_leaves(parts), counts), item)


_STEP = T.StructType().add("key", T.StringType()).add("pos", T.IntegerType())
_LEAF = (
    T.StructType()
    .add("path", T.ArrayType(_STEP))
    .add("text", T.StringType())
    .add("field", T.StringType())
    .add("in_array", T.BooleanType())
)


def _one_level_down(key: str, level: str) -> str:
    keys = ", ".join(sql_string(k) for k in CONTEXT_KEYS)
    return f"""
      SELECT p.{key},
             CASE WHEN e.pos IS NULL THEN p.v ELSE e.value END AS v,
             CASE WHEN e.pos IS NULL THEN p.path ELSE concat(p.path, array(named_struct(
               'key', e.key, 'pos', CASE WHEN e.key IS NULL THEN e.pos END))) END AS path,
             coalesce(e.key, p.field) AS field,
             p.context OR coalesce(e.key IN ({keys}), false) AS context,
             CASE WHEN e.pos IS NULL THEN p.in_array ELSE e.key IS NULL END AS in_array
      FROM ({level}) AS p, LATERAL variant_explode_outer(p.v) AS e"""


@F.pandas_udf(T.ArrayType(_LEAF))
def leaves_below(documents: pd.Series) -> pd.Series:
    """String leaves of JSON documents, with their paths."""

    def one(document: str | None):
        if document is None:
            return None
        found, todo = [], [((), None, json.loads(document))]
        while todo:
            path, field, value = todo.pop()
            if isinstance(value, dict):
                todo += [((*path, {"key": k, "pos": None}), k, v) for k, v in value.items()]
            elif isinstance(value, list):
                todo += [((*path, {"key": None, "pos": i}), field, v) for i, v in enumerate(value)]
            elif isinstance(value, str):
                in_array = bool(path) and path[-1]["key"] is None
                found.append({"path": list(path), "text": value, "field": field, "in_array": in_array})
        return found

    return pd.Series([one(d) for d in documents], dtype=object)


def strict_json(text: Column) -> Column:
    """The variant of a string that is one JSON value as a whole, else null.

    The parser stops after the first value, whatever follows it. Inside an array and inside an object the
    text can only be followed by the closing bracket of each, so what passes both has nothing after it.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    single = F.try_variant_get(listed, "$[1]", "variant").isNull() & F.try_variant_get(listed, "$[0]", "variant").isNotNull()
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(single & keyed, F.try_parse_json(text))


def is_json_text(text: Column) -> Column:
    """A string that as a whole is a JSON object or array."""
    return F.rlike(text, F.lit(r"^\s*+[\[{]")) & strict_json(text).isNotNull()


def path_text(path: Column) -> Column:
    """Readable form: ``messages[0].content``."""
    parts = F.transform(
        path,
        lambda p, i: F.when(p["key"].isNull(), F.concat(F.lit("["), p["pos"].cast("string"), F.lit("]")))
        .when(i == 0, p["key"])
        .otherwise(F.concat(F.lit("."), p["key"])),
    )
    return F.array_join(parts, "")


def conversation_key(json_column: Column, request_id: Column) -> Column:
    """First non-empty string among the id fields, at top level and then in ``metadata``; else a key
    of the request's own, which is the same on every run."""

    def at(path: str) -> Column:
        value = F.try_variant_get(json_column, path, "variant")
        is_string = F.schema_of_variant(value) == "STRING"
        return F.nullif(F.when(is_string, F.try_variant_get(json_column, path, "string")), F.lit(""))

    paths = [f"$.{k}" for k in CONVERSATION_KEYS] + [f"$.metadata.{k}" for k in CONVERSATION_KEYS]
    return F.coalesce(*[at(p) for p in paths], F.concat(F.lit("request:"), request_id.cast("string")))


def compact_json(text: Column) -> Column:
    """Drop white space outside strings; keeps key order and number spelling."""
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|\s++', "$1")


EDIT_TYPE = "array<struct<path:array<struct<key:string,pos:int>>,text:string,json_encoded:boolean>>"


@F.pandas_udf(T.StringType())
def write_back(payloads: pd.Series, edits: pd.Series) -> pd.Series:
    """Set new texts at their paths; JSON held in strings is re-encoded without white space.

    A payload that cannot be rewritten gives null, which callers must not let through.
    """

    def compact(value) -> str:
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)

    def one(payload: str | None, changes) -> str | None:
        if payload is None or changes is None or len(changes) == 0:
            return payload
        try:
            document = json.loads(payload)
            for change in changes:
                *parents, last = [s["key"] if s["key"] is not None else int(s["pos"]) for s in change["path"]]
                place = document
                for step in parents:
                    place = place[step]
                text = change["text"]
                place[last] = compact(json.loads(text)) if change["json_encoded"] else text
            return compact(document)
        except (ValueError, LookupError, TypeError, RecursionError):
            return None

    return pd.Series([one(p, e) for p, e in zip(payloads, edits)], dtype=object)


def override_model(df: DataFrame, model: str | None, column: str = "model") -> DataFrame:
    """Replace the model name where there is one and a replacement is given."""
    if not model:
        return df
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.lit(model)))


def override_model_in_payload(payload: Column, model: str | None) -> Column:
    """The same on a JSON payload; only the value of the top-level ``model`` changes, everything else stays as it is spelled."""
    from textguard.functions.arrays import bind
    from textguard.operators.jsontext import literal_of, tokens

    if not model:
        return payload
    has_model = F.try_variant_get(F.try_parse_json(payload), "$.model", "variant").isNotNull()

    def replaced(parts: Column) -> Column:
        # Places of the key's value at depth one: from after its colon to before the next comma or the end.
        first = F.transform(parts, lambda t: F.substring(t, 1, 1))
        change = lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        walked = F.aggregate(
            F.zip_with(parts, first, lambda t, c: F.struct(t.alias("t"), c.alias("c"))),
            F.struct(F.lit(0).alias("depth"), F.lit(False).alias("value"), F.lit(True).alias("key"), F.lit(False).alias("put"),
                     F.array().cast("array<string>").alias("out")),
            lambda s, p: _model_step(s, p, literal_of(F.lit(model)), change),
        )
        return F.array_join(walked["out"], "")

    return F.when(has_model, bind(tokens(F.when(has_model, payload)), replaced)).otherwise(payload)


def _model_step(state: Column, part: Column, new: Column, change) -> Column:
    """One token: ``key`` says that a key of the outer object may come, ``value`` that the model's value is being left out."""
    from textguard.operators.jsontext import string_of

    token, head = part["t"], part["c"]
    depth = state["depth"] + change(head)
    outer = state["depth"] == 1
    ends = state["value"] & ((outer & (head == ",")) | ((depth == 0) & (head == "}")))
    names = state["key"] & outer & (head == '"') & (string_of(F.when(head == '"', token)) == "model")
    starts = outer & (head == ":") & state["put"]
    blank = head.isin(" ", "\t", "\r", "\n")
    value = (state["value"] & ~ends) | starts
    kept = F.when(starts, F.array(token, new)).when(value, F.array().cast("array<string>")).otherwise(F.array(token))
    return F.struct(
        depth.alias("depth"),
        value.alias("value"),
        F.when(outer & (head == ","), F.lit(True)).when(outer & ((head == ":") | (head == '"')), F.lit(False)).otherwise(state["key"]).alias("key"),
        (names | (state["put"] & blank)).alias("put"),
        F.concat(state["out"], kept).alias("out"),
    )
