"""Log documents to rows, one per content block, with Spark SQL functions only.

A document's blocks are read as VARIANT (to tell strings, objects and lists apart) side
by side with their JSON text (which keeps the key order). Runs of text blocks become one
row each. The runs are cut at the tool blocks with array slices, so the work per document
grows linearly with its blocks and needs no shuffle.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.expressions import parse_timestamp
from tracemill.schemas import BRONZE

BLOCK = (
    "struct<block_type:string,content:string,form:string,tool_name:string,tool_id:string,"
    "tool_use_id:string,raw:string>"
)
# How the text of a column was built: as is, JSON of a value, or a value printed as text.
TEXT, JSON, PRINTED = "text", "json", "printed"


@F.pandas_udf(T.StringType())
def _python_text(source: pd.Series, form: pd.Series) -> pd.Series:
    """JSON text in the spacing and escaping of Python's json module, or the printed value."""

    def one(text, how):
        if text is None:
            return None
        value = json.loads(text)
        return json.dumps(value) if how == JSON else str(value)

    return pd.Series([one(t, h) for t, h in zip(source, form)], dtype=object)


def _kind(v: Column) -> Column:
    """object, array, or the type name of a scalar; the casts look at the top level only."""
    return (
        F.when(v.isNull() | F.is_variant_null(v), "VOID")
        .when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), "OBJECT")
        .when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), "ARRAY")
        .otherwise(F.schema_of_variant(v))
    )


def _string(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _present(text: Column) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(text, F.lit(""))


def _json_source(v: Column, text: Column) -> Column:
    """JSON text of a value: the original text, which keeps key order and number format,
    except for a string, whose quotes were lost when it was extracted."""
    return F.when(_kind(v) == "STRING", F.to_json(v)).otherwise(text)


def _is_text_item(v: Column) -> Column:
    kind = _kind(v)
    return (kind == "STRING") | ((kind == "OBJECT") & F.coalesce(_string(v, "$.type") == "text", F.lit(False)))


def _item_text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", _string(v, "$")).otherwise(F.coalesce(_string(v, "$.text"), F.lit("")))


def _null() -> Column:
    return F.lit(None).cast("string")


def _block(block_type, content, form=None, name=None, tool_id=None, use_id=None, raw=None) -> Column:
    parts = {
        "block_type": block_type,
        "content": content,
        "form": F.lit(TEXT) if form is None else form,
        "tool_name": name,
        "tool_id": tool_id,
        "tool_use_id": use_id,
        "raw": raw,
    }
    return F.struct(*[(_null() if c is None else c).alias(n) for n, c in parts.items()])


def _label(v: Column) -> Column:
    """What a list element is: string, text, tool_use, tool_result, or null to drop it."""
    named = F.try_variant_get(v, "$", "map<string,variant>")["type"]
    label = F.try_variant_get(named, "$", "string")
    return F.when(named.isNotNull(), F.when(label.isin("text", "tool_use", "tool_result"), label)).when(
        _kind(v) == "STRING", "string"
    )


def _read_block(element: Column) -> Column:
    """A labelled element as a block."""
    v, text, label = element["v"], element["t"], element["label"]
    given = _part(v, "$.input")
    # Empty inputs of any type leave no content.
    empty = given.isNull() | F.to_json(given).isin("null", "{}", "[]", '""', "0", "false", "0.0")
    result = _part(v, "$.content")
    result_kind = _kind(result)
    items = F.try_variant_get(v, "$.content", "array<variant>")
    joined = F.array_join(F.transform(F.filter(items, _is_text_item), _item_text), "\n")
    result_text = (
        F.when(result.isNull(), "")
        .when(result_kind == "STRING", _string(v, "$.content"))
        .when(result_kind == "ARRAY", joined)
        .when(result_kind == "VOID", "None")
        .otherwise(_json_source(result, F.get_json_object(text, "$.content")))
    )
    printed = result.isNotNull() & ~result_kind.isin("STRING", "ARRAY", "VOID")
    speech = _block(
        F.lit("text"),
        F.when(label == "string", _string(v, "$")).otherwise(F.coalesce(_string(v, "$.text"), F.lit(""))),
    )
    call = _block(
        label,
        F.when(~empty, _json_source(given, F.get_json_object(text, "$.input"))),
        F.lit(JSON),
        name=_string(v, "$.name"),
        tool_id=_string(v, "$.id"),
        raw=text,
    )
    answer = _block(
        label,
        result_text,
        F.when(printed, PRINTED).otherwise(TEXT),
        use_id=_string(v, "$.tool_use_id"),
        raw=text,
    )
    return (
        F.when(label == "tool_use", call.cast(BLOCK)).when(label == "tool_result", answer.cast(BLOCK)).otherwise(speech.cast(BLOCK))
    )


def _merge_text(blocks: Column, role: Column) -> Column:
    """Consecutive text blocks joined into one; tool blocks stay where they are."""
    count = F.size(blocks)
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    tool_at = F.filter(at, lambda i: F.get(blocks, i)["block_type"] != "text")
    starts = F.concat(F.array(F.lit(0)), F.transform(tool_at, lambda i: i + 1))
    ends = F.concat(tool_at, F.array(count))

    def run(bounds: Column) -> Column:
        first, after = bounds["0"], bounds["1"]
        texts = F.transform(F.slice(blocks, first + 1, after - first), lambda b: b["content"])
        following = F.get(blocks, after)
        default = (
            F.when(following["block_type"] == "tool_use", "assistant")
            .when(following["block_type"] == "tool_result", "user")
            .otherwise("unknown")
        )
        merged = _block(F.coalesce(role, default), F.array_join(texts, "\n")).cast(BLOCK)
        none = F.array().cast(f"array<{BLOCK}>")
        return F.concat(
            F.when(after > first, F.array(merged)).otherwise(none),
            F.when(after < count, F.array(following.cast(BLOCK))).otherwise(none),
        )

    return F.flatten(F.transform(F.arrays_zip(starts.alias("0"), ends.alias("1")), run))


def content_blocks(docs: DataFrame) -> DataFrame:
    """Add `blocks`, the ordered content blocks of each document (empty list if none)."""
    d = docs.withColumn("_message", F.from_json("entry", "message variant")["message"])
    message = F.col("_message")
    d = d.withColumns({"_kind": _kind(message), "_content": _part(message, "$.content")})
    d = d.withColumns(
        {
            "_content_kind": _kind(F.col("_content")),
            "_type": _present(F.col("type")),
            "_role": F.when(F.col("_kind") == "OBJECT", _present(_string(message, "$.role"))),
        }
    )
    d = d.withColumn("_role", F.coalesce("_role", "_type"))
    # Only lists are taken apart; for other documents both arrays stay null.
    is_list = (F.col("_kind") == "OBJECT") & (F.col("_content_kind") == "ARRAY")
    elements = F.arrays_zip(
        F.try_variant_get("_content", "$", "array<variant>").alias("v"),
        F.from_json(F.get_json_object("entry", "$.message.content"), "array<string>").alias("t"),
    )
    # Labelled first, so that the test of an element's type runs once per element.
    labelled = F.transform(
        elements, lambda e: F.struct(e["v"].alias("v"), e["t"].alias("t"), _label(e["v"]).alias("label"))
    )
    listed = F.transform(F.filter(labelled, lambda e: e["label"].isNotNull()), _read_block)
    d = d.withColumn("_listed", F.when(is_list, listed))
    whole = F.get_json_object("entry", "$.message")
    scalar = F.col("_content_kind") != "STRING"
    single = _block(
        F.coalesce("_role", F.lit("unknown")),
        F.when(scalar, _json_source(F.col("_content"), F.get_json_object("entry", "$.message.content"))).otherwise(
            _string(F.col("_content"), "$")
        ),
        F.when(scalar, PRINTED).otherwise(TEXT),
        raw=whole,
    )
    plain = _block(F.coalesce("_type", F.lit("unknown")), _string(message, "$"))
    other = _block(F.lit("unknown"), _null(), raw=_json_source(message, whole))
    blocks = (
        F.when(F.col("_kind") == "VOID", F.array().cast(f"array<{BLOCK}>"))
        .when(F.col("_kind") == "STRING", F.array(plain.cast(BLOCK)))
        .when(is_list, _merge_text(F.col("_listed"), F.col("_role")))
        .when((F.col("_kind") == "OBJECT") & (F.col("_content_kind") == "VOID"), F.array().cast(f"array<{BLOCK}>"))
        .when(F.col("_kind") == "OBJECT", F.array(single.cast(BLOCK)))
        .otherwise(F.array(other.cast(BLOCK)))
    )
    return d.withColumn("blocks", blocks).select(*docs.columns, "blocks")


def flatten_documents(docs: DataFrame, extracted_at: Column, python_json: bool = True) -> DataFrame:
    """Bronze rows of log documents.

    With `python_json` the JSON texts have the spacing and escaping of Python's json module,
    which content lengths depend on; the values are rewritten by a small Arrow function.
    Without it they are compact and everything stays in the JVM.
    """
    timestamp = parse_timestamp(F.col("timestamp"))
    rows = content_blocks(docs).select(
        "*", F.posexplode_outer("blocks").alias("_index", "_b"), timestamp.alias("_timestamp")
    )
    b = F.col("_b")
    speech = b["block_type"].isin("assistant", "user")
    content, raw = b["content"], b["raw"]
    if python_json:
        # Plain text, the bulk of the data, does not go to Python.
        built = b["form"] != TEXT
        content = F.when(built, _python_text(F.when(built, content), b["form"])).otherwise(content)
        raw = _python_text(raw, F.lit(JSON))
    columns = {
        "_id": F.when(F.coalesce("_index", F.lit(0)) == 0, F.col("_id")).otherwise(
            F.concat_ws("_", "_id", F.col("_index").cast("string"))
        ),
        "type": F.when(b.isNull(), F.col("type"))
        .when(speech, F.coalesce(_present(F.col("type")), b["block_type"]))
        .otherwise(b["block_type"]),
        "session_id": F.col("sessionId"),
        "project_id": F.col("projectId"),
        "timestamp": F.col("_timestamp"),
        "ingested_at": F.col("ingestedAt"),
        "extracted_at": extracted_at,
        "message_role": F.when(b["block_type"] == "tool_use", "assistant")
        .when(b["block_type"] == "tool_result", "user")
        .when(speech, b["block_type"]),
        "message_content": content,
        "message_raw": raw,
        "source_file": F.col("sourceFile"),
        "date": F.to_date(F.coalesce("_timestamp", "ingestedAt", extracted_at)),
        "tool_name": b["tool_name"],
        "tool_id": b["tool_id"],
        "tool_use_id": b["tool_use_id"],
    }
    return rows.select(*[columns[f.name].alias(f.name) for f in BRONZE.fields])
