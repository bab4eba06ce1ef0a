"""Accessors of a turn's ``data`` (VARIANT): its type, text, tool and error flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("user_input", "assistant_turn", "tool_call", "tool_result", "system", "assistant", "handoff")


def get_string(data: Column, path: str) -> Column:
    """The JSON string at ``path``; null if absent or of another type."""
    value = F.try_variant_get(data, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(data, path, "string"))


def get_true(data: Column, path: str) -> Column:
    """Whether a JSON true stands at ``path``."""
    value = F.try_variant_get(data, path, "variant")
    return F.coalesce((F.schema_of_variant(value) == "BOOLEAN") & F.try_variant_get(data, path, "boolean"), F.lit(False))


def has(data: Column, path: str) -> Column:
    """Whether ``path`` is present, even as null."""
    return F.try_variant_get(data, path, "variant").isNotNull()


def get_array(data: Column, path: str) -> Column:
    """The JSON array at ``path`` as array<variant>; null if absent or of another type."""
    value = F.try_variant_get(data, path, "variant")
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.try_variant_get(data, path, "array<variant>"))


def turn_type(data: Column) -> Column:
    kind = get_string(data, "$.item_type")
    return F.when(kind.isin(*TYPES), kind).otherwise("unknown")


def text_content(data: Column) -> Column:
    kind = turn_type(data)
    content, result = get_string(data, "$.system.content"), get_string(data, "$.tool_result.content")
    typed = (
        F.when(kind == "user_input", get_string(data, "$.user_input.text"))
        .when((kind == "tool_call") & has(data, "$.tool_call"), F.concat(F.coalesce(get_string(data, "$.tool_call.name"), F.lit("unknown")), F.lit(": "), F.coalesce(get_string(data, "$.tool_call.args"), F.lit(""))))
        .when(kind == "tool_result", F.concat(F.when(get_true(data, "$.tool_result.is_error"), "ERROR: ").otherwise(""), result))
        .when(kind == "assistant", get_string(data, "$.assistant.text"))
        .when(kind == "assistant_turn", get_string(data, "$.turn.text"))
        .when(kind == "system", F.concat(F.lit("["), F.coalesce(get_string(data, "$.system.kind"), F.lit("info")), F.lit("] "), content))
    )
    whole = F.when(F.schema_of_variant(data) == "STRING", F.try_variant_get(data, "$", "string")).when(F.schema_of_variant(data) != "VOID", F.to_json(data))
    flat = [get_string(data, f"$.{k}") for k in ("text", "content", "output")]
    return F.coalesce(typed, *flat, F.concat(F.lit("ERROR: "), get_string(data, "$.error")), whole, F.lit(""))


def tool_name(data: Column) -> Column:
    first = F.when(has(data, "$.tool"), get_string(data, "$.tool")).when(has(data, "$.name"), get_string(data, "$.name")).otherwise(get_string(data, "$.tool_name"))
    return F.coalesce(get_string(data, "$.tool_call.name"), first)


def is_error(data: Column) -> Column:
    code = F.when(F.schema_of_variant(F.try_variant_get(data, "$.exit_code", "variant")) == "BIGINT", F.try_variant_get(data, "$.exit_code", "long"))
    failed = F.coalesce(get_string(data, "$.status").isin("error", "failed"), F.lit(False))
    return get_true(data, "$.tool_result.is_error") | F.coalesce(get_string(data, "$.system.kind") == "error", F.lit(False)) | has(data, "$.error") | failed | F.coalesce(code != 0, F.lit(False))


def unsigned(value: Column) -> Column:
    """A number, or its text, as decimal(20,0); null where it is blank, negative or none."""
    number = F.nullif(value.cast("string"), F.lit("")).try_cast("decimal(20,0)")
    return F.when(number >= 0, number)


def label(title: Column, client_tag: Column) -> Column:
    """What a session is shown as: its title, else the tag of the client."""
    return F.coalesce(title, client_tag)
