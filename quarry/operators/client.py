"""What stands between plans and services: settings (S26), messages and tool calls (X03) as columns, optional tables."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = "array<struct<id:string,name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,tool_calls:{CALLS},tool_call_id:string>"
REPLY = f"content string, tool_calls {CALLS}"


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """Of the environment, else of the session as spark.quarry.<name>, else the default. Values aren't logged or kept."""
    return os.environ.get(name) or spark.conf.get(f"spark.quarry.{name}", default)


def message(role: str, content: Column, calls: Column | None = None, answers: Column | None = None) -> Column:
    """One message of a conversation."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.struct(F.lit(role).alias("role"), content.alias("content"), (none(CALLS) if calls is None else calls).alias("tool_calls"), (none("string") if answers is None else answers).alias("tool_call_id"))


def conversation(user: Column, system: str | None = None) -> Column:
    """An array of messages."""
    first = [message("system", F.lit(system))] if system else []
    return F.array(*first, message("user", user))


def as_request(messages: Column, tools: list[dict] | None = None) -> Column:
    """What a provider is asked: JSON of messages and tools, absent parts left out; the same conversation is the same request."""
    body = F.to_json(F.struct(messages.alias("messages")))
    if not tools:
        return body
    return F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"tools":' + json.dumps(tools, sort_keys=True) + "}"))


def tool(name: str, description: str, parameters: dict[str, str], required: list[str] | None = None) -> dict:
    """A function that a model may call; parameters: name to JSON type."""
    return {"type": "function", "function": {"name": name, "description": description, "parameters": {"type": "object", "properties": {k: {"type": t} for k, t in parameters.items()}, "required": list(parameters) if required is None else required}}}


def parsed_reply(reply: Column) -> Column:
    """A struct of content and tool calls of a JSON reply; another text is content without calls."""
    found = F.from_json(reply, REPLY)
    plain = F.struct(reply.alias("content"), F.lit(None).cast(CALLS).alias("tool_calls"))
    return F.when(found["content"].isNotNull() | found["tool_calls"].isNotNull(), found).otherwise(plain)


def continued(messages: Column, reply: Column, results: Column) -> Column:
    """The conversation with a reply (as parsed_reply gives it) and, for each of its calls, the result at its place in an array of strings."""
    answer = F.array(F.struct(F.lit("assistant").alias("role"), reply["content"].alias("content"), reply["tool_calls"].alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id")))
    calls = F.coalesce(reply["tool_calls"], F.array().cast(CALLS))
    told = F.transform(calls, lambda c, i: F.struct(F.lit("tool").alias("role"), F.get(results, i).alias("content"), F.lit(None).cast(CALLS).alias("tool_calls"), c["id"].alias("tool_call_id")))
    return F.concat(messages.cast(f"array<{MESSAGE}>"), answer.cast(f"array<{MESSAGE}>"), told.cast(f"array<{MESSAGE}>"))


def optional(make: Callable[[], DataFrame], what: str) -> DataFrame | None:
    """A table that plans can do without: None, with a warning, where it can't be made."""
    try:
        return make()
    except Exception as e:
        warnings.warn(f"{what} is left out: {type(e).__name__}", stacklevel=2)
        return None
