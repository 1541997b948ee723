"""Conversations and their logs: the last message of a role, context windows, pairing, redaction, tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def last_of_role(messages: DataFrame, by: str, order: str, role: str) -> DataFrame:
    """The last message of a role in each conversation; an aggregate that combines before the shuffle."""
    cols = [c for c in messages.columns if c != by]
    return messages.where(F.col("role") == role).groupBy(by).agg(F.max_by(F.struct(*cols), order).alias("m")).select(by, "m.*")


def context_window(messages: DataFrame, by: str, order: str, tool_role: str = "tool", examples: Column | None = None, views: Column | None = None, history: Column | None = None) -> DataFrame:
    """Each conversation's messages as sent: examples first, views right after the last tool message (at the end if there is none), history last.

    The added parts are array<string> columns or literals. Returns (by, pos, role, content), pos from 0.
    """
    none = F.array().cast("array<string>")
    parts = {"examples": examples, "views": views, "history": history}
    rows = messages.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("role").alias("role"), F.col("text").alias("content")))).alias("m"),
        *[F.first(v if v is not None else none).alias(k) for k, v in parts.items()],
    )
    plain = lambda a: F.transform(a, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    as_user = lambda a: F.transform(a, lambda x: F.struct(F.lit("user").alias("role"), x.alias("content")))
    tools = F.filter(F.transform("m", lambda x, i: F.when(x["role"] == tool_role, i + 1)), lambda i: i.isNotNull())
    cut = F.coalesce(F.array_max(tools), F.size("m"))
    whole = F.concat(as_user(F.col("examples")), plain(F.slice("m", F.lit(1), cut)), as_user(F.col("views")), plain(F.slice("m", cut + 1, F.size("m"))), as_user(F.col("history")))
    return rows.select(by, F.posexplode(whole).alias("pos", "x")).select(by, "pos", "x.role", "x.content")


def paired(log: DataFrame, by: str, order: str, ask: str = "request", answer: str = "response", kind: str = "type") -> DataFrame:
    """Each request with the next row of its log if that is a response; else without."""
    run = W.partitionBy(by).orderBy(order)
    nxt = lambda c: F.lead(c).over(run)
    got = nxt(kind) == answer
    return log.select("*", F.when(got, nxt(order)).alias("answered_at")).where(F.col(kind) == ask)


def redacted(parts: Column, shown: str = "<redacted>") -> Column:
    """Message parts (type, text, url) without the addresses of images."""
    return F.transform(parts, lambda p: F.when(p["type"] == "image_url", p.withField("url", F.lit(shown))).otherwise(p))


def content_text(content: Column) -> Column:
    """Text of a message whose content is a string, null, or JSON of a list of parts."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    listed = content.startswith("[") & parts.isNotNull()
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    return F.when(listed, joined).otherwise(F.coalesce(content, F.lit("")))


def tool_calls(log: DataFrame, file: str = "file") -> DataFrame:
    """(file, call_id, name, arguments, result) of the tool calls in logged message lists; results by call id; repeats of the growing history once."""
    each = log.where(F.col("messages").isNotNull()).select(file, F.explode("messages").alias("m"))
    calls = each.select(file, F.explode("m.tool_calls").alias("c")).select(file, F.col("c.id").alias("call_id"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments")).distinct()
    results = each.where("m.role = 'tool'").groupBy(file, F.col("m.tool_call_id").alias("call_id")).agg(F.first("m.content").alias("result"))
    return calls.join(results, [file, "call_id"], "left")


def once(calls: DataFrame, by: list[str], order: list[str], name: str = "injected") -> DataFrame:
    """calls with a flag that is true for the first of each run only: what is added to a run's messages once."""
    return calls.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)) == 1)
