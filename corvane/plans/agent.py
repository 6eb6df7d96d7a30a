"""Answering with tools: a model may read files and search again before it answers.

All questions of a batch take their turns together. In a round the model is asked once per open
question, in Arrow batches; then all searches of the round are one batch search, all reads are one
join with the table of source lines, and their results join the conversations. So a round costs
the same few jobs for one question or for a million, and each round is written to the shared
folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.citations import MAX_LINES, rendered
from corvane.plans.answer import prompts
from corvane.plans.search import Index, SearchConfig, search
from corvane.session import stage

ROUNDS = 12

# The tools' names, and what they say where there is nothing to show.
READ, SEARCH = "read_file", "search_symbol"
NO_FILE, TOO_SHORT, NO_HIT = "Hata: dosya bulunamadı: ", " satır.", " için sonuç yok."

STATE = "query_id string, scope string, text string, messages string, made string, usage string, stop string, answer string, asked string"
CALL = "array<struct<n:int,tool:string,query:string,path:string,start:int,stop:int,most:int>>"


class ToolModel(Protocol):
    """Takes the conversation so far and answers or asks for tools.

    ``messages`` are dicts with ``role`` and ``content``. The result holds ``text``, ``calls`` (dicts
    with ``tool`` and ``input``; none ends the conversation), ``usage`` (token counts) and ``stop``.
    """

    def turn(self, messages: list[dict]) -> dict: ...


def _turns(model: ToolModel):
    def run(batches: Iterator):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                messages, made, usage = json.loads(r["messages"]), json.loads(r["made"]), json.loads(r["usage"])
                out = model.turn(messages)
                for k, v in (out.get("usage") or {}).items():
                    usage[k] = usage.get(k, 0) + int(v or 0)
                calls = out.get("calls") or []
                messages.append({"role": "assistant", "content": out.get("text") or "", "calls": calls})
                asked = []
                for n, c in enumerate(calls):
                    made.append({"tool": c["tool"], "input": c.get("input") or {}})
                    i = c.get("input") or {}
                    asked.append(
                        {"n": n, "tool": c["tool"], "query": i.get("query"), "path": i.get("path"), "start": i.get("start_line", 1), "stop": i.get("end_line", 0), "most": i.get("limit", 5)}
                    )
                r |= {"messages": json.dumps(messages), "made": json.dumps(made), "usage": json.dumps(usage), "stop": out.get("stop"), "answer": (out.get("text") or "").strip(), "asked": json.dumps(asked)}
                rows.append(r)
            yield type(pdf)(rows, columns=pdf.columns)

    return run


def searched(calls: DataFrame, index: Index, chunks: DataFrame, config: SearchConfig) -> DataFrame:
    """Q2: ``query_id n result`` of the searches among the calls: numbered hits, or that there is none."""
    calls = calls.filter(F.col("tool") == SEARCH)
    one = F.concat_ws("\x00", "query_id", F.col("n").cast("string"))
    blocks = chunks.select("ord", rendered(F.col("kind"), F.col("name"), F.col("location"), F.col("text"), F.col("start_line")).alias("block"))
    shown = None
    for most in sorted(r[0] for r in calls.select("most").distinct().collect()):
        part = calls.filter(F.col("most") == most).select(one.alias("query_id"), "scope", F.coalesce("query", F.lit("")).alias("text"))
        hits = search(part, index, SearchConfig(**{**config.__dict__, "k": max(1, most)})).select("query_id", "pos", "ord")
        shown = hits if shown is None else shown.unionAll(hits)
    out = calls.select("query_id", "n", "query", one.alias("key"))
    if shown is None:
        return out.select("query_id", "n", F.lit("").alias("result"))
    text = shown.join(blocks, "ord").groupBy(F.col("query_id").alias("key")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n\n").alias("hits")
    )
    nothing = F.concat(F.lit("'"), F.coalesce("query", F.lit("")), F.lit("'"), F.lit(NO_HIT))
    return out.join(text, "key", "left").select("query_id", "n", F.coalesce("hits", nothing).alias("result"))


def read(calls: DataFrame, lines: DataFrame) -> DataFrame:
    """``query_id n result`` of the reads among the calls, at most ``MAX_LINES`` numbered lines each.

    ``lines``: ``scope path line_no text`` of every file.
    """
    calls = calls.filter(F.col("tool") == READ).withColumn("path", F.coalesce("path", F.lit("")))
    wanted = calls.select("scope", "path").distinct()
    known = lines.join(wanted, ["scope", "path"], "left_semi")
    size = known.groupBy("scope", "path").agg(F.max("line_no").alias("total"))
    first = F.greatest(F.lit(1), F.coalesce("start", F.lit(1)))
    last = F.when(F.coalesce("stop", F.lit(0)) <= 0, F.col("total")).otherwise(F.least("stop", "total"))
    span = calls.join(size, ["scope", "path"], "left").withColumn("first", first).withColumn("last", F.least(last, first + MAX_LINES - 1))
    number = F.col("line_no").cast("string")
    row = F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), 5 - F.length(number))), number, F.lit(" | "), F.col("text"))
    body = span.join(known, ["scope", "path"]).filter("line_no between first and last").groupBy("query_id", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", row.alias("row")))), lambda x: x["row"]), "\n").alias("body")
    )
    num = lambda c: F.col(c).cast("string")
    more = F.when(
        F.col("last") < F.col("total"),
        F.concat(F.lit("\n... ("), (F.col("total") - F.col("last")).cast("string"), F.lit(" satır daha, "), "path", F.lit(":"), (F.col("last") + 1).cast("string"), F.lit(" ile devam)")),
    ).otherwise("")
    head = F.concat("path", F.lit(" ("), num("first"), F.lit("-"), num("last"), F.lit(" / "), num("total"), F.lit(" satır)\n"))
    result = (
        F.when(F.col("total").isNull(), F.concat(F.lit(NO_FILE), "path"))
        .when(F.col("first") > F.col("total"), F.concat(F.lit("Hata: "), "path", F.lit(" sadece "), num("total"), F.lit(TOO_SHORT)))
        .otherwise(F.concat(head, F.coalesce("body", F.lit("")), more))
    )
    return span.join(body, ["query_id", "n"], "left").select("query_id", "n", result.alias("result"))


def ask_with_tools(
    queries: DataFrame, index: Index, chunks: DataFrame, lines: DataFrame, model: ToolModel, config: SearchConfig | None = None, rounds: int = ROUNDS
) -> DataFrame:
    """Q1: ``answer_id scope text tool_calls usage stop`` for every query (``query_id scope text``).

    The model is asked until it calls no tool, at most ``rounds`` times; ``tool_calls`` and
    ``usage`` are JSON. What is left open after the last round has its last text as answer.
    """
    config = config or SearchConfig(k=8)
    queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "scope", "text")
    first = prompts(queries, search(queries, index, config), chunks)
    empty = F.lit("[]")
    talk = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))))
    state = queries.join(first, "query_id").select(
        "query_id", "scope", "text", talk.alias("messages"), empty.alias("made"), F.lit("{}").alias("usage"),
        F.lit(None).cast("string").alias("stop"), F.lit("").alias("answer"), empty.alias("asked"),
    )
    done = None
    for n in range(rounds):
        state = stage(state.mapInPandas(_turns(model), STATE), "turns")
        closed = state if n + 1 == rounds else state.filter("asked = '[]'")
        done = closed if done is None else done.unionAll(closed)
        state = state.filter("asked <> '[]'")
        if n + 1 == rounds or state.limit(1).count() == 0:
            break
        calls = state.select("query_id", "scope", F.explode(F.from_json("asked", CALL)).alias("c")).select("query_id", "scope", "c.*")
        calls = stage(calls, "calls")
        unknown = calls.filter(~F.col("tool").isin(READ, SEARCH)).select("query_id", "n", F.concat(F.lit("unknown tool: "), "tool").alias("result"))
        results = read(calls, lines).unionByName(searched(calls, index, chunks, config)).unionByName(unknown)
        told = results.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n", "result"))), lambda x: x["result"])).alias("told"))
        # both are JSON arrays: the results join the conversation as one message
        message = F.concat(F.lit(',{"role":"tool","content":'), F.col("told"), F.lit("}]"))
        state = state.join(told, "query_id").withColumn("messages", F.concat(F.expr("left(messages, length(messages) - 1)"), message)).drop("told")
        state = state.select(*[c.split()[0] for c in STATE.split(", ")])
    return done.select(
        F.col("query_id").alias("answer_id"), "scope", F.col("answer").alias("text"), F.col("made").alias("tool_calls"), "usage", "stop"
    )

