"""Conversations: validation, prompts, model replies and turns."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import is_blank

# Roles, reply types and texts of messages.
AGENT_ROLES = ("user", "assistant")
API_ROLES = ("user", "assistant", "system")
REPLY_ROLES = ("assistant", "system")
TOOL = "retrieve_regulations"
NO_EVIDENCE = "No matching regulations found."
PHASES = ("initial decision", "answer after regulation retrieval")


def _violations(turns: DataFrame, roles: tuple[str, ...], last: str, last_name: str) -> DataFrame:
    per = turns.groupBy("conv_id").agg(
        F.count("*").alias("turns"),
        F.max(F.when(~F.coalesce(F.col("role").isin(*roles), F.lit(False)), 1).otherwise(0)).alias("bad_role"),
        F.max(F.when(is_blank(F.col("text")), 1).otherwise(0)).alias("blank"),
        F.max_by("role", "turn").alias("last_role"),
    )
    rules = F.array(F.when(F.col("bad_role") == 1, "role not allowed"), F.when(F.col("blank") == 1, "blank content"), F.when(~F.coalesce(F.col("last_role") == last, F.lit(False)), last_name))
    return per.select("conv_id", "turns", F.array_join(F.array_compact(rules), "; ").alias("violations"))


def conversation_violations(turns: DataFrame, roles: tuple[str, ...] = API_ROLES) -> DataFrame:
    """conv_id, turns, violations (empty if none): roles, blank content, and the last turn must be the user's."""
    return _violations(turns, roles, "user", "last turn is not the user's")


def response_violations(turns: DataFrame) -> DataFrame:
    """The same for reply lists: assistant and system only, the last one the assistant's."""
    return _violations(turns, REPLY_ROLES, "assistant", "last message is not the assistant's")


def agent_turns(turns: DataFrame) -> DataFrame:
    """Turns that the model is shown: display-only ones go, the order stays."""
    return turns.where(F.col("role").isin(*AGENT_ROLES))


def prompt_messages(turns: DataFrame, system: str) -> DataFrame:
    """conv_id, n_messages, prompt: a JSON list with the system message first, then the history in order."""
    history = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    head = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return turns.groupBy("conv_id").agg(F.concat(head, history).alias("m")).select("conv_id", F.size("m").alias("n_messages"), F.to_json("m").alias("prompt"))


REPLY = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "content", "query", "error")])


def _blank(value: object) -> bool:
    return not isinstance(value, str) or not value.strip()


def classify_reply(output: object, phase: str) -> tuple[str, str | None, str | None, str | None]:
    """kind, content, query and error of one model reply. Strict JSON, as the model was told to give."""
    bad = lambda kind, why: (kind, None, None, f"{why} during {phase}.")
    if not isinstance(output, str):
        return bad("non_text", "Model returned non-text content")
    if not output.strip():
        return bad("empty", "Model returned empty content")
    try:
        reply = json.loads(output)
    except json.JSONDecodeError as e:
        kind, what = ("code_fence", "a Markdown code fence") if output.lstrip().startswith("```") else ("invalid_json", "invalid JSON")
        return kind, None, None, f"Model returned {what} during {phase} ({len(output)} characters; parse error at character {e.pos})."
    if not isinstance(reply, dict):
        return bad("non_object", "Model returned a non-object JSON value")
    if reply.get("type") == "answer":
        if _blank(reply.get("content")):
            return bad("empty_answer", "Model returned empty or non-text answer content")
        return "answer", reply["content"], None, None
    if phase != PHASES[0]:
        return "not_an_answer", None, None, "Expected an answer after regulation retrieval."
    if reply.get("type") != "tool_call":
        return bad("unknown_type", "Unknown Agent response type")
    if reply.get("tool") != TOOL:
        return bad("unknown_tool", "Unknown Agent tool")
    arguments = reply.get("arguments")
    if not isinstance(arguments, dict) or _blank(arguments.get("text")):
        return bad("bad_search_text", "Invalid regulation search text")
    return "tool_call", None, arguments["text"], None


def _classified(output: pd.Series, phase: pd.Series) -> pd.DataFrame:
    rows = [classify_reply(o, p) for o, p in zip(output, phase, strict=True)]
    return pd.DataFrame(rows, columns=REPLY.names)


def reply_classes(replies: DataFrame, phase: str = PHASES[0]) -> DataFrame:
    """Add `reply` (kind, content, query, error); the raw output stays in its column.

    Declared as not deterministic, so that a filter on `reply` doesn't make Spark classify a second time, in a second Python
    worker of the same task."""
    classified = F.pandas_udf(_classified, REPLY).asNondeterministic()
    return replies.withColumn("reply", classified(F.col("output"), F.lit(phase)))


def evidence_text(query: Column, texts: Column) -> Column:
    body = F.when(F.size(F.coalesce(texts, F.array().cast("array<string>"))) == 0, NO_EVIDENCE).otherwise(F.array_join(texts, "\n\n"))
    return F.concat(F.lit("Regulation search: "), query, F.lit("\nSearch results:\n"), body)


def retrieve_texts(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, texts: passages of each query, most relevant first. hits: query_id, rank, id; passages: id, text."""
    found = hits.select("query_id", "rank", "id").join(passages.select("id", "text"), "id")
    return found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))


def evidence_messages(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id and the evidence message of every query, also of those without hits."""
    return queries.select("query_id", "query").join(texts, "query_id", "left").select("query_id", evidence_text(F.col("query"), F.col("texts")).alias("evidence"))


def turn_messages(first: DataFrame, evidence: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Messages of each turn: a direct answer, or evidence and an answer; none after an error.

    first, second: the keys and reply of both phases; evidence: the keys and evidence. Gives the keys, turn_order, role, text."""
    on = list(keys)
    d = first.select(*on, F.col("reply").alias("a")).join(evidence.select(*on, "evidence"), on, "left").join(second.select(*on, F.col("reply").alias("b")), on, "left")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    direct = F.array(message("assistant", F.col("a.content")))
    searched = F.array(message("system", F.col("evidence")), message("assistant", F.col("b.content")))
    messages = F.when(F.col("a.kind") == "answer", direct).when((F.col("a.kind") == "tool_call") & (F.col("b.kind") == "answer"), searched)
    return d.select(*on, F.posexplode(messages).alias("turn_order", "m")).select(*on, "turn_order", "m.role", "m.text")


def run_conversations(questions: DataFrame, replies: DataFrame, assistant_only: bool = False) -> DataFrame:
    """Whole conversations, turn by turn, in one ordered pass over each: conv_id, position, asked_turn, role, text, n_shown.

    questions: conv_id, turn, text; replies: conv_id, turn, turn_order, role, text. A turn with replies puts its question and
    these at the end of the history; a turn without any leaves it as it was. position: gapless from 0. n_shown: how many
    messages of the history, the question included, the model saw when the message's turn began (those of agent roles only).
    assistant_only: the terminal's variant, which keeps no evidence."""
    added = replies.where("role = 'assistant'") if assistant_only else replies
    answered = replies.select("conv_id", "turn").distinct()
    asked = questions.join(answered, ["conv_id", "turn"], "left_semi").select("conv_id", "turn", F.lit(-1).alias("turn_order"), F.lit("user").alias("role"), "text")
    history = asked.unionByName(added.select("conv_id", "turn", "turn_order", "role", "text"))
    so_far = W.partitionBy("conv_id").orderBy("turn", "turn_order")
    shown = F.count(F.when(F.col("role").isin(*AGENT_ROLES), 1)).over(so_far.rowsBetween(W.unboundedPreceding, 0))
    history = history.withColumn("position", (F.row_number().over(so_far) - 1).cast("long")).withColumn("_shown", F.when(F.col("turn_order") == -1, shown))
    n_shown = F.last("_shown", ignorenulls=True).over(so_far.rowsBetween(W.unboundedPreceding, 0))
    return history.select("conv_id", "position", F.col("turn").alias("asked_turn"), "role", "text", n_shown.alias("n_shown"))


def appended_history(turns: DataFrame, question: DataFrame, replies: DataFrame, assistant_only: bool = False) -> DataFrame:
    """History after the turn: where there are replies, the new question and these go to the end; elsewhere nothing changes.

    question: conv_id, text; replies: conv_id, turn_order, role, text. assistant_only: the terminal's variant."""
    added = replies.where("role = 'assistant'") if assistant_only else replies
    asked = question.join(replies.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", F.lit(-1).alias("turn_order"), F.lit("user").alias("role"), "text")
    new = asked.unionByName(added.select("conv_id", "turn_order", "role", "text"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("turn_order"))
    placed = new.join(last, "conv_id", "left").select("conv_id", (F.coalesce("last", F.lit(-1)) + number).alias("turn"), "role", "text")
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(placed.withColumn("turn", F.col("turn").cast("long")))
