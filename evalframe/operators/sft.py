"""Supervised conversations: response-only token masks, their audit, and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dataset import prefix_digest
from .numbering import numbered

#: The label of a token that is not learned from.
IGNORE = -100


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, messages) in turn order, for conversations that end with the assistant."""
    out = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content")))).alias("messages"))
    return out.where(F.element_at("messages", -1)["role"] == "assistant")


def render(messages: Column) -> tuple[Column, Column]:
    """(prompt, response): all turns but the last as role-marked lines, and the last turn's text."""
    before = F.slice(messages, 1, F.size(messages) - 1)
    prompt = F.concat(F.array_join(F.transform(before, lambda m: F.concat(F.lit("<"), m["role"], F.lit("> "), m["content"])), "\n"), F.lit("\n<assistant> "))
    return prompt, F.element_at(messages, -1)["content"]


def load_prompt(text: str, version: str, placeholders: tuple[str, str] = ("{ticket_json}", "{schema_json}"), markers: tuple[str, str] = ("\nSYSTEM:\n", "\nUSER:\n")) -> tuple[str, str]:
    """(system, user template) of a prompt file: a version line, then a system and a user part, each placeholder once in the latter."""
    head, _, rest = text.partition(markers[0])
    system, found, template = rest.partition(markers[1])
    if not found or head.strip() != f"version: {version}":
        raise ValueError(f"no prompt of version {version}")
    if any(template.count(p) != 1 for p in placeholders):
        raise ValueError("each placeholder must stand once in the user part")
    return system.strip(), template.strip()


def chat(system: str, template: str, record: Column, schema: str, answer: Column | None = None, placeholders: tuple[str, str] = ("{ticket_json}", "{schema_json}")) -> Column:
    """Messages (role, content): trusted instructions, then the untrusted record (canonical JSON) and the schema in their template.

    answer, a record's canonical JSON, is the assistant's turn of a supervised example. The template is split at its
    placeholders first, so text of the record that looks like a placeholder stays as it is.
    """
    before, after = template.split(placeholders[0])
    if placeholders[1] in before:
        parts = [*map(F.lit, (before.replace(placeholders[1], schema),)), record, F.lit(after)]
    else:
        parts = [F.lit(before), record, F.lit(after.replace(placeholders[1], schema))]
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = [turn("system", F.lit(system)), turn("user", F.concat(*parts))]
    return F.array(*turns, *([turn("assistant", answer)] if answer is not None else []))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def response_only(df: DataFrame, prompt: str, response: str, max_tokens: int) -> DataFrame:
    """df plus tokens, labels (IGNORE before the response), supervised_tokens, was_truncated and lost_response.

    Tokens are words here; a user's tokenizer takes the same place with an array column. Ids are 31-bit word hashes.
    A sequence whose response is cut off whole is marked lost, which training must refuse.
    """
    ids = lambda c: F.transform(words(c), lambda w: F.pmod(F.xxhash64(w), F.lit(2147483647)).cast("int"))
    out = df.withColumns({"__p": ids(F.col(prompt)), "__r": ids(F.col(response))})
    whole = F.concat("__p", "__r")
    out = out.withColumns({"tokens": F.slice(whole, 1, max_tokens), "was_truncated": F.size(whole) > max_tokens, "boundary": F.size("__p")})
    out = out.withColumn("labels", F.transform("tokens", lambda t, i: F.when(i < F.col("boundary"), F.lit(IGNORE)).otherwise(t)))
    learned = F.size(F.filter("labels", lambda x: x != IGNORE))
    return out.withColumns({"supervised_tokens": learned, "lost_response": (learned == 0) & (F.size("__r") > 0)}).drop("__p", "__r")


def audit_masks(df: DataFrame, prompt: str, response: str) -> DataFrame:
    """(rows, bad_rows) by a second way to the boundary: labels are ignored exactly before the prompt's word count."""
    n = F.size(words(F.col(prompt)))
    ok = F.forall(F.transform("labels", lambda x, i: (x == IGNORE) == (i < n)), lambda x: x) & (F.size("labels") == F.size("tokens"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~ok).alias("bad_rows"), F.count_if("was_truncated").alias("truncated"), F.sum("supervised_tokens").alias("supervised_tokens"))


def row_digests(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(id_col, F.sha2(F.to_json(F.struct("tokens", "labels")), 256).alias("row_sha256"))


def corpus_digest(df: DataFrame, id_col: str) -> DataFrame:
    """(keys, digest): a digest of digests over row_digests, whatever the order of rows."""
    return prefix_digest(row_digests(df, id_col), "row_sha256")


def pad_batches(df: DataFrame, order_col: str, batch_size: int, pad_id: int, multiple: int = 8, groups: str | None = None) -> DataFrame:
    """Right-pad tokens and labels to their batch's longest, rounded up to a multiple.

    Batches are consecutive rows by order_col, within groups (a shard of the corpus) if given. Rows are numbered over
    ranges (numbering.numbered), so neither a table nor a group passes one task; only a batch does. order_col should tell
    rows apart.
    """
    by = [groups] if groups else []
    out = numbered(df, [order_col], "__ef_place", groups)
    out = out.withColumn("batch", F.floor(F.col("__ef_place") / batch_size).cast("long")).drop("__ef_place")
    longest = F.max(F.size("tokens")).over(Window.partitionBy(*by, "batch"))
    out = out.withColumn("width", (F.ceil(longest / multiple) * multiple).cast("int"))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("width") - F.size(c)))
    return out.withColumns({"input_ids": fill("tokens", pad_id), "padded_labels": fill("labels", IGNORE), "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size("tokens")), F.array_repeat(F.lit(0), F.col("width") - F.size("tokens")))})
