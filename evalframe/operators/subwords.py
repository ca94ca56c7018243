"""Supervised token masks on a subword tokenizer: ids with character offsets, response-only labels, and their audit.

The tokenizer is a byte-level BPE file of the tokenizers library, a parameter. Its split rule starts a new piece at every
single space between two other characters, so a long text is cut there into stretches that are encoded one after the other
with the same ids as in one go; a task holds the encodings of about one stretch, whatever the length of a text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sft import IGNORE

#: Where a text may be cut, and characters after which the next such place is taken.
CUT, STRETCH = re.compile(r"(?<=\S) (?=\S)"), 1 << 17
ENCODED = "tokens array<struct<id:int,start:int,end:int>>, begin int"


@lru_cache(maxsize=2)
def _tokenizer(rules: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(rules)
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    return made


def stretches(text: str, size: int = STRETCH) -> Iterator[tuple[int, str]]:
    """(start, part) of a text, cut at the first allowed place after every size characters."""
    start = 0
    while start < len(text):
        found = CUT.search(text, start + size)
        end = found.start() if found else len(text)
        yield start, text[start:end]
        start = end


def _encoded(prompts: pa.Array, responses: pa.Array, rules: str) -> pa.Array:
    tokenizer, parts, ends, begins = _tokenizer(rules), [np.zeros((0, 3), np.int32)], [0], []
    for prompt, response in zip(prompts, responses, strict=True):
        before, held = prompt.as_py() or "", 0
        begins.append(len(before))
        for at, part in stretches(before + (response.as_py() or "")):
            e = tokenizer.encode(part, add_special_tokens=False)
            if len(e.ids):
                parts.append(np.column_stack([np.array(e.ids, np.int32), np.array(e.offsets, np.int32) + at]).astype(np.int32))
                held += len(e.ids)
        ends.append(ends[-1] + held)
    table = np.concatenate(parts)
    rows = pa.StructArray.from_arrays([pa.array(table[:, n]) for n in range(3)], names=["id", "start", "end"])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), pa.array(begins, pa.int32())], names=["tokens", "begin"])


def subword_tokens(prompt: Column, response: Column, rules: str) -> Column:
    """(tokens, begin) of prompt and response as one text: ids with the code points (start, end) that they cover, and the prompt's length.

    Null parts are empty; an empty text has no tokens. rules: the tokenizer file's text. Tokens that share a character, as
    the bytes of a rare one do, carry the same place.
    """

    def run(prompts: pa.Array, responses: pa.Array) -> pa.Array:
        return _encoded(prompts, responses, rules)

    return F.arrow_udf(run, ENCODED)(prompt, response)


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once; inside a lambda, Spark would compute an outer expression for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def read_rules(path: str) -> str:
    """The tokenizer file, a few MB; it goes to tasks with their code, so executors need no copy of it."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def response_only(df: DataFrame, prompt: str, response: str, rules: str, max_tokens: int | None = None) -> DataFrame:
    """df plus tokens, offsets, labels, boundary, supervised_tokens, was_truncated and lost_response.

    Prompt and response are encoded as one sequence. Labels are IGNORE up to the first token that reaches into the
    response; a token over both is learned. Without max_tokens nothing is cut; a response that is cut off whole is lost,
    which training must refuse. Null parts are empty.
    """
    out = df.withColumn("__ef", subword_tokens(F.col(prompt), F.col(response), rules))
    every, begin = F.col("__ef.tokens"), F.col("__ef.begin")
    kept = every if max_tokens is None else F.slice(every, 1, max_tokens)
    learned = lambda t: t["end"] > begin
    out = out.withColumns({
        "tokens": F.transform(kept, lambda t: t["id"]),
        "offsets": F.transform(kept, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))),
        "labels": F.transform(kept, lambda t: F.when(learned(t), t["id"]).otherwise(F.lit(IGNORE))),
        "boundary": F.size(F.filter(every, lambda t: ~learned(t))),
        "supervised_tokens": F.size(F.filter(kept, learned)),
        "was_truncated": F.size(kept) < F.size(every),
    })
    return out.withColumn("lost_response", (F.col("supervised_tokens") == 0) & (F.coalesce(F.col(response), F.lit("")) != "")).drop("__ef")


def learned_characters(df: DataFrame, prompt: str) -> DataFrame:
    """df plus learned_chars, the response's characters under learned tokens, and leaked_tokens, learned ones that end before it."""
    n = F.char_length(F.coalesce(F.col(prompt), F.lit("")))
    spans = F.transform(F.filter(F.arrays_zip("offsets", "labels"), lambda x: x["labels"] != IGNORE), lambda x: x["offsets"])

    def measured(x):
        first, last = F.array_min(x["spans"])["start"], F.array_max(F.transform(x["spans"], lambda o: o["end"]))
        reached = F.when(F.size(x["spans"]) > 0, F.greatest(last - F.greatest(first, x["n"]), F.lit(0))).otherwise(F.lit(0))
        return F.struct(reached.alias("learned"), F.size(F.filter(x["spans"], lambda o: o["end"] <= x["n"])).alias("leaked"))

    out = df.withColumn("__ef", _bound(F.struct(spans.alias("spans"), n.alias("n")), measured))
    return out.withColumns({"learned_chars": F.col("__ef.learned"), "leaked_tokens": F.col("__ef.leaked")}).drop("__ef")


def audit(df: DataFrame, prompt: str, response: str) -> DataFrame:
    """(rows, bad_rows, truncated, supervised_tokens) by character offsets alone, not by the mask's own boundary.

    A good row has as many labels and offsets as tokens, offsets in order that cover the kept text without a gap, and
    one run of learned labels, equal to their tokens, that starts with the token over the response's first character and
    ends with the sequence.
    """
    n = F.char_length(F.coalesce(F.col(prompt), F.lit("")))
    whole = n + F.char_length(F.coalesce(F.col(response), F.lit("")))

    def good(x):
        n, start, size = x["n"], x["start"], F.size(x["labels"])
        tail = lambda c: F.slice(x[c], F.greatest(start, F.lit(1)), F.size(x[c]))
        reach = F.when(size > 0, F.element_at(x["offsets"], -1)["end"]).otherwise(F.lit(0))
        step = lambda a, o: F.struct(o["end"].alias("end"), (a["ok"] & (o["start"] <= a["end"]) & (o["end"] >= a["end"])).alias("ok"))
        gapless = F.aggregate(x["offsets"], F.struct(F.lit(0).alias("end"), F.lit(True).alias("ok")), step)["ok"]
        over = F.try_element_at(x["offsets"], F.when(start > 0, start))
        before = F.try_element_at(x["offsets"], F.when(start > 1, start - 1))
        right_place = F.when(start == 0, reach <= n).otherwise((over["end"] > n) & (over["start"] <= n) & (F.coalesce(before["end"], F.lit(0)) <= n))
        right_tail = (start == 0) | ((tail("labels") == tail("tokens")) & ~F.array_contains(tail("labels"), IGNORE))
        complete = x["cut"] | (reach == x["whole"])
        return (size == F.size(x["tokens"])) & (size == F.size(x["offsets"])) & gapless & right_place & right_tail & complete

    row = F.struct("tokens", "labels", "offsets", F.col("was_truncated").alias("cut"), n.alias("n"), whole.alias("whole"))
    first = lambda x: F.array_position(F.transform(x["labels"], lambda y: y != IGNORE), True).cast("int")
    ok = _bound(row, lambda x: _bound(F.struct(*(x[c].alias(c) for c in ("tokens", "labels", "offsets", "cut", "n", "whole")), first(x).alias("start")), good))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad_rows"), F.count_if("was_truncated").alias("truncated"), F.sum("supervised_tokens").alias("supervised_tokens"))
