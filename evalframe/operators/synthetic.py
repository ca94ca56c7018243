"""Labelled examples from templates: each row's number decides its labels, wording, time and rewriting."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.routing_score import ACTION_OF, TEAM_OF
from ..functions.text import hash_pick

#: Seconds of a year, over which a stride that shares no factor with it spreads times without repeats.
SPAN = 365 * 24 * 3600


def pick(index: Column, values: list[str]) -> Column:
    return F.when(index.isNotNull(), F.get(F.array(*map(F.lit, values)), index.cast("int")))


def expand_templates(
    df: DataFrame, index: str, templates: dict[str, list[str]], scopes: dict[str, str], rewrites: dict[str, str] | None = None, security: tuple[str, int, str] | None = None,
    seed: int = 0, start: str = "2024-01-01T00:00:00Z", stride: int = 7919,
) -> DataFrame:
    """df plus issue_type, affected_scope, routing_team, recommended_action, robustness, body and submitted_at.

    Row i has issue i mod the number of issues and scope (i div that) mod the number of scopes. Its wording is one of the
    issue's templates by a hash of seed and i, with {scope} replaced by the scope's phrase. security (issue, n, text):
    every n-th row of that issue says text and escalates. rewrites maps a robustness category to a text in which {body}
    stands for the wording; categories take turns. Times run from start in strides of a year's seconds, without repeats
    for a year's worth of rows. A null or negative index gives null columns.
    """
    if gcd(stride, SPAN) != 1:
        raise ValueError("stride must share no factor with a year's seconds")
    i, issues, names = F.when(F.col(index) >= 0, F.col(index)), list(templates), list(scopes)
    issue, scope = pick(i % len(issues), issues), pick(F.floor(i / len(issues)) % len(names), names)
    wording = F.lit(None).cast("string")
    for label, texts in templates.items():
        wording = F.when(issue == label, pick(hash_pick(len(texts), F.lit(str(seed)), F.lit(label), i.cast("string")), texts)).otherwise(wording)
    body = F.replace(wording, F.lit("{scope}"), pick(F.floor(i / len(issues)) % len(names), list(scopes.values())))
    of = lambda table: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), issue)
    action = of(ACTION_OF)
    if security:
        is_security = (issue == security[0]) & (F.floor(i / len(issues)) % security[1] == 0)
        body, action = F.when(is_security, security[2]).otherwise(body), F.when(is_security, "ESCALATE_SECURITY_REVIEW").otherwise(action)
    robust = F.lit(None).cast("string")
    if rewrites:
        robust = pick(i % len(rewrites), list(rewrites))
        body = F.replace(pick(i % len(rewrites), list(rewrites.values())), F.lit("{body}"), body)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + (i * stride) % SPAN)
    return df.withColumns({"issue_type": issue, "affected_scope": scope, "routing_team": of(TEAM_OF), "recommended_action": action, "robustness": robust, "body": body, "submitted_at": at})
