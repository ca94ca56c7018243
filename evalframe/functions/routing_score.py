"""The rule labeller, the ambiguity and routing scores, and route decisions, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import find_hints, holds_any

#: Fixed values that results depend on: hints in order of precedence, marker phrases, weights and deductions.
ISSUE_HINTS = {
    "MFA_FAILURE": ["mfa", "multi-factor", "multifactor", "authenticator", "verification code", "push denied"],
    "ACCOUNT_LOCKED_OR_DISABLED": ["account locked", "locked out", "account disabled", "too many attempts"],
    "ACCESS_DENIED_AFTER_LOGIN": ["access denied", "forbidden", "permission denied", "missing entitlement"],
    "PROVISIONING_OR_SYNC_FAILURE": ["provision", "scim", "directory sync", "group sync", "new hire"],
    "SSO_AUTHENTICATION_FAILURE": ["sso", "single sign-on", "saml", "identity provider", "redirect loop", "okta"],
}
SCOPE_HINTS = {
    "ORGANIZATION": ["organization-wide", "company-wide", "all employees", "all users", "everyone"],
    "DEPARTMENT": ["our department", "entire department", "department-wide"],
    "MULTIPLE_USERS": ["multiple users", "several users", "our team", "teammates", "many users"],
    "SINGLE_USER": ["my account", "i cannot", "i can't", "for me", "one user", "single user"],
}
SECURITY_HINTS = ["compromised", "phishing", "stolen token", "unauthorized login"]
ACTION_OF = {
    "MFA_FAILURE": "INVESTIGATE_MFA_CONFIGURATION", "ACCOUNT_LOCKED_OR_DISABLED": "RESET_OR_UNLOCK_ACCOUNT", "ACCESS_DENIED_AFTER_LOGIN": "REVIEW_ACCESS_ENTITLEMENTS",
    "PROVISIONING_OR_SYNC_FAILURE": "INVESTIGATE_PROVISIONING_SYNC", "SSO_AUTHENTICATION_FAILURE": "INVESTIGATE_IDP_OR_SSO_CONFIGURATION", "OTHER_IAM": "COLLECT_MORE_INFORMATION",
}
TEAM_OF = {
    "MFA_FAILURE": "IDENTITY_PLATFORM", "ACCOUNT_LOCKED_OR_DISABLED": "SERVICE_DESK", "ACCESS_DENIED_AFTER_LOGIN": "ACCESS_MANAGEMENT",
    "PROVISIONING_OR_SYNC_FAILURE": "IDENTITY_PLATFORM", "SSO_AUTHENTICATION_FAILURE": "IDENTITY_PLATFORM", "OTHER_IAM": "SERVICE_DESK",
}
INJECTION_MARKERS = ["ignore previous", "ignore all instructions", "system prompt", "developer message", "classify this as", "return p1"]
AMBIGUOUS_MARKERS = ["not sure", "something is wrong", "doesn't work", "does not work", "please help", "no other details", "unknown error"]
TOPIC_HINTS = {
    "sso": ["sso", "okta", "single sign-on", "redirect loop"], "mfa": ["mfa", "authenticator", "verification code", "push"],
    "locked": ["locked", "disabled account", "too many attempts"], "access": ["access denied", "permission", "forbidden", "entitlement"],
    "provisioning": ["provision", "sync", "new hire", "group membership"],
}
WEIGHTS = {"structural": 0.10, "evidence_grounding": 0.25, "ambiguity": 0.25, "self_reported": 0.15, "label_logprob": 0.15, "sample_agreement": 0.10}


def _first(rules: dict[str, Column], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for label, cond in reversed(rules.items()):
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def rule_label(subject: Column, body: Column) -> dict[str, Column]:
    """Labels of a ticket by ordered rules: the columns of a prediction."""
    text = F.concat_ws("\n", subject, body)
    low = F.lower(text)
    issue = _first({k: holds_any(low, h) for k, h in ISSUE_HINTS.items()}, "OTHER_IAM")
    scope = _first({k: holds_any(low, h) for k, h in SCOPE_HINTS.items()}, "UNKNOWN")
    security = holds_any(low, SECURITY_HINTS)
    none = F.array().cast("array<string>")
    chosen = lambda key, hints: F.coalesce(*(F.when(key == k, find_hints(text, h)) for k, h in hints.items()), none)
    found = F.slice(F.array_distinct(F.concat(chosen(issue, ISSUE_HINTS), chosen(scope, SCOPE_HINTS), find_hints(text, SECURITY_HINTS))), 1, 5)
    sure = F.when(issue != "OTHER_IAM", 0.82).otherwise(0.52) - F.when(scope == "UNKNOWN", 0.12).otherwise(0.0)
    return {
        "issue_type": issue,
        "severity": F.when(scope == "ORGANIZATION", "P1").when(security | scope.isin("DEPARTMENT", "MULTIPLE_USERS"), "P2").when(scope == "SINGLE_USER", "P3").otherwise("P4"),
        "routing_team": _lookup(issue, TEAM_OF),
        "affected_scope": scope,
        "recommended_action": F.when(security, "ESCALATE_SECURITY_REVIEW").otherwise(_lookup(issue, ACTION_OF)),
        "evidence": F.when(F.size(found) > 0, found).otherwise(F.array(subject)),
        "confidence": F.round(F.greatest(F.lit(0.0), F.when(security, F.least(sure, F.lit(0.68))).otherwise(sure)), 2),
    }


def ambiguity(corpus: Column, detail: Column, issue: Column, scope: Column) -> tuple[Column, Column]:
    """(score, reasons) of normalised texts: corpus is all of a ticket, detail its subject and body."""
    topics = sum((holds_any(corpus, h).cast("int") for h in TOPIC_HINTS.values()), F.lit(0))
    rules = [
        ("insufficient_detail", 0.30, F.length(detail) < 45), ("ambiguous_language", 0.25, holds_any(corpus, AMBIGUOUS_MARKERS)),
        ("prompt_injection_marker", 0.45, holds_any(corpus, INJECTION_MARKERS)), ("conflicting_issue_signals", 0.20, topics >= 3),
        ("other_iam", 0.15, issue == "OTHER_IAM"), ("unknown_scope", 0.15, scope == "UNKNOWN"),
    ]
    score = F.lit(1.0)
    for _, less, cond in rules:
        score = score - F.when(cond, less).otherwise(0.0)
    return F.greatest(F.lit(0.0), score), F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, _, cond in rules)))


def routing_score(components: dict[str, Column], valid: Column) -> tuple[Column, Column]:
    """(score, hard_failure): the weighted geometric mean of the components that are there, at most the ambiguity score.

    Invalid output or ungrounded evidence is a hard failure with score 0.
    """
    hard = ~valid | (components["evidence_grounding"] < 1.0)
    logs, weights = F.lit(0.0), F.lit(0.0)
    for name, value in components.items():
        logs = logs + F.coalesce(F.lit(WEIGHTS[name]) * F.ln(F.greatest(value, F.lit(1e-6))), F.lit(0.0))
        weights = weights + F.when(value.isNotNull(), WEIGHTS[name]).otherwise(0.0)
    score = F.least(F.exp(logs / weights), components["ambiguity"])
    return F.when(hard, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)), hard


def route(usable: Column, score: Column, threshold: Column | float, frontier_there: Column | None = None) -> tuple[Column, Column]:
    """(escalate, reason). A missing score escalates; a missing large model never falls back to the small answer."""
    threshold = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    low = score.isNull() | (score < threshold)
    escalate = F.coalesce(~usable, F.lit(True)) | low
    reason = F.when(F.coalesce(~usable, F.lit(True)), "small_model_error").when(low, "low_confidence").otherwise("small_confident")
    if frontier_there is not None:
        reason = F.when(escalate & ~frontier_there, "frontier_unavailable").otherwise(reason)
    return escalate, reason
