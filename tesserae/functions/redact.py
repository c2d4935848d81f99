"""Redaction of secrets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.bind import let

#: Secret shapes, in the order in which they are replaced.
PATTERNS = (
    ("openai_key", r"sk-[A-Za-z0-9]{20,}"),
    ("aws_access_key", r"AKIA[0-9A-Z]{16}"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("google_api_key", r"AIza[0-9A-Za-z\-_]{35}"),
    ("private_key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
)
BEARER = r"(?i)(Bearer\s+)[A-Za-z0-9._\-]{20,}"
LONG_TOKEN, MIN_BITS = r"([A-Za-z0-9_\-./+=]{24,})", 3.8


def entropy(c: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    n = F.length(c)
    share = lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(c, "")), F.lit(0.0), lambda acc, x: acc - F.when(x == "", 0.0).otherwise(share(x) * F.log2(share(x))))


def _suspect(token: Column) -> Column:
    return token.rlike("[A-Z]") & token.rlike("[a-z]") & token.rlike("[0-9]") & (entropy(token) >= MIN_BITS)


#: What a text must hold for a pattern to be tried at all.
HINTS = {"openai_key": "sk-", "aws_access_key": "AKIA", "github_token": "gh", "google_api_key": "AIza", "private_key_block": "-----BEGIN "}


def _replaced(state: Column, name: str, hint: Column, pattern: str, by: str) -> Column:
    """The state struct(text, found) after one pattern; a replacement is never equal to what it replaces."""
    old = state["text"]
    new = F.when(hint, F.regexp_replace(old, pattern, by)).otherwise(old)
    return let(new, lambda t: F.struct(t.alias("text"), F.when(t != old, F.concat(state["found"], F.array(F.lit(name)))).otherwise(state["found"]).alias("found")))


def redacted(c: Column) -> Column:
    """struct(text, redacted, findings): secret shapes, bearer tokens, then long mixed tokens of high entropy.

    Each stage is evaluated once, and its pattern only where the text holds the pattern's fixed part.
    """
    state = F.struct(c.alias("text"), F.array().cast("array<string>").alias("found"))
    stages = [(n, lambda t, n=n: t.contains(HINTS[n]), p, f"[REDACTED_{n.upper()}]") for n, p in PATTERNS]
    stages.append(("bearer_token", lambda t: F.lower(t).contains("bearer"), BEARER, "$1[REDACTED_BEARER_TOKEN]"))

    def after(k: int, state: Column) -> Column:
        if k < len(stages):
            name, hint, pattern, by = stages[k]
            return let(_replaced(state, name, hint(state["text"]), pattern, by), lambda s: after(k + 1, s))
        suspects = F.filter(F.regexp_extract_all(state["text"], F.lit(LONG_TOKEN), F.lit(1)), _suspect)
        return let(suspects, lambda x: finished(state, x))

    def finished(state: Column, suspects: Column) -> Column:
        clean = F.aggregate(suspects, state["text"], lambda acc, s: F.replace(acc, s, F.lit("[REDACTED_SECRET]")))
        every = F.when(F.size(suspects) > 0, F.concat(state["found"], F.array(F.lit("high_entropy_token")))).otherwise(state["found"])
        return F.struct(clean.alias("text"), (F.size(every) > 0).alias("redacted"), every.alias("findings"))

    return let(state, lambda s: after(0, s))
