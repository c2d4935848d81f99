"""Ranking scores as column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import has_canonical_tag, has_preference_tag, lower_tags

#: Boosts by scope, tags of noisy rows, penalties with and without a lexical hit.
SCOPE_BOOST = {"global": 0.03, "project": 0.05, "session": 0.08}
NOISY_TAGS = ("captured", "transcript", "turn-log")
NOISY_IMPORTS = ("chatgpt-export", "codex-session", "claude-session")
LEXICAL_PENALTY, SEMANTIC_PENALTY = 0.08, 0.18


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays, moved to 0..1; 0 for empty arrays, unequal lengths and zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fits, F.when(norm > 0, unit((dot(a, b) / norm + 1) / 2)).otherwise(0.0)).otherwise(0.0)


def lexical(bm25: Column) -> Column:
    """0 without a hit; scores are negative, so any hit counts fully."""
    return F.when(bm25.isNull() | F.isnan(bm25), 0.0).when(bm25 <= 0, 1.0).otherwise(1 / (1 + bm25))


def recency(updated: Column, now: datetime) -> Column:
    days = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(updated)) / 86_400e6
    return F.when(updated.isNull(), 0.0).otherwise(F.exp(-F.greatest(F.lit(0.0), days) / 30.0))


def importance(c: Column) -> Column:
    return unit(F.coalesce(F.nanvl(c, F.lit(0.5)), F.lit(0.5)))


def boost(scope_type: Column) -> Column:
    out = F.lit(0.0)
    for name, value in SCOPE_BOOST.items():
        out = F.when(scope_type == name, value).otherwise(out)
    return out


def combined(semantic: Column, lexical: Column, importance: Column, recency: Column, scope_type: Column, embeddings: bool) -> Column:
    if embeddings:
        base = 0.5 * semantic + 0.35 * lexical + 0.1 * importance + 0.05 * recency
    else:
        base = 0.75 * lexical + 0.15 * importance + 0.1 * recency
    return unit(base + boost(scope_type))


def noisy(scope_type: Column, tags: Column, captured: Column, key: Column) -> Column:
    """Global rows that look like captured dialogue or imports, and are no preferences."""
    lowered = lower_tags(tags)
    has = lambda names: F.arrays_overlap(lowered, F.array(*map(F.lit, names)))
    is_captured = F.coalesce(captured, F.lit(False))
    clean = (scope_type != "global") | has_canonical_tag(tags) | has_preference_tag(tags) | key.isNotNull()
    marked = is_captured | has(NOISY_TAGS) | (F.array_contains(lowered, "import") & has(NOISY_IMPORTS))
    return ~clean & marked


def penalty(noisy: Column, lexical: Column) -> Column:
    return F.when(~noisy, 0.0).when(lexical > 0, LEXICAL_PENALTY).otherwise(SEMANTIC_PENALTY)
