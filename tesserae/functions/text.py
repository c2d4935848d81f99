"""Text functions as column expressions: keys, hashes, facts, tokens, snippets."""

from __future__ import annotations

import re
import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(c: str) -> str:
    """The letter without its accents, by Unicode's decomposition; empty if it is no accented letter of a-z."""
    first, *marks = unicodedata.normalize("NFD", c)
    return first if first in string.ascii_lowercase and marks and all(unicodedata.combining(m) for m in marks) else ""


#: Lower-case Latin letters with accents, and without.
ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x2000)) if _plain(c))
PLAIN = "".join(map(_plain, ACCENTED))
#: Words that make a sentence a likely fact.
FACT_WORDS = "prefer|always|never|must|should|avoid|remember|deadline|owner|path|repo|project|session"
#: Words that ask for the past, and for preferences.
TEMPORAL = r"(?i)\b(used to be|what was|formerly|previous(ly)?|prior|earlier|history)\b"
PREFERENCE = r"(?i)\b(favorite|preference|prefer(red|ring)?|leaning\s+toward)\b"
MAX_TAGS, MAX_TERMS = 64, 16


def trim(c: Column) -> Column:
    """Trims Unicode white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def canonical_key(c: Column) -> Column:
    """Lower-case key of letters and digits joined by single underscores; null if nothing is left."""
    bare = F.regexp_replace(F.lower(trim(c)), "['’]", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(""))


def inferred_key(content: Column) -> Column:
    """Key of "Favorite X: ..." and "Canonical user preference: favorite X is ...", for whole contents of one line."""
    # fixed values: the two forms of a written preference
    line = F.regexp_extract(content, r"(?i)^\s*favorite\s+(.+?)\s*:\s*.+$", 1)
    spelt = F.regexp_extract(content, r"(?i)^\s*canonical\s+user\s+preference\s*:\s*favorite\s+(.+?)\s+is\s+.+$", 1)
    found = F.when(line != "", line).when(spelt != "", spelt)
    return canonical_key(F.concat(F.lit("favorite "), found))


def lower_tags(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.lower(trim(t)))


def has_canonical_tag(tags: Column) -> Column:
    return F.array_contains(lower_tags(tags), "canonical")


def has_preference_tag(tags: Column) -> Column:
    return F.exists(lower_tags(tags), lambda t: t.isin("favorite", "user-preference") | t.contains("preference"))


def resolved_key(content: Column, tags: Column, stored: Column | None = None) -> Column:
    """The key of a stored row: from its metadata, else, with a canonical or preference tag, from its content."""
    own = F.when(has_canonical_tag(tags) | has_preference_tag(tags), inferred_key(content))
    return own if stored is None else F.coalesce(canonical_key(stored), own)


def written_key(content: Column, tags: Column, stored: Column, idempotency_key: Column) -> Column:
    """The key of a row that is written; an idempotency key counts if it names a favourite."""
    named = canonical_key(idempotency_key)
    of_key = F.when(has_preference_tag(tags) & named.startswith("favorite_"), named)
    return F.coalesce(canonical_key(stored), of_key, resolved_key(content, tags))


def clean_tags(tags: Column) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(tags, trim), lambda t: t != "")), 1, MAX_TAGS)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def folded(c: Column) -> Column:
    """Lower case, accents folded."""
    low = F.lower(c)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, ACCENTED, PLAIN))  # plain ASCII needs no folding


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, accents folded, in order."""
    return F.array_remove(F.split(folded(c), r"[^\p{L}\p{N}]+"), "")


def query_terms(query: str) -> list[list[str]]:
    """At most MAX_TERMS search terms; each a phrase of tokens, since an underscore separates tokens but not terms."""
    found = re.findall(r"[a-z0-9_]{2,}", query.lower())[:MAX_TERMS]
    phrases = [[t for t in term.split("_") if t] for term in found]
    return [p for k, p in enumerate(phrases) if p and p not in phrases[:k]]


def fact_parts(c: Column) -> Column:
    """Sentences and lines of 20 to 600 characters, in order, repeats included."""
    parts = F.transform(F.split(c, r"\n+|(?<=[.!?])\s+"), trim)
    return F.filter(parts, lambda p: F.length(p).between(20, 600))


def fact_score(c: Column) -> Column:
    n = F.length(c)
    word = F.when(c.rlike(rf"(?i)\b({FACT_WORDS})\b"), 1.0).otherwise(0.0)
    digit = F.when(c.rlike("[0-9]"), 0.25).otherwise(0.0)
    mark = F.when(c.rlike("[:;]"), 0.15).otherwise(0.0)
    return F.least(n / 120.0, F.lit(1.25)) + word + digit + mark - F.when(n < 30, 0.3).otherwise(0.0)


def token_estimate(c: Column) -> Column:
    return (F.ceil(F.length(c) / 4) + 20).cast("long")


def truncated(c: Column, limit: int) -> Column:
    """The first limit characters, and how many were cut."""
    cut = F.regexp_replace(F.substring(c, 1, limit), r"(?U)\s+$", "")
    note = F.format_string("\n… [truncated %d chars]", F.length(c) - limit)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, note))


def snippet(c: Column, limit: int = 140) -> Column:
    """White space collapsed, ended with an ellipsis where it is longer than limit."""
    flat = trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def is_preference_query(query: str) -> bool:
    return re.search(PREFERENCE, query) is not None


def is_temporal_query(query: str) -> bool:
    return re.search(TEMPORAL, query) is not None


def preference_terms(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[a-z0-9_]{3,}", query.lower())))


def preference_score(key: Column, content: Column, terms: list[str]) -> Column:
    """How many of the terms are part of key and content."""
    text = F.lower(F.concat_ws(" ", key, content))
    return sum((text.contains(t).cast("int") for t in terms), F.lit(0))
