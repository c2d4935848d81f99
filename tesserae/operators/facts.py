"""Fact extraction: sentences of a text, first occurrences, scores, the best of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.bind import let
from tesserae.functions.text import fact_parts, fact_score

MAX_FACTS = 20


def candidates(rows: DataFrame, text: str = "text", hint: Column | None = None) -> DataFrame:
    """rows exploded into fact and pos; a fact that occurs again in other case is left out. A hint is a first line."""
    whole = F.coalesce(F.col(text), F.lit(""))
    whole = whole if hint is None else F.concat(hint, F.lit("\n"), whole)

    def distinct(parts: Column) -> Column:
        # in the order of their letters, equal ones stand together; a look-up of each part among all of them grows with the square of a text
        return let(F.sort_array(F.transform(parts, lambda p, i: F.struct(F.lower(p).alias("low"), i.alias("pos"), p.alias("fact")))), firsts)

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["low"] != x["low"], F.lit(True)))

    kept = let(fact_parts(whole), distinct)
    return rows.withColumn("_f", F.explode(kept)).select(*rows.columns, "_f.pos", "_f.fact")


def best(rows: DataFrame, keys: list[str], text: str = "text", limit: int = 5, hint: Column | None = None) -> DataFrame:
    """The limit (1 to MAX_FACTS) best facts of each row, known by keys: fact, score, rank. Ties by position."""
    found = candidates(rows, text, hint).withColumn("score", fact_score(F.col("fact")))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "pos")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, min(MAX_FACTS, limit)))
