"""Scope planning and row-lifecycle predicates: the part of every query that is known before it runs."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY = "*"
SCOPE_TYPES = ("global", "project", "session")


@dataclass(frozen=True)
class Scope:
    """One visible scope; id None or "*" stands for every id of the type."""

    type: str
    id: str | None = None

    def __post_init__(self) -> None:
        if self.type not in SCOPE_TYPES:
            raise ValueError(f"unknown scope type {self.type!r}")


def project_id(path: str) -> str:
    """The id of a project: SHA-256 of its absolute path."""
    return hashlib.sha256(os.path.abspath(path).encode()).hexdigest()


def normalized(scope: Scope, project_path: str | None = None) -> Scope:
    """A scope as it is stored: ids of projects hashed from paths, hex ids in lower case, others trimmed."""
    if scope.type == "global":
        return Scope("global")
    if scope.type == "project" and project_path:
        return Scope("project", project_id(project_path))
    given = (scope.id or "").strip()
    if not given:
        raise ValueError(f"a {scope.type} scope needs an id")
    if re.fullmatch(r"[0-9A-Fa-f]{64}", given):
        return Scope(scope.type, given.lower())
    if scope.type == "project" and ("/" in given or "\\" in given):
        return Scope("project", project_id(given))
    return Scope(scope.type, given)


def visible(scopes: Iterable[Scope] | None = None, project_path: str | None = None, session_id: str | None = None, everything: bool = False) -> list[Scope]:
    """Scopes that a search sees. An explicit list is used as it is, even if it is empty."""
    if scopes is not None:
        return list(scopes)
    if everything:
        return [Scope("global"), Scope("project", ANY), Scope("session", ANY)]
    found = [Scope("global")]
    if project_path:
        found.append(Scope("project", project_id(project_path)))
    if session_id and session_id.strip():
        found.append(Scope("session", session_id.strip()))
    return found


def in_scope(scopes: Iterable[Scope], type_col: str = "scope_type", id_col: str = "scope_id") -> Column:
    """Rows of any of the scopes; none for an empty list."""

    def one(s: Scope) -> Column:
        kind = F.col(type_col) == s.type
        return kind if s.type == "global" or s.id in (None, ANY) else kind & (F.col(id_col) == s.id)

    return reduce(lambda a, b: a | b, map(one, scopes), F.lit(False))


def active(now: datetime | Column) -> Column:
    """Not deleted and not expired; a row that expires right now is not active."""
    at = now if isinstance(now, Column) else F.lit(now)
    return F.col("deleted_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > at))
