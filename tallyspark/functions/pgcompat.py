"""Column helpers reproducing Postgres semantics that differ from Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: a title is a revert when it starts with "revert" (any case)
# followed by whitespace, punctuation or the end of the string.
REVERT_PATTERN = r"(?i)^revert([\s\p{Punct}]|$)"


def pg_concat(*cols: Column) -> Column:
    """Postgres ``concat``: NULL arguments are skipped (Spark ``concat`` is NULL)."""
    return F.concat_ws("", *cols)


def org_repo(org: Column, repo: Column) -> Column:
    """``nullif(concat(org, '/', repo), '/')``: only a fully unknown repo is NULL."""
    return F.nullif(pg_concat(org, F.lit("/"), repo), F.lit("/"))


def epoch_seconds(later: Column, earlier: Column) -> Column:
    """``extract(epoch from later - earlier)`` as double seconds."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def utc_date(ts: Column) -> Column:
    """``(ts at time zone 'UTC')::date``; the session time zone is pinned to UTC."""
    return F.to_date(ts)


def revert_title(title: Column, pattern: str = REVERT_PATTERN) -> Column:
    return F.coalesce(title, F.lit("")).rlike(pattern)
