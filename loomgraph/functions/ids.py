"""Identifiers: 'W123' strings and their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pid(work_id: Column | str) -> Column:
    """The number of a 'W…' id; an id without one is an error (ANSI cast)."""
    return F.ltrim(work_id if isinstance(work_id, Column) else F.col(work_id), F.lit("W")).cast("bigint")


def number(papers: DataFrame) -> Column:
    """The papers' numbers: their column pid where they have one (as bucketed tables do), else pid("id")."""
    return F.col("pid") if "pid" in papers.columns else pid("id")


def try_pid(work_id: Column | str) -> Column:
    """As pid, null where the rest is no whole number."""
    return F.ltrim(work_id if isinstance(work_id, Column) else F.col(work_id), F.lit("W")).try_cast("bigint")


def url_pid(url: Column | str) -> Column:
    """The digits that an id URL ends with."""
    return F.regexp_extract(url if isinstance(url, Column) else F.col(url), r"(\d+)$", 1).cast("bigint")


def work_id(number: Column | str) -> Column:
    return F.concat(F.lit("W"), (number if isinstance(number, Column) else F.col(number)).cast("string"))


def last_segment(url: Column) -> Column:
    """What stands behind the last slash."""
    return F.substring_index(url, "/", -1)


def targets(col: Column | str = "targets") -> Column:
    """The ids of an adjacency list 'W1;W2;…'."""
    return F.split(col, ";")
