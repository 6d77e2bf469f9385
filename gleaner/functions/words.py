"""Word and label expressions used by several operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column | str) -> Column:
    """Longest runs of a-z and 0-9 of the lower-cased text, in order; null gives null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def terms(text: Column | str, least: int = 3) -> Column:
    """Longest runs of a-z of the lower-cased text that are at least ``least`` long."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: F.length(x) >= least)


def bare(text: Column | str) -> Column:
    """Lower-cased text stripped of everything but a-z and 0-9."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def is_blank(text: Column | str) -> Column:
    """True for null and for text of white space only."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))
