"""Spellings: UUIDs in plain form, names without case and blanks, epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Seconds at and above this are taken as milliseconds (1e11 s is the year 5138, 1e11 ms is 1973).
MILLIS_FROM = 100_000_000_000

_PLAIN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def plain_uuid(c: Column) -> Column:
    """A UUID in lower case with hyphens, however it is wrapped or spelled.

    Text that isn't a UUID stays as it is, so any other kind of id is kept; null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^urn:uuid:", ""), "[-{}()\\[\\]\"'\\s]", "")
    parts = [F.substring(bare, *at) for at in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(c.rlike(_PLAIN), c).when(bare.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts)).otherwise(c)


def plain_name(c: Column) -> Column:
    """A name compared without case and outer blanks."""
    return F.lower(F.trim(F.regexp_replace(c, "^\\s+|\\s+$", "")))


def letters(c: Column) -> Column:
    """Only the letters a-z of a keyword: ``BATCH_INSERT``, `` batchInsert`` and ``batch-insert`` are one."""
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def epoch_seconds(c: Column) -> Column:
    """Whole seconds of a number that counts seconds or milliseconds from the epoch."""
    return F.when(F.abs(c) >= MILLIS_FROM, F.floor(c / 1000)).otherwise(c).cast("bigint")
