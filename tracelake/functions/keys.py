"""Content keys and hash buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bucket(c: Column, buckets: int = 10) -> Column:
    """First eight hex digits of the SHA-256, modulo ``buckets``."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def hash_order(seed: int | str, *cols: Column) -> Column:
    """Pseudo-random total order on a key, the same on every engine and run."""
    return F.sha2(F.concat_ws("\t", F.lit(str(seed)), *[c.cast("string") for c in cols]), 256)


def context_key(user: Column, t: Column, problem: Column) -> Column:
    return F.concat_ws("\t", user, t.cast("string"), problem)


def signature(**fields: Column) -> Column:
    """SHA-1 of a JSON object with the fields in name order."""
    return F.sha1(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *parts), 256)
