"""Feature hashing into a fixed number of buckets (M8, M9).

Two bucket rules exist, one per output format:

* Java string hash (``h = 31*h + c`` on 32 bits), ``abs(h) % n``.
* SHA-1 of the UTF-8 text read as one big integer, ``% n``.

Constant keys (slot names of continuous features) are hashed once on the
driver; only per-row values go through column expressions.  The SHA-1 rule
is pure built-ins (``sha1`` + ``conv`` on 40-bit chunks), so it stays in
whole-stage codegen; the Java rule folds characters with ``aggregate``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK32 = 1 << 32


def java_string_hash(s: str) -> int:
    """Java ``String.hashCode`` as a signed 32-bit int (UTF-16 code units)."""
    h = 0
    data = s.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = (31 * h + ((data[i] << 8) | data[i + 1])) % _MASK32
    return h - _MASK32 if h >= (1 << 31) else h


def java_hash_bucket(s: str, n: int = 1000) -> int:
    """Bucket of a constant key; 64-bit abs, so always >= 0."""
    return abs(java_string_hash(s)) % n


def java_hash_bucket_col(value, prefix: str = "", n: int = 1000) -> Column:
    """Bucket of ``prefix + value`` per row.

    ``hash(prefix + v) = hash(prefix) * 31^len(v) + hash(v)`` (mod 2^32), so
    the fold starts from the prefix's hash and walks only the value's
    characters.  ``ascii`` gives the code point; one beyond 16 bits is folded as
    its two UTF-16 units.
    """
    start = java_string_hash(prefix) % _MASK32
    if isinstance(value, str):
        return F.expr(java_hash_bucket_sql("`" + value.replace("`", "``") + "`", start, n))
    v = value.cast("string")
    unsigned = F.aggregate(
        F.transform(F.filter(F.split(v, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("long")),
        F.lit(start).cast("long"),
        lambda acc, x: F.when(x < 65536, (acc * 31 + x) % F.lit(_MASK32)).otherwise(
            (((acc * 31 + 55296 + F.floor((x - 65536) / 1024)) % F.lit(_MASK32)) * 31 + 56320 + (x - 65536) % 1024) % F.lit(_MASK32)))
    signed = (unsigned + F.lit(1 << 31)) % F.lit(_MASK32) - F.lit(1 << 31)
    return F.abs(signed) % F.lit(n)


def java_hash_bucket_sql(value_sql: str, start: int, n: int = 1000) -> str:
    """SQL-text form of the per-row Java-hash bucket (one JVM parse)."""
    h = (f"aggregate(transform(filter(split(cast({value_sql} AS string), ''), ch -> ch != ''), "
         f"ch -> cast(ascii(ch) AS bigint)), "
         f"{start}L, (a, x) -> CASE WHEN x < 65536 THEN (a * 31 + x) % {_MASK32}L ELSE "
         f"(((a * 31 + 55296 + (x - 65536) div 1024) % {_MASK32}L) * 31 + 56320 + (x - 65536) % 1024) % {_MASK32}L END)")
    # signed = ((h + 2^31) mod 2^32) - 2^31 for 0 <= h < 2^32: one reference to the fold.
    return f"abs((({h}) + {1 << 31}L) % {_MASK32}L - {1 << 31}L) % {n}"


def sha1_bucket(s: str, n: int = 1000) -> int:
    return int(hashlib.sha1(s.encode("utf-8")).hexdigest(), 16) % n


def sha1_bucket_col(value, prefix: str = "", n: int = 1000) -> Column:
    """``int(sha1(prefix + value), 16) % n`` with built-in expressions.

    The 160-bit digest is four 40-bit chunks ``c0..c3``; the residue is
    ``sum(c_i mod n * 16^(10*(3-i)) mod n) mod n`` with weights computed on
    the driver.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("string")
    text = F.concat(F.lit(prefix), v) if prefix else v
    digest = F.sha1(text)
    total = F.lit(0).cast("long")
    for i in range(4):
        weight = pow(16, 10 * (3 - i), n)
        chunk = F.conv(F.substring(digest, 10 * i + 1, 10), 16, 10).cast("long")
        total = total + (chunk % F.lit(n)) * F.lit(weight)
    return total % F.lit(n)
