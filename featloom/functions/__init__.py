"""Column-level functions (built-in expressions only)."""

from featloom.functions.mapstr import pack_entries, pack_map, unpack_map, merge_maps, map_entries_text
from featloom.functions.hashing import (
    java_string_hash, java_hash_bucket, java_hash_bucket_col,
    sha1_bucket, sha1_bucket_col,
)
from featloom.functions.dates import period_of, period_range, year_month_text, ymd_text, parse_date, parse_timestamp
from featloom.functions.numeric import clamp_zero, safe_ratio, squared_error, empty_to

__all__ = [
    "pack_entries", "pack_map", "unpack_map", "merge_maps", "map_entries_text",
    "java_string_hash", "java_hash_bucket", "java_hash_bucket_col", "sha1_bucket", "sha1_bucket_col",
    "period_of", "period_range", "year_month_text", "ymd_text", "parse_date", "parse_timestamp",
    "clamp_zero", "safe_ratio", "squared_error", "empty_to",
]
