"""Column functions for packed-digit timestamps."""

from spanwise.functions.packed import packed_bucket, packed_gap, parse_packed, to_packed

__all__ = ["packed_bucket", "packed_gap", "parse_packed", "to_packed"]
