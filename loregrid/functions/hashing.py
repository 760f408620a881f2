"""Keyed hashes from built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 in lower-case hex: two SHA-256 over the padded key."""
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in k).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
