"""Identifiers: canonical UUIDs, name-based UUIDs, canonical JSON and content signatures."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, functions as F

CANONICAL = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_LOOSE = r"^\s*(?:urn:uuid:)?\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\}?\s*$"
#: The URL namespace of RFC 9562, as hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def canonical_uuid(c: Column | str) -> Column:
    """The 36-character lower-case form of a UUID written with or without hyphens, braces, urn:uuid: or blanks.

    What is no UUID comes back as written; null stays null.
    """
    c = F.col(c) if isinstance(c, str) else c
    low = F.lower(c)
    return F.when(c.rlike(CANONICAL), c).when(low.rlike(_LOOSE), F.regexp_replace(low, _LOOSE, "$1-$2-$3-$4-$5")).otherwise(c)


def is_blank(c: Column | str) -> Column:
    """True for null and for texts of white space only."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | ~c.rlike(r"\S")


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """A name-based (version 5) UUID from built-in functions only; null for a null name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def canonical_json(value: object) -> str:
    """Compact JSON with recursively sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_signature(payload: dict) -> str:
    """SHA-256 of the canonical JSON without the top-level created_at."""
    return hashlib.sha256(canonical_json({k: v for k, v in payload.items() if k != "created_at"}).encode()).hexdigest()
