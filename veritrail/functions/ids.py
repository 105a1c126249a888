"""Deterministic ids and digests as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_hex(material: Column) -> Column:
    """Name-based UUID (version 5, URL namespace) of a text, as 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(material, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), F.lower(F.hex(variant)), F.substring(digest, 18, 15))


def prefixed_id(prefix: str, *material: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), uuid5_hex(F.concat_ws(":", *material)))


def stable_ref(namespace: str, canonical: Column) -> Column:
    """``namespace:`` and the first 32 hex digits of the SHA-256 of canonical JSON."""
    return F.concat(F.lit(f"{namespace}:"), F.left(F.sha2(canonical, 256), F.lit(32)))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of fields in name order, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
