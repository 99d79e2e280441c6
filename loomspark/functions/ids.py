"""Identity: every id is derived from its key, so no table is needed to join by it."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

STRATEGIES = ("boundary", "fixed", "recursive", "structural")
#: Bounds of chunk size and overlap in tokens.
SIZES, OVERLAPS = (64, 8000), (0, 4000)
VARIANT = rf"^({'|'.join(STRATEGIES)})-(\d+)-(\d+)$"


def document_id(key) -> Column:
    return F.substring(F.sha1(col(key)), 1, 16)


def content_hash(content) -> Column:
    return F.substring(F.sha2(col(content), 256), 1, 16)


def vector_id(document, index) -> Column:
    return F.concat(col(document), F.lit("#"), F.lpad(col(index).cast("string"), 5, "0"))


def parsed_vector_id(vector) -> tuple[Column, Column]:
    """(document id, chunk index); the index is null where the id can't be read."""
    tail = F.regexp_extract(col(vector), r"#([^#]*)$", 1)
    return F.regexp_replace(col(vector), r"#[^#]*$", ""), F.when(tail.rlike(r"^\d+$"), tail.try_cast("int"))


def derived_key(document, name: str) -> Column:
    return F.concat(F.lit("derived/"), col(document), F.lit(f"/{name}"))


def variant_id(strategy: str, size: int, overlap: int) -> str:
    return f"{strategy}-{size}-{overlap}"


def parse_variant(variant: str) -> tuple[str, int, int]:
    """(strategy, size, overlap) of a variant id; ValueError for unknown strategies and impossible geometry."""
    parts = variant.split("-")
    if len(parts) != 3 or parts[0] not in STRATEGIES or not (parts[1] + parts[2]).isdigit():
        raise ValueError(f"no chunking variant: {variant!r}")
    size, overlap = int(parts[1]), int(parts[2])
    if not SIZES[0] <= size <= SIZES[1] or not OVERLAPS[0] <= overlap <= OVERLAPS[1] or overlap >= size:
        raise ValueError(f"impossible geometry: {variant!r}")
    return parts[0], size, overlap


def resolve_variant(named: str | None, strategy: str | None = None, size: int | None = None, overlap: int | None = None, default: str = "") -> str:
    """The space to use: a named variant beats a requested geometry, which beats the default ('' is the original space)."""
    if named is not None:
        return variant_id(*parse_variant(named)) if named else ""
    if strategy is not None and size is not None and overlap is not None:
        return variant_id(*parse_variant(variant_id(strategy, size, overlap)))
    return default


def resolved_variant(named, strategy, size, overlap, default: str = "") -> Column:
    """The same as a column: null where what was named, or asked for, is no variant."""
    asked = F.concat_ws("-", col(strategy), col(size).cast("string"), col(overlap).cast("string"))
    valid = lambda v: F.when(variant_struct(v).isNotNull(), v)
    whole = col(strategy).isNotNull() & col(size).isNotNull() & col(overlap).isNotNull()
    return F.when(col(named) == "", "").when(col(named).isNotNull(), valid(col(named))).when(whole, valid(asked)).otherwise(default)


def variant_struct(variant) -> Column:
    """strategy, size, overlap; null where parse_variant refuses."""
    v = col(variant)
    size, overlap = F.regexp_extract(v, VARIANT, 2).try_cast("int"), F.regexp_extract(v, VARIANT, 3).try_cast("int")
    good = v.rlike(VARIANT) & size.between(*SIZES) & overlap.between(*OVERLAPS) & (overlap < size)
    return F.when(good, F.struct(F.regexp_extract(v, VARIANT, 1).alias("strategy"), size.alias("size"), overlap.alias("overlap")))


def variant_label(variant) -> Column:
    s = variant_struct(variant)
    return F.when(s.isNotNull(), F.concat(s["strategy"], F.lit(" · "), s["size"].cast("string"), F.lit("/"), s["overlap"].cast("string"))).otherwise(F.when(col(variant) == "", F.lit("original")).otherwise(col(variant)))


def hmac_sha256(value, key: bytes) -> Column:
    """Hex HMAC-SHA256 by its definition, all in columns."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(col(value), "UTF-8")), 256))), 256)
