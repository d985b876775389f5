"""Memory predicates as one Column, tenant scope, pagination, lookup by content, usage and quotas."""

from __future__ import annotations

import base64
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash


@dataclass(frozen=True)
class MemoryFilter:
    """Conjunction of predicates; an empty set or None leaves its column free. ``metadata`` is (key, value) pairs.

    These are columns of their own; with ``in_map`` entries of the map column ``metadata``, compared as text; with
    ``in_variant`` fields of the VARIANT column ``metadata``, compared as what they are: a number meets an equal number, never
    the text that reads like it nor a boolean. None meets a field that is null or not there.
    """

    statuses: frozenset[str] = frozenset({"active"})
    kinds: frozenset[str] = frozenset()
    tags: frozenset[str] = frozenset()
    metadata: tuple[tuple[str, object], ...] = field(default=())
    after: datetime | None = None
    before: datetime | None = None
    source: str | None = None
    in_map: bool = False
    in_variant: bool = False

    def column(self) -> Column:
        """The predicate; comparisons with literals, so that scans can take them over."""
        out = F.col("status").isin(sorted(self.statuses)) if self.statuses else F.lit(True)
        if self.kinds:
            out &= F.col("kind").isin(sorted(self.kinds))
        if self.tags:
            wanted = F.array(*[F.lit(t.lower()) for t in sorted(self.tags)])
            out &= F.size(F.array_except(wanted, F.col("tags"))) == 0
        for key, value in self.metadata:
            if self.in_variant:
                out &= typed_equal(F.col("metadata"), key, value)
                continue
            held = F.element_at(F.col("metadata"), F.lit(key)) if self.in_map else F.col(key)
            wanted = F.lit(str(value)) if self.in_map and value is not None else F.lit(value)
            out &= held.isNull() if value is None else held.eqNullSafe(wanted)
        if self.after is not None:
            out &= F.col("occurred_at") >= F.lit(self.after)
        if self.before is not None:
            out &= F.col("occurred_at") <= F.lit(self.before)
        if self.source is not None:
            out &= F.col("source") == self.source
        return out


def typed_equal(metadata: Column, key: str, value: object) -> Column:
    """Whether a field of a VARIANT object is a value of its type."""
    if '"' in key:
        raise ValueError("a key with a quotation mark has no path")
    path = f'$["{key}"]'
    field = F.try_variant_get(metadata, path, "variant")
    kind = F.schema_of_variant(field)
    if value is None:
        return field.isNull() | (kind == "VOID")
    if isinstance(value, bool):
        typed, held = kind == "BOOLEAN", F.try_variant_get(metadata, path, "boolean") == F.lit(value)
    elif isinstance(value, (int, float)):
        typed, held = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(metadata, path, "double") == F.lit(float(value))
    else:
        typed, held = kind == "STRING", F.try_variant_get(metadata, path, "string") == F.lit(str(value))
    return F.coalesce(typed & held, F.lit(False))


def in_space(rows: DataFrame, org_id: str, space_id: str) -> DataFrame:
    """Rows of one tenant's space; both ids are partition columns in storage, so other tenants' files aren't read."""
    return rows.filter((F.col("org_id") == org_id) & (F.col("space_id") == space_id))


def source_of(rows: DataFrame) -> Column:
    """What a memory counts under in a cap of sources: the memory it was taken from, else its document, else its source."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("extracted_from", "doc_id", "source") if c in rows.columns], F.lit(None).cast("string"))


def fetch(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of the given ids; ids that don't exist are absent."""
    return rows.join(ids.select(id_col).distinct(), id_col, "left_semi")


def encode_cursor(last_id: object) -> str:
    """Opaque cursor of the last id of a page."""
    return base64.urlsafe_b64encode(str(last_id).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> str:
    """Id of a cursor; ValueError if it is malformed."""
    try:
        return base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True).decode()
    except ValueError as e:
        raise ValueError("malformed cursor") from e


def keyset_page(rows: DataFrame, limit: int, cursor: str | None = None, id_col: str = "id") -> DataFrame:
    """The next ``limit`` rows by id after the cursor, with ``total``, the number of all rows that pass the filter."""
    if limit <= 0:
        return rows.limit(0).withColumn("total", F.lit(0).cast("long"))
    total = rows.agg(F.count("*").alias("total"))
    page = rows if cursor is None else rows.filter(F.col(id_col) > F.lit(decode_cursor(cursor)).cast(rows.schema[id_col].dataType))
    return page.orderBy(id_col).limit(limit).join(F.broadcast(total))


def by_content(rows: DataFrame, texts: DataFrame, id_col: str = "id") -> DataFrame:
    """(content_sha256, id) of the first row that isn't archived with the content of each text."""
    wanted = texts.select(content_hash(F.col("content")).alias("content_sha256")).distinct()
    held = rows.filter("status <> 'archived'").select(content_hash(F.col("content")).alias("content_sha256"), id_col)
    return held.join(wanted, "content_sha256", "left_semi").groupBy("content_sha256").agg(F.min(id_col).alias(id_col))


def tenant_usage(rows: DataFrame, since: Column, by: list[str]) -> DataFrame:
    """Memories, UTF-8 bytes and memories since a time of each tenant, without archived ones."""
    return rows.filter("status <> 'archived'").groupBy(*by).agg(
        F.count("*").alias("memories"),
        F.sum(F.octet_length("content")).cast("long").alias("bytes"),
        F.count_if(F.col("occurred_at") >= since).alias("recent"),
    )


def quota_flags(usage: DataFrame, max_memories: int = 0, max_bytes: int = 0, max_recent: int = 0, incoming_bytes: int = 0) -> DataFrame:
    """Which quotas one more write would break; 0 means no quota."""
    return usage.withColumns(
        {
            "over_memories": F.lit(max_memories > 0) & (F.col("memories") >= max_memories),
            "over_bytes": F.lit(max_bytes > 0) & (F.col("bytes") + incoming_bytes > max_bytes),
            "over_recent": F.lit(max_recent > 0) & (F.col("recent") >= max_recent),
        }
    )
