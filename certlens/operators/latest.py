"""Versioned tables: newest-version reads, in-batch dedupe, retention, compaction.

The stored ``certificates`` table is append-only (one row per sighting). The
newest version per key is computed with a hash aggregate ``max_by(row,
version)`` rather than a ``row_number`` window: the aggregate combines
map-side, so a key with millions of versions is collapsed before the shuffle
and never sorted inside one task, and the result comes out hash-partitioned
by the key, which the following join on that key reuses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlens.functions.timewin import Span


def latest_by(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str,
              columns: Sequence[str] | None = None) -> DataFrame:
    """Keep the row with the greatest ``order`` tuple per ``keys``.

    ``columns`` limits the carried payload (select only what the consumer
    needs: a struct over all columns would defeat column pruning).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    wanted = list(columns) if columns is not None else [c for c in df.columns]
    payload_cols = [c for c in dict.fromkeys(wanted + order) if c not in keys]
    payload = F.struct(*payload_cols)
    version = F.struct(*order) if len(order) > 1 else F.col(order[0])
    out = df.groupBy(*keys).agg(F.max_by(payload, version).alias("_latest"))
    return out.select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in payload_cols if c in wanted or columns is None])


def latest_versions(versions: DataFrame, columns: Sequence[str] | None = None,
                    key: str = "cert_hash") -> DataFrame:
    """Newest certificate version: greatest (last_seen, batch_id, ingest_seq), as
    far as the columns are there; sequence numbers start anew in every batch."""
    order = [c for c in ("last_seen", "batch_id", "ingest_seq") if c == "last_seen" or c in versions.columns]
    return latest_by(versions, key, order, columns)


def dedupe_batch(batch: DataFrame, key: str = "cert_hash") -> DataFrame:
    """In-batch upsert dedupe: greatest last_seen per key, later row on ties."""
    return latest_versions(batch, key=key)


def latest_updated(df: DataFrame, keys: Sequence[str] | str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rollups and snapshots: newest ``updated_at`` per key wins."""
    return latest_by(df, keys, "updated_at", columns)


def retained(observations: DataFrame, as_of, days: int = 30, ts_col: str = "seen_at") -> DataFrame:
    """Rows inside the retention window ``[as_of - days, +inf)``."""
    return Span.trailing(as_of, days).filter(observations, ts_col)
