"""``build_dataset``: the one data query, composed from the operators.

raw rows -> file ranks -> keep-last dedup -> variable mapping -> deployments
-> inclusive time window. Lazy end to end; one shuffle (the dedup key
``(dataset_id, time)``) on the wide path.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetseries.operators import deployment as dep_ops
from fleetseries.operators import mapping as map_ops
from fleetseries.operators import reconcile as rec
from fleetseries.session import broadcast_if_small, write_table


def file_ranks(raw: DataFrame) -> DataFrame:
    """One row per file: role and ``file_rank`` (archived by their own first
    timestamp, live last), from the whole files (the file index)."""
    roles = rec.classify_roles(rec.file_bounds(raw))
    return rec.rank_files(roles).select("dataset_id", "file_name", "file_rank", "file_role")


def file_index_table(raw: DataFrame) -> DataFrame:
    """The file index (one row per file with its rank), written as a table.

    This is the one eager step of a build (the index refresh): later joins
    see the index's real size and broadcast it when it is small.
    """
    return write_table(file_ranks(raw), "file_index")


def ranked_rows(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Attach ``file_rank`` to raw rows; the per-file table is broadcast when
    its estimated size is small, else joined by a shuffle join."""
    return rows.join(broadcast_if_small(ranks), on=["dataset_id", "file_name"], how="inner")


def index_ranks(file_index: DataFrame) -> DataFrame:
    """Ranks from a stored file index (dataset_id, file_name, file_role, time_start, ...)."""
    return rec.rank_files(file_index.select("dataset_id", "file_name", "file_role", "time_start")).select(
        "dataset_id", "file_name", "file_rank", "file_role")


def rows_in_window(raw: DataFrame, file_index: DataFrame | None, start, end, half_open: bool) -> DataFrame:
    """Window filter on the rows (pushed to the scan on a stored ``time``) and,
    with a stored index, file pruning: only files whose bounds overlap the
    window are kept (a semi-join on a small table; on a bronze table
    partitioned by file it becomes dynamic partition pruning)."""
    rows = raw
    if start is not None or end is not None:
        rows = rec.time_window(rows, start, end, half_open)
        if file_index is not None:
            keep = rec.prune_files(file_index, start, end).select("dataset_id", "file_name")
            rows = rows.join(broadcast_if_small(keep), ["dataset_id", "file_name"], "left_semi")
    return rows


def build_dataset(raw: DataFrame, specs: Sequence[dict], deployments: DataFrame | None,
                  platform_type: str = "fixed", start: datetime | str | None = None,
                  end: datetime | str | None = None, variables: Sequence[str] | None = None,
                  half_open: bool = False, file_index: DataFrame | None = None, report_bad: bool = False) -> DataFrame:
    """Wide build of every dataset sharing one config signature.

    The window filter is applied to the raw rows before the dedup: it is on
    the window's partition key, so Catalyst pushes it to the scan. Pass the
    stored ``file_index`` (the index refresh keeps it) so ranks and file
    pruning come from it; without it the index is derived from ``raw`` once
    (one extra aggregate pass) and written as a small table. ``report_bad``
    adds the column ``bad_values`` that ``coverage.build_attrs`` sums up.
    """
    columns = map_ops.wide_columns(specs, variables)
    if variables is not None:
        order = {v: i for i, v in enumerate(variables)}
        columns = sorted(columns, key=lambda c: order.get(c["canonical_name"], len(order)))
    needed = sorted({n for c in columns for n in c["raw_names"]})
    ranks = index_ranks(file_index) if file_index is not None else file_index_table(raw)
    rows = rows_in_window(raw, file_index, start, end, half_open)
    rows = map_ops.prune_cells(rows, needed)
    rows = rec.dedup_keep_last(ranked_rows(rows, ranks))
    wide = map_ops.map_wide(rows, columns, report_bad=report_bad)
    if deployments is not None:
        wide = dep_ops.attach_deployments(wide, deployments, platform_type)
    return wide


def wide_column_list(specs: Sequence[dict], variables: Sequence[str] | None = None) -> list[tuple[str, str]]:
    return [(c["column"], c["dtype"]) for c in map_ops.wide_columns(specs, variables)]


def long_observations(rows: DataFrame, vmap: DataFrame) -> DataFrame:
    """Deduped raw rows -> long canonical observations (fleet-wide path)."""
    return map_ops.map_long(map_ops.explode_cells(rows), vmap)


def catalog_deployments(catalog: DataFrame) -> DataFrame:
    """Deployments table exploded from parsed config documents (one row per window).

    A document with an unreadable date gives no windows: its readings stay without
    a position, and those of other documents are not touched. The rules report it.
    """
    from fleetseries.schemas import DEPLOYMENTS

    def unreadable(w):
        return F.try_to_timestamp(w["start"]).isNull() | (w["end"].isNotNull() & F.try_to_timestamp(w["end"]).isNull())

    readable = catalog.filter(~F.exists("deployments", unreadable))
    d = readable.select("dataset_id", F.posexplode("deployments").alias("dep_ord", "d"))
    out = d.select(
        "dataset_id", F.col("dep_ord").cast("int").alias("dep_ord"),
        F.try_to_timestamp("d.start").cast("timestamp_ntz").alias("start"),
        F.try_to_timestamp("d.end").cast("timestamp_ntz").alias("end"),
        *[F.col(f"d.{c}").try_cast("double").alias(c) for c in ("lat", "lon", "elevation")],
        F.col("d.platform_name").alias("platform_name"),
        F.col("d.instrument_config").alias("instrument_config"), F.col("d.notes").alias("notes"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in DEPLOYMENTS.fields])


def build_fleet(raw: DataFrame, catalog: DataFrame, start: datetime | str | None = None,
                end: datetime | str | None = None, half_open: bool = False,
                file_index: DataFrame | None = None) -> DataFrame:
    """Long observations for every dataset of the catalog, whatever its config
    signature, with the fixed position or mobile platform attached.

    One shuffle of the raw rows (dedup on (dataset_id, time)); the variable map
    and deployments are exploded from the catalog and joined by size-checked
    broadcast (a shuffle join beyond the bound).
    """
    ranks = index_ranks(file_index) if file_index is not None else file_index_table(raw)
    rows = rows_in_window(raw, file_index, start, end, half_open)
    rows = rec.dedup_keep_last(ranked_rows(rows, ranks))
    obs = long_observations(rows, map_ops.variable_map_from_catalog(catalog))
    deps = catalog_deployments(catalog)
    platforms = catalog.select("dataset_id", "platform_type")
    obs = obs.join(broadcast_if_small(platforms), "dataset_id", "left")
    fixed = dep_ops.attach_deployments(obs.filter(F.col("platform_type") == "fixed"), deps, "fixed")
    mobile = dep_ops.attach_deployments(obs.filter(F.col("platform_type") != "fixed"), deps, "mobile")
    return fixed.unionByName(mobile, allowMissingColumns=True)
