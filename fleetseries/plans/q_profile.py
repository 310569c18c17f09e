"""Column profiling queries over names derived from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetseries.operators import profile as prof
from fleetseries.plans import fixtures as fx
from fleetseries.plans.registry import register
from fleetseries.schemas import KNOWN_VARIABLES

_POS_CASES = ["Lat", "LONGITUDE", "long", "Latitude_2", "lon"]


def _position_names(p):
    m = F.col("p_partkey") % 8
    expr = F.col("p_name")
    for i in reversed(range(len(_POS_CASES))):
        expr = F.when(m == i, F.lit(_POS_CASES[i])).otherwise(expr)
    return p.select(F.col("p_type").alias("dataset_id"), expr.alias("column_name")).distinct()


@register("detect_position", """SELECT DISTINCT p_type AS dataset_id, column_name,
  CASE WHEN lower(column_name) IN ('latitude', 'lat') THEN 'latitude' ELSE 'longitude' END AS position
FROM (SELECT p_type, CASE p_partkey % 8 WHEN 0 THEN 'Lat' WHEN 1 THEN 'LONGITUDE' WHEN 2 THEN 'long'
        WHEN 3 THEN 'Latitude_2' WHEN 4 THEN 'lon' ELSE p_name END AS column_name FROM part)
WHERE lower(column_name) IN ('latitude', 'lat', 'longitude', 'lon', 'long')""")
def detect_position(spark, d):
    return prof.detect_position(_position_names(fx.table(spark, d, "part")))


@register("level_groups", """WITH cols AS (
  SELECT DISTINCT p_type AS dataset_id, 'AirTC_' || p_size || 'm_' || replace(p_brand, '#', '') AS column_name,
    p_size AS level, replace(p_brand, '#', '') AS suffix
  FROM part)
SELECT dataset_id, 'AirTC' AS prefix, 'm' AS dimension_units, suffix, count(*) AS n_members,
  string_agg(column_name, ',' ORDER BY level, column_name) AS members,
  string_agg(CAST(level AS VARCHAR), ',' ORDER BY level, column_name) AS levels
FROM cols GROUP BY dataset_id, suffix HAVING count(*) >= 2""")
def level_groups(spark, d):
    cols = fx.part_columns(spark, d).select("dataset_id", "column_name").distinct()
    return prof.level_groups(cols)


_SUGGEST_BASES = [k for k, _, _ in KNOWN_VARIABLES]


def _suggest_names(p):
    bases = F.array(*[F.lit(b) for b in _SUGGEST_BASES])
    base = F.element_at(bases, (F.col("p_partkey") % len(_SUGGEST_BASES) + 1).cast("int"))
    variant = F.col("p_size") % 4
    name = (F.when(variant == 0, base)
            .when(variant == 1, F.concat(base, F.lit("_2")))
            .when(variant == 2, F.lower(base))
            .otherwise(F.concat(F.regexp_replace(F.col("p_name"), " ", "_"), F.lit("_"), F.col("p_brand"))))
    return p.select(name.alias("column_name")).distinct()


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


_NAME_SQL = ("CASE p_size % 4 " + "".join(
    f"WHEN {v} THEN {e} " for v, e in enumerate(["base", "base || '_2'", "lower(base)"])) +
    "ELSE replace(p_name, ' ', '_') || '_' || p_brand END")


@register("suggest_names", f"""WITH known AS (SELECT * FROM (VALUES {_values(KNOWN_VARIABLES)}) AS k(known_name, standard_name, units)),
bases AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{b}')" for i, b in enumerate(_SUGGEST_BASES))}) AS b(i, base)),
names AS (SELECT DISTINCT {_NAME_SQL} AS column_name FROM part JOIN bases ON p_partkey % {len(_SUGGEST_BASES)} = i)
SELECT column_name, known_name AS matched_name, standard_name, units FROM names LEFT JOIN known ON known_name = column_name""")
def suggest_names(spark, d):
    return prof.suggest_names(_suggest_names(fx.table(spark, d, "part")))


@register("rename_classes", """SELECT DISTINCT p_type AS dataset_id, 'AirTC_' || p_size || 'm_' || replace(p_brand, '#', '') AS column_name,
  CASE WHEN p_size = 10 THEN 'already_mapped' ELSE 'new' END AS classification FROM part""")
def rename_classes(spark, d):
    """Classify scanned names against each dataset's configured names."""
    cols = fx.part_columns(spark, d).select("dataset_id", "column_name").distinct()
    p = fx.table(spark, d, "part")
    # a dataset's config maps one 10 m column per brand of its own
    configured = p.select(
        F.col("p_type").alias("dataset_id"),
        F.concat(F.lit("AirTC_10m_"), F.regexp_replace("p_brand", "#", "")).alias("raw_name")).distinct()
    return prof.rename_classes(cols, configured)
