"""Month bounds, settled months, publish listing, pending periods, monthly output."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetseries.operators import publish as pub
from fleetseries.plans import fixtures as fx
from fleetseries.plans.build import build_dataset
from fleetseries.plans.q_catalog import CURRENT_SQL, current_versions, valid_catalog
from fleetseries.plans.registry import register
from fleetseries.session import new_scratch_path
from fleetseries.sources.state import StateTable

NOW = "2000-06-15 00:00:00"
LOG_BEFORE = "1998-01"


@register("month_bounds", """SELECT o_orderkey, date_trunc('month', o_orderdate) AS month_start,
  date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS month_end FROM orders""")
def month_bounds(spark, d):
    o = fx.table(spark, d, "orders")
    s, e = pub.month_bounds(F.col("o_orderdate"))
    return o.select("o_orderkey", s.alias("month_start"), e.alias("month_end"))


SETTLED_SQL = f"""{fx.ORDER_COVERAGE_SQL},
settled AS (
  SELECT dataset_id, strftime(m, '%Y-%m') AS period, m AS month_start, m + INTERVAL 1 MONTH AS month_end
  FROM (SELECT dataset_id, data_start, data_end,
          unnest(generate_series(date_trunc('month', data_start),
                 date_trunc('month', least(data_end, TIMESTAMP '{NOW}')) - INTERVAL 1 MONTH,
                 INTERVAL 1 MONTH)) AS m FROM cov)
  WHERE data_start < m + INTERVAL 1 MONTH AND least(data_end, TIMESTAMP '{NOW}') >= m + INTERVAL 1 MONTH)"""


def settled(spark, d):
    return pub.settled_months(fx.order_coverage(spark, d), NOW)


@register("settled_months", f"WITH {SETTLED_SQL} SELECT dataset_id, period FROM settled")
def settled_months(spark, d):
    return settled(spark, d).select("dataset_id", "period")


LATEST_SQL = f"""{fx.ORDER_COVERAGE_SQL},
lat AS (
  SELECT dataset_id,
    CASE WHEN data_start < date_trunc('month', least(data_end, TIMESTAMP '{NOW}'))
          AND least(data_end, TIMESTAMP '{NOW}') >= date_trunc('month', least(data_end, TIMESTAMP '{NOW}'))
         THEN strftime(date_trunc('month', least(data_end, TIMESTAMP '{NOW}')) - INTERVAL 1 MONTH, '%Y-%m')
    END AS latest_complete_month
  FROM cov)"""


@register("latest_settled", f"WITH {LATEST_SQL} SELECT * FROM lat")
def latest_settled(spark, d):
    return pub.latest_settled(fx.order_coverage(spark, d), NOW)


@register("publish_listing", f"""WITH {LATEST_SQL}, {fx.CATALOG_SQL.replace('cat AS', 'catx AS')}
SELECT 'cust' || c.c_custkey AS dataset_id, l.latest_complete_month,
  CASE WHEN l.latest_complete_month IS NOT NULL
       THEN '/publish/cust' || c.c_custkey || '/' || l.latest_complete_month END AS download_url
FROM catx c LEFT JOIN lat l ON l.dataset_id = 'cust' || c.c_custkey
WHERE c.publish AND NOT {fx.VIOLATION_SQL}""")
def publish_listing(spark, d):
    return pub.publish_listing(valid_catalog(spark, d), fx.order_coverage(spark, d), NOW)


def publish_log(spark, d):
    """Periods already published: every settled period before 1998."""
    s = settled(spark, d)
    return s.filter(F.col("period") < LOG_BEFORE).select("dataset_id", "period")


PENDING_SQL = f"""{SETTLED_SQL},
plog AS (SELECT dataset_id, period FROM settled WHERE period < '{LOG_BEFORE}'),
pending AS (SELECT s.* FROM settled s ANTI JOIN plog USING (dataset_id, period))"""


@register("publish_pending", f"WITH {PENDING_SQL} SELECT dataset_id, period FROM pending")
def publish_pending(spark, d):
    return pub.pending_periods(settled(spark, d), publish_log(spark, d)).select("dataset_id", "period")


TEMPLATE = "{station}_{yyyy}{mm}.nc"
ORDER_SPECS = [{"raw_name": "Total", "standard_name": "total_price"}]


@register("publish_month", f"""WITH {PENDING_SQL}, {CURRENT_SQL},
last AS (SELECT 'cust' || o_custkey AS dataset_id, o_orderdate AS time, arg_max(o_totalprice, o_orderkey) AS total_price
         FROM orders GROUP BY o_custkey, o_orderdate)
SELECT p.dataset_id, p.period, l.time, l.total_price,
  p.dataset_id || '_' || strftime(p.month_start, '%Y%m') || '.nc' AS file_name,
  count(*) OVER (PARTITION BY p.dataset_id, p.period) AS n_rows, c.hash AS config_hash
FROM pending p JOIN last l ON l.dataset_id = p.dataset_id AND l.time >= p.month_start AND l.time <= p.month_end
JOIN cur c ON c.dataset_id = p.dataset_id""")
def publish_month(spark, d):
    """Every settled month that was not published before is built, written and logged; the rows are read through the log."""
    root = new_scratch_path(spark, "published")
    log = StateTable(spark, root + "/log", pub.LOG_SCHEMA)
    log.append(publish_log(spark, d).select(
        "dataset_id", "period", *[F.lit(None).alias(c) for c in ("file_name", "n_rows", "config_hash", "software_version", "run")],
        F.lit(None).alias("created_at")), 0)
    o = fx.table(spark, d, "orders")
    ds = F.concat(F.lit("cust"), F.col("o_custkey").cast("string"))
    raw = o.select(ds.alias("dataset_id"), F.concat(ds, F.lit("_Min.dat")).alias("file_name"), F.lit(0).cast("bigint").alias("block_start"),
                   F.col("o_orderkey").alias("row_pos"), F.col("o_orderdate").alias("time"),
                   F.create_map(F.lit("Total"), F.col("o_totalprice").cast("string")).alias("cells"))
    built = build_dataset(raw, ORDER_SPECS, None)
    names = fx.order_coverage(spark, d).select("dataset_id", F.lit(TEMPLATE).alias("template"))
    pub.publish_periods(built, settled(spark, d), names, current_versions(spark, d), log, root + "/data", NOW)
    schema = T._parse_datatype_string("dataset_id string, period string, time timestamp_ntz, total_price double, file_name string")
    entries = log.read().select("dataset_id", "period", "n_rows", "config_hash")
    return pub.published_rows(log, root + "/data", schema).join(pub.sorted_log(entries), ["dataset_id", "period"])
