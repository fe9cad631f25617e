"""Spine, interval expansion, daily densification and panel queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.functions.columns import add_measures, narrow_arrays, yes
from daypanel.operators import panel as P
from daypanel.operators.features import pivot_long
from daypanel.operators.growth import merge_panels
from daypanel.operators.intervals import interval_days
from daypanel.plans.registry import query, r, rounded
from daypanel.plans.standins import (
    DENSE,
    END,
    EV,
    EVENT_SERIES,
    LONG,
    SERIES,
    SPINE,
    START,
    TARGETS,
    days_supply,
    event_measures,
    event_panel,
    events,
    spend_rate,
    targets,
)
from daypanel.sources.spine import as_date, date_spine, entity_sample, hash_fraction, split_by_mod
from daypanel.sources.tables import load

EXPANDED = f"""spans AS (SELECT user_id, date AS first, date + (k % 5)::INTEGER AS last,
  CASE WHEN k % 5 <> 0 THEN value / (k % 5) END AS rate FROM ev WHERE event_type = 'purchase'),
spread AS (SELECT user_id, date, CAST(count(*) AS BIGINT) AS active, sum(rate) AS rate
  FROM spans JOIN spine ON date BETWEEN first AND last GROUP BY user_id, date)"""


@query(
    "date_spine_events",
    f"""WITH {EV}, {SPINE} SELECT date, count(event_id) AS n_events, count(DISTINCT user_id) AS n_users
    FROM spine LEFT JOIN ev USING (date) GROUP BY date""",
)
def date_spine_events(spark: SparkSession, where: str) -> DataFrame:
    seen = events(spark, where).groupBy("date").agg(
        F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users")
    )
    return date_spine(spark, START, END).join(seen, "date", "left").na.fill(0)


@query("daily_dense_counts", f"WITH {DENSE} SELECT * FROM dense")
def daily_dense_counts(spark: SparkSession, where: str) -> DataFrame:
    measured = add_measures(events(spark, where), event_measures())
    daily = P.daily_totals(measured, "user_id", "date", sums=SERIES)
    return P.densify(daily, "user_id", "date", SERIES, START, END)


@query(
    "daily_sum_and_max",
    f"""WITH {EV} SELECT user_id, date, round(sum(value), 6) + 0.0 AS total, max(k) AS top_k,
    max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS any_error FROM ev GROUP BY user_id, date""",
)
def daily_sum_and_max(spark: SparkSession, where: str) -> DataFrame:
    measured = events(spark, where).select(
        "user_id",
        "date",
        F.col("value").alias("total"),
        F.col("k").alias("top_k"),
        yes(F.col("event_type") == "error").alias("any_error"),
    )
    return rounded(P.daily_totals(measured, "user_id", "date", ["total"], ["top_k", "any_error"]))


def _spread(spark: SparkSession, where: str) -> DataFrame:
    return P.expand_intervals(
        events(spark, where).where(F.col("event_type") == "purchase"),
        "user_id",
        "date",
        days_supply(),
        {"active": F.lit(1), "rate": spend_rate()},
        START,
        END,
    )


@query(
    "interval_expand_daily",
    f"WITH {EV}, {SPINE}, {EXPANDED} SELECT user_id, date, active, round(rate, 6) + 0.0 AS rate FROM spread",
)
def interval_expand_daily(spark: SparkSession, where: str) -> DataFrame:
    return rounded(P.interval_totals(_spread(spark, where), "user_id", ["active", "rate"]))


@query(
    "interval_difference_daily",
    f"WITH {EV}, {SPINE}, {EXPANDED} SELECT user_id, date, active, round(rate, 6) + 0.0 AS rate FROM spread",
)
def interval_difference_daily(spark: SparkSession, where: str) -> DataFrame:
    fills = events(spark, where).where(F.col("event_type") == "purchase")
    measures = {"active": F.lit(1), "rate": spend_rate()}
    return rounded(interval_days(fills, "user_id", "date", days_supply(), measures, START, END))


@query(
    "interval_difference_panel",
    f"""WITH {DENSE}, {EXPANDED} SELECT user_id, CAST(date - DATE '{START}' AS INTEGER) AS time, TS_CLMLINES_VIEW AS views,
      CAST(coalesce(active, 0) AS BIGINT) AS active, round(coalesce(rate, 0), 6) + 0.0 AS rate
    FROM dense LEFT JOIN spread USING (user_id, date)""",
)
def interval_difference_panel(spark: SparkSession, where: str) -> DataFrame:
    panel = P.build_panel(
        events(spark, where),
        "user_id",
        "date",
        START,
        END,
        sums={"views": yes(F.col("event_type") == "view")},
        spans={"active": F.lit(1), "rate": spend_rate()},
        span_filter=F.col("event_type") == "purchase",
        span_days=days_supply(),
    )
    days = panel.select("user_id", F.posexplode(F.arrays_zip("views", "active", "rate")).alias("time", "at"))
    return rounded(days.select("user_id", "time", "at.views", "at.active", "at.rate"))


@query(
    "long_daily_panel",
    f"""WITH {DENSE}, {EXPANDED}
    SELECT user_id, date, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in EVENT_SERIES)},
      CAST(coalesce(active, 0) AS BIGINT) AS active, round(coalesce(rate, 0), 6) + 0.0 AS rate
    FROM dense LEFT JOIN spread USING (user_id, date)""",
)
def long_daily_panel(spark: SparkSession, where: str) -> DataFrame:
    points = add_measures(events(spark, where), event_measures()).select("user_id", "date", *EVENT_SERIES)
    measures = [*EVENT_SERIES, "active", "rate"]
    daily = P.combine_daily(points, _spread(spark, where), "user_id", sums=measures)
    return rounded(P.densify(daily, "user_id", "date", measures, START, END))


@query(
    "panel_exploded",
    f"WITH {LONG} SELECT user_id, kind, t AS time, x AS value FROM long",
)
def panel_exploded(spark: SparkSession, where: str) -> DataFrame:
    return P.panel_to_long(event_panel(spark, where), "user_id", SERIES)


@query(
    "panel_running_max",
    f"""WITH {EV}, {SPINE}, top AS (SELECT user_id, date, max(k) AS k FROM ev GROUP BY user_id, date)
    SELECT user_id, CAST(date - DATE '{START}' AS INTEGER) AS time,
      coalesce(max(k) OVER (PARTITION BY user_id ORDER BY date), 0) AS top_k
    FROM ids CROSS JOIN spine LEFT JOIN top USING (user_id, date)""",
)
def panel_running_max(spark: SparkSession, where: str) -> DataFrame:
    panel = P.build_panel(
        events(spark, where), "user_id", "date", START, END, sums={}, maxes={"top_k": F.col("k")}, carried=["top_k"]
    )
    return panel.select("user_id", F.posexplode("top_k").alias("time", "top_k"))


@query(
    "panel_from_long",
    f"""WITH {DENSE} SELECT user_id, count(*) AS n_days,
    CAST(sum(TS_CLMLINES_CLICK * (date - DATE '{START}')) AS BIGINT) AS weighted_clicks,
    max_by(TS_CLMLINES_VIEW, date) AS last_views, min_by(TS_MME_UNITS, date) AS first_units
    FROM dense GROUP BY user_id""",
)
def panel_from_long(spark: SparkSession, where: str) -> DataFrame:
    long = daily_dense_counts(spark, where)
    panel = P.collect_series(long, "user_id", "date", SERIES)
    weighted = F.aggregate(
        F.transform("TS_CLMLINES_CLICK", lambda v, i: v * i), F.lit(0).cast("long"), lambda a, v: a + v
    )
    return panel.select(
        "user_id",
        F.size("TS_CLMLINES_CLICK").cast("long").alias("n_days"),
        weighted.alias("weighted_clicks"),
        F.element_at("TS_CLMLINES_VIEW", -1).alias("last_views"),
        F.element_at("TS_MME_UNITS", 1).alias("first_units"),
    )


@query(
    "status_panel",
    f"""WITH {EV}, {SPINE}, seen AS (SELECT DISTINCT user_id, date FROM ev WHERE event_type = 'error' OR value > 50)
    SELECT user_id, CAST(date - DATE '{START}' AS INTEGER) AS time,
      CASE WHEN seen.user_id IS NULL THEN 0 ELSE 1 END AS status
    FROM ids CROSS JOIN spine LEFT JOIN seen USING (user_id, date)""",
)
def status_panel(spark: SparkSession, where: str) -> DataFrame:
    status = yes((F.col("event_type") == "error") | (F.col("value") > 50))
    panel = P.build_panel(events(spark, where), "user_id", "date", START, END, sums={}, maxes={"status": status})
    return panel.select("user_id", F.posexplode("status").alias("time", "status"))


@query(
    "narrowed_panel",
    f"""WITH {DENSE} SELECT user_id, CAST(date - DATE '{START}' AS INTEGER) AS time,
    CAST(TS_CLMLINES_CLICK AS INTEGER) AS clicks, CAST(TS_MME_UNITS AS DOUBLE) AS units FROM dense""",
)
def narrowed_panel(spark: SparkSession, where: str) -> DataFrame:
    narrow = narrow_arrays(event_panel(spark, where))
    both = F.arrays_zip("TS_CLMLINES_CLICK", "TS_MME_UNITS")
    return narrow.select("user_id", F.posexplode(both).alias("time", "at")).select(
        "user_id",
        "time",
        F.col("at.TS_CLMLINES_CLICK").cast("int").alias("clicks"),
        F.col("at.TS_MME_UNITS").cast("double").alias("units"),
    )


@query(
    "panel_grown",
    f"""WITH {DENSE}, {EXPANDED}, top AS (SELECT user_id, date, max(k) AS k FROM ev GROUP BY user_id, date)
    SELECT user_id, CAST(date - DATE '{START}' AS INTEGER) AS time, TS_CLMLINES_VIEW AS views,
      coalesce(max(k) OVER (PARTITION BY user_id ORDER BY date), 0) AS top_k,
      CAST(coalesce(active, 0) AS BIGINT) AS active, round(coalesce(rate, 0), 6) + 0.0 AS rate
    FROM dense LEFT JOIN spread USING (user_id, date) LEFT JOIN top USING (user_id, date)""",
)
def panel_grown(spark: SparkSession, where: str) -> DataFrame:
    """Two windows that overlap by three days, built apart and merged: as if built at once."""
    old, new = (START, "2024-01-12"), ("2024-01-10", END)

    def built(window: tuple[str, str]) -> DataFrame:
        return P.build_panel(
            events(spark, where),
            "user_id",
            "date",
            *window,
            sums={"views": yes(F.col("event_type") == "view")},
            maxes={"top_k": F.col("k")},
            spans={"active": F.lit(1), "rate": spend_rate()},
            span_filter=F.col("event_type") == "purchase",
            span_days=days_supply(),
            carried=["top_k"],
        )

    cols = ["views", "top_k", "active", "rate"]
    merged = merge_panels(built(old), built(new), "user_id", cols, old, new, carried=["top_k"])
    days = merged.select("user_id", F.posexplode(F.arrays_zip(*cols)).alias("time", "at"))
    return rounded(days.select("user_id", "time", *[f"at.{c}" for c in cols]))


@query(
    "melt_wide",
    """SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS variable,
    unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem""",
)
def melt_wide(spark: SparkSession, where: str) -> DataFrame:
    return P.melt(
        load(spark, where, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"]
    )


@query(
    "pivot_features",
    f"""WITH {EV} SELECT user_id, {", ".join(
        f"CAST(sum(CASE WHEN event_type = '{v}' THEN floor(value) END) AS BIGINT) AS {v}" for v in EVENT_SERIES.values())}
    FROM ev GROUP BY user_id""",
)
def pivot_features(spark: SparkSession, where: str) -> DataFrame:
    long = events(spark, where).withColumn("units", F.floor("value"))
    return pivot_long(long, "user_id", "event_type", "units", list(EVENT_SERIES.values()))


@query(
    "running_distinct_daily",
    f"""WITH {EV}, firsts AS (SELECT user_id, event_id % 7 AS provider, min(date) AS date FROM ev GROUP BY 1, 2),
    fresh AS (SELECT user_id, date, count(*) AS n FROM firsts GROUP BY 1, 2),
    days AS (SELECT DISTINCT user_id, date FROM ev)
    SELECT user_id, date, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY user_id ORDER BY date) AS BIGINT) AS providers
    FROM days LEFT JOIN fresh USING (user_id, date)""",
)
def running_distinct_daily(spark: SparkSession, where: str) -> DataFrame:
    lines = events(spark, where).withColumn("provider", F.col("event_id") % 7)
    return P.running_distinct(lines, "user_id", "date", "provider", "providers")


@query(
    "distinct_set_size",
    f"WITH {EV} SELECT user_id, count(DISTINCT event_id % 7) AS providers FROM ev GROUP BY user_id",
)
def distinct_set_size(spark: SparkSession, where: str) -> DataFrame:
    return events(spark, where).groupBy("user_id").agg(F.countDistinct(F.col("event_id") % 7).alias("providers"))


@query(
    "running_max_daily",
    f"""WITH {EV}, top AS (SELECT user_id, date, max(value) AS v FROM ev GROUP BY 1, 2)
    SELECT user_id, date, max(v) OVER (PARTITION BY user_id ORDER BY date) AS top_value FROM top""",
)
def running_max_daily(spark: SparkSession, where: str) -> DataFrame:
    return P.running_max(events(spark, where), "user_id", "date", "value", "top_value")


@query(
    "replicate_rows",
    "SELECT o_orderkey, copy FROM orders, unnest(range(1, CAST(o_orderkey % 4 AS BIGINT) + 1)) t(copy)",
)
def replicate_rows(spark: SparkSession, where: str) -> DataFrame:
    orders = load(spark, where, "orders").select("o_orderkey")
    copies = P.replicate(orders, (F.col("o_orderkey") % 4).cast("int"))
    number = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return copies.groupBy("o_orderkey").agg(F.count("*").alias("copies")).select("o_orderkey", number.alias("copy"))


@query(
    "entity_sample",
    f"""WITH {EV} SELECT event_id, user_id FROM ev
    WHERE ('0x' || substr(md5(concat_ws('#', CAST(user_id AS VARCHAR), '42')), 1, 13))::BIGINT / 4503599627370496.0 < 0.4""",
)
def entity_sample_query(spark: SparkSession, where: str) -> DataFrame:
    return entity_sample(events(spark, where), "user_id", 0.4, seed=42).select("event_id", "user_id")


@query(
    "split_mod20",
    """SELECT CASE WHEN c_custkey % 20 < 14 THEN 'train' WHEN c_custkey % 20 < 18 THEN 'val' ELSE 'test' END AS split,
    count(*) AS n, min(c_custkey) AS first_key, round(sum(c_acctbal), 4) + 0.0 AS balance FROM customer GROUP BY 1""",
)
def split_mod20(spark: SparkSession, where: str) -> DataFrame:
    parts = split_by_mod(load(spark, where, "customer"), "c_custkey").groupBy("split")
    return parts.agg(
        F.count("*").alias("n"), F.min("c_custkey").alias("first_key"), r(F.sum("c_acctbal"), 4).alias("balance")
    )


@query(
    "date_range_filter",
    """SELECT user_id, count(*) AS n FROM events
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21' GROUP BY user_id""",
)
def date_range_filter(spark: SparkSession, where: str) -> DataFrame:
    inside = (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (
        F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz")
    )
    return load(spark, where, "events").where(inside).groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "panel_with_target",
    f"""WITH {DENSE}, {TARGETS} SELECT user_id, target,
    CAST(sum(TS_CLMLINES_CLICK) AS BIGINT) AS clicks, CAST(sum(TS_CLMLINES_PURCHASE) AS BIGINT) AS purchases
    FROM dense JOIN targets USING (user_id) GROUP BY user_id, target""",
)
def panel_with_target(spark: SparkSession, where: str) -> DataFrame:
    def added(name: str):
        return F.aggregate(name, F.lit(0).cast("long"), lambda a, v: a + v)

    panel = event_panel(spark, where).join(targets(spark, where), "user_id")
    return panel.select(
        "user_id",
        "target",
        added("TS_CLMLINES_CLICK").alias("clicks"),
        added("TS_CLMLINES_PURCHASE").alias("purchases"),
    )
