"""Tables written to the shared folder in each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.operators import evaluation as V
from daypanel.operators.ordered import stored_in_order
from daypanel.plans.registry import query, rounded
from daypanel.plans.standins import DENSE, SCORED, event_panel, events, scored
from daypanel.sources import tables as T


def _folder(spark: SparkSession, name: str) -> str:
    return f"{T.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "split_filtered_scan",
    """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 20 < 14""",
)
def split_filtered_scan(spark: SparkSession, where: str) -> DataFrame:
    """The training part through CSV and back; the split is the feature."""
    train = T.load(spark, where, "customer").where("pmod(c_custkey, 20) < 14").select("c_custkey", "c_name", "c_acctbal")
    path = T.save_csv(train, _folder(spark, "csv"))
    return T.read_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("csv_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, where: str) -> DataFrame:
    """The whole table through CSV and back."""
    customer = T.load(spark, where, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = T.save_csv(customer, _folder(spark, "csv"))
    return T.read_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query(
    "parquet_overwrite",
    "SELECT c_custkey, c_acctbal * 2 AS doubled FROM customer",
)
def parquet_overwrite(spark: SparkSession, where: str) -> DataFrame:
    customer = T.load(spark, where, "customer")
    path = T.save_files(customer.select("c_custkey", "c_name"), _folder(spark, "parquet"))
    T.save_files(customer.select("c_custkey", (F.col("c_acctbal") * 2).alias("doubled")), path)
    return spark.read.parquet(path)


@query(
    "bucketed_panel_join",
    f"""WITH {DENSE}, made AS (SELECT user_id, count(*) AS n_events, round(max(value), 6) + 0.0 AS top_value FROM ev GROUP BY user_id)
    SELECT user_id, CAST(sum(TS_CLMLINES_CLICK) AS BIGINT) AS clicks, max_by(TS_CLMLINES_VIEW, date) AS last_views, n_events, top_value
    FROM dense JOIN made USING (user_id) GROUP BY user_id, n_events, top_value""",
)
def bucketed_panel_join(spark: SparkSession, where: str) -> DataFrame:
    """A catalog table overwritten with another schema, bucketed by user, and joined to features stored alike."""
    return rounded(joined_buckets(spark, where))


def joined_buckets(spark: SparkSession, where: str, buckets: int = 8) -> DataFrame:
    name = uuid.uuid4().hex
    panel = event_panel(spark, where)
    T.save_table(panel.select("user_id", "TS_CLMLINES_CLICK"), f"panel_{name}", bucket_by="user_id", buckets=buckets)
    wider = panel.select("user_id", "TS_CLMLINES_CLICK", "TS_CLMLINES_VIEW")
    stored = T.load(spark, T.save_table(wider, f"panel_{name}", bucket_by="user_id", buckets=buckets))
    made = events(spark, where).groupBy("user_id").agg(F.count("*").alias("n_events"), F.max("value").alias("top_value"))
    features = T.load(spark, T.save_table(made, f"features_{name}", bucket_by="user_id", buckets=buckets))
    clicks = F.aggregate("TS_CLMLINES_CLICK", F.lit(0).cast("long"), lambda a, v: a + v)
    return stored.hint("merge").join(features, "user_id").select(
        "user_id", clicks.alias("clicks"), F.element_at("TS_CLMLINES_VIEW", -1).alias("last_views"), "n_events", "top_value"
    )


@query(
    "total_order",
    """SELECT c_custkey, c_acctbal, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS BIGINT) AS place FROM customer""",
)
def total_order(spark: SparkSession, where: str) -> DataFrame:
    """A table stored in one order over all its files, read back with each row's place."""
    customer = T.load(spark, where, "customer").select("c_custkey", "c_acctbal")
    return stored_in_order(customer, [F.desc("c_acctbal"), F.asc("c_custkey")], _folder(spark, "ordered"))


@query(
    "sorted_report",
    """WITH parts AS (SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 6) + 0.0 AS discount FROM lineitem GROUP BY 1, 2)
    SELECT *, CAST(row_number() OVER (ORDER BY n DESC, l_returnflag, l_linestatus) - 1 AS BIGINT) AS place FROM parts""",
)
def sorted_report(spark: SparkSession, where: str) -> DataFrame:
    lines = T.load(spark, where, "lineitem").groupBy("l_returnflag", "l_linestatus")
    report = rounded(lines.agg(F.count("*").alias("n"), F.avg("l_discount").alias("discount")))
    return stored_in_order(report, [F.desc("n"), F.asc("l_returnflag"), F.asc("l_linestatus")], _folder(spark, "sorted"))


@query(
    "report_round_trip",
    f"""WITH {SCORED}, parts AS (SELECT lang, count(*) AS n, avg((label - score) * (label - score)) AS b FROM scored GROUP BY lang
      UNION ALL SELECT 'all', count(*), avg((label - score) * (label - score)) FROM scored)
    SELECT lang AS "group", n, round(b, 6) + 0.0 AS brier FROM parts""",
)
def report_round_trip(spark: SparkSession, where: str) -> DataFrame:
    groups = {v: (F.col("lang") == v).cast("int") for v in ("en", "fr", "de", "es")}
    scores = V.brier_by_group(scored(spark, where), "label", "score", groups).drop("normalized")
    path = T.save_report(scores, _folder(spark, "report"))
    return rounded(T.read_report(spark, path, "`group` string, n bigint, brier double"))
