"""Labels, eligibility, exclusions, lookups, recodes and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.functions import columns as C
from daypanel.operators import cohort as K
from daypanel.operators.encoding import encode_table, one_hot
from daypanel.plans.registry import query, rounded
from daypanel.plans.standins import EV, events
from daypanel.sources.tables import load

# Code columns of an event line: its type, and two codes derived from its number.
_CODES_SQL = """codes AS (SELECT event_id, user_id, CAST(ts AS DATE) AS date, value, event_type AS code1,
  'D' || CAST(event_id % 11 AS VARCHAR) AS code2,
  CASE WHEN event_id % 3 = 0 THEN 'E' || CAST(event_id % 17 AS VARCHAR) END AS code3 FROM events)"""
_LISTED = ["error", "D4", "E9", "E15"]
_LISTED_SQL = ", ".join(f"'{c}'" for c in _LISTED)


def _coded(spark: SparkSession, where: str) -> DataFrame:
    return events(spark, where).select(
        "event_id",
        "user_id",
        "date",
        "value",
        F.col("event_type").alias("code1"),
        F.concat(F.lit("D"), (F.col("event_id") % 11).cast("string")).alias("code2"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("E"), (F.col("event_id") % 17).cast("string"))).alias("code3"),
    )


@query(
    "label_any_code",
    f"""WITH {_CODES_SQL} SELECT user_id, max(CASE WHEN (code1 IN ({_LISTED_SQL}) OR code2 IN ({_LISTED_SQL}) OR code3 IN ({_LISTED_SQL}))
      AND date BETWEEN DATE '2024-01-20' AND DATE '2024-01-30' AND value > 60 THEN 1 ELSE 0 END) AS target
    FROM codes GROUP BY user_id""",
)
def label_any_code(spark: SparkSession, where: str) -> DataFrame:
    labelled = K.label_events(
        _coded(spark, where),
        ["code1", "code2", "code3"],
        _LISTED,
        "date",
        "2024-01-20",
        "2024-01-30",
        extra=F.col("value") > 60,
    )
    return K.label_entities(labelled, "user_id")


@query(
    "label_event_lines",
    f"""WITH {_CODES_SQL} SELECT event_id, CASE WHEN (code1 IN ({_LISTED_SQL}) OR code2 IN ({_LISTED_SQL}) OR code3 IN ({_LISTED_SQL}))
      AND date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND code3 NOT IN ('E3') THEN 1 ELSE 0 END AS target FROM codes""",
)
def label_event_lines(spark: SparkSession, where: str) -> DataFrame:
    labelled = K.label_events(
        _coded(spark, where),
        ["code1", "code2", "code3"],
        _LISTED,
        "date",
        "2024-01-10",
        "2024-01-20",
        extra=K.not_in_codes("code3", ["E3"]),
    )
    return labelled.select("event_id", "target")


_MONTHS_SQL = """months AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS month,
  bool_or(o_orderstatus <> 'P') AS enrolled, max(o_totalprice) AS top FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1, 2)"""


def _months(spark: SparkSession, where: str) -> DataFrame:
    orders = load(spark, where, "orders").where(
        F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))
    )
    return orders.select(
        "o_custkey",
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"),
        (F.col("o_orderstatus") != "P").alias("enrolled"),
        "o_totalprice",
    )


@query(
    "eligible_months",
    f"""WITH {_MONTHS_SQL} SELECT o_custkey, count(*) FILTER (WHERE enrolled) AS months FROM months GROUP BY o_custkey
    HAVING count(*) FILTER (WHERE enrolled) >= 3 OR (count(*) FILTER (WHERE enrolled) = 2 AND max(top) > 300000)""",
)
def eligible_months(spark: SparkSession, where: str) -> DataFrame:
    kept = K.eligible_entities(
        _months(spark, where),
        "o_custkey",
        "month",
        F.col("enrolled"),
        min_months=3,
        also=[(2, F.col("o_totalprice") > 300000)],
        carried=["o_totalprice"],
    )
    return kept.select("o_custkey", "months")


@query(
    "eligible_by_ordinal",
    f"""WITH {_MONTHS_SQL}, numbered AS (SELECT o_custkey, enrolled, row_number() OVER (PARTITION BY o_custkey ORDER BY month) AS rn FROM months)
    SELECT DISTINCT o_custkey FROM numbered WHERE enrolled AND rn = 3""",
)
def eligible_by_ordinal(spark: SparkSession, where: str) -> DataFrame:
    return K.eligible_entities(
        _months(spark, where), "o_custkey", "month", F.col("enrolled"), min_months=3, literal=True
    )


@query(
    "month_ordinals",
    f"""WITH {_MONTHS_SQL} SELECT o_custkey, CAST(month AS DATE) AS month,
    CASE WHEN enrolled THEN CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY month) AS INTEGER) END AS ordinal FROM months""",
)
def month_ordinals(spark: SparkSession, where: str) -> DataFrame:
    return K.month_ordinals(_months(spark, where), "o_custkey", "month", F.col("enrolled"), "ordinal")


@query(
    "conditional_line_count",
    """SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 10) AS n FROM lineitem GROUP BY l_orderkey""",
)
def conditional_line_count(spark: SparkSession, where: str) -> DataFrame:
    hit = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 10)
    return K.count_lines(load(spark, where, "lineitem"), "l_orderkey", hit)


@query("loose_line_count", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def loose_line_count(spark: SparkSession, where: str) -> DataFrame:
    return K.count_lines(load(spark, where, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", strict=False)


@query(
    "anti_exclusion",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN
    (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""",
)
def anti_exclusion(spark: SparkSession, where: str) -> DataFrame:
    urgent = load(spark, where, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    people = load(spark, where, "customer").select("c_custkey", "c_name")
    return K.exclude(people, urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    "semi_restriction",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN
    (SELECT o_custkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-10-01' AND TIMESTAMP '1998-10-31' AND o_orderpriority = '2-HIGH')""",
)
def semi_restriction(spark: SparkSession, where: str) -> DataFrame:
    orders = load(spark, where, "orders")
    index_month = F.col("o_orderdate").between(
        F.lit("1998-10-01").cast("timestamp_ntz"), F.lit("1998-10-31").cast("timestamp_ntz")
    )
    index = orders.where(index_month & (F.col("o_orderpriority") == "2-HIGH"))
    return K.restrict(orders.select("o_orderkey", "o_custkey", "o_totalprice"), index, "o_custkey")


@query(
    "validity_year_join",
    """WITH dim AS (SELECT p_partkey, p_brand, 1995 + p_size % 3 AS begin_yr, 1998 + p_size % 4 AS end_yr FROM part)
    SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN dim
    ON l_partkey = p_partkey AND year(l_shipdate) BETWEEN begin_yr AND end_yr""",
)
def validity_year_join(spark: SparkSession, where: str) -> DataFrame:
    dim = load(spark, where, "part").select(
        "p_partkey",
        "p_brand",
        (F.lit(1995) + F.col("p_size") % 3).alias("begin_yr"),
        (F.lit(1998) + F.col("p_size") % 4).alias("end_yr"),
    )
    lines = load(spark, where, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    joined = K.join_valid(lines, dim, "l_partkey", "p_partkey", F.year("l_shipdate"), "begin_yr", "end_yr")
    return joined.select("l_orderkey", "l_linenumber", "p_brand")


@query(
    "point_in_interval_join",
    """WITH spans AS (SELECT o_custkey AS c_custkey, o_orderpriority AS rank, CAST(o_orderdate AS DATE) AS b,
      CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS e FROM orders)
    SELECT c_custkey, max(rank) AS rank FROM customer LEFT JOIN (SELECT * FROM spans WHERE DATE '1998-10-31' BETWEEN b AND e) USING (c_custkey)
    GROUP BY c_custkey""",
)
def point_in_interval_join(spark: SparkSession, where: str) -> DataFrame:
    begin = F.col("o_orderdate").cast("date")
    spans = load(spark, where, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderpriority").alias("rank"),
        begin.alias("b"),
        F.date_add(begin, (F.col("o_orderkey") % 90).cast("int")).alias("e"),
    )
    people = load(spark, where, "customer").select("c_custkey")
    return K.join_active(people, spans, "c_custkey", F.lit("1998-10-31").cast("date"), "b", "e", ["rank"])


@query(
    "full_outer_flags",
    """WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' GROUP BY 1),
    b AS (SELECT o_custkey, count(*) AS m FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW' GROUP BY 1)
    SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN n IN (1, 3) THEN 1 ELSE 0 END AS CC_Open,
    CASE WHEN m IN (1, 3) THEN 1 ELSE 0 END AS CC_Finished FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey""",
)
def full_outer_flags(spark: SparkSession, where: str) -> DataFrame:
    orders = load(spark, where, "orders")
    a = orders.where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("OPN"))
    b = orders.where("o_orderstatus = 'F' AND o_orderpriority = '5-LOW'").groupBy("o_custkey").agg(F.count("*").alias("FIN"))
    both = K.full_outer(a, b, "o_custkey")
    return C.recode_flags(both, ["o_custkey"], {"OPN": "Open", "FIN": "Finished"})


@query(
    "dedupe_all_columns",
    """SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS rows_count FROM orders GROUP BY ALL""",
)
def dedupe_all_columns(spark: SparkSession, where: str) -> DataFrame:
    return K.dedupe_counting(load(spark, where, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query(
    "distinct_counts",
    """SELECT count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN event_type = 'error' AND value > 100 THEN user_id END) AS positive_users,
    count(DISTINCT CAST(ts AS DATE)) AS days FROM events""",
)
def distinct_counts(spark: SparkSession, where: str) -> DataFrame:
    positive = F.when((F.col("event_type") == "error") & (F.col("value") > 100), F.col("user_id"))
    return events(spark, where).agg(
        F.countDistinct("user_id").alias("users"),
        F.countDistinct(positive).alias("positive_users"),
        F.countDistinct("date").alias("days"),
    )


@query(
    "keyed_join_without_fanout",
    """WITH tops AS (SELECT l_orderkey, max(l_quantity) AS top FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, l_linenumber, l_suppkey, top FROM lineitem LEFT JOIN tops USING (l_orderkey)""",
)
def keyed_join_without_fanout(spark: SparkSession, where: str) -> DataFrame:
    lines = load(spark, where, "lineitem")
    tops = K.running_values_by_key(lines, ["l_orderkey"], "l_quantity").withColumnRenamed("l_quantity", "top")
    return lines.select("l_orderkey", "l_linenumber", "l_suppkey").join(tops, "l_orderkey", "left")


_BINS = [(0, 10.999, "0-10")] + [(lo + 1, lo + 10.999, f"{lo + 1}-{lo + 10}") for lo in range(10, 90, 10)] + [(91, 100, "91-100")]
_RANK_SQL = """CASE WHEN c_custkey % 50 = 7 THEN 'PH' WHEN c_custkey % 50 = 8 THEN 'GQ' WHEN c_custkey % 50 = 9 THEN 'ZZ'
  WHEN c_custkey % 50 = 10 THEN NULL ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) % 120 AS VARCHAR) || '.5' END"""


def _rank_text():
    place = F.col("c_custkey") % 50
    number = F.concat((F.floor("c_acctbal") % 120).cast("string"), F.lit(".5"))
    return (
        F.when(place == 7, "PH")
        .when(place == 8, "GQ")
        .when(place == 9, "ZZ")
        .when(place == 10, F.lit(None).cast("string"))
        .otherwise(number)
    )


@query(
    "static_bins",
    f"""WITH ranks AS (SELECT c_custkey, {_RANK_SQL} AS rank FROM customer), nums AS (SELECT *, TRY_CAST(rank AS DECIMAL(10,0)) AS v FROM ranks)
    SELECT c_custkey, rank, CASE {" ".join(f"WHEN v BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in _BINS)}
    WHEN rank IN ('PH', 'GQ', 'PH-GQ', 'QDI') THEN rank ELSE 'Unassigned' END AS rank_binned FROM nums""",
)
def static_bins(spark: SparkSession, where: str) -> DataFrame:
    ranks = load(spark, where, "customer").select("c_custkey", _rank_text().alias("rank"))
    return ranks.withColumn("rank_binned", C.bin_labels(F.col("rank"), _BINS, ["PH", "GQ", "PH-GQ", "QDI"]))


@query(
    "bounded_or_null",
    "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN p_size END AS small_size FROM part",
)
def bounded_or_null(spark: SparkSession, where: str) -> DataFrame:
    return load(spark, where, "part").select("p_partkey", C.bounded(F.col("p_size"), 1, 10).alias("small_size"))


@query(
    "median_impute",
    """WITH holes AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS size,
      CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS brand FROM part)
    SELECT p_partkey, coalesce(size, (SELECT quantile_disc(size, 0.5) FROM holes)) AS size, coalesce(brand, 'Unassigned') AS brand FROM holes""",
)
def median_impute(spark: SparkSession, where: str) -> DataFrame:
    holes = load(spark, where, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_size")).alias("size"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("brand"),
    )
    return C.fill_median(holes.na.fill({"brand": "Unassigned"}), ["size"])


@query(
    "static_attribute_per_entity",
    "SELECT o_custkey, max(o_orderpriority) AS o_orderpriority, max(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey",
)
def static_attribute_per_entity(spark: SparkSession, where: str) -> DataFrame:
    return K.first_per_entity(load(spark, where, "orders"), "o_custkey", ["o_orderpriority", "o_totalprice"])


@query(
    "service_flags",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A', 'R') THEN 1 ELSE 0 END AS returned,
    CASE WHEN l_linestatus = 'O' AND l_returnflag IN ('N') THEN 1 ELSE 0 END AS open_kept FROM lineitem""",
)
def service_flags(spark: SparkSession, where: str) -> DataFrame:
    guard = F.col("l_linestatus") == "O"
    flags = {
        "returned": C.yes(C.in_codes("l_returnflag", ["A", "R"])),
        "open_kept": C.yes(guard & C.in_codes("l_returnflag", ["N"])),
    }
    return C.add_measures(load(spark, where, "lineitem"), flags).select("l_orderkey", "l_linenumber", *flags)


@query(
    "like_flags",
    """SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' AND p_name NOT LIKE '%small%' THEN p_retailprice ELSE 0 END AS ring_price,
    CASE WHEN p_brand IN ('Brand#1', 'Brand#2') OR (p_type = 'PROMO' AND p_name LIKE '%bolt%') THEN 1 ELSE 0 END AS listed FROM part""",
)
def like_flags(spark: SparkSession, where: str) -> DataFrame:
    measures = {
        "ring_price": "CASE WHEN p_name LIKE '%ring%' AND p_name NOT LIKE '%small%' THEN p_retailprice ELSE 0 END",
        "listed": C.yes(
            C.in_codes("p_brand", ["Brand#1", "Brand#2"]) | ((F.col("p_type") == "PROMO") & F.col("p_name").like("%bolt%"))
        ),
    }
    return C.add_measures(load(spark, where, "part"), measures).select("p_partkey", *measures)


@query(
    "guarded_rate",
    f"""WITH {EV} SELECT event_id, round(CASE WHEN k % 5 <> 0 THEN value / (k % 5) * 1.5 END, 6) + 0.0 AS dose,
    round(CASE WHEN event_type = 'view' AND k % 5 <> 0 THEN value / (k % 5) END, 6) + 0.0 AS quantity FROM ev""",
)
def guarded_rate(spark: SparkSession, where: str) -> DataFrame:
    days = F.pmod(F.col("k"), F.lit(5))
    return rounded(
        events(spark, where).select(
            "event_id",
            C.daily_rate(F.col("value"), days, F.lit(1.5)).alias("dose"),
            F.when(F.col("event_type") == "view", C.daily_rate(F.col("value"), days)).alias("quantity"),
        )
    )


@query(
    "age_in_years",
    """SELECT o_orderkey, CAST(round((DATE '2020-12-31' - CAST(o_orderdate AS DATE)) / 365.25::DOUBLE) AS INTEGER) AS age FROM orders""",
)
def age_in_years(spark: SparkSession, where: str) -> DataFrame:
    at = F.lit("2020-12-31").cast("date")
    return load(spark, where, "orders").select("o_orderkey", C.age_at(F.col("o_orderdate").cast("date"), at).alias("age"))


@query(
    "outlier_trim",
    """SELECT c_custkey, round((c_acctbal - 65) / 100, 6) + 0.0 AS balance_scaled FROM customer WHERE round(c_acctbal, 0) <= 5000""",
)
def outlier_trim(spark: SparkSession, where: str) -> DataFrame:
    kept = C.trim_outliers(load(spark, where, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": 5000})
    return rounded(C.rescale(kept, "c_acctbal", "balance_scaled", minus=65.0, over=100.0))


@query(
    "column_selection",
    """SELECT c_custkey AS bene_id, c_acctbal AS TS_X__mean, CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END AS CC_Even,
    c_mktsegment AS STATIC_segment FROM customer""",
)
def column_selection(spark: SparkSession, where: str) -> DataFrame:
    wide = load(spark, where, "customer").select(
        F.col("c_custkey").alias("bene_id"),
        C.yes(F.col("c_nationkey") % 2 == 0).alias("CC_Even"),
        C.yes(F.col("c_nationkey") % 3 == 0).alias("CC_Opioid_any"),
        F.col("c_mktsegment").alias("STATIC_segment"),
        F.col("c_acctbal").alias("TS_X__mean"),
        (F.col("c_acctbal") * 2).alias("TS_X__variance"),
        F.col("c_name").alias("note"),
    )
    return C.keep_columns(wide, always=["bene_id", "target"], series=["__mean"])


_VOCABULARY = {
    "o_orderpriority": ["5-LOW", "1-URGENT", "4-NOT SPECIFIED", "2-HIGH", "3-MEDIUM"],
    "o_orderstatus": ["P", "F", "O"],
}
_HOT_SQL = ", ".join(
    f"CAST({c} = '{v}' AS DOUBLE) AS {c}_{C.snake_label(v)}" for c, values in _VOCABULARY.items() for v in values
)


@query("one_hot_fixed", f"SELECT o_orderkey, {_HOT_SQL} FROM orders")
def one_hot_fixed(spark: SparkSession, where: str) -> DataFrame:
    orders = load(spark, where, "orders").select("o_orderkey", *_VOCABULARY)
    return one_hot(orders, _VOCABULARY)


@query(
    "encoded_table",
    f"""SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey, {_HOT_SQL},
    CAST(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS DOUBLE) AS labels FROM orders WHERE o_orderkey % 13 <> 0""",
)
def encoded_table(spark: SparkSession, where: str) -> DataFrame:
    orders = load(spark, where, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")).alias("o_custkey"),
        "o_orderdate",
        *_VOCABULARY,
        C.yes(F.col("o_totalprice") > 400000).alias("target"),
    )
    return encode_table(orders, "o_orderkey", "target", _VOCABULARY, drop=["o_orderdate"])


@query(
    "renamed_columns",
    """SELECT c_custkey AS cust_key, c_acctbal AS bal_q_01, c_mktsegment AS segment FROM customer""",
)
def renamed_columns(spark: SparkSession, where: str) -> DataFrame:
    odd = load(spark, where, "customer").select(
        F.col("c_custkey").alias("cust_key"), F.col("c_acctbal").alias("bal_q_0.1"), F.col("c_mktsegment").alias("(segment)")
    )
    return C.rename_all(odd)


@query(
    "leakage_drop",
    "SELECT c_custkey, c_mktsegment FROM customer",
)
def leakage_drop(spark: SparkSession, where: str) -> DataFrame:
    return C.drop_listed(load(spark, where, "customer"), ["c_name", "c_nationkey", "c_acctbal"])


@query(
    "complete_rows",
    """SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL""",
)
def complete_rows(spark: SparkSession, where: str) -> DataFrame:
    joined = load(spark, where, "documents").select("doc_id").join(load(spark, where, "labels"), "doc_id", "left")
    return joined.select("doc_id", "quality").na.drop()
