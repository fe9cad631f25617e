"""The given tables in the roles of event lines, panel, scores and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.functions.columns import daily_rate, yes
from daypanel.operators.panel import build_panel
from daypanel.sources.tables import load

START, END = "2024-01-01", "2024-01-24"
TAIL = 7

EVENT_SERIES = {
    "TS_CLMLINES_CLICK": "click",
    "TS_CLMLINES_VIEW": "view",
    "TS_CLMLINES_SIGNUP": "signup",
    "TS_CLMLINES_PURCHASE": "purchase",
    "TS_CLMLINES_ERROR": "error",
}
SERIES = [*EVENT_SERIES, "TS_MME_UNITS"]

EV = """ev AS (SELECT event_id, user_id, CAST(ts AS DATE) AS date, event_type, value,
  CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)"""
SPINE = f"""spine AS (SELECT CAST(d AS DATE) AS date
  FROM generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY) t(d)),
ids AS (SELECT DISTINCT user_id FROM events)"""
DENSE = f"""{EV}, {SPINE},
daily AS (SELECT user_id, date,
  {", ".join(f"count(*) FILTER (WHERE event_type = '{v}') AS {k}" for k, v in EVENT_SERIES.items())},
  CAST(sum(floor(value)) AS BIGINT) AS TS_MME_UNITS
  FROM ev GROUP BY user_id, date),
dense AS (SELECT user_id, date, {", ".join(f"coalesce({c}, 0) AS {c}" for c in SERIES)}
  FROM ids CROSS JOIN spine LEFT JOIN daily USING (user_id, date))"""
LONG = f"""{DENSE},
long AS (SELECT user_id, kind, CAST(date - DATE '{START}' AS INTEGER) AS t, CAST(x AS DOUBLE) AS x
  FROM (SELECT user_id, date, unnest([{", ".join(f"'{c}'" for c in SERIES)}]) AS kind,
        unnest([{", ".join(SERIES)}]) AS x FROM dense))"""
STATS = f"""{LONG},
stats AS (SELECT user_id, kind, count(*) AS n, sum(x) / count(*) AS mu, min(x) AS lo, max(x) AS hi
  FROM long GROUP BY user_id, kind)"""
SCORED = """scored AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.toxic,
  l.quality AS label, d.n_chars / (d.n_chars + 4000.0::DOUBLE) AS score
  FROM documents d JOIN labels l USING (doc_id))"""
CURVE = f"""{SCORED},
pts AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
curve AS (SELECT score AS threshold, pos, neg,
  sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS q FROM pts)"""
TARGETS = f"""targets AS (SELECT user_id,
  max(CASE WHEN event_type = 'error' AND value > 100 AND CAST(ts AS DATE) >= DATE '2024-01-25'
      THEN 1 ELSE 0 END) AS target FROM events GROUP BY user_id)"""


def events(spark: SparkSession, where: str) -> DataFrame:
    df = load(spark, where, "events")
    return df.select(
        "event_id",
        "user_id",
        F.col("ts").cast("date").alias("date"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def days_supply() -> Column:
    return F.pmod(F.col("k"), F.lit(5))


def event_measures() -> dict[str, Column]:
    counts = {name: yes(F.col("event_type") == kind) for name, kind in EVENT_SERIES.items()}
    return {**counts, "TS_MME_UNITS": F.floor("value")}


def event_panel(spark: SparkSession, where: str) -> DataFrame:
    """One row per user with the arrays named in SERIES."""
    return build_panel(events(spark, where), "user_id", F.col("date"), START, END, sums=event_measures())


def spend_rate() -> Column:
    return daily_rate(F.col("value"), days_supply())


def targets(spark: SparkSession, where: str) -> DataFrame:
    hit = (F.col("event_type") == "error") & (F.col("value") > 100) & (F.col("date") >= "2024-01-25")
    return events(spark, where).groupBy("user_id").agg(F.max(yes(hit)).alias("target"))


def scored(spark: SparkSession, where: str) -> DataFrame:
    documents = load(spark, where, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = load(spark, where, "labels")
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(4000.0))
    return documents.join(labels, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "toxic", F.col("quality").alias("label"), score.alias("score")
    )


def vectors(spark: SparkSession, where: str) -> DataFrame:
    """Embeddings with a rare label: 1 for one of ten classes."""
    return load(spark, where, "embeddings").select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("vector"),
        yes(F.col("label") == 9).alias("label"),
    )
