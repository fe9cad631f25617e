"""Class weights, upsampling, neighbours, link and neighbourhood cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.functions.columns import yes
from daypanel.operators import resample as B
from daypanel.operators.models import add_folds
from daypanel.operators.neighbours import nearest
from daypanel.operators.ordered import shuffled_places
from daypanel.plans.registry import query, rounded
from daypanel.plans.selection_queries import EVENT_SERIES, MATRIX, matrix
from daypanel.plans.standins import vectors
from daypanel.sources.tables import load

_NEAR = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN label = 9 THEN 1 ELSE 0 END AS label FROM embeddings),
near AS MATERIALIZED (SELECT a.vec_id AS id, b.vec_id AS neighbour, a.label AS label, b.label AS other, list_distance(a.e, b.e) AS d,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS place
  FROM v a JOIN v b ON a.vec_id <> b.vec_id)"""

# The nearest other vector of each, without a window over all pairs: the least of (distance, id).
_FIRST = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN label = 9 THEN 1 ELSE 0 END AS label FROM embeddings),
first AS MATERIALIZED (SELECT a.vec_id AS id, any_value(a.label) AS label,
  arg_min(b.vec_id, {'d': list_distance(a.e, b.e), 'i': b.vec_id}) AS neighbour
  FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)"""


@query("class_counts", "SELECT toxic, count(*) AS n FROM labels GROUP BY toxic")
def class_counts(spark: SparkSession, where: str) -> DataFrame:
    return B.class_counts(load(spark, where, "labels"), "toxic")


@query(
    "class_weights",
    """SELECT doc_id, toxic, round(CASE WHEN toxic = 1 THEN (SELECT count(*) FILTER (WHERE toxic <> 1) / count(*) FROM labels)
    ELSE 1 - (SELECT count(*) FILTER (WHERE toxic <> 1) / count(*) FROM labels) END, 6) + 0.0 AS weight FROM labels""",
)
def class_weights(spark: SparkSession, where: str) -> DataFrame:
    weighted = B.class_weights(load(spark, where, "labels"), "toxic", "weight")
    return rounded(weighted.select("doc_id", "toxic", "weight"))


@query(
    "replicate_minority",
    """WITH n AS (SELECT count(*) FILTER (WHERE toxic = 0) // count(*) FILTER (WHERE toxic = 1) AS times FROM labels)
    SELECT doc_id, toxic, CAST(CASE WHEN toxic = 1 THEN times ELSE 1 END AS BIGINT) AS copies FROM labels, n""",
)
def replicate_minority(spark: SparkSession, where: str) -> DataFrame:
    grown = B.upsample(load(spark, where, "labels"), "toxic")
    return grown.groupBy("doc_id", "toxic").agg(F.count("*").alias("copies"))


@query(
    "shuffled_upsample",
    """WITH n AS (SELECT count(*) FILTER (WHERE toxic = 0) // count(*) FILTER (WHERE toxic = 1) AS times FROM labels),
    grown AS (SELECT doc_id, toxic, unnest(range(1, CASE WHEN toxic = 1 THEN times ELSE 1 END + 1)) AS copy FROM labels, n),
    hashed AS (SELECT *, doc_id || ':' || copy AS id, ('0x' || substr(md5(doc_id || ':' || copy || '#17'), 1, 13))::BIGINT AS h FROM grown),
    placed AS (SELECT *, row_number() OVER (ORDER BY h, id) - 1 AS rn, count(*) OVER () AS total FROM hashed)
    SELECT doc_id, toxic, CAST(copy AS INTEGER) AS copy, CAST(rn * 5 // total AS INTEGER) AS file,
      CAST(rn - (rn * 5 // total * total + 4) // 5 AS BIGINT) AS place FROM placed""",
)
def shuffled_upsample(spark: SparkSession, where: str) -> DataFrame:
    """Upsampled rows dealt to five files in an order that repeats."""
    grown = B.upsample(load(spark, where, "labels").select("doc_id", "toxic"), "toxic")
    copies = grown.groupBy("doc_id", "toxic").agg(F.count("*").cast("int").alias("n"))
    rows = copies.select("doc_id", "toxic", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    keyed = rows.withColumn("id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("copy").cast("string")))
    return shuffled_places(keyed, "id", 17, 5).drop("id")


@query("nearest_neighbours", f"WITH {_NEAR} SELECT id, neighbour, CAST(place AS INTEGER) AS place, round(d, 6) + 0.0 AS distance FROM near WHERE place <= 5")
def nearest_neighbours(spark: SparkSession, where: str) -> DataFrame:
    return rounded(nearest(vectors(spark, where), "vec_id", "vector", 5))


@query(
    "tomek_links",
    f"""WITH {_FIRST} SELECT x.id AS a, x.neighbour AS b FROM first x JOIN first y ON y.id = x.neighbour AND y.neighbour = x.id
    WHERE x.id < x.neighbour AND x.label <> y.label""",
)
def tomek_links(spark: SparkSession, where: str) -> DataFrame:
    return B.tomek_links(vectors(spark, where), "vec_id", "label", "vector")


@query(
    "tomek_clean",
    f"""WITH {_FIRST}, links AS (SELECT x.id FROM first x JOIN first y ON y.id = x.neighbour AND y.neighbour = x.id WHERE x.label <> y.label)
    SELECT vec_id, label FROM v WHERE vec_id NOT IN (SELECT id FROM links)""",
)
def tomek_clean(spark: SparkSession, where: str) -> DataFrame:
    return B.remove_tomek(vectors(spark, where), "vec_id", "label", "vector").select("vec_id", "label")


@query(
    "enn_clean",
    f"""WITH {_NEAR}, bad AS (SELECT id FROM near WHERE place <= 3 AND label <> other)
    SELECT vec_id, label FROM v WHERE vec_id NOT IN (SELECT id FROM bad)""",
)
def enn_clean(spark: SparkSession, where: str) -> DataFrame:
    return B.remove_enn(vectors(spark, where), "vec_id", "label", "vector").select("vec_id", "label")


@query(
    "enn_clean_majority",
    f"""WITH {_NEAR}, bad AS (SELECT id FROM near WHERE place <= 3 GROUP BY id HAVING 2 * count(*) FILTER (WHERE label = other) <= count(*))
    SELECT vec_id, label FROM v WHERE vec_id NOT IN (SELECT id FROM bad)""",
)
def enn_clean_majority(spark: SparkSession, where: str) -> DataFrame:
    return B.remove_enn(vectors(spark, where), "vec_id", "label", "vector", rule="mode").select("vec_id", "label")


def _mixed(spark: SparkSession, where: str) -> DataFrame:
    return matrix(spark, where).select(
        "user_id", "target", *EVENT_SERIES, "TS_UNITS", yes(F.col("user_id") % 3 == 0).alias("CC_Third")
    )


_NUMERIC = [*EVENT_SERIES, "TS_UNITS"]
_MIXED = [*_NUMERIC, "CC_Third"]


def _hash(key: str, seed: int) -> str:
    return f"('0x' || substr(md5({key} || '#{seed}'), 1, 13))::BIGINT / 4503599627370496.0"


def _apart(a: str, b: str, scale: str) -> str:
    """Distance with the squares added in the order of the columns; the 0/1 column is scaled."""
    gaps = [f"({a}.{c} - {b}.{c})" for c in _NUMERIC] + [f"({a}.CC_Third * {scale} - {b}.CC_Third * {scale})"]
    total = "0.0::DOUBLE"
    for gap in gaps:
        total = f"({total} + {gap} * {gap})"
    return f"sqrt({total})"


_LIST = ", ".join(_MIXED)
# The seed of the draws is 2143; the neighbours of a base row are its five nearest in the minority.
_SMOTE = f"""{MATRIX},
mixed AS (SELECT user_id, target, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _NUMERIC)},
  CASE WHEN user_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS CC_Third FROM matrix),
rare AS MATERIALIZED (SELECT * FROM mixed WHERE target = 1),
sizes AS (SELECT count(*) FILTER (WHERE target = 1) AS few, count(*) FILTER (WHERE target = 0) - count(*) FILTER (WHERE target = 1) AS missing FROM mixed),
spread AS (SELECT median(s) / pow(2, 0.5) AS step FROM (SELECT unnest([{", ".join(f"stddev_pop({c})" for c in _NUMERIC)}]) AS s FROM rare)),
near AS MATERIALIZED (SELECT * FROM (SELECT a.user_id AS id, b.*, row_number() OVER (PARTITION BY a.user_id ORDER BY {_apart("a", "b", "step")}, b.user_id) AS place
  FROM rare a JOIN rare b ON a.user_id <> b.user_id, spread) WHERE place <= 5),
votes AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE CC_Third > 0) AS ones FROM near GROUP BY id),
numbered AS (SELECT *, row_number() OVER (ORDER BY {_hash("user_id", 2143)}, user_id) AS rn FROM rare),
drawn AS (SELECT *, user_id || ':' || copy AS draw FROM (SELECT *, unnest(range(1, missing // few + CASE WHEN rn <= missing % few THEN 1 ELSE 0 END + 1)) AS copy FROM numbered, sizes)),
synthetic AS (SELECT d.draw, {", ".join(f"d.{c} + {_hash('d.draw', 2144)} * (o.{c} - d.{c}) AS {c}" for c in _NUMERIC)},
  CASE WHEN v.ones * 2 > v.n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS CC_Third
  FROM drawn d JOIN votes v ON v.id = d.user_id JOIN near o ON o.id = d.user_id AND o.place = 1 + CAST(floor({_hash("d.draw", 2145)} * v.n) AS BIGINT)),
grown AS MATERIALIZED (SELECT 'o' || user_id AS key, user_id, target, {_LIST}, 0 AS synthetic FROM mixed
  UNION ALL SELECT 's' || draw, NULL, 1, {_LIST}, 1 FROM synthetic)"""
_SMOTE_COLUMNS = f"user_id, CAST(target AS INTEGER) AS target, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _MIXED)}, CAST(synthetic AS INTEGER) AS synthetic"
_GROWN_NEAR = f"""near_grown AS MATERIALIZED (SELECT * FROM (SELECT a.key AS key, b.key AS other, a.target AS label, b.target AS other_label,
  row_number() OVER (PARTITION BY a.key ORDER BY {_apart("a", "b", "1.0")}, b.key) AS place FROM grown a JOIN grown b ON a.key <> b.key) WHERE place <= 3)"""


@query("smote_nc", f"WITH {_SMOTE} SELECT {_SMOTE_COLUMNS} FROM grown")
def smote_nc(spark: SparkSession, where: str) -> DataFrame:
    return rounded(B.smote_nc(_mixed(spark, where), "user_id", "target", _NUMERIC, ["CC_Third"]))


@query(
    "smote_tomek",
    f"""WITH {_SMOTE}, {_GROWN_NEAR}, first AS (SELECT * FROM near_grown WHERE place = 1),
    ends AS (SELECT x.key FROM first x JOIN first y ON y.key = x.other AND y.other = x.key WHERE x.label <> x.other_label)
    SELECT {_SMOTE_COLUMNS} FROM grown WHERE key NOT IN (SELECT key FROM ends)""",
)
def smote_tomek(spark: SparkSession, where: str) -> DataFrame:
    """Oversampling followed by link removal."""
    return rounded(B.smote_tomek(_mixed(spark, where), "user_id", "target", _NUMERIC, ["CC_Third"]))


@query(
    "smote_enn",
    f"""WITH {_SMOTE}, {_GROWN_NEAR}, bad AS (SELECT key FROM near_grown WHERE label <> other_label)
    SELECT {_SMOTE_COLUMNS} FROM grown WHERE key NOT IN (SELECT key FROM bad)""",
)
def smote_enn(spark: SparkSession, where: str) -> DataFrame:
    """Oversampling followed by the removal of rows that their neighbours contradict."""
    return rounded(B.smote_enn(_mixed(spark, where), "user_id", "target", _NUMERIC, ["CC_Third"]))


@query(
    "stratified_folds",
    """WITH h AS (SELECT doc_id, quality, ('0x' || substr(md5(concat_ws('#', CAST(doc_id AS VARCHAR), '7')), 1, 13))::BIGINT AS h FROM labels)
    SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) - 1) % 3 AS INTEGER) AS fold FROM h""",
)
def stratified_folds(spark: SparkSession, where: str) -> DataFrame:
    labels = load(spark, where, "labels").select("doc_id", "quality")
    return add_folds(labels, "doc_id", "quality", 3, seed=7)
