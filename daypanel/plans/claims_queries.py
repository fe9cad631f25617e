"""The claims setting on tables derived from the given events and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.functions.columns import trim_outliers
from daypanel.operators import cohort as K
from daypanel.operators.encoding import encode_table, one_hot_names
from daypanel.operators.features import TAIL_DAYS, abridged_features
from daypanel.plans import claims as L
from daypanel.plans import fixed_values as V
from daypanel.plans.registry import query, r, rounded
from daypanel.plans.standins import EV, events
from daypanel.sources.spine import split_by_mod
from daypanel.sources.tables import load, written

def _pick(key: str, values: list[str], more: int = 0) -> str:
    """SQL that names one of the values by a whole number; `more` of its remainders name none."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values) + more} {cases} END"


_CODES = [c for codes in V.SERVICE_CODES.values() for c in codes] + V.BUPRENORPHINE_ORAL_CODES + V.NALOXONE_CODES

# How an event reads as a claim line, in SQL that both engines understand.
_LINE = {
    "bene_id": "user_id",
    "clm_id": "event_id",
    "line_num": "1",
    "srvc_dlvrd": f"""CASE event_type WHEN 'purchase' THEN concat('OXY', CAST(k % 8 AS STRING)) WHEN 'signup' THEN {_pick("event_id", _CODES)}
      WHEN 'view' THEN 'G2086' ELSE '99285' END""",
    "first_srvc_dt": "DATE '2020-10-10' + CAST(date - DATE '2024-01-01' AS INTEGER)",
    "prvdr_spclty": "CASE k % 4 WHEN 0 THEN '19' WHEN 1 THEN '62' WHEN 2 THEN '50' ELSE '01' END",
    "prvdr_id": "concat('p', CAST(event_id % 7 AS STRING))",
    "dgns_cd1": "CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'T400X1A' ELSE 'Z00' END",
    "dgns_cd5": "CASE WHEN k = 3 THEN 'F1110' END",
    "pymt_sys": "CASE WHEN event_type = 'purchase' THEN 'PTD-DRUG' ELSE 'OTHER' END",
    "srvc_vol": "floor(value) + 10",
    "clm_days": "k % 6",
    "bene_age": "60 + user_id % 20",
    "bene_death_dt": "CASE WHEN user_id % 10 = 3 THEN DATE '2020-11-20' END",
}
_DRUG = {
    "FDB_NDC": "concat('OXY', CAST(j AS STRING))",
    "BEGIN_YR": "2018",
    "END_YR": "2021",
    "FDB_GNN": _pick(
        "j",
        [
            "HYDROCODONE/ACETAMINOPHEN",
            "FENTANYL",
            "NALTREXONE HCL",
            "BUPRENORPHINE",
            "DIAZEPAM",
            "QUETIAPINE FUMARATE",
            "BUPRENORPHINE HCL/NALOXONE HCL",
            "NALOXONE HCL",
        ],
    ),
    "FDB_IND": "'Y'",
    "OMS_OPIOID_FLAG": "CASE WHEN j IN (0, 1, 3, 6, 7) THEN 'Y' ELSE 'N' END",
    "OMS_NALOXONE_FLAG": "CASE WHEN j = 7 THEN 'Y' ELSE 'N' END",
    "OMS_MAT_FLAG": "CASE WHEN j = 6 THEN 'Y' ELSE 'N' END",
    "OMS_BENZO_FLAG": "CASE WHEN j = 4 THEN 'Y' ELSE 'N' END",
    "ANTIPSYCH_FLAG": "CASE WHEN j = 5 THEN 'Y' ELSE 'N' END",
    "CDC_OPIOID_LA_SA_ACTING_FLAG": "CASE WHEN j = 1 THEN 'LA' WHEN j = 3 THEN 'SA' END",
    "OMS_MME_CONVERSION_FACTOR": "CAST(1.5 AS DOUBLE)",
    "OMS_OPIOID_STR": "CAST(100 * (j + 1) AS DOUBLE)",
}
# What else is known of a person.
_PERSON = {
    "birth_dt": "make_date(CAST(1930 + bene_id % 25 AS INTEGER), 6, 30)",
    "sex_desc": _pick("bene_id", V.VOCABULARY["STATIC_DEMO_sex_label"]),
    "state_cd": _pick("bene_id", V.VOCABULARY["STATIC_DEMO_state_cd"][:-1], more=6),
    "race_cd_desc": _pick("bene_id", V.VOCABULARY["STATIC_DEMO_race_label"]),
    "crec_desc": _pick("bene_id", V.VOCABULARY["STATIC_DEMO_crec_label"]),
    "zip5_ltst": "concat('450', CAST(bene_id % 13 AS STRING))",
}
_AREA_RANK = "CASE bene_id % 12 WHEN 0 THEN 'PH' WHEN 1 THEN 'GQ' WHEN 2 THEN '10.5' WHEN 3 THEN 'x' ELSE CAST(bene_id % 101 AS STRING) END"
_AREA_YEAR = "CASE WHEN bene_id % 6 = 1 THEN 2019 ELSE 2020 END"
# The first conditions come from one table, the others from a second; either lacks some people.
_CONDITIONS = {name: f"(bene_id + {i}) % 5" for i, name in enumerate(V.CONDITION_NAMES)}
_CHRONIC = list(V.CONDITION_NAMES)[:27]


def _tables(spark: SparkSession, where: str) -> dict[str, DataFrame]:
    # Every table below is made of these lines: they are read and their JSON parsed once.
    ev = written(events(spark, where))
    made = dict(_LINE)
    made["first_srvc_dt"] = "date_add(DATE '2020-10-10', datediff(date, DATE '2024-01-01'))"
    text = [c for c in L.DIAGNOSIS_COLUMNS if c not in made]
    lines = ev.select(*[F.expr(e).alias(n) for n, e in made.items()], *[F.lit(None).cast("string").alias(c) for c in text])
    gap = ((F.col("bene_id") % 10 == 3) & (F.col("m") > 10)) | ((F.col("bene_id") % 10 == 4) & (F.col("m") == 6))
    enrolment = ev.select(F.col("user_id").alias("bene_id")).distinct().select(
        "bene_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m")
    ).select(
        "bene_id",
        F.make_date(F.lit(V.YEAR), "m", F.lit(1)).alias("month_begin"),
        F.when(gap, "None").otherwise(V.BUY_IN[0]).alias("BUYIN_desc"),
        F.lit(V.NOT_DUAL).alias("OP_MDCD_monthly"),
        F.lit(V.DRUG_PLAN).alias("PTD_enrlmt"),
        F.lit(V.NO_MANAGED_CARE).alias("HMOIND_desc"),
        F.last_day(F.make_date(F.lit(V.YEAR), "m", F.lit(1))).alias("month_end"),
        *[F.expr(e).alias(n) for n, e in _PERSON.items()],
    )
    clm, bene = F.col("event_id").alias("clm_id"), F.col("user_id").alias("bene_id")
    errors = ev.where("event_type = 'error'")
    emergency = errors.select(clm, bene, F.expr("CASE WHEN k % 3 = 0 THEN '0450' ELSE '0300' END").alias("REV_CNTR_CD"), F.lit("ER").alias("SRVC_2"))
    hospice = ev.where("user_id % 25 = 0").select(clm, bene, F.lit("0651").alias("REV_CNTR_CD"), F.lit("HOS").alias("SRVC_2"))
    drugs = load(spark, where, "part").select((F.col("p_size") % 8).alias("j")).distinct()
    people = ev.select(bene).distinct()
    conditions = lambda names: [F.expr(_CONDITIONS[n]).alias(n) for n in names]
    zips = load(spark, where, "part").select((F.col("p_size") % 11).cast("int").alias("RUCA1")).distinct()
    year = F.expr(_AREA_YEAR)
    return {
        "chronic": people.where("bene_id % 9 <> 0").select("bene_id", *conditions(_CHRONIC)),
        "other": people.where("bene_id % 7 <> 0").select("bene_id", *conditions(n for n in V.CONDITION_NAMES if n not in _CHRONIC)),
        "rural": zips.select(F.concat(F.lit("450"), F.col("RUCA1").cast("string")).alias("ZIP_CODE"), "RUCA1"),
        "area": people.where("bene_id % 8 <> 0").select(
            "bene_id",
            F.make_date(year, F.lit(1), F.lit(1)).alias("drvd_adr_bgn_dt"),
            F.make_date(year, F.lit(12), F.lit(31)).alias("drvd_adr_end_dt"),
            F.expr(_AREA_RANK).alias("ADI_NATRANK_BG_2019_v3_1"),
        ),
        "timeline": ev.select(bene, F.expr(made["first_srvc_dt"]).alias("date"), (F.col("k") % 2).alias("in_nh_today")),
        "lines": lines,
        "enrolment": enrolment,
        "revenue": emergency.unionByName(hospice),
        "inpatient": errors.select(clm, F.expr("CASE WHEN k % 5 = 0 THEN '3' ELSE '1' END").alias("CLM_IP_ADMSN_TYPE_CD")),
        "drugs": drugs.select(*[F.expr(e).alias(n) for n, e in _DRUG.items()]),
    }


_COHORT_SQL = f"""{EV}, lines AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _LINE.items())} FROM ev),
people AS (SELECT DISTINCT user_id AS bene_id FROM ev),
months AS (SELECT bene_id, count(*) FILTER (WHERE NOT ((bene_id % 10 = 3 AND m > 10) OR (bene_id % 10 = 4 AND m = 6))) AS months
  FROM people, range(1, 13) t(m) GROUP BY bene_id),
cohort AS (SELECT l.*, CASE WHEN (dgns_cd1 = 'T400X1A' OR dgns_cd5 = 'F1110') AND e.event_type = 'error' AND e.k % 3 = 0
    AND first_srvc_dt BETWEEN DATE '2020-11-01' AND DATE '2020-12-31' AND e.k % 5 <> 0 THEN 1 ELSE 0 END AS target
  FROM lines l JOIN ev e ON l.clm_id = e.event_id JOIN months USING (bene_id)
  WHERE (months = 12 OR (months = 11 AND bene_death_dt BETWEEN DATE '2020-12-01' AND DATE '2020-12-31')
      OR (months = 10 AND bene_death_dt BETWEEN DATE '2020-11-01' AND DATE '2020-11-30'))
    AND bene_age >= 65 AND (bene_death_dt IS NULL OR bene_death_dt >= DATE '2020-11-01') AND bene_id % 25 <> 0),
drugs AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _DRUG.items())} FROM (SELECT DISTINCT p_size % 8 AS j FROM part)),
joined AS (SELECT *, coalesce(OMS_OPIOID_FLAG = 'Y' AND OMS_NALOXONE_FLAG = 'N' AND OMS_MAT_FLAG = 'N', false) AS opioid FROM cohort LEFT JOIN drugs ON srvc_dlvrd = FDB_NDC AND year(first_srvc_dt) BETWEEN BEGIN_YR AND END_YR),
picked AS (SELECT * FROM joined WHERE bene_id IN (SELECT bene_id FROM joined
  WHERE opioid AND first_srvc_dt BETWEEN DATE '2020-10-01' AND DATE '2020-10-31'))"""


@query(
    "claims_cohort",
    f"""WITH {_COHORT_SQL} SELECT bene_id, max(target) AS target, count(*) AS n_lines,
    count(*) FILTER (WHERE target = 1) AS n_positive, count(FDB_NDC) AS n_drug_lines FROM picked GROUP BY bene_id""",
)
def claims_cohort(spark: SparkSession, where: str) -> DataFrame:
    t = _tables(spark, where)
    cohort = written(L.with_drugs(L.cohort_lines(t["lines"], t["enrolment"], t["revenue"], t["inpatient"]), t["drugs"]))
    return L.index_people(cohort).groupBy("bene_id").agg(
        F.max("target").alias("target"),
        F.sum("rows_count").alias("n_lines"),
        F.sum(F.col("target") * F.col("rows_count")).alias("n_positive"),
        F.count("FDB_NDC").alias("n_drug_lines"),
    )


def _listed(column: str, values: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


_ORAL = f"({_listed('srvc_dlvrd', V.BUPRENORPHINE_ORAL_CODES)} OR OMS_MAT_FLAG = 'Y' AND FDB_GNN LIKE '%BUPRENORPHINE%')"
_COUNTED = {name: _listed("srvc_dlvrd", codes) for name, codes in V.SERVICE_CODES.items()} | {
    "TS_CLMLINES_BUPRENORPHINE_ORAL_NONOTP": _ORAL,
    "TS_CLMLINES_NALOXONE": f"({_listed('srvc_dlvrd', V.NALOXONE_CODES)} OR OMS_NALOXONE_FLAG = 'Y')",
}
_FLAGGED = {
    "TS_FLAG_DENTIST_OPX_RXERS": f"{_listed('prvdr_spclty', V.DENTIST)} AND opioid",
    "TS_FLAG_PYCHLGST_RXERS": _listed("prvdr_spclty", V.PSYCHOLOGIST),
    "TS_FLAG_NP_PA_OPX_RXERS": f"{_listed('prvdr_spclty', V.NURSE_OR_ASSISTANT)} AND opioid",
    "TS_FLAG_OPX_ED_VISIT": "(dgns_cd1 = 'T400X1A' OR dgns_cd5 = 'F1110')",
}
_MME = "per_day * OMS_MME_CONVERSION_FACTOR * OMS_OPIOID_STR"
_DOSES = {
    "TS_MME_ALL_SA": (f"opioid AND (CDC_OPIOID_LA_SA_ACTING_FLAG = 'SA' OR {_listed('FDB_GNN', V.SHORT_ACTING_NAMES)})", _MME),
    "TS_MME_ALL_LA": ("opioid AND CDC_OPIOID_LA_SA_ACTING_FLAG = 'LA'", _MME),
    "TS_DQ_BENZOS": ("OMS_BENZO_FLAG = 'Y'", "per_day"),
    "TS_DQ_ANTIPSYCH": ("ANTIPSYCH_FLAG = 'Y'", "per_day"),
    "TS_DQ_BUPRENORPHINE_PART_AGON": ("FDB_GNN LIKE '%BUPRENORPHINE%' AND OMS_MAT_FLAG = 'N'", "per_day"),
    "TS_DQ_NALTREXONE_PART_AGON": ("FDB_GNN LIKE '%NALTREXONE%' AND FDB_GNN NOT LIKE '%METHYLNALTREXONE%'", "per_day"),
}
_MEASURES = [*_COUNTED, *_FLAGGED, "TS_CUM_OPX_RXERS", *_DOSES]

_SERIES_SQL = f"""{_COHORT_SQL}, spine AS (SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '2020-01-01', DATE '2020-10-31', INTERVAL 1 DAY) t(d)),
ids AS (SELECT bene_id, max(target) AS target FROM picked GROUP BY bene_id),
dose AS (SELECT *, CASE WHEN clm_days <> 0 THEN srvc_vol / clm_days END AS per_day FROM picked WHERE pymt_sys = 'PTD-DRUG'),
spans AS (SELECT bene_id, date, {", ".join(f"sum(CASE WHEN {when} THEN {value} END) AS {n}" for n, (when, value) in _DOSES.items())}
  FROM spine JOIN dose ON date BETWEEN first_srvc_dt AND first_srvc_dt + CAST(clm_days AS INTEGER) GROUP BY bene_id, date),
firsts AS (SELECT bene_id, prvdr_id, min(first_srvc_dt) AS date FROM picked WHERE opioid GROUP BY 1, 2),
fresh AS (SELECT bene_id, date, count(*) AS n FROM firsts GROUP BY 1, 2),
points AS (SELECT bene_id, first_srvc_dt AS date, {", ".join(f"count(*) FILTER (WHERE {w}) AS {n}" for n, w in _COUNTED.items())},
  {", ".join(f"max(CASE WHEN {w} THEN 1 ELSE 0 END) AS {n}" for n, w in _FLAGGED.items())} FROM picked GROUP BY 1, 2),
days AS (SELECT bene_id, target, CAST(date - DATE '2020-01-01' AS INTEGER) AS day,
  {", ".join(f"coalesce({n}, 0) AS {n}" for n in [*_COUNTED, *_DOSES])}, {", ".join(f"CAST(coalesce({n}, 0) AS INTEGER) AS {n}" for n in _FLAGGED)},
  CAST(sum(coalesce(n, 0)) OVER (PARTITION BY bene_id ORDER BY date) AS BIGINT) AS TS_CUM_OPX_RXERS
  FROM ids CROSS JOIN spine LEFT JOIN spans USING (bene_id, date) LEFT JOIN fresh USING (bene_id, date) LEFT JOIN points USING (bene_id, date))"""


@query(
    "claims_series",
    f"""WITH {_SERIES_SQL} SELECT bene_id, target, day, {", ".join(f"round({n}, 4) + 0.0 AS {n}" if n in _DOSES else n for n in _MEASURES)} FROM days""",
)
def claims_series(spark: SparkSession, where: str) -> DataFrame:
    """All series of the lines, one row per person and day."""
    t = _tables(spark, where)
    cohort = written(L.with_drugs(L.cohort_lines(t["lines"], t["enrolment"], t["revenue"], t["inpatient"]), t["drugs"]))
    selected = written(L.with_prescriber_count(L.index_people(cohort)))
    panel = L.series_panel(selected).join(K.label_entities(selected, "bene_id"), "bene_id")
    days = F.posexplode(F.arrays_zip(*_MEASURES)).alias("day", "at")
    return rounded(panel.select("bene_id", "target", days).select("bene_id", "target", "day", *[F.col(f"at.{m}").alias(m) for m in _MEASURES]), 4)


_KEPT_CONDITIONS = {
    f"CC_{name}": f"CASE WHEN bene_id % {9 if old in _CHRONIC else 7} <> 0 AND {_CONDITIONS[old]} IN (1, 3) THEN 1 ELSE 0 END"
    for old, name in V.CONDITION_NAMES.items()
    if f"CC_{name}" not in V.LEAKING_CONDITIONS
}
_BIN = " ".join(f"WHEN rank BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in V.AREA_BINS)
_STATIC = [
    "STATIC_DEMO_bene_age",
    "STATIC_DEMO_sex_label",
    "STATIC_DEMO_state_cd",
    "STATIC_DEMO_race_label",
    "STATIC_DEMO_crec_label",
    "STATIC_DEMO_RUCA1",
    "STATIC_DEMO_ADI_NATRANK_binned",
]
_ALL_SERIES = [*_MEASURES, "TS_IN_NH_TODAY"]
_PANEL_SQL = f"""{_SERIES_SQL},
homes AS (SELECT bene_id, CAST(first_srvc_dt - DATE '2020-01-01' AS INTEGER) AS day, max(e.k % 2) AS home
  FROM lines JOIN ev e ON clm_id = e.event_id GROUP BY 1, 2),
found AS (SELECT bene_id, target, {", ".join(f"{e} AS {n}" for n, e in _PERSON.items())},
    CASE WHEN bene_id % 8 <> 0 AND {_AREA_YEAR} = 2020 THEN {_AREA_RANK} END AS area,
    {", ".join(f"{e} AS {n}" for n, e in _KEPT_CONDITIONS.items())} FROM ids WHERE bene_id % 9 <> 0 OR bene_id % 7 <> 0),
placed AS (SELECT *, CAST(round(TRY_CAST(area AS DOUBLE)) AS INTEGER) AS rank, CASE WHEN z BETWEEN 1 AND 10 THEN z END AS ruca
  FROM found LEFT JOIN (SELECT DISTINCT CAST(p_size % 11 AS INTEGER) AS z FROM part) ON zip5_ltst = concat('450', CAST(z AS VARCHAR))),
static AS (SELECT bene_id, target, {", ".join(_KEPT_CONDITIONS)},
    CAST(round(date_diff('day', birth_dt, DATE '2020-12-31') / 365.25) AS INTEGER) AS STATIC_DEMO_bene_age,
    sex_desc AS STATIC_DEMO_sex_label, coalesce(state_cd, 'Unassigned') AS STATIC_DEMO_state_cd, race_cd_desc AS STATIC_DEMO_race_label,
    crec_desc AS STATIC_DEMO_crec_label, coalesce(ruca, (SELECT quantile_disc(ruca, 0.5) FROM placed)) AS STATIC_DEMO_RUCA1,
    CASE {_BIN} WHEN {_listed("area", V.AREA_CODES)} THEN area ELSE 'Unassigned' END AS STATIC_DEMO_ADI_NATRANK_binned
  FROM placed),
narrowed AS (SELECT bene_id, day, {", ".join(f"CAST(CAST({n} AS REAL) AS DOUBLE) AS {n}" if n.startswith("TS_MME") else f"CAST({n} AS DOUBLE) AS {n}" for n in _MEASURES)},
    CAST(coalesce(home, 0) AS DOUBLE) AS TS_IN_NH_TODAY FROM days LEFT JOIN homes USING (bene_id, day))"""


def _panel(spark: SparkSession, where: str) -> DataFrame:
    return L.claims_panel(**_tables(spark, where))


@query(
    "claims_panel",
    f"""WITH {_PANEL_SQL}, totals AS (SELECT bene_id, count(*) AS n_days, {", ".join(f"round(sum({n}), 1) + 0.0 AS {n}" for n in _ALL_SERIES)}
    FROM narrowed GROUP BY bene_id) SELECT * FROM static JOIN totals USING (bene_id)""",
)
def claims_panel(spark: SparkSession, where: str) -> DataFrame:
    """The finished panel, each series by its total."""
    panel = _panel(spark, where)
    totals = [F.aggregate(F.col(n).cast("array<double>"), F.lit(0.0), lambda a, x: a + x).alias(n) for n in _ALL_SERIES]
    return rounded(
        panel.select("bene_id", "target", *_KEPT_CONDITIONS, *_STATIC, F.size(_ALL_SERIES[0]).cast("long").alias("n_days"), *totals), 1
    )


def _encoded_sql() -> str:
    features = []
    for n in _ALL_SERIES:
        for end, rows in (("", "TRUE"), (f"_{TAIL_DAYS}_day", f"day >= 305 - {TAIL_DAYS}")):
            features += [
                f"round(avg({n}) FILTER (WHERE {rows}), 6) + 0.0 AS {n}__mean{end}",
                f"round(var_pop({n}) FILTER (WHERE {rows}), 4) + 0.0 AS {n}__variance{end}",
            ]
    coded = f"CASE WHEN {_listed('STATIC_DEMO_ADI_NATRANK_binned', V.AREA_CODES)} THEN 'Unassigned' ELSE STATIC_DEMO_ADI_NATRANK_binned END"
    hot = [
        f"CAST(CAST({coded if c == 'STATIC_DEMO_ADI_NATRANK_binned' else c} AS VARCHAR) = '{v}' AS DOUBLE) AS {name}"
        for (c, v), name in zip(((c, v) for c, values in V.VOCABULARY.items() for v in values), one_hot_names(V.VOCABULARY), strict=True)
    ]
    return f"""WITH {_PANEL_SQL}, features AS (SELECT bene_id, {", ".join(features)} FROM narrowed GROUP BY bene_id)
    SELECT bene_id, {", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in _KEPT_CONDITIONS)}, features.* EXCLUDE (bene_id), {", ".join(hot)},
    CAST(target AS DOUBLE) AS labels FROM static JOIN features USING (bene_id)"""


def _encoded(spark: SparkSession, where: str) -> DataFrame:
    panel = written(_panel(spark, where))
    series = list(L.series_names(panel))
    # Made in the person's row: no join of the panel with its own features.
    wide = abridged_features(panel, "bene_id", series, keep=[c for c in panel.columns if c not in ("bene_id", *series)])
    coded = encode_table(L.area_labels_for_encoding(wide), "bene_id", "target", V.VOCABULARY, drop=["STATIC_DEMO_bene_age"])
    return coded.select(
        *[r(c, 4 if "__variance" in c else 6).alias(c) if c.startswith("TS_") else F.col(c) for c in coded.columns]
    )


@query("claims_encoded", _encoded_sql())
def claims_encoded(spark: SparkSession, where: str) -> DataFrame:
    """Model input: means and variances of all series, conditions and the one-hot columns."""
    return _encoded(spark, where)


@query(
    "claims_training_rows",
    f"""SELECT * FROM ({_encoded_sql()}) WHERE bene_id % 20 < 14
    AND {" AND ".join(f"round({n}, 0) <= {cap}" for n, cap in V.TRAINING_CAPS.items())}""",
)
def claims_training_rows(spark: SparkSession, where: str) -> DataFrame:
    """The training part without the rows of extreme doses."""
    train = split_by_mod(_encoded(spark, where), "bene_id").where("split = 'train'").drop("split")
    return trim_outliers(train, V.TRAINING_CAPS)
