"""The claims setting: from claim lines and side tables to the encoded panel.

Every step takes and gives DataFrames with the column names of the claims
schemas. Where the published steps have a doubtful literal reading, the
default is the evident intent and an option gives the literal one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.functions import columns as C
from daypanel.operators import cohort as K
from daypanel.operators.panel import build_panel, running_distinct
from daypanel.plans import fixed_values as V
from daypanel.sources.tables import written

DIAGNOSIS_COLUMNS = [f"dgns_cd{i}" for i in range(1, 13)]
LINE_COLUMNS = [
    "bene_id",
    "clm_id",
    "line_num",
    "srvc_dlvrd",
    "first_srvc_dt",
    "prvdr_spclty",
    "prvdr_id",
    *DIAGNOSIS_COLUMNS,
    "pymt_sys",
    "srvc_vol",
    "clm_days",
]


def enrolled() -> Column:
    return (
        C.in_codes("BUYIN_desc", V.BUY_IN)
        & C.in_codes("OP_MDCD_monthly", [V.NOT_DUAL])
        & C.in_codes("PTD_enrlmt", [V.DRUG_PLAN])
        & C.in_codes("HMOIND_desc", [V.NO_MANAGED_CARE])
    )


def with_enrolled_months(
    lines: DataFrame, enrolment: DataFrame, literal: bool = False
) -> DataFrame:
    """Lines of people enrolled all year, or up to the month of their death.

    `literal` tests the ordinal of single enrolled months instead of their number.
    """
    in_year = enrolment.where(F.year("month_begin") == V.YEAR)
    if literal:
        numbered = K.month_ordinals(in_year, "bene_id", "month_begin", enrolled(), "months")
        months = numbered.where(F.col("months").isin(10, 11, 12)).select("bene_id", "months")
    else:
        months = K.enrolled_months(in_year, "bene_id", "month_begin", enrolled())
    death, n = F.col("bene_death_dt"), F.col("months")
    full = n == 12
    died_in_december = (n == 11) & death.between("2020-12-01", "2020-12-31")
    died_in_november = (n == 10) & death.between("2020-11-01", "2020-11-30")
    old_enough = F.col("bene_age") >= V.MIN_AGE
    alive = death.isNull() | (death >= V.TARGET_START)
    return lines.join(months, "bene_id").where((full | died_in_december | died_in_november) & old_enough & alive)


def cohort_lines(
    lines: DataFrame,
    enrolment: DataFrame,
    revenue: DataFrame,
    inpatient: DataFrame,
    literal: bool = False,
    null_admission_ok: bool = False,
) -> DataFrame:
    """Distinct claim lines of the cohort with `target` and `rows_count`.

    A line is positive with a listed diagnosis, an emergency line on its claim,
    a date in the target period and a non-elective admission.
    """
    emergency = K.count_lines(
        revenue, "clm_id", C.in_codes("REV_CNTR_CD", V.EMERGENCY_REVENUE_CODES), "er_count", strict=not literal
    )
    admissions = inpatient.groupBy("clm_id").agg(F.max("CLM_IP_ADMSN_TYPE_CD").alias("admission"))
    hospice = revenue.where(
        (F.col("SRVC_2") == V.HOSPICE_SERVICE) & C.in_codes("REV_CNTR_CD", V.HOSPICE_REVENUE_CODES)
    )
    in_year = lines.where(F.col("first_srvc_dt").between(f"{V.YEAR}-01-01", V.YEAR_END))
    kept = K.exclude(with_enrolled_months(in_year, enrolment, literal), hospice, "bene_id")
    joined = kept.join(emergency, "clm_id", "left").join(admissions, "clm_id", "left")
    labelled = K.label_events(
        joined,
        DIAGNOSIS_COLUMNS,
        V.DIAGNOSIS_CODES,
        "first_srvc_dt",
        V.TARGET_START,
        V.TARGET_END,
        extra=(F.col("er_count") > 0) & K.not_in_codes("admission", V.ELECTIVE_ADMISSION, null_admission_ok),
    )
    return K.dedupe_counting(labelled.select(*LINE_COLUMNS, "target"))


def with_drugs(lines: DataFrame, drugs: DataFrame) -> DataFrame:
    """Drug reference entry valid in the year of the line."""
    return K.join_valid(lines, drugs, "srvc_dlvrd", "FDB_NDC", F.year("first_srvc_dt"), "BEGIN_YR", "END_YR")


def is_opioid() -> Column:
    """An opioid that is neither a treatment of opioid use nor naloxone."""
    return (
        (F.col("OMS_OPIOID_FLAG") == "Y")
        & (F.col("OMS_NALOXONE_FLAG") == "N")
        & (F.col("OMS_MAT_FLAG") == "N")
        & (F.col("FDB_IND") == "Y")
        & (F.col("FDB_GNN") != V.NOT_AN_OPIOID)
    )


def index_people(lines: DataFrame) -> DataFrame:
    """All lines of people with an opioid in the index month."""
    in_month = F.col("first_srvc_dt").between(V.INDEX_START, V.INDEX_END)
    return K.restrict(lines, lines.where(is_opioid() & in_month), "bene_id")


def with_prescriber_count(lines: DataFrame) -> DataFrame:
    """Add the number of distinct opioid prescribers up to the line's date."""
    counts = running_distinct(
        lines.where(is_opioid()), "bene_id", "first_srvc_dt", "prvdr_id", "cum_distinct_opx_prescribers"
    )
    return lines.join(counts, ["bene_id", "first_srvc_dt"], "left")


def point_sums() -> dict[str, Column]:
    """Measures added up per day."""
    flags = {name: C.yes(C.in_codes("srvc_dlvrd", codes)) for name, codes in V.SERVICE_CODES.items()}
    treated = (F.col("OMS_MAT_FLAG") == "Y") & F.col("FDB_GNN").like("%BUPRENORPHINE%")
    flags["TS_CLMLINES_BUPRENORPHINE_ORAL_NONOTP"] = C.yes(
        C.in_codes("srvc_dlvrd", V.BUPRENORPHINE_ORAL_CODES) | treated
    )
    flags["TS_CLMLINES_NALOXONE"] = C.yes(
        C.in_codes("srvc_dlvrd", V.NALOXONE_CODES) | (F.col("OMS_NALOXONE_FLAG") == "Y")
    )
    return flags


def point_maxima() -> dict[str, Column]:
    """Measures of which a day keeps the largest."""
    opioid = is_opioid() & F.lit(V.YEAR).between(F.col("BEGIN_YR"), F.col("END_YR"))
    return {
        "TS_CUM_OPX_RXERS": F.col("cum_distinct_opx_prescribers"),
        "TS_FLAG_DENTIST_OPX_RXERS": C.yes(C.in_codes("prvdr_spclty", V.DENTIST) & opioid),
        "TS_FLAG_PYCHLGST_RXERS": C.yes(C.in_codes("prvdr_spclty", V.PSYCHOLOGIST)),
        "TS_FLAG_NP_PA_OPX_RXERS": C.yes(C.in_codes("prvdr_spclty", V.NURSE_OR_ASSISTANT) & opioid),
        "TS_FLAG_OPX_ED_VISIT": C.yes(C.any_code(DIAGNOSIS_COLUMNS, V.DIAGNOSIS_CODES)),
    }


def span_sums() -> dict[str, Column]:
    """Daily doses and quantities, counted on every day a fill covers."""
    opioid = is_opioid() & F.lit(V.YEAR).between(F.col("BEGIN_YR"), F.col("END_YR"))
    per_day = C.daily_rate(F.col("srvc_vol"), F.col("clm_days"))
    dose = C.daily_rate(
        F.col("srvc_vol"), F.col("clm_days"), F.col("OMS_MME_CONVERSION_FACTOR"), F.col("OMS_OPIOID_STR")
    )
    acting, name = F.col("CDC_OPIOID_LA_SA_ACTING_FLAG"), F.col("FDB_GNN")
    short = (acting == "SA") | C.in_codes(name, V.SHORT_ACTING_NAMES)
    partial = name.like("%BUPRENORPHINE%") & (F.col("OMS_MAT_FLAG") == "N")
    naltrexone = name.like("%NALTREXONE%") & ~name.like("%METHYLNALTREXONE%")
    return {
        "TS_MME_ALL_SA": F.when(short & opioid, dose).otherwise(0.0),
        "TS_MME_ALL_LA": F.when((acting == "LA") & opioid, dose).otherwise(0.0),
        "TS_DQ_BENZOS": F.when(F.col("OMS_BENZO_FLAG") == "Y", per_day),
        "TS_DQ_ANTIPSYCH": F.when(F.col("ANTIPSYCH_FLAG") == "Y", per_day),
        "TS_DQ_BUPRENORPHINE_PART_AGON": F.when(partial, per_day).otherwise(0.0),
        "TS_DQ_NALTREXONE_PART_AGON": F.when(naltrexone, per_day).otherwise(0.0),
    }


def series_panel(lines: DataFrame, start: str = V.PANEL_START, end: str = V.PANEL_END) -> DataFrame:
    """One row per person with one daily array per measure."""
    return build_panel(
        lines,
        "bene_id",
        F.col("first_srvc_dt"),
        start,
        end,
        sums=point_sums(),
        maxes=point_maxima(),
        spans=span_sums(),
        span_filter=F.col("pymt_sys") == V.DRUG_LINE,
        span_days=F.col("clm_days"),
        carried=["TS_CUM_OPX_RXERS"],
    )


def condition_flags(chronic: DataFrame, other: DataFrame, names: Mapping[str, str] = V.CONDITION_NAMES) -> DataFrame:
    """0/1 flags of the conditions, without those that give the outcome away."""
    both = K.full_outer(chronic, other, "bene_id")
    flags = C.recode_flags(both, ["bene_id"], names, V.CONDITION_PRESENT, "CC_")
    return flags.select(*[c for c in flags.columns if c not in V.LEAKING_CONDITIONS])


def demographics(enrolment: DataFrame, rural: DataFrame, area: DataFrame) -> DataFrame:
    """Age, labels, rural code and area rank of each person at the end of the panel."""
    at_end = F.lit(V.PANEL_END).cast("date")
    people = enrolment.where(F.col("month_end") == at_end)
    codes = rural.groupBy(F.col("ZIP_CODE").alias("zip5_ltst")).agg(F.max("RUCA1").alias("RUCA1"))
    placed = people.join(codes, "zip5_ltst", "left")
    ranked = K.join_active(
        placed, area, "bene_id", at_end, "drvd_adr_bgn_dt", "drvd_adr_end_dt", ["ADI_NATRANK_BG_2019_v3_1"]
    )
    binned = C.bin_labels(F.col("ADI_NATRANK_BG_2019_v3_1"), V.AREA_BINS, V.AREA_CODES, V.UNASSIGNED)
    columns = {
        "STATIC_DEMO_bene_age": C.age_at(F.col("birth_dt"), F.lit(V.YEAR_END).cast("date")),
        "STATIC_DEMO_sex_label": F.col("sex_desc"),
        "STATIC_DEMO_state_cd": F.col("state_cd"),
        "STATIC_DEMO_race_label": F.col("race_cd_desc"),
        "STATIC_DEMO_crec_label": F.col("crec_desc"),
        "STATIC_DEMO_RUCA1": C.bounded(F.col("RUCA1"), 1, 10).cast("int"),
        "STATIC_DEMO_ADI_NATRANK_binned": binned,
    }
    return ranked.select("bene_id", *[c.alias(n) for n, c in columns.items()]).distinct()


def nursing_home_panel(
    people: DataFrame, timeline: DataFrame, start: str = V.PANEL_START, end: str = V.PANEL_END
) -> DataFrame:
    """Daily 0/1 status of every person of the cohort."""
    known = K.restrict(timeline, people, "bene_id").select("bene_id", "date", "in_nh_today")
    everyone = people.select("bene_id").withColumns(
        {"date": F.lit(None).cast("date"), "in_nh_today": F.lit(0)}
    )
    return build_panel(
        known.unionByName(everyone), "bene_id", "date", start, end, sums={}, maxes={"TS_IN_NH_TODAY": F.col("in_nh_today")}
    )


def finished_panel(
    series: DataFrame, targets: DataFrame, conditions: DataFrame, people: DataFrame, homes: DataFrame
) -> DataFrame:
    """The panel: everything joined by person, narrowed and filled in.

    The median needs the joined people, but not their series: only what is fixed
    per person is stored for it, and the dense days are made once, where they are read.
    """
    fixed = reduce(lambda a, b: a.join(b, "bene_id"), [targets, conditions, people])
    for daily in (series, homes):
        fixed = K.restrict(fixed, daily, "bene_id")
    filled = C.fill_median(written(fixed), ["STATIC_DEMO_RUCA1"]).na.fill({"STATIC_DEMO_state_cd": V.UNASSIGNED})
    own = [c for c in filled.columns if c != "bene_id"]
    joined = series.join(filled, "bene_id").join(homes, "bene_id")
    return C.narrow_arrays(joined.select(*series.columns, *own, *[c for c in homes.columns if c != "bene_id"]))


def claims_panel(
    lines: DataFrame,
    enrolment: DataFrame,
    revenue: DataFrame,
    inpatient: DataFrame,
    drugs: DataFrame,
    chronic: DataFrame,
    other: DataFrame,
    rural: DataFrame,
    area: DataFrame,
    timeline: DataFrame,
    conditions: Mapping[str, str] = V.CONDITION_NAMES,
    literal: bool = False,
    null_admission_ok: bool = False,
) -> DataFrame:
    """All of the above in order.

    The cohort's lines and what is fixed per person are read by several steps,
    so each is written once to the shared folder.
    """
    cohort = written(with_drugs(cohort_lines(lines, enrolment, revenue, inpatient, literal, null_admission_ok), drugs))
    selected = written(with_prescriber_count(index_people(cohort)))
    targets = K.label_entities(selected, "bene_id")
    return finished_panel(
        series_panel(selected),
        targets,
        condition_flags(chronic, other, conditions),
        demographics(enrolment, rural, area),
        nursing_home_panel(targets, timeline),
    )


def area_labels_for_encoding(df: DataFrame) -> DataFrame:
    """Area codes that the one-hot vocabulary does not list become 'Unassigned'."""
    name = "STATIC_DEMO_ADI_NATRANK_binned"
    return df.withColumn(name, F.when(C.in_codes(name, V.AREA_CODES), V.UNASSIGNED).otherwise(F.col(name)))


def series_names(panel: DataFrame) -> Sequence[str]:
    return [c for c in panel.columns if c.startswith("TS_")]
