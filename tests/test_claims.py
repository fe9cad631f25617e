"""The claims setting end to end on a few inline rows."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from daypanel.operators.encoding import encode_table
from daypanel.operators.features import abridged_features
from daypanel.plans import claims as L
from daypanel.plans import fixed_values as V

DAY = date(2020, 1, 1)


def line(bene, clm, code, day, *, pay="PTD-DRUG", vol=30.0, days=10, prov="p1", spec="01", dx="Z00", n=1, death=None, age=70):
    dx_values = [dx] + [None] * 11
    return (bene, clm, n, code, day, spec, prov, *dx_values, pay, vol, days, age, death)


LINE_SCHEMA = (
    "bene_id long, clm_id long, line_num int, srvc_dlvrd string, first_srvc_dt date, prvdr_spclty string, prvdr_id string, "
    + ", ".join(f"dgns_cd{i} string" for i in range(1, 13))
    + ", pymt_sys string, srvc_vol double, clm_days int, bene_age int, bene_death_dt date"
)


@pytest.fixture(scope="module")
def tables(spark):
    lines = [
        # person 1: two overlapping opioid fills by two prescribers, an event in November
        line(1, 11, "OXY", date(2020, 10, 1), vol=60.0, days=10, prov="p1", spec="19"),
        line(1, 12, "OXY", date(2020, 10, 5), vol=30.0, days=5, prov="p2"),
        line(1, 12, "OXY", date(2020, 10, 5), vol=30.0, days=5, prov="p2"),
        line(1, 13, "99285", date(2020, 11, 20), pay="OTHER", dx="T400X1A"),
        line(1, 14, "G2074", date(2020, 3, 2), pay="OTHER"),
        # person 2: opioid, event but elective admission
        line(2, 21, "OXY", date(2020, 10, 30), vol=20.0, days=5),
        line(2, 22, "99285", date(2020, 11, 21), pay="OTHER", dx="F1110"),
        # person 3: no opioid in the index month
        line(3, 31, "OXY", date(2020, 5, 1)),
        # person 4: hospice
        line(4, 41, "OXY", date(2020, 10, 2)),
        # person 5: ten enrolled months, died in November
        line(5, 51, "OXY", date(2020, 10, 3), death=date(2020, 11, 15)),
        # person 6: eleven enrolled months, alive
        line(6, 61, "OXY", date(2020, 10, 3)),
        # person 7: too young
        line(7, 71, "OXY", date(2020, 10, 3), age=60),
    ]
    months = []
    for person, enrolled in ((1, 12), (2, 12), (3, 12), (4, 12), (5, 10), (6, 11), (7, 12)):
        for m in range(1, 13):
            begin = date(2020, m, 1)
            end = (date(2020, m + 1, 1) if m < 12 else date(2021, 1, 1)) - timedelta(days=1)
            buy_in = V.BUY_IN[0] if m <= enrolled else "None"
            months.append(
                (person, begin, end, buy_in, V.NOT_DUAL, V.DRUG_PLAN, V.NO_MANAGED_CARE, date(1950, 6, 30), "Female",
                 None if person == 2 else "OH", "Other", V.VOCABULARY["STATIC_DEMO_crec_label"][0], "45000" if person != 2 else "99999")
            )
    drug = ("OXY", 2018, 2021, "OXYCODONE HCL/ACETAMINOPHEN", "Y", "Y", "N", "N", "N", "N", "SA", 1.5, 5.0)
    old_drug = ("OXY", 2010, 2017, "OLD NAME", "Y", "Y", "N", "N", "N", "N", "LA", 9.0, 9.0)
    make = spark.createDataFrame
    return dict(
        lines=make(lines, LINE_SCHEMA),
        enrolment=make(
            months,
            "bene_id long, month_begin date, month_end date, BUYIN_desc string, OP_MDCD_monthly string, PTD_enrlmt string, "
            "HMOIND_desc string, birth_dt date, sex_desc string, state_cd string, race_cd_desc string, crec_desc string, zip5_ltst string",
        ),
        revenue=make(
            [(13, 1, "0450", "ER"), (13, 1, "0300", "LAB"), (22, 2, "0450", "ER"), (40, 4, "0651", "HOS")],
            "clm_id long, bene_id long, REV_CNTR_CD string, SRVC_2 string",
        ),
        inpatient=make([(13, "1"), (22, "3")], "clm_id long, CLM_IP_ADMSN_TYPE_CD string"),
        drugs=make(
            [drug, old_drug],
            "FDB_NDC string, BEGIN_YR int, END_YR int, FDB_GNN string, FDB_IND string, OMS_OPIOID_FLAG string, OMS_NALOXONE_FLAG string, "
            "OMS_MAT_FLAG string, OMS_BENZO_FLAG string, ANTIPSYCH_FLAG string, CDC_OPIOID_LA_SA_ACTING_FLAG string, "
            "OMS_MME_CONVERSION_FACTOR double, OMS_OPIOID_STR double",
        ),
        chronic=make([(1, 1, 0), (2, 2, 3)], "bene_id long, ASTHMA int, CHF int"),
        other=make([(1, 3), (5, 1)], "bene_id long, DRUG_MEDICARE int"),
        rural=make([("45000", 4)], "ZIP_CODE string, RUCA1 int"),
        area=make(
            [
                (1, date(2020, 1, 1), date(2020, 12, 31), "10.5"),
                (2, date(2020, 1, 1), date(2020, 12, 31), "PH"),
                (5, date(2019, 1, 1), date(2019, 12, 31), "50"),
            ],
            "bene_id long, drvd_adr_bgn_dt date, drvd_adr_end_dt date, ADI_NATRANK_BG_2019_v3_1 string",
        ),
        timeline=make([(1, date(2020, 1, 3), 1), (9, date(2020, 1, 3), 1)], "bene_id long, date date, in_nh_today int"),
        conditions={"ASTHMA": "Asthma", "CHF": "CHF", "DRUG_MEDICARE": "Drug_use"},
    )


def test_cohort_rules(tables):
    cohort = L.cohort_lines(tables["lines"], tables["enrolment"], tables["revenue"], tables["inpatient"])
    rows = cohort.collect()
    assert {r["bene_id"] for r in rows} == {1, 2, 3, 5}
    assert {(r["bene_id"], r["clm_id"]) for r in rows if r["target"] == 1} == {(1, 13)}
    assert [r["rows_count"] for r in rows if r["clm_id"] == 12] == [2]


def test_literal_month_rule(tables):
    # Person 6 has eleven enrolled months and lives: neither reading lets them in.
    # Person 5's tenth month is enrolled and they died in November: both do.
    literal = L.cohort_lines(tables["lines"], tables["enrolment"], tables["revenue"], tables["inpatient"], literal=True)
    assert {r["bene_id"] for r in literal.select("bene_id").collect()} == {1, 2, 3, 5}


def test_panel(tables):
    panel = L.claims_panel(**tables)
    rows = {r["bene_id"]: r for r in panel.collect()}
    assert set(rows) == {1, 2, 5}
    one = rows[1]
    assert one["target"] == 1 and rows[2]["target"] == 0
    assert all(len(one[c]) == 305 for c in panel.columns if c.startswith("TS_"))
    first = (date(2020, 10, 1) - DAY).days
    mme = one["TS_MME_ALL_SA"]
    dose = 1.5 * 5.0
    # Fill 1 covers Oct 1..11, fill 2 Oct 5..10; both add up.
    assert mme[first - 1] == 0
    assert mme[first] == pytest.approx(6 * dose)
    assert mme[first + 4] == pytest.approx(12 * dose)
    assert mme[first + 9] == pytest.approx(12 * dose)
    assert mme[first + 10] == pytest.approx(6 * dose)
    assert mme[first + 11] == 0
    assert sum(one["TS_MME_ALL_LA"]) == 0
    rxers = one["TS_CUM_OPX_RXERS"]
    assert rxers[first - 1] == 0 and rxers[first] == 1 and rxers[first + 3] == 1
    assert rxers[first + 4] == 2 and rxers[-1] == 2
    assert one["TS_CLMLINES_OTP_NONDRUG"][(date(2020, 3, 2) - DAY).days] == 1
    assert sum(one["TS_FLAG_DENTIST_OPX_RXERS"]) == 1
    assert one["TS_IN_NH_TODAY"][2] == 1 and sum(one["TS_IN_NH_TODAY"]) == 1
    assert sum(rows[2]["TS_IN_NH_TODAY"]) == 0
    assert one["CC_Asthma"] == 1 and rows[2]["CC_CHF"] == 1 and rows[5]["CC_Asthma"] == 0
    assert "CC_Drug_use" not in panel.columns
    assert one["STATIC_DEMO_ADI_NATRANK_binned"] == "11-20"
    assert rows[2]["STATIC_DEMO_ADI_NATRANK_binned"] == "PH"
    assert rows[5]["STATIC_DEMO_ADI_NATRANK_binned"] == "Unassigned"
    assert rows[2]["STATIC_DEMO_state_cd"] == "Unassigned" and rows[2]["STATIC_DEMO_RUCA1"] == 4
    assert one["STATIC_DEMO_bene_age"] == 71


def test_panel_to_model_input(tables):
    panel = L.claims_panel(**tables)
    series = L.series_names(panel)
    wide = panel.drop(*series).join(abridged_features(panel, "bene_id", series), "bene_id")
    encoded = encode_table(
        L.area_labels_for_encoding(wide), "bene_id", "target", V.VOCABULARY, drop=["STATIC_DEMO_bene_age"]
    )
    hot = [c for c in encoded.columns if c.startswith("STATIC_")]
    assert len(hot) == 87
    sums = encoded.select(sum((F.col(c) for c in hot[1:]), F.col(hot[0])).alias("s")).collect()
    assert [r["s"] for r in sums] == [6.0, 6.0, 6.0]
    assert encoded.columns[-1] == "labels"


def test_dense_series_are_not_stored_for_the_median(tables, monkeypatch):
    stored, write = [], L.written
    monkeypatch.setattr(L, "written", lambda df: stored.append(df.dtypes) or write(df))
    panel = L.claims_panel(**tables)
    assert len(stored) == 3 and not [n for dtypes in stored for n, kind in dtypes if kind.startswith("array")]
    # The median is that of the joined people only.
    parts = [panel.select("bene_id", *L.series_names(panel)), panel.select("bene_id", "target"), panel.select("bene_id")]
    people = panel.select("bene_id", "STATIC_DEMO_state_cd", F.when(F.col("bene_id") != 5, F.col("bene_id").cast("int")).alias("STATIC_DEMO_RUCA1"))
    homes = panel.where("bene_id <> 1").select("bene_id", F.array(F.lit(0)).alias("TS_IN_HOME"))
    found = L.finished_panel(*parts, people, homes).select("bene_id", "STATIC_DEMO_RUCA1").collect()
    assert sorted(map(tuple, found)) == [(2, 2), (5, 2)]
