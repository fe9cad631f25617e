"""Fixed values of the claims setting: code lists, names and vocabularies.

They must equal the values the published results were made with, so they are
stated here as they are.
"""

# Diagnosis codes of an opioid-related event.
DIAGNOSIS_CODES = [
    "F1110", "F11120", "F11121", "F11122", "F11129", "F1113", "F1114", "F11150", "F11151", "F11159", "F11181",
    "F11182", "F11188", "F1119", "F1120", "F11220", "F11221", "F11222", "F11229", "F1123", "F1124", "F11250",
    "F11251", "F11259", "F11281", "F11282", "F11288", "F1129", "F1190", "F11920", "F11921", "F11922", "F11929",
    "F1193", "F1194", "F11950", "F11951", "F11959", "F11981", "F11982", "F11988", "F1199", "T400X1A", "T400X1D",
    "T400X1S", "T400X2A", "T400X2D", "T400X2S", "T400X3A", "T400X3D", "T400X3S", "T400X4A", "T400X4D", "T400X4S",
    "T400X5A", "T400X5D", "T400X5S", "T401X1A", "T401X1D", "T401X1S", "T401X2A", "T401X2D", "T401X2S", "T401X3A",
    "T401X3D", "T401X3S", "T401X4A", "T401X4D", "T401X4S", "T402X1A", "T402X1D", "T402X1S", "T402X2A", "T402X2D",
    "T402X2S", "T402X3A", "T402X3D", "T402X3S", "T402X4A", "T402X4D", "T402X4S", "T402X5A", "T402X5D", "T402X5S",
    "T403X1A", "T403X1D", "T403X1S", "T403X2A", "T403X2D", "T403X2S", "T403X3A", "T403X3D", "T403X3S", "T403X4A",
    "T403X4D", "T403X4S", "T403X5A", "T403X5D", "T403X5S", "T404X1A", "T404X1D", "T404X1S", "T404X2A", "T404X2D",
    "T404X2S", "T404X3A", "T404X3D", "T404X3S", "T404X4A", "T404X4D", "T404X4S", "T404X5A", "T404X5D", "T404X5S",
    "T40411A", "T40411D", "T40411S", "T40412A", "T40412D", "T40412S", "T40413A", "T40413D", "T40413S", "T40414A",
    "T40414D", "T40414S", "T40415A", "T40415D", "T40415S", "T40421A", "T40421D", "T40421S", "T40422A", "T40422D",
    "T40422S", "T40423A", "T40423D", "T40423S", "T40424A", "T40424D", "T40424S", "T40425A", "T40425D", "T40425S",
    "T40491A", "T40491D", "T40491S", "T40492A", "T40492D", "T40492S", "T40493A", "T40493D", "T40493S", "T40494A",
    "T40494D", "T40494S", "T40495A", "T40495D", "T40495S", "T40601A", "T40601D", "T40601S", "T40602A", "T40602D",
    "T40602S", "T40603A", "T40603D", "T40603S", "T40604A", "T40604D", "T40604S", "T40605A", "T40605D", "T40605S",
    "T40691A", "T40691D", "T40691S", "T40692A", "T40692D", "T40692S", "T40693A", "T40693D", "T40693S", "T40694A",
    "T40694D", "T40694S", "T40695A", "T40695D", "T40695S",
]

# Revenue centre codes of emergency and hospice lines.
EMERGENCY_REVENUE_CODES = ["0450", "0451", "0452", "0456", "0459", "0981"]
HOSPICE_REVENUE_CODES = ["0651", "0652", "0655", "0656"]
HOSPICE_SERVICE = "HOS"
ELECTIVE_ADMISSION = ["3"]

# What an enrolled month looks like.
BUY_IN = [
    "Part A and Part B",
    "Part A state buy-in",
    "Part B state buy-in",
    "Part A and Part B state buy-in",
]
NOT_DUAL = "NONDUAL"
DRUG_PLAN = "Enrolled in PTD for the month"
NO_MANAGED_CARE = "Not a member of an HMO"
DRUG_LINE = "PTD-DRUG"

# The periods.
YEAR = 2020
PANEL_START, PANEL_END = "2020-01-01", "2020-10-31"
INDEX_START, INDEX_END = "2020-10-01", "2020-10-31"
TARGET_START, TARGET_END = "2020-11-01", "2020-12-31"
YEAR_END = "2020-12-31"
MIN_AGE = 65

# Service codes counted per day.
SERVICE_CODES = {
    "TS_CLMLINES_OTP_NONDRUG": ["G2074", "G2076", "G2077"],
    "TS_CLMLINES_METHADONE_OTP_MAT": ["G2067", "G2078"],
    "TS_CLMLINES_METHADONE_INJ_NONOTP": ["J1230"],
    "TS_CLMLINES_BUPRENORPHINE_ORAL_OTP_MAT": ["G2068", "G2079"],
    "TS_CLMLINES_BUPRENORPHINE_INJ_OTP_MAT": ["G2069"],
    "TS_CLMLINES_BUPRENORPHINE_IMPL_OTP_MAT": ["G2070", "G2072"],
    "TS_CLMLINES_BUPRENORPHINE_INJ_NONOTP": ["J0592", "Q9991", "Q9992"],
    "TS_CLMLINES_NALTREXONE_INJ_OTP_MAT": ["G0273"],
    "TS_CLMLINES_NALTREXONE_INJ_NONOTP_MAT": ["J1235"],
    "TS_CLMLINES_OUD_PSYCHOTHERAPY": ["G2086", "G2087", "G2088"],
}
BUPRENORPHINE_ORAL_CODES = ["J0571", "J0572", "J0573", "J0574", "J0575"]
NALOXONE_CODES = ["G2215", "G2216"]

# Provider specialties.
DENTIST = ["19"]
PSYCHOLOGIST = ["62", "68"]
NURSE_OR_ASSISTANT = ["50", "97"]

# Drug names.
NOT_AN_OPIOID = "AMLODIPINE BESYLATE"
SHORT_ACTING_NAMES = [
    "HYDROCODONE/ACETAMINOPHEN",
    "HYDROCODONE/IBUPROFEN",
    "OXYCODONE HCL/ACETAMINOPHEN",
    "OXYCODONE HCL/ASPIRIN",
    "ACETAMINOPHEN WITH CODEINE",
    "BUTALBIT/ACETAMIN/CAFF/CODEINE",
    "BUTALBITAL/ASPIRIN/CAFFEINE",
    "CODEINE/BUTALBITAL/ASA/CAFFEIN",
]

# Condition columns and their readable names.
CONDITION_PRESENT = [1, 3]
CONDITION_NAMES = {
    "ATRIAL_FIB": "Afib",
    "ALZH_DEMEN": "Alz_Dem",
    "ALZH": "Alzheimers",
    "AMI": "Act_Myo_Inf",
    "ANEMIA": "Anemia",
    "ASTHMA": "Asthma",
    "CANCER_BREAST": "Breast_Cncr",
    "CATARACT": "Cataract",
    "CHF": "CHF",
    "CHRONICKIDNEY": "CKD",
    "COPD": "COPD",
    "CANCER_COLORECTAL": "Colorectal_Cncr",
    "DEPRESSION": "Depression",
    "DIABETES": "Diabetes",
    "CANCER_ENDOMETRIAL": "Endometrial_Cncr",
    "GLAUCOMA": "Glaucoma",
    "HIP_FRACTURE": "Hip_Fracture",
    "HYPERL": "Hyperlipidemia",
    "HYPERP": "Ben_Prost_Hyprpl",
    "HYPERT": "Hypertension",
    "HYPOTH": "Hypothyroidism",
    "ISCHEMICHEART": "Ischemic_HD",
    "CANCER_LUNG": "Lung_cncr",
    "OSTEOPOROSIS": "Osteoporosis",
    "RA_OA": "RA_Osteoarth",
    "STROKE_TIA": "Stroke",
    "CANCER_PROSTATE": "Prostate_Cncr",
    "ACP_MEDICARE": "Conduct_dis",
    "ALCO_MEDICARE": "Alcoholism",
    "ANXI_MEDICARE": "Anxiety",
    "AUTISM_MEDICARE": "Autism",
    "BIPL_MEDICARE": "Bipolar",
    "BRAINJ_MEDICARE": "Brain_injury",
    "CERPAL_MEDICARE": "Cerebral_palsy",
    "CYSFIB_MEDICARE": "Cystic_Fibrs",
    "DEPSN_MEDICARE": "Depressive_dis",
    "DRUG_MEDICARE": "Drug_use",
    "EPILEP_MEDICARE": "Epilepsy",
    "FIBRO_MEDICARE": "Fibromyalgia",
    "HEARIM_MEDICARE": "Hearing_imp",
    "HEPVIRAL_MEDICARE": "Hepatitis_viral",
    "HIVAIDS_MEDICARE": "HIVAIDS",
    "INTDIS_MEDICARE": "Intillectual_dsblty",
    "LEADIS_MEDICARE": "Learning_dsblty",
    "LEUKLYMPH_MEDICARE": "Leuk_lymph",
    "LIVER_MEDICARE": "Liver_dis",
    "MIGRAINE_MEDICARE": "Migraine",
    "MOBIMP_MEDICARE": "Mobility_impairment",
    "MULSCL_MEDICARE": "Multiple_sclrs",
    "MUSDYS_MEDICARE": "Muscular_dys",
    "OBESITY_MEDICARE": "Obesity",
    "OTHDEL_MEDICARE": "Other_developmental_dis",
    "OUD_ANY_MEDICARE": "Opioid_any",
    "OUD_DX_MEDICARE": "Opioid_dx",
    "OUD_HOSP_MEDICARE": "Opioid_hospitalization",
    "OUD_MAT_MEDICARE": "Opioid_medically_assisted",
    "PSDS_MEDICARE": "Personality_dis",
    "PTRA_MEDICARE": "PTSD",
    "PVD_MEDICARE": "Periph_vasc_dis",
    "SCD_MEDICARE": "Sickle_cell_disease",
    "SCHI_MEDICARE": "Schizophrenia",
    "SCHIOT_MEDICARE": "Schizophrenia_and_other_psychotic",
    "SPIBIF_MEDICARE": "Spina_bifida",
    "SPIINJ_MEDICARE": "Spinal_injury",
    "TOBA_MEDICARE": "Tobacco_use",
    "ULCERS_MEDICARE": "Ulcers",
    "VISUAL_MEDICARE": "Visual_imp",
}
LEAKING_CONDITIONS = [
    "CC_Opioid_any",
    "CC_Opioid_hospitalization",
    "CC_Opioid_dx",
    "CC_Opioid_medically_assisted",
    "CC_Drug_use",
]

# Area rank codes kept as they are, and the rank bins.
AREA_CODES = ["PH", "GQ", "PH-GQ", "QDI"]
AREA_BINS = [
    (0, 10.999, "0-10"),
    (11, 20.999, "11-20"),
    (21, 30.999, "21-30"),
    (31, 40.999, "31-40"),
    (41, 50.999, "41-50"),
    (51, 60.999, "51-60"),
    (61, 70.999, "61-70"),
    (71, 80.999, "71-80"),
    (81, 90.999, "81-90"),
    (91, 100, "91-100"),
]
UNASSIGNED = "Unassigned"

# The one-hot vocabulary; its order is the order of the columns.
VOCABULARY = {
    "STATIC_DEMO_sex_label": ["Female", "Male"],
    "STATIC_DEMO_state_cd": [
        "SC", "AZ", "LA", "MN", "NJ", "DC", "OR", "VA", "RI", "KY", "WY", "NH", "MI", "NV", "WI", "ID", "CA", "CT",
        "NE", "MT", "NC", "VT", "MD", "DE", "MO", "VI", "IL", "ME", "ND", "WA", "MS", "AL", "IN", "OH", "TN", "IA",
        "NM", "PA", "SD", "NY", "TX", "WV", "GA", "MA", "KS", "FL", "CO", "AK", "AR", "OK", "PR", "UT", "HI",
        "Unassigned",
    ],
    "STATIC_DEMO_race_label": [
        "Black or African-American",
        "Asian / Pacific Islander",
        "Unknown",
        "Other",
        "Hispanic",
        "American Indian / Alaska Native",
        "Non-Hispanic White",
    ],
    "STATIC_DEMO_crec_label": [
        "Old age and survivor’s insurance (OASI)",
        "End-stage renal disease (ESRD)",
        "Disability insurance benefits (DIB)",
    ],
    "STATIC_DEMO_RUCA1": ["1", "4", "2", "7", "3", "9", "10", "8", "6", "5"],
    "STATIC_DEMO_ADI_NATRANK_binned": [name for _, _, name in AREA_BINS] + [UNASSIGNED],
}

# Training rows above these rounded means are left out.
TRAINING_CAPS = {"TS_MME_ALL_SA__mean": 277, "TS_MME_ALL_LA__mean": 351}
