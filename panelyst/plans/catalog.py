"""Rule tables of the study: everything here is a fixed value.

Codes, labels, item lists, valid ranges and rule conditions must be exactly
these for results to agree with the study's published definitions. Rule
conditions are SQL predicates over the survey columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from string import ascii_uppercase as LETTERS

from panelyst.operators.columns import numbered
from panelyst.operators.prevalence import Question
from panelyst.operators.scales import Scale

KEYS = ["SITE1", "PID"]


def lettered(prefix: str, letters: str) -> list[str]:
    return [prefix + x for x in letters]


# --- Fixed values: sites, in display order -------------------------------------
SITE_CODES = {
    1: "CBW",
    2: "FRI",
    3: "NYSDA",
    4: "HBHC",
    5: "MHS",
    6: "PSU",
    7: "PFC",
    8: "SFDPH",
    9: "WFU",
    10: "WUSL",
}
SITE_LABELS = {
    "CBW": "C. Christi",
    "FRI": "L.A.",
    "NYSDA": "N.Y.",
    "HBHC": "Chicago",
    "MHS": "Cleveland",
    "PSU": "Hershey",
    "PFC": "Phil.",
    "SFDPH": "S.F.",
    "WFU": "W.-Salem",
    "WUSL": "St. Louis",
}
PADDED_SITE, PADDED_WIDTH = "WUSL", 4
REKEYED_SITE = "FRI"


# --- Fixed values: code-to-label recodes, with the adjudicated text that wins ---
@dataclass(frozen=True)
class Recode:
    source: str
    levels: dict[int, str]
    override: str | None = None


_TIMES = {
    1: "Several times a day",
    2: "Once a day",
    3: "Once every couple of days",
    4: "About once a week",
    5: "Less than once a week",
    6: "Never",
    8: "Refuse to answer",
    9: "Skipped",
}
RECODES = {
    "GENDER_RC": Recode(
        "GENDER",
        {
            1: "Male (cis man)",
            2: "Female (cis woman)",
            3: "Trans-identified",
            4: "Trans-identified",
            5: "Other gender",
            6: "Other gender",
            8: "Refuse to answer",
        },
        "GENDERRECODE",
    ),
    "ORIENT_RC": Recode(
        "ORIENT",
        {
            1: "Straight",
            2: "Gay or lesbian",
            3: "Bisexual",
            4: "Other orientation",
            5: "Other orientation",
            7: "Other orientation",
            8: "Refuse to answer",
        },
        "ORIENTRECODE",
    ),
    "GRADE_RC": Recode(
        "GRADE",
        {
            **dict.fromkeys((1, 2, 3), "High school, equivalent or less"),
            4: "Some post-K12",
            **dict.fromkeys((5, 6, 7), "College graduate or trade certification"),
            8: "Refuse to answer",
        },
    ),
    "STAY7D_RC": Recode(
        "STAY7D",
        {
            1: "Stable housing",
            **dict.fromkeys(range(2, 12), "Unstable housing"),
            12: "Other residence",
            98: "Refuse to answer",
        },
        "STAYRECODE",
    ),
    "ARTADHR_RC": Recode(
        "ARTADHR",
        {
            **dict.fromkeys((1, 2), "Negative"),
            3: "Neutral",
            **dict.fromkeys((4, 5, 6), "Positive"),
            **dict.fromkeys((8, 9), "Missing"),
        },
    ),
}
REPORT_RECODES = {
    "SCREEN5": {
        1: "Within past 12 months",
        2: "More than 12 months ago",
        7: "Don't know",
        8: "Refuse to answer",
    },
    "ViralSupp_MCD": {0: "Not suppressed", 1: "Suppressed"},
}
TECH_RECODES = {
    "S56_3": {
        1: "Have cell phone, minutes, and data",
        2: "Have cell phone, minutes, and no data",
        3: "Have cell phone, data, and no minutes",
        4: "I share a phone",
        5: "Don't have own cell, can borrow one",
        6: "Don't have own cell, can't borrow one",
        8: "Refuse to answer",
    },
    **dict.fromkeys(("S56_4", "S56_7", "S56_13", "S56_16", "S56_21"), _TIMES),
    "S56_11": {
        0: "Facebook",
        1: "Facebook Messenger",
        2: "Twitter",
        3: "Instagram",
        4: "Snapchat",
        5: "WhatsApp",
        6: "Skype",
        7: "Kik",
        8: "Vine",
        9: "Tumblr",
        10: "Pinterest",
        11: "Other",
        98: "Refuse to answer",
        99: "Skipped",
    },
    "S56_20": {
        1: "Tinder",
        2: "Grindr",
        3: "Growler",
        4: "Jack'd",
        5: "Scruff",
        6: "Badoo",
        7: "Craigslist",
        8: "Plenty of Fish (POF)",
        9: "Adam4Adam (A4a)",
        10: "Hinge",
        11: "Bumble",
        12: "Other",
        98: "Refuse to answer",
        99: "Skipped",
    },
    "S56_23": {
        1: "Every day, more than 1 hour",
        2: "Every day, less than 1 hour",
        3: "Almost every day",
        4: "A couple times a week",
        5: "Once a week",
        6: "Less than once a week",
        7: "Never",
        8: "Refuse to answer",
    },
}


# --- Fixed values: ordered rules; a default in braces names a column -----------
@dataclass(frozen=True)
class Ladder:
    rules: tuple[tuple[str, str], ...]
    fallback_column: str | None = None
    default: str | None = None


LADDERS = {
    "RACE_RC": Ladder(
        (
            ("LATINO = 1", "Latino"),
            ("RACEC = 1", "Black, Not Latino"),
            ("RACEE = 1 AND RACE > 1", "White Mixed-Race, Not Latino or Black"),
            ("RACEE = 1", "White, Not Latino"),
            ("LATINO = 8 AND RACE = 8", "Refuse to answer"),
        ),
        "RACERECODE",
        "Other race",
    ),
    "ViralSupp_MCD_RC": Ladder(
        (("ViralSupp_MCD = 1", "Suppressed"), ("ViralSupp_MCD = 0", "Not suppressed"), ("ViralSupp_MCD IS NULL", "Missing"))
    ),
    "INSURE_RC": Ladder(
        (
            ("INSUREA = 1", "Not insured"),
            ("INSURE = 97", "Don't know"),
            ("INSURE = 98", "Refuse to answer"),
            ("INSURE = 99", "Skipped"),
            (" OR ".join(f"{c} = 1" for c in lettered("INSURE", "BCDEFG")), "Insured"),
        ),
        "INSURERECODE",
    ),
    "CARED6_RC": Ladder(
        (("CARED6 = 0", "No"), ("CARED6 > 0 AND CARED6 < 998", "Yes"), ("CARED6 >= 998", "Missing"))
    ),
    "CAREHV06_RC": Ladder(
        (
            ("CARELHIV = 1 AND CAREHV06 > 0", "Yes"),
            ("CARELHIV = 0 OR CAREHV06 = 0", "No"),
            ("CARELHIV = 8", "Missing"),
        )
    ),
    "CAREHV06_MCD_RC": Ladder(
        (("CAREHV06_MCD > 0", "Yes"), ("CAREHV06_MCD = 0", "No"), ("CAREHV06_MCD IS NULL", "Missing"))
    ),
    "ARTNOW_RC": Ladder((("ARTNOW = 1", "Yes"), ("ARTNOW = 0", "No")), default="Missing"),
    "INJECTL_RC": Ladder((("INJECTL = 1", "Yes"), ("INJECTL = 0", "No")), default="Missing"),
}


# --- Fixed values: dummies; first entry of ``levels`` is the reference ---------
@dataclass(frozen=True)
class Dummies:
    source: str
    reference: str
    levels: dict[str, str | tuple[str, ...]]


_YES_NO = {"No": "No", "Yes": "Yes", "Missing": "Missing"}
DUMMIES = {
    "SITE": Dummies("SITE1", "CBW", {c: c for c in SITE_CODES.values()}),
    "surveylanguage": Dummies("surveylanguage", "Span", {"Span": "Spanish", "Eng": "English"}),
    "RACE": Dummies(
        "RACE_RC",
        "White",
        {
            "White": "White, Not Latino",
            "Latino": "Latino",
            "Black": "Black, Not Latino",
            "WhiteMix": "White Mixed-Race, Not Latino or Black",
            "Other": "Other race",
            "Missing": "Refuse to answer",
        },
    ),
    "GENDER": Dummies(
        "GENDER_RC",
        "Male",
        {
            "Male": "Male (cis man)",
            "Female": "Female (cis woman)",
            "Trans": "Trans-identified",
            "Other": "Other gender",
            "Missing": "Refuse to answer",
        },
    ),
    "ORIENT": Dummies(
        "ORIENT_RC",
        "Straight",
        {
            "Straight": "Straight",
            "Gay": "Gay or lesbian",
            "Bi": "Bisexual",
            "Other": "Other orientation",
            "Missing": "Refuse to answer",
        },
    ),
    "GRADE": Dummies(
        "GRADE_RC",
        "HS",
        {
            "HS": "High school, equivalent or less",
            "PostK": "Some post-K12",
            "Grad": "College graduate or trade certification",
            "Missing": "Refuse to answer",
        },
    ),
    "MONEY": Dummies(
        "MONEY_RC_Cat", "Zero", {"Zero": "Zero", "Low": "Low", "High": "High", "DontKnow": "Don't know"}
    ),
    "STAY7D": Dummies(
        "STAY7D_RC",
        "Unstable",
        {"Unstable": "Unstable housing", "Stable": "Stable housing", "Missing": "Refuse to answer"},
    ),
    "ViralSupp": Dummies(
        "ViralSupp_MCD_RC",
        "Unsuppressed",
        {"Unsuppressed": "Not suppressed", "Suppressed": "Suppressed", "Missing": "Missing"},
    ),
    "INSURE": Dummies(
        "INSURE_RC",
        "Uninsured",
        {
            "Uninsured": "Not insured",
            "Insured": "Insured",
            "Unknown": "Don't know",
            "Missing": ("Refuse to answer", "Skipped"),
        },
    ),
    "CARED6": Dummies("CARED6_RC", "No", _YES_NO),
    "CAREHV06_MCD": Dummies("CAREHV06_MCD_RC", "No", _YES_NO),
    "ARTNOW": Dummies("ARTNOW_RC", "No", _YES_NO),
    "ARTADHR": Dummies(
        "ARTADHR_RC",
        "Negative",
        {"Negative": "Negative", "Neutral": "Neutral", "Positive": "Positive", "Missing": "Missing"},
    ),
    "INJECTL": Dummies("INJECTL_RC", "No", _YES_NO),
}


# --- Fixed values: check-box groups, with the adjudicated text that also counts --
@dataclass(frozen=True)
class Boxes:
    boxes: tuple[str, ...]
    text: str
    pattern: str
    all_known: bool = False  # NULL as soon as one box is missing


BOX_FLAGS = {
    "DISC_RCD_Partner": Boxes(("DISCB", "DISCC"), "DISCRECODE", "Partner"),
    "DISC_RCD_Family": Boxes(("DISCD", "DISCE"), "DISCRECODE", "Family"),
    "DISC_RCD_Other": Boxes(("DISCF", "DISCG", "DISCH", "DISCI"), "DISCRECODE", "Other"),
    "DRUG_RCD_Alcohol": Boxes(("DRUG1LA",), "DRUGRECODE", "Alcohol"),
    "DRUG_RCD_Tobacco": Boxes(("DRUG1LB",), "DRUGRECODE", "Tobacco"),
    "DRUG_RCD_Marijuana": Boxes(("DRUG1LC",), "DRUGRECODE", "Marijuana"),
    "DRUG_RCD_Other": Boxes(
        (*lettered("DRUG1L", LETTERS[3:12]), *lettered("DRUG2L", LETTERS[:9])), "DRUGRECODE", "Other", all_known=True
    ),
}
DISC_VALID = range(1, 11)
REFUSED = 98
MONEY_UNKNOWN = (99997, 99998)
SINCE_BIRTH = 2099

# --- Fixed values: outcome indicators ------------------------------------------
OUTCOMES = {
    "outcome_Search_SexHealth": (lettered("S56_25", "BCDEFG"), None),
    "outcome_Search_GenHealth": (lettered("S56_25", "AHIJK"), "outcome_SGen_RECODE"),
    "outcome_Comms_SexHealth": (
        [f"S56_{q}{x}" for q in (6, 9, 15, 18) for x in "KM"],
        None,
    ),
}
RECODE_COLUMNS = [
    "GENDERRECODE",
    "RACERECODE",
    "ORIENTRECODE",
    "STAYRECODE",
    "INSURERECODE",
    "DISCRECODE",
    "DRUGRECODE",
    "outcome_SSex_RECODE",
    "outcome_SGen_RECODE",
]

# --- Fixed values: scales --------------------------------------------------------
SCALES = [
    Scale("SOCIALS_RC", tuple(numbered("SOCIALS", range(1, 4))), 10, "Social Support"),
    Scale("STIGMA_RC", tuple(numbered("STIGMA", range(1, 11))), 4, "HIV-related Stigma"),
    Scale("HE_RC_HAL", tuple(numbered("HE", range(1, 5), 2)), 4, "Health Access Literacy"),
    Scale("HE_RC_HSE", tuple(numbered("HE", range(6, 11), 2)), 4, "Health Self-Efficacy"),
    Scale("CARE_RC", tuple(numbered("CARE", range(1, 11), 2)), 5, "Provider Empathy", all_missing=0),
    Scale(
        "MENTALH_RC",
        tuple(numbered("MENTALH", range(1, 4))),
        6,
        "Physical and Mental Health",
        reverse={"MENTALH3": 7},
    ),
    Scale("MTUEX_RC", tuple(numbered("MTUEX", range(1, 5))), 9, "E-mailing"),
    Scale("MTUSPX_RC_Text", tuple(numbered("MTUSPX", (1, 2, 12), 2)), 9, "Text Messaging", skip_null=False),
    Scale("MTUSPX_RC_Smartphone", tuple(numbered("MTUSPX", range(3, 12), 2)), 9, "Smartphone Usage"),
    Scale("MTUIX_RC", tuple(numbered("MTUIX", range(1, 5))), 9, "Internet Searching"),
    Scale(
        "MTUSNX_RC", tuple(numbered("MTUSNX", range(1, 10), 2)), 9, "General Social Media Usage", remap={99: 0}
    ),
    Scale(
        "MTUAX_RC_Pos", tuple(numbered("MTUAX", (1, 3, 4, 9, 10, 11), 2)), 5, "Positive Attitudes Toward Technology"
    ),
    Scale(
        "MTUAX_RC_Anx",
        tuple(numbered("MTUAX", (5, 6, 8), 2)),
        5,
        "Anxiety About Being Without Technology or Dependence on Technology",
    ),
    Scale("MTUAX_RC_Neg", tuple(numbered("MTUAX", (12, 13, 14), 2)), 5, "Negative Attitudes Toward Technology"),
]
# Items that are cleaned but belong to no score.
SINGLE_ITEMS = [
    Scale("", ("MENTALH4",), 6),
    Scale("", ("MTUIX5", "MTUIX6"), 9),
    Scale("", ("MTUSNX10", "MTUSNX11", "MTUSNX12"), 9, remap={99: 0}),
    Scale("", ("MTUAX02", "MTUAX07"), 5),
]

# --- Fixed values: health-search questions ---------------------------------------
TRANS, SEXUAL, GENERAL = "Trans Health", "Sexual Health", "General Health"
LIFETIME, SIX_MONTHS = "Lifetime", "Last 6 Months"
_HEALTH_TOPICS = [  # topic, category, lifetime item, six-month item
    ("Hormone Therapy", TRANS, "S56_24XM", "S56_26A"),
    ("Trans Surgeries/Procedures", TRANS, "S56_24XN", "S56_26B"),
    ("Healthcare Services", GENERAL, "S56_25A", "S56_26C"),
    ("HIV Testing", SEXUAL, "S56_25B", "S56_26D"),
    ("STD Symptoms", SEXUAL, "S56_25C", "S56_26E"),
    ("STD Testing/Treatment", SEXUAL, "S56_25D", "S56_26F"),
    ("PrEP", SEXUAL, "S56_25E", "S56_26G"),
    ("PEP", SEXUAL, "S56_25F", "S56_26H"),
    ("Free Condoms", SEXUAL, "S56_25G", "S56_26I"),
    ("Diet/Nutrition", GENERAL, "S56_25H", "S56_26J"),
    ("Exercise", GENERAL, "S56_25I", "S56_26K"),
    ("Cold/Flu Symptoms", GENERAL, "S56_25J", "S56_26L"),
    ("Medication", GENERAL, "S56_25K", "S56_26M"),
    ("Other", GENERAL, "S56_25L", "S56_26N"),
]
HEALTH_QUESTIONS = [
    Question("S56_24XL", SEXUAL, "Sex and Sexuality", LIFETIME, in_any=False),
    *[Question(q, cat, topic, LIFETIME) for topic, cat, q, _ in _HEALTH_TOPICS],
    *[Question(q, cat, topic, SIX_MONTHS) for topic, cat, _, q in _HEALTH_TOPICS],
]

# --- Fixed values: communication questions -----------------------------------------
PLATFORMS = {6: "Text Messaging", 9: "Email", 15: "Social Media", 18: "Private Messaging"}
LIFESTYLE, RELATIONS, LGBTQ = "Lifestyle", "Relationships/Sex", "LGBTQ Topics"
_COMM_TOPICS = [  # letters A to R in order
    ("Music/Movies/Television", LIFESTYLE),
    ("Work", LIFESTYLE),
    ("School", LIFESTYLE),
    ("Drinking/Drugs/Partying", LIFESTYLE),
    ("Friends/Family Positives", LIFESTYLE),
    ("Friends/Family Negatives", LIFESTYLE),
    ("Social Services", LIFESTYLE),
    ("Love/Relationships", RELATIONS),
    ("Sex", RELATIONS),
    ("Sex Work (Clients/Dates)", RELATIONS),
    ("Safe Sex", SEXUAL),
    ("Sexual Identity/Attraction", LGBTQ),
    ("HIV Status/Care", SEXUAL),
    ("LGBTQ Videos", LGBTQ),
    ("Non-LGBTQ Videos", LIFESTYLE),
    ("Hormone Therapy", LGBTQ),
    ("Other Gender Identity", LGBTQ),
    ("Other", LIFESTYLE),
]
COMM_QUESTIONS = [
    Question(f"S56_{number}{letter}", cat, topic, platform, in_any=topic != "Other")
    for number, platform in PLATFORMS.items()
    for letter, (topic, cat) in zip(LETTERS, _COMM_TOPICS)
] + [
    Question("S56_12M", LGBTQ, "Support LGBTQ Groups/Causes*", "Social Media", in_any=False),
    Question("S56_12O", LGBTQ, "Trans/Non-Conforming Procedures*", "Social Media", in_any=False),
    Question("S56_12P", SEXUAL, "HIV Information/Care*", "Social Media", in_any=False),
    Question("S56_12Q", LIFESTYLE, "Play Games*", "Social Media", in_any=False),
]

# --- Fixed values: reports -----------------------------------------------------------
AGE_EDGES, AGE_LABELS = [25], ["18-24 Years", "25-34 Years"]
TABLE1_FACTORS = {
    "Age Groups": "Age Groups",
    "RACE_RC": "Ethnicity and Race",
    "GENDER_RC": "Gender Identity",
    "ORIENT_RC": "Sexual Orientation",
    "GRADE_RC": "Education",
    "STAY7D_RC": "Current Residence",
}
TABLE1_ORDER = {
    "Age Groups": ["18-24 Years"],
    "Ethnicity and Race": [
        "Latino",
        "Black, Not Latino",
        "White, Not Latino",
        "White Mixed-Race, Not Latino or Black",
    ],
    "Gender Identity": ["Male (cis man)", "Female (cis woman)", "Trans-identified"],
    "Sexual Orientation": ["Straight", "Gay or lesbian", "Bisexual"],
    "Education": ["High school, equivalent or less", "Some post-K12"],
    "Current Residence": ["Stable housing"],
    "HIV Diagnosis": ["Within past 12 months", "More than 12 months ago"],
}
TABLE2_FACTORS = {
    "SCREEN5": "HIV Diagnosis",
    "ViralSupp_MCD": "Viral Suppression",
    "INSURE_RC": "Insurance",
    "CARED6_RC": "Non-HIV Care Visit, 6 Months",
    "CAREHV06_MCD_RC": "HIV Care Visit, 6 Months",
    "DISC_RC": "HIV Disclosure Status",
}
# Levels that the printed table leaves out.
TABLE2_HIDDEN = {
    "Viral Suppression": ["Not suppressed"],
    "Non-HIV Care Visit, 6 Months": ["No"],
    "HIV Care Visit, 6 Months": ["No"],
    "HIV Disclosure Status": ["Did not disclose"],
    "Injected Substance Use": ["Did not inject drugs"],
}
TABLE2_DRUGS = {
    "DRUG_RCD_None": "None",
    "DRUG_RCD_Alcohol": "Alcohol",
    "DRUG_RCD_Tobacco": "Tobacco",
    "DRUG_RCD_Marijuana": "Marijuana",
    "DRUG_RCD_Other": "Other non-injected drug(s)",
}
TABLE2_SCALES = {
    "HE_RC_HAL": "Health Access Literacy",
    "HE_RC_HSE": "Health Self-Efficacy",
    "CARE_RC": "Provider Empathy",
    "SOCIALS_RC": "Social Support",
    "STIGMA_RC": "HIV-Related Stigma",
    "MENTALH_RC": "Mental Health",
}
TABLE3_SCALES = {
    "MTUEX_RC": "Email usage",
    "MTUSPX_RC_Text": "Text messaging",
    "MTUSPX_RC_Smartphone": "Smartphone usage",
    "MTUIX_RC": "Internet searching",
    "MTUSNX_RC": "General social media usage",
    "MTUAX_RC_Pos": "Positive attitudes toward technology",
    "MTUAX_RC_Anx": "Anxiety and dependence on technology",
    "MTUAX_RC_Neg": "Negative attitudes toward technology",
}
TABLE3_DEVICES = {
    "S56_1A": "Cell Phone",
    "S56_1B": "Tablet",
    "S56_1C": "Other mobile device",
    "S56_1D": "Laptop",
    "S56_1E": "Desktop computer",
    "S56_1F": "Other",
    "S56_1G": "No devices",
}
TABLE3_KEEP_DEVICE = "S56_1G"
OFTEN = "Several times a day"
TABLE3_OFTEN = {
    "S56_4": "Text messaging",
    "S56_7": "E-mail",
    "S56_13": "SNS",
    "S56_16": "Private messaging",
}
TABLE3_INTERNET = ("S56_23", "Used more than 1 hour a day", "Every day, more than 1 hour")
CHI_SQUARE_EXTRA = {
    "DRUG_RCD_Alcohol": "Substance Use: Alcohol",
    "DRUG_RCD_Tobacco": "Substance Use: Tobacco",
    "DRUG_RCD_Marijuana": "Substance Use: Marijuana",
    "DRUG_RCD_Other": "Substance Use: Other Non-Injected",
}
ANOVA_VARIABLES = {
    "MONEY_RC_Log": "Table 1",
    **dict.fromkeys(("HE_RC_HAL", "HE_RC_HSE", "CARE_RC", "MENTALH_RC"), "Table 2"),
    **dict.fromkeys(TABLE3_SCALES, "Table 3"),
}
ATTRITION_FACTORS = ["AGE_RC", "RACE_RC", "GENDER_RC", "ORIENT_RC", "GRADE_RC", "STAY7D_RC", "INSURE_RC"]
ATTRITION_MERGE = {"RACE_RC": {"White Mixed-Race, Not Latino or Black": "White, Not Latino"}}
ATTRITION_PREDICTORS = ["AGE", "MONEY_RC_Log"]

# --- Fixed values: labels of the analysis variables, in codebook order --------------
_SITE_CITY = {
    "FRI": "Los Angeles",
    "NYSDA": "New York",
    "HBHC": "Chicago",
    "MHS": "Cleveland",
    "PFC": "Philadelphia",
    "PSU": "Hershey",
    "SFDPH": "San Francisco",
    "WFU": "Winston-Salem",
    "WUSL": "St. Louis",
}
ANALYSIS_LABELS = {
    **{f"SITE_RCD_{code}": f"Site: {city}" for code, city in _SITE_CITY.items()},
    "surveylanguage_RCD_Eng": "Survey Language: English",
    "AGE_RC": "Age (Years)",
    "RACE_RCD_Latino": "Ethnicity and Race: Latino",
    "RACE_RCD_Black": "Ethnicity and Race: Black, Not Latino",
    "RACE_RCD_WhiteMix": "Ethnicity and Race: White Mixed-Race, Not Latino or Black",
    "RACE_RCD_Other": "Ethnicity and Race: Other",
    "GENDER_RCD_Female": "Gender: Female (cis woman)",
    "GENDER_RCD_Trans": "Gender: Trans-identified",
    "GENDER_RCD_Other": "Gender: Other",
    "ORIENT_RCD_Gay": "Sexual Orientation: Gay or Lesbian",
    "ORIENT_RCD_Bi": "Sexual Orientation: Bisexual",
    "ORIENT_RCD_Other": "Sexual Orientation: Other",
    "GRADE_RCD_PostK": "Education: Some Post-K12",
    "GRADE_RCD_Grad": "Education: College Graduate or Trade-Certified",
    "MONEY_RCD_Low": "Income Last Month: Low (Under Median)",
    "MONEY_RCD_High": "Income Last Month: High (At or Above Median)",
    "MONEY_RCD_DontKnow": "Income Last Month: Don't Know",
    "STAY7D_RCD_Stable": "Housing Last 7 Days: Stable Housing",
    "BORNHIV": "Born with HIV",
    "TIMESINCEHIV": "Years Since HIV Diagnosis",
    "ViralSupp_RCD_Suppressed": "Viral Suppression (Self-reported)",
    "INSURE_RCD_Insured": "Insurance: Insured",
    "INSURE_RCD_Unknown": "Insurance: Don't Know",
    "CARED6_RCD_Yes": "Non-HIV Care Visits, Past 6 Months: Yes",
    "CAREHV06_MCD_RCD_Yes": "HIV Care Visits, Past 6 Months: Yes",
    "CAREHV06_MCD_RCD_Missing": "HIV Care Visits, Past 6 Months: Missing",
    "ARTNOW_RCD_Yes": "Taking ART/HIV Medication Now: Yes",
    "ARTNOW_RCD_Missing": "Taking ART/HIV Medication Now: Missing",
    "ARTADHR_RCD_Neutral": "ART Adherence: Neutral",
    "ARTADHR_RCD_Positive": "ART Adherence: Positive",
    "HE_RC_HAL": "YEHS: Health Access Literacy Subscale",
    "HE_RC_HSE": "YEHS: Health Self-Efficacy Subscale",
    "CARE_RC": "Provider Empathy Scale",
    "STIGMA_RC": "HIV-related Stigma Scale",
    "DISC_RCD_Anyone": "HIV Status Disclosed",
    "MENTALH_RC": "Physical and Mental Health Scale",
    "MENTALH4_RC": "Physical Health (1 item)",
    "DRUG_RCD_Alcohol": "Substance Use: Alcohol",
    "DRUG_RCD_Tobacco": "Substance Use: Tobacco",
    "DRUG_RCD_Marijuana": "Substance Use: Marijuana",
    "DRUG_RCD_Other": "Substance Use: Other Non-Injected",
    "DRUG_RCD_Uses": "Substance Use Other Than Alcohol",
    "INJECTL_RCD_Yes": "Injected Substance Use: Yes",
    "INJECTL_RCD_Missing": "Injected Substance Use: Missing",
    "SOCIALS_RC": "Social Support Scale",
    "MTUEX_RC": "MTUAS: Email Usage Subscale",
    "MTUSPX_RC_Text": "MTUAS: Text Usage Subscale",
    "MTUSPX_RC_Smartphone": "MTUAS: Smartphone Usage Subscale",
    "MTUIX_RC": "MTUAS: Internet Search Usage Subscale",
    "MTUSNX_RC": "MTUAS: General Social Media Usage Subscale",
    "MTUAX_RC_Pos": "MTUAS: Positive Attitudes",
    "MTUAX_RC_Anx": "MTUAS: Anxiety/Dependence on Technology",
    "MTUAX_RC_Neg": "MTUAS: Negative Attitudes",
}
# Kept for analysis though they carry no label.
UNLABELLED = [
    "RACE_RCD_Missing",
    "GENDER_RCD_Missing",
    "STAY7D_RCD_Missing",
    "INSURE_RCD_Missing",
    "CARED6_RCD_Missing",
    "DISC_RCD_Missing",
    *OUTCOMES,
]
ANALYSIS_COLUMNS = [*ANALYSIS_LABELS, *UNLABELLED]

# --- Fixed values: columns kept from the baseline survey ------------------------------
BASELINE_NAMES = [
    "SITE1",
    "PID",
    "TODAY",
    "surveylanguage",
    "INTRVWER",
    "SITE",
    "SCREEN1",
    "LATINO",
    "SEXBRTH",
    "INSCHOOL",
    "GRADE",
    "MONEY",
    "RELSTAT",
    "BORNHIV",
    "DIAGHIV",
    "SCREEN5",
    "ADAP",
    "CARELHIV",
    "ARTNOW",
    "ARTADHR",
    "INJECTL",
]
BASELINE_PREFIXES = [
    "AGE",
    "DOB",
    "RACE",
    "GENDER",
    "ORIENT",
    "EMPLOY",
    "LIVED",
    "STAY7",
    "INSURE",
    "CAREHV",
    "HE",
    "DISC",
    "STIGMA",
    "MENTALH",
    "SOCIALS",
    "MTUEX",
    "MTUSPX",
    "MTUIX",
    "MTUSNX",
    "MTUAX",
]
BASELINE_PATTERNS = ["CARE[a-z]6", r"CARE\d{2}", r"DRUG\dL", r"DRUG\d6"]
# Questionnaire versions of the follow-up: retired letters and what replaced them.
RETIRED = "LMNOPQRS"
HARMONISED = {f"S56_24X{x}": f"S56_24{x}" for x in RETIRED}
SEARCH_ITEMS = lettered("S56_24", LETTERS[:11])
EXTRA_SEARCH_ITEMS = list(HARMONISED)
SEARCH_FREQUENCY, NEVER_SEARCHES, NOT_ASKED = "S56_23", 7, 9
