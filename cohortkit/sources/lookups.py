"""Small in-code tables and default parameters.

Everything here is a value a result depends on (vocabulary ids, names,
thresholds), not logic.  The tables are a few dozen rows each, so joining them
with a broadcast is bounded by construction.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Administration routes.  concept_id|concept_name|class, where an
# empty class means "known route, neither parenteral nor enteral".
ROUTES = """
40490898|Lower respiratory tract route|
4171884|Intravenous peripheral route|parenteral
4170113|Intravenous central route|parenteral
44801748|Haemodiafiltration route|parenteral
4233974|Urethral route|
45956875|Route of administration not applicable|
40486069|Respiratory tract route|
4222259|Intraventricular route - cardiac|parenteral
4132711|Nasogastric route|enteral
4163770|Subconjunctival route|
4006860|Intra-articular route|
4243022|Intraperitoneal route|parenteral
40487501|Digestive tract route|enteral
4240824|Intra-arterial route|parenteral
40492287|Intravascular route|parenteral
4302612|Intramuscular route|parenteral
0|No matching concept|missing
4229543|Intratracheal route|
4156707|Intrapleural route|
4142048|Subcutaneous route|
40492301|Intragastric route|enteral
4213522|Intraosseous route|parenteral
4269621|Intrauterine route|
40489990|Intracolonic route|
4303409|Intracameral route|
4292410|Intraluminal route|parenteral
40489989|Intrajejunal route|enteral
4171047|Intravenous route|parenteral
4305834|Nasojejunal route|enteral
4133177|Jejunostomy route|enteral
4222254|Body cavity route|
4157760|Intraocular route|
4156706|Intradermal route|
4217202|Intrathecal route|
4262099|Transdermal route|
4132254|Gastrostomy route|enteral
3440180|Intrathecal route|
4186834|Gastroenteral route|enteral
4172316|Nasoduodenal route|enteral
4232601|Transmucosal route|
4303277|Oropharyngeal route|enteral
4167393|Intrathoracic route|
4168656|Intratympanic route|
4157758|Intralesional route|
4302785|Intravitreal route|
4302354|Intraduodenal route|enteral
40493258|Intrahepatic route|enteral
4303795|Orogastric route|enteral
4169440|Intrasinal route|enteral
46272911|Intraneural route|
4184451|Ophthalmic route|
4312507|Injection route|parenteral
4262914|Nasal route|
4157759|Intralymphatic route|
4186838|Intravesical route|
4011083|By inhalation|
44814650|No information|missing
3661892|PEG tube route|enteral
4223965|Intrabiliary route|
35807218|Topical|
35807334|Nasal|
4263689|Topical route|
4167540|Enteral route|enteral
35807246|Intramuscular|parenteral
4181897|Buccal route|
4163765|Dental route|
35627167|Percutaneous|parenteral
4112421|Intravenous|parenteral
35807199|Intravenous|parenteral
35807338|Intrathecal|
4023156|Otic route|
4132161|Oral route|enteral
45956874|Inhalation|
4290759|Rectal route|
35807427|Inhalation|
44814649|Other|missing
4057765|Vaginal route|
4120036|Inhaling|
4231622|Topical|
35807209|Rectal|
4128794|Oral|enteral
35807196|Oral|enteral
"""

# Laboratory concepts.  concept_id|measure_name
LABS = """
44817130|pct
3046279|pct
3010813|wbc
40652446|wbc
3003282|wbc
3000905|wbc
"""

# Census regions.  state_name|state|region|division
STATES = """
Alaska|AK|West|Pacific
Alabama|AL|South|East South Central
Arkansas|AR|South|West South Central
Arizona|AZ|West|Mountain
California|CA|West|Pacific
Colorado|CO|West|Mountain
Connecticut|CT|Northeast|New England
District of Columbia|DC|South|South Atlantic
Delaware|DE|South|South Atlantic
Florida|FL|South|South Atlantic
Georgia|GA|South|South Atlantic
Hawaii|HI|West|Pacific
Iowa|IA|Midwest|West North Central
Idaho|ID|West|Mountain
Illinois|IL|Midwest|East North Central
Indiana|IN|Midwest|East North Central
Kansas|KS|Midwest|West North Central
Kentucky|KY|South|East South Central
Louisiana|LA|South|West South Central
Massachusetts|MA|Northeast|New England
Maryland|MD|South|South Atlantic
Maine|ME|Northeast|New England
Michigan|MI|Midwest|East North Central
Minnesota|MN|Midwest|West North Central
Missouri|MO|Midwest|West North Central
Mississippi|MS|South|East South Central
Montana|MT|West|Mountain
North Carolina|NC|South|South Atlantic
North Dakota|ND|Midwest|West North Central
Nebraska|NE|Midwest|West North Central
New Hampshire|NH|Northeast|New England
New Jersey|NJ|Northeast|Middle Atlantic
New Mexico|NM|West|Mountain
Nevada|NV|West|Mountain
New York|NY|Northeast|Middle Atlantic
Ohio|OH|Midwest|East North Central
Oklahoma|OK|South|West South Central
Oregon|OR|West|Pacific
Pennsylvania|PA|Northeast|Middle Atlantic
Rhode Island|RI|Northeast|New England
South Carolina|SC|South|South Atlantic
South Dakota|SD|Midwest|West North Central
Tennessee|TN|South|East South Central
Texas|TX|South|West South Central
Utah|UT|West|Mountain
Virginia|VA|South|South Atlantic
Vermont|VT|Northeast|New England
Washington|WA|West|Pacific
Wisconsin|WI|Midwest|East North Central
West Virginia|WV|South|South Atlantic
Wyoming|WY|West|Mountain
"""

# Ingredient labels, tried in this order (some repeat), and the
# fragments that mark a row to drop when no label applies.
DRUG_LABELS = (
    "vancomycin", "cefepime", "ceftriaxone", "azithromycin", "cefazolin",
    "amoxicillin", "doxycycline", "cephalexin", "piperacillin", "metronidazole",
    "sulfamethoxazole", "ampicillin", "meropenem", "ampicillin", "levofloxacin",
    "ciprofloxacin", "daptomycin", "linezolid", "clindamycin", "metronidazole",
    "penicillin", "daptomycin", "cefdinir", "aztreonam", "gentamicin",
    "moxifloxacin", "ceftazidime", "ertapenem", "tobramycin", "minocycline",
    "nitrofurantoin", "cefpodoxime", "cefuroxime", "kanamycin", "ofloxacin",
    "nafcillin", "cefoxitin", "fosfomycin", "cefotaxime", "imipenem",
    "tetracycline", "clarithromycin", "amikacin", "colistin", "tedizolid",
    "cefixime", "dalbavancin", "ceftolozane", "plazomicin", "spectinomycin",
    "oxacillin", "erythromycin", "cefaclor", "cefadroxil", "ceftaroline",
    "omadacycline", "tigecycline", "cefotetan",
)
DROP_LABELS = (
    "tazobactam", "sulbactam", "sulfamethoxazole", "bacitracin", "clavulanate",
    "methenamine",
)
DROP = "DROP"

# Vocabulary ids.
ANTIBIOTIC_CODESET = 54810628
EXTENDED_SPECTRUM_CODESET = 192654943
VASOPRESSOR_CODESET = 593515761
VENTILATION_SET_NAME = "[ICU/MODS]IMV"
ECMO_SET_NAME = "Kostka - ECMO"
LATE_INFECTION_CONCEPTS = (
    193688, 1326482, 1326483, 1403028, 1403029, 3154244, 3157127, 3157136,
    3182508, 3302715, 3333447, 3344537, 3399378, 4217284, 4225690, 4265457,
    4307981, 35205420, 37312146, 40565482, 42483658, 44826288, 45436339,
    45436856, 45436861, 45450116, 45552153, 45763575,
)

# How an exposure without a recorded route is resolved.
ENTERAL_NAME_PARTS = ("oral", "tablet", "capsule")
PARENTERAL_NAME_PARTS = ("injectable", "injection", "syringe")
ENTERAL_CONCEPTS = (
    1734104, 1738521, 1707164, 1742253, 997881, 35861919, 1742287, 35151057,
)
PARENTERAL_CONCEPTS = (1736887, 1836241, 46274210, 36789702, 45774861, 46221507)
DOMINANT_RATE = 0.9

# Comorbidity points.  Each component is a list of
# (condition stem, points); the first stem present wins.
SCORE_COMPONENTS = {
    "CCI_mi": [("MYOCARDIALINFARCTION", 1)],
    "CCI_chf": [("CONGESTIVEHEARTFAILURE", 1)],
    "CCI_pvd": [("PERIPHERALVASCULARDISEASE", 1)],
    "CCI_stroke": [("CEREBROVASCULARDISEASE", 1)],
    "CCI_dementia": [("DEMENTIA", 1)],
    "CCI_copd": [("CHRONICLUNGDISEASE", 1)],
    "CCI_ctd": [("RHEUMATOLOGICDISEASE", 1)],
    "CCI_pud": [("PEPTICULCER", 1)],
    "CCI_liver": [("MODERATESEVERELIVERDISEASE", 2), ("MILDLIVERDISEASE", 1)],
    "CCI_diabetes": [("DIABETESCOMPLICATED", 2), ("DIABETESUNCOMPLICATED", 1)],
    "CCI_hemiplegia": [("HEMIPLEGIAORPARAPLEGIA", 2)],
    "CCI_ckd": [("KIDNEYDISEASE", 2)],
    "CCI_cancer": [("METASTATICSOLIDTUMORCANCERS", 6), ("MALIGNANTCANCER", 2)],
    "CCI_aids": [("HIVINFECTION", 2)],
}
# Age bands, highest first: (lower bound, points).
SCORE_AGE_BANDS = ((80, 4), (70, 3), (60, 2), (50, 1))
# The value that counts as "present" in the _post_covid_indicator column where
# it is not 1.  Kept because results depend on it; see analysis.weighted_score.
SCORE_POST_VALUES = {"MODERATESEVERELIVERDISEASE": 3}

# Study period, site threshold, trend origin.
STUDY_START, STUDY_END, SENSITIVITY_END = "2020-03-01", "2022-07-01", "2022-01-01"
MIN_SITE_ROWS = 500
ORIGIN_MONTH = (2020, 3)
EARLY_CUT = 5
HORIZON_DAYS = 21
WEIGHT_CAP = 10.0
# ---------------------------------------------------------------------------

def _columns(text: str) -> list[tuple[str, ...]]:
    return list(zip(*(line.split("|") for line in text.strip().splitlines())))


def lookup_table(spark: SparkSession, name: str) -> DataFrame:
    """The literal table ``routes``, ``labs`` or ``states`` (82, 6, 51 rows).

    Route flags are True or NULL, never False: the rules built on them rely on
    three-valued logic.  Built from Arrow so Catalyst sees a local relation of
    known size.
    """
    if name == "routes":
        ids, labels, kinds = _columns(ROUTES)
        flags = {f"is_{kind}": pa.array([True if k == kind else None for k in kinds], pa.bool_())
                 for kind in ("parenteral", "enteral", "missing")}
        table = {"concept_id": pa.array(map(int, ids), pa.int32()),
                 "concept_name": pa.array(labels), **flags}
    elif name == "labs":
        ids, measures = _columns(LABS)
        table = {"concept_id": pa.array(map(int, ids), pa.int32()),
                 "measure_name": pa.array(measures)}
    elif name == "states":
        table = dict(zip(("state_name", "state", "region", "division"),
                         map(pa.array, _columns(STATES))))
    else:
        raise ValueError(f"unknown lookup table {name!r}")
    return spark.createDataFrame(pa.table(table))
