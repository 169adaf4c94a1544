"""Vocabulary, units, cues and formats of clinical text. They are given and not derived from anything here."""

# Vocabulary of mentions: kind, canonical name, spelling.
LEXICON = {
    "condition": {
        "type_2_diabetes": r"type\s*(?:2|II)\s+diabetes(?:\s+mellitus)?",
        "diabetes": r"diabetes(?:\s+mellitus)?",
        "hypertension": r"hypertension|high blood pressure",
        "asthma": r"asthma",
        "copd": r"COPD|chronic obstructive pulmonary disease",
        "heart_failure": r"(?:congestive\s+)?heart failure",
        "atrial_fibrillation": r"atrial fibrillation",
        "chronic_kidney_disease": r"chronic kidney disease|CKD",
        "breast_cancer": r"breast cancer",
        "lung_cancer": r"(?:non[- ]small cell\s+)?lung cancer",
        "gastric_adenocarcinoma": r"gastric adenocarcinoma",
        "adenocarcinoma": r"adenocarcinoma",
        "lymphoma": r"lymphoma",
        "leukemia": r"leukemia|leukaemia",
        "melanoma": r"melanoma",
        "pneumonia": r"pneumonia",
        "tuberculosis": r"tuberculosis",
        "hiv": r"HIV",
        "hepatitis_c": r"hepatitis C",
        "stroke": r"stroke",
        "myocardial_infarction": r"myocardial infarction|heart attack",
        "depression": r"depression",
        "rheumatoid_arthritis": r"rheumatoid arthritis",
        "crohn_disease": r"Crohn(?:'s)? disease",
        "constipation": r"constipation",
        "cauda_equina_syndrome": r"cauda equina syndrome",
    },
    "medication": {
        name: name
        for name in (
            "metformin", "insulin", "aspirin", "warfarin", "apixaban", "lisinopril", "atorvastatin", "prednisone", "prednisolone",
            "methotrexate", "albuterol", "salbutamol", "ibuprofen", "amoxicillin", "cisplatin", "pembrolizumab",
        )
    },
    "treatment": {
        "chemotherapy": r"chemotherapy",
        "radiotherapy": r"radiotherapy|radiation therapy",
        "immunotherapy": r"immunotherapy",
        "dialysis": r"(?:hemo|haemo)?dialysis",
        "surgery": r"surgery|surgical resection",
        "transplant": r"(?:kidney|renal|liver|heart|bone marrow) transplant(?:ation)?",
    },
}
#: All kinds of facts.
KINDS = ("age", "sex", "condition", "medication", "treatment", "measurement")

# Measured quantities: spelling, and each unit with its canonical form.
MEASUREMENTS = {
    "platelets": (r"platelets?|platelet count", {"/mm3": "/mm3", "/mm³": "/mm3", "x10^9/L": "x10^9/L"}),
    "hemoglobin": (r"ha?emoglobin|Hb", {"g/dL": "g/dL", "g/L": "g/L"}),
    "hba1c": (r"HbA1c", {"%": "%", "mmol/mol": "mmol/mol"}),
    "creatinine": (r"(?:serum\s+)?creatinine", {"mg/dL": "mg/dL", "umol/L": "umol/L", "µmol/L": "umol/L", "μmol/L": "umol/L"}),
    "glucose": (r"(?:blood\s+)?glucose", {"mg/dL": "mg/dL", "mmol/L": "mmol/L"}),
    "weight": (r"weight", {"kg": "kg", "lb": "lb", "lbs": "lb"}),
    "height": (r"height", {"cm": "cm", "m": "m"}),
    "temperature": (r"temperature", {"°C": "C", "C": "C", "°F": "F", "F": "F"}),
    "heart_rate": (r"heart rate|pulse(?: rate)?", {"bpm": "bpm", "/min": "bpm"}),
    "oxygen_saturation": (r"oxygen saturation|SpO2", {"%": "%"}),
    "bmi": (r"BMI", {"kg/m2": "kg/m2", "kg/m²": "kg/m2"}),
}
BLOOD_PRESSURE = r"\b(?:blood pressure|BP)\s*(?:is|of|=|:)?\s*(\d{2,3})/(\d{2,3})\s*(mmHg)?\b"
#: Signs and words before a measured value.
MEASURED = {
    ">=": "ge", "<=": "le", "≥": "ge", "≤": "le", ">": "gt", "<": "lt", "~": "approx", "about": "approx", "approximately": "approx", "": "eq",
}
#: Signs and words of a limit.
LIMITING = {
    ">=": "ge", "≥": "ge", "at least": "ge", "no less than": "ge", ">": "gt", "more than": "gt", "<=": "le", "≤": "le", "at most": "le",
    "no more than": "le", "<": "lt", "less than": "lt", "=": "eq",
}
#: Quantities that limits are read of: spelling, and each unit with its canonical form.
LIMITED = {
    "age": (r"age(?:d)?", {"years": "year", "year": "year", "months": "month", "month": "month", "weeks": "week", "week": "week", "days": "day", "day": "day"}),
    "hemoglobin": (r"ha?emoglobin|Hb", {"g/dL": "g/dL", "g/L": "g/L"}),
    "hba1c": (r"HbA1c", {"%": "%", "mmol/mol": "mmol/mol"}),
    "creatinine": (r"(?:serum\s+)?creatinine", {"mg/dL": "mg/dL", "umol/L": "umol/L", "µmol/L": "umol/L", "μmol/L": "umol/L"}),
    "bmi": (r"BMI|body mass index", {"kg/m2": "kg/m2", "kg/m²": "kg/m2"}),
    "platelets": (r"platelets?|platelet count", {"/mm3": "/mm3", "/mm³": "/mm3", "x10^9/L": "x10^9/L"}),
}

AGE = r"\b(?P<value>\d{1,3}(?:\.\d+)?)\s*[- ]?(?P<unit>year|month|week|day)s?\s*[- ]?old\b"
AGE_AND_SEX = r"\b(?P<value>\d{1,3})(?P<sex>[MF])\b"
SEX = r"\b(?:female|male|woman|man|girl|boy|lady|gentleman)\b"
FEMALE = ("female", "woman", "girl", "lady")
SEX_UNCLEAR = r"\b(?:transgender|nonbinary|non-binary|intersex|sex unknown|sex unspecified)\b"
OLDEST_YEARS = 130

# Ends of clauses, and cues of what is said of a mention in its clause.
CLAUSE_END = r"(?<!\d)\.|\.(?!\d)|[!?;\n]|\b(?:but|however|whereas)\b|,?\s+and\s+(?=(?:the patient|he|she)\b)"
FAMILY = (
    r"\b(?:mother|father|sisters?|brothers?|daughters?|sons?|parents?|children|child|"
    r"aunt|uncle|grandmother|grandfather|family history)\b"
)
OTHERS = r"\b(?:friends?|neighbors?|neighbours?|spouse|husband|wife|partners?)\b"
PATIENT = r"\b(?:the patient|patient|he|she)\s+(?:has|had|is|was|denies|takes|reports|underwent)\b"
PREDICATE = r"(?:,\s*|\band\s+)(?=(?:has|takes|receives|denies|reports|underwent|currently)\b)"
NEGATION = (
    r"\b(?:no(?: evidence of)?|denies|denied|without|not taking|not receiving|"
    r"negative for|free of|never had)\b"
)
UNCERTAIN = (
    r"\b(?:possible|possibly|suspected|suspect|may have|might have|rule out|cannot exclude|"
    r"cannot rule out|unlikely|uncertain|question of|concern for|if|risk of|evaluate for)\b"
)
HISTORICAL = (
    r"\b(?:history of|previously|prior|past|formerly|had|was|stopped|discontinued|resolved|"
    r"underwent)\b|\b\d+\s+(?:years?|months?|weeks?|days?) ago\b"
)
PLANNED = r"\b(?:planned|scheduled|will receive|will undergo|considering|consider|recommended|plan for)\b"
# The same cues where they follow the mention.
FAMILY_AFTER = r"\s+(?:mother|father|sister|brother|daughter|son)\b"
OTHERS_AFTER = r"\s+(?:friend|partners?)\b"
UNCERTAIN_AFTER = r"\s+(?:is\s+)?(?:possible|suspected|uncertain)\b"
NEGATION_AFTER = r"\s+(?:is\s+|was\s+)?(?:absent|ruled out|negative)\b"
HISTORICAL_AFTER = r"\s+(?:\d+\s+\w+\s+ago|in\s+\d{4}|resolved|was stopped|was discontinued)\b"
PLANNED_AFTER = r"\s+(?:is\s+)?(?:planned|scheduled|considered|recommended)\b"

# Age and sex are the patient's own only in the opening or after a label.
PRESENTED = r"\s*(?:the\s+)?patient is\s+(?:a\s+|an\s+)?\d"
OPENING = r"\s*(?:(?:the\s+)?patient is\s+)?(?:(?:a|an)\s+)?(?:\d|male\b|female\b|woman\b|man\b|girl\b|boy\b)"
LABEL_BEFORE = r"\b(?:patient(?:\s+is)?|age(?:\s+is)?|aged|sex(?:\s+is)?)\s*[:,]?\s*$"
HEDGE_BEFORE = r"\b(?:about|approximately|around|between|over|under|at least|at most)\b|[<>~]|\d\s*[-–]\s*$"

# Sections, lists and sentences of eligibility text.
SECTION_HEADER = (
    r"(?im)(?:(?<!\w)(inclusion|exclusion)\s+criteria\s*:"
    r"|^[ \t]*(inclusion|exclusion)(?:\s+criteria)?[ \t]*:?[ \t\r]*$)"
)
BULLET = r"(?m)^(?P<indent>[ \t]*)(?:[-*•]|\d+[.)]|\([a-z0-9]+\)|[a-z][.)])\s+"
BLANK_LINE = r"\r?\n[ \t]*\r?\n"
CONTINUATION = r"\s*(?:or|and|unless|except|however)\b"
SHARED_CONDITION = r"\b(?:or|unless|except|if|provided that|however)\b"
NEW_SUBJECT = r"\s*(?:age|sex|hemoglobin|haemoglobin|HbA1c|creatinine|BMI|platelets|written consent)\b"
CRITERION_NEGATION = r"\b(?:no|not|without|absence of|negative for|must not|never)\b"
CONDITION_OR_EXCEPTION = r"\b(?:unless|except|if|provided that|however)\b"
PLACEHOLDERS = ("none", "n/a", "not applicable", "not specified")
CRITERION_TYPES = {
    "age": r"\bage(?:d)?\b|\byears? old\b",
    "sex": r"\b(?:male|female|men|women|pregnan\w*|breast[- ]?feeding)\b",
    "condition": r"\b(?:diagnos\w*|disease|cancer|diabetes|asthma|infection|malignancy|"
    r"HIV|hepatitis|tuberculosis)\b",
    "medication": r"\b(?:medication|drug|prednisone|corticosteroids?|methotrexate|insulin|"
    r"warfarin|metformin)\b",
    "treatment": r"\b(?:chemotherapy|radiotherapy|surgery|surgical|dialysis|transplant\w*)\b",
    "measurement": r"\b(?:hemoglobin|haemoglobin|HbA1c|Hb|creatinine|BMI|platelets?|"
    r"laboratory|blood pressure)\b",
    "consent": r"\b(?:consent|assent)\b",
}
