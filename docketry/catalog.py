"""Document templates, rules, thresholds, landmark indices.

Every constant here is a value a result depends on.  Logic lives elsewhere.
"""

from __future__ import annotations

# --- fixed values: document templates, in scan order -------------------------------------------
TEMPLATES = {
    "PAN_CARD": [
        r"Permanent Account Number Card",
        r"Father's Name",
        r"Date of Birth",
        r"\bpan\b",
        r"INCOME TAX DEPARTMENT",
    ],
    "AADHAAR_CARD": [
        r"Unique Identification Authority",
        r"Government of India",
        r"DOB",
        r"Male",
    ],
    "DRIVING_LICENSE": [
        r"DRIVING LICENCE",
        r"THE UNION OF INDIA",
        r"MAHARASHTRA STATE MOTOR DRIVING LICENCE",
        r"driving license",
        r"DL no",
        r"DOI",
        r"COV",
        r"AUTHORISATION TO DRIVE FOLLOWING CLASS",
        r"OF VEHICLES THROUGHOUT INDIA",
    ],
    "VOTER_ID": [
        r"ELECTION COMMISSION OF INDIA",
        r"Elector Photo Identity Card",
        r"IDENTITY CARD",
        r"Elector's Name",
        r"\b[A-Z]{3}\d{7}\b",
    ],
    "BANK_STATEMENT": [
        r"Account Statement",
        r"STATEMENT OF ACCOUNT",
        r"IFSC",
        r"Account Number",
        r"Customer Name",
        r"Branch",
        r"Statement of Transactions",
        r"Account Description",
    ],
}

# --- fixed values: the first, regex-only catalogue ---------------------------------------------
TEMPLATES_V1 = {
    "PAN_CARD": [
        r"Permanent Account Number Card",
        r"Father's Name",
        r"Date of Birth",
        r"\bpan\b",
        r"INCOME TAX DEPARTMENT",
    ],
    "AADHAAR_CARD": [
        r"Unique Identification Authority",
        r"Government of India",
        r"aadhaar",
        r"DOB",
        r"Male",
    ],
    "DRIVING_LICENSE": [
        r"DRIVING LICENCE",
        r"THE UNION OF INDIA",
        r"MAHARASHTRA STATE MOTOR DRIVING LICENCE",
        r"driving license",
        r"DL no",
        r"DOI",
        r"COV",
        r"AUTHORISATION TO DRIVE FOLLOWING CLASS",
        r"OF VEHICLES THROUGHOUT INDIA",
    ],
    "VOTER_ID": [
        r"ELECTION COMMISSION OF INDIA",
        r"Elector Photo Identity Card",
        r"IDENTITY CARD",
        r"Elector's Name",
    ],
    "BANK_STATEMENT": [
        r"Account Statement",
        r"STATEMENT OF ACCOUNT",
        r"IFSC",
        r"Account Number",
        r"Customer  Name",
        r"Branch",
    ],
}

# --- fixed values: detector bonus per type (detector name, label in the match list, points) ------
BONUSES = {
    "PAN_CARD": ("pan", "PAN_NUMBER", 1),
    "AADHAAR_CARD": ("digit12", "AADHAAR_NUMBER", 1),
    "VOTER_ID": ("voter", "VOTERID_NUMBER", 1),
    "BANK_STATEMENT": ("account11", "ACCOUNT11_NUMBER", 1),
}
BONUSES_V1 = {k: BONUSES[k] for k in ("PAN_CARD", "AADHAAR_CARD", "VOTER_ID")}

# --- fixed values: acceptance rules per type (minimum score, detector that must have fired) ------
RULES = {
    "AADHAAR_CARD": (3, "digit12"),
    "PAN_CARD": (3, "pan"),
    "DRIVING_LICENSE": (3, None),
    "VOTER_ID": (3, "voter"),
    "BANK_STATEMENT": (4, "account11"),
}
#: The first rules know no bank statements, so one match is enough there.
RULES_V1 = {
    "AADHAAR_CARD": (3, "digit12"),
    "PAN_CARD": (3, "pan"),
    "DRIVING_LICENSE": (3, None),
    "VOTER_ID": (3, "voter"),
}
UNKNOWN = "UNKNOWN"
# --- fixed values: phrases that stand for a detector's hit among the matched keywords ----------------
DETECTOR_PHRASES = {
    "PAN_NUMBER": "pan number",
    "AADHAAR_NUMBER": "12 digit number",
    "VOTERID_NUMBER": "voterid number",
    "ACCOUNT11_NUMBER": "11 digit account number",
}
FUZZY_THRESHOLD = 75

# --- fixed values: identity-number patterns ------------------------------------------------------
DIGIT12 = (r"\b(\d{12})\b", r"\b(\d{4}[-\s]?\d{4}[-\s]?\d{4})\b", r"(\d{4}\D?\d{4}\D?\d{4})")
PAN = (
    r"\b([A-Z]{5}\d{4}[A-Z])\b",
    r"\b([A-Z]{5}\s?\d{4}\s?[A-Z])\b",
    r"\b([A-Za-z]{5}[-\s]?\d{4}[-\s]?[A-Za-z])\b",
)
PAN_VALID = r"^[A-Z]{5}\d{4}[A-Z]$"
TEN_ALNUM = r"([A-Za-z0-9]{10})"
VOTER = r"\b([A-Z]{3}\d{7})\b"
VOTER_PHRASE = r"(Elector(?:'s)? Name|Elector Photo Identity Card|ELECTION COMMISSION OF INDIA)"
VOTER_NEARBY = r"([A-Z0-9]{8,10})"
VOTER_CONTEXT_CHARS = 120
ACCOUNT11 = (r"\b(\d{11})\b", r"\b(\d{3}[-\s]?\d{4}[-\s]?\d{4})\b", r"((?:\d{2,5}\D?){2,4}\d{2,5})")

# --- fixed values: identity-card component patterns ----------------------------------------------
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE_NUMERIC = r"\b\d{1,2}[\/\-\s]\d{1,2}[\/\-\s]\d{2,4}\b"
DATE_YEAR_FIRST = r"\b\d{4}[\/\-\s]\d{1,2}[\/\-\s]\d{1,2}\b"
DATE_YEAR_FIRST_V11 = r"\b\d{4}[\/\-\s]\d{1,2}[\/\-\s]\d{1,1}\b"
DATE_MONTH_NAME = rf"\b\d{{1,2}}[\/\-\s](?:{MONTHS}|[0-9]{{1,2}})[\/\-\s]\d{{2,4}}\b"
DOB_WORD = r"\bDate of Birth\b|\bDOB\b"
MALE_WORD = r"\bMale\b"
MALE_LETTER = r"\b(?:Gender|Sex)[:\s]*M\b"
ISSUER = r"Government of India"
AUTHORITY = r"Unique Identification Authority|UIDAI"
ADDRESS = r"\bAddress\b"
RELATION = r"\bS\/O\b|\bSO\b|\bD\/O\b|\bDO\b|\bW\/O\b|\bWO\b|\bson of\b|\bwife of\b|\bdaughter of\b"
RELATION_V14 = r"\bS\/O\b|\bSO\b|\bD\/O\b|\bDO\b|\bW\/O\b|\bWO\b|\bon of\b|\bwife of\b|\bdaughter of\b"

# --- fixed values: OCR noise ----------------------------------------------------------------------
BRACKETS = r"[\{\}\[\]\(\)]"
COORDINATES_ONLY = r"^[\[\]\(\)\d\.,\s\-:;]+$"
CONFIDENCE_ONLY = r"^(?:conf(?:idence)?[:\s]*)?\d{1,3}(?:\.\d+)?$"
MIN_ALPHA_RATIO = 0.07
MIN_ENGINE_TEXT = 4

# --- fixed values: files ---------------------------------------------------------------------------
SCAN_EXTENSIONS = ("png", "jpg", "jpeg", "tiff", "bmp", "pdf")

# --- fixed values: layout ---------------------------------------------------------------------------
LINE_TOLERANCE_MULTIPLIER = 0.6
MIN_LINE_TOLERANCE = 10
MERGE_IOU = 0.1
SUPPRESS_IOU = 0.3
NMS_IOU = 0.7
ADJACENT_GAP = 10
MIN_BOX_SIDE = 10
MAX_PAGE_SHARE = 0.98
MIN_AREA_RATIO = 0.02
PAD_SHARE = 0.02
SEGMENT_ORDER = {"table": 0, "text_block": 1, "photo": 2}

# --- fixed values: faces ----------------------------------------------------------------------------
RIGHT_EYE = (33, 160, 158, 133, 153, 144)
LEFT_EYE = (362, 385, 387, 263, 373, 380)
MOUTH_LEFT, MOUTH_RIGHT, MOUTH_TOP, MOUTH_BOTTOM = 61, 291, 13, 14
SCREEN_CLASSES = (62, 63, 67)
PERSON_CLASS = 0
EAR_THRESHOLD = 0.25
EAR_FRAMES = 3
SMILE_WIDTH_RATIO = 0.4
SMILE_OPEN_RATIO = 0.25
SMILE_FRAMES = 3
MOVE_RATIO = 0.05
COOLDOWN_FRAMES = 12
TRACK_TIMEOUT = 12
SMALL_FACE_WIDTH = 140
SMALL_FACE_MOUTH_SHARE = 0.30
SCREEN_EVERY = 6
FACE_SCALE = 0.6
FAKE_WIDTH_SHARE = 0.40
TEETH_SHARE = 0.12
SQUINT_EAR = 0.25


def pattern_rows(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[int, str, int, str]]:
    """(type_ord, doc_type, pattern_ord, pattern), pattern_ord counting over the whole catalogue."""
    rows, n = [], 0
    for type_ord, (doc_type, patterns) in enumerate(templates.items()):
        for pattern in patterns:
            rows.append((type_ord, doc_type, n, pattern))
            n += 1
    return rows
