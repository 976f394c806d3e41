"""Word lists, weights, patterns and limits that results depend on."""

# Document types in declaration order, each with its keywords and their weights.
CLASSIFICATION_KEYWORDS = {
    "PAN Card": [("permanent account number", 20), ("income tax department", 15), ("pan", 8), ("govt. of india", 10), ("date of birth", 6), ("father", 6), ("signature", 4)],
    "Aadhaar Card": [("aadhaar", 25), ("unique identification", 20), ("uidai", 20), ("enrolment no", 12), ("vid:", 10), ("your aadhaar", 10), ("government of india", 5), ("dob:", 4)],
    "ITR Acknowledgement": [("acknowledgement", 20), ("itr", 15), ("income tax return", 20), ("assessment year", 15), ("ay ", 10), ("central processing centre", 12), ("cpc", 8), ("filed", 8), ("refund", 6), ("tax payable", 6), ("total income", 6), ("gross total income", 6), ("return of income", 15), ("e-filing", 10), ("verification", 5), ("bangalore", 5), ("bengaluru", 5)],
    "GST Certificate": [("gstin", 25), ("goods and services tax", 20), ("gst", 10), ("registration certificate", 12), ("place of business", 10), ("taxpayer type", 8), ("constitution of business", 8), ("date of registration", 8), ("gst certificate", 20)],
    "Bank Statement": [("statement of account", 20), ("account statement", 18), ("opening balance", 15), ("closing balance", 15), ("debit", 10), ("credit", 10), ("transaction", 10), ("ifsc", 8), ("branch", 6), ("cheque no", 6), ("utr", 5), ("neft", 5), ("rtgs", 5), ("imps", 5)],
    "Salary Slip": [("salary slip", 25), ("payslip", 20), ("pay slip", 20), ("gross salary", 15), ("net salary", 15), ("basic salary", 12), ("hra", 10), ("provident fund", 10), ("pf", 6), ("tds", 8), ("employee id", 8), ("employee code", 8), ("department", 5), ("designation", 5)],
    "Invoice": [("invoice", 20), ("tax invoice", 22), ("bill to", 12), ("ship to", 8), ("invoice no", 15), ("invoice date", 12), ("amount due", 10), ("total amount", 8), ("hsn", 8), ("sac", 6), ("cgst", 8), ("sgst", 8), ("igst", 8)],
    "Form 16": [("form 16", 25), ("form no. 16", 25), ("certificate under section 203", 20), ("tds certificate", 18), ("tan of deductor", 15), ("pan of employee", 15), ("salaries", 10), ("deductor", 10), ("deductee", 10), ("quarter", 8)],
    "Cheque": [("pay", 8), ("or bearer", 12), ("rupees", 6), ("account payee", 12), ("micr", 10), ("ifsc", 8), ("cheque", 10), ("drawn on", 8)],
    "Passbook": [("passbook", 20), ("savings account", 12), ("current account", 12), ("account holder", 10), ("opening balance", 10), ("interest", 6), ("nominee", 8)],
    "Balance Sheet": [("balance sheet", 30), ("assets", 14), ("liabilities", 14), ("equity and liabilities", 20), ("current assets", 16), ("non-current assets", 16), ("current liabilities", 16), ("non-current liabilities", 16), ("fixed assets", 14), ("share capital", 12), ("reserves and surplus", 12), ("profit and loss", 12), ("as at", 6)],
}

# Points of each type for what its text holds: what, how many at least (of counted things), points.
STRUCTURE_POINTS = {
    "PAN Card": [("pan", 1, 10), ("aadhaar", 1, 5)],
    "Aadhaar Card": [("aadhaar", 1, 20), ("pan and aadhaar", 1, 5)],
    "ITR Acknowledgement": [("pan", 1, 10), ("year", 1, 20), ("itr", 1, 25), ("pairs", 5, 8)],
    "GST Certificate": [("gstin", 1, 30), ("pan", 1, 5)],
    "Bank Statement": [("rows", 5, 15), ("pairs", 3, 5)],
    "Salary Slip": [("pan", 1, 5), ("rows", 3, 8)],
    "Form 16": [("tan", 1, 20), ("pan", 1, 10), ("year", 1, 10)],
    "Invoice": [("gstin", 1, 10)],
    "Balance Sheet": [("rows", 3, 8), ("balance sheet", 1, 20)],
}

# Keywords of the OCR text score.
OCR_SCORE_KEYWORDS = "india government income tax name father birth pan aadhaar gst gstin account number permanent acknowledgement itr assessment year salary invoice certificate return filing refund payable debit credit balance branch ifsc cheque bank department employee form total".split()

# Points of the OCR text score and of the short circuit.
SCORE = {"keyword": 8, "pan": 30, "aadhaar": 25, "gstin": 25, "year": 15, "word": 0.05, "alnum": 0.3, "pair": 2, "garbage": 20, "short": 10}
SHORT_CIRCUIT = 70

# Image pipelines from cheap to dear, and what each mode runs: scales, pipelines, page modes, and the score that ends it.
OCR_PIPELINES = ["fastpath", "light", "standard", "adaptive", "sharpen", "heavy_denoise"]
OCR_MODES = {
    "dev": {"scales": [2.0], "pipelines": ["standard"], "grayscale": True, "psm": [6, 3], "stop": 80.0},
    "balanced": {"scales": [2.0, 1.5], "pipelines": ["standard", "adaptive", "sharpen"], "grayscale": False, "psm": [6, 3, 4], "stop": 90.0},
    "prod": {"scales": [1.5, 2.0, 2.5], "pipelines": ["standard", "adaptive", "sharpen", "light", "heavy_denoise"], "grayscale": True, "psm": [3, 4, 6, 11], "stop": 95.0},
}

# Words that make a line of another pass worth keeping.
INFORMATIVE_WORDS = ["pan", "aadhaar", "gst", "name", "year", "itr", "date", "account", "ifsc", "tan"]

# Folders of document types, the first whose words the type contains.
FOLDER_RULES = [(["itr", "income tax", "return of income"], "ITR"), (["gst"], "GST"), (["aadhaar"], "Aadhaar"), (["bank"], "Bank Statements"), (["balance sheet"], "Balance Sheet"), (["notice"], "Notices"), (["pan"], "PAN")]

# Labels that stand before a name, in order.
NAME_LABELS = ["name", "assessee name", "applicant name", "customer name", "employee name", "account holder", "taxpayer name", "name of taxpayer", "name of assessee", "name of applicant", "proprietor name", "authorized signatory", "full name", "registered name", "partner name", "company name"]

# Words that are no name.
NAME_BLACKLIST = "income tax department government india permanent account number return acknowledgement assessment year receipt date mobile email address state district pin code gender male female other status type category section form itr pan gst gstin tan cin ifsc bank branch debit credit balance salary designation employee employer deductor deductee challan serial amount total gross net basic signature verification certified original copy page of the and for in to from by central processing centre bangalore bengaluru none null na n/a".split()

# Words that make a name candidate invalid, and phrases and first words that do.
NAME_BAD_TOKENS = "signature counter trp premises address rule acknowledgement department verification office processing centre account statement transaction summary".split()
NAME_BLOCKLIST = [
    "of premises", "address of premises", "name and address", "name and address of premises", "place of business", "registered office", "principal place", "principal place of business",
    "of", "premises", "and address", "address", "flat no", "house no", "building", "ward", "pin code", "pincode", "state", "city", "district", "taluka", "tehsil", "village",
    "date", "assessment year", "acknowledgement", "acknowledgement number", "income tax", "income tax department", "government of india", "return of income", "see rule", "see rule 12", "form no", "itr", "rule",
    "the", "and", "for", "in", "to", "from", "by", "with", "on", "at", "as", "an", "a", "le mute", "ptvnee", "ptvnee see rule", "see", "nil", "na", "n/a", "none", "null",
    "verification", "filing date", "e-filing", "efiling", "filed", "tax payable", "total income", "refund", "gross total", "net tax", "bank account", "account number",
    "account summary", "account statement", "statement summary", "transaction summary", "customer id", "account details",
]
NAME_FIRST_STOPWORDS = "of and the in to for from by with on at as an a see per".split()
TOP_LINE_STOPWORDS = "of and the in to for from by with on at as an a see".split()
TOP_LINE_WORDS = [
    "income tax", "government", "india", "department", "permanent account", "central", "processing", "centre", "aadhaar", "uidai", "gst", "invoice", "certificate", "acknowledgement", "return", "salary", "form",
    "premises", "address", "place of", "registered", "principal", "verification", "e-filing", "efiling", "see rule", "rule 12", "assessment year",
    "account summary", "account statement", "statement summary", "transaction summary", "account details", "customer id",
]

# Mojibake and typographic characters and what replaces them, in order.
LIGATURES = [("â\u0080\u0099", "'"), ("â\u0080\u009c", '"'), ("â\u0080\u009d", '"'), ("â\u0080\u0093", "-"), ("â\u0080\u0094", "-"), (" ", " "), ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("ﬁ", "fi"), ("ﬂ", "fl")]

# Look-alike characters, letter to digit and digit to letter.
PAN_DIGITS = ("OILSBGZT", "01158627")
PAN_LETTERS = ("0158627", "OISBGZT")
NUMERIC_DIGITS = ("OILSBGZ", "0115862")

# Patterns of identifiers and dates (Java and Python syntax alike).
PAN = r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"
PAN_LABEL = r"(?i)(?:pan\s*(?:no\.?|number|card)?[\s:—\-]+)([A-Z0-9OoIlBGSZ]{10})"
AADHAAR_FORMATTED = r"\b(\d{4}[\s\-]\d{4}[\s\-]\d{4})\b"
AADHAAR_PLAIN = r"\b(\d{12})\b"
AADHAAR_LABEL = r"(?i)(?:aadhaar|uid|enrolment)[\s\w]*?(?:no\.?|number)?[\s:—\-]+(\d[\d\s\-]{10,14}\d)"
AADHAAR_MASKED = r"\b[Xx*]{4}[\s\-][Xx*]{4}[\s\-](\d{4})\b"
AADHAAR_WORDS = ["aadhaar", "uidai", "enrolment", "your aadhaar"]
NOT_AADHAAR = r"(?i)\b(?:acknowledgement|ack\.?\s*no|ack\s*number|e-?filing|efiling|transaction|txn|invoice\s*(?:no|number|#)|receipt\s*(?:no|number)|account\s*(?:no|number)|reference\s*(?:no|number|id)|challan\s*(?:no|number)|serial\s*(?:no|number)|folio)\b"
GSTIN = r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z])\b"
GSTIN_LABEL = r"(?i)(?:gstin|gst\s*(?:no|number|in))[\s:—\-]+([0-9A-Z\s]{13,15})"
# A PAN or a GSTIN as read, lower-cased: its letters are no words.
ID_TOKEN = r"\b(?:[0-9oilsbgzt]{2})?[a-z]{5}[0-9oilsbgzt]{4}[a-z](?:[0-9a-z]{3})?\b"
TAN = r"\b([A-Z]{4}[0-9]{5}[A-Z])\b"
TAN_LABEL = r"(?i)(?:tan|tax\s*deduction\s*account)[\s:—\-]+([A-Z0-9]{10})"
IFSC = r"\b([A-Z]{4}0[A-Z0-9]{6})\b"
IFSC_LABEL = r"(?i)(?:ifsc|ifsc\s*code)[\s:—\-]+([A-Z0-9]{11})"
CIN = r"\b([LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6})\b"
ACCOUNT_LABEL = r"(?i)(?:account\s*(?:no\.?|number))[\s:—\-]+(\d[\d\s]{8,17}\d)"
DATE_ISO = r"\b(\d{4}[\-\/]\d{2}[\-\/]\d{2})\b"
AY_LABEL = r"(?i)(?:assessment\s*year|ay)[\s:—\-]*(\d{4}[\-\/]\d{2,4})"
AY_ALONE = r"\b(20\d{2}[\-\/](?:20)?\d{2})\b"
FY_LABEL = r"(?i)(?:financial\s*year|fy|f\.y\.)[\s:—\-]*(\d{4}[\-\/]\d{2,4})"
INVOICE_LABEL = r"(?i)(?:invoice\s*(?:no\.?|number|#))[\s:—\-]+([A-Z0-9\-\/]{3,20})"
PHONE = r"(?:(?:\+91|0091|91)?[\s\-]?)?([6-9]\d{9})\b"
PHONE_LABEL = r"(?i)(?:mobile|phone|contact|tel)[\s:—\-]+(\+?[\d\s\-]{10,13})"
EMAIL = r"\b([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})\b"
DATE_NUMERIC = r"\b(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{4})\b"
DATE_MONTH = r"(?i)\b(\d{1,2}[\s\-]+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*[\s\-]+\d{4})\b"
ITR_TYPE = r"(?i)\b(ITR[\s\-]?[0-9A-Z]{1,2})\b"
# An ITR form: a word that merely begins with these letters is none.
ITR_FORM = r"(?i)\b(ITR(?![A-Z]{2}\b)[\s\-]?[0-9A-Z]{1,2})\b"
ACK_LABEL = r"(?i)(?:acknowledgement\s*(?:no\.?|number)?)[\s:—\-]*(\d{12,15})"
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
GST_PERIOD = rf"(?i)(?:tax\s*period|return\s*period|period|month)\s*[:\-]?\s*({MONTH}\s+20\d{{2}}|\d{{1,2}}[\-/]20\d{{2}})"
GST_FILED = rf"(?i)(?:date\s*of\s*filing|filing\s*date|filed\s*on|arn\s*date)\s*[:\-]?\s*(\d{{1,2}}[\-/]\d{{1,2}}[\-/]\d{{2,4}}|\d{{1,2}}[\-/\s]+{MONTH}[\-/\s]+20\d{{2}})"
KEY_VALUE = r"\b\w[\w\s]{2,20}:\s*\S"
TABLE_ROW = r"[\d,.]+\s{2,}[\d,.]+"
YEAR_TOKEN = r"(?i)(?:\bay\b|\bassessment\s+year\b)?\s*\b(?:(20)?(\d{2})\s*[-/]\s*(20)?(\d{2}))\b"

# Message keywords of the retrieval, by document type in order.
MESSAGE_KEYWORDS = {
    "Aadhaar": ["aadhaar", "adhar", "aadhar"],
    "PAN": ["pan"],
    "ITR": ["itr", "income tax return", "income tax", "return of income", "income taxt return", "insome tax return"],
    "GST": ["gst", "gstin"],
    "Bank Statement": ["bank statement", "bank statment", "statement", "statment"],
    "Balance Sheet": ["balance sheet", "balancesheet", "assets liabilities"],
    "Form 16": ["form 16", "form16"],
    "Salary Slip": ["salary slip", "payslip", "pay slip"],
}

# Why a retrieval gives nothing, and what a document's link begins with.
NO_CLIENT = "No access / client not found"
NO_KEYWORDS = "No supported document keywords found"
NO_DOCUMENT = "No document available"
DRIVE_LINK = "https://drive.google.com/uc?export=download&id="

# What a requested type may be called besides its keywords.
MORE_TERMS = {"Aadhaar": ["aadhaar card"], "PAN": ["pan card"]}

# Folder names of document types, and the limits that send a file to review.
DRIVE_FOLDERS = {"PAN Card": "PAN Cards", "Aadhaar Card": "Aadhaar Cards", "ITR Acknowledgement": "ITR Acknowledgements", "GST Certificate": "GST Certificates", "Bank Statement": "Bank Statements", "Salary Slip": "Salary Slips", "Invoice": "Invoices", "Form 16": "Form 16", "Cheque": "Cheques", "Passbook": "Passbooks", "Balance Sheet": "Balance Sheets", "Other": "Uncategorised"}
MIN_ROUTING_CONFIDENCE, MIN_ROUTING_OCR = 60, 20.0

# Ranks of permissions and roles.
PERMISSION_RANK = {"viewer": 1, "contributor": 2, "editor": 3, "owner": 4}
UPLOAD_EXTENSIONS = ["pdf", "jpg", "jpeg", "png"]

# Extensions read as images, what stands between pages, and the words and points of the rotation score.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp"]
PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"
ROTATION_WORDS = ["india", "government", "income", "tax", "name", "father", "birth", "male", "account", "number", "permanent", "card"]
ROTATION_POINTS = {"word": 10, "alnum": 0.01}
