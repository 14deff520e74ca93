"""Entity types, their tables, and the patterns of the recognizers.

The values in this module are fixed by the results to be matched; they are stated as text in their natural order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<entity_type:string,start:int,end:int,score:double,recognizer:string>"
SPANS = f"array<{SPAN}>"

# Label, least score and priority (lower wins) of each entity type.
TYPES = {
    "PERSON": ("[REDACTED: PERSON_NAME]", 0.70, 4),
    "EMAIL_ADDRESS": ("[REDACTED: EMAIL]", 0.50, 3),
    "PHONE_NUMBER": ("[REDACTED: PHONE]", 0.60, 3),
    "ORGANIZATION": ("[REDACTED: COMPANY_NAME]", 0.75, 4),
    "ADDRESS": ("[REDACTED: ADDRESS]", 0.65, 2),
    "US_SSN": ("[REDACTED: SSN]", 0.85, 1),
    "CREDIT_CARD": ("[REDACTED: CREDIT_CARD]", 0.80, 1),
    "DATE_OF_BIRTH": ("[REDACTED: DOB]", 0.90, 1),
    "IP_ADDRESS": ("[REDACTED: IP_ADDRESS]", 0.60, 3),
}
DEFAULT_THRESHOLD, DEFAULT_PRIORITY = 0.70, 99

# Patterns. \b, \d, \w and \s are ASCII.
EMAIL = r"\b[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b"
INDIAN_PHONE = r"(?:\+91[\s\-]?\d{2}[\s\-]?\d{4}[\s\-]?\d{4}|\+91[\s\-]?\d{5}[\s\-]?\d{5}|0\d{2,4}[\s\-]?\d{3,4}[\s\-]?\d{4}|\+91[\s\-]?\d{10})"
INTL_PHONE = r"\+\s?\d{1,3}[\s\-]?\(?\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:[2-6]\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
SUFFIXES = (r"Private\s+Limited|Pvt\.?\s*Ltd\.?|Public\s+Limited|Limited|LLP|Corporation|Corp\.?|Incorporated|Inc\.?|Holdings|Securities|"
            r"Technologies|Solutions|Services|Infrastructure|Industries|Enterprises|Investments|Finance")
COMPANY = (r"(?:[‘’“”\"'(]?\b[A-Z][A-Za-z0-9'-]*(?:\s+(?:&|[A-Z0-9][A-Za-z0-9'-]*)){0,8}"
           rf"\s+(?:{SUFFIXES})\b[‘’“”\"')]?)")
PERSON = (r"(?:(?:Contact\s+Person|Director|Promoter|Secretary|Officer|Auditor|Executive|Manager|Partner|CFO|CEO|MD|CMD|Name)\s*[:\-]\s*"
          r"|(?:Mr\.|Ms\.|Mrs\.|Dr\.|Shri|Smt\.?)\s+)([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4})")
DATES = (r"\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}", r"\d{1,2}\s+\w+\s+\d{4}", r"\w+\s+\d{1,2},?\s+\d{4}")
BIRTH = r"(?i)\b(dob|date\s+of\s+birth|birth\s+date|born\s+on|born|d\.o\.b\.?)\s*[:\-–]?\s*"
PIN = r"\b[1-9][0-9]{5}\b"
ADDRESS_WORD = (r"(?i)\b(floor|building|bldg|plot|road|street|lane|avenue|nagar|colony|sector|apartment|apt|complex|village|taluka|taluqa|district|dist\.?"
                r"|registered\s+office|corporate\s+office|correspondence\s+address|head\s+office|branch\s+office|flat|wing|block|phase|survey\s+no"
                r"|s\.no|plot\s+no|door\s+no|house\s+no|gat\s+no|shop\s+no)\b")
ADDRESS_LABEL = (r"(?i)\b(registered\s+office|corporate\s+office|correspondence\s+address|head\s+office|branch\s+office|mailing\s+address|office\s+address"
                 r"|contact\s+address)\s*(?::\s*|\s+at\s+)")
PLACE = (r"(?i)\b(maharashtra|karnataka|gujarat|delhi|tamil\s*nadu|telangana|rajasthan|uttar\s*pradesh|west\s*bengal|pune|mumbai|bengaluru|bangalore|hyderabad"
         r"|chennai|kolkata|ahmedabad|surat|jaipur|lucknow|nagpur|thane|nashik|aurangabad|solapur|amravati|navi\s*mumbai)\b")
# What a match of these patterns cannot do without: ends of labels and honorifics as written; the others lower-cased.
HONORIFICS = ("Mr.", "Ms.", "Mrs.", "Dr.", "Shri", "Smt")
PERSON_LABELS = ("Person", "Director", "Promoter", "Secretary", "Officer", "Auditor", "Executive", "Manager", "Partner", "CFO", "CEO", "MD", "Name")
SUFFIX_PARTS = ("limited", "ltd", "llp", "corp", "inc", "holdings", "securities", "technologies", "solutions", "services", "infrastructure", "industries", "enterprises", "investments", "finance")
BIRTH_PARTS = ("dob", "birth", "born", "d.o.b")
LABEL_PARTS = ("office", "address")

# Words that raise a score, and cues without which a unit is skipped.
CONTEXT = {
    "EMAIL_ADDRESS": ("email", "e-mail", "mail", "contact"),
    "PHONE_NUMBER": ("phone", "tel", "telephone", "mobile", "fax", "contact", "call", "helpline", "number", "no.", "nos."),
    "US_SSN": ("ssn", "social security", "social security number", "ss#", "ss #", "tax id", "taxpayer id"),
}
CUES = (
    "ltd", "limited", "llp", "pvt", "corp", "inc", "road", "nagar", "street", "floor", "office", "bank", "mumbai", "pune", "delhi", "director",
    "officer", "person", "contact",
)

# What is not an organisation.
GENERIC_COMPANY = r"(?i)^(the|our|this|such|any|said|a|an)\s+(company|bank|corporation|trust|fund|enterprise|organisation|organization|institution)\s*$"
BARE_SUFFIX = r"(?i)^(private\s+limited|pvt\.?\s*ltd\.?|llp|limited|corporation|inc\.?|trust|fund|bank|securities)\s*$"
ORG_GENERIC_START = r"(?i)^(our|the|this|such|any|said)\s+(company|bank|board|committee|issuer|promoter|trust)"
ORG_GENUINE = r"(?i)\b(Private\s+Limited|Pvt\.?\s*Ltd\.?|Limited|LLP|Inc\.?|Corp\.?)\b"
ORG_ACRONYM = r"^[A-Z]{1,5}\.?$"
ORG_ACRONYMS = (
    "SSN", "CEO", "CFO", "COO", "MD", "CMD", "MCA", "RBI", "ROC", "CIN", "DIN", "PAN", "TAN", "GST", "IPO", "NSE", "BSE", "SEBI", "SCRR", "ICDR",
    "SCRA", "FEMA", "IFRS", "KMP", "KMPS", "WTD",
)
ORG_EXACT = (r"(?i)^(the\s+)?(company|bank|corporation|trust|fund|enterprise|organisation|organization|institution|group|committee|authority|board|sebi|nse|bse"
             r"|ipo|rbi|roc|mca|cin|din|pan|tan|gst|ssn|ceo|cfo|coo|md|cmd|llp|ltd|pvt|inc|corp|co\.|co|goods\s+and\s+services|goods\s+&\s+services"
             r"|securities|securities\s+law|capital\s+market|reserve\s+bank|stock\s+exchange)\s*\.?$")
ORG_PHRASE = (r"(?i)^(weighted\s+average\s+price|details\s+of\s+price|exemption\s+from|on\s+the\s+conversion|as\s+certified\s+by\b|while\s+we\s+|though\s+we\s+"
              r"|we\s+(require|will|meet|perform|maintain|strive|intend|propose|expect)|company\s+and\s+all)")
ORG_SUFFIX_END = (r"(?i)\b(Private\s+Limited|Pvt\.?\s*Ltd\.?|Public\s+Limited|Limited|LLP|Corporation|Corp\.?|Incorporated|Inc\.?|Holdings|Technologies|Solutions|"
                  r"Services|Industries|Enterprises|Investments|Finance|Securities)\s*\.?$")
ORG_VERBS = (
    "was", "were", "is", "are", "been", "being", "have", "has", "had", "originally", "incorporated", "registered", "pursuant", "provisions",
    "section", "clause", "regulation", "regulations", "under", "against", "repetition", "holding", "allotted", "transferred", "shifted", "situated",
    "require", "requires", "required", "perform", "performs", "performed", "strive", "strives", "meet", "meets", "maintain", "maintains", "finance",
    "weighted", "complying", "certified", "conversion", "constitute", "include", "includes", "including", "affect", "affects", "protect", "invest",
    "propose", "intend", "intends", "expect", "expects",
)

# What is not a person.
PERSON_ACRONYMS = (
    "SCRR", "SEBI", "ICDR", "SCRA", "FEMA", "IFRS", "RBI", "NSE", "BSE", "MCA", "ROC", "CIN", "DIN", "PAN", "TAN", "GST", "IPO", "KMP", "WTD", "CMD",
    "CFO", "COO", "CSR", "AGM", "EGM", "MOA", "AOA", "NRI", "FPI", "QIB", "HNI", "SME", "MSME", "NBFC", "RERA", "PMLA", "IRDA", "PFRDA",
)
PERSON_WORDS = (
    "email", "telephone", "website", "contact", "phone", "fax", "mobile", "fiscals", "fiscal", "annexure", "schedule", "appendix", "enclosure",
    "prospectus", "memorandum", "compliance", "indebtedness", "taluka", "taluk", "tehsil", "district", "village", "gram", "nagar", "mauje", "ward",
    "sector", "block", "plot", "survey",
)
PERSON_PLACES = (
    "mumbai", "pune", "delhi", "bangalore", "bengaluru", "chennai", "hyderabad", "kolkata", "ahmedabad", "surat", "jaipur", "lucknow", "kanpur",
    "nagpur", "baner", "khed", "chakan", "vikhroli", "bandra", "andheri", "kurla", "thane", "navi", "vasai", "nashik", "aurangabad", "solapur",
    "kolhapur", "ahmednagar", "ahilyanagar", "parner", "shirur", "birdewadi", "churchgate", "nariman", "worli", "dadar", "powai", "goregaon", "marol",
    "sakinaka", "jogeshwari", "malad", "kandivali", "borivali", "supa", "palve", "khurd",
)

# Pools of fake values.
FAKE_PERSONS = (
    "Ananya Sharma", "Vikram Mehta", "Priya Nair", "Rohan Verma", "Deepa Iyer", "Arjun Patel", "Sneha Joshi", "Rahul Gupta", "Kavita Singh",
    "Amit Kumar", "Pooja Rao", "Suresh Reddy", "Meera Pillai", "Kiran Bhat", "Neha Desai", "Ajay Mishra", "Sunita Tiwari", "Rajiv Saxena",
    "Divya Pandey", "Manoj Chauhan", "Ravi Krishnan", "Lata Bhatt", "Sanjay Malhotra", "Geeta Agarwal", "Nikhil Bansal", "Rekha Srivastava",
    "Vivek Chaudhary", "Asha Ghosh", "Pramod Tripathi", "Swati Das",
)
FAKE_DOMAINS = (
    "example.com", "sample.org", "testmail.in", "fakeemail.co.in", "demomail.com", "placeholder.in",
)
FAKE_WORDS = (
    "Alpha", "Beta", "Delta", "Omega", "Apex", "Prime", "Unity", "Nova", "Zenith", "Sigma", "Crest", "Vega", "Orion", "Atlas", "Titan", "Nexus",
    "Vertex", "Horizon",
)
FAKE_CATEGORIES = (
    "Technologies", "Solutions", "Industries", "Services", "Analytics", "Enterprises", "Holdings", "Ventures", "Consulting", "Systems",
)
FAKE_STREETS = ("123, Sample Nagar", "456, Demo Colony", "789, Placeholder Road", "101, Example Lane", "202, Test Building, MG Road", "303, Model Society, FC Road")
FAKE_CITIES = ("Pune", "Mumbai", "Bangalore", "Delhi", "Chennai")
FAKE_PINS = (411001, 411045, 400001, 400051, 560001, 110001)


def of_type(kind: Column, which: int, default, types: dict | None = None) -> Column:
    """Label (0), threshold (1) or priority (2) of an entity type, the caller's own types included; default for others."""
    out = F
    for name, row in (TYPES | (types or {})).items():
        out = out.when(kind == name, F.lit(row[which]))
    return out.otherwise(default)
