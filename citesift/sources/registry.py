"""Constant relations: acts, their sections, aliases, helplines, scenarios and languages.

Names, numbers and years are facts of public law and keep their values; descriptions are our own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .descriptions import ANSWERS, SUMMARIES
from .descriptions import SECTIONS as SECTION_TEXTS

# Acts (id, short name, title, year, what it replaces, domain).
ACTS = [
    ("BNS", "BNS", "Bharatiya Nyaya Sanhita", 2023, "Indian Penal Code, 1860", "criminal"),
    ("BNSS", "BNSS", "Bharatiya Nagarik Suraksha Sanhita", 2023, "Code of Criminal Procedure, 1973", "procedure"),
    ("PWDVA", "PWDVA", "Protection of Women from Domestic Violence Act", 2005, None, "family"),
    ("CPA", "Consumer Protection Act", "Consumer Protection Act", 2019, "Consumer Protection Act, 1986", "consumer"),
    ("IT", "IT Act", "Information Technology Act", 2000, None, "cyber"),
    ("RERA", "RERA", "Real Estate (Regulation and Development) Act", 2016, None, "property"),
    ("RAILWAYS", "Railways Act", "Railways Act", 1989, None, "consumer"),
    ("WAGES", "Code on Wages", "Code on Wages", 2019, "Payment of Wages Act 1936, Minimum Wages Act 1948 and others", "labour"),
    ("MTA", "Model Tenancy Act", "Model Tenancy Act", 2021, None, "property"),
    ("LSAA", "Legal Services Authorities Act", "Legal Services Authorities Act", 1987, None, "access"),
]

# Sections (act, number, heading, what came before).
SECTIONS = [
    ("BNS", "85", "Cruelty by husband or his relatives", "IPC 498A"),
    ("BNS", "86", "Meaning of cruelty", "IPC 498A explanation"),
    ("BNS", "115", "Voluntarily causing hurt", "IPC 323"),
    ("BNS", "117", "Voluntarily causing grievous hurt", "IPC 325"),
    ("BNS", "74", "Assault or criminal force on a woman with intent to outrage her modesty", "IPC 354"),
    ("BNS", "351", "Criminal intimidation", "IPC 503 and 506"),
    ("BNS", "303", "Theft", "IPC 378 and 379"),
    ("BNS", "316", "Criminal breach of trust", "IPC 405 and 406"),
    ("BNS", "318", "Cheating", "IPC 415 and 420"),
    ("BNS", "319", "Cheating by personation", "IPC 416 and 419"),
    ("BNSS", "173", "Information in cognizable cases", "CrPC 154"),
    ("BNSS", "175", "Power of police to investigate a cognizable case", "CrPC 156"),
    ("BNSS", "193", "Report of police officer on completion of investigation", "CrPC 173"),
    ("BNSS", "35", "When police may arrest without warrant", "CrPC 41"),
    ("BNSS", "47", "Person arrested to be informed of grounds of arrest", "CrPC 50"),
    ("BNSS", "58", "Person arrested not to be detained more than twenty-four hours", "CrPC 57"),
    ("BNSS", "144", "Order for maintenance of wives, children and parents", "CrPC 125"),
    ("BNSS", "183", "Recording of confessions and statements", "CrPC 164"),
    ("PWDVA", "3", "Definition of domestic violence", None),
    ("PWDVA", "12", "Application to Magistrate", None),
    ("PWDVA", "18", "Protection orders", None),
    ("PWDVA", "19", "Residence orders", None),
    ("PWDVA", "20", "Monetary relief", None),
    ("PWDVA", "21", "Custody orders", None),
    ("PWDVA", "22", "Compensation orders", None),
    ("PWDVA", "23", "Power to grant interim and ex-parte orders", None),
    ("PWDVA", "31", "Penalty for breach of protection order", None),
    ("CPA", "2(11)", "Deficiency in service", None),
    ("CPA", "2(47)", "Unfair trade practice", None),
    ("CPA", "34", "Jurisdiction of the District Commission", None),
    ("CPA", "35", "Manner of making a complaint", None),
    ("CPA", "38", "Procedure on admission of complaint", None),
    ("CPA", "39", "Findings of the District Commission", None),
    ("CPA", "47", "Jurisdiction of the State Commission", None),
    ("IT", "43", "Penalty for damage to a computer or computer system", None),
    ("IT", "66", "Computer-related offences", None),
    ("IT", "66C", "Identity theft", None),
    ("IT", "66D", "Cheating by personation using a computer resource", None),
    ("IT", "43A", "Compensation for failure to protect data", None),
    ("IT", "72", "Breach of confidentiality and privacy", None),
    ("RERA", "13", "No deposit or advance without an agreement for sale", None),
    ("RERA", "18", "Return of amount and compensation", None),
    ("RERA", "12", "Obligations of the promoter regarding advertisement or prospectus", None),
    ("RERA", "31", "Filing of complaints with the Authority", None),
    ("RAILWAYS", "155", "Entering a compartment reserved, or resisting lawful entry", None),
    ("RAILWAYS", "162", "Entering a compartment reserved for women", None),
    ("WAGES", "17", "Time limit for payment of wages", None),
    ("WAGES", "45", "Claims arising under this Code", None),
    ("MTA", "11", "Security deposit", None),
    ("MTA", "32", "Rent Authority and Rent Court", None),
    ("LSAA", "12", "Criteria for giving legal services", None),
    ("LSAA", "22B", "Lok Adalats and permanent Lok Adalats", None),
]

# Names by which texts call an act.
ALIASES = {
    "BNSS": ["bharatiya nagarik suraksha sanhita", "bnss", "crpc", "code of criminal procedure"],
    "BNS": ["bharatiya nyaya sanhita", "bns", "ipc", "indian penal code"],
    "PWDVA": ["protection of women from domestic violence act", "pwdva", "dv act", "domestic violence act"],
    "CPA": ["consumer protection act", "cpa", "consumer act"],
    "IT": ["information technology act", "it act"],
    "RERA": ["real estate (regulation and development) act", "real estate regulation and development act", "rera"],
    "RAILWAYS": ["indian railways act", "railways act", "railway act"],
    "WAGES": ["code on wages", "payment of wages act", "minimum wages act", "wages code"],
    "MTA": ["model tenancy act", "tenancy act", "mta"],
    "LSAA": ["legal services authorities act", "legal services act", "lsaa"],
}

# Helplines (number, name, primary); what each is for is in our words.
HELPLINES = [
    ("112", "National Emergency", True, "Police, fire and ambulance, for danger that is there now."),
    ("1091", "Women Helpline", True, "Police help for women in danger or under threat."),
    ("1930", "Cyber Financial Fraud", True, "Report money lost to online fraud at once, so that banks can stop it."),
    ("15100", "NALSA Free Legal Aid", True, "Free advice and lawyers for those who are entitled to legal services."),
    ("1098", "Childline", False, "Help for children who are lost, hurt or made to work."),
    ("181", "Women Helpline (alternate)", False, "Advice and shelter for women who face violence."),
    ("139", "Rail Madad", False, "Complaints and security on trains, during the journey too."),
    ("14567", "Elderline", False, "Advice and help for older people."),
]

# Scenarios (id, label, helplines, key words in order).
SCENARIOS = [
    ("domestic-violence", "Domestic Safety", ["112", "1091", "15100"], ["abus", "husband", "in-law", "beat", "hit", "slap", "hurt", "threaten", "domestic", "violence", "dowry", "cruel"]),
    ("train-seat", "Occupied Train Seat", ["139"], ["train", "railway", "berth", "seat", "coach", "irctc", "pnr", "reserved"]),
    ("tenant-deposit", "Tenant Deposit", ["15100"], ["landlord", "deposit", "rent", "tenant", "vacat", "flat", "lease"]),
    ("upi-fraud", "UPI Fraud", ["1930"], ["upi", "scam", "fraud", "cyber", "phish", "otp", "transaction", "bank", "money lost", "paytm", "gpay"]),
    ("unpaid-salary", "Unpaid Salary", ["15100"], ["salary", "wage", "unpaid", "employer", "boss", "epf", "provident fund"]),
]

# Answer languages (code, name, native name, tag).
LANGUAGES = [
    ("en", "English", "English", "en-IN"),
    ("hi", "Hindi", "हिंदी", "hi-IN"),
    ("hinglish", "Hinglish", "Hinglish", "en-IN"),
    ("ta", "Tamil", "தமிழ்", "ta-IN"),
    ("te", "Telugu", "తెలుగు", "te-IN"),
    ("mr", "Marathi", "मराठी", "mr-IN"),
    ("bn", "Bengali", "বাংলা", "bn-IN"),
    ("kn", "Kannada", "ಕನ್ನಡ", "kn-IN"),
]

SOURCE_BASE = "https://www.indiacode.nic.in/simple-search?query="


def sorted_aliases() -> list[tuple[str, str]]:
    """(act, alias), longest alias first, those of one length in the order given."""
    return sorted(((act, a) for act, names in ALIASES.items() for a in names), key=lambda x: -len(x[1]))


def act_rows() -> list[tuple]:
    return [(i, *a[:5], SUMMARIES[a[0]], a[5]) for i, a in enumerate(ACTS)]


def section_rows() -> list[tuple]:
    return [(i, act, n, heading, SECTION_TEXTS[act, n][0], before, SECTION_TEXTS[act, n][1]) for i, (act, n, heading, before) in enumerate(SECTIONS)]


def acts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(act_rows(), "ordinal int, act_id string, short_name string, title string, year int, replaces string, summary string, domain string")


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(section_rows(), "ordinal int, act_id string, number string, heading string, plain string, previously string, consequence string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, act, a) for i, (act, a) in enumerate(sorted_aliases())], "ordinal int, act_id string, alias string")


def helplines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HELPLINES, "number string, name string, is_primary boolean, detail string")


def scenarios(spark: SparkSession) -> DataFrame:
    rows = [(i, s, label, lines, words, *ANSWERS[s]) for i, (s, label, lines, words) in enumerate(SCENARIOS)]
    return spark.createDataFrame(rows, "priority int, scenario_id string, label string, helplines array<string>, signals array<string>, question string, answer string")


def languages(spark: SparkSession) -> DataFrame:
    script = {"hinglish": " Use Latin script."}
    rows = [(*x, f"Write the whole answer in {x[1]}.{script.get(x[0], '')}" + ("" if x[0] == "en" else " Names of acts and numbers of sections stay in English.")) for x in LANGUAGES]
    return spark.createDataFrame(rows, "code string, name string, native_name string, tag string, directive string")
