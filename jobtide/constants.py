"""Closed vocabularies and thresholds.

Fixed values: every list, order, rate and bound in this module has to hold
exactly these values for results to be right; none of them is tunable.
"""

ATS_KEYS = [
    "ashby", "greenhouse", "lever", "workday", "smartrecruiters", "workable", "recruitee",
    "breezy", "pinpoint", "jobvite", "teamtailor", "personio", "rippling", "bamboohr",
    "icims", "paylocity", "jazzhr", "polymer", "dover", "gem",
]
EMPLOYMENT_TYPES = ["FullTime", "PartTime", "Contract", "Temporary", "Intern", "Volunteer", "Unknown"]
WORKPLACE_TYPES = ["onsite", "hybrid", "remote", "unknown"]
SENIORITY_LEVELS = [
    "intern", "entry", "junior", "mid", "senior", "staff", "principal", "manager",
    "director", "executive", "unknown",
]
JOB_FUNCTIONS = [
    "engineering", "data", "design", "product", "sales", "marketing", "customer-success",
    "operations", "finance", "legal", "people", "research", "security", "it", "healthcare",
    "education", "science", "manufacturing", "construction", "logistics", "hospitality",
    "retail", "nonprofit", "government", "media", "other",
]
PAY_PERIODS = ["YEAR", "HALF_YEAR", "MONTH", "SEMI_MONTH", "BIWEEK", "WEEK", "DAY", "HOUR", "NONE"]
REMOTE_SCOPES = ["worldwide", "country", "region", "timezone"]
DEGREES = ["none", "bachelors", "masters", "phd"]

# (value, label, lowest count, highest count)
COMPANY_SIZE_BANDS = [
    ("1", "1 open role", 1, 1),
    ("2-5", "2–5 open roles", 2, 5),
    ("6-20", "6–20 open roles", 6, 20),
    ("21-100", "21–100 open roles", 21, 100),
    ("101-500", "101–500 open roles", 101, 500),
    ("500+", "over 500 open roles", 501, None),
]

SECTORS = {
    "ai": "AI & machine learning",
    "developer-tools": "developer tools & infrastructure",
    "data-analytics": "data & analytics",
    "cybersecurity": "cybersecurity",
    "enterprise-software": "business software",
    "fintech": "fintech & payments",
    "crypto": "crypto & web3",
    "financial-services": "banking, investing & insurance",
    "health-tech": "health technology",
    "healthcare": "healthcare providers & services",
    "biotech-pharma": "biotech & pharma",
    "education": "education & edtech",
    "consumer": "consumer apps & products",
    "ecommerce-retail": "e-commerce & retail",
    "media-entertainment": "media & entertainment",
    "gaming": "gaming",
    "marketing-adtech": "marketing & advertising",
    "hr-tech": "HR, recruiting & staffing",
    "real-estate": "real estate & proptech",
    "transportation-logistics": "transportation & logistics",
    "energy-climate": "energy & climate",
    "manufacturing-industrial": "manufacturing & industrial",
    "hardware-robotics": "hardware, robotics & semiconductors",
    "aerospace-defense": "aerospace & defense",
    "government": "government & public sector",
    "nonprofit": "nonprofit",
    "professional-services": "consulting & professional services",
    "telecom": "telecom & networking",
    "hospitality-travel": "hospitality, travel & food",
    "construction": "construction & engineering services",
    "other": "something else",
}

# Which seniority bands a years filter admits: lowest and highest years per band.
BAND_FLOOR = {
    "intern": 0, "entry": 0, "junior": 2, "mid": 3, "senior": 6, "staff": 9,
    "principal": 10, "manager": 5, "director": 8, "executive": 10,
}
BAND_CEILING = {"intern": 1, "entry": 1, "junior": 2, "mid": 5, "senior": 8}

UNKNOWN_POLICIES = ["include", "exclude", "separate"]
UNKNOWABLE_CRITERIA = [
    "metro", "description", "workplace", "experience", "salary", "employment_type", "posted",
    "job_function", "skills", "degree", "visa", "pay_period", "currency", "equity",
    "remote_scope", "salary_source", "sector",
]
DEFAULT_WEIGHTS = {
    "text_match": 30.0, "title_keyword": 10.0, "description_keyword": 1.5,
    "description_keyword_cap": 6, "recency": 8.0, "salary": 4.0, "years_fit": 5.0, "quality": 3.0,
}
SORTS = ["relevance", "newest", "oldest", "salary-high", "salary-low", "quality", "company"]
GUESSED_ONSITE = "default-has-metro"

EVENTS = ["appeared", "changed", "disappeared", "reappeared"]
APPLICATION_STATUSES = ["saved", "applied", "interviewing", "offer", "rejected"]
ACTED_ON = ["applied", "interviewing", "offer", "rejected"]

# Salary: one unit of currency in US dollars, pay periods per year, plausibility bounds.
FX_USD = {
    "USD": 1.0, "EUR": 1.09, "GBP": 1.27, "CAD": 0.73, "AUD": 0.66, "NZD": 0.61, "CHF": 1.13,
    "SEK": 0.095, "NOK": 0.094, "DKK": 0.146, "PLN": 0.25, "CZK": 0.043, "HUF": 0.0028,
    "RON": 0.22, "BGN": 0.56, "UAH": 0.024, "TRY": 0.030, "ILS": 0.27, "AED": 0.27,
    "SAR": 0.27, "INR": 0.012, "SGD": 0.74, "HKD": 0.128, "JPY": 0.0067, "KRW": 0.00073,
    "CNY": 0.14, "TWD": 0.031, "MYR": 0.22, "IDR": 0.000062, "THB": 0.028, "PHP": 0.017,
    "VND": 0.000039, "BRL": 0.18, "MXN": 0.050, "ARS": 0.0011, "CLP": 0.0011, "COP": 0.00025,
    "PEN": 0.27, "UYU": 0.025, "ZAR": 0.055, "NGN": 0.00065, "KES": 0.0077, "EGP": 0.021,
    "MAD": 0.10, "RSD": 0.0093, "HRK": 0.145, "ISK": 0.0073, "GEL": 0.37, "AMD": 0.0026,
    "KZT": 0.0021, "MDL": 0.056, "BAM": 0.56, "MKD": 0.018, "ALL": 0.011,
}
PERIODS_PER_YEAR = {
    "YEAR": 1, "HALF_YEAR": 2, "QUARTER": 4, "MONTH": 12, "SEMI_MONTH": 24,
    "BIWEEK": 26, "WEEK": 52, "DAY": 260, "HOUR": 2080,
}
GUESS_ORDER = ["HOUR", "YEAR", "MONTH", "DAY", "WEEK", "HALF_YEAR", "QUARTER"]
SALARY_FLOOR = 5_000
SALARY_CEILING = 2_000_000
SALARY_GUESS_CEILING = 1_000_000
SALARY_MAX_SPREAD = 8

# Facets
FACET_CAPS = {"metro": 250, "country": 250, "company": 60, "skill": 60}
FACET_CAP = 40
AGE_BANDS = [("≤7 days", 7), ("≤30 days", 30), ("≤90 days", 90), ("≤180 days", 180), ("any age", None)]
SALARY_BANDS = [
    ("<$80k", 0, 80_000), ("$80–120k", 80_000, 120_000), ("$120–160k", 120_000, 160_000),
    ("$160–200k", 160_000, 200_000), ("$200k+", 200_000, None),
]
LADDER_MIN_FIGURES = 40
LADDER_QUANTILES = [0.2, 0.4, 0.6, 0.8]

NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "twelve": 12, "fifteen": 15, "twenty": 20,
}
