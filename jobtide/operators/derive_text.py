"""Row-local derivations: workplace, salary, years, seniority, function, signals.

Every function takes columns and gives a column (or struct of columns), so a
whole posting is derived inside the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    FX_USD, GUESS_ORDER, GUESSED_ONSITE, NUMBER_WORDS, PERIODS_PER_YEAR, SALARY_CEILING, SALARY_FLOOR,
    SALARY_GUESS_CEILING, SALARY_MAX_SPREAD,
)
from ..functions.text import any_term, fold, fold_lines, let, parse_number_word, running_sums, terms_found, unlined

# What a source's own workplace word means.
WORKPLACE_WORDS = {
    "onsite": "onsite", "on-site": "onsite", "on site": "onsite", "office": "onsite", "inoffice": "onsite",
    "hybrid": "hybrid", "flexible": "hybrid",
    "remote": "remote", "virtual": "remote", "work from home": "remote", "anywhere": "remote",
}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def workplace(raw: Column, raw_remote: Column, remote_hint: Column, metros: Column) -> Column:
    """struct(value, src): stated word, remote wording, on-site flag, else a guess from having an office."""
    word = F.coalesce(F.lower(F.trim(raw)), F.lit(""))

    def answer(value, src) -> Column:
        return F.struct(value.alias("value"), src.alias("src"))

    return (
        F.when(word.isin(list(WORKPLACE_WORDS)), answer(F.try_element_at(_map(WORKPLACE_WORDS), word), F.lit("ats-enum")))
        .when(word != "", answer(F.lit("unknown"), F.concat(F.lit("ats-enum-unrecognised:"), F.left(word, F.lit(24)))))
        .when(remote_hint, answer(F.lit("remote"), F.lit("location-text")))
        .when(raw_remote == F.lit(False), answer(F.lit("onsite"), F.lit("is-remote-false")))
        .when(F.size(metros) > 0, answer(F.lit("onsite"), F.lit(GUESSED_ONSITE)))
        .otherwise(answer(F.lit("unknown"), F.lit("no-signal")))
    )


def round_half_up(c: Column, places: int = 0) -> Column:
    """Nearest value with halves away from zero on the stored double, not its decimal spelling."""
    scale = 10.0 ** places
    return F.floor(c * scale + 0.5) / scale if places else F.floor(c + 0.5)


def number_text(c: Column) -> Column:
    """A double the way it is written: whole numbers without a decimal point."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def annual_salary(comp_min: Column, comp_max: Column, currency: Column, interval: Column) -> Column:
    """struct(min, max, known, src, currency) in US dollars a year.

    The stated interval is believed when the whole range is plausible under it;
    otherwise the first interval of a fixed order that makes it plausible, held
    to a lower ceiling because it is a guess.
    """
    stated = F.upper(F.coalesce(interval, F.lit("")))
    code = F.upper(F.coalesce(F.nullif(currency, F.lit("")), F.lit("USD")))
    read = F.struct(
        F.when(comp_min > 0, comp_min).alias("lo"), F.when(comp_max > 0, comp_max).alias("hi"), code.alias("code"),
        F.try_element_at(_map(FX_USD), code).alias("rate"), stated.alias("stated"),
        F.try_element_at(_map(PERIODS_PER_YEAR), stated).alias("per_year"),
        F.coalesce(F.nullif(stated, F.lit("")), F.lit("none")).alias("said"))
    return let(read, _read_salary)


def _read_salary(b: Column) -> Column:
    def attempt(name: Column, per_year: Column) -> Column:
        ceiling = F.when(name == b["stated"], SALARY_CEILING).otherwise(SALARY_GUESS_CEILING)
        src = F.when(name == b["stated"], F.lit("as-stated")).otherwise(F.concat(F.lit("reinterpreted:"), b["said"], F.lit("->"), name))

        def judge(y: Column) -> Column:
            fits = (
                F.coalesce(y["lo"].between(F.lit(SALARY_FLOOR), ceiling), F.lit(True))
                & F.coalesce(y["hi"].between(F.lit(SALARY_FLOOR), ceiling), F.lit(True))
                & F.coalesce((y["lo"] <= y["hi"]) & (y["hi"] <= y["lo"] * SALARY_MAX_SPREAD), F.lit(True))
            )
            return F.when(fits, F.struct(
                round_half_up(y["lo"]).cast("long").alias("min"), round_half_up(y["hi"]).cast("long").alias("max"),
                F.lit(True).alias("known"), src.alias("src"), b["code"].alias("currency")))

        yearly = F.struct((b["lo"] * b["rate"] * per_year).alias("lo"), (b["hi"] * b["rate"] * per_year).alias("hi"))
        return F.when(per_year.isNotNull(), let(yearly, judge))

    def refused(src: Column) -> Column:
        none = F.lit(None).cast("long")
        return F.struct(none.alias("min"), none.alias("max"), F.lit(False).alias("known"), src.alias("src"),
                        F.lit(None).cast("string").alias("currency"))

    tries = [attempt(b["stated"], b["per_year"])]
    tries += [attempt(F.lit(name), F.lit(PERIODS_PER_YEAR[name])) for name in GUESS_ORDER]
    implausible = F.concat(F.lit("implausible:"), b["said"], F.lit(":"), number_text(F.coalesce(b["lo"], b["hi"])), b["code"])
    return (
        F.when(b["lo"].isNull() & b["hi"].isNull(), refused(F.lit("no-figure")))
        .when(b["rate"].isNull(), refused(F.concat(F.lit("unknown-currency:"), b["code"])))
        .otherwise(F.coalesce(*tries, refused(implausible)))
    )


# How years of experience are written, and what is not one.
YEARS = (
    "(?:^|[^a-z0-9])(?:(?:at least|minimum(?: of)?|min\\.?|over|more than|upwards of|>=?)\\s*)?"
    "(\\d{1,2}(?:\\.\\d)?|" + "|".join(NUMBER_WORDS) + ")\\s*(?:\\+\\s*)?"
    "(?:(?:-|to|or)\\s*(\\d{1,2})\\s*(?:\\+\\s*)?)?(?:\\+\\s*)?(?:years?|yrs?\\.?|yoe)\\b"
)
# What every match has, asked first: the word for years behind a number. Folded lines hold no run of more than two spaces.
YEARS_NEAR = "y(?<=(?:[0-9]|" + "|".join(NUMBER_WORDS) + ")[\\s+]{0,8}y)(?=ear|r|oe)"
# A match begins at most 39 characters before that y, and claims are judged on 60 more; behind the y, 4 and 70 are read.
YEARS_BEFORE, YEARS_BEHIND = 200, 100
YEARS_CONTEXT = (
    "experien|background|professional|track record|hands[- ]on|working (?:in|with|as)|"
    "in the (?:industry|field|space)|expertise|practicing|practice|building|career|history of|proven|"
    "relevant|minimum|required|requirement|qualification"
)
YEARS_ANTI_CONTEXT = (
    "\\b(?:founded|since|for (?:the )?(?:last|past)|over the (?:last|past)|in business|anniversary|"
    "history|company|we have been|has been|our \\w+ of|celebrating)\\b"
)
NOT_EXPERIENCE = (
    "^['’]?\\s*(?:of age\\b|(?:or|and)\\s+(?:older|above|over|up)\\b|older\\b|old\\b|"
    "of (?:continuous )?service\\b|continuous service\\b|of employment\\b|ago\\b|in a row\\b|running\\b)"
)
COMPANY_TENURE = (
    "(?:\\b(?:with|for)\\s+(?:over|more than|upwards of|nearly|almost)|"
    "\\b(?:backed by|legacy of|tenure of|(?:build(?:ing)?|built) (?:on|upon|from))"
    "(?:\\s+(?:over|more than|upwards of|nearly|almost))?|"
    "\\b(?:nearly|almost|every)|\\bin (?:just|under|less than|only))$"
)
BULLET_SIGNS = "\\s>*•‣▪●◦⁃∙·o-"
BULLET = f"^[{BULLET_SIGNS}]*$"
MAX_YEARS = 40


def years_claims(description: Column) -> Column:
    """array<struct(min, max)> of experience claims in reading order."""
    # Most texts say nothing about years; they skip the folding and the cutting.
    return F.when(speaks_of_years(description), let(fold_lines(description), claims_in_lines)).otherwise(F.array().cast(CLAIMS))


CLAIMS = "array<struct<min:double,max:double>>"


def speaks_of_years(description: Column) -> Column:
    """False only where no claim can be; an accent may make the y another character."""
    return description.rlike("(?i)y(?:ea)?r|yoe") | (F.length(description) != F.octet_length(description))


def around_years(pieces: Column) -> Column:
    """A text again, from its pieces between the words for years, without what lies too far from any of them to be read.

    Of a part left out, what ``line`` asks stays: whether it breaks the line, and
    whether more than bullets stand behind that.
    """
    def ends(p: Column) -> Column:
        out = F.substring(p, F.lit(YEARS_BEHIND + 1), F.length(p) - (YEARS_BEHIND + YEARS_BEFORE))
        stays = let(out, lambda o: F.concat(
            F.when(o.contains("\n"), "\n").otherwise(""), F.when(F.substring_index(o, "\n", -1).rlike(f"[^{BULLET_SIGNS}]"), "x").otherwise("")))
        return F.when(F.length(p) > YEARS_BEHIND + YEARS_BEFORE, F.concat(F.left(p, F.lit(YEARS_BEHIND)), stays, F.right(p, F.lit(YEARS_BEFORE)))).otherwise(p)

    return F.array_join(F.transform(pieces, ends), "y")


def claims_in_lines(lines: Column) -> Column:
    """``years_claims`` of a text that is folded with its lines.

    Only what is near a word for years is read. It is cut at its matches; running lengths of cuts and matches give
    each match's offset, and each claim is judged on the text just around it.
    """
    def matches(text: Column) -> Column:
        cuts = F.zip_with(F.split(text, YEARS, -1), F.regexp_extract_all(text, F.lit(YEARS), F.lit(0)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

        def placed(pairs: Column) -> Column:
            lengths = F.transform(pairs, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
            return let(running_sums(lengths), lambda before: F.filter(F.transform(pairs, lambda x, i: F.struct(
                (F.get(before, i) + F.length(x["gap"]) + 1).alias("at"), x["m"].alias("m"), x["gap"].alias("gap"), (i == 0).alias("first"))), lambda x: x["m"].isNotNull()))

        return let(cuts, placed)

    def window(text: Column, x: Column) -> Column:
        start = F.greatest(x["at"] - 60, F.lit(1))
        return F.struct(
            F.substring(text, start, x["at"] - start).alias("before"),
            F.substring(text, x["at"] + F.length(x["m"]), F.lit(70)).alias("behind"),
            x["m"].alias("m"),
            line(x).alias("line"),
            parse_number_word(F.regexp_extract(x["m"], YEARS, 1)).alias("min"),
            parse_number_word(F.nullif(F.regexp_extract(x["m"], YEARS, 2), F.lit(""))).alias("max"),
        )

    def line(x: Column) -> Column:
        """The current line up to the number. A line that holds an earlier match is no bullet, whatever follows."""
        lead = F.concat(x["gap"], F.when(x["at"] > 1, F.left(x["m"], F.lit(1))).otherwise(""))
        return F.when(x["first"] | lead.contains("\n"), F.substring_index(lead, "\n", -1)).otherwise(F.concat(F.lit("x"), lead))

    def is_claim(w: Column) -> Column:
        qualified = w["m"].rlike("(?:^|[^a-z])(?:over|more than|upwards of)\\s")
        lead = F.concat(F.regexp_replace(w["before"], "\\s+$", ""), F.when(qualified, " over").otherwise(""))
        around = w["before"].rlike(YEARS_CONTEXT) | F.concat(w["m"], w["behind"]).rlike(YEARS_CONTEXT)
        return (
            (w["min"] <= MAX_YEARS)
            & ~w["before"].rlike(YEARS_ANTI_CONTEXT)
            & ~w["behind"].rlike(NOT_EXPERIENCE)
            & ~lead.rlike(COMPANY_TENURE)
            & (w["line"].rlike(BULLET) | around)
        )

    def read(text: Column) -> Column:
        windows = F.transform(let(text, matches), lambda x: window(text, x))
        return F.transform(F.filter(windows, is_claim), lambda w: F.struct(
            w["min"].alias("min"), F.when(w["max"] >= w["min"], w["max"]).alias("max")))

    return let(F.split(lines, YEARS_NEAR, -1), lambda pieces: F.when(F.size(pieces) > 1, let(around_years(pieces), read)).otherwise(F.array().cast(CLAIMS)))


def strictest_years(claims: Column) -> Column:
    """struct(min, max): the claim with the largest minimum, the first of equals."""
    return F.aggregate(
        claims, F.lit(None).cast("struct<min:double,max:double>"),
        lambda best, x: F.when(best.isNull() | (x["min"] > best["min"]), x).otherwise(best),
    )


# Title rules in the order they are tried.
TITLE_RULES = [
    ("intern", "\\b(?:intern|internship|co-?op|trainee|apprentice|working student|werkstudent|praktikum)\\b"),
    ("executive", "\\b(?:chief|c[teofm]o|cxo|founder|co-?founder|partner|general manager|gm|svp|evp|"
                  "senior vice president|executive vice president)\\b"),
    ("director", "\\b(?:director|head of|vp|vice president)\\b"),
    ("manager", "\\b(?:manager|mgr|supervisor|team lead(?:er)?|people lead)\\b"),
    ("principal", "\\b(?:principal|distinguished|fellow)\\b"),
    ("staff", "\\b(?:staff|senior staff)\\b"),
    ("senior", "\\b(?:senior|snr|sr\\.?|lead|experienced|expert)\\b"),
    ("entry", "\\b(?:junior|jr\\.?|entry[- ]level|new grad(?:uate)?|graduate|associate|assistant)\\b"),
]
# Kinds of manager that manage no people.
FALSE_MANAGERS = [
    "account", "customer success", "product", "program", "project", "partner", "community", "social media", "content", "category", "brand",
    "marketing", "campaign", "portfolio", "relationship", "success", "engagement", "implementation", "deployment", "office", "case", "asset", "fund",
]
FALSE_MANAGER = "\\b(?:" + "|".join(FALSE_MANAGERS) + ") manager\\b"
RANK_SUFFIX = "\\b(?:level\\s*)?(i{1,3}|iv|v|[1-5])\\b\\s*$"
RANK_LEVELS = {"i": "entry", "1": "entry", "ii": "entry", "2": "entry", "iii": "senior", "3": "senior",
               "iv": "senior", "4": "senior", "v": "staff", "5": "staff"}
YEARS_LEVELS = [(1, "entry"), (2, "junior"), (5, "mid"), (8, "senior")]


def seniority_from_title(folded_title: Column) -> Column:
    """struct(level, src) from wording or a trailing rank, NULL when the title says nothing."""
    out = None
    for level, pattern in TITLE_RULES:
        hit = folded_title.rlike(pattern)
        if level == "manager":
            hit = hit & ~folded_title.rlike(FALSE_MANAGER)
        answer = F.struct(F.lit(level).alias("level"), F.lit(f"title:{level}").alias("src"))
        out = F.when(hit, answer) if out is None else out.when(hit, answer)
    rank = F.regexp_extract(folded_title, RANK_SUFFIX, 1)
    return out.when(rank != "", F.struct(
        F.try_element_at(_map(RANK_LEVELS), rank).alias("level"), F.concat(F.lit("title:rank-"), rank).alias("src")))


def seniority_from_years(min_years: Column) -> Column:
    out = F.when(min_years.isNull(), F.lit(None).cast("string"))
    for ceiling, level in YEARS_LEVELS:
        out = out.when(min_years <= ceiling, level)
    return out.otherwise("staff")


def seniority(folded_title: Column, min_years: Column) -> Column:
    by_years = F.when(min_years.isNotNull(), F.struct(
        seniority_from_years(min_years).alias("level"), F.concat(F.lit("years:"), number_text(min_years)).alias("src")))
    silent = F.struct(F.lit("unknown").alias("level"), F.lit("no-signal").alias("src"))
    return F.coalesce(seniority_from_title(folded_title), by_years, silent)


# Function rules in the order they are tried, on the title and then on department and team.
FUNCTION_RULES = {
    "customer-success": [
        "customer success", "customer experience", "account management", "account manager", "client services", "client success", "implementation",
        "deployment", "onboarding", "solutions consultant", "solutions architect", "solutions engineer", "sales engineer", "technical account",
        "support engineer", "customer support", "technical support", "renewals", "customer operations",
    ],
    "sales": [
        "sales", "account executive", "business development", "bdr", "sdr", "revenue", "partnerships", "channel", "go to market", "gtm",
        "commercial", "inside sales", "field sales", "enterprise sales",
    ],
    "marketing": [
        "marketing", "growth", "demand generation", "brand", "content", "seo", "communications", "pr", "social media", "copywriter", "campaign",
        "community",
    ],
    "data": [
        "data scientist", "data science", "data engineer", "data analyst", "analytics", "machine learning", "ml engineer", "ai engineer",
        "business intelligence", "bi", "data platform", "analytics engineer", "statistician",
    ],
    "research": ["research scientist", "research engineer", "researcher", "research associate", "scientist", "r&d"],
    "security": [
        "security", "appsec", "infosec", "soc analyst", "penetration", "threat", "trust and safety", "trust & safety", "grc", "compliance engineer",
    ],
    "it": [
        "it", "information technology", "helpdesk", "help desk", "system administrator", "sysadmin", "network engineer", "desktop support",
    ],
    "engineering": [
        "engineer", "engineering", "developer", "programmer", "sre", "devops", "architect", "qa", "quality assurance", "test engineer", "mobile",
        "frontend", "front end", "backend", "back end", "full stack", "fullstack", "platform", "infrastructure", "firmware", "embedded",
    ],
    "design": ["designer", "design", "ux", "ui", "user experience", "user research", "creative", "illustrator", "motion"],
    "product": [
        "product manager", "product management", "product owner", "product lead", "technical product", "product operations", "product marketing",
    ],
    "finance": [
        "finance", "financial", "accountant", "accounting", "controller", "fp&a", "treasury", "audit", "tax", "payroll", "bookkeep", "investment",
        "underwrit",
    ],
    "legal": ["legal", "counsel", "attorney", "lawyer", "paralegal", "contracts", "privacy"],
    "people": [
        "recruiter", "recruiting", "talent", "people operations", "people ops", "human resources", "hr", "hrbp", "compensation", "benefits",
        "learning and development",
    ],
    "healthcare": [
        "nurse", "rn", "physician", "clinical", "medical", "therapist", "pharmacist", "behavior analyst", "bcba", "caregiver", "dental", "veterinar",
        "patient",
    ],
    "education": ["teacher", "tutor", "instructor", "professor", "curriculum", "education", "academic", "school"],
    "science": ["biolog", "chemist", "physicist", "laborator", "lab technician", "bioinformatic", "genomic"],
    "manufacturing": [
        "manufacturing", "production", "assembler", "machinist", "fabrication", "welder", "industrial", "mechanical engineer", "electrical engineer",
        "process engineer", "quality inspector", "maintenance technician",
    ],
    "construction": ["construction", "foreman", "estimator", "superintendent", "electrician", "plumber", "hvac", "installer", "carpenter", "roofer"],
    "logistics": ["logistics", "supply chain", "warehouse", "driver", "dispatcher", "fleet", "procurement", "inventory", "shipping", "fulfillment"],
    "hospitality": ["chef", "cook", "server", "bartender", "barista", "housekeep", "hotel", "restaurant", "concierge", "front desk"],
    "retail": ["retail", "store manager", "sales associate", "cashier", "merchandis", "stylist"],
    "media": ["journalist", "editor", "producer", "video", "photographer", "podcast", "broadcast"],
    "operations": [
        "operations", "ops", "program manager", "project manager", "chief of staff", "strategy", "business operations", "bizops", "strategist",
        "analyst", "consultant", "coordinator", "administrator", "executive assistant", "office manager",
    ],
}


def job_function(folded_title: Column, folded_department: Column) -> Column:
    out = None
    for text in (folded_title, folded_department):
        for name, terms in FUNCTION_RULES.items():
            hit = any_term(text, terms)
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


# Skills looked for, visa, clearance and degree wording.
SKILL_TERMS = [
    "python", "javascript", "typescript", "java", "kotlin", "swift", "ruby", "rails", "php", "scala", "rust", "golang", "c++", "c#", ".net",
    "objective-c", "perl", "elixir",
    "react", "react native", "angular", "vue", "svelte", "next.js", "node.js", "django", "flask", "fastapi", "spring boot", "graphql", "rest api",
    "grpc",
    "aws", "azure", "gcp", "google cloud", "kubernetes", "docker", "terraform", "ansible", "jenkins", "ci/cd", "linux", "serverless",
    "microservices",
    "sql", "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "snowflake", "databricks", "bigquery", "redshift", "spark", "hadoop", "kafka",
    "airflow", "dbt", "etl",
    "machine learning", "deep learning", "nlp", "computer vision", "pytorch", "tensorflow", "scikit-learn", "pandas", "numpy", "llm",
    "large language models",
    "generative ai", "rag", "prompt engineering", "langchain", "hugging face", "mlops",
    "tableau", "power bi", "looker", "excel", "google sheets", "sigma", "mode",
    "salesforce", "hubspot", "marketo", "outreach", "salesloft", "gong", "zendesk", "servicenow", "jira", "confluence", "asana", "notion",
    "airtable", "zapier",
    "netsuite", "workday", "sap", "oracle", "quickbooks", "stripe", "segment", "amplitude", "mixpanel", "google analytics", "braze", "iterable",
    "intercom", "twilio",
    "figma", "sketch", "adobe", "photoshop", "illustrator", "after effects", "canva", "webflow", "wordpress", "shopify", "contentful",
    "agile", "scrum", "kanban", "six sigma", "lean", "pmp", "prince2", "itil", "soc 2", "hipaa", "gdpr", "pci", "iso 27001", "sox",
    "cpa", "cfa", "series 7", "bcba", "rn", "cissp", "ccna", "aws certified", "autocad", "solidworks", "revit", "matlab", "labview", "plc",
]
VISA_NO = (
    "\\b(?:not|no|cannot|can not|can't|unable|do(?:es)? not|will not|won't|without|ineligible)\\b[^.]{0,40}?\\bsponsor"
)
VISA_YES = (
    "\\b(?:visa sponsorship (?:is )?(?:available|offered|provided)|we (?:can |do |will )?sponsor|"
    "sponsorship (?:is )?available|will sponsor|h-?1b (?:transfer|sponsor)|open to sponsor)"
)
CLEARANCE = (
    "\\b(?:security clearance|ts/sci|top secret|secret clearance|public trust|dod clearance|active clearance|polygraph)\\b"
)
DEGREE_RULES = [
    ("phd", "\\b(?:ph\\.?d|doctorate|doctoral)\\b"),
    ("masters", "\\b(?:master'?s?(?: degree)?|m\\.?s\\.?c?\\b|mba|m\\.?eng)\\b"),
    ("bachelors", "\\b(?:bachelor'?s?(?: degree)?|b\\.?s\\.?c?\\b|b\\.?a\\.?\\b|undergraduate degree|four[- ]year degree)\\b"),
    ("none", "\\b(?:no degree (?:required|necessary)|degree not required|in lieu of a degree|or equivalent experience|"
             "equivalent practical experience|high school diploma)\\b"),
]
# A wording has one of these; most texts have none, and finding that out costs little.
DEGREE_HINTS = {"phd": ["phd", "ph.d", "doctora"], "none": ["degree", "equivalent", "diploma"]}
DEGREE_STARTS = {"masters": "m", "bachelors": "buf"}
VISA_HINTS = ["sponsor", "1b transfer"]
# A refusal as it is seen from its last word, with room for characters that are stored as two.
VISA_NO_NEAR = "sponsor(?<=" + VISA_NO.replace("{0,40}?", "{0,80}") + ")"
CLEARANCE_HINTS = ["clearance", "ts/sci", "top secret", "public trust", "polygraph"]


def _hinted(text: Column, hints: list[str]) -> Column:
    some = text.contains(hints[0])
    for h in hints[1:]:
        some = some | text.contains(h)
    return some


def _holds(text: Column, hints: list[str], pattern: str) -> Column:
    """Whether the pattern is found; it is only tried where a hint is."""
    return _hinted(text, hints) & text.rlike(pattern)


def _starting(chars: str, pattern: str) -> str:
    """The pattern, tried only at characters it can start with; these come first, as they are the cheaper test."""
    return f"[{chars}](?<=(?={pattern})[{chars}])"


def skills(folded_text: Column, terms=None) -> Column:
    """Distinct skills named, in alphabetical order."""
    return F.array_sort(F.array_distinct(terms_found(folded_text, terms or SKILL_TERMS)))


def visa(folded_text: Column) -> Column:
    """False for a refusal to sponsor, true for an offer, NULL when silent."""
    told = F.when(folded_text.rlike(VISA_NO_NEAR) & folded_text.rlike(VISA_NO), False).when(folded_text.rlike(_starting("vwsho", VISA_YES)), True)
    return F.when(_hinted(folded_text, VISA_HINTS), told)


def clearance(folded_text: Column) -> Column:
    return F.when(_holds(folded_text, CLEARANCE_HINTS, CLEARANCE), True)


def degree(folded_text: Column) -> Column:
    out = None
    for level, pattern in DEGREE_RULES:
        hit = _holds(folded_text, DEGREE_HINTS[level], pattern) if level in DEGREE_HINTS else folded_text.rlike(_starting(DEGREE_STARTS[level], pattern))
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


def signals(description: Column) -> Column:
    """struct(skills, visa, clearance, degree) with the text folded once."""
    return let(fold(description), signals_in)


def signals_in(folded_text: Column) -> Column:
    """``signals`` of a text that is folded."""
    return F.struct(skills(folded_text).alias("skills"), visa(folded_text).alias("visa"), clearance(folded_text).alias("clearance"), degree(folded_text).alias("degree"))


def read_text(description: Column) -> Column:
    """struct(signals, years): ``signals`` and the ``strictest_years`` of ``years_claims``, with the text folded once for both."""
    def read(lines: Column) -> Column:
        return F.struct(let(unlined(lines, description), signals_in).alias("signals"), strictest_years(claims_in_lines(lines)).alias("years"))

    return let(fold_lines(description), read)


def quality(description_length: Column, salary_known: Column, years_known: Column, place: Column, metros: Column,
            employment_type: Column, department: Column, posted_at: Column) -> Column:
    """Share of eight useful fields the posting fills in, to two places."""
    filled = [
        description_length > 400, salary_known, years_known, place != "unknown", F.size(metros) > 0,
        F.coalesce(employment_type, F.lit("")) != "", F.coalesce(department, F.lit("")) != "", posted_at.isNotNull(),
    ]
    total = sum((F.coalesce(f, F.lit(False)).cast("int") for f in filled), F.lit(0))
    return round_half_up(total / 8.0, 2)
