"""Row-local derivations against worked cases."""

import pytest
from pyspark.sql import functions as F

from jobtide.functions import text as T
from jobtide.operators import derive_text as D


def run(spark, values, schema, expr):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_terms(spark):
    cases = [
        ("Paid Social Account Director", "ai", False), ("Supply Chain Manager", "ai", False), ("AI/ML Engineer", "ai", True),
        ("Engineer (AI)", "ai", True), ("Especialista de Producto", "specialist", False),
        ("Geotechnical Engineer", "technical", False), ("JavaScript Engineer", "java", False),
        ("Senior C++ Developer", "c++", True), (".NET Engineer", ".net", True),
    ]
    for term in {t for _, t, _ in cases}:
        mine = [(s, want) for s, t, want in cases if t == term]
        assert run(spark, [s for s, _ in mine], "s string", T.has_term(T.fold(F.col("s")), term)) == [w for _, w in mine]


def test_fold_agrees_with_literals(spark):
    words = ["Zürich", "  A B\t c ", "“x” – ‘y’", "Bogotá́", "", "ÅNGSTRÖM İ", None]
    got = run(spark, words, "s string", T.fold(F.col("s")))
    assert got[:6] == [T.fold_literal(w) for w in words[:6]] and got[6] == ""
    lines = run(spark, [" A \r\n\r\n\r\n\r\n b\tc "], "s string", T.fold_lines(F.col("s")))
    assert lines == ["a\n\nb c"]


def test_text_helpers(spark):
    assert run(spark, ["acme-corp", "mcDonald_foo  bar", "x"], "s string", T.title_case(F.col("s"))) == ["Acme Corp", "McDonald Foo Bar", "X"]
    assert run(spark, ["O'Brien & Söhne -- GmbH!"], "s string", T.slugify(F.col("s"))) == ["obrien-sohne-gmbh"]
    assert run(spark, ["two", "2.5", "1,000", "x", None], "s string", T.parse_number_word(F.col("s"))) == [2.0, 2.5, 1000.0, None, None]
    assert run(spark, ["a &amp;lt; &#8211; &#x41; &bogus; &lt;&nbsp;x &#55296;"], "s string", T.decode_entities(F.col("s"))) == [
        "a &lt; – A &bogus; < x &#55296;"]
    html = "<head><title>t</title></head><p>One&nbsp;two</p><ul><li>a</li><li>b</li></ul><script>x()</script><td>c</td><td>d</td><!-- z -->"
    assert run(spark, [html], "s string", T.html_to_text(F.col("s"))) == ["One two\n\na\nb\n\nc d"]
    assert run(spark, [None, ""], "s string", T.html_to_text(F.col("s"))) == ["", ""]


SALARIES = [
    ((250000.0, 300000.0, "USD", "YEAR"), (250000, 300000, True)), ((42.0, 55.0, "USD", "HOUR"), (87360, 114400, True)),
    ((9000.0, 12000.0, "EUR", "MONTH"), (117720, 156960, True)), ((30.0, 50.0, "USD", "YEAR"), (62400, 104000, True)),
    ((310000000.0, None, "USD", "YEAR"), (None, None, False)), ((1.0, 1.0, "USD", "YEAR"), (None, None, False)),
    ((None, None, None, "NONE"), (None, None, False)), ((200.0, 400000.0, "USD", "YEAR"), (None, None, False)),
    ((200000.0, 90000.0, "USD", "YEAR"), (None, None, False)), ((60.0, 90.0, "USD", "YEAR"), (124800, 187200, True)),
    ((125000.0, 1350000.0, "USD", "YEAR"), (None, None, False)), ((100000.0, 800000.0, "USD", "YEAR"), (100000, 800000, True)),
    ((600.0, 800.0, "EUR", "YEAR"), (7848, 10464, True)), ((925000.0, 2000000.0, "USD", "YEAR"), (925000, 2000000, True)),
    ((400.0, 600.0, "USD", "HOUR"), (832000, 1248000, True)), ((5.0, None, "ZZZ", "YEAR"), (None, None, False)),
]


def test_salary(spark):
    got = run(spark, [s for s, _ in SALARIES], "lo double, hi double, cur string, per string",
              D.annual_salary(F.col("lo"), F.col("hi"), F.col("cur"), F.col("per")))
    assert [(g.min, g.max, g.known) for g in got] == [w for _, w in SALARIES]
    assert got[3].src == "reinterpreted:YEAR->HOUR" and got[4].src == "implausible:YEAR:310000000USD"
    assert got[6].src == "no-figure" and got[15].src == "unknown-currency:ZZZ" and got[0].src == "as-stated"


YEARS = [
    ("5+ years of experience in sales", 5), ("3–7+ years of SaaS sales experience", 3),
    ("Minimum of 5 years of experience required", 5), ("At least two years of relevant experience", 2),
    ("We have been building products for the last 15 years.", None), ("The 5 years since our founding", None),
    ("5+ years of experience in sales. 1+ year of experience with Salesforce.", 5),
    ("Minimum Qualifications:\n- Must be 18 years of age or older.", None),
    ("Must be 21 years of age. 2+ years of experience in retail.", 2),
    ("Sabbatical after 5 years of service. Requires relevant background.", None),
    ("Our required rebuild shipped 6 years ago.", None),
    ("What You'll Bring\n6+ years in customer-facing roles (Product, Consulting)", 6),
    ("- 3 - 5+ years in a technical, customer-facing role", 3), ("We spent 15 years in customer-facing roles.", None),
    ("- 18 years of age with a high school diploma", None),
    ("Hiring requirements\n- Must be 21 years or older\n- Must pass a background check", None),
    ("Requirements: 18 years and up.", None), ("A cybersecurity forerunner with more than 30 years of experience.", None),
    ("Leader in the industry for over 40 years of proven expertise.", None),
    ("Proven success: nearly 20 years serving local communities.", None),
    ("We have served customers with over 40 years of experience.\n- 3+ years of experience in sales", 3),
    ("Field experience for at least 4 years required", 4), ("- Up to 2 years of relevant work experience", 2),
    ("An investment firm building on more than 30 years of investing experience.", None),
    ("We are backed by 30 years of infrastructure and proven expertise.", None),
    ("Cashiers must be 16 years' of age to apply, per requirements.", None), (None, None), ("", None),
]


def test_years(spark):
    got = run(spark, [s for s, _ in YEARS], "s string", D.strictest_years(D.years_claims(F.col("s"))))
    assert [(s, g.min if g else None) for (s, _), g in zip(YEARS, got)] == [(s, float(w) if w is not None else None) for s, w in YEARS]
    bullet = run(spark, ["• 2-4 years in a quantitative or analytical role"], "s string", D.strictest_years(D.years_claims(F.col("s"))))
    assert bullet[0].max == 4.0


def test_seniority(spark):
    cases = [
        ("Senior Software Engineer", "senior"), ("Lead Engineer", "senior"), ("Team Lead, Support", "manager"), ("Engineer II", "entry"),
        ("Software Engineer", None), ("Solutions Architect", None), ("Principal Architect", "principal"), ("Account Manager", None),
        ("Engineering Manager", "manager"), ("Type 2 Diabetes Specialist", None),
    ]
    got = run(spark, [t for t, _ in cases], "s string", D.seniority_from_title(T.fold(F.col("s"))))
    assert [g.level if g else None for g in got] == [w for _, w in cases]
    by_years = run(spark, [1.0, 2.0, 5.0, 8.0, 9.0, None], "y double", D.seniority(F.lit(""), F.col("y")))
    assert [g.level for g in by_years] == ["entry", "junior", "mid", "senior", "staff", "unknown"]
    assert by_years[0].src == "years:1"


def test_function(spark):
    cases = [
        ("Software Engineer", "", "engineering"), ("Implementation Specialist", "", "customer-success"),
        ("AI Deployment Strategist", "", "customer-success"), ("Account Executive", "", "sales"),
        ("Registered Nurse", "", "healthcare"), ("Team Member", "Marketing", "marketing"), ("Zzz", "", "other"),
    ]
    got = run(spark, [(t, d) for t, d, _ in cases], "t string, d string", D.job_function(T.fold(F.col("t")), T.fold(F.col("d"))))
    assert got == [w for *_, w in cases]


def test_text_is_folded_once(spark):
    """What is read with one folding is what each function reads by itself, and single blanks are no match of the folding."""
    texts = ["At least\u00a0two\n\n years of relevant experience. \u0085", " PhD \r\n\r\n\r\n•  5 +\t+ yrs. Python\u200b", "\u3000a\u0301 \x0b b \n ", "TS/SCI, e\u0301quivalent", "", None]
    texts += [text for text, _ in YEARS]
    spaced = [f"a{c}b {c} c{c}" for c in "\t\n\x0b\f\r\u00a0\u1680\u2000\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"]
    assert run(spark, texts + spaced, "s string", T.unlined(T.fold_lines(F.col("s")), F.col("s"))) == run(spark, texts + spaced, "s string", T.fold(F.col("s")))
    apart = F.struct(D.signals(F.col("s")).alias("signals"), D.strictest_years(D.years_claims(F.col("s"))).alias("years"))
    assert run(spark, texts, "s string", D.read_text(F.col("s"))) == run(spark, texts, "s string", apart)
    assert run(spark, spaced, "s string", T.fold(F.col("s"))) == ["a b c"] * len(spaced)
    assert run(spark, ["a b c", "a  b", "a\tb"], "s string", F.col("s").rlike(T.SPACE_RUN)) == [False, True, True]
    found = run(spark, [text for text, _ in YEARS], "s string", F.struct(T.fold_lines(F.col("s")).rlike(D.YEARS).alias("a"), T.fold_lines(F.col("s")).rlike(D.YEARS_NEAR).alias("b")))
    assert all(r.b for r in found if r.a) and any(r.a for r in found)


def test_signals(spark):
    texts = [
        "We are unable to provide visa sponsorship.", "We do not offer sponsorship at this time.", "Visa sponsorship is available.",
        "This role is not remote. Sponsorship is available.", "Requires an active TS/SCI clearance.", "Bachelor's degree required.",
        "PhD or Bachelor's degree", "We use Python, python, and PostgreSQL.", None,
    ]
    got = run(spark, texts, "s string", D.signals(F.col("s")))
    assert [g.visa for g in got[:4]] == [False, False, True, True]
    assert got[4].clearance is True and got[5].degree == "bachelors" and got[6].degree == "phd"
    assert got[7].skills == ["postgresql", "python"] and got[8].skills == [] and got[8].visa is None


@pytest.mark.parametrize("raw,remote,hint,metros,want", [
    ("Hybrid", True, False, [], "hybrid"), (None, None, True, [], "remote"), (None, None, False, ["nyc"], "onsite"),
    (None, None, False, [], "unknown"), ("weird", None, True, ["nyc"], "unknown"), (None, False, False, [], "onsite"),
])
def test_workplace(spark, raw, remote, hint, metros, want):
    got = run(spark, [(raw, remote, hint, metros)], "a string, b boolean, c boolean, d array<string>",
              D.workplace(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    assert got[0].value == want


FAR = "We care about people. " * 30
NEAR_YEARS = [
    FAR + "\n\n• 5+ years in sales.\n" + FAR + "At least two years of relevant experience. " + FAR,
    "• " + "o" * 700 + " 5 years", "x" + "•" * 700 + " 5 years", "x\n" + "•" * 700 + " 5 years", "5 years ago. " + "•" * 700 + " 6 years",
    "5 years ago.\n" + "o " * 400 + "6 years", "5 years ago. x\n" + "- " * 400 + "\u0085 6 years", "experience " + "•" * 60 + "5 years" + "•" * 62 + " experience" + "•" * 700,
    "3 years" + "•" * 68 + "experience " + "- " * 300, "3 years" + "z" * 75 + "experience " + "- " * 300, "12 \u00fdears of experience", "12 y\u0301ears of experience",
    "minimum of\n\ntwelve\n\n+\n\nto\n\n15\n\n+\n\n+\n\nyears" + FAR + "experience", FAR + "99 yrs.experience " + FAR + " one yoe, 2yrs, 3 years 4 years " + FAR + "proven 7 years\n" + FAR,
]


def test_years_are_read_near_their_words(spark, monkeypatch):
    """Claims of a text without its far parts are those of the whole text, and the far parts do go."""
    texts = NEAR_YEARS + [a + FAR + b for a, _ in YEARS for b, _ in YEARS if a and b]
    near = run(spark, texts, "s string", D.years_claims(F.col("s")))
    left = run(spark, [NEAR_YEARS[0]], "s string", F.length(D.around_years(F.split(T.fold_lines(F.col("s")), D.YEARS_NEAR, -1))))
    assert left[0] < 1200 < len(NEAR_YEARS[0])
    monkeypatch.setattr(D, "around_years", lambda pieces: F.array_join(pieces, "y"))
    assert near == run(spark, texts, "s string", D.years_claims(F.col("s")))
    assert [len(c) for c in near[10:12]] == [1, 1] and len(near[0]) == 2


def test_terms_found_as_by_one_pattern(spark):
    """The tree of terms finds what the alternation finds, at the edges of words and texts too."""
    texts = ["python", "java,javascript/java", "c++", "c++java", "c++,c#|.net", "x.net (.net", "react native reactnative react", "aws certified,aws", "node.js.next.js", "ci/cd/ci", "a\U0001f600sql\U0001f600",
             "r sql5 5sql sql", "series 7.", " sql", "sql ", "", "rest api;rest apis", "c+++", "soc 2type", "excel\nexcel"]
    whole = F.regexp_extract_all(F.col("s"), F.lit(T.terms_pattern(D.SKILL_TERMS)), F.lit(0))
    assert run(spark, texts, "s string", T.terms_found(F.col("s"), D.SKILL_TERMS)) == run(spark, texts, "s string", whole)
    odd = ["a/", ".net", "net", "r&d", "c++", "+", "ørsted", "a b", "a"]
    texts = ["a/.net", "a b/a/ .net net", "r&d,c++ + ørsted", "+c++", "a b a ba"]
    for terms in (odd, odd[1:]):
        whole = F.regexp_extract_all(F.col("s"), F.lit(T.terms_pattern(terms)), F.lit(0))
        assert run(spark, texts, "s string", T.terms_found(F.col("s"), terms)) == run(spark, texts, "s string", whole)
    assert run(spark, texts, "s string", T.terms_found(F.col("s"), [])) == [[]] * len(texts)


def test_wordings_are_tried_where_they_can_start(spark):
    """Degree and visa patterns behind their cheaper tests hit what the plain patterns hit; a transfer alone is an offer."""
    texts = ["m.s. b.a", "ms", "ams", "mba.", "four-year degree", "afour year degree", "b.sc", "bs", "master's", "an mba", "undergraduate degrees", "undergraduate degree",
             "h1b transfer", "h-1b sponsor", "we do sponsor", "awe sponsor", "open to sponsor", "no visa or other sponsor", "no. sponsor", "not " + "x" * 39 + " sponsor", "not " + "x" * 38 + " sponsor",
             "not " + "\U0001f600" * 39 + " sponsor", "not " + "\U0001f600" * 38 + " sponsor", "nosponsor", "no sponsor of some\nbut not here", ""]
    s = F.col("s")
    for level, pattern in D.DEGREE_RULES:
        if level in D.DEGREE_STARTS:
            assert run(spark, texts, "s string", s.rlike(D._starting(D.DEGREE_STARTS[level], pattern))) == run(spark, texts, "s string", s.rlike(pattern))
    assert run(spark, texts, "s string", D.visa(s)) == run(spark, texts, "s string", F.when(s.rlike(D.VISA_NO), False).when(s.rlike(D.VISA_YES), True))
    assert run(spark, ["h1b transfer available"], "s string", D.visa(s)) == [True]
