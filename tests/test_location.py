"""Written places: inputs and the metros or countries they must give."""

from pyspark.sql import functions as F

from jobtide.operators.location import derive_location, parse_fragments, title_places, remote_scope

METROS = [
    ("Daly City, CA", ["sf-bay"]), ("Milpitas", ["sf-bay"]), ("Walnut Creek, CA", ["sf-bay"]), ("Manhattan Beach", ["la"]), ("Carrollton, TX", ["dallas"]),
    ("Denton", ["dallas"]), ("Doral, FL", ["miami"]), ("Etobicoke", ["toronto"]), ("North York, ON", ["toronto"]), ("Laval", ["montreal"]),
    ("Amstelveen", ["amsterdam"]), ("Haarlem, Netherlands", ["amsterdam"]), ("Saint-Denis", ["paris"]), ("Kowloon", ["hong-kong"]), ("Shibuya", ["tokyo"]),
    ("Gangnam", ["seoul"]), ("Pasig", ["manila"]), ("Del Mar, CA", ["san-diego"]), ("Hackney", ["london"]), ("Thane", ["mumbai"]), ("Koeln", ["cologne"]),
    ("New York City", ["nyc"]), ("New York, NY", ["nyc"]), ("Brooklyn, NY", ["nyc"]),
    ("NYC | SF", ["nyc", "sf-bay"]), ("San Francisco Office", ["sf-bay"]),
    ("In person in New York City", ["nyc"]), ("Metzingen / Riederich", ["stuttgart"]),
    ("United States, New York, New York City", ["nyc"]), ("Washington D.C, New York", ["dc", "nyc"]),
    ("Riederich, Baden-Wurttemberg, Germany", ["stuttgart"]), ("Paris, Île-de-France, France", ["paris"]),
    ("Boulogne-Billancourt, France", ["paris"]), ("Newark, NJ", ["nyc"]), ("Newark, CA", ["sf-bay"]),
    ("Singapore, SG", ["singapore"]), ("Hong Kong", ["hong-kong"]), ("United States", []), ("Europe", []),
    ("Remote", []), ("New York - Remote", ["nyc"]), ("San Francisco, CA", ["sf-bay"]),
    ("Pangyo Software Dream Center", []), ("829 Boston Post Road", []),
    ("Ho Chi Minh City", ["ho-chi-minh-city"]), ("St Louis, MO", ["st-louis"]),
    ("Dallas TX", ["dallas"]), ("New York City NY", ["nyc"]), ("MA Boston", ["boston"]),
    ("London UK", ["london"]), ("Germany Berlin", ["berlin"]), ("Atlanta Georgia", ["atlanta"]),
    ("Berlin DE", ["berlin"]), ("US NY New York", ["nyc"]), ("Newark CA", ["sf-bay"]),
    ("Portland ME", ["portland-me"]), ("Paris TX", ["paris-tx"]), ("Surrey GB", ["surrey-gb"]),
    ("Costa Mesa", ["costa-mesa"]), ("La Mesa", ["la-mesa"]), ("Washington State", ["washington-state"]),
    ("US-MA-Boston", ["boston"]), ("US-CA-Menlo Park", ["sf-bay"]), ("FL-Midtown", ["fl-midtown"]),
    ("La-Mesa", ["la-mesa"]), ("AZ_Mesa_HQ", ["phoenix"]), ("Boulogne-Billancourt", ["paris"]),
    ("Riederich, Baden-Wurttemberg", ["stuttgart"]), ("Office MPS TN Nashville", ["nashville"]),
    ("Office MPS TX Lewisville 1", ["dallas"]), ("Gurugram 10 C", ["delhi-ncr"]), ("NYC (1285)", ["nyc"]),
    ("Richmond University Medical Center (Staten Island, NY)", ["nyc"]),
    ("Mexico > Mexico City : Building B", ["mexico-city"]), ("US > Arizona > Phoenix", ["phoenix"]),
    ("Campus: Tempe", ["phoenix"]), ("Remote: United States", []),
    ("Columbia University Irving Medical Center", []), ("Berkeley Medical Center (BMC)", []),
    ("Seminole Hard Rock Hotel & Casino Hollywood", []), ("New York Mills, MN", ["new-york-mills"]),
    ("North Chicago, IL", ["north-chicago"]), ("Newton College, Spain, Elche", ["elche", "newton-college"]),
    ("Rio de Janeiro", ["rio-de-janeiro"]), ("Paris La Défense", ["paris-la-defense"]),
    ("Beth Israel Deaconess Medical Center", []),
    ("Aurora St Lukes Medical Center - 2900 W Oklahoma Ave", []), ("St Louis MO", ["st-louis-mo"]),
]
COUNTRIES = [("Remote - US", ["us"]), ("Seoul, KR", ["kr"]), ("Toronto, ON, Canada", ["ca"])]
TITLES = [  # title, metros, countries
    ("Enterprise Sales Representative – Saudi Arabia", None, ["sa"]),
    ("Business Development Representative - MENA (Saudi Arabia)", None, ["sa"]),
    ("Sports Data Collector (Football) - Abha, Saudi Arabia", [], ["sa"]),
    ("Real Estate Associate - Los Angeles", ["la"], None),
    ("Structurer (Structured Products) - New York", None, ["us"]),
    ("Field Application Engineer – Smartcard (Munich OR Paris based)", ["munich", "paris"], None),
    ("RTV Returns Inspector - Indianapolis, IN", None, ["us"]),
    ("Applied AI Sr. Web Developer - Ottawa, ON", None, ["ca"]),
    ("District Sales Manager - Portland, ME", [], None), ("Sales Lead, Hong Kong", ["hong-kong"], None),
    ("Full Stack .Net - UI Focus - Remote US", None, ["us"]),
    ("Medical Science Liaison, Pennsylvania", None, ["us"]),
    ("Field Reimbursement Manager - New Brunswick, NJ", None, ["us"]),
    ("Brokerage Operations Manager - Saudi", None, ["sa"]), ("Account Manager - KSA", None, ["sa"]),
    ("Software Engineer - Cambridge, UK", [], ["gb"]), ("Product Manager - Growth", [], None),
    ("Senior Network Engineer, IT", None, []), ("Physical Therapist, PT - Home Health", None, []),
    ("MD/DO - Orthopedics", None, []), ("Elektroniker: in Betriebstechnik", None, []),
    ("Part Time Faculty Interest Pool - PE and Dance", None, []), ("Sr. Mechanical Engineer, PE", None, []),
    ("RN Case Manager - FT - Days - $10K Sign on Bonus - MHP", None, []),
    ("CDD - Technicien de recherches en synthèse organique (F/H)", None, []),
    ("Senior Software Engineer, Backend", None, []),
]


def test_fragments(spark):
    rows = [(f,) for f, _ in METROS + COUNTRIES]
    got = {r.fragment: r for r in parse_fragments(spark.createDataFrame(rows, "fragment string")).collect()}
    wrong = [(f, sorted(got[f].metros), want) for f, want in METROS if sorted(got[f].metros) != want]
    wrong += [(f, sorted(got[f].countries), want) for f, want in COUNTRIES if sorted(got[f].countries) != want]
    assert not wrong
    assert got["Remote - US"].remote and not got["Dallas TX"].remote


def test_titles(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TITLES) if t], "i int, title string")
    got = {r.i: r.place for r in title_places(df).collect()}
    wrong = []
    for i, (title, metros, countries) in enumerate(TITLES):
        if metros is not None and sorted(got[i].metros) != metros:
            wrong.append((title, got[i].metros, metros))
        if countries is not None and sorted(got[i].countries) != countries:
            wrong.append((title, got[i].countries, countries))
    assert not wrong


def test_derive_location(spark):
    schema = "id string, locations_all array<string>, location_raw string, city string, region string, country string, title string"
    rows = [
        ("a", ["Remote", "Brooklyn, NY"], "Remote", "NYC", "NY", None, "x"),
        ("b", ["Remote"], "Remote", None, None, None, "Enterprise Sales Representative – Saudi Arabia"),
        ("c", ["Statistician Network"], None, None, None, None, "Sports Data Collector (Football) - Abha, Saudi Arabia"),
        ("d", ["New York, NY"], None, None, None, None, "Account Executive - Saudi Arabia"),
        ("e", None, None, None, None, None, None),
    ]
    got = {r.id: r for r in derive_location(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"].d_metros == ["nyc"]
    assert got["b"].d_countries == ["sa"] and got["b"].remote_hint
    assert got["c"].d_countries == ["sa"]
    assert got["d"].d_countries == ["us"]
    assert got["e"].d_metros == [] and got["e"].d_countries == [] and not got["e"].remote_hint


def test_remote_scope(spark):
    rows = [(1, ["us"], []), (2, ["us", "ca"], []), (3, [], ["europe"]), (4, ["us"], ["worldwide"]), (5, [], [])]
    df = spark.createDataFrame(rows, "i int, c array<string>, s array<string>")
    got = {r.i: r.v for r in df.select("i", remote_scope(F.col("c"), F.col("s")).alias("v")).collect()}
    assert got == {1: "country", 2: "region", 3: "region", 4: "worldwide", 5: None}


def test_place_tables_are_whole():
    """Every metro is listed with all its spellings, and none twice."""
    from jobtide.functions.gazetteer import DEFAULT, METROS as TABLE

    spellings = [c for *_, cities in TABLE for c in cities]
    assert len(TABLE) == 65 and len(spellings) == len(set(spellings)) == len(DEFAULT.cities) == 336
