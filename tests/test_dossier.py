"""Dossiers and aliases, which have no SQL."""

from jobtide.operators import dossier, metros
from jobtide.operators.location import derive_location
from jobtide.schemas import COMPANIES, columns


def company(spark, **kw):
    return spark.createDataFrame([tuple(kw.get(c) for c in columns(COMPANIES))], COMPANIES)


def test_dossier(spark):
    about = "About Acme\n" + "We make anvils for the discerning. " * 4
    texts = ["Intro that is not about us at all.\n" + about, "short", about + "\n" + "x" * 3000, "Who we are\n" + "Z" * 5000, "y" * 400]
    titles = ["Smith", " smith ", "Anvil Tester", None] + [f"Role {i}" for i in range(20)]
    gathered = spark.createDataFrame([("a:acme", titles, texts)], "company_id string, titles array<string>, texts array<string>")
    c = company(spark, id="a:acme", slug="acme", name="Acme", website="https://acme.example.com")
    text = dossier.company_dossier(c, gathered).first().dossier
    lines = text.split("\n")
    assert lines[:3] == ["Company: Acme", "Board slug: acme", "Website: https://acme.example.com"]
    assert lines[3].startswith("Open roles: Smith; Anvil Tester; Role 0") and lines[3].endswith("(and 8 more)")
    pieces = text.split("\n\n--- from a posting ---\n")[1:]
    assert len(pieces) == 3 and pieces[0].startswith("About Acme") and "Intro" not in pieces[0]
    assert pieces[2].startswith("Who we are") and all(len(p) <= 1500 for p in pieces) and len(text) < 6200


def test_dossier_without_postings(spark):
    empty = spark.createDataFrame([], "company_id string, titles array<string>, texts array<string>")
    c = company(spark, id="a:x", slug="x", board_url="https://b")
    assert dossier.company_dossier(c, empty).first().dossier == "Company: x\nBoard: https://b"


def test_aliases(spark):
    schema = "id string, locations_all array<string>, location_raw string, city string, region string, country string, title string"
    posts = spark.createDataFrame([(str(i), [p], None, None, None, None, None) for i, p in enumerate(["Oslo, Norway", "Oslo", "Brooklyn, NY"])], schema)
    located = derive_location(posts)
    registry = metros.metro_registry(located, located)
    rows = {r.id: r for r in registry.collect()}
    assert (rows["oslo"].label, rows["oslo"].country, rows["oslo"].job_count) == ("Oslo", "no", 2) and rows["nyc"].label == "New York City"
    aliases = {r.alias: r.metro_id for r in metros.metro_aliases(registry, located).collect()}
    assert aliases["oslo"] == "oslo" and aliases["brooklyn"] == "nyc" and aliases["hoboken"] == "nyc" and "london" not in aliases
