"""The stored corpus and the token store: what a day reads, writes, keeps and shares."""

import pytest
from pyspark.sql import functions as F

from jobtide.operators import textindex
from jobtide.plans import corpus as plan
from jobtide.plans.corpus import Corpus
from jobtide.plans.textstore import TokenStore
from jobtide.schemas import BOARDS, POSTINGS_RAW, SNAPSHOT
from jobtide.sources.store import TableStore, part_of
from jobtide.workloads.q_snapshot import fill

T0 = "2026-02-01 06:00:00"


def postings(spark, boards=20, each=3):
    rows = spark.range(boards * each).withColumn("b", F.col("id") % boards)
    return fill(rows, POSTINGS_RAW, id="'ashby:b' || b || ':' || id", ats="'ashby'", company_id="'ashby:b' || b", company_slug="'b' || b", title="'Role ' || id",
                first_seen=f"TIMESTAMP'{T0}'", last_seen=f"TIMESTAMP'{T0}'", is_open="true", text_length="3", content_hash="'x'")


def texts(spark, **kw):
    return postings(spark, **kw).select("id", F.lit("old").alias("text"))


def snap(spark, rows):
    """Rows are (board, native id, text or None if unread)."""
    df = spark.createDataFrame([(b, n, t, t is not None) for b, n, t in rows], "b string, n string, t string, r boolean")
    return fill(df, SNAPSHOT, id="'ashby:' || b || ':' || n", ats="'ashby'", company_slug="b", native_id="n", title="'New ' || n", description_text="t", has_text="r", has_place="false", url="'u'")


def boards(spark, outcomes):
    return fill(spark.createDataFrame(list(outcomes.items()), "b string, o string"), BOARDS, ats="'ashby'", slug="b", outcome="o")


@pytest.fixture
def corpus(spark, tmp_path):
    c = Corpus(spark, str(tmp_path), parts=6)
    c.load(postings(spark), texts(spark))
    return c


def test_sweep_reads_and_writes_the_parts_of_its_boards(spark, corpus):
    before = corpus.store.pieces()
    swept = corpus.sweep(snap(spark, [("b3", "3", "new"), ("b3", "900", None)]), boards(spark, {"b3": "swept", "b4": "error"}), "2026-02-02 06:00:00", "2026-02-02")
    part = spark.range(1).select(part_of(F.lit("ashby:b3"), 6)).first()[0]
    assert swept.parts == [part] and swept.rows_read == sum(p.rows for p in before if p.name == "postings" and p.part == part)
    after = corpus.store.pieces()
    kept = {p.folder for p in before} & {p.folder for p in after}
    assert kept == {p.folder for p in before if not (p.name == "postings" and p.part == part)}  # texts included
    read = {f for f in corpus.store.read("postings", 1, swept.parts).inputFiles()}
    assert all(f"_part={part}/" in f for f in read)
    rows = {r["id"]: r for r in corpus.postings().collect()}
    assert len(rows) == 61 and rows["ashby:b3:3"]["title"] == "New 3" and not rows["ashby:b3:23"]["is_open"] and rows["ashby:b4:4"]["title"] == "Role 4"
    assert {(r["id"], r["event"]) for r in corpus.events().collect()} == {
        ("ashby:b3:3", "changed"), ("ashby:b3:900", "appeared"), ("ashby:b3:23", "disappeared"), ("ashby:b3:43", "disappeared")}
    assert [p.rows for p in swept.added if p.name == "posting_text"] == [1]
    assert corpus.postings(1).where("title like 'New%'").isEmpty() and corpus.text(1).where("text = 'new'").isEmpty()


def test_unchanged_and_dead_boards_meet_no_join_but_follow_their_outcome(spark, corpus):
    corpus.sweep(snap(spark, []), boards(spark, {"b1": "unchanged", "b2": "dead"}), "2026-02-02 06:00:00", "2026-02-02")
    rows = {r["id"]: r for r in corpus.postings().collect()}
    assert rows["ashby:b1:1"]["last_seen"].day == 2 and rows["ashby:b2:2"]["last_seen"].day == 1 and not rows["ashby:b2:2"]["is_open"] and rows["ashby:b5:5"]["is_open"]
    assert corpus.events().isEmpty() and len(rows) == 60


def test_empty_sweep_and_empty_corpus(spark, corpus, tmp_path):
    pieces = corpus.store.pieces()
    swept = corpus.sweep(snap(spark, []), boards(spark, {}), "2026-02-02 06:00:00", "2026-02-02")
    assert swept.parts == [] and swept.rows_read == 0 and corpus.store.pieces() == pieces
    none = Corpus(spark, str(tmp_path / "other"), parts=4)
    assert none.store.version() == 0 and none.postings().isEmpty() and none.text().isEmpty() and none.compact_text() == 0
    none.sweep(snap(spark, [("b1", "1", "first")]), boards(spark, {"b1": "swept"}), "2026-02-02 06:00:00", "2026-02-02")
    assert [r["text"] for r in none.text().collect()] == ["first"] and none.postings().count() == 1


def test_text_deltas_and_compaction(spark, corpus, monkeypatch):
    monkeypatch.setattr(plan, "SHARE", 0.1)
    one = boards(spark, {"b3": "swept"})
    for k, text in enumerate(["a", "b", "", "d"]):
        corpus.sweep(snap(spark, [("b3", "3", text), ("b3", "23", None)]), one, f"2026-02-0{k + 2} 06:00:00", f"2026-02-0{k + 2}")
    newest = {r["id"]: r["text"] for r in corpus.text().collect()}
    assert newest["ashby:b3:3"] == "d" and newest["ashby:b3:23"] == "old" and len(newest) == 60
    part = spark.range(1).select(part_of(F.lit("ashby:b3"), 6)).first()[0]
    assert corpus.crowded() == [part]  # four later rows beside the rows of a few boards
    before = corpus.store.pieces("posting_text")
    version = corpus.compact_text()
    after = corpus.store.pieces("posting_text")
    assert {p.folder for p in before if p.part != part} == {p.folder for p in after if p.part != part}
    assert len([p for p in after if p.part == part]) == 1 and {r["id"]: r["text"] for r in corpus.text().collect()} == newest
    assert {r["id"]: r["text"] for r in corpus.text(version - 1).collect()} == newest and corpus.compact_text() == version


def test_store_publishes_whole_versions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), {"t": "k string, v int"})
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v int")
    first = store.write("t", rows, part_of(F.col("k"), 5))
    assert store.version() == 0 and store.read("t").isEmpty()  # written, not published
    assert store.publish([], first) == 1 and sum(p.rows for p in first) == 50
    assert store.write("t", rows.limit(0), part_of(F.col("k"), 5)) == []
    spark.range(1).write.parquet(str(tmp_path / "_versions" / "v=2"))  # left by a writer that died before it published
    second = store.write("t", rows.where("v < 3").withColumn("v", F.col("v") + 100), F.lit(0), 7)
    store.publish(first[1:], second)
    assert store.read("t").count() == first[0].rows + 3 and store.read("t", 1).count() == 50
    assert sorted(r["v"] for r in store.read("t", pieces=second).collect()) == [100, 101, 102]


# -- token store --------------------------------------------------------------------------------------

def bodies(spark, rows):
    return spark.createDataFrame([(i, "Role", "Acme", b) for i, b in rows], "id string, title string, company string, body string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_segments_follow_changes(spark, tmp_path):
    store = TokenStore(spark, str(tmp_path), parts=3)
    store.add(bodies(spark, [("a", "red fox"), ("b", "red hen"), ("c", None)]))
    assert ids(store.match(["red"])) == ["a", "b"] and ids(store.match(["red fox", "red hen"], "all")) == []
    store.add(bodies(spark, [("b", "blue hen"), ("d", "red red")]))
    assert ids(store.match(["red"])) == ["a", "d"] and ids(store.match(["blue hen"])) == ["b"] and ids(store.query("hen")) == ["b"]
    store.add(bodies(spark, []), spark.createDataFrame([("d",)], "id string"))
    assert ids(store.match(["red"])) == ["a"]
    store.add(bodies(spark, [("d", "red again")]))
    assert ids(store.match(["red"])) == ["a", "d"] and ids(store.match(["acme"], field="company")) == ["a", "b", "c", "d"]


def test_merges_by_size_and_untouched_files(spark, tmp_path):
    store = TokenStore(spark, str(tmp_path), parts=2)
    store.add(bodies(spark, [(f"big{i}", "word " * 40) for i in range(20)]))
    large = {p.folder for p in store.store.pieces("tokens")}
    for k in range(4):
        store.add(bodies(spark, [("x", f"small {k}"), (f"y{k}", "small")]))
    now = store.store.pieces("tokens")
    assert large < {p.folder for p in now} and len(store.segments()) == 2  # four small segments became one, the large one kept its files
    assert ids(store.match(["small"])) == ["x", "y0", "y1", "y2", "y3"] and ids(store.match(["small 2"])) == [] and ids(store.match(["small 3"])) == ["x"]
    small = store.store.read("tokens", pieces=[p for p in now if p.folder not in large])
    assert small.where("id = 'x' and field = 'body'").count() == 2  # void entries went
    assert all(p.sequence > 1 for p in store.store.pieces("marks"))
    store.merge(store.segments())
    assert store.store.pieces("marks") == [] and len(store.segments()) == 1 and ids(store.match(["small 3"])) == ["x"]


def test_terms_are_read_first(spark, tmp_path):
    store = TokenStore(spark, str(tmp_path), parts=8)
    store.add(bodies(spark, [("a", "apple apricot"), ("b", "apple to"), ("c", "banana tomato")]))
    assert {tuple(r) for r in store.terms(["app", "to", "zzz"]).collect()} == {("app", "apple", 2), ("to", "to", 1)}
    assert {(r["word"], r["postings"]) for r in store.rarity(["app", "ban", "zzz", "apr"], 3).collect()} == {("app", 2), ("ban", 1), ("zzz", 0), ("apr", 1)}
    part = spark.range(1).select(part_of(F.lit("banana"), 8)).first()[0]
    assert all(f"_part={part}/" in f for f in store.index(["banana"]).inputFiles())
    store.add(bodies(spark, [("a", "cherry")]))
    assert {(r["word"], r["postings"]) for r in store.rarity(["app", "cherry"], 3).collect()} == {("app", 1), ("cherry", 1)}  # void entries count for nothing
    assert ids(store.query("cherry")) == ["a"] and ids(store.query("")) == []


def test_empty_token_store(spark, tmp_path):
    store = TokenStore(spark, str(tmp_path))
    assert store.match(["x"]).isEmpty() and store.query("some text").isEmpty() and store.terms(["some"]).isEmpty()
    store.add(bodies(spark, []))
    assert store.match(["x"]).isEmpty() and textindex.match_terms(store.index(), ["x"]).isEmpty()


# -- many profiles ------------------------------------------------------------------------------------

def test_many_profiles_are_one_scan(spark, sf_dir):
    from jobtide.plans import many
    from jobtide.plans.search import search
    from jobtide.workloads import views
    from jobtide.workloads.q_snapshot import TEN

    view, texts = views.postings(spark, sf_dir), views.texts(spark, sf_dir)
    profiles = {name: profile for name, (profile, _) in TEN.items()}
    plain = many.totals(view, {n: p for n, p in profiles.items() if n not in ("words", "free", "without")})
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") <= 3  # documents for the view and for its open roles, labels: not once a profile
    stored = view.cache()
    assert many.totals(stored, profiles, texts)._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1
    found = {r["profile"]: (r["standing"], r["standing_aside"]) for r in many.totals(stored, profiles, texts).collect()}
    for name, p in profiles.items():
        row = search(stored, p, texts=texts).funnel.first()
        assert found[name] == (row["matched"], row["set_aside"]), name
    many_more = {f"p{i}": {"posted_within_days": i} for i in range(70)}
    assert many.totals(stored, many_more).count() == 70 and many.totals(stored, {}).count() == 0
    with pytest.raises(ValueError):
        many.totals(stored, {"x": {"text": "the"}})
    stored.unpersist()


# -- places read before -------------------------------------------------------------------------------

def test_place_memory(spark, tmp_path, monkeypatch):
    from jobtide.functions.gazetteer import Gazetteer
    from jobtide.operators.location import derive_location
    from jobtide.plans import places as module
    from jobtide.plans.places import PlaceMemory

    def rows(*given):
        return spark.createDataFrame([(str(i), t, p) for i, (t, p) in enumerate(given)], "id string, title string, location_raw string").selectExpr(
            "*", "cast(null as array<string>) as locations_all", "'' as city", "'' as region", "cast(null as string) as country")

    def facts(df):
        return sorted(map(str, df.collect()))

    one = rows(("Engineer - Paris", None), (None, None), ("Clerk", "Berlin, Germany"), (None, "Nowhereville"))
    memory = PlaceMemory(spark, str(tmp_path), parts=2)
    assert facts(derive_location(one, memory=memory)) == facts(derive_location(one)) and memory.parsed == {"fragments": 2, "titles": 1}
    assert facts(derive_location(one, memory=memory)) == facts(derive_location(one)) and memory.parsed == {"fragments": 2, "titles": 1}
    two = rows(("Clerk", "Berlin, Germany"), ("Engineer - Paris", ""), ("Nurse", "London, UK"))
    other = PlaceMemory(spark, str(tmp_path), parts=2)
    assert facts(derive_location(two, memory=other)) == facts(derive_location(two)) and other.parsed == {"fragments": 1, "titles": 0}
    # Other place tables: what was read with the old ones does not count, and comes back with them.
    places = Gazetteer(extra_cities={"nowhereville": "nyc"})
    new = PlaceMemory(spark, str(tmp_path), places, parts=2)
    found = {r["id"]: r["d_metros"] for r in derive_location(one, places, new).collect()}
    assert found["3"] == ["nyc"] and new.parsed["fragments"] == 2
    monkeypatch.setattr(module, "PIECES", 2)
    memory.fragments(spark.createDataFrame([("Town",), ("Lisbon",), (None,), ("Lisbon",)], "fragment string"))
    pieces = memory.store.pieces("fragments")
    assert max(sum(p.part == part for p in pieces) for part in (0, 1)) <= 2 and memory.parsed == {"fragments": 4, "titles": 1}
    assert memory.fragments(spark.createDataFrame([], "fragment string")).count() == 5  # Berlin, Nowhereville, London, Town, Lisbon


# -- what a large corpus moves --------------------------------------------------------------------------

def test_a_sweep_stores_merged_rows_once_and_no_joined_ones(spark, corpus, tmp_path):
    from pathlib import Path

    from jobtide.session import checkpoint_root

    stages = lambda: {p.name for p in Path(checkpoint_root(spark), "jobtide").glob("*") if p.name.startswith(("joined-", "events-"))}
    before = stages()
    swept = corpus.sweep(snap(spark, [("b3", "3", "new"), ("b3", "900", None)]), boards(spark, {"b3": "swept"}), "2026-02-02 06:00:00", "2026-02-02")
    assert stages() == before
    assert sorted((r["id"], r["event"]) for r in swept.events.collect()) == sorted((r["id"], r["event"]) for r in corpus.events().collect())
    assert len(corpus.events().collect()) == 4 and "_events" not in corpus.postings().columns
    assert swept.joined.where("n is not null").count() == 2


def test_wide_rows_are_dealt_before_they_are_sorted(spark):
    from jobtide.operators.snapshot import latest_text, read_texts

    listings = snap(spark, [("b3", "3", "new"), ("b3", "3", "newer")])
    deltas = listings.select("id", F.col("description_text").alias("text"), F.lit(1).alias("sweep"))
    for df in (read_texts(listings, boards(spark, {"b3": "swept"})), latest_text(deltas.select("id", "text").limit(0), deltas)):
        plan = df._jdf.queryExecution().sparkPlan().toString().split("\n")
        sorts = [i for i, line in enumerate(plan) if "SortAggregate" in line or "ObjectHashAggregate" in line]
        deals = [i for i, line in enumerate(plan) if "REPARTITION_BY_COL" in line]
        assert sorts and deals and max(sorts) < max(deals)  # below every such aggregate the rows are dealt


def test_texts_that_name_their_board_are_not_joined(spark, tmp_path):
    c = Corpus(spark, str(tmp_path), parts=3)
    c.load(postings(spark).limit(0), texts(spark).withColumn("company_id", F.substring_index("id", ":", 2)))
    assert c.text().count() == 60


def test_entries_hold_what_the_index_holds(spark, tmp_path, monkeypatch):
    texts = bodies(spark, [("a", "red fox, red Élan"), ("b", " red "), ("c", None), ("d", "")])
    rows = lambda df: sorted((r["token"], r["field"], r["id"], r["pos"]) for r in df.collect())
    for words in (1 << 20, 3):
        monkeypatch.setattr(textindex, "WORDS_AT_ONCE", words)
        entries = textindex.build_entries(texts)
        assert rows(entries.select("token", "field", "id", F.explode("places").alias("pos"))) == rows(textindex.build_token_index(texts))
        assert {(r["id"], r["token"], r["field"]) for r in entries.where("not first").collect()} == set()
    both = textindex.build_entries(spark.createDataFrame([("a", "red", "Acme", "red hen")], "id string, title string, company string, body string"))
    assert both.where("token = 'red'").count() == 2 and both.where("token = 'red' and first").count() == 1
    store = TokenStore(spark, str(tmp_path), parts=2)
    store.add(bodies(spark, [("a", "red red red"), ("a", "red hen")]))  # an id given twice is one posting
    assert store.store.read("tokens").where("token = 'red'").count() == 2 and rows(store.index(["red"]).where("token = 'red'")) == [("red", "body", "a", 0)] * 2 + [("red", "body", "a", 1), ("red", "body", "a", 2)]
    assert {tuple(r) for r in store.terms(["red"]).collect()} == {("red", "red", 1)}


def test_entries_know_their_part(spark, monkeypatch):
    """The part of a token is found once a run, as ``part_of`` finds it; runs are sorted by part and token, and words are cut where Java cuts them."""
    texts = bodies(spark, [("a", "Red (fox)  hen-fox_fox \u00e9t\u00e9 \u0663\u4e2d\u6587 \u03a3\u03a3 c++ 3.5"), ("b", "--red"), ("c", "  "), ("d", ""), ("e", None), ("f", "a\u0301 b\u00a0c\U0001d11e\U00010400 \u00df")]).coalesce(1)
    rows = lambda df: sorted((r["token"], r["field"], r["id"], r["pos"]) for r in df.collect())
    for words in (1 << 20, 1):
        monkeypatch.setattr(textindex, "WORDS_AT_ONCE", words)
        entries = textindex.build_entries(texts, parts=5)
        assert rows(entries.select("token", "field", "id", F.explode("places").alias("pos"))) == rows(textindex.build_token_index(texts))
        assert entries.where(F.col("part") != part_of(F.col("token"), 5)).isEmpty() and entries.select("part").distinct().count() > 1
    monkeypatch.undo()
    run = [(r["part"], r["token"]) for r in textindex.build_entries(texts, parts=5).collect()]
    assert run == sorted(run, key=lambda x: (x[0], x[1].encode()))


def test_votes_are_dealt_before_they_are_counted(spark):
    index = textindex.build_token_index(bodies(spark, [("a", "red fox"), ("b", "red hen fox")]))
    found = textindex.match_terms(index, ["red fox", "hen"])
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].split("\n")
    counts, deals = [[i for i, line in enumerate(plan) if word in line] for word in ("HashAggregate", "REPARTITION_BY_COL")]
    assert counts and deals and max(counts) < min(deals) and sum("Exchange" in line for line in plan) == 1
    assert ids(found) == ["a", "b"]
