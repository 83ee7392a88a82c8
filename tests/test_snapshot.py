"""Merge rules day by day, unread text, idempotence, and one pass over many days."""

from pyspark.sql import functions as F

from jobtide.operators import snapshot, textindex
from jobtide.schemas import BOARDS, COMPANIES, EVENTS, POSTING_TEXT, POSTINGS_RAW, SNAPSHOT, columns
from jobtide.session import materialize
from jobtide.sources import sink, slug_lists


def rows(spark, ddl, *items):
    names = columns(ddl)
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in items], ddl)


def job(**kw):
    return {"id": "ashby:acme:1", "ats": "ashby", "company_slug": "acme", "native_id": "1", "title": "Engineer", "title_norm": "engineer", "location_raw": "Oslo",
            "locations_all": ["Oslo"], "has_text": True, "has_place": True, "description_text": "hello", **kw}


def run(spark, days, board=None):
    """Merge each day's snapshot; returns postings, text and (day, event) pairs."""
    current, text = rows(spark, POSTINGS_RAW), rows(spark, POSTING_TEXT)
    log = []
    board = board or {"ats": "ashby", "slug": "acme", "outcome": "swept"}
    for n, jobs in enumerate(days):
        day = f"2026-01-0{n + 1}"
        outcome = jobs if isinstance(jobs, dict) else {}
        jobs = [] if isinstance(jobs, dict) else jobs
        m = snapshot.merge_snapshot(current, text, rows(spark, SNAPSHOT, *jobs), rows(spark, BOARDS, {**board, **outcome}), f"{day} 06:00:00", day)
        log += [(n, r.event) for r in m.events.collect()]
        current, text = materialize(m.postings), materialize(m.text)
    return current, text, log


def test_event_sequence(spark):
    new = job()
    days = [[new], [new], [job(description_text=None, has_text=False)], [job(description_text=None)], [job(description_text="other")], [job(description_text="words")]]
    _, text, log = run(spark, days)
    assert log == [(0, "appeared"), (3, "changed"), (4, "changed")]
    assert text.first().text == "words"


def test_unread_text_is_kept(spark):
    current, text, _ = run(spark, [[job()], [job(description_text=None, has_text=False, location_raw=None, locations_all=None, has_place=False)]])
    assert text.first().text == "hello"
    row = current.first()
    assert row.location_raw == "Oslo" and row.locations_all == ["Oslo"] and row.text_length == 5


def test_close_reopen_and_change(spark):
    current, _, log = run(spark, [[job()], [], [job(title="Senior Engineer")]])
    assert sorted(log) == [(0, "appeared"), (1, "disappeared"), (2, "changed"), (2, "reappeared")]
    assert current.first().is_open and current.first().d_derived_at is None


def test_dead_unchanged_and_failed_boards(spark):
    current, _, log = run(spark, [[job()], {"outcome": "error"}, {"outcome": "unchanged"}])
    assert current.first().is_open and str(current.first().last_seen)[:10] == "2026-01-03"
    current, _, log = run(spark, [[job()], {"outcome": "dead"}])
    assert log == [(0, "appeared")] and not current.first().is_open


def test_merge_is_idempotent(spark):
    once, _, _ = run(spark, [[job()]])
    twice, _, log = run(spark, [[job()], [job()]])
    keep = [c for c in columns(POSTINGS_RAW) if c != "last_seen"]
    assert once.select(*keep).collect() == twice.select(*keep).collect() and log == [(0, "appeared")]


def test_replay_equals_daily_merges(spark):
    plan = {"a": "1101", "b": "0110", "c": "1011", "d": "1111"}
    hashes = {"a": "xxyy", "b": "xxyx", "c": "xyzx", "d": "xxxy"}
    days = []
    for n in range(4):
        days.append([job(id=f"ashby:acme:{k}", native_id=k, title=hashes[k][n]) for k in plan if plan[k][n] == "1"])
    _, _, log = run(spark, days)
    seen = spark.createDataFrame([(k, f"2026-01-0{n + 1}", hashes[k][n]) for k in plan for n in range(4) if plan[k][n] == "1"], "id string, day string, hash string")
    numbered = spark.createDataFrame([(f"2026-01-0{n + 1}", n) for n in range(4)], "day string, n int")
    replayed = [(int(r.day[-1]) - 1, r.event) for r in snapshot.replay_events(seen, numbered).collect()]
    assert sorted(replayed) == sorted(log)


def test_event_log_is_a_set(spark):
    log = spark.createDataFrame([("a", "2026-01-01", "changed")], "id string, day string, event string").selectExpr("id", "CAST(day AS DATE) AS day", "event")
    again = log.unionByName(log)
    assert snapshot.append_events(log, again).count() == 1
    assert snapshot.append_events(log.where("false"), again).count() == 1
    assert log.columns == columns(EVENTS)


def test_sectors_and_names(spark):
    c = rows(spark, COMPANIES, {"id": "a:x-co", "ats": "a", "slug": "x-co", "status": "live"}, {"id": "a:y", "ats": "a", "slug": "y", "name": "Y"})
    named, _ = snapshot.fill_company_names(c, rows(spark, POSTINGS_RAW))
    assert {r.slug: (r.name, r.name_source) for r in named.collect()} == {"x-co": ("X Co", "slug"), "y": ("Y", None)}


def test_versions_are_published_whole(spark, tmp_path):
    root = str(tmp_path / "corpus")
    one, two = spark.range(3).withColumn("ats", F.lit("lever")), spark.range(5).withColumn("ats", F.lit("lever"))
    sink.write_corpus({"postings": one}, root, "1")
    two.write.parquet(f"{root}/v=2/postings")  # written, never published
    assert sink.published_version(spark, root) == 1 and sink.read_table(spark, root, "postings").count() == 3
    sink.write_corpus({"postings": two}, root, "3")
    assert sink.read_table(spark, root, "postings").count() == 5


def test_token_index_on_disk(spark, tmp_path):
    texts = spark.createDataFrame([("a", "Big cat", "Acme", "the big red cat"), ("b", "Dog", "Acme", "a red big cat")], "id string, title string, company string, body string")
    path = str(tmp_path / "index")
    textindex.write_token_index(textindex.build_token_index(texts), path, 2)
    index = spark.read.parquet(path)
    assert [r.id for r in textindex.match_terms(index, ["big red"]).collect()] == ["a"]
    assert {r.id for r in textindex.match_terms(index, ["red", "cat"], "all").collect()} == {"a", "b"}
    assert {(r.id, r.text_field) for r in textindex.text_query(index, "big").collect()} == {("a", "title"), ("b", "body")}
    assert {(r.id, r.text_field) for r in textindex.text_query(index, "acm cat").collect()} == {("a", "body"), ("b", "body")}


def test_bad_csv_column(spark, tmp_path):
    path = str(tmp_path / "list")
    spark.createDataFrame([("a",)], "slug string").write.csv(path, header=True)
    assert slug_lists.read_csv_slugs(spark, path, {"column": 0}).count() == 1
    try:
        slug_lists.read_csv_slugs(spark, path, {"column": "nope"})
        raise AssertionError("an unknown column must be refused")
    except ValueError:
        pass


def test_last_listing_gives_row_and_text(spark):
    """A posting listed twice takes row and text from the same, last listing, whatever the partitions."""
    jobs = [job(id=f"ashby:acme:{i}", native_id=str(i), title=f"T{k}", description_text="x" * (10 + 7 * k + i % 3)) for i in range(60) for k in (0, 1)]
    current, text = rows(spark, POSTINGS_RAW), rows(spark, POSTING_TEXT)
    boards = rows(spark, BOARDS, {"ats": "ashby", "slug": "acme", "outcome": "swept"})
    frame = rows(spark, SNAPSHOT, *jobs)
    m = snapshot.merge_snapshot(current, text, frame.repartition(5), boards, "2026-01-01 06:00:00", "2026-01-01")
    both = m.postings.select("id", "text_length").join(m.text, "id", "full_outer").collect()
    assert len(both) == 60 and all(r.text_length == len(r.text) for r in both)
    placed = frame.withColumn("position", F.when(F.col("title") == "T0", 2).otherwise(1))
    m = snapshot.merge_snapshot(current, text, placed, boards, "2026-01-01 06:00:00", "2026-01-01")
    assert {r.title for r in m.postings.collect()} == {"T0"} and {len(r.text) for r in m.text.collect()} == {10, 11, 12}


def test_text_of_failed_boards_stays(spark):
    _, text, _ = run(spark, [[job()]])
    current, _, _ = run(spark, [[job()]])
    boards = rows(spark, BOARDS, {"ats": "ashby", "slug": "acme", "outcome": "error"})
    late = rows(spark, SNAPSHOT, job(description_text="partial"), job(id="ashby:acme:2", native_id="2"))
    m = snapshot.merge_snapshot(current, text, late, boards, "2026-01-02 06:00:00", "2026-01-02")
    assert [tuple(r) for r in m.text.collect()] == [("ashby:acme:1", "hello")] and m.postings.count() == 1
