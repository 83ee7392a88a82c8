"""Lists read in splits give what one task gives."""

import csv
import json
import random

import pytest

from jobtide.sources import records, slug_lists


def value(rng):
    return rng.choice(["a,b", 'x"y', "[{", "}]", "é\\,", "plain", "", "line\nend", "\\", '\\"', "],["])


@pytest.fixture
def sized(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield size
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [97, 3000, 1 << 27])
def test_json_arrays(spark, sized, tmp_path, size):
    rng = random.Random(size)
    items = [rng.choice([value(rng), {"slug": value(rng), "deep": [1, {"a": [value(rng)]}]}, 12, None, True, [value(rng), 3], "s" * 300]) for _ in range(400)]
    (tmp_path / "a.json").write_text(json.dumps(items, ensure_ascii=False))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text(' [\n "one" ] \n')
    (tmp_path / "d.json").write_text("")
    sized(1 << 27)
    whole = sorted(r["candidate"] or "" for r in slug_lists.read_slug_source(spark, str(tmp_path), {"format": "json-array", "split": False}).collect())
    sized(size)
    found = sorted(r["candidate"] or "" for r in slug_lists.read_slug_source(spark, str(tmp_path), {"format": "json-array"}).collect())
    assert found == whole and len(found) == 401
    assert size > 3000 or spark.read.text(str(tmp_path), lineSep=",").rdd.getNumPartitions() > 3


@pytest.mark.parametrize("size", [97, 3000, 1 << 27])
def test_quoted_csv(spark, sized, tmp_path, size):
    rng = random.Random(size)
    rows = [[f"n{i}", rng.choice(['q "x", y', "two\nlines", "tri\r\nple\n\n", " plain ", "", "\n" * 200, '"']), str(i)] for i in range(400)]
    for name, part in (("a", rows[:399]), ("b", rows[399:]), ("c", [])):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            csv.writer(f).writerows([["name", "te xt", "n"], *part])
    (tmp_path / "d.csv").write_text("")
    sized(1 << 27)
    spec = {"format": "csv", "column": "te xt", "where": {"n": {"not": ["7", "8"]}}}
    whole = sorted(r["candidate"] or "" for r in slug_lists.read_slug_source(spark, str(tmp_path), spec | {"split": False}).collect())
    sized(size)
    found = sorted(r["candidate"] or "" for r in slug_lists.read_slug_source(spark, str(tmp_path), spec).collect())
    # The reader of whole files makes every line end inside a cell that of the file; splits leave it as written.
    assert [f.replace("\r\n", "\n") for f in found] == whole and len(found) == 398
    cells = sorted(tuple(r) for r in records.csv_records(spark, str(tmp_path), ["name", "te xt", "n"]).select("name", "n").collect())
    assert cells == sorted((a, c) for a, _, c in rows)


def test_open_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h\nx\n"never closed\nat all')
    assert [r["value"] for r in records.read_records(spark, str(tmp_path), records.Quotes).where("not first").orderBy("value").collect()] == ['"never closed\nat all', "x"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.json").write_text('["x", {"y": [1, 2')
    assert sorted(r["value"].strip() for r in records.read_records(spark, str(tmp_path / "b"), records.Brackets).collect()) == ['"x"', '{"y": [1, 2']


@pytest.mark.parametrize("size", [97, 1 << 27])
def test_one_array_in_many_files(spark, sized, tmp_path, size):
    """Files that follow each other hold one array; only the first begins it."""
    rng = random.Random(size)
    items = [rng.choice([value(rng), {"slug": value(rng), "deep": [1, {"a": [value(rng)]}]}, "s" * 300]) for _ in range(200)]
    cut = [json.dumps(x, ensure_ascii=False) for x in items]
    cut[0], cut[-1] = "[" + cut[0], cut[-1] + "]"
    for n in range(5):
        (tmp_path / f"part-{n}.txt").write_text("".join(c + "," for c in cut[40 * n:40 * n + 40]))
    sized(size)
    found = sorted(r["value"] for r in records.json_elements(spark, str(tmp_path), one=True).collect())
    assert found == sorted(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in items)
    assert records.read_records(spark, str(tmp_path), records.Brackets, one=True).where("first").count() == 1


@pytest.mark.parametrize("name", ["slug_list_json_split", "slug_list_csv_split"])
def test_no_task_writes_a_whole_list(spark, sf_dir, tmp_path, monkeypatch, name):
    """Where shuffled parts are not put together, each task writes its own."""
    from jobtide.workloads import QUERIES, q_sources
    seen, write = [], q_sources._list_file
    monkeypatch.setattr(q_sources, "_list_file", lambda *a, **o: seen.append(write(*a, **o)) or seen[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        QUERIES[name](spark, sf_dir).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r[0] for r in spark.read.text(seen[0]).selectExpr("input_file_name()").collect()}) > 1


def test_truncated_boards_read_paths_alone(spark):
    """Different paths of all pages count; the rows beside them are neither parsed nor kept."""
    from jobtide.sources import payloads
    pages = spark.range(200).selectExpr(
        "CASE WHEN id < 100 THEN 'full' ELSE 'same' END AS slug", "id % 100 AS page",
        "to_json(named_struct('jobPostings', transform(sequence(1, 20), i -> named_struct('title', 'T', 'externalPath', CASE WHEN id = 100 THEN '/j/1-1' ELSE '/j/' || id || '-' || i END)))) AS body")
    found = payloads.workday_truncated(pages)
    assert [r["slug"] for r in found.collect()] == ["full"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and "locationsText" not in plan


def test_spread_deals_rows_of_one_file(spark, sf_dir):
    """Without a setting of its own, a table is dealt over as many tasks as a shuffle has."""
    from jobtide.workloads.registry import spread, table
    kept = spark.conf.get("spark.jobtide.inputPartitions")
    spark.conf.unset("spark.jobtide.inputPartitions")
    try:
        assert spread(table(spark, sf_dir, "supplier")).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.jobtide.inputPartitions", kept)
