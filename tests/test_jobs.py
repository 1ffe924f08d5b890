"""Whole runs over a growing folder."""

from functools import partial

import pytest
from helpers import values

from contactmine.operators.sightings import current
from contactmine.plans import jobs, variants
from contactmine.sinks.commits import Commits


def lines(spark, path):
    return values(spark.read.text(str(path)))


ADVANCED = partial(variants.advanced_candidates, disposable=["mailinator.com"], blocked=["web.com"])
BOUNDED = partial(variants.bounded_candidates, disposable=[], blocked=["*.web.com"])


@pytest.mark.parametrize("find", [ADVANCED, BOUNDED, partial(variants.service, mode="all", rules=["com", "org"])])
def test_runs_add_up(spark, tmp_path, find):
    root, out = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    (root / "a.txt").write_text("joe@shop.com http://a.org/1 a@mailinator.com http://x.web.com/")
    (root / "bad.docx").write_bytes(b"no zip")
    jobs.run(spark, str(root), str(out), find)
    first = lines(spark, out / "emails"), lines(spark, out / "urls")
    jobs.run(spark, str(root), str(out), find)
    assert (lines(spark, out / "emails"), lines(spark, out / "urls")) == first

    (root / "b.txt").write_text("joe@shop.com jane@shop.com http://b.org/2")
    jobs.run(spark, str(root), str(out), find)
    assert lines(spark, out / "emails") == sorted([*first[0], "jane@shop.com"])
    assert len(lines(spark, out / "urls")) == len(first[1]) + 1
    ledger = values(spark.read.parquet(str(out / "ledger")), "path")
    assert [p.rsplit("/", 1)[1] for p in ledger] == ["a.txt", "b.txt", "bad.docx"]
    assert spark.read.parquet(str(out / "bad_sources")).count() == 1
    if find is ADVANCED:
        assert "a@mailinator.com" not in first[0] and first[1] == ["http://a.org/1"]
        summary = {(r.kind, r.reason): r.n_values for r in spark.read.json(str(out / "summary")).collect()}
        assert summary == {("email", "kept"): 2, ("url", "kept"): 1}
    if find is BOUNDED:
        provenance = {r.value: r.source for r in spark.read.csv(str(out / "provenance"), schema="value string, source string").collect()}
        assert provenance["jane@shop.com"].endswith("b.txt") and provenance["joe@shop.com"].endswith("a.txt")


@pytest.mark.parametrize("files", [20_000, 1])
def test_each_file_is_opened_once(spark, tmp_path, monkeypatch, files):
    monkeypatch.setattr(jobs, "PASS_FILES", files)
    root, out, log = tmp_path / "in", tmp_path / "out", tmp_path / "opened"
    root.mkdir()

    def reader(content):
        with open(log, "ab") as file:
            file.write(content + b"\n")
        return content.decode()

    for i in range(3):
        (root / f"a {i}.bin").write_text(f"a{i}@x.com http://x.com/{i}")
    (root / "b[1].txt").write_text("b@x.com")
    for run, expected in enumerate((3, 3, 4)):
        if run == 2:
            (root / "a 3.bin").write_text("a3@x.com http://x.com/3")
        jobs.run(spark, str(root), str(out), BOUNDED, readers={".bin": reader})
        assert len(log.read_text().split()) == 2 * expected
    assert lines(spark, out / "emails") == ["a0@x.com", "a1@x.com", "a2@x.com", "a3@x.com", "b@x.com"]
    assert lines(spark, out / "urls") == ["http://x.com/0"]  # one a host, over all runs


def test_files_without_reader_wait_for_one(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    (root / "a.txt").write_text("joe@shop.com")
    (root / "b.pdf").write_bytes(b"jane@shop.com")
    for _ in range(2):
        jobs.run(spark, str(root), str(out), ADVANCED)
        assert lines(spark, out / "emails") == ["joe@shop.com"]
        errors = values(spark.read.parquet(str(out / "bad_sources")), "error")
        assert errors == ["no reader for .pdf"]
    jobs.run(spark, str(root), str(out), ADVANCED, readers={".pdf": bytes.decode})
    assert lines(spark, out / "emails") == ["jane@shop.com", "joe@shop.com"]
    ledger = values(spark.read.parquet(str(out / "ledger")), "path")
    assert [p.rsplit("/", 1)[1] for p in ledger] == ["a.txt", "b.pdf"]


PROVENANCE = "value string, source string"


def outputs(spark, out):
    """All lines of all tables, as any reader of the folders finds them."""
    read = {"emails": spark.read.text, "urls": spark.read.text, "provenance": partial(spark.read.csv, schema=PROVENANCE)}
    read |= dict.fromkeys(("ledger", "bad_sources"), spark.read.parquet)
    names = {table: sorted(tuple(x.rsplit("/", 1)[-1] for x in row[:-1]) for row in open_(f"{out}/{table}").collect()) for table, open_ in read.items()}
    seen = current(Commits(spark, str(out))).select("kind", "key", "value", "reason", "source_id").collect()
    return names | {"sightings": sorted((*r[:4], r[4].rsplit("/", 1)[-1]) for r in seen)}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for i in range(3):
        (root / f"t{i}.txt").write_text(f"joe@shop.com new{i}@shop.com http://a.org/{i}\nhttp://h{i}.org/")
        (root / f"m{i}.eml").write_text(f"Subject: x\n\nhello joe@shop.com m{i}@b.org http://a.org/m{i}")
    (root / "bad.docx").write_bytes(b"no zip")
    (root / "c.pdf").write_bytes(b"unread")
    return root


@pytest.mark.parametrize("last", [2, 7, 9])
def test_killed_runs_leave_no_line_twice(spark, tree, tmp_path, monkeypatch, last):
    jobs.run(spark, str(tree), str(tmp_path / "whole"), BOUNDED)
    writes = []

    def dies(self, batch, tables, frames):
        for table, save in tables.items():
            save(frames[table].write.mode("overwrite"), self.path(table, batch))
            writes.append(table)
            if len(writes) == last:
                raise RuntimeError("killed")

    with monkeypatch.context() as killed:
        killed.setattr(Commits, "write", dies)
        with pytest.raises(Exception, match="killed"):
            jobs.run(spark, str(tree), str(tmp_path / "out"), BOUNDED)
    jobs.run(spark, str(tree), str(tmp_path / "out"), BOUNDED)
    assert outputs(spark, tmp_path / "out") == outputs(spark, tmp_path / "whole")


def test_first_sightings_do_not_depend_on_the_order_of_runs(spark, tree, tmp_path):
    late = tmp_path / "late"
    late.mkdir()
    files = sorted(tree.iterdir())
    seen = {}
    for name, order in {"one": [files], "up": [files[:4], files[4:]], "down": [files[4:], files[:4]]}.items():
        root = tmp_path / f"in-{name}"
        root.mkdir()
        for part in order:
            for file in part:
                (root / file.name).write_bytes(file.read_bytes())
            jobs.run(spark, str(root), str(tmp_path / name), BOUNDED)
        seen[name] = outputs(spark, tmp_path / name)
    assert seen["one"]["sightings"] == seen["up"]["sightings"] == seen["down"]["sightings"]
    assert seen["one"]["emails"] == seen["up"]["emails"] == seen["down"]["emails"]
    # a small run writes only the buckets that its keys fall into, replaced ones go
    (tmp_path / "in-one" / "z.txt").write_text("one.more@shop.com")
    jobs.run(spark, str(tmp_path / "in-one"), str(tmp_path / "one"), BOUNDED)
    commits = Commits(spark, str(tmp_path / "one"))
    assert len(commits.rows[commits.with_table("sightings")[-1]].buckets) == 1
    jobs.run(spark, str(tmp_path / "in-one"), str(tmp_path / "one"), BOUNDED)
    assert current(commits).count() == len(seen["one"]["sightings"]) + 1
    folders = [p.name for p in (tmp_path / "one" / "sightings").glob("*/bucket=*")]
    assert len(folders) == len(set(folders))


def test_export(spark, tree, tmp_path):
    jobs.run(spark, str(tree), str(tmp_path / "out"), ADVANCED)
    for _ in range(2):
        jobs.export(spark, str(tmp_path / "out"), ["com", "org"])
    assert lines(spark, tmp_path / "out" / "sorted_emails") == lines(spark, tmp_path / "out" / "emails")
    maps = {r.key: r.urls for r in spark.read.json(str(tmp_path / "out" / "mapping_json")).collect()}
    assert maps["a.org"] == sorted(f"http://a.org/{x}" for x in ("0", "1", "2", "m0", "m1", "m2"))
    found = {r.kind: (r.n_found, r.n_kept) for r in spark.read.json(str(tmp_path / "out" / "totals")).collect()}
    assert found["email"] == (7, 7)
