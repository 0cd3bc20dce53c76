import json

import pytest
from pyspark.sql import functions as F

from loreforge.operators import digest, events, store
from loreforge.sources import files


@pytest.fixture(scope="module")
def lessons(spark):
    rows = [(1, "testing", '["a"]', "one", "s1", "p", "info", None), (2, "testing", "b, c", "two", "s2", "q", "critical", 1), (3, "seo", None, "three\nlines | \\ 🧠", None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, category string, tags string, content string, source string, project string, severity string, repeats long")
    stamp = F.lit("2024-01-01").cast("timestamp")
    return store.migrate(df.withColumn("created_at", stamp).withColumn("updated_at", stamp))


def test_migrate_twice_changes_nothing(lessons):
    again = store.migrate(lessons)
    assert again.columns == lessons.columns and again.collect() == lessons.collect()
    assert {r["scope"] for r in again.collect()} == {"project"}


def test_forget_and_restore(spark, lessons):
    empty = lessons.limit(0).withColumn("archived_at", F.current_timestamp()).withColumn("reason", F.lit("x"))
    ids = spark.createDataFrame([(2,)], "id long")
    assert store.forget(lessons, empty, ids)[0].count() == 3
    left, arch = store.forget(lessons, empty, ids, "old", confirm=True)
    assert {r["id"] for r in left.collect()} == {1, 3} and arch.first()["reason"] == "old"
    back, none = store.restore(left, arch, ids, confirm=True)
    assert sorted(map(str, back.select(lessons.columns).collect())) == sorted(map(str, lessons.collect())) and none.count() == 0


def test_learn_and_problems(spark, lessons):
    new = spark.createDataFrame([("testing", "fresh", ["x"], "p", None, None, None, None), ("nope", "bad", None, None, None, None, None, None)], "category string, content string, tags array<string>, project string, severity string, scope string, repeats long, source string")
    assert [r["problem"] for r in store.problems(new).collect()] == ["unknown category"]
    after = store.learn(lessons, new.filter("category = 'testing'"))
    row = after.filter("content = 'fresh'").first()
    assert row["id"] > 3 and row["severity"] == "info" and row["scope"] == "project" and after.count() == 4
    with pytest.raises(ValueError):
        store.check_limit(0)


def test_rescope_needs_ids(lessons):
    with pytest.raises(ValueError):
        store.rescope(lessons, [])
    assert {r["id"]: r["scope"] for r in store.rescope(lessons, [2]).collect()} == {1: "project", 2: "global", 3: "project"}


def test_export_and_import_again(spark, lessons, tmp_path):
    doc = files.export_document(lessons).first()["json"]
    (tmp_path / "x.json").write_text(doc)
    rows, _ = files.read_export(spark, str(tmp_path / "x.json"))
    assert {r["content"]: r["tags"] for r in rows.collect()} == {"one": ["a"], "two": ["b", "c"], "three\nlines | \\ 🧠": []}
    fresh, report = store.import_new(lessons, rows)
    assert fresh.count() == 0 and tuple(report.first()) == (0, 3)
    (tmp_path / "cut.json").write_text(doc[:50])
    assert files.read_export(spark, str(tmp_path / "cut.json"))[0].count() == 0
    (tmp_path / "other.json").write_text(json.dumps({"hello": 1}))
    assert files.read_export(spark, str(tmp_path / "other.json"))[0].count() == 0
    files.write_lines(lessons, str(tmp_path / "lines"))
    assert files.read_lines(spark, str(tmp_path / "lines")).count() == 3


def test_paths_stay_inside(tmp_path):
    (tmp_path / "sub").mkdir()
    assert files.confined("sub/a.json", str(tmp_path)) and files.confined("a.json", str(tmp_path))
    for bad in ("../a.json", "/etc/passwd", "none/a.json", "store.db"):
        assert files.confined(bad, str(tmp_path)) is None


def test_notes(spark, tmp_path):
    d = tmp_path / "p" / "memory"
    d.mkdir(parents=True)
    (d / "a.md").write_text("---\nname: A note\ndescription: \"about\"\nmetadata:\n  type: feedback\n---\n\nThe body.\n")
    (d / "b.md").write_text("no front matter")
    (d / "MEMORY.md").write_text("---\nname: index\n---\nx")
    assert [tuple(r)[1:] for r in files.read_notes(spark, str(tmp_path)).collect()] == [("A note", "about", "feedback", "The body.")]


def test_projects(spark, tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "package.json").write_text('{"dependencies": {"react": "1"}, "devDependencies": {"typescript": "5"}}')
    (tmp_path / "app" / "README.md").write_text("# App\n")
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "package.json").write_text("{" + " " * (1 << 20) + "}")
    (tmp_path / "link").symlink_to(tmp_path / "app")
    got = {r["name"]: r["stack"] for r in files.scan_projects(spark, str(tmp_path)).collect()}
    assert got == {"app": ["node", "react", "typescript"], "big": []}


def test_incident_journal(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"ts": 1, "kind": "retry", "count": 2, "cmd": "x"}\nbroken\n{"ts": 2, "kind": "revert", "cmd": "y"}\n')
    assert [r["kind"] for r in files.read_incidents(spark, str(tmp_path / "j.jsonl")).orderBy("ts").collect()] == ["retry", "revert"]


UNDONE = [
    ("git checkout -- a.py", "git-checkout-file"), ("cd x && git restore .", "git-restore"), ("FOO=1 sudo git reset --hard", "git-reset-hard"), ("git clean -fd", "git-clean"),
    ("git commit -q --amend", "git-amend"), ("git stash drop", "git-stash-drop"), ("cp conf.bak conf", "restore-backup"), ("mv a.orig ./b; ls", "restore-backup"), ("git rebase --abort", "rebase-abort"),
    ("git checkout HEAD -- a b", "git-checkout-file"), ("git checkout --ours x", "git-checkout-file"), ("make || git revert abc", "git-revert"), ("time nohup env A=1 B=2 git restore x", "git-restore"),
    ("cat <<EOF | sh\nnothing\nEOF\ngit reset --hard", "git-reset-hard"), ("sudo /bin/cp -a x.backup.1 y z", "restore-backup"), ("cp a.bak 'b'", "restore-backup"), ("git restore x && git clean -f", "git-restore"),
    ("cp $(ls | head) a.bak b", "restore-backup"), ("install -m 600 conf.orig /etc/conf", "restore-backup"), ("  git   stash   clear", "git-stash-drop"),
]
KEPT = [
    "git status", "echo 'git checkout -- x'", "cp conf conf.bak", "cp conf.json conf.bak-$(date +%s) && ls", "cp /tmp/k.bak /tmp/k.php", "git checkout main", "python - <<'PY'\ngit restore x\nPY", "", None,
    "cp a.bak", "cp -r a.bak", "cp a.bak '/tmp/x'", "rsync a.bak /private/tmp/x", "xcp a.bak b", "echo git restore", "sudo", "FOO=1", "git clean -n", "python <<X\ngit revert a", "cp a b.orig; ls", "mygit restore x",
    "x" * 400 + "; git restore y", "legit=1 ls",
]


def test_undone_commands(spark):
    rows = UNDONE + [(c, None) for c in KEPT]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(rows)], "i int, command string").select("i", events.undo(F.col("command")).alias("label"))
    assert [(rows[i][0], label) for i, label in sorted(map(tuple, got.collect()))] == rows


def test_incidents(spark):
    rows = [("s", 1, 1, "failure", "make  x"), ("s", 2, 2, "failure", "make x"), ("s", 3, 3, "failure", "make x"), ("t", 1, 1, "failure", "make x"), ("s", 4, 4, "run", "git restore a"), ("s", 5, 5, "run", None)]
    df = spark.createDataFrame(rows, "session_id string, ts int, seq int, event string, command string")
    got = events.incidents(df)
    assert {(r["session_id"], r["kind"], r["label"], r["count"]) for r in got.collect()} == {("s", "retry", None, 2), ("s", "retry", None, 3), ("s", "revert", "git-restore", None)}
    d = events.incident_digest(got, most=2).first()
    assert d["n"] == 3 and d["digest"].endswith("…and 1 more")


def test_stop_gate(spark):
    t = ["2024-01-01 00:00:00", "2024-01-01 00:10:00"]
    rows = [("ask", False, False, *t, 3, 3), ("goes on", True, False, *t, 3, 3), ("asked", False, True, *t, 3, 3), ("short", False, False, t[0], "2024-01-01 00:01:00", 3, 3), ("wrote", False, False, *t, 3, 4), ("unknown", None, None, None, t[1], None, 3)]
    df = spark.createDataFrame(rows, "session_id string, continuing boolean, asked boolean, started string, stopped string, lessons_before int, lessons_now int")
    df = df.withColumn("started", F.col("started").cast("timestamp")).withColumn("stopped", F.col("stopped").cast("timestamp"))
    assert [r["session_id"] for r in events.stop_gate(df).filter("ask").collect()] == ["ask"]


def test_scope_candidates(spark, lessons):
    rows = [(1, "use bash and git", "app", "project"), (2, "git rebase in the web-shop", "app", "project"), (3, "only git", None, None), (4, "docker and npm", None, "global")]
    les = spark.createDataFrame(rows, "id long, content string, project string, scope string").withColumn("severity", F.lit("info"))
    names = spark.createDataFrame([("web-shop",)], "name string")
    assert [(r["id"], r["matched"]) for r in digest.scope_candidates(les, names).collect()] == [(1, ["bash", "git"])]
