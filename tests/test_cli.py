import json

from lorekeep import cli


def call(spark, store, *words):
    return cli.run(spark, cli.parser().parse_args(["--store", store, "--as-of", "2025-01-01", *words]))


def test_verbs(spark, tmp_path):
    store, out = str(tmp_path / "s"), str(tmp_path / "out.json")
    assert json.loads(call(spark, store, "learn", "Always use bun instead of npm", "--project", "p")) == {"added": 1, "merged": 0, "skipped": 0}
    assert json.loads(call(spark, store, "status"))["total"] == 1 and all(json.loads(call(spark, store, "health")).values())
    assert json.loads(call(spark, store, "search", "bun"))["score"] == 20.0
    assert call(spark, store, "conflicts") == ""
    assert "- **[Trick]** Always use bun instead of npm (score: 50, recalled 0x)" in call(spark, store, "export", "--format", "markdown")
    call(spark, store, "export", "--output", out)
    assert json.loads(open(out).read())["bullet_count"] == 1
    call(spark, store, "clear")
    assert json.loads(call(spark, store, "import", out)) == {"added": 1, "merged": 0, "skipped": 0}
    assert json.loads(call(spark, store, "projects"))["n"] == 1
    assert json.loads(call(spark, store, "decay")) == {"updated": 0, "archived": 0}
    assert call(spark, store, "promote", "p", "--min-score", "1") == ""
    settings = str(tmp_path / "c.json")
    assert json.loads(cli.run(spark, cli.parser().parse_args(["--store", store, "--settings", settings, "config", "search.max_results", "9"]))) == 9
    assert json.loads(open(settings).read())["search"]["max_results"] == 9
