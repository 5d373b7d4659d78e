import json

import pytest

from codeweave.functions import pages
from codeweave.operators import fanout, links, schema
from codeweave.plans import cli, planning
from codeweave.plans import pipeline as pl
from codeweave.plans import summaries
from codeweave.sources import artifacts
from codeweave.sources.client import CompletionError, Offline
from codeweave.sources.config import Config

from .test_graph import EDGES, MODULES, edges_frame


def docs(spark, **files):
    return spark.createDataFrame([(k, v) for k, v in files.items()], schema.DOCS)


def test_link_report(spark):
    tree = {"index.md": "[a](modules/a.md) [b](gone.md#x) [c](https://x) [d](#frag) ![i](img.png) [up](../out.md)", "modules/a.md": "[back](../index.md#top) [dir](../modules) [m](mailto:x@y)", "img.png": "[no](no.md)"}
    gone, totals = links.report(docs(spark, **tree))
    assert sorted((r["source_file"], r["link_target"], r["line"]) for r in gone.collect()) == [("index.md", "../out.md", 0), ("index.md", "gone.md#x", 0), ("modules/a.md", "mailto:x@y", 0)]
    assert totals.first().asDict() == {"total_files": 2, "total_links": 7, "broken": 3}
    gone, totals = links.report(docs(spark, **tree).limit(0))
    assert gone.count() == 0 and totals.first().asDict() == {"total_files": 0, "total_links": 0, "broken": 0}
    kinds = links.with_kind(links.broken(links.internal_links(docs(spark, **{"m/a.md": "[F](p/f.go#L3) [x](y.md)"})), docs(spark, a="").select("path")))
    assert {r["link_target"]: r["kind"] for r in kinds.collect()} == {"p/f.go#L3": "source_ref", "y.md": "link"}


def requests(spark, ids):
    return spark.createDataFrame([(i, "m", "", f"about {i}", 10, 0.0) for i in ids], schema.REQUESTS)


def test_fan_out_keeps_errors_as_rows(spark):
    client = Offline([("about helm", CompletionError("refused", 401))])
    got = fanout.run(requests(spark, ["bow", "helm", "oar"]), client, 0)
    rows = {r["module_id"]: r for r in got.collect()}
    assert rows["bow"]["content"] and rows["bow"]["error"] is None and rows["helm"]["content"] is None
    assert (rows["helm"]["error"]["status"], rows["helm"]["error"]["retryable"]) == (401, False)
    assert fanout.tally(got).first().asDict() == {"total": 3, "succeeded": 2, "failed": 1, "failed_ids": "helm"}
    with pytest.raises(fanout.FanOutError, match=r"1 of 3 modules failed: \[helm\]") as e:
        fanout.raise_failures(got)
    assert e.value.summary().split("\n") == ["2/3 modules documented", "Failed modules:", "  - helm: refused"]
    assert fanout.summary(2, []) == "2/2 modules documented"


def test_pages(spark):
    context = spark.createDataFrame([("logger", "Logs.", ["Logger"], [{"name": "New", "signature": "func New()", "ref": "l.go#L1"}, {"name": "Bare", "signature": "", "ref": ""}], ["l.go#L1"]), ("bare", "Only.", [], [], [])], schema.SHARED_CONTEXT)
    made = context.select("module_id", pages.shared_page(*[context[c] for c in context.columns]).alias("p"))
    got = {r["module_id"]: r["p"] for r in made.collect()}
    assert got["logger"] == "# logger\n\nLogs.\n\n## Key Types\n\n- `Logger`\n\n## Key Functions\n\n- `New`: `func New()` ([source](l.go#L1))\n- `Bare`\n\n## Source References\n\n- `l.go#L1`\n"
    assert got["bare"] == "# bare\n\nOnly.\n"
    modules = artifacts.modules_frame(spark, [{"id": "b"}, {"id": "a"}, {"id": "logger", "shared": True, "referenced_by": ["api", "auth"]}, {"id": "x", "shared": True}])
    depth = spark.createDataFrame([("a", 2), ("b", 1)], "node string, depth int")
    rows = ["| logger | shared | api, auth |", "| x | shared | - |", "| b | module | - |", "| a | module | - |"]
    assert pages.index_page(modules, depth) == pages.INDEX_HEAD + "\n".join(rows) + "\n"
    assert pages.index_page(modules).split("\n")[4:6] == ["| a | module | - |", "| b | module | - |"]
    site = pages.site_config(modules, "", "/tmp/shop/", "https://x/y")
    assert "title: 'shop'" in site and "pattern: 'https://x/y/edit/main/:path'" in site and "{ text: 'x', link: '/shared/x.md' }" in site and "link: '/modules/a.md'" in site
    assert "editLink" not in pages.site_config(modules, "T", "/r", "") and "$" not in site and "ignoreDeadLinks: true" in site


def test_summaries_see_direct_dependencies_only(spark):
    """rope is used by sail, sail by mast; mast is told of sail alone."""
    names = ("mast", "sail", "rope")
    modules = artifacts.modules_frame(spark, [{"id": i, "files": [f"{i}.go"], "shared": True, "owner": "shared_preprocessor"} for i in names])
    index = spark.createDataFrame([(f"{i}.go", "go", "h", [], [], []) for i in names], schema.FILE_INDEX)
    edges = edges_frame(spark, [("mast.go", "sail.go"), ("sail.go", "rope.go")])
    reply = lambda s: json.dumps({"summary": s, "key_functions": [{"name": "X", "signature": "", "ref": "claimed"}]})
    both = ("- rope: R\n- sail: S", CompletionError("told of all"))
    rules = [both, ("- sail: S", reply("M")), ("- rope: R", reply("S")), ('module "rope"', reply("R"))]
    got = summaries.summarise(modules, index, edges, Offline(rules), 3000, {"model": "m"})
    assert {r["module_id"]: r["summary"] for r in got.collect()} == {"mast": "M", "sail": "S", "rope": "R"}
    kept = spark.createDataFrame([("rope", "old", [], [], [])], schema.SHARED_CONTEXT)
    only = Offline([('module "rope"', CompletionError("asked again")), ('module "sail"', reply("new")), ('module "mast"', reply("new"))])
    touched = spark.createDataFrame([("sail",), ("mast",)], "module_id string")
    got = summaries.summarise(modules, index, edges, only, 3000, {}, affected=touched, existing=kept)
    assert {r["module_id"]: r["summary"] for r in got.collect()} == {"rope": "old", "sail": "new", "mast": "new"}
    with pytest.raises(fanout.FanOutError):
        summaries.summarise(modules, index, edges, Offline([("module", CompletionError("down"))]), 3000, {})


def test_computed_plan(spark):
    index = spark.createDataFrame([(p, "go", "h", [], [], []) for p in sorted({x for e in EDGES for x in e})], schema.FILE_INDEX)
    got = {r["id"]: r for r in planning.computed_plan(index, edges_frame(spark, EDGES), 3).collect()}
    assert got["clock"]["shared"] and got["clock"]["referenced_by"] == ["ticket", "timetable", "units"]
    assert not got["units"]["shared"] and got["units"]["depends_on_shared"] == ["clock"] and got["ticket"]["owner"] == "agent"


@pytest.fixture
def run(spark, ferry, tmp_path):
    c = Config(repo_path=str(ferry), output_dir=str(tmp_path / "docs"), artifacts_dir=str(tmp_path / "art"))
    c.analysis.shared_module_threshold = 2
    return pl.Run(spark, c, Offline(), computed_plan=True)


def read(run, *path):
    with open("/".join([run.config.output_dir, *path])) as f:
        return f.read()


def test_generate_then_update(run, ferry, tmp_path):
    (ferry / "broken.go").write_text("package x\nfunc B( {")
    report = run.generate()
    assert run.skipped == 1 and report["total_files"] == 6
    assert sorted(run.store.read_file_index().select("path").toPandas()["path"])[0] == "clock/tide.go"
    before = {n: (tmp_path / "art" / n).read_bytes() for n in ("file_index.json", "dep_graph.json")}
    assert "## Contents" in read(run, "modules", "ticket.md") and "# clock" in read(run, "shared", "clock.md")
    rows = read(run, "index.md").split("\n")[4:]
    assert rows[0].startswith("| clock | shared |") and rows[2].startswith("| timetable |")
    assert "'/shared/units.md'" in read(run, ".vitepress", "config.mts")

    # The same tree gives the same bytes; the stored plan and context are used again.
    run.analyse()
    assert before == {n: (tmp_path / "art" / n).read_bytes() for n in before}

    (ferry / "ticket/seat.go").write_text("package ticket\n\nfunc Take() {}\n")
    calm = [(f'module "{m}"', CompletionError("not affected", 401)) for m in ("timetable", "clock", "units")]
    run.client = Offline(calm)
    run.update(changed_files="ticket/seat.go")
    graph = json.loads((tmp_path / "art" / "dep_graph.json").read_text())
    assert graph["ticket/seat.go"] == [] and len(graph) == 8

    run.client = Offline([('module "ticket"', CompletionError("down", 500, True))])
    with pytest.raises(fanout.FanOutError, match="ticket"):
        run.update(changed_files="timetable/season.go")

    (tmp_path / "art" / "module_docs" / "ticket.md").unlink()
    with pytest.raises(pl.MissingDocument, match="ticket"):
        run.update(changed_files="README.md")


def test_update_without_an_index_builds_all(run):
    assert run.update(changed_files="x.go")["total_files"] == 6


def test_validate_reports_and_succeeds(run, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("[x](y.md)")
    got = run.validate()
    assert got["total_links"] == 1 and got["broken_links"] == [{"source_file": "a.md", "link_text": "x", "link_target": "y.md", "line": 0}]
    (tmp_path / "docs" / "a.md").write_text("none")
    run.validate()
    assert json.loads((tmp_path / "art" / "validation_report.json").read_text())["broken_links"] is None


def test_command_line(ferry, tmp_path, spark, monkeypatch, capsys):
    (tmp_path / "c.yaml").write_text(f"repo_path: {ferry}\noutput_dir: {tmp_path}/docs\nartifacts_dir: {tmp_path}/art\n")
    monkeypatch.setattr(cli.runtime, "session", lambda: spark)
    assert cli.main(["--config", str(tmp_path / "c.yaml"), "--offline", "plan"]) == 0
    assert cli.main(["--config", str(tmp_path / "c.yaml"), "--offline", "validate"]) == 0
    assert "0 of 0 links are broken in 0 files" in capsys.readouterr().out
    assert cli.main(["--config", str(tmp_path / "c.yaml"), "--offline", "--repo", str(tmp_path / "no"), "plan"]) == 1


def test_modules_of_the_fixture_are_valid(spark):
    assert [m["id"] for m in MODULES] == [r["id"] for r in artifacts.modules_frame(spark, MODULES).collect()]
