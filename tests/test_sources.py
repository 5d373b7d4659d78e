import io
import json
import os
import subprocess
import urllib.error

import pytest

from codeweave.operators import schema
from codeweave.plans import cli
from codeweave.sources import artifacts, client, config, tree


def test_tree_reads_hidden_files_and_applies_globs(spark, ferry):
    (ferry / ".hidden").mkdir()
    (ferry / ".hidden" / "_x.go").write_bytes(b"\xff\x00")
    (ferry / "vendor").mkdir()
    (ferry / "vendor" / "v.go").write_text("package v")
    (ferry / "a_test.go").write_text("package a")
    got = {r["path"]: bytes(r["content"]) for r in tree.read_tree(spark, str(ferry), ["*_test.go", "vendor/**", "[bad"]).collect()}
    assert got[".hidden/_x.go"] == b"\xff\x00" and "vendor/v.go" not in got and "a_test.go" not in got and len(got) == 11
    far = tree.read_tree(spark, f"file://{ferry}", ["*_test.go", "vendor/**", "[bad"])
    assert {r["path"]: bytes(r["content"]) for r in far.collect()} == got
    bare = tree.read_tree(spark, str(ferry), contents=False)
    assert bare.where("content is null").count() == 13


def test_an_empty_tree_has_no_rows(spark, tmp_path):
    assert tree.read_tree(spark, str(tmp_path)).count() == 0


def test_module_name(tmp_path):
    (tmp_path / "go.mod").write_text("// c\nmodule example.org/x // y\n")
    assert tree.module_name(str(tmp_path)) == "example.org/x"
    (tmp_path / "go.mod").write_text("go 1.22\n")
    with pytest.raises(ValueError):
        tree.module_name(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        tree.module_name(str(tmp_path / "none"))


def commit(root, message):
    env = os.environ | {"GIT_AUTHOR_NAME": "t", "GIT_AUTHOR_EMAIL": "t@t", "GIT_COMMITTER_NAME": "t", "GIT_COMMITTER_EMAIL": "t@t"}
    for args in (["add", "-A"], ["commit", "-q", "-m", message]):
        subprocess.run(["git", "-C", str(root), *args], check=True, env=env)


def test_revisions(spark, tmp_path):
    from codeweave.operators import changes

    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / "old.go").write_text("same")
    (tmp_path / "keep.go").write_text("same")
    commit(tmp_path, "one")
    first = changes.changed_files(*tree.revisions(spark, str(tmp_path)))
    assert [tuple(r) for r in first.collect()] == [("keep.go", "", "added"), ("old.go", "", "added")]
    (tmp_path / "old.go").rename(tmp_path / "new.go")
    (tmp_path / "keep.go").unlink()
    (tmp_path / "added.go").write_text("x")
    commit(tmp_path, "two")
    second = changes.changed_files(*tree.revisions(spark, str(tmp_path)))
    assert [tuple(r) for r in second.collect()] == [("added.go", "", "added"), ("keep.go", "", "deleted"), ("new.go", "old.go", "renamed")]
    with pytest.raises(tree.MissingRevision):
        tree.revisions(spark, str(tmp_path), head="nothing")
    body = "".join(f"line {i}\n" for i in range(20))
    (tmp_path / "new.go").write_text(body)
    commit(tmp_path, "three")
    (tmp_path / "new.go").unlink()
    (tmp_path / "far").mkdir()
    (tmp_path / "far" / "moved.go").write_text(body.replace("line 7\n", "another\n"))
    commit(tmp_path, "four")
    third = changes.changed_files(*tree.revisions(spark, str(tmp_path)))
    assert [tuple(r) for r in third.collect()] == [("far/moved.go", "new.go", "renamed")]


def test_artifacts_round_trip(spark, tmp_path):
    store = artifacts.Artifacts(spark, str(tmp_path / "art"))
    for read in (store.read_file_index, store.read_file_index_distributed, store.read_dep_graph, store.read_nav_plan, store.read_shared_context):
        with pytest.raises(artifacts.ArtifactNotFound):
            read()
    fn = {"name": "F", "signature": "func F()", "line_start": 1, "line_end": 2, "exported": True}
    rows = [("b.go", "go", "h", [fn], [], [{"path": "x", "internal": True, "resolved_path": "x.go"}]), ("a.go", "go", "g", [], [], [])]
    store.write_file_index(spark.createDataFrame(rows, schema.FILE_INDEX))
    text = (tmp_path / "art" / "file_index.json").read_text()
    assert list(json.loads(text)) == ["a.go", "b.go"] and "resolved_path" not in text and '"functions": []' in text and text.endswith("}\n")
    one = {r["path"]: r for r in store.read_file_index().collect()}
    two = {r["path"]: r for r in store.read_file_index_distributed().collect()}
    assert one == two and one["b.go"]["imports"][0]["resolved_path"] == ""
    store.write_dep_graph(spark.createDataFrame([("b", ["c"]), ("a", [])], "path string, deps array<string>"))
    nodes, edges = store.read_dep_graph()
    assert sorted(r[0] for r in nodes.collect()) == ["a", "b"] and [tuple(r) for r in edges.collect()] == [("b", "c")]
    store.write_nav_plan([{"id": "m", "files": ["f"], "shared": False, "owner": "agent", "depends_on_shared": [], "referenced_by": ["x"]}], "2024-01-01T00:00:00Z")
    stored = json.loads((tmp_path / "art" / "nav_plan.json").read_text())
    assert "depends_on_shared" not in stored["modules"][0] and stored["modules"][0]["referenced_by"] == ["x"]
    assert store.read_nav_plan().first()["depends_on_shared"] == []
    store.write_shared_context(spark.createDataFrame([("m", "s", ["T"], [{"name": "F", "signature": "", "ref": "r"}], ["r"])], schema.SHARED_CONTEXT))
    assert store.read_shared_context().first()["key_functions"][0]["ref"] == "r"
    with pytest.raises(json.JSONDecodeError):
        (tmp_path / "art" / "dep_graph.json").write_text("{")
        store.read_dep_graph()
    assert [p for p in os.listdir(tmp_path / "art") if p.endswith(".tmp")] == []


YAML = """# comment
repo_path: "{root}"   # here
llm:
  api_key_env: "SOME_KEY"
  agent_model: 'it''s'
  temperature: 0
  preprocessor_model: ""
  planner_model: p
analysis:
  exclude_patterns:
    - "*_test.go"
    - a/**
  languages: ["go", rust]
agent:
  concurrency: 8
cache:
  enabled: false
"""


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    path.write_text(YAML.format(root=tmp_path))
    with pytest.raises(config.ConfigError, match="SOME_KEY"):
        config.load(str(path))
    monkeypatch.setenv("SOME_KEY", "secret")
    c = config.load(str(path))
    assert (c.repo_path, c.llm.agent_model, c.llm.temperature, c.llm.preprocessor_model) == (str(tmp_path), "it's", 0.2, "p")
    assert c.analysis.exclude_patterns == ["*_test.go", "a/**"] and c.analysis.languages == ["go", "rust"]
    assert (c.agent.concurrency, c.agent.skeleton_max_tokens, c.cache.enabled, c.llm.api_key) == (8, 3000, False, "secret")
    assert "secret" not in repr(c) and config.problems(c) == []
    c.repo_path, c.agent.concurrency, c.analysis.shared_module_threshold, c.llm.api_key_env = str(path), 33, 0, ""
    assert len(config.problems(c)) == 4
    with pytest.raises(config.ConfigError, match="concurrency"):
        config.validate(c)


@pytest.mark.parametrize("bad", ["a b", "llm: 3", "agent:\n  concurrency: many", "cache:\n  enabled: 3", "- x", "llm:\n\tx: 1"])
def test_bad_config(tmp_path, bad):
    (tmp_path / "c.yaml").write_text(bad)
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "c.yaml"))
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "none.yaml"))


def test_overrides_come_after_the_checks(tmp_path):
    (tmp_path / "c.yaml").write_text(f"repo_path: {tmp_path}/none\n")
    args = cli.parser().parse_args(["--config", str(tmp_path / "c.yaml"), "--repo", str(tmp_path), "--offline", "validate"])
    with pytest.raises(config.ConfigError):
        cli.configured(args)
    (tmp_path / "c.yaml").write_text(f"repo_path: {tmp_path}\n")
    assert cli.configured(args).repo_path == str(tmp_path)
    assert cli.main(["--config", str(tmp_path / "c.yaml"), "plan"]) == 1


REQUEST = client.Request("hello", "m", max_tokens=5)


@pytest.mark.parametrize("script, calls, ok", [([500, "x"], 2, True), ([500] * 4, 4, False), ([401], 1, False), ([503, 429, 502], 3, False)])
def test_retries(script, calls, ok):
    inner = client.Scripted([x if isinstance(x, str) else client.CompletionError("e", x, x in client.RETRYABLE) for x in script])
    retrying = client.Retrying(inner, 3, sleep=lambda s: None)
    if ok:
        assert retrying.complete(REQUEST) == "x"
    else:
        with pytest.raises(client.CompletionError):
            retrying.complete(REQUEST)
    assert len(inner.requests) == calls


def test_backoff_and_classes():
    assert [client.backoff(i, lambda: 0.5) for i in (0, 1, 3, 4, 9)] == [2, 4, 16, 30, 30]
    assert client.backoff(0, lambda: 0) == pytest.approx(1.6) and client.backoff(9, lambda: 1) == pytest.approx(36)
    assert client.classify(TimeoutError("t")).retryable and client.classify(urllib.error.URLError(TimeoutError())).retryable
    assert not client.classify(ValueError("v")).retryable
    for status in (400, 401, 429, 500, 502, 503, 504):
        got = client.classify(urllib.error.HTTPError("u", status, "m", {}, None))
        assert (got.status, got.retryable) == (status, status in (429, 500, 503))


class Service:
    def __init__(self, *choices):
        self.choices, self.bodies = list(choices), []

    def __call__(self, request, timeout):
        self.bodies.append(json.loads(request.data))
        return io.BytesIO(json.dumps({"choices": self.choices.pop(0)}).encode())


def test_http_continues_a_cut_reply():
    say = lambda text, why: [{"message": {"content": text}, "finish_reason": why}]
    service = Service(say("one ", "length"), say("two", "stop"))
    http = client.Http("http://x/v1/", "k", "default", opener=service)
    assert http.complete(client.Request("u", system="s")) == "one two"
    assert service.bodies[0]["model"] == "default" and [m["role"] for m in service.bodies[1]["messages"]] == ["system", "user", "assistant", "user"]
    with pytest.raises(client.CompletionError, match="empty"):
        client.Http("http://x", "k", "d", opener=Service([])).complete(REQUEST)
    with pytest.raises(client.CompletionError, match="continuations"):
        client.Http("http://x", "k", "d", opener=Service(*[say("a", "length")] * 99)).complete(REQUEST)
    with pytest.raises(client.CompletionError, match="deadline") as e:
        client.Http("http://x", "k", "d", timeout=0, opener=Service()).complete(REQUEST)
    assert e.value.retryable


def test_offline_is_a_function_of_the_request():
    c = client.Offline([("boom", client.CompletionError("no"))])
    assert c.complete(REQUEST) == c.complete(REQUEST) != c.complete(client.Request("other"))
    with pytest.raises(client.CompletionError):
        c.complete(client.Request("boom"))
