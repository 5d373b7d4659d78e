import json

from codeweave.operators import schema
from codeweave.sources import artifacts
from codeweave.streaming import changes as stream


def entry(path, digest, *uses):
    imports = [{"path": u, "internal": True, "resolved_path": u} for u in uses]
    return path, "go", digest, [], [], imports


def test_batches_change_the_index_and_name_the_affected(spark, tmp_path):
    root = f"file://{tmp_path}"
    old = spark.createDataFrame([entry("api.go", "1", "auth.go"), entry("auth.go", "1"), entry("db.go", "1"), entry("gone.go", "1")], schema.FILE_INDEX)
    fresh = spark.createDataFrame([entry("api.go", "1", "auth.go"), entry("auth.go", "2"), entry("db.go", "2", "auth.go")], schema.FILE_INDEX)
    modules = artifacts.modules_frame(spark, [{"id": m, "files": [f"{m}.go"], "owner": "agent"} for m in ("api", "auth", "db", "gone")])
    stream.start_index(old, f"{root}/state")
    (tmp_path / "in").mkdir()

    def send(name, *changes):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("path", "old_path", "type"), c))) for c in changes))

    def run():
        q = stream.follow_changes(spark, f"{root}/in", f"{root}/state", modules, lambda: fresh, f"{root}/check")
        q.awaitTermination(120)

    send("a.json", ("auth.go", "", "modified"), ("gone.go", "", "deleted"))
    run()
    now = {r["path"]: r["content_hash"] for r in stream.current_index(spark, f"{root}/state").collect()}
    assert now == {"api.go": "1", "auth.go": "2", "db.go": "1"}
    hit = lambda i: sorted(r["id"] for r in spark.read.parquet(f"{root}/state/affected/batch={i}").collect())
    assert hit(0) == ["api", "auth", "gone"]

    send("b.json", ("db.go", "", "modified"))
    run()
    assert {r["path"]: r["content_hash"] for r in stream.current_index(spark, f"{root}/state").collect()}["db.go"] == "2" and hit(1) == ["db"]

    # The same batch again, as after a failure, gives the same version.
    stream.apply_batch(spark.createDataFrame([("db.go", "", "modified")], schema.CHANGES), 1, f"{root}/state", modules, lambda: fresh)
    assert stream.current_index(spark, f"{root}/state").count() == 3 and hit(1) == ["db"]
