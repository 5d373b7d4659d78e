import pytest

import corpus_pipeline as cp
from codeweave.llm import quality

from .conftest import frame, messy_rows, shingles_of
from .test_decontaminate import brute as contaminated
from .test_line_dedup import key
from .test_minhash_dedup import brute as groups
from .test_token_files import check_packing

STAGES = dict(cp.STAGES)


@pytest.fixture(scope="module")
def through(spark, sf01, tmp_path_factory):
    """Every stage's rows, each stage fed with those of the one before."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    out = {"documents": docs}
    for name, stage in cp.STAGES:
        stage(spark, docs, sf01).write.parquet(f"file://{root}/{name}")
        docs = out[name] = spark.read.parquet(f"file://{root}/{name}")
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_names_and_columns(through):
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, _ in cp.STAGES[:-1]:
        assert through[name].columns == through["documents"].columns and dict(through[name].dtypes) == dict(through["documents"].dtypes)


def test_quality_keeps_what_the_classifier_accepts(spark, sf01, through):
    scores = quality.quality(through["documents"], spark.read.parquet(f"{sf01}/labels.parquet"), "doc_id", "text")
    want = sorted(r["doc_id"] for r in scores.where("predicted = 1").collect())
    assert [k for k, _ in texts(through["quality"])] == want and 0 < len(want) < 1000


def test_line_dedup_drops_common_lines(through):
    rows = texts(through["quality"])
    seen = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    # A null text stays one; all others are their lines that stay.
    want = [(k, t if t is None else "\n".join(x for x in t.split("\n") if not key(x) or seen[key(x)] < cp.COMMON)) for k, t in rows]
    got = texts(through["line_dedup"])
    assert got == want and got != rows
    assert all(r["n_chars"] == len(r["text"]) for r in through["line_dedup"].where("text is not null").collect())


def test_near_dedup_keeps_one_of_each_group(through):
    rows = texts(through["line_dedup"])
    want = [k for k, n, _, kept in groups(rows, cp.SIMILAR) if kept or n == 0]
    assert sorted(k for k, _ in texts(through["near_dedup"])) == sorted(want) and len(want) < len(rows)


def test_decontamination_drops_what_holds_an_item(spark, sf01, through):
    rows = texts(through["near_dedup"])
    items = [tuple(r) for r in spark.read.parquet(f"{sf01}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {k for k, *_ in contaminated(rows, items)}
    assert texts(through["decontamination"]) == [r for r in rows if r[0] not in bad] and bad


def test_packing_and_run(spark, sf01, through):
    rows = through["packing"].collect()
    check_packing(rows, texts(through["decontamination"]), 1024)
    pieces = lambda rs: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs)
    assert pieces(cp.run(spark, sf01).collect()) == pieces(rows)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_take_messy_and_empty_tables(spark, sf01, messy, nothing, name):
    out = STAGES[name](spark, messy, sf01)
    assert out.columns == messy.columns and out.count() <= len(messy_rows())
    assert STAGES[name](spark, nothing, sf01).count() == 0


def test_packing_takes_messy_and_empty_tables(spark, sf01, messy, nothing):
    check_packing(STAGES["packing"](spark, messy, sf01).collect(), messy_rows(), 1024)
    assert STAGES["packing"](spark, nothing, sf01).count() == 0


def test_rows_without_words_stay(spark, sf01):
    blank = frame(spark, [(1, None), (2, ""), (3, " "), (4, "\n"), (5, "a b"), (6, "A  b")])
    kept = STAGES["near_dedup"](spark, blank, sf01)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5] and shingles_of("a b") == shingles_of("A  b")
