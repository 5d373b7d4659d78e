import random

import pytest

from codeweave.llm import decontaminate, queries

from .conftest import frame, messy_rows, shingles_of, words_of


def brute(docs, items, threshold=0.8):
    sets = [(k, shingles_of(t)) for k, t in docs]
    out = []
    for i, t in dict.fromkeys(items):
        item = shingles_of(t)
        for k, s in sets:
            shared = len(item & s)
            if item and shared >= threshold * len(item) - 1e-9:
                out.append((k, i, len(item), shared))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


def test_whole_table(spark, sf01):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf01}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert rows_of(queries.op4_decontaminate(spark, sf01)) == want and want


def planted():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(2000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items, docs = [], []
    for i, n in enumerate([5, 6, 7, 8, 12, 16, 17, 33, 64, 65, 130, 300, 1000]):
        w = text(n)
        items.append((i, " ".join(w)))
        for at, size in ((0, 2000), (1999, 2000), (777, 5000)):
            body = text(size)
            docs.append((len(docs), " ".join(body[:at] + w + body[at:])))
        changed = list(w)
        changed[n // 2] = "other"
        docs.append((len(docs), " ".join(text(300) + changed + text(50)).upper()))
        docs.append((len(docs), " ".join(w[: n // 2] + text(3) + w[n // 2 :])))
    items += [(90, "two words"), (91, None), (92, ""), (93, " \n"), (None, "lone item with six words here"), (0, items[0][1])]
    docs += [(900, "Two\twords"), (901, "two words more"), (None, "a lone item with six words here b"), (902, None), (903, "")]
    return docs, items


def test_planted_items_of_all_sizes(spark):
    docs, items = planted()
    got = decontaminate.contaminated(frame(spark, docs), "doc_id", "text", frame(spark, items, "item_id"), "item_id", "text")
    want = brute(docs, items)
    assert rows_of(got) == want and len(want) > 40


def test_item_table_in_slices(spark, monkeypatch):
    docs, items = planted()
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 2000)
    got = decontaminate.contaminated(frame(spark, docs), "doc_id", "text", frame(spark, items, "item_id"), "item_id", "text")
    assert rows_of(got) == brute(docs, items)


def test_messy(spark, messy, nothing):
    items = [(1, messy_rows()[4][1]), (2, "three short words"), (3, " ".join(words_of(messy_rows()[14][1])[30_000:30_050])), (4, messy_rows()[8][1])]
    kept = decontaminate.drop_contaminated(messy, "doc_id", "text", frame(spark, items, "item_id"), "item_id", "text")
    hit = {k for k, *_ in brute(messy_rows(), items)}
    want = [k for k, t in messy_rows() if not any(t2 == t and k2 == k for k2, t2 in messy_rows() if brute([(k2, t2)], items))]
    assert kept.columns == messy.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(want, key=repr) and hit
    none = frame(spark, [], "item_id")
    assert decontaminate.contaminated(messy, "doc_id", "text", none, "item_id", "text").count() == 0
    assert decontaminate.contaminated(nothing, "doc_id", "text", frame(spark, items, "item_id"), "item_id", "text").count() == 0
    assert decontaminate.drop_contaminated(messy, "doc_id", "text", none, "item_id", "text").count() == len(messy_rows())


@pytest.mark.parametrize("n", [4, 5, 9])
def test_a_window_edge_loses_nothing(spark, n):
    rng = random.Random(n)
    item = [f"i{j}" for j in range(n + 4)]
    docs = [(at, " ".join([f"p{rng.random()}" for _ in range(at)] + item)) for at in range(0, 40)]
    got = decontaminate.contaminated(frame(spark, docs), "doc_id", "text", frame(spark, [(7, " ".join(item)), (8, "one two three four five")], "item_id"), "item_id", "text")
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(40))
