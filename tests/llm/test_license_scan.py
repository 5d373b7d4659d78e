import re
from collections import Counter

from codeweave.llm import license_scan, queries

from .conftest import frame, messy_rows


def bag(text):
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return Counter(zip(w, w[1:]))


def brute(rows, threshold=0.8):
    bags = {n: bag(t) for n, t in license_scan.TEMPLATES.items()}
    out = []
    for k, t in rows:
        t = t or ""
        units = [("line", i, x) for i, x in enumerate(t.split("\n"))] + ([("document", None, t)] if "\n" in t else [])
        for unit, i, x in units:
            own = bag(x)
            n = sum(own.values())
            scores = [(2.0 * sum((own & b).values()) / (n + sum(b.values())), name) for name, b in bags.items()] if n else []
            best = max(scores, key=lambda s: (s[0], [-ord(c) for c in s[1]]), default=(0, ""))
            if best[0] >= threshold:
                out.append((k, unit, i, best[1], round(best[0], 9)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r[0], r["unit"], r["line"], r["license"], round(r["dice"], 9)) for r in df.collect()), key=repr)


def test_whole_table(spark, sf01):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(queries.op8_license_scan(spark, sf01))
    assert got == brute(docs) and got


def test_templates_and_their_variants(spark):
    t = license_scan.TEMPLATES
    mit = t["MIT"].split()
    rows = [(i, text) for i, text in enumerate(t.values())]
    rows += [
        (100, "intro\n" + t["MIT"].upper() + "\nend"), (101, "\n".join(mit[i] for i in range(len(mit)))), (102, " ".join(mit[: len(mit) // 2])),
        (103, t["MIT"].replace("Software", "Program", 2)), (104, t["ISC"] + " " + t["MIT"]), (105, "License"), (106, "released under the mit license " * 400),
    ]
    got = rows_of(license_scan.scan(frame(spark, rows), "doc_id", "text"))
    assert got == brute(rows) and {r[3] for r in got} == set(t)


def test_messy_and_empty(messy, nothing):
    assert rows_of(license_scan.scan(messy, "doc_id", "text")) == brute(messy_rows())
    assert license_scan.scan(nothing, "doc_id", "text").count() == 0


def test_ties_go_to_the_first_name(spark):
    same = {"b": "one two three", "a": "One, two: three", "c": "four five six seven"}
    got = license_scan.scan(frame(spark, [(1, "one two three"), (1, "one two three")]), "doc_id", "text", templates=same)
    assert rows_of(got) == [(1, "line", 0, "a", 1.0)] * 2


def best_run(text, license):
    """The greatest dice of any run of words."""
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    grams, own = list(zip(w, w[1:])), bag(license_scan.TEMPLATES[license])
    n = sum(own.values())
    top = 0.0
    for a in range(len(grams)):
        left, shared = Counter(own), 0
        for b in range(a, min(len(grams), a + 2 * n)):
            if left[grams[b]] > 0:
                left[grams[b]] -= 1
                shared += 1
            top = max(top, 2.0 * shared / (b - a + 1 + n))
    return top


def wrapped(text, width=9):
    w = text.split()
    return ["// " + " ".join(w[i : i + width]) for i in range(0, len(w), width)]


def test_notices_within_longer_texts(spark):
    """Wrapped over lines of a longer text, changed, inside a longer line, and twice in one text."""
    t = license_scan.TEMPLATES
    code = [f"int value{i} = call{i}(x{i}, y{i});" for i in range(300)]
    prose = " ".join(f"some{i} plain{i} words{i}" for i in range(200))
    changed = re.sub("Software", "Program", t["MIT"], count=4) + " without any more words of it"
    rows, want = [], []
    for i, name in enumerate(("Apache-2.0-header", "MIT", "ISC", "GPL-header", "MPL-2.0-header")):
        rows += [(i, "\n".join([*code[:20], *wrapped(t[name]), *code])), (20 + i, f"{prose} {t[name]} {prose}")]
        want += [(i, "passage", 20, name), (20 + i, "passage", 0, name)]
    rows += [(40, "\n".join([*code[:7], *wrapped(changed), *code])), (41, "\n".join([*wrapped(t["MIT"]), *code[:3], *wrapped(t["MIT"]), *code])), (42, t["ISC"] + " " + t["MIT"])]
    second = len(wrapped(t["MIT"])) + 3
    want += [(40, "passage", 7, "MIT"), (41, "passage", 0, "MIT"), (41, "passage", second, "MIT"), (42, "passage", 0, "ISC"), (42, "passage", 0, "MIT")]
    rows += [(50, "\n".join([*code, t["MIT"], *code])), (51, "\n".join(wrapped(t["MIT"]))), (52, prose), (53, "\n".join([*code, *wrapped(t["MIT"])[:9], *code])), (54, None)]
    got = license_scan.scan(frame(spark, rows), "doc_id", "text", passages=True)
    got = [r for r in rows_of(got) if r[1] == "passage" and not r[3].endswith("-short")]
    assert [r[:4] for r in got] == sorted(want, key=repr)
    texts = dict(rows)
    for k, _, _, name, dice in got:
        assert abs(dice - best_run(texts[k], name)) < 1e-6, (k, name)


def test_whole_licences(spark):
    """Complete texts with another holder, alone and within a longer text."""
    t = license_scan.TEMPLATES
    names = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")
    code = "\n".join(f"int value{i} = call{i}(x{i}, y{i});" for i in range(600))
    rows = [(i, "Copyright 2020 Some Person\n\n" + t[n]) for i, n in enumerate(names)]
    rows += [(100 + i, f"{code}\n{t[n].strip()}\n{code}") for i, n in enumerate(names[:4])]
    got = rows_of(license_scan.scan(frame(spark, rows), "doc_id", "text", passages=True))
    assert [(r[0], r[3]) for r in got if r[1] == "document"] == list(enumerate(names))
    assert {(100 + i, "passage", 600, n) for i, n in enumerate(names[:4])} <= {r[:4] for r in got}
