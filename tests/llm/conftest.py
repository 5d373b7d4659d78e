import random
import re
import string

import pytest

#: Columns that no operator may trip over, whatever it calls its own.
CLASHING = (
    "k t th h h1 h2 n m node rid root row _k _th _t _part _key _n _each _blank size shard slot score lines dropped line key pos gram w u "
    "index train bucket chunk blob label v valid weight start length piece sequence_id offset y f i s1 s2 sig cluster component license dice"
).split()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def shingles_of(text, width=5):
    w = words_of(text)
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def components_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def messy_rows():
    """Null, blank, tied, repeated, very long and odd texts; null and repeated ids."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    one, two = text(120), text(40)
    near = one.split()
    near[60] = "zzz"
    long = text(60_000)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "\n"), (5, one), (6, one), (6, one), (7, " ".join(near)), (None, two), (None, two), (None, None),
        (8, two.upper() + "  "), (9, "three short words"), (10, "Three  SHORT\nwords"), (11, long), (12, long + " tail"), (13, "x" * 200_000),
        (14, "Üñí cødé   <|endoftext|> \x00 \U0001f600"), (15, "\r\n a \r\n A\t\n"), (16, "word " * 3000), (-5, one), (2**40, text(500)),
    ]


def frame(spark, rows, id="doc_id"):
    """Rows as documents with all other columns null or clashing."""
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    data = [(k, t, None, "src" if i % 2 else None, None, *(["?"] * len(CLASHING))) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(data, f"{id} long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def messy(spark):
    df = frame(spark, messy_rows()).repartition(3).cache()
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def sf01():
    import os

    path = os.environ.get("TEST_SF01_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    return path
