import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from codeweave.llm import packing, queries, token_files, tokens

from .conftest import messy_rows

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = str(public_tokenizers.path("word_bpe_49k.json")), str(public_tokenizers.path("byte_bpe_50k.json"))


def encode(path, texts):
    from tokenizers import Tokenizer

    return [np.array([*e.ids, 2], "<u4") for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path, drops", [(WORD, True), (BYTE, False)])
def test_cached_encoding_is_the_tokenizers_own(path, drops, sf01):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf01}/documents.parquet", columns=["text"])["text"].to_pylist() + [t for _, t in messy_rows()]
    odd = ["a  b", " a", "a ", "a\n", "\n\na", "a\tb", "don't I'll", "a　b", "A<|endoftext|>b", "1234 5,6", "\x1ca", "é É", "a \n b", "\r\n", "x\x0by"]
    enc = tokens.Encoder(path, drops)
    got = enc.encode(pa.array(texts + odd, pa.string()))
    for text, ids, want in zip(texts + odd, got, encode(path, texts + odd)):
        assert np.array_equal(np.frombuffer(ids, enc.dtype), want[:-1]), repr((text or "")[:80])


def test_whole_table(spark, sf01):
    rows = sorted(queries.op2_token_files(spark, sf01).collect(), key=lambda r: r["doc_id"])
    docs = sorted(spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect())
    start = 0
    for r, d, ids in zip(rows, docs, encode(WORD, [d["text"] for d in docs]), strict=True):
        assert tuple(r[:4]) == (d["doc_id"], start, len(ids), zlib.crc32(ids))
        start += len(ids)


def test_files_hold_ids_and_offsets(spark, messy, tmp_path):
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(messy, "doc_id", "text", WORD, 2, folder, True, per_part=1 << 18)
    parts = sorted(manifest.collect())
    assert len(parts) > 1
    order, flat = [], []
    for p in parts:
        at = lambda kind: os.path.join(tmp_path, "files", f"{kind}-{p['stem']}.bin")
        ids, off, docs = np.memmap(at("tokens"), "<u2", "r"), np.memmap(at("offsets"), "<u8", "r"), np.memmap(at("docs"), "<i8", "r")
        assert (len(docs), len(ids), off[0], off[-1]) == (p["n_docs"], p["n_tokens"], 0, p["n_tokens"])
        order += docs.tolist()
        flat += [np.array(ids[a:b]) for a, b in zip(off[:-1].astype(int), off[1:].astype(int))]
    assert order == sorted(order) and order[:3] == [token_files.NULL_ID] * 3
    want = {}
    for (k, _), ids in zip(messy_rows(), encode(WORD, [t for _, t in messy_rows()])):
        want.setdefault(token_files.NULL_ID if k is None else k, []).append(ids.tolist())
    for k in want:
        assert sorted(x.tolist() for o, x in zip(order, flat) if o == k) == sorted(want[k])
    back = token_files.read_token_files(manifest, folder, "doc_id").orderBy("start").collect()
    assert len(back) == len(order) and back[-1]["start"] + back[-1]["n_tokens"] == sum(map(len, flat)) and back[0]["doc_id"] is None


def test_no_rows(spark, nothing):
    assert token_files.token_table(nothing, "doc_id", "text", WORD, 2, True).count() == 0
    assert packing.pack(nothing, "doc_id", "text", BYTE, 2).count() == 0


def check_packing(rows, docs, capacity):
    """Pieces are those of the whole ids, sequences are full of them without gaps."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    want = {}
    for (k, _), ids in zip(docs, encode(BYTE, [t for _, t in docs])):
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want.setdefault(k, []).extend((p, a, b - a, zlib.crc32(ids[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])))
    for k in want:
        assert sorted(tuple(r[c] for c in ("piece", "start", "length", "ids_crc32")) for r in by_doc[k]) == sorted(want[k])
    assert by_doc.keys() == want.keys()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r["length"] for r in rows)


def test_packing_of_the_whole_table(spark, sf01):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op9_packing(spark, sf01).collect()
    bins, total = check_packing(rows, docs, 1024)
    best = len(packing.best_fit([r["length"] for r in rows], 1024))
    assert bins <= best + 3 and bins <= 1.02 * -(-total // 1024) + 2


def test_packing_of_messy_rows(messy):
    rows = packing.pack(messy, "doc_id", "text", BYTE, 2, 64).collect()
    check_packing(rows, messy_rows(), 64)


@pytest.mark.parametrize("parts", [1, 16])
def test_merge_rounds_gather_underfull_bins(spark, parts):
    """Tasks pack 300 items at a time, however many their partition has."""
    pieces = spark.range(4000).selectExpr("id as rid", "id * 7919 % 800 + 1 as length").repartition(parts)
    got = packing.pack_items(pieces, 1024, 1016, most=300).collect()
    sizes = {r["rid"]: r["length"] for r in pieces.collect()}
    assert sorted(x for r in got for x in r["rids"]) == sorted(sizes)
    assert all(sum(sizes[x] for x in r["rids"]) <= 1024 for r in got)
    assert len(got) <= 1.02 * sum(sizes.values()) / 1024 + 2


def test_best_fit():
    assert packing.best_fit([], 10) == []
    assert [sorted(b) for b in packing.best_fit([5, 5, 10, 1, 9], 10)] == [[2], [3, 4], [0, 1]]
