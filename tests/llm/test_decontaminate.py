import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tools.check import compare
from tracemill.llm import decontaminate
from tracemill.llm.queries import ORACLE, op11_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        k = min(len(w), 10)
        for i in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if name is None else str(name))
    sizes = {len(k) for k in windows}
    out = []
    for name, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        out.append((name, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def search(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.search(docs, items, keep=("doc_id",)).withColumn("hit", decontaminate.n_words_in(F.col("spans"))).collect()
    return sorted(((r["row"]["doc_id"], r["n_words"], r["hit"], tuple(sorted(r["items"]))) for r in rows), key=repr)


def fixture(seed, letters="abc"):
    """Texts of few words, so that windows, parts of windows and borders recur; items of every length."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(7)] + ["é", "一二", "X9"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14, 30])))) for i in range(25)]
    items += [(3, " ".join(some(12))), (50, items[5][1]), (None, " ".join(some(4))), (51, None), (52, "!?"), (53, items[5][1].upper())]
    docs = []
    for i in range(60):
        w = some(rng.randint(0, 80))
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = words(rng.choice(items)[1])
        docs.append((i, rng.choice([" ", "\n", "-", ", "]).join(w)))
    return docs + [(60, None), (61, ""), (62, " \n"), (7, docs[0][1]), (7, docs[0][1]), (None, docs[3][1])], items


def test_query_equals_sql(spark, duck, sf_dir):
    ok, note = compare(spark, duck, op11_decontaminate, ORACLE["op11_decontaminate"], sf_dir)
    assert ok, note


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    docs, items = fixture(seed)
    got = search(spark, docs, items)
    assert got == brute(docs, items) and any(r[2] for r in got)


def test_benchmark_in_several_blocks(spark, monkeypatch):
    docs, items = fixture(9)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 300)
    assert search(spark, docs, items) == brute(docs, items)


def test_long_texts_and_long_items_in_pieces(spark, monkeypatch):
    docs, items = fixture(4)
    whole = " ".join(t or "" for _, t in docs)
    docs, items = [(1, whole * 3), (2, "b" * 5000), (3, "! " * 5000)], [*items, (90, whole)]
    monkeypatch.setattr(decontaminate, "_SLICE", 7)
    raw = np.frombuffer(whole.encode(), np.uint8)
    pieces = list(decontaminate._pieces(raw, 60))
    assert len(pieces) > 20 and pieces[-1][1] + len(pieces[-1][0].start) == len(words(whole))
    assert search(spark, docs, items) == brute(docs, items)


def test_pieces_give_the_hits_of_the_whole(monkeypatch):
    docs, items = fixture(5)
    texts = [t for _, t in items if t and words(t)]
    raw = "\0".join(texts).encode()
    bounds = np.append(0, np.cumsum([len(t.encode()) + 1 for t in texts]))
    bounds[-1] -= 1
    index = decontaminate.Index(raw, bounds, np.arange(len(texts)), [str(i) for i in range(len(texts))])
    text = np.frombuffer(" ".join(t or "" for _, t in docs).encode(), np.uint8)
    whole = decontaminate.Text(text, np.array([0, len(text)]))
    a, b, _ = index.hits(whole)
    spans = set(zip(a.tolist(), b.tolist(), strict=True))
    for limit in (50, 200):
        found = set()
        for piece, number in decontaminate._pieces(text, limit):
            a, b, _ = index.hits(piece)
            found |= set(zip((a + number).tolist(), (b + number).tolist(), strict=True))
        assert found == spans


def test_equal_keys_are_compared_byte_by_byte(spark, monkeypatch):
    """With a hash that is always zero, buckets hold many different windows."""
    monkeypatch.setattr(decontaminate, "_hashes", lambda data, start, length: np.zeros(len(start), np.uint64))
    docs, items = fixture(6)
    texts = [(i, t) for i, t in items if t and words(t)]
    raw = "\0".join(t for _, t in texts).encode()
    bounds = np.append(0, np.cumsum([len(t.encode()) + 1 for _, t in texts]))
    bounds[-1] -= 1
    index = decontaminate.Index(raw, bounds, np.arange(len(texts)), ["" if i is None else str(i) for i, _ in texts])
    for want, (_, t) in zip(brute(docs[:20], texts), sorted(docs[:20], key=lambda d: repr((d[0],))), strict=True):
        data = np.frombuffer((t or "").encode(), np.uint8)
        text = decontaminate.Text(data, np.array([0, len(data)]))
        _, _, found = index.hits(text)
        names = {index.names[i] for i in index.items_of(decontaminate._sorted(found), 0, len(text.start)).tolist()}
        assert tuple(sorted(names)) == want[3]


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, empty):
    items = spark.createDataFrame([(1, "né 一二"), (2, None)], "item_id bigint, text string")
    rows = decontaminate.search(odd, items).collect()
    assert len(rows) == len(odd_rows) and set(rows[0]["row"].asDict()) == set(odd.columns)
    assert {r["row"]["doc_id"] for r in rows if r["items"]} == {11}
    assert sorted(r["n_words"] for r in rows) == sorted(len(words(t)) for _, t in odd_rows)
    assert decontaminate.search(empty, items).count() == 0
    none = decontaminate.search(odd, items.limit(0)).collect()
    assert len(none) == len(odd_rows) and not any(r["spans"] or r["items"] for r in none)
