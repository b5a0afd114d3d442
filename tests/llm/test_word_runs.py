import random
import re
import zlib

import numpy as np

from tools.check import compare
from tracemill.llm import word_runs
from tracemill.llm.queries import ORACLE, op13_word_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=12):
    """Runs by trying every period: start, length, smallest period, by start and period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequence(rng):
    """Words over few letters, powers, powers of near powers, Fibonacci words."""
    kind = rng.randint(0, 4)
    if kind == 0:
        return [rng.randint(0, 1) for _ in range(rng.randint(0, 120))]
    if kind == 1:
        return [0] * rng.randint(0, 60)
    if kind == 2:
        u = ([rng.randint(0, 2) for _ in range(rng.randint(1, 30))] * rng.randint(2, 5))[: -rng.randint(1, 4)]
        return (u + [rng.randint(0, 2) for _ in range(rng.randint(0, 9))]) * rng.randint(1, 3)
    if kind == 3:
        m = rng.randint(1, 12)
        return ([0, 1] * m + [0]) * 2 + [0, 1] * rng.randint(0, 3) + ([0, 1] * m + [0]) * rng.randint(0, 3)
    a, b = [0], [0, 1]
    for _ in range(rng.randint(1, 8)):
        a, b = b, b + a
    return b


def test_query_equals_sql(spark, duck, sf_dir):
    ok, note = compare(spark, duck, op13_word_runs, ORACLE["op13_word_runs"], sf_dir)
    assert ok, note


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(500):
        texts = [sequence(rng) for _ in range(rng.randint(1, 4))]
        bounds = np.append(0, np.cumsum([len(t) for t in texts]))
        start, length, period = word_runs.find_runs(np.array(sum(texts, []), np.int64), bounds)
        row = np.searchsorted(bounds, start, side="right") - 1
        got = [[] for _ in texts]
        for r, s, n, q in zip(row.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
            got[r].append((s - int(bounds[r]), n, q))
        assert got == [brute(t) for t in texts]


def test_pairs_stay_linear():
    n = 1 << 14
    for words in (np.zeros(n, np.int64), np.tile(np.arange(128), n // 128), np.tile([0, 1, 0, 1, 0], n // 5 + 1)[:n]):
        grams = word_runs.Grams(words, np.zeros(n, np.int64))
        while grams.grow():
            size = 1 << (len(grams.levels) - 1)
            if size >= 8:
                assert len(word_runs._pairs(grams.levels[-1], size)[0]) <= 8 * n
            if 2 * size > n:
                break


def test_texts_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join("abé"[k] for k in sequence(rng))) for i in range(150)]
    rows += [(None, rows[3][1]), (4, rows[4][1]), (500, None), (501, ""), (502, " \n"), (503, "no break " * 15)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for chosen in (frame, word_runs.with_repeated_tails(frame)):
        texts = {r["doc_id"]: r["text"] for r in chosen.collect()}
        for r in word_runs.collapse(chosen).collect():
            w = WORD.findall(texts[r["row"]["doc_id"]] or "")
            runs = brute(w)
            gone = {i for s, n, q in runs for i in range(s + q, s + n)}
            assert r["n_words"] == len(w) and [tuple(x) for x in r["runs"]] == runs
            assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_repeated_tails(spark):
    rng = random.Random(2)
    rows = [(i, " \n".join(str(rng.randint(0, 99)) for _ in range(i % 97))) for i in range(400)] + [(None, "a b"), (10**12, None)]
    changed = 0
    for r in word_runs.with_repeated_tails(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        text = dict(rows)[r["doc_id"]]
        h = zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
        w = WORD.findall(text or "")
        if h % 10 or not w:
            assert r["text"] == text
            continue
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        changed += 1
        assert r["text"] == " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(len(w)))
    assert changed > 20


def test_odd_rows(odd, odd_rows, empty):
    rows = word_runs.collapse(odd).collect()
    assert len(rows) == len(odd_rows) and set(rows[0]["row"].asDict()) == set(odd.columns)
    texts = {r["row"]["doc_id"]: (r["n_words"], len(r["runs"]), r["collapsed"]) for r in rows}
    assert texts[1] == texts[2] == texts[3] == (0, 0, "") and texts[12] == (18, 1, "same line")
    assert word_runs.collapse(empty).count() == 0
