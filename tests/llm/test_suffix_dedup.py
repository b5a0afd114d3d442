import hashlib
import random
from collections import Counter

import pytest

from tests.llm.conftest import prose
from tracemill.llm import suffix_dedup
from tracemill.llm.queries import op4_suffix_dedup


def brute(texts, length):
    """Kept bytes, bytes and maximal runs removed of every text."""
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((bytes(c for c, g in zip(t, gone, strict=True) if not g), sum(gone), runs))
    return out


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        parts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 8))]
        array = suffix_dedup.SuffixArray(parts)
        data = b"".join(parts)
        suffix = [data[i : array.end[i]] for i in range(len(data))]
        order = sorted(range(len(data)), key=lambda i: ([c + 1 for c in suffix[i]] + [0], array.part[i]))
        assert array.order.tolist() == order
        shared = array.common_prefixes(40)
        for a, b in zip(order, order[1:], strict=False):
            x, y = suffix[a], suffix[b]
            assert shared[b] == min(40, next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))))


def texts_with_passages(seed):
    rng = random.Random(seed)
    passages = [prose(900 + k, 40) for k in range(5)]
    rows = []
    for k in range(60):
        parts = [prose(seed * 1000 + k * 7 + j, rng.randrange(5, 40)) for j in range(3)]
        parts += [p[rng.randrange(30) : len(p) - rng.randrange(30)] for p in rng.sample(passages, rng.randrange(3))]
        rng.shuffle(parts)
        rows.append("ñ".join(parts))
    return [*rows, rows[0], rows[0], "xyz" * 300, "q" * 900, "", "short"]


@pytest.mark.parametrize("shard", [1 << 20, 2000])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    texts = texts_with_passages(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r["row"]["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup(docs, length=100, gram=16).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts], 100)))


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {i: (len(t), n, s, hashlib.sha256(k).hexdigest()) for (i, t), (k, n, s) in zip(texts.items(), brute(list(texts.values()), 200), strict=True)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op4_suffix_dedup(spark, sf_dir).collect()}
    assert got == want


def test_odd_rows(odd, odd_rows, empty):
    got = sorted((r["row"]["doc_id"] or -1, r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.dedup(odd).collect())
    texts = [(i, (t or "").encode()) for i, t in odd_rows if len(t or "") < 100_000]
    want = {(i or -1, n, k) for (i, _), (k, n, _) in zip(texts, brute([t for _, t in texts], 200), strict=True)}
    assert want <= set(got) and len(got) == len(odd_rows)
    size = len(dict(odd_rows)[8])
    long = [(i, n) for i, n, _ in got if i in (8, 9)]
    assert long == [(8, size), (9, size)]
    out = suffix_dedup.without_repeats(odd)
    assert out.columns == odd.columns and out.where("doc_id = 1 and text is null").count() == 1
    assert suffix_dedup.without_repeats(empty).count() == 0
