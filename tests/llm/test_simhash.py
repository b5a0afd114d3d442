import random
from itertools import combinations

import numpy as np
import xxhash

from tests.llm.conftest import prose
from tracemill.llm import simhash
from tracemill.llm.common import Scratch
from tracemill.llm.components import components
from tracemill.llm.queries import op8_simhash


def brute_fingerprint(text, words):
    tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or ([b" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, nodes):
    owner = {n: n for n in nodes}
    for _ in range(len(nodes)):
        before = dict(owner)
        for a, b in pairs:
            owner[a] = owner[b] = min(owner[a], owner[b])
        if owner == before:
            return owner
    return owner


def test_masks_cover_the_radius():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for a, b in combinations(range(64), 2):
        assert any(not (m >> a & 1 or m >> b & 1) for m in masks)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, None), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == groups(real, {x for e in real for x in e})


def test_query_against_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t, 3) for i, t in texts.items()}
    owner = groups([(a, b) for a, b in combinations(sorted(prints), 2) if bin(prints[a] ^ prints[b]).count("1") <= 2], sorted(prints))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op8_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", owner[i]) for i in prints}


def test_links_join_exactly_the_close_ones(spark):
    rng = random.Random(11)
    values = {0}
    for _ in range(60):
        value = rng.getrandbits(64)
        for _ in range(8):
            values.add(value)
            value ^= sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 4)))
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    rows = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp bigint")).collect()
    found = [(r["a"], r["b"]) for r in rows]
    assert all(int(np.bitwise_count(np.uint64((a ^ b) % (1 << 64)))) <= 2 for a, b in found)
    close = [(signed[a], signed[b]) for a, b in combinations(values, 2) if bin(a ^ b).count("1") <= 2]
    assert groups(found, list(signed.values())) == groups(close, list(signed.values()))


def test_odd_rows(odd, odd_rows, empty):
    got = sorted((r["doc_id"] or -1, r["fp"] % (1 << 64)) for r in simhash.near_duplicates(odd).collect())
    assert got == sorted((i or -1, brute_fingerprint(t or "", 3)) for i, t in odd_rows)
    linked = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert linked[2] == linked[3] == linked[1] == 1 and linked[6] == linked[5] == 5 and linked[9] == 8
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 7, 8, 10, 11, 12]


def brute_keep_one(rows, words=3):
    """Places of the rows that stay, given (doc_id, text, ...) rows without whole repeats."""
    prints = [brute_fingerprint(r[1] or "", words) for r in rows]
    owner = groups([(a, b) for a, b in combinations(range(len(rows)), 2) if bin(prints[a] ^ prints[b]).count("1") <= 2], range(len(rows)))
    least = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        least.setdefault(owner[k], rows[k][0])
    return [(least[c], {r[1:] for k, r in enumerate(rows) if owner[k] == c and r[0] == least[c]}) for c in least]


def check_kept(spark, rows):
    """Of each component one row of the smallest id, and nothing else."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    wanted = brute_keep_one(rows)
    assert len(kept) == len(wanted)
    for least, choices in wanted:
        match = [r for r in kept if r[0] == least and r[1:] in choices]
        assert len(match) == 1
        kept.remove(match[0])
    return wanted


def test_keep_one_with_repeated_and_null_ids(spark):
    """Different texts of one id are decided apart, copies of a null id leave one row, and null ids carry links."""
    a, b, c = prose(60, 50), prose(61, 50), prose(62, 4000)
    near = c.rsplit(" ", 1)[0]
    assert bin(brute_fingerprint(c, 3) ^ brute_fingerprint(near, 3)).count("1") <= 2
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "y"), (None, b, "z"), (None, c, "p"), (None, c, "q"), (None, near, "r"), (3, "three", "u"), (3, "three", "v"), (4, " Three ", "w")]
    assert len(check_kept(spark, rows)) == 4
    assert len(check_kept(spark, [(5, near, "s"), *rows])) == 4


def test_keep_one_against_brute_force(spark):
    """Families of copies with a few words changed, ids repeated and missing, texts without words."""
    rng, rows = random.Random(2), []
    for k in range(70):
        base = prose(100 + k, rng.choice([2, 9, 200, 1500])).split()
        for c in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, len(base) // 100])):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
            rows.append((rng.choice([None, 7, 1000 * c + k, 1000 * c + k, 1000 * c + k]), " ".join(copy), f"s{len(rows)}"))
    rows += [(9000, None, "a"), (9001, "", "b"), (None, " ", "c")]
    assert len(check_kept(spark, rows)) < len(rows)


def test_keep_one_of_whole_repeats(spark):
    """Of rows alike in every column one stays."""
    docs = spark.createDataFrame([(4, "same words here", "s")] * 5 + [(None, "other words there", "t")] * 3, "doc_id bigint, text string, source string")
    assert sorted(r["text"] for r in simhash.keep_one(docs.repartition(3)).collect()) == ["other words there", "same words here"]
