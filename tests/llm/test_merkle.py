import hashlib
import zlib

import pytest

from tools.check import compare
from tracemill.llm import merkle
from tracemill.llm.queries import ORACLE, op12_merkle_manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """The root, and for every node its siblings (None if there is none) with whether they come before."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, at in enumerate(places):
            other = level[at ^ 1] if at ^ 1 < len(level) else ""
            paths[k].append((other, bool(at & 1)))
            places[k] = at // 2
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def brute(rows):
    """Of ``(group, key, leaf)``: group, key, leaf, subroot, root, path."""
    first = lambda x: (x is not None, "" if x is None else x)
    groups = {}
    for g, key, leaf in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), r[2])):
        groups.setdefault(g, []).append((key, leaf))
    names = sorted(groups, key=first)
    found = {g: climb([leaf for _, leaf in groups[g]]) for g in names}
    root, over = climb([found[g][0] for g in names])
    return [(g, key, leaf, found[g][0], root, found[g][1][i] + over[k]) for k, g in enumerate(names) for i, (key, leaf) in enumerate(groups[g])]


def test_query_equals_sql(spark, duck, sf_dir):
    ok, note = compare(spark, duck, op12_merkle_manifest, ORACLE["op12_merkle_manifest"], sf_dir)
    assert ok, note


@pytest.mark.parametrize("bits", [1, 2, 9])
def test_against_brute_force(spark, monkeypatch, bits):
    """Blocks of two and four nodes, so that proofs pass several rounds; groups of every small size."""
    monkeypatch.setattr(merkle, "BITS", bits)
    monkeypatch.setattr(merkle, "BLOCK", 1 << bits)
    sizes = {"a": 1, "b": 2, "c": 3, "É": 4, "d": 5, "e": 17, "f": 64, "g": 33, None: 9, "": 6}
    rows = [(g, k if k % 5 else None, H(str(g), str(k))) for g, n in sizes.items() for k in range(n)]
    rows += [("e", 3, H("again")), ("e", 3, H("again")), (None, None, H("x"))]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "grp string, key int, leaf string, data int").repartition(7)
    got = [(r["grp"], r["key"], r["leaf"], r["subroot"], r["root"], [(s["sibling"], s["before"]) for s in r["path"]]) for r in merkle.manifest(frame).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_folding_finds_tampered_leaves(spark):
    rows = [(str(k % 3), k, H(str(k)), None) for k in range(40)]
    made = merkle.manifest(spark.createDataFrame(rows, "grp string, key int, leaf string, data string"))
    right, wrong = made.select("root", merkle.fold(made["leaf"], made["path"]).alias("r"), merkle.fold(merkle.leaf(made["leaf"]), made["path"]).alias("w")), 0
    for r in right.collect():
        assert r["r"] == r["root"] != r["w"]


def test_document_rows(spark, odd, odd_rows, empty):
    tampered = merkle.F.crc32(merkle.F.col("doc_id").cast("string")) % 7 == 0
    rows = merkle.document_manifest(odd, tampered).collect()
    piece = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(i, text, k, add=0):
        n = None if text is None else len(text) + add
        return H(*map(piece, (i, f"src{k % 2}", "en", n, text)))

    want = [(i, leaf(i, t, k), leaf(i, t, k, 1) if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else None) for k, (i, t) in enumerate(odd_rows)]
    assert sorted([(r["key"], r["leaf"], r["data"]) for r in rows], key=repr) == sorted(want, key=repr)
    assert len({r["root"] for r in rows}) == 1
    assert merkle.document_manifest(empty, tampered).count() == 0


def test_no_python_on_the_path(spark, sf_dir):
    plan = op12_merkle_manifest(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
