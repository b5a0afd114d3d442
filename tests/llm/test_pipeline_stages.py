import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_simhash import brute_keep_one
from tests.llm.test_suffix_dedup import brute as brute_strings
from tracemill.llm import toxicity
from tracemill.llm.common import Scratch
from tracemill.llm.queries import tokenizer_path


def brute_lines(texts):
    """Texts without the later occurrences of windows of three full lines, in the order of ids."""
    seen, out = set(), {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        full = [k for k, line in enumerate(lines) if line.strip(" \t\n\x0b\f\r")]
        gone = set()
        for three in zip(full, full[1:], full[2:], strict=False):
            window = tuple(lines[k] for k in three)
            gone.update(three if window in seen else ())
            seen.add(window)
        out[i] = "\n".join(line for k, line in enumerate(lines) if k not in gone) if gone else texts[i]
    return out


def brute_ids(texts):
    """The ids of every document, the closing one included."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}


def test_stages(spark, sf_dir):
    """Each stage on its own input against a brute-force version; then the whole run against the last of these."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, columns = {r["doc_id"]: r["text"] or "" for r in docs.collect()}, docs.columns
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.learnable())).select("row.doc_id", "score").collect()}
    expected = {
        "toxicity": lambda texts: {i: t for i, t in texts.items() if scores[i] < 0.5},
        "line_dedup": brute_lines,
        "simhash_near_dedup": lambda texts: {i: texts[i] for i, _ in brute_keep_one(sorted(texts.items()))},
        "suffix_array_dedup": lambda texts: dict(zip(texts, (kept.decode("utf-8", "replace") for kept, _, _ in brute_strings([t.encode() for t in texts.values()], 200)), strict=True)),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark).save(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(after) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
        assert after == expected[name](before), name
        before = after
    wanted = brute_ids(before)
    for pieces in (corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), corpus_pipeline.run(spark, sf_dir).collect()):
        whole = {}
        for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
            held = whole.setdefault(p["doc_id"], [])
            ids = np.frombuffer(p["ids"], "<u4").tolist()
            assert p["start"] == len(held) and p["length"] == len(ids) and p["offset"] + p["length"] <= 1024
            held += ids
        assert whole == wanted
        filled = {}
        for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
            assert p["offset"] == filled.get(p["sequence_id"], 0)
            filled[p["sequence_id"]] = p["offset"] + p["length"]
        assert len(filled) == -(-sum(map(len, wanted.values())) // 1024)


def test_odd_rows(spark, odd, sf_dir):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark).save(stage(spark, docs, sf_dir))
    assert docs.where("length > 0").count() == docs.count()


def test_empty_tables(spark, empty, sf_dir):
    """No documents: every stage gives an empty table with its columns."""
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark).save(stage(spark, docs, sf_dir))
        assert docs.count() == 0
