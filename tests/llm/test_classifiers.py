"""Toxicity, language and quality: held-out accuracy, and counts against brute force."""

import re
import zlib

import numpy as np
import pytest

from tracemill.llm import language_id, quality_rules, toxicity
from tracemill.llm.queries import op3_language_id, op5_toxicity, op10_quality_rules

SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity_on_held_out_rows(spark):
    rows = op5_toxicity(spark, LARGE).collect()
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) >= 0.97
    scores = [[r["score"] for r in held if toxic[r["doc_id"]] == k] for k in (0, 1)]
    assert np.mean([a < b for a in scores[0] for b in scores[1]]) >= 0.97


def test_toxicity_learns_from_given_rows_only(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = (toxicity.train(docs, t, toxicity.learnable()) for t in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_toxicity_on_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (8, None), (4, 1), (6, 0), (12, 0)], "doc_id bigint, toxic int")
    for given in (none, labels):
        model = toxicity.train(odd, given)
        rows = toxicity.scored(odd, model)
        assert rows.select("row.*").columns == odd.columns and rows.count() == odd.count()
        assert rows.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.scored(empty, toxicity.train(empty, none)).count() == 0
    absent = spark.createDataFrame([(10**9, 1), (10**9 + 1, 0)], "doc_id bigint, toxic int")
    assert {round(r["score"], 6) for r in toxicity.scored(odd, toxicity.train(odd, absent)).collect()} == {0.5}
    assert toxicity.without_toxic(odd, none).columns == odd.columns


def test_languages_on_held_out_rows(spark):
    rows = op3_language_id(spark, SMALL).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"] and lang[r["doc_id"]]]) >= 0.95


def test_scripts_with_combining_marks_and_many_languages(spark, monkeypatch):
    assert language_id.plain("किताब की कीमत है, 12 நூல் ภาษาที่").decode() == "किताब की कीमत है நூல் ภาษาที่"
    words = {"hi": "किताब की कीमत है और यह अच्छी पुस्तक हमारे घर में", "mr": "पुस्तकाची किंमत आहे आणि हे चांगले पुस्तक आमच्या घरात", "th": "ภาษาไทยเป็นภาษาที่มีระดับเสียงและหนังสือเล่มนี้ดีมาก"}
    rows = [(k, f"{text} {text[k % 7 :]}", lang) for lang, text in words.items() for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language_id.identify(docs.select("text", "doc_id"), language_id.train(docs)).join(docs.select("doc_id").distinct(), "doc_id")
    counts = {r["lang_pred"]: r["count"] for r in found.groupBy("lang_pred").count().collect()}
    assert counts == {"hi": 30, "mr": 30, "th": 30}
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        language_id.train(docs)


def test_languages_of_odd_rows(spark, odd, empty):
    learnt = language_id.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert set(learnt) == {"de", "en", "es", "fr"}
    rows = language_id.identify(odd, learnt).collect()
    assert len(rows) == odd.count()
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert all(r["lang_pred"] in learnt for r in rows if r["doc_id"] in (4, 5, 8))
    assert language_id.train(empty) == {}
    assert {r["lang_pred"] for r in language_id.identify(odd, {}).collect()} == {"und"}
    assert language_id.identify(empty, learnt).count() == 0


def counts(text):
    words, places = WORD.findall(text), {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_against_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    ratios = quality_rules.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"))
    total = np.zeros((2, 1 << quality_rules.BUCKET_BITS))
    grams = {}
    for i, text in texts.items():
        raw = np.frombuffer(text.encode(), np.uint8)
        grams[i] = quality_rules.ngrams(quality_rules.words(raw, np.array([0, len(raw)])))[1]
        assert len(grams[i]) == max(0, 2 * len(WORD.findall(text)) - 1)
        np.add.at(total[0], grams[i], 1)
        if i in good:
            np.add.at(total[1], grams[i], 1)
    expected = total[0] * total[1].sum() / total[0].sum()
    assert np.allclose(ratios, np.log((total[1] + quality_rules.SHRINK) / (expected + quality_rules.SHRINK)))
    for r in op10_quality_rules(spark, sf_dir).collect():
        text = texts[r["doc_id"]]
        want = counts(text)
        assert tuple(r[n] for n in NAMES) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        ratio = ratios[grams[r["doc_id"]]].sum() / max(1, len(grams[r["doc_id"]]))
        assert r["base_failed"] == failed and r["ratio"] == pytest.approx(ratio, abs=1e-9)
        assert r["kept"] == (not failed and r["ratio"] >= quality_rules.MIN_RATIO)


def test_quality_keeps_labelled_good_texts(spark):
    rows = op10_quality_rules(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("n_words >= 50").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"])
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.05


def test_quality_of_odd_rows(odd, odd_rows, empty):
    trusted = odd.select("doc_id").where("doc_id in (5, 8)")
    ratios = quality_rules.fit(odd, trusted)
    got = sorted((r["row"]["doc_id"] or -1, *(r[n] for n in NAMES)) for r in quality_rules.assess(odd, ratios).collect())
    assert got == sorted((i or -1, *counts(t or "")) for i, t in odd_rows)
    assert not quality_rules.fit(empty, empty).any() and quality_rules.assess(empty, ratios).count() == 0


def test_trusted_ids_beyond_the_broadcast_limit(odd, monkeypatch):
    trusted = odd.select("doc_id").where("doc_id in (5, 8)")
    before = quality_rules.fit(odd, trusted)
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", 1)
    assert np.array_equal(quality_rules.fit(odd, trusted), before)
