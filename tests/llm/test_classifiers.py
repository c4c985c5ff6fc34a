"""Quality, toxicity and language: held-out accuracy, and defined results for odd rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textprep.llm import labelled, language, quality, toxicity
from textprep.llm.batches import ALNUM_WORD, LOWER, Words
from textprep.llm.labelled import flat


@pytest.fixture(scope="module")
def large(spark):
    folder = "/root/testdata/sf0.1"
    return [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]


def counted(found, labels, label):
    rows = found.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return np.array([[sum(r.predicted == p and r[label] == y for r in rows) for y in (0, 1)] for p in (0, 1)])


def test_quality(spark, large):
    found = quality.quality(spark, *large)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    table = counted(found, large[1], "quality")
    assert table[1, 1] >= 0.99 * table[:, 1].sum() and table[0, 0] >= 0.95 * table[:, 0].sum()
    kept = quality.drop_low_quality(spark, large[0], *large)
    assert kept.columns == large[0].columns
    assert kept.count() == found.where("predicted = 1").count()


def test_exact_neighbours(monkeypatch):
    """The vote is that of the nearest labelled vectors by plain cosines."""
    texts = [f"{'good fine text here' if i % 3 else 'BAD!! BAD!! ###'} {i} w{i % 7}".encode() for i in range(60)]
    labels = np.array([int(i % 3 > 0) for i in range(60)])
    model = quality.train(texts, labels)
    data, offsets = flat(texts[:20])
    cosines = model.latent(quality.counts(data, offsets)) @ model.vectors.T
    for row, score in zip(cosines, model.scores(data, offsets), strict=True):
        near = np.argsort(-row, kind="stable")[: quality.NEIGHBOURS]
        weight = np.maximum(row[near], 0).astype(float) ** quality.SHARPNESS
        assert abs(score - (weight * labels[near]).sum() / weight.sum()) < 1e-3


def test_toxicity(spark, large):
    found = toxicity.toxicity(spark, *large)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    table = counted(found, large[1], "toxic")
    assert table[1, 1] >= 0.9 * table[:, 1].sum() and table[1, 0] <= 0.03 * table[:, 0].sum()


def test_language(spark, large):
    found = language.predicted_languages(spark, large[0])
    rows = found.where("held_out").join(large[0].select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.995 * len(rows)


def test_bayes_matches_plain_counts():
    texts = ["Der Hund, der bellt", "the dog that barks", "le chien"]
    bucket, owner, lettered = language.grams([*texts, " 12 ", ""])
    assert lettered.tolist() == [True, True, True, False, False]
    plain = " ".join("".join(c if c.isalpha() else " " for c in texts[0].lower()).split())
    assert (owner == 0).sum() == sum(len(plain) - n + 1 for n in language.GRAMS)
    again, own, _ = language.grams(["der hund der BELLT"])
    assert sorted(again.tolist()) == sorted(bucket[owner == 0].tolist()) and not own.any()


def test_bayes_matches_plain_posterior():
    """Scores of a small model against products of probabilities, one n-gram after another."""
    random = np.random.default_rng(2)
    counts = random.integers(1, 50, (3, 1 << language.BUCKET_BITS)).astype(float)
    model = language.Model(["aa", "bb", "cc"], np.log(counts / counts.sum(1, keepdims=True)), np.log(np.array([0.5, 0.3, 0.2])))
    texts = ["Some words", "und noch mehr, 12 Wörter", "x", "漢字 kana"]
    names, top, rest, lettered = model.judged(texts)
    assert lettered.all()
    bucket, owner, _ = language.grams(texts)
    for i in range(len(texts)):
        plain = [math.log(p) + sum(math.log(counts[k, b] / counts[k].sum()) for b in bucket[owner == i]) for k, p in enumerate((0.5, 0.3, 0.2))]
        best = max(range(3), key=plain.__getitem__)
        assert names[i] == ["aa", "bb", "cc"][best]
        assert abs(1 / rest[i] - 1 / sum(math.exp(x - plain[best]) for x in plain)) < 1e-6


def test_more_languages_than_a_task_holds(monkeypatch):
    """Counters are given out and begun anew; their sums stay the same."""
    rows = pa.RecordBatch.from_arrays([pa.array(["abc abd"] * 40), pa.array([f"l{i % 20}" for i in range(40)])], ["text", "lang"])

    def summed():
        total = Counter()
        for batch in language._counts(iter([rows, rows])):
            for lang, bucket, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[lang, bucket] += n
        return total

    whole = summed()
    monkeypatch.setattr(language, "HELD_LANGUAGES", 3)
    assert summed() == whole and len({lang for lang, _ in whole}) == 20


def test_equally_near_rows_vote_in_order():
    """Thirty equal labelled texts, of which fifteen may vote: the first ones do."""
    texts = [b"one text that is there many times"] * 30 + [f"BAD!! ### {i} something else".encode() for i in range(10)]
    labels = np.array([1] * quality.NEIGHBOURS + [0] * (40 - quality.NEIGHBOURS))
    model = quality.train(texts, labels)
    assert model.scores(*flat([texts[0]] * 3)).tolist() == pytest.approx([1.0] * 3)


def test_network_matches_a_plain_forward_pass():
    """Embeddings, filters of each width and maxima, word by word."""
    texts = [b"some words of a text", b"one", b"", b"words words toxic words again and again"]
    net = toxicity.train([b"good words here", b"bad toxic words"] * 30, np.tile([0, 1], 30))
    words = Words(*flat(texts), ALNUM_WORD, LOWER)
    rows, counts = toxicity.features(words), words.counts
    found, first = net.logits(rows, counts), 0
    for i, n in enumerate(counts):
        vectors = [net.embeddings[r].sum(0).astype(float) for r in rows[first : first + n]]
        vectors += [np.zeros(toxicity.DIMENSIONS)] * (max(toxicity.WIDTHS) - 1)
        first += n
        tops = []
        for kernel, bias in zip(net.kernels, net.biases, strict=True):
            for f in range(toxicity.FILTERS):
                values = [sum(float(vectors[p + k] @ kernel[k][:, f]) for k in range(len(kernel))) + float(bias[f]) for p in range(n)]
                tops.append(max([0.0, *values]))
        assert abs(found[i] - (np.dot(tops, net.out) + net.shift)) < 1e-3


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (5, 0, 1), (6, 0, None), (7, None, 1), (8, 1, 0), (99, 1, 1), (None, 0, 0), (2, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    for given in (labels, labels.where("false"), labels.where("doc_id = 1")):
        for run in (quality.quality, toxicity.toxicity):
            rows = run(spark, odd_docs, given).collect()
            assert len(rows) == odd_docs.count()
            assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
            assert all(r.held_out for r in rows if r.doc_id is None)
            same = {r.doc_id: r.score for r in rows}
            assert same[2] == same[3] == same[4] and same[5] == same[6]
            assert run(spark, no_docs, given).count() == 0
    kept = quality.drop_low_quality(spark, odd_docs, odd_docs, labels)
    assert kept.columns == odd_docs.columns
    rows = language.predicted_languages(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all((r.lang_pred == "und" and r.score == 0) == (r.doc_id in (2, 3, 4)) for r in rows if r.doc_id is not None)
    assert language.predicted_languages(spark, no_docs).count() == 0
    unknown = language.predicted_languages(spark, odd_docs.withColumn("lang", odd_docs.lang.substr(9, 1).cast("string")).where("lang IS NULL"))
    assert all(r.lang_pred == "und" for r in unknown.collect())


def test_scores_do_not_read_other_columns(spark, odd_docs):
    """Another lang or source changes no score of quality or toxicity."""
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (8, 1, 0), (7, 0, 1)], "doc_id bigint, quality int, toxic int")
    other = odd_docs.replace({"en": "de", "a": "z"}, subset=["lang", "source"])
    for run in (quality.quality, toxicity.toxicity):
        assert sorted(map(str, run(spark, odd_docs, labels).collect())) == sorted(map(str, run(spark, other, labels).collect()))


def test_partitioning_does_not_matter(spark, large):
    few = large[0].where("doc_id < 400")
    for run in (quality.quality, toxicity.toxicity):
        one = {r.doc_id: round(r.score, 5) for r in run(spark, few.coalesce(1), large[1]).collect()}
        assert one == {r.doc_id: round(r.score, 5) for r in run(spark, few.repartition(7), large[1]).collect()}


def test_thresholds_by_language():
    random = np.random.default_rng(4)
    labels = np.tile([0, 1], 60)
    languages = np.repeat([0, 1, 2], 40)
    p = np.where(labels == 1, 0.7, 0.5) - 0.3 * (languages == 1) + random.normal(0, 0.01, 120)
    found = toxicity._thresholds(p, labels, languages)
    assert 0.55 < found[0] < 0.65 and 0.25 < found[1] < 0.35 and 0.55 < found[2] < 0.65


def test_more_languages_than_one_model_holds(spark, monkeypatch):
    """All 600 languages are learned, and blocks of them give what one model gives."""
    rows = [(9 * i + k, (chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i)) * 5, f"x{i:03}") for i in range(600) for k in range(9)]
    docs = spark.createDataFrame([*rows, (-1, "12", "x000"), (-2, None, "x001")], "doc_id bigint, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted_languages(spark, docs).collect()}
    assert found.pop(-1) == found.pop(-2) == ("und", 0.0)
    assert len(found) == len(rows) and sum(found[i][0] == lang for i, _, lang in rows) > 0.99 * len(rows)
    monkeypatch.setattr(language, "LANGUAGES_AT_ONCE", 600)
    whole = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted_languages(spark, docs).collect()}
    assert all(whole[i][0] == name and abs(whole[i][1] - score) < 1e-9 for i, (name, score) in found.items())


def test_toxicity_learns_from_every_labelled_text(spark, monkeypatch):
    """A word of one learned text of thousands is known: counts are those of all texts, in several shards and rounds."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 500)
    monkeypatch.setattr(toxicity, "VISITS", 100)
    n = 6000
    texts = [(i, f"some plain text with w{hashlib.md5(str(i // 2).encode()).hexdigest()} at the end") for i in range(n)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id div 2 % 2) AS toxic")
    table = labelled.labelled_texts(docs, labels, "toxic", ~labelled.held_out(4, 2))
    given = [(t, i // 2 % 2) for i, t in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    words = Words(*flat([t.encode() for t, _ in given]), ALNUM_WORD, LOWER)
    plain = toxicity._holders(toxicity._Texts(toxicity.features(words), words.counts, np.zeros(len(given)), np.array([y for _, y in given])))
    assert (toxicity._all_holders(table) == plain).all() and table.count() == len(given) > 2 * 1200
    net = toxicity.fit(docs, labels)
    again = toxicity.fit(docs.repartition(5), labels)
    assert (net.embeddings == again.embeddings).all() and net.shift == again.shift and (net.thresholds == again.thresholds).all()
    first = toxicity._network(5).embeddings
    moved = (net.embeddings[:, 1:] != first[:, 1:]).any(1)
    used = toxicity.features(words)[4::8, 0]
    assert len(used) == len(given) and moved[used].mean() > 0.5
