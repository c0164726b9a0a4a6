import math
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = queries.op5_language(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(abs(sum(x.share for x in r.languages) - 1) < 1e-6 for r in rows if r.languages)


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_mixtures(spark, model):
    texts = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 2000 and 4000").collect()}
    (found,) = model.predict([texts["en"] + " " + texts["de"]])
    assert {a for a, _ in found} == {"en", "de"} and all(0.2 < b < 0.8 for _, b in found)
    assert [a for a, _ in model.predict([texts["fr"]])[0]][0] == "fr"


def test_edges(spark, model):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 34 !?", "x"), (4, "the and of that with", "x")], "id long, text string, score string")
    found = {r.id: r for r in language.identify(rows, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[1].score == 0.0
    assert found[4].lang_pred == "en"
    assert language.identify(rows.limit(0), model).count() == 0


def test_long_text_is_read_whole(model):
    half = "the and of that with this " * 40_000
    other = "der die und nicht eine schen " * 40_000
    (found,) = model.predict([half + other])
    assert {a for a, _ in found} >= {"en", "de"}


def test_without_labels(spark):
    rows = spark.createDataFrame([(1, "the and", None)], "doc_id long, text string, lang string")
    model = language.fit(rows)
    assert language.identify(rows, model).first().lang_pred == "und"


def test_prediction_takes_text_only(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    plain = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert plain == {r.doc_id: r.lang_pred for r in language.identify(other, model).collect()}


def _shares(model, text):
    """The mixture worked out letter by letter and word by word, with plain loops."""
    codes = [ord(c) if c.isalpha() else 1 for c in text.lower()]
    padded, words = [0, *codes, 0], []
    for i, c in enumerate(codes):
        if c != 1:
            x = (padded[i] * 0x9E3779B1 + padded[i + 1] * 0x85EBCA77 + padded[i + 2] * 0xC2B2AE3D) % 2**32
            x ^= x >> 15
            if not i or codes[i - 1] == 1:
                words.append([0.0] * len(model.languages))
            row = model.logp[((x * 0x27D4EB2F) % 2**32) >> 17]
            words[-1] = [a + float(b) for a, b in zip(words[-1], row)]
    if not words:
        return {}
    tops = [max(w) for w in words]
    likely = [[math.exp(max(x - t, -60.0)) for x in w] for w, t in zip(words, tops)]

    def em(share, rounds):
        for _ in range(rounds):
            total = [0.0] * len(share)
            for row in likely:
                joint = [a * b for a, b in zip(share, row)]
                total = [a + b / sum(joint) for a, b in zip(total, joint)]
            new = [a / len(likely) for a in total]
            moved, share = max(abs(a - b) for a, b in zip(share, new)), new
            if moved < language.SETTLED:
                break
        return share, sum(math.log(sum(a * b for a, b in zip(share, row))) for row in likely)

    share, _ = em([1.0 / len(model.languages)] * len(model.languages), language.ROUNDS)
    order = sorted(range(len(share)), key=lambda i: -share[i])
    best, chosen = -math.inf, []
    for k in range(1, len(order) + 1):
        begin = [(share[i] + 1e-6) * (i in order[:k]) for i in range(len(share))]
        part, loglik = em([b / sum(begin) for b in begin], language.SET_ROUNDS if k > 1 else 0)
        value = sum(tops) + loglik - (k - 1) / 2 * math.log(len(words) + 1.0)
        if value <= best + 1e-9:
            break
        best, chosen = value, part
    return {model.languages[i]: s for i, s in enumerate(chosen) if s > 0}


def test_mixtures_against_brute_force(spark, model):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500").limit(60).collect()
    texts = [r.text for r in rows] + [a.text[:400] + " " + b.text[:400] for a, b in zip(rows[:20], rows[20:40])] + ["", "1 2", "é", "the der"]
    for text, found in zip(texts, model.predict(texts), strict=True):
        want = _shares(model, text)
        assert {k for k, v in found if v > 1e-9} == {k for k, v in want.items() if v > 1e-9}
        assert all(abs(v - want[k]) < 1e-6 for k, v in found if v > 1e-9)


def test_repeated_rows_ties_and_clashing_names(spark, model):
    words = "the and of that with this"
    rows = spark.createDataFrame([(1, words, "x", "y", "z"), (1, words, "x", "y", "z"), (2, words, None, None, None)], "id long, text string, languages string, _in_text string, lang_pred string")
    found = language.identify(rows, model)
    assert found.columns == ["id", "text", "_in_text", "languages", "lang_pred", "score"]
    got = found.collect()
    assert len(got) == 3 and len({(r.lang_pred, r.score) for r in got}) == 1
    # Languages that are learnt from the same texts are equally likely: the first by name is taken, always.
    both = spark.createDataFrame([(i, words + f" word{i % 5}", lang) for i in range(20) for lang in ("bb", "aa")], "doc_id long, text string, lang string")
    tied = language.fit(both)
    assert [p[0][0] for p in tied.predict([words] * 3)] == ["aa"] * 3
