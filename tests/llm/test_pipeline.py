import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import language, ngram_join, secrets

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert docs.columns == COLUMNS
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == COLUMNS
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_against_brute_force(spark):
    """The stages again on the driver: the model's predictions, all pairs of texts, the scan, and the library's ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.where(~language.is_held_out(docs.doc_id)))
    rows = docs.collect()
    kept = [r for r, found in zip(rows, model.predict([r.text for r in rows])) if found and found[0][1] >= corpus_pipeline.LEAST_SHARE]
    grams = {r.doc_id: set(ngram_join.ngrams(r.text).tolist()) for r in kept}
    parent = {d: d for d in grams}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(grams)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(grams[a] & grams[b])
            if both and both / (len(grams[a]) + len(grams[b]) - both) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in kept:
        if root(r.doc_id) == r.doc_id:
            text = r.text and secrets.redacted(r.text, secrets.find_spans(r.text), "[SECRET]")
            want[r.doc_id] = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    assert sum(r.length for r in got) == sum(map(len, want.values()))


def test_repeated_rows_and_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = "the and of that with this from for are was"
    rows = [(1, words, "en", "s", 1), (1, words, "en", "s", 1), (2, words + " more", None, None, None), (None, "der die und nicht", "de", "s", 1), (3, None, "en", "s", 0), (4, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.language_stage(spark, docs, SF)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 2] and kept.where("lang IS NULL").count() == 0
    one = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    # 5 of 2's 6 n-grams are 1's, of which there are 5: linked at 0.83.
    assert sorted((r.doc_id or 0) for r in one.collect()) == [0, 1, 3, 4]
    assert corpus_pipeline.secret_stage(spark, docs, SF).count() == 6
    assert corpus_pipeline.packing_stage(spark, docs, SF).count() >= 6


def test_near_duplicates_among_rows_that_share_an_id(spark):
    a, b = "one two three four five six seven", "quite another text with more words in it"
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (3, b, "en", "s", 1), (4, None, "en", "s", 0), (4, None, "en", "s", 0), (None, a, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert kept.columns == COLUMNS and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (2, b), (4, None), (None, a)], key=str)


def test_an_id_of_two_texts_loses_only_its_copy(spark):
    """Row 3 and a near copy of it under the id 5, which another text has too."""
    words = [f"w{i}" for i in range(60)]
    a, near, other = " ".join(words), " ".join([*words[:30], "x", *words[31:]]), "a wholly different text of its own with several words"
    docs = spark.createDataFrame([(3, a, "en", "s", 1), (5, near, "en", "s", 1), (5, other, "en", "s", 1)], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()) == [(3, a), (5, other)]


def test_which_of_repeated_rows_stays(spark):
    words = "one two three four five six seven"
    rows = [(1, words, "fr", "b", 9), (1, words, None, "z", 7), (1, words, "de", "a", 8), (2, "?!", "y", "q", 2), (2, "?!", "x", "r", 3), (2, None, "x", "r", 3), (2, None, "x", "r", 3)]
    for order in (rows, rows[::-1]):
        kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(order, SCHEMA).repartition(2), SF).collect()
        assert sorted(map(tuple, kept), key=str) == sorted([(1, words, None, "z", 7), (2, "?!", "x", "r", 3), (2, None, "x", "r", 3)], key=str)


def test_clashing_names_and_long_texts(spark):
    long = "the and of that with this from for are was " * 30_000
    base = spark.createDataFrame([(1, long, "en", "s", 1), (2, long + "more", "en", "s", 1), (3, "der die und nicht eine schen und der die das", "de", "s", 1)], SCHEMA)
    from pyspark.sql import functions as F

    extra = ["score", "lang_pred", "_row", "n_links", "class_id", "_in_text", "secrets", "doc", "_maybe", "_bitmap"]
    docs = base.select("*", *[F.lit(f"own {c}").alias(c) for c in extra])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in out.collect() for c in extra)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3] and len(next(r.text for r in kept if r.doc_id == 1)) == len(long)
    pieces = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3} and max(r.length for r in pieces) == 2048


def test_the_language_stage_sends_texts_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = corpus_pipeline.language_stage(spark, docs, SF)._jdf.queryExecution().analyzed()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head()
    assert plan.children().head().schema().json().count('"string"') == 3  # text, lang and source
