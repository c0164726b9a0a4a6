import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import ngram_join, queries

SF = "/root/testdata/sf0.001"


def _grams(text):
    import re

    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return set()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def _brute(docs, threshold=0.8):
    """class_id, n_links and copy_of of each row, by comparing all pairs of texts."""
    sets = [(d, _grams(t)) for d, t in docs]
    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(i)
    common = defaultdict(int)
    for held in holders.values():
        for x, i in enumerate(held):
            for j in held[:x]:
                common[j, i] += 1
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, copies = [0] * len(sets), [{i} for i in range(len(sets))]
    for (i, j), n in common.items():
        union = len(sets[i][1]) + len(sets[j][1]) - n
        if n / union >= threshold:
            links[i] += 1
            links[j] += 1
            parent[root(j)] = root(i)
            if n == union:
                copies[i].add(j)
                copies[j].add(i)
    smallest = {}
    for i, (d, _) in enumerate(sets):
        smallest[root(i)] = min(smallest.get(root(i), d), d)
    return sorted((d, smallest[root(i)], links[i], min(sets[c][0] for c in copies[i])) for i, (d, _) in enumerate(sets))


def _rows(df):
    return sorted((r.doc_id, r.class_id, r.n_links, r.copy_of) for r in df.collect())


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert _rows(queries.op1_ngram_join(spark, SF)) == _brute(docs)


def _family(seed, n, words=120, edits=6):
    """Near copies of one text with different words changed, and unrelated texts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_hot_group_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = _family(1, 60) + _family(2, 5) + [_family(1, 1)[0]] * 20
    docs = list(enumerate(texts))
    random.Random(3).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert _rows(ngram_join.join(df)) == _brute(docs)


def test_edges(spark):
    words = "one two three four five six seven"
    docs = [(5, words), (5, words), (9, words.upper() + "!"), (3, None), (4, ""), (8, "?"), (6, "two words"), (7, "two  words"), (5, "quite another text with more words"), (2, "a b")]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id long, text string, class_id string, grams string")
    assert _rows(ngram_join.join(df)) == _brute(docs)
    null = spark.createDataFrame([(None, words), (1, words)], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.join(null).collect()), key=str) == sorted([(None, None, None, None), (1, 1, 0, 1)], key=str)
    assert ngram_join.join(df.limit(0)).count() == 0


def test_recall_of_the_forest(spark):
    """Links near the threshold, in many small families."""
    texts = [t for s in range(150) for t in _family(s, 3, words=60, edits=3)]
    docs = list(enumerate(texts))
    brute = _brute(docs)
    rows = _rows(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")))
    assert sum(r[2] for r in rows) >= 0.999 * sum(r[2] for r in brute)


def test_signatures_estimate_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(101, 1101, dtype=np.uint64)
    x, y = (np.frombuffer(ngram_join.signature(ngram_join._mix(s)), "<u2") for s in (a, b))
    assert abs((x == y).mean() - 900 / 1100) < 0.15
    assert ngram_join.found_share(0.8, 4) > 0.9999 > ngram_join.found_share(0.8, 6)


def test_a_hot_group_hides_no_link_near_the_threshold(spark):
    """Pairs at 0.806 that share no whole label, beside a group whose links all are found by whole labels."""
    rng = random.Random(5)
    pairs = []
    while len(pairs) < 6:
        words = [f"w{rng.randrange(10**9)}" for _ in range(60)]
        other = [*words[:30], "x", "y", *words[32:]]
        a, b = (np.frombuffer(ngram_join.signature(ngram_join.ngrams(" ".join(t))), "<u2").reshape(ngram_join.TREES, -1) for t in (words, other))
        if not (a == b).all(axis=1).any():
            pairs += [" ".join(words), " ".join(other)]
    hot = [f"h{i}" for i in range(300)]
    copies = [" ".join([*hot[:50], f"x{i}", *hot[51:]]) for i in range(40)]
    docs = list(enumerate(copies + pairs))
    assert _rows(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"))) == _brute(docs)


def test_long_texts_make_blocks_by_their_ngrams(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 4000)
    texts = _family(7, 6, words=3000, edits=20) + _family(8, 3)
    docs = list(enumerate(texts))
    assert _rows(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"))) == _brute(docs)


def test_only_texts_of_members_are_shuffled(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "rid")
    filters, bits = ngram_join.member_filter(keys, "rid", 1000)
    rows = spark.range(3000).withColumnRenamed("id", "doc")
    kept = {r.doc for r in ngram_join.maybe_members(rows, "doc", filters, bits).where("_maybe").collect()}
    assert kept >= set(range(0, 3000, 3)) and len(kept) < 1150
    none, bits = ngram_join.member_filter(keys.limit(0), "rid", 0)
    assert ngram_join.maybe_members(rows, "doc", none, bits).where("NOT _maybe").count() == 3000
