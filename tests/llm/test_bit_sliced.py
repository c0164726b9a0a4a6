import numpy as np
import pytest

from tidemark.llm import bit_sliced, queries

SF = "/root/testdata/sf0.001"


def _brute(rows, asked, k=5):
    usable = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in dict(sorted((i, tuple(v)) for i, v in usable if i in asked)).items():
        found = sorted((-int(np.array(v) @ w), i) for i, w in usable if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries.op9_bit_sliced(spark, SF).collect()))
    assert got == _brute(rows, {i for i, _ in rows if i % 50 == 0})


@pytest.mark.parametrize("block", [16384, 70])
def test_blocks_and_ties(spark, monkeypatch, block):
    monkeypatch.setattr(bit_sliced, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(300)]  # many equal scores
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, bit_sliced.top_k(df, df.where("vec_id % 7 = 0"), k=9).collect()))
    assert got == _brute(rows, set(range(0, 300, 7)), 9)


def test_edges(spark):
    rows = [(0, [0.5, -0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (50, [1.0, 2.0]), (100, [0.25]), (6, [-1.5, 0.001]), (None, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, bit_sliced.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    assert got == _brute(rows, {0, 50, 100})
    assert bit_sliced.top_k(df.limit(0), df.limit(0)).count() == 0


def test_bitmap_arithmetic():
    rng = np.random.default_rng(0)
    rows, query = rng.integers(-200, 200, (130, 9)), rng.integers(-90, 90, 9)
    slices, bits, least = bit_sliced.build(rows)
    score, offset = bit_sliced.score_slices(slices, least, query)
    plain = sum(np.unpackbits(p.view(np.uint8), bitorder="little")[:130].astype(np.int64) << i for i, p in enumerate(score))
    assert (plain - offset == rows @ query).all()


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(-2, 6, 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, bit_sliced.top_k(df, df.where("vec_id % 3 = 0")).collect()))
    assert got == _brute(rows, set(range(0, 90, 3)))


def test_only_what_leaves_64_bits_is_an_error(spark):
    def top(*rows):
        df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
        return sorted(map(tuple, bit_sliced.top_k(df, df).collect()))

    big = 2.0**54  # scaled: 2 ** 62
    assert top([big], [1 / 256], [-1 / 256]) == [(0, 1, 1, 2**62), (0, 2, 2, -(2**62)), (1, 1, 0, 2**62), (1, 2, 2, -1), (2, 1, 1, -1), (2, 2, 0, -(2**62))]
    with pytest.raises(Exception, match="64 bits"):
        top([big], [2 / 256])
    with pytest.raises(Exception, match="64 bits"):
        top([2.0**56], [0.0])
