from collections import Counter

import numpy as np
import pytest

from tidemark.llm import cover_tree, queries

SF = "/root/testdata/sf0.001"


def _brute(rows, cosine=0.98):
    def valid(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a == b and valid(v, a) and valid(w, b) and len(v) == len(w):
                x, y = np.array(v, np.float64), np.array(w, np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i, (k, *_) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return sorted((k, links[i], least[root(i)], k == least[root(i)]) for i, (k, *_) in enumerate(rows))


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert _rows(queries.op6_cover_tree(spark, SF)) == _brute(rows)


def _cluster(rng, n, spread, dim=16):
    centre = rng.normal(size=dim)
    return [(centre / np.linalg.norm(centre) + rng.normal(size=dim) * spread).astype(np.float32).tolist() for _ in range(n)]


@pytest.mark.parametrize("cell", [2048, 20])
def test_clusters_and_splits(spark, monkeypatch, cell):
    monkeypatch.setattr(cover_tree, "CELL", cell)
    rng = np.random.default_rng(5)
    vectors = _cluster(rng, 60, 0.03) + _cluster(rng, 40, 0.005) + _cluster(rng, 40, 0.06) + [rng.normal(size=16).astype(np.float32).tolist() for _ in range(40)]
    vectors += [vectors[0]] * 15
    rows = [(i, v, 1 if i % 5 else 2) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert _rows(cover_tree.near_duplicates(df)) == _brute(rows)


def test_edges(spark):
    a, b = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0]
    rows = [(9, a, 1), (4, b, 1), (5, [2.0, 0.0, 0.0], 1), (6, a, 2), (7, a, None), (8, None, 1), (3, [0.0, 0.0, 0.0], 1), (2, [None, 1.0, 0.0], 1), (1, [float("nan"), 0.0, 1.0], 1), (10, [float("inf"), 0.0, 0.0], 1), (11, [], 1), (12, [1.0, 0.0], 1), (9, a, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, component_id string")
    assert _rows(cover_tree.near_duplicates(df)) == _brute(rows)
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, a, 1), (1, a, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(r.n_links for r in cover_tree.near_duplicates(null).collect()) == [0, 0]


def test_tree_covers_and_halves():
    rng = np.random.default_rng(1)
    points = np.array(_cluster(rng, 200, 0.1) + _cluster(rng, 200, 0.01))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    todo = [(cover_tree.build(points), 2.0)]
    seen = 0
    while todo:
        node, _ = todo.pop()
        far = np.linalg.norm(points[node.members] - points[node.centre], axis=1)
        assert far.max() <= node.radius + 1e-6 and node.centre in node.members
        if node.children:
            assert sorted(m for c in node.children for m in c.members) == sorted(node.members)
            assert all(c.radius <= node.radius + 1e-9 for c in node.children)
        seen += 1
        todo += [(c, 0) for c in node.children]
    assert seen > 10


def test_small_cells_with_few_centres_and_parallel_vectors(spark, monkeypatch):
    """Two centres a split, visitors dealt over units, and vectors that no centre tells apart."""
    monkeypatch.setattr(cover_tree, "CELL", 20)
    monkeypatch.setattr(cover_tree, "CENTRES", 2)
    monkeypatch.setattr(cover_tree, "VISITORS", 7)
    rng = np.random.default_rng(8)
    vectors = _cluster(rng, 50, 0.02) + [(np.array([1.0, 0.5] + [0.0] * 14) * (i + 1)).tolist() for i in range(60)] + [rng.normal(size=16).astype(np.float32).tolist() for _ in range(60)]
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert _rows(cover_tree.near_duplicates(df)) == _brute(rows)


@pytest.mark.parametrize(("spread", "leaf", "descent"), [(0.01, 4, 10**9), (0.03, 4, 1), (0.06, 128, 1000)])
def test_traversal_against_all_pairs(monkeypatch, spread, leaf, descent):
    """Nodes taken whole, dense comparisons and descents give the same counts."""
    monkeypatch.setattr(cover_tree, "LEAF", leaf)
    monkeypatch.setattr(cover_tree, "DESCENT", descent)
    rng = np.random.default_rng(3)
    vectors = np.array(_cluster(rng, 300, spread) + _cluster(rng, 200, spread / 4) + [rng.normal(size=16).tolist() for _ in range(300)])
    copies = rng.integers(1, 4, len(vectors))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    side = cover_tree.Side(np.arange(len(vectors)), copies, vectors)
    links = cover_tree.Links(0.98)
    links.traverse(side, side)
    assert (side.links == near @ copies).all()
    a, b = (cover_tree.Side(np.flatnonzero(m), copies[m], vectors[m]) for m in (np.arange(len(vectors)) % 3 == 0, np.arange(len(vectors)) % 3 > 0))
    cover_tree.Links(0.98).traverse(a, b)
    assert (a.links == near[np.ix_(a.ids, b.ids)] @ b.copies).all() and (b.links == near[np.ix_(b.ids, a.ids)] @ a.copies).all()
    label = np.arange(len(vectors))
    for x, y in links.edges:
        label[label == label[x]] = label[y]
    want = np.arange(len(vectors))
    for _ in range(len(vectors)):
        new = np.where(near, want[None, :], len(vectors)).min(axis=1)
        if (np.minimum(want, new) == want).all():
            break
        want = np.minimum(want, new)
    assert len(set(label)) == len(set(want))


@pytest.mark.parametrize("dim", [2, 16, 64, 768])
def test_projections_bound_cosines_from_above(dim):
    rng = np.random.default_rng(dim)
    points = rng.normal(size=(200, dim))
    points = np.vstack([points, points[:50] + rng.normal(size=(50, dim)) * 0.05])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    bound = cover_tree._projected(points)
    assert (bound @ bound.T >= points @ points.T - cover_tree.COARSE).all()
