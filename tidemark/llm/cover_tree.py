"""Exact near-duplicates of embeddings by dual traversal of cover trees.

Vectors with the same label are compared; on the unit sphere a cosine of at least c is a
distance of at most sqrt(2 - 2c). The upper levels are built as tables: a group with more
than CELL members is split by the CENTRES of its members that a hash puts first, each
vector going to the nearest one (among equally near ones, to one by its hash), until no
group is larger. A vector also visits a cell of a later centre while the bisector of the two
is no farther than the threshold and the cell's covering radius allows a neighbour there.
So each pair within the threshold meets in exactly one cell, the one that is home to the
vector whose centre comes later. Inside a cell a cover tree with halving radii is
traversed against itself and against the visitors, who are dealt over several tasks where
they are many: node pairs farther apart than their covering radii and the threshold are
pruned, pairs that lie within it altogether are counted whole, and the others descend.
Nodes of one vector are told apart by projections first. Where most of a pair of nodes
would descend, and at the leaves, vectors are compared by the exact cosine in double
precision.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import drop, join_hot, materialize
from tidemark.llm.components import components

COSINE = 0.98
#: Members of a cell that one task holds, the centres that split a larger one, and a cell's visitors in one task.
CELL = 16384
CENTRES = 16
VISITORS = 4 * CELL
LEAF = 128
#: Compared pairs that take about as long as one pair of nodes that descends.
DESCENT = 1000
_ROWS = 512
#: Room for rounding in every bound; pairs this near the threshold are always compared themselves.
MARGIN = 1e-6
#: The same for bounds and radii in single precision: on a cosine, and on the square of a distance.
COARSE = 1e-5
#: Dimensions of the projection that bounds a cosine from above, and nodes that need not be told apart any more.
PROJECTED = 16
FINE = 0.01


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Node:
    """A centre, the members that it covers with their largest distance, and its children."""

    __slots__ = ("centre", "radius", "members", "children", "_centres", "_radii")

    def __init__(self, centre: int, radius: float, members: np.ndarray) -> None:
        self.centre, self.radius, self.members = centre, radius, members
        self.children: list[Node] = []


def build(points: np.ndarray) -> Node:
    """A cover tree of unit vectors: the children of a node cover its members at half the node's scale.

    Distances may be in single precision: radii are given a little room, so that they cover.
    """
    every = np.arange(len(points))
    root = Node(0, _distance((points @ points[0]).min()), every)
    todo = [(root, 2.0)]
    while todo:
        node, scale = todo.pop()
        if len(node.members) <= LEAF or node.radius < FINE:
            continue
        while scale / 2 >= node.radius:
            scale /= 2
        bound = 1.0 - (scale / 2) ** 2 / 2
        left = np.concatenate([[node.centre], node.members[node.members != node.centre]])
        step = LEAF // 4
        while len(left):  # the next centre is the first that none covers; so many of them are compared at once
            step = min(4 * LEAF, 2 * step)
            cosines = points[left[:step]] @ points[left].T
            free = np.ones(len(left), dtype=bool)
            for b in range(len(cosines)):
                if free[b]:
                    inside = free & (cosines[b] >= bound)
                    inside[b] = True
                    free &= ~inside
                    covered = left[inside]
                    child = Node(int(left[b]), _distance(cosines[b][inside].min()) if len(covered) > 1 else 0.0, covered)
                    node.children.append(child)
                    todo.append((child, scale / 2))
            left = left[free]
    return root


def _distance(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine) + COARSE))


_bases: dict[int, np.ndarray] = {}


def _projected(points: np.ndarray) -> np.ndarray:
    """Each unit vector's part in PROJECTED directions, and the length of the rest of it.

    Products of these are at least the vectors' cosines (Cauchy and Schwarz).
    """
    dim = points.shape[1]
    if dim not in _bases:
        _bases[dim] = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, min(dim, PROJECTED))))[0]
    part = points @ _bases[dim]
    rest = np.sqrt(np.maximum(0.0, 1.0 - (part**2).sum(axis=1)))
    return np.hstack([part, rest[:, None]]).astype(np.float32)


def _open(node: Node, points: np.ndarray) -> tuple[list[Node], np.ndarray, np.ndarray]:
    """The nodes that stand for this one a level lower, their centres and radii; a leaf's are its members."""
    if not node.children:
        nodes = [Node(int(m), 0.0, node.members[i : i + 1]) for i, m in enumerate(node.members)]
    else:
        nodes = node.children
    return nodes, points[[n.centre for n in nodes]], np.array([n.radius for n in nodes])


class Links:
    """Counts links and joins what they connect while two trees are traversed."""

    def __init__(self, cosine: float) -> None:
        self.cosine = cosine
        self.reach = float(np.sqrt(2.0 - 2.0 * cosine))
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def connect(self, a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            if (x := self._root(a)) != (y := self._root(b)):
                self.parent[max(x, y)] = min(x, y)
                self.edges.append((a, b))

    def traverse(self, a: Side, b: Side) -> None:
        """Link all pairs of a member of a and one of b; a is b to link a set with itself."""
        todo = [(a.tree, b.tree)]
        while todo:
            x, y = todo.pop()
            if len(x.members) * len(y.members) <= LEAF * LEAF or not (x.children or y.children):
                self._compare(a, x.members, b, y.members, x is y)
                continue
            left, cx, rx = ([x], a.points[[x.centre]], np.array([x.radius])) if not x.children else _open(x, a.points)
            right, cy, ry = (left, cx, rx) if x is y else ([y], b.points[[y.centre]], np.array([y.radius])) if not y.children else _open(y, b.points)
            # Most nodes of spread-out vectors have one member; they need no descent.
            groups = [np.array([i for i, n in enumerate(nodes) if len(n.members) > 1], dtype=np.int64) for nodes in (left, right)]
            singles = [np.array([i for i, n in enumerate(nodes) if len(n.members) == 1], dtype=np.int64) for nodes in (left, right)]
            most = len(x.members) * len(y.members) // DESCENT
            if (found := self._near(cx, rx, cy, ry, groups[0], groups[1], x is y, most)) is None:
                self._compare(a, x.members, b, y.members, x is y)
                continue
            for i, j, whole in zip(*found):
                m, n = left[i], right[j]
                if whole and m is not n:
                    self._whole(a, m.members, b, n.members)
                elif m is n and 2 * m.radius <= self.reach - MARGIN:
                    self._within(a, m.members)
                else:
                    todo.append((m, n))
            alone = [np.array([nodes[i].centre for i in some], dtype=np.int64) for nodes, some in zip((left, right), singles)]
            self._beside(a, left, groups[0], b, alone[1])
            if x is not y:
                self._beside(b, right, groups[1], a, alone[0])
            self._singles(a, alone[0], b, alone[1], x is y)

    def _beside(self, a: Side, nodes: list[Node], groups: np.ndarray, b: Side, alone: np.ndarray) -> None:
        """Link members of nodes with single vectors; those near a node are compared with all of it."""
        for i in groups if len(alone) else ():
            node = nodes[i]
            far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (b.points[alone] @ a.points[node.centre])))
            near = alone[far - node.radius <= self.reach + COARSE]
            if len(near):
                self._compare(b, near, a, node.members, False)

    def _singles(self, a: Side, x: np.ndarray, b: Side, y: np.ndarray, same: bool) -> None:
        """Link vectors with each other: those whose projections allow it are compared."""
        for at in range(0, len(x), _ROWS):
            part, others = x[at : at + _ROWS], x[at:] if same else y
            near = a.projected[part] @ b.projected[others].T >= self.cosine - COARSE
            if same:
                near[:, : len(part)] &= np.arange(len(part))[:, None] < np.arange(len(part))[None, :]
            i, j = np.nonzero(near)
            if len(i) * 256 > near.size:
                self._block(a, part, b, others, same)
            elif len(i):
                i, j = part[i], others[j]
                linked = np.einsum("ij,ij->i", a.rows[i], b.rows[j]) / (a.norms[i] * b.norms[j]) >= self.cosine
                i, j = i[linked], j[linked]
                np.add.at(a.links, i, b.copies[j])
                np.add.at(b.links, j, a.copies[i])
                for p, q in zip(i, j):
                    self.connect(int(a.ids[p]), b.ids[[q]])

    def _near(self, cx: np.ndarray, rx: np.ndarray, cy: np.ndarray, ry: np.ndarray, some: np.ndarray, others: np.ndarray, same: bool, most: int) -> tuple[list, list, list] | None:
        """Pairs of nodes that may hold links, and whether all of theirs are; None if there are too many to descend."""
        rows, columns, wholes = [], [], []
        count = 0
        for at in range(0, len(some), _ROWS):
            part = some[at : at + _ROWS]
            far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (cx[part] @ cy[others].T)))
            sums = rx[part, None] + ry[None, others]
            near = far - sums <= self.reach + COARSE
            if same:
                near &= np.arange(at, at + len(far))[:, None] <= np.arange(len(others))[None, :]
            i, j = np.nonzero(near)
            count += len(i) - (len(far) if same else 0)
            if count > most:
                return None
            rows += part[i].tolist()
            columns += others[j].tolist()
            wholes += (far[i, j] + sums[i, j] <= self.reach - COARSE).tolist()
        return rows, columns, wholes

    def _whole(self, a: Side, x: np.ndarray, b: Side, y: np.ndarray) -> None:
        a.links[x] += b.copies[y].sum()
        b.links[y] += a.copies[x].sum()
        self.connect(int(b.ids[y[0]]), a.ids[x])
        self.connect(int(a.ids[x[0]]), b.ids[y])

    def _within(self, a: Side, x: np.ndarray) -> None:
        a.links[x] += a.copies[x].sum() - a.copies[x]
        self.connect(int(a.ids[x[0]]), a.ids[x[1:]])

    def _compare(self, a: Side, x: np.ndarray, b: Side, y: np.ndarray, same: bool) -> None:
        for at in range(0, len(x), _ROWS):
            self._block(a, x[at : at + _ROWS], b, x[at:] if same else y, same)

    def _block(self, a: Side, x: np.ndarray, b: Side, y: np.ndarray, same: bool) -> None:
        """Compare all pairs; of a set with itself (y begins with x) those that come later in it."""
        linked = (a.rows[x] @ b.rows[y].T) / (a.norms[x][:, None] * b.norms[y][None, :]) >= self.cosine
        if same:
            linked[:, : len(x)] &= np.arange(len(x))[:, None] < np.arange(len(x))[None, :]
        hit = np.flatnonzero(linked.any(axis=1))
        if len(hit):
            linked, x = linked[hit], x[hit]
            a.links[x] += linked @ b.copies[y]
            b.links[y] += a.copies[x] @ linked
            self._join(a.ids[x], b.ids[y], linked)

    def _join(self, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> None:
        """Connect what a matrix of links connects, by few edges."""
        ids = np.concatenate([left, right])
        label = np.arange(len(ids))
        marked = np.zeros(len(ids), dtype=bool)
        for r, row in enumerate(linked):
            held = label[np.append(np.flatnonzero(row) + len(left), r)]
            least = held.min()
            if (held != least).any():
                marked[held] = True
                label[marked[label]] = least
                marked[held] = False
        changed = np.flatnonzero(label != np.arange(len(ids)))
        order = changed[np.argsort(label[changed], kind="stable")]
        cuts = np.flatnonzero(np.diff(label[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            self.connect(int(ids[label[group[0]]]), ids[group])


class Side:
    """The vectors of a cell that are at home in it, or some that visit it."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.copies, self.rows = ids, copies, rows
        self.norms = np.linalg.norm(rows, axis=1)
        unit = rows / self.norms[:, None]
        self.points = unit.astype(np.float32)
        self.projected = _projected(unit)
        self.links = np.zeros(len(ids), dtype=np.int64)
        self.tree = build(self.points)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cells(cosine: float):
    """Links inside each unit, a cell with some of its visitors, from rows sorted by unit with those at home first."""
    types = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts = None, []
        first = False
        home: Side | None = None
        links = Links(cosine)

        def settle() -> Side:
            """All of the cell's home vectors are here: link them, in the first of its units."""
            ids, copies, rows = (np.concatenate(x) for x in zip(*parts))
            side = Side(ids, copies, rows)
            if first:
                links.traverse(side, side)
            return side

        def told(side: Side) -> pa.RecordBatch:
            edges, links.edges = links.edges, []
            some = np.flatnonzero(side.links)
            ids, counts = side.ids[some].tolist(), side.links[some].tolist()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids + [e[0] for e in edges], [None] * len(ids) + [e[1] for e in edges], counts + [0] * len(edges))], schema=types)

        for batch in batches:
            if not batch.num_rows:
                continue
            units = batch.column(0).to_numpy()
            at_home = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((units[1:] != units[:-1]) | (at_home[1:] != at_home[:-1])) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(units)]):
                if units[begin] != unit:
                    if parts:
                        yield told(home or settle())
                    unit, parts, home, links = units[begin], [], None, Links(cosine)
                    first = batch.column(2)[int(begin)].as_py()
                part = batch.slice(begin, end - begin)
                piece = part.column(3).to_numpy(), part.column(4).to_numpy(), _vectors(part.column(5))
                if at_home[begin]:
                    parts.append(piece)
                else:
                    home = home or settle()
                    visitors = Side(*piece)
                    links.traverse(visitors, home)
                    yield told(visitors)
        if parts:
            yield told(home or settle())

    return run


def _split(level: int, reach: float, schema: pa.Schema):
    """Send the rows of a cell to the cells of its centres."""

    def run(key, rows: pa.Table, centres: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        centres = centres.sort_by("cid")
        points, middle = (_unit(_vectors(t.column("vector").combine_chunks())) for t in (rows, centres))
        cosines = points @ middle.T
        own = cosines.argmax(axis=1)
        equal = cosines >= cosines[np.arange(len(own)), own, None] - 1e-12
        for r in np.flatnonzero(equal.sum(axis=1) > 1):  # equally near centres share their vectors, or no split would end
            among = np.flatnonzero(equal[r])
            own[r] = among[hash_pair(level, rows.column("cid")[int(r)].as_py(), 0) % len(among)]
        far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines))
        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * middle @ middle.T))
        # Distance to the bisector between the own centre and another one.
        bisector = (far**2 - far[np.arange(len(far)), own, None] ** 2) / np.maximum(2.0 * apart[own], 1e-12)
        goes = bisector <= reach + MARGIN
        home = rows.column("home").to_numpy(zero_copy_only=False)
        goes &= ~home[:, None] | (np.arange(len(middle))[None, :] >= own[:, None])
        row, to = np.nonzero(goes)
        cells = np.array([hash_pair(key[0].as_py(), level, c) for c in centres.column("cid").to_pylist()], dtype=np.int64)
        kept = rows.select(["cid", "copies", "vector"]).take(pa.array(row))
        columns = [pa.array(cells[to]), pa.array(home[row] & (to == own[row])), *kept.columns, pa.array(far[row, to])]
        return pa.table(columns, names=schema.names).cast(schema)

    return run


def hash_pair(cell: int, level: int, centre: int) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(f"{cell},{level},{centre}".encode(), digest_size=8).digest(), "little", signed=True)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row for every row: key, n_links, component_id and kept.

    Links join vectors of equal label and length whose cosine is at least `cosine`;
    n_links counts them, component_id is the smallest key that they reach. A vector that
    is null, empty, zero or holds a null or a value that isn't finite, or that has no
    label or no key, links with nothing. Repeated rows count as vectors of their own.
    Other columns are not kept.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False))
    classes = rows.where(valid).groupBy("label", "vector").agg(F.min("id").alias("rid"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    n_classes = classes.count()
    cells = classes.select(F.xxhash64("label", F.size("vector")).alias("cell"), F.lit(True).alias("home"), "cid", "copies", "vector", F.lit(0.0).alias("far"))
    fields = cells.schema
    done: list[DataFrame] = []
    scratch: list[DataFrame] = []
    for level in itertools.count():
        at_home = F.when(F.col("home"), 1)
        info = cells.groupBy("cell").agg(F.count(at_home).alias("homes"), F.count(F.lit(1)).alias("all"), F.max(F.when(F.col("home"), F.col("far"))).alias("radius"))
        info = materialize(info.where("homes > 0"), "info")  # a cell without home vectors links nothing
        cells = join_hot(cells, info.withColumn("_n", F.col("all")), "cell", "_n", cells.count())
        cells = cells.where(F.col("home") | (F.col("far") <= F.col("radius") + reach + MARGIN))
        done.append(cells.where(F.col("homes") <= CELL))
        scratch.append(info)
        if info.where(F.col("homes") > CELL).isEmpty():
            break
        split = cells.where(F.col("homes") > CELL).withColumn("part", F.pmod(F.xxhash64("cid"), F.ceil(F.col("all") / CELL)))
        first = Window.partitionBy("cell").orderBy(F.xxhash64("cid", F.lit(level)), "cid")
        drawn = split.where("home").select("cell", "cid", "vector", "all", F.row_number().over(first).alias("place")).where(F.col("place") <= CENTRES)
        drawn = materialize(drawn.select("cell", "cid", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("all") / CELL) - 1)).alias("part")), "centres")
        sent = split.groupBy("cell", "part").cogroup(drawn.groupBy("cell", "part")).applyInArrow(_split(level, reach, to_arrow_schema(fields)), fields)
        cells = materialize(sent, "cells")
        scratch += [drawn, cells]
    for part in done[1:]:
        done[0] = done[0].unionByName(part)
    parts = F.greatest(F.ceil((F.col("all") - F.col("homes")) / VISITORS), F.lit(1).cast("long"))
    part = F.explode(F.when(F.col("home"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid"), parts))))
    dealt = done[0].withColumn("part", part).select(F.xxhash64("cell", "part").alias("unit"), "home", (F.col("part") == 0).alias("first"), "cid", "copies", "vector")
    # So many partitions whatever their bytes: the work is in comparing.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(partitions, "unit").sortWithinPartitions("unit", F.desc("home"))
    found = materialize(dealt.mapInArrow(_cells(cosine), "a long, b long, links long"), "near")
    drop(*scratch)
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    groups = components(found.select("a", "b"))
    linked = classes.join(links, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    linked = materialize(linked, "linked")
    names = linked.groupBy("component").agg(F.min("rid").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    pair = F.struct("label", "vector").alias("pair")
    named = join_hot(linked, names, "component", "_n", n_classes)
    named = materialize(named.select(pair, "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("_n")), "named")
    drop(found, groups, classes, linked)
    joined = join_hot(rows.select("id", F.when(valid, pair).alias("pair")), named, "pair", "_n", rows.count(), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
