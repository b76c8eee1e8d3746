import random

import numpy as np
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from themeloom.llm import ann, vector_dedup

ROWS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"
NAN, INF = float("nan"), float("inf")
ODD = [
    (900, None, 1), (901, [0.0] * 8, 1), (902, [NAN] + [1.0] * 7, 1), (903, [INF] + [1.0] * 7, 1),
    (904, [None] + [1.0] * 7, 1), (905, [], 1),
]


def groups(seed=4, n=240, size=8):
    """Clusters of near copies, exact copies, and vectors on their own."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = np.array(rows[rng.integers(len(rows))][1])
            v = base * rng.choice([1.0, 2.0]) + rng.normal(size=size) * rng.choice([0.0, 0.02, 0.05])
        else:
            v = rng.normal(size=size)
        rows.append((i, np.float32(v).tolist(), int(rng.integers(2))))
    return rows


def plain_links(rows, cosine=0.98):
    ids = [r[0] for r in rows]
    vectors = np.array([r[1] for r in rows])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= cosine) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    root = np.array(ids)
    while True:
        new = np.array([min([root[i], *root[near[i]]]) for i in range(len(ids))])
        if (new == root).all():
            return near.sum(axis=1), root
        root = new


@pytest.mark.parametrize("block", [vector_dedup.BLOCK, 16])
def test_links_and_components_are_all_found(spark, scratch, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = groups()
    found = vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, ROWS), scratch).collect()
    found = {r.vec_id: r for r in found}
    links, roots = plain_links(rows)
    for (vec_id, _, _), n, root in zip(rows, links, roots, strict=True):
        assert (found[vec_id].n_links, found[vec_id].component_id) == (n, root)
        assert found[vec_id].kept == (root == vec_id)


def test_odd_vectors_are_linked_with_nothing(spark, scratch):
    rows = [*ODD, (1, [1.0] * 8, None), (2, [1.0] * 8, 3), (3, [2.0] * 8, 3), (4, [1.0] * 7, 3),
            (5, [-0.0, 1.0], 3), (6, [0.0, 1.0], 3), (7, [0.0, 1.0], 3), (7, [0.0, 1.0], 3), (None, [5.0], 9)]
    table = spark.createDataFrame(rows, ROWS)
    for name in ("name", "node", "copies", "n_links", "root", "v"):
        table = table.withColumn(name, F.lit("clash"))
    found = vector_dedup.near_duplicate_vectors(table, scratch).collect()
    told = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in found)
    assert told[0] == (0, 0, None, None)
    assert told[1:10] == [
        (1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False), (4, 0, 4, True), (5, 3, 5, True), (6, 3, 5, False),
        (7, 3, 5, False), (7, 3, 5, False), (900, 0, 900, True),
    ]
    assert all(t[1:] == (0, t[0], True) for t in told[9:])
    assert vector_dedup.near_duplicate_vectors(table.limit(0), scratch).count() == 0


def test_a_label_of_copies(spark, scratch):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(300)] + [(300 + i, [3.0, 2.0, float(i)], 1) for i in range(5)]
    found = {r.vec_id: r for r in vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, ROWS), scratch).collect()}
    assert {(found[i].n_links, found[i].component_id) for i in range(300)} == {(299, 0)}


def test_estimates_have_no_bias_and_bounds_hold():
    rng = np.random.default_rng(0)
    coder = vector_dedup.make_codes(32, 1000, 0.98)
    x = rng.normal(size=(400, 32))
    y = x + rng.normal(size=(400, 32)) * rng.uniform(0, 1, (400, 1))
    unit = np.concatenate([x, y])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rotated = coder.rotate(unit)
    factors = np.abs(rotated).sum(axis=2) / np.sqrt(32)
    i, j = np.arange(400), np.arange(400, 800)
    upper = vector_dedup.upper_bounds(rotated, rotated >= 0, factors, i, j)
    exact = (unit[i] * unit[j]).sum(axis=1)
    assert (upper >= exact).all()
    spread = np.sqrt(((1 - factors[j] ** 2) / factors[j] ** 2 / 31).sum(axis=1)) / len(coder.rotations)
    assert abs((upper - vector_dedup.DEVIATIONS * spread - exact).mean()) < 0.01


def plain_nearest(rows, query, k):
    vec_id, vector, _ = query
    scored = sorted({(-float(np.dot(np.array(r[1]), np.array(vector))), r[0]) for r in rows if r[0] != vec_id})
    return [i for _, i in scored[:k]]


def test_nearest_of_a_small_table_are_exact(spark, scratch):
    rows = groups(n=300)
    table = spark.createDataFrame(rows, ROWS)
    found = ann.nearest(table, table.filter("vec_id % 20 = 0"), scratch, k=5).collect()
    for query in rows[::20]:
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == query[0])
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        # Scores of copies differ in the last place at most, so compare the scores.
        told = [np.dot(np.array(rows[i][1]), np.array(query[1])) for i in plain_nearest(rows, query, 5)]
        assert np.allclose([r[2] for r in own], told, rtol=1e-12)


def test_recall_over_many_ranges(spark, scratch, monkeypatch):
    monkeypatch.setattr(ann, "MOST_VECTORS", 50)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, np.float32(v).tolist(), 1) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, ROWS)
    found = ann.nearest(table, table.filter("vec_id % 50 = 0"), scratch, k=10).collect()
    hits = 0
    for query in rows[::50]:
        near = {r.vec_id for r in found if r.query_id == query[0]}
        assert len(near) == 10
        hits += len(near & set(plain_nearest(rows, query, 10)))
    assert hits >= 0.9 * 300


def test_many_queries_are_cut_in_pieces(spark, scratch, monkeypatch):
    monkeypatch.setattr(ann, "MOST_VECTORS", 50)
    whole, sides = GroupedData.cogroup, []
    monkeypatch.setattr(GroupedData, "cogroup", lambda own, other: sides.extend([own, other]) or whole(own, other))
    rows = groups(n=300)
    table = spark.createDataFrame(rows, ROWS)
    found = ann.nearest(table, table, scratch, k=5).collect()
    assert len(found) == 5 * len(rows)
    for side in sides:
        assert side.count().agg(F.max("count")).first()[0] <= 2 * ann.MOST_VECTORS
    hits = 0
    for query in rows[::10]:
        near = [r.score for r in sorted(found, key=lambda r: r.rank) if r.query_id == query[0]]
        told = [np.dot(np.array(rows[i][1]), np.array(query[1])) for i in plain_nearest(rows, query, 5)]
        hits += np.isclose(near, told, rtol=1e-12).sum()
    assert len(sides) == 2 and hits >= 0.9 * 5 * 30


def test_copies_ties_and_odd_rows(spark, scratch):
    rows = [(i, [1.0, 0.0], 1) for i in range(50, 0, -1)] + [(60, [0.0, 1.0], 1), (61, [1.0, 0.0, 0.0], 1)]
    rows += [(7, [1.0, 0.0], 2), (None, [9.0, 9.0], 1), (70, None, 1), (71, [0.0, 0.0], 1), (72, [NAN, 1.0], 1)]
    table = spark.createDataFrame(rows, ROWS)
    for name in ("name", "v", "ids", "curve", "key", "block", "salt", "rank", "score"):
        table = table.withColumn(name, F.lit("clash"))
    found = ann.nearest(table, table.filter("vec_id IN (3, 60, 61, 70, 71, 72)"), scratch, k=4).collect()
    told = {q: [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in found}}
    assert told == {3: [1, 2, 4, 5], 60: [1, 2, 3, 4]}
    few = table.filter("vec_id IN (1, 2, 60)")
    found = ann.nearest(few, few, scratch, k=20).collect()
    assert sorted((r.query_id, r.vec_id) for r in found) == [(1, 2), (1, 60), (2, 1), (2, 60), (60, 1), (60, 2)]
    assert ann.nearest(table.limit(0), table.limit(0), scratch).count() == 0


def test_hilbert_keys_visit_every_cell_in_steps_of_one():
    bits, axes = 2, 3
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes)).reshape(axes, -1).T
    keys = ann.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(1 << (bits * axes)))
    walk = cells[np.argsort(keys)]
    assert (abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_components(spark, scratch):
    from themeloom.llm.components import connected_components

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (3, None)]
    edges += [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(120)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a BIGINT, b BIGINT"), scratch).collect()}
    root = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in range(200):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert found == root
    assert connected_components(spark.createDataFrame([], "a BIGINT, b BIGINT"), scratch).count() == 0
