"""The greedy resolution, components and vector pairs at sizes and shapes where plain ways fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import components, dedup, vectors

ROWS = "id long, position long, url_key string, title_key string, vec long"


def loop(rows, edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    taken, out = {"u": {}, "t": {}, "v": {}}, {}
    for i, p, u, t, v in sorted(rows, key=lambda r: r[1]):
        by = {"url": taken["u"].get(u), "title": taken["t"].get(t), "semantic": min((taken["v"][c] for c in {v} | near.get(v, set()) if v is not None and c in taken["v"]), default=None)}
        basis = None if p < 0 else next((b for b in by if by[b] is not None), None)
        if basis is None:
            for k, x in (("u", u), ("t", t), ("v", v)):
                if x is not None:
                    taken[k].setdefault(x, p)
        out[p] = (i, basis is None, basis, by.get(basis))
    return {p: r for p, r in out.items() if p >= 0}


@pytest.mark.parametrize("in_one_task", [100_000, 0, 12])
@pytest.mark.parametrize("seed", [0, 1])
def test_greedy_with_classes_and_known_rows(spark, seed, in_one_task):
    rng = np.random.default_rng(seed)
    positions = rng.permutation(np.arange(-20, 130))
    head = {}
    rows = []
    for i, p in enumerate(positions.tolist()):
        c = int(rng.integers(0, 90))
        u, t = (None if rng.random() < 0.2 else f"{k}{rng.integers(110)}" for k in "ut")
        rows.append([i, p, u, t, c if rng.random() < 0.7 else None])
    for r in rows:
        if r[4] is not None:
            head.setdefault(r[4], r[1])
    rows = [(i, p, u, t, None if c is None else head[c]) for i, p, u, t, c in rows]
    heads = list(head.values())
    edges = {(int(a), int(b)) for a, b in rng.choice(heads, (30, 2)) if a != b}
    got = dedup.greedy(spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(sorted(edges), "a long, b long"), in_one_task=in_one_task)
    assert {r.position: (r.id, r.accepted, r.basis, r.blame) for r in got.collect()} == loop(rows, edges)


def test_a_chain_of_10_000_links(spark):
    """Every second row of a long path is accepted, in few actions."""
    n = 10_001
    order = np.random.default_rng(0).permutation(n).tolist()
    rows = spark.createDataFrame([(i, i, None, None, i) for i in order], ROWS).repartition(4)
    edges = spark.createDataFrame([(i, i + 1) for i in order if i + 1 < n], "a long, b long").repartition(4)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = {r.position: r.accepted for r in dedup.greedy(rows, edges).collect()}
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("chain")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: i % 2 == 0 for i in range(n)}
    assert len(jobs) < 60  # Spark counts a job for each shuffle; rounds would take 5,000 of several


def test_rounds_do_not_grow_the_plan(spark):
    """A chain takes a round for two rows; the result reads as many folders after six rounds as after four."""

    def chain(n):
        rows = [(i, i, f"u{i // 2}", f"t{(i + 1) // 2}", i if i % 3 else None) for i in range(-1, n)]
        got = dedup.greedy(spark.createDataFrame(rows, ROWS), spark.createDataFrame([(i, i + 3) for i in range(1, n - 3)], "a long, b long"), in_one_task=0)
        assert {r.position: (r.id, r.accepted, r.basis, r.blame) for r in got.collect()} == loop(rows, [(i, i + 3) for i in range(1, n - 3)])
        return got._jdf.queryExecution().optimizedPlan().toString().count("Relation")

    assert chain(12) == chain(8)


@pytest.mark.parametrize("in_one_task", [10**6, 5])
def test_components(spark, in_one_task):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (180, 2))] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7), (1, 2), (2, 1)]
    label = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(3), in_one_task=in_one_task)
    assert {r.node: r.label for r in got.collect()} == {x: label[x] for x in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(40, 16))
    v = (centre[rng.integers(0, 40, n)] + 0.25 * rng.normal(size=(n, 16))).astype(np.float32)
    v[5] = v[3] * 2
    v[10:20] = v[10]
    v[20] = 0
    return v


def near_pairs(v, threshold):
    u = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-12)
    a, b = np.nonzero(np.triu(u @ u.T >= threshold, 1))
    return set(zip(a.tolist(), b.tolist()))


def frame(spark, v):
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(9001, []), (9002, None), (9003, [1.0]), (9004, [1.0]), (9005, [float("nan")] * 16), (9006, [float("nan")] * 16)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("block_rows", [20, 150, 2000])
def test_pairs_by_pivots_are_all_pairs(spark, block_rows):
    v = clustered(900)
    got = vectors.semantic_pairs(frame(spark, v), threshold=0.92, block_rows=block_rows).collect()
    assert {(r.a, r.b) for r in got} == near_pairs(v, 0.92) | {(9003, 9004)} and len(got) == len({(r.a, r.b) for r in got})


@pytest.mark.parametrize("most_copies,pass_bytes", [(0, 1 << 13), (0, 1 << 25), (10**6, 1 << 25)])
def test_pairs_in_passes_and_in_cells_are_all_pairs(spark, most_copies, pass_bytes):
    """Seven passes, one, and cells with blocks of homes and of visitors; vectors of another length among them."""
    v = clustered(400, 4)
    reps, _ = vectors.vector_classes(frame(spark, v))
    got = vectors.near_classes(reps, threshold=0.4, block_rows=20, most_copies=most_copies, pass_bytes=pass_bytes).collect()
    v[11:20] = 0  # copies of row 10, which stands for them
    assert {(r.a, r.b) for r in got} == near_pairs(v, 0.4) and len(got) == len({(r.a, r.b) for r in got})


def test_evenly_spread_vectors_are_not_copied(spark, monkeypatch):
    """Where nothing is pruned each vector is written once; with copies for each cell and block it was 40 times as many, and more than that shuffled."""
    v = np.random.default_rng(1).standard_normal((4000, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<float>").repartition(3)
    reps, _ = vectors.vector_classes(rows)
    seen, written = [], vectors.written
    monkeypatch.setattr(vectors, "written", lambda df, name: seen.append(written(df, name)) or seen[-1])
    got = {(r.a, r.b) for r in vectors.near_classes(reps, threshold=0.8, block_rows=50).collect()}
    assert got == near_pairs(v, 0.8) and sum(df.count() for df in seen) == 4000


def test_pivots_spare_comparisons(spark):
    """With 60 pivots a vector visits a few cells, not all."""
    reps, members = vectors.vector_classes(frame(spark, clustered(6000)))
    assert reps.count() == 6000 + 1 - 9 - 1 and members.count() == 6000 + 2 - 1  # nine copies, two of another length, a zero
    seen = []
    meet = vectors._meet
    try:
        vectors._meet = lambda cells, *a: seen.append(cells.count()) or meet(cells, *a)
        vectors.near_classes(reps, threshold=0.95, block_rows=100).count()
    finally:
        vectors._meet = meet
    assert seen[0] < 6 * 6000


def test_likely_pairs_reach_their_recall(spark):
    v = clustered(3000, 2)
    want = near_pairs(v, 0.92)
    got = {(r.a, r.b) for r in vectors.semantic_pairs(frame(spark, v), threshold=0.92, exact=False).collect()} - {(9003, 9004)}
    assert got <= want and len(got) >= 0.9 * len(want)
