import numpy as np
from marketprose.llm import neighbours


def by_hand(rows, threshold):
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        return v / np.linalg.norm(v)

    units = [unit(v) if label is not None and key is not None else None for key, v, label in rows]
    links = {i: set() for i in range(len(rows))}
    for i, a in enumerate(units):
        for j, b in enumerate(units[:i]):
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                links[i].add(j)
                links[j].add(i)
    component = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        component[i] = min(rows[j][0] for j in seen) if rows[i][0] is not None else None
    return sorted((rows[i][0] or -1, len(links[i]), component[i] if component[i] is not None else -1) for i in links)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, key = [], 0
    for label in (0, 1):
        for family in [1] * 150 + [2] * 20 + [7, 40, 130]:
            centre = rng.normal(size=24)
            for k in range(family):
                noise = rng.normal(size=24) * (0.03 if k % 3 else 0.0)
                rows.append((key, (centre + noise).astype(np.float32).tolist(), label))
                key += 1
    bad = [None, [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [], [1.0, 2.0], [2.0, 4.0]]
    rows += [(key + i, v, 1) for i, v in enumerate(bad)] + [(90_000, rows[0][1], None), (None, rows[0][1], 0), (3, rows[3][1], 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS unit")
    found = neighbours.near_vectors(table.repartition(4), 0.98, sample=100)
    got = found.vectors.collect()
    rounded = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], n) for k, v, n in rows]
    want = by_hand(rounded, 0.98)
    mine = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in got)
    want = sorted((-1 if k == -1 else k, n, c) for k, n, c in want)
    assert found.recall >= 0.99
    assert len(mine) == len(rows)
    zero = [(r[0] if r[0] != 0 else -1, *r[1:]) for r in mine]  # by_hand writes id 0 as -1
    assert sorted(zero) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_adjacent_families_that_fill_each_others_lists(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label, size, families in ((0, 12, 2), (1, 12, 4), (2, 320, 2), (3, 15, 1), (4, 40, 3)):
        start, step = np.linalg.qr(rng.normal(size=(256, 2)))[0].T
        for family in range(families):  # each family links with the one before: inside 0.995, across 0.982
            angle = family * np.arccos(0.987)
            centre = np.cos(angle) * start + np.sin(angle) * step
            for _ in range(size):
                rows.append((len(rows), (centre + rng.normal(size=256) * np.sqrt(0.005 / 256)).astype(np.float32).tolist(), label))
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4)
    found = neighbours.near_vectors(table, 0.98)
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in found.vectors.collect())
    assert got == by_hand(rows, 0.98)
    assert len({c for _, _, c in got}) == 5 and found.recall == 1.0


def test_rows_that_repeat_an_id(spark):
    big = 2**60 + 1
    rows = [(big, [1.0, 0.0], 1), (big, [0.0, 1.0], 1), (big, None, 1), (big + 1, [0.0, 2.0], 1), (big + 2, [1.0, 0.05], 1),
            (5, [0.05, 1.0], 1), (None, [1.0, 0.0], 1), (None, None, None), (5, [0.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in neighbours.near_vectors(table, 0.98).vectors.collect())
    want = [(big, 1, big), (big, 2, 5), (big, 0, big), (big + 1, 2, 5), (big + 2, 1, big), (5, 2, 5), (0, 0, 0), (0, 0, 0), (5, 0, 5)]
    assert got == sorted(want)


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert neighbours.near_vectors(table).vectors.count() == 0
