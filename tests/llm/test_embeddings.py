import numpy as np

from netloom.llm.embeddings import embedding_components, forest_of_few, forest_of_many, met_before, op7_embedding_dedup, shape


def brute(rows, low=0.9):
    units = []
    for _, v in rows:
        x = None if v is None or None in v or not len(v) else np.array(v, float)
        units.append(x / np.linalg.norm(x) if x is not None and np.isfinite(x).all() and x.any() else None)
    n = len(rows)
    near = [{j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= low} for i in range(n)]
    return near


def recall(rows, got):
    want = sum(map(len, brute(rows)))
    return sum(r.n_links for r in got) / want if want else 1.0


def test_odd_vectors(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal(16)
    rows = [(k, (base + 0.05 * r.standard_normal(16)).tolist()) for k in range(40)]
    rows += [(100 + k, r.standard_normal(16).tolist()) for k in range(40)]
    rows += [(100, rows[50][1]), (100, rows[50][1]), (200, rows[50][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] + [1.0] * 15), (304, [float("inf")] + [1.0] * 15), (305, [None] + [1.0] * 15), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, node string")
    got = embedding_components(frame).collect()
    near = brute(rows)
    assert len(got) == len(rows) and recall(rows, got) > 0.99
    links = {k: [] for k in {i for i, _ in rows}}
    for (i, _), s in zip(rows, near):
        links[i].append(len(s))
    for row in got:
        assert row.n_links <= max(links[row.vec_id])
        if row.vec_id is not None and row.vec_id >= 300 and row.vec_id < 306:
            assert row.n_links == 0 and row.component_id == row.vec_id and row.kept
    by_id = {row.vec_id: row for row in got}
    assert {by_id[k].component_id for k in range(40)} == {0} and by_id[307].component_id == 306 and by_id[306].n_links == 1
    assert embedding_components(frame.limit(0)).count() == 0


def test_a_large_group_is_counted_whole(spark):
    r = np.random.default_rng(6)
    base = r.standard_normal(32)
    rows = [(k, (base + 0.1 * r.standard_normal(32)).tolist()) for k in range(700)]
    got = embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {row.component_id for row in got} == {0}
    assert 0.98 < recall(rows, got) <= 1


def test_planes_follow_the_number_of_vectors():
    assert shape(1000, 0.9) == (96, 20) and shape(0, 0.9) == (96, 20)
    tables, planes = shape(1 << 26, 0.9)
    assert planes == 26 and 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** 26) ** tables >= 0.988


def test_met_before_looks_at_each_pair_s_own_columns():
    r = np.random.default_rng(8)
    marks = r.integers(0, 40, (200, 96), dtype=np.int32)
    i, j, at = r.integers(0, 200, 3000), r.integers(0, 200, 3000), r.integers(0, 97, 3000)
    want = [bool((marks[x, :n] == marks[y, :n]).any()) for x, y, n in zip(i, j, at)]
    assert met_before(marks, i, j, at).tolist() == want


def test_forests_span():
    r = np.random.default_rng(9)
    for n in (2, 30, 200):
        i, j = r.integers(0, n, 90), r.integers(0, n, 90)
        i, j = i[i != j], j[i != j]

        def parts(edges):
            label = list(range(n))
            for _ in range(n):
                for x, y in edges:
                    label[x] = label[y] = min(label[x], label[y])
            return label

        want = parts(list(zip(i.tolist(), j.tolist())))
        for forest in (forest_of_few(i, j), forest_of_many(i, j)):
            assert parts(forest) == want and len(forest) == n - len(set(want))


def test_many_null_and_equal_vectors(spark):
    rows = [(k, None) for k in range(1500)] + [(2000 + k, [1.0, 2.0, 3.0]) for k in range(1500)] + [(4000, [1.0, -2.0, 3.0])]
    got = {r.vec_id: r for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[k].n_links == 0 and got[k].kept for k in [*range(1500), 4000])
    assert all(got[2000 + k].n_links == 1499 and got[2000 + k].component_id == 2000 for k in range(1500))


def test_query(spark, tiny):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    got = {r.vec_id: r for r in op7_embedding_dedup(spark, tiny).collect()}
    assert len(got) == len(rows) and 0.97 < recall(rows, got.values()) <= 1
    near = brute(rows)
    reach = {}
    for k in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        todo = [] if k in reach else [k]
        while todo:
            j = todo.pop()
            if j not in reach:
                reach[j] = rows[k][0]
                todo += near[j]
    wrong = 0
    for k, (i, _) in enumerate(rows):
        assert got[i].n_links <= len(near[k]) and got[i].kept == (got[i].component_id == i)
        assert reach[k] <= got[i].component_id <= i
        wrong += got[i].component_id != reach[k]
    assert wrong <= 0.02 * len(rows)
