"""Near vectors against all pairs."""

import numpy as np

from tidewatch.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, least=0.98):
    good = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, _ in rows]
    n = len(rows)
    links, top = [0] * n, list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(n):
        for b in range(a):
            if good[a] and good[b] and rows[a][2] is not None and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
                if V.exact_cosine([x], [y])[0] >= least:
                    links[a] += 1
                    links[b] += 1
                    top[find(a)] = find(b)
    least_id = {}
    for k in range(n):
        if rows[k][0] is not None:
            least_id[find(k)] = min(rows[k][0], least_id.get(find(k), rows[k][0]))
    return sorted(((i, links[k], None if i is None else least_id[find(k)], i is not None and i == least_id[find(k)]) for k, (i, _, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], SCHEMA)
    return sorted((tuple(r) for r in V.near_vectors(df).collect()), key=str)


def planted(rng, groups, members, noise, label=1, first=0, width=64):
    rows = []
    for g in range(groups):
        base = rng.standard_normal(width)
        base /= np.linalg.norm(base)
        rows += [(first + g * members + k, [float(c) for c in base + noise * rng.standard_normal(width)], label) for k in range(members)]
    return rows


def test_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = planted(rng, 12, 6, 0.015) + planted(rng, 5, 4, 0.018, 2, 500) + planted(rng, 60, 1, 0.0, 1, 900) + planted(rng, 2, 5, 0.01, None, 2000)
    rows += [(3000, rows[0][1], 1), (3000, rows[0][1], 1), (3001, rows[0][1], 2), (3002, rows[0][1], None), (3003, None, 1), (3004, [], 1), (3005, [0.0] * 64, 1),
             (3006, [float("nan")] + [1.0] * 63, 1), (3007, [None] + [1.0] * 63, 1), (3008, [float("inf")] + [1.0] * 63, 1), (3009, [1.0, 2.0], 1),
             (3010, [2.0, 4.0], 1), (None, rows[0][1], 1)]
    assert run(spark, rows) == brute(rows)


def test_one_hot_group_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    rows = planted(np.random.default_rng(4), 1, 150, 0.012)
    assert run(spark, rows) == brute(rows)


def test_widths_that_share_strips_are_kept_apart(spark, monkeypatch):
    rows = planted(np.random.default_rng(9), 3, 4, 0.012) + [(500, [1.0, 2.0], 1), (501, [2.0, 4.0], 1)]
    numbered = V._numbered

    def colliding(classes, least):  # the short vectors lie in the strips of a long one
        found = numbered(classes, least).join(classes.selectExpr("class_id", "size(vector) AS width"), "class_id")
        one = found.where("width = 64").selectExpr("min_by(strips, class_id) AS other")
        return found.crossJoin(one).selectExpr("class_id", "CASE WHEN width = 2 THEN other ELSE strips END AS strips")

    monkeypatch.setattr(V, "_numbered", colliding)
    assert run(spark, rows) == brute(rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):  # pairs at a cosine of just over 0.98
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), k % 3), (2 * k + 1, (0.9805 * a + np.sqrt(1 - 0.9805 ** 2) * b).tolist(), k % 3)]
    found = sum(r[1] for r in run(spark, rows)) / 2
    assert found >= 299


def test_window_collisions_are_counted():
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((20, 7)), rng.standard_normal((30, 7))
    assert (V.collisions(a, b, 0.4) == (np.abs(a[:, None] - b[None]) < 0.4).sum(2)).all()


def test_empty(spark):
    assert run(spark, []) == []
