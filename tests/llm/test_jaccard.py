"""The Jaccard join against all pairs in plain Python."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import graph
from tidewatch.llm import jaccard as J
from tidewatch.llm.graph import components
from tidewatch.llm.text import mix

SCHEMA = "doc_id long, text string, component_id string, n_shingles int"


def brute(rows, n, num, den):
    upper = {i: i + 32 for i in range(65, 91)}
    sets = []
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(upper))
        sets.append((i, {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                top[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            groups[find(k)] = min(i, groups.get(find(k), i))
    return sorted(((i, len(s), groups[find(k)] if i is not None else None) for k, (i, s) in enumerate(sets)), key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df, **options).collect()), key=str)


def near(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = rng.choice("uvwxyz")
    return " ".join(out)


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 50)])
def test_equals_all_pairs(spark, words, n, num):
    rng = random.Random(n)
    rows = [(1, None), (2, ""), (3, " \t "), (4, "one"), (5, "ONE"), (6, "two words"), (7, "two  words"), (None, "two words"), (8, "é É"), (8, "é É")]
    for g in range(12):
        base = words(rng.choice([4, 12, 40, 150]), [f"w{k}" for k in range(400)]).split()
        rows += [(100 + 10 * g + k, near(rng, base, rng.choice([0, 1, 2, 4]))) for k in range(8)]
    assert got(spark, rows, n=n, num=num, den=100) == brute(rows, n, num, 100)


def test_large_group_of_near_copies_in_many_blocks(spark, words, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    rng = random.Random(3)
    base = words(60, [f"w{k}" for k in range(300)]).split()
    rows = [(k, near(rng, base, rng.choice([1, 1, 2]))) for k in range(80)] + [(1000 + k, " ".join(base)) for k in range(60)]
    assert got(spark, rows) == brute(rows, 3, 90, 100)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_very_long_text(spark):
    text = " ".join(f"w{k}" for k in range(300_000))
    assert got(spark, [(2, text), (1, text + " end"), (3, "w1 w2 w3")]) == [(1, 299_999, 1), (2, 299_998, 1), (3, 1, 3)]


def test_pairs_near_enough_share_an_upper_node():
    rng = np.random.default_rng(1)
    for num in (50, 80, 90):
        bands = J.size_bands(num, 100, 1 << 16)
        for _ in range(300):
            size = int(rng.integers(1, 400))
            a = np.unique(mix(rng.integers(0, 1 << 62, size).astype(np.uint64)))
            gone = int(rng.integers(0, size + 1))
            b = np.unique(np.concatenate([a[:len(a) - gone], mix(rng.integers(0, 1 << 62, gone // 2).astype(np.uint64))]))
            shared = len(np.intersect1d(a, b))
            if len(b) and 100 * shared >= num * (len(a) + len(b) - shared):
                assert np.intersect1d(J.routes(a, num, 100, bands), J.routes(b, num, 100, bands)).size


@pytest.mark.parametrize("num", [80, 90])
def test_sets_that_share_nothing_share_no_upper_node(num):
    rng = np.random.default_rng(4)
    bands = J.size_bands(num, 100, 1 << 12)
    nodes = [J.routes(np.unique(mix(rng.integers(0, 1 << 62, 300).astype(np.uint64))), num, 100, bands) for _ in range(40)]
    assert len(np.unique(np.concatenate(nodes))) == sum(map(len, nodes))  # empty hash ranges brought them together


def test_one_of_each_group_stays(spark, words):
    base = words(60, [f"w{k}" for k in range(300)])
    rows = [(5, base, "s", 1), (3, base + " more", "s", 2), (9, words(30, ["other", "text", "of", "its", "own"]), "s", 3), (None, base, "s", 4), (7, None, "s", 5)]
    kept = J.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, component_id int"))
    assert kept.columns == ["doc_id", "text", "source", "component_id"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 7, 9]


def test_rows_of_equal_and_missing_ids_leave_one(spark, words):
    base, other = words(60, [f"w{k}" for k in range(300)]), words(60, [f"v{k}" for k in range(300)])
    rows = [(None, base), (None, base), (None, base + " more"), (4, other), (4, other + " more"), (4, other), (4, words(40, ["a", "b", "c", "d", "e"])), (None, ""), (None, ""),
            (8, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, _class string")
    kept = J.distinct_documents(df)
    assert kept.columns == df.columns
    out = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert len(out) == 1 + 2 + 3 and [k for k, _ in out] == ["4", "4", "8", "None", "None", "None"]
    texts = [t for _, t in out]
    assert sum(t.startswith(base[:30]) for t in texts) == 1 and sum(t.startswith(other[:30]) for t in texts) == 1


@pytest.mark.parametrize("kind", ["int", "long"])
def test_rows_without_id_link_others(spark, words, kind):
    base = words(60, [f"w{k}" for k in range(300)]).split()
    bridge = base + ["p1", "p2", "p3"]
    rows = [(1, " ".join(base)), (None, " ".join(bridge)), (2, " ".join(bridge + ["q1", "q2", "q3"])), (None, "alone and far from all of them")]
    expected = brute(rows, 3, 90, 100)
    assert [e[2] for e in expected if e[0] == 2] == [1]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df, n=3, num=90, den=100).collect()), key=str)
    assert out == expected


def test_forest_joins_what_all_pairs_join(words):
    rng = np.random.default_rng(5)
    for trial in range(20):
        base = np.unique(mix(rng.integers(0, 1 << 62, 80).astype(np.uint64)))
        members = []
        for k in range(60):
            s = np.unique(np.concatenate([base[rng.random(len(base)) > 0.04], mix(rng.integers(0, 1 << 62, int(rng.integers(0, 8))).astype(np.uint64))]))
            members.append({"set_no": k, "component": k // 2, "n_shingles": len(s), "shingles": s, "bits": J.bitmap(s)})
        for left, right in ((members, None), (members[:30], members[30:])):
            def top(links):
                up = {m["component"]: m["component"] for m in members}
                def find(x):
                    while up[x] != x:
                        x = up[x]
                    return x
                for a, b in links:
                    up[find(a // 2)] = find(b // 2)
                return [sorted(c for c in up if find(c) == find(d)) for d in up]
            pairs = [(a["set_no"], b["set_no"]) for a in left for b in (right or left) if a["set_no"] < b["set_no"]
                     and 190 * len(np.intersect1d(a["shingles"], b["shingles"])) >= 90 * (len(a["shingles"]) + len(b["shingles"]))]
            found = J.forest(left, right, 90, 100)
            assert top(found) == top(pairs) and len(found) < 30 and {tuple(sorted(f)) for f in found} <= set(pairs)


@pytest.mark.parametrize("links", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(30)] + [(50, 51), (51, 50)],
                                   [(k, 97 - k) for k in range(0, 97, 3)]])
def test_components(spark, links):
    top = {}

    def find(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a long, b long")
    assert {(r.node, r.component) for r in components(df).collect()} == {(i, find(i)) for i in list(top)}


@pytest.mark.parametrize("few", [0, 1000])
def test_components_by_broadcast_and_by_shuffle(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "BROADCAST_EDGES", few)
    links = [(k, 97 - k) for k in range(0, 97, 3)] + [(k, k + 200) for k in range(30)] + [(1, 2), (2, 1), (300, 301), (301, 302)]
    near, want = {}, {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in sorted(near):
        todo = [start]
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = start
                todo += near[x]
    assert dict(components(spark.createDataFrame(links, "a long, b long")).collect()) == want


def test_stars_need_no_round(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a round")

    links = [(9, 1), (8, 1), (1, 7), (30, 20), (31, 20)]
    monkeypatch.setattr(graph, "_large_star", never)
    assert dict(components(spark.createDataFrame(links, "a long, b long")).collect()) == {9: 1, 8: 1, 7: 1, 1: 1, 30: 20, 31: 20, 20: 20}


def test_links_between_groups_go_from_least_to_least(spark):
    grouped = spark.createDataFrame([(1, 1), (5, 1), (6, 1), (2, 2), (7, 2)], "node long, component long")
    links = J._joined(grouped, spark.createDataFrame([(6, 7), (8, 5), (9, 10)], "a long, b long"))
    assert {(r.a, r.b) for r in links.collect() if r.a != r.b} == {(1, 2), (8, 1), (9, 10), (5, 1), (6, 1), (7, 2)}
    assert dict(components(links).collect()) == {1: 1, 2: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 9, 10: 9}


@pytest.mark.parametrize("cut, bucket", [(1 << 22, 1 << 20), (7, 5)])
def test_shared_keys_are_those_of_several_rows(spark, monkeypatch, cut, bucket):
    monkeypatch.setattr(J, "CUT_KEYS", cut)
    monkeypatch.setattr(J, "BUCKET_KEYS", bucket)
    rng = np.random.default_rng(8)
    rows = [((k % 3) << 40 | k * 9_000, [7, *map(int, rng.choice(np.arange(-300, 300), 6, replace=False))]) for k in range(60)]
    rows += [(999_999, []), (999_998, [-(2 ** 63), 2 ** 63 - 1])]
    holders = {}
    for row, keys in rows:
        for key in set(keys):
            holders.setdefault(key, set()).add(row)
    want = {(key, row) for key, held in holders.items() if len(held) > 1 for row in held}
    found = J._shared_keys(spark.createDataFrame(rows, "row long, keys array<long>").repartition(3)).collect()
    assert {(r["key"], r["row"]) for r in found if len(holders[r["key"]]) > 1} == want
    assert J._shared_keys(spark.createDataFrame([], "row long, keys array<long>")).collect() == []


def test_keys_are_dealt_a_few_at_a_time_from_rows_of_any_length():
    keys = np.random.default_rng(3).permutation(1 << 21)
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6]), pa.array([keys.tolist(), [1]], pa.list_(pa.int64()))], names=["row", "keys"])
    sizes, held = [], 0
    tracemalloc.start()
    try:
        for out in J.dealt(iter([batch]), 3, 1 << 16):
            sizes.append(sum(len(k) for k in out.column(3).to_pylist()) // 8)
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) == len(keys) + 1 and max(sizes) <= 1 << 16
    assert held < 48 << 20  # the row's own numbers are 16 MB; dealt at once they would take 200


def test_texts_are_taken_in_runs_of_about_a_size():
    texts = pa.array(["a" * n if n >= 0 else None for n in (10, 0, -1, 300, 40, 70, 5, 90, 20, 0)])
    parts = list(J._parts(texts, 100))
    assert pa.concat_arrays(parts).equals(texts) and len(parts) > 3
    assert all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()[1:]) <= 100 for p in parts)
    assert [len(p) for p in J._parts(pa.array([], pa.string()), 100)] == [0]


def test_each_text_is_read_once_to_find_the_class_that_stays(spark, words):
    docs = spark.createDataFrame([(k, words(30)) for k in range(20)], "doc_id long, text string")
    plan = J.distinct_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # once for the rows with a class, once to find those without


def test_parities_leave_every_linked_pair_and_few_others():
    rng = np.random.default_rng(6)
    members, sets = [], []
    for k in range(90):
        base = sets[k - 1] if k % 3 == 1 else np.unique(mix(rng.integers(0, 1 << 62, int(rng.integers(200, 420))).astype(np.uint64)))
        s = np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], mix(rng.integers(0, 1 << 62, int(rng.integers(0, 8))).astype(np.uint64))]))
        sets.append(s)
        members.append({"set_no": k, "component": 0 if k in (3, 4) else k + 1, "n_shingles": len(s), "bits": J.parity(s)})
    for left, right in ((members, None), (members[::2], members[1::2])):
        want = {x["set_no"] for a in left for b in (right or left) if a["component"] != b["component"] and 180 * len(np.intersect1d(
            sets[a["set_no"]], sets[b["set_no"]])) >= 80 * (a["n_shingles"] + b["n_shingles"]) for x in (a, b)}
        found = J.partnered(left, right, 80, 100)
        assert len(want) > 20 and want <= found and not {3, 4} & want and len(found - want) < 20


def test_bitmaps_go_only_where_a_partner_may_be(spark, words):
    texts = [(k, words(160, [f"{k}x{j}" for j in range(500)])) for k in range(30)]
    texts.append((30, texts[7][1] + " more"))
    sets = J._sets(spark.createDataFrame(texts, "doc_id long, text string"), 3).cache()
    size = {r.set_no: r.n for r in sets.selectExpr("set_no", "size(shingles) AS n").collect()}
    near = {J.class_number(s) for s in J._document_sets(pa.array([texts[7][1], texts[30][1]]), 3)}
    nodes = spark.createDataFrame([(key, n, size[n]) for key in (1, 2) for n in size if key == 1 or n not in near], "key long, set_no long, n_shingles long")
    blocks, _ = J._blocks(nodes, spark.createDataFrame([], "node long, component long"), sets, "fine", 90, 100)
    rows = blocks.collect()
    assert [(r.key, {m.set_no for m in r.left}, r.right) for r in rows] == [(1, near, None)]
