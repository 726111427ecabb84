import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import kernels as k
from vectorloom.llm.clusters import connect, describe_clusters, similarity_clusters, spectral_report
from vectorloom.llm.neighbours import exact_neighbours, similar_pairs, similar_vectors
from vectorloom.llm.subset import reserves, varied_subsets
from vectorloom.llm.vectors import pack_id, unpack_id, usable_vectors

KIND = "id string, collection string, data array<float>, metadata string, ingested_at timestamp, similarity double, tab int, cell int, a int, b int, own int, m int, w double, root string"
OTHER = (0.5, 1, 1, 1, 1, 1, 1, 1.0, "r")


def uid(i):
    return f"{i:08x}-0000-4000-8000-000000000000"


def clustered(rng, n, groups, d=64, spread=0.035):
    """Groups of very unequal size, and noise."""
    sizes = np.maximum(1, (n * 0.6 * np.array([1 / (g + 1) ** 1.2 for g in range(groups)]) / sum(1 / (g + 1) ** 1.2 for g in range(groups))).astype(int))
    x = [c + spread * rng.standard_normal((s, d)) for s, c in zip(sizes, (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.standard_normal((groups, d))), strict=True)]
    x.append(rng.standard_normal((n - sum(sizes), d)))
    x = np.concatenate(x)[rng.permutation(n)].astype(np.float32)
    return x * rng.uniform(0.5, 2, (n, 1)).astype(np.float32)


def frame(spark, by_collection):
    rows = []
    for c, x in by_collection.items():
        rows += [(uid(i), c, [float(v) for v in r], None, None, *OTHER) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, KIND)


def unit(x):
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_nearest_kernel_recall():
    rng = np.random.default_rng(2)
    x = unit(clustered(rng, 3000, 60))
    x[5] = x[77] = x[3]  # ties
    row, other, sim = k.nearest(x, 5, 0.86)
    got, want = set(zip(row.tolist(), other.tolist(), strict=True)), exact_neighbours(x, 5, 0.86)
    assert len(got & want) >= 0.99 * len(want) and len(got) <= len(want) * 1.01
    assert np.allclose(sim, np.einsum("ij,ij->i", x[row], x[other]), atol=1e-6)
    for empty in (x[:0], x[:1]):
        assert len(k.nearest(empty, 5, 0.86)[0]) == 0 and len(k.links(empty, 0.86)[0]) == 0


@pytest.mark.parametrize("n", [2500, 9000])
def test_links_hold_the_linked_sets_together(n):
    """In one cell and in many; the spectral step finds the sets by itself, and the check reports and mends whatever it is given instead."""
    x = unit(clustered(np.random.default_rng(3), n, 40))
    p, c, w = k.links(x, 0.86)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.86, 1))
    want = k._components(n, a, b)
    assert np.array_equal(k._components(n, p, c), want) and (w >= 0.86 - 1e-6).all() and len(p) < 12 * n
    root, m = k.spectral_sets(x, 0.86)
    assert np.array_equal(root, want) and m["right"] >= 0.95 * m["sets"] > 0
    one, all_ = k.spectral_sets(x, 0.86, lambda e: np.zeros(len(e), int)), k.spectral_sets(x, 0.86, lambda e: np.arange(len(e)))
    assert np.array_equal(one[0], want) and one[1]["right"] == 0 and one[1]["parted"] == 1
    assert np.array_equal(all_[0], want) and all_[1]["right"] == 0 and all_[1]["across"] == len(p)


def test_a_chain_of_links_is_one_set():
    """Rows of which only neighbours are linked: the walk mixes slowly, and the check joins what k-means leaves apart."""
    angle = np.arange(60) * 0.5
    x = np.zeros((62, 64))
    x[:60, 0], x[:60, 1], x[60, 5], x[61, 6] = np.cos(angle[:60] / 5), np.sin(angle[:60] / 5), 1, 1
    root, m = k.spectral_sets(x, 0.99)
    assert set(root[:60].tolist()) == {0} and root[60:].tolist() == [60, 61] and m["sets"] == 1


def test_collisions_choose_what_is_verified():
    x = unit(clustered(np.random.default_rng(13), 9000, 60))
    stats: dict = {}
    row, other, _ = k.nearest(x, 5, 0.86, stats=stats)
    want = exact_neighbours(x, 5, 0.86)
    assert len(set(zip(row.tolist(), other.tolist(), strict=True)) & want) >= 0.995 * len(want)
    assert stats["counted"] < 9000 * 9000 and stats["verified"] < 0.5 * stats["counted"]


def test_windows_are_those_of_the_sorted_arrays():
    x = unit(np.random.default_rng(14).standard_normal((300, 64))).astype(np.float32)
    s, rows, q = k.SortedProjections(x), np.arange(50, 250), np.array([3, 299])
    hits = s.collisions(s.windows(q, np.array([0.3, 0.7])), rows)
    half = (k.REACH * np.array([0.3, 0.7])).astype(np.float32)
    want = (np.abs(s.values[:, q, None] - s.values[:, None, rows]) <= half[None, :, None]).sum(axis=0)
    assert np.abs(hits.astype(int) - want).max() <= 1 and (hits != want).mean() < 0.01  # but for rounding at the edge


def test_coarse_cells():
    x = unit(np.random.default_rng(15).standard_normal((500, 64)))
    y = unit(0.86 * x + np.sqrt(1 - 0.86**2) * unit(np.random.default_rng(16).standard_normal((500, 64))))
    for c in (2, 16, 128, 1024):
        a, b = (k.nearest_centres(v.astype(np.float32), c, 1) for v in (x, y))
        shared = (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
        assert a.shape[1] == k.spread(c) and shared.mean() > 0.98


def test_spectral_report(spark):
    x = clustered(np.random.default_rng(4), 500, 25)
    r = spectral_report(frame(spark, {"p": x})).first()
    assert r["collection"] == "p" and r["right"] == r["sets"] > 10 and r["parted"] == r["across"] == 0


@pytest.mark.parametrize("block", [100_000, 150, 40])
def test_neighbours_and_clusters_against_brute_force(spark, block):
    """One block; blocks against blocks; coarse cells cut into blocks."""
    rng = np.random.default_rng(4)
    data = {"p": clustered(rng, 500, 25), "q": clustered(rng, 60, 6)}
    df = frame(spark, data)
    near = {(r.collection, r.a, r.b) for r in similar_vectors(df, block_rows=block).select("collection", unpack_id(F.col("id")).alias("a"), unpack_id(F.col("other")).alias("b")).collect()}
    want = {(c, uid(i), uid(j)) for c, x in data.items() for i, j in exact_neighbours(unit(x), 5, 0.86)}
    assert len(near & want) >= 0.98 * len(want) and len(near) <= len(want) * 1.02
    members, usable = similarity_clusters(df, block_rows=block)
    got = {(r.collection, r.id, r.cluster_id) for r in members.select("collection", unpack_id(F.col("id")).alias("id"), unpack_id(F.col("cluster_id")).alias("cluster_id")).collect()}
    true = set()
    for c, x in data.items():
        a, b = np.nonzero(np.triu(unit(x) @ unit(x).T >= 0.86, 1))
        comp = k._components(len(x), a, b)
        true |= {(c, uid(i), uid(comp[i])) for i in set(a.tolist()) | set(b.tolist())}
    assert len(got ^ true) <= 0.02 * len(true)
    if block == 100_000:
        assert got == true
        top = describe_clusters(members, usable).where("rank = 1").collect()
        assert len(top) == len({t[2] + t[0] for t in true}) and all(0.8 < r.affinity <= r.member_affinity + 1e-9 for r in top)


def test_equal_vectors(spark):
    """A third of all rows is one vector: its copies see the smallest ids, and nothing is squared."""
    rng = np.random.default_rng(5)
    x = clustered(rng, 90, 5)
    x[30:60] = x[30]
    want = {tuple(sorted((uid(i), uid(j)))) for i, j in exact_neighbours(unit(x), 5, 0.86)}
    got = similar_pairs(frame(spark, {"c": x})).select(unpack_id(F.col("id_a")).alias("a"), unpack_id(F.col("id_b")).alias("b")).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    # as clusters: copies that are linked to others, copies that aren't, and few copies
    x[60:70], x[80:84] = np.eye(64)[7], np.eye(64)[9]
    a, b = np.nonzero(np.triu(unit(x) @ unit(x).T >= 0.86, 1))
    comp = k._components(len(x), a, b)
    members = similarity_clusters(frame(spark, {"c": x, "d": x[:1]}))[0].select(unpack_id(F.col("id")).alias("id"), unpack_id(F.col("cluster_id")).alias("c")).collect()
    assert {(r.id, r.c) for r in members} == {(uid(i), uid(comp[i])) for i in set(a.tolist()) | set(b.tolist())} and len(members) == len(set(a.tolist()) | set(b.tolist()))


def test_unusable_rows(spark):
    good = [0.0] * 63 + [1.0]
    nan, inf = [float("nan")] + good[1:], [float("inf")] + good[1:]
    datas = [None, [], good[:10], [0.0] * 64, nan, inf, [None] + good[1:], good]
    rows = [(uid(i), "c", d, None, None, *OTHER) for i, d in enumerate(datas)]
    rows += [(uid(7).upper(), "c", good, None, None, *OTHER), (None, "c", good, None, None, *OTHER), (uid(1), None, good, None, None, *OTHER), ("not a uuid", "c", good, None, None, *OTHER)]
    df = spark.createDataFrame(rows, KIND)
    assert {r.x for r in usable_vectors(df).select(unpack_id(F.col("id")).alias("x")).collect()} == {uid(7), "not a uuid"}
    assert similar_pairs(df).count() == 1
    none = df.limit(0)
    assert similar_pairs(none).count() == 0 and similarity_clusters(none)[0].count() == 0
    req = spark.createDataFrame([(1, "c", 5, None)], "request_id int, collection string, subset_size int, group_key string")
    assert varied_subsets(none, req).count() == 0


def test_packed_ids(spark):
    ids = [uid(3), "x", "", "ABC" * 30, uid(3)[:-1] + "g"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").orderBy("i").select(unpack_id(pack_id(F.col("x")))).collect()
    assert [r[0] for r in got] == ids


def test_connect(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 203), (201, 203), (202, 203)]
    got = {r.node: r.low for r in connect(spark.createDataFrame(e, "a int, b int"), "test").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100 and {got[i] for i in (201, 202, 203)} == {200} and 7 in got
    assert connect(spark.createDataFrame([], "a int, b int"), "test").count() == 0


def test_farthest_first_is_a_two_approximation():
    x = unit(np.random.default_rng(6).standard_normal((300, 8)))
    rows, dist = k.farthest_first(x, 20, np.zeros(1, int), np.zeros(300, int))
    cover = (1 - x @ x[rows].T).min(axis=1)
    # the next choice would be the farthest row, and no choice was nearer to those before
    assert len(set(rows.tolist())) == 20 and cover.max() <= dist[1:].min() + 1e-9
    rows, _ = k.farthest_first(x, 500, np.zeros(1, int), np.zeros(300, int))
    assert sorted(rows.tolist()) == list(range(300))


def test_subsets(spark):
    rng = np.random.default_rng(7)
    x = clustered(rng, 400, 8)
    meta = lambda i: None if i % 9 == 0 else "{cut" if i % 9 == 1 else '{"g": "%s"}' % (["a", " A", "b", "rare"][0 if i % 3 else 1 if i % 2 else 2] if i % 50 else "rare")
    rows = [(uid(i), "c", [float(v) for v in r], meta(i), None, *OTHER) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, KIND)
    asked = [(1, "c", 30, "g"), (1, "c", 30, "g"), (2, "c", 9999, None), (3, "c", 0, None), (4, "none", 5, None), (5, "c", None, None), (6, None, 5, None), (7, "c", 12, "absent"), (8, "c", 3, "g")]
    req = spark.createDataFrame([(*r, "x") for r in asked], "request_id int, collection string, subset_size int, group_key string, id string")
    for block in (10_000, 64):
        got = varied_subsets(df, req, block_rows=block).collect()
        by = {i: [r for r in got if r.request_id == i] for i in range(1, 9)}
        assert {i: len(v) for i, v in by.items()} == {1: 30, 2: 400, 3: 0, 4: 0, 5: 0, 6: 0, 7: 12, 8: 3}
        assert all(sorted(r.rank for r in v) == list(range(1, len(v) + 1)) and len({bytes(r.id) for r in v}) == len(v) for v in by.values())
        assert {r.grp for r in by[1]} == {"", "a", "b", "rare"} and len({r.grp for r in by[8]}) == 3 and {r.grp for r in by[7]} == {""}
        # as spread as one farthest-first run over all rows, but for the factor that the blocks cost
        u = unit(x)
        chosen = u[[int(unpack[:8], 16) for unpack in [bytes(r.id)[1:].hex() for r in by[7]]]]
        best = u[k.farthest_first(u, 12, np.zeros(1, int), np.zeros(400, int))[0]]
        assert (1 - u @ chosen.T).min(axis=1).max() <= 1.5 * (1 - u @ best.T).min(axis=1).max()


def test_each_value_keeps_its_first_place(spark):
    """Of values whose vectors all lie within a large group, and of as many values as places beside rows without a value."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64)
    x = centre + 0.01 * rng.standard_normal((300, 64))
    group = np.zeros(300, int)
    group[[7, 8, 9]], group[50] = 1, 2
    rows, dist = k.farthest_first(unit(x), 12, np.array([4, 3, 1]), group)
    assert {0, 1, 2} == set(group[rows[:3]].tolist()) and len(set(rows.tolist())) == 12 and (dist[1:] < k.NEAR).all()
    for block in (10_000, 64):
        meta = lambda i: '{"s": "v%d"}' % (i % 10) if i < 30 else '{"s": "v0"}' if i < 100 else None
        df = spark.createDataFrame([(uid(i), "c", [float(v) for v in r], meta(i), None, *OTHER) for i, r in enumerate(x)], KIND)
        req = spark.createDataFrame([(1, "c", 10, "s"), (2, "c", 11, "s"), (3, "c", 4, "s")], "request_id int, collection string, subset_size int, group_key string")
        got = varied_subsets(df, req, block_rows=block).collect()
        values = {f"v{i}" for i in range(10)}
        assert {r.grp for r in got if r.request_id == 1} == values and {r.grp for r in got if r.request_id == 2} == values | {""}
        assert len({r.grp for r in got if r.request_id == 3} - {""}) == 4
    counts = spark.createDataFrame([(1, "", 2)] * 9 + [(1, "a", 2)] + [(1, "b", 2)], "request_id int, grp string, subset_size int")
    assert {r.grp: r.reserve for r in reserves(counts).collect()} == {"a": 1, "b": 1, "": 0}


@pytest.mark.parametrize("share", [0.3, 0.02])
def test_a_hot_set_is_never_listed_as_pairs(share, monkeypatch):
    """Copies amid single rows: most hubs, or all that are tried, are single rows; the links stay a forest and the memory small."""
    rng = np.random.default_rng(9)
    n = 6000
    x = rng.standard_normal((n, 64))
    hot = rng.permutation(n)[: int(share * n)]
    x[hot] = x[hot[0]] + 0.01 * rng.standard_normal((len(hot), 64))
    x = unit(x).astype(np.float32)
    for strays in (32, 0):
        monkeypatch.setattr(k, "STRAYS", strays, raising=False)
        tracemalloc.start()
        p, c = k._cell_forest(x, 0.86)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        a, b = np.nonzero(np.triu(x @ x.T >= 0.86, 1))
        want = k._components(n, a, b)
        assert np.array_equal(k._components(n, p, c), want) and len(p) == (want != np.arange(n)).sum() and peak < 80e6


def test_neighbours_a_little_above_the_least_similarity():
    rng = np.random.default_rng(11)
    centres = unit(rng.standard_normal((600, 64)))
    x = unit(centres[rng.integers(600, size=6000)] + 0.045 * rng.standard_normal((6000, 64)))
    row, other, _ = k.nearest(x, 5, 0.86)
    want = exact_neighbours(x, 5, 0.86)
    assert len(set(zip(row.tolist(), other.tolist(), strict=True)) & want) >= 0.995 * len(want)


def test_sizes_beyond_a_block(spark, monkeypatch):
    """A quarter, nearly all and all of a collection, a third of which are copies: no task sees more than a block, and small groups are all met."""
    import vectorloom.llm.subset as sub

    rng = np.random.default_rng(17)
    n, block = 1500, 128
    x = clustered(rng, n, 30)
    x[500:1000] = x[500]
    df = spark.createDataFrame([(uid(i), "c", [float(v) for v in r], '{"s": "v%d"}' % (i % 3) if i % 5 else None, None, *OTHER) for i, r in enumerate(x)], KIND)
    req = spark.createDataFrame([(1, "c", n // 4, None), (2, "c", n - 50, "s"), (3, "c", n, None), (4, "c", 9999, "s"), (5, "c", 20, "s")], "request_id int, collection string, subset_size int, group_key string")
    seen = spark.sparkContext.accumulator(0)
    choose = sub._choose

    def watched(table):
        if table.num_rows > 2 * block:
            seen.add(1)
        return choose(table)

    monkeypatch.setattr(sub, "_choose", watched)
    got = varied_subsets(df, req, block_rows=block).collect()
    by = {i: [r for r in got if r.request_id == i] for i in range(1, 6)}
    assert {i: len(v) for i, v in by.items()} == {1: n // 4, 2: n - 50, 3: n, 4: n, 5: 20} and seen.value == 0
    assert all(sorted(r.rank for r in v) == list(range(1, len(v) + 1)) and len({bytes(r.id) for r in v}) == len(v) for v in by.values())
    u, place = unit(x), lambda r: int(bytes(r.id)[1:].hex()[:8], 16)
    rows = [place(r) for r in by[1]]
    assert sum(500 <= i < 1000 for i in rows) < 60  # a third of the collection, and hardly more than one place's worth of variety
    best = u[k.farthest_first(u, n // 4, np.zeros(1, int), np.zeros(n, int))[0]]
    assert (1 - u @ u[rows].T).min(axis=1).max() <= 2.5 * (1 - u @ best.T).min(axis=1).max()
