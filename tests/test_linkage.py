"""Density clusters and Ward's merges against plain versions over all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quakeframe.operators import linkage

LEAST = linkage.LEAST


def all_pairs(x: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(x)))
    for i in range(x.shape[1]):
        total += (x[:, i, None] - x[None, :, i]) ** 2
    return np.sqrt(total)


def plain_density(ids: np.ndarray, x: np.ndarray, least: int, samples: int) -> tuple[dict[int, int], dict[int, float]]:
    """Labels and probabilities from all pairs: every edge in order, the whole dendrogram, condensed from the top."""
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    dist = all_pairs(x)
    core = np.sort(dist, axis=1)[:, min(samples, len(x) - 1)]
    reach = np.maximum(np.maximum(dist, core[:, None]), core[None, :])
    i, j = np.triu_indices(len(x), 1)
    rank = np.lexsort((j, i, reach[i, j]))
    top = list(range(len(x)))

    def find(a):
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        return a

    tree = {k: (None, None, 0.0, [k]) for k in range(len(x))}  # two parts, weight, members
    node = list(range(len(x)))
    for e in rank:
        a, b = find(i[e]), find(j[e])
        if a != b:
            tree[len(tree)] = (node[a], node[b], float(reach[i[e], j[e]]), tree[node[a]][3] + tree[node[b]][3])
            top[a], node[b] = b, len(tree) - 1
    clusters = {}  # number: parent, birth, fall of each own point, child clusters

    def condense(at: int, number: int, birth: float, parent: int | None) -> None:
        clusters[number] = me = {"parent": parent, "birth": birth, "fall": {}, "children": [], "members": tree[at][3], "split": 0.0}
        while True:
            left, right, weight, members = tree[at]
            density = 1 / max(weight, LEAST)
            if left is None:
                me["fall"][at] = 1 / LEAST
                return
            sides = [s for s in (left, right) if len(tree[s][3]) >= least]
            if len(sides) == 2:
                me["split"] = density
                for s in sides:
                    me["children"].append(len(clusters))
                    condense(s, len(clusters), density, number)
                return
            if not sides:
                me["fall"].update(dict.fromkeys(members, density))
                return
            me["fall"].update(dict.fromkeys(set(members) - set(tree[sides[0]][3]), density))
            at = sides[0]

    if len(x) >= least:
        condense(len(tree) - 1, 0, 0.0, None)
    value, chosen = {}, set()
    for n in sorted(clusters, reverse=True):  # a child has a larger number
        c = clusters[n]
        own = sum(f - c["birth"] for f in c["fall"].values()) + sum(len(clusters[k]["members"]) * (c["split"] - c["birth"]) for k in c["children"])
        below = sum(value[k] for k in c["children"])
        if n and not (c["children"] and below > own):
            chosen.add(n)
        value[n] = own if n in chosen else below
    labels, probability, falls, owner = dict.fromkeys(ids.tolist(), -1), dict.fromkeys(ids.tolist(), 0.0), {}, {}
    for n, c in clusters.items():
        above, at = None, n
        while at is not None:
            above, at = (at if at in chosen else above), clusters[at]["parent"]
        for p, f in c["fall"].items():
            falls[p], owner[p] = f, above
    taken = sorted({n for n in owner.values() if n is not None}, key=lambda n: min(clusters[n]["members"]))
    for p, n in owner.items():
        if n is not None:
            most = max([clusters[n]["split"], *clusters[n]["fall"].values()])
            labels[int(ids[p])], probability[int(ids[p])] = taken.index(n), min(1.0, falls[p] / most)
    return labels, probability


def blobs(n: int, d: int = 2, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    part = n // 5
    near = [rng.normal(c, s, (part, d)) for c, s in ((0, 0.3), (2.2, 0.25), (6, 1.0), (6.5, 0.2))]
    return np.concatenate([*near, rng.uniform(-3, 10, (n - 4 * part, d))])


def density(spark, x: np.ndarray, ids: np.ndarray, group=None, **options):
    d = x.shape[1]
    names = [f"f{k}" for k in range(d)]
    df = spark.createDataFrame([(int(i), int(group[k]) if group is not None else 0, *map(float, r)) for k, (i, r) in enumerate(zip(ids, x, strict=True))], ", ".join(["id long, g int", *[f"{c} double" for c in names]]))
    return linkage.density_clusters(df, "id", names, ["g"], **options).collect()


@pytest.mark.parametrize(("n", "d", "least", "samples", "block"), [(2000, 2, 25, 8, 256), (200, 3, 10, 4, 64)])
def test_density_clusters_equal_those_of_all_pairs(spark, n, d, least, samples, block):
    x, ids = blobs(n, d), np.random.default_rng(1).permutation(n) * 3
    labels, probability = plain_density(ids, x, least, samples)
    got = density(spark, x, ids, least_size=least, samples=samples, block=block)
    assert len(got) == n and len(set(labels.values())) > 3
    assert {r["id"]: r["label"] for r in got} == labels
    assert all(math.isclose(r["probability"], probability[r["id"]], rel_tol=1e-9) for r in got)
    means = {k: x[[labels[i] == k for i in ids.tolist()]].mean(axis=0) for k in set(labels.values()) - {-1}}
    at = {int(i): p for i, p in zip(ids, x, strict=True)}
    for r in got:
        want = r["label"] if r["label"] >= 0 else min(means, key=lambda k: ((at[r["id"]] - means[k]) ** 2).sum())
        assert r["nearest"] == want


def test_density_by_group_with_copies(spark):
    """Two groups at once, one of them with a third of its rows equal; each as if it were alone."""
    x = blobs(240)
    x[:80] = np.round(x[:80], 1)
    x[80:160] = x[80]
    group = np.arange(240) % 2
    got = {r["id"]: (r["g"], r["label"]) for r in density(spark, x, np.arange(240), group, least_size=10, samples=3)}
    for g in (0, 1):
        ids = np.flatnonzero(group == g)
        labels, _ = plain_density(ids, x[ids], 10, 3)
        mine = {i: got[i][1] for i in ids.tolist()}
        same = {}
        for i, v in labels.items():
            assert same.setdefault(v, mine[i]) == mine[i]
        assert len(set(same.values())) == len(same) and same.get(-1, -1) == -1


def test_density_by_boxes(spark, monkeypatch):
    """Boxes of 120 points in three levels give what all pairs give, copies and parts farther apart than boxes look included."""
    for name, value in {"LEFT": 120, "FAN": 2, "PART": 2}.items():
        monkeypatch.setattr(linkage, name, value, raising=False)
    x = blobs(800, 2, seed=3)
    x[100:300] = np.round(x[100:300], 1)  # copies, and many equal distances
    x[500:] += 12
    x, first = np.unique(x, axis=0, return_index=True)
    ids = np.random.default_rng(2).permutation(len(x)) * 2
    labels, probability = plain_density(ids, x, 12, 5)
    got = density(spark, x, ids, least_size=12, samples=5, block=64)
    assert {r["id"]: r["label"] for r in got} == labels and len(set(labels.values())) > 3
    assert all(math.isclose(r["probability"], probability[r["id"]], rel_tol=1e-9) for r in got)
    means = {k: x[[labels[i] == k for i in ids.tolist()]].mean(axis=0) for k in set(labels.values()) - {-1}}
    at = {int(i): p for i, p in zip(ids, x, strict=True)}
    assert all(r["nearest"] == (r["label"] if r["label"] >= 0 else min(means, key=lambda k: ((at[r["id"]] - means[k]) ** 2).sum())) for r in got)


def test_density_takes_few_rounds(spark, monkeypatch):
    """3,764 voxels in boxes of 1,000 are stored a few times, with the result of one box."""
    x = lattice(4000, 1)
    whole = density(spark, x, np.arange(len(x)), least_size=20, samples=5)
    monkeypatch.setattr(linkage, "LEFT", 1000)
    count, keep = [], linkage.stored
    monkeypatch.setattr(linkage, "stored", lambda df, name: count.append(name) or keep(df, name))
    assert sorted(density(spark, x, np.arange(len(x)), least_size=20, samples=5)) == sorted(whole)
    assert len({r["label"] for r in whole}) > 5 and len(count) < 25


def test_density_of_many_clusters(spark):
    """4,200 pairs are as many clusters, none of which passes the driver."""
    x = np.array([[10.0 * k + s] for k in range(4200) for s in (0, 1)])
    got = density(spark, x, np.arange(8400), least_size=2, samples=1)
    assert {r["id"]: (r["label"], r["probability"]) for r in got} == {k: (k // 2, 1.0) for k in range(8400)}


def test_contracted_regions_equal_the_whole():
    """What half a line of points is certain of, joins of clusters and edges that points come in by, is so for the whole line."""
    rng = np.random.default_rng(4)
    n, least = 600, 7
    u = rng.permutation(n - 1)
    v = u + 1
    into, born, _, joins, kept, fresh = linkage._contracted(list(range(n)), [1] * n, [None] * n, u.tolist(), v.tolist(), least)
    assert not kept and set(into) == {into[0]} and len(joins) == len(fresh) - 1 > 20
    inside = lambda e, low, high: int(low <= e < high)
    for low, high in ((0, 300), (300, 600)):
        k = [e for e in range(len(u)) if inside(u[e], low, high) or inside(v[e], low, high)]
        place = lambda p: int(p) - low if inside(p, low, high) else -1  # noqa: B023, E731
        part = linkage._contracted(list(range(low, high)), [1] * 300, [None] * 300, [place(u[e]) for e in k], [place(v[e]) for e in k], least)
        assert all(b < 0 or k[b] == born[low + p] for p, b in enumerate(part[1]))
        assert {k[j[0]] for j in part[3]} <= {j[0] for j in joins} and len(part[3]) > 5 and part[4]


def test_density_of_odd_tables(spark):
    none = spark.createDataFrame([], "id long, a double")
    assert linkage.density_clusters(none, "id", ["a"]).count() == 0
    rows = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (None, 2.0), (5, 1.0)], "id long, a double")
    assert sorted((r["id"], r["label"], r["nearest"]) for r in linkage.density_clusters(rows, "id", ["a"]).collect()) == [(1, -1, -1), (5, -1, -1)]


def plain_ward(x: np.ndarray) -> tuple[list[float], list[list[set]]]:
    """Heights of the greedy merges over all pairs, and the partition after each."""
    parts, heights, after = [({k}, p, 1.0) for k, p in enumerate(x)], [], []
    while len(parts) > 1:
        mean, n = np.array([p[1] for p in parts]), np.array([p[2] for p in parts])
        h = all_pairs(mean) * np.sqrt(2 * n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
        np.fill_diagonal(h, np.inf)
        i, j = sorted(np.unravel_index(np.argmin(h), h.shape))
        heights.append(float(h[i, j]))
        (a, p, m), (b, q, k) = parts[i], parts[j]
        parts = [r for t, r in enumerate(parts) if t not in (i, j)] + [(a | b, (p * m + q * k) / (m + k), m + k)]
        after.append([r[0] for r in parts])
    return heights, after


@pytest.mark.parametrize("left", [1000, 25])
def test_ward_equals_the_greedy_order(spark, monkeypatch, left):
    """The same heights and clusters whether the driver merges all points or only the last twenty-five clusters."""
    monkeypatch.setattr(linkage, "LEFT", left)
    x = blobs(60, 3, seed=8)
    heights, after = plain_ward(x)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id long, a double, b double, c double")
    merges, _ = linkage.ward_merges(df, "id", ["a", "b", "c"], block=64)
    got = sorted(r["height"] for r in merges.collect())
    assert np.allclose(got, sorted(heights), rtol=1e-9)
    labels = {r["id"]: r["label"] for r in linkage.ward_clusters(df, "id", ["a", "b", "c"], 5, block=64).collect()}
    want = sorted(after[-5], key=min)
    assert labels == {i: k for k, part in enumerate(want) for i in part}


def lattice(n: int, m: int = 0) -> np.ndarray:
    """Columns of equal steps, many of them equally far apart, as the voxels have."""
    p = np.arange(n)
    p = p[(p + m) % 17 != 0]
    return np.stack([p % 20, p // 20 % 20, 35 + 0.4 * (p // 400) + (p * (7 * m + 3) % 100) / 100], axis=1).astype(float)


def by_chain(x: np.ndarray) -> list[tuple[float, int, int, int]]:
    """Ward's merges over all clusters, each time along nearest ones to two that are each other's."""
    x, w, live, chain, out = x.copy(), np.ones(len(x)), np.arange(len(x)), [], []
    while len(live) > 1:
        c = chain[-1] if chain else int(live[0])
        chain = chain or [c]
        h = all_distances(x[c], x[live]) * np.sqrt(2 * w[c] * w[live] / (w[c] + w[live]))
        h[live == c] = np.inf
        j = int(live[h.argmin()])
        if len(chain) < 2 or j != chain[-2]:
            chain.append(j)
            continue
        chain = chain[:-2]
        a, b = min(c, j), max(c, j)
        out.append((float(h.min()), int(w[a] + w[b]), a, b))
        x[a], w[a] = (x[a] * w[a] + x[b] * w[b]) / (w[a] + w[b]), w[a] + w[b]
        live = live[live != b]
    return out


def all_distances(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(sum((p[i] - x[:, i]) ** 2 for i in range(len(p))))


@pytest.mark.parametrize("block", [8, 64])
def test_ward_of_equal_steps_and_blobs(block):
    """The same merges, ids and heights to the last bit, whether searched in small parts or all at once."""
    for x in (lattice(1500, 1), blobs(700, 3, seed=2), blobs(300, 1)):
        free = np.full(x.shape[1], np.inf)
        got = linkage._ward(x.copy(), np.ones(len(x)), -free, free, block)
        assert sorted(zip(*(c.tolist() for c in got), strict=True)) == sorted(by_chain(x))


def test_ward_within_walls():
    """What a thin box merges by itself are merges of the whole."""
    x = lattice(4000)
    whole = {(h, n, a, b) for h, n, a, b in by_chain(x)}
    inside = np.flatnonzero((x[:, 2] >= 36.1) & (x[:, 2] < 38.7))
    low, high = np.array([-np.inf, -np.inf, 36.1]), np.array([np.inf, np.inf, 38.7])
    height, size, a, b = linkage._ward(x[inside], np.ones(len(inside)), low, high, 64)
    got = set(zip(height.tolist(), size.tolist(), inside[a].tolist(), inside[b].tolist(), strict=True))
    assert got <= whole and len(got) > len(inside) / 6


def test_ward_takes_few_rounds(spark, monkeypatch):
    """3,764 voxels in boxes of 700 are stored a few times, not once for every doubling of a scale and every link of a chain."""
    monkeypatch.setattr(linkage, "LEFT", 700)
    count, keep = [], linkage.stored
    monkeypatch.setattr(linkage, "stored", lambda df, name: count.append(name) or keep(df, name))
    x = lattice(4000)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(x.tolist())], "id long, a double, b double, c double")
    merges, _ = linkage.ward_merges(df, "id", ["a", "b", "c"])
    got = sorted((r["height"], r["size"], r["a"], r["b"]) for r in merges.collect())
    assert got == sorted(by_chain(x))
    assert len(count) < 20
    labels = {r["id"]: r["label"] for r in linkage.ward_clusters(df, "id", ["a", "b", "c"], 40).collect()}
    top = list(range(len(x)))
    for _, _, a, b in sorted(got, key=lambda m: (m[0], m[1]))[:-39]:
        top[b] = a
    for k in range(len(x)):
        while top[top[k]] != top[k]:
            top[k] = top[top[k]]
    roots = sorted(set(top))
    assert labels == {k: roots.index(top[k]) for k in range(len(x))}


def test_ward_by_group_with_copies(spark):
    rows = [(k, k % 2, float(v)) for k, v in enumerate([0, 0, 0, 0, 5, 5.5, 9, 20, 9, 21])] + [(100, 0, None)]
    got = linkage.ward_clusters(spark.createDataFrame(rows, "id long, g int, v double"), "id", ["v"], 2, ["g"]).collect()
    assert {r["id"]: r["label"] for r in got} == {0: 0, 2: 0, 4: 1, 6: 1, 8: 1, 1: 0, 3: 0, 5: 0, 7: 1, 9: 1}
    assert linkage.ward_clusters(spark.createDataFrame([], "id long, v double"), "id", ["v"], 2).count() == 0
