"""Embedding near duplicates against all pairs."""

import math
import random

import numpy as np

from siltstone.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, raw string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA).repartition(4)


def plain(rows, threshold=0.9):
    """Exact links and components."""
    usable = [(k, np.array(v, dtype=np.float32).astype(float)) for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(usable):
        for j, b in usable[:n]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, links[k], least.get(find(k))) for k, (i, _) in enumerate(rows)]


def near_groups(seed, groups, copies, alone, dim=32, noise=0.06):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = r.normal(size=dim)
        out += [base / np.linalg.norm(base) + noise * r.normal(size=dim) * r.choice([0, 1, 1.3]) for _ in range(copies)]
    out += list(r.normal(size=(alone, dim)))
    order = r.permutation(len(out))
    return [(int(n), out[k].astype(np.float32).tolist()) for n, k in enumerate(order)]


def test_recall_and_precision(spark):
    rows = near_groups(1, groups=40, copies=8, alone=300)
    got = {x.vec_id: x for x in vectors.near_duplicates(frame(spark, rows)).collect()}
    want = plain(rows)
    assert len(got) == len(rows)
    assert all(got[i].n_links <= n for i, n, _ in want)
    assert sum(got[i].n_links for i, _, _ in want) >= 0.97 * sum(n for _, n, _ in want) > 0
    assert sum(got[i].component_id == c for i, _, c in want) >= 0.97 * len(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())


def test_large_group_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rows = near_groups(2, groups=1, copies=150, alone=30, noise=0.02)
    got = {x.vec_id: (x.n_links, x.component_id) for x in vectors.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (n, c) for i, n, c in plain(rows)}


def test_awkward_vectors(spark):
    r = random.Random(3)
    v = [r.gauss(0, 1) for _ in range(8)]
    rows = [(5, v), (3, v), (3, v), (9, [2 * c for c in v]), (1, None), (2, []), (4, [0.0] * 8), (6, [None, *v[1:]]), (7, [float("nan"), *v[1:]]), (8, [float("inf"), *v[1:]]), (10, v[:7]), (None, v), (11, [-c for c in v])]
    got = [(x.vec_id, x.n_links, x.component_id) for x in vectors.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    assert vectors.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def codes(x, bits=10, bands=16, least=160):
    signs, factor, small, scale, gap = vectors.encoded(x.astype(np.float32), least)
    return vectors.Codes([r.tobytes() for r in signs], factor, [r.tobytes() for r in small], scale, gap, bits, bands, least)


def test_estimates_are_unbiased_and_bounded():
    x = np.random.default_rng(4).normal(size=(300, 48))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    estimate, bound = codes(x).estimates(codes(x), 5.0)
    error = estimate - unit @ unit.T
    assert abs(error[~np.eye(300, dtype=bool)].mean()) < 0.005
    assert (np.abs(error) <= bound).mean() > 0.9999


def test_bytes_lie_within_the_stored_gap():
    x = np.random.default_rng(6).normal(size=(100, 24)).astype(np.float32)
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    _, _, small, scale, gap = vectors.encoded(x, 40)
    assert (np.linalg.norm(unit - small * scale[:, None].astype(float), axis=1) <= gap + 1e-6).all()
    assert gap.max() < 0.02


def test_only_codes_are_dealt_to_all_bands(spark):
    """Vectors without a partner are never read again once they have codes."""
    alone = np.random.default_rng(5).normal(size=(400, 64))
    alone = np.concatenate([alone, alone[:3] + 0.01])
    own = vectors.NearVectors(frame(spark, [(k, v.astype(np.float32).tolist()) for k, v in enumerate(alone)]))
    own.fold()
    own.partial()
    chosen = spark.read.parquet(own.ws.path("chosen"))
    assert {"raw", "embedding"}.isdisjoint(own.codes.columns)
    dealt = own.codes.selectExpr("size(bands) as n").agg({"n": "sum"}).first()[0]
    assert 6 <= chosen.count() < dealt / 20


def test_rotations_keep_lengths():
    for dim, wide in ((5, 40), (40, 40), (50, 20)):
        q = vectors.rotation(dim, wide).astype(float)
        assert np.allclose(q.T @ q, np.eye(dim), atol=1e-5)
