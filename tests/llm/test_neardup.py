import numpy as np
import pytest

from sparklog.llm import neardup


def brute(rows, width, percent):
    """Exact sets, all pairs, union-find on doc_id."""
    sets = []
    for i, text in rows:
        low = (text or "").encode().lower().split()
        sets.append((i, {tuple(low[p : p + width]) for p in range(len(low) - width + 1)} if len(low) >= width else ({tuple(low)} if low else set())))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i) if i is not None else None) for i, s in sets]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(docs, width, percent):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = neardup.near_duplicates(docs, width, percent).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute(rows, width, percent), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_chains_and_strays(spark):
    """Documents that only a third one links, and a bucket whose head links to nothing."""
    words = [f"w{i}" for i in range(200)]
    rows = [(10 + k, " ".join(words[3 * k : 3 * k + 120])) for k in range(12)]
    rows += [(100 + k, " ".join(["x"] * k + [f"v{i}" for i in range(100)])) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: c for i, _, c in brute(rows, 3, 85)}
    assert len({got[i] for i in range(10, 22)}) == 1


def test_empty_table(none):
    assert neardup.near_duplicates(none).collect() == []
    assert neardup.dedup(none).collect() == []


def test_dedup_keeps_rows_and_columns(docs):
    out = neardup.dedup(docs)
    assert out.columns == docs.columns
    left = [r.doc_id for r in out.collect()]
    assert 12 not in left and 13 not in left and 1 in left and None in left


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    make = lambda x: neardup.sketches(x, np.zeros(len(x), np.int64), 1)
    assert (np.maximum(make(pool[:1000]), make(pool[1000:])) == make(pool)).all()
    for shared in (0, 500, 1000, 1800):
        a, b = pool[:2000], np.concatenate([pool[:shared], pool[2000 : 2000 + 2000 - shared] if shared >= 1000 else rng.integers(0, 1 << 62, 2000 - shared).astype(np.uint64)])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found = neardup.joint_estimate(make(a), make(b), np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(found - truth) < 0.12


def test_bands_miss_little():
    for threshold in (0.8, 0.85, 0.9):
        r = neardup.band_rows(threshold)
        assert (1 - threshold**r) ** (neardup.REGISTERS // r) <= neardup.MISS


@pytest.mark.parametrize("block", [3, 1000])
def test_many_strays_in_blocks(spark, monkeypatch, block):
    """Near copies that their head doesn't link to, some of which link to each other."""
    import random

    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        own = list(base)
        for p in rng.sample(range(150), 4 + k % 7):
            own[p] = f"e{k // 4 if k % 3 else k}x{p}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 3, 85).collect()}
    want = {i: c for i, _, c in brute(rows, 3, 85)}
    assert got == want and 1 < len(set(want.values())) < 59
