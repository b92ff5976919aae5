"""Hard negatives and vector codes against plain Python versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

import __spark_entry__ as E
from ridgeline.llm import common, hardneg, vectorcodes

NAN, INF = float("nan"), float("inf")


def f32(x):
    return float(np.float32(x))


def vectors(n=300, width=8, seed=1, labels=4):
    """Clusters, equal vectors, ties and one label that a third of the rows have."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.4) for _ in range(width)] for _ in range(6)]
    out = []
    for i in range(n):
        c = centres[r.randrange(6)]
        v = c if r.random() < 0.2 else [x + r.gauss(0, 0.15) for x in c]
        out.append((i, [f32(x) for x in v], 0 if r.random() < 0.33 else r.randrange(labels)))
    return out


AWKWARD = [
    (None, [0.5] * 8, 1), (None, [0.5] * 8, 1), (5000, None, 1), (5001, [0.1] * 8, None), (5050, [0.2, None] * 4, 1), (5100, [NAN] * 8, 1), (5101, [INF] * 8, 2),
    (50, [0.3] * 8, 2), (50, [0.3] * 8, 2), (100, [-0.3] * 8, 3), (5150, [0.4] * 3, 1), (5200, [], 1), (5250, [0.25] * 11, 2), (5300, [0.0] * 8, 3), (5350, [-0.0] * 8, 2),
    (5400, [300.0, -200.5] * 4, 1), (5401, [299.0, -200.5] * 4, 2),
]


def negatives(rows):
    """Nested loops over the distinct rows that take part, in whole numbers."""
    kept = {(i, tuple(v), y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    kept = [(i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in kept]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a in kept:
        if a[0] is None or a[0] % 50:
            continue
        scored = [(sum(p * q for p, q in zip(a[1], b[1])), b[0], b[2]) for b in kept if b is not a]  # noqa: B905
        for p, positive, _ in sorted((x for x in scored if x[2] == a[2]), key=order)[:5]:
            fits = sorted((x for x in scored if x[2] != a[2] and 50 * p <= 100 * x[0] <= 95 * p), key=order)[:3]
            out += [(a[0], positive, k + 1, x[1], p, x[0]) for k, x in enumerate(fits)]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_op11_equals_nested_loops(spark, tables, monkeypatch, small):
    if small:  # many blocks, chunks, tiles and cuts
        for name, value in (("ANCHORS", 3), ("CHUNK", 40), ("LEAST_CHUNK", 10), ("TILE", 64), ("PENDING", 20)):
            monkeypatch.setattr(hardneg, name, value)
    rows = vectors() + AWKWARD
    got = E.queries()["op11_hard_negatives"](spark, tables(embeddings=rows, extra={"row": "x", "score": "y", "cell": "z"}))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = negatives(rows)
    assert len(want) > 20 and sorted((tuple(r) for r in got.collect()), key=str) == want


def test_op11_scores_beyond_64_bits_are_held(spark, tables):
    big = 3e38
    rows = [(0, [big, big], 1), (1, [big, 1.0], 1), (50, [1.0, 1.0], 2), (51, [-big, -big], 1)]
    assert hardneg.products(np.array([[2.0 ** 130, 1.0]]), np.array([[2.0 ** 130, 1.0], [-(2.0 ** 130), 0.0], [0.0, 3.0]])).tolist() == [[hardneg.LONG, -hardneg.LONG - 1, 3]]
    out = E.queries()["op11_hard_negatives"](spark, tables(embeddings=rows)).collect()
    assert all(50 * r.positive_score <= 100 * r.negative_score <= 95 * r.positive_score for r in out)


def codes(rows, entries=256, rounds=4):
    """Lloyd's rounds by comparing every part with every entry."""
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = max((len(v) for _, v, _ in kept), default=0)
    wide = max(1, -(-wide // 4)) * 4
    x = [[math.floor(1024 * c) for c in v] + [0] * (wide - len(v)) for _, v, _ in kept]
    w = wide // 4
    code, error, books = [[0] * 4 for _ in x], [0] * len(x), []
    for p in range(4):
        part = [v[p * w:(p + 1) * w] for v in x]
        book = [list(v) for v in part[:entries]]
        for step in range(rounds + 1):
            best = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(book)) for v in part]
            if step < rounds:
                for k in range(len(book)):
                    own = [v for v, (_, e) in zip(part, best, strict=True) if e == k]
                    if own:
                        book[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        books.append(book)
        for i, (d, k) in enumerate(best):
            code[i][p], error[i] = k, error[i] + d
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total = {}
    for (_, _, y), e in zip(kept, error, strict=True):
        total[y] = total.get(y, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for k in c), e, total[y], sha) for (i, _, y), c, e in zip(kept, code, error, strict=True)), key=str)


@pytest.mark.parametrize("block", [2048, 7])
def test_op12_equals_full_comparison(spark, tables, monkeypatch, block):
    monkeypatch.setattr(vectorcodes.compress, "__defaults__", (4, 256, 4, 1024, block, *vectorcodes.compress.__defaults__[5:]))
    rows = vectors(400) + AWKWARD
    got = E.queries()["op12_cover_tree_codes"](spark, tables(embeddings=rows, extra={"id": "x", "codes": "y", "its": "z"}))
    assert sorted((tuple(r) for r in got.collect()), key=str) == codes(rows)


def test_op12_fewer_rows_than_entries_and_other_settings(spark, tables):
    rows = [(3, [0.5, 0.25, 0.1, 0.2], 1), (1, [0.5, 0.2, 0.1, 0.2], None), (2, [-0.5, 0.2, 0.1, 0.2], None)]
    folder = tables(embeddings=rows)
    assert sorted((tuple(r) for r in E.queries()["op12_cover_tree_codes"](spark, folder).collect()), key=str) == codes(rows)
    many = vectors(200, 6, 3)
    got, books = vectorcodes.compress(common.table(spark, tables(embeddings=many), "embeddings"), entries=5, rounds=2)
    assert books.shape == (4, 5, 2)
    assert sorted((r.id, bytes(r.codes).hex(), r.error) for r in got.collect()) == sorted(x[:3] for x in codes(many, 5, 2))


def test_cover_trees_cover_and_add_up():
    r = np.random.default_rng(2)
    points = np.concatenate([r.integers(-400, 400, (300, 4)), np.repeat(r.integers(-9, 9, (5, 4)), 20, axis=0), 100000 + r.integers(0, 3, (40, 4))])
    place, end, parent, radius = vectorcodes.cover_tree(points)
    assert sorted(place) == list(range(len(points)))
    x = points[place]
    for i in range(len(x)):
        assert math.isclose(np.sqrt(((x[i:end[i]] - x[i]) ** 2).sum(axis=1)).max(), radius[i])
        if i:
            assert parent[i] < i < end[parent[i]] and end[i] <= end[parent[i]]
            assert radius[i] <= radius[parent[i]] / 2
    tree = vectorcodes.Tree(x, end, parent, radius)
    book = np.concatenate([x[:30], [[100001, 100001, 100001, 100001]]])
    start, stop, entry = tree.assign(book)
    assert len(start) < len(x)  # whole subtrees were given away
    want = vectorcodes.squares(x, book).argmin(axis=1)
    assert (tree.entries(book)[0] == want).all()
    for k in range(len(book)):
        assert ((tree.sums[stop] - tree.sums[start])[entry == k].sum(axis=0) == x[want == k].sum(axis=0)).all()


def test_large_components_keep_exact_distances():
    a = vectorcodes.held(np.array([[1e30, -1e30, 5.0, 1.0]]))
    assert int(((a - -a) ** 2).sum()) < 1 << 62
    far = np.array([[2 ** 28, 1, 0, 0], [-(2 ** 28), 0, 3, 0]])
    assert vectorcodes.squares(far, far).tolist() == [[0, 2 ** 58 + 10], [2 ** 58 + 10, 0]]
