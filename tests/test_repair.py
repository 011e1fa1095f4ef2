"""Repaired areas against even-odd sampling of their broken rings, and the rules that valid rings keep."""

import itertools
import math
import random
from collections import defaultdict

import pytest

from gridwright.operators import repair, vector

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
SHAPES = {
    "plain": [SQUARE],
    "clockwise": [SQUARE[::-1]],
    "bow": [[(0, 0), (10, 10), (10, 0), (0, 10)]],
    "spike": [[(0, 0), (10, 0), (10, 5), (20, 5), (10, 5), (10, 10), (0, 10)]],
    "inner spike": [[(0, 0), (5, 0), (5, 5), (5, 0), (10, 0), (10, 10), (0, 10)]],
    "hole": [SQUARE, [(2, 2), (4, 2), (4, 4), (2, 4)]],
    "nested": [SQUARE, [(1, 1), (9, 1), (9, 9), (1, 9)], [(3, 3), (6, 3), (6, 6), (3, 6)]],
    "overlap": [SQUARE, [(5, 5), (15, 5), (15, 15), (5, 15)]],
    "shared edge": [SQUARE, [(10, 2), (15, 2), (15, 8), (10, 8)]],
    "touching hole": [SQUARE, [(0, 5), (5, 3), (5, 7)]],
    "twice": [SQUARE, SQUARE],
    "loop": [[(0, 0), (10, 0), (10, 10), (4, 10), (4, -4), (6, -4), (6, 12), (0, 12)]],
    "flat": [[(0, 0), (5, 0), (9, 0)]],
    "star": [[(5 + 5 * math.sin(4 * math.pi * k / 5), 5 + 5 * math.cos(4 * math.pi * k / 5)) for k in range(5)]],
    "repeated points": [[(0, 0), (0, 0), (10, 0), (10, 10), (10, 10), (0, 10), (0, 0)]],
    "figure eight": [[(0, 0), (4, 0), (4, 4), (8, 4), (8, 8), (4, 8), (4, 4), (0, 4)]],
}


def segments(spark, shapes):
    rows = [(i, [[[float(c) for c in p] for p in [*ring, ring[0]]] for ring in rings]) for i, rings in shapes.items()]
    return vector.polyline_segments(spark.createDataFrame(rows, "id string, paths array<array<array<double>>>"))


def inside(x, y, edges):
    return sum(min(ay, by) <= y < max(ay, by) and x < ax + (y - ay) / (by - ay) * (bx - ax) for ax, ay, bx, by in edges) % 2 == 1


def edges_of(rings):
    return [(*a, *b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]


def check(shapes, rows, step=0.37):
    by = defaultdict(list)
    for r in rows:
        by[r.id].append(r)
    for i, rings in shapes.items():
        got = by[i]
        have = [(r.x1, r.y1, r.x2, r.y2) for r in got]
        xs, ys = ([c for ring in rings for c in (p[k] for p in ring)] for k in (0, 1))
        for x, y in itertools.product(*([min(v) - 0.6 + step * k for k in range(int((max(v) - min(v) + 1.2) / step) + 1)] for v in (xs, ys))):
            x, y = x + 0.0123, y + 0.0217
            assert inside(x, y, have) == inside(x, y, edges_of(rings)), (i, x, y)
        # rings are closed, and go on edge by edge; outer ones run counter-clockwise, holes clockwise
        for ring in {r.ring for r in got}:
            own = sorted((r for r in got if r.ring == ring), key=lambda r: r.seq)
            assert [r.seq for r in own] == list(range(len(own)))
            assert all((a.x2, a.y2) == (b.x1, b.y1) for a, b in zip(own, [*own[1:], own[0]], strict=True))
            assert (sum(r.x1 * r.y2 - r.x2 * r.y1 for r in own) <= 0) == own[0].hole
            assert len({(r.x1, r.y1) for r in own}) == len(own)  # a ring passes no vertex twice
        # no two edges cross
        for a, b in itertools.combinations(have, 2):
            side = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
            k = [side(a, *b[:2]), side(a, *b[2:]), side(b, *a[:2]), side(b, *a[2:])]
            assert not (k[0] * k[1] < -1e-9 and k[2] * k[3] < -1e-9), (i, a, b)


def test_broken_rings_keep_what_they_cover(spark):
    rings, problems = repair.repair(segments(spark, SHAPES), 4.0)
    rows = rings.collect()
    assert {(r.id, r.problem) for r in problems.collect()} == {("flat", "empty"), ("twice", "empty")}
    check(SHAPES, rows)
    totals = {r.id: (r.parts, r.holes, round(r.area, 6)) for r in repair.ring_totals(rings).collect()}
    assert totals["plain"] == totals["clockwise"] == totals["spike"] == totals["inner spike"] == totals["repeated points"] == (1, 0, 100.0)
    assert totals["bow"] == (2, 0, 50.0) and totals["hole"] == (1, 1, 96.0) and totals["overlap"] == (2, 0, 150.0) and totals["shared edge"] == (1, 0, 130.0)
    assert totals["nested"] == (2, 1, 100 - 64 + 9.0) and totals["star"][0] == 5 and totals["figure eight"] == (2, 0, 32.0)
    owners = {(r.ring, r.part) for r in rows if r.id == "nested" and r.hole}
    assert len(owners) == 1 and {p for _, p in owners} < {r.ring for r in rows if r.id == "nested" and not r.hole and abs(r.x1) < 11}


def test_random_rings(spark):
    r = random.Random(3)
    shapes = {str(i): [[(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(r.randint(3, 9))] for _ in range(r.randint(1, 2))] for i in range(12)}
    rings, problems = repair.repair(segments(spark, shapes), 3.0)
    assert problems.count() == 0
    check(shapes, rings.collect(), 0.53)


def test_large_coordinates_and_errors(spark):
    far = {"bow": [[(x + 330_000.25, y + 6_380_000.5) for x, y in SHAPES["bow"][0]]]}
    got = repair.ring_totals(repair.repaired(segments(spark, far), 4.0)).first()
    assert (got.parts, got.holes, round(got.area, 4)) == (2, 0, 50.0)
    with pytest.raises(ValueError, match="empty"):
        repair.repaired(segments(spark, {"flat": SHAPES["flat"]}), 4.0)
    none = segments(spark, far).limit(0)
    assert repair.repaired(none, 4.0).count() == 0


def test_candidate_pairs_are_made_once(spark, monkeypatch):
    """Long edges share many buckets and are a pair in one of them, without a grouping of pairs."""
    plans, kept = [], repair._kept
    monkeypatch.setattr(repair, "_kept", lambda df, label: (label == "cuts" and plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df, label))[1])
    edges = spark.createDataFrame([(1, -9.0, -9.0, 9.0, 9.0), (1, -9.0, 9.0, 9.0, -9.0)], "id int, x1 double, y1 double, x2 double, y2 double")
    cut, n = repair._cut_once(edges, 2.0, 1e-6)
    assert n == 2 and cut.count() == 4 and plans[0].count("Aggregate") == 1
