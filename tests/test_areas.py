"""Areas with holes against point sampling."""

import math
import random

from pyspark.sql import functions as F

from gridwright.operators import grid, vector

RINGS = {1: [[(1.2, 1.1), (8.7, 0.6), (9.3, 7.9), (4.1, 9.4), (0.7, 6.2)], [(3.2, 3.1), (6.3, 3.4), (5.1, 6.7)]], 2: [[(10.2, 2.3), (11.9, 2.3), (11.9, 11.1), (10.2, 11.1)]]}


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if min(ay, by) <= y < max(ay, by) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                odd = not odd
    return odd


def segments(spark):
    rows = [(i, [[list(p) for p in [*ring, ring[0]]] for ring in rings]) for i, rings in RINGS.items()]
    return vector.polyline_segments(spark.createDataFrame(rows, "id int, paths array<array<array<double>>>"))


def test_fill_covers_centres(spark):
    got = {(r.id, r.row, r.col) for r in grid.fill(segments(spark), 0.0, 12.0, 0.5, 24, 24).collect()}
    assert got == {(i, r, c) for i, rings in RINGS.items() for r in range(24) for c in range(24) if inside((c + 0.5) / 2, 12 - (r + 0.5) / 2, rings)}
    touched = {(r.row, r.col) for r in grid.burn_areas(segments(spark), 0.0, 12.0, 0.5, 24, 24).collect()}
    assert {(r, c) for _, r, c in got} < touched
    dense = {(int((12 - y) * 2), int(x * 2)) for rings in RINGS.values() for x, y in ((i / 40, j / 40) for i in range(480) for j in range(1, 480)) if inside(x, y, rings)}
    assert dense <= touched


def test_length_inside(spark):
    r = random.Random(3)
    points = [(r.uniform(0, 12), r.uniform(0, 12)) for _ in range(7)]
    rows = [("p", i, *a, *b) for i, (a, b) in enumerate(zip(points, points[1:], strict=False))]
    route = spark.createDataFrame(rows, "preset string, step int, x1 double, y1 double, x2 double, y2 double")
    got = {x.id: x.length for x in vector.length_inside(route, segments(spark), 2.0).collect()}
    for i, rings in RINGS.items():
        want = sum(math.dist(a, b) * sum(inside(a[0] + (b[0] - a[0]) * t / 5000, a[1] + (b[1] - a[1]) * t / 5000, rings) for t in range(5000)) / 5000 for a, b in zip(points, points[1:], strict=False))
        assert abs(got.get(i, 0) - want) < 0.02
    assert vector.length_inside(route.filter(F.lit(False)), segments(spark), 2.0).count() == 0
