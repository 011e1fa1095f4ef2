"""Routes against areas and lines: lengths by dense sampling, touching points, shared edges, coordinates of the real grid."""

import math
import random

import pytest

from gridwright.operators import report, vector


def rings_of(spark, areas):
    rows = [(i, [[[float(c) for c in p] for p in [*ring, ring[0]]] for ring in rings]) for i, rings in areas.items()]
    return vector.polyline_segments(spark.createDataFrame(rows, "id string, paths array<array<array<double>>>"))


def route_of(spark, points, preset="p"):
    rows = [(preset, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(points, points[1:], strict=False))]
    return spark.createDataFrame(rows, "preset string, step int, x1 double, y1 double, x2 double, y2 double")


def found(df):
    return {r.id: (r.length_m, r.dimension) for r in df.collect()}


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


CASES = [
    ([(-5, 5), (15, 5)], (10.0, 1)),  # through
    ([(2, 2), (4, 4)], (round(2 * math.sqrt(2), 3), 1)),  # all inside
    ([(-5, 0), (15, 0)], (10.0, 1)),  # along an edge, below
    ([(-5, 10), (15, 10)], (10.0, 1)),  # along an edge, above
    ([(0, -5), (0, 3)], (3.0, 1)),
    ([(-5, -5), (0, 0)], (0.0, 0)),  # ends at a corner
    ([(-5, 5), (5, 15)], (0.0, 0)),  # passes a corner
    ([(-5, 5), (0, 5)], (0.0, 0)),  # ends on an edge
    ([(0, 5), (-5, 5)], (0.0, 0)),
    ([(10, 10), (15, 15)], (0.0, 0)),
    ([(-1, -1), (11, 11)], (round(10 * math.sqrt(2), 3), 1)),  # from corner to corner
    ([(-5, 5), (5, 5), (5, 20)], (10.0, 1)),  # two steps
    ([(-5, 12), (15, 12)], None),
    ([(11, -5), (11, 15)], None),
    ([(5, 10), (10, 5)], (round(5 * math.sqrt(2), 3), 1)),  # from edge to edge
]


@pytest.mark.parametrize("turn", [0, 1])
def test_one_square(spark, turn):
    ring = SQUARE if not turn else SQUARE[::-1]
    rows = [(str(k), i, *map(float, a), *map(float, b)) for k, (points, _) in enumerate(CASES) for i, (a, b) in enumerate(zip(points, points[1:], strict=False))]
    routes = spark.createDataFrame(rows, "preset string, step int, x1 double, y1 double, x2 double, y2 double")
    got = {r.preset: (r.length_m, r.dimension) for r in report.area_crossings(routes, rings_of(spark, {"a": [ring]}), 7.0).collect()}
    assert got == {str(k): want for k, (_, want) in enumerate(CASES) if want}


def test_holes_and_shared_edges(spark):
    areas = {"ring": [SQUARE, [(3, 3), (7, 3), (7, 7), (3, 7)]], "hole": [[(3, 3), (7, 3), (7, 7), (3, 7)]], "split": [[(0, 0), (5, 0), (5, 10), (0, 10)]]}
    got = found(report.area_crossings(route_of(spark, [(-2, 5), (12, 5)]), rings_of(spark, areas), 4.0))
    assert got == {"ring": (6.0, 1), "hole": (4.0, 1), "split": (5.0, 1)}
    # along the hole's edge: it belongs to both
    assert found(report.area_crossings(route_of(spark, [(-2, 3), (12, 3)]), rings_of(spark, areas), 4.0)) == {"ring": (10.0, 1), "hole": (4.0, 1), "split": (5.0, 1)}


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if min(ay, by) <= y < max(ay, by) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                odd = not odd
    return odd


def test_random_areas_against_sampling(spark):
    r = random.Random(8)
    areas = {}
    for i in range(12):
        cx, cy, n = r.uniform(0, 30), r.uniform(0, 30), r.randint(3, 9)
        spokes = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
        areas[str(i)] = [[(cx + r.uniform(2, 9) * math.cos(t), cy + r.uniform(2, 9) * math.sin(t)) for t in spokes]]
    points = [(r.uniform(0, 30), r.uniform(0, 30)) for _ in range(9)]
    got = found(report.area_crossings(route_of(spark, points), rings_of(spark, areas), 5.0))
    for i, rings in areas.items():
        want = sum(math.dist(a, b) * sum(inside(a[0] + (b[0] - a[0]) * (t + 0.5) / 4000, a[1] + (b[1] - a[1]) * (t + 0.5) / 4000, rings) for t in range(4000)) / 4000 for a, b in zip(points, points[1:], strict=False))
        assert abs(got.get(i, (0, 0))[0] - want) < 0.05, i
        assert (i in got) or want < 0.02


def test_shared_stretches_on_the_real_grid(spark):
    """Steps between centres of cells and a feature along them whose ends have other fractions: one line, though rounding keeps them apart."""
    west, north = 283_712.3, 6_428_913.7
    a, b = (west + 50.0, north - 50.0), (west + 350.0, north - 350.0)
    third = [(a[0] + (b[0] - a[0]) * k / 7, a[1] + (b[1] - a[1]) * k / 7) for k in (1, 3, 6)]
    line = spark.createDataFrame([("f", *third[0], *third[1]), ("f", *third[1], *third[2])], "id string, x1 double, y1 double, x2 double, y2 double")
    steps = [(west + 50 + 100 * k, north - 50 - 100 * k) for k in range(4)]
    length, dimension = found(report.crossings(route_of(spark, steps), line, 150.0))["f"]
    assert dimension == 1 and abs(length - math.dist(a, b) * 5 / 7) < 0.002
    square = [(a[0], a[1]), (b[0], b[1]), (b[0], a[1])]
    length, dimension = found(report.area_crossings(route_of(spark, steps), rings_of(spark, {"t": [square]}), 150.0))["t"]
    assert dimension == 1 and abs(length - math.dist(a, b)) < 0.002


def test_inventory_holds_lines_and_areas(spark):
    route = route_of(spark, [(-5, 5), (15, 5)])
    ring = rings_of(spark, {"1": [SQUARE]}).selectExpr("'land' as component", "id", "cast(null as boolean) as major", "x1", "y1", "x2", "y2")
    line = spark.createDataFrame([("roads", 7, True, 5.0, -5.0, 5.0, 15.0)], "component string, id int, major boolean, x1 double, y1 double, x2 double, y2 double")
    got = [tuple(r) for r in report.impact_inventory(route, line, 6.0, ring).collect()]
    assert got == [("p", "land", "1", 10.0, 1, None), ("p", "roads", "7", 0.0, 0, True)]
    assert report.impact_inventory(route.limit(0), line, 6.0, ring).count() == 0
