"""Routing rules, published figures, and the tiled distances against the search."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from gridwright.operators import cost, grid, routing
from gridwright.sources.workspace import use_checkpoints

INF = math.inf
PUBLISHED = [(128, "astar", 8023, 184, 220.959415), (128, "dijkstra", 16281, 184, 220.959415), (256, "astar", 27635, 371, 450.540151), (256, "dijkstra", 65032, 371, 450.540151), (512, "astar", 111200, 746, 908.287409), (512, "dijkstra", 260119, 746, 908.287409)]


@pytest.mark.parametrize(("size", "algorithm", "explored", "cells", "total"), PUBLISHED)
def test_published_figures(size, algorithm, explored, cells, total):
    path, found, settled = routing.search(grid.benchmark_costs(size), (1, 1), (size - 2, size - 2), algorithm)
    assert (len(path), settled, round(found, 6)) == (cells, explored, total)


def test_both_algorithms_agree_and_avoid_walls():
    a, b = (routing.search(np.ones((5, 5)), (0, 0), (4, 4), x) for x in routing.ALGORITHMS)
    assert a[1] == b[1] and a[2] <= b[2]
    wall = np.ones((5, 5))
    wall[1:4, 2] = 100
    assert all(wall[c] < 100 for c in routing.search(wall, (2, 0), (2, 4))[0])


@pytest.mark.parametrize("costs", [[[1, INF, 1]], [[1, INF, 1], [INF, 1, 1], [1, 1, 1]]])
def test_no_route(costs):
    with pytest.raises(routing.NoRoute):
        routing.search(np.array(costs), (0, 0), (0, 2))


def test_one_blocked_corner_forbids_the_diagonal():
    g = np.ones((2, 2))
    g[0, 1] = INF
    assert routing.search(g, (0, 0), (1, 1))[0] == [(0, 0), (1, 0), (1, 1)]


def test_bad_input():
    one = np.ones((1, 1))
    assert routing.search(one, (0, 0), (0, 0)) == ([(0, 0)], 0.0, 1)
    for call in (lambda: routing.search(one, (0, 0), (0, 0), "bellman-ford"), lambda: routing.search(one, (0, 0), (0, 1)), lambda: routing.search(-one, (0, 0), (0, 0)), lambda: routing.search(np.array([[math.nan]]), (0, 0), (0, 0))):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_tiles_give_the_same_distances(spark, tile):
    use_checkpoints(spark)
    r = random.Random(tile)
    g = np.array([[INF if r.random() < 0.2 else r.randint(0, 9) for _ in range(15)] for _ in range(13)], float)
    g[0, 0] = 1
    cells = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(13) for j in range(15)], "row int, col int, cost double")
    got = {(x.row, x.col): x.distance for x in routing.tile_distances(cells, (0, 0), tile).collect()}
    for i in range(13):
        for j in range(15):
            try:
                want = routing.search(g, (0, 0), (i, j), "dijkstra")[1]
            except routing.NoRoute:
                want = None
            assert (i, j) in got if want is not None else (i, j) not in got
            if want is not None:
                assert abs(got[i, j] - want) < 1e-9


def test_routes_over_tiles(spark):
    """The published landscape twice over, once with a gap in it, in tiles of 64: costs of the search, and legal steps."""
    size = 256
    g = grid.benchmark_costs(size)
    blocked = g.copy()
    blocked[100, 3:250] = INF
    rows = [(name, i, j, float(x[i, j])) for name, x in (("open", g), ("blocked", blocked)) for i in range(size) for j in range(size)]
    cells = spark.createDataFrame(pd.DataFrame(rows, columns=["preset", "row", "col", "cost"])).selectExpr("preset", "cast(row as int) row", "cast(col as int) col", "cost").cache()
    got = routing.tile_routes(cells, (1, 1), (size - 2, size - 2), 64).cache()
    for name, x in (("open", g), ("blocked", blocked)):
        steps = sorted((r.step, r.row, r.col, r.route_cost) for r in got.filter(got.preset == name).collect())
        path = [s[1:3] for s in steps]
        assert path[0] == (1, 1) and path[-1] == (size - 2, size - 2) and [s[0] for s in steps] == list(range(len(steps)))
        total = sum((x[a] + x[b]) / 2 * math.dist(a, b) for a, b in zip(path, path[1:], strict=False))
        want = routing.search(x, (1, 1), (size - 2, size - 2))[1]
        assert abs(total - want) < 1e-6 and abs(steps[0][3] - want) < 1e-6
    assert {(r.preset, r.illegal_steps) for r in routing.illegal_steps(got, cells).collect()} == {("open", 0), ("blocked", 0)}
    wall = spark.createDataFrame([("p", 0, 0, 1.0), ("p", 0, 1, INF), ("p", 0, 2, 1.0)], cells.schema)
    with pytest.raises(routing.NoRoute):
        routing.tile_routes(wall, (0, 0), (0, 2), 2)


def test_illegal_steps_are_counted(spark):
    cells = spark.createDataFrame([("p", i, j, INF if (i, j) == (0, 1) else 1.0) for i in range(4) for j in range(4)], "preset string, row int, col int, cost double")
    routes = spark.createDataFrame([("p", k, *c) for k, c in enumerate([(0, 0), (1, 1), (1, 2), (3, 2), (3, 3), (3, 3), (4, 3)])], "preset string, step int, row int, col int")
    # past a blocked corner, a jump, on the spot, and off the grid
    assert [r.illegal_steps for r in routing.illegal_steps(routes, cells).collect()] == [4]


def test_no_start(spark):
    use_checkpoints(spark)
    cells = spark.createDataFrame([(0, 0, INF), (0, 1, 1.0)], "row int, col int, cost double")
    assert routing.tile_distances(cells, (0, 0), 4).count() == 0


def test_layers_combine(spark):
    names = ["length", "terrain"]
    layers = spark.createDataFrame([("length", i, j, 1.0) for i in (0, 1) for j in (0, 1)] + [("terrain", i, j, float(i != j)) for i in (0, 1) for j in (0, 1)], "component string, row int, col int, value double")
    presets = spark.createDataFrame([("p", 0.75, 0.25)], "preset string, w_length double, w_terrain double")
    out = spark.createDataFrame([(0, 1)], "row int, col int")
    got = {(x.row, x.col): x.cost for x in cost.combine(cost.wide(layers, names), presets, out, names).collect()}
    assert got == {(0, 0): 0.75, (0, 1): INF, (1, 0): 1.0, (1, 1): 0.75}
    assert cost.shape_violations(layers).count() == 0
    assert {x.component for x in cost.shape_violations(layers.union(spark.createDataFrame([("terrain", 0, 2, 1.0)], layers.schema))).collect()} == {"terrain"}
