"""Least-cost routes over a grid with eight neighbours.

``route_groups`` runs the exact search for every group (preset) in parallel; ``tile_distances`` and ``tile_routes``
give the same distances and costs tile by tile, for grids beyond one task.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import new_path

#: Row and column steps in the order in which neighbours are looked at (fixed values).
OFFSETS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
ALGORITHMS = ("astar", "dijkstra")


class NoRoute(ValueError):
    """Start or goal is blocked, or nothing joins them."""


def search(costs: np.ndarray, start: tuple[int, int], goal: tuple[int, int], algorithm: str = "astar") -> tuple[list[tuple[int, int]], float, int]:
    """(path, cost, settled cells). Infinite cells are blocked; a diagonal needs both its corners open.

    An edge costs the mean of its cells times its length. Equal costs are settled by the order in
    which they were found, so paths are the same on every run."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    costs = np.asarray(costs, float)
    if costs.ndim != 2 or not costs.size or np.isnan(costs).any() or (costs < 0).any():
        raise ValueError("costs must be a filled grid of numbers that are not negative")
    rows, cols = costs.shape
    for r, c in (start, goal):
        if not (0 <= r < rows and 0 <= c < cols):
            raise ValueError("cell outside the grid")
        if math.isinf(costs[r, c]):
            raise NoRoute("start or goal is blocked")
    if start == goal:
        return [start], 0.0, 1
    inf, width = math.inf, cols + 2
    padded = np.full((rows + 2, width), inf)
    padded[1:-1, 1:-1] = costs
    half = (padded / 2).ravel().tolist()  # halves add up to the mean without rounding
    moves = [(dr * width + dc, math.sqrt(2) if dr and dc else 1.0, dr * width, dc, bool(dr and dc) and not np.isfinite(costs).all()) for dr, dc in OFFSETS]
    source, target = ((r + 1) * width + c + 1 for r, c in (start, goal))
    least = float(costs[np.isfinite(costs)].min()) if algorithm == "astar" else 0.0
    if least:
        away = np.hypot(np.arange(rows + 2)[:, None] - goal[0] - 1, np.arange(width)[None, :] - goal[1] - 1) * least
        ahead = away.ravel().tolist()
    else:
        ahead = [0.0] * len(half)
    best = [inf] * len(half)
    came = [0] * len(half)
    done = bytearray(len(half))
    best[source] = 0.0
    queue, found, settled = [(ahead[source], 0.0, 0, source)], 0, 0
    push, pop = heapq.heappush, heapq.heappop
    while queue:
        _, g, _, at = pop(queue)
        if done[at]:
            continue
        done[at] = 1
        settled += 1
        if at == target:
            path = [at]
            while at != source:
                at = came[at]
                path.append(at)
            return [(p // width - 1, p % width - 1) for p in reversed(path)], g, settled
        here = half[at]
        for step, length, side, other, corners in moves:
            to = at + step
            new = g + (here + half[to]) * length  # infinite for blocked cells
            if new < best[to] and not done[to] and not (corners and (half[at + side] == inf or half[at + other] == inf)):
                best[to] = new
                came[to] = at
                found += 1
                push(queue, (new + ahead[to], new, found, to))
    raise NoRoute("nothing joins start and goal")


def _grid_of(cells: pd.DataFrame) -> np.ndarray:
    grid = np.full((int(cells["row"].max()) + 1, int(cells["col"].max()) + 1), np.inf)
    grid[cells["row"], cells["col"]] = cells["cost"]
    return grid


def route_groups(cells: DataFrame, start: tuple[int, int], goal: tuple[int, int], algorithm: str = "astar", key: str = "preset") -> DataFrame:
    """key, step, row, col, route_cost, explored of each group's route over cells(key, row, col, cost).

    A missing or infinite cell is blocked. One group is one grid, which a task holds whole."""

    def one(names: tuple, group: pd.DataFrame) -> pd.DataFrame:
        path, total, settled = search(_grid_of(group), start, goal, algorithm)
        return pd.DataFrame({key: names[0], "step": range(len(path)), "row": [r for r, _ in path], "col": [c for _, c in path], "route_cost": total, "explored": settled}).astype({"step": "int32", "row": "int32", "col": "int32", "explored": "int64"})

    kind = cells.schema[key].dataType.simpleString()
    return cells.select(key, "row", "col", "cost").groupBy(key).applyInPandas(one, f"{key} {kind}, step int, row int, col int, route_cost double, explored long")


def edges_8n(cells: DataFrame) -> DataFrame:
    """row, col, to_row, to_col, weight of every allowed move over cells(row, col, cost): equi-joins on shifted keys."""
    spark = cells.sparkSession
    steps = spark.createDataFrame([(dr, dc, math.sqrt(2) if dr and dc else 1.0) for dr, dc in OFFSETS], "dr int, dc int, length double")
    free = cells.filter(F.col("cost").isNotNull() & (F.col("cost") < float("inf"))).select("row", "col", "cost")
    # eight rows at most on the one side, whatever the grid
    moves = free.crossJoin(F.broadcast(steps)).withColumns({"to_row": F.col("row") + F.col("dr"), "to_col": F.col("col") + F.col("dc")})
    ends = free.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("cost").alias("to_cost"))
    near = moves.join(ends, ["to_row", "to_col"])
    straight, diagonal = near.filter("dr = 0 or dc = 0"), near.filter("dr <> 0 and dc <> 0")
    open_cells = lambda r, c: free.select(F.col("row").alias(r), F.col("col").alias(c))
    diagonal = diagonal.join(open_cells("row", "to_col"), ["row", "to_col"], "left_semi").join(open_cells("to_row", "col"), ["to_row", "col"], "left_semi")
    return straight.unionByName(diagonal).select("row", "col", "to_row", "to_col", ((F.col("cost") + F.col("to_cost")) / 2 * F.col("length")).alias("weight"))


def illegal_steps(routes: DataFrame, cells: DataFrame, key: str = "preset") -> DataFrame:
    """key, illegal_steps of routes(key, step, row, col) over cells(key, row, col, cost): cells that are blocked, steps to
    no neighbour, and diagonal steps past a blocked corner."""
    free = cells.filter(F.col("cost").isNotNull() & (F.col("cost") < float("inf"))).select(key, "row", "col", F.lit(True).alias("open"))
    w = Window.partitionBy(key).orderBy("step")
    x = routes.select(key, "step", "row", "col", F.lag("row").over(w).alias("r"), F.lag("col").over(w).alias("c"))
    here = x.join(free, [key, "row", "col"], "left").withColumnRenamed("open", "free")
    corner = lambda name, r, c: free.select(key, F.col("row").alias(r), F.col("col").alias(c), F.col("open").alias(name))
    both = here.join(corner("past", "row", "c"), [key, "row", "c"], "left").join(corner("over", "r", "col"), [key, "r", "col"], "left")
    dr, dc = F.abs(F.col("row") - F.col("r")), F.abs(F.col("col") - F.col("c"))
    ok = F.col("free").isNotNull() & (F.col("r").isNull() | ((F.greatest(dr, dc) == 1) & ((dr + dc == 1) | (F.col("past").isNotNull() & F.col("over").isNotNull()))))
    return both.groupBy(key).agg(F.count_if(~ok).cast("int").alias("illegal_steps"))


def _relax(cost: np.ndarray, dist: np.ndarray, seeds: list[int]) -> set[int]:
    """Lower dist from the seeds on, in place; both are flat with one blocked cell around. Returns what fell."""
    width = int(math.isqrt(len(cost)))
    c, d = cost.tolist(), dist.tolist()
    moves = [(dr * width + dc, math.sqrt(2) if dr and dc else 1.0, dr * width if dr and dc else 0, dc if dr and dc else 0) for dr, dc in OFFSETS]
    queue = [(d[s], s) for s in seeds]
    heapq.heapify(queue)
    fell, inf = set(seeds), math.inf
    while queue:
        g, at = heapq.heappop(queue)
        if g > d[at]:
            continue
        for step, length, side, other in moves:
            to = at + step
            if c[to] == inf or (side and (c[at + side] == inf or c[at + other] == inf)):
                continue
            new = g + (c[at] + c[to]) / 2 * length
            if new < d[to]:
                d[to] = new
                fell.add(to)
                heapq.heappush(queue, (new, to))
    dist[:] = d
    return fell


_AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
#: Rounds after which the states that rounds left are written together.
COMPACT = 8


def _tiles_near(row, col, tile: int):
    """The tiles that hold a cell or touch it."""
    return F.array_distinct(F.array(*(F.struct(F.floor((row + a) / tile).cast("int").alias("tr"), F.floor((col + b) / tile).cast("int").alias("tc")) for a, b in _AROUND)))


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tiles:
    """A grid cut into tiles for each key, with the least costs from a start.

    A tile's costs, with the cells around it, are written once. A round takes the tiles that got news, lowers the
    distances inside them, all at once, and sends what fell at their borders to the neighbours; it writes the distances of
    these tiles alone. Rounds grow with the tiles along a route, not with its cells, and go on until nothing falls. A task
    holds one tile."""

    def __init__(self, cells: DataFrame, start: tuple[int, int], tile: int, key: str = "preset"):
        self.tile, self.wide, self.key = tile, tile + 4, key  # the tile, the cells around, and one blocked cell around these
        self.by = [key, "tr", "tc"]
        self.kind = cells.schema[key].dataType.simpleString()
        self.spark = cells.sparkSession
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))  # tiles are long rows; the same bound for all stages
        free = cells.filter(F.col("cost").isNotNull() & (F.col("cost") < float("inf"))).select(key, "row", "col", F.col("cost").cast("double").alias("cost"))
        self.costs = _kept(self._packed(free), "tile-costs")
        self.states: list[DataFrame] = []
        self._settle(free.filter((F.col("row") == start[0]) & (F.col("col") == start[1])).select(key, F.lit(start[0] // tile).alias("tr"), F.lit(start[1] // tile).alias("tc"), "row", "col", F.lit(0.0).alias("d")))

    def _packed(self, free: DataFrame) -> DataFrame:
        """key, tr, tc, cost: the costs of a tile and around it as one binary value."""
        tile, wide, by = self.tile, self.wide, self.by
        place = (F.col("row") - F.col("tr") * tile + 2) * wide + F.col("col") - F.col("tc") * tile + 2
        spread = free.withColumn("t", F.explode(_tiles_near(F.col("row"), F.col("col"), tile))).select(self.key, "t.*", "row", "col", "cost").select(*by, place.cast("int").alias("at"), "cost")

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            grid = np.full(wide * wide, np.inf)
            grid[rows.column("at").to_numpy()] = rows.column("cost").to_numpy()
            return pa.table({**{c: rows.column(c)[:1] for c in by}, "cost": pa.array([grid.tobytes()], pa.binary())})

        return spread.groupBy(*by).applyInArrow(lambda key, rows: pack(key, rows), f"{self.key} {self.kind}, tr int, tc int, cost binary")

    def distances(self) -> DataFrame:
        """key, tr, tc, dist: the latest distances of the tiles that were reached."""
        every = self.states[0]
        for more in self.states[1:]:
            every = every.unionByName(more)
        return every.groupBy(*self.by).agg(F.max_by("dist", "round").alias("dist"))

    def _settle(self, news: DataFrame) -> None:
        tile, wide, by = self.tile, self.wide, self.by
        schema = f"{self.key} {self.kind}, tr int, tc int, dist binary, border array<struct<row:int,col:int,d:double>>"
        border = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("d", pa.float64())]))

        def solve(batches):
            for batch in batches:
                dists, borders = [], []
                for tr, tc, cost, dist, got in zip(*(batch.column(c).to_pylist() for c in ("tr", "tc", "cost", "dist", "news")), strict=True):
                    now = np.full(wide * wide, np.inf) if dist is None else np.frombuffer(dist).copy()
                    seeds = []
                    for k in got:
                        at = (k["row"] - tr * tile + 2) * wide + k["col"] - tc * tile + 2
                        if k["d"] < now[at]:
                            now[at] = k["d"]
                            seeds.append(at)
                    edge = []
                    for at in _relax(np.frombuffer(cost), now, seeds):
                        r, c = divmod(at, wide)
                        if 2 <= r < wide - 2 and 2 <= c < wide - 2 and (r in (2, wide - 3) or c in (2, wide - 3)):
                            edge.append({"row": tr * tile + r - 2, "col": tc * tile + c - 2, "d": float(now[at])})
                    dists.append(now.tobytes())
                    borders.append(edge)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(dists, pa.binary()), pa.array(borders, border)], [*by, "dist", "border"])

        turn = 0
        while True:
            sent = news.groupBy(*by).agg(F.collect_list(F.struct("row", "col", "d")).alias("news"))
            touched = sent.join(self.costs, by)
            touched = touched.join(self.distances(), by, "left") if self.states else touched.withColumn("dist", F.lit(None).cast("binary"))
            made = _kept(touched.select(*by, "cost", "dist", "news").mapInArrow(solve, schema).withColumn("round", F.lit(turn)), "tile-distances")
            self.states.append(made.select(*by, "round", "dist"))
            news = (made.select(self.key, F.col("tr").alias("fr"), F.col("tc").alias("fc"), F.explode("border").alias("k")).select(self.key, "fr", "fc", "k.*")
                .withColumn("t", F.explode(_tiles_near(F.col("row"), F.col("col"), tile))).select(self.key, "t.*", "row", "col", "d", "fr", "fc").filter("tr <> fr or tc <> fc").drop("fr", "fc"))
            if news.isEmpty():
                return
            if len(self.states) > COMPACT:
                self.states = [_kept(self.distances().withColumn("round", F.lit(turn)), "tile-distances")]
            turn += 1

    def cells(self) -> DataFrame:
        """key, row, col, distance of every cell that can be reached."""
        tile, wide, by = self.tile, self.wide, self.by

        def opened(batches):
            for batch in batches:
                for i, (tr, tc, dist) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tr", "tc", "dist")), strict=True)):
                    grid = np.frombuffer(dist).reshape(wide, wide)[2:-2, 2:-2]
                    r, c = np.nonzero(np.isfinite(grid))
                    yield pa.RecordBatch.from_arrays([batch.column(self_key).take(pa.array(np.full(len(r), i))), pa.array((r + tr * tile).astype(np.int32)), pa.array((c + tc * tile).astype(np.int32)), pa.array(grid[r, c])], [self_key, "row", "col", "distance"])

        self_key = self.key
        return self.distances().select(*by, "dist").mapInArrow(opened, f"{self.key} {self.kind}, row int, col int, distance double")

    def routes(self, goal: tuple[int, int]) -> DataFrame:
        """key, step, row, col, route_cost of the route of each key from the start to a goal that all can reach.

        The route is followed back from the goal, a tile a round, for all keys at once; only tiles on it are read."""
        tile, wide, by, key = self.tile, self.wide, self.by, self.key
        known = _kept(self.distances(), "tile-distances")
        at = known.filter((F.col("tr") == goal[0] // tile) & (F.col("tc") == goal[1] // tile)).select(*by, F.lit(goal[0]).alias("row"), F.lit(goal[1]).alias("col"))
        wanted = self.costs.select(key).distinct().count()
        schema = f"{key} {self.kind}, row int, col int, d double, next_row int, next_col int"

        def follow(batches):
            for batch in batches:
                out = [[] for _ in range(6)]
                for name, tr, tc, row, col, cost, dist in zip(*(batch.column(c).to_pylist() for c in (*by, "row", "col", "cost", "dist")), strict=True):
                    c, d = np.frombuffer(cost), np.frombuffer(dist)
                    place = (row - tr * tile + 2) * wide + col - tc * tile + 2
                    for here in _followed(c, d, place, wide):
                        r, k = divmod(here, wide)
                        last = not (2 <= r < wide - 2 and 2 <= k < wide - 2)
                        values = (name, tr * tile + r - 2, tc * tile + k - 2, float(d[here]))
                        if last:  # the next tile goes on from here
                            out[4][-1], out[5][-1] = values[1], values[2]
                            break
                        for column, value in zip(out, (*values, None, None), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(key).type), *(pa.array(x, t) for x, t in zip(out[1:], (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()), strict=True))], [key, "row", "col", "d", "next_row", "next_col"])

        parts = []
        while True:
            made = _kept(at.join(known, by).join(self.costs, by).select(*by, "row", "col", "cost", "dist").mapInArrow(follow, schema), "tile-routes")
            if not parts and made.filter((F.col("row") == goal[0]) & (F.col("col") == goal[1]) & (F.col("d") < float("inf"))).count() < wanted:
                raise NoRoute("nothing joins start and goal")
            parts.append(made.select(key, "row", "col", "d"))
            ahead = made.filter("next_row is not null").select(key, F.floor(F.col("next_row") / tile).cast("int").alias("tr"), F.floor(F.col("next_col") / tile).cast("int").alias("tc"), F.col("next_row").alias("row"), F.col("next_col").alias("col"))
            if ahead.isEmpty():
                break
            at = ahead
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        w = Window.partitionBy(key)
        return every.select(key, (F.row_number().over(w.orderBy("d")) - 1).alias("step"), "row", "col", F.max("d").over(w).alias("route_cost"))


def _followed(cost: np.ndarray, dist: np.ndarray, at: int, wide: int):
    """Places from one back to the start or to the first one outside the tile: the neighbour over which the distance came."""
    inf = math.inf
    moves = [(dr * wide + dc, math.sqrt(2) if dr and dc else 1.0, dr * wide if dr and dc else 0, dc if dr and dc else 0) for dr, dc in OFFSETS]
    yield at
    while dist[at] > 0 and math.isfinite(dist[at]):
        best, found = inf, -1
        for step, length, side, other in moves:
            to = at + step
            if cost[to] == inf or (side and (cost[at + side] == inf or cost[at + other] == inf)):
                continue
            by = dist[to] + (cost[at] + cost[to]) / 2 * length
            if dist[to] < dist[at] and by < best:
                best, found = by, to
        if found < 0 or best > dist[at] * (1 + 1e-9) + 1e-12:
            raise ValueError("a distance has no neighbour that it came from: costs must be above 0")
        at = found
        yield at
        r, c = divmod(at, wide)
        if not (2 <= r < wide - 2 and 2 <= c < wide - 2):
            return


def tile_distances(cells: DataFrame, start: tuple[int, int], tile: int = 256) -> DataFrame:
    """row, col, distance from start to each cell of cells(row, col, cost) that can be reached, tile by tile."""
    one = cells.select(F.lit(0).alias("preset"), "row", "col", "cost")
    return Tiles(one, start, tile).cells().drop("preset")


def tile_routes(cells: DataFrame, start: tuple[int, int], goal: tuple[int, int], tile: int = 256, key: str = "preset") -> DataFrame:
    """key, step, row, col, route_cost of each key's least-cost route over cells(key, row, col, cost), for grids beyond one task.

    Costs are above 0; the routes cost what `search` finds, and may differ from its cells where costs tie."""
    return Tiles(cells, start, tile, key).routes(goal)
