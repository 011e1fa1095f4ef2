"""Repair of areas whose rings cross themselves or each other, overlap, touch, or run back on themselves.

What an area covers is decided by even-odd over all its rings, and the repair keeps exactly that. Edges are cut
where they meet (grid buckets bring candidates together), edges that lie on each other an even number of times go,
and each edge that is left has the area on one side: it is directed so that this is its left. At every vertex an
edge goes on with the sharpest turn to the side of the area, which gives a table of half edges and their
successors; pointer doubling over that table finds the rings and the order in them. A ring that touches itself
is parted there. Rings that run counter-clockwise bound an area from outside, the others are holes.

All of it is joins and groupings over edges, so a ring may be as long as a table. Coordinates are whole multiples
of `precision`. An area without extent is reported, as is one whose edges still cross after `rounds` cuts.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import new_path
from .vector import bucketed

PRECISION = 1e-6
ENDS = ("x1", "y1", "x2", "y2")


def _kept(df: DataFrame, label: str) -> DataFrame:
    """The table, written and read again: it cuts the lineage, and numbers given to rows stay."""
    path = f"{new_path(df.sparkSession, label)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _snap(c: Column, precision: float) -> Column:
    """Signed zeros are one zero."""
    return F.round(c / precision) * precision + 0.0


def _cut_once(edges: DataFrame, size: float, precision: float) -> tuple[DataFrame, int]:
    """(edges cut where they meet another edge of their area elsewhere than at a common end, number of cuts)."""
    numbered = _kept(edges.withColumn("edge", F.monotonically_increasing_id()), "edges")
    b = bucketed(numbered, size)
    one = b.select("id", "bx", "by", F.col("edge").alias("ea"), *(F.col(c).alias(f"a{c}") for c in ENDS))
    other = b.select("id", "bx", "by", F.col("edge").alias("eb"), *(F.col(c).alias(f"b{c}") for c in ENDS))
    # edges that share buckets make a pair in the lowest of them alone, so that no pairs are shuffled to be made distinct
    low = lambda k: F.greatest(*(F.floor(F.least(f"{p}{k}1", f"{p}{k}2") / size).cast("int") for p in "ab"))
    pairs = one.join(other, ["id", "bx", "by"]).filter((F.col("ea") < F.col("eb")) & (F.col("bx") == low("x")) & (F.col("by") == low("y"))).drop("bx", "by")
    a, c = ([F.col(f"{p}{k}") for k in ENDS] for p in "ab")

    def off(seg: list[Column], x: Column, y: Column) -> Column:
        """Signed distance of a place from a segment's line; 0 within half the precision."""
        dx, dy = seg[2] - seg[0], seg[3] - seg[1]
        d = (dx * (y - seg[1]) - dy * (x - seg[0])) / F.hypot(dx, dy)
        return F.when(F.abs(d) <= precision / 2, 0.0).otherwise(d)

    def strictly_within(seg: list[Column], x: Column, y: Column) -> Column:
        """On the segment, and neither of its ends."""
        dx, dy = seg[2] - seg[0], seg[3] - seg[1]
        t = ((x - seg[0]) * dx + (y - seg[1]) * dy) / (dx * dx + dy * dy)
        end = ((x == seg[0]) & (y == seg[1])) | ((x == seg[2]) & (y == seg[3]))
        return (off(seg, x, y) == 0) & (t > 0) & (t < 1) & ~end

    d1, d2, d3, d4 = off(a, c[0], c[1]), off(a, c[2], c[3]), off(c, a[0], a[1]), off(c, a[2], a[3])
    t = F.try_divide(d3, d3 - d4)
    px, py = _snap(a[0] + t * (a[2] - a[0]), precision), _snap(a[1] + t * (a[3] - a[1]), precision)
    place = lambda edge, x, y: F.struct(edge.alias("edge"), x.alias("px"), y.alias("py"))
    cross = (d1 * d2 < 0) & (d3 * d4 < 0)
    found = F.array(
        *(F.when(strictly_within(a, c[i], c[i + 1]), place(F.col("ea"), c[i], c[i + 1])) for i in (0, 2)),
        *(F.when(strictly_within(c, a[i], a[i + 1]), place(F.col("eb"), a[i], a[i + 1])) for i in (0, 2)),
        *(F.when(cross, place(F.col(e), px, py)) for e in ("ea", "eb")))
    cuts = pairs.select(F.explode(F.filter(found, lambda p: p.isNotNull())).alias("p")).select("p.*").distinct()
    # a crossing that rounds to an end of an edge moves only the other one
    ends = cuts.join(numbered, "edge").filter(~(((F.col("px") == F.col("x1")) & (F.col("py") == F.col("y1"))) | ((F.col("px") == F.col("x2")) & (F.col("py") == F.col("y2")))))
    cuts = _kept(ends.select("edge", "px", "py"), "cuts")
    n = cuts.count()
    if not n:
        return numbered.drop("edge"), 0
    by_edge = cuts.groupBy("edge").agg(F.collect_set(F.struct("px", "py")).alias("cuts"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = lambda p: F.struct(((p["px"] - F.col("x1")) * dx + (p["py"] - F.col("y1")) * dy).alias("t"), p["px"].alias("x"), p["py"].alias("y"))
    first, last = (F.struct(*(F.col(f"{k}{i}").alias(f"p{k}") for k in "xy")) for i in (1, 2))
    chain = F.array_sort(F.transform(F.concat(F.array(first, last), "cuts"), along))
    pieces = F.transform(F.sequence(F.lit(0), F.size("chain") - 2), lambda i: F.struct(*(F.get("chain", i + k)[c].alias(f"{c}{k + 1}") for k in (0, 1) for c in "xy")))
    whole = numbered.join(by_edge, "edge", "left_anti").select("id", *ENDS)
    cut = numbered.join(by_edge, "edge").withColumn("chain", chain).select("id", F.explode(pieces).alias("s")).select("id", *(f"s.{c}" for c in ENDS))
    return whole.unionByName(cut).filter("x1 <> x2 or y1 <> y2"), n


def node(segments: DataFrame, size: float, precision: float = PRECISION, rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """(edges that meet only at their ends: id, x1, y1, x2, y2; ids whose edges do not come to rest).

    Rounding a crossing moves two edges by half the precision at most, which may make them meet others: they are cut again."""
    snapped = segments.select("id", *(_snap(F.col(c), precision).alias(c) for c in ENDS)).filter("x1 <> x2 or y1 <> y2")
    edges, left = snapped, 0
    for _ in range(rounds):
        edges, left = _cut_once(_single(edges), size, precision)
        if not left:
            return edges, edges.select("id").limit(0)
    after, left = _cut_once(_single(edges), size, precision)
    return after, after.select("id").distinct() if left else after.select("id").limit(0)


def _single(edges: DataFrame) -> DataFrame:
    """Edges that lie on each other an odd number of times, once each, from their smaller end to their larger one."""
    a, b = (F.struct(*(F.col(f"{k}{i}").alias(k) for k in "xy")) for i in (1, 2))
    return edges.select("id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).groupBy("id", "a", "b").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("id", *(F.col(f"{p}.{k}").alias(f"{k}{i}") for i, p in ((1, "a"), (2, "b")) for k in "xy"))


def _beyond(points: DataFrame, edges: DataFrame, size: float, axis: str) -> DataFrame:
    """key, parity of the edges of its area that a ray from each of points(key, id, own, x, y) along an axis meets; the edge `own` is left out."""
    along, across = ("x", "y") if axis == "x" else ("y", "x")
    band = lambda c: F.floor(c / size).cast("long")
    low, high = F.least(f"{across}1", f"{across}2"), F.greatest(f"{across}1", f"{across}2")
    spread = edges.withColumn("band", F.explode(F.sequence(band(low), band(high))))
    at = points.withColumn("band", band(F.col(across)))
    p, q = F.col(across), F.col(along)
    spans = (F.col(f"{across}1") <= p) != (F.col(f"{across}2") <= p)
    meets = F.col(f"{along}1") + F.try_divide(p - F.col(f"{across}1"), F.col(f"{across}2") - F.col(f"{across}1")) * (F.col(f"{along}2") - F.col(f"{along}1"))
    hits = at.join(spread.select("id", "band", F.col("edge").alias("of"), *ENDS), ["id", "band"]).filter(spans & (meets > q) & (F.col("of") != F.col("own")))
    return at.select("key").join(hits.groupBy("key").agg((F.count("*") % 2).alias("parity")), "key", "left").na.fill(0, ["parity"])


def directed(edges: DataFrame, size: float) -> DataFrame:
    """edge, id, x1, y1, x2, y2 with the area on the left: edges that meet only at their ends, each once."""
    numbered = _kept(edges.withColumn("edge", F.monotonically_increasing_id()), "single-edges")
    middle = numbered.select(F.col("edge").alias("key"), "id", F.col("edge").alias("own"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), (F.abs(F.col("y2") - F.col("y1")) >= F.abs(F.col("x2") - F.col("x1"))).alias("steep"))
    sides = _beyond(middle.filter("steep").drop("steep"), numbered, size, "x").withColumn("steep", F.lit(True)).unionByName(_beyond(middle.filter("not steep").drop("steep"), numbered, size, "y").withColumn("steep", F.lit(False)))
    # with an even number beyond, the area is on the near side of the edge: to the left of x or below y
    up = F.when(F.col("steep"), F.col("y2") > F.col("y1")).otherwise(F.col("x2") < F.col("x1"))
    keep = up == (F.col("parity") == 0)
    turned = lambda a, b: F.when(keep, F.col(a)).otherwise(F.col(b))
    return numbered.join(sides, numbered["edge"] == sides["key"]).select("edge", "id", turned("x1", "x2").alias("x1"), turned("y1", "y2").alias("y1"), turned("x2", "x1").alias("x2"), turned("y2", "y1").alias("y2"))


def successors(half_edges: DataFrame, within: str = "id", sharpest: bool = True) -> DataFrame:
    """edge, next: where each goes on at its end, among the edges of its area (or ring) that start there.

    With the sharpest turn to the side of the area, rings follow its faces; with the widest one among the edges of a
    ring, a ring that comes back to a vertex falls into rings that touch there."""
    out = half_edges.select(within, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("edge").alias("next"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("leaves"))
    back = F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2"))
    turn = back - F.col("leaves")
    turn = F.when(turn <= 1e-15, turn + 2 * math.pi).otherwise(turn)
    pick = F.min_by if sharpest else F.max_by
    return half_edges.join(out, [within, "x2", "y2"]).select("edge", "next", turn.alias("turn")).groupBy("edge").agg(pick("next", F.struct("turn", "next")).alias("next"))


def cycles(links: DataFrame) -> DataFrame:
    """edge, ring (its smallest edge), seq (steps from that edge) for links(edge, next) that make rings, by pointer doubling."""
    state = _kept(links.select("edge", F.col("next").alias("jump"), F.least("edge", "next").alias("ring")), "ring-labels")
    while True:
        far = state.select(F.col("edge").alias("jump"), F.col("jump").alias("far"), F.col("ring").alias("seen"))
        state = _kept(state.join(far, "jump").select("edge", F.col("far").alias("jump"), F.least("ring", "seen").alias("ring"), (F.col("seen") < F.col("ring")).alias("moved")), "ring-labels")
        if state.filter("moved").isEmpty():
            break
        state = state.drop("moved")
    rings = state.select("edge", "ring")
    start = F.col("edge") == F.col("ring")
    walk = _kept(links.join(rings, "edge").select("edge", "ring", F.when(start, F.col("edge")).otherwise(F.col("next")).alias("jump"), F.when(start, 0).otherwise(1).cast("long").alias("steps")), "ring-steps")
    while not walk.filter("jump <> ring").isEmpty():
        far = walk.select(F.col("edge").alias("jump"), F.col("jump").alias("far"), F.col("steps").alias("more"))
        walk = _kept(walk.join(far, "jump").select("edge", "ring", F.col("far").alias("jump"), (F.col("steps") + F.col("more")).alias("steps")), "ring-steps")
    sizes = walk.groupBy("ring").agg(F.count("*").alias("n"))
    return walk.join(sizes, "ring").select("edge", "ring", ((F.col("n") - F.col("steps")) % F.col("n")).alias("seq"))


def repair(segments: DataFrame, size: float, precision: float = PRECISION) -> tuple[DataFrame, DataFrame]:
    """(id, part, ring, hole, seq, x1, y1, x2, y2 of valid rings; id, problem of areas that cannot be repaired).

    segments: id, x1, y1, x2, y2 of all rings of the areas, closed. part is the outer ring that a ring belongs to, itself
    included; seq orders a ring's edges; size is that of the grid buckets."""
    edges, restless = node(segments, size, precision)
    half = _kept(directed(_single(edges), size), "half-edges")
    rings = _kept(half.join(cycles(successors(half)), "edge"), "rings")
    if not rings.groupBy("ring", "x1", "y1").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        rings = _kept(half.join(cycles(successors(rings, "ring", sharpest=False)), "edge"), "rings")
    double = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    # a ring's own corner is taken off first, so that large coordinates lose no digits
    corner = rings.groupBy("ring").agg(F.min("x1").alias("cx"), F.min("y1").alias("cy"))
    local = rings.join(corner, "ring").select("id", "ring", "edge", *((F.col(c) - F.col(f"c{c[0]}")).alias(c) for c in ENDS))
    areas = _kept(local.groupBy("id", "ring").agg((double / 2).alias("area")), "ring-areas")
    outer = areas.filter("area > 0").select(F.col("ring"), F.col("area").alias("size"))
    holes = rings.join(areas.filter("area <= 0").select("ring"), "ring", "left_semi").filter("edge = ring")
    # the middle of a hole's edge lies inside the outer rings around it; the smallest is its own
    middle = holes.select("id", F.col("ring").alias("hole"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    band = lambda c: F.floor(c / size).cast("long")
    walls = rings.join(outer, "ring").withColumn("band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2"))))).select("id", "band", "ring", "size", *ENDS)
    p = F.col("y")
    meets = F.col("x1") + F.try_divide(p - F.col("y1"), F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    around = middle.withColumn("band", band(p)).join(walls, ["id", "band"]).filter(((F.col("y1") <= p) != (F.col("y2") <= p)) & (meets > F.col("x"))).groupBy("hole", "ring").agg(F.count("*").alias("n"), F.first("size").alias("size")).filter("n % 2 = 1")
    owner = around.groupBy("hole").agg(F.min_by("ring", F.struct("size", "ring")).alias("part")).select(F.col("hole").alias("ring"), "part")
    out = rings.join(areas.select("ring", "area"), "ring").join(owner, "ring", "left")
    out = out.select("id", F.coalesce("part", "ring").alias("part"), "ring", (F.col("area") <= 0).alias("hole"), "seq", *ENDS)
    empty = segments.select("id").distinct().join(areas.filter("area > 0").select("id"), "id", "left_anti").select("id", F.lit("empty").alias("problem"))
    return out, empty.unionByName(restless.select("id", F.lit("still crossing").alias("problem")))


def repaired(segments: DataFrame, size: float, precision: float = PRECISION) -> DataFrame:
    """repair()'s rings; an area that cannot be repaired is an error."""
    out, problems = repair(segments, size, precision)
    bad = problems.limit(1).collect()
    if bad:
        raise ValueError(f"area {bad[0].id} cannot be repaired: {bad[0].problem}")
    return out


def ring_totals(rings: DataFrame) -> DataFrame:
    """id, parts, holes, area, length of repaired rings."""
    edge = (F.col("x1") - F.col("cx")) * (F.col("y2") - F.col("cy")) - (F.col("x2") - F.col("cx")) * (F.col("y1") - F.col("cy"))
    corner = rings.groupBy("id").agg(F.min("x1").alias("cx"), F.min("y1").alias("cy"))
    return rings.join(corner, "id").groupBy("id").agg(F.count_distinct("part").alias("parts"), F.count_distinct(F.when(F.col("hole"), F.col("ring"))).alias("holes"), (F.sum(edge) / 2).alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"))
