"""The projections in SQL by another route than `functions.geo`: for the checks of its results.

Constants come from the ellipsoid inside the SQL, latitudes go through the isometric latitude, and the
inverse solves for the latitude by repeated substitution.
"""

from __future__ import annotations

_E = "sqrt((2 - 1 / 298.257222101) / 298.257222101)"


def _isometric(radians: str) -> str:
    return f"(ln(tan(pi() / 4 + ({radians}) / 2)) + {_E} / 2 * ln((1 - {_E} * sin({radians})) / (1 + {_E} * sin({radians}))))"


# Kruger's coefficients of GRS80, rounded to their last useful digit (fixed values of the ellipsoid)
_ALPHA = (8.377318247344e-4, 7.608527788826e-7, 1.197638020e-9, 2.4433762e-12)
_BETA = (8.377321681641e-4, 5.905869626e-8, 1.6734889e-10, 2.16737e-13)
_RADIUS = 6367449.145771052 * 0.9996


def transverse_mercator(table: str) -> str:
    """CTEs tm_angles and tm(id, x, y) of table(id, lon, lat), zone 56 south."""
    x = " + ".join([f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1)])
    y = " + ".join([f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1)])
    return f"""tm_chi AS (SELECT id, radians(lon - 153) AS lam, 2 * atan(exp({_isometric('radians(lat)')})) - pi() / 2 AS chi FROM {table}),
tm_angles AS (SELECT id, atan(tan(chi) / cos(lam)) AS xi, atanh(cos(chi) * sin(lam)) AS eta FROM tm_chi),
tm AS (SELECT id, 500000 + {_RADIUS!r} * (eta + {x}) AS x, 10000000 + {_RADIUS!r} * (xi + {y}) AS y FROM tm_angles)"""


def lambert_conic(table: str) -> str:
    """CTEs up to lcc(id, x, y) of table(id, lon, lat), the state-wide grid of the study area."""
    m = lambda lat: f"(cos(radians({lat})) / sqrt(1 - power({_E} * sin(radians({lat})), 2)))"
    q = lambda lat: _isometric(f"radians({lat})")
    return f"""lcc_n AS (SELECT (ln({m(-30.75)}) - ln({m(-35.75)})) / ({q(-35.75)} - {q(-30.75)}) AS n),
lcc_k AS (SELECT n, 6378137.0 * {m(-30.75)} / n * exp(n * {q(-30.75)}) AS k FROM lcc_n),
lcc AS (SELECT id, 9300000 + k * exp(-n * {q('lat')}) * sin(n * radians(lon - 147)) AS x, 4500000 + k * (exp(-n * {q(-33.25)}) - exp(-n * {q('lat')}) * cos(n * radians(lon - 147))) AS y FROM {table}, lcc_k)"""


def inverse_transverse_mercator(table: str) -> str:
    """CTEs up to lonlat(*, lon, lat) of table(*, x, y)."""
    xi = " + ".join([f"{b!r} * sin({2 * j} * a) * cosh({2 * j} * b)" for j, b in enumerate(_BETA, 1)])
    eta = " + ".join([f"{b!r} * cos({2 * j} * a) * sinh({2 * j} * b)" for j, b in enumerate(_BETA, 1)])
    steps = "asin(sin(p) / cosh(q))"
    phi = steps
    for _ in range(5):
        phi = f"asin(tanh(atanh(sin(p) / cosh(q)) + {_E} * atanh({_E} * sin({phi}))))"
    return f"""inv_a AS (SELECT *, (y - 10000000) / {_RADIUS!r} AS a, (x - 500000) / {_RADIUS!r} AS b FROM {table}),
inv_b AS (SELECT *, a - ({xi}) AS p, b - ({eta}) AS q FROM inv_a),
lonlat AS (SELECT *, 153 + degrees(atan(sinh(q) / cos(p))) AS lon, degrees({phi}) AS lat FROM inv_b)"""
