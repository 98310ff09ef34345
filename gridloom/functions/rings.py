"""Geometry predicates over vertex arrays.

A ring is ``ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>`` with the first vertex repeated
at the end.  Point tests run on the edge list so that it is built once per polygon
and then reused by every candidate pixel; holes and multi-polygons are the edges of
all rings together, which the even-odd rule handles.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring_of(*points: tuple[Column, Column]) -> Column:
    """Closed ring through the given corners."""
    corners = [vertex(x, y) for x, y in points]
    return F.array(*corners, corners[0])


def edges(ring: Column) -> Column:
    """Consecutive vertex pairs of one ring."""
    n = F.size(ring) - 1
    return F.zip_with(
        F.slice(ring, F.lit(1), n),
        F.slice(ring, F.lit(2), n),
        lambda a, b: F.struct(
            a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")
        ),
    )


def edges_of_rings(rings: Column) -> Column:
    """Edges of an outer ring and its holes, or of several polygons."""
    return F.flatten(F.transform(rings, edges))


def bounds(ring: Column) -> dict[str, Column]:
    xs, ys = ring["x"], ring["y"]  # a field of an array of structs is the array of that field
    return {
        "minx": F.array_min(xs),
        "miny": F.array_min(ys),
        "maxx": F.array_max(xs),
        "maxy": F.array_max(ys),
    }


def _twice_signed_area(edge_list: Column) -> Column:
    return F.aggregate(
        edge_list,
        F.lit(0.0),
        lambda acc, e: acc + (e["ax"] * e["by"] - e["bx"] * e["ay"]),
    )


def area(ring: Column) -> Column:
    return F.abs(_twice_signed_area(edges(ring))) / 2


def area_of_parts(parts: Column) -> Column:
    """Area of polygons with holes: each part is an outer ring followed by its holes."""
    def part(rings: Column) -> Column:
        holes = F.aggregate(
            F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0),
            lambda acc, ring: acc + area(ring),
        )
        return area(F.get(rings, F.lit(0))) - holes

    return F.aggregate(parts, F.lit(0.0), lambda acc, rings: acc + part(rings))


def centroid(ring: Column) -> Column:
    """Area-weighted centroid ``STRUCT<x, y>``; the vertex mean where the area is zero."""
    es = edges(ring)
    a2 = _twice_signed_area(es)

    def moment(axis: str) -> Column:
        return F.aggregate(
            es,
            F.lit(0.0),
            lambda acc, e: acc
            + (e[f"a{axis}"] + e[f"b{axis}"]) * (e["ax"] * e["by"] - e["bx"] * e["ay"]),
        )

    def mean(axis: str) -> Column:
        total = F.aggregate(es, F.lit(0.0), lambda acc, e: acc + e[f"a{axis}"])
        return F.try_divide(total, F.size(es))

    return F.struct(
        F.coalesce(F.try_divide(moment("x"), a2 * 3), mean("x")).alias("x"),
        F.coalesce(F.try_divide(moment("y"), a2 * 3), mean("y")).alias("y"),
    )


def contains_point(edge_list: Column, px: Column, py: Column) -> Column:
    """Half-open even-odd test: a shared edge belongs to exactly one of two neighbours.

    The crossing test multiplies out instead of dividing, so horizontal edges need no guard.
    """

    def crosses(e: Column) -> Column:
        lhs = (px - e["ax"]) * (e["by"] - e["ay"])
        rhs = (e["bx"] - e["ax"]) * (py - e["ay"])
        upward = e["by"] > e["ay"]
        return ((e["ay"] > py) != (e["by"] > py)) & F.when(upward, lhs < rhs).otherwise(lhs > rhs)

    return F.size(F.filter(edge_list, crosses)) % 2 == 1


def row_crossings(edge_list: Column, py: Column) -> Column:
    """Sorted x positions where a horizontal line crosses the polygon.

    A point is inside between the first and second crossing, the third and fourth, and so
    on, closed on the left and open on the right: the rule of :func:`contains_point`.  Each
    edge is evaluated from its lower end, so polygons sharing an edge agree on it exactly.
    """
    def position(e: Column) -> Column:
        upward = e["ax"] + (py - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])
        downward = e["bx"] + (py - e["by"]) * (e["ax"] - e["bx"]) / (e["ay"] - e["by"])
        return F.when(e["by"] > e["ay"], upward).otherwise(downward)

    spanning = F.filter(edge_list, lambda e: (e["ay"] > py) != (e["by"] > py))
    return F.sort_array(F.transform(spanning, position))


def boxes_touch(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed box overlap: boxes that only share a border count."""
    return (
        (a["minx"] <= b["maxx"])
        & (b["minx"] <= a["maxx"])
        & (a["miny"] <= b["maxy"])
        & (b["miny"] <= a["maxy"])
    )


def _edge_meets_box(e: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Closed segment-box intersection by separating axes: both coordinate axes and the edge normal."""
    cx, cy = (minx + maxx) / 2, (miny + maxy) / 2
    hx, hy = (maxx - minx) / 2, (maxy - miny) / 2
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    offset = dx * (cy - e["ay"]) - dy * (cx - e["ax"])
    return (
        (F.least(e["ax"], e["bx"]) <= maxx)
        & (F.greatest(e["ax"], e["bx"]) >= minx)
        & (F.least(e["ay"], e["by"]) <= maxy)
        & (F.greatest(e["ay"], e["by"]) >= miny)
        & (F.abs(offset) <= F.abs(dx) * hy + F.abs(dy) * hx)
    )


def _sequence(lo: Column, hi: Column, step: int = 1) -> Column:
    """``lo, lo + step, ...`` up to ``hi``; empty where ``hi`` is below ``lo``."""
    return F.when(lo <= hi, F.sequence(lo, hi, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )


def cells_in_band(
    edge_list: Column, left: Column, low: Column, high: Column, gx: float,
    first: Column, last: Column,
) -> Column:
    """Cells ``first .. last`` of one row of cells that a polygon meets, borders included.

    Cell ``c`` spans ``left + c * gx`` to ``left + (c + 1) * gx`` between ``low`` and ``high``.  Every
    edge names the few cells along its own way through the band and is tested on those alone.  A
    cell that no edge meets is inside as a whole or outside as a whole, so the crossings of the
    lower border give the rest as runs, without a test per cell.  ``edge_list`` holds edges that meet
    the row.
    """
    def passage(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        west, east = F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])

        def x_at(y: Column) -> Column:  # where the edge passes the border, within its own ends
            return F.greatest(F.least(e["ax"] + (y - e["ay"]) * dx / dy, east), west)

        down = x_at(F.greatest(F.least(e["ay"], e["by"]), low))
        up = x_at(F.least(F.greatest(e["ay"], e["by"]), high))
        return F.struct(  # a level edge passes no border
            e.alias("e"),
            F.when(dy != 0, down).otherwise(west).alias("p"),
            F.when(dy != 0, up).otherwise(east).alias("q"),
        )

    def along(way: Column) -> Column:
        # the hundredth of a cell is for rounding: the test below is exact
        lo = F.greatest(F.ceil((F.least(way["p"], way["q"]) - left) / gx - 1.01).cast("int"), first)
        hi = F.least(F.floor((F.greatest(way["p"], way["q"]) - left) / gx + 0.01).cast("int"), last)
        tested = F.filter(
            _sequence(lo, hi),
            lambda c: _edge_meets_box(way["e"], left + c * gx, low, left + (c + 1) * gx, high),
        )
        return F.when(lo == hi, F.array(lo)).otherwise(tested)

    ways = F.transform(edge_list, passage)
    crossings = row_crossings(edge_list, low)
    pairs = _sequence(F.lit(0), F.size(crossings) - 2, 2)

    def run(k: Column) -> Column:
        lo = F.ceil((F.get(crossings, k) - left) / gx).cast("int")
        hi = F.ceil((F.get(crossings, k + 1) - left) / gx).cast("int") - 1
        return _sequence(F.greatest(lo, first), F.least(hi, last))

    met = F.array_distinct(
        F.concat(F.flatten(F.transform(ways, along)), F.flatten(F.transform(pairs, run)))
    )
    # within one column of cells, whatever meets the row meets its cell
    return F.when(first == last, F.when(F.size(edge_list) > 0, F.array(first))).otherwise(met)


def box_overlap_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    width = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    height = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a lon/lat point, with the Norway and Svalbard exceptions."""
    plain = (F.floor((lon + 180) / 6) % 60 + 1).cast("int")
    svalbard = (lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42)
    zone = (
        F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), F.lit(32))
        .when(svalbard & (lon < 9), F.lit(31))
        .when(svalbard & (lon < 21), F.lit(33))
        .when(svalbard & (lon < 33), F.lit(35))
        .when(svalbard, F.lit(37))
        .otherwise(plain)
    )
    return F.concat(
        F.when(lat > 0, F.lit("EPSG:326")).otherwise(F.lit("EPSG:327")),
        F.lpad(zone.cast("string"), 2, "0"),
    )
