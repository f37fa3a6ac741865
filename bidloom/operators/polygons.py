"""Outlines of pages: simplification of closed polygons, their areas, and the test for a quadrilateral, as folds over point arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance as a share of the perimeter, and the least share of the image that a page covers.
TOLERANCE, LEAST_AREA = 0.02, 0.20


def _at(points: Column, i: Column) -> Column:
    return F.get(points, F.pmod(i, F.size(points)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2.0) + F.pow(a["y"] - b["y"], 2.0))


def perimeter(points: Column) -> Column:
    each = F.transform(points, lambda p, i: distance(p, _at(points, i + 1)))
    return F.aggregate(each, F.lit(0.0), lambda s, d: s + d)


def area(points: Column) -> Column:
    """By the shoelace formula, without sign."""
    each = F.transform(points, lambda p, i: p["x"] * _at(points, i + 1)["y"] - _at(points, i + 1)["x"] * p["y"])
    return F.abs(F.aggregate(each, F.lit(0.0), lambda s, c: s + c)) / 2


def off_line(p: Column, a: Column, b: Column) -> Column:
    """Distance of p from the line through a and b, from a where both are one."""
    length = distance(a, b)
    cross = F.abs((b["x"] - a["x"]) * (a["y"] - p["y"]) - (a["x"] - p["x"]) * (b["y"] - a["y"]))
    return F.when(length == 0, distance(p, a)).otherwise(cross / length)


def _farthest(points: Column, of: Column) -> Column:
    """Number of the point farthest from one, the first of several."""
    return F.array_max(F.transform(points, lambda p, i: F.struct(distance(p, of).alias("d"), F.negative(i).alias("i"))))["i"] * -1


def simplified(points: Column, tolerance: Column, rounds: int = 8) -> Column:
    """Numbers of the vertices that stay, ascending (Douglas and Peucker, closed): beginning with two points far apart, in each round
    every stretch between kept vertices keeps its point farthest off the line through its ends, if that is over the tolerance.

    A round at least doubles what may be kept, so ``rounds`` suit outlines of up to ``2 ** (rounds + 1)`` vertices; of a stretch that
    is not settled by then, the vertices kept so far stay.
    """
    first = _farthest(points, F.get(points, F.lit(0)))
    second = _farthest(points, F.get(points, first))
    start = F.array_sort(F.array_distinct(F.array(first.cast("int"), second.cast("int"))))

    def round_(kept: Column, _: Column) -> Column:
        def split(k: Column, i: Column) -> Column:
            to = F.coalesce(F.get(kept, i + 1), F.get(kept, F.lit(0)) + F.size(points))
            inside = F.when(to - k > 1, F.sequence(k + 1, to - 1)).otherwise(F.array().cast("array<int>"))
            off = F.transform(inside, lambda j: F.struct(off_line(_at(points, j), _at(points, k), _at(points, to)).alias("d"), F.negative(j).alias("j")))
            top = F.array_max(off)
            return F.when(top["d"] > tolerance, F.array(F.pmod(F.negative(top["j"]), F.size(points)))).otherwise(F.array().cast("array<int>"))

        return F.array_sort(F.concat(kept, F.flatten(F.transform(kept, split))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, round_)


def quadrilateral(points: Column, image_area: Column) -> Column:
    """Whether the outline has four vertices at the tolerance and covers more than a fifth of the image."""
    kept = simplified(points, perimeter(points) * TOLERANCE)
    return (F.size(kept) == 4) & (area(F.transform(kept, lambda i: F.get(points, i))) > image_area * LEAST_AREA)
