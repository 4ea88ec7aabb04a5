"""Reductions over arrays that hold one track, kept inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wakeline.functions.geo import haversine_km


def total(arr: Column, of=lambda x: x) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + of(x).cast("double"))


def mean(arr: Column, of=lambda x: x) -> Column:
    return total(arr, of) / F.size(arr)


def std_pop(arr: Column, of=lambda x: x) -> Column:
    """Population standard deviation in two passes, as stable as a column aggregate."""
    centre = mean(arr, of)
    spread = F.aggregate(
        arr,
        F.struct(F.lit(0.0).alias("s"), centre.alias("m")),
        lambda acc, x: F.struct(
            (acc.s + (of(x).cast("double") - acc.m) * (of(x).cast("double") - acc.m)).alias("s"),
            acc.m.alias("m"),
        ),
        lambda acc: acc.s,
    )
    return F.sqrt(spread / F.size(arr))


def largest(arr: Column, of=lambda x: x) -> Column:
    return F.array_max(F.transform(arr, lambda x: of(x).cast("double")))


def consecutive(arr: Column, fn) -> Column:
    """fn(previous, current) for each neighbouring pair; empty for fewer than two items."""
    n = F.greatest(F.size(arr) - 1, F.lit(0))
    return F.zip_with(F.slice(arr, F.lit(1), n), F.slice(arr, F.lit(2), n), fn)


def leg_km(a, b) -> Column:
    return haversine_km(
        a.lat.cast("double"), a.lon.cast("double"), b.lat.cast("double"), b.lon.cast("double")
    )


def path_km(points: Column) -> Column:
    """Length of a track given as an array of structs with lat and lon."""
    return total(consecutive(points, leg_km))


def running_sum(arr: Column) -> Column:
    """Prefix sums of an array of doubles."""
    return F.aggregate(
        arr,
        F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("s")),
        lambda acc, x: F.struct(
            F.concat(acc.out, F.array(acc.s + x)).alias("out"), (acc.s + x).alias("s")
        ),
        lambda acc: acc.out,
    )
