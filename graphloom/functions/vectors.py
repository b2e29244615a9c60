"""Vector arithmetic on ``array<float>`` columns, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = 1e-10) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(epsilon))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def mean_vector(vec: Column, size: int) -> Column:
    """The mean of a group's vectors, as an aggregate."""
    return F.array(*(F.avg(vec[i].cast("double")) for i in range(size)))


def transe_score(h: Column, r: Column, t: Column) -> Column:
    return -distance(add(h, r), t)


def complex_score(h_re: Column, h_im: Column, r_re: Column, r_im: Column, t_re: Column, t_im: Column) -> Column:
    """The real part of <h, r, conj(t)>."""
    three = lambda a, b, c: F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: x.cast("double") * y), c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return three(h_re, r_re, t_re) + three(h_im, r_re, t_im) + three(h_re, r_im, t_im) - three(h_im, r_im, t_re)
