"""Column functions: names and text, vectors, hashes, quantile maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(text: Column, hints: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(text).contains(h) for h in hints])


def name_words(text: Column) -> Column:
    """Words of a name, cut at underscores, hyphens, spaces and lower-to-upper changes."""
    apart = F.lower(F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", " "))
    return F.filter(F.split(apart, r"[_\s-]+"), lambda w: w != "")


def slug(text: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def role_of(name: Column, roles: dict[str, tuple[str, ...]]) -> Column:
    """The first role that has a word of the name; null without one."""
    words = name_words(name)
    return F.coalesce(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, marks))), F.lit(role)) for role, marks in roles.items()])


def fingerprint(*parts: Column) -> Column:
    """The first ten hexadecimal digits of the SHA-1 of parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 10)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is 0 or lengths differ."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(F.size(a) == F.size(b), F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


def quantile_of(quantiles: Column, probabilities: tuple[float, ...], q: float) -> Column:
    """Linear interpolation in stored quantiles, clamped at the ends."""
    if q <= probabilities[0]:
        return F.element_at(quantiles, 1)
    for i in range(1, len(probabilities)):
        lo, hi = probabilities[i - 1], probabilities[i]
        if q <= hi:
            a, b = F.element_at(quantiles, i), F.element_at(quantiles, i + 1)
            return a + (b - a) * ((q - lo) / (hi - lo))
    return F.element_at(quantiles, len(probabilities))


def mahalanobis(point: Column, centre: Column, inverse_variance: Column) -> Column:
    """Squared distance over the keys that all three maps share; null without any."""
    shared = F.array_intersect(F.array_intersect(F.map_keys(point), F.map_keys(centre)), F.map_keys(inverse_variance))
    term = lambda k: F.pow(F.element_at(point, k) - F.element_at(centre, k), F.lit(2)) * F.element_at(inverse_variance, k)
    return F.when(F.size(shared) > 0, F.aggregate(F.transform(shared, term), F.lit(0.0), lambda s, x: s + x))
