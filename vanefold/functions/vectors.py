"""Vector expressions as Columns, in DOUBLE: they stay in the JVM and reach the scan's projection."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(Enum):
    """Squared L2 (less is nearer), inner product and cosine (more is nearer)."""

    L2 = 0
    DOT = 1
    COSINE = 2

    @staticmethod
    def parse(name: str) -> Metric:
        known = {"l2": Metric.L2, "dot": Metric.DOT, "ip": Metric.DOT, "cos": Metric.COSINE, "cosine": Metric.COSINE}
        if name.lower() not in known:
            raise ValueError(f"unknown metric: {name}")
        return known[name.lower()]

    @property
    def higher_is_better(self) -> bool:
        return self is not Metric.L2


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, where body would compute it for every component."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalized(v: Column) -> Column:
    """v / |v|; a zero vector stays."""
    return _bound(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def prepared(v: Column, metric: Metric) -> Column:
    """What a collection stores, and what a query becomes."""
    return normalized(doubles(v)) if metric is Metric.COSINE else doubles(v)


def key(q: Column, v: Column, metric: Metric) -> Column:
    """The exact key of prepared vectors; less is better."""
    return squared_l2(q, v) if metric is Metric.L2 else -dot(q, v)


def score(k: Column, metric: Metric) -> Column:
    """What is reported for a key, to six decimals."""
    return F.round(k if metric is Metric.L2 else -k, 6)


def int8_scale(v: Column) -> Column:
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.when(most > 0, most / 127).otherwise(F.lit(1.0))


def int8_codes(v: Column, scale: Column) -> Column:
    """Rounded half away from zero and clamped to 127 either way."""
    return _bound(scale, lambda s: F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / s).cast("int")))))


def int8_values(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: c * scale)


def int8_key(qc: Column, qs: Column, qn: Column, c: Column, s: Column, n: Column, metric: Metric) -> Column:
    """The approximate key of two encoded vectors; n is the squared norm of the original."""
    inner = F.aggregate(F.zip_with(qc, c, lambda x, y: x * y), F.lit(0), lambda a, x: a + x) * qs * s
    return n + qn - 2 * inner if metric is Metric.L2 else -inner


def sign_words(v: Column, dim: int) -> Column:
    """ceil(dim / 64) words; bit j of the row is set where component j is not negative."""
    words = []
    for w in range(-(-dim // 64)):
        part = F.slice(v, 64 * w + 1, min(64, dim - 64 * w))
        words.append(F.aggregate(F.transform(part, lambda x, i: F.when(x >= 0, F.expr("shiftleft(1L, 0)") * 1).otherwise(F.lit(0)).cast("long")), F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("i")), lambda s, b: F.struct(F.when(b > 0, s["w"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), s["i"]))).otherwise(s["w"]).alias("w"), (s["i"] + 1).alias("i")), lambda s: s["w"]))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
