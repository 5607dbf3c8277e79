"""Column functions for probabilities and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: clipping bound of probabilities before the logit.
PROB_EPS = 1e-6


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(x: Column | str) -> Column:
    """Logistic function; the exponent is never positive, so it cannot overflow."""
    x = _col(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: Column | str) -> Column:
    p = F.least(F.greatest(_col(p), F.lit(PROB_EPS)), F.lit(1 - PROB_EPS))
    return F.ln(p / (1 - p))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
