"""Column functions on arrays of numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine likeness; null for a null or zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, 1 where there is none."""
    return F.coalesce(1 - cosine(a, b), F.lit(1.0))


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """The longest array that both arrays begin with."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False)).cast("int")
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), F.when(first > 0, F.least(n, first - 1)).otherwise(n))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def normalize_box(box: Column | str, width: Column | str, height: Column | str) -> Column:
    """(x0, y0, x1, y1) as shares of the page, corners ordered, within 0..1; a malformed box is the whole page."""
    b = F.col(box) if isinstance(box, str) else box
    w, h = (F.col(x) if isinstance(x, str) else x for x in (width, height))
    x = [clamp(F.get(b, F.lit(i)).cast("double") / (w if i % 2 == 0 else h)) for i in range(4)]
    good = (F.size(b) == 4) & (w > 0) & (h > 0) & F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")))
    return F.when(good, F.array(F.least(x[0], x[2]), F.least(x[1], x[3]), F.greatest(x[0], x[2]), F.greatest(x[1], x[3]))).otherwise(F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)]))
