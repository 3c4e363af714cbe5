"""Column expressions over array<float> or array<double>; arithmetic is in doubles."""

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 1e-8


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """a divided by its length, or by LEAST where that is shorter. The length is taken once."""
    return F.transform(F.array(F.greatest(norm(a), F.lit(LEAST))), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
