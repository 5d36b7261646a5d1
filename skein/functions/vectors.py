"""Column expressions on vectors and bit fingerprints."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import bound


def dot(a: Column, b: Column) -> Column:
    """Inner product over the common length, in doubles."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length; 0 if a vector is empty or zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    size = norm(x) * norm(y)
    return F.when((n > 0) & (size > 0), dot(x, y) / size).otherwise(0.0)


def l2_normalize(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def sign_bits(a: Column, bits: int = 64) -> Column:
    """Bit k is set if element k is positive."""

    def read(x: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda s, k: F.when(F.get(x, k) > 0, s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))).otherwise(s))

    # a derived vector would otherwise be made anew for every bit
    return bound(a, read)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def positional_distance(a: Column, b: Column) -> Column:
    """Share of differing positions over the shorter length; 1 if that is 0."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(n > 0, F.aggregate(same, F.lit(0), lambda s, x: s + x) / n).otherwise(1.0)
