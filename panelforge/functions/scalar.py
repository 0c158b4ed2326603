"""Scalar expressions shared by the operators. All are built-in expressions inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null. Spark orders NaN above all numbers, so one comparison tells."""
    return F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False))


def finite(c: Column) -> Column:
    """The value as double, null where it is not finite."""
    d = c.cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def month_end(c: Column) -> Column:
    return F.last_day(c)


def month_start(c: Column) -> Column:
    return F.trunc(c, "MM")


def month_ordinal(c: Column) -> Column:
    """Months since year 0, so that successive months differ by one."""
    return F.year(c) * 12 + F.month(c)


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def parse_day(c: Column) -> Column:
    """ISO ``yyyy-MM-dd`` first, compact ``yyyyMMdd`` second; null where neither fits."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("yyyyMMdd"))).cast("date")


def null_tokens(c: Column, tokens: tuple[str, ...] = ("", "NA", "NaN")) -> Column:
    return F.when(~c.isin(*tokens), c)


def safe_div(a: Column, b: Column) -> Column:
    """``a / b`` as double; null where ``b`` is zero or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_ln(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def logsumexp(items: list[Column]) -> Column:
    m = F.greatest(*items)
    total = F.exp(items[0] - m)
    for x in items[1:]:
        total = total + F.exp(x - m)
    return m + F.ln(total)


def softmax_ref(scores: list[Column], clip: float = 30.0) -> list[Column]:
    """Probabilities of K classes of which class 0 is the reference with score 0; scores clipped to ±clip."""
    s = [F.lit(0.0)] + [F.greatest(F.lit(-clip), F.least(F.lit(clip), x)) for x in scores]
    z = logsumexp(s)
    return [F.exp(x - z) for x in s]


def argmax_array(a: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def normalise_ticker(c: Column) -> Column:
    return F.upper(F.trim(c))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def gaussian_from_hash(seed: int, *keys: Column) -> Column:
    """A standard normal draw fixed by the keys: same rows, same draw, whatever the partitioning (Box-Muller)."""
    def u(k: int) -> Column:
        h = F.xxhash64(F.lit(seed), F.lit(k), *keys)
        return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2**53))

    return F.sqrt(-2.0 * F.ln(u(1))) * F.cos(2.0 * 3.141592653589793 * u(2))
