"""Decimal rounding of a double's exact binary value, half to even, as Python and C do it; all in the JVM.

Spark's own round, bround and format_string take the shortest decimal text of a double, and so differ where that text ends in
a tie that the binary value is beside (2.675) or where a tie is to go to the even side (0.125).

A value times 10**digits in doubles is right to one part in 2**53, which settles the rounding unless it comes that close to a
tie. Only then is the part after the point written as m / 2**s with a whole m, and m * 10**digits divided by 2**s in whole
decimals: what is left over says exactly on which side of the tie the value is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits after the point that are supported; what is below TINY is then below half of the last of them.
MOST = 17
TINY = 2.0**-60


def _power_of_two(s: Column) -> Column:
    half = F.call_function("div", s, F.lit(2)).cast("int")

    def factor(n: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), n).cast("decimal(19,0)")

    return factor(half) * factor(s - half)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _near_tie(x: Column, digits: int) -> Column:
    """The parts of x (not negative, below 2**63) in whole decimals."""
    def after_point(whole: Column) -> Column:
        return _let(x - whole.cast("double"), lambda after: _let(F.when(after >= TINY, after).otherwise(0.5), lambda seen: _let((F.lit(54) - F.floor(F.log2(seen))).cast("int"), lambda s: counted(whole, after, seen, s))))

    def counted(whole: Column, after: Column, seen: Column, s: Column) -> Column:
        m = (seen * F.pow(F.lit(2.0), s)).cast("long")  # at least 53 bits, so nothing is cut off
        n = m.cast("decimal(19,0)") * F.lit(10**digits).cast("decimal(18,0)")
        return _let(F.struct(n.alias("n"), _power_of_two(s).alias("d")), lambda q: _let(F.call_function("div", q["n"], q["d"]), lambda down: placed(whole, after, q, down)))

    def placed(whole: Column, after: Column, q: Column, down: Column) -> Column:
        left = (q["n"] - down.cast("decimal(18,0)") * q["d"]) * 2
        up = (left > q["d"]) | ((left == q["d"]) & (down % 2 == 1))
        k = F.when(after < TINY, F.lit(0).cast("long")).otherwise(down + F.when(up, F.lit(1)).otherwise(F.lit(0)))
        return _let(k, lambda k: _split(whole, k, digits))

    return _let(F.floor(x), after_point)


def _split(whole: Column, k: Column, digits: int) -> Column:
    return F.struct((whole + F.call_function("div", k, F.lit(10**digits))).cast("long").alias("whole"), (k % 10**digits).cast("long").alias("part"))


def _parts(x: Column, digits: int) -> Column:
    """struct(whole, part): the rounded digits of |x| before and after the point, as whole numbers; null for what is no number or beyond 2**63."""
    def scaled(size: Column) -> Column:
        return _let(size * float(10**digits), lambda y: _let(y - F.floor(F.when(y < 2.0**62, y).otherwise(0.0)), lambda after: chosen(size, y, after)))

    def chosen(size: Column, y: Column, after: Column) -> Column:
        sure = (y < 2.0**52) & (F.abs(after - 0.5) > y * 2.0**-52)
        k = F.floor(F.when(y < 2.0**62, y).otherwise(0.0)) + F.when(after > 0.5, F.lit(1)).otherwise(F.lit(0))
        return F.when(sure, _split(F.lit(0), k, digits)).otherwise(_near_tie(size, digits))

    return _let(F.abs(x), lambda size: F.when(~F.isnan(size) & (size < 2.0**63), scaled(size)))


def _checked(digits: int) -> None:
    if not 1 <= digits <= MOST:
        raise ValueError(f"from 1 to {MOST} digits")


def _minus(x: Column) -> Column:
    return x.cast("string").startswith("-")


def _text(n: Column, digits: int) -> Column:
    return F.concat(n["whole"].cast("string"), F.lit("."), F.lpad(n["part"].cast("string"), digits, "0"))


def fixed(value: Column, digits: int, width: int = 0) -> Column:
    """The text of `%<width>.<digits>f`; beyond 2**63 the digits of the shortest text, then zeros."""
    _checked(digits)

    def printed(x: Column) -> Column:
        return _let(_parts(x, digits), lambda n: F.concat(F.when(_minus(x), F.lit("-")).otherwise(F.lit("")), F.when(n.isNotNull(), _text(n, digits))
            .when(F.isnan(x), F.lit("nan")).when(F.abs(x) == float("inf"), F.lit("inf")).otherwise(F.format_string(f"%.{digits}f", F.abs(x)))))

    text = _let(value.cast("double"), lambda x: F.when(x.isNotNull(), printed(x)))
    return _let(text, lambda t: F.lpad(t, F.greatest(F.lit(width), F.length(t)), F.lit(" "))) if width else text


def rounded(value: Column, digits: int) -> Column:
    """The double nearest to value's rounding to so many decimals; null, NaN and infinities as they are, -0.0 where a negative value rounds to nothing."""
    if digits == 0:
        return F.rint(value.cast("double"))
    _checked(digits)

    def near(x: Column, n: Column) -> Column:
        small = n["whole"] < (1 << 53) // 10**digits - 1  # then the digits are a double
        size = F.when(small, (n["whole"] * 10**digits + n["part"]).cast("double") / F.lit(float(10**digits))).otherwise(_text(n, digits).cast("double"))
        return F.when(n.isNull(), x).when(_minus(x), -size).otherwise(size)

    return _let(value.cast("double"), lambda x: F.when(x.isNotNull(), _let(_parts(x, digits), lambda n: near(x, n))))
