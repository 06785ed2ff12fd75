"""Sums of doubles that do not depend on the order of the rows.

A double is a whole number times a power of two, so a sum of whole numbers is
exact in any order. ``exact_sums`` cuts every value into ``DIGITS`` signed digits
of ``DIGIT_BITS`` bits at fixed binary places and adds the digits as longs, in
native aggregates. The places lie in bands of ``BAND_BITS`` bits; a value belongs
to the band of its magnitude, and the bands of a row are grouping keys beside the
caller's. Amounts between 2^-24 and 2^64 (and zero) are all in band 0, so usual
data has one group a key; a second grouping brings the bands of a key together
(24 a column at most). At the end the digits are carried, and the exact sum is
rounded once, to the nearest double (ties to even): what ``math.fsum`` gives.

Cases: nulls are left out; a sum of nothing is null; NaN or infinities of both
signs give NaN, infinities of one sign that infinity, as addition does; a sum
whose exact value is beyond the doubles is infinite; zeros give 0.0. More than
2^38 values of one key and band may overflow a digit's long: the job then fails
(``try_add`` is not used), it never gives a wrong sum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorscope.functions.numeric import is_finite

DIGIT_BITS = 24
DIGITS = 6
#: Digit 0 of band 0 counts units of 2^LOWEST.
LOWEST = -80
#: Exponents a band takes; its digits reach 56 bits below the least, so all 53 bits fit.
BAND_BITS = 88
FIRST_EXPONENT = -24
BANDS = range(-12, 12)
BASE = 1 << DIGIT_BITS


def band(x: Column) -> Column:
    """The band of a finite value. The logarithm may err next to a power of two;
    both bands hold such a value whole."""
    return F.when(x == 0, F.lit(0)).otherwise(
        F.floor((F.log2(F.abs(x)) - F.lit(float(FIRST_EXPONENT))) / F.lit(float(BAND_BITS))).cast("int"))


def digits(x: Column, b: Column) -> list[Column]:
    """The signed digits of a finite value in its band, lowest first: differences of
    the value rounded at neighbouring places (all exact in doubles)."""
    half = F.element_at(F.array(*[F.lit(2.0 ** (-BAND_BITS // 2 * k)) for k in BANDS]), b - BANDS[0] + 1)
    y = F.when(b == 0, x).otherwise(x * half * half)
    at = [F.rint(y * F.lit(2.0 ** -(LOWEST + DIGIT_BITS * i))) for i in range(DIGITS)]
    return [(at[i] - at[i + 1] * F.lit(float(BASE)) if i + 1 < DIGITS else at[i]).cast("long") for i in range(DIGITS)]


def exact_sums(df: DataFrame, keys: Sequence[str | Column], sums: Mapping[str, str | Column],
               whole: Mapping[str, str | Column] | None = None) -> DataFrame:
    """``keys`` and one double a name in ``sums`` (name -> column): the exact sum,
    rounded once. Integer and decimal columns are added as doubles; those in
    ``whole`` (integers) as longs beside them. Without keys: one row, also for an
    empty table."""
    whole = whole or {}
    names = list(sums)
    key_columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    inner = [f"_k{i}" for i in range(len(keys))]
    values = [F.col(c) if isinstance(c, str) else c for c in sums.values()]
    rows = df.select(*[k.alias(n) for k, n in zip(key_columns, inner)],
                     *[(F.col(c) if isinstance(c, str) else c).alias(f"_w{j}") for j, c in enumerate(whole.values())],
                     *[v.cast("double").alias(f"_v{j}") for j, v in enumerate(values)])
    rows = rows.select(*inner, *[f"_w{j}" for j in range(len(whole))], *[F.col(f"_v{j}") for j in range(len(names))],
                       *[F.when(is_finite(f"_v{j}"), F.col(f"_v{j}")).alias(f"_f{j}") for j in range(len(names))])
    rows = rows.withColumns({f"_b{j}": F.coalesce(band(F.col(f"_f{j}")), F.lit(0)) for j in range(len(names))})
    bands = [f"_b{j}" for j in range(len(names))]
    aggregates = [F.sum(f"_w{j}").alias(f"_w{j}") for j in range(len(whole))]
    for j in range(len(names)):
        aggregates += [F.sum(d).alias(f"_d{j}_{i}") for i, d in enumerate(digits(F.col(f"_f{j}"), F.col(f"_b{j}")))]
        aggregates.append(F.sum(F.when(~is_finite(f"_v{j}"), F.col(f"_v{j}"))).alias(f"_e{j}"))
    per_band = rows.groupBy(*inner, *bands).agg(*aggregates)
    finals = [F.sum(f"_w{j}").alias(f"_w{j}") for j in range(len(whole))]
    for j in range(len(names)):
        part = F.struct(F.col(f"_b{j}").alias("band"), F.array(*[F.col(f"_d{j}_{i}") for i in range(DIGITS)]).alias("digits"))
        # the combinations of the columns' bands, a bounded number a key
        finals += [F.collect_list(F.when(F.col(f"_d{j}_0").isNotNull(), part)).alias(f"_p{j}"), F.sum(f"_e{j}").alias(f"_e{j}")]
    grouped = per_band.groupBy(*inner).agg(*finals)
    labels = [df.select(k).columns[0] for k in key_columns]
    return grouped.select(*[F.col(i).alias(n) for i, n in zip(inner, labels)],
                        *[F.col(f"_w{j}").alias(n) for j, n in enumerate(whole)],
                        *[F.coalesce(F.col(f"_e{j}"), rounded(F.col(f"_p{j}"))).alias(n) for j, n in enumerate(names)])


def rounded(parts: Column) -> Column:
    """The nearest double of the digit sums in ``parts`` (null without any)."""
    def value(held: Column) -> Column:
        # usual data: one band, whose digits start at a fixed place; else all places of all bands
        first = F.get(held, F.lit(0))
        one = (F.size(held) == 1) & (first["band"] == 0)
        return _nearest(F.when(one, _padded(first["digits"])).otherwise(_all_places(held)),
                        F.when(one, F.lit(LOWEST)).otherwise(F.lit(PLACE_0)))
    return F.when(F.size(parts) > 0, _bound(parts, value))


# All bands on one scale: digits of DIGIT_BITS at PLACE_0 + DIGIT_BITS * i. A band starts
# BAND_BITS = 88 bits above the one before, so its digits are shifted by a multiple of
# 8 bits against the common places and each falls into two of them.
PLACE_0 = LOWEST + BAND_BITS * BANDS[0]
PLACES = (BAND_BITS * len(BANDS)) // DIGIT_BITS + DIGITS + 4


def _shl(a: Column, n: Column) -> Column:
    return F.call_function("shiftleft", a, n.cast("int"))


def _shr(a: Column, n: Column) -> Column:
    return F.call_function("shiftright", a, n.cast("int"))


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _padded(digit_sums: Column) -> Column:
    return F.concat(digit_sums, F.array_repeat(F.lit(0).cast("long"), 4))


def _all_places(parts: Column) -> Column:
    def add(acc: Column, part: Column) -> Column:
        first = (part["band"] - F.lit(BANDS[0])) * F.lit(BAND_BITS)
        at, shift = F.floor(first / F.lit(DIGIT_BITS)).cast("int"), F.pmod(first, F.lit(DIGIT_BITS))

        def moved(carried: Column) -> Column:
            # digits below BASE, so that a shifted one stays far from 2^63
            def place(v: Column, i: Column) -> Column:
                k = i - at
                low = F.when((k >= 0) & (k < F.size(carried)), F.get(carried, k)).otherwise(F.lit(0).cast("long"))
                under = F.when((k >= 1) & (k <= F.size(carried)), F.get(carried, k - 1)).otherwise(F.lit(0).cast("long"))
                down = F.lit(DIGIT_BITS) - shift
                return v + _shl(F.pmod(low, _shl(F.lit(1).cast("long"), down)), shift) + _shr(under, down)
            return F.transform(acc, place)
        return _bound(_carried(_padded(part["digits"])), moved)
    return F.aggregate(parts, F.array_repeat(F.lit(0).cast("long"), PLACES), add)


def _carried(d: Column) -> Column:
    """Digits in [0, BASE) but for the last, which keeps the sign."""
    zero = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("long").alias("carry"))

    def step(acc: Column, v: Column) -> Column:
        whole = v + acc["carry"]
        low = F.pmod(whole, F.lit(BASE).cast("long"))
        return F.struct(F.concat(acc["done"], F.array(low)).alias("done"),
                        _shr(whole, F.lit(DIGIT_BITS)).alias("carry"))

    def last(acc: Column) -> Column:
        n = F.size(acc["done"])
        return F.concat(F.slice(acc["done"], 1, n - 1),
                        F.array(F.get(acc["done"], n - 1) + acc["carry"] * F.lit(BASE).cast("long")))
    return F.aggregate(d, zero, step, last)


def _nearest(d: Column, lowest: Column) -> Column:
    """Digit sums at places ``lowest + DIGIT_BITS * i`` as the nearest double. Values
    used more than once are bound, so the expression stays small."""
    def signed(carried: Column) -> Column:
        def value(sign: Column) -> Column:
            positive = F.when(sign < 0, _carried(F.transform(carried, lambda v: -v))).otherwise(carried)
            return sign * _bound(positive, lambda p: _top_bits(p, lowest))
        return _bound(F.when(F.get(carried, F.size(carried) - 1) < 0, F.lit(-1.0)).otherwise(F.lit(1.0)), value)
    return _bound(_carried(d), signed)


def _top_bits(p: Column, lowest: Column) -> Column:
    """Carried digits, none negative: the first 62 bits as a long whose last bit says
    whether anything follows; Java's cast rounds it to the nearest even double."""
    top = F.array_max(F.transform(p, lambda v, i: F.when(v != 0, i).otherwise(F.lit(-1))))
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")

    def value(t: Column) -> Column:
        four = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(t >= i, F.get(p, t - i)).otherwise(zero))
        follows = F.exists(F.transform(p, lambda v, i: (i < t - 3) & (v != 0)), lambda x: x)
        return _bound(F.struct(four.alias("q"), follows.alias("more"), lowest.alias("lowest"), t.alias("t")), lead)

    def lead(x: Column) -> Column:
        q = [F.get(x["q"], F.lit(i)) for i in range(4)]

        def placed(room: Column) -> Column:
            # room: bits of the long below the first digit, 38 to 61
            third = F.when(room >= 48, _shl(q[2], room - 48)).otherwise(_shr(q[2], F.lit(48) - room))
            kept = _shl(q[0], room) + _shl(q[1], room - 24) + third + _shr(q[3], F.lit(72) - room)
            cut = ((F.pmod(q[2], _shl(one, F.greatest(F.lit(48) - room, F.lit(0)))) != 0)
                   | (F.pmod(q[3], _shl(one, F.lit(72) - room)) != 0) | x["more"])
            return _bound(F.struct(kept.bitwiseOR(F.when(cut, one).otherwise(zero)).alias("kept"),
                                   (x["lowest"] + x["t"] * F.lit(DIGIT_BITS) - room).alias("exponent")), _scaled)
        return _bound(F.lit(62) - F.length(F.bin(q[0])), placed)
    return _bound(top, lambda t: F.when(t < 0, F.lit(0.0)).otherwise(value(t)))


def _scaled(x: Column) -> Column:
    """``kept * 2^exponent``, rounded once. ``kept`` has 62 bits; where the result is
    below the normal doubles, it is rounded by hand to the bits that stay."""
    kept, exponent = x["kept"], x["exponent"]
    one = F.lit(1).cast("long")

    def by_hand(cut: Column) -> Column:
        def at_unit(unit: Column) -> Column:
            twice, odd = F.pmod(kept, unit) * 2, F.pmod(_shr(kept, cut), F.lit(2).cast("long")) == 1
            up = F.when((twice > unit) | ((twice == unit) & odd), one).otherwise(F.lit(0).cast("long"))
            return (_shr(kept, cut) + up).cast("double") * F.lit(2.0 ** -1074)
        return _bound(_shl(one, cut), at_unit)
    # powers of two are exact; two factors where one alone would be below the normal doubles
    low = kept.cast("double") * F.pow(F.lit(2.0), exponent + 200) * F.lit(2.0 ** -200)
    usual = kept.cast("double") * F.pow(F.lit(2.0), F.least(exponent, F.lit(1023)))
    return (F.when(exponent < -1083, _bound(F.least(F.lit(-1074) - exponent, F.lit(62)), by_hand))
            .when(exponent < -900, low).otherwise(usual))
