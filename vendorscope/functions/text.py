"""String expressions with Python semantics, written as native Spark
expressions (regex, substring, format_number), never as Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` removes (``str.isspace``),
# as one regex character class usable by Java regex and RE2 alike.
PY_WHITESPACE_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
STRIP_PATTERN = f"^{PY_WHITESPACE_CLASS}+|{PY_WHITESPACE_CLASS}+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """``str.strip()``: leading and trailing Unicode whitespace (tabs included;
    Spark's ``trim`` only removes spaces). NULL stays NULL."""
    return F.regexp_replace(_c(c), STRIP_PATTERN, "")


def py_float_repr(c) -> Column:
    """``str(float)`` / ``repr(float)`` as Python prints it.

    Spark's double-to-string cast gives the same shortest digits but Java's
    layout (``1.0E-5``, ``-1.23456785E7``, ``Infinity``). Python uses plain
    notation for 1e-4 <= |x| < 1e16 and ``1e-05`` / ``1.5e+16`` otherwise.
    The parsed parts are bound once through a lambda so the expression stays
    small enough for whole-stage codegen.
    """
    s = _c(c).cast("double").cast("string")

    def assemble(p) -> Column:
        d, e, sign = p["d"], p["e"], p["sign"]
        nd = F.length(d)
        e1 = e + F.lit(1)
        plain_pos = F.concat(F.rpad(d, e1, F.lit("0")), F.lit("."),
                             F.when(nd > e1, F.call_function("substr", d, e + F.lit(2)))
                              .otherwise(F.lit("0")))
        plain_neg = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - F.lit(1)), d)
        sci = F.concat(
            F.substring(d, 1, 1),
            F.when(nd > 1, F.concat(F.lit("."), F.call_function("substr", d, F.lit(2))))
             .otherwise(F.lit("")),
            F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")),
            F.lpad(F.abs(e).cast("string"), 2, "0"))
        return F.concat(sign, F.when((e >= -4) & (e < 16),
                                     F.when(e >= 0, plain_pos).otherwise(plain_neg))
                               .otherwise(sci))

    def parse(sv) -> Column:
        neg = sv.startswith("-")
        body = F.when(neg, F.call_function("substr", sv, F.lit(2))).otherwise(sv)
        parts = F.struct(
            F.regexp_replace(F.regexp_replace(F.substring_index(body, "E", 1), r"\.", ""), "0+$", "")
             .alias("d"),
            F.substring_index(body, "E", -1).cast("int").alias("e"),
            F.when(neg, F.lit("-")).otherwise(F.lit("")).alias("sign"))
        return F.transform(F.array(parts), assemble)[0]

    return (
        F.when(s == "NaN", F.lit("nan"))
        .when(s == "Infinity", F.lit("inf"))
        .when(s == "-Infinity", F.lit("-inf"))
        .when(s.contains("E"), F.transform(F.array(s), parse)[0])
        .otherwise(s)
    )


def fixed_decimals(c, digits: int) -> Column:
    """``format(x, f'.{digits}f')`` without grouping: ``format_number`` rounds
    the binary value half-even, exactly as Python does (1.125 -> '1.12',
    2.675 -> '2.67'); ``format_string('%.2f')`` would round half-up."""
    c = _c(c)
    txt = F.regexp_replace(F.format_number(c, digits), ",", "")
    return (F.when(F.isnan(c), F.lit("nan"))
            .when(c == F.lit(float("inf")), F.lit("inf"))
            .when(c == F.lit(float("-inf")), F.lit("-inf"))
            .otherwise(txt))


def dollar_label(c) -> Column:
    """The reference's dollar label: >= 1e6 -> six decimals of millions + 'M'
    (its format spec ``2f`` is width 2, default precision 6), >= 1e3 -> two
    decimals of thousands + 'K', anything else (negatives too) -> ``str(x)``.

    Matches Python digit for digit for |x| < 1e16 (tested on random values);
    beyond that JDK 17's shortest-digit printing can differ in the last digit.
    NaN compares greater than everything in Spark, so it is tested first.
    """
    c = _c(c).cast("double")
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when(c >= 1_000_000,F.concat(fixed_decimals(c / 1_000_000, 6), F.lit("M")))
        .when(c >= 1_000, F.concat(fixed_decimals(c / 1_000, 2), F.lit("K")))
        .otherwise(py_float_repr(c))
    )
