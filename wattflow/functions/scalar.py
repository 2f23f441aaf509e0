"""Column expressions: the normal law, quantizing to bits, clauses, labels and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formula 7.1.26 of Abramowitz and Stegun, Handbook of Mathematical Functions.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

#: Bits of a word of packed bits.
WORD_BITS = 63
BIT_COUNTS = (1, 2, 4, 8)


def _erf_t(x: Column) -> Column:
    return 1 / (1 + ERF_P * F.abs(x))


def _erf_of(x: Column, t: Column) -> Column:
    poly = reduce(lambda acc, a: (acc + F.lit(a)) * t, reversed(ERF_A), F.lit(0.0))
    return F.when(x >= 0, 1.0).otherwise(-1.0) * (1 - poly * F.exp(-x * x))


def erf(x: Column) -> Column:
    """The error function to 1.5e-7, odd by construction."""
    return _erf_of(x, _erf_t(x))


def norm_cdf(x: Column, mean: Column | float = 0.0, std: Column | float = 1.0) -> Column:
    """The normal distribution function."""
    return 0.5 * (1 + erf((x - mean) / (std * F.lit(2.0**0.5))))


def _checked(n_bits: int) -> int:
    if n_bits not in BIT_COUNTS:
        raise ValueError(f"number of bits must be one of {BIT_COUNTS}")
    return n_bits


def quantize(x: Column, n_bits: int = 8) -> Column:
    """x in [0, 1] as a whole number of n_bits, halves to even; an error outside. Null stays null."""
    top = 2 ** _checked(n_bits) - 1
    whole = F.bround(x * F.lit(float(top)), 0).cast("int")
    return F.when((x < 0) | (x > 1), F.raise_error(F.lit("value to be quantized is outside [0, 1]")).cast("int")).otherwise(whole)


def to_bits(v: Column, n_bits: int = 8) -> Column:
    """A whole number as n_bits numbers 0 or 1, the most significant first."""
    return F.array(*(F.shiftright(v, i).bitwiseAND(1) for i in range(_checked(n_bits) - 1, -1, -1)))


def booleanize_array(features: Column, n_bits: int, mean: float | list[float], std: float | list[float]) -> Column:
    """Bits of all features in order: standardised by one mean and deviation or one each, through the normal law, quantized."""
    if isinstance(mean, list) != isinstance(std, list):
        raise ValueError("mean and std must both be numbers or both be lists")
    root = F.lit(2.0**0.5)
    if isinstance(mean, list):
        scaled = F.zip_with(F.zip_with(features, F.array(*map(F.lit, mean)), lambda x, m: x - m), F.array(*map(F.lit, std)), lambda x, s: x / s / root)
    else:
        scaled = F.transform(features, lambda x: (x - mean) / (std * root))
    # A lambda shares no common terms, so what is used more than once is an array of its own.
    chances = F.zip_with(scaled, F.transform(scaled, _erf_t), lambda z, t: 0.5 * (1 + _erf_of(z, t)))
    whole = F.transform(chances, lambda x: quantize(x, n_bits))
    return F.flatten(F.transform(whole, lambda v: to_bits(v, n_bits)))


def pack_bits(bits: Column, n: int) -> Column:
    """n bits as an array of words: bit p of the array has weight 2^(p mod 63) in word p div 63."""
    words = []
    for at in range(0, n, WORD_BITS):
        part = F.slice(bits, at + 1, min(WORD_BITS, n - at))
        words.append(F.aggregate(F.reverse(part), F.lit(0).cast("long"), lambda acc, b: acc * 2 + b.cast("long")))
    return F.array(*words)


def mask_of(positions: Column, n: int) -> Column:
    """Bit positions as words, so that masks and packed bits agree."""

    def word(at: int) -> Column:
        own = F.filter(positions, lambda p: (p >= at) & (p < at + WORD_BITS))
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, p: acc + F.pow(F.lit(2.0), (p - at).cast("double")).cast("long"))

    return F.array(*(word(at) for at in range(0, n, WORD_BITS)))


def clause_output(x: Column, positive: Column, negative: Column) -> Column:
    """Whether all included literals hold: the positive ones are 1, the negated ones 0. An empty clause holds. All are words."""
    good = F.zip_with(x, positive, lambda a, m: a.bitwiseAND(m) == m)
    none = F.zip_with(x, negative, lambda a, m: a.bitwiseAND(m) == 0)
    return F.forall(good, lambda v: v) & F.forall(none, lambda v: v)


def first_largest(votes: Column) -> Column:
    """The index of the largest number, the first on ties."""
    return (F.array_position(votes, F.array_max(votes)) - 1).cast("int")


def encode_label(label: Column, mapping: dict[str, int], strict: bool = True) -> Column:
    """The number of a label; an unknown label is an error if strict, else null. Null stays null."""
    if not mapping:
        raise ValueError("the mapping is empty")
    number = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))[label]
    if not strict:
        return number
    return F.when(label.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit("unknown label "), label)).cast("int")).otherwise(number)


def direction(transition: Column) -> Column:
    """1 for a rising edge, -1 for any other."""
    return F.when(transition > 0, 1).otherwise(-1)


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column, tolerance: int) -> Column:
    """Whether two closed intervals, each widened by tolerance at both ends, meet."""
    return (start_b - end_a <= 2 * tolerance) & (start_a - end_b <= 2 * tolerance)


def known(watts: Column) -> Column:
    """A reading with null in place of NaN, which Spark would compare as larger than any number."""
    return F.when(~F.isnan(watts), watts)


def feedback_probability(votes: Column, target: int, sign: int = 1) -> Column:
    """The chance that a clause learns from a sample: votes, cut to -target and target, fall short of target (sign 1, the sample's class) or exceed -target (sign -1, another class)."""
    if target < 1 or sign not in (1, -1):
        raise ValueError("target must be positive, sign 1 or -1")
    return (target - sign * F.least(F.greatest(votes, F.lit(-target)), F.lit(target))) / (2.0 * target)
