"""Scalar expression builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(value: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def ladder(*rules: tuple[Column, str], otherwise: Column | None = None) -> Column:
    """The code of the first rule that holds: ordered reasons as one CASE."""
    first, *rest = rules
    out = F.when(first[0], F.lit(first[1]))
    for condition, code in rest:
        out = out.when(condition, F.lit(code))
    return out.otherwise(otherwise) if otherwise is not None else out


def strict_json(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; null otherwise, also for a key that comes twice.

    The parser stops after the first value, so the text is read as a field of an object that
    must also reach its last field, whose value only the whole text can name.
    """
    end = F.sha2(text, 256)
    v = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(',"end":"'), end, F.lit('"}')))
    both = (F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))) == 2) & (F.try_variant_get(v, "$.end", "string") == end)
    return F.when(both, F.try_variant_get(v, "$.value", "variant"))


def rounded_double(x: Column, places: int) -> Column:
    """x rounded half away from zero after it is scaled as a double, as SQL engines do it; F.round looks at the shortest decimal instead."""
    scale = F.lit(float(10**places))
    return F.round(x * scale) / scale


def mid_rank_share(less: Column, equal: Column, n: Column) -> Column:
    """100 * (less + equal / 2) / n."""
    return F.lit(100.0) * (less + F.lit(0.5) * equal) / n


def safe_correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's r clamped to [-1, 1]; null where a side is constant or empty."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def signed_circular(a: Column, b: Column, turn: int = 1440) -> Column:
    """a - b on a circle, from -turn / 2 up to but without turn / 2."""
    return F.pmod(a - b + F.lit(turn / 2), F.lit(float(turn))) - F.lit(turn / 2)


def noon_unwrapped_median(minutes: Column | str) -> Column:
    """Median clock minute of times that may straddle midnight."""
    m = F.col(minutes) if isinstance(minutes, str) else minutes
    return F.pmod(F.median(F.pmod(m - F.lit(720.0), F.lit(1440.0))) + F.lit(720.0), F.lit(1440.0))


def exact_count(text: Column) -> Column:
    """A canonical decimal int64 (no sign, space or leading zero) as bigint; anything else is null."""
    ok = text.rlike(r"^(0|[1-9]\d{0,18})$")
    return F.when(ok, text).try_cast("bigint")


def duration_seconds(text: Column) -> Column:
    """'[+-]digits[.up to 9 digits]s' as decimal seconds; anything else is null."""
    return F.when(text.rlike(r"^[+-]?\d+(\.\d{1,9})?s$"), F.regexp_extract(text, r"^(.*)s$", 1)).try_cast("decimal(38,9)")


def to_kilograms(value: Column, unit: Column) -> Column:
    """kg as is, lb times 0.45359237 (fixed value); other units are null."""
    return F.when(unit == "kg", value).when(unit == "lb", value * F.lit(0.45359237))


def idempotency_key(*parts: Column) -> Column:
    """SHA-256 over the parts in order, null told apart from empty."""
    marked = [F.coalesce(F.concat(F.lit("v"), p.cast("string")), F.lit("n")) for p in parts]
    return F.sha2(F.concat_ws("\x1f", *marked), 256)
