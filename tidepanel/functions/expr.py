"""Column expressions of the panel: numbers, periods, ratios, scores. All of them are JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def known(x: Column | str) -> Column:
    """NaN as NULL: a NaN compares greater than any number."""
    return F.when(~F.isnan(c(x)), c(x))


def trimmed(x: Column | str) -> Column:
    """Without any leading or trailing white space (``trim`` takes spaces only)."""
    return F.regexp_replace(c(x), r"^\s+|\s+$", "")


def spanish_number(x: Column | str) -> Column:
    """'9.220' -> 9220, '45,73' -> 45.73; '', '.', '..' and anything else -> NULL."""
    t = trimmed(x)
    plain = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(~t.isin("", ".", ".."), plain).try_cast("double")


def territory_code(x: Column | str) -> Column:
    """Two leading digits of '38 Santa Cruz', else NULL."""
    return F.when(trimmed(x).rlike(r"^\d{2}\s+\S"), F.substring(trimmed(x), 1, 2))


def territory_name(x: Column | str) -> Column:
    return F.when(trimmed(x).rlike(r"^\d{2}\s+\S"), F.regexp_replace(trimmed(x), r"^\d{2}\s+", ""))


def is_period(x: Column | str) -> Column:
    return c(x).rlike(r"^[0-9]{4}M(?:0[1-9]|1[012])$")


def period_month(x: Column | str) -> Column:
    """'2026M05' -> 2026-05-01; malformed -> NULL."""
    return F.when(is_period(x), F.to_date(F.concat(F.replace(c(x), F.lit("M"), F.lit("-")), F.lit("-01"))))


def month_id(d: Column | str) -> Column:
    return F.date_format(c(d), "yyyy-MM")


def month_index(d: Column | str) -> Column:
    """Months since year 0: the ordering key of calendar windows."""
    return F.year(c(d)) * 12 + F.month(c(d))


def season(m: Column | str) -> Column:
    m = c(m)
    return F.when(m.isin(12, 1, 2), "winter").when(m.between(3, 5), "spring").when(m.between(6, 8), "summer").when(m.isNotNull(), "autumn")


def month_name(m: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), c(m).cast("int"))


def coverage_class(ratio: Column | str) -> Column:
    r = c(ratio)
    return F.when(r >= 0.95, "high").when(r >= 0.80, "medium").when(r >= 0.50, "low").otherwise("insufficient")


def safe_divide(n: Column | str, d: Column | str) -> Column:
    """NULL unless the denominator is positive."""
    return F.when(c(d) > 0, c(n) / c(d))


def pct_change_positive(now: Column | str, before: Column | str) -> Column:
    """Change in percent, NULL unless the earlier value is positive."""
    return F.when(c(before) > 0, (c(now) - c(before)) / c(before) * 100)


def pct_change_nonzero(now: Column | str, before: Column | str) -> Column:
    """Change in percent, NULL if the earlier value is zero or missing."""
    return F.when(c(before) != 0, (c(now) - c(before)) / c(before) * 100)


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bounded, NULL stays NULL (``greatest`` and ``least`` skip NULLs)."""
    out = c(x)
    if high is not None:
        out = F.least(F.lit(float(high)), out)
    if low is not None:
        out = F.greatest(F.lit(float(low)), out)
    return F.when(c(x).isNotNull(), out)


def round2(x: Column | str) -> Column:
    """Two decimals, halves to even on the scaled double."""
    return F.rint(c(x) * 100) / 100


def integer_or_violation(x: Column | str, tolerance: float = 1e-6) -> tuple[Column, Column]:
    """(bigint value, whether the fraction exceeds the tolerance)."""
    return F.rint(c(x)).cast("bigint"), F.abs(c(x) - F.rint(c(x))) > tolerance


def integer_or_fail(x: Column | str, name: str, tolerance: float = 1e-6) -> Column:
    """bigint value; a fraction beyond the tolerance fails the query that meets it."""
    value, bad = integer_or_violation(x, tolerance)
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{name}: not a whole number: "), c(x).cast("string"))).cast("bigint")).otherwise(value)


def weighted_available_score(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are not NULL; NULL if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) * w for x, w in parts])
    weight = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in parts])
    return F.when(weight > 0, total / weight)


def all_present(*cols: Column | str) -> Column:
    return reduce(lambda a, b: a & b, [c(x).isNotNull() for x in cols])


def any_present(*cols: Column | str) -> Column:
    return reduce(lambda a, b: a | b, [c(x).isNotNull() for x in cols])


def data_status(provisional: Column | str) -> Column:
    p = c(provisional)
    return F.when(p, "provisional").when(~p, "final_or_not_marked_provisional").otherwise("unknown")


def fingerprint(demand: Column | str, supply: Column | str) -> Column:
    return F.sha2(F.concat(F.lit("demand:"), c(demand), F.lit("|supply:"), c(supply)), 256)


def same_within(a: Column | str, b: Column | str, tolerance: float = 1e-6) -> Column:
    """NULL equals NULL only."""
    return F.coalesce(c(a).eqNullSafe(c(b)) | (F.abs(c(a) - c(b)) <= tolerance), F.lit(False))


def improvement_pct(baseline: Column | str, model: Column | str) -> Column:
    return F.when(c(baseline) != 0, (c(baseline) - c(model)) / c(baseline) * 100)


def lookup(x: Column | str, mapping: dict[str, str]) -> Column:
    """Dictionary map; unmapped -> NULL (see ``normalize.unmapped``)."""
    if not mapping:
        return F.when(c(x).isNull(), F.lit(None).cast("string"))
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])[c(x)]


def snapshot_time(file_name: Column | str) -> Column:
    """Timestamp of names such as 20260101T101500Z_label.csv; NULL without one."""
    return F.try_to_timestamp(F.regexp_extract(c(file_name), r"([0-9]{8}T[0-9]{6}Z)_", 1), F.lit("yyyyMMdd'T'HHmmss'Z'"))
