"""Period labels (YYYY, YYYY-Qn, YYYY-MM, ISO date) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANNUAL = r"^\d{4}$"
QUARTERLY = r"^\d{4}-Q[1-4]$"
MONTHLY = r"^\d{4}-(0[1-9]|1[0-2])$"
ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"

# Label length that each period type requires; irregular accepts any length.
LABEL_LENGTHS = {"annual": 4, "quarterly": 7, "monthly": 7, "daily": 10, "weekly": 10}
PERIOD_TYPES = tuple(LABEL_LENGTHS) + ("irregular",)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def quarter_label(day: Column | str) -> Column:
    day = _col(day)
    return F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string"))


def period_start(label: Column | str) -> Column:
    """First day of the labelled period, null when the label has no supported shape."""
    text = F.upper(F.trim(_col(label).cast("string")))
    return (
        F.when(text.rlike(ANNUAL), F.concat(text, F.lit("-01-01")).try_cast("date"))
        .when(
            text.rlike(QUARTERLY),
            F.concat(
                F.substring(text, 1, 4), F.lit("-"),
                F.lpad(((F.substring(text, 7, 1).try_cast("int") - 1) * 3 + 1).cast("string"), 2, "0"),
                F.lit("-01"),
            ).try_cast("date"),
        )
        .when(text.rlike(MONTHLY), F.concat(text, F.lit("-01")).try_cast("date"))
        .when(text.rlike(ISO_DAY), text.try_cast("date"))
    )


def inferred_type(label: Column | str) -> Column:
    text = F.upper(F.trim(_col(label).cast("string")))
    return (
        F.when(text.rlike(ANNUAL), "annual")
        .when(text.rlike(QUARTERLY), "quarterly")
        .when(text.rlike(MONTHLY), "monthly")
        .otherwise("irregular")
    )


def normalize_period(label: Column | str, declared: Column | None = None) -> Column:
    """struct(label, period_type, start, valid): the type must agree with the label length."""
    text = F.upper(F.trim(_col(label).cast("string")))
    kind = F.coalesce(declared, inferred_type(label)) if declared is not None else inferred_type(label)
    expected = F.lit(None).cast("int")
    for name, width in LABEL_LENGTHS.items():
        expected = F.when(kind == name, width).otherwise(expected)
    start = period_start(label)
    valid = start.isNotNull() & (
        (kind == "irregular") | F.coalesce(F.length(text) == expected, F.lit(False))
    )
    return F.struct(text.alias("label"), kind.alias("period_type"), start.alias("start"), valid.alias("valid"))


def period_index(label: Column | str, frequency: Column | str) -> Column:
    """Integer position on the calendar of the given frequency; null for other frequencies."""
    label, frequency = _col(label), _col(frequency)
    year = F.substring(label, 1, 4).try_cast("int")
    return (
        F.when(frequency == "annual", year)
        .when(frequency == "quarterly", year * 4 + F.substring(label, 7, 1).try_cast("int") - 1)
        .when(frequency == "monthly", year * 12 + F.substring(label, 6, 2).try_cast("int") - 1)
    )


def quarter_index(label: Column | str) -> Column:
    return period_index(label, F.lit("quarterly"))


def date_index(day: Column | str, frequency: str) -> Column:
    """Integer period index of a period start date."""
    day = _col(day)
    if frequency == "annual":
        return F.year(day)
    if frequency == "quarterly":
        return F.year(day) * 4 + F.quarter(day) - 1
    if frequency == "monthly":
        return F.year(day) * 12 + F.month(day) - 1
    raise ValueError(f"unsupported frequency: {frequency}")


def shift(day: Column | str, periods: int, frequency: str) -> Column:
    """Move a period start by whole periods of the frequency."""
    months = {"annual": 12, "quarterly": 3, "monthly": 1}[frequency]
    return F.add_months(_col(day), periods * months)


def period_end(label: Column | str, frequency: Column | str) -> Column:
    start = period_start(label)
    frequency = _col(frequency)
    return F.when(frequency == "annual", F.last_day(F.add_months(start, 11))).when(
        frequency == "quarterly", F.last_day(F.add_months(start, 2))
    ).when(frequency == "monthly", F.last_day(start))


# Fixed values: (input frequency, output frequency, transformation) combinations that are allowed.
FREQUENCY_CONVERSIONS = {
    ("annual", "annual", "source_last_observation"),
    ("annual", "quarterly", "annual_carry_forward"),
    ("daily", "annual", "period_mean_broadcast"), ("daily", "annual", "period_end_broadcast"),
    ("daily", "quarterly", "period_mean_broadcast"), ("daily", "quarterly", "period_end_broadcast"),
    ("weekly", "annual", "period_mean_broadcast"), ("weekly", "quarterly", "period_mean_broadcast"),
    ("monthly", "annual", "period_mean_broadcast"), ("monthly", "quarterly", "period_mean_broadcast"),
    ("monthly", "annual", "period_end_broadcast"), ("monthly", "quarterly", "period_end_broadcast"),
}


def require_conversion(source: str, target: str, transformation: str) -> None:
    if (source, target, transformation) not in FREQUENCY_CONVERSIONS:
        raise ValueError(f"frequency conversion is not allowed: {source} -> {target} by {transformation}")
