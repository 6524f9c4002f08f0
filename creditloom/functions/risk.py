"""Risk bands, decisions and small conversions used by reports and the audit log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band limits and the decision threshold.
HIGH, MEDIUM = 0.25, 0.10
THRESHOLD = 0.15

BAND_LABELS = {
    "log": ("high", "medium", "low"),
    "report": ("High Risk", "Moderate Risk", "Low Risk"),
    "table": ("High Risk", "Moderate", "Low Risk"),
}


def risk_band(p: Column, style: str = "log") -> Column:
    """Three bands; the style picks the spelling of the labels."""
    high, medium, low = BAND_LABELS[style]
    return F.when(p >= HIGH, high).when(p >= MEDIUM, medium).otherwise(low)


def prediction(p: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(p >= threshold, 1).otherwise(0)


def decision(p: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(p >= threshold, "Rejected").otherwise("Approved")


def risk_group(p: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(p >= threshold, "High Risk").otherwise("Safe")


def years_from_days(days: Column) -> Column:
    return F.round(F.abs(days) / F.lit(365.25), 1)


def years_employed(days: Column) -> Column:
    """Employment in years; a non-negative day count means not employed."""
    return F.when(days < 0, years_from_days(days)).when(days >= 0, F.lit(0.0))


def repayment_status(target: Column) -> Column:
    return F.when(target == 0, "Paid").when(target == 1, "Defaulted").otherwise("Unknown")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def normal_key(x: Column) -> Column:
    """Trimmed lower-case text, for user names and addresses."""
    return F.lower(F.trim(x))
