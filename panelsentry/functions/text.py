"""Sentences and number formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Params
from .logs import exp

# What alerts and incidents say.
BEYOND = "%s FY%s: %s of %s is %s the expected range %s to %s (learned from FY%s, where a typical year was %s); that is %.1f robust sigmas from the typical year (limits sit at %.0f), so %.1f beyond the %s limit."
SHIFT = "%s FY%s: no single year breaks a control limit, but this is part of a run of %d+ consecutive years %s the historical typical %s of %s - the level has shifted rather than spiked."
BASELINE_NOTE = " Baseline: %d years, %d flagged year(s) held out, %d zero-period year(s) skipped."
PERSISTENT = "%s: flagged in %d consecutive years FY%d-FY%d (%s). %s no longer describes this country - treat as one regime change and re-fit its limits, not as %d separate investigations."
REVERSAL = "%s: FY%d moved %s and FY%d moved %s straight back - most likely ONE unusual year (FY%d); check that year's level first."
TWO_STEP = "%s: two unusual years in the same direction, FY%d %s and FY%d %s - a two-step change rather than a one-off."
LIFECYCLE = "%s: gross disbursement at or below zero for %d consecutive years FY%d-FY%d (%s); %s. The chart does not evaluate dormant years; this is an observation about the data, not an IDA status."
ALSO_ZERO = "repayments and commitments are ALSO zero - the whole country may be missing from the feed; verify"
STILL_FLOWING = "repayments/commitments continue, consistent with lending winding down"
NOUN = {"usd": "disbursement", "growth": "year-over-year change"}
COVERAGE = "coverage: the fixed baseline could not chart this country at all"
SENSITIVITY = "sensitivity: recent calmer years tightened the rolling limits"
ADAPTATION = "adaptation: the rolling baseline has absorbed a newer, more volatile regime"
RULE_NOTES = {
    "R1_net_identity": "Net != Gross - Repayments by more than $1 (rounding tolerance)",
    "R2_negative_gross": "Gross disbursement below zero - usually a refund/correction, verify",
    "R3_negative_repayments": "Repayments below zero",
    "R4_duplicate_key": "More than one row per (financier, fiscal_year, country)",
    "R5_region_reassigned": "Country appears under more than one region across years",
    "R6_stale_gross": "Gross disbursement identical to the cent to the prior fiscal year - stale feed?",
}

NULL_KEY_NOTE = "Rows without this key belong to no series; left out of rules that compare rows, of coverage and of charts"


def fmt_usd(v: Column) -> Column:
    return F.format_string("$%,.0f", v)


def nearest(v: Column, digits: int = 0) -> Column:
    """v to some decimals as C and Python print it: the nearest to the number that is held, halves to the even digit. The JVM's formats go by its shortest decimals, halves up."""
    if not digits:
        return F.rint(v)
    by = 10.0**digits
    scaled, t = v * by, v * 134217729.0  # 2^27 + 1: halves of v's digits, so that their products are exact
    high = t - (t - v)
    lost = (high * by - scaled) + (v - high) * by  # what scaled has lost by rounding
    down = F.floor(scaled)
    half = (scaled - down == 0.5) & (lost != 0)  # only seems to lie half way
    return F.when(half, down + F.when(lost > 0, 1).otherwise(0)).otherwise(F.rint(scaled)) / by


def fmt_pct(v: Column) -> Column:
    """Percent of a log change."""
    return pct_of(exp(v))


def pct_of(ratio: Column) -> Column:
    """Percent of a ratio of levels."""
    return F.format_string("%+.0f%%", nearest((ratio - 1) * 100))


def fmt(v: Column, kind: str) -> Column:
    return fmt_usd(v) if kind == "usd" else fmt_pct(v)


def change_pct(v: Column) -> Column:
    return F.bround((exp(v) - 1) * 100, 0)


def explain_alert(p: Params, kind: str, span: Column | None = None) -> Column:
    """One sentence for rows with entity, period, value, center, lcl, ucl, robust_z, rule."""
    c = F.col
    above = c("value") > c("ucl")
    z = F.abs("robust_z")
    span = F.lit(p.span) if span is None else span
    beyond = F.format_string(BEYOND, c("entity"), c("period").cast("string"), F.lit(NOUN[kind]), fmt(c("value"), kind), F.when(above, "above").otherwise("below"), fmt(c("lcl"), kind), fmt(c("ucl"), kind), span, fmt(c("center"), kind), nearest(z, 1), F.lit(p.sigmas), nearest(z - p.sigmas, 1), F.when(above, fmt(c("ucl"), kind)).otherwise(fmt(c("lcl"), kind)))
    shift = F.format_string(SHIFT, c("entity"), c("period").cast("string"), F.lit(p.run_length), F.when(c("value") > c("center"), "above").otherwise("below"), F.lit(NOUN[kind]), fmt(c("center"), kind))
    return F.when(c("rule") == "beyond_limits", beyond).when(c("rule") == "sustained_shift", shift).otherwise("")
