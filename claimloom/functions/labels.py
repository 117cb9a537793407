"""Evidence levels, distortion labels and their rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the taxonomy.
EVIDENCE_LEVELS = ("With_Evidence", "Weak_Evidence", "No_Evidence")
SEVERITIES = ("none", "mild", "moderate", "severe")
NO_DISTORTION = "no_distortion"
PRIORITY = ("substitution", "addition", "omission")
LEVEL1 = {
    "context_omission": "omission",
    "evidence_uncertainty_omission": "omission",
    "mechanism_omission": "omission",
    "function_application_addition": "addition",
    "significance_addition": "addition",
    "relation_substitution": "substitution",
    "magnitude_substitution": "substitution",
    "mechanism_substitution": "substitution",
}
UNCOVERED = ("numerical_change", "semantic_contradiction", "other")


def level1_of(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LEVEL1.items() for x in kv])[label]


def level_of(x: Column) -> Column:
    """with/weak/no and their variants to the canonical level; others unchanged."""
    low = F.lower(F.trim(x))
    out = F.when(low.isin("with", "with_evidence"), EVIDENCE_LEVELS[0]).when(low.isin("weak", "weak_evidence"), EVIDENCE_LEVELS[1])
    return out.when(low.isin("no", "no_evidence"), EVIDENCE_LEVELS[2]).otherwise(x)


def has_distortion(level: Column, primary: Column) -> Column:
    """Three-valued: null unless there is evidence."""
    return F.when(level == EVIDENCE_LEVELS[0], F.coalesce(primary, F.lit(NO_DISTORTION)) != NO_DISTORTION)


def standardise(level: Column, primary: Column, secondary: Column, severity: Column, uncovered: Column) -> Column:
    """A legal classification: a missing level is Weak, only With has labels, severity is moderate by default."""
    lev = F.coalesce(F.nullif(level, F.lit("")), F.lit(EVIDENCE_LEVELS[1]))
    is_with, bad = lev == EVIDENCE_LEVELS[0], has_distortion(lev, primary)
    sev = F.when(bad, F.when(severity.isin(*SEVERITIES[1:]), severity).otherwise(F.lit("moderate"))).when(is_with, F.lit("none")).otherwise(F.lit(""))
    second = F.when(bad & (secondary != primary) & secondary.isin(*LEVEL1), secondary)
    return F.struct(
        lev.alias("evidence_level"),
        bad.alias("has_distortion"),
        F.when(is_with, F.coalesce(primary, F.lit(NO_DISTORTION))).alias("primary"),
        F.when(bad, level1_of(primary)).alias("level1"),
        second.alias("secondary"),
        F.when(is_with | (lev != ""), sev).alias("severity"),
        (F.coalesce(uncovered, F.lit("")) != "").alias("needs_review"),
    )


# Labels of the former taxonomy, which are read and never written.
LEGACY = (
    "certainty_amplification", "mechanism_simplification", "scope_generalization", "numerical_distortion", "causality_distortion", "context_stripping",
    "fact_addition", "semantic_contradiction", "accurate",
)


def is_legacy(label: Column) -> Column:
    return label.isin(*LEGACY) & ~label.isin(*LEVEL1)


def read_view(level: Column, primary_label: Column, primary_type: Column, secondary_label: Column, secondary_types: Column, distorted: Column, accurate: Column) -> Column:
    """Old and new fields of a classification as one view; labels are read as they are, legacy ones too.

    A missing flag follows from the other one, then from the label, and stays null without evidence.
    """
    full = lambda x: F.nullif(F.trim(x), F.lit(""))
    primary = F.coalesce(full(primary_label), full(primary_type), F.lit(""))
    others = F.coalesce(F.filter(secondary_types, lambda x: F.coalesce(x, F.lit("")) != ""), F.array().cast("array<string>"))
    second = F.array_distinct(F.concat(F.array_compact(F.array(full(secondary_label))), others))
    is_with = F.coalesce(level == EVIDENCE_LEVELS[0], F.lit(False))
    by_label = F.when(primary.isin("", NO_DISTORTION, "accurate"), F.when(is_with, False)).otherwise(True)
    derived = F.when(level.isin(*EVIDENCE_LEVELS[1:]), F.lit(None)).when(accurate.isNotNull(), ~accurate).otherwise(by_label)
    bad = F.coalesce(distorted, derived)
    return F.struct(
        level.alias("evidence_level"),
        bad.alias("has_distortion"),
        F.coalesce(accurate, F.when(is_with, F.coalesce(~bad, F.lit(False)))).alias("is_accurate"),
        primary.alias("primary"),
        F.coalesce(level1_of(primary), F.lit("")).alias("level1"),
        second.alias("secondary"),
    )


def shape_errors(level: Column, distorted: Column, primary: Column, secondary: Column, severity: Column) -> Column:
    """The rules that a classification breaks, in order."""
    is_with = level == EVIDENCE_LEVELS[0]
    rules = [
        (~level.isin(*EVIDENCE_LEVELS) | level.isNull(), "level"),
        (is_with & distorted.isNull(), "has_distortion_missing"),
        (~is_with & distorted.isNotNull(), "has_distortion_present"),
        (is_with & distorted & ~F.coalesce(primary.isin(*LEVEL1), F.lit(False)), "primary"),
        (is_with & ~distorted & (F.coalesce(primary, F.lit("")) != NO_DISTORTION), "primary_undistorted"),
        (~is_with & primary.isNotNull(), "primary_present"),
        (secondary.isNotNull() & (secondary == primary), "secondary_same"),
        (is_with & distorted & ~F.coalesce(severity.isin(*SEVERITIES[1:]), F.lit(False)), "severity"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules]))


def reader_note(level: Column, distorted: Column, primary: Column) -> Column:
    """caution without evidence, ok where nothing is distorted, else correct and the label."""
    return F.when(level.isin(*EVIDENCE_LEVELS[1:]), F.lit("caution")).when(~distorted, F.lit("ok")).otherwise(F.concat(F.lit("correct:"), primary))
