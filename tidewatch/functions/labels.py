"""Labels: the threshold rule, the bad-label test, and class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.schemas import BAD, CLASS_NAMES, NORMAL, UNKNOWN, WARNING

# Score thresholds of the rule, and the name it signs results with.
BAD_FROM, WARNING_FROM = 0.7, 0.4
RULE_MODEL = "rule-based-skeleton-v0"


def rule_label(score: Column, rule_status: Column) -> Column:
    """Label a score by thresholds; without a numeric score the received status is the label.

    NaN compares above every number in Spark but below no threshold here, so it is NORMAL.
    """
    by_score = (F.when(F.isnan(score), NORMAL)
                 .when(score >= BAD_FROM, BAD)
                 .when(score >= WARNING_FROM, WARNING)
                 .otherwise(NORMAL))
    return F.when(score.isNotNull(), by_score).otherwise(F.coalesce(rule_status, F.lit(UNKNOWN)))


def is_bad(label: Column) -> Column:
    """Anything but NORMAL and UNKNOWN; a missing label is UNKNOWN."""
    return ~F.coalesce(label, F.lit(UNKNOWN)).isin(NORMAL, UNKNOWN)


def state_key(user_id: Column, session_id: Column) -> Column:
    """The user, or the session when the user is missing or blank; null when neither is there."""
    return F.coalesce(F.when(user_id.rlike(r"\S"), user_id), F.when(session_id != "", session_id))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the maximum to stay finite."""
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def first_max_class(probabilities: Column) -> Column:
    """Class name of the largest probability; the first one wins a tie."""
    at = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in CLASS_NAMES]), at)


def class_probabilities(probabilities: Column) -> Column:
    """Map class name to probability, rounded half-even to 4 digits."""
    return F.map_from_arrays(
        F.array(*[F.lit(c) for c in CLASS_NAMES]),
        F.transform(probabilities, lambda p: F.bround(p, 4)))
