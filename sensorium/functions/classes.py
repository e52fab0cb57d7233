"""Class ladders and the maps between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorium.functions.scalar import col, yes

# Severity order of result classes.
LADDER = ("Normal", "Drift", "Contextual Anomaly", "Drift + Anomaly", "Strong Anomaly")

# Plot token of each class.
PLOT_TOKENS = {
    "Strong Anomaly": "strong",
    "Drift + Anomaly": "drift_anomaly",
    "Contextual Anomaly": "contextual",
    "Drift": "drift",
    "Normal": "normal",
}

# Consensus status shown on the common ladder.
CONSENSUS_TO_LADDER = {"Actual Outlier": "Strong Anomaly", "Warning": "Drift", "Normal": "Normal"}

# Cluster detector class shown on the common ladder.
CLUSTER_TO_LADDER = {
    "Normal": "Normal",
    "Cluster Drift": "Drift",
    "Warning": "Drift + Anomaly",
    "Actual Outlier": "Strong Anomaly",
}


def lookup(value: Column | str, table: dict[str, object], default: object = None) -> Column:
    """Literal map look-up with a default."""
    items = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*items), col(value))
    return found if default is None else F.coalesce(found, F.lit(default))


def ladder_rank(final_class: Column | str) -> Column:
    """0 for Normal up to 4 for Strong Anomaly; unknown text ranks 0."""
    return lookup(final_class, {name: i for i, name in enumerate(LADDER)}, 0)


def ladder_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LADDER]), (rank + 1).cast("int"))


def plot_token(final_class: Column | str) -> Column:
    return lookup(final_class, PLOT_TOKENS, "normal")


def binary_status(final_class: Column | str) -> Column:
    """Normal, Abnormal or Unknown from a free class text."""
    c = F.lower(F.trim(col(final_class)))
    return (
        F.when(c.isNull() | c.isin("unknown", "", "nan", "none"), "Unknown")
        .when(c.isin("normal", "ok", "good"), "Normal")
        .otherwise("Abnormal")
    )


def z_ladder(abs_z: Column, drift: Column, drift_anomaly: Column, strong: Column) -> Column:
    """Three-threshold ladder on an absolute z."""
    return (
        F.when(abs_z >= strong, "Strong Anomaly")
        .when(abs_z >= drift_anomaly, "Drift + Anomaly")
        .when(abs_z >= drift, "Drift")
        .otherwise("Normal")
    )


def z_direction(status: Column, z: Column) -> Column:
    return (
        F.when(status == "Normal", "NORMAL").when(z > 0, "UP").when(z < 0, "DOWN").otherwise("UNKNOWN")
    )


def crossed_limit(final_class: Column, direction: Column) -> Column:
    """Name of the limit a reading crossed."""
    side = F.when(direction == "UP", "Upper").when(direction == "DOWN", "Lower")
    stem = lookup(
        final_class,
        {"Strong Anomaly": "Strong_Anomaly", "Drift + Anomaly": "Drift_Anomaly", "Drift": "Drift"},
    )
    return F.coalesce(F.concat(stem, F.lit("_"), side, F.lit("_Limit")), F.lit("Within_Limits"))


def limit_status(x: Column, lower: Column, upper: Column, otherwise: str = "Unknown") -> Column:
    return (
        F.when(x < lower, "Below Lower Limit")
        .when(x > upper, "Above Upper Limit")
        .when(yes(x.between(lower, upper)), "Within Limit")
        .otherwise(otherwise)
    )


def issue_category(status: Column, peer_fired: Column) -> Column:
    """Tag issue when the peer signal fired, process issue when not, null when normal.

    Runs without a peer signal fall back to the stored status text.
    """
    return (
        F.when(status.isNull() | (status == "Normal"), F.lit(None).cast("string"))
        .when(peer_fired, "tag")
        .when(~peer_fired, "process")
        .when(status == "Both", "both")
        .when(status.contains("Process"), "process")
        .otherwise("tag")
    )
