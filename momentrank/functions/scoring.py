"""Scores: logistic, penalties, gates, and calibration over a population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType

from ..tables import small
from .medians import HELD, medians

EPSILON = 1e-12
#: Scales a median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826


def sigmoid(x: Column) -> Column:
    """Logistic that never overflows: the exponent is not positive on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def hinge(gap: Column, tau: Column | float, weight: Column | float) -> Column:
    """``weight * max(0, gap - tau)``."""
    tau = tau if isinstance(tau, Column) else F.lit(tau)
    return (weight if isinstance(weight, Column) else F.lit(weight)) * F.greatest(F.lit(0.0), gap - tau)


def gated(kind: str, weight: float, confidence: Column, threshold: float) -> Column:
    """Order weight after the confidence gate: none, linear, or a threshold on the mean score or mean margin."""
    if kind == "none":
        return F.lit(weight)
    if kind == "linear":
        return F.lit(weight) * confidence
    if kind not in ("threshold", "margin"):
        raise ValueError(f"unknown gate: {kind}")
    return F.when(confidence >= threshold, F.lit(weight)).otherwise(F.lit(0.0))


def pair_softmax(pre: Column, post: Column, temperature: float = 1.0) -> Column:
    """Probability of ``post`` against ``pre`` [from documentation]."""
    return 1 / (1 + F.exp((pre - post) / temperature))


def middles(df: DataFrame, by: Sequence[str], value: str, name: str, accuracy: int | None = None, held: int = HELD) -> DataFrame:
    """``by..., name``: the median of each population; exact, by narrowing down where ``df`` has more than ``held`` rows."""
    if accuracy is None and df.count() > held:
        return medians(df, by, value, held).withColumnRenamed("median", name)
    middle = F.median(value) if accuracy is None else F.percentile_approx(value, 0.5, accuracy)
    return df.groupBy(*by).agg(middle.alias(name))


def robust_stats(df: DataFrame, by: Sequence[str], value: str, accuracy: int | None = None, held: int = HELD) -> DataFrame:
    """``by..., center, mad``: median and median absolute deviation of each population.

    Both are exact at any size: see ``medians``. ``accuracy`` takes mergeable percentile sketches instead, with that
    relative error's inverse, which read the rows once.
    """
    center = small(middles(df, by, value, "center", accuracy, held))
    off = df.join(center, list(by)).withColumn("__off", F.abs(F.col(value) - F.col("center")))
    return center.join(small(middles(off, by, "__off", "mad", accuracy, held)), list(by))


def robust_sigmoid(df: DataFrame, by: Sequence[str], value: str, out: str, clip: float = 8.0, accuracy: int | None = None) -> DataFrame:
    """Adds ``out``: the logistic of the clipped robust z-score within each population ``by``.

    The population's rows stay where they are: two aggregations give its statistics, which are joined back. A population
    without spread gets 0.5 at its median and the clipped tails elsewhere.
    """
    stats = small(robust_stats(df, by, value, accuracy))
    x, scale = F.col(value) - F.col("center"), MAD_SCALE * F.col("mad")
    same = F.abs(x) <= F.greatest(F.lit(EPSILON), 1e-9 * F.greatest(F.abs(F.col(value)), F.abs(F.col("center"))))
    flat = F.when(same, F.lit(0.5)).when(x > 0, sigmoid(F.lit(clip))).otherwise(sigmoid(F.lit(-clip)))
    z = F.greatest(F.lit(-clip), F.least(F.lit(clip), x / scale))
    score = F.when(scale <= EPSILON, flat).otherwise(sigmoid(z))
    return df.join(stats, list(by)).withColumn(out, score).drop("center", "mad")


def min_max(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: linear rescaling to [0, 1] within each population; 0.5 where there is no spread."""
    ends = small(df.groupBy(*by).agg(F.min(value).alias("__low"), F.max(value).alias("__high")))
    spread = F.col("__high") - F.col("__low")
    scaled = F.when(spread <= EPSILON, F.lit(0.5)).otherwise((F.col(value) - F.col("__low")) / spread)
    return df.join(ends, list(by)).withColumn(out, scaled).drop("__low", "__high")


def first_anchor(df: DataFrame, name: str) -> Column:
    """The anchor in a column that holds a number, a list of seeds (best first), or JSON text of either: the number or the first seed.

    Null for an empty list, and for text that is neither.
    """
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, ArrayType):
        return F.get(c, F.lit(0)).cast("double")
    if isinstance(kind, StringType):
        text = F.trim(c)
        return F.when(text.startswith("["), F.get_json_object(text, "$[0]")).otherwise(text).try_cast("double")
    if isinstance(kind, NumericType):
        return c.cast("double")
    raise TypeError(f"{name} is neither a number, a list nor text: {kind.simpleString()}")
