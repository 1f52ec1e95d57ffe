"""Choosing agents by what is known of their success: Beta beliefs and Thompson sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIOR = 2.0


def beliefs(outcomes: DataFrame, agent: str, category: str, success: Column, confidence: Column | None = None, prior: float = PRIOR) -> DataFrame:
    """alpha, beta and number of observations of each agent and category.

    Each outcome adds its credit to alpha and the rest of 1 to beta; the credit is the
    confidence where there is one, else 1 or 0.
    """
    credit = success.cast("double") if confidence is None else F.coalesce(confidence.cast("double"), success.cast("double"))
    rows = outcomes.select(F.col(agent), F.col(category), credit.alias("_c"))
    return rows.groupBy(agent, category).agg((F.lit(prior) + F.sum("_c")).alias("alpha"), (F.lit(prior) + F.sum(1 - F.col("_c"))).alias("beta"), F.count("*").alias("observations"))


def mean(a: Column, b: Column) -> Column:
    return a / (a + b)


def variance(a: Column, b: Column) -> Column:
    return a * b / (F.pow(a + b, 2) * (a + b + 1))


def confidence(observations: Column) -> Column:
    return F.least(F.lit(1.0), observations / 20)


#: Proposals for one gamma variate; each is taken with a chance of over 0.95.
PROPOSALS = 12


def uniform(key: Column, name: Column) -> Column:
    """A number between 0 and 1 from the MD5 digest of a key and a name: the same on every engine."""
    return (F.conv(F.left(F.md5(F.concat_ws("|", key, name).cast("binary")), F.lit(8)), 16, 10).cast("double") + 0.5) / 2.0**32


def _gamma(key: Column, name: str, shape: Column) -> Column:
    """A gamma variate of unit scale: the first of some squeezed cubes of normals that is taken."""
    d = F.when(shape < 1, shape + 1).otherwise(shape) - 1.0 / 3
    c = 1 / F.sqrt(9 * d)
    u = lambda i, part: uniform(key, F.concat(F.lit(name), i.cast("string"), F.lit(part)))
    normal = lambda i: F.sqrt(-2 * F.log(u(i, "a"))) * F.cos(2 * math.pi * u(i, "b"))
    tries = F.transform(F.sequence(F.lit(0), F.lit(PROPOSALS - 1)), lambda i: F.struct(normal(i).alias("x"), F.log(u(i, "c")).alias("u")))
    roots = F.transform(tries, lambda s: F.struct(s["x"].alias("x"), s["u"].alias("u"), (1 + c * s["x"]).alias("t")))
    cubes = F.transform(F.filter(roots, lambda s: s["t"] > 0), lambda s: F.struct(s["x"].alias("x"), s["u"].alias("u"), (s["t"] * s["t"] * s["t"]).alias("v")))
    taken = F.filter(cubes, lambda s: s["u"] < 0.5 * s["x"] * s["x"] + d - d * s["v"] + d * F.log(s["v"]))
    drawn = d * F.coalesce(F.get(taken, F.lit(0))["v"], F.lit(1.0))
    return F.when(shape < 1, drawn * F.pow(uniform(key, F.lit(f"{name}p")), 1 / shape)).otherwise(drawn)


def beta_draw(key: Column, a: Column, b: Column) -> Column:
    """A draw from Beta(a, b), the same for the same key (text)."""
    x, y = _gamma(key, "x", a), _gamma(key, "y", b)
    return x / (x + y)


def select(known: DataFrame, candidates: DataFrame, excluded: DataFrame | None = None, agent: str = "agent", category: str = "category", seed: int | None = None, priors: DataFrame | None = None) -> DataFrame:
    """The best agent of each request: request, agent, theta, confidence.

    ``candidates``: request, category, agent, position. ``excluded``: request, agent.
    Agents without outcomes have the prior (or ``priors``: agent, category, alpha, beta).
    Theta is the posterior mean, or with a seed a draw; the first of equals wins. Requests
    without candidates have no row.
    """
    rows = candidates if excluded is None else candidates.join(excluded.select("request", agent), ["request", agent], "left_anti")
    rows = rows.join(known.select(agent, category, "alpha", "beta", "observations"), [agent, category], "left")
    if priors is not None:
        rows = rows.join(priors.select(agent, category, F.col("alpha").alias("_pa"), F.col("beta").alias("_pb")), [agent, category], "left")
    own = lambda c, p: F.coalesce(F.col(c), F.col(p) if priors is not None else F.lit(None).cast("double"), F.lit(PRIOR))
    rows = rows.withColumn("_a", own("alpha", "_pa")).withColumn("_b", own("beta", "_pb"))
    theta = mean(F.col("_a"), F.col("_b")) if seed is None else beta_draw(F.concat_ws("|", F.lit(str(seed)), F.col("request").cast("string"), F.col(agent).cast("string")), F.col("_a"), F.col("_b"))
    rows = rows.withColumn("theta", theta)
    best = rows.groupBy("request").agg(F.max_by(F.struct(F.col(agent), F.col("theta"), F.coalesce("observations", F.lit(0).cast("long")).alias("n")), F.struct("theta", -F.col("position"))).alias("b"))
    return best.select("request", F.col(f"b.{agent}").alias(agent), F.col("b.theta").alias("theta"), confidence(F.col("b.n")).alias("confidence"))
