"""Metropolis-coupled Markov chain search of a few parameters.

Chains live on the driver: a chain is a handful of walkers with one number per
parameter.  What costs is the objective; all proposals of a step, over all walkers and
chains, go to Spark as one DataFrame, one task each, and come back as one number each.
Random numbers are ``random.Random`` with explicit seeds, so a run can be repeated.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from random import Random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLD, HOT = 0.3, 0.75
HISTORY = 1000
LEAST_SAMPLES = 100
BURN_IN = 0.1
PSRF_LIMIT = 1.1


@dataclass
class Variable:
    """A bounded parameter and its random stream."""

    name: str
    low: float
    high: float
    seed: int | None = None
    current: float = field(init=False)
    draw: float = field(init=False)

    def __post_init__(self):
        if self.low >= self.high:
            raise ValueError(f"{self.name}: the lower bound must be under the upper one")
        self.random = Random(self.seed)
        self.current = self.draw = round(self.random.uniform(self.low, self.high), 12)

    def propose(self, heat: float) -> float:
        """A step from the current value, reflected at the bounds."""
        span = self.high - self.low
        value = self.random.gauss(self.current, span * heat)
        for _ in range(100):
            if self.low <= value <= self.high:
                self.draw = round(value, 12)
                return self.draw
            value = 2 * (self.low if value < self.low else self.high) - value
        raise RuntimeError(f"{self.name}: no draw inside the bounds")

    def propose_anywhere(self) -> float:
        self.draw = round(self.random.uniform(self.low, self.high), 12)
        return self.draw

    def accept(self) -> None:
        self.current = self.draw


@dataclass
class Walker:
    """One point of a chain.  ``lava`` walkers jump anywhere and accept all, ``ice`` ones only climb."""

    variables: list[Variable]
    heat: float
    seed: int | None = None
    lava: bool = False
    ice: bool = False
    score: float | None = None
    proposed: float | None = None
    history: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.random = Random(self.seed)

    def propose(self) -> list[float]:
        return [v.propose_anywhere() if self.lava else v.propose(self.heat) for v in self.variables]

    def accept(self) -> None:
        for v in self.variables:
            v.accept()
        self.score = self.proposed

    def settle(self, std: float) -> bool:
        """Take or leave the proposal whose score is known; whether it was taken."""
        self.history = (self.history + [self.proposed])[-HISTORY:]
        if self.lava or self.score is None or self.proposed >= self.score:
            self.accept()
            return True
        if self.ice:
            return False
        z = (self.score - self.proposed) / (2 * std * self.heat) if std > 0 else math.inf
        chance = 1 - 0.5 * (1 + math.erf(z / math.sqrt(2)))
        if self.random.random() < chance:
            self.accept()
            return True
        return False


@dataclass
class Chain:
    walkers: list[Walker]
    samples: list[tuple] = field(default_factory=list)

    def best(self) -> Walker:
        """The walker with the largest score, the last of equals."""
        return max(reversed(self.walkers), key=lambda w: w.score)

    def swap(self) -> None:
        """The best walker takes the cold slot; lava and ice ones lend their values."""
        best, cold = self.best(), next(w for w in self.walkers if w.heat == min(x.heat for x in self.walkers))
        if best is cold:
            return
        if best.lava or best.ice:
            for mine, theirs in zip(cold.variables, best.variables, strict=True):
                mine.current = theirs.current
            cold.score = best.score
        else:
            cold.heat, best.heat = best.heat, cold.heat

    def sample(self, generation: int) -> None:
        best = self.best()
        self.samples.append((generation, *[v.current for v in best.variables], best.score))


def evaluated(spark: SparkSession, points: list[tuple[int, list[float]]], objective: Callable[[list[float]], float]) -> dict[int, float]:
    """Objective of every proposal of a step: one row each, spread over the tasks."""
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in points], "k int, point array<double>")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "value": [float(objective(list(p))) for p in pdf["point"]]})

    out = rows.repartition(max(1, len(points)), "k").mapInPandas(run, "k int, value double")
    return {r["k"]: r["value"] for r in out.collect()}


def search(
    spark: SparkSession, bounds: dict[str, tuple[float, float]], objective: Callable[[list[float]], float], steps: int, chains: int = 3,
    walkers: int = 2, seed: int = 0, lava: bool = True, ice: bool = True, check_every: int = 25,
) -> tuple[list[Chain], tuple[float, dict[str, float]]]:
    """Run the chains; returns them and the best score seen with its parameters.

    Stops after ``steps`` or when the samples of all chains agree (see :func:`psrf`).
    """
    rng = Random(seed)
    new = lambda: [Variable(n, lo, hi, rng.randint(1, 10**15)) for n, (lo, hi) in bounds.items()]
    made = []
    for _ in range(chains):
        normal = [Walker(new(), COLD if i == 0 else HOT, rng.randint(1, 10**15)) for i in range(walkers)]
        extra = [Walker(new(), HOT, rng.randint(1, 10**15), lava=True)] * lava + [Walker(new(), HOT, rng.randint(1, 10**15), ice=True)] * ice
        made.append(Chain(normal + extra))
    every = [w for c in made for w in c.walkers]
    best: tuple[float, dict[str, float]] = (-math.inf, {})
    for step in range(steps):
        values = evaluated(spark, [(k, w.propose()) for k, w in enumerate(every)], objective)
        for k, w in enumerate(every):
            w.proposed = values[k]
            if values[k] > best[0]:
                best = (values[k], {v.name: v.draw for v in w.variables})
        for c in made:
            seen = [s for w in c.walkers for s in w.history]
            mean = sum(seen) / len(seen) if seen else 0.0
            std = math.sqrt(sum((s - mean) ** 2 for s in seen) / len(seen)) if seen else 0.0
            for w in c.walkers:
                w.settle(std)
            c.swap()
            c.sample(step)
        if step + 1 >= LEAST_SAMPLES and (step + 1) % check_every == 0:
            rows = [(k, s[0], s[1 + i], n) for k, c in enumerate(made) for s in c.samples for i, n in enumerate(bounds)]
            table = spark.createDataFrame([(c, g, n, v) for c, g, v, n in rows], "chain int, gen int, variable string, value double")
            if psrf(table).first()["psrf"] < PSRF_LIMIT:
                break
    return made, best


def after_burn_in(samples: DataFrame, share: float = BURN_IN) -> DataFrame:
    """Samples ``chain, gen, …`` without the first ``share`` of each chain, rounded half to even."""
    gens = samples.select("chain", "gen").distinct()
    numbered = gens.withColumn("row", F.row_number().over(W.partitionBy("chain").orderBy("gen")))
    drop = gens.groupBy("chain").agg(F.bround(share * F.count("*"), 0).alias("drop"))
    kept = numbered.join(drop, "chain").filter(F.col("row") > F.col("drop")).select("chain", "gen")
    return samples.join(kept, ["chain", "gen"], "left_semi")


def psrf(samples: DataFrame, extra_columns: int = 2) -> DataFrame:
    """One row, ``within, between, psrf``, of samples ``chain, gen, variable, value``.

    ``within`` is the mean over chains of the mean over variables of the sample variance;
    ``between`` sets each chain's samples against every other chain's mean.  The length
    that the factor uses is the number of columns of a chain's log: the variables and
    ``extra_columns`` (generation and result).  Sums per chain and variable are all that
    meets, so no sample is paired with another.
    """
    kept = after_burn_in(samples)
    stats = kept.groupBy("chain", "variable").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.count("*").alias("n"))
    n_vars = stats.select("variable").distinct().agg(F.count("*").alias("vars")).withColumn("_1", F.lit(1))
    within = stats.withColumn("_1", F.lit(1)).join(F.broadcast(n_vars), "_1")
    per_chain = within.groupBy("chain").agg(F.sum(F.col("var") * F.col("n") / (F.col("n") - 1) / F.col("vars")).alias("w"))
    w = per_chain.agg((F.avg("w") + F.lit(1e-7) / F.count("*")).alias("within"), F.count("*").alias("chains")).withColumn("_1", F.lit(1))
    other = stats.select("variable", F.col("chain").alias("other"), F.col("mean").alias("other_mean"))
    crossed = stats.join(other, "variable").filter("chain != other")
    # sum over a chain's samples of (x - m)^2 = n * (variance + (mean - m)^2)
    dev = F.col("n") * (F.col("var") + F.pow(F.col("mean") - F.col("other_mean"), F.lit(2.0))) / (F.col("n") - 1)
    b = crossed.agg(F.sum(dev).alias("dev")).withColumn("_1", F.lit(1))
    one = w.join(b, "_1").join(n_vars, "_1")
    pairs = F.col("chains") * (F.col("chains") - 1) / 2
    between = F.col("dev") / F.col("vars") / (2 * pairs)
    length = F.col("vars") + extra_columns
    return one.select("within", between.alias("between"), F.sqrt((length - 1) / length + between / (length * F.col("within"))).alias("psrf"))


def last_scores(samples: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The last ``keep`` samples of each chain."""
    row = F.row_number().over(W.partitionBy("chain").orderBy(F.desc("gen")))
    return samples.withColumn("row", row).filter(F.col("row") <= keep).drop("row")
