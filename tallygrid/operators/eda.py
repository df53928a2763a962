"""Estimation-of-distribution optimisation: generations of populations kept in Spark."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.cluster import cut
from tallygrid.network import Network
from tallygrid.operators.counting import Tally
from tallygrid.operators.ordered import first_k
from tallygrid.operators.sampling import uniform


class Part(ABC):
    """A replaceable step of the loop."""

    required = True


class Seeding(Part):
    @abstractmethod
    def seed(self, spark: SparkSession, cards: Sequence[int], n: int, seed: int) -> DataFrame: ...


class Selection(Part):
    @abstractmethod
    def select(self, population: DataFrame, n: int) -> DataFrame: ...


class Learning(Part):
    @abstractmethod
    def learn(self, selected: DataFrame, cards: Sequence[int]) -> Network: ...


class Sampling(Part):
    @abstractmethod
    def sample(self, spark: SparkSession, model: Network, n: int, seed: int) -> DataFrame: ...


class Stop(Part):
    @abstractmethod
    def stop(self, generation: int, statistics: Sequence["Statistics"]) -> bool: ...


class Replacement(Part):
    required = False

    @abstractmethod
    def replace(self, old: DataFrame, new: DataFrame, n: int) -> DataFrame: ...


class Change(Part):
    """Repair, mutation or local optimisation: rows to rows."""

    required = False

    @abstractmethod
    def change(self, population: DataFrame, generation: int) -> DataFrame: ...


class UniformSeeding(Seeding):
    def seed(self, spark, cards, n, seed):
        return spark.range(n).select("id", *[F.expr(f"CAST(floor(({uniform(seed, v)}) * {k}) AS INT)").alias(f"x{v}") for v, k in enumerate(cards)])


@dataclass
class Truncation(Selection):
    """The best part; equal ones by their id."""

    ratio: float = 0.5

    def select(self, population, n):
        return first_k(population, [F.desc("f"), F.asc("id")], max(1, int(n * self.ratio)))


@dataclass
class NetworkLearning(Learning):
    method: str = "k2"
    alpha: float = 1.0
    options: dict = field(default_factory=dict)

    def learn(self, selected, cards):
        return Network.fit(Tally.of(selected, [f"x{v}" for v in range(len(cards))], cards), self.method, alpha=self.alpha, **self.options)


class AncestralSampling(Sampling):
    def sample(self, spark, model, n, seed):
        return model.sample(spark, n, seed)


class FullReplacement(Replacement):
    def replace(self, old, new, n):
        return new


class Elitist(Replacement):
    """The best of both."""

    def replace(self, old, new, n):
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        return first_k(both, [F.desc("f"), F.asc("id"), F.asc("_new")], n).drop("_new")


@dataclass
class MaxGenerations(Stop):
    most: int

    def stop(self, generation, statistics):
        return generation + 1 >= self.most


@dataclass(frozen=True)
class Statistics:
    """Of one generation, after replacement and before selection; with several objectives a number for each."""

    generation: int
    best: float | tuple[float, ...]
    mean: float | tuple[float, ...]
    std: float | tuple[float, ...]
    worst: float | tuple[float, ...]


@dataclass
class Components:
    """The parts of a run; five of them are required."""

    seeding: Seeding | None = field(default_factory=UniformSeeding)
    selection: Selection | None = field(default_factory=Truncation)
    learning: Learning | None = field(default_factory=NetworkLearning)
    sampling: Sampling | None = field(default_factory=AncestralSampling)
    stop: Stop | None = field(default_factory=lambda: MaxGenerations(10))
    replacement: Replacement = field(default_factory=FullReplacement)
    repair: Change | None = None
    mutation: Change | None = None
    local: Change | None = None

    def missing(self) -> list[str]:
        return [k for k in ("seeding", "selection", "learning", "sampling", "stop") if getattr(self, k) is None]


@dataclass
class Kept:
    """What a run keeps of each generation."""

    statistics: bool = True
    populations: bool = False
    selected: bool = False
    models: bool = False
    fitness: bool = False

    @staticmethod
    def of(flags: Sequence[int]) -> "Kept":
        return Kept(*[bool(x) for x in flags])

    def flags(self) -> list[int]:
        return [int(x) for x in (self.statistics, self.populations, self.selected, self.models, self.fitness)]


@dataclass
class Run:
    best: list[int]
    fitness: float
    statistics: list[Statistics]
    models: list[Network]
    populations: list[DataFrame]


def statistics_of(population: DataFrame, generation: int, objectives: Sequence[str] = ("f",)) -> Statistics:
    """One pass over the population."""
    folds = {"best": F.max, "mean": F.avg, "std": F.stddev_pop, "worst": F.min}
    r = population.agg(*[fold(F.col(o)).alias(f"{name}_{i}") for name, fold in folds.items() for i, o in enumerate(objectives)]).first()
    found = {name: tuple(r[f"{name}_{i}"] for i in range(len(objectives))) for name in folds}
    return Statistics(generation, **{k: v[0] if len(objectives) == 1 else v for k, v in found.items()})


def run(spark: SparkSession, cards: Sequence[int], fitness: Column | Callable[[DataFrame], Column] | Sequence[Column], n: int, parts: Components | None = None, keep: Kept | None = None, seed: int = 0) -> Run:
    """Seed, evaluate, select, learn and sample until stopped. The fitness is a column over ``x0`` ...; every generation cuts the lineage.

    Several objectives, a list of columns, are kept as ``f0``, ``f1`` ...; ``f``, by which rows are selected and the best one is
    found, is their mean.
    """
    several = isinstance(fitness, (list, tuple))
    objectives = [f"f{i}" for i in range(len(fitness))] if several else ["f"]
    parts, keep = parts or Components(), keep or Kept()
    if missing := parts.missing():
        raise ValueError(f"missing parts: {missing}")

    def changed(df: DataFrame, names: Sequence[str], g: int) -> DataFrame:
        for k in names:
            if (part := getattr(parts, k)) is not None:
                df = part.change(df, g)
        return df

    def evaluated(df: DataFrame) -> DataFrame:
        if several:
            df = df.withColumns({o: c.cast("double") for o, c in zip(objectives, fitness, strict=True)})
            return df.withColumn("f", sum((F.col(o) for o in objectives), F.lit(0.0)) / len(objectives))
        return df.withColumn("f", (fitness(df) if callable(fitness) and not isinstance(fitness, Column) else fitness).cast("double"))

    stats: list[Statistics] = []
    models: list[Network] = []
    populations: list[DataFrame] = []
    population = cut(changed(evaluated(changed(parts.seeding.seed(spark, cards, n, seed), ["repair"], 0)), ["local"], 0))
    generation = 0
    while True:
        stats.append(statistics_of(population, generation, objectives))
        if keep.populations:
            populations.append(population)
        model = parts.learning.learn(cut(parts.selection.select(population, n)), cards)
        if keep.models:
            models.append(model)
        if parts.stop.stop(generation, stats):
            break
        generation += 1
        fresh = changed(parts.sampling.sample(spark, model, n, seed + generation), ["repair", "mutation"], generation)
        population = cut(parts.replacement.replace(population, changed(evaluated(fresh), ["local"], generation), n))
    top = population.orderBy(F.desc("f"), "id").first()
    return Run([top[f"x{v}"] for v in range(len(cards))], top["f"], stats, models, populations)
