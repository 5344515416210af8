"""Forward sampling, rejection sampling and likelihood weighting.

A sample is a row with one int column for each variable, added in topological
order as an expression over its parents' columns: the look-up is a literal
array, so generation is one narrow stage. The uniform numbers come from a
counter (`seed`, sample, variable), so a sample does not depend on the
partitioning; `fast=True` uses Spark's own generator instead.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..network import Model, NetworkError, configurations, strides


def _row_number(model: Model, variable) -> Column:
    parents = model.network.parents(variable)
    out = F.lit(0)
    for p, s in zip(parents, strides(p.card for p in parents)):
        out = out + F.col(p.name) * s
    return out


def draw(u: Column, cumulative: Column) -> Column:
    """The first state whose cumulative probability exceeds u; the last one if rounding leaves none."""
    return F.least(F.size(F.filter(cumulative, lambda c: c <= u)), F.size(cumulative) - 1)


def _literal(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def weighted_samples(spark: SparkSession, model: Model, n: int, evidence: Mapping[str, int] | None = None, seed: int = 0, start: int = 0, fast: bool = False) -> DataFrame:
    """(sample_id, variables..., _weight): evidence variables are fixed and their probability given the parents goes into the weight."""
    evidence = dict(evidence or {})
    df = spark.range(start, start + n).select(F.col("id").alias("sample_id"))
    weight = F.lit(1.0)
    for v in model.network.topological():
        rows = [model.tables[v.id][c] for c in configurations(p.card for p in model.network.parents(v))]
        at = _row_number(model, v)
        if v.name in evidence:
            df = df.withColumn(v.name, F.lit(int(evidence[v.name])))
            weight = weight * F.get(F.array(*[F.lit(float(r[evidence[v.name]])) for r in rows]), at)
        else:
            cumulative = [[sum(r[: i + 1]) for i in range(len(r))] for r in rows]
            u = F.rand(seed * 1009 + v.id) if fast else uniform(seed, F.col("sample_id"), v.name)
            df = df.withColumn(v.name, draw(u, F.get(_literal(cumulative), at)).cast("int"))
    return df.withColumn("_weight", weight).select("sample_id", *[v.name for v in model.network.variables], "_weight")


def forward_samples(spark: SparkSession, model: Model, n: int, seed: int = 0, start: int = 0, fast: bool = False) -> DataFrame:
    return weighted_samples(spark, model, n, None, seed, start, fast).drop("_weight")


def tally(samples: DataFrame, model: Model, weight: str | None = "_weight") -> DataFrame:
    """(var_id, state, mass): summed weights of every state of every variable, from one pass."""
    w = F.col(weight) if weight else F.lit(1.0)
    each = F.array(*[F.struct(F.lit(v.id).alias("var_id"), F.col(v.name).alias("state")) for v in model.network.variables])
    return samples.select(w.alias("_w"), F.explode(each).alias("_x")).groupBy("_x.var_id", "_x.state").agg(F.sum("_w").alias("mass"))


def to_posterior(mass: DataFrame, model: Model, guard: str | None = None, least: float = 1e-20) -> DataFrame:
    """(var_id, state, p) over the whole domains. No mass gives nulls, or equal shares with guard="uniform"."""
    spark = mass.sparkSession
    domain = spark.createDataFrame([(v.id, s, v.card) for v in model.network.variables for s in range(v.card)], "var_id int, state int, card int")
    total = mass.groupBy("var_id").agg(F.sum("mass").alias("total"))
    joined = domain.join(mass, ["var_id", "state"], "left").join(total, "var_id", "left")
    none = 1 / F.col("card") if guard == "uniform" else F.lit(None).cast("double")
    return joined.select("var_id", "state", F.when(F.coalesce("total", F.lit(0.0)) < least, none).otherwise(F.coalesce("mass", F.lit(0.0)) / F.col("total")).alias("p"))


def likelihood_weighting(spark: SparkSession, model: Model, evidence: Mapping[str, int] | None = None, n: int = 10_000, seed: int = 0, guard: str | None = None, fast: bool = False) -> DataFrame:
    """(var_id, state, p) from n weighted samples."""
    return to_posterior(tally(weighted_samples(spark, model, n, evidence, seed, fast=fast), model), model, guard)


def make_samples(spark: SparkSession, model: Model, evidence: Mapping[str, int] | None = None, unit: int = 1_000_000, epsilon: float = 1e-3, seed: int = 0, max_units: int = 100, fast: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """(patterns with counts, posterior, units): units of samples are added until no posterior moves by epsilon, at least two. Patterns are counted unweighted."""
    before: dict[tuple[int, int], float] = {}
    mass: dict[tuple[int, int], float] = {}
    for k in range(max_units):
        part = weighted_samples(spark, model, unit, evidence, seed, start=k * unit, fast=fast)
        for r in tally(part, model).collect():  # one row for each state of each variable
            mass[r.var_id, r.state] = mass.get((r.var_id, r.state), 0.0) + r.mass
        now = {key: m / max(sum(x for (v, _), x in mass.items() if v == key[0]), 1e-300) for key, m in mass.items()}
        far = max((abs(now[x] - before.get(x, 0.0)) for x in now), default=0.0)
        before = now
        if k and far < epsilon:
            break
    names = [v.name for v in model.network.variables]
    patterns = weighted_samples(spark, model, (k + 1) * unit, evidence, seed, fast=fast).groupBy(*names).agg(F.count("*").alias("n"))
    table = spark.createDataFrame([(v, s, m) for (v, s), m in mass.items()], "var_id int, state int, mass double")
    return patterns, to_posterior(table, model), k + 1


def rejection_samples(spark: SparkSession, model: Model, n: int, evidence: Mapping[str, int] | None = None, seed: int = 0, max_rounds: int = 20, fast: bool = False) -> DataFrame:
    """The first n forward samples that agree with the evidence; an error if max_rounds of growing size do not give n."""
    evidence = dict(evidence or {})
    fits = F.lit(True)
    for name, state in evidence.items():
        fits = fits & (F.col(name) == state)
    tried, size, got, out = 0, n, 0, None
    for _ in range(max_rounds):
        part = forward_samples(spark, model, size, seed, tried, fast).filter(fits)
        out = part if out is None else out.union(part)
        got += part.count()
        tried += size
        if got >= n:
            return out.orderBy("sample_id").limit(n)
        size = min(64 * n, int(1.2 * (n - got) * tried / got) + 1 if got else 4 * size)
    raise NetworkError(f"only {got} of {tried} samples agree with the evidence; {n} are wanted")


def rejection_sampling(spark: SparkSession, model: Model, evidence: Mapping[str, int] | None = None, n: int = 10_000, seed: int = 0, **how) -> DataFrame:
    """(var_id, state, p): relative frequencies among n accepted samples."""
    return to_posterior(tally(rejection_samples(spark, model, n, evidence, seed, **how), model, None), model)
