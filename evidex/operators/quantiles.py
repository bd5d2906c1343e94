"""Exact percentiles of many groups by counting, without lists of a group's values.

Each wanted rank of each group has an open interval that holds it. A round takes two cuts of every interval from a quantile sketch of bounded size, counts the values below, at, between and above them,
and keeps the part that holds the rank, or is done where the rank falls on a cut. All groups' ranks are refined together, two passes a round, which leaves about a hundredth of the values
or less, whatever their distribution; an interval of few values, as all are in small groups, is sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.shared import written

GRID, ACCURACY, SMALL = 256, 10_000, 10_000


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])


def _inside(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The values of open ranks' intervals, with the ranks' state."""
    after, before = F.col("s.lo").isNull() | (F.col("x.v") > F.col("s.lo")), F.col("s.hi").isNull() | (F.col("x.v") < F.col("s.hi"))
    return rows.alias("x").join(state.alias("s"), _same(keys) & after & before).select("x.v", "s.*")


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], *, small: int = SMALL) -> DataFrame:
    """keys and a double for each name of ``wanted`` (a fraction): linear interpolation between the two nearest ranks. Nulls don't count; a group of nulls alone has no row; null keys are a group."""
    names, keys = keys, [f"_key{i}" for i in range(len(keys))]
    x = rows.select(*[F.col(name).alias(k) for name, k in zip(names, keys, strict=True)], F.col(value).cast("double").alias("v")).where("v is not null")
    asked = []
    for name, p in wanted.items():
        at = F.lit(p) * (F.col("n") - 1)
        asked += [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (at - F.floor(at)).alias("part"), rank.cast("bigint").alias("r")) for side, rank in (("low", F.floor(at)), ("high", F.ceil(at)))]
    none = F.lit(None).cast("double")
    sizes = x.groupBy(*keys).agg(F.count("*").alias("n"))
    state = written(sizes.select(*keys, "n", F.explode(F.array(*asked)).alias("_asked")).select(*keys, "_asked.*", "n", none.alias("lo"), none.alias("hi"), none.alias("found")), "ranks")
    done, columns = [], state.columns
    while True:
        done += [state.where("found is not null"), _sorted(x, state.where((F.col("n") <= small) & F.col("found").isNull()), keys).select(*columns)]
        state = state.where((F.col("n") > small) & F.col("found").isNull())
        if state.isEmpty():
            break
        cut = _inside(x, state, keys).groupBy(*columns).agg(F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("grid"))
        at = F.col("r") / F.col("n") * GRID
        cut = cut.withColumns({"cut_lo": F.get("grid", F.greatest(F.lit(0), F.floor(at) - 1).cast("int")), "cut_hi": F.get("grid", F.least(F.lit(GRID), F.ceil(at) + 1).cast("int"))}).drop("grid")
        state = written(_narrowed(x, written(cut, "cuts"), keys).select(*columns), "ranks")
    every = reduce(DataFrame.unionByName, done)
    sides = every.groupBy(*keys, "name").agg(F.max(F.when(F.col("side") == "low", F.col("found"))).alias("low"), F.max(F.when(F.col("side") == "high", F.col("found"))).alias("high"), F.max("part").alias("part"))
    value_of = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    out = sides.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, value_of)).alias(name) for name in wanted])
    return out.withColumnsRenamed(dict(zip(keys, names, strict=True)))


def _narrowed(x: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """state with each rank's interval cut down to the part between its cuts, below or above them, or with the value found."""
    v, a, b = F.col("v"), F.col("cut_lo"), F.col("cut_hi")
    carried = state.columns
    counts = _inside(x, state, keys).groupBy(*carried).agg(F.count_if(v < a).alias("below"), F.count_if(v == a).alias("at_lo"), F.count_if((v > a) & (v < b)).alias("between"), F.count_if((v == b) & (b > a)).alias("at_hi"))
    r, upto = F.col("r"), [F.col("below"), F.col("below") + F.col("at_lo"), F.col("below") + F.col("at_lo") + F.col("between"), F.col("below") + F.col("at_lo") + F.col("between") + F.col("at_hi")]
    pick = lambda *five: F.when(r < upto[0], five[0]).when(r < upto[1], five[1]).when(r < upto[2], five[2]).when(r < upto[3], five[3]).otherwise(five[4])
    zero = F.lit(0).cast("bigint")
    return counts.select(
        *[F.col(c) for c in carried if c not in ("r", "n", "lo", "hi", "found")], pick(r, zero, r - upto[1], zero, r - upto[3]).alias("r"), pick(F.col("below"), zero, F.col("between"), zero, F.col("n") - upto[3]).alias("n"),
        pick(F.col("lo"), a, a, b, b).alias("lo"), pick(a, a, b, b, F.col("hi")).alias("hi"), pick(F.lit(None), a, F.lit(None), b, F.lit(None)).cast("double").alias("found"),
    )


def _sorted(x: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """state with the value of each rank, from the sorted values of its small interval."""
    found = _inside(x, state.drop("found"), keys).groupBy(*[c for c in state.columns if c != "found"]).agg(F.sort_array(F.collect_list("v")).alias("values"))
    return found.withColumn("found", F.get("values", F.col("r").cast("int"))).drop("values")
