"""Model Confidence Set: which models may be the best, by a block bootstrap of their losses.

Resamples are blocks of neighbouring rows.  Where a block ends is a hash of asset, resample
and block number, exploded to rows, so the draws need no generator state and come out alike
on any cluster; sums over blocks are one trailing frame, and a resample's means one
aggregate.  Elimination works on what is left then, a row per resample, of fixed number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.operators.blocks import by_block, own_rows, with_halo

BLOCK = 12
RESAMPLES = 200
LEVEL = 0.10


def drawn(assets: DataFrame, block: int, resamples: int) -> DataFrame:
    """(asset, resample, t): the last rows of the blocks drawn for each resample of ``assets`` (asset, n)."""
    draws = assets.select("asset", "n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    draws = draws.select("*", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / block).cast("int"))).alias("k"))
    seed = F.md5(F.concat_ws("|", "asset", F.col("resample").cast("string"), F.col("k").cast("string")))
    place = F.conv(F.substring(seed, 1, 12), 16, 10).cast("long") % (F.col("n") - block + 1)
    return draws.select("asset", "resample", (place + block).alias("t"))


def resampled(losses: DataFrame, models: tuple[str, ...], block: int, resamples: int) -> DataFrame:
    """(asset, resample, n, m_i, b_i): mean loss of each model, and its mean in each resample.

    Assets with fewer rows than a block are left out.  ``losses`` (asset, t, models) has
    consecutive ``t``, from any value on, and no missing loss.
    """
    means = losses.groupBy("asset").agg(F.min("t").alias("t0"), F.count("*").alias("n"), *(F.avg(m).alias(f"m_{i}") for i, m in enumerate(models))).where(F.col("n") >= block)
    rows = losses.join(means.select("asset", "t0"), "asset").withColumn("t", F.col("t") - F.col("t0") + 1)
    frame = by_block().rowsBetween(1 - block, 0)
    sums = own_rows(with_halo(rows, block - 1).withColumns({f"s_{i}": F.sum(m).over(frame) for i, m in enumerate(models)}))
    draws = drawn(means.select("asset", "n"), block, resamples)
    met = draws.join(sums.select("asset", "t", *(f"s_{i}" for i in range(len(models)))), ["asset", "t"])
    boot = met.groupBy("asset", "resample").agg(*((F.sum(f"s_{i}") / (F.count("*") * block)).alias(f"b_{i}") for i in range(len(models))))
    return boot.join(means.drop("t0"), "asset")


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def confidence_set(losses: DataFrame, models: tuple[str, ...], block: int = BLOCK, resamples: int = RESAMPLES, level: float = LEVEL) -> DataFrame:
    """Model Confidence Set of each asset by the largest t statistic: a row per asset and model.

    In each round the model whose mean loss lies furthest above that of the models left,
    in bootstrap standard errors, goes (of equal ones the first in ``models``).  The round's
    p-value is the share of resamples whose own largest deviation is at least as large; a model's
    ``p_value`` is the greatest so far, that of the last one 1, and ``in_set`` tells whether it
    reaches ``level``.  ``round`` counts from 1; the last model has that of no elimination, null.
    """
    every = Window.partitionBy("asset")
    rows = resampled(losses, models, block, resamples).repartition("asset")
    index = range(len(models))
    rows = rows.withColumns({f"a_{i}": F.lit(True) for i in index} | {f"p_{i}": F.lit(1.0) for i in index} | {f"r_{i}": F.lit(None).cast("int") for i in index} | {"p": F.lit(0.0)})
    for turn in range(1, len(models)):
        left = _sum([F.col(f"a_{i}").cast("int") for i in index])
        over = {x: _sum([F.when(F.col(f"a_{i}"), F.col(f"{x}_{i}")).otherwise(0.0) for i in index]) / left for x in "mb"}
        rows = rows.withColumns({"mm": over["m"], "mb": over["b"]})
        rows = rows.withColumns({f"d_{i}": F.col(f"m_{i}") - F.col("mm") for i in index} | {f"e_{i}": F.col(f"b_{i}") - F.col("mb") - F.col(f"m_{i}") + F.col("mm") for i in index})
        rows = rows.withColumns({f"v_{i}": F.sqrt(F.avg(F.col(f"e_{i}") * F.col(f"e_{i}")).over(every)) for i in index})
        ratio = {x: [F.when(F.col(f"a_{i}"), F.when(F.col(f"v_{i}") > 0, F.col(f"{x}_{i}") / F.col(f"v_{i}")).otherwise(0.0)) for i in index] for x in "de"}
        rows = rows.withColumns({f"t_{i}": c for i, c in enumerate(ratio["d"])} | {"worst": F.greatest(*ratio["d"]), "star": F.greatest(*ratio["e"])})
        rows = rows.withColumn("p", F.greatest("p", F.avg((F.col("star") >= F.col("worst")).cast("double")).over(every)))
        goes = F.coalesce(*(F.when(F.col(f"t_{i}") == F.col("worst"), i) for i in index))
        rows = rows.withColumn("goes", goes)
        gone = {i: F.col("goes") == i for i in index}
        rows = rows.withColumns({f"p_{i}": F.when(gone[i], F.col("p")).otherwise(F.col(f"p_{i}")) for i in index} | {f"r_{i}": F.when(gone[i], turn).otherwise(F.col(f"r_{i}")) for i in index} | {f"a_{i}": F.col(f"a_{i}") & ~gone[i] for i in index})
    one = rows.where("resample = 1")
    cells = [F.struct(F.lit(m).alias("model"), F.col(f"m_{i}").alias("mean_loss"), F.col(f"p_{i}").alias("p_value"), F.col(f"r_{i}").alias("round"), (F.col(f"p_{i}") >= level).alias("in_set")) for i, m in enumerate(models)]
    return one.select("asset", "n", F.explode(F.array(*cells)).alias("c")).select("asset", "n", "c.*")
