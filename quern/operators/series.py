"""Windows over series, standardising, metrics and sequential folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import with_quantiles


def sliding(
    df: DataFrame,
    station: str,
    time: str,
    features: list[str],
    target: str,
    past: int = 30,
    ahead: int = 7,
    inclusive: bool = True,
) -> DataFrame:
    """station, start, x (past rows of features), y (the next ahead targets); not inclusive drops each station's last window."""
    w = Window.partitionBy(station).orderBy(time)
    x = F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(w.rowsBetween(0, past - 1))
    y = F.collect_list(F.col(target).cast("double")).over(w.rowsBetween(past, past + ahead - 1))
    more = F.count("*").over(w.rowsBetween(past + ahead, past + ahead)) if not inclusive else F.lit(1)
    out = df.select(station, F.col(time).alias("start"), x.alias("x"), y.alias("y"), more.alias("_more"))
    return out.where((F.size("x") == past) & (F.size("y") == ahead) & (F.col("_more") > 0)).drop("_more")


def means_in_order(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """The mean of each group, its values added one by one in order: equal to the last bit however the rows are parted."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mean = F.sum(F.col(value)).over(upto) / F.count(value).over(upto)
    last = F.lead(F.lit(1)).over(Window.partitionBy(*by).orderBy(order)).isNull()
    return df.select(*by, F.when(F.count(value).over(upto) > 0, mean).alias(name), last.alias("_last")).where("_last").drop("_last")


def mean_row(x: Column, k: int) -> Column:
    """Mean over a window's rows of its k-th feature."""
    return F.aggregate(x, F.lit(0.0), lambda a, r: a + r[k]) / F.size(x)


def metrics(obs: str, pred: str) -> list[Column]:
    """mse, mae, rmse and nse (which is R2)."""
    e = F.col(obs) - F.col(pred)
    mse = F.avg(e * e)
    return [
        mse.alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(mse).alias("rmse"),
        (1 - F.sum(e * e) / (F.var_pop(obs) * F.count(obs))).alias("nse"),
    ]


def flow_loss(df: DataFrame, obs: str, pred: str, physics: float = 0.0, weight: float = 0.1) -> DataFrame:
    """mse + half the peaks' mse + a fifth of the squared low-flow bias + the weighted physics residual."""
    e = F.col(pred) - F.col(obs)
    x = with_quantiles(df, obs, _hi=0.9, _lo=0.1).agg(
        F.avg(e * e).alias("mse"),
        F.coalesce(F.avg(F.when(F.col(obs) > F.col("_hi"), e * e)), F.lit(0.0)).alias("peak"),
        F.coalesce(F.avg(F.when(F.col(obs) < F.col("_lo"), e)), F.lit(0.0)).alias("_bias"),
    )
    x = x.withColumn("low", F.col("_bias") * F.col("_bias")).drop("_bias")
    return x.withColumn("total", F.col("mse") + 0.5 * F.col("peak") + 0.2 * F.col("low") + weight * physics)


def early_stop(steps: Column, patience: int, delta: float) -> Column:
    """Folds sorted structs (step, val): best value, and the step at which patience ran out (null if never). Lower is better."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(None).cast("long").alias("stop"))

    def on(a: Column, s: Column) -> Column:
        better = s["val"] < a["best"] - delta
        bad = F.when(better, 0).otherwise(a["bad"] + 1)
        after = F.struct(
            F.when(better, s["val"]).otherwise(a["best"]).alias("best"),
            bad.cast("int").alias("bad"),
            F.when(bad >= patience, s["step"].cast("long")).alias("stop"),
        )
        return F.when(a["stop"].isNotNull(), a).otherwise(after)

    return F.aggregate(steps, start, on)


def every_kth(steps: Column, k: int) -> Column:
    """Of sorted structs, the k-th, 2k-th and so on: which log lines are kept."""
    return F.filter(steps, lambda s, i: (i + 1) % k == 0)
