"""Training history: early stopping, best epochs, checkpoint retention, versions, memory arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def early_stopping(history: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "val_loss", patience: int = 3, min_delta: float = 0.0) -> DataFrame:
    """Adds best (so far), waited (epochs without improvement) and stopped.

    An epoch improves if its loss is below the best so far by more than
    ``min_delta``; the first always does, and a loss that is no number never
    improves, nor is it ever improved upon. Without ``min_delta`` the best is the
    running minimum. With it, it depends on the improvements before, so a run is
    folded in order into the list of its improvements, and windows do the rest.
    """
    rows = history.select(F.col(run).alias("r"), F.col(epoch).cast("long").alias("e"), F.coalesce(F.col(loss).cast("double"), F.lit(float("nan"))).alias("l"))
    upto = Window.partitionBy("r").orderBy("e", "l").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("r").orderBy("e", "l")))
    if min_delta:
        entry = F.struct("n", "l")
        folded = F.aggregate(
            F.array_sort(F.collect_list(entry)),
            F.array().cast("array<struct<n:int,l:double>>"),
            lambda held, x: F.when((F.size(held) == 0) | (~F.isnan(x["l"]) & ~F.isnan(F.element_at(held, -1)["l"]) & (x["l"] < F.element_at(held, -1)["l"] - min_delta)), F.concat(held, F.array(x))).otherwise(held),
        )
        steps = rows.groupBy(F.col("r").alias("r2")).agg(folded.alias("held")).select("r2", F.inline("held").alias("n2", "l2"))
        marked = rows.join(steps, F.col("r").eqNullSafe(F.col("r2")) & (F.col("n") == F.col("n2")), "left").withColumn("better", F.col("n2").isNotNull())
    else:
        number = F.when(~F.isnan("l"), F.col("l"))
        before = F.min(number).over(Window.partitionBy("r").orderBy("e", "l").rowsBetween(Window.unboundedPreceding, -1))
        first = F.first("l").over(upto)
        marked = rows.withColumn("better", (F.col("n") == 1) | F.coalesce(~F.isnan(first) & (number < before), F.lit(False)))
    last = F.max(F.when(F.col("better"), F.struct("n", "l"))).over(upto)
    waited = marked.withColumn("last", last).withColumn("waited", (F.col("n") - F.col("last.n")).cast("int"))
    stopped = F.max("waited").over(upto) >= patience
    return waited.select(F.col("r").alias(run), F.col("e").alias(epoch), F.col("l").alias(loss), F.col("last.l").alias("best"), "waited", stopped.alias("stopped"))


def best_epoch(history: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "val_loss", lower_is_better: bool = True) -> DataFrame:
    """(run, epoch, loss) of the best epoch, the first among equals."""
    value = F.col(loss) if lower_is_better else -F.col(loss)
    least = F.min(F.struct(value.alias("v"), F.col(epoch).alias("e"), F.col(loss).alias("l")))
    return history.groupBy(run).agg(least.alias("b")).select(run, F.col("b.e").alias(epoch), F.col("b.l").alias(loss))


def kept_checkpoints(history: DataFrame, k: int = 3, run: str = "run", epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """The k best epochs of each run."""
    rank = F.row_number().over(Window.partitionBy(run).orderBy(loss, epoch))
    return history.withColumn("rank", rank).where(F.col("rank") <= k)


def newest_checkpoints(history: DataFrame, n: int = 3, run: str = "run", epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """The n newest epochs of each run, and the best one."""
    newest = F.row_number().over(Window.partitionBy(run).orderBy(F.col(epoch).desc()))
    best = F.row_number().over(Window.partitionBy(run).orderBy(loss, epoch))
    return history.withColumns({"newest": newest, "best": best}).where((F.col("newest") <= n) | (F.col("best") == 1)).drop("newest", "best")


def next_version(versions: DataFrame, day: str, column: str = "version") -> DataFrame:
    """One row: v<day>_<number>, the number after the day's highest."""
    number = F.max(F.when(F.col(column).startswith(f"v{day}_"), F.element_at(F.split(column, "_"), -1).try_cast("int")))
    return versions.agg(F.format_string(f"v{day}_%03d", F.coalesce(number, F.lit(0)) + 1).alias("version"))


def latest_version(versions: DataFrame, column: str = "version") -> DataFrame:
    return versions.agg(F.max(column).alias("version"))


def mean_loss(history: DataFrame, loss: str = "val_loss") -> DataFrame:
    return history.agg(F.coalesce(F.avg(loss), F.lit(0.0)).alias("loss"))


GIB = 1024.0**3


def image_memory(n: Column, height: int = 224, width: int = 224, channels: int = 3, size: int = 4) -> Column:
    """Gibibytes of n decoded images."""
    return n * F.lit(height * width * channels * size / GIB)


def text_memory(n: Column, length: int = 512, size: int = 8) -> Column:
    """Gibibytes of n token sequences with their masks."""
    return n * F.lit(2 * length * size / GIB)


def metadata_memory(n: Column, fixed: bool = False) -> Column:
    """Gibibytes of metadata: 0.001 a row, or one kilobyte a row with ``fixed``."""
    return n * F.lit(1024 / GIB if fixed else 0.001)


def loading_strategy(need: Column, available: Column) -> Column:
    return F.when(need * 1.5 < available * 0.5, "small").when(need < available * 2, "medium").otherwise("large")


def batch_size(most: Column) -> Column:
    """The largest power of two that isn't over ``most``, 1 at least."""
    return F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(most, F.lit(1)).cast("double")))).cast("long")
