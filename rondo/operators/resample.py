"""Resampling statistics on pre-aggregated blocks.

Draws are integer arithmetic on (iteration, draw), so a run can be repeated anywhere. Data is reduced to one row per
block (or block start) before it meets the draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import with_one_row
from ..session import dimension, persist_table
from .slices import MOST, Unit, drop_halo, halo_window, running, with_halo

_M = 2147483647  # modulus of the multiplicative generator


def draw(iteration: Column, number: Column, n: Column, seed: int | Column) -> Column:
    """Uniform index in 0..n-1 for a draw of an iteration."""
    x = (iteration.cast("bigint") * 1000003 + number.cast("bigint") * 7919 + seed + 1) % _M
    x = (x * 48271) % _M
    x = (x * 16807 + 12345) % _M
    return x % n


TASK_DRAWS = 2_000_000  # draws that a task makes, and so the most counts it holds


def _chunked(df: DataFrame, count: Column, name: str, chunk: int = 100_000, tasks: int | None = None) -> DataFrame:
    """Explode 0..count-1 in two steps, so that no row carries a long array. ``tasks``: deal the chunks out to so many tasks between the steps."""
    df = df.withColumn("_cnt", count.cast("bigint")).filter(F.col("_cnt") > 0)
    df = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_cnt") - 1) / chunk))))
    if tasks:
        df = df.repartition(tasks, *df.columns)  # a set number: few small rows that become many must not be put together again
    last = F.least((F.col("_chunk") + 1) * chunk, F.col("_cnt")) - 1
    return df.withColumn(name, F.explode(F.sequence(F.col("_chunk") * chunk, last))).drop("_cnt", "_chunk")


def summarise(boot: DataFrame, keys: list[str] = (), value: str = "value", level: float = 0.95) -> DataFrame:
    """Mean, deviation, interval, median and share <= 0 of the iterations (one row each)."""
    a = (1 - level) / 2
    return boot.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, a).alias("ci_lower"), F.percentile(value, 1 - a).alias("ci_upper"),
        F.percentile(value, 0.5).alias("median"), F.avg(F.when(F.col(value) <= 0, 1.0).otherwise(0.0)).alias("p_le_zero"))


def block_bootstrap(df: DataFrame, block: str, numerator: Column, denominator: Column | None = None, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """Resample whole blocks with replacement; the metric is sum(numerator) / sum(denominator). One row.

    Blocks are windows or periods: their number follows the calendar, not the rows.
    """
    blocks = df.groupBy(block).agg(F.sum(numerator).alias("_a"), F.sum(F.lit(1.0) if denominator is None else denominator).alias("_b"))
    blocks = blocks.withColumn("_i", (F.row_number().over(Window.orderBy(block)) - 1).cast("bigint"))
    size = blocks.agg(F.count(F.lit(1)).alias("_n"))
    its = with_one_row(df.sparkSession.range(iterations).withColumnRenamed("id", "iteration"), size)
    draws = _chunked(its, F.col("_n"), "_j").select("iteration", draw(F.col("iteration"), F.col("_j"), F.col("_n"), seed).alias("_i"))
    boot = draws.join(blocks, "_i").groupBy("iteration").agg((F.sum("_a") / F.sum("_b")).alias("value"))
    return summarise(boot)


CELL = 1024  # starts that are drawn from together
CELL_SEED = 104729


def moving_block_bootstrap(df: DataFrame, keys: list[str], order: list[str], value: str, length: int, iterations: int = 1000, seed: int = 0, unit: Unit = MOST) -> DataFrame:
    """Mean of a series under resampling of overlapping blocks of ``length`` rows; one row per key.

    Every start gets its block sum from one bounded window; a sample is n // length starts, drawn in two steps. Draw j of an iteration picks a cell of ``CELL`` neighbouring
    starts with a chance in proportion to its starts; of these draws only the count per (iteration, cell) is kept, combined before the shuffle. Then each cell,
    one row with its sums and its counts, makes that many draws among its own starts and gives one sum per iteration. Draws never meet starts in a join.
    Iterations are dealt out to a task per ``TASK_DRAWS`` draws, whatever their own few bytes suggest.
    """
    rows = df.select(*keys, *order, F.col(value).cast("double").alias("_x"))
    haloed = with_halo(rows, keys, order, length - 1, unit)
    frame = halo_window(keys, order).rowsBetween(-(length - 1), 0)
    sums = drop_halo(haloed.withColumns({"_s": F.sum("_x").over(frame), "_c": F.count("_x").over(frame)}))
    placed = running(sums, keys, order, {"_pos": F.lit(1).cast("bigint")}, unit)
    at = F.col("_pos") - (length - 1)
    starts = placed.filter(F.col("_c") == length).select(*keys, F.floor(at / CELL).alias("_cell"), F.struct((at % CELL).alias("i"), F.col("_s").alias("s")).alias("_e"))
    cells = starts.groupBy(*keys, "_cell").agg(F.sort_array(F.collect_list("_e"))["s"].alias("_sums"))  # CELL numbers a row
    sizes = persist_table(rows.groupBy(*keys).agg(F.count("_x").alias("_n"), F.avg("_x").alias("original")))
    its = sizes.filter(F.col("_n") >= length).withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    picked = F.floor(draw(F.col("iteration"), F.col("_j"), F.col("_n") - length + 1, seed) / CELL)
    samples = F.floor(F.col("_n") / length)
    total = (sizes.filter(F.col("_n") >= length).agg(F.sum(samples)).first()[0] or 0) * iterations
    draws = _chunked(its, samples, "_j", tasks=-(-total // TASK_DRAWS) or 1).select(*keys, "iteration", picked.alias("_cell"))
    counts = draws.groupBy(*keys, "_cell", "iteration").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    vectors = counts.groupBy(*keys, "_cell").agg(F.collect_list(F.struct("iteration", "_times")).alias("_counts"))  # one number per iteration

    def drawn(c: Column) -> Column:
        index = lambda k: draw(c["iteration"], k, F.size("_sums"), F.lit(seed) + (F.col("_cell") + 1) * CELL_SEED)
        total = F.aggregate(F.sequence(F.lit(0), c["_times"] - 1), F.lit(0.0), lambda acc, k: acc + F.get(F.col("_sums"), index(k).cast("int")))
        return F.struct(c["iteration"].alias("iteration"), total.alias("s"), c["_times"].alias("times"))

    per_cell = cells.join(vectors, [*keys, "_cell"]).select(*keys, F.explode(F.transform("_counts", drawn)).alias("_d"))
    boot = per_cell.groupBy(*keys, F.col("_d.iteration").alias("iteration")).agg((F.sum("_d.s") / (F.sum("_d.times") * length)).alias("value"))
    return summarise(boot, keys).join(dimension(sizes.select(*keys, "original")), list(keys))


def acceptance(df: DataFrame) -> DataFrame:
    """Acceptance tests of a feature as rows (feature, test, metric, status).

    Needs columns feature, brier_improvement, logloss_improvement, slope, ks_p, n_periods, ci_low.
    """
    tests = [
        ("brier_improvement", F.col("brier_improvement"), F.col("brier_improvement") >= 0.005),
        ("logloss_improvement", F.col("logloss_improvement"), F.col("logloss_improvement") >= 0.01),
        ("calibration_slope", F.col("slope"), F.col("slope").between(0.95, 1.05)),
        ("temporal_stability", F.col("ks_p"), F.col("ks_p") > 0.05),
        ("bootstrap_ci", F.col("ci_low"), F.col("ci_low") > 0),
    ]
    entries = [F.struct(F.lit(n).alias("test"), m.cast("double").alias("metric"),
                        (F.when(F.col("n_periods") < 2, "INSUFFICIENT_DATA") if n == "temporal_stability" else F.when(F.lit(False), "")).when(ok, "PASSED").otherwise("FAILED").alias("status"))
               for n, m, ok in tests]
    return df.select("feature", F.explode(F.array(*entries)).alias("t")).select("feature", "t.*")


def acceptance_summary(results: DataFrame) -> DataFrame:
    """Counts by status and pass rate; one row."""
    n = F.count(F.lit(1))
    return results.agg(n.alias("total_tests"), F.count_if(F.col("status") == "PASSED").alias("passed"), F.count_if(F.col("status") == "FAILED").alias("failed"),
                       F.count_if(F.col("status") == "INSUFFICIENT_DATA").alias("insufficient"), (F.count_if(F.col("status") == "PASSED") / n).alias("pass_rate"))
