"""Matrices of features by samples, kept long: one row for each feature and sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ranks import medians
from strandline.sources.storage import Latest, materialize


def to_long(df: DataFrame, ids: list[str], columns: list[str], name: str = "sample", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def to_wide(df: DataFrame, row: str, column: str, values: list[str], value: str = "value") -> DataFrame:
    """One column for each of the given values."""
    return df.groupBy(row).pivot(column, values).agg(F.first(value, ignorenulls=True))


def per_million(df: DataFrame) -> DataFrame:
    """``cpm``: value over the sample's total, times a million; the totals are one row for each sample."""
    totals = df.groupBy("sample").agg(F.sum("value").alias("_total"))
    return df.join(totals, "sample").withColumn("cpm", F.col("value") * 1e6 / F.col("_total")).drop("_total")


def row_medians(df: DataFrame, value: str = "cpm") -> DataFrame:
    """The exact median of each feature; a feature of any number of samples is dealt by ranges."""
    return medians(df, ["feature"], value, "median")


def above_median(df: DataFrame, least: float, value: str = "cpm") -> DataFrame:
    """Rows of features whose median reaches the least."""
    kept = row_medians(df, value).filter(F.col("median") >= least).select("feature")
    return df.join(kept, "feature", "left_semi")


def _with_samples(df: DataFrame, matrix: DataFrame) -> DataFrame:
    """Adds ``_samples``, the number of the matrix's samples."""
    return df.join(F.broadcast(matrix.agg(F.count_distinct("sample").alias("_samples"))))  # one row


def observed_share(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Features seen in at least a share of all samples, with the share."""
    seen = _with_samples(df.groupBy("feature").agg(F.count("value").alias("_n")), df)
    return seen.select("feature", (F.col("_n") / F.col("_samples")).alias("share")).filter(F.col("share") >= least)


def summed(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def stacked(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """Matrices of several batches or rounds under each other, with prefixed sample names: what an outer join of wide ones holds."""
    return reduce(DataFrame.unionByName, (df.withColumns({label: F.lit(name), "sample": F.concat(F.lit(f"{name}."), F.col("sample"))}) for name, df in parts.items()))


def aligned(matrix: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both cut down to the samples that both have."""
    return matrix.join(samples.select("sample").distinct(), "sample", "left_semi"), samples.join(matrix.select("sample").distinct(), "sample", "left_semi")


def group_intervals(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, standard error and the 1.96-fold interval."""
    sem = F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), sem.alias("sem"), (F.avg(value) - 1.96 * sem).alias("lower"), (F.avg(value) + 1.96 * sem).alias("upper"))


def filled(df: DataFrame, fills: dict[str, Column]) -> DataFrame:
    """Nulls and non-finite numbers become an aggregate of the finite ones; ``<column>_missing`` says where."""
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in fills}
    clean = df.withColumns(finite)
    whole = clean.agg(*(how.alias(f"_{c}") for c, how in fills.items()))
    out = clean.crossJoin(F.broadcast(whole))  # one row
    marked = out.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in fills})
    return marked.withColumns({c: F.coalesce(c, f"_{c}") for c in fills}).drop(*(f"_{c}" for c in fills))


def varying(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows of features that vary; a feature with one value, or none, doesn't."""
    kept = df.groupBy("feature").agg(F.var_samp(value).alias("_v")).filter(F.col("_v") > 0).select("feature")
    return df.join(kept, "feature", "left_semi")


def size_factors(df: DataFrame) -> DataFrame:
    """Median of ratios: for each sample the median, over features with counts in all samples, of the count over the feature's geometric mean."""
    logs = df.filter(F.col("value") > 0).withColumn("_log", F.ln("value"))
    means = logs.groupBy("feature").agg(F.count("*").alias("_n"), F.avg("_log").alias("_mean"))
    means = _with_samples(means, df).filter(F.col("_n") == F.col("_samples")).select("feature", "_mean")
    ratios = logs.join(means, "feature").select("sample", (F.col("_log") - F.col("_mean")).alias("_ratio"))
    return medians(ratios, ["sample"], "_ratio", "_median").select("sample", F.exp("_median").alias("size_factor"))


def base_means(df: DataFrame, factors: DataFrame) -> DataFrame:
    """Mean normalised count of each feature over all samples; an absent count is zero."""
    sums = df.join(factors, "sample").groupBy("feature").agg(F.sum(F.col("value") / F.col("size_factor")).alias("_sum"))
    return _with_samples(sums, df).select("feature", (F.col("_sum") / F.col("_samples")).alias("base_mean"))


def top_rows(df: DataFrame, by: Column, n: int) -> DataFrame:
    return df.orderBy(by, "feature").limit(n)


def centred(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn("centred", F.col(value) - F.avg(value).over(Window.partitionBy("feature")))


def median_polish(df: DataFrame, batches: DataFrame, reference: Column, most_passes: int = 25, close: float = 1e-4) -> DataFrame:
    """Two-way median polish across batches: ``feature``, ``sample``, ``value`` (log2, normalised) without the reference samples.

    Values become log2 ratios to the median of their batch's reference samples; then, in turn, the median of each feature in each batch and
    the median of each sample are taken out, until no median moves by more than ``close``. A sample is one row of its features' numbers and values, so
    that its median needs no shuffle; a batch's medians are one array by number, which all its samples meet. Each pass shuffles the values once, and is
    stored in place of the one before, so that lost executors cost one pass.
    """
    names = df.select("feature").distinct().agg(F.array_sort(F.collect_set("feature")).alias("_names"))  # one row
    numbers = materialize(names.select(F.posexplode("_names").alias("_at", "feature")), "features")
    cells = df.filter(F.col("value") > 0).join(F.broadcast(numbers), "feature").groupBy("sample").agg(F.collect_list(F.struct("_at", F.log2("value").alias("value"))).alias("_cells"))
    rows = cells.join(batches.select("sample", "batch", reference.alias("is_reference")).filter("batch is not null"), "sample")
    stored, levels = Latest("polish"), Latest("levels")
    rows = stored.put(rows)

    def by_feature(rows: DataFrame) -> DataFrame:
        """For each batch the medians of all features, by number; null for those without values."""
        found = rows.select("batch", F.inline("_cells")).groupBy("batch", "_at").agg(F.median("value").alias("_m"))
        grid = rows.select("batch").distinct().join(F.broadcast(numbers.select("_at")))
        listed = grid.join(found, ["batch", "_at"], "left").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_at", "_m"))).alias("_f"))
        return levels.put(listed.select("batch", F.transform("_f", lambda f: f["_m"]).alias("_f")))

    less = lambda c, m: F.struct(c["_at"].alias("_at"), (c["value"] - m).alias("value"))
    without = rows.join(F.broadcast(by_feature(rows.filter("is_reference"))), "batch").withColumn("_cells", F.transform("_cells", lambda c: less(c, F.get("_f", c["_at"]))))
    rows = stored.put(without.withColumn("_cells", F.filter("_cells", lambda c: c["value"].isNotNull())).filter(F.size("_cells") > 0).drop("_f"))
    middle = lambda i: F.get("_sorted", F.floor(i).cast("int"))
    for _ in range(most_passes):
        step = rows.join(F.broadcast(by_feature(rows)), "batch").withColumn("_cells", F.transform("_cells", lambda c: less(c, F.get("_f", c["_at"]))))
        step = step.withColumn("_sorted", F.array_sort(F.transform("_cells", lambda c: c["value"])))
        low, high = middle((F.size("_sorted") - 1) / 2), middle(F.size("_sorted") / 2)
        step = step.withColumn("_s", low + (high - low) / 2).withColumn("_cells", F.transform("_cells", lambda c: less(c, F.col("_s"))))
        moved = F.greatest(F.array_max(F.transform("_f", F.abs)), F.abs("_s")).alias("_moved")
        rows = stored.put(step.select("sample", "batch", "is_reference", "_cells", moved))
        moved = rows.agg(F.max("_moved")).first()[0]
        rows = rows.drop("_moved")
        if moved is None or moved <= close:
            break
    named = rows.filter(~F.col("is_reference")).select("sample", F.inline("_cells")).join(F.broadcast(numbers), "_at")
    return named.select("feature", "sample", "value")
