"""Per-feature tests over long matrices: sufficient statistics in one shuffle, closed forms after it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.distributions import p_from_f, p_from_range, p_from_t, p_from_z, range_critical
from strandline.functions.predicates import pinned
from strandline.operators import fits
from strandline.sources.storage import materialize

#: Most features whose covariance (32 MB) the driver may hold; the products that replace it cost a job each.
COVARIANCE_FEATURES = 2000
#: Most levels of a factor, and the features of a count test that one row names.
MOST_LEVELS, LISTED_FEATURES = 100, 1000


def _moments(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(F.col("value").isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"))


def t_test(df: DataFrame, first: str, second: str, with_p: bool = True) -> DataFrame:
    """Two groups, equal variances: ``estimate`` (mean of the first less the second's), ``t``, ``df``, ``p``; null where nothing varies or a group is empty."""
    of = lambda g, what: F.max(F.when(F.col("grp") == g, F.col(what)))
    wide = _moments(df.filter(F.col("grp").isin(first, second)), ["feature", "grp"]).groupBy("feature").agg(*(of(g, w).alias(f"{w}{i}") for i, g in ((1, first), (2, second)) for w in ("n", "mean", "var")))
    free = F.col("n1") + F.col("n2") - 2
    pooled = F.when(free > 0, ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / free)
    estimate = F.col("mean1") - F.col("mean2")
    t = F.when(pooled > 0, estimate / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    out = wide.select("feature", estimate.alias("estimate"), t.alias("t"), free.alias("df"))
    return out.withColumn("p", p_from_t(F.col("t"), F.col("df"))) if with_p else out


def anova(df: DataFrame, with_p: bool = True) -> DataFrame:
    """One-way analysis of variance: ``groups``, ``n``, ``ss_between``, ``ss_within``, ``f``, ``p``."""
    g = _moments(df, ["feature", "grp"])
    total, grand = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - total * grand * grand
    out = g.groupBy("feature").agg(F.count("*").alias("groups"), total.alias("n"), between.alias("ss_between"), F.sum((F.col("n") - 1) * F.col("var")).alias("ss_within"))
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = F.when((d1 > 0) & (d2 > 0) & (F.col("ss_within") > 0), (F.col("ss_between") / d1) / (F.col("ss_within") / d2))
    out = out.withColumn("f", f)
    return out.withColumn("p", p_from_f(F.col("f"), d1, d2)) if with_p else out


def tukey(df: DataFrame, level: float = 0.95) -> DataFrame:
    """All pairs of groups of each feature: ``difference`` (second less first), its simultaneous interval ``lower`` to ``upper``, ``q``, ``df`` and the studentised-range ``p``.

    Figures but the difference are null where nothing varies inside groups or no degree of freedom is left.
    """
    g = _moments(df, ["feature", "grp"])
    whole = g.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum((F.col("n") - 1) * F.col("var")).alias("ssw"))
    side = lambda i: g.select("feature", F.col("grp").alias(f"g{i}"), F.col("n").alias(f"n{i}"), F.col("mean").alias(f"m{i}"))
    pairs = side(1).join(side(2), "feature").filter("g1 < g2").join(whole, "feature")
    free, difference = F.col("total") - F.col("k"), F.col("m2") - F.col("m1")
    ms = F.when((free > 0) & (F.col("ssw") > 0), F.col("ssw") / free)
    error = F.sqrt(ms / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    out = pairs.select("feature", F.concat_ws("-", "g2", "g1").alias("comparison"), difference.alias("difference"), error.alias("_error"), (F.abs(difference) / error).alias("q"), "k", free.alias("df"))
    reach = range_critical(F.lit(1 - level), F.col("k"), F.col("df")) * F.col("_error")
    out = out.withColumn("_reach", reach).withColumns({"lower": F.col("difference") - F.col("_reach"), "upper": F.col("difference") + F.col("_reach")})
    return out.withColumn("p", p_from_range(F.col("q"), F.col("k"), F.col("df"))).drop("k", "_error", "_reach")


def adjusted(df: DataFrame, p: str = "p", name: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg adjustment: the least of p times n over rank among p-values as large; null stays null.

    Different p-values are counted first, so that a common one is a row like any other; they are dealt by ranges and stored. A range's
    ranks continue those of the ranges before, and its running minimum starts from the least of the ranges after it; both come from one
    row for each range, so that no task sees all p-values. The figures are joined back by p.
    """
    counted = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    ranged = materialize(counted.repartitionByRange("_p").sortWithinPartitions("_p").withColumn("_part", F.spark_partition_id()), "adjust")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(F.sum("_n").alias("_m"))
    offsets = parts.select("_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(F.lit(0))).alias("_all"))
    # equal p-values have the rank of the last of them
    rank = F.col("_before") + F.sum("_n").over(Window.partitionBy("_part").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.join(F.broadcast(offsets), "_part").withColumn("_raw", F.col("_p") * F.col("_all") / rank)
    after = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    later = placed.groupBy("_part").agg(F.min("_raw").alias("_least")).select("_part", F.coalesce(F.min("_least").over(after), F.lit(1.0)).alias("_later"))
    down = Window.partitionBy("_part").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    done = placed.join(F.broadcast(later), "_part").select("_p", F.least(F.min("_raw").over(down), F.col("_later"), F.lit(1.0)).alias("_q"))
    return df.join(done, F.col(p) == F.col("_p"), "left").withColumn(name, F.col("_q")).select(*[c for c in df.columns if c != name], name)


def paired_values(matrix: DataFrame, pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """For each pair and sample both values and the group: ``smorf_id``, ``main_id``, ``sample``, ``grp``, ``x`` (main), ``y`` (smORF)."""
    y = matrix.select(F.col("feature").alias("smorf_id"), "sample", F.col("value").alias("y"))
    x = matrix.select(F.col("feature").alias("main_id"), "sample", F.col("value").alias("x"))
    return pairs.join(y, "smorf_id").join(x, ["main_id", "sample"]).join(samples.select("sample", "grp"), "sample")


def _sums(values: DataFrame, groups: tuple[str, str]) -> DataFrame:
    """Counts, means and centred sums of each pair within both groups (suffixes 1 and 2) and overall."""
    both = values.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("grp").isin(*groups))
    by_group = []
    for i, g in enumerate(groups, 1):
        at = F.col("grp") == g
        of = lambda c: F.when(at, c)  # noqa: E731, B023
        x, y, n = of(F.col("x")), of(F.col("y")), F.count_if(at)
        by_group += [
            n.alias(f"n{i}"), F.avg(x).alias(f"x{i}"), F.avg(y).alias(f"y{i}"), (F.var_pop(x) * n).alias(f"sxx{i}"), (F.var_pop(y) * n).alias(f"syy{i}"), (F.covar_pop(x, y) * n).alias(f"sxy{i}"), correlation(x, y).alias(f"r{i}"),
        ]
    n = F.count("*")
    return both.groupBy("smorf_id", "main_id").agg(*by_group, n.alias("n"), (F.var_pop("x") * n).alias("sxx"), (F.var_pop("y") * n).alias("syy"), (F.covar_pop("x", "y") * n).alias("sxy"))


def _known(r: Column) -> Column:
    return r.isNotNull() & ~F.isnan(r)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows that have both; null, not an error, where one doesn't vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def coexpression(values: DataFrame, groups: tuple[str, str], apart: float = 0.1) -> DataFrame:
    """Correlation of each pair in both groups, their difference, and whether the pair is coupled; pairs with under 3 values or without a correlation go."""
    s = _sums(values, groups).filter((F.col("n1") >= 3) & (F.col("n2") >= 3) & _known(F.col("r1")) & _known(F.col("r2")))
    delta = F.col("r2") - F.col("r1")
    return s.select("smorf_id", "main_id", F.col("r1").alias("r_group1"), F.col("r2").alias("r_group2"), delta.alias("delta_r"), F.when(F.abs(delta) > apart, "non_coupled").otherwise("coupled").alias("route"))


def fisher_z(r1: Column, r2: Column, n1: Column, n2: Column) -> Column:
    """z of the difference of two independent correlations; null for perfect ones and for groups of 3."""
    turned = lambda r: 0.5 * F.ln(F.try_divide(1 + r, 1 - r))
    one = F.lit(1.0)
    return F.abs(turned(r1) - turned(r2)) / F.sqrt(F.try_divide(one, n1 - 3) + F.try_divide(one, n2 - 3))


def nested_models(values: DataFrame, groups: tuple[str, str], with_p: bool = True) -> DataFrame:
    """Additive and interaction terms of group in y ~ x: F, estimate and standard error of each, from the sums."""
    s = _sums(values, groups).filter((F.col("n1") >= 3) & (F.col("n2") >= 3) & _known(F.col("r1")) & _known(F.col("r2")))
    c = F.col
    within_x, within_xy, within_y = c("sxx1") + c("sxx2"), c("sxy1") + c("sxy2"), c("syy1") + c("syy2")
    b = within_xy / within_x
    rss_null = c("syy") - c("sxy") * c("sxy") / c("sxx")
    rss_add = within_y - within_xy * within_xy / within_x
    rss_int = (c("syy1") - c("sxy1") * c("sxy1") / c("sxx1")) + (c("syy2") - c("sxy2") * c("sxy2") / c("sxx2"))
    gap = c("x2") - c("x1")
    d_add, d_int = c("n") - 3, c("n") - 4
    out = s.select(
        "smorf_id", "main_id", "n", "n1", "n2", "r1", "r2",
        F.when(rss_add > 0, (rss_null - rss_add) / (rss_add / d_add)).alias("add_f"),
        F.when((d_int > 0) & (rss_int > 0), (rss_add - rss_int) / (rss_int / d_int)).alias("int_f"),
        ((c("y2") - c("y1")) - b * gap).alias("add_b"), F.sqrt(rss_add / d_add * (1 / c("n1") + 1 / c("n2") + gap * gap / within_x)).alias("add_se"),
        (c("sxy2") / c("sxx2") - c("sxy1") / c("sxx1")).alias("int_b"), F.when(d_int > 0, F.sqrt(rss_int / d_int * (1 / c("sxx1") + 1 / c("sxx2")))).alias("int_se"),
        fisher_z(c("r1"), c("r2"), c("n1"), c("n2")).alias("fisher_z"),
    )
    if not with_p:
        return out
    one = F.lit(1.0)
    positive = lambda f: F.when(c(f).isNotNull(), F.greatest(c(f), F.lit(0.0)))
    return out.withColumns({"add_p": p_from_f(positive("add_f"), one, c("n") - 3), "int_p": p_from_f(positive("int_f"), one, c("n") - 4), "fisher_p": p_from_z(c("fisher_z"))})


def correlated_with(matrix: DataFrame, target: str) -> DataFrame:
    """Correlation of every other feature with one, over the samples that both have; strongest first."""
    wanted = matrix.filter(F.col("feature") == target).select("sample", F.col("value").alias("_t"))
    r = matrix.filter(F.col("feature") != target).join(wanted, "sample").groupBy("feature").agg(correlation(F.col("value"), F.col("_t")).alias("correlation"))
    return r.filter(_known(F.col("correlation"))).withColumn("abs_corr", F.abs("correlation")).orderBy(F.desc("abs_corr"), "feature")


def outlying_samples(matrix: DataFrame, components: int = 5, limit: float = 3.0) -> DataFrame:
    """Principal components of scaled features over samples; ``outlier`` if the z-score of the first or second is beyond the limit.

    Missing and non-finite values become their feature's mean; features that don't vary go. A sample's features are one vector. Up to
    COVARIANCE_FEATURES features the driver gets their covariance; for more it holds single vectors only, and the components come from
    distributed products with the samples' vectors. A component's largest loading is positive; components beyond the features or the rank are null.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    finite = matrix.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value")))
    stats = finite.groupBy("feature").agg(F.avg("value").alias("_mean"), F.var_samp("value").alias("_var")).filter(F.col("_var") > 0)
    # a sample's known values become one map, and the features' means, one row of a bounded number of them, fill in the others
    held = finite.join(stats.select("feature"), "feature").filter("value is not null").groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("_held"))
    means = stats.agg(F.array_sort(F.collect_list(F.struct("feature", "_mean"))).alias("_means"))
    full = finite.select("sample").distinct().join(held, "sample", "left").join(F.broadcast(means))
    filled = F.transform("_means", lambda m: F.coalesce(F.col("_held")[m["feature"]], m["_mean"]))
    vectors = materialize(full.select("sample", array_to_vector(filled).alias("raw"), F.size("_means").alias("width")), "vectors")
    first = vectors.select("width").first()
    width, found = first[0] if first else 0, []
    scaled = vectors.withColumn("scaled", F.lit(None))
    if width:
        scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(vectors).transform(vectors)
        scaled = materialize(scaled.select("sample", "scaled"), "scaled")
        if width <= COVARIANCE_FEATURES:
            found = PCA(k=min(components, width), inputCol="scaled", outputCol="pc").fit(scaled).pc.toArray().T
        else:
            rows = MLUtils.convertVectorColumnsFromML(scaled.select("scaled"), "scaled").persist()  # read again for each product
            found = RowMatrix(rows).computeSVD(components).V.toArray().T
            rows.unpersist()
        found = [(v * np.sign(v[np.abs(v).argmax()])).tolist() for v in found]
    loadings = matrix.sparkSession.createDataFrame([(found,)], "loadings array<array<double>>")  # a row of as many numbers as features times components
    values = vector_to_array("scaled") if width else F.array().cast("array<double>")
    dot = lambda v: F.aggregate(F.zip_with("values", v, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    scores = scaled.select("sample", values.alias("values")).join(F.broadcast(loadings)).select("sample", F.transform("loadings", dot).alias("pc"))
    scores = scores.select("sample", *(F.get("pc", F.lit(i)).alias(f"pc{i + 1}") for i in range(components)))
    spread = scores.agg(*(f(f"pc{i}").alias(f"{n}{i}") for i in (1, 2) for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    z = [F.abs(F.try_divide(F.col(f"pc{i}") - F.col(f"m{i}"), F.col(f"s{i}"))) for i in (1, 2)]
    out = scores.join(F.broadcast(spread))  # one row
    return out.select("sample", *(f"pc{i + 1}" for i in range(components)), F.coalesce((z[0] > limit) | (z[1] > limit), F.lit(False)).alias("outlier"))


def regressed(df: DataFrame, covariates: list[str], group: str, remove: list[str], boots: int = 5, seed: int = 1) -> DataFrame:
    """Takes covariate effects out of each feature: medians of the coefficients of least-squares fits to seeded Poisson bootstrap samples.

    df has ``feature``, ``sample``, ``value``, the covariates and the group. How often a row is drawn is a hash of seed, feature, sample and draw, so
    that all draws of all features are one aggregation and the same for any partitioning. Rows with a null in value or a covariate enter
    no fit; a null group is none of the levels. The effects are stored, a row for each feature.
    """
    levels = [r[0] for r in df.select(group).dropna().distinct().orderBy(group).limit(MOST_LEVELS + 1).collect()]
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"{group} has more than {MOST_LEVELS} levels")
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in covariates), *(F.coalesce((F.col(group) == g).cast("double"), F.lit(0.0)) for g in levels[1:])]
    known = df.dropna(subset=["value", *covariates]).withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(boots))))
    drawn = pinned(known, {"_hash": fits.poisson_hash(F.lit(seed), F.col("feature"), F.col("sample"), F.col("_draw"))})  # one digest for each row and draw
    drawn = drawn.withColumn("_weight", fits.poisson_weight(F.col("_hash"))).filter("_weight > 0")
    sums = drawn.groupBy("feature", "_draw").agg(*fits.cross_products(x, F.col("value"), F.col("_weight")))
    effects = sums.select("feature", fits.solved()("_gram", "_side").alias("_beta"))
    at = {c: 1 + covariates.index(c) for c in remove}
    effects = effects.groupBy("feature").agg(*(F.median(F.get("_beta", F.lit(i))).alias(f"_e_{c}") for c, i in at.items()))  # a row for each draw
    effects = materialize(effects, "effects")
    out = df.join(effects, "feature", "left")
    return out.select("feature", "sample", (F.col("value") - sum((F.col(c) * F.col(f"_e_{c}") for c in remove), F.lit(0.0))).alias("value"))


def without_effects(df: DataFrame, samples: DataFrame, nuisance: list[str], keep: list[str]) -> DataFrame:
    """Takes nuisance effects out of each feature by one linear fit, over the samples it has, that also has the columns to keep.

    Samples with a null in a column go, and null values. All features' normal equations are one aggregation; where a feature's samples don't
    determine the effects, those of least norm are taken out.
    """
    design = samples.select("sample", *(F.col(c).cast("double").alias(c) for c in (*nuisance, *keep))).dropna()
    rows, names = df.select("feature", "sample", "value").dropna(subset=["value"]).join(design, "sample"), [*nuisance, *keep]
    means = rows.groupBy("feature").agg(*(F.avg(c).alias(f"_m_{c}") for c in names), F.avg("value").alias("_m"))
    centred = rows.join(means, "feature").withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in names})
    sums = centred.groupBy("feature").agg(*fits.cross_products([F.col(c) for c in names], F.col("value") - F.col("_m"), F.lit(1.0)))
    effects = sums.select("feature", fits.solved()("_gram", "_side").alias("_beta"))
    effect = sum((F.col(c) * F.get("_beta", F.lit(i)) for i, c in enumerate(nuisance)), F.lit(0.0))
    return centred.join(effects, "feature").select("feature", "sample", (F.col("value") - effect).alias("value"))


def count_design(factors: DataFrame, samples: DataFrame, covariates: list[str], group: str, first: str, second: str) -> DataFrame:
    """The samples of two groups with all covariates and a size factor: ``sample``, the group, the covariates, ``size_factor``."""
    return samples.filter(F.col(group).isin(first, second)).select("sample", group, *covariates).dropna().join(factors, "sample")


def _trigamma(x: Column) -> Column:
    """By recurrence up to 6 and more, and the asymptotic series there."""
    far = x + 6
    return sum((1 / ((x + k) * (x + k)) for k in range(6)), 1 / far + 1 / (2 * far**2) + 1 / (6 * far**3) - 1 / (30 * far**5))


def dispersions(df: DataFrame, design: DataFrame, coefficients: int = 2) -> DataFrame:
    """``feature``, ``base_mean``, ``dispersion`` (moments of the normalised counts), ``trend`` (fitted over the features) and ``moderated``.

    A sample without a row counts 0; a dispersion is at least 1e-8. The moderated one is the normal posterior of its logarithm about the trend's: the sampling
    variance is that of the logarithm of a variance with as many degrees of freedom as the fit leaves, the prior variance is what the features'
    residuals vary beyond it, at least 0.25. Features more than two standard deviations above the trend keep their own.
    """
    norm = F.col("value") / F.col("size_factor")
    sums = df.join(design.select("sample", "size_factor"), "sample").groupBy("feature").agg(F.sum(norm).alias("_s1"), F.sum(norm * norm).alias("_s2"))
    size = design.agg(F.count("*").alias("_n"), F.avg(1 / F.col("size_factor")).alias("_inverse"))
    mean = F.col("_s1") / F.col("_n")
    var = F.when(F.col("_n") > 1, F.greatest(F.col("_s2") - F.col("_n") * mean * mean, F.lit(0.0)) / (F.col("_n") - 1)).otherwise(0.0)
    own = F.when(mean > 0, F.greatest((var - mean * F.col("_inverse")) / (mean * mean), F.lit(1e-8))).otherwise(1e-8)
    free = F.greatest(F.col("_n") - coefficients, F.lit(1)).cast("double")
    out = sums.join(F.broadcast(size)).select("feature", mean.alias("base_mean"), own.alias("dispersion"), _trigamma(free / 2).alias("_sampling"))  # one row
    out = materialize(out, "dispersions")
    trend = F.when(F.col("base_mean") > 0, F.col("a0") + F.col("a1") / F.col("base_mean"))
    out = out.join(F.broadcast(dispersion_trend(out))).withColumn("trend", trend).withColumn("_residual", F.ln("dispersion") - F.ln("trend"))  # one row
    spread = out.filter("dispersion > 1e-6").agg(F.coalesce(F.var_samp("_residual"), F.lit(0.0)).alias("_spread"))
    prior = F.greatest(F.col("_spread") - F.col("_sampling"), F.lit(0.25))
    weight = prior / (prior + F.col("_sampling"))
    drawn = F.exp(F.ln("trend") + weight * F.col("_residual"))
    moderated = F.when(F.col("_residual") > 2 * F.sqrt("_spread"), F.col("dispersion")).otherwise(F.coalesce(drawn, "dispersion"))
    return out.join(F.broadcast(spread)).select("feature", "base_mean", "dispersion", "trend", moderated.alias("moderated"))  # one row


def count_tests(df: DataFrame, factors: DataFrame, samples: DataFrame, covariates: list[str], group: str, first: str, second: str, steps: int = 50) -> DataFrame:
    """Negative-binomial Wald test of a group: ``base_mean``, ``log2fc``, ``se``, ``stat``, ``p``, ``dispersion``, ``converged``.

    The dispersion is the one moderated by the fitted trend (:func:`dispersions`); all features are fitted together, a step an aggregation
    (:func:`strandline.operators.fits.negative_binomial`), with the sizes as offset. A sample without a row counts 0: counts are as dense as features
    times samples. Figures of the test are null for features without counts or with no more samples than coefficients. Fold changes are
    not shrunk; there is no outlier replacement or independent filtering.
    """
    chosen = materialize(count_design(factors, samples, covariates, group, first, second), "design")
    known = dispersions(df, chosen, 2 + len(covariates)).select("feature", "base_mean", F.col("moderated").alias("dispersion"))
    features = df.select("feature").distinct().join(known, "feature", "left")
    features = materialize(features.select("feature", F.coalesce("base_mean", F.lit(0.0)).alias("base_mean"), F.coalesce("dispersion", F.lit(1e-8)).alias("dispersion")), "features")
    spread = chosen.agg(F.count("*").alias("_n"), *(f(c).alias(f"_{n}_{c}") for c in covariates for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in covariates}
    design = chosen.join(F.broadcast(spread)).withColumns({**scaled, "_one": F.lit(1.0), "_second": (F.col(group) == second).cast("double")})  # one row
    x = ["_one", *covariates, "_second"]
    tested = features.filter((F.col("base_mean") > 0) & F.lit(chosen.count() > len(x)))
    # every feature meets every sample: lists of features are stored, so that Spark sends them to the samples if they are small, and makes a product of both if not
    piece = F.pmod(F.xxhash64("feature"), F.lit(-(-tested.count() // LISTED_FEATURES) or 1))
    listed = materialize(tested.groupBy(piece.alias("_piece")).agg(F.collect_list("feature").alias("_features")).select("_features"), "listed")
    dealt = design.select("sample", F.col("size_factor").alias("size"), *x).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grid = dealt.crossJoin(listed).withColumn("feature", F.explode("_features")).drop("_features")
    rows = grid.join(df.select("feature", "sample", "value"), ["feature", "sample"], "left").withColumn("y", F.coalesce("value", F.lit(0.0)))
    fitted = fits.negative_binomial(rows, tested.withColumnRenamed("base_mean", "mean"), x, steps)
    figures = fitted.select("feature", "converged", *(c.alias(k) for k, c in fits.wald(F.get("beta", F.lit(len(x) - 1)), F.col("factor")).items()))
    return features.join(figures, "feature", "left").select("feature", "base_mean", "log2fc", "se", "stat", "p", "dispersion", "converged")


def dispersion_trend(tested: DataFrame) -> DataFrame:
    """One row: ``a0``, ``a1`` of dispersion = a0 + a1 / mean, by least squares over features with a positive mean; nearly flat where the means are one."""
    good = tested.filter((F.col("base_mean") > 0) & F.col("dispersion").isNotNull()).withColumn("_x", 1 / F.col("base_mean"))
    slope = F.greatest(F.try_divide(F.covar_pop("_x", "dispersion"), F.var_pop("_x")), F.lit(1e-8))
    return good.agg(F.greatest(F.avg("dispersion") - slope * F.avg("_x"), F.lit(1e-4)).alias("a0"), slope.alias("a1"))


def stabilised(df: DataFrame, factors: DataFrame, trend: DataFrame) -> DataFrame:
    """Variance-stabilised values of the normalised counts, from the trend's closed form."""
    out = df.join(factors, "sample").join(F.broadcast(trend))  # one row
    q, a0, a1 = F.col("value") / F.col("size_factor"), F.col("a0"), F.col("a1")
    root = 2 * F.sqrt(a0 * q * (1 + a1 + a0 * q))
    return out.select("feature", "sample", F.log2((1 + a1 + 2 * a0 * q + root) / (4 * a0)).alias("value"))
