"""Statistics as aggregations: rank measures, calibration, risk and coverage, entropy, regression with rows left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.joins import null_safe_join
from trackloom.plans.ordered import prefix_sums


def average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Ranks from 1 with ties sharing their mean; ranks are found over the distinct values, whatever a key's size."""
    c = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    r = prefix_sums(c, keys, value, {"_upto": F.col("_c")}).select(*keys, value, (F.col("_upto") - F.col("_c") / 2 + 0.5).alias(out))
    return null_safe_join(df, r, [*keys, value])


def spearman(df: DataFrame, keys: list[str], a: str, b: str, *, least: int = 3) -> DataFrame:
    d = df.where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND NOT isnan({a}) AND NOT isnan({b})")
    d = average_rank(average_rank(d, keys, a, "_a"), keys, b, "_b")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("rho")).where(F.col("n") >= least)


def roc_auc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """(keys, auc): chance that a positive outscores a negative, ties half, from counts per score; null without both classes."""
    c = df.groupBy(*keys, score).agg(F.count(F.when(F.col(positive), 1)).alias("_p"), F.count(F.when(~F.col(positive), 1)).alias("_q"))
    c = prefix_sums(c, keys, score, {"_below": F.col("_q")})
    won = F.sum(F.col("_p") * (F.col("_below") - F.col("_q") / 2))
    return c.groupBy(*keys).agg(F.try_divide(won, F.sum("_p") * F.sum("_q")).alias("auc"))


def reliability(df: DataFrame, p: str, y: str, *, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, frac) over equal-width bins of the forecast."""
    b = F.greatest(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("frac"))


def calibration_error(rel: DataFrame) -> DataFrame:
    return rel.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("frac"))) / F.sum("n")).alias("ece"))


def rps(probs: list[str], outcome: str) -> Column:
    """Ranked probability score of ordered classes; ``outcome`` is the class's index."""
    total: Column = F.lit(0.0)
    cum: Column = F.lit(0.0)
    for k in range(len(probs) - 1):
        cum = cum + F.col(probs[k])
        total = total + (cum - (F.col(outcome) <= k).cast("double")) ** 2
    return total / (len(probs) - 1)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, z2 = k / n, z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)


def conformal_radius(df: DataFrame, keys: list[str], score: str, *, alpha: float = 0.1) -> DataFrame:
    """(keys, k): the ceil((n + 1)(1 - alpha))-th smallest score, infinite if there are too few."""
    c = df.groupBy(*keys, score).agg(F.count("*").alias("_c"))
    c = prefix_sums(c, keys, score, {"_upto": F.col("_c")})
    n = c.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    need = F.ceil((F.col("_n") + 1) * (1 - alpha))
    return null_safe_join(c, n, keys).groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_upto") >= need, F.col(score))), F.lit(float("inf"))).alias("k"))


def risk_coverage(df: DataFrame, keys: list[str], err: str, conf: str, *ties: str) -> DataFrame:
    """(keys, aurc, augrc): areas of selective and generalised risk, surest (smallest conf) rows first."""
    d = prefix_sums(df.select(*keys, err, conf, *ties), keys, conf, {"_s": F.col(err), "_k": F.lit(1)}, *ties)
    return d.groupBy(*keys).agg(F.avg(F.col("_s") / F.col("_k")).alias("aurc"), (F.sum("_s") / F.count("*") / F.count("*")).alias("augrc"))


def frontier(df: DataFrame, keys: list[str], conf: str, correct: str, *ties: str) -> DataFrame:
    """(keys, k, threshold, coverage, precision): answers by falling confidence, one row each."""
    d = prefix_sums(df.select(*keys, conf, correct, *ties), keys, conf, {"k": F.lit(1), "_ok": F.col(correct).cast("long")}, *ties, descending=True)
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return null_safe_join(d, n, keys).select(*keys, "k", F.col(conf).alias("threshold"), (F.col("k") / F.col("_n")).alias("coverage"), (F.col("_ok") / F.col("k")).alias("precision"))


def coverage_at(front: DataFrame, keys: list[str], floor: float) -> DataFrame:
    return front.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("precision") >= floor, F.col("coverage"))), F.lit(0.0)).alias("coverage"))


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, gini) of non-negative weights, from counts per weight; null where they sum to nothing."""
    c = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    c = prefix_sums(c, keys, value, {"_upto": F.col("_c")})
    # the mean rank of equal weights stands for each of them
    mean_rank = F.col("_upto") - (F.col("_c") - 1) / 2
    g = c.groupBy(*keys).agg(F.sum(F.col("_c") * F.col(value)).alias("_s"), F.sum("_c").alias("_n"), F.sum(mean_rank * F.col("_c") * F.col(value)).alias("_r"))
    return g.select(*keys, F.try_divide(2 * F.col("_r") - (F.col("_n") + 1) * F.col("_s"), F.col("_n") * F.col("_s")).alias("gini"))


def entropy(counts: DataFrame, keys: list[str], n: str, *, least: int = 1) -> DataFrame:
    """(keys, n, entropy) in bits of the distribution of counts under each key."""
    t = F.sum(n).over(Window.partitionBy(*keys))
    d = counts.withColumn("_t", t).where(F.col("_t") >= least).withColumn("_p", F.col(n) / F.col("_t"))
    return d.groupBy(*keys).agg(F.sum(n).alias("n"), (-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))


def js_distance(a: DataFrame, b: DataFrame, key: str, n: str) -> DataFrame:
    """(js): square root of the Jensen-Shannon divergence in bits of two tables of counts."""
    p = lambda df, c: df.select(key, (F.col(n) / F.sum(n).over(Window.partitionBy())).alias(c))
    j = p(a, "p").join(p(b, "q"), key, "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return j.agg(F.sqrt(F.greatest(F.sum(part("p") + part("q")) / 2, F.lit(0.0))).alias("js"))


def mean_without_self(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn(out, F.try_divide(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1))


def line_without_group(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, slope, intercept) of least-squares lines over all other groups, from sums; the mean where x does not vary."""
    s = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    w = Window.partitionBy()
    for c in ("n", "sx", "sy", "sxx", "sxy"):
        s = s.withColumn(f"_{c}", F.sum(c).over(w) - F.col(c))
    var = F.col("_sxx") - F.col("_sx") * F.col("_sx") / F.col("_n")
    slope = F.when(var > 1e-9, (F.col("_sxy") - F.col("_sx") * F.col("_sy") / F.col("_n")) / var).otherwise(0.0)
    return s.where("_n > 0").withColumn("slope", slope).select(group, "slope", ((F.col("_sy") - F.col("slope") * F.col("_sx")) / F.col("_n")).alias("intercept"))


def one_way(df: DataFrame, group: str, value: str) -> DataFrame:
    """(groups, n, between, within, f): one-way analysis of variance."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    ssb = F.col("q") - F.col("n") * F.col("mean") * F.col("mean")
    t = t.withColumn("between", ssb / (F.col("groups") - 1)).withColumn("within", F.col("ssw") / (F.col("n") - F.col("groups")))
    return t.select("groups", "n", "between", "within", (F.col("between") / F.col("within")).alias("f"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def poisson_weight(*columns: str | Column, steps: int = 14) -> Column:
    """A weight of mean one drawn by a hash; ``steps`` cover the whole resolution of the draw."""
    u = (F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) + 0.5) / (1 << 30)
    weight, cum, p = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(steps):
        cum += p
        weight = weight + (u > cum).cast("int")
        p /= k + 1
    return weight


def block_bootstrap(df: DataFrame, block: str, value: str, *, replicates: int = 200, seed: int = 1) -> DataFrame:
    """(replicate, mean): blocks drawn with replacement by Poisson weights from a hash, so every replicate is one aggregation."""
    b = df.groupBy(block).agg(F.sum(value).alias("s"), F.count(value).alias("n")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return b.withColumn("w", poisson_weight(F.lit(seed), block, "replicate")).groupBy("replicate").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("mean"))


def discordant(df: DataFrame, base: str, arm: str) -> DataFrame:
    """(helped, hurt, both, neither) of two boolean columns."""
    n = lambda a, b: F.count(F.when(F.col(base).eqNullSafe(a) & F.col(arm).eqNullSafe(b), 1))
    return df.agg(n(False, True).alias("helped"), n(True, False).alias("hurt"), n(True, True).alias("both"), n(False, False).alias("neither"))


def signed_rank(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, w_plus, z, helped, hurt) of paired differences b - a by the signed-rank test; equal pairs count for nothing."""
    d = df.select(*keys, (F.col(b) - F.col(a)).alias("_d")).where("_d <> 0").withColumn("_m", F.abs("_d"))
    r = average_rank(d, keys, "_m", "_r")
    n = F.count("*")
    g = r.groupBy(*keys).agg(n.alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.count(F.when(F.col("_d") > 0, 1)).alias("helped"), F.count(F.when(F.col("_d") < 0, 1)).alias("hurt"))
    # whole numbers of more than 1.6 million pairs would overflow
    d = F.col("n").cast("double")
    mean, var = d * (d + 1) / 4, d * (d + 1) * (2 * d + 1) / 24
    return g.select(*keys, "n", "w_plus", F.try_divide(F.col("w_plus") - mean, F.sqrt(var)).alias("z"), "helped", "hurt")


def half_widths(df: DataFrame, bucket: str, resid: str, *, floor: float, least: int = 20) -> DataFrame:
    """(bucket, n, width): half the spread between the 5th and 95th percentile of buckets with enough residuals, not below the floor."""
    q = F.percentile(resid, F.array(F.lit(0.05), F.lit(0.95)))
    return df.groupBy(bucket).agg(F.count(resid).alias("n"), F.greatest((q[1] - q[0]) / 2, F.lit(floor)).alias("width")).where(F.col("n") >= least)


def coverage_table(df: DataFrame, bucket: str, resid: str, widths: DataFrame, *, k: float) -> DataFrame:
    """(bucket, radius, covered): share of residuals within k half widths."""
    j = df.join(widths.select(bucket, "width"), bucket)
    return j.groupBy(bucket).agg((F.first("width") * k).alias("radius"), F.avg((F.abs(resid) <= F.col("width") * k).cast("double")).alias("covered"))


def team_map(matched: DataFrame) -> DataFrame:
    """(identity, flipped, mapping): which of two ways to map teams agrees with more rows (pred_team 0/1, team 1/2)."""
    same = F.count(F.when(F.col("pred_team") + 1 == F.col("team"), 1))
    turned = F.count(F.when(2 - F.col("pred_team") == F.col("team"), 1))
    return matched.where("pred_team IN (0, 1)").agg(same.alias("identity"), turned.alias("flipped")).withColumn("mapping", F.when(F.col("identity") >= F.col("flipped"), "identity").otherwise("flipped"))


def first_unskilled(errors: DataFrame, bucket: str, ours: str, bar: str, block: str, *, replicates: int = 200, level: float = 0.95, seed: int = 1) -> DataFrame:
    """(bucket, gain, upper) of the first bucket whose bootstrap upper bound of our error minus the bar's is not below zero; no row if all are."""
    d = errors.withColumn("_g", F.col(ours) - F.col(bar))
    b = d.groupBy(bucket, block).agg(F.sum("_g").alias("s"), F.count("*").alias("n")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    m = b.withColumn("w", poisson_weight(F.lit(seed), block, "r")).groupBy(bucket, "r").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    up = m.groupBy(bucket).agg(F.percentile("m", level).alias("upper"), F.avg("m").alias("gain")).where("upper >= 0")
    return up.agg(F.min(F.struct(F.col(bucket).alias("bucket"), "gain", "upper")).alias("x")).where("x IS NOT NULL").select("x.*")
