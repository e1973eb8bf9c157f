"""Firth-penalised logistic regression of one predictor, for all bins at once.

Every Newton step is one aggregation: tasks add up the sufficient statistics of all bins, and expressions turn them into
the next coefficients, one row per bin in a written table. Bins that can't be fitted don't hold up the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenframe.functions.numeric import chi2_1df_p, expit
from burdenframe.plans.workspace import stored

MAX_ITER = 100
TOLERANCE = 1e-8
MAX_HALVINGS = 25
MAX_STEP = 5.0
MIN_PER_SIDE = 5


def _statistics(data: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Sufficient statistics of every bin at its coefficients."""
    z, eta, p = F.col("z"), F.col("_eta"), F.col("_p")
    w = p * (1 - p)
    softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))  # log(1 + exp(eta)) without overflow
    n, tilt = F.col("n"), F.col("n") * w * (0.5 - p)
    sums = {
        "ll": F.sum(n * (F.col("y") * eta - softplus)),
        "w0": F.sum(n * w), "w1": F.sum(n * w * z), "w2": F.sum(n * w * z * z),
        "r0": F.sum(n * (F.col("y") - p)), "r1": F.sum(n * (F.col("y") - p) * z),
        "s0": F.sum(tilt), "s1": F.sum(tilt * z), "s2": F.sum(tilt * z * z), "s3": F.sum(tilt * z * z * z),
    }
    at = data.join(F.broadcast(coefficients.select("bin", "b0", "b1")), "bin").withColumn("_eta", F.col("b0") + F.col("b1") * z)
    return at.withColumn("_p", expit(eta)).groupBy("bin").agg(*[c.alias(k) for k, c in sums.items()])


def _advance(state: DataFrame, stats: DataFrame) -> DataFrame:
    """One step of every open bin: Newton's direction of the penalised score, cut to ``MAX_STEP`` per coefficient, or half of the
    last step back if that made the likelihood worse."""
    c = F.col
    rows = state.join(stats, "bin").withColumn("_det", c("w0") * c("w2") - c("w1") * c("w1"))
    rows = rows.withColumn("_good", (c("_det") > 0) & ~F.isnan("_det"))
    inverse = {"_a": "w2", "_b": "w1", "_c": "w0"}
    rows = rows.withColumns({k: F.when(c("_good"), (-c(v) if k == "_b" else c(v)) / c("_det")) for k, v in inverse.items()})
    rows = rows.withColumns({
        "_now": F.when(c("_good"), c("ll") + 0.5 * F.log("_det")),
        "_u0": c("r0") + c("_a") * c("s0") + 2 * c("_b") * c("s1") + c("_c") * c("s2"),
        "_u1": c("r1") + c("_a") * c("s1") + 2 * c("_b") * c("s2") + c("_c") * c("s3"),
    })
    rows = rows.withColumns({"_s0": c("_a") * c("_u0") + c("_b") * c("_u1"), "_s1": c("_b") * c("_u0") + c("_c") * c("_u1")})
    size = F.greatest(F.abs("_s0"), F.abs("_s1"))
    worse = c("_good") & c("loglik").isNotNull() & (c("_now") < c("loglik") - 1e-10 * F.abs("loglik"))
    rows = rows.withColumns({
        "_scale": F.greatest(F.lit(1.0), size / MAX_STEP), "_small": size < TOLERANCE, "_worse": worse & (c("halvings") < MAX_HALVINGS),
        "_stuck": worse & (c("halvings") >= MAX_HALVINGS)})
    reason = F.when(~c("_good"), "degenerate").when(c("_stuck"), "no better step")

    def pick(halved: Column, stepped: Column) -> Column:
        return F.when(c("_worse"), halved).otherwise(stepped)

    step = {f"step{i}": pick(c(f"step{i}") / 2, c(f"_s{i}") / c("_scale")) for i in "01"}
    rows = rows.select("*", reason.alias("_reason"), *[v.alias(f"_{k}") for k, v in step.items()])
    move = {f"b{i}": F.when(c("_reason").isNotNull() | (~c("_worse") & c("_small")), c(f"b{i}")).otherwise(
        pick(c(f"b{i}") - c(f"_step{i}"), c(f"b{i}") + c(f"_step{i}"))).alias(f"b{i}") for i in "01"}
    return rows.select(
        "bin", move["b0"], move["b1"], pick(c("loglik"), c("_now")).alias("loglik"), c("_step0").alias("step0"), c("_step1").alias("step1"),
        pick(c("halvings") + 1, F.lit(0)).alias("halvings"), pick(c("se"), F.sqrt(c("_c"))).alias("se"),
        (c("n_iter") + 1).alias("n_iter"), (c("_reason").isNull() & ~c("_worse") & c("_small")).alias("converged"), c("_reason").alias("reason"),
    )


def _fit(data: DataFrame, bins: DataFrame) -> DataFrame:
    zero = {k: F.lit(0.0) for k in ("b0", "b1", "step0", "step1")}
    nothing = F.lit(None).cast("double")
    opened = bins.select("bin").withColumns({
        **zero, "loglik": nothing, "halvings": F.lit(0), "se": nothing, "n_iter": F.lit(0), "converged": F.lit(False),
        "reason": F.lit(None).cast("string")})
    opened = stored(opened, "firth")
    done = None
    for _ in range(MAX_ITER):
        state = stored(_advance(opened, _statistics(data, opened)), "firth")
        ended = F.col("converged") | F.col("reason").isNotNull()
        done = state.filter(ended) if done is None else done.union(state.filter(ended))
        opened = state.filter(~ended)
        if opened.isEmpty():
            return done
    return done.union(opened.withColumn("reason", F.lit("iterations")))


def _fit_constrained(data: DataFrame) -> DataFrame:
    """Penalised likelihood with the slope held at zero and the penalty of the full design.

    With slope zero every row has the same probability, so for a centred and scaled predictor the
    information is ``p(1-p)`` times ``diag(n, n)`` and the score in the intercept has the closed form
    ``sum(y) - n p + (1 - 2p)``; its root is ``p = (sum(y) + 1) / (n + 2)``.
    """
    sizes = data.groupBy("bin").agg(
        F.sum(F.col("n") * F.col("y")).alias("ones"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("z")).alias("z1"), F.sum(F.col("n") * F.col("z") * F.col("z")).alias("z2"),
    )
    p = (F.col("ones") + 1.0) / (F.col("n") + 2.0)
    det = F.pow(p * (1 - p), F.lit(2.0)) * (F.col("n") * F.col("z2") - F.col("z1") * F.col("z1"))
    loglik = F.col("ones") * F.log(p) + (F.col("n") - F.col("ones")) * F.log(1 - p)
    kept = (F.col("ones") >= MIN_PER_SIDE) & (F.col("n") - F.col("ones") >= MIN_PER_SIDE)
    return sizes.filter(kept).select("bin", F.when(det > 0, loglik + 0.5 * F.log(det)).alias("null_loglik"))


def _scaled(folded: DataFrame) -> DataFrame:
    """The folded rows with the predictor standardised as by ``resample.standardise``: each counts ``n`` times."""
    n, x = F.col("n"), F.col("x")
    mean = F.when(F.min("x") == F.max("x"), F.min("x")).otherwise(F.sum(n * x) / F.sum(n))  # exact where x is constant
    means = folded.groupBy("bin").agg(mean.alias("_mean"))
    off = folded.join(F.broadcast(means), "bin").withColumn("_off", x - F.col("_mean"))
    spread = off.groupBy("bin").agg(F.sqrt(F.sum(n * F.col("_off") * F.col("_off")) / F.sum(n)).alias("_sd"))
    return off.join(F.broadcast(spread), "bin").select("bin", "y", "n", (F.col("_off") / F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))).alias("z"))


def firth_by_bin(labelled: DataFrame) -> DataFrame:
    """Fit ``bin, y, x`` rows per bin on the standardised predictor.

    Gives log odds, standard error, p of the penalised likelihood-ratio test, odds ratio, change in
    probability and the 95 % interval on the log2 scale, and ``converged``, ``n_iter`` and ``reason``. A bin that can't be fitted, such as
    one with a constant predictor, has nulls and a reason; one that didn't converge has its last values and a reason. Bins with fewer than five
    rows on a side are left out. Equal rows are folded into one with their number first; rows and coefficients are written between steps, so a lost executor costs a re-read.
    """
    folded = stored(labelled.groupBy("bin", "y", "x").agg(F.count(F.lit(1)).alias("n")), "folded")
    data = stored(_scaled(folded), "scaled")
    null = stored(_fit_constrained(data), "null")
    fitted = _fit(data, null).join(null, "bin")
    lost = F.col("reason") == "degenerate"
    lr = 2 * (F.col("loglik") - F.col("null_loglik"))
    table = fitted.select(
        "bin", F.when(lost, None).otherwise(F.col("b1")).alias("log_odds"), "se", lr.alias("lr"), "converged", "n_iter", "reason")
    log2_se = F.col("se") / math.log(2.0)
    return (
        table.withColumns(
            {
                "pval": F.when(F.col("lr").isNotNull(), chi2_1df_p(F.col("lr"))),
                "odds_ratio": F.exp("log_odds"),
                "prob_change": expit(F.col("log_odds")) - 0.5,
                "log2_or": F.col("log_odds") / math.log(2.0),
            }
        )
        .withColumns(
            {
                "ci_lower_log2": F.col("log2_or") - 1.96 * log2_se,
                "ci_upper_log2": F.col("log2_or") + 1.96 * log2_se,
            }
        )
        .drop("lr")
    )
