"""Tests of normality: Shapiro-Wilk, Kolmogorov-Smirnov, and the choice between them by the number of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import ordered, tails
from helixframe.operators.statistics import kolmogorov_p, normality

# Coefficients of the normal quantile in the middle, the outer and the far range, numerator and denominator.
MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
     21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
OUTER = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
     0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
     0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
# Polynomials in 1/sqrt(n) of the two outer weights; in n (4 to 11) and ln n (from 12 on) of mean and log spread.
LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
LAST_BUT_ONE = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_MEAN, SMALL_SPREAD = (0.5440, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN, LARGE_SPREAD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
SMALL_SHIFT = (-2.273, 0.459)

#: Ranks of equal values that one row sums up.
CHUNK = 4096


def polynomial(x: str, coefficients: Sequence[float]) -> str:
    """SQL text, from the highest power inwards."""
    out = f"CAST({coefficients[-1]!r} AS DOUBLE)"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def quantile_sql(q: str, t: str) -> str:
    """The standard normal quantile as SQL text, from q = p - 1/2 and t = sqrt(-ln(min(p, 1 - p)))."""
    ratio = lambda x, pair: f"{polynomial(x, pair[0])} / {polynomial(x, pair[1])}"
    return (f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(f'(0.180625 - {q} * {q})', MIDDLE)} WHEN {t} <= 5 THEN sign({q}) * {ratio(f'({t} - 1.6)', OUTER)} "
            f"ELSE sign({q}) * {ratio(f'({t} - 5)', FAR)} END")


def _scores(lo: str, hi: str, n: str) -> Column:
    """The expected order statistics of ranks lo to hi of n, as an array."""
    chances = f"transform(sequence({lo}, {hi}), i -> (i - 0.375D) / ({n} + 0.25D))"
    parts = f"transform({chances}, p -> struct(p - 0.5D AS q, sqrt(-ln(least(p, 1 - p))) AS t))"
    return F.expr(f"transform({parts}, x -> {quantile_sql('x.q', 'x.t')})")


def root_sql(n: str, top: str, second: str, squares: str, cross: str, gap: str, inner: str) -> str:
    """The weighted sum of the ordered values, whose square over the sum of squares is W, as SQL text.

    top and second are the expected values of the largest and the second largest, squares the sum of all their squares, cross
    that of their products with the values, gap and inner the distance of the outermost two values and of the next two.
    """
    u = f"(1 / sqrt({n}))"
    last = f"({top} / sqrt({squares}) + {polynomial(u, LAST)})"
    next_ = f"({second} / sqrt({squares}) + {polynomial(u, LAST_BUT_ONE)})"
    wide = f"(({squares} - 2 * {top} * {top} - 2 * {second} * {second}) / (1 - 2 * {last} * {last} - 2 * {next_} * {next_}))"
    narrow = f"(({squares} - 2 * {top} * {top}) / (1 - 2 * {last} * {last}))"
    six = f"(({cross} - {top} * {gap} - {second} * {inner}) / sqrt({wide}) + {last} * {gap} + {next_} * {inner})"
    four = f"(({cross} - {top} * {gap}) / sqrt({narrow}) + {last} * {gap})"
    return f"CASE WHEN {n} > 5 THEN {six} WHEN {n} > 3 THEN {four} ELSE {gap} * sqrt(0.5) END"


def z_sql(n: str, w: str) -> str:
    """The normal deviate of W for four values or more, as SQL text."""
    log = f"ln({n})"
    small = f"((-ln({polynomial(n, SMALL_SHIFT)} - ln(1 - {w})) - {polynomial(n, SMALL_MEAN)}) / exp({polynomial(n, SMALL_SPREAD)}))"
    large = f"((ln(1 - {w}) - {polynomial(log, LARGE_MEAN)}) / exp({polynomial(log, LARGE_SPREAD)}))"
    return f"CASE WHEN {n} < 12 THEN {small} ELSE {large} END"


def shapiro_wilk(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, w, p), null for fewer than three values or without spread.

    Ranks come from value ranges, so a group may hold any number of rows; equal values share the sum of their
    weights, which is added up in chunks of ranks. Null and NaN values do not count.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    size = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("_n"), F.avg("_v").alias("_mean"))
    places = ordered.tie_counts(rows, keys, "_v")
    placed = places.join(size, keys) if keys else places.crossJoin(F.broadcast(size))  # without keys, size is one row
    chunks = placed.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(ties - 1) div {CHUNK}"))))
    lo = F.col("upto") - F.col("ties") + F.col("_chunk") * CHUNK + 1
    chunks = chunks.withColumn("_lo", lo).withColumn("_hi", F.least(lo + CHUNK - 1, F.col("upto"))).repartition(*keys, "_v", "_chunk")
    chunks = chunks.withColumn("_m", _scores("_lo", "_hi", "_n"))
    total = F.aggregate("_m", F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate("_m", F.lit(0.0), lambda a, x: a + x * x)
    at = lambda rank: F.max(F.when((F.col("_lo") <= rank) & (rank <= F.col("_hi")), F.col("_v")))
    score = lambda rank: F.max(F.when((F.col("_lo") <= rank) & (rank <= F.col("_hi")), F.get("_m", (rank - F.col("_lo")).cast("int"))))
    n = F.col("_n").cast("long")
    shifted = F.col("_v") - F.col("_mean")
    sums = chunks.groupBy(*keys).agg(
        F.max("_n").alias("n"), F.sum(squares).alias("m2"), F.sum(total * shifted).alias("mx"),
        F.sum((F.col("_hi") - F.col("_lo") + 1) * shifted * shifted).alias("ss"),
        score(n).alias("top"), score(n - 1).alias("second"), (F.max("_v") - F.min("_v")).alias("gap"), (at(n - 1) - at(F.lit(2))).alias("inner"))
    root = root_sql("n", "top", "second", "m2", "mx", "gap", "inner")
    usable = (F.col("n") >= 3) & (F.col("gap") > 0)
    found = sums.withColumn("_root", F.expr(root)).withColumn("w", F.when(usable, F.least(F.col("_root") * F.col("_root") / F.col("ss"), F.lit(1.0))))
    three = F.greatest(F.lit(6.0) / F.pi() * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75)))), F.lit(0.0))
    upper = tails.normal_cdf(-F.expr(z_sql("n", "least(w, 1 - 1e-15)")))
    return found.select(*keys, F.col("n").cast("long").alias("n"), "w", F.when(usable, F.when(F.col("n") == 3, three).otherwise(upper)).alias("p"))


def kolmogorov_smirnov(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, distance, p): the largest gap between the empirical and the standard normal distribution."""
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    size = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    places = ordered.tie_counts(rows, keys, "_v")
    at = (places.join(size, keys) if keys else places.crossJoin(F.broadcast(size))).withColumn("_cdf", tails.normal_cdf(F.col("_v")))
    gap = F.greatest(F.col("upto") / F.col("n") - F.col("_cdf"), F.col("_cdf") - (F.col("upto") - F.col("ties")) / F.col("n"))
    out = at.groupBy(*keys).agg(F.max("n").alias("n"), F.max(gap).alias("distance"))
    return out.withColumn("p", kolmogorov_p(F.col("distance"), F.col("n")))


# Numbers of values from which the second and the third test are taken.
SHAPIRO_FROM, KOLMOGOROV_FROM = 50, 300


def normality_by_size(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, test, p): the omnibus test for few values, then Shapiro-Wilk, and Kolmogorov-Smirnov for many."""
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = ordered.with_totals(df.filter(v.isNotNull() & ~F.isnan(v)).withColumn("_v", v), keys, _size=F.count("*"))
    few, some, many = (rows.filter(c) for c in (
        F.col("_size") < SHAPIRO_FROM, F.col("_size").between(SHAPIRO_FROM, KOLMOGOROV_FROM - 1), F.col("_size") >= KOLMOGOROV_FROM))
    parts = [(normality(few, keys, "_v"), "normalTest"), (shapiro_wilk(some, keys, "_v"), "shapiro"), (kolmogorov_smirnov(many, keys, "_v"), "kstest")]
    out = None
    for found, name in parts:
        part = found.select(*keys, "n", F.lit(name).alias("test"), "p")
        out = part if out is None else out.union(part)
    return out
