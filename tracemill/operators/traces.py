"""Shape attributes of intensity traces: window functions over points (trace, i, y) and one aggregate for each trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12
#: Width at half height of a Gaussian over its sigma; fixed value.
FWHM_PER_SIGMA = 2.35482


def by_place():
    """The window of a trace in order; made when it is needed, as that takes a session."""
    return Window.partitionBy("trace").orderBy("i")


def fisher(r: Column) -> Column:
    """Fisher's z of a correlation, clipped."""
    return F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r)))


def correlation(x: str, y: str) -> Column:
    """Pearson's r; null where one side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def smoothed(points: DataFrame) -> DataFrame:
    """Adds m, the moving average of three with zeros beyond the ends."""
    z = F.lit(0.0)
    return points.withColumn("m", (F.coalesce(F.lag("y").over(by_place()), z) + F.col("y") + F.coalesce(F.lead("y").over(by_place()), z)) / 3)


def _zigzag(total: Column, n: Column, most: Column, least: Column) -> Column:
    return F.log10(F.greatest(total / (n * F.greatest((most - least) ** 2, F.lit(EPS))), F.lit(EPS)))


def shape(points: DataFrame) -> DataFrame:
    """n, SNR, CV, TPAS, ZZ, DZZ, PCC, SKEW, DENT, DM, JAG of each trace, from one window pass and one aggregate. Values that are null, negative or not finite count as 0."""
    points = points.withColumn("y", F.when((F.col("y") > 0) & (F.col("y") < float("inf")) & ~F.isnan("y"), F.col("y")).otherwise(0.0))
    lag, lead = (lambda c, k=1: F.lag(c, k).over(by_place())), (lambda c: F.lead(c).over(by_place()))
    d = smoothed(points).select("trace", "y", "m", lag("y").alias("p"), lag("y", 2).alias("pp"), lead("y").alias("q"), lag("m").alias("mp"), lead("m").alias("mq"))
    step = F.col("y") - F.col("p")
    s = d.groupBy("trace").agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.max("y").alias("top"), F.min("y").alias("low"), F.sum("y").alias("total"),
        F.sum((2 * F.col("y") - F.col("p") - F.col("q")) ** 2).alias("zz"), F.max("m").alias("m_top"), F.min("m").alias("m_low"), F.sum((2 * F.col("m") - F.col("mp") - F.col("mq")) ** 2).alias("m_zz"),
        correlation("y", "m").alias("r"), F.stddev_pop("m").alias("m_std"), F.skewness("y").alias("g1"),
        F.sum(F.when(F.col("y") > 0, F.col("y") * F.log2("y")).otherwise(0.0)).alias("ylog"), F.avg(F.abs(step)).alias("move"),
        F.sum(F.abs(F.signum(step) - F.signum(F.col("p") - F.col("pp")))).alias("turns"),
    )
    n, top, zz = F.col("n"), F.col("top"), _zigzag(F.col("zz"), F.col("n"), F.col("top"), F.col("low"))
    return s.filter((n >= 3) & (top > 0)).select(
        "trace", "n",
        F.when(F.col("std") <= EPS, top).otherwise((top - F.col("mean")) / F.col("std")).alias("SNR"), F.try_divide(F.col("std"), F.col("mean")).alias("CV"),
        F.log10(F.greatest(0.5 * n * top / F.col("total"), F.lit(EPS))).alias("TPAS"), zz.alias("ZZ"), (zz - _zigzag(F.col("m_zz"), n, F.col("m_top"), F.col("m_low"))).alias("DZZ"),
        F.when((F.col("std") > EPS) & (F.col("m_std") > EPS), fisher(F.col("r"))).alias("PCC"), (F.col("g1") * F.sqrt(n * (n - 1.0)) / (n - 2)).alias("SKEW"),
        (F.log2("total") - F.col("ylog") / F.col("total")).alias("DENT"), (F.col("move") / F.col("mean")).alias("DM"), (F.col("turns") / n).alias("JAG"),
    )


def apexes(points: DataFrame) -> DataFrame:
    """trace, n, apex (first place of the greatest value), top."""
    return points.groupBy("trace").agg(F.count("*").alias("n"), F.max_by("i", F.struct("y", -F.col("i"))).alias("apex"), F.max("y").alias("top"))


def symmetry(points: DataFrame) -> DataFrame:
    """SYM: 1 minus the differences over the sums of the values at equal offsets from the apex, in [0, 1]."""
    d = points.join(apexes(points), "trace").withColumn("off", F.abs(F.col("i") - F.col("apex"))).filter("off > 0")
    pairs = d.groupBy("trace", "off").agg(F.count("*").alias("k"), (F.max("y") - F.min("y")).alias("diff"), F.sum("y").alias("both")).filter("k = 2")
    value = 1 - F.sum("diff") / F.sum("both")
    return pairs.groupBy("trace").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("SYM"))


def edges(points: DataFrame) -> DataFrame:
    """EDGE: the greater median of the first and last k values over the apex; k is a tenth of the points, 3 at least."""
    d = points.join(apexes(points), "trace").withColumn("k", F.least("n", F.greatest(F.lit(3), F.bround(0.1 * F.col("n")))))
    first, last = F.when(F.col("i") < F.col("k"), F.col("y")), F.when(F.col("i") >= F.col("n") - F.col("k"), F.col("y"))
    return d.groupBy("trace", "top").agg(F.median(first).alias("a"), F.median(last).alias("b")).filter("top > 0").select("trace", (F.greatest("a", "b") / F.col("top")).alias("EDGE"))


def widths(points: DataFrame, fraction: float = 0.5) -> DataFrame:
    """left, right (interpolated crossings of the fraction of the apex), strict and with the ends of the trace allowed."""
    d = points.withColumns({"next": F.lead("y").over(by_place()), "prev": F.lag("y").over(by_place())}).join(apexes(points), "trace").withColumn("level", fraction * F.col("top"))
    low = F.col("y") < F.col("level")
    at = F.struct("i", "y", "next", "prev")
    s = d.groupBy("trace", "n", "apex", "top", "level").agg(
        F.max_by(at, F.when(low & (F.col("i") < F.col("apex")), F.col("i"))).alias("l"), F.min_by(at, F.when(low & (F.col("i") > F.col("apex")), F.col("i"))).alias("r")
    )
    left = F.col("l.i") + (F.col("level") - F.col("l.y")) / (F.col("l.next") - F.col("l.y"))
    right = F.col("r.i") - (F.col("level") - F.col("r.y")) / (F.col("r.prev") - F.col("r.y"))
    return s.select(
        "trace", "n", "apex", "top", (right - left).alias("strict"), (F.coalesce(right, F.col("n") - 1.0) - F.coalesce(left, F.lit(0.0))).alias("width")
    )


def half_to_base(points: DataFrame) -> DataFrame:
    """H2B: width at half height over the span of the trace."""
    return widths(points).filter("n > 1").select("trace", (F.col("width") / (F.col("n") - 1)).alias("H2B"))


def gauss_similarity(points: DataFrame) -> DataFrame:
    """GS: Fisher's z of the correlation with a Gaussian at the apex of the width at half height."""
    sigma = F.greatest(F.coalesce(F.col("strict") / FWHM_PER_SIGMA, (F.col("n") - 1) / 6.0), F.lit(1e-6))
    d = points.join(widths(points).select("trace", "apex", sigma.alias("sigma")), "trace").withColumn("g", F.exp(-0.5 * ((F.col("i") - F.col("apex")) / F.col("sigma")) ** 2))
    s = d.groupBy("trace").agg(correlation("y", "g").alias("r"), F.stddev_pop("y").alias("a"), F.stddev_pop("g").alias("b"))
    return s.select("trace", F.when((F.col("a") > EPS) & (F.col("b") > EPS), fisher(F.col("r"))).alias("GS"))


def histogram_entropy(points: DataFrame, bins: int = 256) -> DataFrame:
    """ENT: entropy in bits of the values in equal bins over their range, the last bin closed; 0 for a flat trace."""
    s = points.groupBy("trace").agg(F.min("y").alias("low"), F.max("y").alias("top"), F.count("*").alias("n"))
    share = F.when(F.col("top") > F.col("low"), F.least(F.floor((F.col("y") - F.col("low")) / (F.col("top") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    c = points.join(s, "trace").groupBy("trace", "n", share.alias("bin")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("n")
    return c.groupBy("trace").agg(F.abs(F.sum(-p * F.log2(p))).alias("ENT"))


def robust_baseline(points: DataFrame) -> DataFrame:
    """baseline (median) and noise (1.4826 times the median absolute deviation)."""
    b = points.groupBy("trace").agg(F.median("y").alias("baseline"))
    return points.join(b, "trace").groupBy("trace", "baseline").agg((1.4826 * F.median(F.abs(F.col("y") - F.col("baseline")))).alias("noise"))


def local_maxima(points: DataFrame, height: float) -> DataFrame:
    """Number of points above a height that are greater than the one before and not less than the one after."""
    d = points.withColumns({"p": F.lag("y").over(by_place()), "q": F.lead("y").over(by_place())})
    return d.groupBy("trace").agg(F.count_if((F.col("y") > height) & (F.col("y") > F.col("p")) & (F.col("y") >= F.col("q"))).alias("n_maxima"))


def triangular(points: DataFrame, half: int = 2) -> DataFrame:
    """y smoothed with weights 1, 2 ... half + 1 ... 2, 1 and zeros beyond the ends."""
    weight = [half + 1 - abs(k) for k in range(-half, half + 1)]
    total = sum((w * F.coalesce(F.lag("y", -k).over(by_place()), F.lit(0.0)) for w, k in zip(weight, range(-half, half + 1), strict=True)), F.lit(0.0))
    return points.select("trace", "i", (total / sum(weight)).alias("y"))


def trimmed_baseline(points: DataFrame, share: float = 0.05) -> DataFrame:
    """Mean and deviation without the least and the greatest share of the points; median and scaled MAD under 8 points."""
    ranked = Window.partitionBy("trace").orderBy("y", "i")
    d = points.withColumns({"rank": F.row_number().over(ranked), "n": F.count("*").over(Window.partitionBy("trace"))})
    cut = F.floor(share * F.col("n"))
    inner = d.filter((F.col("rank") > cut) & (F.col("rank") <= F.col("n") - cut)).groupBy("trace", "n").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    few = robust_baseline(points)
    return inner.join(few, "trace").select("trace", F.when(F.col("n") < 8, F.col("baseline")).otherwise(F.col("m")).alias("baseline"), F.when(F.col("n") < 8, F.col("noise")).otherwise(F.col("s")).alias("noise"))


def derivatives(points: DataFrame, x: str = "i") -> DataFrame:
    """First derivative on an uneven grid: second order inside, one-sided at the ends."""
    d = points.withColumns({f"{s}{c}": (F.lag if s == "p" else F.lead)(c).over(by_place()) for s in "pq" for c in (x, "y")})
    h, k = F.col(x) - F.col(f"p{x}"), F.col(f"q{x}") - F.col(x)
    inner = (h * h * F.col("qy") + (k * k - h * h) * F.col("y") - k * k * F.col("py")) / (h * k * (h + k))
    return d.select("trace", "i", F.when(h.isNull(), (F.col("qy") - F.col("y")) / k).when(k.isNull(), (F.col("y") - F.col("py")) / h).otherwise(inner).alias("dy"))


def slopes(points: DataFrame) -> DataFrame:
    """trace, i, d1, d2: first and second derivative of y over x on a grid of any steps, of second order inside a trace, of first order at its ends."""
    def slope(d: DataFrame, y: str, name: str) -> DataFrame:
        before, after = F.col("x") - F.lag("x").over(by_place()), F.lead("x").over(by_place()) - F.col("x")
        rise, fall = F.lead(y).over(by_place()) - F.col(y), F.col(y) - F.lag(y).over(by_place())
        inner = (fall / before * after + rise / after * before) / (before + after)
        return d.withColumn(name, F.coalesce(inner, rise / after, fall / before, F.lit(0.0)))

    return slope(slope(points, "y", "d1"), "d1", "d2").select("trace", "i", "x", "y", "d1", "d2")


#: Greatest share of the maximum that still counts as noise, and the least noise; fixed values.
NOISE_SHARE, QUIET = 0.05, 1e-4


def noise_filters(points: DataFrame) -> DataFrame:
    """af, ff, sf of each trace: the median of what is at most a twentieth of the greatest step, slope, and change of slope; QUIET for fewer than five points, or where there is nothing."""
    d = slopes(points).withColumns({"d1": F.abs("d1"), "step": F.abs(F.lead("y").over(by_place()) - F.col("y"))})
    d = slopes(d.select("trace", "i", "x", F.col("d1").alias("y"))).select("trace", "i", F.abs("d1").alias("sf"), F.col("y").alias("ff")).join(d.select("trace", "i", F.col("step").alias("af")), ["trace", "i"])
    whole = {c: F.max(c).over(Window.partitionBy("trace")) for c in ("af", "ff", "sf")}
    d = d.withColumns({f"{c}_top": v for c, v in whole.items()})
    def picked(c: str) -> Column:
        m = F.median(F.when(F.col(c) <= NOISE_SHARE * F.col(f"{c}_top"), F.col(c)))
        m = F.coalesce(m, F.median(c))
        return F.when((F.count("*") < 5) | (F.max(c) <= 1e-12) | (m <= 1e-12), QUIET).otherwise(m).alias(c)

    return d.groupBy("trace").agg(*(picked(c) for c in ("af", "ff", "sf")))
