"""The sixteen peak attributes of feature tables, in one plan.

Points (feature, x, y) are shuffled once, by feature: every window and the one aggregate behind them need the same
partitioning, so Spark adds no other exchange. Rows of a feature are bounded by the scans of its window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import ranking
from .range_join import dense
from .traces import EPS, FWHM_PER_SIGMA, correlation, fisher

#: In the order of the tables that hold them; fixed values.
ATTRIBUTES = ("SNR", "CV", "GS", "TPAS", "H2B", "ZZ", "DZZ", "PCC", "SKEW", "DENT", "DM", "ENT", "JAG", "SYM", "MOD", "EDGE")
BINS = 256


def _crossing(x1: Column, y1: Column, x2: Column, y2: Column, level: Column) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (level - y1) / (y2 - y1)))
    return F.when(F.abs(y2 - y1) < EPS, (x1 + x2) / 2).otherwise(x1 + share * (x2 - x1))


def _secondary(m: Column, apex: Column) -> Column:
    """Greatest prominence of a local maximum of the array more than two places from the apex; plateaus count at their middle.

    The base on a side is the least value before the array rises above the maximum.
    """
    n = F.size(m)
    side = lambda part, top: F.aggregate(part, F.struct(top.alias("low"), F.lit(False).alias("done")), lambda s, v: F.when(s["done"] | (v > top), F.struct(s["low"].alias("low"), F.lit(True).alias("done"))).otherwise(F.struct(F.least(s["low"], v).alias("low"), F.lit(False).alias("done"))))["low"]
    # where the plateau that begins at k ends: the first later place of another value
    end = lambda v, k: k + F.aggregate(F.slice(m, k + 1, n), F.struct(F.lit(0).alias("k"), F.lit(False).alias("done")), lambda s, u: F.when(s["done"] | (u != v), F.struct(s["k"].alias("k"), F.lit(True).alias("done"))).otherwise(F.struct((s["k"] + 1).alias("k"), F.lit(False).alias("done"))))["k"]

    def prominence(v: Column, k: Column) -> Column:
        after = end(v, k)
        far = F.abs(F.floor((k + after - 1) / 2) - apex) > 2
        return F.when((after < n) & (F.get(m, after.cast("int")) < v) & far, v - F.greatest(side(F.reverse(F.slice(m, 1, k)), v), side(F.slice(m, after + 1, n), v))).otherwise(0.0)

    rises = F.filter(F.transform(m, lambda v, k: F.struct(v.alias("v"), k.alias("k"))), lambda s: (s["k"] > 0) & (F.get(m, s["k"] - 1) < s["v"]))
    return F.coalesce(F.array_max(F.transform(rises, lambda s: prominence(s["v"], s["k"]))), F.lit(0.0))


def attributes(points: DataFrame, apex: Column | None = None) -> DataFrame:
    """feature and the sixteen attributes; all null for features without a positive value.

    Values that are null, negative or not finite count as 0. The apex is the first greatest value, unless `apex` gives its place
    (an expression of the columns feature, i, x, y). Attributes that need three points, a spread or a width are null
    without them.
    """
    by = Window.partitionBy("feature")
    line, all_ = by.orderBy("x"), by
    y = F.when((F.col("y") > 0) & (F.col("y") < float("inf")) & ~F.isnan("y"), F.col("y")).otherwise(0.0)
    lag, lead = (lambda c, k=1: F.lag(c, k).over(line)), (lambda c, k=1: F.lead(c, k).over(line))
    d = points.select("feature", F.col("x").cast("double").alias("x"), y.cast("double").alias("y"))
    d = d.withColumns({"i": F.row_number().over(line) - 1, "n": F.count("*").over(all_), "top": F.max("y").over(all_), "least": F.min("y").over(all_)})
    d = d.withColumns({"apex": apex if apex is not None else F.min(F.when(F.col("y") == F.col("top"), F.col("i"))).over(all_), "m": (F.coalesce(lag("y"), F.lit(0.0)) + F.col("y") + F.coalesce(lead("y"), F.lit(0.0))) / 3})
    at = lambda c, place: F.max(F.when(F.col("i") == place, F.col(c))).over(all_)
    d = d.withColumns({"high": at("y", F.col("apex")), "mu": at("x", F.col("apex")), "p": lag("y"), "pp": lag("y", 2), "q": lead("y"), "mp": lag("m"), "mq": lead("m")})
    low = F.col("y") < 0.5 * F.col("high")
    d = d.withColumns({
        "l": F.coalesce(F.max(F.when(low & (F.col("i") < F.col("apex")), F.col("i"))).over(all_), F.lit(0)),
        "r": F.coalesce(F.min(F.when(low & (F.col("i") > F.col("apex")), F.col("i"))).over(all_), F.col("n") - 1),
    })
    ends = {f"{c}{k}": at(c, F.col(side) + step) for c in "xy" for k, side, step in (("l1", "l", 0), ("l2", "l", 1), ("r1", "r", -1), ("r2", "r", 0))}
    d = d.withColumns({**ends, "x0": F.min("x").over(all_), "x9": F.max("x").over(all_)})
    half = 0.5 * F.col("high")
    left = _crossing(F.col("xl1"), F.col("yl1"), F.col("xl2"), F.col("yl2"), half)
    right = _crossing(F.col("xr1"), F.col("yr1"), F.col("xr2"), F.col("yr2"), half)
    inside = (F.col("apex") > 0) & (F.col("apex") < F.col("n") - 1)
    # at an end of the window that is still high, the strict width goes on along the last step, the other one stops there
    strict = F.when(inside, F.greatest(right - left, F.lit(0.0)))
    wide_left = F.when((F.col("apex") == 0) | (F.col("yl1") >= half), F.col("x0")).otherwise(left)
    wide_right = F.when((F.col("apex") == F.col("n") - 1) | (F.col("yr2") >= half), F.col("x9")).otherwise(right)
    d = d.withColumns({"sigma": F.greatest(F.coalesce(strict / FWHM_PER_SIGMA, (F.col("x9") - F.col("x0")) / 6), F.lit(1e-6)), "wide": wide_right - wide_left})
    off = F.abs(F.col("i") - F.col("apex"))
    pair, bins = Window.partitionBy("feature", "off"), Window.partitionBy("feature", "bin")
    share = F.when(F.col("top") > F.col("least"), F.least(F.floor((F.col("y") - F.col("least")) / (F.col("top") - F.col("least")) * BINS), F.lit(BINS - 1))).otherwise(0)
    d = d.withColumns({"off": off, "bin": share, "g": F.exp(-0.5 * ((F.col("x") - F.col("mu")) / F.col("sigma")) ** 2)})
    d = d.withColumns({"in_bin": F.count("*").over(bins), "k": F.count("*").over(pair), "apart": F.max("y").over(pair) - F.min("y").over(pair)})
    edge = F.least(F.col("n"), F.greatest(F.lit(3), F.bround(0.1 * F.col("n"))))
    both = (F.col("k") == 2) & (F.col("off") > 0)
    step = F.col("y") - F.col("p")
    zigzag = lambda total, top, least: F.log10(F.greatest(total / (F.col("n") * F.greatest((top - least) ** 2, F.lit(EPS))), F.lit(EPS)))
    s = d.groupBy("feature").agg(
        *(F.first(c).alias(c) for c in ("n", "top", "least", "apex", "high", "wide", "x0", "x9")), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.sum("y").alias("total"),
        F.sum((2 * F.col("y") - F.col("p") - F.col("q")) ** 2).alias("zz"), F.max("m").alias("m_top"), F.min("m").alias("m_least"), F.sum((2 * F.col("m") - F.col("mp") - F.col("mq")) ** 2).alias("m_zz"),
        correlation("y", "m").alias("r_m"), F.stddev_pop("m").alias("m_std"), correlation("y", "g").alias("r_g"), F.stddev_pop("g").alias("g_std"), F.skewness("y").alias("g1"),
        F.sum(F.when(F.col("y") > 0, F.col("y") * F.log2("y")).otherwise(0.0)).alias("ylog"), F.avg(F.abs(step)).alias("move"), F.sum(F.abs(F.signum(step) - F.signum(F.col("p") - F.col("pp")))).alias("turns"),
        F.sum(-F.log2(F.col("in_bin") / F.col("n")) / F.col("n")).alias("entropy"), F.sum(F.when(both, F.col("apart"))).alias("apart"), F.sum(F.when(both, F.col("y"))).alias("sides"),
        F.median(F.when(F.col("i") < edge, F.col("y"))).alias("first"), F.median(F.when(F.col("i") >= F.col("n") - edge, F.col("y"))).alias("last"),
        F.max(F.when(F.col("i") == F.col("apex"), F.col("m"))).alias("m_high"), F.sort_array(F.collect_list(F.struct("i", "m"))).alias("ms"),
    )
    n, high, spread = F.col("n"), F.col("high"), F.col("std") > EPS
    zz = zigzag(F.col("zz"), F.col("top"), F.col("least"))
    z0 = zigzag(F.col("zz"), high, F.col("least"))
    apart, sides = F.coalesce("apart", F.lit(0.0)) / 2 / (high + EPS), F.coalesce("sides", F.lit(0.0)) / (high + EPS)
    value = {
        "SNR": F.when(spread, (high - F.col("mean")) / F.col("std")).otherwise(high), "CV": F.when(F.col("mean") > EPS, F.col("std") / F.col("mean")),
        "GS": F.when(spread & (F.col("g_std") > EPS), fisher(F.col("r_g"))), "TPAS": F.log10(F.greatest(0.5 * n * high / F.col("total"), F.lit(EPS))),
        "H2B": F.when(F.col("x9") - F.col("x0") > EPS, F.col("wide") / (F.col("x9") - F.col("x0"))), "ZZ": z0 if apex is not None else zz,
        "DZZ": (z0 if apex is not None else zz) - zigzag(F.col("m_zz"), F.col("m_top"), F.col("m_least")),
        "PCC": F.when(spread & (F.col("m_std") > EPS), fisher(F.col("r_m"))), "SKEW": F.col("g1") * F.sqrt(n * (n - 1.0)) / (n - 2),
        "DENT": F.log2("total") - F.col("ylog") / F.col("total"), "DM": F.when(F.col("mean") > EPS, F.col("move") / F.col("mean")),
        "ENT": F.when(F.col("top") > F.col("least"), F.abs(F.col("entropy"))).otherwise(0.0), "JAG": F.col("turns") / n,
    }
    three = (n >= 3) & (high > 0)
    rest = {
        "SYM": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / (sides + EPS))),
        "MOD": F.least(F.lit(1.0), _secondary(F.transform("ms", lambda e: e["m"]), F.col("apex")) / (F.col("m_high") + EPS)),
        "EDGE": F.greatest("first", "last") / (high + EPS),
    }
    return s.select("feature", *(F.when(three, v).alias(c) for c, v in value.items()), *(F.when(high > 0, v).alias(c) for c, v in rest.items()))


def windows(features: DataFrame, tolerance: float) -> DataFrame:
    """features (mz, RT, RTmin, RTmax) with lo and hi: the bounds, in either order, where both are finite, else RT -+ tolerance.
    Rows without m/z or RT go."""
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in ("mz", "RT", "RTmin", "RTmax")}
    ok = lambda c: F.coalesce(F.abs(number[c]) < float("inf"), F.lit(False))
    both = ok("RTmin") & ok("RTmax")
    d = features.filter(number["mz"].isNotNull() & number["RT"].isNotNull())
    return d.withColumns({"lo": F.when(both, F.least("RTmin", "RTmax")).otherwise(F.col("RT") - tolerance), "hi": F.when(both, F.greatest("RTmin", "RTmax")).otherwise(F.col("RT") + tolerance)})


def peak_attributes(features: DataFrame, peaks: DataFrame, width: float = 5.0, method: str = "window_sum") -> DataFrame:
    """The attributes of each row of a feature table (feature, source, mz, tol, lo, hi), from its scans' window sums or, with
    method nearest, from the peak of each scan that is nearest to its m/z.

    Rows without m/z or window are dropped; rows without a scan in the window keep null attributes.
    """
    asked = features.filter(F.col("mz").isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull())
    points = dense(asked, peaks, width, method).select("feature", F.col("scan").alias("x"), F.col("intensity").alias("y"))
    return attach(asked.select("feature", "source", "mz"), attributes(points), "feature")


def univariate(rows: DataFrame, label: str, names: list[str]) -> DataFrame:
    """attribute, raw_auc, direction_free_auc (the greater of it and its complement) and rank of each attribute alone, over the
    rows whose split is not train; missing values are the median of the training rows, 0 without one.

    Attributes become rows, and one pass by ranges of (attribute, value) ranks them all.
    """
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    fill = rows.filter("split = 'train'").agg(*(F.coalesce(F.median(value(c)), F.lit(0.0)).alias(f"_{c}") for c in names))  # one row
    d = rows.filter("split <> 'train'").crossJoin(F.broadcast(fill))
    long = d.select(F.col(label).alias("label"), F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.round(F.coalesce(value(c), F.col(f"_{c}")), 9).alias("score")) for c in names))).alias("x")).select("label", "x.*")
    auc = ranking(long, ["attribute"]).select("attribute", F.col("auroc").alias("raw_auc"), F.greatest("auroc", 1 - F.col("auroc")).alias("direction_free_auc"))
    return auc.withColumn("rank", F.rank().over(Window.orderBy(F.round("direction_free_auc", 9).desc())).cast("int"))  # a row for each attribute


def attach(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """All rows with the computed columns of their key, null where there are none; columns that rows have already are replaced."""
    return rows.drop(*(c for c in values.columns if c != key)).join(values, key, "left")
