"""Normalisation of feature tables and labels: projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column names that detectors use for one field, in order of preference; fixed values.
ALIASES = {
    "RT": ("RT", "rt", "rtime", "rt_apex", "Average Rt(min)"),
    "RTmin": ("RTmin", "rtmin", "rt_min", "rt_start"),
    "RTmax": ("RTmax", "rtmax", "rt_max", "rt_end"),
    "mz": ("mz", "mzmed", "Average Mz"),
}
#: Words of label columns; fixed values.
TRUE_WORDS = ("1", "true", "yes", "y", "t", "tp", "positive", "是")
FALSE_WORDS = ("0", "false", "no", "n", "f", "fp", "negative", "否")


def unify_columns(rows: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """The first alias that is there becomes the field; its other aliases go."""
    taken = {next((c for c in names if c in rows.columns), None): field for field, names in aliases.items()}
    every = {c for names in aliases.values() for c in names}
    return rows.select(*(F.col(f"`{c}`").alias(taken.get(c, c)) for c in rows.columns if c in taken or c not in every))


def minutes(rows: DataFrame, columns: list[str], limit: float = 200.0) -> DataFrame:
    """Retention times in minutes: a table whose greatest time is over the limit has seconds. Rounded to 3 digits, half to even."""
    top = rows.agg((F.max(F.greatest(*map(F.col, columns))) > limit).alias("_seconds"))  # one row
    return rows.crossJoin(F.broadcast(top)).select(*(F.bround(F.when(F.col("_seconds"), F.col(c) / 60).otherwise(F.col(c)), 3).alias(c) if c in columns else F.col(c) for c in rows.columns))


def samples_to_zero(rows: DataFrame, samples: list[str]) -> DataFrame:
    """Missing intensities of sample columns count as none."""
    return rows.fillna(0.0, subset=samples)


def peak_intensity(rows: DataFrame, preferred: tuple[str, ...], samples: list[str]) -> DataFrame:
    """intensity: the first preferred column that is there, else the sum of the samples, else 1; rows without mz or RT go."""
    name = next((c for c in preferred if c in rows.columns), None)
    value = F.col(name) if name else sum((F.coalesce(F.col(c), F.lit(0.0)) for c in samples), F.lit(0.0)) if samples else F.lit(1.0)
    return rows.withColumn("intensity", F.coalesce(value.cast("double"), F.lit(0.0))).dropna(subset=["mz", "RT"])


def mask_huge(rows: DataFrame, columns: list[str], limit: float = 1e300) -> DataFrame:
    """Values that stand for missing (over the limit, NaN) become null."""
    return rows.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) <= limit), F.col(c)) for c in columns})


def valid_bounds(rows: DataFrame, half: float = 0.1) -> DataFrame:
    """Missing bounds are RT -+ half, missing RT is their middle; rows whose start is behind their end go."""
    rt = F.coalesce("RT", (F.col("RTmin") + F.col("RTmax")) / 2)
    d = rows.withColumn("RT", rt).withColumns({"RTmin": F.coalesce("RTmin", F.col("RT") - half), "RTmax": F.coalesce("RTmax", F.col("RT") + half)})
    return d.dropna(subset=["mz", "RT"]).filter("RTmin <= RTmax")


def feature_key(name: str) -> Column:
    """The number in F12, FT12, 12 or at the end of another id; null without one."""
    digits = lambda pattern: F.expr(f"try_cast(nullif(regexp_extract({name}, '{pattern}', 1), '') as bigint)")
    return F.coalesce(digits("^[Ff][Tt]?([0-9]+)$"), digits("^([0-9]+)$"), digits("([0-9]+)$"))


def label_value(name: str) -> Column:
    """1, 0 or null of a label as people write it."""
    word = F.lower(F.trim(F.col(name).cast("string")))
    return F.when(word.isin(*TRUE_WORDS), 1).when(word.isin(*FALSE_WORDS), 0)


def mapped_labels(name: str, mapping: dict[str, str]) -> Column:
    """Labels of an array replaced by their alias."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.transform(name, lambda x: F.coalesce(F.try_element_at(pairs, x), x))


def annotation_state(labels: str, true: str, false: str) -> Column:
    """empty, conflict, true, false or unresolved, by which of two labels an array holds."""
    has = lambda x: F.array_contains(labels, x)
    return F.when(F.size(labels) == 0, "empty").when(has(true) & has(false), "conflict").when(has(true), "true").when(has(false), "false").otherwise("unresolved")


def rectangle(points: str) -> Column:
    """[xmin, ymin, xmax, ymax] of an array of points; null unless finite, not negative and of some size."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    box = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    ok = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0)) & (box[2] > box[0]) & (box[3] > box[1])
    return F.when(ok, box)


def pixel_to_rt(x: str, rt: str, width: float, half: float = 1.0) -> Column:
    """A pixel column of a window of RT -+ half, as a time; clamped to the window."""
    t = F.col(rt) - half + F.col(x) / width * 2 * half
    return F.greatest(F.col(rt) - half, F.least(F.col(rt) + half, t))


def tiny(width_px: Column, width_s: Column, scans: Column, px: float = 4.5, s: float = 1.0, n: int = 3) -> Column:
    """A box too small to tell anything: `px` pixels or `s` seconds at most, or fewer than `n` scans."""
    return (width_px <= px) | (width_s <= s) | (scans < n)


def scaled_box(box: str, fx: float, fy: float) -> Column:
    return F.zip_with(box, F.array(F.lit(fx), F.lit(fy), F.lit(fx), F.lit(fy)), lambda a, b: a * b)


def portable(path: str, root: str) -> Column:
    """What follows the last part equal to root (in any case) of a path; null for absolute rests, drives and '..'."""
    parts = F.split(F.translate(F.col(path), "\\", "/"), "/")
    low = F.transform(parts, F.lower)
    at = F.size(parts) - F.array_position(F.reverse(low), F.lit(root.lower())).cast("int") + 1
    rest = F.when(F.array_contains(low, root.lower()), F.slice(parts, at + 1, F.greatest(F.lit(0), F.size(parts) - at))).otherwise(parts)
    bad = F.exists(rest, lambda p: p == "..") | (F.get(rest, F.lit(0)) == "") | F.coalesce(F.get(rest, F.lit(0)).rlike("^[A-Za-z]:$"), F.lit(False))
    return F.when(~bad, F.array_join(rest, "/"))


def all_missing(rows: DataFrame, attributes: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with some attribute, and those without any."""
    none = F.coalesce(*(F.col(a).cast("double") for a in attributes)).isNull()
    return rows.filter(~none), rows.filter(none)


def dhash(matrix: Column) -> Column:
    """16 hex digits of the 64 comparisons left > right in a matrix of 8 rows of 9 grey values, row after row."""
    once = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))  # noqa: E731  a name for a value: it is made once a row, however often it is used
    bit = lambda m, k: (F.get(m, (k + F.floor(k / 8)).cast("int")) > F.get(m, (k + F.floor(k / 8) + 1).cast("int"))).cast("int")
    digit = lambda bits, j: F.lower(F.hex(sum((F.get(bits, j + k) * 2 ** (3 - k) for k in range(1, 4)), F.get(bits, j) * 8).cast("bigint")))
    digits = lambda bits: F.transform(F.sequence(F.lit(0), F.lit(60), F.lit(4)), lambda j: digit(bits, j))
    return F.array_join(once(matrix, lambda m: once(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: bit(m, k)), digits)), "")


def samples(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.endswith(".mzML")]


def xcms_table(rows: DataFrame) -> DataFrame:
    """A detector's table with its medians as mz (4 digits), RTmin, RT and RTmax in minutes (3 digits), npeaks, the quality
    columns that are there, and samples with 0 for null; all else goes. Digits are rounded half to even."""
    minutes_of = lambda c: F.bround(F.col(c).cast("double") / 60, 3)
    kept = [c for c in ("sn", "maxo", "into") if c in rows.columns]
    first = [F.col("Feature_ID")] if "Feature_ID" in rows.columns else []
    return rows.select(
        *first, F.bround(F.col("mzmed").cast("double"), 4).alias("mz"), *(minutes_of(c).alias(n) for c, n in (("rtmin", "RTmin"), ("rtmed", "RT"), ("rtmax", "RTmax"))), "npeaks", *kept,
        *(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in samples(rows)),
    )


#: Columns of identifications that go with the raw bounds; fixed values.
IDENTIFICATION = ("RTstart", "RTend", "MZstart", "MZend", "peptide_sequence", "peptide_score", "ID_filename", "ID_native_id", "charge", "quality", "sequence")


def openms_table(rows: DataFrame, recompute: bool = False) -> DataFrame:
    """A detector's table with bounds from its start and end columns, where start <= end and neither stands for missing
    (over 1e300); bounds that are there already stay unless `recompute`. A missing RT or mz column is the middle of the bounds.

    A table whose greatest RT is over 200 is in seconds, and becomes minutes; another with an RT column is taken times 60,
    and stays so; one without RT keeps its unit. mz has 4 digits, RT 3, rounded half to even. Columns of IDENTIFICATION go.
    """
    has = set(rows.columns)
    raw = lambda c: F.when(F.abs(F.expr(f"try_cast(`{c}` as double)")) <= 1e300, F.expr(f"try_cast(`{c}` as double)"))
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    needs = {p: recompute or not {f"{p}min", f"{p}max"} <= has for p in ("RT", "mz")}
    for p, ends in (("RT", ("RTstart", "RTend")), ("mz", ("MZstart", "MZend"))):
        if needs[p] and not set(ends) <= has:
            raise ValueError(f"columns are missing: {ends}")
    d, factor = rows, F.lit(1.0)
    if "RT" in has:
        top = rows.agg((F.coalesce(F.max(F.when(~F.isnan(number("RT")), number("RT"))), F.lit(0.0)) > 200).alias("_seconds"))  # one row
        d, factor = rows.crossJoin(F.broadcast(top)), F.when(F.col("_seconds"), 1 / 60).otherwise(60.0)
    out = {}
    for p, lo, hi, scale, digits in (("RT", "RTstart", "RTend", factor, 3), ("mz", "MZstart", "MZend", F.lit(1.0), 4)):
        if needs[p]:
            ok = raw(lo) <= raw(hi)
            old = lambda c, p=p: number(f"{p}{c}") if f"{p}{c}" in has else F.lit(None).cast("double")
            out |= {f"{p}min": F.when(ok, raw(lo)).otherwise(old("min")), f"{p}max": F.when(ok, raw(hi)).otherwise(old("max"))}
        else:
            out |= {f"{p}{c}": number(f"{p}{c}") for c in ("min", "max")}
        out[p] = number(p) if p in has else (raw(lo) + raw(hi)) / 2
        out |= {c: F.bround(out[c] * scale, digits) for c in (p, f"{p}min", f"{p}max")}
    first = [F.col("Feature_ID")] if "Feature_ID" in has else []
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in (*IDENTIFICATION, *out, "Feature_ID")]
    return d.select(*first, *(out[c].alias(c) for c in ("mz", "mzmin", "mzmax", "RT", "RTmin", "RTmax")), *rest)


def pool_rows(rows: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one source's table (source_file, source_path, Feature_ID, mz, RT, RTmin, RTmax) for a pool of many.

    A column that is missing altogether is made: RT as the middle of its bounds, a bound 0.1 beside RT. Rows without id, m/z,
    RT or a bound go. Ids become stem__id; mz has 4 digits, RT 3; attributes and is_true_peak are there, null where rows have none.
    """
    has = set(rows.columns)
    number = {c: F.expr(f"try_cast(`{c}` as double)") for c in ("mz", "RT", "RTmin", "RTmax") if c in has}
    if "RT" not in has and {"RTmin", "RTmax"} <= has:
        number["RT"] = (number["RTmin"] + number["RTmax"]) / 2
    for c, off in (("RTmin", -0.1), ("RTmax", 0.1)):
        if c not in has:
            number[c] = number["RT"] + off
    name, stem = F.trim(F.col("Feature_ID").cast("string")), F.regexp_replace(F.regexp_extract("source_file", r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    d = rows.select("source_file", "source_path", F.when(name != "", F.concat(stem, F.lit("__"), name)).alias("Feature_ID"), *(F.bround(number[c], 4 if c == "mz" else 3).alias(c) for c in ("mz", "RTmin", "RT", "RTmax")), *(F.col(c) for c in (*attributes, "is_true_peak") if c in has))
    for c in (*attributes, "is_true_peak"):
        if c not in has:
            d = d.withColumn(c, F.lit(None).cast("int" if c == "is_true_peak" else "double"))
    nan = [~F.isnan(c) for c in ("mz", "RT", "RTmin", "RTmax")]
    d = d.dropna(subset=["Feature_ID", "mz", "RT", "RTmin", "RTmax"]).filter(nan[0] & nan[1] & nan[2] & nan[3])
    return d.select("source_file", "source_path", "Feature_ID", "mz", "RTmin", "RT", "RTmax", *attributes, "is_true_peak")


def changed_labels(name: str, mapping: dict[str, str]) -> Column:
    """How many labels of an array, without spaces around them, the mapping names."""
    return F.size(F.filter(name, lambda x: F.trim(x).isin(*mapping))).cast("long")


def sorted_state(labels: str, true: tuple[str, ...], false: tuple[str, ...], empty_as_false: bool = False) -> Column:
    """conflict, true, false, false_empty (if empty ones count as false) or unresolved, by the labels that an array holds."""
    has = lambda names: F.arrays_overlap(F.coalesce(F.col(labels), F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    none = F.coalesce(F.size(labels), F.lit(0)) <= 0
    out = F.when(has(true) & has(false), "conflict").when(has(true), "true").when(has(false), "false")
    return (out.when(none, "false_empty") if empty_as_false else out).otherwise("unresolved")


def box_state(labels: str, deletes: tuple[str, ...], uncertain: tuple[str, ...]) -> Column:
    """no_box (no shapes), delete, uncertain or box."""
    names = F.transform(labels, lambda x: F.trim(x))
    has = lambda which: F.arrays_overlap(names, F.array(*map(F.lit, which)))
    return F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, "no_box").when(has(deletes), "delete").when(has(uncertain), "uncertain").otherwise("box")


def plot_state(labels: str, peak: str = "True_Peak", out: str = "OUT_FIG") -> Column:
    """positive_with_out_fig, positive, out_fig_only or negative."""
    has = lambda x: F.coalesce(F.array_contains(labels, x), F.lit(False))
    return F.when(has(peak) & has(out), "positive_with_out_fig").when(has(peak), "positive").when(has(out), "out_fig_only").otherwise("negative")


def id_parts(name: str, space: str) -> list[Column]:
    """Of an id: namespaced, its difficulty (the second of three parts or more, else UNPARSED) and the number of its box (null without)."""
    parts = F.split(F.col(name), "__")
    box = F.expr(f"try_cast(nullif(regexp_extract({name}, '__P([0-9]+)$', 1), '') as int)")
    return [F.concat(F.lit(f"{space}::"), F.col(name)).alias("id"), F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise("UNPARSED").alias("difficulty"), box.alias("box_index")]
