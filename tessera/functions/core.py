"""Column expressions and small plans that the operators are made of. Everything stays in built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType
from pyspark.sql.window import Window

MICROS_PER_DAY = 86_400_000_000

#: Lead status synonyms.
STATUS_SYNONYMS = {
    "new": "new", "new lead": "new", "prospect": "prospect", "prospecting": "prospect",
    "contacted": "contacted", "contact": "contacted", "attempted contact": "contacted",
    "qualified": "qualified", "mql": "qualified", "sql": "qualified", "sales qualified": "qualified",
    "opportunity": "opportunity", "open opportunity": "opportunity",
    "converted": "converted", "won": "converted", "closed won": "converted", "customer": "converted",
    "lost": "lost", "closed lost": "lost",
    "disqualified": "disqualified", "unqualified": "disqualified", "dead": "disqualified", "rejected": "disqualified",
    "nurture": "nurture", "nurturing": "nurture", "working": "working", "in progress": "working",
}


#: Of the sketches that enclose a quantile: one over their relative error.
ACCURACY = 100_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(num: str | Column, den: str | Column, mult: float = 1.0) -> Column:
    """num * mult / den; 0 where den is 0 or the result is null, NaN or infinite."""
    out = F.try_divide(col(num).cast("double") * mult, col(den).cast("double"))
    return F.when(out.isNull() | F.isnan(out) | (F.abs(out) == float("inf")), 0.0).otherwise(out)


def safe_divide_eps(num: str | Column, den: str | Column, default: float = 0.0, eps: float = 1e-7) -> Column:
    den = col(den).cast("double")
    return F.when(den.isNull() | (F.abs(den) <= eps), default).otherwise(col(num).cast("double") / den)


def safe_pct(num: str | Column, den: str | Column) -> Column:
    den = col(den).cast("double")
    return F.when(den.isNull() | (den <= 0), 0.0).otherwise(F.round(col(num) / den * 100, 2))


def parse_number(c: str | Column) -> Column:
    """A number from text with thousands commas, currency and percent signs; null if there is none."""
    return F.trim(F.regexp_replace(col(c).cast("string"), "[,$%]", "")).try_cast("double")


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def coerce_timestamp(c: str | Column) -> Column:
    return F.try_to_timestamp(col(c).cast("string"))


def micros(c: str | Column) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def days_between(start: str | Column, end: str | Column) -> Column:
    """Whole periods of 24 hours from start to end, rounded down."""
    return F.floor((micros(end) - micros(start)) / MICROS_PER_DAY)


def clean_text(c: str | Column) -> Column:
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")))


def normalize_label(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean_text(c)), "[_-]", " "), r"\s+", " "))


def map_label(c: str | Column, synonyms: Mapping[str, str] = STATUS_SYNONYMS, blank: str = "unknown") -> Column:
    """The synonym's label; other labels pass through, blanks become ``blank``."""
    label = normalize_label(c)
    table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.when(label == "", blank).otherwise(F.coalesce(F.try_element_at(table, label), label))


def resolve_columns(schema: StructType, roles: Mapping[str, Sequence[str]]) -> dict[str, str | None]:
    """For each role the first column whose name is among its candidates, without regard to case, spaces, _ and -."""
    plain = lambda s: s.lower().replace(" ", "").replace("_", "").replace("-", "")
    names = {plain(f.name): f.name for f in reversed(schema.fields)}
    return {role: next((names[plain(c)] for c in candidates if plain(c) in names), None) for role, candidates in roles.items()}


def drop_empty(df: DataFrame) -> DataFrame:
    """Without columns that are all null, rows that are all null, and blanks around column names."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    kept = [c for i, c in enumerate(df.columns) if counts[i]]
    return df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in kept]).na.drop("all") if kept else df.select().limit(0)


def value_counts(df: DataFrame, c: str, top: int | None = None) -> DataFrame:
    out = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c)
    return out.limit(top) if top else out


def numeric_summary(df: DataFrame, c: str | Column, names: Sequence[str] = ("mean", "median", "min", "max", "std"), by: Sequence[str] = ()) -> DataFrame:
    """One row, or one per group: mean, median, least, most and spread, rounded, by the given names."""
    mean, median, least, most, std = names
    c = col(c)
    one = df.groupBy(*by).agg(r(F.avg(c)).alias(mean), r(F.min(c).cast("double")).alias(least), r(F.max(c).cast("double")).alias(most), r(F.stddev_samp(c)).alias(std))
    return with_quantiles(one, df, {median: (c, 0.5)}, by)


def exact_quantiles(df: DataFrame, wanted: Mapping[str, tuple[str | Column, float]], by: Sequence[str] = ()) -> DataFrame:
    """One row, or one per group: the exact quantile of each name's column, interpolated between neighbours.

    For more than ACCURACY rows a sketch of bounded size first gives two values that enclose the quantile, with about
    6 / ACCURACY of the rows between them; then values are counted, those below the two as one. Only the counts between
    them are sorted, so no task ever holds the distinct values of a large table.
    """
    gap = 3 / ACCURACY
    base = df.select(*by, *[col(c).cast("double").alias(f"_v{i}") for i, (c, _) in enumerate(wanted.values())])
    marks = [F.percentile_approx(f"_v{i}", F.array(*[F.lit(min(1.0, max(0.0, p + d))) for d in (-gap, gap)]), F.lit(ACCURACY)).alias(f"_m{i}") for i, (_, p) in enumerate(wanted.values())]
    sizes = base.groupBy(*by).agg(*marks, *[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(wanted))])
    near = base.join(sizes, list(by)) if by else base.join(F.broadcast(sizes))

    def end(i: int, which: int) -> Column:  # few rows need no narrowing
        return F.when(F.col(f"_n{i}") <= ACCURACY, (-1.0) ** (which + 1) * float("inf")).otherwise(F.col(f"_m{i}")[which])

    each = F.array(*[F.struct(F.lit(i).alias("_q"), F.col(f"_v{i}").alias("_v"), end(i, 0).alias("_lo"), end(i, 1).alias("_hi"), F.col(f"_n{i}").alias("_n")) for i in range(len(wanted))])
    rows = near.select(*by, F.inline(each)).where("_v <= _hi").select(*by, "_q", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"), "_n")
    counts = rows.groupBy(*by, "_q", "_v").agg(F.count(F.lit(1)).alias("_k"), F.max("_n").alias("_n"))
    upto = F.sum("_k").over(Window.partitionBy(*by, "_q").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    shares = F.array(*[F.lit(float(p)) for _, p in wanted.values()])
    at = (F.col("_n") - 1) * F.element_at(shares, F.col("_q") + 1)
    picked = counts.withColumn("_upto", upto).groupBy(*by, "_q").agg(
        F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v"))).alias("_a"), F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v"))).alias("_b"), F.max(at - F.floor(at)).alias("_f")
    )
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")
    return picked.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == i, value)).alias(name) for i, name in enumerate(wanted)])


def with_quantiles(one: DataFrame, df: DataFrame, wanted: Mapping[str, tuple[str | Column, float]], by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Adds rounded quantiles of ``df`` to a row of its aggregates, or to a row per group."""
    found = exact_quantiles(df, wanted, by).select(*by, *[r(n, digits).alias(n) for n in wanted])
    return one.join(found, list(by), "left") if by else one.join(F.broadcast(found))


def iqr_bounds(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    q = exact_quantiles(df, {"q1": (c, 0.25), "q3": (c, 0.75)}, by)
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    return q.withColumns({"low": F.col("q1") - spread, "high": F.col("q3") + spread})


def iqr_outliers(df: DataFrame, c: str) -> DataFrame:
    """Rows outside the quartiles by more than one and a half times their distance. The bounds are one row."""
    return df.join(F.broadcast(iqr_bounds(df, c).select("low", "high"))).where((F.col(c) < F.col("low")) | (F.col(c) > F.col("high"))).drop("low", "high")


def sigma_outliers(df: DataFrame, c: str, sigmas: float = 2.0, least: int = 3) -> DataFrame:
    """Rows above mean + sigmas * std, if there are ``least`` values with some spread."""
    s = df.agg(F.count(c).alias("_n"), F.avg(c).alias("_mean"), F.stddev_samp(c).alias("_std"))
    limit = s.where(f"_n >= {least} and _std > 0").select((F.col("_mean") + sigmas * F.col("_std")).alias("threshold"))
    return df.join(F.broadcast(limit)).where(F.col(c) > F.col("threshold"))


def bias_corrected_skew(c: str | Column) -> Column:
    n = F.count(col(c)).cast("double")
    return F.when(n > 2, F.skewness(col(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def smallest_mode(df: DataFrame, c: str | Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one per group: the smallest of the most frequent values. Values are counted first, so groups may be large."""
    counts = df.select(*by, col(c).alias(name)).where(F.col(name).isNotNull()).groupBy(*by, name).agg(F.count(F.lit(1)).alias("_k"))
    return counts.groupBy(*by).agg(F.min_by(name, F.struct(-F.col("_k"), F.col(name))).alias(name))


def sums_in_order(df: DataFrame, by: Sequence[str], sums: Mapping[str, Column], at: Sequence[Column]) -> DataFrame:
    """One row per group: sums of doubles, added one by one in the order of ``at``, nulls left out.

    So their last bits, and with them who ties with whom, are the same in any partitioning. A group's rows meet in one
    list: for groups of few rows.
    """
    row = F.struct(*[c.alias(f"_at{i}") for i, c in enumerate(at)], *[c.cast("double").alias(n) for n, c in sums.items()])
    lists = df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("_rows"))

    def added(n: str) -> Column:
        return F.aggregate("_rows", F.lit(None).cast("double"), lambda total, x: F.coalesce(total + x[n], total, x[n])).alias(n)

    return lists.select(*by, *[added(n) for n in sums])


#: Ranges that values are dealt to, so that no task sorts a whole column.
RANGES = 200
_STEP = 14  #: bounds between two that are looked at first


def _ranges(df: DataFrame, value: str) -> DataFrame:
    """One row, ``_bounds``: values that cut a numeric column in at most RANGES ranges of about as many rows each; ``_coarse``: every _STEP-th."""
    cuts = F.percentile_approx(value, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(50 * RANGES))
    one = df.agg(F.array_distinct(F.coalesce(cuts, F.array().cast("array<double>"))).alias("_bounds"))
    return one.withColumn("_coarse", F.filter("_bounds", lambda _, i: i % _STEP == _STEP - 1))


def same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``a`` with the other columns of ``b`` where the keys are equal, null with null."""
    right = b.select(*[F.col(k).alias(f"_same_{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_same_{i}")) for i, k in enumerate(keys)]
    return a.join(right, on, how).drop(*[f"_same_{i}" for i in range(len(keys))])


def with_range(df: DataFrame, value: str, name: str = "_range") -> DataFrame:
    """Adds the number of the range that ``value`` lies in; equal values share one, nulls are in the first."""
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b < F.coalesce(F.col(value), b)))
    cut = df.join(F.broadcast(_ranges(df, value))).withColumn("_far", below("_coarse") * _STEP)
    return cut.withColumn(name, F.col("_far") + below(F.slice("_bounds", F.col("_far") + 1, F.lit(_STEP)))).drop("_bounds", "_coarse", "_far")


def _before(totals: DataFrame, by: Sequence[str], n: str) -> DataFrame:
    """(by, _range, _base, _all): rows in the ranges before, and in all; a group has RANGES rows here at most."""
    w = Window.partitionBy(*by)
    base = F.coalesce(F.sum(n).over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return totals.select(*by, "_range", base.alias("_base"), F.sum(n).over(w).alias("_all"))


def with_pct_ranks(df: DataFrame, ranks: Mapping[str, Column], by: Sequence[str] = (), times: float | Column = 1) -> DataFrame:
    """Adds each name: the rank of its numeric column over the number of rows (of the group), ties sharing their mean rank, nulls first.

    Ranks are multiplied by ``times``, a number or an expression over ``by``, before they are divided. Values are counted, the counts added up within ranges of values and over the ranges' totals, and the ranks joined
    back by value. So a task sorts a range of distinct values of a group, never its rows.
    """
    base = df.withColumns({f"_v{i}": value.cast("double") for i, value in enumerate(ranks.values())})
    out = base
    for i, name in enumerate(ranks):
        v = f"_v{i}"
        counts = with_range(base.groupBy(*by, v).agg(F.count(F.lit(1)).alias("_k")), v)
        upto = F.sum("_k").over(Window.partitionBy(*by, "_range").orderBy(F.asc_nulls_first(v)).rowsBetween(Window.unboundedPreceding, 0))
        totals = _before(counts.groupBy(*by, "_range").agg(F.sum("_k").alias("_n")), by, "_n")
        counts = counts.withColumn("_upto", upto)
        placed = same(counts, totals if by else F.broadcast(totals), [*by, "_range"])
        share = times * (F.col("_base") + F.col("_upto") - (F.col("_k") - 1) / 2) / F.col("_all")
        out = same(out, placed.select(*by, v, share.alias(name)), [*by, v]).drop(v)
    return out


def in_blocks(df: DataFrame, ts: str, by: Sequence[str] = (), halo: int = 1, size: int = 100_000) -> DataFrame:
    """The rows of each series in blocks of ``size`` rows, each preceded by the ``halo`` rows before it: adds _pos, _block, _halo.

    Rows are numbered by ``ts`` within ranges of it and over the ranges' counts, so a series of any length, with or
    without keys, is many tasks; a window over (by, _block) ordered by _pos sees what it would see in one piece, as far
    back as ``halo`` rows. Rows with _halo are there for others' sake. Rows of one time are in any order.
    """
    if size < halo:
        raise ValueError("a block has at least as many rows as its halo")
    at = with_range(df.withColumn("_t", micros(ts).cast("double")), "_t")
    totals = _before(at.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n")), by, "_n")
    number = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(F.asc_nulls_first("_t")))
    at = same(at.withColumn("_i", number), totals if by else F.broadcast(totals), [*by, "_range"])
    at = at.withColumn("_pos", F.col("_base") + F.col("_i") - 1).drop("_t", "_range", "_i", "_base", "_all")
    own = F.floor(F.col("_pos") / size)
    place = lambda block, extra: F.struct(block.alias("_block"), F.lit(extra).alias("_halo"))
    late = F.col("_pos") % size >= size - halo
    both = F.when(late, F.array(place(own, False), place(own + 1, True))).otherwise(F.array(place(own, False)))
    return at.select("*", F.inline(both))


def duplicate_rows(df: DataFrame) -> Column:
    """Rows beyond the first of each group of equal rows, as an aggregate over groupBy(all).count()."""
    return F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows")


def top_n_share(df: DataFrame, c: str, n: int) -> DataFrame:
    """share: sum of the n largest values over the sum of all, in percent. Only n rows meet in one task."""
    top = df.orderBy(F.desc(c)).limit(n).agg(F.sum(c).alias("_top"))
    return df.agg(F.sum(c).alias("_all")).join(top).select(safe_divide("_top", "_all", 100.0).alias("share"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def month(c: str | Column) -> Column:
    return F.date_format(F.date_trunc("month", col(c)), "yyyy-MM")


def r(c: str | Column, digits: int = 4) -> Column:
    """Rounded for output; NaN and infinity become null."""
    c = col(c)
    return F.round(F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c), digits)


def r_scaled(c: str | Column, digits: int = 4) -> Column:
    """Rounded as r() does, but by the product with the power of ten as engines on doubles do; they differ where the next digit is a five."""
    return r(col(c) * 10.0**digits, 0) / 10.0**digits


def summary_rows(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """One row: every metric as a double, rounded."""
    return df.agg(*[r(v.cast("double")).alias(k) for k, v in metrics.items()])
