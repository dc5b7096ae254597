"""Predicates on regions, and lattices of their combinations evaluated in one pass.

A null comparison counts as not passed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predicate:
    name: str
    test: Callable[[], Column]

    def passed(self) -> Column:
        return F.coalesce(self.test(), F.lit(False))


def multiple_detections(most: int = 10) -> Predicate:
    return Predicate(f"n_obs<{most}", lambda: F.count("*").over(Window.partitionBy("obsid")) < most)


def time_bin(t_bin: int) -> Predicate:
    return Predicate(f"t_bin={t_bin}", lambda: F.contains("runid", F.lit(f"_{t_bin}_")))


def energy_range(lo: float, hi: float) -> Predicate:
    """A pattern as it stands: a dot is any character."""
    return Predicate(f"E={lo}_{hi}", lambda: F.rlike("runid", F.lit(f"{lo}_{hi}")))


def below(column: str, limit: float) -> Predicate:
    return Predicate(f"{column}<{limit}", lambda: F.col(column) < limit)


def above(column: str, limit: float) -> Predicate:
    return Predicate(f"{column}>{limit}", lambda: F.col(column) > limit)


def peak_or_eclipse(sigma: float) -> Predicate:
    return Predicate(f"sigma>={sigma}", lambda: (F.col("sigma_max_peak") >= sigma) | (F.col("sigma_max_eclipse") >= sigma))


def five_sigma() -> Predicate:
    return Predicate("5sig", lambda: (F.col("b_peak_max") > 13.2) | (F.col("b_eclipse_max") > 12.38))


def bins_at_least(sigma: int, kind: str, times: str, least: int) -> Predicate:
    column = f"n_{sigma}_sig_{kind}_bins_{times}"
    return Predicate(f"{column}>={least}", lambda: F.col(column) >= least)


def separated(column: str, limit: float, side: str) -> Predicate:
    if side not in ("lower", "greater"):
        raise ValueError(f"side must be lower or greater, not {side}")
    return Predicate(f"{column} {side} {limit}", lambda: F.col(column) < limit if side == "lower" else F.col(column) > limit)


def not_variable(column: str = "var_flag") -> Predicate:
    return Predicate("not variable", lambda: ~F.col(column))


def apply(df: DataFrame, *predicates: Predicate) -> DataFrame:
    flagged = df.withColumns({f"_p{k}": p.passed() for k, p in enumerate(predicates)})
    return flagged.where(reduce(lambda a, b: a & b, [F.col(f"_p{k}") for k in range(len(predicates))], F.lit(True))).select(*df.columns)


def info(df: DataFrame, predicate: Predicate) -> DataFrame:
    """Counts of the rows there were, those that pass and those removed."""
    flagged = df.withColumn("_p", predicate.passed())
    return flagged.agg(F.lit(predicate.name).alias("filter"), F.count("*").alias("n_original"), F.count_if("_p").alias("n_filtered"), F.count_if(~F.col("_p")).alias("n_removed"))


def combinations(categories: Sequence[Sequence[Predicate]]) -> list[tuple[Predicate, ...]]:
    """All choices of none or one predicate of each category; later categories vary fastest."""
    return [tuple(p for p in chosen if p is not None) for chosen in product(*[[None, *c] for c in categories])]


def _superset_sums(patterns: DataFrame, keys: Sequence[str], widths: Sequence[int]) -> DataFrame:
    """(keys, node, _n): for every node the sum of ``_n`` over the patterns that pass all of its predicates.

    A pattern is one bitmap ``_c0``, ``_c1``, .. a category.  Category by category a
    bitmap becomes a choice, none or one of its bits, and rows that then agree are
    summed: the sums over supersets, with a few rows for each that goes in.
    """
    rows = patterns.withColumn("node", F.lit(0).cast("long"))
    for c, width in enumerate(widths):
        bits = F.array(*[F.when(F.col(f"_c{c}").bitwiseAND(F.lit(1 << k)) != 0, F.lit(k + 1)) for k in range(width)])
        chosen = F.explode(F.concat(F.array(F.lit(0)), F.array_compact(bits)))
        left = [f"_c{k}" for k in range(c + 1, len(widths))]
        dealt = rows.select(*keys, *left, "node", "_n", chosen.alias("_choice")).withColumn("node", F.col("node") * (width + 1) + F.col("_choice"))
        rows = dealt.groupBy(*keys, *left, "node").agg(F.sum("_n").alias("_n"))
    return rows


def lattice(df: DataFrame, categories: Sequence[Sequence[Predicate]], unique: str = "cluster_label") -> DataFrame:
    """(node, n_reg, n_unique) of every combination that some row passes, in one pass over the rows.

    Rows collapse to bitmaps of passed predicates, sources to the set of their rows'
    bitmaps; sources with equal sets are one row that counts as often.  Both are
    summed over supersets along the categories, so what is dealt grows with the
    patterns and not with the combinations of each row.
    """
    names, widths = [f"_c{c}" for c in range(len(categories))], [len(c) for c in categories]
    bitmap = lambda c: sum((F.when(p.passed(), 1 << k).otherwise(0) for k, p in enumerate(c)), F.lit(0))
    flagged = df.select(F.col(unique).alias("_u"), *[bitmap(c).alias(n) for n, c in zip(names, categories, strict=True)])
    # a source without a name is none
    patterns = flagged.groupBy("_u", *names).agg(F.count("*").alias("_n"))
    regions = _superset_sums(patterns.groupBy(*names).agg(F.sum("_n").alias("_n")), [], widths)
    kinds = patterns.groupBy("_u").agg(F.array_sort(F.collect_set(F.struct(*names))).alias("_set")).groupBy("_set").agg(F.count("*").alias("_times"))
    kinds = kinds.select(F.xxhash64("_set").alias("_h"), "_set", "_times").select("_h", "_times", F.explode("_set").alias("_p")).select("_h", "_times", *[f"_p.{n}" for n in names]).withColumn("_n", F.lit(1))
    sources = _superset_sums(kinds, ["_h", "_times"], widths).groupBy("node").agg(F.sum("_times").alias("n_unique"))
    return regions.withColumnRenamed("_n", "n_reg").join(sources, "node").select("node", "n_reg", "n_unique")


def quality_flags(df: DataFrame, excluded: Sequence[str], crowded: int = 20) -> DataFrame:
    """Flags of regions: few counts in short bins, crowded runs, excluded observations."""
    per_run = F.count("*").over(Window.partitionBy("runid"))
    return df.withColumns({
        "low_counts": F.contains("runid", F.lit("_5_")) & (F.col("intensity") < 500),
        "crowded_run": per_run > crowded,
        "excluded": F.regexp_extract("runid", r"(\d{10})", 1).isin(*excluded),
    })


def flag_statistics(flagged: DataFrame, flags: Sequence[str], strong: Column) -> DataFrame:
    """Per flag its number and share, over all rows and over the strong ones."""
    rows = flagged.withColumn("_s", strong).select("_s", F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("on")) for f in flags])).alias("x"))
    return rows.groupBy("x.flag").agg(
        F.count_if("x.on").alias("n_all"), F.count_if(F.col("x.on") & F.col("_s")).alias("n_strong"), (100.0 * F.count_if("x.on") / F.count("*")).alias("pct_all"), (100.0 * F.count_if(F.col("x.on") & F.col("_s")) / F.greatest(F.count_if("_s"), F.lit(1))).alias("pct_strong")
    )


def in_rectangles(df: DataFrame, rectangles: DataFrame) -> DataFrame:
    """Rows with the rectangles of their time bin that hold them, edges excluded; rectangles are a short fixed list."""
    r = F.broadcast(rectangles)
    inside = (F.col("x_img") > F.col("x")) & (F.col("x_img") < F.col("x") + F.col("w")) & (F.col("y_img") > F.col("y")) & (F.col("y_img") < F.col("y") + F.col("h"))
    return df.join(r, (df["t_bin"] == r["rect_t_bin"]) & inside)


def hot_flag(df: DataFrame, rectangles: DataFrame) -> DataFrame:
    hot = in_rectangles(df, rectangles).select("detid").distinct().withColumn("is_hot", F.lit(True))
    return df.join(hot, "detid", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
