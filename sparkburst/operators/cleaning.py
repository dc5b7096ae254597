"""Cleaning of photon events: predicates, and the anti-join with hot pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (CCDNR, RAWX) columns of the PN camera that are bad.
BAD_COLUMNS = ((4, 12), (5, 11), (10, 28))
#: Which submodes can be searched.
SUBMODES = {
    ("PN", "PrimeFullWindow"): True,
    ("PN", "PrimeFullWindowExtended"): True,
    ("PN", "PrimeLargeWindow"): True,
    ("PN", "PrimeSmallWindow"): False,
    ("PN", "FastBurst"): False,
    ("PN", "FastTiming"): False,
    ("MOS", "PrimeFullWindow"): True,
    ("MOS", "PrimePartialW2"): True,
    ("MOS", "PrimePartialW3"): True,
    ("MOS", "FastUncompressed"): False,
    ("MOS", "FastCompressed"): False,
}


def is_pn() -> Column:
    return F.col("instrument") == "EPN"


def in_file_band(lo: int, hi: int) -> Column:
    """Inclusive energy band and the camera's patterns: what the file-level filter keeps."""
    return F.col("pi").between(lo, hi) & (F.col("pattern") <= F.when(is_pn(), 4).otherwise(12))


def in_band(lo_kev: float, hi_kev: float) -> Column:
    """Strict energy band in keV."""
    return (F.col("pi") > lo_kev * 1000) & (F.col("pi") < hi_kev * 1000)


def good_column() -> Column:
    bad = F.lit(False)
    for ccd, rawx in BAD_COLUMNS:
        bad = bad | ((F.col("ccdnr") == ccd) & (F.col("rawx") == rawx))
    return ~(is_pn() & bad)


def inside_borders(submode: str) -> Column:
    """PN only: three pixels off the edges; a large window has no lower edge in RAWY."""
    x = (F.col("rawx") > 4) & (F.col("rawx") < 61)
    y = F.col("rawy") < 197
    if submode in ("PrimeFullWindow", "PrimeFullWindowExtended"):
        y = y & (F.col("rawy") > 23)
    return ~is_pn() | (x & y)


def not_mos_centre(submode: str) -> Column:
    if submode == "PrimeFullWindow":
        return F.lit(True)
    return is_pn() | (F.col("ccdnr") != 1)


def without_hot_pixels(events: DataFrame, hot: DataFrame, revolution: int | str = "revolution") -> DataFrame:
    """Events on no hot pixel whose revolutions hold the event's, ends excluded.  Repeated events stay."""
    rev = F.col(revolution) if isinstance(revolution, str) else F.lit(revolution)
    e, h = events.withColumn("_rev", rev).alias("e"), hot.alias("h")
    same = (F.col("e.rawx") == F.col("h.rawx")) & (F.col("e.rawy") == F.col("h.rawy")) & (F.col("e.ccdnr") == F.col("h.ccdnr"))
    return e.join(h, same & (F.col("e._rev") > F.col("h.rev1")) & (F.col("e._rev") < F.col("h.rev2")), "left_anti").drop("_rev")


def supported_lists(lists: DataFrame, stop: bool = True) -> DataFrame:
    """Event lists whose submode can be searched; a submode that is not in the table stops the job.

    Without ``stop`` such lists, which ``unknown_submodes`` names, are left out.
    """
    family = F.when(is_pn(), "PN").otherwise("MOS")
    known = F.create_map(*[F.lit(x) for (fam, mode), ok in SUBMODES.items() for x in (f"{fam}:{mode}", ok)])
    ok = F.element_at(known, F.concat_ws(":", family, F.col("submode")))
    unknown = F.raise_error(F.concat(F.lit("unknown submode: "), F.coalesce(F.col("submode"), F.lit("null")))).cast("boolean")
    return lists.where(F.coalesce(ok, unknown if stop else F.lit(False)))


def unknown_submodes(lists: DataFrame) -> DataFrame:
    family = F.when(is_pn(), "PN").otherwise("MOS")
    known = F.array(*[F.lit(f"{a}:{b}") for a, b in SUBMODES])
    return lists.where(~F.array_contains(known, F.concat_ws(":", family, F.coalesce("submode", F.lit("")))))


def refuse_timing(lists: DataFrame) -> DataFrame:
    """Stops at event files taken in timing mode."""
    return lists.withColumn("evt_file", F.when(F.contains("evt_file", F.lit("TI")), F.raise_error(F.concat(F.lit("timing mode: "), "evt_file"))).otherwise(F.col("evt_file")))


def hot_pixel_rows(ranges: DataFrame) -> DataFrame:
    """One row per pixel of ranges (rawx, rawy1..rawy2)."""
    return ranges.select("ccdnr", "rawx", F.explode(F.sequence("rawy1", "rawy2")).alias("rawy"), "rev1", "rev2")


def in_box(x: tuple[float, float], y: tuple[float, float], t_us: tuple[int, int]) -> Column:
    """All six bounds excluded."""
    return (F.col("x") > x[0]) & (F.col("x") < x[1]) & (F.col("y") > y[0]) & (F.col("y") < y[1]) & (F.col("t_us") > t_us[0]) & (F.col("t_us") < t_us[1])


def events_of_alerts(events: DataFrame, alerts: DataFrame, pixel: int = 400, frame_us: int = 21_600_000_000) -> DataFrame:
    """(alert columns, event_id) of the events in each alert's open box.

    Both sides are keyed by cells, the alert's box exploded to the cells it
    touches, so that the range condition is a residual of an equi-join.
    """
    cell = lambda c, w: F.floor(c / w).cast("long")
    spans = lambda lo, hi, w: F.explode(F.sequence(cell(F.col(lo), w), cell(F.col(hi), w)))
    a = alerts.withColumn("_x", spans("x_lo", "x_hi", pixel)).withColumn("_y", spans("y_lo", "y_hi", pixel)).withColumn("_t", spans("t_lo", "t_hi", frame_us))
    e = events.select("event_id", "obsid", "x", "y", "t_us", cell(F.col("x"), pixel).alias("_x"), cell(F.col("y"), pixel).alias("_y"), cell(F.col("t_us"), frame_us).alias("_t"))
    inside = (F.col("x") > F.col("x_lo")) & (F.col("x") < F.col("x_hi")) & (F.col("y") > F.col("y_lo")) & (F.col("y") < F.col("y_hi")) & (F.col("t_us") > F.col("t_lo")) & (F.col("t_us") < F.col("t_hi"))
    return a.join(e, ["obsid", "_x", "_y", "_t"]).where(inside).select(*alerts.columns, "event_id")
