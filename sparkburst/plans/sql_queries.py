"""Queries in SQL text over registered functions."""

from __future__ import annotations

from ..functions import sql
from ..operators import background, regions
from ..sources import adapters as A
from .cube_queries import COMPONENTS, REACH, cells_of, labelled_of
from .oracle import put

REGISTER: dict[str, tuple] = {}


def query(text: str | None = None):
    def add(f):
        REGISTER[f.__name__] = (f, text)
        return f

    return add


@query(put("SELECT region, cat_id, sep, ra_offset FROM pairs WHERE sep <= 20.0", "pairs"))
def q_sql_sky_join(s, d):
    sql.register(s)
    return s.sql(
        """
        SELECT region, cat_id, round(separation(ra, dec, ra2, dec2), 6) AS sep, round(ra_offset(ra, dec, ra2), 9) AS ra_offset
        FROM (SELECT r.region, r.ra_deg AS ra, r.dec_deg AS dec, k.band, k.slot FROM {regions} r, LATERAL sky_cells(r.ra_deg, r.dec_deg, 20.0D, true) k)
        JOIN (SELECT c.cat_id, c.ra_deg AS ra2, c.dec_deg AS dec2, m.band, m.slot FROM {catalogue} c, LATERAL sky_cells(c.ra_deg, c.dec_deg, 20.0D, false) m) USING (band, slot)
        WHERE round(separation(ra, dec, ra2, dec2), 6) <= 20.0
        """,
        regions=A.regions(s, d), catalogue=A.catalogue(s, d),
    )


@query(put("""SELECT b.obsid, b.label, c.it, CAST(sum(c.n) AS BIGINT) AS n, max(c.n) AS n_max FROM (SELECT obsid, label, min(ix) AS a, min(iy) AS b, max(ix) AS e, max(iy) AS f FROM parts GROUP BY obsid, label) b
    JOIN cells c ON c.obsid = b.obsid AND c.ix BETWEEN a AND e AND c.iy BETWEEN b.b AND f GROUP BY ALL""", "flagged", "cells", reach=REACH, parts=COMPONENTS))
def q_sql_region_curves(s, d):
    sql.register(s)
    boxes = regions.properties(labelled_of(s, d))
    return s.sql(
        """
        SELECT obsid, label, it, sum(n) AS n, max(n) AS n_max
        FROM (SELECT b.obsid, b.label, p.ix, p.iy FROM {boxes} b, LATERAL box_pixels(b.bbox_0, b.bbox_1, b.bbox_2, b.bbox_3) p) JOIN {cells} USING (obsid, ix, iy)
        GROUP BY obsid, label, it
        """,
        boxes=boxes, cells=cells_of(s, d),
    )


@query(put("""SELECT obsid, ix, iy, it, n, round(b_peak, 6) AS b_peak, CAST(ceil((2 * mu + 9 + sqrt(72 * mu + 81)) / 2) AS BIGINT) AS n_peak FROM scored""", "scored"))
def q_sql_factors(s, d):
    sql.register(s)
    return s.sql("SELECT obsid, ix, iy, it, n, round(bayes_peak(n, mu), 6) AS b_peak, gaussian_peak_counts(mu, 3.0D) AS n_peak FROM {cells}", cells=background.expectation(cells_of(s, d)))
