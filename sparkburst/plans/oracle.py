"""DuckDB text of the domain views, as named parts that oracle queries are put together from."""

from __future__ import annotations

FRAME = 21_600_000_000

#: name -> (parts it reads, body)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "photons": ((), """
        SELECT event_id, lpad(CAST(user_id % 3 AS VARCHAR), 10, '0') AS obsid,
               CASE WHEN event_type IN ('click', 'purchase') THEN 'EPN' WHEN event_type IN ('view', 'error') THEN 'EMOS1' ELSE 'EMOS2' END AS instrument,
               epoch_us(ts) - 1704067200000000 AS t_us, (user_id // 3) % 10 AS ix, user_id // 30 AS iy,
               CAST(((user_id // 3) % 10) * 400 + event_id % 400 AS DOUBLE) AS x, CAST((user_id // 30) * 400 + (event_id * 7) % 400 AS DOUBLE) AS y,
               (event_id * 7) % 64 AS rawx, (event_id * 13) % 200 AS rawy, user_id % 12 + 1 AS ccdnr, CAST(floor(value * 100) AS INTEGER) AS pi, event_id % 14 AS pattern
        FROM events"""),
    "cells": (("photons",), f"SELECT obsid, ix, iy, t_us // {FRAME} AS it, count(*) AS n FROM photons WHERE pi > 200 AND pi < 12000 GROUP BY ALL"),
    "mu": (("cells",), """
        SELECT obsid, ix, iy, it, n, (sum(n) OVER (PARTITION BY obsid, ix, iy) * sum(n) OVER (PARTITION BY obsid, it))::DOUBLE / (sum(n) OVER (PARTITION BY obsid))::DOUBLE AS mu FROM cells"""),
    "scored": (("mu",), """
        SELECT *, log10(list_reduce([1.0::DOUBLE] || list_transform(range(1, n + 1), lambda k: k::DOUBLE), lambda a, k: 1 + a * k / mu)) AS b_peak FROM mu"""),
    "frames": (("cells",), "SELECT obsid, unnest(range(min(it), max(it) + 1)) AS it FROM cells GROUP BY obsid"),
    "dense": (("cells", "frames"), """
        SELECT p.obsid, p.ix, p.iy, f.it, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT obsid, ix, iy FROM cells) p JOIN frames f USING (obsid) LEFT JOIN cells c USING (obsid, ix, iy, it)"""),
    "image": (("dense",), """
        SELECT obsid, ix, iy, CAST(sum(n) AS BIGINT) AS total, max(n) AS max_n, min(n) AS min_n, avg(n) AS mean_n, median(n) AS median_n, stddev_pop(n) AS std_n FROM dense GROUP BY ALL"""),
    "hard": (("photons",), f"""
        SELECT f.obsid, f.it, coalesce(h.n, 0) AS n, coalesce(h.n, 0) / 21600.0::DOUBLE AS rate
        FROM (SELECT obsid, unnest(range(min(t_us // {FRAME}), max(t_us // {FRAME}) + 1)) AS it FROM photons GROUP BY obsid) f
        LEFT JOIN (SELECT obsid, t_us // {FRAME} AS it, count(*) AS n FROM photons WHERE pi > 10000 AND pi < 12000 GROUP BY ALL) h USING (obsid, it)"""),
    "bti": (("hard",), """
        SELECT s.obsid, s.start, e.stop FROM
          (SELECT obsid, row_number() OVER (PARTITION BY obsid ORDER BY it) AS k, coalesce(p, it) AS start FROM
             (SELECT *, n > 0 AS bad, lag(n > 0) OVER w AS b, lag(it) OVER w AS p FROM hard WINDOW w AS (PARTITION BY obsid ORDER BY it)) WHERE bad AND NOT coalesce(b, false)) s
          JOIN (SELECT obsid, row_number() OVER (PARTITION BY obsid ORDER BY it) AS k, it AS stop FROM
             (SELECT *, n > 0 AS bad, lead(n > 0) OVER (PARTITION BY obsid ORDER BY it) AS a FROM hard) WHERE bad AND NOT coalesce(a, false)) e USING (obsid, k)"""),
    "curves": (("dense",), """
        SELECT obsid AS runid, ix * 100 + iy AS label, it, n, (sum(n) OVER (PARTITION BY obsid, ix, iy) * sum(n) OVER (PARTITION BY obsid, it))::DOUBLE / (sum(n) OVER (PARTITION BY obsid))::DOUBLE AS mu,
               it % 4 = 0 AS bti FROM dense"""),
    "flagged": (("image",), """
        SELECT i.* FROM (SELECT *, (max_n - mean_n) * std_n AS v FROM image) i
        JOIN (SELECT obsid, quantile_cont(total, 0.7) AS q FROM image GROUP BY obsid) l USING (obsid) WHERE i.total > l.q"""),
    "lists": ((), """
        SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS obsid, 'P' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS evt_file, ['EPN', 'EMOS1', 'EMOS2'][o_orderkey % 3 + 1] AS instrument,
               ['PrimeFullWindow', 'PrimeLargeWindow', 'FastTiming', 'PrimeFullWindowExtended'][o_orderkey % 4 + 1] AS submode, o_orderkey % 60 AS revolution, CAST(floor(o_totalprice) AS BIGINT) AS exposure, lo, hi
        FROM orders JOIN (SELECT l_orderkey, min(epoch_us(l_shipdate) // 86400000000) AS lo, max(epoch_us(l_shipdate) // 86400000000) AS hi FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""),
    "islands": (("lists",), """
        SELECT * EXCLUDE fresh, CAST(sum(fresh) OVER (PARTITION BY obsid ORDER BY lo, hi, evt_file) AS BIGINT) AS island FROM
          (SELECT *, CASE WHEN coalesce(lo > max(hi) OVER (PARTITION BY obsid ORDER BY lo, hi, evt_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS fresh FROM lists)"""),
    "hot": ((), """
        SELECT p_partkey % 64 AS rawx, (p_partkey * 3) % 200 AS rawy, p_partkey % 12 + 1 AS ccdnr, p_size % 20 AS rev1, p_size % 20 + 25 AS rev2 FROM part WHERE p_partkey % 4 = 0"""),
    "regions": ((), """
        SELECT region, obsid, t_bin, obsid || '_0_' || t_bin || '_' || band AS runid, label, intensity, area_bbox, x_img, y_img, segment,
               ((region // 2 * 61803) % 100000) * 0.0036::DOUBLE + (region % 2) * 0.001::DOUBLE AS ra_deg, ((region // 2 * 38197) % 100000) * 0.0016::DOUBLE - 80.0::DOUBLE + (region % 2) * 0.002::DOUBLE AS dec_deg,
               obsid || '_0_' || t_bin || '_' || band || '_' || label AS detid
        FROM (SELECT c_custkey AS region, lpad(CAST(c_nationkey * 10 + c_custkey % 10 AS VARCHAR), 10, '0') AS obsid, [5, 50, 200][c_custkey % 3 + 1] AS t_bin,
                     ['0.2_2.0', '2.0_12.0', '0.2_12.0'][c_custkey // 3 % 3 + 1] AS band, c_custkey % 7 AS label, CAST(floor(abs(c_acctbal)) AS BIGINT) AS intensity,
                     c_custkey % 30 + 1 AS area_bbox, (c_custkey * 37) % 1000 AS x_img, (c_custkey * 53) % 1000 AS y_img, c_mktsegment AS segment FROM customer)"""),
    "catalogue": ((), """
        SELECT cat_id, flux, var_flag, ((k // 2 * 61803) % 100000) * 0.0036::DOUBLE + (k % 2) * 0.001::DOUBLE + 0.0005::DOUBLE AS ra_deg,
               ((k // 2 * 38197) % 100000) * 0.0016::DOUBLE - 80.0::DOUBLE + (k % 2) * 0.002::DOUBLE + (cat_id % 5) * 0.002::DOUBLE AS dec_deg
        FROM (SELECT s_suppkey AS cat_id, CAST(floor(abs(s_acctbal)) AS BIGINT) AS flux, s_suppkey % 2 = 0 AS var_flag, s_suppkey * 10 AS k FROM supplier)"""),
    "pairs": (("regions", "catalogue"), f"""
        SELECT * FROM (SELECT r.region, c.cat_id, round({{SEP}}, 6) AS sep, round((r.ra_deg - c.ra_deg) * cos(radians(r.dec_deg)), 9) AS ra_offset, round(r.dec_deg - c.dec_deg, 9) AS dec_offset
        FROM regions r, catalogue c)"""),
    "unique_sources": (("regions",), """
        SELECT u.first, u.ra_deg, u.dec_deg, u.n_chosen, l.members FROM (
          SELECT first, round(avg(ra_deg), 9) AS ra_deg, round(avg(dec_deg), 9) AS dec_deg, count(*) AS n_chosen FROM (
            SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2), 18), first) AS r FROM (
              SELECT *, avg(x) OVER (PARTITION BY first) AS mx, avg(y) OVER (PARTITION BY first) AS my, avg(z) OVER (PARTITION BY first) AS mz FROM (
                SELECT first, region, ra_deg, dec_deg, cos(radians(dec_deg)) * cos(radians(ra_deg)) AS x, cos(radians(dec_deg)) * sin(radians(ra_deg)) AS y, sin(radians(dec_deg)) AS z
                FROM (SELECT first, unnest(members) AS region FROM cl) JOIN regions USING (region)))) WHERE r = 1 GROUP BY first) u JOIN cl l USING (first)"""),
}

#: The factors by another formula than the folds: logarithms of gamma functions, the greatest term taken out.
TERMS_PEAK = "list_transform(range(0, {n} + 1), lambda j: lgamma({n} + 1) - lgamma({n} - j + 1) - j * ln({mu}))"
TERMS_ECLIPSE = "list_transform(range(1, CAST(greatest({mu} - {n}, 0) + 10 * sqrt({mu}) + 80 AS BIGINT)), lambda j: j * ln({mu}) + lgamma({n} + 1) - lgamma({n} + j + 1))"


TOP_PEAK, TOP_ECLIPSE = "CAST(greatest(0, {n} - {mu}) AS BIGINT)", "CAST(greatest(1, {mu} - {n}) AS BIGINT)"


def factor(kind: str, n: str = "n", mu: str = "mu") -> str:
    if kind == "peak":
        j = TOP_PEAK.format(n=n, mu=mu)
        top, terms = f"(lgamma({n} + 1) - lgamma({n} - {j} + 1) - {j} * ln({mu}))", TERMS_PEAK.format(n=n, mu=mu)
    else:
        j = TOP_ECLIPSE.format(n=n, mu=mu)
        top, terms = f"({j} * ln({mu}) + lgamma({n} + 1) - lgamma({n} + {j} + 1))", TERMS_ECLIPSE.format(n=n, mu=mu)
    return f"(({top} + ln(list_sum(list_transform({terms}, lambda t: exp(t - {top}))))) / ln(10.0::DOUBLE))"


def summed(terms: str, n: str = "n", mu: str = "mu") -> str:
    """The same where no term overflows."""
    return f"log10(list_sum(list_transform({terms.format(n=n, mu=mu)}, lambda t: exp(t))))"


SEP = "degrees(2 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(c.dec_deg - r.dec_deg) / 2), 2) + cos(radians(r.dec_deg)) * cos(radians(c.dec_deg)) * pow(sin(radians(c.ra_deg - r.ra_deg) / 2), 2))))) * 3600"
PARTS["crossed"] = ((), f"""
        SELECT kind, n, exp(lo) * (1 - 1e-9::DOUBLE) AS m FROM bisected WHERE i = 50""")
PARTS["bisected"] = ((), f"""
        SELECT kind, n, 0 AS i, ln(1e-9::DOUBLE) AS lo, ln(1400.0::DOUBLE) AS hi FROM (SELECT unnest(['p', 'e']) AS kind), (SELECT unnest(range(0, 1142)) AS n) WHERE kind = 'e' OR n > 0
        UNION ALL SELECT kind, n, i + 1, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END FROM (
          SELECT *, CASE kind WHEN 'p' THEN log10(list_sum(list_transform(range(0, n + 1), lambda j: exp(least(700.0::DOUBLE, lgamma(n + 1) - lgamma(n - j + 1) - j * mid))))) > 5.94096891658419::DOUBLE
                            ELSE log10(list_sum(list_transform(range(1, 700), lambda j: exp(least(700.0::DOUBLE, j * mid + lgamma(n + 1) - lgamma(n + j + 1)))))) < 5.708917345972507::DOUBLE END AS below
          FROM (SELECT *, (lo + hi) / 2 AS mid FROM bisected) WHERE i < 50)""")
PARTS["crossed"] = (("bisected",), PARTS["crossed"][1])
PARTS["knots"] = (("crossed",), """
        SELECT g.k, g.mu, CASE WHEN k < 50000 THEN p.n ELSE CAST(ceil((2 * mu + 9 + sqrt(72 * mu + 81)) / 2) AS BIGINT) END AS n_peak, CASE WHEN k < 50000 THEN e.n ELSE CAST(floor((2 * mu + 9 - sqrt(72 * mu + 81)) / 2) AS BIGINT) END AS n_eclipse
        FROM (SELECT k, CASE WHEN k < 50000 THEN pow(10.0::DOUBLE, -7 + 10 * k / 49999.0::DOUBLE) ELSE pow(10.0::DOUBLE, 3 + 3 * (k - 50000) / 999.0::DOUBLE) END AS mu FROM (SELECT unnest(range(51000)) AS k)) g
        ASOF LEFT JOIN (SELECT n, m FROM crossed WHERE kind = 'p') p ON g.mu < p.m ASOF LEFT JOIN (SELECT n, m FROM crossed WHERE kind = 'e') e ON g.mu < e.m""")
PARTS["stairs"] = ((), f"""
        SELECT 'p' AS kind, round({factor("peak", "n", "1000.0::DOUBLE")}, 9) AS b, sqrt(pow(greatest(n - 1001, 0), 2) / (greatest(n - 1001, 0) + 2000)) AS sigma FROM (SELECT unnest(range(1000, 1502)) AS n)
        UNION ALL SELECT 'e', round({factor("eclipse", "n", "1000.0::DOUBLE")}, 9), sqrt(pow(greatest(999 - n, 0), 2) / (2000 - greatest(999 - n, 0))) FROM (SELECT unnest(range(590, 1001)) AS n)""")
PARTS["pairs"] = (PARTS["pairs"][0], PARTS["pairs"][1].replace("{SEP}", SEP))
PARTS["cl"] = (("regions",), f"""
        SELECT members, min(region) AS first FROM (
          SELECT region, list_sort(list(other)) AS members FROM (SELECT r.region, c.region AS other FROM regions r, regions c WHERE round({SEP}, 6) <= 20.0) GROUP BY region) GROUP BY members""")  # fmt: skip
PARTS["unique_sources"] = (("regions", "cl"), PARTS["unique_sources"][1])


def put(final: str, *names: str, **more: str) -> str:
    """A query that ends with ``final`` and reads the named parts; ``more`` are parts of its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in PARTS[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({PARTS[n][1].strip()})" for n in order] + [f"{n} AS ({b})" for n, b in more.items()]
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + final
