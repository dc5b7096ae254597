"""Schemas of the domain tables, as Spark reads them; nothing is inferred."""

from __future__ import annotations

PHOTONS = "event_id LONG, obsid STRING, instrument STRING, t_us LONG, ix LONG, iy LONG, x DOUBLE, y DOUBLE, rawx LONG, rawy LONG, ccdnr LONG, pi INT, pattern LONG"
EVENT_LISTS = "obsid STRING, evt_file STRING, instrument STRING, submode STRING, revolution INT, exposure DOUBLE, time_min DOUBLE, time_max DOUBLE"
HOT_PIXELS = "rawx LONG, rawy LONG, ccdnr LONG, rev1 LONG, rev2 LONG"
CUBE = "obsid STRING, ix LONG, iy LONG, it LONG, n LONG, mu DOUBLE"
FRAMES = "obsid STRING, it LONG, is_bti BOOLEAN, exposure DOUBLE"
INTERVALS = "obsid STRING, start DOUBLE, stop DOUBLE"
ALERTS = "obsid STRING, x_cube LONG, y_cube LONG, t_cube LONG, x_lo DOUBLE, x_hi DOUBLE, y_lo DOUBLE, y_hi DOUBLE, t_lo DOUBLE, t_hi DOUBLE, type STRING"
REGIONS = "runid STRING, label LONG, bbox_0 LONG, bbox_1 LONG, bbox_2 LONG, bbox_3 LONG, intensity_mean DOUBLE, ra_deg DOUBLE, dec_deg DOUBLE"
LIGHT_CURVES = "runid STRING, label LONG, it LONG, n LONG, mu DOUBLE, bti BOOLEAN"
