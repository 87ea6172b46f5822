"""The views of ``isotherm.sources.tables`` as SQL text, for comparison runs."""

from __future__ import annotations

from isotherm.schemas import BAND_COLUMNS, LEVELS

_LEVEL_LIST = "[" + ", ".join(str(p) for p in LEVELS) + "]"
_HEADS = ", ".join(
    f"floor((p.hres + m.q[{i + 1}]) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS {c}" for i, c in enumerate(BAND_COLUMNS)
)

VIEWS = {
    "cell_day": """
SELECT concat('c', l_suppkey // 20) AS cell_key, CAST(l_shipdate AS DATE) AS date,
       max(l_quantity) AS tmax_C, min(l_quantity) AS tmin_C,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_discount * 100) AS BIGINT) ELSE 0 END) AS DOUBLE) AS precip_mm,
       max(l_extendedprice) / 3600 AS wind_max_ms,
       CASE WHEN CAST(l_shipdate AS DATE) < DATE '2001-01-01' THEN 'archive'
            WHEN CAST(l_shipdate AS DATE) < DATE '2001-05-01' THEN 'recent' ELSE 'forecast' END AS tier
FROM lineitem GROUP BY ALL
""",
    "tier_rows": """
SELECT cell_key, date, tmax_C + s AS tmax_C, tmin_C + s AS tmin_C, precip_mm + s AS precip_mm, wind_max_ms + s AS wind_max_ms, t.tier
FROM cell_day JOIN (VALUES ('archive', DATE '1990-01-01', DATE '2001-01-01', 0.0::DOUBLE),
                           ('recent', DATE '2000-12-15', DATE '2001-05-01', 0.5::DOUBLE),
                           ('forecast', DATE '2001-04-15', DATE '2010-01-01', 1.0::DOUBLE)) t(tier, a, b, s)
  ON date >= a AND date < b
""",
    "pairs_wide": """
SELECT concat('c', l_suppkey // 20) AS cell_key, CAST(l_shipdate AS DATE) AS date,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS DOUBLE) / (count(*) * 1.0007e7) AS era5_tmax,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 1.0007e5) AS hres_tmax,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_discount * 100) AS BIGINT) ELSE 0 END) AS DOUBLE) AS era5_precip,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_tax * 100) AS BIGINT) ELSE 0 END) AS DOUBLE) AS hres_precip,
       max(l_extendedprice) / 3600 AS era5_wind,
       CAST(max(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 + CAST(round(l_tax * 100) AS BIGINT))) AS DOUBLE) / 3.7e7 AS hres_wind
FROM lineitem GROUP BY ALL
""",
    "pairs": "SELECT cell_key, date, era5_tmax AS era5, hres_tmax AS hres FROM pairs_wide",
    "pairs_long": """
SELECT cell_key, date, 'tmax' AS metric, era5_tmax AS archive, hres_tmax AS hres FROM pairs_wide
UNION ALL SELECT cell_key, date, 'precip', era5_precip, hres_precip FROM pairs_wide
UNION ALL SELECT cell_key, date, 'wind', era5_wind, hres_wind FROM pairs_wide
""",
    "wet_pairs": """
SELECT cell_key, date, CASE WHEN era5_precip < 1 THEN 0.0::DOUBLE ELSE era5_precip END AS era5,
       CASE WHEN hres_precip < 1 THEN 0.0::DOUBLE ELSE hres_precip END AS hres FROM pairs_wide
""",
    "hourly": """
SELECT cell_key, ts, t2m,
       CAST(sum(c) OVER (PARTITION BY cell_key, CAST(ts - INTERVAL 1 HOUR AS DATE) ORDER BY ts) AS DOUBLE) / 1.3e8 AS tp, u10, v10
FROM (SELECT concat('c', user_id // 75) AS cell_key, date_trunc('hour', ts) AS ts,
             273.15 + CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 2300 AS t2m,
             sum(CAST(round(value * 100) AS BIGINT)) AS c,
             CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 5000 AS u10,
             max(value) / 60 AS v10
      FROM events GROUP BY 1, 2)
""",
    "hits": """
SELECT event_id, ts, CAST(user_id // 15 AS VARCHAR) AS visitor,
       CASE WHEN event_type = 'click' THEN 'search' ELSE event_type END AS kind,
       CASE WHEN k % 10 = 9 THEN concat('/', k % 90, '.5,', k, '.5')
            ELSE concat('/', k % 90, '.5,', k, '.5/', CAST(CAST(ts AS DATE) AS VARCHAR), '/',
                        CASE k % 4 WHEN 0 THEN 'tmax' WHEN 1 THEN 'tmin' WHEN 2 THEN 'precip' ELSE 'wind' END) END AS page,
       concat('N', user_id % 12) AS country,
       concat('10.0.', k, '.', user_id % 250) AS ip,
       concat('https://site', k % 7, '.example.org/a?b=1') AS referer_url,
       CASE user_id % 5 WHEN 0 THEN 'Amazon.com, Inc.' WHEN 1 THEN 'Cloudflare, Inc.' WHEN 2 THEN 'Example Telecom'
            WHEN 3 THEN 'City Broadband' ELSE 'Hetzner Online' END AS asn_org,
       CASE k % 5 WHEN 0 THEN 'Mozilla/5.0 (X11) AppleWebKit/537 Chrome/126 Safari/537'
            WHEN 1 THEN 'Mozilla/5.0 (iPhone) Version/17 Safari/604' WHEN 2 THEN 'python-requests/2.31'
            WHEN 3 THEN 'SomeClient/1.0' ELSE 'Mozilla/5.0 (compatible; Googlebot/2.1)' END AS ua,
       CASE WHEN event_type = 'click' THEN concat('town ', k) END AS query,
       CASE WHEN event_type = 'click' AND k % 6 <> 0 THEN concat('Town ', k) END AS matched,
       CASE WHEN event_type = 'click' AND k % 6 <> 0 THEN concat('Cell ', k % 20) END AS served,
       CASE WHEN event_type = 'click' AND k % 6 <> 0 THEN value * 3 END AS dist_km
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
""",
    "cells": """
SELECT c_custkey AS cell_id, round(((c_custkey * 37) % 1400) / 10.0 - 57, 1) AS lat,
       round(((c_custkey * 91) % 3600) / 10.0 - 180, 1) AS lon,
       CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS population, c_name AS name, c_nationkey AS country,
       concat(c_mktsegment, ', Land ', c_nationkey) AS label
FROM customer
""",
    "gazetteer": """
SELECT s_suppkey AS place_id, round(round(((s_suppkey * 53) % 1400) / 10.0 - 57, 1) + 0.03, 2) AS lat,
       round(round(((s_suppkey * 97) % 3600) / 10.0 - 180, 1) + 0.03, 2) AS lon,
       CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS population, concat('Place ', s_suppkey % 40) AS name,
       s_nationkey AS cc
FROM supplier
""",
    "gridpoints": """
SELECT p_partkey // 2500 AS tile, CAST((p_partkey % 2500) // 50 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col,
       p_size >= 10 AS land
FROM part
""",
    "grid_targets": """
SELECT c_custkey AS cell_id, c_custkey // 1875 AS tile, CAST((c_custkey * 37) % 40 AS INT) AS row,
       CAST((c_custkey * 91) % 50 AS INT) AS col
FROM customer
""",
    "pixels": """
SELECT round(((o_orderkey * 37) % 14000) / 100.0 - 57, 2) AS lat, round(((o_orderkey * 91) % 36000) / 100.0 - 180, 2) AS lon,
       o_totalprice * CASE WHEN o_orderstatus = 'P' THEN -1.0 ELSE 1.0 END AS pop
FROM orders
""",
    "static": """
SELECT concat('c', k) AS cell_key, lat, lon, population, CAST(population % 3000 AS DOUBLE) AS elevation,
       CAST((population * 7) % 3000 AS DOUBLE) AS hres_elevation, lat + 0.04 AS hres_lat, lon - 0.03 AS hres_lon,
       concat('Town ', k) AS name
FROM (SELECT s_suppkey // 20 AS k, round(((s_suppkey // 20 * 137) % 1400) / 10.0 - 57, 1) AS lat,
             round(((s_suppkey // 20 * 291) % 3600) / 10.0 - 180, 1) AS lon,
             CAST(sum(abs(CAST(round(s_acctbal * 100) AS BIGINT))) AS BIGINT) AS population
      FROM supplier GROUP BY 1, 2, 3)
""",
    "banded": f"""
SELECT p.cell_key, p.date, p.era5 AS truth, p.hres, {_HEADS}
FROM pairs p JOIN (SELECT cell_key, month(date) AS mo, quantile_cont(era5 - hres, {_LEVEL_LIST}) AS q FROM pairs GROUP BY 1, 2) m
  ON p.cell_key = m.cell_key AND month(p.date) = m.mo
""",
    "role_blocks": """
SELECT cell_key, date, era5, hres, era5 - hres AS bias, (year(date) - oy) * 12 + month(date) - om AS block
FROM pairs, (SELECT year(min(date)) AS oy, month(min(date)) AS om FROM pairs)
""",
    "block_roles": """
SELECT block, CASE WHEN (rn - 1) % 5 = 0 THEN 'test'
                   WHEN (rn - 1 - ((rn - 1) // 5 + 1)) % 4 = 0 THEN 'val' ELSE 'train' END AS role
FROM (SELECT block, row_number() OVER (ORDER BY block) AS rn FROM (SELECT DISTINCT block FROM role_blocks))
""",
    "split_pairs": """
SELECT b.cell_key, b.date, b.era5, b.hres, b.bias, b.block,
       CASE WHEN r.role = 'train' AND EXISTS (
              SELECT 1 FROM (SELECT DISTINCT h.date FROM role_blocks h JOIN block_roles hr ON h.block = hr.block AND hr.role <> 'train') x
              WHERE x.date BETWEEN b.date - 3 AND b.date + 3) THEN 'embargo' ELSE r.role END AS role
FROM role_blocks b JOIN block_roles r ON b.block = r.block
""",
    "labelled": """
SELECT *, CASE WHEN u <= 0.1 THEN 'low' WHEN u >= 0.9 THEN 'high' ELSE 'mid' END AS dec,
       CASE WHEN u <= 0.01 THEN 'p01' WHEN u >= 0.99 THEN 'p99' ELSE 'mid' END AS dec1,
       CASE WHEN f <= 0.1 THEN 'low' WHEN f >= 0.9 THEN 'high' ELSE 'mid' END AS fdec
FROM (SELECT *, (rank() OVER (PARTITION BY cell_key, season ORDER BY era5)
                 + (count(*) OVER (PARTITION BY cell_key, season, era5) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY cell_key, season) AS u,
              (rank() OVER (PARTITION BY cell_key, season ORDER BY hres)
                 + (count(*) OVER (PARTITION BY cell_key, season, hres) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY cell_key, season) AS f
      FROM (SELECT *, CASE month(date) % 12 // 3 WHEN 0 THEN 'DJF' WHEN 1 THEN 'MAM' WHEN 2 THEN 'JJA' ELSE 'SON' END AS season,
                   CASE WHEN date >= DATE '2000-06-01' THEN 'v3' WHEN date >= DATE '1998-01-01' THEN 'v2' ELSE 'v1' END AS fc_version
            FROM split_pairs))
""",
}
