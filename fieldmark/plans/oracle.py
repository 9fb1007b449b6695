"""SQL twins of the input views, composed into stand-alone statements for an independent engine."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "fx_site": """
SELECT c_custkey AS site_key, concat('C', CAST(c_custkey AS STRING)) AS hotspot_id, c_nationkey AS state_key,
       c_acctbal AS acctbal,
       3e1 + ((kk*kk*31 + kk*17) % 1009) * 4e-3 AS lat, -1e2 + ((kk*kk*13 + kk*7919) % 2003) * 4e-3 AS lon
FROM (SELECT *, CASE WHEN c_custkey % 10 = 0 AND c_custkey > 0 THEN c_custkey - 1 ELSE c_custkey END AS kk
      FROM customer) t""",
    "fx_loc": """
SELECT s_suppkey AS loc_key, concat('L', CAST(s_suppkey AS STRING)) AS hotspot_id, n_name AS state, r_name AS country,
       3e1 + ((kk*kk*31 + kk*17) % 1009) * 4e-3 AS lat, -1e2 + ((kk*kk*13 + kk*7919) % 2003) * 4e-3 AS lon
FROM (SELECT *, CASE WHEN s_suppkey % 10 = 0 AND s_suppkey > 0 THEN s_suppkey - 1 ELSE s_suppkey END AS kk
      FROM supplier) t
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fx_obs": """
SELECT concat('O', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS global_id,
       h.hotspot_id, h.loc_key, h.lat, h.lon, h.state, h.country,
       concat('S', CAST(l_orderkey AS STRING)) AS checklist_id, o_custkey AS observer_id,
       CAST(o_orderdate AS DATE) AS obs_date, p_brand AS species,
       CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS complete
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN fx_loc h ON l_suppkey = h.loc_key""",
    "fx_occ": """
SELECT event_id AS occurrence_id, concat(CAST(user_id AS STRING), '_', CAST(CAST(ts AS DATE) AS STRING)) AS event_id,
       CASE WHEN e.event_id % 17 = 0 THEN NULL ELSE event_type END AS species, s.site_key, s.hotspot_id,
       CAST(ts AS DATE) AS occ_date,
       CASE WHEN e.event_id % 5 = 0 THEN 'CA' ELSE 'US' END AS country_code,
       CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE n_name END AS state,
       s.lat + (e.event_id % 21 - 10) * 1e-3 AS lat, s.lon + (e.event_id % 19 - 9) * 1e-3 AS lon
FROM events e JOIN fx_site s ON e.user_id = s.site_key JOIN nation ON s.state_key = n_nationkey""",
    "fx_scene": """
SELECT o_orderkey AS scene_id, o_custkey % 100 AS tile_id, CAST(o_orderdate AS DATE) AS acquired,
       (CAST(round(o_totalprice * 100) AS BIGINT) % 10000) / 1e2 AS cloud
FROM orders""",
    "fx_tile": """
SELECT tile_id, -1e2 + (tile_id % 10) * 8e-1 AS minx, -1e2 + (tile_id % 10) * 8e-1 + 9e-1 AS maxx,
       3e1 + (tile_id // 10) * 4e-1 AS miny, 3e1 + (tile_id // 10) * 4e-1 + 5e-1 AS maxy
FROM (SELECT DISTINCT tile_id FROM fx_scene) t""",
    "fx_list": """
SELECT species, row_number() OVER (ORDER BY species) - 1 AS species_idx
FROM (SELECT p_brand AS species FROM (SELECT p_brand, row_number() OVER (ORDER BY p_brand DESC) AS rk
                                      FROM (SELECT DISTINCT p_brand FROM part) b) c WHERE rk > 3
      UNION ALL SELECT 'Zz absent one' UNION ALL SELECT 'Zz absent two') t""",
    "fx_poly": """
SELECT species_idx, species, part, i AS edge,
       x0 + r * cos(i * pi() / 3e0 + 1e-1) AS ax, y0 + r * 6e-1 * sin(i * pi() / 3e0 + 1e-1) AS ay,
       x0 + r * cos(((i + 1) % 6) * pi() / 3e0 + 1e-1) AS bx, y0 + r * 6e-1 * sin(((i + 1) % 6) * pi() / 3e0 + 1e-1) AS b_y
FROM (SELECT species_idx, species, p AS part, -1e2 + (species_idx % 5) * 15e-1 + 1e0 + p * 2e0 AS x0,
             3e1 + (species_idx // 5) * 7e-1 + 5e-1 AS y0, 8e-1 + species_idx * 3e-2 AS r
      FROM fx_list CROSS JOIN (SELECT unnest(range(2)) AS p) q WHERE species_idx % 8 <> 7 AND (p = 0 OR species_idx % 3 = 0)) s
CROSS JOIN (SELECT unnest(range(6)) AS i) g""",
    "fx_env": """
SELECT vec_id AS env_key, i AS layer,
       CASE WHEN (vec_id*7 + i) % 13 = 0 THEN NULL ELSE CAST(embedding[i+1] AS DOUBLE) * 100 END AS value
FROM embeddings CROSS JOIN (SELECT unnest(range(27)) AS i) g""",
    "fx_patch": """
SELECT vec_id AS patch_key, i // 16 AS band, (i % 16) // 4 AS y, i % 4 AS x,
       CASE WHEN (vec_id + i) % 11 = 0 THEN NULL ELSE CAST(embedding[i+1] AS DOUBLE) END AS value
FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS i) g""",
    "fx_image": """
SELECT vec_id AS patch_key, i // 16 AS band, (i % 16) // 4 AS y, i % 4 AS x,
       1e3 + round(CAST(embedding[i+1] AS DOUBLE) * 1e3) AS value
FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS i) g""",
    "fx_raster": """
SELECT layer, vec_id // 20 AS "row", vec_id % 20 AS col,
       CASE WHEN (vec_id*5 + layer) % 29 = 0 THEN NULL ELSE CAST(embedding[layer+1] AS DOUBLE) * 100 END AS value
FROM embeddings CROSS JOIN (SELECT unnest(range(27)) AS layer) g""",
    "fx_pair": """
SELECT o.loc_key, o.hotspot_id, o.species, o.checklist_id FROM fx_obs o
WHERE complete = 1 AND month(obs_date) IN (6, 7) AND year(obs_date) >= 1996""",
    "fx_n": """
SELECT hotspot_id, loc_key, count(DISTINCT checklist_id) AS n FROM fx_pair GROUP BY hotspot_id, loc_key
HAVING count(DISTINCT checklist_id) > 5""",
    "fx_rate": """
SELECT h.hotspot_id, h.loc_key, h.n, s.species_idx, s.species, coalesce(c.k, 0) / CAST(h.n AS DOUBLE) AS y
FROM fx_n h CROSS JOIN fx_list s
LEFT JOIN (SELECT hotspot_id, species, count(DISTINCT checklist_id) AS k FROM fx_pair GROUP BY hotspot_id, species) c
ON c.hotspot_id = h.hotspot_id AND c.species = s.species""",
    "fx_pred": """
SELECT *, greatest(0e0, least(1e0, y + ((loc_key*31 + species_idx*17) % 101 - 50) / 1013e0)) AS p,
       CASE WHEN loc_key % 10 < 7 THEN 'train' WHEN loc_key % 10 = 7 THEN 'valid' ELSE 'test' END AS split
FROM fx_rate""",
}



def uniform(seed: int, *keys: str) -> str:
    """The portable generator of :func:`fieldmark.functions.arrays.uniform` over whole-number expressions."""
    numbers = ", ".join([f"{seed}::BIGINT", *(f"(({k})::BIGINT % 2147483647 + 2147483647) % 2147483647" for k in keys), "0", "0", "0"])
    return f"(list_reduce([{numbers}], lambda s, k: ((s + k + 1) * 48271 + ((s + k + 1) // 32768) * 40014) % 2147483647) / 2147483647e0)"


def normal(seed: int, *keys: str) -> str:
    return f"(sqrt(-2e0 * ln(greatest({uniform(seed, *keys)}, 1e-12))) * cos(2e0 * pi() * {uniform(seed + 1, *keys)}))"


_NAME = re.compile(r"\bfx_\w+\b")


def _needed(text: str, found: list[str]) -> None:
    for name in _NAME.findall(text):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found.append(name)


def statement(body: str, doubles: str = "", bigints: str = "") -> str:
    """Prefix ``body`` with the views it mentions and fix the output types of its columns."""
    found: list[str] = []
    _needed(body, found)
    body = body.strip()
    if found:
        views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in found)
        tail = body
        if re.match(r"WITH\s+RECURSIVE\s", tail, re.I):
            sql = f"WITH RECURSIVE {views},\n" + re.sub(r"^WITH\s+RECURSIVE\s", "", tail, flags=re.I)
        elif re.match(r"WITH\s", tail, re.I):
            sql = f"WITH {views},\n" + re.sub(r"^WITH\s", "", tail, flags=re.I)
        else:
            sql = f"WITH {views}\n{tail}"
    else:
        sql = body
    casts = [f"round(CAST({c} AS DOUBLE), 6) + 0e0 AS {c}" for c in doubles.split()]
    casts += [f"CAST({c} AS BIGINT) AS {c}" for c in bigints.split()]
    if casts:
        sql = f"SELECT * REPLACE ({', '.join(casts)}) FROM (\n{sql}\n) final_result"
    return sql
