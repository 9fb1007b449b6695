"""Range maps."""

from pyspark.sql import functions as F

from fieldmark.functions import arrays
from fieldmark.operators import encounter, ranges
from fieldmark.plans.catalog import query

# even-odd rule with edge points left out, over the polygon edges
INSIDE_SITE = """
SELECT site_key, hotspot_id, species_idx, bool_or(inside) AS in_range FROM (
  SELECT s.site_key, s.hotspot_id, p.species_idx, p.part,
         (sum(CASE WHEN (ay > lat) <> (b_y > lat) AND lon < (bx - ax) * (lat - ay) / nullif(b_y - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1) AS inside
  FROM fx_site s CROSS JOIN fx_poly p GROUP BY s.site_key, s.hotspot_id, p.species_idx, p.part) t
GROUP BY site_key, hotspot_id, species_idx"""
INSIDE_LOC = INSIDE_SITE.replace("fx_site", "fx_loc").replace("site_key", "loc_key")
MASK = f"""
SELECT l.hotspot_id, l.loc_key, s.species_idx, coalesce(i.in_range, TRUE) AS mask
FROM fx_loc l CROSS JOIN fx_list s LEFT JOIN ({INSIDE_LOC}) i ON i.loc_key = l.loc_key AND i.species_idx = s.species_idx"""


@query("range_membership", f"SELECT hotspot_id, species_idx, in_range FROM ({INSIDE_SITE}) q", bigints="species_idx")
def range_membership(d):
    masks = ranges.range_masks(d.site, d.polygon, d.species_list)
    long = masks.select("hotspot_id", arrays.unrolled("in_range", "species_idx", "in_range"))
    return long.filter(F.col("in_range").isNotNull())


@query("range_map_matrix", f"SELECT hotspot_id, species_idx, mask FROM ({MASK}) q", bigints="species_idx")
def range_map_matrix(d):
    masks = ranges.range_masks(d.loc, d.polygon, d.species_list)
    return masks.select("hotspot_id", arrays.unrolled("mask", "species_idx", "mask"))


@query("correct_targets", f"""
SELECT r.hotspot_id, r.species_idx, CASE WHEN mask THEN y ELSE 0e0 END AS rate
FROM fx_rate r JOIN ({MASK}) m ON m.hotspot_id = r.hotspot_id AND m.species_idx = r.species_idx
WHERE r.loc_key % 3 <> 0""", "rate", "species_idx")
def correct_targets(d):
    done = d.loc.filter(F.col("loc_key") % 3 == 0)
    masks = ranges.range_masks(d.loc, d.polygon, d.species_list)
    return encounter.long_targets(ranges.correct_targets(d.targets.select("hotspot_id", "probs"), masks, done))


@query("mask_pred_and_target", f"""
SELECT r.hotspot_id, r.species_idx // 2 AS place, CASE WHEN mask THEN y ELSE 0e0 END AS y, CASE WHEN mask THEN p ELSE 0e0 END AS p
FROM fx_pred r JOIN ({MASK}) m ON m.hotspot_id = r.hotspot_id AND m.species_idx = r.species_idx WHERE r.species_idx % 2 = 0""",
       "y p", "place")
def mask_pred_and_target(d):
    masks = ranges.range_masks(d.loc, d.polygon, d.species_list)
    size = F.size(F.col("y"))
    subset = F.sequence(F.lit(0), size - 1, F.lit(2))
    masked = ranges.masked_predictions(d.predictions, masks, subset=subset)
    return masked.select("hotspot_id", arrays.unrolled(F.arrays_zip("y", "p"), "place", "c")).select("hotspot_id", "place", "c.y", "c.p")


@query("mask_target_soft", f"""
SELECT r.hotspot_id, r.species_idx, CASE WHEN mask THEN y ELSE 0e0 END AS y, p
FROM fx_pred r JOIN ({MASK}) m ON m.hotspot_id = r.hotspot_id AND m.species_idx = r.species_idx""", "y p", "species_idx")
def mask_target_soft(d):
    masks = ranges.range_masks(d.loc, d.polygon, d.species_list)
    masked = ranges.masked_predictions(d.predictions, masks, soft=True)
    return masked.select("hotspot_id", arrays.unrolled(F.arrays_zip("y", "p"), "species_idx", "c")).select("hotspot_id", "species_idx", "c.y", "c.p")


@query("point_in_polygon", f"SELECT hotspot_id FROM ({INSIDE_SITE}) q WHERE species_idx = 3 AND in_range")
def point_in_polygon(d):
    boundary = d.polygon.filter(F.col("species_idx") == 3)
    return ranges.keep_inside(d.site, boundary, "hotspot_id").select("hotspot_id")
