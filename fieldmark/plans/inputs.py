"""Input views: the operators' domain tables derived from the given parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions import arrays
from fieldmark.operators import encounter
from fieldmark.session import materialize, widen

EXCLUDED_STATES = ["NATION_3", "NATION_7"]
SUMMER, WINTER = [6, 7], [12, 1]
#: Log rows of one task of a join or an aggregate, in the mean.
ROWS_PER_TASK = 200_000


def _coordinates(key: Column) -> tuple[Column, Column, Column]:
    """Every tenth key is a coordinate twin of the key before it."""
    kk = F.when((key % 10 == 0) & (key > 0), key - 1).otherwise(key)
    lat = F.lit(30.0) + ((kk * kk * 31 + kk * 17) % 1009) * F.lit(4e-3)
    lon = F.lit(-100.0) + ((kk * kk * 13 + kk * 7919) % 2003) * F.lit(4e-3)
    return kk, lat, lon


def split_of(key: Column) -> Column:
    return F.when(key % 10 < 7, "train").when(key % 10 == 7, "valid").otherwise("test")


class Inputs:
    """Lazily built views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def site(self) -> DataFrame:
        key = F.col("c_custkey")
        _, lat, lon = _coordinates(key)
        return self.table("customer").select(
            key.alias("site_key"), F.concat(F.lit("C"), key.cast("string")).alias("hotspot_id"),
            F.col("c_nationkey").alias("state_key"), F.col("c_acctbal").alias("acctbal"),
            lat.alias("lat"), lon.alias("lon"))

    @cached_property
    def loc(self) -> DataFrame:
        key = F.col("s_suppkey")
        _, lat, lon = _coordinates(key)
        nation, region = self.table("nation"), self.table("region")
        return (self.table("supplier")
                .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
                .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
                .select(key.alias("loc_key"), F.concat(F.lit("L"), key.cast("string")).alias("hotspot_id"),
                        F.col("n_name").alias("state"), F.col("r_name").alias("country"),
                        lat.alias("lat"), lon.alias("lon")))

    @cached_property
    def tasks(self) -> int:
        """Tasks for a shuffle of the log: the session's number, more where the log is too long for that."""
        usual = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(usual, -(-self.table("lineitem").count() // ROWS_PER_TASK))

    def dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows by ``key`` over as many tasks as the log needs; left to the planner where the session's number will do."""
        usual = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(self.tasks, key) if self.tasks > usual else rows

    @cached_property
    def obs(self) -> DataFrame:
        line, orders, part = self.table("lineitem"), self.table("orders"), self.table("part")
        widen(self.spark, self.tasks)
        return (line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                .join(part, F.col("l_partkey") == F.col("p_partkey"))
                .join(self.loc, F.col("l_suppkey") == F.col("loc_key"))
                .select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string"), F.lit("-"),
                                 F.col("l_linenumber").cast("string")).alias("global_id"),
                        "hotspot_id", "loc_key", "lat", "lon", "state", "country",
                        F.concat(F.lit("S"), F.col("l_orderkey").cast("string")).alias("checklist_id"),
                        F.col("o_custkey").alias("observer_id"), F.to_date("o_orderdate").alias("obs_date"),
                        F.col("p_brand").alias("species"),
                        F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("complete")))

    @cached_property
    def occ(self) -> DataFrame:
        e = F.col("event_id")
        return (self.table("events").join(self.site, F.col("user_id") == F.col("site_key"))
                .join(self.table("nation"), F.col("state_key") == F.col("n_nationkey"))
                .select(e.alias("occurrence_id"),
                        F.concat(F.col("user_id").cast("string"), F.lit("_"),
                                 F.to_date("ts").cast("string")).alias("event_id"),
                        F.when(e % 17 != 0, F.col("event_type")).alias("species"), "site_key", "hotspot_id",
                        F.to_date("ts").alias("occ_date"),
                        F.when(e % 5 == 0, "CA").otherwise("US").alias("country_code"),
                        F.when(e % 7 != 0, F.col("n_name")).alias("state"),
                        (F.col("lat") + (e % 21 - 10) * F.lit(1e-3)).alias("lat"),
                        (F.col("lon") + (e % 19 - 9) * F.lit(1e-3)).alias("lon")))

    @cached_property
    def scene(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("scene_id"), (F.col("o_custkey") % 100).alias("tile_id"),
            F.to_date("o_orderdate").alias("acquired"),
            (F.round(F.col("o_totalprice") * 100).cast("bigint") % 10000 / F.lit(100.0)).alias("cloud"))

    @cached_property
    def tile(self) -> DataFrame:
        t = F.col("tile_id")
        minx = F.lit(-100.0) + (t % 10) * F.lit(0.8)
        miny = F.lit(30.0) + F.floor(t / 10) * F.lit(0.4)
        return self.scene.select("tile_id").distinct().select(
            t, minx.alias("minx"), (minx + F.lit(0.9)).alias("maxx"),
            miny.alias("miny"), (miny + F.lit(0.5)).alias("maxy"))

    @cached_property
    def scene_box(self) -> DataFrame:
        """Scenes with their footprint and a closed validity interval of ten days."""
        return self.scene.join(self.tile, "tile_id").select(
            "scene_id", "tile_id", "cloud", "minx", "maxx", "miny", "maxy", "acquired",
            F.col("acquired").alias("mint"), F.date_add("acquired", 10).alias("maxt"))

    @cached_property
    def species_list(self) -> DataFrame:
        """Ordered species list: the brands but the last three, plus two names nobody reports."""
        brands = self.table("part").select(F.col("p_brand").alias("species"))
        ranked = encounter.species_dimension(brands).withColumn("total", F.count("*").over(encounter.whole_list()))
        kept = ranked.filter(F.col("species_idx") < F.col("total") - 3).select("species")
        absent = brands.agg(F.count("*")).select(F.explode(F.array(F.lit("Zz absent one"), F.lit("Zz absent two"))).alias("species"))
        # a species list is a stored file in practice; written once, every use reads a few known bytes
        return materialize(encounter.species_dimension(kept.unionByName(absent)), "species-list")

    @cached_property
    def polygon(self) -> DataFrame:
        """Hexagonal range polygons; every eighth species has none, every third has two parts."""
        idx = F.col("species_idx")
        x0 = F.lit(-100.0) + (idx % 5) * F.lit(1.5) + F.lit(1.0) + F.col("part") * F.lit(2.0)
        y0 = F.lit(30.0) + F.floor(idx / 5) * F.lit(0.7) + F.lit(0.5)
        r = F.lit(0.8) + idx * F.lit(3e-2)

        def corner(i: Column) -> Column:
            angle = i * F.pi() / F.lit(3.0) + F.lit(0.1)
            return F.struct((x0 + r * F.cos(angle)).alias("lon"), (y0 + r * F.lit(0.6) * F.sin(angle)).alias("lat"))

        parts = F.when(idx % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        ring = F.transform(F.sequence(F.lit(0), F.lit(5)), corner)
        return (self.species_list.filter(idx % 8 != 7).withColumn("part", F.explode(parts))
                .select(idx, "species", "part", F.array(ring).alias("rings")))

    @cached_property
    def env(self) -> DataFrame:
        """Long point table of 27 environmental layers."""
        return (self.table("embeddings").select(F.col("vec_id").alias("env_key"), F.posexplode("embedding").alias("layer", "v"))
                .filter(F.col("layer") < 27)
                .select("env_key", F.col("layer").cast("bigint").alias("layer"),
                        F.when((F.col("env_key") * 7 + F.col("layer")) % 13 != 0, F.col("v").cast("double") * 100).alias("value")))

    @cached_property
    def env_wide(self) -> DataFrame:
        """Same values, one array per point."""
        key = F.col("vec_id")
        values = F.transform(F.slice("embedding", 1, 27), lambda v, i: F.when(
            (key * 7 + i) % 13 != 0, v.cast("double") * 100))
        return self.table("embeddings").select(key.alias("env_key"), "label", values.alias("env"))

    @cached_property
    def patch(self) -> DataFrame:
        """4 bands of 4 x 4 pixels with gaps."""
        key = F.col("vec_id")
        data = F.transform("embedding", lambda v, i: F.when((key + i) % 11 != 0, v.cast("double")))
        return self.table("embeddings").select(key.alias("patch_key"), arrays.patch(data, 4, 4, 4).alias("img"))

    @cached_property
    def image(self) -> DataFrame:
        """4 bands of 4 x 4 whole-number reflectances without gaps."""
        data = F.transform("embedding", lambda v: F.lit(1e3) + F.round(v.cast("double") * 1e3))
        return self.table("embeddings").select(F.col("vec_id").alias("patch_key"), arrays.patch(data, 4, 4, 4).alias("img"))

    @cached_property
    def raster(self) -> DataFrame:
        """27 stacked layers on a grid of 20 columns, one source vector per pixel."""
        key = F.col("vec_id")
        values = F.transform(F.slice("embedding", 1, 27), lambda v, i: F.when(
            (key * 5 + i) % 29 != 0, v.cast("double") * 100))
        return self.table("embeddings").select(F.floor(key / 20).alias("row"), (key % 20).alias("col"), values.alias("values"))

    @cached_property
    def season_obs(self) -> DataFrame:
        return self.obs.filter((F.col("complete") == 1) & F.month("obs_date").isin(SUMMER) & (F.year("obs_date") >= 1996))

    @cached_property
    def targets(self) -> DataFrame:
        """One row per hotspot: dense rate vector over the species list, checklist count."""
        return encounter.encounter_targets(self.season_obs, self.species_list, min_checklists=5)

    @cached_property
    def predictions(self) -> DataFrame:
        """Target vectors ``y`` beside synthetic predictions ``p`` and a split label."""
        key = F.substring("hotspot_id", 2, 20).cast("bigint")
        # a prime divisor keeps means of these values off the decimal ties where rounded comparisons are ambiguous
        pred = F.transform("probs", lambda y, i: F.greatest(F.lit(0.0), F.least(
            F.lit(1.0), y + ((key * 31 + i * 17) % 101 - 50) / F.lit(1013.0))))
        return self.targets.select("hotspot_id", key.alias("loc_key"), F.col("num_complete_checklists").alias("n"),
                                   F.col("probs").alias("y"), pred.alias("p"), split_of(key).alias("split"))
