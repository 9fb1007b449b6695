"""Patches, transforms, scores, time and files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.functions import arrays, scores, time, transforms
from fieldmark.operators import baselines, metrics, raster, samples
from fieldmark.sources import readers, writers


def image(spark, array):
    n, h, w = array.shape
    data = [None if math.isnan(v) else float(v) for v in array.ravel()]
    df = spark.createDataFrame([(1, data)], "k int, data array<double>")
    return df.select("k", arrays.patch(F.col("data"), n, h, w).alias("img"))


def result(df, column):
    r = df.select(column.alias("r")).first()["r"]
    return np.array([math.nan if v is None else v for v in r["data"]]).reshape(r["bands"], r["h"], r["w"])


BASE = np.arange(2 * 5 * 6, dtype=float).reshape(2, 5, 6) ** 1.5


def test_flips_crops_and_bands(spark):
    df, img = image(spark, BASE), F.col("img")
    np.testing.assert_allclose(result(df, transforms.hflip(img)), BASE[:, :, ::-1])
    np.testing.assert_allclose(result(df, transforms.vflip(img)), BASE[:, ::-1])
    np.testing.assert_allclose(result(df, transforms.center_crop(img, 3, 2)), BASE[:, 1:4, 2:4])
    np.testing.assert_allclose(result(df, transforms.center_crop_half(img, 2)), BASE[:, 1:3, 2:4])
    np.testing.assert_allclose(result(df, transforms.reorder_bands(img, [1, 0])), BASE[::-1])
    # chained transforms read each other's output
    np.testing.assert_allclose(result(df, transforms.hflip(transforms.vflip(transforms.center_crop(img, 3, 2)))), BASE[:, 1:4, 2:4][:, ::-1, ::-1])


def test_bilinear_and_blur_against_numpy(spark):
    df, img = image(spark, BASE), F.col("img")

    def taps(n, size):
        s = np.maximum(0, (np.arange(size) + 0.5) * n / size - 0.5)
        a = np.floor(s).astype(int)
        return a, np.minimum(a + 1, n - 1), s - a

    ya, yb, fy = taps(5, 7)
    xa, xb, fx = taps(6, 4)
    rows = BASE[:, :, xa] * (1 - fx) + BASE[:, :, xb] * fx
    want = rows[:, ya] * (1 - fy)[:, None] + rows[:, yb] * fy[:, None]
    np.testing.assert_allclose(result(df, transforms.resize_bilinear(img, 7, 4)), want)
    k = np.exp(-0.5 * (np.arange(-1, 2) / 0.8) ** 2)
    k /= k.sum()
    padded = np.pad(BASE, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    want = sum(k[i] * k[j] * padded[:, i:i + 5, j:j + 6] for i in range(3) for j in range(3))
    np.testing.assert_allclose(result(df, transforms.gaussian_blur(img, 3)), want)


def test_gap_filling(spark):
    gaps = BASE.copy()
    gaps[0, 2, 3] = math.nan
    gaps[1] = math.nan
    df, img = image(spark, gaps), F.col("img")
    filled = result(df, raster.interpolate_gaps(img))
    assert filled[0, 2, 3] == pytest.approx((BASE[0, 2, [2, 4]].mean() + BASE[0, [1, 3], 3].mean()) / 2)
    assert np.isnan(filled[1]).all()
    mean = result(df, raster.fill_means(raster.interpolate_gaps(img), arrays.literal_vector([0, 9])))
    assert (mean[1] == 9).all()
    clipped = result(df, raster.clip_layers(img, arrays.literal_vector([5, 0]), arrays.literal_vector([20, 1])))
    assert np.nanmin(clipped[0]) == 5 and np.nanmax(clipped[0]) == 20 and np.isnan(clipped[1]).all()


def test_random_steps_stay_in_bounds_and_repeat(spark):
    df = image(spark, BASE).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50))))
    img, key = F.col("img"), F.col("k")
    crops = df.select("k", transforms.random_crop(img, 2, 3, 1, key)["data"].alias("d")).collect()
    windows = {tuple(BASE[:, t:t + 2, l:l + 3].ravel()) for t in range(3) for l in range(3)}
    assert all(tuple(r["d"]) in windows for r in crops) and len({tuple(r["d"]) for r in crops}) > 3
    again = df.repartition(5).select("k", transforms.random_crop(img, 2, 3, 1, key)["data"].alias("d")).collect()
    assert sorted(crops) == sorted(again)
    noisy = np.array([r[0] for r in df.select(transforms.noise(img, 1e-2, 2e-2, 3, key)["data"]).collect()]) - BASE.ravel()
    assert noisy.min() >= -1e-9 and noisy.max() <= 2e-2 + 1e-9 and (noisy > 1e-4).any()
    flipped = df.select(samples.gated(img, transforms.hflip(img), 0.5, 2, key)["data"][0].alias("v")).collect()
    assert 5 < sum(r["v"] == BASE[0, 0, 0] for r in flipped) < 45


def test_kl_and_cross_entropy_limits(spark):
    df = spark.createDataFrame([(0.0, 0.3), (0.5, 0.0), (1.0, 1.0)], "y double, p double")
    kl = [r[0] for r in df.select(scores.kl_bernoulli(F.col("y"), F.col("p"))).collect()]
    assert kl[0] == pytest.approx(math.log(1 / 0.7)) and kl[1] == math.inf and kl[2] == 0
    ce = [r[0] for r in df.select(scores.cross_entropy(F.col("y"), F.col("p"))).collect()]
    assert ce[1] == math.inf and math.isnan(ce[2])
    assert df.select(scores.clipped_cross_entropy(F.col("y"), F.col("p"))).collect()[2][0] is None


def test_ranking_scores(spark):
    y = [0.5, 0.4, 0.3] + [0.0] * 12
    p = [0.0, 0.9, 0.8, 0.7, 0.6] + [0.5] * 5 + [0.1] * 5
    df = spark.createDataFrame([(y, p), ([0.0] * 15, p), (y, y)], "y array<double>, p array<double>")
    c = F.col
    rows = df.select(scores.top_overlap(c("y"), c("p")).alias("k"), scores.top_overlap(c("y"), c("p"), 10).alias("wide"),
                     scores.top_overlap(c("y"), c("p"), 10, True).alias("both"), scores.hits_in_present(c("y"), c("p")).alias("h")).collect()
    assert rows[0]["k"] == pytest.approx(2 / 3) and rows[0]["wide"] == pytest.approx(2 / 3) and rows[0]["both"] == pytest.approx(2 / 3)
    assert rows[1]["k"] is None and rows[1]["h"] == -1 and rows[2]["k"] == 1
    mean = metrics.ranking(df, metrics.top_variants()).first()
    assert mean["topk"] == pytest.approx((2 / 3 + 1) / 2)


@pytest.mark.parametrize("text, fmt, start, end", [
    ("2021-12", "%Y-%m", "2021-12-01", "2022-01-01"), ("2020", "%Y", "2020-01-01", "2021-01-01"), ("20200229", "%Y%m%d", "2020-02-29", "2020-03-01"),
    ("2020-02-29 23", "%Y-%m-%d %H", "2020-02-29 23:00", "2020-03-01"), ("2020-01-01 00:00:59", "%Y-%m-%d %H:%M:%S", "2020-01-01 00:00:59", "2020-01-01 00:01")])
def test_partial_dates(spark, text, fmt, start, end):
    import datetime as dt

    row = spark.createDataFrame([(text,)], "t string").select(time.interval_of(F.col("t"), fmt).alias("i")).first()["i"]
    micro = dt.timedelta(microseconds=1)
    assert row["mint"] == dt.datetime.fromisoformat(start) - micro and row["maxt"] == dt.datetime.fromisoformat(end) - micro


WEEKS = ["%Y-%U-%w", "%Y-%W-%a", "%G-W%V-%u", "%A %d %B %Y", "%a, %Y-%m-%d %H:%M", "%Y %U %A %H", "%G%V%a", "%Y-%W-%u %H:%M:%S", "100%% %a %Y-%m-%d"]


@pytest.mark.parametrize("fmt", WEEKS)
def test_weeks_and_weekdays(spark, fmt):
    """Every day of some years, written and read by the standard library, against the interval of its unit."""
    import datetime as dt

    days = [dt.datetime(y, 1, 1, 13, 45, 59) + dt.timedelta(days=k) for y in (2019, 2020, 2023) for k in range(0, 366, 5 if y != 2020 else 1)]
    texts = [d.strftime(fmt) for d in days]
    unit = time.resolution(fmt)
    width = {"day": dt.timedelta(days=1), "hour": dt.timedelta(hours=1), "minute": dt.timedelta(minutes=1), "second": dt.timedelta(seconds=1)}[unit]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", time.interval_of(F.col("t"), fmt).alias("i")).collect()
    micro = dt.timedelta(microseconds=1)
    for r in rows:
        start = dt.datetime.strptime(r["t"], fmt)
        assert (r["i"]["mint"], r["i"]["maxt"]) == (start - micro, start + width - micro), r["t"]
    bad = spark.createDataFrame([("tile",), (None,), ("",)], "t string").select(time.interval_of(F.col("t"), fmt).alias("i")).collect()
    assert [r["i"] for r in bad] == [None] * 3


@pytest.mark.parametrize("fmt", ["%c", "%Y %x", "%Y-%U", "%V-%u", "%G-%m-%d", "%Y %Q"])
def test_refused_formats_say_why(fmt):
    with pytest.raises(ValueError, match="locale|weekday|needs|unsupported"):
        time.interval_of(F.lit("x"), fmt)


def test_format_without_year_is_all_time(spark):
    row = spark.range(1).select(time.interval_of(F.lit("x"), "%H").alias("i")).first()["i"]
    assert row["mint"] is None and row["maxt"] is None


@pytest.mark.parametrize("fmt, unit", [
    ("%Y %d", "year"), ("%Y-%j", "day"), ("%d %B %Y", "day"), ("%Y-%m-%d %I %p", "hour"), ("%m-%d", None), ("%Y-%m-%d %H:%M:%S.%f", "microsecond"), ("%Y-%m %S", "month")])
def test_finest_unit_needs_all_coarser_ones(fmt, unit):
    assert time.resolution(fmt) == unit


def test_dates_that_do_not_parse_have_no_interval(spark):
    df = spark.createDataFrame([("20210230",), ("tile",), (None,), ("20210228",)], "t string")
    got = df.select("t", time.interval_of(F.col("t"), "%Y%m%d").alias("i")).filter("i IS NOT NULL").collect()
    assert [r["t"] for r in got] == ["20210228"]
    row = spark.createDataFrame([("03 March 2021 04 PM",)], "t string").select(time.interval_of(F.col("t"), "%d %B %Y %I %p").alias("i")).first()["i"]
    assert str(row["maxt"]) == "2021-03-03 16:59:59.999999"
    with pytest.raises(ValueError):
        time.resolution("%Q")


def test_array_files_and_species_list(spark, tmp_path):
    a = BASE.copy()
    a[0, 0, 0] = math.nan
    np.save(tmp_path / "L7.npy", a)
    np.save(tmp_path / "L8.npy", BASE[0])
    rows = {r["hotspot_id"]: r for r in readers.array_files(spark, str(tmp_path)).collect()}
    assert rows["L7"]["data"][0] is None and rows["L7"]["data"][1:] == list(a.ravel()[1:])
    assert (rows["L8"]["bands"], rows["L8"]["h"], rows["L8"]["w"]) == (1, 5, 6)
    (tmp_path / "list.txt").write_text("zeta\nalpha\n\n")
    assert [tuple(r) for r in readers.species_list(spark, str(tmp_path / "list.txt")).collect()] == [(0, "zeta"), (1, "alpha")]


def test_bucket_is_number_modulo(spark):
    df = spark.createDataFrame([("L12345",), ("L7",)], "h string")
    assert [r[0] for r in df.select(writers.locality_bucket(F.col("h"))).collect()] == [345, 7]


def test_ridge_solves_the_normal_equations(spark):
    rng = np.random.default_rng(0)
    x, noise = rng.normal(size=(80, 4)), rng.normal(size=(80, 3)) * 0.1
    y = x @ rng.normal(size=(4, 3)) + 2 + noise
    df = spark.createDataFrame([(r.tolist(), t.tolist()) for r, t in zip(x, y)], "x array<double>, y array<double>").repartition(5)
    w = baselines.ridge_weights(df, "x", "y", alpha=1.0)
    xc, yc = x - x.mean(0), y - y.mean(0)
    coef = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc)
    np.testing.assert_allclose(w[1:], coef, atol=1e-9)
    np.testing.assert_allclose(w[0], y.mean(0) - x.mean(0) @ coef, atol=1e-9)
    pred = np.array(sorted(r["p"] for r in baselines.ridge_predict(df, "x", w).collect()))
    np.testing.assert_allclose(pred, np.array(sorted((x @ coef + w[0]).tolist())), atol=1e-9)


def test_out_of_bounds_error(spark):
    pixels = spark.createDataFrame([(0, 0, [1.0])], "row bigint, col bigint, values array<double>")
    grid = raster.Grid(1.0, 0.0, 1.0, 1.0)
    points = spark.createDataFrame([(0.5, 0.5)], "lat double, lon double")
    assert raster.sample(points, pixels, grid, "error").first()["env"] == [1.0]
    with pytest.raises(Exception, match="outside the raster"):
        raster.sample(points.withColumn("lat", F.lit(9.0)), pixels, grid, "error").collect()


def test_steps_skip_by_mode():
    specs = [{"name": "hflip", "ignore": "val"}, {"name": "vflip", "ignore": True}, {"name": "blur"}]
    assert len(samples.steps(specs, "val", "k", {})) == 1 and len(samples.steps(specs, "train", "k", {})) == 2


def test_layers_stack_by_number(spark):
    pixels = spark.createDataFrame([(2, 0, 0, 3.0), (0, 0, 0, 1.0), (1, 0, 1, 5.0)], "layer int, row bigint, col bigint, value double")
    rows = {(r["row"], r["col"]): r["values"] for r in raster.stack_layers(pixels, 3).collect()}
    assert rows == {(0, 0): [1.0, None, 3.0], (0, 1): [None, 5.0, None]}
