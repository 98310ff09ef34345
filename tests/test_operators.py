"""Hand-made cases, algebraic properties and numpy twins of the neighbourhood operators."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import indices, text, vectors
from gridloom.operators import (
    composites, grid, masks, metrics, models, pairs, patches, registry, sampling, stats, temporal,
)
from gridloom.operators.tiling import circle_spans
from gridloom.sources import cubes


def frame(spark, *box):
    return spark.createDataFrame([tuple(map(float, box))], "minx double, miny double, maxx double, maxy double")


def image(spark, array, name="v", img=0):
    rows = [(img, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(array)]
    return spark.createDataFrame(rows, f"img int, yi int, xi int, {name} double")


def to_array(df, name, shape, fill=np.nan):
    out = np.full(shape, fill)
    for r in df.collect():
        out[r.yi, r.xi] = r[name]
    return out


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


# grids ---------------------------------------------------------------------------------


def test_chunk_grid_drops_the_remainder(spark):
    got = grid.chunk_grid(frame(spark, 0, 0, 100, 70), 30, 30).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.ty, r.tx) for r in got] == [
        (0, 70, 0), (1, 70, 30), (2, 70, 60), (3, 40, 0), (4, 40, 30), (5, 40, 60)
    ]
    assert grid.chunk_grid(frame(spark, 0, 0, 20, 20), 30, 30).count() == 0


def test_exact_extent_gets_one_more_chunk_of_coordinates(spark):
    box = frame(spark, 0, 0, 60, 60)
    assert grid.chunk_grid(box, 30, 30).count() == 4
    axes = grid.coordinate_axes(box, 30, 30, 30).groupBy("axis").count().collect()
    assert {r.axis: r["count"] for r in axes} == {"lat": 3, "lon": 3}


def test_every_pixel_lies_in_one_chunk(spark):
    chunks = grid.chunk_grid(frame(spark, 0, 0, 120, 90), 30, 30)
    pixels = grid.chunk_pixels(chunks, 3, 3)
    assert pixels.count() == pixels.select("yi", "xi").distinct().count() == 12 * 9


@pytest.mark.parametrize("height,width,size", [(7, 10, 4), (8, 9, 3)])
def test_clip_and_pad(spark, height, width, size):
    array = np.arange(height * width, dtype=float).reshape(height, width)
    y0, x0 = (height - size) // 2, (width - size) // 2
    clipped = grid.centre_clip(image(spark, array), height, width, size)
    assert np.array_equal(to_array(clipped, "v", (size, size)), array[y0:y0 + size, x0:x0 + size])
    big = 13
    images = spark.createDataFrame([(0,)], "img int")
    padded = grid.centre_pad(images, image(spark, array), ["img"], height, width, big, {"v": -9.0})
    top, left = (big - height) // 2, (big - width) // 2
    expected = np.pad(array, ((top, big - height - top), (left, big - width - left)), constant_values=-9)
    assert np.array_equal(to_array(padded, "v", (big, big)), expected)


def test_window_pads_sides(spark):
    """Top and left when the window starts at the first row or column, else bottom and right."""
    labels = frame(spark, 0, 0, 90, 90)  # four pixels of 30 per axis, first to last label
    windows = spark.createDataFrame([(0, 120.0, -60.0), (1, 60.0, 60.0), (2, 90.0, 0.0)], "sample_id int, tY double, tx double")
    got = {r.sample_id: r for r in grid.window_pads(windows, labels, 4, 4, 30.0).collect()}
    pads = lambda r: (r.pad_top, r.pad_bottom, r.pad_left, r.pad_right)
    assert pads(got[0]) == (1, 0, 2, 0)
    assert pads(got[1]) == (0, 1, 0, 2)
    assert pads(got[2]) == (0, 0, 0, 0)


def test_unpad_divides_by_rescale(spark):
    rows = [(y, x, 90.0, 0.0, 3, 0, 0, 1) for y in range(4) for x in range(4)]
    blocks = spark.createDataFrame(
        rows, "oy int, ox int, tY double, tx double, pad_top int, pad_bottom int, pad_left int, pad_right int"
    )
    out = grid.unpad(blocks, 4, 4, 30.0, rescale=2)
    assert {(r.oy, r.ox) for r in out.collect()} == {(y, x) for y in range(2) for x in range(3)}
    assert {r.tY for r in out.collect()} == {90.0 - 2 * 60.0}


# patches -------------------------------------------------------------------------------


def test_fold_undoes_patchify(spark):
    array = np.random.default_rng(0).random((9, 12))
    whole = patches.fold(patches.patchify(image(spark, array), 3).drop("yi", "xi"), ["img"], ["v"], 3)
    assert np.allclose(to_array(whole, "v", array.shape), array)
    tiles = patches.overlapping_patchify(image(spark, array), 9, 12, 4, 2)
    again = to_array(patches.fold(tiles.drop("yi", "xi"), ["img"], ["v"], 2), "v", array.shape)
    covered = ~np.isnan(again)
    assert covered[:8, :12].all() and not covered[8].any()
    assert np.allclose(again[covered], array[covered])


def test_overlap_is_a_mean(spark):
    tiles = patches.overlapping_patchify(image(spark, np.array([[1.0, 2.0, 3.0]])), 1, 3, 1, 1)
    assert tiles.count() == 3
    rows = [(0, 0, 0, 0, 10.0), (0, 0, 0, 1, 20.0), (0, 0, 1, 0, 40.0)]
    df = spark.createDataFrame(rows, "img int, pr int, pc int, ox int, v double").withColumn("oy", F.lit(0))
    out = {r.xi: (r.v, r.n) for r in patches.fold(df, ["img"], ["v"], 1, "n").collect()}
    assert out == {0: (10.0, 1), 1: (30.0, 2)}


def test_patch_mean_is_void_with_a_missing_pixel(spark):
    rows = [(0, x, t, None if (x, t) == (1, 0) else 1.0) for x in range(4) for t in range(2)]
    df = spark.createDataFrame(rows, "yi int, xi int, t int, v double")
    out = patches.patch_means(df, [], "v", 2, "t", {0: "a", 1: "b"}).collect()
    assert [(r.pr, r.pc) for r in out] == [(0, 1)]


# time ----------------------------------------------------------------------------------


def series(spark, steps=7, skip=()):
    rows = [(0, 0, t, float(t * t)) for t in range(steps) if t not in skip]
    return spark.createDataFrame(rows, "yi int, xi int, t int, v double")


def test_window_edges(spark):
    anchors = spark.createDataFrame([(0, 0, t) for t in range(7)], "yi int, xi int, tdx int")
    out = temporal.asymmetric_windows(anchors, series(spark), ["yi", "xi"], ["yi", "xi"], ["v"], (2, 2), 7)
    assert {r.tdx for r in out.collect()} == {2, 3, 4, 5}
    assert value(spark, temporal.anchor_steps(7, (2, 2))) == [0, 1, 2, 3]
    assert value(spark, temporal.anchor_steps(3, (2, 2))) == []


def test_sliding_windows(spark):
    out = temporal.sliding_windows(series(spark), ["yi", "xi"], ["v"], 3, 7)
    got = {a: sorted((r.k, r.t) for r in out.collect() if r.anchor == a) for a in range(8)}
    assert {a for a, w in got.items() if w} == {3, 4, 5, 6}
    assert got[5] == [(0, 2), (1, 3), (2, 4)]


def test_windows_are_full_where_steps_are_missing(spark):
    out = temporal.sliding_windows(series(spark, skip=(0, 4)), ["yi", "xi"], ["v"], 3, 7).collect()
    got = {a: [r.v for r in sorted(out, key=lambda r: r.k) if r.anchor == a] for a in range(3, 7)}
    assert got == {3: [-1, 1, 4], 4: [1, 4, 9], 5: [4, 9, -1], 6: [9, -1, 25]}
    pixels = spark.createDataFrame([(0, 0)], "yi int, xi int")
    held = temporal.holdout_windows(pixels, series(spark, skip=(2,)), ["yi", "xi"], ["v"], 2, 1, 7, seed=1)
    assert held.count() == 3 * 2
    samples = spark.createDataFrame([(0, 0), (0, 3)], "yi int, t int")
    labels = spark.createDataFrame([(0, 9, 1.0)], "xi int, t int, label double")
    joined = temporal.windows_with_labels(
        samples, series(spark, skip=(2,)), labels, "yi", ["xi"], ["v"], "label", 7
    ).collect()
    assert sorted((r.t, r.k, r.v, r.label) for r in joined) == [(3, 0, -1, 0), (3, 1, 9, 0)]


def test_frame_delta_stops_at_a_gap(spark):
    rows = [(0, t, [float(t * t)]) for t in (0, 2, 3)]
    df = spark.createDataFrame(rows, "img int, t int, emb array<double>")
    assert [(r.t, r.emb) for r in temporal.frame_delta(df, ["img"], "emb").collect()] == [(2, [-5.0])]
    cat = temporal.frame_delta(df, ["img"], "emb", "cat_delta").collect()
    assert [r.emb for r in cat] == [[0.0, -5.0]]


def test_differences_need_neighbours(spark):
    df = series(spark, skip=(3,))
    first = {r.t: r.v for r in temporal.first_difference(df, ["yi", "xi"], ["v"]).collect()}
    assert first == {0: 1, 1: 3, 4: 9, 5: 11}
    second = {r.t: r.v for r in temporal.second_difference(df, ["yi", "xi"], ["v"]).collect()}
    assert second == {0: 2, 4: 2}


def test_reversing_twice(spark):
    df = series(spark)
    twice = temporal.reverse_time(temporal.reverse_time(df, 7), 7)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, df.collect()))


def test_month_roll(spark):
    expected = [(date(2024, 1, 31), date(2024, 3, 1)), (date(2024, 3, 1), date(2024, 4, 1))]
    assert composites.month_starts(date(2024, 1, 31), date(2024, 4, 1)) == expected
    df = spark.createDataFrame([(date(2024, 1, 31), date(2024, 4, 1))], "a date, b date")
    out = composites.month_ranges(df, F.col("a"), F.col("b")).orderBy("range_start").collect()
    assert [(r.range_start, r.range_end) for r in out] == expected
    for start in (date(2023, 11, 30), date(2024, 2, 1), date(2023, 12, 31)):
        end = date(2024, 9, 13)
        df = spark.createDataFrame([(start, end)], "a date, b date")
        got = composites.month_ranges(df, F.col("a"), F.col("b")).orderBy("range_start").collect()
        assert [(r.range_start, r.range_end) for r in got] == composites.month_starts(start, end)


def test_day_finds_its_month_range(spark):
    start, end = date(2023, 12, 31), date(2024, 6, 2)
    days = [date.fromordinal(d) for d in range(start.toordinal() - 3, end.toordinal())]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = {r.d: r.s for r in df.select("d", composites.month_range_start(F.col("d"), start).alias("s")).collect()}
    for d in days:
        hits = [lo for lo, hi in composites.month_starts(start, end) if lo <= d < hi]
        assert got[d] == (hits[0] if hits else None)


def test_quarters_roll_over_the_year(spark):
    assert composites.quarter_windows(date(2020, 8, 5), date(2020, 11, 9)) == [
        (date(2020, 8, 5), date(2020, 11, 9)), (date(2020, 11, 5), date(2021, 2, 9))
    ]


def test_days_past_the_month_run_on():
    assert composites.quarter_windows(date(2021, 11, 30), date(2021, 11, 30)) == [
        (date(2021, 11, 30), date(2022, 3, 2))
    ]
    seasons = composites.season_windows(date(2020, 2, 29), date(2021, 9, 1))
    assert [s[2] for s in seasons] == [date(2020, 2, 29), date(2021, 3, 1)]


def test_region_index_is_clamped(spark):
    df = spark.createDataFrame([(200.0, -50.0), (75.0, 10.0), (-500.0, 900.0)], "ty double, tx double")
    out = grid.region_index(df, 100.0, 0.0, 10.0, height=10, width=12).collect()
    assert [(r.row0, r.col0) for r in out] == [(0, 0), (3, 1), (10, 12)]


def test_overlapping_windows_share_an_observation(spark):
    df = spark.createDataFrame([(0, date(2020, 3, 1), 5.0), (0, date(2020, 6, 1), 7.0)], "p int, d date, b double")
    windows = [("a", date(2020, 1, 1), date(2020, 4, 1)), ("b", date(2020, 2, 1), date(2020, 7, 1))]
    out = composites.window_median(df, F.col("d"), windows, ["p"], ["b"])
    assert {r.period: r.b for r in out.collect()} == {"a": 5.0, "b": 6.0}


def test_unpack_segments(spark):
    df = spark.range(12).select(F.col("id").cast("int").alias("t"))
    got = {r.t: (r.segment, r.k, r.tt) for r in temporal.unpack_segments(df, 2, ["bwd", "cur", "fwd"], [2, 1, 2]).collect()}
    assert got[0] == ("bwd", 0, 0) and got[3] == ("bwd", 1, 1) and got[5] == ("cur", 0, 1)
    assert got[9] == ("fwd", 1, 1) and got[11] == (None, None, 1)


# masks ---------------------------------------------------------------------------------


def focal_twin(array, radius, pick):
    h, w = array.shape
    spans = circle_spans(radius)
    out = np.zeros_like(array)
    for y in range(h):
        for x in range(w):
            out[y, x] = pick(
                array[y + dy, x + dx] for dy, s in spans.items() for dx in range(-s, s + 1)
                if 0 <= y + dy < h and 0 <= x + dx < w
            )
    return out


def test_circle_spans():
    assert circle_spans(2) == {-2: 0, -1: 1, 0: 2, 1: 1, 2: 0}
    assert sum(2 * s + 1 for s in circle_spans(5).values()) == sum(
        1 for y in range(-5, 6) for x in range(-5, 6) if x * x + y * y <= 25
    )


@pytest.mark.parametrize("tile", [6, 64])
def test_clean_mask(spark, tile):
    array = (np.random.default_rng(3).random((24, 31)) > 0.12).astype(float)
    got = to_array(masks.clean_mask(image(spark, array), ["img"], "v", tile=tile), "mask", array.shape)
    expected = focal_twin(focal_twin(array, 2, min), 5, max)
    assert 0 < expected.mean() < 1
    assert np.array_equal(got, expected)


def test_bits(spark):
    assert value(spark, indices.bits_clear(F.lit(0b10000000), [3, 4])) is True
    assert value(spark, indices.bits_clear(F.lit(0b00001000), [3, 4])) is False
    flags = masks.mask_flags(F.lit(128), ["cloud", "water"])
    assert value(spark, flags["cloud"]) is True and value(spark, flags["water"]) is False


def test_missing_values_are_null_after_ingest(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "b double")
    out = cubes.ingest(df, ["b"])
    assert out.agg(F.avg("b"), F.count("b")).collect()[0] == (1.0, 1)


# statistics and scores -----------------------------------------------------------------


def test_all_null_chunk_leaves_statistics_alone(spark):
    rows = [(0, 1.0), (0, 2.0), (0, 4.0), (1, None), (1, None)]
    df = spark.createDataFrame(rows, "chunk int, b double")
    for ddof in (0, 1):
        r = stats.band_stats(df, ["b"], ddof).collect()[0]
        assert (r.n, r.mean) == (3, pytest.approx(7 / 3))
        assert r.std == pytest.approx(np.std([1, 2, 4], ddof=ddof))


def test_zero_over_zero_index(spark):
    assert value(spark, indices.ndvi(F.lit(0.0), F.lit(0.0))) is None
    assert value(spark, indices.ndvi(F.lit(3.0), F.lit(1.0))) == 0.5


def test_density_is_close_to_the_exact_kernel_sum(spark):
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal((0, 0), 1, (300, 2)), rng.normal((4, 3), (0.5, 1), (200, 2))])
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    got = np.array([r.density for r in stats.density(df, "x", "y").orderBy("id").collect()])
    cov = np.cov(points.T) * len(points) ** (-1 / 3)
    d = points[:, None] - points[None]
    e = np.einsum("ijk,kl,ijl->ij", d, np.linalg.inv(cov), d)
    exact = np.exp(-e / 2).sum(1) / (len(points) * 2 * np.pi * np.sqrt(np.linalg.det(cov)))
    assert np.abs(got / exact - 1).max() < 0.02


def ssim_twin(x, y, weights, correct):
    n = len(weights)
    w = np.outer(weights, weights)
    out = []
    for r in range(x.shape[0] - n + 1):
        for c in range(x.shape[1] - n + 1):
            a, b = x[r:r + n, c:c + n], y[r:r + n, c:c + n]
            ma, mb = (w * a).sum(), (w * b).sum()
            va, vb = ((w * a * a).sum() - ma**2) * correct, ((w * b * b).sum() - mb**2) * correct
            vab = ((w * a * b).sum() - ma * mb) * correct
            c1, c2 = 1e-4, 9e-4
            out.append((2 * ma * mb + c1) * (2 * vab + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2)))
    return np.mean(out)


@pytest.mark.parametrize("kernel,size", [("uniform", 7), ("gaussian", 11)])
def test_ssim(spark, kernel, size):
    rng = np.random.default_rng(1)
    x, y = rng.random((19, 26)), rng.random((19, 26))
    df = image(spark, x, "p").join(image(spark, y, "t"), ["img", "yi", "xi"])
    got = metrics.ssim(df, ["img"], "p", "t", kernel=kernel, size=size, tile=8).collect()[0].ssim
    weights = [1 / 7] * 7 if kernel == "uniform" else metrics.gaussian_weights(1.5, 11)
    assert got == pytest.approx(ssim_twin(x, y, weights, 49 / 48 if kernel == "uniform" else 1.0))
    same = metrics.ssim(image(spark, x, "p").withColumn("t", F.col("p")), ["img"], "p", "t", kernel=kernel, size=size)
    assert same.collect()[0].ssim == pytest.approx(1.0)


def test_ssim_without_a_data_range(spark):
    rng = np.random.default_rng(2)
    x, y = rng.random((9, 9)) * 40, rng.random((9, 9)) * 30
    df = image(spark, x, "p").join(image(spark, y, "t"), ["img", "yi", "xi"])
    span = max(x.max() - x.min(), y.max() - y.min())
    auto = metrics.ssim(df, ["img"], "p", "t", data_range=None).collect()[0].ssim
    given = metrics.ssim(df, ["img"], "p", "t", data_range=float(span)).collect()[0].ssim
    loss = metrics.ssim_loss(df, ["img"], "p", "t", data_range=None).collect()[0].loss
    assert auto == pytest.approx(given) and loss == pytest.approx(1 - auto)


def test_ignored_class_has_no_loss(spark):
    z = F.array(F.lit(1.0), F.lit(2.0))
    assert value(spark, indices.cross_entropy(z, F.lit(1), 2, ignore_index=1)) is None
    assert value(spark, indices.cross_entropy(z, F.lit(-100), 2)) is None


def test_scores_without_positives(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.2, 0.0)], "p double, t double")
    r = metrics.binary_scores(df, "p", "t").collect()[0]
    assert (r.accuracy, r.jaccard, r.precision, r.recall) == (1.0, 0.0, 0.0, 0.0)


def test_jaccard_is_at_most_precision_and_recall(spark):
    rng = np.random.default_rng(2)
    rows = [(k % 9, float(rng.random()), float(rng.integers(2))) for k in range(500)]
    df = spark.createDataFrame(rows, "img int, p double, t double")
    for r in metrics.binary_scores(df, "p", "t", ["img"]).collect():
        assert r.jaccard <= min(r.precision, r.recall) + 1e-12


def test_reductions(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    assert metrics.reduce_rows(df, "v", "none").count() == 2
    assert metrics.reduce_rows(df, "v", "mean").collect()[0].loss == 2.0
    assert metrics.reduce_rows(df, "v", "sum").collect()[0].loss == 4.0


def test_losses_do_not_overflow(spark):
    x = F.lit(-900.0)
    assert value(spark, indices.bce_with_logits(x, F.lit(1.0))) == pytest.approx(900.0)
    assert value(spark, indices.bce_with_logits(F.lit(900.0), F.lit(1.0))) == pytest.approx(0.0)
    assert value(spark, vectors.sigmoid(x)) == pytest.approx(0.0)
    assert value(spark, indices.cross_entropy(F.array(F.lit(1000.0), F.lit(0.0)), F.lit(1), 2)) == pytest.approx(1000.0)
    assert value(spark, vectors.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == [0.5, 0.5]


def test_vectors(spark):
    a, b = F.array(*map(F.lit, [3.0, 4.0])), F.array(*map(F.lit, [0.0, 0.0]))
    assert value(spark, vectors.normalise(a)) == [0.6, 0.8]
    assert value(spark, vectors.normalise(b)) == [0.0, 0.0]
    assert value(spark, vectors.cosine(a, b)) == 0.0
    assert value(spark, vectors.l1(a, b)) == 7.0 and value(spark, vectors.l2(a, b)) == 5.0
    assert value(spark, vectors.argmax(F.array(*map(F.lit, [1.0, 2.0, 2.0])))) == 1
    assert value(spark, vectors.sub_range(a, 1, 2)) == [4.0]


def test_contrastive_spread_matches_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [([*map(float, rng.normal(size=5))], [*map(float, rng.normal(size=5))],
             [[*map(float, rng.normal(size=5))] for _ in range(3)]) for _ in range(20)]
    df = spark.createDataFrame(rows, "h array<double>, p array<double>, n array<array<double>>")
    r = pairs.contrastive_summary(pairs.contrastive_scores(df, "h", "p", "n", 0.5)).collect()[0]
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    pos = np.array([unit(h) @ unit(p) for h, p, _ in rows]) / 0.5
    neg = np.array([[unit(h) @ unit(v) for v in n] for h, _, n in rows]) / 0.5
    logits = np.concatenate([pos[:, None], neg], axis=1)
    assert r.loss == pytest.approx((np.log(np.exp(logits).sum(1)) - pos).mean())
    assert r.stdv_neg_sim == pytest.approx(neg.std(ddof=1)) and r.stdv_pos_sim == pytest.approx(pos.std(ddof=1))
    assert r.max_neg_sim == pytest.approx(neg.max()) and r.mean_neg_sim == pytest.approx(neg.mean())


# names ---------------------------------------------------------------------------------


def test_checkpoint_ties(spark):
    from gridloom.operators.checkpoints import best_checkpoint, latest_checkpoint

    names = {
        "a": ["epoch=0003_val_loss=0.500.ckpt", "epoch=0005_val_loss=0.500.ckpt", "epoch=0009_val_loss=0.700.ckpt"],
        "b": ["epoch=0004_val_loss=0.500.ckpt", "epoch=0004_val_loss=0.500-v1.ckpt"],
        "c": ["last.ckpt"],
        "d": ["epoch=0003_val_f1=0.51.ckpt", "epoch=0004_test/iou@50=0.49-v2.ckpt"],
    }
    rows = [(run, n) for run, ns in names.items() for n in ns]
    df = spark.createDataFrame(rows, "run_id string, path string")
    best = {r.run_id: r.path for r in best_checkpoint(df).collect()}
    assert best == {"a": names["a"][1], "b": names["b"][1], "c": "null", "d": names["d"][1]}
    latest = {r.run_id: r.path for r in latest_checkpoint(df).collect()}
    assert latest == {"a": names["a"][2], "b": names["b"][1], "c": "null", "d": names["d"][1]}


def test_names(spark):
    assert value(spark, text.sample_name(F.lit(12), F.lit(3))) == "00000012_t03"
    assert value(spark, text.prediction_position(F.lit("17_forest_t1.pt"))) == 17
    assert value(spark, text.prediction_position(F.lit("forest.pt"))) is None


# sampling ------------------------------------------------------------------------------


def test_four_quarter_turns(spark):
    array = np.random.default_rng(5).random((6, 6))
    df = image(spark, array)
    for k in range(4):
        turned = to_array(sampling.rotate(df, F.lit(k), 6), "v", (6, 6))
        assert np.array_equal(turned, np.rot90(array, k))


def test_flips(spark):
    array = np.random.default_rng(6).random((4, 5))
    out = sampling.flip(image(spark, array), F.lit(True), F.lit(False), 4, 5)
    assert np.array_equal(to_array(out, "v", (4, 5)), array[:, ::-1])


def test_affine_keeps_every_pixel(spark):
    rows = [(s, y, x, float(y * 8 + x)) for s in range(12) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "s int, yi int, xi int, v double")
    out = sampling.random_affine(df, ["s"], 8, seed=2)
    assert out.select("s", "yi", "xi").distinct().count() == len(rows)


def test_jitter_offsets():
    assert sampling.jitter_offsets(120, 30) == [-90, -60, -30, 0, 30, 60]


def test_batches(spark):
    out = sampling.batches(spark.range(103), ["id"], 10, seed=1).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in out) == [3] + [10] * 10
    assert sampling.batches(spark.range(103), ["id"], 10, seed=1, drop_last=True).count() == 100


def test_colour_jitter_without_strength_changes_nothing(spark):
    df = image(spark, np.random.default_rng(8).random((3, 3)))
    out = sampling.colour_jitter(df, ["img"], ["v"], 0.0, 0.0, seed=1, uniform=False)
    assert np.allclose(to_array(out, "v", (3, 3)), to_array(df, "v", (3, 3)))


def test_colour_jitter_stays_in_range_and_differs_by_band(spark):
    df = image(spark, np.random.default_rng(8).random((4, 4))).withColumn("w", F.col("v"))
    shared = sampling.colour_jitter(df, ["img"], ["v", "w"], 0.5, 0.5, seed=1).collect()
    assert all(r.v == r.w and 0 <= r.v <= 1 for r in shared)
    own = sampling.colour_jitter(df, ["img"], ["v", "w"], 0.5, 0.5, seed=1, uniform=False).collect()
    assert any(abs(r.v - r.w) > 1e-6 for r in own)


# storage, steps, models ----------------------------------------------------------------


def test_rewriting_tiles_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "cube")
    df = spark.createDataFrame([(k % 3, t, k, float(k)) for k in range(9) for t in range(2)], "tile_id int, t int, k int, v double")
    cubes.write_tiles(df, path)
    part = df.where("tile_id = 1").withColumn("v", F.lit(-1.0))
    for _ in range(2):
        cubes.write_tiles(part, path)
    back = spark.read.parquet(path)
    assert back.count() == df.count()
    assert {r.v for r in back.where("tile_id = 1").collect()} == {-1.0}
    assert cubes.read_cube(spark, None) is None


def test_small_tiles_share_folders_and_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "cube")
    rows = [(k % 9 if k % 9 < 8 else None, t, k, float(k)) for k in range(18) for t in (0, 1, None)]
    df = spark.createDataFrame(rows, "tile_id int, t int, k int, v double")
    cubes.write_tiles(df, path, tiles=4)
    assert len(list((tmp_path / "cube").glob("block_=*/t=*"))) == 9  # two blocks and none, two steps and none
    before = {(r.tile_id, r.t, r.k): r.v for r in cubes.read_cube(spark, path).collect()}
    assert before == {r[:3]: r[3] for r in rows}
    part = df.where("tile_id = 1 OR tile_id IS NULL AND t = 0").withColumn("v", F.lit(-1.0))
    for _ in range(2):
        cubes.write_tiles(part, path, tiles=4)
    after = {(r.tile_id, r.t, r.k): r.v for r in cubes.read_cube(spark, path).collect()}
    again = {(r.tile_id, r.t, r.k) for r in part.collect()}
    assert after == {key: -1.0 if key in again else v for key, v in before.items()}
    cubes.write_tiles(df.where("tile_id = 5 AND k = 5"), path, tiles=4)  # a tile is replaced whole
    assert cubes.read_cube(spark, path).where("tile_id = 5").count() == 3
    assert cubes.read_cube(spark, path).count() == df.count() - 3


def test_merge_keeps_keys_of_both_sides(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    new = spark.createDataFrame([("b", 5), ("c", 7)], "k string, n int")
    merged = cubes.merge_document(old, new, ["k"], ["n"]).collect()
    assert {r.k: r.n for r in merged} == {"a": 1, "b": 5, "c": 7}


def test_a_second_update_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "stats")
    for k, (key, n) in enumerate([("a", 1), ("b", 2), ("c", 3), ("b", 9)]):
        new = spark.createDataFrame([(key, n)], "k string, n int")
        out = cubes.update_document(spark, path, new, ["k"], ["n"], first=k == 0)
    assert {r.k: r.n for r in out.collect()} == {"a": 1, "b": 9, "c": 3}


def test_steps_by_name(spark):
    df = series(spark)

    @registry.step("scale_for_test")
    def scale(df, column, factor, unused=None):
        return df.withColumn(column, F.col(column) * factor)

    config = [{"name": "reverse_time", "args": {"steps": 7}}, {"name": "scale_for_test", "args": {"column": "v"}}]
    out = registry.apply_steps(df, config, factor=2.0, unrelated=1)
    assert {r.t: r.v for r in out.collect()}[6] == 0.0
    with pytest.raises(KeyError):
        registry.apply_steps(df, [{"name": "no_such_step"}])


def test_a_forest_grows_on_no_more_partitions_than_run_at_a_time(spark, monkeypatch):
    met = []
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, data: met.append(data.rdd.getNumPartitions()))
    rows = spark.range(0, 400, 1, 4 * spark.sparkContext.defaultParallelism).selectExpr(
        "array(CAST(id AS DOUBLE)) AS features", "CAST(id % 2 AS DOUBLE) AS hit")
    models.fit_forest(rows, "hit")
    models.fit_forest(rows.coalesce(2), "hit")
    assert met == [spark.sparkContext.defaultParallelism, 2]


def test_forest_learns_and_reverses(spark):
    rows = [(k, 0, t, float(t if k % 2 else 6 - t)) for k in range(60) for t in range(7)]
    cube = spark.createDataFrame(rows, "yi int, xi int, t int, b double")
    forward = models.pixel_features(cube, ["yi", "xi"], ["b"], "t", 7)
    labelled = forward.withColumn("hit", (F.col("yi") % 2).cast("double"))
    model = models.fit_forest(labelled, "hit", trees=5, depth=3)
    right = models.apply_forest(model, labelled).where("prediction = hit").count()
    reverse = models.pixel_features(cube, ["yi", "xi"], ["b"], "t", 7, reverse=True)
    reverse = reverse.withColumn("hit", (F.col("yi") % 2).cast("double"))
    wrong = models.apply_forest(model, reverse).where("prediction <> hit").count()
    assert right == 60 and wrong == 60


def test_projection_is_reapplied(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(80, 2)) @ np.array([[5.0, 0, 0, 1], [0, 2.0, 1, 0]])
    df = spark.createDataFrame([(k, list(map(float, p))) for k, p in enumerate(points)], "id int, v array<double>")
    model = models.fit_projection(df, "v")
    once = {r.id: r.projection for r in models.apply_projection(model, df, "v").collect()}
    shifted = models.apply_projection(model, df.withColumn("v", F.transform("v", lambda x: x * 2)), "v")
    for r in shifted.collect():
        assert np.allclose(r.projection, np.array(once[r.id]) * 2)
    assert np.allclose(np.linalg.norm(list(once.values()), axis=1), np.linalg.norm(points, axis=1))


def test_padded_windows_score_and_mosaic(spark):
    from gridloom.plans.landcover import score_and_mosaic

    array = np.random.default_rng(10).random((4, 4))
    pixels = image(spark, array, "b").drop("img").withColumn("t", F.lit(0))
    windows = spark.createDataFrame(
        [(0, 120.0, -30.0, 0), (1, 90.0, 0.0, 0)], "sample_id int, tY double, tx double, t int"
    )
    padded = grid.window_pads(windows, frame(spark, 0, 0, 90, 90), 4, 4, 30.0)

    def load():
        return lambda blocks: blocks * 10 + blocks.max(axis=(2, 3), keepdims=True) * 0

    out = score_and_mosaic(padded, pixels, ["b"], 4, 30.0, F.lit(0.0), F.lit(90.0), load, lambda x: x)
    got = to_array(out, "score", (4, 4))
    assert np.allclose(got, array * 10, atol=1e-5)
    assert {(r.yi, r.xi): r.n for r in out.collect()}[(0, 0)] == 2


def test_model_matrix_equals_numpy(spark):
    """Missing values, a repeated row, and models that share few parameters."""
    from gridloom.operators import pairs

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    x[:25, 2] = np.nan
    x[3, 0] = np.nan
    rows = [("w", p, f"m{m}", float(x[p, m])) for p in range(40) for m in range(3) if x[p, m] == x[p, m]]
    rows += [("w", 7, "m1", float(x[7, 1]) - 1), ("w", 8, None, 1.0), ("w", 9, "m3", None)]
    df = spark.createDataFrame(rows, "name string, pos int, model string, value double").repartition(3)
    got = {(r.model_a, r.model_b): (r.l1, r.l2, r.cosine) for r in pairs.model_matrix(df).collect()}
    assert len(got) == 9
    for a in range(3):
        for b in range(3):
            u, v = x[:, a], x[:, b]
            both = ~np.isnan(u + v)
            u, v = u[both], v[both]
            want = (np.abs(u - v).sum(), np.sqrt(((u - v) ** 2).sum()), u @ v / np.sqrt((u @ u) * (v @ v)))
            assert np.allclose(got[f"m{a}", f"m{b}"], want)


def test_positions_follow_the_files(spark, tmp_path):
    from gridloom.sources import features

    df = spark.range(0, 997).selectExpr("id * 3 AS fid")
    path = str(tmp_path / "layer")
    df.repartitionByRange(5, "fid").sortWithinPartitions("fid").write.parquet(path)
    rows = features.with_positions(spark, path).collect()
    assert sorted((r.position, r.fid) for r in rows) == [(k, 3 * k) for k in range(997)]
    assert features.with_positions(spark, path).columns == ["fid", "position"]


def test_split_chains_in_one_pass_equal_chains_one_by_one(spark, tmp_path):
    rows = [(k, float(k), ["train", "validate", "test", "other", None][k % 5]) for k in range(100)]
    spark.createDataFrame(rows, "t int, b double, split string").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    t, b = F.col("t"), F.col("b")
    chains = {"train": [{"t": 99 - t, "b": b + t}, {"b": b * t}], "validate": [], "test": [{"c": t + 1}, {"t": t * 2}]}
    df = df.withColumn("c", F.lit(None).cast("int"))
    one = sampling.per_split_columns(df, chains)
    several = sampling.per_split(
        df, {name: [lambda d, s=step: d.withColumns(s) for step in chain] for name, chain in chains.items()})
    assert sorted(map(repr, one.select(df.columns).collect())) == sorted(map(repr, several.select(df.columns).collect()))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert plan(one).count("FileScan") == 1 and plan(several).count("FileScan") == 3
    assert sampling.per_split_columns(df, {}).collect() == []


def test_step_means_count_negatives_from_the_last_step(spark):
    rows = [(0, 1.0, [2.0, 4.0]), (0, 3.0, [6.0]), (1, 5.0, []), (5, 100.0, [100.0]), (None, 9.0, [9.0])]
    scored = spark.createDataFrame(rows, "step int, pos_sim double, neg_sims array<double>")
    (row,) = pairs.contrastive_steps(scored, "step", 3).collect()
    assert row.asDict() == {"pos_sim_1": 2.0, "neg_sim_3": 4.0, "pos_sim_2": 5.0, "neg_sim_2": None,
                            "pos_sim_3": None, "neg_sim_1": None}
