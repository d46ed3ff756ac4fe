"""Literal edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from furrow.functions import logits, text
from furrow.operators import aggregate, clean, encode, evaluate, gapfill, phenology, quantiles, reshape, sampling, splits, timegrid
from furrow.operators.neighbours import nearest_neighbours
from furrow.operators.oversample import smote

DAY0 = dt.date(2024, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def agg(spark, rows):
    return spark.createDataFrame([(p, day(d), i, v) for p, d, i, v in rows], "parcel_id string, date date, idx string, value double")


def column(df, c, order):
    return [r[c] for r in df.orderBy(order).collect()]


def test_gap_fill(spark):
    # A second parcel makes all six dates exist; their spacing must not matter.
    offsets = [0, 1, 5, 6, 30, 200]
    full = [("b", d, "X", float(n)) for n, d in enumerate(offsets)]
    out = gapfill.interpolate(agg(spark, full + [("a", 1, "X", 1.0), ("a", 30, "X", 4.0)]))
    assert column(out.where("parcel_id = 'a'"), "value", "date") == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert column(out.where("parcel_id = 'b'"), "value", "date") == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_gap_fill_positions_are_per_index(spark):
    rows = [("a", 0, "X", 0.0), ("a", 10, "X", 10.0), ("b", 5, "Y", 1.0), ("a", 5, "Y", 7.0)]
    out = gapfill.interpolate(agg(spark, rows))
    assert out.where("idx = 'X' AND parcel_id = 'a'").count() == 2


def test_interleaved_fill_and_padding(spark):
    dates = [day(0), day(1), day(2)]
    out = gapfill.interpolate_interleaved(agg(spark, [("a", 1, "X", 1.0), ("a", 1, "Y", 5.0)]), dates, ["X", "Y"])
    assert [r["value"] for r in out.orderBy("date", "idx").collect()] == [1.0, 1.0, 1.0, 5.0, 5.0, 5.0]
    kept = phenology.drop_padding(reshape.pivot_index(out, ["X", "Y"]), ["X", "Y"])
    assert [r["date"] for r in kept.collect()] == [day(1)]


def test_absent_series_takes_the_median(spark):
    rows = [("a", 0, "X", 1.0), ("b", 0, "X", 3.0), ("c", 0, "X", 8.0), ("d", 0, "Y", 2.0), ("a", 0, "Y", 4.0)]
    filled = gapfill.interpolate(agg(spark, rows))
    assert filled.where("parcel_id = 'd' AND idx = 'X'").count() == 0
    out = gapfill.impute_median(filled)
    assert out.count() == 8
    assert out.where("parcel_id = 'd' AND idx = 'X'").first()["value"] == 3.0
    fit = filled.where("parcel_id IN ('a', 'b')")
    assert gapfill.impute_median(filled, fit).where("parcel_id = 'd' AND idx = 'X'").first()["value"] == 2.0


def test_single_observation(spark):
    one = agg(spark, [("a", 40, "X", 2.5)])
    row = phenology.phenology(one).first()
    assert row["std"] is None and row["auc"] == 0.0 and row["amp"] == 0.0
    row = phenology.temporal_summary(reshape.pivot_index(one, ["X"]), ["X"]).first()
    assert (row["X_std"], row["X_auc"], row["X_mean_diff"], row["X_peak_pos"], row["n_valid_dates"]) == (0.0, 0.0, 0.0, 0.0, 1)


def test_peak_ties_take_the_first_day(spark):
    row = phenology.phenology(agg(spark, [("a", 89, "X", 2.0), ("a", 49, "X", 2.0), ("a", 60, "X", 1.0), ("a", 70, "X", 1.0)])).first()
    assert (row["doy_peak"], row["doy_trough"]) == (50.0, 61.0)


def test_mode(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (" ",), (None,)], "c string")
    assert df.agg(text.mode_text("c").alias("m")).first()["m"] == "a"
    assert df.where("trim(c) = ''").agg(text.mode_text("c").alias("m")).first()["m"] == ""


def test_consolidate_labels(spark):
    raw = spark.createDataFrame(
        [(" 12.0", "b", "g"), ("12", "a", ""), ("12.00", "b ", None), ("1.05", "z", ""), ("7", " ", "g"), (None, "a", "g"), ("8", None, "g")],
        "parcel_id string, label string, grp string",
    )
    out = {r["parcel_id"]: (r["label"], r["label_group"]) for r in aggregate.consolidate_labels(raw, "grp").collect()}
    assert out == {"12": ("b", "g"), "1.05": ("z", "")}


def test_blank_groups_have_no_id(spark):
    df = spark.createDataFrame([("p", ""), ("q", None)], "parcel_id string, label_group string")
    assert {r["group_id"] for r in encode.encode_labels(df, "label_group", "group_id").collect()} == {-100}


def test_class_without_support(spark):
    preds = spark.createDataFrame([(0, 0), (0, 0), (1, 1)], "y_true int, y_pred int")
    names = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    assert evaluate.scalar_metrics(preds).first()["f1_macro"] == 1.0
    report = {r["name"]: r for r in evaluate.class_report(preds, names).collect()}
    assert report["macro avg"]["f1"] == pytest.approx(2 / 3)
    assert report["2"]["support"] == 0
    errors = {r["class_name"]: r for r in evaluate.error_analysis(evaluate.confusion(preds, names)).collect()}
    assert errors[0]["main_confusion_target"] is None and errors[0]["main_confusion_count"] == 0


def test_most_confused_class_is_the_first_on_ties(spark):
    preds = spark.createDataFrame([(0, 2), (0, 1), (0, 0)], "y_true int, y_pred int")
    names = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    row = evaluate.error_analysis(evaluate.confusion(preds, names)).where("class_name = 0").first()
    assert (row["main_confusion_target"], row["main_confusion_count"], row["false_negative"]) == (1, 1, 2)


def test_missing_cloud_and_pixels(spark):
    rows = spark.createDataFrame([(None, None)], "cloud_scene double, px_count int")
    assert clean.max_cloud(rows, 40.0).count() == 0
    assert clean.max_cloud(rows, None).count() == 1
    assert clean.min_px(rows, 0).count() == 1
    assert clean.min_px(rows, 1).count() == 0


def test_dates_that_never_parse_fail(spark):
    rows = spark.createDataFrame([("soon",), ("later",)], "date string")
    with pytest.raises(ValueError):
        clean.require_dates(clean.coerce(rows, dates=["date"]))


def test_window_start(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 7),), (dt.date(2023, 12, 31),)], "d date")
    starts = [r[0] for r in df.orderBy(F.desc("d")).select(timegrid.window_start(F.col("d"), F.lit(DAY0), 5)).collect()]
    assert starts == [dt.date(2024, 1, 6), dt.date(2023, 12, 27)]


def test_calendar_grids_are_refused(spark):
    with pytest.raises(ValueError):
        timegrid.time_grid(agg(spark, [("a", 0, "X", 1.0)]), "M")
    with pytest.raises(ValueError):
        timegrid.bin_dates(agg(spark, [("a", 0, "X", 1.0)]), "0D")


def parcels(spark, per_tile):
    rows = [(f"p{t}_{n}", f"c{n % 3}", f"T{t:02d}") for t, size in enumerate(per_tile) for n in range(size)]
    return spark.createDataFrame(rows, "parcel_id string, label string, tile string")


def parts(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def test_two_tiles_fall_back_to_parcels(spark):
    out = splits.split_by_tile(parcels(spark, [50, 50]))
    assert parts(out) == {"test": 20, "val": 10, "train": 70}
    assert out.where("tile = 'T00'").select("split").distinct().count() > 1


@pytest.mark.parametrize("tiles", [5, 13])
def test_tiles_stay_whole(spark, tiles):
    out = splits.split_by_tile(parcels(spark, [10 + t for t in range(tiles)]))
    assert out.select("tile", "split").distinct().count() == tiles
    assert set(parts(out)) == {"train", "val", "test"}


def test_tile_split_without_validation(spark):
    assert set(parts(splits.split_by_tile(parcels(spark, [10, 20, 30]), val=0.0))) == {"train", "test"}


def test_split_parameters(spark):
    df = parcels(spark, [10])
    for bad in ({"test": 0.0}, {"val": 1.0}, {"test": 0.6, "val": 0.5}):
        with pytest.raises(ValueError):
            splits.split_by_parcel(df, **bad)
    with pytest.raises(ValueError):
        splits.group_folds(df, "tile", 2)


def test_split_is_plain_where_a_class_is_too_small(spark):
    df = spark.createDataFrame([(f"p{n}", "rare" if n == 0 else "c") for n in range(40)], "parcel_id string, label string")
    assert parts(splits.split_by_parcel(df)) == {"test": 8, "val": 4, "train": 28}


def test_split_sizes_follow_the_published_rule(spark):
    # 114,814 rows at 20 % hold out 22,963; 112,002 hold out 22,401.
    for n, held in ((114_814, 22_963), (112_002, 22_401)):
        df = spark.range(n).select(F.col("id").cast("string").alias("parcel_id"), (F.sqrt("id") % 5).cast("int").alias("label"))
        assert parts(splits.stratified_split(df))["test"] == held


def test_group_fold_loads(spark):
    out = {r["tile"]: r["test_fold"] for r in splits.group_folds(parcels(spark, [9, 5, 4, 3]), "tile", 2).collect()}
    assert out == {"T00": 1, "T01": 2, "T02": 2, "T03": 1}


def test_class_too_small_for_smote(spark):
    rows = [(f"a{n}", "big", float(n), 0.0) for n in range(20)] + [(f"b{n}", "small", float(n), 1.0) for n in range(5)]
    with pytest.raises(ValueError):
        smote(spark.createDataFrame(rows, "parcel_id string, label string, x double, y double"), ["x", "y"], 5)


def test_losses_with_nothing_left(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1)], "x array<double>, y int")
    loss = df.select(logits.focal_loss(F.col("x"), F.col("y"), ignore=1).alias("l"))
    assert loss.agg(logits.mean_or_zero(F.col("l"))).first()[0] == 0.0
    with pytest.raises(ValueError):
        logits.focal_loss(F.col("x"), F.col("y"), -1.0)


def test_large_scores_do_not_overflow(spark):
    df = spark.createDataFrame([([1000.0, 999.0],)], "x array<double>")
    p = df.select(logits.softmax(F.col("x")).alias("p")).first()["p"]
    assert p[0] == pytest.approx(0.7310585786) and sum(p) == pytest.approx(1.0)


def test_quantiles_of_heavy_ties(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 != 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    out = {r["prob"]: r["quantile"] for r in quantiles.exact_quantiles(df, [], "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    values = sorted(5.0 if n % 3 else float(n) for n in range(3000))
    assert out[0.0] == values[0] and out[1.0] == values[-1]
    assert out[0.5] == (values[1499] + values[1500]) / 2
    low, high = values[2699], values[2700]
    assert out[0.9] == pytest.approx(low + (high - low) * 0.1)


def test_quantiles_equal_the_built_in_for_extreme_values(spark):
    inf = float("inf")
    groups = {"a": [inf] * 5 + [1.0] * 2, "b": [1e308, 1e308, -1e308, -1e308], "c": [-inf, 1.0, 2.0, inf], None: [1.0, 3.0, 10.0]}
    df = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["k"], r["prob"]): r["quantile"] for r in quantiles.exact_quantiles(df, ["k"], "v", probs).collect()}
    want = {(r["k"], p): q for r in df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect() for p, q in zip(probs, r["q"])}
    assert {k: repr(x) for k, x in got.items()} == {k: repr(x) for k, x in want.items()}


def test_splits_keep_rows_without_label_or_tile(spark):
    rows = [(f"p{i}", None if i % 5 == 0 else f"c{i % 3}", None if i % 5 == 1 else f"T{i % 4}") for i in range(100)]
    df = spark.createDataFrame(rows, "parcel_id string, label string, tile string")
    sizes = lambda d: {r["split"]: r["count"] for r in d.groupBy("split").count().collect()}
    assert sizes(splits.stratified_split(df)) == {"train": 80, "test": 20}
    assert sum(sizes(splits.split_by_tile(df)).values()) == 100
    folds = splits.group_kfold(df, k=3)
    assert folds.count() == 300 and folds.where("split = 'test'").count() == 100
    strata = {(r["label"], r["fold"]): r["count"] for r in splits.stratified_kfold(df, k=5).groupBy("label", "fold").count().collect()}
    assert [strata[None, f] for f in range(5)] == [4] * 5


def test_quantiles_of_one_value(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None)], "k string, v double")
    assert [(r["k"], r["quantile"]) for r in quantiles.exact_quantiles(df, ["k"], "v", [0.25]).collect()] == [("a", 3.0)]


def test_random_ranks_are_dense_under_skew(spark):
    df = spark.range(6000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    out = quantiles.random_rank(df, ["g"], 1, "k").where("g = 'hot'")
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 2001))


def test_mask_share_rounds_to_even_and_masks_one(spark):
    cells = spark.createDataFrame([(p, t, True, 1.0) for p, n in (("a", 5), ("b", 1)) for t in range(n)], "parcel_id string, t int, observed boolean, X double")
    out = sampling.mask_time_steps(cells, ["X"], 0.5)
    seen = {r["parcel_id"]: r["n"] for r in out.groupBy("parcel_id").agg(F.count_if(F.col("observed")).alias("n")).collect()}
    assert seen == {"a": 3, "b": 0}
    assert out.where("NOT observed AND X <> 0").count() == 0


def test_neighbours_with_many_copies(spark):
    # A third of all points are one and the same point.
    rows = [(f"{n:04d}", [1.0, 1.0] if n % 3 == 0 else [float(n % 17), float(n % 23)]) for n in range(600)]
    points = spark.createDataFrame(rows, "parcel_id string, vec array<double>")
    got = {}
    for r in nearest_neighbours(points, points, 4).collect():
        got.setdefault(r["parcel_id"], []).append((r["rank"], r["neighbour"]))
    for name, x in rows:
        near = sorted((((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2) ** 0.5, other) for other, y in rows if other != name)[:4]
        assert [o for _, o in sorted(got[name])] == [o for _, o in near]


def test_neighbours_across_many_blocks(spark, monkeypatch):
    import numpy as np

    from furrow.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)
    x = np.random.default_rng(3).normal(size=(300, 3))
    rows = [(f"{n:03d}", "ab"[n % 2], [float(v) for v in r]) for n, r in enumerate(x)]
    points = spark.createDataFrame(rows, "parcel_id string, label string, vec array<double>")
    got = {(r["parcel_id"], r["rank"]): r["neighbour"] for r in nearest_neighbours(points, points.where("label = 'a'"), 3, "label").collect()}
    assert len(got) == 450
    for n in range(0, 300, 2):
        d = np.sqrt(((x - x[n]) ** 2).sum(1))
        d[n] = np.inf
        d[1::2] = np.inf
        assert [got[f"{n:03d}", k + 1] for k in range(3)] == [f"{m:03d}" for m in np.argsort(d, kind="stable")[:3]]


def sphere(spark, n, dims, seed=5):
    import numpy as np

    x = np.random.default_rng(seed).normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(f"{i:04d}", "abc"[i % 3], [float(v) for v in r]) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "parcel_id string, label string, vec array<double>")


def test_bucket_neighbours_find_most_with_fewer_pairs(spark):
    import numpy as np

    from furrow.operators import neighbours

    x, points = sphere(spark, 900, 8)
    flagged = points.select(F.lit("").alias("g"), F.col("parcel_id").alias("key"), "vec", F.lit(True).alias("is_query"))
    met = neighbours.meetings(*neighbours._buckets(flagged, 42, 4, 5))
    assert met.agg(F.sum(F.col("n_q") * F.col("n_p"))).first()[0] < 0.25 * 900 * 900
    found = {(r["parcel_id"], r["neighbour"]): r["distance"] for r in nearest_neighbours(points, points, 5, method="buckets").collect()}
    right = 0
    for i in range(900):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        right += sum((f"{i:04d}", f"{j:04d}") in found for j in np.argsort(d)[:5])
    assert right >= 0.9 * 4500
    for (a, b), d in list(found.items())[:50]:
        assert d == pytest.approx(float(np.linalg.norm(x[int(a)] - x[int(b)])))
    with pytest.raises(ValueError):
        nearest_neighbours(points, points, 5, method="other")


def test_only_drawn_rows_are_searched(spark, monkeypatch):
    """Nearly balanced classes: few draws, so far fewer pairs than rows squared."""
    from furrow.operators import oversample

    asked = []
    real = oversample.nearest_neighbours
    monkeypatch.setattr(oversample, "nearest_neighbours", lambda points, queries, *a, **b: asked.append(queries) or real(points, queries, *a, **b))
    _, points = sphere(spark, 300, 4)
    points = points.where("parcel_id > '0003'")  # a, b and c miss one, one and two rows
    new = oversample.synthetic_rows(points, 3).collect()
    short = sorted(r["label"] for r in new)
    assert len(short) == len(new) < 5
    assert asked[0].count() == len({r["base"] for r in new}) <= len(new)


def test_close_pairs_survive_the_matrix_form():
    """Far from the origin the matrix product rounds; distances and order are still exact."""
    import numpy as np

    from furrow.operators.neighbours import closest

    rng = np.random.default_rng(1)
    p = 1e6 + rng.normal(size=(400, 5)) * 1e-3
    p[5] = p[7]
    keys = np.array([f"{i:03d}" for i in range(400)], object)
    q, near, distance = closest(keys, p, keys, p, 3)
    for i in range(400):
        d = np.sqrt(((p - p[i]) ** 2).sum(1))
        d[i] = np.inf
        want = np.argsort(d, kind="stable")[:3]
        assert near[q == i].tolist() == keys[want].tolist() and np.allclose(distance[q == i], d[want], rtol=0, atol=1e-12)


def greedy(sizes, k):
    """Folds by walking over every group."""
    loads, folds = [0] * k, []
    for n in sizes:
        at = loads.index(min(loads))
        loads[at] += n
        folds.append(at)
    return loads, folds


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_dealing_in_phases_equals_a_walk(k):
    import random

    rng = random.Random(k)
    for _ in range(200):
        start = [rng.choice([0, 0, 3, 50, rng.randrange(200)]) for _ in range(k)]
        size, count = rng.randint(1, 9), rng.randint(1, 120)
        loads, want = list(start), []
        for _ in range(count):
            at = loads.index(min(loads))
            loads[at] += size
            want.append(at)
        got = list(start)
        phases = splits.deal(got, size, count)
        assert [turn[i % len(turn)] for _, length, turn in phases for i in range(length)] == want and got == loads
        assert len(phases) <= 4 * k * k + 4


def test_a_million_groups_get_folds_in_few_phases():
    loads = [0] * 5
    phases = [splits.deal(loads, n, 1_000_000 // n) for n in (1000, 10, 3, 1)]
    assert sum(map(len, phases)) < 200 and max(loads) - min(loads) <= 1


def test_folds_of_many_groups_equal_the_walk(spark):
    sizes = {f"t{i:04d}": 1 + i * i % 7 + (40 if i % 50 == 0 else 0) for i in range(600)}
    df = spark.createDataFrame([(t,) for t, n in sizes.items() for _ in range(n)], "tile string").repartition(6)
    got = {r["tile"]: (r["test_fold"], r["n"]) for r in splits.group_folds(df, "tile", 4).collect()}
    order = sorted(sizes, key=lambda t: (-sizes[t], t))
    _, folds = greedy([sizes[t] for t in order], 4)
    assert got == {t: (f + 1, sizes[t]) for t, f in zip(order, folds, strict=True)}


def test_lines_of_the_wrong_length_are_named(spark, tmp_path):
    from furrow.sources.readers import bad_lines

    path = tmp_path / "rows.csv"
    path.write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n,,\n")
    assert sorted(r["line"] for r in bad_lines(spark, str(path)).collect()) == ["4,5", "6,7,8,9"]


def test_points_are_packed_once_and_many_blocks_meet(spark, monkeypatch):
    """Groups of one block and of many, far from the origin, equal distances: as by comparing all pairs, and each point is stored once."""
    import numpy as np

    from furrow.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 30)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 7)
    monkeypatch.setattr(neighbours, "MEASURED", 11)
    packed = []
    monkeypatch.setattr(neighbours, "_product", lambda blocks, k, real=neighbours._product: packed.append(blocks.collect()) or real(blocks, k))
    rng = np.random.default_rng(8)
    x = np.where(np.arange(500)[:, None] % 2 == 0, rng.integers(0, 6, (500, 4)), rng.normal(size=(500, 4)) + 1e5).astype(float)
    group = ["big" if i < 460 else f"g{i % 7}" for i in range(500)]
    points = spark.createDataFrame([(f"{i:03d}", group[i], [float(v) for v in x[i]]) for i in range(500)], "parcel_id string, label string, vec array<double>")
    for by in (None, "label"):
        asked = [i for i in range(500) if i % 3]
        got = {(r["parcel_id"], r["rank"]): (r["neighbour"], r["distance"]) for r in nearest_neighbours(points, points.where("cast(parcel_id as int) % 3 > 0"), 4, by).collect()}
        for i in asked:
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            others = sorted((d[j], f"{j:03d}") for j in range(500) if j != i and (by is None or group[j] == group[i]))[:4]
            assert [got.get((f"{i:03d}", k + 1)) for k in range(len(others))] == [(o, pytest.approx(dist)) for dist, o in others]
    for blocks in packed:
        keys = [key for b in blocks for key in b["p_keys"]]
        assert len(keys) == len(set(keys)) and max(len(b["p_keys"]) for b in blocks) < 4 * 30 and len(blocks) > 8


@pytest.mark.parametrize("px", [1, 40])
def test_zones_by_pixels_or_by_sums(spark, monkeypatch, px):
    """Small zones are shuffled as pixels, once; large ones are combined first; either gives the plain result."""
    from furrow.operators import raster

    monkeypatch.setattr(raster, "LARGE_LOT_PX", 100)
    n = F.col("id")
    pixels = spark.range(0, 4000, 1, 4).select(
        F.concat(F.lit("T"), (n % 1).cast("string")).alias("tile"),  # no constants, which the plan would fold
        F.date_add(F.lit(DAY0), (n % 1).cast("int")).alias("date"),
        F.when(n % 4 == 0, F.lit(-1)).when(n % 101 == 1, F.lit(None)).otherwise(F.floor(n / px)).cast("long").alias("parcel_id"),
        *[(n % k + 1).cast("double").alias(b) for b, k in (("nir", 97), ("red", 31), ("green", 13), ("blue", 7), ("swir", 53))],
        (n % 12).cast("int").alias("scl"),
    )
    large = raster._large_lots(pixels.where("parcel_id is not null"), raster.ZONE)
    assert large is None if px == 40 else len(large) == 1  # a fourth of all pixels is one parcel
    got = raster.zonal_indices(pixels)
    want = raster.zonal_stats(raster.masked_indices(pixels))
    assert got.columns == want.columns
    same = {r["parcel_id"]: r.asDict() for r in want.collect()}
    rows = got.collect()
    assert len(rows) == len(same)
    for r in rows:
        assert r.asDict() == pytest.approx(same[r["parcel_id"]])
    small = raster.zonal_indices(pixels.where("parcel_id >= 0"))
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert px == 40 or plan.index("Exchange hashpartitioning") > plan.rindex("HashAggregate")  # below both steps of the aggregation


def test_names_are_ordered_for_equal_distances_alone():
    import numpy as np

    from furrow.operators import neighbours

    class Name(str):
        def __str__(self):
            raise AssertionError("compared without need")

    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 5))
    names = np.array([Name(f"p{i:03}") for i in range(300)], object)
    seen = neighbours._Nearest(names[:40], points[:40], 7)
    for part in np.array_split(np.arange(300), 3):
        seen.see(names[part], points[part])
    gap = np.linalg.norm(points[:40, None] - points[None], axis=2)
    np.fill_diagonal(gap, np.inf)
    want = [(i, int(j)) for i in range(40) for j in np.argsort(gap[i])[:7]]
    order = np.lexsort((seen.distance, seen.at))
    assert [(int(i), int(n[1:])) for i, n in zip(seen.at[order], seen.names[order])] == want
    # Ties still go to the smaller key, whatever the order of the blocks.
    tied = neighbours._Nearest(np.array(["q"], object), np.zeros((1, 2)), 2)
    for name in ("c", "a", "b"):
        tied.see(np.array([name], object), np.array([[1.0, 0.0]]))
    assert sorted(tied.names) == ["a", "b"]
