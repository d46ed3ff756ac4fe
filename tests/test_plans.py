"""Sources, sinks and whole paths."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from furrow.checks import views as v
from furrow.config import SEQUENCE, TabularParams, TensorParams
from furrow.operators import aggregate, evaluate, models, oversample, phenology, scenes, spatial, splits, timegrid
from furrow.operators.aggregate import first_label
from furrow.operators.timegrid import from_tensor
from furrow.plans import long_table, tabular, tensor
from furrow.sources import prepared, readers, runs, writers

SF = "/root/testdata/sf0.001"
NAMES = ("CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW")


@pytest.fixture(scope="module")
def obs(spark):
    return v.obs(spark, "/root/testdata/sf0.01").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return v.parcel_labels(spark, "/root/testdata/sf0.01").cache()


def test_observation_csv(spark, tmp_path):
    path = str(tmp_path / "obs.csv")
    (tmp_path / "obs.csv").write_text(
        "date,extra,ID_PARCEL,index,value_mean,px_count,cloud_scene,tile\n"
        "2024-01-12,x,7,NDVI,0.5,12,3.5,T1\nnever,x,8,NDVI,n/a,1.0,,T1\n"
    )
    rows = readers.read_observations(spark, path).orderBy("parcel_id").collect()
    assert rows[0].asDict() == {"date": dt.date(2024, 1, 12), "tile": "T1", "parcel_id": "7", "idx": "NDVI", "value_mean": 0.5, "px_count": 12, "cloud_scene": 3.5}
    assert rows[1]["date"] is None and rows[1]["value_mean"] is None and rows[1]["px_count"] == 1


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "t.csv").write_text("date,tile\n2024-01-01,T1\n")
    with pytest.raises(ValueError, match="parcel_id"):
        readers.read_training(spark, str(tmp_path / "t.csv"))


def test_labels_keep_input_order(spark, tmp_path):
    lines = ["ID_PARCEL,CODE_CULTU,CODE_GROUP"] + [f"{n % 50},c{n},g" for n in range(500)] + ["999,,g"]
    (tmp_path / "l.csv").write_text("\n".join(lines))
    raw = readers.read_labels(spark, str(tmp_path / "l.csv"), "ID_PARCEL", "CODE_CULTU", "CODE_GROUP")
    assert raw.count() == 500
    got = {r["parcel_id"]: r["label"] for r in first_label(raw).collect()}
    assert got == {str(n): f"c{n}" for n in range(50)}


def test_sinks(spark, obs, tmp_path):
    few = obs.orderBy("parcel_id", "date", "idx", "value_mean").limit(200).cache()
    writers.write_parquet(few, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).exceptAll(few).count() == 0
    writers.write_csv(few, str(tmp_path / "c"))
    assert readers.read_observations(spark, str(tmp_path / "c")).select(few.columns).exceptAll(few).count() == 0
    writers.append_training(few, str(tmp_path / "t"), "one")
    writers.append_training(few, str(tmp_path / "t"), "two")
    writers.append_training(few, str(tmp_path / "t"), "two")  # tried again
    assert spark.read.parquet(str(tmp_path / "t")).count() == 400
    assert {d.name for d in (tmp_path / "t").glob("tile=*")} == {f"tile={r[0]}" for r in few.select("tile").distinct().collect()}
    writers.write_json(few.select(F.struct("tile", "idx").alias("s")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).select("s.tile").count() == 200
    writers.write_metrics(spark, {"a": {"b": 1.5}}, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).select("a.b").first()[0] == 1.5


def test_runs(spark, tmp_path):
    for n, score in enumerate((0.25, 0.75, 0.5)):
        folder = tmp_path / f"run{n}"
        folder.mkdir()
        (folder / "test_metrics.json").write_text(json.dumps({"accuracy": score, "f1_macro": score, "nested": {"x": [1]}}, indent=2))
    table = runs.collect_runs(spark, str(tmp_path / "*" / "test_metrics.json"))
    ranked = evaluate.rank_runs(table, "f1_macro").collect()
    assert [r["run"] for r in ranked] == ["run1", "run2", "run0"]
    assert runs.newest_run(table).first()["run"] in {"run0", "run1", "run2"}
    assert table.select("f1_weighted").where("f1_weighted IS NOT NULL").count() == 0


def test_build_training(spark, obs, labels):
    out = long_table.build_training(obs, labels, ["VIEW", "CLICK"], 40.0, 10, 290)
    assert set(out.select("idx").distinct().toPandas()["idx"]) == {"VIEW", "CLICK"}
    assert out.where("cloud_scene > 40 OR px_count < 10 OR label IS NULL").count() == 0


@pytest.mark.parametrize("fit_on", ["train", "all"])
def test_tabular_features(spark, obs, labels, fit_on):
    p = TabularParams(indices=NAMES, min_class_count=20, max_dates=10, fit_on=fit_on)
    agg = tabular.cells(obs, labels, p)
    kept = tabular.targets(agg, labels, p)
    table = tabular.feature_table(agg, kept, p)
    features = [c for c in table.columns if "__" in c]
    assert len(features) == 10 * 5 + 9 * 5
    assert table.count() == kept.count() > 0
    missing = table.select(*[F.count_if(F.col(f"`{c}`").isNull()).alias(str(n)) for n, c in enumerate(features)]).first()
    assert sum(missing) == 0
    assert set(table.select("split").distinct().toPandas()["split"]) == {"train", "test"}


def test_sequence_features(spark, obs, labels):
    p = TabularParams(indices=("CLICK", "VIEW"), min_class_count=20, max_dates=SEQUENCE.max_dates, phenology=False, fill="interleaved")
    agg = tabular.cells(obs, labels, p)
    kept = tabular.targets(agg, labels, p)
    table = tabular.feature_table(agg, kept, p)
    assert sum("__" in c for c in table.columns) == 60
    season = tabular.season_table(agg, kept, p)
    assert season.where("n_valid_dates < 1 OR VIEW_peak_pos > 1 OR VIEW_amplitude < 0").count() == 0


@pytest.mark.parametrize("frequency,method", [(None, "parcel"), ("5D", "tile")])
def test_prepare_and_round_trip(spark, obs, labels, tmp_path, frequency, method):
    p = TensorParams(indices=NAMES, frequency=frequency, min_obs=3, split_method=method)
    out = tensor.prepare(obs.join(labels, "parcel_id"), p)
    assert out.features == sorted(NAMES)
    assert len(out.dates) == (30 if frequency is None else 6)
    row = out.rows.first()
    assert len(row["features"]) == len(row["observed"]) == len(out.dates) and len(row["features"][0]) == 5
    assert out.rows.where(F.size(F.filter("observed", lambda o: o)) < 3).count() == 0
    assert set(out.rows.select("split").distinct().toPandas()["split"]) == {"train", "val", "test"}
    assert out.rows.where("group_id NOT IN (-100, 0, 1)").count() == 0
    prepared.save_prepared(out, str(tmp_path / "prep"))
    back = prepared.load_prepared(spark, str(tmp_path / "prep"))
    assert (back.features, back.dates) == (out.features, out.dates)
    assert sorted(back.rows.columns) == sorted(out.rows.columns)
    assert back.rows.count() == out.rows.count()
    assert [r["label"] for r in back.labels.orderBy("label_id").collect()] == sorted(r["label"] for r in out.labels.collect())
    assert from_tensor(back.rows, back.features, ["split"]).count() == back.rows.count() * len(back.dates)


def test_old_tables_get_defaults(spark):
    old = spark.createDataFrame([("p", [True, False])], "parcel_id string, observed array<boolean>")
    row = prepared.with_defaults(old).first()
    assert (row["cloud"], row["px"], row["group_id"]) == ([100.0, 100.0], [0.0, 0.0], -100)


def test_pick_scenes_and_observe(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    ring = "array<struct<x double, y double>>"
    parcels = spark.createDataFrame([("a", square(0.1, 0.1, 0.2)), ("b", square(0.6, 0.6, 0.2)), ("c", square(5.0, 5.0, 0.2))], f"parcel_id string, ring {ring}")
    bands = {b: "href" for b in ("B02", "B03", "B04", "B08", "B11", "SCL")}
    d = dt.date
    rows = [
        ("s1", d(2024, 1, 2), "T1", 10.0, square(0.0, 0.0, 1.0), bands),
        ("s2", d(2024, 1, 3), "T1", 5.0, square(0.0, 0.0, 0.5), bands),
        ("s3", d(2024, 1, 7), "T1", 20.0, square(0.0, 0.0, 0.5), {"B02": "href"}),
        ("s4", d(2024, 1, 8), "T1", 85.0, square(0.0, 0.0, 1.0), bands),
        ("s5", d(2024, 1, 12), "T1", 1.0, square(9.0, 9.0, 0.5), bands),
    ]
    from furrow.operators.spatial import with_box

    catalogue = with_box(spark.createDataFrame(rows, f"scene_id string, date date, tile string, cloud double, footprint {ring}, assets map<string,string>"), "footprint")
    picked = long_table.pick_scenes(catalogue, with_box(parcels), "2024-01-01", "2024-12-31", 0.25)
    # s2 covers less, s3 lacks bands, s4 is too cloudy, s5 covers nothing.
    assert [(r["scene_id"], r["coverage"]) for r in picked.collect()] == [("s1", 2)]
    pixels = spark.createDataFrame(
        [("T1", d(2024, 1, 2), "a", 0, c, 3000.0, 1000.0, 900.0, 800.0, 700.0, 4 if c < 12 else 9) for c in range(14)]
        + [("T1", d(2024, 1, 2), "b", 0, 0, 3000.0, 1000.0, 900.0, 800.0, 700.0, 4), ("T1", d(2024, 1, 9), "a", 0, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 4)],
        "tile string, date date, parcel_id string, row_no int, col_no int, nir double, red double, green double, blue double, swir double, scl int",
    )
    out = long_table.observe_parcels(pixels, picked)
    assert out.count() == 11 and {r[0] for r in out.select("parcel_id").distinct().collect()} == {"a"}
    ndvi = out.where("idx = 'NDVI'").first()
    assert ndvi["px_count"] == 12 and ndvi["value_mean"] == pytest.approx(0.5) and ndvi["cloud_scene"] == 10.0


def test_synthetic_points_lie_on_segments(spark):
    rows = [(f"{n:03d}", "big" if n < 60 else "small", float(n % 7), float(n % 11)) for n in range(90)]
    train = spark.createDataFrame(rows, "parcel_id string, label string, x double, y double")
    new = oversample.synthetic_rows(oversample.with_vec(train, ["x", "y"])).collect()
    at = {r[0]: r[2:] for r in rows}
    assert len(new) == 30
    for r in new:
        a, b = at[r["base"]], at[r["neighbour"]]
        assert r["vec"] == pytest.approx([a[k] + r["gap"] * (b[k] - a[k]) for k in (0, 1)])
        assert r["label"] == "small"


def test_models(spark):
    df = spark.range(300).select(
        F.col("id").cast("string").alias("parcel_id"),
        (F.col("id") % 3).cast("int").alias("label_id"),
        ((F.col("id") % 3) + (F.col("id") % 7) / 20.0).alias("a"),
        ((F.col("id") % 13) / 13.0).alias("b"),
    )
    forest = models.fit_random_forest(df, ["a", "b"], trees=5, depth=3)
    assert models.macro_f1(forest.transform(df)) > 0.95
    imp = models.feature_importance(forest, ["a", "b"], spark).collect()
    assert imp[0]["feature"] == "a" and sum(r["importance"] for r in imp) == pytest.approx(1.0)
    rows = df.withColumn("hold", F.col("parcel_id").cast("int") % 5 == 0)
    boosted = models.fit_boosted_trees(rows, ["a", "b"], validation="hold", n_rounds=3, depth=2)
    assert models.macro_f1(boosted.transform(df)) > 0.95
    assert sum(r["importance"] for r in models.feature_importance(boosted, ["a", "b"], spark).collect()) == pytest.approx(1.0)


def test_small_side_leaves_large_tables_distributed(spark):
    from furrow.session import small_side

    big = spark.range(100)
    assert small_side(big, 50) is big
    assert small_side(big, 100).count() == 100


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_statistics_need_two_exchanges_and_no_python(obs):
    plan = executed(phenology.phenology(aggregate.weighted_mean(obs)))
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_one_exchange_by_parcel_serves_the_arrays(spark, obs):
    binned = obs.select("parcel_id", "date", "idx", "value_mean", "cloud_scene", "px_count").repartition("parcel_id")
    steps = tensor.step_rows(binned, ["CLICK", "VIEW"])
    plan = executed(timegrid.to_tensor(steps, ["CLICK", "VIEW"], [dt.date(2024, 1, 1)]))
    assert plan.count("Exchange hashpartitioning") == 1


def test_split_rows_are_not_shuffled(spark, labels):
    plan = executed(splits.stratified_split(labels))
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_scene_search_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "scenes")
    v.scenes(spark, SF).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = executed(scenes.search_scenes(spark.read.parquet(path), "1995-01-01", "1995-12-31").select("scene_id"))
    pushed = plan[plan.index("PushedFilters") :]
    for condition in ("GreaterThanOrEqual(date", "LessThanOrEqual(date", "LessThan(cloud"):
        assert condition in pushed
    assert "coverage" not in plan[plan.index("ReadSchema") :]


def test_scene_rank_is_limited_before_the_exchange(spark):
    plan = executed(scenes.select_scenes(v.scenes(spark, SF), "1992-01-01"))
    assert plan.count("WindowGroupLimit") == 2


def test_spatial_join_is_no_nested_loop(spark):
    plan = executed(spatial.parcels_in_footprint(v.parcel_boxes(spark, SF), v.scene_boxes(spark, SF), 1.0))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
