"""Reproducible train/validation/test splits and folds.

Rows are ordered by a hash of their key, so a split is a set of rank limits per class. The limits
become cut points first; assigning rows is then a projection with a small lookup, whatever the
size of a class.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.draws import uniform
from furrow.operators.quantiles import join_null_safe, rank_cutoffs, with_draw
from furrow.session import cut_lineage, small_side

# Search limits of the tile split.
EXHAUSTIVE_TILES = 12
SAMPLED_CANDIDATES = 25_000


def _assign(df: DataFrame, by: Sequence[str], targets: DataFrame, seed, key: str, names: Sequence[str], rest: str) -> DataFrame:
    """Add ``split``: the first of ``names`` whose cut point the row does not exceed, else ``rest``."""
    by = list(by)
    cuts = rank_cutoffs(df, by, targets, seed, key)
    table = small_side(cuts.groupBy(*by).agg(*[F.max(F.when(F.col("tag") == n, F.col("cut"))).alias(f"_{n}") for n in names]))
    at = F.struct("_h", F.col(key).alias("_k"))
    split = reduce(lambda acc, n: F.when(at <= F.col(f"_{n}"), n).otherwise(acc), reversed(names), F.lit(rest))
    joined = join_null_safe(with_draw(df, seed, key), table, by, "left")
    return joined.withColumn("split", split).drop("_h", *[f"_{n}" for n in names])


def allot(table: DataFrame, label: str, n: str, total: Column, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Share ``total`` over the classes in proportion to ``n``: floors plus largest remainders."""
    every = Window.partitionBy(*within)
    share = F.col(n) * total / F.sum(n).over(every)
    order = Window.partitionBy(*within).orderBy(F.desc("_rest"), label)
    return (
        table.withColumn("_share", share)
        .withColumn("_rest", F.col("_share") - F.floor("_share"))
        .withColumn("_left", total - F.sum(F.floor("_share")).over(every))
        .withColumn(out, (F.floor("_share") + F.when(F.row_number().over(order) <= F.col("_left"), 1).otherwise(0)).cast("long"))
        .drop("_share", "_rest", "_left")
    )


def _class_table(df: DataFrame, label: str) -> DataFrame:
    return small_side(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")))


def stratified_split(df: DataFrame, label: str = "label", frac: float = 0.2, seed: int = 42, key: str = "parcel_id", name: str = "test", rest: str = "train") -> DataFrame:
    """Hold out ceil(n * frac) rows, in proportion to the classes."""
    every = Window.partitionBy()
    total = F.ceil(F.sum("n").over(every) * F.lit(float(frac)))
    sizes = allot(_class_table(df, label).withColumn("_k", total), label, "n", F.col("_k"), "k")
    targets = small_side(sizes.select(label, F.lit(name).alias("tag"), "k"))
    return _assign(df, [label], targets, seed, key, [name], rest)


def inner_val_split(train: DataFrame, frac: float = 0.15, seed: int = 42, label: str = "label", key: str = "parcel_id") -> DataFrame:
    return stratified_split(train, label, frac, seed, key, name="val", rest="fit")


def _ceil(x: float) -> int:
    return -int(-x // 1)


def split_by_parcel(df: DataFrame, test: float = 0.2, val: float = 0.1, seed: int = 42, stratify: bool = True, label: str = "label", key: str = "parcel_id") -> DataFrame:
    """Train/val/test; stratified where the classes allow it, else plain."""
    if not 0 < test < 1:
        raise ValueError("test must be in (0, 1)")
    if not 0 <= val < 1:
        raise ValueError("val must be in [0, 1)")
    if test + val >= 1:
        raise ValueError("test + val must be < 1")
    table = _class_table(df, label)
    facts = table.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.min("n").alias("low")).first()
    n, n_classes, low = facts["n"] or 0, facts["k"], facts["low"] or 0
    if n == 0:
        return df.withColumn("split", F.lit("train"))
    gaps = False
    if dict(df.dtypes)[label] in ("int", "bigint", "smallint"):
        gaps = table.agg(F.max(label)).first()[0] + 1 > n_classes
    n_test = _ceil(n * test)
    n_rest = n - n_test
    n_val = _ceil(n_rest * (val / (1.0 - test)))
    if val <= 0 or n_rest < 2 or n_val >= n_rest:
        n_val = 0

    def fits(lowest: int, classes: int, rows: int, take: int) -> bool:
        return stratify and not gaps and classes >= 2 and lowest >= 2 and min(take, rows - take) >= classes

    plain = df.withColumn("_one", F.lit(0))
    if fits(low, n_classes, n, n_test):
        sizes = allot(table, label, "n", F.lit(n_test), "k_test").withColumn("_rem", F.col("n") - F.col("k_test"))
        spare = sizes.agg(F.min("_rem")).first()[0]
        if n_val == 0 or fits(spare, n_classes, n_rest, n_val):
            sizes = allot(sizes, label, "_rem", F.lit(n_val), "k_val")
            tags = F.array(
                F.struct(F.lit("test").alias("tag"), F.col("k_test").alias("k")),
                F.struct(F.lit("val").alias("tag"), (F.col("k_test") + F.col("k_val")).alias("k")),
            )
            targets = small_side(sizes.select(label, F.explode(tags).alias("_t")).select(label, "_t.*"))
            return _assign(df, [label], targets.where("k > 0"), seed, key, ["test", "val"], "train")
        # Too few rows per class are left for validation: draw it plainly from the rest.
        first = _assign(df, [label], small_side(sizes.select(label, F.lit("test").alias("tag"), F.col("k_test").alias("k"))), seed, key, ["test"], "train")
        rest = first.where("split = 'train'").drop("split").withColumn("_one", F.lit(0))
        second = _assign(rest, ["_one"], _targets(df, [("val", n_val)]), seed, key, ["val"], "train").drop("_one")
        return first.where("split = 'test'").unionByName(second)
    wanted = [("test", n_test)] + ([("val", n_test + n_val)] if n_val else [])
    return _assign(plain, ["_one"], _targets(df, wanted), seed, key, ["test", "val"], "train").drop("_one")


def _targets(df: DataFrame, wanted: list[tuple[str, int]]) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(0, t, k) for t, k in wanted], "_one int, tag string, k long"))


def tile_assignment(tiles: DataFrame, test: float, val: float, seed: int = 42) -> dict[str, str] | None:
    """Tile to split, chosen so that the parcel shares come nearest to the wanted ones.

    ``tiles`` has one row per tile with its parcel count ``n``. Up to 12 tiles every assignment
    is scored, above that a fixed number of hashed ones; the candidates are a Spark range, so the
    scoring is distributed. None if no candidate fills every part.
    """
    if test + val >= 1:
        raise ValueError("test + val must be < 1")
    spark = tiles.sparkSession
    counts = [(r["tile"], r["n"]) for r in tiles.orderBy("tile").collect()]
    total = sum(n for _, n in counts)
    parts = ["train", "val", "test"] if val > 0 else ["train", "test"]
    base, k = len(parts), len(counts)
    sizes = F.array(*[F.lit(n).cast("long") for _, n in counts])
    if k <= EXHAUSTIVE_TILES:
        candidates = spark.range(base**k)
        powers = F.array(*[F.lit(base ** (k - 1 - j)).cast("long") for j in range(k)])
        digits = F.transform(powers, lambda p: (F.floor(F.col("id") / p) % base).cast("int"))
    else:
        candidates = spark.range(SAMPLED_CANDIDATES)
        digits = F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(uniform(seed, F.col("id"), j) * base).cast("int")
        )

    def held(part: str) -> Column:
        d = F.lit(parts.index(part))
        return F.aggregate(F.zip_with("_d", sizes, lambda a, n: F.when(a == d, n).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, v: acc + v)

    scored = candidates.withColumn("_d", digits).withColumns({f"_{p}": held(p) for p in parts})
    score = F.abs(F.col("_train") / total - F.lit(1.0 - test - val)) + F.abs(F.col("_test") / total - F.lit(test))
    if val > 0:
        score = score + F.abs(F.col("_val") / total - F.lit(val))
    filled = reduce(lambda a, b: a & b, [F.col(f"_{p}") > 0 for p in parts])
    best = scored.where(filled).agg(F.min_by("_d", F.struct(score, "id")).alias("d")).first()["d"]
    return None if best is None else {tile: parts[d] for (tile, _), d in zip(counts, best)}


def split_by_tile(df: DataFrame, test: float = 0.2, val: float = 0.1, seed: int = 42, stratify: bool = True, label: str = "label", key: str = "parcel_id") -> DataFrame:
    """Whole tiles go to one part. Falls back to the parcel split below 3 tiles."""
    tiles = df.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    if tiles.limit(3).count() < 3:
        return split_by_parcel(df, test, val, seed, stratify, label, key)
    chosen = tile_assignment(tiles, test, val, seed)
    if chosen is None:
        return split_by_parcel(df, test, val, seed, stratify, label, key)
    table = df.sparkSession.createDataFrame(list(chosen.items()), "tile string, split string")
    return join_null_safe(df, small_side(table), ["tile"])


def create_splits(df: DataFrame, method: str = "parcel", **kwargs) -> DataFrame:
    methods = {"parcel": split_by_parcel, "tile": split_by_tile}
    if method not in methods:
        raise ValueError(f"unknown split method: {method}")
    return methods[method](df, **kwargs)


def deal(loads: list[int], size: int, count: int) -> list[tuple[int, int, list[int]]]:
    """Deal ``count`` groups of one size, each to the lightest fold (of equals the first); adds to ``loads``.

    Returns phases (start, length, folds): within a phase the folds take turns. The lightest folds, those within one size of the
    lightest, lap each other until the next fold is reached, so the number of phases depends on the number of folds alone.
    """
    phases: list[tuple[int, int, list[int]]] = []
    done = 0
    while done < count:
        order = sorted(range(len(loads)), key=lambda j: (loads[j], j))
        lightest = order[0]
        turn = [j for j in order if (loads[j], j) < (loads[lightest] + size, lightest)] or [lightest]
        rest = order[len(turn):]
        laps = (count - done) // len(turn) if not rest else min((loads[rest[0]] - loads[turn[-1]]) // size, (count - done) // len(turn))
        if laps:
            taken = laps * len(turn)
            for j in turn:
                loads[j] += laps * size
        else:
            taken, turn = 1, [lightest]
            loads[lightest] += size
        phases.append((done, taken, turn))
        done += taken
    return phases


def group_folds(df: DataFrame, group: str = "tile", k: int = 5) -> DataFrame:
    """Fold (1..k) of each group: largest group first (of equals by name), always into the lightest fold.

    Groups of one size form a run. The walk over the runs keeps nothing but the k loads, and there are at most as many runs as the square root
    of twice the rows; a group then finds its fold by its place in its run.
    """
    spark = df.sparkSession
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    # Sorted once and stored with its partition, so that places are counted per partition.
    ordered = cut_lineage(sizes.orderBy(F.desc("n"), group).withColumn("_part", F.spark_partition_id()))
    counts = ordered.groupBy("n", "_part").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n"), "_part").collect()  # runs and partitions
    if sum(r["c"] for r in counts) < k:
        raise ValueError(f"fewer groups than folds: {k}")
    loads, runs, places = [0] * k, [], []
    for n, rows in groupby(counts, key=lambda r: r["n"]):
        place = 0
        for r in rows:
            places.append((n, r["_part"], place))
            place += r["c"]
        runs.append((n, [(start, length, turn) for start, length, turn in deal(loads, n, place)]))
    runs = spark.createDataFrame(runs, "n long, phases array<struct<start: long, length: long, turn: array<int>>>")
    places = spark.createDataFrame(places, "n long, _part int, place long")
    inside = Window.partitionBy("n", "_part").orderBy(group)
    placed = ordered.withColumn("_at", F.row_number().over(inside) - 1).join(places, ["n", "_part"]).withColumn("_at", F.col("_at") + F.col("place"))
    phase = F.get(F.filter("phases", lambda p: (p["start"] <= F.col("_at")) & (F.col("_at") < p["start"] + p["length"])), F.lit(0))
    found = placed.join(runs, "n").withColumn("_p", phase)
    turn = F.pmod(F.col("_at") - F.col("_p.start"), F.size("_p.turn").cast("long")).cast("int")
    return found.select(group, (F.get("_p.turn", turn) + 1).alias("test_fold"), "n")


def group_kfold(df: DataFrame, group: str = "tile", k: int = 5, val: float = 0.1, seed: int = 42, label: str = "label", key: str = "parcel_id") -> DataFrame:
    """One row per (fold, row): its part in that fold, with a validation share drawn from the rest.

    All folds are drawn in one pass; the draw of a fold uses seed + fold.
    """
    table = small_side(group_folds(df, group, k).select(group, "test_fold"))
    folds = F.explode(F.sequence(F.lit(1), F.lit(k)))
    rows = join_null_safe(df.select(key, group, label), table, [group]).withColumn("fold", folds)
    test = rows.where(F.col("fold") == F.col("test_fold")).withColumn("split", F.lit("test"))
    rest = rows.where(F.col("fold") != F.col("test_fold"))
    if val <= 0:
        parts = rest.withColumn("split", F.lit("train"))
    else:
        classes = rest.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n"))
        each = Window.partitionBy("fold")
        total = F.ceil(F.sum("n").over(each) * F.lit(float(val)))
        fits = (F.min("n").over(each) >= 2) & (F.count(F.lit(1)).over(each) >= 2) & (
            F.least("_k", F.sum("n").over(each) - F.col("_k")) >= F.count(F.lit(1)).over(each)
        )
        table = small_side(classes.withColumn("_k", total).withColumn("_fits", fits))
        # A fold whose classes are too small is drawn as one group.
        rest = join_null_safe(rest, table.select("fold", label, "_fits"), ["fold", label]).withColumn(
            "_by", F.when(F.col("_fits"), F.col(label).cast("string")).otherwise(F.lit(""))
        )
        groups = table.groupBy("fold", F.when(F.col("_fits"), F.col(label).cast("string")).otherwise(F.lit("")).alias("_by")).agg(
            F.sum("n").alias("n"), F.first("_k").alias("_k")
        )
        sizes = allot(groups, "_by", "n", F.col("_k"), "k", within=["fold"])
        targets = small_side(sizes.select("fold", "_by", F.lit("val").alias("tag"), "k"))
        parts = _assign(rest, ["fold", "_by"], targets, F.lit(seed) + F.col("fold"), key, ["val"], "train").drop("_by", "_fits")
    return test.unionByName(parts).select("fold", key, group, label, "split")


def stratified_kfold(df: DataFrame, label: str = "label", k: int = 5, seed: int = 42, key: str = "parcel_id") -> DataFrame:
    """Add ``fold`` (0..k-1): each class is cut into k equal blocks of its random order."""
    table = _class_table(df, label)
    steps = F.explode(F.sequence(F.lit(1), F.lit(k - 1)))
    targets = (
        table.withColumn("_f", steps)
        .select(label, F.col("_f").cast("string").alias("tag"), F.ceil(F.col("_f") * F.col("n") / k).alias("k"))
    )
    cuts = rank_cutoffs(df, [label], small_side(targets), seed, key)
    lists = small_side(cuts.groupBy(label).agg(F.collect_list("cut").alias("_cuts")))
    at = F.struct("_h", F.col(key).alias("_k"))
    fold = F.size(F.filter("_cuts", lambda c: at > c))
    joined = join_null_safe(with_draw(df, seed, key), lists, [label], "left")
    return joined.withColumn("fold", F.coalesce(fold, F.lit(0))).drop("_h", "_cuts")
