"""Documents larger than a task: running counts by blocks, cells by sweep."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import giants, sweeps
from paperloom.operators import windows as wn


def turns(spark, n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["giant"] * 8 + ["small", None]), k, rng.random() < 0.1 if rng.random() < 0.9 else None, rng.choice(["a", "b", None]), rng.choice([0, 1])) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc string, `at.row` long, cut boolean, num string, level int").withColumnRenamed("at.row", "pos")


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_by_blocks_equal_windows(spark, seed):
    df = turns(spark, 3000, seed)
    by, order = ["doc"], ["pos"]
    held = giants.blocked(df, by, order, rows=150)
    sizes = {(r.doc, r._block): r["count"] for r in held.groupBy("doc", "_block").count().collect()}
    assert len([k for k in sizes if k[0] == "giant"]) >= 10 and max(sizes.values()) < 1000
    pairs = [
        (wn.islands(df, by, order, F.col("cut")), giants.islands(held, by, order, F.col("cut"))),
        (wn.numbered_markers(df, by, order, F.col("cut"), ["num", "level"]), giants.numbered_markers(held, by, order, F.col("cut"), ["num", "level"])),
        (wn.node_ids(df.withColumn("p", F.coalesce("num", F.lit("t"))), by, "p", order), giants.node_ids(held.withColumn("p", F.coalesce("num", F.lit("t"))), by, "p", order)),
    ]
    for plain, split in pairs:
        columns = plain.columns
        assert sorted(split.select(columns).collect(), key=str) == sorted(plain.collect(), key=str)


def test_counts_of_nothing(spark):
    held = giants.blocked(turns(spark, 3, 1).limit(0), ["doc"], ["pos"])
    assert giants.numbered_markers(giants.islands(held, ["doc"], ["pos"], F.col("cut")), ["doc"], ["pos"], F.col("cut"), ["num"]).count() == 0


def brute_kept(cells):
    kept = []
    for c in sorted(cells):
        if not any(k[0] <= c[0] < k[0] + k[3] and k[1] <= c[1] < k[1] + k[2] for k in kept):
            kept.append(c)
    return kept


def brute_columns(cells):
    placed = []
    for row, k, colspan, rowspan in sorted(cells):
        x = max([p[1] + p[2] for p in placed if p[0] == row], default=0)
        while any(p[0] < row < p[0] + p[3] and p[1] <= x < p[1] + p[2] for p in placed):
            x += 1
        placed.append((row, x, colspan, rowspan, k))
    return placed


def test_cells_by_sweep_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(t, rng.randrange(-2, 9), rng.randrange(-2, 9), rng.choice([0, 1, 1, 2, 5, 2**31 - 1]), rng.choice([0, 1, 1, 2, 7])) for t in range(60) for _ in range(rng.randrange(1, 50))]
    df = spark.createDataFrame(rows, "t long, row_index int, column_index int, colspan int, rowspan int")
    found = sorted(tuple(r) for r in sweeps.kept_cells(df, ["t"]).collect())
    assert found == sorted((t, *c) for t in range(60) for c in brute_kept([r[1:] for r in rows if r[0] == t]))
    rows = [(t, r, k, rng.choice([1, 1, 2, 4]), rng.choice([1, 1, 2, 6])) for t in range(40) for r in range(rng.randrange(1, 9)) for k in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "t long, row int, k int, colspan int, rowspan int")
    found = sorted((r.t, r.row, r.column, r.colspan, r.rowspan, r.k) for r in sweeps.placed_cells(df, ["t"]).collect())
    assert found == sorted((t, *c) for t in range(40) for c in brute_columns([r[1:] for r in rows if r[0] == t]))


def test_cells_with_nulls_stay_and_cover_nothing(spark):
    df = spark.createDataFrame([(None, 0, 0, None, 3), (None, 0, 0, 1, 1), (None, 0, 0, 1, 1), (None, None, 0, 9, 9), (None, 0, None, 9, 9)], "t string, row_index int, column_index int, colspan int, rowspan int")
    assert sweeps.kept_cells(df, ["t"]).count() == 4
    assert sweeps.kept_cells(df.limit(0), ["t"]).count() == 0


def test_one_table_of_many_cells(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("t"), F.floor(F.col("id") / 50).cast("int").alias("row_index"), (F.col("id") % 50).cast("int").alias("column_index"), F.lit(2).alias("colspan"), F.lit(2).alias("rowspan"))
    found = sweeps.kept_cells(df, ["t"])
    assert found.count() == n // 4 and found.where("row_index % 2 = 1 or column_index % 2 = 1").count() == 0
    wide = df.select("t", F.lit(0).alias("row"), F.col("row_index").alias("r"), F.col("column_index").alias("k"), "colspan", "rowspan").select("t", F.col("r").alias("row"), "k", "colspan", "rowspan")
    assert sweeps.placed_cells(wide, ["t"]).count() == n
