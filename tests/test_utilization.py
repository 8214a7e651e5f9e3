import numpy as np
import pytest

from jobscope.operators.utilization import (histogram, unit_means, util_bands,
                                            wide_to_long)
from jobscope.sources.readers import rename_wide


def hist(spark, values):
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in values],
                               "mean_util double")
    rows = sorted(histogram(df, bins=10).collect(), key=lambda r: r.bin)
    return rows


@pytest.mark.parametrize("values", [
    [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 3.3],
    [5, 5, 5],                 # all equal
    [0, 100],                  # two values, exact max
    [12.5],                    # one unit
    [0.1, 0.2, 0.30000000000000004, 99.9, None],
])
def test_histogram_vs_numpy(spark, values):
    rows = hist(spark, values)
    clean = [v for v in values if v is not None]
    counts, edges = np.histogram(clean, bins=10)
    assert [r.bin for r in rows] == list(range(10))
    assert [r.n for r in rows] == list(counts)
    assert sum(r.n for r in rows) == len(clean)
    if min(clean) != max(clean):
        assert rows[0].bin_lo == pytest.approx(edges[0])
        assert rows[-1].bin_hi == pytest.approx(edges[-1])


def test_histogram_no_units(spark):
    rows = hist(spark, [])
    assert [r.n for r in rows] == [0] * 10


def test_histogram_by_group(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 7.0)], "cluster string, mean_util double")
    out = histogram(df, bins=2, by=["cluster"]).collect()
    got = {(r.cluster, r.bin): r.n for r in out}
    # a lone value sits in the upper half of its widened range, as in numpy
    assert got == {("A", 0): 1, ("A", 1): 1, ("B", 0): 0, ("B", 1): 1}


def test_bands_and_zones(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 5.0, 19.9, 20.0, 65.0, 70.0, 100.0, 101.0, None]],
                               "mean_util double")
    got = {r.bin: (r.label, r.zone, r.n_units) for r in util_bands(df).collect()}
    assert got[0] == ("0-10", "low", 2)
    assert got[1] == ("10-20", "low", 1)
    assert got[2] == ("20-30", "mid", 1)
    assert got[6] == ("60-70", "unclassified", 1)
    assert got[7] == ("70-80", "high", 1)
    assert got[9] == ("90-100", "high", 1)     # 100 is in the last band
    assert got[3][2] == 0                      # empty band kept
    assert got[None] == ("Unknown", "unclassified", 2)


def test_wide_to_long_and_means(spark):
    wide = spark.createDataFrame([("t1", "10", "50", "x"), ("t2", "20", None, "30")],
                                 "Time string, `gpu-a` string, `gpu-b` string, `gpu-c` string")
    renamed, names = rename_wide(wide, "Time")
    assert renamed.columns == ["time", "col_1", "col_2", "col_3"]
    means = {r.unit: r.mean_util
             for r in unit_means(wide_to_long(renamed, names=names)).collect()}
    assert means == {"gpu-a": 15.0, "gpu-b": 50.0, "gpu-c": 30.0}


def test_wide_table_with_many_units(spark):
    n = 500
    wide = spark.range(30).selectExpr(
        "CAST(id AS STRING) AS Time",
        *[f"CAST((id * {i + 1}) % 101 AS STRING) AS `gpu {i}`" for i in range(n)])
    renamed, names = rename_wide(wide, "Time")
    means = {r.unit: r.mean_util for r in unit_means(wide_to_long(renamed, names=names)).collect()}
    assert len(means) == n
    for i in (0, 7, n - 1):
        want = round(sum((t * (i + 1)) % 101 for t in range(30)) / 30, 6)
        assert means[f"gpu {i}"] == pytest.approx(want)
