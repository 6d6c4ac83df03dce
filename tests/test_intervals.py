"""Conformal bands against sorted errors, and the upload manifest over repeated and killed runs."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.operators import inference as inf
from demandlake.sources import files


def errors(spark, rows):
    return spark.createDataFrame(rows, "family string, horizon_step int, y_true double, y_pred double, mase_scale double")


@pytest.mark.parametrize("n", [9, 10, 57, 400])
def test_widths_cover_at_least_the_asked_rank(spark, n):
    rng = np.random.default_rng(n)
    e = rng.exponential(10, (n, 2)).round(3)
    rows = [("a", h + 1, 100.0, float(100 + 2 * e[i, h] * (h + 1)), 2.0) for i in range(n) for h in range(2)]
    parts = [inf.error_sketches(errors(spark, rows[k::3])) for k in range(3)]
    kept = parts[0].unionByName(parts[1]).unionByName(parts[2])
    got = {r.horizon_step: r for r in inf.conformal_widths(kept).collect()}
    for h in (1, 2):
        values, rank = np.sort(e[:, h - 1] * h), math.ceil((n + 1) * 0.9)
        assert got[h].n == n
        if rank > n:
            assert got[h].width is None
            continue
        share = 0.9 + math.ceil((rank / n - 0.9) * 1000 - 1e-9) / 1000
        assert math.isclose(got[h].width, values[math.ceil(round(share * n, 7)) - 1], rel_tol=1e-9)
        assert got[h].width >= values[rank - 1] - 1e-9


def test_new_errors_of_the_same_kind_lie_inside(spark):
    rng = np.random.default_rng(0)
    e = rng.standard_t(3, 4000)
    rows = [("a", 1, 0.0, float(x), 1.0) for x in e[:2000]]
    width = inf.conformal_widths(inf.error_sketches(errors(spark, rows))).first().width
    assert abs(np.mean(np.abs(e[2000:]) <= width) - 0.9) < 0.03


def test_bands_widen_beyond_the_backtest(spark):
    rows = [("a", h, 0.0, float(h ** 0.5 * (1 + i / 1000)), 1.0) for h in (1, 2, 4) for i in range(50)]
    rows += [("b", 1, 0.0, 1.0, None), ("b", 1, None, 1.0, 1.0), ("c", 1, 5.0, 5.0, 1.0)]
    widths = inf.conformal_widths(inf.error_sketches(errors(spark, rows)))
    growth = {r.family: r.growth for r in widths.collect()}
    assert math.isclose(growth["a"], 0.5, rel_tol=1e-9) and growth["c"] == 0 and "b" not in growth
    fc = spark.createDataFrame([(f, h, 10.0, s) for f in "abc" for h in (1, 3, 4, 9) for s in (2.0, None)], "family string, horizon int, forecast double, mase_scale double")
    got = {(r.family, r.horizon): r for r in inf.add_conformal_intervals(fc, widths).filter("mase_scale IS NOT NULL").collect()}
    last = got["a", 4].forecast_upper - 10
    assert math.isclose(got["a", 9].forecast_upper - 10, last * 1.5, rel_tol=1e-9)
    assert math.isclose(got["a", 3].forecast_upper - 10, last * (3 / 4) ** 0.5, rel_tol=1e-9) and got["a", 1].interval_method == "conformal"
    assert got["b", 1].forecast_lower is None and got["c", 1].forecast_lower is None  # no errors, and too few
    none = inf.add_conformal_intervals(fc, widths).filter("mase_scale IS NULL AND forecast_lower IS NOT NULL")
    assert none.count() == 0 and inf.conformal_widths(inf.error_sketches(errors(spark, []))).count() == 0


def write(folder, name, text="a,b\n1,2\n"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


def test_each_upload_is_recorded_once(spark, tmp_path):
    inbox, manifest, checkpoint = (str(tmp_path / n) for n in ("in", "manifest", "checkpoint"))
    names = lambda: sorted(r.filename for r in spark.read.parquet(manifest).collect())
    write(inbox, "one.csv")
    write(inbox, "bad.exe")
    run = lambda: files.record_uploads(spark, inbox, "demand", manifest, checkpoint)
    run()
    run()
    assert names() == ["one.csv"]
    write(f"{inbox}/deeper", "two.csv")
    run()
    assert names() == ["one.csv", "two.csv"]
    # A run that was killed after its files were written, but before the batch was committed, is done again.
    write(inbox, "three.csv")
    run()
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    run()
    assert names() == ["one.csv", "three.csv", "two.csv"]
    assert {r.status for r in spark.read.parquet(manifest).select("status").distinct().collect()} == {"saved"}


def test_a_killed_batch_leaves_no_second_record(spark, tmp_path):
    inbox, manifest, checkpoint = (str(tmp_path / n) for n in ("in", "manifest", "checkpoint"))
    write(inbox, "one.csv")
    files.record_uploads(spark, inbox, "demand", manifest, checkpoint)
    # Files of a batch that never got into the manifest's log are not read.
    part = next(n for n in os.listdir(manifest) if n.startswith("part-"))
    with open(f"{manifest}/{part}", "rb") as a, open(f"{manifest}/part-99999-left-over.parquet", "wb") as b:
        b.write(a.read())
    assert spark.read.parquet(manifest).count() == 1
    assert spark.read.parquet(manifest).select(F.count(F.lit(1))).first()[0] == 1
