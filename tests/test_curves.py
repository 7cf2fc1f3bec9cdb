import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewsieve.operators import coverage, curves, frames, pool

LOG = "topic string, policy string, run int, round int, rank_in_round int, pmid long, label int"


def review(rng, n, seeds, k, policy, run, topic="T", labels=None):
    order = list(rng.permutation(n))
    rows = []
    for pos, pmid in enumerate(order):
        round_ = 0 if pos < seeds else (pos - seeds) // k + 1
        rank = pos + 1 if pos < seeds else (pos - seeds) % k + 1
        rows.append((topic, policy, run, round_, rank, int(pmid), int(labels[pmid])))
    return rows


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(5)
    labels = (rng.random(50) < 0.2).astype(int)
    labels[3] = 2
    rows = []
    for policy in ("a", "b"):
        for run, k in enumerate((5, 7, 9)):
            rows += review(rng, 50, 4, k, policy, run, labels=labels)
    x = rng.normal(size=(50, 3))
    x[:, 1] = 2.5
    judged = spark.createDataFrame(
        [("T", i, int(labels[i]), [float(v) for v in x[i]]) for i in range(50)],
        "topic string, pmid long, label int, features array<double>",
    )
    return spark.createDataFrame(rows, LOG), judged, rows, labels, x


def runs_of(rows):
    runs = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[4])):
        runs.setdefault((r[1], r[2]), []).append(r)
    return runs


def state_before(run, included, count_seeds=False):
    """Per round: effort and recall in percent before the round's own reveal."""
    points = []
    for step in range(1, run[-1][3] + 1):
        seen = [r for r in run if r[3] < step]
        hits = sum(r[6] == 1 for r in seen if count_seeds or r[3] > 0)
        points.append((100 * len(seen) / 50, 100 * hits / included))
    return points


def test_recall_curve_is_the_state_before_each_round(study):
    log, judged, rows, labels, _ = study
    got = {}
    for r in curves.recall_curve(log, judged).orderBy("round").collect():
        got.setdefault((r.policy, r.run), []).append((r.effort_pct, r.recall_pct))
    included = int((labels == 1).sum())
    for key, run in runs_of(rows).items():
        assert got[key] == [pytest.approx(p) for p in state_before(run, included)]
        assert got[key][0] == (8.0, 0.0)


def test_final_point_with_seeds_ends_at_all(study):
    log, judged, *_ = study
    curve = curves.recall_curve(log, judged, count_seeds=True, include_final=True)
    ends = curve.groupBy(*pool.RUN).agg(F.max_by("effort_pct", "round").alias("e"), F.max_by("recall_pct", "round").alias("r"))
    assert {(round(r.e, 6), round(r.r, 6)) for r in ends.collect()} == {(100.0, 100.0)}
    drops = curves.with_previous(curve, pool.RUN, "round", ["recall_pct"]).where("recall_pct < prev_recall_pct")
    assert drops.count() == 0


def test_topic_without_included_articles(study):
    log, judged, *_ = study
    none = judged.withColumn("label", F.lit(0))
    curve = curves.recall_curve(log.withColumn("label", F.lit(0)), none)
    assert curve.where("recall_pct is not null").count() == 0
    assert curves.curve_auc(curve, "recall_pct").where("auc is not null").count() == 0
    state = pool.run_state(log.withColumn("label", F.lit(0)), none).collect()
    assert all(s.recall is None for s in state)


def test_areas_and_summary(study):
    log, judged, rows, labels, _ = study
    curve = curves.recall_curve(log, judged)
    got = {(r.policy, r.run): r.auc for r in curves.curve_auc(curve, "recall_pct").collect()}
    included = int((labels == 1).sum())
    for key, run in runs_of(rows).items():
        points = np.array(state_before(run, included))
        want = np.sum(np.diff(points[:, 0]) * (points[1:, 1] + points[:-1, 1]) / 2)
        assert got[key] == pytest.approx(want)
    areas = curves.curve_auc(curve, "recall_pct", name="auc_recall").withColumn("auc_coverage", F.lit(1.0))
    for r in curves.policy_summary(areas).collect():
        mean = np.mean([v for (p, _), v in got.items() if p == r.policy])
        assert r.auc_recall == pytest.approx(mean) and r.runs == 3
        assert r.line == f"{r.policy:20} | {mean:13.2f} | {1.0:25.2f}"


@pytest.mark.parametrize("chunk", [4096, 3])
def test_grid_equals_interpolation(study, chunk, monkeypatch):
    monkeypatch.setattr(curves, "GRID_CHUNK", chunk)
    log, judged, rows, labels, _ = study
    got = {}
    for r in curves.curve_grid(curves.recall_curve(log, judged), "recall_pct").orderBy("grid").collect():
        got.setdefault((r.policy, r.run), []).append(r.recall_pct)
    included = int((labels == 1).sum())
    points = {k: np.array(state_before(run, included)) for k, run in runs_of(rows).items()}
    size = max(len(p) for p in points.values())
    for key, p in points.items():
        want = np.interp(np.linspace(0, 100, size), p[:, 0], p[:, 1])
        assert got[key] == pytest.approx(list(want))


def test_band_across_runs(spark):
    rows = [("T", "a", run, 0, 0.0, v) for run, v in enumerate((1.0, 2.0, 4.0))] + [("T", "b", 0, 0, 0.0, 3.0)]
    grid = spark.createDataFrame(rows, "topic string, policy string, run int, grid int, grid_x double, y double")
    got = {r.policy: r for r in curves.curve_band(grid, "y").collect()}
    sem = np.std([1, 2, 4], ddof=1) / np.sqrt(3)
    assert got["a"].low == pytest.approx(7 / 3 - 4.30265272975 * sem)
    assert got["a"].high == pytest.approx(7 / 3 + 4.30265272975 * sem)
    assert got["b"].mean == 3.0 and got["b"].low is None


def test_t_points_beyond_the_table(spark):
    df = spark.createDataFrame([(1,), (30,), (31,), (100,)], "df long")
    got = [r[0] for r in df.orderBy("df").select(curves.t_975(F.col("df"))).collect()]
    assert got == pytest.approx([12.7062047, 2.0422725, 2.0395134, 1.9839715], abs=3e-6)


@pytest.mark.parametrize("prefix", ["index", "round"])
@pytest.mark.parametrize("block", [1024, 4])
def test_coverage_equals_its_definition(study, prefix, block):
    log, judged, rows, _, x = study
    got = {}
    for r in coverage.coverage_curve(log, judged, prefix, block).orderBy("round").collect():
        got.setdefault((r.policy, r.run), []).append(r.coverage_pct)
    whole = x.var(axis=0)
    whole[1] = 1e-10
    for key, run in runs_of(rows).items():
        want = []
        for step in range(1, run[-1][3] + 1):
            n = step if prefix == "index" else sum(r[3] < step for r in run)
            part = x[[r[5] for r in run][:n]].var(axis=0)
            part[part < 1e-30] = 1e-10
            want.append(min(100 * np.mean(part / whole), 100))
        assert got[key] == pytest.approx(want)


def test_coverage_without_seeds_starts_at_zero(study):
    log, judged, *_ = study
    bare = log.where("round > 0")
    curve = coverage.coverage_curve(bare, judged, "round")
    assert {r.coverage_pct for r in curve.where("round = 1").collect()} == {0.0}


def test_frames(study, spark):
    log, judged, rows, *_ = study
    xy = judged.select("topic", "pmid", F.col("features")[0].alias("x"), F.col("features")[2].alias("y"))
    points = frames.frame_points(xy, log.where("round <= 3"))
    assert points.count() == log.where("round <= 3").count()
    sizes = {(r.policy, r.run, r.round): r.labelled for r in frames.frame_sizes(log).collect()}
    for (policy, run), own in runs_of(rows).items():
        mine = points.where((F.col("policy") == policy) & (F.col("run") == run))
        assert frames.frame(mine, 2).count() == sum(r[3] <= 2 for r in own) == sizes[policy, run, 2]
