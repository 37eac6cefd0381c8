"""Order, runs, ranks and corrections over many ranges of few rows, against loops."""

import math
from collections import defaultdict

import numpy as np
import pytest
from lociq.operators import essentiality, ordered, windows
from pyspark.sql import functions as F


@pytest.fixture
def ranges(spark):
    """Every range stays a partition of its own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def track(spark, seed=1, n=200):
    rng = np.random.default_rng(seed)
    rows = []
    for s, p in (("a", 0.3), ("b", 0.0), ("hot", 0.1), (None, 1.0)):
        rows += [(s, int(7 * i), float((rng.random() < p) * rng.integers(1, 9))) for i in rng.permutation(n if s != "hot" else 4 * n)]
    return rows, spark.createDataFrame(rows, "sample_id string, position long, count double").repartition(5)


def by_sample(rows):
    out = defaultdict(list)
    for s, p, c in rows:
        out[s].append((p, c))
    return {s: sorted(v) for s, v in out.items()}


def test_places_and_sums(ranges):
    rows, df = track(ranges)
    laid = ordered.in_order(df, ["sample_id"], ["position"])
    assert laid.select("_range").distinct().count() > 3
    got = ordered.tidy(ordered.running(ordered.placed(laid, ["sample_id"]), ["sample_id"], {"upto": F.col("count")})).collect()
    for s, own in by_sample(rows).items():
        mine = sorted((r for r in got if r.sample_id == s), key=lambda r: r.position)
        assert [r["_n"] for r in mine] == list(range(1, len(own) + 1)) and np.allclose([r.upto for r in mine], np.cumsum([c for _, c in own]))


def plain_runs(own):
    found, hits, run = [], 0, None
    for i, (p, c) in enumerate(own, 1):
        if c:
            hits, run = hits + 1, None
        elif run is None:
            run = [hits, 1, i, i, p, p]
            found.append(run)
        else:
            run[1], run[3], run[5] = run[1] + 1, i, p
    return sorted(map(tuple, found))


def test_runs_over_range_edges(ranges):
    rows, df = track(ranges)
    got = windows.runs(df, ["sample_id"]).collect()
    states = windows.state_runs(df, ["sample_id"]).collect()
    for s, own in by_sample(rows).items():
        runs = plain_runs(own)
        assert sorted((r.run_id, r.length, r.start_idx, r.end_idx, r.start_pos, r.end_pos) for r in got if r.sample_id == s) == runs
        low = plain_runs([(p, float(c >= 2)) for p, c in own])
        long_ones = {p for r in low if r[1] >= 6 for p, _ in own[r[2] - 1 : r[3]]}
        assert {r.position for r in states if r.sample_id == s and r.state == "ES"} == long_ones and sum(r.sample_id == s for r in states) == len(own)


def test_neighbours_over_block_edges(ranges):
    rows, df = track(ranges, n=60)
    df = df.withColumn("state", F.when(F.col("count") > 3, "NE").otherwise("ES"))
    got = windows.local_average(df, ["sample_id"], width=3, block=7).collect()
    for s, own in by_sample(rows).items():
        mine = {r.position: r for r in got if r.sample_id == s}
        assert len(mine) == len(own) == sum(r.sample_id == s for r in got)
        for i, (p, c) in enumerate(own):
            near = [x for j, (_, x) in enumerate(own) if 0 < abs(j - i) <= 3 and (x > 3) == (c > 3)]
            assert math.isclose(mine[p].local_mean, sum(near) / len(near) if near else -1)


def plain_bh(p):
    known = sorted(x for x in p if x is not None and x == x)
    raw = [x * len(known) / (sum(y <= x for y in known)) for x in known]
    return {x: min(1, min(r for y, r in zip(known, raw) if y >= x)) for x in known}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_bh_with_ties_over_ranges(ranges, keys):
    rng = np.random.default_rng(4)
    rows = [(None if i % 11 == 0 else "x" if i % 3 else "y", i, None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(rng.choice([0.01, 0.2, 1.0, rng.random() ** 3]))) for i in range(400)]
    got = windows.bh_fdr(ranges.createDataFrame(rows, "k string, i int, pval double").repartition(3), keys=keys).collect()
    assert len(got) == len(rows)
    for k in {r[0] for r in rows} if keys else {"all"}:
        want = plain_bh([r[2] for r in rows if not keys or r[0] == k])
        for r in got:
            if not keys or r.k == k:
                assert r.padj is None if r.pval is None or r.pval != r.pval else math.isclose(r.padj, want[r.pval])


def test_ranks_means_and_thresholds_over_ranges(ranges):
    rng = np.random.default_rng(5)
    rows = [(f"g{i:03}", float(rng.choice([0.0, 0.5, 1.0, rng.random()]))) for i in range(300)]
    df = ranges.createDataFrame(rows, "orf string, z double").repartition(3)
    up = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r.orf: r for r in windows.fwer_bayes(windows.bfdr(df, "z"), "z").collect()}
    for j, (orf, _) in enumerate(up, 1):
        below = [z for _, z in up[:j]]
        assert math.isclose(got[orf].bfdr, np.mean(below), abs_tol=1e-12) and math.isclose(got[orf].fwer, 1 - math.exp(sum(math.log1p(-min(z, 1 - 1e-12)) for z in below)), abs_tol=1e-9)
    ranked = {r.orf: r["rank"] for r in windows.rank_scores(df.withColumn("lfc", F.col("z")), "LFC", seed=None).collect()}
    assert [ranked[o] for o, _ in sorted(rows, key=lambda r: (-r[1], r[0]))] == list(range(1, 301))
    z, n = [x for _, x in up], len(up)
    down = z[::-1]
    high = next((down[i - 1] for i in range(3, n + 1) if (1 - down[i - 1]) - np.mean([1 - x for x in down[: i - 2]]) > 0.05 * i / n), 1.0)
    low = next((z[j - 1] for j in range(2, n + 1) if z[j - 1] - np.mean(z[: j - 1]) > 0.05 * j / n), 0.0)
    cut = windows.essentiality_thresholds(df, "z").first()
    assert math.isclose(cut.lower, low) and math.isclose(cut.upper, high)


def test_hmm_does_not_depend_on_ranges(ranges):
    rng = np.random.default_rng(6)
    rows = [(c, k, 5 * i, float((rng.random() < 0.4) * rng.geometric(0.05))) for c in ("N", "A") for k in ("c1", "c2") for i in range(150)]
    df = ranges.createDataFrame(rows, "condition string, contig string, position long, count double").repartition(4)
    many = essentiality.hmm(df, 16).orderBy("condition", "contig", "position").toPandas()
    ranges.conf.set("spark.sql.shuffle.partitions", "1")
    one = essentiality.hmm(df, 10_000).orderBy("condition", "contig", "position").toPandas()
    assert len(many) == 600 and (many.state == one.state).all() and np.allclose(many[["es", "gd", "ne", "ga"]], one[["es", "gd", "ne", "ga"]])
