"""Sums of genes from arrays of all samples, and how rows are dealt: against loops, and by plan."""

from collections import defaultdict

import numpy as np
import pytest
from lociq.functions import special
from lociq.operators import aggregates, essentiality, genesets, interactions, joins, ordered, tests
from pyspark.sql import functions as F

IDS = ["s0", "s1", "s2"]


@pytest.fixture(scope="module")
def arrays(spark):
    rng = np.random.default_rng(3)
    rows = [("c1", p, [float(x) for x in rng.integers(0, 3, 3)], f"g{g}") for g in range(12) for p in range(g, g + 1 + g % 5)]
    df = spark.createDataFrame(rows, "contig string, position long, counts array<double>, orf string")
    genes = spark.createDataFrame([(f"g{g}",) for g in range(14)], "orf string")
    samples = spark.createDataFrame([("s0", "a", "A1"), ("s1", "b", "B1"), ("s2", "b", "B1")], "sample_id string, condition string, cell string")
    return rows, df, genes, samples


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_by_sample(arrays):
    rows, df, genes, samples = arrays
    want = defaultdict(list)
    for _, _, counts, orf in rows:
        for s, x in zip(IDS, counts):
            want[orf, s].append(x)
    sums = aggregates.sums_by_sample(df, IDS, {"reads": lambda x: x, "hits": lambda x: (x > 0).cast("long")}, genes)
    got = {(r.orf, r.sample_id): (r.n, r.reads, r.hits) for r in sums.collect()}
    assert len(got) == 14 * 3 and got["g13", "s2"] == (0, 0, 0)
    assert all(got[k] == (len(x), sum(x), sum(c > 0 for c in x)) for k, x in want.items())
    assert aggregates.sums_by_sample(df, [], {"reads": lambda x: x}).count() == 0


def test_a_gene_is_shuffled_once_for_all_samples(arrays):
    _, df, genes, samples = arrays
    sums = aggregates.sums_by_sample(df, IDS, {"reads": lambda x: x, "hits": lambda x: (x > 0).cast("long")})
    each = aggregates.sums_by_group(sums, samples, ["condition"])
    found = plan(aggregates.stats_of_sums(each))
    assert found.count("Exchange hashpartitioning") == 1 and "hashpartitioning(orf" in found
    by_rows = joins.with_metadata(joins.by_sample(df, IDS), samples.select("sample_id", "condition"))
    key = lambda r: (r.orf, r.condition)
    got, want = (sorted(x.select("orf", "condition", *[F.round(c, 9).alias(c) for c in ("mean", "nz_mean", "nz_perc")]).collect(), key=key) for x in (aggregates.stats_of_sums(each), aggregates.stats_for_gene(by_rows, ["condition"])))
    assert got == want


def test_anova_and_cells_of_sums_are_those_of_rows(arrays):
    _, df, genes, samples = arrays
    sums = aggregates.sums_by_group(aggregates.sums_by_sample(df, IDS, {"s": lambda x: x, "ss": lambda x: x * x}), samples, ["condition"])
    columns = ["orf", "n_sites", "status", *[F.round(c, 9).alias(c) for c in ("msr", "mse_alpha", "pval")]]
    rows = joins.by_sample(df, IDS)
    want = tests.anova(rows, samples, genes).select(*columns).collect()
    assert sorted(tests.anova_of_sums(sums, genes).select(*columns).collect()) == sorted(want)
    calls = {s.lower(): (lambda x, s=s: F.when(x == 0, s == "ES").otherwise(s == "GA").cast("long")) for s in essentiality.STATES}
    got = essentiality.hmm_calls(aggregates.sums_by_sample(df, IDS, calls, genes)).select("sample_id", "orf", "n", "call").collect()
    states = rows.withColumn("state", F.when(F.col("count") == 0, "ES").otherwise("GA"))
    assert sorted(got) == sorted(essentiality.hmm_genes(states, genes, samples.select("sample_id")).select("sample_id", "orf", "n", "call").collect())


def test_correlations_need_no_join(arrays):
    _, df, _, _ = arrays
    means = joins.by_sample(df, IDS).groupBy("orf", "sample_id").agg(F.avg("count").alias("mean"))
    found = aggregates.sample_correlation(means)
    assert "Join" not in plan(found)
    wide = {(r.orf, r.sample_id): r["mean"] for r in means.collect()}
    column = lambda s: [wide[f"g{g}", s] for g in range(12)]
    got = {(r.a, r.b): r.r for r in found.collect()}
    assert len(got) == 6 and all(np.isclose(r, np.corrcoef(column(a), column(b))[0, 1]) for (a, b), r in got.items())


def test_kernels_and_joins_keep_all_partitions(arrays):
    """Rows of few bytes that make much work are not joined into few tasks."""
    _, df, genes, samples = arrays
    cells = joins.by_sample(df, IDS).join(samples, "sample_id").groupBy("orf", "cell").agg(F.count("*").alias("n"), F.avg("count").alias("m"), F.var_pop("count").alias("v"), F.countDistinct("position").alias("sites"))
    assert "REPARTITION_BY_NUM" in plan(interactions.interactions_of_cells(cells, samples=10))
    located = genes.select(F.lit("c1").alias("contig"), "orf", F.lit(1).alias("start"), F.lit(20).alias("end"), F.lit("+").alias("strand"))
    assert "REPARTITION_BY_NUM" in plan(joins.assign_sites(df.drop("orf"), located))


def test_ranges_are_met_without_a_shuffle(spark):
    df = spark.createDataFrame([("a", i, float(i % 2)) for i in range(50)], "sample_id string, position long, count double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(ordered.placed(ordered.in_order(df, ["sample_id"], ["position"]), ["sample_id"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in found and "SortMergeJoin" not in found


def test_parent_unions(spark):
    members = [("p", "g1"), ("p", "g2"), ("q", "g2"), ("q", "g3"), ("q", "g3"), ("r", "g4"), ("p", None)]
    edges = [("x", "p"), ("x", "q"), ("y", "q"), ("y", "q"), ("z", "none")]
    found = genesets.parent_unions(spark.createDataFrame(members, "parent string, orf string"), spark.createDataFrame(edges, "child string, parent string"))
    assert sorted((r.child, r.n) for r in found.collect()) == [("x", 3), ("y", 2)]


def test_quantiles_take_one_tail_a_step(monkeypatch):
    seen, plain = [], special.norm_sf
    monkeypatch.setattr(special, "norm_sf", lambda x: seen.append(np.size(x)) or plain(x))
    p = np.linspace(1e-9, 1 - 1e-9, 101)
    x = special.norm_ppf(p)
    assert sum(seen) == 4 * 101
    assert np.allclose(np.where(p < 0.5, plain(-x), 1 - plain(x)), p, rtol=1e-9, atol=0)
