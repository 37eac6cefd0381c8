"""Registered queries of the engine's operators over the derived tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators import aggregates as agg
from lociq.operators import filters, joins, normalise, windows
from lociq.plans import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, and the SQL that must give the same rows over the shared table expressions."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = f"WITH RECURSIVE {t.CTE} {sql}" if not sql.lstrip().startswith(",") else f"WITH RECURSIVE {t.CTE.rstrip()}{sql}"
        return f

    return add


def r6(*columns: str):
    """The columns rounded to six decimals, as the SQL rounds them; no negative zero."""
    return [(F.round(c, 6) + F.lit(0.0)).alias(c) for c in columns]


def _assigned(spark: SparkSession, sf_dir: str, variant: str) -> tuple[DataFrame, list[str]]:
    table, ids = t.site_table(spark, sf_dir)
    assigned = joins.assign_sites(table, t.genes(spark, sf_dir).select("contig", "orf", "start", "end", "strand"), variant=variant)
    return assigned.select("contig", "position", "counts", "orf"), ids


def gene_sums(spark: SparkSession, sf_dir: str, variant: str = "A", genes: DataFrame | None = None, **sums) -> DataFrame:
    """(orf, sample_id, n, reads, and what else is named) of each gene and sample."""
    return agg.sums_by_sample(*_assigned(spark, sf_dir, variant), {"reads": lambda x: x, **sums}, genes)


def gene_means(spark: SparkSession, sf_dir: str, variant: str = "A") -> DataFrame:
    return gene_sums(spark, sf_dir, variant).select("orf", "sample_id", (F.col("reads") / F.col("n")).alias("mean"))


def site_gene(spark: SparkSession, sf_dir: str, variant: str = "A", whole_genes: bool = False) -> DataFrame:
    """Sites meet genes once for all samples, which become rows after that. What needs only sums of a gene takes gene_sums().

    whole_genes: for windows over genes, rows are dealt by gene while they still hold all samples, and not shuffled as rows a sample.
    """
    assigned, ids = _assigned(spark, sf_dir, variant)
    return joins.by_sample(assigned.repartition("orf") if whole_genes else assigned, ids).select("sample_id", "contig", "position", "count", "orf")


def _changed(spark: SparkSession, sf_dir: str, change: Callable, name: str = "count") -> DataFrame:
    """(orf, sample_id, position, name) of counts changed where a gene's sites lie; samples become rows after that."""
    table, ids = t.site_table(spark, sf_dir)
    return joins.by_sample(joins.changed_over_genes(table, t.genes(spark, sf_dir), change, len(ids)), ids).select("orf", "sample_id", "position", F.col("count").alias(name))


def tosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.tosses_of_sites(t.site_table(spark, sf_dir)[0], t.genes(spark, sf_dir))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, ids = t.site_table(spark, sf_dir)
    return agg.block_stats_of_sites(table, t.genes(spark, sf_dir), len(ids))


# Filters and projections


@query("SELECT sample_id, count(*) AS n, sum(count) AS reads FROM site_counts WHERE sample_id IN (SELECT sample_id FROM samples WHERE condition IN ('A', 'N')) GROUP BY 1")
def f1_with_only(spark, d):
    return filters.with_only(t.site_counts(spark, d), t.samples(spark, d), conditions=["A", "N"]).groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("count").alias("reads"))


@query("SELECT sample_id, condition FROM samples WHERE condition NOT IN ('R')")
def f2_filter_by_conditions(spark, d):
    return filters.filter_by_conditions(t.samples(spark, d), exclude=["R"]).select("sample_id", "condition")


@query("SELECT sample_id, status AS condition, replicate FROM samples WHERE condition IN ('A', 'N')")
def f3_regroup_conditions(spark, d):
    return filters.regroup_conditions(t.samples(spark, d), "status", include=["A", "N"], covars=["replicate"])


@query("SELECT condition, cast(row_number() OVER (ORDER BY min(condition_order)) AS int) AS rank FROM samples WHERE condition <> 'A' GROUP BY condition")
def f4_select_conditions(spark, d):
    return filters.select_conditions(t.samples(spark, d), exclude=["A"])


@query("SELECT DISTINCT sample_id FROM samples WHERE condition = 'N' AND replicate = '1'")
def f5_lookup(spark, d):
    return filters.lookup(t.samples(spark, d), "sample_id", condition="N", replicate="1")


@query("SELECT sample_id, position, CASE WHEN count < 20 THEN 0 ELSE count END AS count FROM site_counts")
def f6_min_read_filter(spark, d):
    return filters.min_read_filter(t.site_counts(spark, d), 20).select("sample_id", "position", "count")


@query("""SELECT sample_id, orf, position, count FROM (SELECT s.*, g.orf FROM site_counts s JOIN genes g ON s.position BETWEEN g.start AND g."end"
 AND (CASE WHEN strand = '+' THEN s.position <= g."end" - 3 ELSE s.position >= g.start + 3 END) AND (s.position - g.start) / (g."end" - g.start) BETWEEN 0.05 AND 0.9)""")
def f7_terminus_trim(spark, d):
    return joins.assign_sites(t.site_counts(spark, d), t.genes(spark, d).drop("name", "description"), 5, 10).select("sample_id", "orf", "position", "count")


@query(""", r AS (SELECT *, dense_rank() OVER (PARTITION BY orf, sample_id ORDER BY count DESC) AS k FROM site_gene_a), s AS (SELECT *, max(CASE WHEN k = 2 THEN count END) OVER (PARTITION BY orf, sample_id) AS second FROM r)
 SELECT orf, sample_id, position, CASE WHEN k = 1 AND second IS NOT NULL THEN second ELSE count END AS count FROM s""")
def f8_winsorize(spark, d):
    return _changed(spark, d, filters.winsorized)


@query(""", r AS (SELECT *, row_number() OVER (PARTITION BY orf, sample_id ORDER BY count DESC) AS k, max(count) OVER (PARTITION BY orf, sample_id) AS m, count(*) OVER (PARTITION BY orf, sample_id) AS n FROM site_gene_a),
 s AS (SELECT *, max(CASE WHEN k = 2 THEN count END) OVER (PARTITION BY orf, sample_id) AS second FROM r) SELECT orf, sample_id, position, CASE WHEN n >= 3 AND second <> 0 AND count = m THEN second ELSE count END AS count FROM s""")
def f9_winsorize_resampling(spark, d):
    return _changed(spark, d, filters.winsorized_resampling)


@query("SELECT a.condition, b.status, count(s.sample_id) AS n_samples FROM (SELECT DISTINCT condition FROM samples) a CROSS JOIN (SELECT DISTINCT status FROM samples) b LEFT JOIN samples s ON s.condition = a.condition AND s.status = b.status GROUP BY 1, 2")
def f10_cross_product_counts(spark, d):
    return filters.cross_product_counts(t.samples(spark, d), ["condition", "status"])


def _runs(spark, d):
    return windows.runs(t.site_counts(spark, d), ["sample_id", "contig"])


RUNS_SQL = """, idx AS (SELECT sample_id, contig, position, count, row_number() OVER w AS i, sum(CASE WHEN count = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id, contig ORDER BY position ROWS UNBOUNDED PRECEDING) AS run_id
  FROM site_counts WINDOW w AS (PARTITION BY sample_id, contig ORDER BY position)),
 runs AS (SELECT sample_id, contig, run_id, count(*) AS length, min(i) AS start_idx, max(i) AS end_idx, min(position) AS start_pos, max(position) AS end_pos FROM idx WHERE count = 0 GROUP BY 1, 2, 3) """


@query(RUNS_SQL + "SELECT sample_id, count(*) AS n FROM site_counts s WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.sample_id = s.sample_id AND r.length >= 5 AND s.position BETWEEN r.start_pos AND r.end_pos) GROUP BY 1")
def f11_remove_empty_regions(spark, d):
    return filters.remove_empty_regions(t.site_counts(spark, d), 5).groupBy("sample_id").agg(F.count("*").alias("n"))


@query("SELECT sample_id, bool_or(count = 0) AS has_zero_sites, CASE WHEN bool_or(position = p + 1) THEN 'tn5' ELSE 'himar1' END AS transposon FROM (SELECT *, lag(position) OVER (PARTITION BY sample_id ORDER BY position) AS p FROM site_counts) GROUP BY 1")
def f14_transposon_type(spark, d):
    return filters.transposon_type(t.site_counts(spark, d))


# Joins


@query("SELECT sample_id, orf, count(*) AS n, sum(count) AS reads FROM site_gene_a GROUP BY 1, 2")
def j1_assign_sites(spark, d):
    return gene_sums(spark, d).select("sample_id", "orf", "n", "reads")


@query("SELECT sample_id, orf, count(*) AS n, sum(count) AS reads FROM site_gene_b GROUP BY 1, 2")
def j2_assign_sites_rv(spark, d):
    return gene_sums(spark, d, "B").select("sample_id", "orf", "n", "reads")


@query("SELECT coalesce(m.condition, 'FLAG-UNMAPPED-CONDITION-IN-WIG') AS condition, sum(s.count) AS reads FROM site_counts s LEFT JOIN (SELECT * FROM samples WHERE condition <> 'R') m ON m.sample_id = s.sample_id GROUP BY 1")
def j3_attach_conditions(spark, d):
    return joins.attach_conditions(t.site_counts(spark, d), t.samples(spark, d).filter("condition <> 'R'")).groupBy("condition").agg(F.sum("count").alias("reads"))


@query(RUNS_SQL + """SELECT r.sample_id, r.run_id, count(DISTINCT g.orf) AS n_genes, min(g.orf) AS first_orf FROM runs r JOIN genes g ON r.start_pos <= g."end" AND g.start <= r.end_pos GROUP BY 1, 2""")
def j4_genes_in_ranges(spark, d):
    """Runs of every sample and length."""
    found = joins.genes_in_ranges(_runs(spark, d), t.genes(spark, d), keys=("sample_id", "run_id"))
    return found.select("sample_id", "run_id", F.size("orfs").cast("long").alias("n_genes"), F.get("orfs", F.lit(0)).alias("first_orf"))


@query(RUNS_SQL + """SELECT r.sample_id, r.run_id, g.orf, greatest(least(r.end_pos, g."end") - greatest(r.start_pos, g.start), 0) AS overlap,
 round(CASE WHEN (g.start >= r.start_pos AND g."end" <= r.end_pos) OR (r.start_pos >= g.start AND r.end_pos <= g."end") THEN 1.0 ELSE greatest(least(r.end_pos, g."end") - greatest(r.start_pos, g.start), 0) / (g."end" - g.start) END, 6) + 0 AS overlap_fraction
 FROM runs r JOIN genes g ON r.start_pos <= g."end" AND g.start <= r.end_pos""")
def j5_overlap(spark, d):
    """Runs of every sample and length."""
    found = joins.overlap_columns(joins.overlaps(_runs(spark, d), t.genes(spark, d)))
    return found.select("sample_id", "run_id", "orf", "overlap", *r6("overlap_fraction"))


@query(", m AS (SELECT orf, sample_id, avg(count) AS mean FROM site_gene_a GROUP BY 1, 2) SELECT a.orf, round(a.mean, 6) + 0 AS ctrl, round(b.mean, 6) + 0 AS exp FROM m a JOIN m b ON a.orf = b.orf WHERE a.sample_id = 'NO_0' AND b.sample_id = 'AF_0'")
def j6_join_strains(spark, d):
    means = gene_means(spark, d)
    ctrl, exp = (means.filter(F.col("sample_id") == s).select("orf", F.col("mean").alias(n)) for s, n in (("NO_0", "ctrl"), ("AF_0", "exp")))
    return joins.join_strains(ctrl, exp, different_strains=True).select("orf", *r6("ctrl", "exp"))


@query("SELECT sample_id, CASE WHEN position % 10 = 0 THEN -1 ELSE position + 5 END AS position, count FROM raw_counts WHERE position % 10 <> 0")
def j7_lift_positions(spark, d):
    coord = t.grid(spark, d).select(F.col("position").alias("pos_a"), F.when(F.col("position") % 10 == 0, -1).otherwise(F.col("position") + 5).alias("pos_b"))
    return joins.lift_positions(t.raw_counts(spark, d), coord).select("sample_id", "position", "count")


@query("SELECT sample_id, count(*) AS n, sum(count) AS reads, sum(CASE WHEN count = 0 THEN 1 ELSE 0 END) AS zeros FROM site_counts GROUP BY 1")
def j8_zero_fill(spark, d):
    return t.site_counts(spark, d).groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("count").alias("reads"), F.sum((F.col("count") == 0).cast("long")).alias("zeros"))


@query("SELECT r.sample_id, count(*) AS n FROM raw_counts r WHERE position % 3 <> 0 GROUP BY 1")
def j8_off_grid(spark, d):
    return joins.off_grid(t.grid(spark, d).filter("position % 3 = 0"), t.raw_counts(spark, d)).groupBy("sample_id").agg(F.count("*").alias("n"))


@query("""SELECT a.term, n.name, count(*) AS n_genes, min(a.orf) AS first_gene FROM associations a JOIN (SELECT DISTINCT orf FROM site_gene_a WHERE count > 45) h ON h.orf = a.orf LEFT JOIN terms n ON n.term = a.term GROUP BY 1, 2""")
def j9_term_members(spark, d):
    hits = site_gene(spark, d).filter("count > 45").select("orf").distinct()
    found = joins.term_members(hits, t.associations(spark, d), t.terms(spark, d))
    return found.select("term", "name", "n_genes", F.get("genes", F.lit(0)).alias("first_gene"))


@query("""SELECT g.sgrna, g.orf, round(g.efficacy, 6) + 0 AS efficacy, c.count, coalesce(u.uninduced, 1.0) AS uninduced FROM guides g LEFT JOIN (SELECT sgrna, sum(count) AS count FROM abundances WHERE dose > 0 GROUP BY 1) c ON c.sgrna = g.sgrna
 LEFT JOIN (SELECT sgrna, sum(count)::double AS uninduced FROM abundances WHERE dose = 0 GROUP BY 1) u ON u.sgrna = g.sgrna""")
def j10_join_guides(spark, d):
    a = t.abundances(spark, d)
    counts = a.filter("dose > 0").groupBy("sgrna").agg(F.sum("count").alias("count"))
    uninduced = a.filter("dose = 0").groupBy("sgrna").agg(F.sum("count").cast("double").alias("uninduced"))
    return joins.join_guides(t.guides(spark, d), counts, uninduced).select("sgrna", "orf", *r6("efficacy"), "count", "uninduced")


@query("SELECT g.orf, CASE WHEN c.orf IS NULL THEN 'U' ELSE 'E' END AS call FROM genes g LEFT JOIN (SELECT DISTINCT orf FROM site_gene_a WHERE count > 45) c ON c.orf = g.orf")
def j11_attach_calls(spark, d):
    calls = site_gene(spark, d).filter("count > 45").select("orf", F.lit("E").alias("call")).distinct()
    return joins.attach_calls(t.genes(spark, d), calls).select("orf", "call")


# Aggregations


STATS_SQL = """SELECT sample_id, round(avg((count > 0)::int), 6) + 0 AS density, round(avg(count), 6) + 0 AS mean_count, round(avg(count) FILTER (count > 0), 6) + 0 AS nz_mean, round(quantile_cont(count, 0.5) FILTER (count > 0), 6) + 0 AS nz_median, max(count) AS max_count, sum(count) AS total_counts,
 round(avg(power(count - m, 3)) FILTER (count > 0) / power(avg(power(count - m, 2)) FILTER (count > 0), 1.5), 6) + 0 AS skewness, round(avg(power(count - m, 4)) FILTER (count > 0) / power(avg(power(count - m, 2)) FILTER (count > 0), 2) - 3, 6) + 0 AS kurtosis
 FROM (SELECT *, avg(CASE WHEN count > 0 THEN count END) OVER (PARTITION BY sample_id) AS m FROM site_counts) GROUP BY 1"""


@query(STATS_SQL)
def a1_track_stats(spark, d):
    return agg.track_stats(t.site_counts(spark, d)).select("sample_id", *r6("density", "mean_count", "nz_mean", "nz_median"), "max_count", "total_counts", *r6("skewness", "kurtosis"))


TAIL_SQL = """, x AS (SELECT sample_id, list(count ORDER BY count DESC) AS x FROM site_counts GROUP BY 1),
 v AS (SELECT sample_id, log2((x[m+1] - x[2*m+1]) / nullif(x[2*m+1] - x[4*m+1], 0)) AS v FROM (SELECT sample_id, x, unnest(range(10, 100)) AS m FROM x) WHERE x[m+1] > x[2*m+1])"""


@query(TAIL_SQL + """
 SELECT s.sample_id, round(quantile_cont(v, 0.5), 6) + 0 AS tail_index FROM samples s LEFT JOIN v ON v.sample_id = s.sample_id GROUP BY 1""")
def a2_pickands_tail_index(spark, d):
    return agg.pickands_tail_index(t.site_counts(spark, d)).select("sample_id", *r6("tail_index"))


@query(f"{TAIL_SQL} SELECT * FROM ({STATS_SQL}) JOIN (SELECT s.sample_id, round(quantile_cont(v, 0.5), 6) + 0 AS tail_index FROM samples s LEFT JOIN v ON v.sample_id = s.sample_id GROUP BY 1) USING (sample_id)")
def a3_dataset_report(spark, d):
    return agg.dataset_report(t.site_counts(spark, d)).select("sample_id", *r6("density", "mean_count", "nz_mean", "nz_median"), "max_count", "total_counts", *r6("skewness", "kurtosis", "tail_index"))


BLOCKS_SQL = """, toss AS (SELECT orf, position, sum(count) AS total, (sum(count) > 0)::int AS hit FROM site_gene_a GROUP BY 1, 2),
 isl AS (SELECT *, sum(hit) OVER (PARTITION BY orf ORDER BY position ROWS UNBOUNDED PRECEDING) AS island FROM toss),
 rr AS (SELECT orf, island, count(*) AS length, max(position) - min(position) + 2 AS span FROM isl WHERE hit = 0 GROUP BY 1, 2),
 best AS (SELECT orf, length AS max_run, span AS gap_span FROM (SELECT *, row_number() OVER (PARTITION BY orf ORDER BY length DESC, island DESC) AS k FROM rr) WHERE k = 1),
 st AS (SELECT orf, count(*) AS n, sum(hit) AS k, max(position) - min(position) + 2 AS span FROM toss GROUP BY 1),
 ct AS (SELECT orf, sum(count) AS reads, avg(count) AS mean, avg(count) FILTER (count > 0) AS nz_mean FROM site_gene_a GROUP BY 1),
 blocks AS (SELECT g.orf, coalesce(n, 0) AS n, coalesce(k, 0)::bigint AS k, coalesce(reads, 0) AS reads, coalesce(span, 0) AS span, coalesce(mean, 0) AS mean, coalesce(nz_mean, 0) AS nz_mean, coalesce(max_run, 0) AS max_run, coalesce(gap_span, 0) AS gap_span,
   CASE WHEN coalesce(n, 0) > 0 THEN k / n ELSE 0 END AS theta FROM genes g LEFT JOIN st ON st.orf = g.orf LEFT JOIN ct ON ct.orf = g.orf LEFT JOIN best ON best.orf = g.orf) """


@query(BLOCKS_SQL + "SELECT orf, n, k, reads, span, round(mean, 6) + 0 AS mean, round(nz_mean, 6) + 0 AS nz_mean, round(theta, 6) + 0 AS theta, round(1 - theta, 6) + 0 AS phi FROM blocks")
def a4_gene_block_stats(spark, d):
    return blocks(spark, d).select("orf", "n", "k", "reads", "span", *r6("mean", "nz_mean", "theta", "phi"))


@query(BLOCKS_SQL + "SELECT orf, position, total, hit FROM toss")
def a5_tosses(spark, d):
    return tosses(spark, d).select("orf", "position", "total", "hit")


@query(BLOCKS_SQL + "SELECT orf, max_run, gap_span FROM best")
def a6_max_runs(spark, d):
    return blocks(spark, d).filter("max_run > 0").select("orf", "max_run", "gap_span")


@query(BLOCKS_SQL + "SELECT sum(k)::bigint AS insertions, sum(n)::bigint AS sites, max(max_run) AS max_run, sum(reads) AS reads, round(sum(k) / sum(n), 6) + 0 AS theta FROM blocks")
def a7_genome_stats(spark, d):
    return agg.genome_stats(blocks(spark, d)).select("insertions", "sites", "max_run", "reads", *r6("theta"))


def _conditioned(spark, d):
    return joins.attach_conditions(t.site_counts(spark, d), t.samples(spark, d))


@query("SELECT condition, position, round_even(avg(count), 0) AS count FROM site_counts JOIN samples USING (sample_id) GROUP BY 1, 2")
def a8_combine_replicates(spark, d):
    return agg.combine_replicates(_conditioned(spark, d), "Mean")


@query("SELECT condition, position, sum(count) AS count FROM site_counts JOIN samples USING (sample_id) GROUP BY 1, 2")
def a9_summed_by_condition(spark, d):
    return agg.summed_by_condition(_conditioned(spark, d))


@query("SELECT orf, condition, round(sum(count) / count(*), 6) + 0 AS mean_count FROM site_gene_a JOIN samples USING (sample_id) GROUP BY 1, 2")
def a10_averaged(spark, d):
    sums = agg.sums_by_group(gene_sums(spark, d), t.samples(spark, d), ["condition"])
    return sums.withColumn("mean_count", F.col("reads") / F.col("n")).select("orf", "condition", *r6("mean_count"))


@query("SELECT orf, condition, round(avg(mean), 6) + 0 AS mean FROM (SELECT orf, sample_id, avg(count) AS mean FROM site_gene_a GROUP BY 1, 2) JOIN samples USING (sample_id) GROUP BY 1, 2")
def a11_gene_means(spark, d):
    means = joins.with_metadata(gene_means(spark, d), t.samples(spark, d).select("sample_id", "condition"))
    return means.groupBy("orf", "condition").agg(F.avg("mean").alias("mean")).select("orf", "condition", *r6("mean"))


@query("SELECT orf, condition, status, round(avg(count), 6) + 0 AS mean, round(coalesce(avg(count) FILTER (count > 0), 0), 6) + 0 AS nz_mean, round(avg((count > 0)::int), 6) + 0 AS nz_perc FROM site_gene_b JOIN samples USING (sample_id) GROUP BY 1, 2, 3")
def a12_stats_for_gene(spark, d):
    sums = gene_sums(spark, d, "B", hits=lambda x: (x > 0).cast("long"))  # counts are not below 0, so their sum is that of the hits
    return agg.stats_of_sums(agg.sums_by_group(sums, t.samples(spark, d), ["condition", "status"])).select("orf", "condition", "status", *r6("mean", "nz_mean", "nz_perc"))


@query("SELECT sample_id, round(ln(avg((count = 0)::int) / (1 - avg((count = 0)::int))), 6) + 0 AS logit_z_perc, round(avg(count) FILTER (count > 0), 6) + 0 AS nz_mean FROM site_counts GROUP BY 1")
def a13_global_stats_for_rep(spark, d):
    return agg.global_stats_for_rep(t.site_counts(spark, d)).select("sample_id", *r6("logit_z_perc", "nz_mean"))


@query(", m AS (SELECT orf, condition, avg(count) AS mean FROM site_gene_b JOIN samples USING (sample_id) GROUP BY 1, 2) SELECT orf, condition, round(log2((mean + 5) / (avg(mean) OVER (PARTITION BY orf) + 5)), 6) + 0 AS lfc FROM m")
def a14_log_fold_change(spark, d):
    sums = agg.sums_by_group(gene_sums(spark, d, "B"), t.samples(spark, d), ["condition"])
    return agg.log_fold_change(sums.withColumn("mean", F.col("reads") / F.col("n"))).select("orf", "condition", *r6("lfc"))


@query(", m AS (SELECT orf, sample_id, avg(count) AS mean FROM site_gene_a GROUP BY 1, 2) SELECT x.sample_id AS a, y.sample_id AS b, round(corr(x.mean, y.mean), 6) + 0 AS r FROM m x JOIN m y ON x.orf = y.orf AND x.sample_id <= y.sample_id GROUP BY 1, 2")
def a15_sample_correlation(spark, d):
    return agg.sample_correlation(gene_means(spark, d)).select("a", "b", *r6("r"))


@query(", x AS (SELECT a.position, a.count > 0 AS x, b.count > 0 AS y FROM site_counts a JOIN site_counts b ON a.position = b.position AND a.sample_id = 'NO_0' AND b.sample_id = 'NO_1'), c AS (SELECT sum((x AND y)::int) AS a, sum((x AND NOT y)::int) AS b, sum((NOT x AND y)::int) AS c, sum((NOT x AND NOT y)::int) AS d FROM x) SELECT round((a * d - b * c) / sqrt((a + b)::double * (c + d) * (a + c) * (b + d)), 6) + 0 AS phi FROM c")
def a16_phi_coefficient(spark, d):
    both = agg.pairwise_points(t.site_counts(spark, d), "NO_0", "NO_1").select((F.col("x") > 0).alias("x"), (F.col("y") > 0).alias("y"))
    return agg.phi_coefficient(both, "x", "y").select(*r6("phi"))


@query("SELECT sample_id, round(regr_slope(count, position), 6) + 0 AS slope, round(regr_intercept(count, position), 6) + 0 AS intercept, round(sqrt((regr_syy(count, position) - regr_sxy(count, position) ^ 2 / regr_sxx(count, position)) / (regr_count(count, position) - 2)), 6) + 0 AS residual_sd FROM site_counts WHERE count > 0 GROUP BY 1")
def a17_regress(spark, d):
    return agg.regress(t.site_counts(spark, d).filter("count > 0"), "position", "count", ["sample_id"]).select("sample_id", *r6("slope", "intercept", "residual_sd"))


@query("SELECT count, count(*) AS n FROM site_counts GROUP BY 1")
def a18_popularity(spark, d):
    return agg.popularity(t.site_counts(spark, d), "count")


@query("SELECT cast(least(floor((count - 0) / 2), 99) AS int) AS bin, count(*) AS n FROM site_counts WHERE count > 0 AND count <= 200 GROUP BY 1")
def a19_histogram(spark, d):
    return agg.histogram(t.site_counts(spark, d).filter("count > 0"), "count", 0, 200, 100)


@query(""", h AS (SELECT *, quantile_cont(count, 0.99) OVER (PARTITION BY sample_id) AS top FROM site_counts WHERE count > 0), k AS (SELECT sample_id, count, count(*) AS n FROM h WHERE count <= top GROUP BY 1, 2),
 q AS (SELECT *, sum(n) OVER w / sum(n * count) OVER w AS p, (sum(n) OVER (PARTITION BY sample_id ORDER BY count ROWS UNBOUNDED PRECEDING) - n / 2) / sum(n) OVER w AS q FROM k WINDOW w AS (PARTITION BY sample_id)) SELECT sample_id, count, n, ceil(ln(1 - q) / ln(1 - p)) AS expected FROM q""")
def a20_qq_geometric(spark, d):
    return agg.qq_geometric(t.site_counts(spark, d))


@query("SELECT sample_id, position, count, cast(row_number() OVER (PARTITION BY sample_id ORDER BY count DESC, position) AS int) AS rank FROM site_counts")
def a21_ranked_counts(spark, d):
    return agg.ranked_counts(t.site_counts(spark, d)).select("sample_id", "position", "count", "rank")


@query("SELECT position, round(log10(x), 6) + 0 AS x, round(log10(y), 6) + 0 AS y FROM (SELECT position, max(CASE WHEN sample_id = 'NO_0' THEN count END) AS x, max(CASE WHEN sample_id = 'NO_1' THEN count END) AS y FROM raw_counts WHERE sample_id IN ('NO_0', 'NO_1') GROUP BY 1) WHERE x > 0 AND y > 0")
def a22_pairwise_points(spark, d):
    return agg.pairwise_points(t.site_counts(spark, d), "NO_0", "NO_1", log=True).select("position", *r6("x", "y"))


# Windows


@query(RUNS_SQL + "SELECT sample_id, run_id, length, start_idx, end_idx, start_pos, end_pos FROM runs")
def w2_runs(spark, d):
    return _runs(spark, d).select("sample_id", F.col("run_id"), "length", "start_idx", "end_idx", "start_pos", "end_pos")


STATE_SQL = """, i1 AS (SELECT *, sum(CASE WHEN count < 2 THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS island FROM site_counts),
 st AS (SELECT sample_id, position, count, CASE WHEN count < 2 AND sum((count < 2)::int) OVER (PARTITION BY sample_id, island) >= 6 THEN 'ES' ELSE 'NE' END AS state FROM i1) """


@query(STATE_SQL + "SELECT * FROM st")
def w3_state_runs(spark, d):
    return windows.state_runs(t.site_counts(spark, d), ["sample_id"]).select("sample_id", "position", "count", "state")


@query(STATE_SQL + """, nb AS (SELECT a.sample_id, a.position, a.count, a.state, row_number() OVER (PARTITION BY a.sample_id ORDER BY a.position) AS i FROM st a),
 m AS (SELECT a.sample_id, a.position, a.count, avg(b.count) AS m FROM nb a LEFT JOIN nb b ON a.sample_id = b.sample_id AND b.i BETWEEN a.i - 5 AND a.i + 5 AND b.i <> a.i AND a.state = b.state GROUP BY 1, 2, 3)
 SELECT sample_id, position, round(coalesce(m, -1), 6) + 0 AS local_mean, round(log2((count + 10) / (coalesce(m, -1) + 10)), 6) + 0 AS local_lfc FROM m""")
def w4_local_average(spark, d):
    return windows.local_average(windows.state_runs(t.site_counts(spark, d), ["sample_id"]), ["sample_id"]).select("sample_id", "position", *r6("local_mean", "local_lfc"))


@query(""", v AS (SELECT sample_id, count, row_number() OVER (PARTITION BY sample_id ORDER BY count) AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM site_counts WHERE count > 0)
 SELECT sample_id, round(avg(count), 6) + 0 AS trimmed_mean FROM v WHERE i > floor(n * 0.05) AND i <= n - floor(n * 0.05) GROUP BY 1""")
def w9_trimmed_mean(spark, d):
    return windows.trimmed_mean(t.site_counts(spark, d).filter("count > 0"), ["sample_id"], "count", 0.05).select("sample_id", *r6("trimmed_mean"))


@query("SELECT orf, sample_id, position, rank() OVER (PARTITION BY orf ORDER BY count) + (count(*) OVER (PARTITION BY orf, count) - 1) / 2 AS avg_rank FROM site_gene_a")
def w10_average_ranks(spark, d):
    return _changed(spark, d, windows.ranked_counts, "avg_rank")


@query("SELECT sample_id, bucket, min(position) AS position, sum(count) AS count FROM (SELECT *, cast((row_number() OVER (PARTITION BY sample_id ORDER BY position) - 1) // 100 AS bigint) AS bucket FROM site_counts) GROUP BY 1, 2")
def w13_bucket_sums(spark, d):
    return windows.bucket_sums(t.site_counts(spark, d), ["sample_id"]).select("sample_id", "bucket", "position", "count")


# Normalisation


def _norm_sql(factor: str, extra: str = "") -> str:
    return f"{extra or ', one AS (SELECT 1)'}, f AS ({factor}) SELECT sample_id, position, round(s.count * f.factor, 4) + 0 AS count FROM site_counts s JOIN f USING (sample_id)"


def _sites(df, digits: int = 4):
    """Every site's count."""
    return df.select("sample_id", "position", (F.round("count", digits) + F.lit(0.0)).alias("count"))


@query("SELECT sample_id, position, round(count, 4) + 0 AS count FROM site_counts")
def n1_nonorm(spark, d):
    return _sites(normalise.normalize(t.site_counts(spark, d), "nonorm"))


TTR_SQL = """, v AS (SELECT sample_id, count, row_number() OVER (PARTITION BY sample_id ORDER BY count) AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM site_counts WHERE count > 0),
 tm AS (SELECT sample_id, avg(count) AS m FROM v WHERE i > floor(n * 0.05) AND i <= n - floor(n * 0.05) GROUP BY 1), de AS (SELECT sample_id, avg((count > 0)::int) AS d FROM site_counts GROUP BY 1),
 ttr AS (SELECT sample_id, 100 / (d * m) AS factor FROM tm JOIN de USING (sample_id))"""


@query(_norm_sql("SELECT * FROM ttr", TTR_SQL))
def n2_ttr(spark, d):
    return _sites(normalise.normalize(t.site_counts(spark, d), "TTR"))


@query(_norm_sql("SELECT sample_id, 50 / (avg((count > 10)::int) * quantile_cont(count, 0.5) FILTER (count > 0)) AS factor FROM site_counts GROUP BY 1"))
def n2_ttr_with_estimators(spark, d):
    """TTR with other estimators of density and mean, and another target."""
    counts, hit = t.site_counts(spark, d), F.when(F.col("count") > 0, F.col("count"))
    factors = normalise.ttr_factors(counts, density=F.avg((F.col("count") > 10).cast("double")), mean=F.percentile(hit, 0.5), target=50.0)
    return _sites(normalise.scaled(counts, factors))


@query(_norm_sql("SELECT sample_id, avg(m) OVER () / m AS factor FROM (SELECT sample_id, avg(count) AS m FROM site_counts WHERE count > 0 GROUP BY 1)"))
def n3_nzmean(spark, d):
    return _sites(normalise.normalize(t.site_counts(spark, d), "nzmean"))


@query(_norm_sql("SELECT sample_id, avg(m) OVER () / m AS factor FROM (SELECT sample_id, avg(count) AS m FROM site_counts GROUP BY 1)"))
def n4_totreads(spark, d):
    return _sites(normalise.normalize(t.site_counts(spark, d), "totreads"))


@query(None)
def n5_emphist(spark, d):
    return _sites(normalise.normalize(t.site_counts(spark, d), "emphist", site_gene(spark, d), "NO_0"))


@query(None)
def n6_zinfnb(spark, d):
    return _sites(normalise.normalize(t.site_counts(spark, d), "zinfnb"))


@query(""", x AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY count, position) AS i, dense_rank() OVER (PARTITION BY sample_id ORDER BY count) AS r FROM site_counts),
 mm AS (SELECT m, dense_rank() OVER (ORDER BY m) AS r FROM (SELECT DISTINCT m FROM (SELECT i, avg(count) AS m FROM x GROUP BY 1))) SELECT sample_id, position, round(m, 4) + 0 AS count FROM x JOIN mm USING (r)""")
def n7_quantile(spark, d):
    return _sites(normalise.normalize(t.site_counts(spark, d), "quantile"))


@query(None)
def n8_betageom(spark, d):
    return _sites(normalise.normalize(t.site_counts(spark, d), "betageom"))


@query(None)
def n9_abgc(spark, d):
    return _sites(normalise.normalize(t.site_counts(spark, d), "aBGC"))


@query(_norm_sql("SELECT sample_id, 100 / avg(count) AS factor FROM site_counts GROUP BY 1"))
def n10_target(spark, d):
    return _sites(normalise.normalize(t.site_counts(spark, d), "target"))


@query(""", b AS (SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY position) - 1) // 100 AS bucket, position, count FROM site_counts), w AS (SELECT sample_id, bucket, min(position) AS position, sum(count) AS count FROM b GROUP BY 1, 2),
 n AS (SELECT a.sample_id, a.bucket, a.position, c.position::double AS x, c.count AS y, power(1 - power(abs(c.position - a.position) / 10000.0, 3), 3) AS w FROM w a JOIN w c ON a.sample_id = c.sample_id AND abs(a.position - c.position) <= 10000),
 s AS (SELECT sample_id, bucket, position, sum(w) AS sw, sum(w * x) AS swx, sum(w * y) AS swy, sum(w * x * y) AS swxy, sum(x * x) AS sxx FROM n GROUP BY 1, 2, 3),
 g AS (SELECT *, coalesce((sw * swxy - swx * swy) / nullif(sw * sxx - swx * swx, 0), 0) AS slope FROM s), h AS (SELECT sample_id, bucket, (swy - slope * swx) / sw + slope * position AS smooth FROM g),
 f AS (SELECT sample_id, bucket, smooth / avg(smooth) OVER (PARTITION BY sample_id) AS factor FROM h) SELECT sample_id, position, round(count / factor, 3) + 0 AS count FROM b JOIN f USING (sample_id, bucket)""")
def n11_loess(spark, d):
    return _sites(normalise.loess_correction(t.site_counts(spark, d)), 3)


@query(TTR_SQL + "SELECT sample_id, round(d, 6) + 0 AS theta, round(m, 6) + 0 AS mu FROM tm JOIN de USING (sample_id)")
def n12_estimators(spark, d):
    sc = t.site_counts(spark, d)
    return normalise.empirical_theta(sc).join(normalise.trimmed_empirical_mu(sc), "sample_id").select("sample_id", *r6("theta", "mu"))
