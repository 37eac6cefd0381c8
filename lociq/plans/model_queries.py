"""Registered queries of the statistical models, gene sets and dose response."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lociq.functions import special
from lociq.operators import aggregates as agg
from lociq.operators import crispri, essentiality, filters, genesets, interactions, joins, normalise, ordered, tests, ttn, windows
from lociq.operators import reads as rd
from lociq.plans import tables as t
from lociq.plans.queries import BLOCKS_SQL, RUNS_SQL, SQL, TTR_SQL, blocks, gene_sums, query, r6, site_gene
from lociq.scratch import folder, keep
from lociq.sources import readers


def _groups(spark, d):
    """Samples of conditions N (control) and A."""
    return t.samples(spark, d).filter("condition IN ('N', 'A')").select("sample_id", (F.col("condition") == "A").alias("is_exp"), F.col("replicate").alias("library"))


ANOVA_SQL = """, e AS (SELECT orf, condition, count(*) AS n, sum(count) AS s, sum(count * count) AS ss, count(DISTINCT position) AS sites FROM site_gene_b JOIN samples USING (sample_id) GROUP BY 1, 2),
 tot AS (SELECT orf, sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS between_ss, count(*) AS k, max(sites) AS n_sites FROM e GROUP BY 1) """


@query(ANOVA_SQL + "SELECT orf, n_sites, round((between_ss - s * s / n) / (k - 1), 6) + 0 AS msr, round((ss - between_ss) / (n - k) + 1000, 6) + 0 AS mse_alpha FROM tot WHERE n_sites > 1 AND s > 0")
def m1_anova_statistics(spark, d):
    sums = agg.sums_by_group(gene_sums(spark, d, "B", ss=lambda x: x * x), t.samples(spark, d), ["condition"])
    found = tests.anova_of_sums(sums.withColumnRenamed("reads", "s"), t.genes(spark, d))
    return found.filter("status = '-'").select("orf", "n_sites", *r6("msr", "mse_alpha"))


#: Benjamini-Hochberg over a table p with a column pval.
BH_SQL = "bh AS (SELECT *, pval * count(*) OVER () / count(*) OVER (ORDER BY pval) AS raw FROM p), q AS (SELECT *, least(min(raw) OVER (ORDER BY pval DESC), 1) AS padj FROM bh) "


def _ttr(spark, d):
    return normalise.normalize(keep(t.site_counts(spark, d), "track"), "TTR")  # read for the factors and for the counts


# Three conditions: the F distribution with 2 and m degrees of freedom has the tail (1 + 2 f / m) ^ (-m / 2).
M1_SQL = TTR_SQL + """, sg AS (SELECT orf, position, condition, b.count * factor AS c FROM site_gene_b b JOIN ttr USING (sample_id) JOIN samples USING (sample_id)),
 e AS (SELECT orf, condition, count(*) AS n, sum(c) AS s, sum(c * c) AS ss, count(DISTINCT position) AS sites FROM sg GROUP BY 1, 2),
 tot AS (SELECT orf, sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS between_ss, count(*) AS k, max(sites) AS n_sites FROM e GROUP BY 1),
 r AS (SELECT g.orf, coalesce(n_sites, 0) AS n_sites, n, k, CASE WHEN coalesce(n_sites, 0) <= 1 THEN 'TA sites <= 1' WHEN s = 0 THEN 'No counts in all conditions' ELSE '-' END AS status, (between_ss - s * s / n) / (k - 1) AS a, (ss - between_ss) / (n - k) + 1000 AS b FROM genes g LEFT JOIN tot USING (orf)),
 p AS (SELECT orf, n_sites, status, CASE WHEN status = '-' THEN a ELSE 0 END AS msr, CASE WHEN status = '-' THEN b ELSE 0 END AS mse_alpha, CASE WHEN status = '-' THEN a / b ELSE -1 END AS fstat, CASE WHEN status = '-' THEN power(1 + 2 * a / b / (n - k), -(n - k) / 2) ELSE 1 END AS pval FROM r), """ + BH_SQL


@query(M1_SQL + "SELECT orf, n_sites, status, round(msr, 3) + 0 AS msr, round(mse_alpha, 3) + 0 AS mse_alpha, round(fstat, 6) + 0 AS fstat, round(pval, 6) + 0 AS pval, round(padj, 6) + 0 AS padj FROM q")
def m1_anova(spark, d):
    """The flagship: TTR, sites to genes, moderated ANOVA and BH."""
    found = tests.anova_of_counts(_ttr(spark, d), t.samples(spark, d), t.genes(spark, d), variant="B")
    return found.select("orf", "n_sites", "status", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("msr", "mse_alpha")], *r6("fstat", "pval", "padj"))


@query(M1_SQL + """, wr AS (SELECT *, dense_rank() OVER (PARTITION BY orf, condition ORDER BY c DESC) AS rk FROM sg), ws AS (SELECT *, max(CASE WHEN rk = 2 THEN c END) OVER (PARTITION BY orf, condition) AS second FROM wr),
 mm AS (SELECT orf, condition, avg(CASE WHEN rk = 1 AND second IS NOT NULL THEN second ELSE c END) AS m FROM ws GROUP BY 1, 2),
 wide AS (SELECT g.orf, coalesce(max(m) FILTER (condition = 'N'), 0) AS n, coalesce(max(m) FILTER (condition = 'A'), 0) AS a, coalesce(max(m) FILTER (condition = 'R'), 0) AS r FROM genes g LEFT JOIN mm USING (orf) GROUP BY 1)
 SELECT q.orf, round(n, 4) + 0 AS "Mean N", round(a, 4) + 0 AS "Mean A", round(r, 4) + 0 AS "Mean R", round(log2((n + 5) / (n + 5)), 6) + 0 AS "Log 2 FC N", round(log2((a + 5) / (n + 5)), 6) + 0 AS "Log 2 FC A", round(log2((r + 5) / (n + 5)), 6) + 0 AS "Log 2 FC R", n_sites, status, round(pval, 6) + 0 AS pval, round(padj, 6) + 0 AS padj FROM q JOIN wide USING (orf)""")
def m1_anova_report(spark, d):
    """The whole result table, in gene order, with N as the reference."""
    table, ids = t.site_table(spark, d)
    sites = keep(table, "sites")  # read for the factors and for the sums
    factors = {r["sample_id"]: r["factor"] for r in normalise.ttr_factors(joins.by_sample(sites, ids)).filter("factor IS NOT NULL").collect()}  # a row a sample
    found = tests.anova_report_of_sites(sites, ids, t.samples(spark, d), t.genes(spark, d), ["N", "A", "R"], refs=["N"], factors=factors)
    return found.select("orf", *[(F.round(f"Mean {c}", 4) + F.lit(0.0)).alias(f"Mean {c}") for c in "NAR"], *r6(*[f"Log 2 FC {c}" for c in "NAR"]), "n_sites", "status", *r6("pval", "padj"))


@query(None)
def m2_resampling(spark, d):
    sites, ids = t.site_table(spark, d)
    return tests.resampling(sites, _groups(spark, d), times=10_000, mode="site", genes=t.genes(spark, d), ids=ids)


@query(None)
def m2_resampling_adaptive(spark, d):
    sites, ids = t.site_table(spark, d)
    return tests.resampling(sites, _groups(spark, d), times=10_000, mode="library", adaptive=True, genes=t.genes(spark, d), ids=ids)


def _shifted_genes(spark, d):
    """The annotation of a second strain: the same genes 40 bases on, without every seventh."""
    return t.genes(spark, d).filter("gene_order % 7 <> 0").withColumns({"start": F.col("start") + 40, "end": F.col("end") + 40})


@query(""", g2 AS (SELECT contig, orf, start + 40 AS start, "end" + 40 AS "end", strand FROM genes WHERE gene_order % 7 <> 0),
 sg AS (SELECT a.orf, a.position, a.count, false AS x FROM site_gene_a a JOIN samples s USING (sample_id) JOIN g2 ON g2.orf = a.orf WHERE s.condition = 'N'
  UNION ALL SELECT g.orf, s.position, s.count, true FROM site_counts s JOIN samples m USING (sample_id) JOIN g2 g ON s.position BETWEEN g.start AND g."end" AND (CASE WHEN g.strand = '+' THEN s.position <= g."end" - 3 ELSE s.position >= g.start + 3 END) WHERE m.condition = 'A')
 SELECT orf, count(DISTINCT position) AS sites, sum(count) FILTER (NOT x) AS sum_ctrl, sum(count) FILTER (x) AS sum_exp, round(avg(count) FILTER (NOT x), 6) + 0 AS mean_ctrl, round(avg(count) FILTER (x), 6) + 0 AS mean_exp,
  round(avg(count) FILTER (x) - avg(count) FILTER (NOT x), 6) + 0 AS delta_mean, round(log2((avg(count) FILTER (x) + 1) / (avg(count) FILTER (NOT x) + 1)), 6) + 0 AS lfc FROM sg GROUP BY 1""")
def m2_two_strain_statistics(spark, d):
    """Control and experiment in two strains, each with its own annotation: what the permutation test reports beside its p."""
    table, ids = t.site_table(spark, d)
    found = tests.resampling_of_strains(keep(table, "sites"), ids, _groups(spark, d), t.genes(spark, d), _shifted_genes(spark, d), times=10_000, mode="pooled")
    return found.select("orf", "sites", "sum_ctrl", "sum_exp", *r6("mean_ctrl", "mean_exp", "delta_mean", "lfc"))


@query(""", g AS (SELECT orf, count, s.condition = 'A' AS x FROM site_gene_a JOIN samples s USING (sample_id) WHERE s.condition IN ('N', 'A')), r AS (SELECT *, rank() OVER (PARTITION BY orf ORDER BY count) + (count(*) OVER (PARTITION BY orf, count) - 1) / 2 AS rk FROM g)
 SELECT orf, sum(CASE WHEN NOT x THEN rk END) - count(*) FILTER (NOT x) * (count(*) FILTER (NOT x) + 1) / 2 AS u, round(avg(count) FILTER (NOT x), 6) + 0 AS mean_ctrl, round(avg(count) FILTER (x), 6) + 0 AS mean_exp FROM r GROUP BY 1""")
def m3_utest_statistics(spark, d):
    found = tests.utest(site_gene(spark, d, whole_genes=True), _groups(spark, d).select("sample_id", "is_exp"))
    return found.select("orf", "u", *r6("mean_ctrl", "mean_exp"))




@query(""", gs AS (SELECT b.orf, s.status || '_' || s.condition AS g, count AS c FROM site_gene_b b JOIN samples s USING (sample_id)), rk AS (SELECT *, dense_rank() OVER (PARTITION BY orf, g ORDER BY c DESC) AS k FROM gs), w AS (SELECT *, max(CASE WHEN k = 2 THEN c END) OVER (PARTITION BY orf, g) AS second FROM rk),
 v AS (SELECT orf, g, CASE WHEN k = 1 AND second IS NOT NULL THEN second ELSE c END AS c FROM w), st AS (SELECT orf, g, avg(c) AS m, coalesce(avg(c) FILTER (c > 0), 0) AS nz, avg((c > 0)::int) AS z FROM v GROUP BY 1, 2)
 SELECT ge.orf, round(coalesce(a.m, 0), 6) + 0 AS "Mean F_A", round(coalesce(b.m, 0), 6) + 0 AS "Mean O_N", round(log2((coalesce(a.m, 0) + 5) / ((coalesce(a.m, 0) + coalesce(b.m, 0)) / 2 + 5)), 6) + 0 AS "Log 2 FC F_A", round(log2((coalesce(b.m, 0) + 5) / ((coalesce(a.m, 0) + coalesce(b.m, 0)) / 2 + 5)), 6) + 0 AS "Log 2 FC O_N",
 round(coalesce(a.nz, 0), 6) + 0 AS "Non Zero Mean F_A", round(coalesce(b.nz, 0), 6) + 0 AS "Non Zero Mean O_N", round(coalesce(a.z, 0), 6) + 0 AS "Non Zero Percentage F_A", round(coalesce(b.z, 0), 6) + 0 AS "Non Zero Percentage O_N" FROM genes ge LEFT JOIN st a ON a.orf = ge.orf AND a.g = 'F_A' LEFT JOIN st b ON b.orf = ge.orf AND b.g = 'O_N'""")
def m4_group_table(spark, d):
    """The columns by group that stand beside the models, with winsorised counts."""
    named = t.samples(spark, d).select("sample_id", F.concat_ws("_", "status", "condition").alias("group"))
    found = tests.group_table(site_gene(spark, d, "B"), named, t.genes(spark, d), ["F_A", "O_N"], winz=True)
    return found.select("orf", *r6(*[c for c in found.columns if c != "orf"]))


@query(None)
def m4_zinb_interactions(spark, d):
    """Condition by status: samples with both levels of status in each condition do not exist here, so the test is on batches (replicates)."""
    samples = t.samples(spark, d).filter("condition IN ('A', 'R', 'N')")
    table, ids = t.site_table(spark, d)
    return tests.zinb_report_of_sites(table, ids, t.site_counts(spark, d), samples, t.genes(spark, d), ["N", "A", "R"], interactions=["replicate"])


@query(None)
def m4_zinb(spark, d):
    table, ids = t.site_table(spark, d)
    return tests.zinb_of_sites(table, ids, t.site_counts(spark, d), t.samples(spark, d), t.genes(spark, d))


def _blocks(spark, d):
    """Gene blocks of all samples together, on whole genes."""
    return keep(blocks(spark, d), "blocks")


@query(None)
def m5_gumbel(spark, d):
    found = _blocks(spark, d).select("orf", "k", "n", F.col("max_run").cast("long").alias("max_run"), F.col("gap_span").cast("long").alias("gap_span"), F.col("span").cast("long").alias("span"), "theta")
    return essentiality.gumbel(found, samples=10_000, burnin=500)


# Up to 19 sites the expected longest run is exact: the sum over r of P(longest >= r), where P(longest < r) of n sites is b(n) - q^r b(n - r)
# with b(n) = sum over l of (-1)^l C(n - l r, l) (p q^r)^l.
EXPECTED_SQL = """, th AS (SELECT sum(k) / sum(n) AS p FROM blocks), nr AS (SELECT n, r, p, 1 - p AS q FROM range(1, 20) a(n), range(1, 20) b(r), th WHERE r <= n),
 bt AS (SELECT n, r, q, list_sum(list_transform(range(0, n // (r + 1) + 1), lambda l: power(-1, l) * exp(lgamma(n - l * r + 1) - lgamma(l + 1) - lgamma(n - l * r - l + 1)) * power(p * power(q, r), l))) AS b0,
   list_sum(list_transform(range(0, (n - r) // (r + 1) + 1), lambda l: power(-1, l) * exp(lgamma(n - r - l * r + 1) - lgamma(l + 1) - lgamma(n - r - l * r - l + 1)) * power(p * power(q, r), l))) AS b1 FROM nr),
 sm AS (SELECT n, sum(1 - (b0 - power(q, r) * b1)) AS e FROM bt GROUP BY 1) """


@query(BLOCKS_SQL + EXPECTED_SQL + """, u AS (SELECT b.orf, b.n, max_run, p, CASE WHEN b.n = 0 THEN 0 WHEN b.n < 20 THEN sm.e ELSE ln(b.n * p) / ln(1 / (1 - p)) + 0.5772156649015329 / ln(1 / (1 - p)) - 0.5 + 0.000016 + 0.01 END AS e FROM blocks b CROSS JOIN th LEFT JOIN sm ON sm.n = b.n)
 SELECT orf, round(e, 6) + 0 AS expected_run, CASE WHEN n = 0 THEN 1 ELSE round(1 - exp(-exp((e - 0.5772156649015329 / ln(1 / (1 - p)) - max_run) * ln(1 / (1 - p)))), 6) + 0 END AS pval FROM u""")
def m6_griffin(spark, d):
    found = _blocks(spark, d)  # read for the share of hits and for the genes
    theta = found.agg((F.sum("k") / F.sum("n")).alias("p")).first()["p"]
    return essentiality.griffin(found, theta).select("orf", *r6("expected_run", "pval"))


GAPS_SQL = RUNS_SQL + """, g AS (SELECT sample_id, avg((count > 0)::int) AS p, count(*) AS n FROM site_counts GROUP BY 1), mt AS (SELECT r.sample_id, ge.orf, r.run_id, r.length, greatest(least(r.end_pos, ge."end") - greatest(r.start_pos, ge.start), 0) AS ov FROM runs r JOIN genes ge ON r.start_pos <= ge."end" AND ge.start <= r.end_pos),
 b AS (SELECT *, row_number() OVER (PARTITION BY sample_id, orf ORDER BY ov DESC, run_id) AS k FROM mt),
 pv AS (SELECT g.sample_id, ge.orf, b.run_id, coalesce(b.length, 0) AS run_length, coalesce(ov, 0) AS overlap, coalesce(1 - exp(-exp((ln(n * p) / ln(1 / (1 - p)) - b.length) * ln(1 / (1 - p)))), 1) AS pval FROM genes ge CROSS JOIN g LEFT JOIN b ON b.orf = ge.orf AND b.sample_id = g.sample_id AND b.k = 1),
 raw AS (SELECT *, pval * count(*) OVER (PARTITION BY sample_id) / count(*) OVER (PARTITION BY sample_id ORDER BY pval) AS raw FROM pv), q AS (SELECT *, least(min(raw) OVER (PARTITION BY sample_id ORDER BY pval DESC), 1) AS padj FROM raw) """


@query(GAPS_SQL + "SELECT sample_id, orf, run_id, run_length, overlap, round(pval, 6) + 0 AS pval, round(padj, 6) + 0 AS padj, CASE WHEN padj < 0.05 THEN 'Essential' ELSE 'Non-essential' END AS call FROM q")
def m7_tn5gaps(spark, d):
    """Every sample by itself, in one plan; the zero-filled track is written once."""
    track = keep(t.site_counts(spark, d), "track")
    found = essentiality.gaps(windows.runs(track, ["sample_id", "contig"]), t.genes(spark, d), essentiality.insertion_rates(track, ["sample_id"]), ["sample_id"])
    return found.select("sample_id", "orf", "run_id", "run_length", "overlap", *r6("pval", "padj"), "call")


def _track(spark, d):
    counts = joins.with_metadata(t.site_counts(spark, d), t.samples(spark, d).select("sample_id", "condition"))
    return agg.combine_replicates(counts, "Mean", ["condition", "contig", "position"])


@query(None)
def m8_hmm(spark, d):
    return essentiality.hmm(_track(spark, d), block=2000)


def _hmm_genes(spark, d):
    states = essentiality.hmm(_track(spark, d), block=2000)
    assigned = joins.assign_sites(states, t.genes(spark, d).select("contig", "orf", "start", "end", "strand"), ignore_codon=False)
    return essentiality.hmm_genes(assigned, t.genes(spark, d), t.samples(spark, d).select("condition"))


@query(None)
def m9_hmm_genes(spark, d):
    return _hmm_genes(spark, d)


@query(""", st AS (SELECT orf, CASE WHEN count = 0 THEN 'ES' WHEN count < 20 THEN 'GD' WHEN count < 40 THEN 'NE' ELSE 'GA' END AS state, count FROM site_gene_a),
 c AS (SELECT orf, count(*) AS n, count(*) FILTER (state = 'ES') AS es, count(*) FILTER (state = 'GD') AS gd, count(*) FILTER (state = 'NE') AS ne, count(*) FILTER (state = 'GA') AS ga, avg((count > 0)::int) * coalesce(avg(count) FILTER (count > 0), 0) AS v FROM st GROUP BY 1),
 ca AS (SELECT *, CASE WHEN es = n THEN 'ES' WHEN ga >= greatest(es, gd, ne) THEN 'GA' WHEN ne >= greatest(es, gd) THEN 'NE' WHEN gd >= es THEN 'GD' ELSE 'ES' END AS call FROM c),
 sp AS (SELECT call, quantile_cont(v, 0.5) AS mid, greatest(0.7314 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)), 1) AS sd FROM ca GROUP BY 1),
 de AS (SELECT ca.orf, ca.call, sp.call AS s, exp(-0.5 * power((v - mid) / sd, 2)) / (sd * sqrt(2 * pi())) AS d FROM ca CROSS JOIN sp), pr AS (SELECT orf, s, call, coalesce(d / nullif(sum(d) OVER (PARTITION BY orf), 0), 0) AS p FROM de),
 cf AS (SELECT orf, max(p) FILTER (s = call) AS confidence, max(p) AS best FROM pr GROUP BY 1)
 SELECT ca.orf, call, round(CASE call WHEN 'ES' THEN es WHEN 'GD' THEN gd WHEN 'NE' THEN ne ELSE ga END / n, 6) + 0 AS consistency, round(confidence, 6) + 0 AS confidence, CASE WHEN confidence < 0.2 THEN 'low-confidence' WHEN confidence < best THEN 'ambiguous' ELSE '' END AS flag FROM ca JOIN cf USING (orf)""")
def m10_confidence_of_calls(spark, d):
    """Confidence of calls that stand on counts: every sample's sites."""
    x = F.col("count")
    states = site_gene(spark, d).withColumn("state", F.when(x == 0, "ES").when(x < 20, "GD").when(x < 40, "NE").otherwise("GA"))
    return essentiality.hmm_confidence(essentiality.hmm_genes(states, t.genes(spark, d))).select("orf", "call", *r6("consistency", "confidence"), "flag")


@query(None)
def m10_hmm_confidence(spark, d):
    return essentiality.hmm_confidence(_hmm_genes(spark, d), keys=["condition"])


@query(""", st AS (SELECT sample_id, orf, CASE WHEN count = 0 THEN 'ES' WHEN count < 20 THEN 'GD' WHEN count < 40 THEN 'NE' ELSE 'GA' END AS state, count FROM site_gene_a),
 c AS (SELECT sample_id, orf, count(*) AS n, count(*) FILTER (state = 'ES') AS es, count(*) FILTER (state = 'GD') AS gd, count(*) FILTER (state = 'NE') AS ne, count(*) FILTER (state = 'GA') AS ga FROM st GROUP BY 1, 2)
 SELECT s.sample_id, g.orf, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'N/A' WHEN es = n THEN 'ES' WHEN ga >= greatest(es, gd, ne) THEN 'GA' WHEN ne >= greatest(es, gd) THEN 'NE' WHEN gd >= es THEN 'GD' ELSE 'ES' END AS call FROM genes g CROSS JOIN samples s LEFT JOIN c ON c.orf = g.orf AND c.sample_id = s.sample_id""")
def m9_hmm_gene_calls(spark, d):
    """Calls of every sample by itself, in one plan."""
    state = lambda x: F.when(x == 0, "ES").when(x < 20, "GD").when(x < 40, "NE").otherwise("GA")
    counted = {s.lower(): (lambda x, s=s: (state(x) == s).cast("long")) for s in essentiality.STATES}
    return essentiality.hmm_calls(gene_sums(spark, d, genes=t.genes(spark, d), **counted)).select("sample_id", "orf", "n", "call")


@query(None)
def m11_genetic_interactions(spark, d):
    cells = t.samples(spark, d).filter("condition IN ('N', 'A', 'R')").withColumn("cell", F.when(F.col("condition") == "N", F.concat(F.lit("A"), F.col("replicate").cast("int") + 1)).otherwise(F.concat(F.lit("B"), F.col("replicate").cast("int") + 1)))
    sums = agg.sums_by_group(gene_sums(spark, d, ss=lambda x: x * x), cells, ["cell"])
    mean = F.col("reads") / F.col("n")
    each = sums.select("orf", "cell", "n", mean.alias("m"), F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)).alias("v"), "sites")
    return interactions.genetic_interactions(each, None, samples=10_000)


@query(None)
def m12_ttn_fitness(spark, d):
    letters = F.array(*[F.lit(c) for c in "ACGT"])
    base = lambda k: F.get(letters, F.pmod(F.xxhash64((F.col("position") + k)), F.lit(4)).cast("int"))
    context = F.concat(*[base(k) for k in (-4, -3, -2, -1)], F.lit("TA"), *[base(k) for k in (2, 3, 4, 5)])
    table, ids = t.site_table(spark, d)
    sites = keep(ttn.ttn_features(table.withColumn("context", context)).drop("context"), "sites")  # read for the equations and for the effects
    return ttn.ttn_fitness_of_sites(sites, ids, t.genes(spark, d))


@query(""", ta AS (SELECT read_id, i AS position, substr(seq, i::int - 4, 10) AS c FROM (SELECT read_id, seq, unnest(range(5, length(seq) - 4)) AS i FROM reads) WHERE substr(seq, i::int, 2) = 'TA')
 SELECT read_id, position, (instr('ACGT', substr(c, 1, 1)) - 1) * 64 + (instr('ACGT', substr(c, 2, 1)) - 1) * 16 + (instr('ACGT', substr(c, 3, 1)) - 1) * 4 + instr('ACGT', substr(c, 4, 1)) - 1 AS up,
 (instr('TGCA', substr(c, 10, 1)) - 1) * 64 + (instr('TGCA', substr(c, 9, 1)) - 1) * 16 + (instr('TGCA', substr(c, 8, 1)) - 1) * 4 + instr('TGCA', substr(c, 7, 1)) - 1 AS down FROM ta""")
def m12_ttn_features(spark, d):
    """The neighbourhoods of every TA that has four letters on either side."""
    reads = t.reads(spark, d)
    sites = rd.ta_sites(reads.select(F.col("read_id").alias("contig"), F.lit(1).cast("long").alias("chunk_start"), "seq")).withColumnRenamed("contig", "read_id")
    at = sites.join(reads, "read_id").filter("position >= 5 AND position <= length(seq) - 5").withColumn("context", F.expr("substring(seq, cast(position AS int) - 4, 10)"))
    return ttn.ttn_features(at).select("read_id", "position", F.col("up").cast("long").alias("up"), F.col("down").cast("long").alias("down"))


@query(None)
def m13_fitness_defect(spark, d):
    """Every sample by itself, in one plan."""
    track = keep(t.site_counts(spark, d), "track")
    background = windows.state_runs(track, ["sample_id"]).filter("state = 'NE'").groupBy("sample_id", "count").agg(F.count("*").alias("n"))
    assigned = joins.assign_sites(track, t.genes(spark, d).select("contig", "orf", "start", "end", "strand"))
    blocks = assigned.groupBy("sample_id", "orf").agg(F.count("*").alias("n"), F.sum("count").alias("sum"))
    return tests.fitness_defect(blocks, background, draws=10_000, keys=["sample_id"])


HITS_SQL = ", res AS (SELECT orf, avg(count) AS m FROM site_gene_a GROUP BY 1), hits AS (SELECT orf FROM res WHERE m > 8.5) "


def _hits(spark, d):
    """All genes with sites, and those whose mean count is above 8.5; the means are written once."""
    sites = t.site_counts(spark, d).groupBy("contig", "position").agg(F.count("*").alias("n"), F.sum("count").alias("s"))  # before sites meet genes
    assigned = joins.assign_sites(sites, t.genes(spark, d).select("contig", "orf", "start", "end", "strand"))
    means = keep(assigned.groupBy("orf").agg((F.sum("s") / F.sum("n")).alias("m")), "means")
    return means.select("orf"), means.filter("m > 8.5").select("orf")


@query(HITS_SQL + """SELECT a.term, count(*) AS n_term, count(h.orf) AS k, (SELECT count(*) FROM res) AS n_genes, (SELECT count(*) FROM hits) AS n_hits, round((SELECT count(*) FROM hits) * count(*) / (SELECT count(*) FROM res), 6) + 0 AS expected,
 round((count(h.orf) + 2) / ((SELECT count(*) FROM hits) * count(*) / (SELECT count(*) FROM res) + 2), 6) + 0 AS enrichment FROM associations a JOIN res USING (orf) LEFT JOIN hits h ON h.orf = a.orf GROUP BY 1 HAVING count(*) > 1""")
def m14_fet_statistics(spark, d):
    found = genesets.fet(*_hits(spark, d), t.associations(spark, d))
    return found.select("term", "n_term", "k", F.col("n_genes").cast("long").alias("n_genes"), F.col("n_hits").cast("long").alias("n_hits"), *r6("expected", "enrichment"))


#: Choosing k of n, in logs.
LOG_CHOOSE = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


def _hypergeom_sql(k: str, total: str, marked: str, drawn: str) -> str:
    """P(X > k) of X marked among `drawn` of `total`, as SQL over columns."""
    lo, hi = f"greatest({k} + 1, {drawn} + {marked} - {total}, 0)", f"least({drawn}, {marked})"
    term = f"exp({LOG_CHOOSE.format(n=marked, k='x')} + {LOG_CHOOSE.format(n=f'({total} - {marked})', k=f'({drawn} - x)')} - {LOG_CHOOSE.format(n=total, k=drawn)})"
    return f"least(1, coalesce(list_sum(list_transform(range(({lo})::bigint, ({hi})::bigint + 1), lambda x: {term})), 0))"


@query(HITS_SQL + ", o AS (SELECT (SELECT count(*) FROM res) AS m, (SELECT count(*) FROM hits) AS h), te AS (SELECT a.term, count(*) AS n_term, count(h.orf) AS k FROM associations a JOIN res USING (orf) LEFT JOIN hits h ON h.orf = a.orf GROUP BY 1 HAVING count(*) > 1), "
       "f AS (SELECT term, n_term, k, m, h, n_term + floor(m * 2 / h)::bigint AS marked, k + 2 AS kk FROM te, o), p AS (SELECT *, " + _hypergeom_sql("kk", "m", "marked", "h") + " AS pval FROM f), " + BH_SQL
       + "SELECT term, m AS n_genes, n_term, h AS n_hits, k, round(pval, 6) + 0 AS pval, round(padj, 6) + 0 AS padj FROM q")
def m14_fet(spark, d):
    found = genesets.fet(*_hits(spark, d), t.associations(spark, d))
    return found.select("term", F.col("n_genes").cast("long").alias("n_genes"), "n_term", F.col("n_hits").cast("long").alias("n_hits"), "k", *r6("pval", "padj"))


def _ranked(spark, d):
    table, ids = t.site_table(spark, d)
    found = tests.utest_of_sites(table, ids, _groups(spark, d).select("sample_id", "is_exp"), t.genes(spark, d))
    return windows.rank_scores(found, "LFC")


@query(""", g AS (SELECT orf, avg(count) FILTER (condition = 'N') AS c, avg(count) FILTER (condition = 'A') AS e FROM site_gene_a JOIN samples USING (sample_id) WHERE condition IN ('N', 'A') GROUP BY 1),
 l AS (SELECT orf, CASE WHEN c > 0 AND e > 0 THEN log2(e / c) ELSE log2((e + 1) / (c + 1)) END AS score FROM g) SELECT orf, round(score, 6) + 0 AS score, cast(row_number() OVER (ORDER BY score DESC, orf) AS int) AS rank FROM l""")
def w5_rank_scores(spark, d):
    found = tests.utest(site_gene(spark, d), _groups(spark, d).select("sample_id", "is_exp"))
    return windows.rank_scores(found, "LFC", seed=None).select("orf", *r6("score"), "rank")


@query(None)
def m15_gsea(spark, d):
    return genesets.gsea(_ranked(spark, d), t.associations(spark, d), n_perm=10_000)


RANK_SQL = ", m AS (SELECT orf, avg(count) AS score FROM site_gene_a GROUP BY 1), rk AS (SELECT orf, score, row_number() OVER (ORDER BY score DESC, orf) AS rank FROM m)"


@query(RANK_SQL + """, h AS (SELECT term, rank, count(*) OVER (PARTITION BY term) AS sz, row_number() OVER (PARTITION BY term ORDER BY rank) AS i FROM associations JOIN rk USING (orf))
 SELECT term, round(max(abs(i / sz - (rank - i) / ((SELECT count(*) FROM rk) - sz))), 6) + 0 AS es, max(sz) AS n_members FROM h GROUP BY 1""")
def w6_running_enrichment(spark, d):
    means = site_gene(spark, d).groupBy("orf").agg(F.avg("count").alias("score"))
    ranked = ordered.tidy(ordered.placed(ordered.in_order(means, [], [F.desc("score"), "orf"]), [], "rank"))
    return windows.running_enrichment(ranked, t.associations(spark, d)).select("term", *r6("es"), "n_members")


@query(""", cl AS (SELECT child AS term, parent AS ancestor FROM term_edges UNION SELECT c.term, e.parent FROM cl c JOIN term_edges e ON e.child = c.ancestor) SELECT term, ancestor FROM cl UNION SELECT child, child FROM term_edges UNION SELECT parent, parent FROM term_edges""")
def m16_ancestors(spark, d):
    return genesets.ancestors(t.term_edges(spark, d))


@query(HITS_SQL + """, cl AS (SELECT child AS term, parent AS ancestor FROM term_edges UNION SELECT c.term, e.parent FROM cl c JOIN term_edges e ON e.child = c.ancestor), ca AS (SELECT term, ancestor FROM cl UNION SELECT child, child FROM term_edges UNION SELECT parent, parent FROM term_edges),
 mk AS (SELECT DISTINCT a.orf, c.ancestor AS term, h.orf IS NOT NULL AS hit FROM associations a JOIN ca c ON c.term = a.term LEFT JOIN hits h ON h.orf = a.orf), ow AS (SELECT term, count(*) AS m, count(*) FILTER (hit) AS b FROM mk GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (hit) >= 1),
 un AS (SELECT child, count(*) AS q, count(*) FILTER (hit) AS p FROM (SELECT DISTINCT e.child, mk.orf, mk.hit FROM term_edges e JOIN mk ON mk.term = e.parent) GROUP BY 1), pc AS (SELECT child, count(*) AS n_parents FROM term_edges GROUP BY 1),
 f AS (SELECT ow.term, n_parents, m, q AS total, p AS drawn, b, b - 1 AS kk FROM ow JOIN un ON un.child = ow.term JOIN pc ON pc.child = ow.term), p AS (SELECT *, """ + _hypergeom_sql("kk", "total", "m", "drawn") + " AS pval FROM f), " + BH_SQL
       + "SELECT term, n_parents, m, total AS q, drawn AS p, b, round(pval, 6) + 0 AS pval, round(((b + 1) / (drawn + 1)) / ((m + 1) / (total + 1)), 6) + 0 AS enrichment, round(padj, 6) + 0 AS padj FROM q")
def m16_ontology_enrichment(spark, d):
    found = genesets.ontology_enrichment(_hits(spark, d)[1], t.associations(spark, d), t.term_edges(spark, d), largest=1_000_000)
    return found.select("term", "n_parents", "m", "q", "p", "b", *r6("pval", "enrichment", "padj"))


def _points(spark, d):
    whole = Window.partitionBy("dose")
    return t.abundances(spark, d).withColumn("abundance", F.col("count") / F.max("count").over(whole))


@query("SELECT sgrna, dose::double AS dose, round(count / sum(count) OVER (PARTITION BY dose), 8) + 0 AS fraction FROM abundances WHERE dose IN (0, 0.5)")
def m17_extract_abundance(spark, d):
    a = t.abundances(spark, d).select("sgrna", "count", F.concat(F.lit("d"), F.col("dose").cast("string")).alias("sample"))
    meta = t.abundances(spark, d).select(F.concat(F.lit("d"), F.col("dose").cast("string")).alias("sample"), F.when(F.col("dose") == 0, "DMSO").when(F.col("dose") == 0.5, "drug").otherwise("other").alias("drug"), "dose", F.lit(1).alias("days")).distinct()
    return crispri.extract_abundance(a, meta, "drug", 1).select("sgrna", "dose", (F.round("fraction", 8) + 0.0).alias("fraction"))


@query(""", g AS (SELECT sgrna, avg(count) AS m, coalesce(stddev_samp(count), 0) AS s, coalesce(avg(count) FILTER (dose = 0), 0) AS m0 FROM abundances GROUP BY 1), u AS (SELECT sgrna, m0 * exp(2 * (s + 1e-8) / (m + 1e-8)) AS u FROM g)
 SELECT sgrna, round(u / sum(u) OVER (), 9) + 0 AS uninduced FROM u""")
def m17_no_uninduced(spark, d):
    return crispri.estimated_uninduced(t.abundances(spark, d)).select("sgrna", (F.round("uninduced", 9) + F.lit(0.0)).alias("uninduced"))


@query(""", ab AS (SELECT orf, efficacy AS a, log2(CASE WHEN dose = 0 THEN 0.125 ELSE dose END) AS b, count / max(count) OVER (PARTITION BY dose) AS x FROM abundances), y AS (SELECT orf, a, b, log10((0.01 + 0.99 * tanh(x)) / (1 - (0.01 + 0.99 * tanh(x)))) AS y FROM ab),
 m AS (SELECT orf, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM y GROUP BY 1), s AS (SELECT orf, n, sum((a - ma) * (a - ma)) AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) * (b - mb)) AS bb, sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS "by" FROM y JOIN m USING (orf) GROUP BY 1, 2)
 SELECT orf, n, round((bb * ay - ab * "by") / (aa * bb - ab * ab), 6) + 0 AS coef_efficacy, round((aa * "by" - ab * ay) / (aa * bb - ab * ab), 6) + 0 AS coef_dose FROM s""")
def m18_dose_response_coefficients(spark, d):
    return crispri.dose_response(_points(spark, d)).select("orf", "n", *r6("coef_efficacy", "coef_dose"))


#: Two-sided p of Student's t with whole degrees of freedom v: finite sums over the angle whose tangent is |t| / sqrt(v).
def _t_sql(stat: str, v: str) -> str:
    angle = f"atan(abs({stat}) / sqrt({v}))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(1, ({v} - 1)::bigint // 2 + 1), lambda j: sqrt(pi()) / 2 * exp(lgamma(j) - lgamma(j + 0.5)) * power(cos({angle}), 2 * j - 1))), 0))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, ({v})::bigint // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * power(cos({angle}), 2 * j)))"
    return f"(1 - CASE WHEN ({v})::bigint % 2 = 1 THEN {odd} ELSE {even} END)"


def _erf_sql(x: str) -> str:
    return f"(exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 200), lambda n: CASE WHEN ({x}) = 0 THEN 0 ELSE exp((2 * n + 1) * ln(abs({x})) - lgamma(n + 1.5)) END)))"


@query(f", v AS (SELECT o_orderkey, (o_totalprice % 997) / 150 AS x, o_custkey % 30 + 1 AS v FROM orders) SELECT o_orderkey, round({_t_sql('x', 'v')}, 6) + 0 AS p FROM v")
def s1_t_tail(spark, d):
    o = t.read(spark, d, "orders")
    return o.select("o_orderkey", (F.round(special.t_sf2_column((F.col("o_totalprice") % 997) / 150, (F.col("o_custkey") % 30 + 1).cast("double")), 6) + F.lit(0.0)).alias("p"))


@query(f""", v AS (SELECT o_orderkey, (o_totalprice % 997) / 20 AS x, o_custkey % 12 + 1 AS v FROM orders)
 SELECT o_orderkey, round(CASE WHEN v % 2 = 0 THEN exp(-x / 2) * list_sum(list_transform(range(0, v // 2), lambda j: power(x / 2, j) / gamma(j + 1)))
  ELSE 1 - {_erf_sql('sqrt(x / 2)')} + exp(-x / 2) * coalesce(list_sum(list_transform(range(1, (v - 1) // 2 + 1), lambda j: power(x / 2, j - 0.5) / gamma(j + 0.5))), 0) END, 6) + 0 AS p FROM v""")
def s3_chi2_tail(spark, d):
    o = t.read(spark, d, "orders")
    return o.select("o_orderkey", (F.round(special.chi2_sf_column((F.col("o_totalprice") % 997) / 20, (F.col("o_custkey") % 12 + 1).cast("double")), 6) + F.lit(0.0)).alias("p"))


@query(f", v AS (SELECT o_orderkey, (o_totalprice % 997) / 180 AS x FROM orders) SELECT o_orderkey, round(0.5 * (1 - {_erf_sql('x / sqrt(2)')}), 6) + 0 AS p FROM v")
def s5_normal_tail(spark, d):
    o = t.read(spark, d, "orders")
    return o.select("o_orderkey", (F.round(special.norm_sf_column((F.col("o_totalprice") % 997) / 180), 6) + F.lit(0.0)).alias("p"))


@query(""", ab AS (SELECT orf, efficacy AS a, log2(CASE WHEN dose = 0 THEN 0.125 ELSE dose END) AS b, count / max(count) OVER (PARTITION BY dose) AS x FROM abundances), y AS (SELECT orf, a, b, log10((0.01 + 0.99 * tanh(x)) / (1 - (0.01 + 0.99 * tanh(x)))) AS y FROM ab),
 m AS (SELECT orf, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM y GROUP BY 1), s AS (SELECT orf, n, sum((a - ma) * (a - ma)) AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) * (b - mb)) AS bb, sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS "by", sum((y - my) * (y - my)) AS yy FROM y JOIN m USING (orf) GROUP BY 1, 2),
 c AS (SELECT *, (bb * ay - ab * "by") / (aa * bb - ab * ab) AS ca, (aa * "by" - ab * ay) / (aa * bb - ab * ab) AS cb FROM s), e AS (SELECT *, greatest(yy - ca * ay - cb * "by", 0) / (n - 3) AS v FROM c),
 f AS (SELECT orf, n - 3 AS df, ca / sqrt(v * bb / (aa * bb - ab * ab)) AS ta, cb / sqrt(v * aa / (aa * bb - ab * ab)) AS tb FROM e), p AS (SELECT orf, """ + _t_sql("ta", "df") + " AS p_efficacy, " + _t_sql("tb", "df") + " AS pval FROM f), " + BH_SQL
       + "SELECT orf, round(p_efficacy, 6) + 0 AS p_efficacy, round(pval, 6) + 0 AS p_dose, round(padj, 6) + 0 AS padj FROM q")
def m18_dose_response_pvalues(spark, d):
    return crispri.dose_response(_points(spark, d)).select("orf", *r6("p_efficacy", "p_dose", "padj"))


# Exact distribution of a rank sum: w has the number of ways to choose k of the ranks 1 to i with sum s.
M3_SQL = """, g AS (SELECT orf, position, count, s.condition = 'A' AS x FROM site_gene_a JOIN samples s USING (sample_id) WHERE s.condition IN ('N', 'A')),
 r AS (SELECT *, rank() OVER (PARTITION BY orf ORDER BY count) + (count(*) OVER (PARTITION BY orf, count) - 1) / 2 AS rk, count(*) OVER (PARTITION BY orf, count) AS ties FROM g),
 a AS (SELECT orf, count(DISTINCT position) AS sites, avg(count) FILTER (NOT x) AS mean_ctrl, avg(count) FILTER (x) AS mean_exp, count(*) FILTER (NOT x) AS n1, count(*) FILTER (x) AS n2, sum(rk) FILTER (NOT x) AS r1, sum(ties * ties - 1) AS tie_sum, max(count) AS top FROM r GROUP BY 1),
 u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 12 * (n1 + n2 + 1 - tie_sum / ((n1 + n2) * (n1 + n2 - 1))) AS v FROM a), z AS (SELECT *, (abs(u - n1 * n2 / 2) - 0.5) / sqrt(nullif(v, 0)) AS z FROM u),
 w AS (SELECT 0 AS i, 0 AS k, 0 AS s, 1::hugeint AS c UNION ALL SELECT i + 1, k + b, s + b * (i + 1), sum(c) FROM w, (VALUES (0), (1)) t(b) WHERE i < 60 AND k + b <= 8 GROUP BY ALL),
 e AS (SELECT z.orf, least(1, 2 * sum(c) FILTER (w.s - k * (k + 1) // 2 <= floor(least(u, n1 * n2 - u))) / sum(c)) AS exact FROM z JOIN w ON w.i = n1 + n2 AND w.k = least(n1, n2) WHERE tie_sum = 0 AND least(n1, n2) <= 8 GROUP BY 1),
 p AS (SELECT orf, sites, mean_ctrl, mean_exp, CASE WHEN mean_ctrl > 0 AND mean_exp > 0 THEN log2(mean_exp / mean_ctrl) ELSE log2((mean_exp + 1) / (mean_ctrl + 1)) END AS lfc, u,
  CASE WHEN top = 0 THEN 1 WHEN exact IS NOT NULL THEN exact WHEN z IS NULL OR z <= 0 THEN 1 WHEN z > 9 THEN 0 ELSE 1 - """ + _erf_sql("z / sqrt(2)") + " END AS pval FROM z LEFT JOIN e USING (orf)), " + BH_SQL  # fmt: skip


@query(M3_SQL + "SELECT orf, sites, round(mean_ctrl, 6) + 0 AS mean_ctrl, round(mean_exp, 6) + 0 AS mean_exp, round(lfc, 6) + 0 AS lfc, u, round(pval, 6) + 0 AS pval, round(padj, 6) + 0 AS padj FROM q")
def m3_utest(spark, d):
    found = tests.utest(site_gene(spark, d), _groups(spark, d).select("sample_id", "is_exp"))
    return found.select("orf", "sites", *r6("mean_ctrl", "mean_exp", "lfc"), "u", *r6("pval", "padj"))


@query(None)
def m18_dose_response(spark, d):
    return crispri.significant_interactions(crispri.dose_response(_points(spark, d)))


@query(None)
def m19_local_fdr(spark, d):
    return windows.running_locfdr(crispri.local_fdr(crispri.dose_response(_points(spark, d)))).select("orf", "z", "locfdr", "ebfdr")


@query(", ab AS (SELECT sgrna, orf, dose, count / max(count) OVER (PARTITION BY dose) AS x FROM abundances) SELECT sgrna, round(regr_slope(log10(greatest(x, 1e-8)), log2(CASE WHEN dose = 0 THEN 0.125 ELSE dose END)), 6) + 0 AS slope, count(*) AS n FROM ab WHERE orf = 'o3' GROUP BY 1")
def m23_dose_points(spark, d):
    return crispri.dose_points(_points(spark, d), "o3").select("sgrna", *r6("slope"), "n")


P_SQL = ", m AS (SELECT orf, sum(count) AS s FROM site_gene_a GROUP BY 1), p AS (SELECT orf, (s % 997) / 997 AS pval FROM m)"


def _pvals(spark, d):
    return site_gene(spark, d).groupBy("orf").agg(F.sum("count").alias("s")).select("orf", ((F.col("s") % 997) / 997).alias("pval"))


@query(P_SQL + ", r AS (SELECT pval, count(*) AS c FROM p GROUP BY 1), q AS (SELECT pval, pval * (sum(c) OVER ()) / sum(c) OVER (ORDER BY pval ROWS UNBOUNDED PRECEDING) AS raw FROM r), f AS (SELECT pval, least(min(raw) OVER (ORDER BY pval DESC ROWS UNBOUNDED PRECEDING), 1) AS padj FROM q) SELECT orf, round(pval, 6) + 0 AS pval, round(padj, 6) + 0 AS padj FROM p JOIN f USING (pval)")
def w1_bh_fdr(spark, d):
    return windows.bh_fdr(_pvals(spark, d)).select("orf", *r6("pval", "padj"))


@query(P_SQL + "SELECT orf, round(avg(pval) OVER w, 6) + 0 AS bfdr, round(1 - exp(sum(ln(1 - least(pval, 1 - 1e-12))) OVER w), 6) + 0 AS fwer FROM p WINDOW w AS (ORDER BY pval, orf ROWS UNBOUNDED PRECEDING)")
def w7_bfdr_fwer(spark, d):
    return windows.fwer_bayes(windows.bfdr(_pvals(spark, d), "pval"), "pval").select("orf", *r6("bfdr", "fwer"))


@query(P_SQL + "SELECT orf, round(avg(pval) OVER (ORDER BY pval, orf ROWS UNBOUNDED PRECEDING), 6) + 0 AS ebfdr FROM p")
def w8_running_locfdr(spark, d):
    return windows.running_locfdr(_pvals(spark, d), "pval").select("orf", *r6("ebfdr"))


@query(P_SQL + """, s AS (SELECT pval AS z, count(*) OVER () AS n, row_number() OVER dn AS i, avg(1 - pval) OVER (dn ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS above, row_number() OVER up AS j, avg(pval) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
 FROM p WINDOW dn AS (ORDER BY pval DESC, orf), up AS (ORDER BY pval, orf)) SELECT round(coalesce(arg_min(z, j) FILTER (j >= 2 AND z - below > 0.05 * j / n), 0), 6) + 0 AS lower, round(coalesce(arg_min(z, i) FILTER (i >= 3 AND (1 - z) - above > 0.05 * i / n), 1), 6) + 0 AS upper FROM s""")
def w11_essentiality_thresholds(spark, d):
    return windows.essentiality_thresholds(_pvals(spark, d), "pval").select(*r6("lower", "upper"))


RESULT_SQL = P_SQL + ", res AS (SELECT p.orf, pval AS padj, avg(count) AS mean_of_means, log2((avg(count) + 1) / 6) AS lfc FROM p JOIN site_gene_a USING (orf) GROUP BY 1, 2)"


def _results(spark, d):
    means = site_gene(spark, d).groupBy("orf").agg(F.avg("count").alias("mean_of_means"))
    return _pvals(spark, d).withColumnRenamed("pval", "padj").join(means, "orf").withColumn("lfc", F.log2((F.col("mean_of_means") + 1) / 6))


@query(RESULT_SQL + "SELECT orf FROM res WHERE padj < 0.05 AND round(mean_of_means, 1) >= 6")
def f12_significant_rows(spark, d):
    return filters.significant_rows(_results(spark, d), low_mean=6).select("orf")


@query(RESULT_SQL + "SELECT orf FROM (SELECT * FROM res ORDER BY padj, orf LIMIT 50) WHERE lfc > 0 AND abs(lfc) > 0.1")
def f13_enrichment_filters(spark, d):
    return filters.enrichment_filters(_results(spark, d), topk=50, focus="pos", min_lfc=0.1).select("orf")


@query(RESULT_SQL + ", v AS (SELECT orf, lfc, CASE WHEN padj > 0 THEN -log10(padj) END AS lp, padj FROM res) SELECT orf, round(lfc, 6) + 0 AS lfc, round(coalesce(lp, max(lp) OVER ()), 6) + 0 AS log_p, round(min(CASE WHEN padj <= 0.05 THEN lp END) OVER (), 6) + 0 AS threshold FROM v")
def a23_volcano_points(spark, d):
    return agg.volcano_points(_results(spark, d).withColumn("pval", F.col("padj"))).select("orf", *r6("lfc", "log_p", "threshold"))


@query(", m AS (SELECT orf, condition, avg(count) AS mean FROM site_gene_b JOIN samples USING (sample_id) GROUP BY 1, 2), l AS (SELECT orf, condition, log2((mean + 5) / (avg(mean) OVER (PARTITION BY orf) + 5)) AS lfc FROM m) SELECT orf, round(max(CASE WHEN condition = 'N' THEN lfc END), 6) + 0 AS \"N\", round(max(CASE WHEN condition = 'A' THEN lfc END), 6) + 0 AS \"A\", round(max(CASE WHEN condition = 'R' THEN lfc END), 6) + 0 AS \"R\" FROM l GROUP BY 1")
def a24_lfc_matrix(spark, d):
    lfcs = tests.condition_lfcs(site_gene(spark, d, "B"), t.samples(spark, d))
    return agg.lfc_matrix(lfcs, ["N", "A", "R"]).select("orf", *r6("N", "A", "R"))


@query(", c AS (SELECT g.orf, CASE WHEN c.orf IS NULL THEN 'U' ELSE 'E' END AS call FROM genes g LEFT JOIN (SELECT DISTINCT orf FROM site_gene_a WHERE count > 45) c ON c.orf = g.orf) SELECT call, count(*) AS n FROM c GROUP BY 1")
def a25_call_summary(spark, d):
    from lociq.plans.queries import j11_attach_calls

    return agg.call_summary(j11_attach_calls(spark, d))


@query("SELECT least(count(*), 500) AS n FROM reads WHERE seq <> ''")
def t3_max_reads(spark, d):
    """A reader that stops after so many reads."""
    path = folder(spark, "fastq")
    t.reads(spark, d).filter("seq <> ''").select(F.concat(F.lit("@"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), F.regexp_replace("seq", ".", "I")).alias("value")).write.text(path)
    return readers.read_fastq(spark, path, maxreads=500).agg(F.count("*").alias("n"))


@query("SELECT orf FROM (SELECT orf FROM genes ORDER BY (\"end\" - start) DESC, orf LIMIT 20)")
def t2_top_k(spark, d):
    return t.genes(spark, d).orderBy(F.desc(F.col("end") - F.col("start")), "orf").limit(20).select("orf")


@query("SELECT orf FROM associations WHERE term LIKE '%1' INTERSECT SELECT orf FROM site_gene_a GROUP BY 1 HAVING avg(count) > 8.5")
def set1_intersection(spark, d):
    return t.associations(spark, d).filter("term LIKE '%1'").select("orf").intersect(_hits(spark, d)[1])


@query("SELECT e.child, count(DISTINCT p2.orf) AS n FROM term_edges e JOIN (SELECT p_type AS parent, 'g' || p_partkey AS orf FROM part) p2 ON p2.parent = e.parent GROUP BY 1")
def set2_parent_union(spark, d):
    members = t.read(spark, d, "part").select(F.col("p_type").alias("parent"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("orf"))
    return genesets.parent_unions(members, t.term_edges(spark, d))


@query("SELECT orf FROM genes EXCEPT SELECT orf FROM associations WHERE term LIKE '%1'")
def set3_difference(spark, d):
    return t.genes(spark, d).select("orf").exceptAll(t.associations(spark, d).filter("term LIKE '%1'").select("orf"))


@query("SELECT name, min(gene_order) AS first_seen FROM genes GROUP BY 1")
def set4_ordered_distinct(spark, d):
    return t.genes(spark, d).groupBy("name").agg(F.min("gene_order").alias("first_seen"))


@query("SELECT name, count(*) AS n, min(orf) AS first_orf FROM genes GROUP BY 1")
def set5_invert(spark, d):
    grouped = t.genes(spark, d).groupBy("name").agg(F.array_sort(F.collect_list("orf")).alias("orfs"))
    return grouped.select("name", F.size("orfs").cast("long").alias("n"), F.get("orfs", F.lit(0)).alias("first_orf"))


del SQL, TTR_SQL
