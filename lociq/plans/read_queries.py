"""Registered queries of the read-level operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociq.operators import reads as rd
from lociq.plans import tables as t
from lociq.plans.queries import query, r6


@query("SELECT read_id, instr(seq, 'ACCA') - 1 AS hit, CASE WHEN length(seq) >= 30 THEN substr(seq, 5, 26) END AS part FROM reads")
def rd1_find_exact(spark, d):
    return t.reads(spark, d).select("read_id", rd.find_with_mismatches(F.col("seq"), "ACCA").cast("long").alias("hit"), F.when(F.length("seq") >= 30, F.substring("seq", 5, 26)).alias("part"))


@query(""", p AS (SELECT read_id, seq, unnest(range(0, greatest(length(seq) - 7, 1))) AS i FROM reads WHERE length(seq) >= 8),
 m AS (SELECT read_id, seq, i, (SELECT count(*) FROM range(1, 9) r(k) WHERE substr(substr(seq, i + 1, 8), k::int, 1) <> substr('ACCATTAC', k::int, 1)) AS mm FROM p),
 h AS (SELECT read_id, min(i) AS i FROM m WHERE mm <= 1 GROUP BY 1)
 SELECT r.read_id, CASE WHEN instr(seq, 'ACCATTAC') > 0 THEN instr(seq, 'ACCATTAC') - 1 ELSE coalesce(h.i, -1) END AS hit FROM reads r LEFT JOIN h ON h.read_id = r.read_id""")
def rd1_find_with_mismatches(spark, d):
    return t.reads(spark, d).select("read_id", rd.find_with_mismatches(F.col("seq"), "ACCATTAC", 1).cast("long").alias("hit"))


@query("""SELECT read_id, CASE WHEN a BETWEEN 1 AND 41 THEN CASE WHEN instr(rest, 'TTT') > 0 THEN substr(rest, 1, instr(rest, 'TTT') - 1) ELSE rest END END AS insert,
 coalesce(a BETWEEN 1 AND 41 AND length(CASE WHEN instr(rest, 'TTT') > 0 THEN substr(rest, 1, instr(rest, 'TTT') - 1) ELSE rest END) >= 20, false) AS kept FROM (SELECT read_id, instr(seq, 'TTA') AS a, substr(seq, instr(seq, 'TTA') + 3) AS rest FROM reads)""")
def rd2_trim_prefix(spark, d):
    return rd.trim_transposon_prefix(t.reads(spark, d), "TTA", 0, 40, 0, 20, "TTT").select("read_id", "insert", "kept")


@query("""SELECT read_id, CASE WHEN b BETWEEN 5 AND 15 THEN substr(tail, 1, b) ELSE 'XXXXXXXXXX' END AS barcode, CASE WHEN instr(gen, 'GAA') > 0 THEN substr(gen, 1, instr(gen, 'GAA') - 1) ELSE gen END AS genomic
 FROM (SELECT *, CASE WHEN b >= 0 THEN substr(tail, b + 4) ELSE '' END AS gen FROM (SELECT *, instr(tail, 'TTC') - 1 AS b FROM (SELECT read_id, CASE WHEN instr(seq, 'ACT') > 0 THEN substr(seq, instr(seq, 'ACT') + 3) ELSE '' END AS tail FROM reads)))""")
def rd3_template_barcodes(spark, d):
    return rd.extract_template_barcodes(t.reads(spark, d), "ACT", "TTC", "GAA", 0).select("read_id", "barcode", "genomic")


def _near_sql(text: str, pattern: str) -> str:
    """The first place with one mismatch at most, an exact one before all others, as SQL."""
    misses = " + ".join(f"({text}[i + {k + 1}] <> '{c}')::int" for k, c in enumerate(pattern))
    return f"CASE WHEN instr({text}, '{pattern}') > 0 THEN instr({text}, '{pattern}') - 1 ELSE coalesce(list_filter(range(0, length({text}) - {len(pattern) - 1}), lambda i: {misses} <= 1)[1], -1) END"


@query(f""", a AS (SELECT read_id, seq, {_near_sql('seq', 'TTACAT')} AS a FROM reads), b AS (SELECT read_id, CASE WHEN a BETWEEN 0 AND 40 THEN substr(seq, a + 7) END AS rest FROM a),
 c AS (SELECT read_id, rest, {_near_sql("coalesce(rest, '')", 'GATTCA')} AS cut FROM b), d AS (SELECT read_id, CASE WHEN cut >= 0 THEN substr(rest, 1, cut) ELSE rest END AS insert FROM c) SELECT read_id, insert, coalesce(length(insert) >= 20, false) AS kept FROM d""")
def rd2_trim_prefix_mme1(spark, d):
    return rd.trim_transposon_prefix(t.reads(spark, d), "TTACAT", 0, 40, 1, 20, "GATTCA").select("read_id", "insert", "kept")


@query(f""", a AS (SELECT read_id, seq, {_near_sql('seq', 'ACTAC')} AS a FROM reads), b AS (SELECT read_id, CASE WHEN a >= 0 THEN substr(seq, a + 6) ELSE '' END AS tail FROM a), c AS (SELECT *, {_near_sql('tail', 'TTCAG')} AS b FROM b),
 e AS (SELECT *, CASE WHEN b >= 0 THEN substr(tail, b + 6) ELSE '' END AS gen FROM c), f AS (SELECT *, {_near_sql('gen', 'GAAGA')} AS c FROM e)
 SELECT read_id, CASE WHEN b BETWEEN 5 AND 15 THEN substr(tail, 1, b) ELSE 'XXXXXXXXXX' END AS barcode, CASE WHEN c >= 0 THEN substr(gen, 1, c) ELSE gen END AS genomic FROM f""")
def rd3_template_barcodes_mme1(spark, d):
    return rd.extract_template_barcodes(t.reads(spark, d), "ACTAC", "TTCAG", "GAAGA", 1).select("read_id", "barcode", "genomic")


@query("""SELECT read_id, CASE WHEN a > 0 AND instr(tail, 'TTA') - 1 BETWEEN 5 AND 25 THEN substr(tail, 1, instr(tail, 'TTA') - 1) ELSE 'XXXXXXXXXX' END AS barcode FROM (SELECT read_id, instr(seq, 'CAT') AS a, substr(seq, instr(seq, 'CAT') + 3) AS tail FROM reads)""")
def rd4_barseq(spark, d):
    return rd.extract_between(t.reads(spark, d), "CAT", "TTA", 5, 25).select("read_id", "barcode")


@query("SELECT read_id, length(seq) AS n FROM reads WHERE read_id IN (SELECT read_id FROM reads WHERE instr(seq, 'TTA') BETWEEN 1 AND 20)")
def rd5_select_mates(spark, d):
    kept = t.reads(spark, d).filter(F.instr("seq", "TTA").between(1, 20))
    mates = t.reads(spark, d).withColumn("read_id", F.concat("read_id", F.lit("/2")))
    return rd.select_mates(mates, kept).select(rd.mate_id().alias("read_id"), F.length("seq").cast("long").alias("n"))


@query("SELECT read_id, translate(substr(md5(seq), 1, 8), '0123456789abcdef', 'ACGTACGTACGTACGT') AS barcode FROM reads WHERE length(seq) > 12")
def rd6_attach_barcodes(spark, d):
    codes = t.reads(spark, d).filter(F.length("seq") > 12).select(F.concat("read_id", F.lit("/2")).alias("read_id"), t.letters_of("seq", 8).alias("barcode"))
    return rd.attach_barcodes(t.reads(spark, d).select("read_id"), codes)


@query("SELECT read_id, substr(seq, 4, 17) AS seq FROM reads")
def rd8_select_cycles(spark, d):
    return rd.select_cycles(t.reads(spark, d), 4, 20)


SITES_SQL = ", sites AS (SELECT position FROM grid)"


@query(SITES_SQL + """, c AS (SELECT CASE WHEN flag = 0 THEN pos - 2 ELSE pos + seq_len END AS position, sum((flag = 0)::int) AS fwd, sum((flag = 16)::int) AS rev FROM alignments WHERE flag IN (0, 16) GROUP BY 1)
 SELECT s.position, coalesce(fwd, 0)::bigint AS fwd, coalesce(rev, 0)::bigint AS rev, coalesce(fwd + rev, 0)::bigint AS total FROM sites s LEFT JOIN c USING (position)""")
def rd9_read_counts(spark, d):
    return rd.read_counts(t.alignments(spark, d), t.grid(spark, d)).drop("contig")


@query(SITES_SQL + """, e AS (SELECT unnest([pos + (CASE WHEN flag = 0 THEN seq_len ELSE 1 END) - 2, pos + (CASE WHEN flag = 0 THEN seq_len ELSE 1 END) - 1]) AS position, flag FROM alignments WHERE flag IN (0, 16)),
 c AS (SELECT position, sum((flag = 0)::int) AS fwd, sum((flag = 16)::int) AS rev FROM e GROUP BY 1) SELECT s.position, coalesce(fwd, 0)::bigint AS fwd, coalesce(rev, 0)::bigint AS rev, coalesce(fwd + rev, 0)::bigint AS total FROM sites s LEFT JOIN c USING (position)""")
def rd9_read_counts_mme1(spark, d):
    return rd.read_counts(t.alignments(spark, d), t.grid(spark, d), "mme1").drop("contig")


TEMPLATES_SQL = SITES_SQL + """, k AS (SELECT *, CASE WHEN flag & 16 <> 0 THEN 'R' ELSE 'F' END AS strand, CASE WHEN flag & 16 <> 0 THEN pos + seq_len ELSE pos - 2 END AS position FROM alignments WHERE flag & 64 <> 0 AND flag & 2 <> 0 AND cigar NOT LIKE '%S%' AND barcode <> 'XXXXXXXXXX'),
 c AS (SELECT position, count(*) FILTER (strand = 'F') AS fr, count(DISTINCT tlen || '/' || barcode) FILTER (strand = 'F') AS ft, count(*) FILTER (strand = 'R') AS rr, count(DISTINCT tlen || '/' || barcode) FILTER (strand = 'R') AS rt FROM k GROUP BY 1),
 tc AS (SELECT s.position, coalesce(fr, 0) AS fwd_rd_ct, coalesce(ft, 0) AS fwd_templ_ct, coalesce(rr, 0) AS rev_rd_ct, coalesce(rt, 0) AS rev_templ_ct, coalesce(fr + rr, 0) AS tot_rd_ct, coalesce(ft + rt, 0) AS tot_templ_ct FROM sites s LEFT JOIN c USING (position)) """


@query(TEMPLATES_SQL + "SELECT * FROM tc")
def rd10_template_counts(spark, d):
    return rd.template_counts(t.alignments(spark, d), t.grid(spark, d)).drop("contig")


@query("SELECT read_id AS contig, i AS position FROM (SELECT read_id, seq, unnest(range(1, length(seq))) AS i FROM reads) WHERE substr(seq, i, 2) = 'TA'")
def rd11_ta_sites(spark, d):
    return rd.ta_sites(t.reads(spark, d).select(F.col("read_id").alias("contig"), F.lit(1).cast("long").alias("chunk_start"), "seq"))


@query(TEMPLATES_SQL + """SELECT sum(tot_rd_ct)::bigint AS read_count, sum(tot_templ_ct)::bigint AS template_count, count(*) AS sites, count(*) FILTER (tot_templ_ct > 0) AS sites_hit, max(tot_templ_ct) AS max_count,
 round(avg(tot_templ_ct) FILTER (tot_templ_ct > 0), 6) + 0 AS nz_mean, round(corr(fwd_templ_ct, rev_templ_ct), 6) + 0 AS fr_corr, round(corr(tot_rd_ct, tot_templ_ct), 6) + 0 AS rt_corr, (SELECT count(*) FROM reads) AS total_reads FROM tc""")
def rd12_preprocess_stats(spark, d):
    return _preprocess_stats(spark, d, t.grid(spark, d))


def _preprocess_stats(spark, d, sites):
    counts = rd.template_counts(t.alignments(spark, d), sites)
    trimmed = rd.trim_transposon_prefix(t.reads(spark, d), "TTA", 0, 40, 0)
    return rd.preprocess_stats(counts, trimmed).select("read_count", "template_count", "sites", "sites_hit", "max_count", *r6("nz_mean", "fr_corr", "rt_corr"), "total_reads")


@query(""", e AS (SELECT CASE WHEN flag & 16 <> 0 THEN -pos ELSE pos END AS site, barcode, count(*) AS n FROM alignments GROUP BY 1, 2), h AS (SELECT barcode, count(*) = 1 AS one FROM e GROUP BY 1)
 SELECT site, e.barcode, n, one AND e.barcode NOT LIKE '%X%' AS good, cast(row_number() OVER (PARTITION BY site ORDER BY n DESC, e.barcode DESC) AS int) AS popularity FROM e JOIN h USING (barcode)""")
def rd13_barseq_catalog(spark, d):
    placed = t.alignments(spark, d).select(F.when(F.col("flag").bitwiseAND(16) != 0, -F.col("pos")).otherwise(F.col("pos")).alias("site"), "barcode")
    return rd.barseq_catalog(placed)


@query("SELECT count(*) AS sites, count(*) FILTER (count > 1) AS sites_hit, round(avg((count > 1)::int), 6) + 0 AS density, round(avg(count) FILTER (count > 1), 6) + 0 AS mean_hit, (SELECT sum(c) FROM (SELECT count AS c FROM site_counts ORDER BY 1 DESC LIMIT 5)) AS top5 FROM site_counts")
def rd14_dataset_stats(spark, d):
    found = rd.dataset_stats(t.site_counts(spark, d))
    return found.select("sites", "sites_hit", *r6("density", "mean_hit"), F.aggregate("top5", F.lit(0.0), lambda a, x: a + x).alias("top5"))


@query(""", b AS (SELECT 'u' || (p_partkey % 64) AS sgrna, p_partkey % 64 AS k FROM part GROUP BY ALL), g AS (SELECT sgrna, substr('ACGT', (k % 4 + 1)::int, 1) || substr('ACGT', (k // 4 % 4 + 1)::int, 1) || substr('ACGT', (k // 16 % 4 + 1)::int, 1) AS three FROM b),
 s AS (SELECT translate(substr(md5(seq), 1, 3), '0123456789abcdef', 'ACGTACGTACGTACGT') AS rc, count(*) AS n FROM reads GROUP BY 1) SELECT g.sgrna, coalesce(n, 0) AS count FROM g LEFT JOIN s ON s.rc = reverse(translate(g.three, 'ACGT', 'TGCA'))""")
def rd15_barcode_counts(spark, d):
    k = F.col("k")
    letter = lambda x: F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))
    guides = t.read(spark, d, "part").select((F.col("p_partkey") % 64).alias("k")).distinct().select(F.concat(F.lit("u"), k.cast("string")).alias("sgrna"), F.concat(letter(k), letter(F.floor(k / 4)), letter(F.floor(k / 16))).alias("three"))
    guides = guides.select("sgrna", F.concat("three", "three", "three", "three").alias("barcode"))  # twelve bases
    three = t.letters_of("seq", 3)  # each read's barcode, from its whole text
    made = t.reads(spark, d).select(F.concat(F.lit(rd.GUIDE_BEFORE), three, three, three, three, F.lit(rd.GUIDE_AFTER)).alias("seq"))
    return rd.barcode_counts(made, guides)


@query("SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM reads")
def rd16_reverse_complement(spark, d):
    return t.reads(spark, d).select("read_id", rd.reverse_complement(F.col("seq")).alias("seq"))
