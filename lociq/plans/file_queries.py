"""Registered queries of the sources and sinks: each format is written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociq.operators import reads as rd
from lociq.plans import tables as t
from lociq.plans.queries import query
from lociq.plans.read_queries import TEMPLATES_SQL
from lociq.scratch import folder as _folder
from lociq.sources import readers, writers


def _written(df, name: str) -> str:
    """df (value) as lines of text files in a new folder."""
    path = _folder(df.sparkSession, name)
    df.write.text(path)
    return path


def _table(df, name: str, header: bool = False) -> str:
    path = _folder(df.sparkSession, name)
    df.write.option("sep", "\t").option("header", header).csv(path)
    return path


def _ids(spark, d) -> list[str]:
    return sorted(r["sample_id"] for r in t.samples(spark, d).select("sample_id").collect())  # metadata


@query("SELECT sample_id, contig, position, count FROM site_counts")
def src1_read_wig(spark, d):
    """Tracks written by export_normalized (whole counts), read as wig with the folder as the sample."""
    path = _folder(spark, "wig")
    writers.export_normalized(t.site_counts(spark, d), path, "nonorm", whole=True)
    return readers.read_wig(spark, path, sample=r"sample_id=([^/]+)/")


@query("SELECT sample_id, contig, position, count FROM site_counts")
def src2_read_combined_wig(spark, d):
    """The matrix of export_combined_wig, read back into long form."""
    path = _folder(spark, "combined")
    writers.export_combined_wig(t.site_counts(spark, d), t.genes(spark, d), _ids(spark, d), path, "nonorm")
    return readers.read_combined_wig(spark, [f"{path}/header", f"{path}/matrix"])


@query("SELECT g.position, count(ge.orf) AS n_genes, coalesce(string_agg(ge.orf || ',' || ge.name, ' ' ORDER BY ge.orf || ',' || ge.name), '') AS genes FROM grid g LEFT JOIN genes ge ON g.position BETWEEN ge.start AND ge.\"end\" GROUP BY 1")
def snk2_export_combined_wig(spark, d):
    """The genes over each site in the rows of the combined matrix."""
    path, ids = _folder(spark, "combined"), _ids(spark, d)
    writers.export_combined_wig(t.site_counts(spark, d), t.genes(spark, d), ids, path, "nonorm")
    cells = F.split("value", "\t")
    genes = F.filter(F.slice(cells, len(ids) + 2, 1_000_000), lambda x: x != "")
    return spark.read.text(f"{path}/matrix").select(cells[0].cast("long").alias("position"), F.size(genes).cast("long").alias("n_genes"), F.array_join(genes, " ").alias("genes"))


@query("SELECT sample_id, sample_id || '.wig' AS filename, condition, status AS batch, CASE condition WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS order_of_condition FROM samples")
def src4_read_metadata(spark, d):
    path = _table(t.samples(spark, d).select(F.col("sample_id").alias("Id"), F.col("condition").alias("CONDITION"), F.col("filename").alias("Filename"), F.col("status").alias("Batch")).coalesce(1).sort("Id"), "metadata", header=True)
    found = readers.read_metadata(spark, path)
    order = F.dense_rank().over(rd.Window.orderBy("condition_order")).cast("long")  # a row a sample
    return found.select("sample_id", "filename", "condition", F.col("covars").getItem("Batch").alias("batch"), order.cast("int").alias("order_of_condition"))


def _prot_rows(genes):
    return genes.select(F.col("description"), "start", "end", "strand", F.floor((F.col("end") - F.col("start") + 1) / 3).alias("aa"), F.lit("-").alias("a"), F.lit("-").alias("b"), "name", "orf", F.lit("-").alias("cog"))


@query("SELECT contig, orf, name, description, start, \"end\", strand FROM genes")
def src5_read_prot_table(spark, d):
    return readers.read_prot_table(spark, _table(_prot_rows(t.genes(spark, d)), "prot"))


def _gff(spark, d):
    attributes = F.concat(F.lit("locus_tag="), "orf", F.lit(";gene="), "name", F.lit(";product="), F.regexp_replace("description", "[;=]", " "))
    return _table(t.genes(spark, d).select("contig", F.lit("made"), F.when(F.col("gene_order") % 5 == 0, "gene").otherwise("CDS"), "start", "end", F.lit("."), "strand", F.lit("0"), attributes), "gff")


@query("SELECT 'g' || p_partkey AS orf, CASE WHEN p_partkey % 5 = 0 THEN 'gene' ELSE 'CDS' END AS type, start, \"end\", genes.name FROM genes JOIN part ON 'g' || p_partkey = orf")
def src6_read_gff3(spark, d):
    found = readers.read_gff3(spark, _gff(spark, d))
    return found.select(F.col("attributes").getItem("locus_tag").alias("orf"), "type", "start", "end", F.col("attributes").getItem("gene").alias("name"))


@query("SELECT count(*) > 0 AS gff, false AS prot FROM genes")
def src7_gff_check(spark, d):
    """The format check on a GFF and on a table that is none."""
    gff, prot = readers.gff_is_gff3(spark, _gff(spark, d)), readers.gff_is_gff3(spark, _table(_prot_rows(t.genes(spark, d)), "prot"))
    return t.genes(spark, d).agg((F.count("*") > 0).alias("some")).select((F.col("some") & F.lit(gff)).alias("gff"), F.lit(prot).alias("prot"))


@query("SELECT regexp_replace(description, '[;=]', ' ', 'g') AS description, start, \"end\", strand, (\"end\" - start + 1) // 3 AS aa_len, name, orf FROM genes WHERE gene_order % 5 <> 0")
def snk6_gff_to_prot_table(spark, d):
    made = writers.gff_to_prot_table(readers.read_gff3(spark, _gff(spark, d)))
    back = spark.read.schema("description string, start long, `end` long, strand string, aa_len long, a string, b string, name string, orf string, cog string").option("sep", "\t").csv(_table(made, "prot"))
    return back.select("description", "start", "end", "strand", "aa_len", "name", "orf")


@query("SELECT read_id AS contig, seq FROM reads")
def src8_read_fasta(spark, d):
    return readers.read_fasta(spark, _written(t.reads(spark, d).select(F.concat(F.lit(">"), "read_id", F.lit(" note\n"), F.lower("seq")).alias("value")), "fasta"))


@query("SELECT read_id, seq FROM reads WHERE seq <> ''")
def src9_read_fastq(spark, d):
    """Qualities that begin with @, so that they look like headers."""
    kept = t.reads(spark, d).filter("seq <> ''")
    return readers.read_fastq(spark, _written(kept.select(F.concat(F.lit("@"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n@"), F.expr("repeat('I', length(seq) - 1)")).alias("value")), "fastq"))


@query("SELECT read_id, flag, contig, pos, cigar, tlen, seq_len FROM alignments")
def src10_read_sam(spark, d):
    a = t.alignments(spark, d)
    line = F.concat_ws("\t", "read_id", "flag", "contig", "pos", F.lit("60"), "cigar", F.lit("*"), F.lit("0"), "tlen", F.expr("repeat('A', seq_len)"), F.expr("repeat('I', seq_len)"))
    rows, _ = readers.read_sam(spark, _written(a.select(line.alias("value")), "sam"))
    return rows.drop("seq")


@query("SELECT orf, name, start, start / 3.0 AS score, length(description) AS size, 'demo' AS kind, '0.05' AS q FROM genes")
def src11_result_round_trip(spark, d):
    """write_result and read_result: plain cells, nested cells as JSON, and what the head says."""
    path = _folder(spark, "result")
    made = t.genes(spark, d).select("orf", "name", "start", (F.col("start") / 3.0).alias("score"), F.array(F.length("description")).alias("sizes"))
    writers.write_result(made, "demo", {"q": 0.05, "conditions": ["N", "A"]}, path)
    rows, info = readers.read_result(spark, path, "start long, score double, sizes array<long>")
    return rows.select("orf", "name", "start", "score", F.get("sizes", F.lit(0)).alias("size"), F.lit(info["kind"]).alias("kind"), F.lit(info["q"]).alias("q"))


@query("SELECT orf, a.term, n.name FROM associations a JOIN terms n USING (term)")
def src12_read_associations(spark, d):
    pairs = readers.read_associations(spark, _table(t.associations(spark, d), "associations"))
    return pairs.join(readers.read_terms(spark, _table(t.terms(spark, d), "terms")), "term").select("orf", "term", "name")


@query("SELECT replace(child, ' ', '_') AS child, replace(parent, ' ', '_') AS parent FROM term_edges")
def src13_read_obo(spark, d):
    name = lambda c: F.regexp_replace(c, " ", "_")
    stanza = t.term_edges(spark, d).groupBy(name("child").alias("id")).agg(F.array_sort(F.collect_list(F.concat(F.lit("is_a: "), name("parent"), F.lit(" ! note")))).alias("up"))
    edges, _ = readers.read_obo(spark, _written(stanza.select(F.concat(F.lit("[Term]\nid: "), "id", F.lit("\nname: "), "id", F.lit("\n"), F.array_join("up", "\n"), F.lit("\n")).alias("value")), "obo"))
    return edges


@query("SELECT sgrna, 'd' || (dose * 100)::int AS sample, count FROM abundances")
def src14_read_counts(spark, d):
    """A header-less file of guide counts for each dose."""
    a = t.abundances(spark, d).withColumn("sample", F.concat(F.lit("d"), (F.col("dose") * 100).cast("int").cast("string")))
    files = {f"d{x}": _table(a.filter(F.col("sample") == f"d{x}").select("sgrna", "count"), f"counts{x}") for x in (0, 25, 50, 100)}
    return readers.read_counts(spark, files)


@query("SELECT position AS pos_a, CASE WHEN position % 10 = 0 THEN -1 ELSE position + 5 END AS pos_b FROM grid WHERE position % 7 <> 0")
def src15_read_galign(spark, d):
    x = F.col("position")
    made = t.grid(spark, d).select(F.concat_ws(" ", F.when(x % 7 == 0, -1).otherwise(x), F.when(x % 10 == 0, -1).otherwise(x + 5)).alias("value"))
    return readers.read_galign(spark, _written(made, "galign"))


@query("SELECT read_id, translate(substr(md5(seq), 1, 20), '0123456789abcdef', 'ACGTACGTACGTACGT') AS barcode FROM reads WHERE seq <> ''")
def src16_read_barcode_fasta(spark, d):
    kept = t.reads(spark, d).filter("seq <> ''").select(F.concat(F.lit(">"), "read_id", F.lit("\n"), t.letters_of("seq", 20)).alias("value"))
    return readers.read_barcode_fasta(spark, _written(kept, "barcodes"))


@query("SELECT position AS \"Start\", position + 1 AS \"End\", 'TA' || position AS \"Feature\", max(count) FILTER (sample_id = 'NO_0') AS \"NO_0\", max(count) FILTER (sample_id = 'AF_0') AS \"AF_0\" FROM site_counts WHERE sample_id IN ('NO_0', 'AF_0') GROUP BY position")
def snk3_export_igv(spark, d):
    path = _folder(spark, "igv")
    writers.export_igv(t.site_counts(spark, d), ["NO_0", "AF_0"], "c1", path, "nonorm")
    back = spark.read.option("sep", "\t").option("header", True).csv(path)
    return back.select(F.col("Start").cast("long"), F.col("End").cast("long"), "Feature", F.col("NO_0").cast("double"), F.col("AF_0").cast("double"))


@query("SELECT sample_id, position, round(count * f.factor, 1) AS count FROM site_counts JOIN (SELECT sample_id, 64 / avg(count) AS factor FROM site_counts GROUP BY 1) f USING (sample_id)")
def snk4_export_normalized(spark, d):
    """Normalised tracks with a decimal, read back; counts and factors are scaled so that few halves are to be rounded."""
    from lociq.operators import normalise

    path, scaled = _folder(spark, "normalised"), normalise.normalize(t.site_counts(spark, d), "target", target=64.0)
    writers.export_normalized(scaled, path, "nonorm")
    back = readers.read_wig(spark, path, sample=r"sample_id=([^/]+)/")
    return back.select("sample_id", "position", "count")


@query(TEMPLATES_SQL + "SELECT position, fwd_rd_ct, fwd_templ_ct, rev_rd_ct, rev_templ_ct, tot_rd_ct, tot_templ_ct, tot_templ_ct AS wig FROM tc")
def snk5_export_counts(spark, d):
    """Both files of the template counts of every site, read back."""
    path = _folder(spark, "templates")
    writers.export_counts_wig(rd.template_counts(t.alignments(spark, d), t.grid(spark, d)), path)
    names = ["position", "fwd_rd_ct", "fwd_templ_ct", "rev_rd_ct", "rev_templ_ct", "tot_rd_ct", "tot_templ_ct"]
    counts = spark.read.option("sep", "\t").option("header", True).csv(f"{path}/counts").select(*[F.col(c).cast("long").alias(c) for c in names])
    wig = readers.read_wig(spark, f"{path}/wig", sample=r"contig=([^/]+)/").select("position", F.col("count").cast("long").alias("wig"))
    return counts.join(wig, "position")
