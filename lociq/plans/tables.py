"""The engine's input tables, derived from the supplied star-schema tables by expressions that SQL shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators.joins import by_sample, sample_ids, site_matrix


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sample_id():
    return F.concat("l_returnflag", "l_linestatus", F.lit("_"), (F.col("l_linenumber") % 2).cast("string"))


def raw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads per sample and site, without zeros."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(_sample_id().alias("sample_id"), F.lit("c1").alias("contig"), (F.col("l_orderkey") + 1).alias("position")).agg(F.sum("l_quantity").alias("count"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    each = lines.groupBy(_sample_id().alias("sample_id")).agg(F.max("l_returnflag").alias("condition"), F.max("l_linestatus").alias("status"), F.max((F.col("l_linenumber") % 2).cast("string")).alias("replicate"))
    rank = {"A": 1, "N": 0, "R": 2}
    order = F.when(F.col("condition") == "N", rank["N"]).when(F.col("condition") == "A", rank["A"]).otherwise(rank["R"])
    return each.withColumn("filename", F.concat("sample_id", F.lit(".wig"))).withColumn("condition_order", order)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.lit("c1").alias("contig"), (F.col("o_orderkey") + 1).alias("position")).distinct()


def site_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """(contig, position, counts), a row a site with the counts of all samples, and the samples' ids in the order of counts."""
    ids = sample_ids(samples(spark, sf_dir))
    lines = read(spark, sf_dir, "lineitem").select(_sample_id().alias("sample_id"), F.lit("c1").alias("contig"), (F.col("l_orderkey") + 1).alias("position"), F.col("l_quantity").alias("count"))
    return site_matrix(grid(spark, sf_dir), lines, ids), ids


def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_sample(*site_table(spark, sf_dir)).select("sample_id", "contig", "position", "count")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping genes on both strands over the span of the sites."""
    top = read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    start = (F.col("p_partkey") * 7) % (top + 1) + 1
    return read(spark, sf_dir, "part").select(
        F.lit("c1").alias("contig"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("orf"), F.col("p_brand").alias("name"), F.col("p_name").alias("description"),
        start.alias("start"), (start + 3 * F.col("p_size") + 30).alias("end"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("p_partkey").alias("gene_order"),
    )


def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("orf"), F.col("p_brand").alias("term")).distinct()


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("term")).union(part.select("p_type")).distinct().withColumn("name", F.concat(F.lit("term "), F.col("term")))


def term_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("child"), F.col("p_type").alias("parent")).union(part.select("p_type", F.lit("root"))).distinct()


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as stand-in reads: letters A, C, G and T only, in their order."""
    docs = read(spark, sf_dir, "documents")
    letters = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    return docs.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("read_id"), F.explode(F.array(letters)).alias("seq"))  # a generator: computed once a row


def letters_of(column: str, n: int):
    """n letters that stand for a whole text: the first hexadecimal digits of its digest, as A, C, G and T."""
    return F.translate(F.substring(F.md5(column), 1, n), "0123456789abcdef", "ACGTACGTACGTACGT")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    top = read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return e.select(
        F.concat(F.lit("r"), k.cast("string")).alias("read_id"), (F.when(k % 3 == 0, 83).when(k % 3 == 1, 99).otherwise(16 * (k % 2))).cast("int").alias("flag"), F.lit("c1").alias("contig"),
        ((k * 37) % (top + 1) + 1).alias("pos"), F.when(k % 11 == 0, "5S45M").otherwise("50M").alias("cigar"), (k % 7 + 100).cast("int").alias("tlen"), (F.lit(30) + k % 5).cast("int").alias("seq_len"),
        F.when(k % 13 == 0, "XXXXXXXXXX").otherwise(F.concat(F.lit("AC"), (F.col("user_id") % 4).cast("string"))).alias("barcode"),
    )


def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("sgrna"), (F.col("c_acctbal") / 1000).alias("efficacy"), F.concat(F.lit("o"), F.col("c_nationkey").cast("string")).alias("orf"))


def abundances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sgrna, sample, dose, orf, efficacy, abundance): four doses from order priorities."""
    o = read(spark, sf_dir, "orders")
    dose = F.when(F.substring("o_orderpriority", 1, 1) == "1", 0.0).when(F.substring("o_orderpriority", 1, 1) == "2", 0.25).when(F.substring("o_orderpriority", 1, 1) == "3", 0.5).otherwise(1.0)
    counts = o.groupBy(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("sgrna"), dose.alias("dose")).agg(F.count("*").alias("count"))
    return counts.join(guides(spark, sf_dir), "sgrna")


#: The same tables in SQL.
CTE = """
raw_counts AS (SELECT l_returnflag || l_linestatus || '_' || cast(l_linenumber % 2 AS varchar) AS sample_id, 'c1' AS contig, l_orderkey + 1 AS position, sum(l_quantity) AS count FROM lineitem GROUP BY 1, 2, 3),
samples AS (SELECT l_returnflag || l_linestatus || '_' || cast(l_linenumber % 2 AS varchar) AS sample_id, max(l_returnflag) AS condition, max(l_linestatus) AS status, max(cast(l_linenumber % 2 AS varchar)) AS replicate,
            max(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS condition_order FROM lineitem GROUP BY 1),
grid AS (SELECT DISTINCT 'c1' AS contig, o_orderkey + 1 AS position FROM orders),
site_counts AS (SELECT s.sample_id, g.contig, g.position, coalesce(r.count, 0) AS count FROM grid g CROSS JOIN samples s LEFT JOIN raw_counts r ON r.sample_id = s.sample_id AND r.position = g.position),
top AS (SELECT max(o_orderkey) AS m FROM orders),
genes AS (SELECT 'c1' AS contig, 'g' || p_partkey AS orf, p_brand AS name, p_name AS description, (p_partkey * 7) % (m + 1) + 1 AS start, (p_partkey * 7) % (m + 1) + 1 + 3 * p_size + 30 AS "end",
          CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_partkey AS gene_order FROM part, top),
associations AS (SELECT DISTINCT 'g' || p_partkey AS orf, p_brand AS term FROM part),
terms AS (SELECT term, 'term ' || term AS name FROM (SELECT p_brand AS term FROM part UNION SELECT p_type FROM part)),
term_edges AS (SELECT p_brand AS child, p_type AS parent FROM part UNION SELECT p_type, 'root' FROM part),
reads AS (SELECT 'r' || doc_id AS read_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents),
alignments AS (SELECT 'r' || event_id AS read_id, CASE WHEN event_id % 3 = 0 THEN 83 WHEN event_id % 3 = 1 THEN 99 ELSE 16 * (event_id % 2) END AS flag, 'c1' AS contig, (event_id * 37) % (m + 1) + 1 AS pos,
               CASE WHEN event_id % 11 = 0 THEN '5S45M' ELSE '50M' END AS cigar, event_id % 7 + 100 AS tlen, 30 + event_id % 5 AS seq_len, CASE WHEN event_id % 13 = 0 THEN 'XXXXXXXXXX' ELSE 'AC' || (user_id % 4) END AS barcode FROM events, top),
guides AS (SELECT 's' || c_custkey AS sgrna, c_acctbal / 1000 AS efficacy, 'o' || c_nationkey AS orf FROM customer),
abundances AS (SELECT g.sgrna, dose, count, efficacy, orf FROM (SELECT 's' || o_custkey AS sgrna, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0.0 WHEN '2' THEN 0.25 WHEN '3' THEN 0.5 ELSE 1.0 END AS dose, count(*) AS count FROM orders GROUP BY 1, 2) c JOIN guides g ON g.sgrna = c.sgrna),
site_gene_a AS (SELECT s.*, g.orf FROM site_counts s JOIN genes g ON s.position BETWEEN g.start AND g."end" AND (CASE WHEN strand = '+' THEN s.position <= g."end" - 3 ELSE s.position >= g.start + 3 END)),
site_gene_b AS (SELECT s.*, g.orf FROM site_counts s JOIN genes g ON s.position BETWEEN (CASE WHEN strand = '+' THEN g.start ELSE g.start + 3 END) AND (CASE WHEN strand = '+' THEN g."end" - 3 ELSE g."end" END))
"""
