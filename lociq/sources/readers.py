"""Text formats as DataFrames. Bodies are read and parsed by Spark; only header lines reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(spark: SparkSession, paths) -> DataFrame:
    """Lines of files, or of all files in folders and the folders in them."""
    return spark.read.option("recursiveFileLookup", True).text(paths).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"))


def signature(site_counts: DataFrame) -> DataFrame:
    """One row a sample: number, range and hash of its positions."""
    return site_counts.groupBy("sample_id").agg(F.count("*").alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.sum(F.xxhash64("contig", "position") % 1_000_000_007).alias("h"))


def check_same_sites(site_counts: DataFrame) -> DataFrame:
    if signature(site_counts).select("n", "lo", "hi", "h").distinct().count() > 1:
        raise ValueError("the samples do not have the same sites")
    return site_counts


def read_wig(spark: SparkSession, paths, contig: str = "c1", check: bool = True, sample: str = r"([^/]+)$") -> DataFrame:
    """(sample_id, contig, position, count) of wig tracks. Lines that do not begin with a digit are no data.

    sample: the part of a file's path that names its sample, by default the file name; r"sample_id=([^/]+)/" for a folder a sample.
    """
    cells = F.split(F.trim("value"), r"\s+")
    out = _lines(spark, paths).filter(F.col("value").rlike("^[0-9]")).select(F.regexp_extract("file", sample, 1).alias("sample_id"), F.lit(contig).alias("contig"), cells[0].cast("long").alias("position"), cells[1].cast("double").alias("count"))
    return check_same_sites(out) if check else out


def combined_header(spark: SparkSession, path: str) -> list[str]:
    """Sample names from #File: lines, or from the list wig_fingerprints in the # block."""
    head = [r["value"] for r in _lines(spark, path).filter(F.col("value").startswith("#")).select("value").collect()]
    old = [h.split(":", 1)[1].strip() for h in head if h.startswith("#File:")]
    if old:
        return old
    names, inside = [], False
    for h in head:
        text = h.lstrip("#").strip()
        if text.startswith("wig_fingerprints:"):
            inside = True
            rest = text.split(":", 1)[1].strip()
            if rest.startswith("["):
                return [x.strip().strip("'\"") for x in rest.strip("[]").split(",") if x.strip()]
        elif inside and text.startswith("- "):
            names.append(text[2:].strip().strip("'\""))
        elif inside:
            break
    return names


def read_combined_wig(spark: SparkSession, path: str, contig: str = "c1") -> DataFrame:
    """The long form of a combined matrix; trailing gene columns are not read."""
    names = combined_header(spark, path)
    cells = F.split("value", "\t")
    body = _lines(spark, path).filter(F.col("value").rlike("^[0-9]")).select(cells[0].cast("long").alias("position"), F.slice(cells, 2, len(names)).alias("c"))
    listed = F.array(*[F.lit(n) for n in names])
    long = body.select("position", F.posexplode("c").alias("i", "v"))
    return long.select(F.get(listed, F.col("i")).alias("sample_id"), F.lit(contig).alias("contig"), "position", F.col("v").cast("double").alias("count"))


def read_metadata(spark: SparkSession, path: str, condition: str = "Condition", covars: list[str] | None = None) -> DataFrame:
    """(sample_id, filename, condition, covars, condition_order); headers are matched without regard to case."""
    raw = spark.read.option("sep", "\t").option("comment", "#").option("header", True).csv(path).withColumn("_n", F.monotonically_increasing_id())
    at = {c.lower(): c for c in raw.columns}
    for need in ("id", "filename", condition.lower()):
        if need not in at:
            raise ValueError(f"metadata has no column {need}")
    names = covars if covars is not None else [c for k, c in at.items() if k not in ("id", "filename", "condition", "_n")]
    extra = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(at[c.lower()]).cast("string") for c in names])) if names else F.create_map().cast("map<string,string>")
    out = raw.select(F.col(at["id"]).alias("sample_id"), F.col(at["filename"]).alias("filename"), F.col(at[condition.lower()]).alias("condition"), extra.alias("covars"), "_n")
    first = out.groupBy("condition").agg(F.min("_n").alias("condition_order"))
    return out.drop("_n").join(first, "condition").select("sample_id", "filename", "condition", "covars", "condition_order")


def read_prot_table(spark: SparkSession, path: str, contig: str = "c1") -> DataFrame:
    schema = "description string, start long, end long, strand string, aa_len string, _a string, _b string, name string, orf string, cog string"
    raw = spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)
    return raw.filter("orf IS NOT NULL").select(F.lit(contig).alias("contig"), "orf", "name", "description", "start", "end", "strand")


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows with attributes as a map."""
    schema = "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"
    raw = spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)
    return raw.filter("attributes IS NOT NULL").withColumn("attributes", F.expr("str_to_map(regexp_replace(attributes, ';+$', ''), ';', '=')"))


def gff_is_gff3(spark: SparkSession, path: str) -> bool:
    """Whether all rows have nine columns, numbers where they belong, a strand, a phase, and attribute pairs."""
    cells = F.split("value", "\t")
    rows = _lines(spark, path).filter((F.col("value") != "") & ~F.col("value").startswith("#")).select(cells.alias("c"))
    ok = (F.size("c") == 9) & F.get("c", F.lit(3)).rlike(r"^\d+$") & F.get("c", F.lit(4)).rlike(r"^\d+$") & F.get("c", F.lit(5)).rlike(r"^(\.|-?[\d.eE+-]+)$") & F.get("c", F.lit(6)).isin("+", "-", ".", "?") & F.get("c", F.lit(7)).isin(".", "0", "1", "2") & F.get("c", F.lit(8)).rlike("^(\\.|[^=;]+=[^;]*(;[^=;]+=[^;]*)*;?)$")
    return bool(rows.agg(F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(True))).first()[0])


def read_fasta(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """(contig, seq), a row a record. A record starts at a line break before >: a > within a header is part of it."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).filter("trim(value) <> ''")
    lines = F.split("value", "\r?\n")
    seq = F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x)), "")
    return raw.select(F.split(F.trim(lines[0]), r"\s")[0].alias("contig"), (F.upper(seq) if upper else seq).alias("seq"))


def chunk_genome(genome: DataFrame, size: int = 100_000) -> DataFrame:
    """(contig, chunk_start, seq): chunks that overlap by a base, starts counted from 1."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("seq") - 1, F.lit(1)), F.lit(size))
    return genome.select("contig", "seq", F.explode(starts).alias("_s")).select("contig", F.col("_s").cast("long").alias("chunk_start"), F.expr(f"substring(seq, _s, {size + 1})").alias("seq"))


def read_fastq(spark: SparkSession, path: str, maxreads: int | None = None) -> DataFrame:
    """(read_id, seq). A record starts at a line break before @ whose line after next is a +: qualities that begin with @ are not taken for headers."""
    raw = spark.read.option("lineSep", "\n@").text(path)
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "^@", ""), "\r", ""), "\n")
    out = raw.filter((F.size(lines) >= 3) & F.get(lines, F.lit(2)).startswith("+")).select(lines[0].alias("read_id"), lines[1].alias("seq"))
    return out.limit(maxreads) if maxreads else out


def read_sequences(spark: SparkSession, path: str, maxreads: int | None = None) -> DataFrame:
    """FASTQ or FASTA, told by the first character."""
    first = spark.read.text(path).limit(1).first()
    if first and first["value"].startswith(">"):
        out = read_fasta(spark, path, upper=False).withColumnRenamed("contig", "read_id")
        return out.limit(maxreads) if maxreads else out
    return read_fastq(spark, path, maxreads)


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Alignments, and (contig, length) of the @SQ lines."""
    lines, cells = spark.read.text(path), F.split("value", "\t")
    refs = lines.filter(F.col("value").startswith("@SQ")).select(F.regexp_extract("value", "SN:(\\S+)", 1).alias("contig"), F.regexp_extract("value", "LN:(\\d+)", 1).try_cast("long").alias("length"))
    rows = lines.filter(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        cells[0].alias("read_id"), cells[1].cast("int").alias("flag"), cells[2].alias("contig"), cells[3].cast("long").alias("pos"), cells[5].alias("cigar"), cells[8].cast("int").alias("tlen"), F.length(cells[9]).alias("seq_len"), cells[9].alias("seq"))
    return rows, refs


def result_info(head: list[str]) -> dict[str, str]:
    """What the # lines of a result file say: the kind (first line), and the key: value pairs after it, in a #yaml: block or by themselves."""
    info = {"kind": head[0][1:].strip()} if head and ":" not in head[0] else {}
    for line in head:
        key, colon, value = line.lstrip("#").strip().partition(":")
        if colon and key and value.strip():
            info[key.strip()] = value.strip().strip("'\"")
    return info


def read_result(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """A result table with the columns its last # line names, and what the # lines before it say.

    Cells are strings; with a schema (a DDL string) they are cast where they can be and null where not, and cells of
    array, map and struct columns are read as JSON.
    """
    head = [r["value"] for r in _lines(spark, path).filter(F.col("value").startswith("#")).select("value").collect()]
    names = head[-1].lstrip("#").split("\t")
    cells = F.split("value", "\t", -1)
    body = _lines(spark, path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    out = body.select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])
    if schema is not None:
        for field in T.StructType.fromDDL(schema).fields:
            cell = F.col(f"`{field.name}`")
            nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
            out = out.withColumn(field.name, F.from_json(cell, field.dataType) if nested else F.nullif(cell, F.lit("")).try_cast(field.dataType))
    return out, result_info(head[:-1])


def read_associations(spark: SparkSession, path: str, genes: DataFrame | None = None) -> DataFrame:
    out = spark.read.schema("orf string, term string").option("sep", "\t").option("comment", "#").csv(path).na.drop().distinct()
    return out.join(genes.select("orf"), "orf", "left_semi") if genes is not None else out


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, name string").option("sep", "\t").option("comment", "#").csv(path)


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(child, parent) edges and (term, name) of an ontology's stanzas."""
    stanza = spark.read.option("lineSep", "\n\n").text(path).withColumn("term", F.regexp_extract("value", "(?m)^id: (\\S+)", 1)).filter("term <> ''")
    edges = stanza.select(F.col("term").alias("child"), F.explode(F.regexp_extract_all("value", F.lit("(?m)^is_a: (\\S+)"), F.lit(1))).alias("parent"))
    return edges, stanza.select("term", F.regexp_extract("value", "(?m)^name: (.*)$", 1).alias("name"))


def read_counts(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(sgrna, sample, count) of header-less guide counts; files maps sample to path."""
    out = None
    for sample, path in files.items():
        one = spark.read.schema("sgrna string, count long").option("sep", "\t").option("comment", "#").csv(path).withColumn("sample", F.lit(sample))
        out = one if out is None else out.unionByName(one)
    return out.select("sgrna", "sample", "count")


def read_galign(spark: SparkSession, path: str, reverse: bool = False) -> DataFrame:
    """(pos_a, pos_b) of two strains' aligned positions; -1 is a gap."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.col("value").rlike("^[0-9-]")).select(cells[0].cast("long").alias("x"), cells[1].cast("long").alias("y"))
    a, b = ("y", "x") if reverse else ("x", "y")
    return rows.select(F.col(a).alias("pos_a"), F.col(b).alias("pos_b")).filter("pos_a <> -1")


def read_barcode_fasta(spark: SparkSession, path: str) -> DataFrame:
    return read_fasta(spark, path, upper=False).select(F.col("contig").alias("read_id"), F.col("seq").alias("barcode"))
