from lociq.operators import reads as rd
from lociq.sources import readers as r
from lociq.sources import writers as w
from lociq.streaming import counts as streaming
from pyspark.sql import functions as F


def write(path, text):
    path.write_text(text)
    return str(path)


def test_wig_and_combined(spark, tmp_path):
    a = write(tmp_path / "a.wig", "#note\nvariableStep chrom=x\n10 0\n20 5\n30\t7\n")
    b = write(tmp_path / "b.wig", "variableStep chrom=x\n10 1\n20 0\n30 2\n")
    counts = r.read_wig(spark, [a, b])
    assert sorted((x.sample_id, x.position, x["count"]) for x in counts.collect())[1] == ("a.wig", 20, 5.0)
    c = write(tmp_path / "c.wig", "10 1\n21 0\n30 2\n")
    try:
        r.read_wig(spark, [a, c])
        raise AssertionError("different sites were accepted")
    except ValueError:
        pass
    genes = spark.createDataFrame([("c1", "g1", "n1", "", 5, 25, "+"), ("c1", "g2", "n2", "", 15, 40, "-")], "contig string, orf string, name string, description string, start long, end long, strand string")
    w.export_combined_wig(counts, genes, ["a.wig", "b.wig"], str(tmp_path / "out"), "nonorm")
    header, body = (sorted((tmp_path / "out" / n).glob("part-*.txt")) for n in ("header", "matrix"))
    joined = write(tmp_path / "all.txt", "".join(x.read_text() for x in header + body))
    assert r.combined_header(spark, joined) == ["a.wig", "b.wig"]
    again = r.read_combined_wig(spark, joined)
    assert again.exceptAll(counts.select(*again.columns)).isEmpty() and again.count() == 6
    assert "g1,n1\tg2,n2" in (tmp_path / "all.txt").read_text()
    yaml = write(tmp_path / "new.txt", "#CombinedWig\n#yaml:\n#  wig_fingerprints:\n#  - s1\n#  - s2\n#pos\n10\t1\t2\n")
    assert r.combined_header(spark, yaml) == ["s1", "s2"]


def test_metadata_and_annotation(spark, tmp_path):
    meta = write(tmp_path / "m.tsv", "Id\tCONDITION\tFilename\tBatch\ns1\tX\ta.wig\tb1\ns2\tY\tb.wig\tb2\ns3\tX\tc.wig\tb1\n")
    rows = {x.sample_id: x for x in r.read_metadata(spark, meta).collect()}
    assert rows["s1"].covars == {"Batch": "b1"} and rows["s3"].condition_order == rows["s1"].condition_order < rows["s2"].condition_order
    prot = write(tmp_path / "p.prot_table", "#c\nprotein A\t1\t1524\t+\t507\t-\t-\tdnaA\tRv0001\tC\n")
    assert r.read_prot_table(spark, prot).first()["orf"] == "Rv0001"
    gff = write(tmp_path / "g.gff", "##gff-version 3\nc1\ts\tCDS\t10\t39\t.\t+\t0\tlocus_tag=L1;gene=abc;product=kinase\nc1\ts\tgene\t10\t39\t.\t+\t.\tID=x\n")
    assert r.gff_is_gff3(spark, gff)
    assert not r.gff_is_gff3(spark, prot)
    row = w.gff_to_prot_table(r.read_gff3(spark, gff)).first()
    assert (row["orf"], row["name"], row["aa_len"], row["description"]) == ("L1", "abc", 10, "kinase")


def test_sequences(spark, tmp_path):
    fa = write(tmp_path / "g.fa", ">c1 note > inside\nacta\nTTaa\n>c2\nTATA\n")
    genome = r.read_fasta(spark, fa)
    assert {x.contig: x.seq for x in genome.collect()} == {"c1": "ACTATTAA", "c2": "TATA"}
    for size in (3, 100):
        sites = rd.ta_sites(r.chunk_genome(genome, size)).collect()
        assert sorted((x.contig, x.position) for x in sites) == [("c1", 3), ("c1", 6), ("c2", 1), ("c2", 3)]
    fq = write(tmp_path / "r.fastq", "@r1 x\nACGT\n+\n@III\n@r2\nTTTT\n+r2\nIIII\n")
    assert [(x.read_id, x.seq) for x in r.read_sequences(spark, fq).collect()] == [("r1 x", "ACGT"), ("r2", "TTTT")]
    assert r.read_fastq(spark, fq, maxreads=1).count() == 1
    sam = write(tmp_path / "a.sam", "@HD\tVN:1\n@SQ\tSN:c1\tLN:99\nr1\t16\tc1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\n")
    rows, refs = r.read_sam(spark, sam)
    assert refs.first()["length"] == 99 and rows.first()["seq_len"] == 4


def test_tables(spark, tmp_path):
    res = write(tmp_path / "x.result", "#kind\n#norm: TTR\n#Orf\tp\ng1\t0.5\ng2\t\n")
    rows, info = r.read_result(spark, res)
    assert info == {"kind": "kind", "norm": "TTR"} and [tuple(x) for x in rows.orderBy("Orf").collect()] == [("g1", "0.5"), ("g2", "")]
    obo = write(tmp_path / "o.obo", "format: 1\n\n[Term]\nid: A\nname: root term\n\n[Term]\nid: B\nname: b\nis_a: A ! root\n\n[Term]\nid: C\nname: c\nis_a: A\nis_a: B\n")
    edges, names = r.read_obo(spark, obo)
    assert sorted(tuple(x) for x in edges.collect()) == [("B", "A"), ("C", "A"), ("C", "B")] and names.count() == 3
    counts = r.read_counts(spark, {"s1": write(tmp_path / "c1", "g1\t5\ng2\t0\n"), "s2": write(tmp_path / "c2", "g1\t7\n")})
    assert sorted(tuple(x) for x in counts.collect()) == [("g1", "s1", 5), ("g1", "s2", 7), ("g2", "s1", 0)]
    assoc = r.read_associations(spark, write(tmp_path / "as", "g1\tt1\ng1\tt1\ng2\tt1\n"))
    assert assoc.count() == 2
    galign = r.read_galign(spark, write(tmp_path / "ga", "1 5\n2 -1\n-1 7\n"))
    assert sorted(tuple(x) for x in galign.collect()) == [(1, 5), (2, -1)]
    nested = assoc.select("orf", "term", F.array(F.lit(1), F.lit(2)).alias("xs"), F.when(F.col("orf") == "g1", F.lit("a\tb")).alias("note"))
    w.write_result(nested, "demo", {"a": 1, "refs": ["x"]}, str(tmp_path / "w"))
    text = "".join(x.read_text() for part in ("head", "rows") for x in sorted((tmp_path / "w" / part).glob("part-*")))
    assert text.startswith('#demo\n#yaml:\n#  a: 1\n#  refs: ["x"]\n#orf\tterm\txs\tnote\n')
    for path in (str(tmp_path / "w"), write(tmp_path / "one.result", text)):  # in parts, or as one file
        back, info = r.read_result(spark, path, "xs array<int>, note string")
        assert info == {"kind": "demo", "a": "1", "refs": '["x"]'} and sorted((x.orf, x.term, x.xs, x.note) for x in back.collect()) == [("g1", "t1", [1, 2], "a b"), ("g2", "t1", [1, 2], None)]
    odd, _ = r.read_result(spark, write(tmp_path / "odd.result", "#k\n#x\ty\n1\toops\n\t2.5\n"), "x int, y double")
    assert sorted(((x.x, x.y) for x in odd.collect()), key=str) == [(1, None), (None, 2.5)]


def test_igv_and_streams(spark, tmp_path):
    counts = spark.createDataFrame([("a", "c1", 10, 2.0), ("a", "c1", 20, 0.0)], "sample_id string, contig string, position long, count double")
    row = w.igv_table(counts, ["a"], "chr", "nonorm").orderBy("Start").first()
    assert (row["Start"], row["End"], row["Feature"], row["a"]) == (10, 11, "TA10", "2.0")
    (tmp_path / "in").mkdir()
    read = rd.GUIDE_BEFORE + "ACGTACGTACGT" + rd.GUIDE_AFTER
    (tmp_path / "in" / "1.txt").write_text(f"{read}\n{read}\nAAAA\n")
    stream = streaming.stream_barcode_counts(streaming.stream_reads(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(x) for x in spark.table("bc").collect()] == [("ACGTACGTACGT", 2)]
    guides = spark.createDataFrame([("g", "ACGTACGTACGT"), ("h", "CCCCCCCCCC")], "sgrna string, barcode string")
    reads = spark.createDataFrame([(read,)], "seq string")
    assert {x.sgrna: x["count"] for x in rd.barcode_counts(reads, guides.withColumn("barcode", F.col("barcode"))).collect()} == {"g": 1, "h": 0}
