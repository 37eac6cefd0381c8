"""Exact duplicates by deterministic block naming (native: DataFrame functions only).

Texts are cut into fixed-size blocks. The distinct blocks are sorted and get integer names; then names
of adjacent blocks are paired, the distinct pairs sorted and named, and so on until each document has
one name. Equal names at equal depth mean equal texts: names stand for whole contents, so nothing
rests on a hash. Hashes only route blocks to their names; where two different blocks share a hash,
these blocks are looked up by their contents.

Null text counts as empty; empty texts are equal to one another. Repeated rows are documents of their
own. Of equal texts the row with the largest doc_id stays (null is smallest), and of rows that repeat
that id too, one. Very long texts: as many blocks as they need, in one row while they are cut. Empty
table: empty result. Other columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.session import keep, release

BLOCK = 1024


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Number the rows of `distinct` in the sorted order of each hash partition: unique positive integers."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id() + 1)


def block_rows(docs: DataFrame, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """(row, doc_id, sha, n, pos, route, block) for each block of each text; bits shortens the route, for tests."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("sha"),
        F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))).alias("blocks"),
    )
    rows = cut.select("row", "doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    return rows.withColumn("route", F.shiftrightunsigned(F.xxhash64("block"), 64 - bits) if bits < 64 else F.xxhash64("block"))


def identities(docs: DataFrame, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """One row a document: row, doc_id, sha and its identity (depth, name)."""
    rows, whole = block_rows(docs, block, bits), []
    names = keep(_named(rows.select("route", "block").distinct(), ["block"]).select("route", "name"), "names")
    clashes = names.groupBy("route").count().filter("count > 1").select("route")
    slim = ["row", "doc_id", "sha", "n", "pos"]
    sha = F.when(F.col("pos") == 0, F.col("sha")).alias("sha")
    found = rows.select("row", "doc_id", sha, "n", "pos", "route")
    if clashes.isEmpty():
        current = found.join(names, "route").select(*slim, "name")
    else:
        # Blocks that share a route are compared by content. Their names lie above all others. The rows are used twice
        # here and must keep their numbers, so they are written first.
        clashes, rows = keep(clashes, "clashes"), keep(rows, "rows")
        whole.append(rows)
        found = rows.select("row", "doc_id", sha, "n", "pos", "route")
        top = names.agg(F.max("name")).first()[0]
        several = keep(_named(rows.join(clashes, "route", "left_semi").select("block").distinct(), ["block"]), "clash-names").withColumn("name", F.col("name") + top)
        alone = found.join(names.join(clashes, "route", "left_anti"), "route").select(*slim, "name")
        current = alone.union(rows.withColumn("sha", sha).join(clashes, "route", "left_semi").join(several, "block").select(*slim, "name"))
    current = keep(current, "level0")
    release(*whole)
    heads = current.filter("pos = 0").select("row", "doc_id", "sha")
    done, depth, old = current.filter("n = 1").select("row", F.lit(0).alias("depth"), "name"), 0, [names]
    level = current.filter("n > 1").select("row", "n", "pos", "name")
    most = level.agg(F.max("n")).first()[0] or 1
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        half = (F.col("pos") / 2).cast("int")
        first, second = (F.max(F.when(F.col("pos") % 2 == k, F.col("name"))) for k in (0, 1))
        pairs = level.groupBy("row", ((F.col("n") + 1) / 2).cast("int").alias("n"), half.alias("pos")).agg(first.alias("a"), F.coalesce(second, F.lit(0)).alias("b"))
        pairs = keep(pairs, "pairs")
        names = keep(_named(pairs.select("a", "b").distinct(), ["a", "b"]), "pair-names")
        current = keep(pairs.join(names, ["a", "b"]).select("row", "n", "pos", "name"), f"level{depth}")
        release(*old)
        old = [pairs, names]
        done = done.union(current.filter("n = 1").select("row", F.lit(depth).alias("depth"), "name"))
        level = current.filter("n > 1")
    release(*old)
    return heads.join(done, "row")


def exact_groups(docs: DataFrame, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = keep(identities(docs, block, bits), "identities")
    groups = keep(found.groupBy("depth", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best")), "groups")  # a table, so that Spark can split a large group's rows in the join
    out = found.join(groups, ["depth", "name"])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents that exact_groups keeps, with the columns of docs; one row of each text.

    Rows are matched by doc_id and the text's digest. Of rows equal in both, the one whose other columns hash lowest stays;
    they are reduced to it before the shuffle, so many of them meet in no task.
    """
    def ids(d: DataFrame, digest: Column) -> list[Column]:
        return [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), digest.alias("_sha")]

    kept = exact_groups(docs, block).filter("kept")
    kept = kept.select(*ids(kept, F.col("text_sha256")))
    named = ids(docs, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]  # maps have no hash
    packed = docs.select(*named, F.xxhash64(F.lit(0), *others).alias("_order"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    one = packed.groupBy("_id", "_sha").agg(F.min_by("_doc", "_order").alias("_doc"))
    return one.join(kept, ["_id", "_sha"], "left_semi").select("_doc.*")
