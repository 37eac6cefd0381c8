"""Gene-set enrichment: hypergeometric, ranked, and over an ontology."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.functions import special
from lociq.operators.joins import dealt
from lociq.operators.windows import bh_fdr, running_enrichment
from lociq.scratch import keep


def fet(results: DataFrame, hits: DataFrame, associations: DataFrame, pseudo: int = 2) -> DataFrame:
    """(term, n_genes, n_term, n_hits, k, expected, enrichment, pval, padj): hypergeometric tails with pseudo-counts, for terms of two genes or more.

    n_genes tested, n_term in the term, n_hits hits, k of them in the term. Genes are marked once; both totals come from one aggregation.
    """
    marked = keep(results.select("orf").distinct().join(hits.select("orf").distinct().withColumn("_hit", F.lit(1)), "orf", "left"), "marked")
    whole = marked.agg(F.count("*").alias("n"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("hits")).first()
    one, size = whole["n"], whole["hits"]
    sets = associations.select("orf", "term").distinct().join(marked, "orf").groupBy("term").agg(F.count("*").alias("n_term"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("k"))
    sets = sets.filter("n_term > 1").withColumn("n_genes", F.lit(one)).withColumn("n_hits", F.lit(size))
    extra = int(one * pseudo / size) if size else 0
    expected = F.col("n_hits") * F.col("n_term") / F.col("n_genes")
    out = sets.withColumn("expected", expected).withColumn("enrichment", (F.col("k") + pseudo) / (F.col("expected") + pseudo))
    p = special.hypergeom_sf_column(*[x.cast("double") for x in (F.col("k") + pseudo, F.col("n_genes"), F.col("n_term") + extra, F.col("n_hits"))])
    return bh_fdr(out.withColumn("pval", p))


def random_places(n: int, size: int, rng: np.random.Generator) -> np.ndarray:
    """A random set of `size` of n places, in order: the first `size` different ones of a sequence, or all but such a set where that is smaller."""
    few, kind = min(size, n - size), np.int32 if n < 2**31 else np.int64
    at = np.sort(rng.integers(0, n, few, kind))
    at = at[np.r_[True, at[1:] != at[:-1]]] if few else at
    more = at[:0]
    while left := few - len(at) - len(more):  # in place of those that came twice
        new = np.union1d(more, rng.integers(0, n, left, kind))
        more = new[at[np.minimum(np.searchsorted(at, new), len(at) - 1)] != new]
    at = np.sort(np.concatenate([at, more]), kind="stable")
    return at if few == size else np.delete(np.arange(n), at)


def random_gaps(n: int, size: int, draws: int, weights: np.ndarray | None, rng: np.random.Generator) -> np.ndarray:
    """The enrichment statistic of `draws` random sets of `size` of n ranked genes, a set at a time."""
    found, i = np.zeros(draws), np.arange(1, size + 1)
    even = i / size
    for k in range(draws):
        at = random_places(n, size, rng)
        if weights is None:
            hit = even
        else:
            w = weights[at]
            hit = np.cumsum(w) / max(w.sum(), 1e-300)
        found[k] = np.abs(hit - (at + 1 - i) / max(n - size, 1)).max()
    return found


def gsea(ranked: DataFrame, associations: DataFrame, p: float = 0.0, n_perm: int = 10_000, seed: int = 0, max_genes: int = 2_000_000, batch: int = 100) -> DataFrame:
    """(term, n_members, es, mean_rank, pval, padj): weighted Kolmogorov-Smirnov statistic against random sets of the same size.

    The null depends on the set's size and the ranking alone, so terms of one size share their draws. Draws are rows of (size, batch), each seeded by
    both, and only the members of a random set are drawn: a large set is many small tasks. After a tenth of the draws those sizes go on
    whose largest statistic was reached 10 times at most. With p = 0 every gene weighs the same, and
    only their number is taken to the driver; otherwise the kernels need all weights, of max_genes genes at most.
    """
    ranked = keep(ranked.select("orf", "rank", "score"), "ranked")
    members = keep(associations.select("orf", "term").distinct().join(ranked.select("orf"), "orf", "left_semi"), "members")
    found = keep(running_enrichment(ranked, members, p).filter("n_members >= 2"), "statistics")
    ranks = members.join(ranked.select("orf", "rank"), "orf").groupBy("term").agg(F.avg("rank").alias("mean_rank"))
    total = ranked.count()
    weights = None
    if p:
        if total > max_genes:
            raise ValueError(f"{total} ranked genes are more than max_genes = {max_genes}; with p = 0 their number does not matter")
        weights = np.abs(ranked.orderBy("rank").select("score").toArrow().column(0).to_numpy().astype(float)) ** p

    def null(rows: pd.DataFrame) -> pd.DataFrame:
        size, part, draws = (int(rows[c].iloc[0]) for c in ("n_members", "part", "draws"))
        seen = np.sort(random_gaps(total, size, draws, weights, np.random.default_rng([seed, size, part])))
        return pd.DataFrame({"es": rows["es"], "n_members": size, "draws": draws, "reached": draws - np.searchsorted(seen, rows["es"], "left")})

    def run(statistics: DataFrame, first: int, last: int) -> DataFrame:
        lo = F.explode(F.sequence(F.lit(first), F.lit(last - 1), F.lit(batch)))
        parts = statistics.withColumn("part", lo).withColumn("draws", F.least(F.lit(batch), last - F.col("part")))
        return dealt(parts, "n_members", "part").groupBy("n_members", "part").applyInPandas(null, "es double, n_members long, draws long, reached long")

    values = found.select("n_members", "es").distinct()
    first = max(min(n_perm, batch), n_perm // 10)
    sums = lambda df: df.groupBy("n_members", "es").agg(F.sum("draws").alias("draws"), F.sum("reached").alias("reached"))
    drawn = keep(sums(run(values, 0, first)), "drawn")
    if first < n_perm:
        on = drawn.groupBy("n_members").agg(F.min("reached").alias("least")).filter("least <= 10").select("n_members")
        drawn = sums(drawn.unionByName(run(values.join(on, "n_members", "left_semi"), first, n_perm).select(*drawn.columns[:2], "draws", "reached")))
    tested = found.join(drawn.select("n_members", "es", (F.col("reached") / F.col("draws")).alias("pval")), ["n_members", "es"])
    return bh_fdr(tested.join(ranks, "term").select("term", "es", "n_members", "pval", "mean_rank"))


def ancestors(edges: DataFrame) -> DataFrame:
    """(term, ancestor) closure of (child, parent), itself included.

    Each round joins only the pairs that the last one found with all pairs known by then, and writes what is new; the length of the
    paths doubles, so depth d takes log2 d rounds, and a cycle ends when it finds nothing new.
    """
    strict = keep(edges.filter("child <> parent").select(F.col("child").alias("term"), F.col("parent").alias("ancestor")).distinct(), "edges")
    nodes = edges.select(F.col("child").alias("term")).union(edges.select("parent")).distinct()
    known = newest = strict
    while not newest.isEmpty():
        onward = known.select(F.col("term").alias("_m"), F.col("ancestor").alias("_a"))
        longer = newest.join(onward, newest["ancestor"] == onward["_m"]).select("term", F.col("_a").alias("ancestor")).filter("term <> ancestor").distinct()
        newest = keep(longer.join(known, ["term", "ancestor"], "left_anti"), "longer-paths")
        known = known.union(newest)
    return nodes.select("term", F.col("term").alias("ancestor")).union(known)


def ontology_enrichment(hits: DataFrame, associations: DataFrame, edges: DataFrame, smallest: int = 2, largest: int = 300) -> DataFrame:
    """(term, n_parents, m, q, p, b, pval, enrichment, padj) by the parent-child union: b of m term genes are hits, against p of q in the union of the direct parents.

    enrichment: the share of the union's hits that the term holds over the share of its genes, 1 added to each of the four.
    """
    edges = keep(edges.distinct(), "ontology")
    genes = associations.select("orf", "term").distinct().join(ancestors(edges), "term").select("orf", F.col("ancestor").alias("term")).distinct()
    marked = keep(genes.join(hits.select("orf").distinct().withColumn("_hit", F.lit(1)), "orf", "left").fillna(0, ["_hit"]), "marked")
    own = marked.groupBy("term").agg(F.count("*").alias("m"), F.sum("_hit").alias("b")).filter(F.col("m").between(smallest, largest) & (F.col("b") >= 1))
    own = keep(own, "terms")
    parents = edges.join(own.select(F.col("term").alias("child")), "child", "left_semi")
    union = parents.join(marked.withColumnRenamed("term", "parent"), "parent").select("child", "orf", "_hit").distinct().groupBy("child").agg(F.count("*").alias("q"), F.sum("_hit").alias("p"))
    count = parents.groupBy("child").agg(F.count("*").alias("n_parents"))
    out = own.join(union.withColumnRenamed("child", "term"), "term").join(count.withColumnRenamed("child", "term"), "term")
    p = special.hypergeom_sf_column(*[x.cast("double") for x in (F.col("b") - 1, F.col("q"), F.col("m"), F.col("p"))])
    return bh_fdr(out.withColumn("pval", p).withColumn("enrichment", ((F.col("b") + 1) / (F.col("p") + 1)) / ((F.col("m") + 1) / (F.col("q") + 1))))


def parent_unions(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(child, n): the number of different genes in a child's parents taken together; members is (parent, orf), edges (child, parent).

    Genes that lie in the same parents are one row with their number before they meet the edges: rows are a child and such a set, not a child and gene.
    """
    alike = members.filter("orf IS NOT NULL").groupBy("orf").agg(F.array_sort(F.collect_set("parent")).alias("_parents")).groupBy("_parents").agg(F.count("*").alias("n"))
    met = alike.withColumn("parent", F.explode("_parents")).join(edges, "parent").select("child", "_parents", "n").distinct()
    return met.groupBy("child").agg(F.sum("n").alias("n"))
