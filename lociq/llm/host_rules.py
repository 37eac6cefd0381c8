"""Quality rules judged by host (native: DataFrame functions only).

Every document gets its rule counts, failures are summed by host, each host's failure rate is shrunk
towards an empirical beta prior, and the host's verdict is joined back to its documents.

Null or empty text: no words, so the base rule fails. Very long texts: judged whole, in one row. Null host: a
host of its own. Ties and repeated rows: judged one by one. Empty table: empty result. Other columns of the
input are not touched. Windows of eight words are told apart by 64-bit hashes within a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.session import keep

WORD = r"[^\\x20\\x09-\\x0D]+"
WINDOW = 8

#: Words in windows found twice or more, of an array w of words.
_WINDOWS = f"""transform(array(transform(w, x -> xxhash64(x))), a ->
    if(size(a) < {WINDOW}, array(), transform(sequence(1, size(a) - {WINDOW - 1}), i -> xxhash64(slice(a, i, {WINDOW})))))[0]"""
REPEATS = f"""transform(array({_WINDOWS}), h -> if(size(array_distinct(h)) = size(h), 0L,
    transform(array(sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))), s ->
      transform(array(sort_array(transform(filter(s, (x, j) -> (j > 0 AND s[greatest(j - 1, 0)].h = x.h)
            OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = x.h)), x -> x.i))), p ->
        aggregate(transform(p, (x, j) -> if(j = size(p) - 1, {WINDOW}, least({WINDOW}, p[least(j + 1, size(p) - 1)] - x))), 0L, (a, x) -> a + x))[0])[0]))[0]"""


def rule_struct(text: str = "text") -> Column:
    """One struct of a text's counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and of base_failed and rule_failed.

    Each one-element transform names a value, so that it is computed once.
    """
    t = f"coalesce(`{text}`, '')"
    lines = f"""transform(array(filter(split({t}, '\\n'), x -> x rlike '{WORD}')), l -> size(l) - size(array_distinct(l)))[0]"""
    counts = f"""transform(array(regexp_extract_all({t}, '{WORD}', 0)), w -> struct(
        cast(size(w) as long) AS n_words, cast(length(array_join(w, '')) as long) AS word_chars,
        cast(length({t}) - length(regexp_replace({t}, '[#*$%&|<>]', '')) as long) AS n_symbols,
        cast({lines} as long) AS n_dup_lines, {REPEATS} AS n_repeat_words))[0]"""
    base = "(r.n_words < 20 OR 100 * r.n_repeat_words > 30 * r.n_words)"
    soft = f"({base} OR 10 * r.n_symbols > r.word_chars OR 10 * r.n_dup_lines > 3 * r.n_words OR NOT r.word_chars BETWEEN 2 * r.n_words AND 20 * r.n_words)"
    return F.expr(f"""transform(array({counts}), r -> struct(r.n_words AS n_words, r.word_chars AS word_chars, r.n_symbols AS n_symbols,
        r.n_dup_lines AS n_dup_lines, r.n_repeat_words AS n_repeat_words, {base} AS base_failed, {soft} AS rule_failed))[0]""")


def base_struct(text: str = "text") -> Column:
    """base_failed alone, as a struct: words and repeated windows, without the other rules."""
    t = f"coalesce(`{text}`, '')"
    return F.expr(f"""transform(array(regexp_extract_all({t}, '{WORD}', 0)), w -> struct(size(w) < 20 OR 100 * {REPEATS} > 30 * size(w) AS base_failed))[0]""")


def with_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the rule counts, base_failed, and rule_failed, which feeds the host rates.

    The generator keeps Spark from repeating the expression for each of its columns and in filters.
    """
    return docs.select("*", F.inline(F.array(rule_struct(text))))


def host_verdicts(judged: DataFrame, host: str = "source", most: float = 0.5) -> DataFrame:
    """One row a host: documents, failures, shrunk rate and host_rejected.

    The hosts' sums are a table, so that judged is read once. The beta prior comes from their rates by the
    method of moments (one row of sums reaches the driver); a host is rejected when its posterior mean failure rate is `most` or more.
    """
    hosts = keep(judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_docs"), F.sum(F.col("rule_failed").cast("long")).alias("host_failed")), "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("w")).first()
    m = min(max(moments["m"] if moments["m"] is not None else 0.5, 1e-3), 1 - 1e-3)
    spread = max((moments["v"] or 0.0) - m * (1 - m) * (moments["w"] or 0.0), 1e-6)  # less what sampling alone explains
    strength = min(max(m * (1 - m) / spread - 1, 2.0), 1e6)
    shrunk = (F.col("host_failed") + m * strength) / (F.col("host_docs") + strength)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") >= most)


def quality_rules(docs: DataFrame, host: str = "source", most: float = 0.5) -> DataFrame:
    """One row a document: doc_id, host, the counts, base_failed, the host's rate and kept."""
    stats = keep(with_rules(docs.select("doc_id", F.col(host).alias("host"), "text")).drop("text"), "rules")
    hosts = host_verdicts(stats, "host", most)  # on a table, so that Spark can split a large host's rows in the join
    joined = stats.join(hosts.select("host", "host_docs", "host_rate", "host_rejected"), stats["host"].eqNullSafe(hosts["host"]), "left").drop(hosts["host"])
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def drop_rejected(docs: DataFrame, host: str = "source", most: float = 0.5, max_hosts: int = 10_000) -> DataFrame:
    """The documents that quality_rules keeps, with the columns of docs.

    All rules are applied once, for the hosts' sums; what a row then needs besides its host's verdict is the base rule alone, which is
    cheaper to apply again than the documents are to keep.
    Rejected hosts are excluded by a broadcast only where there are at most max_hosts of them; otherwise by a shuffle join.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(host).alias("host"), "text")
    rejected = host_verdicts(with_rules(rows.select("host", "text")), "host", most).filter("host_rejected").select(F.col("host").alias("_host"))
    if rejected.limit(max_hosts + 1).count() <= max_hosts:
        rejected = F.broadcast(rejected)
    kept = rows.select("_doc", "host", F.inline(F.array(base_struct()))).filter(~F.col("base_failed"))
    return kept.join(rejected, kept["host"].eqNullSafe(rejected["_host"]), "left_anti").select("_doc.*")
