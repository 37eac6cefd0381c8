"""The registered query of each text operator, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociq.llm import block_names, class_lm, codes, host_rules, merkle, packing, pieces, prefix_trie, quality_qda, repeats, set_join, sharding, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_class_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_scores(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.near_groups(_read(spark, sf_dir, "documents"), width=4, t=85)


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.token_files(_read(spark, sf_dir, "documents"), end=2)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(_read(spark, sf_dir, "documents"), length=100)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_groups(_read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), end=1)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.quality_rules(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_read(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_slots(_read(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_class_lm_scoring": op1_class_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_token_binary": op6_token_binary,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sharding": op12_sharding,
    "op13_conversation_trie": op13_conversation_trie,
}

RULES_CTE = r"""
d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, cast(sum(least(8, coalesce(nxt - i, 8))) AS bigint) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hit) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
r AS (SELECT w.doc_id, w.source, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
             coalesce(ln.n, 0)::bigint AS n_dup_lines, coalesce(cov.n, 0)::bigint AS n_repeat_words
      FROM w LEFT JOIN ln ON ln.doc_id = w.doc_id LEFT JOIN cov ON cov.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM r),
f AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_words OR NOT word_chars BETWEEN 2 * n_words AND 20 * n_words AS rule_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(rule_failed::int) AS k FROM f GROUP BY source),
m AS (SELECT least(greatest(avg(k / n), 1e-3), 1 - 1e-3) AS m, coalesce(var_samp(k / n), 0) AS v, avg(1 / n) AS w FROM h),
p AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * w, 1e-6) - 1, 2), 1e6) AS s FROM m),
v AS (SELECT source, (k + m * s) / (n + s) >= 0.5 AS rejected FROM h, p),
judged AS (SELECT f.*, NOT base_failed AND NOT rejected AS kept FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source)
"""

#: crc32 of a list of byte values. Its table is linear: the entry of a byte is the sum of those of its bits.
_BITS = [0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320]


def _crc32(values: str) -> str:
    table = "0"
    for k, v in enumerate(_BITS):
        table = f"xor({table}, ((xor(a, b) >> {k}) & 1) * {v})"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {values}), lambda a, b: xor(a >> 8, {table})), 4294967295)"


#: crc32 of a number's decimal digits.
ID_CRC = "(" + _crc32("list_transform(string_split({c}::varchar, ''), lambda x: ascii(x)::bigint)") + ")"
TEXT_CRC = _crc32("list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: (16 * (instr('0123456789ABCDEF', x[1]) - 1) + instr('0123456789ABCDEF', x[2]) - 1)::bigint)")

SQL: dict[str, str] = {
    "op5_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, max(a.n) AS nx, max(b.n) AS ny, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (nx + ny - c)), b AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN b ON b.x = r.c)
        SELECT s.doc_id, len(s.s) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY 1, 2""",
    "op7_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        w AS (SELECT doc_id, p, substr(h, (2 * p + 1)::int, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d)),
        g AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM w),
        m AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM g WHERE again),
        i AS (SELECT doc_id, p, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
        r AS (SELECT doc_id, run, min(p) AS lo, max(p) + 100 AS hi FROM i GROUP BY 1, 2),
        k AS (SELECT doc_id, run, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM r),
        t AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS last, string_agg(substr(d.h, (2 * before + 1)::int, (2 * (lo - before))::int), '' ORDER BY lo) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
        SELECT d.doc_id, n AS n_bytes, coalesce(gone, 0)::bigint AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::int))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_quality_rules": f"WITH {RULES_CTE} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged",
    "op11_merkle_manifest": """
        WITH RECURSIVE c AS (SELECT *, CASE WHEN """ + ID_CRC.format(c="doc_id") + """ % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS m FROM documents),
        v AS (SELECT *, [doc_id::varchar, source, lang, n_chars::varchar, text] AS own, [doc_id::varchar, source, lang, m::varchar, text] AS changed FROM c),
        l AS (SELECT doc_id, lang, sha256(array_to_string(list_transform(own, lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')), '')) AS leaf,
                     sha256(array_to_string(list_transform(changed, lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')), '')) AS claimed FROM v),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
        t AS (SELECT lang, 0 AS level, i, n, leaf AS h FROM o UNION ALL SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, level, n, i // 2),
        s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (SELECT 0 AS level, i, n, h FROM s UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, n, i // 2),
        f AS (SELECT doc_id, lang, 0 AS level, i, n, claimed AS h, '' AS proof FROM o
              UNION ALL SELECT f.doc_id, f.lang, f.level + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN f.i % 2 = 1 THEN t.h || f.h ELSE f.h || coalesce(t.h, '') END), proof || coalesce(t.h, '')
              FROM f LEFT JOIN t ON t.lang IS NOT DISTINCT FROM f.lang AND t.level = f.level AND t.i = xor(f.i, 1) WHERE f.n > 1),
        g AS (SELECT f.doc_id, 0 AS level, s.i, s.n, f.h, f.proof FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
              UNION ALL SELECT g.doc_id, g.level + 1, g.i // 2, (g.n + 1) // 2, sha256(CASE WHEN g.i % 2 = 1 THEN u.h || g.h ELSE g.h || coalesce(u.h, '') END), proof || coalesce(u.h, '')
              FROM g LEFT JOIN u ON u.level = g.level AND u.i = xor(g.i, 1) WHERE g.n > 1)
        SELECT o.doc_id, o.leaf, s.h AS subroot, r.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = r.h AS verified
        FROM o JOIN s ON s.lang IS NOT DISTINCT FROM o.lang JOIN g ON g.doc_id = o.doc_id AND g.n = 1 CROSS JOIN (SELECT h FROM u WHERE n = 1) r""",
    "op12_sharding": f"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, source, octet_length(encode(t)) + 1 AS size, {TEXT_CRC} AS crc, md5('12:' || coalesce(doc_id::varchar, 'null')) AS mix FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mix, doc_id NULLS FIRST, crc, size) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM m),
        p AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::double / (2 * n)::double, source NULLS FIRST, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM r),
        k AS (SELECT *, place * 16 // total AS shard FROM p)
        SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard::int AS shard, place - (shard * total + 15) // 16 AS slot, NULL::int AS grown_shard FROM k""",
    "op13_conversation_trie": r"""
        WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT DISTINCT conv_id, """ + ID_CRC.format(c="conv_id") + r""" % 4 AS h FROM o),
        b AS (SELECT c.conv_id, 0 AS own, i, t FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND i <= h UNION ALL SELECT c.conv_id, 1, i, t FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
        q AS (SELECT c.conv_id, coalesce(list(t ORDER BY own, i) FILTER (t IS NOT NULL), []) AS s FROM c LEFT JOIN b USING (conv_id) GROUP BY 1),
        p AS (SELECT conv_id, d, s[:d] AS p, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM q)),
        n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (ends), '') AS e,
              (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[-1].x, '[^\x20\x09-\x0D]+')) END AS own FROM p GROUP BY p, d),
        k AS (SELECT p[:-2] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
        f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.p = n.p),
        a AS (SELECT p[:x] AS p, sum((n_children = 0)::int) AS n_leaves, sum(own) AS saved FROM (SELECT p, n_children, own, unnest(range(0, d + 1)) AS x FROM f) GROUP BY 1)
        SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves::bigint AS n_leaves, a.saved::bigint AS saved_tokens, sha256(f.e) AS ends_sha256
        FROM f JOIN a ON a.p = f.p LEFT JOIN f up ON f.d > 0 AND up.p = f.p[:-2]""",
}
