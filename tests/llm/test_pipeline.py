
import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_dedup import groups, shingles
from tests.llm.test_rules_and_models import rules
from tests.llm.test_tokens import ids_of


def test_against_brute_force(spark, tmp_path, hard_rows):
    """Every stage's decisions on a small corpus, repeated in plain Python."""
    base = hard_rows[7][1].split()
    rows = [(i, t) for i, (_, t) in enumerate(hard_rows)]
    for k in range(8):  # passages that several documents share
        rows.append((50 + k, " ".join(f"own{k}x{j}" for j in range(40)) + " " + " ".join(base[100:170]) + f" end{k}"))
    df = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {i: t for i, t in rows if not (rules(t)[0] < 20 or 100 * rules(t)[4] > 30 * rules(t)[0])}
    last = {t: max(i for i, x in kept.items() if x == t) for t in kept.values()}
    kept = {i: t for i, t in kept.items() if last[t] == i}
    comp = groups({i: shingles(t, 5) for i, t in kept.items()}, 80)
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    seen, texts = set(), {}
    for i, t in sorted(kept.items()):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        place, out = 0, []
        for c in t:
            n = len(c.encode())
            if not gone[place : place + n].all():
                out.append(c)
            place += n
        texts[i] = "".join(out)
    want = {i: len(x) + 1 for i, x in ids_of(sorted(texts.items())).items()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and len(texts) < len(rows)


def test_stages_keep_the_columns(spark, hard):
    docs = hard.withColumn("lang", F.lit("en"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
