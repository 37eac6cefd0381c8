import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from lociq.llm import class_lm, host_rules, quality_qda, toxicity
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules(hard, hard_rows, empty):
    got = Counter(tuple(r) for r in host_rules.quality_rules(hard).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = [rules(t) for _, t in hard_rows]
    assert got == Counter((*x, x[0] < 20 or 100 * x[4] > 30 * x[0]) for x in want)
    kept = host_rules.drop_rejected(hard)
    assert kept.columns == hard.columns
    assert host_rules.quality_rules(empty).count() == 0 and host_rules.drop_rejected(empty).count() == 0


def test_bad_host_is_rejected(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good if i % 10 else "x", f"h{i % 7}") for i in range(700)] + [(1000 + i, good if i == 0 else "x", "bad") for i in range(100)] + [(2000, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in host_rules.quality_rules(df).filter("kept").collect()}
    assert 1000 not in kept and 1 in kept and kept == {r.doc_id for r in host_rules.drop_rejected(df).collect()}


def test_language_model(plain_df, plain, hard, hard_rows, empty):
    got = {r.doc_id: r for r in class_lm.class_scores(plain_df, classes=8, seeds=64, block_tokens=1000).collect()}
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in plain}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(counts[w] > 0 for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t), rel_tol=1e-9)
        assert r.score <= 0 and r.perplexity >= 1
    # Null and repeated ids: each row by its own text, a null id hashed as empty text.
    rows = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in hard_rows]
    counts = Counter(w for _, out, t in rows if not out for w in t)
    total, distinct = sum(counts.values()), len(counts)
    want = Counter((i, out, len(t), sum(counts[w] > 0 for w in t), total, f"{sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t):.8g}") for i, out, t in rows)
    found = class_lm.class_scores(hard, classes=8, seeds=64).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.8g}") for r in found) == want and all(math.isfinite(r.score) and r.score <= 0 for r in found)
    assert class_lm.class_scores(empty).count() == 0


def test_class_counts_and_scores_by_hand(spark, plain):
    """The sweeps' neighbour counts, the class bigrams and the score, counted again in Python from the classes found."""
    rng = np.random.default_rng(8)
    texts = {i: " ".join([t or "", *[f"{'ab'[k % 2]}{rng.integers(0, 12)}" for k in range(60)]]) for i, t in plain}
    df = spark.createDataFrame(list(texts.items()), "key long, text string").repartition(3)
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    classes = 6
    marked = df.select("key", "text", (F.crc32(F.col("key").cast("string").cast("binary")) % 10 == 0).alias("held_out"))
    model = class_lm.learn(marked, classes, 20, 3, 0.0, 700)
    assert all(b > a for a, b in zip(model.likelihoods[:-2], model.likelihoods[1:-1]))

    def ids(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return class_lm.token_ids(data, np.array([0, len(data)]))[0].tolist()

    tokens = {i: ids(t) for i, t in texts.items()}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    found = {r.word: r for r in class_lm.word_rows(model.words).collect()}
    assert set(found) == {w for t in tokens.values() for w in t} and all(r.n == counts[w] and (r.cls < classes if r.n else r.cls == class_lm.UNKNOWN) for w, r in found.items())
    cls = {w: r.cls for w, r in found.items()}
    near, pairs = defaultdict(Counter), np.zeros((classes, classes))
    for i, t in tokens.items():
        if not held[i]:
            for before, w, after in zip([0, *t[:-1]], t, [*t[1:], None]):
                pairs[cls[before], cls[w]] += 1
                near[w][cls[before]] += 1
                if after is not None:
                    near[w][classes + 1 + cls[after]] += 1
    assert (pairs == model.pairs).all()
    for w, r in found.items():
        if w:  # what follows an end is not used
            assert dict(zip(r.codes, np.frombuffer(r.counts, "<i8").tolist())) == dict(near[w])
    n, v = sum(counts.values()), len(counts)
    size, single = np.zeros(classes), np.zeros(classes)
    for w, c in counts.items():
        size[cls[w]] += c
        single[cls[w]] += c == 1
    unseen = np.minimum((single + 0.5) / (size + 1), 0.9)
    unseen[0] = 1e-12
    prior = (pairs.sum(0) + 0.1) / (pairs.sum() + 0.1 * classes)
    follow = (pairs + 2 * prior) / (pairs.sum(1, keepdims=True) + 2)
    docs = df.withColumnRenamed("key", "doc_id")
    for r in class_lm.class_scores(docs, 10, classes, 20, 3, 0.0, 700).collect():
        context, score, base = 0, 0.0, 0.0
        for w in tokens[r.doc_id]:
            base += math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1)))
            if counts[w]:
                score += math.log10(follow[context, cls[w]] * (1 - unseen[cls[w]]) * counts[w] / size[cls[w]])
                context = cls[w]
            else:
                score += math.log10(follow[context] @ unseen)
        assert math.isclose(r.score, score, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9) and r.held_out == held[r.doc_id]


def test_exchange_around_other_words():
    """Exchanging some words around fixed ones never lowers the likelihood of all bigrams, and its class bigrams stay true."""
    rng = np.random.default_rng(9)
    n, classes = 40, 5
    bigrams = rng.poisson(1.0, (n, n)) * (rng.random((n, n)) < 0.4)
    of = 1 + rng.integers(0, classes - 1, n)
    of[0] = 0

    def pairs(c):
        one = np.eye(classes)[c]
        return one.T @ bigrams @ one

    some = np.arange(15)
    one = np.eye(classes)[of[15:]]
    moved = of.copy()
    moved[:15] = class_lm.exchange(bigrams[:15, :15], 0, classes, 4, of[:15], (pairs(of), bigrams[:15, 15:] @ one, (one.T @ bigrams[15:, :15]).T))
    assert class_lm.likelihood(pairs(moved)) > class_lm.likelihood(pairs(of)) and moved[0] == 0 and len(some) == 15


def test_exchange_finds_classes():
    """Words of two languages that never mix fall into classes that do not mix."""
    n = 21
    bigrams = np.zeros((n, n))
    for side in (range(1, 11), range(11, 21)):
        for a in side:
            for b in side:
                bigrams[a, b] = 1 + (a * b) % 3
    bigrams[0, 1:] = bigrams[1:, 0] = 1
    of = class_lm.exchange(bigrams, 0, 3)
    assert len(set(of[1:11])) == 1 and len(set(of[11:21])) == 1 and of[1] != of[11] and of[0] == 0


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(-4, 4, rng.integers(1, 30)).astype(float)

        def split(lo, hi, x=x):
            best = max(((x[i:j].sum(), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i, j = -best[2], -best[2] - best[1]
            return split(lo, i) + [(i, j, best[0])] + split(j, hi)

        got = toxicity.segments(x)
        assert math.isclose(sum(s for *_, s in got), sum(s for *_, s in split(0, len(x)))) and max((s for *_, s in got), default=0) == max((s for *_, s in split(0, len(x))), default=0)


def test_toxicity_and_quality(spark, hard, empty):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(vocabulary, 60))
        toxic = int(i % 4 == 0)
        if toxic:
            for k in (10, 12, 14, 30):
                text[k] = rng.choice(["vileword", "vilething", "nastyone"])
        poor = int(i % 5 == 1)
        rows.append((i, " ".join(["same"] * 50 + text[:5] if poor else text)))
        labels.append((i, 1 - poor, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = {i: (q, t) for i, q, t in labels}
    found = toxicity.toxicity(docs, marks).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    poor_free = [r for r in found if r.held_out and want[r.doc_id][0] == 1]
    assert np.mean([r.predicted == want[r.doc_id][1] for r in poor_free]) > 0.95 and any(r.passages for r in found)
    scored = [r for r in quality_qda.quality(docs, marks).collect() if r.held_out]
    assert np.mean([r.predicted == want[r.doc_id][0] for r in scored]) > 0.95
    for f in (toxicity.toxicity, quality_qda.quality):
        # Equal texts have equal scores, whatever their ids and other columns are; empty texts have one too.
        found, texts = f(hard, marks).collect(), {}
        assert len(found) == hard.count() and all(0 <= r.score <= 1 for r in found) and f(empty, marks).count() == 0
        for i in (1, 2, 12):
            texts[i] = {r.score for r in found if r.doc_id == i}
        assert texts[1] == texts[2] and len(texts[12]) == 1 and texts[12] == {r.score for r in found if r.doc_id == 10}
        assert f(docs, marks.limit(0)).count() == 400


def test_discriminant_is_the_density_difference():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (300, 3))])
    y = np.repeat([0, 1], 300)
    m = quality_qda.fit(x, y)
    z = (x - m.centre) / m.spread
    want = []
    for k in (0, 1):
        inv = m.factor[k]
        cov = np.linalg.inv(inv.T @ inv)
        d = z - m.mean[k]
        want.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(m.difference(x), want[1] - want[0])
