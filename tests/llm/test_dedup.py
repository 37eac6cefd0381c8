import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from lociq.llm import block_names, components, repeats, set_join

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else (text or ""))


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def groups(sets, t):
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= t * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in sets}


def test_of_rows_alike_in_id_and_text_a_defined_one_stays(spark):
    rows = [(None, "same text", f"h{k}", k) for k in range(60)] + [(1, "other", "h", 0), (1, "other", "h", 0), (2, None, "x", 1), (2, "", "y", 2)]
    schema = "doc_id long, text string, source string, _order long"
    found = [sorted(map(str, block_names.drop_copies(spark.createDataFrame(rows, schema).repartition(n)).collect())) for n in (1, 3, 5)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 3


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(plain_df, plain, bits):
    got = {r.doc_id: r for r in block_names.exact_groups(plain_df, block=16, bits=bits).collect()}
    by_text = defaultdict(list)
    for i, t in plain:
        by_text[t or ""].append(i)
    for t, ids in by_text.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_on_hard_rows(hard, hard_rows, empty):
    got = block_names.exact_groups(hard).collect()
    assert len(got) == len(hard_rows) and sum(r.kept for r in got) == len({t or "" for _, t in hard_rows})
    kept = block_names.drop_copies(hard)
    assert kept.columns == hard.columns and Counter((r.text or "") for r in kept.collect()) == Counter({t or "" for _, t in hard_rows})
    assert block_names.exact_groups(empty).count() == 0 and block_names.drop_copies(empty).count() == 0


@pytest.mark.parametrize(("whole", "tile", "hot"), [(2, 2, 50_000), (2, 1000, 3), (8, 1000, 50_000)])
def test_near_groups(plain_df, plain, spark, whole, tile, hot):
    many = list(plain)
    base = words(plain[7][1])
    for k in range(30):  # a chain of near copies, each a few words from the last
        base = list(base)
        for j in range(3):
            base[(37 * k + 11 * j) % len(base)] = f"new{k}{j}"
        many.append((100 + k, " ".join(base)))
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(4)
    want = {i: shingles(t, 4) for i, t in many}
    comp = groups(want, 85)
    for r in set_join.near_groups(df, 4, 85, whole, tile, hot).collect():
        assert (r.n_shingles, r.component_id) == (len(want[r.doc_id]), comp[r.doc_id])


def test_crowded_buckets(spark):
    """Families of near copies that share a long passage and so crowd the same buckets, and short texts that fall short of segments."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    shared, rows = [word() for _ in range(60)], []
    for family in range(12):
        base = [*shared, *[word() for _ in range(rng.randint(6, 40))]]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(60, len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    few = [word() for _ in range(14)]
    for _ in range(30):
        rows.append((len(rows), " ".join(few[: rng.randint(5, 14)] + [word() for _ in range(rng.randint(0, 2))])))
    comp = groups({i: shingles(t, 4) for i, t in rows}, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for whole, tile, hot in ((2, 3, 50_000), (3, 500, 50_000), (3, 4, 1), (2, 500, 4)):
        assert {r.doc_id: r.component_id for r in set_join.near_groups(df, 4, 85, whole, tile, hot).collect()} == comp
    assert 12 <= len(set(comp.values())) < 90


def test_hot_buckets_in_cells(spark):
    """Every bucket of more than `hot` sets is found, dealt to several cells, and named again as it was."""
    shared = " ".join(f"s{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{shared} a{i} b{i} c{i}") for i in range(40)], "key long, text string").repartition(3)
    plan = [(*p, p[2] + 1, 0) for p in set_join.bands(100, 85)]
    buckets = lambda rows: Counter((r.bucket, r.tag) for r in rows)
    plain_rows = set_join.index_rows(df, 4, plan, set_join.NONE_HOT).distinct().collect()
    hot = set_join.find_hot(df, 4, plan, 10)
    large = {b: n for b, n in Counter(r.bucket for r in plain_rows).items() if n > 10}
    assert dict(zip(hot.names.view("int64").tolist(), hot.cells.tolist())) == {b: -(-n // 10) for b, n in large.items()} and len(large) > 5
    dealt = set_join.index_rows(df, 4, plan, hot)
    assert max(Counter(r.bucket for r in dealt.distinct().collect()).values()) < 25
    found = set_join.candidates(dealt, 8, hot).filter("kind = 2").selectExpr("a AS bucket", "b AS tag")
    assert buckets(found.collect()) == buckets(r for r in plain_rows if r.bucket in large)
    want, entity = set(), int(set_join.ENTITY)
    for b in (b for b in large if not b & 1):
        tags = sorted(r.tag for r in plain_rows if r.bucket == b)
        want |= {tuple(sorted((tags[0] & entity, x & entity))) for x in tags[1:] if tags[0] < 0}
    assert {tuple(r) for r in set_join.hot_stars(found).collect()} == want and len(want) >= 39


def test_segments_cover_every_link():
    """Random pairs at the threshold share a bucket under the smaller one's scheme, for every allocation."""
    rng = np.random.default_rng(0)
    for size in (3, 6, 7, 20, 90, 400):
        for _ in range(40):
            a = rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)
            gone = int(size * rng.random() * 0.15)
            b = np.concatenate([a[gone:], rng.integers(0, 2**63, int(size * rng.random() * 0.12), dtype=np.int64).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both) or both == len(a) == len(b):
                continue
            lo, hi, h = next(x for x in set_join.bands(10_000, 85) if x[0] <= min(len(a), len(b)) <= x[1])
            for m, k in ((h + 1, 0), (h + 1, 1), (h + 3, h + 1), set_join.allocate(lo, hi, h, 1000)):
                ids, row, short = set_join.segment_rows(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), np.array([5, 5]), np.array([m, m]), np.array([k, k]), np.array([h + 1, h + 1]))
                shared = np.intersect1d(ids[row == 0], ids[row == 1])
                plain_shared = shared[(shared & np.uint64(1)) == 0]
                assert len(plain_shared) or (short.any() and len(shared))


def test_near_on_hard_rows(hard, hard_rows, empty):
    sets = [shingles(t, 5) for _, t in hard_rows]
    got = set_join.near_groups(hard, 5, 80)
    assert Counter((r.doc_id, r.n_shingles) for r in got.collect()) == Counter((i, len(x)) for (i, _), x in zip(hard_rows, sets)) and set_join.near_groups(empty).count() == 0
    # Rows are judged by themselves: of the copies and near copies one stays, and the other text under a repeated id does too.
    order = sorted(range(len(hard_rows)), key=lambda k: (hard_rows[k][0] is not None, hard_rows[k][0] or 0, hard_rows[k][1] or ""))
    comp = groups({at: sets[k] for at, k in enumerate(order)}, 80)
    want = Counter(hard_rows[k] for at, k in enumerate(order) if comp[at] == at)
    kept = set_join.drop_near_copies(hard)
    assert kept.columns == hard.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == want and set_join.drop_near_copies(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == got[100] == 100


def brute_cut(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        out[i] = gone, bytes(np.frombuffer(b, np.uint8)[~gone])
    return out


@pytest.mark.parametrize("most", [20_000, 1])
def test_repeats(plain_df, plain, most):
    want = brute_cut(plain, 100)
    for r in repeats.repeat_report(plain_df, 100, most).collect():
        gone, kept = want[r.doc_id]
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(gone), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_repeats_within_and_across_tasks(spark):
    """One line many times in some documents, copies, and passages that move; one row a content and task is sent on, whatever order ids come in."""
    rng = random.Random(4)
    line = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(12)) + "\n"
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, "".join(rng.choice("qrstuvw ") for _ in range(rng.randint(0, 300))) + (line * rng.randint(1, 12) if i % 2 else "") + (passage[i % 7 :] if i % 3 == 0 else "")) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(40)]
    rng.shuffle(rows)
    want = brute_cut(rows, 100)
    for most in (20_000, 3):
        for r in repeats.repeat_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 100, most).collect():
            gone, kept = want[r.doc_id]
            assert (r.n_removed, r.kept_sha256) == (int(gone.sum()), hashlib.sha256(kept).hexdigest())
    seen = repeats._Earliest(most=4)
    u = lambda *x: np.array(x, np.uint64)
    i = lambda *x: np.array(x, np.int64)
    assert seen.later(u(1, 1, 2), u(0, 0, 0), i(5, 4, 9), i(0, 0, 0)).tolist() == [True, False, False]
    assert seen.later(u(1, 2, 2), u(0, 1, 0), i(3, 1, 10), i(0, 0, 0)).tolist() == [False, False, True]  # earlier than any before; another content; later
    assert seen.later(u(1, 3, 4, 5), u(0, 0, 0, 0), i(4, 1, 1, 1), i(0, 0, 0, 0)).tolist() == [True, False, False, False]
    with pytest.raises(ValueError):
        repeats.repeat_report(spark.createDataFrame(rows, "doc_id long, text string"), 5000)


def test_cut_keeps_rows_and_columns(hard, hard_rows, empty):
    got = repeats.cut_repeats(hard)
    assert got.columns == hard.columns and got.count() == len(hard_rows)
    assert repeats.cut_repeats(empty).count() == 0 and repeats.repeat_report(empty).count() == 0
    assert all("�" not in (r.text or "") for r in got.collect())


def test_maximal_repeats():
    """Two contexts of one anchor: shared by 3 bytes before it and 20 from it on."""
    anchor = b"0123456789abcdef"
    group = np.array([1, 1, 1])
    before = [b"cbaX", b"cbaY", b"Q"]  # backwards
    after = [anchor + b"tail1", anchor + b"tail2", anchor + b"zzz"]
    number, row, head, tail = repeats.maximal_repeats(group, before, after, 22)
    assert [(int(r), int(h), int(t)) for r, h, t in zip(row, head, tail)] == [(0, 3, 20), (1, 3, 20)] and len(set(number.tolist())) == 1
