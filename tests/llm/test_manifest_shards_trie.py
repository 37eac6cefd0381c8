"""Merkle manifest, shards and prefix trie against plain versions of their definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from lociq.llm import merkle, prefix_trie, sharding
from lociq.llm.ordering import ranked
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key long, g string, idx long, total long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes, fanout):
    """All levels from the nodes to one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def plain_manifest(rows, fanout):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = plain_tree([leaf_of(r) for r in by[g]], fanout)
    top = plain_tree([trees[g][-1][0] for g in langs], fanout)
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(by[g]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node, proof = leaf_of((*r[:3], r[3] + 1, r[4]) if bad else r), ""
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    lo = at // fanout * fanout
                    run = level[lo : lo + fanout]
                    proof += "".join(x for j, x in enumerate(run) if j != at - lo)
                    run[at - lo] = node
                    node, at = h(*run), at // fanout
            out.append((r[0], leaf_of(r), trees[g][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return out


def documents(n=150):
    rng = random.Random(3)
    rows = [(i, rng.choice(["s1", "s2", None]), rng.choice(["en", "en", "en", "é", None, "de"]), rng.choice([7, 123, None]), rng.choice([None, "", "word é " * rng.randint(1, 9)])) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "s", "en", 1, "no id"), (5, "s1", "en", 3, "same id"), (8, "x", "zz", 1, "alone"), (9, "copy", "en", 1, "twice"), (9, "copy", "en", 1, "twice"), (500, "s", "en", 1, "long " * 20000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "g", 2, 3) for r in rows], SCHEMA).repartition(3)


def test_manifest_is_the_plain_tree(spark):
    rows = documents()
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for fanout, levels in ((2, 9), (2, 2), (3, 2)):
        bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
        found = merkle.manifest(frame(spark, rows), {"n_chars": F.when(bad, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, fanout=fanout, levels=levels)
        assert Counter(map(tuple, found.select(columns).collect())) == Counter(plain_manifest(rows, fanout))


def test_manifest_proofs_lead_to_the_root(spark):
    for r in merkle.manifest(frame(spark, documents()), levels=3, proofs=True).collect():
        node = r["claimed"]
        for before, after in zip(r["before"], r["after"]):
            node = h(before, node, after)
        assert node == r["root"] == r["folded_root"] and r["verified"]


def test_manifest_of_few_rows(spark):
    assert merkle.audit(frame(spark, documents()).limit(0)).count() == 0
    alone = [(1, None, "en", None, "x")]
    assert [tuple(r) for r in merkle.audit(frame(spark, alone)).collect()] == [(1, *[leaf_of(alone[0])] * 3, h(), leaf_of(alone[0]), True)]


def test_states_resume_before_a_slot():
    children = [h(str(i)).encode() for i in range(4)]
    parent = merkle.Parent(children)
    for slot in range(4):
        changed = [*children[:slot], b"new", *children[slot + 1 :]]
        assert merkle.resume(parent.states[slot], b"new", b"".join(children[slot + 1 :])) == merkle.Parent(changed).digest
    assert len(parent.states) == 4


def test_ranks_are_places(spark, hard, hard_rows):
    found = ranked(hard.select("doc_id", "source", "n"), ["doc_id", "n"], "source").collect()
    for source in ("h0", "h1", "h2"):
        want = sorted((i is not None, i or 0, k) for k, (i, _) in enumerate(hard_rows) if f"h{k % 3}" == source)
        own = sorted((r["rank"], r["doc_id"] is not None, r["doc_id"] or 0, r["n"]) for r in found if r["source"] == source)
        assert own == [(p, *w) for p, w in enumerate(want)] and {r["total"] for r in found if r["source"] == source} == {len(want)}


def test_shards_follow_the_mixture(spark):
    sources = ["hot"] * 600 + ["small"] * 61 + [None] * 130 + ["tiny"] * 3
    rows = [(i, s, "en", 1, None if i % 50 == 0 else f"text {i % 40}") for i, s in enumerate(sources)]
    found = sharding.shard_slots(frame(spark, rows), 16).collect()
    shards = defaultdict(list)
    for r in found:
        shards[r["shard"]].append(r)
        text = rows[r["doc_id"]][4] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text.encode()), "rows", None)
    assert len(found) == len(rows) and set(shards) == set(range(16))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        for source, n in Counter(sources).items():
            assert abs(sum(sources[r["doc_id"]] == source for r in own) - n / 16) <= 2
    again = sharding.shard_slots(frame(spark, rows).repartition(7), 16).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))
    assert sorted((r["doc_id"], r["shard"]) for r in sharding.shard_slots(frame(spark, rows), 16, seed=1).collect()) != sorted((r["doc_id"], r["shard"]) for r in found)


def test_shards_of_hard_rows(spark, hard, empty):
    found = sharding.shard_slots(hard, 5).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in hard.select("doc_id").collect())
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.shard_slots(empty).count() == 0


def test_shards_as_files(spark, hard, tmp_path):
    read = sharding.write_shards(hard, f"file://{tmp_path}/shards", 4, rows_a_file=2)
    assert read.select("doc.*").columns == hard.columns
    assert Counter(map(str, read.select("doc.*").collect())) == Counter(map(str, hard.collect()))
    for shard in range(4):
        assert sorted(r["slot"] for r in read.filter(f"shard = {shard}").collect()) == list(range(read.filter(f"shard = {shard}").count()))


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    new = {}
    for c, ts in own.items():
        k = zlib.crc32(str(c).encode()) % 4
        new[c] = tuple(own.get(c - c % 20, [])[:k] + ts[k:])
    members = defaultdict(list)
    for c, ts in new.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        words = lambda q: len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
        children = lambda q: sum(len(r) == len(q) + 1 and r[:-1] == q for r in members)
        ends = ",".join(map(str, sorted(c for c in m if new[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children(p), sum(not children(q) for q in below), sum((len(members[q]) - 1) * words(q) for q in below), h(ends)))
    return out


def conversations(seed, n=90):
    rng = random.Random(seed)
    texts = ["hi there", "what is it", "a b c d", "", None, "naïve  ünïcode\ttext", "bye"]
    rows = []
    for c in rng.sample(range(200), n):
        turns = [(c, i if i or rng.random() < 0.8 else None, rng.choice(["user", "assistant", None]), rng.choice(texts)) for i in range(rng.randint(1, 6))]
        rows += turns + ([turns[-1]] if rng.random() < 0.1 else [])
    for c in range(1000, 1030):  # copies
        rows += [(c, i, "user", texts[i]) for i in range(4)]
    return rows + [(None, 1, "user", "no conversation"), (300, 1, "user", "word " * 30000)]


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, b"x", 2) for r in rows], "conv_id long, turn long, role string, text string, id long, digest binary, words long").repartition(3)


def test_trie_is_the_plain_one(spark):
    for seed, most in ((1, 512), (2, 7), (3, 1)):
        rows = conversations(seed)
        found = prefix_trie.prefix_trie(talk(spark, rows), most)
        assert Counter(map(tuple, found.collect())) == Counter(plain_trie(rows))


def test_trie_of_few_rows(spark):
    assert prefix_trie.prefix_trie(talk(spark, conversations(1)).limit(0)).count() == 0
    rows = [(1, None, None, None)]  # the checksum of 1 takes its only turn away: no base conversation to put one there
    assert Counter(map(tuple, prefix_trie.prefix_trie(talk(spark, rows)).collect())) == Counter(plain_trie(rows))


def test_digests_of_many_ids_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 50)
    rows = [(bytes([k % 3]), k * 7) for k in range(400)]
    found = prefix_trie.ends_digests(spark.createDataFrame(rows, "seq binary, conv_id long").repartition(3)).collect()
    want = {bytes([s]): h(",".join(str(c) for q, c in rows if q == bytes([s]))) for s in range(3)}
    assert {bytes(r["seq"]): r["ends"] for r in found} == want and len(found) == 3


def test_medians_and_tree():
    assert sorted(prefix_trie.medians(11)) == list(range(11)) and list(prefix_trie.medians(7))[:3] == [3, 1, 5]
    tree = prefix_trie.TernaryTree()
    rows = sorted([[1], [1, 2], [1, 3], [2], [2, 9, 9], []])
    for i in prefix_trie.medians(len(rows)):
        tree.insert(rows[i], [1] * len(rows[i]), i)
    assert all(tree.end[tree.path(r)[-1]] == i for i, r in enumerate(rows)) and len(tree.walk()) == 7
