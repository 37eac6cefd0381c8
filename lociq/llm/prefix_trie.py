"""Prefix trie of conversations from ternary search trees over ranges of turn sequences.

Distinct turns are numbered, so a conversation is an array of numbers. Equal conversations become one row with
their count; the distinct sequences are sorted, and every `most` consecutive ones are a range. A task builds a
ternary search tree of its range, inserting medians first, and walks it without recursion, adding up members, leaves and
savings from the bottom. A range also gets the last sequence before it and the first after it: so it knows which of
its nodes other ranges share. These boundary nodes carry partial sums, which are merged by the digest of their prefix;
every node counts once as a child, a leaf or a textless start, in the range where it begins. All others are final at once.

Digests (SHA-256) stand for contents of turns, sequences and shared prefixes.

Null role or text: empty. Null turn: before all others; ties and repeated rows: by the digest of the turn. Null conv_id: such rows are
no conversation and are left out. Very long texts: digested and counted where they are, never moved. A conversation is one row of
numbers, 16 bytes a turn. Empty table: no node. Other columns are untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.ordering import ranked
from lociq.llm.session import keep, release
from lociq.llm.text import table

WORD = r"[^\x20\x09-\x0D]+"
NODE = "node binary, parent binary, parent_conv_id long, conv_id long, depth int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
CHUNK = 1 << 16


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of each row."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")
    return conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("digest"), words.alias("words"))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words) of each conversation: its turns as numbers, in order, and the words of each."""
    rows = keep(turns(conversations), "turns")
    names = keep(rows.groupBy("digest").agg(F.first("words").alias("words")).withColumn("id", F.monotonically_increasing_id()), "turn-names")
    named = rows.drop("words").join(names, "digest")
    laid = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "words"))).alias("t"))
    out = keep(laid.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words")), "sequences")
    release(rows, names)
    return out


def rebuilt(convs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with its first turns replaced by those of c - c % family; how many, the checksum of c says (below `most`)."""
    heads = convs.filter(F.pmod("conv_id", F.lit(family)) == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, most - 1).alias(f"head_{c}") for c in ("ids", "words")])
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    met = convs.withColumns({"base": F.col("conv_id") - F.pmod("conv_id", F.lit(family)), "h": h}).join(heads, "base", "left")
    none = F.array().cast("array<long>")
    return met.select("conv_id", *[F.concat(F.coalesce(F.slice(f"head_{c}", F.lit(1), F.col("h")), none), F.slice(c, F.col("h") + 1, F.size(c))).alias(c) for c in ("ids", "words")])


def ends_digests(members: DataFrame) -> DataFrame:
    """(seq, ends): SHA-256 of the decimal conv_ids of each sequence, ascending and joined by commas.

    A digest is one chain. Sorted ranges first turn their ids into text, in pieces of 64 KB; a sequence's pieces are
    then streamed through its digest in order, so that memory is a piece, whatever the number of its conversations.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, first, held, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            return table(seq=pa.array([seq], pa.binary()), first=[first], ids=[",".join(held)])

        for batch in batches:
            for s, c in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (s != seq or size >= CHUNK):
                    yield piece()
                    held, size = [], 0
                if not held:
                    seq, first = s, c
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, state = None, None
        for batch in batches:
            seqs, ends = [], []
            for s, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist()):
                if s == seq:
                    state.update(b",")
                else:
                    if state is not None:
                        seqs.append(seq)
                        ends.append(state.hexdigest())
                    seq, state = s, hashlib.sha256()
                state.update(ids.encode())
            yield table(seq=pa.array(seqs, pa.binary()), ends=pa.array(ends, pa.string()))
        if state is not None:
            yield table(seq=pa.array([seq], pa.binary()), ends=[state.hexdigest()])

    pieces = members.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(write, "seq binary, first long, ids string")
    return pieces.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(digest, "seq binary, ends string")


class TernaryTree:
    """A ternary search tree of sequences: node 0 is the root, every other node a turn with links to smaller, larger and next ones."""

    def __init__(self):
        self.key, self.low, self.high, self.next, self.words, self.end = [0], [-1], [-1], [-1], [0], [-1]

    def _new(self, key: int, words: int) -> int:
        for links, value in ((self.key, key), (self.low, -1), (self.high, -1), (self.next, -1), (self.words, words), (self.end, -1)):
            links.append(value)
        return len(self.key) - 1

    def insert(self, ids: list[int], words: list[int], row: int) -> None:
        node = 0
        for i, w in zip(ids, words):
            at = self.next[node]
            if at < 0:
                at = self.next[node] = self._new(i, w)
            while self.key[at] != i:
                side = self.low if i < self.key[at] else self.high
                if side[at] < 0:
                    side[at] = self._new(i, w)
                at = side[at]
            node = at
        self.end[node] = row

    def path(self, ids: list[int]) -> list[int]:
        """The nodes of a sequence that is in the tree, from the root."""
        found = [0]
        for i in ids:
            at = self.next[found[-1]]
            while self.key[at] != i:
                at = self.low[at] if i < self.key[at] else self.high[at]
            found.append(at)
        return found

    def walk(self) -> list[tuple[int, int, int]]:
        """(node, parent, depth), parents before children."""
        found, todo = [(0, -1, 0)], [(self.next[0], 0, 1)]
        while todo:
            node, parent, depth = todo.pop()
            if node < 0:
                continue
            found.append((node, parent, depth))
            todo += [(self.low[node], parent, depth), (self.high[node], parent, depth), (self.next[node], node, depth + 1)]
        return found


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each part before its halves."""
    todo = [(0, n)]
    for lo, hi in todo:
        if lo < hi:
            mid = (lo + hi) // 2
            todo += [(lo, mid), (mid + 1, hi)]
            yield mid


def shared(a: list[int] | None, b: list[int] | None) -> int:
    """The length of the common prefix, -1 where one of the two is missing."""
    if a is None or b is None:
        return -1
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def range_nodes(rows: list[dict], before: list[int] | None, after: list[int] | None) -> list[dict]:
    """The trie nodes of sorted sequences (ids, words, n, conv_id, ends) that stand between two others.

    Nodes shared with other ranges have a key in `node`, their parts to be summed. Nodes below them have a key in `parent`.
    """
    tree = TernaryTree()
    for i in medians(len(rows)):
        tree.insert(rows[i]["ids"], rows[i]["words"], i)
    left, right = shared(before, rows[0]["ids"]), shared(rows[-1]["ids"], after)
    names, begun, goes_on = {}, set(), set()  # names: keys of shared nodes; begun: those that begin in an earlier range
    for ids, upto, own in ((rows[0]["ids"], left, begun), (rows[-1]["ids"], right, goes_on)):
        name = hashlib.sha256(b"root").digest()
        for depth, node in enumerate(tree.path(ids[: max(upto, 0)])):
            if depth > upto:
                break
            if depth:
                name = hashlib.sha256(name + ids[depth - 1].to_bytes(8, "little", signed=True)).digest()
            names[node] = name
            own.add(node)
    order = tree.walk()
    size = len(order)
    n, conv, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    for node, parent, _ in reversed(order):
        row = tree.end[node]
        if row >= 0:
            n[node] += rows[row]["n"]
            conv[node] = rows[row]["conv_id"] if conv[node] is None else min(conv[node], rows[row]["conv_id"])
        if tree.next[node] < 0 and node not in goes_on:
            leaves[node] = 1
        saved[node] += tree.words[node] * (n[node] - (node not in begun))
        if parent >= 0:
            n[parent] += n[node]
            conv[parent] = conv[node] if conv[parent] is None else min(conv[parent], conv[node])
            children[parent] += node not in begun
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
    return [
        {"node": names.get(node), "parent": names.get(parent), "parent_conv_id": conv[parent] if parent >= 0 and parent not in names else None, "conv_id": conv[node], "depth": depth, "n_convs": n[node],
         "n_children": children[node], "n_leaves": leaves[node], "saved_tokens": saved[node], "ends": rows[tree.end[node]]["ends"] if tree.end[node] >= 0 else None}
        for node, parent, depth in order
    ]


def trie(members: DataFrame, most: int = 512) -> DataFrame:
    """All nodes of the trie of (conv_id, ids, words): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    most: sequences in a range.
    """
    seq = F.unhex(F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary"), 256))
    members = keep(members.withColumn("seq", seq), "members")
    ends = keep(ends_digests(members), "ends")
    distinct = members.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("ids").alias("ids"), F.first("words").alias("words"))
    placed = ranked(distinct.join(ends, "seq").drop("seq"), ["ids"], None, "sorted")
    own, last, first = F.expr(f"rank div {most}L"), F.col("rank") % most == most - 1, (F.col("rank") % most == 0) & (F.col("rank") > 0)
    to = F.array(F.struct(own.alias("range"), F.lit(0).alias("side")), F.when(last, F.struct((own + 1).alias("range"), F.lit(-1).alias("side"))), F.when(first, F.struct((own - 1).alias("range"), F.lit(1).alias("side"))))
    dealt = placed.withColumn("_to", F.explode(F.filter(to, lambda x: x.isNotNull()))).select("_to.*", "rank", "n", "conv_id", "ids", "words", "ends")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        side = {k: [r["ids"].tolist() for r in part.to_dict("records")] for k, part in rows[rows["side"] != 0].groupby("side")}
        inner = rows[rows["side"] == 0].sort_values("rank").to_dict("records")
        if not inner:  # the range after the last one: only a neighbour came here
            return pd.DataFrame(columns=[c.split()[0] for c in NODE.split(", ")])
        for r in inner:
            r["ids"], r["words"] = r["ids"].tolist(), r["words"].tolist()
        found = pd.DataFrame(range_nodes(inner, *[side.get(k, [None])[0] for k in (-1, 1)]))
        return found.astype({"parent_conv_id": "Int64"})

    nodes = keep(dealt.groupBy("range").applyInPandas(build, NODE), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = keep(nodes.filter("node IS NOT NULL").groupBy("node").agg(F.first("parent", ignorenulls=True).alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.max("ends").alias("ends")), "boundary")
    columns = ["parent", "parent_conv_id", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    whole = nodes.filter("node IS NULL").select(*columns).unionByName(merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    return whole.join(above, "parent", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, most: int = 512) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(sequences(conversations)), most)
