"""Merkle manifest of a table by a midstate tree.

Leaves are digests of rows, ordered within their group; every `fanout` consecutive nodes become a parent until one
is left, the group's subroot; subroots, in the order of their groups, become the root in the same way. A parent
keeps a copy of its hash state before each child's slot. A changed child is folded by resuming the state before
its slot with the new digest and the siblings to its right alone; nothing on its left is hashed again.

Nodes are handled in chunks of fanout ^ LEVELS consecutive ones, each a whole subtree in one task: upwards every
chunk gives one node of the next table, downwards it gets the siblings between it and the root. So the tables
shrink by the size of a chunk each round, and no task holds more than a chunk, however large a group is.

Null in a leaf's field: the letter `-`. Null group: a group of its own, the first. Null ids: first in their group,
never tampered with. Ties (repeated ids): in the order of their leaves; equal rows are equal leaves. Very long texts: hashed
whole. A group of one row: its leaf is the subroot. Empty table: empty result. Other columns are untouched.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.ordering import ranked
from lociq.llm.session import keep

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
LEVELS = 9

NODE = "g string, idx long, total long, digest string"
PATH = "g string, idx long, before array<string>, after array<string>, subroot string, root string"


def leaf(fields: dict[str, Column]) -> Column:
    """SHA-256, in hexadecimal, of the fields in their order: `-` for null, else byte count, colon, value."""
    items = []
    for value in fields.values():
        text = value.cast("string")
        items.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*items).cast("binary"), 256)


class Parent:
    """A node with a copy of its hash state before each child."""

    __slots__ = ("children", "digest", "states")

    def __init__(self, children: list[bytes]):
        state, self.children, self.states = hashlib.sha256(), children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()


def resume(state, child: bytes, after: bytes) -> bytes:
    """The parent's digest with child in the slot before which state was kept; after: the siblings to its right."""
    state = state.copy()
    state.update(child)
    state.update(after)
    return state.hexdigest().encode()


def subtree(nodes: list[bytes], fanout: int, levels: int) -> list[list[Parent]]:
    """The parents of each level above nodes."""
    found = []
    for _ in range(levels):
        found.append([Parent(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)])
        nodes = [p.digest for p in found[-1]]
    return found


def way_up(tree: list[list[Parent]], i: int, fanout: int) -> tuple[list[bytes], list[bytes], list]:
    """Siblings before and after node i at each level of its subtree, and the states kept before its slots."""
    before, after, states = [], [], []
    for parents in tree:
        parent, slot = parents[i // fanout], i % fanout
        before.append(b"".join(parent.children[:slot]))
        after.append(b"".join(parent.children[slot + 1 :]))
        states.append(parent.states[slot])
        i //= fanout
    return before, after, states


def _levels(total: int, fanout: int, most: int) -> int:
    """Levels from `total` nodes to one, `most` of them at most."""
    found = 0
    while total > 1 and found < most:
        total, found = -(-total // fanout), found + 1
    return found


def _climb(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The nodes `levels` higher: one for each chunk."""
    size = fanout**levels

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        first, total = rows.iloc[0], int(rows["total"].iloc[0])
        digests = [d.encode() for d in rows["digest"]]
        tree = subtree(digests, fanout, _levels(total, fanout, levels))
        top = tree[-1][0].digest if tree else digests[0]
        return pd.DataFrame({"g": [first["g"]], "idx": [first["idx"] // size], "total": [-(-total // size)], "digest": [top.decode()]})

    return nodes.groupBy("g", F.expr(f"idx div {size}L").alias("_chunk")).applyInPandas(up, NODE)


def _descend(nodes: DataFrame, paths: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The paths of nodes, from those of their chunks."""
    size = fanout**levels

    def down(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, above = rows.sort_values("idx"), above.iloc[0]
        tree = subtree([d.encode() for d in rows["digest"]], fanout, _levels(int(rows["total"].iloc[0]), fanout, levels))
        found = [way_up(tree, i, fanout) for i in range(len(rows))]
        sides = [[[s.decode() for s in f[k]] + list(above[name]) for f in found] for k, name in ((0, "before"), (1, "after"))]
        return pd.DataFrame({"g": rows["g"], "idx": rows["idx"], "before": sides[0], "after": sides[1], "subroot": above["subroot"], "root": above["root"]})

    chunked = nodes.groupBy("g", F.expr(f"idx div {size}L").alias("_chunk"))
    return chunked.cogroup(paths.groupBy("g", F.col("idx").alias("_chunk"))).applyInPandas(down, PATH)


def _rounds(nodes: DataFrame, most: int, fanout: int, levels: int) -> list[DataFrame]:
    """Tables of nodes, from the given one to that with one node a group."""
    found = [nodes]
    while most > 1 or len(found) < 2:
        found.append(keep(_climb(found[-1], fanout, levels), "nodes"))
        most = -(-most // fanout**levels)
    return found


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", fanout: int = FANOUT, levels: int = LEVELS, proofs: bool = False) -> DataFrame:
    """One row a document: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    changed gives the columns that someone has altered since: folded_root stands on the leaf of the altered row and the
    original siblings. proof_sha256 is the digest of all siblings from the leaf to the root. With proofs, also
    claimed (the altered leaf) and before and after: the siblings of each level on either side, in hexadecimal.
    """
    own = {f: F.col(f"`{f}`") for f in fields}
    g = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # null before all others, the rest bytewise
    rows = docs.select(F.col(f"`{key}`").alias("key"), g.alias("g"), leaf(own).alias("digest"), leaf(own | (changed or {})).alias("claimed"))
    placed = keep(ranked(rows, ["key", "digest"], "g", "leaves").withColumnRenamed("rank", "idx"), "placed")
    rounds = _rounds(placed.select("g", "idx", "total", "digest"), placed.agg(F.max("total")).first()[0] or 0, fanout, levels)
    subroots = ranked(rounds[-1].select("g", "digest"), ["g"], None, "subroots")
    subroots = keep(subroots.select(F.col("g").alias("name"), F.lit("").alias("g"), F.col("rank").alias("idx"), "total", "digest"), "subroots-placed")
    upper = _rounds(subroots.drop("name"), subroots.count(), fanout, levels)
    none = F.array().cast("array<string>")
    paths = upper[-1].select("g", "idx", none.alias("before"), none.alias("after"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(upper[:-1]):
        paths = keep(_descend(nodes, paths, fanout, levels), "upper-paths")
    paths = subroots.join(paths.drop("g", "subroot"), "idx").select(F.col("name").alias("g"), F.lit(0).cast("long").alias("idx"), "before", "after", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(rounds[1:-1]):
        paths = keep(_descend(nodes, paths, fanout, levels), "paths")
    size = fanout**levels
    kind = placed.schema["key"].dataType.simpleString()

    def fold(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, above = rows.sort_values("idx"), above.iloc[0]
        tree = subtree([d.encode() for d in rows["digest"]], fanout, _levels(int(rows["total"].iloc[0]), fanout, levels))
        higher = [s.encode() for s in above["before"]], [s.encode() for s in above["after"]]
        states = [hashlib.sha256(s) for s in higher[0]]  # those of the chunk's ancestors, once for all its leaves
        rest = b"".join(a + b for a, b in zip(*higher))
        folded, digest, sides = [], [], ([], [])
        for i, node in enumerate(d.encode() for d in rows["claimed"]):
            before, after, kept = way_up(tree, i, fanout)
            for state, right in zip(kept + states, after + higher[1]):
                node = resume(state, node, right)
            folded.append(node.decode())
            digest.append(hashlib.sha256(b"".join(a + b for a, b in zip(before, after)) + rest).hexdigest())
            if proofs:
                for side, here, up in zip(sides, (before, after), higher):
                    side.append([s.decode() for s in here + up])
        out = pd.DataFrame({"key": rows["key"], "leaf": rows["digest"], "subroot": above["subroot"], "root": above["root"], "proof_sha256": digest, "folded_root": folded})
        out["verified"] = out["folded_root"] == out["root"]
        return out.assign(claimed=rows["claimed"], before=sides[0], after=sides[1]) if proofs else out

    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", claimed string, before array<string>, after array<string>" if proofs else "")
    chunked = placed.groupBy("g", F.expr(f"idx div {size}L").alias("_chunk"))
    return chunked.cogroup(paths.groupBy("g", F.col("idx").alias("_chunk"))).applyInPandas(fold, schema).withColumnRenamed("key", key)


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of documents where 7 divides the checksum of an id: n_chars of these has grown by 1."""
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, {"n_chars": F.when(bad, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
