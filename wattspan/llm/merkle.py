"""Merkle manifest of a table: one tree a source, and one tree over the sources' roots.

Leaves are hashed by Spark's own functions, numbered in the order of source and id, and cut into aligned blocks of
``fanout ** depth`` leaves. A block is one contiguous numpy matrix of 64-byte hex digests: its rows are hashed ``fanout``
at a time, level by level, and every sibling is found by index arithmetic. Roots of blocks are the leaves of the
next round, so any number of leaves ends in ``log(n) / log(block)`` rounds; what a block needs from above (the
siblings of its ancestors) comes down once a block, not once a leaf.

Defined results: a null field is ``-``; a null source is a source of its own and the first; null ids come first and
are never tampered with; rows that repeat an id are leaves of their own, ordered by digest; a source with one row has
that leaf as its root; an empty table gives no rows. Columns that the leaf does not name are ignored. A text of any
length is hashed by one row function.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspan.llm.common import materialise
from wattspan.llm.ranking import join_ranges, key_ranges, numbered

FANOUT = 3
#: Levels in a block: 3 ** 7 leaves are 140 kB of hex digests, and a source of any size is many blocks.
BLOCK_LEVELS = 7
#: Fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64


def field_text(c: Column) -> Column:
    """A field with its length before it, so that two rows never spell the same input."""
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(c) for c in fields]), 256))


def levels_to_one(n: int, fanout: int) -> int:
    """How often ``n`` nodes are grouped until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


class Block:
    """The levels of one aligned block: ``level[t]`` is the matrix of hex digests after ``t`` groupings."""

    def __init__(self, digests: list[bytes], n: int, fanout: int, depth: int):
        self.fanout = fanout
        self.level = [np.frombuffer(b"".join(d.hex().encode() for d in digests), dtype=np.uint8).reshape(-1, HEX)]
        for _ in range(min(depth, levels_to_one(n, fanout))):
            self.level.append(self._grouped(self.level[-1]))
        self._bytes = [m.tobytes() for m in self.level]

    def _grouped(self, m: np.ndarray) -> np.ndarray:
        whole = len(m) // self.fanout * self.fanout
        rows = m[:whole].reshape(-1, self.fanout * HEX)
        out = [hashlib.sha256(row).hexdigest() for row in rows]
        if whole < len(m):
            out.append(hashlib.sha256(m[whole:].reshape(-1)).hexdigest())
        return np.frombuffer("".join(out).encode(), dtype=np.uint8).reshape(-1, HEX)

    @property
    def root(self) -> bytes:
        return bytes.fromhex(self._bytes[-1].decode())

    def path(self, i: int) -> list[str]:
        """Left and right siblings of leaf ``i`` at every level below the block's root, as joined hex digests."""
        out = []
        for b in self._bytes[:-1]:
            first = i - i % self.fanout
            last = min(first + self.fanout, len(b) // HEX)
            out += [b[first * HEX : i * HEX].decode(), b[(i + 1) * HEX : last * HEX].decode()]
            i //= self.fanout
        return out


def folded(digest: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        digest = hashlib.sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def _block_of(p: pd.DataFrame, fanout: int, depth: int) -> Block:
    return Block(list(p["digest"]), int(p["size"].iloc[0]), fanout, depth)


def _climb(nodes: DataFrame, fanout: int, depth: int, name: str) -> DataFrame:
    """Roots of the blocks of ``tree, idx, size, digest``: the nodes of the next round."""
    width = fanout**depth

    def root(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx")
        size = int(p["size"].iloc[0])
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "size": [-(-size // width)], "digest": [_block_of(p, fanout, depth).root]})

    cut = nodes.select("tree", "idx", "size", "digest", F.floor(F.col("idx") / F.lit(width)).alias("block"))
    up = cut.groupBy("tree", "block").applyInPandas(root, "tree long, idx long, size long, digest binary")
    return materialise(up, name)[0]


def _descend(nodes: DataFrame, above: DataFrame, fanout: int, depth: int, name: str) -> DataFrame:
    """``tree, idx, path`` of nodes: siblings inside the block, then the path of the block's root (``above``)."""
    width = fanout**depth

    def paths(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx")
        block, upper = _block_of(p, fanout, depth), list(q["path"].iloc[0])
        return pd.DataFrame({"tree": p["tree"], "idx": p["idx"], "path": [block.path(i) + upper for i in range(len(p))]})

    cut = nodes.select("tree", "idx", "size", "digest", F.floor(F.col("idx") / F.lit(width)).alias("block"))
    down = cut.groupBy("tree", "block").cogroup(above.groupBy("tree", "idx")).applyInPandas(paths, "tree long, idx long, path array<string>")
    return materialise(down, name)[0]


def _rounds(nodes: DataFrame, fanout: int, depth: int, name: str) -> list[DataFrame]:
    """``nodes`` and the tables above it, up to one node a tree."""
    tables = [nodes]
    while True:
        tables.append(_climb(tables[-1], fanout, depth, name))
        if tables[-1].where("size > 1").isEmpty():
            return tables


def _paths_above(tables: list[DataFrame], top: DataFrame, fanout: int, depth: int, name: str) -> DataFrame:
    """Paths of the nodes of ``tables[1]``, given those of the last table's (``tree, idx, path``)."""
    for nodes in reversed(tables[1:-1]):
        top = _descend(nodes, top, fanout, depth, name)
    return top


def manifest(docs: DataFrame, tampered: Column, tampered_text: Column, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", tree: str = "source", text: str = "text", fanout: int = FANOUT, depth: int = BLOCK_LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    The leaf of rows for which ``tampered`` holds is made again with ``tampered_text`` and folded with the original
    siblings; all other columns are those of the untampered table.
    """
    changed = leaf([tampered_text if c == text else F.col(c) for c in fields])
    digests = docs.select(F.col(key).alias("doc_id"), F.col(tree).alias("source"), leaf([F.col(c) for c in fields]).alias("digest"), F.when(tampered, changed).alias("other"))
    # Equal rows have equal digests; their places in the scan keep many of them from one range.
    rows = numbered(digests.withColumn("_tie", F.monotonically_increasing_id()), [F.col(c) for c in ("source", "doc_id", "digest", "_tie")], "_g", "_part", "merkle-leaves").drop("_tie")
    placed = join_ranges(rows, key_ranges(rows, ["source"], "_g", "_part"), ["source"], "_part")
    # A source's first number names it, and orders the sources.
    leaves = materialise(placed.select(F.col("start").alias("tree"), (F.col("_g") - F.col("start")).alias("idx"), "size", "digest", "other", "doc_id"), "merkle-placed")[0]

    own = _rounds(leaves, fanout, depth, "merkle-own")
    subroots = own[-1].select(F.col("tree").alias("source_at"), "digest")
    ranked = numbered(subroots, [F.col("source_at")], "idx", "_part", "merkle-sources")
    size = F.lit(ranked.count()).cast("long")
    nodes = materialise(ranked.select(F.lit(0).cast("long").alias("tree"), "idx", size.alias("size"), "digest", "source_at"), "merkle-subroots")[0]
    over = _rounds(nodes, fanout, depth, "merkle-over")
    summit = over[-1].select("tree", "idx", F.array().cast("array<string>").alias("path"))
    shared = _descend(nodes, _paths_above(over, summit, fanout, depth, "merkle-over-paths"), fanout, depth, "merkle-shared")
    of_source = nodes.join(shared.select("idx", "path"), "idx").select(F.col("source_at").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.lower(F.hex("digest")).alias("subroot"))
    top = of_source.select("tree", "idx", "path")
    above = _paths_above(own, top, fanout, depth, "merkle-own-paths")
    summits = over[-1].select(F.lower(F.hex("digest"))).take(1)  # one digest, none of an empty table
    root = summits[0][0] if summits else ""
    named = above.join(of_source.select("tree", "subroot"), "tree")

    width = fanout**depth

    def proofs(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx")
        block, upper = _block_of(p, fanout, depth), list(q["path"].iloc[0])
        subroot = q["subroot"].iloc[0]
        hashes, folds = [], []
        for i, (digest, other) in enumerate(zip(p["digest"], p["other"], strict=True)):
            path = block.path(i) + upper
            hashes.append(hashlib.sha256("".join(path).encode()).hexdigest())
            folds.append(folded((digest if other is None else other).hex(), path))
        own_leaf = [d.hex() for d in p["digest"]]
        return pd.DataFrame({"doc_id": p["doc_id"], "leaf": own_leaf, "subroot": subroot, "root": root, "proof_sha256": hashes, "folded_root": folds, "verified": [f == root for f in folds]})

    # Ids as text on the way through pandas, which would make a long beside a null a double.
    kind = dict(docs.dtypes)[key]
    cut = leaves.select("tree", "idx", "size", "digest", "other", F.col("doc_id").cast("string").alias("doc_id"), F.floor(F.col("idx") / F.lit(width)).alias("block"))
    out = cut.groupBy("tree", "block").cogroup(named.groupBy("tree", "idx")).applyInPandas(proofs, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
