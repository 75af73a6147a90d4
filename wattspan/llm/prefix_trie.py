"""The trie of all conversation prefixes, from the sorted conversations and the longest common prefixes of neighbours.

1. *Order.* A turn is the SHA-256 of its role and text. Conversations are gathered in segments of ``SEGMENT`` turns;
   segments get names in their order, names are gathered again, until every conversation is one array of at most
   ``SEGMENT`` symbols. Sorting these arrays (equal ones by id) sorts the conversations, whatever their length.
2. *LCP.* The common prefix of neighbours is found on the names and refined down the levels.
3. *Cartesian tree.* All nearest smaller values of the LCP array, by blocks of ranks: inside a block with a stack;
   what has no smaller value in its block goes to the nearest block whose minimum is smaller (block minima, at
   most ``MOST_BLOCKS`` numbers), and to that block's suffix or prefix minima there. Positions with one LCP
   between the same bounds are one node: an interval of ranks and a depth.
4. *Depths.* A node stands for all depths above its parent's: these are the turns of the interval's first
   conversation, so nodes are expanded by a join with the stored turns.
5. *Aggregates.* Members, leaves and saved code points of a subtree are differences of prefix sums over ranks (of a
   suffix sum over depths in the first rank); least members come from block and partial minima.

No task holds a conversation, a group of copies or a subtree: joins are by id *and* segment or by rank, ids of
members that end at a node are joined by chunks and hashed as a stream.

Defined results: a null role or text is empty; turns with equal numbers are ordered by the digest of role and text;
rows with a null conversation id belong to no conversation and are left out; repeated rows are turns of their own;
one conversation is a path; an empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.llm.common import materialise
from wattspan.llm.ranking import join_ranges, key_ranges, numbered

#: Turns in a segment.
SEGMENT = 512
#: Ranks in a block at least; beyond MOST_BLOCKS blocks they grow, so block minima never exceed 16 MB.
BLOCK, MOST_BLOCKS = 1024, 1 << 20
#: Ids in one chunk of an end list.
CHUNK = 16384
NO_ENDS = hashlib.sha256(b"").hexdigest()
FAR = (1 << 63) - 1


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, token, chars``: what the trie needs of a turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", token.alias("token"), F.char_length(text).cast("long").alias("chars"))


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place ``pos`` (from 1) in their conversation, and the ranges each conversation touches."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    flat = numbered(tied, [F.col(c) for c in ("conv_id", "turn", "token", "_tie")], "_g", "_part", "trie-rows").drop("_tie", "turn")
    ranges = materialise(key_ranges(flat, ["conv_id"], "_g", "_part"), "trie-ranges")[0]
    placed = join_ranges(flat, ranges, ["conv_id"], "_part").withColumn("pos", F.col("_g") - F.col("start") + 1)
    return placed.select("conv_id", "_part", "pos", "token", "chars"), ranges


def as_given(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns`` (conv_id, pos, token, chars) and ``convs`` (conv_id, length) of the table as it is."""
    placed, ranges = _placed(turn_rows(conversations))
    return materialise(placed.drop("_part"), "trie-turns")[0], ranges.select("conv_id", F.col("size").alias("length")).distinct()


def with_shared_heads(conversations: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """As ``as_given``, each conversation c rebuilt: the first ``h = crc32(c) % heads`` turns of conversation
    ``c - c % group`` (all if it has fewer, none if there is none), then c's own turns after its first h."""
    placed, ranges = _placed(turn_rows(conversations))
    placed = materialise(placed, "trie-placed")[0]
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    sizes = ranges.select("conv_id", "size").distinct()
    lead = sizes.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("_there"))
    taken = F.least("h", F.coalesce("_there", F.lit(0).cast("long")))
    convs = materialise(lead.join(of_base, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")[0]
    first = placed.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "token", "chars")
    shared = convs.join(first, "base").where("pos <= h").select("conv_id", "pos", "token", "chars")
    moved = ranges.select("conv_id", "_part").join(convs.select("conv_id", (F.col("taken") - F.col("h")).alias("_by")), "conv_id")
    own = join_ranges(placed.where(F.col("pos") > h), moved, ["conv_id"], "_part").select("conv_id", (F.col("pos") + F.col("_by")).alias("pos"), "token", "chars")
    return materialise(shared.unionByName(own), "trie-turns")[0], convs.select("conv_id", "length")


def _common(x: Column, y: Column) -> Column:
    """How many symbols two arrays share from their beginning."""
    differs = F.array_position(F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b)), True)
    return F.when(differs == 0, F.size(x).cast("long")).otherwise(differs - 1)


def sorted_conversations(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``rank, conv_id, length, lcp`` (with the rank before; -1 at rank 0), ``run_start, run_size`` (of equal conversations)."""
    symbols = turns.select("conv_id", "pos", F.col("token").alias("sym"))
    levels: list[DataFrame] = []
    while True:
        inside = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda s: s["sym"])
        cut = symbols.groupBy("conv_id", F.floor((F.col("pos") - 1) / segment).alias("seg")).agg(inside.alias("syms"))
        levels.append(materialise(cut, "trie-segments")[0])
        if levels[-1].where("seg > 0").isEmpty():
            break
        named = numbered(levels[-1], [F.col(c) for c in ("syms", "conv_id", "seg")], "_g", "_part", "trie-names")
        symbols = join_ranges(named, key_ranges(named, ["syms"], "_g", "_part"), ["syms"], "_part").select("conv_id", (F.col("seg") + 1).alias("pos"), F.col("start").alias("sym"))
    top = levels.pop()
    none = F.array().cast(dict(top.dtypes)["syms"])
    whole = convs.join(top.where("seg = 0").drop("seg"), "conv_id", "left").withColumn("syms", F.coalesce("syms", none))
    ranked = numbered(whole, [F.col("syms"), F.col("conv_id")], "rank", "_part", "trie-ranked")
    runs = key_ranges(ranked, ["syms"], "rank", "_part").withColumnsRenamed({"start": "run_start", "size": "run_size"})
    ranked = join_ranges(ranked, runs, ["syms"], "_part")
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.col("conv_id").alias("_prev"), F.col("length").alias("_plen"), F.col("syms").alias("_psyms"))
    pairs = ranked.join(before, "rank", "left").withColumn("lcp", _common(F.col("syms"), F.col("_psyms"))).drop("syms", "_psyms", "_part")
    for k in range(len(levels) - 1, -1, -1):
        symbols_of = lambda c, k=k: F.ceil(F.col(c) / segment**k)
        mine = levels[k].select("conv_id", F.col("seg").alias("lcp"), F.col("syms").alias("_a"))
        theirs = levels[k].select(F.col("conv_id").alias("_prev"), F.col("seg").alias("lcp"), F.col("syms").alias("_b"))
        empty = F.array().cast(dict(levels[k].dtypes)["syms"])
        inner = _common(F.coalesce("_a", empty), F.coalesce("_b", empty))
        pairs = pairs.join(mine, ["conv_id", "lcp"], "left").join(theirs, ["_prev", "lcp"], "left")
        pairs = pairs.withColumn("lcp", F.least(F.col("lcp") * segment + inner, symbols_of("length"), symbols_of("_plen"))).drop("_a", "_b")
    lcp = F.when(F.col("rank") == 0, F.lit(-1).cast("long")).otherwise(F.col("lcp"))
    return materialise(pairs.select("rank", "conv_id", "length", lcp.alias("lcp"), "run_start", "run_size"), "trie-sorted")[0]


def _sums_before(df: DataFrame, value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` up to and with each ``rank``, by ``block`` and then over blocks."""
    inside = F.sum(value).over(Window.partitionBy("block").orderBy("rank"))
    sums = df.groupBy("block").agg(F.sum(value).alias("_s"))
    # At most MOST_BLOCKS rows.
    before = sums.select("block", F.coalesce(F.sum("_s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return df.withColumn("_in", inside).join(before, "block").withColumn(out, F.col("_before") + F.col("_in")).drop("_in", "_before")


class Minima:
    """Least values of ranges of an array, by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 ** len(self.rows) <= len(values):
            half = 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def least(self, a: int, b: int) -> int:
        """The least of ``values[a:b]``; FAR where there is none."""
        if a >= b:
            return FAR
        k = (b - a).bit_length() - 1
        return int(min(self.rows[k][a], self.rows[k][b - 2**k]))


def _smaller_before(values: list[int]) -> list[int]:
    """The nearest place before each with a smaller value, or -1."""
    stack: list[int] = []
    out = []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] >= v:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return out


def _record_rows(block: int, values: list[int], begin: int, step: int, least) -> list[dict]:
    """Places with a value below all that were passed on the way in from one end."""
    out, low = [], FAR
    for i in range(0, len(values))[::step]:
        if values[i] < low:
            low = values[i]
            out.append({"kind": "left" if step < 0 else "right", "block": block, "v": low, "at": begin + i, "least": least(i)})
    return out


WALKED = "kind string, block long, id long, v long, l long, l_block long, l_v long, r long, r_block long, r_v long, k long, at long, least long"


def _walk(block_lcp: np.ndarray, block_conv: np.ndarray, n: int):
    """The function that turns a block of sorted conversations into nodes, places of positions and minima from both ends."""

    def walk(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p, b = p.sort_values("rank"), int(key[0])
        lcp, begin = p["lcp"].tolist(), int(p["rank"].iloc[0])
        size = len(lcp)
        inside, blocks = Minima(p["conv_id"].to_numpy(dtype=np.int64)), Minima(block_conv)
        before = _smaller_before(lcp)
        after = [size - 1 - i if i >= 0 else -1 for i in _smaller_before(lcp[::-1])][::-1]
        nodes: dict[tuple[int, int, int], dict] = {}
        rows: list[dict] = []
        far: dict[tuple[int, int], int] = {}

        def block_with_less(v: int, step: int) -> int:
            """The nearest block on one side whose minimum is below ``v``, or -1."""
            if (v, step) not in far:
                rest = block_lcp[b + 1 :] if step > 0 else block_lcp[:b][::-1]
                hit = int(np.argmax(rest < v)) if len(rest) else 0
                far[v, step] = (b + step * (1 + hit)) if len(rest) and rest[hit] < v else -1
            return far[v, step]

        for i, v in enumerate(lcp):
            if v < 0:  # the first rank has none before it
                continue
            node = nodes.get((before[i], after[i], v))
            if node is None:
                node = nodes[before[i], after[i], v] = {"kind": "node", "block": b, "id": len(nodes), "v": v, "k": 0}
                first, last = max(before[i], 0), after[i] if after[i] >= 0 else size
                least = inside.least(first, last)
                if before[i] >= 0:
                    node |= {"l": begin + before[i], "l_v": lcp[before[i]]}
                else:
                    node["l_block"] = block_with_less(v, -1)  # rank 0 is less than any, so there is one
                    least = min(least, blocks.least(node["l_block"] + 1, b))
                if after[i] >= 0:
                    node |= {"r": begin + after[i], "r_v": lcp[after[i]]}
                else:
                    there = block_with_less(v, 1)
                    node |= {"r_block": there} if there >= 0 else {"r": n, "r_v": -1}
                    least = min(least, blocks.least(b + 1, there if there >= 0 else len(block_conv)))
                node["least"] = least
            node["k"] += 1
            rows.append({"kind": "place", "block": b, "id": node["id"], "at": begin + i})
        rows += nodes.values()
        rows += _record_rows(b, lcp, begin, -1, lambda i: inside.least(i, size))
        rows += _record_rows(b, lcp, begin, 1, lambda i: inside.least(0, i))
        columns = [c.split()[0] for c in WALKED.split(", ")]
        return pd.DataFrame({c: pd.array([r.get(c) for r in rows], dtype="string" if c == "kind" else "Int64") for c in columns})

    return walk


def _as_of(nodes: DataFrame, records: DataFrame, block: str) -> DataFrame:
    """For each block and value that ``nodes`` ask for, the record there with the greatest smaller value: the nearest
    place with a smaller value. ``_block, v, at, at_v, part``."""
    asked = nodes.where(F.col(block).isNotNull()).select(F.col(block).alias("_block"), "v").distinct().withColumn("_r", F.lit(None).cast("struct<at:bigint,at_v:bigint,part:bigint>"))
    known = records.select(F.col("block").alias("_block"), "v", F.struct("at", F.col("v").alias("at_v"), F.col("least").alias("part")).alias("_r"))
    # A value itself is not smaller: questions come before records of the same value.
    order = Window.partitionBy("_block").orderBy(F.col("v"), F.col("_r").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = asked.unionByName(known).withColumn("_f", F.last("_r", True).over(order)).where("_r IS NULL")
    return found.select("_block", "v", "_f.*")


def _sided(nodes: DataFrame, records: DataFrame, side: str) -> DataFrame:
    """Nodes with the bound that lies in another block."""
    found = _as_of(nodes, records, f"{side}_block").withColumnRenamed("_block", f"{side}_block")
    joined = nodes.join(found, [f"{side}_block", "v"], "left")
    values = {side: F.coalesce(side, "at"), f"{side}_v": F.coalesce(f"{side}_v", "at_v"), "least": F.least("least", "part")}
    return joined.withColumns(values).drop("at", "at_v", "part")


def intervals(ranked: DataFrame, n: int, block: int) -> DataFrame:
    """Nodes of the Cartesian tree and single conversations: ``l, r, top`` (depth), ``above`` (depth of the parent, -1 for none),
    ``splits`` (places where it is divided), ``least`` (member), ``parent_least``. ``ranked`` has ``block`` and ``next_lcp``."""
    mins = ranked.groupBy("block").agg(F.min("lcp"), F.min("conv_id")).orderBy("block").collect()  # at most MOST_BLOCKS rows
    block_lcp, block_conv = (np.array([r[i] for r in mins], dtype=np.int64) for i in (1, 2))
    walked = materialise(ranked.select("block", "rank", "lcp", "conv_id").groupBy("block").applyInPandas(_walk(block_lcp, block_conv, n), WALKED), "trie-walked")[0]
    kind = lambda k: walked.where(F.col("kind") == k)
    nodes = kind("node").drop("kind", "at")
    bound = materialise(_sided(_sided(nodes, kind("left"), "l"), kind("right"), "r").select("block", "id", "v", "l", "l_v", "r", "r_v", "k", "least"), "trie-bound")[0]
    merged = bound.groupBy("l", "r", "v").agg(F.sum("k").alias("splits"), F.min("least").alias("least"), F.first("l_v").alias("l_v"), F.first("r_v").alias("r_v"))
    tree = merged.select("l", (F.col("r") - 1).alias("r"), F.col("v").alias("top"), "splits", "least", "l_v", "r_v")
    tree = materialise(tree, "trie-merged")[0]
    zero = F.lit(0).cast("long")
    single = ranked.where(F.col("length") > F.greatest("lcp", "next_lcp")).select(F.col("rank").alias("l"), F.col("rank").alias("r"), F.col("length").alias("top"), zero.alias("splits"), F.col("conv_id").alias("least"), F.col("lcp").alias("l_v"), F.col("next_lcp").alias("r_v"))
    # The parent is the node of the greater border.
    both = tree.unionByName(single).withColumn("above", F.greatest("l_v", "r_v")).withColumn("_at", F.when(F.col("l_v") >= F.col("r_v"), F.col("l")).otherwise(F.col("r") + 1))
    least_of = bound.select("block", "id", "l", F.col("v").alias("top")).join(tree.select("l", "top", F.col("least").alias("parent_least")), ["l", "top"]).drop("l", "top")
    at = kind("place").select("block", "id", F.col("at").alias("_at")).join(least_of, ["block", "id"]).select("_at", "parent_least")
    return both.join(at, "_at", "left").select("l", "r", "top", "above", "splits", "least", "parent_least")


def _end_digests(ranked: DataFrame, chunk: int) -> DataFrame:
    """``l, ends``: the digest of the ids of equal conversations, by the first one's rank."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "conv_id"))), lambda s: s["conv_id"].cast("string"))
    chunks = ranked.groupBy("run_start", F.floor(F.col("rank") / chunk).alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, state = None, None
        for batch in batches:
            starts, out = batch.column(0).to_pylist(), []
            for at, text in zip(starts, batch.column(1), strict=True):
                if at != run:
                    if run is not None:
                        out.append((run, state.hexdigest()))
                    run, state = at, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_py().encode())
            yield pa.record_batch([pa.array([r for r, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["l", "ends"])
        if run is not None:
            yield pa.record_batch([pa.array([run], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["l", "ends"])

    ordered = chunks.repartition("run_start").sortWithinPartitions("run_start", "chunk").select("run_start", "ids")
    return ordered.mapInArrow(digest, "l long, ends string")


def prefix_trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row a distinct prefix: ``conv_id`` (least member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    ranked = sorted_conversations(turns, convs, segment)
    n = ranked.count()
    block = max(block, -(-n // MOST_BLOCKS))
    following = ranked.select((F.col("rank") - 1).alias("rank"), F.col("lcp").alias("_next"))
    ranked = ranked.join(following, "rank", "left").withColumn("next_lcp", F.coalesce("_next", F.lit(-1).cast("long"))).drop("_next").withColumn("block", F.floor(F.col("rank") / block))
    ranked = ranked.withColumn("leaf", (F.col("next_lcp") < F.col("length")).cast("long"))
    ranked = materialise(_sums_before(ranked, "leaf", "leaves"), "trie-leaves")[0]

    first = ranked.select(F.col("rank").alias("l"), F.col("conv_id").alias("first"), F.col("length").alias("_length"), "run_size", (F.col("leaves") - F.col("leaf")).alias("_l_leaves"))
    last = ranked.select(F.col("rank").alias("r"), F.col("leaves").alias("_r_leaves"))
    spans = intervals(ranked, n, block).join(first, "l").join(last, "r").join(_end_digests(ranked, chunk), "l", "left")
    ended = F.col("_length") == F.col("top")
    spans = spans.select(
        "l", "r", "top", "above", "least", "parent_least", "first",
        (F.col("splits") + 1 - F.when(ended, F.col("run_size")).otherwise(0)).alias("children"),
        (F.col("_r_leaves") - F.col("_l_leaves")).alias("n_leaves"), F.when(ended, F.col("ends")).otherwise(NO_ENDS).alias("ends"),
    )
    spans = materialise(spans, "trie-spans")[0]

    seg = lambda c: F.floor((c - 1) / segment)
    cut = spans.where("top > 0").withColumn("seg", F.explode(F.sequence(seg(F.greatest(F.col("above") + 1, F.lit(1))), seg(F.col("top")))))
    at = turns.select(F.col("conv_id").alias("first"), seg(F.col("pos")).alias("seg"), F.col("pos").alias("depth"), "chars")
    below = cut.join(at, ["first", "seg"]).where("depth > above AND depth <= top")
    root = spans.where("above = -1").withColumns({"seg": F.lit(0).cast("long"), "depth": F.lit(0).cast("long"), "chars": F.lit(0).cast("long")})
    nodes = below.unionByName(root).withColumn("n_convs", F.col("r") - F.col("l") + 1)
    nodes = materialise(nodes.withColumn("_w", (F.col("n_convs") - 1) * F.col("chars")), "trie-nodes")[0]

    # Saved code points: those of later ranks of the interval, and those of the first rank at this depth and below.
    own = nodes.groupBy("l", "seg").agg(F.sum("_w").alias("_s"))
    later = F.coalesce(F.sum("_s").over(Window.partitionBy("l").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_rank = ranked.select("rank", "block").join(own.groupBy(F.col("l").alias("rank")).agg(F.sum("_s").alias("_s")), "rank", "left").withColumn("_s", F.coalesce("_s", F.lit(0).cast("long")))
    saved = materialise(_sums_before(by_rank.withColumnRenamed("_s", "_v"), "_v", "_upto").select("rank", "_upto"), "trie-saved")[0]
    wide = spans.where("r > l").select("l", "r", "top", "above")
    rest = wide.join(saved.withColumnsRenamed({"rank": "l", "_upto": "_l_upto"}), "l").join(saved.withColumnsRenamed({"rank": "r", "_upto": "_r_upto"}), "r")
    low = F.when(F.col("above") < 1, F.lit(0).cast("long")).otherwise(seg(F.col("above") + 1))
    tails = rest.select("l", "top", (F.col("_r_upto") - F.col("_l_upto")).alias("_tail"), F.explode(F.sequence(low, F.greatest(seg(F.col("top")), F.lit(0).cast("long")))).alias("seg"))
    more = tails.join(own.select("l", "seg", later.alias("_later")), ["l", "seg"]).select("l", "top", "seg", (F.col("_tail") + F.col("_later")).alias("_more"))
    here = F.sum("_w").over(Window.partitionBy("l", "seg").orderBy(F.desc("depth")))
    found = nodes.withColumn("_here", here).join(more, ["l", "top", "seg"], "left")
    last_turn = F.col("depth") == F.col("top")
    return found.select(
        F.col("least").alias("conv_id"), "depth",
        F.when(F.col("depth") == 0, None).when(F.col("depth") - 1 > F.col("above"), F.col("least")).otherwise(F.col("parent_least")).alias("parent_conv_id"),
        "n_convs", F.when(last_turn, F.col("children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        F.when(F.col("n_convs") == 1, F.lit(0)).otherwise(F.col("_here") + F.col("_more")).cast("long").alias("saved_tokens"),
        F.when(last_turn, F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"),
    )
