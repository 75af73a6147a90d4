"""Near-duplicate vectors by a pivot-permutation index.

Pivots are a bounded sample of the vectors of a label. Every vector is described by its ``DEPTH`` nearest
pivots in order, and stands in the inverted lists of those pivots. Two vectors are candidates if they share
at least ``SHARED`` of them, counted in the list of the first pivot they share, so each pair is verified
once, by cosine in double precision; those that reach the threshold are links.

Equal vectors of a label are one class with a count before anything else, so a group of copies of any
size is one row. A list longer than ``BLOCK`` is cut into blocks and each pair of blocks is a task of its
own. Tasks return counts of links and a spanning forest of what they linked, never pairs, so output grows
with the vectors and not with the squares of clusters.

Null labels, and vectors that are null, empty, zero or hold a null, NaN or infinity, link with nothing.
Within a label, vectors of different lengths never link. Rows that repeat an id are separate vectors with
the same id; null ids are counted in others' links but their own component is null. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspan.llm.common import materialise
from wattspan.llm.components import components

#: Pivots of a label: so many at most, and one for so many vectors.
MOST_PIVOTS = 512
LEAST_PIVOTS = 32
VECTORS_A_PIVOT = 24
#: Nearest pivots that describe a vector, and those that candidates share.
DEPTH = 8
SHARED = 3
#: No two pivots are closer: pivots from one cluster would describe its vectors by chance.
PIVOT_COSINE = 0.7
BLOCK = 2048
#: Bytes of vectors that are multiplied together when pairs are verified.
PAIR_BYTES = 64_000_000


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.col(label_col).alias("label"))
    return rows.where(F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))


def choose_pivots(classes: DataFrame) -> dict:
    """(label, dimensions) -> matrix of unit pivots; bounded for each label by ``MOST_PIVOTS``.

    From a sample of twice as many classes, in the order of their hashes, those are taken that are not
    close to an earlier one.
    """
    sized = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    wanted = F.least(F.lit(MOST_PIVOTS), F.greatest(F.lit(LEAST_PIVOTS), F.col("n") / VECTORS_A_PIVOT))
    rows = classes.select("label", F.size("v").alias("dim"), "v", "class").join(sized, ["label", "dim"])
    share = F.pmod(F.xxhash64("class", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where(share <= 2 * wanted / F.col("n") + 8 / F.col("n")).select("label", "dim", "v", wanted.cast("int").alias("wanted"), share.alias("share"))
    out: dict = {}
    for r in sorted(picked.collect(), key=lambda r: (r["share"], r["v"])):
        out.setdefault((r["label"], r["dim"], r["wanted"]), []).append(r["v"])
    return {k[:2]: _apart(_unit(np.array(v)), max(1, k[2])) for k, v in out.items()}


def _apart(m: np.ndarray, most: int) -> np.ndarray:
    chosen = m[:1]
    for v in m[1:]:
        if len(chosen) == most:
            break
        if (chosen @ v).max() < PIVOT_COSINE:
            chosen = np.concatenate([chosen, v[None]])
    return chosen


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def inverted_lists(classes: DataFrame, pivots: dict) -> DataFrame:
    """One row for a class and each of its nearest pivots."""
    sent = classes.sparkSession.sparkContext.broadcast(pivots)
    schema = classes.select("label", "class", "count", "v").schema.add("near", T.ArrayType(T.IntegerType())).add("pivot", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("label", "class", "count", "v", "near", "pivot")}
            rows = batch.to_pydict()
            groups: dict = {}
            for i, (label, v) in enumerate(zip(rows["label"], rows["v"], strict=True)):
                groups.setdefault((label, len(v)), []).append(i)
            for key, at in groups.items():
                own = sent.value.get(key)
                sims = _unit(np.array([rows["v"][i] for i in at])) @ own.T if own is not None else np.zeros((len(at), 1))
                near = np.argsort(-sims, axis=1, kind="stable")[:, :DEPTH]
                for i, p in zip(at, near.tolist(), strict=True):
                    for pivot in p:
                        for k in ("label", "class", "count", "v"):
                            cols[k].append(rows[k][i])
                        cols["near"].append(p)
                        cols["pivot"].append(pivot)
            types = [batch.schema.field(k).type for k in ("label", "class", "count", "v")] + [pa.list_(pa.int32()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols.values(), types, strict=True)], names=list(cols))

    return classes.select("label", "class", "count", "v").mapInArrow(run, schema)


def _links(ids: np.ndarray, counts: np.ndarray, unit: np.ndarray, near: np.ndarray, pivot: int, left: np.ndarray, right: np.ndarray, threshold: float, found: list) -> None:
    """Verified pairs between the rows ``left`` and ``right`` of one list."""
    shape = int(near.max()) + 1
    inside = np.zeros((len(ids), shape), np.float32)
    np.put_along_axis(inside, near, 1, axis=1)
    shared = inside[left] @ inside[right].T
    ok = shared >= min(SHARED, near.shape[1])
    # The pair belongs to the list of the least pivot that both share.
    low = inside[:, :pivot]
    if pivot:
        ok &= (low[left] @ low[right].T) == 0
    ok &= ids[left][:, None] < ids[right][None, :]
    i, j = np.nonzero(ok)
    step = max(1, PAIR_BYTES // (16 * unit.shape[1]))
    for at in range(0, len(i), step):
        a, b = left[i[at : at + step]], right[j[at : at + step]]
        cosine = np.einsum("ij,ij->i", unit[a], unit[b])
        good = cosine >= threshold
        found.append(np.stack([a[good], b[good]]))


def link_lists(lists: DataFrame, threshold: float) -> DataFrame:
    """Rows ``kind, a, b``: ``n`` (class, links to other classes' vectors) and ``edge`` (spanning edges)."""
    place = F.row_number().over(Window.partitionBy("label", "dim", "pivot", "salt").orderBy("class")) - 1
    salted = lists.withColumn("dim", F.size("v")).withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(16)).cast("int"))
    # Each salt puts a sixteenth of a block's rows into each block.
    numbered = salted.withColumn("own", F.floor(place / (BLOCK // 16)).cast("int"))
    sizes = numbered.groupBy("label", "dim", "pivot").agg((F.max("own") + 1).cast("int").alias("blocks"))
    sizes, _ = materialise(sizes, "list-blocks")
    placed = numbered.join(sizes, ["label", "dim", "pivot"])
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other"))
    cols = ["label", "dim", "pivot", "b1", "b2", "own", "class", "count", "v", "near"]

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("class").to_numpy()
        counts = table.column("count").to_numpy()
        unit = _unit(np.array(table.column("v").to_pylist()))
        near = np.array(table.column("near").to_pylist())
        own = table.column("own").to_numpy()
        b1, b2, pivot = (table.column(k)[0].as_py() for k in ("b1", "b2", "pivot"))
        found: list = []
        lefts, rights = np.flatnonzero(own == b1), np.flatnonzero(own == b2)
        for at in range(0, len(lefts), 1024):
            left = lefts[at : at + 1024]
            _links(ids, counts, unit, near, pivot, left, rights, threshold, found)
            if b1 != b2:  # the order of ids decides which of a pair is on the left
                _links(ids, counts, unit, near, pivot, rights, left, threshold, found)
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        n = np.bincount(pairs[0], counts[pairs[1]], len(ids)) + np.bincount(pairs[1], counts[pairs[0]], len(ids)) if pairs.size else np.zeros(len(ids))
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        edges = []
        for a, b in zip(*pairs.tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[rb] = ra
                edges.append((a, b))
        some = np.flatnonzero(n)
        e = np.array(edges, np.int64).reshape(-1, 2)
        kind = ["n"] * len(some) + ["edge"] * len(e)
        a = np.concatenate([ids[some], ids[e[:, 0]]])
        b = np.concatenate([n[some].astype(np.int64), ids[e[:, 1]]])
        return pa.table([pa.array(kind, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    return spread.select(*cols).groupBy("label", "dim", "pivot", "b1", "b2").applyInArrow(run, "kind string, a bigint, b bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    rows, _ = materialise(usable(vectors, id_col, vector_col, label_col).withColumn("key", F.xxhash64("label", "v")), "vectors")
    # ``class`` numbers equal vectors of a label by a hash; ``first`` is their least id.
    # Should two vectors ever share one, the run fails rather than link them unverified.
    same = F.when(F.min("v") == F.max("v"), F.min("v")).otherwise(F.raise_error(F.lit("two vectors have one hash")).cast("array<double>"))
    grouped = rows.groupBy("key", "label").agg(F.count("*").alias("count"), F.min("vec_id").alias("first"), same.alias("v"))
    classes, _ = materialise(grouped.withColumnRenamed("key", "class"), "vector-classes")
    found, _ = materialise(link_lists(inverted_lists(classes, choose_pivots(classes)), threshold), "vector-links")
    n = found.where("kind = 'n'").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("others"))
    roots, _ = materialise(components(found.where("kind = 'edge'")).select("node", F.col("root").alias("home")), "vector-roots")
    joined = classes.select("class", "count", "first").join(n, "class", "left").join(roots, F.col("class") == F.col("node"), "left").withColumn("home", F.coalesce("home", "class"))
    least = joined.groupBy("home").agg(F.min("first").alias("component_id"))
    least, _ = materialise(least, "vector-components")
    classes_out, _ = materialise(joined.join(least, "home").select("class", (F.coalesce("others", F.lit(0)) + F.col("count") - 1).alias("n_links"), "component_id"), "class-results")
    linked = rows.select("vec_id", F.col("key").alias("class")).join(classes_out, "class")
    alone = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    alone = alone.where(F.col("label").isNull() | ~F.coalesce(fine, F.lit(False)))
    both = linked.select("vec_id", "n_links", "component_id").unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    component = F.when(F.col("vec_id").isNotNull(), F.col("component_id"))
    return both.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
