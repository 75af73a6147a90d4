"""Exact Jaccard self-join on word shingles by filters under several global token orders.

1. Equal sets are one class from the start: documents are grouped by a 128-bit digest of their set.
2. Tokens (hashes of shingles) are dealt by range to buckets, in binary arrays, and counted over all
   documents. A document whose set has too few tokens that any other document has cannot reach the
   threshold, whatever its partner. The rest, the survivors, are counted once more among themselves, now
   without copies and without what no survivor has.
3. Candidates, first of stars: under each of several random global orders, a document's first token is one of its
   prefix, and it is paired with the least edited document of the same first token. This is linear in the
   survivors, and it gathers large groups of near copies before any list of them is paired.
4. Candidates, then of lists: prefixes under several global orders, in which tokens rank by the corpus frequency
   of frequent ones, then by a hash of the order's own. Pairs come from each order's lists. Pairs inside a component of step 3
   are left out: they would change no component. So are pairs whose shared tokens, as counted, are too few
   for the sizes of both. Lists of frequent tokens also carry each document's parity map, whose distance bounds
   from above what two sets share. A list longer than ``LIST_BLOCK`` is cut into blocks by hashes of its documents, and
   each pair of blocks is a group of its own.
5. Filters of all orders are intersected before anything is verified: two sets that reach the threshold share a
   token of their prefixes under every global order. A pair of lists is kept only if every order gives it; a pair of a star only
   if its prefixes meet under every order. What is left is verified on whole sets, and components are found over all links.

Filters are one-sided and verification is exact on 64-bit hashes, so results do not depend on tables of
frequencies being bounded. Frequencies of the ``FREQUENT`` most common tokens among survivors only order prefixes.

Null texts, empty texts and texts of white space have empty sets and link with nothing. Rows with a null
id keep their set size and have a null component. Rows that repeat an id are one document for linking,
with the links of each of its texts. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.llm.common import materialise
from wattspan.llm.components import components
from wattspan.llm.shingles import WORDS, mix, sets

#: Frequent tokens that order prefixes: 12 MB at most in each Python process.
FREQUENT = 1 << 20
#: A token is frequent if so many documents have it.
FREQUENT_DOCS = 4
#: Random orders of step 3, and orders of step 4.
FIRST_ORDERS = 6
PREFIX_ORDERS = 3
#: Bytes of text whose tokens one bucket holds on average. A task holds one bucket at a time, about eight times as much.
BUCKET_BYTES = 16_000_000
#: Lists of one token up to so many documents are paired by shifts, longer ones by blocks.
SHORT_LIST = 32
#: Bits of a document's parity map, which long lists carry.
MAP_BITS = 1024
#: Documents of one token that a task pairs at once, from each of two blocks.
LIST_BLOCK = 2048

_U32 = np.uint64(32)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least number of shared tokens of a set of ``n`` with any partner."""
    return -((-n * percent) // 100)


def bucket_count(texts: DataFrame) -> int:
    """Token buckets: as many as shuffle partitions, more where texts need them, so that a bucket does not grow with the input."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def _range_bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> _U32) * np.uint64(buckets)) >> _U32


def _deal(tokens: np.ndarray, doc: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, tokens, document positions) for each bucket that has tokens; documents stay together."""
    b = _range_bucket(tokens, buckets)
    order = np.argsort(b, kind="stable")
    b, tokens, doc = b[order], tokens[order], doc[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(b)]]).tolist(), strict=True):
        if hi > lo:
            yield int(b[lo]), tokens[lo:hi], doc[lo:hi]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return starts, np.diff(np.concatenate([starts, [len(values)]]))


def _different(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which runs hold more than one id; ids are sorted inside runs."""
    return ids[starts] != ids[starts + lengths - 1]


def _parts(ids: np.ndarray, many: np.ndarray, buckets: int) -> list[tuple]:
    """Counts of documents as rows, packed for each home of documents."""
    home = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    by_home = np.argsort(home, kind="stable")
    out = []
    for at, size in zip(*(x.tolist() for x in _runs(home[by_home])), strict=True):
        rows = by_home[at : at + size]
        out.append(("part", None, None, None, None, int(home[rows[0]]), ids[rows].tobytes(), many[rows].tobytes()))
    return out


def _binary(items: list[np.ndarray], kind: str) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, kind).tobytes() for x in items], pa.binary())


COUNTED = "kind string, doc_id bigint, n bigint, sig binary, token bigint, home int, ids binary, counts binary"


def _stored(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and sets of (id, tokens) batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            yield part.column(0).to_pylist(), [np.frombuffer(x.as_py(), "<u8") for x in part.column(1)]


def count_shared(source: DataFrame, buckets: int, stored: bool, words: int = WORDS) -> DataFrame:
    """Rows of three kinds: ``doc`` (id, set size, digest), ``part`` (counts of a bucket's tokens that other
    documents have too, packed for each home of documents) and, from stored sets, ``frequent`` (token,
    documents). ``source`` holds ids and texts, or ids and stored sets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "doc_ids", "counts", "tokens", "digests"]
        for ids, found in _stored(batches) if stored else sets(batches, size=words):
            n = np.array([len(x) for x in found], np.int64)
            known = np.array([-1 if i is None else 0 for i in ids])
            doc_ids = np.array([0 if i is None else i for i in ids], np.int64)
            digests = b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in found)
            where = np.repeat(np.arange(len(ids)), np.where(known < 0, 0, n))
            tokens = np.concatenate([x for x, k in zip(found, known, strict=True) if k == 0] or [np.zeros(0, np.uint64)])
            # What several ids of this batch have is shared whatever else there is: one entry with a count goes on.
            order = np.lexsort((doc_ids[where], tokens))
            tokens, where = tokens[order], where[order]
            starts, lengths = _runs(tokens)
            several = np.repeat(_different(doc_ids[where], starts, lengths), lengths)
            here = np.bincount(where[several], minlength=len(ids))
            rows: list[tuple] = [(-1 - int(doc_ids[0] % buckets), doc_ids.tobytes(), np.where(known < 0, -1 - n, n).tobytes(), here.tobytes(), digests)]
            lead = starts[several[starts]] if len(starts) else starts
            for b, t, d in _deal(tokens[lead], lengths[several[starts]] if len(starts) else lengths, buckets):
                rows.append((b, None, d.astype("<u4").tobytes(), t.astype("<u4").tobytes(), None))
            order = np.flatnonzero(~several)
            order = order[np.argsort(where[order], kind="stable")]
            tokens, where = tokens[order], where[order]
            for b, t, d in _deal(tokens, where, buckets):
                starts, lengths = _runs(d)
                rows.append((b, doc_ids[d[starts]].tobytes(), lengths.astype("<u4").tobytes(), t.astype("<u4").tobytes(), None))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=names)

    def gather(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        out: list[tuple] = []
        if bucket < 0:
            for r in table.to_pylist():
                doc_ids, n, here = (np.frombuffer(r[k], np.int64) for k in ("doc_ids", "counts", "tokens"))
                out += _parts(doc_ids[here > 0], here[here > 0], buckets)
                for i, (d, k) in enumerate(zip(doc_ids.tolist(), n.tolist(), strict=True)):
                    out.append(("doc", d if k >= 0 else None, k if k >= 0 else -1 - k, r["digests"][16 * i : 16 * i + 16], None, None, None, None))
        else:
            parts = table.select(["doc_ids", "counts", "tokens"]).to_pydict()
            # An entry of one document, or of several that are counted already.
            one = [d is not None for d in parts["doc_ids"]]
            counts = [np.frombuffer(c, "<u4") for c in parts["counts"]]
            docs_ = np.concatenate([np.repeat(np.frombuffer(d, np.int64), c) if k else np.zeros(len(c), np.int64) for d, c, k in zip(parts["doc_ids"], counts, one, strict=True)])
            weight = np.concatenate([np.ones(int(c.sum()), np.int64) if k else c.astype(np.int64) for c, k in zip(counts, one, strict=True)])
            single = np.repeat(one, [int(c.sum()) if k else len(c) for c, k in zip(counts, one, strict=True)])
            tokens = np.concatenate([np.frombuffer(t, "<u4") for t in parts["tokens"]])
            order = np.argsort(tokens)
            tokens, weight, single = tokens[order], weight[order], single[order]
            starts, entries = _runs(tokens)
            lengths = np.add.reduceat(weight, starts) if len(starts) else weight
            shared = np.repeat(lengths > 1, entries) & single
            ids, many = np.unique(docs_[order][shared], return_counts=True)
            out += _parts(ids, many, buckets)
            often = (lengths >= FREQUENT_DOCS) & stored
            out += [("frequent", None, k, None, (bucket << 32) | t, None, None, None) for t, k in zip(tokens[starts[often]].tolist(), lengths[often].tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) or [()] * 8
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "doc_id", "n", "sig", "token", "home", "ids", "counts"])

    dealt = source.mapInArrow(emit, "bucket int, doc_ids binary, counts binary, tokens binary, digests binary")
    return dealt.groupBy("bucket").applyInArrow(gather, COUNTED)


def frequent_tokens(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common tokens, by bucket and low half, in order, and their counts; at most ``FREQUENT``."""
    top = counted.where("kind = 'frequent'").orderBy(F.desc("n"), "token").limit(FREQUENT).select("token", "n").toArrow()
    tokens = top.column("token").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], np.minimum(top.column("n").to_numpy()[order], 2**31 - 1).astype(np.int32)


def _key(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """What ``frequent_tokens`` calls a token."""
    return ((_range_bucket(tokens, buckets) << _U32) | (tokens & np.uint64(0xFFFFFFFF))).astype(np.int64)


def survivor_sets(docs: DataFrame, chosen: DataFrame, words: int = WORDS) -> DataFrame:
    """Sets of the chosen documents, made again from their texts; binary arrays of sorted 64-bit tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in sets(batches, size=words):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in found], pa.int64()), _binary(found, "<u8")], names=["doc_id", "n", "tokens"])

    return docs.join(chosen.select(F.col("doc_id").alias("chosen")), F.col("doc_id") == F.col("chosen"), "left_semi").mapInArrow(run, "doc_id bigint, n bigint, tokens binary")


def first_token_pairs(held: DataFrame) -> DataFrame:
    """Each document with one that has the same first token, under each random order.

    The partner is the document of the list with the greatest share of tokens that others have: of copies,
    the least edited.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(data.as_py(), "<u8")
                for k in range(FIRST_ORDERS):
                    ids.append(doc_id)
                    keys.append(int(np.min(mix(tokens ^ np.uint64(0xA5A5 + 7919 * k)))) - 2**63)
            orders = list(range(FIRST_ORDERS)) * batch.num_rows
            share = np.repeat(batch.column(2).to_numpy(), FIRST_ORDERS)
            yield pa.RecordBatch.from_arrays([pa.array(orders, pa.int32()), pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(share)], names=["ord", "first", "doc_id", "share"])

    source = held.select("doc_id", "tokens", (F.col("shared") / F.col("n")).alias("share"))
    keys, _ = materialise(source.mapInArrow(run, "ord int, first bigint, doc_id bigint, share double"), "first-tokens")
    best = F.max(F.struct("share", (-F.col("doc_id")).alias("k")))
    hubs = keys.groupBy("ord", "first").agg((-best["k"]).alias("hub"), F.count("*").alias("many")).where("many > 1")
    hubs, _ = materialise(hubs.select("ord", "first", "hub"), "hubs")
    return keys.join(hubs, ["ord", "first"]).where("hub <> doc_id").select(F.least("hub", "doc_id").alias("x"), F.greatest("hub", "doc_id").alias("y")).distinct()


def verified(pairs: DataFrame, held: DataFrame, percent: int, filters: tuple[tuple[np.ndarray, np.ndarray], int] | None = None) -> DataFrame:
    """Pairs (x, y) whose sets reach the threshold. With ``filters`` (frequent tokens and buckets), only pairs whose prefixes
    meet under every order are verified."""
    sent = held.sparkSession.sparkContext.broadcast(filters) if filters else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            sides = [[np.frombuffer(v.as_py(), "<u8") for v in batch.column(c)] for c in (2, 3)]
            met = _prefixes_meet(sides, sent.value, percent) if sent else np.ones(batch.num_rows, bool)
            keep = []
            for s, t, able in zip(*sides, met.tolist(), strict=True):
                at = np.searchsorted(t, s) if able else s
                both = int(np.count_nonzero(t[np.minimum(at, len(t) - 1)] == s)) if able and len(s) and len(t) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    ys = held.select(F.col("doc_id").alias("y"), F.col("tokens").alias("t"))
    xs = held.select(F.col("doc_id").alias("x"), F.col("tokens").alias("s"))
    return pairs.join(ys, "y").join(xs, "x").select("x", "y", "s", "t").mapInArrow(run, "x bigint, y bigint")


def _prefixes_meet(sides: list[list[np.ndarray]], filters: tuple[tuple[np.ndarray, np.ndarray], int], percent: int) -> np.ndarray:
    """Which pairs of sets share a prefix token under every order."""
    met = np.ones(len(sides[0]), bool)
    flats = []
    for found in sides:
        n = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        flats.append((flat, frequencies(flat, *filters), np.repeat(np.arange(len(n)), n), n))
    for o in range(PREFIX_ORDERS):
        # A token and its pair as one number: pairs are few, so collisions of the mixed sum are as rare as those of hashes.
        keys = []
        for flat, freq, where, n in flats:
            at = prefix_of(flat, freq, where, n, percent, o)
            keys.append((mix(flat[at]) + mix(where[at].astype(np.uint64)), where[at]))
        hit = np.zeros(len(met), bool)
        hit[keys[0][1][np.isin(keys[0][0], keys[1][0])]] = True
        met &= hit
    return met


def _reach(shared: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether so many shared tokens can give sets of ``total`` tokens together the threshold."""
    return (100 + percent) * shared >= percent * total


def parity_maps(flat: np.ndarray, where: np.ndarray, many: int) -> np.ndarray:
    """For each of ``many`` documents, the parity of its tokens in each of ``MAP_BITS`` classes, as 64-bit words.

    Two maps differ in at most as many bits as the sets differ in tokens, which bounds what they share.
    """
    cells = where * MAP_BITS + (mix(flat ^ np.uint64(0xB17)) % np.uint64(MAP_BITS)).astype(np.int64)
    bits = (np.bincount(cells, minlength=many * MAP_BITS) & 1).astype(np.uint8).reshape(many, MAP_BITS)
    return np.packbits(bits, axis=1).view(np.uint64)


def _pairs_of_bucket(tokens: np.ndarray, docs: np.ndarray, labels: np.ndarray, n: np.ndarray, shared: np.ndarray, percent: int, at: np.ndarray | None = None, maps: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """Distinct pairs (two columns, least first) of documents that share a token, differ in label, fit in size,
    and have enough tokens that other documents have. ``at`` is each entry's row in ``maps``, or -1. With ``side``,
    only pairs between two sides."""
    order = np.lexsort((labels, tokens))
    tokens, docs, labels, n, shared = tokens[order], docs[order], labels[order], n[order], shared[order]
    at = np.full(len(tokens), -1) if at is None else at[order]
    side = None if side is None else side[order]
    if len(tokens):
        # Against the smallest partner that its list and its size allow; what cannot reach that leaves first.
        starts, lengths = _runs(tokens)
        least = np.maximum(needed(n, percent), np.repeat(np.minimum.reduceat(n, starts), lengths))
        able = _reach(shared, n + least, percent)
        tokens, docs, labels, n, shared, at = tokens[able], docs[able], labels[able], n[able], shared[able], at[able]
        side = None if side is None else side[able]
    starts, lengths = _runs(tokens)
    mixed = np.minimum.reduceat(labels, starts) != np.maximum.reduceat(labels, starts) if len(starts) else np.zeros(0, bool)
    # Pairs are held as one number each, of the documents' places among the bucket's.
    names, place = np.unique(docs, return_inverse=True)
    found: list[np.ndarray] = []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (labels[i] != labels[j]) & (100 * small >= percent * large) & (docs[i] != docs[j])
        ok &= _reach(np.minimum(shared[i], shared[j]), small + large, percent)
        if side is not None:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        both = (at[i] >= 0) & (at[j] >= 0)
        if both.any():
            total = n[i[both]] + n[j[both]]
            apart = np.bitwise_count(maps[at[i[both]]] ^ maps[at[j[both]]]).sum(axis=1, dtype=np.int64)
            near = np.ones(len(i), bool)
            near[both] = (100 + percent) * (total - apart) >= 2 * percent * total
            i, j = i[near], j[near]
        i, j = place[i], place[j]
        found.append(np.minimum(i, j) * len(names) + np.maximum(i, j))
        if len(found) > 1 and sum(map(len, found[1:])) > 500_000:
            found[:] = [np.unique(np.concatenate(found))]

    short = np.repeat(mixed & (lengths <= SHORT_LIST), lengths)
    rows = np.flatnonzero(short)
    run = np.repeat(np.arange(len(lengths)), lengths)[rows]
    for shift in range(1, SHORT_LIST):
        same = run[shift:] == run[:-shift] if len(run) > shift else np.zeros(0, bool)
        if not same.any():
            break
        add(rows[:-shift][same], rows[shift:][same])
    for s, k in zip(starts[mixed & (lengths > SHORT_LIST)].tolist(), lengths[mixed & (lengths > SHORT_LIST)].tolist(), strict=True):
        inner = np.arange(s, s + k)
        groups, sizes = _runs(labels[s : s + k])
        for g, size in zip(groups.tolist(), sizes.tolist(), strict=True):
            mine, later = inner[g : g + size], inner[g + size :]
            step = max(1, 50_000 // max(1, len(later)))
            for first in range(0, size if len(later) else 0, step):
                block = mine[first : first + step]
                add(np.repeat(block, len(later)), np.tile(later, len(block)))
    codes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return np.stack([names[codes // max(1, len(names))], names[codes % max(1, len(names))]], axis=1)


def frequencies(flat: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> np.ndarray:
    """How many survivors have each token, as far as it is frequent; else 0."""
    keys, counts = frequent
    if not len(keys) or not len(flat):
        return np.zeros(len(flat), np.int32)
    k = _key(flat, buckets)
    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    return np.where(keys[at] == k, counts[at], 0)


def prefix_of(flat: np.ndarray, freq: np.ndarray, where: np.ndarray, n: np.ndarray, percent: int, o: int) -> np.ndarray:
    """Places of the prefix tokens of sets that lie one after another, under the ``o``-th order; set by set."""
    order = np.lexsort((mix(flat ^ np.uint64(0x5EED + 104729 * o)), freq, where))
    starts = np.concatenate([[0], np.cumsum(n)])[:-1]
    return order[np.arange(len(flat)) - np.repeat(starts, n) < np.repeat(n - needed(n, percent) + 1, n)]


def _block_rows(base: int, tokens: np.ndarray, freq: np.ndarray, where: np.ndarray, buckets: int, ids: np.ndarray, labels: np.ndarray, n: np.ndarray, shared: np.ndarray, maps: np.ndarray) -> list[tuple]:
    """Entries of lists that are cut into blocks: each goes to its block's pairings with every block of its list."""
    rows = []
    blocks = -(-freq.astype(np.int64) // LIST_BLOCK)
    own = (mix(ids[where].view(np.uint64) ^ np.uint64(0xB10C)) % blocks.astype(np.uint64)).astype(np.int64) if len(where) else where
    order = np.lexsort((where, own, tokens))
    tokens, where, own, blocks = tokens[order], where[order], own[order], blocks[order]
    cuts = np.flatnonzero((np.diff(tokens) != 0) | (np.diff(own) != 0)) + 1 if len(tokens) else np.zeros(0, np.int64)
    for lo, hi in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(tokens)]]).tolist(), strict=True):
        if hi > lo:
            d, k = where[lo:hi], int(own[lo])
            packed = (ids[d].tobytes(), labels[d].tobytes(), n[d].tobytes(), shared[d].tobytes(), np.ones(hi - lo, "<u4").tobytes(), tokens[lo:hi].astype("<u4").tobytes(), np.ones(hi - lo, bool).tobytes(), maps[d].tobytes())
            bucket = base + int(_range_bucket(tokens[lo : lo + 1], buckets)[0])
            rows += [(bucket, int(tokens[lo].view(np.int64)), min(k, other), max(k, other), k, *packed) for other in range(int(blocks[lo]))]
    return rows


def prefix_pairs(held: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int, buckets: int) -> DataFrame:
    """Pairs that share a prefix token under every order. ``held`` has doc_id, n, tokens, label, shared."""
    common = held.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            ids, n, labels, shared = (batch.column(i).to_numpy() for i in (0, 1, 3, 4))
            tokens = [np.frombuffer(x.as_py(), "<u8") for x in batch.column(2)]
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            where = np.repeat(np.arange(len(ids)), n)
            freq = frequencies(flat, common.value, buckets)
            maps = parity_maps(flat, where, len(ids))
            rows = []
            for o in range(PREFIX_ORDERS):
                chosen = prefix_of(flat, freq, where, n, percent, o)
                hot = freq[chosen] > LIST_BLOCK
                rows += _block_rows(o * buckets, flat[chosen[hot]], freq[chosen[hot]], where[chosen[hot]], buckets, ids, labels, n, shared, maps)
                chosen = chosen[~hot]
                long = np.unique(where[chosen][freq[chosen] > SHORT_LIST])
                for b, t, d in _deal(flat[chosen], where[chosen], buckets):
                    s, c = _runs(d)
                    d = d[s]
                    mapped = np.isin(d, long)
                    rows.append((o * buckets + b, 0, 0, 0, 0, ids[d].tobytes(), labels[d].tobytes(), n[d].tobytes(), shared[d].tobytes(), c.astype("<u4").tobytes(), t.astype("<u4").tobytes(), mapped.tobytes(), maps[d[mapped]].tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 13
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:5]), *(pa.array(c, pa.binary()) for c in cols[5:])], names=["bucket", "list", "b1", "b2", "own", "ids", "labels", "sizes", "shared", "counts", "tokens", "mapped", "maps"])

    def gather(table: pa.Table) -> pa.Table:
        p = table.to_pydict()
        many = np.concatenate([np.frombuffer(x, "<u4") for x in p["counts"]])
        spread = lambda name: np.repeat(np.concatenate([np.frombuffer(x, np.int64) for x in p[name]]), many)
        tokens = np.concatenate([np.frombuffer(x, "<u4") for x in p["tokens"]])
        mapped = np.concatenate([np.frombuffer(x, bool) for x in p["mapped"]])
        maps = np.frombuffer(b"".join(p["maps"]), np.uint64).reshape(-1, MAP_BITS // 64)
        at = np.repeat(np.where(mapped, np.cumsum(mapped) - 1, -1), many)
        # Two blocks of one list are two sides; one block, and whole lists, are paired inside.
        side = None if p["b1"][0] == p["b2"][0] else np.repeat(np.repeat(p["own"], [len(x) // 8 for x in p["ids"]]), many)
        pairs = _pairs_of_bucket(tokens, spread("ids"), spread("labels"), spread("sizes"), spread("shared"), percent, at, maps, side)
        o = np.full(len(pairs), p["bucket"][0] // buckets, np.int32)
        return pa.table([pa.array(o), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["ord", "x", "y"])

    dealt = held.select("doc_id", "n", "tokens", "label", "shared").mapInArrow(emit, "bucket int, list bigint, b1 int, b2 int, own int, ids binary, labels binary, sizes binary, shared binary, counts binary, tokens binary, mapped binary, maps binary")
    pairs = dealt.groupBy("bucket", "list", "b1", "b2").applyInArrow(gather, "ord int, x bigint, y bigint")
    return pairs.groupBy("x", "y").agg(F.expr("bit_or(shiftleft(1, ord))").alias("orders")).where(F.col("orders") == 2**PREFIX_ORDERS - 1).select("x", "y")


def _shared(counted: DataFrame) -> DataFrame:
    """doc_id and the number of its tokens that other documents have; documents without any are missing."""

    def add_up(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("ids")])
        many = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("counts")])
        own, where = np.unique(ids, return_inverse=True)
        return pa.table([pa.array(own), pa.array(np.bincount(where, many).astype(np.int64))], names=["doc_id", "shared"])

    return counted.where("kind = 'part'").select("home", "ids", "counts").groupBy("home").applyInArrow(add_up, "doc_id bigint, shared bigint")


def jaccard_components(docs: DataFrame, percent: int = 75, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", gather_first: bool = True) -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id (least document of an equal set), component_id.

    ``gather_first`` False leaves step 3 out, with the same result: groups of near copies are then paired in full.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = bucket_count(texts)
    counted, _ = materialise(count_shared(texts, buckets, stored=False, words=words), "counted")
    rows = counted.where("kind = 'doc'").select("doc_id", "n", "sig")
    classes, _ = materialise(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig", "n").agg(F.min("doc_id").alias("class_id")), "classes")
    able = classes.join(_shared(counted), F.col("class_id") == F.col("doc_id")).where(100 * F.col("shared") >= percent * F.col("n"))
    able, _ = materialise(able.select(F.col("class_id").alias("doc_id")).distinct(), "survivors")
    every, _ = materialise(survivor_sets(texts, able, words), "sets")
    again, _ = materialise(count_shared(every.select("doc_id", "tokens"), buckets, stored=True), "counted-again")
    kept = every.join(_shared(again).withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id")).where(100 * F.col("shared") >= percent * F.col("n"))
    held, _ = materialise(kept.select("doc_id", "n", "tokens", "shared"), "held")

    frequent = frequent_tokens(again)
    if gather_first:
        first, _ = materialise(first_token_pairs(held), "first-pairs")
        links, _ = materialise(verified(first, held, percent, (frequent, buckets)), "first-links")
        early, _ = materialise(components(links, "x", "y"), "early")
    else:
        links = held.select(F.col("doc_id").alias("x"), F.col("doc_id").alias("y")).limit(0)
        early = links.select(F.col("x").alias("node"), F.col("y").alias("root"))
    labelled = held.join(early, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n", "tokens", F.coalesce("root", "doc_id").alias("label"), "shared")
    pairs, _ = materialise(prefix_pairs(labelled, frequent, percent, buckets), "prefix-pairs")
    more = verified(pairs, held, percent)
    roots, _ = materialise(components(links.union(more), "x", "y"), "roots")

    named = rows.join(classes, ["sig", "n"], "left").join(roots, F.col("class_id") == F.col("node"), "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "class_id", "doc_id")).alias("component_id"))
