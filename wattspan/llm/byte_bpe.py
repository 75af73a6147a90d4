"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Each match of the tokenizer's split pattern is a word. Words are folded: a word starts as the array of
its bytes, and ``aggregate`` merges, one at a time, the leftmost adjacent pair of lowest rank until no
pair has a rank. Ranks come from a literal: for each pair of tokens whose bytes together are a
token, that token's rank, in a table without collisions addressed by a hash of the two ids. Spark writes a plan out as text
again and again, with its literals, and the driver keeps these texts; so ``encode`` stores the literals as a table of one row, which
a scalar subquery gives to the tasks. An item of the folded array is one
number, of its pair's rank, its place in the word and its id, so that the least number is the next merge.
Decoding looks every id up in a literal array of binary pieces and concatenates them.

Words of more than ``PIECE_BYTES`` are folded by pieces, which are joined one after another: the tokens
around a joint are folded again, and if those at both ends of that stretch come back, every adjacent pair
of the result is what folding gives for it alone, which makes the whole what folding gives for the word. If not, all
that was joined so far is folded. So a word's cost grows with its length, not with the square.
This needs a vocabulary whose tokens fold to themselves; with others words are folded whole.

Distinct words are folded once in each run of ``RUN_WORDS`` words of a document. The most frequent words of
a sample are folded beforehand and reach the tasks as one array, by a scalar subquery; that only saves
time, a word it lacks is folded in its document with the same result. Nothing is shuffled but the sample's word
counts, so neither hot sources nor copies matter.

Nulls and empty texts give no tokens. Repeated rows are encoded each on its own, other columns pass
through. The columns ``words``, ``token_ids``, ``_bpe_words`` and ``_bpe_tables`` are the operator's own and replace
input columns of those names.
"""

from __future__ import annotations

import base64
import itertools
import json

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.llm.common import materialise

#: Documents sampled to find frequent words, and frequent words that are folded beforehand.
SAMPLE_DOCS = 48_000
FREQUENT_WORDS = 393_216
#: Buckets of the table of frequent words, and words looked at in each.
BUCKETS = 262_144
BUCKET_WORDS = 4
#: Words of a document that are looked up and folded together.
RUN_WORDS = 2048
#: Longer words are folded by pieces of so many bytes; tokens on either side of a joint that are folded again.
PIECE_BYTES = 64
JOINT_TOKENS = 24
#: Bits of an item of a folded array: rank of the pair that begins there, place, id.
ID_BITS, PLACE_BITS = 18, 27
END = 2**ID_BITS - 1
NO_RANK = 2**ID_BITS - 1
_LOW = ID_BITS + PLACE_BITS
_DONE = NO_RANK << _LOW


def load_ranks(path: str) -> list[bytes]:
    """Byte pieces of a tiktoken vocabulary file, in the order of their ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    pieces = [b""] * (1 + max(int(r) for _, r in pairs))
    for piece, rank in pairs:
        pieces[int(rank)] = base64.b64decode(piece)
    return pieces


def java_pattern(pattern: str) -> str:
    """The split pattern for Java, whose ``\\s`` means Unicode white space only with this flag."""
    return "(?U)" + pattern


def place_apart(hashes: list[int]) -> tuple[list[int], list[int], int, int]:
    """A table without collisions for 64-bit hashes: for each group of keys a shift, for each slot the key in it or -1,
    the bits of a group and the bits of a slot.

    A key of hash ``h`` is in group ``h & (2**bits - 1)`` and in the slot ``(h >> bits) + shift``, of which the low bits count.
    Groups are placed largest first, each by the first shift that finds all its slots free. Tables are small, as every
    task reads them once.
    """
    bits = max(1, (len(hashes) // 2).bit_length())
    members: list[list[int]] = [[] for _ in range(2**bits)]
    for i, h in enumerate(hashes):
        members[h % 2**bits].append(i)
    order = sorted(range(2**bits), key=lambda g: -len(members[g]))
    for slot_bits in itertools.count(max(1, len(hashes).bit_length())):
        slots = 2**slot_bits
        shifts, owner = [0] * 2**bits, [-1] * slots
        for g in order:
            start = [(hashes[i] >> bits) % slots for i in members[g]]
            d = next((d for d in range(slots) if all(owner[(x + d) % slots] < 0 for x in start)), -1)
            if d < 0 or len(set(start)) < len(start):
                break  # in one slot whatever the shift, or too full: more slots
            shifts[g] = d
            for i, x in zip(members[g], start, strict=True):
                owner[(x + d) % slots] = i
        else:
            return shifts, owner, bits, slot_bits


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: an aggregate over nothing, whose end is ``body``."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def _literal(value, kind: str) -> Column:
    """A literal of a nested type: ``from_json`` of a literal folds."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


class WordTable:
    """Frequent words and their ids, as one array that a scalar subquery gives to every task.

    A word's bucket is the low bits of its hash. Of a bucket's words the ``BUCKET_WORDS`` most frequent are kept, as a word that is not
    found is folded in its document.
    """

    def __init__(self, folded: DataFrame):
        """``folded`` has ``w``, ``count`` and ``ids``, at most ``FREQUENT_WORDS`` rows."""
        entry = F.struct(F.col("count").alias("n"), "w", "ids")
        best = F.slice(F.sort_array(F.collect_list(entry), asc=False), 1, BUCKET_WORDS)
        found = folded.groupBy(F.xxhash64("w").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.transform(best, lambda e: F.struct(e["w"].alias("w"), e["ids"].alias("v"))).alias("x"))
        every = folded.sparkSession.range(BUCKETS).join(found, F.col("id") == F.col("bucket"), "left")
        rows = F.sort_array(F.collect_list(F.struct("id", "x")))
        self.rows = every.agg(F.transform(rows, lambda b: b["x"]).alias("rows")).scalar()

    def find(self, t: Column, word: Column) -> Column:
        """The ids of a word, or null; ``t`` holds this table."""

        def among(bucket: Column) -> Column:
            def at(k: int) -> Column:
                if k == BUCKET_WORDS:
                    return F.lit(None).cast("array<int>")
                return _let(F.get(bucket, k), lambda e: F.when(e["w"] == word, e["v"]).when(e.isNotNull(), at(k + 1)))

            return at(0)

        return _let(F.get(t["words"], F.xxhash64(word).bitwiseAND(BUCKETS - 1).cast("int")), among)


def mergeable(pieces: list[bytes]) -> list[tuple[int, int, int]]:
    """(left id, right id, rank) for all pairs of tokens whose bytes together are a token."""
    rank = {p: i for i, p in enumerate(pieces) if p}
    return [(rank[p[:k]], rank[p[k:]], i) for p, i in rank.items() for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]


def fold_plain(word: bytes, byte_ids: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """Ranked merges of one word in Python; used on the driver to look at a vocabulary's own tokens."""
    ids = [byte_ids[b] for b in word]
    while len(ids) > 1:
        found = [ranks.get(p, NO_RANK) for p in zip(ids, ids[1:], strict=False)]
        low = min(found)
        if low == NO_RANK:
            break
        at = found.index(low)
        ids[at : at + 2] = [low]
    return ids


def _decoded(t: Column, ids: Column) -> Column:
    """Bytes of ids. A cast between binary and string leaves bytes as they are."""
    return F.array_join(F.transform(ids, lambda i: F.get(t["pieces"], i).cast("string")), "").cast("binary")


class BytePairCoder:
    """Encoder and decoder over columns, for one vocabulary and split pattern."""

    def __init__(self, pieces: list[bytes], pattern: str):
        if len(pieces) >= NO_RANK:
            raise ValueError(f"a vocabulary may have {NO_RANK - 1} tokens")
        self.pattern = java_pattern(pattern)
        rank = {p: i for i, p in enumerate(pieces) if p}
        byte_ids = [rank[bytes([b])] for b in range(256)]
        pairs = mergeable(pieces)
        ranks = {(a, b): r for a, b, r in pairs}
        # Tokens that folding does not give for their own bytes; a word that equals one is that token.
        odd = [(p, r) for p, r in rank.items() if fold_plain(p, byte_ids, ranks) != [r]]
        self._odd = _literal({base64.b64encode(p).decode(): r for p, r in odd}, "map<string,int>") if odd else None
        # A pair's key is its left and its right id.
        keys = [(a << ID_BITS) + b for a, b, _ in pairs]
        shifts, owner, self._bits, self._slot_bits = place_apart([xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42) for k in keys])
        self._shifts = _literal(shifts, "array<bigint>")
        self._pairs = _literal([(keys[i] << ID_BITS) + pairs[i][2] if i >= 0 else -1 for i in owner], "array<bigint>")
        # The first state of a byte before another one, at 256 times the first and the second; of a last byte, at 65536 and it.
        start = [(ranks.get((a, b), NO_RANK) << _LOW) + a for a in byte_ids for b in byte_ids]
        self._bytes = _literal(start + [_DONE + a for a in byte_ids], "array<bigint>")
        self._pieces = _literal([base64.b64encode(p).decode() for p in pieces], "array<binary>")

    def _tables(self) -> Column:
        """A literal is folded wherever it stands, so each must stand in a plan once only."""
        return F.struct(self._shifts.alias("shifts"), self._pairs.alias("pairs"), self._bytes.alias("bytes"), self._pieces.alias("pieces"))

    def stored_tables(self, spark: SparkSession) -> DataFrame:
        """The literals as ``tables`` of one row, so that no later plan holds them."""
        return materialise(spark.range(1).select(self._tables().alias("tables")), "bpe-tables")[0]

    @staticmethod
    def _with_tables(tables: Column, body, known: Column | None = None) -> Column:
        """``body(t)``; ``tables`` and ``known`` are evaluated once, as a subquery may be put in for them."""

        def opened(x: Column) -> Column:
            more = [] if known is None else [known.alias("words")]
            return _let(F.struct(*(x[k].alias(k) for k in ("shifts", "pairs", "bytes", "pieces")), *more), body)

        return _let(tables, opened)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def rank(self, t: Column, left: Column, right: Column) -> Column:
        """Rank of a pair of ids, or ``NO_RANK``."""

        key = left * 2**ID_BITS + right

        def slot(h: Column) -> Column:
            place = F.shiftrightunsigned(h, self._bits) + F.get(t["shifts"], h.bitwiseAND(2**self._bits - 1).cast("int"))
            return F.get(t["pairs"], place.bitwiseAND(2**self._slot_bits - 1).cast("int"))

        return _let(_let(F.xxhash64(key), slot), lambda e: F.when(F.shiftright(e, ID_BITS) == key, e.bitwiseAND(2**ID_BITS - 1)).otherwise(F.lit(NO_RANK).cast("long")))

    def _merge_all(self, t: Column, codes: Column) -> Column:
        """Ids after all ranked merges of an array of byte values."""
        n = F.size(codes)
        own = lambda e: e.bitwiseAND(2**ID_BITS - 1)
        start = F.transform(codes, lambda c, i: F.get(t["bytes"], F.when(i < n - 1, c * 256 + F.get(codes, i + 1)).otherwise(c + 65536)) + i.cast("long") * 2**ID_BITS)

        def step(s: Column, _: Column) -> Column:
            return _let(F.array_min(s), lambda m: F.when(m >= _DONE, s).otherwise(_let(F.array_position(s, m).cast("int"), lambda i: merged(s, m, i))))

        def merged(s: Column, m: Column, i: Column) -> Column:
            """``i`` counts from 1. An item keeps the place of its first byte."""
            after, new = F.get(s, i + 1), F.shiftright(m, _LOW)
            onward = F.when(after.isNull(), F.lit(NO_RANK).cast("long")).otherwise(self.rank(t, new, own(after)))
            here = onward * 2**_LOW + m.bitwiseAND((2**PLACE_BITS - 1) << ID_BITS) + new
            before = F.get(s, i - 2)
            back = self.rank(t, own(before), new) * 2**_LOW + before.bitwiseAND(2**_LOW - 1)
            gone = F.lit(-1).cast("long")
            return F.array_remove(F.transform(s, lambda e, j: F.when((j < i - 2) | (j > i), e).when(j == i - 1, here).when(j == i, gone).otherwise(back)), gone)

        return F.aggregate(F.slice(codes, F.lit(2), n), start, step, lambda s: F.transform(s, lambda e: own(e).cast("int")))

    def _codes(self, word: Column) -> Column:
        return _let(F.decode(word, "ISO-8859-1"), lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substring(s, i, F.lit(1)))))

    def _fold_whole(self, t: Column, word: Column) -> Column:
        return _let(self._codes(word), lambda codes: self._merge_all(t, codes))

    def _fold_by_pieces(self, t: Column, word: Column) -> Column:
        n = F.length(word)
        cuts = F.sequence(F.lit(0), ((n - 1) / PIECE_BYTES).cast("int"))
        folded = F.transform(cuts, lambda c: self._fold_whole(t, F.substring(word, c * PIECE_BYTES + 1, F.lit(PIECE_BYTES))))

        def join(made: Column, piece: Column) -> Column:
            otherwise = self._fold_whole(t, _decoded(t, F.concat(made, piece)))  # exact for whatever no joint suits
            return self._joined(t, made, piece, JOINT_TOKENS, otherwise)

        return F.aggregate(folded, F.array().cast("array<int>"), join)

    def _joined(self, t: Column, made: Column, piece: Column, k: int, otherwise: Column) -> Column:
        """``made`` and ``piece`` joined by folding ``k`` tokens on either side again, where that is sure."""
        left = F.slice(made, F.greatest(F.size(made) - k, F.lit(0)) + 1, F.lit(k))
        right = F.slice(piece, F.lit(1), F.lit(k))

        def placed(m: Column) -> Column:
            sure = ((F.size(made) <= k) | (F.get(m, 0) == F.get(left, 0))) & ((F.size(piece) <= k) | (F.element_at(m, -1) == F.element_at(right, -1)))
            return F.when(sure, F.concat(F.slice(made, F.lit(1), F.greatest(F.size(made) - k, F.lit(0))), m, F.slice(piece, F.lit(k + 1), F.size(piece)))).otherwise(otherwise)

        return F.when(F.size(made) == 0, piece).otherwise(_let(self._fold_whole(t, _decoded(t, F.concat(left, right))), placed))

    def _fold(self, t: Column, word: Column) -> Column:
        if self._odd is None:
            return F.when(F.length(word) <= PIECE_BYTES, self._fold_whole(t, word)).otherwise(self._fold_by_pieces(t, word))
        return _let(F.try_element_at(self._odd, F.base64(word)), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(self._fold_whole(t, word)))

    def fold(self, word: Column) -> Column:
        """Ids of one word, given as its bytes."""
        return self._with_tables(self._tables(), lambda t: self._fold(t, word))

    def frequent(self, docs: DataFrame, text_col: str, tables: DataFrame) -> WordTable:
        """The ids of the sample's frequent words; bounded by ``FREQUENT_WORDS``. Rows are drawn one by one where they are read,
        about ``SAMPLE_DOCS`` to twice that, so no task gets them all."""
        texts = docs.select(text_col)
        share = max(1, texts.count() // SAMPLE_DOCS)
        sample = texts if share == 1 else texts.sample(1 / share, seed=17)
        counted = sample.select(F.explode(self.words(F.col(text_col))).alias("w")).where(F.length("w") <= PIECE_BYTES).groupBy("w").count().where("count > 1")
        top = counted.orderBy(F.desc("count"), "w").limit(FREQUENT_WORDS)
        dealt = top.repartition(docs.sparkSession.sparkContext.defaultParallelism).withColumn("_bpe_tables", tables.scalar())
        ids = self._with_tables(F.col("_bpe_tables"), lambda t: self._fold(t, F.col("w").cast("binary")))
        return WordTable(materialise(dealt.select("w", "count", ids.alias("ids")), "frequent-words")[0])

    def _run_ids(self, t: Column, run: Column, known: WordTable) -> Column:
        """Ids of a run of words."""
        def placed(found: Column) -> Column:
            rare = F.array_distinct(F.filter(run, lambda _, i: F.get(found, i).isNull()))
            folded = F.map_from_entries(F.transform(rare, lambda w: F.struct(w, self._fold(t, w.cast("binary")))))
            return _let(folded, lambda f: F.flatten(F.zip_with(run, found, lambda w, ids: F.coalesce(ids, F.try_element_at(f, w)))))

        return _let(F.transform(run, lambda w: known.find(t, w)), placed)

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with ``token_ids``, an array of ints."""
        tables = self.stored_tables(docs.sparkSession)
        known = self.frequent(docs, text_col, tables)
        out = docs.drop(*(c for c in ("words", "_bpe_words", "_bpe_tables", "token_ids") if c not in (id_col, text_col)))

        def ids(t: Column, words: Column) -> Column:
            runs = F.sequence(F.lit(0), ((F.greatest(F.size(words), F.lit(1)) - 1) / RUN_WORDS).cast("int"))
            return F.flatten(F.transform(runs, lambda r: _let(F.slice(words, r * RUN_WORDS + 1, F.lit(RUN_WORDS)), lambda run: self._run_ids(t, run, known))))

        # Spark takes no subquery inside a higher-order function, but moves the two below into it, as each is used once.
        out = out.withColumn("_bpe_words", known.rows).withColumn("_bpe_tables", tables.scalar())
        tokens = self._with_tables(F.col("_bpe_tables"), lambda t: _let(self.words(F.col(text_col)), lambda words: ids(t, words)), F.col("_bpe_words"))
        return out.withColumn("token_ids", tokens).drop("_bpe_words", "_bpe_tables")

    def decode(self, ids: Column) -> Column:
        """The bytes that an array of ids stands for."""
        return _let(F.struct(self._pieces.alias("pieces")), lambda t: _decoded(t, ids))


def digest(encoded: DataFrame, coder: BytePairCoder, id_col: str = "doc_id") -> DataFrame:
    """One row a document: number of ids, and SHA-256 of the ids in decimal and of the decoded bytes."""
    ids = F.col("token_ids")
    return encoded.select(
        id_col,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(coder.decode(ids), 256).alias("decoded_sha256"),
    )
