"""Language identification of code-switched text by a linear-chain conditional random field over words.

Every word has a label. Its features are hashed: the word itself (lexicon), and byte 2-, 3- and 4-grams of
the word between boundary marks, of which those that touch a mark are its affixes. Transitions are
learned. Forward-backward runs over the whole chain of a text's words; its marginals are averaged over the
words that hold a letter, and the greatest average is the document's language and score. Words without a
letter have no features, but are items of the chain, in training as in prediction.

Training takes a bounded sample (``SAMPLE_DOCS`` to twice as many documents, ``SAMPLE_CHARS`` characters, no text above
``LONGEST_SAMPLE_TEXT``) of rows that are not held out and have a language. No table has labels of words:
each word takes its document's language, so switches within a document are not learned as such, but
follow from words whose features speak for another language than their neighbours'. Prediction is a map
over documents: nothing is shuffled, the model's size is fixed.

Null texts and texts without a letter are ``und`` with score 0. Rows that repeat are predicted each alone;
null ids are kept and count as not held out. Texts of any length take bounded memory beside themselves. Other columns are dropped unless carried. Without any labelled row, or with
an empty table, everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspan.llm.common import bounded_sample, by_bytes, held_out, pieces_at, utf8
from wattspan.llm.crf import Adagrad, gradients, long_marginals, marginals
from wattspan.llm.workers import hold

BUCKETS = 1 << 18
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 4_000_000
LONGEST_SAMPLE_TEXT = 200_000
#: Words of a step of training.
BATCH_WORDS = 16_384
EPOCHS = 6
MEMO_WORDS, MEMO_CHARS = 200_000, 4_000_000
#: Bytes of text that are worked on at once; a longer text goes through in pieces, with the same marginals.
CHUNK_BYTES = 1_000_000
#: Features of a longer word are summed in parts.
LONG_WORD = 50_000
WHITE = b" \t\n\r\x0b\x0c"
UNKNOWN = "und"
GRAMS = (2, 3, 4)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, and where each word's begin. Every word has at least its lexicon feature."""
    coded = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    sizes = np.array([len(c) for c in coded], np.int64)
    buf = np.frombuffer(b"".join(coded) + b"\0" * max(GRAMS), np.uint8).astype(np.uint64)
    total = int(sizes.sum())
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(total)
    hashes, owners = [], []
    word = np.repeat(np.arange(len(words)), sizes)
    code = np.zeros(total, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        code = (code << np.uint64(8)) | buf[n - 1 : n - 1 + total]
        if n in GRAMS:
            ok = place + n <= ends
            h = (code[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            hashes.append(h >> np.uint64(46))
            owners.append(word[ok])
    power = np.uint64(0x100000001B3) ** (place - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
    whole = np.add.reduceat((buf[:total] + np.uint64(1)) * power, np.cumsum(sizes) - sizes) if total else np.zeros(0, np.uint64)
    hashes.append((whole * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(46))
    owners.append(np.arange(len(words)))
    owner, h = np.concatenate(owners), np.concatenate(hashes).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return h[order], np.searchsorted(owner[order], np.arange(len(words)))


def long_word_score(word: str, weights: np.ndarray) -> np.ndarray:
    """The sum of the weights of ``word_features`` of one word, in parts."""
    buf = np.frombuffer(b"^" + word.encode("utf-8", "surrogatepass") + b"$", np.uint8)
    total, whole = np.zeros(weights.shape[1], np.float64), 0
    for at in range(0, len(buf), LONG_WORD):
        part = buf[at : at + LONG_WORD + max(GRAMS) - 1].astype(np.uint64)
        code = np.zeros(len(part), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            code = (code[: len(part) - n + 1] << np.uint64(8)) | part[n - 1 :]
            if n in GRAMS:
                h = (code[:LONG_WORD] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                total += weights[(h >> np.uint64(46)).astype(np.int64)].sum(axis=0, dtype=np.float64)
        own = part[:LONG_WORD]
        power = np.uint64(0x100000001B3) ** np.arange(at, at + len(own), dtype=np.uint64)
        whole = (whole + int(((own + np.uint64(1)) * power).sum(dtype=np.uint64))) % 2**64
    return (total + weights[(whole * 0xC2B2AE3D27D4EB4F) % 2**64 >> 46]).astype(np.float32)


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


class WordScorer:
    """Emission scores of words, by a bounded memo. Row 0 is that of words without a letter."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.chars = 0
        self.scores = np.zeros((1, self.weights.shape[1]), np.float32)

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.memo) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self.clear()
        missing = list(set().union(*texts).difference(self.memo))
        spelled, long = [], []
        for w in missing:
            self.chars += len(w)
            if len(w) > LONG_WORD and has_letter(w):
                long.append(w)
            elif has_letter(w):
                self.memo[w] = len(self.scores) + len(spelled)
                spelled.append(w)
            else:
                self.memo[w] = 0
        if spelled:
            h, starts = word_features(spelled)
            self.scores = np.concatenate([self.scores, np.add.reduceat(self.weights[h], starts, axis=0)])
        for w in long:
            self.memo[w] = len(self.scores)
            self.scores = np.concatenate([self.scores, long_word_score(w, self.weights)[None]])
        return [np.fromiter(map(self.memo.__getitem__, t), np.int64, len(t)) for t in texts]


def train(texts: list[str], languages: list[str], epochs: int = EPOCHS, seed: int = 5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, hashed feature weights, and transitions."""
    names = sorted(set(languages))
    known = {n: i for i, n in enumerate(names)}
    vocabulary: dict[str, int] = {}
    docs = []
    for text, lang in zip(texts, languages, strict=True):
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) if has_letter(w) else -1 for w in text.lower().split()], np.int64)
        if len(ids) and ids.max() >= 0:
            docs.append((ids, known[lang]))
    weights, transition = Adagrad((BUCKETS, len(names)), 0.2, 1e-6), Adagrad((len(names), len(names)), 0.2)
    if not docs:
        return names, weights.w, transition.w
    h, starts = word_features(list(vocabulary))
    ends = np.append(starts[1:], len(h))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        ahead = np.cumsum([len(docs[i][0]) for i in order]) // BATCH_WORDS
        for part in ([docs[i] for i in order[ahead == k]] for k in np.unique(ahead)):
            ids = np.concatenate([p[0] for p in part])
            lengths = np.array([len(p[0]) for p in part])
            labels = np.repeat([p[1] for p in part], lengths)
            spelled = ids >= 0
            words, where = np.unique(ids[spelled], return_inverse=True)
            many = ends[words] - starts[words]
            first = np.cumsum(many) - many
            feats = h[np.repeat(starts[words] - first, many) + np.arange(many.sum())]
            scores = np.add.reduceat(weights.w[feats], first, axis=0)
            emission = np.zeros((len(ids), len(names)))
            emission[spelled] = scores[where]
            by_item, by_pair = gradients(emission, lengths, transition.w.astype(np.float64), labels)
            by_word = np.stack([np.bincount(where, by_item[spelled, k], len(words)) for k in range(len(names))], axis=1)
            units = len(ids) / 64
            touched, spot = np.unique(feats, return_inverse=True)
            by_feature = np.repeat(by_word, many, axis=0)
            grad = np.stack([np.bincount(spot, by_feature[:, k], len(touched)) for k in range(len(names))], axis=1)
            weights.step(grad / units, touched)
            transition.step(by_pair / units)
    return names, weights.w, transition.w


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded sample, in a fixed order. Characters are bounded before anything is collected."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    texts = usable.select("doc_id", "lang", "text").where(F.length("text") <= LONGEST_SAMPLE_TEXT)
    picked = bounded_sample(texts, ["doc_id", "text"], SAMPLE_DOCS, "text", SAMPLE_CHARS)
    rows = sorted(picked.collect(), key=lambda r: (hash_order(r["doc_id"]), r["lang"], r["text"]))
    return [(r["text"], r["lang"]) for r in rows]


def hash_order(doc_id: int | None) -> int:
    return ((doc_id or 0) * 0x9E3779B97F4A7C15) % 2**64


def _sums(scorer: WordScorer, texts: list[list[str]], transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginals of each text's words with a letter, summed, and how many they are."""
    rows = scorer.rows(texts)
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows)
    if not len(flat) or not len(transition):
        return np.zeros((len(rows), len(transition))), np.zeros(len(rows))
    got, _, _ = marginals(scorer.scores[flat], lengths, transition)
    spelled = (flat > 0).astype(np.float64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    sums = np.stack([np.bincount(owner, got[:, k] * spelled, len(rows)) for k in range(len(transition))], axis=1)
    return sums, np.bincount(owner, spelled, len(rows))


def _long_sums(scorer: WordScorer, data: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_sums``, for one text that goes through in pieces."""
    sums, count = np.zeros((1, len(transition))), np.zeros(1)
    spelled: list[np.ndarray] = []

    def emissions() -> Iterator[np.ndarray]:
        for piece in pieces_at(data, WHITE, CHUNK_BYTES):
            words = piece.decode("utf-8", "surrogatepass").lower().split()
            if words:
                rows = scorer.rows([words])[0]
                spelled[:] = [rows > 0]
                yield scorer.scores[rows]

    for got in long_marginals(emissions, transition) if len(transition) else ():
        sums[0] += got[spelled[0]].sum(axis=0)
        count[0] += spelled[0].sum()
    return sums, count


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the columns named in ``carry`` unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = ("doc_id", "held_out", "lang_pred", "score")
    more = [c for c in carry or [] if c not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language")
        names, weights, transition = sent.value
        scorer = WordScorer(weights)
        for batch in batches:
            for part in by_bytes(batch, 2, CHUNK_BYTES, 512):
                if part.num_rows == 1 and part.column(2)[0].is_valid and len(data := utf8(part.column(2), 0)) > CHUNK_BYTES:
                    sums, count = _long_sums(scorer, data, transition)
                else:
                    sums, count = _sums(scorer, [(t.as_py() or "").lower().split() for t in part.column(2)], transition)
                lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                best = sums.argmax(axis=1) if names else []
                for i in np.flatnonzero(count) if names else []:
                    lang[i] = names[best[i]]
                    score[i] = min(1.0, sums[i, best[i]] / count[i])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *(part.column(3 + k) for k in range(len(more)))], names=[*own, *more])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("_text"), *more)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *(docs.schema[c] for c in more)])
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Train on the bounded sample, predict every row."""
    sample = training_rows(docs)
    return predict(docs, train([t for t, _ in sample], [x for _, x in sample]), carry)
