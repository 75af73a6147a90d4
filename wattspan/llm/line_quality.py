"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. A line is described by measures of its own and of the lines before and after it;
each measure is cut into the sample's quantile bins, so a line's emission is a sum of table entries.
Forward-backward over the whole chain of a text's lines gives each line's marginal; a document's quality is their average by length, brought to the scale of the labels by a logistic fit.

Training takes a bounded sample (``SAMPLE_DOCS`` to twice as many of each class, ``SAMPLE_CHARS`` characters, no text above
``LONGEST_SAMPLE_TEXT``; of an id with several texts the least) of labelled documents that are not held
out; each line takes its document's label, and classes weigh the same. The
labels' own ratio returns in the logistic fit. Prediction is a map over documents with a model of fixed
size.

Null and empty texts are one empty line. Rows that repeat are scored each alone; null ids are kept and
count as not held out. Texts and lines of any length take bounded memory beside themselves, but for one hash a line and a word. A document with several labels is taken with the least. Without labels of both
kinds every score is the share of label 1, or 0.5 without any. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspan.llm.common import bounded_sample, by_bytes, held_out, pieces_at, utf8
from wattspan.llm.crf import Adagrad, gradients, long_marginals, marginals
from wattspan.llm.language_id import hash_order
from wattspan.llm.workers import hold

BINS = 10
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 5_000_000
LONGEST_SAMPLE_TEXT = 100_000
EPOCHS = 30
THRESHOLD = 0.7
#: Bytes of text that are worked on at once. A longer text goes through in pieces, and so does a longer line's
#: list of words; both with the same measures and marginals.
CHUNK_BYTES = 1_000_000
#: Lines whose table entries are summed at once.
LINES_AT_ONCE = 16_384
WHITE = b" \t\n\r\x0b\x0c"

_SYMBOLS, _MARKS, _STOPS, _BARS = b"#*$%&<>^~=_{}[]\\@", b"!?", b".,;:", b"|"
_DIGITS, _UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HIGH = bytes(range(128, 256))
MEASURES = 17


def word_measures(line: bytes) -> tuple[int, int, int, int, bytes]:
    """Words, distinct words, words equal to the one before, bytes of the longest, and the first byte of the first."""
    if len(line) <= CHUNK_BYTES:
        words = line.split()
        return len(words), len(set(words)), sum(map(bytes.__eq__, words, words[1:])), max(map(len, words), default=0), words[0][:1] if words else b""
    k, runs, longest, first, last, hashes = 0, 0, 0, b"", None, np.zeros(0, np.uint64)
    for piece in pieces_at(np.frombuffer(line, np.uint8), WHITE, CHUNK_BYTES):
        words = piece.split()
        if words:
            k += len(words)
            runs += sum(map(bytes.__eq__, words, words[1:])) + (words[0] == last)
            longest, first, last = max(longest, max(map(len, words))), first or words[0][:1], words[-1]
            hashes = np.union1d(hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, set(words)), np.uint64))
    return k, len(hashes), runs, longest, first


def line_measures(line: bytes, seen_before: bool) -> list[float]:
    """The measures of one line of UTF-8 text."""
    n = len(line)
    if not n:
        return [0.0] * (MEASURES - 1) + [float(seen_before)]
    k, distinct, runs, longest, first = word_measures(line)
    share = lambda kind: (n - len(line.translate(None, kind))) / n
    return [
        np.log1p(n),
        np.log1p(k),
        n / (k + 1),
        share(_SYMBOLS),
        share(_MARKS),
        share(_STOPS),
        share(_BARS),
        share(_DIGITS),
        share(_UPPER),
        share(_HIGH),
        distinct / k if k else 0.0,
        runs / k if k else 0.0,
        float(line.rstrip()[-1:] in (b".", b"!", b"?")),
        float(first.isupper()),
        len(set(line)) / min(n, 64),
        longest,
        float(seen_before),
    ]


def described_lines(lines: list[bytes], seen: np.ndarray) -> np.ndarray:
    """Measures of lines, of which ``seen`` tells those that stand earlier in their text."""
    out = np.zeros((len(lines), MEASURES), np.float32)
    for i, (line, again) in enumerate(zip(lines, seen.tolist(), strict=True)):
        out[i] = line_measures(line, again)
    return out


def document_measures(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Measures of all lines, and the lines' lengths (at least 1, as weights)."""
    lines = (text or b"").split(b"\n")
    seen: set[bytes] = set()
    again = np.zeros(len(lines), bool)
    for i, line in enumerate(lines):
        again[i] = bool(line) and line in seen
        seen.add(line)
    return described_lines(lines, again), np.array([len(x) + 1 for x in lines], np.float64)


def line_pieces(data: np.ndarray) -> Iterator[list[bytes]]:
    """The lines of a text, about ``CHUNK_BYTES`` of them at a time."""
    ended = False
    for piece in pieces_at(data, b"\n", CHUNK_BYTES):
        ended = piece.endswith(b"\n")
        yield (piece[:-1] if ended else piece).split(b"\n")
    if ended or not len(data):
        yield [b""]


def seen_lines(data: np.ndarray) -> np.ndarray:
    """Which lines of a long text stand earlier in it, by 64-bit hashes."""
    hashes = np.concatenate([np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines)) for lines in line_pieces(data)])
    order = np.argsort(hashes, kind="stable")
    again = np.zeros(len(hashes), bool)
    again[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
    return again & (hashes != np.uint64(xxhash.xxh3_64_intdigest(b"")))


class LineModel:
    def __init__(self, cuts: np.ndarray, tables: np.ndarray, transition: np.ndarray, slope: float, offset: float):
        self.cuts, self.tables, self.transition, self.slope, self.offset = cuts, tables, transition, slope, offset

    def own_bins(self, measures: np.ndarray) -> np.ndarray:
        """Table rows of each line's own measures."""
        own = np.stack([np.searchsorted(self.cuts[j], measures[:, j], side="right") for j in range(MEASURES)], axis=1).astype(np.int16)
        return own + (np.arange(MEASURES) * (BINS + 1)).astype(np.int16)

    def bins(self, measures: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Table rows of each line: its own bins, those of the line before, those of the line after."""
        return self._beside(self.own_bins(measures), lengths)

    def _beside(self, own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        edge = MEASURES * (BINS + 1)
        first = np.cumsum(lengths) - lengths
        before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
        before[first] = edge
        after[np.cumsum(lengths) - 1] = edge
        return np.concatenate([own, before + np.int16(edge + 1), after + np.int16(2 * (edge + 1))], axis=1)

    def emissions(self, bins: np.ndarray) -> np.ndarray:
        parts = [self.tables[bins[i : i + LINES_AT_ONCE]].sum(axis=1) for i in range(0, len(bins), LINES_AT_ONCE)]
        return np.concatenate(parts).astype(np.float64)

    def good(self, measures: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Length-weighted marginal of "good" of each document."""
        got, _, _ = marginals(self.emissions(self.bins(measures, lengths)), lengths, self.transition.astype(np.float64))
        owner = np.repeat(np.arange(len(lengths)), lengths)
        return np.bincount(owner, got[:, 1] * weights, len(lengths)) / np.bincount(owner, weights, len(lengths))

    def good_of_long(self, data: np.ndarray) -> float:
        """As ``good``, of one text whose lines go through in pieces."""
        again = seen_lines(data)
        sizes: list[np.ndarray] = []

        def own() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            at = 0
            for lines in line_pieces(data):
                yield self.own_bins(described_lines(lines, again[at : at + len(lines)])), np.array([len(x) + 1 for x in lines], np.float64)
                at += len(lines)

        def emissions() -> Iterator[np.ndarray]:
            sizes.clear()
            before, held = None, None
            for after in chain(own(), [None]):
                if held is not None:
                    rows = [*([before] if before is not None else []), held[0], *([after[0][:1]] if after is not None else [])]
                    whole = np.concatenate(rows)
                    begin = 0 if before is None else 1
                    sizes.append(held[1])
                    yield self.emissions(self._beside(whole, np.array([len(whole)]))[begin : begin + len(held[0])])
                    before = held[0][-1:]
                held = after

        total = good = 0.0
        for got in long_marginals(emissions, self.transition.astype(np.float64)):
            good += float(got[:, 1] @ sizes[-1])
            total += float(sizes[-1].sum())
        return good / total

    def score(self, good: np.ndarray) -> np.ndarray:
        g = np.clip(good, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(g / (1 - g)) + self.offset)))


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak pull to (1, 0)."""
    w = np.array([1.0, 0.0])
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weights * (p - y)) + 0.1 * (w - [1, 0])
        hess = (a * (weights * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    return max(float(w[0]), 1e-3), float(w[1])


def train(texts: list[bytes], labels: list[int], share_good: float | None = None, epochs: int = EPOCHS, seed: int = 3) -> LineModel:
    """``share_good``: of label 1 among all labelled rows, where the sample is balanced otherwise."""
    y = np.array(labels)
    cuts = np.zeros((MEASURES, BINS), np.float32)
    width = 3 * (MEASURES * (BINS + 1) + 1)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        odds = np.clip(share, 1e-6, 1 - 1e-6)
        return LineModel(cuts, np.zeros((width, 2), np.float32), np.zeros((2, 2), np.float32), 0.0, float(np.log(odds / (1 - odds))))
    described = [document_measures(t) for t in texts]
    everything = np.concatenate([m for m, _ in described])
    for j in range(MEASURES):
        cuts[j] = np.quantile(everything[:, j], np.linspace(0, 1, BINS + 2)[1:-1])
    model = LineModel(cuts, np.zeros((width, 2), np.float32), np.zeros((2, 2), np.float32), 1.0, 0.0)
    lengths = np.array([len(m) for m, _ in described])
    binned = model.bins(everything, lengths)
    starts = np.cumsum(lengths) - lengths
    tables, transition = Adagrad((width, 2), 0.1, 1e-3), Adagrad((2, 2), 0.05, 1e-3)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            size = lengths[part]
            rows = np.repeat(starts[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            label = np.repeat(y[part], size)
            emission = tables.w[binned[rows]].sum(axis=1).astype(np.float64)
            by_line, by_pair = gradients(emission, size, transition.w.astype(np.float64), label)
            by_line *= np.repeat(balance[part] / size, size)[:, None]  # every document weighs the same
            grad = np.stack([np.bincount(binned[rows].ravel(), np.repeat(by_line[:, k], binned.shape[1]), width) for k in range(2)], axis=1)
            tables.step(grad / len(part))
            transition.step(by_pair / len(rows))
    model.tables, model.transition = tables.w, transition.w
    good = np.clip(model.good(everything, lengths, np.concatenate([w for _, w in described])), 1e-6, 1 - 1e-6)
    share = y.mean() if share_good is None else share_good
    model.slope, model.offset = _logistic(np.log(good / (1 - good)), y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return model


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[bytes, int]], float | None]:
    """The bounded sample of both classes, and the share of label 1 among all usable labels."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    one = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in one.groupBy("quality").count().collect()}
    total = sum(counts.values())
    if not total:
        return [], None
    picked = [bounded_sample(one.where(F.col("quality") == k), "doc_id", SAMPLE_DOCS) for k in sorted(counts)]
    chosen = picked[0] if len(picked) == 1 else picked[0].union(picked[1])
    texts = docs.select(F.col("doc_id").alias("text_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = texts.where(F.length("text") <= LONGEST_SAMPLE_TEXT).join(F.broadcast(chosen), F.col("text_id") == F.col("doc_id"))
    each = joined.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    # At most four times SAMPLE_DOCS rows, of which characters are bounded before they are collected.
    so_far = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = each.withColumn("_chars", F.sum(F.length("text")).over(so_far)).where(F.col("_chars") <= SAMPLE_CHARS // 2)
    rows = bounded.select("doc_id", "quality", "text").collect()
    out = [(r["text"].encode("utf-8", "surrogatepass"), r["quality"]) for r in sorted(rows, key=lambda r: (hash_order(r["doc_id"]), r["text"]))]
    return out, counts.get(1, 0) / total


def predict(docs: DataFrame, model: LineModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("lines")
        own = sent.value
        for batch in batches:
            for part in by_bytes(batch, 2, CHUNK_BYTES):
                if part.num_rows == 1 and part.column(2)[0].is_valid and len(data := utf8(part.column(2), 0)) > CHUNK_BYTES:
                    score = own.score(np.array([own.good_of_long(data)]))
                else:
                    described = [document_measures(t.as_py()) for t in part.column(2).cast(pa.binary())]
                    lengths = np.array([len(m) for m, _ in described])
                    score = own.score(own.good(np.concatenate([m for m, _ in described]), lengths, np.concatenate([w for _, w in described])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the bounded sample of labelled rows, score every row."""
    sample, share = training_rows(docs, labels)
    return predict(docs, train([t for t, _ in sample], [k for _, k in sample], share))
