"""Texts beyond a chunk: pieces give what whole texts give, and memory does not grow with their number."""

import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from wattspan.llm import crf, language_id, line_quality
from wattspan.llm.common import by_bytes, pieces_at


@pytest.mark.parametrize("n", [1, 5, 64, 65, 1000])
@pytest.mark.parametrize("cut", [1, 7, 64, 300])
def test_pieces_of_a_chain(n, cut):
    rng = np.random.default_rng(n * cut)
    e, t = rng.normal(size=(n, 3)) * 2, rng.normal(size=(3, 3))
    whole, _, _ = crf.marginals(e, np.array([n]), t)
    parts = np.concatenate(list(crf.long_marginals(lambda: (e[i : i + cut] for i in range(0, n, cut)), t)))
    np.testing.assert_allclose(parts, whole, atol=1e-9)


def test_slices_and_pieces():
    texts = [None, "", "abc", "x" * 50, "y" * 9, None, "é" * 4, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["a", "t"])
    got = list(by_bytes(batch, 1, 10, rows=3))
    assert [v for b in got for v in b.column(1).to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len((v or "").encode()) for v in b.column(1).to_pylist()) <= 10 for b in got) and all(b.num_rows <= 3 for b in got)
    for text in (b"", b"a", b"a b  c\nlonger words here ", b"nothingtocutat"):
        parts = list(pieces_at(np.frombuffer(text, np.uint8), b" \n", 4))
        assert b"".join(parts) == text and all(p[-1:] in (b" ", b"\n") for p in parts[:-1])


def lines(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta.", "été", "THE", "x1", "#|$", "", "same"]
    return "\n".join(rng.choice(["", "same line again.", " ".join(rng.choices(words, k=rng.randrange(1, 15)))]) for _ in range(n))


def test_quality_of_a_text_in_pieces(monkeypatch):
    model = line_quality.train([lines(i, 30).encode() for i in range(40)] + [b"!!! $$$ " * (i % 7 + 1) for i in range(40)], [1] * 40 + [0] * 40, epochs=3)
    for text in (lines(1, 400), lines(2, 300) + "\n", "\n" * 200, "one line " * 300, "x"):
        data = text.encode()
        measures, weights = line_quality.document_measures(data)
        want = model.good(measures, np.array([len(measures)]), weights)[0]
        with monkeypatch.context() as m:
            m.setattr(line_quality, "CHUNK_BYTES", 64)
            assert model.good_of_long(np.frombuffer(data, np.uint8)) == pytest.approx(want, abs=1e-9)


def test_language_of_a_text_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    weights, transition = rng.normal(size=(language_id.BUCKETS, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    text = lines(5, 200) + " Σίσυφος ΟΔΟΣ " + "ab" * 700 + " 日本語　語 42"
    want, n = language_id._sums(language_id.WordScorer(weights), [text.lower().split()], transition)
    for name, value in (("CHUNK_BYTES", 100), ("LONG_WORD", 300), ("MEMO_CHARS", 500)):
        monkeypatch.setattr(language_id, name, value)
    got, k = language_id._long_sums(language_id.WordScorer(weights), np.frombuffer(text.encode(), np.uint8), transition)
    assert k[0] == n[0]
    np.testing.assert_allclose(got, want, rtol=1e-5)


MEMORY = """
import random, resource, sys
import numpy as np, pyarrow as pa
from wattspan.llm import language_id, line_quality
rng = random.Random(1)
words = ["w%d" % i for i in range(30000)]
text = " ".join(rng.choices(words, k=2000)) + ".\\n"
big = "".join(" ".join(rng.choices(words, k=12)) + "\\n" for _ in range(int(sys.argv[2]) // 80))
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
data = np.frombuffer(big.encode(), np.uint8)
if sys.argv[1] == "language":
    scorer = language_id.WordScorer(np.zeros((language_id.BUCKETS, 8), np.float32))
    language_id._long_sums(scorer, data, np.zeros((8, 8), np.float32))
else:
    line_quality.train([text.encode(), b"!!"], [1, 0], epochs=1).good_of_long(data)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""


@pytest.mark.parametrize("kind", ["language", "lines"])
def test_memory_beside_a_long_text(kind):
    """MB beside the text itself: about the same for 10 and for 40 MB."""
    grown = [int(subprocess.run([sys.executable, "-c", MEMORY, kind, str(n)], capture_output=True, text=True, check=True).stdout) for n in (10_000_000, 40_000_000)]
    assert grown[1] < 60 + grown[0] + 40 + 30, grown
