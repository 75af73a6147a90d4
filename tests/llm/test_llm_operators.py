"""Training-data operators on small tables with odd rows, each against a plain version."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspan.llm import bit_planes, byte_bpe, components, jaccard_join, language_id, licenses, line_quality, packing, pivot_index, quality_rules, warc
from wattspan.llm import common
from wattspan.llm.common import scratch_path
from wattspan.llm import crf
from wattspan.llm.crf import gradients, marginals

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "ünd", "été", "naïve", "x1", "42"]) + str(rng.randrange(40)) for _ in range(n))


def texts():
    """Odd texts: null, empty, blank, short, long, repeated, of one word, without spaces, with odd characters."""
    rng = random.Random(7)
    base = sentence(rng, 120)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (3, 60)]
    return [
        None, "", "   \n\t ", "one", "one two three four", base, base, base.upper(), *near, "again " * 400, "\n".join([base[:80]] * 12),
        "x" * 3000, "a\x1cb c d　e\x85f", "Σίσυφος ΟΔΟΣ ﬁ é Å 한글 日本語 🙂🙂", "don't WE'LL 's 't !!! ???  \n\n  end", sentence(rng, 5000), "Licensed under the Apache License, Version 2.0.\n" + base,
        "<|endoftext|> tail", "EDTH!! ERERER!! ONHABLE!! " * 20, "stt | ier | gezu | keit | enk | ung | auf | das | zu | st | " * 5,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "src", 1) for i, t in enumerate(texts())] + [(None, "no id at all but some words", "en", None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# Byte-level BPE.


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.BytePairCoder(byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def test_byte_bpe_is_tiktokens(spark, docs, nothing, coder):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    clash = docs.withColumn("words", F.lit(1)).withColumn("token_ids", F.lit("x"))
    encoded = coder.encode(clash)
    assert "words" not in encoded.columns
    for r in encoded.select("doc_id", "text", "token_ids").collect():
        assert r["token_ids"] == plain.encode_ordinary(r["text"] or ""), r["doc_id"]
    for r in byte_bpe.digest(encoded, coder).join(docs, "doc_id").collect():
        t = (r["text"] or "").encode()
        assert r["decoded_sha256"] == hashlib.sha256(t).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, plain.encode_ordinary(r["text"] or ""))).encode()).hexdigest()
    assert coder.encode(nothing).count() == 0


# Packing.


def encoded_by_library(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing_keeps_ids_exactly(spark):
    """Ids beyond 2**53 beside a null one."""
    rows = [(2**53 + 1, "one two"), (2**60 - 1, "three"), (-(2**63), "four"), (None, "five")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}


def test_packing_of_many_shards(spark):
    """What shards lose against one packing of everything: at most an open sequence or so each."""
    rng = random.Random(4)
    lengths = [(i, 0, 0, min(2048, 1 + int(rng.lognormvariate(5.5, 1))), i) for i in range(8000)]
    cut = spark.createDataFrame(lengths, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    placed = packing.pack(cut, 2048, shard_pieces=1000).select("sequence_id", "length").toPandas()
    fill = placed.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and len(placed) == 8000
    least = -(-sum(x[3] for x in lengths) // 2048)
    one, _ = packing.sum_of_squares(np.sort([x[3] for x in lengths])[::-1], 2048)
    assert least <= one.max() + 1 <= len(fill) <= one.max() + 1 + 2 * 8


def test_packing_places_every_piece_once(spark, docs, nothing):
    encode = encoded_by_library("word_bpe_49k.json", 0)
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=64, with_ids=True).collect()
    want = {i: encode(t) for i, t in enumerate(texts())} | {None: encode("no id at all but some words")}
    seen = collections.Counter()
    sequences = collections.defaultdict(list)
    for r in rows:
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 64 * r["piece"] and bytes(r["ids"]) == part.tobytes() and r["ids_crc32"] == zlib.crc32(part.tobytes())
        seen[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == {k: len(v) for k, v in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(seen.values()) // 64) + 2
    assert packing.pack_documents(nothing, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_sum_of_squares_takes_the_least_sum():
    rng = np.random.default_rng(2)
    lengths, capacity = rng.integers(1, 21, 200), 20
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    fill: dict[int, int] = {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        def total(level):
            n = collections.Counter(capacity - v for v in level.values() if v < capacity)
            return sum(k * k for k in n.values())

        choices = [total({**fill, i: v + s}) for i, v in fill.items() if v + s <= capacity] or [total({**fill, len(fill): s})]
        assert fill.get(b, 0) == o
        fill[b] = fill.get(b, 0) + s
        assert total(fill) == min(choices)


# Bit planes.


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 4096, 4097, 10_000])
def test_chunk_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    chunk = bit_planes.encode_chunk(ids, kind)
    assert np.array_equal(bit_planes.decode_chunk(chunk), ids)
    if n:
        with pytest.raises(ValueError):
            bit_planes.decode_chunk(chunk[:-1] + bytes([chunk[-1] ^ 255]))


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_archive_in_document_order(spark, docs, nothing, kind):
    encode = encoded_by_library("byte_bpe_50k.json", 2)
    path = scratch_path(spark, "t")
    bit_planes.write_archive(docs.unionByName(docs.where("doc_id = 5")), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2, kind, chunk_ids=500)
    rows = sorted(bit_planes.read_archive(spark, path).collect(), key=lambda r: r["start"])
    order = [None, *range(6), 5, *range(6, len(texts()))]
    assert [r["doc_id"] for r in rows] == order
    at = 0
    for r in rows:
        ids = encode("no id at all but some words" if r["doc_id"] is None else texts()[r["doc_id"]])
        assert (r["start"], r["n_tokens"], bytes(r["ids"]), r["ids_crc32"]) == (at, len(ids), ids.tobytes(), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert bit_planes.round_trip(nothing, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2).count() == 0


# WARC.


def test_warc_revisits(spark):
    big, other = "<p>" + "y" * 1200, "<p>" + "ü\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "http://c", "small"), (5, "http://d", "small"), (6, "http://e", None), (7, "http://f\r\nX: y", ""), (8, "http://g", other), (9, "http://g", other), (9, "http://g", other), (None, "http://h", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2))
    got = warc.archive_pages(pages).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["page_id"]].append((r["record_type"], r["refers_to"]))
    assert by[3] == [("response", None)] and by[1] == by[2] == by[None] == [("revisit", 3)]
    assert [by[k] for k in (4, 5, 6, 7)] == [[("response", None)]] * 4
    assert by[8] == [("revisit", 9)] and sorted(by[9], key=str) == [("response", None), ("revisit", 9)]
    for r in got:
        html = {i: h for i, _, h in rows}[r["page_id"]] or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_keeps_payloads(spark):
    pages = spark.createDataFrame([(i, "http://x", f"<p>{'z' * 2000}{i % 2}") for i in range(6)], "page_id bigint, url string, html string")
    raw, clean = scratch_path(spark, "w"), scratch_path(spark, "w")
    warc.write_archives(warc.pages_to_records(pages), raw, compression="none")
    warc.deduplicate_archives(spark, raw, clean)
    back = collected(warc.read_archives(spark, clean), "page_id")
    assert bytes(back[5]["payload"]).decode() == f"<p>{'z' * 2000}1" and bytes(back[1]["payload"]) == b""
    files = spark.read.format("binaryFile").load(raw).collect()
    assert all(bytes(f["content"]).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and bytes(f["content"]).endswith(b"\r\n\r\n") for f in files if f["length"])


def test_warc_files_are_members_with_headers_of_the_standard(spark):
    import gzip

    text = "<p>" + "w" * 1500
    pages = spark.createDataFrame([(i, f"http://x/{i}", text if i % 2 else f"{text}{i}") for i in range(40)] + [(1, "http://x/1", text)] * 2, "page_id bigint, url string, html string")
    raw, clean = scratch_path(spark, "w"), scratch_path(spark, "w")
    warc.write_archives(warc.pages_to_records(pages), raw, file_bytes=2000)
    warc.deduplicate_archives(spark, raw, clean)
    files = [bytes(f["content"]) for f in spark.read.format("binaryFile").load(raw).collect()]
    assert len(files) > 4 and all(len(f) < 2000 + 1000 for f in files)
    ids = {}
    for f in (bytes(x["content"]) for x in spark.read.format("binaryFile").load(clean).collect()):
        whole = gzip.decompress(f)
        at = 0
        for head, _, record, offset in warc.parse(iter([whole])):
            assert head["warc-record-id"] not in ids and whole[offset : offset + len(record)] == record
            ids[head["warc-record-id"]] = head
            at += 1
        # Every record begins at a member of its own.
        starts = [k for k in range(len(f)) if f[k : k + 4] == b"\x1f\x8b\x08\x00"]
        assert sum(gzip.decompress(f[k:])[:9] == b"WARC/1.1\r" for k in starts if f[k:]) >= at
    assert len(ids) == 42
    revisits = [h for h in ids.values() if h["warc-type"] == "revisit"]
    assert len(revisits) == 21
    for h in revisits:
        assert ids[h["warc-refers-to"]]["warc-type"] == "response"
        assert h["warc-refers-to-target-uri"] == "http://x/39" and h["warc-refers-to-date"] == warc.DATE and h["warc-profile"] == warc.PROFILE


def test_foreign_records_pass_through(spark, tmp_path):
    import gzip

    def record(kind, block, **more):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items())
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Date: 2020-02-02T00:00:00Z\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    body = b"z" * 2000
    http = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + body
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    parts = [
        record("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        record("response", http, Content_Type="application/http; msgtype=response", WARC_Target_URI="http://a", WARC_Payload_Digest=f"sha1:{sha}"),
        record("response", http, Content_Type="application/http; msgtype=response", WARC_Target_URI="http://b"),
        record("resource", b"plain", Content_Type="text/plain"),
    ]
    for name, data in (("one.warc.gz", gzip.compress(b"".join(parts))), ("two.warc", b"".join(parts))):
        (tmp_path / name).write_bytes(data)
    clean = scratch_path(spark, "w")
    warc.deduplicate_archives(spark, f"file://{tmp_path}", clean, compression="none")
    back = warc.read_archives(spark, clean).collect()
    kinds = collections.Counter(r["record_type"] for r in back)
    assert kinds == {"warcinfo": 2, "request": 2, "resource": 2, "response": 1, "revisit": 3}
    assert {bytes(r["raw"]) + b"\r\n\r\n" for r in back if r["record_type"] in ("warcinfo", "request", "resource")} == {parts[0], parts[1], parts[4]}
    assert all(b"Server: s" in bytes(r["http"]) for r in back if r["record_type"] in ("response", "revisit"))
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "x.warc").write_bytes(parts[2].replace(b"zz", b"zy"))
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archives(spark, f"file://{broken}").collect()


# Quality rules.


def base_measures(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in (x for x in t.split("\n") if WORD.search(x)):
        dup += line in seen
        seen.add(line)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(win)
    covered = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_rules(spark, docs, nothing):
    judged = quality_rules.judge(docs.withColumn("kept", F.lit("clash")).withColumn("_q_words", F.lit(1)))
    for r in judged.collect():
        want = base_measures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in judged.where("kept").collect()}
    assert {5, 6, 8, 9, 16, 17} <= kept and not kept & {0, 1, 2, 10, 12, 19, 20}
    assert quality_rules.judge(nothing).count() == 0


def test_verdict_does_not_depend_on_the_order(spark, docs):
    rules = quality_rules.default_rules()
    m = quality_rules.measured(docs)
    a = [r["k"] for r in m.select(quality_rules.cascade(rules).isNull().alias("k")).collect()]
    b = [r["k"] for r in m.select(quality_rules.cascade(rules[::-1]).isNull().alias("k")).collect()]
    assert a == b


def test_rules_are_ordered_by_rejection_per_cost(spark, docs):
    never, often = quality_rules.Rule("never", F.lit(False)), quality_rules.Rule("often", F.col("n_words") > 0)
    ordered = quality_rules.order_rules(quality_rules.measured(docs).where("NOT base_failed"), [never, often])
    assert [r.name for r, _, _ in ordered] == ["often", "never"]


def test_order_goes_by_cost_where_nothing_is_rejected():
    none = np.zeros((100, 3), bool)
    assert quality_rules.greedy_order(none, [0.3, 0.1, 0.2]) == [1, 2, 0]
    # The same documents fail rules 0 and 1: after rule 0, rule 1 rejects nothing more and rule 2 goes first.
    both = np.zeros((100, 3), bool)
    both[:50, 0] = both[:45, 1] = both[60:70, 2] = True
    assert quality_rules.greedy_order(both, [1.0, 1.0, 1.0]) == [0, 2, 1]


def test_a_slow_rule_goes_after_a_fast_one(spark):
    m = quality_rules.measured(spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(400))) for i in range(400)], "doc_id bigint, text string"))
    sample, _ = common.materialise(m, "rules")
    slow = F.size(F.filter("_q_words", lambda w: w.rlike("(a|b|c)+(d|e)+$"))) > 400
    for at_least in (0, 200):  # both rules reject nothing, or the same half
        half = F.col("doc_id") < at_least
        rules = [quality_rules.Rule("a_slow", slow | half), quality_rules.Rule("b_fast", (F.col("n_words") < 0) | half)]
        assert [r.name for r, _, _ in quality_rules.order_rules(sample, rules)] == ["b_fast", "a_slow"]
    assert quality_rules.order_rules(sample, []) == []


# Licences.


def test_licences(spark, nothing):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "Text.\nReleased under the MIT License. More text"), (3, bsd), (4, None), (5, ""), (6, "You may obtain a copy of the License at:\n"), (7, "MIT License"), (8, "Released under the MIT License.\n" * 3 + "Licensed under CC BY-NC 4.0."), (None, "All rights reserved.")]
    got = collected(licenses.recognise(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("licenses", F.lit(0)).withColumn("ids", F.lit(0))))
    assert [got[k]["licenses"] for k in (1, 2, 3, 4, 5, 6, 7, 8, None)] == ["Apache-2.0", "MIT", "BSD-2-Clause", "", "", "", "", "CC-BY-NC-4.0,MIT", ""]
    assert got[6]["unknown_sentences"] == 1 and got[8]["unknown_sentences"] == 0 and got[8]["n_license_sentences"] == 4
    assert licenses.recognise(nothing).count() == 0


def test_every_known_sentence_has_an_anchor():
    known = {**licenses.SENTENCES, **licenses.WHOLE, **licenses.TEXTS}
    assert all(any(a in s for a in licenses.ANCHORS) for s in known)
    assert all(licenses.normal(s) == s for s in known)
    rules = {i for _, ids in licenses.RULES for i in ids} | {i for _, i in licenses.SINGLE}
    assert set(known.values()) <= rules | {"bsd-grant-0"} and len({name for name, _ in licenses.SINGLE}) >= 40


# Conditional random fields.


def brute_marginals(emission, lengths, transition):
    import itertools

    out, at = np.zeros_like(emission), 0
    for n in lengths:
        total = 0.0
        for path in itertools.product(range(emission.shape[1]), repeat=int(n)):
            w = np.exp(sum(emission[at + i, k] for i, k in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            for i, k in enumerate(path):
                out[at + i, k] += w
        out[at : at + n] /= total
        at += n
    return out


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 5, 3, 5, 2])
    e, t = rng.normal(size=(16, 3)), rng.normal(size=(3, 3))
    got, pairs, log_z = marginals(e, lengths, t, with_pairs=True)
    assert np.allclose(got, brute_marginals(e, lengths, t))
    assert np.isclose(pairs.sum(), (lengths - 1).sum())
    y = rng.integers(0, 3, 16)
    by_e, by_t = gradients(e, lengths, t, y)

    def loss(e, t):
        at, score = 0, 0.0
        for n in lengths:
            score += e[np.arange(at, at + n), y[at : at + n]].sum() + t[y[at : at + n - 1], y[at + 1 : at + n]].sum()
            at += n
        return marginals(e, lengths, t)[2] - score

    step = 1e-5
    for i, k in ((0, 0), (7, 2), (15, 1)):
        d = e.copy()
        d[i, k] += step
        assert np.isclose((loss(d, t) - loss(e, t)) / step, by_e[i, k], atol=1e-3)
    d = t.copy()
    d[1, 2] += step
    assert np.isclose((loss(e, d) - loss(e, t)) / step, by_t[1, 2], atol=1e-3)


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_blocks_of_chains_change_nothing(monkeypatch, block):
    """Chains longer than a block have the marginals of whole chains."""
    rng = np.random.default_rng(block)
    lengths = np.array([1, 6, 0, 3, 4, 2, 7])
    e, t = rng.normal(size=(23, 3)) * 2, rng.normal(size=(3, 3)) * 2
    monkeypatch.setattr(crf, "BLOCK", 64)
    want, pairs, log_z = marginals(e, lengths, t, with_pairs=True)
    assert np.allclose(want, brute_marginals(e, lengths[lengths > 0], t))
    monkeypatch.setattr(crf, "BLOCK", block)
    got, again, z = marginals(e, lengths, t, with_pairs=True)
    assert np.allclose(got, want) and np.allclose(again, pairs) and np.isclose(z, log_z)


def test_a_chain_of_any_length():
    rng = np.random.default_rng(9)
    n = 50_000
    e, t = rng.normal(size=(n, 2)), np.array([[2.0, -2.0], [-2.0, 2.0]])
    got, _, _ = marginals(e, np.array([n]), t)
    alpha = np.empty((n, 2))
    step, now = np.exp(t), np.exp(e[0])
    for i in range(n):
        now = np.exp(e[i]) if i == 0 else (now @ step) * np.exp(e[i])
        now /= now.sum()
        alpha[i] = now
    beta = np.ones(2)
    for i in range(n - 1, -1, -1):
        p = alpha[i] * beta
        assert np.allclose(got[i], p / p.sum())
        beta = step @ (np.exp(e[i]) * beta)
        beta /= beta.sum()


def test_language_id(spark, docs, nothing):
    rng = random.Random(1)
    parts = {"en": ["the", "of", "and", "thing", "with"], "fr": ["le", "été", "dans", "eaux", "que"], "de": ["der", "und", "schön", "keit", "über"]}
    rows = [(i, " ".join(rng.choice(parts[k]) + rng.choice(["", "s", "e", "t"]) for _ in range(30)), k, "s", 1) for i in range(300) for k in [rng.choice(sorted(parts))]]
    train = spark.createDataFrame(rows, DOCS)
    odd = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10_000)
    got = language_id.identify(train.unionByName(odd).withColumn("score", F.lit("clash"))).collect()
    assert len(got) == 300 + odd.count()
    lang = {i: k for i, _, k, _, _ in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in lang]
    assert len(held) > 40 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert all(by[10_000 + k]["lang_pred"] == "und" and by[10_000 + k]["score"] == 0 for k in (0, 1, 2)) and None in by
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert language_id.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd).collect()} == {"und"}
    mixed = spark.createDataFrame([(1, " ".join(["the", "of", "and"] * 3 + ["été", "dans", "eaux", "que"] * 9), None, None, None)], DOCS)
    model = language_id.train([t for _, t, *_ in rows], [k for _, _, k, *_ in rows])
    assert language_id.predict(mixed, model, carry=["source", "text"]).first()["lang_pred"] == "fr"


def test_line_quality(spark, docs, nothing):
    rng = random.Random(3)
    good = lambda: "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(9)) for _ in range(12)) + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(["###", "buy", "$$$"] * 4) for _ in range(4))
    rows = [(i, good() if i % 4 else bad(), None, "s", 1) for i in range(400)]
    train = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 0), (1, None, 0), (9, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = line_quality.score_documents(train.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).withColumn("score", F.lit(0)), labels).collect()
    assert len(got) == 400 + docs.count()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert line_quality.score_documents(nothing, labels).count() == 0
    alone = line_quality.score_documents(docs, labels.limit(0)).collect()
    assert {round(r["score"], 6) for r in alone} == {0.5}


# Near duplicates.


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_case(spark, rows):
    s = shingle_sets(rows)
    ids = sorted(s)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (n := len(s[a] & s[b])) and 100 * n >= 75 * (len(s[a]) + len(s[b]) - n)]
    want = roots(ids, pairs)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(0)).withColumn("tokens", F.lit("x")).withColumn("component_id", F.lit(1))
    got = collected(jaccard_join.jaccard_components(frame))
    assert {k: got[k]["component_id"] for k in ids} == want
    assert {k: got[k]["n_shingles"] for k in ids} == {k: len(v) for k, v in s.items()}
    return want


def test_jaccard_odd_texts(spark, docs, nothing):
    jaccard_case(spark, list(enumerate(texts())))
    got = jaccard_join.jaccard_components(docs.unionByName(docs.where("doc_id = 5"))).collect()
    assert len(got) == docs.count() + 1
    assert [(r["component_id"], r["n_shingles"]) for r in got if r["doc_id"] is None] == [(None, 3)]
    assert jaccard_join.jaccard_components(nothing).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_near_the_threshold(spark, seed):
    """Chains of edits around 0.75, shared passages, and copies."""
    rng = random.Random(seed)
    rows, k = [], 0
    passage = [f"p{i}" for i in range(40)]
    for g in range(12):
        words = [f"w{g}_{i}" for i in range(rng.choice([12, 40, 90]))]
        for _ in range(rng.choice([1, 4, 9])):
            edited = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                edited += passage
            rows.append((k, " ".join(edited)))
            k += 1
            if rng.random() < 0.5:
                words = edited
    rng.shuffle(rows)
    want = jaccard_case(spark, rows)
    assert 1 < len(set(want.values())) < len(rows)


def test_filters_alone_give_the_same_components(spark, monkeypatch):
    """Without step 3 every link comes through the prefixes of all orders; buckets are small and many."""
    monkeypatch.setattr(jaccard_join, "BUCKET_BYTES", 2000)
    rng = random.Random(21)
    rows = []
    for g in range(10):
        words = [f"w{g}_{i}" for i in range(rng.choice([8, 30, 70]))]
        for _ in range(rng.choice([1, 3, 8])):
            edited = [f"e{rng.randrange(10**6)}" if rng.random() < 0.03 else w for w in words]
            rows.append((len(rows), " ".join(edited)))
    want = jaccard_case(spark, rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame, gather_first=False).collect()}
    assert got == want and 10 <= len(set(want.values())) < len(rows)
    assert jaccard_join.bucket_count(frame) > 4


def test_long_lists_are_paired_by_blocks():
    rng = np.random.default_rng(4)
    n = 90
    tokens, docs_ = np.repeat(np.array([5, 9], np.uint32), n), np.tile(np.arange(n), 2)
    labels = np.where(docs_ < 70, 0, docs_)
    sizes = rng.integers(80, 120, n)[docs_]
    shared = (sizes * rng.uniform(0.75, 1, n)[docs_]).astype(int)
    got = {tuple(x) for x in jaccard_join._pairs_of_bucket(tokens, docs_, labels, sizes, shared, 75).tolist()}
    s, h = {d: int(sizes[d]) for d in range(n)}, {d: int(shared[d]) for d in range(n)}
    fits = lambda a, b: 100 * min(s[a], s[b]) >= 75 * max(s[a], s[b]) and 175 * min(h[a], h[b]) >= 75 * (s[a] + s[b])
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if labels[a] != labels[b] and fits(a, b)}
    assert 0 < len(want) < n * n // 4
    assert got == want


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 400)).astype(np.uint64)) for _ in range(30)]
    maps = jaccard_join.parity_maps(np.concatenate(sets), np.repeat(np.arange(30), [len(s) for s in sets]), 30)
    for i in range(30):
        for j in range(30):
            assert np.bitwise_count(maps[i] ^ maps[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_jaccard_large_group_of_edited_copies(spark, monkeypatch):
    """Copies with light and heavy edits, in lists long enough for blocks and maps."""
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 4)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            k = rng.randrange(len(words))
            words[k] = rng.choice([base[(k + 1) % 60], f"e{rng.randrange(6)}"])
        rows.append((i * 3 % 101, " ".join(words)))
    want = jaccard_case(spark, rows)
    assert 1 < len(set(want.values())) < len(rows)


def test_components(spark):
    rng = random.Random(5)
    nodes = [rng.randrange(-(10**9), 10**9) for _ in range(300)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(200)] + [(nodes[0], x) for x in nodes[1:60]] + list(zip(nodes[100:140], nodes[101:141], strict=True)) + [(None, 1), (nodes[5], nodes[5])]
    want = roots(sorted({*nodes}), [(a, b) for a, b in pairs if a is not None])
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "x bigint, y bigint"), "x", "y").collect()}
    assert {n: got.get(n, n) for n in want} == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pivot_index(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(600):
        v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.25, 1.0])
        rows.append((i, v.tolist(), int(i % 3)))
    rows += [(600 + i, centres[0].tolist(), 0) for i in range(30)]
    odd = [None, [], [0.0] * 16, [1.0, None, *[0.0] * 14], [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]
    rows += [(700 + i, v, 1) for i, v in enumerate(odd)] + [(800, rows[0][1], None), (801, [x * 7 for x in rows[0][1]], 0)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])
    got = collected(pivot_index.near_duplicates(spark.createDataFrame(rows, schema).withColumn("count", F.lit(9)).withColumn("v", F.lit("clash"))), "vec_id")
    assert len(got) == len(rows)
    fine = [(i, np.array(v), k) for i, v, k in rows if k is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    pairs = []
    for k in range(3):
        ids = [i for i, _, x in fine if x == k]
        m = np.stack([v for _, v, x in fine if x == k])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        pairs += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.93, 1)), strict=True)]
    n = collections.Counter(x for p in pairs for x in p)
    found = sum(r["n_links"] for r in got.values())
    assert all(r["n_links"] <= n[i] for i, r in got.items())
    assert found >= 0.97 * sum(n.values())
    want = roots([i for i, *_ in rows], pairs)
    assert np.mean([got[i]["component_id"] == want[i] for i in got]) > 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    for i in [*range(700, 707), 800]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert pivot_index.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_blocks_of_long_lists(spark, monkeypatch):
    """Lists cut into blocks give the same links as whole ones."""
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=8) * 0.15 + 1).tolist(), 0) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    whole = {r["vec_id"]: r["n_links"] for r in pivot_index.near_duplicates(df).collect()}
    monkeypatch.setattr(pivot_index, "BLOCK", 64)
    assert {r["vec_id"]: r["n_links"] for r in pivot_index.near_duplicates(df).collect()} == whole and sum(whole.values()) > 1000


def test_byte_bpe_of_long_words(spark, coder):
    """Words of many pieces, whose joints must not change what folding the whole word gives."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(11)
    letters = lambda kinds, n: "".join(rng.choice(kinds) for _ in range(n))
    long = ["x" * 300_000, "x" * 301 + "y", letters("abcdefghijklmnopqrstuvwxyz", 20_000), letters("ab", 3000), "abc" * 700 + "a" * 333, "日本語" * 900, letters(["the", "and", "ing", "tion", "x", "é"], 900), "!" * 2000 + "?" * 65]
    frame = spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string").repartition(8)
    for r in coder.encode(frame).collect():
        assert r["token_ids"] == plain.encode_ordinary(r["text"]), r["doc_id"]


def test_byte_bpe_tables_have_no_collisions():
    rng = random.Random(2)
    for n in (0, 1, 2, 5000):
        hashes = [rng.getrandbits(64) for _ in range(n)]
        shifts, owner, bits, slot_bits = byte_bpe.place_apart(hashes)
        for i, h in enumerate(hashes):
            assert owner[((h >> bits) + shifts[h % 2**bits]) % 2**slot_bits] == i


def test_byte_bpe_of_a_vocabulary_that_does_not_fold_to_itself(spark):
    """A word that is a token is that token, even if folding its bytes ends elsewhere."""
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"xyz"]
    odd = byte_bpe.BytePairCoder(pieces, r"\S+|\s+")
    got = odd.encode(spark.createDataFrame([(1, "xyz abc xyzz")], "doc_id bigint, text string")).first()["token_ids"]
    assert got == [259, 32, 258, 32, 120, 121, 122, 122] and odd._odd is not None


def test_byte_bpe_plans_hold_no_tables(spark, docs, coder):
    assert len(coder.encode(docs)._jdf.queryExecution().toString()) < 200_000


def test_byte_bpe_keeps_frequent_words_that_share_a_hash(spark):
    folded = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("w"), F.col("id").alias("count"), F.array(F.col("id").cast("int")).alias("ids"))
    table = byte_bpe.WordTable(folded)
    found = folded.withColumn("_t", table.rows).select("ids", byte_bpe._let(F.struct(F.col("_t").alias("words")), lambda t: table.find(t, F.col("w"))).alias("v"))
    assert found.where("v <=> ids").count() == 20_000
