"""Prefix trie, Merkle manifest and chat formatting against plain versions."""

import collections
import hashlib
import json
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wattspan.llm import chat_format, merkle, prefix_trie, ranking

TURNS = "conv_id bigint, turn bigint, role string, text string"


def sha(text) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# Ranking.


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.randrange(1000), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int, tie int").repartition(7)
    got = ranking.numbered(df, [F.col("k"), F.col("v"), F.col("tie")], "g", "part", "numbers")
    placed = ranking.join_ranges(got, ranking.key_ranges(got, ["k"], "g", "part"), ["k"], "part").orderBy("g").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert [(r["k"], r["v"], r["tie"], r["g"]) for r in placed] == [(*w, i) for i, w in enumerate(want)]
    sizes = collections.Counter(w[0] for w in want)
    first = {}
    for i, w in enumerate(want):
        first.setdefault(w[0], i)
    assert all((r["start"], r["size"]) == (first[r["k"]], sizes[r["k"]]) for r in placed)


# Prefix trie.


def plain_trie(rows, group=100, heads=6):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = turns.get(c - int(math.fmod(c, group)), [])[:h] + own[h:]
    members, kids, leaves, saved = collections.defaultdict(list), collections.Counter(), collections.Counter(), collections.Counter()
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = lambda k, m: sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)))
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items()), key=str)


def trie_case(spark, rows, **sizes):
    df = spark.createDataFrame(rows, TURNS).withColumn("rank", F.lit(1)).withColumn("block", F.lit("clash"))
    got = prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(df), **sizes).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)
    return got


def random_turns(seed, n, most, words):
    rng = random.Random(seed)
    role = lambda: rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.1 else "user"
    return [(c, None if rng.random() < 0.03 else t, role(), rng.choice([*words, None])) for c in range(n) for t in range(rng.randrange(most))]


@pytest.mark.parametrize("seed,n,most,words,sizes", [
    (1, 70, 9, ["a"], {"segment": 2, "block": 4, "chunk": 3}),
    (2, 60, 7, ["a", "bé🙂"], {"segment": 3, "block": 5, "chunk": 2}),
    (3, 90, 5, ["a", "", "long " * 300], {"segment": 512, "block": 8, "chunk": 4}),
])
def test_trie_of_random_conversations(spark, seed, n, most, words, sizes):
    odd = [(-5, 0, "u", "a"), (-105, 0, "u", "b"), (None, 1, "u", "a"), (0, 0, "user", "a"), (0, 0, "user", "a"), (100, 0, "u", "z" * 100_000)]
    trie_case(spark, random_turns(seed, n, most, words) + odd, **sizes)


def test_trie_of_copies_of_one_and_of_none(spark):
    trie_case(spark, [(c, t, "u", "a") for c in range(200, 240) for t in range(7)], segment=2, block=4, chunk=3)
    one = trie_case(spark, [(0, t, "u", "x" * t) for t in range(40)], segment=4, block=4, chunk=3)
    assert len(one) == 41
    trie_case(spark, [], segment=4, block=4, chunk=3)
    # No shared head is there, and own turns are fewer than are cut off: a conversation without turns.
    bare = next(c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6 > 1 and c % 100)
    got = trie_case(spark, [(bare, 0, "u", "a")], segment=4, block=4, chunk=3)
    assert [(r["depth"], r["n_convs"], r["n_leaves"], r["ends_sha256"]) for r in got] == [(0, 1, 1, sha(str(bare)))]


def test_trie_without_rebuilding(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (2, 1, "u", "c"), (3, 0, "u", "a")]
    got = prefix_trie.prefix_trie(*prefix_trie.as_given(spark.createDataFrame(rows, TURNS))).collect()
    assert sorted((r["depth"], r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in got) == [(0, 1, 3, 1, 2, 2), (1, 1, 3, 2, 2, 2), (2, 1, 1, 0, 1, 0), (2, 2, 1, 0, 1, 0)]


def test_nearest_smaller_values():
    rng = random.Random(5)
    for _ in range(50):
        v = [rng.randrange(5) for _ in range(rng.randrange(30))]
        assert prefix_trie._smaller_before(v) == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(len(v))]


# Merkle manifest.


def plain_manifest(rows, fanout=3):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    spell = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(map(spell, r)))

    def tree(level):
        """The root, and for each leaf its list of (left, right) siblings."""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
            for k, i in enumerate(at):
                run = runs[i // fanout]
                paths[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
                at[k] = i // fanout
            level = [sha("".join(r)) for r in runs]
        return level[0], paths

    sources = collections.defaultdict(list)
    for r in rows:
        sources[r[1]].append(((r[0] is not None, r[0] or 0, leaf(r)), r))
    ordered = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    if not rows:
        return []
    trees = {s: tree([leaf(r) for _, r in sorted(sources[s], key=lambda x: x[0])]) for s in ordered}
    root, above = tree([trees[s][0] for s in ordered])
    out = []
    for k, s in enumerate(ordered):
        for (_, r), path in zip(sorted(sources[s], key=lambda x: x[0]), trees[s][1], strict=True):
            path = path + above[k]
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            fold = leaf((*r[:4], r[4].replace("\n", ""))) if even and r[4] is not None else leaf(r)
            for left, right in path:
                fold = sha(left + fold + right)
            out.append((r[0], leaf(r), trees[s][0], root, sha("".join(a + b for a, b in path)), fold, fold == root))
    return sorted(out, key=str)


def manifest_case(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").withColumn("digest", F.lit("clash")).withColumn("tree", F.lit(1))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.manifest(df.repartition(3), even, F.replace("text", F.lit("\n"), F.lit("")), **sizes).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(rows)
    return got


def test_manifest(spark):
    rng = random.Random(4)
    sources = ["web", "web", "web", "b", "ß", "Z", None, "", "🙂"]
    rows = [(i * 7 - 50, rng.choice(sources), rng.choice(["en", None]), rng.choice([1, None]), rng.choice([None, "", "a\nb", "plain", "\n"])) for i in range(200)]
    rows += [(None, "web", "en", 1, "a\nb"), (3, "alone", None, None, "x" * 300_000 + "\n"), rows[0], rows[0], (rows[0][0], rows[0][1], "de", 2, "other"), (1152921504606846977, "b", "en", 1, "\n")]
    whole = manifest_case(spark, rows)
    assert manifest_case(spark, rows, depth=2) == whole or sorted(map(str, whole)) == sorted(map(str, manifest_case(spark, rows, depth=1)))
    assert {r["verified"] for r in whole} == {True, False}


def test_manifest_of_one_source_one_row_and_none(spark):
    manifest_case(spark, [(i, "s", "en", 1, f"t\n{i}") for i in range(30)], depth=1)
    got = manifest_case(spark, [(1, "s", "en", 1, "t")])
    assert got[0]["leaf"] == got[0]["root"] and got[0]["proof_sha256"] == sha("")
    manifest_case(spark, [])


def test_every_other_change_is_found(spark):
    rows = [(i, "s" if i % 2 else "t", "en", 1, f"text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = merkle.manifest(df, F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).collect()
    assert all(r["verified"] == (r["doc_id"] % 5 != 0) for r in got)


# Chat formatting.


def read(spark, chats):
    return {r["conv_id"]: r for r in chat_format.read_back(chat_format.formatted(chats)).collect()}


ODD = ["", "plain", "\\", "\\\\h", "###", "####", "#####x", "</turn>", "</turn>\n", "</turn", "<", "<</turn>>", "\\e", "\\b\\h\\c", "### user: x</turn>\n### assistant: y", "\\### Assistant: </turn> ok", ": ", "a\nb\r\n", "🙂é", "x" * 50_000]


def test_formatting_is_reversible(spark):
    rng = random.Random(2)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 7)):
            rows.append((c if c else None, rng.choice([t, None]), rng.choice(["user", "assistant", "a: b", ":", "\\c", "###", "</turn>\n", None, ""]), rng.choice([None, *ODD]) if rng.random() < 0.8 else "".join(rng.choices(ODD[:-1], k=4))))
    rows += [(99, t, "assistant" if t % 2 else "user", f"{t}é") for t in range(2500)] + [rows[0], rows[0]]
    df = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("clash"))
    chats = chat_format.chats(df)
    got = read(spark, chats)
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(turns)
    for c, ts in turns.items():
        ts = [x[2:] for x in sorted(ts)]
        loss = "".join(text for role, text in ts if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(ts), sha("".join(f"{r}\n{x}\n" for r, x in ts))), c
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss)), c
    # The marks are marks only: as many as turns.
    for r in chat_format.formatted(chats).collect():
        n = got[r["conv_id"]]["n_turns"]
        assert r["formatted"].count("</turn>") == n and r["formatted"].count("###") == n and len(r["loss_spans"]) == n
        assert len(r["formatted"]) == got[r["conv_id"]]["formatted_chars"]


def test_no_chats_and_chats_without_turns(spark):
    assert read(spark, chat_format.chats(spark.createDataFrame([], TURNS))) == {}
    kind = "id string, messages array<struct<role:string,content:string>>"
    got = read(spark, chat_format.chats(spark.createDataFrame([("a", []), ("b", None), ("c", [(None, None)])], kind)))
    assert [(got[c]["n_turns"], got[c]["formatted_chars"]) for c in "abc"] == [(0, 0), (0, 0), (1, 14)]


def test_layouts_are_found_by_their_fingerprints(spark):
    one = lambda rows, kind: [(t["role"], t["text"]) for t in chat_format.chats(spark.createDataFrame(rows, kind)).first()["turns"]]
    qa = [("user", "q"), ("assistant", "a")]
    assert one([("1", "q", "a")], "id string, prompt string, completion string") == qa
    assert one([("1", "q", "a", "z")], "id string, question string, answer string, lang string") == qa
    assert one([("1", [("human", "q"), ("gpt", "a")])], "id string, conversations array<struct<from:string,value:string>>") == qa
    assert one([("1", "do", "this", "a")], "id string, instruction string, input string, output string") == [("user", "do\n\nthis"), ("assistant", "a")]
    assert one([("1", "do", None, "a")], "id string, instruction string, input string, output string") == [("user", "do"), ("assistant", "a")]
    assert one([("1", "s", "do", None, "a")], "id string, system string, instruction string, input string, output string")[0] == ("system", "s")
    # An extra column that another layout names: the first layout that is all there.
    assert one([(1, 0, "user", "q", "p")], TURNS + ", prompt string") == [("user", "q")]
    with pytest.raises(ValueError, match="no layout"):
        chat_format.chats(spark.createDataFrame([("1", "x")], "id string, body string"))


def test_records_of_several_layouts(spark):
    records = [
        {"id": "m", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"id": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"id": "p", "prompt": "q", "completion": "a"}, {"completion": "a", "prompt": "q", "id": 7},
        {"id": "n", "prompt": "q", "completion": None}, {"id": "i", "instruction": "do", "input": "", "output": "a"},
        {"id": "x", "body": "?"}, {"id": "e", "messages": []},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("no json",), (None,), ("3",)], "record string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.json_chats(df, "record").collect()}
    qa = [("user", "q"), ("assistant", "a")]
    assert got == {"m": qa, "s": qa, "p": qa, "7": qa, "n": [("user", "q")], "i": [("user", "do"), ("assistant", "a")]}
    assert chat_format.unknown_layouts(df, "record").count() == 5
