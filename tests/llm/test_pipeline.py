"""The pipeline against plain versions of its stages, and the queries against their SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import DATA

import corpus_pipeline
from wattspan.llm import language_id, line_quality, packing, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in sorted(DATA.glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got = queries.QUERIES[name](spark, str(DATA)).toPandas()
    want = con.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    frame = lambda x: x[cols].sort_values(cols, ignore_index=True)
    pd.testing.assert_frame_equal(frame(got), frame(want), check_dtype=False)


def plain_chain(emission, transition):
    """Marginals of one chain, item by item."""
    e, step = np.exp(np.asarray(emission, float)), np.exp(np.asarray(transition, float))
    alpha, beta = [e[0] / e[0].sum()], [np.ones(e.shape[1])]
    for x in e[1:]:
        now = (alpha[-1] @ step) * x
        alpha.append(now / now.sum())
    for x in e[:0:-1]:
        back = step @ (x * beta[-1])
        beta.append(back / back.sum())
    out = np.array(alpha) * np.array(beta[::-1])
    return out / out.sum(axis=1, keepdims=True)


def plain_language(text, model):
    names, weights, transition = model
    words = (text or "").lower().split()
    spelled = [any(c.isalpha() for c in w) for w in words]
    if not names or not any(spelled):
        return "und", 0.0
    emission = [weights[language_id.word_features([w])[0]].sum(axis=0) if s else np.zeros(len(names)) for w, s in zip(words, spelled, strict=True)]
    mean = plain_chain(emission, transition)[spelled].mean(axis=0)
    return names[mean.argmax()], mean.max()


def test_language_query_is_its_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language_id.training_rows(docs)
    model = language_id.train([t for t, _ in rows], [x for _, x in rows])
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, str(DATA)).collect()}
    for r in docs.collect():
        lang, score = plain_language(r["text"], model)
        assert got[r["doc_id"]]["lang_pred"] == lang and abs(got[r["doc_id"]]["score"] - score) < 1e-3


def test_line_quality_query_is_its_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    rows, share = line_quality.training_rows(docs, labels)
    model = line_quality.train([t for t, _ in rows], [k for _, k in rows], share)
    got = {r["doc_id"]: r for r in queries.op10_line_quality(spark, str(DATA)).collect()}
    width = line_quality.MEASURES * (line_quality.BINS + 1)
    for r in docs.collect():
        seen, own, weights = set(), [], []
        for line in (r["text"] or "").encode().split(b"\n"):
            m = np.array(line_quality.line_measures(line, line in seen and bool(line)), np.float32)
            own.append([j * (line_quality.BINS + 1) + int((model.cuts[j] <= m[j]).sum()) for j in range(line_quality.MEASURES)])
            weights.append(len(line) + 1)
            seen.add(line)
        edge = [width] * line_quality.MEASURES
        emission = []
        for k, mine in enumerate(own):
            before, after = own[k - 1] if k else edge, own[k + 1] if k + 1 < len(own) else edge
            emission.append(sum(model.tables[b + shift * (width + 1)] for shift, part in enumerate((mine, before, after)) for b in part))
        good = np.clip(np.average(plain_chain(emission, model.transition)[:, 1], weights=weights), 1e-6, 1 - 1e-6)
        score = 1 / (1 + np.exp(-(model.slope * np.log(good / (1 - good)) + model.offset)))
        assert abs(got[r["doc_id"]]["score"] - score) < 1e-3 and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.7)


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    kept = {}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    good = {i for (i,) in con.execute(f"select doc_id from ({queries.OP5_SQL}) where kept").fetchall()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(DATA))
        assert after.columns == docs.columns
        a, b = after.toPandas(), before.toPandas()
        assert set(a.doc_id) <= set(b.doc_id) and a.doc_id.is_unique
        kept[name] = set(a.doc_id)
        if name == "quality_rules":
            assert kept[name] == good
        if name == "language_id":
            rows = language_id.training_rows(before)
            model = language_id.train([t for t, _ in rows], [x for _, x in rows])
            named = {i: plain_language(t, model) for i, t in zip(b.doc_id, b.text, strict=True)}
            assert kept[name] == {i for i, (lang, score) in named.items() if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
        before = spark.createDataFrame(a, docs.schema)
    from test_llm_operators import jaccard_case

    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept["language_id"]]
    want = jaccard_case(spark, rows)
    assert kept["jaccard_join"] == {i for i, c in want.items() if i == c}
    packed = corpus_pipeline.run(spark, str(DATA)).toPandas()
    assert set(packed.doc_id) == kept["jaccard_join"]
    cut = packing.pieces(before, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"), 2048, 0).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pd.testing.assert_frame_equal(packed[key].sort_values(key, ignore_index=True), cut[key].sort_values(key, ignore_index=True))


def test_stages_take_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", None, "s", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(DATA)).count() == 0
        assert stage(spark, odd, str(DATA)).count() == {"quality_rules": 0, "language_id": 0, "jaccard_join": 3, "best_fit_packing": 3}[name]


def test_near_copies_by_row(spark):
    """Rows that repeat an id, copies, null ids, and columns named like the operators' own."""
    base, other, third = ("\n".join(" ".join(f"{k}{i}w{j}" for j in range(12)) for i in range(6)) for k in "abc")
    near = base.replace("a3w3", "changed")
    rows = [(1, base), (1, base), (2, near), (3, other), (1, third), (2, third + " more"), (None, other), (None, "quite another text of a row without an id"), (5, None), (6, None), (7, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", k, "n", "c", 1.5) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, component_id string, score double")
    got = corpus_pipeline.keep_one_of_each_group(spark, frame, str(DATA))
    assert got.columns == frame.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    # The two rows (1, base) are one document; what has no words links with nothing.
    assert kept == sorted([(1, base), (3, other), (1, third), (None, rows[7][1]), (5, None), (6, None), (7, "")], key=str)
    judged = corpus_pipeline.keep_good_text(spark, frame, str(DATA))
    assert judged.columns == frame.columns and {r["n_words"] for r in judged.collect()} == {"n"}
    named = corpus_pipeline.keep_known_language(spark, frame, str(DATA))
    assert named.columns == frame.columns and all(r["score"] == 1.5 for r in named.collect())
