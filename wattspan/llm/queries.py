"""The queries of this subpackage and their SQL: one thin query an operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.llm import bit_planes, byte_bpe, chat_format, jaccard_join, language_id, licenses, line_quality, merkle, packing, pivot_index, prefix_trie, quality_rules, warc
from wattspan.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_pages(table(spark, sf_dir, "pages"), min_bytes=1000)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND best <> page_id THEN best END AS refers_to
FROM m
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_token_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_planes.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = byte_bpe.BytePairCoder(byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return byte_bpe.digest(coder.encode(table(spark, sf_dir, "documents")), coder)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), starts AS (
  SELECT rn, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) > 8
), windows AS (
  SELECT rn, p, count(*) OVER (PARTITION BY rn, array_to_string(list_slice(w, p, p + 7), ' ')) AS c FROM starts
), gaps AS (
  SELECT rn, least(8, coalesce(lead(p) OVER (PARTITION BY rn ORDER BY p) - p, 8)) AS g FROM windows WHERE c > 1
), repeats AS (
  SELECT rn, CAST(sum(g) AS BIGINT) AS n FROM gaps GROUP BY rn
), m AS (
  SELECT doc_id, t, w, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM d LEFT JOIN repeats USING (rn)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > 3 * n_words
            OR (len(lines) >= 4 AND 100 * n_dup_lines > 30 * len(lines))
            OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 60 * n_words
            OR length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(t, '[^\p{Ll}]+', '', 'g'))
            OR (n_words >= 50 AND 100 * len(list_distinct(w)) < 10 * least(n_words, 1000))
            OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '(!!|\?\?)$'))) > 50 * n_words) AS kept
FROM b
"""


def op7_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(table(spark, sf_dir, "documents"))


def _op7_sql() -> str:
    """Sentences by steps that this engine has: without look-around, so ends are doubled and taken with the sentences."""
    pairs = lambda table: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"
    anchors = " OR ".join(f"contains(t, '{a}')" for a in licenses.ANCHORS)
    gap = r"(?: |\n\n)"
    pattern = rf"(?:\n(?:{licenses.known(gap)})| (?:{licenses.known(gap, licenses.LONG_SENTENCE)}))\n"
    singles = {i: name for name, i in licenses.SINGLE}
    steps, last = [], "seqs"
    for i, (name, ids) in enumerate(licenses.RULES):
        sought = " " + "  ".join(ids) + " "
        steps.append(f"r{i} AS (SELECT rn, doc_id, n, replace(rest, '{sought}', '|') AS rest, CASE WHEN contains(rest, '{sought}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})")
        last = f"r{i}"
    names = f"({licenses._NAME})"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, lower(coalesce(text, '')) AS t FROM documents
), held AS (
  SELECT rn, t, regexp_replace(replace(regexp_replace(t, '{licenses.TAG}', E'.\n', 'g'), '|', '-'), '[.;:!?]([\x20\x09-\x0D]|$)', '|\1', 'g') AS c FROM d WHERE {anchors}
), lines AS (
  SELECT rn, t, trim(regexp_replace(regexp_replace(regexp_replace(c, '(^|[|\n])([^a-z0-9|\n]*)\(?(?:[0-9]{{1,2}}|[a-z])\) ', '\1\2', 'g'), '[^a-z0-9|\n]+', ' ', 'g'), ' ?([|\n]) ?', '\1', 'g')) AS l FROM held
), norm AS (
  SELECT rn, t, regexp_replace(l, '\n*\|[|\n]*|\n\n+', '|', 'g') AS s FROM lines
), hits AS (
  SELECT rn, t, list_transform(regexp_extract_all(chr(10) || replace(replace(s, chr(10), chr(10) || chr(10)), '|', chr(10) || '|' || chr(10)) || chr(10), '{pattern}', 0), lambda x: replace(trim(x, ' ' || chr(10)), chr(10) || chr(10), ' ')) AS h FROM norm
), ids AS (
  SELECT rn, list_concat(
    list_transform(h, lambda x: CASE WHEN {pairs(licenses.SENTENCE_IDS)}[x] IS NOT NULL THEN [{pairs(licenses.SENTENCE_IDS)}[x]] ELSE list_transform(regexp_extract_all(x, '{names}', 1), lambda n: 'spdx:' || {pairs(licenses.SPELLED)}[n]) END),
    list_transform(regexp_extract_all(t, '{licenses.TAG}', 1), lambda e: list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace(e, '[()]', '', 'g'), '[ \t]+with[ \t]+[^ \t]+', '', 'g'), '\.$', ''), '[ \t]+(?:and|or)[ \t]+'), lambda p: 'spdx:' || coalesce({pairs(licenses.TAGS)}[p], '?')))) AS ids
  FROM hits
), seqs AS (
  SELECT rn, doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n, ' ' || coalesce(array_to_string(list_transform(flatten(ids), lambda x: x || ' '), ' '), '') AS rest, CAST([] AS VARCHAR[]) AS found
  FROM d LEFT JOIN ids USING (rn)
), {", ".join(steps)}
SELECT doc_id, n AS n_license_sentences,
       array_to_string(list_sort(list_distinct(list_concat(found, list_filter(list_transform(left_over, lambda x: {pairs(singles)}[x]), lambda x: x IS NOT NULL)))), ',') AS licenses,
       CAST(len(list_filter(left_over, lambda x: {pairs(singles)}[x] IS NULL)) AS BIGINT) AS unknown_sentences
FROM (SELECT *, list_filter(string_split_regex(rest, '[ |]+'), lambda x: x <> '') AS left_over FROM {last})
"""


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), percent=75, words=5).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM w UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: crc32 of the text of an id: bytes are taken in, each followed by eight shifts.
_CRC32 = """(SELECT id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(id AS VARCHAR), ''),
  lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS crc FROM (SELECT DISTINCT {id} AS id FROM {table}))"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(table(spark, sf_dir, "conversations"), group=100, heads=6))


OP11_SQL = f"""
WITH crc AS {_CRC32.format(id="conv_id", table="conversations")}, t AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list(token ORDER BY turn NULLS FIRST, token) AS s FROM t GROUP BY conv_id
), c AS (
  SELECT o.conv_id, list_concat(coalesce(base.s[1:crc % 6], []), o.s[crc % 6 + 1:]) AS s
  FROM o JOIN crc ON crc.id = o.conv_id LEFT JOIN o AS base ON base.conv_id = o.conv_id - o.conv_id % 100
), n AS (
  SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM c
), p AS (
  SELECT d, s[1:d] AS k, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = d), '') AS ends
  FROM n GROUP BY d, s[1:d]
), kids AS (
  SELECT k[1:d - 1] AS k, count(*) AS n_children FROM p WHERE d > 0 GROUP BY k[1:d - 1]
), turns AS (
  SELECT DISTINCT token, chars FROM t
), own AS (
  SELECT p.*, coalesce(n_children, 0) AS n_children, coalesce((n_convs - 1) * chars, 0) AS w
  FROM p LEFT JOIN kids USING (k) LEFT JOIN turns ON d > 0 AND token = p.k[d]
), sub AS (
  SELECT k[1:a] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(w) AS saved
  FROM (SELECT k, n_children, w, unnest(range(0, d + 1)) AS a FROM own) GROUP BY k[1:a]
)
SELECT own.conv_id, own.d AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(own.ends) AS ends_sha256
FROM own JOIN sub USING (k) LEFT JOIN p AS up ON own.d > 0 AND up.k = own.k[1:own.d - 1]
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), even, F.replace("text", F.lit("\n"), F.lit("")))


def _op12_sql() -> str:
    field = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    return f"""
WITH RECURSIVE crc AS {_CRC32.format(id="doc_id", table="documents")}, l AS (
  SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN crc % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS other
  FROM documents LEFT JOIN crc ON crc.id = doc_id
), p AS (
  SELECT *, row_number() OVER () AS rn, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM l
), up AS (
  SELECT tree, 0 AS level, pos AS i, n, leaf AS d FROM p
  UNION ALL
  SELECT tree, level + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY tree, level, i // 3
), sub AS (
  SELECT tree, max_by(d, level) FILTER (n = 1) AS subroot, max(level) AS height FROM up GROUP BY tree
), over AS (
  SELECT 0 AS level, tree AS i, (SELECT count(*) FROM sub) AS n, subroot AS d FROM sub
  UNION ALL
  SELECT level + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(d, '' ORDER BY i)) FROM over WHERE n > 1 GROUP BY level, i // 3
), top AS (
  SELECT max_by(d, level) AS root, max(level) AS height FROM over
), steps AS (
  SELECT rn, level AS k, pos // CAST(pow(3, level) AS BIGINT) AS i, p.tree, false AS above FROM p JOIN sub USING (tree), LATERAL (SELECT unnest(range(height)) AS level)
  UNION ALL
  SELECT rn, sub.height + level, p.tree // CAST(pow(3, level) AS BIGINT), p.tree, true FROM p JOIN sub USING (tree), top, LATERAL (SELECT unnest(range(top.height)) AS level)
), sib AS (
  SELECT rn, k, coalesce(string_agg(up.d, '' ORDER BY up.i) FILTER (up.i < steps.i), '') AS l, coalesce(string_agg(up.d, '' ORDER BY up.i) FILTER (up.i > steps.i), '') AS r
  FROM steps JOIN up ON NOT above AND up.tree = steps.tree AND up.level = k AND up.i // 3 = steps.i // 3 GROUP BY rn, k
  UNION ALL
  SELECT rn, k, coalesce(string_agg(over.d, '' ORDER BY over.i) FILTER (over.i < steps.i), ''), coalesce(string_agg(over.d, '' ORDER BY over.i) FILTER (over.i > steps.i), '')
  FROM steps JOIN sub USING (tree) JOIN over ON above AND over.level = k - sub.height AND over.i // 3 = steps.i // 3 GROUP BY rn, k
), paths AS (
  SELECT rn, string_agg(l || r, '' ORDER BY k) AS proof FROM sib GROUP BY rn
), fold AS (
  SELECT rn, 0 AS k, coalesce(other, leaf) AS d FROM p
  UNION ALL
  SELECT fold.rn, fold.k + 1, sha256(l || d || r) FROM fold JOIN sib ON sib.rn = fold.rn AND sib.k = fold.k
), folded AS (
  SELECT rn, max_by(d, k) AS folded_root FROM fold GROUP BY rn
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN sub USING (tree) JOIN folded USING (rn) LEFT JOIN paths USING (rn), top
"""


#: The text of both turns of the added conversation.
MARKED = r"\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-7, [("user", MARKED), ("assistant", MARKED)])], "conv_id bigint, messages array<struct<role:string,content:string>>")
    turns = chat_format.chats(table(spark, sf_dir, "conversations")).unionByName(chat_format.chats(added))
    return chat_format.read_back(chat_format.formatted(turns))


OP13_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{MARKED}' UNION ALL SELECT -7, 1, 'assistant', '{MARKED}'
), m AS (
  SELECT *, (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, ':', ''))) + len(list_filter(range(1, length(role) + 1), lambda i: substr(role, i, 3) = '###')) + (length(role) - length(replace(role, '</turn>', ''))) // 7 AS in_role,
         (length(text) - length(replace(text, '\', ''))) + len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = '###')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS in_text
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(text) + in_role + in_text + 14) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_pivot_index": op4_pivot_index,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_bit_planes": op6_token_bit_planes,
    "op7_license_sentences": op7_license_sentences,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_line_quality": op10_line_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_chat_format": op13_chat_format,
}

ORACLE_SQL: dict[str, str] = {"op1_warc_revisits": OP1_SQL, "op5_quality_rules": OP5_SQL, "op9_jaccard_join": OP9_SQL, "op7_license_sentences": _op7_sql(), "op11_prefix_trie": OP11_SQL, "op12_merkle_manifest": _op12_sql(), "op13_chat_format": OP13_SQL}
