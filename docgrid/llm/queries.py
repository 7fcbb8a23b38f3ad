"""The registered queries of the thirteen operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, html_extract, language, media, mixing, prefix_trie, quality, sharding, simhash, substring, token_count
from .common import held_out, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back from the formatted text."""
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(rows))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by trees that never saw the held-out labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return quality.score(docs, forest).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    out = mixing.with_copies(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's audio column and fingerprint arrays."""
    return media.media_digest(media.media_columns(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the items: one row per pair, none for clean documents."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document by a kernel model that never saw the held-out rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, ~held_out(F.col("doc_id")))
    out = language.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the 32k piece model."""
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language diverge, pair by pair, and the terms that set each apart."""
    return divergence.diverge(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words under windows of 35 words that start elsewhere as well."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_chat_format, op2_quality, op3_kd_sharding, op4_mixing, op5_media, op6_simhash, op7_decontaminate, op8_language, op9_token_count, op10_html_extract,
            op11_divergence, op12_substring_dedup, op13_prefix_trie,
        )
    }


#: How many characters the escapes add to a text: one for each backslash, "<|" and "|>".
_ADDED = """(length({0}) - length(replace({0}, '\\', '')) + (length({0}) - length(replace({0}, '<|', ''))) // 2
  + (length({0}) - length(replace({0}, '|>', ''))) // 2)"""

_OP1 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(role) + length(text) + {_ADDED.format("role")} + {_ADDED.format("text")} + {len(chat.OPEN + chat.MIDDLE + chat.CLOSE)}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

_OP4 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS id FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM s),
r AS (SELECT *, source_size * 2 AS cap, CAST(source_size * 2 AS DOUBLE) / weight AS ratio FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY ratio, source NULLS LAST) AS pos FROM r),
f AS (SELECT level FROM l WHERE level <= ratio ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM f) * weight) AS target,
    CAST('0x' || substr(md5('mix' || coalesce('|' || source, '')), 1, 6) AS BIGINT) AS u0 FROM l),
p AS (
  SELECT doc_id, d.source, d.size, t.source_size, t.target, u0,
    CAST(CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216::DOUBLE) ELSE 0 END AS BIGINT) AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (u0 + k * 524288) % 16777216 AS u FROM p, range(32) x(k)),
m AS (SELECT source, k, u, abs(sum(size * (((place * rate + u) >> 24) - (((place - 1) * rate + u) >> 24))) - target) AS miss, target FROM k GROUP BY source, k, u, target),
b AS (SELECT source, u FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss > target * 0.001::DOUBLE, CASE WHEN miss > target * 0.001::DOUBLE THEN miss ELSE 0 END, k) = 1),
c AS (SELECT p.*, ((place * rate + u) >> 24) - (((place - 1) * rate + u) >> 24) AS copies FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP7 = f"""
WITH i AS (SELECT DISTINCT item_id, {_WORDS} AS iw FROM benchmark),
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS dw FROM documents),
iw AS (SELECT row_number() OVER () AS ik, item_id, iw, len(iw) AS n, least(len(iw), 20) AS width FROM i WHERE len(iw) >= 5),
ip AS (SELECT ik, unnest(iw) AS w, unnest(range(len(iw))) AS ipos FROM iw),
dp AS (SELECT k, len(dw) AS dn, unnest(dw) AS w, unnest(range(len(dw))) AS dpos FROM d),
m AS (SELECT k, dn, ik, dpos - ipos AS diag, list(ipos) AS hit FROM dp JOIN ip USING (w) GROUP BY ALL HAVING count(*) >= 5),
c AS (
  SELECT *, CASE WHEN width < 10 THEN width ELSE CAST(ceil(width * 0.8::DOUBLE) AS BIGINT) END AS need,
    greatest(0, -diag) AS low, least(n, dn - diag) AS high FROM m JOIN iw USING (ik)),
v AS (
  SELECT k, item_id, n, diag, len(hit) AS matched FROM c
  WHERE len(hit) >= need AND high - low >= width
    AND list_max([len(list_filter(hit, lambda p: p >= s AND p < s + width)) FOR s IN range(low, high - width + 1)]) >= need)
SELECT doc_id, item_id, CAST(matched AS BIGINT) AS matched_words, CAST(n AS BIGINT) AS item_words, CAST(diag AS BIGINT) AS doc_word
FROM v JOIN d USING (k)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, diag, n) = 1
"""


_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM t GROUP BY ALL),
keep AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(term) AS v, CAST(coalesce(sum(n), 0) AS HUGEINT) AS n FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN keep USING (lang) GROUP BY g.lang),
s AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS n FROM g LEFT JOIN (SELECT c.* FROM c SEMI JOIN keep USING (lang, term)) c USING (lang, source) GROUP BY ALL),
q AS (SELECT keep.lang, term, 1 + (1000000000::HUGEINT * (keep.n + 5)) // (v.n + 5 * v) AS q FROM keep JOIN v USING (lang)),
p AS (
  SELECT s.lang, s.source, keep.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * v) AS p
  FROM s JOIN v USING (lang) JOIN keep USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = keep.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e QUALIFY part = 'pair' OR rank <= 50
"""

_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS words FROM documents),
p AS (SELECT k, words, unnest(range(1, len(words) - 33)) AS s FROM d WHERE len(words) >= 35),
w AS (SELECT k, s, md5(array_to_string(words[s:s + 34], ' ')) AS seq FROM p),
g AS (SELECT k, s FROM w JOIN (SELECT seq FROM w GROUP BY seq HAVING count(*) > 1) USING (seq)),
c AS (SELECT DISTINCT k, s + o AS place FROM g, range(35) r(o)),
r AS (SELECT d.k, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d),
t AS (SELECT k, string_agg(word, ' ' ORDER BY place) AS kept FROM r ANTI JOIN c USING (k, place) GROUP BY k),
n AS (SELECT k, count(*) AS n FROM c GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (k) LEFT JOIN n USING (k)
"""

_OP13 = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS turns FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, conv_id - conv_id % 5 AS base, CAST(xor(4294967295, list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(crc, byte)), 4294967295::BIGINT)) % 9 AS BIGINT) AS h FROM l),
r AS (SELECT h.conv_id, coalesce(b.turns, [])[1:h] || h.turns[h + 1:] AS turns FROM h LEFT JOIN l b ON b.conv_id = h.base),
p AS (SELECT conv_id, len(turns) AS n, d AS depth, md5(CAST(turns[1:d] AS VARCHAR)) AS node, md5(CAST(turns[1:d - 1] AS VARCHAR)) AS above,
    CASE WHEN d > 0 THEN strlen(turns[d].text) ELSE 0 END AS bytes FROM r, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)),
n AS (
  SELECT depth, node, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS last_bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM p GROUP BY depth, node),
k AS (SELECT n.*, u.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children FROM n
  LEFT JOIN n u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.node = n.above
  LEFT JOIN (SELECT depth - 1 AS depth, above, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL) c ON c.depth = n.depth AND c.above = n.node),
s AS (
  SELECT p.depth, p.node, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((k.n_convs - 1) * k.last_bytes) AS saved_tokens
  FROM k JOIN p ON p.conv_id = k.conv_id AND p.depth <= k.depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256, last_bytes
FROM k JOIN s USING (depth, node)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_divergence": _OP11, "op12_substring_dedup": _OP12, "op13_prefix_trie": _OP13, "op1_chat_format": _OP1, "op4_mixing": _OP4, "op7_decontaminate": _OP7}
