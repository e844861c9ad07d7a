"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Iterable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, chat, decontam, exact_dedup, license_scan, quality, sharding, simhash, token_count, warc
from orrery.session import spread, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(spread(table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(spread(table(spark, sf_dir, "documents")), path, public_tokenizers.PATTERN, with_ids=False)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = chat.canonical(table(spark, sf_dir, "conversations")).unionByName(chat.canonical(more))
    return chat.chat_digests(chat.format_chats(turns))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_simhash, op3_byte_bpe, op4_warc, op5_chat_format, op6_token_count, op7_quality, op8_sharding, op9_exact_dedup, op10_decontamination)}

_LOWER = f"'{decontam.UPPER}', '{decontam.LOWER}'"


def _list(words: Iterable[bytes]) -> str:
    return "[" + ", ".join(f"'{w.decode()}'" for w in sorted(words)) + "]::VARCHAR[]"


def _template(name: str, text: str) -> str:
    numbers, versions, family = license_scan.decisive(license_scan.words_of(text))
    return f"('{name}', '{text.replace(chr(39), chr(39) * 2)}', {_list(numbers)}, {_list(versions)}, {_list(family)})"


_TEMPLATES = ", ".join(_template(name, text) for name, texts in license_scan.TEMPLATES.items() for text in texts)
_FAMILY = _list(w.encode() for w in license_scan.FAMILY)

ORACLES = {
    "op1_license_scan": rf"""
WITH big AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '{license_scan.PARAGRAPH}')) FROM documents
), seg AS (
  SELECT DISTINCT doc_id, s FROM (
    FROM big UNION ALL SELECT doc_id, unnest(regexp_split_to_array(s, '{license_scan.SENTENCE}')) FROM big
    UNION ALL SELECT doc_id, text FROM documents)
  WHERE s <> ''
), num AS (SELECT row_number() OVER () AS sid, doc_id, regexp_extract_all(translate(s, {_LOWER}), '[a-z0-9]+') AS w FROM seg),
tpl AS (SELECT row_number() OVER () AS tid, name, numbers, versions, family, regexp_extract_all(translate(t, {_LOWER}), '[a-z0-9]+') AS w FROM (VALUES {_TEMPLATES}) AS v(name, t, numbers, versions, family)),
sb AS (SELECT sid, w[i] || ' ' || w[i + 1] AS g, count(*) AS n FROM (SELECT sid, w, unnest(range(1, len(w))) AS i FROM num) GROUP BY ALL),
tb AS (SELECT tid, w[i] || ' ' || w[i + 1] AS g, count(*) AS n FROM (SELECT tid, w, unnest(range(1, len(w))) AS i FROM tpl) GROUP BY ALL),
hit AS (SELECT sid, tid, sum(least(sb.n, tb.n)) AS common FROM sb JOIN tb USING (g) GROUP BY ALL),
sc AS (SELECT doc_id, name, common, 2 * common::DOUBLE / (len(num.w) + len(tpl.w) - 2) AS score FROM hit JOIN num USING (sid) JOIN tpl USING (tid)
  WHERE list_has_all(num.w, numbers) AND list_sort(list_distinct(list_filter(num.w, lambda x: list_contains({_FAMILY}, x)))) = family
  AND (versions = [] OR versions = list_sort(list_distinct(list_transform(regexp_extract_all(' ' || array_to_string(num.w, ' ') || ' ', '{license_scan.VERSION}', 1), lambda x: regexp_replace(x, ' 0$', '')))))),
good AS (SELECT doc_id, name, max(common) AS common, arg_max(score, (common, score)) AS score FROM sc WHERE score >= {license_scan.THRESHOLD} GROUP BY doc_id, name),
best AS (SELECT doc_id, arg_min(name, (-common, -score, name)) AS license_id, round(arg_min(score, (-common, -score, name)), 9) AS score, count(*) AS n_licenses, string_agg(name, ',' ORDER BY name) AS licenses FROM good GROUP BY doc_id)
SELECT d.doc_id, license_id, score, coalesce(n_licenses, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses FROM documents d LEFT JOIN best USING (doc_id)
""",
    "op5_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS erole,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS etext FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('<|turn|>') + length(replace(erole, chr(10), '&#10;')) + 1 + length(etext) + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
""",
    "op10_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, s, array_to_string(w[i : i + s - 1], ' ') AS g FROM (SELECT item_id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM bs)),
sizes AS (SELECT DISTINCT s FROM bs),
dw AS (SELECT doc_id, s, i, array_to_string(w[i : i + s - 1], ' ') AS g FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, sizes)),
m AS (SELECT dw.doc_id, dw.s, dw.i, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + s)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
tok AS (SELECT doc_id, w[p] AS term, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
cnt AS (SELECT term, count(*) AS n FROM tok GROUP BY term),
cell AS (SELECT item_id, s, i, k, w[i + k] AS term FROM (SELECT item_id, w, s, i, unnest(range(0, s)) AS k FROM (SELECT item_id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM bs))),
rare AS (SELECT item_id, s, list(cell.term ORDER BY n, k) AS ts FROM cell JOIN cnt USING (term) GROUP BY item_id, s, i HAVING count(*) = s),
pair AS (SELECT DISTINCT item_id, ts[1] AS a, CASE WHEN s = 1 THEN '' ELSE ts[2] END AS b FROM rare),
close AS (SELECT x.doc_id, pair.item_id FROM pair JOIN tok x ON x.term = a JOIN tok y ON y.doc_id = x.doc_id AND y.term = b WHERE x.p <> y.p AND abs(x.p - y.p) <= {decontam.SLOP}
  UNION SELECT x.doc_id, pair.item_id FROM pair JOIN tok x ON x.term = a WHERE b = ''),
c AS (SELECT doc_id, count(*) AS n_near FROM close GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
""",
}
