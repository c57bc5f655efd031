"""The registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op2_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import removed_bytes

    return removed_bytes(table(spark, sf_dir, "documents"), length=200, buckets=2)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_items

    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import kd_shards

    placed = kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from . import common, token_files

    path = f"{common.shared_dir(spark)}/emberplane-{uuid.uuid4().hex}/ids"
    token_files.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), "words", end_id=2)
    return token_files.read_ids(spark.read.parquet(path))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "spaced", end_id=0, capacity=1024)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_language

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = identify_language(table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from . import common, warc

    path = f"{common.shared_dir(spark)}/emberplane-{uuid.uuid4().hex}/archives"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    history = warc.capture_history(warc.read_archives(spark, path))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "place")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import conversations

    rows = table(spark, sf_dir, "conversations")
    return conversations.repair_report(conversations.damaged(rows), rows)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k == "pipeline" or k.startswith("op") and k[2].isdigit()}


#: SQL of what DuckDB can express over whole tables; the others are tested against brute force.
EXACT_DEDUP = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS k FROM documents),
 g AS (SELECT doc_id, k, first_value(doc_id) OVER (PARTITION BY k ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM t)
 SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g"""


#: Every pair of sources over every kept term, one by one.
DIVERGENCE = """WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 t AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 vocabulary AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
 counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN vocabulary USING (lang, term) GROUP BY ALL),
 langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM vocabulary GROUP BY ALL),
 sources AS (SELECT DISTINCT lang, source FROM d),
 sizes AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
 p AS MATERIALIZED (SELECT s.lang, s.source, w.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(z.total, 0) + 2 * l.v) AS BIGINT) AS p, CAST(1 + 1000000000::HUGEINT * (w.n + 2) // (l.total + 2 * l.v) AS BIGINT) AS q
  FROM sources s JOIN langs l USING (lang) JOIN vocabulary w USING (lang) LEFT JOIN sizes z ON z.lang = s.lang AND z.source = s.source LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = w.term),
 summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
 parts AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
 ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts)
 SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""

#: Digests and references of the pages, and their order by URL key, time and id.
WARC = """WITH t AS (SELECT page_id, coalesce(html, '') AS payload, coalesce(nullif(url, ''), 'urn:page:' || page_id) AS url FROM pages),
 u AS (SELECT *, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS latest, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^?#]*)([?][^#]*)?', ['host', 'path', 'query']) AS m FROM t),
 v AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(m.host, '^.*@', '')), ':(80|443)$', ''), '^www[0-9]*[.]', '') AS host FROM u),
 w AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || coalesce(nullif(m.path, ''), '/') || CASE WHEN m.query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(m.query[2:], '&')), '&') END AS url_key,
  strftime(TIMESTAMP '2000-01-01' + to_seconds(page_id % 1073741824), '%Y-%m-%dT%H:%M:%SZ') AS captured,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), '') AS payload_digest FROM v)
 SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < latest THEN latest END AS refers_to, url_key, captured,
 row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS place FROM w"""


def repair_sql() -> str:
    """The least (cost, audit, lines) of each state of a conversation, row by row from its start."""
    put = lambda x, letter, cost, line: f"struct_pack(c := {x}.c + {cost}, a := {x}.a || '{letter}', t := list_append({x}.t, {line}))"
    far = "struct_pack(c := 1000000000, a := '', t := CAST([] AS VARCHAR[]))"
    gone = lambda x: f"struct_pack(c := {x}.c + 3, a := {x}.a || 'D', t := {x}.t)"
    kept = lambda x, initial: f"CASE WHEN r.fault < 2 AND r.k = '{initial}' THEN {put(x, 'K', 'r.fault', 'r.role || chr(58) || r.text')} ELSE {far} END"
    moved = lambda x, role: f"CASE WHEN r.fault < 2 THEN {put(x, 'R', '2 + r.fault', f"'{role}:' || r.text")} ELSE {far} END"
    two = ", ".join([gone("d.two"), *(f(x, w) for x in ("d.zero", "d.one", "d.three") for f, w in ((kept, "u"), (moved, "user")))])
    after_two = "least(two, " + ", ".join(put(x, "I", 2, "'user:'") for x in ("zero", "one", "three")) + ")"
    step = f"""SELECT conv_id, i, n, rows, zero, one, two, least(three, {put("two", "I", 2, "'assistant:'")}) AS three FROM (SELECT conv_id, i, n, rows, zero, one, {after_two} AS two, three FROM
  (SELECT d.conv_id, d.i + 1 AS i, d.n, d.rows, {gone("d.zero")} AS zero, least({gone("d.one")}, {kept("d.zero", "s")}) AS one, least({two}) AS two, least({gone("d.three")}, {kept("d.two", "a")}, {moved("d.two", "assistant")}) AS three
  FROM (SELECT *, rows[i + 1] AS r FROM dp WHERE i < n) d))"""
    start = "struct_pack(c := 0, a := '', t := CAST([] AS VARCHAR[]))"
    white = "\\x20\\x09-\\x0D"
    return f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS tab),
 keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
 faulted AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS INT) + 1]), 4294967295)) % 20 AS fault FROM keyed, crc),
 damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM faulted, range(2) copies WHERE fault <> 0 AND (copies.range = 0 OR fault = 3)),
 placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place FROM damaged),
 judged AS (SELECT *, left(role, 1) AS k, CASE WHEN NOT regexp_matches(text, '[^{white}]') THEN 3 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2 WHEN regexp_extract(text, '([^{white}])[{white}]*$', 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair FROM placed),
 convs AS MATERIALIZED (SELECT conv_id, list(struct_pack(role := role, text := text, k := k, fault := fault) ORDER BY place) AS rows, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank,
  count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (place > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
 dp AS (SELECT conv_id, 0 AS i, n, rows, {start} AS zero, {far} AS one, {put(start, "I", 2, "'user:'")} AS two, {put(put(start, "I", 2, "'user:'"), "I", 2, "'assistant:'")} AS three FROM convs UNION ALL {step}),
 best AS (SELECT conv_id, least(zero, three) AS b FROM dp WHERE i = n)
 SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit,
 sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN convs c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op13_conversation_repair": repair_sql(), "op6_exact_dedup": EXACT_DEDUP, "op11_source_divergence": DIVERGENCE, "op12_warc": WARC}
