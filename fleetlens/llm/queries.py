"""The operators bound to the fixture tables, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    chat, covertree, decontam, langid, licenses, periodic, pii, repeats, simhash, spm, tokens, trie, urls,
)
from fleetlens.llm.common import materialize, table

TOKENIZERS = {"pieces": "piece_bpe_32k.model", "ranks": "byte_bpe_50k.tiktoken", "eod": 50256}


def tokenizer_path(name: str) -> str:
    """A public vocabulary file's place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("select cast(-7 as bigint) conv_id, cast(n as bigint) turn, role, '</s>[INST] ok [/INST]' text "
                      "from values (0, 'user'), (1, 'assistant') as t(n, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_turns(rows))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    files = materialize(tokens.pack_documents(docs, tokenizer_path(TOKENIZERS["ranks"]), public_tokenizers.PATTERN,
                                              TOKENIZERS["eod"]), "token-files")
    return (tokens.token_counts(files, TOKENIZERS["eod"])
            .select(F.col("name").alias("doc_id"), "file", "ordinal", "start", "n_tokens"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZERS["pieces"]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    models = langid.fit(docs.where(~held))
    return (langid.identify(docs, models)
            .select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def file_tree(docs: DataFrame) -> DataFrame:
    """``documents`` as files of a derived tree: folders of 64 ids with folders of 8 in them. A document that speaks of
    a license is a LICENSE file, of its inner folder if its id is even, else of the outer one."""
    d = F.col("doc_id")
    outer, inner = F.shiftright(d, 6), F.pmod(F.shiftright(d, 3), F.lit(8))
    speaks = F.col("text").rlike("(?i)licen[sc]e")
    return docs.select("doc_id", "text", F.when(
        speaks & (d % 2 != 0), F.concat_ws("/", F.lit("files"), outer, F.lit("LICENSE"))).when(
        speaks, F.concat_ws("/", F.lit("files"), outer, inner, F.lit("LICENSE"))).otherwise(
        F.concat_ws("/", F.lit("files"), outer, inner, F.concat(d.cast("string"), F.lit(".txt")))).alias("path"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(file_tree(table(spark, sf_dir, "documents")))


# The rules that op10 applies.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (urls.judge_urls(table(spark, sf_dir, "pages"), RULES)
            .select("page_id", "host", "path", "rule", "verdict"))


def looped_tail(doc_id, words: list[bytes]) -> list[bytes]:
    """The words of op11's fixture: where the hash of the id is a multiple of ten, a tail repeats one stretch."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a:a + p]
    return words[:a] + (loop * ((n - a) // p + 1))[:n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=looped_tail)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                               r["period"].cast("string")), F.lit("\n")))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(base).cast("binary"), 256).alias("base_sha256"),
                        pii.span_list(F.col("spans")).alias("spans"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """op13's conversations: the first h turns of the conversation c - c % 20, then c's own after its first h.

    Takes (conv, ordinal, turn_key, words); returns the rebuilt turns (with depth from 1) and (conv, n_turns). A
    conversation lends at most three turns, to twenty conversations at most.
    """
    sizes = materialize(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")), "conversation-sizes")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    first = turns.where("ordinal < 3").groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "turn_key", "words"))).alias("lent"))
    convs = sizes.select("conv", "own", h.cast("int").alias("h"), (F.col("conv") - F.col("conv") % 20).alias("base"))
    convs = convs.join(first, "base", "left").select("conv", "own", "h", F.slice(F.coalesce(
        "lent", F.array().cast(first.schema["lent"].dataType)), F.lit(1), F.col("h")).alias("lent"))
    convs = materialize(convs.withColumn("n_lent", F.size("lent").cast("long")), "conversation-heads")
    lent = convs.select("conv", F.posexplode("lent").alias("at", "t")).select(
        "conv", (F.col("at") + 1).cast("long").alias("depth"), "t.turn_key", "t.words")
    # conv is unique on one side; written first, so that a conversation with many turns can be split by the planner
    own = turns.join(convs.select("conv", "h", "n_lent"), "conv").where("ordinal >= h").select(
        "conv", (F.col("ordinal") - F.col("h") + F.col("n_lent") + 1).alias("depth"), "turn_key", "words")
    lengths = convs.select("conv", (F.col("n_lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"))
    return lent.unionByName(own), materialize(lengths, "conversation-lengths")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*rebuilt(trie.ordered_turns(table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_chat_formatting, op2_token_counts, op3_suffix_array_dedup, op4_simhash_near_dedup, op5_sentencepiece,
        op6_language_id, op7_exact_top_k, op8_decontamination, op9_license_scan, op10_url_filters,
        op11_periodic_runs, op12_pii, op13_prefix_trie, pipeline)}


SQL_OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|\[/?ROLE\]|\[/END\]')) AS extra,
         len(regexp_extract_all(role, '\\|</?s>|\[/?INST\]|\[/?ROLE\]|\[/END\]')) AS role_extra
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(length(text) + extra + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6
                    ELSE 23 + length(role) + role_extra END) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS n_rewrites
FROM marked GROUP BY conv_id
"""

SQL_OP7 = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

SQL_OP10 = r"""
WITH RECURSIVE rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), page AS (
  SELECT page_id, url, coalesce(html, '') AS html,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), tag AS (
  SELECT url, lower(regexp_extract(t, '^<([A-Za-z]+)', 1)) AS kind, ' ' || t AS t
  FROM (SELECT url, unnest(regexp_extract_all(html, '<(?:link|meta)\b[^>]*>', 0, 'is')) AS t FROM page WHERE contains(url, '://'))
), attr AS (
  SELECT url, kind, lower(regexp_extract(a, '^\s([A-Za-z-]+)', 1)) AS name,
         regexp_replace(regexp_replace(a, '^\s[A-Za-z-]+\s*=\s*', '', 's'), '^(?:"(.*)"|''(.*)'')$', '\1\2', 's') AS v, n
  FROM (SELECT url, kind, unnest(regexp_extract_all(t, '\s[A-Za-z-]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)', 0, 'is')) AS a, n
        FROM (SELECT *, row_number() OVER () AS n FROM tag))
), plain AS (
  SELECT url, kind, name, n, trim(replace(replace(replace(replace(replace(list_aggregate(list_transform(string_split(v, '&#'), lambda p, i:
    CASE WHEN i = 1 THEN p
         WHEN regexp_matches(p, '^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]);') THEN
           chr(CAST(regexp_extract(p, '^([0-9]+);', 1) AS INTEGER)) || regexp_extract(p, '^[0-9]+;(.*)$', 1, 's')
         WHEN regexp_matches(p, '^[xX][0-9a-fA-F]{1,2};') THEN
           chr(CAST('0x' || regexp_extract(p, '^[xX]([0-9a-fA-F]+);', 1) AS INTEGER)) || regexp_extract(p, '^[xX][0-9a-fA-F]+;(.*)$', 1, 's')
         ELSE '&#' || p END), 'string_agg', ''),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), ' ') AS v
  FROM attr
), raw AS (
  SELECT url, trim(v, ' ') AS target FROM plain WHERE name = 'href' AND n IN (
    SELECT n FROM plain WHERE kind = 'link' AND name = 'rel' AND list_contains(regexp_split_to_array(lower(v), '\s+'), 'canonical'))
  UNION ALL
  SELECT url, trim(regexp_replace(regexp_extract(v, '^\s*[0-9.]*\s*[;,\s]\s*(?:url\s*=\s*)?(.*)$', 1, 'is'),
                                  '^(?:"([^"]*)".*|''([^'']*)''.*)$', '\1\2', 's'), ' ')
  FROM plain WHERE name = 'content' AND n IN (SELECT n FROM plain WHERE kind = 'meta' AND name = 'http-equiv' AND lower(v) = 'refresh')
), ends AS (
  SELECT url AS a, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN regexp_extract(url, '^(.*?:)//', 1, 's') || target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || target
    WHEN starts_with(target, '?') THEN regexp_extract(url, '^(.*?://[^?#]*)', 1, 's') || target
    WHEN starts_with(target, '#') OR regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE rtrim(regexp_extract(url, '^(.*?://[^/?#]*(?:[^?#]*/)?)', 1, 's'), '/') || '/' || target END AS b
  FROM raw WHERE target <> ''
), named AS (
  SELECT u, regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         regexp_extract(u, '^(.*?://)', 1, 's') || translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS head,
         regexp_extract(u, '^.*?://[^?#]*(\?[^#]*)', 1, 's') AS query
  FROM (SELECT url AS u FROM page WHERE contains(url, '://') UNION SELECT a FROM ends UNION SELECT b FROM ends)
), node(url, n) AS (
  SELECT u, head || CASE WHEN path = '' THEN '/' ELSE coalesce(list_reduce(list_prepend('', string_split(substr(path, 2), '/')), lambda done, s:
      CASE s WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN '.' THEN done ELSE done || '/' || s END), '')
    || CASE WHEN regexp_matches(path, '/\.\.?$') THEN '/' ELSE '' END END || query
  FROM named
), edge AS (
  SELECT x.n AS a, y.n AS b FROM ends e JOIN node x ON x.url = e.a JOIN node y ON y.url = e.b
  UNION SELECT y.n, x.n FROM ends e JOIN node x ON x.url = e.a JOIN node y ON y.url = e.b
), reach(a, b) AS (
  SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b
), judged AS (
  SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT host, path FROM page
        UNION SELECT regexp_extract(n, '^.*?://([^/?#]*)', 1, 's'), regexp_extract(n, '^.*?://[^/?#]*([^?#]*)', 1, 's') FROM node WHERE n IS NOT NULL) u
  JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.host, u.path
), blocked AS (
  SELECT DISTINCT r.a AS n FROM reach r JOIN judged j
    ON j.host = regexp_extract(r.b, '^.*?://([^/?#]*)', 1, 's') AND j.path = regexp_extract(r.b, '^.*?://[^/?#]*([^?#]*)', 1, 's')
  WHERE j.verdict = 'block'
)
SELECT p.page_id, p.host, p.path, j.rule,
       coalesce(j.verdict, CASE WHEN b.n IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM page p LEFT JOIN judged j ON p.host = j.host AND p.path = j.path
LEFT JOIN node d ON d.url = p.url LEFT JOIN blocked b ON b.n = d.n
"""


SQL_OP13 = r"""
WITH RECURSIVE src AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS o
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, count(*) AS own, c - c % 20 AS base, xor(4294967295, list_reduce(
    [4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(CAST(c AS VARCHAR), '')],
    lambda r, v: list_reduce([xor(r, v)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
                             lambda a, z: xor(a >> 1, 3988292384::BIGINT * (a & 1))))) % 4 AS h
  FROM src GROUP BY c
), rebuilt AS (
  SELECT k.c, 0 AS part, s.o, s.role, s.text FROM convs k JOIN src s ON s.c = k.base AND s.o < k.h
  UNION ALL SELECT k.c, 1, s.o, s.role, s.text FROM convs k JOIN src s ON s.c = k.c AND s.o >= k.h
), placed AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, o) AS d,
         sha256(length(role) || ':' || role || text) AS t,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt
), member AS (
  SELECT c, d, words, string_agg(t, '') OVER (PARTITION BY c ORDER BY d) AS p FROM placed
  UNION ALL SELECT c, 0, 0, '' FROM convs
), long AS (SELECT c, max(d) AS n FROM member GROUP BY c
), node AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM member GROUP BY d, p
), linked AS (
  SELECT n.*, u.conv_id AS parent_conv_id FROM node n
  LEFT JOIN node u ON u.d = n.d - 1 AND u.p = left(n.p, 64 * (n.d - 1)::BIGINT)
), kids AS (SELECT d - 1 AS d, parent_conv_id AS conv_id, count(*) AS n FROM linked WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT m.d, m.p, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
  FROM linked n LEFT JOIN kids k ON k.d = n.d AND k.conv_id = n.conv_id
  JOIN member m ON m.c = n.conv_id AND m.d <= n.d GROUP BY m.d, m.p
), ends AS (
  SELECT m.d, m.p, string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) AS ids
  FROM member m JOIN long l ON l.c = m.c AND l.n = m.d GROUP BY m.d, m.p
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, n.parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
       b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM linked n JOIN below b ON b.d = n.d AND b.p = n.p
LEFT JOIN kids k ON k.d = n.d AND k.conv_id = n.conv_id LEFT JOIN ends e ON e.d = n.d AND e.p = n.p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": SQL_OP1.strip(), "op7_exact_top_k": SQL_OP7.strip(), "op10_url_filters": SQL_OP10.strip(),
            "op13_prefix_trie": SQL_OP13.strip()}
