"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import dialogue, infill, jaccard, langid, lattice, licences, mixing, quality, rules, tokens, urls, vectors, warc
from tidewatch.session import staged


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf, "documents"), n=3, num=90, den=100)


# Components in SQL: `linked` (a, b) both ways, `node` (id); the smallest id that links lead to.
_REACH = """
reach(id, top) AS (
  SELECT id, id FROM node
  UNION
  SELECT l.b, r.top FROM reach r JOIN linked l ON l.a = r.id),
component AS (SELECT id, min(top) AS component_id FROM reach GROUP BY id)"""

OP1_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM words),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
size AS (SELECT doc_id, len(s) AS n FROM sets),
pair AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
linked AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
node AS (SELECT doc_id AS id FROM documents),{_REACH}
SELECT doc_id, n AS n_shingles, component_id FROM size JOIN component ON id = doc_id"""


def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf, "pages"))


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
first AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> holder THEN holder END AS refers_to
FROM first"""


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    held_out = langid.is_held_out(F.col("doc_id"))
    model = langid.learn(docs.where(~held_out))
    return langid.identify(docs, model, "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    statistics = staged(rules.text_statistics(_table(spark, sf, "documents")))
    labels = _table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return rules.apply(statistics, rules.learn_from(statistics, labels))


# Segments that lengthen the path of every seventh page, so that captures and list entries go deep.
DEEP = "/a/b/c/d/e/f/g/h/i/j/k/l"


def _captures(pages: DataFrame) -> DataFrame:
    """Pages with a day of 2024 on which they were fetched, by page_id; every seventh lies twelve segments deeper."""
    plain = (F.col("page_id") % 7 == 0) & ~F.contains("url", F.lit("?")) & ~F.contains("url", F.lit("#"))
    url = F.when(plain, F.concat(F.col("url"), F.lit(DEEP))).otherwise(F.col("url")).alias("url")
    return pages.select("page_id", url, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(page_id * 37 % 366 as int))").alias("fetched_at"))


def _listed(captures: DataFrame) -> DataFrame:
    """A dated list over the captures' own hosts, domains, first path segments and whole paths, by the smallest page_id of each."""
    parts = captures.select("page_id", urls.host(F.col("url")).alias("h"), F.split(urls.path(F.col("url")), "/").alias("p")).where("h IS NOT NULL")
    domain = F.array_join(F.slice(F.split("h", r"\."), -2, 2), ".")
    segments = F.array_remove("p", "")
    found = parts.select("page_id", F.explode(F.array(
        F.struct(F.col("h").alias("pattern"), F.lit(0).alias("kind")),
        F.struct(F.when(F.size(F.split("h", r"\.")) > 2, domain).alias("pattern"), F.lit(1).alias("kind")),
        F.struct(F.when(F.size("p") > 1, F.concat("h", F.lit("/"), F.get("p", F.lit(1)))).alias("pattern"), F.lit(2).alias("kind")),
        F.struct(F.when(F.size(segments) > 1, F.concat("h", F.lit("/"), F.array_join(segments, "/"))).alias("pattern"), F.lit(3).alias("kind")))).alias("e"))
    least = found.where("e.pattern IS NOT NULL AND e.pattern NOT LIKE '%/'").groupBy("e.pattern", "e.kind").agg(F.min("page_id").alias("m"))
    day = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(d as int))")
    entries = least.select("pattern", F.explode(F.expr("""
        filter(array(named_struct('d', m * 11 % 200, 'verdict', if((m + kind) % 3 = 0, 'allow', 'block'), 'used', (m + kind) % 4 <> 0),
                     named_struct('d', m * 11 % 200 + 60, 'verdict', if(m % 2 = 0, cast(null as string), 'allow'), 'used', m % 3 = 0),
                     named_struct('d', 300, 'verdict', 'block', 'used', m % 5 = 0)), e -> e.used)""")).alias("e"))
    return entries.select("pattern", F.col("e.d").alias("d"), F.col("e.verdict").alias("verdict")).select("pattern", day.alias("listed_at"), "verdict")


def op6_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    pages = _table(spark, sf, "pages").select("page_id", "url")
    captures = _captures(pages)
    return urls.list_verdicts(captures, _listed(captures))


OP6_SQL = rf"""
WITH captured AS (
  SELECT page_id, CASE WHEN page_id % 7 = 0 AND NOT contains(url, '?') AND NOT contains(url, '#') THEN url || '{DEEP}' ELSE url END AS url FROM pages),
c AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 37 % 366 AS INTEGER)) AS fetched_at,
         nullif(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1),
                                                                   '^.*@', ''), ':[0-9]*$', '')), '\.+$', ''), '') AS host,
         regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)', 1) AS path
  FROM captured),
s AS (SELECT *, string_split(host, '.') AS l, [x FOR x IN string_split(path, '/') IF x <> ''] AS seg FROM c),
found AS (
  SELECT page_id, host AS pattern, 0 AS kind FROM s WHERE host IS NOT NULL
  UNION ALL SELECT page_id, l[-2] || '.' || l[-1], 1 FROM s WHERE len(l) > 2
  UNION ALL SELECT page_id, host || '/' || string_split(path, '/')[2], 2 FROM s WHERE string_split(path, '/')[2] <> ''
  UNION ALL SELECT page_id, host || '/' || array_to_string(seg, '/'), 3 FROM s WHERE host IS NOT NULL AND len(seg) > 1),
least_id AS (SELECT pattern, kind, min(page_id) AS m FROM found GROUP BY 1, 2),
entry AS (
  SELECT pattern, m * 11 % 200 AS d, CASE WHEN (m + kind) % 3 = 0 THEN 'allow' ELSE 'block' END AS verdict FROM least_id WHERE (m + kind) % 4 <> 0
  UNION ALL SELECT pattern, m * 11 % 200 + 60, CASE WHEN m % 2 = 0 THEN NULL ELSE 'allow' END FROM least_id WHERE m % 3 = 0
  UNION ALL SELECT pattern, 300, 'block' FROM least_id WHERE m % 5 = 0),
daily AS (SELECT pattern, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER)) AS since, max(verdict) AS verdict FROM entry GROUP BY 1, 2),
held AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM daily),
asked AS (
  SELECT page_id, fetched_at, unnest(range(1, len(l) + 1)) AS rank, array_to_string(l[len(l) - rank + 1:], '.') AS pattern FROM s WHERE host IS NOT NULL
  UNION ALL
  SELECT page_id, fetched_at, 100 + k, host || '/' || array_to_string(seg[:k], '/')
  FROM (SELECT *, unnest(range(1, len(seg) + 1)) AS k FROM s WHERE host IS NOT NULL)),
ranked AS (
  SELECT page_id, verdict, a.pattern, since, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, verdict DESC) AS r
  FROM asked a JOIN held h ON a.pattern = h.pattern AND since <= fetched_at AND (until IS NULL OR fetched_at < until)
  WHERE verdict IS NOT NULL)
SELECT c.page_id, url, host, fetched_at, coalesce(verdict, 'none') AS verdict, pattern, since
FROM c LEFT JOIN ranked ON ranked.page_id = c.page_id AND r = 1"""


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf, "documents"))


def op8_quality_machine(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    machine = quality.learn(docs, _table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")))
    return quality.scores(docs, machine, "doc_id").select("doc_id", langid.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.round_trip(_table(spark, sf, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf, "embeddings"))


OP10_SQL = f"""
WITH RECURSIVE valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
    AND len([c FOR c IN embedding IF c <> 0]) > 0),
pair AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM valid x JOIN valid y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
linked AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
node AS (SELECT vec_id AS id FROM embeddings),{_REACH},
links AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component ON id = vec_id LEFT JOIN links ON a = vec_id"""


def op11_infill(spark: SparkSession, sf: str) -> DataFrame:
    cut = infill.fill_in_middle(_table(spark, sf, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(infill.restored("output", "form").cast("binary"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         [('0x' || sha256('42:' || doc_id)[8 * k + 1:8 * k + 8])::BIGINT FOR k IN range(4)] AS h FROM documents),
placed AS (
  SELECT *, len(u) AS n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, coalesce(array_to_string(u[:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM parts"""


def op12_dialogue_repair(spark: SparkSession, sf: str) -> DataFrame:
    conversations = _table(spark, sf, "conversations")
    out = dialogue.repair_summary(dialogue.damaged(conversations), conversations.select(F.col("conv_id").alias("conv")))
    return out.withColumnRenamed("conv", "conv_id")


OP12_SQL = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) g(b)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (
  SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT)),
                                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE h <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w || role[1] AS pair, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text))),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
flagged AS (
  SELECT *, last = '' AS blank, last <> '' AND again AS dup, last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS cut FROM seen),
inserted(p, q, cost, audit, lines) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']),
         (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
step(initial, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
edit AS (
  SELECT conv_id, i, p, p AS q, 3 AS cost, 'D' AS audit, []::VARCHAR[] AS lines FROM flagged, range(4) g(p)
  UNION ALL SELECT conv_id, i, p, q, 2 + cut::INT, 'R', [CASE step.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
  FROM flagged, step WHERE NOT (blank OR dup) AND step.initial <> 's'
  UNION ALL SELECT conv_id, i, p, q, cut::INT, 'K', [role || ':' || text] FROM flagged JOIN step ON role[1] = step.initial WHERE NOT (blank OR dup)),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS place, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM flagged
  UNION ALL
  SELECT w.conv_id, e.i, e.q, min({'cost': w.best.cost + n.cost + e.cost, 'audit': w.best.audit || n.audit || e.audit, 'lines': w.best.lines || n.lines || e.lines})
  FROM walk w JOIN inserted n ON n.p = w.place JOIN edit e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.p = n.q
  GROUP BY w.conv_id, e.i, e.q),
found AS (
  SELECT w.conv_id, min({'cost': w.best.cost + n.cost, 'audit': w.best.audit || n.audit, 'lines': w.best.lines || n.lines}) AS best
  FROM walk w JOIN inserted n ON n.p = w.place AND n.q IN (0, 3)
  WHERE i = (SELECT max(i) FROM flagged f WHERE f.conv_id IS NOT DISTINCT FROM w.conv_id) GROUP BY w.conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
         count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flagged GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM o.conv_id"""


def op13_licences(spark: SparkSession, sf: str) -> DataFrame:
    places = licences.licence_places(_table(spark, sf, "documents"))
    found, base = F.col("places"), F.filter("places", lambda p: p["kind"] == "base")
    return places.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
                         F.array_min(F.transform(base, lambda p: p["first_word"])).alias("first_word"),
                         F.array_max(F.transform(base, lambda p: p["first_word"])).alias("last_word"),
                         licences.label_list(base).alias("base_labels"), licences.label_list(found).alias("labels"),
                         licences.certainty(found).alias("score"), licences.freedom(found).alias("freedom"))


ENTRIES = {
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op1_ngram_jaccard": (op1_ngram_jaccard, OP1_SQL),
    "op2_warc": (op2_warc, OP2_SQL),
    "op3_mixing": (op3_mixing, None),
    "op4_language_id": (op4_language_id, None),
    "op5_quality_rules": (op5_quality_rules, None),
    "op6_url_filters": (op6_url_filters, OP6_SQL),
    "op7_token_counts": (op7_token_counts, None),
    "op8_quality_machine": (op8_quality_machine, None),
    "op9_sentencepiece": (op9_sentencepiece, None),
    "op10_embedding_near_dedup": (op10_embedding_near_dedup, OP10_SQL),
    "op11_infill": (op11_infill, OP11_SQL),
    "op12_dialogue_repair": (op12_dialogue_repair, OP12_SQL),
    "op13_licences": (op13_licences, None),
}
