"""The registered queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadlens.llm.common import table
from roadlens.llm.decontaminate import contamination
from roadlens.llm.embeddings import embedding_duplicates
from roadlens.llm.langid import identify_languages
from roadlens.llm.mixing import mixed
from roadlens.llm.neighbours import nearest_neighbours
from roadlens.llm.pages import extracted
from roadlens.llm.pii import personal_data
from roadlens.llm.simhash import near_duplicates
from roadlens.llm.spelling import spelling_variants
from roadlens.llm.substrings import removed_units
from roadlens.llm.toxicity import toxicity
from roadlens.llm.warc import archived_pages
from roadlens.llm.whitening import whitened_vectors


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("found")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_units(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"), targets={"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}})
    return out.select("doc_id", "n_tokens", "weight", "probability", "kept")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_vectors(table(spark, sf_dir, "embeddings"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_substrings": op2_substrings,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_langid": op6_langid,
    "op7_pages": op7_pages,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_embeddings": op10_embeddings,
    "op11_spelling": op11_spelling,
    "op12_whitening": op12_whitening,
    "op13_neighbours": op13_neighbours,
}

ORACLES = {
    "op1_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bp AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM bp),
sizes AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM dp),
hits AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
""",
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT page_id, b, CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY b) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
""",
    "op10_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id) c
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) n USING (vec_id)
""",
    "op2_substrings": r"""
WITH u AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(('0x' || substr(md5(text), 1, 15)) AS BIGINT) AS tie,
         string_split(regexp_replace(text, '([^.!?\x20\x09-\x0D][.!?])\x20', '\1' || chr(10), 'g'), chr(10)) AS us
  FROM documents WHERE text IS NOT NULL),
p AS (SELECT rid, unnest(us) AS un, unnest(range(1, len(us) + 1)) AS k FROM u),
o AS (SELECT rid, un, k, sum(length(un) + 1) OVER (PARTITION BY rid ORDER BY k) - length(un) - 1 AS s FROM p),
w AS (SELECT rid, s, s + length(un) AS e, regexp_extract_all(un, '[^\x20\x09-\x0D]+') AS ws FROM o),
g AS (SELECT rid, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es, list(len(ws) ORDER BY s) AS ns,
             list(translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ORDER BY s) AS fs
      FROM w WHERE len(ws) > 0 GROUP BY rid),
i AS (SELECT *, unnest(range(1, len(ns) + 1)) AS i FROM g),
r AS (SELECT rid, i AS a, i AS b FROM i WHERE ns[i] >= 8
      UNION SELECT rid, i, list_filter(range(i, least(i + 8, len(ns) + 1)), lambda j: list_sum(ns[i : j]) >= 8)[1] FROM i WHERE ns[i] < 8
      UNION SELECT rid, list_filter(range(greatest(1, i - 7), i + 1), lambda j: list_sum(ns[j : i]) >= 8)[-1], i FROM i WHERE ns[i] < 8
      UNION SELECT rid, 1, len(ns) FROM g WHERE list_sum(ns) < 8),
f AS (SELECT rid, doc_id, tie, a < b AS run, ss[a] AS s, es[b] AS e, list_sum(ns[a : b]) AS n, array_to_string(fs[a : b], ' ') AS form
      FROM r JOIN g USING (rid) JOIN u USING (rid) WHERE a IS NOT NULL AND b IS NOT NULL),
q AS (SELECT *, first_value(doc_id) OVER o AS kd, first_value(rid) OVER o AS kr, first_value(s) OVER o AS ks, first_value(e) OVER o AS ke, count(*) OVER (PARTITION BY form) AS c, max(run) OVER (PARTITION BY form) AS runs
      FROM f WINDOW o AS (PARTITION BY form ORDER BY doc_id NULLS LAST, tie, rid, s)),
m AS (SELECT *, rid = kr AND s = ks AS stays FROM q WHERE c > 1),
bad AS (SELECT form FROM m WHERE runs AND stays AND EXISTS (SELECT 1 FROM m t WHERE NOT t.runs AND NOT t.stays AND t.rid = m.rid AND t.s < m.e AND t.e > m.s)),
v AS (SELECT * FROM m WHERE form NOT IN (SELECT form FROM bad))
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", CAST(n AS INTEGER) AS n_words,
       kd AS kept_doc_id, CAST(ks AS INTEGER) AS kept_start, CAST(ke AS INTEGER) AS kept_end
FROM v WHERE NOT stays AND (NOT runs OR NOT EXISTS (SELECT 1 FROM v k WHERE k.stays AND k.rid = v.rid AND k.s < v.e AND k.e > v.s))
""",
    "op11_spelling": r"""
WITH RECURSIVE
tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
u AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
l AS (SELECT d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c FROM u WHERE length(r) >= 6 GROUP BY ALL),
b AS (SELECT r, c, flatten(list_transform(string_split(d || ':' || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195::BIGINT, CAST(unicode(x) - 64 AS BIGINT)] END)) AS bytes FROM l),
h AS (SELECT r, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a // 256, t[CAST(xor(a % 256, x) AS BIGINT) + 1])), 4294967295::BIGINT) AS h FROM b, tab),
m AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
e AS (SELECT word, n, substr(word, 1, i - 1) || '$' || substr(word, i + 1) AS k FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
y AS (SELECT word, n, substr(word, 1, i) || '$' || substr(word, i + 1) AS k FROM (SELECT *, unnest(range(0, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b, b.n FROM e a JOIN e b USING (k) WHERE a.word <> b.word UNION SELECT e.word, y.word, y.n FROM e JOIN y USING (k) UNION SELECT y.word, e.word, e.n FROM e JOIN y USING (k)),
q AS (SELECT *, count(*) OVER (PARTITION BY a) AS c, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS o FROM p),
f AS (SELECT w.word, w.n, coalesce(c, 0) AS n_near, CASE WHEN q.n >= 5 * w.n THEN b END AS form, CASE WHEN q.n >= 5 * w.n THEN q.n END AS form_n FROM w LEFT JOIN q ON q.a = w.word AND o = 1),
g(word, last, steps) AS (SELECT word, word, 0 FROM f UNION ALL SELECT g.word, f.form, steps + 1 FROM g JOIN f ON f.word = g.last WHERE f.form IS NOT NULL)
SELECT word, form, arg_max(last, steps) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM g JOIN f USING (word) GROUP BY ALL
""",
}
