"""The registered queries of the corpus operators; each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import chat, decontam, langid, linededup, media, mixing, packing, pii, simhash, spelling, topk, toxicity, whitening
from wayfold.llm.common import crc_remainder, prepare, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract(F.lower("url"), linededup.HOST, 1)
    pages = pages.select("page_id", host.alias("host"), linededup.page_lines(F.col("html")).alias("text"))
    out = linededup.dedup_lines(pages)
    return out.select("page_id", "host", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    stored = media.store_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [c.split()[0] for c in media.READ_SCHEMA.split(", ")]
    return media.read_media(stored).select("doc_id", "n_bytes", *names)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(chat.calls_from_turns(table(spark, sf_dir, "conversations")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = langid.classify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (crc_remainder(F.col("doc_id"), langid.FOLDS) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_toxicity, op3_best_fit_packing, op4_line_dedup, op5_media, op6_mixing, op7_chat_format, op8_simhash, op9_language_id, op10_top_k,
        op11_whitening, op12_decontamination, op13_spelling_variants,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: op4: a page's lines and the share of a host's pages that hold each, as the operator defines them. op7: calls
#: are a conversation's user and system turns in order, so a call's level is its place among them. op12: every window of words
#: as text. op13: crc32 from its table of remainders; near words through words with one letter taken out.
ORACLES = {
    "op12_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {decontam.WINDOW}) AS size, array_to_string(w[k:k+{decontam.WINDOW}-1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w)-{decontam.WINDOW}+1, 1)+1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT rid, size, k, array_to_string(w[k:k+size-1], ' ') AS win
  FROM (SELECT rid, w, size, unnest(range(1, len(w)-size+2)) AS k FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT rid, k, size, item_id FROM dw JOIN iw USING (win, size)),
places AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(k, k+size)) AS pos FROM hits) GROUP BY rid),
ids AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (item_id IS NOT NULL)) AS ids FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN ids USING (rid)
""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY doc_id, run),
b AS (SELECT run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(t.crc[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM b, t),
c AS (SELECT CASE WHEN h % {spelling.MODULUS} = 0 THEN concat(run[:h % length(run)], run[h % length(run) + 2:]) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
s AS (SELECT word, n, word[:i-1] AS p, word[i+1:] AS q FROM (SELECT word, n, unnest(range(1, length(word)+1)) AS i FROM v)),
e AS (SELECT a.word, b.word AS other, b.n AS m FROM s a JOIN s b ON a.p = b.p AND a.q = b.q AND a.word <> b.word
  UNION SELECT s.word, v.word, v.n FROM s JOIN v ON concat(p, q) = v.word UNION SELECT v.word, s.word, s.n FROM s JOIN v ON concat(p, q) = v.word),
g AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS best, max(m) AS best_n FROM e GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2*n THEN best END AS form, CASE WHEN best_n >= 2*n THEN best_n END AS form_n FROM v LEFT JOIN g USING (word)),
w AS (SELECT word, word AS at FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL),
z AS (SELECT w.word, w.at AS root FROM w JOIN f ON f.word = w.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
""",
    "op7_chat_format": f"""
WITH m AS (SELECT *, role IN ('user','system') AND turn IS NOT NULL AND conv_id IS NOT NULL AS asks FROM
    (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text,'') AS text FROM conversations)),
c AS (SELECT conv_id, turn, count(*) AS uses, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS level FROM m WHERE asks GROUP BY conv_id, turn),
i AS (SELECT m.*, CASE WHEN asks THEN turn WHEN role='assistant' AND conv_id IS NOT NULL THEN turn-1 END AS ref FROM m),
j AS (SELECT i.*, c.uses, c.level, c.turn AS called, EXISTS (SELECT 1 FROM m a WHERE a.role='assistant' AND a.conv_id=i.conv_id AND a.turn=i.turn+1) AS answered FROM i LEFT JOIN c ON c.conv_id=i.conv_id AND c.turn=i.ref)
SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, CASE WHEN ref IS NOT NULL THEN concat('call_',CAST(ref AS VARCHAR)) END AS call_id,
  CASE WHEN ref IS NULL THEN 'message' WHEN asks AND uses>1 THEN 'duplicate' WHEN asks AND length(text)>{chat.MAX_PROMPT} THEN 'invalid:length:prompt' WHEN asks AND NOT answered THEN 'unanswered'
    WHEN asks THEN 'linked' WHEN called IS NULL THEN 'orphan' ELSE 'linked' END AS status,
  coalesce(called, turn) AS anchor, CAST(CASE WHEN asks THEN level WHEN called IS NOT NULL THEN level+1 ELSE 0 END AS BIGINT) AS level,
  CASE WHEN asks THEN concat('{{"arguments":{{"prompt":', CAST(to_json(text) AS VARCHAR), ',"turn":', CAST(turn AS VARCHAR), '}},"id":"call_', CAST(ref AS VARCHAR), '","name":"', CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END, '","role":"', role, '","turn":', CAST(turn AS VARCHAR), '}}')
    ELSE concat('{{"content":', CAST(to_json(text) AS VARCHAR), CASE WHEN role IS NOT NULL THEN concat(',"role":', CAST(to_json(role) AS VARCHAR)) ELSE '' END,
      CASE WHEN ref IS NOT NULL THEN concat(',"tool_call_id":"call_', CAST(ref AS VARCHAR), '"') ELSE '' END, CASE WHEN turn IS NOT NULL THEN concat(',"turn":', CAST(turn AS VARCHAR)) ELSE '' END, '}}') END AS json
FROM j
""",
    "op10_top_k": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE}*CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding)>0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id%{topk.EVERY}=0 GROUP BY vec_id)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY CAST(list_dot_product(q.v, c.v) AS BIGINT) DESC, c.vec_id) AS INTEGER) AS rank, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
FROM q JOIN v c ON c.vec_id<>q.vec_id AND len(c.v)=len(q.v) QUALIFY rank<={topk.K}
""",
    "op4_line_dedup": r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS rid, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS host,
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', chr(10), 'g'),
      '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS body
  FROM pages),
l AS (SELECT rid, host, pos, line, trim(line, ' ' || chr(9)) AS shown FROM (
  SELECT rid, host, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS pos FROM p)),
c AS (SELECT host, shown, count(DISTINCT rid) AS n FROM l WHERE shown <> '' GROUP BY ALL),
b AS (SELECT c.host, c.shown FROM c JOIN (SELECT host, count(*) AS t FROM p GROUP BY host) h ON c.host = h.host WHERE n >= 3 AND n > 0.5 * t),
m AS (SELECT l.rid, l.pos, l.line, l.shown, b.shown IS NOT NULL AS gone FROM l LEFT JOIN b ON l.host = b.host AND l.shown = b.shown),
g AS (SELECT rid, count(*) FILTER (shown <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY rid)
SELECT page_id, host, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, g.text
FROM p LEFT JOIN g USING (rid)
""",
}
