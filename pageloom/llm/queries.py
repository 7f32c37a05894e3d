"""One query per training-data operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, epsilon, fingerprints, flatfiles, jaccard, langid, lines, lm, mixing, packing, runs, whitening
from .common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return chat.read_conversations(chat.format_conversations(turns, vocabulary), vocabulary)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon.epsilon_join(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.95)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 20 = 0", k=20)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), weights=(1, 2, 3), most=3)
    return out.select("doc_id", "size", "source_size", "target", "taken", "slots", "first_slot")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.stupid_backoff(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(langid.training_rows(docs))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.jaccard_components(_table(spark, sf_dir, "documents"), words=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return flatfiles.token_counts(docs, f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}", public_tokenizers.path("word_bpe_49k.json"), end_id=49407)


def with_periods(docs: DataFrame) -> DataFrame:
    """docs whose texts repeat words with a period, in one document of ten: which, from which word on and how long are functions of doc_id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    x = docs.withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    n = F.size("_w")
    x = x.withColumn("_n", n).withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))).cast("int"))
    rest = (F.col("_n") - F.col("_a")).cast("int")
    head = F.slice("_w", F.lit(1), F.col("_a").cast("int"))
    again = F.flatten(F.array_repeat(F.slice("_w", (F.col("_a") + 1).cast("int"), F.col("_p")), F.ceil(rest / F.col("_p")).cast("int")))
    text = F.array_join(F.concat(head, F.slice(again, F.lit(1), rest)), " ")
    return x.withColumn("text", F.when(F.col("_n") > 0, text).otherwise(F.col("text"))).select(*docs.columns)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(with_periods(_table(spark, sf_dir, "documents").select("doc_id", "text")), least=12)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = out.withColumn("_r", longest)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_r.start")).alias("start"),
        F.col("_r.length").alias("length"),
        (-F.col("_r.period")).alias("period"),
        F.floor(1000 * F.col("_r.length") / -F.col("_r.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_embedding_near_dedup, op3_best_fit_packing, op4_nearest_neighbours, op5_line_dedup, op6_source_mixing, op7_lm_scoring, op8_language_id, op9_ngram_jaccard, op10_token_counts, op11_periodic_runs, op12_embedding_whitening, op13_document_fingerprints)}

ORACLES = {
    "op1_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|/?ROLE\])')) AS n,
    length(role) + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\]|/?ROLE\])')) AS m FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS said,
    3 + sum(CASE role WHEN 'user' THEN n + 13 WHEN 'assistant' THEN n + 4 ELSE m + n + 17 END) AS formatted_chars FROM e GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, turns_sha256, CAST(length(said) AS BIGINT) AS loss_chars, sha256(said) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g""",
    "op2_embedding_near_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm, coalesce(len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0, false) AS ok FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.ok AND b.ok AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM u UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
k AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT k.vec_id, coalesce(n.n, 0) AS n_links, component_id, k.vec_id = component_id AS kept FROM k LEFT JOIN n ON k.vec_id = n.a""",
    "op5_line_dedup": r"""
WITH l AS (
  SELECT doc_id, i AS line_no, x[i] AS line, lower_az AS k FROM (
    SELECT doc_id, x, i, translate(trim(x[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
    FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)))),
heavy AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(heavy.k) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE heavy.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN heavy ON l.k = heavy.k GROUP BY l.doc_id""",
    "op6_source_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0 * sum(size) AS cap,
    1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
fill(step, share, sum_w) AS (
  SELECT 0, (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) / (SELECT sum(weight) FROM s), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT step + 1, (SELECT (sum(source_size) - coalesce(sum(cap) FILTER (WHERE cap / weight < share), 0)) / CAST(sum(weight) FILTER (WHERE cap / weight >= share) AS DOUBLE) FROM s), share
  FROM fill WHERE share <> sum_w AND step < 50),
t AS (SELECT source, source_size, CAST(least(cap, weight * (SELECT max(share) FROM fill)) AS DOUBLE) AS target FROM s),
q AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota, row_number() OVER (ORDER BY source ASC NULLS LAST) AS no,
    sum(target) OVER (ORDER BY source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) / (SELECT sum(target) FROM t) AS hi FROM t),
shares AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY no), 0) AS lo FROM q),
total AS (SELECT CAST((sum(quota) + 1023) // 1024 AS BIGINT) AS n FROM q),
points AS (SELECT i AS slot, ((i + 0.5) * CAST(0.6180339887498949 AS DOUBLE)) % 1.0 AS u FROM (SELECT unnest(range(0, (SELECT n FROM total))) AS i)),
hits AS (SELECT slot, no, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS block FROM points JOIN shares ON u >= lo AND (u < hi OR hi >= 1) AND quota > 0),
blocks AS (SELECT no, unnest(range(0, (quota + 1023) // 1024)) AS block FROM q),
slots AS (
  SELECT b.no, b.block, coalesce(slot, (SELECT n FROM total) + row_number() OVER (PARTITION BY slot IS NULL ORDER BY b.no, b.block) - 1) AS slot
  FROM blocks b LEFT JOIN hits h ON b.no = h.no AND b.block = h.block),
p AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.quota, q.no,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.size ROWS UNBOUNDED PRECEDING) - d.size AS a
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
passes AS (
  SELECT *, a + k * source_size AS f, least(a + k * source_size + size, quota) AS t FROM p, (SELECT unnest(range(0, 3)) AS k) WHERE size > 0 AND a + k * source_size < quota),
found AS (
  SELECT doc_id, sum(t - f) AS taken, sum((t - 1) // 1024 - f // 1024 + 1) AS slots, min(f // 1024) AS block FROM passes GROUP BY doc_id)
SELECT p.doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(coalesce(found.slots, 0) AS BIGINT) AS slots, CAST(slots.slot AS BIGINT) AS first_slot
FROM p LEFT JOIN found ON p.doc_id = found.doc_id LEFT JOIN slots ON slots.no = p.no AND slots.block = found.block""",
    "op9_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(x[i : i + 3], ' ') AS g FROM (SELECT doc_id, x, unnest(range(1, greatest(len(x) - 3, least(len(x), 1)) + 1)) AS i FROM w)),
n AS (SELECT w.doc_id, count(g.g) AS n_shingles FROM w LEFT JOIN g ON w.doc_id = g.doc_id GROUP BY w.doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * o >= 85 * (x.n_shingles + y.n_shingles - o)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT n.doc_id, n.n_shingles, min(r.c) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n_shingles""",
    "op11_periodic_runs": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_concat([4294967295], flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(CAST(doc_id AS VARCHAR), '')])),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g, coalesce(h % 10 = 0, false) AND len(w) > 0 AS planted FROM d),
p AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM e),
q AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) END AS per FROM p),
t AS (SELECT doc_id, CASE WHEN planted THEN list_concat(w[1 : a], [w[a + i % per + 1] for i in range(0, n - a)]) ELSE w END AS w FROM q),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM t),
six AS (SELECT doc_id, i - 1 AS i, array_to_string(w[i : i + 5], ' ') AS k FROM s),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS period FROM six a JOIN six b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i),
isles AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS isle FROM pairs),
found AS (SELECT doc_id, period, min(i) AS start, count(*) + 5 + period AS length FROM isles GROUP BY doc_id, period, isle HAVING count(*) + 5 + period >= greatest(12, 2 * period)),
r AS (SELECT doc_id, start, CAST(length AS BIGINT) AS length, min(period) AS period FROM found GROUP BY doc_id, start, length),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
said AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS x FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
word AS (SELECT doc_id, i - 1 AS i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS x FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(said.n, 0) AS n_runs, best.start, best.length, best.period, best.length * 1000 // best.period AS exponent_milli,
  sha256(coalesce(said.x, '')) AS runs_sha256, sha256(coalesce(kept.x, '')) AS collapsed_sha256
FROM t LEFT JOIN said ON t.doc_id = said.doc_id LEFT JOIN best ON t.doc_id = best.doc_id LEFT JOIN kept ON t.doc_id = kept.doc_id""",
    "op13_document_fingerprints": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM documents),
x AS (
  SELECT doc_id, text, n_chars, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next FROM d
  WINDOW w AS (ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, text[1 : n_chars - n_chars // 2] || next[1 : n_chars // 2] AS edited FROM x),
v AS (SELECT doc_id, 'own' AS kind, text AS t FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e UNION ALL SELECT doc_id, 'next', next FROM e),
p AS (
  SELECT DISTINCT doc_id, kind, CAST('0x' || md5(piece)[1 : 15] AS BIGINT) AS k FROM (
    SELECT doc_id, kind, unnest(string_split(regexp_replace(t, '([^\n]{100})', '\1' || chr(10), 'g'), chr(10))) AS piece FROM v) WHERE piece <> ''),
s AS (SELECT doc_id, kind, count(*) AS n FROM p GROUP BY doc_id, kind),
b AS (SELECT a.doc_id, b.kind, count(*) AS n FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.k = b.k AND a.kind = 'own' AND b.kind <> 'own' GROUP BY a.doc_id, b.kind),
c AS (
  SELECT doc_id, kind, unnest([k % 8, (k >> 20) % 8 + 8, (k >> 40) % 8 + 16]) AS cell, k, (k % 2147483647) * (k % 2147483629) AS chk FROM p WHERE kind <> 'next'),
g AS (SELECT doc_id, kind, cell, count(*) || '.' || hex(bit_xor(k)) || '.' || hex(bit_xor(chk)) AS said FROM c GROUP BY doc_id, kind, cell),
f AS (
  SELECT e.doc_id, kind, string_agg(coalesce(said, '0.0.0'), ' ' ORDER BY cell) AS said
  FROM e CROSS JOIN (SELECT unnest(['own', 'edited']) AS kind) CROSS JOIN (SELECT unnest(range(0, 24)) AS cell) LEFT JOIN g USING (doc_id, kind, cell) GROUP BY e.doc_id, kind)
SELECT e.doc_id, n_chars, sha256(edited) AS edited_sha256, coalesce(so.n, 0) || ':' || fo.said AS fingerprint, coalesce(se.n, 0) || ':' || fe.said AS edited_fingerprint,
  CASE WHEN coalesce(so.n, 0) + coalesce(se.n, 0) = 0 THEN 1.0::DOUBLE ELSE coalesce(be.n, 0) / (coalesce(so.n, 0) + coalesce(se.n, 0) - coalesce(be.n, 0))::DOUBLE END AS near_edited,
  CASE WHEN coalesce(so.n, 0) + coalesce(sn.n, 0) = 0 THEN 1.0::DOUBLE ELSE coalesce(bn.n, 0) / (coalesce(so.n, 0) + coalesce(sn.n, 0) - coalesce(bn.n, 0))::DOUBLE END AS near_next
FROM e JOIN f fo ON e.doc_id = fo.doc_id AND fo.kind = 'own' JOIN f fe ON e.doc_id = fe.doc_id AND fe.kind = 'edited'
LEFT JOIN s so ON e.doc_id = so.doc_id AND so.kind = 'own' LEFT JOIN s se ON e.doc_id = se.doc_id AND se.kind = 'edited' LEFT JOIN s sn ON e.doc_id = sn.doc_id AND sn.kind = 'next'
LEFT JOIN b be ON e.doc_id = be.doc_id AND be.kind = 'edited' LEFT JOIN b bn ON e.doc_id = bn.doc_id AND bn.kind = 'next'""",
}
