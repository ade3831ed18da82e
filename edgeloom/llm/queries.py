"""The queries that apply each operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import ann, chat, codebooks, decontaminate, hard_negatives, langid, lattice, licenses, line_dedup, packing, simhash, token_counts, url_rules


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.licenses(docs, licenses.fit(docs))


#: A conversation whose texts hold the template's own marks.
MARKED = r"\### Assistant: </turn> ok"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is an event that brings a whole message."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    events = rows.unionByName(own).selectExpr("conv_id", "row_number() over (partition by conv_id order by turn, role, text) as seq", "'message' as kind", "role", "text")
    turns = chat.reconstruct(events.withColumn("message_id", F.col("seq")))
    return chat.digests(chat.render(turns))


URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels name pages by number; a page is unwanted if it is labelled as toxic or of quality 0."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("unwanted"))
    return url_rules.judge(table(spark, sf_dir, "pages"), labels, URL_RULES)


def packed(docs: DataFrame) -> DataFrame:
    """Where each piece of the documents goes, with a checksum in place of its ids."""
    pieces = packing.tokenized(docs, vocabulary("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.best_fit(pieces)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text as line dedup leaves it."""
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; every seventh label is the next one."""
    v = table(spark, sf_dir, "embeddings").where("label is not null")
    v = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(hard_negatives.whole_numbers(v, "vec_id", "embedding", "label"), F.col("id") % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.code_strings(*codebooks.compress(table(spark, sf_dir, "embeddings")))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length(replace(text, '\', '\\')) + length(text) - length(replace(text, '</turn>', '</turn')) AS body FROM t),
h AS (SELECT *, body + coalesce(list_sum(list_transform(regexp_extract_all(replace(text, '\', '\\'), '###+'), lambda y: length(y) - 2)), 0) AS chars FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ': ') + chars + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM h GROUP BY conv_id
"""

#: A line goes if it lies in a run of lines, of 60 characters or more, that an earlier document holds too; the shortest
#: runs that start or end at a line cover all others. All columns stay.
OP7_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, p, trim(line) AS x, length(trim(line)) AS n, row_number() OVER w AS i, sum(length(trim(line))) OVER w AS z
      FROM l WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT a.doc_id, a.i AS i, b.i AS j FROM x a ASOF JOIN x b ON a.doc_id = b.doc_id AND a.z - a.n + 60 <= b.z
         UNION SELECT b.doc_id, a.i, b.i FROM x b ASOF JOIN x a ON b.doc_id = a.doc_id AND b.z - 60 >= a.z - a.n),
whole AS (SELECT doc_id, list(x ORDER BY i) AS xs FROM x GROUP BY doc_id),
keyed AS (SELECT doc_id, i, j, array_to_string(list_slice(xs, i, j), chr(10)) AS k FROM runs JOIN whole USING (doc_id)),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM keyed JOIN (SELECT k, min(doc_id) AS first FROM keyed GROUP BY k) USING (k) WHERE doc_id > first),
gone AS (SELECT doc_id, p FROM cut JOIN x USING (doc_id, i)
         UNION SELECT a.doc_id, l.p FROM (SELECT doc_id, x.i, x.p FROM cut JOIN x USING (doc_id, i)) a
         JOIN (SELECT doc_id, x.i, x.p FROM cut JOIN x USING (doc_id, i)) b ON a.doc_id = b.doc_id AND b.i = a.i + 1 JOIN l ON l.doc_id = a.doc_id AND l.p > a.p AND l.p < b.p),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM l ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT documents.* REPLACE (CASE WHEN documents.text IS NULL OR documents.doc_id IS NULL THEN documents.text ELSE coalesce(kept.text, '') END AS text)
FROM documents LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
           FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM benchmark),
bw AS (SELECT item, least(len(w), 13) AS n, unnest(range(1, CAST(len(w) - least(len(w), 13) + 2 AS BIGINT))) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS x FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, lens WHERE len(w) >= n),
hit AS (SELECT rid, i, win.n AS n, item FROM (SELECT rid, i, n, list_slice(w, i, i + n - 1) AS x FROM dw) q JOIN win ON q.n = win.n AND q.x = win.x),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, CAST(i + n AS BIGINT))) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""

#: Integer vectors of the rows that have a label and finite components alone.
_WHOLE = """e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

OP11_SQL = f"""
WITH {_WHOLE}, r AS (SELECT id, CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, x FROM e WHERE label IS NOT NULL),
s AS (SELECT a.id AS anchor_id, a.label AS own, r.id, r.label, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score FROM r a JOIN r ON a.id <> r.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE label = own) q WHERE n <= 5),
w AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS n
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(n AS INT) AS rank, negative_id, positive_score, negative_score FROM w WHERE n <= 10
"""


def _assigned_sql(n: int) -> str:
    """CTEs: the parts p at the nearest entries of the codebook c before, and the codebook after."""
    return f"""a{n} AS (SELECT p.id, p.part, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), k := c.k)) AS best
      FROM p JOIN c{n} c USING (part) GROUP BY p.id, p.part),
m{n} AS (SELECT part, k, list(s ORDER BY pos) AS v FROM (SELECT part, best.k AS k, pos, CAST(floor(CAST(sum(CAST(v[pos] AS BIGINT)) AS DOUBLE) / count(*)) AS DOUBLE) AS s FROM a{n} JOIN p USING (id, part), (SELECT unnest([1, 2, 3, 4]) AS pos) q GROUP BY 1, 2, 3) z GROUP BY part, k),
c{n + 1} AS (SELECT part, k, coalesce(m{n}.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} USING (part, k))"""


OP12_SQL = f"""
WITH {_WHOLE}, p AS (SELECT id, label, part, list_slice(x, 4 * part + 1, 4 * part + 4) AS v FROM e, (SELECT unnest(range(16)) AS part) q),
c0 AS (SELECT part, dense_rank() OVER (ORDER BY id) - 1 AS k, v FROM p WHERE id IN (SELECT id FROM e ORDER BY id LIMIT 64)),
{_assigned_sql(0)}, {_assigned_sql(1)}, {_assigned_sql(2)},
books AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM c2),
coded AS (SELECT id AS vec_id, string_agg(printf('%02x', best.k), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY id),
sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN e ON vec_id = id GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM coded JOIN e ON vec_id = id JOIN sums ON sums.label IS NOT DISTINCT FROM e.label, books
"""

#: All pairs of a label by their cosine, and components by spreading the smallest id.
OP13_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x,
  label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.ok AND b.ok AND list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT vec_id, vec_id AS near FROM e UNION SELECT vec_id, b FROM reach JOIN links ON near = a),
least AS (SELECT vec_id, min(near) AS component_id FROM reach GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)
"""

QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_license_scan, op3_chat_formatting, op4_url_filters, op5_best_fit_packing, op6_nearest_neighbours, op7_line_dedup, op8_benchmark_decontamination, op9_language_id, op10_token_counts, op11_hard_negatives, op12_vector_codes, op13_embedding_near_dedup)}
ORACLE_SQL = {"op3_chat_formatting": OP3_SQL, "op7_line_dedup": OP7_SQL, "op8_benchmark_decontamination": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_embedding_near_dedup": OP13_SQL}
