"""The registered queries of the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopelens.llm import centroids, conversations, decontaminate, fingerprints, language, main_text, near_duplicates, near_vectors, quality, repeats, token_files, toxicity, word_bpe
from scopelens.llm.tables import crc_fold, shared_folder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_fold("doc_id", 3) == 1
    model = toxicity.fit(documents.where(~held_out), labels.where(~held_out))
    return documents.select("doc_id", held_out.alias("held_out"), toxicity.score(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.7).cast("int")
    )


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_fold("doc_id", 3) == 1
    model = quality.fit(documents.where(~held_out), labels.where(~held_out))
    return documents.select("doc_id", held_out.alias("held_out"), quality.score(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 5) == 0
    model = language.fit(documents.where(~held_out))
    found = documents.select("doc_id", held_out.alias("held_out"), language.predicted(model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    files = token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.digest(token_files.read(files, folder))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.find(documents.select("doc_id", "text"), benchmark))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op9_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    coded = table(spark, sf_dir, "documents").select("doc_id", word_bpe.coded(vocabulary).alias("coded"))
    out = coded.select("doc_id", "coded.*")
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", main_text.extracted().alias("text"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(centroids.cluster(table(spark, sf_dir, "embeddings")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_vectors": op2_near_vectors,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_token_files": op5_token_files,
    "op6_decontaminate": op6_decontaminate,
    "op7_repeats": op7_repeats,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_word_bpe": op9_word_bpe,
    "op10_main_text": op10_main_text,
    "op11_centroids": op11_centroids,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_fingerprints": op13_fingerprints,
}

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(nodes: str, links: str) -> str:
    """Tables ``links`` (a, b, both ways) and ``component`` (id, component_id) for WITH RECURSIVE."""
    return f"""
links AS ({links}),
reach AS (SELECT id, id AS other FROM ({nodes}) UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)"""


USABLE = (
    "label IS NOT NULL AND list_bool_or(list_transform(v, lambda x: x <> 0)) "
    "AND NOT list_bool_or(list_transform(v, lambda x: x IS NULL OR NOT isfinite(x)))"
)
NEAR_VECTORS = """
SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.98"""
NEAR_SETS = """
SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)"""


def _rounds(count: int) -> str:
    """Rounds of assignment and floored means, from ``c0`` (cluster, c) and ``kept`` (n, vec_id, v)."""
    out = ""
    for k in range(count + 1):
        out += f"""
a{k} AS (
    SELECT n, min(struct_pack(distance := list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, cluster := cluster)) AS best
    FROM kept, c{k} GROUP BY n),"""
        if k < count:
            out += f"""
m{k} AS (
    SELECT cluster, list(CAST(floor(total::DECIMAL(30, 6) / members) AS BIGINT) ORDER BY d) AS c
    FROM (SELECT best.cluster AS cluster, d, sum(v[d]) AS total, count(*) AS members FROM kept JOIN a{k} USING (n), range(1, 65) AS dims(d) GROUP BY 1, 2)
    GROUP BY 1),
c{k + 1} AS (SELECT cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster)),"""
    return out


#: crc32 of a column's decimal text.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: unicode(x)::UBIGINT)),
lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)::UBIGINT[]), lambda k, i: xor(k >> 1, CASE WHEN k & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))))"""
TEST_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE: dict[str, str] = {
    "op2_near_vectors": f"""
WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (SELECT * FROM vectors WHERE {USABLE}),
{_components("SELECT vec_id AS id FROM vectors", NEAR_VECTORS)}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM vectors JOIN component ON id = vec_id""",
    "op6_decontaminate": f"""
WITH item AS (SELECT item_id, regexp_extract_all({LOWER}, {TEST_WORDS}) AS w FROM benchmark WHERE text IS NOT NULL),
test AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), {TEST_WORDS}) AS w FROM documents),
place AS (
    SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS words
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM doc, (SELECT DISTINCT size FROM test) WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, place.size AS size, item_id FROM place JOIN test USING (size, words)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY 1),
found AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items
    FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op8_near_duplicates": rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
    SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM doc)
    UNION ALL SELECT doc_id, w[1] FROM doc WHERE len(w) = 1),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
{_components("SELECT doc_id AS id FROM documents", NEAR_SETS)}
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, component_id, doc.doc_id = component_id AS kept
FROM doc JOIN component ON id = doc.doc_id LEFT JOIN size USING (doc_id)""",
    "op11_centroids": f"""
WITH vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
kept AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS n, vec_id, v
    FROM (SELECT vec_id, list_transform(x, lambda y: CAST(floor(64 * y) AS BIGINT)) AS v FROM vectors
          WHERE NOT list_bool_or(list_transform(x, lambda y: y IS NULL OR NOT isfinite(y))))),
c0 AS (SELECT CAST(n AS INT) AS cluster, v AS c FROM kept WHERE n < 16),{_rounds(3)}
found AS (SELECT vec_id, best.cluster AS cluster, best.distance AS distance FROM a3 JOIN kept USING (n))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM found JOIN c3 USING (cluster)""",
    "op12_conversation_trie": f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT conv_id, list(struct_pack(role, text) ORDER BY turn NULLS FIRST, md5(concat(length(role), ':', role, text))) AS turns
    FROM said GROUP BY conv_id),
headed AS (SELECT conv_id, conv_id - conv_id % 100 AS base, turns, CAST({CRC} % 6 AS BIGINT) AS h FROM own),
rebuilt AS (
    SELECT headed.conv_id, list_concat(coalesce(own.turns[1 : h], []), headed.turns[h + 1 :]) AS s
    FROM headed LEFT JOIN own ON own.conv_id = headed.base),
prefix AS (SELECT conv_id, d, s[1 : d] AS p, len(s) AS n FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
node AS (
    SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
    FROM prefix GROUP BY d, p),
child AS (SELECT d - 1 AS d, p[1 : d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
tree AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (d, p)),
below AS (
    SELECT k AS d, p[1 : k] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT p, n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(p[d].text) ELSE 0 END AS saved, unnest(range(0, d + 1)) AS k FROM tree)
    GROUP BY 1, 2)
SELECT tree.conv_id, tree.d AS depth, up.conv_id AS parent_conv_id, tree.n_convs, tree.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, tree.ends_sha256
FROM tree JOIN below USING (d, p) LEFT JOIN node AS up ON up.d = tree.d - 1 AND up.p = tree.p[1 : tree.d - 1]""",
}
