"""The registered queries of the corpus operators, ``opN_<name>``: whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat_format, decontaminate, filter_audit, gru_lm, html_wrappers, langid, media, mixing, quality, sharding
from .jaccard_join import jaccard_join
from .shared import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_wrappers.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return gru_lm.score(docs, held_out=fold("doc_id", 10) == 0)


#: A conversation that says the template's own control strings.
FORGED = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = spark.createDataFrame(FORGED, "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_chats(turns.union(forged)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 5) == 0
    filters = langid.learn(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.predictor(spark, filters, "text").alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op5_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10)


def op8_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 4) == 2
    ranker = quality.learn(docs.where(~held_out), _table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.scorer(spark, ranker, "text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= quality.CUT, 1).otherwise(0))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), words=5, per_cent=75)


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 16)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return centroids.cluster(vectors, centroids.fit(vectors)).drop("embedding")


#: A file of public_tokenizers, installed on the driver and the executors.
TOKENIZER = "word_bpe_49k.json"


def op12_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path(TOKENIZER), decode=True)
    hexed = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return coded.select("doc_id", "n_tokens", hexed("ids").alias("ids_sha256"), hexed("decoded").alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_html_wrappers, op2_gru_lm, op3_chat_format, op4_language_id, op5_media_archive, op6_mix_sources, op7_decontaminate, op8_bradley_terry, op9_ngram_jaccard_join, op10_feistel_shards, op11_centroids, op12_bpe_chunks, op13_filter_audit)
}

#: Every occurrence of a 10-word window (or of a whole shorter item), found by joins of word lists.
_OP7 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(10, len(w)) AS n, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') for i in range(1, len(w) - least(10, len(w)) + 2)]) AS g
  FROM bw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
doc_win AS (
  SELECT doc_id, s.n, unnest(range(1, len(w) - s.n + 2)) AS i, unnest([array_to_string(w[i:i + s.n - 1], ' ') for i in range(1, len(w) - s.n + 2)]) AS g
  FROM dw, sizes s WHERE len(w) >= s.n),
hits AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM doc_win d JOIN win b ON d.n = b.n AND d.g = b.g),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: The turns in order, with the template's lengths: 4 + 2 + 8 characters a turn and its escapes.
_OP3 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(text) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

#: All pairs that share a shingle, their exact Jaccard similarity, and reachability by recursion.
_OP9 = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id
FROM w JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id
"""

def _op11() -> str:
    """Vectors and centroids as rows (id, component, value); each round an assignment and a mean."""
    rounds = []
    for n in range(4):
        if n:
            rounds.append(
                f"m{n} AS (SELECT a.k, v.i, CAST(floor(sum(v.x)::HUGEINT // count(*)) AS BIGINT) - CASE WHEN sum(v.x) < 0 AND sum(v.x)::HUGEINT % count(*) <> 0 THEN 1 ELSE 0 END AS x FROM a{n - 1} a JOIN v USING (id) GROUP BY a.k, v.i),\n"
                f"c{n} AS MATERIALIZED (SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM c{n - 1} c LEFT JOIN m{n} m ON m.k = c.k AND m.i = c.i)"
            )
        rounds.append(
            f"d{n} AS (SELECT v.id, c.k, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{n} c ON c.i = v.i GROUP BY v.id, c.k),\n"
            f"a{n} AS MATERIALIZED (SELECT id, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, k) = 1)"
        )
    return f"""
WITH e AS (
  SELECT vec_id, embedding AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([1 for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
t AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) AS id, vec_id, v FROM e),
v AS MATERIALIZED (SELECT id, unnest(range(64)) AS i, unnest([CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in v]) AS x FROM t),
c0 AS (SELECT id - 1 AS k, i, x FROM v WHERE id <= 16),
{", ".join(rounds)},
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY k)
SELECT t.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM t JOIN a3 a USING (id) JOIN h ON h.k = a.k
"""


#: Verdicts of each document, then every order's steps over the counts of verdicts.
_OP13 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM t LEFT JOIN l USING (doc_id)),
m AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
o(p) AS (SELECT '' UNION ALL SELECT p || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(p, x)),
s AS (SELECT p AS filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o WHERE len(p) = 5),
x AS (
  SELECT m.*, s.*, contains(fails, filter_order[step]) AS hit,
    fails <> '' AND len(translate(fails, substr(filter_order, 1, step - 1), '')) < len(fails) AS gone
  FROM m, s),
y AS (
  SELECT part, filter_order, step, filter_order[step] AS letter,
    sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM y
"""

ORACLES: dict[str, str] = {"op13_filter_audit": _OP13, "op11_centroids": _op11(), "op3_chat_format": _OP3, "op7_decontaminate": _OP7, "op9_ngram_jaccard_join": _OP9}
