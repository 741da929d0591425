"""The registered queries of this subpackage, by name, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.llm import (
    decontaminate,
    hard_negatives,
    html_text,
    language_model,
    mixing,
    near_join,
    pii,
    sharding,
    spelling,
    substrings,
    toxicity,
    url_filter,
    vector_join,
)

PII_KEY = "change-me-per-corpus"  # the queries' key; a user passes a secret one

QUERIES = {}
ORACLE_SQL = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(n: int) -> Column:
    """The fold of a doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def not_held_out(labels: DataFrame) -> DataFrame:
    """The labels that toxicity may learn from."""
    return labels.where(_part(3) != 1)


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs, weights=(3, 1, 2), share=1.5, most=2.0, carry_text=False).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


ORACLE_SQL["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM sources
), levels AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w,
    sum(cap) OVER filling AS caps, sum(w) OVER filling AS ws
  FROM weighed
  WINDOW filling AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), filled AS (
  SELECT *, caps + cap / w * (all_w - ws) <= budget AS is_full FROM levels
), targets AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN cap ELSE
      (budget - sum(CASE WHEN is_full THEN cap ELSE 0.0 END) OVER ()) * w / sum(CASE WHEN is_full THEN 0.0 ELSE w END) OVER ()
    END AS target,
    ('0x' || substr(md5('0:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM filled
), ranked AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS r
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), chosen AS (
  SELECT *, least(floor(r * rate + u) - floor((r - 1) * rate + u), 2)::BIGINT AS copies FROM ranked
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM chosen
"""


@query
def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document under a neural model and under token counts of the training fold."""
    held_out = F.coalesce(_part(10) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    return language_model.LanguageModel(docs.where("NOT held_out")).score(docs)


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url with its rule and verdict; examples are labelled by words in their hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = url_filter.host_and_path(F.col("_url"))
    bad = F.lit(False)
    for word in url_filter.BAD_WORDS:
        bad = bad | F.instr("_host", word).cast("boolean")
    labelled = pages.select(F.col("url").alias("_url")).withColumn("_host", host).withColumn("_bad", bad.cast("int"))
    return url_filter.UrlFilter(labelled, "_url", "_bad").judge(pages, RULES).drop("url")


@query
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, key=PII_KEY).select("doc_id", "n_entities", "text")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned from the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = not_held_out(table(spark, sf_dir, "labels"))
    return toxicity.score(docs, toxicity.fit(docs, labels), threshold=0.7).select(
        "doc_id", F.coalesce(_part(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted"
    )


@query
def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of near duplicates of the same label and their component."""
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


ORACLE_SQL["op6_near_vectors"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a
  JOIN usable b ON b.label = a.label AND b.vec_id <> a.vec_id AND len(b.v) = len(a.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), reached AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node WHERE r.root < l.b
), least AS (
  SELECT node, min(root) AS component_id FROM reached GROUP BY node
)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN least r ON r.node = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""


@query
def op7_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of shingles and the class of near copies it belongs to."""
    return near_join.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL["op7_near_join"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON b.s = a.s AND b.doc_id > a.doc_id GROUP BY 1, 2
), near AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)
), links AS (
  SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), reached AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node WHERE r.root < l.b
), least AS (
  SELECT node, min(root) AS component_id FROM reached GROUP BY node
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d JOIN least r ON r.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that its text holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "contaminated", "items"
    )


@query
def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that stand earlier in the corpus."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL["op9_remove_repeats"] = r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM worded
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM worded WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
), marked AS (
  SELECT p.doc_id, p.i, p.word, count(l.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM placed p LEFT JOIN later l ON l.doc_id = p.doc_id AND l.i = p.i
), summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s ON s.doc_id = d.doc_id
"""


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.fit(pages))


# crc32 of bytes: a table of 256 by the reflected polynomial, then one lookup a byte.
_CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM (SELECT unnest(range(256)) AS i)
  )
)"""


def _bytes_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda y: ('0x' || y)::BIGINT)"


def _crc_sql(numbers: str) -> str:
    return f"xor(list_reduce({numbers}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"


@query
def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard among 24 and its slot there, and its shard among 25."""
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)


ORACLE_SQL["op12_shards"] = f"""
WITH RECURSIVE {_CRC_TABLE}, hashed AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_bytes_sql("coalesce(text, '')")} AS b,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::HUGEINT AS k
  FROM documents
), jumps AS (
  SELECT r, n, 0::BIGINT AS here, 0::BIGINT AS "to", k FROM hashed, (VALUES (24), (25)) AS shards(n)
  UNION ALL
  SELECT r, n, "to",
    floor(("to" + 1)::DOUBLE * (2147483648::DOUBLE / (((k * 2862933555777941757 + 1) % 18446744073709551616 >> 33) + 1)::DOUBLE))::BIGINT,
    (k * 2862933555777941757 + 1) % 18446744073709551616
  FROM jumps WHERE "to" < n
), placed AS (
  SELECT r, max(here) FILTER (n = 24) AS shard, max(here) FILTER (n = 25) AS grown_shard FROM jumps GROUP BY r
), told AS (
  SELECT doc_id, len(b)::BIGINT + 8 AS size, {_crc_sql("b")} AS text_crc32, shard, grown_shard
  FROM hashed JOIN placed USING (r), crc_table
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM told
"""


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its five first positives; every seventh vector's label is moved on."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), anchor=F.col("vec_id") % 100 == 0)


ORACLE_SQL["op11_hard_negatives"] = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM usable a JOIN usable r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words' number, the form it is a variant of, and the last form."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


# Near words meet through what is left after one deletion: a replacement leaves equal rests at one place,
# and a deletion leaves the shorter word.
ORACLE_SQL["op13_spelling"] = f"""
WITH RECURSIVE {_CRC_TABLE}, found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), counted AS MATERIALIZED (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found GROUP BY ALL
), numbers AS MATERIALIZED (
  SELECT id, run, n, {_bytes_sql("id || ':' || run")} AS b FROM counted
), hashed AS (
  SELECT run, n, {_crc_sql("b")} AS h FROM numbers, crc_table
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed
), vocabulary AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), placed AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary
), rests AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM placed
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM rests a JOIN rests b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT r.word, v.word, v.n FROM rests r JOIN vocabulary v ON r.rest = v.word
  UNION
  SELECT v.word, r.word, r.n FROM rests r JOIN vocabulary v ON r.rest = v.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
), named AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form,
    CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word)
), followed AS (
  SELECT word, word AS root, form AS next FROM named
  UNION ALL
  SELECT f.word, f.next, n.form FROM followed f JOIN named n ON f.next = n.word
)
SELECT n.word, form, root, n, n_near, form_n FROM named n JOIN followed f ON n.word = f.word AND f.next IS NULL
"""
