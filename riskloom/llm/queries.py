"""The operators over the whole given tables, with production parameters, and their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    bond, ctw, decontam, jaccard, langid, lines, pieces, repair, shards, suffix, urls, vectors, warc,
)

SHARDS = [1.0] * 8
#: A line on so many sites is boilerplate.
SITES = 10
#: Whole texts travel to Python in batches of so many rows, which bounds the memory beside the heap.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.identify(docs, model).select(
        "doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"), F.col("language.bits_per_byte").alias("bits_per_byte"))


def tokenizer() -> bytes:
    return pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, tokenizer()).select("doc_id", "tokens.*")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return lines.remove_shared_lines(docs, threshold=SITES).select(
        "doc_id", F.col("cleaned.n_lines").alias("n_lines"), F.col("cleaned.n_removed").alias("n_removed"),
        F.md5("cleaned.text").alias("kept_md5"))


OP3_SQL = f"""
WITH bad AS (
  SELECT list(line) AS bad FROM (
    SELECT trim(line, ' ') AS line FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {SITES})
), cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines, coalesce(bad, []::VARCHAR[]) AS bad FROM documents, bad
), counted AS (
  SELECT *, len(list_filter(lines, lambda x: trim(x, ' ') <> '' AND list_contains(bad, trim(x, ' ')))) AS gone,
         len(list_filter(lines, lambda x: trim(x, ' ') <> '')) AS filled,
         count(*) OVER (PARTITION BY md5(text)) > 1 AS copied FROM cut
)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines,
       CASE WHEN gone = filled AND copied THEN 0 ELSE coalesce(gone, 0) END::BIGINT AS n_removed,
       md5(CASE WHEN gone = filled AND copied THEN text ELSE array_to_string(list_filter(lines,
           lambda x: trim(x, ' ') = '' OR NOT list_contains(bad, trim(x, ' '))), chr(10)) END) AS kept_md5
FROM counted
"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeats(docs).select(
        "doc_id", "kept.n_bytes", "kept.n_removed", "kept.n_spans", "kept.kept_sha256")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", F.col("hits.n_words").alias("n_words"), F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, w, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins))
), hits AS (
  SELECT doc_id, item_id, p.i, p.n FROM places p JOIN wins USING (n, win)
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hits)
  GROUP BY 1
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY 1
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1),
         lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM d WHERE len(w) > 0
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id
       AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, pairs.v FROM reach JOIN pairs ON reach.v = pairs.u
)
SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, component_id
FROM documents JOIN (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY 1) USING (doc_id)
     LEFT JOIN s USING (doc_id)
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def base32_sql(hexed: str) -> str:
    """20 bytes in hex as base-32 text: 8 characters for each 5 bytes."""
    part = "('0x' || substr({h}, {at}, 10))::BIGINT"
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    return " || ".join(
        f"substr({letters}, (({part.format(h=hexed, at=10 * i + 1)} >> {5 * (7 - j)}) & 31)::INT + 1, 1)"
        for i in range(4) for j in range(8))


OP7_SQL = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
last AS (SELECT h, max(page_id) AS m FROM p GROUP BY 1)
SELECT page_id, payload_bytes, {base32_sql('h')} AS payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> m THEN m END AS refers_to
FROM p JOIN last USING (h)
"""


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries of three lists, derived from the hosts of the pages.

    A hash of the name stands for the dates: names enter, some leave, and some of those come back.
    """
    hosts = pages.select(urls.host_of(F.col("url")).alias("value")).where("value IS NOT NULL").distinct()
    labels = F.split("value", r"\.")
    domains = hosts.select(F.explode(F.array(
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), "."))).alias("value")).distinct()
    named = hosts.select(F.lit("spam").alias("list"), F.lit("host").alias("kind"), "value").union(
        domains.select(F.lit("parked"), F.lit("domain"), "value")).union(
        hosts.select(F.lit("malware"), F.lit("host"), "value"))
    number = F.conv(F.substring(F.md5(F.concat("list", "value")), 1, 8), 16, 10).cast("long")
    drawn = named.withColumn("h", number).where("h % 3 < 2").withColumn(
        "start", F.to_date(F.lit("2024-01-01")) + (F.col("h") % 300).cast("int"))
    return drawn.select("list", "kind", "value", F.explode(F.array(
        F.struct(F.col("start").alias("day"), F.lit("add").alias("action")),
        F.struct((F.col("start") + (F.col("h") % 40 + 5).cast("int")).alias("day"),
                 F.when(F.col("h") % 2 == 0, "remove").otherwise("add").alias("action")),
        F.struct((F.col("start") + (F.col("h") % 50 + 60).cast("int")).alias("day"),
                 F.when(F.col("h") % 5 == 0, "remove").otherwise("add").alias("action")),
    )).alias("e")).select("list", "kind", "value", "e.day", "e.action")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn(
        "fetched", F.to_date(F.lit("2024-01-01")) + (F.col("page_id") % 365).cast("int"))
    return urls.judge(pages, urls.validity(list_entries(pages))).select(
        "page_id", "fetched", "filter.host", "filter.blocked", "filter.lists", "filter.since")


OP8_SQL = rf"""
WITH p AS (
  SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '{urls.HOST}', 1)), '.'), '') AS host,
         DATE '2024-01-01' + (page_id % 365)::INT AS fetched FROM pages
), hosts AS (SELECT DISTINCT host AS value FROM p WHERE host IS NOT NULL
), parts AS (SELECT string_split(value, '.') AS s FROM hosts
), domains AS (
  SELECT DISTINCT unnest([array_to_string(s[greatest(len(s) - 1, 1):len(s)], '.'),
                          array_to_string(s[greatest(len(s) - 2, 1):len(s)], '.')]) AS value FROM parts
), named AS (
  SELECT 'spam' AS list, 'host' AS kind, value FROM hosts UNION ALL
  SELECT 'parked', 'domain', value FROM domains UNION ALL SELECT 'malware', 'host', value FROM hosts
), drawn AS (
  SELECT *, DATE '2024-01-01' + (h % 300)::INT AS start
  FROM (SELECT *, ('0x' || substr(md5(list || value), 1, 8))::BIGINT AS h FROM named) WHERE h % 3 < 2
), entries AS (
  SELECT list, kind, value, start AS day, 'add' AS action FROM drawn UNION ALL
  SELECT list, kind, value, start + (h % 40 + 5)::INT, CASE WHEN h % 2 = 0 THEN 'remove' ELSE 'add' END FROM drawn UNION ALL
  SELECT list, kind, value, start + (h % 50 + 60)::INT, CASE WHEN h % 5 = 0 THEN 'remove' ELSE 'add' END FROM drawn
), daily AS (SELECT list, kind, value, day, max(action) AS action FROM entries GROUP BY ALL
), valid AS (
  SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, kind, value ORDER BY day) AS until FROM daily)
  WHERE action = 'add'
), found AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, min(day) AS since
  FROM p JOIN valid ON fetched >= day AND (until IS NULL OR fetched < until)
       AND CASE kind WHEN 'host' THEN host = value ELSE host = value OR ends_with(host, '.' || value) END
  GROUP BY 1
)
SELECT page_id, fetched, host, lists IS NOT NULL AS blocked, coalesce(lists, '') AS lists, since
FROM p LEFT JOIN found USING (page_id)
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards.placed(docs, SHARDS, [*SHARDS, 1.0])


def shard_sql(count: int) -> str:
    draws = ", ".join(
        f"{{'cost': -ln((('0x' || substr(md5(doc_id::VARCHAR || '/{i}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0),"
        f" 'shard': {i}}}" for i in range(count))
    return f"list_sort([{draws}])[1].shard"


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id
       AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION SELECT reach.u, pairs.v FROM reach JOIN pairs ON reach.v = pairs.u
), smallest AS (SELECT u, min(v) AS component_id FROM reach GROUP BY 1
), counts AS (SELECT u, count(*) AS n_links FROM pairs GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN smallest s ON e.vec_id = s.u LEFT JOIN counts c ON e.vec_id = c.u
"""


# CRC-32 from its rule: a table of 256 entries by eight shifts each, then one step for each byte.
OP9_SQL = f"""
WITH table_ AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
              ORDER BY i) AS t FROM range(256) r(i)
), d AS (
  SELECT doc_id, {shard_sql(8)} AS shard, {shard_sql(9)} AS grown_shard,
         strlen(coalesce(text, '')) + 1 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                        lambda b: ('0x' || b)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM documents, table_
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id || '/' || text_crc32 || '/' || size)) - 1 AS slot,
       grown_shard FROM d
"""


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tenth = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    return ctw.language_model_scores(docs, tenth != 0).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage that a checksum of conversation and turn decides: one in 20 of each of five kinds."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.where("kind <> 0").withColumn("copy", F.explode(copies)).drop("kind", "copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations")
    return repair.repair(damaged(told), ids=told)[0]


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "embeddings").where(
        "label IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('Infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = known.select("vec_id", label.alias("label"), F.transform(
        "embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    return bond.hard_negatives(whole, F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_warc": op7_warc,
    "op8_url_filters": op8_url_filters,
    "op9_sharding": op9_sharding,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op3_line_dedup": OP3_SQL,
    "op5_decontaminate": OP5_SQL,
    "op6_ngram_jaccard": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op8_url_filters": OP8_SQL,
    "op9_sharding": OP9_SQL,
    "op10_embedding_near_dedup": OP10_SQL,
    "op13_hard_negatives": OP13_SQL,
}
