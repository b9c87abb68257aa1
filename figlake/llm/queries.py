"""The queries of the corpus operators and, where SQL expresses them, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figlake.llm import bitslice, bpe, chosen_path, decontam, html_extract, line_dedup, quality, recompress, shard, token_count
from figlake.llm.common import table


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path("byte_bpe_50k.tiktoken")
    both = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


SHARDS = 40


def op3_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    tree = shard.tree_of(SHARDS)
    placed = shard.draw(shard.draw(rows, "doc_id", tree, "shard"), "doc_id", shard.grown(tree, SHARDS), "grown_shard")
    return shard.slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_bit_sliced_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(table(spark, sf_dir, "embeddings"))


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = recompress.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    plain = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))  # texts without repeats come back as they were
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.when(F.col("n_removed") > 0, text).otherwise(plain).cast("binary"), 256).alias("kept_sha256"))


LIMIT = 4096


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", vocabulary_path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


#: Of a document to be kept.
LEAST_SCORE = 0.3


def _remainder(key):
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the score; learns from labelled rows that are not held out."""
    model = quality.fit(documents, labels, usable=lambda key: _remainder(key) != 0)
    return quality.score(documents, model)


def op7_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (_remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chosen_path.with_groups(docs).select("doc_id", F.col("group_id").alias("class_id"), "n_links")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_dedup.dedup_lines(docs)
    return left.select(
        "doc_id",
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_site_templates, op2_byte_bpe, op3_hash_tree_shards, op4_bit_sliced_top10, op5_recompression, op6_token_counts, op7_random_indexing, op8_winnowing, op9_chosen_path, op10_line_dedup)
}

#: Where SQL can say what an operator returns, and does so in seconds on the table it is checked on.
ORACLE_SQL: dict[str, str] = {
    "op4_bit_sliced_top10": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op5_recompression": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op8_winnowing": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, m, w[s : s + m - 1] AS win FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM (SELECT *, least(10, len(w)) AS m FROM i WHERE len(w) > 0))),
        own AS (SELECT doc_id, s, m, w[s : s + m - 1] AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d JOIN (SELECT DISTINCT m FROM windows) ON len(w) >= m)),
        hit AS (SELECT doc_id, s, own.m, item_id FROM own JOIN windows ON own.m = windows.m AND own.win = windows.win),
        n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)""",
    "op9_chosen_path": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        half AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
        links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM d""",
    # equal sets by their first line; then the pairs of these that share a word of their rarest, m - ceil(0.8 m) + 1 of each
    "op10_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL),
        s AS (SELECT *, row_number() OVER (ORDER BY doc_id, k) AS n, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS w FROM l),
        u AS (SELECT w, len(w) AS m, min(n) AS n FROM s WHERE len(w) > 0 GROUP BY w),
        t AS (SELECT n, m, unnest(w) AS x FROM u),
        r AS (SELECT n, m, x, row_number() OVER (PARTITION BY n ORDER BY c, x) AS p FROM t JOIN (SELECT x, count(*) AS c FROM t GROUP BY x) USING (x)),
        prefix AS (SELECT n, m, x FROM r WHERE p <= m - (4 * m + 4) // 5 + 1),
        pairs AS (SELECT DISTINCT a.n AS a, b.n AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.n < b.n AND 5 * least(a.m, b.m) >= 4 * greatest(a.m, b.m)),
        near AS (SELECT DISTINCT b AS n FROM pairs JOIN u x ON x.n = a JOIN u y ON y.n = b WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.m + y.m)),
        marked AS (SELECT s.doc_id, s.k, s.line, len(s.w) > 0 AND (s.n <> u.n OR s.n IN (SELECT n FROM near)) AS gone FROM s LEFT JOIN u USING (w)),
        d AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (gone), '') AS removed_lines, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id)
        SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents LEFT JOIN d USING (doc_id)""",
}
