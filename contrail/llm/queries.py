"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm import (
    decontaminate,
    html_blocks,
    jaccard_join,
    licenses,
    packing,
    prefix_trie,
    quality,
    recompression,
    spelling,
    suffix_sort,
    suffix_tree,
    weak_rules,
    winnowing,
)
from contrail.llm.common import held_out, table
from contrail.llm.registry import register
from contrail.llm.sql import CRC_TABLE, crc32


@register("op8_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    weights = quality.fit(
        docs.withColumnRenamed("doc_id", "key"),
        labels.where(~held_out(F.col("doc_id"), 5)).withColumnRenamed("doc_id", "key"),
    )
    scored = quality.score(docs, weights)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 5).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@register("op10_lm_scores")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = suffix_tree.score(docs, docs.where(~held_out(F.col("doc_id"), 10)))
    return scored.withColumn("held_out", held_out(F.col("doc_id"), 10))


@register("op7_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@register("op9_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_blocks.extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


@register("op1_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edited(table(spark, sf_dir, "documents"))


@register(
    "op2_substring_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
    win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM starts),
    f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM win JOIN f USING (h) WHERE m < doc_id),
    g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
        sha256(array_to_string(CASE WHEN gone IS NULL THEN w
            ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN g USING (doc_id)
    """,
)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.report(table(spark, sf_dir, "documents"))


@register("op3_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sort.report(table(spark, sf_dir, "documents"))


@register(
    "op6_ngram_jaccard_join",
    r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    place AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0),
    sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM place),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s)
        WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    edges AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
        WHERE 100 * c >= 90 * (p.n + q.n - c)),
    reach AS (SELECT doc_id AS node, doc_id AS root FROM d
        UNION SELECT y, root FROM reach JOIN edges ON x = node),
    least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
    FROM d LEFT JOIN n USING (doc_id) JOIN least ON node = d.doc_id
    """,
)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents")).drop("th", "root")


@register("op4_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op5_license_scan", licenses.oracle())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@register(
    "op11_spelling_variants",
    rf"""
    WITH RECURSIVE {CRC_TABLE},
    runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
    low AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
        FROM runs WHERE length(r) >= 5 GROUP BY ALL),
    h AS (SELECT r, n, {crc32("coalesce(doc_id::VARCHAR, 'null') || ':' || r")} AS h FROM low, crc_table),
    w AS (SELECT CASE WHEN h % 97 = 0 THEN r[1:(h % length(r))::BIGINT] || r[(h % length(r))::BIGINT + 2:] ELSE r END AS word, n FROM h),
    v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    cut AS (SELECT DISTINCT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
    pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
        UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
    form AS (SELECT word, n_near, CASE WHEN b.m >= 2 * min(p.n) THEN min(encode(other)) FILTER (p.m = b.m) END AS form,
        CASE WHEN b.m >= 2 * min(p.n) THEN b.m END AS form_n FROM pairs p JOIN best b USING (word) GROUP BY word, n_near, b.m),
    all_forms AS (SELECT v.word, decode(form) AS form, v.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n FROM v LEFT JOIN form USING (word)),
    chain AS (SELECT word, word AS at FROM all_forms UNION ALL
        SELECT c.word, f.form FROM chain c JOIN all_forms f ON f.word = c.at WHERE f.form IS NOT NULL)
    SELECT a.word, a.form, c.at AS root, a.n, a.n_near, a.form_n FROM all_forms a JOIN chain c ON c.word = a.word
    JOIN all_forms e ON e.word = c.at AND e.form IS NULL
    """,
)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), slips=97))


@register("op12_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.filtered(table(spark, sf_dir, "documents"))


@register(
    "op13_conversation_prefix_trie",
    rf"""
    WITH {CRC_TABLE},
    o AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS k,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, n, {crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id), crc_table),
    g AS (SELECT c.conv_id, c.n, c.h, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
    rb AS (SELECT g.conv_id, pos, k, words FROM g JOIN o ON o.conv_id = g.conv_id - g.conv_id % 20 AND pos <= taken
        UNION ALL SELECT g.conv_id, pos - h + taken, k, words FROM g JOIN o USING (conv_id) WHERE pos > h),
    path AS (SELECT conv_id, 0 AS depth, '' AS key, 0 AS words FROM g
        UNION ALL SELECT conv_id, pos, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos), words FROM rb),
    size AS (SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id),
    ended AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM path JOIN size USING (conv_id, depth) GROUP BY key),
    node AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM path GROUP BY key, depth),
    kids AS (SELECT left(key, 32 * (depth - 1)::BIGINT) AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
    own AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (key)),
    up AS (SELECT left(key, 32 * unnest(range(0, depth::BIGINT + 1))) AS key, n_children = 0 AS leaf, (n_convs - 1) * words AS saved FROM own),
    total AS (SELECT key, sum(leaf::BIGINT) AS n_leaves, sum(saved) AS saved FROM up GROUP BY key)
    SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children::BIGINT AS n_children,
        n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM own o JOIN total USING (key) LEFT JOIN ended USING (key) LEFT JOIN node p ON o.depth > 0 AND p.key = left(o.key, 32 * (o.depth - 1)::BIGINT)
    """,
)
def conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))
