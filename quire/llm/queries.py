"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import ann_forest, bpe_tree, centroids, decontamination, jaccard, kd_search, line_dedup, lm, mixing, prefix_trie, quality, token_counts, warc
from quire.llm.shared import table

#: Seed of the mix, its weights in the order of sources, and files of the public tokenizers.
MIX_SEED, MIX_WEIGHTS = 11, [1, 2, 3]
#: Clusters, rounds, seed, and what vectors are scaled by.
CLUSTERS, ROUNDS, CLUSTER_SEED, CLUSTER_SCALE = 40, 5, 2, 256
BYTE_BPE, WORD_BPE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, "doc_id", "text", quality.fit(docs, "text"))


def op2_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=20, k=20)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.digests(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer(BYTE_BPE), pattern())


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    mixed, _ = mixing.mix(docs, F.array("source"), "doc_id", F.col("size"), MIX_WEIGHTS, MIX_SEED)
    return mixed.select("__row.doc_id", "__row.size", "source_size", "target", (F.col("__row.size") * F.col("times")).alias("taken"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), "page_id", "html", "url")


def op6_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=100, k=10)


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), "doc_id", "text", k=3, num=90, den=100).drop("key")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "text")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer(WORD_BPE))


def op11_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def op13_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, CLUSTER_SCALE, CLUSTERS, CLUSTER_SEED, ROUNDS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_hash_prefix_forest, op3_byte_bpe, op4_source_mix, op5_warc, op6_kd_top_k, op7_maxent_lm, op8_ngram_jaccard, op9_line_dedup, op10_token_counts,
        op11_suffix_decontamination, op12_prefix_trie, op13_hamerly_clusters,
    )
}


def _clusters_sql() -> str:
    """One pair of steps for each round: the nearest centroid of each vector, and the centroids after it."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
        a{r} AS (
            SELECT k, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
            FROM (SELECT v.k, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) AS d FROM v, c{r} c) GROUP BY k)""")
        if r < ROUNDS:
            steps.append(f"""
        s{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM v JOIN a{r} USING (k)) GROUP BY cluster, i),
        c{r + 1} AS (
            SELECT c.cluster, coalesce(m.v, c.v) AS v
            FROM c{r} c LEFT JOIN (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY cluster) m USING (cluster))""")
    return ",".join(steps)


ORACLE_SQL: dict[str, str] = {
    "op4_source_mix": rf"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, [1, 2, 3][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS w
            FROM d GROUP BY source),
        c AS (
            SELECT *, row_number() OVER (ORDER BY (3 * source_size)::DOUBLE / w, source COLLATE "C" NULLS LAST) AS i FROM s),
        l AS (
            SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
                      / (sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM c),
        t AS (
            SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce((SELECT arg_min(level, i) FROM l WHERE 3 * source_size > level * w), 1e300) * w) AS target FROM l),
        p AS (
            SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END AS passes FROM t),
        r AS (SELECT *, CASE WHEN passes < 3 THEN target - passes * source_size ELSE 0 END AS rest FROM p),
        h AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
        u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM h)
        SELECT d.doc_id, d.size, r.source_size, r.target,
               (d.size * (r.passes + CASE WHEN r.rest > 0 AND 2 * u.upto - u.size <= 2 * r.rest THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.h = u.h
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM f
    """,
    "op6_kd_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.k, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.k <> c.k),
        r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op8_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (
            SELECT DISTINCT k, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM w),
        n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
        p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.k < b.k GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        m AS (SELECT r.a AS k, min(w.doc_id) AS least FROM r JOIN w ON w.k = r.b GROUP BY r.a)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(w.doc_id, m.least), w.doc_id) AS component_id FROM w LEFT JOIN n ON n.k = w.k LEFT JOIN m ON m.k = w.k
    """,
    "op9_line_dedup": f"""
        WITH l AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
        c AS (SELECT DISTINCT source, text FROM documents),
        p AS (SELECT source, count(*) AS pages FROM c GROUP BY source),
        x AS (SELECT DISTINCT source, text, trim(u.line) AS line FROM c, unnest(string_split(text, chr(10))) AS u(line) WHERE trim(u.line) <> ''),
        n AS (SELECT source, line, count(*) AS n FROM x GROUP BY source, line),
        b AS (
            SELECT n.source, list(n.line) AS bad FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source
            WHERE n >= {line_dedup.LEAST_WITH_LINE} AND n > pages * {line_dedup.RATIO}::DOUBLE GROUP BY n.source),
        o AS (SELECT l.*, list_filter(lines, lambda y: trim(y) = '' OR NOT list_contains(coalesce(bad, []), trim(y))) AS kept FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
               coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped
        FROM o
    """,
    "op11_suffix_decontamination": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        g AS (
            SELECT DISTINCT item_id, least(len(w), {decontamination.WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {decontamination.WINDOW}) - 1], ' ') AS gram
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {decontamination.WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        o AS (
            SELECT k, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS gram
            FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n) s),
        m AS (SELECT o.k, o.i, o.n, g.item_id FROM o JOIN g ON o.n = g.n AND o.gram = g.gram),
        h AS (SELECT k, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT k, i, n FROM m)) GROUP BY k),
        t AS (SELECT k, count(*)::BIGINT AS n_items, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR), '') AS items FROM (SELECT DISTINCT k, item_id FROM m) GROUP BY k)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k)
    """,
    "op12_prefix_trie": """
        WITH o AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p,
                   md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS chars
            FROM conversations WHERE conv_id IS NOT NULL),
        h AS (
            SELECT c, c - c % 100 AS b,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ord((c::VARCHAR)[i])::BIGINT)),
                                   lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 6 AS h
            FROM (SELECT DISTINCT c FROM o)),
        r AS (
            SELECT h.c, 0 AS part, o.p, o.x, o.chars FROM h JOIN o ON o.c = h.b AND o.p < h.h
            UNION ALL
            SELECT h.c, 1, o.p, o.x, o.chars FROM h JOIN o ON o.c = h.c AND o.p >= h.h),
        s AS (SELECT h.c, coalesce(list(x ORDER BY part, p) FILTER (x IS NOT NULL), []) AS xs, coalesce(list(chars ORDER BY part, p) FILTER (x IS NOT NULL), []) AS cs FROM h LEFT JOIN r USING (c) GROUP BY h.c),
        m AS (SELECT c, len(xs) AS l, depth, array_to_string(xs[1 : depth], ',') AS key, array_to_string(xs[1 : depth - 1], ',') AS up, CASE WHEN depth > 0 THEN cs[depth] ELSE 0 END AS chars FROM (SELECT *, unnest(range(len(xs) + 1)) AS depth FROM s)),
        n AS (
            SELECT depth, key, min(up) AS up, min(c) AS conv_id, count(*)::BIGINT AS n_convs, max(chars) AS chars, max(l) > depth AS inner_node,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (l = depth), '')) AS ends_sha256
            FROM m GROUP BY depth, key),
        k AS (SELECT depth - 1 AS depth, up AS key, count(*)::BIGINT AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
        f AS (
            SELECT m.depth, m.key, sum((NOT n.inner_node)::INTEGER)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
            FROM n JOIN m ON m.c = n.conv_id AND m.depth <= n.depth GROUP BY 1, 2)
        SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, f.n_leaves, f.saved_tokens, n.ends_sha256
        FROM n JOIN f ON f.depth = n.depth AND f.key = n.key LEFT JOIN k ON k.depth = n.depth AND k.key = n.key LEFT JOIN n u ON u.depth = n.depth - 1 AND u.key = n.up AND n.depth > 0
    """,
    "op13_hamerly_clusters": f"""
        WITH v AS (
            SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor({CLUSTER_SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS (
            SELECT (row_number() OVER (ORDER BY sha256('{CLUSTER_SEED}:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS cluster, v FROM v
            QUALIFY row_number() OVER (ORDER BY sha256('{CLUSTER_SEED}:' || vec_id) NULLS LAST, v) <= {CLUSTERS}),{_clusters_sql()}
        SELECT vec_id, a.cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM v JOIN a{ROUNDS} a USING (k) JOIN c{ROUNDS} c ON c.cluster = a.cluster
    """,
}
