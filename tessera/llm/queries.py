"""One query opN_<name> per operator, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, html, langid, lines, mixing, phrases, secrets, simhash, topk
from tessera.llm.common import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_additive_quantisation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_line_alignment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_common_lines(docs).select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op5_prefix_free_parsing_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return phrases.remove_repeats(docs, length=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, RANKS, PATTERN).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("secrets", lambda x: x["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op7_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rates, domains, reached, wanted = mixing.fitted(docs, table(spark, sf_dir, "labels"))
    listed = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<double>")
    return rates.withColumns({"domains": F.array(*[F.lit(d) for d in domains]).cast("array<string>"), "reached": listed(reached), "wanted": listed(wanted)})


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model, score_out="score")
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), RANKS, PATTERN, ids=False, digests=True)


def op10_impact_ordered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_html_main_text, op3_additive_quantisation_ann, op4_line_alignment_dedup,
    op5_prefix_free_parsing_dedup, op6_secret_scan, op7_soft_membership_mixing, op8_language_id, op9_byte_bpe, op10_impact_ordered_topk,
)}

ORACLE = {
    "op5_prefix_free_parsing_dedup": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
        ), w AS (
            SELECT doc_id, 512 * c + o AS s, md5_number(substr(piece, 2 * o + 1, 200)) AS k
            FROM (SELECT doc_id, c, piece, unnest(range(0, least(512, n - 99 - 512 * c))) AS o
                  FROM (SELECT doc_id, n, c, substr(h, 1024 * c + 1, 1222) AS piece FROM (SELECT doc_id, h, n, unnest(range(0, (n + 412) // 512)) AS c FROM d)))
        ), f AS (
            SELECT k, min(doc_id * 4294967296 + s) AS first FROM w GROUP BY k
        ), r AS (
            SELECT doc_id, s FROM w JOIN f USING (k) WHERE doc_id * 4294967296 + s > first
        ), i AS (
            SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run
            FROM (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS new FROM r)
        ), g AS (
            SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, run
        ), p AS (
            SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM g
            UNION ALL SELECT d.doc_id, coalesce(max(g.b), 0), any_value(d.n) FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
        ), kept AS (
            SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x))) AS kept_sha256 FROM p JOIN d USING (doc_id) GROUP BY doc_id
        ), t AS (
            SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM g GROUP BY doc_id
        )
        SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
        FROM d JOIN kept USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op4_line_alignment_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
        ), c AS (
            SELECT doc_id, i, line, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS hi, hi - length(line) AS lo FROM l
        ), w AS (
            SELECT a.doc_id, a.i AS s, b.i AS e
            FROM c a ASOF JOIN (SELECT doc_id, i, hi * 4194304 + i AS k FROM c) b ON a.doc_id = b.doc_id AND (a.lo + 100) * 4194304 <= b.k
            UNION
            SELECT b.doc_id, a.i, b.i
            FROM (SELECT doc_id, i, (hi - 100) * 4194304 + 4194303 AS k FROM c) b ASOF JOIN (SELECT doc_id, i, lo * 4194304 + i AS k FROM c) a ON a.doc_id = b.doc_id AND b.k >= a.k
        ), t AS (
            SELECT w.doc_id, s, e, md5(array_to_string(list_slice(string_split(coalesce(d.text, ''), chr(10)), s, e), chr(10))) AS run FROM w JOIN documents d USING (doc_id)
        ), f AS (
            SELECT doc_id, s, e FROM (SELECT *, min(doc_id) OVER (PARTITION BY run) AS first FROM t) WHERE doc_id > first
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM f
        ), kept AS (
            SELECT c.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY c.i) FILTER (WHERE gone.i IS NULL), '') AS left_over
            FROM c LEFT JOIN gone ON c.doc_id = gone.doc_id AND c.i = gone.i GROUP BY c.doc_id
        )
        SELECT d.doc_id, n_lines, n_removed, CASE WHEN d.text IS NOT NULL THEN length(left_over) END AS n_chars, CASE WHEN d.text IS NOT NULL THEN sha256(left_over) END AS kept_sha256
        FROM documents d JOIN kept USING (doc_id)
    """,
    # Learns from all labelled rows, as the operator does up to its bound of 4,000 a language.
    "op8_language_id": """
        WITH tab AS (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))
        ), d AS (
            SELECT doc_id, lower(text) AS t, lang, text IS NOT NULL AND regexp_matches(text, '\\p{L}') AS spoken, coalesce(xor(list_reduce(
                list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda c, b: xor(tab.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 4 = 2, false) AS held_out
            FROM documents, tab
        ), ch AS (
            SELECT doc_id, unnest(list_transform(string_split(t, ''), lambda x: CAST(unicode(x) AS UBIGINT))) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM d WHERE t <> ''
        ), c3 AS (
            SELECT doc_id, c AS a, lead(c) OVER w AS b, lead(c, 2) OVER w AS c FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)
        ), h AS (
            SELECT doc_id, a + 1013904242 AS h FROM c3
            UNION ALL SELECT doc_id, (a * 16777619 + b) % 4294967296 + 2027808484 FROM c3 WHERE b IS NOT NULL
            UNION ALL SELECT doc_id, ((a * 16777619 + b) % 4294967296 * 16777619 + c) % 4294967296 + 3041712726 FROM c3 WHERE c IS NOT NULL
        ), m AS (
            SELECT doc_id, h % 4294967296 * CAST(2654435761 AS UBIGINT) % 4294967296 AS m FROM h
        ), n AS (
            SELECT doc_id, xor(m, m >> 15) & 32767 AS bucket, count(*) AS n FROM m GROUP BY ALL
        ), learned AS (
            SELECT doc_id, lang FROM d WHERE NOT held_out AND t IS NOT NULL AND lang IS NOT NULL
        ), seen AS (
            SELECT lang, bucket, ln(1 + sum(n)) AS gain FROM n JOIN learned USING (doc_id) GROUP BY lang, bucket
        ), size AS (
            SELECT lang, ln(count(DISTINCT doc_id) / CAST((SELECT count(*) FROM learned) AS DOUBLE)) AS prior, ln(32768 + coalesce(sum(n), 0)) AS lost FROM learned LEFT JOIN n USING (doc_id) GROUP BY lang
        ), long AS (
            SELECT doc_id, sum(n) AS grams FROM n GROUP BY doc_id
        ), gains AS (
            SELECT doc_id, lang, sum(n * gain) AS gain FROM n JOIN seen USING (bucket) GROUP BY doc_id, lang
        ), total AS (
            SELECT d.doc_id, size.lang, size.prior + coalesce(gains.gain, 0) - long.grams * size.lost AS z
            FROM d JOIN long USING (doc_id) CROSS JOIN size LEFT JOIN gains ON gains.doc_id = d.doc_id AND gains.lang = size.lang WHERE d.spoken
        ), best AS (
            SELECT doc_id, arg_max(lang, z) AS lang_pred, list(z) AS zs, max(z) AS top FROM (SELECT * FROM total ORDER BY doc_id, lang) GROUP BY doc_id
        )
        SELECT d.doc_id, d.held_out, coalesce(lang_pred, 'und') AS lang_pred,
            CASE WHEN lang_pred IS NULL THEN 0e0 ELSE round(1e0 / list_sum(list_transform(zs, lambda z: exp(z - top))), 6) END AS score
        FROM d LEFT JOIN best USING (doc_id)
    """,
    "op10_impact_ordered_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
