"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontamination, jaccard_join, language_id, licences, piece_tokens, pii, rolling, sharding, substring_dedup, suffixes, tool_calls, topk, vector_codes


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.ngram_jaccard_join(_read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_language_id(spark, sf_dir):
    return language_id.identify_language(_read(spark, sf_dir, "documents"))


def op3_chat_formatting(spark, sf_dir):
    return tool_calls.link_tool_calls(_read(spark, sf_dir, "conversations"), tool_calls.SCHEMAS, turns_are_calls=True)


def op4_sentencepiece(spark, sf_dir):
    return piece_tokens.encode_documents(_read(spark, sf_dir, "documents"))


def op5_exact_top_k(spark, sf_dir):
    return topk.exact_top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeated_passages(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_decontamination(spark, sf_dir):
    return decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_sharding(spark, sf_dir):
    return sharding.assign_shards(_read(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.find_personal_data(_read(spark, sf_dir, "documents"))


def op10_licence_scans(spark, sf_dir):
    return licences.scan_licences(_read(spark, sf_dir, "documents")).withColumn("families", F.array_join("families", ","))


def op11_suffix_array_dedup(spark, sf_dir):
    return suffixes.remove_repeated_bytes(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_rolling_window_features(spark, sf_dir):
    return rolling.rolling_window_features(_read(spark, sf_dir, "documents"))


def op13_vector_code_compression(spark, sf_dir):
    return vector_codes.compress_vectors(_read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_language_id, op3_chat_formatting, op4_sentencepiece, op5_exact_top_k, op6_substring_dedup, op7_decontamination, op8_sharding, op9_pii, op10_licence_scans, op11_suffix_array_dedup, op12_rolling_window_features, op13_vector_code_compression)}

def _codes_sql(rounds: int = 4) -> str:
    """Rounds of assignment and floored means, written out."""
    nearest = lambda k: f"""near{k} AS (SELECT p.vec_id, p.part, arg_min(c.entry, (d.d, c.entry)) AS entry, min(d.d) AS d FROM parts p JOIN book{k} c USING (part), LATERAL (SELECT list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d) AS d GROUP BY p.vec_id, p.part)"""
    moved = lambda k: f"""flat{k} AS (SELECT part, entry, j, floor(sum(v)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT n.part, n.entry, unnest(range(len(p.x))) AS j, unnest(p.x) AS v FROM near{k} n JOIN parts p USING (vec_id, part)) GROUP BY part, entry, j),
        mean{k} AS (SELECT part, entry, list(m ORDER BY j) AS x FROM flat{k} GROUP BY part, entry),
        book{k + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))"""  # noqa: E731
    return f"""
        WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT vec_id, part::INTEGER AS part, e[part * (len(e) // 4) + 1:(part + 1) * (len(e) // 4)] AS x FROM v, range(4) AS r(part)),
        first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 256),
        book0 AS MATERIALIZED (SELECT part, entry, x FROM parts JOIN first USING (vec_id)),
        {", ".join(f"{nearest(k)}, {moved(k)}" for k in range(rounds))}, {nearest(rounds)},
        codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
        digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN v USING (vec_id), digest"""


_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
        l AS (SELECT u AS doc_id, count(*) AS l FROM e GROUP BY u),
        r(doc_id, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.v, r.m FROM r JOIN e ON e.u = r.doc_id)
        SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(r.m), w.doc_id) AS component_id, coalesce(any_value(l.l), 0)::BIGINT AS n_links
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id) GROUP BY w.doc_id""",
    "op5_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 10""",
    "op6_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
                FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
        least AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN least USING (k) CROSS JOIN range(13) AS t(j) WHERE d < doc_id),
        word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    # splitmix64 of the id, the jump loop in integers of 128 bits, and the CRC by a table that a rule gives
    "op8_sharding": r"""
        WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda v, n: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i) ORDER BY i) AS t FROM range(256) AS r(i)),
        d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
                     list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
        c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda v, x: xor(v // 256, t[xor(v % 256, x) + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, crc),
        m0 AS (SELECT *, ((CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END + 11400714819323198485) % 18446744073709551616)::UBIGINT AS x FROM c),
        m1 AS (SELECT * REPLACE ((xor(x, x >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS x) FROM m0),
        m2 AS (SELECT * REPLACE ((xor(x, x >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS x) FROM m1),
        keyed AS (SELECT doc_id, size, text_crc32, xor(x, x >> 31) AS k FROM m2),
        j AS (SELECT DISTINCT k, k AS state, 0::BIGINT AS shard, 0::BIGINT AS ahead FROM keyed
              UNION ALL
              SELECT k, moved, ahead, trunc((ahead + 1)::DOUBLE * (2147483648::DOUBLE / ((moved >> 33)::DOUBLE + 1)))::BIGINT
              FROM (SELECT k, ahead, ((state::UHUGEINT * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS moved FROM j WHERE ahead < 17)),
        s AS (SELECT k, max(shard) FILTER (WHERE shard < 16)::INTEGER AS shard, max(shard) FILTER (WHERE shard < 17)::INTEGER AS grown_shard FROM j GROUP BY k),
        b0 AS (SELECT *, xor(k, (text_crc32::UHUGEINT * 131072::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT) AS x FROM keyed),
        b1 AS (SELECT * REPLACE ((xor(x, x >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS x) FROM b0),
        b2 AS (SELECT * REPLACE ((xor(x, x >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS x) FROM b1)
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY xor(x, x >> 31) % 2048, doc_id, text_crc32, size) - 1 AS slot, grown_shard
        FROM b2 JOIN s USING (k)""",
    "op12_rolling_window_features": r"""
        WITH crc AS (SELECT list(list_reduce(range(8), lambda v, n: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i) ORDER BY i) AS t FROM range(256) AS r(i)),
        h AS (SELECT doc_id, source, lang, length(text) AS n, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda v, x: xor(v // 256, t[xor(v % 256, x) + 1]), 4294967295), 4294967295) % 10000 + doc_id AS tenths FROM documents, crc),
        e AS (SELECT doc_id, source, lang, n, 60 * ((tenths - (tenths % 6 + 6) % 6) // 6) AS event_s FROM h),
        q AS (SELECT row_number() OVER () AS row_id, doc_id, source, event_s, w::BIGINT AS window_s FROM e CROSS JOIN (VALUES (600), (43200)) AS v(w)),
        a AS (SELECT q.row_id, count(e.event_s) AS n_events, coalesce(sum(e.n), 0)::BIGINT AS sum_chars, count(DISTINCT e.lang) AS n_langs, list_sort(list(e.n) FILTER (WHERE e.n IS NOT NULL)) AS s
              FROM q LEFT JOIN e ON e.source IS NOT DISTINCT FROM q.source AND e.event_s >= q.event_s - q.window_s AND e.event_s < q.event_s GROUP BY q.row_id)
        SELECT doc_id, window_s, event_s, n_events, sum_chars, n_langs, s[(len(s) + 1) // 2]::BIGINT AS median_chars, s[(90 * len(s) + 99) // 100]::BIGINT AS high_chars FROM q JOIN a USING (row_id)""",
    "op13_vector_code_compression": _codes_sql(),
}


def __getattr__(name: str):
    """SQL, made when it is asked for: that of the licence scan has the numbers of a trained model in it."""
    if name != "SQL":
        raise AttributeError(name)
    return _SQL | {"op10_licence_scans": licences.equivalent_sql()}
