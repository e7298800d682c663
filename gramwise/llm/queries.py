"""The queries of the training-data operators, each over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gramwise.llm import alignment, bpe, embeddings, exact, html, katz, mixing, repair, simhash, substring, suffix_dedup, toxicity, warc
from gramwise.llm.common import read

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_substring_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(read(spark, sf_dir, "documents"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), RANKS, ids=False)


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit(read(spark, sf_dir, "pages"))


def op5_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_dedup(read(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(read(spark, sf_dir, "documents"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(read(spark, sf_dir, "documents"), order=3, least=1)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_substring_words, op2_suffix_array, op3_byte_bpe, op4_warc_fixity, op5_embedding_forest, op6_simhash, op7_katz, op8_exact_dedup, op9_mixing, op10_toxicity, op11_token_alignment, op12_html_text, op13_conversation_repair)}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op4_warc_fixity": r"""
        WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 1024.0) AS BIGINT)) AS files FROM pages),
        p AS (SELECT page_id, coalesce(page_id, ('0x' || substr(md5(concat_ws(chr(31), url, html)), 1, 8))::BIGINT) AS deal, coalesce(html, '') AS body,
                     md5(concat_ws(chr(31), CAST(page_id AS VARCHAR), url)) AS u, coalesce(url, '') AS url, chr(13) || chr(10) AS nl,
                     ('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 6))::BIGINT % 1000 AS drawn
              FROM pages),
        f AS (SELECT *, (deal % files + files) % files AS file FROM p, n),
        r AS (SELECT page_id, file, CASE WHEN file % 4 = 0 THEN drawn ELSE 999 END AS draw, nl, 'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:uuid:'
                     || concat_ws('-', substr(u, 1, 8), substr(u, 9, 4), substr(u, 13, 4), substr(u, 17, 4), substr(u, 21, 12)) || '>' || nl
                     || 'WARC-Target-URI: ' || url || nl || 'WARC-Date: 2024-01-01T00:00:00Z' || nl || 'Content-Type: text/html' || nl
                     || 'Content-Length: ' || CAST(octet_length(encode(body)) AS VARCHAR) || nl || nl || body || nl || nl AS warc
              FROM f),
        a AS (SELECT page_id, file, page_id AS place, draw, sha256(warc) AS sha256, CAST(octet_length(encode(warc)) AS BIGINT) AS length FROM r),
        c AS (SELECT page_id, file, draw, CASE WHEN draw BETWEEN 18 AND 19 THEN 1000000000000000 ELSE 0 END + page_id AS place, false AS extra,
                     CASE WHEN draw < 13 THEN left(warc, length(warc) - 5) || '#' || nl || nl WHEN draw < 18 THEN left(warc, length(warc) - 7) ELSE warc END AS warc
              FROM r WHERE draw >= 3
              UNION ALL SELECT 1000000000000000 + page_id, file, draw, 1000000000000000 + page_id, true, warc FROM r WHERE draw BETWEEN 20 AND 21),
        b AS (SELECT page_id, file, place, extra, sha256(warc) AS sha256, CAST(octet_length(encode(warc)) AS BIGINT) AS length FROM c),
        one AS (SELECT *, row_number() OVER w - 1 AS record_no, CAST(sum(length) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - length AS "offset"
                FROM a WINDOW w AS (PARTITION BY file ORDER BY place NULLS FIRST, sha256)),
        two AS (SELECT *, row_number() OVER w - 1 AS record_no, CAST(sum(length) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - length AS "offset"
                FROM b WINDOW w AS (PARTITION BY file ORDER BY place NULLS FIRST, sha256))
        SELECT one.page_id, one.file, one.record_no, one."offset", one.length, one.sha256,
               CASE WHEN two.file IS NULL THEN 'missing' WHEN two.sha256 = one.sha256 THEN CASE WHEN two."offset" = one."offset" AND two.record_no = one.record_no THEN 'ok' ELSE 'displaced' END
                    WHEN two.length < one.length THEN 'truncated' WHEN two.length > one.length THEN 'extended' ELSE 'corrupt' END AS status
        FROM one LEFT JOIN two ON one.page_id = two.page_id AND NOT two.extra
        UNION ALL SELECT page_id, file, record_no, "offset", length, sha256, 'extra' FROM two WHERE extra""",
    "op8_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op9_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   ('0x' || substr(md5(concat_ws(chr(31), CAST(doc_id AS VARCHAR), text)), 1, 15))::BIGINT AS h
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        p AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight,
                     2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
        q AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                     sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM p),
        m AS (SELECT *, most * rest_weight <= (budget - before) * weight AS stops FROM q),
        g AS (SELECT source, source_size,
                     CASE WHEN stops THEN most
                          ELSE (budget - sum(CASE WHEN stops THEN most ELSE 0.0::DOUBLE END) OVER ()) * weight
                               / sum(CASE WHEN stops THEN 0.0::DOUBLE ELSE weight END) OVER () END AS target FROM m),
        w AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 2) AS BIGINT) ELSE 0 END AS whole FROM g),
        r AS (SELECT *, greatest(target - whole * source_size, 0) AS rest FROM w),
        j AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.rest,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                     sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
              FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, size, source_size, target,
               size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR upto - same <= rest AND 2 * (rest - (upto - same)) > same) THEN 1 ELSE 0 END) AS taken
        FROM j""",
    # The pages at hand have their text in an article of headings and paragraphs.
    "op12_html_text": r"""
        WITH a AS (SELECT page_id, url, string_split_regex(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<br>', ' ', 'g'), '</?(p|h1)>') AS parts FROM pages),
        b AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(regexp_replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&quot;', '"'), '&amp;?', '&', 'g'), chr(160), ' '), '\s+', ' ', 'g'))) AS parts FROM a),
        t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
        SELECT page_id, url, text, length(text) AS n_chars FROM t""",
    # The cheapest way to each state after each row, with the least audit and what it leaves.
    "op13_conversation_repair": r"""
        WITH RECURSIVE tab AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
        s AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
        d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     xor(list_reduce([4294967295] || list_transform(range(1, length(name) + 1), lambda i: CAST(ord(substr(name, i, 1)) AS BIGINT)),
                                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS draw FROM s, tab),
        g AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
                     CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE draw <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM g),
        f AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM o),
        h AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM f),
        c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                     count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS rows FROM h GROUP BY conv_id),
        nxt(q, x, to_q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        ins(q, to_q, more, said, left_) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
            (1, 2, 5, 'I', chr(10) || 'user:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 3, 5, 'I', chr(10) || 'assistant:'), (3, 2, 5, 'I', chr(10) || 'user:')),
        e AS (SELECT f.conv_id, n, 0 AS q, 0 AS to_q, 2 AS more, 'D' AS said, '' AS left_ FROM f
              UNION ALL SELECT conv_id, n, q, q, 2, 'D', '' FROM f, (VALUES (1), (2), (3)) v(q)
              UNION ALL SELECT conv_id, n, q, to_q, CASE WHEN fault = 3 THEN 5 ELSE 0 END, 'K', chr(10) || role || ':' || text FROM f JOIN nxt ON x = initial WHERE fault IN (0, 3)
              UNION ALL SELECT conv_id, n, q, to_q, CASE WHEN fault = 3 THEN 6 ELSE 1 END, 'R', chr(10) || CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text FROM f, nxt WHERE fault IN (0, 3) AND x <> 's'),
        p AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS q, 0 AS cost, '' AS audit, '' AS left_ FROM c
              UNION ALL
              SELECT conv_id, n, q, cost, audit, left_ FROM (
                  SELECT p.conv_id, e.n, e.to_q AS q, p.cost + ins.more + e.more AS cost, p.audit || ins.said || e.said AS audit, p.left_ || ins.left_ || e.left_ AS left_,
                         row_number() OVER (PARTITION BY p.conv_id, e.to_q ORDER BY p.cost + ins.more + e.more, p.audit || ins.said || e.said) AS r
                  FROM p JOIN ins ON ins.q = p.q JOIN e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.n = p.n + 1 AND e.q = ins.to_q) WHERE r = 1),
        z AS (SELECT p.conv_id, p.cost + more AS cost, p.audit || said AS audit, p.left_ || ins.left_ AS left_,
                     row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + more, p.audit || said) AS r
              FROM p JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.rows = p.n JOIN ins ON ins.q = p.q WHERE ins.to_q IN (0, 3))
        SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(substr(coalesce(left_, ''), 2)) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
        LEFT JOIN (SELECT * FROM z WHERE r = 1) z ON z.conv_id IS NOT DISTINCT FROM a.conv_id""",
}
