"""Queries and SQL of the operators of this subpackage, by the names that the driver runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isochron.llm import chat, decontaminate, divergence, licenses, lines, media, ngram_join, pieces, quality, resample, substrings, vector_dedup, warc
from isochron.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each applies one operator to its whole table."""
    return {
        "op1_ngram_jaccard_join": lambda spark, d: ngram_join.jaccard_components(table(spark, d, "documents")),
        "op2_media_columns": lambda spark, d: media.media_report(table(spark, d, "documents")),
        "op3_license_scans": lambda spark, d: licenses.licence_report(table(spark, d, "documents")),
        "op4_suffix_array_dedup": lambda spark, d: substrings.substring_report(table(spark, d, "documents")),
        "op5_line_dedup": lambda spark, d: lines.line_report(table(spark, d, "documents")),
        "op6_quality_classifier": lambda spark, d: quality.quality_report(table(spark, d, "documents"), table(spark, d, "labels")),
        "op7_warc": lambda spark, d: warc.warc_report(table(spark, d, "pages")),
        "op8_chat_formatting": lambda spark, d: chat.chat_report(table(spark, d, "conversations")),
        "op9_benchmark_decontamination": lambda spark, d: decontaminate.decontamination_report(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op10_sentencepiece": lambda spark, d: pieces.pieces_report(table(spark, d, "documents")),
        "op11_embedding_neardup": lambda spark, d: vector_dedup.vector_report(table(spark, d, "embeddings")),
        "op12_source_divergence": lambda spark, d: divergence.divergence_report(table(spark, d, "documents")),
        "op13_importance_resampling": lambda spark, d: resample.resampling_report(table(spark, d, "documents"), table(spark, d, "benchmark")),
    }


#: What `strip` removes in a line key: space, tab, newline, vertical tab, form feed, carriage return.
_WHITE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators that SQL can express."""
    return {
        "op1_ngram_jaccard_join": f"""
            WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
                 s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles FROM w),
                 n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s),
                 t AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
                 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
                 l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
                 r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
            SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY ALL""",
        "op5_line_dedup": f"""
            WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                              generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
                 k AS (SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_WHITE})")} AS key FROM l),
                 o AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
                 m AS (SELECT k.*, o.key IS NOT NULL AND doc_id <> owner AS dropped FROM k LEFT JOIN o USING (key))
            SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
            FROM m GROUP BY doc_id""",
        "op7_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
                 w AS (SELECT html, max(page_id) AS best FROM p GROUP BY html),
                 s AS (SELECT page_id, strlen(html) AS payload_bytes, best, upper(sha1(html)) AS hex FROM p JOIN w USING (html)),
                 b AS (SELECT *, list_reduce(list_prepend('', list_transform(range(0, 40), lambda i:
                        lpad(bin(instr('0123456789ABCDEF', substr(hex, CAST(i AS INTEGER) + 1, 1)) - 1), 4, '0'))), lambda a, x: a || x) AS bits FROM s)
            SELECT page_id, payload_bytes,
                   list_reduce(list_prepend('', list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                     1 + 16 * CAST(substr(bits, CAST(5 * i AS INTEGER) + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * i AS INTEGER) + 2, 1) AS INTEGER)
                       + 4 * CAST(substr(bits, CAST(5 * i AS INTEGER) + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(5 * i AS INTEGER) + 4, 1) AS INTEGER)
                       + CAST(substr(bits, CAST(5 * i AS INTEGER) + 5, 1) AS INTEGER), 1))), lambda a, x: a || x) AS payload_digest,
                   CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> best THEN best END AS refers_to
            FROM b""",
        "op8_chat_formatting": """
            WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
                   CAST(3 + sum(length(text) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 ELSE 24 + length(role) END)
                        + sum(len(regexp_extract_all(text, '</s>|<s>|<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]|<\\|[a-z]+\\|>'))) AS BIGINT) AS formatted_chars
            FROM c GROUP BY conv_id""",
        "op9_benchmark_decontamination": f"""
            WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
                 b AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
                 w AS (SELECT DISTINCT item_id, words[s:s + 9] AS win FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM b WHERE len(words) > 0)),
                 n AS (SELECT DISTINCT len(win) AS size FROM w),
                 p AS (SELECT doc_id, size, words[s:s + size - 1] AS win, s FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM d, n WHERE len(words) >= size)),
                 h AS (SELECT p.doc_id, p.s, p.size, w.item_id FROM p JOIN w ON p.win = w.win),
                 c AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS spot FROM h) GROUP BY doc_id),
                 i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
            SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
                   sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
            FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
        "op11_embedding_neardup": """
            WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
                 u AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
                 l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                       WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
                 r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
                 n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
            SELECT e.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.y) AS component_id, e.vec_id = min(r.y) AS kept
            FROM embeddings e JOIN r ON r.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id GROUP BY e.vec_id""",
        "op12_source_divergence": f"""
            WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                              regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
                 t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
                 k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT row) >= 30),
                 l AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS total FROM k GROUP BY 1),
                 c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
                 g AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
                 p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p,
                              1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (l.total + 5 * l.v) AS q
                       FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
                 s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
                 r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                         LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
                       UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
            FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50""",
    }
