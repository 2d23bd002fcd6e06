"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fim, langid, licenses, linededup, neardup, packing, quality, sharding, spelling, suffixes, topk, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_read(spark, sf_dir, "documents"), words=4, num=80, den=100)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_passages(_read(spark, sf_dir, "documents"), width=400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, min_docs=10, least=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text_kept").cast("binary"), 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    index = warc.write_archive(_read(spark, sf_dir, "pages"), path)
    return warc.read_archive(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.host_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_decontamination, op3_near_duplicates, op4_licenses, op5_suffix_dedup, op6_language_id, op7_packing, op8_line_dedup, op9_warc, op10_exact_topk,
    op11_quality_rules, op12_fill_in_middle, op13_spelling_variants)}

#: Lines are split, keyed and counted as the contract says; DuckDB's trim takes the set of characters.
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: CRC-32 from its rule: the table of 256 remainders, then byte by byte.
_CRC = """t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
                         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) x(i)))"""

SQL = {
    "op1_sharding": f"""
        WITH {_CRC}, x AS (SELECT doc_id, source, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
             c AS (SELECT doc_id, coalesce('=' || source, 'null') AS key, len(h)::BIGINT + 1 AS size, xor(list_reduce(list_prepend(4294967295::UBIGINT,
                          list_transform(h, lambda y: ('0x' || y)::UBIGINT)), lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255)::BIGINT + 1])), 4294967295)::BIGINT AS text_crc32 FROM x, t),
             d AS (SELECT *, md5('17 ' || doc_id || ' ' || text_crc32) AS m, ('0x' || substr(md5('17 ' || key), 1, 8))::BIGINT AS u FROM c),
             f AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY m, doc_id, text_crc32, size) - 1 + (u + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / count(*) OVER (PARTITION BY key) AS f FROM d),
             r AS (SELECT *, row_number() OVER (ORDER BY f, key, m, doc_id, text_crc32, size) - 1 AS r, count(*) OVER () AS n FROM f),
             s AS (SELECT *, r * 16 // n AS shard FROM r)
        SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (r - (shard * n + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s""",
    "op3_near_duplicates": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM w WHERE len(w) > 0),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
             r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
             m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op5_suffix_dedup": """
        WITH x AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             v AS (SELECT r, j // 512 AS j, substr(h, 2 * j + 1, 1822) AS h, least(512, length(h) // 2 - 399 - j) AS n FROM x, unnest(range(0, greatest(length(h) // 2 - 399, 0), 512)) y(j)),
             k AS (SELECT r, 512 * j + i AS i, md5(substr(h, 2 * i + 1, 800)) AS k FROM v, unnest(range(n)) z(i)),
             q AS (SELECT r, i FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
             o AS (SELECT r, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -401) + 400 THEN 1 ELSE 0 END AS o FROM q),
             u AS (SELECT r, i, sum(o) OVER (PARTITION BY r ORDER BY i) AS u FROM o),
             s AS (SELECT r, u, min(i) AS lo, max(i) + 400 AS hi FROM u GROUP BY r, u),
             b AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS gap FROM s),
             e AS (SELECT r, count(*) AS n, sum(hi - lo) AS gone, max(hi) AS last, list(gap ORDER BY lo) AS a, list(lo ORDER BY lo) AS z FROM b GROUP BY r)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
               sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(list_zip(a, z), lambda t: substr(h, 2 * t[1] + 1, 2 * (t[2] - t[1]))), '')
                            || substr(h, 2 * last + 1) END)) AS kept_sha256
        FROM x LEFT JOIN e USING (r)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS r FROM p)
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
               CASE WHEN r = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> page_id THEN r END AS refers_to FROM d""",
    "op2_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
             b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
             k AS (SELECT DISTINCT len(w) AS k FROM b WHERE len(w) BETWEEN 1 AND 4),
             ds AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) > 0
                    UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d JOIN k ON len(w) >= k),
             bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0),
             n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
        SELECT doc_id, item_id, n_item::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / n_item AS containment
        FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 80""",
    "op10_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_quality_rules": r"""
        WITH x AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
             w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM x),
             g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) t(i)),
             d AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
             c AS (SELECT r, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM d, unnest([0, 1, 2]) u(j) GROUP BY r),
             m AS (SELECT r, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars,
                          (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                          coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN c USING (r)),
             b AS (SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 100 * n_dup_lines > 30 * n_lines,
                              word_chars < 3 * n_words OR word_chars > 10 * n_words] AS bad FROM m),
             h AS (SELECT source, rule, count(*)::DOUBLE AS n, (count(*) FILTER (bad[rule]))::DOUBLE AS f FROM b, unnest(range(1, 6)) t(rule) WHERE source IS NOT NULL GROUP BY ALL),
             s AS (SELECT rule, count(*) AS k, sum(n) AS n, sum(n * n) AS nn, sum(f) AS f, sum(f * f / n) AS ff, sum(f) / sum(n) AS p FROM h GROUP BY rule),
             q AS (SELECT *, p * (1 - p) * (n - nn / n - (k - 1)) AS room, ff - f * p - p * (1 - p) * (k - 1) AS spread FROM s),
             y AS (SELECT *, CASE WHEN room > 0 THEN spread / room ELSE 0 END AS gamma FROM q),
             z AS (SELECT rule, p, CASE WHEN gamma >= 0.5 THEN 1 WHEN gamma <= 1 / (n + 1) THEN n ELSE 1 / gamma - 1 END AS strength FROM y),
             v AS (SELECT DISTINCT source FROM h JOIN z USING (rule) WHERE f > 0.5 * n AND (f + p * strength) / (n + strength) > 0.5)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad[1] OR bad[2] AS base_failed,
               NOT (bad[1] OR bad[2] OR v.source IS NOT NULL) AS kept, v.source IS NOT NULL AS host_failed
        FROM b LEFT JOIN v ON v.source = b.source""",
    "op13_spelling_variants": rf"""
        WITH RECURSIVE {_CRC}, r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
             d AS (SELECT doc_id, w, count(*) AS k, regexp_extract_all(hex(encode(doc_id || ':' || w)), '..') AS h FROM r GROUP BY doc_id, w),
             c AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(h, lambda y: ('0x' || y)::UBIGINT)),
                          lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255)::BIGINT + 1])), 4294967295)::BIGINT AS h FROM d, t),
             n AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM c),
             w AS (SELECT word, sum(k)::BIGINT AS n FROM n WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
             e AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS e FROM w, unnest(range(1, length(word) + 1)) u(i)),
             p AS (SELECT e.word AS a, w.word AS b FROM e JOIN w ON w.word = e.e UNION SELECT w.word, e.word FROM e JOIN w ON w.word = e.e
                   UNION SELECT x.word, y.word FROM e x JOIN e y USING (i, e) WHERE x.word <> y.word),
             b AS (SELECT a, b, x.n AS n, y.n AS m, count(*) OVER (PARTITION BY a) AS c FROM p JOIN w x ON x.word = a JOIN w y ON y.word = b
                   QUALIFY row_number() OVER (PARTITION BY a ORDER BY y.n DESC, b) = 1),
             f AS (SELECT word, w.n, coalesce(c, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * w.n THEN b END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
                   FROM w LEFT JOIN b ON a = word),
             g(word, root) AS (SELECT word, word FROM f UNION ALL SELECT g.word, form FROM g JOIN f ON f.word = g.root WHERE form IS NOT NULL),
             z AS (SELECT g.word, root FROM g JOIN f ON f.word = root WHERE form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)""",
    "op12_fill_in_middle": """
        WITH x AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
             t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t, list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS d FROM x),
             c AS (SELECT *, len(t) AS n, least(d[1] % (len(t) + 1), d[2] % (len(t) + 1)) AS a, greatest(d[1] % (len(t) + 1), d[2] % (len(t) + 1)) AS b FROM t),
             p AS (SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s,
                          CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM p""",
    "op8_line_dedup": f"""
        WITH n AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
             l AS (SELECT r, doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i,
                          unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM n),
             k AS (SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(hot.key)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN hot USING (key) GROUP BY r, doc_id""",
}
