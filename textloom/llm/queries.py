"""Registered queries of the operators and the SQL they are compared with."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import (
    decontaminate,
    exact_dedup,
    language_id,
    licenses,
    packing,
    piece_codec,
    simhash,
    spelling,
    substring_dedup,
    token_counts,
    url_filter,
    vector_codes,
    warc,
)

COUNTING_TOKENIZER, PACKING_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"

# Rules of the URL query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(COUNTING_TOKENIZER)
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), path)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), any_case=True)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_groups(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(licenses.NOTICES, "license string, text string")
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"), templates)
    return found.select("doc_id", "license", "containment", F.col("start").cast("long").alias("start"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECE_MODEL)
    coded = piece_codec.decode(piece_codec.encode(_table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    digest = F.lit(vector_codes.codebooks_digest(codebooks)).alias("codebooks_sha256")
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", digest)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_url_filter,
        op3_token_counts,
        op4_language_id,
        op5_decontamination,
        op6_simhash,
        op7_license_scan,
        op8_substring_dedup,
        op9_warc,
        op10_best_fit_packing,
        op11_sentencepiece,
        op12_spelling_variants,
        op13_vector_codes,
    )
}



def _license_sql() -> str:
    """All windows against all templates: the windows of a class start every ``step`` words."""
    lengths = [len(re.findall(r"\w+", text)) for _, text in licenses.NOTICES]
    classes = licenses.length_classes(lengths)
    rows = ", ".join(f"({c.least}, {c.most}, {c.size}, {c.window}, {c.step})" for c in classes)
    notices = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.NOTICES)
    cut = "[x FOR x IN string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+') IF x <> '']"
    return f"""
        WITH c(least, most, size, win, step) AS (VALUES {rows}),
        n(license, notice) AS (VALUES {notices}),
        t AS (SELECT license, notice, {cut.format("notice")} AS w FROM n),
        ts AS (SELECT DISTINCT license, notice, size, win, step, array_to_string(w[i:i + size - 1], ' ') AS s
               FROM t JOIN c ON len(w) BETWEEN least AND most, generate_series(1, len(w) - size + 1) g(i)),
        total AS (SELECT license, notice, count(*) AS n FROM ts GROUP BY ALL),
        d AS (SELECT doc_id, {cut.format("coalesce(text, '')")} AS w FROM documents),
        p AS (SELECT doc_id, i - 1 AS p, c.size, array_to_string(w[i:i + c.size - 1], ' ') AS s
              FROM d, (SELECT DISTINCT size FROM c) c, generate_series(1, len(w) - c.size + 1) g(i)),
        h AS (SELECT doc_id, license, notice, k * step AS start, count(DISTINCT p.s) AS shared
              FROM p JOIN ts ON p.s = ts.s AND p.size = ts.size,
                   generate_series(greatest(0, ((p.p + p.size - win + step - 1) // step)::BIGINT), (p.p // step)::BIGINT) q(k)
              GROUP BY ALL),
        best AS (SELECT doc_id, license, shared / n AS containment, start FROM h JOIN total USING (license, notice)
                 WHERE shared / n >= {licenses.CONTAINED})
        SELECT doc_id, license, max(containment) AS containment, arg_min(start, (-containment, start)) AS start
        FROM best GROUP BY doc_id, license
    """


def _spelling_sql() -> str:
    """Runs with a CRC-32 by half bytes; near words by their forms without one letter."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    digits = "[strpos('0123456789ABCDEF', substr(x, i + (i % 2) * 2 - 1, 1))::BIGINT - 1 FOR i IN range(1, length(x) + 1)]"
    return f"""
        WITH RECURSIVE d AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS id,
                   unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                       'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
            FROM documents),
        r AS (SELECT run, count(*) AS k, hex(id || ':' || run) AS x FROM d WHERE length(run) >= 7 GROUP BY id, run),
        h AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {digits}),
                                 lambda c, v: xor(c >> 4, {table}[(xor(c, v) & 15) + 1]))) AS h FROM r),
        l AS (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                             ELSE run END AS word FROM h),
        w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM l WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
        cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x
                             FROM w, generate_series(1, length(word)) g(i)),
        shorter AS (SELECT DISTINCT cut.word AS a, w.word AS b FROM cut JOIN w ON cut.x = w.word),
        near AS (SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter UNION ALL
                 SELECT p.word, q.word FROM cut p JOIN cut q ON p.i = q.i AND p.x = q.x AND p.word <> q.word),
        best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS bn
                 FROM near JOIN w ON b = word GROUP BY a),
        f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 10 * n THEN b END AS form,
                                  CASE WHEN bn >= 10 * n THEN bn END AS form_n FROM w LEFT JOIN best ON word = a),
        up AS (SELECT word, word AS at, form AS next FROM f UNION ALL
               SELECT up.word, up.next, f.form FROM up JOIN f ON f.word = up.next)
        SELECT f.word, f.form, up.at AS root, n, n_near, form_n FROM f JOIN up ON up.word = f.word AND up.next IS NULL
    """


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Full scans in every round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        d{r} AS MATERIALIZED (SELECT v.no, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x)) AS gap
                 FROM v JOIN c{r} c ON v.part = c.part AND v.j = c.j GROUP BY ALL),
        a{r} AS MATERIALIZED (SELECT no, part, arg_min(entry, gap * {entries} + entry) AS entry, min(gap) AS gap
                 FROM d{r} GROUP BY no, part)""")
        if r < rounds:
            steps.append(f"""
        c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN
                 (SELECT v.part, a.entry, v.j, floor(sum(v.x)::DOUBLE / count(*))::BIGINT AS x
                  FROM v JOIN a{r} a ON v.no = a.no AND v.part = a.part GROUP BY ALL) m
                 ON c.part = m.part AND c.entry = m.entry AND c.j = m.j)""")
    return f"""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS no, vec_id, label, embedding FROM embeddings
                      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS MATERIALIZED (SELECT no, (i - 1) * {parts} // len(embedding) AS part, (i - 1) % (len(embedding) // {parts}) AS j,
                     floor(256 * embedding[i]::DOUBLE)::BIGINT AS x FROM kept, generate_series(1, len(embedding)) g(i)),
        c0 AS MATERIALIZED (SELECT part, no AS entry, j, x FROM v WHERE no < {entries}), {",".join(steps)},
        e AS (SELECT no, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error
              FROM a{rounds} GROUP BY no),
        s AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM c{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM kept JOIN e ON kept.no = e.no, s
    """


ORACLE = {
    "op12_spelling_variants": _spelling_sql(),
    "op13_vector_codes": _codes_sql(),
    "op7_license_scan": _license_sql(),
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op2_url_filter": """
        WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
                   FROM pages),
        p AS (SELECT page_id,
                     coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') AS path
              FROM a),
        r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
                                ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        best AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
                 FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
                 GROUP BY page_id)
        SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
        FROM p LEFT JOIN best ON p.page_id = best.page_id
    """,
}
