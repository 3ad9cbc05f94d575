"""One registered query per operator, on the whole of its table, and the
DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm import (bpe, clustering, collocations, decontaminate, exact_dedup, html_extract, language_id, license_scan,
                            line_dedup, quality_rules, simhash_dedup, toxicity, url_rules)
from gridwright.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The host and path rules of the URL filter (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.notices(spark))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), stored=True)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_exact_dedup, op3_toxicity, op4_language_id, op5_decontamination, op6_url_filter, op7_bpe,
                                op8_line_dedup, op9_license_scan, op10_simhash_dedup, op11_collocations, op12_quality_rules, op13_clustering)}


def collocations_sql(min_count: int = 100, top: int = 2000) -> str:
    """DuckDB: every phrase of up to 5 words is written out and counted."""
    leads = ", ".join(f"lead(word, {k}) OVER w AS w{k}, lead(pos, {k}) OVER w AS a{k}" for k in range(1, 5))
    grams = " UNION ALL ".join(
        f"SELECT lang, {k + 1} AS k, concat_ws(' ', word{''.join(f', w{j}' for j in range(1, k + 1))}) AS p FROM x"
        + (f" WHERE a{k} = pos + {k}" if k else "") for k in range(5))
    return rf"""
        WITH toks AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                   regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]+', ' ' || chr(10) || ' ', 'g'), '[\x20\x09]+') AS ws
            FROM documents),
        every AS (SELECT doc, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM toks),
        words AS (SELECT * FROM every WHERE word <> '' AND word <> chr(10)),
        totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
        x AS (SELECT lang, pos, word, {leads} FROM words WINDOW w AS (PARTITION BY doc ORDER BY pos)),
        f AS MATERIALIZED (SELECT lang, k, p, count(*) AS c FROM ({grams}) GROUP BY lang, k, p HAVING count(*) >= {min_count}),
        cand AS (
            SELECT * FROM f WHERE k > 1 AND NOT EXISTS (
                SELECT 1 FROM f AS q WHERE q.lang = f.lang AND q.k > f.k AND 100 * q.c >= 100 * f.c
                    AND contains(' ' || q.p || ' ', ' ' || f.p || ' '))),
        cuts AS (
            SELECT lang, p, k, c, j, array_to_string(string_split(p, ' ')[1:j], ' ') AS first,
                   array_to_string(string_split(p, ' ')[j + 1:], ' ') AS rest
            FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
        scored AS (
            SELECT cuts.lang, cuts.p AS phrase, cuts.c AS a, l.c AS l, r.c AS r, n,
                   CAST((1000::HUGEINT * cuts.c * n) // (l.c::HUGEINT * r.c) AS BIGINT) AS score, j
            FROM cuts JOIN f AS l ON l.lang = cuts.lang AND l.p = first JOIN f AS r ON r.lang = cuts.lang AND r.p = rest
            JOIN totals ON totals.lang = cuts.lang),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM lowest QUALIFY rank <= {top}"""


def quality_sql() -> str:
    """DuckDB twin of the quality rules; repeated windows are counted as rows."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws.split()}))
    fails = []
    for _, measure, per, least, most in quality_rules.THRESHOLDS:
        fails += [f"1000 * {measure} < {least} * {per}"] if least is not None else []
        fails += [f"1000 * {measure} > {most} * {per}"] if most is not None else []
    space = r"\x20\x09-\x0D"
    return rf"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[{space}]+'), lambda x: x <> '') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS ls
            FROM documents),
        wins AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS t
                 FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
        again AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, t) > 1),
        cover AS (SELECT rid, sum(w) AS n FROM (
            SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS w FROM again) GROUP BY rid),
        m AS (
            SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
                   len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
                   len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
                   len(list_filter(ls, lambda x: regexp_matches(x, '^[{space}]*[-*•]'))) AS n_bullet_lines,
                   len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[{space}]*$'))) AS n_ellipsis_lines
            FROM d LEFT JOIN cover USING (rid)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR {' OR '.join(fails)}) AS kept FROM b"""


def clustering_sql(clusters: int = 40, rounds: int = 5) -> str:
    """DuckDB: every distance of every round; the rounds are written out."""
    def assigned(k: int) -> str:
        d = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return (f"a{k} AS MATERIALIZED (SELECT v.rid, any_value(v.vec_id) AS vec_id, any_value(v.v) AS v, "
                f"min(struct_pack(d := {d}, c := c.c)) AS m FROM v CROSS JOIN c{k} AS c GROUP BY v.rid)")

    parts = [assigned(0)]
    for k in range(rounds):
        parts.append(f"s{k} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(v) AS x, "
                     f"generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY c, i)")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(t.v, o.v) AS v FROM c{k} AS o LEFT JOIN (SELECT c, "
                     f"list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{k} GROUP BY c) AS t ON t.c = o.c)")
        parts.append(assigned(k + 1))
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < {clusters}),
        {', '.join(parts)}
        SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
               (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} AS c ON c.c = m.c"""


ORACLE = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h
                   FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
        FROM d WINDOW w AS (PARTITION BY h)""",
    "op11_collocations": collocations_sql(),
    "op12_quality_rules": quality_sql(),
    "op13_clustering": clustering_sql(),
}
