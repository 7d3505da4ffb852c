"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import batch_dedup, components, leakage, mixing, near_dup, neighbours, pii, reading, term_scores
from factloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_pairs(table(spark, sf_dir, "facts"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_classes(table(spark, sf_dir, "facts"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_items(*[table(spark, sf_dir, t) for t in ("facts", "session_lines", "name_roster")])


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pii.stored_texts(table(spark, sf_dir, "facts"), table(spark, sf_dir, "session_lines"))
    return pii.redact(texts, pii.roster(table(spark, sf_dir, "name_roster"))).select("tbl", "rec_key", "redacted")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_fact_pairs(table(spark, sf_dir, "fact_vectors"))


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.fact_neighbours(table(spark, sf_dir, "fact_vectors"))
    return near.select("id", "rank", "near_id", near["score"].cast("decimal(6,4)").alias("score"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scores.top_terms(term_scores.term_scores(table(spark, sf_dir, "facts")))


def p5_residual_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scores.top_terms(term_scores.term_scores(table(spark, sf_dir, "facts")), by="residual_score")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_dedup.rejected_facts(table(spark, sf_dir, "facts"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.supersession_groups(table(spark, sf_dir, "facts"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.short_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).report()


def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).copies()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.hard_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels")
    return reading.reading_levels(documents, reading.fit(documents.filter(reading.is_english(documents["lang"])), labels))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_classes, p2_found, p2_redacted, p4_found, p4_nearest, p5_found, p5_residual_top, p6_found, p7_found, p8_found, p8_spans, p9_found, p9_report, p9_copies, p10_found, p10_levels]
    return {q.__name__: q for q in found}


_FACT_SETS = """
    d AS (SELECT DISTINCT id, lower(regexp_replace(kind, '^\\s+|\\s+$', '', 'g')) AS k, content FROM facts WHERE id IS NOT NULL),
    w AS (SELECT id, k, list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+')) AS ws FROM d),
    x AS (SELECT id, k, ws, len(ws) AS n FROM w WHERE len(ws) >= 8 AND k IS NOT NULL),
    p AS (SELECT a.id AS id_a, b.id AS id_b, a.n + b.n AS s, len(list_intersect(a.ws, b.ws)) AS o
          FROM x a JOIN x b ON a.k = b.k AND a.id < b.id AND a.n >= 0.75 * b.n AND b.n >= 0.75 * a.n)"""

_TERMS = """
    d AS (SELECT DISTINCT id, content FROM facts WHERE id IS NOT NULL),
    w AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+')) AS term FROM d),
    tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL),
    t AS (SELECT term, count(*) AS n, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= 2),
    r AS (SELECT count(DISTINCT id)::DOUBLE AS records FROM tf)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_FACT_SETS} SELECT id_a, id_b FROM p WHERE o / (s - o) >= 0.75",
        "p1_classes": f"""WITH {_FACT_SETS},
            same AS (SELECT id, min(id) OVER g AS class_id, count(*) OVER g AS copies FROM (SELECT id, k, list_sort(ws) AS ws FROM x) WINDOW g AS (PARTITION BY k, ws)),
            l AS (SELECT DISTINCT a.class_id AS x, b.class_id AS y FROM p JOIN same a ON a.id = id_a JOIN same b ON b.id = id_b WHERE o / (s - o) >= 0.75 AND a.class_id <> b.class_id),
            n AS (SELECT c, count(DISTINCT o) AS links FROM (SELECT x AS c, y AS o FROM l UNION ALL SELECT y, x FROM l) GROUP BY c)
            SELECT id, class_id, copies, coalesce(links, 0) AS links FROM same LEFT JOIN n ON c = class_id""",
        "p4_found": """WITH v AS (SELECT fact_id AS id, vector::DOUBLE[] AS x, row_number() OVER (PARTITION BY fact_id ORDER BY vector::VARCHAR) AS n FROM fact_vectors
                WHERE model_id = 'static-64' AND fact_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0),
            p AS (SELECT a.id AS i, b.id AS j, list_cosine_similarity(a.x, b.x) AS s FROM v a JOIN v b ON a.id < b.id WHERE a.n = 1 AND b.n = 1 AND list_cosine_similarity(a.x, b.x) >= 0.9),
            r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY s DESC) AS n FROM (SELECT i, j, s FROM p UNION ALL SELECT j, i, s FROM p))
            SELECT DISTINCT least(i, j) AS id_a, greatest(i, j) AS id_b FROM r WHERE n <= 5""",
        "p6_found": """WITH RECURSIVE d AS (SELECT DISTINCT id, content, substr(trim(source_date), 1, 10) AS day FROM facts WHERE id IS NOT NULL AND regexp_matches(trim(source_date), '^[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(substr(trim(source_date), 1, 10) AS DATE) IS NOT NULL),
            w AS (SELECT id, list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+')) AS ws, row_number() OVER (ORDER BY day, id) AS seq FROM d),
            x AS (SELECT *, len(ws) AS n FROM w WHERE len(ws) >= 8),
            p AS (SELECT a.seq AS a, b.seq AS b, a.n + b.n AS s, len(list_intersect(a.ws, b.ws)) AS o FROM x a JOIN x b ON b.seq < a.seq AND a.n >= 0.75 * b.n AND b.n >= 0.75 * a.n),
            l AS MATERIALIZED (SELECT a, list(b) AS bs, row_number() OVER (ORDER BY a) AS k FROM p WHERE o / (s - o) >= 0.75 GROUP BY a),
            t(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
                SELECT l.k, CASE WHEN len(list_filter(bs, lambda y: NOT list_contains(gone, y))) > 0 THEN list_append(gone, a) ELSE gone END FROM t JOIN l ON l.k = t.k + 1)
            SELECT id FROM x WHERE seq IN (SELECT unnest(gone) FROM t WHERE k = (SELECT max(k) FROM t))""",
        "p9_found": """WITH g AS (SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source, sum(coalesce(target_share, 0)) AS share, max(coalesce(max_repeats, 0)) AS repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
            d AS (SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source, sum(len(coalesce(text, '')))::DOUBLE AS size FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)
            SELECT g.source FROM g LEFT JOIN d ON g.source = d.source WHERE coalesce(size, 0) * repeats < share * 0.5 * (SELECT sum(size) FROM d)""",
        "p8_spans": """WITH i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') AS w FROM eval_items),
            g AS (SELECT DISTINCT item_id, array_to_string(w[k + 1 : k + 12], ' ') AS phrase FROM i, unnest(range(len(w) - 11)) AS t(k)),
            d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
            h AS (SELECT doc_id, k, array_to_string(w[k + 1 : k + 12], ' ') AS phrase FROM d, unnest(range(len(w) - 11)) AS t(k)),
            m AS (SELECT doc_id, item_id, k, lag(k) OVER (PARTITION BY doc_id, item_id ORDER BY k) AS before FROM h JOIN g USING (phrase)),
            s AS (SELECT *, sum(CASE WHEN before IS NULL OR k > before + 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id ORDER BY k) AS span FROM m)
            SELECT doc_id, item_id, min(k) AS from_word, max(k) + 12 AS to_word FROM s GROUP BY doc_id, item_id, span""",
        "p5_found": f"""WITH {_TERMS} SELECT id, term FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(tf * ln(records / n), 9) DESC, term) AS place
            FROM tf JOIN t USING (term), r) WHERE place = 1""",
        "p5_residual_top": f"""WITH {_TERMS} SELECT id, term FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round((ln(records / n) + ln(1 - exp(-cf / records))) * n, 9) DESC, term) AS place
            FROM tf JOIN t USING (term), r) WHERE place = 1""",
        "p7_found": """WITH RECURSIVE f AS (SELECT lower(regexp_replace(id, '^\\s+|\\s+$', '', 'g')) AS u, lower(regexp_replace(superseded_by, '^\\s+|\\s+$', '', 'g')) AS v FROM facts WHERE id IS NOT NULL),
            e AS (SELECT DISTINCT u, v FROM f WHERE u <> v AND v IN (SELECT u FROM f)),
            b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
            reach(id, other) AS (SELECT u, v FROM b UNION SELECT reach.id, b.v FROM reach JOIN b ON reach.other = b.u)
            SELECT id, min(least(id, other)) AS group_id FROM reach GROUP BY id""",
        "p8_found": """WITH i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') AS w FROM eval_items),
            g AS (SELECT DISTINCT item_id, array_to_string(w[k + 1 : k + 12], ' ') AS phrase FROM i, unnest(range(len(w) - 11)) AS t(k)),
            d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
            h AS (SELECT doc_id, array_to_string(w[k + 1 : k + 12], ' ') AS phrase FROM d, unnest(range(len(w) - 11)) AS t(k))
            SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (phrase)""",
    }
