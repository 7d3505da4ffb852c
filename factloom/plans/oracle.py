"""SQL counterparts of the core queries, for DuckDB on the same tables."""

from __future__ import annotations

from factloom.plans import rules as R


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(quoted(x) for x in items) + "]"


def sql_in(items) -> str:
    return "(" + ", ".join(quoted(x) for x in items) + ")"


def matches(column: str, patterns: list[str], flags: str = "i") -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {quoted(p)}, '{flags}')" for p in patterns) + ")"


def strip(x: str) -> str:
    """A text without white space of any kind at its ends."""
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s*(Z|z|UTC|[+-]\d{2}(:?\d{2})?)?)?$"
OFFSET = r"[T ]\d{2}:\d{2}.*(Z|z|UTC|[+-]\d{2}(:?\d{2})?)$"


def instant(x: str) -> str:
    """Microseconds since 1970 of an ISO text, null for other text."""
    return (
        f"CASE WHEN regexp_matches({strip(x)}, {quoted(ISO)}) THEN CASE WHEN regexp_matches({strip(x)}, {quoted(OFFSET)}) "
        f"THEN epoch_us(try_cast({strip(x)} AS TIMESTAMPTZ)) ELSE epoch_us(try_cast({strip(x)} AS TIMESTAMP)) END END"
    )


#: Tidied facts, one row per id, as operators.store_view.tidy
FACTS = f"""
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_seen_at DESC NULLS LAST, ord DESC) AS rn FROM facts WHERE id IS NOT NULL),
    f AS (SELECT ord, id, lower({strip("coalesce(kind, '')")}) AS kind, coalesce(nullif(lower({strip('status')}), ''), 'current') AS status, coalesce(confidence, 0) AS confidence,
        coalesce(content, '') AS content, coalesce(nullif({strip('source')}, ''), 'shared') AS source, source_date, coalesce(nullif({strip('source_date')}, ''), 'unknown') AS date_key,
        coalesce({instant("source_date")}, CASE WHEN regexp_matches(substr({strip('source_date')}, 1, 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN epoch_us(try_cast(substr({strip('source_date')}, 1, 10) AS TIMESTAMP)) END) AS day,
        {instant("valid_at")} AS valid_from, {instant("invalid_at")} AS valid_to, superseded_by, superseded_at, deprecated, trust, json_extract_string(extra, '$.provenance') AS provenance, session, source_file, evidence, last_seen_at
        FROM r WHERE rn = 1)"""


def live(now: str, floor: float = R.MIN_CONFIDENCE) -> str:
    n = f"epoch_us(TIMESTAMP {quoted(now)})"
    return f"l AS (SELECT * FROM f WHERE status <> 'superseded' AND coalesce({n} >= valid_from, true) AND coalesce({n} < valid_to, true) AND confidence >= {floor})"


def hmac(key: str, message: str) -> str:
    """HMAC-SHA256 in hex of a text under a key of up to 64 bytes."""
    padded = key.encode().ljust(64, b"\0")
    inner, outer = ("".join(f"\\x{b ^ pad:02x}" for b in padded) for pad in (0x36, 0x5C))
    return f"sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode({message}))))"


def current(now: str) -> str:
    """CTE cu: facts that are not superseded and valid, of any confidence."""
    n = f"epoch_us(TIMESTAMP {quoted(now)})"
    return f"cu AS (SELECT * FROM f WHERE status <> 'superseded' AND coalesce({n} >= valid_from, true) AND coalesce({n} < valid_to, true))"


def excerpts(source: str, terms: list[str], most: int) -> str:
    """CTEs up to ex: the rows of ``source`` with ``excerpt``, the best stretch of their content for the terms."""
    word = "regexp_extract(sg[i + 1], '[A-Za-z0-9]+$')"
    first = "greatest(0, h.p - 30)"
    return f"""e0 AS (SELECT *, regexp_extract_all(content, '[^A-Za-z0-9]*[A-Za-z0-9]+') AS sg FROM {source}),
        e1 AS (SELECT *, list_transform(range(len(sg)), lambda i: {{'p': list_sum(list_transform(sg[1:i + 1], lambda z: len(z)))::BIGINT - len({word}), 't': {STEM.format(x=f"[lower({word})]")}[1]}}) AS hw FROM e0),
        e2 AS (SELECT *, list_filter(hw, lambda h: list_contains({sql_list(terms)}, h.t)) AS hits FROM e1),
        e3 AS (SELECT *, list_sort(list_transform(hits, lambda h: {{'n': len(list_distinct(list_transform(list_filter(hits, lambda g: g.p >= {first} AND g.p < {first} + {most}), lambda g: g.t))), 'm': -{first}}}), 'DESC')[1] AS best FROM e2),
        ex AS (SELECT *, CASE WHEN len(content) <= {most} OR best IS NULL THEN substr(content, 1, {most}) ELSE (CASE WHEN best.m < 0 THEN '...' ELSE '' END)
            || regexp_replace(substr(content, 1 - best.m, {most}), '^\\s+|\\s+$', '', 'g') || (CASE WHEN {most} - best.m < len(content) THEN '...' ELSE '' END) END AS excerpt FROM e3)"""


STEM = "list_transform({x}, lambda t: CASE WHEN len(t) > 4 AND t LIKE '%ies' THEN substr(t, 1, len(t) - 3) || 'y' WHEN len(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN substr(t, 1, len(t) - 1) ELSE t END)"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def stemmed(x: str) -> str:
    return STEM.format(x=tokens(x))


def recency(now: str) -> str:
    lives = " ".join(f"WHEN {quoted(k)} THEN {h}" for k, h in R.HALF_LIFE_DAYS.items())
    days = f"((epoch_us(TIMESTAMP {quoted(now)}) - day) / 86400e6)"
    return f"CASE WHEN day IS NULL OR {days} <= 0 THEN 1.0 ELSE greatest({R.MIN_RECENCY}, pow(0.5::DOUBLE, {days} / (CASE kind {lives} ELSE {R.DEFAULT_HALF_LIFE} END))) END"


SUPERSESSION = f"CASE WHEN coalesce(deprecated, false) THEN 0.4 WHEN status = 'current' AND len(coalesce({strip('superseded_by')}, '')) > 0 THEN 0.6 ELSE 1.0 END"
TRUST = """CASE WHEN lower(coalesce(trust, '')) IN ('untrusted', 'external') OR (lower(coalesce(trust, '')) <> 'trusted'
    AND lower(coalesce(provenance, '')) IN ('external_write', 'mcp', 'tool', 'external')) THEN 0.5 ELSE 1.0 END"""


def bulk(share: str) -> str:
    return f"CASE WHEN {share} <= {R.BULK_DATE_SHARE} THEN 1.0 ELSE greatest({R.BULK_DATE_FLOOR}, 1.0 - ({share} - {R.BULK_DATE_SHARE})) END"


def bm25(terms: list[str], now: str, min_matched: int) -> str:
    """CTEs f, l, …, s: scored matches as operators.rank.bm25_scores."""
    tf = ", ".join(f"len(list_filter(tokens, lambda x: x = {quoted(t)})) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    k1, b = R.BM25_K1, R.BM25_B
    part = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * {k1 + 1} / (tf{i} + {k1} * (1 - {b} + {b} * size / avgdl)) ELSE 0 END" for i in range(len(terms)))
    matched = " + ".join(f"(tf{i} > 0)::INT" for i in range(len(terms)))
    near = " + ".join(
        f"(len(list_filter(range(len(tokens)), lambda i: tokens[i + 1] = {quoted(a)} AND len(list_filter(range(len(tokens)), lambda j: tokens[j + 1] = {quoted(c)} AND abs(i - j) <= {R.PAIR_WINDOW})) > 0)) > 0)::INT"
        for a, c in zip(terms, terms[1:])
    ) or "0"
    return f"""{FACTS}, {live(now)},
        t0 AS (SELECT *, {stemmed('content')} AS tokens FROM l),
        t AS (SELECT *, len(tokens)::DOUBLE AS size, {tf} FROM t0),
        st AS (SELECT count(*)::DOUBLE AS n, avg(size) AS avgdl, {df} FROM t),
        dd AS (SELECT date_key, count(*)::DOUBLE AS on_date FROM t GROUP BY 1),
        m AS (SELECT t.*, st.n, on_date, {part} AS bm25, {matched} AS matched FROM t JOIN dd USING (date_key) CROSS JOIN st),
        p AS (SELECT *, {near} AS pairs FROM m WHERE bm25 > 0 AND matched >= {min_matched}),
        s AS (SELECT *, bm25 * confidence * {recency(now)} * {SUPERSESSION} * {TRUST} * (1.0 + greatest(0, matched - 1) * 3.0) * (1.0 + pairs * 4.0) * {bulk('on_date / n')} AS score FROM p)"""


RANK_ORDER = "round(score, 9) DESC, pairs DESC, matched DESC, confidence DESC, ord"


def classify(x: str) -> str:
    """kind of a bullet or null; ``conf`` in the second."""
    rules = [(p, k, c, "c") for p, k, c in R.TAGGED] + [(p, k, c, "i") for p, k, c in R.INFERRED]
    kind = " ".join(f"WHEN regexp_matches({x}, {quoted(p)}, '{f}') THEN {quoted(k)}" for p, k, _, f in rules)
    conf = " ".join(f"WHEN regexp_matches({x}, {quoted(p)}, '{f}') THEN {c}" for p, _, c, f in rules)
    return f"CASE {kind} END", f"CASE {conf} END"


def distinct_in_order(items: str, keep: str, most: int) -> str:
    """The first ``most`` distinct items of a list in order that ``keep`` (a condition on x) lets through, joined by spaces."""
    filtered = f"list_filter({items}, lambda x: {keep})"
    return f"array_to_string(list_slice(list_filter(list_transform(range(len({filtered})), lambda i: CASE WHEN list_position({filtered}, {filtered}[i + 1]) = i + 1 THEN {filtered}[i + 1] END), lambda y: y IS NOT NULL), 1, {most}), ' ')"
