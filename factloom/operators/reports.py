"""Health, evaluation and promotion reports (survey A3, A6 to A9, A11 to A14, A17, D7c, J12, X3 to X7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.functions import values as V
from factloom.operators.numbering import numbered

PROMOTABLE = ("decision", "directive", "architecture", "config", "correction")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """A3."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def health(facts: DataFrame, raw: DataFrame) -> DataFrame:
    """Counters of a store; ready for recall if it has facts and no malformed row (one without id, content or date)."""
    bad = F.col("id").isNull() | F.col("content").isNull() | F.col("source_date").isNull()
    rows = raw.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(bad, 1)).alias("malformed"))
    own = facts.agg(
        F.count(F.lit(1)).alias("facts"), F.count(F.when(F.col("status") == "superseded", 1)).alias("superseded"), F.count_distinct("kind").alias("kinds"),
        F.count_distinct("date_key").alias("dates"), F.round(F.avg("confidence"), 4).alias("mean_confidence"),
    )
    return rows.crossJoin(own).withColumn("recall_ready", (F.col("facts") > 0) & (F.col("malformed") == 0))


def recent_counts(events: DataFrame, at: str, now: Column, group: str, hours: float = 24.0, threshold: int = 1) -> DataFrame:
    """Per group: total, number in the last hours, last time, flagged from a threshold on."""
    recent = F.count(F.when((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")) <= hours * 3600e6), 1))
    return events.groupBy(group).agg(F.count(F.lit(1)).alias("total"), recent.alias("recent"), F.max(at).alias("last_at")).withColumn("flagged", F.col("recent") >= threshold)


def queue_freshness(written_at: Column, now: Column, max_age_hours: float = 26.0) -> Column:
    """Struct (age_hours, stale); missing and future times are stale."""
    age = (F.unix_micros(now) - F.unix_micros(written_at)) / F.lit(3600e6)
    return F.struct(F.round(age, 3).alias("age_hours"), F.coalesce((age < 0) | (age > max_age_hours), F.lit(True)).alias("stale"))


def last_status(receipts: DataFrame, key: str, status: str, seq: str) -> DataFrame:
    """The newest status of each artifact."""
    return receipts.groupBy(key).agg(F.max_by(status, seq).alias("status"), F.max(seq).alias("seq"))


def stratified(facts: DataFrame, targets: dict[str, int]) -> DataFrame:
    """Per kind, current prose facts of enough confidence in order of date and ord, every k-th, as many as the kind's target."""
    wanted = F.create_map(*[x for k, n in targets.items() for x in (F.lit(k), F.lit(n))])
    sound = (F.col("status") == "current") & (F.col("confidence") >= V.MIN_CONFIDENCE)
    pool = facts.filter(sound & text.is_prose(F.col("content")) & F.col("kind").isin(list(targets))).withColumn("target", F.try_element_at(wanted, F.col("kind")))
    sizes = pool.groupBy("kind").agg(F.count(F.lit(1)).alias("size"))
    placed = pool.withColumn("nth", F.row_number().over(W.partitionBy("kind").orderBy("date_key", "ord"))).join(F.broadcast(sizes), "kind")
    step = F.greatest(F.lit(1), F.floor(F.col("size") / F.col("target")))
    picked = placed.filter(F.pmod(F.col("nth") - 1, step) == 0).withColumn("pick", F.floor((F.col("nth") - 1) / step) + 1)
    return picked.filter(F.col("pick") <= F.col("target")).select("kind", "pick", "id", "date_key")


def fuzz_queries(facts: DataFrame, count: int) -> DataFrame:
    """(id, query) of about ``count`` evenly spaced current facts: four tokens from the middle of their sorted set."""
    pool = facts.filter(F.col("status") != "superseded").withColumn("tokens", F.array_sort(text.content_tokens(F.col("content"))))
    size = pool.agg(F.count(F.lit(1)).alias("size"))
    rows = numbered(pool.select("id", "ord", "tokens"), [F.col("ord"), F.col("id")], "place").withColumn("nth", F.col("place") - 1).crossJoin(F.broadcast(size))
    step = F.greatest(F.lit(1), F.floor(F.col("size") / count))
    query = F.array_join(F.slice("tokens", F.floor(F.size("tokens") / 2).cast("int") + 1, 4), " ")
    # the slice comes first: a fact of fewer than two tokens takes its place and has no query
    return rows.filter(F.pmod("nth", step) == 0).filter(F.col("nth") < step * count).filter(F.size("tokens") >= 2).select("id", query.alias("query"))


def promotion_queue(facts: DataFrame) -> DataFrame:
    """X3, D7c, F13, U11s: promotable facts with target and risk; of equal target and text the first by ord."""
    content = F.regexp_replace(F.regexp_replace("content", r"^\[[A-Z_ -]+\]\s*", ""), r"^\s+|\s+$", "")
    upper, low = F.upper("content"), F.lower("content")
    target = (
        F.when(F.contains(upper, F.lit("AGENTS.MD")), "AGENTS.md").when(F.contains(upper, F.lit("CLAUDE.MD")), "CLAUDE.md").when(F.contains(low, F.lit("skill")), "skills/review")
        .when(F.contains(low, F.lit("hook")), "hooks/review").when(F.contains(low, F.lit("identity")) | F.contains(low, F.lit("invariant")), "identity/review").otherwise("review/project-rules.md")
    )
    pool = facts.filter(F.col("kind").isin(*PROMOTABLE) & (F.col("confidence") >= V.PROMOTION_CONFIDENCE) & (F.col("status") != "superseded"))
    risk = F.when(F.col("target").rlike("^(hooks|identity|skills)/"), "high").when(F.col("target").isin("CLAUDE.md", "AGENTS.md"), "medium").otherwise("low")
    rows = pool.select("id", "ord", "kind", content.alias("text"), target.alias("target")).withColumn("risk", risk)
    best = rows.groupBy("target", F.lower("text").alias("_t")).agg(F.min_by(F.struct("id", "ord", "kind", "text", "risk"), "ord").alias("r"))
    return best.select("r.id", "r.kind", "target", "r.risk", "r.text")


def recall_quality(gold: DataFrame, included: DataFrame, siblings: DataFrame) -> DataFrame:
    """Recall, mean companionship and its hit rate of gold (query, id) in included (query, id).

    Companions of a gold fact are the other facts of its session; siblings is (id, session_key).
    """
    hits = gold.join(included.withColumn("hit", F.lit(1)), ["query", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    own = gold.join(siblings, "id").select("query", F.col("id").alias("gold"), "session_key")
    others = own.join(siblings, "session_key").filter(F.col("id") != F.col("gold"))
    came = others.join(included.withColumn("came", F.lit(1)), ["query", "id"], "left").groupBy("query", "gold").agg(F.avg(F.coalesce("came", F.lit(0))).alias("share"))
    companions = hits.filter("hit = 1").join(came.withColumnRenamed("gold", "id"), ["query", "id"], "inner")
    a = hits.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("hit"), 4).alias("recall"))
    b = companions.agg(F.round(F.coalesce(F.avg("share"), F.lit(0.0)), 4).alias("companionship"), F.round(F.coalesce(F.avg((F.col("share") > 0).cast("int")), F.lit(0.0)), 4).alias("companion_rate"))
    return a.crossJoin(b)


def first_hits(suite: DataFrame, results: DataFrame) -> DataFrame:
    """(label, first_hit): the best rank at which a result (label, rank, id, content) meets its ground, id: or token: (null: never)."""
    both = suite.join(results, "label", "left")
    match = F.when(F.col("ground").startswith("id:"), F.col("id") == F.substring("ground", 4, 1 << 20)).otherwise(F.contains(F.lower("content"), F.lower(F.regexp_replace("ground", "^token:", ""))))
    return both.groupBy("label").agg(F.min(F.when(match, F.col("rank"))).alias("first_hit"))


def gate(before: float, after: float, floor: float, lever: float = 0.05) -> bool:
    """The diversity lever moves recall by enough, and recall is above the floor."""
    return after >= floor and after - before >= lever


def fixture_slice(facts: DataFrame, gold: DataFrame, session_key: Column, distractors: int) -> DataFrame:
    """(id, why): gold facts, facts of their sessions, and up to ``distractors`` others of each of their dates."""
    rows = facts.select("id", "ord", "date_key", session_key.alias("session_key"))
    own = rows.join(gold.select("id").distinct(), "id", "left_semi")
    siblings = rows.join(own.select("session_key").distinct(), "session_key", "left_semi").join(own.select("id"), "id", "left_anti")
    rest = rows.join(own.select("date_key").distinct(), "date_key", "left_semi").join(own.select("id"), "id", "left_anti").join(siblings.select("id"), "id", "left_anti")
    some = rest.withColumn("nth", F.row_number().over(W.partitionBy("date_key").orderBy("ord"))).filter(F.col("nth") <= distractors)
    return own.select("id", F.lit("gold").alias("why")).unionAll(siblings.select("id", F.lit("sibling").alias("why"))).unionAll(some.select("id", F.lit("distractor").alias("why")))


#: A note of an entity holds the facts of so many values of ord, so its size has a bound
NOTE_FACTS = 1000


def vault_notes(facts: DataFrame) -> DataFrame:
    """(path, body): a note per fact with links to its concepts, per decision, per concept with its facts and sessions, and an index of counts.

    Notes of concepts are paged by NOTE_FACTS values of ord. Square brackets of contents become round ones, so that contents make no links.
    """
    head = text.plain_brackets(F.substring("content", 1, 80))
    links = F.array_join(F.transform(text.concepts(F.col("content")), lambda c: F.concat(F.lit("[["), c, F.lit("]]"))), " ")
    of_facts = facts.select(
        F.concat(F.lit("facts/"), text.safe_name(F.col("id")), F.lit(".md")).alias("path"),
        F.concat(F.lit("# "), head, F.lit("\n\n"), text.plain_brackets(F.col("content")), F.lit("\n\n"), links).alias("body"),
    )
    decisions = facts.filter(F.col("kind") == "decision").select(
        F.concat(F.lit("decisions/"), text.safe_name(F.col("id")), F.lit(".md")).alias("path"),
        F.concat(F.lit("# "), "date_key", F.lit(" "), head, F.lit("\n\nstatus: "), "status", F.lit("\nfact: [["), text.safe_name(F.col("id")), F.lit("]]")).alias("body"),
    )
    session = F.when(text.stripped(F.coalesce("session", F.lit(""))) == "", "unknown").otherwise(text.stripped("session"))
    mentioned = facts.select("ord", text.safe_name(F.col("id")).alias("note"), session.alias("session_key"), F.floor(F.col("ord") / NOTE_FACTS).alias("page"), F.explode(text.concepts(F.col("content"))).alias("concept"))
    pages = mentioned.groupBy("concept", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "note"))).alias("notes"), F.array_sort(F.collect_set("session_key")).alias("sessions"))
    lines = F.array_join(F.transform("notes", lambda n: F.concat(F.lit("- [["), n["note"], F.lit("]]"))), "\n")
    entities = pages.select(
        F.concat(F.lit("entities/"), "concept", F.lit("-"), F.col("page").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("# "), "concept", F.lit("\n\nfacts: "), F.size("notes").cast("string"), F.lit("\n"), lines, F.lit("\n\nsessions: "), F.array_join("sessions", ", ")).alias("body"),
    )
    counts = facts.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("k"))
    index = listed.select(F.lit("index.md").alias("path"), F.concat(F.lit("# Index\n\n"), F.array_join(F.transform("k", lambda x: F.concat(F.lit("- "), x["kind"], F.lit(": "), x["n"].cast("string"))), "\n")).alias("body"))
    return of_facts.unionAll(decisions).unionAll(entities).unionAll(index)


def purge(facts: DataFrame, ids: list[str], needle: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, purged): facts of the given ids, or whose JSON holds a text whatever its case, go."""
    hit = F.col("id").isin(ids)
    if needle:
        hit = hit | F.contains(F.lower(F.to_json(F.struct(*facts.columns))), F.lit(needle.lower()))
    marked = facts.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return marked.filter(~F.col("_hit")).drop("_hit"), marked.filter("_hit").drop("_hit")


def purge_cascade(purged: DataFrame, events: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that purged facts rest on and vectors of purged facts, removed from their tables."""
    gone = purged.select(F.explode("evidence.event_id").alias("event_id")).distinct()
    return events.join(gone, "event_id", "left_anti"), vectors.join(purged.select(F.col("id").alias("fact_id")), "fact_id", "left_anti")


def live_secrets(lines: DataFrame, secrets: dict[str, str]) -> DataFrame:
    """(path, line_no, key) of lines that hold a secret's value (of 8 characters or more). The secrets are the query set."""
    keys = {k: v for k, v in secrets.items() if len(v) >= 8}
    if not keys:
        return lines.select("path", "line_no", F.lit("").alias("key")).limit(0)
    found = F.filter(F.array(*[F.when(F.contains("value", F.lit(v)), k) for k, v in keys.items()]), lambda k: k.isNotNull())
    return lines.select("path", "line_no", F.explode(found).alias("key"))


def children(facts: DataFrame, parent: str) -> DataFrame:
    """Ids of the facts that name a parent. Needs parent_fact_ids."""
    return facts.filter(F.array_contains("parent_fact_ids", parent)).select("id")


def proposal_queue(queue: DataFrame, candidates: DataFrame, live: DataFrame) -> DataFrame:
    """The queue with the candidates that are neither live nor queued appended as proposed."""
    from factloom.operators.setops import new_proposals

    fresh = new_proposals(candidates, live, queue).withColumn("status", F.lit("proposed"))
    return queue.unionByName(fresh.select(*queue.columns))


def queue_document(rows: DataFrame, name: str, dropped: int = 0) -> DataFrame:
    """A review queue as JSON lines (value): a head with its counts, then one line a row."""
    head = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(0).alias("_part"), F.to_json(F.struct(F.lit(name).alias("queue"), "rows", F.lit(dropped).alias("dropped"))).alias("value"))
    body = rows.select(F.lit(1).alias("_part"), F.to_json(F.struct(*rows.columns)).alias("value"))
    return head.unionAll(body).orderBy("_part", "value").select("value")


def rebuild_summary(result: dict) -> str:
    """What a rebuild did, as text."""
    verdict = "promoted" if result.get("promoted") else "refused"
    return "\n".join([f"Rebuild {verdict}", f"facts before: {result.get('before', 0)}", f"facts after: {result.get('after', 0)}", f"duplicate pairs: {result.get('duplicate_pairs', 'not checked')}"])
