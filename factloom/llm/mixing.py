"""Problem 9: mixing sources to target weights by soft membership.

A naive Bayes classifier, fitted on a bounded sample of the labelled table (documents with the source
they state), predicts how likely each document belongs to each domain; the stated source is evidence
that is wrong with probability ``LABEL_NOISE``. Document rates between 0 and the repeats that the
source allows are then fitted by projected gradient so that the expected tokens of the domains meet
their targets in the least-squares sense. A step needs the expected totals only (one small row a
task); a document's rate is kept in a column, to which every ``STEPS_A_CUT`` steps are applied at once. The steps
are scaled so that the loss falls with each; they end when it no longer falls by ``CLOSE`` of its scale.

A mix has ``of_whole`` times the tokens of all documents. The report has what was reached: a source is short if the
fitted rates use all its documents up to their cap and still supply less than its target.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import stripped
from factloom.llm.tokens import TOKENIZER_DIR, VOCABULARY, TokenCounter
from factloom.session import cut

MAX_LABELLED, MAX_HELD_OUT, MAX_DOMAINS, BUCKETS, LABEL_NOISE, OF_WHOLE = 10_000, 2_000, 1_000, 1 << 14, 0.01, 0.5
TRUSTS = (0.0, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
STEPS_A_CUT, CLOSE, AT_CAP = 8, 1e-6, 0.999


@lru_cache(maxsize=2)
def _counter(directory: str, vocabulary: str) -> TokenCounter:
    return TokenCounter(directory, vocabulary)


_bucket_of: dict[str, int] = {}


def _buckets(pieces: list[str]) -> np.ndarray:
    if len(_bucket_of) > 400_000:
        _bucket_of.clear()
    known = _bucket_of
    try:
        return np.array([known[p] for p in pieces], dtype=np.int32)
    except KeyError:
        for p in pieces:
            if p not in known:
                known[p] = zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS
        return np.array([known[p] for p in pieces], dtype=np.int32)


def tidy_source(source: Column) -> Column:
    return F.lower(stripped(source))


@dataclass
class Targets:
    sources: list[str]
    shares: np.ndarray
    repeats: np.ndarray


def read_targets(targets: DataFrame) -> Targets:
    """Targets by tidied source; repeated sources add their shares and keep the greater cap. Null sources drop."""
    rows = (
        targets.groupBy(tidy_source(F.col("source")).alias("source"))
        .agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("repeats"))
        .filter(F.col("source").isNotNull()).orderBy("source").limit(MAX_DOMAINS + 1).collect()
    )
    if len(rows) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} sources with a target")
    return Targets([r.source for r in rows], np.array([r.share for r in rows], dtype=float), np.array([r.repeats for r in rows], dtype=float))


def domain_of(source: Column, targets: Targets) -> Column:
    """Number of a source among the targets; the last number is for all sources without target, and null."""
    other = F.lit(len(targets.sources))
    if not targets.sources:
        return other
    numbers = F.create_map(*[x for i, s in enumerate(targets.sources) for x in (F.lit(s), F.lit(i))])
    return F.coalesce(F.try_element_at(numbers, tidy_source(source)), other)


def fit_domains(documents: DataFrame, targets: Targets, directory: str, vocabulary: str, max_labelled: int) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood per bucket and domain, log prior) from at most ``max_labelled`` documents, those whose ids hash lowest.

    The words of a text depend on each other, so their mean log likelihood counts as that of a number
    of words: the one of ``TRUSTS`` that predicts the sources of at most ``MAX_HELD_OUT`` other documents best, the
    next ones by hash. A table of fewer documents is divided four to one. The likelihood comes multiplied with the trust.
    """
    domains = len(targets.sources) + 1
    labelled = documents.filter(F.length("text") > 0).select("doc_id", domain_of(F.col("source"), targets).alias("domain"), "text")
    # only ids go through one task; the texts are picked where they are read
    lowest = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled + MAX_HELD_OUT)
    placed = cut(lowest.withColumn("place", F.row_number().over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))))
    first = min(max_labelled, placed.count() * 4 // 5)
    sample = labelled.join(F.broadcast(placed.filter(F.col("place") <= first).select("doc_id")), "doc_id", "left_semi")
    held_out = labelled.join(F.broadcast(placed.filter(F.col("place").between(first + 1, first + MAX_HELD_OUT)).select("doc_id")), "doc_id", "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(directory, vocabulary)
        seen, texts = np.zeros((domains, BUCKETS)), np.zeros(domains)
        for b in batches:
            for d, text in zip(b["domain"], b["text"]):
                np.add.at(seen[d], np.unique(_buckets(counter.pieces(text))), 1)
                texts[d] += 1
        d, k = np.nonzero(seen)
        yield pd.DataFrame({"domain": d, "bucket": k, "n": seen[d, k]})
        yield pd.DataFrame({"domain": np.arange(domains), "bucket": -1, "n": texts})

    rows = sample.mapInPandas(count, "domain int, bucket int, n double").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toPandas()
    seen, texts = np.ones((BUCKETS, domains)) * 0.5, np.zeros(domains)
    rest = rows["bucket"] >= 0
    seen[rows["bucket"][rest], rows["domain"][rest]] += rows["n"][rest]
    texts[rows["domain"][~rest]] = rows["n"][~rest]
    likelihood, prior = np.log(seen / seen.sum(axis=0)).astype(np.float32), np.log((texts + 1) / (texts + 1).sum())
    shared = documents.sparkSession.sparkContext.broadcast(likelihood)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(directory, vocabulary)
        for b in batches:
            yield pd.DataFrame({"domain": b["domain"], "scores": [_mean_likelihood(shared.value, counter.pieces(t)) for t in b["text"]]})

    judged = held_out.mapInPandas(judge, "domain int, scores array<float>").toPandas()
    if not len(judged):
        return likelihood * np.float32(0), prior
    scores, truth = np.stack(judged["scores"].to_numpy()).astype(float), judged["domain"].to_numpy()

    def loss(trust: float) -> float:
        z = prior + trust * scores
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    return likelihood * np.float32(min(TRUSTS, key=loss)), prior


def _mean_likelihood(likelihood: np.ndarray, pieces: list[str]) -> np.ndarray:
    return likelihood[np.unique(_buckets(pieces))].mean(axis=0)


def document_table(documents: DataFrame, targets: Targets, model: tuple[np.ndarray, np.ndarray], directory: str, vocabulary: str) -> DataFrame:
    """(doc_id, domain, tokens, member: array of the posteriors of the domains with a target)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    domains = len(targets.sources) + 1

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(directory, vocabulary)
        likelihood, prior = shared.value
        for b in batches:
            tokens, scores = np.zeros(len(b), np.int64), np.tile(prior, (len(b), 1))
            for i, text in enumerate(b["text"]):
                if text:
                    pieces = counter.pieces(text)
                    tokens[i] = sum(counter.sizes(pieces))
                    scores[i] += _mean_likelihood(likelihood, pieces)
            stated = np.full((len(b), domains), LABEL_NOISE / domains)
            stated[np.arange(len(b)), b["domain"]] += 1 - LABEL_NOISE
            scores += np.log(stated)
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            member = (scores / scores.sum(axis=1, keepdims=True))[:, :-1].astype(np.float32)
            yield pd.DataFrame({"doc_id": b["doc_id"], "domain": b["domain"], "tokens": tokens, "member": list(member)})

    rows = documents.select("doc_id", domain_of(F.col("source"), targets).alias("domain"), "text")
    return rows.mapInPandas(score, "doc_id long, domain int, tokens long, member array<float>")


def _moved(rate: np.ndarray, member: np.ndarray, most: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after gradient steps, each projected back to 0 .. the document's cap."""
    for g in steps:
        rate = np.clip(rate - member @ g, 0, most)
    return rate


def _with_rates(table: DataFrame, cap: np.ndarray, steps: np.ndarray) -> DataFrame:
    """The table with the steps applied to its column ``rate``; documents of no target stay at 0."""

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                most = np.append(cap, 0.0)[b["domain"].to_numpy()]
                yield b.assign(rate=_moved(b["rate"].to_numpy(), np.stack(b["member"].to_numpy()).astype(float), most, steps))

    return table.mapInPandas(move, "doc_id long, domain int, tokens long, member array<float>, rate double")


@dataclass
class Fit:
    """The fitted table (doc_id, domain, tokens, member, rate), the number of steps, and the root of the loss relative to its scale."""

    table: DataFrame
    steps: int
    error: float


def fit_rates(table: DataFrame, targets: Targets, wanted: np.ndarray) -> Fit:
    """Gradient steps that bring expected domain tokens to ``wanted`` as far as the caps let them, until they no longer help.

    Tokens weigh the domains: the loss is the sum of (reached - wanted)^2 / weight, weight a domain's expected tokens at
    rate 1 (what is wanted of it, if that is more). As memberships sum to 1 at most, a step of error / weight never raises it.
    """
    size, cap = len(targets.sources), targets.repeats
    sums = [F.sum(F.col("tokens") * F.col("member")[k]) for k in range(size)]
    weight = np.maximum(np.maximum(np.array([x or 0.0 for x in table.agg(*sums).first()], dtype=float), wanted), 1.0)
    scale = max(float((wanted**2 / weight).sum()), 1e-9)
    pending, taken, last = np.zeros((0, size)), 0, np.inf
    while True:

        def totals(batches: Iterator[pd.DataFrame], steps: np.ndarray = pending) -> Iterator[pd.DataFrame]:
            sums = np.zeros(size)
            for b in batches:
                if len(b):
                    member = np.stack(b["member"].to_numpy()).astype(float)
                    rate = _moved(b["rate"].to_numpy(), member, np.append(cap, 0.0)[b["domain"].to_numpy()], steps)
                    sums += (rate * b["tokens"].to_numpy()) @ member
            yield pd.DataFrame([sums], columns=[f"d{k}" for k in range(size)])

        parts = table.select("domain", "tokens", "member", "rate").mapInPandas(totals, ", ".join(f"d{k} double" for k in range(size)))
        error = np.array([x or 0.0 for x in parts.agg(*[F.sum(f"d{k}") for k in range(size)]).first()], dtype=float) - wanted
        loss = float((error**2 / weight).sum())
        if last - loss <= CLOSE * scale:
            return Fit(_with_rates(table, cap, pending), taken, float(np.sqrt(loss / scale)))
        last = loss
        pending, taken = np.vstack([pending, error / weight]), taken + 1
        if len(pending) == STEPS_A_CUT:
            table, pending = cut(_with_rates(table, cap, pending)), np.zeros((0, size))


@dataclass
class Mix:
    fit: Fit
    targets: Targets
    wanted: np.ndarray

    def copies(self) -> DataFrame:
        """(doc_id, source, tokens, rate, copies): how often each document enters the mix, never beyond its cap."""
        names = F.array(*[F.lit(s) for s in self.targets.sources], F.lit(None).cast("string"))
        # a fixed fraction of 1 for each document decides the fractional copy
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
        whole = F.floor(F.col("rate") + 1e-9)
        copies = (whole + (draw < F.col("rate") - whole).cast("long")).cast("long")
        return self.fit.table.select("doc_id", F.element_at(names, F.col("domain") + 1).alias("source"), "tokens", "rate", copies.alias("copies"))

    def report(self) -> DataFrame:
        """One row per source with a target: what it has, can supply, should and does supply, its share reached, and how well the rates fit.

        ``expected_tokens`` are supplied by the fitted rates, ``mixed_tokens`` by the whole copies drawn for them.
        """
        spark, t = self.fit.table.sparkSession, self.targets
        schema = "source string, target_share double, max_repeats long, target_tokens double"
        goals = spark.createDataFrame([(s, float(a), int(r), float(w)) for s, a, r, w in zip(t.sources, t.shares, t.repeats, self.wanted)], schema)
        sums = self.copies().filter(F.col("source").isNotNull()).groupBy("source").agg(
            F.sum("tokens").alias("available"), F.sum(F.col("tokens") * F.col("rate")).alias("expected"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed")
        )
        joined = goals.join(F.broadcast(sums), "source", "left").fillna({"available": 0, "expected": 0.0, "mixed": 0})
        total = joined.agg(F.greatest(F.sum("mixed"), F.lit(1)).alias("total"))
        return joined.crossJoin(F.broadcast(total)).select(
            "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), (F.col("available") * F.col("max_repeats")).alias("capacity_tokens"),
            "target_tokens", F.col("expected").alias("expected_tokens"), F.col("mixed").alias("mixed_tokens"), (F.col("mixed") / F.col("total")).alias("reached_share"),
            ((F.col("expected") >= AT_CAP * F.col("available") * F.col("max_repeats")) & (F.col("expected") < F.col("target_tokens"))).alias("short"),
            F.lit(self.fit.steps).alias("fit_steps"), F.lit(self.fit.error).alias("fit_error"),
        )


def mix(documents: DataFrame, targets: DataFrame, of_whole: float = OF_WHOLE, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, max_labelled: int = MAX_LABELLED) -> Mix:
    """Fits a mix of ``documents`` (doc_id, text, source) to ``targets`` (source, target_share, max_repeats).

    Sources are compared trimmed and lower-cased. Documents of sources without target, or without
    source, never enter the mix but count for the whole. Null and empty texts have no tokens. A source
    that can't supply its share is used up to its cap and marked ``short`` in the report.
    """
    goal = read_targets(targets)
    usable = documents.filter(F.col("doc_id").isNotNull())
    model = fit_domains(usable, goal, directory, vocabulary, max_labelled)
    table = cut(document_table(usable, goal, model, directory, vocabulary))
    sums = {r.domain: float(r.n or 0) for r in table.groupBy("domain").agg(F.sum("tokens").alias("n")).collect()}
    wanted = goal.shares * of_whole * sum(sums.values())
    have = np.array([max(sums.get(k, 0.0), 1.0) for k in range(len(goal.sources))])
    start = np.append(np.minimum(goal.repeats, wanted / have), 0.0)
    table = table.withColumn("rate", F.element_at(F.array(*[F.lit(float(x)) for x in start]), F.col("domain") + 1))
    fitted = fit_rates(table, goal, wanted) if goal.sources else Fit(table, 0, 0.0)
    return Mix(Fit(cut(fitted.table), fitted.steps, fitted.error), goal, wanted)


def short_sources(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source) of the sources that can't supply their target share of a mix half as large as all documents."""
    return mix(documents, targets).report().filter("short").select("source")
