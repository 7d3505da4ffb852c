"""Problem 10: reading level of documents from the grades at which their words are acquired.

A word's grade is estimated from graded texts: its share of the prose of each level, levels weighed
alike, gives a distribution over levels, whose mean is the grade. A document is described by quantiles
of the grades of its known words; a multinomial regression calibrates those to levels.

The model is fitted on at most ``MAX_LABELLED`` labelled documents (those whose ids hash lowest) and knows the
words that MIN_RECORDS of them have, so what is gathered and sent to the tasks has a bound that the corpus can't
outgrow. Every document is then scored where it is read; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import stripped
from factloom.llm.common import WORD_PATTERN
from factloom.session import cut

MAX_LABELLED, MIN_RECORDS, MIN_PROSE_WORDS, LEVELS = 20_000, 3, 30, 5
QUANTILES = np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])

_FENCE = re.compile(r"(```|~~~)")
_LOG = re.compile(r"\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d\b|(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\b[ :]")
_COMMAND = re.compile(r"(?:\$|>>>|%|#!|sudo |git |pip |npm |curl |cd )\s*\S")
_CODE = re.compile(r"(?:def|class|import|from|return|const|let|var|function|public|private|SELECT|INSERT|UPDATE)\b.*[(;:={]\s*\S*$|\w[\w.]*\s*=\s*\S+\(|\w+\(.*\)[;:]?$|[})\];]+[,;]?$")
_RULE = re.compile(r"[-=*_#~+|: ]+$")
_LIST = re.compile(r"(?:[-*+•>]|\d+[.)])\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_NOTE = re.compile(WORD_PATTERN)


def prose_lines(text: str) -> list[str]:
    """The lines of a text that are prose: without code, logs, tables, JSON, commands and headings."""
    lines = [raw.strip() for raw in text.splitlines()]
    out: list[str] = []
    fenced, depth, inside = False, 0, False  # inside: the line before is prose
    for i, line in enumerate(lines):
        before, inside = inside, False
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or not line:
            continue
        first = line[0]
        if depth or (first in "{[" and line[-1] in "{[,}]"):
            depth = max(0, depth + line.count("{") + line.count("[") - line.count("}") - line.count("]"))
            continue
        if first in "#|$" or "\t" in line or _RULE.match(line) or _LOG.match(line) or _COMMAND.match(line) or _CODE.match(line):
            continue
        item = _LIST.match(line)
        if not item and len(line) < 80 and line[-1] not in ".!?…:;,\"'”)" and len(line.split()) <= 8:
            # a short line that stands alone, or is underlined, is a heading
            after = lines[i + 1] if i + 1 < len(lines) else ""
            if not before and (not after or _RULE.match(after)):
                continue
        out.append(line[item.end() :] if item else line)
        inside = True
    return out


def prose_words(text: str | None) -> tuple[list[str], int]:
    """Words to grade of the prose of a text, and its number of words of a-z and 0-9. Null has none."""
    if not text:
        return [], 0
    joined = " ".join(prose_lines(text)).lower()
    return _WORD.findall(joined), len(_NOTE.findall(joined))


@dataclass
class LevelModel:
    grades: dict[str, float]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def describe(self, words: list[str]) -> np.ndarray:
        known = np.array([g for g in map(self.grades.get, words) if g is not None])
        if not len(known):
            known = np.array([(1 + LEVELS) / 2])
        return np.append(np.quantile(known, QUANTILES), known.mean())

    def _design(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.spread
        products = [z[:, [i]] * z[:, i:] for i in range(z.shape[1])]
        return np.hstack([z, *products, np.ones((len(z), 1))])

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        score = self._design(features) @ self.weights
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def calibrate(self, features: np.ndarray, levels: np.ndarray, steps: int = 400, decay: float = 1e-3) -> None:
        self.mean, self.spread = features.mean(axis=0), features.std(axis=0) + 1e-6
        design, target = self._design(features), np.eye(LEVELS)[levels - 1]
        self.weights = np.zeros((design.shape[1], LEVELS))
        one, two = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for t in range(1, steps + 1):
            score = design @ self.weights
            score = np.exp(score - score.max(axis=1, keepdims=True))
            step = design.T @ (score / score.sum(axis=1, keepdims=True) - target) / len(design) + decay * self.weights
            one, two = 0.9 * one + 0.1 * step, 0.999 * two + 0.001 * step**2
            self.weights = self.weights - 0.1 * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.999**t)) + 1e-8)


def is_english(lang: Column) -> Column:
    return F.coalesce(F.lower(stripped(lang)).rlike("^(en|eng|english)([-_.].*)?$"), F.lit(False))


def _split_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "level": b["level_no"], "words": [prose_words(t)[0] for t in b["text"]]})


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> LevelModel:
    """Grades of words and their calibration from labelled documents; labels outside 1 to 5 are ignored."""
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("level_no").between(1, LEVELS)).groupBy("doc_id").agg(F.min("level_no").alias("level_no"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    words = cut(texts.mapInPandas(_split_words, "doc_id long, level int, words array<string>").filter(F.size("words") >= 10))
    per_level = dict(words.groupBy("level").count().collect())
    if not per_level:
        return LevelModel({}, np.zeros(len(QUANTILES) + 1), np.ones(len(QUANTILES) + 1), np.zeros((1, LEVELS)))
    shares = words.select("level", (1.0 / F.size("words")).alias("share"), F.explode("words").alias("w"), "doc_id")
    sums = [(F.sum(F.when(F.col("level") == k, F.col("share"))) / per_level[k]).alias(f"s{k}") for k in sorted(per_level)]
    table = shares.groupBy("w").agg(F.count_distinct("doc_id").alias("records"), *sums).filter(F.col("records") >= MIN_RECORDS)
    rows = table.orderBy("w").toPandas()
    mass = rows[[f"s{k}" for k in sorted(per_level)]].fillna(0.0).to_numpy()
    grade = mass @ np.array(sorted(per_level)) / mass.sum(axis=1)
    model = LevelModel(dict(zip(rows["w"], grade)), np.zeros(1), np.ones(1), np.zeros(1))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "level": b["level"], "features": [shared.value.describe(w) for w in b["words"]]})

    known = words.mapInPandas(describe, "doc_id long, level int, features array<double>").orderBy("doc_id").toPandas()
    model.calibrate(np.stack(known["features"].to_numpy()), known["level"].to_numpy())
    return model


def reading_levels(documents: DataFrame, model: LevelModel) -> DataFrame:
    """(doc_id, prose_words, level, p_hard): level of highest probability and the probability of level 4 or 5.

    Every row gets a result; a document of fewer than 30 words of prose has level null.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            read = [prose_words(t) for t in b["text"]]
            out = pd.DataFrame({"doc_id": b["doc_id"], "prose_words": [n for _, n in read], "level": None, "p_hard": None})
            fit_for = np.array([n >= MIN_PROSE_WORDS for _, n in read], dtype=bool)
            if fit_for.any() and m.grades:
                p = m.probabilities(np.array([m.describe(w) for (w, _), ok in zip(read, fit_for) if ok]))
                out.loc[fit_for, "level"] = p.argmax(axis=1) + 1
                out.loc[fit_for, "p_hard"] = p[:, 3:].sum(axis=1)
            yield out.astype({"level": "Int32", "p_hard": "Float64"})

    return documents.select("doc_id", "text").mapInPandas(score, "doc_id long, prose_words int, level int, p_hard double")


def hard_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id) of English documents whose prose is of level 4 or 5."""
    english = documents.filter(is_english(F.col("lang")) & F.col("doc_id").isNotNull())
    return reading_levels(english, fit(english, labels)).filter(F.col("p_hard") >= 0.5).select("doc_id")
