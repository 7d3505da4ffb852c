"""Problem 8: evaluation texts in training text, by an FM-index per shard of the corpus.

Every shard (documents up to ``SHARD_WORDS`` words, whole documents) is indexed as a text of words.
Words that no test item uses share one symbol, which no phrase contains, so the index is exact with
the alphabet of the items. Every run of ``PHRASE_WORDS`` words of every item is searched backwards,
its occurrences located by sampled positions and joined to spans. Documents stay in the task that
reads them; nothing but the findings is shuffled.

The items are the stated query set. They go to the tasks in blocks of at most ``BLOCK_ITEMS`` items
and ``BLOCK_CHARS`` characters, one after the other, so what the driver and a task hold has a bound; more items mean more passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WORD_PATTERN
from factloom.llm.fm_index import FMIndex
from factloom.session import cut

PHRASE_WORDS, SHARD_WORDS, BLOCK_ITEMS, BLOCK_CHARS = 12, 1_000_000, 20_000, 16_000_000
GAP, OTHER = 1, 2  # symbols of a document's end and of words that no item has


class Phrases:
    """The distinct runs of ``width`` words of some items, as symbols."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.symbols: dict[str, int] = {}
        spelled = [(i, [self.symbols.setdefault(w, len(self.symbols) + 3) for w in re.findall(WORD_PATTERN, text.lower())]) for i, text in items]
        owners: dict[tuple[int, ...], set[int]] = {}
        for i, w in spelled:
            for k in range(len(w) - width + 1):
                owners.setdefault(tuple(w[k : k + width]), set()).add(i)
        self.width = width
        self.alphabet = len(self.symbols) + 3
        self.phrases = np.array(list(owners), dtype=np.int64).reshape(len(owners), width)
        self.owner_lists = [np.array(sorted(o)) for o in owners.values()]


def _leaks(items: list[tuple[int, str]], width: int, shard_words: int):
    def shard(ids: list[int], parts: list[np.ndarray], phrases: Phrases) -> pd.DataFrame | None:
        text = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        index = FMIndex(text, phrases.alphabet)
        low, high = index.search(phrases.phrases)
        n = high - low
        if not n.sum():
            return None
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        at = index.locate(rows)
        doc = np.searchsorted(ends, at, side="right")
        starts = at - (ends - np.array([len(p) for p in parts]))[doc]
        owners = [phrases.owner_lists[p] for p in which]
        times = np.array([len(o) for o in owners])
        hits = pd.DataFrame({"doc": np.repeat(doc, times), "item_id": np.concatenate(owners), "at": np.repeat(starts, times)}).sort_values(["doc", "item_id", "at"], ignore_index=True)
        # phrases that overlap or touch in one document and item are one span
        fresh = (hits["doc"] != hits["doc"].shift()) | (hits["item_id"] != hits["item_id"].shift()) | (hits["at"] > hits["at"].shift() + width)
        spans = hits.groupby(fresh.cumsum()).agg(doc=("doc", "first"), item_id=("item_id", "first"), from_word=("at", "min"), to_word=("at", "max"))
        spans["to_word"] += width
        spans["doc_id"] = np.array(ids, dtype=np.int64)[spans["doc"].to_numpy()]
        return spans[["doc_id", "item_id", "from_word", "to_word"]]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases = Phrases(items, width)
        if not len(phrases.phrases):
            return
        find, symbol = re.compile(WORD_PATTERN).findall, phrases.symbols.get
        ids: list[int] = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = [symbol(w, OTHER) for w in find(text.lower())]
                if len(found) < width:
                    continue
                found.append(GAP)
                ids.append(doc_id)
                parts.append(np.array(found, dtype=np.int32))
                held += len(found)
                if held >= shard_words:
                    if (out := shard(ids, parts, phrases)) is not None:
                        yield out
                    ids, parts, held = [], [], 0
        if parts and (out := shard(ids, parts, phrases)) is not None:
            yield out

    return scan


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.filter(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).select("item_id", "item_text").toLocalIterator():
        block.append((row.item_id, row.item_text))
        size += len(row.item_text)
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_spans(documents: DataFrame, items: DataFrame, phrase_words: int = PHRASE_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, from_word, to_word): stretches of a document's words that stand in an item too.

    Words count from 0, ``to_word`` is exclusive. Null texts and ids have no rows; items of fewer than
    ``phrase_words`` words are never found; a document with repeated rows repeats its spans.
    """
    corpus = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    schema = "doc_id long, item_id long, from_word long, to_word long"
    found: DataFrame | None = None
    held: list[tuple[int, str]] | None = None
    for block in _blocks(items):
        if held is not None:
            # another block follows: the findings of this one are written before it is let go
            part = cut(corpus.mapInPandas(_leaks(held, phrase_words, shard_words), schema))
            found = part if found is None else found.unionAll(part)
        held = block
    if held is None:
        return corpus.select("doc_id", F.col("doc_id").alias("item_id"), F.lit(0).cast("long").alias("from_word"), F.lit(0).cast("long").alias("to_word")).limit(0)
    last = corpus.mapInPandas(_leaks(held, phrase_words, shard_words), schema)
    return last if found is None else found.unionAll(last)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) that share at least 12 consecutive words."""
    return leaked_spans(documents, items).select("doc_id", "item_id").distinct()
