"""Benchmark decontamination: every passage of the corpus queries a BM25 index of test items by block-max WAND.

Postings hold an item's BM25 weight of a term as a share of what the item scores with all its own terms, so one
threshold suits short and long items. A passage retrieves all items at or above it; lists are skipped by their upper
bounds, then by those of their blocks. Before that, passages are left out in which no item can reach the threshold:
its common terms count in full, its rare terms as far as the passage has them. Retrieved items are verified on the words: shingles of the question, words of
the answer; of items given as one text, also shingles of the whole item.

Passages are as long as the items need that are sought in them: items are indexed by classes of length, and those of a
class are sought in windows of twice that length, each half over the one before.

The index is broadcast in shards of at most ``SHARD_WORDS`` words of items (checked by a count; most benchmarks are
one shard), all with the term statistics of the whole benchmark; documents are read once per shard and never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvaspark.llm.licences import _PLAIN
from silvaspark.llm.native import word_count
from silvaspark.llm.parity_join import BASE, U, mix, word_hashes

K1, B = 1.2, 0.75
BLOCK = 64  # postings with one upper bound
LEAST = 0.5  # share of an item's own score that retrieves it
COMMON = 0.25  # share of an item's own score that its common terms may have together
SHINGLE = 5
QUESTION, ANSWER = 0.6, 0.5  # shares of the question's shingles and the answer's words that must be found
WINDOW = 128  # words of the shortest passages
SHARD_WORDS = 500_000  # about 100 MB of index in a worker


def words(text: str) -> np.ndarray:
    """Hashes of the words of a text without punctuation, A-Z lower-cased."""
    return word_hashes(text.encode().translate(_PLAIN))


def shingles(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, in order."""
    if len(w) < n:
        return np.zeros(0, U)
    h = np.zeros(len(w) - n + 1, U)
    for j in range(n):
        h = (h + w[j : len(w) - n + 1 + j]) * BASE
        h ^= h >> U(29)
    return mix(h)


def question_answer(text: str) -> tuple[str, str]:
    """The last sentence of an item is its answer, what stands before it the question; one sentence is a question."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if words(p).size]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


@dataclass
class Statistics:
    """What the weights of terms rest on: number of items, their words, and in how many items each term is."""

    n: int
    n_words: int
    terms: np.ndarray
    df: np.ndarray

    @staticmethod
    def of(items: list[np.ndarray]) -> Statistics:
        terms, df = np.unique(np.concatenate([np.zeros(0, U), *map(np.unique, items)]), return_counts=True)
        return Statistics(len(items), sum(map(len, items)), terms, df)

    def __add__(self, other: Statistics) -> Statistics:
        terms, place = np.unique(np.concatenate([self.terms, other.terms]), return_inverse=True)
        df = np.bincount(place, np.concatenate([self.df, other.df]), len(terms)).astype(np.int64)
        return Statistics(self.n + other.n, self.n_words + other.n_words, terms, df)


def span(n_words: int) -> int:
    """Class of an item's length: a power of two that holds it; its passages are twice as long."""
    return max(WINDOW // 2, 1 << (max(1, n_words) - 1).bit_length())


class Index:
    """Inverted index of items with block maxima."""

    def __init__(self, items: list[tuple[int, str, str]], whole: bool = False, of: Statistics | None = None):
        """``whole``: the items had no answer of their own, so that the whole item also counts; ``of``: all shards' statistics."""
        self.whole = whole
        self.ids = [i for i, _, _ in items]
        self.question = [words(q) for _, q, _ in items]
        self.answer = [np.unique(words(a)) for _, _, a in items]
        every = [np.concatenate([q, words(a)]) for q, (_, _, a) in zip(self.question, items, strict=True)]
        self.every = every if whole else []
        of = Statistics.of(every) if of is None else of
        self.span, mean = max(map(span, map(len, every)), default=span(0)), max(1.0, of.n_words / max(1, of.n))
        counts = [dict(zip(*(x.tolist() for x in np.unique(w, return_counts=True)), strict=True)) for w in every]
        own_terms = np.unique(np.concatenate(every)) if every else np.zeros(0, U)
        df = dict(zip(own_terms.tolist(), of.df[np.searchsorted(of.terms, own_terms)].tolist(), strict=True))
        idf = {t: float(np.log(1 + (of.n - n + 0.5) / (n + 0.5))) for t, n in df.items()}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, (c, w) in enumerate(zip(counts, every, strict=True)):
            weight = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in c.items()}
            own = sum(weight.values())
            for t, x in weight.items():
                postings[t].append((i, x / own))
        self.terms = np.array(sorted(postings), U)
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.terms & U(0xFFFF)).astype(np.int64)] = True
        self.items, self.shares, self.tops, self.bound = [], [], [], np.zeros(len(self.terms) + 1)
        for k, t in enumerate(self.terms.tolist()):
            p = postings[t]
            self.items.append([i for i, _ in p])
            self.shares.append([x for _, x in p])
            self.tops.append([max(self.shares[-1][j : j + BLOCK]) for j in range(0, len(p), BLOCK)])
            self.bound[k] = max(self.shares[-1])
        self._split_rare()

    def _split_rare(self) -> None:
        """Terms in few items are rare: so many that no item gets over ``COMMON`` from the others (``common``)."""
        df = np.array([*map(len, self.items), 0])
        self.common = np.zeros(len(self.ids))
        self.rare = df > 0
        for n in sorted({*df.tolist()} - {0}, reverse=True):
            more = self.common.copy()
            for k in np.flatnonzero(df == n):
                more[self.items[k]] += self.shares[k]
            if n < 2 or more.max() > COMMON:
                break
            self.common = more
            self.rare[df == n] = False
        self.first = np.concatenate([[0], np.cumsum(np.where(self.rare, df, 0))])  # rare postings end to end
        rare = np.flatnonzero(self.rare)
        self.post_items = np.array([i for k in rare for i in self.items[k]], np.int64)
        self.post_shares = np.array([x for k in rare for x in self.shares[k]])

    def possible(self, place: np.ndarray, size: int, step: int, least: float) -> list[int]:
        """Numbers of the passages (``size`` words from each ``step``) in which some item may reach ``least``."""
        at = np.flatnonzero(self.rare[place])
        if not len(at):
            return [0] if least <= self.common.max(initial=0) else []
        last = max(0, -(-(len(place) - size) // step)) if len(place) > size else 0
        window = at // step
        term, terms = place[at], len(self.terms) + 1
        pairs = []
        for back in range(-(-size // step)):
            k = window - back
            good = (k >= 0) & (k * step + size > at)
            pairs.append(np.minimum(k[good], last) * terms + term[good])
        key = np.unique(np.concatenate(pairs))
        window, term = key // terms, key % terms
        count = self.first[term + 1] - self.first[term]
        post = np.repeat(self.first[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
        both, inverse = np.unique(np.repeat(window, count) * len(self.ids) + self.post_items[post], return_inverse=True)
        sums = np.bincount(inverse, self.post_shares[post])
        good = sums + self.common[both % len(self.ids)] >= least - 1e-6
        return np.unique(both[good] // len(self.ids)).tolist()

    def places(self, w: np.ndarray) -> np.ndarray:
        """Term number of each word; the number of terms for words of no item."""
        out = np.full(len(w), len(self.terms))
        maybe = np.flatnonzero(self.low[(w & U(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.terms, w[maybe])
        good = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == w[maybe])
        out[maybe[good]] = at[good]
        return out

    def retrieve(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items whose shares over ``terms`` sum to ``least`` or more, by block-max WAND."""
        least -= 1e-9
        end = len(self.ids)
        lists = [[self.items[t][0], t, 0] for t in terms]  # current item, term, position
        found = []

        def forward(entry: list, item: int) -> None:
            p = bisect_left(self.items[entry[1]], item, entry[2])
            entry[2] = p
            entry[0] = self.items[entry[1]][p] if p < len(self.items[entry[1]]) else end

        while True:
            lists.sort()
            total, pivot = 0.0, -1
            for k, entry in enumerate(lists):
                if entry[0] == end:
                    break
                total += self.bound[entry[1]]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            total, skip = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else end
            for entry in lists[: pivot + 1]:
                own = self.items[entry[1]]
                p = bisect_left(own, item, entry[2])
                if p < len(own):
                    total += self.tops[entry[1]][p // BLOCK]
                    skip = min(skip, own[min(len(own), (p // BLOCK + 1) * BLOCK) - 1] + 1)
            if total < least:  # no item up to the first end of a block can reach the threshold
                for entry in lists[: pivot + 1]:
                    forward(entry, max(skip, item + 1))
            elif lists[0][0] == item:
                score = sum(self.shares[e[1]][e[2]] for e in lists[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                for entry in lists[: pivot + 1]:
                    forward(entry, item + 1)
            else:
                for entry in lists[:pivot]:
                    if entry[0] < item:
                        forward(entry, item)

    def overlap(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the question's shingles and of the answer's words that the passage has; an empty answer has 1."""
        q, a = self.question[item], self.answer[item]
        n = max(1, min(SHINGLE, len(q)))
        own = np.unique(shingles(q, n))
        got = np.isin(own, shingles(passage, n)).mean() if len(own) else 1.0
        return float(got), float(np.isin(a, passage).mean()) if len(a) else 1.0

    def holds(self, item: int, passage: np.ndarray) -> bool:
        """Whether the passage has enough of the whole item's shingles, wherever its last sentence begins."""
        own = self.every[item]
        n = max(1, min(SHINGLE, len(own)))
        return bool(np.isin(np.unique(shingles(own, n)), shingles(passage, n)).mean() >= QUESTION)

    def search(self, w: np.ndarray, least: float = LEAST) -> list[tuple[int, float, float, float, int]]:
        """Verified items in the words of a whole text: ``(item id, score, question share, answer share, first word)``.

        Passages overlap by their half, no item is longer, so each copy of an item lies whole in one; the best is given.
        """
        if not len(w) or not len(self.terms):
            return []
        place = self.places(w)
        size, step = 2 * self.span, self.span
        best: dict[int, tuple] = {}
        for s in (k * step for k in self.possible(place, size, step, least)):
            terms = np.unique(place[s : s + size])
            terms = terms[terms < len(self.terms)]
            if self.bound[terms].sum() < least - 1e-6:
                continue
            for item, score in self.retrieve(terms.tolist(), least):
                q, a = self.overlap(item, w[s : s + size])
                if (q >= QUESTION and a >= ANSWER or self.whole and self.holds(item, w[s : s + size])) and (item not in best or (q, a, score) > best[item][:3]):
                    best[item] = (q, a, score, s)
        return sorted((self.ids[i], score, q, a, s) for i, (q, a, score, s) in best.items())


def indexes(items: DataFrame) -> Iterator[list[Index]]:
    """Shards of ``items (item_id, text)`` or ``(item_id, question, answer)``, in each an index per class of length.

    Rows without an id or words are left out, repeated rows count once; an empty table has no shard.
    """
    if "question" in items.columns:
        items = items.select("item_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
        size = word_count(F.col("question")) + word_count(F.col("answer"))
    else:
        items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
        size = word_count(F.col("text"))
    items = items.where("item_id is not null").distinct()
    shards = -(-(items.agg(F.sum(size)).first()[0] or 0) // SHARD_WORDS)
    whole = "question" not in items.columns

    def parts(shard: int) -> list[tuple[int, str, str]]:
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).orderBy("item_id", items.columns[1]).toArrow().to_pylist()
        split = [(r["item_id"], *(question_answer(r["text"]) if whole else (r["question"], r["answer"]))) for r in rows]
        return [p for p in split if words(p[1]).size]

    def each(found: list[tuple[int, str, str]]) -> list[np.ndarray]:
        return [np.concatenate([words(q), words(a)]) for _, q, a in found]

    # weights do not depend on the number of shards; with more than one, items are read twice
    held = parts(0) if shards == 1 else None
    of = reduce(Statistics.__add__, (Statistics.of(each(held or parts(shard))) for shard in range(shards))) if shards else None
    for shard in range(shards):
        found = held or parts(shard)
        by_length = defaultdict(list)
        for item, w in zip(found, each(found), strict=True):
            by_length[span(len(w))].append(item)
        if found:
            yield [Index(some, whole, of) for _, some in sorted(by_length.items())]


def contamination(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs of documents and test items whose text they hold.

    Columns: ``doc_id, item_id, score, question_overlap, answer_overlap, first_word`` (start of the passage). Every word
    of every text is in a passage. Null and empty texts hold nothing; an empty benchmark gives no rows; repeated rows
    give repeated pairs; repeated items (same id and text) count once; other columns are not read.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    out = None
    for shard in indexes(items):
        found = _search(docs, shard, least, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def hits(shard: list[Index], text: str | None, least: float) -> list[tuple]:
    """What all indexes of a shard find in a whole text."""
    w = words(text or "")
    return sorted(hit for index in shard for hit in index.search(w, least))


def _search(docs: DataFrame, shard: list[Index], least: float, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *hit) for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in hits(shared.value, t.as_py(), least)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose texts hold no test item, all columns as they are; nothing is shuffled.

    Null and empty texts hold none and stay, as do all rows where the benchmark is empty; repeated rows stay or go alike.
    """
    for shard in indexes(items):
        docs = _clean(docs, shard, least)
    return docs


def _clean(docs: DataFrame, shard: list[Index], least: float) -> DataFrame:
    shared, at = docs.sparkSession.sparkContext.broadcast(shard), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not hits(shared.value, t.as_py(), least) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
