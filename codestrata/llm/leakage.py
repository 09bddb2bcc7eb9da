"""Evaluation texts that leak into training text: latent semantic retrieval, then checks of the words themselves.

The evaluation set is stated and of bounded size, so it is the query side: its words make the vocabulary, and all
documents are read into word numbers once. Passages of the corpus are TF-IDF vectors over that vocabulary; a distributed
randomised decomposition of all passages (one pass, summed up in a tree) gives the latent space. The items' passages are
indexed there in buckets around centres; every passage of every document is looked up in the buckets nearest to it by
cosine. Passages that share GRAM successive words with an item, along which enough others are in place, are candidates
whatever their cosine; every leak has such words. Candidates are checked by the longest common subsequence, then aligned
word by word: a leak is a run of at least MIN_WORDS successive words of an item that begins and ends with words in place,
of which at most one in six is changed, left out or joined by an added one. What is no such run but near in the latent
space, has most of an item's words in order and the words of its answer about it is a paraphrase.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.words import reader_words
from codestrata.session import cut, spread

#: Passages are three blocks of eight words, one from every block on: 14 successive words are within one of them.
STEP, BLOCKS = 8, 3
WINDOW = STEP * BLOCKS
ITEM_WINDOW, ITEM_STRIDE = 16, 8
#: A run of MIN_WORDS words with one change in six keeps this many of them within so many words of the document.
MIN_WORDS, CHANGES = 12, 6
NEED, SPAN = MIN_WORDS - MIN_WORDS // CHANGES, MIN_WORDS + MIN_WORDS // CHANGES
#: With three or four changes a leak of least extent keeps 15 words within 21 (20 within 28, of which any 21 hold 17).
LONG_NEED, LONG_SPAN = 15, 21
#: A leak of least extent (no part of it is a leak) has this many successive words of the item in place somewhere: 12 words
#: with 2 changes are 3 stretches with 10 words in place, 18 with 3 are 4 with 15, 24 with 4 are at most 4 with 20.
GRAM = 4
#: A leak of least extent has at most 4 changes, so one more than that is looked for. Its stretches in place are below 12
#: words, else one alone would do. Cut at an inner stretch (counted in both halves), one half has changes to spare, so it is
#: below 12 words and has a single change: the leak has at most three gaps, 22 words in place and 22 // 5 changes.
MOST_CHANGES = 5
#: Words of the document that a leak of least extent has at most; words that are aligned before and after a gram.
LEAST_EXTENT = 26
BEFORE, AFTER = 32, 48
#: Bounds of the stated side, which every task holds (checked): distinct words of all items.
MOST_WORDS = 200_000
#: A paraphrase has, beside the least cosine, this share of the words of an item's passage in order, and this share of the rarest words of the answer within so many words.
PARAPHRASE_SHARE, ANSWER_SHARE, ANSWER_WORDS, ANSWER_REACH = 0.6, 0.5, 6, 120
SCHEMA = "doc_id bigint, item_id string, part string, kind string, matched_words int, changes int, similarity double"


def longest_runs(doc: np.ndarray, item: np.ndarray, max_changes: int = 3) -> np.ndarray:
    """Longest run of item words found in doc with exactly e changes, of pairs in rows: (pairs, e).

    doc (pairs, n) and item (pairs, m) hold word numbers, below 0 for no word (item) and for words that no item has (doc);
    they never match. Whether a run of MIN_WORDS with one change in six exists is known from at most MOST_CHANGES changes.
    """
    pairs, m = item.shape
    none = np.int16(-10_000)
    before = np.full((max_changes + 1, pairs, m + 1), none, np.int16)
    best = np.zeros((pairs, max_changes + 1), np.int16)
    shift = np.where(item >= 0, item, -9)
    for j in range(doc.shape[1]):
        equal = shift == doc[:, j : j + 1]
        now = np.full_like(before, none)
        for e in range(max_changes + 1):
            diagonal = before[e, :, :-1]
            start = np.maximum(diagonal, 0) if e == 0 else diagonal
            step = np.where(equal, start + 1, none)
            now[e, :, 1:] = step
            if e:
                fewer = before[e - 1]
                changed = np.where(fewer[:, :-1] > 0, fewer[:, :-1] + 1, none)
                left_out = np.where(now[e - 1, :, :-1] > 0, now[e - 1, :, :-1] + 1, none)
                now[e, :, 1:] = np.maximum(now[e, :, 1:], np.maximum(changed, left_out))
                now[e] = np.maximum(now[e], np.where(fewer > 0, fewer, none))
            best[:, e] = np.maximum(best[:, e], step.max(1, initial=none))
        before = now
    return np.maximum(best, 0)


#: Places by which the alignment may leave the gram's own: its leak's changes, and those of a gram that another stands for.
BAND = 2 * (MOST_CHANGES - 1) + 1


def banded_runs(doc: np.ndarray, item: np.ndarray, max_changes: int) -> np.ndarray:
    """longest_runs of pairs in rows, of alignments in a band: doc (pairs, n) and item (pairs, n + 2 BAND), whose j + BAND-th word is opposite the j-th of doc."""
    pairs, width = len(doc), 2 * BAND + 1
    none = np.int16(-10_000)
    before = np.full((max_changes + 1, pairs, width + 2), none, np.int16)
    best = np.zeros((pairs, max_changes + 1), np.int16)
    item = np.where(item >= 0, item, -9)
    for j in range(doc.shape[1]):
        equal = item[:, j : j + width] == doc[:, j : j + 1]
        now = np.full_like(before, none)
        for e in range(max_changes + 1):
            same = before[e, :, 1:-1]
            step = np.where(equal, (np.maximum(same, 0) if e == 0 else same) + 1, none)
            best[:, e] = np.maximum(best[:, e], step.max(1, initial=none))
            if e:
                # A word changed, a word of the item left out (the item is one further), a word joined (it is one behind).
                changed, left_out, joined = before[e - 1, :, 1:-1], now[e - 1, :, :-2], before[e - 1, :, 2:]
                step = np.maximum(step, np.maximum(np.where(changed > 0, changed + 1, none), np.where(left_out > 0, left_out + 1, none)))
                step = np.maximum(step, np.where(joined > 0, joined, none))
            now[e, :, 1:-1] = step
        before = now
    return np.maximum(best, 0)


def common_subsequence(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of pairs in rows; numbers below 0 never match."""
    length = np.zeros((len(item), item.shape[1] + 1), np.int16)
    shift = np.where(item >= 0, item, -9)
    for j in range(doc.shape[1]):
        step = np.where(shift == doc[:, j : j + 1], length[:, :-1] + 1, 0)
        length[:, 1:] = np.maximum.accumulate(np.maximum(length[:, 1:], step), axis=1)
    return length[:, -1]


def _laid_out(pdf: pd.DataFrame, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all documents in one array, each begun at a block and apart from the next; starts and lengths."""
    docs = [np.frombuffer(t, np.int32) for t in pdf["terms"]]
    n = np.array([len(d) for d in docs], np.int64)
    room = -(-(n + WINDOW + BEFORE + AFTER) // STEP) * STEP
    starts = np.concatenate([[0], np.cumsum(room)])[: len(docs)] + BEFORE // STEP * STEP
    out = np.full(int(room.sum()) + BEFORE + AFTER, v, np.int32)
    for d, at in zip(docs, starts):
        out[at : at + len(d)] = d
    return out[: len(out) // STEP * STEP], starts, n


def _parts(batches: Iterator[pd.DataFrame], rows: int = 2000) -> Iterator[pd.DataFrame]:
    """The rows of all batches, so many at a time."""
    for pdf in batches:
        for lo in range(0, len(pdf), rows):
            yield pdf.iloc[lo : lo + rows]


def _passages(pdf: pd.DataFrame, v: int) -> np.ndarray:
    """Disjoint passages of all documents of a batch, without those that hold no known word."""
    a, _, _ = _laid_out(pdf, v)
    w = a[: len(a) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return w[(w < v).any(1)]


def _sum_tree(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of the matrices of all partitions, sixteen at a time until eight are left to collect."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.float64)
        for pdf in batches:
            for m in pdf["m"]:
                total += np.frombuffer(m, np.float32)
        yield pd.DataFrame({"m": [total.astype(np.float32).tobytes()]})

    n = parts.rdd.getNumPartitions()
    while n > 8:
        n = max(8, -(-n // 16))
        parts = parts.repartition(n).mapInPandas(add, "m binary")
    return sum((np.frombuffer(r["m"], np.float32).astype(np.float64) for r in parts.collect()), np.zeros(size))


def _latent(tokens: DataFrame, weight: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Projection (words, rank) onto the leading right singular vectors of the TF-IDF matrix A of all passages.

    One pass: A'A times a random orthonormal matrix, from which the range's own part of A'A is solved (Nyström).
    """
    v = len(weight)
    width = min(v, rank + 8)
    probe, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((v, width)))
    weighted = np.vstack([probe * weight[:, None], np.zeros((1, width))]).astype(np.float32)
    square = np.append(weight.astype(np.float32) ** 2, 0)
    of_word = np.append(weight, 0).astype(np.float32)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((v + 1, width), np.float32)
        for pdf in _parts(batches):
            passages = _passages(pdf, v)
            for lo in range(0, len(passages), 500):
                w = passages[lo : lo + 500]
                y = weighted[w.ravel()].reshape(len(w), WINDOW, width).sum(1) / np.maximum(square[w].sum(1), 1e-9)[:, None]
                order = np.argsort(w, axis=None, kind="stable")
                ids = w.ravel()[order]
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                total[ids[first]] += np.add.reduceat(y[order // WINDOW], first, axis=0) * of_word[ids[first], None]
        yield pd.DataFrame({"m": [total[:v].tobytes()]})

    product = _sum_tree(tokens.mapInPandas(part, "m binary"), v * width).reshape(v, width)
    product += (shift := 1e-7 * max(np.linalg.norm(product), 1e-9)) * probe
    values, vectors = np.linalg.eigh((inner := probe.T @ product) / 2 + inner.T / 2)
    root = vectors / np.sqrt(np.maximum(values, shift * 1e-3))
    u, _, _ = np.linalg.svd(product @ root, full_matrices=False)
    return u[:, :rank].astype(np.float32)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


@dataclass
class Buckets:
    """Vectors in buckets around centres; a look-up visits the `probe` nearest buckets."""

    centres: np.ndarray
    members: list[np.ndarray]
    vectors: np.ndarray
    probe: int = 8

    @classmethod
    def of(cls, vectors: np.ndarray, rounds: int = 6, probe: int = 8) -> Buckets:
        m = max(1, round(len(vectors) ** 0.5))
        centres = vectors[np.linspace(0, len(vectors) - 1, m).astype(int)]
        for _ in range(rounds):
            near = (vectors @ centres.T).argmax(1)
            total = np.zeros_like(centres)
            np.add.at(total, near, vectors)
            centres = _unit(np.where(np.bincount(near, minlength=m)[:, None] > 0, total, centres))
        near = (vectors @ centres.T).argmax(1)
        return cls(centres, [np.flatnonzero(near == k) for k in range(m)], vectors, probe)

    def search(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, cosine) of at least `least` in the visited buckets."""
        to = queries @ self.centres.T
        k = min(self.probe, len(self.centres))
        visited = np.argpartition(-to, k - 1, axis=1)[:, :k] if k < to.shape[1] else np.tile(np.arange(to.shape[1]), (len(to), 1))
        bucket, row = visited.ravel(), np.repeat(np.arange(len(queries)), visited.shape[1])
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(len(self.centres) + 1))
        out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32))]
        for b, member in enumerate(self.members):
            rows = row[order[edges[b] : edges[b + 1]]]
            if len(rows) and len(member):
                cosine = queries[rows] @ self.vectors[member].T
                r, c = np.nonzero(cosine >= least)
                out.append((rows[r], member[c], cosine[r, c]))
        return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class Items:
    """The items of a block as every task holds them."""

    names: list[tuple[str, str]]
    words: np.ndarray
    buckets: Buckets
    of_window: np.ndarray
    window_at: np.ndarray
    grams: np.ndarray
    gram_of: np.ndarray
    gram_at: np.ndarray
    answers: list[np.ndarray]

    @classmethod
    def of(cls, listed: list[tuple[str, str, np.ndarray, np.ndarray]], weight: np.ndarray, projection: np.ndarray) -> Items:
        v = len(weight)
        longest = max(len(w) for _, _, w, _ in listed)
        words = np.full((len(listed), longest + ITEM_WINDOW), -1, np.int32)
        for k, (_, _, w, _) in enumerate(listed):
            words[k, : len(w)] = w
        at = [np.arange(0, max(1, len(w) - ITEM_WINDOW + ITEM_STRIDE), ITEM_STRIDE) for _, _, w, _ in listed]
        of_window, window_at = np.repeat(np.arange(len(listed)), [len(x) for x in at]), np.concatenate(at)
        spots = words[of_window[:, None], window_at[:, None] + np.arange(ITEM_WINDOW)]
        scaled = np.vstack([projection * weight[:, None], np.zeros((1, projection.shape[1]), np.float32)])
        vectors = _unit(scaled[np.where(spots < 0, v, spots)].sum(1)).astype(np.float32)
        parts = np.lib.stride_tricks.sliding_window_view(words, GRAM, axis=1)
        gram_of, gram_at = np.nonzero((parts >= 0).all(2))
        key = _key(parts[gram_of, gram_at].T, v)
        order = np.argsort(key, kind="stable")
        rare = [a[np.argsort(-weight[a], kind="stable")[:ANSWER_WORDS]] for _, _, _, a in listed]
        return cls([(i, p) for i, p, _, _ in listed], words, Buckets.of(vectors), of_window, window_at, key[order], gram_of[order], gram_at[order], rare)


def _key(parts: np.ndarray, v: int) -> np.ndarray:
    """One number for GRAM successive words; equal words have equal numbers (beyond 64 bits it wraps: a few candidates more)."""
    key = np.zeros(parts.shape[1], np.int64)
    for row in parts:
        key = key * (v + 1) + row
    return key


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    parts: list[str],
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "id",
    answer: str | None = None,
    rank: int = 64,
    least_cosine: float = 0.8,
    block: int = 2000,
) -> DataFrame:
    """Every (document, item) with a leaked passage, with the part it comes from, its length, changes and cosine.

    `kind` is 'run' for a run of words in the sense above (one of the document is measured, without changes if it does), else 'paraphrase'. items hold the texts named in `parts` and
    perhaps the `answer` whose words a paraphrase needs about it. Documents are read into words once; items are looked up
    `block` at a time. Documents without an id, null and empty texts and items below MIN_WORDS words give no row; whole texts are read; repeated
    documents count once per id; other columns are left out.
    """
    texts = docs.select(F.col(doc_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    columns = list(dict.fromkeys([*parts, *([answer] if answer else [])]))
    stated = items.select(F.col(item_col).cast("string").alias("id"), *[F.col(p).cast("string").alias(p) for p in columns]).where(F.col("id").isNotNull()).orderBy("id")
    vocabulary: dict[str, int] = {}
    pages, last = [], None
    while True:
        rows = (stated if last is None else stated.where(F.col("id") > F.lit(last))).limit(block).collect()
        read = [(r["id"], {p: [vocabulary.setdefault(x, len(vocabulary)) for x in reader_words(r[p])] for p in columns}) for r in rows]
        if len(vocabulary) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} distinct words in the items")
        answers = {i: np.unique(np.array(w[answer] if answer else [], np.int32)) for i, w in read}
        if listed := [(i, p, np.array(w[p], np.int32), answers[i]) for i, w in read for p in parts if len(w[p]) >= MIN_WORDS]:
            pages.append(listed)
        if len(rows) < block:
            break
        last = rows[-1]["id"]
    spark = texts.sparkSession
    if not pages:
        return spark.createDataFrame([], SCHEMA)
    tokens, v = cut(_tokens(texts, vocabulary)), len(vocabulary)
    counted = {r["term"]: r["n"] for r in _counts(tokens, v).collect()}  # one row a word of the vocabulary and one for all passages
    passages = counted.pop(-1, 0)
    if not passages:
        return spark.createDataFrame([], SCHEMA)
    df = np.array([counted.get(t, 0) for t in range(v)], float)
    weight = np.log((1 + passages) / (1 + df) + 1e-9).clip(1e-3).astype(np.float32)
    projection = _latent(tokens, weight, min(rank, v))
    found = None
    for listed in pages:
        held = spark.sparkContext.broadcast((weight, projection, Items.of(listed, weight, projection)))  # bounded by the block and MOST_WORDS
        part = tokens.mapInPandas(_searcher(held, least_cosine), SCHEMA)
        found = part if found is None else found.unionByName(part)
    is_run = (F.col("kind") == "run").cast("int")
    best = F.max(F.struct(is_run.alias("r"), "matched_words", (-F.col("changes")).alias("c"), "similarity", "part", "kind")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.part", "b.kind", "b.matched_words", (-F.col("b.c")).alias("changes"), "b.similarity")


class _Numbers(dict):
    """Word numbers; the first free one for words that no item has."""

    def __missing__(self, word: str) -> int:
        return len(self)


def _tokens(texts: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, terms): the word numbers of every document, those of unknown words beyond all others."""
    held = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = _Numbers(held.value).__getitem__
        for pdf in batches:
            terms = [np.fromiter(map(number, reader_words(t)), np.int32) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "terms": [t.tobytes() for t in terms]})

    return spread(texts).mapInPandas(tokenise, "doc_id bigint, terms binary")


def _counts(tokens: DataFrame, v: int) -> DataFrame:
    """(term, n): passages that hold each word, over all passages; term -1 for their number."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(v + 1, np.int64)
        for pdf in _parts(batches):
            w = np.sort(_passages(pdf, v), 1)
            n += len(w)
            first = np.concatenate([np.ones((len(w), 1), bool), w[:, 1:] != w[:, :-1]], 1)
            df += np.bincount(w[first], minlength=v + 1)
        yield pd.DataFrame({"term": np.append(np.flatnonzero(df[:v]), -1), "n": np.append(df[:v][df[:v] > 0], n)})

    return tokens.mapInPandas(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _gram_hits(a: np.ndarray, v: int, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, item, place in the item) of shared grams along which NEED of SPAN words are in place."""
    known = a < v
    run = known[: len(a) - GRAM + 1].copy()
    for k in range(1, GRAM):
        run &= known[k : len(a) - GRAM + 1 + k]
    at = np.flatnonzero(run)
    key = _key(np.stack([a[at + k] for k in range(GRAM)]), v) if len(at) else np.zeros(0, np.int64)
    lo = np.searchsorted(items.grams, key)
    hit = lo < len(items.grams)
    hit[hit] = items.grams[lo[hit]] == key[hit]
    at, key, lo = at[hit], key[hit], lo[hit]
    n = np.searchsorted(items.grams, key, "right") - lo
    place = np.repeat(at, n)
    of = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    item, inside = items.gram_of[of], items.gram_at[of]
    keep = np.zeros(len(place), bool)
    reach = np.arange(GRAM - LONG_SPAN, LONG_SPAN)
    for lo in range(0, len(place), 20_000):
        p, c, j = place[lo : lo + 20_000], item[lo : lo + 20_000], inside[lo : lo + 20_000]
        words = a[np.clip(p[:, None] + reach, 0, len(a) - 1)]
        near, far = np.zeros(words.shape, bool), np.zeros(words.shape, bool)
        # Words left out or joined shift what follows by as many places as there are changes.
        for shift in range(1 - MOST_CHANGES, MOST_CHANGES):
            spot = j[:, None] + reach + shift
            same = (spot >= 0) & (spot < items.words.shape[1]) & (items.words[c[:, None], np.clip(spot, 0, items.words.shape[1] - 1)] == words)
            far |= same
            if abs(shift) <= MIN_WORDS // CHANGES:
                near |= same
        most = lambda m, span: ((t := np.concatenate([np.zeros((len(p), 1), np.int16), np.cumsum(m, 1, dtype=np.int16)], 1))[:, span:] - t[:, :-span]).max(1)
        keep[lo : lo + 20_000] = (most(near, SPAN) >= NEED) | (most(far, LONG_SPAN) >= LONG_NEED)
    return place[keep], item[keep], inside[keep]


class _Batch:
    """The documents of a batch against the items of a block."""

    def __init__(self, pdf: pd.DataFrame, v: int, items: Items, scaled: np.ndarray):
        self.items, self.v = items, v
        self.a, self.starts, self.lengths = _laid_out(pdf, v)
        self.ids = pdf["doc_id"].to_numpy()
        # Passages in the latent space: sums of blocks.
        step = 500 * STEP
        blocks = np.concatenate([scaled[self.a[lo : lo + step]].reshape(-1, STEP, scaled.shape[1]).sum(1) for lo in range(0, len(self.a), step)])
        known = (self.a < v).reshape(-1, STEP).sum(1)
        last = len(blocks) - BLOCKS + 1
        self.asked = np.flatnonzero(sum(known[k : last + k] for k in range(BLOCKS)) >= NEED)
        self.vectors = _unit(sum(blocks[k : last + k] for k in range(BLOCKS))[self.asked])
        self.leaked: set[tuple[int, int]] = set()
        self.out: list[tuple] = []

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def words_about(self, at: np.ndarray, before: int, after: int) -> np.ndarray:
        words = self.a[np.clip(at[:, None] + np.arange(-before, after), 0, len(self.a) - 1)]
        return np.where(words < self.v, words, -2)

    def near(self, least_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, window of an item, cosine): of an item's windows that a passage is near to, the nearest one."""
        found = [np.zeros((3, 0))]
        for lo in range(0, len(self.asked), 20_000):
            r, c, cosine = self.items.buckets.search(self.vectors[lo : lo + 20_000], least_cosine)
            order = np.lexsort((-cosine, self.items.of_window[c], r))
            r, c, cosine = r[order], c[order], cosine[order]
            first = np.ones(len(r), bool)
            first[1:] = (r[1:] != r[:-1]) | (self.items.of_window[c[1:]] != self.items.of_window[c[:-1]])
            found.append(np.stack([self.asked[lo + r[first]] * STEP, c[first], cosine[first]]))
        at, window, cosine = np.concatenate(found, axis=1)
        return at.astype(np.int64), window.astype(np.int64), cosine

    def found(self, doc: int, c: int, at: int, matched: int, changes: int) -> None:
        # The cosine of the passage that the gram begins in.
        i = int(np.searchsorted(self.asked, at // STEP))
        seen = i < len(self.asked) and self.asked[i] == at // STEP
        cosine = float((self.items.buckets.vectors[self.items.of_window == c] @ self.vectors[i]).max()) if seen else 0.0
        self.leaked.add((doc, c))
        self.out.append((int(self.ids[doc]), *self.items.names[c], "run", matched, changes, cosine))

    def verbatim(self, places: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Runs without changes through the grams of (document, item, place, place in the item); the places that have none of MIN_WORDS."""
        left = []
        for lo in range(0, len(places), 4000):
            doc, c, at, inside = (np.array(x) for x in zip(*places[lo : lo + 4000]))
            reach = np.arange(-BEFORE, AFTER)
            spot = inside[:, None] + reach
            words = np.where((spot >= 0) & (spot < self.items.words.shape[1]), self.items.words[c[:, None], np.clip(spot, 0, self.items.words.shape[1] - 1)], -1)
            same = words == self.words_about(at, BEFORE, AFTER)
            before = np.where(same[:, :BEFORE], 1, 0)[:, ::-1].cumprod(1).sum(1)
            run = before + np.where(same[:, BEFORE:], 1, 0).cumprod(1).sum(1)
            for k in range(len(run)):
                if run[k] >= MIN_WORDS:
                    self.found(int(doc[k]), int(c[k]), int(at[k]), int(run[k]), 0)
                else:
                    left.append(places[lo + k])
        return left

    def align(self, places: list[tuple[int, int, int, int]]) -> None:
        """Runs about (document, item, place, place in the item) by the longest common subsequence, then word by word."""
        for lo in range(0, len(places), 1000):
            doc, c, at, inside = (np.array(x) for x in zip(*places[lo : lo + 1000]))
            segment = self.words_about(at, BEFORE, AFTER)
            some = np.flatnonzero(common_subsequence(segment, self.items.words[c]) >= NEED)
            if not len(some):
                continue
            spot = inside[some, None] + np.arange(-BEFORE - BAND, AFTER + BAND)
            words = np.where((spot >= 0) & (spot < self.items.words.shape[1]), self.items.words[c[some, None], np.clip(spot, 0, self.items.words.shape[1] - 1)], -1)
            found = banded_runs(segment[some], words, MOST_CHANGES)
            fine = found >= np.maximum(MIN_WORDS, CHANGES * np.arange(found.shape[1]))
            for k, run, ok in zip(some.tolist(), found, fine):
                if ok.any():
                    e = int(np.flatnonzero(ok)[run[ok].argmax()])
                    self.found(int(doc[k]), int(c[k]), int(at[k]), int(run[e]), e)

    def runs(self) -> None:
        place, item, inside = _gram_hits(self.a, self.v, self.items)
        order = np.lexsort((place, item))
        kept: list[tuple[int, int, int, int]] = []
        for doc, c, at, j in zip(self.doc_of(place[order]).tolist(), item[order].tolist(), place[order].tolist(), inside[order].tolist()):
            # The words about one that is aligned anyway, on nearly the same diagonal, hold all that a near one might.
            near = (x for x in kept[-8:] if x[1] == c and at - x[2] <= AFTER - LEAST_EXTENT and abs((at - j) - (x[2] - x[3])) < MOST_CHANGES)
            if next(near, None) is None:
                kept.append((doc, c, at, j))
        # The first place of every document and item is read first, the others only where that is no leak; runs without
        # changes need no alignment.
        first = {x[:2]: x for x in reversed(kept)}
        self.align(self.verbatim(list(first.values())))
        self.align(self.verbatim([x for x in kept if x[:2] not in self.leaked and first[x[:2]] != x]))

    def paraphrases(self, least_cosine: float) -> None:
        items = self.items
        places, windows, cosines = self.near(least_cosine)
        for lo in range(0, len(places), 4000):
            at, w, cosine = places[lo : lo + 4000], windows[lo : lo + 4000], cosines[lo : lo + 4000]
            c = items.of_window[w]
            spot = items.window_at[w][:, None] + np.arange(-STEP, ITEM_WINDOW + STEP)
            words = np.where((spot >= 0) & (spot < items.words.shape[1]), items.words[c[:, None], np.clip(spot, 0, items.words.shape[1] - 1)], -1)
            size = np.minimum((items.words[c] >= 0).sum(1), ITEM_WINDOW)
            matched = np.minimum(common_subsequence(self.words_about(at, STEP, WINDOW + STEP), words), size)
            docs = self.doc_of(at + WINDOW - 1)  # a passage may begin before its document
            for k in np.flatnonzero(matched >= PARAPHRASE_SHARE * size).tolist():
                doc = int(docs[k])
                if (doc, int(c[k])) in self.leaked:
                    continue
                rare, start = items.answers[c[k]], self.starts[doc]
                about = self.a[max(start, at[k] - ANSWER_REACH) : min(start + self.lengths[doc], at[k] + WINDOW + ANSWER_REACH)]
                if not len(rare) or np.isin(rare, about).mean() >= ANSWER_SHARE:
                    self.out.append((int(self.ids[doc]), *items.names[c[k]], "paraphrase", int(matched[k]), int(size[k] - matched[k]), float(cosine[k])))


def _searcher(held, least_cosine: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, projection, items = held.value
        v = len(weight)
        scaled = np.vstack([projection * weight[:, None], np.zeros((1, projection.shape[1]), np.float32)]).astype(np.float32)
        for pdf in _parts(batches):
            batch = _Batch(pdf, v, items, scaled)
            batch.runs()
            batch.paraphrases(least_cosine)
            if batch.out:
                yield pd.DataFrame(batch.out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return search
