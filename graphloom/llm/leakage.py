"""Evaluation texts leaking into training text (problem 6).

Items and documents become sequences of words: letter case, punctuation, markup,
comment signs and line layout are gone. Then

1. *SimHash windows*: every window of ``SIZES`` words, up to what long items have,
   of items and documents gets a 64-bit fingerprint: the weighted majority of its
   word pairs' bits. A leak may hold only two fifths of an item and has changed
   words, so windows of the item's own size alone lie outside any usable radius;
2. *Multi-index Hamming*: fingerprints are cut into ``RADIUS`` + 1 blocks. Two
   fingerprints within the radius agree in at least one block, so looking up all
   blocks finds every window pair within the radius. Items with fewer than
   ``SHORT`` words have too few windows for changes; they are looked up by their
   loose shingles;
3. *Exact shingle similarity*: a loose shingle is ``SHINGLE`` words that follow
   each other in steps of at most ``NEAR``. A candidate stays if the item words in
   common loose shingles make up the share, where stock phrases weigh nothing.
   What is counted in 4. stands in such a shingle, so else this drops no leak;
4. *Alignment*: the best alignment is found by dynamic programming over all
   words that item and document share. A stretch is ``SHINGLE`` or more words in
   the item's order, each at most ``NEAR`` words after the one before in both
   texts (single changed, added or dropped words don't end it); stretches are
   chained in the item's order, close together. A document holds an item if a
   chain has at least ``SHARE`` of the item's words.

Items are the stated query set: they are taken in blocks of bounded size, each
block's index is broadcast to the tasks, and all documents pass by; nothing of
the documents is shuffled. However many items there are, every block is held
against all documents.

Cases: null or wordless texts and items leak nothing; items under four words may
have one word changed, those under three none; repeated documents and items
each count; ids are kept as they are.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import spread

#: Words of a window: ``max(STEPS)`` more than powers of two, up to what longer items have.
SIZES = (5, 7, 11, 19, 35)
#: Items with fewer words (eight windows of the least size) are looked up by their loose shingles.
SHORT = 8 * SIZES[0]
#: Distances of the words of a pair; the heaviest weight (96 pairs of it are still an int32).
STEPS, _HEAVIEST = (1, 2, 3), 2.0**24
RADIUS = 3
#: Share of an item's words that makes a leak.
SHARE = 0.4
#: Words between two runs, and difference of their distances in item and document, that still count as close.
GAP, SHIFT = 24, 16
#: Least words of a stretch, and most words from one of them to the next.
SHINGLE, NEAR = 3, 2
#: Surroundings (or share of the items), and items, from which on a shingle is a stock phrase.
STOCK_PLACES, STOCK_SHARE, STOCK_ITEMS = 6, 0.015, 3
#: Items per broadcast block, and letters of their texts; a word takes about 200 bytes of the index in each worker.
ITEMS_PER_BLOCK, TEXT_PER_BLOCK = 20_000, 4 << 20
_CHUNK = 24_000  # words fingerprinted at once in a task
_HITS = 2_000_000  # common shingles counted at once in a task (a single document may have more)

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|&#?\w{1,8};")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words of a text without markup, in lower case."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """64-bit hashes of words; starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def hashes_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_pairs(hashes: np.ndarray, step: int) -> np.ndarray:
    """Feature of each word and the one ``step`` words later, in this order."""
    a, b = hashes[:-step], hashes[step:]
    return _mixed(a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(1)) | (b >> np.uint64(63))))


class _Known:
    """Sorted keys with a table of their low bits, which most strange keys fail."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.mask = np.uint64((1 << max(16, int(32 * len(keys)).bit_length())) - 1)
        self.there = np.zeros(int(self.mask) + 1, dtype=bool)
        self.there[(keys & self.mask).astype(np.int64)] = True

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be among the known."""
        return self.there[(keys & self.mask).astype(np.int64)]


class Weights:
    """Weight of a feature: the rarer among the items the heavier, times a factor with a long tail that depends on the feature alone.

    In nearly every window one feature outweighs most of the others, so that the
    fingerprint follows it: words that change elsewhere in the window turn over
    few bits, which the radius allows for. With equal weights one changed word
    of six turns over 14 of 64 bits in the median.
    """

    def __init__(self, items: list[np.ndarray]) -> None:
        own = [np.unique(np.concatenate([word_pairs(h, s) for s in STEPS])) for h in items if len(h) > max(STEPS)]
        features, self.counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(1, dtype=np.uint64), np.ones(1, dtype=np.int64))
        self.known = _Known(features)

    def of(self, features: np.ndarray) -> np.ndarray:
        often = np.ones(len(features), dtype=np.int64)
        maybe = np.flatnonzero(self.known.maybe(features))
        at = np.minimum(np.searchsorted(self.known.keys, features[maybe]), len(self.counts) - 1)
        often[maybe] = np.where(self.known.keys[at] == features[maybe], self.counts[at], 1)
        tail = ((_mixed(features ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(11)) + np.uint64(1)).astype(np.float64) / 2.0**53
        return np.minimum(_HEAVIEST, np.ceil(64.0 / (tail * often))).astype(np.int32)


def fingerprints(hashes: np.ndarray, weights: Weights) -> dict[int, np.ndarray]:
    """SimHash of every window of each size: the weighted majority of its word pairs' bits. A window's words say all about it."""
    out: dict[int, np.ndarray] = {}
    n = len(hashes) - max(STEPS)
    if n < 1:
        return {size: np.zeros(0, dtype=np.uint64) for size in SIZES}
    sums = np.zeros((n, 64), dtype=np.int32)
    for step in STEPS:
        features = word_pairs(hashes, step)[:n]
        signs = np.unpackbits(features.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8) * np.int8(2) - np.int8(1)
        sums += signs * weights.of(features)[:, None]
    width = 1  # pairs that begin at so many places are in a row of sums
    for size in SIZES:
        while width < size - max(STEPS):
            sums = sums[:-width] + sums[width:]
            width *= 2
        out[size] = np.packbits(sums > 0, axis=1).view(np.uint64).ravel()
    return out


class HammingIndex:
    """Multi-index over fingerprints: all within the radius are found."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS) -> None:
        self.prints, self.radius = prints, radius
        blocks = radius + 1
        self.shifts = [np.uint64(b * (64 // blocks)) for b in range(blocks)]
        width = min(16, 64 // blocks)  # of a wider block the first bits are looked up
        self.mask = np.uint64((1 << width) - 1)
        self.tables = []
        for shift in self.shifts:
            keys = ((prints >> shift) & self.mask).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            self.tables.append((order, np.searchsorted(keys[order], np.arange((1 << width) + 1))))

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``prints``, position in the index) within the radius; a pair may come more than once."""
        left, right = [], []
        for shift, (order, starts) in zip(self.shifts, self.tables):
            keys = ((prints >> shift) & self.mask).astype(np.int64)
            begin, count = starts[keys], starts[keys + 1] - starts[keys]
            total = int(count.sum())
            if not total:
                continue
            a = np.repeat(np.arange(len(prints)), count)
            offset = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            b = order[np.repeat(begin, count) + offset]
            near = np.bitwise_count(prints[a] ^ self.prints[b]) <= self.radius
            left.append(a[near])
            right.append(b[near])
        if not left:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(left), np.concatenate(right)


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    places: dict[str, int] = defaultdict(int)
    for i, x in enumerate(a):
        places[x] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def stretch_of(words: int) -> int:
    """Least words of a stretch for an item of so many words."""
    return min(SHINGLE, max(min(words, 2), words - 1))


def loose_shingles(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, places) of all ``k`` words in steps of at most ``NEAR``; places has a row of ``k`` positions for each."""
    keys, places = [], []
    for steps in itertools.product(range(1, NEAR + 1), repeat=k - 1):
        offsets = [0, *itertools.accumulate(steps)]
        at = np.arange(max(0, len(hashes) - offsets[-1]))[:, None] + np.array(offsets)
        key = np.zeros(len(at), dtype=np.uint64)
        for column in at.T:
            key = (key ^ hashes[column]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys.append(key)
        places.append(at)
    return np.concatenate(keys), np.concatenate(places)


def _surroundings(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The words before and after each shingle, as one number."""
    padded = np.concatenate([np.zeros(1, dtype=np.uint64), hashes, np.zeros(1, dtype=np.uint64)])
    return _mixed(padded[places[:, 0]] * np.uint64(0x9E3779B97F4A7C15) + padded[places[:, -1] + 2])


def _stock(keys: np.ndarray, around: np.ndarray, owners: np.ndarray, least: float) -> np.ndarray:
    """Whether each key is one that stands in at least so many surroundings, and in ``STOCK_ITEMS`` items."""
    names, at = np.unique(keys, return_inverse=True)
    count = lambda other: np.bincount(np.unique(np.stack([at.astype(np.uint64), other.astype(np.uint64)]), axis=1)[0].astype(np.int64), minlength=len(names))
    return ((count(around) >= least) & (count(owners) >= STOCK_ITEMS))[at]


class ShingleIndex:
    """Loose shingles of items that have the same least stretch, with the item words in each.

    Stock phrases weigh nothing: a whole shingle that stands in many different
    surroundings, in several items, is a phrase of the language (``the _ of every``),
    and items and documents that have no more in common than such phrases share
    them by chance. Repeated items and variants of one have the same surroundings.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], k: int) -> None:
        self.k = k
        found = [loose_shingles(h, k) for _, h in items]
        keys = np.concatenate([key for key, _ in found])
        owners = np.repeat([i for i, _ in items], [len(key) for key, _ in found])
        order = np.argsort(keys, kind="stable")
        if k == SHINGLE:
            around = np.concatenate([_surroundings(h, at) for (_, h), (_, at) in zip(items, found)])
            order = order[~_stock(keys, around, owners, max(STOCK_PLACES, STOCK_SHARE * len(items)))[order]]
        self.keys = keys[order]
        self.known = _Known(self.keys)
        self.places = np.concatenate([at for _, at in found]).astype(np.int32)[order]
        self.owners = owners[order]

    def common(self, hashes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document, row of the index) of shingles that both hold, whole documents at a time; owner: the document of each word, ascending."""
        keys, at = loose_shingles(hashes, self.k)
        maybe = np.flatnonzero(self.known.maybe(keys))
        keys, at = keys[maybe], at[maybe]
        docs = owner[at[:, 0]]
        inside = docs == owner[at[:, -1]]
        keys, docs = keys[inside], docs[inside]
        order = np.lexsort((keys, docs))
        keys, docs = keys[order], docs[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        keys, docs = keys[new], docs[new]
        begin = np.searchsorted(self.keys, keys, "left")
        count = np.searchsorted(self.keys, keys, "right") - begin
        hit = count > 0
        docs, begin, count = docs[hit], begin[hit], count[hit]
        total = np.cumsum(count)
        first = 0
        while first < len(docs):
            last = int(np.searchsorted(total, (total[first - 1] if first else 0) + _HITS, "right"))
            if last < len(docs):
                last = int(np.searchsorted(docs, docs[last], "left"))
            if last <= first:
                last = int(np.searchsorted(docs, docs[first], "right"))
            b, c = begin[first:last], count[first:last]
            yield np.repeat(docs[first:last], c), np.repeat(b, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            first = last

    def similar(self, near: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Those of the near pairs (document times the number of items, plus item; ascending) whose common loose shingles hold the share of the item's words.

        Items with fewer than ``SHORT`` words have too few windows for changes: for
        them every document with a common shingle is near.
        """
        good = [np.zeros(0, dtype=np.int64)]
        for docs, rows in self.common(hashes, owner):
            items = self.owners[rows]
            pair = docs * len(lengths) + items
            wanted = lengths[items] < SHORT
            if len(near):
                wanted |= near[np.minimum(np.searchsorted(near, pair), len(near) - 1)] == pair
            rows = rows[wanted]
            asked, at = np.unique(pair[wanted], return_inverse=True)
            if not len(asked):
                continue
            size = lengths[asked % len(lengths)]
            starts = np.cumsum(size) - size
            seen = np.zeros(int(size.sum()), dtype=bool)  # words of the items of all pairs, one after the other
            for column in self.places[rows].T:
                seen[starts[at] + column] = True
            good.append(asked[np.add.reduceat(seen, starts, dtype=np.int64) >= np.ceil(SHARE * size - 1e-9)])
        return np.concatenate(good)


class Item:
    """An item's words, aligned with documents."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.k = stretch_of(len(words))
        self.places: dict[str, list[int]] = defaultdict(list)
        for p, word in enumerate(words):
            self.places[word].append(p)

    def share_in(self, words: list[str]) -> float:
        """Share of the item's words that a document holds in order and close together."""
        k, need = self.k, SHARE * len(self.words) - 1e-9
        if common_words(self.words, words) < need:
            return 0.0
        # recent[q][p][j]: most words of a chain that ends with item word p at q as word j + 1 (the last: or later) of its stretch
        recent: dict[int, dict[int, list[int]]] = {}
        ended: deque[tuple[int, int, int]] = deque()  # (q, p, words) of chains that end with a whole stretch
        most = 0
        for q, word in enumerate(words):
            recent.pop(q - NEAR - 1, None)
            while ended and ended[0][0] < q - GAP - 1:
                ended.popleft()
            found = self.places.get(word)
            if not found:
                continue
            here = recent.setdefault(q, {})
            whole = []
            for p in found:
                before = 0
                for q2, p2, n in ended:
                    if n > before and p2 < p and abs((q - q2) - (p - p2)) <= SHIFT:
                        before = n
                here[p] = state = [0] * k
                for q2, column in recent.items():
                    for p2 in range(p - NEAR, p) if q2 < q else ():
                        for j, n in enumerate(column.get(p2, ())):
                            to = min(j + 1, k - 1)
                            if n and n >= state[to]:
                                state[to] = n + 1
                state[0] = max(state[0], before + 1)
                if state[-1]:
                    whole.append((q, p, state[-1]))
                    most = max(most, state[-1])
            ended.extend(whole)
        return most / len(self.words)


class Block:
    """Indexes of a block of items: fingerprints of its windows by size, and loose shingles."""

    def __init__(self, rows: list[tuple[int, str]], radius: int = RADIUS) -> None:
        read = [(item_id, words) for item_id, text in rows if (words := words_of(text))]
        self.ids = [item_id for item_id, _ in read]
        self.items = [Item(words) for _, words in read]
        hashes = [hashes_of(words) for _, words in read]
        self.weights = Weights(hashes)
        prints = [fingerprints(h, self.weights) for h in hashes]
        self.indexes: dict[int, tuple[HammingIndex, np.ndarray]] = {}
        for size in SIZES:
            own = [p[size] for p in prints]
            if any(map(len, own)):
                self.indexes[size] = HammingIndex(np.concatenate(own), radius), np.repeat(np.arange(len(own)), [len(p) for p in own])
        self.lengths = np.array([len(h) for h in hashes], dtype=np.int64)
        loose: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for n, h in enumerate(hashes):
            loose[stretch_of(len(h))].append((n, h))
        self.shingles = [ShingleIndex(found, k) for k, found in loose.items()]

    def near(self, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Pairs (document times the number of items, plus item; ascending) with fingerprints of some size within the radius; owner: the document of each word, ascending."""
        found = [np.zeros(0, dtype=np.int64)]
        prints = fingerprints(hashes, self.weights)
        for size, (index, items) in self.indexes.items():
            inside = np.flatnonzero(owner[: len(prints[size])] == owner[size - 1 :][: len(prints[size])])
            a, b = index.search(prints[size][inside])
            found.append(np.unique(owner[inside[a]] * len(self.items) + items[b]))
        return np.unique(np.concatenate(found))

    def leaks(self, documents: list[list[str]]) -> Iterator[tuple[int, int, float]]:
        """(position of the document, item id, share) of each leak."""
        if not self.items or not documents:
            return
        hashes = np.concatenate([hashes_of(d) for d in documents])
        owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
        near = self.near(hashes, owner)
        pairs = np.concatenate([index.similar(near, self.lengths, hashes, owner) for index in self.shingles])
        for pair in np.sort(pairs).tolist():
            d, i = divmod(pair, len(self.items))
            share = self.items[i].share_in(documents[d])
            if share >= SHARE - 1e-9:
                yield d, self.ids[i], share


#: The last block of items that this worker process indexed, for the tasks to come.
_LAST: dict[str, Block] = {}


def _block_of(key: str, rows: list[tuple[int, str]]) -> Block:
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Block(rows)
    return _LAST[key]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows: list[tuple[int, str]] = []
    size = 0
    for row in items.toLocalIterator():
        rows.append((row[0], row[1]))
        size += len(row[1])
        if len(rows) >= ITEMS_PER_BLOCK or size >= TEXT_PER_BLOCK:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share) of each evaluation item that a document holds."""
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, share double"
    docs = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null"))
    wanted = items.select(F.col("item_id").cast("bigint"), "item_text").filter("item_text is not null")
    found: DataFrame | None = None
    for rows in _blocks(wanted):
        shared = spark.sparkContext.broadcast(rows)

        def search(frames: Iterator[pd.DataFrame], shared=shared, key=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            block = _block_of(key, shared.value)
            for frame in frames:
                ids, texts, out = frame["doc_id"].tolist(), frame["text"].tolist(), []
                at = 0
                while at < len(texts):
                    group, size, begun = [], 0, at
                    while at < len(texts) and (not group or size < _CHUNK):
                        group.append(words_of(texts[at]))
                        size += len(group[-1])
                        at += 1
                    out += [(ids[begun + d], item, share) for d, item, share in block.leaks(group)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "share"])

        part = docs.mapInPandas(search, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.select("doc_id", F.lit(None).cast("bigint").alias("item_id"), F.lit(None).cast("double").alias("share")).filter(F.lit(False))


def leaked_items(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Leaked items with the number of documents that hold them and the largest share."""
    counts = leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max("share"), 6).alias("top_share"))
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), "suite").join(counts, "item_id")
