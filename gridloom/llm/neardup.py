"""Near-duplicate classes: BagMinHash signatures of word shingles, bands, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.common import clean, free_name, once
from gridloom.session import cut

SHINGLE = 5  # words
BANDS, ROWS = 21, 6  # at a similarity of 0.8 a pair misses every band with probability 0.002
NUM, DEN = 4, 5  # least similarity, as a fraction
MARKS = 16  # 64-bit words of the parity marks that bound how far two bags differ
CACHE_WORDS = 150_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (the finaliser of a public split-mix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Bag of word shingles of a text as 64-bit hashes with their counts."""

    def __init__(self):
        from xxhash import xxh3_64_digest

        self.hash, self.known = xxh3_64_digest, {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.encode("utf-8", "surrogatepass").split()
        if not words:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        codes = list(map(self.known.get, words))
        if None in codes:
            self.known.update((w, self.hash(w)) for w in {w for w, c in zip(words, codes) if c is None})
            codes = map(self.known.__getitem__, words)
        h = np.frombuffer(b"".join(codes), dtype=">u8").astype(np.uint64)
        size = min(SHINGLE, len(words))
        total = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for k in range(size):
            total = total * _STEP + h[k : k + len(total)]
        return np.unique(mix(total), return_counts=True)

    def elements(self, text: str) -> np.ndarray:
        """The bag as a set: the k-th occurrence of a shingle is an element of its own."""
        bag, counts = self(text)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        number = (np.arange(counts.sum()) - first).astype(np.uint64)
        return mix(np.repeat(bag, counts) + number * _STEP)


def parity_marks(elements: np.ndarray) -> np.ndarray:
    """``64 * MARKS`` bits; a bit tells whether an odd number of elements falls on it.

    An element in one of two sets flips one bit of their difference, so the sets differ in at least as
    many elements as their marks differ in bits.
    """
    place = (elements % np.uint64(64 * MARKS)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * MARKS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def bag_minhash(bag: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Signature of a weighted set; two registers are equal with the weighted Jaccard probability.

    The weight axis is cut into the intervals [0, 1), [1, 2), [2, 4), [4, 8) and so on.  Every element
    has a Poisson process on each interval that its weight reaches, of a rate equal to the
    interval's width; a point carries a time, a level in its interval and a register, and counts
    if its level is below the weight.  A register keeps its earliest time.  Points are drawn in order
    of time and only up to a limit that fills all registers; if it does not, the limit is doubled.
    """
    if not len(bag):
        return np.full(size, np.inf)
    seeds, widths, lows, weights = [bag], [np.ones(len(bag))], [np.zeros(len(bag))], [counts]
    low = 1
    while (reach := counts > low).any():
        seeds.append(mix(bag[reach] + np.uint64(low)))
        widths.append(np.full(reach.sum(), float(low)))
        lows.append(np.full(reach.sum(), float(low)))
        weights.append(counts[reach])
        low *= 2
    seed, width = np.concatenate(seeds), np.concatenate(widths)
    low_, weight = np.concatenate(lows), np.concatenate(weights).astype(float)
    plain = len(seeds) == 1  # all weights are 1, so every level counts
    limit = size * (np.log(size) + 3.0) / counts.sum()
    while True:
        registers = np.full(size, np.inf)
        live, t, drawn = np.arange(len(seed)), np.zeros(len(seed)), 0
        while len(live):
            expected = limit * width[live].max()
            block = int(np.clip(expected + 2 * np.sqrt(expected), 1, max(1, 8192 // len(live))))
            steps = np.arange(drawn + 1, drawn + block + 1, dtype=np.uint64) * _STEP
            z = mix(seed[live][:, None] + steps)
            gap = -np.log((z >> np.uint64(11)) * 2.0**-53 + 2.0**-54)
            times = np.cumsum(gap if plain else gap / width[live][:, None], axis=1)
            times += t[live][:, None]
            early = times < limit
            when, y = times[early], mix(z[early] ^ np.uint64(0xD6E8FEB86659FD93))
            place = ((y & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)
            if not plain:
                of = live[np.nonzero(early)[0]]
                counted = low_[of] + width[of] * ((y >> np.uint64(32)) * 2.0**-32) < weight[of]
                when, place = when[counted], place[counted]
            np.minimum.at(registers, place.astype(np.int64), when)
            t[live] = times[:, -1]
            live = live[early[:, -1]]
            drawn += block
        if np.isfinite(registers).all():
            return registers
        limit *= 2


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band of ``ROWS`` registers."""
    bits = registers.view(np.uint64).reshape(BANDS, ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)
    for k in range(ROWS):
        key = mix(key + bits[:, k])
    return key.view(np.int64)


def signatures(text: str | Column) -> Column:
    """Struct of the bag's total weight and the bucket keys; no keys without a word."""

    @F.pandas_udf("weight long, keys array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingles = Shingler()
        for texts in batches:
            weights, keys = [], []
            for t in clean(texts):
                bag, counts = shingles(t)
                weights.append(int(counts.sum()))
                keys.append(band_keys(bag_minhash(bag, counts, BANDS * ROWS)) if len(bag) else [])
            yield pd.DataFrame({"weight": weights, "keys": keys})

    return once(run)(F.col(text) if isinstance(text, str) else text)


def elements(text: str | Column) -> Column:
    """Struct of the bag of shingles as an array of distinct numbers, and its parity marks."""

    @F.pandas_udf("bag array<long>, marks array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingles = Shingler()
        for texts in batches:
            bags = [shingles.elements(t) for t in clean(texts)]
            yield pd.DataFrame({
                "bag": pd.Series([b.view(np.int64) for b in bags], dtype=object),
                "marks": pd.Series([parity_marks(b) for b in bags], dtype=object),
            })

    return once(run)(F.col(text) if isinstance(text, str) else text)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``; the root is the component's least node.

    Least labels spread along the edges and then jump to the label's own label, until none moves.
    Every round is written to the shared folder.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        spread = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.least("root", "m").alias("to"), F.col("root").alias("was"))
        own = labels.select(F.col("node").alias("to"), F.col("root").alias("next"))
        moved = cut(spread.join(own, "to").select("node", F.col("next").alias("root"), "was"))
        labels = moved.select("node", "root")
        if moved.where("root <> was").isEmpty():
            return labels


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose weighted Jaccard similarity reaches the threshold."""
    side = lambda s: bags.select(F.col("node").alias(s), F.col("bag").alias(f"bag_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("bag_a", "bag_b")).cast("long")
    total = F.size("bag_a").cast("long") + F.size("bag_b")
    # common / (total - common) >= NUM / DEN
    return both.where((NUM + DEN) * common >= NUM * total).select("a", "b")


def _may_match(a: Column, b: Column) -> Column:
    """Bags whose weights differ too much cannot be similar enough."""
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def _may_overlap(a: str, b: str, total: Column) -> Column:
    """Whether two bags of together ``total`` elements can be similar enough, by their parity marks."""
    apart = F.lit(0)
    for k in range(MARKS):
        apart = apart + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    # at most (total - apart) / 2 elements are common; common / (total - common) >= NUM / DEN
    return (NUM + DEN) * (total - apart) >= 2 * NUM * total


def _strange_pairs(placed: DataFrame, bags: DataFrame) -> DataFrame:
    """Candidate pairs of a bucket's strangers, those outside its hub's class, with its other classes.

    ``placed`` is ``key, node, weight, r, ra``.  Weights and marks are compared while the bucket is joined,
    so only pairs that may be similar leave the join; no similar pair is lost.
    """
    open_keys = placed.where("r <> ra").select("key").distinct()
    held = cut(placed.join(open_keys, "key").join(bags.select("node", "marks"), "node"))
    left = held.where("r <> ra").select(
        "key", F.col("node").alias("a"), F.col("weight").alias("wa"), F.col("r").alias("r1"),
        F.col("marks").alias("m1"))
    right = held.select(
        F.col("key").alias("key2"), F.col("node").alias("b"), F.col("weight").alias("wb"),
        F.col("r").alias("r2"), F.col("marks").alias("m2"))
    may = (
        (F.col("key") == F.col("key2")) & (F.col("r1") != F.col("r2"))
        & _may_match(F.col("wa"), F.col("wb")) & _may_overlap("m1", "m2", F.col("wa") + F.col("wb"))
    )
    return left.join(right, may).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _signed(df: DataFrame, text: str) -> DataFrame:
    """One row per distinct text with a word: node, weight, keys."""
    made = df.select(F.unhex(F.md5(text)).alias("node"), signatures(text).alias("s"))
    return made.where("node IS NOT NULL AND s.weight > 0").select("node", "s.*").dropDuplicates(["node"])


def text_classes(df: DataFrame, text: str = "text") -> DataFrame:
    """``(node, root)`` of every distinct text that is a near copy of another one.

    A node is the binary MD5 of a text.  Texts that share a bucket are linked if the weighted Jaccard
    similarity of their bags of five-word shingles is at least 0.8; classes are the connected
    components.  Each bucket first pairs its members with its hub only, the member that meets most
    texts in all its buckets.  Then members that this left outside the hub's class are paired with all
    members of other classes whose weights and parity marks allow the similarity, so that no similar
    pair of a bucket stays untested, while a large group of copies never meets itself.
    """
    signed = cut(_signed(df, text))
    places = signed.select("node", "weight", F.explode("keys").alias("key"))
    company = places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(places.join(company, "key"))
    seen = shared.groupBy("node").agg(F.sum("n").alias("seen"))
    hubs = shared.join(seen, "node").groupBy("key").agg(
        F.max(F.struct("seen", "node", "weight")).alias("hub")
    )
    members = cut(shared.drop("n").join(
        hubs.select("key", F.col("hub.node").alias("a"), F.col("hub.weight").alias("wa")), "key"
    ))
    stars = (
        members.where(F.col("a") != F.col("node"))
        .where(_may_match(F.col("wa"), F.col("weight")))
        .select("a", F.col("node").alias("b"))
        .distinct()
    )
    nodes = members.select("node").distinct()
    texts = df.select(F.unhex(F.md5(text)).alias("node"), F.col(text).alias("t_"))
    # the wanted nodes are the small side: the texts are dealt out once, and not sorted
    wanted = texts.join(nodes.hint("shuffle_hash"), "node", "left_semi")
    bags = cut(wanted.dropDuplicates(["node"]).select("node", elements("t_").alias("e")).select("node", "e.*"))
    links = cut(_verified(stars, bags))
    labels = components(links)

    root = lambda side, name: labels.select(F.col("node").alias(side), F.col("root").alias(name))
    placed = (
        members.join(root("node", "r"), "node", "left")
        .join(root("a", "ra"), "a", "left")
        .select("key", "node", "weight", F.coalesce("r", "node").alias("r"), F.coalesce("ra", "a").alias("ra"))
    )
    pairs = _strange_pairs(cut(placed), bags)
    more = cut(_verified(pairs, bags))
    return labels if more.isEmpty() else components(links.unionByName(more))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, copies``.

    The class id is the least id in the class; ``copies`` counts the documents of the very same text.
    Texts with fewer than five words are one shingle; texts without a word are copies of one another
    only if equal.  NULL text is a class of its own under the document's id.  Repeated rows are copies.
    Other columns are ignored; empty input gives no rows.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text_col)).alias("node"))
    classes = text_classes(df.select(F.col(text_col).alias("text")))
    sizes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    rooted = cut(sizes.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")))
    totals = rooted.groupBy("root").agg(
        F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    said = cut(rooted.join(totals, "root").select("node", "class_id", "class_size", "copies"))
    return rows.join(said, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with one document left of each class: the least id, then one of equal rows.

    Rows with NULL text stay.
    """
    node, keep = free_name(df, "node_"), free_name(df, "keep_id_")
    marked = df.withColumn(node, F.unhex(F.md5(text_col)))
    ids = marked.select(F.col(node).alias("node"), F.col(id_col).alias("id"))
    classes = text_classes(df.select(F.col(text_col).alias("text")))
    firsts = ids.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("first"))
    rooted = firsts.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keepers = cut(rooted.groupBy("root").agg(
        F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("k")
    ).select(F.col("k.node").alias(node), F.col("k.first").alias(keep)))
    kept = marked.join(keepers, node).where(F.col(id_col).eqNullSafe(F.col(keep)))
    kept = kept.dropDuplicates([node]).drop(keep)
    return kept.unionByName(marked.where(F.col(node).isNull())).drop(node)
