"""Exact repeated passages: suffix order of shards that hold every text holding a common passage."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm import suffix
from gridloom.llm.common import clean, once
from gridloom.llm.neardup import mix
from gridloom.session import cut, scratch_path

LENGTH = 400  # bytes of a passage
CHUNK = 1 << 17  # bytes hashed at a time
SHARD_BYTES = 8 << 20  # what a shard holds, about, and the most that one hash brings to it
WINDOWS = 1 << 14  # passages of a piece that are digested at a time
_SYMBOLS = bytes((b + suffix.SHIFT) % 256 for b in range(256))  # UTF-8 has no bytes above 0xF4


def gram_size(length: int) -> int:
    """Bytes hashed at each position: a power of two, about a sixth of a passage.

    Much shorter ones would stand at many places by chance and fill the shards in vain.
    """
    return 1 << max(0, (length // 6).bit_length() - 1)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width``."""
    n, reach = len(x) - width + 1, 1
    while reach * 2 <= width:
        x = pick(x[:-reach], x[reach:])
        reach *= 2
    return pick(x[:n], x[width - reach : width - reach + n])


def window_runs(texts: list[bytes], length: int = LENGTH) -> list[tuple]:
    """For each text its passages by least gram: ``(values, first starts, last starts, twice)``.

    A passage is a window of ``length`` bytes.  Its value is the least hash of its grams, so equal
    passages have equal values wherever they stand.  Neighbouring passages of one value are one run.
    ``twice`` tells whether the value's gram stands more than once in the text.
    """
    gram = gram_size(length)
    grams = length - gram + 1
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    none = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, bool))
    if total < length:
        return [none] * len(texts)
    h = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    width, factor = 1, 0x100000001B3
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    h = mix(h)
    least = _slide(h, grams, np.minimum)
    inside = np.zeros(total + 1, dtype=np.int64)
    long = sizes >= length
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, (begins + sizes - length + 1)[long], -1)
    inside = np.cumsum(inside)[: len(least)] > 0
    held = np.where(inside, least, np.uint64(0))
    # a gram is chosen if it is the least of some passage
    pad = np.zeros(grams - 1, dtype=np.uint64)
    chosen = np.flatnonzero(_slide(np.concatenate([pad, held, pad]), grams, np.maximum) == h)
    text_of = np.searchsorted(begins + sizes, chosen, side="right")
    by = np.lexsort((h[chosen], text_of))
    hv, tv = h[chosen][by], text_of[by]
    again = np.flatnonzero((hv[1:] == hv[:-1]) & (tv[1:] == tv[:-1]))
    doubled = {(int(t), int(v)) for t, v in zip(tv[again], hv[again])}
    out = []
    for k, (b, n) in enumerate(zip(begins, sizes)):
        if n < length:
            out.append(none)
            continue
        own = least[b : b + n - length + 1]
        edge = np.flatnonzero(own[1:] != own[:-1]) + 1
        first = np.r_[0, edge]
        value = own[first]
        twice = np.array([(k, int(v)) in doubled for v in value]) if doubled else np.zeros(len(value), bool)
        out.append((
            value.view(np.int64), first.astype(np.int32),
            (np.r_[edge, len(own)] - 1).astype(np.int32), twice,
        ))
    return out


def _runs(text: Column, length: int) -> Column:
    names = ["value", "first", "last", "twice"]

    @F.pandas_udf("value array<long>, first array<int>, last array<int>, twice array<boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows, group, size = [], [], 0
            for t in clean(texts):
                raw = t.encode("utf-8", "surrogatepass")
                group.append(raw)
                size += len(raw)
                if size >= CHUNK:
                    rows += window_runs(group, length)
                    group, size = [], 0
            rows += window_runs(group, length) if group else []
            yield pd.DataFrame({n: [r[k] for r in rows] for k, n in enumerate(names)})

    made = once(run)(text)
    return F.arrays_zip(*[made[n].alias(n) for n in names])


def _pieces(text: Column, runs: Column, length: int) -> Column:
    """The bytes of each run of passages."""

    @F.pandas_udf("array<binary>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, firsts, lasts in batches:
            out = []
            for t, a, b in zip(texts, firsts, lasts):
                raw = t.encode("utf-8", "surrogatepass")
                out.append([raw[x : y + length] for x, y in zip(a, b)])
            yield pd.Series(out)

    return once(run)(text, runs["first"], runs["last"])


def _covered(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte stretches covered by passages at ascending ``starts``."""
    if not len(starts):
        return starts, starts
    split = np.flatnonzero(np.diff(starts) > length)
    return starts[np.r_[0, split + 1]], starts[np.r_[split, len(starts) - 1]] + length


def _sorted_shard(length: int, memory: int):
    """``mapInPandas`` function: pieces of a shard to the stretches of each that repeat in it."""

    def run(batches):
        with tempfile.TemporaryDirectory(prefix="shard-") as folder:
            raw = os.path.join(folder, "raw")
            digests, values, sizes, inner = [], [], [], []
            with open(raw, "wb") as f:
                for frame in batches:
                    inner += frame["twice"].tolist()
                    for d, v, p in zip(frame["digest"], frame["value"], frame["piece"]):
                        f.write(p)
                        digests.append(d)
                        values.append(v)
                        sizes.append(len(p))
            # a value with one piece has nothing to be compared with, unless its gram repeats inside
            _, group, members = np.unique(
                np.array(values, dtype=np.int64), return_inverse=True, return_counts=True
            )
            chosen = np.flatnonzero((members[group] > 1) | np.array(inner, dtype=bool))
            kept, ends = [], np.cumsum(sizes)
            with open(raw, "rb") as f, open(os.path.join(folder, "text"), "wb") as g:
                at = 0
                for k in chosen:
                    f.seek(int(ends[k]) - sizes[k])
                    g.write(f.read(sizes[k]).translate(_SYMBOLS) + bytes([suffix.BREAK]))
                    kept.append((k, at))
                    at += sizes[k] + 1
                g.write(bytes(1 + length + 8))
            os.remove(raw)
            rows = []
            if kept:
                text = np.memmap(os.path.join(folder, "text"), dtype=np.uint8, mode="r")
                hit = suffix.repeated_starts(text, length, folder, memory)
                for k, at in kept:
                    lo, hi = _covered(np.flatnonzero(hit[at : at + sizes[k] - length + 1]), length)
                    if len(lo):
                        rows.append((digests[k], lo.tolist(), hi.tolist()))
                del text
            yield pd.DataFrame(rows, columns=["digest", "lo", "hi"])

    return run


def _window_digests(length: int):
    """``mapInPandas`` function: every passage of each piece as ``(digest of the piece, start, digest)``."""

    def run(batches):
        for frame in batches:
            for d, piece in zip(frame["digest"], frame["piece"]):
                for lo in range(0, len(piece) - length + 1, WINDOWS):
                    at = range(lo, min(lo + WINDOWS, len(piece) - length + 1))
                    yield pd.DataFrame({
                        "digest": [d] * len(at), "start": at,
                        "window": [hashlib.md5(piece[k : k + length]).digest() for k in at],
                    })

    return run


def _covers(starts: Column, length: int) -> Column:
    """Ascending stretches covered by passages at ``starts``, in any order."""

    @F.pandas_udf("lo array<int>, hi array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [_covered(np.sort(x), length) for x in rows]
            yield pd.DataFrame({"lo": [lo for lo, _ in made], "hi": [hi for _, hi in made]})

    return once(run)(starts)


def _crowded(pieces: DataFrame, length: int) -> DataFrame:
    """``digest, lo, hi`` of pieces whose hash has too many for one shard: passages meet by their own digest.

    Passages are counted before they are dealt, so that one in very many pieces is no large group.
    """
    windows = _stored(
        pieces.select("digest", "piece").mapInPandas(
            _window_digests(length), "digest binary, start int, window binary"
        ),
        "windows",
    )
    twice = cut(windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window"))
    found = windows.join(twice, "window").groupBy("digest").agg(F.collect_list("start").alias("starts"))
    return found.select("digest", _covers(F.col("starts"), length).alias("c")).select("digest", "c.*")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _cut_out(text: Column, los: Column, his: Column) -> Column:
    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, starts, ends in batches:
            rows = []
            for t, lo, hi in zip(texts, starts, ends):
                raw = t.encode("utf-8", "surrogatepass")
                order = np.argsort(lo, kind="stable")
                lo, hi = np.asarray(lo)[order], np.maximum.accumulate(np.asarray(hi)[order])
                new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
                lo, hi = lo[new], hi[np.r_[new[1:] - 1, len(hi) - 1]]
                kept, at = hashlib.sha256(), 0
                for a, b in zip(lo, hi):
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((int((hi - lo).sum()), len(lo), kept.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256"])

    return once(run)(text, los, his)


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    memory: int = suffix.MEMORY,
) -> DataFrame:
    """Count and digest what stays of each text without bytes that lie in a repeated passage.

    Every passage of ``length`` bytes is dealt to a shard by the least hash of its grams, as a piece that
    holds all neighbouring passages of that hash; pieces whose hash stands at one place only cannot
    repeat and are left out, equal pieces are merged before they are shuffled.  A hash with more bytes of
    different pieces than a shard holds is split further, by the digests of its passages.  Each shard sorts the
    suffixes of its pieces by external induced sorting; a suffix whose common prefix with a
    neighbour reaches ``length`` starts a repeated passage.  Equal texts are worked on once.

    NULL counts as empty; texts shorter than ``length`` keep all bytes.  Repeated rows are copies, so
    all their passages repeat.  Other columns are ignored; empty input gives no rows.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("node", F.unhex(F.md5("text")))
    texts = docs.where(F.octet_length("text") >= length).select("node", "text")
    runs = _stored(
        texts.select("node", F.explode(_runs(F.col("text"), length)).alias("r")).select("node", "r.*"), "runs"
    )
    place = F.xxhash64("node", "first")
    again = cut(
        runs.groupBy("value")
        .agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("twice").alias("twice"))
        .where("a <> b OR twice")
        .select("value")
    )
    fields = ["first", "last", "value", "twice"]
    kept = runs.join(again, "value").select("node", *fields).distinct()
    lists = kept.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("runs"))
    wanted = texts.join(lists.hint("shuffle_hash"), "node").dropDuplicates(["node"])
    wanted = _stored(wanted, "wanted")
    pieces = wanted.select(
        "node", F.explode(F.arrays_zip("runs", _pieces(F.col("text"), F.col("runs"), length).alias("piece"))).alias("p")
    ).select("node", "p.runs.first", "p.runs.value", "p.runs.twice", "p.piece", F.unhex(F.md5("p.piece")).alias("digest"))
    distinct = _stored(
        pieces.groupBy("digest").agg(
            F.first("value").alias("value"),
            F.max("twice").alias("twice"),
            F.first("piece").alias("piece"),
            F.count(F.lit(1)).alias("n"),
        ),
        "pieces",
    )
    # no more than one in SHARD_BYTES of all bytes, so few
    crowded = cut(
        distinct.groupBy("value").agg(F.sum(F.octet_length("piece")).alias("size"))
        .where(F.col("size") > SHARD_BYTES)
    )
    dealt = distinct.join(F.broadcast(crowded.select("value")), "value", "left_anti")
    size = dealt.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // SHARD_BYTES) + 1)
    found = dealt.repartition(shards, "value").select(
        "digest", "value", "twice", "piece"
    ).mapInPandas(
        _sorted_shard(length, memory), "digest binary, lo array<int>, hi array<int>"
    )
    if not crowded.isEmpty():
        many = distinct.join(F.broadcast(crowded.select("value")), "value", "left_semi")
        found = found.unionByName(_crowded(many, length))
    whole = distinct.where("n > 1").select(
        "digest", F.array(F.lit(0)).alias("lo"), F.array(F.octet_length("piece")).alias("hi")
    )
    cover = cut(found.unionByName(whole))
    held = pieces.select("node", "first", "digest").join(cover, "digest").groupBy("node").agg(
        F.flatten(F.collect_list(F.transform("lo", lambda x: x + F.col("first")))).alias("lo"),
        F.flatten(F.collect_list(F.transform("hi", lambda x: x + F.col("first")))).alias("hi"),
    )
    parts = wanted.select("node", "text").join(held, "node").select(
        "node", _cut_out(F.col("text"), F.col("lo"), F.col("hi")).alias("c")
    )
    rows = docs.select(
        "doc_id", "node", F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("whole_sha"),
    )
    copies = rows.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    said = cut(copies.join(parts, "node", "left"))
    full = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return rows.join(said, "node").select(
        "doc_id",
        "n_bytes",
        F.when(full, F.col("n_bytes")).otherwise(F.coalesce("c.n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(full, 1).otherwise(F.coalesce("c.n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(full, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("c.kept_sha256", "whole_sha")).alias("kept_sha256"),
    )
