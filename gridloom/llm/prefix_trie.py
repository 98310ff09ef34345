"""Prefix trie of conversations by truncation peeling, from the deepest turn up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.operators.ranks import lookup_join
from gridloom.session import cut

FAMILY, HEADS = 20, 4  # conversations that share a first one; it lends less than HEADS turns
CHUNK = 256  # ids joined to one text before a node's list is hashed
PORTION = 100_000  # turns peeled together
NODE = [("key", "binary"), ("parent", "binary"), ("depth", "long"), ("words", "long"), ("least", "long"), ("n_convs", "long")]
SUM = [("key", "binary"), ("n_leaves", "long"), ("saved", "long")]
WORD = r"[^\x20\x09-\x0D]+"


def _turn(role: Column, text: Column) -> Column:
    """Digest and word count of a turn; the role's length keeps role and text apart."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.struct(
        F.unhex(F.sha2(whole, 256)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def ordered_turns(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, turns``: a conversation's turns as ``(digest, words)`` in order, NULL turn first.

    Texts stay in their rows: a turn enters the array with 40 bytes.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        _turn(blank(role_col), blank(text_col)).alias("said"),
    )
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "said"))).alias("all"))
    return gathered.select("conv_id", F.col("all.said").alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """``conv_id, digests, words, key``: the first turns of the family's first conversation, then a
    conversation's own; ``key`` names the whole path.

    How many are borrowed, 0 to 3, follows from the checksum of the id.
    """
    held = convs.withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY)
    lent = convs.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("first"), F.slice("turns", 1, HEADS - 1).alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.array().cast("array<struct<digest:binary,words:bigint>>")
    own = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).otherwise(none)
    borrowed = F.when(h > 0, F.slice(F.coalesce("lent", none), 1, h)).otherwise(none)
    path = held.join(lent, "first", "left").select("conv_id", F.concat(borrowed, own).alias("path"))
    start = F.lit(hashlib.sha256(b"").digest())
    key = F.reduce("path.digest", start, lambda k, d: F.unhex(F.sha2(F.concat(k, d), 256)))
    return path.select("conv_id", F.col("path.digest").alias("digests"), F.col("path.words").alias("words"), key.alias("key"))


def _keys(digests: list[bytes]) -> list[bytes]:
    """Keys of all prefixes of a path, the root's first: each the digest of the key before and a turn."""
    keys = [hashlib.sha256(b"").digest()]
    for d in digests:
        keys.append(hashlib.sha256(keys[-1] + d).digest())
    return keys


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows in portions of about ``PORTION`` turns, with the keys of their prefixes."""
    rows, turns = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                row["keys"] = _keys(row.pop("digests"))
                rows.append(row)
                turns += len(row["keys"])
            if turns > PORTION:
                yield rows
                rows, turns = [], 0
    if rows:
        yield rows


def _levels(rows: list[dict]) -> Iterator[tuple[int, list[tuple[dict, list]]]]:
    """Truncation peeling of a portion: from the greatest depth up, the nodes of a level.

    A node is a conversation that runs through it and a list of what merges there: the figures of the
    nodes below that were cut by their last turn, and the conversations that end here.  The caller
    puts the node's figures in place of the list, and they go on to the level above.
    """
    ending = {}
    for row in rows:
        ending.setdefault(len(row["keys"]) - 1, []).append(row)
    alive: list[tuple[dict, list]] = []
    for depth in range(max(ending), -1, -1):
        merged: dict[bytes, tuple[dict, list]] = {}
        for through, figures in alive:
            merged.setdefault(through["keys"][depth], (through, []))[1].append(figures)
        for row in ending.get(depth, ()):
            merged.setdefault(row["keys"][depth], (row, []))[1].append(row)
        alive = list(merged.values())
        yield depth, alive
        alive = [(through, figures[0]) for through, figures in alive]


def _discovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each portion with the number and the least id of its conversations."""
    for rows in _portions(batches):
        out = []
        for depth, nodes in _levels(rows):
            for through, below in nodes:
                n = sum(1 if isinstance(x, dict) else x[0] for x in below)
                least = min(x["conv_id"] if isinstance(x, dict) else x[1] for x in below)
                below[:] = [(n, least)]
                out.append((
                    through["keys"][depth], through["keys"][depth - 1] if depth else None, depth,
                    through["words"][depth - 1] if depth else 0, least, n))
        yield _batch(out, NODE)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the conversations of each portion add to the subtrees of their nodes."""
    for rows in _portions(batches):
        given = {}
        for row in rows:
            for x in row["given"]:
                given[row["keys"][x["depth"]]] = (x["leaf"], x["saved"])
        out = []
        for depth, nodes in _levels(rows):
            for through, below in nodes:
                key = through["keys"][depth]
                sums = [given.get(key, (0, 0)), *[x for x in below if not isinstance(x, dict)]]
                leaves, saved = sum(x[0] for x in sums), sum(x[1] for x in sums)
                below[:] = [(leaves, saved)]
                out.append((key, leaves, saved))
        yield _batch(out, SUM)


def _batch(rows: list[tuple], fields: list[tuple[str, str]]) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kinds[kind]) for column, (_, kind) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields)


def trie_nodes(paths: DataFrame) -> DataFrame:
    """``key, parent, depth, least, n_convs, n_children, n_leaves, saved`` of every node.

    Each portion of conversations is peeled where it lies; a node found by several tasks is a row for
    each, and their counts merge by its key.  Children are counted once all nodes are known.  A
    node's own words and whether it is a leaf then go to its least conversation, one share for each
    node, and a second peeling adds the shares up along the paths.
    """
    found = paths.select("conv_id", "digests", "words").mapInArrow(_discovered, _ddl(NODE))
    nodes = cut(found.groupBy("key", "parent", "depth", "words").agg(
        F.min("least").alias("least"), F.sum("n_convs").alias("n_convs")))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    share = F.struct(
        "depth", (F.col("n_children") == 0).cast("int").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    given = nodes.groupBy(F.col("least").alias("conv_id")).agg(F.collect_list(share).alias("given"))
    sums = paths.select("conv_id", "digests").join(given, "conv_id").mapInArrow(_summed, _ddl(SUM))
    sums = sums.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    return nodes.join(sums, "key")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted ``key, conv_id`` as texts of up to ``CHUNK`` ids, numbered within the partition."""
    key, ids, number = None, [], 0
    for batch in batches:
        out = []
        for k, i in zip(batch["key"], batch["conv_id"]):
            if ids and (k != key or len(ids) == CHUNK):
                out.append((key, number, ",".join(ids)))
                number, ids = number + 1, []
            key = k
            ids.append(str(i))
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "ids"])
    if ids:
        yield pd.DataFrame([(key, number, ",".join(ids))], columns=["key", "seq", "ids"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest per key over its texts in order; only the running digest is held."""
    key, state = None, None
    for batch in batches:
        keys, said = [], []
        for k, ids in zip(batch["key"], batch["ids"]):
            if k != key:
                if state is not None:
                    keys.append(key)
                    said.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if keys:
            yield pd.DataFrame({"key": keys, "ends_sha256": said})
    if state is not None:
        yield pd.DataFrame({"key": [key], "ends_sha256": [state.hexdigest()]})


def ends_digests(paths: DataFrame) -> DataFrame:
    """``key, ends_sha256``: digest of the sorted ids of the conversations that end at a node.

    Ids are sorted and joined in ranges, so the ids of one node are spread over tasks; what meets in
    one task are texts of 256 ids each, and they pass through it as a stream.
    """
    ranged = paths.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = ranged.mapInPandas(_joined, "key binary, seq long, ids string").withColumn("part", F.spark_partition_id())
    chunks = chunks.repartition("key").sortWithinPartitions("key", "part", "seq")
    return chunks.drop("part", "seq").mapInPandas(_hashed, "key binary, ends_sha256 string")


def conversation_trie(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``.  Turns of one number are ordered by the digest of role and text; NULL role or text is
    empty; NULL turn comes first; repeated rows are turns of their own.  Rows without a conversation id
    belong to no conversation.  Texts of any length are hashed in place.  Other columns are
    ignored; empty input gives no rows.

    The number of Spark rounds does not depend on the length of the conversations.  The turns of one
    conversation meet in one row, with 40 bytes a turn.
    """
    paths = cut(rebuilt(ordered_turns(df, conv_col, turn_col, role_col, text_col)))
    nodes = cut(trie_nodes(paths))
    parents = nodes.select(F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return lookup_join(nodes, parents, ["parent"]).join(ends_digests(paths), "key", "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


# The checksum is folded over the digits with the usual table of the reflected polynomial.
SQL = r"""
WITH RECURSIVE step(n, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
  FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY n) AS t FROM step WHERE k = 8),
conv AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST,
           sha256(strlen(role) || ':' || role || text)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id),
told AS (
  SELECT conv_id, turns, conv_id - conv_id % 20 AS first,
         xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]))) % 4 AS h
  FROM conv, tab),
whole AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS path
  FROM told c LEFT JOIN conv b ON b.conv_id = c.first),
member AS (
  SELECT conv_id, len(path) AS own, CAST(d AS BIGINT) AS depth, list_slice(path, 1, d) AS path
  FROM (SELECT conv_id, path, unnest(generate_series(0, len(path))) AS d FROM whole)),
node AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS least, count(*) AS n_convs,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (own = depth) AS ends
  FROM member GROUP BY path),
child AS (
  SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children
  FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN n.depth = 0 THEN 0
              ELSE (n_convs - 1) * len(regexp_extract_all(n.path[n.depth]['text'], '[^\x20\x09-\x0D]+')) END AS saved
  FROM node n LEFT JOIN child c ON c.path = n.path),
below AS (
  SELECT list_slice(path, 1, d) AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT path, saved, n_children, unnest(generate_series(0, depth)) AS d FROM full_node)
  GROUP BY 1)
SELECT f.least AS conv_id, f.depth, p.least AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_node f JOIN below b ON b.path = f.path
LEFT JOIN full_node p ON f.depth > 0 AND p.path = list_slice(f.path, 1, f.depth - 1) AND p.depth = f.depth - 1
"""
