"""Merkle manifest of a dataset: proofs from nested-interval labels of the tree's nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridloom.session import cut

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LEVELS = 10  # tree levels of one bucket; a node has at most 1024 descendants in it
SPAN = 1 << LEVELS


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields in turn, each ``-`` if NULL, else its byte count, a colon and itself."""
    return F.sha2(F.concat(*[_field(c) for c in fields]), 256)


def _hex(digest: str | Column) -> Column:
    return F.lower(F.hex(digest))


def _ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``lo``, the rank of a row in its group ``g``, and ``n``, the group's rows.

    Rows are range-partitioned by group and order, a group over as many partitions as it needs;
    per-partition counts give every partition's part of a group its start.
    """
    placed = cut(
        df.withColumn("at_", F.monotonically_increasing_id())
        .repartitionByRange("g", *order, "at_")
        .withColumn("part_", F.spark_partition_id())  # must not move any more
    )
    counts = placed.groupBy("g", "part_").agg(F.count(F.lit(1)).alias("rows_"))
    group = W.partitionBy("g")  # a row per partition
    starts = counts.select(
        "g", "part_", F.sum("rows_").over(group).alias("n"),
        (F.sum("rows_").over(group.orderBy("part_")) - F.col("rows_")).alias("start_"),
    )
    inside = W.partitionBy("part_", "g").orderBy(*order, "at_")
    return (
        placed.withColumn("in_", F.row_number().over(inside) - 1)
        .join(starts, ["part_", "g"])
        .withColumn("lo", F.col("start_") + F.col("in_"))
        .drop("at_", "part_", "in_", "start_")
    )


def _halved(row: Column) -> Column:
    """The level above: every two nodes in turn, a last one alone."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(row) - 1) / 2).cast("int")),
        lambda i: F.sha2(F.concat(F.get(row, 2 * i), F.coalesce(F.get(row, 2 * i + 1), F.lit(""))), 256),
    )


def _blocks(members: DataFrame, level: int) -> DataFrame:
    """Subtrees of one bucket of levels: ``g, n, lo`` of the top node and all ``rows`` of digests.

    ``members`` are the nodes of the bucket's lowest level; a block has 1024 of them at most.
    """
    top = 1 << (level + LEVELS)
    blocks = members.groupBy("g", "n", (F.col("lo") - F.col("lo") % top).alias("top")).agg(
        F.sort_array(F.collect_list(F.struct("lo", _hex("digest").alias("digest")))).alias("row"))
    # members of the whole group on the lowest level, and the levels from there to its root
    width = F.ceil(F.col("n") / (1 << level))
    height = F.length(F.bin(width - 1))
    steps = F.when(width <= 1, 0).otherwise(F.least(height, F.lit(LEVELS)))
    numbers = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    rows = F.reduce(
        numbers, F.array(F.col("row.digest")),
        lambda rows, _: F.concat(rows, F.array(_halved(F.element_at(rows, -1)))),
    )
    return blocks.select("g", "n", F.col("top").alias("lo"), rows.alias("rows"))


def _parents(blocks: DataFrame, level: int) -> DataFrame:
    """Inner nodes with the intervals of leaf ranks they cover and the digests of their children.

    ``lo`` to ``mid`` is the left child's interval, ``mid`` to ``hi`` the right one's, empty if there is none.
    """
    lines = blocks.select(
        "g", "n", "lo", F.size("rows").alias("levels"), F.posexplode("rows").alias("k", "row")
    ).where("k < levels - 1")
    unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("k") + level)
    pairs = lines.select(
        "g", "n", (F.col("k") + level + 1).alias("level"), "lo", unit.alias("unit"), "row",
        F.explode(F.sequence(F.lit(0), F.floor((F.size("row") - 1) / 2).cast("int"))).alias("i"),
    )
    lo = F.col("lo") + 2 * F.col("i") * F.col("unit")
    return pairs.select(
        "g", "level", lo.alias("p_lo"),
        F.least(lo + F.col("unit"), F.col("n")).alias("p_mid"),
        F.least(lo + 2 * F.col("unit"), F.col("n")).alias("p_hi"),
        F.unhex(F.get("row", 2 * F.col("i"))).alias("left"),
        F.unhex(F.get("row", 2 * F.col("i") + 1)).alias("right"),
    )


def _siblings(members: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """``g, lo, path``: a member's siblings on the way through one bucket of levels, lowest first.

    A member meets the ancestors whose interval contains its own, level by level of the bucket.  What
    an ancestor's interval has besides the child that contains the member is the sibling's.
    """
    width = F.ceil(F.col("n") / (1 << level))
    steps = F.least(F.length(F.bin(width - 1)), F.lit(LEVELS))
    climbing = members.where(F.col("n") > (1 << level)).select(
        "g", "lo", F.least(F.col("lo") + (1 << level), F.col("n")).alias("hi"),
        F.explode(F.sequence(F.lit(level + 1), level + steps)).alias("level"),
    )
    unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level"))
    climbing = climbing.withColumn("p_lo", F.col("lo") - F.col("lo") % unit)
    met = climbing.join(parents, ["g", "level", "p_lo"]).where("p_lo <= lo AND hi <= p_hi")
    on_left = F.col("lo") >= F.col("p_mid")  # the member is in the right child, its sibling the left one
    step = F.struct(
        "level", on_left.alias("on_left"), F.when(on_left, F.col("left")).otherwise(F.col("right")).alias("digest"))
    return met.groupBy("g", "lo").agg(F.sort_array(F.collect_list(step)).alias("path"))


def _buckets(leaves: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Members and sibling paths of every bucket of levels, lowest first; and the roots ``g, n, digest``.

    ``leaves`` are ``g, n, lo, digest``.
    """
    members, level, out, roots = leaves, 0, [], None
    while True:
        blocks = cut(_blocks(members, level))
        out.append((members, _siblings(members, _parents(blocks, level), level)))
        tops = blocks.select(
            "g", "n", "lo", F.unhex(F.element_at(F.element_at("rows", -1), 1)).alias("digest"))
        level += LEVELS
        done = tops.where(F.col("n") <= (1 << level)).drop("lo")
        roots = done if roots is None else roots.unionByName(done)
        members = tops.where(F.col("n") > (1 << level))
        if members.isEmpty():
            return out, roots


def _paths(buckets: list[tuple[DataFrame, DataFrame]], above: DataFrame) -> DataFrame:
    """Whole sibling paths of the leaves, from the top bucket down to the leaves.

    ``above`` has ``g, n, path`` of every root, with further columns that each leaf inherits.  A node
    hands its path on to at most 1024 members of the bucket below, so no key is hot.
    """
    more = [c for c in above.columns if c not in ("g", "n", "path")]
    path = None
    for k in reversed(range(len(buckets))):
        members, own = buckets[k]
        span = 1 << (LEVELS * (k + 1))
        # groups whose root is the top of this bucket
        least = 0 if k == 0 else 1 << (LEVELS * k)
        upper = above.where((F.col("n") > least) & (F.col("n") <= span)).select(
            "g", F.lit(0).cast("long").alias("top"), F.col("path").alias("upper"), *more)
        if path is not None:
            upper = upper.unionByName(path.select("g", F.col("lo").alias("top"), F.col("path").alias("upper"), *more))
        climbed = members.select("g", "lo").join(own, ["g", "lo"], "left")
        climbed = climbed.withColumn("top", F.col("lo") - F.col("lo") % span)
        whole = F.when(F.col("path").isNull(), F.col("upper")).otherwise(F.concat("path", "upper"))
        path = climbed.join(upper, ["g", "top"]).select("g", "lo", whole.alias("path"), *more)
    return path


def _fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    def up(below: Column, step: Column) -> Column:
        beside = F.coalesce(_hex(step["digest"]), F.lit(""))
        return F.sha2(F.when(step["on_left"], F.concat(beside, below)).otherwise(F.concat(below, beside)), 256)

    return F.reduce(path, start, up)


def manifest(df: DataFrame, fields: list[str] = FIELDS, tamper_every: int = 7) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``fields`` name id, source, language, character count and text, in this order; a column that is
    missing counts as NULL.  The leaves of a language are ordered by id (NULL first, equal ids by their
    digest) and hashed in pairs, a last one alone, until one is left; the languages' roots, ordered by
    their bytes, NULL first, likewise give the root.

    Every node has an interval of leaf ranks.  Ten levels make a bucket: a block of 1024 neighbours is
    hashed in one array, its members meet the ancestors whose intervals contain theirs, and what is
    left of an ancestor's interval names the sibling.  The block's top climbs through the next bucket in
    the same way, and paths are handed down again, so a table of any size takes one round for
    every ten levels, and no join key has more than 1024 rows.

    ``proof_sha256`` is the digest of the siblings in order.  ``folded_root`` is computed from the siblings
    and a leaf in which ``n_chars`` is one more where ``tamper_every`` divides the checksum of the id
    (NULL stays).  Texts of any length are hashed in place and not shuffled.  Repeated rows are leaves of
    their own.  Other columns are ignored; empty input gives no rows.
    """
    have = [F.col(c) if c in df.columns else F.lit(None) for c in fields]
    doc_id, source, lang, n_chars, text = have
    picked = F.crc32(doc_id.cast("string").cast("binary")) % tamper_every == 0
    changed = F.when(picked & n_chars.isNotNull(), leaf_digest([doc_id, source, lang, n_chars + 1, text]))
    slim = df.select(
        F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), lang.cast("string"))).alias("g"),
        doc_id.cast("long").alias("doc_id"),
        F.unhex(leaf_digest(have)).alias("digest"),
        F.unhex(changed).alias("changed"),
    )
    leaves = cut(_ranked(slim, ["doc_id", "digest"]))
    below, subroots = _buckets(leaves.select("g", "n", "lo", "digest"))
    subroots = cut(subroots)
    langs = cut(_ranked(
        subroots.select(F.lit("").alias("g"), F.col("g").alias("lang"), F.col("digest")), ["lang"]))
    top, roots = _buckets(langs.select("g", "n", "lo", "digest"))
    over = roots.select("g", "n", F.array().cast("array<struct<level:int,on_left:boolean,digest:binary>>").alias("path"),
                        F.col("digest").alias("root"))
    to_root = langs.select("lo", "lang", F.col("digest").alias("subroot")).join(
        _paths(top, over).drop("g"), "lo")
    above = cut(subroots.select("g", "n").join(to_root.withColumnRenamed("lang", "g").drop("lo"), "g"))
    proven = leaves.join(_paths(below, above), ["g", "lo"])
    digests = F.transform("path", lambda s: F.coalesce(_hex(s["digest"]), F.lit("")))
    said = proven.select(
        "doc_id",
        _hex("digest").alias("leaf"),
        _hex("subroot").alias("subroot"),
        _hex("root").alias("root"),
        F.sha2(F.concat_ws("", digests), 256).alias("proof_sha256"),
        _fold(_hex(F.coalesce("changed", "digest")), F.col("path")).alias("folded_root"),
    )
    return said.withColumn("verified", F.col("folded_root") == F.col("root"))


# The checksum is folded over the digits with the usual table of the reflected polynomial.
SQL = """
WITH RECURSIVE step(n, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
  FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY n) AS t FROM step WHERE k = 8),
told AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]))) AS crc
  FROM documents, tab),
leaf AS (
  SELECT doc_id, lang,
         sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || body) AS leaf,
         CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL
              THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || body)
         END AS changed
  FROM told),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf),
node(lang, level, pos, digest, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)),
         (any_value(n) + 1) // 2
  FROM node WHERE n > 1 GROUP BY lang, level, pos // 2),
sub AS (SELECT lang, level AS height, digest AS subroot,
               row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos
        FROM node WHERE n = 1),
peak(level, pos, digest, n) AS (
  SELECT CAST(0 AS BIGINT), pos, subroot, count(*) OVER () FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM peak WHERE n > 1 GROUP BY level, pos // 2),
top AS (SELECT digest AS root FROM peak WHERE n = 1),
climb AS (
  SELECT p.doc_id, p.leaf, n.level, p.pos >> n.level AS place, s.digest AS beside
  FROM placed p JOIN node n ON n.lang IS NOT DISTINCT FROM p.lang AND n.pos = p.pos >> n.level AND n.n > 1
  LEFT JOIN node s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = n.level
                  AND s.pos = xor(p.pos >> n.level, 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, b.height + k.level, b.pos >> k.level, s.digest
  FROM placed p JOIN sub b ON b.lang IS NOT DISTINCT FROM p.lang
  JOIN peak k ON k.pos = b.pos >> k.level AND k.n > 1
  LEFT JOIN peak s ON s.level = k.level AND s.pos = xor(b.pos >> k.level, 1)),
way AS (
  SELECT doc_id, leaf, list({'left': place % 2 = 1, 'beside': coalesce(beside, '')} ORDER BY level) AS path
  FROM climb GROUP BY doc_id, leaf),
folded AS (
  SELECT p.doc_id, p.leaf, p.lang, coalesce(changed, p.leaf) AS start, coalesce(path, []) AS path
  FROM placed p LEFT JOIN way w ON w.doc_id IS NOT DISTINCT FROM p.doc_id AND w.leaf = p.leaf),
fold(doc_id, leaf, k, digest) AS (
  SELECT doc_id, leaf, 0, start FROM folded
  UNION ALL
  SELECT f.doc_id, f.leaf, k + 1,
         sha256(CASE WHEN path[k + 1]['left'] THEN path[k + 1]['beside'] || digest
                     ELSE digest || path[k + 1]['beside'] END)
  FROM fold f JOIN folded w ON w.doc_id IS NOT DISTINCT FROM f.doc_id AND w.leaf = f.leaf
  WHERE k < len(path))
SELECT w.doc_id, w.leaf, subroot, root,
       sha256(array_to_string(list_transform(path, lambda s: s['beside']), '')) AS proof_sha256,
       f.digest AS folded_root, f.digest = root AS verified
FROM folded w
JOIN fold f ON f.doc_id IS NOT DISTINCT FROM w.doc_id AND f.leaf = w.leaf AND f.k = len(path)
JOIN sub b ON b.lang IS NOT DISTINCT FROM w.lang, top
"""
