"""Secret scan: fixed patterns, and character Markov models of random strings and identifiers.

Everything runs on DataFrame and SQL functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.common import free_name

# Kind, pattern, group that is measured, least length; in this order.
BASE = [
    ("assign",
     r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]
# runs this long are whole or nothing, so a short run need not be cut out to be dropped
FAST = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]{20,}"  # what the models judge
WORD = "[A-Za-z0-9+/_=-]{6,}"  # what the model of ordinary strings learns from
PART = "[A-Za-z]{2,}"  # what identifiers are put together from
SAMPLE_DOCS = 20_000  # documents the model of ordinary strings is fitted on, about
BLOCK = 256
SCALE = 1000  # model values are whole thousandths of a bit


def _starts(df: DataFrame, pieces: str, matches: str, out: str, tmp: list[str]) -> DataFrame:
    """Add ``out``: code-point start of every match, from the pieces between matches.

    Lengths are summed in blocks, so that a text with very many matches costs far less than the
    square of their number.
    """
    lens, blocks, before = tmp
    df = df.withColumn(lens, F.zip_with(
        pieces, F.concat(F.array(F.lit("")), F.col(matches)),
        lambda p, m: F.coalesce(F.length(p), F.lit(0)) + F.coalesce(F.length(m), F.lit(0)),
    ))
    # element k of ``lens`` is the match before piece k and piece k itself, so sums are starts
    add = lambda a, x: a + x
    df = df.withColumn(blocks, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(lens, b * BLOCK + 1, BLOCK), F.lit(0), add),
    ))
    df = df.withColumn(before, F.transform(
        blocks, lambda _, k: F.aggregate(F.slice(blocks, F.lit(1), k), F.lit(0), add)
    ))
    return df.withColumn(out, F.transform(
        matches,
        lambda _, k: F.element_at(before, F.floor(k / BLOCK).cast("int") + 1) + F.aggregate(
            F.slice(lens, F.floor(k / BLOCK).cast("int") * BLOCK + 1, k % BLOCK + 1), F.lit(0), add
        ),
    ))


def _spans(
    df: DataFrame, text: str, order: int, kind: str, pattern: str, group: int, least: int, out: str
) -> DataFrame:
    """Add ``out``: array of ``(start, ord, end, kind, value)`` of the matches long enough."""
    m, v, p, s, *tmp = [free_name(df, f"{out}{x}_") for x in "mvpsabc"]
    has = F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    if group:
        df = df.withColumn(
            v, F.when(F.size(m) > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)
        )
    df = df.withColumn(
        p, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(F.array(F.lit("")))
    )
    df = _starts(df, p, m, s, tmp)
    values = F.col(v if group else m)
    spans = F.transform(m, lambda x, k: F.struct(
        F.element_at(s, k + 1).alias("start"),
        F.lit(order).alias("ord"),
        (F.element_at(s, k + 1) + F.length(x)).alias("end"),
        F.lit(kind).alias("kind"),
        F.element_at(values, k + 1).alias("value"),
    ))
    df = df.withColumn(out, F.filter(spans, lambda x: F.length(x["value"]) >= least))
    return df.drop(m, p, s, *tmp, *([v] if group else []))


@dataclass(frozen=True)
class MarkovModels:
    """Thousandths of a bit by which each pair of characters speaks for a random string."""

    ratios: tuple[int, ...]  # row: first character, column: second

    def bits(self, text: Column) -> Column:
        """Log-likelihood ratio of a run over the alphabet, in bits."""
        k = len(ALPHABET)
        table = F.from_json(F.lit(str(list(self.ratios))), "array<int>")
        place = F.transform(  # positions in the alphabet
            F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c)
        )
        pairs = F.zip_with(
            F.slice(place, F.lit(1), F.size(place) - 1), F.slice(place, F.lit(2), F.size(place) - 1),
            lambda a, b: (a - 1) * k + b,
        )
        total = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, j: s + F.element_at(table, j))
        return total / F.lit(float(SCALE))


def _identifiers(texts: DataFrame) -> DataFrame:
    """Strings ``t`` and how often ``n`` they stand in ordinary identifiers made of neighbouring words.

    Every word of a text and every join of two words is counted first, then spelled in the styles
    that programs and paths use; drawn lines of one character come with the joins.
    """
    words = texts.select(F.regexp_extract_all("text", F.lit(PART), F.lit(0)).alias("w"))
    n = F.count(F.lit(1)).alias("n")
    parts = words.select(F.explode("w").alias("w")).groupBy(F.lower("w").alias("w")).agg(n)
    count = F.size("w") - 1
    joined = F.zip_with(
        F.slice("w", F.lit(1), count), F.slice("w", F.lit(2), count),
        lambda a, b: F.lower(F.concat(F.right(a, F.lit(1)), F.left(b, F.lit(1)))),
    )
    joins = words.where(count > 0).select(F.explode(joined).alias("j")).groupBy("j").agg(n)
    last, first = F.substring("j", 1, 1), F.substring("j", 2, 1)
    low, up, cap = F.col("w"), F.upper("w"), F.initcap("w")
    spelled = F.array(low, low, low, up, cap, cap)  # three marks, constants, two kinds of camel case
    camel = F.concat(last, F.upper(first))
    marked = F.array(
        *[F.concat(last, F.lit(mark), first) for mark in "_-/"], F.upper(F.concat(last, F.lit("_"), first)),
        camel, camel, *[F.lit(mark * 2) for mark in "+/_=-"],
    )
    return parts.select(F.explode(spelled).alias("t"), "n").unionByName(
        joins.select(F.explode(marked).alias("t"), "n")
    )


def _pair_counts(tokens: DataFrame) -> dict[str, int]:
    """Counts of neighbouring characters in strings ``t`` that stand ``n`` times each.

    Equal strings are counted before they are taken apart; at most the square of the alphabet
    reaches the driver.
    """
    at = F.sequence(F.lit(1), F.length("t") - 1)
    counted = tokens.where(F.length("t") > 1).groupBy("t").agg(F.sum("n").alias("n"))
    pairs = counted.select(
        F.explode(F.transform(at, lambda i: F.substr(F.col("t"), i, F.lit(2)))).alias("pair"), "n"
    )
    return {r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


def _log_model(counts: dict[str, int], uniform: float) -> list[list[float]]:
    """Transition probabilities, smoothed towards single characters and mixed with the uniform."""
    k = len(ALPHABET)
    single = {c: 1.0 for c in ALPHABET}
    for pair, n in counts.items():
        if pair[1] in single:
            single[pair[1]] += n
    total = sum(single.values())
    rows = []
    for a in ALPHABET:
        seen = [counts.get(a + b, 0) for b in ALPHABET]
        weight = 5.0
        rows.append([
            math.log2(
                uniform / k
                + (1 - uniform) * (n + weight * single[b] / total) / (sum(seen) + weight)
            )
            for b, n in zip(ALPHABET, seen)
        ])
    return rows


def fit_models(df: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> MarkovModels:
    """Learn both models from strings that the fixed patterns label.

    Random strings: the distinct values that the base patterns find in all texts, mixed half
    and half with the uniform distribution, so that alphabets not seen still count as random.
    Ordinary strings: words outside base matches in about ``sample_docs`` texts, chosen by the
    hash of the text, and identifiers (snake, kebab, path, constant, camel case) and drawn lines put
    together from neighbouring words of the same texts; each occurrence counts.  Without any text both
    models are uniform and nothing but base spans is found.
    """
    texts = df.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    long = texts
    for order, (kind, pattern, group, least) in enumerate(BASE):
        long = _spans(long, "text", order, kind, FAST.get(kind, pattern), group, least, f"{kind}_")
    found = F.concat(*[F.col(f"{kind}_") for kind, *_ in BASE])
    values = long.select(F.explode(found).alias("s")).select(F.col("s.value").alias("t")).distinct()
    values = values.withColumn("n", F.lit(1))
    n = texts.count()
    share = F.lit(min(1.0, sample_docs / max(n, 1)))
    drawn = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1_000_003)) < share * 1_000_003
    rest = texts.where(drawn).select(F.regexp_replace("text", BASE[0][1], " ").alias("text"))
    for kind in ("access", "hex"):
        rest = rest.select(F.regexp_replace("text", FAST[kind], " ").alias("text"))
    words = rest.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("t"))
    words = words.withColumn("n", F.lit(1))
    ordinary = words.unionByName(_identifiers(rest))
    random, plain = _log_model(_pair_counts(values), 0.5), _log_model(_pair_counts(ordinary), 1e-4)
    return MarkovModels(tuple(
        round(SCALE * (r - o)) for rs, os in zip(random, plain) for r, o in zip(rs, os)
    ))


def with_spans(
    df: DataFrame, models: MarkovModels, text_col: str = "text", out: str = "spans",
    min_bits: float = 24.0, bits_per_char: float = 2.5,
) -> DataFrame:
    """Add ``out``: sorted array of ``(start, ord, end, kind, value)``, base spans and model spans.

    The models judge runs of 20 and more characters of their alphabet; a run is a span of kind
    ``markov`` if its log-likelihood ratio reaches both ``min_bits`` and ``bits_per_char`` for each
    character and it meets no base span.  Offsets are code points, ends exclusive.  NULL text counts
    as empty.  Rows are judged one by one.
    """
    text = free_name(df, "text_")
    work = df.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    names = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        names.append(free_name(work, f"{kind}_"))
        work = _spans(work, text, order, kind, FAST.get(kind, pattern), group, least, names[-1])
    base, run = free_name(work, "base_"), free_name(work, "run_")
    work = work.withColumn(base, F.array_sort(F.concat(*names)))
    work = _spans(work, text, len(BASE), "markov", RUN, 0, 20, run)
    bits = lambda r: models.bits(r["value"])
    judged = F.filter(
        F.col(run),
        lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
        & (bits(r) >= F.greatest(F.lit(min_bits), bits_per_char * F.length(r["value"]))),
    )
    return work.withColumn(out, F.array_sort(F.concat(base, judged))).drop(text, base, run, *names)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_scan(df: DataFrame, models: MarkovModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with base counts, the digest of the base spans, and all spans."""
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    s = F.col("all_")
    base = F.filter(s, lambda x: x["ord"] < len(BASE))
    of_kind = lambda kind: F.filter(s, lambda x: x["kind"] == kind)
    kinds = {f"n_{k}": F.size(of_kind(k)).cast("long") for k, *_ in BASE}
    return with_spans(slim, models, "text", "all_").select(
        "doc_id", *[c.alias(k) for k, c in kinds.items()],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(s).alias("spans"),
    )


def redacted(df: DataFrame, models: MarkovModels, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The rows with every span of ``text_col`` replaced by ``mask``; overlapping spans share one.

    NULL text stays NULL; all other columns stay as they are.
    """
    spans, kept = free_name(df, "spans_"), free_name(df, "kept_")
    work = with_spans(df, models, text_col, spans)
    # what stays: the gaps between merged spans
    state = "struct<pos:int,gaps:array<struct<lo:int,hi:int>>>"
    start = F.from_json(F.lit('{"pos":0,"gaps":[]}'), state)
    gap = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["pos"], s["end"]).cast("int").alias("pos"),
        F.when((s["start"] >= acc["pos"]), F.concat(acc["gaps"], F.array(gap(acc["pos"], s["start"]))))
        .otherwise(acc["gaps"]).alias("gaps"),
    )
    folded = F.aggregate(F.col(spans), start, step)
    work = work.withColumn(kept, F.when(F.size(spans) > 0, folded))
    pieces = F.transform(
        F.col(kept)["gaps"], lambda g: F.substr(F.col(text_col), g["lo"] + 1, g["hi"] - g["lo"])
    )
    tail = F.substr(F.col(text_col), F.col(kept)["pos"] + 1, F.length(text_col))
    return work.withColumn(
        text_col,
        F.when(F.col(kept).isNull(), F.col(text_col)).otherwise(
            F.array_join(F.concat(pieces, F.array(tail)), mask)
        ),
    ).drop(spans, kept)
