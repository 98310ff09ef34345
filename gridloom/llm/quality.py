"""Quality rules learned as an ordered list of threshold conjunctions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.common import clean, free_name, once

SAMPLE_ROWS = 20_000  # labelled rows the list is fitted on, at most
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_marks", "n_types",
]
FIELDS = ", ".join(f"{c} long" for c in COUNTS)
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "types_per_word": ("n_types", "n_words"),
}
FEATURES = ["n_words", *RATIOS]


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    code, base = ids[:n], len(numbers)
    top = base
    for k in range(1, size):
        if top > (1 << 62) // base:  # number the prefixes anew before they overflow
            code = np.unique(code, return_inverse=True)[1]
            top = n
        code = code * base + ids[k : k + n]
        top *= base
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def measure(text: str) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # white space 09-0D and 20, as bytes know it
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    first = Counter(lines)
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(first),
        repeated_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, bytes(range(65, 91)))),
        len(raw) - len(raw.translate(None, bytes(range(48, 58)))),
        text.count("!") + text.count("?"),
        len(set(words)),
    )


def text_counts(text: str | Column) -> Column:
    """Struct of ``COUNTS`` of every whole text; NULL counts as empty."""

    @F.pandas_udf(FIELDS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in clean(texts)], columns=COUNTS, dtype="int64")

    return once(run)(F.col(text) if isinstance(text, str) else text)


def features(counts: Column) -> dict[str, Column]:
    out = {"n_words": counts["n_words"].cast("double")}
    for name, (part, whole) in RATIOS.items():
        out[name] = counts[part].cast("double") / F.greatest(counts[whole], F.lit(1))
    return out


Rule = list[tuple[str, str, float]]  # conjunction of (feature, "<=" or ">", threshold)


def _covered(rule: Rule, x: pd.DataFrame) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for name, op, cut in rule:
        hit &= (x[name] <= cut) if op == "<=" else (x[name] > cut)
    return hit


def _grow(x: pd.DataFrame, bad: np.ndarray, thresholds: dict[str, np.ndarray]) -> Rule:
    """Add the condition of highest information gain until no good row is covered."""
    rule: Rule = []
    hit = np.ones(len(x), dtype=bool)
    while len(rule) < 4 and (hit & ~bad).any():
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        if not p:
            break
        best = (0.0, None, None)
        for name, cuts in thresholds.items():
            values = x[name].to_numpy()
            for cut in cuts:
                low = values <= cut
                for op, side in (("<=", low), (">", ~low)):
                    q, m = (hit & side & bad).sum(), (hit & side & ~bad).sum()
                    if q:
                        gain = q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (name, op, float(cut)), side)
        if best[1] is None:
            break
        rule.append(best[1])
        hit = hit & best[2]
    return rule


def _worth(rule: Rule, x: pd.DataFrame, bad: np.ndarray) -> float:
    hit = _covered(rule, x)
    return ((hit & bad).sum() + 1) / (hit.sum() + 2)


def fit_rules(x: pd.DataFrame, bad: np.ndarray, precision: float = 0.95, most: int = 12) -> list[Rule]:
    """Sequential covering of the bad rows.

    Two rows of three grow a conjunction; the third row prunes its last conditions away, down to
    the beginning of highest worth of which at least ``precision`` of the covered rows are bad.
    Covered rows leave before the next rule is grown.  The feature that opens an unsound rule is
    barred from then on; when nothing can be grown the list ends.
    """
    rules: list[Rule] = []
    fold = np.arange(len(x)) % 3
    left = np.ones(len(x), dtype=bool)
    barred: set[str] = set()
    while len(rules) < most and (left & bad).any():
        grow, prune = left & (fold < 2), left & (fold == 2)
        shares = np.linspace(0.01, 0.99, 33)
        cuts = {
            f: np.unique(np.quantile(x[f][grow], shares)) for f in FEATURES if f not in barred
        } if grow.any() else {}
        rule = _grow(x[grow], bad[grow], cuts)
        sound = []
        for k in range(1, len(rule) + 1):
            hit = _covered(rule[:k], x) & left
            if hit.sum() >= 3 and (hit & bad).sum() >= precision * hit.sum():
                sound.append((_worth(rule[:k], x[prune], bad[prune]), -k))
        if not rule:
            break
        if not sound:
            barred.add(rule[0][0])
            continue
        rule = rule[: -max(sound)[1]]
        rules.append(rule)
        left &= ~_covered(rule, x)
    return rules


def decision(rules: list[Rule], values: dict[str, Column]) -> Column:
    """The list as one ordered conditional expression: false at the first rule that holds."""
    verdict = None
    for rule in rules:
        holds = F.lit(True)
        for name, op, cut in rule:
            holds = holds & ((values[name] <= cut) if op == "<=" else (values[name] > cut))
        verdict = F.when(holds, False) if verdict is None else verdict.when(holds, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def learn_rules(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> list[Rule]:
    """Fit the list on at most ``rows`` labelled documents, taken in the order of a hash of the id.

    Of documents with one id and label, those of least features are taken.  Rows with NULL id or label
    are left out.  Without both kinds of label no rule is learned.
    """
    order = F.xxhash64(F.col(id_col))
    chosen = (
        labels.select(id_col, F.col(label_col).alias("label_"))
        .dropna()
        .orderBy(order, id_col, "label_")
        .limit(rows)
    )
    texts = docs.select(id_col, text_col)
    joined = texts.join(F.broadcast(chosen), id_col)  # bounded by ``rows``
    counted = joined.select(id_col, "label_", text_counts(text_col).alias("c_"))
    values = F.struct(*[c.alias(k) for k, c in features(F.col("c_")).items()])
    # repeated ids count once, whatever their number
    single = counted.groupBy(F.col(id_col).alias("id_"), "label_").agg(F.min(values).alias("values_"))
    frame = single.select("id_", "label_", "values_.*").toPandas()
    frame = frame.sort_values(["id_", "label_", *FEATURES], ignore_index=True)
    frame = frame.sample(frac=1.0, random_state=7, ignore_index=True)
    return fit_rules(frame[FEATURES], frame["label_"].to_numpy() == 0) if len(frame) else []


def quality_rules(
    docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Base counts, base verdict and the learned verdict of every whole text.

    NULL and empty text has no words and fails the base rule (fewer than 10 words).  Rows are
    judged one by one: repeated rows give repeated results, other columns are ignored.
    """
    counts = free_name(docs, "counts_")
    made = docs.select(F.col(id_col).alias("doc_id"), text_counts(text_col).alias(counts))
    c = F.col(counts)
    failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
    return made.select(
        "doc_id", *[c[k].alias(k) for k in COUNTS[:5]],
        failed.alias("base_failed"),
        (~failed & decision(rules, features(c))).alias("kept"),
    )
