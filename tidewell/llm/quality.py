"""Quality rules: a learned decision list over statistics of whole texts.

Statistics of a bounded sample of labelled documents are gathered on the driver, where sequential covering learns an
ordered list of rules: a rule grows by the threshold condition with the largest FOIL gain, is pruned on held-out rows, and
is kept while it is precise; rows it covers are set aside and the next rule is grown.  The list becomes one ordered Spark
conditional expression that is applied to every document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_rows, safe

#: Labelled documents to fit on: the first by hash of their id.
MAX_LABELLED = 6_000
SPACE, SYMBOLS, PUNCTUATION = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b".,;:!?"
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
#: Counts of a text, in order; the first five are n_words and the base statistics.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_shouts", "n_echoes", "n_distinct")


def counts(text: bytes) -> tuple[int, ...]:
    """The COUNTS of one UTF-8 text.

    Words are runs without ASCII white space.  n_repeat_words: words inside windows of three words that occur at least
    twice; n_dup_lines: lines with a word that equal an earlier line; n_echoes: words equal to the word before them.
    """
    tokens = text.split()
    n = len(tokens)
    if not n:
        return (0,) * len(COUNTS)
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), np.int64, n)
    repeated = 0
    if n >= 3 and len(ids) < n:
        pairs = codes[:-1] * len(ids) + codes[1:]
        _, pairs = np.unique(pairs, return_inverse=True)
        _, at, seen = np.unique(pairs[:-1] * len(ids) + codes[2:], return_inverse=True, return_counts=True)
        found = seen[at] > 1
        covered = np.zeros(n, bool)
        covered[:-2] |= found
        covered[1:-1] |= found
        covered[2:] |= found
        repeated = int(covered.sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(text)
    dense = size - (size - len(text.translate(None, SPACE)))
    # code points: bytes that do not continue a character
    chars = len(text.translate(None, bytes(range(0x80, 0xC0)))) - (size - dense)
    marks = size - len(text.translate(None, PUNCTUATION))
    return (
        n,
        chars,
        size - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        size - len(text.translate(None, UPPER)),
        size - len(text.translate(None, DIGITS)),
        marks,
        text.count(b"!"),
        int((codes[1:] == codes[:-1]).sum()),
        len(ids),
    )


def with_counts(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the COUNTS of each text as long columns; the second value maps each count to its column's name."""
    names = dict(zip(COUNTS, safe(docs, *COUNTS), strict=True))
    kept = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` long" for n in names.values())])

    def fn(c: dict[str, list]) -> dict[str, list]:
        made = [counts(t.encode() if isinstance(t, str) else t or b"") for t in c["text"]]
        return {k: c[k] for k in kept} | {n: [m[i] for m in made] for i, n in enumerate(names.values())}

    return map_rows(docs, fn, schema), names


def per(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def features(c: dict[str, Column]) -> dict[str, Column]:
    """The statistics that rules test, as Spark expressions over the counts."""
    words, chars = c["n_words"], c["word_chars"]
    return {
        "words": words.cast("double"),
        "chars_per_word": per(chars, words),
        "symbols_per_word": per(c["n_symbols"], words),
        "dup_lines_per_line": per(c["n_dup_lines"], c["n_lines"]),
        "repeat_words_per_word": per(c["n_repeat_words"], words),
        "words_per_line": per(words, c["n_lines"]),
        "upper_per_char": per(c["n_upper"], chars),
        "digits_per_char": per(c["n_digits"], chars),
        "marks_per_word": per(c["n_marks"], words),
        "shouts_per_word": per(c["n_shouts"], words),
        "echoes_per_word": per(c["n_echoes"], words),
        "distinct_per_word": per(c["n_distinct"], words),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, f: dict[str, Column]) -> Column:
        return f[self.feature] > self.threshold if self.above else f[self.feature] <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.threshold if self.above else x <= self.threshold


@dataclass
class DecisionList:
    """Ordered rules that reject; a document that none covers is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def keep(self, f: dict[str, Column]) -> Column:
        """One conditional expression, rules in order, true by default."""
        out = None
        for rule in self.rules:
            test = rule[0].column(f)
            for condition in rule[1:]:
                test = test & condition.column(f)
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def rejects(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        out = np.zeros(n, bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.holds(x[c.feature]) for c in rule])
        return out

    def describe(self) -> list[str]:
        return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in r) + " -> reject" for r in self.rules]


def best_condition(x: dict[str, np.ndarray], bad: np.ndarray, on: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the largest FOIL gain on the rows ``on``."""
    p0, n0 = int((bad & on).sum()), int((~bad & on).sum())
    best: tuple[float, Condition | None] = (1e-9, None)
    if not p0 or not n0:
        return best
    before = np.log2(p0 / (p0 + n0))
    for name, values in x.items():
        v, y = values[on], bad[on]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        below_p = np.cumsum(y)[cut]
        below_n = cut + 1 - below_p
        for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / (p + n)) - before)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), Condition(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray, precision: float = 0.97, least: int = 5, most: int = 24) -> DecisionList:
    """Sequential covering: grow each rule on rows not ``held``, prune it on held rows, keep it while precise on both."""
    out, left = DecisionList(), np.ones(len(bad), bool)
    while len(out.rules) < most and (bad & left & ~held).any():
        on, rule = left & ~held, []
        while len(rule) < 6:
            _, condition = best_condition(x, bad, on)
            if condition is None:
                break
            rule.append(condition)
            on &= condition.holds(x[condition.feature])

        def covered(some: list[Condition], rows: np.ndarray) -> np.ndarray:
            return np.logical_and.reduce([rows, *(c.holds(x[c.feature]) for c in some)])

        def worth(some: list[Condition]) -> float:
            c = covered(some, left & held)
            p, n = (bad & c).sum(), (~bad & c).sum()
            return float((p - n) / (p + n)) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        if not rule:
            break
        c = covered(rule, left)
        p = int((bad & c).sum())
        if p < least or (p + 1) / (c.sum() + 2) < precision * (1 - 1 / (c.sum() + 2)):
            break
        out.rules.append(tuple(rule))
        left &= ~c
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learns from at most ``max_labelled`` labelled documents (doc_id, quality; 0 is bad), chosen by hash of their id.

    Where an id has several labels the lowest counts.  Null labels and ids, and labels without a document, are left out;
    without both kinds of label, or without documents, the list is empty and keeps all.  Texts of any length are counted whole.
    """
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("l_id"))
        .agg(F.min("quality").alias("l_quality"))
        .orderBy(F.xxhash64("l_id"), "l_id")
        .limit(max_labelled)
    )
    # max_labelled ids at most
    rows, names = with_counts(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("doc_id", "l_quality", "text"))
    f = features({k: F.col(n) for k, n in names.items()})
    got = rows.select("doc_id", "l_quality", *(v.alias(k) for k, v in f.items())).limit(2 * max_labelled).toPandas().sort_values(["doc_id", *f], ignore_index=True)
    if got.empty:
        return DecisionList()
    x = {k: got[k].to_numpy(float) for k in f}
    held = (got["doc_id"].to_numpy(np.int64) * 2654435761 % 4294967296) % 3 == 0
    return learn(x, got["l_quality"].to_numpy() == 0, held)


def judge(docs: DataFrame, rules: DecisionList, least_words: int = 50, most_repeated: int = 50) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its counts, base_failed and kept; base rules come first, then the learned list.

    Null and empty texts have no words and fail the base rule.  Each row is judged by its text alone, so repeated rows
    get equal verdicts; texts of any length are counted whole and an empty table gives no rows; clashing column names get underscores before the new ones, as the second value tells.
    """
    rows, names = with_counts(docs)
    failed, kept = safe(rows, "base_failed", "kept")
    c = {k: F.col(n) for k, n in names.items()}
    out = rows.withColumn(failed, (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeated * c["n_words"]))
    return out.withColumn(kept, ~F.col(failed) & rules.keep(features(c))), names | {"base_failed": failed, "kept": kept}


def filter_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, columns as given; null and empty texts go, equal rows are judged alike.

    Texts of any length are judged whole, columns may have any names, and an empty table gives no rows; without labels of both kinds
    only the base rules apply.
    """
    judged, names = judge(docs, fit(docs, labels), **options)
    return judged.filter(F.col(names["kept"])).select(*docs.columns)
