"""Audit of how sources diverge in their words: smoothed term rates of each source against its language and its other sources.

Terms are counted in Arrow batches and combined before the one shuffle by term.  Pairs of sources are compared sparsely: a pair
starts from the value it has if no term occurs in either, and is corrected for the terms of either side (through the number of
terms with each count) and for the terms that both have.  The terms that stand out most are found by radix selection: histograms
over the bits of the values narrow down each group's k-th value, ties are narrowed down by the bytes of the terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, safe

MIN_DOCS, TOP = 10, 10
#: Counters of a task are handed on when they have so many terms.
HELD_TERMS = 600_000
#: Bytes of a text that are cut into words at once.
PIECE = 4 << 20
#: Bits of a value that a histogram tells apart at once; of a tied item it is a byte.
DIGIT_BITS = 11
#: Rows of a group that are still tied or in doubt and may be ranked without further histograms.
SLACK = 512

NAMES = ("lang", "source", "term", "n", "docs")
KINDS = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in pieces: runs of letters and of characters beyond ASCII, only A-Z lower-cased."""
    at = 0
    while at < len(text):
        stop = at + PIECE
        while stop < len(text) and _TERMS[text[stop]] != 32:
            stop += 1
        yield text[at:stop].translate(_TERMS).split()
        at = stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of term_counts, combined over as many texts as give HELD_TERMS entries."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for (lang, source), (n, docs) in groups.items():
            found = [(b"", 0, 0), *((t, c, docs[t]) for t, c in n.items())]  # the empty term says that the group occurs
            for column, values in zip(rows, ([lang] * len(found), [source] * len(found), [t.decode("utf-8", "replace") for t, _, _ in found], [c for _, c, _ in found], [d for _, _, d in found]), strict=True):
                column.extend(values)
            if len(rows[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, KINDS, strict=True)], names=list(NAMES))
                for column in rows:
                    column.clear()
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, KINDS, strict=True)], names=list(NAMES))
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            group = (lang.as_py() or "", source.as_py() or "")
            if group not in groups:
                groups[group] = (Counter(), Counter())
                held += 1
            n, docs = groups[group]
            before = len(n)
            seen: set[bytes] = set()
            for piece in terms(text.as_py() or b""):
                n.update(piece)
                seen.update(piece)
            docs.update(seen)
            held += len(n) - before
            if held > HELD_TERMS:
                yield from handed_on()
                held = 0
    yield from handed_on()


def term_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, leads): occurrences in the source and in the language of the terms that it keeps; null reads as empty.

    ``leads`` is true for one source of each (lang, term).  Every (lang, source) that occurs has a row with the empty term and
    n = 0, which is no term's.  Rows are dealt out once, by language and term; sums by source and by language follow in place.
    """
    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    sums = rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    summed = sums.select("lang", "source", "term", "n", F.sum("n").over(whole).alias("lang_n"), (F.min("source").over(whole) == F.col("source")).alias("leads"), F.sum("docs").over(whole).alias("docs"))
    return summed.filter((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs")


def rate(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 (n + 2) / (total + 2 kept)) without rounding; null where no term is kept."""
    whole = F.nullif(total + 2 * kept, F.lit(0)).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", (n + 2).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), whole)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); rates are at most 10**9 + 1, so a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def radix_top(rows: DataFrame, group: list[str], value: str, item: str, k: int, *, slack: int = SLACK, value_bits: int = 63) -> DataFrame:
    """Each group's first k rows by ``value`` descending, then the UTF-8 bytes of ``item`` ascending, with ``rank`` (int, from 1).

    ``value`` is a long from 0 to 2**value_bits - 1, not null; a null item reads as empty; group columns may be null; other columns
    stay, whatever their names (``rank`` excepted).  Of rows equal in both, which come first depends on where they lie.

    A histogram over the next bits of the value splits each group: what lies above the digit that holds the k-th row is in, what
    lies below is out, and that digit's rows go on for what is left of k.  After the value's bits come the item's bytes (an ended
    item before all others), then the rows' numbers.  So no group lies in one task until at most ``slack`` rows more than wanted
    are left of it; those are ranked by a window.
    """
    digit, n, above, left, inside, tie = safe(rows, "digit", "n", "above", "left", "inside", "tie")
    columns = rows.columns
    rows = materialize(rows.withColumn(tie, F.monotonically_increasing_id()), "radix-rows")
    item_bytes = F.hex(F.coalesce(F.col(item), F.lit("")).cast("binary"))
    keyed = lambda frame: frame.select(*(F.col(c).alias(f"{c}_") for c in group), *(F.col(c) for c in frame.columns if c not in group))

    def digits() -> Iterator[Column]:
        """The digits by which rows come, the highest first."""
        bits = lambda c, of: (F.shiftright(c, max(0, at - DIGIT_BITS)).bitwiseAND((1 << min(DIGIT_BITS, at)) - 1) for at in range(of, 0, -DIGIT_BITS))
        yield from bits(F.col(value), value_bits)
        for at in range((in_doubt.agg(F.max(F.octet_length(item))).first()[0] or 0) + 1):
            yield -F.coalesce(F.conv(F.nullif(F.substring(item_bytes, 2 * at + 1, 2), F.lit("")), 16, 10).cast("long"), F.lit(-1))
        yield from bits(F.lit((1 << 63) - 1) - F.col(tie), 63)

    in_doubt, chosen = rows.withColumn(left, F.lit(k)), []
    for found in digits():
        sizes = in_doubt.groupBy(*group).agg(F.count("*").alias(n), F.first(left).alias(left))
        large = keyed(materialize(sizes.filter(F.col(n) > F.col(left) + slack).select(*group), "radix-groups"))
        if large.isEmpty():
            break
        same = [in_doubt[c].eqNullSafe(large[f"{c}_"]) for c in group]
        chosen.append(in_doubt.join(large, same, "left_anti").select(*columns))
        now = in_doubt.join(large, same, "left_semi").withColumn(digit, found)
        higher = Window.partitionBy(*group).orderBy(F.desc(digit)).rowsBetween(Window.unboundedPreceding, -1)
        counts = now.groupBy(*group, digit).agg(F.count("*").alias(n), F.first(left).alias(left)).withColumn(above, F.coalesce(F.sum(n).over(higher), F.lit(0)))
        kth = keyed(counts.filter((F.col(above) < F.col(left)) & (F.col(above) + F.col(n) >= F.col(left))).select(*group, F.col(digit).alias(f"{digit}_"), above))
        met = now.join(kth, [now[c].eqNullSafe(kth[f"{c}_"]) for c in group]).filter(F.col(digit) >= F.col(f"{digit}_")).withColumn(inside, F.col(digit) > F.col(f"{digit}_"))
        met = materialize(met.select(*columns, tie, (F.col(left) - F.col(above)).cast("int").alias(left), inside), "radix-step")
        chosen.append(met.filter(inside).select(*columns))
        in_doubt = met.filter(~F.col(inside)).drop(inside)
    last = in_doubt.select(*columns)
    for part in chosen:
        last = last.unionByName(part)
    order = Window.partitionBy(*group).orderBy(F.desc(value), F.coalesce(F.col(item), F.lit("")))
    return last.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source's term rates differ from other sources' and from its language's.

    A language keeps the terms of ``min_docs`` of its documents.  Part ``pair``: each other source of the language, ranked by the
    sum of ``gap`` over all kept terms (0 if there are none).  Part ``term``: the ``top`` terms that the source uses more than its
    language, ranked by ``gap``.  A null text, lang or source reads as empty, and empty ones are groups like any other.  Ties go by
    the bytes of the item.  A source alone in its language has no pairs, an empty table gives no rows, repeated rows count, texts
    are read whole in pieces of PIECE bytes.  Columns other than text, lang and source are left out, whatever their names.
    """
    counts = materialize(term_counts(docs, min_docs), "divergence-counts")
    kept = counts.filter(F.col("term") != "")
    langs = kept.filter("leads").groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter(F.col("term") == "").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    groups = materialize(groups.withColumn("p0", rate(F.lit(0), F.col("total"), F.col("kept"))), "divergence-groups")
    rated = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", rate(F.col("n"), F.col("total"), F.col("kept")).alias("p"), rate(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"), "p0")

    more = rated.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    shown = radix_top(more, ["lang", "source"], "value", "item", top, value_bits=31)

    other = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, rated).select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    return pairs.withColumn("rank", F.row_number().over(other).cast("int")).unionByName(shown)


def pair_values(groups: DataFrame, rated: DataFrame) -> DataFrame:
    """(lang, a, b, value) for sources a < b of a language: the sum of ``gap`` over its kept terms, from what occurs in either.

    With p0 for the rate of a term that does not occur: all kept terms at gap(p0a, p0b); for each term of one side what its rate
    changes in that, by the number of terms with that rate; for each term of both sides what the two changes leave out.
    """
    left = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("p0a"), "kept")
    right = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("p0b"))
    sides = materialize(left.join(right, "lang").filter(F.col("a") != F.col("b")), "divergence-pairs")
    none = gap(F.col("p0a"), F.col("p0b"))
    least, greatest = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    base = sides.filter(F.col("a") < F.col("b")).select("lang", "a", "b", F.coalesce(F.col("kept") * none, F.lit(0)).alias("value"))
    rates = rated.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("terms"))
    one = rates.join(sides, ["lang", "a"]).select("lang", least, greatest, (F.col("terms") * (gap(F.col("p"), F.col("p0b")) - none)).alias("value"))
    x = rated.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("p0a"))
    y = rated.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("p0b"))
    change = gap(F.col("pa"), F.col("pb")) - gap(F.col("pa"), F.col("p0b")) - gap(F.col("p0a"), F.col("pb")) + none
    both = x.join(y, ["lang", "term"]).filter(F.col("a") < F.col("b")).select("lang", "a", "b", change.alias("value"))
    return base.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
