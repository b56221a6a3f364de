"""Line dedup within an edit distance of one, by a deletion-neighbourhood join.

Lines are compared in normal form (A-Z lower-cased, ASCII white space folded and trimmed).  Two lines of MIN_FUZZY code
points or more lie within one edit if and only if both give the same text when the character at the same place is deleted
(substitution), or the shorter one is the longer one with a character deleted.  Each line therefore emits the hashes of its
deletion variants and of itself; equal hashes are joined, edit distances verified, and the earliest line stays.

Most lines have no near line, and their variants would be many times the corpus.  An exact filter spares them: cut a line in
``BLOCKS`` blocks; one edit lies in one block, so near lines agree in the hash of all but some block (suffixes are counted
from the end, and block bounds depend on the length in steps of 16, so an inserted character moves none; a line whose
length is a multiple of 16 also emits the keys of the step below).  Only lines that share such a key with another line emit
variants, and only for the block in question.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_rows, materialize, safe, utf8

#: Code points from which lines are compared within one edit; shorter ones only exactly.
MIN_FUZZY = 16
BLOCKS = 4
#: A table of keys of at most this many rows (8 to 16 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000

#: An odd multiplier and its inverse modulo 2**64.
BASE = np.uint64(0xD6E8FEB86659FD93)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))

digest = xxhash.xxh64_intdigest


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def normal(line: bytes) -> str:
    return b" ".join(line.split()).lower().decode()


def cuts(n: int) -> list[tuple[int, int, int]]:
    """(step, start, stop) of each block that a line of ``n`` code points is compared without."""
    step = n - n % MIN_FUZZY
    steps = [step, step - MIN_FUZZY] if n == step and step > MIN_FUZZY else [step]
    return [(m, i * m // BLOCKS, n - (BLOCKS - 1 - i) * m // BLOCKS) for m in steps for i in range(BLOCKS)]


def key_without(line: str, step: int, start: int, stop: int) -> int:
    return digest(f"{step}/{start}/{line[:start]}\0{line[stop:]}".encode(), 7)


def small(frame: DataFrame, rows: int) -> DataFrame:
    """The written table with a broadcast hint if its row count allows it."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def lines_of(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: d (doc_id), r (hash of the text), line, h1 and h2 (128-bit hash), and keys."""

    def fn(c: dict[str, list]) -> dict[str, list]:
        d, r, at, h1, h2, keys = [], [], [], [], [], []
        for doc, row, text in zip(c["d"], c["r"], c["t"], strict=True):
            for i, raw in enumerate(text.split(b"\n")):
                if line := normal(raw):
                    data = line.encode()
                    d.append(doc)
                    r.append(row)
                    at.append(i)
                    h1.append(digest(data, 1))
                    h2.append(digest(data, 2))
                    n = len(line)
                    keys.append(signed([key_without(line, *cut) for cut in cuts(n)]) if n >= MIN_FUZZY else [])
        return {"d": d, "r": r, "line": at, "h1": signed(h1), "h2": signed(h2), "keys": keys}

    return map_rows(docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("r"), utf8("text").alias("t")), fn, "d long, r long, line int, h1 long, h2 long, keys array<long>")


def texts_of(docs: DataFrame) -> DataFrame:
    """d, r, line, h1 and the normal text of each line that may have near lines."""

    def fn(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"d": [], "r": [], "line": [], "h1": [], "text": []}
        for doc, row, text in zip(c["d"], c["r"], c["t"], strict=True):
            for i, raw in enumerate(text.split(b"\n")):
                line = normal(raw)
                if len(line) >= MIN_FUZZY:
                    for k, v in zip(out, (doc, row, i, digest(line.encode(), 1), line), strict=True):
                        out[k].append(v)
        return out | {"h1": signed(out["h1"])}

    return map_rows(docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("r"), utf8("text").alias("t")), fn, "d long, r long, line int, h1 long, text string")


def without_each(line: str) -> tuple[int, np.ndarray]:
    """The hash of a line, and of the line without each of its characters, in one pass.

    The hash is the sum of mixed code points times powers of an odd BASE, modulo 2**64: what stands behind a deleted
    character moves by one place, which the inverse of BASE undoes.  Equal lines have equal hashes; others are told apart
    when edit distances are verified.
    """
    points = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(points), BASE))), dtype=np.uint64)[:-1]
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed * power, dtype=np.uint64)))
    return int(sums[-1]), sums[:-1] + (sums[-1] - sums[1:]) * UNBASE


def variants(lines: DataFrame) -> DataFrame:
    """key, place (-1: the line itself) and h1 of the line and of its deletion variants in the blocks of its shared keys."""

    def fn(c: dict[str, list]) -> dict[str, list]:
        key, place, owner = [], [], []
        for h1, line, shared in zip(c["h1"], c["text"], c["shared"], strict=True):
            wanted, near = set(shared), np.zeros(len(line), bool)
            for cut in cuts(len(line)):
                if int(signed([key_without(line, *cut)])[0]) in wanted:
                    near[cut[1] : cut[2]] = True
            whole, each = without_each(line)
            places = np.flatnonzero(near)
            key += [np.array([whole], np.uint64), each[places]]
            place += [np.array([-1]), places]
            owner.append(np.full(len(places) + 1, h1))
        return {"key": np.concatenate(key).view(np.int64), "place": np.concatenate(place), "h1": np.concatenate(owner)}

    return map_rows(lines.select("h1", "text", "shared"), fn, "key long, place int, h1 long")


def first_lines(docs: DataFrame) -> DataFrame:
    """The first occurrence (by doc_id with nulls first, text hash, line) of every distinct line: h1, h2, first, keys."""
    lines = lines_of(docs)
    where = F.struct("d", "r", "line")
    return materialize(lines.groupBy("h1", "h2").agg(F.min(F.struct(where.alias("w"), F.col("keys"))).alias("m")).select("h1", "h2", F.col("m.w").alias("first"), F.col("m.keys").alias("keys")), "first-lines")


def near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """h1 and earlier (an h1) of each distinct line that has a line within one edit that occurs first earlier."""
    keyed = firsts.filter(F.size("keys") > 0).select("h1", F.explode("keys").alias("key"))
    hot = materialize(keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key"), "line-keys")
    shared = materialize(
        keyed.join(small(hot, hot.count()), "key", "left_semi").groupBy("h1").agg(F.collect_set("key").alias("shared")).join(firsts.select("h1", "first"), "h1"), "line-shared"
    )
    rows = shared.count()
    place = shared.select(F.col("h1").alias("s_h1"), F.col("first.d").alias("s_d"), F.col("first.r").alias("s_r"), F.col("first.line").alias("s_line"), "first", "shared")
    same = (F.col("h1") == F.col("s_h1")) & F.col("d").eqNullSafe(F.col("s_d")) & (F.col("r") == F.col("s_r")) & (F.col("line") == F.col("s_line"))
    texts = materialize(texts_of(docs).join(small(place, rows), same).select("h1", "first", "shared", "text").dropDuplicates(["h1"]), "line-texts")
    made = variants(texts)
    met = materialize(made.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key"), "line-variants")
    some = materialize(made.join(small(met, met.count()), "key", "left_semi").join(texts.select("h1", "first"), "h1"), "line-met")

    member = F.struct("first", "h1")
    # lines that differ in one character at the same place, and a line with those that have one character more
    by_place = some.filter("place >= 0").groupBy("key", "place").agg(F.min(member).alias("best"))
    alone = some.filter("place < 0").groupBy("key").agg(F.min(member).alias("best"))
    longer = some.filter("place >= 0").groupBy("key").agg(F.min(member).alias("best"))
    links = (
        some.filter("place >= 0").join(by_place, ["key", "place"]).select("h1", "first", "best")
        .unionByName(some.filter("place >= 0").join(alone, "key").select("h1", "first", "best"))
        .unionByName(some.filter("place < 0").join(longer, "key").select("h1", "first", "best"))
        .filter(F.col("best.first") < F.col("first"))
        .select("h1", F.col("best.h1").alias("earlier"))
        .distinct()
    )
    left, right = texts.select("h1", F.col("text").alias("t1")), texts.select(F.col("h1").alias("earlier"), F.col("text").alias("t2"))
    return links.join(left, "h1").join(right, "earlier").filter(F.levenshtein("t1", "t2", 1) >= 0).select("h1", "earlier")


def kept_lines(docs: DataFrame) -> DataFrame:
    """d, r and kept of each document with lines that stay: bit i % 64 of entry i // 64 tells of line i; 0 may lack at the end."""
    firsts = first_lines(docs)
    near = materialize(near_lines(docs, firsts).select("h1").distinct(), "line-near")
    stay = firsts.join(small(near, near.count()), "h1", "left_anti")
    word, bit = F.floor(F.col("line") / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("line") % 64)
    # both groupings use the one exchange by document
    words = stay.select("first.*").repartition("d", "r").groupBy("d", "r", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    held = words.groupBy("d", "r").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("of"), F.max("word").alias("last"))
    return held.select("d", "r", F.transform(F.sequence(F.lit(0), "last"), lambda w: F.coalesce(F.try_element_at("of", w), F.lit(0).cast("long"))).alias("kept"))


def with_kept_lines(docs: DataFrame) -> tuple[DataFrame, str, str, str]:
    """``docs`` with its lines, the number of its lines with a word, and the text of the lines that stay."""
    d, r, kept, lines, n, text, k_d, k_null, k_r = safe(docs, "ld_d", "ld_r", "ld_kept", "ld_lines", "ld_words", "ld_text", "k_d", "k_null", "k_r")
    stay = kept_lines(docs).select(F.coalesce("d", F.lit(0)).alias(k_d), F.col("d").isNull().alias(k_null), F.col("r").alias(k_r), F.col("kept").alias(kept))
    joined = docs.withColumns({d: F.coalesce("doc_id", F.lit(0)), r: F.xxhash64("text")}).join(
        stay, (F.col(d) == F.col(k_d)) & (F.col("doc_id").isNull() == F.col(k_null)) & (F.col(r) == F.col(k_r)), "left"
    )
    split = joined.withColumn(lines, F.split(F.coalesce("text", F.lit("")), "\n", -1))
    worded = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    stays = lambda i: F.coalesce(F.call_function("shiftright", F.get(kept, F.floor(i / 64).cast("int")), i % 64).bitwiseAND(1) == 1, F.lit(False))
    held = F.filter(lines, lambda x, i: ~worded(x) | stays(i))
    out = split.withColumn(n, F.size(F.filter(lines, worded)).cast("long")).withColumn(text, F.array_join(held, "\n"))
    ones = F.aggregate(F.coalesce(kept, F.array().cast("array<bigint>")), F.lit(0), lambda s, w: s + F.bit_count(w))
    return out.withColumn(kept, ones.cast("long")), n, kept, text


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (lines with a word), n_kept, and the SHA-256 of the text that stays, for each row."""
    out, n, kept, text = with_kept_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col(n).alias("n_lines"), F.col(kept).alias("n_kept"), F.sha2(F.col(text), 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with only the earliest of equal and near lines, columns as given.

    Lines come in the order of doc_id (null first), text hash and line number; a line goes if an equal line, or one within
    one edit, comes first earlier, even where that line goes as well.  Lines without a word stay.  Rows equal in doc_id
    and text are one document and get equal results.  A document that loses all its lines with words goes; null, empty and
    blank texts stay as they are.  n_chars, where present, follows the text.  Lines and texts of any length are compared
    whole, in time that grows with them; lines under MIN_FUZZY code points go only as exact copies, as most short lines (list
    items, names, numbers) are one edit from some other line without being its copy.  An empty table gives no rows, and
    columns may have any names.
    """
    out, n, kept, text = with_kept_lines(docs)
    left = out.filter((F.col(n) == 0) | (F.col(kept) > 0))
    changed = F.col(n) > F.col(kept)
    new: dict[str, Column] = {"text": F.when(changed, F.col(text)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumns(new).select(*docs.columns)
