"""Merkle manifest of a dataset: a digest of every row, a tree per source, a tree over the sources, and proofs.

Leaves are dealt out by range, so that a source's order is known from counts of sorted partitions and no source lies in one
task.  Trees are built bottom up: each level joins FANOUT consecutive nodes to their parent and is written.  Proofs are pushed
top down: each child prepends the siblings in its run to the suffix that it inherits, with the root of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, n_partitions

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"
#: The tree over the sources; a source's own tree is called - or =source, so that null comes first and the rest in order of bytes.
TOP = ""


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of a row's fields, each a dash if null, else the number of its UTF-8 bytes, a colon and itself."""
    text = {n: c.cast("string") for n, c in fields.items()}
    return sha256(F.concat(*[F.coalesce(F.concat(F.octet_length(text[n]).cast("string"), F.lit(":"), text[n]), F.lit("-")) for n in FIELDS]))


def leaves(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, tree, hash, seen, tie): ``hash`` of the row as it is, ``seen`` of the row with the ``tampered`` columns in place."""
    now = {n: F.col(n) for n in FIELDS}
    made = leaf(now)
    seen = leaf(now | tampered) if tampered else made
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    return docs.select("doc_id", tree.alias("tree"), made.alias("hash"), seen.alias("seen"), F.monotonically_increasing_id().alias("tie"))


def ranked(frame: DataFrame, *order: str) -> DataFrame:
    """``frame`` with ``idx``, each row's place from 0 in its ``tree`` in the given order, and ``n``, the tree's rows.

    Rows are sorted by range over all trees; a row's place is its place in its partition plus the tree's rows before that.
    """
    tagged = frame.repartitionByRange(n_partitions(frame.sparkSession), "tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    tagged = materialize(tagged, "merkle-order").withColumn("part", F.shiftright("at", 33))
    runs = tagged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return tagged.join(runs, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def build(nodes: DataFrame) -> list[DataFrame]:
    """Levels of all trees over written (tree, idx, n, hash), the lowest first; from the second on with ``kids``, the digests of a run.

    A tree with n nodes on a level has ceil(n / FANOUT) on the next, until it has one.
    """
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = levels[-1].filter("n > 1").groupBy("tree", F.expr(f"idx div {FANOUT}").alias("idx"))
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda k: k["hash"])
        above = run.agg(F.first("n").alias("n"), kids.alias("kids")).select("tree", "idx", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), sha256(F.array_join("kids", "")).alias("hash"), "kids")
        levels.append(materialize(above, "merkle-level"))
        most = -(-most // FANOUT)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of the one node that each tree ends in."""
    found = [level.filter("n = 1").select("tree", "hash") for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def pushed(levels: list[DataFrame], heads: DataFrame) -> DataFrame:
    """The lowest level with what it inherits: ``steps`` (siblings left and right of the way up) and the columns of ``heads``.

    ``heads`` has for each tree (key ``tree``) its root's steps and further columns.  All but the lowest level are written.
    """
    inherited = [c for c in heads.columns if c not in ("tree", "steps")]
    out = None
    for at in range(len(levels) - 1, -1, -1):
        level = levels[at].drop("kids") if at == 0 else levels[at]
        own = level.filter("n = 1").join(heads, "tree")
        if out is not None:
            place = (F.col("idx") % FANOUT).cast("int")
            step = F.struct(F.array_join(F.slice("above", 1, place), "").alias("left"), F.array_join(F.slice("above", place + 2, FANOUT), "").alias("right"))
            parents = out.select("tree", F.col("idx").alias("parent"), F.col("kids").alias("above"), F.col("steps").alias("suffix"), *inherited)
            rest = level.filter("n > 1").withColumn("parent", F.expr(f"idx div {FANOUT}")).join(parents, ["tree", "parent"])
            own = own.unionByName(rest.withColumn("steps", F.concat(F.array(step), "suffix")).drop("parent", "above", "suffix"))
        out = own if at == 0 else materialize(own, "merkle-proofs")
    return out


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, start, lambda h, s: sha256(F.concat(s["left"], h, s["right"])))


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, seen, subroot, root and the proof's steps from the leaf's run to the root.

    ``tampered`` gives columns in place of documents' own; ``seen`` is the leaf with them, ``leaf`` without.  A source's leaves
    ascend by doc_id (null first), then by digest; rows that repeat wholly are leaves each.  Sources ascend by their bytes, null
    first, and the empty one after it.  Any column may be null; texts of any length are read once, and only digests move.
    Columns other than those of FIELDS are left out, whatever their names.  An empty table gives no rows and has no root.
    """
    nodes = materialize(ranked(materialize(leaves(docs, tampered), "merkle-leaves"), "doc_id", "hash", "tie").drop("tie"), "merkle-level")
    levels = build(nodes.select("tree", "idx", "n", "hash"))
    subroots = roots(levels).withColumnRenamed("tree", "source").withColumn("tree", F.lit(TOP))
    top = build(materialize(ranked(materialize(subroots, "merkle-subroots"), "source").select("tree", "idx", "n", "hash", "source"), "merkle-level"))
    root = roots(top).select("tree", F.col("hash").alias("root"), F.array().cast(STEPS).alias("steps"))
    heads = pushed(top, root).select(F.col("source").alias("tree"), F.col("hash").alias("subroot"), "root", "steps")
    levels[0] = nodes
    return pushed(levels, materialize(heads, "merkle-heads")).select("doc_id", F.col("hash").alias("leaf"), "seen", "subroot", "root", "steps")


def proof_report(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, checked on a copy in which every fifth one (by CRC-32 of its id) has A-Z of its text in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = manifest(docs, {"text": F.when(hit, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))})
    proof = sha256(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""))
    shown = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("seen"), F.col("steps")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
