"""A word index over texts: a search reads the buckets of its rarest word and verifies the phrase in the texts found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import has_word, search_key
from tidewell.scratch import discard, passing_shuffles, scratch
from tidewell.sources import keyed

WORD = r"\w+"


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(search_key(text), F.lit(WORD), F.lit(0)))


def index(changed: DataFrame, path: str, count: int = 64, spread: int = 8, keep: int | None = None) -> None:
    """Brings new and changed rows (id, seq, text) into the index at ``path``; of an id the row with the largest seq holds.

    Words go in before texts, each in one commit, and a word that a text has lost stays until the index is made anew: words
    only propose texts, which a search verifies.  So a run that breaks off leaves an index that finds what its texts hold, and
    running it again completes it.  A word's ids are spread over ``spread`` buckets, so none holds all of a frequent word.
    With ``keep`` only so many states stay of words, then of texts, each once its batch is in: not while others search earlier ones.
    A row with a null text has no words; rows without an id are left out.
    """
    spark, changed = changed.sparkSession, changed.filter("id IS NOT NULL")
    parts = F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int")
    # written, as a merge reads its batch several times and words cost more to find than to read
    words = changed.select(F.explode(_words(F.col("text"))).alias("word"), parts.alias("part"), "id").withColumn("spread", F.lit(spread))
    written = scratch(spark, "words")
    with passing_shuffles(spark):
        words.write.parquet(written)
        # a row is nothing but its key, so batches meet as lists of ids
        keyed.merge(spark.read.schema(words.schema).parquet(written), f"{path}/words", ["word", "part", "spread", "id"], "id", "word", count, place=["word", "part"])
        discard(spark, written)
        if keep:
            keyed.clean(spark, f"{path}/words", keep)
        keyed.merge(changed.select("id", "seq", "text"), f"{path}/texts", ["id"], "seq", count=count)
        if keep:
            keyed.clean(spark, f"{path}/texts", keep)


def find(spark: SparkSession, path: str, term: str) -> DataFrame:
    """Rows (id, seq, text) whose text has the term at word bounds, without regard to case and accents.

    Of the term's words the one in the fewest texts is looked up, by counts kept beside the index; texts are read from their buckets,
    at most all, and the whole term is verified.  A term without letters or digits is looked for in every text.
    """
    folded = spark.range(1).select(search_key(F.lit(term)).alias("t")).select("t", F.array_distinct(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("w")).first()
    texts = keyed.read(spark, f"{path}/texts")
    if folded["w"] and keyed.manifest(spark, f"{path}/words") is None:
        return texts.filter("false")
    if folded["w"]:
        counts = {r["word"]: r["n"] for r in keyed.counts_of(spark, f"{path}/words", folded["w"]).collect()}
        rarest = min(folded["w"], key=lambda w: (counts.get(w, 0), w))
        asked = spark.range(_spread(spark, path)).select(F.lit(rarest).alias("word"), F.col("id").cast("int").alias("part"))
        ids = keyed.lookup(spark, f"{path}/words", asked).select("id")
        texts = texts.join(ids.distinct(), "id", "left_semi") if counts.get(rarest) else texts.filter("false")
    return texts.filter(has_word(search_key(F.col("text")), folded["t"]))


def _spread(spark: SparkSession, path: str) -> int:
    return keyed.read(spark, f"{path}/words").select("spread").first()[0]
