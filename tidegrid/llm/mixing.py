"""Mix sources to target shares of a total size in tokens.

Method: Efraimidis-Spirakis sampling. Each document gets the key -ln(u) / w, with u
a uniform number made from a hash of its id and w its quality weight; the smallest
keys are drawn first. A source's budget is its share of the total: complete epochs
first, then the documents in key order whose running sum stays within the rest.
No source is repeated more often than its cap; where that or a lack of texts keeps
it below its target, the report shows the share it really has.

Scale: the running sum of a source is built from key ranges of about BUCKET_ROWS
documents, cut by a sample of the keys themselves, so they are even at any weights:
sums per range with map-side combine give offsets, and rows are ordered only in the
one range per source in which the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lower_key
from ..sources.storage import small_side, stash
from .tokens import TOKENIZERS, VOCABULARY, with_tokens

BUCKET_ROWS = 50_000
SEED = 17
LEAST_WEIGHT = 0.05


def quality_weight(text: str | Column = "text") -> Column:
    """A weight in [LEAST_WEIGHT, 1] by simple rules of published corpora: share of letters, length of words, share of words that aren't repeats.

    0 never occurs, so every text can be drawn; null and empty texts have the least.
    Words are what blanks separate. The text is taken apart once: its parts are bound
    to a variable.
    """
    c = F.col(text) if isinstance(text, str) else text
    plain = F.length(F.regexp_replace(c, r"[^\p{L}\s]+", ""))
    parts = F.struct(F.split(c, " ").alias("w"), plain.alias("p"), F.length(c).alias("c"))

    def weigh(x: Column) -> Column:
        n = F.size(x["w"]).cast("double")
        blanks = n - 1
        visible = F.nullif(x["c"] - blanks, F.lit(0.0))
        length = visible / n
        sane = F.when((length >= 3) & (length <= 10), 1.0).otherwise(F.greatest(F.lit(0.1), 1.0 - F.abs(F.log(length / 5.5)) / 2))
        fresh = F.least(F.lit(1.0), 0.2 + 2 * F.size(F.array_distinct(x["w"])) / n)
        return F.greatest(F.lit(0.0), x["p"] - blanks) / visible * sane * fresh

    bound = F.get(F.transform(F.array(parts), weigh), F.lit(0))
    return F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(1.0), F.coalesce(bound, F.lit(LEAST_WEIGHT))))


def uniform(*columns: str) -> Column:
    """A number in (0, 1) from a hash: the same in every run and on every executor."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def _budgets(docs: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("documents"))
    wanted = targets.select(lower_key("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce(F.col("max_repeats").cast("bigint"), F.lit(1)).alias("max_repeats")).where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = stash(wanted.join(have, "source", "left").na.fill(0, ["available_tokens", "documents", "target_share"]), "mixture-budgets")
    total = total_tokens if total_tokens is not None else joined.agg(F.sum("available_tokens")).first()[0] or 0
    budget = F.round(F.col("target_share") * F.lit(total)).cast("bigint")
    epochs = F.when(F.col("available_tokens") > 0, F.least(F.col("max_repeats"), F.floor(F.col("budget") / F.col("available_tokens")))).otherwise(F.lit(0)).cast("bigint")
    return (
        joined.withColumn("budget", budget)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available_tokens")).otherwise(F.lit(0)))
    )


def prepare(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (cleaned), weight, n_tokens of texts that have tokens and a source."""
    narrow = documents.select("doc_id", lower_key("source").alias("source"), quality_weight("text").alias("weight"), "text").where("source is not null")
    return with_tokens(narrow, ["doc_id", "source", "weight"], folder=folder, vocabulary=vocabulary).where("n_tokens > 0")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    selection: doc_id, source, n_tokens, copies > 0. shares: per source of targets
    its target_share, available, selected tokens, actual_share and whether the
    target was reached to within one document. total_tokens: the size wanted; by
    default that of all texts of the sources in targets.

    Texts without a source or tokens, and sources without a target, are left out;
    a source listed twice has its larger target; a null cap counts as 1; a source
    without texts has share 0; repeated rows are documents of their own.
    """
    docs = stash(prepare(documents, folder, vocabulary), "mixture-documents")
    budgets = _budgets(docs, targets, total_tokens)
    sides = small_side(stash(budgets.select("source", "epochs", "rest"), "mixture-epochs"))
    key = -F.log(uniform("doc_id")) / F.col("weight")
    n = budgets.agg(F.sum("documents")).first()[0] or 0
    keyed = docs.join(sides, "source").withColumn("_key", key)
    # even ranges of the keys themselves, whatever the weights are: sampled by the range partitioner, each a partition
    ranged = stash(keyed.repartitionByRange(max(1, -(-n // BUCKET_ROWS)), "source", "_key").withColumn("_range", F.spark_partition_id()), "mixture-keys")
    per_range = ranged.where("rest > 0").groupBy("source", "_range").agg(F.sum("n_tokens").alias("_sum"))
    w = Window.partitionBy("source").orderBy("_range")
    offsets = small_side(stash(per_range.select("source", "_range", (F.sum("_sum").over(w) - F.col("_sum")).alias("_before"), F.sum("_sum").over(w).alias("_after")), "mixture-ranges"))
    placed = ranged.join(offsets, ["source", "_range"], "left")
    own = Window.partitionBy("source", "_range").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    border = F.coalesce((F.col("_before") < F.col("rest")) & (F.col("_after") > F.col("rest")), F.lit(False))
    out = ["doc_id", "source", "n_tokens"]
    sure = placed.where(~border).select(*out, (F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("_after") <= F.col("rest")), 1).otherwise(0)).alias("copies"))
    at_border = placed.where(border).withColumn("_run", F.col("_before") + F.sum("n_tokens").over(own)).select(*out, (F.col("epochs") + F.when(F.col("_run") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    selection = sure.unionByName(at_border).where("copies > 0")
    chosen = selection.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("selected_tokens"), F.count("*").alias("selected_documents"), F.max("copies").alias("most_copies"))
    joined = budgets.join(chosen, "source", "left").na.fill(0, ["selected_tokens", "selected_documents", "most_copies"])
    everything = Window.partitionBy()
    largest = docs.groupBy("source").agg(F.max("n_tokens").alias("_largest"))
    shares = (
        joined.join(largest, "source", "left")
        .withColumn("actual_share", F.coalesce(F.try_divide("selected_tokens", F.sum("selected_tokens").over(everything)), F.lit(0.0)))
        .withColumn("reached", F.col("budget") - F.col("selected_tokens") <= F.coalesce("_largest", F.lit(0)))
        .select("source", "target_share", "max_repeats", "documents", "available_tokens", "budget", "epochs", "selected_documents", "selected_tokens", "most_copies", "actual_share", "reached")
    )
    return selection, shares
