"""Fill containers of fixed capacity with texts of varying length.

Method: length-histogram planning. Best-fit decreasing runs over counts per
length, not over documents; its result are segments "items of length L, ranks a to
b, fill containers c, c + 1, … with k each". Documents take their slots by joining
on their rank within their length. A text longer than the capacity is cut into
whole containers and a rest, no other text is split.

Scale: a histogram has at most as many rows as the capacity has tokens, so the
plan is bounded whatever the corpus holds, and is the only thing the driver sees.
Ranks within a length are built from buckets of about BUCKET_ROWS items with their
offsets, so a length that a third of all documents share is many small windows;
ranks meet their segment by slices of ranks, of which each holds about one segment.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import small_side, stash
from .tokens import TOKENIZERS, VOCABULARY, with_tokens

BUCKET_ROWS = 100_000
SEGMENT = "container_id int, length bigint, slice bigint, low bigint, high bigint, rank_from bigint, first_container bigint, per_container bigint"
LENGTH = "container_id int, length bigint, buckets int, width bigint"


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (length, rank_from, rank_to exclusive, first container, items per container) and the number of containers.

    Exactly what best-fit decreasing does item by item, with runs of containers
    of equal remaining space taken at once.
    """
    segments: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # remaining space -> runs (first, count)
    spaces: list[int] = []
    made = 0

    def give(space: int, first: int, count: int) -> None:
        if space > 0 and count > 0:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, count))

    for length in sorted((x for x, n in histogram.items() if n > 0 and x > 0), reverse=True):
        if length > capacity:
            raise ValueError("longer than the capacity")
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces.pop(at)
            else:
                space, first = capacity, made
                count = -(-left // (capacity // length))
                made += count
            each = space // length
            full = min(count, left // each)
            if full:
                segments.append((length, rank, rank + full * each, first, each))
                give(space - full_length(each, length), first, full)
                rank, left, first, count = rank + full * each, left - full * each, first + full, count - full
            if left and count:  # one container takes the last few
                segments.append((length, rank, rank + left, first, left))
                give(space - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            give(space, first, count)
    return segments, made


def full_length(each: int, length: int) -> int:
    return each * length


def sliced(segments: list[tuple[int, int, int, int, int]], histogram: dict[int, int]) -> tuple[list[tuple], dict[int, int]]:
    """Segments cut where slices of ranks end, and the width of a length's slices.

    A length has as many slices as segments, so a rank's slice holds about one segment
    and the cutting at most doubles their number.
    """
    per: dict[int, int] = {}
    for length, *_ in segments:
        per[length] = per.get(length, 0) + 1
    width = {length: max(1, -(-histogram[length] // n)) for length, n in per.items()}
    out = []
    for length, a, b, first, each in segments:
        w = width[length]
        for s in range(a // w, (b - 1) // w + 1):
            out.append((length, s, max(a, s * w), min(b, (s + 1) * w), a, first, each))
    return out, width


def _ranked(items: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 within (container_id, length) and its slice, without a window over a whole length."""
    keys = ["container_id", "length"]
    placed = items.join(small_side(lengths), keys).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "chunk_no", "_copy"), F.col("buckets")).cast("int")).drop("buckets")
    w = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = placed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).select(*keys, "_bucket", (F.sum("_n").over(w) - F.col("_n")).alias("_offset"))
    own = Window.partitionBy(*keys, "_bucket").orderBy("doc_id", "chunk_no", "_copy")
    numbered = placed.withColumn("_r", F.row_number().over(own)).join(small_side(stash(offsets, "rank-offsets")), [*keys, "_bucket"])
    return numbered.withColumn("rank", F.col("_offset") + F.col("_r") - 1).withColumn("slice", F.floor(F.col("rank") / F.col("width"))).drop("_r", "_offset", "_bucket", "width")


def pack(documents: DataFrame, containers: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """container_id, capacity_tokens, container, doc_id, chunk_no, token_from, n_tokens: every piece of every text per capacity.

    container names one container of the given capacity; token_from and n_tokens
    are the piece's place in the text. Null and empty texts need no space: one row
    with a null container. Repeated rows are packed as often as they occur. A
    capacity that is null or under 1 is left out; containers is a small table.
    """
    spark = documents.sparkSession
    sizes = containers.where("capacity_tokens > 0").select(F.col("container_id").cast("int").alias("container_id"), F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).distinct()
    counted = stash(with_tokens(documents, ["doc_id"], folder=folder, vocabulary=vocabulary).withColumn("_copy", F.monotonically_increasing_id()), "token-counts")
    c = F.col("capacity_tokens")
    pieces = counted.crossJoin(F.broadcast(sizes)).select(  # the few container sizes, not a join of large sides
        "container_id", "capacity_tokens", "doc_id", "_copy", "n_tokens",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("n_tokens") / c) - 1, F.lit(0)))).alias("chunk_no"),
    ).select(
        "container_id", "capacity_tokens", "doc_id", "_copy", F.col("chunk_no").cast("int").alias("chunk_no"),
        (F.col("chunk_no") * c).alias("token_from"),
        F.least(c, F.col("n_tokens") - F.col("chunk_no") * c).alias("length"),
    )
    pieces = stash(pieces, "pieces")  # read for the histogram, the ranks and both rests
    whole = F.col("length") == c
    rest = pieces.where((F.col("length") > 0) & ~whole)
    capacities = {r.container_id: r.capacity_tokens for r in sizes.collect()}
    histograms: dict[int, dict[int, int]] = {k: {} for k in capacities}
    for r in rest.groupBy("container_id", "length").agg(F.count("*").alias("n")).toLocalIterator():  # at most capacity rows each
        histograms[r.container_id][r.length] = r.n
    segments, lengths = [], []
    for k, h in histograms.items():
        cut, width = sliced(best_fit(h, capacities[k])[0], h)
        segments += [(k, *x) for x in cut]
        lengths += [(k, length, -(-n // BUCKET_ROWS), width[length]) for length, n in h.items()]
    plan = small_side(stash(spark.createDataFrame(segments, SEGMENT), "packing-plan"))
    ranked = _ranked(rest, stash(spark.createDataFrame(lengths, LENGTH), "packing-lengths"))
    slot = F.col("first_container") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per_container"))
    out = ["container_id", "capacity_tokens", "container", "doc_id", "chunk_no", "token_from", F.col("length").alias("n_tokens")]
    planned = (
        ranked.join(plan, ["container_id", "length", "slice"])
        .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .withColumn("container", F.concat(F.lit("p-"), slot.cast("bigint").cast("string")))
        .select(*out)
    )
    alone = pieces.where(whole).withColumn("container", F.concat_ws("-", F.lit("w"), F.col("doc_id").cast("string"), F.col("_copy").cast("string"), F.col("chunk_no").cast("string"))).select(*out)
    empty = pieces.where("length <= 0").withColumn("container", F.lit(None).cast("string")).select(*out)
    return planned.unionByName(alone).unionByName(empty)


def report(packed: DataFrame) -> DataFrame:
    """Per capacity: items, tokens, containers, the least number possible, the share of space used and the fullest container."""
    per = packed.where("container is not null").groupBy("container_id", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return per.groupBy("container_id", "capacity_tokens").agg(
        F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.count("*").alias("containers"), F.max("used").alias("fullest"),
    ).withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("space_used", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
