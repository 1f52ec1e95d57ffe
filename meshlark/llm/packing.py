"""Packing into length buckets with the least padding.

The global histogram of lengths is small: n distinct lengths need n^2 / 2 tokens, so their
number grows with the root of the corpus. Dynamic programming over it picks the bucket
boundaries. Inside each bucket, rows are dealt into groups of a bounded number of batches
and numbered there, so no bucket meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .token_index import encoded, id_bytes

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Full batches in a group on average. Each group ends with one batch that may not be full.
GROUP_BATCHES = 32


def word_count(text: Column) -> Column:
    """Words (runs without ASCII blanks) of a text, and one end mark."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    ``histogram``: (length, rows), distinct lengths in ascending order. A bucket (a, b]
    costs sum(rows * (b - length)). As a function of the boundary before it the cost is a
    line whose slope falls, so each layer is the lower hull of lines, read from left to
    right: time is buckets times lengths. Integers keep it exact.
    """
    n = len(histogram)
    if not n:
        return []
    rows, tokens = [0], [0]
    for length, count in histogram:
        rows.append(rows[-1] + count)
        tokens.append(tokens[-1] + length * count)
    best = [0] + [histogram[j - 1][0] * rows[j] - tokens[j] for j in range(1, n + 1)]  # one bucket
    layers: list[list[int]] = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, boundary
        at, new, came = 0, best[:], [0] * (n + 1)
        for j in range(1, n + 1):
            i = j - 1
            slope, intercept = -rows[i], best[i] + tokens[i]
            while len(hull) >= 2:
                (s1, c1, _), (s2, c2, _) = hull[-2], hull[-1]
                if (intercept - c1) * (s1 - s2) <= (c2 - c1) * (s1 - slope):
                    hull.pop()
                else:
                    break
            hull.append((slope, intercept, i))
            at = min(at, len(hull) - 1)
            x = histogram[j - 1][0]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            new[j] = hull[at][0] * x + hull[at][1] + x * rows[j] - tokens[j]
            came[j] = hull[at][2]
        best = new
        layers.append(came)
    bounds, j = [], n
    for came in reversed(layers):
        if j == 0:
            break
        bounds.append(histogram[j - 1][0])
        j = came[j]
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, carry: tuple[str, ...] = ()) -> DataFrame:
    """Bucket, batch and place of every row.

    ``length`` is the number of tokens (null: 0; default: words and an end mark, so null
    and empty texts have 1). A batch of a bucket holds ``token_budget // bucket length``
    rows, at least one, so that it is within the budget after padding unless one row
    exceeds it.

    Returns ``id_col``, ``n_tokens``, the columns named in ``carry``, ``bucket`` (from 0),
    ``bucket_tokens`` (its padded length), ``batch`` (bucket-group-number) and ``slot``
    (from 0). Repeated rows get places of their own; null ids sort first. Other columns are
    not read.
    """
    tokens = word_count(F.col(text_col)) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    # Ids may be null or repeat: each row is dealt by its place in this table.
    counted = written(docs.select(F.col(id_col), tokens.alias("n_tokens"), *carry, F.monotonically_increasing_id().alias("_row")))
    histogram = [(r[0], r[1]) for r in counted.groupBy("n_tokens").count().orderBy("n_tokens").collect()]
    bounds = optimal_boundaries(histogram, buckets) or [0]
    per_batch = [max(1, token_budget // max(1, b)) for b in bounds]
    rows = [sum(n for x, n in histogram if (k == 0 or x > bounds[k - 1]) and x <= b) for k, b in enumerate(bounds)]
    groups = [max(1, -(-n // (size * GROUP_BATCHES))) for n, size in zip(rows, per_batch, strict=True)]
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("bucket"))
    dealt = counted.withColumn("bucket", F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b < F.col("n_tokens"))))
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("_row"), of(groups).cast("long")))
    place = F.row_number().over(Window.partitionBy("bucket", "_group").orderBy("n_tokens", id_col, "_row")) - 1
    placed = dealt.withColumn("_place", place)
    batch = F.concat_ws("-", "bucket", "_group", F.floor(F.col("_place") / of(per_batch)))
    return placed.select(id_col, "n_tokens", *carry, "bucket", of([int(b) for b in bounds]).cast("long").alias("bucket_tokens"), batch.alias("batch"), (F.col("_place") % of(per_batch)).alias("slot"))


def pack_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, with_ids: bool = True) -> DataFrame:
    """``pack`` by the tokens of a tokenizer, with ``ids``: each row's token ids, padded with 0 to its bucket's length.

    Ids are little-endian, 2 or 4 bytes each. The rows of a batch, in order of their slots,
    are one padded block of at most ``token_budget`` ids. Without ``with_ids``, places only.
    """
    counted = encoded(docs, tokenizer_path, id_col, text_col, with_ids=with_ids)
    places = pack(counted, id_col, length=F.col("n_tokens"), buckets=buckets, token_budget=token_budget, carry=("ids",) if with_ids else ())
    if not with_ids:
        return places
    return places.withColumn("ids", F.rpad("ids", (F.col("bucket_tokens") * id_bytes(tokenizer_path)).cast("int"), F.lit(bytearray(1))))
