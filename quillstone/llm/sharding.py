"""Shards of bounded size by extendible hashing, in DataFrame operations only.

A row's hash is 60 bits of its key's MD5, continued by bits of its place in the input, so that even
a key with a third of all rows can be split.  A directory maps hash prefixes to shards; a shard
above the byte limit is split on the next bit, and only such shards are.  Instead of splitting one
by one, a round sums bytes by the next ``ROUND`` bits of the still oversized prefixes (summed
before the shuffle), adds them up over all shorter prefixes, and so sees every split of these bits
at once: a prefix is a shard if it fits and the one a bit shorter doesn't.  A single round reaches
2**ROUND shards; later rounds touch only rows under prefixes still too large.

Cases: null text counts no bytes and a null key hashes like an empty one; a row larger than the
limit ends alone in its shard (or with rows of no bytes); repeated rows are told apart by their
place, so which of them share a shard depends on the table's partitioning, while distinct keys do not
depend on it; lengths are all that is read of texts of any size; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common

#: Bits that a round looks at: at most 2**16 partial sums leave a task.
ROUND = 16
#: Bits of the key's hash, and with those of the place.
KEY_BITS, ALL_BITS = 60, 108
#: A directory of up to so many prefixes (of some 30 bytes) is broadcast; a larger one is joined by a shuffle.
SMALL = 100_000


def bits() -> Column:
    """The hash as a string of ``ALL_BITS`` binary digits, from the columns ``_h`` and ``_p``."""
    return F.concat(F.lpad(F.bin("_h"), KEY_BITS, "0"), F.lpad(F.bin("_p"), ALL_BITS - KEY_BITS, "0"))


def _number(text: Column, digits: int) -> Column:
    """The first hex digits of a text's MD5 as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_bytes``: ``shard`` is the prefix, ``depth`` its length."""
    text = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    place = F.monotonically_increasing_id().cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("n_bytes"), _number(key, KEY_BITS // 4).alias("_h"), _number(place, (ALL_BITS - KEY_BITS) // 4).alias("_p"))
    # written once: texts are read once, and places can't change between rounds
    rows = common.durable(rows).select("doc_id", "n_bytes", bits().alias("bits"))
    parts, prefix, depth = [], F.lit(""), 0
    left = rows.withColumn("above", F.lit(""))
    while True:
        wide = min(ROUND, ALL_BITS - depth)
        cells = left.groupBy("above", F.substring("bits", depth + 1, wide).alias("cell")).agg(F.sum("n_bytes").alias("n"), F.count("*").alias("rows"))
        lengths = F.sequence(F.lit(0 if depth == 0 else 1), F.lit(wide))
        sums = cells.select(F.explode(F.transform(lengths, lambda k: F.concat("above", F.col("cell").substr(F.lit(1), k)))).alias("shard"), "n", "rows")
        sums = sums.groupBy("shard").agg(F.sum("n").alias("shard_bytes"), F.sum("rows").alias("rows"))
        sums = common.durable(sums.withColumn("depth", F.length("shard")).withColumn("large", (F.col("shard_bytes") > limit) & (F.col("rows") > 1)))
        # a shard fits, and one bit less doesn't; what this round began with is known to be too large
        whole = sums.where("large").select(F.col("shard").alias("up"))
        fits = sums.where("not large").withColumn("up", F.expr("substring(shard, 1, depth - 1)"))
        if depth == 0:
            parts.append(fits.where("depth = 0").select(*sums.columns))
            fits = fits.where("depth > 0")
            parts.append(fits.join(whole, "up", "left_semi").select(*sums.columns))
        else:
            first = fits.where(F.col("depth") == depth + 1)
            parts += [first.select(*sums.columns), fits.where(F.col("depth") > depth + 1).join(whole, "up", "left_semi").select(*sums.columns)]
        depth += wide
        over = sums.where(F.col("large") & (F.col("depth") == depth)).select(F.col("shard").alias("above"))
        if depth >= ALL_BITS:
            parts.append(sums.where(F.col("large") & (F.col("depth") == depth)))
            break
        if over.isEmpty():
            break
        left = rows.withColumn("above", F.substring("bits", 1, depth)).join(over, "above", "left_semi")
    directory = parts[0]
    for part in parts[1:]:
        directory = directory.unionByName(part)
    directory = common.durable(directory.select("shard", "depth", "shard_bytes"))
    lengths = sorted(r[0] for r in directory.select("depth").distinct().collect())  # at most ALL_BITS + 1 numbers
    if directory.limit(SMALL + 1).count() <= SMALL:
        directory = F.broadcast(directory)
    # every row has exactly one of its prefixes in the directory
    tried = rows.withColumn("shard", F.explode(F.array(*[F.substring("bits", 1, k) for k in lengths]))) if lengths else rows.withColumn("shard", F.lit(""))
    return tried.join(directory, "shard").select("doc_id", "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes")
