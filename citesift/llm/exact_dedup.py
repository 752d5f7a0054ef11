"""Exact deduplication by deterministic block naming, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RE, discard, stage

#: Bytes in a block of the lowest level. Texts of up to one block need no pairing.
BLOCK_BYTES = 1024
#: A key is hot if it has more than one in so many of a level's rows; fewer keys than that can be.
HOT_PARTS = 4000
#: Bits of a hash that choose a key's bucket, and bits left for its place among the bucket's keys.
_BUCKET_BITS, _PLACE_BITS = 40, 22


def normalised(col: str = "text") -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), SPACE_RE, "")


def _named(rows: DataFrame, by: list[str]) -> DataFrame:
    """Staged rows with the integer name of their key in place of it: equal exactly for equal keys, the same in every run.

    rows has _at, a hash of the key. Keys are sorted within the buckets that their hashes choose, and a name is the
    bucket and the place in it, so keys whose hashes collide still differ. Each key moves once, to be sorted. Hot keys
    are named apart: there are fewer than HOT_PARTS, so their names are broadcast, and their rows, which may be most
    of the table, stay where they are."""
    counts = stage(rows.groupBy("_at").agg(F.count(F.lit(1)).alias("n")), "key-counts")
    least = max(100, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_PARTS)
    hot = F.broadcast(counts.filter(F.col("n") > least).select("_at"))
    bucket = F.col("_at").bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1))
    spot = Window.partitionBy("_bucket").orderBy(*by)
    place = lambda at: F.col("_bucket") * F.lit(1 << _PLACE_BITS) + at + 1
    cold = rows.join(hot, "_at", "left_anti").withColumn("_bucket", bucket).withColumn("name", place(F.dense_rank().over(spot)))
    # Hot keys take names below 0.
    keys = rows.join(hot, "_at", "left_semi").select("_at", *by).distinct().withColumn("_bucket", bucket).withColumn("name", -place(F.row_number().over(spot))).drop("_bucket")
    warm = rows.join(hot, "_at", "left_semi").join(F.broadcast(keys), ["_at", *by])
    out = stage(cold.drop("_bucket", "_at", *by).unionByName(warm.drop("_at", *by)), "named")
    discard(counts, rows)
    return out


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """The blocks of every normalised text, one row each: _row, i, _n (blocks of the text), block, _at (its hash); the
    first also has the row's id, length and digest. Every text is normalised, hashed and cut once, here."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.length(text).alias("_len"), normalised(text_col).cast("binary").alias("_b"))
    rows = rows.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.octet_length("_b") / F.lit(block_bytes))).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.substring("_b", i * block_bytes + 1, F.lit(block_bytes)))
    rows = rows.select("_row", "_n", F.struct("_id", "_len", F.sha2("_b", 256).alias("text_sha256")).alias("doc"), F.posexplode(cut).alias("i", "block"))
    return rows.select("_row", "_n", "i", F.when(F.col("i") == 0, F.col("doc")).alias("doc"), "block", F.xxhash64("block").alias("_at"))


def _identities(blocks: DataFrame, rows: list[DataFrame]) -> DataFrame:
    """(_row, level, name) from staged blocks, which it discards; staged tables to discard later are added to rows."""
    level = _named(blocks.select("_row", "_n", "i", "block", "_at"), ["block"])
    done, depth = [], 0
    while True:
        rows.append(level)
        done.append(level.filter("_n = 1").select("_row", F.lit(depth).alias("level"), "name"))
        rest = level.filter("_n > 1")
        if rest.isEmpty():
            break
        side = lambda k: F.max(F.when(F.col("i") % 2 == k, F.col("name")))
        pairs = rest.groupBy("_row", "_n", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(0)).alias("b"))
        pairs = pairs.select("_row", F.ceil(F.col("_n") / 2).cast("int").alias("_n"), "i", "a", "b", F.xxhash64("a", "b").alias("_at"))
        level = _named(stage(pairs, "pairs"), ["a", "b"])
        depth += 1
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The identity (level, name) of every row's text: equal for two rows exactly if their normalised texts are equal.

    The normalised text is cut into blocks of block_bytes bytes. The distinct blocks are sorted and numbered, then the
    pairs of adjacent names, and so on until one name is left; level is the number of pairings. Returns a row for each
    input row: _id, _len (code points of the original text), text_sha256, level, name.
    """
    staged: list[DataFrame] = []
    blocks = stage(_blocks(docs, id_col, text_col, block_bytes), "blocks")
    heads = blocks.filter("i = 0").select("_row", "doc.*")
    out = stage(heads.join(_identities(blocks, staged), "_row").drop("_row"), "names")
    discard(blocks, *staged)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Mark the row that stays of each group of equal normalised texts.

    Returns one row for each input row: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the one with most
    code points stays, then the one with the smallest id (null ids last). Null texts count as empty, an empty table gives no
    rows, texts are taken whole. Rows that repeat an id and its text are members of their group like any other; each of
    them that equals the row to keep is marked kept. Only the id and text columns are read, so further columns may have any name.
    """
    rows = block_names(docs, id_col, text_col, block_bytes)
    order = F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("n"), F.col("_id").alias("id"))
    # Written first, so that the join below can split the rows of a large group among tasks.
    groups = stage(rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best")), "groups")
    out = rows.join(groups.hint("merge"), ["level", "name"])
    same = F.col("_id").eqNullSafe(F.col("best.id")) & (F.col("_len") == -F.col("best.l"))
    return out.select(F.col("_id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", same.alias("kept"), "text_sha256")
