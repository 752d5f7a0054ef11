"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

#: Copies of a document at most.
MAX_COPIES = 3
#: Documents in a leaf of the reduction tree, and residuals joined in a node above, on average.
LEAF_ROWS, FAN_IN = 4096, 256
_EPS = 1e-9


def water_fill(sizes: Sequence[int], weights: Sequence[float], most: float = MAX_COPIES) -> list[float]:
    """Targets that share the total of sizes by weight, none above most times its size; the excess is shared anew by
    weight among the rest until none is above."""
    total, open_ = float(sum(sizes)), set(range(len(sizes)))
    targets = [0.0] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        share = {i: total * weights[i] / weight for i in open_}
        above = [i for i in open_ if share[i] > most * sizes[i]]
        if not above:
            for i in open_:
                targets[i] = share[i]
            break
        for i in above:
            targets[i] = float(most * sizes[i])
            total -= targets[i]
            open_.discard(i)
    return targets


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each key, the same in every run."""
    h = (keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2**53


def pivotal(sizes: np.ndarray, parts: np.ndarray, draws: np.ndarray, draws_apart: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Round parts in (0, 1) to 0 or 1 but for one, keeping sum(sizes * parts). Entries come in descending order of size.

    Two open entries meet at a time: mass moves from one to the other, in a direction drawn so that neither expectation
    changes, until one of them is integral. Against a much shorter partner it is always the short one that settles, so
    a long entry would stay open to the end. One that meets an entry of less than half its size is therefore drawn by itself, and
    what it takes or leaves is shared by size among all later entries, where their parts have room for it.
    Returns the parts and the index of the entry still open, or -1."""
    draws_apart = draws if draws_apart is None else draws_apart
    x, a = parts.astype(float), sizes.astype(float)
    open_ = (x > _EPS) & (x < 1 - _EPS)
    x[~open_] = np.round(x[~open_])
    at = np.flatnonzero(open_)
    later = np.cumsum(a[at][::-1])[::-1].tolist()
    least = np.minimum.accumulate(x[at][::-1])[::-1].tolist()
    most = np.maximum.accumulate(x[at][::-1])[::-1].tolist()
    x, a, held, shift = x.tolist(), a.tolist(), -1, 0.0
    for k, i in enumerate(at.tolist()):
        if held >= 0 and a[held] > 2 * a[i]:
            # There must be room whichever way it falls, or the draw would favour one of them.
            low, high = ((x[held] - taken) * a[held] / later[k] + shift for taken in (1.0, 0.0))
            if least[k] + low >= 0 and most[k] + high <= 1:
                x[held], shift = (1.0, low) if draws_apart[held] < x[held] else (0.0, high)
                held = -1
        x[i] += shift
        if x[i] <= _EPS or x[i] >= 1 - _EPS:
            x[i] = float(round(x[i]))
            continue
        if held < 0:
            held = i
            continue
        up = min((1 - x[held]) * a[held], x[i] * a[i])  # words that can move to held, and from held
        down = min(x[held] * a[held], (1 - x[i]) * a[i])
        move = up if draws[i] * (up + down) < down else -down
        x[held] += move / a[held]
        x[i] -= move / a[i]
        is_open = [j for j in (held, i) if _EPS < x[j] < 1 - _EPS]
        for j in (held, i):
            if j not in is_open:
                x[j] = float(round(x[j]))
        held = is_open[0] if is_open else -1
    return np.array(x), held


_NODE = "doc_id {id}, size long, source_no int, whole int, part double, key long, salt int, is_open boolean"


def _round_node(level: int):
    def run(table: pa.Table) -> pa.Table:
        size, key, part = (table[c].to_numpy() for c in ("size", "key", "part"))
        # Long documents settle first, so that what stays open at the end is short.
        order = np.lexsort((part, key, -size))
        keys = key[order].view(np.uint64)
        x, held = pivotal(size[order], part[order], _uniform(keys, level), _uniform(keys, level + 1000))
        table = table.take(pa.array(order))
        for name, values in (("part", pa.array(x)), ("is_open", pa.array(np.arange(len(x)) == held))):
            table = table.set_column(table.schema.get_field_index(name), name, values)
        return table
    return run


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), seed: int = 7, draw_col: str | None = None) -> DataFrame:
    """How many copies of each document a mix takes, so that the words of every source come to its target.

    A document's size is its number of words. Sources take the weights in turn by code point order, null last; targets
    see water_fill. Every document of a source asks for the same real number of copies; its fraction is rounded by
    pivotal sampling with the words as mass, so a source misses its target by less than one document, a short one unless
    few long ones hold most of its words. Leaves hold
    about LEAF_ROWS documents dealt by a hash of id and size, and each passes its one open entry to a node of about
    FAN_IN, up to a root for each source. The table of sources, one row each, is read by the driver.

    Returns one row for each input row: doc_id, size, source_size, target, taken, copies, source. Null and wordless texts have
    size 0 and are taken 0 times over; an empty table gives no rows; texts are counted whole. Repeated rows are documents of
    their own. Reruns agree: all draws are hashes of draw_col (the id, unless given) and size. Ids pass through Arrow
    unchanged. Only the columns named are read, so further ones may have any name.
    """
    # Words end before white space or the text's end; counting ends keeps the match short for any text.
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")).cast("long")
    sizes_table = rows = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.col(draw_col or id_col).alias("draw")), "sizes")
    spark = docs.sparkSession
    sources = rows.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    sources.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.s for r in sources]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sources))])
    table = spark.createDataFrame(
        [(i, r.source, int(r.s), float(t), float(t / r.s) if r.s else 0.0, max(1, -(-r.n // LEAF_ROWS))) for i, (r, t) in enumerate(zip(sources, targets))],
        "source_no int, _source string, source_size long, target double, rate double, leaves long",
    )
    rows = rows.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor(F.col("rate") + _EPS).cast("int")
    key = F.xxhash64(F.lit(seed), "draw", "size")
    leaf = rows.select(
        "doc_id", "size", "source_no", F.when(F.col("size") > 0, whole).otherwise(0).alias("whole"),
        F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("rate") - whole)).otherwise(0.0).alias("part"),
        key.alias("key"), F.pmod(F.xxhash64(key), F.col("leaves")).cast("int").alias("salt"), F.lit(False).alias("is_open"),
    )
    schema = _NODE.format(id=dict(docs.dtypes)[id_col])
    level, closed, most = leaf, [], max([-(-r.n // LEAF_ROWS) for r in sources], default=1)
    depth = 0
    while True:
        level = stage(level.groupBy("source_no", "salt").applyInArrow(_round_node(depth), schema), "mix")
        closed.append(level.filter("not is_open"))
        rest = level.filter("is_open")
        if most <= 1:
            # The root of a source: its last open entry is drawn by its own probability.
            draw = F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(1 << 30)) / F.lit(1 << 30)
            closed.append(rest.withColumn("part", (draw < F.col("part")).cast("double")))
            break
        most = -(-most // FAN_IN)
        level = rest.withColumn("salt", F.floor(F.col("salt") / FAN_IN).cast("int"))
        depth += 1
    discard(sizes_table)
    out = closed[0]
    for df in closed[1:]:
        out = out.unionByName(df)
    copies = F.col("whole") + F.col("part").cast("int")
    return out.join(table, "source_no").select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"), F.col("_source").alias("source"))
