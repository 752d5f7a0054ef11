"""Hard-negative mining: product-quantised scores with residual bounds choose candidates, exact integer scores decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stage

#: Rows that the codebooks are fitted on, at most about; results don't depend on them, only the number of candidates does.
SAMPLE_ROWS = 8192
#: Components of a subspace, and centroids of each.
SUB_DIMS, CENTROIDS, ROUNDS = 2, 256, 6
#: Anchors that one pass over all rows serves, about: what is broadcast, whatever the table's size.
ANCHORS = 2048
#: Rows scored at a time, and pairs multiplied exactly at a time.
_ROWS, _PAIRS = 1024, 1 << 16
#: Components up to this have codes; rows with larger ones are always candidates.
_CODED = 1 << 20
#: Scores are exact in doubles below this.
_EXACT = 1 << 53
#: No score yet, and a score that none reaches.
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Rules:
    """What is mined: so many positives of each anchor, so many negatives of each positive, and the window of a negative's score,
    in hundredths of the positive's."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100


def _packed(values: np.ndarray, offsets: np.ndarray, good: np.ndarray) -> pa.Array:
    """A binary value for each good row's integer components: int16 behind a 2, or doubles behind an 8."""
    out: list[bytes | None] = []
    small = values.astype(np.int16, copy=False) if len(values) and np.abs(values).max() < 2**15 else None
    for ok, a, b in zip(good.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        row = (small if small is not None else values)[a:b]
        if small is None and len(row) and np.abs(row).max() < 2**15:
            row = row.astype(np.int16)
        out.append((b"\x08" if row.dtype == np.float64 and len(row) else b"\x02") + row.tobytes() if ok else None)
    return pa.array(out, pa.binary())


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """The rows' components as doubles, cut or filled with zeros to dims."""
    out = np.zeros((len(column), dims))
    for i, raw in enumerate(column.to_pylist()):
        row = np.frombuffer(raw, np.int16 if raw[0] == 2 else np.float64, offset=1)[:dims]
        out[i, : len(row)] = row
    return out


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v): the rows that take part, with each component x as floor(256 x) in v."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            column = batch.column("v")
            offsets = column.offsets.to_numpy().astype(np.int64)
            flat = column.values[offsets[0] : offsets[-1]]
            x = np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(np.float64), nan=np.nan, posinf=np.nan, neginf=np.nan)
            offsets = offsets - offsets[0]
            bad = np.concatenate([[0], np.cumsum(np.isnan(x))])
            good = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False) & ~batch.column("label").is_null().to_numpy(zero_copy_only=False)
            packed = _packed(np.floor(256.0 * np.where(np.isnan(x), 0, x)), offsets, good)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed], ["vec_id", "label", "v"]).filter(pa.array(good))

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, label long, v binary")


def _parts(dims: int) -> list[slice]:
    return [slice(a, min(a + SUB_DIMS, dims)) for a in range(0, dims, SUB_DIMS)]


def fit_codebooks(sample: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Centroids of each subspace by k-means."""
    rng = np.random.default_rng(seed)
    books = []
    for part in _parts(sample.shape[1]):
        x = sample[:, part]
        book = np.unique(x, axis=0)
        if len(book) > CENTROIDS:
            book = book[rng.choice(len(book), CENTROIDS, replace=False)]
            for _ in range(ROUNDS):
                near = _nearest(x, book)
                size = np.bincount(near, minlength=len(book))
                sums = np.stack([np.bincount(near, x[:, k], len(book)) for k in range(x.shape[1])], axis=1)
                book = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], book)
        books.append(book if len(book) else np.zeros((1, part.stop - part.start)))
    return books


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2 * x @ book.T, axis=1)


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the rows, and how far a looked-up score of theirs can be off for a query of length one: the norm of the
    residual, and what sums of single-precision numbers can lose."""
    codes, residual, reached = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x)), np.zeros(len(x))
    for j, (part, book) in enumerate(zip(_parts(x.shape[1]), books)):
        codes[:, j] = _nearest(x[:, part], book)
        near = book[codes[:, j]]
        residual += ((x[:, part] - near) ** 2).sum(1)
        reached += (near * near).sum(1)
    off = np.sqrt(residual) * (1 + 1e-6) + (len(books) + 8) * 2.0**-23 * np.sqrt(reached)
    off[np.abs(x).max(axis=1, initial=0) > _CODED] = np.inf
    return codes, np.nextafter(off.astype(np.float32), np.float32(np.inf))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of paired rows, in Python's integers where doubles don't suffice."""
    if not len(a) or np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < _EXACT:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a.tolist(), b.tolist())], dtype=object).astype(np.int64)


class _Best:
    """The best rows so far of each group of a task: the highest scores, of equal ones the smallest ids, null ids last."""

    def __init__(self, groups: int, keep: int):
        self.keep, self.floor = keep, np.full(groups, _LEAST)
        self.group, self.score, self.id, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids, none = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids), (self.none, none)))
        order = np.lexsort((ids, none, -score, group))
        group = group[order]
        new = np.concatenate([[True], group[1:] != group[:-1]])
        place = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
        order, group = order[place < self.keep], group[place < self.keep]
        place = place[place < self.keep]
        self.group, self.score, self.id, self.none = group, score[order], ids[order], none[order]
        last = place == self.keep - 1
        self.floor[group[last]] = self.score[last]


class _Anchors:
    """A block of anchors with the lookup tables of their scores."""

    def __init__(self, ids: list, labels: list, copies: list, vectors: np.ndarray, books: list[np.ndarray], positives: list | None = None):
        self.ids, self.labels, self.copies, self.vectors, self.books, self.positives = ids, np.array(labels, np.int64), copies, vectors, books, positives

    def ready(self) -> _Anchors:
        self.huge = np.abs(self.vectors).max(axis=1, initial=0) > _CODED
        q = np.where(self.huge[:, None], 0, self.vectors)
        self.tables = [(book @ q[:, part].T).astype(np.float32) for part, book in zip(_parts(q.shape[1]), self.books)]
        self.norm = np.where(self.huge, np.inf, np.sqrt((q * q).sum(1)) * (1 + 1e-6)).astype(np.float32)
        return self

    def bounds(self, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x anchors) the looked-up scores, and how far they can be off."""
        scores = np.zeros((len(codes), len(self.ids)), np.float32)
        for j, table in enumerate(self.tables):
            scores += table[codes[:, j]]
        with np.errstate(invalid="ignore"):
            reach = off[:, None] * self.norm[None, :]
        return scores, np.nan_to_num(reach, nan=np.inf, posinf=np.inf)


def _rows(it: Iterator[pa.RecordBatch], anchors: _Anchors) -> Iterator[tuple]:
    """Rows of the coded table, some at a time: ids, null ids, labels, again, vectors, codes, off."""
    m, dims = len(anchors.books), anchors.vectors.shape[1]
    for whole in it:
        for at in range(0, whole.num_rows, _ROWS):
            b = whole.slice(at, _ROWS)
            ids, flat = b.column("vec_id"), lambda name: np.frombuffer(b"".join(b.column(name).to_pylist()), np.uint8)  # noqa: B023, E731
            yield (
                ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), b.column("label").to_numpy(zero_copy_only=False),
                b.column("again").to_numpy(zero_copy_only=False), _unpacked(b.column("v"), dims), flat("codes").reshape(b.num_rows, m), b.column("off").to_numpy(zero_copy_only=False),
            )


def _exact(candidates: np.ndarray, x: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, anchor, score) of the candidate pairs, scored exactly."""
    row, anchor = np.nonzero(candidates)
    for at in range(0, len(row), _PAIRS):
        i, a = row[at : at + _PAIRS], anchor[at : at + _PAIRS]
        yield i, a, exact_scores(x[i], q[a])


def _find_positives(shared, keep: int) -> Callable:
    """For mapInArrow: the best rows of each anchor's label in a task, without the anchor itself."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value.ready()
        own = [(i is None, 0 if i is None else i) for i in anchors.ids]
        own_none, own_id = np.array([x[0] for x in own], bool), np.array([x[1] for x in own], np.int64)
        best = _Best(len(own), keep)
        for ids, none, labels, again, x, codes, off in _rows(it, anchors):
            scores, reach = anchors.bounds(codes, off)
            mask = (labels[:, None] == anchors.labels[None, :]) & (scores + reach >= best.floor[None, :])
            if len(ids) > keep:
                # So many rows of the label surely score that much.
                sure = np.where(labels[:, None] == anchors.labels[None, :], np.nan_to_num(scores - reach, nan=-np.inf, neginf=-np.inf), -np.inf)
                mask &= scores + reach >= np.partition(sure, len(ids) - keep - 1, axis=0)[len(ids) - keep - 1][None, :]
            for i, a, score in _exact(mask, x, anchors.vectors):
                same = (ids[i] == own_id[a]) & (none[i] == own_none[a]) & ~again[i]
                same[same] = (x[i[same]] == anchors.vectors[a[same]]).all(axis=1)
                ok = ~same & (score >= best.floor[a])
                best.add(a[ok], score[ok], ids[i[ok]], none[i[ok]])
        yield pa.RecordBatch.from_arrays([pa.array(best.group), pa.array(best.id, mask=best.none), pa.array(best.score)], ["q", "vec_id", "score"])

    return run


def _find_negatives(shared, rules: Rules) -> Callable:
    """For mapInArrow: the best rows of other labels in a task in the window of each anchor and positive."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, n = shared.value.ready(), rules.positives
        # Windows that no score lies in, where an anchor has fewer positives.
        low, high = np.full((len(anchors.ids), n), _MOST), np.full((len(anchors.ids), n), _LEAST)
        for q, k, _, score in anchors.positives:
            low[q, k], high[q, k] = -(-rules.low * score // 100), rules.high * score // 100
        best = _Best(len(anchors.ids) * n, rules.negatives)
        for ids, none, labels, _, x, codes, off in _rows(it, anchors):
            scores, reach = anchors.bounds(codes, off)
            need = np.maximum(low, best.floor.reshape(low.shape))
            need = np.where(need > high, _MOST, need)
            mask = (labels[:, None] != anchors.labels[None, :]) & (scores + reach >= need.min(axis=1)[None, :]) & (scores - reach <= high.max(axis=1)[None, :])
            for i, a, score in _exact(mask, x, anchors.vectors):
                for k in range(n):
                    ok = (score >= need[a, k]) & (score <= high[a, k])
                    best.add(a[ok] * n + k, score[ok], ids[i[ok]], none[i[ok]])
        yield pa.RecordBatch.from_arrays([pa.array(best.group), pa.array(best.id, mask=best.none), pa.array(best.score)], ["q", "vec_id", "score"])

    return run


_FOUND = "q long, vec_id long, score long"


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    """The best rows of all tasks for each group, with their rank from 1."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def _coded(vectors: DataFrame, rows: DataFrame, dims: int, count: int, copies: int) -> tuple[DataFrame, list[np.ndarray]]:
    """The staged rows with codes, and the codebooks. Of rows equal in vector and label only the first copies stay: all score alike,
    so none after them can be among so many best. again: the row before it has its id, too."""
    sample = rows.filter(F.rand(7) < SAMPLE_ROWS / max(count, 1)).limit(2 * SAMPLE_ROWS).select("v").toArrow().column("v").combine_chunks()
    drawn = _unpacked(sample, dims)
    books = fit_codebooks(drawn[np.abs(drawn).max(axis=1, initial=0) <= _CODED])
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                codes, off = encode(_unpacked(b.column("v"), dims), shared.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)], names=[*b.schema.names, "codes", "off"])

    same = Window.partitionBy("label", "v").orderBy(F.asc_nulls_last("vec_id"))
    first = rows.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= copies)
    first = first.withColumn("again", (F.col("place") > 1) & F.lag("vec_id").over(same).eqNullSafe(F.col("vec_id"))).drop("place")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // (16 * _ROWS)))
    dealt = first.repartition(tasks, F.xxhash64("vec_id", "label", "v"))
    return stage(dealt.mapInArrow(run, "vec_id long, label long, v binary, again boolean, codes binary, off float"), "coded"), books


def mine(vectors: DataFrame, anchors: Callable, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rules: Rules = Rules()) -> DataFrame:
    """Hard negatives: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: a condition of the column vec_id that chooses the anchors. Each component x counts as floor(256 x), and a score is the integer
    inner product with the anchor; vectors of different lengths are compared over the shorter. An anchor's positives are its best other
    rows of its label, and each positive's negatives are the best rows of other labels whose score lies in the window of rules; of equal scores the
    smallest id comes first, null ids last. All rows are scored against every anchor, by lookup tables; those whose score plus and minus its
    bound can't reach the window or the best so far are left out, the others scored exactly, so the result doesn't depend on the codes.

    Anchors are served in blocks of about ANCHORS, each by two passes over the coded rows; only a block, its tables and its positives are broadcast.
    Rows with a null label, a null vector, or null or non-finite components take no part. Rows that repeat an id or a vector
    are rows like any other, and an anchor that is there twice is answered twice. Empty vectors score 0 with all. Only the three columns
    are read. Scores must fit 64 bits. An empty table, or one without anchors, gives no rows."""
    spark = vectors.sparkSession
    rows = prepared(vectors, id_col, vector_col, label_col)
    asked = stage(rows.filter(anchors(F.col("vec_id"))).groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("copies")), "anchors")
    # Two bytes or eight for a component: the longest that an anchor can have.
    n, size = asked.agg(F.count(F.lit(1)), F.max(F.when(F.substring("v", F.lit(1), F.lit(1)) == F.lit(b"\x02"), (F.octet_length("v") - 1) / 2).otherwise((F.octet_length("v") - 1) / 8))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    dims, blocks = max(1, int(size)), -(-n // ANCHORS)
    coded, books = _coded(vectors, rows, dims, vectors.count(), max(rules.positives + 1, rules.negatives))
    done = []
    for k in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)) == k).toArrow().sort_by([("vec_id", "ascending"), ("label", "ascending"), ("v", "ascending")])
        if block.num_rows:
            done.append(_served(coded, block, dims, books, rules))
    out = reduce(DataFrame.unionByName, done)
    discard(asked, coded)
    return out


def _served(coded: DataFrame, block: pa.Table, dims: int, books: list[np.ndarray], rules: Rules) -> DataFrame:
    """The staged result of one block of anchors."""
    spark = coded.sparkSession
    columns = [block.column(x).to_pylist() for x in ("vec_id", "label", "copies")]
    vectors = _unpacked(block.column("v").combine_chunks(), dims)
    shared = spark.sparkContext.broadcast(_Anchors(*columns, vectors, books))
    found = _ranked(coded.mapInArrow(_find_positives(shared, rules.positives), _FOUND), rules.positives)
    positives = [(r.q, r.rank - 1, r.vec_id, r.score) for r in found.collect()]
    both = spark.sparkContext.broadcast(_Anchors(*columns, vectors, books, positives))
    mined = _ranked(coded.mapInArrow(_find_negatives(both, rules), _FOUND), rules.negatives)
    # The block's anchors and positives, which the driver holds anyway.
    names = spark.createDataFrame([(q * rules.positives + k, columns[0][q], columns[2][q], i, s) for q, k, i, s in positives], "q long, anchor_id long, copies long, positive_id long, positive_score long")
    named = mined.join(F.broadcast(names), "q").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    out = stage(named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    shared.unpersist()
    both.unpersist()
    return out
