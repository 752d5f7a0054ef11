"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, byte_views, mix, stage, text_bytes, word_hashes

#: Words whose counts the executors hold, at most; the counts of all others are joined.
HOT_WORDS = 1 << 17
#: The most frequent words have a class of their own; all others share classes by their last TAIL bytes.
OWN_CLASSES, TAIL_CLASSES, TAIL = 127, 128, 2
CLASSES = 256  # the end's class is OWN_CLASSES, tails follow
BRANCH = 16  # the softmax chooses one of 16 groups, then one of 16 classes in it
#: Words with a context identity of their own; other words appear in contexts by their class.
CONTEXT_WORDS = 4096
_START = CONTEXT_WORDS + CLASSES
#: Rows of the hashed weights of each of the two softmaxes.
ROWS = 1 << 15
FEATURES = 4
ROUNDS, STEP, RATE = 2, 4096, 0.1
#: Tasks whose weights one node of the reduction sums.
FAN_IN = 32
#: The token that ends every text.
END = np.uint64(0xE0F5_1A7E_57ED_0001)
_COUNTS = "h long, tail int, n long"


@dataclass
class Lexicon:
    """Counts of the training tokens. hot: sorted hashes with counts and ranks; den: for each class its tokens and words."""

    total: int
    words: int
    hashes: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray


@dataclass
class Weights:
    """Rows of 16 for the choice of the group, rows of 16 for the class in it, and biases from class counts."""

    group: np.ndarray
    within: np.ndarray
    group_bias: np.ndarray
    within_bias: np.ndarray


def tail_class(tails: np.ndarray) -> np.ndarray:
    return (OWN_CLASSES + 1 + (tails % np.uint64(TAIL_CLASSES)).astype(np.int64)).astype(np.int32)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail classes of all tokens (words, then the end) and the n + 1 token offsets of the texts."""
    h, offs, tails = word_hashes(data, offsets, (-TAIL,))
    n = len(offs) - 1
    offs_all = offs + np.arange(n + 1)
    out = np.empty(offs_all[-1], np.uint64)
    cls = np.empty(offs_all[-1], np.int32)
    ends = offs_all[1:] - 1
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = h, END
    cls[word], cls[ends] = tail_class(tails), OWN_CLASSES
    return out, cls, offs_all


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(it, "_text", 32 << 20):
        h, cls, _ = tokens(*byte_views(batch.column("_text")))
        h, first, n = np.unique(h, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cls[first]), pa.array(n)], names=["h", "tail", "n"])


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, tail, n): every distinct token of docs with its class by tail and its count. Words are told apart by 64-bit hashes."""
    return docs.select(text_bytes(text_col).alias("_text")).mapInArrow(_counted, _COUNTS).groupBy("h").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


def lexicon(vocab: DataFrame) -> Lexicon:
    """Totals and frequent words of a table of counts. Only the words above a count that HOT_WORDS at most reach come to the driver."""
    vocab = vocab.withColumn("bin", F.floor(F.log2("n") * 16).cast("int"))
    bins = sorted(vocab.groupBy("bin").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect(), key=lambda r: -r.bin)
    room, least = HOT_WORDS, 1 << 30
    for r in bins:
        room -= r.words
        if room < 0:
            break
        least = r.bin
    hot = vocab.filter(F.col("bin") >= least).select("h", "n").toArrow()
    h, n = hot["h"].to_numpy().view(np.uint64), hot["n"].to_numpy().astype(np.int64)
    rank = np.empty(len(h), np.int32)
    rank[np.lexsort((h, -n))] = np.arange(len(h))
    end = h == END
    if end.any():  # the end isn't a word: it gives up its rank
        rank[rank > rank[end][0]] -= 1
        rank[end] = len(h)
    order = np.argsort(h)
    lex = Lexicon(sum(r.n for r in bins), sum(r.words for r in bins), h[order], n[order], rank[order], np.zeros(CLASSES), np.zeros(CLASSES))
    own = lex.ranks < OWN_CLASSES
    for r in vocab.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        lex.class_tokens[r.tail], lex.class_words[r.tail] = r.n, r.words
    # Words with classes of their own leave those of their tails.
    spark = vocab.sparkSession
    moved = spark.createDataFrame([(int(x),) for x in lex.hashes[own].view(np.int64)], "h long")
    for r in vocab.join(F.broadcast(moved), "h").select("h", "tail", "n").collect():
        at = lex.ranks[np.searchsorted(lex.hashes, np.array([r.h]).view(np.uint64)[0])]
        lex.class_tokens[r.tail] -= r.n
        lex.class_words[r.tail] -= 1
        lex.class_tokens[at], lex.class_words[at] = r.n, 1
    return lex


def initial_weights(lex: Lexicon) -> Weights:
    mass = (lex.class_tokens + 0.5 * (lex.class_words + 1)).reshape(BRANCH, BRANCH)
    groups = mass.sum(axis=1)
    f = np.float32
    return Weights(np.zeros((ROWS, BRANCH), f), np.zeros((ROWS, BRANCH), f), np.log(groups / groups.sum()).astype(f), np.log(mass / groups[:, None]).astype(f))


def look_up(lex: Lexicon, h: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each token among the hot words or -1, its class, and its identity in contexts."""
    if len(lex.hashes) == 0:
        return np.full(len(h), -1), tails, CONTEXT_WORDS + tails
    at = np.minimum(np.searchsorted(lex.hashes, h), len(lex.hashes) - 1)
    at = np.where(lex.hashes[at] == h, at, -1)
    rank = np.where(at >= 0, lex.ranks[at], 1 << 30)
    cls = np.where(rank < OWN_CLASSES, rank, tails).astype(np.int32)
    return at, cls, np.where(rank < CONTEXT_WORDS, rank, CONTEXT_WORDS + cls).astype(np.int32)


def features(ctx: np.ndarray, cls: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes (FEATURES x tokens) of the word before, the two words before, the word before that (a skip), and the
    classes of the three before."""
    n = len(ctx)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))

    def before(x: np.ndarray, k: int) -> np.ndarray:
        out = np.full(n, _START, np.uint64)
        out[k:] = x[: n - k]
        out[place < k] = _START
        return out

    w1, w2 = before(ctx, 1), before(ctx, 2)
    c1, c2, c3 = before(cls, 1), before(cls, 2), before(cls, 3)
    m = np.uint64(8191)
    return np.stack([mix(w1 * np.uint64(4) + np.uint64(1)), mix((w1 * m + w2) * np.uint64(4) + np.uint64(2)), mix(w2 * np.uint64(4) + np.uint64(3)), mix(((c1 * m + c2) * m + c3) * np.uint64(4))])


def _rows(f: np.ndarray, group: np.ndarray | None) -> np.ndarray:
    if group is not None:
        f = mix(f + (group.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return (f & np.uint64(ROWS - 1)).astype(np.uint16)


def _activations(table: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Sums of the rows named for each token, and the bias, less the largest in each line."""
    z = table.take(rows[0], axis=0)
    for r in rows[1:]:
        z += table.take(r, axis=0)
    z += bias
    z -= z.max(axis=1, keepdims=True)
    return z


def class_log_probs(w: Weights, f: np.ndarray, cls: np.ndarray, step: int = 1 << 13) -> np.ndarray:
    """Natural log probability of each token's class in its context."""
    out = np.empty(len(cls), np.float32)
    for lo in range(0, len(cls), step):
        g, c = np.divmod(cls[lo : lo + step], BRANCH)
        part, at = f[:, lo : lo + step], np.arange(len(g))
        z = _activations(w.group, _rows(part, None), w.group_bias)
        y = _activations(w.within, _rows(part, g), w.within_bias.take(g, axis=0))
        out[lo : lo + step] = z[at, g] + y[at, c] - np.log(np.exp(z).sum(axis=1) * np.exp(y).sum(axis=1))
    return out


def _descend(rows: np.ndarray, grad: np.ndarray, table: np.ndarray, squares: np.ndarray) -> None:
    """One AdaGrad step: each row that rows (features x tokens) names, with the sum of the gradients of its tokens."""
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")  # a radix sort, for numbers of 16 bits
    by_row = flat[order]
    last = np.flatnonzero(np.append(by_row[1:] != by_row[:-1], True))
    # Sums of runs are differences of running sums.
    sums = np.cumsum(grad.take(order % len(grad), axis=0), axis=0, dtype=np.float64)[last]
    sums[1:] -= sums[:-1].copy()
    g, at = sums.astype(np.float32), by_row[last]
    total = squares.take(at, axis=0)
    total += g * g
    squares[at] = total
    g *= RATE
    g /= np.sqrt(total)
    table[at] -= g


def local_updates(w: Weights, f: np.ndarray, cls: np.ndarray, squares: tuple[np.ndarray, np.ndarray]) -> None:
    """Follow the gradient of the log loss over the tokens in steps of STEP, in place."""
    for lo in range(0, len(cls), STEP):
        g, c = np.divmod(cls[lo : lo + STEP], BRANCH)
        part, at = f[:, lo : lo + STEP], np.arange(len(g))
        for bias, rows, table, square, y in ((w.group_bias, _rows(part, None), w.group, squares[0], g), (w.within_bias.take(g, axis=0), _rows(part, g), w.within, squares[1], c)):
            d = np.exp(_activations(table, rows, bias))
            d /= d.sum(axis=1, keepdims=True)
            d[at, y] -= 1
            _descend(rows, d, table, square)


def _trainer(lex_sent, weights_sent):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, start = lex_sent.value, weights_sent.value
        w = Weights(start.group.copy(), start.within.copy(), start.group_bias, start.within_bias)
        squares = (np.full((ROWS, BRANCH), 1.0, np.float32), np.full((ROWS, BRANCH), 1.0, np.float32))
        seen = 0
        for batch in batches_of(it, "_text", 4 << 20):
            h, tails, offs = tokens(*byte_views(batch.column("_text")))
            _, cls, ctx = look_up(lex, h, tails)
            local_updates(w, features(ctx, cls, offs), cls, squares)
            seen += len(h)
        if seen:
            # Each task's weights count by its tokens; blocks are summed apart from each other.
            block = ROWS // 16
            for i in range(16):
                part = np.stack([t[i * block : (i + 1) * block] - s[i * block : (i + 1) * block] for t, s in ((w.group, start.group), (w.within, start.within))])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seen], pa.int64()), pa.array([(part * seen).astype(np.float32).tobytes()], pa.binary())], names=["block", "salt", "seen", "delta"])
    return run


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float32) for x in pdf["delta"])
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "salt": pdf["salt"].iloc[:1], "seen": [int(pdf["seen"].sum())], "delta": [total.astype(np.float32).tobytes()]})


def train(docs: DataFrame, lex: Lexicon, text_col: str = "text", rounds: int = ROUNDS) -> Weights:
    """Fit the class softmaxes to all texts of docs, a part of them in each round.

    Every task follows the gradient over its share of the round's texts from the weights sent to it; their changes,
    weighted by tokens, are summed in a tree of FAN_IN at a node and sent out anew. The weights have a fixed size."""
    spark = docs.sparkSession
    w = initial_weights(lex)
    lex_sent = spark.sparkContext.broadcast(lex)
    slim = docs.select(text_bytes(text_col).alias("_text"))
    schema = "block int, salt int, seen long, delta binary"
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(w)
        part = slim.filter(F.pmod(F.xxhash64("_text"), F.lit(rounds)) == r)
        got = part.mapInArrow(_trainer(lex_sent, sent), schema)
        tasks = part.rdd.getNumPartitions()
        while True:
            got = got.withColumn("salt", F.floor(F.col("salt") / FAN_IN).cast("int")).groupBy("block", "salt").applyInPandas(_summed, schema)
            tasks = -(-tasks // FAN_IN)
            if tasks <= 1:
                break
        got = got.collect()
        new = Weights(w.group.copy(), w.within.copy(), w.group_bias, w.within_bias)
        size = ROWS // 16
        for row in got:
            delta = np.frombuffer(row.delta, np.float32).reshape(2, size, BRANCH) / row.seen
            for t, d in ((new.group, delta[0]), (new.within, delta[1])):
                t[row.block * size : (row.block + 1) * size] += d
        w = new
        sent.unpersist()
    return w


def score_documents(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Unigram and model log10 probabilities of every text, learning from the rows where use holds.

    Tokens are lower-cased (A-Z) words and one end for each text. Returns for every row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. The model gives a token the probability of its class after the words before it, times its
    share of the class, where a word never seen in training has half a count. Null and empty texts are an end alone.
    Repeated rows are texts of their own. Without training rows N and V are 0 and all tokens are unknown; an empty table gives no
    rows. Texts are taken whole; a batch holds about 8 MB of them or a single longer one. Only the id, the text and the
    columns of use are read.
    """
    train_docs = docs.filter(use)
    vocab = stage(count_words(train_docs, text_col), "vocab")
    lex = lexicon(vocab)
    w = train(train_docs, lex, text_col)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((lex, w))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, w = sent.value
        log_count = np.log10(lex.counts + 0.5)
        log_den = np.log10(lex.class_tokens + 0.5 * (lex.class_words + 1))
        for batch in batches_of(it, "_text", 8 << 20):
            h, tails, offs = tokens(*byte_views(batch.column("_text")))
            at, cls, ctx = look_up(lex, h, tails)
            known = at >= 0
            model = class_log_probs(w, features(ctx, cls, offs), cls) / np.log(10) - log_den[cls]
            count = np.where(known, log_count[at], 0.0) if len(log_count) else np.zeros(len(h))
            sums = [np.add.reduceat(x.astype(np.float64), offs[:-1]) for x in (known, count, model)]
            # The rest of each text, each word once with its number.
            rest = np.flatnonzero(~known)
            doc = np.searchsorted(offs, rest, side="right") - 1
            order = np.lexsort((h[rest], doc))
            d, x = doc[order], h[rest][order]
            heads = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])) if len(d) else np.zeros(0, int)
            times = np.diff(np.append(heads, len(d)))
            cut = pa.array(np.searchsorted(d[heads], np.arange(len(offs))).astype(np.int32))
            cols = [pa.array(np.diff(offs)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            cols += [pa.ListArray.from_arrays(cut, pa.array(x[heads].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *cols], names=["doc_id", "held_out", "n_tokens", "known", "counted", "model", "rest", "times"])

    slim = docs.select(F.col(id_col).alias("doc_id"), (~F.coalesce(use, F.lit(False))).alias("held_out"), text_bytes(text_col).alias("_text"))
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, n_tokens long, known long, counted double, model double, rest array<long>, times array<int>"
    rows = stage(slim.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "lm-rows")
    rest = rows.select("_row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("_row", F.col("x.rest").alias("h"), F.col("x.times").alias("k"))
    found = rest.join(vocab.select("h", "n").hint("merge"), "h").groupBy("_row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10((F.col("n") + 0.5) / F.lit(0.5))).alias("gain"))
    out = rows.drop("rest", "times").join(found, "_row", "left")
    # A word not joined has count 0: half a count, which is what all tokens outside the hot words get first.
    count = F.col("counted") + (F.col("n_tokens") - F.col("known")) * F.log10(F.lit(0.5)) + F.coalesce("gain", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(lex.total)).cast("long").alias("train_tokens"),
        (count - F.col("n_tokens") * F.log10(F.lit(lex.total + 0.5 * (lex.words + 1)))).alias("base_score"), (count + F.col("model")).alias("score"),
    )
