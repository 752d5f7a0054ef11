"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy by tasks whose weights are averaged."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, byte_views, discard, stage, text_bytes, word_hashes

#: Embedding slots (as bits of the hash), size of an embedding, widths of the filters and filters of each width.
SLOT_BITS, DIM, WIDTHS, FILTERS = 22, 8, (1, 2, 3), 8
#: A word is the sum of its own embedding and those of its first bytes, so that unseen forms of a stem are known.
PREFIXES = (4, 6)
#: What one training task holds, about: documents, and bytes of their texts. More of them are more tasks.
TASK_DOCS, TASK_BYTES = 4000, 16 << 20
#: Slots that fewer training documents have stay neutral.
MIN_DOCS = 4
#: Passes over all documents, as many as make STEPS steps of BATCH documents in all tasks, EPOCHS at least; the tasks' weights are averaged ROUNDS times.
EPOCHS, STEPS, BATCH, RATE, SEED, ROUNDS = 6, 800, 64, 0.05, 11, 6
#: Share of a language's clean calibration documents that may lie above its threshold.
FALSE_SHARE = 0.002
MIN_CLEAN = 20
#: Steps of a threshold for one unit of the score's log odds.
FINE = 256
_PAD = max(WIDTHS) - 1


@dataclass
class ToxicityModel:
    """Weights, and the score above which a document of a language counts as toxic."""

    used: np.ndarray  # slots that have an embedding, in order: row 1 and on; row 0 is neutral
    emb: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    # Sums of squared gradients: of the embeddings, the filters, biases and output weights, and the output's bias.
    emb_g: np.ndarray | None = None
    sums: list[np.ndarray] = field(default_factory=list)
    bias_g: float = 1e-6

    @cached_property
    def rows(self) -> np.ndarray:
        """Slot to row of the embeddings. Each process makes it for itself, as it is larger than most models."""
        rows = np.zeros(1 << SLOT_BITS, np.int32)
        rows[self.used] = np.arange(1, len(self.used) + 1)
        return rows

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rows"}


def slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of every word (words x 1 + prefixes) and the word offsets of the texts."""
    first, offs, *heads = word_hashes(data, offsets, PREFIXES)
    shift = np.uint64(64 - SLOT_BITS)
    return np.stack([(h >> shift).astype(np.int32) for h in (first, *heads)], axis=1), offs


def _padded(model: ToxicityModel, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows with padding after each text, and where each text begins and ends; an empty text is one neutral word."""
    lens = np.diff(offsets)
    seen = np.maximum(lens, 1)
    begin = np.concatenate([[0], np.cumsum(seen + _PAD)])
    at = np.zeros((begin[-1], words.shape[1]), np.int32)
    place = np.arange(len(words)) + np.repeat(begin[:-1] - offsets[:-1], lens)
    at[place] = model.rows[words]
    return at, begin[:-1], begin[:-1] + seen


def _responses(model: ToxicityModel, x: np.ndarray, k: int) -> np.ndarray:
    """Responses of the filters of one width at every word; rows beyond the padding stay out."""
    w = model.filters[k]
    n = len(x) - _PAD
    z = x[:n] @ w[0]
    for o in range(1, len(w)):
        z += x[o : n + o] @ w[o]
    return z + model.biases[k]


def scores(model: ToxicityModel, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of toxic for each text."""
    if len(offsets) == 1:
        return np.zeros(0)
    at, begin, end = _padded(model, words, offsets)
    x = model.emb[at].sum(axis=1)
    ends = np.empty(2 * len(begin), np.int64)
    ends[0::2], ends[1::2] = begin, end
    pooled = []
    for k in range(len(WIDTHS)):
        z = _responses(model, x, k)
        z = np.concatenate([z, np.full((1, z.shape[1]), -np.inf, z.dtype)])
        pooled.append(np.maximum.reduceat(z, ends, axis=0)[0::2])
    h = np.maximum(np.concatenate(pooled, axis=1), 0)
    return 1 / (1 + np.exp(-(h @ model.out + model.out_bias).astype(np.float64)))


def untrained(used: np.ndarray) -> ToxicityModel:
    """Random weights, with an embedding for each slot of used."""
    rng = np.random.default_rng(SEED)
    model = ToxicityModel(
        used.astype(np.int32), rng.normal(0, 0.1, (len(used) + 1, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0,
    )
    model.emb[0] = 0
    model.emb_g = np.full(len(model.emb), 1e-6, np.float32)
    model.sums = [np.full_like(p, 1e-6) for p in (*model.filters, *model.biases, model.out)]
    return model


def train(model: ToxicityModel, texts: list[np.ndarray], labels: np.ndarray, epochs: range, of: int, seed: int) -> np.ndarray:
    """Some of all the epochs over slot arrays, in place, by AdaGrad on the log loss. Each pooled maximum passes its gradient to
    its window. Returns the embeddings that changed."""
    rng = np.random.default_rng((SEED, seed))
    touched = np.zeros(len(model.emb), bool)
    emb_g, sums, bias_g = model.emb_g, model.sums, model.bias_g
    params = [*model.filters, *model.biases, model.out]
    for epoch in epochs:
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / of)
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
            at, begin, end = _padded(model, np.concatenate([texts[i] for i in pick]), offsets)
            x = model.emb[at].sum(axis=1)
            best, pooled = [], []
            for k in range(len(WIDTHS)):
                z = _responses(model, x, k)
                arg = np.stack([b + z[b:e].argmax(axis=0) for b, e in zip(begin, end)])
                best.append(arg)
                pooled.append(z[arg, np.arange(FILTERS)])
            h = np.maximum(np.concatenate(pooled, axis=1), 0)
            y = labels[pick]
            p = 1 / (1 + np.exp(-(h @ model.out + model.out_bias)))
            d = ((p - y) / len(pick)).astype(np.float32)
            grads_out, gb = h.T @ d, float(d.sum())
            dh = d[:, None] * model.out * (h > 0)
            grads_f, grads_b, hit, hit_g = [], [], [], []
            for k, width in enumerate(WIDTHS):
                g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                win = best[k][..., None] + np.arange(width)  # texts x filters x width
                grads_f.append(np.einsum("nfwd,nf->wdf", x[win], g))
                grads_b.append(g.sum(axis=0))
                hit.append(win.ravel())
                hit_g.append(np.einsum("wdf,nf->nfwd", model.filters[k], g).reshape(-1, DIM))
            for param, total, grad in zip(params, sums, [*grads_f, *grads_b, grads_out]):
                total += grad * grad
                param -= rate * grad / np.sqrt(total)
            bias_g += gb * gb
            model.out_bias -= rate * gb / bias_g**0.5
            hit_all, g_all = np.concatenate(hit), np.concatenate(hit_g)
            live = np.abs(g_all).sum(axis=1) > 0
            ids = at[hit_all[live]]
            flat, g_rows = ids.ravel(), np.repeat(g_all[live], ids.shape[1], axis=0)
            by_row = np.argsort(flat, kind="stable")
            uniq, heads = np.unique(flat[by_row], return_index=True)
            if not len(uniq):
                continue
            grad = np.add.reduceat(g_rows[by_row], heads, axis=0)
            emb_g[uniq] += (grad * grad).sum(axis=1)
            model.emb[uniq] -= rate * grad / np.sqrt(emb_g[uniq])[:, None]
            model.emb[0] = 0
            touched[uniq] = True
    model.bias_g = float(bias_g)
    touched[0] = False
    return np.flatnonzero(touched)


def calibrate(clean: dict[str, dict[int, int]]) -> dict[str, float]:
    """For each language the lowest threshold, 0.5 at least, at or above which no more than FALSE_SHARE of clean documents lie.
    Languages with fewer than MIN_CLEAN of them take the threshold of all together. clean: for each language the number of documents by the
    log odds of their scores, in FINE steps for a unit."""
    def at(counts: dict[int, int]) -> float:
        left, limit = FALSE_SHARE * sum(counts.values()), 0
        for odds in sorted((x for x in counts if x >= 0), reverse=True):
            left -= counts[odds]
            if left < 0:
                limit = odds + 1
                break
        return 1 / (1 + float(np.exp(-limit / FINE)))

    pooled: dict[int, int] = {}
    for counts in clean.values():
        for odds, n in counts.items():
            pooled[odds] = pooled.get(odds, 0) + n
    return {x: at(counts if sum(counts.values()) >= MIN_CLEAN else pooled) for x, counts in clean.items()}


def _used_slots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's texts have each slot."""
    seen = np.zeros(1 << SLOT_BITS, np.int32)
    for batch in batches_of(it, "_text", 2 << 20):
        words, offs = slots(*byte_views(batch.column("_text")))
        for a, b in zip(offs, offs[1:]):
            seen[np.unique(words[a:b])] += 1
    held = np.flatnonzero(seen)
    for at in range(0, len(held), 100_000):
        part = held[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[part].astype(np.int64))], names=["slot", "n"])


def _flat(model: ToxicityModel) -> np.ndarray:
    """Weights other than embeddings, and their sums, as one array."""
    return np.concatenate([np.ravel(x) for x in (*model.filters, *model.biases, model.out, *model.sums, model.out_bias, model.bias_g)]).astype(np.float64)


def _unflatten(model: ToxicityModel, flat: np.ndarray) -> None:
    at = 0
    for x in (*model.filters, *model.biases, model.out, *model.sums):
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    model.out_bias, model.bias_g = map(float, flat[at:])


_CHANGED = [f"e{k}" for k in range(DIM)] + ["g"]


def _trainer(sent, epochs: range, of: int, tasks: int):
    """For mapInArrow: trains on a task's documents from the weights sent. Rows from 0: changed embeddings, with their sums; below 0: other weights, one in each."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: dict[int, tuple[list, list]] = {}
        for batch in batches_of(it, "_text", 2 << 20):
            words, offs = slots(*byte_views(batch.column("_text")))
            for task, toxic, a, b in zip(batch.column("task").to_pylist(), batch.column("toxic").to_pylist(), offs, offs[1:]):
                texts, labels = dealt.setdefault(task, ([], []))
                texts.append(words[a:b])
                labels.append(toxic)
        for task, (texts, labels) in dealt.items():
            model = pickle.loads(pickle.dumps(sent.value))
            changed = train(model, texts, np.array(labels, np.float32), epochs, of, task * of + epochs.start)
            flat = _flat(model)
            values = np.zeros((len(changed) + len(flat), DIM + 1))
            values[: len(changed), :DIM], values[: len(changed), DIM], values[len(changed) :, 0] = model.emb[changed], model.emb_g[changed], flat
            row = np.concatenate([changed, -1 - np.arange(len(flat))])
            for at in range(0, len(row), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(row[part]), *(pa.array(np.ascontiguousarray(values[part, k])) for k in range(DIM + 1))], names=["row", *_CHANGED])
    return run


def _odds(sent):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it, "_text", 2 << 20):
            s = np.clip(scores(sent.value, *slots(*byte_views(batch.column("_text")))), 1e-15, 1 - 1e-15)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(np.floor(np.log(s / (1 - s)) * FINE).astype(np.int64))], names=["lang", "odds"])
    return run


def fit(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ToxicityModel:
    """Learn from all labelled documents where use holds, and their whole texts.

    By a hash of the id a fifth of them sets the thresholds, and the others are dealt to tasks of about TASK_DOCS documents. Each task trains on its own from the same
    weights; the weights are averaged, an embedding's over the tasks that changed it, and sent out again, ROUNDS times. The driver gets
    weights and counts only. Where an id has several labels, toxic wins; null labels don't count.
    Without labelled documents every score is that of the untrained weights with thresholds of 0.5.
    """
    spark = docs.sparkSession
    tagged = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    base = docs.filter(use).select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), text_bytes(text_col).alias("_text"))
    hashed = F.xxhash64(F.lit(SEED), F.col("id").cast("string"), "_text")
    rows = stage(base.join(tagged.hint("merge"), "id").select(F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), "lang", hashed.alias("h"), "_text"), "labelled")
    kept = F.shiftrightunsigned("h", 40).bitwiseAND(F.lit(1023)) >= 205
    learnt, held = rows.filter(kept), rows.filter(~kept)
    n, size = learnt.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    counted = learnt.select("_text").mapInArrow(_used_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_DOCS)
    used = stage(counted.select(F.col("slot").cast("int")), "slots")  # written, so that shuffle files go, as those of each round do
    model = untrained(np.sort(used.toArrow().column("slot").to_numpy()))
    discard(used)
    tasks = max(1, -(-n // TASK_DOCS), -(-size // TASK_BYTES))
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(n, 1))) if n else 0
    dealt = learnt.select("toxic", "_text", F.pmod("h", F.lit(tasks)).cast("int").alias("task")).repartitionById(tasks, F.col("task")).sortWithinPartitions("task", F.xxhash64("_text"), "toxic")
    for k in range(ROUNDS if n else 0):
        part = range(epochs * k // ROUNDS, epochs * (k + 1) // ROUNDS)
        sent = spark.sparkContext.broadcast(model)
        found = dealt.mapInArrow(_trainer(sent, part, epochs, tasks), f"row long, {', '.join(f'{c} double' for c in _CHANGED)}")
        mean = stage(found.groupBy("row").agg(*(F.avg(c).alias(c) for c in _CHANGED)), "weights")
        got = mean.filter("row >= 0").select(F.col("row").cast("int"), *(F.col(c).cast("float") for c in _CHANGED)).toArrow()
        row = got.column("row").to_numpy()
        for j, c in enumerate(_CHANGED[:DIM]):
            model.emb[row, j] = got.column(c).to_numpy()
        model.emb_g[row] = got.column(_CHANGED[DIM]).to_numpy()
        other = mean.filter("row < 0").select("row", _CHANGED[0]).toArrow()
        _unflatten(model, other.column(_CHANGED[0]).to_numpy()[np.argsort(-other.column("row").to_numpy())])
        del got, other
        sent.destroy()
        discard(mean)
    model.emb_g, model.sums = None, []
    sent = spark.sparkContext.broadcast(model)
    clean: dict[str, dict[int, int]] = {}
    for r in held.filter("toxic = 0").select("lang", "_text").mapInArrow(_odds(sent), "lang string, odds long").groupBy("lang", "odds").agg(F.count(F.lit(1)).alias("n")).collect():
        clean.setdefault(r.lang, {})[r.odds] = r.n
    sent.destroy()
    discard(rows)
    if clean and n:
        model.thresholds = calibrate(clean)
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", names: tuple[str, str] = ("_score", "_rejected")) -> DataFrame:
    """All columns of docs, and _score (0 to 1) and _rejected (score above the threshold of the row's language), under
    the names given; columns of docs that have these names are replaced.

    The score depends on the text alone. Null and empty texts get the score of a neutral word; a null or unknown
    language has the threshold 0.5. Repeated rows are scored alike, an empty table gives no rows. Texts are scored whole; a batch
    holds about 2 MB of them or a single longer one. Further columns pass through unchanged, whatever their names."""
    docs = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches_of(it, "text", 2 << 20):
            s = scores(m, *slots(*byte_views(batch.column("text"))))
            limit = np.array([m.thresholds.get(x or "", 0.5) for x in batch.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(s), pa.array(s >= limit)], names=[*batch.schema.names[:-2], "score", "rejected"])

    # Names with dots and such don't pass through Arrow, so columns go by place.
    placed = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    rows = placed.select("*", text_bytes(f"c{columns.index(text_col)}").alias("text"), F.col(f"c{columns.index(lang_col)}").cast("string").alias("lang"))
    return rows.mapInArrow(run, f"{fields}, score double, rejected boolean").toDF(*columns, *names)
