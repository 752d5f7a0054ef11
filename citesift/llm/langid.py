"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, mix, stage, text_bytes

ORDER = 4
#: Documents of a language in the training sample, about.
SAMPLE_ROWS = 2000
#: A text is rejected if its cross-entropy lies above this quantile of the language's calibration texts, plus a margin in nats.
ACCEPT_QUANTILE, MARGIN = 0.995, 0.25
#: Characters beyond which more text no longer sharpens the score.
SHARPNESS = 50
_SPACE, _EDGE = 32, 1
_TABLE: np.ndarray | None = None
_MARK: np.ndarray | None = None


def alphabet() -> np.ndarray:
    """Code points to symbols: letters to their lower case, marks (vowel signs, accents) as they are, all others to a space, NUL to a
    text's edge."""
    global _TABLE, _MARK
    if _TABLE is None:
        table = np.full(0x110000, _SPACE, np.uint32)
        marks = np.zeros(0x110000, bool)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
            elif unicodedata.category(c)[0] == "M":
                table[cp], marks[cp] = cp, True
        table[0] = _EDGE
        _TABLE, _MARK = table, marks
    return _TABLE


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ORDER - 1 edges and with a final edge; runs of spaces are one. Also where each
    text begins (n + 1 offsets into the symbols, edges included)."""
    edge = "\0" * (ORDER - 1)
    joined = "".join(f"{edge}{t}\0" for t in texts)
    s = alphabet()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != _SPACE) | (s[:-1] != _SPACE)
    at = np.concatenate([[0], np.cumsum([len(t) + ORDER for t in texts])])
    count = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], count[at]


def gram_hashes(s: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols that end at each place from n - 1 on."""
    h = np.full(len(s) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + s[k : len(s) - n + 1 + k].astype(np.uint64) + np.uint64(1)
    return mix(h)


@dataclass
class Level:
    """Grams of one order: sorted hashes, log probabilities (grams x languages), and for the contexts of this order
    sorted hashes and log weights of the lower order."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


@dataclass
class LanguageModel:
    langs: list[str]
    levels: list[Level]  # orders 1 to ORDER
    floor: np.ndarray  # log probability of any symbol below order 1
    limits: np.ndarray  # cross-entropy above which a language is rejected


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in sorted keys, or -1."""
    if len(keys) == 0:
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def log_probs(model: LanguageModel, s: np.ndarray, order: int, ends: np.ndarray) -> np.ndarray:
    """Log probability (places x languages) of the symbol at each of ends after the order - 1 before it."""
    if order == 0:
        return np.broadcast_to(model.floor, (len(ends), len(model.langs)))
    level = model.levels[order - 1]
    at = _find(level.keys, gram_hashes_at(s, order, ends))
    out = level.logp[at]
    miss = np.flatnonzero(at < 0)
    if len(miss):
        ctx = _find(level.contexts, gram_hashes_at(s, order - 1, ends[miss] - 1))
        low = log_probs(model, s, order - 1, ends[miss])
        out[miss] = low + np.where(ctx[:, None] >= 0, level.weight[ctx], 0)
    return out


def gram_hashes_at(s: np.ndarray, n: int, ends: np.ndarray) -> np.ndarray:
    h = np.full(len(ends), n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + s[ends - n + 1 + k].astype(np.uint64) + np.uint64(1)
    return mix(h)


def _kneser_ney(grams: np.ndarray, counts: np.ndarray, lower: np.ndarray | None, context: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interpolated probability of each gram, and per context id the weight of the lower order.

    lower is the lower order's probability of each gram, or None for the uniform one; context numbers the grams' contexts."""
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    d = ones / (ones + 2 * twos) if ones and twos else 0.5
    total = np.bincount(context, counts)
    kinds = np.bincount(context)
    weight = d * kinds / total
    base = 1 / (n_symbols + 1) if lower is None else lower
    return np.maximum(counts - d, 0) / total[context] + weight[context] * base, weight, total


def train_language(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Orders 1 to ORDER of one language: gram symbols, probabilities, context symbols, weights.

    The highest order has its counts; lower orders count the distinct symbols that come before a gram."""
    per_order = {ORDER: (grams, counts.astype(np.float64))}
    for n in range(ORDER - 1, 0, -1):
        g, c = np.unique(per_order[n + 1][0][:, 1:], axis=0, return_counts=True)
        per_order[n] = (g, c.astype(np.float64))
    out, lower_g, lower_p = [], None, None
    for n in range(1, ORDER + 1):
        g, c = per_order[n]
        ctx, which = np.unique(g[:, :-1], axis=0, return_inverse=True) if n > 1 else (np.zeros((1, 0), g.dtype), np.zeros(len(g), int))
        low = None
        if lower_g is not None:
            keys = gram_hashes_rows(lower_g)
            order = np.argsort(keys)
            low = lower_p[order[np.searchsorted(keys[order], gram_hashes_rows(g[:, 1:]))]]
        p, weight, _ = _kneser_ney(g, c, low, which.ravel(), len(per_order[1][0]))
        out.append((g, p, ctx, weight))
        lower_g, lower_p = g, p
    return out


def gram_hashes_rows(g: np.ndarray) -> np.ndarray:
    h = np.full(len(g), g.shape[1], np.uint64)
    for k in range(g.shape[1]):
        h = h * np.uint64(0x9E3779B97F4A7C15) + g[:, k].astype(np.uint64) + np.uint64(1)
    return mix(h)


def build(tables: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """Join the languages' models: one sorted array of hashes for each order, and a column for each language.

    Where a language lacks a gram that another has, the column holds what backing off gives it."""
    langs = sorted(tables)
    trained = [train_language(*tables[x]) for x in langs]
    floor = np.array([-np.log(len(t[0][0]) + 1) for t in trained], np.float32)
    model = LanguageModel(langs, [], floor, np.full(len(langs), np.inf))
    for n in range(1, ORDER + 1):
        all_g = np.unique(np.concatenate([t[n - 1][0] for t in trained]), axis=0)
        all_c = np.unique(np.concatenate([t[n - 1][2] for t in trained]), axis=0)
        order, corder = np.argsort(gram_hashes_rows(all_g)), np.argsort(gram_hashes_rows(all_c))
        all_g, all_c = all_g[order], all_c[corder]
        keys, ckeys = gram_hashes_rows(all_g), gram_hashes_rows(all_c)
        weight = np.zeros((len(all_c), len(langs)), np.float32)
        for j, t in enumerate(trained):
            weight[_find(ckeys, gram_hashes_rows(t[n - 1][2])), j] = np.log(t[n - 1][3])
        flat, ends = all_g.ravel(), np.arange(len(all_g)) * n + n - 1
        logp = log_probs(model, flat, n - 1, ends) + weight[_find(ckeys, gram_hashes_rows(all_g[:, :-1]))]
        for j, t in enumerate(trained):
            logp[_find(keys, gram_hashes_rows(t[n - 1][0])), j] = np.log(t[n - 1][1])
        model.levels.append(Level(keys, logp.astype(np.float32), ckeys, weight))
    return model


def cross_entropies(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nats a symbol of each text in each language, the symbols counted, and whether the text has a letter."""
    s, offs = symbols(texts)
    sums = np.zeros((len(texts), len(model.langs)))
    is_edge = s == _EDGE
    # Each symbol but the leading edges is predicted once, in blocks of bounded memory.
    block = max(1, (4 << 20) // max(1, len(model.langs)))
    mask = np.ones(len(s), bool)
    for k in range(ORDER - 1):
        mask[offs[:-1] + k] = False
    ends = np.flatnonzero(mask)
    doc = np.searchsorted(offs, ends, side="right") - 1
    for lo in range(0, len(ends), block):
        lp = log_probs(model, s, ORDER, ends[lo : lo + block])
        d = doc[lo : lo + block]
        heads = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        sums[d[heads]] += np.add.reduceat(lp, heads, axis=0, dtype=np.float64)
    n = np.diff(offs) - (ORDER - 1)
    letters = np.concatenate([[0], np.cumsum((s != _SPACE) & ~is_edge & ~_MARK[s])])
    return -sums / n[:, None], n, letters[offs[1:]] > letters[offs[:-1]]


def _gram_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(it, "_text", 8 << 20):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        texts = [t.decode("utf-8", "replace") for t in batch.column("_text").to_pylist()]
        for x in sorted(set(langs)):
            s, offs = symbols([t for t, y in zip(texts, langs) if y == x])
            grams = np.lib.stride_tricks.sliding_window_view(s, ORDER)
            # A window is of one text exactly if it doesn't reach over a final edge into the next text's edges.
            mask = np.ones(len(s), bool)
            for k in range(ORDER - 1):
                mask[offs[:-1] + k] = False
            g, c = np.unique(grams[mask[ORDER - 1 :]], axis=0, return_counts=True)
            names = [row.tobytes() for row in np.ascontiguousarray(g, dtype="<u4")]
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(g), pa.string()), pa.array(names, pa.binary()), pa.array(c, pa.int64())], names=["lang", "gram", "n"])


def fit(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn a model of each language from the documents where use holds and the language isn't null.

    About SAMPLE_ROWS documents of each language are taken, by a hash of the id; grams are counted on the executors. A
    fifth of the sample sets the rejection limits. Empty and null texts teach nothing. No documents: no languages. The table of
    languages, a row for each, is broadcast, so texts aren't shuffled by language."""
    base = docs.filter(use & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(5), F.col(id_col).cast("string")).alias("h"), text_bytes(text_col).alias("_text"))
    share = base.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.least(F.lit(1.0), SAMPLE_ROWS / F.col("n"))).select("lang", "part")
    unit = F.col("h").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    sample = stage(base.join(F.broadcast(share), "lang").filter(unit < F.col("part")).select("lang", "h", "_text"), "langid-sample")
    held = F.pmod(F.shiftright("h", 40), F.lit(5)) == 0
    counted = sample.filter(~held).select("lang", "_text").mapInArrow(_gram_counts, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    tables = {}
    names = np.array(got["lang"].to_pylist(), dtype=object)
    grams, counts = got["gram"].to_pylist(), got["n"].to_numpy()
    for x in sorted(set(names)):
        pick = np.flatnonzero(names == x)
        g = np.frombuffer(b"".join(grams[i] for i in pick), "<u4").reshape(-1, ORDER)
        order = np.lexsort(g.T[::-1])
        tables[x] = (g[order], counts[pick][order])
    model = build(tables) if tables else LanguageModel([], [], np.zeros(0), np.zeros(0))
    if tables:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for batch in batches_of(it, "_text", 4 << 20):
                x, _, letters = cross_entropies(m, [t.decode("utf-8", "replace") for t in batch.column("_text").to_pylist()])
                lang = batch.column("lang").to_pylist()
                column = np.array([m.langs.index(y) if y in m.langs else 0 for y in lang])
                ok = letters & np.array([y in m.langs for y in lang])
                yield pa.RecordBatch.from_arrays([pa.array([y for y, k in zip(lang, ok) if k], pa.string()), pa.array(x[np.arange(len(lang)), column][ok])], names=["lang", "x"])

        limits = sample.filter(held).select("lang", "_text").mapInArrow(own, "lang string, x double").groupBy("lang").agg(F.percentile_approx("x", ACCEPT_QUANTILE, 10000).alias("q"))
        for r in limits.collect():
            model.limits[model.langs.index(r.lang)] = r.q + MARGIN
    discard(sample)
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row.

    The language of the lowest cross-entropy by symbol; its score is its share among the languages' likelihoods of
    SHARPNESS symbols (fewer if the text is shorter). rejected: the text fits even that language worse than the
    calibration allows. Null texts and those without a letter are und, with score 0 and rejected. Ties go to the
    language first in order. A model without languages calls all texts und. Repeated rows are judged alike, an empty table gives no
    rows. Texts are taken whole; a batch holds about 4 MB of them or a single longer one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches_of(it, "_text", 4 << 20):
            texts = [t.decode("utf-8", "replace") for t in batch.column("_text").to_pylist()]
            if m.langs:
                x, n, letters = cross_entropies(m, texts)
                best = x.argmin(axis=1)
                z = np.exp(-(x - x.min(axis=1, keepdims=True)) * np.minimum(n, SHARPNESS)[:, None])
                score = np.where(letters, 1 / z.sum(axis=1), 0.0)
                reject = ~letters | (x.min(axis=1) > m.limits[best])
                best = np.where(letters, best, len(m.langs))
            else:
                best, score, reject = np.zeros(len(texts), int), np.zeros(len(texts)), np.ones(len(texts), bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(reject)], names=["doc_id", "lang_pred", "score", "rejected"])

    slim = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("_text"))
    return slim.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double, rejected boolean")
