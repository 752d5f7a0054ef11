"""Removal of repeated passages by suffix arrays, built by the difference-cover algorithm over shared passages.

Every string of LENGTH bytes holds one anchor, the GRAM-byte string in it with the least hash. Equal strings have equal
anchors, so the places of an anchor that two texts share can be sorted apart from those of any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, mix, stage, text_bytes

LENGTH, GRAM = 50, 20
_SPAN = LENGTH - GRAM + 1  # grams in a window
#: Bytes of text for each group of anchors, and for each group of passages.
ANCHOR_GROUP_BYTES, PASSAGE_GROUP_BYTES = 16 << 20, 512 << 10
_BATCH, _PIECE, _CHUNK = 2 << 20, 64 << 20, 64 << 20
_POS_BITS = 28
_R = np.random.default_rng(8).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s (integers above 0).

    The suffixes at places 1 and 2 modulo 3 are the sample: their triples are sorted and named, the names are sorted by
    recursion if two are equal, the other suffixes are sorted by a symbol and the rank after it, and both are merged."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    places = np.concatenate([ones, twos])
    order = _order(t[places], t[places + 1], t[places + 2])
    a = places[order]
    new = np.concatenate([[True], (t[a[1:]] != t[a[:-1]]) | (t[a[1:] + 1] != t[a[:-1] + 1]) | (t[a[1:] + 2] != t[a[:-1] + 2])])
    names = np.empty(len(places), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
    rank = np.zeros(n + 5, np.int64)
    rank[places[order]] = np.arange(1, len(places) + 1)
    zeros = np.arange(0, n, 3)
    zeros = zeros[_order(t[zeros], rank[zeros + 1])]
    sample = places[order]
    sample = sample[sample < n]
    # A suffix at 0 modulo 3 comes after those of the sample that are less by a symbol, or two, and the rank that follows.
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    wide = np.int64(n + 6)
    before = np.searchsorted(t[one] * wide + rank[one + 1], t[zeros] * wide + rank[zeros + 1])
    pair = np.int64(t.max() + 1)
    if float(pair) * float(pair) * float(wide) < 2**62:
        before += np.searchsorted((t[two] * pair + t[two + 1]) * wide + rank[two + 2], (t[zeros] * pair + t[zeros + 1]) * wide + rank[zeros + 2])
    else:  # number the pairs of symbols first
        both = np.concatenate([t[two] * pair + t[two + 1], t[zeros] * pair + t[zeros + 1]])
        both = np.unique(both, return_inverse=True)[1]
        before += np.searchsorted(both[: len(two)] * wide + rank[two + 2], both[len(two) :] * wide + rank[zeros + 2])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zeros))
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at], out[~taken] = zeros, sample
    return out


def _order(*keys: np.ndarray) -> np.ndarray:
    """Places in the order of the keys (integers, none below 0). Keys and place share one number that is sorted by itself, which is
    several times as fast as sorting places by keys; where they don't fit, the first two keys are numbered by rank first."""
    n = len(keys[0])
    place_bits = n.bit_length()

    def packed(parts: list[np.ndarray], widths: list[int]) -> np.ndarray:
        key = parts[0].astype(np.uint64)
        for k, b in zip(parts[1:], widths[1:]):
            key = key << np.uint64(b) | k.astype(np.uint64)
        key = key << np.uint64(place_bits) | np.arange(n, dtype=np.uint64)
        key.sort()
        return key

    keys = list(keys)
    while n:
        bits = [int(k.max()).bit_length() for k in keys]
        if sum(bits) + place_bits <= 64:
            return (packed(keys, bits) & np.uint64((1 << place_bits) - 1)).astype(np.int64)
        if len(keys) < 3 or bits[0] + bits[1] + place_bits > 64:
            break
        both = packed(keys[:2], bits[:2])
        order = (both & np.uint64((1 << place_bits) - 1)).astype(np.int64)
        both >>= np.uint64(place_bits)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], both[1:] != both[:-1]]))
        keys = [rank, *keys[2:]]
    return np.lexsort(keys[::-1])


def window_classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each window of LENGTH bytes at starts in data: equal exactly for equal windows. data has LENGTH
    bytes or more after each start."""
    sa = suffix_array(data.astype(np.int64) + 1)
    wanted = np.full(len(data), -1, np.int64)
    wanted[starts] = np.arange(len(starts))
    order = wanted[sa]
    order = order[order >= 0]
    a = starts[order]
    same = np.ones(max(0, len(a) - 1), bool)
    words = np.zeros(len(data), np.uint64)
    for k in range(8):
        words[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    for at in (0, 8, 16, 24, 32, 40, LENGTH - 8):
        same &= words[a[1:] + at] == words[a[:-1] + at]
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(np.concatenate([[True], ~same])) - 1 if len(a) else 0
    return out


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All texts as arrays of _CHUNK bytes or so, whose places fit _POS_BITS; pieces of very long texts overlap, so each window lies in
    one piece. For each piece its text, its place in that text and where it begins in the array (n + 1 offsets)."""
    parts, text, base, size = [], [], [], 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.array(text, np.int64), np.array(base, np.int64), offs

    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), _PIECE):
            if size >= _CHUNK:
                yield made()
                parts, text, base, size = [], [], [], 0
            parts.append(t[a : a + _PIECE + LENGTH - 1])
            text.append(i)
            base.append(a)
            size += len(parts[-1])
    if parts:
        yield made()


def window_anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the place of the anchor of each, and the gram hash at every place."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, width = _R[data], 1  # hashes of 1, 2, 4, ... bytes make up those of GRAM bytes
    total, done = None, 0
    k = GRAM
    while k:
        if k & 1:
            if total is None:
                total, done = h, width
            else:
                m = min(len(total), len(h) - done)
                total, done = total[:m] * np.uint64(pow(_P, width, 2**64)) + h[done : done + m], done + width
        k >>= 1
        if k:
            h, width = h[:-width] * np.uint64(pow(_P, width, 2**64)) + h[width:], 2 * width
    grams = mix(total)
    # The least hash, of equal ones the first.
    low = (grams >> np.uint64(_POS_BITS)) << np.uint64(_POS_BITS) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= _SPAN:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    rest = _SPAN - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    inside = np.zeros(n + 1, np.int8)
    lens = np.diff(offs)
    long = lens >= LENGTH
    inside[offs[:-1][long]] += 1
    np.subtract.at(inside, offs[1:][long] - LENGTH + 1, 1)
    starts = np.flatnonzero(np.cumsum(inside[: len(low)], dtype=np.int8))
    return starts, (low[starts] & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64), grams


def _anchors(groups: int):
    """Anchors of each batch by group, those that two texts of the batch share settled at once (group -1 - a spread number)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it, "_text", _BATCH):
            rid = batch.column("rid").to_numpy()
            for data, text, base, offs in _pieces(batch.column("_text").to_pylist()):
                _, anchor, grams = window_anchors(data, offs)
                at = np.unique(anchor)
                if not len(at):
                    continue
                piece = np.searchsorted(offs, at, side="right") - 1
                h, r, pos = grams[at], rid[text[piece]], at - offs[piece] + base[piece]
                order = np.argsort(h, kind="stable")
                hs, rs = h[order], r[order]
                heads = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
                shared = np.minimum.reduceat(rs, heads) != np.maximum.reduceat(rs, heads)
                sizes = np.diff(np.append(heads, len(hs)))
                settled = np.empty(len(h), bool)
                settled[order] = np.repeat(shared, sizes)
                # One place of a settled anchor goes on, for the sake of other batches.
                go = ~settled
                go[order[heads[shared]]] = True
                group = (h % np.uint64(groups)).astype(np.int64)
                yield from _blobs(group[go], h[go], r[go], pos[go])
                yield from _blobs(-1 - (r[settled] % groups), h[settled], r[settled], pos[settled])
    return run


_BLOB = pa.schema([("grp", pa.int64()), ("h", pa.binary()), ("rid", pa.binary()), ("pos", pa.binary())])


def _blobs(group: np.ndarray, h: np.ndarray, rid: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each group with its arrays; ids and places as differences, which compress well."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if len(g) else np.zeros(1, int)
    rows = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    if rows:
        diff = lambda x, kind: np.diff(x, prepend=0).astype(kind).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(g[cuts[:-1]]), pa.array([h[i].tobytes() for i in rows]), pa.array([diff(rid[i], np.int64) for i in rows]), pa.array([diff(pos[i], np.int32) for i in rows])], schema=_BLOB)


def _unblob(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in table["h"].to_pylist()])
    rid = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in table["rid"].to_pylist()])
    pos = np.concatenate([np.cumsum(np.frombuffer(x, np.int32), dtype=np.int32) for x in table["pos"].to_pylist()])
    return h, rid, pos


def _shared(table: pa.Table) -> pa.Table:
    """Places whose anchor lies in two texts or more."""
    h, rid, pos = _unblob(table)
    if table["grp"][0].as_py() >= 0:
        order = np.argsort(h, kind="stable")
        hs, rs = h[order], rid[order]
        heads = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
        many = np.minimum.reduceat(rs, heads) != np.maximum.reduceat(rs, heads)
        keep = order[np.repeat(many, np.diff(np.append(heads, len(hs))))]
        rid, pos = rid[keep], pos[keep]
    return pa.table({"rid": rid, "pos": pos})


_PASSAGE = pa.schema([("grp", pa.int64()), ("rid", pa.int64()), ("first", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("passage", pa.binary())])
_PASSAGE_DDL = "grp long, rid long, first long, start int, stop int, passage binary"


def _passages(groups: int):
    """For each shared anchor the bytes of all windows that it is the anchor of. Of one passage in a batch, only the place in the
    smallest text goes on; others are settled (group below 0): all their windows start in a smaller text."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it, "_text", _BATCH):
            rid, first = batch.column("rid").to_numpy(), batch.column("first").to_numpy()
            known = batch.column("pos")
            for data, text, base, offs in _pieces(batch.column("_text").to_pylist()):
                starts, anchor, grams = window_anchors(data, offs)
                flags = np.zeros(len(data), bool)
                for i in range(len(text)):
                    p = known[int(text[i])].values.to_numpy() - base[i]
                    p = p[(p >= 0) & (p < offs[i + 1] - offs[i])]
                    flags[offs[i] + p] = True
                use = flags[anchor]
                starts, anchor = starts[use], anchor[use]
                if not len(starts):
                    continue
                heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
                lo, hi = starts[heads], starts[np.append(heads[1:], len(starts)) - 1] + LENGTH
                piece = np.searchsorted(offs, lo, side="right") - 1
                body = data.tobytes()
                found = [body[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
                f = first[text[piece]]
                least: dict[bytes, int] = {}
                for x, y in zip(found, f.tolist()):
                    if least.get(x, y) >= y:
                        least[x] = y
                bound = np.array([least[x] for x in found])
                group = (grams[anchor[heads]] % np.uint64(groups)).astype(np.int64)
                r = rid[text[piece]]
                settled = bound != f
                start = (lo - offs[piece] + base[piece]).astype(np.int32)
                stop = (hi - offs[piece] + base[piece]).astype(np.int32)
                group = np.where(settled, -1 - r % groups, group)
                keep = [None if s else x for s, x in zip(settled.tolist(), found)]
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(r), pa.array(f), pa.array(start), pa.array(stop), pa.array(keep, pa.binary())], schema=_PASSAGE)
    return run


def _removed(table: pa.Table) -> pa.Table:
    """Byte ranges (rid, start, stop) of windows that start in a smaller text too."""
    if table["grp"][0].as_py() < 0:
        return table.select(["rid", "start", "stop"])
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(x, len(number)) for x in table["passage"].to_pylist()])
    first, rid, start = (table[c].to_numpy() for c in ("first", "rid", "start"))
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, which, first)
    lens = np.array([len(x) for x in number])
    offs = np.concatenate([[0], np.cumsum(lens)])
    windows = lens - LENGTH + 1
    w_offs = np.concatenate([[0], np.cumsum(windows)])
    of = np.repeat(np.arange(len(lens)), windows)
    at = np.arange(w_offs[-1]) - w_offs[of] + offs[of]
    classes = window_classes(np.frombuffer(b"".join(number), np.uint8), at)
    best = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, classes, least[of])
    best = best[classes]
    # Every place of a passage: which of its windows start in a smaller text.
    n = windows[which]
    row = np.repeat(np.arange(len(which)), n)
    o = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    gone = best[w_offs[which[row]] + o] < first[row]
    row, o = row[gone], o[gone]
    heads = np.concatenate([[True], (row[1:] != row[:-1]) | (o[1:] != o[:-1] + 1)]) if len(row) else np.zeros(0, bool)
    ends = np.append(heads[1:], True) if len(row) else heads
    return pa.table({"rid": rid[row[heads]], "start": (start[row[heads]] + o[heads]).astype(np.int32), "stop": (start[row[ends]] + o[ends] + LENGTH).astype(np.int32)})


def cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the ranges, the bytes removed and the maximal runs they form."""
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in merged:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), sum(b - a for a, b in merged), len(merged)


def _applied(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(it, "_text", _BATCH):
        out = []
        for t, r in zip(batch.column("_text").to_pylist(), batch.column("ranges").to_pylist()):
            kept, removed, spans = cut(t, [(x["start"], x["stop"]) for x in r or ()])
            out.append((removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        removed, spans, sha, kept = zip(*out)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("first"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())], names=["key", "first", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Remove every byte that a 50-byte string covers which also starts in a document with a smaller id.

    Returns for each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, with texts also kept (binary). Ids are integers; a null id is larger than
    all others. Null texts are empty, texts below 50 bytes stay as they are. Rows of one id don't count as smaller for each
    other. Equal texts are worked on once: a copy with a larger id than the smallest loses all its bytes.
    """
    none = 2**63 - 1
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("_n"), text_bytes(text_col).alias("_text"))
    key = F.sha2("_text", 256).alias("key")
    small = rows.select("doc_id", "_n", key, F.octet_length("_text").cast("long").alias("n_bytes"))
    reps = rows.select(key, "_n", "_text").groupBy("key").agg(F.min("_n").alias("first"), F.any_value("_text").alias("_text"))
    reps = stage(reps.withColumn("rid", F.monotonically_increasing_id()), "texts")
    total = reps.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    groups = lambda per: max(8, -(-total // per))
    anchors = reps.filter(F.octet_length("_text") >= LENGTH).select("rid", "_text").mapInArrow(_anchors(groups(ANCHOR_GROUP_BYTES)), "grp long, h binary, rid binary, pos binary")
    shared = stage(anchors.groupBy("grp").applyInArrow(_shared, "rid long, pos int").groupBy("rid").agg(F.collect_set("pos").alias("pos")), "anchors")
    spots = reps.select("rid", "first", "_text").join(shared.hint("merge"), "rid").select("rid", "first", "_text", "pos")
    passages = spots.mapInArrow(_passages(groups(PASSAGE_GROUP_BYTES)), _PASSAGE_DDL)
    ranges = stage(passages.groupBy("grp").applyInArrow(_removed, "rid long, start int, stop int").groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("ranges")), "ranges")
    discard(shared)
    joined = reps.join(ranges.hint("merge"), "rid", "left").select("key", "first", "_text", "ranges")
    done = joined.mapInArrow(_applied, "key string, first long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    done = stage(done if texts else done.drop("kept"), "kept")
    discard(reps, ranges)
    out = small.join(done.hint("merge"), "key")
    copy = (F.col("_n") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    pick = lambda a, b, c: F.when(copy, a).otherwise(F.col(b)).alias(c)
    cols = ["doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", "n_removed"), pick(F.lit(1).cast("long"), "n_spans", "n_spans"), pick(F.sha2(F.lit(b""), 256), "kept_sha256", "kept_sha256")]
    return out.select(*cols, *([pick(F.lit(b""), "kept", "kept")] if texts else []))
