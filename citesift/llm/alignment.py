"""Cross-tokenizer alignment by a dictionary of groups: tokens of two tokenizers over the same bytes, and corpus-wide link counts."""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, byte_views, discard, stage

#: Bytes of text that a worker aligns at a time, and units that it remembers.
BATCH_BYTES, REMEMBERED = 4 << 20, 250_000
#: Units that tokenizer A gets as one text.
UNITS_TOGETHER = 64
#: Groups of documents that a step works on at a time.
BATCH_GROUPS = 1 << 20
#: A group is looked up by broadcast if it has more than one in so many of all documents' groups; fewer groups than that can. Longer keys are joined.
HOT_GROUPS, HOT_BYTES = 20_000, 64


def _byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def group_key(a: list[int], b: list[int]) -> bytes:
    """A group's name: its ids, packed exactly. The number of A ids, then all ids, in two bytes each or in four behind a 255."""
    if len(a) < 255 and max(max(a), max(b)) < 1 << 16:
        return struct.pack(f"<B{len(a) + len(b)}H", len(a), *a, *b)
    return struct.pack(f"<BI{len(a) + len(b)}I", 255, len(a), *a, *b)


def key_ids(key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The A ids and B ids that a key names."""
    if key[0] < 255:
        n, ids = key[0], np.frombuffer(key, np.uint16, offset=1)
    else:
        n, ids = struct.unpack_from("<I", key, 1)[0], np.frombuffer(key, np.uint32, offset=5)
    return ids[:n].astype(np.int64), ids[n:].astype(np.int64)


def _plain(c: str) -> bool:
    """Not white space; characters that some tables count as white space and others don't are kept away from cuts."""
    return c != "" and not c.isspace() and c not in "\u180e\u200b\ufeff"


def _joined(values: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids' values as joined bytes, and the n + 1 offsets of the ids in them."""
    return byte_views(values.take(pa.array(ids)))


def _distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct row of numbers, and for each row the number of the place. Columns are packed into one number while they
    fit, and the packed ones numbered anew when they don't."""
    wide = max(1, int(rows.max(initial=0)).bit_length())
    held = np.zeros(len(rows), np.int64)
    used = 0
    for column in rows.T:
        if used + wide > 62:
            held = np.unique(held, return_inverse=True)[1]
            used = max(1, len(rows).bit_length())
        held, used = held << wide | column, used + wide
    _, places, which = np.unique(held, return_index=True, return_inverse=True)
    return places, which


class Aligner:
    """Both tokenizers, and what they make of the units met so far.

    A text (behind a space) is cut before every space that has no white space on either side. Neither tokenizer has tokens across
    such a place: A's words begin at it, and no piece of B has a space behind another character, which is checked. So the tokens of a text are those
    of its units one by one, and so are its groups, which never cross a cut."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        self.a, self.b = tokenizers.Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = _byte_of_letter()
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = np.zeros(max(self.a_bytes, default=0) + 1, np.int64), np.array([len(x) for x in self.b_bytes], np.int64)
        for i, x in self.a_bytes.items():
            self.a_sizes[i] = len(x)
        self.a_values, self.b_values = (pa.array(x, pa.large_binary()) for x in ([self.a_bytes.get(i, b"") for i in range(len(self.a_sizes))], self.b_bytes))
        self.cuts = type(self.a.pre_tokenizer).__name__ == "ByteLevel" and not any("▁" in p.lstrip("▁") for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        #: The groups of unit number k are at unit_at[k] to unit_at[k + 1] of the codes.
        self.unit_at, self.unit_codes = np.zeros(1, np.int64), np.zeros(0, np.int32)
        #: A tokens, B tokens, links, and whether the bytes differ from the text.
        self.unit_sizes = np.zeros((0, 4), np.int64)
        self.groups: dict[bytes, int] = {}
        self.group_keys: list[bytes] = []
        self.group_text: list[str] = []

    @property
    def unit_text(self) -> list[str]:
        """The groups of every unit, by name."""
        codes, text = self.unit_codes.tolist(), self.group_text
        return [";".join([text[c] for c in codes[s:e]]) for s, e in pairwise(self.unit_at.tolist())]

    def learn(self, units: list[str]) -> None:
        """Tokenize and group new units, each without the space before it."""
        if not units:
            return
        together = [_plain(u[:1]) and _plain(u[-1:]) for u in units] if self.cuts else [False] * len(units)
        units = [u for u, t in zip(units, together) if t] + [u for u, t in zip(units, together) if not t]
        whole = [f" {u}" for u in units]
        text = pa.array(whole, pa.large_string())
        data, ends = byte_views(text)
        text_sizes = np.diff(ends)
        a_ids, a_counts = self._a_tokens(whole, text_sizes, sum(together))
        b = self.b.encode(units, num_threads=1)
        b_counts = np.fromiter(map(len, b), np.int64, len(b))
        b_ids = np.fromiter(chain.from_iterable(b), np.int64, int(b_counts.sum()))
        good = self._same(a_ids, a_counts, self.a_values, self.a_sizes, data, text_sizes) & self._same(b_ids, b_counts, self.b_values, self.b_sizes, data, text_sizes)
        a_ids, b_ids = a_ids[np.repeat(good, a_counts)], b_ids[np.repeat(good, b_counts)]
        codes, per_unit, links = self._grouped(a_ids, b_ids, np.where(good, text_sizes, 0))
        self.units.update(zip(units, range(len(self.units), len(self.units) + len(units))))
        self.unit_at = np.append(self.unit_at, len(self.unit_codes) + np.cumsum(per_unit))
        self.unit_codes = np.append(self.unit_codes, codes.astype(np.int32))
        self.unit_sizes = np.concatenate([self.unit_sizes, np.stack([np.where(good, a_counts, 0), np.where(good, b_counts, 0), links, ~good], axis=1)])

    def _a_tokens(self, whole: list[str], sizes: np.ndarray, n_plain: int) -> tuple[np.ndarray, np.ndarray]:
        """A's tokens of all units, one after the other, and each unit's number of them. Of the first n_plain units, which begin and end with
        plain characters, many make one text, as no token goes across; if one does, or bytes differ, its units are taken one by one."""
        bounds = [*range(0, n_plain, UNITS_TOGETHER), *range(n_plain, len(whole) + 1)]
        texts = ["".join(whole[s:e]) for s, e in pairwise(bounds)]
        ids, counts = self._a_encoded(texts)
        at = np.append(0, np.cumsum(sizes))
        token_ends = np.cumsum(self.a_sizes[ids])
        have, want = np.append(0, token_ends)[np.append(0, np.cumsum(counts))], at[np.array(bounds)]
        if np.array_equal(have, want):
            last = np.searchsorted(token_ends, at[1:])
            if len(token_ends) and np.array_equal(token_ends[np.minimum(last, len(token_ends) - 1)], at[1:]):
                return ids, np.diff(np.append(0, last + 1))
        return self._a_encoded(whole)

    def _a_encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts

    @staticmethod
    def _same(ids: np.ndarray, counts: np.ndarray, values: pa.Array, token_sizes: np.ndarray, data: np.ndarray, text_sizes: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of each unit's tokens are its text."""
        at = np.concatenate([[0], np.cumsum(counts)])
        sizes = np.diff(np.concatenate([[0], np.cumsum(token_sizes[ids])])[at])
        fits = sizes == text_sizes
        joined, text = _joined(values, ids[np.repeat(fits, counts)])[0], data[np.repeat(fits, text_sizes)]
        wrong = np.searchsorted(np.cumsum(sizes[fits]), np.flatnonzero(joined != text), side="right")
        fits[np.flatnonzero(fits)[np.unique(wrong)]] = False
        return fits

    def _grouped(self, a: np.ndarray, b: np.ndarray, text_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes of all groups of units one after the other, each unit's number of groups, and of links."""
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_last, b_last = np.searchsorted(a_ends, both), np.searchsorted(b_ends, both)
        a_first, b_first = (np.concatenate([[0], x[:-1] + 1]) if len(x) else x for x in (a_last, b_last))
        n_a, n_b = a_last - a_first + 1, b_last - b_first + 1
        of = np.searchsorted(np.cumsum(text_sizes), both)
        per_unit, links = np.bincount(of, minlength=len(text_sizes)), np.bincount(of, n_a * n_b, len(text_sizes)).astype(np.int64)
        codes = np.zeros(len(both), np.int64)
        # Groups of few tokens are most; those of one shape are told apart as rows of numbers, the others by their names.
        shape = np.where((n_a < 16) & (n_b < 16), n_a << 4 | n_b, 0)
        for kind in np.unique(shape).tolist():
            here = np.flatnonzero(shape == kind)
            if kind:
                rows = np.concatenate([a[a_first[here, None] + np.arange(kind >> 4)], b[b_first[here, None] + np.arange(kind & 15)]], axis=1)
                places, which = _distinct_rows(rows)
                codes[here] = np.array([self._code(r[: kind >> 4], r[kind >> 4 :]) for r in rows[places].tolist()], np.int64)[which]
            else:
                codes[here] = [self._code(a[s : e + 1].tolist(), b[u : v + 1].tolist()) for s, e, u, v in zip(*(x[here].tolist() for x in (a_first, a_last, b_first, b_last)))]
        return codes, per_unit, links

    def _code(self, a: list[int], b: list[int]) -> int:
        key = group_key(a, b)
        code = self.groups.get(key)
        if code is None:
            code = self.groups[key] = len(self.group_keys)
            self.group_keys.append(key)
            self.group_text.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
        return code

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The units of all texts in order as numbers into a list of distinct ones, and the n + 1 unit offsets of the texts."""
        if not self.cuts:
            distinct = texts.dictionary_encode()
            return distinct.indices.to_numpy(), np.arange(len(texts) + 1), distinct.dictionary.to_pylist()
        split = pc.split_pattern(texts, " ")
        offsets, words = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
        offsets, codes, names = offsets - offsets[0], words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        heads, tails = [w[:1] for w in names], [w[-1:] for w in names]
        plain = {c: _plain(c) for c in {*heads, *tails}}
        opens, closes = np.array([plain[c] for c in heads], bool), np.array([plain[c] for c in tails], bool)
        first = np.zeros(len(codes), bool)
        first[offsets[:-1]] = True
        starts = first.copy()
        starts[1:] |= closes[codes[:-1]] & opens[codes[1:]]
        starts = np.flatnonzero(starts)
        ends = np.append(starts[1:], len(codes))
        units, more = codes[starts], {}
        for k in np.flatnonzero(ends - starts > 1).tolist():
            joined = " ".join([names[c] for c in codes[starts[k] : ends[k]].tolist()])
            units[k] = more.setdefault(joined, len(names) + len(more))
        return units, np.searchsorted(starts, offsets), [*names, *more]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's own, which later tasks use again."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values between offsets."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def _aligned(aligner: Aligner, batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column("text").fill_null("")
    n = len(texts)
    units, at, names = aligner.cut(texts)
    at = at.copy()
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    used, units = np.unique(units, return_inverse=True)
    used = [names[u] for u in used.tolist()]
    aligner.learn([u for u in used if u not in aligner.units])
    ids = np.fromiter(map(aligner.units.__getitem__, used), np.int64, len(used))
    sizes, first, n_groups = aligner.unit_sizes[ids], aligner.unit_at[ids], np.diff(aligner.unit_at)[ids]
    bad = (_per_text(sizes[units, 3], at) > 0) | empty
    # Every text's groups, with how often each occurs in it.
    text_of = np.repeat(np.arange(n), np.diff(at))
    kept = ~bad[text_of]
    occurrences = aligner.unit_codes[_spread(first[units[kept]], n_groups[units[kept]])].astype(np.int64)
    pairs, often = np.unique(np.repeat(text_of[kept], n_groups[units[kept]]) << 32 | occurrences, return_counts=True)
    codes, which = np.unique(pairs & 0xFFFFFFFF, return_inverse=True)
    offsets = np.searchsorted(pairs >> 32, np.arange(n + 1))
    keys = pa.array([aligner.group_keys[c] for c in codes.tolist()], pa.binary()).take(pa.array(which, pa.int64()))
    counts = [np.where(bad, 0, _per_text(x[units], at)) for x in (sizes[:, 0], sizes[:, 1], n_groups, sizes[:, 2])]
    named, ends = _joined(pa.array([f"{t};".encode() for t in aligner.group_text], pa.large_binary()), occurrences)
    ends, view = ends[np.append(0, np.cumsum(counts[2]))].tolist(), memoryview(named)
    shas = ["" if b else hashlib.sha256(view[s : e - 1]).hexdigest() for b, s, e in zip(bad.tolist(), ends, ends[1:])]
    lists = lambda values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    return pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), *map(pa.array, counts), pa.array(shas, pa.string()), lists(keys), lists(pa.array(often, pa.int32()))], names=[
        "_row", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "often"])


def _align_batches(a_path: str, b_path: str) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for batch in batches_of(it, "text", BATCH_BYTES):
            yield _aligned(aligner, batch)
            if len(aligner.units) > REMEMBERED:
                aligner.forget()

    return run


def _some_groups(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Parts of the batches with their keys and the n + 1 key offsets of their texts."""
    for whole in it:
        ends = whole.column("keys").offsets.to_numpy().astype(np.int64)
        at = 0
        while at < whole.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_GROUPS, side="right")) - 1)
            part = whole.slice(at, end - at)
            yield part, whole.column("keys").values[ends[at] : ends[end]], ends[at : end + 1] - ends[at]
            at = end


def _links(key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct links of a group (A id above 32 bits, B id below) and how often each occurs in it."""
    a, b = (np.unique(x, return_counts=True) for x in key_ids(key))
    return (a[0][:, None] << 32 | b[0][None, :]).ravel(), (a[1][:, None] * b[1][None, :]).ravel()


def _count_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): documents of each group; (null, a, b, n): how often too much a link is counted if its groups' documents are summed,
    as a document may hold it in several groups."""
    for _, keys, offsets in _some_groups(it):
        named = keys.dictionary_encode()
        codes, names = named.indices.to_numpy().astype(np.int64), named.dictionary
        links = [_links(k)[0] for k in names.to_pylist()]
        n_links = np.array([len(x) for x in links], np.int64)
        pairs, flat = np.unique(np.concatenate(links) if links else np.zeros(0, np.int64), return_inverse=True)
        held = flat[_spread((np.cumsum(n_links) - n_links)[codes], n_links[codes])]
        where = np.repeat(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), n_links[codes])
        both, times = np.unique(where * max(len(pairs), 1) + held, return_counts=True)
        over = np.bincount(both % max(len(pairs), 1), times - 1, len(pairs)).astype(np.int64)
        twice = np.flatnonzero(over)
        empty = pa.nulls(len(twice), pa.binary())
        none = pa.nulls(len(names), pa.int32())
        yield pa.RecordBatch.from_arrays([names, none, none, pa.array(np.bincount(codes, minlength=len(names)))], ["key", "a", "b", "n"])
        yield pa.RecordBatch.from_arrays([empty, pa.array((pairs[twice] >> 32).astype(np.int32)), pa.array((pairs[twice] & 0xFFFFFFFF).astype(np.int32)), pa.array(over[twice])], ["key", "a", "b", "n"])


def _expand_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, a, b, times, documents): the links of each distinct group."""
    for whole in it:
        for at in range(0, whole.num_rows, 1 << 14):
            batch = whole.slice(at, 1 << 14)
            links = [_links(k) for k in batch.column("key").to_pylist()]
            sizes = np.array([len(x[0]) for x in links], np.int64)
            pairs, times = (np.concatenate([x[i] for x in links]) for i in (0, 1))
            of = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(of), pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(times), batch.column("documents").take(of)],
                ["key", "a", "b", "times", "documents"],
            )


def _look_up_batches(shared) -> Callable:
    """A row for each document with what its hot groups add up to, and a row for each other group of it."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, best, total = shared.value
        value_set = pa.array(hot, pa.binary())
        for part, keys, offsets in _some_groups(it):
            n = part.num_rows
            often = part.column("often").flatten().to_numpy().astype(np.int64)
            place = pc.index_in(keys, value_set=value_set)
            cold = place.is_null().to_numpy(zero_copy_only=False)
            place = place.fill_null(0).to_numpy()
            take = lambda values: np.where(cold, 0, values[place]) * often if len(values) else np.zeros(len(often), np.int64)  # noqa: B023, E731
            of = pa.array(np.repeat(np.arange(n), np.diff(offsets))[cold])
            docs = [part.column(x) for x in ("_row", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            names = [*(x for x in ("_row", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), "key", "often", "n_best", "count_sum"]
            yield pa.RecordBatch.from_arrays([*docs, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(_per_text(take(best), offsets)), pa.array(_per_text(take(total), offsets))], names)
            m = len(of)
            yield pa.RecordBatch.from_arrays(
                [docs[0].take(of), *(pa.nulls(m, x.type) for x in docs[1:]), keys.filter(pa.array(cold)), pa.array(often[cold]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)

    return run


@dataclass(frozen=True)
class Alignment:
    """documents: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; groups: every distinct group's key (see key_ids), documents,
    n_best, count_sum; links: a, b, documents (that hold the link), best (no B id of this A id is held by more)."""

    documents: DataFrame
    groups: DataFrame
    links: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> Alignment:
    """Align the tokens of every whole text, behind a space, by a byte-level tokenizer A (tokenizers, JSON) and a piece tokenizer B
    (sentencepiece), without special tokens. The paths are local to every executor.

    Byte offsets where tokens of both end cut them into groups; all A and B tokens of a group are linked. A text that
    either tokenizer doesn't give back byte for byte, a null one and an empty one have no tokens and zeros.

    Distinct groups are interned by their exact ids; a group's links are expanded once, its documents stand for each of them (less those that hold the
    link in another group, too), and its sums go back to the documents by its key: by broadcast for the fewer than HOT_GROUPS
    most frequent groups, for the others by a join. Rows that repeat an id are documents of their own. An empty table gives
    empty tables. Only the two columns are read, so others may have any name."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    heads = f"_row long, _id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    texts = stage(rows.mapInArrow(_align_batches(a_path, b_path), f"{heads}, keys array<binary>, often array<int>"), "aligned")

    counts = stage(texts.select("keys").mapInArrow(_count_batches, "key binary, a int, b int, n long").groupBy("key", "a", "b").agg(F.sum("n").alias("n")), "group-counts")
    distinct = counts.filter("key is not null").select("key", F.col("n").alias("documents"))
    expanded = stage(distinct.mapInArrow(_expand_batches, "key binary, a int, b int, times long, documents long"), "group-links")
    over = counts.filter("key is null").select("a", "b", (-F.col("n")).alias("documents"))
    held = expanded.select("a", "b", "documents").unionByName(over).groupBy("a", "b").agg(F.sum("documents").alias("documents"))
    links = stage(held.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy("a"))), "links")
    known = expanded.withColumnRenamed("documents", "_of").join(links, ["a", "b"])
    sums = known.groupBy("key").agg(
        F.max("_of").alias("documents"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum")
    )
    groups = stage(sums, "groups")

    total = groups.agg(F.sum("documents")).first()[0] or 0
    hot = groups.filter((F.col("documents") > total // HOT_GROUPS) & (F.octet_length("key") <= HOT_BYTES)).select("key", "n_best", "count_sum").toArrow()
    columns = (hot.column("key").to_pylist(), *(hot.column(x).to_numpy().astype(np.int64) for x in ("n_best", "count_sum")))
    shared = docs.sparkSession.sparkContext.broadcast(columns)
    looked = stage(texts.mapInArrow(_look_up_batches(shared), f"{heads}, key binary, often long, n_best long, count_sum long"), "looked-up")
    cold = looked.filter("key is not null").select("_row", "key", "often").join(groups.select("key", "n_best", "count_sum"), "key")
    cold = cold.groupBy("_row").agg(F.sum(F.col("often") * F.col("n_best")).alias("_best"), F.sum(F.col("often") * F.col("count_sum")).alias("_sum"))
    both = looked.filter("key is null").join(cold, "_row", "left")
    sum_of = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    out = both.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", sum_of("n_best", "_best"), sum_of("count_sum", "_sum"), "groups_sha256")
    done = stage(out, "alignment")
    discard(texts, counts, expanded, looked)
    return Alignment(done, groups, links)
