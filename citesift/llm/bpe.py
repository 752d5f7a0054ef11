"""Byte-level BPE: encoding by a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, byte_views, text_bytes, worker_cache

#: Transitions and words held in memory before they are built anew.
MAX_TRANSITIONS, MAX_WORDS = 400_000, 80_000
#: Places of a piece that wait at most, before the sure tokens are emitted; well above the longest token.
MAX_HELD = 4096
#: Longest piece in characters that is remembered and led through the transducer beside others; bytes of such pieces at a time.
MAX_WORD, TOGETHER_BYTES = 64, 1 << 18
#: Places of the array in front of the transitions' dictionary, as a power of two.
_PLACES = 20
_NEVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of a piece by the definition: merge the leftmost pair of lowest rank until none has a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == _NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that the last merge of a token joins."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == _NEVER:
            raise ValueError(f"merges don't rebuild the token {token!r}")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Transducer:
    """Merges compiled to a finite-state transducer from bytes to tokens.

    The tokens of a prefix are fixed by its last token: a token may follow another exactly if the two, merged alone,
    stay as they are. A hypothesis is a place where a token may begin: its node in the trie of tokens, and the token that
    ends before it. A state is the set of open hypotheses, whatever came before them, so that states recur in unlike
    words. A byte moves all of them and closes the one token that may end here. The token that each place closes leads
    back to the place before it; tokens are emitted when all open hypotheses lead back to one place. Lookahead is
    bounded by the longest token. States and transitions are made when first met.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        # The trie of tokens: node << 8 | byte gives the next node; inner nodes have children.
        self.trie: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.inner: list[bool] = [True]
        self.deep: list[int] = [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                self.inner[node] = True
                child = self.trie.get(node << 8 | b)
                if child is None:
                    child = self.trie[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                    self.deep.append(self.deep[node] + 1)
                node = child
            self.ends[node] = rank
        self.edges: dict[int, tuple] = {}
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        # A hypothesis is node << 32 | token + 1. The newest comes last: it begins here, after the token closed here.
        self.states: list[tuple[int, ...]] = [(0,)]
        self.number: dict[tuple[int, ...], int] = {(0,): 0}
        self.closed: list[int] = [-1]
        #: state << 8 | byte to the next state.
        self.delta: dict[int, int] = {}
        #: Transitions met last, one at each place: the key, and next state << 32 | token closed there.
        self.met = np.full(1 << _PLACES, -1, np.int64)
        self.met_to = np.zeros(1 << _PLACES, np.int64)

    def _edges(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """Parts that stand at the token's right and at its left edge while merges rebuild it, each with the rank of
        the merge that takes it in."""
        known = self.edges.get(token)
        if known is None:
            data = self.tokens[token]
            right, left = [(data, _NEVER)], [(data, _NEVER)]
            if len(data) > 1:
                a, b = last_merge(data, self.ranks)
                right += [(p, min(d, token)) for p, d in self._edges(self.ranks[b])[0]]
                left += [(p, min(d, token)) for p, d in self._edges(self.ranks[a])[1]]
            known = self.edges[token] = (right, left)
        return known

    def follows(self, a: int, b: int) -> bool:
        """No merge joins a part at the right edge of a with one at the left edge of b while both stand.

        Of merges of one rank the leftmost goes first: the merge inside a before the one across, that before b's."""
        if a < 0:
            return True
        known = self.fits.get(a << 32 | b)
        if known is None:
            if len(self.fits) > MAX_TRANSITIONS // 2:
                self.fits.clear()
            known = self.fits[a << 32 | b] = self._apart(self._edges(a)[0], self._edges(b)[1])
        return known

    def _apart(self, right: list[tuple[bytes, int]], left: list[tuple[bytes, int]]) -> bool:
        rank = self.ranks.get
        for x, x_until in right:
            for y, y_until in left:
                r = rank(x + y)
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def _step(self, state: int, byte: int) -> int:
        moved, closed = [], -1
        child, inner, ends = self.trie.get, self.inner, self.ends
        for hypothesis in self.states[state]:
            to = child(hypothesis >> 32 << 8 | byte)
            if to is not None:
                before = hypothesis & 0xFFFFFFFF
                if inner[to]:
                    moved.append(to << 32 | before)
                if closed < 0:
                    end = ends[to]
                    if end >= 0 and self.follows(before - 1, end):
                        closed = end
        if closed < 0:
            raise ValueError("the vocabulary lacks a single byte")
        moved.append(closed + 1)
        key = tuple(moved)
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
            self.closed.append(closed)
        self.delta[state << 8 | byte] = at
        return at

    def _back(self, tokens: list[int], end: int) -> list[int]:
        """The tokens that lead back from a place, the last one first."""
        out, length = [], self.length
        while end > 0:
            t = tokens[end - 1]
            out.append(t)
            end -= length[t]
        return out

    def _sure(self, state: int, tokens: list[int]) -> int:
        """The last place that all open hypotheses lead back to."""
        common: set[int] | None = None
        for hypothesis in self.states[state]:
            end = len(tokens) - self.deep[hypothesis >> 32]
            places = {end}
            for t in self._back(tokens, end):
                end -= self.length[t]
                places.add(end)
            common = places if common is None else common & places
        return max(common or {0})

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one piece; a piece that is a token is that token."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        if len(self.delta) > MAX_TRANSITIONS:
            self.reset()
        out: list[int] = []
        tokens: list[int] = []  # the token closed at each place that isn't emitted yet
        state, known, closed = 0, self.delta.get, self.closed
        for byte in piece:
            to = known(state << 8 | byte)
            state = self._step(state, byte) if to is None else to
            tokens.append(closed[state])
            if len(tokens) == MAX_HELD:
                sure = self._sure(state, tokens)
                out += self._back(tokens, sure)[::-1]
                del tokens[:sure]
        return (*out, *self._back(tokens, len(tokens))[::-1])

    def _moved(self, keys: np.ndarray) -> np.ndarray:
        """next state << 32 | token closed there, for each state << 8 | byte."""
        place = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _PLACES)).view(np.int64)
        to = self.met_to[place]
        new = np.flatnonzero(self.met[place] != keys)
        if len(new):
            distinct, which = np.unique(keys[new], return_inverse=True)
            known, closed, found = self.delta.get, self.closed, []
            for key in distinct.tolist():
                state = known(key)
                state = self._step(key >> 8, key & 255) if state is None else state
                found.append(state << 32 | closed[state])
            to[new] = np.array(found, np.int64)[which]
            self.met[place[new]], self.met_to[place[new]] = keys[new], to[new]
        return to

    def encode_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces, one after the other, and each piece's number of them. No piece is empty.

        All pieces go through the transducer side by side, a byte of each at a time, the longest first in order, so
        that those with a byte left are at the front."""
        if len(self.delta) > MAX_TRANSITIONS:
            self.reset()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        first, falling = starts[order], -sizes[order]
        closed, state = np.zeros(len(data), np.int64), np.zeros(len(pieces), np.int64)
        for at in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(falling, -at, side="left"))
            places = first[:n] + at
            to = self._moved(state[:n] << 8 | data[places])
            closed[places] = to & 0xFFFFFFFF
            state = to >> 32
        # From every piece's end back to its start: the tokens that stay.
        stays = np.zeros(len(data), bool)
        starts, ends = starts.copy(), starts + sizes
        while len(ends):
            stays[ends - 1] = True
            ends = ends - self.lengths[closed[ends - 1]]
            left = ends > starts
            starts, ends = starts[left], ends[left]
        whole = {k: self.ranks[p] for k, p in enumerate(pieces) if p in self.ranks}
        firsts = np.cumsum(sizes) - sizes
        for k, rank in whole.items():
            at, end = int(firsts[k]), int(firsts[k] + sizes[k])
            stays[at:end], closed[end - 1] = False, rank
            stays[end - 1] = True
        return closed[stays].astype(np.int32), np.add.reduceat(stays, firsts, dtype=np.int64) if len(firsts) else sizes


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The pattern with the letters, numbers and white space among the first 256 characters written out, so that the
    standard library's faster engine matches texts of these characters alike; None if it holds other escapes."""
    def members(kind: str) -> str:
        some = (c for c in map(chr, range(256)) if (c in "\t\n\v\f\r \x85\xa0" if kind == "s" else unicodedata.category(c)[0] == kind))
        return "".join(map(re.escape, some))

    known = {r"\p{L}": members("L"), r"\p{N}": members("N"), r"\s": members("s")}
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if part in known:
            part = known[part] if inside else f"[{known[part]}]"
        elif part == r"\S" and not inside:
            part = f"[^{known[chr(92) + 's']}]"
        elif part[0] == "\\" and part[1:] not in ("r", "n", "t"):
            return None
        inside = part == "[" or inside and part != "]"
        out.append(part)
    return re.compile("".join(out))


class Encoder:
    """Texts to token ids: pieces by the pattern, each distinct one through the transducer; those met are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.any_pieces = regex.compile(pattern).findall
        latin = latin_pattern(pattern)
        self.latin_pieces = latin.findall if latin else None
        self.forget()

    def forget(self) -> None:
        #: A piece's number; the tokens of number k begin at starts[k] of all tokens and end at starts[k + 1].
        self.known: dict[str, int] = {}
        self.starts, self.tokens = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def pieces(self, text: str) -> list[str]:
        if self.latin_pieces:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.any_pieces(text)
            return self.latin_pieces(text)
        return self.any_pieces(text)

    def _add(self, pieces: list[str], tokens: np.ndarray, counts: np.ndarray) -> None:
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.starts = np.append(self.starts, len(self.tokens) + np.cumsum(counts))
        self.tokens = np.append(self.tokens, tokens)

    def _learn(self, pieces: list[str]) -> None:
        """Remember the tokens of new pieces, at most MAX_WORD characters each, in parts of bounded size."""
        data = [p.encode() for p in pieces]
        part = (np.cumsum(np.fromiter(map(len, data), np.int64, len(data))) - 1) // TOGETHER_BYTES
        at = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist() if len(part) else []
        for s, e in zip(at, at[1:]):
            self._add(pieces[s:e], *self.transducer.encode_together(data[s:e]))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the n + 1 offsets of the texts in them."""
        if len(self.known) > MAX_WORDS:
            self.forget()
        cut = [self.pieces(t) for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.known)
        long = [p for p in new if len(p) > MAX_WORD]
        self._learn(list(new.difference(long)) if long else list(new))
        if long:
            found = [self.transducer.encode(p.encode()) for p in long]
            before = self.starts, self.tokens
            counts = np.fromiter(map(len, found), np.int64, len(found))
            self._add(long, np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts)
        n_pieces = np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(n_pieces.sum()))
        starts, sizes = self.starts[numbers], np.diff(self.starts)[numbers]
        ends = np.append(0, np.cumsum(sizes))
        ids = self.tokens[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
        if long:
            for p in long:
                del self.known[p]
            self.starts, self.tokens = before
        return ids, ends[np.append(0, np.cumsum(n_pieces))]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


class Utf8Stream:
    """Incremental UTF-8: takes bytes in any cuts, gives text as soon as its characters are complete.

    The state is the bytes of the character begun last, at most three. Ill-formed bytes give U+FFFD as Python's
    replacing decoder does."""

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    def _begun(data: bytes) -> int:
        """Length of the incomplete but so far well-formed character at the end."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
            if need <= back:
                return 0
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
            return back if back == 1 or low <= data[-back + 1] <= high else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        n = self._begun(data)
        self.open = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def decode_bytes(data: memoryview, step: int = 1 << 16) -> Iterator[str]:
    """The text of tokens' joined bytes, piece by piece."""
    stream = Utf8Stream()
    for at in range(0, len(data), step):
        yield stream.feed(bytes(data[at : at + step]))
    yield stream.close()


def _joined(values: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> Iterator[memoryview]:
    """The joined bytes of the ids' values between offsets."""
    data, ends = byte_views(values.take(pa.array(ids)))
    view = memoryview(data)
    return (view[s:e] for s, e in pairwise(ends[offsets].tolist()))


def decode_stream(ids: Iterable[int], tokens: dict[int, bytes], step: int = 4096) -> Iterator[str]:
    """The text of token ids, piece by piece, without waiting for the end."""
    stream, ids = Utf8Stream(), iter(ids)
    while part := b"".join(map(tokens.__getitem__, islice(ids, step))):
        yield stream.feed(part)
    yield stream.close()


_ENCODERS: dict[tuple[int, int, str], Encoder] = worker_cache("bpe")


def _encoder(ranks: dict[bytes, int], key: int, pattern: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task with the states and pieces it knows."""
    at = (key, len(ranks), pattern)
    if at not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[at] = Encoder(ranks, pattern)
    return _ENCODERS[at]


def _ranks_column(spark: SparkSession, path: str):
    """The vocabulary, read by the driver and sent once to each executor: some hundred KB, whatever the corpus."""
    return spark.sparkContext.broadcast(load_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row. Null and empty texts have no ids; texts are taken whole."""
    ranks = _ranks_column(docs.sparkSession, path)
    key = zlib.crc32(repr(sorted(ranks.value.items())).encode())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, key, pattern)
        for batch in batches_of(it, "_text", 1 << 20, "bpe"):
            ids, offsets = encoder.encode_all([t.decode("utf-8", "replace") for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])

    slim = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("_text"))
    return slim.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids count as none; an id outside the vocabulary fails the query."""
    ranks = _ranks_column(encoded.sparkSession, path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in ranks.value.items()}
        for batch in it:
            texts = ["".join(decode_stream(ids or (), tokens)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The ids digest is that of decimal ids joined by commas; the decoded digest that of the bytes, which equal the
    text's. Null texts count as empty: no tokens, digests of nothing. Repeated rows give repeated rows, an empty table
    none. Texts are taken whole, however long; a batch holds about 1 MB of them or a single longer one. Only the id and
    text columns are read, so further columns may have any name."""
    ranks = _ranks_column(docs.sparkSession, path)
    key = zlib.crc32(repr(sorted(ranks.value.items())).encode())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, key, pattern)
        ids_of = range(max(encoder.transducer.tokens, default=-1) + 1)
        names = pa.array([f"{i},".encode() for i in ids_of], pa.large_binary())
        tokens = pa.array([encoder.transducer.tokens.get(i, b"") for i in ids_of], pa.large_binary())
        for batch in batches_of(it, "_text", 1 << 20, "bpe"):
            ids, at = encoder.encode_all([t.decode("utf-8", "replace") for t in batch.column("_text").to_pylist()])
            n, a, b = np.diff(at), [], []
            for name, data in zip(_joined(names, ids, at), _joined(tokens, ids, at)):
                a.append(hashlib.sha256(name[:-1]).hexdigest())
                done = hashlib.sha256()
                for text in decode_bytes(data):
                    done.update(text.encode())
                b.append(done.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("_text"))
    return slim.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
