"""Byte-level BPE encoding and decoding on padded numpy matrices.

Each distinct piece of a text is a row of bytes. Rows of similar length share
a matrix; in every round each row merges its leftmost pair of lowest rank,
found in a hashed pair table, and the matrix is compacted. Rows without a
mergeable pair leave the matrix.

Defined results for odd input: null and empty text give no ids; repeated rows
give repeated rows; extra columns are passed by or ignored, as named below.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters and numbers added after Unicode 16, the version by which
# the compared library splits; the regex module already counts them as such.
_AFTER_UNICODE_16 = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    "\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)

_NONE = np.int32(2**31 - 1)
_SHIFT = np.uint64(16)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> bytes:
    """Content of a rank file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return f.read()


class BytePairCoder:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks: bytes, pattern: str, keep: int = 200_000, matrix_bytes: int = 1 << 20, long_piece: int = 512):
        self.tokens: dict[bytes, int] = {}
        for line in ranks.splitlines():
            if line.strip():
                token, rank = line.split()
                self.tokens[base64.b64decode(token)] = int(rank)
        self.bytes_of = {i: t for t, i in self.tokens.items()}
        self.pattern = regex.compile(pattern)
        parts = [p for p in regex.split(r"(\[\^\\s\\p\{L\}\\p\{N\}\]|\\p\{[LN]\})", pattern) if p]
        older = [f"[{p}||[{_AFTER_UNICODE_16}]]" if p.startswith("[^") else f"[{p}--[{_AFTER_UNICODE_16}]]" if regex.fullmatch(r"\\p\{[LN]\}", p) else p for p in parts]
        self.older_pattern = regex.compile("".join(older), regex.V1)
        self.newer = regex.compile(f"[{_AFTER_UNICODE_16}]")
        self.keep, self.matrix_bytes, self.long_piece = keep, matrix_bytes, long_piece
        self.single = np.full(256, -1, dtype=np.int32)
        for value in range(256):
            self.single[value] = self.tokens[bytes([value])]
        self._build_pairs()
        self._cache: dict[str, tuple[str, bytes, int, bytes]] = {}

    def _build_pairs(self) -> None:
        get = self.tokens.get
        left, right, rank = [], [], []
        for token, merged in self.tokens.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(merged)
        keys = (np.array(left, dtype=np.uint64) << np.uint64(32)) | np.array(right, dtype=np.uint64)
        bits = max(10, int(len(keys) * 4).bit_length())
        self._mask = np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, np.uint64(2**64 - 1), dtype=np.uint64)
        self._ranks = np.full(1 << bits, _NONE, dtype=np.int32)
        values, todo = np.array(rank, dtype=np.int32), np.arange(len(keys))
        slot = self._slots(keys)
        while len(todo):
            free = self._keys[slot[todo]] == np.uint64(2**64 - 1)
            seats, first = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free][first]
            self._keys[seats] = keys[placed]
            self._ranks[seats] = values[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self._mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _FACTOR) >> np.uint64(30)).astype(np.int64) & self._mask

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE; -1 (padding) pairs with nothing."""
        out = np.full(a.shape, _NONE, dtype=np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        keys = (a[todo].astype(np.uint64) << np.uint64(32)) | b[todo].astype(np.uint64)
        slot = self._slots(keys)
        while len(todo):
            there = self._keys[slot]
            hit = there == keys
            out[todo[hit]] = self._ranks[slot[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & self._mask
        return out

    def _merge_matrix(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yield (row numbers, padded ids) as rows come to rest."""
        rows = np.arange(len(ids))
        ranks = self._pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                yield rows[done], ids[done]
                live = ~done
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
                if not len(rows):
                    return
            n, width = ids.shape
            each = np.arange(n)
            columns = np.arange(width - 1)
            moved = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            moved[each, at] = best
            if width == 2:
                yield rows, moved
                return
            columns = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            inner = at < width - 2
            ranks[each[inner], at[inner]] = self._pair_ranks(moved[each[inner], at[inner]], moved[each[inner], at[inner] + 1])
            outer = at > 0
            ranks[each[outer], at[outer] - 1] = self._pair_ranks(moved[each[outer], at[outer] - 1], moved[each[outer], at[outer]])
            ids = moved

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one very long piece, by a heap over a linked list."""
        ids = [int(self.single[b]) for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        bytes_of, get, alive = self.bytes_of, self.tokens.get, [True] * len(ids)

        def rank(i: int):
            j = after[i]
            return get(bytes_of[ids[i]] + bytes_of[ids[j]]) if j < len(ids) else None

        heap = [(r, i) for i in range(len(ids)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank(i) != r:
                continue
            j = after[i]
            ids[i], alive[j] = r, False
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (new := rank(k)) is not None:
                    heapq.heappush(heap, (new, k))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; a piece that is itself a token is that token."""
        out: list[list[int] | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            token = self.tokens.get(piece)
            if token is not None:
                out[k] = [token]
            elif len(piece) > self.long_piece:
                out[k] = self._merge_long(piece)
            elif piece:
                buckets.setdefault((len(piece) + 3) // 4 * 4, []).append(k)
            else:
                out[k] = []
        for width, members in buckets.items():
            step = max(1, self.matrix_bytes // (8 * width))
            for start in range(0, len(members), step):
                part = members[start : start + step]
                raw = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in part), dtype=np.uint8).reshape(len(part), width)
                lengths = np.array([len(pieces[k]) for k in part])
                ids = np.where(np.arange(width) < lengths[:, None], self.single[raw], np.int32(-1))
                for rows, rest in self._merge_matrix(ids):
                    for row, values, n in zip(rows.tolist(), rest.tolist(), (rest >= 0).sum(axis=1).tolist(), strict=True):
                        out[part[row]] = values[:n]
        return out

    def decode_ids(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.newer.search(text):
                return self.older_pattern.findall(text)
        return self.pattern.findall(text)

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.encode_pieces([p.encode() for p in self.split(text or "")]) for i in ids]

    def _learn(self, chunk: list[list[str]]) -> None:
        if len(self._cache) > self.keep:
            self._cache.clear()
        cache = self._cache
        new = list({p for pieces in chunk for p in pieces if p not in cache})
        for piece, ids in zip(new, self.encode_pieces([p.encode() for p in new]), strict=True):
            cache[piece] = (" ".join(map(str, ids)), self.decode_ids(ids), len(ids), np.array(ids, dtype=np.int32).tobytes())

    def chunks(self, texts: list[str | None], most_chars: int = 2_000_000) -> Iterator[list[list[str]]]:
        held, size = [], 0
        for text in texts:
            held.append(self.split(text or ""))
            size += len(text or "")
            if size >= most_chars:
                yield held
                held, size = [], 0
        if held:
            yield held

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, sha256 of the ids' decimal text, sha256 of the decoded bytes) of each text."""
        for chunk in self.chunks(texts):
            self._learn(chunk)
            get = self._cache.__getitem__
            for pieces in chunk:
                found = list(map(get, pieces))
                ids = " ".join([x[0] for x in found])
                decoded = b"".join([x[1] for x in found])
                yield sum([x[2] for x in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    def packed(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as packed int32, bytes decoded from them) of each text."""
        for chunk in self.chunks(texts):
            self._learn(chunk)
            get = self._cache.__getitem__
            for pieces in chunk:
                found = list(map(get, pieces))
                yield b"".join([x[3] for x in found]), b"".join([x[1] for x in found])


_coders: dict[tuple[int, str], BytePairCoder] = {}


def _coder(ranks, pattern: str) -> BytePairCoder:
    """One coder for each Python worker."""
    key = (hash(ranks.value), pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = BytePairCoder(ranks.value, pattern)
    return _coders[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns of ``keep``, n_tokens long, ids array<int>, round_trip boolean) for every row.

    Null text gives an empty array; ``round_trip`` tells whether the ids
    decode to the bytes of the text.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = docs.select(F.struct(id_col, *keep).alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        coder = _coder(ranks, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids, same = [], []
            for text, (packed, decoded) in zip(texts, coder.packed(texts), strict=True):
                ids.append(packed)
                same.append(decoded == (text or "").encode())
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n), lists, pa.array(same, pa.bool_())], ["row", "n_tokens", "ids", "round_trip"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, n_tokens long, ids array<int>, round_trip boolean").select("row.*", "n_tokens", "ids", "round_trip")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes of each row's ids; null ids give no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        coder = _coder(ranks, pattern)
        for batch in batches:
            data = [coder.decode_ids(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(data, pa.binary())], ["id", "data"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, data binary").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids_sha256, decoded_sha256) of encoding and decoding every row.

    The digests are made beside the coder, so that ids don't travel between processes.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        coder = _coder(ranks, pattern)
        for batch in batches:
            found = list(coder.digests(batch.column("text").to_pylist()))
            n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
