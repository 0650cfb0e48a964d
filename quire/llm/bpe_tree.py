"""Byte-level BPE encoding and decoding by a monoid tree reduction.

``encode`` halves a piece until a half is small, encodes the halves, and joins neighbours: the tokens next to
the seam are re-encoded in a window that grows until the tokens outside it provably stay.  The proof is the
pair rule of byte-pair encodings: where every token of the vocabulary encodes to itself, a token sequence is
the encoding of its bytes if and only if each two neighbours are the encoding of their own bytes.  So a window
may stop growing as soon as its first and last token agree with the token just outside.

A text is first divided into the matches of the vocabulary's pattern, which are encoded separately; texts are
concatenations of their pieces, so decoding joins token bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A piece of up to this many bytes is merged directly, without halving.
LEAF_BYTES = 8
#: Entries of each generation of a worker's caches of encoded units and of compared token pairs.
CACHE_ENTRIES = 100_000
#: Ids that one leaf of the decoding tree covers.
DECODE_LEAF = 4096

#: Units that no match of the pattern crosses: a run of non-space with one space before it, or white space.
_UNITS = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
#: Python counts these as white space, the pattern does not; texts with them go through the pattern alone.
_ODD_SPACE = re.compile("[\x1c-\x1f]").search


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Recent:
    """A bounded cache of two generations: what was used since the last change of generation stays."""

    def __init__(self, entries: int):
        self.entries, self.young, self.old = entries, {}, {}

    def get(self, key):
        if (value := self.young.get(key)) is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        self.young[key] = value


class TreeBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        #: The length of the longest token that begins with four given bytes.
        self.longest: dict[bytes, int] = {}
        for t in ranks:
            if len(t) > 3:
                self.longest[t[:4]] = max(len(t), self.longest.get(t[:4], 0))
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.units, self.pairs, self.small, self.shorter = Recent(CACHE_ENTRIES), Recent(CACHE_ENTRIES), Recent(CACHE_ENTRIES), {}
        self.split: dict[int, tuple[int, int] | None] = {}

    # -- one piece ---------------------------------------------------------------------------------------

    def direct(self, piece: bytes, never: int = -1) -> list[int]:
        """The merges themselves, but the one to the token ``never``: lowest rank first, leftmost among equals; a heap keeps long windows near-linear."""
        n = len(piece)
        if n < 2:
            return [self.ranks[piece]] if n else []
        ranks, after, before, end = self.ranks, list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None and r != never]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or not end[i] or end[j] != stop:
                continue  # one of the two was merged meanwhile
            end[i], end[j], after[i] = stop, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(piece[a : end[b]])) is not None and r != never:
                    heapq.heappush(heap, (r, a, end[b]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that are merged last into the token (a byte: itself, twice), or None if some merge on the way has a higher rank than one after it."""
        if token not in self.split:
            whole = self.token[token]
            parts = self.direct(whole, token) if len(whole) > 1 else [token, token]
            in_order = len(whole) == 1 or len(parts) == 2 and max(parts) < token and all(map(self.halves, parts))
            self.split[token] = (parts[0], parts[1]) if in_order else None
        return self.split[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses between the two tokens, where both are made by merges of rising rank.

        Their merges are undone, the latest first: a pair that met at the seam stands until one of the two is merged on, so it is merged itself if its rank is lower
        than that (or equal, if it is the right one that is merged on, as merges go from the left).
        """
        limit = 1 << 62
        while True:
            if (both := self.ranks.get(self.token[left] + self.token[right])) is not None and both < limit:
                return False
            a, b = self.split[left], self.split[right]
            if a[0] == left and b[0] == right:
                return True
            if b[0] == right or a[0] != left and left > right:
                left, limit = a[1], left
            else:
                right, limit = b[0], right + 1

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their own bytes, so that no merge crosses between them."""
        key = left << 32 | right
        if (known := self.pairs.get(key)) is None:
            known = self.apart(left, right) if self.halves(left) and self.halves(right) else self.direct(self.token[left] + self.token[right]) == [left, right]
            self.pairs.put(key, known)
        return known

    def _longest(self, piece: bytes, at: int) -> int:
        for end in range(min(len(piece), at + self.longest.get(piece[at : at + 4], 3)), at, -1):
            if (rank := self.ranks.get(piece[at:end])) is not None:
                return rank
        raise ValueError("a byte has no token")

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of the token, or -1."""
        if (known := self.shorter.get(token)) is None:
            whole = self.token[token]
            known = self.shorter[token] = next((self.ranks[whole[:n]] for n in range(len(whole) - 1, 0, -1) if whole[:n] in self.ranks), -1)
        return known

    def leaf(self, piece: bytes) -> list[int]:
        """A short piece: from the left the longest tokens whose neighbours are stable, going back where none is."""
        out, at, dead, n = [], 0, set(), len(piece)
        token = self._longest(piece, 0) if n else -1
        while at < n or token >= 0:
            while token >= 0:
                end = at + len(self.token[token])
                if end not in dead and (not out or self.stable(out[-1], token)):
                    break
                token = self._next_shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = self._longest(piece, at)
            else:
                dead.add(at)
                token = out.pop()
                at -= len(self.token[token])
        return out

    def short(self, piece: bytes) -> list[int]:
        """``leaf``, remembered: halves and windows of different pieces are often the same few bytes."""
        if len(piece) > 2 * LEAF_BYTES:
            return self.leaf(piece)
        if (known := self.small.get(piece)) is None:
            known = self.leaf(piece)
            self.small.put(piece, known)
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation: the encoding of the concatenated bytes of two encodings."""
        if not left or not right:
            return left + right
        a, b = len(left) - 1, 1
        if self.stable(left[a], right[0]):
            return left + right
        step_a = step_b = 1
        while True:
            window = self.short(b"".join(map(self.token.__getitem__, left[a:] + right[:b])))
            left_holds = a == 0 or self.stable(left[a - 1], window[0])
            right_holds = b == len(right) or self.stable(window[-1], right[b])
            if left_holds and right_holds:
                return left[:a] + window + right[b:]
            if not left_holds:
                a, step_a = max(0, a - step_a), 2 * step_a
            if not right_holds:
                b, step_b = min(len(right), b + step_b), 2 * step_b

    def encode_piece(self, piece: bytes) -> list[int]:
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        if len(piece) <= LEAF_BYTES:
            return self.short(piece)
        half = len(piece) // 2
        return self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    # -- texts -------------------------------------------------------------------------------------------

    def _unit(self, unit: str) -> bytes:
        if (packed := self.units.get(unit)) is None:
            # A run of letters is one match, with the space before it; of ASCII letters without asking the pattern.
            whole = unit.isascii() and unit.removeprefix(" ").isalpha()
            ids = self.encode_piece(unit.encode()) if whole else [i for piece in self.pieces(unit) for i in self.encode_piece(piece.encode())]
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(unit) <= 64:
                self.units.put(unit, packed)
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        units = self.pieces(text) if _ODD_SPACE(text) else _UNITS(text)
        known = self.units.young.get
        return b"".join([known(u) or self._unit(u) for u in units])

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids: halves are decoded and concatenated."""
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def require_reachable(bpe: TreeBpe) -> None:
    """The pair rule needs every token to be what its own bytes encode to; refuse a vocabulary where one is not."""
    for token, rank in bpe.ranks.items():
        if bpe.direct(token) != [rank]:
            raise ValueError(f"token {rank} cannot be reached by merges; the tree reduction would not be exact")


_BUILT: dict[tuple[str, str], TreeBpe] = {}


def encoder(path: str, pattern: str) -> TreeBpe:
    """One encoder a worker process and vocabulary."""
    if (path, pattern) not in _BUILT:
        _BUILT[path, pattern] = TreeBpe(load_ranks(path), pattern)
    return _BUILT[path, pattern]


def _mapper(path: str, pattern: str, make: Callable[[TreeBpe, str | None], tuple], schema: pa.Schema):
    """For mapInArrow: the text is the last column; the others stay, and what ``make`` returns follows them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                made = [make(bpe, text) for text in part.columns[-1].to_pylist()]
                columns = [pa.array(x, f.type) for x, f in zip(zip(*made), schema)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], *schema.names])

    return run


def encode_documents(docs: DataFrame, text: str, keep: list[str], path: str, pattern: str) -> DataFrame:
    """Rows of ``docs``: the columns ``keep``, then ``ids`` array<bigint> of the whole text, then the text that they decode to.

    No shuffle; a row's result depends on its text alone.  Null and empty texts have no ids; repeated rows
    stay; other columns, whatever their names, are not read.
    """
    require_reachable(encoder(path, pattern))
    import numpy as np

    rows = docs.select(*keep, F.col(text).alias("__text"))

    def make(bpe: TreeBpe, value: str | None) -> tuple:
        ids = np.frombuffer(bpe.encode(value), "<u4").astype("int64")
        return (ids, None if value is None else bpe.decode(ids.tolist()).decode())

    fields = pa.schema([("ids", pa.list_(pa.int64())), (text, pa.string())])
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), "ids array<bigint>", f"`{text}` string"])
    return rows.mapInArrow(_mapper(path, pattern, make, fields), out)


def decode_ids(ids: Column, path: str, pattern: str) -> Column:
    """The text that an ids column stands for; bytes that are not UTF-8 become U+FFFD."""

    @F.udf("string")
    def decoded(values):
        return None if values is None else encoder(path, pattern).decode(list(values)).decode("utf-8", "replace")

    return decoded(ids)


def digests(docs: DataFrame, doc_id: str, text: str, path: str, pattern: str) -> DataFrame:
    """Encode each whole text, decode the ids again, and return doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts give 0 tokens and the hash of no bytes; a null doc_id and repeated rows stay as they are.
    """
    require_reachable(encoder(path, pattern))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))

    def make(bpe: TreeBpe, value: str | None) -> tuple:
        packed = bpe.encode(value)
        back = bpe.decode(memoryview(packed).cast("I").tolist())
        return (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest())

    fields = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return rows.mapInArrow(_mapper(path, pattern, make, fields), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
