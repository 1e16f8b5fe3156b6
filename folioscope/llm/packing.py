"""Packing token sequences: best-fit decreasing with a segment tree indexed by remaining capacity.

Overlong documents are first cut into full windows. What is left of each document goes, longest first, into the
open window with the tightest sufficient room; the tree answers "smallest capacity >= length that some open
window has" in log2(window) steps. Each task packs the documents of its own input split, so nothing is shuffled
and a lost task is simply run again. Until the end of a split a task keeps lengths and checksums, and of each document the compressed ids
of its last piece alone (under a window), as that may have to be cut.
The few windows left with much room at the end of a split are cut anew into full ones.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, ship

#: Characters that Python's split() takes for white space and the tokenizer does not, and the start of its special tokens.
_ODD = "[\x1c-\x1f]|<\\|"
#: Outside of these ranges lower case and letter classes are left to the tokenizer.
_WIDE = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: Pieces kept for good, and further ones kept until as many are there.
HELD, PASSING = 150_000, 100_000
#: Characters of text that are cut at once; a longer text stands alone.
CHUNK = 1 << 20
#: Pieces that are merged in one call: a call holds some 500 bytes a piece.
CALL = 4096

BLANK, LETTER, NUMBER, SIGN = range(4)
#: What the tokenizer's pattern takes a character of the narrow ranges for.
_KIND = np.array([BLANK if c.isspace() else LETTER if c.isalpha() else NUMBER if unicodedata.category(c)[0] == "N" else SIGN for c in map(chr, range(0x250))], np.uint8)
#: Letters that stay with an apostrophe before them.
_SHORT = [np.frombuffer(x, np.uint8) for x in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")]


def wide(text: str) -> bool:
    return not text.isascii() and _WIDE.search(text) is not None


def lowered(text: str) -> str:
    """Lower case, but for words with wide characters."""
    return " ".join([w if wide(w) else w.lower() for w in text.split()]) if wide(text) else text.lower()


def cut(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of UTF-8 text start a piece, and which are blank.

    Pieces are what the tokenizer cuts text into before it merges: 's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+. A word with a
    character outside of the narrow ranges is one piece here. The text ends with two blanks.
    """
    kind = _KIND[np.minimum(b, 0x7F)]
    inner = np.zeros(len(b), bool)
    lead = np.flatnonzero(b >= 0xC0)
    beyond = lead[:0]
    if len(lead):
        inner = (b & 0xC0) == 0x80
        code = ((b[lead].astype(np.int32) & 0x1F) << 6) | (b[lead + 1] & 0x3F)
        far = (b[lead] >= 0xE0) | (code >= 0x250) | (code == 0x130)
        near, beyond = lead[~far], lead[far]
        kind[near] = kind[near + 1] = _KIND[code[~far]]
    blank = kind == BLANK
    start = (kind != np.concatenate([[BLANK], kind[:-1]])) | (kind == NUMBER)
    start &= ~inner & ~blank
    mark = np.flatnonzero(start & (b == 0x27))
    for short in _SHORT:
        at = mark
        for k, x in enumerate(short, 1):
            at = at[b[at + k] == x]
        start[at + 1] = False
        after = at + 1 + len(short)
        start[after] |= kind[after] == LETTER
    if len(beyond):
        words = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        w = np.unique(np.searchsorted(words, beyond, "right") - 1)
        turn = np.zeros(len(b), np.int8)
        turn[words[w] + 1], turn[ends[w]] = 1, -1
        start &= np.cumsum(turn, dtype=np.int8) == 0
    return start, blank


class WordTokenizer:
    """Token ids of whole texts from the ids of their pieces.

    The tokenizer file normalises with NFC, white space to one space and lower case, drops white space, and cuts the rest into pieces that
    no token spans: ids of a text are those of its pieces in a row. Many texts are cut at once and their distinct pieces numbered by Arrow,
    so only these are looked up in Python. Pieces are held in a bounded table; words with wide characters are pieces of their own that go
    through the tokenizer, and texts with the odd characters above go through it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.t = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.t.model)  # the same merges, for pieces that are normalised and cut already
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [i for token, i in self.t.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.t.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.held: dict[str, int] = {}  # the number of a piece; its ids are ids[at[number] : at[number + 1]]
        self.ids, self.at = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row and where those of each end. One call for many: tokens that end a word part the pieces."""
        many = (" ".join(pieces[i : i + CALL]) for i in range(0, len(pieces), CALL))
        ids = np.concatenate([np.array(self.merges.encode_batch_fast([x], add_special_tokens=False)[0].ids, "<u4") for x in many])
        ends = np.flatnonzero(self.ends[ids]) + 1
        return (ids, ends) if len(ends) == len(pieces) else self._joined(self._whole(pieces))

    @staticmethod
    def _joined(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.empty(0, "<u4"), *each]), np.cumsum([len(x) for x in each], dtype=np.int64)

    def _learn(self, new: list[str]) -> np.ndarray:
        """Numbers of pieces that are not held yet."""
        numbers = np.arange(len(new)) + len(self.held)
        far = [wide(p) for p in new]
        if any(far):
            order = np.argsort(far, kind="stable")
            numbers[order] = numbers.copy()
            new = [new[i] for i in order.tolist()]
        narrow = len(new) - sum(far)
        for pieces, ids_of in ((new[:narrow], self._merged), (new[narrow:], lambda w: self._joined(self._whole(w)))):
            if pieces:
                ids, ends = ids_of(pieces)
                self.held.update(zip(pieces, range(len(self.held), len(self.held) + len(pieces))))
                self.at = np.concatenate([self.at, ends + len(self.ids)])
                self.ids = np.concatenate([self.ids, ids])
        return numbers

    def _forget(self) -> None:
        """The pieces that came after the first ones."""
        for p in list(islice(reversed(self.held), len(self.held) - HELD)):
            del self.held[p]
        self.at = self.at[: HELD + 1].copy()
        self.ids = self.ids[: self.at[-1]].copy()

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        of = np.fromiter(map(self.held.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(of < 0)
        if len(new):
            of[new] = self._learn([pieces[i] for i in new.tolist()])
        return of

    def _encode_chunk(self, texts: list[str]) -> list[bytes]:
        if len(self.held) > HELD + PASSING:
            self._forget()
        odd = pc.match_substring_regex(pa.array(texts, pa.string()), _ODD).to_pylist()
        raw = [b"" if whole else lowered(x).encode() for x, whole in zip(texts, odd)]
        b = np.frombuffer(b"\n".join([*raw, b"\n"]), np.uint8)
        start, blank = cut(b)
        full = ~blank
        first = np.flatnonzero(start[full]).astype(np.int32)
        letters = b[full]
        pieces = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, np.int32(len(letters)))), pa.py_buffer(letters)).dictionary_encode()
        of = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy()]
        n = self.at[of + 1] - self.at[of]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.at[of] - ends[:-1], n)
        at += np.arange(len(at))
        ids = memoryview(self.ids[at]).cast("B")
        lines = np.cumsum([0, *[len(x) + 1 for x in raw]])
        cuts = (4 * ends[np.searchsorted(np.flatnonzero(start), lines)]).tolist()
        return [self._whole([t])[0].tobytes() if whole else bytes(ids[x:y]) for t, whole, x, y in zip(texts, odd, cuts, cuts[1:])]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text in turn; none for null."""
        chunk, size = [], 0
        for text in texts:
            if chunk and size + len(text or "") > CHUNK:
                yield from self._encode_chunk(chunk)
                chunk, size = [], 0
            chunk.append(text or "")
            size += len(text or "")
        if chunk:
            yield from self._encode_chunk(chunk)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and file, kept between tasks until another operator runs there."""
    held = _TOKENIZERS
    claim("packing", held.clear)
    if path not in held:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held[path] = WordTokenizer(path)
    return held[path]


class Rooms:
    """Open windows by remaining capacity: a segment tree over capacities 0..size holding whether any window has it."""

    def __init__(self, size: int):
        self.leaf = 1
        while self.leaf < size + 1:
            self.leaf *= 2
        self.tree = [0] * (2 * self.leaf)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _mark(self, room: int, step: int) -> None:
        i = room + self.leaf
        while i:
            self.tree[i] += step
            i //= 2

    def add(self, window: int, room: int) -> None:
        self.open[room].append(window)
        self._mark(room, 1)

    def tightest(self, length: int) -> int | None:
        """The least capacity >= length that an open window has."""
        i = length + self.leaf
        if i >= 2 * self.leaf:
            return None
        if self.tree[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.leaf:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaf
            i //= 2
        return None

    def take(self, room: int) -> int:
        self._mark(room, -1)
        return self.open[room].pop()


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Indices of the pieces in each window; every length is from 1 to size. Ties keep their order."""
    rooms, windows = Rooms(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = rooms.tightest(lengths[i])
        if room is None:
            windows.append([])
            at, room = len(windows) - 1, size
        else:
            at = rooms.take(room)
        windows[at].append(i)
        if room > lengths[i]:
            rooms.add(at, room - lengths[i])
    return windows


def padding(used: int, size: int) -> int:
    """Places filled up in a sequence: none at a power of two."""
    return 0 if used & (used - 1) == 0 else size - used


def arrange(lengths: list[int], size: int, most_left: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (piece, start in it, length): best fit, then the windows with more than ``most_left`` places to fill are cut anew
    into full ones, and what is still over into powers of two while that fills places."""
    packed, over = [], []
    for w in best_fit(lengths, size):
        used = sum(lengths[i] for i in w)
        (packed if padding(used, size) <= most_left else over).append([(i, 0, lengths[i]) for i in w])
    flat = [p for w in sorted(over, key=len) for p in w]
    left = sum(p[2] for p in flat)
    while flat:
        room = size if left >= size else 1 << (left.bit_length() - 1) if padding(left, size) > most_left else left
        left -= room
        window = []
        while room:
            i, start, n = flat.pop()
            k = min(n, room)
            window.append((i, start, k))
            room -= k
            if k < n:
                flat.append((i, start + k, n - k))
        packed.append(window)
    return packed


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, most_left: int = 64) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's, then ``end_id``; null or empty text: that id alone. Pieces of a document cover its
    ids once, without gaps. In a sequence offsets are gapless from 0. sequence_id is unique over the whole table: the input
    split's number times 2**33, plus a count. Rows that share a doc_id are packed each for itself; a null doc_id is kept.
    An empty table: no rows. The same input splits give the same rows on every run.
    """
    ship(docs.sparkSession)

    def run(batches):
        tok = tokenizer(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        ids, start, length, crc, total = [], [], [], [], []  # full windows and rests, in order
        rest: list[int] = []
        tails: dict[int, bytes] = {}
        kept = "<u2" if max(len(tok.ends), end_id + 1) <= 1 << 16 else "<u4"
        codec = pa.Codec("zstd", compression_level=1)
        first = TaskContext.get().partitionId() << 33
        count = 0

        def rows(windows, tails):
            nonlocal count
            out = []
            for w in windows:
                at = 0
                for i, s, n in w:
                    c = crc[i] if n == length[i] else zlib.crc32(tails[i][4 * s : 4 * (s + n)])
                    out.append((ids[i], start[i] + s, n, c, total[i], first + count, at))
                    at += n
                count += 1
            return out

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            full = []
            for doc, b in zip(batch.column(0).to_pylist(), tok.encode(batch.column(1).to_pylist())):
                b += end
                n = len(b) // 4
                for s in range(0, n, size):
                    piece = b[4 * s : 4 * (s + size)]
                    i = len(ids)
                    ids.append(doc), start.append(s), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(n)
                    if length[i] == size:
                        full.append([(i, 0, size)])
                    else:
                        rest.append(i)
                        tails[i] = codec.compress(np.frombuffer(piece, "<u4").astype(kept).tobytes(), asbytes=True)
            yield batch_of(rows(full, tails))
        windows = [[(rest[i], s, n) for i, s, n in w] for w in arrange([length[i] for i in rest], size, most_left)]
        parted = {i for w in windows for i, _, n in w if n != length[i]}
        tails = {i: np.frombuffer(codec.decompress(tails[i], length[i] * np.dtype(kept).itemsize), kept).astype("<u4").tobytes() for i in parted}
        yield batch_of(rows(windows, tails))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
