"""Minimum bin slack packing of token sequences.

A document's ids are cut into full windows and one remainder. Within a block of remainders only their lengths matter:
a bitset subset-sum program over the multiset of lengths finds, for the longest length left, the partners that fill
the window closest to its capacity; backtracking through the bitsets gives how many of each length it takes, and that
pattern is used as often as the counts allow. Windows that no pattern fills are carried into the next block, up to half a
block; what is more is closed at once, the closest fills first, their slack filled by pieces cut from the worst. At a
partition's end all are closed so, and less than a window is cut into windows whose lengths are powers of two, which need no
padding.

Each task packs its own partition, so nothing is shuffled and no plan grows with the corpus; a block holds at most
``BLOCK`` ids. Sequence numbers carry the partition number in their upper bits.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomline.llm.common import narrow, small_batches, tokenizer_path, worker_state

CAPACITY = 2048
END_ID = 1
BLOCK = 3_000_000
MEMO = 400_000
LONG = 48
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


_PIECE = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+")


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class WordEncoder:
    """The library's ids of a whole text. White space separates words for good in this vocabulary, and case does not
    count, so each lower-cased run of other characters is encoded once and remembered. An unknown run of visible ASCII
    is cut as the vocabulary's pre-tokenizer cuts it and its letters are looked up apart from the marks around them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def _remember(memo: dict, key: bytes | str, data: bytes) -> bytes:
        if len(key) <= LONG:
            if len(memo) >= MEMO:
                memo.clear()
            memo[key] = data
        return data

    def _piece(self, piece: str) -> bytes:
        return self._remember(self.pieces, piece, _packed([t.id for t in self.library.model.tokenize(piece)]))

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isascii() and text.isprintable() and "<|" not in text:
            found = _PIECE.findall(text.lower())
            return self._remember(self.memo, word, b"".join([self.pieces.get(p) or self._piece(p) for p in found]))
        return self._remember(self.memo, word, _packed(self.library.encode(text, add_special_tokens=False).ids))

    def encode(self, text: str | None) -> bytes:
        data, memo, out = (text or "").encode(), self.memo, []
        if b"<|" not in data:  # a special token counts only as it is spelled
            data = data.lower()
        for word in data.split():
            ids = memo.get(word)
            out.append(self._word(word) if ids is None else ids)
        return b"".join(out)


def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker and vocabulary."""
    return worker_state((WordEncoder, path), lambda: WordEncoder(path))


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length sum closest to ``room`` without passing it."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, power = min(counts[length], room // length), 1
        while left:
            take = min(power, left)
            steps.append((length, take, reach))
            reach = (reach | reach << (length * take)) & mask
            left, power = left - take, power * 2
            if reach >> room:
                break
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return dict(used)


def fill_windows(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int, int]]:
    """Patterns (lengths with counts), how often each is used, and its slack, until no length is left."""
    counts = {k: v for k, v in counts.items() if v > 0}
    while counts:
        seed = max(counts)
        rest = dict(counts)
        rest[seed] -= 1
        if not rest[seed]:
            del rest[seed]
        pattern = best_fill(rest, capacity - seed)
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        yield pattern, times, capacity - sum(k * n for k, n in pattern.items())


class Packer:
    """Packs one partition block by block."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.capacity, self.next, self.out, self.held, self.tokens = capacity, first, [], defaultdict(list), 0

    def _emit(self, doc_id, start: int, ids, total: int, sequence: int, offset: int) -> None:
        self.out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))

    def add(self, doc_id, ids: bytes) -> None:
        view, total, size = memoryview(ids), len(ids) // 4, self.capacity * 4
        whole = len(ids) // size * size
        for at in range(0, whole, size):
            self._emit(doc_id, at // 4, view[at : at + size], total, self.next, 0)
            self.next += 1
        if rest := bytes(view[whole:]):
            self.held[len(rest) // 4].append((doc_id, whole // 4, rest, total))
            self.tokens += len(rest) // 4

    def _close(self, pieces: list[tuple]) -> None:
        """A sequence of these pieces."""
        offset = 0
        for doc_id, start, ids, total in pieces:
            self._emit(doc_id, start, ids, total, self.next, offset)
            offset += len(ids) // 4
        self.next += 1

    def pack(self, keep: int) -> None:
        """Pack what is held until at most ``keep`` ids are left, or less than a window.

        Windows that a pattern fills are done. Of the others those closest to their capacity are closed first: pieces of the
        windows furthest from it are cut to fill their slack. So a call that starts at twice ``keep`` ids or more gets rid of
        half of them, whatever their lengths are."""
        patterns = fill_windows({k: len(v) for k, v in self.held.items()}, self.capacity)
        open_windows = []
        for pattern, times, slack in patterns:
            for _ in range(times):
                pieces = [self.held[length].pop() for length, n in pattern.items() for _ in range(n)]
                if slack:
                    open_windows.append((slack, pieces))
                else:
                    self._close(pieces)
        waiting = deque(sorted(open_windows, key=lambda w: w[0]))
        self.tokens = sum(self.capacity - slack for slack, _ in waiting)
        spare: list[tuple] = []  # pieces of one dissolved window, less than a window's ids
        while self.tokens > keep and self.tokens >= self.capacity:
            slack, pieces = waiting.popleft()
            while slack:
                if not spare:
                    spare = waiting.pop()[1]
                doc_id, start, ids, total = spare.pop()
                pieces.append((doc_id, start, ids[: slack * 4], total))
                if len(ids) > slack * 4:
                    spare.append((doc_id, start + slack, ids[slack * 4 :], total))
                slack -= len(pieces[-1][2]) // 4
            self._close(pieces)
            self.tokens -= self.capacity
        self.held = defaultdict(list)
        for piece in chain(spare, *(pieces for _, pieces in waiting)):
            self.held[len(piece[2]) // 4].append(piece)

    def finish(self) -> None:
        """Pack all full windows, then cut what is left into windows of a power of two."""
        self.pack(0)
        left = self.tokens
        room, offset = 1 << max(0, left.bit_length() - 1), 0
        for length in sorted(self.held, reverse=True):
            for doc_id, start, ids, total in self.held[length]:
                at = 0
                while at < length:
                    take = min(room - offset, length - at)
                    self._emit(doc_id, start + at, ids[at * 4 : (at + take) * 4], total, self.next, offset)
                    at, offset, left = at + take, offset + take, left - take
                    if offset == room:
                        self.next, offset = self.next + 1, 0
                        room = 1 << max(0, left.bit_length() - 1)
        self.held, self.tokens = defaultdict(list), 0

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_stream(rows: Iterable[tuple[int | None, bytes]], first: int = 0, capacity: int = CAPACITY, block: int = BLOCK) -> Iterator[list[tuple]]:
    """Lists of pieces of (doc_id, ids) rows."""
    packer = Packer(first, capacity)
    for doc_id, ids in rows:
        packer.add(doc_id, ids)
        if packer.tokens >= block:
            packer.pack(block // 2)
        if len(packer.out) >= 20_000:
            yield packer.drain()
    packer.finish()
    yield packer.drain()


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack every document's ids and ``end_id`` into sequences of at most ``capacity``.

    Null and empty texts are a document of the end id alone; repeated rows and null ids are packed like any other; a very
    long text fills sequences of its own and only its remainder is packed with others.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path("word_bpe_49k.json")
    names = [x.split(" ")[0] for x in PIECE_SCHEMA.split(", ")]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_encoder(path)
        rows = ((d.as_py(), words.encode(t.as_py()) + end) for b in batches for d, t in zip(b.column("doc_id"), b.column("text"), strict=True))
        for pieces in pack_stream(rows, TaskContext.get().partitionId() << 36, capacity):
            if pieces:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)], names)

    return narrow(docs, doc_id="long", text="string").mapInArrow(run, PIECE_SCHEMA)
