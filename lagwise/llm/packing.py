"""Bounded-space online packing of token ids into sequences of a fixed length.

Each partition tokenizes its documents and keeps a fixed number of open windows. A document's piece goes to the open window with the least room
that holds it (best fit). Where none holds it the fullest open window is emitted, and a new one is opened once there is space for it; room of
MIN_CUT ids or more in the window that is emitted is filled with the beginning of the piece. Documents longer than a window are cut into full
windows and a rest. The windows that are open at the end of a partition are carried, with their ids, to fewer partitions and packed again, until
one partition is left: each round has at most OPEN windows from each partition, so that no task ever holds more than FAN * OPEN of them.

A null text is an empty one: its single piece is the end id. Every row is packed, repeated rows and null ids too; an empty table gives no rows, and
columns other than doc_id and text are not read. doc_id, start, length,
ids_crc32, doc_tokens, sequence_id and offset describe each piece; sequence_id is unique but not gapless.
"""

from __future__ import annotations

import os
import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import TEXTS, slices, written

#: Ids in a sequence, open windows of a partition, least room that is filled by a cut, partitions whose rests meet, id after each document.
LENGTH, OPEN, MIN_CUT, FAN, END = 2048, 64, 16, 16, 1
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, rest binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
#: Words and ids (4 bytes each) that a worker keeps from task to task; beyond either it keeps those words that were used most, a quarter as many at most.
_CACHE, _CACHED_IDS = 300_000, 2_400_000
#: Stands between words that are tokenized in one call; words that hold it are tokenized alone.
_MARK, _TOGETHER = "•", 200
#: Characters (or one word) whose words are looked up at once; bytes of a word's key, in which longer words have no place; factors of the keys' hash.
_CHARS, _KEY = 500_000, 23
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
#: By number of bytes: which bits of eight bytes count, and blanks in place of the others.
_LOW = np.array([256**i - 1 for i in range(9)], np.uint64)
_FILL = ~_LOW & np.uint64(0x2020202020202020)


class _Words:
    """Numbers of words, and the ids of each. Words between blanks are tokenized apart; a tokenizer that doesn't do so is an error. Whether it
    lower-cases, takes a line's end for a blank and cuts marks from the letters before them is found by trying.

    A word of up to _KEY bytes is found by these bytes themselves (filled up to 24 with blanks, which no word has) in an open hash table; longer ones are in a dict."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # there is a worker for each core: threads in each of them only take memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        if not self._alike("ab, C d", "ab,", "C", "d"):
            raise ValueError(f"{file} doesn't tokenize words between blanks apart")
        self.lower, self.lines = self._alike("ABC, Xyz", "abc,", "xyz"), self._alike("ab\ncd", "ab", "cd")
        table = bytearray(range(256))
        if self.lines:
            table[10] = 32
        self.as_is = bytes(table)
        self.lowered = self.as_is.lower() if self.lower else self.as_is
        self.cuts = np.zeros(256, bool)
        self.cuts[[ord(c) for c in string.punctuation if self._apart(c)]] = True
        self.mark = self._ids([_MARK])[0]
        suffix, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.reset()

    def __len__(self) -> int:
        return len(self.cut) - 1

    def __contains__(self, word: str) -> bool:
        return self._numbers([word])[0] >= 0

    def __getitem__(self, word: str) -> int:
        return int(self._numbers([word])[0])

    def reset(self) -> None:
        self.flat, self.cut, self.used = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.keys, self.long = np.zeros((0, 3), np.uint64), {}
        self.slots = np.full(1 << (3 * _CACHE).bit_length(), -1, np.int32)

    def trim(self) -> None:
        """Forgets all words but those used more than once, the most used first, up to a quarter of what may be kept; counting begins anew."""
        n = np.diff(self.cut)
        kept = np.argsort(-self.used, kind="stable")[: min(_CACHE // 4, int((self.used > 1).sum()))]
        kept = np.sort(kept[np.cumsum(n[kept]) <= _CACHED_IDS // 4])
        now = dict(zip(kept.tolist(), range(len(kept))))
        keys, long, ids = self.keys[kept], {w: now[k] for w, k in self.long.items() if k in now}, self.ids(kept)
        self.reset()
        self.long = long
        self._put(keys, ids, n[kept], np.isin(np.arange(len(kept)), [*long.values()], invert=True))

    def _alike(self, text: str, *parts: str) -> bool:
        """Whether the text has the ids of its parts."""
        whole, *apart = self._ids([text, *parts])
        return whole == list(chain.from_iterable(apart))

    def _apart(self, mark: str) -> bool:
        """Whether the tokenizer cuts between letters and the mark behind them, whatever follows, so that no id reaches over both."""
        pre, letters = self.tokenizer.pre_tokenizer, ("ab", "nose")
        texts = [(x, m) for x in letters for m in (mark, 2 * mark, f"{mark}.", f".{mark}")]
        if pre is None or not all(any(begin == len(x) for _, (begin, _) in pre.pre_tokenize_str(x + m)) for x, m in texts):
            return False
        return all(self._alike(x + m, x, m) for x, m in [*texts, ("né", mark)])

    def split(self, text: str) -> list[str]:
        """The words that the text is made of."""
        data, start, end = self._found([text])[:3]
        return [data[i:j].decode() for i, j in zip(start.tolist(), end.tolist())]

    def _found(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """All texts' bytes, where each word begins and ends in them, and where each text ends. Up to four marks behind a letter (of ASCII, or of two
        bytes up to U+027F without × and ÷) are a word of their own. Combining marks can make another letter of a lower-case one: then case stays."""
        parts = [t.encode() for t in texts]
        data = b" ".join([b"", *parts, b" " * 24])
        data = data.translate(self.as_is if b"\xcc" in data or b"\xcd" in data else self.lowered)
        x = np.frombuffer(data, np.uint8)
        blank = x == 32
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        last = end - 1
        for _ in range(4):
            last = last - self.cuts[x[last]]
        y, before = x[last], x[last - 1]
        letter = ((y | 32) >= 97) & ((y | 32) <= 122) | (y >= 128) & (before >= 0xC3) & (before <= 0xC9) & ((before != 0xC3) | (y & 0xDF != 0x97))
        i = np.flatnonzero((last < end - 1) & letter)
        at = last[i] + 1
        return data, np.insert(start, i + 1, at), np.insert(end, i, at), np.cumsum([len(p) + 1 for p in parts])

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' words, of which new ones are learned, and how many words each text and those before it have."""
        data, start, end, to = self._found(texts)
        n, eight = end - start, np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))
        keys = np.empty((len(n), 3), np.uint64)
        for j in range(3):
            part = np.clip(n - 8 * j, 0, 8)
            keys[:, j] = eight[np.minimum(start + 8 * j, len(eight) - 1)] & _LOW[part] | _FILL[part]
        k, short = np.full(len(n), -1), np.flatnonzero(n <= _KEY)
        while len(short):  # words that differ but have the same hash are learned one after the other
            k[short] = self._find(keys[short])
            short = short[k[short] < 0]
            if len(short):
                one = keys[short[np.unique(_hash(keys[short]), return_index=True)[1]]]
                self.learn(set(filter(None, one.tobytes().decode().split(" "))))
        far = np.flatnonzero(n > _KEY)
        words = [data[i:j].decode() for i, j in zip(start[far].tolist(), end[far].tolist())]
        self.learn({w for w in words if w not in self.long})
        k[far] = [self.long[w] for w in words]
        return k, np.searchsorted(start, to)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The words' numbers; -1 where there is none."""
        k, todo, at = np.full(len(keys), -1), np.arange(len(keys)), self._slot(keys)
        while len(todo):
            got = self.slots[at]
            some = got >= 0
            todo, at, got = todo[some], at[some], got[some]
            same = (self.keys[got] == keys[todo]).all(1)
            k[todo[same]] = got[same]
            todo, at = todo[~same], (at[~same] + 1) & (len(self.slots) - 1)
        return k

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (_hash(keys) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.array([self.long.get(w, -1) if len(w.encode()) > _KEY else self._find(_keys([w]))[0] for w in words])

    def ids(self, k: np.ndarray) -> np.ndarray:
        """The ids of the words with these numbers, one word's behind the other's."""
        begin = self.cut[k]
        n = self.cut[k + 1] - begin
        to = np.cumsum(n)
        return self.flat[np.repeat(begin - to + n, n) + np.arange(to[-1] if len(k) else 0)]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str], between: str) -> np.ndarray:
        """Ids of the words, tokenized _TOGETHER at a time with so much between them and after the last."""
        rows = self._ids([between.join([*words[i : i + _TOGETHER], ""]) for i in range(0, len(words), _TOGETHER)])
        return np.fromiter(chain.from_iterable(rows), np.uint32, sum(map(len, rows)))

    def learn(self, words: set[str]) -> None:
        """Words of letters end with the id that says so, where the vocabulary has such ids and each word has one; others are told apart by marks or tokenized alone."""
        letters = sorted(w for w in words if w.isalpha()) if self.ends.any() else []
        ids = self._together(letters, " ")
        last = np.flatnonzero(self.ends[ids])
        if len(last) == len(letters):
            self._add(letters, ids, np.diff(last, prepend=-1))
            words = words.difference(letters)
        together = sorted(w for w in words if _MARK not in w) if len(self.mark) == 1 else []
        ids = self._together(together, f" {_MARK} ")
        marks = ids == self.mark[0]
        self._add(together, ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1)
        alone = sorted(words.difference(together))
        rows = self._ids(alone)
        self._add(alone, np.fromiter(chain.from_iterable(rows), np.uint32, sum(map(len, rows))), np.fromiter(map(len, rows), np.int64, len(rows)))

    def _add(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        if len(words) != len(n):
            raise ValueError(f"{len(words)} words but {len(n)} marks between them")
        if not words:
            return
        short = np.array([len(w.encode()) <= _KEY for w in words], bool)
        self.long.update((words[i], len(self) + i) for i in np.flatnonzero(~short).tolist())
        self._put(_keys(words), ids, n, short)

    def _put(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray, short: np.ndarray) -> None:
        """Behind the words that there are; short: those that are found by their keys."""
        new = len(self) + np.flatnonzero(short)
        self.flat = np.append(self.flat, ids)
        self.cut = np.append(self.cut, self.cut[-1] + np.cumsum(n))
        self.used = np.append(self.used, np.zeros(len(n), np.int32))
        self.keys = np.concatenate([self.keys, keys])
        if 2 * len(self) > len(self.slots):
            every = np.append(self.slots[self.slots >= 0], new)
            self.slots, new = np.full(1 << (4 * len(self)).bit_length(), -1, np.int32), every
        at = self._slot(self.keys[new])
        while len(new):
            free = self.slots[at] < 0
            self.slots[at[free]] = new[free]
            more = self.slots[at] != new
            new, at = new[more], (at[more] + 1) & (len(self.slots) - 1)


def _keys(words: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(w.encode()[:_KEY].ljust(24) for w in words), np.uint64).reshape(-1, 3)


def _hash(keys: np.ndarray) -> np.ndarray:
    h = keys[:, 0] * _MUL[0] + keys[:, 1] * _MUL[1] + keys[:, 2] * _MUL[2]
    return (h ^ (h >> np.uint64(29))) * _MUL[1] >> np.uint64(20)


@lru_cache(maxsize=1)
def _words(file: str) -> _Words:
    """Kept by a worker from task to task."""
    return _Words(file)


def encoded(texts: list[str], words: _Words) -> list[np.ndarray]:
    """Ids of each text, the end id last."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for some in _few(texts):
        if len(words) > _CACHE or len(words.flat) > _CACHED_IDS:
            words.trim()
        k, to = words.numbers([t for _, t in some])
        words.used += np.bincount(k, minlength=len(words)).astype(np.int32)
        for (i, _), x, y in zip(some, [0, *to.tolist()], to.tolist()):
            out[i].append(words.ids(k[x:y]))
    return [np.concatenate([*x, np.array([END], np.uint32)]).astype("<u4", copy=False) for x in out]


def _few(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """The texts with their places, about _CHARS characters at a time; longer ones are cut at blanks."""
    some, chars = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            to = text.find(" ", at + _CHARS) if len(text) > at + _CHARS else -1
            piece = text[at : to if to >= 0 else len(text)]
            if some and chars + len(piece) > _CHARS:
                yield some
                some, chars = [], 0
            some.append((i, piece))
            at, chars = at + len(piece) + 1, chars + len(piece)
    if some:
        yield some


class Windows:
    """The open windows of one partition; emitted pieces gather in rows."""

    def __init__(self, base: int, length: int, most: int, min_cut: int):
        self.next, self.length, self.most, self.min_cut = base, length, most, min_cut
        self.room: list[tuple[int, int]] = []  # (room, window), sorted
        self.held: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def put(self, doc: int | None, ids: np.ndarray, start: int, total: int) -> None:
        """A piece: ids of the document from its id number start on; of any length."""
        while len(ids) >= self.length:
            self._emit(self._new(), [(doc, start, ids[: self.length], total)])
            ids, start = ids[self.length :], start + self.length
        while len(ids):
            i = bisect_left(self.room, (len(ids), -1))
            if i < len(self.room):
                room, window = self.room.pop(i)
                self._into(window, room, doc, start, ids, total)
                return
            if len(self.room) < self.most:
                window = self._new()
                self.held[window] = []
                self._into(window, self.length, doc, start, ids, total)
                return
            room, window = self.room.pop(0)  # the fullest
            pieces = self.held.pop(window)
            if room >= self.min_cut:  # the piece is longer than this room, else it would fit
                pieces.append((doc, start, ids[:room], total))
                ids, start = ids[room:], start + room
            self._emit(window, pieces)

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _into(self, window: int, room: int, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.held[window].append((doc, start, ids, total))
        if room == len(ids):
            self._emit(window, self.held.pop(window))
        else:
            insort(self.room, (room - len(ids), window))

    def _emit(self, window: int, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, window, at, None))
            at += len(ids)

    def leave(self, carry: bool) -> None:
        """Ends: open windows with little room are emitted; the others too, or as pieces with their ids where they are carried on."""
        for room, window in self.room:
            pieces = self.held[window]
            if not carry or room < self.min_cut:
                self._emit(window, pieces)
            else:
                self.rows += [(doc, start, len(ids), 0, total, -1, 0, ids.tobytes()) for doc, start, ids, total in pieces]
        self.room, self.held = [], {}

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        types = [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], _NAMES)


def _first(file: str, base: int, length: int, most: int, min_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(file)
        open_ = Windows(base + (TaskContext.get().partitionId() << 28), length, most, min_cut)
        for part in slices(batches):
            for doc, ids in zip(part["doc_id"], encoded([t or "" for t in part["text"]], words)):
                open_.put(doc, ids, 0, len(ids))
            yield open_.batch()
        open_.leave(True)
        yield open_.batch()

    return run


def _again(base: int, length: int, most: int, min_cut: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = Windows(base + (TaskContext.get().partitionId() << 28), length, most, min_cut)
        for part in slices(batches, 2000):
            for doc, start, total, rest in zip(part["doc_id"], part["start"], part["doc_tokens"], part["rest"]):
                open_.put(doc, np.frombuffer(rest, "<u4"), start, total)
            yield open_.batch()
        open_.leave(not last)
        yield open_.batch()

    return run


def packed(docs: DataFrame, file: str, length: int = LENGTH, open_windows: int = OPEN, min_cut: int = MIN_CUT) -> DataFrame:
    """One row for each piece; file: a vocabulary of the tokenizers library, at the same path on each executor."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = rows.rdd.getNumPartitions()
    out, turn = [], 0
    step = written(rows.mapInArrow(_first(file, 0, length, open_windows, min_cut), _SCHEMA), TEXTS)
    while True:
        out.append(step.where("rest is null").drop("rest"))
        rest = step.where("rest is not null")
        parts, turn = max(1, -(-parts // FAN)), turn + 1
        # rests meet by where they lie, longest first; the order within a task is fixed by the sort
        rest = rest.repartition(parts, F.xxhash64("doc_id", "start", "doc_tokens")).sortWithinPartitions(F.desc("length"), "doc_id", "start")
        step = written(rest.mapInArrow(_again(turn << 56, length, open_windows, min_cut, parts == 1), _SCHEMA))
        if parts == 1:
            out.append(step.where("rest is null").drop("rest"))
            break
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole
