"""Token ids of whole texts by the tokenizers library, with each distinct piece encoded once per worker.

A column's bytes are cut, as a whole, at places where the vocabulary's own pattern ends a pre-token whatever stands around them:
between ASCII letters, digits and marks, before white space, and where a run of white space gives its last character to what
follows. Pieces are looked up by 128 bits of hash in a table of fixed size; only pieces not seen before become Python strings and
go to the library, whose ids then serve every later occurrence. Ids joined are the text's ids, because the library merges within
pre-tokens only. Special tokens are never cut. Pieces of more than LONG bytes go to the library each time and are not kept.
"""

from __future__ import annotations

import gc
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the longest piece that is kept.
LONG = 96
#: Slots of the table of pieces (half of them used at most, 24 bytes each) and ids kept for them; beyond it the table starts anew.
SLOTS, POOL = 1 << 22, 1 << 24
#: Classes of bytes; no cut touches an odd byte (one that is white space for some, or part of white space beyond ASCII). An
#: angle may begin a special token, before which white space ends as at a text's end.
OTHER, LETTER, DIGIT, MARK, LINE, SPACE, ODD, ANGLE = range(8)
#: Marks that no special token and no contraction holds.
MARKS = b".,;:!?%&*$#-/()[]{}=+@_\"\\^~`"


def _classes() -> np.ndarray:
    of = np.full(256, OTHER, np.uint8)
    for chars, kind in ((range(65, 91), LETTER), (range(97, 123), LETTER), (range(48, 58), DIGIT), (MARKS, MARK), (range(9, 14), LINE), (b" ", SPACE), (b"<", ANGLE), (range(28, 32), ODD)):
        of[list(chars)] = kind
    return of


def _cuts() -> np.ndarray:
    """For the classes of two neighbours (first * 8 + second): whether a pre-token always ends between them."""
    out = np.zeros(64, bool)
    for a in (LETTER, DIGIT, MARK):
        for b in (LETTER, DIGIT, MARK):
            out[a * 8 + b] = a != b
    for a in (OTHER, LETTER, DIGIT, MARK, ANGLE):
        out[[a * 8 + LINE, a * 8 + SPACE]] = True
        out[LINE * 8 + a] = a != ANGLE
    return out


CLASSES, CUTS = _classes(), _cuts()
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte; white space beyond ASCII is odd."""
    kind = CLASSES[data]
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        for at in np.flatnonzero(data == lead):
            size = 2 if lead == 0xC2 else 3
            if bytes(data[at : at + size]).decode("utf-8", "replace").isspace():
                kind[at : at + size] = ODD
    return kind


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin, for texts that begin at bounds[:-1]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes(data)
    cut = np.zeros(n, bool)
    cut[1:] = CUTS[kind[:-1] * np.uint8(8) + kind[1:]]
    white = (kind == LINE) | (kind == SPACE)
    ends = bounds[(bounds > 0) & (bounds < n)]
    # the last of several white characters belongs to what follows, if that is in the same text and neither odd nor an angle
    last = np.flatnonzero(white[1:] & white[:-1]) + 1
    last = last[last + 1 < n]
    last = last[~white[last + 1] & (kind[last + 1] < ODD)]
    if last.size:
        cut[last[~np.isin(last + 1, ends)]] = True
    # a text's closing run of white space is one token: no cut inside it
    cut[ends] = True
    cut[0] = True
    return np.flatnonzero(cut)


def hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each piece; data has 8 bytes to spare at its end."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    one, two = (sizes.astype(np.uint64) * m for m in _MULTIPLIERS)
    some = np.arange(len(starts))
    at = 0
    while some.size:
        left = sizes[some] - at
        some, left = some[left > 0], left[left > 0]
        if not some.size:
            break
        w = words[starts[some] + at] & _MASKS[np.minimum(left, 8)]
        for h, m, shift in ((one, _MULTIPLIERS[0], 29), (two, _MULTIPLIERS[1], 32)):
            x = (h[some] ^ w) * m
            h[some] = x ^ (x >> np.uint64(shift))
        at += 8
    for h in (one, two):
        h *= _MULTIPLIERS[1]
        h ^= h >> np.uint64(31)
    one[one == 0] = 1
    return one, two


class Table:
    """Ids by hash: open addressing in numpy arrays that double up to `slots`, and a pool of ids up to `pool`."""

    def __init__(self, kind: type, slots: int = SLOTS, pool: int = POOL):
        self.kind, self.most, self.most_ids = kind, slots, pool
        self.clear()

    def clear(self, slots: int = 1 << 16) -> None:
        self._sized(min(slots, self.most))
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def _sized(self, slots: int) -> None:
        self.slots, self.n = slots, 0
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.one, self.two = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.start, self.count = np.zeros(slots, np.uint32), np.zeros(slots, np.uint32)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        out = np.full(len(one), -1, np.int64)
        todo, slot = np.arange(len(one)), (one >> self.shift).astype(np.int64)
        while todo.size:
            held = self.one[slot]
            hit = (held == one[todo]) & (self.two[slot] == two[todo])
            out[todo[hit]] = slot[hit]
            on = ~hit & (held != 0)
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _put(self, one: np.ndarray, two: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        todo, slot = np.arange(len(one)), (one >> self.shift).astype(np.int64)
        while todo.size:
            free = self.one[slot] == 0
            at, i = slot[free], todo[free]
            for to, x in ((self.one, one), (self.two, two), (self.start, start), (self.count, count)):
                to[at] = x[i]  # of several for one slot the last wins, in each array
            on = (self.one[slot] != one[todo]) | (self.two[slot] != two[todo])
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        self.n += len(one)

    def room(self, n: int, ids: int) -> None:
        """Makes room for n more keys with so many ids: clears the table, or moves its keys to other slots."""
        if 2 * (self.n + n) > self.most or self.used + ids > self.most_ids:
            self.clear(self.slots)
        if 2 * (self.n + n) > self.slots:
            slots = self.slots
            while slots < min(self.most, 2 * (self.n + n)):
                slots *= 2
            at = np.flatnonzero(self.one)
            old = [x[at] for x in (self.one, self.two, self.start, self.count)]
            self._sized(slots)
            self._put(*old)

    def write(self, ids: np.ndarray, keep: bool) -> int:
        """Puts ids at the end of the pool, for good or until the next call; returns where."""
        need = self.used + len(ids)
        if need > len(self.pool):
            grown = np.zeros(max(need, 2 * len(self.pool)), self.kind)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        at = self.used
        self.pool[at:need] = ids
        if keep:
            self.used = need
        return at

    def add(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """New keys with their ids, one after the other; room() has been made."""
        self._put(one, two, (self.write(ids, True) + np.cumsum(count) - count).astype(np.uint32), count.astype(np.uint32))


class PieceEncoder:
    """Ids of texts; kind is 'byte' or 'word'."""

    def __init__(self, path: str, kind: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.byte = kind == "byte"
        self.load(path)
        for token in self.special:
            raw = np.frombuffer(token.encode(), np.uint8)
            if raw[:1] != ord("<") or len(cuts(raw, np.array([0, len(raw)]))) > 1:
                raise ValueError(f"the special token {token!r} would be cut")
        self.table = Table(np.uint16 if self.size <= 1 << 16 else np.uint32)

    def load(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = np.zeros(self.size, bool)  # ids that end a word, in the word kind
        if self.byte:
            (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        else:
            self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts by the library, one after the other, and how many each has."""
        got = [x.ids for at in range(0, len(texts), 4096) for x in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.uint32, int(count.sum())), count

    def _plain(self, piece: str) -> bool:
        """Whether the piece is one pre-token of letters and digits, or a few, that the library may see among others."""
        if self.byte:
            return piece.isalnum() or (piece[:1] == " " and piece[1:].isalnum())
        return piece.isalpha() and unicodedata.is_normalized("NFC", piece)

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As whole(), for plain pieces: encoded as one text and cut at the line ends between them, or, in the word kind, after the
        ids that end a word."""
        ids, count = [], []
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            got = np.array(self.tokenizer.encode_batch_fast(["".join([x + "\n" for x in part])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(got == self.line if self.byte else self.last[got])
            if len(ends) != len(part):
                got, n = self.whole(part)
            elif self.byte:
                got, n = np.delete(got, ends), np.diff(ends, prepend=-1) - 1
            else:
                n = np.diff(ends, prepend=-1)
            ids.append(got)
            count.append(n)
        return np.concatenate(ids), np.concatenate(count)

    def learned(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, one after the other, and how many each has."""
        plain = np.fromiter(map(self._plain, pieces), bool, len(pieces))
        if not plain.any():
            return self.whole(pieces)
        ids, count = self._joined([x for x, p in zip(pieces, plain.tolist(), strict=True) if p])
        if plain.all():
            return ids, count
        more, n = self.whole([x for x, p in zip(pieces, plain.tolist(), strict=True) if not p])
        every = np.concatenate([count, n])
        order = np.argsort(np.argsort(~plain, kind="stable"), kind="stable")  # back in the pieces' order
        first, every = (np.cumsum(every) - every)[order], every[order]
        return np.concatenate([ids, more])[ranges(first, every)], every

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), one after the other, and the bounds of each text's."""
        gc.disable()  # many small objects, none of them in cycles
        try:
            return self._encode(pc.fill_null(texts, ""))
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        wide = pa.types.is_large_string(texts.type)
        _, places, body = texts.buffers()
        bounds = np.frombuffer(places, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        low, bounds = int(bounds[0]), bounds - bounds[0]
        n = int(bounds[-1])
        data = np.zeros(n + 8, np.uint8)
        if n:
            data[:n] = np.frombuffer(body, np.uint8, n, low)
        starts = cuts(data[:n], bounds)
        ends = np.append(starts[1:], n)
        if not self.byte:  # no case, and no space before a word
            capital = (data >= 65) & (data <= 90)
            data[capital] |= 32
            begins = starts + (data[starts] == 32)
        else:
            begins = starts
        sizes = ends - begins
        one, two = hashes(data, begins, np.minimum(sizes, LONG))
        short = sizes <= LONG
        slot = np.full(len(starts), -1, np.int64)
        slot[short] = self.table.find(one[short], two[short])
        new = np.flatnonzero(short & (slot < 0))
        if new.size:
            _, first = np.unique(one[new], return_index=True)
            self.table.room(len(first), int(sizes[new[first]].sum()))
            if not self.table.n:  # it starts anew
                new = np.flatnonzero(short)
                _, first = np.unique(one[new], return_index=True)
                self.table.room(len(first), 0)
            first = new[first]
            ids, count = self.learned(self._texts(data, begins[first], ends[first]))
            self.table.add(one[first], two[first], ids, count)
            slot[short] = self.table.find(one[short], two[short])
        at, count = self.table.start[slot].astype(np.int64), self.table.count[slot].astype(np.int64)
        rest = np.flatnonzero(slot < 0)  # long pieces
        if rest.size:
            ids, n_ids = self.whole(self._texts(data, begins[rest], ends[rest]))
            at[rest] = self.table.write(ids, False) + np.cumsum(n_ids) - n_ids
            count[rest] = n_ids
        upto = np.append(0, np.cumsum(count))
        return self.table.pool[ranges(at, count)], upto[np.searchsorted(starts, bounds)]

    @staticmethod
    def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        raw = data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, bounds = self.encode_column(pa.array(texts, pa.large_string()))
        raw, at = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each, one after the other."""
    upto = np.cumsum(count)
    return np.repeat(start - (upto - count), count) + np.arange(int(upto[-1]) if len(upto) else 0)


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    return PieceEncoder(path, kind)
