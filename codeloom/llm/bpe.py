"""Operator 4: BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A pre-token is a row of symbols. Leaf i of its tree holds the merge rank of symbol i and its right neighbour together with i, so
the root is the leftmost pair of lowest rank. A merge changes three leaves, each updated along its path to the root; it ends
when the root has no rank. Short pre-tokens run together as the rows of a numpy matrix, long ones one by one.

Null text counts as empty: no ids, empty decoded text. Extra columns are not read; repeated rows give repeated rows.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm._shared import map_texts
from codeloom.llm.tokens import PieceEncoder, ranges

#: Pre-tokens of more symbols are merged one by one.
WIDE = 64
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    return [chr(b if b in plain else next(odd)) for b in range(256)]


class Vocabulary:
    """Merge ranks and token bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        ids = held["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        self.size = max([*ids.values(), *(t["id"] for t in held["added_tokens"])]) + 1
        pairs = [p if isinstance(p, list) else p.split(" ") for p in held["model"]["merges"]]
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        self.rank_of = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        self.keys, first = np.unique(keys, return_index=True)
        self.ranks = first.astype(np.int64)
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.decimal = [str(i) for i in range(self.size)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_rows(vocabulary: Vocabulary, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """symbols: a row of ids for each pre-token, width a power of two, sizes of them used; returns rows with -1 at merged places."""
    n, width = symbols.shape
    place = np.arange(width)
    right = np.where(place + 1 < sizes[:, None], place + 1, width) * np.ones((n, 1), np.int64)
    left = place - 1 + np.zeros((n, 1), np.int64)
    tree = np.full((n, 2 * width), NONE)
    ranks = vocabulary.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
    held = (ranks >= 0) & (place[1:] < sizes[:, None])
    tree[:, width:-1] = np.where(held, ranks * width + place[:-1], NONE)
    half = width
    while half > 1:
        tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
        half //= 2

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        at = leaf + width
        tree[rows, at] = value
        at = at >> 1
        while at[0]:  # all leaves are equally deep
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            at = at >> 1

    rows = np.flatnonzero(tree[:, 1] != NONE)
    while rows.size:
        root = tree[rows, 1]
        at = root % width
        new = vocabulary.made[root // width]
        gone = right[rows, at]
        after = right[rows, gone]
        symbols[rows, at], symbols[rows, gone] = new, -1
        right[rows, at] = after
        put(rows, gone, np.full(rows.size, NONE))
        more = after < width
        value = np.full(rows.size, NONE)
        if more.any():
            r, a, x = rows[more], at[more], after[more]
            left[r, x] = a
            rank = vocabulary.rank(new[more], symbols[r, x])
            value[more] = np.where(rank >= 0, rank * width + a, NONE)
        put(rows, at, value)
        before = left[rows, at]
        some = before >= 0
        if some.any():
            r, b = rows[some], before[some]
            rank = vocabulary.rank(symbols[r, b], new[some])
            put(r, b, np.where(rank >= 0, rank * width + b, NONE))
        rows = rows[tree[rows, 1] != NONE]
    return symbols


def merge_long(vocabulary: Vocabulary, symbols: list[int]) -> list[int]:
    """The same for one long pre-token."""
    n, size, rank_of = len(symbols), vocabulary.size, vocabulary.rank_of
    width = 1 << (n - 1).bit_length()
    none = (1 << 62, 0)
    tree = [none] * (2 * width)
    right, left = [*range(1, n), -1], [*range(-1, n - 1)]

    def leaf(i: int) -> tuple[int, int]:
        j = right[i]
        r = rank_of.get(symbols[i] * size + symbols[j]) if j >= 0 else None
        return none if r is None else (r, i)

    for i in range(n):
        tree[width + i] = leaf(i)
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    while tree[1] != none:
        rank, i = tree[1]
        j = right[i]
        symbols[i], symbols[j] = int(vocabulary.made[rank]), -1
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
        for k, value in ((j, none), (i, leaf(i)), *([(left[i], leaf(left[i]))] if left[i] >= 0 else [])):
            k += width
            tree[k] = value
            while k > 1:
                k >>= 1
                best = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == best:
                    break
                tree[k] = best
    return [x for x in symbols if x >= 0]


class TreeEncoder(PieceEncoder):
    """Cuts texts as PieceEncoder does; pre-tokens are merged by segment trees, not by the library."""

    def load(self, path: str) -> None:
        import public_tokenizers
        import regex

        self.vocabulary = Vocabulary(path)
        self.size, self.special = self.vocabulary.size, [*self.vocabulary.special]
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split

    def single(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after the other, and how many each has."""
        vocabulary = self.vocabulary
        raw = [t.encode() for t in tokens]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        got, count = [], np.zeros(len(raw), np.int64)
        for width in (2, 4, 8, 16, 32, WIDE):
            mine = np.flatnonzero((sizes <= width) & (sizes > (width // 2 if width > 2 else 0)))
            for at in range(0, mine.size, 16384):
                part = mine[at : at + 16384]
                table = np.frombuffer(b"".join([raw[i].ljust(width, b"\0") for i in part.tolist()]), np.uint8).reshape(-1, width)
                merged = merge_rows(vocabulary, vocabulary.byte_ids[table], sizes[part])
                keep = (merged >= 0) & (np.arange(width) < sizes[part][:, None])
                count[part] = keep.sum(1)
                got.append((part, merged[keep].astype(np.uint32)))
        for i in np.flatnonzero(sizes > WIDE).tolist():
            ids = np.array(merge_long(vocabulary, vocabulary.byte_ids[np.frombuffer(raw[i], np.uint8)].tolist()), np.uint32)
            count[i] = len(ids)
            got.append((np.array([i]), ids))
        out, before = np.zeros(int(count.sum()), np.uint32), np.cumsum(count) - count
        for part, ids in got:
            out[ranges(before[part], count[part])] = ids
        return out, count

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts by way of their pre-tokens, each distinct one merged once; special tokens have their own ids."""
        special, tokens, held = self.vocabulary.special, {}, []
        for text in texts:
            mine = []
            for part in self.at_special(text) if special and "<|" in text else [text]:
                mine += [part] if part in special else self.cut(part)
            held.append([tokens.setdefault(t, len(tokens)) for t in mine])
        ids, count = self.single([t for t in tokens if t not in special])
        if any(t in special for t in tokens):
            plain = np.array([t not in special for t in tokens])
            every = np.ones(len(tokens), np.int64)
            every[plain] = count
            out = np.zeros(int(every.sum()), np.uint32)
            first = np.cumsum(every) - every
            out[ranges(first[plain], count)] = ids
            out[first[~plain]] = [special[t] for t in tokens if t in special]
            ids, count = out, every
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        of = np.fromiter((i for x in held for i in x), np.int64, int(sizes.sum()))
        first = np.cumsum(count) - count
        upto = np.append(0, np.cumsum(count[of]))
        ends = np.cumsum(sizes)
        return ids[ranges(first[of], count[of])], upto[ends] - upto[ends - sizes]

    def learned(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.whole(pieces)

    def decode(self, ids: list[int]) -> str:
        """Token bytes joined; bytes that are no UTF-8 become U+FFFD, as in the library."""
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tree_encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path, "byte")


def encode_decode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (array of int, if with_ids), decoded (string), n_tokens, ids_sha256 of each document, in one pass."""

    def make():
        import hashlib

        e = tree_encoder(path)
        decimal = e.vocabulary.decimal.__getitem__

        def f(doc_ids, texts):
            ids, bounds = e.encode_column(texts)
            out = {"doc_id": doc_ids, "n_tokens": pa.array(np.diff(bounds)), "ids_sha256": [], "decoded": []}
            held = ids.tolist()
            for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                mine = held[a:b]
                out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal, mine)).encode()).hexdigest())
                out["decoded"].append(e.decode(mine))
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            return out

        return f

    return map_texts(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded string" + ", ids array<int>" * with_ids, make, arrow=True)
