"""Operator 7: token ids in patched frame-of-reference files.

A shard file holds blocks of BLOCK ids. A block keeps its minimum, the ids less the minimum packed at the width that holds 95 in
100 of them, and an exception list of positions and values for the rest. After the blocks come the documents (id, first token)
and the blocks' places, so both a document and a token range are found without reading the rest.

Shards are ranges of doc_id of about equal numbers of documents, as many as the bytes of text ask for. A task sorts its range and
streams it to a temporary file, then renames it: a task that runs twice writes the same bytes, and files of lost attempts are
removed at the end. The files are written with pyarrow.fs to the store that Spark takes the shared folder for.

Rows without doc_id come first, whatever ids there are; equal doc_ids are ordered by their ids, repeated rows are stored each.
Null text counts as empty (the end id alone). A text of any length goes through blocks of BLOCK ids. Extra columns are not read.
No documents give no shards and no rows.
"""

from __future__ import annotations

import contextlib
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm._shared import binaries, map_texts, new_path, values

BLOCK, END, MAGIC = 4096, 2, b"CLPF"
_HEAD = struct.Struct("<IHHB")  # minimum, ids, exceptions, width
_FOOT = struct.Struct("<QQQQQ4s")  # documents, of these without doc_id, ids, blocks, where the tables begin
#: Bytes of text of a shard, and the most shards (beyond it they grow; a task streams its shard and holds only the tables).
SHARD, MOST = 16 << 20, 20_000


def pack_block(ids: np.ndarray, share: float = 0.95) -> bytes:
    low = int(ids.min())
    over = (ids - low).astype("<u4")
    width = int(np.sort(over)[min(len(over) - 1, int(share * len(over)))]).bit_length()
    odd = np.flatnonzero(over >> width) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(over.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return _HEAD.pack(low, len(ids), len(odd), width) + np.packbits(bits, bitorder="little").tobytes() + odd.astype("<u2").tobytes() + over[odd].tobytes()


def unpack_block(data: bytes) -> np.ndarray:
    low, n, odd, width = _HEAD.unpack_from(data)
    at = _HEAD.size
    size = (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: n * width].reshape(n, width)
    over = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    over[np.frombuffer(data, "<u2", odd, at + size)] = np.frombuffer(data, "<u4", odd, at + size + 2 * odd)
    return over + np.uint32(low)


class ShardWriter:
    """Blocks go out as they fill; only the tables stay in memory (16 bytes a document)."""

    def __init__(self, out):
        self.out, self.rest, self.held, self.n = out, [], 0, 0
        self.docs, self.starts, self.places, self.at, self.nulls = array("q"), array("q"), array("q"), 0, 0

    def _blocks(self, ids: np.ndarray) -> None:
        for i in range(0, len(ids), BLOCK):
            data = pack_block(ids[i : i + BLOCK])
            self.places.append(self.at)
            self.out.write(data)
            self.at += len(data)

    def add(self, docs: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents (those without an id come before all others) with their ids, one after the other."""
        self.nulls += docs.null_count
        self.docs.frombytes(docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        self.starts.frombytes((self.n + bounds[:-1]).astype("<i8").tobytes())
        self.n += len(ids)
        self.rest.append(ids.astype("<u4"))
        self.held += len(ids)
        if self.held >= 16 * BLOCK:
            every = np.concatenate(self.rest)
            full = len(every) // BLOCK * BLOCK
            self._blocks(every[:full])
            self.rest, self.held = [every[full:]], len(every) - full

    def close(self) -> None:
        if self.rest:
            self._blocks(np.concatenate(self.rest))
        for table in (self.docs, self.starts, self.places):
            self.out.write(table.tobytes())
        self.out.write(_FOOT.pack(len(self.docs), self.nulls, self.n, len(self.places), self.at, MAGIC))


class ShardReader:
    """f: a file with seek and read."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - _FOOT.size)
        docs, self.nulls, self.n, blocks, self.tables, magic = _FOOT.unpack(f.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        f.seek(self.tables)
        table = np.frombuffer(f.read(8 * (2 * docs + blocks)), "<i8")
        self.docs, self.starts = table[:docs], np.append(table[docs : 2 * docs], self.n)
        self.places = np.append(table[2 * docs :], self.tables)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids of a token range, from its blocks alone."""
        if end <= start:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK, (end - 1) // BLOCK
        self.f.seek(int(self.places[first]))
        data = self.f.read(int(self.places[last + 1] - self.places[first]))
        at = (self.places[first : last + 2] - self.places[first]).tolist()
        got = np.concatenate([unpack_block(data[a:b]) for a, b in zip(at, at[1:], strict=False)])
        return got[start - first * BLOCK : end - first * BLOCK]

    def documents(self, step: int = 64 * BLOCK) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """doc_ids, bounds in the shard, and ids, of documents that hold about step ids together."""
        i = 0
        while i < len(self.docs):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + step, side="right")) - 1)
            j = min(j, len(self.docs))
            named = pa.array(self.docs[i:j], pa.int64(), mask=np.arange(i, j) < self.nulls)
            yield named, self.starts[i : j + 1], self.ids(int(self.starts[i]), int(self.starts[j]))
            i = j


#: What pyarrow calls the stores that Spark knows by other names.
_SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark gives it, so that the workers write to the same store; a store that pyarrow cannot
    write is refused here and not in a task."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    scheme, _, rest = str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)).partition(":")
    if scheme not in _SCHEMES:
        raise ValueError(f"token files cannot be written to {scheme}: set spark.checkpoint.dir to one of {', '.join(_SCHEMES)}")
    return f"{_SCHEMES[scheme]}://{rest.removeprefix('//')}"


def write_shards(docs: DataFrame, path: str, folder: str, end: int = END, size: int = SHARD) -> list[tuple[int, str, int, int]]:
    """Writes shards of about `size` bytes of text; (shard, file, documents, ids) of each, in ascending doc_id order: a row a file,
    the only thing that is collected."""
    from pyarrow import fs
    from tokenizers import Tokenizer

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST, max(1, -(-total // size)))
    cuts = docs.select(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], max(10_000, 50 * shards))).first()[0] if shards > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)

    # ids of a vocabulary of up to 65,536 travel to their shard as 16-bit numbers
    kind = "<u2" if max(end, Tokenizer.from_file(path).get_vocab_size() - 1) < 1 << 16 else "<u4"

    def make():
        from codeloom.llm.tokens import encoder

        e = encoder(path, "byte")

        def f(doc_ids, texts):
            # ids without a doc_id belong to the first shard
            named = doc_ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            ids, ends = e.encode_column(texts)
            ends = ends + np.arange(len(ends))  # each text has the end id, too
            every = np.full(int(ends[-1]), end, kind)
            own = np.ones(len(every), bool)
            own[ends[1:] - 1] = False
            every[own] = ids
            return {"doc_id": doc_ids, "shard": pa.array(np.searchsorted(bounds, named, side="left").astype(np.int32)), "ids": binaries(every, ends)}

        return f

    def write(batches):
        from pyspark import TaskContext

        writer = None
        for b in batches:
            if not b.num_rows:
                continue
            shard = b.column("shard").to_numpy()
            if writer is None:
                store, top = fs.FileSystem.from_uri(folder)
                number = int(shard[0])
                final, mine = f"{top}/shard-{number:08d}.pfor", f"{top}/.shard-{number:08d}-{uuid.uuid4().hex}"
                writer = ShardWriter(store.open_output_stream(mine))
            assert (shard == number).all(), (number, TaskContext.get().partitionId())
            writer.add(b.column("doc_id"), *values(b.column("ids"), kind))
        if writer is not None:
            writer.close()
            writer.out.close()
            try:
                store.move(mine, final)
            except OSError:
                if store.get_file_info(final).type == fs.FileType.NotFound:
                    raise
                store.delete_file(mine)  # another attempt was first
            yield pa.RecordBatch.from_pydict({"shard": [number], "file": [f"shard-{number:08d}.pfor"], "docs": [len(writer.docs)], "n": [writer.n]})

    encoded = map_texts(docs, "doc_id long, shard int, ids binary", make, arrow=True)
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    written = sorted(tuple(r) for r in dealt.mapInArrow(write, "shard long, file string, docs long, n long").collect())
    for left in store.get_file_info(fs.FileSelector(top)):  # of attempts that were lost half-way
        if left.base_name.startswith(".shard-"):
            with contextlib.suppress(OSError):
                store.delete_file(left.path)
    return written


def read_shards(docs: DataFrame, folder: str, manifest: list[tuple[int, str, int, int]]) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit) of every document, read from the files."""
    rows, start = [], 0
    for _, file, _, n in manifest:
        rows.append((file, start))
        start += n
    files = docs.sparkSession.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))

    def read(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                with store.open_input_file(f"{top}/{file}") as f:
                    for named, places, ids in ShardReader(f, f.size()).documents():
                        held = binaries(ids.astype("<u4", copy=False), places - places[0])
                        yield pa.RecordBatch.from_arrays([named, pa.array(base + places[:-1]), held], ["doc_id", "start", "ids"])

    return files.mapInArrow(read, "doc_id long, start long, ids binary")


def store_and_read(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    folder = qualified(docs.sparkSession, new_path(docs.sparkSession, "tokens"))
    return read_shards(docs, folder, write_shards(docs, path, folder, end))
