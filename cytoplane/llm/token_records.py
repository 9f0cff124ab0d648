"""Operator 10: token ids as length-delimited binary records with masked checksums and an offset index.

A record is: length (8 bytes), masked CRC-32C of these 8 bytes (4), the data, masked CRC-32C of the data (4), all
little-endian. The data of a sequence is its doc_id (8 bytes), the number of ids (4; its top bit marks a null doc_id) and
the ids, 2 bytes each where the vocabulary allows it, else 4. Beside each file lies an index: the offset of every record as 8 bytes, so that a
reader can fetch records in any order.

Documents are dealt out by ranges of doc_id, as many as there are shuffle partitions or, on large input, as make about
`SHARD_BYTES` of text each, and each task writes one file under a name of its own attempt to the
shared folder; only files of tasks that ended well enter the manifest, so lost or repeated tasks leave no trace in it.

Null text counts as empty (only the end id); repeated doc_ids are each written, in order of their text; rows with a
null doc_id come first, and the id is read back as null; an empty table gives no rows; columns other than doc_id and text are ignored."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import new_path, partitions, small_batches, staged
from .tokens import encoder

MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
SHARD_BYTES = 512 << 20
_CHUNK = 64
_NULL = 1 << 31


def _crc_tables() -> np.ndarray:
    """Eight tables of the Castagnoli polynomial: table k is the state after a byte and k zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    out = [t]
    for _ in range(7):
        out.append(t[out[-1] & 255] ^ (out[-1] >> 8))
    return np.stack(out)


_T = _crc_tables()


def _zeros(n: int) -> np.ndarray:
    """What n zero bytes make of a state, by its four bytes."""
    out = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(n):
        out = _T[0][out & 255] ^ (out >> 8)
    return out


_SKIP = _zeros(_CHUNK)


def masked_crc32c(records: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each byte string of 4 bytes or more. All 64-byte chunks of all strings are run through the
    tables side by side; a string's chunks are then joined by the matrix of 64 zero bytes."""
    sizes = np.array([len(r) for r in records], np.int64)
    chunks = -(-sizes // _CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)])
    buf = np.zeros(int(first[-1]) * _CHUNK, np.uint8)
    for r, end, n in zip(records, first[1:], sizes):
        buf[end * _CHUNK - n : end * _CHUNK] = np.frombuffer(r, np.uint8)
    head = (first[1:] * _CHUNK - sizes)[:, None] + np.arange(4)
    buf[head] ^= 255
    words = buf.reshape(-1, _CHUNK)
    s = np.zeros(len(words), np.uint32)
    for k in range(0, _CHUNK, 8):
        x = words[:, k : k + 8]
        nxt = _T[3][x[:, 4]] ^ _T[2][x[:, 5]] ^ _T[1][x[:, 6]] ^ _T[0][x[:, 7]]
        for j in range(4):
            nxt ^= _T[7 - j][x[:, j] ^ ((s >> np.uint32(8 * j)) & np.uint32(255)).astype(np.uint8)]
        s = nxt
    order = np.argsort(-chunks, kind="stable")
    state, left = np.zeros(len(records), np.uint32), chunks[order]
    begin = first[:-1][order]
    for k in range(int(chunks.max(initial=0))):
        n = int(np.searchsorted(-left, -k, side="left"))
        a = state[:n]
        state[:n] = _SKIP[0][a & 255] ^ _SKIP[1][(a >> 8) & 255] ^ _SKIP[2][(a >> 16) & 255] ^ _SKIP[3][a >> 24] ^ s[begin[:n] + k]
    crc = np.empty_like(state)
    crc[order] = ~state
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(data: list[bytes]) -> list[bytes]:
    sizes = [len(d).to_bytes(8, "little") for d in data]
    a, b = masked_crc32c(sizes).astype("<u4"), masked_crc32c(data).astype("<u4")
    return [s + x.tobytes() + d + y.tobytes() for s, x, d, y in zip(sizes, a, data, b)]


def unframe(raw: bytes, offsets: np.ndarray) -> list[bytes]:
    """The data of the records of raw that start at offsets, every checksum tested."""
    sizes = [raw[o : o + 8] for o in offsets]
    data = [raw[o + 12 : o + 12 + int.from_bytes(s, "little")] for o, s in zip(offsets, sizes)]
    stored = np.array([(int.from_bytes(raw[o + 8 : o + 12], "little"), int.from_bytes(raw[o + 12 + len(d) : o + 16 + len(d)], "little")) for o, d in zip(offsets, data)], np.uint32).reshape(-1, 2)
    if any(len(d) != int.from_bytes(s, "little") for d, s in zip(data, sizes)) or (masked_crc32c(sizes) != stored[:, 0]).any() or (masked_crc32c(data) != stored[:, 1]).any():
        raise ValueError("a record is damaged")
    return data


def _store(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 1, drop_space: bool = True, width: int = 2) -> DataFrame:
    """Writes the files and their indexes; returns the manifest, a row for each file, in order of shard."""
    spark = docs.sparkSession
    small_batches(spark, 2000)
    folder = new_path(spark, "records")
    end = end_id.to_bytes(width, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        fs, root = _store(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/part-{shard:05d}-{uuid.uuid4().hex[:8]}.rec"
        enc = encoder(tokenizer, drop_space)
        at, n_docs, n_ids, out, offsets = 0, 0, 0, None, []
        for b in batches:
            if not b.num_rows:
                continue
            out = out or fs.open_output_stream(path)
            ids = [i + end for i in enc.encode_many(b.column(1))]
            framed = frame([(d or 0).to_bytes(8, "little", signed=True) + (len(i) // width | (_NULL if d is None else 0)).to_bytes(4, "little") + i for d, i in zip(b.column(0).to_pylist(), ids)])
            size = np.array([len(f) for f in framed], np.int64)
            offsets.append(at + np.cumsum(size) - size)
            out.write(b"".join(framed))
            at, n_docs, n_ids = at + int(size.sum()), n_docs + len(ids), n_ids + sum(map(len, ids)) // width
        if out:
            out.close()
            with fs.open_output_stream(f"{path}.index") as f:
                f.write(np.concatenate(offsets).astype("<i8").tobytes())
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": n_docs, "n_ids": n_ids, "n_bytes": at}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(spark), -(-size // SHARD_BYTES))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(dealt.mapInArrow(work, MANIFEST), "manifest").withColumn("uri", F.lit(folder))


def read_records(manifest: DataFrame, width: int = 2, block: int = 8_000_000) -> DataFrame:
    """The files of a manifest, read back record by record, checksums tested; start: ids in the records before."""
    spark = manifest.sparkSession
    # one row for each file: the running sum is over as many rows as there are files
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, _ = _store(row["uri"])
                with fs.open_input_stream(f"{row['path']}.index") as f:
                    offsets = np.append(np.frombuffer(f.read(), "<i8"), row["n_bytes"])
                start, k = row["base"], 0
                with fs.open_input_file(row["path"]) as f:
                    while k < len(offsets) - 1:
                        n = max(k + 1, int(np.searchsorted(offsets, offsets[k] + block)) - 1)
                        f.seek(int(offsets[k]))
                        data = unframe(f.read(int(offsets[n] - offsets[k])), offsets[k:n] - offsets[k])
                        ids = [np.frombuffer(d, f"<u{width}", offset=12) for d in data]
                        size = np.array([len(i) for i in ids], np.int64)
                        if any(int.from_bytes(d[8:12], "little") & ~_NULL != len(i) for d, i in zip(data, ids)):
                            raise ValueError("a sequence is damaged")
                        yield pa.RecordBatch.from_arrays([pa.array(list(map(_doc_id, data)), pa.int64()), pa.array(start + np.cumsum(size) - size), pa.array(size), pa.array([zlib.crc32(i.astype("<u4")) for i in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start, k = start + int(size.sum()), n

    return placed.repartition(partitions(spark)).mapInArrow(work, RESULT)


def _doc_id(data: bytes) -> int | None:
    return None if int.from_bytes(data[8:12], "little") & _NULL else int.from_bytes(data[:8], "little", signed=True)


def fetch(path: str, numbers: list[int], width: int = 2) -> list[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the records of one file by their numbers, in any order, by the offset index."""
    fs, root = _store(path)
    with fs.open_input_stream(f"{root}.index") as f:
        offsets = np.append(np.frombuffer(f.read(), "<i8"), fs.get_file_info(root).size)
    out = []
    with fs.open_input_file(root) as f:
        for k in numbers:
            f.seek(int(offsets[k]))
            d = unframe(f.read(int(offsets[k + 1] - offsets[k])), np.zeros(1, np.int64))[0]
            out.append((_doc_id(d), np.frombuffer(d, f"<u{width}", offset=12)))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_records(write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
