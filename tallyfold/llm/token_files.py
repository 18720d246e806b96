"""Token ids as flat binary files, with 64-bit document offsets.

Layout of one shard in the output folder (all little-endian):

``shard-NNNNN.ids``   the ids of its documents one after the other, uint16 where the vocabulary
                      allows it, else uint32
``shard-NNNNN.off``   uint64, one more than documents: where each document starts within the shard
``shard-NNNNN.doc``   int64 document ids, then one byte each: 1 where the id is known, 0 where null

Shards hold consecutive ranges of documents in ascending ``doc_id``.  A shard's base, the number of
ids in all shards before it, is a prefix sum over the shards' counts, kept in the manifest; base
plus offset is a document's place in the whole corpus.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Scratch, slices, text_or_empty

_MANIFEST = "shard int, n_docs long, n_tokens long, width int"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, n_shards: int | None = None) -> DataFrame:
    """Writes ``docs`` (``doc_id``, ``text``) to ``folder`` and returns the manifest, a lazy frame
    of one row per shard (run it once and keep it).

    A null or empty text is the end id alone.  A null ``doc_id`` sorts first; rows that share an id
    keep one place each, in the order of their texts; equal rows are the same in either order.  A text of any
    length is encoded whole.  An empty table leaves no shard.  A retried or
    repeated task writes under a name of its own and moves the finished files into place.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = (rows.repartitionByRange(n_shards, *keys) if n_shards else rows.repartitionByRange(*keys)).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"
    )
    with_shard = ordered.withColumn("shard", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        dtype = "<u2" if max(enc.vocab, end_id + 1) <= 1 << 16 else "<u4"
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        end = np.array([end_id], "<u4").tobytes()
        out, shard, at, offsets, ids_, known = None, None, 0, [], [], []
        own = uuid.uuid4().hex
        for batch in batches:
            for part in slices(batch, "text"):
                if out is None:
                    shard = part.column("shard")[0].as_py()
                    out = fs.open_output_stream(f"{root}/.{own}.ids")
                docs_ = part.column("doc_id")
                known.append(np.asarray(docs_.is_valid()).astype("u1"))
                ids_.append(docs_.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                raws = enc.ids(part.column("text").to_pylist())
                out.write(np.frombuffer(end.join([*raws, b""]), "<u4").astype(dtype).tobytes())
                for raw in raws:
                    offsets.append(at)
                    at += len(raw) // 4 + 1
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{root}/.{own}.off") as f:
            f.write(np.array([*offsets, at], "<u8").tobytes())
        with fs.open_output_stream(f"{root}/.{own}.doc") as f:
            f.write(np.concatenate(ids_).tobytes() + np.concatenate(known).tobytes())
        for kind in ("off", "doc", "ids"):
            fs.move(f"{root}/.{own}.{kind}", f"{root}/shard-{shard:05d}.{kind}")
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "n_docs": pa.array([len(offsets)], pa.int64()),
                "n_tokens": pa.array([at], pa.int64()),
                "width": pa.array([np.dtype(dtype).itemsize], pa.int32()),
            }
        )

    return with_shard.mapInArrow(write, _MANIFEST)


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with each shard's base: the ids of all shards before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _mapped(fs: pafs.FileSystem, path: str, dtype: str, tmp: str) -> np.ndarray:
    """The file as a memory map; one that isn't local is copied to the task's folder first."""
    if not isinstance(fs, pafs.LocalFileSystem):
        local = os.path.join(tmp, os.path.basename(path))
        pafs.copy_files(path, local, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
        path = local
    if os.path.getsize(path) == 0:
        return np.empty(0, dtype)
    return np.memmap(path, dtype=dtype, mode="r")


def read_shards(manifest: DataFrame, folder: str, step_docs: int = 20_000) -> DataFrame:
    """Per document of the files: its id, start in the corpus, number of ids and the crc32 of its
    ids as little-endian uint32.  ``manifest`` needs the columns of ``with_bases``."""

    def read(batches):
        fs, root = _fs(folder)
        for batch in batches:
            for m in batch.to_pylist():
                with tempfile.TemporaryDirectory() as tmp:
                    name = f"{root}/shard-{m['shard']:05d}"
                    ids = _mapped(fs, f"{name}.ids", f"<u{m['width']}", tmp)
                    off = _mapped(fs, f"{name}.off", "<u8", tmp)
                    raw = _mapped(fs, f"{name}.doc", "u1", tmp)
                    n = m["n_docs"]
                    doc, valid = raw[: 8 * n].view("<i8"), raw[8 * n :]
                    if len(off) != n + 1 or int(off[n]) != len(ids):
                        raise ValueError(f"{name}: the files don't agree with the manifest")
                    for a in range(0, n, step_docs):
                        b = min(n, a + step_docs)
                        places = off[a : b + 1].astype("i8")
                        crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(places[:-1], places[1:], strict=True)]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(np.array(doc[a:b]), pa.int64(), mask=np.array(valid[a:b]) == 0),
                                "start": pa.array(places[:-1] + m["base"], pa.int64()),
                                "n_tokens": pa.array(np.diff(places), pa.int64()),
                                "ids_crc32": pa.array(crc, pa.int64()),
                            }
                        )
                    del ids, off, raw, doc, valid

    return manifest.mapInArrow(read, _READ)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the token files and reads them back; see ``write_shards`` and ``read_shards``."""
    scratch = Scratch(docs.sparkSession, "token-files")
    folder = folder or scratch.path("shards")
    manifest = scratch.save(write_shards(docs, folder, tokenizer_path, end_id), "manifest")
    based = scratch.save(with_bases(manifest), "bases")
    spread = based.repartition(max(1, based.count()), "shard")
    return read_shards(spread, folder)
