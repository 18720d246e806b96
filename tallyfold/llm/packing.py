"""Packing documents into training sequences by lexical retrieval.

Documents become token ids once.  They are dealt to shards by a min-hash of their rarer tokens, so
that documents with words in common tend to meet, in ranges of bounded size: any number of equal
documents is split by their ids.  Each shard holds a BM25 inverted index of its documents, with the
document frequencies of the whole corpus.  A sequence starts with a seed document (or what is left
of one that was cut); the index returns the seed's unused neighbours by all of its terms, best first,
a page at a time; those that fit go in, and the best one of a page that doesn't is cut to fill the
window.  What remains at a shard's end goes into
sequences whose lengths are powers of two, so that nothing is padded.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, forget
from .common import STEP_BYTES, Scratch, slices, text_or_empty
from .words import mix

WINDOW = 4096
#: Ids of a shard, about.
SHARD_TOKENS = 4_000_000
#: Neighbours on a page; more pages are asked for until the window is full.
NEIGHBOURS = 32
K1, B = 1.2, 0.75
DENSE = 8
#: Ids below this one are frequent word parts; they don't say in which shard a document goes.
FREQUENT_IDS = 5000

_U_MAX = np.iinfo(np.uint64).max
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Rows of documents (``ids``: uint16 or uint32 bytes, the end id last), and per task one row of
    document frequencies by token id (null ``ids``); every id but the appended end is a term."""

    def run(batches):
        enc = encoder(tokenizer_path)
        top = max(enc.vocab, end_id + 1)
        dtype = "<u2" if top <= 1 << 16 else "<u4"
        often = np.zeros(top, "i8")
        spread = mix(np.arange(top, dtype=np.uint64)) >> np.uint64(1)
        rare = np.where(np.arange(top) >= FREQUENT_IDS, spread, _U_MAX)
        for batch in batches:
            for part in slices(batch, "text", 4 * STEP_BYTES):
                found, n = enc.column(part.column("text"))
                first = np.cumsum(n + 1) - (n + 1)
                ids = np.full(len(found) + len(n), end_id, dtype)
                own = np.ones(len(ids), bool)
                own[first + n] = False
                ids[own] = found
                doc = np.repeat(np.arange(len(n)), n)
                often += np.bincount(np.unique(doc * top + found) % top, minlength=top)
                near = np.minimum.reduceat(rare[ids], first)
                near = np.where(near == _U_MAX, np.minimum.reduceat(spread[ids], first), near)
                places = np.append(first, len(ids)).astype("i4") * ids.itemsize
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"), "n": pa.array(n + 1), "near": pa.array(near.view("i8")),
                        "ids": pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(places), pa.py_buffer(ids)]),
                        "df": pa.nulls(len(n), pa.list_(pa.int64())),
                    }
                )
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.nulls(1, pa.int64()), "n": pa.array([0], pa.int64()), "near": pa.array([0], pa.int64()),
                "ids": pa.nulls(1, pa.binary()), "df": pa.array([often.tolist()], pa.list_(pa.int64())),
            }
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, near long, ids binary, df array<long>")


class Index:
    """BM25 over the documents of one shard; ``idf`` by token id comes from the whole corpus, and an id
    of idf 0 is no term.

    A term's list holds its documents and their weights.  The list of a term that a ``DENSE``-th of all
    documents have is a row with a weight for each document, which is added up as it is."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray):
        self.n, vocab = len(docs), len(idf)
        size = np.array([len(d) for d in docs])
        every = np.concatenate(docs)
        key = np.repeat(np.arange(self.n) * vocab, size) + every
        key, tf = np.unique(key[idf[every] > 0], return_counts=True)
        owner, term = np.divmod(key, vocab)
        self.first, self.terms = np.searchsorted(owner, np.arange(self.n + 1)), term
        norm = K1 * (1 - B + B * size / size.mean())
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[owner])).astype("f4")
        df = np.bincount(term, minlength=vocab)
        often = np.flatnonzero(df * DENSE > self.n)
        self.row = np.full(vocab, -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n), "f4")
        here = self.row[term] >= 0
        self.dense[self.row[term[here]], owner[here]] = weight[here]
        order = np.argsort(term[~here], kind="stable")
        self.all = term[~here][order], owner[~here][order], weight[~here][order]
        self.vocab = vocab
        self._keep(np.ones(self.n, bool))

    def _keep(self, live: np.ndarray) -> None:
        """Postings of these documents only, which are numbered anew."""
        term, owner, weight = self.all
        self.live, self.docs = live, np.flatnonzero(live)
        self.rows = self.dense if live.all() else np.take(self.dense, self.docs, axis=1)
        kept = live[owner]
        self.owner, self.weight = (np.cumsum(live) - 1)[owner[kept]], weight[kept]
        self.at = np.searchsorted(term[kept], np.arange(self.vocab + 1))

    def neighbours(self, seed: int, free: np.ndarray, most: int = NEIGHBOURS) -> np.ndarray:
        """Unused documents that share a term with the seed, best first by all of its terms."""
        if (free & ~self.live).any() or 4 * np.count_nonzero(free) < 3 * len(self.docs):
            self._keep(free.copy())  # used documents leave the lists
        terms = self.terms[self.first[seed] : self.first[seed + 1]]
        row = self.row[terms]
        spans = [slice(a, b) for a, b in zip(self.at[terms].tolist(), self.at[terms + 1].tolist(), strict=True) if a < b]
        score = np.zeros(len(self.docs), "f4")
        if spans:
            owner, weight = np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans])
            score += np.bincount(owner, weights=weight, minlength=len(score))
        for r in row[row >= 0].tolist():
            score += self.rows[r]
        score *= free[self.docs]
        found = np.flatnonzero(score)
        if len(found) > most:
            found = found[score[found] >= np.partition(score[found], -most)[-most]]
        return self.docs[found[np.lexsort((found, -score[found]))[:most]]]


def pack_shard(sizes: list[int], neighbours, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover every id once.

    ``neighbours(seed, free)`` gives a page of unused documents, best first, and an empty one if there
    are no more.
    """
    free = np.ones(len(sizes), bool)
    pieces, sequence, fill = [], 0, 0
    next_, cut = 0, None  # a document that was cut: (document, ids used)
    while True:
        if cut is None:
            while next_ < len(sizes) and not free[next_]:
                next_ += 1
            if next_ == len(sizes):
                break
            cut = (next_, 0)
            free[next_] = False
        seed, used = cut
        take = min(sizes[seed] - used, window - fill)
        pieces.append((seed, used, take, sequence, fill))
        fill += take
        cut = (seed, used + take) if used + take < sizes[seed] else None
        rest, page = [], None
        while fill < window and not rest and page != []:
            page = neighbours(seed, free).tolist()
            for d in page:
                if sizes[d] <= window - fill:
                    free[d] = False
                    pieces.append((d, 0, sizes[d], sequence, fill))
                    fill += sizes[d]
                    if fill == window:
                        break
                else:
                    rest.append(d)
        if fill < window and rest:
            free[rest[0]] = False
            cut = (rest[0], 0)
            continue
        if fill == window:
            sequence, fill = sequence + 1, 0
    return _powers_of_two(pieces, sequence, fill)


def _powers_of_two(pieces: list, last: int, fill: int) -> list:
    """The unfilled last sequence, cut into sequences whose lengths are powers of two."""
    if fill & (fill - 1) == 0:
        return pieces
    out = [p for p in pieces if p[3] < last]
    sequence, room, offset = last, 1 << (fill.bit_length() - 1), 0
    for d, start, length, _, _ in pieces[len(out) :]:
        while length:
            take = min(length, room - offset)
            out.append((d, start, take, sequence, offset))
            start, length, offset, fill = start + take, length - take, offset + take, fill - take
            if offset == room and fill:
                sequence, room, offset = sequence + 1, 1 << (fill.bit_length() - 1), 0
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  A null or empty text is the end
    id alone.  Rows that repeat, or share an id, are packed as documents of their own, and a null id
    stays null.  Neighbours with the same score are taken in the order of their places in the shard.  A text
    of any length is encoded whole and cut into as many pieces as it needs.  An empty table has no pieces.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    encoded = scratch.save(encode(docs, tokenizer_path, end_id), "ids")
    rows = encoded.filter("ids is not null").select("doc_id", "n", "near", "ids")
    total = rows.agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).first()
    by_id = encoded.filter("ids is null").select(F.posexplode("df").alias("id", "df")).filter("df > 0").groupBy("id").agg(F.sum("df").alias("df"))
    df = {r.id: r.df for r in by_id.collect()}  # a number for each id of the vocabulary at most
    vocab = max(encoder(tokenizer_path).vocab, end_id + 1)
    idf = np.zeros(vocab)
    for i, n in df.items():
        idf[i] = math.log(1 + (total.docs - n + 0.5) / (n + 0.5))
    idf[end_id] = 0  # every document has it
    wide = "<u2" if vocab <= 1 << 16 else "<u4"
    shards = max(1, math.ceil((total.tokens or 0) / shard_tokens))
    dealt = rows.repartitionByRange(shards, "near", "doc_id", F.xxhash64("ids")).sortWithinPartitions("near", "doc_id", "ids")
    # numbers a partition's sequences; a retried task numbers them alike
    dealt = dealt.withColumn("shard", F.spark_partition_id())

    def run(batches):
        forget()
        held: list[pa.RecordBatch] = []
        size, part, shard = 0, 0, 0

        def flush():
            ids = [np.frombuffer(x.as_buffer(), wide) for b in held for x in b.column("ids")]
            names = [x for b in held for x in b.column("doc_id").to_pylist()]
            sizes = [len(x) for x in ids]
            index = Index(ids, idf)
            found = pack_shard(sizes, index.neighbours, window)
            base = (shard << 32) + (part << 24)
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([names[p[0]] for p in found], pa.int64()),
                    "start": pa.array([p[1] for p in found], pa.int64()),
                    "length": pa.array([p[2] for p in found], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in found], pa.int64()),
                    "doc_tokens": pa.array([sizes[p[0]] for p in found], pa.int64()),
                    "sequence_id": pa.array([base + p[3] for p in found], pa.int64()),
                    "offset": pa.array([p[4] for p in found], pa.int64()),
                }
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard")[0].as_py()
            for piece in slices(batch, "ids", STEP_BYTES):
                held.append(piece)
                size += sum(piece.column("n").to_pylist())
                if size >= 2 * shard_tokens:  # a range that came out larger than meant
                    yield flush()
                    held, size, part = [], 0, part + 1
        if held:
            yield flush()

    # however finely the session deals ranges out, the result has a file per shard of the meant size
    return dealt.mapInArrow(run, _PIECES).coalesce(shards)
