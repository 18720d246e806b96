"""Exact token counts of whole texts, huge ones in overlapping chunks.

A huge text is encoded in overlapping chunks with offsets.  Two neighbouring encodings are spliced
at a boundary that is proven stable: a place where both start a token, right before a space that
follows something else than a space.  No piece of the vocabulary joins a space to something before
it (checked when the model is opened), so the merges on either side of such a place never see the
other side, and the encodings agree with the whole text's from there on.  Where an overlap has no
such place, it is widened, in the end to the rest of the text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, prepare, text_or_empty

#: Characters of a chunk, and of the overlap that is tried first.
CHUNK = 40_000
OVERLAP = 400

_open: dict[str, object] = {}


def tokens_of_huge(
    text: str,
    encode: Callable[[str, bool], np.ndarray],
    joins_at: Callable[[str, int], bool],
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> int:
    """Number of tokens of ``text``.

    ``encode(part, first)`` gives the character offsets at which the tokens of ``part`` start (a
    character of several tokens has its offset several times); ``joins_at(text, i)``: whether a
    token may join what is before place ``i`` with what follows.
    """
    total, start, first = 0, 0, True
    while True:
        # [start, mid) belongs to this chunk; [mid, end) is the overlap with the next one.
        mid, wide = start + chunk, overlap
        while True:
            end = min(len(text), mid + wide)
            here = encode(text[start:end], first) + start
            if end == len(text):
                return total + len(here)
            after = encode(text[mid : min(len(text), end + wide)], False) + mid
            cut = _common(text, here, after, mid, end, joins_at)
            if cut is not None:
                break
            wide *= 2
        total += int(np.searchsorted(here, cut, "left"))
        start, first = cut, False


def _common(text, here, after, mid, end, joins_at):
    """The first stable boundary inside the overlap that both encodings have."""
    both = np.intersect1d(here[(here > mid) & (here < end)], after)
    return next((int(i) for i in both if not joins_at(text, int(i))), None)


class PieceCounter:
    """Counts of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        inner = any("▁" in p.piece.lstrip("▁") for p in model.pieces)
        #: Whether chunks can be spliced at all: text is used as it is, and spaces only begin pieces.
        self.splices = spec.name == "identity" and not spec.remove_extra_whitespaces and not inner
        self.dummy = spec.add_dummy_prefix

    def starts(self, part: str, first: bool) -> np.ndarray:
        if not first and self.dummy and part[:1] == " ":
            # the encoder adds a space of its own; the one that is there stands for it
            return self._starts(part[1:]) + np.int64(1) if len(part) > 1 else np.zeros(1, "i8")
        return self._starts(part)

    def _starts(self, part: str) -> np.ndarray:
        at, out, raw = 0, [], self.sp.encode(part, out_type=str)
        pad = 1 if self.dummy else 0
        rest = 0
        for piece in raw:
            out.append(max(0, at - pad))
            if len(piece) == 6 and piece.startswith("<0x"):  # one byte of a character
                byte = int(piece[3:5], 16)
                rest = rest - 1 if rest else (0 if byte < 0x80 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3)
                at += not rest
            else:
                at += len(piece)
        return np.array(out, "i8")

    @staticmethod
    def joins_at(text: str, i: int) -> bool:
        return text[i] != " " or text[i - 1] in " ▁"

    def count(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= 2 * chunk or not self.splices]
        out = [0] * len(texts)
        for i, ids in zip(short, self.sp.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i in set(range(len(texts))).difference(short):
            out[i] = tokens_of_huge(texts[i], self.starts, self.joins_at, chunk, overlap)
        return out


def piece_counter(path: str) -> PieceCounter:
    if path not in _open:
        _open[path] = PieceCounter(path)
    return _open[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): bytes, tokens, and whether they exceed ``limit``.

    Row by row, so repeated rows, ties and null ids give one row each; a null text counts as empty
    (0 bytes, 0 tokens); other columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def kernel(part: pa.RecordBatch) -> dict:
        texts = part.column("text")
        return {
            "doc_id": part.column("doc_id"),
            "n_bytes": pc.cast(pc.binary_length(texts), pa.int64()),
            "n_tokens": piece_counter(model_path).count(texts.to_pylist(), chunk, overlap),
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    counted = rows.mapInArrow(by_slices("text", schema, kernel), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
