"""Byte-level BPE encoding and decoding with a local rank file.

Long texts are cut before a space or newline that follows a letter, digit, mark, symbol
or punctuation character. No match of the split pattern crosses such a place and none
looks back, so the ids are those of the whole text.

Defined results: a null text is encoded as the empty text (no ids); empty texts have no
ids; repeated rows are encoded each by itself; null ids of documents stay null; columns
other than the two named are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of more code points than this are cut at safe boundaries.
LONG = 1 << 16
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{M}\p{P}\p{S}])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, target: int = LONG) -> Iterator[str]:
    """Pieces of about target code points that can be encoded one by one."""
    at = 0
    while len(text) - at > target:
        cut = _SAFE.search(text, at + target)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


#: White space that is cut out by hand.
_RUN = regex.compile(r"\p{White_Space}{4096,}+")


def without_long_runs(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of the text one after another, and whether a part is a single match of white space."""
    at = 0
    for m in _RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() > at:
            yield text[at : m.start()], False
        yield text[m.start() : end], True
        at = end
    if at < len(text):
        yield text[at:], False


def encode_text(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part, run in without_long_runs(text):
        if run:
            out += enc._encode_single_piece(part.encode())
        else:
            for piece in safe_pieces(part):
                out += enc.encode_ordinary(piece)
    return out


def _small(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that few texts and ids are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; one pass, no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for whole in batches:
            for batch in _small(whole):
                ids = [np.asarray(encode_text(enc, t), np.int32) for t in batch.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=["id", "ids"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return out.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary): the raw bytes of each row of ids; null ids give no bytes."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for whole in batches:
            for batch in _small(whole):
                rows = batch.column(1)
                flat, ends = rows.values.to_numpy(), rows.offsets.to_numpy()
                got = [enc.decode_bytes(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(got, pa.binary())], names=["id", "ids", "decoded"])

    out = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return out.mapInArrow(run, f"id {id_type}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    back = decode(encode(docs, rank_path, pattern), rank_path, pattern)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
