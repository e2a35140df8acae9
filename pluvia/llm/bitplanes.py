"""Token-id files with shuffled bit or byte planes.

Documents are range-partitioned and sorted by id, so shard n holds smaller ids than shard
n+1. A shard is a run of chunks; a chunk holds whole documents. The ids of a chunk are cut
into fixed-size blocks (the last one padded with zeros), each block is transposed into
32 bit planes or 4 byte planes, and each plane is compressed with zstandard. The chunk
index (shard, chunk, first position, documents and their lengths) stands beside the planes,
so a reader can fetch any document, or only the index.

The container is Parquet written by Spark: its commit protocol keeps retried tasks from
leaving half files, and any store that Spark reads will do.

Defined results: null texts count as empty; every document ends with one end id, so an
empty one has length 1; null document ids come first; documents of one id stand in the order
of their texts.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.llm.common import materialise, remove, shared_dir, width

BLOCK = 4096
#: A chunk is closed once it holds so many ids.
CHUNK = 1 << 17
#: Documents encoded together.
TOGETHER = 1024
INDEX = "shard int, chunk int, first long, n_ids long, doc_ids array<long>, lengths array<long>"

#: A space before more white space, and what may be a special token: such texts go to the library
#: whole. In all others every space starts a match of the pre-tokenizer, as no run of white space
#: has a space but at its end.
_ODD = re.compile(r" (?=\s)|<\|")
#: Marks that end a match when they follow letters and are matches of their own at a word's end.
_MARKS = frozenset(".,;:!?")


class FileTokenizer:
    """The tokenizers library with a memo of the ids (as bytes) of words seen before.

    A word is what stands between two spaces; its ids are those of a space and it. The memo has two
    generations of at most `bound` words of at most LONGEST code points, which bounds its bytes. A
    word that is met again moves to the younger one; when that is full it becomes the older one,
    whose words are forgotten, so frequent words stay. Words not in it are encoded many in a call,
    one behind the other, and told apart by the bytes that ids stand for; letters with a mark at
    the end are the letters and the mark.
    """

    LONGEST = 48
    #: Words encoded as one text.
    RUN = 200

    def __init__(self, path: str, bound: int = 700_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        #: Bytes that each id stands for: a character each in a byte-level vocabulary.
        self.bytes = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], np.int64)
        self.marks = {m: self._whole(m) for m in _MARKS}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bound = bound

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words (each after a space) that the memo lacks."""
        # No word, or one with white space at an end, is not put among others.
        inner = [w for w in words if w and w == w.strip()]
        found = {w: self._whole(" " + w) for w in words if not w or w != w.strip()}
        runs = [inner[i : i + self.RUN] for i in range(0, len(inner), self.RUN)]
        texts = [" " + " ".join(r) for r in runs]
        for run, e in zip(runs, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            ends = np.cumsum(pc.binary_length(pa.array(run)).to_numpy() + 1)
            cuts = ((np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1) * 4).tolist()
            raw = ids.tobytes()
            found.update(zip(run, (raw[a:b] for a, b in zip([0, *cuts], cuts)), strict=True))
        return found

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of each of these distinct words, after a space."""
        young, old = self.young, self.old
        got = list(map(young.get, words))
        missing = [i for i, g in enumerate(got) if g is None]
        more, marked = set(), []
        for i in missing:
            w = words[i]
            known = old.get(w)
            if known is None:
                letters = w[:-1]
                if w[-1:] in _MARKS and letters.isalpha():
                    marked.append(i)
                    if letters not in young and letters not in old:
                        more.add(letters)
                else:
                    more.add(w)
                continue
            young[w] = got[i] = known
        here = self._fresh(list(more))
        young.update((w, ids) for w, ids in here.items() if len(w) <= self.LONGEST)
        of = lambda w: here[w] if w in here else young[w] if w in young else old[w]
        for i in marked:
            w = words[i]
            got[i] = of(w[:-1]) + self.marks[w[-1]]
            if len(w) <= self.LONGEST:
                young[w] = got[i]
        for i in missing:
            if got[i] is None:
                got[i] = here[words[i]]
        if len(young) > self.bound:
            self.young, self.old = {}, young
        return got

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        odd = [bool(_ODD.search(t)) for t in texts]
        whole = iter(self.library.encode_batch_fast([t for t, o in zip(texts, odd, strict=True) if o], add_special_tokens=False))
        cut = pc.split_pattern(pa.array([t for t, o in zip(texts, odd, strict=True) if not o], pa.string()), " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        which = coded.indices.to_numpy().copy()
        # A text's first word stands after nothing.
        firsts = [words[i] for i in which[bounds[:-1]].tolist()]
        which[bounds[:-1]] = len(words) + np.arange(len(firsts))
        starts = [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(firsts, add_special_tokens=False)]
        table = self._known(words) + starts
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), "<u4")
        begin = (np.cumsum(sizes) - sizes).astype(np.int32)
        each = sizes[which]
        ends = np.cumsum(each)
        ids = flat[np.repeat(begin[which] - (ends - each).astype(np.int32), each) + np.arange(int(each.sum()), dtype=np.int32)]
        edges = np.concatenate([[0], ends])[bounds]
        plain = (ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return [np.asarray(next(whole).ids, "<u4") if o else next(plain) for o in odd]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> FileTokenizer:
    return FileTokenizer(path)


def pack(ids: np.ndarray, kind: str = "byte", block: int = BLOCK, level: int = 1) -> list[bytes]:
    """The compressed planes of ids (uint32), block after block."""
    compressor, out = zstandard.ZstdCompressor(level=level), []
    for at in range(0, len(ids), block):
        part = np.zeros(block, "<u4")
        part[: len(ids) - at] = ids[at : at + block]
        rows = part.view(np.uint8).reshape(block, 4)
        if kind == "bit":
            planes = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
        else:
            planes = np.ascontiguousarray(rows.T)
        out += [compressor.compress(p.tobytes()) for p in planes]
    return out


def unpack(planes: list[bytes], n_ids: int, kind: str = "byte", block: int = BLOCK) -> np.ndarray:
    """The ids that pack was given."""
    per, d, out = (32 if kind == "bit" else 4), zstandard.ZstdDecompressor(), []
    for at in range(0, len(planes), per):
        raw = [np.frombuffer(d.decompress(p), np.uint8) for p in planes[at : at + per]]
        if kind == "bit":
            bits = np.stack([np.unpackbits(p, bitorder="little") for p in raw], axis=1)
            rows = np.packbits(bits, axis=1, bitorder="little")
        else:
            rows = np.ascontiguousarray(np.stack(raw, axis=1))
        out.append(rows.reshape(-1).view("<u4"))
    return np.concatenate(out)[:n_ids] if out else np.empty(0, "<u4")


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, kind: str = "byte", shards: int | None = None) -> None:
    """Encode every document and write the shards in ascending order of doc_id."""
    n = shards or width(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, shard = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        state = {"chunk": 0, "first": 0, "held": 0}

        def close() -> pd.DataFrame:
            flat = np.concatenate(held)
            row = {"shard": shard, "chunk": state["chunk"], "first": state["first"], "n_ids": len(flat), "doc_ids": list(ids), "lengths": [len(x) for x in held], "planes": pack(flat, kind)}
            state["chunk"] += 1
            state["first"] += len(flat)
            state["held"] = 0
            held.clear()
            ids.clear()
            return pd.DataFrame([row])

        end = np.asarray([end_id], "<u4")
        for frame in frames:
            for at in range(0, len(frame), TOGETHER):
                part = frame.iloc[at : at + TOGETHER]
                for doc_id, got in zip(part["doc_id"], tok.encode_batch(part["text"].tolist()), strict=True):
                    one = np.concatenate([got, end])
                    held.append(one)
                    ids.append(None if pd.isna(doc_id) else int(doc_id))
                    state["held"] += len(one)
                    if state["held"] >= CHUNK:
                        yield close()
        if held:
            yield close()

    # Rows of one id, or of none, are dealt out by their texts, and repeated rows one by one.
    keyed = rows.withColumns({"start": F.substring("text", 1, 32), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(n, F.asc_nulls_first("doc_id"), "start", "row").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    ordered.select("doc_id", "text").mapInPandas(run, INDEX + ", planes array<binary>").write.option("compression", "none").parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index alone; the planes are not read."""
    return spark.read.schema(INDEX).parquet(path)


def read(spark: SparkSession, path: str, kind: str = "byte") -> DataFrame:
    """(doc_id, start, ids as little-endian 32-bit integers) of every document in the files."""
    totals = chunk_index(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row for each shard: their number is a setting, not a size of the data.
    bases = totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    chunks = spark.read.schema(INDEX + ", planes array<binary>").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["planes"], r["n_ids"], kind)
                ends = np.cumsum(np.asarray(r["lengths"], np.int64))
                starts = ends - np.asarray(r["lengths"], np.int64)
                blobs = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["base"] + r["first"] + starts), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "ids"])

    return chunks.join(F.broadcast(bases), "shard").mapInArrow(run, "doc_id long, start long, ids binary")


def write_and_digest(docs: DataFrame, tokenizer_path: str, kind: str = "byte") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the files, which go afterwards."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, tokenizer_path, path, kind=kind)
    back = read(spark, path, kind).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    out = materialise(back, "id-digests")
    remove(spark, path)
    return out


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
