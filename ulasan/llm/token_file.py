"""Token ids in frequency-ranked, byte-aligned variable-length files (operator 12).

Writing: texts become ids by the ``tokenizers`` library (one end id behind each)
and are written once as plain ids. Occurrences of every id are summed over all
documents, and ids are numbered by falling frequency, so the ids used most get
the numbers that fit one byte. The documents are then range-partitioned and
sorted by id, and each task writes its part of the order as blocks of whole
documents: every number takes 1 to 4 bytes in the data bytes, and its length
takes two bits in the separate control bytes, four numbers to a control byte.

A token file set is a folder of Parquet tables, so Spark's committer publishes
each file once, whatever executor is lost, on any store that Spark writes:

- ``blocks``: ``part`` and ``block`` (order), ``first`` (ids of the part before
  the block), ``doc_ids``, ``sizes`` (ids of each document), ``control``, ``data``;
- ``ranks``: the id of every number;
- ``parts``: the ids before each part.

Reading: a table of 256 rows gives the four lengths of a control byte; all bytes
of a block are gathered by numpy at once, and numbers become ids again.

Memory is bounded by a block (at least ``BLOCK_IDS`` ids) and the longest text.
The frequency table has the size of the vocabulary.

Edge cases: NULL text counts as empty (the end id alone); a NULL document id
comes first; repeated ids are ordered by their digest, equal rows being
interchangeable; an empty table gives an empty set; special tokens written in a
text become their ids, as the library does. Other columns are not read.
"""
from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import shuffle_partitions, utf8, whole_text
from .pieces import PieceTokenizer

BLOCK_IDS = 1 << 20
#: Pieces kept with their ids in each worker.
MEMO = 1_000_000
#: White space of three UTF-8 bytes.
WIDE_BLANK = re.compile(rb"\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80").finditer

#: Lengths of the four numbers of every control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)

BLOCK_SCHEMA = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())),
    T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])


def pack_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    numbers = np.ascontiguousarray(numbers, dtype="<u4")
    n = len(numbers)
    codes = np.zeros(-(-n // 4) * 4, dtype=np.uint8)
    codes[:n] = (numbers > 0xFF).view(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    used = np.arange(4) <= codes[:n, None]
    return control.tobytes(), numbers.view(np.uint8).reshape(n, 4)[used].tobytes()


def unpack_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of a control and a data stream."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(4, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        long = np.flatnonzero(size > k)
        out[long] |= raw[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class LibraryTokenizer(PieceTokenizer):
    """Ids of whole texts by the library, each distinct piece encoded once and
    kept. Byte-level patterns begin a piece at a space before a visible
    character and between letters, digits and ASCII marks. Texts with white
    space beyond ASCII are cut at their words by the pattern ``words``; texts
    that hold a special token's string, and tokenizers with another splitting,
    go to the library as they are."""

    def __init__(self, spec: str):
        import json

        from tokenizers import Tokenizer

        lib = Tokenizer.from_str(spec)
        lib.no_truncation()
        lib.no_padding()
        said = json.loads(spec)
        pre = said.get("pre_tokenizer") or {}
        self.by_word = (said.get("normalizer") is None and pre.get("type") == "ByteLevel"
                        and not pre.get("add_prefix_space") and pre.get("use_regex", True))
        self.special = [t["content"].encode() for t in said.get("added_tokens", [])]
        self.words = regex.compile(r" ?\S+|\s+(?!\S)|\s+").findall
        super().__init__(lib, id_type(lib.get_vocab_size()), MEMO, True, blanks=True, lower=False, single_digits=False)

    def _apart(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which texts hold a special token, and which white space beyond ASCII."""
        special, wide = np.zeros((2, len(offsets) - 1), dtype=bool)
        if not self.by_word:
            special[:] = True
            return special, wide
        data = raw.tobytes()
        found = [m.start() for token in self.special for m in re.finditer(re.escape(token), data)]
        special[np.searchsorted(offsets, found, "right") - 1] = True
        at = [np.array([m.start() for m in WIDE_BLANK(data)], dtype=np.int64)] if (raw >= 0xE1).any() else []
        two = np.flatnonzero(raw[:-1] == 0xC2)
        at.append(two[(raw[two + 1] == 0x85) | (raw[two + 1] == 0xA0)])
        wide[np.searchsorted(offsets, np.concatenate(at), "right") - 1] = True
        return special, wide & ~special

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text (see ``utf8``), as little-endian integers of ``dtype``."""
        special, wide = self._apart(raw, offsets)
        apart = special | wide
        if not apart.any():
            return super().encode(raw, offsets)
        size = np.diff(offsets)
        plain = super().encode(raw[np.repeat(~apart, size)], np.concatenate([[0], np.cumsum(size[~apart])]))
        text = lambda i: raw[offsets[i]:offsets[i + 1]].tobytes().decode()
        out: list[bytes] = [b""] * len(size)
        for i, ids in zip(np.flatnonzero(~apart).tolist(), plain):
            out[i] = ids
        whole = np.flatnonzero(special).tolist()
        for i, ids in zip(whole, self.by_library([text(i) for i in whole])):
            out[i] = array(self.dtype.char, ids).tobytes()
        for i in np.flatnonzero(wide).tolist():
            out[i] = self.gather(pa.array(self.words(text(i)), pa.large_string()))[0].tobytes()
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return self.encode(*utf8(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"]), "text"))


def id_type(vocabulary: int) -> np.dtype:
    """Two bytes an id where they are enough, else four."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


_WORKER: dict[int, LibraryTokenizer] = {}


def encode_documents(df: DataFrame, tokenizer: str, dtype: np.dtype, end_id: int = 0) -> DataFrame:
    """``(doc_id, ids)``: the whole text's ids and the end id, as little-endian
    integers of ``dtype``; ``tokenizer`` is the content of its file."""
    spark = df.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer)
    key, end = zlib.crc32(tokenizer.encode()), np.array([end_id], dtype=dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _WORKER:
            _WORKER[key] = LibraryTokenizer(spec.value)
        for batch in batches:
            ids = _WORKER[key].encode(*utf8(batch, "text"))
            if _WORKER[key].dtype != dtype:
                ids = [np.frombuffer(x, _WORKER[key].dtype).astype(dtype).tobytes() for x in ids]
            ids = [x + end for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, ids binary")


def _ids(value, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=dtype)


def id_counts(encoded: DataFrame, dtype: np.dtype) -> DataFrame:
    """``(id, n)``: occurrences of every id over all documents; each task sends
    one row an id it met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            got = np.bincount(utf8(batch, "ids")[0].view(dtype), minlength=len(total))
            got[:len(total)] += total
            total = got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(df: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Write the token file set of ``df`` ``(doc_id, text)`` to the folder ``path``."""
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    dtype = id_type(max(LibraryTokenizer(tokenizer).lib.get_vocab_size(), end_id + 1))
    encoded = materialize(encode_documents(df, tokenizer, dtype, end_id), "token-ids", "zstd")
    counts = id_counts(encoded, dtype).orderBy(F.desc("n"), "id")
    # as many rows as the vocabulary has ids
    ranked = [r[0] for r in counts.select("id").collect()]
    spark.createDataFrame([(ranked,)], "ids array<long>").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max(ranked, default=0) + 1, dtype=np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank)

    def block(part: int, k: int, first: int, docs: list, values: list[np.ndarray]) -> pa.RecordBatch:
        control, data = pack_numbers(ranks.value[np.concatenate(values)])
        row = [[part], [k], [first], [docs], [[len(v) for v in values]], [control], [data]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=BLOCK_SCHEMA.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, first, held = TaskContext.get().partitionId(), 0, 0, 0
        docs: list = []
        values: list[np.ndarray] = []
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc)
                values.append(_ids(value, dtype))
                held += len(values[-1])
                if held >= block_ids:
                    yield block(part, k, first, docs, values)
                    k, first, held, docs, values = k + 1, first + held, 0, [], []
        if docs:
            yield block(part, k, first, docs, values)

    order = ["doc_id", "digest", "salt"]
    dealt = encoded.withColumns({"digest": F.xxhash64("ids"), "salt": F.rand(12)}).repartitionByRange(
        shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    # the streams are dense already
    dealt.select("doc_id", "ids").mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row a part
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of a token file set:
    ``start`` counts the ids of all documents before, ``ids_crc32`` is that of
    the little-endian unsigned 32-bit ids."""
    ranked = spark.read.parquet(f"{path}/ranks").first()    # one row, as long as the vocabulary
    id_of = spark.sparkContext.broadcast(np.array(ranked[0] if ranked else [], dtype="<u4"))
    names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, docs, sizes, control, data = (batch.column(c)[row] for c in range(6))
                sizes = sizes.values.to_numpy()
                ends = np.cumsum(sizes)
                found = id_of.value[unpack_numbers(control.as_buffer(), data.as_buffer(), int(ends[-1]))]
                raw = memoryview(found.tobytes())
                own = [raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
                out = [pa.array(np.full(len(sizes), part.as_py(), dtype=np.int32)), docs.values, pa.array(first.as_py() + ends - sizes),
                       pa.array(sizes), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                if ids:
                    places = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    out.append(pa.ListArray.from_arrays(places, pa.array(found.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "first", "doc_ids", "sizes", "control", "data")
    # one row a part, so its size is that of the partition count
    return (blocks.mapInArrow(run, schema).join(F.broadcast(spark.read.parquet(f"{path}/parts")), "part")
            .select("doc_id", (F.col("before") + F.col("at")).alias("start"), *names[3:]))
