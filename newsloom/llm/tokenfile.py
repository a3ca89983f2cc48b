"""Token ids in compressed binary blocks (operator 10).

A block holds consecutive documents by ascending ``doc_id``. Each document's ids, two or four
bytes each, are one zstandard frame of its own, made with a dictionary shared by all blocks and
trained on serialized id arrays, so that a short document is small and can be read alone. A
block is little endian throughout:

    magic "NLTK", version u16, bytes per id u16, dictionary SHA-256 (32 bytes), documents u32
    doc_id i64 for each document
    number of ids u32 for each document
    offset u64 for each document and one more: where its frame starts after this header
    frames

Blocks are the rows of a Parquet table (``part, block, first_id, before, n_tokens, data``; before:
ids of the earlier blocks of the part), written and read by Spark alone, so any store will do. The dictionary is the table ``dictionary`` beside it.
"""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from newsloom.llm.tables import documents, give_back, slices
from newsloom.llm.tokens import encoder

END_ID = 2
MAGIC = b"NLTK"
HEAD = struct.Struct("<4sHH32sI")
#: A block is closed once it holds this many ids.
BLOCK_IDS = 1 << 20
#: Texts, and characters of them, whose pieces are looked up at once: the more, the fewer are looked up twice.
ROUND_ROWS = 4000
ROUND_CHARS = 1 << 24
#: The dictionary is trained on the leading ids of so many documents, the first by hash of id.
TRAIN_DOCUMENTS = 512
TRAIN_CHARS = 4096
DICTIONARY_BYTES = 1 << 16
BLOCK_SCHEMA = "part int, block int, first_id long, before long, n_tokens long, data binary"


def train_dictionary(docs, vocabulary, width):
    """Dictionary bytes from a bounded sample; plain content where there is too little to train on."""
    # about four times as many candidates as are taken, so that tasks send few of them
    every = max(1, docs.count() // (4 * TRAIN_DOCUMENTS))
    sample = (
        docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) & (F.col("text") != ""))
        .select("doc_id", F.substring("text", 1, TRAIN_CHARS).alias("text"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRAIN_DOCUMENTS)
        .collect()
    )
    encoded = encoder(vocabulary, spaces_matter=True).encode_all([r["text"] for r in sample])
    arrays = [np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() for ids in encoded]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(arrays) or bytes(8))[:DICTIONARY_BYTES]


def pack_block(rows, dictionary, width):
    """``rows``: (doc_id, ids as u4 bytes). One block as bytes."""
    shared = zstandard.ZstdCompressionDict(dictionary)
    packer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
    frames = [
        packer.compress(ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
        for _, ids in rows
    ]
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    return b"".join(
        [
            HEAD.pack(MAGIC, 1, width, hashlib.sha256(dictionary).digest(), len(rows)),
            np.array([r[0] for r in rows], "<i8").tobytes(),
            np.array([len(r[1]) // 4 for r in rows], "<u4").tobytes(),
            offsets.tobytes(),
            *frames,
        ]
    )


class Block:
    """Read access to one block; ``ids(k)`` opens the frame of document k alone."""

    def __init__(self, data, dictionary):
        magic, version, self.width, digest, n = HEAD.unpack_from(data)
        if (magic, version) != (MAGIC, 1):
            raise ValueError("not a token block")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.lengths = np.frombuffer(data, "<u4", n, at + 8 * n)
        self._offsets = np.frombuffer(data, "<u8", n + 1, at + 12 * n)
        self._frames = memoryview(data)[at + 20 * n + 8 :]
        shared = zstandard.ZstdCompressionDict(dictionary)
        self._open = zstandard.ZstdDecompressor(dict_data=shared).decompress

    def ids(self, k):
        raw = self._open(self._frames[self._offsets[k] : self._offsets[k + 1]])
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write_tokens(docs, path, vocabulary, end_id=END_ID, partitions=None):
    """Write the blocks and the dictionary of all documents under ``path``.

    A null or empty text has the end id alone; equal ``doc_id`` rows stay rows of their own.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    docs = documents(docs)
    size = Tokenizer.from_file(vocabulary).get_vocab_size()
    width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, vocabulary, width)
    spark.createDataFrame([(dictionary,)], "data binary").write.parquet(f"{path}/dictionary")
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches):
        ids_of = encoder(vocabulary, spaces_matter=True)
        part, block, before, rows, n = TaskContext.get().partitionId(), 0, 0, [], 0

        def closed():
            row = [part, block, rows[0][0], before, n, pack_block(rows, dictionary, width)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, kinds)],
                names=["part", "block", "first_id", "before", "n_tokens", "data"],
            )

        for batch in slices(batches, ROUND_ROWS):
            texts = batch["text"].to_pylist()
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), ids_of.encode_all(texts, ROUND_CHARS)):
                ids += end
                rows.append((doc_id, ids))
                n += len(ids) // 4
                if n >= BLOCK_IDS:
                    yield closed()
                    block, before, rows, n = block + 1, before + n, [], 0
        if rows:
            yield closed()
        # the remembered pieces stay for the worker's next task: most of its pieces are the same
        give_back()

    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    in_order.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")


def read_tokens(spark, path, with_ids=True):
    """One row per document: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``."""
    dictionary = spark.read.parquet(f"{path}/dictionary").first()[0]
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # one total for each writing task, so at most as many as tasks
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, so_far = [], 0
    for r in totals:
        starts.append((r["part"], so_far))
        so_far += r["n"]
    starts = spark.createDataFrame(starts, "part int, part_start long")
    def opened(batches):
        for batch in batches:
            for base, data in zip(batch["base"].to_pylist(), batch["data"].to_pylist()):
                block = Block(data, dictionary)
                starts = base + np.concatenate([[0], np.cumsum(block.lengths[:-1], dtype=np.int64)])
                ids = [block.ids(k) for k in range(len(block.doc_ids))]
                columns = [
                    pa.array(block.doc_ids, pa.int64()),
                    pa.array(starts[: len(ids)], pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return (
        blocks.join(F.broadcast(starts), "part")
        .select((F.col("before") + F.col("part_start")).alias("base"), "data")
        .mapInArrow(opened, schema + (", ids array<int>" if with_ids else ""))
    )
