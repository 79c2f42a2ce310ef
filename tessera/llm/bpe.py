"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding. Texts are split into pre-tokens by the vocabulary's pattern. A chunk is a run of documents of
one input split whose distinct words fit a bounded dictionary. Chunks are cut into blocks of about `block`
characters; each block lists the words that are new in its chunk and, for each document, the places of
its pre-tokens in the chunk's dictionary. The lists are dealt out by a hash of the word, a row for each
block and bucket; the task of a bucket sees every occurrence of its words in the corpus, encodes each
distinct word once (again only if it has seen `CACHE` others since) and answers with ids. Answers and places
are joined by chunk (a cogroup), and documents are put together by position. A frequent word is in each
chunk's dictionary once, so no word is a hot key.

Places travel once. For that the texts are split twice, and a split of the input must give its rows in the
same order each time it is read, as scans do; each block's words are checked by a checksum that comes both
ways, so that an input which doesn't keep its order fails instead of getting wrong ids.

Decoding joins the table of token bytes, a fixed file of some 50,000 rows that every task holds.

Null texts count as empty and have no ids. Rows that repeat are encoded alike. An empty table gives an
empty result. Texts and words may have any length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, tokens

BLOCK = 1_000_000
#: A chunk ends with the block that brings it to so many words or so many blocks.
DICTIONARY = 500_000
BLOCKS = 16
CACHE = 1_000_000
#: words: those of a block that are new in its chunk and fall to a bucket, one after the other; sizes: their lengths.
WORDS = "chunk long, block int, bucket int, check long, sizes array<int>, words string"
#: ids: those of a list's words, unsigned 16-bit; sizes: how many each word has.
ANSWERS = "chunk long, block int, bucket int, check long, sizes array<int>, ids array<smallint>"
#: A block's documents, how many words each has, and the words' places: the low and high 16 bits of each.
PLACES = "chunk long, block int, check long, doc_ids array<long>, counts array<int>, low array<smallint>, high array<smallint>"
_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<smallint>": pa.list_(pa.int16()),
}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(f.split() for f in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(columns, types)], list(names))


def ragged(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The stretches [start, start + size) of flat, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]


class Chunk:
    """A dictionary of words and the blocks of documents that it was made from."""

    def __init__(self, number: int, buckets: int, placed: bool):
        self.number, self.buckets, self.placed = number, buckets, placed
        self.known: dict[str, int] = {}
        self.blocks = 0
        self._begin()

    def _begin(self) -> None:
        self.first = len(self.known)
        self.ids: list[int | None] = []
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        known, number, words = self.known, self.known.setdefault, tokens.pattern().findall(text)
        if self.placed:
            self.places.append(np.array([number(w, len(known)) for w in words], dtype=np.int32))
        else:
            for word in dict.fromkeys(words):
                number(word, len(known))
        self.ids.append(doc_id)
        self.size += len(text)

    def end_block(self) -> tuple[list[str], np.ndarray, int]:
        """The block's new words in order of bucket, the places where buckets begin, and the checksum.
        New words are numbered anew in that order, as their answers arrive."""
        words = list(islice(self.known, self.first, None))
        bucket = np.fromiter((zlib.crc32(w.encode()) % self.buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        self.rank = np.empty(len(words), dtype=np.int32)
        self.rank[order] = np.arange(self.first, self.first + len(words))
        self.known.update(zip(words, self.rank.tolist()))
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        words = [words[i] for i in order.tolist()]
        return words, cuts, zlib.crc32("\n".join(words).encode())

    def word_rows(self) -> list[tuple]:
        words, cuts, check = self.end_block()
        rows = []
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            some = words[cuts[b] : cuts[b + 1]]
            rows.append((self.number, self.blocks, b, check, list(map(len, some)), "".join(some)))
        self.blocks += 1
        self._begin()
        return rows

    def place_rows(self) -> list[tuple]:
        first = self.first
        _, _, check = self.end_block()
        flat = np.concatenate(self.places)
        new = flat >= first
        flat[new] = self.rank[flat[new] - first]
        low, high = (flat & 0xFFFF).astype(np.uint16).view(np.int16), (flat >> 16).astype(np.int16)
        rows = [(self.number, self.blocks, check, self.ids, list(map(len, self.places)), low, high)]
        self.blocks += 1
        self._begin()
        return rows


def split_blocks(docs: DataFrame, schema: str, block: int, buckets: int, dictionary: int) -> DataFrame:
    """The rows of WORDS or of PLACES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        placed = schema == PLACES
        rows_of = Chunk.place_rows if placed else Chunk.word_rows
        for batch in batches:
            for doc_id, text, part in zip(*map(common.each, batch.columns)):
                chunk = chunk or Chunk(part << 24, buckets, placed)
                chunk.add(doc_id, text)
                if chunk.size >= block:
                    yield _batch(rows_of(chunk), schema)
                    if len(chunk.known) > dictionary or chunk.blocks == BLOCKS:
                        chunk = Chunk(chunk.number + 1, buckets, placed)
        if chunk and chunk.ids:
            yield _batch(rows_of(chunk), schema)

    # the scan's own partition: a union may number its tasks otherwise
    return common.texts(docs).withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, schema)


def encode_words(lists: DataFrame) -> DataFrame:
    """Answers the word lists of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            rows = []
            for *key, lengths, text in zip(*map(common.each, batch.columns)):
                at, flat, sizes = 0, [], []
                for n in lengths:
                    word = text[at : at + n]
                    at += n
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= CACHE:
                            known.clear()
                        ids = known[word] = tokens.encode_piece(word)
                    flat += ids
                    sizes.append(len(ids))
                rows.append((*key, sizes, np.array(flat, dtype=np.uint16).view(np.int16)))
            yield _batch(rows, ANSWERS)

    return lists.mapInArrow(run, ANSWERS)


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def put_together(answers: pa.Table, places: pa.Table) -> pa.Table:
    """The ids of a chunk's documents."""
    answers, places = answers.sort_by([("block", "ascending"), ("bucket", "ascending")]), places.sort_by("block")
    checks = dict(zip(answers.column("block").to_pylist(), answers.column("check").to_pylist()))
    for block, check in zip(places.column("block").to_pylist(), places.column("check").to_pylist()):
        if checks.pop(block, 0) != check:
            raise RuntimeError("a split of the input gave other rows, or another order, when read again: write the input first")
    if checks:
        raise RuntimeError("a split of the input gave fewer rows when read again: write the input first")
    table, size = _flat(answers, "ids").view(np.uint16), _flat(answers, "sizes").astype(np.int64)
    starts = np.cumsum(size) - size
    ids, out = [], []
    for k in range(places.num_rows):
        row = places.slice(k, 1)
        at = _flat(row, "low").view(np.uint16).astype(np.int64) | _flat(row, "high").astype(np.int64) << 16
        ids += row.column("doc_ids")[0].as_py()
        cut = 0
        for n in row.column("counts")[0].as_py():
            some = at[cut : cut + n]
            cut += n
            out.append(ragged(starts[some], size[some], table).tobytes())
    lengths = pa.array([len(x) // 2 for x in out], pa.int64())
    return pa.Table.from_arrays([pa.array(ids, pa.int64()), lengths, pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids"])


def by_chunk(docs: DataFrame, block: int = BLOCK, buckets: int | None = None, dictionary: int = DICTIONARY):
    """The answers and the places of each chunk, joined."""
    buckets = buckets or common.partitions(docs.sparkSession)
    lists = split_blocks(docs, WORDS, block, buckets, dictionary).repartitionById(buckets, F.col("bucket"))
    places = split_blocks(docs, PLACES, block, buckets, dictionary)
    return encode_words(lists).groupBy("chunk").cogroup(places.groupBy("chunk"))


def encode(docs: DataFrame, block: int = BLOCK, buckets: int | None = None, dictionary: int = DICTIONARY) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of docs; ids are unsigned 16-bit, little-endian."""
    return by_chunk(docs, block, buckets, dictionary).applyInArrow(put_together, "doc_id long, n_tokens long, ids binary")


class ByteTable:
    """A stretch of bytes for each id."""

    def __init__(self, stretches: list[bytes]):
        self.sizes = np.array([len(s) for s in stretches], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(stretches), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        return b"".join(
            ragged(self.starts[some], self.sizes[some], self.flat).tobytes() for some in (ids[i : i + (1 << 16)] for i in range(0, len(ids), 1 << 16))
        )


@lru_cache(maxsize=1)
def token_table() -> ByteTable:
    ranks = tokens.token_bytes()
    return ByteTable([t for t, _ in sorted(ranks.items(), key=lambda x: x[1])])


@lru_cache(maxsize=1)
def decimal_table() -> ByteTable:
    return ByteTable([b"%d " % i for i in range(len(tokens.token_bytes()))])


def decoded(ids: bytes) -> bytes:
    return token_table().join(np.frombuffer(ids, "<u2"))


def decode(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids, data): encoded with the bytes that its ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.array([decoded(x.as_py()) for x in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, data], ["doc_id", "n_tokens", "ids", "data"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids binary, data binary")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding and decoding docs, chunk by chunk as ids are there."""

    def run(answers: pa.Table, places: pa.Table) -> pa.Table:
        encoded = put_together(answers, places)
        listed, data = [], []
        for ids in common.each(encoded.column("ids")):
            listed.append(hashlib.sha256(decimal_table().join(np.frombuffer(ids, "<u2"))[:-1]).hexdigest())
            data.append(hashlib.sha256(decoded(ids)).hexdigest())
        return encoded.drop_columns("ids").append_column("ids_sha256", pa.array(listed, pa.string())).append_column("decoded_sha256", pa.array(data, pa.string()))

    return by_chunk(docs).applyInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
