"""Token ids as binary chunks: bit or byte planes of fixed-size id blocks, under zstandard.

A chunk holds whole documents. Its ids are cut into blocks of BLOCK ids, the last one
shorter; each block is transposed, so that plane k of the chunk is plane k of all blocks in
turn, and every plane is one zstandard frame. A chunk's bytes are

    b"PLNZ", u8 version, u8 unit (0 byte planes, 1 bit planes), u16 planes, u32 block,
    u64 ids, then for each plane a u32 length and the frame

all little-endian. Chunks are rows of Parquet files, written by Spark's own committer so that
a lost executor costs a retried task; the other columns are the chunk index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinweave.plans.joins import lookup_join

BLOCK = 4096
IDS_PER_CHUNK = 1 << 17
DOCS_PER_CHUNK = 4096
END_ID = 2
# Pieces and their ids that a worker remembers; beyond that it goes on with those of the last
# texts, which changes no result.
CACHED_BYTES = 32 << 20
# Text that is encoded at a time, each row counted with some bytes more; one text may be longer.
GROUP_BYTES, ROW_BYTES = 8 << 20, 64
# Pieces or words that go to the tokenizer at a time.
TOKENIZED = 1 << 14
_HEADER = struct.Struct("<4sBBHIQ")
_MAGIC, _VERSION, _PLANES = b"PLNZ", 1, {"byte": 4, "bit": 32}
_IDS = pa.large_list(pa.uint32())


def _planes(block: np.ndarray, unit: str) -> np.ndarray:
    """Rows are planes: bytes of the ids, or their bits packed into bytes, lowest first."""
    octets = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return np.ascontiguousarray(octets.T)
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")


def encode_chunk(ids: np.ndarray, unit: str = "byte", block: int = BLOCK, level: int = 3) -> bytes:
    """The chunk's bytes; ``ids`` are unsigned 32-bit."""
    blocks = [_planes(ids[i : i + block], unit) for i in range(0, len(ids), block)]
    out = [_HEADER.pack(_MAGIC, _VERSION, unit == "bit", _PLANES[unit], block, len(ids))]
    pack = zstandard.ZstdCompressor(level=level)
    for k in range(_PLANES[unit]):
        frame = pack.compress(b"".join(b[k].tobytes() for b in blocks))
        out += [struct.pack("<I", len(frame)), frame]
    return b"".join(out)


def decode_chunk(data: bytes) -> np.ndarray:
    """The ids of a chunk; a damaged chunk raises ValueError."""
    magic, version, is_bit, planes, block, total = _HEADER.unpack_from(data)
    if magic != _MAGIC or version != _VERSION or planes != _PLANES["bit" if is_bit else "byte"]:
        raise ValueError("not a chunk of this format")
    at, rows = _HEADER.size, []
    unpack = zstandard.ZstdDecompressor()
    for _ in range(planes):
        (size,) = struct.unpack_from("<I", data, at)
        at += 4
        rows.append(np.frombuffer(unpack.decompress(data[at : at + size]), np.uint8))
        at += size
    if at != len(data):
        raise ValueError("chunk has bytes after its planes")
    sizes = [min(block, total - i) for i in range(0, total, block)]
    ids = np.empty(total, np.uint32)
    begin = start = 0
    for n in sizes:
        width = -(-n // 8) if is_bit else n
        part = np.stack([r[begin : begin + width] for r in rows])
        if is_bit:
            bits = np.unpackbits(part, axis=1, bitorder="little")[:, :n]
            octets = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        else:
            octets = np.ascontiguousarray(part.T)
        ids[start : start + n] = octets.reshape(-1).view("<u4")
        begin, start = begin + width, start + n
    return ids


class WordEncoder:
    """Ids of texts by a tokenizer, each different piece of a group of texts encoded once.

    For a tokenizer that splits at white space anyway, the ids of a text are those of its
    words. Words of printable Latin-1 letters are normalised and cut here and their pieces
    given to the tokenizer's model in one go; every other word, and one that may hold a
    special token, goes through the whole tokenizer. ``tests/llm`` holds both against encoding whole texts.
    Texts, words and pieces stay Arrow columns; only pieces not met before become strings.
    """

    # The split pattern of the tokenizer file and the byte alphabet of GPT-2.
    _PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    _PLAIN = "^[!-~¡-¬®-ÿ]+$"
    # Pieces that go to the model as one line.
    _LINE = 256

    def __init__(self, path: str):
        import tokenizers

        self.full = tokenizers.Tokenizer.from_file(path)
        self.bare = tokenizers.Tokenizer(self.full.model)
        self.bare.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(self.full.get_vocab(True).values()) + 1, bool)
        for token, i in self.full.get_vocab(False).items():
            self.ends[i] = token.endswith("</w>")
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = [b for b in range(256) if b not in kept]
        self.alphabet = np.arange(256, dtype="<u4")
        self.alphabet[moved] = np.arange(256, 256 + len(moved))
        self.alphabet[0x20] = 0x20  # the space between two pieces of a line
        self.known = pa.array([], pa.large_string())
        self.known_ids = pa.array([], _IDS)

    def _is_plain(self, words: pa.Array) -> pa.Array:
        plain = pc.match_substring_regex(words, self._PLAIN)
        return pc.and_not(plain, pc.match_substring(words, "<|"))

    def _lines(self, pieces: pa.Array, size: int) -> list[np.ndarray]:
        """The model's ids of the pieces, ``size`` of them a line."""
        bounds = np.append(np.arange(0, len(pieces), size), len(pieces))
        some = pa.LargeListArray.from_arrays(pa.array(bounds), pieces)
        lines = pc.binary_join(some, pa.scalar(" ", pieces.type))
        octets = (np.frombuffer(line.as_buffer(), np.uint8) for line in lines)
        texts = [self.alphabet[x].tobytes().decode("utf-32-le") for x in octets]
        return _encoded(self.bare, texts, max(1, TOKENIZED // size))

    def _by_model(self, pieces: pa.Array) -> pa.Array:
        if not len(pieces):
            return pa.array([], _IDS)
        ids = np.concatenate(self._lines(pieces, self._LINE))
        ends = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(pieces) + 1:  # some piece has no token that ends it
            return _lists(self._lines(pieces, 1))
        return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids))

    def _by_tokenizer(self, words: pa.Array) -> pa.Array:
        return _lists(_encoded(self.full, words.to_pylist(), TOKENIZED))

    def _look_up(self, pieces: pa.Array) -> pa.Array:
        """The ids of different pieces, and of words that are not cut, in their order."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1)
        at = at.to_numpy().astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = pieces.take(pa.array(missing))
            plain = self._is_plain(new).to_numpy(zero_copy_only=False)
            missing = np.append(missing[plain], missing[~plain])
            parts, rest = new.filter(pa.array(plain)), new.filter(pa.array(~plain))
            at[missing] = len(self.known) + np.arange(len(missing))
            ids = [self._by_model(parts), self._by_tokenizer(rest)]
            known = pa.concat_arrays([self.known, parts, rest])
            self.known, self.known_ids = known, pa.concat_arrays([self.known_ids, *ids])
        found = self.known_ids.take(pa.array(at))
        if self.known.nbytes + self.known_ids.nbytes > CACHED_BYTES:
            self.known, self.known_ids = pieces, found
        return found

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow column; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        words = split.values.dictionary_encode()
        plain = self._is_plain(words.dictionary)
        cut = pc.replace_substring_regex(pc.utf8_lower(words.dictionary), self._PIECES, r"\0 ")
        cut = pc.if_else(plain, pc.ascii_rtrim(cut, " "), words.dictionary)
        cut = pc.split_pattern(cut, " ")
        pieces = cut.values.dictionary_encode()
        by_piece = self._look_up(pieces.dictionary).take(pieces.indices)
        spans = by_piece.offsets.to_numpy()[cut.offsets.to_numpy()]
        by_word = pa.LargeListArray.from_arrays(pa.array(spans), by_piece.values)
        by_word = by_word.take(words.indices)
        ids = by_word.values.to_numpy()
        ends = by_word.offsets.to_numpy()[split.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        octets = [t.encode("utf-8", "replace") for t in texts]
        return self.encode_column(pa.array(octets, pa.large_string()))


def _encoded(tokenizer, texts: list[str], most: int) -> list[np.ndarray]:
    """The ids of each text, ``most`` at a time: what a tokenizer returns is many times as large."""
    return [
        np.array(e.ids, np.uint32)
        for i in range(0, len(texts), most)
        for e in tokenizer.encode_batch_fast(texts[i : i + most], add_special_tokens=False)
    ]


def _lists(found: list[np.ndarray]) -> pa.Array:
    if not found:
        return pa.array([], _IDS)
    bounds = np.append(0, np.cumsum([len(ids) for ids in found], dtype=np.int64))
    return pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found)))


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker; its pieces survive from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about GROUP_BYTES of text, joined or cut."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        ends = np.cumsum(np.append(0, sizes.astype(np.int64) + ROW_BYTES))
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(ends, ends[at] + GROUP_BYTES - size, "right")) - 1
            to = max(fits, at if held else at + 1)
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to] - ends[at])
                at = to
            if at < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _give_back() -> None:
    """Frees what Arrow keeps of a task's columns; the worker would hold it while it serves other queries."""
    pa.default_memory_pool().release_unused()


def _chunk_writer(tokenizer: str, unit: str, end_id: int, kind: pa.DataType):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        part = TaskContext.get().partitionId()
        names = ["part", "chunk", "start_in_part", "n_ids", "doc_ids", "lengths", "payload"]
        number = start = held = 0
        docs, parts = [], []

        def row() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            values = [part, number, start, len(ids)]
            arrays = [pa.array([v], pa.int64()) for v in values]
            arrays.append(pa.array([docs], pa.list_(kind)))
            arrays.append(pa.array([[len(p) for p in parts]], pa.list_(pa.int64())))
            arrays.append(pa.array([encode_chunk(ids, unit)], pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, names)

        for some in _groups(batches):
            encoded = encoder.encode_column(some.column("text"))
            for doc, ids in zip(some.column("doc_id").to_pylist(), encoded, strict=True):
                docs.append(doc)
                parts.append(np.append(ids, np.uint32(end_id)).astype(np.uint32))
                held += len(parts[-1])
                if held >= IDS_PER_CHUNK or len(docs) >= DOCS_PER_CHUNK:
                    yield row()
                    number, start, held = number + 1, start + held, 0
                    docs, parts = [], []
        if docs:
            yield row()
        some = encoded = ids = None  # the last group's columns
        _give_back()

    return write


def write_token_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    unit: str = "byte",
    end_id: int = END_ID,
    partitions: int | None = None,
) -> None:
    """Encode the texts and write their chunks to ``path`` in ascending doc_id order.

    Null ids come first, and rows that share an id go by their text; a null text is empty
    and still gets its end id. ``part`` ascends with doc_id, ``chunk`` with it inside a
    part, and ``start_in_part`` counts the part's ids before the chunk.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType
    ordered = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .repartitionByRange(partitions, "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )
    chunks = ordered.mapInArrow(
        _chunk_writer(tokenizer, unit, end_id, to_arrow_type(kind)),
        "part bigint, chunk bigint, start_in_part bigint, n_ids bigint, "
        f"doc_ids array<{kind.simpleString()}>, lengths array<bigint>, payload binary",
    )
    chunks.write.option("compression", "none").parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """``(part, chunk, start, n_ids, n_docs)`` of the chunks, read without their payloads.

    ``start`` counts all ids before the chunk. The sums per part, one row for each written
    file, are the only thing ordered in one task.
    """
    chunks = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("__ids")).select(
        "part", F.coalesce(F.sum("__ids").over(before), F.lit(0)).alias("__base")
    )
    return chunks.join(F.broadcast(parts), "part").select(
        "part",
        "chunk",
        (F.col("__base") + F.col("start_in_part")).alias("start"),
        "n_ids",
        F.size("doc_ids").cast("bigint").alias("n_docs"),
    )


def read_token_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents back from their chunks: doc_id, start, n_tokens and ids.

    With ``digest`` the crc32 of the ids' little-endian bytes takes the place of the ids.
    """
    chunks = spark.read.parquet(path)
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    index = chunk_index(spark, path).select("part", "chunk", "start")
    value = "ids_crc32 bigint" if digest else "ids array<bigint>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, lengths, first, data in zip(
                batch.column("doc_ids"),
                batch.column("lengths").to_pylist(),
                batch.column("start").to_pylist(),
                batch.column("payload").to_pylist(),
                strict=True,
            ):
                ids = decode_chunk(data)
                ends = np.cumsum(np.array(lengths, np.int64))
                cuts = np.split(ids, ends[:-1])
                if digest:
                    out = pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cuts], pa.int64())
                else:
                    out = pa.array([c.astype(np.int64) for c in cuts], pa.list_(pa.int64()))
                starts = pa.array(first + ends - np.array(lengths, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [docs.values, starts, pa.array(lengths, pa.int64()), out],
                    ["doc_id", "start", "n_tokens", value.split()[0]],
                )
        _give_back()

    # One row for each chunk and three numbers in it: the payloads are not shuffled.
    located = chunks.select("part", "chunk", "doc_ids", "lengths", "payload")
    return lookup_join(located, index, ["part", "chunk"]).select(
        "doc_ids", "lengths", "start", "payload"
    ).mapInArrow(read, f"doc_id {kind}, start bigint, n_tokens bigint, {value}")
