"""Token ids in files of fixed-width bit-packed blocks, as a Spark data source.

A vocabulary of v ids needs ``(v - 1).bit_length()`` bits an id. Sixty-four ids of b bits fill b longs, so a group of 64
starts at a byte that follows from its number alone, and numpy packs or unpacks any run of groups with two shifts per
lane. A file is the packed blocks, one after the other, and behind them an index of its documents (id and number of
tokens), a table of its blocks (first id, offset, bytes, checksum) and a trailer that says where these lie. A folder
is made of such files and a manifest, which names them in order and says how many ids lie before each.

The writer is a data source: every task packs its (sorted) rows into a file of its own name, and the driver lists only the
files of the tasks that Spark committed, in a manifest that is renamed into place; a lost executor or a second
attempt leaves a file that no manifest names. The reader plans splits from the manifest alone, checks each
block's checksum, and unpacks a bounded run of documents at a time. ``ids_at`` reads any stretch of the whole folder's ids and
touches only the groups that hold it.

Defined results: null or empty text is the end token alone; rows are ordered by doc_id, nulls first, ties by text and
then as they lie in the input; repeated rows are written once each; a very long text is tokenized whole and may span any
number of blocks; an empty table gives a folder without files, which reads as no rows; other columns of the
input are left out; an id that the vocabulary has no place for is an error.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from scriptorium.llm.common import text_batches

FORMAT = "packed_ids"
MAGIC = b"IDPACK01"
MANIFEST = "_manifest.json"
GROUP = 64
#: Ids of a block; a multiple of the group.
BLOCK = 1 << 16
#: Ids that a reader unpacks at once, and ids of a split; a longer document is read alone.
RUN = 1 << 20
SPLIT = 1 << 23
#: Bytes of texts that are tokenized at once; a longer text is tokenized alone.
TEXT_BYTES = 1 << 22
COLUMNS = ("doc_id", "start", "n_tokens", "ids", "ids_crc32")


def bits_for(vocabulary: int) -> int:
    """The least bits that tell the ids 0 to vocabulary - 1 apart."""
    if not 0 < vocabulary <= 1 << 31:
        raise ValueError(f"a vocabulary of {vocabulary} ids has no packed form")
    return max(1, (vocabulary - 1).bit_length())


def _lanes(bits: int) -> Iterator[tuple[int, int, int]]:
    for lane in range(GROUP):
        word, shift = divmod(lane * bits, 64)
        yield lane, word, shift


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Whole groups of the ids, the last one filled up with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    full = np.zeros((-(-len(ids) // GROUP), GROUP), np.uint64)
    full.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(full), bits), np.uint64)
    for lane, word, shift in _lanes(bits):
        out[:, word] |= full[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= full[:, lane] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(packed: bytes, bits: int) -> np.ndarray:
    """The ids of whole groups, with what the last one was filled up with."""
    words = np.frombuffer(packed, "<u8").reshape(-1, bits)
    out, mask = np.empty((len(words), GROUP), np.uint32), np.uint64((1 << bits) - 1)
    for lane, word, shift in _lanes(bits):
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | words[:, word + 1] << np.uint64(64 - shift)
        out[:, lane] = x & mask
    return out.reshape(-1)


def group_bytes(groups: int, bits: int) -> int:
    return groups * bits * (GROUP // 8)


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI that all tasks share, and the path in it."""
    if re.match(r"\w[\w+.-]*:", path):
        return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pa.fs.LocalFileSystem(), path


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class FileWriter:
    """One file: ids come in pieces of any length and leave in packed blocks."""

    def __init__(self, out: pa.NativeFile, bits: int) -> None:
        self.out, self.bits, self.rest, self.n_ids = out, bits, [], 0
        self.blocks: list[tuple[int, int, int, int]] = []
        out.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        if sum(map(len, self.rest)) >= BLOCK:
            ids = np.concatenate(self.rest)
            whole = len(ids) // BLOCK * BLOCK
            for at in range(0, whole, BLOCK):
                self._block(ids[at : at + BLOCK])
            self.rest = [ids[whole:]]

    def _block(self, ids: np.ndarray) -> None:
        packed = pack(ids, self.bits)
        self.blocks.append((self.n_ids, self.out.tell(), len(packed), zlib.crc32(packed)))
        self.out.write(packed)
        self.n_ids += len(ids)

    def close(self, documents: pa.Table) -> None:
        last = np.concatenate(self.rest) if self.rest else np.empty(0, np.uint32)
        if len(last):
            self._block(last)
        blocks = pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("first_id", "offset", "bytes", "crc32"), zip(*self.blocks) if self.blocks else [[]] * 4, strict=True)})
        trailer = {"bits": self.bits, "n_ids": self.n_ids}
        for name, table in (("documents", documents), ("blocks", blocks)):
            section = _ipc(table)
            trailer[name] = [self.out.tell(), len(section)]
            self.out.write(section)
        end = json.dumps(trailer).encode()
        self.out.write(end + len(end).to_bytes(8, "little") + MAGIC)


class FileReader:
    """One file: the tables of its documents and blocks, and any run of its ids."""

    def __init__(self, fs: pa.fs.FileSystem, path: str) -> None:
        self.file, self.path = fs.open_input_file(path), path
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if self.file.read_at(8, 0) != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{path} is no file of packed ids")
        n = int.from_bytes(tail[:8], "little")
        self.trailer = json.loads(self.file.read_at(n, size - 16 - n))
        self.bits, self.n_ids = self.trailer["bits"], self.trailer["n_ids"]

    def table(self, name: str) -> pa.Table:
        at, n = self.trailer[name]
        return pa.ipc.open_stream(self.file.read_at(n, at)).read_all()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop; only the groups that hold them are read."""
        first, last = start // GROUP, -(-stop // GROUP)
        packed = self.file.read_at(group_bytes(last - first, self.bits), len(MAGIC) + group_bytes(first, self.bits))
        return unpack(packed, self.bits)[start - first * GROUP : stop - first * GROUP]

    def checked(self, start: int, stop: int, blocks: pa.Table) -> np.ndarray:
        """The same by whole blocks, each held against its checksum."""
        if start == stop:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        out = []
        for b in blocks.slice(first, last - first).to_pylist():
            packed = self.file.read_at(b["bytes"], b["offset"])
            if zlib.crc32(packed) != b["crc32"]:
                raise ValueError(f"{self.path}: the block at {b['offset']} is damaged")
            out.append(unpack(packed, self.bits))
        return np.concatenate(out)[start - first * BLOCK : stop - first * BLOCK]


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str | None = None
    n_docs: int = 0
    n_ids: int = 0


@dataclass
class Split(InputPartition):
    file: str
    before: int
    first: int
    stop: int


def manifest(path: str) -> dict:
    fs, root = filesystem(path)
    with fs.open_input_file(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


class PackedIds(DataSource):
    """format("packed_ids"): writes sorted rows and reads them back.

    Rows to write are (doc_id, ids array<int>) with the option vocabulary, or (doc_id, text) with the options tokenizer and
    end_token; texts are then tokenized where they are written. What is read are the columns that the option of that name lists.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        kinds = {"doc_id": T.StructType.fromJson(manifest(self.options["path"])["key"])["doc_id"].dataType, "ids": T.ArrayType(T.IntegerType(), False)}
        return T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in self.options.get("columns", "doc_id,start,n_tokens,ids").split(",")])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        given = self.options.get("tokenizer")
        end_token = int(self.options["end_token"]) if given else -1
        vocabulary = max(Encoder(given).vocabulary, end_token + 1) if given else int(self.options["vocabulary"])
        return _Writer(self.options["path"], vocabulary, schema, given, end_token)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, vocabulary: int, schema: T.StructType, tokenizer: str | None, end_token: int) -> None:
        self.path, self.vocabulary, self.schema, self.tokenizer, self.end_token = path, vocabulary, schema, tokenizer, end_token

    def _pieces(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        if self.tokenizer:
            yield from _encoded(batch, encoder(self.tokenizer), self.end_token)
        else:
            ids = batch.column("ids")
            yield batch.column("doc_id"), ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), ids.value_lengths().fill_null(0).to_numpy().astype(np.int64)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part = TaskContext.get().partitionId()
        fs, root = filesystem(self.path)
        name, out, keys, sizes = f"part-{part:05d}-{uuid.uuid4().hex}.ids", None, [], []
        key = to_arrow_schema(T.StructType([self.schema["doc_id"]])).field(0).type
        for batch in iterator:
            if batch.num_rows == 0:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = FileWriter(fs.open_output_stream(f"{root}/{name}"), bits_for(self.vocabulary))
            for key_part, ids, n in self._pieces(batch):
                out.add(ids)
                keys.append(pa.concat_arrays([key_part]))  # a copy, not a view of the batch
                sizes.append(pa.array(n))
        if out is None:
            return Written(part)
        documents = pa.table({"doc_id": pa.chunked_array(keys, key), "n_tokens": pa.chunked_array(sizes, pa.int64())})
        out.close(documents)
        out.out.close()
        return Written(part, name, documents.num_rows, out.n_ids)

    def commit(self, messages: list[Written]) -> None:
        files, before = [], 0
        for m in sorted((m for m in messages if m is not None and m.file), key=lambda m: m.part):
            files.append({"file": m.file, "n_docs": m.n_docs, "n_ids": m.n_ids, "start": before})
            before += m.n_ids
        told = {"vocabulary": self.vocabulary, "bits": bits_for(self.vocabulary), "key": T.StructType([self.schema["doc_id"]]).jsonValue(), "n_ids": before, "files": files}
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}.new") as f:
            f.write(json.dumps(told).encode())
        fs.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written]) -> None:
        """Nothing is named by a manifest, so nothing is read."""


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[Split]:
        out = []
        for f in manifest(self.path)["files"]:
            step = max(1, -(-f["n_docs"] * SPLIT // max(f["n_ids"], SPLIT)))
            out += [Split(f["file"], f["start"], at, min(at + step, f["n_docs"])) for at in range(0, f["n_docs"], step)]
        return out or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, root = filesystem(self.path)
        file = FileReader(fs, f"{root}/{partition.file}")
        documents, blocks = file.table("documents"), file.table("blocks")
        sizes = documents["n_tokens"].to_numpy()
        ends = np.cumsum(sizes)
        arrow, at = to_arrow_schema(self.schema), partition.first
        while at < partition.stop:
            start = int(ends[at] - sizes[at])
            stop = min(partition.stop, max(at + 1, int(np.searchsorted(ends, start + RUN, "right"))), at + 10_000)
            borders = np.concatenate([[start], ends[at:stop]]) - start
            ids = file.checked(start, int(ends[stop - 1]), blocks) if {"ids", "ids_crc32"} & set(arrow.names) else None
            made: dict[str, Callable[[], pa.Array]] = {
                "doc_id": lambda: documents["doc_id"].slice(at, stop - at).combine_chunks(),  # noqa: B023
                "start": lambda: pa.array(borders[:-1] + start + partition.before),  # noqa: B023
                "n_tokens": lambda: pa.array(sizes[at:stop]),  # noqa: B023
                "ids": lambda: pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(ids.astype(np.int32))),  # noqa: B023
                "ids_crc32": lambda: pa.array([zlib.crc32(ids[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)], pa.int64()),  # noqa: B023
            }
            yield pa.RecordBatch.from_arrays([made[f.name]().cast(f.type) for f in arrow], schema=arrow)
            at = stop


def ids_at(path: str, start: int, n: int) -> np.ndarray:
    """n of the folder's ids from number start on (fewer at its end), over the borders of files, reading only what holds them."""
    fs, root = filesystem(path)
    out = [np.empty(0, np.uint32)]
    for f in manifest(path)["files"]:
        a, b = max(start, f["start"]) - f["start"], min(start + n, f["start"] + f["n_ids"]) - f["start"]
        if a < b:
            out.append(FileReader(fs, f"{root}/{f['file']}").ids(a, b))
    return np.concatenate(out)


#: The parts of a tokenizer file whose texts may be cut at white space, and at the borders of its own pattern.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Signs that no normalizer joins or changes but to lower case, and where the pattern cuts words of them.
PLAIN = "!-~À-ÖØ-öø-ÿ"
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Words, and cuts of words, that make a generation of what a worker remembers; it holds two at most.
REMEMBERED = 300_000


def _visible() -> dict[int, str]:
    """The signs by which a byte-level vocabulary writes bytes: themselves where they are visible, else from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(visible))}


def _bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Recent(dict):
    """What is remembered of the last keys asked for: a full generation is kept until the next is full, and what is asked for again moves up."""

    def __init__(self) -> None:
        self.before: dict = {}

    def made(self, key: str | bytes) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str | bytes) -> bytes:
        found = self.before.get(key)
        if found is None:
            found = self.made(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[key] = found
        return found


class _Cuts(_Recent):
    """Ids of the cuts of words, by the model of the library alone."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.tokenize, self.signs = tokenizer.model.tokenize, _visible()

    def made(self, cut: str) -> bytes:
        signs = cut if cut.isascii() else cut.encode().decode("latin-1").translate(self.signs)
        return _bytes([t.id for t in self.tokenize(signs)])


class _Words(_Recent):
    """Ids of words without white space."""

    def __init__(self, tokenizer: Tokenizer, special: list[str]) -> None:
        super().__init__()
        self.whole, self.cuts = tokenizer.encode, _Cuts(tokenizer)
        # a sign that special tokens begin with is left to the library
        self.plain = re.compile(f"(?:(?![{re.escape(''.join({t[0] for t in special}))}])[{PLAIN}])+" if special else f"[{PLAIN}]+")

    def made(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone
            return self.cuts[word.lower().decode()]
        if self.plain.fullmatch(text := word.decode("utf-8", "replace")):
            return b"".join(map(self.cuts.__getitem__, CUT.findall(text.lower())))
        return _bytes(self.whole(text, add_special_tokens=False).ids) if word else b""


#: Length of the longest word or cut that is remembered.
LONGEST = 256


class Encoder:
    """Ids of whole texts by the tokenizers library, as its own encode gives them without special tokens added.

    Where the file's rules never look across white space, each distinct word is handed to the library once, and its ids are
    remembered; words of plain signs are cut further, where the file's own pattern cuts. Any other file runs on whole texts.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, extra = spec["model"], spec["added_tokens"]
        self.by_word = (
            (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and (spec["pre_tokenizer"] or {}).get("pretokenizers") == PRE_TOKENIZERS
            and not model.get("dropout")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"] for t in extra)
        )
        self.words = _Words(self.tokenizer, [t["content"] for t in extra])

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def __call__(self, text: bytes) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return _bytes(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, text.split()))  # at the six ASCII spaces

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of many texts, where a word that repeats in them is looked up once; null texts have none."""
        if not self.by_word:
            found = [self(t or b"") for t in texts.cast(pa.large_binary()).to_pylist()]
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        lists = pc.ascii_split_whitespace(texts.fill_null(""))  # the same six; a text that begins or ends with them has an empty word there
        coded = lists.flatten().dictionary_encode()
        rows = list(map(self.words.__getitem__, coded.dictionary.cast(pa.large_binary()).to_pylist()))
        ids, sizes = np.frombuffer(b"".join(rows), "<u4"), np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        at = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[at]
        ends = np.cumsum(each)
        # a word's ids lie together among those of the distinct words
        shift = (np.cumsum(sizes) - sizes)[at] - ends + each
        borders = np.r_[0, ends][np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]]
        return ids[np.repeat(shift, each) + np.arange(ends[-1] if len(ends) else 0)], np.diff(borders)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file; a worker keeps it, with what it remembers, from task to task."""
    return Encoder(path)


def _encoded(batch: pa.RecordBatch, encode: Encoder, end_token: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids, numbers of ids) of the texts of a batch, some at a time."""
    texts = batch.column("text")
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right")))
        ids, sizes = encode.texts(texts.slice(at, stop - at))
        yield batch.column("doc_id").slice(at, stop - at), np.insert(ids, np.cumsum(sizes), end_token), sizes + 1
        at = stop


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedIds)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_token: int) -> None:
    """Tokenize the documents in ascending doc_id order, an end token behind each, into a new folder of packed files.

    Rows are sorted over range partitions, whose last key is a row's place in the input, so that an id that repeats without
    end is spread over as many files as it fills. Texts are tokenized behind the sort, so each is encoded once.
    """
    register(docs.sparkSession)
    keys = ["doc_id", "_hash", "_place"]
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_place"))
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    with text_batches(docs.sparkSession):
        ordered.write.format(FORMAT).options(path=path, tokenizer=tokenizer_path, end_token=end_token).mode("append").save()


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The documents of a folder: doc_id, start (ids of all documents before it), n_tokens, ids and their checksum, as wanted."""
    register(spark)
    return spark.read.format(FORMAT).option("columns", ",".join(columns)).load(path)
