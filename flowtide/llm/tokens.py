"""Token ids in Arrow files: equal-length sequences and masks with zero-copy random access.

Layout of a folder, one pair of files per shard (a run of ascending document ids):

* `ids-NNNNNN.arrow`: Arrow stream batches in a file with a footer, so that any batch is found
  and mapped without reading the others. Columns `input_ids` (fixed-size list of uint16, or of
  uint32 where the vocabulary needs it) and `mask` (fixed-size list of bits, true for an id and
  false for the padding after a shard's last id).
* `docs-NNNNNN.arrow`: `doc_id`, `start` (ids before the document in its shard), `n_tokens`.

Batches hold the same number of sequences but for the last, so sequence i of a shard is row
i % BATCH_ROWS of batch i // BATCH_ROWS.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowtide.llm.common import shared_path

#: ids per sequence
SEQUENCE = 2048
#: sequences per batch
BATCH_ROWS = 64
#: units kept with their ids by each Python worker
CACHE_UNITS = 400_000
#: characters encoded together
PORTION = 1 << 20

# Pieces between which the byte-level pattern always splits, for texts whose only white space
# is blanks and line feeds: letters before common punctuation, white space or the end, with the
# blank or line feed before them; such punctuation after them; any other word, with the blank or
# line feed before it; white space up to the last before a word, or at the end.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r".,!?#$%&*|"
_UNITS = re.compile(rf"[ \n]?[{_LETTERS}]+(?![^ \n{_MARKS}])|[{_MARKS}]+(?![^ \n])|[ \n]?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+").findall
_OTHER_SPACE = re.compile(r"[^\S \n]").search

_encoders: dict[tuple[str, bool], "Encoder"] = {}


class _Numbers(dict):
    """Numbers units in the order in which they are first asked for."""

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        return number


class Encoder:
    """Ids of texts by the tokenizers library; each unit is encoded once and its ids are kept.

    The ids of all kept units lie in `flat`; unit i has `length[i]` from `start[i]` on. With
    `literal` the added tokens of the file are text like any other; else a text that has the
    content of one is encoded whole, since an added token need not end where a unit does.
    """

    def __init__(self, file: str, by_unit: bool, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = literal
        # the library takes added tokens out of a text, special ones unless literal
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (literal and t.special)]
        self.whole = re.compile("|".join(re.escape(t.content) for t in added), re.IGNORECASE).search if added else lambda text: None
        # what a normalizer changes before it looks for a token cannot be searched for
        self.by_unit = by_unit and not (self.tokenizer.normalizer is not None and any(t.normalized for t in added))
        # bytes of each id: a character of a byte-level vocabulary stands for one byte
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.width[k] = len(token)
        self._forget()

    @classmethod
    def of(cls, file: str, by_unit: bool) -> "Encoder":
        """One per worker and file, with added tokens: reading the vocabulary takes longer than a small batch."""
        key = (file, by_unit)
        if key not in _encoders:
            _encoders[key] = cls(file, by_unit, literal=False)
        return _encoders[key]

    def kind(self, end_id: int) -> type:
        """The narrowest type for all ids."""
        return np.uint16 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32

    def _forget(self) -> None:
        self.numbers, self.flat = _Numbers(), np.zeros(0, np.uint32)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, units: list[str]) -> None:
        """Encode new units. Those that begin with a blank before a word are encoded as one text,
        which the pattern splits before each of these blanks; the others as words of their own."""
        word = np.fromiter((u[0] == " " and u[1:2] not in ("", " ", "\n") for u in units), bool, len(units))
        joined = [u for u, w in zip(units, word.tolist()) if w]
        apart = [u for u, w in zip(units, word.tolist()) if not w]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, np.uint32)
        # where the bytes of each unit end, and how many ids end up to there
        ends = np.cumsum(np.fromiter((len(u.encode()) for u in joined), np.int64, len(joined)))
        upto = np.searchsorted(np.cumsum(self.width[ids]), ends, side="right")
        lengths = [np.diff(upto, prepend=0)]
        if apart:
            encoding = self.tokenizer.encode(apart, is_pretokenized=True, add_special_tokens=False)
            ids = np.concatenate([ids, np.array(encoding.ids, np.uint32)])
            lengths.append(np.bincount(np.array(encoding.word_ids, np.int64), minlength=len(apart)))
        # in `flat` the joined ones come first; `at` follows the numbers
        order = np.argsort(np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)]))
        length = np.concatenate(lengths)
        start = np.cumsum(length) - length + len(self.flat)
        self.flat = np.concatenate([self.flat, ids])
        self.start = np.concatenate([self.start, start[order]])
        self.length = np.concatenate([self.length, length[order]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [k for k, text in enumerate(texts) if self.by_unit and not _OTHER_SPACE(text) and not self.whole(text)]
        others = sorted(set(range(len(texts))).difference(plain))
        if others:
            for k, e in zip(others, self.tokenizer.encode_batch_fast([texts[k] for k in others], add_special_tokens=False)):
                out[k] = np.array(e.ids, np.uint32)
        if len(self.numbers) > CACHE_UNITS:
            self._forget()
        units = [_UNITS(texts[k]) for k in plain]
        counts = np.array([len(u) for u in units], np.int64)
        known = len(self.numbers)
        unit = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(units)), np.int64, int(counts.sum()))
        if len(self.numbers) > known:
            self._learn(list(islice(self.numbers, known, None)))
        length = self.length[unit]
        ends = np.cumsum(length)
        flat = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[unit] - (ends - length), length)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        for k, a, b in zip(plain, bounds.tolist(), bounds[1:].tolist()):
            out[k] = flat[a:b]
        return out


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about PORTION characters together."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= PORTION:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


class _ShardWriter:
    """Writes one shard; what is written under a name of this attempt gets its own name at the end."""

    def __init__(self, folder: str, shard: int, sequence: int, kind: type):
        self.kind = kind
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.shard, self.sequence = shard, sequence
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        self.names = [(f"{self.root}/_{kind}-{shard:06d}-{attempt}", f"{self.root}/{kind}-{shard:06d}.arrow") for kind in ("ids", "docs")]
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [self.fs.open_output_stream(name) for name, _ in self.names]
        self.ids = pa.ipc.new_file(self.files[0], self.schema)
        self.docs = pa.ipc.new_file(self.files[1], self.docs_schema)
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_tokens = self.n_docs = 0
        self.index: tuple[list, list, list] = ([], [], [])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for column, value in zip(self.index, (doc_id, self.n_tokens, len(ids))):
            column.append(value)
        self.n_docs += 1
        self.n_tokens += len(ids)
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= self.sequence * BATCH_ROWS:
            self._flush(last=False)
        if len(self.index[0]) >= 1 << 16:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.pending) if self.pending else np.zeros(0, self.kind)
        size = self.sequence * BATCH_ROWS
        whole = len(flat) // size * size
        for at in range(0, whole, size):
            self._batch(flat[at : at + size], size)
        rest = flat[whole:]
        if last and len(rest):
            self._batch(rest, -(-len(rest) // self.sequence) * self.sequence)
            rest = rest[:0]
        self.pending, self.n_pending = [rest], len(rest)

    def _batch(self, ids: np.ndarray, size: int) -> None:
        values, mask = np.zeros(size, self.kind), np.zeros(size, bool)
        values[: len(ids)] = ids
        mask[: len(ids)] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (values, mask)]
        self.ids.write_batch(pa.record_batch(columns, schema=self.schema))

    def _flush_index(self) -> None:
        self.docs.write_batch(pa.record_batch([pa.array(x, pa.int64()) for x in self.index], schema=self.docs_schema))
        self.index = ([], [], [])

    def close(self) -> None:
        self._flush(last=True)
        if self.index[0]:
            self._flush_index()
        for writer, file in zip((self.ids, self.docs), self.files):
            writer.close()
            file.close()
        for unfinished, name in self.names:
            # an earlier attempt may have come this far; what it wrote is the same
            if self.fs.get_file_info(name).type != pafs.FileType.NotFound:
                self.fs.delete_file(name)
            self.fs.move(unfinished, name)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, by_unit: bool = True) -> DataFrame:
    """Encode every whole text, append `end_id`, write shards in ascending id order.

    Writes now and returns one row per shard: `shard`, `n_docs`, `n_tokens`, and `first_token`,
    the ids of all shards before it. Every task writes its own shard, so nothing but these
    counts leaves the executors; a repeated attempt replaces the same files. A null text is
    encoded as an empty one (only `end_id`); a null id comes first; rows that share an id are
    all written, in order of a hash of their texts; an empty table gives no rows. `tokenizer` is a file of
    the tokenizers library that every executor has. `by_unit` says that its vocabulary is
    byte-level and splits at blanks, so that units between blanks may be encoded once and cached.
    """
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # rows of one id are dealt by their texts' hashes, and equal rows over any shards
    frame = frame.withColumns({"h": F.xxhash64("text"), "r": F.rand(9)})
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("text").asc_nulls_first()]
    ordered = frame.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h", "r").sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = Encoder.of(tokenizer, by_unit), None
        kind = encoder.kind(end_id)
        for batch in batches:
            if writer is None and batch.num_rows:
                writer = _ShardWriter(folder, TaskContext.get().partitionId(), sequence, kind)
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()
            for a, b in _portions(texts):
                for doc_id, ids in zip(doc_ids[a:b], encoder.encode(texts[a:b])):
                    writer.add(doc_id, np.append(ids, end_id).astype(kind))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": writer.shard, "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}], schema=pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    done = ordered.mapInArrow(write, "shard long, n_docs long, n_tokens long")
    done.write.parquet(f"{folder}/shards.parquet")
    shards = docs.sparkSession.read.schema("shard long, n_docs long, n_tokens long").parquet(f"{folder}/shards.parquet")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


class ShardReader:
    """Random access to one shard; local files are mapped, not read."""

    def __init__(self, folder: str, shard: int):
        filesystem, root = pafs.FileSystem.from_uri(folder)

        def opened(kind: str) -> pa.ipc.RecordBatchFileReader:
            name = f"{root}/{kind}-{shard:06d}.arrow"
            local = isinstance(filesystem, pafs.LocalFileSystem)
            return pa.ipc.open_file(pa.memory_map(name) if local else filesystem.open_input_file(name))

        self.ids, self.docs = opened("ids"), opened("docs")
        self.sequence = self.ids.schema.field("input_ids").type.list_size
        self._at: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint16))

    def batch(self, i: int) -> np.ndarray:
        """All ids of batch i, as one flat view."""
        if self._at[0] != i:
            self._at = (i, self.ids.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True))
        return self._at[1]

    def sequence_at(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i."""
        batch = self.ids.get_batch(i // BATCH_ROWS)
        row = i % BATCH_ROWS
        return batch.column(0)[row].values.to_numpy(zero_copy_only=True), batch.column(1)[row].values.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of ids start to start + n, one per batch that holds some."""
        size = self.sequence * BATCH_ROWS
        while n > 0:
            part = self.batch(start // size)[start % size :][:n]
            yield part
            start, n = start + len(part), n - len(part)


def read_token_files(shards: DataFrame, folder: str, digest: Callable[[Iterator[np.ndarray]], int]) -> DataFrame:
    """Per document, from the files: `doc_id`, `start` over all shards, `n_tokens`, `digest` of its ids.

    Each row of `shards` (see `write_token_files`) is read by one task.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("digest", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first in zip(batch.column("shard").to_pylist(), batch.column("first_token").to_pylist()):
                reader = ShardReader(folder, shard)
                for i in range(reader.docs.num_record_batches):
                    docs = reader.docs.get_batch(i)
                    start, n = (docs.column(k).to_numpy() for k in (1, 2))
                    digests = [digest(reader.tokens(int(s), int(m))) for s, m in zip(start, n)]
                    yield pa.record_batch([docs.column(0), pa.array(start + first), docs.column(2), pa.array(digests, pa.int64())], schema=schema)

    n = shards.sparkSession.sparkContext.defaultParallelism
    dealt = shards.select("shard", "first_token").repartition(max(n, 1), "shard")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, digest long")


def ids_crc32(parts: Iterator[np.ndarray]) -> int:
    """Unsigned crc32 of ids as little-endian 32-bit integers."""
    value = 0
    for part in parts:
        value = zlib.crc32(part.astype("<u4", copy=False).tobytes(), value)
    return value


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `start`, `n_tokens`, `ids_crc32` of every document, read back from files in the shared folder."""
    folder = shared_path(docs.sparkSession, "tokens")
    shards = write_token_files(docs, folder, tokenizer, end_id, id_col, text_col)
    return read_token_files(shards, folder, ids_crc32).withColumnRenamed("digest", "ids_crc32")
