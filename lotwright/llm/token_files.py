"""Token ids in Arrow files of fixed-size lists.

Every shard is one Arrow IPC file whose batches hold sequences of equal length
(``input_ids``) and masks of their valid positions (``mask``). The documents of
a shard follow one another without gaps; the last sequence is filled up with the
end id and masked. Beside it lies a small Arrow file with the shard's documents
and their numbers of ids. A reader maps the file and gets any sequence, or the
ids of any document, without copying the rest.
"""

from __future__ import annotations

import gc
import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

SEQUENCE_LENGTH, BATCH_SEQUENCES, END_ID = 2048, 64, 1
_CACHED_WORDS, _CACHED_PARTS, _CACHED_LENGTH = 300_000, 60_000, 64
#: Fixed value: the pattern of parts in the tokenizer's file.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for words without the characters of _RARE.
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_RARE = re.compile("[\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbe\u0130\u0250-\U0010ffff]")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache:
    """A dict that forgets what has long not been used: of two generations the older goes."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Those of ``keys`` that are not held; the others are held until the next call."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for k in keys.difference(new):
            if k in old:
                new[k] = old[k]
            else:
                out.append(k)
        return out


class WordEncoder:
    """Encodes texts as the tokenizer at ``path`` does, each different word once.

    With ``by_word`` the tokenizer must drop white space, so that a text's ids
    are those of its words one after the other. Where it also lower-cases, cuts
    words at the pattern _PARTS and marks each part's last piece, as its file
    tells, words are cut here and only new parts are encoded; words with rare
    characters, whose cutting may differ, are left to the tokenizer.
    """

    _made: dict = {}

    def __init__(self, path: str, by_word: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
        cutter = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_part = by_word and steps == ["NFC", "Replace", "Lowercase"] and (cutter.get("pattern") or {}).get("Regex") == _PARTS and told["model"].get("end_of_word_suffix") == "</w>"
        self.words, self.parts = _Cache(_CACHED_WORDS), _Cache(_CACHED_PARTS)
        if self.by_part:
            self.last = np.zeros(size, dtype=bool)
            for piece, i in self.tokenizer.get_vocab().items():
                self.last[i] = piece.endswith("</w>")

    @classmethod
    def of(cls, path: str, by_word: bool = True) -> WordEncoder:
        """One encoder for each path and Python worker."""
        if (path, by_word) not in cls._made:
            cls._made[path, by_word] = cls(path, by_word)
        return cls._made[path, by_word]

    @classmethod
    def forget(cls) -> None:
        """Drops the worker's encoders and what they cache: other stages' tasks may need the memory."""
        cls._made.clear()
        gc.unfreeze()

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of parts, encoded as one text and cut after each last piece."""
        ids = np.array(self.tokenizer.encode(" ".join(parts), add_special_tokens=False).ids, dtype=self.dtype)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(parts):
            return self._encode(parts)
        raw, at = ids.tobytes(), [0, *(ends * self.dtype.itemsize).tolist()]
        return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Puts new words into the cache; returns those too long for it."""
        known, extra = self.words.new, {}
        plain, other = {}, []
        for w in words:
            if self.by_part and len(w) <= _CACHED_LENGTH and w.isascii() and w.isalpha():
                # Letters alone are one part.
                plain[w] = [w.lower()]
            elif self.by_part and len(w) <= _CACHED_LENGTH and not _RARE.search(w) and "<|" not in w:
                plain[w] = _CUT.findall(w.lower())
            else:
                other.append(w)
        new = self.parts.missing({p for parts in plain.values() for p in parts})
        parts = self.parts.new
        for at in range(0, len(new), 1024):
            piece = new[at : at + 1024]
            parts.update(zip(piece, self._encode_parts(piece), strict=True))
        for w, cut in plain.items():
            known[w] = parts[cut[0]] if len(cut) == 1 else b"".join([parts[p] for p in cut])
        for at in range(0, len(other), 1024):
            piece = other[at : at + 1024]
            for w, ids in zip(piece, self._encode(piece), strict=True):
                (known if len(w) <= _CACHED_LENGTH else extra)[w] = ids
        return extra

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``dtype``."""
        if not self.by_word:
            return self._encode(texts)
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        extra = self._learn(self.words.missing(set().union(*split)))
        known = self.words.new
        if extra:
            return [b"".join([extra[w] if w in extra else known[w] for w in words]) for words in split]
        return [b"".join(map(known.__getitem__, words)) for words in split]


def _file_type(dtype: np.dtype, length: int) -> pa.Schema:
    of = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([("input_ids", pa.list_(of, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Writes one shard; nothing but one batch of sequences is held."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, length: int, end_id: int):
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        # The name tells the attempt: only that of the attempt whose row the driver gets is ever read.
        self.name, self.length, self.dtype, self.end_id = f"{shard:06d}-{uuid.uuid4().hex}.arrow", length, dtype, end_id
        meta = {b"sequence_length": str(length).encode(), b"batch_sequences": str(BATCH_SEQUENCES).encode(), b"end_id": str(end_id).encode()}
        self.schema = _file_type(dtype, length).with_metadata(meta)
        self.doc_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(self._path(k)) for k in ("ids", "docs")]
        self.ids = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], self.doc_schema)
        self.waiting, self.size, self.n_docs, self.n_tokens = [], 0, 0, 0

    def _path(self, kind: str) -> str:
        return f"{self.folder}/{kind}-{self.name}"

    def _flush(self, last: bool) -> None:
        step = self.length * BATCH_SEQUENCES
        if not last and self.size < step:
            return
        ids = np.frombuffer(b"".join(self.waiting), dtype=self.dtype)
        whole = len(ids) if last else len(ids) // step * step
        for at in range(0, whole, step):
            part = ids[at : min(at + step, whole)]
            fill = -len(part) % self.length
            mask = np.ones(len(part) + fill, dtype=bool)
            if fill:
                mask[len(part) :] = False
                part = np.concatenate([part, np.full(fill, self.end_id, dtype=self.dtype)])
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.ids.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        rest = ids[whole:]
        self.waiting, self.size = [rest.tobytes()], len(rest)

    def add(self, doc_ids: pa.Array, encoded: list[bytes]) -> None:
        counts = np.array([len(x) // self.dtype.itemsize for x in encoded], dtype=np.int64)
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(counts)], schema=self.doc_schema))
        for x in encoded:
            self.waiting.append(x)
            self.size += len(x) // self.dtype.itemsize
            self._flush(False)
        self.n_docs += len(encoded)
        self.n_tokens += int(counts.sum())

    def close(self) -> None:
        """Both files are whole before the task's row names them; a lost attempt's files are never named."""
        self._flush(True)
        for part in (self.ids, self.docs, *self.sinks):
            part.close()


class SequenceFile:
    """Random access to the sequences and documents of one shard."""

    def __init__(self, folder: str, name: str):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        paths = [f"{root}/{kind}-{name}" for kind in ("ids", "docs")]
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        self.reader, self.docs = (pa.ipc.open_file(pa.memory_map(p) if local else fs.open_input_file(p)) for p in paths)
        meta = self.reader.schema.metadata
        self.length, self.per_batch = int(meta[b"sequence_length"]), int(meta[b"batch_sequences"])
        self._at, self._batch = -1, None

    def _get(self, k: int) -> pa.RecordBatch:
        if k != self._at:
            self._at, self._batch = k, self.reader.get_batch(k)
        return self._batch

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * self.per_batch + self._get(n - 1).num_rows if n else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence ``i``: a view of its ids in the file, and its mask."""
        batch, row = self._get(i // self.per_batch), i % self.per_batch
        ids, mask = (batch.column(k).values[row * self.length : (row + 1) * self.length] for k in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """The ids from position ``start`` of the shard; a view where they lie in one batch."""
        step, parts = self.length * self.per_batch, []
        while count > 0:
            k, at = divmod(start, step)
            values = self._get(k).column(0).values
            part = values[at : at + count].to_numpy(zero_copy_only=True)
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, dtype=np.uint16), *parts])


def write_sequences(docs: DataFrame, folder: str, tokenizer_path: str, *, by_word: bool = True, end_id: int = END_ID, length: int = SEQUENCE_LENGTH, ordered: bool = True) -> list[tuple[int, int, int, str]]:
    """Encode every text and write it to ``folder``; [(shard, documents, ids, file name)] in order.

    ``ordered``: ascending doc_id over all shards, nulls first and rows that
    repeat an id by the hash of their text; else the rows keep their order and
    partitions. Null texts count as empty: only their end id is written. An
    empty table gives no shard. A text of any length is encoded whole, and its
    ids may span sequences and batches. Other columns are ignored, whatever
    their names. The driver gets one
    row for each shard.
    """
    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if ordered:
        kept = kept.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches):
        encoder, out = WordEncoder.of(tokenizer_path, by_word), None
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            # The caches hold a million objects and no cycles: once what is new has been looked at, the collector need not walk them again.
            gc.collect()
            gc.freeze()
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = out or SequenceWriter(folder, shard, encoder.dtype, length, end_id)
                out.add(part.column(0), [x + end for x in encoder.encode(part.column(1).to_pylist())])
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (shard, out.n_docs, out.n_tokens)), pa.array([out.name])], names=["shard", "n_docs", "n_tokens", "name"])

    return sorted(tuple(r) for r in kept.mapInArrow(run, "shard bigint, n_docs bigint, n_tokens bigint, name string").collect())


def read_documents(spark: SparkSession, folder: str, shards: list[tuple[int, int, int, str]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files in ``folder``."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    bases, base = [], 0
    for _, _, n, name in shards:
        bases.append((name, base))
        base += n
    if not bases:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, at = SequenceFile(folder, name), 0
                for k in range(file.docs.num_record_batches):
                    part = file.docs.get_batch(k)
                    counts = part.column(1).to_numpy()
                    starts = at + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                    crc = [zlib.crc32(file.tokens(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, counts, strict=True)]
                    at += int(counts.sum())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts + base), part.column(1), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = spark.createDataFrame(bases, "name string, base bigint").repartition(len(bases), "name")
    return tasks.mapInArrow(run, schema)


def op3(spark, sf_dir):
    folder = scratch(spark, "tokens")
    shards = write_sequences(table(spark, sf_dir, "documents"), folder, vocabulary_path())
    return read_documents(spark, folder, shards)
