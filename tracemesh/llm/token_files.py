"""Token ids in flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tracemesh.llm.common import id_and_text, small_batches
from tracemesh.session import discard, materialise, shared_folder

END = 2
#: Words whose ids a worker remembers before it starts afresh.
REMEMBERED = 600_000
#: Stands for a null id in the file of document ids.
NO_ID = -(1 << 63)
#: Rows of one id are dealt to parts by the beginning of their text, which bounds what the driver sees of a text.
RANGE_CHARACTERS = 256
MANIFEST = "manifest"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class WordCoder:
    """Ids of texts from the ids of their words.

    For tokenizers that drop white space and lower the case: no token reaches over white space, so the ids of a text are
    those of its words in order.  The library encodes a word when it is first seen; a word of Latin letters goes to its merge
    model directly, since normalising leaves nothing but lower case to do and splitting nothing.
    """

    PROBE = "It's a test, isn't it?\n\tÉtude Nº 42: übergroß -- x+y=z   naïve."

    def __init__(self, tokenizer_json: str, end: int = END):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4")
        letters = byte_letters()
        self.spelled = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x41, 0x250)}
        self.known: dict[bytes, bytes] = {}
        self.end = np.array([end], self.dtype).tobytes()
        if self.encode(self.PROBE) != self._pack([*self._library(self.PROBE), end]):
            raise ValueError("this tokenizer does not encode word by word")

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode().lower()
        if text.isalpha() and max(text) < "ɐ":
            return self._pack([t.id for t in self.model.tokenize(text.translate(self.spelled))])
        body = text.rstrip(".,")
        if body and len(body) < len(text) and body[-1].isalpha() and body.isalpha() and max(body) < "ɐ":
            return self._seen(body.encode()) + self._seen(text[len(body) :].encode())
        return self._pack(self._library(word.decode()))

    def _seen(self, word: bytes) -> bytes:
        if word not in self.known:
            self.known[word] = self._word(word)
        return self.known[word]

    def encode(self, text: str) -> bytes:
        """The ids and the end id as little-endian integers of the width of the file."""
        words, known = text.encode().split(), self.known
        try:
            parts = [known[w] for w in words]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
            parts = [known[w] for w in words]
        return b"".join(parts) + self.end


@lru_cache(maxsize=2)
def _coder(tokenizer_json: str, end: int) -> WordCoder:
    return WordCoder(tokenizer_json, end)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark gives it: without one it lies on the default file system, on any executor."""
    if "://" in path:
        return path
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and "://" not in whole else whole


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end: int = END, partitions: int | None = None) -> DataFrame:
    """Encode all texts and write them in ascending order of id; returns the manifest.

    Every task writes three files: ids, offsets (one more than documents, from 0) and document ids.  Their names are
    new for each attempt, and the manifest names those of the attempts that succeeded, so a task that is lost and run again
    leaves no mark.  ``(part, ids_path, offsets_path, docs_path, width, n_docs, n_tokens, base)``: ``base`` is the
    number of ids in all parts before, a prefix sum over one row per part.  The manifest is written last, as Parquet in
    ``folder/manifest``, so that :func:`read_manifest` opens the files in any later session.  A ``folder`` without a scheme
    lies where Spark would put it, and must not hold a manifest yet.

    Rows without an id come first; rows of one id are ordered by text; a null or empty text has the end id only.  Repeated
    rows are rows like any other; many rows of one id are dealt to several parts by their texts.  Texts may be of any length.  An empty
    table gives an empty manifest.  Columns other than id and text are not looked at.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = spark.sparkContext.broadcast(file.read())  # a vocabulary of fixed size
    folder = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        coder, part = _coder(tokenizer.value, end), TaskContext.get().partitionId()
        stem = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        files, base = _file_system(stem)
        files.create_dir(base.rsplit("/", 1)[0], recursive=True)
        n_docs = n_tokens = 0
        with files.open_output_stream(f"{base}.ids") as ids, files.open_output_stream(f"{base}.offsets") as offsets, files.open_output_stream(f"{base}.docs") as names:
            offsets.write(np.zeros(1, "<u8").tobytes())
            while batch is not None:
                if batch.num_rows:
                    coded = [coder.encode(t) for t in batch["text"].to_pylist()]
                    ends = n_tokens + np.cumsum([len(c) // coder.dtype.itemsize for c in coded], dtype="<u8")
                    ids.write(b"".join(coded))
                    offsets.write(ends.astype("<u8").tobytes())
                    names.write(np.array([NO_ID if d is None else d for d in batch["doc_id"].to_pylist()], "<i8").tobytes())
                    n_docs, n_tokens = n_docs + len(coded), int(ends[-1])
                batch = next(batches, None)
        row = {"part": part, "ids_path": f"{stem}.ids", "offsets_path": f"{stem}.offsets", "docs_path": f"{stem}.docs", "width": coder.dtype.itemsize, "n_docs": n_docs, "n_tokens": n_tokens}
        yield pa.RecordBatch.from_pylist([row])

    keys = ["doc_id", F.substring("text", 1, RANGE_CHARACTERS)]
    rows = id_and_text(docs)
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    schema = "part bigint, ids_path string, offsets_path string, docs_path string, width bigint, n_docs bigint, n_tokens bigint"
    parts = materialise(ranged.sortWithinPartitions("doc_id", "text").mapInArrow(write, schema).filter("n_docs > 0"), "token-parts")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).write.parquet(f"{folder}/{MANIFEST}")
    discard(parts)
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of the files that :func:`write_tokens` wrote to ``folder``, in this session or an earlier one.

    Files that it does not name were left by lost attempts.  A folder whose writing did not end has none, which is an error.
    """
    return spark.read.parquet(f"{qualified(spark, folder).rstrip('/')}/{MANIFEST}")


def _mapped(path: str, dtype: str) -> np.ndarray:
    """The numbers of a file: memory-mapped where the file system allows it, else read."""
    files, name = _file_system(path)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(name, dtype, mode="r")
    with files.open_input_file(name) as file:
        return np.frombuffer(file.read_buffer(), dtype)


def read_tokens(manifest: DataFrame, rows_a_batch: int = 500) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files of a manifest, one task per part.

    ``ids`` holds the ids of a document as little-endian unsigned 32-bit integers.  An empty manifest gives no rows.
    """
    parts = max(1, manifest.count())
    columns = ["part", "ids_path", "offsets_path", "docs_path", "width", "base"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                ids = _mapped(part["ids_path"], f"<u{part['width']}")
                offsets, names = _mapped(part["offsets_path"], "<u8"), _mapped(part["docs_path"], "<i8")
                for at in range(0, len(names), rows_a_batch):
                    ends = offsets[at : at + rows_a_batch + 1].astype(np.int64)
                    own = np.array(names[at : at + rows_a_batch])
                    texts = [ids[s:e].astype("<u4").tobytes() for s, e in zip(ends, ends[1:], strict=False)]
                    yield pa.record_batch(
                        [pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(ends[:-1] + part["base"]), pa.array(np.diff(ends)), pa.array(texts, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    dealt = manifest.select(*columns).repartitionByRange(parts, "part")
    return dealt.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/tracemesh/tokens-{uuid.uuid4().hex}"
