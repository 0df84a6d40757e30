"""Token ids in Arrow files of equal-length sequences (operator 1).

Layout below the output folder, for each shard of documents in ascending id order:

* `shard-NNNNN-TAG.seq.arrow`: record batches with `ids` fixed_size_list<uint16 or uint32>[seq_len] and
  `mask` fixed_size_list<bool>[seq_len]. All buffers are plain, so a reader that maps the file takes
  any sequence or mask by its position without a copy. The mask is false only for the padding after
  a shard's last document.
* `shard-NNNNN-TAG.doc.arrow`: record batches of (doc, start, n_tokens), `start` counted within the shard.

* `manifest.json`: for each shard its name, the tokens before it, its tokens and its documents.

Every attempt of a task writes files with a tag of its own, and the manifest, which the driver writes
last, names those of the attempts that counted. So nothing is renamed, a lost executor or a task that
runs twice leaves no half shard that a reader could take, and files of a run before, or of attempts
that did not count, are deleted. The driver gets one small row for each shard.

The library encodes each word once per worker while its memo has room, and the ids of a text are the
joined ids of its words: neither the tokenizer's normalizer nor its patterns reach over ASCII white
space. Words of plain characters go straight to the library's model, part by part, others through
its whole pipeline. The memo is a cache of bounded size, not a limit, and long words are not kept.

Results in odd cases: a null or empty text has only the end id; rows with a null id come first,
repeated rows stay, ties are ordered by a hash of the text; an empty table gives no shards and an
empty result; other columns are ignored; texts of any length are handled whole.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: Words whose ids a worker remembers, in a newer and an older memo each.
MEMO_WORDS = 400_000
#: Longer words, in bytes, are not remembered; so a memo has at most MEMO_WORDS times a few hundred bytes.
LONGEST_WORD = 64
#: Sequences in a record batch.
BATCH_SEQUENCES = 64


class Memo(dict):
    """Values made on demand; of two generations, the older is dropped when the newer is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST_WORD:
            self[key] = found
        return found

    def trim(self) -> None:
        if len(self) >= MEMO_WORDS:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Ids of a text as little-endian bytes."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words, self.parts = Memo(self.word), Memo(self.part)
        # The short way for words of plain characters: cut by the tokenizer's own pattern, and give
        # each part to the tokenizer's model once. It holds for the pipeline of steps named here.
        spec = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.short = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
        if self.short:
            self.find = regex.compile(cuts[0]["pattern"]["Regex"]).findall
            self.plain = regex.compile(r"[!-~¡-¬®-įı-ɏ]+").fullmatch  # no white space, combining or format characters
            self.added = [x["content"] for x in spec["added_tokens"]]
            self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def part(self, text: str) -> bytes:
        mapped = text if text.isascii() else self.to_bytes(text)[0][0]
        return array("H" if self.kind.itemsize == 2 else "I", [x.id for x in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def word(self, raw: bytes) -> bytes:
        if self.short:
            if raw.isalpha():  # ASCII letters are one part
                return self.parts[raw.lower().decode("ascii")]
            if raw[:-1].isalpha() and raw[-1:] in b".,;:!?":
                return self.parts[raw[:-1].lower().decode("ascii")] + self.parts[raw[-1:].decode("ascii")]
        text = raw.decode("utf-8")
        if self.short and self.plain(text) and not any(x in text for x in self.added):
            return b"".join([self.parts[x] for x in self.find(text.lower())])
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        get, out = self.words.__getitem__, []
        for x in texts:
            out.append(b"".join(map(get, x.encode("utf-8").split())))
            self.words.trim()
            self.parts.trim()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def file_system(path: str):
    """(file system, path) for a URI such as s3://, gs://, hdfs:// or file://, or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else "file://" + path[5:])


class ShardWriter:
    """Streams documents to one shard; holds one record batch of ids at a time."""

    def __init__(self, out_dir: str, shard: int, id_type: pa.DataType, kind: np.dtype, seq_len: int):
        self.fs, top = file_system(out_dir)
        self.fs.create_dir(top, recursive=True)
        self.name = f"shard-{shard:05d}-{uuid.uuid4().hex}"
        self.seq_len, self.kind = seq_len, kind
        value = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.seq_schema = pa.schema([("ids", pa.list_(value, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.doc_schema = pa.schema([("doc", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = {x: self.fs.open_output_stream(f"{top}/{self.name}.{x}.arrow") for x in ("seq", "doc")}
        self.out = {x: pa.ipc.new_file(self.sinks[x], s) for x, s in (("seq", self.seq_schema), ("doc", self.doc_schema))}
        self.held: list[bytes] = []
        self.held_bytes = self.tokens = self.docs = 0

    def add(self, ids: pa.Array, encoded: list[bytes]) -> None:
        sizes = np.array([len(x) // self.kind.itemsize for x in encoded], np.int64)
        starts = self.tokens + np.cumsum(sizes) - sizes
        self.out["doc"].write_batch(pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(sizes)], schema=self.doc_schema))
        self.tokens += int(sizes.sum())
        self.docs += len(encoded)
        self.held += encoded
        self.held_bytes += sum(map(len, encoded))
        step = self.seq_len * self.kind.itemsize * BATCH_SEQUENCES
        if self.held_bytes >= step:
            whole = b"".join(self.held)
            end = len(whole) // step * step
            for at in range(0, end, step):
                self._sequences(np.frombuffer(whole, self.kind, step // self.kind.itemsize, at), None)
            self.held, self.held_bytes = [whole[end:]], len(whole) - end

    def _sequences(self, ids: np.ndarray, real: int | None) -> None:
        mask = np.ones(len(ids), bool)
        if real is not None:
            mask[real:] = False
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)]
        self.out["seq"].write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.seq_schema))

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.held), self.kind)
        if len(rest):
            full = -(-len(rest) // self.seq_len) * self.seq_len
            self._sequences(np.concatenate([rest, np.zeros(full - len(rest), self.kind)]), len(rest))
        for x in self.out:
            self.out[x].close()
            self.sinks[x].close()


Manifest = list[tuple[str, int, int, int]]  # name, tokens before, tokens, documents


def write_manifest(out_dir: str, manifest: Manifest) -> None:
    """Name the shards that count, and delete other shards that are there."""
    from pyarrow import fs

    store, top = file_system(out_dir)
    store.create_dir(top, recursive=True)
    with store.open_output_stream(f"{top}/manifest.json") as out:
        out.write(json.dumps([dict(zip(("name", "before", "tokens", "documents"), m)) for m in manifest]).encode())
    named = {f"{m[0]}.{x}.arrow" for m in manifest for x in ("seq", "doc")}
    for info in store.get_file_info(fs.FileSelector(top)):
        if info.base_name.startswith("shard-") and info.base_name.endswith(".arrow") and info.base_name not in named:
            store.delete_file(info.path)


def read_manifest(out_dir: str) -> Manifest:
    store, top = file_system(out_dir)
    with store.open_input_stream(f"{top}/manifest.json") as file:
        return [(m["name"], m["before"], m["tokens"], m["documents"]) for m in json.loads(file.read())]


def in_order(shards: list[tuple[str, int, int]]) -> Manifest:
    """Shards (name, tokens, documents) by their number, with the tokens before each. The order of the
    names as text is another one beyond 99,999 shards."""
    out, before = [], 0
    for name, tokens, n in sorted(shards, key=lambda s: int(s[0].split("-")[1])):
        out.append((name, before, tokens, n))
        before += tokens
    return out


def write_token_files(
    docs: DataFrame,
    out_dir: str,
    tokenizer_path: str,
    end_id: int = 1,
    seq_len: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Manifest:
    """Write the shards and the manifest, which is returned too."""
    small_batches(docs.sparkSession)
    ordered = (
        docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(F.col("doc").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc").asc_nulls_first(), "tie")
    )

    def write(batches):
        writer, shard = None, TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                enc = encoder(tokenizer_path)
                if writer is None:
                    writer = ShardWriter(out_dir, shard, batch.column("doc").type, enc.kind, seq_len)
                end = np.asarray([end_id], enc.kind).tobytes()
                writer.add(batch.column("doc"), [x + end for x in enc(batch.column("text").to_pylist())])
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"name": pa.array([writer.name], pa.string()), "tokens": pa.array([writer.tokens], pa.int64()), "docs": pa.array([writer.docs], pa.int64())})

    manifest = in_order([tuple(r) for r in ordered.mapInArrow(tidy(write), "name string, tokens long, docs long").collect()])
    write_manifest(out_dir, manifest)
    return manifest


class Shard:
    """One shard, opened for reading; `sequence(i)` and `mask(i)` are views of the file."""

    def __init__(self, out_dir: str, name: str):
        from pyarrow import fs

        store, top = file_system(out_dir)
        name = f"{top}/{name}"
        local = isinstance(store, fs.LocalFileSystem)
        self.seq, self.doc = (pa.ipc.open_file(pa.memory_map(f"{name}.{x}.arrow") if local else store.open_input_file(f"{name}.{x}.arrow")) for x in ("seq", "doc"))
        self.seq_len = self.seq.schema.field("ids").type.list_size

    def batch(self, i: int) -> np.ndarray:
        """Ids of the i-th record batch, one after the other, without a copy."""
        return self.seq.get_batch(i).column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> np.ndarray:
        at, row = divmod(i, BATCH_SEQUENCES)
        return self.batch(at)[row * self.seq_len : (row + 1) * self.seq_len]

    def mask(self, i: int) -> pa.BooleanArray:
        at, row = divmod(i, BATCH_SEQUENCES)
        return self.seq.get_batch(at).column("mask").flatten().slice(row * self.seq_len, self.seq_len)

    def tokens(self, start: int, n: int):
        """Views that together are the ids from `start` on."""
        step = BATCH_SEQUENCES * self.seq_len
        while n > 0:
            at, off = divmod(start, step)
            part = self.batch(at)[off : off + n]
            yield part
            start, n = start + len(part), n - len(part)

    def documents(self):
        for i in range(self.doc.num_record_batches):
            yield self.doc.get_batch(i)


def read_token_files(spark: SparkSession, out_dir: str, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """Rows of (id, start, n_tokens, ids_crc32) from the files; start counts over all shards."""
    manifest = read_manifest(out_dir)
    shards = spark.createDataFrame([x[:2] for x in manifest], "name string, before long").repartition(max(1, len(manifest)))

    def read(batches):
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist()):
                opened = Shard(out_dir, name)
                for docs in opened.documents():
                    sums = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                        crc = 0
                        for part in opened.tokens(start, n):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        sums.append(crc)
                    starts = pa.array(docs.column("start").to_numpy() + before)
                    yield pa.RecordBatch.from_arrays([docs.column("doc"), starts, docs.column("n_tokens"), pa.array(sums, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(tidy(read), f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")
