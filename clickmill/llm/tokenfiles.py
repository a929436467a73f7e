"""Token-id files: raw id payloads in shards, and a minimal perfect hash index from document keys to offsets."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmill.session import scratch_path

from .common import one_memory, runs, ship, small_table, table
from .encode import encoder
from .hashindex import look_up, mix, pack

MAGIC = b"TOKIDS1\0"
#: Magic, bytes per id, id after each document.
HEADER = "<8sII"
#: The id after each document.
END = 0
#: Text bytes per shard, and the most shards; documents per index file.
SHARD_BYTES, MOST_SHARDS, KEYS_PER_INDEX = 32 << 20, 20_000, 50_000
#: Characters of a text by which rows that repeat an id are dealt to shards; those that agree in them share one.
RANGE_CHARS = 16


@dataclass
class TokenFiles:
    """A written folder: ``shard-N.ids``, ``index-N.mph``, and the tables of their documents and shards."""

    path: str
    buckets: int
    entries: DataFrame
    shards: DataFrame


def filesystem(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri)


def put(fs: arrow_fs.FileSystem, temporary: str, final: str) -> None:
    """A repeated task writes the same bytes under the same name."""
    if fs.get_file_info(final).type != arrow_fs.FileType.NotFound:
        fs.delete_file(final)
    fs.move(temporary, final)


def key_hash(ids: pa.Array, nth: pa.Array) -> np.ndarray:
    """64-bit key of (document id, how many rows of that id come before); a null id is a key of its own kind."""
    values = np.asarray(ids.fill_null(0), np.int64).view(np.uint64)
    keys = mix(values, 2000) ^ mix(np.asarray(nth, np.int64).view(np.uint64), 2001)
    return np.where(np.asarray(ids.is_null()), mix(keys, 2002), keys)


def write_token_files(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> TokenFiles:
    """Encode every whole text, with one end id after each, into shards in ascending order of id, and index them.

    Documents are dealt to shards by ranges of (id, beginning of the text), so a shard is one sorted partition and holds a contiguous
    part of the whole order, and the driver, which finds the ranges, sees no whole text; null ids come first, and rows that repeat
    an id are told apart by their order. A null text is empty. Tasks stream into their file; the driver sees one row per shard.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = min(MOST_SHARDS, max(1, -(-size // shard_bytes)))
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        there, base = filesystem(path)
        model = encoder(tokenizer)
        kind = np.dtype(model.kind)
        end = np.array([END], kind).tobytes()
        there.create_dir(base, recursive=True)
        temporary = f"{base}/.{uuid4().hex}"
        documents = ids = nth = 0
        last: object = ()
        with there.open_output_stream(temporary) as out:
            out.write(struct.pack(HEADER, MAGIC, kind.itemsize, END))
            for part in parts:
                offsets, sizes, repeats = [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    packed = model.encode(text) + end
                    nth = nth + 1 if (doc_id,) == last else 0
                    last = (doc_id,)
                    offsets.append(ids)
                    sizes.append(len(packed) // kind.itemsize)
                    repeats.append(nth)
                    ids += sizes[-1]
                    documents += 1
                    out.write(packed)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(repeats, pa.int64()), pa.array([shard] * len(sizes), pa.int32()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())],
                    names=["doc_id", "nth", "shard", "offset", "length"],
                )
        if documents:
            put(there, temporary, f"{base}/shard-{shard}.ids")
        else:
            there.delete_file(temporary)

    dealt = source.repartitionByRange(n_shards, "doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    local = table(dealt.mapInArrow(write, "doc_id bigint, nth bigint, shard int, offset bigint, length bigint"), "token-rows")

    found = local.groupBy("shard").agg(
        F.sum("length").alias("ids"), F.min(F.struct("doc_id")).alias("low"), F.max(F.struct("doc_id", "nth")).alias("high")
    )
    rows, start, carried = [], 0, ((), 0)
    for r in sorted(found.collect(), key=lambda r: r.shard):
        before = carried[1] if carried[0] == (r.low.doc_id,) else 0
        rows.append((r.shard, start, r.low.doc_id, before))
        start += r.ids
        same = (r.high.doc_id,) == (r.low.doc_id,)
        carried = ((r.high.doc_id,), r.high.nth + 1 + (before if same else 0))
    columns = zip(("shard", "base", "first_id", "before"), zip(*rows, strict=True) if rows else [[]] * 4, strict=True)
    shards = small_table(spark, **{name: list(values) for name, values in columns}).withColumn("shard", F.col("shard").cast("int"))
    entries = local.join(F.broadcast(shards), "shard")
    entries = entries.withColumn("nth", F.col("nth") + F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("before")).otherwise(0))
    buckets = max(1, -(-local.count() // KEYS_PER_INDEX))
    entries = entries.select("doc_id", "nth", "shard", "offset", "length", F.pmod(F.xxhash64("doc_id", "nth"), F.lit(buckets)).cast("int").alias("bucket"))
    entries = table(entries, "token-entries")

    def index(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_memory()
        there, base = filesystem(path)
        for (bucket,), rows in runs(parts, ["bucket"]):
            data = pack(key_hash(rows["doc_id"], rows["nth"]), *(rows[c].to_numpy(zero_copy_only=False) for c in ("shard", "offset", "length")))
            temporary = f"{base}/.{uuid4().hex}"
            with there.open_output_stream(temporary) as out:
                out.write(data)
            put(there, temporary, f"{base}/index-{bucket}.mph")
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(data)], pa.int64())], names=["bucket", "bytes"])

    by_bucket = entries.repartition("bucket").sortWithinPartitions("bucket")
    by_bucket.mapInArrow(index, "bucket int, bytes bigint").agg(F.sum("bytes")).collect()
    return TokenFiles(path, buckets, entries, shards)


def find(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """``keys(doc_id, nth)`` that the index holds, with shard, offset and length: one index file is read per
    bucket of keys, and each key costs a few hashes and one slot."""
    path, buckets = files.path, files.buckets
    wanted = keys.select("doc_id", "nth", F.pmod(F.xxhash64("doc_id", "nth"), F.lit(buckets)).cast("int").alias("bucket"))

    def locate(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, base = filesystem(path)
        for (bucket,), rows in runs(parts, ["bucket"]):
            name = f"{base}/index-{bucket}.mph"
            if there.get_file_info(name).type == arrow_fs.FileType.NotFound:
                continue
            with there.open_input_stream(name) as src:
                data = src.read()
            slots, ok = look_up(data, key_hash(rows["doc_id"], rows["nth"]))
            mask = pa.array(ok)
            out = [rows["doc_id"].filter(mask), rows["nth"].filter(mask)]
            out += [pa.array(slots[c][ok].astype(t)) for c, t in (("shard", np.int32), ("offset", np.int64), ("length", np.int64))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "nth", "shard", "offset", "length"])

    return wanted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(locate, "doc_id bigint, nth bigint, shard int, offset bigint, length bigint")


def read_ids(files: TokenFiles, places: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read the payload of each of ``places(doc_id, nth, shard, offset, length)``: global ``start``, ``n_tokens``,
    ``ids_crc32`` and, if asked for, the ids themselves."""
    path = files.path
    schema = "doc_id bigint, nth bigint, shard int, offset bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def load(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_memory()
        there, base = filesystem(path)
        opened, src, width = None, None, 2
        for part in parts:
            sums, lists = [], []
            for shard, offset, length in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != opened:
                    if src:
                        src.close()
                    src, opened = there.open_input_file(f"{base}/shard-{shard}.ids"), shard
                    magic, width, *_ = struct.unpack(HEADER, src.read_at(struct.calcsize(HEADER), 0))
                    if magic != MAGIC:
                        raise ValueError("not a token file")
                ids = np.frombuffer(src.read_at(length * width, struct.calcsize(HEADER) + offset * width), f"<u{width}").astype("<u4")
                sums.append(zlib.crc32(ids.tobytes()))
                lists.append(ids.astype(np.int64) if with_ids else None)
            kept = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "nth", "shard", "offset", "length")]
            more = [pa.array(lists, pa.list_(pa.int64()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.int64()), *more], names=["doc_id", "nth", "shard", "offset", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
        if src:
            src.close()

    read = places.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(load, schema)
    bases = F.broadcast(files.shards.select("shard", "base"))
    return read.join(bases, "shard").withColumn("start", F.col("base") + F.col("offset")).drop("base", "offset", "shard")


def token_index(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files of ``docs`` to the shared scratch folder and read every document back by its key.

    One row per row of ``docs``: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` (with the end id)
    and ``ids_crc32``. An empty or null text has the end id alone; rows that repeat an id follow each other, ordered by text;
    null ids come first; an empty table gives no rows. Other columns are not looked at.
    """
    spark: SparkSession = docs.sparkSession
    files = write_token_files(docs, tokenizer, scratch_path(spark, "tokens"), id_col, text_col)
    places = find(files, files.entries.select("doc_id", "nth"))
    return read_ids(files, places).select("doc_id", "start", "n_tokens", "ids_crc32")
