"""Token-ID output (operator 1): flat unsigned integer files with 64-bit document offsets, read back memory-mapped.

Rows are range-partitioned by (doc_id, hash of the text, row number), so that no partition holds more than its share even if one
doc_id, or one row, has a third of all rows, and each task writes one shard: ``.bin`` (ids, 16 bits where the vocabulary
fits), ``.off`` (n + 1 offsets, 64 bits) and ``.doc`` (doc_ids, 64 bits). A shard is written under another name and
renamed, so a lost or repeated task leaves whole files only. The number of ids before a shard is a prefix sum over
the manifest, which has one row a shard.

Edge cases: a null or empty text has the end id alone; a null doc_id sorts first; rows that share a doc_id each keep
their own entry, ordered by the text's hash, then text; a very long text is encoded whole, as a slice of its own; an empty table writes no shard and returns no row; columns
besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_path, parts, scratch, table
from .encoding import encoder

NO_ID = np.iinfo(np.int64).min
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


def write_token_files(docs: DataFrame, tokenizer: str, out_dir: str, end_id: int = 1, partitions: int | None = None) -> list[dict]:
    """Write the shards to ``out_dir`` (a path on a volume that all executors mount) and return the manifest."""
    os.makedirs(out_dir, exist_ok=True)
    n = partitions or parts(docs.sparkSession)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange(n, "doc_id", "h", F.monotonically_increasing_id())  # the last splits rows that are the same
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text")
    )

    def write(batches):
        enc = None
        shard = TaskContext.get().partitionId()
        n_docs = n_tokens = 0
        tmp = f"{out_dir}/tmp-{shard:07d}-{TaskContext.get().taskAttemptId()}"
        files = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if enc is None:
                enc = encoder(tokenizer, end_id)
                kind = np.uint16 if enc.vocab <= 65536 and end_id < 65536 else np.uint32
                files = {x: open(f"{tmp}.{x}", "wb") for x in ("bin", "off", "doc")}
                files["off"].write(np.zeros(1, "<i8").tobytes())
            ids_of = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
            files["doc"].write(ids_of.tobytes())
            for _, ids, off in enc.slices(batch.column(1)):
                files["bin"].write(ids.astype(np.dtype(kind).newbyteorder("<")).tobytes())
                files["off"].write((off[1:] + n_tokens).astype("<i8").tobytes())
                n_tokens += len(ids)
            n_docs += batch.num_rows
        for x, f in files.items():
            f.close()
            os.replace(f.name, f"{out_dir}/shard-{shard:07d}.{x}")
        if files:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens], "width": pa.array([np.dtype(kind).itemsize], pa.int32())})

    # One row a shard comes to the driver: as many as there are tasks, whatever the corpus holds.
    rows = ordered.mapInArrow(write, "shard int, n_docs long, n_tokens long, width int").collect()
    manifest, base = [], 0
    for r in sorted(rows, key=lambda r: r.shard):
        manifest.append(r.asDict() | {"base": base})
        base += r.n_tokens
    with open(f"{out_dir}/manifest.json.tmp", "w") as f:
        json.dump({"end_id": end_id, "shards": manifest}, f)
    os.replace(f"{out_dir}/manifest.json.tmp", f"{out_dir}/manifest.json")
    return manifest


def open_shard(out_dir: str, shard: int, width: int):
    """(ids, offsets, doc_ids) of a shard, memory-mapped."""
    name = f"{out_dir}/shard-{shard:07d}"
    kind = "<u2" if width == 2 else "<u4"
    ids = np.memmap(f"{name}.bin", kind, "r") if os.path.getsize(f"{name}.bin") else np.zeros(0, kind)
    return ids, np.memmap(f"{name}.off", "<i8", "r"), np.memmap(f"{name}.doc", "<i8", "r")


def read_token_files(spark: SparkSession, out_dir: str, manifest: list[dict] | None = None) -> DataFrame:
    """One row a document, from the files alone: where its ids start among all, how many they are, their crc32."""
    if manifest is None:
        with open(f"{out_dir}/manifest.json") as f:
            manifest = json.load(f)["shards"]
    shards = spark.createDataFrame([(m["shard"], m["width"], m["base"]) for m in manifest], "shard int, width int, base long")
    shards = shards.repartition(max(1, len(manifest)), "shard")

    def read(batches):
        for batch in batches:
            for shard, width, base in zip(*[c.to_pylist() for c in batch.columns]):
                ids, off, docs = open_shard(out_dir, shard, width)
                for a in range(0, len(docs), 50_000):
                    o, d = np.array(off[a : a + 50_001]), np.array(docs[a : a + 50_000])
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(o[:-1].tolist(), o[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d, mask=d == NO_ID), pa.array(o[:-1] + base), pa.array(np.diff(o)), pa.array(crc, pa.int64()), pa.array(np.full(len(d), shard, np.int32))],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                    )

    return shards.mapInArrow(read, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = local_path(scratch(spark, "tokens"))
    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    return read_token_files(spark, out, manifest)
