"""Token counts of flat token files by separator scan [operator 8].

A token file is ids end to end, little-endian, each document followed by the
end-of-document id; nothing else says where documents are. Files are cut into
blocks of bytes that tasks range-read; each block finds its separators with one
vectorised comparison. What a document has in earlier blocks, and its number in
the file, come from a prefix scan over one summary row per block.

Defined results: two separators in a row bound an empty document of 0 tokens;
ids after the last separator are a document too, marked as not ended; an empty
file has no documents. When files are written, null texts count as empty and null
ids are kept; each row is a document of its own, repeated or not. Other columns of
the input do not matter: the results have their own columns only.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import textkit as tk
from plumbline.llm.bpe import SLICE, byte_bpe
from plumbline.llm.workspace import in_tasks, keep, new_dir

BLOCK_BYTES = 8 << 20
WIDTHS = {2: "<u2", 4: "<u4"}


def write_files(docs: DataFrame, path: str, end_id: int = 50256, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes documents into flat files in the shared folder, one per task.

    Returns (file, number, id): which document stands where. Each attempt of a
    task writes a file of its own, and only those of attempts that succeeded are
    in the result. End ids in a text's own ids do not occur: its special strings
    are encoded as ordinary text.
    """
    folder = new_dir(docs.sparkSession, "tokens")

    def run(batches):
        bpe = byte_bpe(path)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}.bin"
        number = 0
        with store.open_output_stream(name) as out:
            for batch in batches:
                for s in tk.slices(batch.column(1), SLICE):
                    ids, offsets = bpe.encode_plain(batch.column(1).slice(s.first, s.rows))
                    out.write(np.insert(ids, offsets[1:], end_id).astype(WIDTHS[width]).tobytes())
                    columns = [pa.array([name] * s.rows), pa.array(np.arange(number, number + s.rows)), batch.column(0).slice(s.first, s.rows)]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "number", "id"])
                    number += s.rows

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    index = docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(run, "file string, number long, id long")
    return keep(index, "token-index").withColumn("folder", F.lit(folder))


def count(files: DataFrame, end_id: int = 50256, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document of the files named in `files` (folder, file): file, number, start and n_tokens, ended."""

    def blocks(batches):
        for batch in batches:
            for folder, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = fs.FileSystem.from_uri(folder)[0].get_file_info(file).size
                at = np.arange(0, size, block_bytes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([folder] * len(at), pa.string()), pa.array([file] * len(at), pa.string()), pa.array(np.arange(len(at))), pa.array(at), pa.array(np.minimum(block_bytes, size - at))],
                    names=["folder", "file", "block", "at", "size"],
                )

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with fs.FileSystem.from_uri(row["folder"])[0].open_input_file(row["file"]) as f:
                    ids = np.frombuffer(f.read_at(row["size"], row["at"]), WIDTHS[width])
                ends = pa.array(np.flatnonzero(ids == end_id))
                columns = [pa.array([row["file"]]), pa.array([row["block"]]), pa.array([len(ids)]), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), ends)]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "tokens", "ends"])

    found = files.select("folder", "file").distinct().mapInArrow(blocks, "folder string, file string, block long, at long, size long")
    found = in_tasks(keep(found, "blocks")).mapInArrow(scan, "file string, block long, tokens long, ends array<long>")
    found = keep(found, "separators")
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "block", "tokens", F.size("ends").alias("n"), F.array_max("ends").alias("last"))
    summary = summary.withColumn("base", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
    summary = summary.select(
        "file",
        "block",
        "base",
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("number"),
        (F.coalesce(F.last(F.col("base") + F.col("last"), ignorenulls=True).over(upto), F.lit(-1)) + 1).alias("open"),
    )
    stitched = found.join(summary, ["file", "block"])
    ended = stitched.select("file", "number", "open", "base", F.posexplode("ends").alias("i", "end"), "ends")
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.element_at("ends", F.greatest(F.col("i"), F.lit(1))) + 1)
    ended = ended.select("file", (F.col("number") + F.col("i")).alias("number"), start.alias("start"), (F.col("base") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = found.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.sum(F.size("ends")).alias("number"))
    last = summary.join(found.select("file", "block", F.array_max("ends").alias("last")), ["file", "block"]).groupBy("file").agg(F.coalesce(F.max(F.col("base") + F.col("last")), F.lit(-1)).alias("last"))
    rest = whole.join(last, "file").filter(F.col("tokens") > F.col("last") + 1)
    rest = rest.select("file", "number", (F.col("last") + 1).alias("start"), (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)
