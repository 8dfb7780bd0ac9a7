"""Checkpointed streaming compactor of tiny per-community CSV deliveries.

A file-source stream discovers every input file once (its checkpoint remembers them), takes what is available in micro-batches of
bounded bytes, parses them and writes each batch as landed/batch=N with mode overwrite: a retried batch replaces its own earlier
output. No batch looks at another one, so 100,000 batches cost as much as their bytes.

When the stream has taken all there was, the landed batches become one generation of three datasets:

  deliveries/generation=G   one row per delivery: file_id, community, file_kind, n_records, fingerprint
  edges/generation=G, vertices/generation=G   the records of the deliveries that count, every field as delivered

A delivery counts unless an earlier generation, or a delivery of smaller file_id in the same one, has the same community, kind and
records (as a multiset of header-named fields). Files are sized by what the landed batches take on disk, for each kind. Generations
too small for a file of the aimed-at size are taken into a later one, so a trickle of deliveries doesn't leave small files for ever.
A generation counts when its commit file, written last, names it; a broken attempt is overwritten by the next one.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kithloom.functions.canonical import canonical_name
from kithloom.operators.skew import skew_join
from kithloom.session import keep

#: Input bytes that a micro-batch takes for each task that can run at once.
TASK_BYTES = 256 << 20
#: Aimed-at bytes of one output file.
TARGET_BYTES = 128 << 20
#: So many generations too small for one file of that size are taken together.
MERGE_AFTER = 8
EDGE_FIELDS = ("__src_id", "__dst_id", "weight", "mindate", "maxdate")
VERTEX_FIELDS = ("__id",)
KINDS = {"edges": EDGE_FIELDS, "vertices": VERTEX_FIELDS}
DELIVERY_KEYS = ("community", "file_kind", "fingerprint")
RECORD = T.StructType([T.StructField(c, T.StringType()) for c in (*EDGE_FIELDS, *VERTEX_FIELDS)])
PARSED = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("community", T.StringType()),
        T.StructField("file_kind", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n_records", T.LongType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("records", T.ArrayType(RECORD)),
    ]
)
MANIFEST = T.StructType([f for f in PARSED.fields if f.name not in ("records", "n_chars")])
#: A landed delivery: its batch and place in it identify it, as file_id may be null or repeated.
PLACE = ("batch", "place")
LANDED = T.StructType([*PARSED.fields, T.StructField("place", T.LongType()), T.StructField("batch", T.LongType())])


def parse_records(body: str | None) -> list[dict[str, str]]:
    """The records of one CSV text, as {header: field}.

    Byte-order mark, line ends, quoting and the order of columns make no difference; the separator is the one of comma,
    semicolon, tab and bar that the header holds most often. Blank lines are no records. A field beyond the header is
    kept under the name ``+i``, a missing one is absent. Null, an empty text and a lone header give no records.
    """
    text = (body or "").lstrip("﻿")
    if not text.strip():
        return []
    csv.field_size_limit(1 << 31)
    head = text.lstrip("\r\n").split("\n", 1)[0]
    mark = max(",;\t|", key=head.count)
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=mark)
    names: list[str] | None = None
    found = []
    for row in rows:
        if not row:
            continue
        if names is None:
            names = [x.strip().lstrip("﻿") for x in row]
            continue
        found.append({(names[i] if i < len(names) else f"+{i}"): x for i, x in enumerate(row)})
    return found


def fingerprint(records: list[dict[str, str]]) -> str:
    """256-bit digest of the multiset of records; lengths are written out, so no two multisets share a serialisation."""
    lines = sorted("".join(f"{len(k)}:{k}{len(v)}:{v}" for k, v in sorted(r.items())) for r in records)
    digest = hashlib.sha256()
    for x in lines:
        digest.update(f"{len(x)}:".encode())
        digest.update(x.encode("utf-8", "surrogatepass"))
    return digest.hexdigest()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema(
        [
            ("file_id", pa.int64()), ("community", pa.string()), ("file_kind", pa.string()), ("n_chars", pa.int64()),
            ("n_records", pa.int64()), ("fingerprint", pa.string()),
            ("records", pa.list_(pa.struct([(c, pa.string()) for c in (*EDGE_FIELDS, *VERTEX_FIELDS)]))),
        ]
    )
    for batch in batches:
        columns = batch.to_pydict()
        out = []
        for file_id, community, kind, body in zip(columns["file_id"], columns["community"], columns["file_kind"], columns["body"]):
            records = parse_records(body)
            out.append(
                {
                    "file_id": file_id, "community": community, "file_kind": kind, "n_chars": len(body or ""),
                    "n_records": len(records), "fingerprint": fingerprint(records), "records": records,
                }
            )
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)


def parse_deliveries(files: DataFrame) -> DataFrame:
    """PARSED rows of (file_id, community, file_kind, body); other columns are ignored, communities come out in canonical spelling, bytes that aren't UTF-8 as U+FFFD."""
    needed = files.select(
        F.col("file_id").cast("long"), F.make_valid_utf8(canonical_name("community")).alias("community"), F.lower(F.btrim("file_kind")).alias("file_kind"), F.make_valid_utf8(F.col("body").cast("string")).alias("body")
    )
    return needed.mapInArrow(_parse, PARSED)


def counting(deliveries: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(PLACE, file_kind, n_chars) of the deliveries that count: with records, the smallest file_id of their keys, and no such keys in ``before``."""
    first = F.struct(F.col("file_id").isNull(), "file_id", *PLACE, "n_chars")
    firsts = deliveries.where("n_records > 0").groupBy(*DELIVERY_KEYS).agg(F.min(first).alias("first"))
    if before is not None:
        known = before.where("n_records > 0").select(*DELIVERY_KEYS).distinct()
        firsts = firsts.join(known, [firsts[c].eqNullSafe(known[c]) for c in DELIVERY_KEYS], "left_anti")
    return firsts.select(*(F.col(f"first.{c}").alias(c) for c in PLACE), "file_kind", "first.n_chars")


class _Files:
    """The file system of a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.system = self.make(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def status(self, path: str):
        """The entry of a path without wildcards; None where there is none."""
        return self.system.getFileStatus(self.make(path)) if self.system.exists(self.make(path)) else None

    def names(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.system.listStatus(self.make(path))) if self.status(path) else []

    def bytes(self, path: str) -> int:
        return self.system.getContentSummary(self.make(path)).getLength() if self.status(path) else 0

    def delete(self, path: str) -> None:
        self.system.delete(self.make(path), True)

    def put(self, path: str, text: str) -> None:
        """Writes a small file so that it is there as a whole or not at all."""
        out = self.system.create(self.make(path + ".tmp"), True)
        out.write(text.encode())
        out.close()
        self.system.delete(self.make(path), False)
        if not self.system.rename(self.make(path + ".tmp"), self.make(path)):
            raise OSError(f"can't write {path}")


@dataclass(frozen=True)
class Compacted:
    """Where a compaction keeps its datasets."""

    spark: SparkSession
    root: str

    def state(self) -> dict:
        """The last commit: its number, the generations that count, and the last batch that they hold."""
        kept = [n for n in _Files(self.spark, self.root).names(f"{self.root}/commits") if n.endswith(".json")]
        if not kept:
            return {"generation": -1, "generations": [], "batch": -1}
        return json.loads(self.spark.read.text(f"{self.root}/commits/{kept[-1]}", wholetext=True).first()[0])

    def read(self, name: str, generations: list[int] | None = None) -> DataFrame:
        """A dataset, or some of its generations."""
        schema = MANIFEST if name == "deliveries" else _sink_schema(KINDS[name])
        chosen = self.state()["generations"] if generations is None else generations
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{name}/generation={g}" for g in chosen))

    def deliveries(self) -> DataFrame:
        return self.read("deliveries")

    def edges(self) -> DataFrame:
        return self.read("edges")

    def vertices(self) -> DataFrame:
        return self.read("vertices")


def _sink_schema(fields: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField("file_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("community", *fields))])


def _land(root: str):
    """Writes a micro-batch, parsed, under its number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_deliveries(batch).withColumn("place", F.monotonically_increasing_id())
        parsed.write.mode("overwrite").parquet(f"{root}/landed/batch={batch_id}")

    return write


def settle(spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES) -> Compacted:
    """Makes the landed batches that no generation holds yet into one; nothing to do where there are none.

    The records are moved once, to the task that writes them; which deliveries count is settled before on their keys alone.
    """
    done, files = Compacted(spark, root), _Files(spark, root)
    state = done.state()
    fresh = [n for n in files.names(f"{root}/landed") if n.startswith("batch=") and int(n[6:]) > state["batch"]]
    if not fresh:
        return done
    number, kept = state["generation"] + 1, state["generations"]
    landed = spark.read.schema(LANDED).option("basePath", f"{root}/landed").parquet(*(f"{root}/landed/{n}" for n in fresh))
    manifest = landed.drop("records")
    chosen = keep(counting(manifest, done.deliveries() if kept else None), "counting")
    chars = {r.file_kind: r.n for r in chosen.groupBy("file_kind").agg(F.sum("n_chars").alias("n")).collect()}
    total = manifest.agg(F.sum("n_chars")).first()[0] or 0
    per_char = sum(files.bytes(f"{root}/landed/{n}") for n in fresh) / max(total, 1)
    size = {g: sum(files.bytes(f"{root}/{kind}/generation={g}") for kind in KINDS) for g in kept}
    small = [g for g in kept if size[g] < target_bytes]
    small = small if len(small) >= MERGE_AFTER else []
    for kind, fields in KINDS.items():
        earlier = sum(files.bytes(f"{root}/{kind}/generation={g}") for g in small)
        parts = max(1, math.ceil((chars.get(kind, 0) * per_char + earlier) / target_bytes))
        ours = landed.where(F.col("file_kind") == kind).repartition(parts, *PLACE)
        counted = ours.join(chosen.where(F.col("file_kind") == kind).select(*PLACE).repartition(parts, *PLACE), list(PLACE), "left_semi")
        rows = counted.select("file_id", "community", F.explode("records").alias("r")).select("file_id", "community", *(F.col(f"r.{c}").alias(c) for c in fields))
        if small:
            rows = rows.unionByName(done.read(kind, small)).repartition(parts)
        rows.write.mode("overwrite").parquet(f"{root}/{kind}/generation={number}")
    known = manifest.select(*MANIFEST.names)
    if small:
        known = known.unionByName(done.read("deliveries", small))
    share = (total * per_char + sum(files.bytes(f"{root}/deliveries/generation={g}") for g in small)) / target_bytes
    known.coalesce(max(1, math.ceil(share))).write.mode("overwrite").parquet(f"{root}/deliveries/generation={number}")
    last = max(int(n[6:]) for n in fresh)
    files.put(f"{root}/commits/{number:010d}.json", json.dumps({"generation": number, "generations": [g for g in kept if g not in small] + [number], "batch": last}))
    for n in fresh:
        files.delete(f"{root}/landed/{n}")
    for g in small:
        for name in ("deliveries", *KINDS):
            files.delete(f"{root}/{name}/generation={g}")
    return done


def compact(
    spark: SparkSession, source: str, root: str, checkpoint: str, batch_bytes: int | None = None, target_bytes: int = TARGET_BYTES
) -> Compacted:
    """Takes all files below ``source`` that this ``checkpoint`` hasn't seen and adds them to the datasets in ``root``.

    ``source`` is a Parquet folder, file or glob of deliveries (file_id, community, file_kind, body, ...). It may be called
    again after more files have landed, or after a failure: batches and generations are replaced, never repeated. A micro-batch
    takes ``batch_bytes``, by default TASK_BYTES for each task that the cluster runs at once.
    """
    where = source.rstrip("/")
    found = _Files(spark, where).status(where)
    if found is not None and found.isFile():
        where = f"{where[:-1]}[{where[-1]}]"  # the file source takes folders and patterns only
    most = TASK_BYTES * spark.sparkContext.defaultParallelism if batch_bytes is None else batch_bytes
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxBytesPerTrigger", most).parquet(where)
    query = (
        stream.select("file_id", "community", "file_kind", "body")
        .writeStream.foreachBatch(_land(root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return settle(spark, root, target_bytes)


def repeats(deliveries: DataFrame) -> DataFrame:
    """file_id of each delivery with records that equals one of a smaller file_id, of the same community and kind.

    A null community or kind equals itself. A repeated statement of one file_id is one delivery.
    """
    null = F.lit("\0")
    held = deliveries.where("n_records > 0").select(
        "file_id", F.concat_ws("\1", F.coalesce("community", null), F.coalesce("file_kind", null), "fingerprint").alias("k")
    )
    shared = held.groupBy("k").agg(F.min("file_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("k", "first_id")
    return skew_join(held, shared, ["k"]).where("file_id > first_id").select("file_id").distinct()
