"""Tables as folders of Parquet that change by commits: keyed upsert by month, anti-join append by day.

A table is a folder. Data lie under _v=V/_part=P, where P is a month or a day; a manifest names the version that
holds each part, or the versions where parts only grow. A commit writes new folders, which no reader knows, and then one
manifest by a rename. So a reader sees a table before or after a change and never between, and a failed write leaves
nothing but unknown folders. Of two writers that change one table at a time the later one fails and can run again.

An upsert has to find the months that hold its keys. The table keeps an index of key hashes and months in BUCKETS
buckets of hashes; an upsert reads and replaces only the buckets of its own keys, and opens only the months they name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.operators.core import only_new, upsert, with_month

BUCKETS = 64


class _Folder:
    """A table's manifests, by the file system of its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self.of(f"{self.path}/_manifest")
        if not self.fs.exists(folder):
            return []
        return sorted(int(n.removesuffix(".json")) for n in (f.getPath().getName() for f in self.fs.listStatus(folder)) if n.endswith(".json") and n[0].isdigit())

    def manifest(self) -> dict:
        """The table as it is: parts (a list of versions each), index (a version for each bucket), batches (the last one of each stream)."""
        known = self.versions()
        if not known:
            return {"version": 0, "parts": {}, "index": {}, "batches": {}}
        stream = self.fs.open(self.of(f"{self.path}/_manifest/{known[-1]:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"version": known[-1]}
        finally:
            stream.close()

    def commit(self, manifest: dict, version: int) -> None:
        """Make the manifest the table's, unless another commit of this version was faster."""
        draft = self.of(f"{self.path}/_manifest/draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "version"}).encode()))
        out.close()
        target = self.of(f"{self.path}/_manifest/{version:012d}.json")
        if self.fs.exists(target) or not self.fs.rename(draft, target):
            self.fs.delete(draft, False)
            raise RuntimeError(f"{self.path} was changed by another writer; run again")
        # what the last two manifests do not name is not read any more
        known = self.versions()
        for old in known[:-2]:
            self.fs.delete(self.of(f"{self.path}/_manifest/{old:012d}.json"), False)

    def unused(self, before: dict, after: dict, older: dict) -> None:
        """Delete folders that the state before last had and that neither the last nor the new one has."""
        named = lambda m: {f"_v={v}/_part={p}" for p, vs in m["parts"].items() for v in vs} | {f"_index/_v={v}/bucket={b}" for b, v in m["index"].items()}
        for folder in named(older) - named(before) - named(after):
            self.fs.delete(self.of(f"{self.path}/{folder}"), True)

    def read(self, manifest: dict, parts: list[str], schema: T.StructType) -> DataFrame:
        """Some parts of the table, with the column _part."""
        paths = [f"{self.path}/_v={v}/_part={p}" for p in parts for v in manifest["parts"].get(p, [])]
        wanted = T.StructType([*[f for f in schema if f.name != "_part"], T.StructField("_part", T.StringType())])
        if not paths:
            return self.spark.createDataFrame([], wanted)
        return self.spark.read.schema(wanted).option("basePath", self.path).parquet(*paths).select(*wanted.names)

    def read_index(self, manifest: dict, buckets: list[int]) -> DataFrame:
        paths = [f"{self.path}/_index/_v={manifest['index'][str(b)]}/bucket={b}" for b in buckets if str(b) in manifest["index"]]
        reader = self.spark.read.schema("_hash long, part string")
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], "_hash long, part string")


def _state(table: _Folder, number: int) -> dict:
    """The manifest that many commits back."""
    known = table.versions()
    if len(known) <= number:
        return {"parts": {}, "index": {}}
    stream = table.fs.open(table.of(f"{table.path}/_manifest/{known[-1 - number]:012d}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _next(manifest: dict) -> tuple[int, str]:
    """The next version and a name for its folders, which no failed attempt has used."""
    return manifest["version"] + 1, f"{manifest['version'] + 1}-{uuid.uuid4().hex[:8]}"


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_Folder(spark, path).versions())


def ensure_table(spark: SparkSession, path: str) -> None:
    """An empty table, if there is none."""
    table = _Folder(spark, path)
    if not table.versions():
        table.commit({"parts": {}, "index": {}, "batches": {}}, 1)


def read_table(spark: SparkSession, path: str, schema: T.StructType, parts: tuple[str, str] | None = None) -> DataFrame:
    """The table, or an empty one where nothing has been written yet; with parts, only those from the first to the last.

    A table that is upserted also stores its rows' month.
    """
    table = _Folder(spark, path)
    manifest = table.manifest()
    chosen = [p for p in sorted(manifest["parts"]) if parts is None or parts[0] <= p <= parts[1]]
    return table.read(manifest, chosen, schema).select(*schema.names)


def _names(rows: DataFrame, column: str) -> list[str]:
    """The distinct values of a column that has one a calendar month or day, or one a bucket."""
    return [r[0] for r in rows.select(F.col(column).cast("string")).distinct().collect()]


def upsert_table(incoming: DataFrame, path: str, keys: list[str], newest_first: list[str], at: str = "date", as_of: str = "1970-01-01", keep: tuple[str, ...] = ()) -> None:
    """Upsert by key into a table in parts by month, rewriting only the months that change.

    A key belongs to the month of its newest row and stands in no other, so a key whose date moved leaves its old month:
    months touched are those of incoming rows and those that the index names for their keys. No other month is opened.
    Columns in keep stay as they were first stored (such as the time at which a key was first seen). A month left without
    rows is no part any more. The same upsert again changes nothing.
    """
    spark = incoming.sparkSession
    table = _Folder(spark, path)
    manifest, older = table.manifest(), _state(table, 1)
    version, label = _next(manifest)
    order = [F.desc(c) for c in newest_first]
    routed = with_month(incoming, at, as_of).withColumn("_part", F.col("month"))
    hashed = lambda rows: rows.withColumn("_hash", F.xxhash64(*keys))
    bucket = F.pmod("_hash", F.lit(BUCKETS)).cast("int")
    own = hashed(routed).select("_hash").distinct()
    buckets = [int(b) for b in _names(own.select(bucket.alias("bucket")), "bucket")]
    if not buckets:
        return
    index = table.read_index(manifest, buckets)
    held = index.join(own, "_hash", "left_semi")
    touched = sorted({*_names(routed, "_part"), *_names(held, "part")})
    old = table.read(manifest, touched, routed.schema)
    if keep:  # what a known key was first stored with
        first = old.join(routed.select(*keys).distinct(), keys, "left_semi").select(*keys, *[F.col(c).alias(f"_first_{c}") for c in keep])
        routed = routed.join(first, keys, "left").withColumns({c: F.coalesce(f"_first_{c}", c) for c in keep}).drop(*[f"_first_{c}" for c in keep])
    upsert(old, routed, keys, *order).write.partitionBy("_part").parquet(f"{table.path}/_v={label}")
    written = {p.removeprefix("_part="): [label] for p in (f.getPath().getName() for f in table.fs.listStatus(table.of(f"{table.path}/_v={label}"))) if p.startswith("_part=")}
    after = {"parts": {p: v for p, v in manifest["parts"].items() if p not in touched} | written, "batches": manifest["batches"]}
    # keys of these buckets: those that stay where they were, and where the incoming ones are now
    now = hashed(table.read(after, list(written), routed.schema)).join(own, "_hash", "left_semi").select("_hash", F.col("_part").alias("part"))
    entries = index.join(own, "_hash", "left_anti").unionByName(now).distinct()
    entries.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{table.path}/_index/_v={label}")
    after["index"] = manifest["index"] | {str(b): label for b in buckets}
    table.commit(after, version)
    table.unused(manifest, after, older)


def append_new(incoming: DataFrame, path: str, keys: list[str], day: str = "day", stream: str | None = None, batch: int | None = None) -> None:
    """Append rows whose key the table does not hold, in parts by day.

    A key always comes with the same day (rule ids are made of it), so only the days of the incoming rows are read.
    With a stream's name and a batch number, a batch that is stored already is skipped whole.
    """
    spark = incoming.sparkSession
    table = _Folder(spark, path)
    manifest = table.manifest()
    version, label = _next(manifest)
    if stream is not None and batch is not None and manifest["batches"].get(stream, -1) >= batch:
        return
    routed = incoming.withColumn("_part", F.coalesce(F.col(day).cast("string"), F.lit("none")))
    days = _names(routed, "_part")
    fresh = only_new(routed, table.read(manifest, days, routed.schema), keys)
    parts = dict(manifest["parts"])
    if days:
        fresh.repartition("_part").write.partitionBy("_part").parquet(f"{table.path}/_v={label}")
        for name in (f.getPath().getName() for f in table.fs.listStatus(table.of(f"{table.path}/_v={label}"))):
            if name.startswith("_part="):
                parts[name.removeprefix("_part=")] = [*parts.get(name.removeprefix("_part="), []), label]
    batches = manifest["batches"] | ({stream: batch} if stream is not None and batch is not None else {})
    table.commit({"parts": parts, "index": {}, "batches": batches}, version)
