"""Tables kept as versions: a write makes new folders and then a mark, so readers see whole states only."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class VersionedTable:
    """A folder with v=<n>/bucket=<b>/ parquet folders and a mark commits/<n> for each whole version; the greatest is current.

    Rows lie in buckets by the hash of their keys. A mark tells for every bucket the version that wrote it last, so a write of a few keys rewrites their
    buckets only. One writer at a time: a mark is made only where none is, which file systems with atomic creation check; elsewhere the caller must see to it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys or [], buckets if keys else 1
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        marks = self._p(f"{self.path}/commits")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(marks)) if self._fs.exists(marks) else []

    def _mark(self, version: int) -> dict:
        stream = self._fs.open(self._p(f"{self.path}/commits/{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> int | None:
        return max(self._versions(), default=None)

    def state(self) -> dict:
        """The current mark: parts (bucket -> version), writers (name -> last batch) and the schema; empty if there is none."""
        v = self.version()
        return {"parts": {}, "writers": {}, "schema": None} if v is None else self._mark(v)

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The current rows, or those of some buckets; None if nothing was ever written."""
        mark = self.state()
        if mark["schema"] is None:
            return None
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in mark["parts"].items() if only is None or int(b) in only]
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(mark["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, writer: str = "", batch: int | None = None, only: list[int] | None = None, keep: int = 2) -> bool:
        """Writes the rows of all buckets (or of `only`, others stay) as the next version and marks it; a crash before the mark leaves the old state.

        A batch of a writer that is already in a version writes nothing and gives False; one that skips batches raises ValueError. Folders that
        only versions before the last `keep` name are removed."""
        mark = self.state()
        last = mark["writers"].get(writer)
        if batch is not None and last is not None:
            if batch <= last:
                return False
            if batch != last + 1:
                raise ValueError(f"batch {batch} of {writer} comes behind {last}")
        version = (self.version() if self.version() is not None else -1) + 1
        target = f"{self.path}/v={version}"
        df.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(target)
        wrote = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._p(target)) if s.getPath().getName().startswith("bucket=")}
        parts = {b: v for b, v in mark["parts"].items() if only is not None and int(b) not in only} | {str(b): version for b in sorted(wrote)}
        body = {"parts": parts, "writers": mark["writers"] | ({writer: batch} if batch is not None else {}), "schema": json.loads(df.schema.json())}
        out = self._fs.create(self._p(f"{self.path}/commits/{version}"), False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        self._clean(keep)
        return True

    def _clean(self, keep: int) -> None:
        versions = self._versions()
        live = {v for n in versions[-keep:] for v in self._mark(n)["parts"].values()} | set(versions[-keep:])
        for v in [v for v in versions if v not in live]:
            self._fs.delete(self._p(f"{self.path}/v={v}"), True)
        for v in versions[:-keep]:
            self._fs.delete(self._p(f"{self.path}/commits/{v}"), False)


def json_pages(rows: DataFrame, order: list[str], page_bytes: int, chunks: int = 1) -> DataFrame:
    """(page_no, order..., line): rows as JSON in order, on pages of at most page_bytes; a longer line has a page of its own.

    The order is cut into `chunks` ranges that are packed apart, each from a fresh page, and numbered by one row a range; so the last page of a range may be short."""
    from turnmill.session import cut

    made = rows.select(*order, F.to_json(F.struct(*rows.columns)).alias("line"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, page, fill, first = TaskContext.get().partitionId(), 0, 0, True
        for batch in batches:
            pages = []
            for line in batch.column(batch.schema.get_field_index("line")).to_pylist():
                size = len(line.encode()) + 1
                if not first and fill + size > page_bytes:
                    page, fill = page + 1, 0
                fill, first = fill + size, False
                pages.append(page)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(pages), pa.int32()), pa.array(pages, pa.int64())], names=[*batch.schema.names, "_part", "_page"])

    placed = made.repartitionByRange(chunks, *order) if chunks > 1 else made.coalesce(1)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    packed = cut(placed.sortWithinPartitions(*order).mapInArrow(pack, f"{fields}, _part int, _page bigint"))
    counts = packed.groupBy("_part").agg((F.max("_page") + 1).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_k0"))  # one row a chunk
    return packed.join(before, "_part").select((F.col("_page") + F.col("_k0")).alias("page_no"), *order, "line")
