"""Image files: which exist, and their size from the header."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linewright.sources.image_size import image_size, image_size_of
from linewright.sources.lines import plain_path
from linewright.sources.stores import UNREADABLE, address, content, full_address, has_store, opened_store, ranges

_SIGNATURE = "89504E470D0A1A0A"
#: Files of a listing that travel together.
_ROWS = 4096


def tidy_path(path: Column) -> Column:
    """A path without `./` parts and doubled slashes, so that spellings of one file meet."""
    return F.regexp_replace(F.regexp_replace(path, r"(?<=^|/)(?:\./+)+", ""), "/{2,}", "/")


class FileListing(DataSource):
    """Files under a folder, listed by the executors: one partition per folder in it, and one for its own files.

    Only the root itself is listed on the driver, and only its folders are kept there. Options: `path`, `pattern` (of
    file names).
    """

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "uri string, size long"

    def reader(self, schema) -> FileListingReader:
        return FileListingReader(self.options["path"], self.options.get("pattern", "*"))


class FileListingReader(DataSourceReader):
    def __init__(self, root: str, pattern: str) -> None:
        self.root, self.pattern = root, pattern

    def partitions(self) -> list[InputPartition]:
        store, base = opened_store(self.root)
        here = store.get_file_info(fs.FileSelector(base, allow_not_found=False))
        return [InputPartition((base, False)), *(InputPartition((f.path, True)) for f in here if f.type == fs.FileType.Directory)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """Folder by folder, so no more than one folder's entries are held."""
        store, base = opened_store(self.root)
        first, deep = partition.value
        folders = [first]
        while folders:
            entries = store.get_file_info(fs.FileSelector(folders.pop(), allow_not_found=True))
            if deep:
                folders += [e.path for e in entries if e.type == fs.FileType.Directory]
            files = [e for e in entries if e.type == fs.FileType.File and fnmatch.fnmatchcase(e.base_name, self.pattern)]
            for start in range(0, len(files), _ROWS):
                some = files[start : start + _ROWS]
                columns = [pa.array([address(self.root, base, e.path) for e in some]), pa.array([e.size for e in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["uri", "size"])


def image_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """`path`, `uri` and `size` of the files of any type under a folder; contents are not read.

    Folders are listed by the executors. Only for a store that these cannot open by themselves Spark's file index lists
    them, on the driver; it leaves out names that begin with a dot or an underscore.
    """
    root = full_address(spark, root)
    if has_store(root):
        spark.dataSource.register(FileListing)
        files = spark.read.format("file_listing").option("pattern", pattern).load(root)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        files = files.select(F.col("_metadata.file_path").alias("uri"), F.col("length").alias("size"))
    return files.select(tidy_path(plain_path(F.col("uri"))).alias("path"), "uri", "size")


def _number_at(content: Column, start: int) -> Column:
    return F.conv(F.hex(F.substring(content, start, 4)), 16, 10).cast("int")


def png_dims(content: Column) -> dict[str, Column]:
    """`width` and `height` of a PNG file; NULL where the bytes are no PNG header."""
    readable = (F.hex(F.substring(content, 1, 8)) == _SIGNATURE) & (F.length(content) >= 24)
    return {
        "width": F.when(readable, _number_at(content, 17)),
        "height": F.when(readable, _number_at(content, 21)),
    }


_SIZE = pa.struct([("width", pa.int32()), ("height", pa.int32())])


def _sizes(sizes: Iterator[tuple[int, int] | None]) -> pa.Array:
    """Sizes no image has (above 31 bits) count as unreadable."""
    return pa.array([{"width": s[0], "height": s[1]} if s and max(s) < 1 << 31 else None for s in sizes], _SIZE)


@F.arrow_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def content_size(content: pa.Array) -> pa.Array:
    """`width` and `height` of files in hand, of all formats of `image_size`; NULL for anything else."""
    return _sizes(None if c is None else image_size_of(c) for c in content.to_pylist())


def _size_at(uri: str) -> tuple[int, int] | None:
    try:
        with ranges(uri) as read:
            return image_size(read)
    except UNREADABLE:
        return None


def with_sizes(listing: DataFrame) -> DataFrame:
    """A listing (`path`, `uri`) with the `width` and `height` of each file, read by ranges.

    The files are dealt anew first: a folder is listed by one task, but its headers are read by all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = _sizes(_size_at(uri) for uri in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes.flatten()], names=["path", "width", "height"])

    return listing.select("path", "uri").repartition("uri").mapInArrow(run, "path string, width int, height int")


def image_dims(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """`path`, `width`, `height` of every file; sizes only where the header is that of an image."""
    return with_sizes(image_listing(spark, root, pattern))


def with_contents(listing: DataFrame) -> DataFrame:
    """A listing (`path`, `uri`) with each file's bytes as `content`; NULL where a file cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, uri in enumerate(batch.column(1).to_pylist()):
                one = pa.array([content(uri)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), one], names=["path", "content"])

    return listing.select("path", "uri").repartition("uri").mapInArrow(run, "path string, content binary")


def with_existing_image(labels: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Label rows whose image exists."""
    return labels.join(listing.select(path), path, "left_semi")


def with_missing_image(labels: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Label rows whose image does not exist."""
    return labels.join(listing.select(path), path, "left_anti")


def flag_existing_image(labels: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Every label row with `has_image`; the listing is reduced to one row per path first, so no row multiplies."""
    present = listing.groupBy(path).agg(F.lit(True).alias("has_image"))
    return labels.join(present, path, "left").withColumn("has_image", F.coalesce("has_image", F.lit(False)))
