"""File trees: manifests, content digests, images, and the stored index."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fleetlens.operators.duplicates import skip_version_control
from fleetlens.session import stored, task_count
from fleetlens.sources.images import list_images, with_image_sizes
from fleetlens.sources.ranges import md5_of
from fleetlens.sources.walk import walk_files

# Fixed value: the format of the stored index.
INDEX_VERSION = 1
POINTER = "CURRENT"  # names the versions that an index consists of


def read_manifest(spark: SparkSession, roots: Sequence[str], hidden: bool = True) -> DataFrame:
    """``(root, subpath, size, mtime, path)`` of all files below the roots; content is not read.

    Empty files and ``.git`` and ``.svn`` folders are left out. With ``hidden=False`` Spark's own
    listing is used, which knows no names that start with a dot or an underscore, and follows links.
    """
    if hidden:
        return walk_files(spark, roots)
    per_root = []
    for root in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        folder = root.rstrip("/") + "/"
        # Listed paths carry a scheme that the given root may lack.
        subpath = F.substring_index(F.col("path"), folder, -1)
        per_root.append(
            files.select(
                F.lit(root).alias("root"),
                subpath.alias("subpath"),
                F.col("length").alias("size"),
                F.col("modificationTime").alias("mtime"),
                "path",
            )
        )
    return skip_version_control(reduce(DataFrame.unionByName, per_root))


@F.pandas_udf(StringType())
def _file_md5(paths: pd.Series, known: pd.Series) -> pd.Series:
    return known.where(known.notna(), paths[known.isna()].map(md5_of))


def hash_files(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Fill ``md5`` where it is null by reading the file at ``path``; other files are not opened.

    Files are spread over tasks by path, as a manifest may list a whole tree in one task; the rows are
    read once.
    """
    spread = files.repartition(tasks or task_count(files.sparkSession), "path")
    return spread.withColumn("md5", _file_md5("path", "md5"))


def read_image_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(width, height, name)`` of the image files in a folder, and the names of those that are none.

    Sizes come from the headers of PNG, JPEG, GIF, BMP and WebP files, each read once and stored; no pixel is read. Empty
    files are not listed.
    """
    images = stored(with_image_sizes(list_images(spark, path)), "images")
    # Listed paths are URIs, so a name may be encoded.
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("name")
    good = images.where("image.width IS NOT NULL").select("image.width", "image.height", name)
    return good, images.where("image.width IS NULL").select(name, F.lit("image").alias("stage"))


def _pointer(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The versions that make up an index, and the roots that are read from each."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return {}
    return json.loads(spark.read.text(target.toString(), wholetext=True).first()[0])


def _switch(spark: SparkSession, path: str, versions: dict[str, list[str]]) -> None:
    """Put a pointer file in place of the earlier one in a single step."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new = jvm.org.apache.hadoop.fs.Path(f"{path}/.{POINTER}-{uuid4().hex}")
    out = new.getFileSystem(conf).create(new, False)
    try:
        out.write(bytearray(json.dumps(versions).encode()))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf)
    context.rename(context.makeQualified(new), context.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")), options)


def write_index(files: DataFrame, path: str, saved_at: datetime) -> None:
    """Store a file index, one partition per root, with its version and time.

    Roots written replace their earlier partition; other roots stay. The rows are written as a version beside
    the earlier ones, and a pointer file is replaced last. So readers find the whole earlier
    index or the whole new one, also where a write fails. Versions that neither this pointer nor the one before
    names are deleted. Two writers at once need a lock of their own: the later pointer wins.
    """
    spark, path = files.sparkSession, path.rstrip("/")
    index = files.select("root", "subpath", "size", "mtime", "md5").withColumns(
        {"metadata_ver": F.lit(INDEX_VERSION), "saved_at": F.lit(saved_at).cast("timestamp")}
    )
    version = f"v-{uuid4().hex}"
    index.write.partitionBy("root").parquet(f"{path}/{version}")
    written = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/{version}").select("root").distinct()
    roots = sorted(r["root"] for r in written.collect())
    before = _pointer(spark, path)
    kept = {v: [r for r in held if r not in roots] for v, held in before.items()}
    after = {v: held for v, held in kept.items() if held} | {version: roots}
    _switch(spark, path, after)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in after and name not in before:
            store.delete(status.getPath(), True)


INDEX_SCHEMA = (
    "subpath string, size bigint, mtime timestamp, md5 string, metadata_ver int, saved_at timestamp, root string"
)


def read_index(spark: SparkSession, path: str, version: int = INDEX_VERSION) -> DataFrame:
    """A stored index; rows of another format version are ignored."""
    path = path.rstrip("/")
    parts = [
        spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/{name}").where(F.col("root").isin(roots))
        for name, roots in sorted(_pointer(spark, path).items())
    ]
    if not parts:  # written in place, before there were versions
        parts = [spark.read.schema(INDEX_SCHEMA).parquet(path)]
    return reduce(DataFrame.unionByName, parts).where(F.col("metadata_ver") == version).drop("metadata_ver")
