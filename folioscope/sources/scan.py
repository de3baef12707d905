"""Files of a directory tree as a DataFrame."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.config import IndexingConfig, SecurityConfig
from folioscope.functions import text as X

# Extensions that are scanned unless others are asked for.
DEFAULT_EXTENSIONS = (".txt", ".md", ".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".csv", ".cs", ".ts", ".js", ".cshtml", ".sql", ".json", ".xml")


#: Columns of the built-in source of whole files.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def plain_path(uri):
    """A Hadoop URI column of the local file system as a plain path."""
    return F.regexp_replace(uri, r"^file:/*(?=/)", "")


def content_hash(content):
    """SHA-256 of bytes, in hexadecimal."""
    return F.sha2(content, 256)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def scan(spark: SparkSession, root: str, indexing: IndexingConfig | None = None, security: SecurityConfig | None = None, content: bool = True, paths: list[str] | None = None) -> DataFrame:
    """``(path, extension, size, modified_at, hash, content)`` of the files to index under a root.

    Directories whose name (the root's own included) is in the ignore list are left out, so are
    files larger than the limit, of other extensions, or restricted.  The size filter and the
    column list reach the file source; ``content=False`` reads no bytes (and gives no hash).
    ``paths``: only those files, as far as they exist; nothing else is listed or read.
    """
    indexing, security = indexing or IndexingConfig(), security or SecurityConfig()
    local = "://" not in root
    if local and not os.path.isdir(root):
        raise NotADirectoryError(root)
    base = os.path.abspath(root) if local else root.rstrip("/")
    wanted = [X.dotted(e).lower() for e in (indexing.include_extensions or DEFAULT_EXTENSIONS)]
    refused = {X.dotted(e).lower() for e in (*indexing.exclude_extensions, *security.restricted_extensions)}
    ignore = [x.lower() for x in indexing.ignore]
    reader = spark.read.format("binaryFile")
    if paths is None:
        files = reader.option("recursiveFileLookup", "true").load(base)
    else:
        there = [p for p in paths if (p.startswith(base.rstrip("/") + "/") or p == base) and _exists(spark, p)]
        # A glob's special characters in a name are meant literally.
        files = reader.load([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in there]) if there else spark.createDataFrame([], FILES)
    path = plain_path(F.col("path"))
    # Segments from the root's own name down, without the file's.
    above = os.path.dirname(base)
    folders = F.slice(F.split(F.lower(F.substring(path, len(above) + 1, 1_000_000)), "/"), 2, F.greatest(F.size(F.split(F.substring(path, len(above) + 1, 1_000_000), "/")) - 2, F.lit(1)))
    kept = files.where(F.col("length") <= indexing.max_file_size_bytes).where(X.extension_of(path).isin(*[e for e in wanted if e not in refused]))
    if ignore:
        kept = kept.where(~F.arrays_overlap(folders, F.array(*(F.lit(x) for x in ignore))))
    columns = [path.alias("path"), X.extension_of(path).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at")]
    if content:
        columns += [content_hash(F.col("content")).alias("hash"), "content"]
    return kept.select(*columns)
