"""Media beside samples: listings of folders, and files as data URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: MIME types by suffix (fixed values of the public registry); others are taken for JPEG images.
MIME = {
    "avif": "image/avif",
    "bmp": "image/bmp",
    "gif": "image/gif",
    "heic": "image/heic",
    "ico": "image/vnd.microsoft.icon",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "json": "application/json",
    "mp3": "audio/mpeg",
    "mp4": "video/mp4",
    "pdf": "application/pdf",
    "png": "image/png",
    "svg": "image/svg+xml",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "txt": "text/plain",
    "wav": "audio/x-wav",
    "webp": "image/webp",
}
OTHERS = "image/jpeg"


def plain_path(path: Column) -> Column:
    """A path without ``file:`` and empty hosts in front."""
    return F.regexp_replace(path, r"^file:(//)?(?=/)", "")


def mime_type(path: Column) -> Column:
    """The MIME type that a path's suffix says."""
    known = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return F.coalesce(known[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))], F.lit(OTHERS))


def data_url(path: Column, content: Column) -> Column:
    """A file as a data URL: MIME type and content in base64, in one line."""
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, bytes, mime`` of all files under a folder whose names match. No content is read; files without content, which Spark passes over, aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("bytes"), mime_type(F.col("path")).alias("mime"))


def data_urls(spark: SparkSession, folder: str, paths: DataFrame, pattern: str = "*") -> DataFrame:
    """``path, url`` of those files under a folder that ``paths`` has; read by the executors, a file at a time.

    Each path comes once; one that isn't there has no row. A file has to fit a task's memory; ``pattern`` keeps files that aren't asked for from being read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    files = files.select(plain_path(F.col("path")).alias("__path"), "content")
    wanted = paths.select("path").dropna().distinct().select("path", plain_path(F.col("path")).alias("__path"))
    return files.join(wanted, "__path").select("path", data_url(F.col("path"), F.col("content")).alias("url"))
