"""Image files: sizes read from their headers, and whether a label can be read on them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phyllary.functions.text import text
from phyllary.session import in_batches

#: Below these an image is too small, or too much compressed, for small labels.
SHORT_SIDE, MEGAPIXELS, BYTES = 1200, 2.0, 250_000


def image_size(content: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG or JPEG file, None if its header cannot be read."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", content[16:24]) if len(content) >= 24 else None
    if content[:2] != b"\xff\xd8":
        return None
    at = 2
    while (at := content.find(b"\xff", at)) >= 0:
        while content[at : at + 1] == b"\xff":
            at += 1
        if at + 3 > len(content):
            return None
        marker = content[at]
        if marker == 0x01 or 0xD0 <= marker <= 0xD9:
            at += 1
            continue
        (length,) = struct.unpack(">H", content[at + 1 : at + 3])
        if length < 2:
            return None
        # frame headers are C0 to CF without the tables C4, C8 and CC
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 8 > len(content):
                return None
            height, width = struct.unpack(">HH", content[at + 4 : at + 8])
            return width, height
        at += 1 + length
    return None


def quality(width: Column, height: Column, size: Column) -> Column:
    """The state of an image for reading labels: no size known, too small, too compressed, or available; missing without a file."""
    short, mega = F.least(width, height), width.cast("double") * height / 1_000_000
    return (
        F.when(size.isNull(), "image_missing")
        .when(F.coalesce(width, F.lit(0)) * F.coalesce(height, F.lit(0)) == 0, "image_dimensions_unknown")
        .when((short < SHORT_SIDE) | (mega < MEGAPIXELS), "review_low_resolution_for_label_reading")
        .when(size < BYTES, "review_compressed_for_label_reading")
        .otherwise("image_available")
    )


def inspect_images(files: DataFrame) -> DataFrame:
    """path, width, height, size, sha256, status of image files (path, length, content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = [image_size(c) or (None, None) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "width": pd.array([s[0] for s in sizes], "Int32"), "height": pd.array([s[1] for s in sizes], "Int32"), "size": b["length"], "sha256": b["sha256"]})

    out = in_batches(files.select("path", "length", "content", F.sha2("content", 256).alias("sha256")), read, "path string, width int, height int, size long, sha256 string")
    return out.withColumn("status", quality(F.col("width"), F.col("height"), F.col("size")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """inspect_images of the files under a path."""
    return inspect_images(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def image_accounts(files: DataFrame, references: DataFrame) -> DataFrame:
    """referenced, unreferenced: how many of the files (path) are referred to (path) or not."""
    flagged = files.select("path").distinct().join(references.select("path").where("path <> ''").distinct().withColumn("r", F.lit(1)), "path", "left")
    return flagged.agg(F.count("r").alias("referenced"), (F.count("*") - F.count("r")).alias("unreferenced"))


def unreferenced(files: DataFrame, references: DataFrame) -> DataFrame:
    """path: the files that no row of references refers to, each once. Null and blank references refer to nothing."""
    return files.select("path").where("path is not null").distinct().join(references.select("path").where("path <> ''").distinct(), "path", "left_anti")


def prune_images(spark: SparkSession, folder: str, references: DataFrame) -> DataFrame:
    """path, removed: the image files below a folder that no record refers to, deleted by the workers that hold them. references: paths
    below the folder, as records have them. An empty references deletes nothing, as it would delete all."""
    root = folder.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("uri"))
    # paths as records have them: below the folder
    own = listed.withColumn("path", F.substring_index("uri", root.split("://")[-1] + "/", -1))
    rest = own.join(unreferenced(own, references), "path") if not references.where("path <> ''").isEmpty() else own.limit(0)

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for b in batches:
            done = []
            for uri in b["uri"]:
                try:
                    system, path = FileSystem.from_uri(uri)
                    system.delete_file(path)
                    done.append(True)
                except (OSError, ValueError):
                    # another attempt of the task may have been first
                    done.append(False)
            yield pd.DataFrame({"path": b["path"], "removed": done})

    return in_batches(rest.select("path", "uri"), remove, "path string, removed boolean")


def cache_address(record_id: Column, media_url: Column, width: int | None = None) -> Column:
    """The aggregator's image cache: the record's number and the MD5 of the media's address."""
    return F.concat(F.lit("https://api.gbif.org/v1/image/cache/" + (f"{width}x/" if width else "") + "occurrence/"), record_id, F.lit("/media/"), F.md5(media_url))


def download_urls(record_id: Column, image_url: Column, cache: bool = True) -> Column:
    """Addresses to try for an image, in order: its own, then the cache's two sizes where the record has the aggregator's number."""
    number, url = text(record_id), text(image_url)
    cached = F.when((number.rlike("^[0-9]+$")) & (url != "") & ~url.contains("api.gbif.org/v1/image/cache/") & F.lit(cache), F.array(cache_address(number, url, 1200), cache_address(number, url)))
    return F.filter(F.concat(F.array(url), F.coalesce(cached, F.array().cast("array<string>"))), lambda u: u != "")


def media_items(media: Column) -> Column:
    """The entries of a media field, parted by semicolons or bars."""
    return F.filter(F.transform(F.split(text(media), "[;|]"), lambda v: F.trim(v)), lambda v: v != "")


def image_for_code(records: DataFrame, files: DataFrame, key: str, code: Column) -> DataFrame:
    """key, path: for each record with a code the first image file (path, by name) whose name begins with the code; letters and digits
    only, small ones. Codes have few lengths, so the beginnings of names in these lengths are joined by equality, not by pairs."""
    plain = lambda c: F.lower(F.regexp_replace(text(c), r"(?U)[^\p{L}\p{N}]", ""))
    codes = records.select(key, plain(code).alias("code")).where("code <> ''")
    # no more lengths than a code has characters
    lengths = sorted(r[0] for r in codes.select(F.length("code")).distinct().collect())
    stems = files.select("path", plain(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)).alias("stem")).where(F.lower("path").rlike(r"\.(?:jpe?g|png)$"))
    if not lengths:
        return codes.select(key, F.lit("").alias("path")).limit(0)
    begun = stems.select("path", "stem", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).where("length(stem) >= n").select("path", F.expr("substring(stem, 1, n)").alias("code"))
    return codes.join(begun.groupBy("code").agg(F.min("path").alias("path")), "code").select(key, "path")
