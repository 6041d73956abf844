"""File catalog: build, project, filter and look up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions import paths
from repograin.functions.constants import EXT_LANG, MAX_FILE_MIB, SUPPORTED_EXTENSIONS
from repograin.functions.text import decode


def content_hash(content: Column | str) -> Column:
    """MD5 of the raw bytes; unreadable content (null) keeps a null hash."""
    return F.md5(content)


def build_catalog(landed: DataFrame, with_hash: bool = True) -> DataFrame:
    """Catalog rows from landed ``(repo_id, rel_path[, content, length, mtime, hash])``.

    A length or hash that comes with the rows is taken as it is; else it is that of the content. What is not used is
    never read from a columnar source. Without a content column the catalog has none either.
    """
    has = set(landed.columns)
    content = F.col("content") if "content" in has else F.lit(None).cast("binary")
    length = F.col("length") if "length" in has else F.octet_length(content)
    if "hash" in has:
        hashed = F.col("hash")
    else:
        hashed = content_hash(content) if with_hash else F.lit(None).cast("string")
    return landed.select(
        "repo_id",
        "rel_path",
        paths.base_name("rel_path").alias("name"),
        paths.suffix("rel_path").alias("ext"),
        length.cast("bigint").alias("length"),
        (F.col("mtime") if "mtime" in has else F.lit(None).cast("timestamp")).alias("mtime"),
        hashed.alias("hash"),
        *(["content"] if "content" in has else []),
    )


def with_text(files: DataFrame) -> DataFrame:
    """Content bytes to text, once, for the extraction and request operators."""
    return files.withColumn("text", decode("content")).drop("content")


def path_parts(files: DataFrame) -> DataFrame:
    return files.select(
        "repo_id",
        "rel_path",
        paths.base_name("rel_path").alias("name"),
        paths.suffix("rel_path").alias("ext"),
        paths.parent_dir("rel_path").alias("dir"),
        F.size(paths.components("rel_path")).alias("depth"),
    )


def display_language(files: DataFrame) -> DataFrame:
    return files.select("repo_id", "rel_path", paths.display_language("rel_path").alias("language"))


def filter_by_extensions(files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """Path ends with one of the extensions (case-sensitive); no extensions keeps everything."""
    if not extensions:
        return files
    cond = F.lit(False)
    for ext in extensions:
        cond = cond | F.col("rel_path").endswith(ext)
    return files.filter(cond)


def supported_files(files: DataFrame) -> DataFrame:
    return filter_by_extensions(files, SUPPORTED_EXTENSIONS)


def extractable_files(files: DataFrame) -> DataFrame:
    """Exact suffix has an extraction language."""
    return files.filter(paths.suffix("rel_path").isin(list(EXT_LANG)))


def filter_by_size(files: DataFrame, max_size_mb: float = MAX_FILE_MIB) -> DataFrame:
    return files.filter(F.col("length") <= int(max_size_mb * 1024 * 1024))


def filter_query(
    rows: DataFrame, path_col: str, ext: str | None = None, prefix: str | None = None
) -> DataFrame:
    """Stored-table query by file type (case-insensitive argument) and path prefix.

    The prefix condition is a plain ``startswith`` and reaches the Parquet scan.
    """
    if prefix and prefix != ".":
        rows = rows.filter(F.col(path_col).startswith(prefix))
    if ext:
        rows = rows.filter(F.lower(paths.suffix(path_col)) == paths.normal_ext(ext))
    return rows


def get_file_info(meta: DataFrame, repo_id: str, rel_path: str) -> DataFrame:
    """Metadata of one file; no row when it is unknown."""
    return meta.filter((F.col("repo_id") == repo_id) & (F.col("rel_path") == rel_path))


def lookup(requests: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata for many paths at once; unknown paths keep null fields."""
    found = meta.select("repo_id", "rel_path", "hash", "summary", F.lit(True).alias("known"))
    return requests.join(found, ["repo_id", "rel_path"], "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )


def ext_stats(meta: DataFrame) -> DataFrame:
    """Files per lower-cased extension with a grand total row (``ext`` null)."""
    return (
        meta.select(F.lower(paths.suffix("rel_path")).alias("ext"))
        .rollup("ext")
        .agg(F.count(F.lit(1)).alias("n_files"))
    )
