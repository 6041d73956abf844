"""How the given tables play the library's tables. Every binding keeps all rows and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograin.session import spread

EXTENSIONS = [".py", ".JS", ".ts", ".md", ".sql", ".html", ".txt", ""]
EPOCH = 1_704_067_200  # 2024-01-01 00:00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Documents as files of one repository per source: ``<lang>/doc_<id><ext>``.

    ``heavy`` spreads a small table over all cores before text work.
    """
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = spread(rows, "doc_id") if heavy else rows
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 8 + 1).cast("int"))
    return rows.select(
        F.col("source").alias("repo_id"),
        F.concat("lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext).alias("rel_path"),
        "text",
        "lang",
        "doc_id",
    )


def files_of(frame: DataFrame, text: str = "text") -> DataFrame:
    """Landed shape: content as bytes."""
    return frame.select("repo_id", "rel_path", F.col(text).cast("binary").alias("content"))


def page_files(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Pages as files below their host, one repository per domain: ``<host>/<url path>/p<id>.html``."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = spread(rows, "page_id") if heavy else rows
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1), r"/+$", "")
    return rows.select(
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("repo_id"),
        F.concat(host, path, F.lit("/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("rel_path"),
        host.alias("host"),
        F.col("html").alias("text"),
        "page_id",
        "url",
    )


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files, one repository per brand; type gives the folder and size the file kind."""
    folder = (
        F.when(F.col("p_type") == "PROMO", "build")
        .when(F.col("p_type") == "SMALL", "node_modules")
        .when(F.col("p_type") == "MEDIUM", "src/.git")
        .when(F.col("p_type") == "LARGE", "app/env")
        .when(F.col("p_type") == "ECONOMY", "lib")
        .otherwise("src")
    )
    ending = (
        F.when(F.col("p_size") < 10, ".tmp")
        .when(F.col("p_size") < 20, ".py")
        .when(F.col("p_size") < 30, ".log")
        .when(F.col("p_size") < 40, "~")
        .otherwise(".java")
    )
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("repo_id"),
        F.concat(folder, F.lit("/"), name, F.lit("/k"), F.col("p_partkey").cast("string"), ending).alias("rel_path"),
        (F.col("p_size") * 1000).cast("bigint").alias("length"),
    )


def stored_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of an earlier run: labelled documents (stale hash unless the quality label is 1) and all pages.

    Against the documents as the current catalog this gives all four change classes.
    """
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    docs = document_files(spark, sf_dir).join(labels, "doc_id")
    known = docs.select(
        "repo_id",
        "rel_path",
        F.when(F.col("quality") == 1, F.md5("text")).otherwise(F.md5(F.concat("text", F.lit("x")))).alias("hash"),
        F.timestamp_seconds(F.col("doc_id") + EPOCH).alias("last_updated"),
        F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.col("text")).alias("summary"),
    )
    gone = page_files(spark, sf_dir).select(
        "repo_id",
        "rel_path",
        F.md5("text").alias("hash"),
        F.lit(None).cast("timestamp").alias("last_updated"),
        F.col("url").alias("summary"),
    )
    return known.unionByName(gone)


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as history rows: user = repository, hour = snapshot, errors = backups."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo_id"),
        F.date_trunc("hour", F.col("ts")).alias("snapshot_ts"),
        F.when(F.col("event_type") == "error", "backup").otherwise("snapshot").alias("kind"),
    )


def suggestion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as suggestions: brand = run, type gives a file glob, name and size give a folder."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("run"),
        F.array(F.concat(F.lit("*."), F.lower("p_type"))).alias("ignore_files"),
        F.array(
            F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"), F.lit("/"))
        ).alias("ignore_folders"),
    )


# Line rules for prose. The SQL check states them without look-behind and possessive loops, which only save steps.
PROSE_RULES = [
    ("prose", "function", r"(?<![a-z])([a-z]++)\."),
    ("prose", "class", r"^([A-Z][a-z]+)[ ,.]"),
    ("prose", "variable", r"(?<![a-z])([a-z]++),"),
    ("prose", "key", r'(?<![a-z_])([a-z_]++) = "'),
]


# The same bindings for the SQL check.
SQL_BINDINGS = {
    "docs": """docs AS (
  SELECT source AS repo_id, lang || '/doc_' || doc_id || CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.JS'
    WHEN 2 THEN '.ts' WHEN 3 THEN '.md' WHEN 4 THEN '.sql' WHEN 5 THEN '.html' WHEN 6 THEN '.txt' ELSE '' END AS rel_path,
    text, lang, doc_id FROM documents)""",
    "page_files": """page_files AS (
  SELECT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS repo_id,
    host || rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') || '/p' || page_id || '.html' AS rel_path,
    host, html AS text, page_id, url
  FROM (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages))""",
    "part_files": """part_files AS (
  SELECT p_brand AS repo_id, CASE p_type WHEN 'PROMO' THEN 'build' WHEN 'SMALL' THEN 'node_modules'
    WHEN 'MEDIUM' THEN 'src/.git' WHEN 'LARGE' THEN 'app/env' WHEN 'ECONOMY' THEN 'lib' ELSE 'src' END
    || '/' || replace(p_name, ' ', '_') || '/k' || p_partkey
    || CASE WHEN p_size < 10 THEN '.tmp' WHEN p_size < 20 THEN '.py' WHEN p_size < 30 THEN '.log'
       WHEN p_size < 40 THEN '~' ELSE '.java' END AS rel_path,
    CAST(p_size * 1000 AS BIGINT) AS length FROM part)""",
    "lab": "lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)",
    "meta": """meta AS (
  SELECT repo_id, rel_path, CASE WHEN quality = 1 THEN md5(text) ELSE md5(text || 'x') END AS hash,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS last_updated,
    CASE WHEN toxic = 1 THEN '' ELSE text END AS summary
  FROM docs JOIN lab USING (doc_id)
  UNION ALL SELECT repo_id, rel_path, md5(text), NULL, url FROM page_files)""",
    "hist": """hist AS (
  SELECT 'u' || user_id AS repo_id, date_trunc('hour', ts) AS snapshot_ts,
    CASE WHEN event_type = 'error' THEN 'backup' ELSE 'snapshot' END AS kind FROM events)""",
    "sug": """sug AS (
  SELECT p_brand AS run, '*.' || lower(p_type) AS f, replace(p_name, ' ', '_') || '_' || p_size || '/' AS d FROM part)""",
    "lines": """lines AS (
  SELECT repo_id, rel_path, unnest(l) AS line, generate_subscripts(l, 1) AS no
  FROM (SELECT repo_id, rel_path, string_split(text, chr(10)) AS l FROM docs))""",
    "rules": """rules(type, type_ord, regex) AS (VALUES ('function', 0, '([a-z]+)\\.'),
  ('class', 1, '^([A-Z][a-z]+)[ ,.]'), ('variable', 2, '([a-z]+),'), ('key', 3, '([a-z_]+) = "'))""",
    "sym": """sym AS (
  SELECT repo_id, rel_path AS file, CAST(no AS INTEGER) AS line, type, unnest(names) AS name, type_ord,
    CAST((generate_subscripts(names, 1) - 1) * 2147483648 AS BIGINT) AS pos
  FROM (SELECT *, regexp_extract_all(line, regex, 1) AS names FROM lines, rules))""",
}


def with_bindings(names: str, select: str) -> str:
    """Query text with the named bindings in front."""
    return "WITH " + ",\n".join(SQL_BINDINGS[n] for n in names.split()) + "\n" + select
