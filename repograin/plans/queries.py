"""Registered queries: each pairs a Spark job with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repograin.functions import paths
from repograin.functions.constants import COMPONENT_PATTERNS, DEFAULT_PATTERNS
from repograin.functions.text import decode, size_label, summary_from_answer, time_label
from repograin.operators import catalog, changes, hierarchy, history, ignore, reports, requests, symbols
from repograin.operators.ordered import block_running_sum, sorted_row_number
from repograin.operators.rules import rules_frame
from repograin.plans import bindings as B
from repograin.plans import sql_functions, updates
from repograin.plans.bindings import with_bindings as w
from repograin.plans.updates import summarise
from repograin.schemas import BATCH_ASKED
from repograin.session import checkpoint, scratch_path
from repograin.sources import stores
from repograin.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return B.document_files(spark, sf)


def _doc_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.build_catalog(B.files_of(_docs(spark, sf)))


def _page_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.build_catalog(B.files_of(B.page_files(spark, sf)))


def _prose(spark: SparkSession, sf: str) -> DataFrame:
    files = B.document_files(spark, sf, heavy=True).withColumn("lang", F.lit("prose"))
    return symbols.extract_symbols(files, rules_frame(spark, B.PROSE_RULES))


def _prose_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same symbols, written once, for jobs that read them more than once."""
    return checkpoint(_prose(spark, sf))


def _as_of() -> Column:
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def _label(c: str = "last_updated") -> Column:
    return time_label(c).alias(c)


SQL_LABEL = "coalesce(strftime(last_updated, '%Y-%m-%d %H:%M:%S'), 'N/A')"
SQL_NAME = "string_split(rel_path, '/')[-1]"
SQL_EXT = f"regexp_extract({SQL_NAME}, '^.+(\\.[^.]+)$', 1)"

# ---------------------------------------------------------------- catalog


@register(
    "file_catalog",
    w("docs", f"""SELECT repo_id, rel_path, {SQL_NAME} AS name, {SQL_EXT} AS ext,
      CAST(octet_length(encode(text)) AS BIGINT) AS length, md5(text) AS hash FROM docs"""),
)
def file_catalog(spark, sf):
    return _doc_catalog(spark, sf).select("repo_id", "rel_path", "name", "ext", "length", "hash")


@register("content_hash", w("page_files", "SELECT repo_id, rel_path, md5(text) AS hash FROM page_files"))
def content_hash(spark, sf):
    return _page_catalog(spark, sf).select("repo_id", "rel_path", "hash")


@register(
    "path_parts",
    w("page_files", f"""SELECT repo_id, rel_path, {SQL_NAME} AS name, {SQL_EXT} AS ext,
      regexp_replace(rel_path, '/?[^/]*$', '') AS dir, CAST(len(string_split(rel_path, '/')) AS INTEGER) AS depth
      FROM page_files"""),
)
def path_parts(spark, sf):
    return catalog.path_parts(B.page_files(spark, sf))


@register(
    "display_language",
    w("docs", f"""SELECT repo_id, rel_path, CASE lower({SQL_EXT}) WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript'
      WHEN '.ts' THEN 'TypeScript' WHEN '.md' THEN 'Markdown' WHEN '.html' THEN 'HTML' END AS language FROM docs"""),
)
def display_language(spark, sf):
    return catalog.display_language(_docs(spark, sf))


@register(
    "ext_filter",
    w("docs", "SELECT repo_id, rel_path FROM docs WHERE rel_path LIKE '%.py' OR rel_path LIKE '%.md' OR rel_path LIKE '%.sql'"),
)
def ext_filter(spark, sf):
    return catalog.filter_by_extensions(_docs(spark, sf), [".py", ".md", ".sql"]).select("repo_id", "rel_path")


@register(
    "supported_files",
    w("docs", f"SELECT repo_id, rel_path FROM docs WHERE {SQL_EXT} IN ('.py', '.ts', '.md', '.html')"),
)
def supported_files(spark, sf):
    return catalog.supported_files(_docs(spark, sf)).select("repo_id", "rel_path")


@register(
    "extractable_files",
    w("docs", f"SELECT repo_id, rel_path FROM docs WHERE {SQL_EXT} IN ('.py', '.ts', '.md', '.sql', '.html')"),
)
def extractable_files(spark, sf):
    return catalog.extractable_files(_docs(spark, sf)).select("repo_id", "rel_path")


@register(
    "size_filter",
    w("docs", """SELECT repo_id, rel_path, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM docs
      WHERE octet_length(encode(text)) <= 2048"""),
)
def size_filter(spark, sf):
    return catalog.filter_by_size(_doc_catalog(spark, sf), 2 / 1024).select("repo_id", "rel_path", "length")


@register(
    "meta_lookup",
    w("docs lab page_files meta", """SELECT repo_id, rel_path, hash, summary, hash IS NOT NULL AS known
      FROM docs LEFT JOIN meta USING (repo_id, rel_path)"""),
)
def meta_lookup(spark, sf):
    wanted = _docs(spark, sf).select("repo_id", "rel_path")
    return catalog.lookup(wanted, B.stored_metadata(spark, sf))


@register(
    "ext_stats",
    w("docs", f"""SELECT ext, count(*) AS n_files FROM (SELECT lower({SQL_EXT}) AS ext FROM docs) GROUP BY ROLLUP (ext)"""),
)
def ext_stats(spark, sf):
    return catalog.ext_stats(_docs(spark, sf))


@register(
    "size_label",
    """SELECT o_orderkey, CASE WHEN s < 1024 THEN printf('%.1fB', round_even(s, 1))
       WHEN s < 1048576 THEN printf('%.1fKB', round_even(s / 1024, 1))
       WHEN s < 1073741824 THEN printf('%.1fMB', round_even(s / 1048576, 1))
       ELSE printf('%.1fGB', round_even(s / 1073741824, 1)) END AS label
       FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey AS DOUBLE) AS s FROM orders)""",
)
def size_labels(spark, sf):
    orders = B.table(spark, sf, "orders")
    return orders.select("o_orderkey", size_label(F.col("o_orderkey") * F.col("o_orderkey")).alias("label"))


# ---------------------------------------------------------------- changes

FEED = """feed AS (
  SELECT coalesce(d.repo_id, m.repo_id) AS repo_id, coalesce(d.rel_path, m.rel_path) AS rel_path,
    CASE WHEN m.rel_path IS NULL THEN 'new' WHEN d.rel_path IS NULL THEN 'deleted'
      WHEN m.hash IS NOT DISTINCT FROM md5(d.text) THEN 'unchanged' ELSE 'modified' END AS change,
    m.hash AS old_hash, md5(d.text) AS new_hash
  FROM docs d FULL JOIN meta m ON d.repo_id = m.repo_id AND d.rel_path = m.rel_path)"""


def _feed(spark, sf):
    return changes.change_feed(B.stored_metadata(spark, sf), _doc_catalog(spark, sf))


@register("change_feed", w("docs lab page_files meta", "SELECT * FROM (WITH " + FEED + " SELECT * FROM feed)"))
def change_feed(spark, sf):
    return _feed(spark, sf)


@register(
    "change_counts",
    w("docs lab page_files meta", "SELECT * FROM (WITH " + FEED + " SELECT repo_id, change, count(*) AS n_files FROM feed GROUP BY ALL)"),
)
def change_counts(spark, sf):
    return changes.change_counts(_feed(spark, sf))


@register(
    "files_to_update",
    w("docs lab page_files meta", """SELECT d.repo_id, d.rel_path, md5(d.text) AS hash FROM docs d LEFT JOIN meta m
      ON d.repo_id = m.repo_id AND d.rel_path = m.rel_path WHERE m.rel_path IS NULL OR m.hash IS DISTINCT FROM md5(d.text)"""),
)
def files_to_update(spark, sf):
    files = _doc_catalog(spark, sf).select("repo_id", "rel_path", "hash")
    return changes.files_to_update(files, B.stored_metadata(spark, sf))


@register(
    "live_metadata",
    w("docs lab page_files meta", f"""SELECT repo_id, rel_path, hash, {SQL_LABEL} AS last_updated, summary FROM meta
      WHERE (repo_id, rel_path) IN (SELECT (repo_id, rel_path) FROM docs)"""),
)
def live_metadata(spark, sf):
    live = changes.live_metadata(B.stored_metadata(spark, sf), _docs(spark, sf))
    return live.withColumn("last_updated", time_label("last_updated"))


@register(
    "removed_metadata",
    w("docs lab page_files meta", """SELECT repo_id, rel_path, hash FROM meta m WHERE NOT EXISTS
      (SELECT 1 FROM docs d WHERE d.repo_id = m.repo_id AND d.rel_path = m.rel_path)"""),
)
def removed_metadata(spark, sf):
    return changes.removed_metadata(B.stored_metadata(spark, sf), _docs(spark, sf)).select("repo_id", "rel_path", "hash")


def _answers(spark, sf):
    """Summaries of a run: every document gets one, French ones come back empty."""
    return _docs(spark, sf).select(
        "repo_id", "rel_path", F.when(F.col("lang") == "fr", "").otherwise(F.concat(F.lit("about "), "rel_path")).alias("summary")
    )


ANSWERS = "answers AS (SELECT repo_id, rel_path, CASE WHEN lang = 'fr' THEN '' ELSE 'about ' || rel_path END AS answer FROM docs)"


@register(
    "metadata_upsert",
    w("docs lab page_files meta", f"""SELECT coalesce(d.repo_id, m.repo_id) AS repo_id, coalesce(d.rel_path, m.rel_path) AS rel_path,
        CASE WHEN d.rel_path IS NULL THEN m.hash ELSE md5(d.text) END AS hash,
        CASE WHEN d.rel_path IS NULL THEN m.summary ELSE d.lang || ' text' END AS summary,
        CASE WHEN d.rel_path IS NULL THEN {SQL_LABEL} ELSE '2024-06-01 00:00:00' END AS last_updated
      FROM docs d FULL JOIN meta m ON d.repo_id = m.repo_id AND d.rel_path = m.rel_path"""),
)
def metadata_upsert(spark, sf):
    updates = _docs(spark, sf).select(
        "repo_id", "rel_path", F.md5("text").alias("hash"), _as_of().alias("last_updated"),
        F.concat("lang", F.lit(" text")).alias("summary"),
    )
    merged = changes.upsert(B.stored_metadata(spark, sf), updates)
    return merged.select("repo_id", "rel_path", "hash", "summary", _label())


@register(
    "incremental_state",
    w("docs lab page_files meta", f"""SELECT repo_id, rel_path, hash,
        CASE WHEN changed THEN '2024-06-01 00:00:00' ELSE {SQL_LABEL} END AS last_updated,
        CASE WHEN changed AND answer <> '' THEN answer ELSE coalesce(summary, '') END AS summary
      FROM (WITH {ANSWERS} SELECT d.repo_id, d.rel_path, md5(d.text) AS hash, m.last_updated, m.summary, a.answer,
          m.rel_path IS NULL OR m.hash IS DISTINCT FROM md5(d.text) AS changed
        FROM docs d JOIN answers a ON a.repo_id = d.repo_id AND a.rel_path = d.rel_path
        LEFT JOIN meta m ON d.repo_id = m.repo_id AND d.rel_path = m.rel_path)"""),
)
def incremental_state(spark, sf):
    state = changes.merge_state(_doc_catalog(spark, sf), B.stored_metadata(spark, sf), _answers(spark, sf), _as_of())
    return state.withColumn("last_updated", time_label("last_updated"))


@register(
    "run_stats",
    w("docs lab page_files meta", f"""SELECT * FROM (WITH {FEED}, {ANSWERS} SELECT f.repo_id,
        count(*) FILTER (change IN ('new', 'modified') AND answer <> '') AS processed,
        count(*) FILTER (change IN ('new', 'modified') AND coalesce(answer, '') = '') AS errors,
        count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change <> 'deleted') AS total_files,
        count(*) FILTER (change = 'unchanged') AS unchanged
      FROM feed f LEFT JOIN answers a ON f.repo_id = a.repo_id AND f.rel_path = a.rel_path GROUP BY f.repo_id)"""),
)
def run_stats(spark, sf):
    return changes.run_stats(_feed(spark, sf), _answers(spark, sf))


# ---------------------------------------------------------------- ignore

PAGE_PATTERNS = ["blog.*/", "spam-farm*", "*/de/*", "p?.html", "[0-4]*.html/", "www.[!a-m]*"]
TREE_PATTERNS = ["src/.git/", "build/", "node_modules", "*.log", "lib/hot_*"]


def _values(patterns: list[str]) -> str:
    return "pats(p) AS (VALUES " + ", ".join(f"('{p.rstrip('/')}')" for p in dict.fromkeys(patterns)) + ")"


def _closure_sql(files: str, patterns: list[str], select: str) -> str:
    """Reference form: test every leading sub-path and its last name against every pattern."""
    return f"""SELECT * FROM (WITH {_values(patterns)},
      pre AS (SELECT repo_id, rel_path, unnest(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[1:i], '/'))) AS q
        FROM (SELECT repo_id, rel_path, string_split(rel_path, '/') AS s FROM {files})),
      hit AS (SELECT DISTINCT repo_id, rel_path, p FROM pre, pats WHERE q GLOB p OR string_split(q, '/')[-1] GLOB p)
      {select})"""


@register(
    "ignore_filter",
    w("page_files", _closure_sql("page_files", PAGE_PATTERNS, "SELECT repo_id, rel_path FROM page_files ANTI JOIN hit USING (repo_id, rel_path)")),
)
def ignore_filter(spark, sf):
    return B.page_files(spark, sf).filter(~ignore.is_ignored(PAGE_PATTERNS)).select("repo_id", "rel_path")


# Patterns that only mean something from the working folder, and absolute ones.
EXTRACT_PATTERNS = [*PAGE_PATTERNS, "site/*/p1?.html", "/data/crawl/*/p2?.html", "/data/crawl/www*"]


def _extract_sql(mode: str, lead: str) -> str:
    """Every path counts as it is seen from the working folder: below it with its folders, outside of it in full."""
    inner = _closure_sql("seen", EXTRACT_PATTERNS, "SELECT repo_id, rel_path FROM seen ANTI JOIN hit USING (repo_id, rel_path)")
    return f"""SELECT '{mode}' AS mode, repo_id, substr(rel_path, {len(lead) + 1}) AS rel_path
      FROM (WITH seen AS (SELECT repo_id, '{lead}' || rel_path AS rel_path FROM page_files) {inner})"""


@register(
    "ignore_extract_mode",
    w("page_files", _extract_sql("below", "site/") + " UNION ALL " + _extract_sql("outside", "/data/crawl/")),
)
def ignore_extract_mode(spark, sf):
    """The same files scanned below the working folder and outside of it."""
    pages = B.page_files(spark, sf)
    kept = [
        pages.filter(~ignore.is_ignored_from(EXTRACT_PATTERNS, root, "/work")).select(F.lit(mode).alias("mode"), "repo_id", "rel_path")
        for mode, root in (("below", "/work/site"), ("outside", "/data/crawl"))
    ]
    return kept[0].unionByName(kept[1])


@register(
    "ignore_audit",
    w("part_files", _closure_sql("part_files", DEFAULT_PATTERNS, "SELECT repo_id, rel_path, p AS pattern FROM hit")),
)
def ignore_audit(spark, sf):
    return ignore.ignore_audit(B.part_files(spark, sf), DEFAULT_PATTERNS).withColumn(
        "pattern", F.rtrim("pattern", F.lit("/"))
    )


def _table_patterns(spark, sf):
    """Per-repository patterns out of the pages: hosts with three or more pages (exact) and one glob per host."""
    by_host = B.page_files(spark, sf).groupBy("repo_id", "host").agg(
        F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")
    )
    return by_host.filter(F.col("n") >= 3).select("repo_id", F.concat("host", F.lit("/")).alias("pattern")).unionByName(
        by_host.select("repo_id", F.concat(F.lit("*/p"), F.col("top").cast("string"), F.lit(".htm?")).alias("pattern"))
    )


@register(
    "ignore_by_table",
    w("page_files", """SELECT repo_id, rel_path FROM (WITH h AS (SELECT repo_id, host, count(*) AS n, max(page_id) AS top FROM page_files GROUP BY ALL)
      SELECT f.repo_id, f.rel_path FROM page_files f JOIN h USING (repo_id, host) WHERE n < 3 AND f.page_id <> top)"""),
)
def ignore_by_table(spark, sf):
    return ignore.kept_by_table(B.page_files(spark, sf), _table_patterns(spark, sf)).select("repo_id", "rel_path")


@register(
    "ignore_tree_mode",
    w("part_files", """SELECT repo_id, rel_path FROM part_files WHERE NOT (starts_with(rel_path, 'src/.git/') OR starts_with(rel_path, 'build/')
      OR list_contains(string_split(rel_path, '/'), 'node_modules') OR suffix(rel_path, '.log')
      OR regexp_matches(rel_path, '^lib/hot_'))"""),
)
def ignore_tree_mode(spark, sf):
    return B.part_files(spark, sf).filter(~ignore.is_ignored_in_tree(TREE_PATTERNS)).select("repo_id", "rel_path")


@register(
    "ignore_component_mode",
    w("part_files", """SELECT repo_id, rel_path FROM part_files WHERE NOT (list_has_any(string_split(rel_path, '/'), ['.git', 'node_modules'])
      OR suffix(rel_path, '.tmp') OR starts_with(rel_path, 'app/env/small'))"""),
)
def ignore_component_mode(spark, sf):
    patterns = [*COMPONENT_PATTERNS, "*.tmp", "app/env/small*"]
    return B.part_files(spark, sf).filter(~ignore.is_ignored_by_component(patterns)).select("repo_id", "rel_path")


@register(
    "ignore_name_set",
    w("part_files", """SELECT repo_id, rel_path FROM part_files WHERE NOT (list_has_any(string_split(rel_path, '/')[:-2],
      ['.git', 'node_modules', 'build', 'env']) OR suffix(rel_path, '.tmp') OR suffix(rel_path, '.log') OR suffix(rel_path, '~'))"""),
)
def ignore_name_set(spark, sf):
    return B.part_files(spark, sf).filter(~ignore.is_ignored_by_name()).select("repo_id", "rel_path")


@register(
    "pruned_dirs",
    w("part_files", """SELECT DISTINCT repo_id, CASE WHEN starts_with(rel_path, 'src/.git/') THEN 'src/.git'
      WHEN starts_with(rel_path, 'app/env/') THEN 'app/env' ELSE string_split(rel_path, '/')[1] END AS dir FROM part_files
      WHERE regexp_matches(rel_path, '^(src/\\.git|app/env|build|node_modules)/')"""),
)
def pruned_dirs(spark, sf):
    return ignore.pruned_dirs(B.part_files(spark, sf), DEFAULT_PATTERNS)


@register(
    "pattern_lines",
    w("docs lines", """SELECT repo_id, count(*) AS n_lines, count(*) FILTER (suffix(t, '/')) AS n_dirs, count(DISTINCT t) AS n_distinct
      FROM (SELECT repo_id, trim(line) AS t FROM lines) WHERE t <> '' AND NOT starts_with(t, '#') GROUP BY repo_id"""),
)
def pattern_lines(spark, sf):
    raw = B.document_files(spark, sf, heavy=True).select("repo_id", F.explode(F.split("text", "\n", -1)).alias("value"))
    return ignore.parse_pattern_lines(raw).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("is_dir").alias("n_dirs"), F.countDistinct("pattern").alias("n_distinct")
    )


_DEFAULTS = "(VALUES " + ", ".join(f"('{p}')" for p in DEFAULT_PATTERNS) + ")"


@register(
    "pattern_union",
    w("sug", f"""SELECT pattern, suffix(pattern, '/') AS is_dir, max(votes) AS votes FROM (
      SELECT f AS pattern, count(DISTINCT run) AS votes FROM sug GROUP BY f
      UNION ALL SELECT d, count(DISTINCT run) FROM sug GROUP BY d
      UNION ALL SELECT p, 0 FROM {_DEFAULTS} t(p)) GROUP BY pattern"""),
)
def pattern_union(spark, sf):
    return ignore.consolidate_suggestions(B.suggestion_runs(spark, sf))


def _stored_patterns(spark, sf):
    """Patterns already stored: the folders suggested by promotional parts and all file globs of small parts."""
    runs = B.table(spark, sf, "part").filter(F.col("p_type").isin("PROMO", "SMALL"))
    folder = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"), F.lit("/"))
    return runs.select(
        F.when(F.col("p_type") == "PROMO", folder).otherwise(F.concat(F.lit("*."), F.lower("p_type"))).alias("pattern")
    ).withColumn("is_dir", F.col("pattern").endswith("/"))


STORED = """stored AS (SELECT DISTINCT CASE WHEN p_type = 'PROMO' THEN replace(p_name, ' ', '_') || '_' || p_size || '/'
  ELSE '*.' || lower(p_type) END AS pattern FROM part WHERE p_type IN ('PROMO', 'SMALL'))"""
ALL_SUGGESTED = "alls AS (SELECT f AS pattern FROM sug UNION SELECT d FROM sug)"


def _suggested(spark, sf):
    runs = B.suggestion_runs(spark, sf)
    return runs.select(F.explode(F.concat("ignore_files", "ignore_folders")).alias("pattern")).withColumn(
        "is_dir", F.col("pattern").endswith("/")
    )


@register(
    "pattern_diff",
    w("sug", f"SELECT * FROM (WITH {STORED}, {ALL_SUGGESTED} SELECT pattern, suffix(pattern, '/') AS is_dir FROM alls ANTI JOIN stored USING (pattern))"),
)
def pattern_diff(spark, sf):
    return ignore.patterns_to_add(_suggested(spark, sf), _stored_patterns(spark, sf))


@register(
    "pattern_add",
    w("sug", f"""SELECT * FROM (WITH {STORED}, {ALL_SUGGESTED}, u AS (SELECT pattern FROM stored UNION SELECT pattern FROM alls)
      SELECT pattern, suffix(pattern, '/') AS is_dir, pattern NOT IN (SELECT pattern FROM stored) AS added FROM u)"""),
)
def pattern_add(spark, sf):
    return ignore.sort_patterns(ignore.add_patterns(_stored_patterns(spark, sf), _suggested(spark, sf)))


@register(
    "pattern_order",
    w("sug", f"""SELECT * FROM (WITH {STORED}, {ALL_SUGGESTED}, u AS (SELECT pattern FROM stored UNION SELECT pattern FROM alls)
      SELECT pattern, row_number() OVER (ORDER BY suffix(pattern, '/') DESC, pattern) AS place FROM u)"""),
)
def pattern_order(spark, sf):
    """The order in which an ignore file lists the patterns."""
    every = ignore.add_patterns(_stored_patterns(spark, sf), _suggested(spark, sf))
    return sorted_row_number(every, [F.desc("is_dir"), "pattern"], "place").select("pattern", "place")


@register(
    "pattern_counts",
    w("sug", f"SELECT * FROM (WITH {ALL_SUGGESTED} SELECT suffix(pattern, '/') AS is_dir, count(*) AS n_patterns FROM alls GROUP BY 1)"),
)
def pattern_counts(spark, sf):
    return ignore.pattern_counts(_suggested(spark, sf).distinct())


# ---------------------------------------------------------------- symbols

SYM = "docs lines rules sym"


@register("symbols_by_rule", w(SYM, "SELECT repo_id, file, line, type, name, type_ord, pos FROM sym"))
def symbols_by_rule(spark, sf):
    return _prose(spark, sf).drop("cell", "block")


@register(
    "symbols_sorted",
    w(SYM, """SELECT repo_id, file, line, type, name, pos, row_number() OVER (ORDER BY repo_id, file, line, type_ord, pos) AS place FROM sym"""),
)
def symbols_sorted(spark, sf):
    ranked = symbols.ranked_symbols(_prose(spark, sf))
    return ranked.select("repo_id", "file", "line", "type", "name", "pos", "place")


@register(
    "symbol_sample",
    w(SYM, "SELECT repo_id, file, line, type, name FROM sym ORDER BY repo_id, file, line, type_ord, pos LIMIT 5"),
)
def symbol_sample(spark, sf):
    return symbols.symbol_sample(_prose(spark, sf)).select("repo_id", "file", "line", "type", "name")


@register(
    "symbol_query",
    w(SYM, """SELECT repo_id, file, line, type, name FROM sym WHERE starts_with(file, 'en/')
      AND lower(regexp_extract(file, '(\\.[^.]+)$', 1)) = '.js'"""),
)
def symbol_query(spark, sf):
    return catalog.filter_query(_prose(spark, sf), "file", ext="JS", prefix="en/").select("repo_id", "file", "line", "type", "name")


@register(
    "symbols_by_file",
    w(SYM, """SELECT repo_id, file, count(*) AS n_symbols, min(line) AS first_line, max(line) AS last_line,
      count(DISTINCT type) AS n_types FROM sym GROUP BY repo_id, file"""),
)
def symbols_by_file(spark, sf):
    return symbols.symbols_by_file(_prose(spark, sf))


@register(
    "symbols_grouped",
    w(SYM, """SELECT repo_id, name, part, count(*) AS n_symbols, string_agg(item, ' ' ORDER BY rn) AS symbols FROM (
      SELECT *, CAST((rn - 1) // 100 AS BIGINT) AS part FROM (SELECT repo_id, string_split(file, '/')[-1] AS name,
        file || ':' || line || ':' || type || ':' || sym.name AS item,
        row_number() OVER (PARTITION BY repo_id, string_split(file, '/')[-1] ORDER BY file, line, type_ord, pos) AS rn FROM sym)) GROUP BY ALL"""),
)
def symbols_grouped(spark, sf):
    item = lambda s: F.concat_ws(":", s["file"], s["line"].cast("string"), s["type"], s["name"])
    return symbols.grouped_symbols(_prose(spark, sf)).withColumn("symbols", F.array_join(F.transform("symbols", item), " "))


@register(
    "file_profile",
    w(SYM, """SELECT repo_id, file, count(*) FILTER (type = 'function') AS n_function, count(*) FILTER (type = 'class') AS n_class,
      count(*) FILTER (type = 'variable') AS n_variable, count(*) FILTER (type = 'key') AS n_other FROM sym GROUP BY repo_id, file"""),
)
def file_profile(spark, sf):
    return symbols.file_profile(_prose(spark, sf))


@register(
    "profile_names",
    w(SYM, """SELECT repo_id, file, type, part, string_agg(name, ' ' ORDER BY rn) AS names FROM (
      SELECT *, CAST((rn - 1) // 100 AS BIGINT) AS part FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_id, file, type ORDER BY line, pos) AS rn FROM sym)) GROUP BY ALL"""),
)
def profile_names(spark, sf):
    return symbols.profile_names(_prose_table(spark, sf)).withColumn("names", F.array_join("names", " "))


@register(
    "symbol_totals",
    w(SYM, "SELECT repo_id, count(*) AS n_total, count(*) FILTER (type = 'class') AS n_filtered FROM sym GROUP BY repo_id"),
)
def symbol_totals(spark, sf):
    return symbols.symbol_totals(_prose(spark, sf), F.col("type") == "class")


@register(
    "type_tags",
    w(SYM, "SELECT type, substr(type, 1, 3) AS stored_tag, substr(type, 1, 3) AS table_tag, count(*) AS n_symbols FROM sym GROUP BY type"),
)
def type_tags(spark, sf):
    return symbols.type_tags(_prose(spark, sf))


@register(
    "keys_by_rule",
    """SELECT event_type AS repo_id, name, count(*) AS n_keys FROM (
       SELECT event_type, unnest(regexp_extract_all(props, '"([^"]+)"\\s*:', 1)) AS name FROM events) GROUP BY ALL""",
)
def keys_by_rule(spark, sf):
    files = B.table(spark, sf, "events").select(
        F.col("event_type").alias("repo_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".json")).alias("rel_path"),
        F.col("props").alias("text"),
    )
    return symbols.symbols_by_rule(files).groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("n_keys"))


@register(
    "sql_symbols",
    "SELECT event_id, name FROM (SELECT event_id, unnest(regexp_extract_all(props, '\"([^\"]+)\"\\s*:', 1)) AS name FROM events)",
)
def sql_symbols(spark, sf):
    sql_functions.register(spark)
    return spark.sql(
        "select event_id, found.name from (select event_id, explode(coalesce(symbols_found, array())) as found from "
        "(select event_id, symbols_of(concat('e', event_id, '.json'), props) as symbols_found from {events}))",
        events=B.table(spark, sf, "events"),
    )


def _config_text() -> Column:
    """Parts written as TOML: a comment, root keys, a table with keys."""
    return F.concat(
        F.lit('# part\nname = "'), "p_name", F.lit(' = x" # brand = none\nbrand = "'), "p_brand",
        F.lit('"\n\n[stock]\nsize = '), F.col("p_size").cast("string"), F.lit("\n"),
    )


@register(
    "config_keys",
    """SELECT p_brand AS repo_id, 'k' || p_partkey || '.toml' AS file, line, name FROM part,
       (VALUES (2, 'name'), (3, 'brand'), (6, 'size')) t(line, name)""",
)
def config_keys(spark, sf):
    files = B.table(spark, sf, "part").select(
        F.col("p_brand").alias("repo_id"),
        F.concat(F.lit("k"), F.col("p_partkey").cast("string"), F.lit(".toml")).alias("rel_path"),
        _config_text().alias("text"),
    )
    return symbols.extract_symbols(files).select("repo_id", "file", "line", "name")


def _code_files(spark, sf):
    """Customers written as small source files, one language per market segment."""
    key = F.col("c_custkey").cast("string")
    segment = F.col("c_mktsegment")

    def text(*parts: str) -> Column:
        return F.concat(*[key if p is None else F.lit(p) for p in parts])

    body = (
        F.when(segment == "BUILDING", text("class C", None, "(Base):\n    '''def no():\n    '''\n    def f", None, "(\n        self, a=1\n    ):\n        total = g(x=2)  # y = 3\n"))
        .when(segment == "AUTOMOBILE", text("export class C", None, " {\n  run", None, "(a: number): void {\n  }\n}\nexport const V", None, " = (a) => a // const no = 1\n"))
        .when(segment == "MACHINERY", text("pub struct C", None, "<'a> { s: &'a str }\nimpl C {\n    fn f", None, "(&self) -> u8 {\n        let v", None, " = 1;\n    }\n}\ntrait T { fn no(&self); }\n"))
        .when(segment == "HOUSEHOLD", text("type C", None, " struct {\n}\n\nfunc (c *C) F", None, "() {\n\tv", None, ", err := g()\n\tvar no = 1\n}\n"))
        .otherwise(text("module M", None, "\n  class C", None, "\n    def f", None, "\n      x = 1\n    end\n  end\nend\n"))
    )
    ext = (
        F.when(segment == "BUILDING", ".py").when(segment == "AUTOMOBILE", ".ts")
        .when(segment == "MACHINERY", ".rs").when(segment == "HOUSEHOLD", ".go").otherwise(".rb")
    )
    return B.table(spark, sf, "customer").select(
        segment.alias("repo_id"), F.concat(F.lit("src/c"), key, ext).alias("rel_path"), body.alias("text")
    )


@register(
    "code_symbols",
    """WITH expected(seg, ext, line, type, pre, keyed) AS (VALUES
       ('BUILDING', '.py', 1, 'class', 'C', true), ('BUILDING', '.py', 4, 'function', 'f', true), ('BUILDING', '.py', 7, 'variable', 'total', false),
       ('AUTOMOBILE', '.ts', 1, 'class', 'C', true), ('AUTOMOBILE', '.ts', 2, 'function', 'run', true),
       ('AUTOMOBILE', '.ts', 5, 'variable', 'V', true), ('AUTOMOBILE', '.ts', 5, 'component', 'V', true),
       ('MACHINERY', '.rs', 1, 'class', 'C', true), ('MACHINERY', '.rs', 3, 'function', 'f', true), ('MACHINERY', '.rs', 4, 'variable', 'v', true),
       ('MACHINERY', '.rs', 7, 'class', 'T', false),
       ('HOUSEHOLD', '.go', 1, 'class', 'C', true), ('HOUSEHOLD', '.go', 4, 'function', 'F', true), ('HOUSEHOLD', '.go', 5, 'variable', 'v', true),
       ('HOUSEHOLD', '.go', 5, 'variable', 'err', false),
       ('FURNITURE', '.rb', 1, 'class', 'M', true), ('FURNITURE', '.rb', 2, 'class', 'C', true), ('FURNITURE', '.rb', 3, 'function', 'f', true))
       SELECT c_mktsegment AS repo_id, 'src/c' || c_custkey || ext AS file, line, type,
         CASE WHEN keyed THEN pre || c_custkey ELSE pre END AS name
       FROM customer JOIN expected ON seg = c_mktsegment""",
)
def code_symbols(spark, sf):
    return symbols.extract_symbols(_code_files(spark, sf)).select("repo_id", "file", "line", "type", "name")


MASKED = """masked AS (SELECT repo_id, rel_path, regexp_replace(regexp_replace(regexp_replace(text, '<!--.*?-->', '', 'gs'),
  '(<script[^>]*>).*?</script', '\\1</script', 'gs'), '(<style[^>]*>).*?</style', '\\1</style', 'gs') AS h FROM page_files)"""


@register(
    "html_tags",
    w("page_files", f"""SELECT repo_id, rel_path AS file, unnest(t) AS name, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos
      FROM (WITH {MASKED} SELECT repo_id, rel_path, regexp_extract_all(h, '</?([A-Za-z][^\\s/>]*)', 1) AS t FROM masked)"""),
)
def html_tags(spark, sf):
    found = symbols.markup_symbols(B.page_files(spark, sf, heavy=True).select("repo_id", "rel_path", "text"))
    return found.filter(F.col("type") == "tag").select("repo_id", "file", "name", "pos")


@register(
    "html_attributes",
    w("page_files", f"""SELECT repo_id, file, name, count(*) AS n_uses FROM (
      SELECT repo_id, file, unnest(regexp_extract_all(tag, '\\s([^\\s=<>"''/]+(\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+))?)', 1)) AS name
      FROM (WITH {MASKED} SELECT repo_id, rel_path AS file, unnest(regexp_extract_all(h, '<[A-Za-z](?:[^<>"'']|"[^"]*"|''[^'']*'')*>')) AS tag FROM masked))
      GROUP BY ALL"""),
)
def html_attributes(spark, sf):
    found = symbols.markup_symbols(B.page_files(spark, sf, heavy=True).select("repo_id", "rel_path", "text"))
    return found.filter(F.col("type") == "attribute").groupBy("repo_id", "file", "name").agg(F.count(F.lit(1)).alias("n_uses"))


@register(
    "delimited_regions",
    w("docs lines", """SELECT repo_id, rel_path, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (open % 2 = 1) AS INTEGER) AS n_inside
      FROM (SELECT repo_id, rel_path, coalesce(sum((length(line) - length(replace(line, '$$', ''))) // 2) OVER
        (PARTITION BY repo_id, rel_path ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM lines) GROUP BY ALL"""),
)
def delimited_regions(spark, sf):
    return symbols.delimited_lines(_docs(spark, sf))


@register(
    "notebook_offsets",
    """SELECT conv_id, turn, CAST(coalesce(sum(len(string_split(text, chr(10)))) OVER (PARTITION BY conv_id ORDER BY turn
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_offset
       FROM conversations WHERE role <> 'user' AND trim(text) <> ''""",
)
def notebook_offsets(spark, sf):
    kept = B.table(spark, sf, "conversations").filter((F.col("role") != "user") & (F.trim("text") != ""))
    rows = kept.select("conv_id", "turn", F.size(F.split("text", "\n", -1)).cast("bigint").alias("n"))
    return block_running_sum(rows, ["conv_id"], "turn", F.col("n"), "line_offset").select("conv_id", "turn", "line_offset")


def _notebooks(spark, sf):
    """Each turn as a notebook: a cell per line, code where the line ends with a full stop."""
    cells = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.struct(
            F.when(line.endswith("."), "code").otherwise("markdown").alias("cell_type"),
            F.array(
                F.concat(F.lit("def f_"), i.cast("string"), F.lit("(a=1):\n")),
                F.concat(F.lit("    n = "), F.char_length(line).cast("string")),
            ).alias("source"),
        ),
    )
    return B.table(spark, sf, "conversations").select(
        F.col("role").alias("repo_id"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/t"), F.col("turn").cast("string"), F.lit(".ipynb")).alias("rel_path"),
        F.to_json(F.struct(cells.alias("cells"))).alias("text"),
    )


@register(
    "notebook_symbols",
    """SELECT role AS repo_id, 'c' || conv_id || '/t' || turn || '.ipynb' AS file, CAST(2 * (rn - 1) + o AS INTEGER) AS line,
         CASE o WHEN 1 THEN 'function' ELSE 'variable' END AS type, CASE o WHEN 1 THEN 'f_' || (no - 1) ELSE 'n' END AS name,
         CAST(no AS INTEGER) AS cell
       FROM (SELECT role, conv_id, turn, no, row_number() OVER (PARTITION BY conv_id, turn ORDER BY no) AS rn
         FROM (SELECT role, conv_id, turn, unnest(l) AS line, generate_subscripts(l, 1) AS no
           FROM (SELECT *, string_split(text, chr(10)) AS l FROM conversations)) WHERE suffix(line, '.')), (VALUES (1), (2)) t(o)""",
)
def notebook_symbols(spark, sf):
    return symbols.notebook_symbols(_notebooks(spark, sf)).select("repo_id", "file", "line", "type", "name", "cell")


@register(
    "block_symbols",
    w("page_files", """SELECT repo_id, 'v' || page_id || '.vue' AS file, line, type, name, block FROM (
      SELECT *, unnest([{'line': 2, 'type': 'tag', 'name': 'a', 'block': 'template'}, {'line': 2, 'type': 'tag', 'name': 'a', 'block': 'template'},
        {'line': 2, 'type': 'attribute', 'name': 'href="' || url || '"', 'block': 'template'},
        {'line': 5, 'type': 'variable', 'name': 'id' || page_id, 'block': 'script'},
        {'line': 6, 'type': 'function', 'name': 'go' || page_id, 'block': 'script'}], recursive := true) FROM page_files)"""),
)
def block_symbols(spark, sf):
    key = F.col("page_id").cast("string")
    text = F.concat(
        F.lit('<template>\n<a href="'), "url", F.lit('">x</a>\n</template>\n<script setup lang="ts">\nconst id'), key,
        F.lit(" = '<b>'\nfunction go"), key, F.lit("() {}\n</script>\n"),
    )
    files = B.page_files(spark, sf).select(
        "repo_id", F.concat(F.lit("v"), key, F.lit(".vue")).alias("rel_path"), text.alias("text")
    )
    # The first script line is the rest of the tag line, so the lines of the block count from the tag.
    return symbols.component_symbols(files).select("repo_id", "file", "line", "type", "name", "block")


# ---------------------------------------------------------------- reports


@register(
    "symbols_markdown",
    w(SYM, "SELECT repo_id, file, pos, '| ' || file || ' | ' || line || ' | ' || type || ' | ' || name || ' |' AS value FROM sym"),
)
def symbols_markdown(spark, sf):
    return reports.symbols_markdown(_prose(spark, sf)).select("repo_id", "file", "pos", "value")


@register(
    "symbols_text",
    w(SYM, "SELECT repo_id, string_split(file, '/')[-1] AS heading, printf('  %4d %-3s %s', line, substr(type, 1, 3), name) AS value FROM sym"),
)
def symbols_text(spark, sf):
    return reports.symbols_text(_prose(spark, sf)).select("repo_id", "heading", "value")


@register(
    "symbols_json",
    w(SYM, """SELECT repo_id, file, pos, '{"file":"' || file || '","line":' || line || ',"type":"' || type || '","name":"' || name || '"}' AS value
      FROM sym"""),
)
def symbols_json(spark, sf):
    return reports.symbols_json(_prose(spark, sf)).select("repo_id", "file", "pos", "value")


@register(
    "symbols_listing",
    w(SYM, "SELECT repo_id, file, pos, printf('%-60s %-6d %-10s %s', file, line, type, name) AS value FROM sym"),
)
def symbols_listing(spark, sf):
    return reports.symbols_listing(_prose(spark, sf)).select("repo_id", "file", "pos", "value")


@register(
    "symbols_compact",
    w(SYM, """SELECT repo_id, file, part, CAST(count(*) AS INTEGER) AS n_symbols,
      string_agg(line || ':' || substr(type, 1, 3) || ':' || name, ' ' ORDER BY rn) AS value
      FROM (SELECT *, CAST((rn - 1) // 100 AS BIGINT) AS part FROM (SELECT *, row_number() OVER
        (PARTITION BY repo_id, file ORDER BY line, type_ord, pos) AS rn FROM sym)) GROUP BY repo_id, file, part"""),
)
def symbols_compact(spark, sf):
    return reports.symbols_compact(_prose_table(spark, sf))


@register(
    "symbols_parse",
    """WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN NULL ELSE
         turn || ':fun:' || regexp_replace(trim(text), '\\s+', ' ' || turn || ':var:', 'g') END AS value,
         CASE WHEN role = 'user' THEN 'src/t' || turn || '.py' END AS header FROM conversations),
       f AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS file FROM c),
       k AS (SELECT conv_id, turn, file, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos
         FROM (SELECT *, string_split(value, ' ') AS l FROM f WHERE value IS NOT NULL AND file IS NOT NULL))
       SELECT conv_id, file, turn, CAST(pos AS INTEGER) AS pos, CAST(string_split(tok, ':')[1] AS INTEGER) AS line,
         string_split(tok, ':')[2] AS type, array_to_string(string_split(tok, ':')[3:], ':') AS name FROM k""",
)
def symbols_parse(spark, sf):
    turn = F.col("turn").cast("string")
    joined = F.regexp_replace(F.trim("text"), F.lit(r"\s+"), F.concat(F.lit(" "), turn, F.lit(":var:")))
    lines = B.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", F.concat(F.lit("src/t"), turn, F.lit(".py")))
        .otherwise(F.concat(turn, F.lit(":fun:"), joined)).alias("value"),
    )
    return reports.parse_compact(lines, store="conv_id", line_no="turn")


@register(
    "summary_report",
    w("docs lab page_files meta", f"""SELECT repo_id, rel_path, '| ' || rel_path || ' | ' ||
      CASE WHEN length(summary) > 80 THEN substr(summary, 1, 80) || '...' ELSE summary END || ' | ' || {SQL_LABEL} || ' |' AS value
      FROM meta WHERE summary <> ''"""),
)
def summary_report(spark, sf):
    return reports.summary_report(B.stored_metadata(spark, sf))


@register(
    "summary_order",
    w("docs lab page_files meta", """SELECT repo_id, rel_path, row_number() OVER (ORDER BY repo_id, rel_path) AS place FROM meta WHERE summary <> ''"""),
)
def summary_order(spark, sf):
    """The order of a listing of all summaries."""
    rows = reports.summary_report(B.stored_metadata(spark, sf))
    return sorted_row_number(rows, ["repo_id", "rel_path"], "place").select("repo_id", "rel_path", "place")


@register(
    "summary_json",
    w("docs lab page_files meta", """SELECT repo_id, rel_path, '{"file":' || to_json(rel_path) || ',"summary":' || to_json(summary) ||
      CASE WHEN last_updated IS NULL THEN '' ELSE ',"last_updated":"' || strftime(last_updated, '%Y-%m-%dT%H:%M:%S') || '.000Z"' END || '}' AS value
      FROM meta WHERE summary <> ''"""),
)
def summary_json(spark, sf):
    return reports.summary_json(B.stored_metadata(spark, sf))


@register(
    "text_replaced",
    "SELECT doc_id, length(text) + 5 AS n_chars, md5(chr(65533) || text || 'x' || chr(65533) || '(' || chr(65533)) AS text_md5 FROM documents",
)
def text_replaced(spark, sf):
    """Documents with malformed bytes around them: a lone continuation byte, a broken and a cut-off sequence."""
    bad = lambda code: F.unhex(F.lit(code))
    content = F.concat(bad("80"), F.encode("text", "UTF-8"), bad("78C328E282"))
    text = decode(content)
    return B.table(spark, sf, "documents").select("doc_id", F.char_length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"))


@register(
    "summary_query",
    w("docs lab page_files meta", f"""SELECT repo_id, rel_path, summary, {SQL_LABEL} AS last_updated FROM meta
      WHERE summary <> '' AND starts_with(rel_path, 'en/') AND lower({SQL_EXT}) = '.md'"""),
)
def summary_query(spark, sf):
    found = catalog.filter_query(B.stored_metadata(spark, sf), "rel_path", ext="md", prefix="en/")
    return found.filter(F.col("summary") != "").select("repo_id", "rel_path", "summary", _label())


@register(
    "summary_text",
    w("docs lab page_files meta", f"""SELECT repo_id, rel_path, repeat('=', 60) || chr(10) || 'File: ' || rel_path || chr(10) || 'Last Updated: ' ||
      {SQL_LABEL} || chr(10) || repeat('=', 60) || chr(10) || summary AS value FROM meta WHERE summary <> ''"""),
)
def summary_text(spark, sf):
    return reports.summary_text(B.stored_metadata(spark, sf))


# ---------------------------------------------------------------- hierarchy


@register(
    "dir_rollup",
    w("page_files", """SELECT * FROM (
      WITH up AS (SELECT repo_id, octet_length(encode(text)) AS b, unnest(list_transform(range(0, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS dir
          FROM (SELECT *, string_split(rel_path, '/') AS s FROM page_files)),
        d AS (SELECT DISTINCT repo_id, dir FROM up),
        t AS (SELECT repo_id, dir, count(*) AS n_files, CAST(sum(b) AS BIGINT) AS bytes FROM up GROUP BY ALL),
        below AS (SELECT a.repo_id, a.dir, count(*) AS n FROM d a JOIN d x ON a.repo_id = x.repo_id AND x.dir <> '' AND x.dir <> a.dir
          AND (a.dir = '' OR starts_with(x.dir, a.dir || '/')) GROUP BY ALL)
      SELECT t.repo_id, t.dir, n_files, coalesce(n, 0) AS n_dirs, bytes FROM t LEFT JOIN below USING (repo_id, dir))"""),
)
def dir_rollup(spark, sf):
    return hierarchy.dir_rollup(_page_catalog(spark, sf))


@register(
    "large_repos",
    w("docs", """SELECT repo_id, count(*) AS n_files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes,
      count(*) > 49 OR sum(octet_length(encode(text))) / 1048576.0 > 0.125 AS is_large FROM docs GROUP BY repo_id"""),
)
def large_repos(spark, sf):
    return hierarchy.large_repos(_doc_catalog(spark, sf), file_threshold=49, size_threshold_mb=0.125)


def _tree_sql(include_files: bool, max_depth: int | None) -> str:
    files = "UNION ALL SELECT repo_id, rel_path, true, octet_length(encode(text)) FROM page_files" if include_files else ""
    depth = f"WHERE len(string_split(path, '/')) <= {max_depth + 1}" if max_depth is not None else ""
    return w("page_files", f"""SELECT * FROM (
      WITH dirs AS (SELECT DISTINCT repo_id, unnest(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS path
          FROM (SELECT repo_id, string_split(rel_path, '/') AS s FROM page_files)),
        every AS (SELECT repo_id, path, false AS is_file, NULL AS b FROM dirs {files}),
        n AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS parent, string_split(path, '/')[-1] AS name FROM every {depth}),
        f AS (SELECT *, row_number() OVER (PARTITION BY repo_id, parent ORDER BY is_file DESC, name DESC) = 1 AS is_last FROM n),
        bars AS (SELECT x.repo_id, x.path, coalesce(string_agg(CASE WHEN a.path IS NULL THEN '' WHEN a.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY length(a.path)), '') AS bars
          FROM f x LEFT JOIN f a ON a.repo_id = x.repo_id AND NOT a.is_file AND starts_with(x.path, a.path || '/') GROUP BY ALL)
      SELECT repo_id, path, is_file, bars || CASE WHEN is_last THEN '└── ' ELSE '├── ' END || name ||
        CASE WHEN NOT is_file THEN '/' WHEN b < 1024 THEN printf(' (%.1fB)', b * 1.0) ELSE printf(' (%.1fKB)', round_even(b / 1024.0, 1)) END AS line
      FROM f JOIN bars USING (repo_id, path))""")


@register("tree_lines", _tree_sql(True, None))
def tree_lines(spark, sf):
    return hierarchy.tree_lines(_page_catalog(spark, sf)).select("repo_id", "path", "is_file", "line")


@register(
    "tree_order",
    w("page_files", """SELECT * FROM (
      WITH dirs AS (SELECT DISTINCT repo_id, unnest(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS path
          FROM (SELECT repo_id, string_split(rel_path, '/') AS s FROM page_files)),
        every AS (SELECT repo_id, path, 0 AS f FROM dirs UNION ALL SELECT repo_id, rel_path, 1 FROM page_files),
        keyed AS (SELECT *, list_transform(string_split(path, '/'), lambda x, i: {'k': CASE WHEN f = 1 AND i = len(string_split(path, '/')) THEN 1 ELSE 0 END, 'name': x}) AS key FROM every)
      SELECT repo_id, path, row_number() OVER (ORDER BY repo_id, key) AS place FROM keyed)"""),
)
def tree_order(spark, sf):
    """The order of all tree lines: depth first, folders before files."""
    lines = hierarchy.tree_lines(_page_catalog(spark, sf)).select("repo_id", "path", "sort_key")
    return sorted_row_number(lines, ["repo_id", "sort_key"], "place").select("repo_id", "path", "place")


@register("tree_folders", _tree_sql(False, None))
def tree_folders(spark, sf):
    return hierarchy.tree_lines(_page_catalog(spark, sf), include_files=False).select("repo_id", "path", "is_file", "line")


@register("tree_depth", _tree_sql(True, 1))
def tree_depth(spark, sf):
    return hierarchy.tree_lines(_page_catalog(spark, sf), max_depth=1).select("repo_id", "path", "is_file", "line")


# ---------------------------------------------------------------- requests


@register(
    "batch_requests",
    w("docs", f"""SELECT rel_path AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, 'summary-model' AS model,
      CAST(4000 AS INTEGER) AS max_tokens, CAST(0.3 AS DOUBLE) AS temperature, length(prompt) AS prompt_chars, md5(prompt) AS prompt_md5
      FROM (SELECT rel_path, '{requests.PROMPT_HEAD.replace("'", "''")}' || rel_path || chr(10) || 'Language: ' ||
        coalesce(CASE lower({SQL_EXT}) WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript'
          WHEN '.md' THEN 'Markdown' WHEN '.html' THEN 'HTML' END, 'Unknown') ||
        '{requests.PROMPT_TASK.replace("'", "''")}' || substr(text, 1, 50000) || '{requests.PROMPT_TAIL.replace("'", "''")}' AS prompt
      FROM docs WHERE length(text) > 0)"""),
)
def batch_requests(spark, sf):
    prompt = F.col("body.messages")[1]["content"]
    return requests.batch_requests(_docs(spark, sf)).select(
        "custom_id", "method", "url", "body.model", "body.max_tokens", "body.temperature",
        F.char_length(prompt).cast("bigint").alias("prompt_chars"), F.md5(prompt).alias("prompt_md5"),
    )


@register(
    "single_prompts",
    w("docs", f"""SELECT rel_path, length(prompt) AS prompt_chars, md5(prompt) AS prompt_md5 FROM (
      SELECT rel_path, '{requests.PROMPT_HEAD.replace("'", "''")}' || rel_path || coalesce(' (Language: ' || CASE lower({SQL_EXT}) WHEN '.py' THEN 'Python'
        WHEN '.js' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript' WHEN '.md' THEN 'Markdown' WHEN '.html' THEN 'HTML' END || ')', '') ||
        '{requests.PROMPT_TASK.replace("'", "''")}' || substr(text, 1, 2000) ||
        CASE WHEN length(text) > 2000 THEN chr(10) || '{requests.TRUNCATION_NOTE}' ELSE '' END || '{requests.PROMPT_TAIL.replace("'", "''")}' AS prompt
      FROM docs)"""),
)
def single_prompts(spark, sf):
    prompt = requests.single_prompt(F.col("rel_path"), paths.display_language("rel_path"), F.col("text"), 2000)
    return _docs(spark, sf).select(
        "rel_path", F.char_length(prompt).cast("bigint").alias("prompt_chars"), F.md5(prompt).alias("prompt_md5")
    )


@register(
    "summarise_changed",
    w("docs lab page_files meta", f"""SELECT d.repo_id, d.rel_path, coalesce(CASE lower(regexp_extract(d.rel_path, '(\\.[^.]+)$', 1)) WHEN '.py' THEN 'Python'
        WHEN '.js' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript' WHEN '.md' THEN 'Markdown' WHEN '.html' THEN 'HTML' END, 'None') || ' ' || length(d.text) AS summary
      FROM docs d LEFT JOIN meta m ON d.repo_id = m.repo_id AND d.rel_path = m.rel_path
      WHERE (m.rel_path IS NULL OR m.hash IS DISTINCT FROM md5(d.text)) AND length(d.text) > 0"""),
)
def summarise_changed(spark, sf):
    def describe(path, content, language):
        return {"summary": f"{language} {len(content)}"}

    files = _doc_catalog(spark, sf)
    keys = changes.files_to_update(files.select("repo_id", "rel_path", "hash"), B.stored_metadata(spark, sf))
    return summarise(catalog.with_text(changes.only_keys(files, keys)), describe).drop("error")


@register(
    "request_chunk_sizes",
    w("docs", """SELECT chunk, part, count(*) AS n_requests, CAST(sum(b) AS BIGINT) AS bytes FROM (
      SELECT b, (seq - 1) // 100 AS chunk, CAST(CASE WHEN b * 2 <= 60000 THEN start_byte // (60001 - longest) ELSE -seq END AS BIGINT) AS part
      FROM (SELECT b, row_number() OVER (ORDER BY repo_id, rel_path) AS seq, max(small) OVER () AS longest,
          coalesce(sum(small) OVER (ORDER BY repo_id, rel_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_byte
        FROM (SELECT *, CASE WHEN b * 2 <= 60000 THEN b ELSE 0 END AS small
          FROM (SELECT repo_id, rel_path, octet_length(encode(text)) AS b FROM docs)))) GROUP BY chunk, part"""),
)
def request_chunk_sizes(spark, sf):
    sizes = _docs(spark, sf).select(
        "repo_id", F.col("rel_path").alias("custom_id"), F.octet_length("text").cast("bigint").alias("bytes")
    )
    return requests.chunk_sizes(requests.chunk_requests(sizes, max_requests=100, max_bytes=60_000))


@register(
    "request_type_histogram",
    w("docs", f"SELECT coalesce(nullif({SQL_EXT}, ''), rel_path) AS file_type, count(*) AS n_requests FROM docs GROUP BY 1"),
)
def request_type_histogram(spark, sf):
    return requests.type_histogram(_docs(spark, sf).select(F.col("rel_path").alias("custom_id")))


@register(
    "request_type_filter",
    w("docs", f"SELECT rel_path AS custom_id FROM docs WHERE {SQL_EXT} NOT IN ('.py', '.txt')"),
)
def request_type_filter(spark, sf):
    return requests.exclude_types(_docs(spark, sf).select(F.col("rel_path").alias("custom_id")), [".py", ".txt"])


@register(
    "token_estimate",
    w("docs", "SELECT repo_id, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(sum(length(text)) // 4 AS BIGINT) AS est_tokens FROM docs GROUP BY repo_id"),
)
def token_estimate(spark, sf):
    return requests.char_totals(_docs(spark, sf))


@register(
    "batch_cost",
    w("docs", "SELECT repo_id, count(*) AS n_requests, round(count(*) * 0.0005::DOUBLE, 4) AS est_cost FROM docs GROUP BY repo_id"),
)
def batch_cost(spark, sf):
    return requests.batch_cost(_docs(spark, sf))


@register(
    "request_chunks",
    w("docs", """SELECT repo_id, custom_id, seq, (seq - 1) // 100 AS chunk, CAST(start_byte // (524288001 - longest) AS BIGINT) AS part FROM (
      SELECT repo_id, rel_path AS custom_id, row_number() OVER o AS seq, max(octet_length(encode(text))) OVER () AS longest,
        coalesce(sum(octet_length(encode(text))) OVER (ORDER BY repo_id, rel_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_byte
      FROM docs WINDOW o AS (ORDER BY repo_id, rel_path))"""),
)
def request_chunks(spark, sf):
    sizes = _docs(spark, sf).select(
        "repo_id", F.col("rel_path").alias("custom_id"), F.octet_length("text").cast("bigint").alias("bytes")
    )
    return requests.chunk_requests(sizes, max_requests=100).select("repo_id", "custom_id", "seq", "chunk", "part")


def _result_lines(spark, sf, repo=""):
    """Turns as result lines: assistants answer in JSON, system turns in raw text, user turns are broken lines."""
    content = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.col("text").alias("summary")))).otherwise(F.col("text"))
    choices = F.array(F.struct(F.struct(content.alias("content")).alias("message")))
    line = F.to_json(
        F.struct(
            F.concat(F.lit(f"{repo}conv_"), F.col("conv_id").cast("string"), F.lit(".md")).alias("custom_id"),
            F.struct(F.struct(choices.alias("choices")).alias("body")).alias("response"),
        )
    )
    return B.table(spark, sf, "conversations").select(
        F.when(F.col("role") == "user", F.col("text")).otherwise(line).alias("value"), F.col("turn").alias("line_no")
    )


@register(
    "batch_results",
    "SELECT 'conv_' || conv_id || '.md' AS custom_id, turn AS line_no, text AS summary FROM conversations WHERE role <> 'user' AND text <> ''",
)
def batch_results(spark, sf):
    return requests.parse_results(_result_lines(spark, sf))


@register(
    "result_files",
    """SELECT 'conv_' || conv_id || '.md' AS custom_id, arg_max(text, (turn % 2) * 1000000 + turn) AS summary
       FROM conversations WHERE role <> 'user' AND text <> '' GROUP BY conv_id""",
)
def result_files(spark, sf):
    """Two batches' result folders on disk, even and odd turns; the last line of the last folder answers."""
    home = scratch_path(spark, "results")
    lines = _result_lines(spark, sf).withColumn("_id", F.get_json_object("value", "$.custom_id"))
    for part in (0, 1):
        some = lines.filter(F.col("line_no") % 2 == part)
        some.orderBy("_id", "line_no").select("value").write.text(f"{home}/{part}")
    return requests.last_summaries(stores.read_results(spark, f"{home}/0", f"{home}/1"))


@register(
    "batch_update",
    w("docs", """SELECT repo_id, rel_path, md5(text) AS hash, 'of ' || repo_id || '::' || rel_path AS summary, doc_id % 5 = 0 AS due FROM docs"""),
)
def batch_update(spark, sf):
    """Requests for all documents, answers to all of them, and every fifth document changed in between."""
    home = scratch_path(spark, "batch")
    docs = _docs(spark, sf)
    updates.prepare_batch(spark, B.files_of(docs), f"{home}/store", f"{home}/requests")
    asked = stores.load_table(spark, f"{home}/store/asked", BATCH_ASKED)
    content = F.to_json(F.struct(F.concat(F.lit("of "), "custom_id").alias("summary")))
    choices = F.array(F.struct(F.struct(content.alias("content")).alias("message")))
    answer = F.to_json(F.struct("custom_id", F.struct(F.struct(choices.alias("choices")).alias("body")).alias("response")))
    asked.select(answer.alias("value")).write.text(f"{home}/results")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    now = B.files_of(docs.withColumn("text", text))
    updates.finish_batch(spark, now, f"{home}/store", f"{home}/results", "2024-06-01")
    state = stores.load_metadata(spark, f"{home}/store/content")
    due = changes.files_to_update(catalog.build_catalog(now).select("repo_id", "rel_path", "hash"), state)
    marked = state.join(due.select("repo_id", "rel_path", F.lit(True).alias("_due")), ["repo_id", "rel_path"], "left")
    return marked.select("repo_id", "rel_path", "hash", "summary", F.coalesce("_due", F.lit(False)).alias("due"))


@register(
    "summary_merge",
    """WITH m AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
       a AS (SELECT conv_id, arg_max(text, turn) AS s FROM conversations WHERE role <> 'user' AND text <> '' GROUP BY conv_id)
       SELECT repo_id, 'conv_' || conv_id || '.md' AS rel_path, CAST(n AS VARCHAR) AS hash,
         CASE WHEN repo_id = 'chat' AND s IS NOT NULL THEN s ELSE 'none' END AS summary,
         CASE WHEN repo_id = 'chat' AND s IS NOT NULL THEN '2024-06-01 00:00:00' ELSE 'N/A' END AS last_updated
       FROM m LEFT JOIN a USING (conv_id), (VALUES ('chat'), ('copy')) r(repo_id)""",
)
def summary_merge(spark, sf):
    meta = B.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(F.array(F.lit("chat"), F.lit("copy"))).alias("repo_id"),  # the same paths in two repositories
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".md")).alias("rel_path"),
        F.col("n").cast("string").alias("hash"),
        F.lit(None).cast("timestamp").alias("last_updated"),
        F.lit("none").alias("summary"),
    )
    merged = requests.merge_results(meta, requests.parse_results(_result_lines(spark, sf, "chat::")), _as_of())
    return merged.select("repo_id", "rel_path", "hash", "summary", _label())


@register("summary_extract", "SELECT conv_id, turn, text AS summary FROM conversations")
def summary_extract(spark, sf):
    json = F.to_json(F.struct(F.col("text").alias("summary")))
    answer = (
        F.when(F.col("role") == "assistant", json)
        .when(F.col("role") == "system", F.concat(F.lit("Here it is:\n"), json, F.lit("\nDone.")))
        .otherwise(F.col("text"))
    )
    return B.table(spark, sf, "conversations").select("conv_id", "turn", summary_from_answer(answer).alias("summary"))


@register(
    "batch_errors",
    """SELECT CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') ELSE 'Unknown' END AS code,
       CASE WHEN event_type = 'error' THEN 'user ' || user_id ELSE 'Unknown error' END AS message, count(*) AS n_errors
       FROM events WHERE event_type IN ('error', 'click') GROUP BY ALL""",
)
def batch_errors(spark, sf):
    error = F.struct(
        F.get_json_object("props", "$.k").alias("code"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"),
    )
    line = (
        F.when(F.col("event_type") == "error", F.to_json(F.struct(F.col("event_id").cast("string").alias("custom_id"), error.alias("error"))))
        .when(F.col("event_type") == "click", F.to_json(F.struct(F.col("event_id").cast("string").alias("custom_id"))))
        .when(F.col("event_type") == "view", F.lit("  "))
        .otherwise(F.concat(F.lit("{broken "), "props"))
    )
    lines = B.table(spark, sf, "events").select(line.alias("value"))
    return requests.error_counts(requests.parse_errors(lines))


def _polls(spark, sf):
    status = (
        F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    )
    return B.table(spark, sf, "events").select("user_id", "ts", "event_id", status.alias("status"))


@register(
    "batch_state_counts",
    """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed,
       count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS pending, bool_and(event_type IN ('purchase', 'error')) AS all_done,
       bool_or(event_type = 'error') AS any_failed FROM events GROUP BY user_id""",
)
def batch_state_counts(spark, sf):
    return requests.state_counts(_polls(spark, sf), ["user_id"])


@register(
    "status_transitions",
    """WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END AS status, ts FROM events)
       SELECT user_id, event_id, status, previous FROM (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM s)
       WHERE previous IS DISTINCT FROM status""",
)
def status_transitions(spark, sf):
    return requests.status_transitions(_polls(spark, sf), "user_id", ["ts", "event_id"]).select(
        "user_id", "event_id", "status", "previous"
    )


# ---------------------------------------------------------------- history

SQL_SNAP = "strftime(snapshot_ts, '%Y-%m-%d_%H-%M-%S')"


@register(
    "history_list",
    w("hist", f"SELECT repo_id, {SQL_SNAP} AS label, count(*) AS n_rows FROM hist WHERE kind = 'snapshot' GROUP BY ALL"),
)
def history_list(spark, sf):
    return history.newest_first(history.snapshots(B.history_rows(spark, sf))).select("repo_id", "label", "n_rows")


@register(
    "history_latest",
    w("hist", f"SELECT repo_id, max({SQL_SNAP}) AS label FROM hist WHERE kind = 'snapshot' GROUP BY repo_id"),
)
def history_latest(spark, sf):
    return history.latest(B.history_rows(spark, sf)).select(
        "repo_id", F.date_format("snapshot_ts", "yyyy-MM-dd_HH-mm-ss").alias("label")
    )


@register(
    "history_retention",
    w("hist", f"""SELECT repo_id, {SQL_SNAP} AS label, row_number() OVER (PARTITION BY repo_id ORDER BY snapshot_ts DESC) <= 10 AS keep
      FROM (SELECT DISTINCT repo_id, snapshot_ts FROM hist WHERE kind = 'snapshot')"""),
)
def history_retention(spark, sf):
    return history.retention(B.history_rows(spark, sf)).select(
        "repo_id", F.date_format("snapshot_ts", "yyyy-MM-dd_HH-mm-ss").alias("label"), "keep"
    )


@register(
    "history_retention_counts",
    w("hist", """SELECT repo_id, least(n, 10) AS n_kept, greatest(n - 10, 0) AS n_deleted FROM (
      SELECT repo_id, count(DISTINCT snapshot_ts) AS n FROM hist WHERE kind = 'snapshot' GROUP BY repo_id)"""),
)
def history_retention_counts(spark, sf):
    return history.retention_counts(history.retention(B.history_rows(spark, sf)))


@register(
    "history_purge",
    w("hist", """, days AS (SELECT repo_id, date_trunc('day', snapshot_ts) AS d, kind FROM hist),
      ranked AS (SELECT repo_id, d, row_number() OVER (PARTITION BY repo_id ORDER BY d DESC) AS rn
        FROM (SELECT DISTINCT repo_id, d FROM days WHERE kind = 'snapshot')),
      rest AS (SELECT repo_id, count(*) AS rows_left FROM days LEFT JOIN ranked USING (repo_id, d) WHERE kind = 'backup' OR rn <= 5 GROUP BY repo_id)
      SELECT repo_id, count(*) FILTER (rn <= 5) AS n_kept, count(*) FILTER (rn > 5) AS n_deleted, any_value(rows_left) AS rows_left
      FROM ranked JOIN rest USING (repo_id) GROUP BY repo_id"""),
)
def history_purge(spark, sf):
    """A history on disk, one snapshot a day, and what is left of it after each repository keeps its newest five."""
    day = F.date_trunc("day", F.col("snapshot_ts"))
    path = scratch_path(spark, "history")
    stores.import_history(B.history_rows(spark, sf).withColumn("snapshot_ts", day), path)
    counts = stores.delete_old_history(spark, path, 5)
    left = stores.load_history(spark, path, "repo_id STRING, kind STRING").groupBy("repo_id").agg(F.count(F.lit(1)).alias("rows_left"))
    return counts.join(left, "repo_id")


@register(
    "history_saved",
    w("docs page_files lab meta", """, snaps AS (
        SELECT repo_id, rel_path, hash, TIMESTAMP '2024-01-01 00:00:00' AS snapshot_ts FROM meta WHERE hash < 'c'
        UNION ALL SELECT repo_id, rel_path, hash, TIMESTAMP '2024-02-01 00:00:00' FROM meta WHERE repo_id < 'src5'),
      ranked AS (SELECT *, dense_rank() OVER (PARTITION BY repo_id ORDER BY snapshot_ts DESC) AS rn FROM snaps)
      SELECT repo_id, rel_path, hash, strftime(snapshot_ts, '%Y-%m-%d') AS day FROM ranked WHERE rn = 1"""),
)
def history_saved(spark, sf):
    """Two saved snapshots, the first of them saved twice; each repository keeps its newest one; the store is read back."""
    path = scratch_path(spark, "history")
    meta = B.stored_metadata(spark, sf)
    stores.save_content_history(meta, path, "2024-01-01")
    stores.save_content_history(meta.filter("hash < 'c'"), path, "2024-01-01")
    stores.save_content_history(meta.filter("repo_id < 'src5'"), path, "2024-02-01")
    stores.delete_old_history(spark, path, 1)
    kept = stores.load_content_history(spark, path)
    return kept.select("repo_id", "rel_path", "hash", F.date_format("snapshot_ts", "yyyy-MM-dd").alias("day"))


@register(
    "stream_state",
    w("", """landed AS (SELECT 'u' || user_id AS repo_id, event_type || '.json' AS rel_path, ts, md5(props) AS hash, event_id % 2 AS part FROM events),
      newest AS (SELECT * FROM landed QUALIFY row_number() OVER (
        PARTITION BY repo_id, rel_path, part ORDER BY ts DESC NULLS LAST, hash DESC NULLS LAST) = 1),
      a AS (SELECT * FROM newest WHERE part = 0), b AS (SELECT * FROM newest WHERE part = 1)
      SELECT repo_id, rel_path, CASE WHEN later THEN h1 ELSE h0 END AS hash,
        strftime(CASE WHEN later THEN t1 ELSE t0 END, '%Y-%m-%d %H:%M:%S') AS last_updated
      FROM (SELECT repo_id, rel_path, a.hash AS h0, b.hash AS h1, a.ts AS t0, b.ts AS t1, a.part IS NULL
          OR (b.part IS NOT NULL AND coalesce(b.ts >= a.ts, true) AND b.hash IS DISTINCT FROM a.hash) AS later
        FROM a FULL JOIN b USING (repo_id, rel_path))"""),
)
def stream_state(spark, sf):
    """Events as files that land twice: user = repository, event type = path, properties = content. The state after both runs."""
    home = scratch_path(spark, "stream")
    landed = B.table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo_id"),
        F.concat("event_type", F.lit(".json")).alias("rel_path"),
        F.col("ts").cast("timestamp").alias("mtime"),
        F.col("props").cast("binary").alias("content"),
        (F.col("event_id") % 2).alias("part"),
    )
    for part in (0, 1):
        landed.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{home}/landing")
        incremental.start(spark, f"{home}/landing", f"{home}/store", f"{home}/state").awaitTermination()
    state = stores.load_metadata(spark, f"{home}/store/content")
    return state.select("repo_id", "rel_path", "hash", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"))


__all__ = ["ORACLES", "QUERIES"]
