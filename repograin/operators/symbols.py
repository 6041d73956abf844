"""Symbol extraction as a job over all files at once, and queries over the symbol table.

Files meet the rules of their language once per file, so consecutive lines share one compiled pattern; a row of lines
is exploded only after that. Nothing here shuffles before the optional final sort. Masks and units are written as
SQL text because nested lambdas then parse in one call.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions import paths
from repograin.functions.constants import SYMBOLS_PER_LINE
from repograin.functions.text import short_tag, table_tag
from repograin.operators.masks import let, lit, mask_by_language, mask_text, newlines_of, rebuild
from repograin.operators.ordered import block_lists, sorted_row_number
from repograin.operators.rules import LINE_RULES, rules_frame
from repograin.schemas import NOTEBOOK
from repograin.session import written

KEY = ["repo_id", "file"]
ORDER = ["type_ord", "line", "pos"]
PLACES = 1 << 31  # positions are pairs of 31-bit numbers
LINE_BLOCK = 4096
_MARK = "\u0003"
_NUMBER = f"{_MARK}\\d+{_MARK}"

# Markup is cut into tag tokens; the rules of markup languages run on tokens instead of lines. Positions are
# written into the text as line numbers between marks, so a token carries its own line and those of its attributes.
_SILENT = r"(?i)<!--[\s\S]*?(?:-->|\z)|<(?:script|style)\b[^>]*>[\s\S]*?(?=</(?:script|style)|\z)"
_TAG_TOKEN = rf"""{_NUMBER}</?[A-Za-z](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
_ATTRIBUTE = (
    rf"""(?<!<)({_NUMBER}(?!<)[^\s=<>"'/{_MARK}]+(?:\s*(?:{_NUMBER})?=\s*(?:{_NUMBER})?"""
    rf"""(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)"""
)
MARKUP_RULES = [
    ("html", "tag", rf"^({_NUMBER}</?[A-Za-z][^\s/>{_MARK}]*)"),
    ("html", "attribute", _ATTRIBUTE),
]


def _rules(files: DataFrame, rules: DataFrame | None) -> DataFrame:
    """One row per language with its rules: as many rows as there are languages, so it is broadcast.

    Lines stay where they are whatever the number of rules of a language.
    """
    listed = rules_frame(files.sparkSession, LINE_RULES + MARKUP_RULES) if rules is None else rules
    rule = F.struct("type_ord", "rule_no", "type", "regex")
    return F.broadcast(listed.groupBy("lang").agg(F.array_sort(F.collect_list(rule)).alias("_rules")))


def _numbered(masked: str) -> str:
    """Lines of a masked text as ``array<struct<no, cell, text>>``."""
    return f"transform(split({masked}, '\\n', -1), (t, i) -> struct(i + 1 as no, cast(null as int) as cell, t as text))"


def _marked(text: str, where: str) -> str:
    """Write the line number in front of every position that matches ``where``."""
    mark = f"concat({lit(_MARK)}, cast(i + 1 as string), {lit(_MARK)})"
    return f"array_join(transform(split({text}, '\\n', -1), (t, i) -> regexp_replace(t, {lit(where)}, {mark})), '\\n')"


def _unmarked(text: str) -> str:
    return f"regexp_replace({text}, {lit(_NUMBER)}, '')"


def _mark_line(text: str) -> str:
    return f"cast(regexp_extract({text}, {lit(f'^{_MARK}([0-9]+){_MARK}')}, 1) as int)"


def _markup_tokens(text: str) -> str:
    """Tag tokens of markup; comments and the bodies of script and style elements are blank."""
    head = "regexp_extract(m, {}, 1)".format(lit(r"(?i)\A(<(?:script|style)\b[^>]*>)"))
    body = newlines_of("substring(m, char_length(h) + 1)")
    masked = rebuild(text, _SILENT, let(head, "h", f"concat(h, {body})"))
    tokens = f"regexp_extract_all({_marked('v', r'(?<!\S)(?=\S)|(?=<)')}, {lit(_TAG_TOKEN)}, 0)"
    return let(masked, "v", f"transform({tokens}, k -> struct({_mark_line('k')} as no, cast(null as int) as cell, k as text))")


def _notebook_lines(text: str) -> str:
    """Lines of the kept code cells in one run; each remembers its cell, counted over all cells."""
    code = "coalesce(array_join(from_json(c.source, 'array<string>'), ''), c.source)"
    cells = (
        f"filter(transform(from_json({text}, '{NOTEBOOK}').cells, "
        f"(c, i) -> struct(i + 1 as cell, c.cell_type as kind, {code} as code)), "
        r"c -> c.kind = 'code' and rlike(c.code, '\\S'))"
    )
    flat = (
        f"flatten(transform({cells}, c -> transform(split({mask_text('c.code', 'python')}, '\\n', -1), "
        "t -> struct(c.cell as cell, t as text))))"
    )
    return f"transform({flat}, (l, i) -> struct(i + 1 as no, l.cell as cell, l.text as text))"


def _blocks(text: str, tag: str) -> str:
    """Blocks ``<tag ...>...</tag>`` as ``array<struct<base, head, body>>``; ``base`` is the line where the tag ends."""
    whole = lit(rf"(?is){_NUMBER}<{tag}\b[^>]*>.*?</{tag}>")
    head = "regexp_extract(m, {}, 1)".format(lit(rf"(?is)(<{tag}\b[^>]*>)"))
    body = "regexp_extract(m, {}, 1)".format(lit(rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>\z"))
    found = f"regexp_extract_all({_marked(text, rf'(?i)(?=<{tag}\b)')}, {whole}, 0)"
    base = f"{_mark_line('m')} - 1 + char_length({newlines_of(head)})"
    return f"transform({found}, m -> struct({base} as base, {head} as head, {_unmarked(body)} as body))"


def _unit(lang: str, block: str, base: str, lines: str) -> str:
    return f"struct({lang} as lang, {block} as block, {base} as base, {lines} as lines)"


def _component_units(text: str, strict: bool) -> str:
    """Script blocks and the first template block of a single-file component."""
    wanted = r"""(?i)^<script\s+lang\s*=\s*["'](\w+)["']""" if strict else r"""(?i)\slang\s*=\s*["'](\w+)["']"""
    typed = f"lower(regexp_extract(b.head, {lit(wanted)}, 1)) in ('ts', 'typescript')"
    script = (
        f"if({typed}, {_unit(lit('typescript'), lit('script'), 'b.base', _numbered(mask_text('b.body', 'typescript')))}, "
        f"{_unit(lit('javascript'), lit('script'), 'b.base', _numbered(mask_text('b.body', 'javascript')))})"
    )
    template = _unit(lit("html"), lit("template"), "b.base", _markup_tokens("b.body"))
    return (
        f"concat(transform({_blocks(text, 'script')}, b -> {script}), "
        f"transform(slice({_blocks(text, 'template')}, 1, 1), b -> {template}))"
    )


def name_sql(lang: str, kind: str, match: str, line_no: str) -> tuple[str, str]:
    """Line and clean name of a match: markup matches carry their own line, keys of JSON lose their quotes."""
    line = f"if({lang} = 'html', {_mark_line(match)}, {line_no})"
    name = (
        f"case when {lang} = 'html' and {kind} = 'tag' then regexp_extract({match}, '</?(.*)$', 1) "
        f"when {lang} = 'html' then {_unmarked(match)} "
        f"when {lang} = 'json' then trim(both {lit(chr(34))} from {match}) else {match} end"
    )
    return line, name


def units_sql(text: str, ext: str, lang: str, strict: bool = False) -> str:
    """Units of one file as ``array<struct<lang, block, base, lines>>``."""
    nothing = "cast(null as string)"
    return f"""case {ext}
        when '.ipynb' then array({_unit(lit("python"), nothing, "0", _notebook_lines(text))})
        when '.vue' then {_component_units(text, strict)}
        else array(if({lang} = 'html', {_unit(lang, nothing, "0", _markup_tokens(text))},
          {_unit(lang, nothing, "0", _numbered(mask_by_language(text, lang)))})) end"""


def extract_symbols(
    files: DataFrame, rules: DataFrame | None = None, recursive: bool = True, strict: bool = False
) -> DataFrame:
    """All symbols of ``(repo_id, rel_path, text)``, whatever the file kind, in one pass over the texts.

    A file becomes one or more units (a plain text, a notebook, the blocks of a component) of one language each;
    units meet the broadcast rules of their language, and only matches are exploded into rows. Nothing shuffles.
    A ``lang`` column overrides the suffix lookup; ``strict`` reads a script language only as first attribute.

    Generators get expressions, not columns: for a plain column the optimizer would add a size filter and push
    the whole masking expression into it a second time.
    """
    if not recursive:
        files = files.filter(~F.col("rel_path").contains("/"))
    given = "lang" in files.columns
    known = files.select(
        "repo_id",
        "rel_path",
        (F.col("lang") if given else paths.grammar_language("rel_path")).alias("lang"),
        (F.lit("") if given else paths.suffix("rel_path")).alias("ext"),
        "text",
    ).filter(F.col("lang").isNotNull())
    per_unit = known.select("repo_id", F.col("rel_path").alias("file"), F.expr(f"inline({units_sql('text', 'ext', 'lang', strict)})"))
    ruled = per_unit.join(_rules(files, rules), "lang").select(*KEY, "lang", "block", "base", "lines", F.explode("_rules").alias("_r"))
    lines = ruled.select(
        *KEY, "lang", "block", "base", "_r.type", "_r.type_ord", "_r.rule_no", "_r.regex",
        F.posexplode(F.coalesce("lines", F.array())).alias("_i", "_l"),
    )
    hits = lines.select(
        *KEY, "lang", "block", "base", "type", "type_ord", "rule_no", "_i",
        F.col("_l.no").alias("_no"), F.col("_l.cell").alias("cell"),
        F.posexplode(F.regexp_extract_all(F.col("_l.text"), F.col("regex"), F.lit(1))).alias("_hit", "_name"),
    )
    line_sql, name_sql_text = name_sql("lang", "type", "_name", "_no")
    line, name = F.expr(line_sql) + F.col("base"), F.expr(name_sql_text)
    markup = F.col("lang") == "html"
    place = (
        F.when(markup & (F.col("type") == "tag"), F.col("_i").cast("bigint"))
        .when(markup, F.col("_i").cast("bigint") * PLACES + F.col("_hit"))
        .otherwise(F.col("_hit").cast("bigint") * PLACES + F.col("rule_no"))
    )
    return hits.select(
        *KEY, line.cast("int").alias("line"), "type", name.alias("name"), "type_ord", place.alias("pos"), "cell", "block"
    ).filter(F.col("name") != "")


def symbols_by_rule(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Symbols of the line-rule languages only."""
    return extract_symbols(files.filter(~paths.suffix("rel_path").isin(".ipynb", ".vue", ".html", ".htm")), rules)


def notebook_symbols(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Python symbols of notebook documents; ``cell`` counts all cells, lines run over the kept code cells.

    Broken JSON yields no rows. Source may be a string or a list of strings.
    """
    return extract_symbols(files.filter(paths.suffix("rel_path") == ".ipynb"), rules)


def component_symbols(files: DataFrame, rules: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Symbols of single-file components: every script block, the first template block."""
    return extract_symbols(files.filter(paths.suffix("rel_path") == ".vue"), rules, strict=strict)


def markup_symbols(files: DataFrame) -> DataFrame:
    """Tags (opening and closing) and attributes (whole text ``k="v"``) of HTML files."""
    return extract_symbols(files.withColumn("lang", F.lit("html")))


def sort_symbols(symbols: DataFrame) -> DataFrame:
    """Total order by file and line; ties by declared type, then position.

    A range sort reads its input twice (sample, then sort), so the rows are written first: texts are parsed once.
    """
    return written(symbols, "symbols").orderBy("repo_id", "file", "line", "type_ord", "pos")


def ranked_symbols(symbols: DataFrame) -> DataFrame:
    """``place`` of every symbol in the total order of ``sort_symbols``, from 1."""
    return sorted_row_number(symbols, ["repo_id", "file", "line", "type_ord", "pos"], "place")


def symbol_sample(symbols: DataFrame, n: int = 5) -> DataFrame:
    """First rows of the total order (a top-n, no sort of the whole table)."""
    return symbols.orderBy("repo_id", "file", "line", "type_ord", "pos").limit(n)


def symbols_by_file(symbols: DataFrame) -> DataFrame:
    """Per file: symbol count, line span and counts per kind (names stay rows; see ``file_profile``)."""
    return symbols.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_symbols"),
        F.min("line").alias("first_line"),
        F.max("line").alias("last_line"),
        F.countDistinct("type").alias("n_types"),
    )


def grouped_symbols(symbols: DataFrame, per_row: int = SYMBOLS_PER_LINE) -> DataFrame:
    """Symbols listed by base name, files of one name merged: ``repo_id, name, part, n_symbols, symbols``.

    ``symbols`` is an array of ``file, line, type, name`` in the total order; a name with more than ``per_row`` symbols
    has further parts, so no row grows with the table. The order is found by slices, not by a window over a name.
    """
    order = ["repo_id", "base", "file", "line", "type_ord", "pos"]
    placed = sorted_row_number(symbols.withColumn("base", paths.base_name("file")), order, "_n")
    placed = written(placed.select("repo_id", "base", "_n", "file", "line", "type", "name"), "grouped-symbols")
    first = placed.groupBy("repo_id", "base").agg(F.min("_n").alias("_first"))
    listed = F.struct("_n", "file", "line", "type", "name")
    return (
        placed.join(first, ["repo_id", "base"])
        .groupBy("repo_id", "base", F.floor((F.col("_n") - F.col("_first")) / per_row).cast("bigint").alias("part"))
        .agg(F.count(F.lit(1)).alias("n_symbols"), F.array_sort(F.collect_list(listed)).alias("_s"))
        .select(
            "repo_id",
            F.col("base").alias("name"),
            "part",
            "n_symbols",
            F.transform("_s", lambda s: F.struct(s["file"].alias("file"), s["line"].alias("line"), s["type"].alias("type"), s["name"].alias("name"))).alias("symbols"),
        )
    )


def file_profile(symbols: DataFrame) -> DataFrame:
    """Structural profile: functions, classes, variables and other symbols per file."""
    main = ["function", "class", "variable"]
    return symbols.groupBy(*KEY).agg(
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in main],
        F.count_if(~F.col("type").isin(main)).alias("n_other"),
    )


def profile_names(symbols: DataFrame, per_row: int = SYMBOLS_PER_LINE) -> DataFrame:
    """Names per file and type in line order, in rows of at most ``per_row`` names."""
    lists = block_lists(symbols, [*KEY, "type"], "line", ["line", "pos"], F.col("name"), per_row, LINE_BLOCK)
    return lists.withColumnRenamed("values", "names")


def delimited_lines(files: DataFrame, delimiter: str = "$$") -> DataFrame:
    """Lines per file and how many start inside a delimited body (an odd number of delimiters above them).

    The text is cut at the delimiters and every second piece marks the lines it starts, so no window is needed.
    """
    cut = f"split(text, {lit(re.escape(delimiter))}, -1)"
    marked = F.expr(
        f"array_join(transform({cut}, (p, i) -> if(i % 2 = 1, replace(p, '\\n', concat('\\n', {lit(_MARK)})), p)), "
        f"{lit(delimiter)})"
    )
    return files.select("repo_id", "rel_path", F.split(marked, "\n", -1).alias("_l")).select(
        "repo_id",
        "rel_path",
        F.size("_l").alias("n_lines"),
        F.size(F.filter("_l", lambda line: line.startswith(_MARK))).alias("n_inside"),
    )


def symbol_totals(symbols: DataFrame, condition: Column) -> DataFrame:
    """Filtered against total, per repository."""
    return symbols.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(condition).alias("n_filtered")
    )


def type_tags(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("type").agg(F.count(F.lit(1)).alias("n_symbols")).select(
        "type", short_tag("type").alias("stored_tag"), table_tag("type").alias("table_tag"), "n_symbols"
    )


__all__ = [
    "LINE_RULES", "component_symbols", "extract_symbols", "file_profile", "markup_symbols", "notebook_symbols",
    "profile_names", "sort_symbols", "symbol_sample", "symbol_totals", "symbols_by_file", "symbols_by_rule",
    "type_tags",
]
