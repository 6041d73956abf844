"""SQL-callable forms for ad-hoc queries, as temporary SQL functions (no Python runs in them).

``symbols_of(path, text)`` returns the symbols of one text as an array:

    select rel_path, inline(coalesce(found, array()))
    from (select rel_path, symbols_of(rel_path, text) as found from files)

(the ``coalesce`` keeps the optimizer from evaluating the array a second time in a size filter).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from repograin.functions.constants import EXT_LANG
from repograin.operators.masks import lit
from repograin.operators.rules import LINE_RULES
from repograin.operators.symbols import MARKUP_RULES, name_sql, units_sql

SUFFIX = "regexp_extract(substring_index({p}, '/', -1), '^.+(\\\\.[^.]+)$', 1)"


def _rules_literal() -> str:
    """The rule table as one constant map from language to its rules."""
    by_lang: dict[str, list[str]] = {}
    for lang, kind, regex in LINE_RULES + MARKUP_RULES:
        by_lang.setdefault(lang, []).append(f"struct({lit(kind)} as type, {lit(regex)} as rx)")
    entries = ", ".join(f"{lit(lang)}, array({', '.join(rules)})" for lang, rules in by_lang.items())
    return f"map({entries})"


def register(spark: SparkSession) -> None:
    """Create the temporary functions in the session."""
    ext = SUFFIX.format(p="path")
    langs = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in EXT_LANG.items())
    spark.sql(
        f"create or replace temporary function grammar_language(path string) returns string "
        f"return try_element_at(map({langs}), {ext})"
    )
    spark.sql(f"create or replace temporary function file_suffix(path string) returns string return {ext}")
    line, name = name_sql("u.lang", "r.type", "n", "l.no")
    per_line = f"transform(regexp_extract_all(l.text, r.rx, 1), n -> struct({line} + u.base as line, r.type as type, {name} as name, l.cell as cell, u.block as block))"
    per_rule = f"flatten(transform(coalesce(u.lines, array()), l -> {per_line}))"
    per_unit = f"flatten(transform(coalesce(try_element_at({_rules_literal()}, u.lang), array()), r -> {per_rule}))"
    units = units_sql("text", ext, f"try_element_at(map({langs}), {ext})")
    spark.sql(
        "create or replace temporary function symbols_of(path string, text string) "
        "returns array<struct<line: int, type: string, name: string, cell: int, block: string>> "
        f"return filter(flatten(transform({units}, u -> {per_unit})), s -> s.name <> '')"
    )
