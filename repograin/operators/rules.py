"""Extraction rules: per language, which parts of a text are masked and which line patterns name a symbol.

Rules are data. ``LINE_RULES`` holds ``(lang, type, regex)``; the first capturing group is the name and an empty
name is dropped. Rules run on masked text (see ``masks.py``): comments are blank, string literals are empty and a
parenthesised group without braces is the single character ``PAREN``; in Java, ``MEMBER`` marks where members begin.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from repograin.schemas import LANG_RULES

PAREN = "\u0002"
MEMBER = "\u000b"  # white space for all rules that do not ask for it
_OPEN = f"[({PAREN}]"
_JS_NAME = r"[A-Za-z_$][\w$]*+"
_CSHARP = "public|private|protected|internal|static|virtual|override|abstract|async|sealed|partial|extern|unsafe|readonly"
_KOTLIN = (
    "public|private|protected|internal|abstract|open|final|sealed|data|inner|enum|annotation|value|inline|"
    "override|suspend|operator|infix|tailrec|external"
)
_SWIFT = "public|private|fileprivate|internal|open|final|static|override|mutating|indirect|convenience|required"
_SCALA = "case|abstract|sealed|final|implicit|lazy|private|protected|override|inline"
_JAVA = "public|private|protected|static|final|abstract|synchronized|native|strictfp|default|transient|volatile|sealed"
_TS_MEMBER = "public|private|protected|static|async|override|readonly|get|set"
_PY_BLOCK = "if|elif|else|while|for|with|try|except|finally|def|class|lambda|return|async"
_NOT_TYPE = "return|new|else|throw|await|using|namespace|class|struct|interface|enum|goto|case|typedef|package|import"

# (language, symbol type, pattern). Types keep this order inside a language. Repeated groups are possessive
# throughout: the engine then loops instead of recursing, so a very long line can not overflow the stack.
LINE_RULES: list[tuple[str, str, str]] = [
    ("python", "function", r"(?:^|[;:])\s*(?:async\s+)?def\s+([^\W\d]\w*)"),
    ("python", "class", r"(?:^|[;:])\s*class\s+([^\W\d]\w*)"),
    (
        "python",
        "variable",
        rf"(?:^|;|^\s*(?:async\s+)?(?:if|elif|else|while|for|with|try|except|finally|def|class)\b[^:]*:|"
        rf"^\s*\w+[.{PAREN}][\w.{PAREN}]*\s*=(?!=)|\G)\s*(?!(?:{_PY_BLOCK})\b)"
        r"([^\W\d]\w*+)\s*(?:=(?!=)|:\s*[^\s=:;][^=;]*(?:=(?!=)|$))",
    ),
    ("javascript", "function", rf"(?:^|[;{{}}])\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+({_JS_NAME})"),
    ("javascript", "class", rf"(?:^|[;{{}}])\s*(?:export\s+(?:default\s+)?)?class\s+({_JS_NAME})"),
    (
        "javascript",
        "variable",
        rf"(?:\b(?:const|let|var)\s+|(?!^)\G\s*(?:=[^,;(){{}}\[\]]*)?,\s*)(?!enum\b)({_JS_NAME})(?!\s+(?:of|in)\b)",
    ),
    ("typescript", "function", rf"(?:^|[;{{}}])\s*(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:async\s+)?function\s+({_JS_NAME})(?![^{{}}]*;\s*$)"),
    (
        "typescript",
        "function",
        rf"(?:^|[{{}},;])\s*(?:@\w+\S*\s+)*+(?:(?:{_TS_MEMBER})\s+)*+\*?\s*"
        rf"(?!(?:if|for|while|switch|catch|with|function|return|super|{_TS_MEMBER})\b\s*{_OPEN})"
        rf"#?({_JS_NAME})\s*(?:<[^>]*>)?\s*{PAREN}\s*(?::\s*[^{{;=]+)?\{{",
    ),
    (
        "typescript",
        "function",
        rf"\b(?:const|let|var)\s+({_JS_NAME})\s*(?::[^=]+)?=\s*(?:async\s+)?function\b(?!\s*\*)",
    ),
    (
        "typescript",
        "class",
        rf"(?:^|[;{{}}])\s*(?:@\w+\S*\s+)*+(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?class\s+"
        rf"(?!extends\b|implements\b)({_JS_NAME})",
    ),
    (
        "typescript",
        "variable",
        rf"(?:\b(?:const|let|var)\s+|(?!^)\G\s*(?::\s*[\w.|\[\] ]+(?:<[^=;]*>)?[\w.|\[\] ]*)?(?:=[^,;(){{}}\[\]]*)?,\s*)"
        rf"(?!enum\b)({_JS_NAME})(?!\s+(?:of|in)\b)",
    ),
    (
        "typescript",
        "component",
        rf"\b(?:const|let|var)\s+({_JS_NAME})\s*(?::[^=]*+(?:=>[^=]*+)*+)?=\s*(?:async\s*)?(?:<[^>]*>\s*)?"
        rf"(?:{PAREN}|\([^;]*?\)|{_JS_NAME})\s*(?::[^={{]+)?=>",
    ),
    (
        "c",
        "function",
        rf"^\s*(?!(?:{_NOT_TYPE}|if|while|for|switch|do|sizeof)\b)"
        rf"(?:[A-Za-z_]\w*+[\s*&]++(?=[A-Za-z_]))++([A-Za-z_]\w*+)\s*{PAREN}\s*(?:\{{|;|$)",
    ),
    (
        "c",
        "variable",
        r"(?:^\s*(?!(?:return|else|goto|case|typedef|break|continue|do)\b|(?:struct|union|enum)\s+\w+\s*;)(?:[A-Za-z_]\w*+\s++(?=[A-Za-z_]))++|"
        r"(?!^)\G\s*,\s*)([A-Za-z_]\w*+)(?=\s*[;,])",
    ),
    (
        "java",
        "function",
        rf"(?:^|[;{{}}])\s*(?:@\w+{PAREN}?\s*)*+(?:(?:{_JAVA})\s+)*+(?:<[^>]*>\s*)?(?!(?:{_NOT_TYPE}|{_JAVA}|record)\b)"
        rf"[A-Za-z_][\w.]*(?:<[^;={PAREN}]*>)?(?:\[\])*+\s+([A-Za-z_]\w*)\s*{PAREN}\s*(?:throws\s[^{{;]+)?(?:\{{|;|$)",
    ),
    ("java", "class", rf"(?:^|[;{{}}])\s*(?:@\w+{PAREN}?\s*)*+(?:(?:{_JAVA})\s+)*+class\s+([A-Za-z_]\w*)"),
    (
        "java",
        "variable",
        rf"(?:{MEMBER}\s*(?:(?:@\w+{PAREN}?|{_JAVA})\s+)*+"
        rf"(?!(?:{_NOT_TYPE}|{_JAVA})\b)[A-Za-z_$][\w$.]*(?:<[^;={PAREN}]*>)?(?:\s*\[\s*\])*+\s+|"
        rf"(?!^)\G\s*(?:\[\s*\]\s*)*+(?:=[^,;{{}}]*)?,\s*)([A-Za-z_$][\w$]*+)(?=\s*(?:\[\s*\]\s*)*+[=;,])",
    ),
    ("json", "key", r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?=\s*:)|"[^"\\]*+(?:\\.[^"\\]*+)*+"'),
    ("markdown", "heading", r"^ {0,3}#{1,6}[ \t]+(?!#+[ \t]*$)(.+?)(?:[ \t]+#+)?[ \t]*\r?$"),
    ("go", "function", rf"^func\s+(?:(?:{PAREN}|\([^)]*\))\s*)?([A-Za-z_]\w*)"),
    ("go", "class", r"^\s*type\s+([A-Za-z_]\w*)"),
    (
        "go",
        "variable",
        r"(?:^\s*(?:\}\s*else\s+)?(?:(?:if|for|switch)\s+)?|[;{]\s*|\G\s*,\s*)([A-Za-z_]\w*+)"
        r"(?=(?:\s*,\s*[A-Za-z_]\w*)*+\s*:=(?!\s*range\b))",
    ),
    (
        "rust",
        "function",
        rf"(?:^|[;{{}}])\s*(?:pub(?:{PAREN}|\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern|default)\s+)*+"
        r"fn\s+([A-Za-z_]\w*+)(?=[^;{]*(?:\{|$))",
    ),
    (
        "rust",
        "class",
        rf"(?:^|[;{{}}])\s*(?:pub(?:{PAREN}|\([^)]*\))?\s+)?(?:unsafe\s+)?(?:struct|enum|trait)\s+([A-Za-z_]\w*)",
    ),
    ("rust", "variable", r"(?:^|[;{}])\s*let\s+(?:mut\s+)?([a-z_]\w*)\s*[:=;]"),
    ("ruby", "function", r"(?:^|;)\s*(?:(?:private|protected|public|module_function)\s+)?def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)"),
    ("ruby", "class", r"(?:^|;)\s*(?:class|module)\s+([A-Z]\w*)"),
    ("php", "function", r"(?:^|[;{}])\s*(?:(?:public|private|protected|static|abstract|final)\s+)*+function\s+&?([A-Za-z_]\w*)\s*" + _OPEN),
    ("php", "class", r"(?:^|[;{}])\s*(?:(?:abstract|final|readonly)\s+)*+class\s+([A-Za-z_]\w*)"),
    (
        "c_sharp",
        "function",
        rf"(?:^|[;{{}}])\s*(?:\[[^\]]*\]\s*)*+(?:(?:{_CSHARP})\s+)*+(?!(?:{_CSHARP}|{_NOT_TYPE}|record|delegate|event|var)\b)"
        rf"[A-Za-z_][\w<>\[\],.?]*\s+([A-Za-z_]\w*)\s*(?:<[^>]*>)?{_OPEN}",
    ),
    ("c_sharp", "class", rf"(?:^|[;{{}}])\s*(?:\[[^\]]*\]\s*)*+(?:(?:{_CSHARP})\s+)*+(?:class|interface|struct)\s+([A-Za-z_]\w*)"),
    ("kotlin", "function", rf"(?:^|[;{{}}])\s*(?:(?:{_KOTLIN})\s+)*+fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?([A-Za-z_]\w*)\s*{_OPEN}"),
    ("kotlin", "class", rf"(?:^|[;{{}}])\s*(?:(?:{_KOTLIN})\s+)*+(?:class|interface|object)\s+([A-Za-z_]\w*)"),
    ("swift", "function", rf"(?:^|[;{{}}])\s*(?:@\w+\s+)*+(?:(?:{_SWIFT}|class)\s+)*+func\s+([A-Za-z_]\w*).*\{{"),
    ("swift", "class", rf"(?:^|[;{{}}])\s*(?:@\w+\s+)*+(?:(?:{_SWIFT})\s+)*+(?:class|struct|enum|protocol|actor)\s+(?!func\b|var\b)([A-Za-z_]\w*)"),
    ("scala", "function", rf"(?:^|[;{{}}])\s*(?:(?:{_SCALA})\s+)*+def\s+([A-Za-z_]\w*)[^=]*="),
    ("scala", "class", rf"(?:^|[;{{}}])\s*(?:(?:{_SCALA})\s+)*+(?:class|trait|object)\s+([A-Za-z_]\w*)"),
    ("bash", "function", r"(?:^|;)\s*(?:function\s+([A-Za-z_][\w-]*))"),
    ("bash", "function", r"(?:^|;)\s*([A-Za-z_][\w-]*)\s*\(\s*\)"),
    (
        "bash",
        "variable",
        r"(?:(?:^|;|&&|\|\||\b(?:then|do|else)\s)\s*(?:(?:local|export|declare|readonly|typeset)\s+(?:-\w+\s+)*+)?|"
        r"""(?!^)\G(?:"[^"]*"|'[^']*'|[^\s;|&"'])*+\s+)([A-Za-z_]\w*)\+?=(?!=)""",
    ),
    ("yaml", "key", r"""^\s*(?:-\s+)*+("[^"]*"|'[^']*'|[^\s#:'"\-{\[&*!|>%@`][^:#]*?)\s*:(?:\s|$)"""),
    ("toml", "key", r"(?:^|[{,])\s*([A-Za-z0-9_-]+)\s*=(?!=)"),
    ("sql", "table", r"(?i)\b(?:table|function|from|join|references|into|update|view)\s+(?:(?:if\s+not\s+exists|if\s+exists|only)\s+)?(?:\w+\.)?([A-Za-z_]\w*)"),
]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Rule table with ``type_ord`` (declared order of the types of a language) and ``rule_no``."""
    rows = []
    types: dict[str, list[str]] = {}
    seen: dict[tuple[str, str], int] = {}
    for lang, kind, regex in rules or LINE_RULES:
        order = types.setdefault(lang, [])
        if kind not in order:
            order.append(kind)
        seen[lang, kind] = seen.get((lang, kind), -1) + 1
        rows.append((lang, kind, order.index(kind), regex, seen[lang, kind]))
    columns = ["lang", "type", "type_ord", "regex", "rule_no"]
    return spark.createDataFrame(pd.DataFrame(rows, columns=columns), LANG_RULES)
