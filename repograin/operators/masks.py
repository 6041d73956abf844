"""Masking: hide comments, literals and nested groups before line rules run, without moving any line.

Everything works inside one row with built-in string functions; a text is never split over rows for this. The
expressions are written as SQL text: nested lambdas parse in one call.
"""

from __future__ import annotations

from repograin.operators.rules import MEMBER, PAREN

ROUNDS = 4  # rounds that most texts need; what is deeper goes on until a round changes nothing

_DQ = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SQ = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_BACKTICK = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
_CHAR = r"'(?:[^'\\\n]|\\(?:u\{[0-9A-Fa-f_]++\}|[uU][0-9A-Fa-f]++|x[0-9A-Fa-f]++|[0-7]{1,3}|[^\n]))'"  # escapes by their forms
_TRIPLE = r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\''
_SLASHES = r"//[^\n]*"
_BLOCK = r"/\*[\s\S]*?(?:\*/|\z)"  # one that never closes runs to the end: a failed search per opener would be quadratic
_HASH = r"#[^\n]*"

# Tokens of a language that cannot hold declarations. Alternatives are tried in this order.
TOKENS = {
    "python": f"{_TRIPLE}|{_DQ}|{_SQ}|{_HASH}",
    "javascript": f"{_DQ}|{_SQ}|{_BACKTICK}|{_SLASHES}|{_BLOCK}",
    "typescript": f"{_DQ}|{_SQ}|{_BACKTICK}|{_SLASHES}|{_BLOCK}",
    "c": f"{_DQ}|{_CHAR}|{_SLASHES}|{_BLOCK}",
    "java": f"{_TRIPLE}|{_DQ}|{_CHAR}|{_SLASHES}|{_BLOCK}",
    "go": f"{_DQ}|{_CHAR}|{_BACKTICK}|{_SLASHES}|{_BLOCK}",
    "rust": f"{_DQ}|{_CHAR}|{_SLASHES}|{_BLOCK}",
    "ruby": f"(?m:^=begin\\b[\\s\\S]*?^=end\\b)|{_DQ}|{_SQ}|{_HASH}",
    "php": f"{_DQ}|{_SQ}|{_SLASHES}|#(?!\\[)[^\\n]*|{_BLOCK}",
    "c_sharp": f'@"[^"]*+(?:""[^"]*+)*+"|{_DQ}|{_CHAR}|{_SLASHES}|{_BLOCK}',
    "kotlin": f"{_TRIPLE}|{_DQ}|{_CHAR}|{_SLASHES}|{_BLOCK}",
    "swift": f"{_TRIPLE}|{_DQ}|{_SLASHES}|{_BLOCK}",
    "scala": f"{_TRIPLE}|{_DQ}|{_CHAR}|{_SLASHES}|{_BLOCK}",
    "bash": r"(?m:^[ \t]*#[^\n]*)|(?<=[\s;])#[^\n]*",
    "toml": f"{_TRIPLE}|{_DQ}|'[^'\\n]*+'|{_HASH}",
    "sql": f"\\$\\$[\\s\\S]*?\\$\\$|'[^']*+'|--[^\\n]*|{_BLOCK}",
    "markdown": r"(?m:^ {0,3}(?:```|~~~)[\s\S]*?(?:^ {0,3}(?:```|~~~)[ \t]*$|\z))|<!--[\s\S]*?(?:-->|\z)",
    "yaml": r"(?m:^[ \t]*#[^\n]*)|(?<=[ \t])#[^\n]*",
}

DEPTH = 8


def nested(opening: str, inner: str, closing: str, depth: int = DEPTH) -> str:
    """Balanced groups up to a depth as one pattern. Possessive loops keep it linear and free of recursion."""
    group = f"{opening}{inner}*+{closing}"
    for _ in range(depth - 1):
        group = f"{opening}(?:{inner}++|{group})*+{closing}"
    return group


# Languages whose groups collapse: any brackets in python, parentheses without statements elsewhere.
# (within one line, over lines)
_ANY = [nested(r"[(\[{]", rf"[^{nl}()\[\]{{}}]", r"[)\]}]") for nl in (r"\n", "")]
_PLAIN = [nested(r"\(", rf"[^{nl}(){{}};]", r"\)") for nl in (r"\n", "")]
COLLAPSE = {
    "python": (*_ANY, r"[(\[{]"),
    **dict.fromkeys(
        ["javascript", "typescript", "c", "java", "go", "rust", "php", "c_sharp", "kotlin", "swift", "scala"],
        (*_PLAIN, r"\([^(){};]*\)"),
    ),
}

# Parameter destructuring ``({a, b})`` and record bodies stand in the way of collapsing or look like variables.
PRELUDE = {
    "javascript": r"(?<=\()\s*\{[^{}();]*\}",
    "typescript": r"(?<=\()\s*\{[^{}();]*\}",
    "c": r"(?:\btypedef\s++)?(?:\b(?:static|const|extern|volatile|register)\s++)*+\b(?:struct|union|enum)\b\s*+\w*+\s*+\{[^{}]*+\}",
}


def lit(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it several times, as ``name``, in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def newlines_of(text: str) -> str:
    return f"if(contains({text}, '\\n'), regexp_replace({text}, {lit('[^\\n]+')}, ''), '')"


def rebuild(text: str, regex: str, replacement: str) -> str:
    """Put ``replacement`` (an expression over ``m``) in place of each match; other texts pass through."""
    rx = lit(regex)
    pieces = (
        f"zip_with(split({text}, {rx}, -1), regexp_extract_all({text}, {rx}, 0), "
        f"(r, m) -> if(m is null, r, concat(r, {replacement})))"
    )
    return f"if(rlike({text}, {rx}), array_join({pieces}, ''), {text})"


def blank_tokens(text: str, regex: str) -> str:
    """Comments become their newlines; string literals become an empty literal plus their newlines."""
    head = f"if(substr(m, 1, 1) in ({lit('@')}, {lit(chr(34))}, {lit(chr(39))}, {lit('`')}), {lit(chr(34) * 2)}, '')"
    return rebuild(text, regex, f"concat({head}, {newlines_of('m')})")


def nesting(text: str, brackets: str) -> str:
    """``top``, how deep the brackets nest (an opener without end counts), and ``d``, how many stay open; in one pass."""
    level = "if(c in ('(', '[', '{'), a.d + 1, greatest(a.d - 1, 0))"
    return (
        f"aggregate(regexp_extract_all({text}, {lit(brackets)}, 0), struct(0 as d, 0 as top), "
        f"(a, c) -> {let(level, 'l', 'struct(l as d, greatest(a.top, l) as top)')})"
    )


def collapse_groups(text: str, one_line: str, any_lines: str, more: str, rounds: int = ROUNDS) -> str:
    """Collapse bracket groups to ``PAREN``, whole nests at once; deeper nests take another round.

    The newlines inside a group move behind the line that closes it, so a declaration whose parameters span
    lines becomes one line and every later line keeps its number. Rounds go on, as far as the nesting of the text asks
    for them, until one finds nothing to collapse.
    """
    to_line_end = any_lines + r"[^\n]*"
    rest_of_line = f"regexp_extract(m, {lit(rf'\A{any_lines}([^\n]*)\z')}, 1)"
    spread = f"concat({lit(PAREN)}, {rest_of_line}, {newlines_of('m')})"

    def once(t: str) -> str:
        return let(f"regexp_replace({t}, {lit(one_line)}, {lit(PAREN)})", "t", rebuild("t", to_line_end, spread))

    first = f"aggregate(sequence(1, {rounds}), {text}, (acc, n) -> if(rlike(acc, {lit(more)}), {once('acc')}, acc))"
    further = (
        f"aggregate(sequence(1, 1 + ceil({nesting('f', r'[()\[\]{}]')}.top / {DEPTH})), struct(f as t, true as go), "
        f"(a, n) -> if(a.go and rlike(a.t, {lit(more)}), {let(once('a.t'), 'u', 'struct(u as t, u <> a.t as go)')}, a), a -> a.t)"
    )
    return let(first, "f", f"if(rlike(f, {lit(more)}), {further}, f)")


# Braces that are dealt with change into other signs, so that each round meets the innermost ones that are left.
_RAW, _DONE, _PLAIN_SIGNS = "{;\x05}", "\x04\x06\x07\x05", "{};}"
_BLOCK_WITH_HEAD = r"(?<![^;{}\x04-\x07])[^;{}\x04-\x07]*+\{[^{}]*+\}"
_HOLDS_FIELDS = rf"\A[^{{]*?(?:\b(?:class|enum|record)\s+[A-Za-z_$][^{{]*|\bnew\s+[^;={{}}]*{PAREN}\s*)\{{"
_MEMBER_START = rf"([{{;\x05](?:\s|@[\w.]++(?:\s*+{PAREN})?)*+)"


def mark_members(text: str) -> str:
    """Write ``MEMBER`` where a member of a class, enum, record or anonymous class may begin, behind its annotations.

    Blocks are met from the inside out, a round for each level: what stands in front of a block tells whether it holds
    fields, and only its own statements are marked. A block that never closes is closed at the end of the text. Other
    rules see ``MEMBER`` as white space.
    """
    done = f"translate(if(rlike(m, {lit(_HOLDS_FIELDS)}), regexp_replace(m, {lit(_MEMBER_START)}, {lit('$1' + MEMBER)}), m), {lit(_RAW)}, {lit(_DONE)})"
    levels = f"aggregate(sequence(1, greatest(1, b.top)), concat(t, repeat('}}', b.d)), (acc, n) -> {rebuild('acc', _BLOCK_WITH_HEAD, done)})"
    marked = let(nesting("t", r"[{}]"), "b", f"translate({levels}, {lit('\x04\x05\x06\x07')}, {lit(_PLAIN_SIGNS)})")
    return let(f"translate({text}, {lit(MEMBER + '\x04\x05\x06\x07')}, '     ')", "t", marked)


def mask_text(text: str, lang: str) -> str:
    """SQL expression for the masked form of a text in a known language."""
    steps = []
    if lang in TOKENS:
        steps.append(lambda t: blank_tokens(t, TOKENS[lang]))
    if lang in PRELUDE:
        # A record's head goes behind its body, next to what is declared with it.
        head = f"concat(regexp_replace(regexp_extract(m, {lit(r'\A([^{]*)')}, 1), {lit(r'\s+')}, ' '), ' ')" if lang == "c" else "''"
        steps.append(lambda t: rebuild(t, PRELUDE[lang], f"concat({newlines_of('m')}, {head})"))
    if lang in COLLAPSE:
        steps.append(lambda t: collapse_groups(t, *COLLAPSE[lang]))
    if lang == "java":
        steps.append(mark_members)
    out = text
    for number, step in enumerate(steps):
        out = let(out, f"s{number}", step(f"s{number}"))
    return out


def mask_by_language(text: str, lang: str) -> str:
    """SQL expression for the masked text by a language column; other languages keep the text."""
    cases = " ".join(
        f"when '{name}' then {mask_text(text, name)}" for name in sorted({*TOKENS, *COLLAPSE, *PRELUDE})
    )
    return f"case {lang} {cases} else {text} end"
