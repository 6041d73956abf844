"""Shell globs as regular expressions.

A star crosses ``/`` as in ``fnmatch``. The ignore rules close every match over the folder tree, which folds
into the regular expression itself: a path is hit when one of its leading sub-paths, or one of its components,
matches. So one ``rlike`` on the whole path replaces a loop over patterns and parents.
"""

from __future__ import annotations

from collections.abc import Iterable

META = set("*?[")
_QUOTE = set("\\^$.|?*+()[]{}-&#~")


def _quote(ch: str) -> str:
    return "\\" + ch if ch in _QUOTE else ch


def _char_class(pattern: str, start: int) -> tuple[str, int] | None:
    """Translate ``[...]`` that opens at ``start``; None when it is never closed (then ``[`` is plain)."""
    end = start + 1
    if pattern[end : end + 1] == "!":
        end += 1
    if pattern[end : end + 1] == "]":
        end += 1
    end = pattern.find("]", end)
    if end < 0:
        return None
    body = pattern[start + 1 : end]
    negated = body.startswith("!")
    body = body[1:] if negated else body
    items: list[str] = []
    i = 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            if low <= high:
                items.append(f"{_quote(low)}-{_quote(high)}")
            i += 3
        else:
            items.append(_quote(body[i]))
            i += 1
    if not items:
        return ("." if negated else "(?!)"), end + 1
    return f"[{'^' if negated else ''}{''.join(items)}]", end + 1


def glob_regex(pattern: str, within_component: bool = False) -> str:
    """Unanchored regular expression for one glob; inside a component nothing may match ``/``."""
    guard = "(?!/)" if within_component else ""
    anything = "[^/]*" if within_component else ".*"
    out: list[str] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            if not out or out[-1] != anything:
                out.append(anything)
        elif ch == "?":
            out.append(guard + ".")
        elif ch == "[" and (found := _char_class(pattern, i)):
            out.append(guard + found[0])
            i = found[1]
            continue
        else:
            out.append(_quote(ch))
        i += 1
    return "".join(out)


def any_of(regexes: Iterable[str]) -> str | None:
    unique = list(dict.fromkeys(regexes))
    return "(?:" + "|".join(unique) + ")" if unique else None


def prefix_closure(patterns: Iterable[str]) -> str | None:
    """Hits a path when it, or any leading sub-path of it, matches one of the globs."""
    body = any_of(glob_regex(p) for p in patterns)
    return None if body is None else rf"(?s)\A{body}(?:/.*)?\z"


def component_closure(patterns: Iterable[str], extra_regexes: Iterable[str] = ()) -> str | None:
    """Hits a path when any one component of it matches one of the globs."""
    # A glob that needs a slash can never equal a single component.
    inner = [glob_regex(p, within_component=True) for p in patterns if "/" not in p]
    body = any_of([*inner, *extra_regexes])
    return None if body is None else rf"(?s)(?:\A|/){body}(?:/|\z)"
