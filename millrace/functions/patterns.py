"""Globs, path terms, excluded paths and search patterns, as regular expressions and predicates.

User patterns keep to the linear-time dialect: no lookaround, no backreference. Expressions that this module writes itself spell character
classes out, as ``\\b`` and ``\\w`` differ between engines.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as part of a word in whole-word searches.
WORD = r"\p{L}\p{Nd}_"
MAX_GLOB, MAX_TERMS, MAX_EXCLUDED = 256, 32, 100


class PatternError(ValueError):
    """A pattern that is refused before a job starts."""


def check_glob(glob: str) -> str:
    """Refuses what can match nothing by mistake: empty, too long, braces, a trailing slash, open or reversed brackets."""
    if not glob.strip():
        raise PatternError("an empty glob matches nothing")
    if len(glob) > MAX_GLOB:
        raise PatternError(f"a glob has at most {MAX_GLOB} characters")
    if "{" in glob or "}" in glob:
        raise PatternError("braces are not alternatives in a glob; give several globs")
    if glob.endswith("/"):
        raise PatternError("a glob names files; end a directory with /*")
    depth = 0
    for i, c in enumerate(glob):
        if c == "[":
            depth = 1
        elif c == "]" and depth:
            depth = 0
        elif depth and c == "-" and 0 < i < len(glob) - 1 and glob[i + 1] != "]" and glob[i - 1] not in "[!" and glob[i - 1] > glob[i + 1]:
            raise PatternError(f"the range {glob[i - 1]}-{glob[i + 1]} is reversed")
    if depth:
        raise PatternError("a bracket is not closed")
    return glob


def glob_regex(glob: str, no_folder: bool = False) -> str:
    """An anchored expression: ``*`` crosses slashes, ``?`` is one character, ``[...]`` and ``[!...]`` are classes.

    With ``no_folder``, stars between two slashes also stand for no folder at all. Each star with the text after it is atomic, which keeps matching nearly linear; an open bracket stands for itself.
    """
    parts: list[str] = [""]
    i = 0
    while i < len(glob):
        c = glob[i]
        if no_folder and (m := re.match(r"/\*+/", glob[i:])):
            parts[-1] += "/(?:.*?/)??"
            i += m.end() - 1
        elif c == "*":
            if i == 0 or glob[i - 1] != "*":
                parts.append("")
        elif c == "?":
            parts[-1] += "."
        elif c == "[" and (end := glob.find("]", i + 1)) > 0:
            body = glob[i + 1 : end]
            negated = body.startswith("!")
            body = body[negated:]
            if not body:
                parts[-1] += "." if negated else "(?!.)."
            else:
                parts[-1] += ("[^" if negated else "[") + re.sub(r"([\\\]\[^&~|])", r"\\\1", body) + "]"
            i = end
        else:
            parts[-1] += re.escape(c)
        i += 1
    if len(parts) == 1:
        return f"^(?s:{parts[0]})$"
    # A segment between stars takes its first place; only the last must reach the end.
    middle = "".join(f"(?>.*?{p})" for p in parts[1:-1] if p)
    return f"^(?s:{parts[0]}{middle}.*{parts[-1]})$"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def split_terms(terms: str | None) -> list[str]:
    """Terms between commas and semicolons, with forward slashes, in lower case."""
    out = [t.strip().replace("\\", "/").lower() for t in re.split("[,;]", terms or "")]
    out = [t for t in out if t]
    if len(out) > MAX_TERMS:
        raise PatternError(f"at most {MAX_TERMS} terms")
    return out


def path_term(path: Column, term: str) -> Column:
    """A term with a star or question mark is a glob on the whole path, any other a part of it; case is ignored."""
    return glob_match(F.lower(path), check_glob(term)) if re.search(r"[*?]", term) else F.contains(F.lower(path), F.lit(term))


def any_term(path: Column, terms: str | None) -> Column:
    parts = split_terms(terms)
    return reduce(or_, (path_term(path, t) for t in parts)) if parts else F.lit(True)


def no_term(path: Column, terms: str | None) -> Column:
    return reduce(and_, (~path_term(path, t) for t in split_terms(terms)), F.lit(True))


def has_extension(path: Column, terms: str | None) -> Column:
    """``.cs``, ``cs`` and ``*.cs`` all mean files that end in ``.cs``."""
    parts = [t.lstrip("*").lstrip(".") for t in split_terms(terms)]
    return reduce(or_, (F.lower(path).endswith("." + p) for p in parts)) if parts else F.lit(True)


def excluded_regex(patterns: list[str]) -> str | None:
    """One alternation over ``'/' || path``; a pattern that starts with neither slash nor star may begin at any directory."""
    if len(patterns) > MAX_EXCLUDED:
        raise PatternError(f"at most {MAX_EXCLUDED} excluded patterns")
    out = []
    for p in patterns:
        p = p.strip().replace("\\", "/")
        check_glob(p)
        body = p if p[0] in "/*" else f"/{p}"
        inner = glob_regex(body, no_folder=True)[len("^(?s:") : -len(")$")]
        out.append(("" if p[0] in "/*" else "(?:.*)") + inner)
    return f"(?is)^(?:{'|'.join(out)})$" if out else None


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns covers the path."""
    regex = excluded_regex(patterns)
    return F.concat(F.lit("/"), path).rlike(regex) if regex else F.lit(False)


#: Escapes that both dialects read alike, outside and inside classes; then those that stand for another form, and the named classes.
_SAME = "dDsSwWaftnr"
_OUTSIDE = "bBAz"
_OTHER = {"v": r"\x0B"}
_CLASSES = {c: rf"\p{{{c.capitalize()}}}" for c in ("alnum", "alpha", "ascii", "blank", "cntrl", "digit", "graph", "lower", "print", "punct", "space", "upper")} | {"xdigit": r"\p{XDigit}", "word": r"\w"}
MAX_REPEAT = 1000


def _escape(pattern: str, i: int, in_class: bool) -> tuple[str, int]:
    """The escape at ``i`` in Java's form, and where it ends."""
    d = pattern[i + 1 : i + 2]
    if not d:
        raise PatternError("the pattern ends in a backslash")
    if m := re.compile(r"x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]{1,6})\})").match(pattern, i + 1):
        return rf"\x{{{m[1] or m[2]}}}", m.end()
    if m := re.compile(r"0[0-7]{0,2}|[1-7][0-7]{1,2}").match(pattern, i + 1):
        return rf"\x{{{int(m[0], 8):x}}}", m.end()
    if m := re.compile(r"([pP])(?:([A-Z])|\{(\^?)(\w+)\})").match(pattern, i + 1):
        name = m[2] or m[4]
        return rf"\{'pP'[(m[1] == 'P') != bool(m[3])]}{{{name if len(name) < 3 else 'Is' + name}}}", m.end()
    if d in "123456789k":
        raise PatternError("backreferences are not supported")
    if d in _OTHER:
        return _OTHER[d], i + 2
    if d in _SAME or (d in _OUTSIDE and not in_class) or (d.isascii() and not d.isalnum()):
        return f"\\{d}", i + 2
    raise PatternError(f"the escape \\{d} is not supported")


def _class(pattern: str, i: int) -> tuple[str, int]:
    """The class that opens at ``i`` in Java's form, and where it ends. A closing bracket right at its start is a member."""
    begin = i
    i += 1
    out = "["
    if pattern[i : i + 1] == "^":
        out, i = "[^", i + 1
    first = i
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and i > first:
            return out + "]", i + 1
        if m := re.compile(r"\[:(\^?)(\w+):\]").match(pattern, i):
            if m[2] not in _CLASSES:
                raise PatternError(f"there is no class [:{m[2]}:]")
            out += re.sub("^(.)([pw])", lambda x: x[1] + x[2].upper(), _CLASSES[m[2]]) if m[1] else _CLASSES[m[2]]
            i = m.end()
        elif c == "\\":
            one, i = _escape(pattern, i, True)
            out += one
        else:
            out += c if c.isalnum() or c == "-" else re.escape(c)
            i += 1
    raise PatternError(f"the class {pattern[begin:]} is not closed")


def java_regex(pattern: str) -> tuple[str, int]:
    """A pattern of the linear-time dialect in the form that Spark's functions take, and the number of its groups.

    Refused are lookaround, backreferences, atomic groups, possessive and doubled repetition, and what no engine could read.
    """
    out, groups, depth, i = "", 0, 0, 0
    repeatable, repeated = False, False  # whether a repetition may follow, and whether one has just been
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("\\Q", i):
            end = pattern.find("\\E", i)
            body = pattern[i + 2 : end if end >= 0 else len(pattern)]
            out, i = out + "".join(re.escape(x) for x in body), end + 2 if end >= 0 else len(pattern)
            repeatable, repeated = repeatable or bool(body), repeated and not body
            continue
        if pattern.startswith("\\E", i):
            i += 2
            continue
        if c == "\\":
            one, i = _escape(pattern, i, False)
            out, repeatable, repeated = out + one, True, False
        elif c == "[":
            one, i = _class(pattern, i)
            out, repeatable, repeated = out + one, True, False
        elif c == "(":
            depth += 1
            m = re.compile(r"\((?:\?(?:(P?<)(\w+)>|([imsU]*(?:-[imsU]+)?)([:)])))?").match(pattern, i)
            if pattern.startswith("(?", i) and len(m[0]) < 3:
                kind = "lookaround is" if re.match(r"\(\?<?[=!]", pattern[i:]) else "atomic groups are" if pattern.startswith("(?>", i) else "backreferences are" if pattern.startswith("(?P=", i) else "this kind of group is"
                raise PatternError(f"{kind} not supported")
            if "U" in (m[3] or ""):
                raise PatternError("the flag U is not supported")
            groups += not m[4]
            depth -= m[4] == ")"
            out, i = out + (f"(?{m[3]}{m[4]}" if m[4] else "("), m.end()
            repeatable, repeated = False, False
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise PatternError("a parenthesis is closed that was not opened")
            out, i, repeatable, repeated = out + c, i + 1, True, False
        elif c in "*+?" or (m := re.compile(r"\{(\d+)(,?)(\d*)\}").match(pattern, i)):
            lazy = c == "?" and repeated
            if not lazy and (not repeatable or repeated):
                raise PatternError(f"nothing to repeat before {pattern[i:]}" if not repeatable else f"a repetition can't be repeated: {pattern[:i + 1]}")
            one = c
            if c == "{":
                low, high = int(m[1]), int(m[3] or m[1])
                if max(low, high) > MAX_REPEAT or high < low:
                    raise PatternError(f"the repetition {m[0]} is out of range")
                one = m[0]
            out, i = out + one, i + len(one)
            repeatable, repeated = not lazy, not lazy
        else:
            out += re.escape(c) if c in "{}]#&~" else c
            repeatable, repeated, i = c not in "|^", False, i + 1
    if depth:
        raise PatternError("a parenthesis is not closed")
    return out, groups


def check_regex(pattern: str, group: int = 0) -> str:
    """The pattern in the form for Spark; refuses what the linear-time dialect lacks and a group that the pattern hasn't."""
    out, groups = java_regex(pattern)
    if not 0 <= group <= min(groups, 9):
        raise PatternError(f"the pattern has {groups} groups")
    return out


def whole_word(pattern: str) -> str:
    """The pattern between characters that are no part of a word."""
    return rf"(?<![{WORD}])(?:{pattern})(?![{WORD}])"


def symbol_regex(symbol: str) -> str:
    return whole_word(r"\Q" + symbol + r"\E")


def names_symbol(content: Column, symbol: str) -> Column:
    """A cheap test for the text first, then the whole-word test."""
    return F.contains(content, F.lit(symbol)) & content.rlike(symbol_regex(symbol))


def occurrences(content: Column, pattern: str) -> Column:
    return F.regexp_count(content, F.lit(pattern)).cast("long")


def has_words(content: Column, query: str, whole_tokens: bool = False) -> Column:
    """Every word of the query occurs on the line, ignoring case; with ``whole_tokens`` every piece of letters, digits and underscores is a token."""
    low = F.lower(content)
    out = reduce(and_, (F.contains(low, F.lit(w)) for w in query.lower().split()), F.lit(True))
    if whole_tokens:
        for token in dict.fromkeys(re.findall("[a-z0-9_]+", query.lower())):
            out = out & low.rlike(f"(?:^|[^a-z0-9_]){token}(?:$|[^a-z0-9_])")
    return out


def required_literal(pattern: str) -> str | None:
    """The longest text that every match of the pattern holds; None where alternatives or flags leave that open."""
    if re.search(r"\(\?[a-z]*[ix]", pattern) or "|" in pattern:
        return None
    best, run, i, depth = "", "", 0, 0

    def close(keep: str) -> None:
        nonlocal best, run
        if len(keep) > len(best):
            best = keep
        run = ""

    while i < len(pattern):
        c = pattern[i]
        literal = None
        if c == "\\":
            if pattern.startswith("\\Q", i):
                return None
            form, end = _escape(pattern, i, False)
            literal = form[1] if end == i + 2 and not form[1].isalnum() else None
            i = end - 1
        elif c == "[":
            close(run)
            i = _class(pattern, i)[1] - 1
        elif c == "(":
            close(run)
            level = 0
            while i < len(pattern):
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == "[":
                    i = _class(pattern, i)[1] - 1
                else:
                    level += (pattern[i] == "(") - (pattern[i] == ")")
                    if not level:
                        break
                i += 1
        elif c in ".^$)":
            pass
        elif c in "*?{":
            close(run[:-1])
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    break
            i += 1
            continue
        elif c == "+":
            close(run)
            i += 1
            continue
        else:
            literal = c
        if literal is None:
            close(run)
        else:
            run += literal
        i += 1
    close(run)
    return best if len(best) >= 3 else None
