"""Reading lines of code: lexical states as a stack of open spans, declared names, imports.

A position in a file is what is open there: a stack of comments, literals and holes, at most eight deep, which carries from line to line.
What is deeper is not known, and neither is anything below it in the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from millrace.operators.profiles import CODE, COMMENT, LITERAL, MODULE, PATH, UNKNOWN, Clause, Form, LanguageProfile

MAX_NESTING = 8
_ESCAPE = r"\\(?:x[0-9A-Fa-f]{1,4}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)"
Span = tuple[int, int, str]


@dataclass(frozen=True)
class Open:
    """One entry of the stack: a form's text until ``closer``; or, with ``nested`` brackets open in it, one of its holes."""

    form: Form
    closer: str
    prose: bool
    nested: int | None = None


Stack = tuple[Open, ...] | None


@lru_cache(maxsize=64)
def scanner(profile: LanguageProfile) -> Scanner:
    return Scanner(profile)


class Scanner:
    """Finds the next mark that matters where a line stands: openers in code, the end of a literal, brackets in a hole."""

    def __init__(self, profile: LanguageProfile) -> None:
        self.prose = set(profile.comments)
        self.forms = sorted((*profile.comments, *profile.literals), key=lambda f: -len(f.open))
        opening = [self._opening(f, profile.directives) for f in self.forms]
        self.holes: dict[Form, re.Pattern] = {f: re.compile("|".join([re.escape(f.hole.close), re.escape(f.hole.nest), *opening])) for f in self.forms if f.hole}
        self.line_comments = profile.line_comments
        marks = [*opening, *map(re.escape, profile.line_comments)]
        self.code = re.compile("|".join(marks)) if marks else None
        self.whole = re.compile(rf"\s*(?:{'|'.join(profile.line_starts)})", re.I if profile.ignore_case else 0) if profile.line_starts else None

    @staticmethod
    def _opening(form: Form, directives: tuple[str, ...]) -> str:
        if form.single:
            return rf"{form.open}(?:[^{form.close}\\]|{_ESCAPE}){form.close}"
        out = re.escape(form.open) + "".join(f"(?!{re.escape(d[len(form.open):])})" for d in directives if d.startswith(form.open))
        return out + (re.escape(form.open[-1]) + "*" if form.repeats else "")

    @staticmethod
    @lru_cache(maxsize=256)
    def _ending(form: Form, closer: str) -> re.Pattern:
        """What ends a form's text or opens a hole, and what only looks like that (the first group)."""
        text = {"\\": r"\\.", "double": re.escape(closer * 2)}.get(form.escape)
        passed = [x for x in (text, re.escape(form.hole.open * 2) if form.hole and form.hole.doubled else None) if x]
        return re.compile("|".join([f"({'|'.join(passed)})" if passed else "((?!))", re.escape(closer), *([re.escape(form.hole.open)] if form.hole else [])]))

    def begins_in_prose(self, line: str, stack: Stack) -> bool:
        """Whether a whole line is a comment by how it begins."""
        return stack == () and self.whole is not None and self.whole.match(line) is not None

    def spans(self, line: str, stack: Stack) -> tuple[list[Span], Stack]:
        """Stretches of the line and their states, and what is open behind it."""
        if stack is None:
            return [(0, len(line), UNKNOWN)], None
        if self.begins_in_prose(line, stack):
            return [(0, len(line), COMMENT)], stack
        out: list[Span] = []
        at, held = 0, list(stack)

        def note(end: int, state: str) -> None:
            nonlocal at
            if end > at:
                if out and out[-1][2] == state:
                    out[-1] = (out[-1][0], end, state)
                else:
                    out.append((at, end, state))
            at = end

        while at < len(line):
            top = held[-1] if held else None
            if top is None or top.nested is not None:
                pattern = self.code if top is None else self.holes[top.form]
                m = pattern.search(line, at) if pattern else None
                if m is None:
                    note(len(line), CODE)
                    break
                note(m.start(), CODE)
                if top is None and m[0] in self.line_comments:
                    note(len(line), COMMENT)
                    break
                if top is not None and m[0] in (top.form.hole.close, top.form.hole.nest):
                    if m[0] == top.form.hole.nest:
                        held[-1] = Open(top.form, top.closer, False, top.nested + 1)
                        note(m.end(), CODE)
                    elif top.nested:
                        held[-1] = Open(top.form, top.closer, False, top.nested - 1)
                        note(m.end(), CODE)
                    else:
                        held.pop()
                        note(m.end(), LITERAL)
                    continue
                form = next(f for f in self.forms if m[0].startswith(f.open) and (f.single or f.repeats or m[0] == f.open))
                if not form.single:
                    if len(held) == MAX_NESTING:
                        out.append((at, len(line), UNKNOWN))
                        return out, None
                    held.append(Open(form, form.close + form.close[-1] * (len(m[0]) - len(form.open)), form in self.prose))
                note(m.end(), COMMENT if form in self.prose else LITERAL)
                continue
            state = COMMENT if top.prose else LITERAL
            m = next((x for x in self._ending(top.form, top.closer).finditer(line, at) if not x[1]), None)
            if m is None:
                note(len(line), state)
                break
            note(m.end(), state)
            if m[0] == top.closer:
                held.pop()
            elif len(held) == MAX_NESTING:
                out.append((at, len(line), UNKNOWN))
                return out, None
            else:
                held.append(Open(top.form, top.closer, False, 0))
        # What can't span lines ends with its line, and so does all that is open inside it.
        kept = next((k for k, x in enumerate(held) if not x.form.spans), len(held))
        return out, tuple(held[:kept])


def masked(line: str, spans: list[Span], hidden: tuple[str, ...]) -> str:
    """The line with all stretches of the hidden states blanked, places unchanged."""
    return "".join(" " * (b - a) if s in hidden else line[a:b] for a, b, s in spans)


def open_state(stack: Stack) -> str:
    """The state at the start of a line."""
    if stack is None:
        return UNKNOWN
    if not stack or stack[-1].nested is not None:
        return CODE
    return COMMENT if stack[-1].prose else LITERAL


def state_at(spans: list[Span], at: int, stack: Stack) -> str:
    """The state at a place of the line; behind its end, the one in which it ends."""
    return next((s for a, b, s in spans if a <= at < b), spans[-1][2] if spans else UNKNOWN if stack is None else CODE)


@dataclass(frozen=True)
class Declared:
    type_name: str | None
    member: str | None
    kind: str
    opens_scope: bool


_TOKEN = re.compile(r"\w+|[^\w\s]")
_CONTROL = ("if", "for", "while", "switch", "catch", "return", "function", "with")


class Names:
    """What a line of code declares: a type and a member are read independently of each other."""

    def __init__(self, profile: LanguageProfile) -> None:
        self.profile = profile
        self.fold = str.lower if profile.ignore_case else str
        self.phrases = sorted((tuple(m.split()) for m in (*profile.modifiers, *profile.untyped)), key=len, reverse=True)

    def read(self, code: str) -> Declared | None:
        p = self.profile
        if not (p.modifiers or p.type_words):
            return None
        tokens = _TOKEN.findall(code)
        first = 0 if p.name_follows else self._behind_attributes(tokens)
        words = [self.fold(t) for t in tokens]
        begin = self._behind_modifiers(words, first)
        type_name, kind = self._type(tokens, words, first)
        member, qualifier, head = None, None, begin
        if begin > first:
            member, qualifier, head = self._following(tokens, words, begin) if p.name_follows else self._typed(tokens, words, first, begin)
        if member is None and type_name is None and p.bare_methods and (m := re.match(r"\s*(?:\w+\s+)*?(\w+)\s*\([^;]*\)\s*(?::[^={]+)?\{\s*$", code)) and m[1] not in _CONTROL and not words[0].startswith(_CONTROL):
            return Declared(None, m[1], "member", True)
        if p.owner and member is not None and p.owner in words[head:-1]:
            qualifier = tokens[words.index(p.owner, head) + 1]
        type_name = type_name or qualifier
        if type_name is None and member is None:
            return None
        flat = bool({*p.flat, *p.untyped} & set(words[first:head]))
        if not p.name_follows and not flat and re.match(r"[^({=]*(?:;|=(?![>=]))", code):  # a field ends or takes a value before any bracket
            flat = True
        if p.untyped and "=>" in code or "function" in words[head:]:  # a name for a function holds lines
            flat = False
        return Declared(type_name, member, kind or (words[begin - 1] if p.name_follows else "member"), type_name is not None or not flat)

    @staticmethod
    def _behind_attributes(tokens: list[str]) -> int:
        at = 0
        while at < len(tokens) and tokens[at] == "[":
            depth, k = 0, at
            for k in range(at, len(tokens)):
                depth += {"[": 1, "]": -1}.get(tokens[k], 0)
                if not depth:
                    break
            at = k + 1
        return at

    def _behind_modifiers(self, words: list[str], at: int) -> int:
        while phrase := next((x for x in self.phrases if tuple(words[at : at + len(x)]) == x), None):
            at += len(phrase)
        return at

    def _type(self, tokens: list[str], words: list[str], at: int) -> tuple[str | None, str | None]:
        """The name behind the last word for a type among the words that begin the line, or before it where the language writes it so."""
        p = self.profile
        end = at
        while end < len(tokens) and _is_word(tokens[end]):
            end += 1
        for k in range(end - 2, at - 1, -1):
            if words[k] in p.type_words and not (p.name_precedes and words[k] in p.modifiers):
                return tokens[k + 1], words[k]
        if not p.name_follows and "delegate" in words[at:end] and tokens[end : end + 1] in (["("], ["<"]) and end - at > 2:
            return tokens[end - 1], "delegate"
        if p.name_precedes and len(tokens) > at + 2 and _is_word(tokens[at]) and tokens[at + 1] == "=":
            rest = [w for w in words[at + 2 : at + 4] if w != "packed"]
            if rest and rest[0] in p.type_words:
                return tokens[at], rest[0]
        return None, None

    def _following(self, tokens: list[str], words: list[str], at: int) -> tuple[str | None, str | None, int]:
        """A name right behind its modifiers, perhaps behind that of its owner and a dot; then something that heads a body or ends the line."""
        name, at = self._name(tokens, at)
        owner = None
        while name and at < len(tokens) and tokens[at] == ".":
            owner = name
            name, at = self._name(tokens, at + 1)
        if name is None or words[at - 1] in self.profile.body_words:
            return None, None, at
        behind = words[at] if at < len(words) else ""
        return (name, owner, at) if behind in ("", "(", "<", "{", "=", ";", ":", *self.profile.body_words) else (None, None, at)

    @staticmethod
    def _name(tokens: list[str], at: int) -> tuple[str | None, int]:
        """A name, which may stand in brackets or quotes."""
        if at < len(tokens) and tokens[at] in ("[", '"'):
            closer, k = {"[": "]", '"': '"'}[tokens[at]], at + 1
            while k < len(tokens) and tokens[k] != closer:
                k += 1
            return (" ".join(tokens[at + 1 : k]), k + 1) if k < len(tokens) else (None, at)
        return (tokens[at], at + 1) if at < len(tokens) and _is_word(tokens[at]) else (None, at)

    def _typed(self, tokens: list[str], words: list[str], first: int, at: int) -> tuple[str | None, str | None, int]:
        """Modifiers, a type, and the name with what opens a body, gives a value or ends a field."""
        p = self.profile
        text = lambda k: tokens[k] if k < len(tokens) else ""
        if p.untyped and words[at - 1] in p.untyped and _is_word(text(at)) and text(at + 1) in ("=", ":"):
            return tokens[at], None, at
        if not _is_word(text(at)) or words[at] in (*p.no_types, *p.type_words):
            return None, None, at
        if text(at + 1) == "(":  # a constructor, or a function without a type; `new X(` is neither
            named = {"public", "private", "protected", "internal", "static", "function", "def", "export"} & set(words[first:at])
            return (tokens[at] if named else None), None, at
        k = at + 1
        while text(k) == "." and _is_word(text(k + 1)):
            k += 2
        if text(k) == "<":
            depth = 0
            while k < len(tokens):
                depth += {"<": 1, ">": -1}.get(tokens[k], 0)
                k += 1
                if not depth:
                    break
        while text(k) in ("[", "]", "?", ","):
            k += 1
        return (tokens[k], None, k) if _is_word(text(k)) and text(k + 1) in ("(", "<", "{", "=", ";") else (None, None, k)


def _is_word(token: str) -> bool:
    return bool(token) and (token[0].isalnum() or token[0] == "_")


class Imports:
    """Clauses that name what a file depends on. ``read`` is given the line without its comments and its spans."""

    _listed = re.compile(r"\s*(\w+(?:\.\w+)*)\s*(?:in\s+'[^']*'\s*)?([,;]|$)", re.I)
    _module = re.compile(r"\s*(?:static\s+)?(?:\w+\s*=\s*)?(\w+(?:\.\w+)*)\s*(?:;.*|\bimport\b.*)?$")
    _quoted = re.compile(r"""(["'`])(.*?)\1""")

    def __init__(self, profile: LanguageProfile) -> None:
        self.flags = re.I if profile.ignore_case else 0
        longest = sorted(profile.imports, key=lambda c: -len(c.opener))
        self.clauses = [(c, re.compile(re.escape(c.opener.rstrip()).replace(r"\ ", r"\s+") + (r"\b\s*" if c.opener[-1].isalpha() else r"\s+" if c.opener[-1] == " " else r"\s*"), self.flags)) for c in longest]

    def read(self, line: str, spans: list[Span], in_list: bool) -> tuple[list[tuple[str, str]], bool, bool]:
        """Names with their shapes; whether the line is (part of) a clause; and whether a list goes on behind it."""
        if in_list:
            names, more = self._names(line, 0)
            return [(n, MODULE) for n in names], bool(names), more
        start = len(line) - len(line.lstrip())
        found: list[tuple[str, str]] = []
        at, is_clause = start, False
        while at < len(line):
            hits = [(m.start(), -len(m[0]), c, m) for c, pattern in self.clauses if (m := self._opening(c, pattern, line, at, start, spans))]
            if not hits:
                break
            _, _, clause, m = min(hits, key=lambda h: h[:2])
            if clause.listed:
                names, more = self._names(line, m.end())
                return found + [(n, MODULE) for n in names], True, more
            name, end = self._clause(clause, line, m.end())
            if name:
                found.append((name, clause.shape))
                is_clause = True
            at = max(end, m.end())
        return found, is_clause, False

    @staticmethod
    def _opening(clause: Clause, pattern: re.Pattern, line: str, at: int, start: int, spans: list[Span]) -> re.Match | None:
        """The clause's next opener that stands in code."""
        if not clause.anywhere:
            m = pattern.match(line, start) if at <= start else None
            return m if m and state_at(spans, start, ()) != LITERAL else None
        for m in pattern.finditer(line, at):
            before = line[m.start() - 1 : m.start()]
            if state_at(spans, m.start(), ()) not in (LITERAL, COMMENT) and not (m[0][0].isalpha() and (before.isalnum() or before in ("_", ".", "-") and before)):
                return m
        return None

    def _names(self, line: str, at: int) -> tuple[list[str], bool]:
        """Names with commas; what can't be part of such a list ends it."""
        names: list[str] = []
        while at < len(line) and line[at:].strip():
            m = self._listed.match(line, at)
            if not m:
                return names, False
            names.append(m[1])
            at = m.end()
            if m[2] == ";":
                return names, False
        return names, True

    def _clause(self, clause: Clause, line: str, at: int) -> tuple[str | None, int]:
        if clause.attribute:
            end = line.find(">", at)
            end = len(line) if end < 0 else end
            m = re.compile(rf"(?<![\w-]){clause.attribute}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I).search(line, at)
            return (m[1] or m[2] or m[3], m.end()) if m and m.start() < end else (None, end)
        if clause.shape == MODULE:
            m = self._module.match(line, at)
            return (m[1], len(line)) if m else (None, at)
        if clause.source:
            m = re.compile(rf"\b{clause.source}\s*(?=[\"'])").search(line, at)
            if not m:
                return None, len(line)
            at = m.end()
        if line[at : at + 1] == "<" and ">" in line[at:]:
            end = line.index(">", at)
            return line[at + 1 : end].strip(), end + 1
        end = line.find(clause.closer, at) if clause.closer else -1
        m = self._quoted.search(line, at, len(line) if end < 0 or line[at : at + 1] in ("'", '"', "`") else end)
        if m:
            return m[2].strip() or None, m.end()
        if end < 0 or clause.opener.endswith(("import(", "require(")):  # only a quoted name is known before the program runs
            return None, at
        return line[at:end].strip() or None, end + 1


def lines_with_states(profile: LanguageProfile, lines: list[str], bound: int | None = None) -> Iterator[tuple[int, str, list[Span], Stack]]:
    """Number, line, spans and what is open before it; behind the bound nothing is known."""
    scan, stack = scanner(profile), ()
    for n, line in enumerate(lines, 1):
        if bound is not None and n > bound:
            stack = None
        before = stack
        spans, stack = scan.spans(line, stack)
        yield n, line, spans, before


__all__ = ["CODE", "COMMENT", "LITERAL", "MODULE", "PATH", "UNKNOWN", "Declared", "Imports", "Names", "Scanner", "lines_with_states", "masked", "open_state", "scanner", "state_at"]
