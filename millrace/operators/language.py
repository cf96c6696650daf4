"""Language scans over files: lexical states, declarations, imports, kinds of references.

Each job takes one row per file with its lines in order, ``repo_slug, path, extension, lines``, and is parallel over files. What is
known of a language is data (``profiles``); how a line is read with it stands in ``lexical``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import patterns
from millrace.operators import lexical
from millrace.operators.profiles import CODE, COMMENT, FALLBACK, LITERAL, PROFILES, UNKNOWN, LanguageProfile, by_extension

KEYS = ["repo_slug", "path"]
KINDS = ("definition", "write", "call", "instantiation", "type_use", "member_access", "import", "comment", "string_literal", "other")
MAX_LINES, TAB = 20_000, 4  # states behind the first are not known


def _jobs(profiles: tuple[LanguageProfile, ...], one: Callable[[LanguageProfile, list[str]], Iterator[tuple]], columns: list[str]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = by_extension(profiles)
        for b in batches:
            out = []
            for repo, path, extension, lines in zip(b["repo_slug"], b["path"], b["extension"], b["lines"], strict=True):
                out += [(repo, path, *row) for row in one(known.get(extension, FALLBACK), list(lines if lines is not None else []))]
            yield pd.DataFrame(out, columns=[*KEYS, *columns])

    return run


def _scan(files: DataFrame, profiles: tuple[LanguageProfile, ...], one: Callable[[LanguageProfile, list[str]], Iterator[tuple]], columns: list[str], shape: str) -> DataFrame:
    """``one`` over every file. Files are dealt by path to all tasks of a shuffle first: what they come from can be a few blocks, as of a table that compresses well."""
    dealt = files.select(*KEYS, "extension", "lines").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS)
    return dealt.mapInPandas(_jobs(profiles, one, columns), f"repo_slug string, path string, {shape}")


def file_rows(lines: DataFrame) -> DataFrame:
    """One row per file from ``repo_slug, path, extension, line_number, content``."""
    ordered = F.array_sort(F.collect_list(F.struct("line_number", "content")))
    return lines.groupBy(*KEYS, "extension").agg(F.transform(ordered, lambda x: x["content"]).alias("lines"))


def line_states(files: DataFrame, profiles: tuple[LanguageProfile, ...] = PROFILES, bound: int = MAX_LINES) -> DataFrame:
    """The state at the start of every line; unknown behind the bound."""

    def one(profile: LanguageProfile, lines: list[str]) -> Iterator[tuple]:
        for n, _, _, stack in lexical.lines_with_states(profile, lines, bound):
            yield n, lexical.open_state(stack)

    return _scan(files, profiles, one, ["line_number", "state"], "line_number int, state string")


def indent(line: str) -> int:
    """Columns before the first character; a tab counts four."""
    return sum(TAB if c == "\t" else 1 for c in line[: len(line) - len(line.lstrip())])


def declared_lines(profile: LanguageProfile, lines: list[str]) -> Iterator[tuple[int, str, lexical.Declared, str | None]]:
    """Number, line, what it declares, and the role that the last section marker gives; no role where none stands above or the language has no sections."""
    names, scan = lexical.Names(profile), lexical.scanner(profile)
    sections = [(re.compile(rf"\s*(?:{s})", re.I if profile.ignore_case else 0), role) for s, role in profile.sections]
    section = None
    for n, line, spans, stack in lexical.lines_with_states(profile, lines):
        if sections and stack == () and not scan.begins_in_prose(line, stack):
            section = next((role for s, role in sections if s.match(line)), section)
        if stack is None:
            return
        found = names.read(lexical.masked(line, spans, (COMMENT, LITERAL)))
        if found:
            yield n, line, found, section


def declarations(files: DataFrame, profiles: tuple[LanguageProfile, ...] = PROFILES) -> DataFrame:
    """Declaring lines with type, member, role, indentation, and whether they open a scope. Lines inside comments and literals declare nothing."""

    def one(profile: LanguageProfile, lines: list[str]) -> Iterator[tuple]:
        for n, line, found, role in declared_lines(profile, lines):
            yield n, found.type_name, found.member, found.kind, role, indent(line), found.opens_scope

    columns = ["line_number", "type_name", "member", "kind", "role", "indent", "opens_scope"]
    return _scan(files, profiles, one, columns, "line_number int, type_name string, member string, kind string, role string, indent int, opens_scope boolean")


def import_lines(profile: LanguageProfile, lines: list[str]) -> Iterator[tuple[int, str, str]]:
    """Number, name and shape of every import; a list of names goes on over lines until it is closed."""
    reader, in_list = lexical.Imports(profile), False
    for n, line, spans, stack in lexical.lines_with_states(profile, lines):
        if stack is None:  # read on its own
            spans, stack = lexical.scanner(profile).spans(line, ())[0], ()
        if lexical.open_state(stack) != CODE:
            line = lexical.masked(line, spans, (COMMENT, LITERAL))
        names, _, in_list = reader.read(lexical.masked(line, spans, (COMMENT,)), spans, in_list)
        for name, shape in names:
            yield n, name, shape


def imports(files: DataFrame, profiles: tuple[LanguageProfile, ...] = PROFILES) -> DataFrame:
    """Import edges of every file of a known language: ``line_number, name, shape, evidence``. Comments and literals hold none."""

    def one(profile: LanguageProfile, lines: list[str]) -> Iterator[tuple]:
        evidence = "parsed" if profile.name in ("HTML", "CSS") else "text"
        for n, name, shape in import_lines(profile, lines) if profile.name else ():
            yield n, name, shape, evidence

    return _scan(files, profiles, one, ["line_number", "name", "shape", "evidence"], "line_number int, name string, shape string, evidence string")


def modules(files: DataFrame, profiles: tuple[LanguageProfile, ...] = PROFILES) -> DataFrame:
    """The module that each file declares; its first declaration counts."""

    def one(profile: LanguageProfile, lines: list[str]) -> Iterator[tuple]:
        if not profile.module:
            return
        shape = re.compile(profile.module, re.I if profile.ignore_case else 0)
        for _, line, spans, _ in lexical.lines_with_states(profile, lines):
            if m := shape.search(lexical.masked(line, spans, (COMMENT, LITERAL))):
                yield (m[1],)
                return

    return _scan(files, profiles, one, ["module"], "module string")


def is_assignment(rest: str, profile: LanguageProfile) -> bool:
    """Whether what follows a name assigns to it: also compound forms, not comparisons and arrows."""
    return bool(re.match(rf"\s*(?:\[[^\]]*\]\s*)?(?:{profile.assign})", rest))


def classify(profile: LanguageProfile, line: str, at: int, length: int, state: str, declares: bool, imports_: bool = False) -> str:
    """The kind of one appearance: noise first, then imports, declaration, writing, construction, call, member, type."""
    if state != CODE:
        return {COMMENT: "comment", LITERAL: "string_literal"}.get(state, "other")
    if imports_:
        return "import"
    before, rest = line[:at].rstrip(), line[at + length :]
    if declares:
        return "definition"
    if is_assignment(rest, profile):
        return "write"
    if re.search(r"\bnew$", before):
        return "instantiation"
    if re.match(r"\s*(?:<[\w\s,.<>\[\]]*>)?\s*\(", rest):
        return "call"
    if before.endswith(profile.member_marks):
        return "member_access"
    if (profile.type_marks and before.endswith((*profile.type_marks, "(")) and re.match(r"\s*(?:[>,)\[{]|\w)", rest)) or re.match(r"\s*(?:<[^>]*>)?\??(?:\[\])?\s+[^\W\d]\w*", rest) or re.search(r"\b(?:is|as|typeof|extends|implements|of)$", before):
        return "type_use"
    return "other"


def symbol_kinds(profile: LanguageProfile, lines: list[str], symbol: str, bound: int | None = MAX_LINES) -> Iterator[tuple[int, int, str]]:
    """Line, column and kind of every appearance of a symbol as a whole word."""
    word = re.compile(rf"(?<!\w){re.escape(symbol)}(?!\w)")
    names, reader, in_list = lexical.Names(profile), lexical.Imports(profile), False
    for n, line, spans, stack in lexical.lines_with_states(profile, lines, bound):
        listed = any(c.listed for c in profile.imports)
        found = word.search(line)
        if not found and not listed:
            continue
        is_import = False
        if stack is not None:
            _, is_import, in_list = reader.read(lexical.masked(line, spans, (COMMENT,)), spans, in_list)
        if not found:
            continue
        code = lexical.masked(line, spans, (COMMENT, LITERAL, UNKNOWN))
        declared = names.read(code)
        own = declared is not None and symbol in (declared.type_name, declared.member)
        for m in word.finditer(line):
            state = lexical.state_at(spans, m.start(), stack)
            yield n, m.start() + 1, classify(profile, line, m.start(), len(symbol), state, own and word.search(code).start() == m.start(), is_import)


def occurrences(files: DataFrame, symbol: str, profiles: tuple[LanguageProfile, ...] = PROFILES) -> DataFrame:
    """Every appearance of a symbol as a whole word, with its kind. Files that don't hold the text are left out before the scan."""
    holds = files.filter(F.exists("lines", lambda x: F.contains(x, F.lit(symbol))))
    one = lambda profile, lines: symbol_kinds(profile, lines, symbol)
    return _scan(holds, profiles, one, ["line_number", "column", "kind"], "line_number int, column int, kind string")


def enclosing(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """For ``repo_slug, path, line_number, indent``: the nearest declarations above that are less indented, as ``Type.Member``.

    Only declarations that open a scope count. A line that names type and member is the whole answer, else the type is further out than the member. Each
    file is one walk down its lines: a declaration hides those above it that are indented as much or more, so the open ones are a stack.
    """

    def walk(lines: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        marks = marks[marks["opens_scope"]].sort_values("line_number")
        todo = list(zip(marks["line_number"], marks["indent"], marks["type_name"].where(marks["type_name"].notna(), None), marks["member"].where(marks["member"].notna(), None), strict=True))
        types: list[tuple[int, int, str]] = []  # line, indent, name: indents ascend
        members: list[tuple[int, int, str, str | None]] = []
        out, k = [], 0
        for n, depth in lines[["line_number", "indent"]].drop_duplicates().sort_values("line_number").itertuples(index=False):
            while k < len(todo) and todo[k][0] < n:
                at, indent_, type_, member = todo[k]
                if type_ is not None:
                    while types and types[-1][1] >= indent_:
                        types.pop()
                    types.append((at, indent_, type_))
                if member is not None:
                    while members and members[-1][1] >= indent_:
                        members.pop()
                    members.append((at, indent_, member, type_))
                k += 1
            member = next((m for m in reversed(members) if m[1] < depth), None)
            type_ = next((t for t in reversed(types) if t[1] < depth), None)
            # A type nearer than every member is the whole scope; below a member, only types above and outside it count.
            if member and type_ and type_[0] > member[0]:
                member = None
            if member and member[3] is not None:
                scope = f"{member[3]}.{member[2]}"
            elif member:
                outer = next((t for t in reversed(types) if t[1] < member[1] and t[0] < member[0]), None)
                scope = f"{outer[2]}.{member[2]}" if outer else member[2]
            else:
                scope = type_[2] if type_ else None
            out.append((n, scope))
        keys = lines.iloc[0][KEYS]
        return pd.DataFrame([(*keys, n, scope) for n, scope in out], columns=[*KEYS, "line_number", "scope"])

    shape = "repo_slug string, path string, line_number int, scope string"
    return rows.select(*KEYS, "line_number", "indent").groupBy(*KEYS).cogroup(declared.select(*KEYS, "line_number", "indent", "type_name", "member", "opens_scope").groupBy(*KEYS)).applyInPandas(lambda a, b: walk(a, b) if len(a) else pd.DataFrame(columns=[*KEYS, "line_number", "scope"]), shape)


def generated(files: DataFrame, profiles: tuple[LanguageProfile, ...] = PROFILES) -> DataFrame:
    """Files whose names mark them as generated, by the globs of their language."""
    globs = [g for p in profiles for g in p.generated]
    return files.filter(patterns.excluded(F.col("path"), globs))


def profile_table(spark, profiles: tuple[LanguageProfile, ...] = PROFILES) -> DataFrame:  # noqa: ANN001
    """``extension, language, has_shapes`` of the profiles: a short fixed table."""
    return spark.createDataFrame([(e, p.name, bool(p.modifiers or p.type_words)) for p in profiles for e in p.extensions], "extension string, language string, has_shapes boolean")
