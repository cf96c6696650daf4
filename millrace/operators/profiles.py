"""Languages as data: how each writes comments, literals, declarations, imports and sections."""

from __future__ import annotations

from dataclasses import dataclass

CODE, COMMENT, LITERAL, UNKNOWN = "code", "comment", "literal", "unknown"
PATH, MODULE = "path", "module"
DECLARATION, IMPLEMENTATION = "declaration", "implementation"


@dataclass(frozen=True)
class Hole:
    """Live code inside a literal: what opens it, closes it, and is counted inside it; with ``doubled`` two openers are text."""

    open: str
    close: str
    nest: str
    doubled: bool = False


@dataclass(frozen=True)
class Form:
    """A comment or literal. ``escape`` is a backslash, or ``double`` for a doubled closer; ``repeats``: the opener's last character may follow more often, and
    as many close it; ``single``: holds one character or one escape, else it is no literal."""

    open: str
    close: str
    escape: str = ""
    spans: bool = False
    hole: Hole | None = None
    repeats: bool = False
    single: bool = False


@dataclass(frozen=True)
class Clause:
    """How an import is written. ``anywhere``: not only at a line's start; ``attribute``: of a tag; ``listed``: names with commas up to a semicolon, over lines;
    ``source``: the name stands behind this word."""

    opener: str
    shape: str
    anywhere: bool = False
    closer: str = ""
    attribute: str = ""
    listed: bool = False
    source: str = ""


@dataclass(frozen=True)
class LanguageProfile:
    """What the scans know of a language.

    ``modifiers`` are words or phrases in front of a declared name, of which ``flat`` ones introduce names that hold no lines. With ``name_follows`` the name stands
    right behind them, else a type stands between. ``owner``: the word that names a member's type behind its head. ``line_starts``: patterns of what makes a whole line a comment;
    ``sections``: patterns at a line's start, and the role of what follows them.
    """

    name: str
    extensions: tuple[str, ...]
    line_comments: tuple[str, ...] = ()
    line_starts: tuple[str, ...] = ()
    comments: tuple[Form, ...] = ()
    literals: tuple[Form, ...] = ()
    directives: tuple[str, ...] = ()
    modifiers: tuple[str, ...] = ()
    flat: tuple[str, ...] = ()
    type_words: tuple[str, ...] = ()
    no_types: tuple[str, ...] = ()
    name_follows: bool = False
    name_precedes: bool = False
    untyped: tuple[str, ...] = ()
    bare_methods: bool = False
    body_words: tuple[str, ...] = ()
    owner: str = ""
    imports: tuple[Clause, ...] = ()
    module: str | None = None
    ignore_case: bool = False
    assign: str = r"(?:[-+*/%&|^]|<<|>>|\?\?)?=(?![=>])"
    member_marks: tuple[str, ...] = (".",)
    type_marks: tuple[str, ...] = ()
    sections: tuple[tuple[str, str], ...] = ()
    generated: tuple[str, ...] = ()


# Words, marks and patterns that results rely on.
_BLOCK = Form("/*", "*/", spans=True)
_DOUBLE, _SINGLE = Form('"', '"', "\\"), Form("'", "'", "\\")
_QUOTED = Form("'", "'", "double")
_PLAIN = (Form('"', '"'), Form("'", "'"))
_BRACES = Hole("{", "}", "{", doubled=True)
_CS_LITERALS = (
    Form('$"""', '"""', spans=True, hole=_BRACES, repeats=True),
    Form('"""', '"""', spans=True, repeats=True),
    Form('$@"', '"', "double", spans=True, hole=_BRACES),
    Form('@$"', '"', "double", spans=True, hole=_BRACES),
    Form('@"', '"', "double", spans=True),
    Form('$"', '"', "\\", hole=_BRACES),
    _DOUBLE,
    Form("'", "'", single=True),
)
_JS_LITERALS = (Form("`", "`", "\\", spans=True, hole=Hole("${", "}", "{")), _DOUBLE, _SINGLE)
_C_MODIFIERS = ("public", "private", "protected", "internal", "static", "async", "override", "virtual", "abstract", "sealed", "partial", "extern", "new", "readonly", "const", "export", "declare", "function", "def", "val", "let", "event")
_C_FLAT = ("const", "readonly", "val", "let", "event")
_XS_MODIFIERS = ("public", "private", "protected", "internal", "export", "hidden", "static", "virtual", "override", "abstract", "sealed", "partial", "const", "async", "new", "function", "procedure", "method", "access", "assign", "property", "event", "delegate", "constructor", "destructor", "operator", "define", "local", "instance", "global", "member", "field")
_DELPHI_MODIFIERS = ("procedure", "function", "constructor", "destructor", "operator", "property", "type", "class", "published", "private", "protected", "public", "strict", "override", "virtual", "overload", "static", "var", "const")
_SQL_MODIFIERS = ("create", "alter", "or replace", "or alter", "declare", "if not exists", "procedure", "function", "view", "table", "trigger", "type", "index", "sequence", "unique", "materialized", "clustered", "nonclustered", "temporary", "global temporary")
_PROSE = r"#\s*(?:region|endregion|error|warning)\b"
_JS_IMPORTS = (Clause("import ", PATH), Clause("import(", PATH, anywhere=True, closer=")"), Clause("require(", PATH, anywhere=True, closer=")"), Clause("export ", PATH, source="from"))
_PACKAGE = ((r"create\s+(?:or\s+replace\s+)?package\s+body\b", IMPLEMENTATION), (r"create\s+(?:or\s+replace\s+)?package\b", DECLARATION))

PROFILES: tuple[LanguageProfile, ...] = (
    LanguageProfile(
        "X#", ("prg", "vh", "xh", "ch"), line_comments=("//", "&&"), line_starts=(r"\*", _PROSE), comments=(_BLOCK,), literals=_PLAIN,
        modifiers=_XS_MODIFIERS, flat=("define", "local", "instance", "global", "member", "field"), type_words=("class", "interface", "struct", "structure", "vostruct", "union", "enum"),
        name_follows=True, body_words=("as",), owner="class", imports=(Clause("using ", MODULE), Clause("#using ", MODULE), Clause("#include", PATH)), module=r"^\s*begin\s+namespace\s+([\w.]+)",
        ignore_case=True, assign=r"(?:[-+*/%^]|\*\*)?:=|(?:[-+*/%^]|\*\*)=", member_marks=(".", ":"), generated=("*_vo.prg", "*.designer.prg"),
    ),
    LanguageProfile(
        "C#", ("cs", "csx"), line_comments=("//",), line_starts=(_PROSE,), comments=(_BLOCK,), literals=_CS_LITERALS,
        modifiers=_C_MODIFIERS, flat=_C_FLAT, type_words=("class", "interface", "struct", "record", "enum"), no_types=("default",),
        imports=(Clause("using ", MODULE), Clause("global using ", MODULE)), module=r"^\s*namespace\s+([\w.]+)", member_marks=(".", "->", "?."), type_marks=(":", "<", ","), generated=("*.g.cs", "*.designer.cs", "*.generated.cs"),
    ),
    LanguageProfile(
        "TypeScript", ("ts", "tsx", "mts", "cts"), line_comments=("//",), comments=(_BLOCK,), literals=_JS_LITERALS,
        modifiers=_C_MODIFIERS, flat=_C_FLAT, type_words=("class", "interface", "enum", "type"), no_types=("default",), untyped=("const", "let", "var"), bare_methods=True,
        imports=_JS_IMPORTS, member_marks=(".", "?."), type_marks=(":", "<", ","), generated=("*.d.ts",),
    ),
    LanguageProfile(
        "JavaScript", ("js", "jsx", "mjs", "cjs"), line_comments=("//",), comments=(_BLOCK,), literals=_JS_LITERALS,
        modifiers=_C_MODIFIERS, flat=_C_FLAT, type_words=("class",), no_types=("default",), untyped=("const", "let", "var"), bare_methods=True,
        imports=_JS_IMPORTS, member_marks=(".", "?."), type_marks=("<", ","), generated=("*.min.js",),
    ),
    LanguageProfile(
        "Delphi", ("pas", "dpr", "dpk", "dfm"), line_comments=("//",), comments=(Form("{", "}", spans=True), Form("(*", "*)", spans=True), _BLOCK), literals=(_QUOTED,), directives=("{$", "(*$"),
        modifiers=_DELPHI_MODIFIERS, flat=("var", "const", "property"), type_words=("class", "record", "interface", "object"), name_follows=True, name_precedes=True,
        imports=tuple(Clause(w, MODULE, listed=True) for w in ("uses", "contains", "requires")), module=r"^\s*(?:unit|program|library|package)\s+([\w.]+)\s*;", ignore_case=True, assign=r":=", type_marks=(":", ","),
        sections=((r"interface(?!\w)", DECLARATION), (r"implementation(?!\w)", IMPLEMENTATION)),
    ),
    LanguageProfile("HTML", ("html", "htm"), comments=(Form("<!--", "-->", spans=True),), literals=_PLAIN, imports=(Clause("<script", PATH, anywhere=True, attribute="src"), Clause("<link", PATH, anywhere=True, attribute="href")), ignore_case=True),
    LanguageProfile("CSS", ("css",), comments=(_BLOCK,), literals=(_DOUBLE, _SINGLE), imports=(Clause("@import url(", PATH, closer=")"), Clause("@import", PATH), Clause("url(", PATH, anywhere=True, closer=")")), ignore_case=True, assign=":"),
    LanguageProfile("SQL", ("sql",), line_comments=("--",), comments=(_BLOCK,), literals=(_QUOTED,), modifiers=_SQL_MODIFIERS, name_follows=True, body_words=("as", "is", "on"), ignore_case=True, assign=r"(?<![<>!:])=(?!=)", sections=_PACKAGE),
    LanguageProfile("PL/SQL", ("pks", "pkb", "plsql", "prc", "fnc", "trg"), line_comments=("--",), comments=(_BLOCK,), literals=(_QUOTED,), modifiers=(*_SQL_MODIFIERS, "package", "body", "cursor", "exception"), name_follows=True, body_words=("as", "is", "on"), ignore_case=True, assign=r":=", sections=_PACKAGE),
)
#: For files without a profile. Its imports say what a reference is; edges are only read where a language is known.
FALLBACK = LanguageProfile(
    "", (), line_comments=("//",), line_starts=(r"\*", "--", "#(?!include)"), comments=(_BLOCK,), literals=(_DOUBLE,),
    modifiers=_C_MODIFIERS, type_words=("class", "interface", "struct", "record", "enum"), no_types=("default",),
    imports=(Clause("using ", MODULE), Clause("import ", MODULE), Clause("#include", PATH), Clause("from ", MODULE), Clause("require(", PATH, anywhere=True, closer=")")), type_marks=(":", "<", ","),
)


def by_extension(profiles: tuple[LanguageProfile, ...]) -> dict[str, LanguageProfile]:
    return {e: p for p in profiles for e in p.extensions}
