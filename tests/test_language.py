"""Lexical states, declarations, imports and kinds of references, line by line."""

import pytest

from millrace.operators import language, lexical
from millrace.operators.profiles import FALLBACK, PROFILES, by_extension

BY = by_extension(PROFILES)


def kinds(extension, text, symbol):
    return [k for _, _, k in language.symbol_kinds(BY.get(extension, FALLBACK), text.split("\n"), symbol)]


def declared(extension, text):
    found = list(language.declared_lines(BY.get(extension, FALLBACK), text.split("\n")))
    return (found[-1][2], found[-1][3]) if found else (None, None)


def imports(extension, text):
    return [(name, shape) for _, name, shape in language.import_lines(BY[extension], text.split("\n"))]


C, S, L = "comment", "string_literal", "call"


@pytest.mark.parametrize(("extension", "text", "expected"), [
    ("cs", "/*\nadvance(1);\n*/", [C]), ("pas", "{\nadvance(1);\n}", [C]), ("pas", "(*\nadvance(1);\n*)", [C]), ("html", "<!--\n<b onclick=advance(1)>\n-->", [C]),
    ("css", "/*\n.a { color: advance(1) }\n*/", [C]), ("sql", "/*\nadvance(1);\n*/", [C]), ("pkb", "/*\nadvance(1);\n*/", [C]), ("prg", "/*\nadvance(1)\n*/", [C]), ("ts", "/*\nadvance(1);\n*/", [C]),
    ("cs", 'var sql = @"\nadvance(1)\n";', [S]), ("cs", 'var sql = """\nadvance(1)\n""";', [S]), ("cs", 'var sql = $@"\nadvance(1)\n";', [S]), ("ts", "const q = `\nadvance(1)\n`;", [S]),
    # As many quotes close a raw literal as open it.
    ("cs", 'var s = """"\n  """ advance(1)\n  advance(2)\n  """";\nadvance(3);', [S, S, L]), ("cs", 'var s = """""\n  """" advance(1)\n  """"";\nadvance(2);', [S, L]),
    # A character literal holds one character or one escape; any other apostrophe opens nothing.
    ("cs", "x = 'advance(1)\nadvance(2);", [L, L]), ("cs", "if (c == '\"') return advance(reader);", [L]), ("cs", "if (c == '\\'') return advance(reader);", [L]),
    ("cs", "x = it's advance(1);", [L]), ("cs", "x = 'ab' + advance(1);", [L]), ("cs", "x = '' + advance(1);", [L]), ("cs", "x = '\\' + advance(1);", [L]), ("cs", "x = ' ; advance(1); var c = 'y';", [L]),
    ("cs", "var s = $\"{(c == '\\'' ? advance(1) : 0)}\";", [L]),
    # Text of an interpolated literal, and the live code in its holes.
    ("cs", 'var s = $"""\n  advance is {advance(1)}\n  """;', [S, L]), ("cs", 'var s = $@"\n  advance is {advance(1)}\n  ";', [S, L]), ("cs", 'var s = $"{{advance(1)}} {advance(2)}";', [S, L]),
    ("ts", "const q = `advance ${advance(1)} ${ {a: advance(2)} } advance`;", [S, L, L, S]), ("ts", "const q = `${ `${advance(1)} advance` }`;", [L, S]),
    ("ts", 'const q = `${ parse("advance(1)\nadvance(2)} a`;', [S, L]), ("ts", "const q = `\n${advance(1)\n+ advance(2)} advance\n`; advance(3)", [L, L, S, L]),
    # What closes is not inside; what follows it is code.
    ("cs", "/*\nadvance(1);\n*/ advance(2);", [C, L]), ("cs", 'var sql = @"\nadvance(1)\n"; advance(2);', [S, L]), ("cs", "advance(1); /* advance(2)\n*/", [L, C]), ("cs", 'Log("advance(1)\nadvance(2);', [S, L]),
    ("cs", "/**\n * advance(1)\n */", [C]), ("prg", "* advance the order", [C]), ("ts", "  *advance() {", [L]), ("cs", "    * advance;", ["other"]),
    ("cs", "#region Don't touch advance\n    advance(1);", [C, L]), ("prg", "#  REGION Don't touch advance", [C]), ("cs", "#regional advance", ["other"]), ("cs", "#warning advance isn't set", [C]),
    ("sql", "SELECT 'it''s advance here'", [S]), ("sql", "-- advance", [C]), ("ts", "--remaining; advance(1)", [L]), ("pas", "{$IFDEF advance}", ["other"]), ("pas", "// advance", [C]), ("prg", "&& advance", [C]),
    ("css", "  border: 1px solid advance;", ["other"]), ("cs", 'var u = "http://x"; advance(1);', [L]),
    # A language that nobody described: comments and strings are still told apart.
    ("py", "# advance", [C]), ("py", '"advance"', [S]), ("zz", "-- advance", [C]), ("zz", "advance(1)", [L]),
])
def test_states(extension, text, expected):
    assert kinds(extension, text, "advance") == expected


@pytest.mark.parametrize(("line", "symbol"), [("var c = 'A';", "A"), ("f('\\'', 'A');", "A"), ("f('\\\\', 'A');", "A"), ("var c = '\\n';", "n"), ("var c = '\\x41';", "x41"), ("var c = '\\u0041';", "u0041"), ("var c = '\\U00000041';", "U00000041")])
def test_character_literals(line, symbol):
    assert kinds("cs", line, symbol) == [S]


def test_nesting_beyond_the_bound_is_not_known():
    text = "const q = " + "`${" * 4 + "advance(1)" + "}`" * 4 + "; advance(2)\n" + "`${" * 5 + "\nadvance(3)\n"
    assert kinds("ts", text, "advance") == [L, L, "other"]
    states = [lexical.open_state(x[3]) for x in lexical.lines_with_states(BY["ts"], text.split("\n"))]
    assert states == ["code", "code", "unknown", "unknown"]


def test_spans_cover_every_line():
    for extension, text in (("cs", 'a("x{y}") // b\n$"{f("q")}" /* c\n d */ e'), ("ts", "`a${b}` + 'c'"), ("pas", "x := 'it''s'; { y }")):
        for _, line, spans, _ in lexical.lines_with_states(BY[extension], text.split("\n")):
            assert [a for a, _, _ in spans[1:]] == [b for _, b, _ in spans[:-1]] and (not line or (spans[0][0], spans[-1][1]) == (0, len(line)))


@pytest.mark.parametrize(("extension", "line", "type_name", "member", "opens"), [
    ("cs", "    public void Advance(int n)", None, "Advance", True), ("cs", "public class OrderService", "OrderService", None, True), ("cs", "public partial class OrderService : IService", "OrderService", None, True),
    ("cs", "    public Dictionary<string, int> Counts { get; }", None, "Counts", True), ("cs", "public readonly struct Point", "Point", None, True), ("cs", "public readonly record struct Money(decimal Amount)", "Money", None, True),
    ("cs", "record struct Money(decimal Amount);", "Money", None, True), ("cs", "        const int Max = 10;", None, "Max", False), ("cs", "        readonly Span<int> s = stackalloc int[4];", None, "s", False),
    ("cs", "    private readonly ILogger _logger;", None, "_logger", False), ("cs", "    public event EventHandler Changed;", None, "Changed", False), ("cs", "    public static explicit operator int(Money m) => 1;", None, None, None),
    ("cs", "public delegate void Done(int n);", "Done", None, True), ("cs", "[Fact] public void Runs()", None, "Runs", True), ("cs", "        return count;", None, None, None), ("cs", "        new Order(x);", None, None, None), ("cs", "    public Order(int n)", None, "Order", True),
    ("cs", '    private const string Pattern = "class No";', None, "Pattern", False), ("cs", "    public Dictionary<string, List<Foo<int>>> Deep;", None, "Deep", False),
    ("prg", "method Advance(n as int) as void", None, "Advance", True), ("prg", "METHOD Advance(n AS INT) AS VOID", None, "Advance", True), ("prg", "METHOD Go() CLASS Foo", "Foo", "Go", True), ("prg", "define FSEDIT_GET := 11", None, "FSEDIT_GET", False),
    ("prg", "define PD_ALLPAGES             := 0x00000000", None, "PD_ALLPAGES", False), ("prg", "instance cLabel as string", None, "cLabel", False), ("prg", "\tlocal cLabel := self:Status", None, "cLabel", False), ("prg", "METHOD Größe()", None, "Größe", True),
    ("prg", "vostruct _winPoint", "_winPoint", None, True), ("prg", "union Both", "Both", None, True), ("prg", "END CLASS", None, None, None),
    ("pas", "procedure Advance(n: Integer);", None, "Advance", True), ("pas", "procedure TCustomer.Save;", "TCustomer", "Save", True), ("pas", "  TCustomer = class(TObject)", "TCustomer", None, True), ("pas", "  TRow = packed record", "TRow", None, True),
    ("pas", "  var Total: Integer;", None, "Total", False), ("pas", "  const Limit = 10;", None, "Limit", False), ("pas", "class function Make: TOrder;", None, "Make", True),
    ("sql", "create or replace function advance(n int)", None, "advance", True), ("sql", "CREATE PROCEDURE Advance(n int)", None, "Advance", True), ("sql", "create table dbo.Orders (", "dbo", "Orders", True), ("sql", "create table [dbo].[Order Lines] (", "dbo", "Order Lines", True),
    ("sql", "create unique index IX_Orders on dbo.Orders (id)", None, "IX_Orders", True), ("sql", "create materialized view totals as", None, "totals", True), ("sql", "   or status = 1", None, None, None), ("sql", "create table if not exists t (", None, "t", True),
    ("pkb", "CREATE OR REPLACE PROCEDURE Advance(n number) IS", None, "Advance", True), ("pks", "create package body app.orders as", "app", "orders", True), ("pkb", "  cursor c_open is", None, "c_open", True),
    ("ts", "export const enum Direction {", "Direction", None, True), ("ts", "export default thing;", None, None, None), ("ts", "export const total = 1;", None, "total", False), ("ts", "export const add = (a) => {", None, "add", True), ("ts", "type Row = {", "Row", None, True),
    ("ts", "  advance(n: number): void {", None, "advance", True), ("ts", "  if (x) {", None, None, None), ("js", "function go(a) {", None, "go", True), ("js", "export async function go(a) {", None, "go", True), ("js", "  } else if (x) {", None, None, None),
    ("py", "def advance(n):", None, "advance", True), ("py", "class Order(Base):", "Order", None, True),
])
def test_declarations(extension, line, type_name, member, opens):
    found, _ = declared(extension, line)
    assert (found and found.type_name, found and found.member, found and found.opens_scope) == (type_name, member, opens)


def test_roles_come_from_sections():
    assert declared("cs", "public abstract void Go();")[1] is None
    assert declared("ts", "export interface Row {")[1] is None
    assert declared("pas", "procedure Go;")[1] is None
    assert declared("pas", "interface\nprocedure Go;")[1] == "declaration"
    assert declared("pas", "interface\nimplementation\nprocedure Go;")[1] == "implementation"
    assert declared("pas", "interface\n{ implementation\n}\nprocedure Go;")[1] == "declaration"
    assert declared("pas", "interface\n// implementation\nimplementations\nprocedure Go;")[1] == "declaration"
    assert declared("pkb", "CREATE  OR REPLACE   PACKAGE BODY app.orders AS")[1] == "implementation"
    assert declared("sql", "create package orders as\nprocedure go;")[1] == "declaration"
    assert declared("sql", "create procedure go as")[1] is None


@pytest.mark.parametrize(("extension", "text", "expected"), [
    ("cs", "using System.Text;", ["System.Text"]), ("cs", "global using System.Text.Json;", ["System.Text.Json"]), ("cs", "using static System.Math;", ["System.Math"]), ("cs", "using Grid = System.Windows.Controls.Grid;", ["System.Windows.Controls.Grid"]),
    ("cs", "        using var reader = new StreamReader(path);", []), ("cs", "        using (var scope = provider.CreateScope())", []), ("cs", "        using var a = b.c;", []), ("cs", "        Status = next;", []), ("cs", "namespace Orders.Domain;", []),
    ("cs", "/* the old shape:\nusing System.Text;\n*/\nusing System.Linq;", ["System.Linq"]), ("cs", "using System.Text; // for the builder", ["System.Text"]), ("cs", "// using System.Text;", []),
    ("prg", "#using System.Collections", ["System.Collections"]), ("prg", '#include "Common.vh"', ["Common.vh"]), ("prg", "#include <Set_Ansi.ch>", ["Set_Ansi.ch"]),
    ("ts", 'import { a, b } from "./orders";', ["./orders"]), ("ts", 'import "./orders";', ["./orders"]), ("ts", 'const m = await import("./late");', ["./late"]), ("js", 'const u = require("./util");', ["./util"]), ("ts", "export * from './all'", ["./all"]),
    ("ts", "const s = \"import x from 'no'\"", []), ("ts", "`\nimport x from 'no'\n`", []), ("ts", "x = `${require('./yes')}`", ["./yes"]), ("ts", "import(name)", []), ("ts", "import fs = require('fs');", ["fs"]),
    ("html", '  <script defer src="app.js"></script>', ["app.js"]), ("html", "<script src=x.js>", ["x.js"]), ("html", '<script data-src="no.js" src=\'yes.js\'>', ["yes.js"]), ("html", '<link rel="stylesheet" href="site.css">', ["site.css"]), ("html", '<a href="/about">About</a>', []),
    ("html", '<link href="a.css"><link href="b.css">', ["a.css", "b.css"]), ("html", '<!-- <script src="a.js"> --><script src="b.js">', ["b.js"]),
    ("css", '@import "base.css";', ["base.css"]), ("css", '@import url("base.css");', ["base.css"]), ("css", "@import url(base.css);", ["base.css"]), ("css", "  background: url(logo.png) no-repeat;", ["logo.png"]), ("css", "a { x: url('a.png'), url(b.png) }", ["a.png", "b.png"]), ("css", "/* url(no.png) */", []),
    ("pas", "unit C;\ninterface\nuses\n  Vcl.Forms, Vcl.Dialogs,\n  System.SysUtils;\nimplementation\nuses Orders, Invoices;\nend.", ["Vcl.Forms", "Vcl.Dialogs", "System.SysUtils", "Orders", "Invoices"]),
    ("pas", "uses\n  Vcl.Forms,\nprocedure Advance(n: Integer);\nuses B;", ["Vcl.Forms", "B"]), ("pas", "uses A in 'a.pas', B;", ["A", "B"]), ("sql", "create table t (a int)", []),
])
def test_imports(extension, text, expected):
    assert [name for name, _ in imports(extension, text)] == expected


def test_import_references():
    assert kinds("pas", "uses Vcl.Forms,\n  Vcl.Dialogs;\nVcl.Dialogs.Show;", "Dialogs") == ["import", "member_access"]
    assert kinds("cs", "using Shop;\nvar shop = new Shop();", "Shop") == ["import", "instantiation"]
    assert kinds("py", "import Shop\nfrom Shop import a", "Shop") == ["import", "import"]
