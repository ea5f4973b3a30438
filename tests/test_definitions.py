"""Definitions of brace languages against trees made by hand, and sources that have none."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import chunking, definitions

TS = r"""import { a } from "./a"; // class Not {}
/* function not() {} */
const limit = 3, other = 4
let text = `x ${ [1].map(v => { return `}${v}`; }) } {`;
const { p, q } = load()
  .then(x => { return x })

export const shown = () => { return 1 }
export default class Out { run() {} }

function typed<T extends { a: string }>(x: T, y = { b: "}" }): { c: number } {
  return { c: /[}/]{2}/.test("a") ? 1 : x.a.length / 2 }
}

interface Shape<T> extends Base { area(): number; name?: string }

@Component({ selector: "app" })
@sealed
class View<T> extends Base<T> implements A, B {
  private count: number = 0;
  handler = async () => { this.count++; };
  constructor(private readonly x: number) { super(); }
  @Input() get value(): string { return this.#secret(); }
  static async *items(): AsyncGenerator<number> { yield 1 }
  #secret() { if (this.count) { return "}" } return '{' }
  overload(a: string): void;
  overload(a: any): void { class Inner { deep() {} } }
  ["computed"]() {}
  last = 1
}

abstract class Shapes { abstract area(): number }
enum Color { Red }
async function load() {}
"""
TS_TREE = [
    ("limit", "variable", []),
    ("text", "variable", []),
    ("p", "variable", []),
    ("typed", "function", []),
    ("Shape", "interface", []),
    ("View", "class", ["constructor", "value", "items", "secret", "overload", ""]),
    ("Shapes", "class", []),
    ("load", "function", []),
]
JAVA = r'''package p;
import java.util.*;

/** class Not {} */
@Entity(name = "x{")
@Deprecated
public final class Box<T extends Comparable<T>> extends Base implements A<T>, B {
  private static final Map<String, List<T>> ITEMS = new HashMap<>() {{ put("}", null); }};
  static { init(); }
  private int size =
    compute();
  public Box() { this(1); }
  @Override
  public <R> List<R> map(Function<? super T, ? extends R> f) throws IOException, E { return null; }
  abstract int[] plain(int... a);
  private static class Inner { void deep() {} }
  String text() { return """
    a "quoted" } text
    """; }
  char c() { return '}'; }
}

interface Shape { double area(); default void x() {} }
enum Color { RED { int f() { return 1; } } }
@interface Note { String value(); }
record Point(int x, int y) { int sum() { return x + y; } }
class Empty {}
'''
JAVA_TREE = [("Box", "class", ["Box", "map", "plain", "text", "c"]), ("Shape", "interface", []), ("Empty", "class", [])]
GO = """package main // func not() {

import (
	"fmt"
)

const text = `raw } "string"`
var f = func(a int) int { return a }

type Pair struct { a, b int }
type (
	First int
	Second string
)
type Any interface { M() }
type Alias = map[string]interface{}

// Add adds.
func Add(a, b int) (sum int, err error) {
	r := '}'
	return a + b, nil
}

func Map[T any, R any](xs []T, f func(T) R) []R { return nil }
func none() interface{} { return struct{}{} }
func (p *Pair) Sum() int { if p.a > 0 { return p.a } ; return p.b }
func (Pair) Chan() <-chan struct{} { return nil }
"""
GO_TREE = [
    ("Pair", "type", []), ("First", "type", []), ("Any", "type", []), ("Alias", "type", []), ("Add", "function", []), ("Map", "function", []),
    ("none", "function", []), ("Sum", "method", []), ("Chan", "method", []),
]
RUST = r"""//! fn not() {}
use std::{fmt, io};
/* outer /* nested } */ still { */
const N: usize = { 3 };
static T: &str = r#"raw " } text"#;

#[derive(Debug, Clone)]
pub struct Point<'a, T: 'a> where T: Fn(i32) -> bool { x: &'a T, c: char }
struct Unit;
pub(crate) struct Pair(i32, i32);

#[cfg(test)]
pub enum E { A { x: i32 }, B(char) }

pub unsafe trait Shape: Base { fn area(&self) -> f64; fn twice(&self) -> f64 { 2.0 } }

impl<'a, T: Fn(i32) -> bool> Point<'a, T> {
    pub const LIMIT: u8 = b'}';
    #[inline]
    pub async fn get<'b>(&'b self, f: impl Fn() -> char) -> Result<(), io::Error> where T: Copy { let c = '{'; Ok(()) }
    fn set(&mut self) { fn inner() {} }
    pub(super) const unsafe extern "C" fn raw() {}
}
impl fmt::Display for Unit { fn fmt(&self) -> fmt::Result { write!(f, "}}{{") } }
impl Empty for Unit {}
mod tests { fn not() {} }
macro_rules! m { ($x:expr) => { fn not() {} } }
pub async fn main() -> Result<(), Box<dyn Error>> { loop { break } }
"""
RUST_TREE = [
    ("Point", "struct", []), ("Unit", "struct", []), ("Pair", "struct", []), ("E", "enum", []), ("Shape", "trait", []), ("Point", "impl", ["get", "set", "raw"]),
    ("Display", "impl", ["fmt"]), ("Empty", "impl", []), ("main", "function", []),
]
CPP = r"""#include <vector>
#define OPEN { \
  more {
using namespace std;
namespace n { int hidden() { return 1; } }
template <typename T> T largest(T a, T b) { return a > b ? a : b; }
typedef struct { int x; } Named;
struct Later;
struct Plain { int a; } one;

static const std::vector<int>& table(int n = 3) noexcept { return *new std::vector<int>{1, 2}; }
Box::Box(int a) : base(a), items{1, 2}, last(3) { if (a) { } }
Box::~Box() {}
bool Box::operator==(const Box& o) const { return true; }
auto late(int x) -> decltype(x) { return x; }

class EXPORT Box final : public Base<int>, private Other {
 public:
  Box() = default;
  explicit Box(int a);
  virtual int get() const override { return R"x(})x"[0]; }
  Box& operator=(const Box& o) { return *this; }
  ~Box() { }
 private: int hidden() { auto f = [](int a) { return a; }; return f('}'); }
  template <class U> void more(U u) { }
  struct Inner { int deep() { return 1; } };
  int field = 3;
};
struct Small { int one() { return 1; } };
extern "C" { int c_name(void) { return 0; } }
int main() { for (;;) { } }
"""
CPP_TREE = [
    ("table", "function", []), ("Box", "function", []), ("~Box", "function", []), ("operator==", "function", []), ("late", "function", []),
    ("Box", "class", ["Box", "get", "operator=", "~Box", "hidden"]), ("Small", "struct", ["one"]), ("main", "function", []),
]
C = """/* int not(void) { */
struct point { int x; };
enum color { RED };
typedef int (*callback)(int);
int table[] = { 1, 2 };
static inline struct point *
make(int a, char b)
{
  char c = '"', d = '\\'';
  if (a) { return 0; }
  return 0;
}
void run(void (*f)(int)) { f(1); }
int declared(int);
"""
C_TREE = [("point", "struct", []), ("make", "function", []), ("run", "function", [])]
ALL = [("TypeScript", TS, TS_TREE), ("TypeScript (React)", TS, TS_TREE), ("Java", JAVA, JAVA_TREE), ("Go", GO, GO_TREE), ("Rust", RUST, RUST_TREE), ("C++", CPP, CPP_TREE), ("C", C, C_TREE)]


@pytest.mark.parametrize("language,source,want", ALL, ids=[x[0] for x in ALL])
def test_trees(language, source, want):
    assert [(d.name, d.kind, [m.name for m in d.members]) for d in definitions.find(source, language)] == want


@pytest.mark.parametrize("language,source,want", ALL, ids=[x[0] for x in ALL])
def test_spans_are_in_order_and_end_where_they_should(language, source, want):
    at = 0
    for d in definitions.find(source, language):
        assert at <= d.start < d.end
        inner = d.start
        for m in d.members:
            assert inner < m.start < m.end <= d.end and source[m.end - 1] in "};"
            inner = m.end
        at = d.end
        assert source[d.end - 1] in "};)" or d.kind in ("variable", "type")


def test_decorators_and_attributes_belong_to_their_definition():
    found = {d.name: TS[d.start : d.end] for d in definitions.find(TS, "TypeScript")}
    assert found["View"].startswith("@Component") and found["limit"] == "const limit = 3, other = 4" and found["p"].endswith("return x })")
    view = next(d for d in definitions.find(TS, "TypeScript") if d.name == "View")
    assert TS[view.members[1].start : view.members[1].end].startswith("@Input() get value")
    assert RUST[definitions.find(RUST, "Rust")[0].start :].startswith("#[derive")
    assert JAVA[definitions.find(JAVA, "Java")[0].start :].startswith("@Entity")


def test_pieces():
    got = chunking.by_definition(TS, "TypeScript")
    assert [(p.symbol_name, p.symbol_type, p.parent_symbol) for p in got if p.parent_symbol] == [(m, "method", "View") for m in ["constructor", "value", "items", "secret", "overload", ""]]
    loose = [p.text for p in got if not p.symbol_type]
    assert loose[0].startswith("import") and any("export const shown" in t and "export default class Out" in t for t in loose) and loose[-1] == "enum Color { Red }"
    assert got[-1].symbol_name == "load"
    rust = chunking.by_definition(RUST, "Rust")
    assert {p.symbol_type for p in rust if p.parent_symbol} == {"method"} and any(p.text == "# (method of Point)\nfn set(&mut self) { fn inner() {} }" for p in rust)


def test_comments_between_python_definitions_are_kept():
    got = chunking.by_definition("# about f\ndef f():\n    pass\n# the end\n", "Python")
    assert [(p.text, p.symbol_name) for p in got] == [("# about f", ""), ("def f():\n    pass", "f"), ("# the end", "")]
    assert [(p.text, p.symbol_name) for p in chunking.by_definition("x = 'ü'\ndef é():\n    'ß'\ny = 1", "Python")] == [("x = 'ü'", ""), ("def é():\n    'ß'", "é"), ("y = 1", "")]


@pytest.mark.parametrize("language", definitions.LANGUAGES)
@pytest.mark.parametrize("source", ["int f() { (", "}", "f(]", "a { b } }", "/* never", "x = {`"])
def test_broken_sources_are_cut_by_separators(language, source):
    if source == "x = {`" and language not in (*definitions.SCRIPTS, "Go"):
        source = "x = {"
    with pytest.raises(definitions.Broken):
        definitions.find(source, language)
    assert {m for *_, m in chunking.chunk(source, language)} == {"heuristic"}


@pytest.mark.parametrize("language", definitions.LANGUAGES)
def test_sources_without_a_definition_are_one_piece(language):
    assert definitions.find("", language) == [] and [p.text for p in chunking.by_definition("  x ( 1 ) ; \n", language)] == ["x ( 1 ) ;"]


@given(st.lists(st.sampled_from(["{", "}", "(", ")", "class A", "function f()", "fn g()", "int h(int a)", "'", '"', "`", "/", "//", "/*", "*/", "\n", ";", "=>", "${", "x", "#", "<", ">", "::", "@d", "\\"]), max_size=40), st.sampled_from(definitions.LANGUAGES))
@settings(max_examples=400, deadline=None)
def test_any_source_has_pieces_or_is_broken(parts, language):
    source = " ".join(parts)
    try:
        found = definitions.find(source, language)
    except definitions.Broken:
        return
    assert all(a.end <= b.start for a, b in zip(found, found[1:]))
    kept = "".join("".join(p.text.split()) for p in chunking._pieces(source, found) if not p.parent_symbol).replace(";", "")
    whole = "".join(source.split()).replace(";", "")
    assert len(kept) <= len(whole)
    if not any(d.members for d in found):
        assert kept == whole
