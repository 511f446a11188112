"""Units of brace languages with strings, comments, templates and regular expressions in their way."""

from spanlake.functions.extract import EXTRACTORS
from spanlake.functions.lexer import code_only, pairs

JS = r'''
// { not a block
function a() {
  const s = "}"; const t = '{'; const u = `}${ f({ x: `}${1}{` }) }{`;
  return /[}/]{2}/.test(s) || s / 2 / 3;
}
/* function hidden() { */
function b(
  x = ")",
  y
) {
  // {
  return x;
}
const c = (x) =>
  x.map((y) => ({ y }))
   .filter(Boolean);
const d = async (x) => {
  return "function e() {";
};
class K extends Base
{
  static async run(x: string): Promise<void> { if (x) { this.go(`}`); } }
  private stop() { }
}
const text = `
function inTemplate() {
}
`;
namespace Shop {
  export function price(a: number) { return "}"; }
  export class Cart {
    add() { return 1; }
  }
}
@Controller('users')
class Users {
  /** All. */
  @Get('/all')
  list() { return []; }
  @RequestMapping("/one")
  one() { return 1; }
}
'''

GO = '''package p
// Run {
func Run(a int) error {
\ts := `}
func fake() {`
\tr := '{'
\treturn do(s, r, "}\\"{")
}
func Next() {}
type S struct { // }
\tx int
}
'''

JAVA = '''public class A {
  // {
  String s = "}";
  char c = '}';
  String t = """
    void fake() { "
    """;
  public int add(int a,
      int b) { return a + b; } // }
  void last() throws E
  {
    call("{");
  }
}
class B { }
'''


def units(ending, source):
    return {u["name"]: u for u in EXTRACTORS[ending](source, f"x{ending}", "x")}


def lines(source, unit):
    return source.split("\n")[unit["start_line"] - 1].strip(), source.split("\n")[unit["end_line"] - 1].strip()


def test_javascript():
    u = units(".ts", JS)
    assert set(u) == {"a", "b", "c", "d", "K", "run", "stop", "Shop", "price", "Cart", "add", "Users", "list", "one"}
    at = lambda n: (u[n]["start_line"], u[n]["end_line"])
    assert at("a") == (3, 6) and at("b") == (8, 14) and at("c") == (15, 17) and at("d") == (18, 20)
    assert at("K") == (21, 25) and at("run") == (23, 23) and u["run"]["qualified_name"] == "x.K.run"
    assert (u["Shop"]["unit_type"], at("Shop")) == ("namespace", (30, 35)) and u["price"]["qualified_name"] == "x.Shop.price" and u["add"]["qualified_name"] == "x.Shop.Cart.add"
    assert (u["list"]["route_path"], u["one"]["route_path"], u["list"]["docstring"], u["add"]["route_path"]) == ("GET /all", "GET /one", "All.", None)
    assert u["b"]["signature"].startswith("function b(") and u["b"]["signature"].endswith(")")


def test_the_two_faults_of_before():
    u = units(".js", 'function a() {\n  const s = "}";\n  return 1;\n}\nfunction b() {\n  // {\n  return 2;\n}\nfunction c() {\n}\n')
    assert [(n, x["start_line"], x["end_line"]) for n, x in u.items()] == [("a", 1, 4), ("b", 5, 8), ("c", 9, 10)]


def test_go():
    u = units(".go", GO)
    assert set(u) == {"Run", "Next", "S"}
    assert (u["Run"]["start_line"], u["Run"]["end_line"], u["Run"]["docstring"]) == (3, 8, "Run {") and (u["S"]["start_line"], u["S"]["end_line"]) == (10, 12)


def test_java():
    u = units(".java", JAVA)
    assert set(u) == {"A", "add", "last", "B"}
    assert (u["A"]["end_line"], u["add"]["start_line"], u["add"]["end_line"], u["last"]["start_line"], u["last"]["end_line"]) == (14, 8, 9, 10, 13)


def test_code_only_keeps_places():
    for language, source in (("javascript", JS), ("go", GO), ("java", JAVA)):
        code = code_only(source, language)
        assert len(code) == len(source) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(source) if c == "\n"]
        assert all(c == s or c == " " for c, s in zip(code, source, strict=True)) and "fake" not in code and "hidden" not in code


def test_unfinished_texts_end():
    for source in ('f("', "`${`${", "/* ", "'\n}", "`", "/", "x = /a", '"""', "}}}", "((", "function a() {", "class A", "const a = (b) =>", "a\\"):
        for ending in (".js", ".go", ".java"):
            list(EXTRACTORS[ending](source, "x", "x"))
    assert pairs("{(}") == {0: 2, 1: 2} and pairs("(") == {0: 0}
