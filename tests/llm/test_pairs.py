import pytest

from strataq.llm.lexing import GO, OTHER, SCRIPT, VUE, language, lex
from strataq.llm.pairs import documented, is_trivial, pairs

FILES = "file_id long, file_name string, code_language string, body string, kind string, text string, line int, module_path string"


def run(spark, *bodies, op=documented):
    rows = [(i, name, lang, body, "x", "y", 0, "m") for i, (name, lang, body) in enumerate(bodies)]
    return op(spark.createDataFrame(rows, FILES))


def found(spark, name, body, lang=None):
    return [(r["line_no"], r["element_name"]) for r in run(spark, (name, lang, body)).orderBy("line_no").collect()]


GO_FILE = """package p

import "x"

// F adds what it is given.
func F(a int) {
	s := "func g() {" + `
// no doc
func raw() {
` // }
	r := '{'
	// inner does things
	inner := func(x int) int {
		return x
	}
}

// Gap is not attached.

func Gap() {}

// G prints the page.
//
//go:noinline
func (r *Tree[K, V]) G(
	a map[string]struct{},
) struct{} { return struct{}{} }

/* H has a block
comment. */
func (T) H()

var x = 1 // beside
func I() {}

/* a block */
// and a line make one text.
func J[T any](v T) { }
func K() {}

type S struct {
	// func in a struct
	f func() // func
}

// TODO
func L() {}

// The last one works.\r
func (t *T) M() {}\r
"""


def test_go(spark):
    assert found(spark, "a\\b.go", GO_FILE) == [(6, "F"), (25, "(*Tree[K, V]).G"), (31, "(T).H"), (38, "J"), (50, "(*T).M")]


TS_FILE = """import { a } from 'b'

/** Adds the numbers. */
export async function add<T>(a: T[]) {
  const s = `text ${a.map(x => `}${x}{`)} /** no */
function no() {}
`
  /** Nested, not counted. */
  function nested() { return /[{"']/.test(s) }
}

/** Says hello to them. */
export const hello = async (name: string): Promise<void> => {
  if (a) { return }
}

/** Bound the older way. */
const old = function () {}

/** No function at all. */
export const table = { a: 1 }
/** A call is none. */
const called = wrap(() => { return 1 })

/** Short arrow of one. */
const one = x => x

/** A class of things. */
export default class Store extends Base<{ a: 1 }> {
  /** Field of it. */
  private items: string[] = []
  /** Builds the store. */
  constructor(private a: string) { super() }
  /** Reads the items. */
  get all(): string[] { return this.items }
  /** Puts one of them. */
  static async put<K>(
    k: K,
  ): Promise<void> {
    /** called, not declared */
    this.run(k)
  }
  // Line comments are none.
  run(k: any) {}
  /** Steps aside. */
  // eslint-disable-next-line
  step() {}
  /** Property with a function. */
  arrow = () => {}
}

const obj = {
  /** Method of an object. */
  method() { return 1 }
}

/** @internal */
function tagged() {}

/** After everything else. */
function last() {}
"""


def test_typescript(spark):
    want = [(4, "add"), (13, "hello"), (18, "old"), (26, "one"), (33, "Store.constructor"), (35, "Store.all"), (37, "Store.put"), (61, "last")]
    assert found(spark, "x/a.ts", TS_FILE) == want
    assert found(spark, "x/a.ts", TS_FILE.replace("\n", "\r\n")) == want


def test_methods_named_like_keywords(spark):
    names = ["delete", "catch", "return", "throw", "with", "import", "new", "for", "if", "in", "of", "function"]
    body = "export class Box {\n" + "".join(f"  /** Says what {n} does here. */\n  {n}(x) {{\n    /** No method at all. */\n    if (x) {{ return (x) }}\n    /** Nor is this one. */\n    for (const y of x) {{\n      y()\n    }}\n  }}\n" for n in names)
    body += "  /** Makes one of them. */\n  static of(x) { return x }\n}\n/** No function either. */\nif (a) {\n  /** Nor this one. */\n  while (a) { a() }\n}\n/** Works after them. */\nfunction last() {}\n"
    assert [n for _, n in found(spark, "a.ts", body)] == [f"Box.{n}" for n in names] + ["Box.of", "last"]
    code = {r["element_name"]: r["code"] for r in run(spark, ("a.ts", None, body), op=pairs).collect()}
    assert code["Box.of"].strip() == "static of(x) { return x }" and code["Box.if"].endswith("y()\n    }\n  }")


def test_vue_reads_its_scripts_only(spark):
    body = "<template>\n<pre>/** Shows code. */\nfunction no() {}</pre>\n</template>\n<!-- <script>\n/** Commented out here. */\nfunction gone() {}\n</script> -->\n<script setup lang=\"ts\">\n/** Picks the colour. */\nfunction pick() {}\n</script>\n<style></style>\n<script>\n/** Second of two. */\nexport const two = () => 1\n</script>\n"
    assert found(spark, "c.vue", body) == [(11, "pick"), (16, "two")]


def test_odd_rows(spark):
    doc = "// F does it.\nfunc F() {}\n"
    rows = [("a.go", None, None), ("a.go", None, ""), ("b.txt", "Rust", doc), (None, "Go", doc), ("a.go", "Go", doc), ("a.go", "Go", doc), ("u.go", "Go", "// Open has no end.\nfunc Open() {"), ("v.go", "Go", 'func f() { "open\n/* open')]
    got = sorted((r["file_id"], r["element_name"]) for r in run(spark, *rows).collect())
    assert got == [(3, "F"), (4, "F"), (5, "F"), (6, "Open")]
    assert run(spark, *rows).where("false").count() == 0


def test_a_very_long_text(spark):
    body = "// F does it.\nfunc F() {\n" + "\tx(\"\\\\x\")\n" * 50_000 + "}\n" + "var s = `" + "{" * 500_000 + "`\n// G too.\nfunc G() {}\n"
    assert [n for _, n in found(spark, "a.go", body)] == ["F", "G"]


def test_code_of_pairs(spark):
    got = {r["element_name"]: (r["doc"], r["code"]) for r in run(spark, ("a.go", None, GO_FILE), ("b.ts", None, TS_FILE), op=pairs).collect()}
    assert got["F"][1].startswith("func F(a int) {") and got["F"][1].endswith("\n\t\treturn x\n\t}\n}")
    assert got["(*Tree[K, V]).G"][1].endswith(") struct{} { return struct{}{} }")
    assert got["(T).H"][1] == "func (T) H()" and got["J"][0] == "/* a block */\n// and a line make one text."
    assert got["one"][1].rstrip() == "const one = x => x" or got["one"][1].startswith("const one")
    assert got["Store.all"][1].strip() == "get all(): string[] { return this.items }"
    assert got["Store.put"][1].endswith("this.run(k)\n  }")


@pytest.mark.parametrize(
    "doc, element",
    [
        ("// TODO", "F"), ("// FIXME: write this comment", "F"), ("/** */", "f"), ("//", "F"), ("// =====\n// -----", "F"), ("// ===== store =====", "F"), ("// LoadItem ...", "LoadItem"), ("// load item", "(*T).LoadItem"),
        ("//go:noinline", "F"), ("//nolint:funlen", "F"), ("/** @internal */", "f"), ("/**\n * @param a\n * @returns {number}\n */", "f"), ("// x.Do(y)\n// return nil, z", "F"), ("/** constructor */", "C.constructor"), ("// TBD", "F"), ("// N/A", "F"), ("// XXX\r", "F"),
        ("// Loads the item", "LoadItem"), ("// TallyRoute tallies the routes.", "TallyRoute"), ("/** Hashes the voucher. */", "Cache.hashVoucher"), ("// Trimmed the window", "trimWindow"), ("// Adds to the set", "(*Set).Add"),
    ],
)
def test_trivial(doc, element):
    assert is_trivial(doc, element)


@pytest.mark.parametrize("doc, element", [("// Loads the items of one day", "LoadItem"), ("// init packs the shard.", "init"), ("// F adds.\n//\n//nolint:funlen", "F"), ("/** Adds.\n * @returns {number} */", "sum"), ("// TODO: the caller has to hold the lock while this runs", "F"), ("// Returns nil if the name is unknown.", "F"), ("// größer als null", "F")])
def test_not_trivial(doc, element):
    assert not is_trivial(doc, element)


@pytest.mark.parametrize("doc, element", [("// Add inserts an item into the set.", "(*Set).Add"), ("// Write flushes the buffer to disk.", "Write"), ("// Insert places v before the head.", "Insert"), ("/** Add text */", "Note.add"), ("/** Add a user to the group */", "join"), ("// needs reports a missing lock", "needs"), ("// Missing keys give zero.", "Get")])
def test_a_sentence_that_starts_like_a_placeholder(doc, element):
    assert not is_trivial(doc, element)


@pytest.mark.parametrize("doc", ["// Add description", "// add a description here.", "/** Insert comment here */", "// Write documentation", "// missing docs", "// Needs documentation.", "// pending", "// needs to be documented", "// Lorem ipsum dolor sit amet"])
def test_placeholders_with_a_verb(doc):
    assert is_trivial(doc, "Load")


def test_languages():
    assert [language(n, c) for n, c in (("a.GO", None), ("a.mjs", None), ("a.vue", "x"), ("noext", " typescript "), ("a.rs", "Rust"), (None, None))] == [GO, SCRIPT, VUE, SCRIPT, OTHER, OTHER]
    assert [t[4] + t[5] for t in lex("func f() {}", "a.go", None)] == ["hfunc", "wf", "O(", "C)", "O{", "C}"]


def test_a_row_delivered_again_counts_once(spark):
    rows = [(1, "a.ts", None, TS_FILE, "x", "y", 0, "m")] * 2 + [(1, "a.go", None, GO_FILE, "x", "y", 0, "m")]
    got = documented(spark.createDataFrame(rows, FILES)).collect()
    assert sorted(r["element_name"] for r in got) == sorted(["add", "hello", "old", "one", "Store.constructor", "Store.all", "Store.put", "last", "F", "(*Tree[K, V]).G", "(T).H", "J", "(*T).M"])


SCRIPT_HEADS = [
    ("/** Takes many things in. */\nconst deep = (a = ((((((b)))))), { c, d }: { c: any; d: Array<string> }) => c\n", "deep"),
    ("/** Parted over lines. */\nexport const parted = (\n  a: number,\n  b = wrap(1),\n): Promise<void> => {\n  a()\n}\n", "parted"),
    ("/** Typed as a function. */\nconst typed: (a: number) => void = async (a) => { a }\n", "typed"),
    ("/** Begins on the next line. */\nconst late =\n  function* () { return 1 }\n", "late"),
    ("/** Generic in its types. */\nconst generic = <T extends { a: 1 }>(x: T): T => x\n", "generic"),
    ("/** Divides by a long name. */\nconst half = a / " + "x" * 40 + " / 2\n/** Looks for brackets. */\nfunction look(s) { return     /* a comment that is long enough */     /[({]/.test(s) }\n", "look"),
]


@pytest.mark.parametrize("body, name", SCRIPT_HEADS)
def test_heads_of_scripts(spark, body, name):
    tail = "/** Comes after it all. */\nfunction after() {}\n"
    assert [n for _, n in found(spark, "a.ts", body + tail)] == [name, "after"]


@pytest.mark.parametrize("body", ["/** No function here. */\nconst a = cond ? (x) => 1 : y\n", "/** Nor in a call. */\nconst b = memo(() => {\n  go()\n})\n", "/** Nor a group. */\nconst c = (a + b)\n", "class\nA\n{\n  /** Field of it, no more. */\n  x: (a) => void\n}\n"])
def test_no_heads(spark, body):
    assert found(spark, "a.ts", body) == []


def test_class_heads(spark):
    body = "abstract class A\n  extends B<{ x: 1 }>\n{\n  /** Counts what is there. */\n  protected abstract count<K extends { a: string }>(x: K): number;\n  /** Walks all of them. */\n  async *walk() { yield 1 }\n}\nif (a) {\n  /** Not a method at all. */\n  call(a)\n}\n"
    assert [n for _, n in found(spark, "a.ts", body)] == ["A.count", "A.walk"]
