import random

import pytest

from strataq.llm import handwritten as h

OWN = "// Copyright 2031 The Quill Project.\n// Internal source; see LICENSE.\n\n"


@pytest.mark.parametrize(
    "head, want",
    [
        ("// Code generated by x v1.2. DO NOT EDIT.\npackage p", "tool"), (OWN + "// Code generated by x; DO NOT EDIT.\npackage p", "tool"), ("/* eslint-disable */\n// This file was automatically generated by x.\n", "tool"), ("/*\n * Generated code. Run `make x` to refresh.\n */\n", "tool"),
        ("// <auto-generated>\n//   tool: x\n// </auto-generated>\n", "tool"), ("// DO NOT EDIT: this file is written by x on every build.\n", "tool"), (OWN + "/*\nGENERATED FILE\nSource: a.proto\n*/\n", "tool"), ("//go:build !ignore\n\n// @generated by x\n", "tool"), ("/*\n * AUTO-GENERATED, do not modify by hand.\n */", "tool"),
        ("// First drafted by xgen, kept by hand ever since. Edit freely.\n", "kept"), (OWN + "// Replaces the client that x used to write; this one is ours.\n", "kept"), ("// Feeds xgen, which writes the accessors. Please do edit this file.\n", "kept"),
        ("// The writer starts each output with the line\n// Code generated by a tool. DO NOT EDIT.\n// and the gate looks for it.\npackage p", ""), ("package p\n// Code generated by x. DO NOT EDIT.\n", ""), ("const a = `\n// @generated by this, do not modify\n`", ""), ("package p\n", ""),
        (OWN + "package p", "own"), ("// Copyright 2020 The Other Authors. All rights reserved.\npackage p", "foreign"), ("/*\n * lib 1.2\n * (c) 2019 lib contributors, released under MIT\n */", "foreign"), ("// Taken from lib v1, file x. Local changes: none.\n", "foreign"), ("// This is a fork of host.example/lib at tag v1,\n", "foreign"), ("/*! lib v1 | licence in x.txt */\nvar a", "banner"),
    ],
)
def test_notices(head, want):
    assert h.notice(head, "quill.example/m") == want


def test_places():
    assert h.below_module("q.example\\m\\vendor\\a.go", "q.example/m") == "vendor/a.go"
    yes, no = ["vendor/a/b.go", "web/node_modules/x.js", "third_party/x.go", "src/3rdparty/x.go", "deps/x/y.go", "external/x.go"], ["vendors/x.go", "internal/thirdpartybilling/x.go", "vendor.go", "a/vendor_x/y.go", "src/depsy/x.go"]
    assert all(h.third_party("package p", f"m/{x}", "m") for x in yes) and not any(h.third_party("package p", f"m/{x}", "m") for x in no)


def test_data_and_minified():
    kind = lambda b: (h.is_data(h.features(b)), h.is_minified(h.features(b)))
    r = random.Random(1)
    table = "export const t = [\n" + "".join(f"  [{','.join(str(r.randrange(99999)) for _ in range(12))}],\n" for _ in range(40)) + "]\n"
    blob = "package p\n\n// blob is embedded.\nconst blob = `\n" + "".join(r.choices("ABCDabcd0123+/\n", k=3000)) + "`\n"
    code = "package p\n\nfunc F(a int) int {\n\tif a > 1 {\n\t\treturn a\n\t}\n\treturn compute(a)\n}\n" * 9
    mini = "!function(e,t){" + "".join(f"if({a}===t)return {b};e.x{a}=function(n){{return n?{b}:void 0}};" for a, b in zip("abcdefgh" * 9, "rstuvwxy" * 9)) + "}();"
    assert kind(table) == (True, False) and kind(blob)[0] and kind(code) == (False, False) and kind(mini) == (False, True)
    assert kind("[1, 2, 3, 'four', 5]\n") == (True, False)  # however small
    assert kind(code + 'var small = []int{1, 2, 3}\nconst icon = "' + "A" * 900 + '"\n') == (False, False)


def test_shingles_see_through_comments_and_packages():
    body = "package a\n\n// words\nfunc F(x int) {\n\treturn x + 1 // kept\n}\n"
    other = "package b\n/* other */\n\nfunc F(x int) {\n\treturn x + 1 // kept\n}\n"
    assert h.shingles(body).tolist() == h.shingles(other).tolist() and len(h.shingles("one two")) == 1 and len(h.shingles("// only\n")) == 0


FILES = "file_id long, module_path string, file_name string, code_language string, generated boolean, body string, reason string, features string"


def hand(r):
    verbs, nouns = "load store merge split walk trim pack seal".split(), "report ledger window parcel route gauge harbor quota".split()
    out = ["package p", "", 'import "context"', ""]
    for _ in range(r.randrange(4, 9)):
        v, n, m = r.choice(verbs), r.choice(nouns), r.choice(nouns)
        out += [f"// {v}{n.title()} {v}s each {n} and keeps {r.choice(nouns)} in the order given.", f"func {v}{n.title()}(ctx context.Context, {n} *{m.title()}) error {{"]
        out += [r.choice([f"\tif {n} == nil || {m}.Len() > {r.randrange(90)} {{\n\t\treturn nil\n\t}}", f"\tfor _, x := range {m}s {{\n\t\t{n}.{v.title()}(x, {r.randrange(90)})\n\t}}", f"\t{m} := {n}.{r.choice(verbs).title()}({m}, {r.randrange(90)})"]) for _ in range(r.randrange(2, 6))]
        out += ["\treturn nil", "}", ""]
    return "\n".join(out)


def made(r):
    n = r.choice("Report Ledger Window Parcel Route".split())
    return "package p\n\n" + "".join(f"func (x *{n}) Get{f}() string {{\n\tif x != nil {{\n\t\treturn x.{f}\n\t}}\n\treturn \"\"\n}}\n\n" for f in r.sample("Alpha Beta Gamma Delta Omega Sigma Theta Kappa Lambda Zeta".split(), 8))


def test_forest_and_copies(spark):
    r = random.Random(7)
    rows, want = [], set()

    def add(name, body, case, module="quill.example/m"):
        rows.append((len(rows), module, f"{module}/{name}", None, None, body, "", ""))
        if case:
            want.add(len(rows) - 1)

    for i in range(40):
        add(f"h{i}.go", OWN + hand(r), False)
        add(f"g{i}.go", "// Code generated by x. DO NOT EDIT.\n\n" + made(r), True)
    held_out = [(made(r), True) for _ in range(15)] + [(hand(r), False) for _ in range(15)]
    for i, (body, case) in enumerate(held_out):
        add(f"u{i}.go", body, case)
    lib = hand(r)
    add("vendor/lib/a.go", lib, True)
    add("internal/a.go", lib.replace("package p", "package a").replace("// ", "// own: "), True, "other.example/m")
    add("internal/part.go", "\n".join(lib.split("\n")[: int(lib.count("\n") * 0.6)]), True)
    add("internal/vendors/b.go", hand(r), False)
    add("kept.go", "// First drafted by x, kept by hand ever since.\n\n" + made(r), False)
    for body in (None, "", " \n\t\n"):
        add("empty.go", body, False)
    add("odd\\path.go", hand(r), False, None)
    df = spark.createDataFrame(rows, FILES)
    got = {x["file_id"]: x["reason"] for x in h.judged(df).collect()}
    assert {rows[i][2] for i in set(got) ^ want} == set()
    assert got[80] == "forest" and got[max(i for i, x in enumerate(rows) if x[2].endswith("internal/a.go"))] in ("forest", "copy")
    assert h.judged(df.where("false")).count() == 0
    assert h.judged(df.where("file_id < 4")).count() == 2  # too few notices for a forest


def test_third_party_shingles_of_any_number_of_files(spark):
    """More different files in one task than it remembers: all their shingles are known, repeats once."""
    n = 100_020
    files = spark.range(n + 5, numPartitions=1).selectExpr("'m' AS module_path", "'m/vendor/x.go' AS file_name", f"concat('word', id % {n}) AS body")
    assert h._third_party_shingles(files).count() == n
