import json
import subprocess

import pytest

from strataq.__main__ import run


@pytest.fixture(scope="module")
def module(tmp_path_factory):
    root = tmp_path_factory.mktemp("m")
    (root / "go.mod").write_text("module example.com/m\n")
    for name, body in {
        "a/a.go": 'package a\n\nimport "example.com/m/b"\n\n// A does.\nfunc A(x, y, z, u, v int) {\n\tfor range 3 {\n\t\tfor range 4 {\n\t\t}\n\t}\n\tb.B()\n}\n',
        "b/b.go": "package b\n\nfunc B() {}\n",
        "b/b_test.go": "package b\n\nfunc Broken( {\n",
        "web/x.ts": "export const Tone = 'same words'\n",
        "web/y.ts": "export const Tone = 'same words'\n",
        "gen/g.go": "package gen\n",
        "c/c.go": "// Code generated by x. DO NOT EDIT.\npackage c\n",
    }.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(body)
    return root


def write(root, name, value):
    (root / name).write_text(value if isinstance(value, str) else json.dumps(value))
    return str(root / name)


def test_scan(spark, module):
    rows = json.loads(run(["scan", str(module), "--format", "json", "--prefix", "pre"], spark)[0])
    assert [(r["rule"], r["filename"], r["element"]) for r in rows] == [("PARAMETER_RISK", "pre/a/a.go", "A"), ("NESTED_LOOP", "pre/a/a.go", "A"), ("MISSING_DOC_COMMENT", "pre/b/b.go", "B")]
    reviewed = {"acceptances": [{"rule": "NESTED_LOOP", "file": "a/a.go", "element": "A", "count": 1, "reviewed": "2031", "reason": "bounded"}]}
    text, code = run(["scan", str(module), "--acceptances", write(module, "acc.json", reviewed)], spark)
    assert code == 0 and "bounded" in text and next(x for x in text.splitlines() if x.startswith("NESTED_LOOP")).split()[1:] == ["0", "0", "0", "1"]
    reviewed["acceptances"][0]["count"] = 2
    text, code = run(["scan", str(module), "--acceptances", write(module, "acc2.json", reviewed)], spark)
    assert code == 2 and "claims 2, matched 1" in text
    assert run(["scan", str(module), "--fail-on", "high risk", "--format", "csv"], spark)[1] == 2
    config = write(module, "cfg.json", {"disabled_rules": ["PARAMETER_RISK", "NESTED_LOOP", "MISSING_DOC_COMMENT"]})
    assert json.loads(run(["scan", str(module), "--format", "json", "--config", config], spark)[0]) == []
    with pytest.raises(OSError):
        run(["scan", str(module / "a")], spark)


def test_profile(spark, module):
    comps = write(module, "comps.json", {"decided": "2031", "components": [{"name": "one", "paths": ["a"], "reason": "r"}, {"name": "two", "paths": ["b"], "reason": "r"}]})
    snap = run(["scan", str(module), "--format", "snapshot", "--components", comps, "--taken", "t"], spark)[0]
    go = json.loads(snap)["languages"][0]
    assert go["language"] == "Go" and go["files_scanned"] == 2 and go["measures"]["unit_interfacing >= 5"] > 0 and go["entanglement"]["lines"] == 1
    base = json.loads(snap)
    base["languages"][0]["measures"]["unit_size > 15"] = 50.0
    text, code = run(["scan", str(module), "--format", "profile", "--baseline", write(module, "base.json", base)], spark)
    assert code == 0 and "| Go | unit_size > 15 | 50 | 0 | -50 |" in text
    other = write(module, "ts.json", {"language": "TypeScript", "non_unit_loc": 2, "units": []})
    text, code = run(["scan", str(module), "--format", "profile", "--units", other], spark)
    assert code == 2 and "Not measured." in text
    with pytest.raises(ValueError, match="no component"):
        run(["scan", str(module), "--format", "modules", "--components", write(module, "c2.json", {"decided": "d", "components": [{"name": "one", "paths": ["a"], "reason": "r"}]})], spark)


def test_profile_of_external_modules(spark, module):
    lines = [f"line {i}" for i in range(8)]
    one = lambda name, coupled: {"file": name, "loc": 8, "in_modules": coupled, "in_refs": coupled, "component": "x", "in_cross_component": coupled, "lines": lines}
    unit = {"element": "f", "file": "p.ts", "line": 1, "loc": 8, "mccabe": 1, "params": 0}
    claims = lambda *m: {"language": "TypeScript", "non_unit_loc": 0, "units": [unit], "modules": [one("p.ts", 11), one("q.ts", 0)], "module_metrics": list(m)}
    text, code = run(["scan", str(module), "--format", "profile", "--units", write(module, "d.json", claims("duplication"))], spark)
    part = text.split("## TypeScript")[1].split("\n## ")[0]
    assert code == 0 and "8 of 16 lines (50.0 %)" in part and "### Modules" not in part
    rolled = text.split("## combined")[1].split("\n## ")[0]
    assert "### Duplication" in rolled and "### Modules" not in rolled and "No verdict" in rolled
    both = claims("duplication", "coupling") | {"components_decided": "2031", "component_edges": [{"from": "x", "to": "y", "weight": 3}]}
    text = run(["scan", str(module), "--format", "profile", "--units", write(module, "e.json", both)], spark)[0]
    part = text.split("## TypeScript")[1].split("\n## ")[0]
    assert "| > 10 | 1 | 8 | 50.0 | 10.0 | over by 7 lines |" in part and "50.0 % of 16 lines hidden" in part and "1 line between 2 components" in part
    assert "### Modules" in text.split("## combined")[1].split("\n## ")[0]


def test_tools_and_publishing(spark, module):
    wanted = {"golangci-lint": {"command": ["echo", "golangci-lint has version v2.1.0 built"], "wanted": "2.1.0"}, "govulncheck": {"command": ["echo", "Go: go1.20.1"], "wanted": "1.21"}}
    text, code = run(["tools", write(module, "tools.json", wanted)], spark)
    assert code == 2 and text == "golangci-lint: ok, 2.1.0 (wanted 2.1.0)\ngovulncheck: mismatch, 1.20.1 (wanted 1.21)\n"
    text, _ = run(["publish", str(module), write(module, "issues.json", [{"number": 4, "title": "old", "body": "<!-- quality:NESTED_LOOP -->", "state": "open"}])], spark)
    assert "create Parameter risk: 1 finding\n" in text and len(text.splitlines()) == 3


def test_declarations(spark, module):
    text, code = run(["declarations", "--root", str(module / "web"), "--root", str(module / "none"), "--json", "--strict"], spark)
    found = json.loads(text)
    assert code == 1 and found["scanned"] == 2 and {f["check"] for f in found["findings"]} == {"value", "name"}


def test_gates(spark, module):
    head = "language,element,file,line,loc,mccabe,params\n"
    before, after = write(module, "b.csv", head + "Go,F,a.go,1,90,1,0\n"), write(module, "a.csv", head + "Go,F,a.go,1,10,1,0\nGo,G,a.go,20,100,1,0\n")
    assert run(["delta", before, after, "--floor", "0.9"], spark)[1] == 1 and run(["delta", before, before, "--floor", "0.9"], spark)[1] == 0
    with pytest.raises(ValueError):
        run(["delta", write(module, "e.csv", head), write(module, "f.csv", head)], spark)
    prof = write(module, "c.out", "mode: set\nexample.com/m/a/a.go:1.1,2.2 3 1\nexample.com/m/b/b.go:1.1,2.2 1 0\nexample.com/m/c/c.go:1.1,2.2 9 0\n")
    text, code = run(["coverage", prof, str(module), write(module, "floor", "80\n")], spark)
    assert code == 1 and text.startswith("75.0 % of 4 statements covered, floor 80.0; 9 generated left out; 1 statement short")
    assert run(["coverage", prof, str(module), write(module, "floor2", "70%\n")], spark)[1] == 0
    theirs = write(module, "t.csv", "60,1,30,0,6,loc,a.go,F,F( x ),1,9\n")
    assert "loc: 1 matched, 0 equal, median ratio 1.500, 1 outside" in run(["agreement", before, theirs], spark)[0]


def test_changes(spark, module, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.go").write_text("package p\n// one\nfunc f() {}\n")
    (tmp_path / "b.go").write_text("package p\nfunc g() {}\n")
    git("add", "-A"), git("commit", "-qm", "one")
    (tmp_path / "a.go").write_text("package p\n// two\nfunc f() {}\n")
    (tmp_path / "b.go").write_text("package p\nfunc h() {}\n")
    text, code = run(["changes", str(tmp_path), "HEAD"], spark)
    assert code == 0 and text == "M b.go\n1 file changed in comments only\n  a.go\n"
