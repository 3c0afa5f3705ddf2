import json
import subprocess

import pytest
from pyspark.sql import functions as F

from strataq import dims
from strataq.config import Config, load_config, scan_settings
from strataq.functions import text
from strataq.operators.changes import partition_changes
from strataq.operators.tools import tool_verdicts
from strataq.sources import records, tree
from strataq.streaming.files import each_batch, watch_tree


def over(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


@pytest.mark.parametrize("path", ["/etc/passwd", "/var/log/x", r"C:\temp\a", "~/conf", "./a/b.json", "../x/y.go", "a/b.txt", "/srv2/data/file.csv"])
def test_paths(spark, path):
    assert over(spark, text.is_filesystem_path, path, f"  {path} ") == [True, True]


@pytest.mark.parametrize("path", ["", "/", "/users", "/api/v1/users", "application/json", "a b/c.txt", "https://x.y/a/b.txt", "plain", "text/plain.x", "a/b", "x" * 201 + "/a.go", "/v1.2/x"])
def test_what_is_no_path(spark, path):
    assert over(spark, text.is_filesystem_path, path) == [False]


def test_urls(spark):
    hosts = over(spark, text.url_host, "HTTP://User:pw@Host.Example:80/p@q?x#y", "ftp://[::1]:21/x", "a://h?q/r", "x://%s/y", "x://")
    assert hosts == ["host.example", "[::1]", "h", "%s", ""]
    allowed = over(spark, text.host_allowed, "w3.org", "www.w3.org", "notw3.org", "a.example.com", "example.com", "x.test", "test", "", "svc.corp")
    assert allowed == [True, True, False, True, True, True, False, False, False]
    assert over(spark, text.hardcoded_url, "see http://w3.org/a and https://svc.corp/b)", "http://w3.org", None, "nothing") == ["https://svc.corp/b", None, None, None]


def test_comment_and_version_text(spark):
    assert over(spark, text.trim_comment, "// a ", "/* b */", "// " + "x" * 95) == ["a", "b", "x" * 87 + "..."]
    assert over(spark, lambda c: text.same_version(c, F.lit("v1.2.3")), "1.2.3", "v1.2.3", "1.2.4") == [True, True, False]
    assert over(spark, lambda c: text.at_least_version(c, F.lit("1.21")), "1.9", "1.21.0", "1.22", "2") == [False, True, True, True]
    assert over(spark, lambda c: text.rounded(c.cast("double"), 1), "0.25", "-0.25", "0.05") == [0.3, -0.3, 0.1]
    dirs = spark.createDataFrame([("a/b/c", 2), (".", 1), ("a", 5)], "d string, n int").select(text.folded_dir(F.col("d"), F.col("n")))
    assert [r[0] for r in dirs.collect()] == ["a/b", "", "a"]
    assert over(spark, lambda c: text.qualify("pre/", c), "x") == ["pre/x"] and over(spark, text.normal_path, ".\\a\\b") == ["a/b"]


@pytest.mark.parametrize("line, hit", [("// Copyright 2020 X", True), ("// copyright (c) us", True), ("// SPDX-License-Identifier: MIT", True), ("// All Rights Reserved.", True), ("// licensed under the MIT", True), ("// the copyright check", False), ("// copyrighted 2020", False)])
def test_notices(spark, line, hit):
    assert over(spark, lambda c: c.rlike(dims.NOTICE), line) == [hit]


def test_words_end_at_ascii(spark):
    assert over(spark, lambda c: c.rlike(dims.UNFINISHED), "éTODO", "xTODO", "TODO:", "TODOs") == [True, False, True, False]


def test_tools(spark):
    rows = [("golangci-lint", "golangci-lint has version v1.60.1 built", "1.60.1"), ("actionlint", "1.7.0\ninstalled", "v1.7.1"), ("govulncheck", "Go: go1.22.3\nScanner: x", "1.22"), ("govulncheck", "nothing", "1.22"), ("actionlint", "1.7.0", None)]
    got = [r["verdict"] for r in tool_verdicts(spark.createDataFrame(rows, "tool string, output string, wanted string")).collect()]
    assert got == ["ok", "mismatch", "ok", "error", "error"]


def test_config(tmp_path):
    c = Config().overlaid({"function_size": {"high": 10}, "exclude_dirs": ["x"], "unknown": 1})
    assert c.bands["FUNCTION_SIZE_RISK"] == (10, 500) and c.exclude_dirs == ["x"] and c.sql_methods == dims.SQL_METHODS
    with pytest.raises(ValueError):
        Config().overlaid({"module_coupling_counts": "files"})
    p = tmp_path / "c.json"
    p.write_text('{"include_tests": true}')
    assert load_config(str(p)).include_tests and not load_config(None).include_tests
    assert scan_settings({}, str(tmp_path / "none.json"), False)["roots"] == ["."]
    p.write_text('{"roots": ["a"], "skip_paths": ["x"]}')
    assert scan_settings({"roots": ["b"]}, str(p), True) == {"roots": ["b"], "skip_paths": ["x"], "auto_import_paths": dims.AUTO_IMPORT_PATHS}
    with pytest.raises(FileNotFoundError):
        scan_settings({}, str(tmp_path / "none.json"), True)


def dump(tmp_path, name, value):
    p = tmp_path / name
    p.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(p)


def test_acceptance_and_deviation_records(spark, tmp_path):
    good = {"rule": "R", "file": "f", "element": "e", "count": 2, "reviewed": "2031", "reason": "why"}
    assert records.acceptances(spark, dump(tmp_path, "a.json", {"note": "", "acceptances": [good]})).first()["count"] == 2
    assert records.acceptances(spark, None).count() == 0
    for bad in ({"count": 0}, {"reason": ""}, {"rule": None}):
        with pytest.raises(ValueError):
            records.acceptances(spark, dump(tmp_path, "b.json", {"acceptances": [good | bad]}))
    dev = {"language": "go", "property": "unit_size", "tail": "> 15", "decided": "d", "measured": "m", "summary": "s"}
    assert records.deviations(spark, dump(tmp_path, "d.json", {"deviations": [dev]})).count() == 1
    for rows in ([dev, dev], [dev | {"property": "nope"}], [dev | {"decided": ""}]):
        with pytest.raises(ValueError):
            records.deviations(spark, dump(tmp_path, "e.json", {"deviations": rows}))


def test_component_map(spark, tmp_path):
    comp = {"name": "a", "paths": ["/x/", "y"], "reason": "r"}
    decided, rows = records.components(spark, dump(tmp_path, "c.json", {"decided": "2031", "components": [comp]}))
    assert decided == "2031" and {r["path"] for r in rows.collect()} == {"x", "y"}
    for bad in ({"components": [comp]}, {"decided": "d", "components": []}, {"decided": "d", "components": [comp, comp]}, {"decided": "d", "components": [comp | {"reason": ""}]}):
        with pytest.raises(ValueError):
            records.components(spark, dump(tmp_path, "d.json", bad))


def test_unit_sets_and_baseline(spark, tmp_path):
    one = {"language": "ts", "non_unit_loc": 3, "units": [{"element": "f", "file": "a", "line": 1, "loc": 2, "mccabe": 1, "params": 0}], "modules": [{"file": "a", "loc": 2, "lines": ["x"]}], "module_metrics": ["coupling", "duplication"]}
    assert records.unit_sets(spark, [dump(tmp_path, "u.json", one)]).first()["units"][0]["loc"] == 2
    for bad in ({"language": " "}, {"module_metrics": ["speed"]}, {"modules": []}, {"modules": [{"file": "a"}], "module_metrics": ["duplication"]}):
        with pytest.raises(ValueError):
            records.unit_sets(spark, [dump(tmp_path, "v.json", one | bad)])
    assert records.baseline(spark, None) is None and records.baseline(spark, str(tmp_path / "none.json")) is None
    snap = {"taken": "t", "languages": [{"language": "go", "measures": {"a > 1": 2.5}}]}
    assert records.baseline(spark, dump(tmp_path, "s.json", snap)).first()["measures"] == {"a > 1": 2.5}
    with pytest.raises(Exception):
        records.baseline(spark, dump(tmp_path, "t.json", "{broken")).count()


def test_inventories(spark, tmp_path):
    csv = dump(tmp_path, "i.csv", "language,element,file,line,loc,mccabe,params,extra\ngo,F,.\\a\\b.go,3,x,2,1,low\nts,G,c.ts,4,5,6,7,high\n")
    assert [tuple(r) for r in records.unit_inventory(spark, csv).collect()] == [("go", "F", "a/b.go", 3, 0, 2, 1), ("ts", "G", "c.ts", 4, 5, 6, 7)]
    with pytest.raises(ValueError):
        records.unit_inventory(spark, dump(tmp_path, "j.csv", "language,element\ngo,F\n"))
    assert [r["name"] for r in records.inventory_by_place(spark, csv, "go").collect()] == ["F"]
    second = records.second_tool(spark, dump(tmp_path, "k.csv", "5,2,30,1,6,loc,./a.go,F,F( x ),3,9\n5,2,30,1,6,loc,b.go, ,x,4,9\n1,2\n"))
    assert [(r["file"], r["line"], r["loc"], r["anonymous"]) for r in second.collect()] == [("a.go", 3, 5, False), ("b.go", 4, 5, True)]


def test_coverage_profile_and_floor(spark, tmp_path):
    assert records.coverage_blocks(spark, dump(tmp_path, "c.out", "mode: set\nm/a:b.go:1.2,3.4 5 1\n")).first()["file"] == "m/a:b.go"
    assert records.coverage_floor("# note\n 87.5% \n") == 87.5
    for bad in ("", "1\n2", "101", "x"):
        with pytest.raises(ValueError):
            records.coverage_floor(bad)


def test_changes_from_git(spark, tmp_path):
    assert records.parse_changes("M\0a.go\0R100\0old.go\0new.go\0A\0b\0") == [("M", "a.go"), ("R", "new.go"), ("A", "b")]
    with pytest.raises(ValueError):
        records.parse_changes("R100\0old.go")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    files = {"same.go": "package p\n// one\nfunc f() {}\n", "code.go": "package p\nfunc f() {}\n", "broken.go": "package p\nfunc f() {}\n", "x.md": "a"}
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    git("add", "-A")
    git("commit", "-qm", "one")
    after = {"same.go": "package p\n\n// two, longer\nfunc f() {}\n", "code.go": "package p\nfunc g() {}\n", "broken.go": "package p\nfunc f( {}\n", "x.md": "b"}
    for name, body in after.items():
        (tmp_path / name).write_text(body)
    changes = records.git_changes(spark, str(tmp_path), "HEAD")
    base = records.git_blobs(spark, str(tmp_path), "HEAD", list(files) + ["none.go"])
    work = spark.createDataFrame(list(after.items()), "path string, body string")
    assert {r["path"]: r["exempt"] for r in partition_changes(changes, base, work).collect()} == {"same.go": True, "code.go": False, "broken.go": False, "x.md": False}


def test_tree_from_disk(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.go").write_text("package b\n")
    (tmp_path / "y.ts").write_text("export const é = 1\n")
    rows = {r["rel"]: r["body"] for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert rows == {"a/b/x.go": "package b\n", "y.ts": "export const é = 1\n"}
    assert tree.read_tree(spark, str(tmp_path / "none")).count() == 0
    assert tree.module_path("// c\nmodule example.com/m\n\ngo 1.22\n") == "example.com/m"
    with pytest.raises(ValueError):
        tree.module_path("go 1.22\n")


def test_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in" / "p").mkdir(parents=True)
    (tmp_path / "in" / "p" / "a.go").write_text("package p\nfunc F() {}\n")
    got = []
    files = watch_tree(spark, str(tmp_path / "in"), "m")
    for _ in range(2):
        each_batch(files, lambda df, n: got.extend((r["rel"], r["units"][0]["element"]) for r in df.collect()), str(tmp_path / "ck")).awaitTermination()
        (tmp_path / "in" / "p" / "b.go").write_text("package p\nfunc G() {}\n")
    assert sorted(got) == [("p/a.go", "F"), ("p/b.go", "G")]


DELIVERED = "file_id long, module_path string, file_name string, code_language string, body string, scanned_at long, module string, rel string"


def test_deliveries(spark):
    rows = [(1, "m", "m\\a\\b.go", "Go", "old", 1, "", ""), (2, "m", "m/a/b.go", "Go", "new", 2, "", ""), (3, None, "lone.go", None, None, None, "", ""), (4, "m", "m/a/b.go", "Go", "tie", 2, "", "")]
    got = {(r["module"], r["rel"], r["dir"]): r["body"] for r in tree.delivered(spark.createDataFrame(rows, DELIVERED)).collect()}
    assert got == {("m", "a/b.go", "a"): "tie", ("", "lone.go", "."): None}


def test_scripts(spark):
    names = ["a.ts", "a.test.ts", "b.vue", "node_modules/x/a.ts", "c.go", "c_test.go", "d.js", "e.mts", "__tests__/f.ts", "gen/g.ts"]
    df = spark.createDataFrame([(n, "<template>no</template><script setup>let a // x\n</script><style></style><script>let b = 'http://y' /* z */</script>") for n in names], "rel string, body string")
    got = {r["rel"]: r["text"] for r in tree.script_sources(df, ["^gen/"]).collect()}
    assert set(got) == {"a.ts", "b.vue", "c.go", "e.mts"}
    assert got["b.vue"] == "let a \n\nlet b = 'http://y' "
