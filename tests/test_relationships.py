from pyspark.sql import functions as F

from textquarry.functions.text import glob_regex, preview
from textquarry.operators import relationships as rel
from textquarry.sources.files import clean_markdown, crawl_filter, exclude_dirs, extension_of, parse_tags, route, source_type, stem_of


def value(spark, text, column, kind="string"):
    return spark.createDataFrame([(text,)], f"t {kind}").select(column(F.col("t")).alias("v")).first()["v"]


def test_capitalised(spark):
    assert value(spark, "Is It Python", rel.capitalized) == ["Python"]
    assert value(spark, "This is about Python Programming and Ouréaux Machine.", rel.capitalized) == ["This", "Python", "Programming", "Machine"]
    assert value(spark, " ".join(["Ab"] * 10 + ["Word"]), rel.capitalized) == [] and value(spark, None, rel.capitalized) == []


def test_code_families(spark):
    r = value(spark, "import os.path\nfrom a.b import c\n@cache\nasync def run(x):\n    pass\nclass Job:\n    def run(self): pass\n", rel.python)
    assert r["symbols"] == ["run", "Job"] and r["refs"] == ["run", "Job", "os.path", "c", "a.b", "cache"] and r["tags"] == ["import", "decorator"]
    r = value(spark, "import java.util.List;\n@Override\npublic class A { public int go(int x) { if (x) { call(x); } } }", rel.java)
    assert r["symbols"] == ["go", "call", "A"] and r["tags"] == ["class", "import", "annotation"]
    r = value(spark, "import { a } from './m';\nconst f = (x) => x;\nfunction g(y) {}\ninterface I {}\ntype T = string;", lambda c: rel.javascript(c, True))
    assert {"f", "g", "I", "T"} <= set(r["symbols"]) and "./m" in r["refs"] and r["tags"] == ["import", "interface", "type"]
    r = value(spark, "fn go() {}\nstruct S;", rel.generic)
    assert r["symbols"] == ["go", "S"] and r["tags"] == []
    r = value(spark, '#include <a.h>\nvar x = 1\nrequire("m")\n', rel.code)
    assert r["refs"] == ["a.h", "m"] and r["symbols"] == ["x"]


def test_document_family(spark):
    text = "[one](docs/1.md) [two](https://x.example) [3] (Smith 2020) @ref **bold** `code`"
    r = spark.createDataFrame([(text, "Setup")], "t string, s string").select(rel.document(F.col("t"), F.col("s")).alias("v")).first()["v"]
    assert r["refs"][:2] == ["one", "docs/1.md"] and {"two", "3", "Smith 2020", "ref", "bold", "code", "Smith"} <= set(r["refs"]) and "https://x.example" not in r["refs"] and r["tags"] == ["citation", "setup"]
    assert value(spark, None, lambda c: rel.document(c, c))["refs"] == []


def test_sources(spark):
    files = spark.createDataFrame([("r/a.py", 1), ("r/vendor/b.py", 2), ("r/.hidden/c.md", 3), ("d.txt", 4), (None, 5)], "p string, n int")
    assert {r["n"] for r in crawl_filter(files, "p", ["*.py"], ["*/vendor/*"]).collect()} == {1}
    assert {r["n"] for r in crawl_filter(files, "p").collect()} == {1, 2, 3, 4}
    assert {r["n"] for r in exclude_dirs(files, "p", ["vend*", ".hidden"]).collect()} == {1, 4}
    assert glob_regex("*.[!p]?") == r"^.*\.[^p].$"
    assert value(spark, " a, ,b ,a", parse_tags) == ["a", "b"] and value(spark, " a, ,b ,a", lambda c: parse_tags(c, False)) == ["a", "b", "a"] and value(spark, None, parse_tags) == []
    assert [value(spark, p, extension_of) for p in ("x/my_file.test.PY", "README", ".env", "a.b/c")] == ["py", "", "", ""]
    assert [value(spark, p, stem_of) for p in ("x/my_file.test.py", "README", ".env")] == ["my_file.test", "README", ".env"]
    assert [value(spark, e, source_type) for e in ("h", "sql", "", None)] == ["code", "document", "document", "document"]
    assert [value(spark, e, lambda c: route(c, F.lit(None).cast("string"))) for e in ("PDF", "md", "exe", None)] == ["pdf", "text", "skip", "skip"]
    assert value(spark, "a\n\n\n\nb\n Page 3 \nPage x\n", clean_markdown) == "a\n\nb\nPage x"


def test_preview(spark):
    assert value(spark, "x" * 401, preview) == "x" * 400 + "..." and value(spark, None, preview) == "[No content available]" and value(spark, " a\tb ", preview) == "a b"
    assert value(spark, "y" * 300 + ". " + "z" * 200, preview) == "y" * 300 + "...." and value(spark, "y" * 350 + " " + "z" * 200, preview) == "y" * 350 + "..."
