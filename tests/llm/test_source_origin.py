from textquarry.llm.source_origin import declared_flags, file_origins, glob_regex, hand_written_chunks, not_hand_written

HAND = "import core\ndef load(item, count):\n    total = item + count\n    if total > limit:\n        log('over', total)\n    return find_index(total, item)\n"
TABLE = "const T = [\n" + "\n".join("  " + ", ".join(f"0x{(i * 37 + j) % 256:02x}" for j in range(12)) + "," for i in range(12)) + "\n];\n"
MINIFIED = "".join(f"!function(a){{b&&c.push({i})}}(d);var e{i}=f?{i}:g.h(j);" for i in range(20))
LONG = "export const rows = [\n" + "\n".join(", ".join(str((i * 37 + j) % 1009) for j in range(60)) + "," for i in range(9)) + "\n];\n"
WORDS = "\n".join("['alpha beta', 'gamma delta', 'epsilon', 'zeta eta theta', 'iota', 'kappa', 'lambda mu', 'nu', 'xi omicron pi', 'rho sigma', 'tau', 'upsilon phi']," for _ in range(8))
LICENCE = "// corlib 1.2.3\n// Copyright (c) 2001 the corlib authors. All rights reserved.\n// Use is governed by the licence shipped with corlib.\n"


def kinds(df):
    return {r["source_path"]: r["kind"] for r in file_origins(df).collect()}


def test_content_evidence(chunks):
    got = kinds(chunks([
        (1, "r/app/main.py", HAND, 0), (2, "r/app/data.ts", TABLE, 0), (3, "r/app/b.js", MINIFIED, 0), (4, "r/node_modules/cor.js", HAND, 0), (11, "r/app/long.ts", LONG, 0), (12, "r/app/words.js", WORDS, 0),
        (5, "r/app/g.go", "// Code generated by x-gen v1. DO NOT EDIT.\n" + HAND, 0), (6, "r/app/o.py", "# Do not edit without asking the team first.\n" + HAND, 0),
        (7, "r/app/m.py", "# Builds the generated client code; the templates are written by hand.\n" + HAND, 0), (8, "r/README.md", TABLE, 0),
        (9, "r/app/raw.js", HAND * 12 + "const raw = '" + "aB3" * 300 + "';", 0), (10, "r/app/own.py", "# Copyright (c) the Nor team, own code of this repository.\n" + HAND, 0),
    ]))
    assert got == {"r/app/main.py": None, "r/app/data.ts": "machine", "r/app/b.js": "minified", "r/node_modules/cor.js": "vendored", "r/app/long.ts": "machine", "r/app/words.js": "machine", "r/app/g.go": "generated", "r/app/o.py": None, "r/app/m.py": None, "r/app/raw.js": None, "r/app/own.py": None}


def test_declared_by_attributes_with_precedence(chunks):
    got = kinds(chunks([
        (1, "r/.gitattributes", "api/*.py linguist-generated\nthird/** linguist-vendored\n*.js -linguist-generated\n", 0), (2, "r/api/.gitattributes", "keep.py -linguist-generated\n", 0),
        (3, "r/api/a.py", HAND, 0), (4, "r/api/keep.py", HAND, 0), (5, "r/third/x/y.py", HAND, 0), (6, "r/b.js", MINIFIED, 0), (7, "s/api/a.py", HAND, 0),
    ]))
    assert got == {"r/api/a.py": "generated", "r/api/keep.py": None, "r/third/x/y.py": "vendored", "r/b.js": None, "s/api/a.py": None}
    assert declared_flags([("a/b.py", "*.py linguist-generated"), ("b.py", "b.py !linguist-generated")]) == (None, None)
    assert glob_regex("docs/**/x.py").match("docs/a/b/x.py") and glob_regex("*.p[yx]").match("a/b.py") and not glob_regex("/x.py").match("a/x.py")


def test_attribute_files_as_documented(chunks):
    rules = """[attr]taken linguist-vendored
    # comment
    vendor/ linguist-vendored
    ext/** taken
    "with space/*.py" linguist-generated
    !no.py linguist-generated
    raw/*.py -taken
    \\#odd.py linguist-generated=true
    back.py linguist-generated=false"""
    paths = ["vendor/x.js", "ext/a/y.py", "with space/z.py", "no.py", "raw/q.py", "#odd.py", "back.py"]
    got = kinds(chunks([(0, "r/.gitattributes", rules, 0)] + [(i, f"r/{p}", HAND.replace("total", f"t{i}"), 0) for i, p in enumerate(paths, 1)]))
    assert got == {"r/vendor/x.js": "vendored", "r/ext/a/y.py": "vendored", "r/with space/z.py": "generated", "r/no.py": None, "r/raw/q.py": None, "r/#odd.py": "generated", "r/back.py": None}  # vendor: by convention
    assert glob_regex("vendor/") is None and glob_regex("!a") is None
    assert declared_flags([("a.py", "[attr]made linguist-generated\n*.py made"), ("a.py", "a.py !made")]) == (True, None)


def test_mined_patterns(chunks):
    words = "alpha beta gamma delta epsilon zeta eta".split()
    rows = [(i, f"r{i}/outgen/f{i}.ts", TABLE, 0) for i in range(6)] + [(10, "r9/outgen/plain.ts", HAND, 0), (11, "r9/app/plain.ts", HAND.replace("total", "sum"), 0)]
    # Copies of libraries in several repositories teach what their heads say; a lone copy is then known by its head.
    for k, name in enumerate(words[:6]):
        body = LICENCE.replace("corlib", name) + (HAND * 3).replace("total", name)
        rows += [(100 + 2 * k, f"r{k}/lib/{name}.js", body, 0), (101 + 2 * k, f"r{k + 1}/src/{name}/index.js", body, 0)]
    rows += [(300 + i, f"r8/app/mine{i}.js", "// Copyright (c) the Nor team, own code of this repository.\n" + HAND.replace("total", f"m{i}"), 0) for i in range(8)]
    rows += [(200, "r8/core/eta.js", LICENCE.replace("corlib", "eta") + HAND.replace("total", "eta"), 0), (201, "r8/core/own.js", "// Copyright (c) the Nor team, own code of this repository.\n" + HAND.replace("total", "own"), 0)]
    got = {r["source_path"]: (r["kind"], r["reason"]) for r in file_origins(chunks(rows)).collect()}
    assert got["r9/outgen/plain.ts"] == ("generated", "dir:outgen") and got["r9/app/plain.ts"][0] is None and got["r0/outgen/f0.ts"] == ("machine", "dir:outgen")
    assert got["r0/lib/alpha.js"][0] == "vendored" and got["r8/core/eta.js"][0] == "vendored" and got["r8/core/eta.js"][1].startswith("say:") and got["r8/core/own.js"][0] is None


def test_text_of_a_vendored_copy(chunks):
    body = HAND * 3
    got = {r["source_path"]: (r["kind"], r["reason"]) for r in file_origins(chunks([(20, "r1/vendor/c.js", body, 0), (22, "r2/util/copy.js", body, 0), (23, "r3/util/other.js", body.replace("total", "sum"), 0), *[(30 + i, f"r4/util/f{i}.js", body, 0) for i in range(40)]])).collect()}
    assert got["r1/vendor/c.js"] == ("vendored", "convention") and got["r2/util/copy.js"] == ("vendored", "shared text") and got["r3/util/other.js"] == (None, None)


def test_edge_cases(chunks):
    assert not_hand_written(chunks([])).count() == 0
    rows = [(1, None, TABLE, 0), (2, "r/a.py", None, 0), (3, "r/b.py", "", 0), (4, "r/c.ts", TABLE, 0), (4, "r/c.ts", TABLE, 0), (5, "r/long.py", HAND * 5000, 0)]
    df = chunks(rows)
    assert [r[0] for r in not_hand_written(df).collect()] == ["r/c.ts"]
    assert {r["vec_id"] for r in hand_written_chunks(df).collect()} >= {2, 3, 5}


def test_attribute_files_of_a_crawled_folder(spark, tmp_path):
    import os

    from textquarry.config import Config
    from textquarry.engine import Engine

    for name, text in {"pkg/.gitattributes": "# Rules\ngen.py linguist-generated\n", "pkg/gen.py": "value = 1\n", "pkg/__init__.py": "value = 2\n"}.items():
        os.makedirs(tmp_path / "f/pkg", exist_ok=True)
        (tmp_path / "f" / name).write_text(text)
    with Engine(spark, Config(index_dir=str(tmp_path / "index"), embedding_dimension=16)) as engine:
        engine.index_folder(str(tmp_path / "f"), "t")
        assert kinds(engine.chunks()) == {"pkg/gen.py": "generated", "pkg/__init__.py": None}
