import hashlib
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from textquarry.config import Config
from textquarry.engine import Engine
from textquarry.operators import metadata
from textquarry.plans.pipeline import chunk_files
from textquarry.runtime import numbered, small_or_plain
from textquarry.sources import archive
from textquarry.sources.files import read_files
from textquarry.storage import IndexStore
from textquarry.streaming.ingest import append_once, windowed_searches


@pytest.fixture
def tree(folder):
    base = os.path.join(folder, "files")
    body = "Words about the scheduler and its token cache. " * 4
    for name, text in {"a.md": f"# Intro\n{body}\n# Usage\n{body}", "src/b.py": "import os\n\ndef load(x):\n    return x\n", "src/c.h": "int f(int x);\n", "empty.txt": "", "node_modules/d.js": "x", "big.bin": "\x00"}.items():
        path = os.path.join(base, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text.encode())
    with open(os.path.join(base, "latin.txt"), "wb") as f:
        f.write("café\r\n".encode("latin-1"))
    return base


def test_index_search_and_keep(spark, folder, tree):
    config = Config(index_dir=os.path.join(folder, "index"), embedding_dimension=16)
    with Engine(spark, config) as engine:
        with pytest.raises(ValueError):
            engine.index_folder(tree, " , ")
        with pytest.raises(FileNotFoundError):
            engine.index_folder(tree + "x", "t")
        counts = engine.index_folder(tree, "docs, own", exclude_directories=["node_modules"])
        assert counts["files"] == 4 and counts["blank_chunks"] == 0
        rows = engine.chunks().orderBy("vec_id").collect()
        assert [r["vec_id"] for r in rows] == list(range(len(rows))) and {r["source_path"] for r in rows} == {"a.md", "src/b.py", "src/c.h", "latin.txt"}
        assert any(r["chunk_text"].startswith("café") for r in rows) and any("load" in r["code_symbols"] for r in rows)
        assert engine.discover() == ["docs", "own"]
        found = engine.search("token cache", 3).collect()
        assert [r["rank"] for r in found] == [1, 2, 3] and found[0]["source_path"] == "a.md" and found[0]["match_type"] == "hybrid"
        assert engine.search("  ") is None
        assert [(r["match_type"], r["search_mode"]) for r in engine.search("token", 1, hybrid=False).collect()] == [("semantic", "vector")]
        assert {r["search_mode"] for r in found} == {"hybrid"} and {r["metadata"]["mime_type"] for r in rows} >= {"text/markdown", "text/x-python", "text/plain"}
        intro = next(r["metadata"] for r in rows if r["parent_section"] == "Intro")
        assert intro["chunk_name"] == "Intro" and intro["chunk_index"] == 0 and intro["page_number"] is None
    again = Engine(spark, config)
    assert again.status()["chunks"] == len(rows) and again.status()["files"] == 4
    again.index_folder(tree, "docs", exclude_directories=["node_modules"], upsert=True)
    assert again.status()["chunks"] == len(rows)
    again.index_folder(tree, "docs", exclude_directories=["node_modules"])
    assert again.status()["chunks"] == 2 * len(rows) and len(again.store.current()["parts"]) == 2
    again.remove([rows[0]["chunk_id"]])
    assert again.chunks().where(F.col("chunk_id") == rows[0]["chunk_id"]).count() == 0
    assert not again.reset() and again.reset(confirm=True) and again.chunks() is None and again.search("token") is None


def test_every_name_is_crawled(spark, folder):
    base = os.path.join(folder, "[files]")
    deep = "/".join(f"d{i}" for i in range(30))
    names = ["pkg/__init__.py", "_x/a.md", "_x/y/__main__.py", ".github/flow.yml", ".eslintrc.json", "pkg/.gitattributes", "pkg/gen.py", f"{deep}/_utils.py", *(f"m{i}/n/b.py" for i in range(250))]
    for name in [*names, ".hidden", "_x/c.bin"]:
        path = os.path.join(base, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write("# Rules\ngen.py linguist-generated\n" if name.endswith("attributes") else f"value = '{name}'\n")
    os.symlink(base, os.path.join(base, "pkg/loop"))
    os.symlink(os.path.join(base, "nowhere"), os.path.join(base, "pkg/dangling.py"))
    with open(os.path.join(os.fsencode(base), b"caf\xe9.txt"), "w") as f:
        f.write("x")
    rows = read_files(spark, base).collect()
    assert sorted(r["relative_path"] for r in rows) == sorted([*names, "caf\\xe9.txt"])
    assert all(r["relative_path"] in r["text"] for r in rows if r["relative_path"].endswith(("py", "md")))
    one = read_files(spark, os.path.join(base, "pkg/__init__.py")).first()
    assert one["relative_path"] == "__init__.py" and one["full_path"] == os.path.join(base, "pkg/__init__.py")
    with Engine(spark, Config(index_dir=os.path.join(folder, "index"), embedding_dimension=16)) as engine:
        assert engine.index_folder(os.path.join(base), "t", include=["pkg/*", "_x/*"])["files"] == 5
        assert {"pkg/gen.py", "pkg/__init__.py", "pkg/.gitattributes", "_x/a.md"} <= {r["source_path"] for r in engine.chunks().collect()}


def test_large_files_are_reported(spark, folder):
    base = os.path.join(folder, "f")
    os.makedirs(base)
    for name, size in (("small.txt", 10), ("large.txt", 3 << 20)):
        with open(os.path.join(base, name), "w") as f:
            f.write("word " * (size // 5))
    engine = Engine(spark, Config(index_dir=os.path.join(folder, "index"), embedding_dimension=16, max_file_size_mb=1))
    counts = engine.index_folder(base, "t")
    assert counts["files"] == 1 and counts["too_large"] == ["large.txt"] and counts["too_large_files"] == 1


def test_hooks_and_media_types(spark, folder):
    base = os.path.join(folder, "f")
    os.makedirs(base)
    for name in ("a.csv", "b.txt", "c.bin"):
        with open(os.path.join(base, name), "w") as f:
            f.write("some words here")
    config = Config(index_dir=os.path.join(folder, "index"), embedding_dimension=16)
    engine = Engine(spark, config, after_loading=lambda d: d.where("filename_stem != 'b'"), after_chunking=lambda d: d.withColumn("chunk_text", F.upper("chunk_text")))
    engine.index_folder(base, "t")
    assert [(r["source_path"], r["chunk_text"], r["metadata"]["mime_type"]) for r in engine.chunks().collect()] == [("a.csv", "SOME WORDS HERE", "text/csv")]


def test_a_file_of_many_sections(spark, folder):
    text = "\n".join(f"# S{i}\n{'x' * 60}" for i in range(30_000)) + "\n# Long\n" + "Word by word. " * 200
    files = spark.createDataFrame([("a.md", "md", text, ["t"], "text/markdown", "a")], "relative_path string, file_extension string, text string, tags array<string>, mime_type string, filename_stem string")
    rows = chunk_files(files, Config(chunk_size=128, chunk_overlap=10))
    assert rows.agg(F.count_distinct("chunk_no"), F.max("chunk_no")).first() == (rows.count(), rows.count() - 1) and rows.count() > 30_001


def test_search_without_keywords_says_so(spark, folder, tree, monkeypatch):
    def fails(*_):
        raise OSError("no keywords")

    engine = Engine(spark, Config(index_dir=os.path.join(folder, "index"), embedding_dimension=16))
    engine.index_folder(tree, "t")
    monkeypatch.setattr(Engine, "_keywords", fails)
    assert {(r["search_mode"], r["match_type"]) for r in engine.search("token", 2).collect()} == {("vector", "semantic")}


def test_the_keyword_index_is_kept_with_its_version(spark, folder, tree):
    engine = Engine(spark, Config(index_dir=os.path.join(folder, "index"), embedding_dimension=16))
    engine.index_folder(tree, "t")
    names = lambda: os.listdir(os.path.join(folder, "index/chunks/keywords"))
    engine.search("token")
    engine.search("cache")
    assert names() == [engine.store.current()["version"]]
    engine.index_folder(tree, "t")
    engine.search("token")
    assert len(names()) == 2


def test_versions(spark, folder):
    store = IndexStore(spark, os.path.join(folder, "s"), keep=1)
    rows = spark.createDataFrame([(1, "code", "x")], "vec_id long, source_type string, t string")
    assert store.load() is None and store.restore_previous() is None
    store.save(rows)
    store.append(spark.createDataFrame([(2, "document", "y")], rows.schema), note="n")
    assert store.load().count() == 2 and store.current()["next_vec_id"] == 3 and store.current()["note"] == "n"
    parts = store.current()["parts"]
    assert len(parts) == 2  # the first rows weren't written again
    store.save(rows.limit(0))
    assert len(store.versions()) == 2 and store.load().count() == 0
    store.restore_previous()
    assert store.load().count() == 2 and store.current()["parts"] == parts
    assert store.restore_previous() is None
    store.clear()
    assert store.load() is None and store.restore_previous() is None
    store.save(rows)
    assert store.load().count() == 1 and sorted(n for n in os.listdir(os.path.join(folder, "s")) if n.startswith("part")) == store.current()["parts"]
    store.clear(files=True)
    assert store.versions() == []


def test_archive(folder):
    inner, packed = os.path.join(folder, "x.txt"), os.path.join(folder, "a.tgz")
    with open(inner, "w") as f:
        f.write("hello")
    with tarfile.open(packed, "w:gz") as t:
        t.add(inner, "in/x.txt")
    with open(packed + ".sha256", "w") as f:
        f.write(hashlib.sha256(open(packed, "rb").read()).hexdigest() + "  a.tgz")
    assert archive.bootstrap("file://" + packed, os.path.join(folder, "out")) == ["in/x.txt"] and os.path.exists(os.path.join(folder, "out/in/x.txt"))
    with pytest.raises(ValueError):
        archive.verify(packed, "00")
    bad = os.path.join(folder, "bad.zip")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError):
        archive.extract(bad, os.path.join(folder, "out2"))


def test_config(monkeypatch):
    monkeypatch.setenv("TEXTQUARRY_CHUNK_SIZE", "many")
    monkeypatch.setenv("TEXTQUARRY_USE_HYBRID_SEARCH", "off")
    monkeypatch.setenv("TEXTQUARRY_KEYWORD_WEIGHT", "0.5")
    c = Config.load(max_backups=7)
    assert (c.chunk_size, c.use_hybrid_search, c.keyword_weight, c.max_backups, c.checksum_url) == (512, False, 0.5, 7, "")
    for wrong in ({"chunk_size": 0}, {"chunk_overlap": 600}, {"keyword_weight": 2.0}, {"bootstrap_archive_url": "ftp://x"}, {"batch_size": 0}):
        with pytest.raises(ValueError):
            Config(**wrong)


def test_metadata(spark):
    rows = [(1, "a", "p", "code", "t", ["x", " y"], None, ["s"], "P", "m"), (2, "b", "p", "Code", None, None, ["x"], [], "P", "m"), (3, None, None, None, "t", [], [], None, "P", None)]
    c = spark.createDataFrame(rows, "vec_id long, chunk_id string, source_path string, source_type string, chunk_text string, tags array<string>, ref_names array<string>, code_symbols array<string>, embedding_provider string, embedding_model string")
    assert [r["tag"] for r in metadata.discover_tags(c).collect()] == ["x", "y"] and metadata.unique_entities(c).first()[0] == 3
    assert {r["kind"]: r["distinct_values"] for r in metadata.relationship_stats(c).collect()} == {"tags": 2, "ref_names": 1, "code_symbols": 1}
    assert not metadata.embedding_compatible(c, "P", "m").first()[0] and metadata.embedding_compatible(c.limit(0), "P", "m").first()[0] and metadata.embedding_compatible(c.where("vec_id < 3"), "P", "m").first()[0]
    assert {r["source_type"]: r["chunks"] for r in metadata.stats_by_type(c).collect()} == {"code": 1, "document": 2}
    assert {r["vec_id"] for r in metadata.remove_chunks(c, c.where("vec_id = 1")).collect()} == {2, 3} and metadata.with_element(c, "tags", "x").count() == 1
    assert metadata.by_source_type(c, "document").count() == 2 and metadata.point_lookup(c, "chunk_id", "a").count() == 1 and metadata.stats_by_type(c.limit(0)).count() == 0


def test_numbered_and_broadcast_check(spark):
    rows = numbered(spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7), ["k"], "n", 5).orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(5, 1005))
    assert "broadcast" in small_or_plain(spark.range(10))._jdf.queryExecution().logical().toString().lower() and "broadcast" not in small_or_plain(spark.range(10), 1)._jdf.queryExecution().logical().toString().lower()


def test_streams(spark, folder):
    log = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", None), (1, "2024-01-01 00:10:00", "a", None), (2, "2024-01-01 01:10:00", None, "E"), (3, None, "a", None)], "query_id long, ts string, search_mode string, error_code string").withColumn("ts_query", F.col("ts").cast("timestamp"))
    assert sorted((r["search_mode"], r["searches"], r["errors"]) for r in windowed_searches(log).collect()) == [("a", 1, 0), ("unknown", 1, 1)]
    source, target = os.path.join(folder, "in"), os.path.join(folder, "out")
    spark.range(5).write.parquet(source)
    for _ in range(2):
        append_once(spark.readStream.schema("id long").parquet(source), target, os.path.join(folder, "cp")).awaitTermination()
    assert spark.read.parquet(target).count() == 5
