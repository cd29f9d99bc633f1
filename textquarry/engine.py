"""The engine: index a folder, search it, look things up, keep it."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.config import Config
from textquarry.operators import metadata, vector
from textquarry.operators.embedding import create_embedder, model_info
from textquarry.operators.keyword import KeywordIndex
from textquarry.plans import pipeline
from textquarry.runtime import cut
from textquarry.sources import archive
from textquarry.sources.files import list_files, read_files
from textquarry.storage import IndexStore

#: A search returns at most so many results.
MOST_RESULTS = 50
#: Of the files that are too large to be read, so many are named; all are counted.
LISTED = 100


class Engine:
    """State is the stored index only; every method is a Spark plan over it."""

    def __init__(self, spark: SparkSession, config: Config | None = None, after_loading: pipeline.Hook | None = None, after_chunking: pipeline.Hook | None = None):
        self.hooks = {"after_loading": after_loading, "after_chunking": after_chunking}
        self.spark, self.config = spark, config or Config.load()
        self.store = IndexStore(spark, self.config.index_path, self.config.max_backups if self.config.backup_indices else 1)
        options = {"dimension": self.config.embedding_dimension} if self.config.embedding_provider == "hashing" else {}
        self.embedder = create_embedder(self.config.embedding_provider, **options)
        #: Rows not yet stored: to be added to the stored ones or, after a removal, to replace them.
        self._unsaved: DataFrame | None = None
        self._rewrite = False
        if self.config.auto_load and self.store.current() is None and self.config.bootstrap_archive_url:
            archive.bootstrap(self.config.bootstrap_archive_url, self.config.index_path)

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None and self.config.auto_persist:
            self.save()
        self.embedder.close()

    def chunks(self) -> DataFrame | None:
        """The current index, or None."""
        stored = self.store.load() if self.config.auto_load and not self._rewrite else None
        return self._unsaved if stored is None else stored if self._unsaved is None else stored.select(self._unsaved.columns).unionByName(self._unsaved)

    def index_folder(self, base: str, tags: str, include: list[str] | None = None, exclude: list[str] | None = None, exclude_directories: list[str] | None = None, upsert: bool = False) -> dict:
        """Add the files below a folder; with ``upsert`` the stored chunks of the same paths are replaced. Returns counts."""
        if not [t for t in tags.split(",") if t.strip()]:
            raise ValueError("tags are required")
        if not os.path.exists(base):
            raise FileNotFoundError(base)
        wanted = (base, include, exclude, exclude_directories)
        listed = list_files(self.spark, *wanted)
        limit = self.config.max_file_size_mb * (1 << 20)
        names, large = listed.where(F.col("length") <= limit), listed.where(F.col("length") > limit)
        files = read_files(self.spark, *wanted, self.config.max_file_size_mb, tags)
        old = self.chunks()
        last = None if old is None else old.agg(F.max("vec_id")).first()[0]
        new, blank = pipeline.index_files(files, self.config, self.embedder, 0 if last is None else last + 1, **self.hooks)
        new = cut(new)
        if old is not None and upsert:
            self._replace(metadata.remove_chunks(old, names.select(F.col("relative_path").alias("source_path")), "source_path"))
        self._add(new)
        if self.config.auto_persist:
            self.save()
        return {"files": names.count(), "chunks": new.count(), "blank_chunks": blank.count(), "too_large": sorted(r["relative_path"] for r in large.select("relative_path").take(LISTED)), "too_large_files": large.count()}

    def _replace(self, rows: DataFrame) -> None:
        """The whole index is to be written anew."""
        self._unsaved, self._rewrite = rows, True

    def _add(self, rows: DataFrame) -> None:
        """Rows to be added to the index as it is."""
        self._unsaved = rows if self._unsaved is None else self._unsaved.select(rows.columns).unionByName(rows)

    def _keywords(self, chunks: DataFrame) -> KeywordIndex:
        """The keyword index of the stored version, built when it is first asked for; of unsaved rows, a passing one."""
        version = self.store.current()
        path = None if version is None or self._unsaved is not None else f"{self.config.index_path}/keywords/{version['version']}"
        return KeywordIndex.of(chunks, "chunk_text", "vec_id", path)

    def search(self, query: str, k: int = 5, hybrid: bool | None = None) -> DataFrame | None:
        """Explained results with the ``search_mode`` that gave them; None for a blank query or an empty index.

        ``k`` below 1 means 5; more than 50 means 50. If the keywords fail, the vectors alone answer, and the mode says so.
        """
        chunks = self.chunks()
        if not query.strip() or chunks is None or chunks.isEmpty():
            return None
        asked = self.embedder.embed(self.spark.createDataFrame([(query,)], "text string"), "text").first()["embedding"]
        k = 5 if k < 1 else min(k, MOST_RESULTS)
        use = self.config.use_hybrid_search if hybrid is None else hybrid
        request = (query, [float(x) for x in asked], k, self.config.keyword_weight)
        vectors = chunks.select("vec_id", "embedding")
        if use:
            try:
                return cut(pipeline.search(chunks, vectors, self._keywords(chunks), *request).withColumn("search_mode", F.lit("hybrid")))
            except Exception:
                logging.getLogger(__name__).exception("keyword search failed; answering by vectors")
        return cut(pipeline.search(chunks, vectors, None, *request).withColumn("search_mode", F.lit("vector")))

    def discover(self) -> list[str]:
        """All tags that users gave."""
        chunks = self.chunks()
        return [] if chunks is None else [r["tag"] for r in metadata.discover_tags(chunks.select(F.col("user_tags").alias("tags"))).collect()]

    def search_settings(self) -> dict:
        """What a search uses: mode, provider, model, weight of the keywords."""
        return {"hybrid": self.config.use_hybrid_search, "keyword_weight": self.config.keyword_weight} | model_info(self.embedder)

    def status(self) -> dict:
        """Counts of the index and the settings."""
        chunks = self.chunks()
        if chunks is None:
            return {"chunks": 0, "config": self.config.summary()}
        row = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source_path").alias("files"), F.count_if(F.col("source_type") == "code").alias("code_chunks")).first()
        info = vector.index_info(chunks, self.embedder.dimension).first()
        return row.asDict() | {"memory_bytes": info["memory_bytes"], "provider": self.embedder.provider, "model": self.embedder.model, "config": self.config.summary()}

    def save(self) -> dict | None:
        """Store what was indexed since the last save."""
        if self._unsaved is None:
            return None
        write = self.store.save if self._rewrite or not self.config.auto_load else self.store.append
        meta = write(self._unsaved, provider=self.embedder.provider, model=self.embedder.model, dimension=self.embedder.dimension)
        self._unsaved, self._rewrite = None, False
        return meta

    def remove(self, chunk_ids: list[str]) -> None:
        """Delete chunks, with their vectors."""
        chunks = self.chunks()
        if chunks is not None:
            gone = self.spark.createDataFrame([(c,) for c in chunk_ids], "chunk_id string")
            self._replace(metadata.remove_chunks(chunks, gone))
            if self.config.auto_persist:
                self.save()

    def reset(self, confirm: bool = False, files: bool = True) -> bool:
        """Clear the index; only if confirmed."""
        if confirm:
            self._unsaved, self._rewrite = None, False
            self.store.clear(files)
        return confirm
