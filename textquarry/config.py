"""Settings of an engine: arguments, else environment, else defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

_TRUE = ("true", "1", "yes", "on")


@dataclass
class Config:
    # Names and defaults of the settings.
    index_dir: str = "./index"
    index_name: str = "chunks"
    auto_persist: bool = True
    auto_load: bool = True
    backup_indices: bool = False
    max_backups: int = 3
    bootstrap_archive_url: str = ""
    embedding_provider: str = "hashing"
    embedding_dimension: int = 48
    chunk_size: int = 512
    chunk_overlap: int = 50
    enable_relationships: bool = True
    max_relationships_per_chunk: int = 10
    use_hybrid_search: bool = True
    keyword_weight: float = 0.3
    max_file_size_mb: int = 10
    batch_size: int = 32

    def __post_init__(self) -> None:
        if self.chunk_size < 1:
            raise ValueError("chunk_size must be positive")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be at least 0 and below chunk_size")
        if not 0 <= self.keyword_weight <= 1:
            raise ValueError("keyword_weight must be between 0 and 1")
        if self.max_file_size_mb < 1 or self.batch_size < 1 or self.max_relationships_per_chunk < 0:
            raise ValueError("sizes and limits must be positive")
        if self.bootstrap_archive_url and not self.bootstrap_archive_url.startswith(("http://", "https://", "file://")):
            raise ValueError("bootstrap_archive_url must be an http, https or file address")

    @classmethod
    def load(cls, prefix: str = "TEXTQUARRY_", **overrides) -> Config:
        """Settings from the arguments that aren't None, else the environment; unreadable numbers take the default."""
        chosen = {}
        for f in fields(cls):
            given = overrides.get(f.name)
            raw = os.environ.get(prefix + f.name.upper())
            if given is not None:
                chosen[f.name] = given
            elif raw is not None:
                kind = type(f.default)
                try:
                    chosen[f.name] = raw.strip().lower() in _TRUE if kind is bool else kind(raw)
                except ValueError:
                    pass
        return cls(**chosen)

    @property
    def index_path(self) -> str:
        return os.path.join(self.index_dir, self.index_name)

    @property
    def checksum_url(self) -> str:
        return self.bootstrap_archive_url + ".sha256" if self.bootstrap_archive_url else ""

    def summary(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}
