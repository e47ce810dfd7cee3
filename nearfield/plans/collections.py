"""Named collections: create, train, add, search, compact, stats, list, drop.

Errors carry the code that a service would answer with: 400 for a bad request, 404 for an
unknown collection, 409 for a conflict. A collection is on disk from its creation on, so
one that was never trained is there after a restart too.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.inverted import IvfConfig
from nearfield.sources.storage import Files, IndexStore


class CollectionError(Exception):
    code = 400


class Invalid(CollectionError, ValueError):
    code = 400


class NotFound(CollectionError, KeyError):
    code = 404


class Conflict(CollectionError):
    code = 409


class Catalog:
    """The collections below a directory, opened on first use."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._files, self._open = Files(spark, root), {}

    def _path(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise Invalid("names have letters, digits, - and _ only")
        return f"{self.root}/{name}"

    def get(self, name: str) -> IndexStore:
        path = self._path(name)
        if name not in self._open:
            try:
                self._open[name] = IndexStore.load(self.spark, path)
            except FileNotFoundError:
                raise NotFound(name) from None
        return self._open[name]

    def create(self, name: str, dim: int, nlist: int, **config) -> IndexStore:
        path = self._path(name)
        try:
            settings = IvfConfig(dim, nlist, **config)
        except (ValueError, TypeError) as error:
            raise Invalid(str(error)) from error
        try:
            self._open[name] = IndexStore.create(self.spark, path, settings)
        except FileExistsError:
            raise Conflict(f"{name} exists") from None
        return self._open[name]

    def train(self, name: str, vectors: DataFrame, coarse_training: str = "legacy", **how) -> None:
        store = self.get(name)
        if store.index.is_trained:
            raise Conflict(f"{name} is trained")
        if coarse_training not in ("legacy", "accumulated"):
            raise Invalid("coarse_training must be 'legacy' or 'accumulated'")
        self._check(vectors, "vec", store.index.config.dim)
        store.index.config.coarse_training = coarse_training
        store.manifest["config"]["coarse_training"] = coarse_training
        try:
            store.train(vectors, **how)
        except ValueError as error:
            raise Invalid(str(error)) from error

    def add(self, name: str, vectors: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Append [id, vec]; the collection's size afterwards."""
        store = self.get(name)
        if not store.index.is_trained:
            raise Invalid(f"{name} is not trained")
        self._check(vectors, "vec", store.index.config.dim)
        store.add(vectors, batch)
        return store.total_vectors()

    def search(self, name: str, queries: DataFrame, k: int = 10, nprobe: int | None = None, max_candidates: int | None = None, rerank: int = 0) -> DataFrame:
        store = self.get(name)
        if not store.index.is_trained:
            raise Invalid(f"{name} is not trained")
        self._check(queries, "q", store.index.config.dim)
        try:
            return store.search(queries, k, nprobe=nprobe, max_candidates=max_candidates, rerank=rerank)
        except ValueError as error:
            raise Invalid(str(error)) from error

    def compact(self, name: str) -> dict:
        store = self.get(name)
        if not store.index.is_trained:
            raise Invalid(f"{name} is not trained")
        return store.compact()

    def stats(self, name: str) -> DataFrame:
        """One row with the collection's settings and sizes."""
        store, c = self.get(name), self.get(name).index.config
        sizes = store.logical_bytes()
        row = (name, store.total_vectors(), sizes["resident_memory_bytes"], c.nlist, c.dim, store.index.is_trained, store.is_compacted, c.store_full_vectors, c.routing_backend, c.pq_mode, c.coarse_training, sizes["posting_bytes"], sizes["raw_vector_bytes"])
        schema = "name string, total_vectors long, resident_memory_bytes long, nlist int, dim int, trained boolean, compacted boolean, store_full_vectors boolean, routing_backend string, pq_mode string, coarse_training string, posting_bytes long, raw_vector_bytes long"
        return self.spark.createDataFrame([row], schema)

    def list(self) -> DataFrame:
        """[name, total_vectors] of every collection."""
        rows = []
        for name in self._files.names():
            try:
                rows.append((name, self.get(name).total_vectors()))
            except CollectionError:
                continue
        return self.spark.createDataFrame(rows, "name string, total_vectors long")

    def drop(self, name: str) -> None:
        self.get(name).close()
        self._open.pop(name)
        self._files.delete(name)

    @staticmethod
    def _check(vectors: DataFrame, column: str, dim: int) -> None:
        found = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high")).first()
        if not found.n or found.low != dim or found.high != dim:
            raise Invalid(f"need at least one vector, and {dim} components in each")
