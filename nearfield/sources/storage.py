"""Versioned index storage: Parquet segments, model tables, and a manifest that commits them.

Layout of an index directory::

    manifest-<version>.json          configuration, state, list of segments; the largest counts
    model/<version>/                 centroids (and codebooks) as Parquet
    segments/<name>/bucket=<b>/      postings of a range of lists, sorted by list within each file

A change writes new directories first and then renames a new manifest into place, so a reader
or a crash sees the old state or the new one. The manifest knows each segment's ranges, so a search
opens the directories of the lists it probes and no others. Paths may be on any file system that Spark reads.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.inverted import IvfConfig, IvfPq, probed, sizes_of
from nearfield.operators.kernels import matrix
from nearfield.operators.quantize import ProductQuantizer

FORMAT = 2
#: Records of a range of lists, on average, and the fewest ranges of a segment.
RANGE, FEWEST = 1 << 18, 16


class Files:
    """The few file operations that a manifest needs, through Spark's Hadoop client."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self._fs.exists(self._at(name)) else []

    def size(self, name: str) -> int:
        return int(self._fs.getContentSummary(self._at(name)).getLength()) if self._fs.exists(self._at(name)) else 0

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write beside, then rename into place; fails if the name is taken."""
        beside = f".{name}-{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(beside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(self._at(beside), self._at(name)):
            self._fs.delete(self._at(beside), False)
            raise FileExistsError(f"{name}: another writer was first")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)


class IndexStore:
    """An inverted file on disk: the state after the last committed change."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.manifest: dict = {}
        self.index: IvfPq | None = None

    # ---- manifests

    def exists(self) -> bool:
        return bool(self._versions())

    def _versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self.files.names() if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))

    def _commit(self, **changes) -> None:
        manifest = {**self.manifest, **changes, "format": FORMAT, "version": self.manifest.get("version", 0) + 1}
        self.files.publish(f"manifest-{manifest['version']:08d}.json", json.dumps(manifest))
        for version in self._versions()[:-2]:  # the previous one stays for readers
            self.files.delete(f"manifest-{version:08d}.json")
        self.manifest = manifest

    @staticmethod
    def create(spark: SparkSession, root: str, config: IvfConfig) -> IndexStore:
        store = IndexStore(spark, root)
        if store.exists():
            raise FileExistsError(root)
        store._commit(config=asdict(config), trained=False, segments=[], ranges={}, sizes=[], model=None, batches={})
        store.index = IvfPq(config)
        return store

    @staticmethod
    def load(spark: SparkSession, root: str) -> IndexStore:
        """The committed state; nothing is trained again."""
        store = IndexStore(spark, root)
        versions = store._versions()
        if not versions:
            raise FileNotFoundError(root)
        store.manifest = json.loads(store.files.read(f"manifest-{versions[-1]:08d}.json"))
        if store.manifest["format"] != FORMAT:
            raise ValueError(f"unknown format {store.manifest['format']}")
        store.index = IvfPq(IvfConfig(**store.manifest["config"]))
        if store.manifest["trained"]:
            store._read_model()
            store._open()
        return store

    # ---- model

    def _write_model(self) -> str:
        name, index = f"model/{uuid.uuid4().hex}", self.index
        rows = [(c, [float(x) for x in v]) for c, v in enumerate(index.centroids)]
        self.spark.createDataFrame(rows, "cluster_id int, centroid array<double>").coalesce(1).write.parquet(f"{self.root}/{name}/centroids")
        index.pq.codebook_table(self.spark).coalesce(1).write.parquet(f"{self.root}/{name}/codebooks")
        return name

    def _read_model(self) -> None:
        index, c = self.index, self.index.config
        table = self.spark.read.parquet(f"{self.root}/{self.manifest['model']}/centroids").orderBy("cluster_id").toArrow()
        index.centroids = matrix(table["centroid"], c.dim)
        table = self.spark.read.parquet(f"{self.root}/{self.manifest['model']}/codebooks").orderBy("subspace", "code").toArrow()
        index.pq = ProductQuantizer(c.dim, c.pq_m, c.pq_k, c.seed, matrix(table["centroid"]).reshape(c.pq_m, c.pq_k, -1))
        index.sizes = np.array(self.manifest["sizes"], dtype=np.int64)

    def train(self, vectors: DataFrame, **how) -> None:
        """Train and drop every posting."""
        old = self.manifest["segments"], self.manifest["model"]
        self.index.train(vectors, **how)
        self._commit(trained=True, model=self._write_model(), segments=[], ranges={}, sizes=[0] * self.index.config.nlist, batches={})
        for name in [f"segments/{s}" for s in old[0]] + [old[1]] * bool(old[1]):
            self.files.delete(name)

    # ---- postings

    def _schema(self) -> str:
        return "cluster_id int, id bigint, codes array<smallint>" + (", vec array<float>" if self.index.config.store_full_vectors else "") + ", bucket int"

    def _open(self) -> None:
        """Postings: all segments at once for those who read everything, and a reader of some lists."""
        paths = [f"{self.root}/segments/{s}" for s in self.manifest["segments"]]
        self.index.postings, self.index.source = None, self.lists
        for path in paths:
            part = self.spark.read.schema(self._schema()).parquet(path)
            self.index.postings = part if self.index.postings is None else self.index.postings.unionByName(part)

    def lists(self, asked: np.ndarray) -> DataFrame:
        """The postings of some lists, from the directories of their ranges alone."""
        found = None
        for name in self.manifest["segments"]:
            path, ranges = f"{self.root}/segments/{name}", self.manifest["ranges"][name]
            wanted = sorted(set(_range_of(np.asarray(asked), ranges["count"], self.index.config.nlist).tolist()) & set(ranges["present"]))
            if wanted:
                part = probed(self.spark.read.schema(self._schema()).option("basePath", path).parquet(*(f"{path}/bucket={b}" for b in wanted)), asked)
                found = part if found is None else found.unionByName(part)
        return self.spark.createDataFrame([], self._schema()) if found is None else found

    def _write_segment(self, postings: DataFrame, name: str, records: int) -> dict:
        """A segment's ranges: their number, and those that hold records. A range that holds very many is split."""
        nlist = self.index.config.nlist
        count = min(nlist, max(FEWEST, -(-records // RANGE)))
        dealt = postings.withColumn("bucket", F.floor(F.col("cluster_id").cast("long") * count / nlist).cast("int"))
        dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", "cluster_id", "id").write.partitionBy("bucket").parquet(f"{self.root}/segments/{name}")
        return {"count": count, "present": sorted(int(n.split("=")[1]) for n in self.files.names(f"segments/{name}") if n.startswith("bucket="))}

    def add(self, vectors: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Append a delta segment; a stream's batch number up to its last one is skipped."""
        self.index._trained()
        batches = dict(self.manifest["batches"])
        if batch is not None:
            if batch[1] <= batches.get(batch[0], -1):
                return False
            batches[batch[0]] = batch[1]
        name = f"delta-{self.manifest['version']:08d}-{uuid.uuid4().hex[:8]}"
        ranges = self._write_segment(self.index.encoded(vectors.select("id", "vec")), name, vectors.count())
        sizes = sizes_of(self.spark.read.schema(self._schema()).parquet(f"{self.root}/segments/{name}"), self.index.config.nlist)
        total = self.index.sizes + sizes
        self._commit(segments=[*self.manifest["segments"], name], ranges={**self.manifest["ranges"], name: ranges}, sizes=total.tolist(), batches=batches)
        self.index.sizes = total
        self._open()
        return True

    def compact(self) -> dict:
        """Rewrite all segments as one, commit it, then delete the old ones."""
        self.index._trained()
        old = self.manifest["segments"]
        name = f"base-{self.manifest['version']:08d}-{uuid.uuid4().hex[:8]}"
        if self.index.postings is not None:
            ranges = self._write_segment(self.index.postings.drop("bucket"), name, int(self.index.sizes.sum()))
            written = int(self.spark.read.schema(self._schema()).parquet(f"{self.root}/segments/{name}").count())
            if written != int(self.index.sizes.sum()):
                self.files.delete(f"segments/{name}")
                raise RuntimeError("the segments do not hold what the manifest says")
            self._commit(segments=[name], ranges={name: ranges})
            for segment in old:
                self.files.delete(f"segments/{segment}")
            self._open()
        return {"vectors": int(self.index.sizes.sum()), "bytes": self.posting_bytes(), "path": f"{self.root}/segments/{name}"}

    @property
    def is_compacted(self) -> bool:
        return len(self.manifest["segments"]) == 1 and self.manifest["segments"][0].startswith("base-")

    # ---- sizes

    def total_vectors(self) -> int:
        return int(self.index.sizes.sum())

    def logical_bytes(self) -> dict[str, int]:
        """Bytes of the records as fixed-width fields, and of what a search holds in memory."""
        c, n = self.index.config, self.total_vectors()
        trained = bool(self.manifest["trained"])
        return {
            "posting_bytes": n * (8 + c.pq_m + (8 if c.store_full_vectors else 0)),
            "raw_vector_bytes": n * 4 * c.dim if c.store_full_vectors else 0,
            "code_bytes": n * c.pq_m + (4 * c.dim * c.pq_k if trained else 0),
            "resident_memory_bytes": (4 * c.nlist * (c.dim + 1) + 4 * c.dim * c.pq_k + 16 * c.nlist) if trained else 0,
        }

    def posting_bytes(self) -> int:
        """Bytes on disk of the live segments."""
        return sum(self.files.size(f"segments/{s}") for s in self.manifest["segments"])

    def disk_bytes(self) -> int:
        return self.files.size("")

    def search(self, queries: DataFrame, k: int = 10, **how) -> DataFrame:
        return self.index.search(queries, k, **how)

    def close(self) -> None:
        self.index.postings = self.index.source = None


def _range_of(asked: np.ndarray, count: int, nlist: int) -> np.ndarray:
    return asked.astype(np.int64) * count // nlist


class GraphStore:
    """A graph index on disk: the shards, a row each, then the manifest; reload and go on adding."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def save(self, index, shards: DataFrame) -> None:
        name = f"shards/{uuid.uuid4().hex}"
        shards.write.parquet(f"{self.root}/{name}")
        pq = index.pq and {"m": index.pq.m, "k": index.pq.k, "seed": index.pq.seed, "codebooks": index.pq.codebooks.tolist()}
        manifest = {"format": FORMAT, "stored": name, "dim": index.dim, "m": index.m, "ef_construction": index.ef_construction, "seed": index.seed, "shards": index.shards, "store_full_vectors": index.store_full_vectors, "pq": pq}
        version = max([0, *(int(m[1]) for n in self.files.names() if (m := re.fullmatch(r"graph-(\d+)\.json", n)))]) + 1
        self.files.publish(f"graph-{version:08d}.json", json.dumps(manifest))

    def load(self):
        """(index, shards)."""
        from nearfield.operators.graph import SHARDS, GraphIndex

        names = [n for n in self.files.names() if re.fullmatch(r"graph-\d+\.json", n)]
        if not names:
            raise FileNotFoundError(self.root)
        m = json.loads(self.files.read(names[-1]))
        if m["format"] != FORMAT:
            raise ValueError(f"unknown format {m['format']}")
        pq = m["pq"] and ProductQuantizer(m["dim"], m["pq"]["m"], m["pq"]["k"], m["pq"]["seed"], np.array(m["pq"]["codebooks"]))
        index = GraphIndex(m["dim"], m["m"], m["ef_construction"], m["seed"], m["shards"], pq, m["store_full_vectors"])
        shards = self.spark.read.schema(SHARDS).parquet(f"{self.root}/{m['stored']}")
        shards._rows = int(shards.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
        return index, shards
