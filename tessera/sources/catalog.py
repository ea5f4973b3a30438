"""Collections of chunks, kept up in segments.

Each sync writes one segment: its chunks and their indexes, and a list of the chunks of earlier segments that
it replaces or deletes. A manifest names the segments that count. So a sync writes in proportion to what
has changed; small segments are merged as they gather (each at most as often as the logarithm of the collection), and what the merged
ones had deleted among themselves goes then.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import inverted_file, keyword, sync
from tessera.operators.small import small

CHUNKS = f"{schemas.CHUNKS}, embedding array<float>"
#: What the filters of a search look at, kept with the vectors.
FILTERED = ("language", "source", "symbol_name")
_GONE, _WORDS, _TOTALS = "segment string, key string", "segment string, token string, df bigint", "segment string, n bigint, total bigint"
#: Sources up to which the chunks to be replaced are looked for by a literal set.
_LITERAL = 1000


def chunk_key():
    """The id of a chunk: its source and its place in it."""
    return F.concat_ws("\u0001", "source", F.lpad(F.col("chunk_index").cast("string"), 10, "0"))


class Conflict(RuntimeError):
    """Another writer was first, again and again."""


class Catalog:
    """Collections below a folder: folders of segments, and numbered manifests, the last readable one of which counts. A manifest is
    only made where there is none of its number, so of two writers the second looks again at what the first has
    left and adds its segment after it: no writer's rows are lost, and readers see a sync whole or not at all."""

    def __init__(self, spark: SparkSession, root: str, vectors: bool = False, keep: int = 3) -> None:
        self.spark, self.root, self.vectors, self.keep = spark, root.rstrip("/"), vectors, keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests

    def _manifests(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(x for s in self._fs.listStatus(self._path(f"{self.root}/{name}")) if (x := s.getPath().getName()).startswith("manifest-"))

    def _load(self, name: str, manifest: str) -> dict | None:
        stream = self._fs.open(self._path(f"{self.root}/{name}/{manifest}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None  # another writer is at it, or has failed at it
        finally:
            stream.close()

    def _current(self, name: str) -> tuple[int, list[dict]]:
        """(number of the next manifest, segments that count, in order)."""
        found = self._manifests(name)
        number = int(found[-1].partition("-")[2]) + 1 if found else 0
        return number, next((m["segments"] for x in reversed(found) if (m := self._load(name, x)) is not None), [])

    def _commit(self, name: str, number: int, segments: list[dict]) -> bool:
        """Make the manifest of that number; false: there is one."""
        path = self._path(f"{self.root}/{name}/manifest-{number:08d}")
        try:
            out = self._fs.create(path, False)
        except Exception as e:
            if self._fs.exists(path):
                return False
            raise e
        try:
            out.write(bytearray(json.dumps({"segments": segments}), "utf-8"))
        finally:
            out.close()
        self._clean(name)
        return True

    def _clean(self, name: str) -> None:
        """Manifests before the last ``keep`` go, with the segments that none of the kept ones names."""
        found = self._manifests(name)
        old, new = found[: -self.keep], found[-self.keep :]
        named = {s["id"] for x in new for s in (self._load(name, x) or {"segments": []})["segments"]}
        for x in old:
            for s in (self._load(name, x) or {"segments": []})["segments"]:
                if s["id"] not in named:
                    self._fs.delete(self._path(f"{self.root}/{name}/{s['id']}"), True)
            self._fs.delete(self._path(f"{self.root}/{name}/{x}"), False)

    # -- segments

    def _chunks(self, name: str, segment: dict) -> DataFrame:
        return self.spark.read.schema(CHUNKS).parquet(f"{self.root}/{name}/{segment['id']}/chunks").select(F.lit(segment["id"]).alias("segment"), chunk_key().alias("key"), "*")

    def _told(self, name: str, segments: list[dict], what: str, schema: str) -> DataFrame | None:
        """What the segments tell of earlier ones: gone, words or totals; of those among ``segments``."""
        some = [self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{s['id']}/lost/{what}") for s in segments if s["gone"]]
        if not some:
            return None
        ids = [s["id"] for s in segments]
        return reduce(DataFrame.unionByName, some).where(F.col("segment").isin(ids))

    def _live(self, name: str, segments: list[dict]) -> DataFrame:
        """(segment, key, chunk columns) of the chunks of ``segments`` that none of them has replaced."""
        if not segments:
            return self.spark.createDataFrame([], f"segment string, key string, {CHUNKS}")
        rows, gone = reduce(DataFrame.unionByName, (self._chunks(name, s) for s in segments)), self._told(name, segments, "gone", _GONE)
        return rows if gone is None else rows.join(small(gone), ["segment", "key"], "left_anti")

    def _write(self, name: str, chunks: DataFrame, model: dict | None) -> dict:
        """A new segment of ``chunks`` with its indexes; nobody sees it yet."""
        made = {"id": f"segment-{uuid.uuid4().hex}", "gone": 0, "model": model and model["model"]}
        path = f"{self.root}/{name}/{made['id']}"
        order = [f.split()[0] for f in CHUNKS.split(", ")]
        chunks.select(*order).sortWithinPartitions("source", "chunk_index").write.parquet(f"{path}/chunks")
        rows = self._chunks(name, made)
        keyword.write(keyword.build(rows.withColumn("text", F.col("page_content")), segment=made["id"]), f"{path}/words")
        made["rows"] = self.spark.read.parquet(f"{path}/words/totals").first()["n"]
        if self.vectors:
            if model is None:
                inverted_file.write_model(self.spark, inverted_file.fit(rows), f"{path}/model")
                made["model"] = f"{made['id']}/model"
            fitted = inverted_file.read_model(self.spark, f"{self.root}/{name}/{made['model']}")
            inverted_file.write_rows(inverted_file.build(rows, fitted, FILTERED), f"{path}/vectors")
        return made

    def _lose(self, name: str, made: dict, earlier: list[dict], sources: DataFrame) -> dict:
        """Write what the segment ``made`` takes from the ``earlier`` ones: the live chunks of ``sources`` (source) there."""
        rows, some = self._live(name, earlier), [r[0] for r in sources.limit(_LITERAL + 1).collect()]
        rows = rows.where(F.col("source").isin(some)) if len(some) <= _LITERAL else rows.join(small(sources), "source", "left_semi")
        path = f"{self.root}/{name}/{made['id']}/lost"
        rows.select("segment", "key", "page_content").write.mode("overwrite").parquet(f"{path}/rows")
        went = self.spark.read.parquet(f"{path}/rows")
        went.select("segment", "key").coalesce(1).write.mode("overwrite").parquet(f"{path}/gone")
        words, totals = keyword.lost(went, "page_content")
        words.write.mode("overwrite").parquet(f"{path}/words")
        totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
        n = self.spark.read.parquet(f"{path}/gone").count()
        self._fs.delete(self._path(f"{path}/rows"), True)
        return made | {"gone": n}

    def _merge(self, name: str) -> None:
        """Merge the last segments, back to the first that is more than twice as large as those after it; if a writer comes between, leave it to that one."""
        number, segments = self._current(name)
        at, size = len(segments) - 1, segments[-1]["rows"] if segments else 0
        while at > 0 and segments[at - 1]["rows"] <= 2 * size:
            at -= 1
            size += segments[at]["rows"]
        if at >= len(segments) - 1:
            return
        before, merged = segments[:at], segments[at:]
        made = self._write(name, self._live(name, merged).drop("segment", "key"), before[0] if before else None)
        path, ids = f"{self.root}/{name}/{made['id']}/lost", [s["id"] for s in before]
        if ids and any(s["gone"] for s in merged):
            for what, schema in (("gone", _GONE), ("words", _WORDS), ("totals", _TOTALS)):
                some = [self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{s['id']}/lost/{what}") for s in merged if s["gone"]]
                reduce(DataFrame.unionByName, some).where(F.col("segment").isin(ids)).coalesce(1).write.parquet(f"{path}/{what}")
            made["gone"] = self.spark.read.parquet(f"{path}/gone").count()
        if not self._commit(name, number, [*before, made]):
            self._fs.delete(self._path(f"{self.root}/{name}/{made['id']}"), True)

    # -- collections

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def create(self, name: str) -> DataFrame:
        """The collection; made empty if there is none."""
        if not self.exists(name):
            self._fs.mkdirs(self._path(f"{self.root}/{name}"))
        return self.read(name)

    def read(self, name: str, where=None) -> DataFrame:
        """All chunks; those of a missing collection are none."""
        rows = self._live(name, self._current(name)[1]).drop("segment", "key")
        return rows if where is None else rows.where(where)

    def keyed(self, name: str) -> DataFrame:
        """All chunks with their key."""
        return self._live(name, self._current(name)[1]).drop("segment")

    def add(self, name: str, chunks: DataFrame, sources: DataFrame, tries: int = 10) -> int:
        """Add ``chunks`` in the place of all chunks of ``sources`` (source); returns how many there are now of them.

        ``sources`` names those of the chunks too, and those to be deleted. What is written is these chunks and a list of
        what they replace, but for the merges that follow now and then.
        """
        self.create(name)
        made = None
        for _ in range(tries):
            number, segments = self._current(name)
            made = made or self._write(name, chunks, segments[0] if segments else None)
            now = self._lose(name, made, segments, sources) if segments else made
            if self._commit(name, number, [*segments, now]):
                self._merge(name)
                return now["rows"]
        raise Conflict(f"{tries} other writers of {name} were first")

    def replace(self, name: str, chunks: DataFrame) -> None:
        """``chunks`` in the place of all there are."""
        self.create(name)
        made = self._write(name, chunks, None)
        while not self._commit(name, self._current(name)[0], [made]):
            pass

    def words(self, name: str) -> keyword.Index | None:
        """The keyword index of the collection; none if it is empty."""
        _, segments = self._current(name)
        if not segments:
            return None
        parts = [keyword.read(self.spark, f"{self.root}/{name}/{s['id']}/words", s["id"]) for s in segments]
        gone = self._told(name, segments, "gone", _GONE)
        lost = None if gone is None else tuple(self._told(name, segments, x, schema).drop("segment") for x, schema in (("words", _WORDS), ("totals", _TOTALS)))
        return keyword.joined(parts, gone, lost)

    def vector_index(self, name: str) -> inverted_file.Index | None:
        """The index of the collection's vectors; none if it is empty or keeps none."""
        _, segments = self._current(name)
        if not segments or not all(s["model"] for s in segments):
            return None
        rows = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.root}/{name}/{s['id']}/vectors").withColumn("segment", F.lit(s["id"])) for s in segments))
        gone = self._told(name, segments, "gone", _GONE)
        rows = rows if gone is None else rows.join(small(gone), ["segment", "key"], "left_anti")
        return inverted_file.Index(inverted_file.read_model(self.spark, f"{self.root}/{name}/{segments[0]['model']}"), rows.drop("segment"))

    def delete_sources(self, name: str, sources: list[str]) -> None:
        if sources and self._current(name)[1]:
            self.add(name, self.spark.createDataFrame([], CHUNKS), self.spark.createDataFrame([(s,) for s in sources], "source string"))

    def drop(self, name: str) -> bool:
        return bool(self.exists(name) and self._fs.delete(self._path(f"{self.root}/{name}"), True))

    def names(self, excluded: tuple[str, ...] = ("eval-",)) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory())
        return sorted(n for n in found if not n.startswith(excluded))

    def count(self, name: str) -> int:
        """Chunks of the collection, from what its manifest tells."""
        return sum(s["rows"] - s["gone"] for s in self._current(name)[1])

    def list(self, excluded: tuple[str, ...] = ("eval-",)) -> list[dict]:
        """Name and number of chunks of each collection; an unreadable one has 0."""
        out = []
        for n in self.names(excluded):
            try:
                count = self.count(n)
            except Exception:
                count = 0
            out.append({"name": n, "chunk_count": count})
        return out

    def sources(self, name: str) -> DataFrame:
        return self.read(name).where("source IS NOT NULL").select("source").distinct().orderBy("source")

    def symbols(self, name: str) -> DataFrame:
        return self.read(name).where(F.coalesce("symbol_name", F.lit("")) != "").select("symbol_name").distinct().orderBy("symbol_name")

    def hashes(self, name: str) -> DataFrame:
        return sync.stored_hashes(self.read(name))
