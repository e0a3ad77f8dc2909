"""A full-text index in segments: a batch of changes writes one small segment and a list of dead ids; merges are jobs of their own."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fts


@dataclass(frozen=True)
class Segment:
    """A folder of postings. ``seq`` orders segments: what is dead as of a segment is dead in all of lesser ``seq``."""

    name: str
    seq: int
    docs: int


class SegmentedIndex:
    """Live segments under a path, as its last manifest names them.

    A manifest is a small file with the number of its version; it is created only if there is none of that
    number, so of two writers one has to read again and retry. Segments are
    never changed, so a search sees one version to its end.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    @staticmethod
    def create(spark: SparkSession, path: str, fields: list[str], key: str = "id", kind: str = "bigint", stemmed: bool = True) -> SegmentedIndex:
        """An index without documents, of some columns of rows whose ``key`` is of type ``kind``."""
        index = SegmentedIndex(spark, path)
        index._publish({"version": 0, "fields": fields, "key": key, "kind": kind, "stemmed": stemmed, "segments": []})
        return index

    def manifest(self) -> dict:
        """The last version."""
        found = sorted(x.getPath().getName() for x in self._fs.listStatus(self._at("manifest")) if x.getPath().getName().endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{found[-1]}", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> bool:
        """Whether this version could be put in place: false if another writer was first."""
        at = self._at(f"manifest/{manifest['version']:010d}.json")
        draft = self._at(f"drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(at.getParent())
        # A rename neither replaces a file nor shows half of one.
        if self._fs.exists(at):
            return False
        return self._fs.rename(draft, at)

    def _change(self, change) -> None:
        while True:
            old = self.manifest()
            new = change([Segment(**s) for s in old["segments"]])
            if new is None or self._publish(old | {"version": old["version"] + 1, "segments": [s.__dict__ for s in new]}):
                return

    def segments(self) -> list[Segment]:
        return [Segment(**s) for s in self.manifest()["segments"]]

    def apply(self, name: str, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Put ``changed`` rows (key and fields, keys unique) in the place of those of their keys, and take out the keys of ``removed``.

        ``name`` names the batch: one that is applied already changes nothing, so a batch can be
        run again after any failure.
        """
        about = self.manifest()
        if any(s["name"] == name for s in about["segments"]) or self._fs.exists(self._at(f"merged/{name}")):
            return
        key = about["key"]
        at = f"{self.path}/segments/{name}"
        fts.write_index(changed.select(key, *about["fields"]), about["fields"], at, key, about["stemmed"])
        gone = changed.select(key) if removed is None else changed.select(key).unionByName(removed.select(key))
        gone.where(F.col(key).isNotNull()).distinct().write.mode("overwrite").parquet(f"{self.path}/dead/{name}")
        docs = self.spark.read.parquet(f"{at}/totals").first()["n"]
        self._change(lambda now: None if any(s.name == name for s in now) else [*now, Segment(name, 1 + max((s.seq for s in now), default=0), docs)])

    def _rows(self, segments: list[Segment], about: dict) -> DataFrame:
        """The postings of some segments, the newest of them included, that no newer one of them has put out."""
        schema, key = fts.post_schema(about["key"], about["kind"]), about["key"]
        if not segments:
            return self.spark.createDataFrame([], schema).withColumn("_seq", F.lit(0))
        one = lambda s: self.spark.read.schema(schema).parquet(f"{self.path}/segments/{s.name}/post").withColumn("_seq", F.lit(s.seq))
        post = reduce(DataFrame.unionByName, map(one, segments))
        if len(segments) == 1:
            return post
        gone = self._dead(segments, about).groupBy(F.col(key).alias("_key")).agg(F.max("_dead").alias("_dead"))
        post = post.join(gone, post[key] == gone["_key"], "left").where(F.col("_dead").isNull() | (F.col("_seq") >= F.col("_dead")))
        return post.drop("_key", "_dead")

    def _dead(self, segments: list[Segment], about: dict) -> DataFrame:
        schema = f"`{about['key']}` {about['kind']}"
        one = lambda s: self.spark.read.schema(schema).parquet(f"{self.path}/dead/{s.name}").withColumn("_dead", F.lit(s.seq))
        return reduce(DataFrame.unionByName, map(one, segments))

    def live(self) -> fts.Index:
        """What searches take: the postings of all segments less what later ones have put out."""
        about = self.manifest()
        rows = self._rows([Segment(**s) for s in about["segments"]], about).drop("_seq")
        return fts.Index(rows.where("bucket >= 0"), fts.totals_of(rows), about["stemmed"], rows.where("bucket < 0").select(about["key"], "dl"))

    def due(self) -> list[Segment]:
        """The newest segments that a merge should make one of: as far back as each is not twice as large as all after it together.

        So a document is written anew about as often as the number of documents can be halved.
        """
        found = sorted(self.segments(), key=lambda s: -s.seq)
        run, total = [], 0
        for s in found:
            if run and s.docs > 2 * max(1, total):
                break
            run.append(s)
            total += s.docs
        return run[::-1] if len(run) > 1 else []

    def merge(self, run: list[Segment] | None = None) -> Segment | None:
        """Write neighbouring segments (those that are due) as one, without what is dead in them; searches go on meanwhile."""
        run = self.due() if run is None else sorted(run, key=lambda s: s.seq)
        if len(run) < 2:
            return None
        about, names = self.manifest(), {s.name for s in run}
        key = about["key"]
        name = f"merged-{uuid.uuid4().hex}"
        rows = self._rows(run, about).drop("_seq")
        fts.store_postings(rows, f"{self.path}/segments/{name}", key)
        # What they put out is still dead in older segments, if there are any.
        older = any(s.seq < run[0].seq for s in self.segments())
        self._dead(run, about).select(key).distinct().where(F.lit(older)).write.parquet(f"{self.path}/dead/{name}")
        docs = self.spark.read.schema(fts.post_schema(key, about["kind"])).parquet(f"{self.path}/segments/{name}/post").where("bucket < 0").count()
        merged = Segment(name, run[-1].seq, docs)
        for s in run:  # a batch that runs again must know that it is in
            self._fs.create(self._at(f"merged/{s.name}"), True).close()

        def change(now: list[Segment]) -> list[Segment] | None:
            if not names <= {s.name for s in now}:
                return None  # another merge was first
            return sorted([*(s for s in now if s.name not in names), merged], key=lambda s: s.seq)

        self._change(change)
        return merged
