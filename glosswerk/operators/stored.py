"""A stored citation index: versions of one table of entries, written by several sessions.

Every write adds one Parquet folder of changed entries (a delta) and publishes a manifest,
a small file that lists the folders of its version: a base and the deltas on top.  A
manifest is published by a rename that fails where the version is already there, so of
two sessions that write at once the second sees the first's version and puts its delta
on top of it; readers see a version whole or not at all.  Reading merges: the last delta
that has an id counts.  After ``DELTAS`` deltas a write first merges them into a new base.
Folders of older versions stay, so any version can be read and any two compared.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswerk.functions import text as X

DELTAS = 8
ENTRY = "id string, authors array<string>, title string, year int, journal string, doi string, arxiv string, local_pdf string, verified boolean, verified_source string, added string"
_DELTA = f"{ENTRY}, gone boolean"
_COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]


class CitationIndex:
    """The index below ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        top = self._path("versions")
        self._fs = top.getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._fs.mkdirs(top)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("versions"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"base": None, "deltas": []}
        stream = self._fs.open(self._path(f"versions/{version:012}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> bool:
        """False if another session has published this version."""
        draft = self._path(f"versions/{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            self._context.rename(draft, self._path(f"versions/{version:012}.json"), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as e:
            if not self._fs.exists(self._path(f"versions/{version:012}.json")):
                raise e
            self._fs.delete(draft, False)
            return False

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def _merged(self, manifest: dict) -> DataFrame:
        """The last row of each id; those that are gone are left out."""
        folders = [*filter(None, [manifest["base"]]), *manifest["deltas"]]
        if not folders:
            return self.spark.createDataFrame([], ENTRY)
        read = lambda name: self.spark.read.schema(_DELTA).parquet(f"{self.path}/data/{name}")
        if len(folders) == 1:
            rows = read(folders[0])
        else:
            turns = reduce(DataFrame.unionByName, (read(name).withColumn("turn", F.lit(k)) for k, name in enumerate(folders)))
            rows = turns.groupBy("id").agg(F.max_by(F.struct(*_COLUMNS[1:], "gone"), "turn").alias("r")).select("id", "r.*")
        return rows.where("NOT gone").select(*_COLUMNS)

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version and version not in known:
            raise ValueError(f"no version {version} of {self.path}")
        return self._merged(self._manifest(version))

    def _apply(self, rows: DataFrame) -> int:
        name = self._write(rows)
        while True:
            last = (self.versions() or [0])[-1]
            manifest = self._manifest(last)
            if len(manifest["deltas"]) >= DELTAS:
                base = self._write(self._merged(manifest).withColumn("gone", F.lit(False)))
                manifest = {"base": base, "deltas": []}
            manifest["deltas"] = [*manifest["deltas"], name]
            if self._publish(last + 1, manifest):
                return last + 1

    def upsert(self, entries: DataFrame) -> int:
        """Adds entries or replaces those of the same id; the version that has them.
        Missing columns are null; of several rows with an id the greatest counts."""
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], ENTRY).schema}
        full = entries.select(*(F.col(c).cast(kinds[c]).alias(c) if c in entries.columns else F.lit(None).cast(kinds[c]).alias(c) for c in _COLUMNS))
        one = full.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct(*_COLUMNS[1:])).alias("r")).select("id", "r.*")
        return self._apply(one.withColumn("gone", F.lit(False)))

    def remove(self, ids: DataFrame) -> int:
        """Takes the entries of (id) out."""
        empty = self.spark.createDataFrame([], _DELTA)
        return self._apply(empty.unionByName(ids.where("id IS NOT NULL").select("id").distinct().withColumn("gone", F.lit(True)), allowMissingColumns=True))

    def index(self, bib: DataFrame, works: DataFrame | None = None, added: str | None = None) -> int:
        """The entries of a bibliography, verified where ``works`` has their DOI."""
        known = None if works is None else works.select(F.col("doi"), F.lit(True).alias("known")).distinct()
        rows = bib.withColumn("known", F.lit(False)) if known is None else bib.join(known, "doi", "left")
        rows = rows.withColumn("verified", F.coalesce("known", F.lit(False)))
        return self.upsert(rows.withColumns({"verified_source": F.when(F.col("verified"), "registry"), "added": F.lit(added)}))

    def add(self, records: DataFrame, added: str | None = None) -> int:
        """Works looked up in a registry (``registry.records`` or ``registry.verify``), those
        that were found.  An id is the first author's surname and the year; where it
        names another work already, or two of these, the DOI is attached.  A work that is
        in the index by its DOI keeps its id."""
        found = records.where("verified").groupBy("doi").agg(F.min(F.struct("title", "authors", "journal", "year")).alias("w")).select("doi", "w.*")
        short = F.concat(F.coalesce(F.regexp_replace(X.surname(F.col("authors")), "[^a-z0-9]", ""), F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")))
        found = found.withColumn("short", short)
        now = self.read()
        own = now.where("doi IS NOT NULL").groupBy("doi").agg(F.min("id").alias("own"))
        taken = now.select(F.col("id").alias("short"), F.lit(True).alias("taken"))
        many = F.count("*").over(Window.partitionBy("short")) > 1
        named = found.join(own, "doi", "left").join(taken, "short", "left").withColumn("many", many)
        i = F.coalesce("own", F.when(F.coalesce("taken", F.lit(False)) | F.col("many") | (F.col("short") == ""), F.concat_ws("-", F.nullif("short", F.lit("")), "doi")).otherwise(F.col("short")))
        return self.upsert(named.withColumns({"id": i, "verified": F.lit(True), "verified_source": F.lit("registry"), "added": F.lit(added)}))

    def diff(self, old: int, new: int) -> DataFrame:
        """id, change (added, removed, changed) and, of changed ones, the columns that differ."""
        a, b = (self.read(v).select("id", F.struct(*_COLUMNS[1:]).alias(n)) for v, n in ((old, "a"), (new, "b")))
        both = a.join(b, "id", "full_outer")
        differ = F.filter(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in _COLUMNS[1:])), lambda c: c.isNotNull())
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(differ) > 0, "changed")
        return both.select("id", change.alias("change"), F.when(change == "changed", differ).alias("columns"), F.col("a.title").alias("old_title"), F.col("b.title").alias("new_title")).where("change IS NOT NULL")
