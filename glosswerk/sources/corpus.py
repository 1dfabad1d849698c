"""Text corpora, notebooks and bibliographies: which files of a tree each scan takes."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glosswerk.functions.bibtex import entries
from glosswerk.operators.bibliography import SOURCE
from glosswerk.sources import tree

# Which files a scan takes and which names it leaves out.
SCANS = {
    "audit": {"extensions": ".md,.html,.js", "exclude": "node_modules,.git,dist", "dot": True},
    "claims": {"extensions": ".md,.tex,.html,.py,.ipynb", "exclude": "node_modules,.git,dist,__pycache__,.ipynb_checkpoints", "dot": False},
    "cross_repo": {"extensions": ".md,.py,.tex", "exclude": "node_modules,.git", "dot": True},
}


class BibtexSource(DataSource):
    """citation_key, entry_type, tags, pos of BibTeX files; one partition for each file.
    Places count up in a file, and those of a later file are greater.  Option ``paths``:
    JSON list of files."""

    @classmethod
    def name(cls) -> str:
        return "glosswerk_bibtex"

    def schema(self) -> str:
        return "citation_key string, entry_type string, tags map<string,string>, pos long"

    def reader(self, schema) -> DataSourceReader:
        return _BibReader(self.options)


class _BibReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in enumerate(json.loads(self.options["paths"]))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        source, path = partition.value
        with open(path, encoding="utf-8", errors="replace") as f:
            for pos, (key, kind, found) in enumerate(entries(f.read()), source * SOURCE):
                yield key, kind, found, pos


def corpus(spark: SparkSession, path: str, scan: str = "audit") -> DataFrame:
    """file, name, content below ``path`` as one of ``SCANS`` takes them."""
    return tree.scan(spark, path, **SCANS[scan])


def notebooks(spark: SparkSession, path: str) -> DataFrame:
    """file, json of the notebooks directly in ``path`` whose names begin with a digit."""
    found = tree.listing(spark, path, ".ipynb", deep=False).where("name RLIKE '^[0-9]'")
    return tree.contents(spark, path, found).selectExpr("file", "content AS json")


def bibtex(spark: SparkSession, *paths: str) -> DataFrame:
    spark.dataSource.register(BibtexSource)
    return spark.read.format("glosswerk_bibtex").option("paths", json.dumps(paths)).load()


def claim_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, content of the claims scan; notebooks give the text of their cells."""
    from glosswerk.operators import claims

    found = corpus(spark, path, "claims")
    plain = found.where("NOT endswith(name, '.ipynb')").select("file", "content")
    return plain.unionByName(claims.prose(found.where("endswith(name, '.ipynb')").selectExpr("file", "content AS json")))
