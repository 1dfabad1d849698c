"""Live answers of a bibliographic registry and a preprint server, asked once and kept.

Requests are rows (key, url).  Those that a Parquet cache already answers are left out
by an anti-join; the others are asked in rounds.  A round deals its requests out to
``tasks`` tasks, each of which asks one after the other at its share of ``rate``
requests a second, so the server never sees more than ``tasks`` at a time nor more than
``rate`` a second.  A round's answers are committed to the cache before the next round
starts: a later run, or one after a failure, asks nothing that was committed, a task that is
tried again asks its own ``batch`` requests at most again, and nobody asks a key twice
within a run.

An answer has a status and a body, or an error in its place: ``timeout``, the socket's
message, ``too many redirects`` or ``too large``.  Answers of 5xx, 429 and errors are kept
too, but may be asked again (``retry=True``), the others never.  Redirects are followed to
http and https alone, ``redirects`` times at most, each within the same time limit.
"""

from __future__ import annotations

import http.client
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.error import HTTPError, URLError
from urllib.parse import urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where the services answer, how long is waited, and how often is asked.
REGISTRY = "https://api.crossref.org"
PREPRINTS = "https://arxiv.org"
LISTING = "https://export.arxiv.org"
AGENT = "glosswerk/0.1 (citation checks)"
TIMEOUT = 10.0
PER_SECOND = 10.0
SEARCH_ROWS = 3

ANSWER = "key string, url string, status int, body string, error string"


@dataclass(frozen=True)
class Limits:
    """How a server may be asked; ``batch`` requests are what one task asks in a round."""

    timeout: float = TIMEOUT
    redirects: int = 0
    rate: float = PER_SECOND
    tasks: int = 4
    batch: int = 50
    most_bytes: int = 1 << 24


class _Stop(HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def fetch(url: str, limits: Limits) -> tuple[int | None, str | None, str | None]:
    """(status, body, error) of one GET, redirects included."""
    opener, end = build_opener(_Stop), time.monotonic() + limits.timeout
    for _ in range(limits.redirects + 1):
        if urlsplit(url).scheme not in ("http", "https"):
            return None, None, f"no http address: {url}"
        try:
            with _open(opener, url, max(0.001, end - time.monotonic())) as answer:
                status, onward = answer.status, answer.headers.get("Location")
                if limits.redirects and 300 <= status < 400 and onward:
                    url = urljoin(url, onward)
                    continue
                return _body(answer, status, end, limits.most_bytes)
        except (TimeoutError, URLError, OSError, http.client.HTTPException, ValueError) as e:
            reason = getattr(e, "reason", e)
            return None, None, "timeout" if isinstance(reason, TimeoutError) else str(reason) or type(reason).__name__
    return None, None, "too many redirects"


def _open(opener, url: str, timeout: float):
    try:
        return opener.open(Request(url, headers={"User-Agent": AGENT}), timeout=timeout)
    except HTTPError as e:  # a status, not a failure
        return e


def _body(answer, status: int, end: float, most: int) -> tuple[int | None, str | None, str | None]:
    parts, size = [], 0
    while part := answer.read1(1 << 16) if hasattr(answer, "read1") else answer.read(1 << 16):
        parts.append(part)
        size += len(part)
        if size > most:
            return None, None, "too large"
        if time.monotonic() > end:
            return None, None, "timeout"
    return status, b"".join(parts).decode("utf-8", "replace"), None


def _ask(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pause, due = limits.tasks / limits.rate, time.monotonic()
        for batch in batches:
            for key, url in zip(batch.column("key").to_pylist(), batch.column("url").to_pylist(), strict=True):
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic()) + pause
                answer = fetch(url, limits)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([url]), pa.array([answer[0]], pa.int32()), pa.array([answer[1]], pa.string()), pa.array([answer[2]], pa.string())], names=["key", "url", "status", "body", "error"])

    return run


class Answers:
    """The cache below ``path``, a folder that all executors share; rounds are its parts
    and the last answer to a key counts."""

    def __init__(self, spark: SparkSession, path: str, limits: Limits | None = None):
        self.spark, self.path, self.limits = spark, path.rstrip("/"), limits or Limits()

    def _rounds(self) -> list[int]:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(conf)
        if not fs.exists(top):
            return []
        done = [s.getPath() for s in fs.listStatus(top) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("round=")) for p in done)

    def kept(self) -> DataFrame:
        """key, url, status, body, error of every key that was answered."""
        rounds = self._rounds()
        if not rounds:
            return self.spark.createDataFrame([], ANSWER)
        parts = self.spark.read.schema(ANSWER).option("basePath", self.path).parquet(*(f"{self.path}/round={r}" for r in rounds))
        number = F.regexp_extract(F.col("_metadata.file_path"), r"round=(\d+)/", 1).cast("long")
        last = parts.withColumn("__round", number).groupBy("key").agg(F.max_by(F.struct("url", "status", "body", "error"), "__round").alias("a"))
        return last.select("key", "a.*")

    def ask(self, requests: DataFrame, retry: bool = False) -> DataFrame:
        """Answers to (key, url), those not yet kept asked for; null keys are left out."""
        asked = requests.where("key IS NOT NULL").groupBy("key").agg(F.min("url").alias("url"))
        settled = F.col("error").isNull() & (F.coalesce("status", F.lit(0)) < 500) & (F.col("status") != 429)
        kept = self.kept().where(settled if retry else F.lit(True)).select("key")
        limits, rounds = self.limits, self._rounds()
        number = rounds[-1] + 1 if rounds else 0
        # The list is written first, so that what a round asks does not hang on what it adds.
        open_ = asked.join(kept, "key", "left_anti").withColumn("h", F.xxhash64("key"))
        plan = f"{self.path}-asked/{number}-{time.time_ns()}"
        open_.write.parquet(plan)
        open_ = self.spark.read.parquet(plan)
        n = open_.count()
        turns = math.ceil(n / (limits.tasks * limits.batch))
        for turn in range(turns):
            mine = open_.where(F.pmod("h", F.lit(turns)) == turn).select("key", "url")
            mine.repartition(limits.tasks).mapInArrow(_ask(limits), ANSWER).write.mode("overwrite").parquet(f"{self.path}/round={number + turn}")
        return asked.select("key").join(self.kept(), "key")


def uri_part(text: Column) -> Column:
    """Percent-encoded as a part of an address, a space as ``%20``."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for plain, coded in (("~", "%7E"), ("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def lookups(answers: Answers, dois: DataFrame, base: str = REGISTRY) -> DataFrame:
    """doi, status, body, error of each distinct (doi); for ``registry.records``."""
    url = F.concat(F.lit(f"{base}/works/"), uri_part(F.col("doi")))
    found = answers.ask(dois.select(F.concat(F.lit("doi:"), "doi").alias("key"), url.alias("url")))
    return found.select(F.substring("key", 5, 1 << 30).alias("doi"), "status", "body", "error")


def searches(answers: Answers, titles: DataFrame, base: str = REGISTRY, hits: int = SEARCH_ROWS) -> DataFrame:
    """query, status, body of each distinct (title); for ``registry.hit_records``."""
    url = F.concat(F.lit(f"{base}/works?query.bibliographic="), uri_part(F.col("title")), F.lit(f"&rows={hits}"))
    found = answers.ask(titles.select(F.concat(F.lit(f"title{hits}:"), "title").alias("key"), url.alias("url")))
    return found.select(F.substring("key", len(f"title{hits}:") + 1, 1 << 30).alias("query"), "status", "body", "error")


def pages(answers: Answers, papers: DataFrame, base: str = PREPRINTS) -> DataFrame:
    """paper, html of the first version of each distinct (id); null where it has none."""
    url = F.concat(F.lit(f"{base}/html/"), F.col("id"), F.lit("v1"))
    found = answers.ask(papers.select(F.concat(F.lit("page:"), "id").alias("key"), url.alias("url")))
    return found.select(F.substring("key", 6, 1 << 30).alias("paper"), F.col("body").alias("html"))


def listing(answers: Answers, count: int, category: str, base: str = LISTING) -> DataFrame:
    """feed, xml of the newest ``count`` papers of a category, asked anew each time."""
    query = f"{base}/api/query?search_query=cat:{category}&sortBy=submittedDate&sortOrder=descending&max_results={count}"
    one = answers.spark.createDataFrame([(f"feed:{category}:{count}:{time.time_ns()}", query)], "key string, url string")
    return answers.ask(one).select(F.lit(category).alias("feed"), F.col("body").alias("xml"))
