"""Notebook claims: references in prose, the claim catalog, notebook blocks, checks.

Texts are handled line by line or cell by cell with higher-order functions; a
catalog's current section is carried forward by a scan in segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswerk.functions import patterns as P
from glosswerk.functions import text as X
from glosswerk.operators.settle import settled

# The wording of the catalog document.
CATALOG_NOTE = "> Auto-generated by `{}`. Do not edit manually."
CATALOG_CONTRACT = "**Contract:** If prose cites a value that disagrees with a row below, the prose is wrong — not the notebook.\n"
CATALOG_CONTENTS = "## Contents\n"
#: Stale values from which on automata are used, and what one automaton takes of them.
MANY = 200
BLOCK_VALUES, BLOCK_CHARS = 100_000, 4_000_000
VALUE_PARTS = 4
#: Lines of a catalog that one task carries a section through.
SEGMENT = 4096


def lines(files: DataFrame) -> DataFrame:
    """file, line (from 1), text of (file, content)."""
    return files.select("file", F.posexplode(F.split("content", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def refs(files: DataFrame) -> DataFrame:
    """raw, notebook, claim_id, file, line of every claim reference."""
    found = lines(files).select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(P.CLAIM_REFERENCE), F.lit(0))).alias("raw"))
    return found.select("raw", F.regexp_extract("raw", P.CLAIM_REFERENCE, 1).alias("notebook"), F.regexp_extract("raw", P.CLAIM_REFERENCE, 2).alias("claim_id"), "file", "line")


def _opened(found: DataFrame) -> DataFrame:
    """Lines (file, line, text) with the section that each heading opens."""
    heading = F.regexp_extract("text", P.CATALOG_HEADING, 1)
    return found.withColumn("opened", F.when(heading != "", F.struct(heading.alias("nb"), F.col("line").alias("at"))))


def _sections(found: DataFrame) -> DataFrame:
    """Lines with the section they stand in and that section's line.

    A prefix scan in segments: of every ``SEGMENT`` lines the last heading is found, these
    few are carried forward within their file, and each segment then fills its own
    lines.  So a catalog of any length is spread over tasks; only its segments' headings
    meet in one.
    """
    marked = _opened(found).withColumn("segment", F.floor(F.col("line") / SEGMENT))
    last = marked.groupBy("file", "segment").agg(F.max_by("opened", F.when(F.col("opened").isNotNull(), F.col("line"))).alias("last"))
    earlier = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file", "segment", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    so_far = Window.partitionBy("file", "segment").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.withColumn("mine", F.last("opened", ignorenulls=True).over(so_far)).join(carried, ["file", "segment"])
    return filled.withColumn("section", F.coalesce("mine", "carried")).drop("mine", "carried", "segment")


def notebooks(catalogs: DataFrame) -> DataFrame:
    """nb of every section, also those without a claim."""
    return _opened(lines(catalogs)).where("opened IS NOT NULL").select("opened.nb").distinct()


def claims(catalogs: DataFrame) -> DataFrame:
    """``claims_of`` of catalogs (file, content)."""
    return claims_of(lines(catalogs))


def claims_of(found: DataFrame) -> DataFrame:
    """nb, claim_id, text of the lines (file, line, text) of catalogs; a section opened
    again starts anew, and of a claim given twice the last counts."""
    rows = _sections(found)
    last = rows.where("opened IS NOT NULL").groupBy("file", F.col("opened.nb").alias("nb")).agg(F.max("opened.at").alias("at"))
    cells = F.filter(F.transform(F.split("text", "\\|", -1), X.strip), lambda c: c != "")
    row = rows.where(F.col("section").isNotNull() & F.col("opened").isNull() & F.startswith("text", F.lit("|"))).select("file", "line", "section.nb", "section.at", cells.alias("cells"))
    found = row.join(last, ["file", "nb", "at"], "left_semi").where(F.size("cells") >= 2).withColumn("claim_id", F.regexp_extract(F.get("cells", F.lit(0)), P.CATALOG_CLAIM.replace("$", "\\z"), 1)).where("claim_id != ''")
    text = F.array_join(F.slice("cells", 2, F.size("cells")), " | ")
    return found.groupBy("nb", "claim_id").agg(F.max_by(text, F.struct("file", "line")).alias("text"))


def missing(references: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Issues of references whose notebook or claim is not in the catalog."""
    known, listed = notebooks(catalogs).withColumn("known", F.lit(True)), claims(catalogs).select(F.col("nb").alias("notebook"), "claim_id", F.lit(True).alias("listed"))
    checked = references.join(known.withColumnRenamed("nb", "notebook"), "notebook", "left").join(listed, ["notebook", "claim_id"], "left").where("listed IS NULL")
    no_notebook = F.col("known").isNull()
    return checked.select(
        F.lit("error").alias("severity"),
        F.when(no_notebook, "missing_notebook").otherwise("missing_claim").alias("type"),
        F.col("raw").alias("ref"),
        "file",
        "line",
        F.when(no_notebook, F.concat("notebook", F.lit(" not found in aggregate Key Claims"))).otherwise(F.concat("raw", F.lit(" — claim "), "claim_id", F.lit(" not found in "), "notebook")).alias("message"),
    )


def _cells(json: Column) -> Column:
    """Sources of the markdown cells; null for text that is no JSON."""
    cells = F.try_variant_get(F.try_parse_json(json), "$.cells", "array<variant>")
    markdown = F.filter(F.coalesce(cells, F.array().cast("array<variant>")), lambda c: F.coalesce(F.try_variant_get(c, "$.cell_type", "string") == "markdown", F.lit(False)))
    source = lambda c: F.coalesce(F.array_join(F.try_variant_get(c, "$.source", "array<string>"), ""), F.try_variant_get(c, "$.source", "string"), F.lit(""))
    return F.when(F.try_parse_json(json).isNotNull(), F.transform(markdown, source))


def prose(notebook_files: DataFrame) -> DataFrame:
    """file, content of notebooks: their markdown cells joined; no row for bad JSON."""
    return notebook_files.select("file", F.array_join(_cells(F.col("json")), "\n").alias("content")).where("content IS NOT NULL")


def blocks(notebook_files: DataFrame) -> DataFrame:
    """file, label, stem, block, claim_count of (file, json); null block without one.

    The block goes from the heading's next line to the next heading of its level or
    the end of the cell; an empty one counts as none.
    """
    named = notebook_files.where(F.col("file").rlike(r"^[0-9]+") & F.endswith("file", F.lit(".ipynb")))
    cell = F.get(F.filter(_cells(F.col("json")), lambda s: F.regexp_like(s, F.lit(f"(?m){P.BLOCK_HEADING}"))), F.lit(0))
    rows = named.withColumn("ls", F.split(cell, "\n", -1))
    heading = F.array_position(F.transform("ls", lambda x: F.regexp_like(x, F.lit(P.BLOCK_HEADING))), True).cast("int")
    rows = rows.withColumn("rest", F.slice("ls", heading + 1, F.greatest(F.size("ls"), F.lit(1))))
    stop = F.array_position(F.transform("rest", lambda x: F.regexp_like(x, F.lit(P.NEXT_HEADING))), True).cast("int")
    kept = F.when(stop > 0, F.slice("rest", 1, stop - 1)).otherwise(F.col("rest"))
    block = X.some(X.strip(F.array_join(kept, "\n")))
    rows = rows.select("file", X.notebook_label(F.col("file")).alias("label"), F.regexp_replace("file", r"\.ipynb$", "").alias("stem"), block.alias("block"))
    return rows.withColumn("claim_count", F.when(F.col("block").isNotNull(), F.regexp_count("block", F.lit(P.CLAIM_ROW))).otherwise(0).cast("long"))


def block_stats(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("notebooks_scanned"),
        F.count("block").alias("notebooks_with_claims"),
        F.count_if(F.col("block").isNull()).alias("notebooks_without"),
        F.coalesce(F.sum("claim_count"), F.lit(0)).cast("long").alias("total_claims"),
    )


def markdown(found: DataFrame, title: str = "Notebook Key Claims", generator: str = "glosswerk aggregate") -> DataFrame:
    """place (from 1), line: the catalog document, notebooks by number, then name.

    Its pieces are sorted over ranges; the lines of a range begin where those before it
    end, which the ranges' line counts tell.  No task or row holds the document.
    """
    number = F.regexp_extract("file", r"^(\d+)", 1).cast("decimal(38,0)")
    entry = F.concat(F.lit("- ["), "label", F.lit(": `"), "stem", F.lit("`](#"), X.anchor(F.col("label"), F.col("stem")), F.lit(") ("), F.col("claim_count").cast("string"), F.lit(" claims)"))
    section = F.concat(F.lit("## "), "label", F.lit(": `"), "stem", F.lit("`\n\n"), "block", F.lit("\n"))
    both = F.array(F.struct(F.lit(1).alias("part"), entry.alias("piece")), F.struct(F.lit(3).alias("part"), section.alias("piece")))
    listed = found.where("block IS NOT NULL").select(number.alias("n"), "file", F.inline(both))
    totals = found.where("block IS NOT NULL").agg(F.count("*").alias("n"), F.coalesce(F.sum("claim_count"), F.lit(0)).alias("claims"))
    head = F.concat_ws("\n", F.lit(f"# {title}\n"), F.lit(CATALOG_NOTE.format(generator)), F.concat(F.lit("> "), "n", F.lit(" notebooks, "), "claims", F.lit(" claims.\n")), F.lit(CATALOG_CONTRACT), F.lit(CATALOG_CONTENTS))
    frame = totals.select(F.lit(None).cast("decimal(38,0)").alias("n"), F.lit(None).cast("string").alias("file"), F.inline(F.array(F.struct(F.lit(0).alias("part"), head.alias("piece")), F.struct(F.lit(2).alias("part"), F.lit("").alias("piece")))))
    pieces = listed.unionByName(frame).withColumn("ls", F.split("piece", "\n", -1)).drop("piece")
    sorted_ = settled(pieces.repartitionByRange("part", "n", "file").sortWithinPartitions("part", "n", "file").withColumn("range", F.spark_partition_id()))
    counts = sorted_.groupBy("range").agg(F.sum(F.size("ls")).alias("lines"))
    starts = counts.select("range", F.coalesce(F.sum("lines").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    before = Window.partitionBy("range").orderBy("part", "n", "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = sorted_.withColumn("before", F.coalesce(F.sum(F.size("ls")).over(before), F.lit(0))).join(starts, "range")
    return placed.select("start", "before", F.posexplode("ls").alias("at", "line")).select((F.col("start") + F.col("before") + F.col("at") + 1).alias("place"), "line")


def status(notebook_files: DataFrame) -> DataFrame:
    """file, label, has_block, verified_date, claim_count, error of (file, json).

    Here the marker may stand anywhere in a cell, and claims of the whole cell count.
    """
    named = notebook_files.where(F.col("file").rlike(r"^[0-9]+") & F.endswith("file", F.lit(".ipynb")))
    cells = _cells(F.col("json"))
    cell = F.get(F.filter(cells, lambda s: F.contains(s, F.lit(P.BLOCK_MARKER))), F.lit(0))
    rows = named.select("file", X.notebook_label(F.col("file")).alias("label"), cell.alias("cell"), cells.isNull().alias("bad"))
    return rows.select(
        "file",
        "label",
        F.col("cell").isNotNull().alias("has_block"),
        X.first(F.col("cell"), P.VERIFIED).alias("verified_date"),
        F.coalesce(F.regexp_count("cell", F.lit(P.CLAIM_ROW)), F.lit(0)).cast("long").alias("claim_count"),
        F.when(F.col("bad"), "parse error").alias("error"),
    )


def missing_blocks(statuses: DataFrame, references: DataFrame) -> DataFrame:
    """Notebooks cited in prose that have no block."""
    cited = references.select(F.col("notebook").alias("label")).distinct()
    found = statuses.where(~F.col("has_block")).join(cited, "label", "left_semi")
    return found.select(F.lit("warn").alias("severity"), F.lit("missing_key_claims_block").alias("type"), "file", F.concat("label", F.lit(" is cited in prose but has no Key Claims block")).alias("message"))


def stats(references: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of counts over references and issues (severity)."""
    seen = references.agg(F.count("*").alias("total_refs"), F.count_distinct("notebook").alias("unique_notebooks"), F.count_distinct("notebook", "claim_id").alias("unique_claims"))
    counted = issues.agg(F.count("*").alias("issue_count"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    return seen.join(counted, F.lit(True))


def _message(value: str) -> str:
    return f'"{value}" may be stale (pre-fix)'


def stale(files: DataFrame, values: list[tuple[str, str | None, str | None]] | DataFrame) -> DataFrame:
    """Lines that contain a stale value anywhere, also inside a longer number.

    ``values``: (value, message or None, correction or None), as a list or a DataFrame with
    these columns.  A short list is tested in place, line by line: no join.  From ``MANY``
    values on, and for DataFrames, the lines are read by automata that find all values at
    once.
    """
    if isinstance(values, DataFrame):
        return _stale_by_automata(files, values)
    if len(values) >= MANY:
        return _stale_by_automata(files, files.sparkSession.createDataFrame(values, "value string, message string, correction string"))
    rules = F.array(*(F.struct(F.lit(v).alias("value"), F.lit(m or _message(v)).alias("message"), F.lit(c).cast("string").alias("correction")) for v, m, c in values))
    hits = lines(files).select("file", "line", F.inline(F.filter(rules, lambda r: F.contains("text", r["value"]))))
    return _stale_issues(hits)


def _stale_issues(hits: DataFrame) -> DataFrame:
    return hits.select(F.lit("warn").alias("severity"), F.lit("potentially_stale").alias("type"), "file", "line", "value", "message", "correction")


def _stale_by_automata(files: DataFrame, values: DataFrame) -> DataFrame:
    """The values go, in blocks of ``BLOCK_VALUES`` and about ``BLOCK_CHARS``, to every task,
    which builds an Aho-Corasick automaton of a block and reads its lines once; what a
    value says is joined to its hits afterwards."""
    spark = files.sparkSession
    message = F.coalesce(X.some(F.col("message")), F.concat(F.lit('"'), "value", F.lit('" may be stale (pre-fix)')))
    rules = settled(values.where("value IS NOT NULL").select("value", message.alias("message"), "correction"))
    distinct = settled(rules.select("value").distinct().repartition(VALUE_PARTS, "value").mapInArrow(_blocks_of_values, "vs array<string>").withColumn("block", F.monotonically_increasing_id()))
    read = lines(files).where("text IS NOT NULL")
    found = []
    for block in (r.block for r in distinct.select("block").collect()):
        sent = spark.sparkContext.broadcast(distinct.where(F.col("block") == block).first().vs)
        found.append(read.mapInArrow(_finder(sent), "file string, line int, value string"))
    hits = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "file string, line int, value string")
    return _stale_issues(hits.join(rules, "value"))


def _blocks_of_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for value in batch.column("value").to_pylist():
            if held and (len(held) >= BLOCK_VALUES or size + len(value) > BLOCK_CHARS):
                yield pa.RecordBatch.from_arrays([pa.array([held], pa.list_(pa.string()))], names=["vs"])
                held, size = [], 0
            held.append(value)
            size += len(value)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.list_(pa.string()))], names=["vs"])


def _finder(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, everywhere = ahocorasick.Automaton(), [v for v in sent.value if not v]
        for v in sent.value:
            if v:
                automaton.add_word(v, v)
        automaton.make_automaton()
        some = len(automaton) > 0
        for batch in batches:
            rows, values = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                met = [*{v for _, v in automaton.iter(text)}, *everywhere] if some else everywhere
                rows += [k] * len(met)
                values += met
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("file").take(at), batch.column("line").take(at), pa.array(values, pa.string())], names=["file", "line", "value"])

    return run
