"""Line dedup by site-relative frequency: lines that more than a few percent of a host's pages carry are boilerplate.

For each host (`source`) the pages that contain a line are divided by the host's pages; lines above the ratio, found on
`least_pages` pages or more, are dropped from every page of the host.  A page counts a line once.  Blank lines are
kept and never counted.  Only a host's boilerplate comes back to its pages: at most (lines of a mean page / ratio)
hashes, as each counts on a `ratio` share of the pages.  Texts are not shuffled while all hosts' boilerplate is small
enough to broadcast (`MAX_BROADCAST`, checked); beyond that pages are joined with it by host, in salted parts.

Lines are counted, before any shuffle, by the hash of host and line, so a host with a third of all pages is spread.
Equality of lines is equality of 64-bit hashes.

Cases: null text stays null and counts as a page without lines; a null source is a host of its own; repeated rows count
as pages; a text whose lines all go becomes empty; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import free_name, materialise, quoted, table, text_or_empty
from tempora.llm.quality_rules import bind

#: Share of a host's pages above which a line is boilerplate, and the least number of pages that carry it.  A template
#: line need not stand on most pages: sections, languages and years of a site have their own, so a few percent tell it
#: from prose.  Two pages that agree may be copies of one page, which op6 thins and this would empty; three are a pattern.
RATIO, LEAST_PAGES = 0.02, 3
#: Boilerplate lines (8 bytes each) that are broadcast at most, and parts of a host beyond that.
MAX_BROADCAST, SALTS = 500_000, 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(documents: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, bad): the hashes of each host's boilerplate lines."""
    rows = documents.select(F.xxhash64(F.coalesce(F.col("source"), F.lit("\x00"))).alias("host"), text_or_empty("text").alias("text"))
    pages = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))
    carried = rows.select("host", F.explode_outer(lines).alias("line")).where("line is not null").groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    frequent = carried.join(pages, "host").where(F.col("n") > ratio * F.col("pages"))
    return materialise(frequent.groupBy("host").agg(F.collect_list("line").alias("bad")), "boilerplate")


def drop_boilerplate(documents: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """documents with the boilerplate lines taken out of text."""
    of, lines_of, salt = (free_name(documents, x) for x in ("host", "bad", "salt"))
    bad = boilerplate(documents, ratio, least_pages).withColumnsRenamed({"host": of, "bad": lines_of})
    host = F.xxhash64(F.coalesce(F.col("source"), F.lit("\x00")))
    size = bad.agg(F.sum(F.size(lines_of)).alias("n")).first()["n"] or 0
    if size <= MAX_BROADCAST:
        joined = documents.join(F.broadcast(bad), host == F.col(of), "left")
    else:
        salted = bad.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = documents.join(salted, (host == F.col(of)) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)) == F.col(salt)), "left")

    def strip(lines: Column) -> Column:
        found = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), F.col(lines_of))
        return bind(found, lambda b: F.when(F.size(b) == 0, F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(b, F.xxhash64(x))), "\n")))

    text = F.when(F.col("text").isNull() | F.col(lines_of).isNull(), F.col("text")).otherwise(bind(_lines(F.col("text")), strip))
    return joined.select(*[text.alias(c) if c == "text" else quoted(c) for c in documents.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with boilerplate lines dropped: the text that is left."""
    kept = drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", F.char_length("text").cast("long").alias("n_chars_left"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: docs with boilerplate lines dropped and n_chars counted anew; every row stays."""
    kept = drop_boilerplate(docs)
    return kept.withColumn("n_chars", F.char_length(text_or_empty("text")).cast("long")) if "n_chars" in docs.columns else kept


ORACLE = rf"""
WITH l AS (SELECT row_number() OVER () AS r, * FROM documents),
x AS (SELECT r, coalesce(source, chr(1)) AS host, unnest(range(1, len(regexp_split_to_array(text, '\n')) + 1)) AS k, unnest(regexp_split_to_array(text, '\n')) AS line FROM l WHERE text IS NOT NULL),
p AS (SELECT coalesce(source, chr(1)) AS host, count(*) AS pages FROM l GROUP BY 1),
b AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT r) AS n FROM x WHERE trim(line) <> '' GROUP BY host, line) JOIN p USING (host) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * pages),
t AS (SELECT r, string_agg(line, chr(10) ORDER BY k) AS text FROM x WHERE trim(line) = '' OR NOT EXISTS (SELECT 1 FROM b WHERE b.host = x.host AND b.line = x.line) GROUP BY r)
SELECT doc_id, source, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, CASE WHEN l.text IS NULL THEN NULL ELSE length(coalesce(t.text, '')) END AS n_chars_left FROM l LEFT JOIN t USING (r)"""
