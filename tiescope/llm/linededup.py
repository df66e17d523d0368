"""Cross-site boilerplate lines, by the spread of each line over sites.

HyperLogLog sketches of the sites, one for each line hash, merge by
aggregation. Lines whose estimate is near the threshold get an exact count.
A document that was copied to many sites has nothing but such lines; in a page
they stand beside lines of its own. So the sites are counted twice: over all
texts, which gives the shared lines, and then over the texts at least half of
whose lines are not shared. Lines on enough sites there are boilerplate, and go
from all texts.

All steps are DataFrame expressions. Decisions are joined back by a hash of
the text; whole texts move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiescope.session import stage

#: Sites from which on a line is boilerplate.
SITES = 10
#: Estimates within this share of SITES are counted exactly.
NEAR = 0.25
#: log2 of the sketch's registers: a relative error of about 1.6 percent.
REGISTERS = 12
BLANK = r"^[\x20\x09-\x0D]*$"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _exploded(docs: DataFrame) -> DataFrame:
    """(k1, k2, site, n, line): every different line with a word, with its text's name and number of such lines."""
    own = F.filter(F.array_distinct(_lines(F.col("text"))), lambda x: ~x.rlike(BLANK))
    named = docs.filter("text is not null").select(
        F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("text"), "text").alias("k2"), "site",
        F.transform(own, lambda x: F.xxhash64(x)).alias("lines"))
    return named.select("k1", "k2", "site", F.size("lines").alias("n"), F.explode("lines").alias("line"))


def _spread(lines: DataFrame, sites: int) -> DataFrame:
    """(line, sites): estimated sites of the lines that may be on ``sites`` of them."""
    sketch = F.hll_sketch_agg("site", F.lit(REGISTERS))
    return (lines.groupBy("line").agg(F.hll_sketch_estimate(sketch).alias("sites"))
            .filter(F.col("sites") >= sites * (1 - NEAR)))


def _on_enough(spread: DataFrame, seen: DataFrame, sites: int) -> DataFrame:
    """(line): those on ``sites`` sites; estimates near the threshold are counted exactly in ``seen`` (line, site)."""
    clear = F.col("sites") >= sites * (1 + NEAR)
    near = (seen.join(spread.filter(~clear).select("line"), "line").select("line", "site").distinct()
            .groupBy("line").count().filter(F.col("count") >= sites))
    return near.select("line").unionByName(spread.filter(clear).select("line"))


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(line): hashes of the boilerplate lines of ``docs`` (text, site; a null site is a site)."""
    lines = _exploded(docs.withColumn("site", F.coalesce("site", F.lit(""))))
    spread = stage(_spread(lines, sites), "line-spread")
    # of the lines that may be on enough sites, every (text, site, line) once
    seen = stage(lines.join(spread.select("line"), "line").distinct(), "line-texts")
    shared = stage(_on_enough(spread, seen, sites), "line-shared")
    here = seen.join(shared, "line")
    texts = (here.select("k1", "k2", "n", "line").distinct().groupBy("k1", "k2").agg(
        F.count("*").alias("shared"), F.first("n").alias("n")).filter(2 * F.col("shared") <= F.col("n")))
    own = stage(here.join(texts.select("k1", "k2"), ["k1", "k2"]).select("line", "site").distinct(), "line-own")
    return _on_enough(_spread(own, sites), own, sites)


def clean(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES) -> DataFrame:
    """``docs`` without its boilerplate lines, and ``n_removed``, the number of lines taken out.

    The remaining lines keep their order and are joined by line ends. Lines of
    blanks are never boilerplate. A null text stays null, an empty one empty,
    both with 0 removed; a null site is a site of its own. Repeated rows are
    cleaned alike; other columns stay, but for one named ``n_removed``, which
    is replaced. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c != "n_removed"]
    # the caller's columns stay apart from the own ones
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), F.col(f"`{text}`").alias("_text"))
    source = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{site}`").alias("site"))
    gone = stage(boilerplate(source, sites), "line-boilerplate")
    removed = (_exploded(source).select("k1", "k2", "line").join(gone, "line")
               .groupBy("k1", "k2").agg(F.collect_set("line").alias("_gone")))  # lines of one text
    left = F.filter(_lines(F.col("_text")), lambda x: ~F.array_contains("_gone", F.xxhash64(x)))
    joined = whole.join(removed, (F.xxhash64("_text") == F.col("k1"))
                        & (F.xxhash64(F.lit("text"), F.col("_text")) == F.col("k2")), "left")
    some = F.col("_gone").isNotNull()
    counted = joined.withColumn("_kept", F.when(some, left)).withColumn(
        "_n", F.when(some, F.size(_lines(F.col("_text"))) - F.size("_kept")).otherwise(0).cast("bigint"))
    cleaned = F.when(some, F.array_join("_kept", "\n")).otherwise(F.col("_text"))
    return counted.select(*[(cleaned if c == text else F.col("_doc").getField(c)).alias(c) for c in kept],
                          F.col("_n").alias("n_removed"))


#: The same for DuckDB; {docs} is a relation with doc_id, text, source.
SQL = r"""
WITH numbered AS (SELECT *, row_number() OVER () AS _row FROM {docs}),
texts AS (SELECT text, min(_row) AS t FROM numbered WHERE text IS NOT NULL GROUP BY text),
lines AS (SELECT DISTINCT t, line FROM (SELECT t, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*')),
placed AS (SELECT DISTINCT t, coalesce(n.source, '') AS site FROM texts JOIN numbered n ON n.text = texts.text),
shared AS (SELECT line FROM lines JOIN placed USING (t) GROUP BY line HAVING count(DISTINCT site) >= {sites}),
own AS (SELECT t FROM lines LEFT JOIN shared ON shared.line = lines.line GROUP BY t
  HAVING 2 * count(shared.line) <= count(*)),
gone AS (SELECT lines.line FROM lines JOIN shared ON shared.line = lines.line JOIN own USING (t) JOIN placed USING (t)
  GROUP BY lines.line HAVING count(DISTINCT site) >= {sites})
SELECT doc_id, CASE WHEN n.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(n_removed, 0) AS n_removed
FROM numbered n LEFT JOIN (
  SELECT _row, string_agg(p.line, chr(10) ORDER BY i) FILTER (WHERE gone.line IS NULL) AS text, count(gone.line) AS n_removed
  FROM (SELECT _row, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) AS i FROM numbered) p
  LEFT JOIN gone ON gone.line = p.line GROUP BY _row) k USING (_row)
"""
