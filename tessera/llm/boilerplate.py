"""Lines repeated across one source's documents.

Lines are nodes of a graph for each source, consecutive lines its edges, weighted by the number of distinct
documents. Nodes of high support (at least ``MIN_DOCS`` documents and ``MIN_SHARE`` of the source's) are
boilerplate; edges of high support join them, and the connected components are the boilerplate blocks. All
occurrences of such lines are found and deleted.

Texts are read once into rows of (source, document, line number, digest), which are kept in the shared folder.
Supports are counted on (source, line, document) first, then with map-side combine, and occurrences meet the
repeated lines through a salted join, so that one source or one line holding a third of all rows is spread.

Defined results: documents without a source (null run, unknown run, blank ticker) have no repeated lines and
keep their text; null and empty texts have no lines; repeated rows count once; blank lines are never repeated;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import cut

from .conversations import squeeze

MIN_DOCS = 5
MIN_SHARE = 0.2
SALT = 16


def line_key(line: Column) -> Column:
    """Digest of a line as compared: case, white space and the value of digit runs don't count."""
    return F.unhex(F.md5(_norm(line)))


def _norm(line: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(line), r"(?U)\s+", " "))
    return F.regexp_replace(spaced, r"\p{Nd}+", "0")


def sources(runs: DataFrame) -> DataFrame:
    """``run_id, source``: the ticker of each run that has one."""
    ticker = F.upper(squeeze(F.col("ticker")))
    return runs.filter(F.col("id").isNotNull() & (ticker != "")).groupBy(F.col("id").alias("run_id")).agg(F.min(ticker).alias("source"))


def occurrences(sections: DataFrame, runs: DataFrame) -> DataFrame:
    """``source, section_id, line_no, key`` of every line that isn't blank, written once for the steps that follow."""
    lines = sections.filter(F.col("text").isNotNull()).select("section_id", "run_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    light = lines.filter(~F.col("line").rlike(r"^(?U)\s*$")).select("section_id", "run_id", (F.col("pos") + 1).alias("line_no"), line_key(F.col("line")).alias("key"))
    return cut(light.join(sources(runs), "run_id").select("source", "section_id", "line_no", "key"))


def source_totals(sections: DataFrame, runs: DataFrame) -> DataFrame:
    """``source, total``: the sections of each source, those without lines too."""
    return sections.select("section_id", "run_id").distinct().join(sources(runs), "run_id").groupBy("source").agg(F.count_distinct("section_id").alias("total"))


def repeated_lines(lines: DataFrame, totals: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """The nodes of high support: ``source, key, n_docs``."""
    seen = lines.select("source", "key", "section_id").distinct().groupBy("source", "key").agg(F.count("*").alias("n_docs"))
    return supported(seen, totals, min_docs, min_share).select("source", "key", "n_docs")


def supported(seen: DataFrame, totals: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """Rows whose ``n_docs`` is high for their source."""
    return seen.filter(F.col("n_docs") >= min_docs).join(totals, "source").filter(F.col("n_docs") / F.col("total") >= F.lit(min_share)).drop("total")


def marked(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """The occurrences of the repeated lines; both sides salted against hot lines and sources."""
    salted = nodes.select("source", "key", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    return lines.withColumn("salt", F.pmod(F.xxhash64("section_id"), F.lit(SALT)).cast("int")).join(salted, ["source", "key", "salt"]).drop("salt")


def _graph(sections: DataFrame, runs: DataFrame, min_docs: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    """The occurrences of the nodes (``source, section_id, line_no, key``) and the blocks (``source, key, block, n_docs``).

    A block is named by its least line digest; a node without a kept edge is a block of its own.
    """
    lines = occurrences(sections, runs)
    totals = source_totals(sections, runs)
    nodes = cut(repeated_lines(lines, totals, min_docs, min_share).withColumn("key", F.lower(F.hex("key"))))
    here = cut(marked(lines.withColumn("key", F.lower(F.hex("key"))), nodes).select("source", "section_id", "line_no", "key").distinct())
    after = here.select("source", "section_id", (F.col("line_no") - 1).alias("line_no"), F.col("key").alias("key2"))
    pairs = here.join(after, ["source", "section_id", "line_no"]).filter(F.col("key") != F.col("key2")).select("source", "key", "key2", "section_id").distinct()
    edges = supported(pairs.groupBy("source", "key", "key2").agg(F.count("*").alias("n_docs")), totals, min_docs, min_share)
    name = lambda k: F.concat_ws(" ", "source", k)
    comps = components(edges.select(name("key").alias("a"), name("key2").alias("b")))
    named = nodes.withColumn("node", name("key")).join(comps, "node", "left")
    return here, named.select("source", "key", F.coalesce(F.substring_index("root", " ", -1), F.col("key")).alias("block"), "n_docs")


def found(sections: DataFrame, runs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """Every occurrence of a line of a boilerplate block: ``section_id, line_no``."""
    here, blocks_ = _graph(sections, runs, min_docs, min_share)
    salted = blocks_.select("source", "key", "block", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    met = here.withColumn("salt", F.pmod(F.xxhash64("section_id"), F.lit(SALT)).cast("int")).join(salted, ["source", "key", "salt"])
    return met.select("section_id", "line_no").distinct()


def blocks(sections: DataFrame, runs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """The boilerplate blocks: ``source, block, key, n_docs``.

    An edge is kept if it stands in as many documents, and in as large a share of its source's, as a node needs.
    """
    return _graph(sections, runs, min_docs, min_share)[1].select("source", "block", "key", "n_docs")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` by alternating large and small stars; logarithmic in the length of the longest path.

    Edges never come to the driver: only the number of changed edges does.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = cut(both)
    while True:
        big = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        root = big.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = big.join(root, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small)
        changed = new.exceptAll(now).limit(1).count() + now.exceptAll(new).limit(1).count()
        now = new
        if not changed:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))


def cleaned(sections: DataFrame, runs: DataFrame) -> DataFrame:
    """Each section once, without the lines of boilerplate blocks: ``section_id, text, removed``."""
    gone = found(sections, runs).groupBy("section_id").agg(F.collect_set("line_no").alias("gone"))  # bounded by the lines of one text
    once = sections.groupBy("section_id").agg(F.max("text").alias("text"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i + 1))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return once.join(gone, "section_id", "left").select("section_id", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
