"""Removal of lines that many sites share, by the distinct-site spread of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import WORD, hot_join, let, stored, stripped

#: Boilerplate of a young or rare kind stands on few sites.
MIN_SITES = 5
#: Lines of so few words recur by chance, so they must stand on more sites.
SHORT_WORDS = 3
SHORT_SITES = 10
LOG_K = 12
#: Six standard errors of a sketch with 2 ** LOG_K cells; an estimate farther than that from the threshold decides.
MARGIN = 0.1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def clean_lines(docs: DataFrame, min_sites: int = MIN_SITES, short_sites: int = SHORT_SITES, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """Texts without the lines that at least ``min_sites`` sites carry; the document with the least key keeps its copy.

    A line of at most ``SHORT_WORDS`` words goes from ``short_sites`` sites on: what chance brings together is short.

    Adds ``n_lines``, ``n_removed`` and ``emptied`` (all its non-blank lines went).  Lines are compared without white space
    at their ends; blank lines are no lines and stay in place.

    A first aggregation finds the lines with more than one site (least and greatest site hash differ), so only their
    occurrences go on, those of a very frequent line dealt over many tasks.  Their spread is a HyperLogLog sketch per line hash, merged over partial aggregates; lines whose
    estimate lies within ``MARGIN`` of the threshold are counted exactly.  Texts meet their removed positions once.

    Edge cases: null texts stay null and have no lines; a null site is one site; rows with a null key never keep a shared
    line unless no other row has it; rows that repeat a key and text are treated alike; lines of a very long text are
    handled in time in proportion to it; an empty table gives an empty result; other columns pass through, whatever
    their names, except that columns called ``n_lines``, ``n_removed`` or ``emptied`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "emptied")]
    own, ident = F.col(f"row.{text}"), F.col(f"row.{key}")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    text_hash = F.xxhash64(own).alias("text_hash")
    line = rows.select(
        ident.alias("key"), text_hash, F.xxhash64(F.col(f"row.{site}")).alias("site"), F.posexplode(_lines(own)).alias("pos", "line"))
    line = line.withColumn("line", stripped(F.col("line"))).filter("line <> ''").select(
        "key", "text_hash", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        F.when(F.regexp_count("line", F.lit(WORD)) <= SHORT_WORDS, short_sites).otherwise(min_sites).alias("need"))
    shared = line.groupBy("h1", "h2").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.min("key").alias("keeper"), F.max("need").alias("need"), F.count("*").alias("n"))
    shared = stored(shared.filter("lo <> hi").select("h1", "h2", "keeper", "need", "n"), "shared-lines")
    by = ["key", "text_hash", "pos"]
    met = stored(hot_join(line.drop("need"), shared, ["h1", "h2"], by).drop("n"), "line-occurrences")

    spread = stored(
        met.groupBy("h1", "h2", "need").agg(F.hll_sketch_agg("site", LOG_K).alias("sketch"))
        .select("h1", "h2", "need", F.hll_sketch_estimate("sketch").alias("sites")), "line-spread")
    least, most = F.col("need") * (1 - MARGIN), F.col("need") * (1 + MARGIN)
    near = spread.filter(F.col("sites").between(least, most)).select("h1", "h2")
    exact = hot_join(met, near, ["h1", "h2"], by, "left_semi", shared).select("h1", "h2", "need", "site").distinct().groupBy("h1", "h2", "need").agg(
        F.count("*").alias("sites"))
    wide = spread.filter(F.col("sites") > most).unionByName(exact.filter(F.col("sites") >= F.col("need")))

    out = hot_join(met, wide.select("h1", "h2"), ["h1", "h2"], by, "left_semi", shared).filter("NOT (key <=> keeper)")
    out = out.groupBy("key", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    hit = F.expr("key <=> k AND text_hash = h")
    both = rows.select("row", ident.alias("k"), F.xxhash64(own).alias("h")).join(out, hit, "left")

    def rest(parts: Column) -> Column:
        """Lines between removed positions, slice by slice."""
        gone = F.col("gone")
        slices = F.transform(
            F.sequence(F.lit(0), F.size(gone)),
            lambda i: let(F.coalesce(F.get(gone, i - 1) + 1, F.lit(0)), lambda a: F.slice(
                parts, a + 1, F.coalesce(F.get(gone, i), F.size(parts)) - a)))
        return F.array_join(F.flatten(slices), "\n")

    cleaned = F.when(F.col("gone").isNull(), own).otherwise(let(_lines(own), rest))
    n_lines = F.size(F.filter(_lines(own), lambda x: stripped(x) != ""))
    n_removed = F.coalesce(F.size("gone"), F.lit(0))
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(n_removed)
    return both.select("row", cleaned.alias("cleaned"), n_lines.alias("nl"), n_removed.alias("nr")).select(
        *[F.col("cleaned").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names],
        F.col("nl").cast("long").alias("n_lines"), F.col("nr").cast("long").alias("n_removed"),
        ((F.col("nr") > 0) & (F.col("nl") == F.col("nr"))).alias("emptied"))
