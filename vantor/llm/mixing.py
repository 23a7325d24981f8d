"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantor.llm.common import WORD, cut

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: A schedule has about so many slots at most, whatever the size of the input: a block has the words that this leaves it.
SLOTS = 1 << 17
#: A source whose target has fewer blocks than this gives that target to the word, its last block being cut.
FEW_BLOCKS = 1 << 10
#: A source's shuffled order is laid out in parts by so many hexadecimal digits, 4,096, so that no task holds a whole source.
PARTS_DIGITS = 3
GOLDEN = 0.6180339887498949
#: Ranges of the unit interval by which slots find their source.
CELLS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column, text: Column) -> Column:
    """What orders a source; it holds the text's hash, so that rows without an id or with one id are spread."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


class Mix:
    """The parts of a mix; each is a DataFrame, all follow from one aggregate of the sizes by source and part."""

    def __init__(self, docs: DataFrame) -> None:
        self.sized = docs.withColumns({"__size": n_words(F.col("text")), "__key": _key(F.col("doc_id"), F.col("text"))})
        self.sized = self.sized.withColumn("__part", F.conv(F.substring("__key", 1, PARTS_DIGITS), 16, 10).cast("int"))
        self.parts = cut(self.sized.groupBy(F.col("source").alias("__source"), "__part").agg(F.sum("__size").alias("__words")))
        self.sources, self.block = self._targets()
        self.slots = self._slots()
        self.limits = self._limits()

    def _targets(self) -> tuple[DataFrame, int]:
        """(__s, __source, __source_size, __target): a row for each source.

        A source's target is weight times a level, or its cap where that is less. Sorted by cap over weight, the
        level is the first at which the sources from there on, unfilled, share what the filled ones leave.
        """
        by_name = Window.orderBy(F.col("__source").asc_nulls_last())
        weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("__s") % len(WEIGHTS) + 1).cast("int"))
        s = self.parts.groupBy("__source").agg(F.sum("__words").alias("__source_size"))
        s = s.withColumn("__s", F.row_number().over(by_name) - 1).withColumn("__w", weight)
        s = s.withColumn("__cap", F.col("__source_size") * MAX_EPOCHS)
        by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), "__s")
        before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
        everything = Window.partitionBy()
        left = F.sum("__source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0))
        s = s.withColumns({"__level": left / F.sum("__w").over(after), "__nth": F.row_number().over(by_ratio)})
        s = s.withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__cap") / F.col("__w"), F.struct("__nth", "__level"))).over(everything)["__level"])
        s = s.withColumn("__target", F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__level") * F.col("__w"), F.lit(0.0))))
        s = cut(s.select("__s", "__source", "__source_size", "__target"))
        total = s.agg(F.sum("__source_size")).first()[0] or 0
        return s, max(1, total // SLOTS)

    def _slots(self) -> DataFrame:
        """(slot, __s, __block): which block of which source stands at each place of the mix.

        The i-th point of the golden-ratio sequence picks the source in whose share of the cumulative targets it
        falls; the points that fall to a source take its blocks in turn. A source of few blocks loses what points it has
        beyond its target, and what it lacks is spread evenly over the mix (beside the block that stands there).
        """
        order = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, 0)
        shares = self.sources.withColumn("__high", F.sum("__target").over(order) / F.sum("__target").over(Window.partitionBy()))
        shares = shares.withColumn("__low", F.coalesce(F.lag("__high").over(Window.orderBy("__s")), F.lit(0.0))).where("__target > 0")
        cells = F.sequence(F.floor(F.col("__low") * CELLS), F.least(F.floor(F.col("__high") * CELLS), F.lit(CELLS)))
        shares = shares.select("__s", "__low", "__high", F.explode(cells).alias("__cell"))
        total = self.sources.agg(F.sum("__source_size")).first()[0] or 0
        n = -(-total // self.block)
        point = (F.col("id") + 0.5) * GOLDEN
        points = self.sources.sparkSession.range(n).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("__u"))
        points = points.withColumn("__cell", F.floor(F.col("__u") * CELLS))
        inside = (F.col("__u") >= F.col("__low")) & (F.col("__u") < F.col("__high"))
        taken = points.join(shares, "__cell").where(inside)
        rank = F.row_number().over(Window.partitionBy("__s").orderBy("slot")) - 1
        taken = cut(taken.select("slot", "__s", rank.cast("long").alias("__block")))
        few = self.sources.where(self._few()).select("__s", F.ceil(F.round("__target") / self.block).cast("long").alias("__need"))
        kept = taken.join(few, "__s", "left").where("__need IS NULL OR __block < __need").select("slot", "__s", "__block")
        lacking = few.join(taken.groupBy("__s").agg(F.count("*").alias("__have")), "__s", "left").withColumn("__have", F.coalesce("__have", F.lit(0).cast("long")))
        lacking = lacking.where("__have < __need").withColumn("__block", F.explode(F.sequence("__have", F.col("__need") - 1)))
        slot = F.floor((F.col("__block") + 0.5) * n / F.col("__need")).cast("long")
        return cut(kept.unionByName(lacking.select(slot.alias("slot"), "__s", "__block")))

    def _few(self) -> Column:
        return F.col("__target") < FEW_BLOCKS * self.block

    def _limits(self) -> DataFrame:
        """(__source, __part, __s, __source_size, __target, __offset, __limit): the words each source gives, and where parts begin."""
        given = self.slots.groupBy("__s").agg((F.count("*") * self.block).alias("__given"))
        given_words = F.when(self._few(), F.round("__target").cast("long")).otherwise(F.coalesce("__given", F.lit(0)))
        limit = F.least(given_words, F.col("__source_size") * MAX_EPOCHS)
        sources = self.sources.join(given, "__s", "left").withColumn("__limit", limit).drop("__given")
        order = Window.partitionBy("__s").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        named = sources.withColumnRenamed("__source", "__name")
        parts = self.parts.join(named, F.col("__source").eqNullSafe(F.col("__name"))).drop("__name")
        return cut(parts.withColumn("__offset", F.coalesce(F.sum("__words").over(order), F.lit(0))).drop("__words"))

    def placed(self) -> DataFrame:
        """Each row of docs with __size, its source's numbers, and __at, where it begins in its source's shuffled words."""
        limits = self.limits.withColumnRenamed("__source", "__name").withColumnRenamed("__part", "__nth")
        rows = self.sized.join(limits, F.col("source").eqNullSafe(F.col("__name")) & (F.col("__part") == F.col("__nth"))).drop("__name", "__nth")
        order = Window.partitionBy("__s", "__part").orderBy("__key", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("__at", F.col("__offset") + F.coalesce(F.sum("__size").over(order), F.lit(0)))

    def copies(self, placed: DataFrame) -> DataFrame:
        """placed, a row for each copy whose first word the mix takes; __epoch counts them."""
        n = F.ceil((F.col("__limit") - F.col("__at")) / F.col("__source_size"))
        n = F.when((F.col("__size") > 0) & (F.col("__limit") > F.col("__at")), n).otherwise(0)
        return placed.withColumn("__epoch", F.explode(F.slice(F.array(*map(F.lit, range(MAX_EPOCHS))), 1, n.cast("int"))))

    def pieces(self, placed: DataFrame) -> DataFrame:
        """The mix itself: (slot, __s, __at, doc_id, source, epoch, first_word, n_words), to be read in order of slot, __at, epoch."""
        start = F.col("__at") + F.col("__epoch") * F.col("__source_size")
        end = F.least(start + F.col("__size"), F.col("__limit"))
        narrow = self.copies(placed.select("doc_id", "source", "__s", "__at", "__size", "__limit", "__source_size"))
        narrow = narrow.withColumn("__start", start).withColumn("__end", end)
        block = F.explode(F.sequence(F.floor(F.col("__start") / self.block), F.floor((F.col("__end") - 1) / self.block)))
        narrow = narrow.withColumn("__block", block).join(self.slots, ["__s", "__block"])
        first = F.greatest(F.col("__start"), F.col("__block") * self.block)
        last = F.least(F.col("__end"), (F.col("__block") + 1) * self.block)
        return narrow.select("slot", "__s", "__at", "doc_id", "source", F.col("__epoch").alias("epoch"), (first - F.col("__start")).alias("first_word"), (last - first).alias("n_words"))


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): for each row of docs the words of it that the mix takes, repeats counted.

    docs needs doc_id, source, text; other columns are ignored. Null and empty texts have no words and are never
    taken; a null source is one more source, last in order; rows that repeat an id are placed one after the other; an
    empty table gives an empty one. The order within a source depends on doc_id and text alone, so that reruns agree.
    """
    mix = Mix(docs.select("doc_id", "source", "text"))
    placed = mix.placed()
    taken = mix.pieces(placed).groupBy("__s", "__at").agg(F.sum("n_words").alias("__taken"))
    taken = taken.withColumnsRenamed({"__s": "__ts", "__at": "__tat"})
    same = (F.col("__s") == F.col("__ts")) & (F.col("__at") == F.col("__tat")) & (F.col("__size") > 0)
    out = placed.select("doc_id", "__s", "__at", "__size", "__source_size", "__target").join(taken, same, "left")
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.coalesce("__taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix begins it, with the columns of docs; a text is never cut.

    The last copy of a source may go beyond its target by less than its own size. Rows without words are not taken.
    """
    mix = Mix(docs)
    return mix.copies(mix.placed()).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS s FROM s0),
s2 AS (SELECT *, CASE s % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ())
         - coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS lv FROM s2),
s4 AS (SELECT *, (SELECT lv FROM s3 AS x WHERE lv <= cap / w ORDER BY cap / w, s LIMIT 1) AS level FROM s3),
s5 AS (SELECT s, source, source_size, least(cap::DOUBLE, coalesce(level * w, 0)) AS target FROM s4),
b AS (SELECT greatest(1, sum(source_size)::BIGINT // {SLOTS}) AS block, sum(source_size)::BIGINT AS total FROM s5),
s6 AS (SELECT *, sum(target) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS high FROM s5),
s7 AS (SELECT *, coalesce(lag(high) OVER (ORDER BY s), 0) AS low FROM s6),
p AS (SELECT i, (i + 0.5::DOUBLE) * {GOLDEN}::DOUBLE - floor((i + 0.5::DOUBLE) * {GOLDEN}::DOUBLE) AS u
      FROM (SELECT unnest(range(0, (total + block - 1) // block)) AS i FROM b)),
g AS (SELECT s, count(*) AS n FROM p JOIN s7 ON u >= low AND u < high AND target > 0 GROUP BY s),
l AS (SELECT s7.s, s7.source, source_size, target,
             least(CASE WHEN target < {FEW_BLOCKS} * block THEN round(target) ELSE coalesce(n, 0) * block END, 3 * source_size)::BIGINT AS lim
      FROM s7 LEFT JOIN g USING (s), b),
a AS (SELECT d.doc_id, d.size, l.*, coalesce(sum(d.size) OVER (PARTITION BY l.s ORDER BY k, d.doc_id, d.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, size, source_size, target,
       (least(size, greatest(0, lim - pos)) + least(size, greatest(0, lim - pos - source_size))
        + least(size, greatest(0, lim - pos - 2 * source_size)))::BIGINT AS taken FROM a
"""
