"""Mixing sources to target weights by Pareto order sampling.

Sources share the words of the corpus by weight, none above ``most`` times its own
words.  Within a source a document's expected copies are proportional to its measure,
8 + the binary digits of its words (longer texts are taken somewhat more often), at most
``most``, at the level that gives the source's target in expected words.  Their whole
part is taken for certain; the fraction is the document's inclusion probability p.

The sample is a prefix of the Pareto order: documents by their random odds over their inclusion odds,
u/(1-u) : p/(1-p), which gives inclusion probabilities close to p.  Its size is fixed in words: documents are
taken until the source's words are reached, and the document on the boundary
gives its leading words.  The random number is a hash of seed and document, so
reruns agree.

The order is never built for a whole source: two levels of 4096 rank classes are
counted (with map-side sums), and only the class on the boundary is sorted, with equal rows as
one; they are numbered within the input's partitions, so that one row repeated many times isn't one task.  The level is found on
one row for each source and measure.  The table of targets has one row a source and is planned in one task.

Null texts have no words and are taken 0 words; a null source is the last one; rows of
equal id are ranked by their hash and size, equal rows in any order; an empty
table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.quality import words_of
from tilewright.llm.storage import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
CLASSES = 4096
SEED = "mix-1"


def uniform(seed: str, *columns: Column) -> Column:
    """A number in (0, 1) from the MD5 of the seed and the columns."""
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target for a table with one row a source.

    Level filling: with the sources in order of most * size / weight, the ones that
    reach their limit are a prefix, and the others share what is left by weight.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy("limit_ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    t = t.withColumn("limit_ratio", F.col("limit") / F.col("weight"))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("share", share)
    level = F.max(F.when(F.col("limit_ratio") >= F.col("share"), F.col("share"))).over(every)
    t = t.withColumn("level", level)
    target = F.when(F.col("level").isNull() | (F.col("limit_ratio") < F.col("level")), F.col("limit")).otherwise(F.col("weight") * F.col("level"))
    return t.select("source", "source_size", target.cast("double").alias("target"))


def measure(size: Column) -> Column:
    """What a document's expected copies are proportional to."""
    return F.lit(8) + F.length(F.bin(size))


def expected_copies(base: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """source, m, copies, p, words (of the source's sample), source_size, target: one row for each
    source and measure.

    With the measures of a source in falling order, those that reach ``most`` copies are a prefix; the
    first prefix whose level leaves the next measure below ``most`` is the solution.
    """
    classes = base.groupBy("source", measure(F.col("size")).alias("m")).agg(F.sum("size").alias("w"))
    c = classes.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = Window.partitionBy("source").orderBy(F.col("m").desc())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy("source")
    c = c.withColumn("capped", F.coalesce(F.sum("w").over(before), F.lit(0))).withColumn("open", F.sum(F.col("m") * F.col("w")).over(rest))
    c = c.withColumn("try", F.when(F.col("open") > 0, (F.col("target") - F.lit(float(most)) * F.col("capped")) / F.col("open")))
    # The largest measure at which the level holds.
    fits = F.when(F.col("try") * F.col("m") <= float(most), F.struct(F.col("m").alias("m"), F.col("try").alias("level")))
    c = c.withColumn("level", F.max(fits).over(every)["level"])
    expected = F.least(F.coalesce(F.col("level") * F.col("m"), F.lit(float(most))), F.lit(float(most)))
    c = c.withColumn("expected", expected).withColumn("copies", F.floor(F.col("expected") + 1e-9))
    p = F.col("expected") - F.col("copies")
    c = c.withColumn("p", F.when(p > 1e-9, p).otherwise(F.lit(0.0)))
    words = F.floor(F.col("target") + 0.5) - F.sum(F.col("copies") * F.col("w")).over(every)
    return c.withColumn("words", F.greatest(F.lit(0), words)).select("source", "m", "copies", "p", "words", "source_size", "target")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: row (its other columns), text, doc_id, size,
    source_size, target, copies, p, taken (words the mix takes)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    base = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    base = base.withColumn("size", F.size(words_of(F.col("text"))).cast("long"))
    return _take(base, weights, most, seed)


def taken_words(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: the mix without its texts."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"))
    return _take(materialize(base, "sizes"), weights, most, seed).drop("source", "p")


def _take(base: DataFrame, weights, most: float, seed: str) -> DataFrame:
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialize(targets(sizes, weights, most), "targets")
    n_sources = plan.count()
    # At most 64 measures a source; beyond that bound Spark's shuffled join.
    small = n_sources <= 20_000
    side = materialize(expected_copies(base, plan, most), "copies").withColumnRenamed("source", "s").withColumnRenamed("m", "sm")
    side = F.broadcast(side) if small else side
    rows = base.join(side, F.col("source").eqNullSafe(F.col("s")) & (measure(F.col("size")) == F.col("sm"))).drop("s", "sm")
    u = uniform(seed, F.col("doc_id"))
    rows = rows.withColumn("odds", (u / (1 - u)) / (F.greatest(F.col("p"), F.lit(1e-12)) / (1 - F.least(F.col("p"), F.lit(1 - 1e-12)))))
    rows = rows.withColumn("open", (F.col("size") > 0) & (F.col("words") > 0) & (F.col("p") > 0))
    # Rank classes of equal width in a rising function of the odds, at two levels.
    place = F.least(F.floor(F.col("odds") / (1 + F.col("odds")) * (CLASSES * CLASSES)), F.lit(CLASSES * CLASSES - 1)).cast("long")
    rows = rows.withColumn("fine", place).withColumn("coarse", (F.col("fine") / CLASSES).cast("long"))
    slim = rows.where("open").select("source", "size", "words", "coarse", "fine")

    def boundary(classes: DataFrame, by: str, start: Column) -> DataFrame:
        """The class of each source in which its words are reached."""
        w = Window.partitionBy("source").orderBy(by)
        c = classes.withColumn("upto", start + F.sum("sum").over(w))
        c = c.withColumn("prior", F.col("upto") - F.col("sum"))
        return c.where("prior < words and upto >= words").select(F.col("source").alias("s"), F.col(by).alias(f"at_{by}"), F.col("prior").alias(f"before_{by}"))

    coarse = materialize(boundary(slim.groupBy("source", "coarse", "words").agg(F.sum("size").alias("sum")), "coarse", F.lit(0)), "coarse")
    within = slim.join(F.broadcast(coarse) if small else coarse, F.col("source").eqNullSafe(F.col("s")) & (F.col("coarse") == F.col("at_coarse"))).drop("s")
    fine = materialize(boundary(within.groupBy("source", "fine", "words", "before_coarse").agg(F.sum("size").alias("sum")), "fine", F.col("before_coarse")), "fine")
    rows = rows.join(F.broadcast(fine) if small else fine, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # A source whose sample is all that is open has no boundary.
    part = F.when(F.col("open") & (F.col("at_fine").isNull() | (F.col("fine") < F.col("at_fine"))), F.col("size")).otherwise(F.lit(0))
    on_edge = F.coalesce(F.col("open") & (F.col("fine") == F.col("at_fine")), F.lit(False))
    keep = [c for c in ("row", "text") if c in base.columns]
    rest = rows.where(~on_edge).withColumn("part", part)
    out = rest.unionByName(_on_boundary(rows.where(on_edge)), allowMissingColumns=True)
    taken = (F.col("copies") * F.col("size") + F.col("part")).cast("long")
    return out.select(*keep, "doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), "p", taken.alias("taken"))


def _on_boundary(edge: DataFrame) -> DataFrame:
    """``part`` (words of the sample) of the rows of the boundary classes: about one row in 16 million of a source."""
    edge = materialize(edge.withColumn("lane", F.spark_partition_id()), "edge")
    same = ["source", "odds", "doc_id", "size"]
    groups = edge.groupBy(*same, "words", "before_fine").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    prior = F.col("before_fine") + F.sum(F.col("size") * F.col("n")).over(order) - F.col("size") * F.col("n")
    groups = groups.select(*[F.col(c).alias(f"g_{c}") for c in same], prior.alias("prior"))
    lanes = edge.groupBy(*same, "lane").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(*same).orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lanes = lanes.select(*[F.col(c).alias(f"l_{c}") for c in (*same, "lane")], earlier.alias("earlier"))
    on = lambda p, names: F.expr(" AND ".join(f"{c} <=> {p}_{c}" for c in names))
    rows = edge.join(groups, on("g", same)).join(lanes, on("l", [*same, "lane"]))
    number = F.row_number().over(Window.partitionBy(*same, "lane").orderBy("lane")) - 1
    rows = rows.withColumn("number", number)
    before = F.col("prior") + (F.col("earlier") + F.col("number")) * F.col("size")
    return rows.withColumn("part", F.least("size", F.greatest(F.lit(0), F.col("words") - before))).select(*edge.columns, "part")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each copy taken, the last
    one cut to its leading words where the sample ends within it."""
    mixed = mix_sources(docs, id_col, source_col, text_col, weights, most, seed)
    whole = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    rest = F.col("taken") - whole * F.col("size")
    cut = F.concat_ws(" ", F.slice(words_of(F.col("text")), F.lit(1), F.greatest(rest, F.lit(1)).cast("int")))
    texts = F.concat(F.array_repeat(F.col("text"), whole), F.when(rest > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    return mixed.select("row", F.explode(texts).alias("text")).select(*[F.col("text").alias(text_col) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
