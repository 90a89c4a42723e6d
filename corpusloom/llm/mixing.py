"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is a number of words. Whole epochs come first: every document once for each
time the source fits into its target. The rest is a weighted sample without replacement: each
document gets the key -ln(u) / weight, and the documents with the smallest keys are taken until
their words reach the rest; the last of them gives its first words only.

A source may hold a third of all rows, so its keys are never sorted in one task. The keys'
expected distribution, known from the counts of weights, maps a key to its place between 0 and
1; places fall into buckets of about equal size; words are summed by bucket, and only the one
bucket per source in which the rest runs out is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import WORD, free_name
from corpusloom.session import materialize

#: Weights of the sources by name, repeating, and the mix's share of all words.
SOURCE_WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
ROWS_PER_BUCKET = 2_000
#: Up to this many sources their few numbers are sent to all tasks, else joined by shuffle.
SMALL = 50_000
#: Marks that prose seldom has; their share lowers a document's quality weight.
JUNK_MARKS = "#$%&*|!"


def text_quality(text: Column) -> Column:
    """A weight from 0.05 to 1: one less three times the share of junk marks."""
    marks = F.length(text) - F.length(F.translate(text, JUNK_MARKS, ""))
    return F.greatest(F.lit(0.05), 1 - 3 * (marks / F.greatest(F.length(text), F.lit(1))))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, docs) to also (target): shares by weight, capped and reshared.

    Resharing what lies above the caps until none is above ends where every source without a
    cap has the same words per weight. Sources come in order of cap per weight, so the capped
    ones are the first: a source is capped if the level that the ones before it leave reaches
    its cap. One row per source, so one task is enough.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(SOURCE_WEIGHTS)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight, cap = F.col("weight"), F.col("cap")
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, SOURCE_WEIGHTS)),
                                           (place + 1).cast("int")).cast("double"))
        .withColumn("cap", (F.col("source_size") * MAX_EPOCHS).cast("double"))
        .withColumn("ratio", cap / weight)
        .withColumn("wanted", F.sum("source_size").over(everything).cast("double") * SHARE)
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
                    / (F.sum(weight).over(everything)
                       - F.coalesce(F.sum(weight).over(before), F.lit(0.0))))
        .withColumn("free", F.min(F.when(F.col("ratio") > F.col("level"), F.struct(
            "place", "level"))).over(everything)["level"]))
    return ranked.select("source", "source_size", "docs", "classes", F.least(
        cap, F.coalesce(F.col("free") * weight, cap)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", quality: Column | None = None,
        seed: str = "", draw: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken.

    ``size`` is the number of words of the whole text, 0 for null. ``taken`` is how many words the
    mix takes, repeats counted: ``size`` for every epoch, and in the sample all, some or no words.
    ``quality`` weighs documents in the sample, by default ``text_quality``; a null or not
    positive weight counts as 1e-6. A null source is one source, the last. Keys depend on ``draw``,
    by default the id, and ``seed``, so reruns agree; rows without an id draw by their number in
    the table. Equal keys, such as those of repeated ids, go by size.
    Columns of other names are not looked at; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    weight = text_quality(text) if quality is None else quality.cast("double")
    drawn = F.col(id_col) if draw is None else draw
    number = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    digest = F.md5(F.concat(F.coalesce(drawn.cast("string"), number), F.lit(seed)))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                    F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                    F.when(weight > 0, weight).otherwise(1e-6).alias("w"), u.alias("u"))
        .select("id", "source", "size", "w", (-F.log("u") / F.col("w")).alias("key")), "mix-rows")

    # Weights of a source by half powers of two: their counts give the keys' distribution.
    half = F.round(F.log2("w") * 2)
    of_class = rows.groupBy("source", half.alias("half")).agg(
        F.count("*").alias("n"), F.avg("w").alias("w"), F.sum("size").alias("size"))
    sizes = of_class.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum("n").alias("docs"),
        F.sort_array(F.collect_list(F.struct("w", "n"))).alias("classes"))
    # Stored once: all that follows sees the same targets.
    targets = materialize(source_targets(sizes), "mix-targets")
    few = targets.count() <= SMALL

    def per_source(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    place = F.aggregate("classes", F.lit(0.0), lambda total, c: total + c["n"] * (
        1 - F.exp(-F.col("key") * c["w"]))) / F.col("docs")
    buckets = F.ceil(F.col("docs") / ROWS_PER_BUCKET)
    same = rows.join(per_source(targets.withColumnRenamed("source", "of")),
                     F.col("source").eqNullSafe(F.col("of")))
    placed = same.withColumn("bucket", F.least(F.floor(place * buckets), buckets - 1)).select(
        "id", "source", "size", "key", "source_size", "target", "bucket")

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, 0)
    edges = (
        placed.groupBy("source", "bucket").agg(
            F.sum("size").alias("words"), F.first("target").alias("target"),
            F.first("source_size").alias("source_size"))
        .withColumn("rest", F.floor("target") - epochs * F.col("source_size"))
        .withColumn("sum", F.sum("words").over(up_to))
        .filter(F.col("sum") > F.col("rest"))
        .groupBy("source").agg(F.min(F.struct(
            "bucket", (F.col("sum") - F.col("words")).alias("before"), "rest")).alias("edge"))
        .select(F.col("source").alias("of"), "edge.*").withColumnRenamed("bucket", "edge"))
    cut = placed.join(per_source(edges), F.col("source").eqNullSafe(F.col("of")), "left").withColumn(
        "epochs", epochs)
    columns = [F.col("id").alias(id_col), "size", "source_size", "target"]
    whole = F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0)
    easy = cut.filter(~F.col("bucket").eqNullSafe(F.col("edge"))).select(
        *columns, (F.col("epochs") * F.col("size") + whole).cast("long").alias("taken"))
    earlier = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(earlier), F.lit(0))
    sampled = F.greatest(F.lit(0), F.least(F.col("size"), left))
    close = cut.filter(F.col("bucket") == F.col("edge")).select(
        *columns, (F.col("epochs") * F.col("size") + sampled).cast("long").alias("taken"))
    return easy.union(close)


def apply_mix(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``docs`` as the mix has them: a row per whole copy, and one of first words where cut.

    The first words stand with one blank between. Rows that repeat an id are all copied alike, and
    so are those without one. Documents without words, or of which nothing is taken,
    are left out. The other columns stay as they are.
    """
    mine, words, size, part = (free_name(docs, x) for x in ("_mix_id", "_mix_taken", "_mix_size", "_mix_part"))
    plan = taken.filter("taken > 0").groupBy(F.col(id_col).alias(mine)).agg(
        F.max("taken").alias(words), F.max("size").alias(size))
    rest = F.col(words) % F.col(size)
    lengths = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), F.floor(F.col(words) / F.col(size)).cast("int")),
        F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    first_words = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)),
                                       F.lit(1), F.col(part).cast("int")), " ")
    return (
        docs.join(plan, F.col(id_col).eqNullSafe(F.col(mine)))
        .withColumn(part, F.explode(lengths))
        .withColumn(text_col, F.when(F.col(part) < 0, F.col(text_col)).otherwise(first_words))
        .select(*[F.col(f"`{c}`") for c in docs.columns]))
