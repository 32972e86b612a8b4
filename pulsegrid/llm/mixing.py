"""Mixing sources to target weights, by distributed prefix sums.

Every document has a size in words.  The total size is shared among the sources by weight; a source's target stops at
``most_epochs`` times its own size, and what that leaves is shared again by weight among the others until no target is
above its stop.  Documents get hash-random keys and are range-sorted by (source, key).  Sums of each range partition
and source, added up over the partitions before it, turn the running sums inside a partition into the prefix sums of
the source.  The mix takes whole epochs of a source as long as its budget holds and then, in key order, documents up to
the exact budget; the document at the cut gives its first words only.

What is kept of a source is its number of whole epochs and its cut key.  Documents are compared with it, so no text is
shuffled and one source with most of the rows is spread over many range partitions.

Cases: a null text has size 0, and a document of size 0 is taken in whole epochs only.  A null source is a source of its
own, after all others.  Texts of any length are counted whole.  Repeated rows (same doc_id, size and source) share one key: if the cut falls among them, each
gives the same number of words, rounded down.  A null doc_id is a key like others.  An empty table gives no rows.
Columns beyond those named are ignored by ``mix_sources`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, cut_lineage

#: Up to so many sources the table of sources is broadcast; beyond, Spark joins it by shuffle and splits hot sources.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> tuple[DataFrame, int]:
    """sizes: source, size, one row per document or part.  Returns (source, source_size, weight, target) and its row count."""
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # The n-th source by code point, null last: rank inside range partitions, plus the counts of the partitions before.
    ranged = by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    counts = sorted((r["pid"], r["count"]) for r in ranged.groupBy("pid").count().collect())  # one row per partition
    starts, n = [], 0
    for pid, count in counts:
        starts.append((pid, n))
        n += count
    first = F.create_map(*(F.lit(x) for pair in starts for x in pair)) if starts else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())) - 1 + first[F.col("pid")]
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), F.pmod(rank, F.lit(len(weights))) + 1)
    table = cut_lineage(ranged.select("source", "source_size", weight.cast("long").alias("weight"), (F.lit(most_epochs) * F.col("source_size")).alias("stop"), F.lit(False).alias("stopped")))
    while True:  # at most as many rounds as there are different stops; each round is two sums
        open_ = ~F.col("stopped")
        s = table.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(F.col("stopped"), F.col("stop")).otherwise(0)).alias("held"),
            F.sum(F.when(open_, F.col("weight")).otherwise(0)).alias("weights"),
        ).first()
        rest, weights_left = (s["all"] or 0) - (s["held"] or 0), s["weights"] or 0
        share = F.lit(rest) * F.col("weight") / F.lit(max(weights_left, 1))
        above = open_ & (share > F.col("stop"))
        if not weights_left or not table.where(above).limit(1).count():
            break
        table = cut_lineage(table.withColumn("stopped", F.col("stopped") | above))
    target = F.when(F.col("stopped"), F.col("stop").cast("double")).otherwise(share)
    return table.select("source", "source_size", "weight", target.cast("double").alias("target")), n


def _joined(docs: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    side = sources.withColumnRenamed("source", "of_source")
    return docs.join(F.broadcast(side) if n <= BROADCAST_SOURCES else side, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")


def source_cuts(sizes: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """sizes: source, key, doc_id, size.  Adds to targets: epochs, and the cut: cut_key, cut_doc, cut_size, cut_words, copies."""
    budget = targets.select(
        "source", "source_size", "weight", "target",
        F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    ).withColumn("left_over", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    budget = cut_lineage(budget)
    # Ranges follow the whole sort key, so a hot source is cut into many; identical rows count as one with copies.
    units = sizes.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("copies"))
    ranged = cut_lineage(units.repartitionByRange("source", "key", "doc_id", "size").withColumn("pid", F.spark_partition_id()))
    words = F.col("size") * F.col("copies")
    before = (
        ranged.groupBy("source", "pid").agg(F.sum(words).alias("part"))
        .withColumn("before", F.sum("part").over(Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col("source").alias("s"), F.col("pid").alias("p"), "part", F.coalesce("before", F.lit(0)).alias("before"))
    )
    # Only the partition in which a source's budget ends has to be summed row by row.
    ends = _joined(before.withColumnRenamed("s", "source"), budget.select("source", "left_over"), n).where("left_over > before AND left_over <= before + part")
    ends = ends.select(F.col("source").alias("s"), F.col("p"), "before", "left_over")
    inside = ranged.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("pid") == F.col("p")))
    run = F.col("before") + F.sum(words).over(Window.partitionBy("source", "pid").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = (
        inside.withColumn("upto", run).where((F.col("upto") >= F.col("left_over")) & (F.col("upto") - words < F.col("left_over")))
        .select(
            "source", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_doc"), F.col("size").alias("cut_size"),
            F.floor((F.col("left_over") - F.col("upto") + words) / F.col("copies")).cast("long").alias("cut_words"),
        )
    )
    cut = cut.withColumnRenamed("source", "cs")
    return budget.join(cut, F.col("source").eqNullSafe(F.col("cs")), "left").drop("cs", "left_over")


def with_sizes(documents: DataFrame, seed: int = 42) -> DataFrame:
    """Adds size (words) and key (hash-random)."""
    return documents.withColumns({
        "size": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"),
        "key": F.xxhash64(F.lit(seed), F.col("doc_id")),
    })


def _plan(sized: DataFrame, weights, most_epochs) -> tuple[DataFrame, int]:
    narrow = cut_lineage(sized.select("source", "key", "doc_id", "size"))
    targets, n = source_targets(narrow, weights, most_epochs)
    return narrow, cut_lineage(source_cuts(narrow, targets, n)), n


def _taken(joined: DataFrame) -> DataFrame:
    """Adds last_words: what is taken beyond whole epochs."""
    doc, cut = F.coalesce("doc_id", F.lit(-(2**63))), F.coalesce("cut_doc", F.lit(-(2**63)))
    this = F.struct(F.col("key").alias("a"), F.col("doc_id").isNotNull().alias("b"), doc.alias("c"), F.col("size").alias("d"))
    that = F.struct(F.col("cut_key").alias("a"), F.col("cut_doc").isNotNull().alias("b"), cut.alias("c"), F.col("cut_size").alias("d"))
    last = F.when(F.col("cut_key").isNull(), 0).when(this < that, F.col("size")).when(this == that, F.col("cut_words")).otherwise(0)
    return joined.withColumn("last_words", last.cast("long"))


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: int = 42) -> DataFrame:
    """documents: doc_id, text, source.  Returns doc_id, size, source_size, target, epochs, last_words, taken, source."""
    narrow, cuts, n = _plan(with_sizes(documents.select("doc_id", "text", "source"), seed), weights, most_epochs)
    return _taken(_joined(narrow, cuts, n)).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("last_words")).cast("long").alias("taken"),
        "epochs", "last_words", "source",
    )


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself, with the columns of documents: a row for each time a document is taken.

    The document at a source's cut gives a row with its first words (white space between them kept).  n_chars, if
    there, is that of the text in the row.
    """
    names = documents.columns
    narrow, cuts, n = _plan(with_sizes(documents.select("doc_id", "text", "source"), seed), weights, most_epochs)
    # The names of the documents' own columns stay inside the struct.
    doc = documents.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"))
    keyed = doc.select("doc", F.col("doc.source").alias("source"), F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), F.xxhash64(F.lit(seed), F.col("doc.doc_id")).alias("key"))
    joined = _joined(keyed, cuts, n)
    place = F.struct(F.col("key").alias("a"), F.col("doc_id").isNotNull().alias("b"), F.coalesce("doc_id", F.lit(-(2**63))).alias("c"))
    cut = F.struct(F.col("cut_key").alias("a"), F.col("cut_doc").isNotNull().alias("b"), F.coalesce("cut_doc", F.lit(-(2**63))).alias("c"))
    at_cut = F.col("cut_key").isNotNull() & (place == cut)
    # Words are counted again only where the cut falls on this doc_id.
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    words = F.when(F.col("cut_key").isNull(), 0).when(place < cut, -1).when(at_cut & (size < F.col("cut_size")), -1).when(at_cut & (size == F.col("cut_size")), F.col("cut_words")).otherwise(0)
    rows = joined.withColumn("words", words).withColumn("full", ((F.col("words") < 0) | (at_cut & (F.col("words") == F.col("cut_size")))) & F.coalesce("text", F.lit("")).rlike(WORD))
    lead = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first_words = F.array_join(F.slice(lead, F.lit(1), F.col("words").cast("int")), "")
    part = F.when((F.col("words") > 0) & ~F.col("full"), F.array(first_words)).otherwise(F.array().cast("array<string>"))
    times = (F.col("epochs") + F.col("full").cast("int")).cast("int")
    taken = rows.select("doc", F.explode(F.concat(F.array_repeat(F.lit(None).cast("string"), times), part)).alias("part"))
    own = lambda c: F.col(f"doc.`{c}`")
    return taken.select(*(
        (F.when(F.col("part").isNull(), own(c)).otherwise(F.col("part")) if c == "text"
         else F.when(F.col("part").isNull(), own(c)).otherwise(F.length("part").cast(documents.schema[c].dataType)) if c == "n_chars" else own(c)).alias(c)
        for c in names
    ))
