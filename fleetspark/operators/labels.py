"""Label-set matching.

Both matches are containment tests between a job's labels and the size
classes.  Jobs are reduced to their distinct label sets.  The contained side
is filed under its rarest label alone, rarity counted on the containing side,
so that labels which everything shares (every runner is self-hosted) bring no
pairs together; the pairs that meet there are verified with ``array_except``,
and the answer goes back to the jobs by an equi-join on the set.  Nothing is
collected, and neither side needs to be small.  A stream, which cannot wait for all label sets, takes the classes'
label sets as an explicit list instead (:func:`label_sets`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_set(c: Column) -> Column:
    """Normalised set key: distinct, sorted labels."""
    return F.array_sort(F.array_distinct(c))


def clean_labels(c: Column) -> Column:
    """Labels that are non-empty strings (webhook payloads can carry junk)."""
    return F.filter(c, lambda x: x.isNotNull() & (x != ""))


def subset_of(small: Column, big: Column) -> Column:
    """Every element of ``small`` occurs in ``big``."""
    return F.size(F.array_except(small, big)) == 0


def required_labels_filter(jobs: DataFrame, required: list[str], labels_col: str = "labels") -> DataFrame:
    """Jobs whose labels include every required label."""
    if not required:
        return jobs
    req = F.array(*[F.lit(x) for x in required])
    return jobs.filter(subset_of(req, F.col(labels_col)))


def rarest_label(parts: DataFrame, containing: DataFrame) -> DataFrame:
    """``part, label``: the label of each set ``part`` that the fewest sets of ``containing`` have.

    Both frames hold one array column of distinct labels, ``part`` and
    ``whole``.  A part with a label that no containing set has is left out:
    nothing can contain it.  Ties go to the first label by code point.
    """
    n = containing.select(F.explode("whole").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    found = parts.select("part", F.explode("part").alias("label")).join(n, "label").groupBy("part").agg(
        F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "label")).alias("least"))
    return found.where(F.col("known") == F.size("part")).select("part", F.col("least.label").alias("label"))


def contained_pairs(parts: DataFrame, containing: DataFrame) -> DataFrame:
    """All ``part, whole`` (and further columns of ``containing``) where ``whole`` has every label of ``part``.

    A part meets only the sets that have its rarest label.
    """
    filed = rarest_label(parts, containing.select("whole").distinct())
    offered = containing.withColumn("label", F.explode("whole"))
    return filed.join(offered, "label").where(subset_of(F.col("part"), F.col("whole"))).drop("label")


def match_class(jobs: DataFrame, classes: DataFrame, labels_col: str = "labels",
                required: list[str] | None = None, out_col: str = "size_class") -> DataFrame:
    """The smallest class whose labels contain all of the job's labels.

    ``classes`` has (name, labels array, class_pos).  Fewest labels wins
    (duplicates counted, as list length), ties go to the earlier class.
    Jobs with null or empty labels, or missing a required label, get null.
    """
    job = label_set(F.col(labels_col))
    ok = F.coalesce(F.size(job) > 0, F.lit(False))
    if required:
        ok = ok & subset_of(F.array(*[F.lit(x) for x in required]), F.col(labels_col))
    keyed = jobs.withColumn("_set", F.when(ok, job))
    sets = keyed.select(F.col("_set").alias("part")).where("part is not null").distinct()
    offered = classes.select(F.array_distinct("labels").alias("whole"),
                             F.struct(F.size("labels").alias("n"), "class_pos", "name").alias("_class"))
    best = contained_pairs(sets, offered).groupBy("part").agg(F.min("_class").alias("_best"))
    return (keyed.join(best, F.col("_set") == F.col("part"), "left")
            .select(*[keyed[c] for c in jobs.columns], F.col("_best.name").alias(out_col)))


def webhook_labels_match(df: DataFrame, classes: DataFrame, labels_col: str = "labels",
                         out_col: str = "labels_match") -> DataFrame:
    """True when some class's labels are all among the job's labels.

    The opposite direction from J1.  Null, empty, and non-string labels are
    ignored; a job with no usable label never matches; a class without
    labels matches any other job.
    """
    cleaned = label_set(clean_labels(F.col(labels_col)))
    keyed = df.withColumn("_set", F.when(F.size(cleaned) > 0, cleaned))
    sets = keyed.select(F.col("_set").alias("whole")).where("whole is not null").distinct()
    listed = classes.select(label_set(F.coalesce("labels", F.array().cast("array<string>"))).alias("part")).distinct()
    met = (contained_pairs(listed.where(F.size("part") > 0), sets).select(F.col("whole").alias("_whole")).distinct()
           .withColumn("_hit", F.lit(True)))
    bare = listed.agg(F.coalesce(F.max(F.size("part") == 0), F.lit(False)).alias("_bare"))
    hit = F.coalesce(F.col("_hit") | F.col("_bare"), F.col("_bare")) & F.col("_set").isNotNull()
    return (keyed.join(met, F.col("_set") == F.col("_whole"), "left").crossJoin(bare)
            .select(*[keyed[c] for c in df.columns], hit.alias(out_col)))


def label_sets(sets: list[list[str]]) -> Column:
    """An explicit list of label sets as a literal, for matching on a stream."""
    return F.array(*[F.array(*[F.lit(x) for x in s]).cast("array<string>") for s in sets])


def covers_some_class(labels: Column, label_sets: Column) -> Column:
    """J2 as an expression: some class's labels are all among ``labels``
    (already cleaned of null/empty); an empty or null list never matches."""
    return F.coalesce((F.size(labels) > 0)
                      & F.exists(label_sets, lambda cls: F.size(F.array_except(cls, labels)) == 0), F.lit(False))
