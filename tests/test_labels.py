"""Containment by the rarest label against set operations, and the pairs that meet on the way."""

import random

from pyspark.sql import functions as F

from fleetspark.operators import labels as lb

SHARED = ["self-hosted", "provider"]


def _classes(rng, n):
    """All share two labels; each has a size label of its own and some of a small set."""
    return [(f"c{i}", SHARED + [f"size-{i}"] + rng.sample(["gpu", "arm", "big", "eu"], rng.randint(0, 3)), i) for i in range(n)]


def _jobs(rng, n, classes):
    out = []
    for i in range(n):
        name, labels, _ = rng.choice(classes)
        own = rng.sample(labels, rng.randint(1, len(labels)))
        if rng.random() < 0.7:
            own = list({*own, f"size-{name[1:]}"})
        if rng.random() < 0.1:
            own.append("unheard-of")
        out.append((i, SHARED + own + own[:1]))
    return out + [(-1, None), (-2, []), (-3, SHARED), (-4, ["gpu"]), (-5, ["", None, "gpu", *SHARED])]


def test_both_directions_against_sets(spark):
    rng = random.Random(6)
    classes = _classes(rng, 40) + [("dup", SHARED + ["gpu", "gpu"], 40)]
    jobs = _jobs(rng, 600, classes)
    c = spark.createDataFrame(classes, "name string, labels array<string>, class_pos int")
    j = spark.createDataFrame(jobs, "job_id long, labels array<string>")
    got = {r.job_id: r.size_class for r in lb.match_class(j, c).collect()}
    back = {r.job_id: r.labels_match for r in lb.webhook_labels_match(j, c).collect()}
    for job_id, labels in jobs:
        fits = [(len(own), pos, name) for name, own, pos in classes if labels and set(labels) <= set(own)]
        assert got[job_id] == (min(fits)[2] if fits else None), labels
        assert back[job_id] == any(set(own) <= {x for x in labels or [] if x} for _, own, _ in classes)


def test_shared_labels_bring_nothing_together(spark):
    """10,000 label sets and 1,000 classes that all share two labels: few pairs meet."""
    rng = random.Random(7)
    classes = _classes(rng, 1000)
    sets = [(SHARED + [f"size-{rng.randrange(1000)}", f"job-{i}" if i % 2 else "eu"],) for i in range(10_000)]
    c = spark.createDataFrame(classes, "name string, labels array<string>, class_pos int")
    wholes = c.select(F.array_distinct("labels").alias("whole"), "name")
    parts = spark.createDataFrame(sets, "part array<string>").select(lb.label_set(F.col("part")).alias("part")).distinct()
    filed = lb.rarest_label(parts, wholes.select("whole")).cache()
    assert filed.where(F.col("label").isin(*SHARED)).count() == 0
    met = filed.join(wholes.withColumn("label", F.explode("whole")), "label").count()
    assert met <= filed.count() <= 10_000
    fits = {name: set(labels) for name, labels, _ in classes}
    expected = sum(set(s) <= fits[f"c{s[2][5:]}"] for s in {tuple(sorted(x)): x for (x,) in sets}.values())
    assert lb.contained_pairs(parts, wholes).count() == expected > 0
