"""Quality rules as a bitmask ledger (DataFrame functions only).

Each rule is evaluated once per document; the ledger keeps the measurements
and one bit per failed rule.  A policy is a versioned set of rules, a verdict
is one bitwise test, and ablations come from counts per distinct bitmask, so
trying another policy never reads a text again.

Defined cases: null text is an empty text (no words, it fails ``few_words``);
repeated rows are documents of their own; an empty table gives an empty
ledger; extra columns are carried only if asked for.  Whole texts are
measured, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import read, register
from .text import SPACES, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Rule name -> failure test over the measurements, null-free; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "capitals": "n_words >= 10 and 100 * n_upper > 50 * n_letters",
    "exclamations": "n_words >= 10 and 100 * n_exclaim > 30 * n_words",
    "word_length": "word_chars > 20 * n_words",
}
BASE = ("few_words", "repeated_windows")
#: Policy version -> rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": BASE + ("symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}
CURRENT = "v2"


def mask(rules) -> int:
    """Bits of the named rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _chars(text: Column, chars: str) -> Column:
    """Occurrences of any of ``chars``, counted in code points."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _window(w: Column, i: Column) -> list[Column]:
    return [F.get(w, i + j) for j in range(WINDOW)]


def measurements(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of ``keep`` plus every measurement, in one pass without a shuffle.

    Repeated windows: hashes first tell the many texts without any repeat;
    only the others sort their windows (as text, so equality is exact) and add
    up the words that flagged windows cover.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_t"))
    df = df.withColumns({"_w": words(F.col("_t")), "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    last = F.size("_w") - WINDOW
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*_window(F.col("_w"), i))))
    df = df.withColumn("_h", hashes)
    texts = F.transform(F.sequence(F.lit(0), last),
                        lambda i: F.struct(F.concat_ws(" ", *_window(F.col("_w"), i)).alias("k"), i.alias("i")))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(texts)))
    same = lambda j, x: F.get(F.col("_s"), j)["k"] == x["k"]
    flagged = F.filter("_s", lambda x, j: F.coalesce(same(j - 1, x), F.lit(False)) | F.coalesce(same(j + 1, x), F.lit(False)))
    df = df.withColumn("_p", F.sort_array(F.transform(flagged, lambda x: x["i"])))
    covered = F.aggregate(
        "_p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"])
    t = F.col("_t")
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        _chars(t, SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        _chars(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _chars(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz").alias("n_letters"),
        _chars(t, "!").alias("n_exclaim"))


def ledger(measured: DataFrame) -> DataFrame:
    """Adds ``fail_bits``: one bit per failed rule, each rule evaluated once.

    The zero that the bits start from is not deterministic to the optimiser,
    so a later filter on the bits stays above them: pushed below, it would
    evaluate the measurements' nested expressions again for every element.
    """
    bits = F.spark_partition_id().cast("long") * 0
    for i, test in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def verdict(policy: str = CURRENT) -> Column:
    """True where no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept without it.

    The ledger is first counted per distinct bitmask (at most 2 ** rules
    rows); everything after that is bitwise work on those counts.
    """
    rules = POLICIES[policy]
    whole = mask(rules)
    counts = (book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits"))
              .agg(F.count(F.lit(1)).alias("n")))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in rules]))
    rows = counts.withColumn("r", each).select("bits", "n", "r.rule", "r.bit")
    n_if = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return rows.groupBy("rule").agg(
        n_if(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        n_if(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        n_if(rest == 0).alias("n_kept_without")).withColumn("policy", F.lit(policy))


_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
k AS (
  SELECT r, i, concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM k) WHERE c > 1),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM f) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_upper,
         CAST(len(regexp_extract_all(t, '[A-Za-z]')) AS BIGINT) AS n_letters,
         CAST(len(regexp_extract_all(t, '!')) AS BIGINT) AS n_exclaim
  FROM w LEFT JOIN c USING (r)),
b AS (
  SELECT *, n_words < 10 AS few, 100 * n_repeat_words > 20 * n_words AS rep, 10 * n_symbols > n_words AS sym,
         100 * n_dup_lines > 50 * n_lines AS dup, n_words >= 10 AND 100 * n_upper > 50 * n_letters AS cap,
         n_words >= 10 AND 100 * n_exclaim > 30 * n_words AS exc, word_chars > 20 * n_words AS lon FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters, n_exclaim,
       CAST(few::INT + 2 * rep::INT + 4 * sym::INT + 8 * dup::INT + 16 * cap::INT + 32 * exc::INT + 64 * lon::INT
            AS BIGINT) AS fail_bits,
       few OR rep AS base_failed, NOT (few OR rep OR sym OR dup OR cap OR exc OR lon) AS kept
FROM b
"""


@register("op3_quality_rules", _SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document with the verdict of the current policy."""
    book = ledger(measurements(read(spark, sf_dir, "documents")))
    return book.withColumns({"base_failed": ~verdict("base"), "kept": verdict(CURRENT)})


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the current policy keeps, columns unchanged."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    book = ledger(measurements(docs.select(row, F.col("text").alias("text")), keep=("_row",)))
    return book.where(verdict(CURRENT)).select("_row.*")
