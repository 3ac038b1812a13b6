"""How five document filters interact: what each removes in any order of all five, and what it alone would find.

A: under 200 words. B: 100 x distinct words < 50 x words. C: 100 x capital letters A-Z > 2 x code points. D: holds one of
``#$%&*|``. E: the text is that of a smaller id, anywhere in the table.

E is an existential self-join: a left-semi join of the rows with the smallest id of each repeated text, on the text's
hash, the text itself and a smaller id. The table side has one row a text, folded before the shuffle; rows of a hash
that holds much of the table are dealt over many tasks. Rows that E marks are united with those that fail A to D, and the
failures of a row become one of 32 combinations of bits. Combinations are counted per part; every order and step of
filters follows from at most 32 counts a part, so no document is looked at twice.

Defined cases: a null text is empty; it fails A. A null id fails no E and lends it to no other row. Rows that repeat an
id all count; those of one id have no smaller id among each other. A label belongs to all rows of its id; of repeated
labels any that is 1 counts, and those of a null id belong to no row. A null part is the empty one. Without rows
there are no parts, hence no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transit_spark.llm.skew import spread

LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT = 200, 50, 2
MARKS = "[#$%&*|]"
REPEATED = 1 << LETTERS.index("E")


def own_failures(text: Column) -> Column:
    """Bits of the filters that need the text alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    failed = (
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words),
        100 * capitals.cast("long") > MOST_CAPITAL_PERCENT * F.length(text),
        text.rlike(MARKS),
    )
    bits = F.lit(0)
    for i, condition in enumerate(failed):
        bits = bits + F.when(condition, 1 << i).otherwise(0)
    return bits


def repeated(rows: DataFrame) -> DataFrame:
    """The rows (id, hash, text, ...) whose text a smaller id has as well."""
    rows = rows.where(F.col("id").isNotNull())
    firsts = rows.groupBy("hash", "text").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    left, right = spread(rows, firsts.drop("n"), counts, "hash", "id")
    a, b = left.alias("a"), right.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("hash", "salt", "text")]
    return a.join(b, [*same, F.col("b.first_id") < F.col("a.id")], "left_semi").drop("salt")


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> DataFrame:
    """(part, bits, n, good, toxic): rows per part and set of failed filters, and those with a label among them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("hash"), text.alias("text"),
    )
    row = ("id", "part", "hash")
    own = rows.select(*row, own_failures(F.col("text")).alias("bits"), F.lit(1).alias("n"))
    marked = repeated(rows).select(*row, F.lit(REPEATED).alias("bits"), F.lit(0).alias("n"))
    failures = own.unionByName(marked).groupBy(*row).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    failures = failures.groupBy("id", "part", "bits").agg(F.sum("n").alias("n"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("is_good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("is_toxic"),
    )

    def labelled(flag: str) -> Column:
        return F.sum(F.when(F.col(flag) == 1, F.col("n")).otherwise(0))

    return failures.join(known, "id", "left").groupBy("part", "bits").agg(
        F.sum("n").alias("n"), labelled("is_good").alias("good"), labelled("is_toxic").alias("toxic")
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step in it; 600 a part."""
    entry = F.struct("bits", "n", "good", "toxic")
    parts = combinations(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(entry).alias("sets"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))

    def bit(letter: str) -> str:
        return f"shiftleft(1, ascii({letter}) - ascii('A'))"

    earlier = F.expr(f"aggregate(sequence(1, {len(LETTERS)}), 0, (m, i) -> if(i < step, m | {bit('substr(filter_order, i, 1)')}, m))")
    steps = steps.withColumn("bit", F.expr(bit("substr(filter_order, step, 1)"))).withColumn("earlier", earlier)

    def total(condition: str, value: str = "s.n") -> Column:
        return F.expr(f"aggregate(sets, 0L, (t, s) -> t + if({condition}, {value}, 0L))")

    removed = "(s.bits & bit) != 0 AND (s.bits & earlier) = 0"
    return steps.select(
        "part", "filter_order", "step",
        total("(s.bits & (bit | earlier)) = 0").alias("kept"),
        total(removed).alias("removed"),
        total("(s.bits & bit) != 0 AND (s.bits & earlier) != 0").alias("redundant"),
        total("s.bits = bit").alias("unique_fails"),
        total(removed, "s.good").alias("good_lost"),
        total(removed, "s.toxic").alias("toxic_lost"),
        # of k filters that a document fails, each comes first in 120 / k of the orders
        total("(s.bits & bit) != 0", "(s.n * 120L) div bit_count(s.bits)").alias("shapley"),
    )
