"""Secrets in texts, and whose they are: spans of known forms, and of tokens that a corpus-wide count of owners tells apart.

Three base forms are found in every text, leftmost and without overlap per form: ``assign``, a word for a credential with a
value of 6 or more characters; ``access``, ``AKIA`` and capitals or digits, 20 or more characters; ``hex``, 24 or more
lower-case hex digits. A span is the whole match, in code points. Base spans always stay.

Beside them, every token of 16 or more characters that reads as a drawn one (letters turn into digits at three places or
more, eight distinct characters) is a candidate unless it overlaps a base span. Values of base spans and candidates are
hashed, and each hash is counted over the whole corpus by distinct repositories and owners:

- ``reused``: a candidate that is the value of a base span anywhere is a credential without its context;
- ``owned``: one that a single owner has is a credential that looks live;
- one that several owners have is a widely copied example, and is no span.

The same counts tell, for base spans, those of one owner (``n_live``) from widely copied ones (``n_copied``).

All of it is DataFrame functions. Texts are scanned once, into a stored table of positions and SHA-256 digests, so that no
credential is written. Counts collapse by (hash, owner, repository), then (hash, owner), then hash, each with map-side
sums; a hash that holds much of the corpus is dealt over many tasks when its counts are joined back.

Defined cases: a null text is empty, and an empty one has no spans. A null owner is one owner of its own; a repository is the
row's id within its owner, a null id one of its own. Repeated rows each return a row and count as one repository. Without
rows the result is empty. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transit_spark.llm.skew import spread
from transit_spark.session import materialise


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN_VALUE = "[A-Za-z0-9+/_.=-]+"
BEFORE_VALUE = rf"""(?:{NAMES})["']?\x20*[:=]\x20*["']?"""
#: Form -> pattern, in the order in which spans with one start are listed. Runs are maximal, so their least length can be part of the pattern.
BASE = {"assign": BEFORE_VALUE + ASSIGN_VALUE, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
LEAST_VALUE = 6
TOKEN = "[A-Za-z0-9+/_-]{16,}={0,2}"
LEAST_TURNS, LEAST_DISTINCT = 3, 8
MOST_OWNERS = 1
BLOCK = 256


def matches(rows: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: (start, end, value) of each match, leftmost and without overlap, in code points.

    Splitting at the matches gives the stretches between them. A match begins after all earlier ones and the stretches up
    to it; sums over whole blocks of ``BLOCK`` matches are made first, so that the work doesn't grow with their square.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = rows.withColumn("_found", found)
    between = F.when(F.size("_found") > 0, F.split(text, pattern, -1))
    rows = rows.withColumn("_gaps", F.transform(between, F.length))
    rows = rows.withColumn("_steps", F.zip_with("_gaps", F.transform("_found", F.length), lambda g, m: g.cast("long") + F.coalesce(m, F.lit(0))))
    blocks = (
        f"aggregate(sequence(0, (size(_found) - 1) div {BLOCK}), array(0L), (upto, b) -> array_append(upto, element_at(upto, -1)"
        f" + aggregate(slice(_steps, cast(b * {BLOCK} + 1 as int), {BLOCK}), 0L, (s, x) -> s + x)))"
    )
    rows = rows.withColumn("_blocks", F.expr(f"if(size(_found) > 0, {blocks}, array(0L))"))
    start = (
        f"_gaps[i] + _blocks[cast(i div {BLOCK} as int)]"
        f" + aggregate(slice(_steps, cast(i div {BLOCK} * {BLOCK} + 1 as int), i % {BLOCK}), 0L, (s, x) -> s + x)"
    )
    spans = F.expr(
        f"transform(_found, (m, i) -> struct({start} as start, {start} + length(m) as end, m as value))"
    )
    return rows.withColumn(out, spans).drop("_found", "_gaps", "_steps", "_blocks")


def looks_drawn(value: Column) -> Column:
    turns = F.regexp_count(value, F.lit("[A-Za-z][0-9]"))
    distinct = F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("."), F.lit(0))))
    return (turns >= LEAST_TURNS) & (distinct >= LEAST_DISTINCT)


def scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """(id, owner, text_hash, base, tokens): positions and digests of base spans and of candidates beside them."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit("")).alias("owner"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("text_hash", F.xxhash64("text"))

    def digested(span: Column, place: int, value: Column) -> Column:
        return F.struct(span["start"].alias("start"), F.lit(place).alias("place"), span["end"].alias("end"), F.sha2(value, 256).alias("digest"))

    def of_form(place: int, kind: str) -> Column:
        if kind != "assign":
            return F.transform(f"{kind}_spans", lambda s: digested(s, place, s["value"]))
        long_enough = F.filter(f"{kind}_spans", lambda s: F.length(_value(s["value"])) >= LEAST_VALUE)
        return F.transform(long_enough, lambda s: digested(s, place, _value(s["value"])))

    for kind, pattern in BASE.items():
        rows = matches(rows, "text", pattern, f"{kind}_spans")
    parts = [of_form(place, kind) for place, kind in enumerate(BASE)]
    rows = matches(rows, "text", TOKEN, "token_spans").withColumn("base", F.array_sort(F.concat(*parts)))

    def free(token: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < token["end"]) & (token["start"] < b["end"]))

    tokens = F.filter("token_spans", lambda t: looks_drawn(t["value"]) & free(t))
    return rows.select(
        "id", "owner", "text_hash", "base", F.transform(tokens, lambda t: digested(t, len(BASE), t["value"])).alias("tokens")
    )


def _value(match: Column) -> Column:
    return F.regexp_extract(match, f"^{BEFORE_VALUE}({ASSIGN_VALUE})$", 1)


def ownership(seen: DataFrame) -> DataFrame:
    """(digest, n, repositories, owners, is_base) of each digest in (digest, owner, id, is_base)."""
    of_repository = seen.groupBy("digest", "owner", "id").agg(F.count(F.lit(1)).alias("n"), F.max("is_base").alias("is_base"))
    of_owner = of_repository.groupBy("digest", "owner").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"), F.max("is_base").alias("is_base")
    )
    return of_owner.groupBy("digest").agg(
        F.sum("n").alias("n"), F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"),
        F.max("is_base").alias("is_base"),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         most_owners: int = MOST_OWNERS) -> DataFrame:
    """(id, base, added, n_live, n_copied) of each row: base spans, added ones, and whose the base ones are."""
    rows = materialise(scanned(docs, id_col, text_col, owner_col), "secret-spans")
    every = F.explode(F.concat("base", "tokens")).alias("span")
    seen = rows.select("id", "owner", "text_hash", every).select(
        "id", "owner", "text_hash", "span", F.col("span.digest").alias("digest"), (F.col("span.place") < len(BASE)).alias("is_base")
    )
    counts = materialise(ownership(seen), "secret-owners")
    # What is said of a span follows from its digest alone, so rows with one id and text can share the answer.
    spans = seen.select("id", "text_hash", "span", "digest").distinct()
    left, right = spread(spans, counts, counts.select("digest", "n"), "digest", "text_hash")
    judged = left.join(right, ["digest", "salt"])
    few = F.col("owners") <= most_owners
    base = F.col("span.place") < len(BASE)
    kind = F.when(base, None).when(F.col("is_base"), "reused").when(few, "owned")
    added = F.struct(F.col("span.start").alias("start"), F.col("span.place").alias("place"), F.col("span.end").alias("end"), kind.alias("kind"))
    found = judged.groupBy(F.col("id").alias("found_id"), F.col("text_hash").alias("found_hash")).agg(
        F.array_sort(F.collect_list(F.when(kind.isNotNull(), added))).alias("added"),
        F.sum((base & few).cast("long")).alias("n_live"), F.sum((base & ~few).cast("long")).alias("n_copied"),
    )
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash"))
    names = F.array(*[F.lit(k) for k in BASE])
    named = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"),
                                                   F.element_at(names, s["place"] + 1).alias("kind")))
    none = F.expr("cast(array() as array<struct<start: bigint, place: int, end: bigint, kind: string>>)")
    return rows.join(found, same, "left").select(
        F.col("id").alias(id_col), named.alias("base"), F.coalesce("added", none).alias("added"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def digest(found: DataFrame) -> DataFrame:
    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[of_kind(kind) for kind in BASE], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_copied",
    )
