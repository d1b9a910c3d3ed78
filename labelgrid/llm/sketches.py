"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A sketch is the sorted array of the k smallest 64-bit hashes of a document's
distinct shingles.  Sketches of parts merge into the sketch of the whole, and
give estimates of resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 128
WORDS = 5
HASHES = "_labelgrid_hashes"


def word_hashes(text: Column) -> Column:
    """Hash of each word of the lower-cased text; words are runs without ASCII white space."""
    words = F.split(F.regexp_replace(F.lower(text), "^\\s++|\\s++$", ""), "\\s++")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, words: int = WORDS) -> Column:
    """Hash of each run of ``words`` word hashes; none for none.

    Fewer word hashes give one value: from 42, each step hashes the value so far and the next word hash.
    """
    n = F.size(hashes)
    full = F.transform(F.sequence(F.lit(1), n - words + 1), lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(words)]))
    short = F.array(F.aggregate(hashes, F.lit(42).cast("long"), lambda a, h: F.xxhash64(a, h)))
    return F.when(n >= words, full).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))


def bottom_k(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct values, ascending.

    Only values under a bound that some 2k of a large array pass are sorted; should repeats leave fewer
    than k of them, the whole array is used.
    """
    n = F.size(hashes)
    bound = F.when(n <= 4 * k, F.lit(2**63 - 1)).otherwise((F.lit(-(2.0**63)) + F.lit(2.0**64 * (2 * k + 20)) / F.greatest(n, F.lit(4 * k))).cast("long"))
    low = F.array_distinct(F.filter(hashes, lambda h: h <= bound))
    whole = F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)
    return F.when((n <= 4 * k) | (F.size(low) >= k), F.slice(F.sort_array(low), 1, k)).otherwise(whole)


def with_sketch(df: DataFrame, text_col: str, out: str, k: int = K) -> DataFrame:
    """Adds ``out`` (a column of that name is replaced): the sketch of a text (NULL: empty).  Stages are separate projections, so nothing is computed twice."""
    staged = df.withColumn(HASHES, word_hashes(F.coalesce(F.col(text_col), F.lit("")))).withColumn(HASHES, shingle_hashes(F.col(HASHES)))
    return staged.withColumn(out, bottom_k(F.col(HASHES), k)).drop(HASHES)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1; two empty sketches are alike."""
    union = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common.cast("double") / F.greatest(F.size(union), F.lit(1)).cast("double"))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated distinct shingles; exact below k."""
    span = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an empty ``a``."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / F.greatest(distinct_count(a, k), F.lit(1.0))))


def printed(a: Column) -> Column:
    """A sketch as text, 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fold(df: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """Sketch of each group of sketches: the k smallest distinct hashes, found by two rounds of ranking-free aggregates.

    NULL sketches are empty; a group without hashes keeps its row, with an empty sketch.
    """
    # Outer: for a plain explode the optimiser filters on the sketch's size, below the projections that make it,
    # and so works out the whole nest of them for every element.
    hashes = df.select(*by, F.explode_outer(sketch).alias("h")).distinct()
    # Salted first: a hot group is cut to k hashes in 64 places before it meets in one.
    part = hashes.groupBy(*by, F.pmod("h", F.lit(64)).alias("salt")).agg(F.slice(F.sort_array(F.collect_set("h")), 1, k).alias("s"))
    return part.groupBy(*by).agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))), 1, k).alias(sketch))


# -- each document and the one after it --------------------------------------


def _bucket(key: str, bounds: list[float]) -> Column:
    """Number of bounds below the key, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    below = lambda b: b < F.col(key).cast("double")
    heads = F.array(*[F.lit(g[0]) for g in groups])
    first = F.greatest(F.size(F.filter(heads, below)), F.lit(1))
    inner = F.element_at(F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups]), first)
    return F.coalesce((first - 1) * step + F.size(F.filter(inner, below)), F.lit(0))


def with_next(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """``df`` (id, text) with the buckets and sentinels that let a window see the next row by (id, text).

    Rows are dealt by ranges of the id, so no task holds the whole order; the first row of each range is
    copied behind the range before it, the first of all behind the last.  Drop rows with ``sentinel`` after.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = df.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    dealt = df.withColumn("bucket", _bucket(id_col, sorted(set(found))))
    firsts = sorted(dealt.groupBy("bucket").agg(F.min(id_col).alias("id"), F.max(F.col(id_col).isNull()).alias("null")).collect(), key=lambda r: r.bucket)
    rows = [(None if r.null else r.id, firsts[k - 1].bucket) for k, r in enumerate(firsts)]  # one row a bucket
    kind = df.schema[id_col].dataType.simpleString()
    ahead = spark.createDataFrame(rows, f"first_id {kind}, bucket int")
    copies = df.join(F.broadcast(ahead), F.col(id_col).eqNullSafe(F.col("first_id"))).drop("first_id").withColumn("sentinel", F.lit(1))
    both = dealt.withColumn("sentinel", F.lit(0)).unionByName(copies)
    return both, Window.partitionBy("bucket").orderBy("sentinel", id_col, text_col)


def edited_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next one, with their likeness.

    The edited text has its last quarter (floor, in code points) replaced by as many first code points of the
    next document, or all it has.  Order is by id, then text; NULL ids first; after the last comes the first.
    NULL texts are empty; a lone document is its own next; repeated rows stay; other columns are ignored; an empty frame
    gives no rows.  Texts are held whole, two at a time.  Ids are numbers, and an id column named like an output is refused.
    """
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"]
    if id_col.lower() in names or not isinstance(df.schema[id_col].dataType, T.NumericType):
        raise ValueError(f"ids must be numbers, in a column named otherwise than {names}")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    both, order = with_next(docs, "id", "t")
    rows = with_sketch(both.withColumn("next_t", F.lead("t").over(order)), "t", "a")
    rows = rows.withColumn("next_a", F.lead("a").over(order)).where("sentinel = 0")
    n = F.length("t")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), n - cut), F.substring("next_t", F.lit(1), cut))
    rows = with_sketch(rows.select("id", "a", "next_a", n.cast("long").alias("n_chars"), edited.alias("e")), "e", "b")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.encode("e", "UTF-8"), 256).alias("edited_sha256"), printed(F.col("a")).alias("fingerprint"),
        printed(F.col("b")).alias("edited_fingerprint"), resemblance(F.col("a"), F.col("b")).alias("near_edited"), resemblance(F.col("a"), F.col("next_a")).alias("near_next"),
        distinct_count(F.col("a")).alias("n_shingles"),
    )
