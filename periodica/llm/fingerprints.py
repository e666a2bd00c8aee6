"""Bottom-k sketches of shingle hashes, as column expressions.

A text's shingles are its runs of five blank-separated, lower-cased words (the
whole sequence where there are fewer). The sketch holds the ``k`` smallest 48-bit
hashes of the distinct shingles, ascending. The sketch of a whole is the ``k``
smallest of its parts' sketches, so parts can be sketched apart and merged; a
sketch shorter than ``k`` is the whole set and its estimates are exact.

Null or empty texts and texts of blanks have an empty sketch. Two empty sketches
are alike (1), an empty and a filled one are not (0). Equal texts have equal
sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.llm.common import text_columns

K = 64
WORDS = 5
#: Neighbouring ids that are ordered together, and buckets whose order is settled together.
RUN, RUNS = 64, 4096


def with_sketch(df: DataFrame, text_col: str, name: str, k: int = K, words: int = WORDS) -> DataFrame:
    """``df`` with the sketch of a text column."""
    blanks = "[\\x20\\x09-\\x0D]+"
    trimmed = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"^{blanks}|{blanks}$", "")
    parts = F.when(F.length(trimmed) > 0, F.split(F.lower(trimmed), blanks)).otherwise(F.array().cast("array<string>"))
    hashed = df.withColumn("_w", F.transform(parts, lambda w: F.xxhash64(w)))
    # Two uses keep ``_w`` a column of its own, so that it is not computed again for each shingle.
    runs = F.when(F.size("_w") > 0, F.sequence(F.lit(1), F.greatest(F.size("_w") - (words - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    shingles = F.transform(runs, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice("_w", i, words)), 16))
    return hashed.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop("_w")


def merged(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts; map tasks send ``k`` hashes of a key at most."""
    hashes = parts.select(*keys, F.explode(sketch).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    kept = hashes.withColumn("_r", rank).where(F.col("_r") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def resemblance(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimated Jaccard similarity of the sketched sets."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.size(union).cast("double"))


def distinct_count(a: Column | str, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    a = F.col(a) if isinstance(a, str) else a
    share = (F.element_at(a, -1) + 1).cast("double") / F.lit(float(1 << 48))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` holds too."""
    held = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    size = distinct_count(a, k)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), held / size))


def shown(a: Column | str) -> Column:
    """A sketch as text: twelve hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 12, "0")), "")


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch) in ascending doc_id; the first follows the last.

    Ids are ordered within short runs of neighbouring ids. The last of a run is
    followed by the head of the next run that exists, found on the run numbers
    alone. Rows without an id come first; equal ids are ordered by text.
    """
    base = text_columns(docs).withColumn("text", F.coalesce("text", F.lit("")))
    base = base.withColumn("_run", F.floor(F.coalesce("doc_id", F.lit(-(1 << 62))) / RUN).cast("long"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("text"))
    heads = base.groupBy("_run").agg(F.min(order)["text"].alias("text"))
    runs = heads.select("_run", F.floor(F.col("_run") / RUNS).alias("_far"))
    far = runs.groupBy("_far").agg(F.min("_run").alias("_head"))
    far = far.withColumn("_after", F.lead("_head").over(Window.orderBy("_far")))
    first = far.agg(F.min("_head").alias("_first"))
    after = runs.withColumn("_then", F.lead("_run").over(Window.partitionBy("_far").orderBy("_run"))).join(far.select("_far", "_after"), "_far")
    after = after.select("_run", F.coalesce("_then", "_after").alias("_then"))
    # Only the last run has none after it: it meets the first.
    tails = after.select("_run", F.coalesce(F.col("_then"), first.scalar()).alias("_then"))
    tails = tails.join(heads.withColumnRenamed("_run", "_then"), "_then").select(F.lit(None).cast("long").alias("doc_id"), "text", "_run", F.lit(1).alias("_end"))
    rows = with_sketch(base.withColumn("_end", F.lit(0)).unionByName(tails), "text", "sketch", k)
    w = Window.partitionBy("_run").orderBy("_end", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sketch", F.lead("sketch").over(w))
    return rows.where("_end = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def edited_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's fingerprint and its likeness to its edited text and to the next document."""
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = with_sketch(with_next(docs, k).withColumn("_edited", edited), "_edited", "_edited_sketch", k)
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        shown("sketch").alias("fingerprint"), shown("_edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch", "_edited_sketch", k).alias("near_edited"), resemblance("sketch", "next_sketch", k).alias("near_next"),
    )
