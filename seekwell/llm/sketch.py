"""Document fingerprints: the k least hashes of a text's shingles, with DataFrame functions only.

Such a bottom-k sketch (Broder 1997, Cohen and Kaplan 2007) is a sample of the distinct shingles that depends on nothing but
their set. Sketches of parts merge to the sketch of the whole, and two of them estimate how much two texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekwell.llm.common import written

# The white space between words, x20 and x09 to x0D.
BLANKS = " \t\n\x0b\f\r"
SPACES = "[\\x20\\x09-\\x0D]+"
K = 128
WORDS = 5
FANOUT = 32


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The `k` least distinct hashes of the shingles of `words` words of a whole text, ascending (array of long).

    Words are lower-cased and stand between ASCII white space. A text of fewer words is one shingle; a null, empty or
    blank text has an empty sketch. Equal texts have equal sketches. One row's words are held in memory.
    """
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))

    def hashes(parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(parts) - (words - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(parts, i, F.lit(words))))

    # the words are bound to a name by a one-element array, else they would be split anew for each shingle
    bound = F.transform(F.array(F.split(bare, SPACES)), hashes)[0]
    least = F.slice(F.sort_array(F.array_distinct(bound)), 1, k)
    return F.when(bare == "", F.array().cast("array<long>")).otherwise(least)


def sketch_digits(a: Column) -> Column:
    """A sketch as text: 16 lowercase hex digits for each of its hashes. That of an empty sketch is empty."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the distinct shingles of either text that both have (0 to 1); exact for up to `k` of them in
    all. Two empty sketches are alike (1), an empty and another one are not (0)."""
    whole = merged(a, b, k)
    both = F.size(F.array_intersect(whole, F.array_intersect(a, b)))
    return F.when(F.size(whole) == 0, F.lit(1.0)).otherwise(both / F.size(whole))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below `k`."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the distinct shingles of `a` that `b` has too (0 to 1); 1 for an empty `a`."""
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge_sketches(rows: DataFrame, key: str, sketches: str, k: int = K) -> DataFrame:
    """(key, sketch): the sketch of all rows of each key together. A key may have any number of rows: copies of a hash and
    what is beyond the k least are dropped before rows of a key meet."""
    hashes = rows.select(key, F.explode(sketches).alias("hash")).distinct()
    nth = F.row_number().over(Window.partitionBy(key).orderBy("hash"))
    least = hashes.withColumn("nth", nth).where(F.col("nth") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("hash")).alias("sketch"))


def _bucket(order: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie below `order`, level by level with at most `FANOUT` comparisons each."""
    if not bounds:
        return F.lit(0)

    def below(some: list[int]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, some)), lambda b: b < order))

    if len(bounds) <= FANOUT:
        return below(bounds)
    groups = [bounds[i : i + FANOUT] for i in range(0, len(bounds), FANOUT)]
    inner = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    group = F.least(_bucket(order, [g[-1] for g in groups]), F.lit(len(groups) - 1))
    return group * FANOUT + F.size(F.filter(F.element_at(inner, group + 1), lambda b: b < order))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): each document and the one that follows in ascending `doc_id`.

    After the last comes the first; a single document follows itself. A null id comes first; rows of equal ids
    come in order of their text. Documents are dealt by ranges of ids, at most one text is moved twice per range: the first of
    each range goes to the range before it as well.
    """
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), order.alias("place"))
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 20 * ranges) if ranges > 1 else F.lit(None)
    bounds = sorted(set(rows.agg(cuts).first()[0] or []))  # a number per range
    rows = rows.withColumn("bucket", _bucket(F.col("place"), bounds))
    first = rows.groupBy("bucket").agg(F.min("place").alias("place"))
    # a row per range; the range before the first is the last
    first = written(first, "ranges")
    ascending = Window.orderBy("bucket")
    last = F.last("bucket").over(ascending.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    guests = first.select("place", F.coalesce(F.lag("bucket").over(ascending), last).alias("guest_of"))
    places = F.array_compact(
        F.array(
            F.struct(F.col("bucket"), F.lit(False).alias("guest")),
            F.when(F.col("guest_of").isNotNull(), F.struct(F.col("guest_of").alias("bucket"), F.lit(True).alias("guest"))),
        )
    )
    dealt = rows.join(F.broadcast(guests), "place", "left").select("doc_id", "text", "place", F.explode(places).alias("at"))
    dealt = dealt.select("doc_id", "text", "place", "at.bucket", "at.guest").repartition(F.col("bucket"))
    sketched = dealt.withColumn("sketch", sketch(F.col("text"), k, words))
    follow = Window.partitionBy("bucket").orderBy("guest", "place", "text")
    following = sketched.withColumns(
        {"next_text": F.lead("text").over(follow), "next_sketch": F.lead("sketch").over(follow)}
    )
    return following.where("not guest").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The edited text has the last half of the code points replaced by as many of the next document's first ones, or by all of
    them where there are fewer. `near_edited` and `near_next` are resemblances. An empty table gives an empty table.
    """
    n = F.col("n_chars")
    edited = F.concat(F.expr("left(text, n_chars - n_chars div 2)"), F.expr("left(next_text, n_chars div 2)"))
    rows = with_next(docs, k=k, words=words).withColumn("n_chars", F.length("text"))
    rows = rows.withColumn("edited_text", edited).withColumn("edited_fingerprint", sketch(F.col("edited_text"), k, words))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "edited_text",
        F.col("sketch").alias("fingerprint"),
        "edited_fingerprint",
        resemblance(F.col("sketch"), F.col("edited_fingerprint"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
