"""Exact document fingerprints, by DataFrame functions only.

The canonical form of a text is NFC, case-folded, NFC again, with every run of white space
as one space and none at the ends.  Its fingerprint is 128 bits of xxhash.  Texts of equal
fingerprint are held to be equal only after a comparison of their canonical bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.llm.frames import cut, discard, stored

NORMALIZER = "com.ibm.icu.text.Normalizer"  # part of Spark, which uses it for collations
FOLDER = "com.ibm.icu.lang.UCharacter"
RANGE_ROWS = 1_000  # documents of a range of ids
COARSE = 128  # ranges are found in two steps, of so many bounds at most
SLOTS = (1 << 16, 1 << 21)  # of the filter of ids, least and most; it grows with what it holds


def canonical(text: Column) -> Column:
    """Canonical form of a text; null is the empty text."""
    plain = F.coalesce(text, F.lit(""))

    def nfc(x: Column) -> Column:
        return F.reflect(F.lit(NORMALIZER), F.lit("compose"), x, F.lit(False))

    folded = nfc(F.reflect(F.lit(FOLDER), F.lit("foldCase"), nfc(plain), F.lit(True)))
    # ASCII text needs neither normalisation nor more than lower case.
    form = F.when(F.octet_length(plain) == F.length(plain), F.lower(plain)).otherwise(folded)
    return F.trim(F.regexp_replace(form, "[\\s\\x1C-\\x1F\\x85\\p{Z}]+", " "))


def wide_hash(form: Column) -> Column:
    """128 bits of a canonical form, as two longs."""
    return F.struct(F.xxhash64(form).alias("a"), F.xxhash64(F.lit("wide"), form, F.octet_length(form)).alias("b"))


def as_hex(h: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(h["a"])), 16, "0"), F.lpad(F.lower(F.hex(h["b"])), 16, "0"))


def ranges(docs: DataFrame) -> tuple[Column, int]:
    """The range of each doc_id, ascending, and their number: about RANGE_ROWS documents each, COARSE ** 2 ranges at most.

    Bounds are quantiles of the ids, from a mergeable sketch, so ids that lie apart from the
    others, however far, do not gather those in one range.  Null ids, which have no order, fill as
    many ranges of their own after all others.
    """
    rows = docs.count()
    steps = min(max(int((rows / RANGE_ROWS) ** 0.5) + 1, 4), COARSE)
    many = steps * steps
    shares = [k / many for k in range(1, many)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * many).alias("q")).first()["q"] or []
    bounds = sorted(set(found))
    coarse = bounds[steps - 1 :: steps]
    null_range = F.lit(many) + F.pmod(F.xxhash64("text"), F.lit(many))

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda v: v <= F.col("doc_id")))

    if not bounds:
        return F.coalesce(F.when(F.col("doc_id").isNotNull(), 0), null_range).cast("int"), many
    first = steps * (below(F.array(*map(F.lit, coarse))) if coarse else F.lit(0))
    place = first + below(F.slice(F.array(*map(F.lit, bounds)), first + 1, F.lit(steps)))
    return F.coalesce(F.when(F.col("doc_id").isNotNull(), place), null_range).cast("int"), many


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``next_text``, that of the next doc_id (after the last: of the first).

    Ids are cut into :func:`ranges`.  The first document of each range is copied
    to the end of the range before it (by order of their first ids, the last range being
    followed by the first), so each range finds its neighbours alone.  Null ids come last;
    rows of equal id are ordered by text.
    """
    place, _ = ranges(docs)
    ranged = docs.withColumn("range", place)
    # Two rows a range at most: the first row of each range that has any.
    text_key = F.xxhash64("text")
    firsts = ranged.groupBy("range").agg(F.min(F.struct("doc_id", text_key.alias("key"))).alias("first"))
    order = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy()))
    targets = firsts.select(F.col("range").alias("of"), before.alias("to"), F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"))
    found = (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (text_key == F.col("first_key"))
    halo = ranged.join(F.broadcast(targets), found).dropDuplicates(["of"])
    rows = ranged.select("doc_id", "text", "range", F.lit(0).alias("halo")).unionByName(halo.select("doc_id", "text", F.col("to").alias("range"), F.lit(1).alias("halo")))
    line = Window.partitionBy("range").orderBy("halo", "doc_id", F.xxhash64("text"))
    return rows.withColumn("next_text", F.lead("text").over(line)).where(F.col("halo") == 0).select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points (rounded down) replaced by the first as many of the following text."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def _same(h1: Column, form1: Column, h2: Column, form2: Column) -> Column:
    """1 if the hashes agree and, compared byte by byte, the canonical forms too."""
    return F.when(h1 == h2, (form1 == form2).cast("double")).otherwise(0.0)


def classes(docs: DataFrame, hashed: DataFrame | None = None) -> DataFrame:
    """Exact classes of ``docs`` (doc_id, text): doc_id, class_id (the least doc_id of equal canonical text).

    Hashes (``hashed``: doc_id, a, b, where they are at hand) are grouped first, as a thin
    aggregate; only documents whose hash occurs under two ids go on, with their canonical form,
    to be compared byte by byte with that of their bucket's least id.  A hot bucket is a
    skewed join, which Spark splits.  The few that differ (a collision) form classes by
    SHA-256 within the bucket.  One row per row of these documents; the others are their own class.
    """
    if hashed is None:
        h = wide_hash(canonical(F.col("text")))
        hashed = docs.select("doc_id", h["a"].alias("a"), h["b"].alias("b"))
    hashed = hashed.where(F.col("doc_id").isNotNull())
    buckets = hashed.groupBy("a", "b").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where(F.col("leader") < F.col("last")).select("a", "b", "leader")
    members = cut(hashed.join(buckets, ["a", "b"]).select("doc_id").distinct())
    # A filter of ids ahead of the shuffle of texts, as large as it need be, within bounds.
    slots = min(max(16 * members.count(), SLOTS[0]), SLOTS[1])

    def held(rows: DataFrame, ids: DataFrame) -> DataFrame:
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
        return rows.join(F.broadcast(ids.select(slot.alias("slot")).distinct()), slot == F.col("slot"), "left_semi")

    h = wide_hash(F.col("form"))
    forms = held(docs.where(F.col("doc_id").isNotNull()), members).select("doc_id", canonical(F.col("text")).alias("form"))
    forms = forms.select("doc_id", "form", h["a"].alias("a"), h["b"].alias("b"))
    # The leaders' forms, found by id; so the one join by hash stands alone on its shuffle and can be split.
    leaders = buckets.withColumnRenamed("leader", "doc_id")
    heads = held(forms.withColumnRenamed("form", "head"), leaders).join(leaders, ["doc_id", "a", "b"]).groupBy("doc_id", "a", "b").agg(F.min("head").alias("head"))
    compared = forms.join(heads.withColumnRenamed("doc_id", "leader"), ["a", "b"]).select("doc_id", "leader", F.when(F.col("form") != F.col("head"), F.sha2(F.col("form"), 256)).alias("odd"))
    other = compared.where(F.col("odd").isNotNull())
    apart = other.join(other.groupBy("leader", "odd").agg(F.min("doc_id").alias("class_id")), ["leader", "odd"]).select("doc_id", "class_id")
    return compared.where(F.col("odd").isNull()).select("doc_id", F.col("leader").alias("class_id")).unionByName(apart)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all ``docs`` (doc_id, text) and of their edited texts.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next and class_id.  Null texts are empty; equal texts have equal fingerprints; an
    exact fingerprint is 1 like an equal canonical text and 0 like any other.  An empty
    table gives an empty result, a single document follows itself.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    pairs = with_next(base).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    forms = pairs.select("*", canonical(F.col("text")).alias("form"), canonical(F.col("edited")).alias("edited_form"), canonical(F.col("next_text")).alias("next_form"))
    hashed = forms.select("*", wide_hash(F.col("form")).alias("h"), wide_hash(F.col("edited_form")).alias("e"), wide_hash(F.col("next_form")).alias("x"))
    result = hashed.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode(F.col("edited"), "UTF-8"), 256).alias("edited_sha256"),
        as_hex(F.col("h")).alias("fingerprint"),
        as_hex(F.col("e")).alias("edited_fingerprint"),
        _same(F.col("h"), F.col("form"), F.col("e"), F.col("edited_form")).alias("near_edited"),
        _same(F.col("h"), F.col("form"), F.col("x"), F.col("next_form")).alias("near_next"),
        F.col("h.a").alias("a"),
        F.col("h.b").alias("b"),
    )
    thin, path = stored(result)
    grouped = classes(base, thin.select("doc_id", "a", "b")).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = cut(thin.drop("a", "b").join(grouped, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id")))
    discard(docs.sparkSession, path)
    return out
