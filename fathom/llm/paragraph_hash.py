"""Homomorphic multiset hash of a text's paragraphs, in DataFrame functions alone.

A paragraph is a line. Each one is hashed to a wide vector of two parts:

* ``digests``: ``DIGESTS`` lanes modulo 2^32, cut from two SHA-256 values of the paragraph;
* ``signs``: ``SIGNS`` lanes modulo 2^24. Every three consecutive words of the paragraph (all of
  them, if there are fewer; 16 characters at most count as one word) give +1 or -1 in each lane by the bits of their MD5.

The fingerprint of a text is the sum of its paragraphs' vectors, lane by lane. So the order of
paragraphs does not matter, :func:`joined` inserts paragraphs and :func:`without` deletes them
without the rest of the text, and equal multisets of paragraphs have equal fingerprints. The sum
of squared ``signs`` estimates the number of word triples, that of a difference the triples in
which two texts differ: :func:`likeness` is ``1 - |a - b|^2 / (|a|^2 + |b|^2)``, the Dice
coefficient of the triples but for an error of about 0.09.

Sums run as hash aggregates within the task that holds the text; two lanes share one 64-bit sum,
30 bits each, which no text of up to 2^31 bytes can fill. A text moves twice: to its key, and its
beginning to the document before. Neighbours are found on keys alone: range partitions of the
order, a window within each, and one row a partition to pass the ends on.

Defined cases: a null text is the empty text, which is one empty paragraph; blank paragraphs count
in ``digests`` only; rows that repeat a doc_id and text are one document and each get its row;
rows that share a doc_id follow by the hash of doc_id and text; null doc_ids come first; the next
document of a single one is itself; likeness is 1 for equal ``digests``, and 0 if they differ and
neither text has a word; a lane beyond +-2^23 wraps; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.plans.storage import materialise, release_shuffles

DIGESTS = 16
SIGNS = 120
DIGEST_RING = 1 << 32
SIGN_RING = 1 << 24
BITS = 30
PAIR = 1 | 1 << BITS
# Words; what is longer counts as several, so that text without spaces has triples, too.
WORD = r"[^\x20\x09-\x0D]{1,16}"
# A repeated document's rows are made in runs of this many.
RUN = 1 << 16


def paragraph_sums(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, ``digests`` and ``signs`` of every ``text``; texts of equal keys are added up."""
    lines = texts.select(*keys, F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = lines.select(
        *keys,
        F.sha2(F.concat(F.lit("0:"), "line"), 256).alias("hash_0"),
        F.sha2(F.concat(F.lit("1:"), "line"), 256).alias("hash_1"),
        F.regexp_extract_all("line", F.lit(WORD), F.lit(0)).alias("words"),
    )
    n_words = F.size("words")
    triples = lines.select(
        "*", n_words.alias("n_words"), F.explode(F.sequence(F.lit(0), F.greatest(n_words - 3, F.lit(0)))).alias("at")
    )
    words = [F.get("words", F.col("at") + i) for i in range(3)]
    triples = triples.select(
        *keys, "hash_0", "hash_1", (F.col("at") == 0).alias("first"), (F.col("n_words") > 0).alias("real"),
        F.md5(F.concat_ws(" ", *words)).alias("triple"),
    )
    halves = [
        F.when(F.col("real"), F.conv(F.substring("triple", 1 + 15 * half, 15), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
        for half in range(2)
    ]
    triples = triples.select(*keys, "hash_0", "hash_1", "first", "real", halves[0].alias("half_0"), halves[1].alias("half_1"))

    def digest_lane(lane: int) -> Column:
        value = F.conv(F.substring(f"hash_{lane // 8}", 1 + 8 * (lane % 8), 8), 16, 10).cast("long")
        return F.sum(F.when(F.col("first"), value).otherwise(F.lit(0).cast("long")))

    digests = [digest_lane(lane).alias(f"digest_{lane}") for lane in range(DIGESTS)]
    packed = [
        F.sum(F.shiftright(f"half_{half}", bit).bitwiseAND(F.lit(PAIR).cast("long"))).alias(f"bits_{half * BITS + bit}")
        for half in range(2)
        for bit in range(BITS)
    ]
    sums = triples.groupBy(*keys).agg(*digests, *packed, F.count_if("real").alias("n_triples"))
    low = F.lit((1 << BITS) - 1).cast("long")
    both = F.array(*[f"bits_{i}" for i in range(2 * BITS)])
    counts = F.concat(F.transform(both, lambda x: x.bitwiseAND(low)), F.transform(both, lambda x: F.shiftright(x, BITS)))
    signs = F.transform(counts, lambda x: F.pmod(2 * x - F.col("n_triples"), F.lit(SIGN_RING)).cast("int"))
    lanes = F.transform(F.array(*[f"digest_{i}" for i in range(DIGESTS)]), lambda x: F.pmod(x, F.lit(DIGEST_RING)))
    return sums.select(*keys, lanes.alias("digests"), signs.alias("signs"))


def joined(a: Column, b: Column, ring: int) -> Column:
    """Lanes of the paragraphs of both."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x.cast("long") + y, F.lit(ring)))


def without(a: Column, b: Column, ring: int) -> Column:
    """Lanes of ``a`` after deleting the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x.cast("long") - y, F.lit(ring)))


def _squares(lanes: Column) -> Column:
    """The sum of squares of lanes read as -2^23 to 2^23."""

    def square(total: Column, lane: Column) -> Column:
        value = lane.cast("long") - F.when(lane >= SIGN_RING // 2, F.lit(SIGN_RING)).otherwise(F.lit(0))
        return total + value * value

    return F.aggregate(lanes, F.lit(0).cast("long"), square)


def likeness(digests_a: Column, signs_a: Column, digests_b: Column, signs_b: Column) -> Column:
    """0 to 1: the estimated share of word triples that two texts have in common."""
    both = _squares(signs_a) + _squares(signs_b)
    apart = _squares(without(signs_a, signs_b, SIGN_RING))
    return (
        F.when(digests_a == digests_b, F.lit(1.0))
        .when(both == 0, F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - apart.cast("double") / both.cast("double")))
    )


def encoded(digests: Column, signs: Column) -> Column:
    """All lanes as one text: big-endian bytes (4 a digest lane, 3 a sign lane) in Base64."""
    digits = [
        F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), width, "0")), "")
        for lanes, width in ((digests, 8), (signs, 6))
    ]
    return F.translate(F.base64(F.unhex(F.concat(*digits))), "\r\n", "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, ``digests``, ``signs`` and the encoded ``fingerprint`` of every document."""
    keyed = _keyed(docs)
    texts = keyed.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    sums = paragraph_sums(texts, "key", "doc_id", "copies")
    return _repeated(sums).select("doc_id", "digests", "signs", encoded(F.col("digests"), F.col("signs")).alias("fingerprint"))


def _keyed(docs: DataFrame) -> DataFrame:
    """key (SHA-256 of doc_id and text), doc_id, text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text)
    return docs.select(F.unhex(F.sha2(name, 256)).alias("key"), "doc_id", text.alias("text"))


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row ``copies`` times, made in bounded runs."""
    runs = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))).alias("run"))
    size = F.least(F.lit(RUN).cast("long"), F.col("copies") - F.col("run") * RUN)
    return runs.select("*", F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("copy")).drop("run", "copy", "copies")


def neighbours(keyed: DataFrame) -> DataFrame:
    """key, and key, doc_id, copies and n_chars of the document ``before`` it by ascending doc_id.

    The document before the first is the last one.
    """
    sizes = keyed.groupBy("doc_id", "key").agg(
        F.max(F.char_length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("copies")
    )
    order = (F.col("doc_id").asc_nulls_first(), F.col("key").asc())
    ranged = sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    stored = materialise(ranged, "paragraph-order")
    whole = F.struct("doc_id", "key", "n_chars", "copies")
    # One row a range partition: the last document of the one before it.
    ends = stored.groupBy("part").agg(F.max(whole).alias("end"))
    by_part = Window.orderBy("part")
    everything = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select("part", F.coalesce(F.lag("end").over(by_part), F.last("end").over(everything)).alias("end"))
    before = F.lag(whole).over(Window.partitionBy("part").orderBy(*order))
    linked = stored.withColumn("before", before).join(F.broadcast(carried), "part")
    return linked.select("key", F.coalesce("before", "end").alias("before"))


def _packed(digests: Column, signs: Column) -> Column:
    """Lanes as 4 and 3 bytes each, small numbers of either sign with zeros in their upper bytes."""
    near = F.transform(signs, lambda x: F.when(x < SIGN_RING // 2, 2 * x).otherwise(2 * (SIGN_RING - x) - 1))

    def plane(shift: int) -> Column:
        return F.transform(near, lambda x: (F.shiftright(x, shift).bitwiseAND(F.lit(255)) - 128).cast("tinyint"))

    planes = [plane(0).alias("low"), plane(8).alias("middle"), plane(16).alias("high")]
    return F.struct(F.transform(digests, lambda x: (x - DIGEST_RING // 2).cast("int")).alias("digests"), *planes)


def _unpacked(packed: Column) -> tuple[Column, Column]:
    """digests and signs of :func:`_packed`."""
    digests = F.transform(packed["digests"], lambda x: x.cast("long") + DIGEST_RING // 2)

    def byte(value: Column) -> Column:
        return value.cast("int") + 128

    near = F.zip_with(
        F.zip_with(packed["low"], packed["middle"], lambda x, y: byte(x) + 256 * byte(y)), packed["high"], lambda x, y: x + 65536 * byte(y)
    )
    signs = F.transform(near, lambda x: F.when(x % 2 == 0, F.shiftright(x, 1)).otherwise(SIGN_RING - F.shiftright(x + 1, 1)))
    return digests, signs


def _sums_of_pairs(docs: DataFrame) -> DataFrame:
    """A written table of every document, its key and the next one's, and the lanes of text and edited text."""
    keyed = _keyed(docs)
    # Both uses read one exchange: the texts by key.
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    wanted = F.floor(F.col("before.n_chars") / 2).cast("int")
    heads = texts.join(neighbours(keyed), "key").select(
        "before.*", F.col("key").alias("next_key"), F.substring(F.col("text"), F.lit(1), wanted).alias("head")
    )
    stays = (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), stays), F.col("head"))
    pairs = texts.join(heads, "key").select("key", "doc_id", "copies", "next_key", "n_chars", "text", edited.alias("edited"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))))
    kept = ["key", "doc_id", "copies", "next_key", "n_chars", "edited_sha256"]
    both = pairs.select("*", F.sha2("edited", 256).alias("edited_sha256")).select(*kept, sides.alias("one"))
    sums = paragraph_sums(both.select(*kept, "one.side", "one.text"), *kept, "side")
    # Two rows a document.
    beside = sums.groupBy(*kept).agg(F.sort_array(F.collect_list(F.struct("side", "digests", "signs"))).alias("both"))
    return materialise(
        beside.select(
            *kept,
            *[_packed(F.col("both")[i]["digests"], F.col("both")[i]["signs"]).alias(name) for i, name in enumerate(("own", "edited"))],
        ),
        "paragraph-sums",
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every document beside its edited text, whose last half is the beginning of the next document.

    doc_id, n_chars, edited_sha256, ``digests`` and ``signs`` of the text, of the edited text
    (``edited_``) and of the next document (``next_``), and the likeness to both.
    """
    stored = _sums_of_pairs(docs)
    release_shuffles(docs.sparkSession)
    following = stored.select(F.col("key").alias("next_key"), F.col("own").alias("next"))
    beside = stored.join(following, "next_key")
    lanes = [
        lane.alias(f"{prefix}{name}")
        for side, prefix in (("own", ""), ("edited", "edited_"), ("next", "next_"))
        for lane, name in zip(_unpacked(F.col(side)), ("digests", "signs"))
    ]
    own = (F.col("digests"), F.col("signs"))
    return _repeated(beside.select("doc_id", "copies", "n_chars", "edited_sha256", *lanes)).select(
        "doc_id", "n_chars", "edited_sha256", "digests", "signs", "edited_digests", "edited_signs", "next_digests", "next_signs",
        likeness(*own, F.col("edited_digests"), F.col("edited_signs")).alias("near_edited"),
        likeness(*own, F.col("next_digests"), F.col("next_signs")).alias("near_next"),
    )


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    pairs = edited_pairs(docs)
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256",
        encoded(F.col("digests"), F.col("signs")).alias("fingerprint"),
        encoded(F.col("edited_digests"), F.col("edited_signs")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
