"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its phrases: it is cut at line ends and behind words that end in one of ``ENDS``, which depends
on the text around a cut alone, so an edit changes the phrases it touches and no others. A term weighs the
code points of its occurrences, so that likeness is a share of the text. For each of
``SAMPLES`` samples a term of weight w draws, from a 64-bit hash of the term and the sample alone,

    r, c ~ Gamma(2, 1)    b ~ Uniform(0, 1)        (from 18, 36 and 10 bits of the hash)
    t = floor(ln w / r + b)    ln a = ln c - r (t - b) - r

and the sample is (term, t) of the least a. Two texts have equal samples with the probability of their
generalised Jaccard similarity, the sum of the lesser over the sum of the greater weights. A sample is kept as
a 16-bit hash, so unequal ones look equal with probability 2**-16; the fingerprint is their hexadecimal digits.

Each document is also compared with the next by descending id, and with an edited text of its own, whose last
third is replaced by the beginning of the next document (after the last one comes the first).

Ids are ordered in ranges without their texts; the neighbours of a range's ends come from one row for each range.
Texts are shuffled once, by document, and of each one the beginning that its neighbour needs. Weighted terms and
samples are aggregated where a document lies, so no term is shuffled. A document's samples are minima of
64-bit numbers (a in the upper, the sample in the lower bits), aggregated in blocks of ``LANES`` columns. A term that both
texts hold as often is drawn for once.

Defined cases: null texts are empty; the empty text has one empty phrase; rows with a null id come after all
others, in the order of their texts' hashes; so do different texts of one id among themselves; repeated rows (equal id and
text) follow each other and are each returned; with one row in all it is its own next; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopelens.llm.tables import stored

#: Samples of a fingerprint, and columns aggregated together.
SAMPLES, LANES = 64, 4
#: What a phrase ends in before a blank: some letters that end a third of all words in many languages, and marks.
ENDS = ("e", "o", "i", ".", "!", "?", "。")
#: Repeated rows that are given back from one row at most.
TOGETHER = 10_000
_BITS = 16
_MASK = (1 << _BITS) - 1


# --- samples ---------------------------------------------------------------------------------


def phrases(text: Column, ends: Sequence[str] = ENDS) -> Column:
    """The phrases of a text, in order; an empty text has one empty phrase."""
    for end in ends:
        text = F.replace(text, F.lit(f"{end} "), F.lit(f"{end}\n"))
    return F.split(text, "\n")  # a single character, so no regular expression is at work


def _uniform(bits: Column, shift: int, width: int) -> Column:
    part = F.shiftrightunsigned(bits, shift) if shift else bits
    part = part if shift + width == 64 else part.bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + 0.5) * F.lit(2.0**-width)


def packed_sample(term: Column, sample: Column, log_weight: Column) -> Column:
    """ln a of a term in the upper bits, the sample it stands for in the lower ones."""
    bits = F.xxhash64(term, sample)
    log_c = F.log(-F.log(_uniform(bits, 46, 18) * _uniform(bits, 28, 18)))
    r = -F.log(_uniform(bits, 19, 9) * _uniform(bits, 10, 9))
    b = _uniform(bits, 0, 10)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t.cast("double") - b + 1.0)
    # |ln a| is below 64: 2**47 steps
    above = F.shiftleft(F.floor((log_a + 64.0) * F.lit(2.0**40)), _BITS)
    # all bits of the hash count, so that equal samples of unlike terms are as rare as chance has it
    folded = bits.bitwiseXOR(F.shiftrightunsigned(bits, 32))
    folded = folded.bitwiseXOR(F.shiftrightunsigned(folded, 16)).bitwiseXOR(t)
    return above.bitwiseOR(folded.bitwiseAND(F.lit(_MASK)))


def _lanes(names: list[str]) -> list[Column]:
    """The samples of some columns, four in a long."""
    samples = [F.col(name).bitwiseAND(F.lit(_MASK)) for name in names]
    return [
        reduce(Column.bitwiseOR, [F.shiftleft(x, _BITS * (3 - k)) for k, x in enumerate(samples[at : at + 4])]) for at in range(0, len(samples), 4)
    ]


def _either(first: list[Column], own: list[Column]) -> Column:
    """The rows of one or two texts' weights."""
    if len(own) == 1:
        return F.array(own[0])
    return F.when(first[0] & first[1], F.array(*own)).when(first[0], F.array(own[0])).otherwise(F.array(own[1]))


def sampled(texts: DataFrame, key: list[str], columns: list[str], *, ends: Sequence[str] = ENDS, samples: int = SAMPLES) -> DataFrame:
    """The samples of one or two text columns as arrays of long, four samples in each, by ``key``.

    Rows with equal keys lie in one partition already if the key begins with what they were dealt out by.
    """
    which = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.col(name).alias("text")) for k, name in enumerate(columns)])).alias("one")
    names = range(len(columns))
    each = texts.select(*key, which).select(*key, "one.which", F.explode(phrases(F.col("one.text"), ends)).alias("phrase"))
    each = each.select(*key, "which", F.xxhash64("phrase").alias("term"), (F.char_length("phrase") + 1).alias("size"))
    weights = each.groupBy(*key, "term").agg(*[F.sum(F.when(F.col("which") == k, F.col("size")).otherwise(0)).alias(f"w{k}") for k in names])
    # a row for each weight of a term, with 0 for the texts that hold it so often and null for others
    own = [F.struct(F.col(f"w{k}").alias("weight"), *[F.when(F.col(f"w{j}") == F.col(f"w{k}"), F.lit(0).cast("long")).alias(f"in{j}") for j in names]) for k in names]
    first = [reduce(Column.__and__, [F.col(f"w{j}") != F.col(f"w{k}") for j in range(k)], F.col(f"w{k}") > 0) for k in names]
    drawn = F.explode(_either(first, own))
    rows = weights.select(*key, "term", drawn.alias("one")).select(*key, "term", F.log("one.weight").alias("log_weight"), *[f"one.in{k}" for k in names])
    blocks = F.explode(F.array(*[F.lit(k) for k in range(samples // LANES)])).alias("block")
    least = (
        rows.select(*key, "term", "log_weight", *[f"in{k}" for k in names], blocks)
        .groupBy(*key, "block")
        .agg(
            *[
                F.min(packed_sample(F.col("term"), F.col("block") * LANES + lane, F.col("log_weight")).bitwiseOR(F.col(f"in{k}"))).alias(f"s{k}_{lane}")
                for lane in range(LANES)
                for k in names
            ]
        )
    )
    lanes = [F.array(*_lanes([f"s{k}_{lane}" for lane in range(LANES)])).alias(name) for k, name in enumerate(columns)]
    ordered = least.select(*key, F.struct("block", *lanes).alias("part")).groupBy(*key).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return ordered.select(*key, *[F.flatten(f"parts.{name}").alias(name) for name in columns])


def likeness(one: str, other: str, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two arrays made by ``sampled``."""

    def equal(bits: Column) -> Column:
        lanes = [F.when(F.shiftright(bits, _BITS * k).bitwiseAND(F.lit(_MASK)) == 0, 1).otherwise(0) for k in range(4)]
        return reduce(Column.__add__, lanes)

    differing = F.zip_with(one, other, lambda x, y: x.bitwiseXOR(y))
    return F.aggregate(differing, F.lit(0), lambda total, bits: total + equal(bits)) / float(samples)


def spelled(name: str) -> Column:
    """A fingerprint: the hexadecimal digits of an array made by ``sampled``."""
    return F.array_join(F.transform(name, lambda x: F.lpad(F.hex(x), 16, "0")), "")


# --- neighbours ------------------------------------------------------------------------------


def neighbours(classes: DataFrame) -> DataFrame:
    """Classes (id, none, hash, copies, n_chars) with the next one's id and hash, and the one's before with its n_chars.

    The order is none, descending id, hash; after the last comes the first.
    """
    count = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), classes.sparkSession.sparkContext.defaultParallelism)
    order = [F.asc("none"), F.desc("id"), F.asc("hash")]
    ranged = stored(classes.repartitionByRange(count, *order).withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range").orderBy(*order)
    own = F.struct("id", "hash", "n_chars")
    placed = stored(ranged.withColumns({"next": F.lead(own).over(within), "before": F.lag(own).over(within)}))
    # one row for each range
    firsts = placed.where("before is null").select("range", own.alias("own")).orderBy("range").collect()
    lasts = placed.where("next is null").select("range", own.alias("own")).orderBy("range").collect()
    edges = [
        (row["range"], tuple(firsts[(k + 1) % len(firsts)]["own"]), tuple(lasts[k - 1]["own"])) for k, row in enumerate(firsts)
    ]
    kind = "struct<id: long, hash: long, n_chars: long>"
    beside = placed.sparkSession.createDataFrame(edges, f"range int, first {kind}, last {kind}")
    found = placed.join(F.broadcast(beside), "range").withColumns({"next": F.coalesce("next", "first"), "before": F.coalesce("before", "last")})
    return found.select(
        *classes.columns,
        *[F.col(f"next.{name}").alias(f"next_{name}") for name in ("id", "hash")],
        *[F.col(f"before.{name}").alias(f"before_{name}") for name in ("id", "hash", "n_chars")],
    )


def fingerprints(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ends: Sequence[str] = ENDS, samples: int = SAMPLES) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    id_ = F.col(doc_id).cast("long")
    rows = documents.select(F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().alias("none"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text", "none"))
    classes = rows.groupBy("id", "none", "hash").agg(F.count("*").alias("copies"), F.max(F.char_length("text").cast("long")).alias("n_chars"))
    known = stored(neighbours(classes))

    texts = rows.dropDuplicates(["id", "hash"]).select("id", "hash", "text")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    placed = texts.join(known.select("id", "hash", "copies", "n_chars", "before_id", "before_hash", "before_n_chars"), ["id", "hash"])
    heads = placed.select(
        F.col("before_id").alias("id"), F.col("before_hash").alias("hash"), F.substring("text", F.lit(1), F.floor(F.col("before_n_chars") / 3).cast("int")).alias("head")
    )
    # all copies of a row but the last are followed by the same text
    inner = F.struct(F.lit(True).alias("inner"), F.substring("text", F.lit(1), third).alias("head"))
    last = F.struct(F.lit(False).alias("inner"), F.col("head").alias("head"))
    turn = F.when(F.col("copies") > 1, F.array(last, inner)).otherwise(F.array(last))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.col("turn.head"))
    both = placed.join(heads, ["id", "hash"]).withColumn("turn", F.explode(turn)).select("id", "hash", "turn.inner", "text", edited.alias("edited"))
    both = both.withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    made = stored(sampled(both, ["id", "hash", "inner", "sha"], ["text", "edited"], ends=ends, samples=samples))

    out = made.join(known.select("id", "hash", "none", "copies", "n_chars", "next_id", "next_hash"), ["id", "hash"]).withColumns(
        {
            "next_id": F.when(F.col("inner"), F.col("id")).otherwise(F.col("next_id")),
            "next_hash": F.when(F.col("inner"), F.col("hash")).otherwise(F.col("next_hash")),
            "times": F.when(F.col("inner"), F.col("copies") - 1).otherwise(F.lit(1)),
        }
    )
    next_ = made.where("not inner").select(F.col("id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("text").alias("next_text"))
    out = out.join(next_, ["next_id", "next_hash"])
    out = out.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / TOGETHER))))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(TOGETHER), F.col("times") - F.col("part") * TOGETHER))))
    return out.select(
        F.when(~F.col("none"), F.col("id")).alias(doc_id),
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        spelled("text").alias("fingerprint"),
        spelled("edited").alias("edited_fingerprint"),
        likeness("text", "edited", samples).alias("near_edited"),
        likeness("text", "next_text", samples).alias("near_next"),
    )
