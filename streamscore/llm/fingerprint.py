"""Document fingerprints by consistent weighted sampling.

A text is a bag of words weighted by their counts. For each of `SAMPLES` draws and
each word, r and c are Gamma(2, 1) and beta is uniform, all from hashes of the word
and the draw; with t = floor(ln(weight) / r + beta) the word that minimizes
ln(c) - r * (t + 1 - beta) is drawn together with its t. Two texts draw the same with a
probability equal to their generalized Jaccard similarity, the sum of the smaller
counts over the sum of the larger ones.

Documents are grouped by 1,024 neighbouring ids once; following each document's
successor, counting its words and drawing all happen within those groups, so texts
are shuffled a single time. Everything is a column expression or an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamscore.llm.words import text_of, words_of
from streamscore.sources.storage import stored

SAMPLES = 24
GROUP_BITS = 10
LEVELS = 4
SEED = 11
UNIT = float(1 << 24)


def _uniform(bits: Column, shift: int) -> Column:
    """A number in (0, 1) from 24 bits of a hash."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND((1 << 24) - 1) + 0.5) / UNIT


def _variables() -> dict[str, Column]:
    """r, ln(c) and beta of a word and draw from 128 bits of hashes."""
    gamma = lambda h: -F.log(_uniform(F.col(h), 0) * _uniform(F.col(h), 24))
    high = F.shiftleft(F.shiftrightunsigned("h1", 48), 16)
    beta = (high.bitwiseOR(F.shiftrightunsigned("h2", 48)) + 0.5) / float(1 << 32)
    return {"r": gamma("h1"), "ln_c": F.log(gamma("h2")), "beta": beta}


def _drawn(weight: str) -> Column:
    """The value that the drawn word makes smallest, as a number that also names word and t.

    ln(c) - r * (t + 1 - beta) lies between -96 and 32; in steps of 2 ** -33 it fills the
    upper bits, and 23 bits of the word's hash and t fill the rest.
    """
    t = F.floor(F.log(F.col(weight).cast("double")) / F.col("r") + F.col("beta"))
    value = F.col("ln_c") - F.col("r") * (t + 1 - F.col("beta"))
    name = F.col("h2").bitwiseXOR(t.cast("long")).bitwiseAND((1 << 23) - 1)
    packed = F.shiftleft(F.floor((value + 96) * float(1 << 33)).cast("long"), 23).bitwiseOR(name)
    return F.when(F.col(weight) > 0, packed)


def successors(keys: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(key, next) for distinct whole numbers `key`, the largest followed by the smallest.

    Each level looks for the successor within 1,024 neighbouring numbers and asks the
    next level for the group that follows, so no task sorts all keys.
    """
    if levels == 0:
        order = Window.orderBy("key")
        first = F.min("key").over(Window.partitionBy())
        return keys.select("key", F.coalesce(F.lead("key").over(order), first).alias("next"))
    grouped = keys.withColumn("up", F.shiftright("key", GROUP_BITS))
    within = F.lead("key").over(Window.partitionBy("up").orderBy("key"))
    grouped = grouped.withColumn("within", within)
    firsts = grouped.groupBy("up").agg(F.min("key").alias("first"))
    following = successors(firsts.select(F.col("up").alias("key")), levels - 1)
    heads = following.join(firsts, following["next"] == firsts["up"]).select(
        following["key"].alias("up"), "first"
    )
    return grouped.join(heads, "up").select("key", F.coalesce("within", "first").alias("next"))


def _ordered(docs: DataFrame) -> DataFrame:
    """Documents with their group and place, and the text that follows within the group."""
    nulls = F.lit(1 << 60) + F.xxhash64(text_of()).bitwiseAND(1023)
    group = F.coalesce(F.shiftright("doc_id", GROUP_BITS), nulls)
    rows = docs.select("doc_id", text_of().alias("text"), group.alias("grp"))
    order = Window.partitionBy("grp").orderBy("doc_id", "text")
    return rows.withColumns(
        {"place": F.row_number().over(order).cast("long"), "after": F.lead("text").over(order)}
    )


def next_texts(docs: DataFrame) -> DataFrame:
    """grp, place, doc_id, text and `after`, the text of the next document.

    The order is that of doc_id and then of the text, null ids last; the last
    document is followed by the first. A single document is followed by itself.
    """
    rows = _ordered(docs)
    heads = rows.filter("place = 1").select("grp", F.col("text").alias("head"))
    heads = stored(heads, "fingerprint-heads")
    following = successors(heads.select(F.col("grp").alias("key")))
    follow = following.join(heads, following["next"] == heads["grp"]).select(
        following["key"].alias("grp"), "head"
    )
    follow = stored(follow, "fingerprint-follow")
    return rows.join(follow, "grp").withColumn("after", F.coalesce("after", "head")).drop("head")


def _samples(texts: DataFrame, samples: int) -> DataFrame:
    """Per grp and place: the draws of `text` and of `edited`, null where it has no words."""
    sides = F.explode(
        F.array(*[
            F.struct(F.lit(k).alias("side"), words_of(F.col(c)).alias("words"))
            for k, c in enumerate(("text", "edited"))
        ])
    )
    words = texts.select("grp", "place", sides.alias("x")).select(
        "grp", "place", "x.side", F.explode("x.words").alias("word")
    )
    words = words.select("grp", "place", F.xxhash64("word").alias("term"), "side")
    counts = words.groupBy("grp", "place", "term").agg(
        F.sum(1 - F.col("side")).alias("n0"), F.sum("side").alias("n1")
    )
    draws = counts.select(
        "*", F.explode(F.array(*[F.lit(k) for k in range(samples)])).alias("draw")
    )
    hashed = draws.withColumns(
        {"h1": F.xxhash64("term", "draw"), "h2": F.xxhash64("draw", "term", F.lit(SEED))}
    )
    hashed = hashed.withColumns(_variables())
    low = (1 << 32) - 1
    drawn = hashed.groupBy("grp", "place", "draw").agg(
        F.min(_drawn("n0")).alias("s0"), F.min(_drawn("n1")).alias("s1")
    )
    pairs = F.array_sort(
        F.collect_list(
            F.struct("draw", F.col("s0").bitwiseAND(low).alias("s0"), F.col("s1").bitwiseAND(low).alias("s1"))
        )
    )
    return drawn.groupBy("grp", "place").agg(pairs.alias("drawn"))


def _likeness(a: str, b: str, samples: int) -> Column:
    """Share of equal draws; two empty fingerprints are equal, one is unlike any other."""
    equal = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    count = F.aggregate(equal, F.lit(0), lambda total, x: total + x) / float(samples)
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    return F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b, 0.0).otherwise(count)


def _text(drawn: str) -> Column:
    return F.array_join(F.transform(drawn, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprints, likenesses.

    The edited text has its last floor(n_chars / 4) characters replaced by the first
    as many (or all) of the next document. Null texts are empty. Texts without words
    have an empty fingerprint, which equals only another empty one. Equal texts have
    equal fingerprints. Order and repeated rows: see next_texts. An empty table gives
    an empty result. Only doc_id and text are read.
    """
    rows = next_texts(docs)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("after", F.lit(1), cut))
    rows = rows.withColumns({"edited": edited, "n_chars": n.cast("long")})
    drawn = _samples(rows, samples)
    facts = rows.select("grp", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    side = lambda k: F.coalesce(
        F.filter(F.transform("drawn", lambda x: x[f"s{k}"]), lambda x: x.isNotNull()),
        F.array().cast("array<bigint>"),
    )
    both = facts.join(drawn, ["grp", "place"], "left")
    both = stored(both.select(facts.columns + [side(0).alias("f0"), side(1).alias("f1")]), "fingerprints")

    order = Window.partitionBy("grp").orderBy("place")
    both = both.withColumn("after", F.lead("f0").over(order))
    heads = both.filter("place = 1").select("grp", F.col("f0").alias("head"))
    following = successors(heads.select(F.col("grp").alias("key")))
    follow = following.join(heads, following["next"] == heads["grp"]).select(
        following["key"].alias("grp"), "head"
    )
    both = both.join(follow, "grp").withColumn("after", F.coalesce("after", "head"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _text("f0").alias("fingerprint"),
        _text("f1").alias("edited_fingerprint"),
        _likeness("f0", "f1", samples).alias("near_edited"),
        _likeness("f0", "after", samples).alias("near_next"),
    )
