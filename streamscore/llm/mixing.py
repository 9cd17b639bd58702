"""Mixing sources to target weights by weighted sampling without replacement.

A source's target is its share of all words, capped at `max_epochs` times its own
size; what the caps leave over goes to the other sources by weight. A target is met
by whole passes over the source (epochs) first. The rest is drawn by Efraimidis and
Spirakis: every document gets the key -ln(u) / w with u from a hash of the document
and w its quality weight, documents are taken in the order of their keys, and the
one that crosses the budget gives only its first words.

Prefix sums run over key digits. A first digit splits every source into a few
thousand classes whose totals are aggregated; only the class in which the budget ends
is split again by a second digit, and only the class found there is sorted. So no
task holds more than a tiny share of a source, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamscore.llm.words import WORD, text_of, words_of
from streamscore.sources.storage import stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 20240131
# Keys are compared as ln(key) in steps of 2 ** -50. On this scale keys have the same
# spread for every weight: no first digit (steps of 1 / 512) gets over 0.1% of them.
SCALE_BITS = 50
FIRST_BITS = 9
DIGIT = 12


def symbol_weight(text: Column) -> Column:
    """Quality weight: one minus the share of symbols, at least 0.05."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(1 - symbols / F.greatest(n, F.lit(1)), F.lit(0.05))


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, share: float = 1.0
) -> DataFrame:
    """Targets of sources: `sizes` has source and source_size, one row per source.

    Weights repeat over the sources in code point order, null last. A source is
    full at max_epochs * size. Sources fill up in the order of that limit per
    weight; what is left over the weights that are left is the level common to all
    that never fill up.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    turn = ((F.row_number().over(order) - 1) % len(weights)).cast("int")
    df = sizes.withColumn("weight", F.get(cycle, turn))
    df = df.withColumn("limit", F.lit(float(max_epochs)) * F.col("source_size"))
    filling = Window.orderBy(
        (F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()
    )
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(
        F.sum("limit").over(before), F.lit(0.0)
    )
    weight_left = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0.0)
    )
    df = df.withColumn("level", left / weight_left)
    # The level rises while sources fill up and falls behind the first that does not.
    df = df.withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("limit"), F.col("level") * F.col("weight"))
    return df.select("source", "source_size", target.alias("target"))


def _upto(rows: DataFrame, keys: list[str], digit: str) -> DataFrame:
    """Per source and digit: words in all smaller digits."""
    totals = rows.groupBy(*keys, digit).agg(F.sum("size").alias("in_class"))
    before = F.sum("in_class").over(Window.partitionBy(*keys).orderBy(digit)) - F.col("in_class")
    return totals.withColumn("before", before)


def draw(rows: DataFrame) -> DataFrame:
    """Adds `part`: the words taken in the fractional pass.

    `rows` has id, sid (source number), size, key (non-negative long) and budget
    (whole words, the same for all rows of a source).
    """
    high = SCALE_BITS - FIRST_BITS
    low = high - DIGIT
    rows = rows.withColumns(
        {
            "d1": F.shiftright("key", high),
            "d2": F.shiftright("key", low).bitwiseAND((1 << DIGIT) - 1),
        }
    )
    first = _upto(rows, ["sid", "budget"], "d1")
    edge = first.filter(
        (F.col("before") <= F.col("budget"))
        & (F.col("before") + F.col("in_class") > F.col("budget"))
    ).select("sid", F.col("d1").alias("edge1"), F.col("before").alias("before1"))
    rows = rows.join(edge, "sid", "left")
    at1 = F.col("d1") == F.col("edge1")
    second = _upto(rows.filter(at1), ["sid", "budget", "before1"], "d2")
    end = F.col("before1") + F.col("before")
    edge = second.filter(
        (end <= F.col("budget")) & (end + F.col("in_class") > F.col("budget"))
    ).select("sid", F.col("d2").alias("edge2"), end.alias("before2"))
    rows = rows.join(edge, "sid", "left")
    at2 = at1 & (F.col("d2") == F.col("edge2"))
    order = Window.partitionBy("sid").orderBy("key", "id", "size")
    last = rows.filter(at2).withColumn(
        "upto", F.col("before2") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    room = F.col("budget") - F.coalesce("upto", "before2")
    last = last.withColumn("part", F.greatest(F.least("size", room), F.lit(0).cast("long")))
    # A source without an edge has a budget at or above its whole size, or no words.
    below = (
        F.col("edge1").isNull()
        | (F.col("d1") < F.col("edge1"))
        | (at1 & (F.col("d2") < F.col("edge2")))
    )
    rest = rows.filter(~F.coalesce(at2, F.lit(False)))
    rest = rest.withColumn("part", F.when(below, F.col("size")).otherwise(F.lit(0).cast("long")))
    return rest.drop("d1", "d2", "edge1", "before1", "edge2", "before2").unionByName(
        last.drop("d1", "d2", "edge1", "before1", "edge2", "before2", "upto")
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
    share: float = 1.0,
    seed: int = SEED,
    quality=symbol_weight,
) -> DataFrame:
    """One row per row of `docs`: its keys, size, source_size, target, epochs, part, taken.

    `size` counts words (0 for null texts), `epochs` whole passes, `part` the words
    of the fractional pass; taken = epochs * size + part. Documents without words
    take nothing. A source without words has target 0. Null sources form one source,
    null ids are allowed, rows that repeat id and text share one key and are taken
    one after the other. The same rows give the same mix, in any order. An empty
    table gives an empty result. Only doc_id, text and source are read.
    """
    body = text_of()
    u = (
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", body), 11).cast("double") + 0.5
    ) / float(1 << 53)
    place = F.log(-F.log(u)) - F.log(quality(body))
    rows = docs.select(
        F.col("doc_id").alias("id"),
        "source",
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        F.floor((place + 64) * float(1 << SCALE_BITS)).cast("long").alias("key"),
        F.xxhash64(body).alias("text_hash"),
    )
    rows = stored(rows, "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs, share)
    passes = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    targets = targets.withColumns({"epochs": passes.cast("long"), "sid": number})
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    targets = stored(targets.withColumn("budget", rest), "mix-targets")
    known = F.col("s.source").eqNullSafe(F.col("t.source"))
    joined = rows.alias("s").join(targets.alias("t"), known).select("s.*", *[
        f"t.{c}" for c in ("source_size", "target", "epochs", "sid", "budget")
    ])
    drawn = draw(joined)
    return drawn.select(
        F.col("id").alias("doc_id"),
        "text_hash",
        "source",
        "size",
        "source_size",
        "target",
        "epochs",
        "part",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each as often as it is taken as a whole.

    The one document of a source that the budget cuts comes once more with its first
    words only, joined by spaces, and n_chars, if there is such a column, to match.
    Rows that share doc_id, source and text come as often as all of them are taken,
    with the other columns of one of them. Columns stay as they are.
    """
    taken = mix(docs, **options).withColumn("is_whole", F.col("part") == F.col("size"))
    copies = F.col("epochs") + F.when((F.col("size") > 0) & F.col("is_whole"), 1).otherwise(0)
    cut = F.when(~F.col("is_whole"), F.col("part")).otherwise(0)
    keys = ["doc_id", "text_hash", "source"]
    taken = taken.groupBy(*keys).agg(F.sum(copies).alias("copies"), F.max(cut).alias("cut"))
    taken = stored(taken.filter("copies > 0 or cut > 0"), "mix-taken")

    text_hash = F.xxhash64(text_of())
    row = docs.select("doc_id", "source", text_hash.alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same_key = Window.partitionBy("doc_id", "text_hash", "source")
    first = F.row_number().over(same_key.orderBy(*[f"row.{c}" for c in ("lang", "n_chars") if c in docs.columns] or [F.lit(0)]))
    one = row.withColumn("turn", first).filter("turn = 1")
    match = (
        F.col("d.doc_id").eqNullSafe(F.col("t.doc_id"))
        & F.col("d.source").eqNullSafe(F.col("t.source"))
        & (F.col("d.text_hash") == F.col("t.text_hash"))
    )
    both = one.alias("d").join(taken.alias("t"), match).select("row", "copies", "cut")
    times = F.concat(
        F.array_repeat(F.lit(0).cast("long"), F.col("copies").cast("int")),
        F.when(F.col("cut") > 0, F.array("cut")).otherwise(F.array().cast("array<bigint>")),
    )
    rows = both.select("row", F.explode(times).alias("upto"))
    words = F.slice(words_of(F.col("row.text")), 1, F.greatest(F.col("upto"), F.lit(1)).cast("int"))
    text = F.when(F.col("upto") > 0, F.array_join(words, " ")).otherwise(F.col("row.text"))
    out = rows.select("row", "upto", text.alias("new_text"))
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == "text":
            value = F.col("new_text")
        elif c == "n_chars":
            value = F.when(F.col("upto") > 0, F.char_length("new_text").cast("long")).otherwise(value)
        columns.append(value.alias(c))
    return out.select(*columns)
