"""Quality rules: robust multivariate outliers per language and source.

Every document gets base counts and a vector of four transformed shares. Its share of
symbols leaves out those that stand alone as words, which are layout (bullets, headings,
bars of tables); n_symbols counts them all, and the mean word length counts such words,
so that texts made of little else stand out. Per
language and source the minimum covariance determinant (MCD) is sought from several
starts: the medians, and `STARTS` draws of five different vectors. A concentration
step takes the distances from a centre and covariance and then centre and covariance
of the `SUPPORT` share of documents that lie nearest. All starts take `TRIAL_STEPS`
steps; the `FINALISTS` with the smallest determinants go on until theirs falls no
more, and the smallest wins. Its centre and covariance are then those of all documents
within the 0.975 quantile, and a document whose squared Mahalanobis distance exceeds
`cutoff` is rejected. All steps are column expressions and aggregates.

What a step gathers from a group of any size and start is a table of at most a few
hundred distance classes with counts and sums, aggregated before the shuffle. Values
are whole 1/256 steps and their sums are whole numbers, so results do not depend on
the order of rows. Equal vectors are counted once for all steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamscore.llm.words import SPACE, text_of, words_of
from streamscore.sources.storage import stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
SUPPORT = 0.75
STARTS = 8
TRIAL_STEPS = 2
FINALISTS = 2
# A determinant falls if its logarithm does by more than this.
FALL = 1e-4
# 0.999 quantile of the chi-squared distribution with four degrees of freedom.
CUTOFF = 18.47
# Makes the covariance of the nearest 75% consistent for normal data in four
# dimensions: 0.75 / P(chi2_6 <= quantile_0.75(chi2_4)).
CONSISTENCY = 1.485
# 0.975 quantile, and the factor that makes the covariance of what lies within consistent.
INNER = 11.143
INNER_CONSISTENCY = 1.0645
# Smallest standard deviation of each statistic: smaller spreads are no evidence.
FLOORS = {"x_length": 0.08, "x_symbols": 0.25, "x_lines": 0.25, "x_repeats": 0.25}
STATS = list(FLOORS)
GRID = 256
PAIRS = [(a, b) for i, a in enumerate(STATS) for b in STATS[: i + 1]]
# Vectors per draw: one more than there are statistics.
DRAWN = len(STATS) + 1


def _windows(words: Column, m: Column) -> Column:
    """The `m` windows of three words with their positions, sorted by their words."""
    join = lambda a, b: F.concat(a, F.lit(" "), b)
    pairs = F.zip_with(F.slice(words, 1, m), F.slice(words, 2, m), join)
    windows = F.zip_with(pairs, F.slice(words, 3, m), join)
    return F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))


def _covered(starts: Column) -> Column:
    """Length of the union of three-word windows that start at the sorted `starts`."""
    gaps = F.zip_with(
        starts,
        F.slice(starts, 2, F.size(starts)),
        lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)),
    )
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Besides, n_lines and n_lone_symbols, the words that are a single symbol. Null texts have no words. Lines end at \\n; a line counts as a copy if it has
    a word and equals an earlier line of the document.
    """
    body = text_of(text)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"_words": words_of(body), "_lines": lines})
    df = df.withColumn("_m", F.greatest(F.size("_words") - 2, F.lit(0)))
    df = df.withColumn("_placed", _windows(F.col("_words"), F.col("_m")))
    same = F.zip_with(
        F.slice("_placed", 1, F.greatest(F.col("_m") - 1, F.lit(0))),
        F.slice("_placed", 2, F.greatest(F.col("_m") - 1, F.lit(0))),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    df = df.withColumn("_starts", starts)
    n_words = F.size("_words").cast("long")
    lone = F.size(F.filter("_words", lambda w: (F.length(w) == 1) & F.lit(SYMBOLS).contains(w)))
    repeats = _covered(F.col("_starts")).cast("long")
    return df.withColumns(
        {
            "n_words": n_words,
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "n_lone_symbols": lone.cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeats,
            "base_failed": (n_words < MIN_WORDS) | (100 * repeats > 50 * n_words),
        }
    ).drop("_words", "_lines", "_placed", "_m", "_starts")


def _vector() -> dict[str, Column]:
    share = lambda a, b: (F.col(a) if isinstance(a, str) else a) / F.greatest(F.col(b), F.lit(1))
    noise = F.col("n_symbols") - F.col("n_lone_symbols")
    values = {
        "x_length": F.log(F.greatest(share("word_chars", "n_words"), F.lit(0.5))),
        "x_symbols": F.log1p(20 * share(noise, "word_chars")),
        "x_lines": F.asin(F.sqrt(F.least(share("n_dup_lines", "n_lines"), F.lit(1.0)))),
        "x_repeats": F.asin(F.sqrt(F.least(share("n_repeat_words", "n_words"), F.lit(1.0)))),
    }
    return {k: F.round(v * GRID).cast("long") for k, v in values.items()}


def _medians(cells: DataFrame) -> DataFrame:
    """Start 0 of every group: medians as centre, interquartile ranges as a diagonal scale."""
    values = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("v")) for s in STATS]))
    counts = cells.select("grp", "n", values.alias("x")).groupBy("grp", "x.stat", "x.v").agg(
        F.sum("n").alias("count")
    )
    group = Window.partitionBy("grp", "stat")
    counts = counts.withColumns(
        {"upto": F.sum("count").over(group.orderBy("v")), "n": F.sum("count").over(group)}
    )
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("v")))
    quartiles = counts.groupBy("grp", "stat").agg(
        at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high")
    )
    pick = lambda s, x: F.max(F.when(F.col("stat") == s, x))
    sd = (F.col("high") - F.col("low")) / 1.349 / GRID
    columns = [pick(s, F.col("mid") / GRID).alias(f"m_{s}") for s in STATS]
    for a, b in PAIRS:
        spread = pick(a, sd * sd) if a == b else F.lit(0.0)
        columns.append(F.coalesce(spread, F.lit(0.0)).alias(f"c_{a}_{b}"))
    return _factor(quartiles.groupBy("grp", F.lit(0).cast("long").alias("start")).agg(*columns))


def _draws(cells: DataFrame, starts: int) -> DataFrame:
    """Starts 1 and up: moments of the different vectors with the smallest hashes, one per draw."""
    lot = lambda draw: F.xxhash64(draw, *STATS)
    draws = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(starts * DRAWN - 1).cast("long")))
    least = cells.select("grp", *STATS, draws.alias("draw")).groupBy("grp", "draw").agg(
        F.min(lot(F.col("draw"))).alias("lot")
    )
    least = least.groupBy("grp").agg(F.collect_list(F.struct("draw", "lot")).alias("least"))
    mine = F.filter("least", lambda x: x["lot"] == lot(x["draw"]))
    drawn = cells.join(least, "grp").select("grp", *STATS, F.explode(mine).alias("x"))
    start = (F.floor(F.col("x.draw") / DRAWN) + 1).cast("long").alias("start")
    sums = drawn.select("grp", *STATS, start, F.lit(1).alias("n")).groupBy("grp", "start")
    return _estimates(sums.agg(*_sums()), 1.0)


def _sums() -> list[Column]:
    """Counts, sums and sums of products of vectors that stand for `n` documents each."""
    n = F.col("n")
    sums = [F.sum(n * F.col(s)).alias(f"s_{s}") for s in STATS]
    sums += [F.sum(n * F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in PAIRS]
    return [F.sum(n).alias("n"), *sums]


def _estimates(sums: DataFrame, factor: float) -> DataFrame:
    """Centre and factored covariance, scaled by `factor`, per group and start."""
    n = F.col("n")
    mean = {s: F.col(f"s_{s}") / n / GRID for s in STATS}
    columns = [mean[s].alias(f"m_{s}") for s in STATS]
    for a, b in PAIRS:
        product = F.col(f"p_{a}_{b}") / n / (GRID * GRID)
        columns.append((factor * (product - mean[a] * mean[b])).alias(f"c_{a}_{b}"))
    return _factor(sums.select("grp", "start", *columns))


def _factor(estimates: DataFrame) -> DataFrame:
    """The Cholesky factor of the covariance, its diagonal raised by the floors, and `log_det`."""
    df = estimates
    for i, a in enumerate(STATS):
        for j, b in enumerate(STATS[: i + 1]):
            known = [F.col(f"l_{a}_{STATS[k]}") * F.col(f"l_{b}_{STATS[k]}") for k in range(j)]
            rest = F.col(f"c_{a}_{b}") - sum(known, F.lit(0.0))
            if a == b:
                # Adding the floor to the diagonal keeps every pivot above its square.
                value = F.sqrt(F.greatest(rest + FLOORS[a] ** 2, F.lit(FLOORS[a] ** 2)))
            else:
                value = rest / F.col(f"l_{b}_{b}")
            df = df.withColumn(f"l_{a}_{b}", value)
    log_det = 2 * sum((F.log(f"l_{s}_{s}") for s in STATS[1:]), F.log(f"l_{STATS[0]}_{STATS[0]}"))
    known = [*[f"m_{s}" for s in STATS], *[f"l_{a}_{b}" for a, b in PAIRS]]
    return df.select("grp", "start", *known, log_det.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    solved: list[Column] = []
    for i, a in enumerate(STATS):
        rest = F.col(a) / GRID - F.col(f"m_{a}")
        for j, b in enumerate(STATS[:i]):
            rest = rest - F.col(f"l_{a}_{b}") * solved[j]
        solved.append(rest / F.col(f"l_{a}_{a}"))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])


def _step(cells: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step of every start; distances are ranked in classes 3% wide."""
    near = F.floor(32 * F.log1p(_distance())).alias("near")
    classes = cells.join(estimates, "grp").select("grp", "start", near, "n", *STATS)
    classes = classes.groupBy("grp", "start", "near").agg(*_sums())
    group = Window.partitionBy("grp", "start")
    before = F.sum("n").over(group.orderBy("near")) - F.col("n")
    classes = classes.withColumns({"before": before, "of": F.sum("n").over(group)})
    nearest = classes.filter(F.col("before") < SUPPORT * F.col("of"))
    total = [F.sum(c).alias(c) for c in classes.columns if c == "n" or c[:2] in ("s_", "p_")]
    return _estimates(nearest.groupBy("grp", "start").agg(*total), CONSISTENCY)


def _smallest(estimates: DataFrame, many: int) -> DataFrame:
    """Per group the `many` different estimates with the smallest determinants."""
    known = [c for c in estimates.columns if c != "start"]
    different = estimates.groupBy(known).agg(F.min("start").alias("start"))
    order = Window.partitionBy("grp").orderBy("log_det", "start")
    ranked = different.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= many).select(estimates.columns)


def minimum_determinants(cells: DataFrame, starts: int = STARTS, folder: str = "quality") -> DataFrame:
    """One estimate per value of `grp`: the smallest determinant that any start comes to.

    `cells` has grp, the columns of `STATS` as whole steps and n, how many documents share
    them. A group with a single vector gets that vector and the floors; an empty table
    gives an empty one.
    """
    estimates = _medians(cells)
    if starts:
        estimates = estimates.unionByName(_draws(cells, starts))
    estimates = stored(estimates, f"{folder}-starts")
    for k in range(TRIAL_STEPS):
        estimates = stored(_step(cells, estimates), f"{folder}-trial{k}")
    falling = stored(_smallest(estimates, FINALISTS), f"{folder}-finalists")
    seen, step = falling, 0
    # Every turn lowers determinants that the floors keep above zero, so it ends.
    while not falling.isEmpty():
        after = stored(_step(cells, falling), f"{folder}-step{step}")
        was = falling.select("grp", "start", F.col("log_det").alias("was"))
        lower = after.join(was, ["grp", "start"]).filter(F.col("log_det") < F.col("was") - FALL)
        falling = stored(lower.drop("was"), f"{folder}-falling{step}")
        seen, step = seen.unionByName(after), step + 1
    return stored(_smallest(seen, 1), f"{folder}-smallest")


def mcd_verdicts(
    statistics: DataFrame, cutoff: float = CUTOFF, starts: int = STARTS, folder: str = "quality"
) -> DataFrame:
    """Adds `distance` and `kept` to base statistics.

    Estimates come from the documents that pass the base rules, per value of lang
    and source (null is a value of its own). A group of any size is estimated the
    same way; the floors alone decide where a group has a single document.
    """
    group = F.to_json(F.struct(F.col("lang").alias("lang"), F.col("source").alias("source")))
    rows = statistics.withColumns(_vector()).withColumn("grp", group)
    passed = rows.filter(~F.col("base_failed")).groupBy("grp", *STATS)
    cells = stored(passed.agg(F.count("*").alias("n")), f"{folder}-cells")
    smallest = minimum_determinants(cells, starts, folder)
    inner = cells.join(smallest, "grp").filter(_distance() <= INNER).groupBy("grp", "start")
    estimates = stored(_estimates(inner.agg(*_sums()), INNER_CONSISTENCY), f"{folder}-final")
    judged = rows.join(estimates, "grp", "left").withColumn("distance", _distance())
    fine = F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & fine)


def _judged(docs: DataFrame, cutoff: float) -> DataFrame:
    kept = ["doc_id", "lang", "source"]
    text_hash = F.xxhash64(text_of()).alias("text_hash")
    base = base_statistics(docs.select(*kept, "text", text_hash)).drop("text")
    return mcd_verdicts(stored(base, "quality-base"), cutoff)


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, base counts, base_failed, distance, kept.

    Null texts, empty texts and texts without words have no words and fail the base
    rule; repeated rows are judged alike; an empty table gives an empty result.
    Columns other than doc_id, text, lang and source are not looked at.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return _judged(docs, cutoff).select("doc_id", *counts, "base_failed", "distance", "kept")


def passing_documents(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of `docs` that the rules keep, as they are."""
    kept = _judged(docs, cutoff).filter("kept").select("doc_id", "lang", "source", "text_hash")
    kept = stored(kept.distinct(), "quality-kept")
    d, k = docs.alias("d"), kept.alias("k")
    same = F.xxhash64(text_of("d.text")) == F.col("k.text_hash")
    for c in ("doc_id", "lang", "source"):
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}"))
    return d.join(k, same, "left_semi")
