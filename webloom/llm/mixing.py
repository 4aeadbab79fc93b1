"""Mixing sources to target weights by Pareto order sampling (Rosen, 1997).

A source whose target is e times its size gives every document the whole copies
in e for certain. What is left of e is drawn: documents of one source are put
into classes of near equal sizes, a quarter of an octave wide, and from each
class a fixed number is drawn with unequal probabilities. A document's odds of
inclusion are those of its class times its size over the class's mean size; the
documents of the least u / (1 - u) over these odds, for a random u, are drawn.
The numbers are such that the words drawn are expected to be the share left, and
are rounded so that what one class lacks goes to the next. What the draw still
misses of the target is made up in the same order: drawn documents stop at the
target, and in further passes others fill the gap where they fit; where none
does, a larger one is taken and small ones are given back for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.ordered import range_parts, running_totals
from webloom.runtime import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """(source, rank, source_size, target) from rows of (source, source_size), one a source.

    Sources in code-point order, null last, take the weights in turn and share
    `share` times the sum of all sizes. A target stops at max_repeat times its
    source's size, and what it leaves is shared out again by weight: the targets
    are min(cap, level * weight), where the level follows from running totals
    over the sources in the order of cap / weight.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked = running_totals(range_parts(sizes, order, "sources"), order, {"rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.select("source", "rank", "source_size", weight.alias("w"), (F.col("source_size") * float(max_repeat)).alias("cap"))
    fill = [F.col("cap") / F.col("w"), F.col("rank")]
    parts = range_parts(capped, fill, "levels")
    run = running_totals(parts, fill, {"caps": F.col("cap"), "ws": F.col("w")})
    whole = parts.agg(F.sum("source_size").alias("n"), F.sum("w").alias("w")).first()
    if not whole["w"]:
        return capped.select("source", "rank", "source_size", F.col("cap").alias("target"))
    total = float(share) * (whole["n"] or 0)
    # the level if all before this source stop at their caps
    level = (F.lit(total) - (F.col("caps") - F.col("cap"))) / (F.lit(float(whole["w"])) - (F.col("ws") - F.col("w")))
    found = run.select((F.col("cap") / F.col("w")).alias("fill"), level.alias("level")).filter("fill > level").agg(F.min_by("level", "fill").alias("x")).first()["x"]
    target = F.col("cap") if found is None else F.least(F.col("cap"), F.col("w") * F.lit(float(found)))
    return materialize(capped.select("source", "rank", "source_size", target.alias("target")), "targets")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 20240607,
    fill_passes: int = 3,
    swaps: int = 2,
    tolerance: float = 0.0025,
) -> DataFrame:
    """How many copies of each document a mix takes, so that each source nears its target of words.

    Returns doc_id, size, source, source_size, target, chance (of being drawn
    beyond the certain copies, null where nothing is), drawn, copies and taken
    (size times copies), a row per input row. No source exceeds its target; one
    that is within `tolerance` of it gets no more passes. The
    same input gives the same mix: u is a hash of the seed, the id and the text.

    Null and empty texts have size 0 and are never taken more than the certain
    copies; a null source is a source like others, the last in order; a null id
    is an id like others. Rows equal in id, text and source can't be told apart:
    they are drawn together or not at all. An empty table gives an empty result.
    Other columns are not read.
    """
    sized = materialize(_sized(docs, id_col, text_col, source_col), "sized")
    plan = _plan(sized, weights, share, max_repeat, seed, fill_passes, swaps, tolerance)
    rows = _copies(sized, plan, seed)
    copies = F.col("copies").cast("long")
    return rows.select("doc_id", "size", "source", "source_size", "target", "chance", "drawn", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("same"))


@dataclass(frozen=True)
class Plan:
    """targets: a row a source; classes: a row a source and class; passes: a row a source; repeats: rows that stand for several, if there are any."""

    targets: DataFrame
    classes: DataFrame
    passes: DataFrame
    repeats: DataFrame | None


ROW = ("source", "doc_id", "size", "same")
#: What orders the documents of a source: large classes first, then the Pareto variable.
KEY = ("from_top", "pareto", "doc_id", "size", "same")


def _class(words: Column) -> Column:
    """Size classes a quarter of an octave wide, counted from the top."""
    return (-F.floor(4 * F.log2(words.cast("double")))).cast("int")


def _pareto(seed: int) -> Column:
    """The variable that ranks a class: u / (1 - u) over the odds of inclusion; from doc_id, same, words and the class's odds and mean."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("same")), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
    return (u / (1 - u)) / (F.col("odds") * F.col("words") / F.col("mean"))


def _plan(sized: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float, seed: int, fill_passes: int, swaps: int, tolerance: float) -> Plan:
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeat)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("certain", F.floor(expected)).withColumn("part", expected - F.col("certain"))
    targets = materialize(targets.withColumn("room", F.col("target") - F.col("certain") * F.col("source_size")).withColumnRenamed("source", "_source"), "targets")
    units = sized.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n")).withColumn("words", F.col("n") * F.col("size"))
    units = materialize(units.withColumn("from_top", F.when(F.col("size") > 0, _class(F.col("words")))), "units")
    repeats = materialize(units.filter("n > 1").select(*[F.col(c).alias(f"_{c}") for c in ROW], "n"), "repeats")
    repeats = repeats if repeats.limit(1).count() else None

    sizes = units.filter("size > 0").groupBy("source", "from_top").agg(F.count(F.lit(1)).alias("count"), F.sum("words").alias("sum"), F.sum(F.col("words").cast("double") * F.col("words")).alias("squares"))
    sizes = sizes.join(targets.filter("part > 0").select("_source", "rank", "part"), F.col("source").eqNullSafe(F.col("_source")))
    # with chances in proportion to sizes a draw brings squares / sum words
    upto = F.sum(F.col("part") * F.col("sum") * F.col("sum") / F.col("squares")).over(Window.partitionBy("rank").orderBy("from_top"))
    sizes = sizes.withColumn("upto", F.floor(upto + 1e-9)).withColumn("draws", F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("rank").orderBy("from_top")), F.lit(0)))
    sizes = sizes.withColumn("draws", F.least("draws", "count"))
    odds = (F.col("draws") + 0.5) / (F.col("count") - F.col("draws") + 0.5)
    classes = materialize(sizes.select(F.col("rank").alias("_rank"), F.col("from_top").alias("_from_top"), "draws", odds.alias("odds"), (F.col("sum") / F.col("count")).alias("mean")), "classes")

    rows = units.join(targets.filter("part > 0").select("_source", "rank"), F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.join(classes, (F.col("rank") == F.col("_rank")) & (F.col("from_top") == F.col("_from_top"))).withColumn("pareto", _pareto(seed)).select("rank", *KEY, "words", "draws")
    order = [F.col("rank"), *map(F.col, KEY)]
    ranked = running_totals(range_parts(rows, order, "pareto"), order, {"nth": F.lit(1).cast("long")}, within=["rank", "from_top"])
    parts = ranked.withColumn("drawn", F.col("nth") <= F.col("draws")).drop("nth", "draws")
    parts = range_parts(parts, order, "drawn")
    key = F.struct(*KEY)
    last = parts.filter("drawn").groupBy(F.col("rank").alias("_rank"), F.col("from_top").alias("_from_top")).agg(F.max(key).alias("last"))
    last = materialize(last, "last")
    classes = classes.join(last.withColumnsRenamed({"_rank": "_r", "_from_top": "_f"}), (F.col("_rank") == F.col("_r")) & (F.col("_from_top") == F.col("_f")), "left").drop("_r", "_f")

    passes = _passes(parts, order, targets.filter("part > 0"), fill_passes, swaps, tolerance)
    return Plan(targets, materialize(classes, "classes"), passes, repeats)


#: A pass sets `taken` to add for rows of up to `room` words whose keys lie between least (null: from the first) and cut.
def _taken(passes: Column) -> Column:
    """Whether a row is taken after these passes; the first one is for drawn rows only."""
    key = F.struct(*KEY)
    inside = lambda p: (F.col("words") <= p["room"]) & (key <= p["cut"]) & F.coalesce(p["least"] <= key, F.lit(True))
    first = F.coalesce(F.col("drawn") & inside(F.get(passes, 0)), F.lit(False))
    return F.aggregate(F.slice(passes, 2, 1000), first, lambda x, p: F.when(inside(p), p["add"]).otherwise(x))


def _passes(parts: DataFrame, order: list[Column], targets: DataFrame, fill_passes: int, swaps: int, tolerance: float) -> DataFrame:
    """(_pass_rank, passes): a row a source, the passes that bring it nearest to its target from below.

    Drawn rows are taken up to the target, then others that the gap can hold.
    Where a gap of more than the tolerance stays, since all that is left is
    larger, the smallest of these is taken as well, and rows that make up what is
    then too much are given back: as many as fit, then the smallest that covers
    the rest; and what fits is filled in again. Of all states, each source keeps
    that with the least gap. Rows are read anew in each pass, for sources that
    are still apart from their targets; only a row a source is written.
    """
    key = F.struct(*KEY)
    kind = parts.select(key.alias("k")).schema["k"].dataType.simpleString()
    entry = f"struct<add:boolean,least:{kind},cut:{kind},room:double>"
    state = targets.select(F.col("rank").alias("_pass_rank"), F.col("room").cast("double").alias("gap"), (F.col("target") * tolerance).alias("close"), F.lit(None).cast(f"array<{entry}>").alias("passes"))
    state = state.withColumns({"passes": F.coalesce("passes", F.array().cast(f"array<{entry}>")), "best": F.col("gap"), "best_passes": F.array().cast(f"array<{entry}>")})
    fill = ["fill"] * fill_passes
    for step in ["draw", *fill, *(["over", "trim", "trim", "last", *fill] * swaps)]:
        wanted = F.col("gap") < 0 if step in ("trim", "last") else (F.col("gap") > 0 if step == "draw" else F.col("gap") > F.col("close"))
        if not state.filter(wanted).limit(1).count():
            continue
        rows = parts.join(state.filter(wanted).select("_pass_rank", "gap", "passes"), F.col("rank") == F.col("_pass_rank")).withColumn("taken", _taken(F.col("passes")))
        back = step in ("trim", "last")
        free, apart = F.col("taken") if back else ~F.col("taken"), F.abs("gap")
        if step in ("over", "last"):
            fits = free & (F.col("words") >= apart)
            one = F.min(F.when(fits, F.struct("words", key.alias("key"))))
            got = rows.groupBy(F.col("rank").alias("_got")).agg(one.alias("one")).filter("one is not null")
            got = got.select("_got", F.col("one.words").alias("got"), F.col("one.key").alias("least"), F.col("one.key").alias("cut"), F.col("one.words").cast("double").alias("room"))
        else:
            fits = free & (F.col("words") <= apart)
            fits = fits & F.col("drawn") if step == "draw" else fits
            run = running_totals(rows.withColumn("fits", fits), order, {"upto": F.when(F.col("fits"), F.col("words")).otherwise(F.lit(0))}, within=["rank"])
            now = F.col("fits") & (F.col("upto") <= apart)
            got = run.groupBy(F.col("rank").alias("_got")).agg(F.sum(F.when(now, F.col("words"))).alias("got"), F.max(F.when(now, key)).alias("cut"), F.max(apart).alias("room"))
            got = got.select("_got", "got", F.lit(None).cast(kind).alias("least"), "cut", "room")
        one = F.struct(F.lit(not back).alias("add"), "least", "cut", "room").cast(entry)
        state = state.join(got, F.col("_pass_rank") == F.col("_got"), "left")
        # a source that is not part of a pass has an entry too, which no row fits
        state = state.withColumn("passes", F.concat("passes", F.array(F.coalesce(F.when(F.col("_got").isNotNull(), one), F.lit(None).cast(entry)))))
        state = state.withColumn("gap", F.col("gap") + F.coalesce("got", F.lit(0)) * (1 if back else -1))
        better = (F.col("gap") >= 0) & ((F.col("gap") < F.col("best")) | (F.size("best_passes") == 0))
        state = state.withColumns({"best_passes": F.when(better, F.col("passes")).otherwise(F.col("best_passes")), "best": F.when(better, F.col("gap")).otherwise(F.col("best"))})
        state = materialize(state.select("_pass_rank", "gap", "close", "passes", "best", "best_passes"), "passes")
    return materialize(state.select("_pass_rank", F.col("best_passes").alias("passes")), "passes")


def _copies(rows: DataFrame, plan: Plan, seed: int) -> DataFrame:
    """rows with ROW's columns, and source_size, target, chance, drawn and copies by a plan: nothing is shuffled by document."""
    found = rows.withColumn("n", F.lit(1).cast("long"))
    if plan.repeats is not None:  # only then is anything shuffled by row
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ROW[1:]]
        found = rows.join(plan.repeats.withColumnRenamed("_source", "_s"), same[0] & same[1] & same[2] & F.col("source").eqNullSafe(F.col("_s")), "left")
    found = found.withColumn("words", F.col("size") * F.coalesce("n", F.lit(1))).withColumn("from_top", F.when(F.col("size") > 0, _class(F.col("words"))))
    found = found.join(plan.targets, F.col("source").eqNullSafe(F.col("_source"))).drop("room")
    found = found.join(plan.classes, (F.col("rank") == F.col("_rank")) & (F.col("from_top") == F.col("_from_top")), "left")
    found = found.join(plan.passes, F.col("rank") == F.col("_pass_rank"), "left").withColumn("pareto", _pareto(seed))
    key = F.struct(*KEY)
    found = found.withColumn("drawn", F.coalesce(key <= F.col("last"), F.lit(False)))
    extra = F.coalesce((F.col("size") > 0) & _taken(F.col("passes")), F.lit(False))
    chance = F.col("odds") * F.col("words") / F.col("mean")
    out = found.withColumn("copies", (F.col("certain") + extra.cast("int")).cast("int")).withColumn("drawn", F.col("drawn") & (F.col("size") > 0)).withColumn("chance", chance / (1 + chance))
    return out.select(*rows.columns, "source_size", "target", "chance", "drawn", "copies")


def take_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 20240607,
    fill_passes: int = 3,
    swaps: int = 2,
    tolerance: float = 0.0025,
) -> DataFrame:
    """The documents of a mix: each row of docs as often as mix_sources() says, in the columns of docs.

    The draw comes back as tables of a row a source or size class, which
    documents meet by source; only texts that are repeated are looked up by row.
    """
    sized = materialize(_sized(docs, id_col, text_col, source_col), "sized")
    plan = _plan(sized, weights, share, max_repeat, seed, fill_passes, swaps, tolerance)
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_whole"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("same"))
    held = _copies(keyed, plan, seed).filter("copies > 0")
    return held.select("_whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_whole.*")
