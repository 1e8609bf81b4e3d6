"""Mixing sources to target weights: pivotal dependent rounding.

Every document of a source should be copied target / source size times. The whole part
is taken; of the fractional parts, two are paired and words are moved between them at
random, as many up as down, until one of the two is whole. The other one goes on to the
next pair, so the words taken by a source are its target up to one last document.

Documents are dealt at random to groups of bounded size. In a group each document, the largest
first, is paired with the bundle of all smaller ones, which have one fraction in common:
either the document becomes whole, or the bundle does and the document is the group's
residual; else the smallest one is. Residuals are dealt to groups again and paired one by one: a
tree of a few levels. Every document is settled by such an exchange. Only ids and
sizes are moved, never texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import WORD_PATTERN
from pagelore.session import materialize


@dataclass(frozen=True)
class MixConfig:
    #: Repeated for the sources in code point order, null last.
    weights: tuple[int, ...] = (3, 1, 2)
    #: Words of the mix per 100 words of input.
    percent: int = 150
    most_copies: int = 2
    #: Documents of a group, and residuals of a group of the tree above, on average.
    group: int = 400
    fan_in: int = 48
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """Per source: words, and the words the mix should take of it.

    Shares are by weight; a share above ``most_copies`` times the source stops there and
    the excess is shared out again by weight. With sources in order of limit / weight, those
    that stop are a prefix, found by running sums over one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in config.weights])
    limits = sources.withColumn("weight", F.element_at(turn, (rank % len(config.weights) + 1).cast("int"))).withColumn(
        "limit", F.col("source_size") * config.most_copies
    )
    everything = Window.partitionBy(F.lit(0))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    counted = (
        limits.withColumn("total", F.sum("source_size").over(everything) * config.percent / 100.0)
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("stops", F.col("limit") * F.col("weight_left") <= F.col("left") * F.col("weight"))
    )
    # Beyond the sources that stop, the first one's level holds for all.
    level = F.min(F.when(~F.col("stops"), F.struct((F.col("limit") / F.col("weight")).alias("at"), (F.col("left") / F.col("weight_left")).alias("level")))).over(everything)
    return counted.withColumn("level", level["level"]).select(
        "source", F.col("source_size").cast("long").alias("source_size"),
        F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"),
    )


_ITEM = "struct<neg_size:long,u:double,row_id:long,doc_id:long,base:long,p:double>"
_DONE = "array<struct<row_id:long,doc_id:long,size:long,taken:long>>"


def _done(x: Column, copies: Column) -> Column:
    size = -x.neg_size
    return F.struct(x.row_id.alias("row_id"), x.doc_id.alias("doc_id"), size.alias("size"), (copies * size).cast("long").alias("taken"))


def _item(x: Column, p: Column) -> Column:
    return F.struct(*[x[f].alias(f) for f in ("neg_size", "u", "row_id", "doc_id", "base")], p.alias("p"))


def _pivot(items: Column) -> Column:
    """Fold a sorted group of (size, p): pairs exchange words until one is 0 or 1."""
    none = F.lit(None).cast(_ITEM)
    start = F.struct(none.alias("open"), F.array().cast(_DONE).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        a, b = acc["open"], x
        # Words that move from b to a, or from a to b.
        up = F.least(-a.neg_size * (1 - a.p), -b.neg_size * b.p)
        down = F.least(-a.neg_size * a.p, -b.neg_size * (1 - b.p))
        move = F.when(x.u * (up + down) < down, up).otherwise(-down)
        pa, pb = a.p + move / -a.neg_size, b.p - move / -b.neg_size

        # Of the two ends, the one nearer to a whole number is the one that stopped there.
        off_a, off_b = F.least(F.abs(pa), F.abs(1 - pa)), F.least(F.abs(pb), F.abs(1 - pb))
        return (
            F.when(a.isNull(), F.struct(x.alias("open"), acc["done"].alias("done")))
            .when(off_a <= off_b, F.struct(_item(b, pb).alias("open"), F.concat(acc["done"], F.array(_done(a, a.base + F.round(pa)))).alias("done")))
            .otherwise(F.struct(_item(a, pa).alias("open"), F.concat(acc["done"], F.array(_done(b, b.base + F.round(pb)))).alias("done")))
        )

    return F.aggregate(items, start, step)


#: Fractions this near to 0 or 1 are whole: sums of doubles have erred by less.
_WHOLE = 1e-9


def _bundle_pivot(items: Column) -> Column:
    """Fold a group, largest first: each document exchanges words with the bundle of those behind it.

    All have the fraction ``p`` of their source. The exchange keeps everybody's expectation,
    and the words of both together; what the bundle gains or loses falls on its documents by size.
    """
    total = F.aggregate(items, F.lit(0.0), lambda acc, x: acc - x.neg_size)
    start = F.struct(
        F.element_at(items, 1).p.alias("p"), total.alias("size"), F.lit(None).cast(_ITEM).alias("open"), F.array().cast(_DONE).alias("done")
    )

    def step(acc: Column, x: Column) -> Column:
        p, size = acc["p"], -x.neg_size
        rest = acc["size"] - size
        up, down = F.least(size * (1 - p), rest * p), F.least(size * p, rest * (1 - p))
        rises = x.u * (up + down) < down
        # Fractions of the document and of the bundle afterwards.
        mine = F.when(rises, p + up / size).otherwise(p - down / size)
        theirs = F.when(rest <= 0, p).when(rises, p - up / rest).otherwise(p + down / rest)
        theirs = F.least(F.greatest(theirs, F.lit(0.0)), F.lit(1.0))
        whole = lambda v: F.least(v, 1 - v) < _WHOLE
        settled = F.concat(acc["done"], F.array(_done(x, x.base + F.round(F.when(whole(p), p).otherwise(mine)).cast("long"))))
        out = lambda q, open_, done: F.struct(q.alias("p"), rest.alias("size"), open_.alias("open"), done.alias("done"))
        return (
            F.when(whole(p), out(p, acc["open"], settled))
            .when(whole(mine), out(theirs, acc["open"], settled))
            .otherwise(out(F.round(theirs), _item(x, mine), acc["done"]))
        )

    return F.aggregate(items, start, step, lambda acc: F.struct(acc["open"].alias("open"), acc["done"].alias("done")))


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """What the mix takes of every row of ``docs`` (doc_id, text, source).

    Returns row_id, doc_id, source, size, source_size, target, copies, taken. ``row_id`` counts rows
    with the same doc_id, source and size, which are interchangeable. A null text or a text
    of white space has size 0 and is taken 0 times; null sources are one source; null
    doc_ids are rows like others. An empty table gives an empty result. Sizes are counted
    in one pass and stored; the rest of the job moves ids and sizes. Texts are counted whole.
    """
    counted = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    alike = counted.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    sizes = materialize(
        alike.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row_id")), "mix-sizes"
    )
    aims = materialize(targets(sizes, config), "mix-targets")
    # One row per source: small next to the documents, yet not of a proven size, so Spark chooses the join.
    rows = sizes.join(aims, sizes["source"].eqNullSafe(aims["source"])).select(
        sizes["doc_id"], sizes["source"], "row_id", "size", "source_size", "target"
    )
    key = (F.col("doc_id"), F.col("row_id"), F.col("source"), F.col("size"))

    def items(p: Column, base: Column, draw: int) -> Column:
        drawn = F.struct((-F.col("size")).alias("neg_size"), _uniform(config.seed + draw, *key).alias("u"), "row_id", "doc_id", base.alias("base"), p.alias("p"))
        return F.sort_array(F.collect_list(drawn)).alias("items")

    def taken(folded: DataFrame) -> DataFrame:
        return folded.select("source", F.explode("done").alias("d")).select("source", "d.row_id", "d.doc_id", "d.size", "d.taken")

    ratio = F.least(F.greatest(F.col("target") / F.col("source_size"), F.lit(0.0)), F.lit(float(config.most_copies)))
    fractions = rows.where(F.col("size") > 0).select(
        "source", "row_id", "doc_id", "size", F.floor(ratio).alias("base"), (ratio - F.floor(ratio)).alias("p")
    )
    per_source = fractions.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("n"))
    pending = fractions.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    parts = [rows.where(F.col("size") == 0).select("source", "row_id", "doc_id", "size", F.lit(0).cast("long").alias("taken"))]
    most, width, level = per_source.agg(F.max("n")).first()[0] or 0, config.group, 0
    while True:
        last = most <= width
        groups = (F.lit(1) if last else F.ceil(F.col("n") / width)).cast("long")
        fold = _pivot if level else _bundle_pivot
        folded = materialize(
            pending.withColumn("groups", groups)
            .groupBy("source", "groups", F.pmod(F.xxhash64(F.lit(config.seed + 10 + level), *key), groups).alias("group"))
            .agg(items(F.col("p"), F.col("base"), 30 + level))
            .withColumn("fold", fold(F.col("items")))
            .select("source", F.col("groups").alias("n"), "fold.open", "fold.done"),
            f"mix-level-{level}",
        )
        parts.append(taken(folded))
        # A group whose fraction was whole from the start leaves no residual.
        pending = folded.where(F.col("open").isNotNull()).select(
            "source", "n", "open.row_id", "open.doc_id", (-F.col("open.neg_size")).alias("size"), "open.base", "open.p"
        )
        if last:
            break
        most, width, level = -(-most // width), config.fan_in, level + 1
    # The last residual of a source is drawn by its own probability.
    up = (_uniform(config.seed + 2, *key) < F.col("p")).cast("long")
    parts.append(pending.select("source", "row_id", "doc_id", "size", ((F.col("base") + up) * F.col("size")).alias("taken")))
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    return everything.join(aims, everything["source"].eqNullSafe(aims["source"])).select(
        "row_id", "doc_id", everything["source"], "size", "source_size", "target",
        F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0).alias("copies"), "taken",
    )
