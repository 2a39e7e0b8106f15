"""Mixing sources to target weights (operator 2), with DataFrame functions only.

Every document of a source is wanted the same number of times, the source's
target over its size.  The whole part is taken outright; what is left is a
probability, which pivotal dependent rounding makes 0 or 1: two documents are
paired and probability mass, counted in words, is moved at random from one to
the other until one of them is whole.  The other goes on to the next pair, so a
source's words stay what they were.  Folds of about ``BLOCK`` documents run in
parallel; their residuals are folded again, level by level, as a reduction
tree, until one document of a source is left, drawn by its own probability.

That last document may be a large one.  A source's smallest documents, with
``RESERVE`` times the words that the largest could be off by, are therefore
folded after all others, by a second tree: before it, what the first draw took
too much or too little is spread over them, which changes no expectation.  So a
source misses its target by less than one of its small documents (if its small
documents are too few for that, by less than one document).

Scale: texts are read once, to count words; from then on rows are an id, a
source, a size and a hash.  A block is drawn by hash inside its source, so a
source with a third of all rows makes as many more blocks.  A tree has
``log(documents) / log(BLOCK)`` levels, each one exchange of what the level
before left over.  Weights and targets are found in one task over one row per
source, so the number of sources, not of documents, bounds it.  Draws are
hashes of the documents' keys: reruns agree.

Defined cases: a null text has size 0, and a very long one is only counted; a
null source is a source of its own, last in order; a null id is an id like any
other; repeated rows are told apart by a running number and each is rounded by
itself; ties in size go by hash; an empty table gives no rows.  Other columns
are not looked at; ``mixed`` passes them on, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotlog.llm._common import table, written

WEIGHTS = (3, 1, 2)
#: Documents of one fold, on average.
BLOCK = 64
#: Words of the small documents folded last, over the most that they may have to make up for.
RESERVE = 2
#: Sources whose targets are broadcast at most.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Number of runs without space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys only."""
    return F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target``: 150 % of all words shared by weight.

    ``sizes`` has ``source`` and ``size``.  A target stops at twice its source;
    the excess is shared again by weight.  That ends where every source below
    its cap gets the same words per unit of weight, which one pass over the
    sources in order of cap per weight finds with whole numbers.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = total.withColumn("_w", weight.cast("long")).withColumn("_cap", 2 * F.col("source_size"))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "_rest": 3 * F.sum("source_size").over(everything) - 2 * F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_weights": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)),
        "_rank": F.row_number().over(order),
    })
    s = s.withColumn("_full", 2 * F.col("_cap") * F.col("_weights") <= F.col("_rest") * F.col("_w"))
    level = F.min(F.when(~F.col("_full"), F.struct("_rank", "_rest", "_weights"))).over(everything)
    s = s.withColumn("_level", level)
    free = F.col("_level._rest") * F.col("_w") / (2.0 * F.col("_level._weights"))
    full = F.col("_full") & (F.col("_level").isNull() | (F.col("_rank") < F.col("_level._rank")))
    return s.select("source", "source_size", F.when(full, F.col("_cap").cast("double")).otherwise(free).alias("target"))


def _item(x: Column, mass: Column) -> Column:
    return F.struct((-x["size"]).alias("order"), x["key"].alias("key"), x["id"].alias("id"), x["whole"].alias("whole"), x["size"].alias("size"), mass.cast("double").alias("mass"))


def _fold(items: Column, seed: int) -> Column:
    """``items`` with each mass 0 or the item's size, but for the last one.

    The accumulator holds the item in hand (none or one) and the settled ones.
    """
    kind = "struct<order:bigint,key:bigint,id:bigint,whole:bigint,size:bigint,mass:double>"

    def step(acc: Column, y: Column) -> Column:
        x = F.get(acc["hand"], F.lit(0))
        sx, sy = x["size"].cast("double"), y["size"].cast("double")
        to_x, to_y = F.least(sx - x["mass"], y["mass"]), F.least(x["mass"], sy - y["mass"])
        up = _draw(seed, x["key"], y["key"]) * (to_x + to_y) < to_y
        x_new = F.when(up, F.when(sx - x["mass"] <= y["mass"], sx).otherwise(x["mass"] + y["mass"])).otherwise(F.when(x["mass"] <= sy - y["mass"], F.lit(0.0)).otherwise(x["mass"] - (sy - y["mass"])))
        y_new = F.when(up, F.when(sx - x["mass"] <= y["mass"], y["mass"] - (sx - x["mass"])).otherwise(F.lit(0.0))).otherwise(F.when(x["mass"] <= sy - y["mass"], x["mass"] + y["mass"]).otherwise(sy))
        both = F.array(_item(x, x_new), _item(y, y_new))
        open_ = lambda i: (i["mass"] > i["size"] * 1e-9) & (i["mass"] < i["size"] * (1 - 1e-9))
        pair = F.when(F.size(acc["hand"]) == 0, F.array(_item(y, y["mass"]))).otherwise(both)
        return F.struct(F.filter(pair, open_).cast(f"array<{kind}>").alias("hand"), F.concat(acc["done"], F.filter(pair, lambda i: ~open_(i))).cast(f"array<{kind}>").alias("done"))

    none = F.array().cast(f"array<{kind}>")
    return F.aggregate(items.cast(f"array<{kind}>"), F.struct(none.alias("hand"), none.alias("done")), step, lambda acc: F.concat(F.transform(acc["done"], lambda i: F.struct(i["key"], i["id"], i["whole"], i["size"], i["mass"], F.lit(True).alias("settled"))), F.transform(acc["hand"], lambda i: F.struct(i["key"], i["id"], i["whole"], i["size"], i["mass"], F.lit(False).alias("settled")))))


def _tree(level: DataFrame, by_source, seed: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Settled rows of every level (``up``: taken once more) and one residual row of each source, by its own draw."""
    per_source = level.groupBy("source").agg(F.count("*").alias("n"))
    most = per_source.agg(F.max("n")).first()[0] or 0
    per_source = by_source(per_source.withColumnRenamed("source", "_of"))
    settled = []
    for k in range(1 + max(0, math.ceil(math.log(max(most, 1), BLOCK)))):
        blocks = F.ceil(F.col("n") / F.lit(float(BLOCK) ** (k + 1))).cast("long")
        dealt = level.join(per_source, F.col("source").eqNullSafe(F.col("_of"))).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + k), "key"), blocks))
        items = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "key", "id", "whole", "size", "mass")))
        folded = dealt.groupBy("source", "block").agg(items.alias("items")).select("source", F.explode(_fold(F.col("items"), seed + k)).alias("x")).select("source", "x.*")
        folded = written(folded, f"{label}{k}")
        settled.append(folded.where("settled").select("source", "id", "whole", "size", "key", (F.col("mass") > F.col("size") / 2).alias("up")))
        level = folded.where(~F.col("settled")).select("source", "id", "whole", "size", "mass", "key")
    up = _draw(seed, F.col("key")) * F.col("size") < F.col("mass")
    return settled, level.withColumn("up", up)


def _small(open_: DataFrame) -> DataFrame:
    """``_of, small``: the size up to which a source's documents are folded last.

    Sizes are summed by steps of a quarter of a power of two.
    """
    steps = open_.groupBy("source", F.floor(F.log2("size") * 4).alias("step")).agg(F.sum("size").alias("words"), F.max("size").alias("top"), F.first(F.col("mass") / F.col("size")).alias("rate"))
    so_far, all_ = Window.partitionBy("source").orderBy("step"), Window.partitionBy("source")
    need = RESERVE * F.max("top").over(all_) / F.least(F.first("rate").over(all_.orderBy("step")), 1 - F.first("rate").over(all_.orderBy("step")))
    half = F.sum("words").over(all_) / 2
    have = steps.withColumns({"have": F.sum("words").over(so_far), "need": F.least(need, half)})
    return have.where("have >= need").groupBy(F.col("source").alias("_of")).agg(F.min("top").alias("small"))


def _took(docs: DataFrame, id: str, text: str, source: str, weights: tuple[int, ...], seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``id, source, size, key, copies`` of every row, all its rows by ``key``, and the targets of the sources."""
    counted = docs.select(F.col(id).cast("long").alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(2), F.col(text)).alias("mark"))
    base = written(counted.groupBy("id", "source", "size", "mark").agg(F.count("*").alias("rows")), "mix-sizes")
    targets = written(source_targets(base.select("source", (F.col("size") * F.col("rows")).alias("size")), weights), "mix-targets")
    by_source = F.broadcast if targets.count() <= BROADCAST_ROWS else (lambda df: df)

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = base.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    units = units.withColumn("key", F.xxhash64(F.lit(seed), "id", "size", "number", "source", "mark"))
    rated = by_source(targets.select(F.col("source").alias("_of"), rate.alias("rate")))
    units = units.join(rated, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    units = units.withColumns({"whole": F.floor("rate").cast("long"), "mass": (F.col("rate") - F.floor("rate")) * F.col("size")}).drop("rate")
    is_open = (F.col("mass") > F.col("size") * 1e-9) & (F.col("mass") < F.col("size") * (1 - 1e-9)) & (F.col("size") > 0)
    open_ = units.where(is_open).select("source", "id", "whole", "size", "mass", "key")
    small = by_source(written(_small(open_), "mix-small"))
    open_ = open_.join(small, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    settled, last = _tree(open_.where("size > small").drop("small"), by_source, seed, "mix-level")
    last = written(last, "mix-last")

    # what the first draw took too much is taken from the small documents, what it took too little given to them
    reserve = open_.where("size <= small").drop("small")
    off = last.select(F.col("source").alias("_of"), (F.col("up").cast("int") * F.col("size") - F.col("mass")).alias("off"))
    room = reserve.groupBy(F.col("source").alias("_in")).agg(F.sum("mass").alias("mass_in"), F.sum(F.col("size") - F.col("mass")).alias("mass_out"))
    spread = off.join(room, F.col("_of").eqNullSafe(F.col("_in"))).select("_of", F.when(F.col("off") > 0, -F.least(F.col("off") / F.col("mass_in"), F.lit(1.0))).otherwise(F.least(-F.col("off") / F.col("mass_out"), F.lit(1.0))).alias("move"))
    reserve = reserve.join(by_source(written(spread, "mix-spread")), F.col("source").eqNullSafe(F.col("_of")), "left")
    moved = F.when(F.col("move") > 0, F.col("mass") + F.col("move") * (F.col("size") - F.col("mass"))).otherwise(F.col("mass") * (1 + F.col("move")))
    reserve = reserve.select("source", "id", "whole", "size", F.coalesce(moved, F.col("mass")).alias("mass"), "key")
    more, rest = _tree(reserve, by_source, seed + 1000, "mix-reserve")

    took = units.where(~is_open).select("id", "source", "size", "key", (F.col("whole") + (F.col("mass") > F.col("size") / 2).cast("long")).alias("copies"))
    for part in [*settled, last, *more, rest]:
        took = took.unionByName(part.select("id", "source", "size", "key", (F.col("whole") + F.col("up").cast("long")).alias("copies")))
    return took, units, targets


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """One row per document: how often the mix takes it (``copies``).

    Columns: the id, ``source``, ``size``, ``source_size``, ``target`` and
    ``copies``.
    """
    took, _, targets = _took(docs, id, text, source, weights, seed)
    few = F.broadcast(targets) if targets.count() <= BROADCAST_ROWS else targets
    rows = took.withColumnRenamed("source", "_source").join(few, F.col("_source").eqNullSafe(F.col("source")))
    return rows.select(F.col("id").alias(id), "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """``docs`` with every row as often as the mix takes it.

    Rows with the same id, source and text are told apart by a running number,
    any order of which gives the same rows.  The text moves once: the number and
    the join go by one key.
    """
    took, units, _ = _took(docs, id, text, source, weights, seed)
    same = F.xxhash64(F.lit(3), "id", "source", "size", "mark").alias("same")
    copies = units.select("key", "rows", same).join(took.select("key", "copies"), "key").groupBy("same").agg(F.sum("copies").alias("copies"), F.max("rows").alias("rows"))
    copies = written(copies.where("copies > 0"), "mix-copies")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id).cast("long").alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(2), F.col(text)).alias("mark"))
    number = F.row_number().over(Window.partitionBy("same").orderBy(F.lit(0)))
    take = F.floor(F.col("copies") / F.col("rows")) + (number <= F.col("copies") % F.col("rows")).cast("long")
    chosen = rows.select("row", same).join(copies, "same").withColumn("take", take).where("take > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "take"))).select("row.*")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, beside its source's target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
