"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target is the least of its cap and its share of the budget; the excess over caps goes back by weight. That is
one water level L with sum(min(L * weight, cap)) = budget, read off a running sum over sources ordered by cap / weight.
A document is taken floor(e) times for sure, e = target / source size, and once more with probability e - floor(e).
The pivotal method settles that: two open documents trade words (probability times size), in a random direction chosen
so that each keeps its expectation, until one of them is settled; the other goes on. In a leaf of the reduction tree each
document, longest first, trades with all that follow as one, which settles all but one, mostly the shortest; the open
ones meet in pairs in the next level's nodes, and the root's last one is drawn. Every trade
keeps the number of words, so a source misses its target by less than its last open document, which may be a long one.

Randomness is a hash of the ids, so reruns agree, whatever the partitioning. A source's leaves are dealt by hash and hold
about ``fan`` documents, so a source of any size is spread evenly.

Defined results: null text has size 0 and takes 0; null is a source of its own, ordered last; a source of size 0 has
target 0; equal rows are settled one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, repeated, row_key, running_sums, whole_row

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D: each becomes one letter, which are counted."""
    plain = F.regexp_replace(F.regexp_replace(text, WORD, "x"), r"[\x20\x09-\x0D]+", "")
    return F.coalesce(F.length(plain), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, n) -> with ``target``: the water level over the sources, of which there is one row each."""
    by_name = [F.col("source").isNull(), F.col("source")]
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = running_sums(sources, by_name, {"before": F.lit(1)})
    rows = rows.withColumn("weight", F.get(cycle, (F.col("before") % len(weights)).cast("int"))).withColumn("most", cap * F.col("source_size")).withColumn("fills_at", F.col("most") / F.col("weight"))
    rows = cut(running_sums(rows, [F.col("fills_at"), *by_name], {"full": F.col("most"), "light": F.col("weight")}))
    total = rows.agg(F.least(share * F.sum("source_size"), F.sum("most")).alias("budget"), F.sum("weight").alias("weight")).first()
    if total["budget"] is None:
        return rows.withColumn("target", F.col("most")).drop("before", "weight", "most", "fills_at", "full", "light")
    rows = rows.withColumn("level", (F.lit(total["budget"]) - F.col("full")) / (F.lit(total["weight"]) - F.col("light")))
    # the level is right at the first source that it does not fill, of sources filled alike the one with the highest
    level = rows.where("level <= fills_at").agg(F.min(F.struct("fills_at", (-F.col("level")).alias("below"))).alias("x")).first()["x"]
    target = F.col("most") if level is None else F.least(F.col("most"), F.lit(-level["below"]) * F.col("weight"))
    return rows.withColumn("target", target).drop("before", "weight", "most", "fills_at", "full", "light", "level")


def _trade(state: Column, doc: Column) -> Column:
    """One pivotal step between the open document in ``state`` and the next one."""
    a, b = state["open"], doc
    give = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])  # words that may move from b to a
    take = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
    coin = F.pmod(F.xxhash64(a["key"], b["key"], F.lit("trade")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    up = coin * (give + take) < take
    moved = F.when(up, give).otherwise(-take)
    pa, pb = a["p"] + moved / a["size"], b["p"] - moved / b["size"]
    # the settled one is known from the amounts, not from rounded probabilities
    a_done = F.when(up, (1 - a["p"]) * a["size"] <= b["p"] * b["size"]).otherwise(a["p"] * a["size"] <= (1 - b["p"]) * b["size"])
    a_value, b_value = up.cast("int"), (~up).cast("int")
    row = lambda x, p: F.struct(x["key"].alias("key"), x["size"].alias("size"), p.alias("p"))
    closed = F.when(a_done, F.struct(a["key"].alias("key"), a_value.alias("extra"))).otherwise(F.struct(b["key"].alias("key"), b_value.alias("extra")))
    going = F.when(a_done, row(b, F.least(F.greatest(pb, F.lit(0.0)), F.lit(1.0)))).otherwise(row(a, F.least(F.greatest(pa, F.lit(0.0)), F.lit(1.0))))
    return F.struct(going.alias("open"), F.array_append(state["done"], closed).alias("done"))


OPEN = "struct<key:struct<h:bigint,n:bigint>,size:double,p:double>"
DONE = "array<struct<key:struct<h:bigint,n:bigint>,extra:int>>"


def _reduce(items: Column) -> Column:
    """All but one of the open documents settled: struct(open, done)."""
    first = F.struct(items[0].cast(OPEN).alias("open"), F.expr(f"cast(array() as {DONE})").alias("done"))
    kind = f"struct<open:{OPEN},done:{DONE}>"
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), first.cast(kind), lambda s, x: _trade(s, x.cast(OPEN)).cast(kind))


def _reduce_leaf(items: Column) -> Column:
    """All but one of a leaf's open documents settled, which have one probability: struct(open, done).

    Each, longest first, trades with all that follow as one: they give or take in proportion, so their probability stays
    one number. The document is settled, or, where they have too little to settle it, they are and it stays open.
    """
    kind = f"struct<p:double,rest:double,open:{OPEN},done:{DONE}>"
    words = F.aggregate(items, F.lit(0.0), lambda t, x: t + x["size"])
    first = F.struct(items[0]["p"].alias("p"), words.alias("rest"), F.expr(f"cast(null as {OPEN})").alias("open"), F.expr(f"cast(array() as {DONE})").alias("done"))

    def step(s: Column, x: Column) -> Column:
        p, size, rest = s["p"], x["size"], s["rest"] - x["size"]
        need, hold = (1 - p) * size, p * size  # words from a settled 1, from a settled 0
        give, take = F.least(need, p * rest), F.least(hold, (1 - p) * rest)
        coin = F.pmod(F.xxhash64(x["key"], F.lit("leaf trade")), F.lit(1 << 53)) / F.lit(float(1 << 53))
        up = coin * (give + take) < take
        last, over = rest <= 0, s["open"].isNotNull()
        settled = ~last & F.when(up, need <= p * rest).otherwise(hold <= (1 - p) * rest)
        near = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        own = F.when(last, p).when(up, p + give / size).otherwise(p - take / size)
        pool = F.when(last, p).when(settled, near(F.when(up, p - need / rest).otherwise(p + hold / rest))).otherwise(F.when(up, 0.0).otherwise(1.0))
        extra = F.when(over, F.when(p >= 0.5, 1).otherwise(0)).otherwise(up.cast("int"))
        closed = F.array_append(s["done"], F.struct(x["key"].alias("key"), extra.alias("extra")).cast("struct<key:struct<h:bigint,n:bigint>,extra:int>"))
        opened = F.struct(x["key"].alias("key"), size.alias("size"), near(own).alias("p")).cast(OPEN)
        shut = over | settled
        return F.struct(F.when(over, p).otherwise(pool).alias("p"), rest.alias("rest"), F.when(shut, s["open"]).otherwise(opened).alias("open"), F.when(shut, closed).otherwise(s["done"]).alias("done")).cast(kind)

    return F.aggregate(items, first.cast(kind), step, lambda s: F.struct(s["open"].alias("open"), s["done"].alias("done")))


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, fan: int = 64, carry: Column | None = None) -> DataFrame:
    """One row per row: doc_id, size, source_size, target, taken, copies (and ``carry``, a small column to keep)."""
    docs = cut(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), (F.lit(None).cast("long") if carry is None else carry).alias("carry")))
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # equal rows are numbered, so that they spread over the leaves like others
    docs = repeated(docs.groupBy("doc_id", "source", "size", "carry").agg(F.count("*").alias("times")), "times", "nth").drop("times")
    plan = cut(targets(sums, weights, share, cap))
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("sure", F.floor(e).cast("int")).withColumn("p", e - F.floor(e))
    rows = docs.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64("doc_id", "size", "nth", F.lit("leaf")), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / fan))))
    fixed = (F.col("size") == 0) | (F.col("p") <= 0) | (F.col("p") >= 1)
    # long documents trade first, so that short ones are left to settle them
    item = F.struct((-F.col("size")).alias("order"), F.xxhash64("doc_id", "size", "nth").alias("h"), F.col("doc_id"), F.col("carry"), F.col("size"), F.when(fixed, F.lit(None).cast("double")).otherwise(F.col("p")).alias("p"))
    same = ["source", "leaf", "source_size", "target", "sure"]
    leaves = rows.groupBy(*same).agg(F.array_sort(F.collect_list(item)).alias("docs"))
    numbered = F.transform("docs", lambda d, i: F.struct(F.struct(d["h"].alias("h"), i.cast("long").alias("n")).alias("key"), d["size"].cast("double").alias("size"), d["p"].alias("p")))
    live = F.filter(numbered, lambda d: d["p"].isNotNull())
    leaves = leaves.withColumn("live", live).withColumn("out", F.when(F.size("live") > 0, _reduce_leaf(F.col("live")))).drop("live")
    leaves = cut(leaves)

    # residuals climb the tree; a leaf's open document keeps the leaf's number as its key
    tree = leaves.where("out is not null").select("source", "leaf", F.col("leaf").alias("node"), F.col("out.open").alias("open"))
    tree = tree.select("source", "node", F.struct(F.struct(F.col("open.key.h").alias("h"), F.col("leaf").alias("n")).alias("key"), F.col("open.size").alias("size"), F.col("open.p").alias("p")).alias("open"))
    width = (leaves.agg(F.max("leaf")).first()[0] or 0) + 1
    settled = None
    while True:
        tree = tree.groupBy("source", F.expr(f"node div {fan}").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("open.size")).alias("order"), "open"))), lambda x: x["open"]).alias("open")).withColumn("out", _reduce(F.col("open")))
        tree = cut(tree.select("source", "node", "out"))
        here = tree.select("source", F.explode("out.done").alias("d")).select("source", F.col("d.key.n").alias("leaf"), F.col("d.extra").alias("last"))
        settled = here if settled is None else settled.unionByName(here)
        tree = tree.select("source", "node", F.col("out.open").alias("open"))
        width = -(-width // fan)
        if width == 1:
            break
    coin = F.pmod(F.xxhash64("open.key.h", "source", F.lit("root")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    settled = settled.unionByName(tree.select("source", F.col("open.key.n").alias("leaf"), (coin < F.col("open.p")).cast("int").alias("last")))
    settled = settled.withColumnRenamed("source", "of").withColumnRenamed("leaf", "of_leaf")

    joined = leaves.join(settled, F.col("source").eqNullSafe(F.col("of")) & (F.col("leaf") == F.col("of_leaf")), "left")
    extras = F.map_from_entries(F.transform(F.col("out.done"), lambda d: F.struct(d["key"]["n"], d["extra"])))
    joined = joined.withColumn("extras", extras)
    each = joined.select(*same, "last", "extras", F.posexplode("docs").alias("i", "d"))
    # an open document that no node settled is the leaf's last one
    extra = F.when(F.col("d.p").isNull(), 0).otherwise(F.coalesce(F.col("extras")[F.col("i").cast("long")], F.col("last"), F.lit(0)))
    copies = F.when(F.col("d.size") == 0, 0).otherwise(F.col("sure") + extra)
    return each.select(F.col("d.doc_id").alias("doc_id"), F.col("d.size").alias("size"), "source_size", "target", (F.col("d.size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies"), *([] if carry is None else [F.col("d.carry").alias("carry")]))


def repeat_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it; columns of any name pass through. Rows equal in all columns share what they are taken together."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), row_key(df).alias("key"), whole_row(df).alias("row"))
    taken = mix(rows, id_col="id", carry=F.col("key"), **settings)
    times = taken.groupBy(F.col("carry").alias("key")).agg(F.sum("copies").alias("times")).where("times > 0")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    once = rows.select("key", "row").withColumn("nth", nth).where("nth = 1").drop("nth")
    return repeated(once.join(times, "key"), "times", "nth").select("row.*")
