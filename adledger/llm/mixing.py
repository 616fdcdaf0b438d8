"""Mixing sources to target weights: exact block quotas dealt to output shards by a splitting tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger.llm.common import cut, stored
from adledger.operators.scan import in_ranges, numbered, part_starts, running

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
BLOCK_WORDS = 4096
SHARD_BLOCKS = 1024
SEED = 11
#: Steps of affine permutations, as fixed primes: larger than any number of blocks, so coprime to it.
PRIMES = (2305843009213693951, 1125899906842597, 1152921504606846883)


# --- targets ----------------------------------------------------------------

def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, rank, source_size, weight, target) from (source, source_size), one row per source.

    Sources in code point order, null last, get ``weights`` in turn; together they share
    ``share`` times all words. A target stops at ``epochs`` times its source, and the excess
    goes to the others by weight until none is above: a level of words per weight that rises
    while the set of full sources grows. The driver reads two numbers per round.
    """
    ranked = numbered(sizes.withColumn("_last", F.col("source").isNull()), [], [F.col("_last"), F.col("source")], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    plan = stored(ranked.drop("_last").withColumn("weight", weight.cast("double")), "sources")
    wanted = share * (plan.agg(F.sum("source_size")).first()[0] or 0)
    most = F.col("source_size") * F.lit(float(epochs))
    level, full = 0.0, None
    while True:
        over = most < F.lit(level) * F.col("weight")
        taken, open_weight = plan.agg(F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)),
                                      F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if (taken, open_weight) == full or not open_weight:
            break
        full = (taken, open_weight)
        level = (wanted - taken) / open_weight
    return plan.withColumn("target", F.when(most < F.lit(level) * F.col("weight"), most).otherwise(F.lit(level) * F.col("weight")))


def quotas(plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``plan`` with quota (words to take), blocks (of one pass), short (words of a last short
    block, 0 if none), passes (whole ones), rest (words of the next pass) and draws (blocks to draw)."""
    size = F.col("source_size")
    out = plan.withColumns({
        "quota": F.floor(F.col("target") + F.lit(0.5)).cast("bigint"),
        "blocks": F.ceil(size / F.lit(block_words)).cast("bigint"),
        "short": (size % block_words).cast("bigint"),
    })
    out = out.withColumns({
        "passes": F.when(size > 0, F.expr("quota div source_size")).otherwise(F.lit(0)).cast("bigint"),
        "rest": F.when(size > 0, F.col("quota") % size).otherwise(F.lit(0)).cast("bigint"),
    })
    return out.withColumn("draws", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / F.lit(block_words)).cast("bigint"))


# --- splitting tree ---------------------------------------------------------

def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked among ``drawn`` of ``population`` for a uniform ``u``: the inverse distribution.

    Weights follow each other by their ratio, from 12 deviations below the mode to 12 above,
    or the ends of the range; what lies outside is below the precision of a double.
    """
    big_n, big_k, n = (c.cast("double") for c in (population, marked, drawn))
    least = F.greatest(F.lit(0).cast("bigint"), drawn + marked - population)
    most = F.least(drawn, marked)
    mode = F.floor((n + 1) * (big_k + 1) / (big_n + 2)).cast("bigint")
    whole = F.greatest(big_n, F.lit(1.0))
    spread = n * (big_k / whole) * ((big_n - big_k) / whole) * ((big_n - n) / F.greatest(big_n - 1, F.lit(1.0)))
    reach = (F.sqrt(F.greatest(spread, F.lit(0.0))) * 12 + 12).cast("bigint")
    low, high = F.greatest(least, mode - reach), F.least(most, mode + reach)
    steps = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))

    def gain(x: Column) -> Column:
        y = x.cast("double")
        return F.log((big_k - y) * (n - y) / ((y + 1) * (big_n - big_k - n + y + 1)))

    def more(state: Column, x: Column) -> Column:
        at = state["at"] + gain(x)
        top = F.greatest(state["top"], at)
        return F.struct(at.alias("at"), top.alias("top"),
                        (state["sum"] * F.exp(state["top"] - top) + F.exp(at - top)).alias("sum"))

    zero = F.lit(0.0)
    total = F.aggregate(steps, F.struct(zero.alias("at"), zero.alias("top"), F.lit(1.0).alias("sum")), more)

    def found(whole: Column) -> Column:
        goal = u * whole["sum"]

        def step(state: Column, x: Column) -> Column:
            at = state["at"] + gain(x)
            return F.struct(at.alias("at"), (state["sum"] + F.exp(at - whole["top"])).alias("sum"),
                            F.when(state["sum"] < goal, x + 1).otherwise(state["x"]).alias("x"))

        first = F.struct(zero.alias("at"), F.exp(-whole["top"]).alias("sum"), low.alias("x"))
        return F.aggregate(steps, first, step)["x"]

    return F.element_at(F.transform(F.array(total), found), 1)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that follows from ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def split_once(nodes: DataFrame, seed: int) -> DataFrame:
    """Each node (lo, shards, left, before) of two or more shards as its two halves.

    ``left`` has the blocks of each source that the node still has to place, ``before`` those
    that shards left of it take. The left half gets an even share of all blocks; how many
    of each source is a multivariate hypergeometric draw, source by source.
    """
    total = F.aggregate("left", F.lit(0).cast("bigint"), lambda a, x: a + x)
    half = F.ceil(F.col("shards") / F.lit(2)).cast("bigint")
    node = nodes.withColumns({"_total": total, "_half": half})
    node = node.withColumn("_room", F.expr("_total div shards * _half + _total % shards * _half div shards"))

    def draw(state: Column, i: Column) -> Column:
        marked = F.element_at("left", (i + 1).cast("int"))
        got = hypergeometric(state["population"], marked, state["room"], uniform(F.lit(seed), F.col("lo"), F.col("shards"), i))
        # evaluated once, then used three times
        return F.element_at(F.transform(F.array(got), lambda g: F.struct(
            (state["population"] - marked).alias("population"), (state["room"] - g).alias("room"),
            F.concat(state["got"], F.array(g)).alias("got"))), 1)

    start = F.struct(F.col("_total").alias("population"), F.col("_room").alias("room"), F.array().cast("array<bigint>").alias("got"))
    node = node.withColumn("_got", F.aggregate(F.sequence(F.lit(0), F.size("left") - 1), start, draw)["got"])
    lower = F.struct(F.col("lo").alias("lo"), F.col("_half").alias("shards"), F.col("_got").alias("left"), F.col("before").alias("before"))
    upper = F.struct((F.col("lo") + F.col("_half")).alias("lo"), (F.col("shards") - F.col("_half")).alias("shards"),
                     F.zip_with("left", "_got", lambda a, b: a - b).alias("left"),
                     F.zip_with("before", "_got", lambda a, b: a + b).alias("before"))
    return node.select(F.inline(F.array(lower, upper)))


def deal(plan: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(rank, draw, shard): the shard of each drawn block of each source.

    One row per source in an array: the weights are a table that a user writes. The tree has a
    row per node; levels are cut, so a level's rows are spread over tasks.
    """
    whole = plan.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "draws"))), lambda s: s["draws"]).alias("left"))
    nodes = whole.where(F.size("left") > 0).select(F.lit(0).cast("bigint").alias("lo"), F.lit(shards).cast("bigint").alias("shards"), "left",
                         F.transform("left", lambda x: F.lit(0).cast("bigint")).alias("before"))
    done = None
    for _ in range((shards - 1).bit_length()):
        nodes = cut(split_once(nodes.where("shards > 1"), seed).repartition("lo"))
        ready = nodes.where("shards = 1")
        done = ready if done is None else done.unionByName(ready)
    done = nodes if done is None else done
    each = done.select(F.col("lo").alias("shard"), F.posexplode(F.arrays_zip("left", "before")).alias("rank", "part"))
    each = each.where("part.left > 0").select("shard", F.col("rank").cast("bigint").alias("rank"), F.explode(F.sequence(
        F.col("part.before"), F.col("part.before") + F.col("part.left") - 1)).alias("draw"))
    return each


# --- pieces -----------------------------------------------------------------

def permuted(block: Column, whole: Column, epoch: Column, rank: Column, seed: int) -> Column:
    """Place of ``block`` in a permutation of 0 .. whole - 1, another one for each source and epoch."""
    step = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(F.xxhash64(F.lit(seed), epoch, rank), F.lit(len(PRIMES))) + 1).cast("int"))
    shift = F.pmod(F.xxhash64(F.lit(seed + 1), epoch, rank), F.greatest(whole, F.lit(1)))
    product = block.cast("decimal(19,0)") * F.pmod(step, F.greatest(whole, F.lit(1))).cast("decimal(19,0)")
    return ((product + shift) % F.greatest(whole, F.lit(1))).cast("bigint")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, shards: int | None = None,
        block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of all ``docs``: its documents and its pieces.

    Documents: row, doc_id, source, size (words), source_size, target, one per input row.
    Pieces: row, doc_id, shard, place (order inside the shard), epoch, first_word, n_words.
    The documents of a source, in an order by hash, form a line of words that is cut in blocks;
    a pass over the line is an epoch. Whole passes are taken first, then permuted blocks of the
    next until the quota of words is met exactly; so no word is taken more than ``EPOCHS``
    times. Which shard a drawn block goes to follows the splitting tree. A null text has no
    words; a null source is one more source, last in order; repeated rows are rows of their
    own; an empty table gives empty results. Other columns are ignored. Reruns agree. ``shards``
    defaults to one per ``SHARD_BLOCKS`` blocks.
    """
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64("text").alias("_h"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key")
    rows = stored(read.select("*", key, F.monotonically_increasing_id().alias("row")), "sizes")
    order = [F.xxhash64(F.lit(seed), "doc_id", "_h"), F.col("doc_id"), F.col("_h"), F.col("row")]
    ranged = in_ranges(rows, ["key"], order)
    starts = part_starts(ranged, ["key"], F.col("size"))
    sizes = stored(starts.groupBy("key").agg(F.sum("_sum").alias("source_size")), "sources")
    named = sizes.withColumn("source", F.when(F.col("key") != "", F.expr("substring(key, 2)")))
    plan = stored(quotas(targets(named, weights, share), block_words), "plan")
    if shards is None:
        shards = max(1, -(-(plan.agg(F.sum("draws")).first()[0] or 0) // SHARD_BLOCKS))
    starts = starts.join(plan.drop("source"), "key")
    placed = stored(running(ranged, starts, ["key"], order, "start", F.col("size")), "line")
    documents = placed.select("row", "doc_id", "source", "size", "source_size", "target")
    width = F.lit(block_words)
    spans = placed.where("size > 0 and (passes > 0 or rest > 0)").select(
        "row", "doc_id", "rank", "start", "size", "blocks", "short", "passes", "rest",
        F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block"))
    last = F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1)
    spans = spans.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("epoch"))
    whole = F.col("blocks") - F.when(F.col("short") > 0, 1).otherwise(0)
    # a short last block stays last
    turn = F.when(F.col("block") < whole, permuted(F.col("block"), whole, F.col("epoch"), F.col("rank"), seed)).otherwise(F.col("block"))
    spans = spans.withColumn("turn", turn)
    # words of the block that the quota reaches: all, but for the last block drawn
    reach = F.when(F.col("epoch") < F.col("passes"), width).otherwise(F.greatest(F.lit(0), F.least(width, F.col("rest") - F.col("turn") * width)))
    begin = F.greatest(F.col("start"), F.col("block") * width)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * width + reach)
    pieces = spans.withColumns({"first_word": begin - F.col("start"), "n_words": end - begin}).where("n_words > 0").select(
        "row", "doc_id", "rank", "epoch", "first_word", "n_words", (F.col("epoch") * F.col("blocks") + F.col("turn")).alias("draw"))
    dealt = pieces.join(deal(plan, shards, seed), ["rank", "draw"])
    return documents, dealt.select("row", "doc_id", "shard", F.xxhash64(F.lit(seed), "shard", "row", "epoch").alias("place"),
                                   "epoch", "first_word", "n_words")


def shuffled(pieces: DataFrame) -> DataFrame:
    """Pieces in the order of output: each shard whole in one partition, shuffled inside by ``place``.

    A shard holds about SHARD_BLOCKS blocks whatever the input.
    """
    return pieces.repartition("shard").sortWithinPartitions("shard", "place", "row", "first_word")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: words that the mix takes, one row per input row."""
    documents, pieces = mix(docs, **options)
    sums = pieces.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return documents.join(sums, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
