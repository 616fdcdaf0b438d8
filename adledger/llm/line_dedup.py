"""Line dedup by prefix doubling over line-id sequences, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger.llm.common import cut, once, stored
from adledger.operators.skew import lookup

MIN_LINES = 2
#: Characters from which a single repeated line goes too; shorter ones (list marks, braces, headings) are
#: part of the form of a text and go only within longer runs.
LONG_LINE = 20
DOC = ["did", "_h"]
SUFFIX = [*DOC, "pos"]
NO_ID = -(1 << 63)


def _salt() -> Column:
    """By document and line, so that a line at the same place in many documents is spread."""
    return F.xxhash64(*SUFFIX)


def line_ids(docs: DataFrame) -> DataFrame:
    """(did, _h, pos, r, chars): rank of each line that is seen more than once, and its length, by distinct document.

    Contents are compared once: a set per XXH64, combined in the map tasks. Lines then go by
    the hash; lines whose hash has several contents alone also by content.
    """
    lines = docs.select(*DOC, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    hashed = lines.withColumn("_b", F.xxhash64("line"))
    sets = hashed.groupBy("_b").agg(F.sort_array(F.collect_set("line")).alias("set"), F.count("*").alias("n")).where("n > 1")
    names = stored(sets.select("_b", F.posexplode("set").alias("_o", "line"), (F.size("set") > 1).alias("clash"))
                   .select("_b", "_o", F.char_length("line").alias("chars"), F.when(F.col("clash"), F.col("line")).alias("line")), "lines")
    ranks = cut(names.orderBy("_b", "_o").select("_b", "_o", "chars", F.monotonically_increasing_id().alias("r")))
    clashing = names.where(F.col("line").isNotNull())
    if clashing.limit(1).count():
        told = hashed.join(clashing.select("_b").distinct(), "_b", "left_semi").join(clashing.drop("chars"), ["_b", "line"]).select(*SUFFIX, "_b", "_o")
        keyed = hashed.join(clashing.select("_b").distinct(), "_b", "left_anti").select(*SUFFIX, "_b", F.lit(0).alias("_o")).union(told)
    else:
        keyed = hashed.select(*SUFFIX, "_b", F.lit(0).alias("_o"))
    return cut(lookup(keyed, ranks, ["_b", "_o"], _salt()).where(F.col("r").isNotNull()).select(*SUFFIX, "r", "chars"))


def _at(ranks: DataFrame, shift, name: str) -> DataFrame:
    """Ranks as the suffix ``shift`` lines earlier sees them."""
    return ranks.select(*DOC, (F.col("pos") - shift).cast("int").alias("pos"), F.col("r").alias(name))


def doubled(ranks: DataFrame, length: int) -> DataFrame:
    """Ranks by the first 2 * ``length`` lines, for suffixes that share them with another.

    The order of the new ranks is that of (rank, rank ``length`` lines on): the suffix
    array by 2 * ``length`` lines, in which equal ranks are an interval of common prefix.
    """
    pairs = cut(ranks.select(*SUFFIX, "r").join(_at(ranks, length, "r2"), SUFFIX))
    many = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1")
    named = cut(many.orderBy("r", "r2").select("r", "r2", F.monotonically_increasing_id().alias("name")))
    return cut(lookup(pairs, named, ["r", "r2"], _salt()).where(F.col("name").isNotNull()).select(*SUFFIX, F.col("name").alias("r")))


def levels(first: DataFrame) -> list[DataFrame]:
    """Rank tables by 1, 2, 4, ... lines, until no two suffixes share so many."""
    out = []
    while first.limit(1).count():
        out.append(first)
        first = doubled(first, 1 << (len(out) - 1))
    return out


def run_scales(tables: list[DataFrame]) -> DataFrame:
    """(did, _h, run_scale): the widest interval a suffix of the document lies in, as a power of two."""
    widths = [t.select(*DOC).distinct().withColumn("width", F.lit(1 << k).cast("bigint")) for k, t in enumerate(tables)]
    return reduce(DataFrame.union, widths).groupBy(*DOC).agg(F.max("width").alias("run_scale"))


def classes_of(tables: list[DataFrame], lines: int) -> DataFrame | None:
    """(did, _h, pos, r): classes of suffixes that agree in the first ``lines`` lines, by the tables
    of the binary digits of ``lines``; None if there is no such class."""
    current, length = None, 0
    for k in range(lines.bit_length()):
        if not lines >> k & 1:
            continue
        if k >= len(tables):
            return None
        if current is None:
            current, length = tables[k], 1 << k
        else:
            pairs = cut(current.select(*SUFFIX, "r").join(_at(tables[k], length, "r2"), SUFFIX))
            named = cut(pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1").select(
                "r", "r2", F.monotonically_increasing_id().alias("name")))
            current = cut(lookup(pairs, named, ["r", "r2"], _salt()).where(F.col("name").isNotNull()).select(*SUFFIX, F.col("name").alias("r")))
            length += 1 << k
    return current


def later_copies(tables: list[DataFrame], min_lines: int, long_line: int) -> DataFrame | None:
    """(did, _h, pos, width): for each suffix the widest interval of common prefix in which it is not
    the first by (document, line), that is, how many lines from there stand earlier as well.

    Widths are ``min_lines``, the powers of two above it, and 1 for lines of ``long_line``
    characters or more. Windows of a maximal repeated run cover all of it, and nothing else.
    """
    classes = [(1 << k, t) for k, t in enumerate(tables) if 1 << k > min_lines]
    least = classes_of(tables, min_lines)
    if least is not None:
        classes.append((min_lines, least))
    if min_lines > 1 and tables:
        classes.append((1, tables[0].where(F.col("chars") >= long_line)))
    found = []
    for width, ranks in classes:
        first = cut(ranks.groupBy("r").agg(F.min(F.struct(*SUFFIX)).alias("first")))
        found.append(lookup(ranks, first, "r", _salt()).where(F.struct(*SUFFIX) != F.col("first")).select(
            *SUFFIX, F.lit(width).alias("width")))
    return reduce(DataFrame.union, found).groupBy(*SUFFIX).agg(F.max("width").alias("width")) if found else None


def remove_repeats(docs: DataFrame, min_lines: int = MIN_LINES, with_text: bool = False, long_line: int = LONG_LINE) -> DataFrame:
    """doc_id, n_lines, n_removed, run_scale, kept_sha256 and (``with_text``) kept_text per row.

    Lines end at newline characters. A run of ``min_lines`` or more lines that also stands
    earlier, by (doc_id, line number), is deleted, and so is a single such line of ``long_line``
    or more characters; what remains is joined by newlines.
    run_scale is the largest power of two such that a run of so many lines of the document
    stands at another place of the corpus too, 0 if none.

    Null and empty texts have one empty line; a null doc_id comes first; rows that repeat
    id and text are one document and get the same result; runs may overlap their copy.
    Suffixes that share no prefix leave the doubling, so its rounds shrink; joins are on
    (document, position), and ranks of common lines are looked up by salted keys.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    tables = levels(line_ids(once(rows, DOC)))
    later = later_copies(tables, min_lines, long_line)
    nothing = rows.limit(0).select(*DOC, F.array().cast("array<int>").alias("gone"))
    if later is None:
        gone = nothing
    else:
        covered = later.select(*DOC, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("width") - 1)).alias("pos")).distinct()
        gone = cut(covered.groupBy(*DOC).agg(F.collect_list("pos").alias("gone")))
    runs = run_scales(tables) if tables else \
        rows.limit(0).select(*DOC, F.lit(0).cast("bigint").alias("run_scale"))
    told = cut(gone.join(runs, DOC, "full"))
    whole = rows.join(told, DOC, "left").withColumn("lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    text = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return whole.select(
        F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("run_scale", F.lit(0).cast("bigint")).alias("run_scale"), F.sha2(text, 256).alias("kept_sha256"),
        *([text.alias("kept_text")] if with_text else []))
