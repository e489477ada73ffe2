"""Line dedup by an exact set-similarity join, in DataFrame operations only.

Lines are cut at newlines and tokenised into lower-cased words; equal lines are one
class, which its first line stands for.  Tokens are ordered by rarity: each one's
hash leads to one of COUNTERS counters of all tokens' occurrences, eight in a number
of a table of fixed size that goes to every task.  The order is the same for every
line, so that it decides about cost alone.

With tokens in that order, two sets of Jaccard similarity t or more share a token
among the first n - ceil(t n) + 1 of the larger one and the first n -
ceil(2 t n / (1 + t)) + 1 of the smaller.  These prefixes are joined on the token; the
length filter, the positional filter, and one on 128 parity bits of each set discard
pairs within the join, the rest is verified on the full sets.

A line goes if an earlier line (by key and place) is similar, whether or not that
one stays, so that one earlier partner is enough.  A first round compares each line
with the earliest lines of the last two tokens of its prefix alone, which near copies
share where the rarest are their own.  What it finds asks no more.  Tokens of many lines then have rounds of their own: each line that still asks
meets the earliest such line of each, as long as a round finds some.  The next round
compares what still asks with all that share a token, and gives on the likeliest
partner of each line alone, combined where the join finds it.  Lines whose likeliest
partner is not similar, though there are others, meet these in a last round that
checks the full sets within the join, and gives on the lines that go.  No round writes
all pairs of a group.

Where a step needs the rows of some lines or tokens alone, a filter of bounded size,
made of their hashes, keeps most others out of the join that decides.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm._stage import Stages

#: Numbers in a table that goes to every task, at most; counters of token occurrences, eight in one of them; parts of the tokens, joined one after another.
TABLE, COUNTERS, PASSES = 1 << 18, 1 << 21, 2
#: Parts of the codes in the last round, in which each entry has its line's whole set beside it.
SET_PASSES = 4
#: Pairs that the last round may write for each distinct line; beyond, it has the sets beside the entries instead.
PAIRS = 1

#: A token of this level (occurrences as a power of 1.25) or more, and of so many times the mean counter, has rounds of its own, the next one as long as one finds so many lines, and the root of all lines.
HOT_LEVEL, HOT_MEANS, SOME = 28, 4, 64


def _plain(text: Column) -> Column:
    """Lower-cased, all white space but newlines as spaces: lines that differ in nothing else have the same tokens.  ASCII lines are lowered faster than a text that is not all ASCII."""
    for gap in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(gap), F.lit(" "))
    return F.lower(text)


def _words(line: Column) -> Column:
    """Words of a plain line; empty ones among them."""
    return F.split(line, " ")


def _tokens(line: Column) -> Column:
    """Distinct 64-bit token hashes of a plain line."""
    return F.array_remove(F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _least_shared(percent: int, n: Column) -> Column:
    """The least number of tokens that a set of n shares with a similar one."""
    return F.floor((F.lit(percent) * n + 99) / 100).cast("int")


def _least_shared_smaller(percent: int, n: Column) -> Column:
    """The same with a similar one of n tokens or more."""
    return F.floor((F.lit(2 * percent) * n + (99 + percent)) / (100 + percent)).cast("int")


def _lines(stages: Stages, docs: DataFrame) -> DataFrame:
    """(row, doc_id, text) to a written table of lines: at (their order by key, row, place), row, doc_id, line_no, worded, two hashes of the plain line, and that line if worded."""
    ordered = docs.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    lines = ordered.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", _plain(F.col("line")))
    worded = F.length(F.btrim("line")) > 0
    names = F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), "line", F.length("line")).alias("h2")
    return stages.keep(lines.select(F.monotonically_increasing_id().alias("at"), "row", "doc_id", "line_no", worded.alias("worded"), *names, F.when(worded, F.col("line")).alias("line")))


def _level(count: Column) -> Column:
    return F.least(F.lit(93), F.floor(F.log(F.greatest(count, F.lit(1))) / F.log(F.lit(1.25)))).cast("long")


def _shifted(way: str, number: Column, bits: Column) -> Column:
    return F.call_function(way, number, bits.cast("int"))


def _table(stages: Stages, numbers: DataFrame, size: int) -> Column:
    """Of rows (id, number) with ids below size an array that is folded into one literal; 0 where there is none."""
    every = ["0"] * size
    parts = numbers.groupBy(F.shiftright("id", 12).alias("segment")).agg(F.concat_ws(" ", F.collect_list(F.concat_ws(":", "id", "number"))).alias("held"))
    with stages.clean():
        for r in parts.collect():
            for pair in r["held"].split(" "):
                i, number = pair.split(":")
                every[int(i)] = number
    return F.split(F.lit(",".join(every)), ",").cast("array<bigint>")


def _among(stages: Stages, values: DataFrame) -> Callable[[Column], Column]:
    """For a column of numbers whether each may be among the values: all of these may, of others few, unless the values are far more than the bits."""
    value = F.col(values.columns[0])
    size = min(TABLE, max(64, 1 << (values.count() >> 2).bit_length()))  # 16 bits a value or more

    def slot(value: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(value), 6).bitwiseAND(size - 1)

    def bit(value: Column) -> Column:
        return _shifted("shiftleft", F.lit(1).cast("long"), F.xxhash64(value).bitwiseAND(63))

    held = _table(stages, values.groupBy(slot(value).alias("id")).agg(F.bit_or(bit(value)).alias("number")), size)
    return lambda column: F.get(held, slot(column)).bitwiseAND(bit(column)) != 0


def _only(rows: DataFrame, wanted: DataFrame, may: Callable[[Column], Column], on: str = "at") -> DataFrame:
    """The rows whose value is among the wanted ones, of which may is the filter."""
    return rows.where(may(F.col(on))).join(wanted.distinct().hint("merge"), on, "left_semi")


def _levels(stages: Stages, distinct: DataFrame) -> tuple[Column, int]:
    """For each counter the logarithm of its tokens' occurrences, eight in a number; the level from which a token is frequent."""
    words = distinct.select(F.explode(_words(F.col("line"))).alias("w")).where("w <> ''")
    sums = stages.keep(words.groupBy(F.xxhash64("w").bitwiseAND(COUNTERS - 1).alias("counter")).count())
    lane = F.shiftright("counter", (TABLE - 1).bit_length()) * 8
    numbers = sums.groupBy(F.col("counter").bitwiseAND(TABLE - 1).alias("id")).agg(F.bit_or(_shifted("shiftleft", _level(F.col("count")), lane)).alias("number"))
    levels = _table(stages, numbers, TABLE)
    total = sums.groupBy().sum("count").first()[0] or 0
    stages.drop(sums)
    return levels, max(HOT_LEVEL, math.ceil(math.log(max(1, HOT_MEANS * total / COUNTERS), 1.25)))


def _coded(stages: Stages, distinct: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """(at, n, low, high, prefix): 128 parity bits of the token set; codes of its rarest tokens, by rarity.  The level from which these are frequent."""
    levels, frequent = _levels(stages, distinct)

    def code(token: Column) -> Column:
        lane = F.shiftright(token, (TABLE - 1).bit_length() - 3).bitwiseAND(56)
        level = _shifted("shiftright", F.get(levels, token.bitwiseAND(TABLE - 1)), lane).bitwiseAND(127)
        return F.shiftleft(level, 56).bitwiseOR(F.shiftrightunsigned(token, 8))

    coded = distinct.select("at", F.sort_array(F.transform(_tokens(F.col("line")), code)).alias("codes")).withColumn("n", F.size("codes"))
    powers, none = [1 << i if i < 63 else -(1 << 63) for i in range(64)], [0] * 64
    low, high = (F.array(*[F.lit(x).cast("long") for x in table]) for table in (powers + none, none + powers))

    def parity(powers: Column) -> Column:
        return F.aggregate("codes", F.lit(0).cast("long"), lambda x, c: x.bitwiseXOR(F.get(powers, c.bitwiseAND(127))))

    bits = parity(low).alias("low"), parity(high).alias("high")
    return stages.keep(coded.select("at", "n", *bits, F.slice("codes", F.lit(1), F.col("n") - _least_shared(percent, F.col("n")) + 1).alias("prefix"))), frequent


def _fields(side: str, packed: bool) -> dict[str, Column]:
    if not packed:
        return {c: F.col(f"{side}_{c}") for c in ("at", "n", "place", "low", "high")}
    m = F.col(f"{side}_m")
    unpacked = {"n": F.shiftright(m, 32), "place": F.shiftright(m.bitwiseAND((1 << 32) - 1), 1), "asks": m.bitwiseAND(1)}
    return {c: F.col(f"{side}_{c}") for c in ("at", "low", "high")} | unpacked


def _may_be_similar(percent: int, packed: bool = False) -> Column:
    """Of x and y that share the token at their places: length, positional and parity filter."""
    x, y = (_fields(s, packed) for s in "xy")
    both = x["n"] + y["n"]
    most = F.least(x["place"], y["place"]) + F.least(x["n"] - x["place"], y["n"] - y["place"])
    alike = both - _unlike()  # at least twice the tokens shared
    sizes = (F.lit(percent) * x["n"] <= 100 * y["n"]) & (F.lit(percent) * y["n"] <= 100 * x["n"])
    return sizes & ((100 + percent) * alike >= 2 * percent * both) & ((100 + percent) * most >= percent * both)


def _unlike() -> Column:
    """The number of parity bits in which x and y differ: so many tokens at least are in one of them only."""
    return F.bit_count(F.col("x_low").bitwiseXOR(F.col("y_low"))) + F.bit_count(F.col("x_high").bitwiseXOR(F.col("y_high")))


def _asked(percent: int) -> Column:
    """Each two once, x the larger set, the token in the shorter prefix of y, and no partner known of the later one."""
    x, y = (_fields(s, True) for s in "xy")
    open_ = F.when(x["at"] > y["at"], x["asks"]).otherwise(y["asks"]) == 1
    return _larger(x, y) & _in_shorter(percent, y) & open_


def _larger(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Whether x is the larger set, or the later one of two of one size."""
    return (x["n"] > y["n"]) | ((x["n"] == y["n"]) & (x["at"] > y["at"]))


def _in_shorter(percent: int, y: dict[str, Column]) -> Column:
    """Whether the token is in the prefix that a set needs towards larger ones."""
    return y["place"] <= y["n"] - _least_shared_smaller(percent, y["n"])


def _meets(percent: int) -> Column:
    """Of x that asks and y that share the token: y is earlier, and the two meet as in _asked."""
    x, y = (_fields(s, False) for s in "xy")
    return (y["at"] < x["at"]) & F.when(_larger(x, y), _in_shorter(percent, y)).otherwise(_in_shorter(percent, x)) & _may_be_similar(percent)


def _entries(coded: DataFrame) -> DataFrame:
    """A row for each code of each prefix."""
    return coded.select("*", F.posexplode("prefix").alias("place", "code")).drop("prefix")


def _side(entries: DataFrame, side: str) -> DataFrame:
    return entries.select("code", *[F.col(c).alias(f"{side}_{c}") for c in entries.columns if c != "code"])


def _candidate(found: DataFrame) -> DataFrame:
    """(later, best, worst, met): of all pairs of each later line those that differ in the fewest and the most parity bits, with these bits above bit 56 of the earlier line's place; how often it met one."""
    key = F.shiftleft(F.least(_unlike(), F.lit(127)).cast("long"), 56).bitwiseOR(F.least("x_at", "y_at"))
    return found.select(F.greatest("x_at", "y_at").alias("later"), key.alias("best")).groupBy("later").agg(F.min("best").alias("best"), F.max("best").alias("worst"), F.count("*").alias("met"))


def _partner(best: Column) -> Column:
    return best.bitwiseAND((1 << 56) - 1)


def _sets(stages: Stages, distinct: DataFrame, at: DataFrame) -> DataFrame:
    at = at.distinct()
    return stages.keep(_only(distinct.select("at", "line"), at, _among(stages, at)).select("at", _tokens(F.col("line")).alias("tokens")))


def _similar_sets(percent: int) -> Column:
    """Whether s and t, of x_n and y_n tokens, are similar."""
    return (100 + percent) * F.size(F.array_intersect("s", "t")) >= percent * (F.col("x_n") + F.col("y_n"))


def _similar(stages: Stages, distinct: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """at of the later ones of pairs (later, earlier), one of each later line, whose full sets are similar."""
    return _verified(stages, distinct, pairs, percent)


def _verified(stages: Stages, distinct: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """at of the later ones of a written table of pairs (later, earlier) whose full sets are similar."""
    sets = _sets(stages, distinct, pairs.select(F.col("later").alias("at")).union(pairs.select("earlier")))
    one = sets.select(F.col("at").alias("later"), F.col("tokens").alias("s"), F.size("tokens").alias("x_n"))
    two = sets.select(F.col("at").alias("earlier"), F.col("tokens").alias("t"), F.size("tokens").alias("y_n"))
    wide = pairs.join(one.hint("merge"), "later").join(two.hint("merge"), "earlier")
    out = stages.keep(wide.where(_similar_sets(percent)).select(F.col("later").alias("at")).distinct())
    stages.drop(sets)
    return out


def _others(stages: Stages, distinct: DataFrame, coded: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """at of the lines of open_ (at, met) that are similar to any earlier line.

    Where all of them together meet no more than PAIRS times the number of lines,
    these pairs are written; else full sets are compared within the join, true
    ones alone leave it.
    """
    few = (open_.groupBy().sum("met").first()[0] or 0) <= PAIRS * distinct.count()
    open_ = open_.select("at")
    asking = stages.keep(_entries(_only(coded, open_, _among(stages, open_))))
    codes = asking.select("code").distinct()
    shared = _among(stages, codes)
    met = _side(asking, "x").join(_side(_entries(coded).where(shared(F.col("code"))), "y").hint("merge"), "code").where(_meets(percent))
    if few:
        pairs = stages.keep(met.select(F.col("x_at").alias("later"), F.col("y_at").alias("earlier")).distinct())
        out = _verified(stages, distinct, pairs, percent)
        stages.drop(asking, pairs)
        return out
    # Earlier lines that may be similar to one that asks: of these alone are the sets needed.
    near = stages.keep(met.select(F.col("y_at").alias("at")).distinct())
    members = stages.keep(_only(_entries(_only(coded, near, _among(stages, near))), codes, shared, "code"))
    sets = _sets(stages, distinct, near.unionByName(asking.select("at")))
    # Each entry takes its line's whole set along: one part of the codes at a time, and in each only lines that no part before has found.
    found = None
    for i in range(SET_PASSES):
        mine = F.pmod(F.col("code"), F.lit(SET_PASSES)) == i
        still = asking.where(mine) if found is None else asking.where(mine).join(found.hint("merge"), "at", "left_anti")
        x = _side(still, "x").join(sets.select(F.col("at").alias("x_at"), F.col("tokens").alias("s")).hint("merge"), "x_at")
        y = _side(members.where(mine), "y").join(sets.select(F.col("at").alias("y_at"), F.col("tokens").alias("t")).hint("merge"), "y_at")
        true = x.join(y.hint("merge"), "code").where(_meets(percent) & _similar_sets(percent))
        newly = stages.keep(true.select(F.col("x_at").alias("at")).distinct())
        found = newly if found is None else found.unionByName(newly)
    stages.drop(asking, near, members, sets)
    return found


def _by_heads(stages: Stages, distinct: DataFrame, entries: DataFrame, percent: int, least: int = 1) -> DataFrame | None:
    """at of lines that are similar to the earliest line of one of their tokens: of those that may be, the likeliest is tried.  None where fewer lines than the least may be similar."""
    head = entries.groupBy("code").agg(F.min("at").alias("y_at"), *[F.min_by(c, "at").alias(f"y_{c}") for c in ("n", "place", "low", "high")])
    near = _side(entries, "x").join(head, "code").where((F.col("y_at") < F.col("x_at")) & _may_be_similar(percent))
    pairs = stages.keep(_candidate(near).select("later", _partner(F.col("best")).alias("earlier")))
    out = _similar(stages, distinct, pairs, percent) if least <= 1 or pairs.count() >= least else None
    stages.drop(pairs)
    return out


def _gone(stages: Stages, distinct: DataFrame, percent: int) -> DataFrame:
    """at of the distinct lines that are similar to an earlier one."""
    coded, frequent = _coded(stages, distinct, percent)
    # First round: the earliest line of each of two tokens.
    few = _entries(coded.withColumn("last", F.size("prefix") - 2)).where("place >= last").drop("last")
    found = _by_heads(stages, distinct, few, percent)
    # Rounds of frequent tokens.
    hot = stages.keep(_entries(coded).where(F.shiftright("code", 56) >= frequent))
    # A group of fewer lines than the root of all makes fewer pairs than there are lines.
    some = max(SOME, math.isqrt(distinct.count()))
    more, known = some, _among(stages, found)
    while more >= some:
        # Only lines that the filter lets through are looked up among those found.
        asking, looked_up = hot.where(~known(F.col("at"))), hot.where(known(F.col("at")))
        newly = _by_heads(stages, distinct, asking.unionByName(looked_up.join(found.hint("merge"), "at", "left_anti")), percent, some)
        if newly is None:  # what few lines would ask is left to the next round
            break
        more, found = newly.count(), found.unionByName(newly)
        known = _among(stages, found)
    # Then all others: x is the larger set, or the later one of two of one size.
    looked_up = coded.where(known(F.col("at"))).join(found.withColumn("found", F.lit(True)).hint("merge"), "at", "left").withColumn("asks", F.col("found").isNull().cast("long")).drop("found")
    asks = coded.where(~known(F.col("at"))).withColumn("asks", F.lit(1).cast("long")).unionByName(looked_up)
    stages.drop(hot)
    parts = []
    for i in range(PASSES):
        entries = _entries(asks).where(F.col("code") % PASSES == i)
        # Sizes and places in one number: shorter rows.
        entries = entries.select("code", "at", "low", "high", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("place").cast("long"), 1)).bitwiseOR(F.col("asks")).alias("m"))
        x, y = (_side(entries, s) for s in "xy")
        parts.append(stages.keep(_candidate(x.join(y.hint("merge"), "code").where(_asked(percent) & _may_be_similar(percent, packed=True)))))
    best = functools.reduce(DataFrame.unionByName, parts).groupBy("later").agg(F.min("best").alias("best"), F.max("worst").alias("worst"), F.sum("met").alias("met"))
    best = stages.keep(best.select("later", _partner(F.col("best")).alias("earlier"), (F.col("best") != F.col("worst")).alias("others"), "met"))
    stages.drop(*parts)
    more = _similar(stages, distinct, best.select("later", "earlier"), percent)
    # Those whose likeliest partner is not similar, but that have others.
    open_ = stages.keep(best.where("others").select(F.col("later").alias("at"), "met").join(more.hint("merge"), "at", "left_anti"))
    gone = found.unionByName(more)
    if not open_.isEmpty():
        gone = gone.unionByName(_others(stages, distinct, coded, open_, percent))
    stages.drop(best, coded, open_)
    return gone


def removed_lines(spark: SparkSession, docs: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: row, doc_id, n_lines, n_removed, removed (their places from 0, ascending).

    A line goes if a line before it (by key, nulls first, then row, then place)
    has a token set of Jaccard similarity of at least percent / 100, whether or
    not that one stays.  Lines without tokens always stay.  Null and empty texts
    have one line, without tokens.  Repeated rows are rows of their own; of
    these, which comes first is not fixed.  No rows give no rows.
    """
    return _removed(spark, docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text")), percent)


def _removed(spark: SparkSession, numbered: DataFrame, percent: int) -> DataFrame:
    stages = Stages(spark, "lines")
    lines = _lines(stages, numbered.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    distinct = stages.keep(lines.where("worded").groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count("*").alias("copies"), F.first("line").alias("line")))
    # The text of a line stands in one table only while lines are compared.
    whole, lines = lines, stages.keep(lines.drop("line"))
    stages.drop(whole)
    gone = _gone(stages, distinct, percent).withColumn("gone", F.lit(True))
    # Only classes of which something goes meet the lines again.
    classes = distinct.select("h1", "h2", F.col("at").alias("first"), "copies").where((F.col("copies") > 1) | _among(stages, gone)(F.col("at")))
    marked = classes.join(gone.withColumnRenamed("at", "first").hint("merge"), "first", "left").where("gone or copies > 1")
    marked = stages.keep(marked.select("h1", "h2", "first", "gone"))
    out = lines.where("worded").where(_among(stages, marked.select("h1"))(F.col("h1"))).select("row", "line_no", "at", "h1", "h2")
    out = out.join(marked.hint("merge"), ["h1", "h2"]).where("gone or at > first")
    by_row = out.groupBy("row").agg(F.sort_array(F.collect_list("line_no")).alias("removed"))
    rows = lines.groupBy("row", "doc_id").agg(F.count("*").alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.join(by_row, "row", "left").select("row", "doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def dedup_lines(spark: SparkSession, docs: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with `text` less the lines that go; see removed_lines.  Rows are numbered in a written table, so that they keep their numbers."""
    stages = Stages(spark, "line-texts")
    whole = stages.keep(docs.withColumn("_row", F.monotonically_increasing_id()))
    gone = _removed(spark, whole.select(F.col("_row").alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text")), percent).select(F.col("row").alias("_row"), F.col("removed").alias("_removed"))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains("_removed", i)), "\n")
    return whole.join(gone, "_row").withColumn(text, F.when(F.size("_removed") > 0, kept).otherwise(F.col(text))).drop("_row", "_removed")
