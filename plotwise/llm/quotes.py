"""Operator 5: chat formatting by quotation linking.

Lines that start with ``>`` are quotes; as many ``>`` as stand there, so deep they are nested.  Neighbouring lines of
one level are a passage.  A passage, and each of its lines, is normalised (lower case, blanks collapsed) and hashed;
the hashes are joined to those of the messages' own words: whole, by paragraph and by line.  An earlier message of the
same conversation comes first, else the first one of the least other conversation; in either, messages that hold the
whole passage come before those that hold only a line of it.  Of several messages that hold it the first counts, so
that each place is one aggregate and no pairs are made.  A message replies to where the least nested of its linked quotes lead to in its
conversation, the latest if there are several; replies form threads, and a conversation is ordered by thread and turn.
Quotes, and the lines that announce them, are left out of the text.

DataFrame functions only.  Patterns match character classes and have no repeated groups, so that a line of any length
is read in linear time and without a deep stack.  Positions in a conversation are counted over sorted ranges, so that
a conversation or a quoted text with a third of all rows is spread over tasks.

Defined cases: a null text has no quotes and an empty body; null ids are kept, and link with nothing; messages of equal
(conv_id, turn) share their thread, and those of them that quote
share their links; quotes of unknown text stay unlinked; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table
from .components import apart

_LEAD = r"^[ \t>]*+"
_MARK = r"^[ \t>]*>[ \t]?"
_ANNOUNCED = r"(?i)^.{0,200}\b(wrote|writes|said|schrieb|escribió|écrit)[ \t]*+:[ \t]*+$"
_BLANKS = " \t\n\r\f\x0b"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s++", " "))


def _filled(texts: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(texts, normalised), lambda x: x != ""))


def level_of(line: Column) -> Column:
    """How many ``>`` stand, with blanks between, at the start of the line."""
    lead = F.regexp_extract(line, _LEAD, 0)
    return F.length(lead) - F.length(F.replace(lead, F.lit(">"), F.lit("")))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds lines (level, content), body and passages (level, contents)."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    line = lambda x: F.struct(level_of(x).alias("level"), F.regexp_replace(x, _MARK, "").alias("content"))
    with_lines = messages.withColumn("lines", F.transform(lines, line))
    level = lambda i: F.get(F.col("lines"), i)["level"]
    before_quote = lambda i: F.coalesce(level(i + 1), F.lit(0)) > 0
    marked = F.transform("lines", lambda x, i: F.struct(x["level"].alias("level"), x["content"].alias("content"), before_quote(i).alias("before")))
    own = F.filter(marked, lambda x: (x["level"] == 0) & ~(x["before"] & x["content"].rlike(_ANNOUNCED)))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (level(i) != F.coalesce(level(i - 1), F.lit(-1))))
    spans = F.transform("starts", lambda s, k: F.struct(s.alias("start"), (F.coalesce(F.get(F.col("starts"), k + 1), F.size("lines")) - s).alias("n")))
    contents = lambda x: F.transform(F.slice("lines", x["start"] + 1, x["n"]), lambda y: y["content"])
    passage = lambda x: F.struct(level(x["start"]).alias("level"), contents(x).alias("contents"))
    body = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), r"\n{3,}+", "\n\n")
    return (
        with_lines.withColumn("body", F.btrim(body, F.lit(_BLANKS)))
        .withColumn("starts", starts)
        .withColumn("passages", F.filter(F.transform(spans, passage), lambda x: x["level"] > 0))
        .drop("starts")
    )


def _links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, n_linked, reply_to, far) of the messages with quotes."""
    units = F.array_distinct(F.concat(_filled(F.array("body")), _filled(F.split("body", r"\n\s*\n")), _filled(F.split("body", "\n"))))
    known = rows.where("conv_id is not null and turn is not null")
    said = known.select("conv_id", "turn", F.explode(units).alias("unit")).select("conv_id", "turn", F.sha2("unit", 256).alias("hash"))
    unit = lambda text, whole: F.transform(text, lambda x: F.struct(x.alias("text"), F.lit(whole).alias("whole")))
    asked = F.concat(unit(_filled(F.array(F.array_join("passage.contents", " "))), 1), unit(_filled(F.col("passage.contents")), 0))
    quotes = (
        known.where(F.size("passages") > 0)
        .select("conv_id", "turn", F.posexplode("passages").alias("number", "passage"))
        .select("conv_id", "turn", "number", F.col("passage.level").alias("level"), F.explode(asked).alias("unit"))
        .select("conv_id", "turn", "number", "level", F.sha2("unit.text", 256).alias("hash"), F.col("unit.whole").alias("whole"))
        .groupBy("conv_id", "turn", "number", "level", "hash").agg(F.max("whole").alias("whole"))
    )
    # What is said matters only where somebody quotes it: the hashes that are asked for, one row each.
    fresh = lambda frame: frame.withColumn("hash", F.concat("hash", F.lit("")))  # noqa: E731  dealt out anew, so that a hot hash can be split
    heard = said.join(fresh(quotes.select("hash").distinct()), "hash", "left_semi")
    places = cut(heard.groupBy("hash", "conv_id").agg(F.min("turn").alias("turn")))
    first = places.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    second = places.join(fresh(first), "hash").where(F.col("conv_id") > F.col("first.conv_id")).groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("second"))
    abroad = cut(first.join(second, "hash", "left"))
    found = (
        quotes.join(places.select(apart("conv_id").alias("conv_id"), "hash", F.col("turn").alias("near_turn")), ["conv_id", "hash"], "left")
        .join(fresh(abroad), "hash", "left")
        .withColumn("near_turn", F.when(F.col("near_turn") < F.col("turn"), F.col("near_turn")))
        .withColumn("far", F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second")))
    )
    of = lambda place, whole: F.when(F.col("whole") == whole, F.col(place))
    passages = found.groupBy("conv_id", "turn", "number", "level").agg(
        F.coalesce(F.max(of("near_turn", 1)), F.max(of("near_turn", 0))).alias("near_turn"), F.coalesce(F.min(of("far", 1)), F.min(of("far", 0))).alias("far")
    )
    passages = passages.withColumn("far", F.when(F.col("near_turn").isNull(), F.col("far")))
    order = F.when(F.col("near_turn").isNotNull(), F.struct(-F.col("level"), F.col("near_turn")))
    return passages.groupBy("conv_id", "turn").agg(
        F.count_if(F.col("near_turn").isNotNull() | F.col("far").isNotNull()).alias("n_linked"), F.max_by("near_turn", order).alias("reply_to"), F.min("far").alias("far")
    )


def linked(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, body, n_quotes, quote_depth, n_linked, reply_to, reply_conv, thread, position."""
    rows = cut(parsed(messages.select("conv_id", "turn", "role", "text")).select("conv_id", "turn", "role", "body", "passages"))
    found = cut(_links(rows))
    threads = _threads(found.where("reply_to is not null").select("conv_id", "turn", "reply_to"))
    quoting = F.size("passages") > 0
    out = rows.join(found, ["conv_id", "turn"], "left").withColumns({c: F.when(quoting, F.col(c)) for c in ("n_linked", "reply_to", "far")})
    out = out.join(threads, ["conv_id", "turn"], "left")
    out = out.select(
        "conv_id", "turn", "role", "body", F.size("passages").cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("passages", lambda x: x["level"])), F.lit(0)).cast("long").alias("quote_depth"),
        F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "reply_to",
        F.when(F.col("reply_to").isNotNull(), F.col("conv_id")).otherwise(F.col("far.conv_id")).alias("reply_conv"),
        F.coalesce("thread", "turn").alias("thread"),
    )
    return _positions(out)


def _threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread): the first turn of the chain of replies, found by doubling jumps."""
    jumps = cut(replies.select("conv_id", "turn", F.col("reply_to").alias("thread")))
    while True:
        on = jumps.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"))
        longer = cut(jumps.join(on, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("further", "thread").alias("thread"), F.col("further").isNotNull().alias("moved")))
        jumps = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return jumps


def _positions(rows: DataFrame) -> DataFrame:
    """Adds the position in the conversation, by (thread, turn), counted over sorted ranges."""
    order = ["thread", "turn", "role", "body"]
    ranged = cut(rows.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("conv_id", "range").orderBy(*order)
    numbered = ranged.withColumn("at", F.row_number().over(inside))
    joined = numbered.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return joined.withColumn("position", (F.col("at") + F.col("offset")).cast("long")).drop("c", "r", "offset", "at", "range")


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "conversations"))
