"""Quotation linking in conversations, with DataFrame functions only.

A message is split into lines; the leading ``>`` marks give each line its quote level. Runs of quoted lines are quoted
passages: their text at the next level is normalised and hashed, whole, by paragraphs and by lines. Units are joined by
hash to the messages whose own (unquoted) text, runs between quotes, paragraphs or lines carry the same normalised
text, and of these to the nearest one before the quote. A passage goes to the message that wrote it whole; else to the one that wrote most of
it, by the letters of the paragraphs and lines found, the nearer one where two wrote as much. A line by itself that more than ``STOCK`` messages of a
conversation wrote says nothing about whose it is.
Conversations are then ordered by the tree of these replies: a message follows the message that it quotes, after the
earlier replies to that one with all of theirs, and the quotes themselves go.

Only hashes are joined, and only those that some quote asks for. Which message was the nearest is an as-of join over range partitions, so
a passage that very many messages quote or carry makes a row per unit of the quote and never pairs. Numbering runs over
range partitions, and places in the tree are found by doubling steps along its tour, so that a conversation of any
size or depth is spread over tasks.

Defined results: null or empty text is a message without own text; a null turn sorts first; repeated rows are messages
of their own, numbered on; quotes whose passage nobody wrote, or only the quoting message itself or a later one, stay
unlinked and still go; very long messages are split whole; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Latest, ascii_lower, broadcast_if_small, let, materialize, numbered
from scriptorium.operators.asof import as_of

#: Lines that announce a quote, which go with it.
ANNOUNCES = r"(?i)^(?:on .{1,200} wrote|am .{1,200} schrieb.{0,80}|le .{1,200} a écrit|el .{1,200} escribió)\s*:\s*$|^-{2,}\s*original message\s*-{2,}$"
LINE = r"\r\n|\r|\n"
#: Messages of a conversation that may have written a line before it is nobody's.
STOCK = 3
PARAGRAPH = r"(?>\r\n|\r|\n)(?:[^\S\r\n]*(?>\r\n|\r|\n))+"
MARKS = r"^(?:\x20{0,3}>)+"


def normalised(text: Column) -> Column:
    """Lower case, marks and punctuation as one space."""
    return F.trim(F.regexp_replace(ascii_lower(text), r"[^\p{L}\p{N}]+", " "))


def hashed(texts: Column) -> Column:
    """The distinct hashes of normalised texts that have any letter or digit."""
    return F.array_distinct(F.transform(F.filter(F.transform(texts, normalised), lambda b: b != ""), lambda b: F.xxhash64(b)))


def units(body: Column) -> Column:
    """Array of (rank, hash, size) of a passage: 0 the whole, 1 its paragraphs, 2 its lines."""
    sized = lambda texts, k: F.transform(F.filter(F.transform(texts, normalised), lambda b: b != ""), lambda b: F.struct(F.lit(k).alias("rank"), F.xxhash64(b).alias("hash"), F.length(b).alias("size")))
    ranked = lambda texts, k: F.array_distinct(sized(texts, k))
    return F.concat(ranked(F.array(body), 0), ranked(F.split(body, PARAGRAPH, -1), 1), ranked(F.split(body, LINE, -1), 2))


def runs(lines: Column) -> Column:
    """Array of (level, body): each run of lines of one level as one text. Runs are cut out by their first lines, in time linear in the lines."""
    none = F.array().cast("array<struct<level:int,body:string>>")

    def cut(v: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (F.get(v, i).level != F.get(v, i - 1).level))
        return let(first, lambda at: F.transform(at, lambda i, k: F.struct(F.get(v, i).level.alias("level"), body(v, i, F.coalesce(F.get(at, k + 1), F.size(v)) - i).alias("body"))))

    def body(v: Column, start: Column, n: Column) -> Column:
        return F.array_join(F.transform(F.slice(v, start + 1, n), lambda s: s.body), "\n")

    return let(lines, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(none))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, own, parts, quoted): own text without quotes, its runs; quoted is an array of (level, units)."""
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    # only rows that share their turn are numbered, so only their texts are sorted
    shared = materialize(messages.groupBy(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn")).count().where("count > 1").select("_conv", "_turn"), "quotes-shared")
    same = rows.conv_id.eqNullSafe(shared["_conv"]) & rows.turn.eqNullSafe(shared["_turn"])
    few = broadcast_if_small(shared)
    several = numbered(rows.join(few, same, "left_semi"), ["conv_id", "turn"], ["role", "text_hash"], "copy")
    rows = rows.join(few, same, "left_anti").withColumn("copy", F.lit(1).cast("long")).unionByName(several)
    lines = F.transform(
        F.split("text", LINE, -1),
        lambda s: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(s, MARKS, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(s, MARKS + r"\x20?", "").alias("body"),
        ),
    )
    rows = rows.withColumn("lines", lines)
    # an own line that announces a quote belongs to no run
    kept = F.filter("lines", lambda s: ~((s.level == 0) & s.body.rlike(ANNOUNCES)))
    plain = ~F.col("text").rlike(r"(?m)^\x20{0,3}>|" + ANNOUNCES.replace("(?i)", "(?im)"))
    rows = rows.withColumn("runs", F.when(plain, F.array(F.struct(F.lit(0).alias("level"), F.col("text").alias("body")))).otherwise(runs(kept)))
    parts = F.filter(F.transform(F.filter("runs", lambda r: r.level == 0), lambda r: F.regexp_replace(r.body, r"^\s+|\s+$", "")), lambda b: b != "")
    quoted = F.filter(F.transform(F.filter("runs", lambda r: r.level > 0), lambda r: F.struct(r.level.alias("level"), units(r.body).alias("units"))), lambda r: F.size(r.units) > 0)
    return rows.select("conv_id", "turn", "copy", "role", F.array_join(parts, "\n").alias("own"), parts.alias("parts"), quoted.alias("quoted"))


def blocks(said: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv_id, hash, turn, copy, writers): the messages that wrote a wanted text, as all of theirs, a run, a paragraph or a line, and how many did."""
    split = lambda by: F.flatten(F.transform("parts", lambda b: F.split(b, by, -1)))
    pieces = F.array_distinct(F.concat(F.array(F.col("own")), F.col("parts"), split(PARAGRAPH), split(LINE)))
    each = said.select("conv_id", F.explode(hashed(pieces)).alias("hash"), "turn", "copy")
    asked = wanted.select(F.col("conv_id").alias("c"), F.col("hash").alias("h"))
    found = materialize(each.join(broadcast_if_small(asked), each.conv_id.eqNullSafe(asked.c) & (each.hash == asked.h), "left_semi"), "quotes-blocks")
    many = found.groupBy(F.col("conv_id").alias("c"), F.col("hash").alias("h")).agg(F.count(F.lit(1)).alias("writers"))
    return found.join(many, found.conv_id.eqNullSafe(many.c) & (found.hash == many.h)).select("conv_id", "hash", "turn", "copy", "writers")


def nearest(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """quotes (a row per unit) with t, k and writers of the nearest earlier message that wrote the unit, if any."""
    wrote = blocks(said, materialize(quotes.select("conv_id", "hash").distinct(), "quotes-wanted"))
    key = F.struct("conv_id", "hash").alias("key")
    at = lambda after: F.struct("turn", "copy", F.lit(after).alias("after")).alias("at")
    versions = wrote.select(key, at(1), F.col("turn").alias("t"), F.col("copy").alias("k"), "writers")  # a message does not see itself
    seen = as_of(quotes.select("*", key, at(0)), versions, "key", "at", "at")
    return seen.select(*quotes.columns, F.col("version.t").alias("t"), F.col("version.k").alias("k"), F.col("version.writers").alias("writers"), F.col("version").isNotNull().alias("found"))


def tree_places(rows: DataFrame) -> DataFrame:
    """(c, v, place) of the messages in conversations that have replies; rows have conv_id, nth, turn, copy, reply_turn, reply_copy.

    The tour of a tree enters and leaves each message (2 v, 2 v + 1); each step's number of entries up to the end is
    found by doubling, in as many joins as the tour's length has binary digits.
    """
    asked = rows.where("reply_copy is not null").select(F.col("conv_id").alias("c")).distinct()
    nodes = rows.join(asked, rows.conv_id.eqNullSafe(asked.c), "left_semi")
    above = nodes.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("copy").alias("k"), F.col("nth").alias("p"))
    found = nodes.join(above, nodes.conv_id.eqNullSafe(above.c) & nodes.reply_turn.eqNullSafe(above.t) & (nodes.reply_copy == above.k), "left")
    kids = numbered(found.select(F.col("conv_id").alias("c"), F.col("nth").alias("v"), F.coalesce("p", F.lit(0)).cast("long").alias("p")), ["c", "p"], ["v"], "k")
    kids = materialize(kids, "quotes-tree")
    after = kids.select(F.col("c").alias("ac"), F.col("p").alias("ap"), (F.col("k") - 1).alias("ak"), F.col("v").alias("sibling"))
    eldest = kids.where("k = 1").select(F.col("c").alias("ec"), F.col("p").alias("ep"), F.col("v").alias("child"))
    both = kids.join(after, kids.c.eqNullSafe(after.ac) & (kids.p == after.ap) & (kids.k == after.ak), "left").join(eldest, kids.c.eqNullSafe(eldest.ec) & (kids.v == eldest.ep), "left")
    leave = F.coalesce(2 * F.col("sibling"), F.when(F.col("p") > 0, 2 * F.col("p") + 1), F.lit(0))
    steps = F.array(
        F.struct((2 * F.col("v")).alias("e"), F.coalesce(2 * F.col("child"), 2 * F.col("v") + 1).alias("s"), F.lit(1).cast("long").alias("d")),
        F.struct((2 * F.col("v") + 1).alias("e"), leave.alias("s"), F.lit(0).cast("long").alias("d")),
    )
    rounds = Latest("quotes-tour")
    tour = rounds.put(both.select("c", F.explode(steps).alias("x")).select("c", "x.*"))
    while not tour.where("s != 0").isEmpty():
        on = tour.select(F.col("c").alias("nc"), F.col("e").alias("ne"), F.col("s").alias("ns"), F.col("d").alias("nd"))
        met = tour.join(on, tour.c.eqNullSafe(on.nc) & (tour.s == on.ne), "left")
        tour = rounds.put(met.select("c", "e", F.coalesce("ns", F.lit(0)).cast("long").alias("s"), (F.col("d") + F.coalesce("nd", F.lit(0))).alias("d")))
    total = tour.groupBy("c").agg(F.max("d").alias("n")).select(F.col("c").alias("tc"), "n")
    entries = tour.where("e % 2 = 0")
    return entries.join(total, entries.c.eqNullSafe(total.tc)).select("c", (F.col("e") / 2).cast("long").alias("v"), (F.col("n") - F.col("d")).alias("place"))


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text, n_quotes, n_linked, reply_turn, reply_copy, position) of every message.

    position numbers the messages of a conversation in reply order, from 0: those that reply to none by turn, and each
    followed by its replies by turn, every one with its own replies.
    """
    said = materialize(passages(messages), "quotes-said")
    runs = said.where(F.size("quoted") > 0).select("conv_id", "turn", "copy", F.posexplode("quoted").alias("run", "q"))
    quotes = runs.select("conv_id", "turn", "copy", "run", F.col("q.level").alias("level"), F.explode("q.units").alias("u")).select("conv_id", "turn", "copy", "run", "level", "u.rank", "u.hash", "u.size")
    quotes = materialize(quotes, "quotes-units")
    if quotes.isEmpty():
        return _numbered_only(said)
    met = nearest(quotes, said).where("found").where((F.col("rank") < 2) | (F.col("writers") <= STOCK))
    keys = ["conv_id", "turn", "copy", "run", "level"]
    scored = met.groupBy(*keys, "t", "k").agg(F.max(F.col("rank") == 0).alias("whole"), F.sum("size").alias("size"))
    best = scored.groupBy(*keys).agg(F.max(F.struct("whole", "size", "t", "k")).alias("best"))
    all_runs = quotes.select(*keys).distinct()
    same = all_runs.conv_id.eqNullSafe(best.conv_id) & all_runs.turn.eqNullSafe(best.turn) & (all_runs["copy"] == best["copy"]) & (all_runs.run == best.run)
    linked = all_runs.join(best, same, "left").select(*(all_runs[c] for c in keys), "best")
    found = linked.groupBy(F.col("conv_id").alias("qc"), F.col("turn").alias("qt"), F.col("copy").alias("qk")).agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("best").alias("n_linked"), F.max(F.when(F.col("best").isNotNull(), F.struct(-F.col("level"), F.col("best.t").alias("t"), F.col("best.k").alias("k")))).alias("to")
    )
    found = found.withColumn("to", F.struct(F.col("to.t").alias("turn"), F.col("to.k").alias("copy")))
    rows = said.join(found, said.conv_id.eqNullSafe(found.qc) & said.turn.eqNullSafe(found.qt) & (said["copy"] == found.qk), "left")
    rows = rows.select("conv_id", said.turn, said["copy"], "role", F.col("own").alias("text"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_quotes", "n_linked")), F.col("to.turn").alias("reply_turn"), F.col("to.copy").alias("reply_copy"))
    names = rows.columns
    placed = materialize(numbered(rows, ["conv_id"], ["turn", "copy"], "nth"), "quotes-placed")
    if placed.where("reply_copy is not null").isEmpty():
        return placed.select(*names, (F.col("nth") - 1).alias("position"))
    places = tree_places(placed.select("conv_id", "nth", "turn", "copy", "reply_turn", "reply_copy"))
    told = placed.join(places, placed.conv_id.eqNullSafe(places.c) & (placed.nth == places.v), "left")
    return told.select(*names, F.coalesce("place", F.col("nth") - 1).alias("position"))


def _numbered_only(said: DataFrame) -> DataFrame:
    """The result where nothing is quoted: messages by turn."""
    none = F.lit(0).cast("long")
    rows = said.select("conv_id", "turn", "copy", "role", F.col("own").alias("text"), none.alias("n_quotes"), none.alias("n_linked"), F.lit(None).cast(said.schema["turn"].dataType).alias("reply_turn"), F.lit(None).cast("long").alias("reply_copy"))
    narrow = numbered(rows.select("conv_id", "turn", "copy"), ["conv_id"], ["turn", "copy"], "nth").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("copy").alias("k"), "nth")
    told = rows.join(narrow, rows.conv_id.eqNullSafe(narrow.c) & rows.turn.eqNullSafe(narrow.t) & (rows["copy"] == narrow.k))
    return told.select(*rows.columns, (F.col("nth") - 1).alias("position"))
