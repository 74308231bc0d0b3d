"""Secret scans with multipart credential linking, with DataFrame functions only.

Strong patterns are reported wherever they are found. The parts of a multipart credential are weak by themselves: an
access identifier, a secret-looking value, an endpoint. They are reported only when complementary parts occur within
the same scope: in one section of a text, and there at most ``RADIUS`` code points apart, from the end of one to the start of the other. A section ends
where the next begins: at a name in brackets, an empty line, a line of dashes, or where one object of braces follows another. The interval join is made with window functions over
the starts and ends of the parts of a section in order: for each other role the last end up to a part's start and the
first start from its end on decide, so parts are never paired with each other and none that overlap hide another.

Positions are code points. Matches are found once; what lies between them, from splitting at the same pattern, gives
their places.

Defined results: null or empty text has no secrets; repeated rows are scanned alike and kept apart; of complements at one distance any will do; very long texts and
values are scanned whole; an empty table gives an empty result; a null doc_id is an id like any other; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import broadcast_if_small, let, materialize

RADIUS = 200
SECRET_KEY = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
#: kind: (pattern, length of the shortest match that counts, group whose length that is)
STRONG = {
    "assign": (rf"{SECRET_KEY}[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 1),
    # whole runs, so asking for the length in the pattern finds the same spans as dropping short matches
    "access": (r"AKIA[A-Z0-9]{12,}", 16, 0),
    "hex": (r"[0-9a-f]{32,}", 32, 0),
}
#: Weak parts by role.
WEAK = {
    "weak_id": r"(?<![A-Za-z0-9])(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@+-]{3,}",
    # a value under a name that says so, or a long run that mixes digits and letters of both cases
    "weak_secret": r"(?<![A-Za-z0-9])(?i:secret_?access_?key|(?:private|signing|client)_?key|pass(?:phrase|code))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}"
    r"|(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9A-Z+/_=-]*+[a-z])(?=[0-9a-z+/_=-]*+[A-Z])[A-Za-z0-9+/_=-]{20,}+",
    "weak_endpoint": r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+]{1,20}://[A-Za-z0-9.-]+(?::[0-9]{1,5})?",
}
#: Where a section begins: [name], an empty line, a line of dashes, and the next object of a list.
BORDER = r"(?<![^\s])\[[A-Za-z0-9_.: /-]{1,64}\](?=\s)|\n[\x20\t\r]*\n|\n(?:---+|===+)[\x20\t\r]*\n|\}[\s,]*\{"
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "weak_endpoint": "endpoint"}
ORDER = {kind: k for k, kind in enumerate([*STRONG, *WEAK])}
#: What a text has that any pattern can match in; the hex alternative asks for a long run. The letters before the words pass most places at once.
HINT = r"AKIA|[0-9a-f]{32}|://|(?=[pstaulcPSTAULC])(?i:pass(?:w|phrase|code)|secret|token|api_?key|user|login|account|client_?id|(?:access|private|signing|client)_?key)"
#: What the nameless long values begin with.
LONG = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-]{20}"


#: Matches whose places are summed up in one go. The sums of these blocks come first, so that the work is nearly linear in the matches.
BLOCK = 256


def spans(text: Column, kind: str, pattern: str, shortest: int = 0, group: int = 0) -> Column:
    """Array of (kind, start, end) of the matches that are long enough, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    lengths = F.transform(F.arrays_zip(between.alias("b"), found.alias("m"), values.alias("v")), lambda z: F.struct(F.length(z.b).alias("gap"), F.length(z.m).alias("own"), F.length(z.v).alias("counts")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def add(acc: Column, z: Column) -> Column:
        begin = acc.at + z.gap
        end = begin + F.coalesce(z.own, F.lit(0))
        new = F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(z.counts >= shortest, F.concat(acc.spans, new)).otherwise(acc.spans).alias("spans"))

    def within(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), add, lambda acc: acc.spans)

    def after(acc: Column, block: Column) -> Column:
        length = F.aggregate(block, F.lit(0), lambda n, z: n + z.gap + F.coalesce(z.own, F.lit(0)))
        return F.struct((acc.at + length).alias("at"), F.concat(acc.starts, F.array(acc.at)).alias("starts"))

    def placed(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), after, lambda acc: acc.starts)
        return let(starts, lambda s: F.flatten(F.transform(blocks, lambda block, k: within(block, F.get(s, k)))))

    def cut(z: Column) -> Column:
        number = F.sequence(F.lit(0), ((F.size(z) - 1) / BLOCK).cast("int"))
        return let(F.transform(number, lambda k: F.slice(z, k * BLOCK + 1, BLOCK)), placed)

    return F.when(text.rlike(pattern), let(lengths, cut)).otherwise(none)


def number(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s.kind == kind)).cast("long")


def written(found: Column) -> Column:
    """kind:start:end of the spans by start, then kind as listed, comma-joined."""
    rank = F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))
    keyed = F.transform(found, lambda s: F.struct(s.start.alias("a"), F.try_element_at(rank, s.kind).alias("b"), s.end.alias("c"), s.kind.alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s.kind, s.a.cast("string"), s.c.cast("string"))), ",")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, strong, weak, borders): spans of every row, in one scan; borders only of rows with weak spans."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    strong = F.concat(*(spans(F.col("_text"), k, *v) for k, v in STRONG.items()))
    weak = F.concat(*(spans(F.col("_text"), k, v) for k, v in WEAK.items()))
    rows = docs.select("doc_id", text.alias("_text"))
    long = F.col("_text").rlike(LONG) & F.col("_text").rlike(WEAK["weak_secret"])
    rows = rows.select("doc_id", "_text", F.col("_text").rlike(HINT).alias("_hint"), long.alias("_long"))
    found = rows.select("doc_id", "_text", F.xxhash64("_text").alias("text_hash"), F.when(F.col("_hint"), strong).otherwise(none).alias("strong"), F.when(F.col("_hint") | F.col("_long"), weak).otherwise(none).alias("weak"))
    borders = F.when(F.size("weak") > 0, spans(F.col("_text"), "border", BORDER)).otherwise(none)
    return found.select("doc_id", "text_hash", "strong", "weak", borders.alias("borders"))


def linked(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, linked): the weak spans that have complementary parts in their scope.

    An identifier needs a secret, a secret needs an identifier or an endpoint, an endpoint needs both.
    """
    of = ["doc_id", "text_hash"]
    parts = rows.where(F.size("weak") > 0).select(*of, F.explode(F.concat("strong", "weak", "borders")).alias("s")).distinct().select(*of, "s.*")
    role = F.create_map(*(F.lit(x) for pair in ROLE.items() for x in pair))
    parts = parts.withColumn("role", F.try_element_at(role, F.col("kind")))
    # an end comes before a start at the same place: parts that touch are apart by nothing, and do not overlap
    edges = parts.select("*", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("edge")), F.struct(F.col("end").alias("at"), F.lit(0).alias("edge")))).alias("e")).select(*parts.columns, "e.*")
    # a border counts where it ends, before what begins there
    border = F.col("kind") == "border"
    edges = edges.where(~border | (F.col("edge") == 0)).withColumn("edge", F.when(border, -1).otherwise(F.col("edge")))
    so_far = Window.partitionBy(*of).orderBy("at", "edge").rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("section", F.count(F.when(border, 1)).over(so_far)).where(~border)
    of = [*of, "section"]
    before = Window.partitionBy(*of).orderBy("at", "edge").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*of).orderBy(F.desc("at"), F.desc("edge")).rowsBetween(Window.unboundedPreceding, -1)

    def near(wanted: str) -> Column:
        # a part that overlaps the span is the same value seen twice, not a complement
        ahead = F.max(F.when((F.col("role") == wanted) & (F.col("edge") == 0), F.col("at"))).over(before)
        behind = F.min(F.when((F.col("role") == wanted) & (F.col("edge") == 1), F.col("at"))).over(after)
        return F.coalesce(F.when(F.col("edge") == 1, F.col("at") - ahead <= radius).otherwise(behind - F.col("at") <= radius), F.lit(False))

    met = edges.select("*", *(near(r).alias(f"near_{r}") for r in ("id", "secret", "endpoint")))
    of = of[:-1]
    met = met.groupBy(*of, "kind", "role", "start", "end").agg(*(F.max(f"near_{r}").alias(f"near_{r}") for r in ("id", "secret", "endpoint")))
    whole = (
        F.when(F.col("role") == "id", F.col("near_secret"))
        .when(F.col("role") == "secret", F.col("near_id") | F.col("near_endpoint"))
        .otherwise(F.col("near_id") & F.col("near_secret"))
    )
    weak = met.where(F.col("kind").isin(*WEAK) & whole)
    return weak.groupBy(*of).agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))


def scan(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, strong, linked) of every row."""
    rows = materialize(candidates(docs), "secret-spans")
    more = materialize(linked(rows, radius).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "linked"), "secret-links")
    joined = rows.join(broadcast_if_small(more), rows.doc_id.eqNullSafe(more["_id"]) & (rows.text_hash == more["_hash"]), "left")
    return joined.select("doc_id", "strong", F.coalesce("linked", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("linked"))
