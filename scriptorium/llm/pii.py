"""Surrogates for personal data, with DataFrame functions only.

Detected entities get keyed surrogates of their own type and format: an entity is first brought to a normal form, and
a keyed hash of type and normal form gives the surrogate, so all mentions of an entity in all documents change alike.
Names are found behind titles and replaced word by word, whatever title stands before them: words with apostrophes, initials, and words
of scripts without capitals too, while particles (van, de la) stay. Within a document, capitalised
mentions of these words without a title go too; words that are months or common words as well go only beside another word of a name. A letter
with its accent is one name however it is coded. The title, hyphens and capitals stay; the form follows the gender that the
titles of the corpus give a first name (else its ending), the letters its script: Latin, Cyrillic, Greek, Armenian, and Latin
for all others. Addresses of one domain keep one domain. Phone numbers keep their country code, and ten digits without one are read as North American, so that
both spellings are one number. Cards and IBANs whose check digits hold get surrogates whose check digits hold. Sixteen digits are
taken for a card in any case, other lengths and IBANs only if their check digits hold.

Collision checks: the distinct entities are grouped by surrogate, and where two meet, or a surrogate is itself an
entity of the corpus, all but the first take their next attempt, until none is left. An entity that has lost ``LAST``
attempts, as where a form has hardly any values left, gets its type and a keyed hash instead of its format, so that this ends. The
few entities that did not keep their first attempt are joined back to the documents that mention them; all others need no join.

Defined results: null text stays null, text without entities stays as it is, repeated rows change alike, of entities that
tie for a surrogate the one with fewer attempts, then the lesser normal form, keeps it, very long texts are
searched whole, an empty table stays empty, and all other columns (of any name) are kept.
"""

from __future__ import annotations

import unicodedata
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Latest, broadcast_if_small, let, materialize


def _cased(titles: str) -> str:
    return "|".join([titles, titles.upper()])


MALE = _cased("Mr|Mister|Sir|Herr|Señor|Monsieur|Господин|Κύριος")
FEMALE = _cased("Mrs|Ms|Miss|Madam|Frau|Señora|Señorita|Madame|Mme|Mlle|Госпожа|Κυρία")
ANY = _cased("Dr|Prof")
#: What titles begin with, so that most places of a text are passed at once.
BEGIN = "".join(sorted({t[0] for t in f"{MALE}|{FEMALE}|{ANY}".split("|")}))
TITLE = rf"^(?:{MALE}|{FEMALE}|{ANY})\.? "
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_H6 = r"[0-9A-Fa-f]{1,4}"
#: Words before which ten digits in a row are a phone number.
_CALLS = "|".join(w + e for w in ("call", "Call", "phone", "Phone", "tel", "Tel", "mobile", "Mobile", "cell", "Cell", "fax", "Fax", "text", "Text") for e in (" ", ": ", ". ", "."))
#: Particles of names, which stay as they are.
PARTICLES = "von|van|der|den|de|del|della|di|da|dos|du|la|le|el|al|bin|ibn|ten|ter|zu|y".split("|")
#: Words that are names, and months or common words as well.
AMBIGUOUS = "january|february|march|april|may|june|july|august|september|october|november|december|will|mark|hope|grace|rose|bill|rich|young|long|king|page|black|white|brown|green|the|this|that|and".split("|")
_PARTICLE = "|".join(PARTICLES)
#: A word of a name: with a capital, an initial, or of a script without capitals.
_UNCASED = r"\p{IsHan}{1,4}|\p{IsHangul}{1,4}|[\p{IsHiragana}\p{IsKatakana}ー]{2,8}|[\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}\p{IsBengali}\p{IsTamil}\p{IsThai}\p{IsGeorgian}\p{IsEthiopic}&&[\p{L}\p{M}]]{2,}"
_NAME = rf"(?:\p{{Lu}}\.|\p{{Lu}}\p{{M}}*(?:['’]\p{{Lu}}?)?(?:\p{{L}}\p{{M}}*)+(?:['’](?:\p{{L}}\p{{M}}*)+)*|{_UNCASED})"
#: Patterns by type, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": _EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "ip": r"(?<![\p{L}\p{N}.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![\p{L}\p{N}]|\.\d)",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f]{0,4}:)(?:(?:" + _H6 + r":){7}" + _H6 + r"|(?=[0-9A-Fa-f:]*::)(?!\S*:::)(?!\S*::\S*::)(?:" + _H6 + r"(?::" + _H6 + r"){0,5})?::(?:" + _H6 + r"(?::" + _H6 + r"){0,5})?)(?![\p{L}\p{N}:])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "card": r"(?<![\p{L}\p{N}+])\d(?:[ -]?\d){12,18}" + _END,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}" + _END + r"|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}" + _END + r"|(?<![\p{L}\p{N}+.-])\d{3}([ .-])\d{3}\1\d{4}(?![\p{L}\p{N}]|[.-]\d)|(?<!\d)\d{10}(?<=(?:" + _CALLS + r")\d{10})" + _END,
    "name": rf"(?=[{BEGIN}])" + _EDGE + rf"(?:{MALE}|{FEMALE}|{ANY})\.? (?:(?:{_PARTICLE}) )*{_NAME}(?:(?:[ -]| (?:(?:{_PARTICLE}) )+){_NAME}){{0,3}}",
}
PATTERN = "|".join(PATTERNS.values())
#: What every entity contains; other texts are not searched.
HINT = rf"[@0-9]|::|(?=[{BEGIN}]){_EDGE}(?:{MALE}|{FEMALE}|{ANY})"
#: Syllables of surrogate names, their letters, and the same letters in other scripts.
SYLLABLES = [c + v for c in "bdfghjklmnprstvz" for v in "aeio"]
LETTERS = "abdefghijklmnoprstvz"
SCRIPTS = {"Cyrillic": "абдефгхийклмнопрствз", "Greek": "αβδεφγχιξκλμνοπρστψζ", "Armenian": "աբդեֆգհիջկլմնօպրստվզ"}
#: What ends a surrogate of a female and of a male form, and how first names end that are read as female without a title.
ENDING = {True: "na", False: "rt"}
FEMALE_END = "(?:[aаяηα]|ette|elle|ine|rie)$"
#: Letters with accents as letters and marks, by the rule of Unicode, so that both codings are one name.
APART = {c: d for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]) if (d := unicodedata.normalize("NFD", c)) != c}
#: Country codes of two digits (the others have one, 1 and 7, or three).
TWO_DIGITS = r"^\+(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Attempts that keep the format.
LAST = 24


def found_by(text: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(text, pattern, F.lit(0))


def kind_of(entity: Column) -> Column:
    kind = F.when(entity.contains("@"), "email").when(entity.contains(":"), "ip6")
    for name in ("ip", "ssn", "card", "phone"):
        kind = kind.when(entity.rlike(f"^(?:{PATTERNS[name]})$" + (r"|^\d{10}$" if name == "phone" else "")), name)
    return kind.when(entity.rlike(r"\d"), "iban").otherwise("name")


def luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 in a valid number."""
    twice = lambda c, i: c.try_cast("int") * (1 + i % 2)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(twice(c, i) - F.when(twice(c, i) > 9, 9).otherwise(0), F.lit(0))), F.lit(0), lambda x, y: x + y)


def mod97(text: Column) -> Column:
    """The remainder by 97 of letters and digits read as one number, A as 10 and so on."""
    value = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.position(c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1)
    return F.aggregate(value, F.lit(0), lambda x, v: (x * F.when(v < 10, 10).otherwise(100) + v) % 97)


def name_tokens(entity: Column) -> Column:
    return F.split(F.regexp_replace(entity, TITLE, ""), "[ -]")


def _apart(text: Column) -> Column:
    """A text with its accents as marks; texts without any are left alone."""
    pairs = F.create_map(*(F.lit(x) for pair in APART.items() for x in pair))
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), ""))


def parts(entity: Column) -> Column:
    """(kind, norm, said) of what is replaced in an entity: one part, or each word of a name after the title.

    said is f or m where the word is a first name behind a title that tells. Entities whose check digits rule them out have no parts.
    """
    read = F.struct(entity.alias("entity"), kind_of(entity).alias("kind"), F.regexp_replace(entity, r"\D", "").alias("digits"), F.regexp_replace(entity, " ", "").alias("plain"), name_tokens(entity).alias("tokens"))
    return let(read, _parts)


def _parts(v: Column) -> Column:
    norm = (
        F.when(v.kind == "email", F.lower(v.entity))
        .when(v.kind == "ip", v.entity)
        .when(v.kind == "ip6", F.lower(v.entity))
        .when(v.kind == "iban", v.plain)
        .when((v.kind == "phone") & v.entity.startswith("+"), F.concat(F.lit("+"), v.digits))
        .when((v.kind == "phone") & (F.length(v.digits) == 10), F.concat(F.lit("+1"), v.digits))
        .otherwise(v.digits)
    )
    whole_iban = F.concat(F.substring(v.plain, 5, 99), F.substring(v.plain, 1, 4))
    ruled_out = (v.kind == "card") & (F.length(v.digits) != 16) & (luhn(v.digits) % 10 != 0) | (v.kind == "iban") & (mod97(whole_iban) != 1)
    title = F.when(v.entity.rlike(rf"^(?:{FEMALE})\b"), "f").when(v.entity.rlike(rf"^(?:{MALE})\b"), "m")
    none = F.lit(None).cast("string")
    kind = lambda t: F.when(t.isin(PARTICLES), "kept").otherwise("name")
    named = F.transform(v.tokens, lambda t, i: F.struct(kind(t).alias("kind"), _apart(F.lower(t)).alias("norm"), F.when((i == 0) & (F.size(v.tokens) > 1), title).otherwise(none).alias("said")))
    whole = F.filter(F.array(F.struct(v.kind.alias("kind"), norm.alias("norm"), none.alias("said"))), lambda _: ~ruled_out)
    return F.when(v.kind == "name", named).otherwise(whole)


def entities(text: Column) -> Column:
    """What the patterns find, in order, names only behind titles."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), found_by(text, F.lit(PATTERN))).otherwise(none)


def with_bare_names(found: Column) -> Column:
    """The pattern for a text in which these entities were found: capitalised words of its names go without a title too."""
    words = F.array_distinct(F.flatten(F.transform(F.filter(found, lambda e: e.rlike(TITLE)), name_tokens)))
    words = F.filter(words, lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}"))
    sure = F.filter(words, lambda w: ~F.lower(w).isin(AMBIGUOUS))
    one = lambda ws: F.concat(F.lit(r"(?=\p{Lu})(?iu:"), F.array_join(ws, "|"), F.lit(")" + r"(?![\p{L}\p{N}\p{M}])"))
    more = F.concat(F.lit("(?:[ -]"), one(words), F.lit(")"))
    alone = F.when(F.size(sure) > 0, F.concat(F.lit("|" + _EDGE), one(sure), more, F.lit("*"))).otherwise("")
    beside = F.when(F.size(words) > F.size(sure), F.concat(F.lit("|" + _EDGE), one(words), more, F.lit("+"))).otherwise("")
    return F.when(F.coalesce(F.size(words), F.lit(0)) > 0, F.concat(F.lit(PATTERN), alone, beside)).otherwise(F.lit(PATTERN))


def female(norm: Column) -> Column:
    """The gender that a name is read as without a title that tells."""
    return norm.rlike(FEMALE_END)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str, is_female: Column | None = None) -> Column:
    """The surrogate of a normal form, itself in normal form."""
    is_female = female(norm) if is_female is None else is_female
    stream = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 256)
    code = F.when(norm.rlike(r"^\+[17]"), 2).when(norm.rlike(TWO_DIGITS), 3).when(norm.startswith("+"), 4).otherwise(0)
    respelled = F.when(kind == "name", "").when(kind == "email", F.substring_index(norm, "@", 1)).otherwise(norm)
    kept = F.when(kind == "phone", code).when(kind == "iban", 2).otherwise(0)
    domain = F.when(kind == "email", F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index(norm, "@", -1)), 256), 1, 12))
    given = F.struct(domain.alias("domain"), kind.alias("kind"), norm.alias("norm"), attempt.alias("attempt"), is_female.alias("is_female"), stream.alias("stream"), respelled.alias("source"), kept.alias("kept"))
    return let(given, lambda v: let(F.struct(*(v[c].alias(c) for c in ("domain", "kind", "norm", "attempt", "is_female", "stream")), _spelled(v).alias("spelled")), _formed))


def _in_script(text: Column, norm: Column) -> Column:
    """Lower-case Latin letters as letters of the script of the normal form."""
    return F.coalesce(*(F.when(norm.rlike(rf"\p{{Is{name}}}"), F.translate(text, LETTERS, letters)) for name, letters in SCRIPTS.items()), text)


def _spelled(v: Column) -> Column:
    """Each letter and digit after the kept ones by another of its kind and script."""
    digits, latin = F.translate(v.stream, "abcdef", "012345"), F.translate(v.stream, "0123456789abcdef", "abdefgiklmnoprst")
    at = lambda source, i: F.substring(source, i % 64 + 1, F.lit(1))

    def other(c: Column, i: Column) -> Column:
        new = F.when(i < v.kept, c).when((v.kind == "ip6") & (c != ":"), at(v.stream, i)).when(c.rlike("[0-9]"), at(digits, i)).when(c.rlike("[A-Z]"), F.upper(at(latin, i)))
        return new.when(c.rlike("[a-z]"), at(latin, i)).when(c.rlike(r"\p{L}"), _in_script(at(latin, i), v.norm)).otherwise(c)

    return F.array_join(F.transform(F.split(v.source, ""), other), "")


def _formed(v: Column) -> Column:
    byte = lambda i: F.conv(F.substring(v.stream, 2 * i + 1, 2), 16, 10).cast("int")
    bytes_ = F.transform(F.sequence(F.lit(0), F.least(v.attempt + 3, F.lit(11))), lambda i: F.conv(F.substring(v.stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    made = F.transform(bytes_, lambda b: F.get(F.array(*map(F.lit, SYLLABLES)), b % len(SYLLABLES)))
    name = _in_script(F.concat(F.array_join(made, ""), F.when(v.is_female, ENDING[True]).otherwise(ENDING[False])), v.norm)
    email = F.concat(v.spelled, F.lit("@"), F.concat(F.lit("m"), v.domain, F.lit(".example")))
    ip = F.concat_ws(".", *((byte(i) % 254 + 1).cast("string") for i in range(4)))
    body = F.substring(v.spelled, F.lit(1), F.length(v.norm) - 1)
    card = F.when(luhn(v.norm) % 10 == 0, F.concat(body, ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))).otherwise(v.spelled)
    account, country = F.substring(v.spelled, 5, 99), F.substring(v.norm, 1, 2)
    iban = F.concat(country, F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    formed = F.when(v.kind == "email", email).when(v.kind == "ip", ip).when(v.kind == "iban", iban).when(v.kind == "card", card).when(v.kind == "name", name).otherwise(v.spelled)
    return F.when(v.kind == "kept", v.norm).when(v.attempt < LAST, formed).otherwise(F.concat(v.kind, F.lit("-"), F.substring(v.stream, 1, 24)))


def poured(entity: Column, norm: Column) -> Column:
    """The last letters and digits of a normal form in the punctuation of an entity."""
    kept = lambda text: F.regexp_replace(text, "[^0-9A-Za-z]", "")
    plain = F.right(kept(norm), F.length(kept(entity)))
    seen = lambda i: F.length(kept(F.substring(entity, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(plain, seen(i), F.lit(1))).otherwise(c)), "")


def _part_key(kind: Column, norm: Column) -> Column:
    return F.concat_ws("|", kind, norm)


def replacement(entity: Column, codes: Column, key: str) -> Column:
    """The surrogate of an entity in its format; codes maps part keys to twice the attempt, plus one if the gender is not the one read off."""

    def new(p: Column) -> Column:
        code = F.coalesce(F.try_element_at(codes, _part_key(p.kind, p.norm)), F.lit(0))
        attempt = F.floor(code / 2).cast("int")
        return F.struct(p.kind.alias("kind"), surrogate(p.kind, p.norm, attempt, key, female(p.norm) != (code % 2 == 1)).alias("norm"), (attempt < LAST).alias("formed"))

    def written(v: Column) -> Column:
        body = F.regexp_replace(v.entity, TITLE, "")
        tokens, joints = F.split(body, "[ -]"), F.regexp_extract_all(body, F.lit("[ -]"), F.lit(0))
        initial = lambda p: F.concat(F.upper(F.left(p.norm, F.lit(1))), F.lit("."))
        as_written = lambda p, t: F.when(~p.formed | (p.kind == "kept"), p.norm).when(t.endswith("."), initial(p)).when((F.length(t) > 1) & (t == F.upper(t)), F.upper(p.norm)).otherwise(F.initcap(p.norm))
        named = F.array_join(F.transform(v.made, lambda p, i: F.concat(as_written(p, F.get(tokens, i)), F.coalesce(F.get(joints, i), F.lit("")))), "")
        one = F.get(v.made, F.lit(0))
        plain = F.when(one.formed & ~one.kind.isin("email", "ip", "ip6"), poured(v.entity, one.norm)).otherwise(one.norm)
        return F.when(F.size(v.made) == 0, v.entity).when(one.kind.isin("name", "kept"), F.concat(F.regexp_extract(v.entity, TITLE, 0), named)).otherwise(plain)

    return let(F.struct(entity.alias("entity"), F.transform(parts(entity), new).alias("made")), written)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kind, norm, said), distinct: what is mentioned where."""
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(entities(F.col("text"))).alias("entity"))
    return found.select("doc_id", "text_hash", F.explode(parts(F.col("entity"))).alias("p")).select("doc_id", "text_hash", "p.*").where("kind <> 'kept'").distinct()


def later_attempts(mentions: DataFrame, key: str) -> DataFrame:
    """(kind, norm, code) of the entities whose first surrogate collides, or whose gender is not the one read off."""
    votes = lambda g: F.count(F.when(F.col("said") == g, 1))
    known = mentions.groupBy("kind", "norm").agg(votes("f").alias("f"), votes("m").alias("m"))
    told = F.when(F.col("f") > F.col("m"), True).when(F.col("m") > F.col("f"), False).otherwise(female(F.col("norm")))
    known = known.select("kind", "norm", told.alias("female"))

    def given(rows: DataFrame) -> DataFrame:
        return rows.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key, F.col("female")))

    rounds = Latest("pii-surrogates")
    held = rounds.put(given(known.withColumn("attempt", F.lit(0))))
    while True:
        # of the entities with one surrogate, the one with the fewest attempts keeps it; a real entity's form is never used
        shared = held.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "norm")).norm.alias("owner"))
        lost = held.join(shared.where("n > 1"), ["kind", "surrogate"]).where("norm != owner").select("kind", "norm")
        real = held.select("kind", F.col("norm").alias("surrogate"))
        lost = materialize(lost.unionByName(held.join(real, ["kind", "surrogate"], "left_semi").select("kind", "norm")).distinct(), "pii-lost")
        if lost.isEmpty():
            code = 2 * F.col("attempt") + F.when((F.col("kind") == "name") & (F.col("female") != female(F.col("norm"))), 1).otherwise(0)
            return held.select("kind", "norm", code.alias("code")).where("code > 0")
        again = held.join(broadcast_if_small(lost.withColumn("lost", F.lit(1))), ["kind", "norm"], "left")
        held = rounds.put(given(again.select("kind", "norm", "female", (F.col("attempt") + F.coalesce("lost", F.lit(0))).alias("attempt"))))


def replace_pii(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """The rows with surrogates in text; count names an optional column for the number of entities replaced."""
    mentions = materialize(occurrences(docs), "pii-mentions")
    late = materialize(later_attempts(mentions, key), "pii-late")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc_id, text = (plain[names[docs.columns.index(c)]] for c in ("doc_id", "text"))
    none = F.create_map().cast("map<string,int>")
    if late.isEmpty():
        rows = plain.withColumn("_codes", none)
    else:
        of_doc = mentions.select("doc_id", "text_hash", "kind", "norm").distinct().join(broadcast_if_small(late), ["kind", "norm"]).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        of_doc = materialize(of_doc.agg(F.map_from_entries(F.collect_list(F.struct(_part_key(F.col("kind"), F.col("norm")), "code"))).alias("_codes")), "pii-codes")
        rows = plain.join(broadcast_if_small(of_doc), doc_id.eqNullSafe(of_doc["_id"]) & (F.xxhash64(text) == of_doc["_hash"]), "left")
        rows = rows.withColumn("_codes", F.coalesce("_codes", none))
    body = names[docs.columns.index("text")]
    rows = rows.select(*names, "_codes", entities(F.col(body)).alias("_titled"))
    rows = rows.select(*names, "_codes", "_titled", with_bare_names(F.col("_titled")).alias("_pattern"))
    # only texts with names are searched again, for those without a title
    found = F.when(F.length("_pattern") > len(PATTERN), found_by(F.col(body), F.col("_pattern"))).otherwise(F.col("_titled"))
    rows = rows.select(*names, "_codes", "_pattern", found.alias("_found"))
    rows = rows.withColumn("_new", F.transform("_found", lambda e: replacement(e, F.col("_codes"), key)))
    between = F.split(F.col(body), F.col("_pattern"), -1)
    woven = F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("b"), F.col("_new").alias("n")), lambda z: F.array(z.b, F.coalesce(z.n, F.lit(""))))), "")
    rows = rows.withColumn(body, F.when(F.size("_found") > 0, woven).otherwise(F.col(body)))
    number = F.coalesce(F.size(F.filter(F.arrays_zip("_found", "_new"), lambda z: z["_found"] != z["_new"])), F.lit(0)).cast("long")
    out = rows.select(*names, *([number.alias("_count")] if count else []))
    return out.toDF(*docs.columns, *([count] if count else []))
