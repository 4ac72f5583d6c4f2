r"""Surrogates for personal data, with SQL functions alone.

Entities are found by patterns, once. A surrogate is a keyed permutation of the entity within its own format: a
Feistel network over the letters and digits in which each character moves within its class (vowels,
consonants, digits, other letters of a script; case is put back). It is one-to-one for a draw of the key. Then
the whole table is checked: an entity whose surrogate is its own text, that of any entity of the table, or another's
surrogate draws again; from draw LONGER on names and addresses also grow by a letter a draw, so that even a table
that has every entity of a form can be served. Names are replaced part by part: a family name has one surrogate
whatever the title, and given names of a list move within it, which keeps their gender. Kept: country
codes of phones and IBANs, the last part of a mail domain, titles of persons, prefixes of keys, the names that
secrets are assigned to, whether a card passes the Luhn test.
"""

from __future__ import annotations

import json
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

# An assignment to a secret's name, up to its value; values with a vendor's prefix are keys.
_ASSIGNED = r"(?i:token|key|secret|password|passwd)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?"
_VENDOR = r"(?:AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abp]-|glpat-)"
# Patterns of entities, in the order they are tried. Repetitions are possessive or bounded, so that no text
# takes more than linear time or a deep stack.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LABEL = r"[A-Za-z0-9-]"
_TITLE = r"(?:Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora|Señor|Господин|Госпожа)"
_WORD = r"(?:\p{Lu}(?:['’](?=\p{Lu}))?+[\p{L}\p{M}]++|\p{Lo}[\p{Lo}\p{M}]*+)"
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:{_LABEL}++(?:\.{_LABEL}++)++(?<=\.[A-Za-z]{{2,63}})|(?:{_LABEL}{{1,63}}\.){{1,126}}[A-Za-z]{{2,63}})",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:gh[pousr]_|sk[-_](?:live_|test_)?|xox[abp]-|glpat-)[A-Za-z0-9_-]{16,}+",
    "hex": rf"{_ASSIGNED}(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{{16,}}+(?![A-Za-z0-9+/_=-])",
    "secret": rf"{_ASSIGNED}(?!{_VENDOR})(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{16,}}+={{0,2}}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\.?[ \xA0](?:{_WORD}|\p{{Lu}}\.)(?:[ -]{_WORD})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has some of.
MAYBE = rf"[0-9@]|{_TITLE}[. \xA0]"
# Characters that replace each other.
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
ALPHABETS = ["0123456789", VOWELS, CONSONANTS, "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
# First and last letter of scripts whose letters all replace each other.
SCRIPTS = [(0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE30), (0x10D0, 0x10FA), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
HEX = "abcdef"


def _others() -> list[str]:
    """The other small letters of Latin, Greek, Cyrillic and Armenian: Latin ones by whether a vowel is at their base, and those
    without a capital of one letter by themselves."""
    have, out = set("".join(ALPHABETS)), {}
    for c in map(chr, [*range(0xDF, 0x250), *range(0x1E00, 0x1F00), *range(0x370, 0x590), *range(0x1F00, 0x2000)]):
        if c.islower() and c not in have:
            base = unicodedata.normalize("NFD", c)[0]
            script = "vowel" if base in VOWELS else "latin" if c < "\u0250" or "\u1e00" <= c < "\u1f00" else unicodedata.name(c, "?").split()[0]
            single = len(c.upper()) == 1 and c.upper().lower() == c
            out.setdefault((script, single), []).append(c)
    return ["".join(x) for x in out.values() if len(x) > 1]


ALPHABETS += _others()
LETTERS = "".join(ALPHABETS)
#: For each of LETTERS, in eight digits: where its class begins, and how many letters it has.
CLASSES = "".join(f"{LETTERS.index(a[0]):04d}{len(a):04d}" * len(a) for a in ALPHABETS)
# Given names by gender, which replace each other.
GIVEN = [
    ["james", "john", "robert", "michael", "william", "david", "thomas", "paul", "peter", "hans", "jean", "carlos"],
    ["mary", "anna", "linda", "susan", "karen", "laura", "sarah", "julia", "maria", "petra", "claire", "carmen"],
]
KEPT = {
    "key": r"^(?:AKIA|ASIA|gh[pousr]_|sk[-_](?:live_|test_)?|xox[abp]-|glpat-)",
    "hex": rf"^{_ASSIGNED}", "secret": rf"^{_ASSIGNED}", "iban": r"^[A-Z]{2}", "phone": r"^\+[0-9]{1,3}(?=[ .(-])",
}
PLAIN = r"[^\p{L}\p{N}]"
#: Turns of the network, characters that one network takes, the draw from which names and addresses grow, and the last draw.
TURNS, PIECE, LONGER, LAST = 4, 64, 6, 60
#: Redrawn entities that go to every task as a literal, at most; more of them are joined.
FEW = 1000


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def _first(branches: list[tuple[Column, Column]], rest: Column) -> Column:
    return reduce(lambda out, b: F.when(*b).otherwise(out), reversed(branches), rest)


def _kind(v: Column) -> Column:
    return _first([(v.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], F.lit("other"))


def _lower(v: Column) -> Column:
    """v in small letters, one for each of its characters."""
    return F.lower(F.replace(v, F.lit("İ"), F.lit("i")))


def _plain(v: Column) -> Column:
    return _lower(F.regexp_replace(v, PLAIN, ""))


def _moved(half: Column, other: Column, secret: Column, turn: Column) -> Column:
    """half, each character moved within its class by an amount that secret, turn and other give."""
    key = F.sha2(F.concat_ws("|", secret, turn.cast("string"), other), 256)

    def turned(start: Column, size: Column, at: Column, by: Column) -> Column:
        return start + (at - start + by) % size

    def listed(at: Column, by: Column) -> Column:
        class_ = F.substring(F.lit(CLASSES), at * 8 + 1, F.lit(8))
        return F.substring(F.lit(LETTERS), turned(F.substring(class_, 1, 4).cast("int"), F.substring(class_, 5, 4).cast("int"), at, by) + 1, F.lit(1))

    def unlisted(cp: Column, by: Column) -> Column:
        # Letters of other scripts move among the 16 around them.
        start = _first([(cp.between(a, b), F.lit(a)) for a, b in SCRIPTS], (cp - cp % 16).cast("int"))
        size = _first([(cp.between(a, b), F.lit(b - a + 1)) for a, b in SCRIPTS], F.lit(16))
        return F.decode(F.unhex(F.lpad(F.hex(turned(start, size, cp, by)), 8, "0")), "UTF-32")

    def char(digest: Column, c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, (i * 3) % 61 + 1, F.lit(4)), 16, 10).cast("int")
        # Hex values stay hex: their letters move among the first six.
        hexed = F.substring(F.lit(HEX), (F.instr(F.lit(HEX), c) - 1 + by) % len(HEX) + 1, F.lit(1))
        known = [
            ((c == "") | ~c.rlike(r"[\p{L}\p{N}]"), c),
            (F.endswith(secret, F.lit("|hex")) & (F.instr(F.lit(HEX), c) > 0), hexed),
            (F.instr(F.lit(LETTERS), c) > 0, _let(F.instr(F.lit(LETTERS), c) - 1, lambda at: listed(at, by))),
        ]
        return _first(known, F.when(c.rlike(r"\p{L}"), unlisted(F.ascii(c), by)).otherwise(c))

    return _let(key, lambda d: F.array_join(F.transform(F.split(half, ""), lambda c, i: char(d, c, i)), ""))


def _permuted(plain: Column, secret: Column) -> Column:
    return _let(plain, lambda p: _turned(p, secret))


def _turned(plain: Column, secret: Column) -> Column:
    cut = F.floor(F.char_length(plain) / 2).cast("int")
    start = F.struct(F.substring(plain, F.lit(1), cut).alias("l"), F.substring(plain, cut + 1, F.char_length(plain)).alias("r"))

    def turn(s: Column, t: Column) -> Column:
        # Halves change places, so that after an even number of turns they stand as before.
        return F.struct(s["r"].alias("l"), _moved(s["l"], s["r"], secret, t).alias("r"))

    return F.aggregate(F.array(*map(F.lit, range(TURNS))), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits, the last one counting once."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return (total + F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)) % 10

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _shaped(like: Column, plain: Column) -> Column:
    """The characters of plain at the places of like's letters and digits, in like's case."""

    def char(new: Column, c: Column, i: Column) -> Column:
        k = F.char_length(F.regexp_replace(F.substring(like, F.lit(1), i), PLAIN, "")) + 1
        n = F.substring(new, k, F.lit(1))
        return F.when(c.rlike(PLAIN), c).otherwise(F.when(c.rlike(r"\p{Lu}"), F.upper(n)).otherwise(n))

    return _let(plain, lambda p: F.array_join(F.transform(F.split(like, ""), lambda c, i: char(p, c, i)), ""))


def _ip(v: Column, secret: Column) -> Column:
    part = lambda i: F.split(v, r"\.")[i].cast("int")
    start = F.struct((part(0) * 256 + part(1)).alias("l"), (part(2) * 256 + part(3)).alias("r"))
    by = lambda x, t: F.conv(F.substring(F.sha2(F.concat_ws("|", secret, t.cast("string"), x.cast("string")), 256), 1, 4), 16, 10).cast("int")

    def joined(s: Column) -> Column:
        octets = [F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256]
        return F.concat_ws(".", *[o.cast("string") for o in octets])

    return F.aggregate(
        F.array(*map(F.lit, range(6))), start,
        lambda s, t: F.struct(s["r"].alias("l"), ((s["l"] + by(s["r"], t)) % 65536).alias("r")), joined,
    )


def _grown(v: Column, draw: Column) -> Column:
    """v and, from draw LONGER on, its own first letters once more, one for each draw."""
    more = F.lower(F.regexp_replace(v, r"[^\p{L}]", ""))
    more = F.when(more == "", "x").otherwise(more)
    return F.when(draw >= LONGER, F.concat(v, F.substring(F.repeat(more, LAST), F.lit(1), draw - (LONGER - 1)))).otherwise(v)


def _part(v: Column, kind: Column, draw: Column, key: str) -> Column:
    """The surrogate of a part of a name, kind being given or family."""
    secret = F.concat(F.lit(f"{key}|"), draw.cast("string"), F.lit("|"), kind)
    low = _lower(v)
    out = _grown(_shaped(v, _permuted(_plain(v), secret)), draw)
    for names in GIVEN:
        listed = F.array(*map(F.lit, names))
        by = F.conv(F.substring(F.sha2(F.lit(f"{key}|{names[0]}"), 256), 1, 4), 16, 10).cast("int") + draw
        moved = F.get(listed, ((F.array_position(listed, low) - 1 + by % (len(names) - 1) + 1) % len(names)).cast("int"))
        out = F.when((kind == "given") & (draw < LONGER) & F.array_contains(listed, low), F.initcap(moved)).otherwise(out)
    return out


def _value(v: Column, kind: Column, draw: Column, key: str) -> Column:
    """The surrogate of an entity that is no name."""
    secret = F.concat(F.lit(f"{key}|"), draw.cast("string"), F.lit("|"), kind)
    tail = F.when(kind == "email", F.regexp_extract(v, r"(\.[A-Za-z]+)$", 1)).otherwise("")

    def parts(p: Column) -> Column:
        body = F.substring(v, F.char_length(p["head"]) + 1, F.char_length(v) - F.char_length(p["head"]) - F.char_length(p["tail"]))
        # A long value is permuted piece by piece.
        pieces = F.regexp_extract_all(body, F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1))
        return F.concat(p["head"], F.array_join(F.transform(pieces, lambda b: _let(_plain(b), lambda plain: shaped(b, plain))), ""), p["tail"])

    def shaped(body: Column, plain: Column) -> Column:
        # The last digit of a card keeps its distance from the one that passes the Luhn test.
        card = kind == "card"
        last = lambda m: (_luhn(plain) - _luhn(F.concat(m, F.lit("0"))) + 10) % 10
        moved = _permuted(F.when(card, F.substring(plain, F.lit(1), F.char_length(plain) - 1)).otherwise(plain), secret)
        return _shaped(body, _let(moved, lambda m: F.when(card, F.concat(m, last(m).cast("string"))).otherwise(m)))

    rest = _let(F.struct(_head(v, kind).alias("head"), tail.alias("tail")), parts)
    longer = _let(rest, lambda x: F.concat(_grown(F.substring_index(x, "@", 1), draw), F.lit("@"), F.substring_index(x, "@", -1)))
    return F.when(kind == "ip", _ip(v, secret)).when((kind == "email") & (draw >= LONGER), longer).otherwise(rest)


def _head(v: Column, kind: Column) -> Column:
    return _first([(kind == k, F.regexp_extract(v, f"({p})", 1)) for k, p in KEPT.items()], F.lit(""))


def _same(v: Column, kind: Column) -> Column:
    """What is equal in entities that count as one: addresses but for case, all else but for case and punctuation."""
    bare = F.when(kind.isin("hex", "secret"), F.substring(v, F.char_length(_head(v, kind)) + 1, F.char_length(v))).otherwise(v)
    return F.when(kind.isin("email", "ip"), F.lower(v)).otherwise(_plain(bare))


# The parts of a name: title, given name (empty if there is one word only), what stands between, family name.
_NAME = rf"^({_TITLE}\.?[ \xA0])(?:((?:{_WORD}|\p{{Lu}}\.))([ -]))?((?:{_WORD}|\p{{Lu}}\.))$"


def _tokens(v: Column) -> Column:
    """array<struct<kind, v>>: what an entity has surrogates for; two for a name with a given name."""
    group = lambda i: F.regexp_extract(v, _NAME, i)
    token = lambda k, x: F.struct(k.alias("kind"), x.alias("v"))
    parts = F.filter(F.array(token(F.lit("given"), group(2)), token(F.lit("family"), group(4))), lambda t: t["v"] != "")
    return _let(_kind(v), lambda k: F.when(k == "name", parts).otherwise(F.array(token(k, v))))


def _surrogate(kind: Column, v: Column, draw: Column, key: str) -> Column:
    return F.when(kind.isin("given", "family"), _part(v, kind, draw, key)).otherwise(_value(v, kind, draw, key))


def _replacement(v: Column, draws, key: str) -> Column:
    """The surrogate of an entity; draws(kind, same) gives the draw of a token."""
    new = F.transform(_tokens(v), lambda t: _surrogate(t["kind"], t["v"], draws(t["kind"], _same(t["v"], t["kind"])), key))
    group = lambda i: F.regexp_extract(v, _NAME, i)
    name = lambda n: F.concat(group(1), F.get(n, F.lit(0)), F.when(F.size(n) > 1, F.concat(group(3), F.get(n, F.lit(1)))).otherwise(""))
    return _let(new, lambda n: F.when(v.rlike(_NAME), name(n)).otherwise(F.get(n, F.lit(0))))


def detected(docs: DataFrame) -> DataFrame:
    """doc (struct of docs' columns but text), found (entities of the text in order), gaps (what stands around them) of
    the texts that may have entities."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.lit(0).alias("__none"))
    found = F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))
    return docs.filter(F.col("text").rlike(MAYBE)).select(rest.alias("doc"), found.alias("found"), F.split("text", f"(?:{ANY})", -1).alias("gaps"))


def entities(found: DataFrame, key: str) -> DataFrame:
    """(kind, same, v, draw, surrogate) of the distinct entities of detected() rows, redrawn until all surrogates are
    distinct and none is an entity of the table. Raises ValueError if LAST draws do not do."""
    tokens = found.select(F.explode("found").alias("e")).distinct().select(F.explode(_tokens(F.col("e"))).alias("t")).select("t.*")
    tokens = tokens.select("kind", _same(F.col("v"), F.col("kind")).alias("same"), "v").filter("same <> ''")
    tokens = tokens.groupBy("kind", "same").agg(F.min("v").alias("v"))
    made = lambda draw: _surrogate(F.col("kind"), F.col("v"), draw, key)
    table = saved(tokens.withColumn("draw", F.lit(0)).withColumn("surrogate", made(F.col("draw"))), "entities")
    for _ in range(LAST):
        is_now = table.select("kind", "same", "draw", _same(F.col("surrogate"), F.col("kind")).alias("x"))
        uses = is_now.select("kind", "x", F.struct("draw", "same").alias("by")).unionByName(table.select("kind", F.col("same").alias("x"), F.lit(None).cast("struct<draw: int, same: string>").alias("by")))
        first = uses.groupBy("kind", "x").agg(F.min("by").alias("first"), F.count("by").alias("n"), F.count(F.lit(1)).alias("all"))
        taken = first.filter("n > 0 and `all` > 1").select("kind", "x", F.when(F.col("all") == F.col("n"), F.col("first.same")).alias("keeps"))
        again = is_now.join(taken, ["kind", "x"]).filter("keeps is null or keeps <> same").select("kind", "same", F.lit(1).alias("again"))
        again = saved(again, "again")
        if again.isEmpty():
            discard(again)
            return table
        drawn = table.join(again, ["kind", "same"], "left")
        drawn = drawn.select("kind", "same", "v", (F.col("draw") + F.coalesce("again", F.lit(0))).alias("draw"), "surrogate", "again")
        drawn = drawn.withColumn("surrogate", F.when(F.col("again") == 1, made(F.col("draw"))).otherwise(F.col("surrogate"))).drop("again")
        before, table = table, saved(drawn, "entities")
        discard(before, again)
    raise ValueError(f"surrogates collide after {LAST} draws")


def replaced(docs: DataFrame, key: str = "surrogates-1") -> DataFrame:
    """docs with every entity in its text replaced; all other columns, and all rows, stay.

    Null, empty and entity-free texts stay as they are; repeated rows stay repeated. Entities that are equal but for case and
    punctuation get the same surrogate, others different ones, none of which is an entity of the table. Columns may
    have any names; an empty table gives no rows.
    """
    found = detected(docs).withColumn("row", F.monotonically_increasing_id())
    found = saved(found, "detected")  # from here on rows keep their number
    redrawn = entities(found, key).filter("draw > 0").select(F.concat_ws("|", "kind", "same").alias("token"), "draw")
    redrawn = saved(redrawn, "redrawn")
    name = lambda kind, same: F.concat_ws("|", kind, same)
    n = redrawn.count()
    if not n:
        draws = lambda kind, same: F.lit(0)
    elif n <= FEW:
        few = F.from_json(F.lit(json.dumps({r["token"]: r["draw"] for r in redrawn.collect()})), "map<string,int>")
        draws = lambda kind, same: F.coalesce(F.try_element_at(few, name(kind, same)), F.lit(0))
    else:
        all_tokens = F.array_distinct(F.flatten(F.transform("found", lambda v: F.transform(_tokens(v), lambda t: name(t["kind"], _same(t["v"], t["kind"]))))))
        mine = found.select("row", F.explode(all_tokens).alias("token")).join(redrawn, "token")
        mine = mine.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("token", "draw"))).alias("mine"))
        found = found.join(mine, "row", "left").withColumn("mine", F.coalesce("mine", F.create_map().cast("map<string,int>")))
        draws = lambda kind, same: F.coalesce(F.try_element_at(F.col("mine"), name(kind, same)), F.lit(0))
    new = F.transform("found", lambda v: _replacement(v, draws, key))
    text = F.array_join(F.flatten(F.zip_with("gaps", new, lambda g, x: F.array(g, F.coalesce(x, F.lit(""))))), "")
    out = found.select(*[text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
    return docs.filter(~F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))).unionByName(out)
