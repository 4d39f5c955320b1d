"""PII surrogates: keyed, type-consistent replacements.

Method. One regular expression finds candidate entities; each is typed by its form
and checked (payment cards by the Luhn sum, addresses by octet range, phones by their
number of digits), and what fails a check stays as it is. An entity is made of units with a
canonical value: a phone's national number, a card's digits, the lower-cased mail address, the
secret as it stands, each name after a title. Names that a title tells are also found where they
stand bare later or earlier in the same text. A unit's
surrogate is a function of (key, type, canonical value, attempt): a keyed SHA-256
stream replaces digits by digits and letters by letters of the same script and case; cards
keep their issuer digit and a valid Luhn sum, phones their country code, mails
their top-level domain, secrets their issuer's prefix, network addresses remain addresses, first names keep the
title's gender and names their script. The source's punctuation, spacing and case
are laid over the surrogate. So one entity reads alike wherever and however it is
written (coreference). A first name whose title tells no gender (Dr Anna) takes the gender that
another title tells of it anywhere in the corpus (Mrs Anna), and so its surrogate.

Collision checks. The distinct units of the corpus are one table. While two units
of a kind (first names are one kind, whatever their gender) share a surrogate, or a surrogate equals a unit that occurs, all but the
smallest of them move to their next attempt. Each attempt makes names one syllable longer, and from attempt WIDER on phones
one digit, so that the spaces do not run out; those of cards, bank accounts, addresses and security numbers hold
over a thousand million values. Attempts above 0 are rare; they
return to the texts as a literal map up to MAP_LIMIT units and by joins beyond it.

All row work is built-in expressions. Hot entities cost nothing: surrogates are computed in place, and
distinct units are pre-aggregated in each task. Patterns start only at a word's boundary and are possessive
or bounded, so that long unbroken texts take linear time.

Edge cases: null text stays null; empty texts stay empty; texts without entities
are unchanged byte for byte; repeated rows change alike; an empty table gives an
empty result; all input columns are kept, whatever their names (``n_chars``, if there, is recounted, and ``n_entities`` replaced).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import release, stored, table

KEY = "surrogates-1"
MAP_LIMIT = 10_000
WIDER = 16
#: Titles by gender ("": none is told).
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "г-жа", "госпожа"],
    "": ["Dr", "Prof"],
}
#: Syllables from which surrogate names are made, by script; endings by gender.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ha he ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo wa we za zo".split(),
    "cyrillic": "ба бе би бо да де ди до га ге ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то ва ве ви во за зо".split(),
}
ENDINGS = {"latin": {"m": ["n", "rt", "s", "ld"], "f": ["na", "lia", "ra", "sa"]}, "cyrillic": {"m": ["н", "рт", "с", "й"], "f": ["на", "лия", "ра", "са"]}}
#: Country calling codes of one and of two digits; all others have three.
CALLING = r"1|7|20|27|3[0-4]|36|39|4[01]|4[3-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_TITLE = "|".join(sorted({x for v in TITLES.values() for t in v for x in (t, t.upper())}, key=lambda t: (-len(t), t)))
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}++(?:-\p{L}++|['’]\p{L}{2,}+)*+"
#: Particles that stand before a surname.
PARTICLES = ["van", "von", "der", "den", "zu", "de", "la", "le", "du", "del", "della", "di", "da", "dos", "bin", "al"]
_BEFORE = rf"(?:(?:\p{{Lu}}\.|{'|'.join(PARTICLES)}) ){{0,3}}"
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
PREFIX = r"(?:AKIA|ASIA|AIza|eyJ|gh[pousr][_\-]|sk[_\-]|pk[_\-]|xox[abp][_\-])"
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]++\.){1,127}\p{L}{2,}+"  # a domain has at most 127 labels
NAME = rf"(?<!\p{{L}})(?:(?:{_TITLE})\.? ){{1,4}}{_BEFORE}{_WORD}(?: {_BEFORE}{_WORD}){{0,2}}"
SECRET = rf"(?<![\p{{L}}\p{{N}}_\-])(?:[0-9a-fA-F]{{32,128}}+{_END}|(?:AKIA|ASIA)[0-9A-Z]{{16}}{_END}|AIza[0-9A-Za-z_\-]{{35}}{_END}|eyJ[A-Za-z0-9_\-]{{8,2048}}+(?:\.[A-Za-z0-9_\-]{{8,2048}}+){{2}}{_END}|(?:gh[pousr]|sk|pk|xox[abp])[_\-][A-Za-z0-9_\-]{{16,512}}+{_END})"
IBAN = rf"{_EDGE}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
IP6 = r"(?<![\p{L}\p{N}:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = rf"{_EDGE}(?:\d{{4}}(?:[ \-]?\d{{4}}){{2}}[ \-]?\d{{1,7}}|3[47]\d{{2}}[ \-]\d{{6}}[ \-]\d{{5}})(?!\d)"
# with a country code; ten digits in threes and four; with a trunk zero in pairs, or as area and number
PHONE = rf"(?<![\p{{L}}\p{{N}}+])(?:\+\d{{1,3}}(?:[ .\-]?\(?\d{{1,5}}\)?){{2,7}}|(?:1[ .\-])?(?:\(\d{{2,4}}\)[ .\-]?|\d{{3}}[ .\-])\d{{3,4}}[ .\-]\d{{4}}|0\d(?:[ .\-]\d{{2}}){{4}}|\(?0\d{{2,4}}\)?[ /.\-]\d{{3,4}}[ .\-]?\d{{3,4}})(?!\d){_END}"
ANY = "|".join([EMAIL, SECRET, IBAN, IP, IP6, SSN, CARD, PHONE, NAME])
#: Cheap test first: each form of entity holds a digit, an @, a title before a capital, a secret's prefix, or 32 hexadecimal letters.
HINT = rf"[0-9@]|(?<!\p{{L}})(?:{_TITLE})\.? (?:\p{{Lu}}|(?:{'|'.join(PARTICLES)}) )|(?:AKIA|ASIA)[A-Z]{{16}}|AIza|eyJ|::|(?:gh[pousr]|sk|pk|xox[abp])[_\-][A-Za-z_\-]{{16}}|[a-fA-F]{{32}}"
NAMES = ["first_f", "first_m", "first_n", "surname"]
UNIT = "struct<type:string,canon:string>"


def let(value: Column, use) -> Column:
    """``use`` of ``value``, which is written and computed once."""
    return F.transform(F.array(value), use)[0]


def no_units() -> Column:
    return F.array().cast(f"array<{UNIT}>")


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def national(phone: Column) -> Column:
    """A phone's digits without country code, or without the trunk digit where there is none."""
    digits = only_digits(phone)
    code = F.regexp_replace(digits, rf"^(?:{CALLING}|\d{{3}})0?", "")
    return F.when(phone.startswith("+"), code).otherwise(F.regexp_replace(digits, r"^(?:0+|1(?=\d{10}$))", ""))


def luhn(digits: Column, keep_last: bool = True) -> Column:
    """The Luhn sum modulo 10; without ``keep_last``, of the digits and a 0."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == (1 if keep_last else 0)
        return total + F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.when(n > 0, F.aggregate(places, F.lit(0), add) % 10).otherwise(F.lit(0))


def entity_type(e: Column) -> Column:
    """The entity's type by its form; null if a check fails."""
    whole = lambda p: e.rlike(f"^(?:{p})$")
    octets = F.forall(F.split(e, r"\."), lambda o: o.cast("int") <= 255)
    card = let(only_digits(e), lambda d: F.length(d).between(13, 19) & (luhn(d) == 0))
    return (
        F.when(e.contains("@"), "email")
        .when(whole(IP), F.when(octets, "ip"))
        .when(whole(IP6), F.when(e.rlike("[0-9]"), "ip6"))
        .when(whole(SSN), "ssn")
        .when(whole(SECRET), "secret")
        .when(whole(IBAN), "iban")
        .when(whole(CARD) & card, "card")
        .when(whole(PHONE), F.when(F.length(only_digits(e)).between(8, 15), "phone"))
        .when(whole(NAME), "name")
    )


def units(e: Column) -> Column:
    """The entity's units: (type, canonical value); empty if it is none. Initials and particles are units of type ``keep``."""
    one = lambda t, c: F.array(F.struct(F.lit(t).alias("type"), c.alias("canon")))
    gender = lambda title: F.when(title.isin([x.lower() for x in TITLES["f"]]), "f").when(title.isin([x.lower() for x in TITLES["m"]]), "m").otherwise("n")

    def names(parts: Column) -> Column:
        titles = [t.lower() for v in TITLES.values() for t in v]
        bare = F.transform(parts, lambda p: F.lower(F.regexp_replace(p, r"\.$", "")))
        first = let(F.concat(bare, F.array(F.lit(""))), lambda b: F.array_position(F.transform(b, lambda p: ~p.isin(titles)), True))  # the first part that is no title
        told = F.coalesce(F.get(F.filter(F.transform(F.slice(bare, F.lit(1), first.cast("int") - 1), gender), lambda g: g != "n"), F.lit(0)), F.lit("n"))
        own = F.slice(parts, first.cast("int"), F.greatest(F.size(parts) - first.cast("int") + 1, F.lit(0)))
        kind = lambda p, i, n: F.when(p.endswith(".") | p.isin(PARTICLES), "keep").when(i == n - 1, "surname").otherwise(F.concat(F.lit("first_"), told))
        return let(own, lambda o: F.transform(o, lambda p, i: F.struct(kind(p, i, F.size(o)).alias("type"), F.lower(p).alias("canon"))))

    def by(kind: Column) -> Column:
        return (
            F.when(kind == "name", let(F.split(e, " "), names))
            .when(kind == "phone", one("phone", national(e)))
            .when(kind == "email", one("email", F.lower(e)))
            .when(kind == "ip", one("ip", e))
            .when(kind == "ip6", one("ip6", F.lower(e)))
            .when(kind == "secret", one("secret", F.when(e.rlike("^[0-9a-fA-F]{32,128}$"), F.lower(e)).otherwise(e)))
            .when(kind == "iban", one("iban", F.regexp_replace(e, " ", "")))
            .when(kind == "card", one("card", only_digits(e)))
            .when(kind == "ssn", one("ssn", only_digits(e)))
            .otherwise(no_units())
        )

    return let(entity_type(e), by)


def bare(e: Column, known: Column) -> Column:
    """Units of names that stand without a title, by those ``known`` in the text: the last of several is rather a surname, the others first names."""
    parts = F.split(e, " ")

    def one(p: Column, i: Column) -> Column:
        own = F.filter(known, lambda u: u["canon"] == F.lower(p))
        last = i == F.size(parts) - 1
        wanted = F.filter(own, lambda u: (u["type"] == "surname") == last)
        return F.coalesce(F.get(wanted, F.lit(0)), F.get(own, F.lit(0)), F.struct(F.lit("keep").alias("type"), p.alias("canon")))

    return F.transform(parts, one)


def bare_pattern(known: Column) -> Column:
    """ANY, or one to three capitalised words of ``known``."""
    words = F.concat(F.lit(r"(?=\p{Lu})(?iu:"), F.array_join(F.array_distinct(F.transform(known, lambda u: u["canon"])), "|"), F.lit(")"))
    return let(words, lambda w: F.concat(F.lit(ANY + r"|(?<!\p{L})"), w, F.lit("(?: "), w, F.lit(r"){0,2}(?!\p{L})")))


def _letter(c: Column, v: Column) -> Column:
    """A character of the same kind as ``c``, chosen by the number ``v``."""
    pick = lambda alphabet: F.substring(F.lit(alphabet), (v % len(alphabet) + 1).cast("int"), F.lit(1))
    return (
        F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστυφχψω")).when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz")).otherwise(c)
    )


def surrogate(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The canonical surrogate of a unit."""
    block = lambda b: F.sha2(F.concat_ws("\u001f", F.lit(key), kind, canon, attempt.cast("string"), F.lit(str(b))).cast("binary"), 256)

    def made(s: Column) -> Column:
        value = lambda i: F.conv(F.substring(s, ((i * 3) % 126 + 1).cast("int"), F.lit(3)), 16, 10).cast("int") + i.cast("int")
        each = lambda text, of: F.when(F.length(text) > 0, F.concat_ws("", F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: of(F.substring(text, i, F.lit(1)), value(i))))).otherwise("")
        mapped = lambda text: each(text, _letter)
        hexes = each(canon, lambda c, v: F.substring(F.lit("0123456789abcdef"), v % 16 + 1, F.lit(1)))
        prefix = F.regexp_extract(canon, f"^{PREFIX}?", 0)
        secret = F.when(canon.rlike("^[0-9a-f]{32,128}$"), hexes).otherwise(F.concat(prefix, mapped(canon.substr(F.length(prefix) + 1, F.length(canon)))))
        body = F.concat(F.substring(canon, 1, 1), mapped(canon.substr(F.lit(2), F.length(canon) - 2)))
        card = let(body, lambda b: F.concat(b, ((10 - luhn(b, keep_last=False)) % 10).cast("string")))
        octet = lambda k: (value(F.lit(k)) % 254 + 1).cast("string")
        top = F.concat(F.lit("."), F.substring_index(canon, ".", -1))
        mail = F.concat(mapped(canon.substr(F.lit(1), F.length(canon) - F.length(top))), top)
        more = F.greatest(attempt - F.lit(WIDER - 1), F.lit(0))
        phone = mapped(F.concat(canon, F.repeat(F.lit("0"), more)))
        iban = F.concat(F.substring(canon, 1, 2), mapped(canon.substr(F.lit(3), F.length(canon))))

        def name(script: str) -> Column:
            syllables = F.array(*[F.lit(x) for x in SYLLABLES[script]])
            count = F.when(kind == "surname", 4).otherwise(2) + attempt
            stem = lambda n, of: F.concat_ws("", F.transform(F.sequence(F.lit(1), n), lambda k: F.element_at(syllables, value(k + 11 * of) % len(SYLLABLES[script]) + 1)))
            endings = F.when(kind == "first_f", F.array(*[F.lit(x) for x in ENDINGS[script]["f"]])).otherwise(F.array(*[F.lit(x) for x in ENDINGS[script]["m"]]))
            more = F.transform(F.slice(F.split(canon, "-"), F.lit(2), F.size(F.split(canon, "-"))), lambda p, i: F.concat(F.lit("-"), stem(F.lit(3), i + 1)))  # a name of several parts stays one
            return F.concat(stem(count, F.lit(0)), F.element_at(endings, value(F.lit(0)) % 4 + 1), F.concat_ws("", more))

        return (
            F.when(kind == "email", mail).when(kind == "ip", F.concat_ws(".", *[octet(k) for k in (1, 2, 3, 4)])).when(kind == "ip6", F.concat_ws(":", *[F.substring(s, 4 * k + 1, 4) for k in range(8)])).when(kind == "secret", secret).when(kind == "iban", iban).when(kind == "card", card)
            .when(kind == "phone", phone).when(kind == "ssn", mapped(canon)).when(kind == "keep", canon).when(canon.rlike(r"\p{IsCyrillic}"), name("cyrillic")).otherwise(name("latin"))
        )

    return let(F.concat(*[block(b) for b in range(2)]), made)


def _cased(source: Column, text: Column) -> Column:
    """``text`` with the case of ``source``: all upper, each part capitalised, or as it is."""
    return F.when((F.upper(source) == source) & (F.lower(source) != source) & (F.length(source) > 1), F.upper(text)).when(F.substring(source, 1, 1).rlike(r"\p{Lu}"), F.array_join(F.transform(F.split(text, "-"), F.initcap), "-")).otherwise(text)


def _each_cased(source: Column, text: Column) -> Column:
    """``text`` with the case of ``source``, character by character."""
    c = lambda t, i: F.substring(t, i, F.lit(1))
    return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(source)), lambda i: F.when(c(source, i).rlike(r"\p{Lu}"), F.upper(c(text, i))).otherwise(c(text, i))))


def _laid(source: Column, digits: Column) -> Column:
    """``digits`` in the places of the source's digits (or letters and digits); what is left over follows."""

    def add(state: Column, i: Column) -> Column:
        c = F.substring(source, i, F.lit(1))
        own = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(state["text"], F.when(own, F.substring(digits, state["at"], F.lit(1))).otherwise(c)).alias("text"), (state["at"] + own.cast("int")).alias("at"))

    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
    return F.aggregate(F.sequence(F.lit(1), F.length(source)), start, add, lambda s: F.concat(s["text"], digits.substr(s["at"], F.length(digits))))


def replaced(e: Column, us: Column, made: Column) -> Column:
    """Entity ``e`` with units ``us`` and their surrogates ``made``."""
    kind, first = us[0]["type"], made[0]

    def name(parts: Column) -> Column:
        titles = F.size(parts) - F.size(us)  # 1, or 0 without a title
        return F.concat_ws(" ", F.transform(parts, lambda p, i: F.when((i < titles) | (F.get(us, i - titles)["type"] == "keep"), p).otherwise(_cased(p, F.get(made, i - titles)))))

    phone = let(only_digits(e), lambda d: _laid(e, F.concat(d.substr(F.lit(1), F.length(d) - F.length(us[0]["canon"])), first)))
    return (
        F.when(F.size(us) == 0, e).when(kind.isin(*NAMES, "keep"), let(F.split(e, " "), name)).when(kind == "phone", phone)
        .when(kind.isin("card", "ssn", "iban"), _laid(e, first)).when(kind.isin("email", "secret"), _each_cased(e, first)).otherwise(first)
    )


def attempts(found: DataFrame, key: str = KEY) -> DataFrame:
    """(type, canon, as_type, attempt, made) for distinct units, without collisions; a first name without gender is ``as_type`` one with gender, if that occurs."""
    seen = stored(found.select("type", "canon").distinct())
    told = seen.where(F.col("type").isin("first_f", "first_m")).groupBy("canon").agg(F.min("type").alias("as_type")).withColumn("type", F.lit("first_n"))
    aliases = stored(seen.join(told, ["type", "canon"]).select("type", "canon", "as_type"))
    own = seen.join(aliases.select("type", "canon"), ["type", "canon"], "left_anti")
    group = F.when(F.col("type").startswith("first_"), "first").otherwise(F.col("type"))
    made = surrogate(F.col("type"), F.col("canon"), F.col("attempt"), key)
    state = stored(own.withColumn("attempt", F.lit(0)).withColumn("made", made))
    while True:
        unit = F.struct("canon", "type")
        least = state.groupBy(group.alias("g"), F.col("made").alias("m")).agg(F.min(unit).alias("least"), F.count("*").alias("n")).where("n > 1")
        twins = state.join(least, (group == F.col("g")) & (F.col("made") == F.col("m")) & (unit > F.col("least"))).select("type", "canon")
        real = state.select(group.alias("g"), F.col("canon").alias("c")).distinct()
        taken = state.join(real, (group == F.col("g")) & (F.col("made") == F.col("c")), "left_semi").select("type", "canon")
        bad = stored(twins.union(taken).distinct().withColumn("bad", F.lit(1)))
        if not bad.take(1):
            release(bad)
            break
        moved = state.join(bad, ["type", "canon"], "left").withColumn("again", F.col("bad").isNotNull()).withColumn("attempt", F.col("attempt") + F.col("again").cast("int"))
        passed, state = state, stored(moved.withColumn("made", F.when(F.col("again"), made).otherwise(F.col("made"))).select("type", "canon", "attempt", "made"))
        release(passed, bad)
    through = aliases.join(state.select(F.col("type").alias("as_type"), "canon", "attempt", "made"), ["as_type", "canon"])
    columns = ["type", "canon", "as_type", "attempt", "made"]
    out = stored(state.withColumn("as_type", F.col("type")).select(*columns).unionByName(through.select(*columns)))
    release(seen, aliases, state)
    return out


def with_surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with entities of ``text`` replaced, and ``n_entities``."""
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    none = F.array().cast("array<string>")
    seen = docs.select(F.when(hinted, F.array_distinct(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))).otherwise(none).alias("es")).where("size(es) > 0")
    found = seen.select(F.explode("es").alias("e")).distinct().select(F.explode(units(F.col("e"))).alias("u")).select("u.type", "u.canon").where("type <> 'keep'")
    all_units = attempts(found, key)
    moved = all_units.where("attempt > 0 or as_type <> type").select("type", "canon", "as_type", "attempt")
    few = moved.limit(MAP_LIMIT + 1).count() <= MAP_LIMIT

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text", F.when(hinted, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(none).alias("es"))
    rows = rows.withColumn("us", F.transform("es", units))
    rows = rows.withColumn("known", F.array_sort(F.array_distinct(F.filter(F.flatten("us"), lambda u: u["type"].isin(NAMES)))))
    named = F.size("known") > 0
    rows = rows.withColumn("pattern", F.when(named, bare_pattern(F.col("known"))).otherwise(F.lit(ANY)))
    rows = rows.withColumn("es", F.when(named, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("es")))
    again = F.transform("es", lambda e: let(units(e), lambda us: F.when((F.size(us) == 0) & e.rlike(r"^\p{Lu}"), bare(e, F.col("known"))).otherwise(us)))
    rows = rows.withColumn("us", F.when(named, again).otherwise(F.col("us")))
    if few:
        listed = {f"{r['type']}:{r['canon']}": {"as_type": r["as_type"], "attempt": r["attempt"]} for r in moved.collect()}
        release(all_units)
        known = F.from_json(F.lit(json.dumps(listed)), "map<string,struct<as_type:string,attempt:int>>")
        own = lambda u: known[F.concat(u["type"], F.lit(":"), u["canon"])] if listed else F.lit(None).cast("struct<as_type:string,attempt:int>")
    else:
        text = F.when(F.size("es") > 0, F.sha2(F.col("text").cast("binary"), 256))  # equal texts are replaced alike
        rows = rows.withColumn("same", text)
        each = rows.where("size(es) > 0").dropDuplicates(["same"]).select("same", F.explode(F.array_distinct(F.flatten("us"))).alias("u")).select("same", "u.type", "u.canon")
        hits = each.join(moved, ["type", "canon"]).groupBy("same").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "type", "canon"), F.struct("as_type", "attempt")))).alias("moved"))
        rows = rows.join(hits, "same", "left").drop("same")
        own = lambda u: F.col("moved")[F.concat(u["type"], F.lit(":"), u["canon"])]
    made = lambda u: let(own(u), lambda m: surrogate(F.coalesce(m["as_type"], u["type"]), u["canon"], F.coalesce(m["attempt"], F.lit(0)), key))
    rows = rows.withColumn("made", F.transform("us", lambda us: F.transform(us, made)))
    rows = rows.withColumn("changed", F.transform(F.arrays_zip(F.col("es").alias("e"), F.col("us").alias("us"), F.col("made").alias("made")), lambda z: replaced(z["e"], z["us"], z["made"])))
    gaps = F.when(named, F.split("text", F.col("pattern"), -1)).otherwise(F.split("text", ANY, -1))
    woven = F.concat_ws("", F.transform(F.arrays_zip(gaps.alias("g"), F.col("changed").alias("c")), lambda z: F.concat(z["g"], F.coalesce(z["c"], F.lit("")))))
    rows = rows.withColumn("text", F.when(F.size("es") > 0, woven).otherwise(F.col("text")))
    counted = F.size(F.filter("us", lambda us: F.exists(us, lambda u: u["type"] != "keep"))).cast("long")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[(new[c] if c in new else F.col("doc")[c]).alias(c) for c in docs.columns if c != "n_entities"], counted.alias("n_entities"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents"))
