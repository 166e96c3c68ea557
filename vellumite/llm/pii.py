"""PII: surrogates for detected entities.

Found are e-mail addresses, secrets (32 to 64 hexadecimal digits), payment card numbers, IBANs with a right check sum, IPv4
and IPv6 addresses, phone numbers, social security numbers and names after a courtesy title. Each gets a replacement of
the same type and form that depends on a key and on the entity's normal form only, so that an entity has one surrogate in
all documents (coreference): digits stay digits and letters stay letters of their script and case, separators and country
codes stay, card numbers stay valid or invalid by their check digit, IBANs stay valid, address bytes stay in range. A
name's words are entities of their own: a surname has one surrogate with any title, with or without a given name; a given
name keeps its gender, and both keep their script, hyphens and apostrophes. Initials become other initials. A full
name found after a title is replaced in the same text where it stands without one, too. Gender is told by the name's own
title, or else by its other mentions in the text, or else by the only gender that titles give that name anywhere.

Distinctness: all distinct entities and their surrogates are compared across the documents. Of entities that share a
surrogate, or whose surrogate is another entity, all but one take the next attempt, until none clash. Later attempts have
more room: surnames get further syllables, given names further names, e-mail addresses further letters. What was found out
about entities so (attempts, genders) is looked up in a table within the plan while it has at most `listed` entries, so
that texts aren't shuffled; beyond that it is joined to the documents, whose texts are written once for it.

All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

import hashlib
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable

# Courtesy titles by gender (x: either), words inside names, given names by script and gender, syllables.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "M", "Señor", "Sr", "Don", "г-н", "κ", "Κος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "г-жа", "Κα"],
    "x": ["Dr", "Prof", "Doctor", "Professor", "Doktor", "Docteur", "Dra", "Mx"],
}
PARTICLES = "von van de der den di da du la le del zu".split()
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Leo Max Noel Oscar Paul".split(),
    ("latin", "f"): "Anna Berta Clara Diana Elsa Flora Greta Helen Irma Julia Karin Laura Maria Nora Olga Petra".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Николай Олег Павел Роман Сергей Юрий".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Ксения Лидия Мария Нина Ольга Полина Раиса Юлия".split(),
    ("greek", "m"): "Άγγελος Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λευτέρης Μάρκος Νίκος Πέτρος Σπύρος Φώτης".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ra ri sa so ta to".split(),
    "cyrillic": "ба бе би бо да де ди до фа фе га го ка ке ки ко ла ле ли ло ма ме ми мо на не ра ри са со та то".split(),
    "greek": "βα βε βι βο δα δε δι δο φα φε γα γο κα κε κι κο λα λε λι λο μα με μι μο να νε ρα ρι σα σο τα το".split(),
}
#: Letters that stand in for those of a script; ranges of code points where the script has no case.
LETTERS = {
    "Latin": "abcdefghijklmnopqrstuvwxyz",
    "Cyrillic": "абвгдежзиклмнопрстуфхцшэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Armenian": "".join(map(chr, range(0x561, 0x587))),
    "Hebrew": "".join(map(chr, range(0x5D0, 0x5EB))),
    "Arabic": "".join(map(chr, range(0x628, 0x63B))),
    "Devanagari": "".join(map(chr, range(0x915, 0x93A))),
    "Thai": "".join(map(chr, range(0xE01, 0xE2F))),
    "Hangul": "".join(map(chr, range(0xAC00, 0xAC00 + 28 * 100, 28))),
    "Hiragana": "".join(map(chr, range(0x304B, 0x3094))),
    "Katakana": "".join(map(chr, range(0x30AB, 0x30F4))),
    "Han": "".join(map(chr, range(0x4E00, 0x4E00 + 500))),
}

_ALL_TITLES = "|".join(sorted((t for g in TITLES.values() for t in g), key=len, reverse=True))
#: Titles as listed, with or without a period; in any case with one.
_TITLE = rf"(?:(?:{_ALL_TITLES})\.?|(?iu:{_ALL_TITLES})\.) "
#: Where a title may begin: at a word of titles' first letters and length that a capital or another short word follows.
_BEGIN = rf"(?<![\p{{L}}\p{{N}}-])(?=[{''.join(sorted({f(t[0]) for g in TITLES.values() for t in g for f in (str.lower, str.upper)}))}])(?=[\p{{L}}-]{{1,9}}\.? (?:\p{{Lu}}|[\p{{L}}-]{{1,9}}\. ))"
_WORD = r"(?:\p{Lu}\.|\p{Lu}\p{L}*(?:-\p{Lu}\p{L}*|['’]\p{Lu}\p{L}+)*)"
_HEX = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,64}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\p{L}\p{N}])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}}))(?![\p{{L}}\p{{N}}:])",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{N}]|\.[0-9])",
    "ssn": r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![\p{N}])|(?<![\p{L}\p{N}])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\p{N}])",
    "name": rf"{_BEGIN}(?:{_TITLE}){{1,3}}{_WORD}(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_WORD})?",
}
ANY = "|".join(PATTERNS.values())
#: What a text must hold to be worth a search for all patterns: each of them has one of these in every match.
HINT = rf"[0-9@]|[A-Fa-f]{{32}}|{_BEGIN}(?iu:{_ALL_TITLES})\.? "


def _mod97(number: Column) -> Column:
    """The remainder by 97 of an IBAN's digits, letters being 10 to 35, the first four characters last."""
    plain = F.replace(number, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")
    return F.aggregate(turned, F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def kind_of(entity: Column) -> Column:
    """The type of a match of ANY, in the order in which the patterns are tried; `literal` for an IBAN that is none."""
    kind = F.when(entity.contains("@"), "email").when(entity.rlike(r"\A[0-9A-Fa-f]{32,64}\z"), "secret")
    kind = kind.when(entity.rlike(r"\A[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), F.when(_mod97(entity) == 1, "iban").otherwise("literal"))
    kind = kind.when(entity.rlike(r"\A[0-9A-Fa-f:]+\z") & entity.contains(":"), "ipv6").when(entity.rlike(r"\p{L}"), "name")
    kind = kind.when(entity.rlike(r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z"), "ip").when(entity.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), "ssn")
    return kind.when(~entity.startswith("+") & (F.length(F.regexp_replace(entity, "[^0-9]", "")) >= 13), "card").otherwise("phone")


def entities(text: Column) -> Column:
    """All entities of a text, in order; none for null."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def _form(kind: Column, gender: Column, entity: Column) -> Column:
    """What tells entities apart: letters in lower case, numbers without separators. Null for what stays or isn't told."""
    told = F.lower(entity)
    plain = F.when(kind == "given", F.concat(gender, F.lit(":"), told)).when(kind.isin("email", "surname", "ip", "ipv6"), told)
    form = F.concat(kind, F.lit(":"), plain.otherwise(F.regexp_replace(told, r"[^0-9a-z+]", "")))
    return F.when(~kind.isin("literal", "initial"), form)


def _title(name: Column) -> Column:
    return F.regexp_extract(name, rf"\A(?:{_TITLE})+", 0)


def _told(title: Column) -> Column:
    """The gender that titles tell: m, f or x."""
    genders = {g: rf"(?iu)(?:\A| )(?:{'|'.join(TITLES[g])})\.? " for g in "fm"}
    return F.when(title.rlike(genders["f"]), "f").when(title.rlike(genders["m"]), "m").otherwise("x")


def full_names(found: Column) -> Column:
    """Names of more than one word among a text's entities -> array of structs: name (without its titles), gender."""
    names = F.transform(F.filter(found, lambda e: kind_of(e) == "name"), lambda e: F.struct(F.substring(e, F.length(_title(e)) + 1, F.length(e)).alias("name"), _told(_title(e)).alias("gender")))
    return F.filter(names, lambda x: x["name"].contains(" "))


def with_names(names: Column) -> Column:
    """The pattern of all entities and of these names as they stand, whole words only."""
    bare = F.array_join(F.array_distinct(F.transform(names, lambda x: F.replace(x["name"], F.lit("."), F.lit(r"\.")))), "|")
    return F.concat(F.lit(rf"{ANY}|(?<![\p{{L}}\p{{N}}-])(?:"), bare, F.lit(r")(?![\p{L}\p{N}]|-\p{L})"))


def atoms(found: Column, pieces: Column, names: Column) -> Column:
    """Entities of a text, the text's pieces between them and its full names -> array of structs: pre (the text before it),
    entity, kind, gender, form. A name is one struct a word."""

    # step by step, so that the plan holds each of them once
    kept = lambda x: (x["before"], x["entity"], x["kind"], x["title"])
    found = F.transform(found, lambda e, i: F.struct(F.element_at(pieces, i + 1).alias("before"), e.alias("entity"), kind_of(e).alias("kind")))
    found = F.transform(found, lambda x: F.struct(x["before"], x["entity"], x["kind"], F.when(x["kind"] == "name", _title(x["entity"])).alias("title")))
    found = F.transform(found, lambda x: F.struct(*kept(x), F.substring(x["entity"], F.length(x["title"]) + 1, F.length(x["entity"])).alias("bare"), _told(x["title"]).alias("told")))

    def others(bare: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(names, lambda n: (n["gender"] != "x") & (F.lower(n["name"]) == F.lower(bare))), lambda n: n["gender"]))

    found = F.transform(found, lambda x: F.struct(*kept(x), F.split(x["bare"], " ").alias("words"), x["told"], F.when(x["told"] == "x", others(x["bare"])).alias("others")))
    found = F.transform(found, lambda x: F.struct(*kept(x), x["words"], F.when(x["told"] != "x", x["told"]).when(F.size(x["others"]) == 1, F.get(x["others"], F.lit(0))).otherwise("x").alias("gender")))

    def of(x: Column) -> Column:
        def word(w: Column, j: Column) -> Column:
            part = F.when(w.isin(PARTICLES), "literal").when(w.rlike(r"\A\p{Lu}\.\z"), "initial").when(j == F.size(x["words"]) - 1, "surname").otherwise("given")
            return F.struct(F.when(j == 0, F.concat(x["before"], x["title"])).otherwise(" ").alias("pre"), w.alias("entity"), part.alias("kind"), x["gender"])

        other = F.array(F.struct(x["before"].alias("pre"), x["entity"], x["kind"], F.lit("x").alias("gender")))
        return F.when(x["kind"] == "name", F.transform(x["words"], word)).otherwise(other)

    split = F.flatten(F.transform(found, of))
    return F.transform(split, lambda x: F.struct(x["pre"], x["entity"], x["kind"], x["gender"], _form(x["kind"], x["gender"], x["entity"]).alias("form")))


def _draw(bits: Column, i: Column) -> Column:
    """The i-th draw of an entity, 0 to 65535."""
    return F.conv(F.substring(F.md5(F.concat(bits, i.cast("string")).cast("binary")), 1, 4), 16, 10).cast("int")


def _pick(choices: Column, n: Column) -> Column:
    return F.element_at(choices, (n % F.size(choices)).cast("int") + 1)


def _letter(letters: str | Column, n: Column) -> Column:
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.substring(letters, n % F.length(letters) + 1, F.lit(1))


def _swap(x: Column, c: Column, n: Column) -> Column:
    """A character like c, by draw n: hexadecimal digits in secrets; digits, and letters of a script and case, elsewhere."""
    # one draw from the letters of c's script, rather than one draw for each script: the plan stays small
    letters = F.when(F.lit(False), "")
    for script, of in LETTERS.items():
        letters = letters if script == "Latin" else letters.when(c.rlike(rf"\p{{Is{script}}}"), of)
    letter = _letter(letters.otherwise(LETTERS["Latin"]), n)
    letter = F.when(c.rlike(r"\p{Lu}"), F.upper(letter)).otherwise(letter)
    digit = _letter("0123456789abcdef", n)
    digit = F.when(F.lower(x["entity"]) != x["entity"], F.upper(digit)).otherwise(digit)
    swapped = F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike(r"\p{L}"), letter).otherwise(c)
    return F.when(x["kind"].isin("secret", "ipv6") & c.rlike("[0-9A-Fa-f]"), digit).otherwise(swapped)


def _changed(x: Column) -> Column:
    """Letters and digits swapped, except a phone's or an IBAN's country code and a card's first digit. The draws' numbers
    count letters and digits only, so that an entity written with other separators gets the same ones."""
    entity = x["entity"]
    fixed = F.when((x["kind"] == "phone") & entity.startswith("+"), F.length(F.regexp_extract(entity, r"\A\+[0-9]{1,3}(?=[^0-9])|\A\+[0-9]", 0))).when(x["kind"] == "card", 1).when(x["kind"] == "iban", 2).otherwise(0)

    def swap(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        return F.when(i < fixed, c).otherwise(_swap(x, c, _draw(x["bits"], at)))

    return F.array_join(F.transform(F.split(entity, ""), swap), "")


def _check(number: Column) -> Column:
    """The Luhn sum, modulo 10, of a number's digits."""
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))

    def value(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))).otherwise(d.cast("int"))

    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, b: a + b) % 10


def _finished(x: Column) -> Column:
    entity, bits, changed, attempt = x["entity"], x["bits"], x["changed"], x["attempt"]
    # the last label of an e-mail's domain stays; from the third attempt on the address grows
    kept = F.length(entity) - F.length(F.substring_index(entity, ".", -1))
    further = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt - 1, F.lit(1))), lambda i: _letter(LETTERS["Latin"], _draw(bits, i + 1000))), "")
    email = F.concat(F.when(attempt > 1, further).otherwise(""), F.substring(changed, F.lit(1), kept), F.substring(entity, kept + 1, F.length(entity)))
    ip = F.array_join(F.transform(F.split(entity, r"\."), lambda o, i: (1 + _draw(bits, i) % 254).cast("string")), ".")
    # a card's last digit is chosen so that the check sum comes out as before, an IBAN's check digits so that it is valid
    last = F.pmod(F.substring(changed, F.length(changed), F.lit(1)).cast("int") - _check(changed) + _check(entity), F.lit(10))
    card = F.concat(F.substring(changed, F.lit(1), F.length(changed) - 1), last.cast("string"))
    bare = F.concat(F.substring(changed, 1, 2), F.lit("00"), F.substring(changed, F.lit(5), F.length(changed)))
    iban = F.concat(F.substring(changed, 1, 2), F.lpad((98 - _mod97(bare)).cast("string"), 2, "0"), F.substring(changed, F.lit(5), F.length(changed)))
    script = F.when(entity.rlike(r"\A\p{IsLatin}"), "latin").when(entity.rlike(r"\A\p{IsCyrillic}"), "cyrillic").when(entity.rlike(r"\A\p{IsGreek}"), "greek").otherwise("other")

    # words between hyphens and apostrophes are replaced one by one; the last has the room of further attempts
    parts = F.split(entity, "(?<=[-'’])|(?=[-'’])")

    def by_parts(of, one: bool) -> Column:
        def part(w: Column, made: Column) -> Column:
            made = F.when(F.length(w) == 1, F.substring(made, 1, 1)).otherwise(made) if one else made
            return F.when(w.rlike("[-'’]"), w).when(F.substring(w, 1, 1) == F.lower(F.substring(w, 1, 1)), F.lower(made)).otherwise(made)

        return F.array_join(F.zip_with(parts, F.transform(parts, lambda w, i: of(i, i == F.size(parts) - 1)), part), "")

    # the script and the gender choose the list, so that the plan holds each step once
    listed = lambda of: F.when(script == "latin", F.array(*map(F.lit, of("latin")))).when(script == "cyrillic", F.array(*map(F.lit, of("cyrillic")))).otherwise(F.array(*map(F.lit, of("greek"))))

    def syllables(i: Column, last: Column) -> Column:
        n = F.when(F.size(parts) == 1, attempt + 4).when(last, attempt + 3).otherwise(2)
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda j: _pick(listed(lambda name: SYLLABLES[name]), _draw(bits, j + 100 * i))), ""))

    def names(i: Column, last: Column) -> Column:
        female = (x["gender"] == "f") | ((x["gender"] == "x") & (_draw(bits, F.lit(900)) % 2 == 0))
        pool = F.when(female, listed(lambda name: GIVEN[name, "f"])).otherwise(listed(lambda name: GIVEN[name, "m"]))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.when(last, attempt).otherwise(0)), lambda j: _pick(pool, _draw(bits, j + 100 * i))), "-")

    def by_script(made: Column) -> Column:
        cased = F.transform(F.array(made), lambda m: F.when((F.length(entity) > 1) & (F.upper(entity) == entity), F.upper(m)).otherwise(m))
        return F.when(script == "other", F.when((F.length(entity) > 1) & (F.upper(entity) == entity), F.upper(changed)).otherwise(changed)).otherwise(F.get(cased, F.lit(0)))

    kind = x["kind"]
    made = F.when(kind == "literal", entity).when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban)
    return made.when(kind == "surname", by_script(by_parts(syllables, True))).when(kind == "given", by_script(by_parts(names, False))).otherwise(changed)


def with_surrogates(df: DataFrame, of: str, into: str, secret: str, tries) -> DataFrame:
    """Adds the array `into` of surrogates for an array made by `atoms`; tries(i, x): for its i-th entity x, a struct of the
    attempt and of the gender found out elsewhere, or null.

    Each step is a column of its own, so that what several expressions use is worked out once."""
    kept = lambda x: (x["entity"], x["kind"], x["gender"])
    df = df.withColumn(into, F.transform(of, lambda x, i: F.struct(x["entity"], x["kind"], x["gender"].alias("own"), x["form"], tries(i, x).alias("tries"))))
    df = df.withColumn(into, F.transform(into, lambda x: F.struct(x["entity"], x["kind"], F.coalesce(x["tries"]["gender"], x["own"]).alias("gender"), x["form"], F.coalesce(x["tries"]["attempt"], F.lit(0)).alias("attempt"))))
    form = lambda x: F.coalesce(F.when(x["form"].isNotNull(), _form(x["kind"], x["gender"], x["entity"])), x["entity"])
    df = df.withColumn(into, F.transform(into, lambda x: F.struct(*kept(x), x["attempt"], F.sha2(F.concat_ws("|", F.lit(secret), form(x), x["attempt"].cast("string")), 256).alias("bits"))))
    df = df.withColumn(into, F.transform(into, lambda x: F.struct(*kept(x), x["attempt"], x["bits"], _changed(x).alias("changed"))))
    return df.withColumn(into, F.transform(into, _finished))


def attempts(distinct: DataFrame, secret: str, rounds: int = 64) -> DataFrame:
    """distinct (form, entity, kind, gender) -> form, attempt, for those whose attempt isn't 0.

    Names and e-mail addresses find room in a few rounds, since attempts grow. Numbers have as many surrogates as their
    form allows; should most of these be taken, those still clashing after all rounds keep their last attempt, and a warning
    tells their number."""
    now = durable(distinct.withColumn("attempt", F.lit(0)))
    # a given name's surrogate is compared whatever its gender
    real = distinct.select(_form(F.col("kind"), F.lit("any"), F.col("entity")).alias("_made"), F.lit(True).alias("_real")).distinct()
    for _ in range(rounds):
        whole = now.withColumn("_e", F.array(F.struct("entity", "kind", "gender", "form")))
        made = durable(with_surrogates(whole, "_e", "_m", secret, lambda i, x: F.struct(F.col("attempt"), F.lit(None).cast("string").alias("gender"))).select("form", "attempt", _form(F.col("kind"), F.lit("any"), F.element_at("_m", 1)).alias("_made")))  # else joins repeat the surrogates in filters for nulls
        shared = made.groupBy("_made").agg(F.count("*").alias("_n"), F.min(F.struct("attempt", "form")).alias("_first")).where("_n > 1").select("_made", "_first")
        clash = made.join(shared, "_made", "left").join(real, "_made", "left")
        bad = durable(clash.where(F.col("_real") | (F.col("_first")["form"] != F.col("form"))).select(F.col("form").alias("_bad")))
        if bad.isEmpty():
            break
        now = durable(now.join(bad, F.col("form") == F.col("_bad"), "left").withColumn("attempt", F.col("attempt") + F.col("_bad").isNotNull().cast("int")).drop("_bad"))
    else:
        warnings.warn(f"after {rounds} attempts {bad.count()} entities share a surrogate or meet another entity", stacklevel=2)
    return now.where("attempt > 0").select("form", "attempt")


def known(told: DataFrame, secret: str) -> DataFrame:
    """told (form, entity, kind, gender): a row for each mention -> form, attempt, gender for entities of which something was
    found out: an attempt other than 0, or the gender of a given name that only titles of one gender go with elsewhere."""
    listed = durable(told.groupBy("form").agg(F.min(F.struct("entity", "kind", "gender")).alias("x")).select("form", "x.*"))
    given = listed.where("kind = 'given'").groupBy(F.lower("entity").alias("_name")).agg(F.collect_set("gender").alias("_genders"))
    carried = given.where(F.array_contains("_genders", "x") & (F.size("_genders") == 2)).select(F.concat(F.lit("given:x:"), "_name").alias("form"), F.array_min("_genders").alias("gender"))
    carried = durable(carried)  # x is the greatest of the three
    tried = attempts(listed.join(carried.select("form"), "form", "left_anti"), secret)
    alike = carried.withColumn("_as", F.concat(F.lit("given:"), "gender", F.substring("form", 8, 1 << 30)))
    alike = alike.join(tried.withColumnRenamed("form", "_as"), "_as", "left").select("form", F.coalesce("attempt", F.lit(0)).alias("attempt"), "gender")
    return tried.select("form", "attempt", F.lit(None).cast("string").alias("gender")).unionByName(alike)


def lookup(entries: list, form: Column) -> Column:
    """For a form, struct(attempt, gender) of entries (form, attempt, gender), or null: a hash table within the plan.

    A slot is a line of `form attempt gender` between tabs; forms hold no blanks."""
    slots = max(1, len(entries))
    lines = [""] * slots
    for e in entries:
        at = int.from_bytes(hashlib.md5(e["form"].encode()).digest()[:4], "big") % slots
        lines[at] += f"\t{e['form']} {e['attempt']} {e['gender'] or ''}\t"
    slot = F.conv(F.substring(F.md5(form.cast("binary")), 1, 8), 16, 10).cast("long") % slots
    line = F.element_at(F.split(F.lit("\n".join(lines)), "\n"), (slot + 1).cast("int"))
    mark = F.concat(F.lit("\t"), form, F.lit(" "))
    rest = F.split(F.substring_index(F.call_function("substring_index", line, mark, F.lit(-1)), "\t", 1), " ")
    gender = F.get(rest, F.lit(1))
    return F.when(line.contains(mark), F.struct(F.get(rest, F.lit(0)).cast("int").alias("attempt"), F.when(gender != "", gender).alias("gender")))


def pseudonymize(docs: DataFrame, secret: str, text: str = "text", into: str = "n_entities", listed: int = 20_000) -> DataFrame:
    """docs with `text` replaced and a count `into` of entities added (a column of that name is replaced).

    Null stays null; texts without entities stay as they are; repeated rows are each treated. With the same secret an
    entity of which nothing else was found out has the same surrogate in every run and table."""
    # the row travels as one struct, so that no column of docs meets one of this function's
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != into]).alias("_row"), F.col(text).alias("_text"))
    found = base.withColumn("_first", entities(F.col("_text"))).withColumn("_names", full_names(F.col("_first")))
    some = F.size("_names") > 0
    found = found.withColumn("_found", F.when(some, F.regexp_extract_all("_text", F.concat(F.lit("("), with_names(F.col("_names")), F.lit(")")), F.lit(1))).otherwise(F.col("_first")))
    found = found.withColumn("_pieces", F.when(F.size("_found") > 0, F.when(some, F.split("_text", with_names(F.col("_names")))).otherwise(F.split("_text", ANY))))
    found = found.withColumn("_atoms", atoms(F.col("_found"), F.col("_pieces"), F.col("_names")))
    # a text's atoms and the rest behind them hold all of it
    held = F.when(F.size("_found") > 0, F.lit(None)).otherwise(F.col("_text"))
    n = F.size(F.filter("_found", lambda e: kind_of(e) != "literal")).cast("long")
    found = found.select(F.col("_row").withField(f"`{text}`", held).alias("_row"), n.alias("_count"), "_atoms", F.element_at("_pieces", -1).alias("_rest"))
    # an inner explode would infer a filter of texts with atoms and push it down to the texts, with all that atoms are made of
    told = found.select(F.explode_outer("_atoms").alias("x")).where("x.form is not null").select("x.form", "x.entity", "x.kind", "x.gender")
    again = durable(known(told, secret))

    def replaced(df: DataFrame, tries) -> DataFrame:
        df = with_surrogates(df, "_atoms", "_made", secret, tries)
        woven = F.array_join(F.zip_with("_atoms", "_made", lambda x, m: F.concat(x["pre"], m)), "")
        text_ = F.when(F.size("_atoms") > 0, F.concat(woven, F.col("_rest"))).otherwise(F.col(f"_row.`{text}`"))
        return df.select(F.col("_row").withField(f"`{text}`", text_).alias("_row"), F.col("_count").alias(into)).select("_row.*", into)

    entries = again.limit(listed + 1).collect()
    if len(entries) <= listed:
        nothing = F.lit(None).cast("struct<attempt:int,gender:string>")
        return replaced(found, lambda i, x: lookup(entries, x["form"]) if entries else nothing)
    # mentions are looked up by a join; rows are told apart by a number, since keys may repeat
    numbered = durable(found.withColumn("_n", F.monotonically_increasing_id()))
    mentions = numbered.select("_n", F.posexplode("_atoms").alias("_i", "x")).select("_n", "_i", "x.form")
    tries = mentions.join(broadcast_if_small(again), "form").groupBy("_n").agg(F.map_from_entries(F.collect_list(F.struct("_i", F.struct("attempt", "gender")))).alias("_tries"))
    return replaced(numbered.join(tries, "_n", "left"), lambda i, x: F.element_at("_tries", i))
