"""Personal data replaced by keyed, type-consistent surrogates.

Entities are found by pattern. An entity is its type and a canonical form (an
address without case, a number without signs), so its mentions get one
surrogate wherever and however they are written. Names are found after titles;
the same people without a title (both names, or one of them) are then found in
the same text by patterns made from it. A name's parts are entities of their
own: "Frau Anna Müller", "Frau Müller" and "Anna Müller" of a text share one
family name, which is the same in all texts, and one given name, which belongs
to the family name and gender.

A surrogate follows from a secret key and the entity. Digits and letters are
permuted within their form (see ``permuted``): digits become digits, letters
letters of the same script and case, signs stay, and no two entities of a form
meet. Card numbers and IBANs keep valid check digits, addresses their
top-level domain, private networks stay private. Domains are entities too. Names are
drawn for script and gender.

Distinctness is checked over the whole corpus: where two entities get one
surrogate, or a surrogate is itself an entity found, all but one try again.
Names grow longer with each try, so they come to an end; a form of which some
entity found no free surrogate in ``ROUNDS`` tries (all its numbers may be
entities) takes the permutation as it is, which is still distinct. Only entities take
part in that, combined before they are shuffled; texts without entities aren't
moved. Only column functions are used.

Defined results
- null text stays null, a text without entities stays as it is, both with 0 entities
- overlapping patterns: the leftmost match counts, of several there the first in order of ``PATTERNS``
- a name is one or more titles and all names after them with their particles and initials; it ends before words that
  begin sentences or name days (``NO_NAME``), and as ``_cut`` says; what is no part of it stays in the text
- the last of the names is the family name, all before are given names; people without a title anywhere in their text aren't found
- a title that tells no gender gives a name that tells none
- repeated rows and null ids are rows of their own; all columns are kept, one named as the count is replaced
- texts of any length are read whole; an empty table gives an empty table
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismill.llm import spotting
from prismill.llm.store import Scratch

#: Titles that tell a gender, as fixed values.
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Señorita|Sra|Signora|Госпожа|Κυρία"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Signor|Господин|Κύριος"
#: Titles that tell none.
NEUTRAL = "Dr|Prof|Professor|Доктор|Δρ"
_GAP = r"[ \u00A0]{1,3}"
_NAME = r"\p{Lu}[\p{L}'’\-]+"
#: Fixed: small words within family names.
PARTICLES = "van|von|vom|zu|zur|der|den|de|del|della|di|da|do|dos|das|du|des|la|le|les|los|las|ter|ten|af|av|bin|ibn"
#: Fixed: words that begin a sentence or name a day or month, but no person, where they follow a name without a full stop.
NO_NAME = (
    "The This That These Those He She It We They You There Here And But Or If When While After Before Since Please Yours On In At By For From With To As Is Was Are Were Has Have Had Will Would Can May Must Not No "
    "Der Die Das Dem Den Des Ein Eine Einen Einem Einer Er Sie Es Wir Ihr Ich Am Im Um Auf Aus Bei Mit Nach Vom Von Vor Zu Zum Zur Und Oder Aber Wenn Wie Bitte Heute Gestern Morgen Hier Dort Ist War Hat Hatte Wird Kann Soll Nicht "
    "Le Les Il Elle On Nous Vous Ils Elles Un Une Et Mais Ou Si Dans Avec Pour Sur Est El Los Las Ella Ellos Una Pero Con Por Para Desde Hoy "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Lundi Mardi Mercredi Jeudi Vendredi Samedi Dimanche Lunes Martes Jueves Viernes Domingo"
)
#: One name with what stands before it: particles and initials. It is no title and none of NO_NAME.
_WORD = rf"(?:(?:{PARTICLES}){_GAP}){{0,3}}(?:\p{{Lu}}\.[ \u00A0]?){{0,4}}(?!(?:{'|'.join(NO_NAME.split())}|{FEMALE}|{MALE}|{NEUTRAL})(?![\p{{L}}'’\-])){_NAME}"
#: Entities by type, the most telling first.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9\p{L}._%+\-])[A-Za-z0-9\p{L}._%+\-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[^0-9A-Za-z+@]{0,6}\(?[0-9]{1,4}\)?[^0-9A-Za-z+@]{1,6}[0-9]{2,8}(?:[-. ][0-9]{2,4}){0,3}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\)[^0-9A-Za-z+@]{0,6}[0-9]{3}-[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}])(?:(?:{FEMALE}|{MALE}|{NEUTRAL})\.?{_GAP})+{_WORD}(?:{_GAP}{_WORD})*",
}
ANY = "|".join(PATTERNS.values())
#: What every entity but a name has, and the beginnings of titles: looked for before the patterns, which take longer.
SIGN = "[0-9@]"
TITLES = ("Mr", "Ms", "Miss", "Mme", "Madame", "Frau", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Госпожа", "Κύριος", "Κυρία", "Dr", "Prof", "Доктор", "Δρ")
TITLE = rf"^(?:(?:{FEMALE}|{MALE}|{NEUTRAL})\.?{_GAP})+"
#: Titles of a language that writes all nouns with a capital.
NOUNS = r"^(?:Herr|Frau)\b"
#: Tries to find a surrogate of an entity's form that is no entity; below 10, so that each moves a digit by another number.
ROUNDS = 4

#: Fixed: given names by gender and script.
GIVEN = {
    ("f", "latin"): "Anna Clara Elena Julia Laura Maria Nora Paula Sofia Vera".split(),
    ("m", "latin"): "Adam Bruno David Emil Felix Hugo Jonas Lukas Martin Paul".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Денис Иван Олег Павел Роман".split(),
    ("f", "greek"): "Άννα Ειρήνη Ελένη Μαρία Σοφία".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
    ("n", "latin"): "Alex Andrea Dominique Kim Noel Robin Sascha Toni".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава".split(),
    ("n", "greek"): "Άρης Φώτης Χάρης".split(),
}
SYLLABLES = {"latin": "bar cor del fan gar hol jan kel lin mar nor pel ros sol tam vin".split(), "cyrillic": "бар вол гор дан жел зим кал лин мар нов пол рад сов тар".split(), "greek": "βαρ γελ δαν ζερ καλ λιν μαρ νορ παλ ροσ".split()}
ENDINGS = {("f", "cyrillic"): "ова", ("m", "cyrillic"): "ов", ("f", "greek"): "ίδου", ("m", "greek"): "ίδης"}
#: Fixed: letters by script and case; a letter's surrogate is one of the same row.
LETTERS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "äöüéèêáíóúñçàâîôûß", "ÄÖÜÉÈÊÁÍÓÚÑÇÀÂÎÔÛ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
#: A character for each number of an address.
OCTETS = "".join(map(chr, range(0x4E00, 0x4F00)))
ROWS = ["0123456789", *LETTERS, OCTETS]


def kind(hit: Column) -> Column:
    """The type of a match; what has neither digit nor "@" is a name, with or without a title."""
    out = F.lit("card")
    for name in ("ssn", "iban", "ip"):
        out = F.when(hit.rlike(rf"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return F.when(hit.contains("@"), F.lit("email")).when(~hit.rlike("[0-9]"), F.lit("name")).when(hit.rlike(r"^[+(]"), F.lit("phone")).otherwise(out)


def canonical(kind: Column, hit: Column) -> Column:
    """One form for all ways to write an entity that is no name."""
    return F.when(kind == "email", F.lower(hit)).when(kind == "iban", F.replace(hit, F.lit(" "), F.lit(""))).when(kind == "ip", hit).otherwise(F.regexp_replace(hit, "[^0-9]", ""))


def _stream(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits that follow from the key and the parts."""
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)
    return F.sha2(F.concat(F.lit(key), inner), 512)


def _number(stream: Column, i: int = 0) -> Column:
    """A number from a stream, another for each i up to 15."""
    return F.conv(F.substr(stream, F.lit(8 * i + 1), F.lit(7)), 16, 10).cast("int")


def _row(c: Column) -> Column:
    """The row of ``ROWS`` that has a character; empty for none."""
    out = F.lit("")
    for row in ROWS:
        out = F.when(F.instr(F.lit(row), c) > 0, F.lit(row)).otherwise(out)
    return out


def _turned(c: Column, row: Column, by: Column) -> Column:
    """The character so many places on in its row."""
    at = F.position(c, row)
    return F.when(row == "", c).otherwise(F.substr(row, F.pmod(at - 1 + by, F.length(row)).cast("int") + 1, F.lit(1)))


def permuted(df: DataFrame, text: Column, key: str, tweak: Column, turn: int, to: str) -> DataFrame:
    """Add a permutation of the texts of one form that has no fixed point, another for each turn (1 to 9).

    Forward and backward, each character is moved in its row by a number that follows from
    the key and all characters done before; then the first that has a row is moved by
    ``turn``, and the two steps are undone. Each step is worked out once a row.
    """
    names = [c for c in df.columns if c != to]
    step = lambda d, c: spotting.once(d, *names, F.col("tweak_"), c.alias("text_"))
    chars = lambda t: F.transform(F.split(t, ""), lambda c: F.struct(c.alias("c"), _row(c).alias("row")))
    shift = lambda before, k: _number(_stream(key, F.col("tweak_"), F.lit(k), before))
    t = F.col("text_")

    def on(t: Column, k: str) -> Column:
        return F.aggregate(chars(t), F.lit(""), lambda done, x: F.concat(done, _turned(x["c"], x["row"], shift(done, k))))

    def back(t: Column, k: str) -> Column:
        return F.array_join(F.transform(chars(t), lambda x, i: _turned(x["c"], x["row"], -shift(F.substr(t, F.lit(1), i), k))), "")

    d = spotting.once(df, *names, tweak.alias("tweak_"), text.alias("text_"))
    d = step(d, F.reverse(on(t, "a")))
    d = step(d, F.reverse(on(t, "b")))
    first = F.array_position(F.transform(F.split(t, ""), lambda c: _row(c) != ""), True).cast("int")
    d = spotting.once(d, *names, F.col("tweak_"), t, first.alias("first_"))
    first, c = F.col("first_"), F.substr(t, F.col("first_"), F.lit(1))
    moved = F.concat(F.substr(t, F.lit(1), first - 1), _turned(c, _row(c), F.lit(turn)), F.substr(t, first + 1, F.length(t)))
    d = step(d, F.reverse(F.when(first > 0, moved).otherwise(t)))
    d = step(d, F.reverse(back(t, "b")))
    d = step(d, back(t, "a"))
    return d.select(*names, F.col("text_").alias(to))


def form(text: Column) -> Column:
    """What a permutation leaves as it is: the row of each character, and signs."""
    out = text
    for i, row in enumerate(ROWS):
        out = F.translate(out, row, chr(0xE000 + i) * len(row))
    return out


def luhn(digits: Column) -> Column:
    """Sum of the Luhn check."""

    def add(acc: Column, d: Column) -> Column:
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["sum"] + F.when(acc["even"], twice).otherwise(d)).alias("sum"), (~acc["even"]).alias("even"))

    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))
    return F.aggregate(values, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("even")), add, lambda acc: acc["sum"])


def luhn_digit(body: Column) -> Column:
    """The digit that makes a number valid."""
    return F.pmod(10 - F.pmod(luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))


def iban_digits(country: Column, body: Column) -> Column:
    """The check number of an IBAN, from 2 to 98."""

    def add(acc: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 65, F.pmod(acc * 10 + n - 48, F.lit(97))).otherwise(F.pmod(acc * 100 + n - 55, F.lit(97)))

    return 98 - F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), add)


def _picked(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(w) for w in words)), F.pmod(n, F.lit(len(words))).cast("int") + 1)


def _syllables(script: str, key: str, canon: Column, n: Column) -> Column:
    one = lambda i: _picked(SYLLABLES[script], _number(_stream(key, canon, i.cast("string"))))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")


def _person(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """A family or given name for the gender and script of the entity, longer with each attempt."""
    gender, out = F.left(canon, F.lit(1)), None
    own = F.concat_ws("-", kind, canon, attempt.cast("string"))
    for script, letters in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", "")):
        for g in "fmn":
            family = F.initcap(F.concat(_syllables(script, key, own, attempt + 5), F.lit(ENDINGS.get((g, script), ""))))
            given = F.concat(_picked(GIVEN[g, script], _number(_stream(key, own))), F.when(attempt > 2, F.concat(F.lit("-"), F.initcap(_syllables(script, key, own, attempt)))).otherwise(F.lit("")))
            test = (canon.rlike(letters) if letters else F.lit(True)) & ((gender == g) if g != "n" else F.lit(True))
            name = F.when(kind == "family", family).otherwise(given)
            out = F.when(test, name) if out is None else out.when(test, name)
    return out


def _core(kind: Column, canon: Column) -> Column:
    """The part of a canonical form that is permuted."""
    kept = F.when(canon.rlike(r"^(10|127)\."), F.lit(1)).when(canon.rlike(r"^(192\.168|172\.(1[6-9]|2[0-9]|3[01]))\."), F.lit(2)).otherwise(F.lit(0))
    parts = F.filter(F.transform(F.split(canon, r"\."), lambda p, i: F.when(i >= kept, F.substr(F.lit(OCTETS), p.cast("int") + 1, F.lit(1))).otherwise(F.lit(""))), lambda p: p != "")
    domain = F.left(canon, F.length(canon) - F.length(F.substring_index(canon, ".", -1)))
    return (
        F.when(kind == "email", F.substring_index(canon, "@", 1)).when(kind == "domain", domain).when(kind == "ip", F.array_join(parts, ""))
        .when(kind == "phone", F.substr(canon, F.lit(2), F.length(canon))).when(kind == "iban", F.substr(canon, F.lit(5), F.length(canon))).when(kind == "card", F.left(canon, F.length(canon) - 1)).otherwise(canon)
    )


def surrogate(df: DataFrame, key: str, attempt: int) -> DataFrame:
    """Add to (kind, canon) the canonical form of the surrogate at an attempt; of an address only what stands before the domain."""
    kind, canon, core, new = (F.col(c) for c in ("kind", "canon", "core", "new"))
    d = spotting.once(df.select("kind", "canon"), kind, canon, F.when(kind.isin("family", "given"), F.lit("")).otherwise(_core(kind, canon)).alias("core"))
    d = permuted(d, core, key, F.concat_ws("-", kind, form(core)), attempt % 9 + 1, "new")
    octets = F.transform(F.split(new, ""), lambda c: (F.instr(F.lit(OCTETS), c) - 1).cast("string"))
    check = lambda k, c: F.when(kind == k, c)
    d = spotting.once(
        d, kind, canon, core, new, F.when(kind == "ip", octets).alias("octets"), check("card", luhn_digit(core)).alias("luhn"), check("card", luhn_digit(new)).alias("new_luhn"),
        check("iban", iban_digits(F.left(canon, F.lit(2)), core)).alias("iban"), check("iban", iban_digits(F.left(canon, F.lit(2)), new)).alias("new_iban"),
    )
    card = F.concat(new, F.pmod(F.col("new_luhn") + F.right(canon, F.lit(1)).cast("int") - F.col("luhn"), F.lit(10)).cast("string"))
    off = F.substr(canon, F.lit(3), F.lit(2)).cast("int") - F.col("iban")
    iban = F.concat(F.left(canon, F.lit(2)), F.lpad((F.pmod(F.col("new_iban") - 2 + off, F.lit(97)) + 2).cast("string"), 2, "0"), new)
    ip = F.array_join(F.concat(F.slice(F.split(canon, r"\."), F.lit(1), F.lit(4) - F.size("octets")), F.col("octets")), ".")
    plain = (
        F.when(kind == "domain", F.concat(new, F.substring_index(canon, ".", -1))).when(kind == "ip", ip)
        .when(kind == "phone", F.concat(F.left(canon, F.lit(1)), new)).when(kind == "iban", iban).when(kind == "card", card).otherwise(new)
    )
    return spotting.once(d, kind, canon, F.when(kind.isin("family", "given"), _person(key, kind, canon, F.lit(attempt))).otherwise(plain).alias("sub"))


def _whole(kind: Column, canon: Column, sub: Column) -> Column:
    """A surrogate as a canonical form, to be compared with those of entities: names with gender, given names with their family's."""
    gender, family = F.left(canon, F.lit(1)), F.regexp_extract(canon, r"\|([^|]*)$", 1)
    return F.when(kind == "family", F.concat(gender, F.lit("|"), F.lower(sub))).when(kind == "given", F.concat(gender, F.lit("|"), F.lower(sub), F.lit("|"), family)).when(kind == "email", F.concat(sub, F.lit("@"), F.substring_index(canon, "@", -1))).otherwise(sub)


def _network(kind: Column, canon: Column) -> Column:
    """The kind of network of an address, which a surrogate shares."""
    return F.when(kind == "ip", F.regexp_extract(canon, r"^(10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.", 1)).otherwise(F.lit(""))


def entities(found: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, canon, sub) for every entity of (kind, canon), no two of a kind with one surrogate."""
    kind, canon = F.col("kind"), F.col("canon")
    todo = scratch.table(found.distinct(), "entities")
    real = todo.select("kind", F.col("canon").alias("whole"))
    # A surrogate takes long for the few bytes of an entity, so entities are dealt to all tasks and not by size.
    dealt = lambda t: t.repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "canon")
    done, attempt = None, 0
    while attempt < ROUNDS or todo.where("kind IN ('family', 'given')").limit(1).count():
        some = dealt(todo if attempt < ROUNDS else todo.where("kind IN ('family', 'given')"))
        some = surrogate(some, key, attempt).withColumn("whole", _whole(kind, canon, F.col("sub")))
        some = some.where(_network(kind, canon) == _network(kind, F.col("whole")))
        first = some.groupBy("kind", "whole").agg(F.min(F.struct("canon", "sub")).alias("f")).join(real, ["kind", "whole"], "left_anti")
        if done is not None:
            first = first.join(done.select("kind", "whole"), ["kind", "whole"], "left_anti")
        won = scratch.table(first.select("kind", "f.canon", "f.sub", "whole"), "won")
        done = won if done is None else done.unionByName(won)
        todo, attempt = scratch.table(todo.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), "left"), attempt + 1
        if not todo.limit(1).count():
            return done.select("kind", "canon", "sub")
    # Forms that are too full: all their entities take the first permutation.
    shape = F.concat_ws("-", kind, form(_core(kind, canon)), F.length(canon).cast("string"))
    full = scratch.table(todo.select(shape.alias("shape")).distinct(), "full")
    rest = done.select("kind", "canon").unionByName(todo).withColumn("shape", shape).join(full, "shape", "left_semi").drop("shape")
    free = done.withColumn("shape", shape).join(full, "shape", "left_anti").select("kind", "canon", "sub")
    return scratch.table(free.unionByName(surrogate(dealt(rest), key, 0)), "surrogates")


def _written(kind: Column, hit: Column, sub: Column) -> Column:
    """A surrogate in the way the mention is written: its signs, case and title."""
    chars = F.split(sub, "")

    def put(acc: Column, c: Column) -> Column:
        takes = c.rlike("^[0-9A-Za-z]$") & ((kind == "iban") | c.rlike("^[0-9]$"))
        return F.struct(F.concat(acc["text"], F.when(takes, F.coalesce(F.get(chars, acc["at"]), F.lit(""))).otherwise(c)).alias("text"), (acc["at"] + takes.cast("int")).alias("at"))

    numbers = F.aggregate(F.split(hit, ""), F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), put, lambda acc: acc["text"])
    shout = (hit == F.upper(hit)) & (hit != F.lower(hit))
    mail = F.when(shout, F.upper(sub)).when(hit == F.lower(hit), sub).otherwise(F.concat(F.upper(F.left(sub, F.lit(1))), F.substr(sub, F.lit(2), F.lit(1000))))
    return F.when(kind == "email", mail).when(kind == "ip", sub).when(kind == "name", F.concat(F.regexp_extract(hit, TITLE, 0), sub)).otherwise(numbers)


def _bare(hit: Column) -> Column:
    """A mention without its titles, its words one space apart."""
    return F.regexp_replace(F.regexp_replace(hit, TITLE, ""), _GAP, " ")


def _family(bare: Column) -> Column:
    """The last word of a name with the particles before it."""
    return F.regexp_extract(bare, rf"(?<![\p{{L}}'’\-])(?:(?:{PARTICLES}) ){{0,3}}{_NAME}$", 0)


def _cut(hits: Column) -> Column:
    """Mentions whose last words are no names, as far as they are ones.

    After a title of a language with capital nouns any noun may follow a name. If
    one of the words, but not the last, is a family name elsewhere in the text, alone
    after a title or at the end of another mention, the name ends there.
    """
    titled = F.transform(F.array_distinct(F.filter(hits, lambda h: h.rlike(rf"^(?:{PATTERNS['name']})$"))), lambda h: F.struct(h.alias("hit"), _bare(h).alias("bare")))

    def ends(x: Column) -> Column:
        other = F.transform(F.filter(titled, lambda y: y["bare"] != x["bare"]), lambda y: _family(y["bare"]))
        words = F.split(x["bare"], " ")
        known = F.filter(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: F.array_contains(other, w))
        cut = (F.size(known) > 0) & ~F.array_contains(other, _family(x["bare"])) & x["hit"].rlike(NOUNS)
        upto = F.regexp_substr(x["hit"], F.concat(F.lit(r"^.*?(?<!\p{L})\Q"), F.get(known, F.lit(0)), F.lit(r"\E(?![\p{L}'’\-])")))
        return F.when(cut, upto)

    return F.filter(F.transform(titled, ends), lambda h: h.isNotNull())


def _people(hits: Column) -> Column:
    """The people of a text's mentions with titles: gender, given names (may be empty) and family name, as written but for spaces."""
    titled = F.filter(hits, lambda h: h.rlike(rf"^(?:{PATTERNS['name']})$"))

    def person(h: Column) -> Column:
        told = lambda titles: h.rlike(rf"^(?:(?:{NEUTRAL})\.?{_GAP})*(?:{titles})\b")
        gender = F.when(told(FEMALE), F.lit("f")).when(told(MALE), F.lit("m")).otherwise(F.lit("n"))
        bare = _bare(h)
        return F.struct(gender.alias("gender"), F.trim(F.left(bare, F.length(bare) - F.length(_family(bare)))).alias("given"), _family(bare).alias("family"))

    return F.array_distinct(F.transform(titled, person))


def _singles(p: Column) -> Column:
    """The given names of a person, together and one by one."""
    return F.filter(F.array_distinct(F.concat(F.array(p["given"]), F.split(p["given"], " "))), lambda w: F.length(w) > 2)


def _last(p: Column) -> Column:
    """The family name, with and without its particles."""
    return F.array_distinct(F.array(p["family"], F.regexp_extract(p["family"], rf"{_NAME}$", 0)))


def _named(people: Column) -> Column:
    """A pattern of these people without titles: given and family names, or one of them."""
    quoted = lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit(" "), F.lit("\\E" + _GAP + "\\Q")), F.lit("\\E"))
    both = F.flatten(F.transform(people, lambda p: F.transform(_singles(p), lambda g: F.concat(g, F.lit(" "), p["family"]))))
    single = F.flatten(F.transform(people, lambda p: F.concat(_last(p), _singles(p))))
    words = F.filter(F.array_distinct(F.concat(both, single)), lambda w: F.length(w) > 2)
    some = F.array_join(F.transform(F.array_sort(words, lambda x, y: F.length(y) - F.length(x)), quoted), "|")
    return F.when(some != "", F.concat(F.lit(r"(?<![\p{L}'’\-])(?:"), some, F.lit(r")(?![\p{L}'’\-])")))


def _parts(hits: DataFrame) -> DataFrame:
    """The entities (part, kind, canon) of mentions (n, people, i, hit, type): of a name its family and given name, of an address its two sides."""
    people, hit, who = F.col("people"), F.col("hit"), F.col("who")
    keep = [F.col(c) for c in ("n", "i", "hit", "type")]
    named = F.col("type") == "name"
    d = spotting.once(hits, *keep, people, F.when(named, F.get(_people(F.array(hit)), F.lit(0))).alias("own"), F.when(named, _bare(hit)).alias("bare"))
    bare = F.col("bare")
    # Without a title: someone with given and family name, else with this family name, else with this given name.
    both = F.filter(people, lambda p: F.exists(_singles(p), lambda g: F.concat(g, F.lit(" "), p["family"]) == bare))
    same = F.filter(people, lambda p: F.array_contains(_last(p), bare))
    given = F.filter(people, lambda p: F.array_contains(_singles(p), bare))
    d = spotting.once(d, *keep, F.coalesce("own", F.get(both, F.lit(0)), F.get(same, F.lit(0)), F.get(given, F.lit(0))).alias("who"), F.col("own").isNotNull().alias("titled"), (F.size(both) > 0).alias("two"), (F.size(same) > 0).alias("last"))
    has_family = F.col("titled") | F.col("two") | F.col("last")
    has_given = F.when(F.col("titled"), who["given"] != "").otherwise(F.col("two") | ~F.col("last"))
    # Latin family names are one for all genders; others have endings.
    gender = F.when(who["family"].rlike(r"\p{IsCyrillic}|\p{IsGreek}"), who["gender"]).otherwise(F.lit("n"))
    entity = lambda k, c: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), c.alias("canon"))
    family = entity("family", F.concat(gender, F.lit("|"), F.lower(who["family"])))
    given = entity("given", F.concat(who["gender"], F.lit("|"), F.lower(who["given"]), F.lit("|"), F.lower(who["family"])))
    names = F.filter(F.array(F.when(has_given, given), F.when(has_family, family)), lambda e: e.isNotNull())
    canon = canonical(F.col("type"), hit)
    sides = F.array(entity("email", canon), entity("domain", F.substring_index(canon, "@", -1)))
    parts = F.when(F.col("type") == "name", names).when(F.col("type") == "email", sides).otherwise(F.array(entity(F.col("type"), canon)))
    return spotting.once(d, *keep, parts.alias("parts")).select(*keep, F.posexplode("parts").alias("part", "e")).select("n", "i", "hit", "type", "part", "e.*")


def replaced(docs: DataFrame, key: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """All rows and columns, the text with surrogates for entities, and how many mentions were replaced.

    ``key`` is the secret: the same key gives the same surrogates in every run.
    """
    scratch = Scratch(docs.sparkSession, "surrogates")
    names = [c for c in docs.columns if c.lower() != count.lower()]
    may = F.col(text).rlike(SIGN)
    for title in TITLES:
        may = may | F.col(text).contains(title)
    has = F.coalesce(may & F.col(text).rlike(ANY), F.lit(False))
    clean = docs.where(~has).select(*(F.col(f"`{c}`") for c in names), F.lit(0).cast("long").alias(count))
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    rows = spotting.once(docs.where(has), row, F.col(text).alias("text"), F.regexp_extract_all(F.col(text), F.lit(PATTERNS["name"]), F.lit(0)).alias("mentions"))
    rows = spotting.once(rows, F.col("row"), F.col("text"), F.col("mentions"), _cut(F.col("mentions")).alias("cut"))
    whole = F.filter("mentions", lambda h: ~F.exists("cut", lambda c: h.startswith(c)))
    rows = spotting.once(rows, F.col("row"), F.col("text"), F.col("cut"), _people(F.concat(whole, "cut")).alias("people"))
    short = F.array_join(F.transform(F.array_distinct("cut"), lambda c: F.concat(F.lit(r"(?<![\p{L}])\Q"), c, F.lit(r"\E(?![\p{L}'’\-])|"))), "")
    any_of = F.concat(short, F.lit(ANY), F.coalesce(F.concat(F.lit("|"), _named(F.col("people"))), F.lit("")))
    rows = spotting.once(rows, F.col("row"), F.col("text"), F.col("people"), any_of.alias("pattern"))
    gaps, hits = F.split("text", F.col("pattern"), -1), F.regexp_extract_all("text", F.col("pattern"), F.lit(0))
    rows = scratch.table(rows.select("row", "people", gaps.alias("gaps"), hits.alias("hits")).withColumn("n", F.monotonically_increasing_id()), "rows")
    hits = rows.select("n", "people", F.posexplode("hits").alias("i", "hit")).withColumn("type", kind(F.col("hit")))
    hits = scratch.table(_parts(hits), "hits")
    table = entities(hits.select("kind", "canon"), key, scratch)
    new = hits.join(table, ["kind", "canon"]).groupBy("n", "i", "hit", "type").agg(F.sort_array(F.collect_list(F.struct("part", "sub"))).alias("parts"))
    subs = F.transform("parts", lambda p: p["sub"])
    sub = F.when(F.col("type") == "email", F.array_join(subs, "@")).otherwise(F.array_join(subs, " "))
    new = new.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("i", _written(F.col("type"), F.col("hit"), sub).alias("new")))).alias("subs"))
    whole = spotting.woven(F.col("gaps"), F.transform("subs", lambda s: s["new"]))
    done = rows.join(new, "n").select(*(whole.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names), F.size("subs").cast("long").alias(count))
    return clean.unionByName(done)
