"""Replacing personal data and secrets by keyed, type-consistent surrogates, in SQL functions only.

Found: e-mail, IPv4 and IPv6 addresses, phone, card, bank account (IBAN) and social security
numbers, access keys, secrets behind a name (password=..., "token": "...", in quotes with
blanks and of any length), and persons (a title, or a known first name, before capitalised
names or names of a script without capitals). A surrogate is derived from SHA-256 of a key, the kind and the entity's normal form,
so an entity gets the same one wherever it stands (whatever its case or separators), and
keeps its format: letters stay letters of their case and script, digits digits, hexadecimal
stays hexadecimal, cards and accounts keep their check digits valid, IPv6 addresses keep their
first group and their zeros, letters behind a backslash in a secret stay.

*Persons.* Each part of a name is an entity of its own, whatever its place, so that "Anna
Weber", "Mrs. Anna" and "WEBER" agree. Its gender and whether it is a first name are settled
over the whole corpus. Where a text names a person in full, the bare names that stand
elsewhere in it are replaced too.

*Distinctness.* Distinct entities get distinct surrogates, none of which is itself an entity
of the corpus, of whatever kind: candidates that clash are drawn anew, for all entities but
one, until none does. Later draws are longer, so that a format with few words is no limit.
"""

from __future__ import annotations

from functools import reduce
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Titles and first names by gender; enough to tell persons and their gender apart.
TITLES = {
    "m": ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "г-н", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "г-жа", "госпожа"),
    "n": ("Dr", "Prof", "Mx", "Профессор"),
}
FIRST_NAMES = {
    "m": (
        "John", "James", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Joseph", "Charles", "Christopher", "Daniel", "Matthew", "Anthony", "Mark", "Donald", "Steven", "Paul", "Andrew", "Joshua", "Kenneth", "Kevin", "Brian", "George", "Edward", "Ronald",
        "Timothy", "Jason", "Jeffrey", "Ryan", "Jacob", "Gary", "Nicholas", "Eric", "Jonathan", "Stephen", "Larry", "Justin", "Scott", "Benjamin", "Samuel", "Henry", "Bob",
        "Hans", "Peter", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Pierre", "Jean", "Michel", "Philippe", "Luis", "Carlos", "José", "Juan", "Miguel", "Javier", "Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Александр", "Андрей", "Γιώργος", "Δημήτρης", "Νίκος",
    ),
    "f": (
        "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Alice", "Barbara", "Jessica", "Lisa", "Nancy", "Betty", "Sandra", "Margaret", "Ashley", "Kimberly", "Emily", "Donna", "Michelle", "Carol", "Amanda", "Melissa", "Deborah",
        "Stephanie", "Rebecca", "Laura", "Helen", "Cynthia", "Amy", "Angela", "Anna", "Emma", "Nicole", "Samantha", "Katherine", "Christine", "Rachel", "Carolyn", "Janet", "Catherine", "Heather", "Diane", "Julie", "Olivia",
        "Sabine", "Ursula", "Monika", "Petra", "Claudia", "Marie", "Nathalie", "Isabelle", "Sylvie", "Sophie", "María", "Carmen", "Lucía", "Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Μαρία", "Ελένη", "Κατερίνα",
    ),
}
SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?"
#: In quotes up to the same quote, with blanks and escapes; else six signs or more.
SECRET_VALUE = r"(?:(?<=\")[^\"\\\n]++(?:\\[^\n][^\"\\\n]*+){0,64}+(?=\")|(?<=')[^'\\\n]++(?:\\[^\n][^'\\\n]*+){0,64}+(?=')|[^\s\"']{6,}+)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.(?=[\p{L}\p{N}]))++\p{L}{2,}"
ACCESS_KEY = r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
#: Eight groups, or fewer around `::` behind a first group of four digits of which one is decimal.
IPV6 = r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f]{0,3}\d)[0-9A-Fa-f]{4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\p{L}\p{N}:])"
#: Country, check digits, perhaps a bank's letters, eight digits or more; groups behind them hold a digit each.
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}[ ]?(?:[A-Z]{4}[ ]?)?\d{4}[ ]?\d{4}(?:[ ]?(?=[A-Z]{0,3}\d)[A-Z0-9]{4}){0,5}(?:[ ]?(?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
CARD = r"(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d)"
PHONE = r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
_CASED = r"\p{Lu}(?:\p{L}++|(?=['’]\p{Lu}))(?:[-'’]\p{Lu}\p{L}++)*+"
_CASELESS = r"\p{IsHan}{1,4}|[\p{IsKatakana}ー]{2,}+|\p{IsHangul}{2,4}|[\p{L}\p{M}&&[\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}\p{IsThai}\p{IsGeorgian}]]{2,}+"
_NAME = rf"(?:{_CASED}|{_CASELESS})"
_INITIALS = r"(?:[ ]\p{Lu}\.)*+"
_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?(?=[ ])"
_FIRST = "(?:" + "|".join(n for ns in FIRST_NAMES.values() for n in ns) + r")(?![\p{L}'’-])"
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?=[\p{{Lu}}г])(?:{_TITLE}|{_FIRST})(?:{_INITIALS}[ ]{_NAME})++"
#: A capitalised word, which may be a name that the text has elsewhere.
BARE = rf"(?<![\p{{L}}\p{{N}}]){_NAME}"
#: Looked at first, as few places pass: a word or a run of digits begins. Only patterns that ask this themselves stand behind it.
START = r"(?:(?<![\p{L}\p{N}])(?=[\p{L}+(_%.-])|(?<!\d)(?=\d))"
#: Secrets, access keys and phones may stand right behind a letter (clientSecret=..., Tel(555) ...).
ANY = "(?:" + "|".join([rf"(?=[PpSsTtAa]){SECRET}{SECRET_VALUE}", rf"(?=[0-9A-Fa-f]{{1,4}}:){IPV6}", START + EMAIL, rf"(?=A){ACCESS_KEY}", rf"(?=[A-Z]{{2}}\d){IBAN}", rf"(?=\d)(?:{IP}|{SSN}|{CARD})", rf"(?=[+(\d])(?:{PHONE})", START + PERSON]) + ")"
#: Draws of an entity's own length before they get longer.
OWN_LENGTH = 8

LOWER, UPPER, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "123456789abcdef"


class Script(NamedTuple):
    """Letters of a script: those that stand for any letter, what begins and goes on in a syllable of a name, and ends by gender and of surnames."""

    letters: str
    first: str
    then: str
    ends: dict[str, tuple[str, ...]]
    syllables: int = 2


#: Scripts with names of their own; Latin is what none of them is.
LATIN = Script(LOWER, "bdfgklmnprstv", "aeiou", {"m": ("n", "r", "s", "k", "l"), "f": ("na", "la", "ra", "sia"), "n": ("m", "lin", "ni"), "surname": ("son", "mann", "berg", "ley", "ton", "ker")})
SCRIPTS = {
    "Cyrillic": Script("абвгдежзиклмнопрстуфхцчшщэюя", "бвгдзклмнпрст", "аеиоу", {"m": ("н", "р", "слав", "й"), "f": ("на", "ра", "ина"), "n": ("н", "ни"), "surname": ("ко", "юк", "ян", "ых")}),
    "Greek": Script("αβγδεζηθικλμνξοπρστυφχψω", "βγδκλμνπρστφ", "αειου", {"m": ("ς", "νος", "ρης"), "f": ("να", "ρα", "λη"), "n": ("ν", "νι"), "surname": ("δης", "κος", "τος")}),
    "Han": Script("安白方高何江金李林山石田王文武新信雪玉中", "林江方白高何石金田王", "文安信山雪玉武新中明", {}, 1),
    "Katakana": Script("アイウエオカキクケコサシスセソタチツテトナニノマミムラリル", "カサタナマラハ", "イウリンルノト", {}),
    "Hangul": Script("가나다라마바사아자차카타하고노도로모보소오조초호", "김이박최정강조윤장임", "민서준지현수영진우연", {}, 1),
    "Arabic": Script("ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "بتجدرسفكلمن", "اوي", {}),
    "Hebrew": Script("אבגדהוזחטיכלמנסעפצקרשת", "בגדלמנרשת", "איו", {}),
    "Devanagari": Script("कखगघचजटडतदनपबमयरलवसह", "कगजतदनपबमरलस", "ािीुो", {}),
    "Thai": Script("กขคงจชซดตทนบปพมยรลวสหอ", "กขคดตทนบปพมรลส", "าิีุู", {}),
    "Georgian": Script("აბგდევზთიკლმნოპრსტუფქღშჩცძწჭხჯჰ", "ბგდკლმნრსტ", "აეიოუ", {}),
}


def _gender(found: Column) -> Column:
    out = F.lit("n")
    for g, names in FIRST_NAMES.items():
        out = F.when(found.rlike(rf"(?:^|[ ])(?:{'|'.join(names)})(?:[ ]|$)"), g).otherwise(out)
    for g in ("m", "f"):
        out = F.when(found.rlike(rf"^(?:{'|'.join(TITLES[g])})\.?[ ]"), g).otherwise(out)
    return out


def kind_of(found: Column) -> Column:
    """The kind of a match of ANY."""
    return (
        F.when(found.rlike(f"^{SECRET}"), "secret")
        .when(found.contains("@"), "email")
        .when(found.rlike(f"^{ACCESS_KEY}$"), "access_key")
        .when(found.rlike(f"^(?:{OCTET}\\.){{3}}{OCTET}$"), "ip")
        .when(found.rlike(r"^[0-9A-Fa-f]{1,4}:"), "ipv6")
        .when(found.rlike(r"^[A-Z]{2}\d"), "iban")
        .when(found.rlike(r"^\p{L}"), "person")
        .when(found.rlike(f"^{SSN}$"), "ssn")
        .when(found.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card")
        .otherwise("phone")
    )


def _groups(found: Column) -> Column:
    """The eight groups of an IPv6 address, without zeros in front."""
    halves = F.transform(F.split(F.lower(found), "::", 2), lambda h: F.filter(F.split(h, ":"), lambda g: g != ""))
    left, right = F.get(halves, F.lit(0)), F.coalesce(F.get(halves, F.lit(1)), F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    return F.transform(F.concat(left, zeros, right), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def mentions(found: Column) -> Column:
    """The entities that a match names: array of (kind, norm, token, first, gender); a person's names are entities each, initials are none."""
    kind = kind_of(found)
    none = F.lit(None).cast("string")
    one = lambda k, norm, token, first, gender: F.struct(k.alias("kind"), norm.alias("norm"), token.alias("token"), first.alias("first"), gender.alias("gender"))
    value = F.regexp_replace(found, f"^{SECRET}", "")
    norm = F.when(kind == "secret", value).when(kind == "email", F.lower(found)).when(kind.isin("card", "phone", "ssn"), _digits(found)).when(kind == "iban", F.replace(found, F.lit(" "), F.lit(""))).when(kind == "ipv6", F.array_join(_groups(found), ":")).otherwise(found)
    names = F.filter(F.split(F.regexp_replace(found, f"^{_TITLE}[ ]", ""), " "), lambda n: ~n.endswith("."))
    script = lambda n: F.coalesce(*[F.when(n.rlike(rf"\p{{Is{x}}}"), f"name:{x.lower()}") for x in SCRIPTS], F.lit("name:latin"))
    known = lambda n: n.rlike(f"^{_FIRST}$")
    persons = F.transform(names, lambda n, i: one(script(n), F.lower(n), n, (i + 1 < F.size(names)) | known(n), F.when(i == 0, _gender(found)).otherwise(_gender(n))))
    return F.when(kind == "person", persons).otherwise(F.array(one(kind, norm, F.when(kind == "secret", value).otherwise(found), F.lit(None).cast("boolean"), none)))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    each = F.reverse(F.split(digits, ""))
    worth = F.transform(each, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10


def _remainder(account: Column) -> Column:
    """A string of digits and capitals modulo 97, each letter as a number from 10 on."""
    worth = lambda a, c: F.when(c.rlike(r"\d"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(account, ""), lambda c: c != ""), F.lit(0), lambda a, c: (worth(a, c) % 97).cast("int"))


def candidate(entities: DataFrame, attempt: int, key: str) -> DataFrame:
    """(kind, norm, surrogate) of entities (kind, norm, first, gender), longer by a letter or digit for each attempt beyond OWN_LENGTH.

    The key comes as a row of its own, so that no plan shows it. What each letter needs of the
    whole entity is a column, worked out once, and so is what later steps use more than once:
    as one expression, the plan would hold a copy of a step for each use of it.
    """
    secret = F.broadcast(entities.sparkSession.createDataFrame([(key,)], "_key string"))
    base = F.sha2(F.concat_ws("\u0001", "_key", "kind", "norm", F.lit(str(attempt))), 256)
    drawn = entities.crossJoin(secret).withColumn("base", base).select(
        "kind", "norm", "first", "gender", F.concat(*[F.sha2(F.concat("base", F.lit(str(k))), 256) for k in range(4)]).alias("stream"),
        F.col("norm").rlike("^[0-9a-f]+$").alias("hexadecimal"), (F.length("norm") - F.length(F.regexp_extract("norm", r"\.(\p{L}+)$", 1))).alias("tld"),
        ((F.col("kind") == "secret") & F.col("norm").contains("\\")).alias("escaped"),
    )
    kind, norm, first, gender, stream, hexadecimal, tld, escaped = (F.col(c) for c in drawn.columns)
    drawn = drawn.withColumn("bytes", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.conv(F.substr(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))
    byte = lambda i: F.get("bytes", i % 128)
    pick = lambda letters, i: F.substr(F.lit(letters), byte(i) % len(letters) + 1, F.lit(1))
    stays = {k: kind == k for k in ("access_key", "email", "card", "phone", "ssn", "iban")}

    def char(c: Column, i: Column) -> Column:
        keep = (stays["access_key"] & (i < 4)) | (stays["email"] & (i >= tld)) | ((stays["card"] | stays["phone"] | stays["ssn"]) & (i < 1)) | (stays["iban"] & (i < 4)) | (escaped & (F.substr(norm, i, F.lit(1)) == "\\"))
        scripts = [F.when(c.rlike(rf"\p{{Is{x}}}"), F.when(c.rlike(r"\p{Lu}"), F.upper(pick(v.letters, i))).otherwise(pick(v.letters, i))) for x, v in SCRIPTS.items()]
        return (
            F.when(keep, c)
            .when(c.rlike(r"\d"), F.when(stays["ssn"], F.when(i == 1, byte(i) % 5 + 1).otherwise(byte(i) % 9 + 1)).otherwise(byte(i) % 10).cast("string"))
            .when(c.rlike(r"[^\x00-\u024F]") & c.rlike(r"\p{L}"), F.coalesce(*scripts, pick(LOWER, i)))
            .when(hexadecimal & c.rlike("[a-f]"), pick("abcdef", i))
            .when(c.rlike(r"\p{Lu}"), pick(UPPER, i))
            .when(c.rlike(r"\p{L}"), pick(LOWER, i))
            .otherwise(c)
        )

    more = range(max(0, attempt - OWN_LENGTH))
    digits = F.concat(F.lit(""), *[(byte(F.lit(100 + k)) % 10).cast("string") for k in more])
    letters = F.concat(F.lit(""), *[pick("abcdef", F.lit(100 + k)) for k in more])
    drawn = drawn.withColumn("drawn", F.concat_ws("", F.transform(F.filter(F.split(norm, ""), lambda c: c != ""), char)))
    same = F.col("drawn")
    longer = F.when(stays["email"], F.concat(letters, same)).when(stays["card"] | stays["phone"] | stays["ssn"], F.concat(same, digits)).when(stays["access_key"] | stays["iban"], F.concat(same, F.upper(letters))).otherwise(F.concat(same, letters))
    drawn, same = drawn.withColumn("same", longer), F.col("same")
    head = F.substr(same, F.lit(1), F.length(same) - 1)
    check = (10 - _luhn(F.concat(head, F.lit("0")))) % 10
    card = F.when(_luhn(norm) == 0, F.concat(head, check.cast("string"))).otherwise(same)
    octets = F.concat_ws(".", *[(byte(F.lit(i)) % (223 if i == 0 else 254) + 1).cast("string") for i in range(4)])
    octets = octets if attempt <= OWN_LENGTH else F.concat(F.lit("fd00::"), F.substr(stream, F.lit(1), F.lit(4)), F.lit(":"), F.substr(stream, F.lit(5), F.lit(4)), F.lit(":"), F.substr(stream, F.lit(9), F.lit(4)))

    body, country = F.substr(same, F.lit(5), F.length(same)), F.substr(norm, F.lit(1), F.lit(2))
    checked = F.lpad((98 - _remainder(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    sound = _remainder(F.concat(F.substr(norm, F.lit(5), F.length(norm)), F.substr(norm, F.lit(1), F.lit(4)))) == 1
    iban = F.when(sound, F.concat(country, checked, body)).otherwise(same)

    def group(g: Column, k: Column) -> Column:
        """Four digits, or as many as the group has; the first one and zeros stay, if that leaves a choice."""
        four = F.concat(*[pick(HEX, F.lit(10 + j) + 4 * k) for j in range(4)])
        return F.when((k == 0) | (g == "0"), F.when((k == 7) & (F.lit(attempt > OWN_LENGTH) | norm.rlike("^[^:]+(?::0){7}$")), four).otherwise(g)).otherwise(four if attempt > OWN_LENGTH else F.substr(four, F.lit(1), F.length(g)))

    ipv6 = F.concat_ws(":", F.transform(F.split(norm, ":"), group))

    def name(script: Script) -> Column:
        syllable = lambda i: F.concat(pick(script.first, F.lit(i)), pick(script.then, F.lit(i + 1)))
        last = F.lit("")
        for start, choices in script.ends.items():
            fits = ~first if start == "surname" else first & (gender == start)
            last = F.when(fits, F.element_at(F.array(*map(F.lit, choices)), byte(F.lit(9)) % len(choices) + 1)).otherwise(last)
        return F.initcap(F.concat(*[syllable(2 * k) for k in range(script.syllables)], *[syllable(10 + 2 * k) for k in range(1, attempt)], last))

    surrogate = F.when(kind == "card", card).when(kind == "ip", octets).when(kind == "ipv6", ipv6).when(kind == "iban", iban).when(kind == "name:latin", name(LATIN))
    for x, script in SCRIPTS.items():
        surrogate = surrogate.when(kind == f"name:{x.lower()}", name(script))
    surrogate = surrogate.otherwise(same)
    return drawn.select("kind", "norm", surrogate.alias("surrogate"))


def choose(mentioned: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) for the distinct entities of `mentioned` (kind, norm, first, gender), without clashes."""
    most = lambda g: F.count_if(F.col("gender") == g)
    gender = F.when(most("f") > most("m"), "f").when(most("m") > most("f"), "m").otherwise("n")
    entities = mentioned.groupBy("kind", "norm").agg((2 * F.count_if("first") >= F.count("*")).alias("first"), gender.alias("gender"))
    entities = cut(entities.repartition(int(mentioned.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "norm"))
    real = entities.select(F.lower("norm").alias("_norm")).distinct()
    done, todo = None, entities
    for attempt in count():
        free = candidate(todo, attempt, key).join(real, F.lower("surrogate") == F.col("_norm"), "left_anti")
        if done is not None:
            free = free.join(done.select(F.lower("surrogate").alias("_taken")), F.lower("surrogate") == F.col("_taken"), "left_anti")
        rank = F.row_number().over(Window.partitionBy(F.lower("surrogate")).orderBy("kind", "norm"))
        good = cut(free.withColumn("_rank", rank).filter("_rank = 1").drop("_rank"))
        done = good if done is None else cut(done.unionByName(good))
        todo = cut(todo.join(good.select("kind", "norm"), ["kind", "norm"], "left_anti"))
        if todo.isEmpty():
            return done


def _as_found(token: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the place: its separators and case."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    slot = lambda c: c.rlike(r"^\d$") | ((kind == "iban") & c.rlike("^[A-Z]$"))
    in_place = F.aggregate(
        F.split(token, ""),
        start,
        lambda acc, c: F.when(slot(c), F.struct(F.concat(acc["out"], F.substr(surrogate, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
        lambda acc: F.concat(acc["out"], F.substr(surrogate, acc["at"], F.length(surrogate))),
    )
    cased = F.concat_ws("", F.zip_with(F.split(surrogate, ""), F.split(token, ""), lambda c, t: F.when(t.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)))
    return F.when(kind.isin("card", "phone", "ssn", "iban"), in_place).when(kind == "email", cased).when(kind == "ipv6", _short_again(token, surrogate)).otherwise(surrogate)


def _short_again(token: Column, surrogate: Column) -> Column:
    """An IPv6 surrogate with `::` where the token has it and only zeros stand there, in the token's case."""
    groups = F.split(surrogate, ":")
    sizes = F.transform(F.split(token, "::", 2), lambda h: F.size(F.filter(F.split(h, ":"), lambda g: g != "")))
    left, right = F.get(sizes, F.lit(0)), F.coalesce(F.get(sizes, F.lit(1)), F.lit(0))
    gap = F.greatest(F.lit(0), 8 - left - right)
    zeros = token.contains("::") & F.forall(F.slice(groups, left + 1, gap), lambda g: g == "0")
    short = F.concat(F.array_join(F.slice(groups, F.lit(1), left), ":"), F.lit("::"), F.array_join(F.slice(groups, left + gap + 1, right), ":"))
    out = F.when(zeros, short).otherwise(surrogate)
    return F.when(F.upper(token) == token, F.upper(out)).otherwise(out)


def _with_surrogates(places: DataFrame, chosen: DataFrame) -> DataFrame:
    """`places` with their entity's surrogate. Entities with a thousandth of all places or more, a thousand at most, are broadcast, so that none fills a task; the others are joined by a shuffle."""
    least = max(1, places.count() // 1_000)
    hot = cut(places.groupBy("kind", "norm").count().filter(F.col("count") > least).join(chosen, ["kind", "norm"]).select(F.col("kind").alias("_kind"), F.col("norm").alias("_norm"), "surrogate"))
    rest = chosen.select(F.col("kind").alias("_kind"), F.col("norm").alias("_norm"), "surrogate")
    on = (F.col("kind") == F.col("_kind")) & (F.col("norm") == F.col("_norm"))
    common = places.join(F.broadcast(hot), on)
    return common.unionByName(places.join(F.broadcast(hot.select("_kind", "_norm")), on, "left_anti").join(rest, on))


def _renamed(word: Column, names: Column) -> Column:
    """The word's surrogate if `names` has it, in capitals if the word is; else the word."""
    new = F.element_at(names, F.lower(word))
    return F.when(new.isNull(), word).when((F.length(word) > 1) & (F.upper(word) == word), F.upper(new)).otherwise(new)


def may_hold(text: Column) -> Column:
    """False for texts that surely match nothing: without a digit, an @, a sign of assignment, an access key's head or a person."""
    signs = [text.contains(c) for c in "0123456789@=:"] + [text.contains(k) for k in ("AKIA", "ASIA")]
    return reduce(Column.__or__, signs) | text.rlike(PERSON)


def replace_personal(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text with surrogates, entities (kind, surrogate in order of the text).

    Texts without personal data, empty and null ones come back as they are, with no entities,
    and take part in no join. Rows that repeat an id are replaced each by its text, rows
    without one as any other; two equal rows become equal.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    has = F.coalesce(may_hold(F.col("_text")) & F.col("_text").rlike(ANY), F.lit(False))
    row = [F.xxhash64("_id", "_text").alias("_row"), F.xxhash64(F.lit("again"), "_text", "_id").alias("_row2")]
    # As the output of a generator the matches are found once, not again for each use.
    hits = slim.filter(has).select("_id", "_text", *row, F.explode(F.array(F.regexp_extract_all("_text", F.lit(ANY), F.lit(0)))).alias("_found"))
    hits = cut(hits)
    places = hits.select("_row", "_row2", F.posexplode("_found").alias("at", "found"))
    places = places.select("_row", "_row2", "at", F.length("found").alias("length"), F.posexplode(mentions(F.col("found"))).alias("part", "m"))
    places = cut(places.select("_row", "_row2", "at", "part", "length", "m.*").distinct())
    chosen = choose(places.select("kind", "norm", "first", "gender"), key)
    named = _with_surrogates(places, chosen)
    named = named.withColumn("new", F.when(F.col("kind").startswith("name:"), F.col("surrogate")).otherwise(_as_found(F.col("token"), F.col("kind"), F.col("surrogate"))))
    name = F.when(F.col("kind").startswith("name:"), F.struct(F.col("norm").alias("key"), F.col("surrogate").alias("value")))
    told = named.groupBy(F.col("_row").alias("_k"), F.col("_row2").alias("_k2")).agg(
        F.array_sort(F.collect_list(F.struct("at", "part", "kind", "new"))).alias("named"),
        F.array_sort(F.collect_list(F.when(F.col("part") == 0, F.struct("at", (F.col("length") - F.length("token")).alias("lead"), "kind", "new")))).alias("matches"),
        F.map_from_entries(F.collect_set(name)).alias("names"),
    )
    joined = hits.join(told, (F.col("_row") == F.col("_k")) & (F.col("_row2") == F.col("_k2")))

    def renewed(found: Column, match: Column) -> Column:
        """A match with what it names replaced; a title, initials, 'password=' stay."""
        person = F.concat_ws(" ", F.transform(F.split(found, " "), lambda w: _renamed(w, F.col("names"))))
        return F.when(match["kind"].startswith("name:"), person).otherwise(F.concat(F.substr(found, F.lit(1), match["lead"]), match["new"]))

    def between(gap: Column) -> Column:
        """What stands between matches, with the text's names replaced."""
        parts = F.zip_with(F.split(gap, BARE, -1), F.regexp_extract_all(gap, F.lit(BARE), F.lit(0)), lambda g, b: F.concat(g, F.coalesce(_renamed(b, F.col("names")), F.lit(""))))
        return F.when(F.size("names") == 0, gap).otherwise(F.concat_ws("", parts))

    new = F.zip_with("_found", "matches", renewed)
    pieces = F.zip_with(F.split("_text", ANY, -1), new, lambda g, r: F.concat(between(g), F.coalesce(r, F.lit(""))))
    entities = F.transform("named", lambda m: F.struct(m["kind"].alias("kind"), m["new"].alias("surrogate")))
    none = F.array().cast("array<struct<kind:string,surrogate:string>>")
    rest = slim.filter(~has).select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), none.alias("entities"))
    return rest.unionByName(joined.select(F.col("_id").alias(id_col), F.concat_ws("", pieces).alias(text_col), entities.alias("entities")))
