"""PII surrogates: keyed replacements of the same type and form, with DataFrame functions only.

Detection is one regular expression per text; the text is cut at its entities, each entity is replaced
by an expression of its type, canonical form, key and attempt, and the pieces are joined again. No text
is shuffled. Types and what a surrogate keeps:
  email     length, script and character classes of the local part; a reserved example domain
  phone     country code, number of digits and punctuation
  number    (cards, accounts) first digit, length, grouping and whether the Luhn sum holds
  ip        dotted quad of four octets
  iban, ssn letters and digits in their places
  birth     (a date after a word for birth) the layout, a valid date
  street    (with house number) the kind of street, letter classes
  secret    hex or alphanumeric classes and length
  name      number of words, gender and script of a listed given name, letter classes of the others

Letters are replaced by letters of their script, case and, where it has them, vowels or consonants.
Draws are HMAC-SHA-256 of the key, the type, the canonical form and the attempt.

Coreference: equal canonical forms (case folded; digits only for numbers) get equal surrogates wherever
they stand. Distinctness: an inventory of the corpus's distinct entities is checked for two entities with
one surrogate and for surrogates that are themselves an entity of the corpus; all but the least of such a
group go to the next attempt, until none is left. From attempt ATTEMPTS on surrogates get longer with each
attempt (an IPv4 address becomes an IPv6 one of the documentation range, a date any year's), so a form whose
space is exhausted is settled too. Names are settled word by word, so that 'Mr Hu' and 'John Hu' share their
surname's surrogate; the listed given names beside one surname are permuted, so they need no attempts. Only
the few exceptions are looked up when texts are rewritten; all other surrogates are computed in place.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm._shared import cut, few, fresh

INLINE = 500  # exceptions that are written into the plan; more are joined
ATTEMPTS = 8  # surrogates of an entity's own length that are tried

# Given names by gender and script, words before names, words inside them, frequent surnames.
GIVEN = {
    "f": {
        "latin": "Anna Maria Emma Sophie Laura Julia Sarah Lisa Emily Olivia Alice Claire Camille Louise Chloe Lucia Carmen Elena Marta Paula Ana Isabel Rosa Teresa Katharina Johanna Greta Heike Sabine Monika Jane Mary Susan Linda Karen Nancy Helen Ruth Amy Fatima Aisha Leila Zeynep Priya Ananya Mei Yuki Sakura Agnieszka Zofia".split(),
        "cyrillic": "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Екатерина Юлия".split(),
    },
    "m": {
        "latin": "John James Robert Michael William David Richard Thomas Charles Daniel Paul Mark George Peter Hans Klaus Jürgen Stefan Wolfgang Markus Jean Pierre Michel Philippe Nicolas Antoine Luis Carlos Juan Pedro Miguel Javier Diego Pablo Andrew Kevin Brian Edward Henry Jack Mohammed Ahmed Ali Omar Mehmet Raj Arjun Wei Hiroshi Kenji Łukasz Wojciech".split(),
        "cyrillic": "Иван Сергей Алексей Дмитрий Андрей Николай Михаил Владимир Павел Олег".split(),
    },
}
_NAMES = [n for by in GIVEN.values() for names in by.values() for n in names]
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sra?|Signora?|Pani?|Господин|Госпожа"
PARTICLES = "van von de da di del der den bin al el la le".split()
_LABELS = "[Nn]ame|NAME|Full [Nn]ame|First [Nn]ame|Last [Nn]ame|Surname|Username|Contact|Patient|Customer|Employee|Nombre|Nom|Vorname|Nachname|Имя|ФИО|姓名|氏名|이름|الاسم"
PARTICLE = "~"  # stands before a particle in a canonical form
_BEFORE = rf"(?:(?:{_TITLES})\.? |(?:{_LABELS}) ?[:：] {{0,2}})"
_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹"
_KOREAN = "김이박최정강조윤장임한오서신권황안송류홍"
_BORN = r"(?i:date of birth|birth date|birthday|born(?: on)?|dob|geboren(?: am)?|geburtsdatum|née? le|nacid[oa] el|fecha de nacimiento|дата рождения):? {0,2}"

_WORD = r"\p{Lu}[\p{Ll}\p{M}]++(?:['’-]\p{Lu}[\p{Ll}\p{M}]++)*+"
_ANY_WORD = rf"(?:{_WORD}|\p{{Lu}}{{2,}}+|\p{{IsHan}}{{2,4}}+|\p{{IsHangul}}{{2,4}}+|[\p{{IsArabic}}\p{{M}}]{{2,}}+|[\p{{IsHebrew}}\p{{M}}]{{2,}}+|[\p{{IsDevanagari}}\p{{M}}]{{2,}}+|[\p{{IsHiragana}}\p{{IsKatakana}}ー]{{2,}}+)"
_LOWER = f"(?: (?:{'|'.join(PARTICLES)}))*+"
_SECRET = r"(?i:token|secret|password|passwd|api_key|apikey|access_key) {0,2}[=:] {0,2}[\"']?"



def _grouped(words: list[str]) -> str:
    """A pattern of the words, those of one first letter together, so that most are passed over at once."""
    return "|".join(f"{first}(?:{'|'.join(w[1:] for w in words if w[0] == first)})" for first in dict.fromkeys(w[0] for w in words))


# The forms that are looked for, in the order in which they are tried at a place. Each begins
# with the characters it can start with, so that most places of a text are passed over after one comparison.
FORMS = {
    "email": r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}_+-][\p{L}\p{N}._+-]*+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "ip": r"(?=[0-9])(?<![\p{L}\p{N}.])\d{1,3}+(?:\.\d{1,3}+){3}(?!\.?\d)",
    "phone": r"(?=[0-9+(])(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "ssn": r"(?=[0-9])(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "birth": rf"(?=[bdgnfдBDGNFД])(?=[Bb]orn|[Bb]irth|[DdFf]ate|[Dd]ob|DOB|[Gg]eb|[Nn][ée]|[Nn]acid|[Ff]echa|[Дд]ата)(?<![\p{{L}}\p{{N}}]){_BORN}(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}|\d{{1,2}} \p{{L}}{{3,9}}+ \d{{4}})(?!\d)",
    "street": r"(?=[0-9])(?<![\p{L}\p{N}.])\d{1,5} (?:\p{Lu}\p{Ll}++ ){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Boulevard|Blvd|Drive|Court|Square)(?!\p{L})|(?=\p{Lu})(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?:straße|strasse|weg|platz|allee) \d{1,4}(?![\p{L}\p{N}])",
    "iban": r"(?=[A-Z])(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "number": r"(?=[0-9])(?<![\p{L}\p{N}.])\d(?:[ -]?\d){8,18}(?![\p{L}\p{N}])",
    "secret": rf"(?=[0-9a-fA-F])(?<![\p{{L}}\p{{N}}])(?:[0-9a-f]{{32,}}+|[0-9A-F]{{32,}}+)(?![\p{{L}}\p{{N}}])|(?=[tspaTSPA])(?<![\p{{L}}\p{{N}}]){_SECRET}[A-Za-z0-9+/_-]{{8,}}+",
    "name": rf"(?![a-mo-z ])(?=[A-ZÀ-ÞΑ-ΩА-ЯЁŁn姓氏이ا一-鿿가-힣])(?:(?<![\p{{L}}\p{{N}}])(?:(?!n)(?:(?:(?:{_TITLES})\.? )?(?:{_grouped(_NAMES)}){_LOWER} {_WORD}|(?:{_TITLES})\.?{_LOWER} {_WORD}(?:{_LOWER} {_WORD})?)(?!\p{{Ll}})"
    rf"|{_BEFORE}{_ANY_WORD}(?:{_LOWER} {_ANY_WORD}){{0,2}})"
    rf"|[{_SURNAMES}][一-鿿]{{1,2}}(?=先生|女士|小姐|医生|教授|老师)|[一-鿿]{{1,4}}(?=さん|様)|[{_KOREAN}][가-힣]{{1,2}}(?= ?[씨님]))",
}
PATTERN = "|".join(f"(?:{p})" for p in FORMS.values())


def suspect(text: Column) -> Column:
    """A cheap necessary condition: a text without these characters and names holds no entity."""
    return F.contains(text, F.lit("@")) | text.rlike("[0-9]") | (text.rlike("[=:]") & text.rlike(_SECRET)) | text.rlike(FORMS["name"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in FORMS if k != "name"]):
        rule = FORMS[kind]
        out = F.when(F.regexp_like(entity, F.lit(f"^(?:{rule})$")), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, r"\D", "")
    return (
        F.when(kind.isin("phone", "number", "ssn"), digits)
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "name", F.lower(F.regexp_replace(F.regexp_replace(entity, f"^{_BEFORE}", ""), rf"(?<![^ ])({'|'.join(PARTICLES)})(?= )", f"{PARTICLE}$1")))
        .when(kind == "secret", F.lower(F.regexp_replace(entity, f"^{_SECRET}", "")))
        .when(kind == "birth", F.lower(F.regexp_replace(entity, f"^{_BORN}", "")))
        .otherwise(F.lower(entity))
    )


def _hmac(key: str, *parts: Column) -> Column:
    """HMAC-SHA-256 of the parts, in hex."""
    own = hashlib.sha256(key.encode()).digest().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in own)) for x in (0x36, 0x5C))
    said = F.concat_ws("\x1f", *parts).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, said), 256))), 256)


def _stream(key: str, kind: Column, form: Column, attempt: Column) -> Column:
    """256 keyed hex digits."""
    return F.concat(*[_hmac(key, F.lit(str(i)), kind, form, attempt.cast("string")) for i in range(4)])


def _at(stream: Column, i: Column, n: int | Column) -> Column:
    """The i-th number (from 1) below n that the stream gives."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substr(stream, 1 + F.pmod(4 * (i - 1), F.lit(252)).cast("int"), F.lit(4)), 16, 10).cast("int") + F.floor(i / 63).cast("int"), n)


def _classes() -> list[tuple[str, str | None]]:
    """Letters by class, and the pattern of what the class replaces if that isn't just its letters.

    Built by rule: the letters of a block, split by case and, where they have one, by a vowel as their base.
    """
    out: list[tuple[str, str | None]] = [(x, None) for x in ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ")]
    vowels = set("aeiouyаеиоуыэюяαεηιουω")
    # Blocks of letters with case, and without.
    for first, last in ((0xC0, 0x17F), (0x370, 0x3FF), (0x400, 0x45F), (0x531, 0x587), (0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA)):
        by: dict[tuple[str, bool], str] = {}
        for c in map(chr, range(first, last + 1)):
            case = unicodedata.category(c)
            # Letters whose other case is no single letter, or stands elsewhere, would not keep their case.
            if case in ("Ll", "Lu", "Lo") and len(c.upper()) == len(c.lower()) == 1 and c.upper().lower() == c.lower() and c.lower().upper() == c.upper():
                base = unicodedata.normalize("NFD", c)[0].lower()
                by[case, base in vowels] = by.get((case, base in vowels), "") + c
        out += [(letters, None) for letters in by.values() if len(letters) > 1]
    common = [bytes((r, c)).decode("gb2312", "ignore") for r in range(0xB0, 0xD8) for c in range(0xA1, 0xFF, 3)]
    out.append(("".join(common), r"\p{IsHan}"))
    out.append(("".join(map(chr, range(0xAC00, 0xD7A4, 19))), r"\p{IsHangul}"))
    return out


CLASSES = _classes()


def _letter_beside(c: Column, stream: Column, i: Column) -> Column:
    """Another letter of c's case among the 32 code points that c is one of, for scripts without a class."""
    point = F.ascii(c)
    of = lambda k: F.decode(F.unhex(F.lpad(F.hex((point - F.pmod(point, F.lit(32)) + k).cast("long")), 8, "0")), "UTF-32")
    beside = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), of), lambda x: F.regexp_like(x, F.lit(r"^\p{L}$")) & (x != c) & ((x == F.lower(x)) == (c == F.lower(c))) & ((x == F.upper(x)) == (c == F.upper(c))))
    return let(beside, lambda b: F.when(F.size(b) > 0, F.element_at(b, 1 + _at(stream, i, F.size(b)))).otherwise(F.lit("x")))


def _class_mapped(text: Column, stream: Column, hexadecimal: Column) -> Column:
    """text with every letter and digit replaced by one of its class, or a hexadecimal digit; other characters stay."""

    def replaced(c: Column, i: Column) -> Column:
        letters = F.when(hexadecimal & (F.instr(F.lit("0123456789abcdef"), c) > 0), F.lit("0123456789abcdef"))
        for own, rule in CLASSES:
            letters = letters.when(F.instr(F.lit(own), c) > 0 if rule is None else F.regexp_like(c, F.lit(f"^{rule}$")), F.lit(own))
        drawn = let(letters, lambda of: F.when(of.isNotNull(), F.substr(of, 1 + _at(stream, i, F.char_length(of)), F.lit(1))).when(F.regexp_like(c, F.lit(r"^\p{L}$")), _letter_beside(c, stream, i)).otherwise(c))
        return F.when((c == "") | ((c < "0") & (c > " ")), c).otherwise(drawn)

    return F.array_join(F.transform(F.split(text, ""), lambda c, i: replaced(c, i + 1)), "")


def _luhn(digits: Column) -> Column:
    """The check digit that makes digits plus it hold the Luhn sum."""

    def term(i: Column) -> Column:
        d = F.substr(digits, i.cast("int"), F.lit(1)).cast("int")
        odd = F.pmod(F.char_length(digits) - i, F.lit(2)) == 0
        return F.when(odd, F.when(d >= 5, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    terms = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(digits))), term)
    return F.pmod(10 - F.pmod(F.aggregate(terms, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10))


def _octets(stream: Column, attempt: Column) -> Column:
    four = F.concat_ws(".", *[(1 + _at(stream, F.lit(i), 254)).cast("string") for i in (1, 2, 3, 4)])
    return F.when(attempt < ATTEMPTS, four).otherwise(F.concat(F.lit("2001:db8:"), F.concat_ws(":", *[F.substr(stream, F.lit(4 * i + 1), F.lit(4)) for i in range(6)])))


def _born(form: Column, stream: Column, attempt: Column) -> Column:
    """A valid date in the layout of the given one; a month's name stays."""
    year = F.when(attempt < ATTEMPTS, 1930 + _at(stream, F.lit(1), 80)).otherwise(1000 + _at(stream, F.lit(1), 9000)).cast("string")
    month, day = (1 + _at(stream, F.lit(2), 12)).cast("string"), (1 + _at(stream, F.lit(3), 28)).cast("string")
    wide = lambda n: F.lpad(n, 2, "0")
    between = F.regexp_extract(form, r"^\d+(\D+)", 1)
    spelt = F.regexp_like(form, F.lit(r"\p{L}"))
    return F.when(F.regexp_like(form, F.lit(r"^\d{4}-")), F.concat_ws("-", year, wide(month), wide(day))).when(spelt, F.concat(day, between, year)).otherwise(F.concat(wide(day), between, wide(month), between, year))


def _listed(part: Column) -> Column:
    return part.isin(*[n.lower() for n in _NAMES])


def _given(given: Column, stream: Column) -> Column:
    """The given name that replaces a listed one: of the same gender and script, by a permutation that the stream draws."""
    new = given
    for by in GIVEN.values():
        for names in by.values():
            n = len(names)
            low = F.split(F.lit(" ".join(names).lower()), " ")
            steps = [str(m) for m in range(1, n) if gcd(m, n) == 1]
            step = F.element_at(F.split(F.lit(" ".join(steps)), " "), _at(stream, F.lit(1), len(steps)) + 1).cast("int")
            place = F.pmod((F.array_position(low, given) - 1) * step + _at(stream, F.lit(2), n), F.lit(n))
            new = F.when(F.array_contains(low, given), F.element_at(low, (place + 1).cast("int"))).otherwise(new)
    return new


def units(kind: Column, form: Column) -> Column:
    """What an entity's surrogate is settled by, (kind, form) each: itself, or the words of a name but its listed given name and particles."""
    words = F.split(form, " ")
    own = F.filter(words, lambda w, i: ~((i == 0) & (F.size(words) > 1) & _listed(w)) & ~F.startswith(w, F.lit(PARTICLE)))
    return F.when(kind == "name", F.transform(own, lambda w: F.struct(F.lit("part").alias("kind"), w.alias("form")))).otherwise(F.array(F.struct(kind.alias("kind"), form.alias("form"))))


def _longer(kind: Column, form: Column, attempt: Column) -> Column:
    """A form, from attempt ATTEMPTS on with two characters of its classes more for each attempt; addresses of four octets and dates have more of their own."""
    more = lambda said: F.repeat(F.lit(said), attempt - (ATTEMPTS - 1))
    letters = F.lit(None)
    for script, said in (("Cyrillic", "на"), ("Greek", "να"), ("Han", "中中"), ("Hangul", "가가"), ("Arabic", "بب"), ("Hebrew", "בב"), ("Hiragana", "なな"), ("Katakana", "ナナ")):
        letters = F.coalesce(letters, F.when(F.regexp_like(form, F.lit(rf"\p{{Is{script}}}")), more(said)))
    letters = F.coalesce(letters, more("na"))
    grown = (
        F.when(kind == "email", F.concat(F.substring_index(form, "@", 1), letters, F.lit("@"), F.substring_index(form, "@", -1)))
        .when(kind == "number", F.concat(F.substr(form, F.lit(1), F.char_length(form) - 1), more("00"), F.substr(form, F.char_length(form), F.lit(1))))
        .when(kind.isin("phone", "ssn", "iban"), F.concat(form, more("00")))
        .when(kind == "secret", F.concat(form, more("a0")))
        .when(kind == "part", F.concat(form, letters))
        .when(kind == "street", F.regexp_replace(form, r"(\d+)", F.concat(F.lit("$1"), more("00"))))
        .otherwise(form)
    )
    return F.when(attempt < ATTEMPTS, form).otherwise(grown)


# The part of a form that is replaced: what stands before it (1), it (2), what stands behind it (3),
# and further letters and digits that are (4). Of a card the last digit is worked out; an e-mail's host is example.
_PARTED = {
    "email": r"^()(.*?)(@)([^.@]*).*$",
    "phone": r"^(.)(.*)()()$",
    "number": r"^(.)(.*).()()$",
    "iban": r"^(..)(.*)()()$",
    "street": r"^()(.*?)( \p{L}+|(?:straße|strasse|weg|platz|allee) )(\d*)$",
}


def unit_surrogate(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The replacement of a unit's canonical form, itself in canonical form."""

    def drawn(p: Column) -> Column:
        # "\x1f" divides what the classes replace from what stands behind it and what is replaced there.
        rule = F.lit(r"(?s)^()(.*)()()$")
        for of, pattern in _PARTED.items():
            rule = F.when(kind == of, F.lit(pattern)).otherwise(rule)
        part = lambda i: F.call_function("regexp_extract", p["form"], rule, F.lit(i))
        hexadecimal = (kind == "secret") & F.regexp_like(p["form"], F.lit("^[0-9a-f]+$"))
        mapped = F.split(_class_mapped(F.concat(part(2), F.lit("\x1f"), part(4)), p["stream"], hexadecimal), "\x1f")
        return F.struct(part(1).alias("before"), mapped[0].alias("first"), part(3).alias("between"), mapped[1].alias("second"))

    def made(p: Column) -> Column:
        stream = p["stream"]

        def joined(d: Column) -> Column:
            whole = F.concat(d["before"], d["first"], d["between"], d["second"])
            domain = F.element_at(F.array(F.lit(".example.com"), F.lit(".example.net"), F.lit(".example.org")), _at(stream, F.lit(61), 3) + 1)
            head, last = F.substr(p["form"], F.lit(1), F.char_length(p["form"]) - 1), F.substr(p["form"], F.char_length(p["form"]), F.lit(1)).cast("int")
            check = F.pmod(last - _luhn(head) + _luhn(whole), F.lit(10)).cast("string")  # as far from the Luhn digit as the original: 0 for true cards
            return F.when(kind == "email", F.concat(whole, domain)).when(kind == "number", F.concat(whole, check)).otherwise(whole)

        return F.when(kind == "ip", _octets(stream, attempt)).when(kind == "birth", _born(p["form"], stream, attempt)).otherwise(let(drawn(p), joined))

    return let(F.struct(_longer(kind, form, attempt).alias("form"), _stream(key, kind, form, attempt).alias("stream")), made)


def surrogate(kind: Column, form: Column, attempt_of: Callable[[Column, Column], Column], key: str) -> Column:
    """The replacement of an entity's canonical form; attempt_of gives the attempt at a unit."""
    named = kind == "name"

    def by_word(words: Column) -> Column:
        def word(w: Column, i: Column) -> Column:
            own = let(F.struct(F.when(named, F.lit("part")).otherwise(kind).alias("kind"), w.alias("form")), lambda u: let(attempt_of(u["kind"], u["form"]), lambda n: unit_surrogate(u["kind"], u["form"], n, key)))
            given = named & (i == 0) & (F.size(words) > 1) & _listed(w)
            return F.when(given, _given(w, _hmac(key, F.lit("given"), F.element_at(words, -1)))).when(named & F.startswith(w, F.lit(PARTICLE)), F.substr(w, F.lit(2))).otherwise(own)

        return F.array_join(F.transform(words, word), " ")

    return let(F.when(named, F.split(form, " ")).otherwise(F.array(form)), by_word)


def _cased(entity: Column, new: Column) -> Column:
    """new in capitals, with a capital or as it is, as entity is written."""
    first = F.substr(entity, F.lit(1), F.lit(1))
    return F.when((entity == F.upper(entity)) & (entity != F.lower(entity)), F.upper(new)).when(first != F.lower(first), F.concat(F.upper(F.substr(new, F.lit(1), F.lit(1))), F.substr(new, F.lit(2), F.char_length(new)))).otherwise(new)


def _dressed(kind: Column, entity: Column, surrogate_: Column) -> Column:
    """A canonical surrogate in the entity's own format: its punctuation, its title or key word, its case."""

    def spread(new: Column) -> Column:
        # The i-th digit or capital of the entity becomes the i-th character of the surrogate.
        def at(i: Column) -> Column:
            c = F.substr(entity, i.cast("int"), F.lit(1))
            return F.when(F.regexp_like(c, F.lit("^[0-9A-Z]$")), F.substr(new, F.char_length(F.regexp_replace(F.substr(entity, F.lit(1), i.cast("int")), "[^0-9A-Z]", "")), F.lit(1))).otherwise(c)

        spread_out = F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(entity)), at), "")
        return F.concat(spread_out, F.substr(new, F.char_length(F.regexp_replace(entity, "[^0-9A-Z]", "")) + 1, F.char_length(new)))

    def put(new: Column) -> Column:
        before = F.when(kind == "name", F.regexp_extract(entity, f"^{_BEFORE}", 0)).when(kind == "secret", F.regexp_extract(entity, f"^{_SECRET}", 0)).when(kind == "birth", F.regexp_extract(entity, f"^{_BORN}", 0)).otherwise(F.lit(""))
        value = F.substr(entity, F.char_length(before) + 1, F.char_length(entity))
        by_word = F.array_join(F.zip_with(F.split(value, " "), F.split(new, " "), lambda old, word: _cased(old, word)), " ")
        return F.when(kind.isin("phone", "number", "ssn", "iban"), spread(new)).when(kind.isin("name", "street"), F.concat(before, by_word)).when(kind == "birth", F.concat(before, new)).otherwise(F.concat(before, _cased(value, new)))

    return let(surrogate_, put)


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def inventory(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct entities of docs: kind, form and their number n."""
    found = docs.filter(suspect(F.col(text))).select(F.explode(entities(F.col(text))).alias("entity"))
    return found.select(kind_of(F.col("entity")).alias("kind"), "entity").select("kind", canonical(F.col("kind"), F.col("entity")).alias("form")).groupBy("kind", "form").agg(F.count(F.lit(1)).alias("n"))


def exceptions(known: DataFrame, key: str) -> DataFrame:
    """The units whose first surrogate collides: kind, form, attempt (from 1). known: a stored inventory."""
    known = cut(known.select(F.explode(units(F.col("kind"), F.col("form"))).alias("u")).select("u.*").distinct())
    n = known.count()
    taken = few(known.select(F.col("kind").alias("k"), F.col("form").alias("s")), n)
    new = unit_surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key)  # built once, which takes longer than a round
    settled = few(cut(known.withColumn("attempt", F.lit(0)).withColumn("new", new)), n)  # worked out in all tasks, read in few
    attempt = 0
    while True:
        # Of those that share a surrogate the earliest attempt, then the least form, keeps it; a corpus entity is no surrogate.
        twice = settled.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("attempt", "form")).alias("best")).filter("c > 1")
        real = settled.join(taken, (settled["kind"] == taken["k"]) & (settled["new"] == taken["s"]), "left_semi").select("kind", "form")
        lost = (
            settled.join(twice.select(F.col("kind").alias("k"), F.col("new").alias("w"), "best"), (F.col("kind") == F.col("k")) & (F.col("new") == F.col("w")))
            .filter((F.col("best.form") != F.col("form")) | (F.col("best.attempt") != F.col("attempt")))
            .select("kind", "form")
        )
        again = cut(few(lost.unionByName(real).distinct(), n))
        if again.isEmpty():
            return settled.filter("attempt > 0").select("kind", "form", "attempt")
        attempt += 1
        moved = again.withColumn("attempt", F.lit(attempt)).withColumn("new", new)
        settled = cut(few(settled.join(again, ["kind", "form"], "left_anti"), n).unionByName(moved))


def _rewritten(text: Column, found: Column, attempts: Column | None, key: str) -> Column:
    def attempt_of(kind: Column, form: Column) -> Column:
        return F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, F.concat_ws("\x1f", kind, form)), F.lit(0))

    def replaced(entity: Column) -> Column:
        each = let(kind_of(entity), lambda kind: F.struct(kind.alias("kind"), canonical(kind, entity).alias("form")))
        return let(each, lambda p: _dressed(p["kind"], entity, surrogate(p["kind"], p["form"], attempt_of, key)))

    parts = F.zip_with(F.split(text, PATTERN, -1), F.transform(found, replaced), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    return F.array_join(parts, "")


def pseudonymised(docs: DataFrame, key: str = "chronoloom", text: str = "text") -> DataFrame:
    """docs with every entity of its text replaced, and n_entities.

    A null text stays null and an empty one empty, both with 0 entities; a text without entities is
    returned as it is. Repeated rows and equal texts get equal results. All other columns are kept,
    whatever they are called, but one called n_entities is replaced. An empty table gives an empty one.
    """
    docs = docs.drop("n_entities")
    of, needed, found = fresh(docs, "_of", "_attempts", "_found")
    known = cut(inventory(docs, text))
    odd = cut(exceptions(known, key))
    n_odd = odd.count()
    said = F.col(text)
    pair = F.concat_ws("\x1f", "kind", "form")
    attempts: Column | None = None
    out = docs
    if 0 < n_odd <= INLINE:
        rows = odd.select(pair.alias("p"), "attempt").collect()
        attempts = F.map_from_arrays(F.array(*[F.lit(r.p) for r in rows]), F.array(*[F.lit(r.attempt) for r in rows]))
    elif n_odd:
        # Each text that holds an exception, by its digest, with the attempts it needs.
        digest = F.sha2(said.cast("binary"), 256)
        each = docs.filter(suspect(said)).select(digest.alias(of), F.explode(F.array_distinct(entities(said))).alias("e"))
        each = each.select(of, kind_of(F.col("e")).alias("kind"), "e").select(of, F.explode(units(F.col("kind"), canonical(F.col("kind"), F.col("e")))).alias("u"))
        each = each.select(of, "u.*").distinct()
        needs = each.join(odd, ["kind", "form"]).groupBy(of).agg(F.map_from_entries(F.collect_set(F.struct(pair, "attempt"))).alias(needed))
        out = docs.join(needs, digest == F.col(of), "left")
        attempts = F.col(needed)
    nothing = F.expr("cast(array() as array<string>)")
    out = out.withColumn(found, F.when(suspect(said), entities(said)).otherwise(nothing))
    out = out.withColumn("n_entities", F.size(found))
    out = out.withColumn(text, F.when(F.col("n_entities") > 0, _rewritten(said, F.col(found), attempts, key)).otherwise(said))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "n_entities")


def key_of(spark: SparkSession) -> str:
    """The key the session names in spark.chronoloom.pii.key; a public one, for tests and trials, where none is set."""
    return spark.conf.get("spark.chronoloom.pii.key", None) or "chronoloom"
