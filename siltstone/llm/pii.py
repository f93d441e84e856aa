"""Replacement of personal data by keyed surrogates (operator 7), DataFrame functions only.

One pattern finds all kinds of entities in a text; the text is split at its matches and
put together again with surrogates in their places, so nothing that a surrogate looks
like is replaced again. A surrogate comes from a keyed hash of the entity's kind and
normal form and keeps its kind and format: digits become digits, letters letters of the
same case and script, hexadecimal stays so, separators stay where they are; network addresses stay
addresses, card numbers keep their issuer's digit and check sum, street addresses their kind of street.

A person is found by a title. A given name and a surname have a surrogate each (kinds ``given`` and ``surname``), made of syllables of
their script, a given name's by the gender of its title, a Cyrillic or Greek surname's by the gender of its ending. So all forms of a
name agree: once a text has ``Mr. John Smith``, its ``Mr. Smith``, ``John Smith`` and ``Smith`` are replaced alike. Names
without a title anywhere in their text aren't found.

The same entity (whatever its case or separators) gets the same surrogate in all texts. Distinct
entities must get distinct ones, and none that is an entity itself: all distinct
entities, with both parts of names, are checked, and each that collides is hashed anew with a higher attempt (names grow longer with it), until none does. Only
those few have an attempt above zero; they are joined to the texts by broadcast up to
``BROADCAST_ROWS`` of them and by a shuffle beyond.

Null and empty texts stay as they are. Repeated rows each give a row. All columns of ``docs`` are kept by
``with_surrogates`` whatever their names; ``text`` and, if there is one, ``n_chars`` follow the replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import let

#: Secret of the keyed hash; set another for each release.
KEY = "siltstone"
#: At most so many entities of attempt above zero are broadcast.
BROADCAST_ROWS = 10_000
ROUNDS = 20

#: Kinds and their patterns, in order of precedence. A secret's value goes up to its closing quote or white space, without
#: punctuation at its end, and has six signs or more.
KINDS = (
    ("email", r"(?<![\w.%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+"),
    ("secret", r"(?<![\w])(?i:password|passwd|pwd|secret|api[_\-]?key|access[_\-]?key|token)\s{0,3}[=:]\s{0,3}(?:\"[^\s\"]{6,}+\"|'[^\s']{6,}+'|[\"']?(?=[^\s\"']{5,}?[^\s\"'.,;])(?:[.,;]*+[^\s\"'.,;]++)++[\"']?)"),
    ("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("hex", r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("card", r"(?<![\w\-])\d(?:[ \-]?\d){12,18}(?![\w\-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\w)"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("address", r"(?<![\w.])\d{1,5} (?:\p{Lu}\p{Ll}+ ){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|St|Ave|Rd|Blvd)(?!\p{L})|(?<!\p{L})\p{Lu}\p{Ll}+(?:straße|strasse|weg|platz|gasse) \d{1,4}[a-z]?(?![\p{L}\p{N}])|(?<![\w.])\d{1,4},? (?:rue|avenue|boulevard) (?:(?:de|du|des|la) ){0,2}\p{Lu}\p{Ll}+"),
)
#: Titles of men, of women and of either, a word of a name.
MR = "Mr|Herr|Monsieur|Señor|господин|Господин|г-н|Κύριος|Κύριε"
MRS = "Mrs|Ms|Miss|Frau|Madame|Señora|госпожа|Госпожа|г-жа|Κυρία"
EITHER = "Dr|Prof"
_NAME = r"\p{Lu}(?:\p{Ll}+|(?=['’]\p{Lu}))(?:[\-'’]\p{Lu}?\p{Ll}+)*"
_TITLE = rf"(?:{MRS}|{MR}|{EITHER})\.? "
TITLED = rf"(?<!\p{{L}}){_TITLE}{_NAME}(?: {_NAME})?"

#: Syllables of surrogate names by script, and the ends of given names (men, women, either) and of surnames (men, women).
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fi ga ge go ha he ho ja jo ka ke ko la le li lo ma me mi mo na ne no pa pe po ra re ri ro sa se so ta te ti to va ve wi".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за зе ка ко ла ле ли ло ма ме ми мо на не но па пе по ра ре ро са се со та те ти то фа фе хо ча".split(),
    "greek": "βα βε γα γε δα δε ζα ζε θα θε κα κε κο λα λε λι μα με μι μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το φα φε χα".split(),
}
GIVEN_ENDS = {
    "latin": ("n r s l rd rt mir lf".split(), "ra na la sa tte lle ne nja".split(), "m nn x y".split()),
    "cyrillic": ("н р л с слав мир".split(), "на ра ла ся нья лия".split(), "ша ня".split()),
    "greek": ("νης ρος λος κης".split(), "να ρα λη νη".split(), "νι ρι".split()),
}
SURNAME_ENDS = {
    "latin": ("rsen rmann lberg nsky lter ndt rick nson lley rton ndez rdi".split(),) * 2,
    "cyrillic": ("нов ров лин син нский рский".split(), "нова рова лина сина нская рская".split()),
    "greek": ("νίδης ρίδης λάκης νόπουλος".split(), "νίδου ρίδου λάκη νοπούλου".split()),
}
#: Letters that stand in for others of their script, small and large.
ALPHABETS = (
    (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{IsLatin}", "àáâãäåæçèéêëìíîïñòóôõöøùúûü", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜ"),
    (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"\p{L}", "的一是不了人我在有他这中大来上国", "的一是不了人我在有他这中大来上国"),
)

#: A text without any of these has no entity; each alternative is one look at a sign in most places.
_MAY_HAVE = r"[0-9@=:]|AKIA|ASIA|[MFHSDPгГΚ](?:rs|r|s|iss|err|rau|adame|onsieur|eñora|eñor|rof|осподин|оспожа|-н|-жа|ύριος|ύριε|υρία)\.? \p{Lu}|[0-9a-f]{32}"
_MAY_NAME = r"[MFHSDPгГΚ](?:rs|r|s|iss|err|rau|adame|onsieur|eñora|eñor|rof|осподин|оспожа|-н|-жа|ύριος|ύριε|υρία)\.? \p{Lu}"
#: Entities begin where no word goes on, which rules out most places before any kind is tried.
_ANY = "|".join(f"(?:{p})" for _, p in KINDS) + f"|{TITLED}"
PATTERN = rf"(?<!\w)(?:{_ANY})"
_ALNUM = r"[^\p{L}\p{N}]"
_SECRET_HEAD = r"^[A-Za-z_\-]+\s{0,3}[=:]\s{0,3}[\"']?"
_STREET = r" (?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|St|Ave|Rd|Blvd)$|(?:straße|strasse|weg|platz|gasse) "


def kind_of(e: Column) -> Column:
    """The first kind whose pattern an entity matches wholly."""
    out = F.lit("name")
    for kind, p in reversed(KINDS):
        out = F.when(e.rlike(f"^(?:{p})$"), kind).otherwise(out)
    return out


def fixed_head(kind: Column, e: Column) -> Column:
    """What of an entity stays: the label of a secret, an access key's prefix, a title, a country code, a card's issuer."""
    return (
        F.when(kind == "secret", F.regexp_extract(e, _SECRET_HEAD, 0))
        .when(kind == "access_key", F.substring(e, 1, 4))
        .when(kind == "iban", F.substring(e, 1, 2))
        .when(kind == "card", F.substring(e, 1, 1))
        .when(kind == "phone", F.regexp_extract(e, r"^\+\d{1,3}(?!\d)", 0))
        .otherwise("")
    )


def normal(kind: Column, e: Column) -> Column:
    """Equal for entities that are the same one: without case and separators (but for network addresses and secrets).

    A given name is written with its gender: ``m|``, ``f|`` or ``x|`` before it."""
    body = F.substr(e, F.char_length(fixed_head(kind, e)) + 1)
    return (
        F.when(kind == "email", F.lower(e))
        .when(kind == "ip", e)
        .when(kind == "secret", F.rtrim(body, F.lit("\"'")))
        .when(kind == "surname", F.lower(e))
        .when(kind == "given", F.concat(F.substr(e, F.lit(1), F.lit(2)), F.lower(F.substr(e, F.lit(3)))))
        .otherwise(F.regexp_replace(F.lower(e), _ALNUM, ""))
    )


def _byte(stream: Column, i: Column) -> Column:
    """Number i (0 to 65535) of a hexadecimal stream, which is used again from its start when it ends."""
    return F.conv(F.substr(stream, F.pmod(i * 4, F.lit(1020)) + 1, F.lit(4)), 16, 10).cast("int")


def _stream(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """1024 hexadecimal digits of a keyed hash."""
    seed = F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat(F.lit(f"{k}|"), seed, F.lit(f"|{key}")), 512) for k in range(8)))


def name_surrogate(kind: Column, part: Column, attempt: Column, stream: Column) -> Column:
    """The surrogate of a given name (with its gender before it) or a surname, in its script: two or three syllables, two more from
    the third attempt on, four from the sixth, and an end that fits the gender."""
    given = kind == "given"
    gender, name = F.substr(part, F.lit(1), F.lit(2)), F.when(given, F.substr(part, F.lit(3))).otherwise(part)

    def of(script: str, women: str) -> Column:
        men, ladies, both = (F.lit(" ".join(x)) for x in GIVEN_ENDS[script])
        male, female = (F.lit(" ".join(x)) for x in SURNAME_ENDS[script])
        ends = F.when(given, F.when(gender == "m|", men).when(gender == "f|", ladies).otherwise(both)).when(name.rlike(women), female).otherwise(male)
        return F.struct(F.lit("".join(SYLLABLES[script])).alias("syllables"), F.split(ends, " ").alias("ends"))

    def made(x: Column) -> Column:
        many = F.when(given, 2).otherwise(3) + F.when(attempt >= 6, 4).when(attempt >= 3, 2).otherwise(0)
        syllable = lambda k: F.substr(x["syllables"], _byte(stream, k + 10) % (F.char_length(x["syllables"]) / 2).cast("int") * 2 + 1, F.lit(2))
        word = F.initcap(F.concat(F.array_join(F.transform(F.sequence(F.lit(0), many - 1), syllable), ""), F.get(x["ends"], _byte(stream, F.lit(30)) % F.size(x["ends"]))))
        return F.when(given, F.concat(gender, word)).otherwise(word)

    return let(F.when(name.rlike(r"\p{IsCyrillic}"), of("cyrillic", "[аяАЯ]$")).when(name.rlike(r"\p{IsGreek}"), of("greek", "[αηουάή]$")).otherwise(of("latin", "^$")), made)


def _mapped(body: Column, stream: Column, hexadecimal: Column, nonzero: Column) -> Column:
    """Digits to digits, letters to letters of their case and script, all else unchanged.

    The k-th letter or digit takes the k-th number of the stream, so separators don't matter.
    """

    def alphabet(c: Column, k: Column) -> Column:
        out = F.lit(None).cast("string")
        for script, small, large in reversed(ALPHABETS):
            out = F.when(c.rlike(script), F.when(c == F.lower(c), F.lit(small)).otherwise(F.lit(large))).otherwise(out)
        ascii = F.when(hexadecimal & c.rlike("[0-9a-f]"), "0123456789abcdef").when(c.rlike("[0-9]"), F.when(nonzero & (k == 0), "23456789").otherwise("0123456789"))
        return ascii.when(c.rlike("[a-z]"), "abcdefghijklmnopqrstuvwxyz").when(c.rlike("[A-Z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").otherwise(out)

    def one(c: Column, k: Column) -> Column:
        return let(alphabet(c, k), lambda a: F.coalesce(F.substr(a, _byte(stream, k) % F.char_length(a) + 1, F.lit(1)), c))

    chars = F.filter(F.split(body, ""), lambda c: c != "")

    def placed(cs: Column) -> Column:
        """Each sign with how many letters and digits come before it."""
        start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
        step = lambda a, c: F.struct(F.concat(a["s"], one(c, a["k"])).alias("s"), (a["k"] + c.rlike(r"[\p{L}\p{N}]").cast("int")).alias("k"))
        return F.aggregate(cs, start, step, lambda a: a["s"])

    return let(chars, placed)


def _luhn_total(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum of digits; the last is doubled if a check digit follows."""
    n = F.char_length(digits)
    weigh = lambda c, i: let(c.cast("int") * F.when(F.pmod(n - 1 - i, F.lit(2)) == (0 if doubled_last else 1), 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), weigh), F.lit(0), lambda a, v: a + v)


def _with_check_digit(e: Column) -> Column:
    """A card number with its last digit set so that the check sum holds."""
    digits = F.regexp_replace(e, r"\D", "")
    total = _luhn_total(F.substr(digits, F.lit(1), F.char_length(digits) - 1), True)
    return F.concat(F.substr(e, F.lit(1), F.char_length(e) - 1), F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def surrogate(kind: Column, e: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of entity ``e``."""

    def build(s: Column) -> Column:
        head = fixed_head(kind, e)
        body = F.substr(e, F.char_length(head) + 1)
        ip = F.concat_ws(".", *((_byte(s, F.lit(k)) % (223 if k == 0 else 254) + 1).cast("string") for k in range(4)))
        top = F.regexp_extract(e, r"\.[A-Za-z0-9\-]+$", 0)
        # what is mapped sign by sign: a mail address without its last label, the number of a house, else all but the head
        part = F.when(kind == "email", F.substr(e, F.lit(1), F.char_length(e) - F.char_length(top))).when(kind == "address", F.regexp_extract(e, r"\d+[a-z]?", 0)).otherwise(body)
        mapped = _mapped(part, s, (kind == "hex") | ((kind == "secret") & body.rlike("^[0-9a-f\"']+$")), kind.isin("phone", "ssn", "address"))
        kept, french = F.regexp_extract(e, _STREET, 0), F.regexp_extract(e, r"^\d+(,? (?:rue|avenue|boulevard) (?:(?:de|du|des|la) ){0,2})", 1)
        valid = (kind == "card") & (_luhn_total(F.regexp_replace(e, r"\D", ""), False) % 10 == 0)

        def whole(m: Column, name: Column) -> Column:
            address = F.when(french != "", F.concat(m, french, name)).when(e.rlike(r"^\d"), F.concat(m, F.lit(" "), name, kept)).otherwise(F.concat(name, kept, m))
            other = let(F.concat(head, m), lambda x: F.when(valid, _with_check_digit(x)).otherwise(x))
            return F.when(kind == "ip", ip).when(kind.isin("given", "surname"), name).when(kind == "email", F.concat(m, top)).when(kind == "address", address).otherwise(other)

        street = F.when(kind == "address", "street").otherwise(e)
        name = F.when(kind.isin("given", "surname", "address"), name_surrogate(kind, street, attempt, s))
        return let(F.struct(mapped.alias("m"), name.alias("n")), lambda x: whole(x["m"], x["n"]))

    return let(_stream(kind, normal(kind, e), attempt, key), build)


def titled_names(text: Column) -> Column:
    """The distinct names with a title of a text: gender (``m|``, ``f|`` or ``x|``), given (may be empty) and surname."""
    found = F.when(text.rlike(_MAY_NAME), F.array_distinct(F.regexp_extract_all(text, F.lit(TITLED), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda x: name_parts(x, None))


def name_parts(e: Column, known: Column | None) -> Column:
    """gender, given and surname of a mention; one without a title has the gender of the first name among ``known`` with its parts."""
    words = F.split(F.regexp_replace(e, f"^{_TITLE}", ""), " ")
    given = F.when(F.size(words) > 1, F.get(words, F.lit(0))).otherwise("")
    surname = F.element_at(words, -1)
    gender = F.when(e.rlike(f"^(?:{MRS})\\.? "), "f|").when(e.rlike(f"^(?:{MR})\\.? "), "m|")
    if known is not None:
        same = F.filter(known, lambda n: (n["given"] == given) & (n["surname"] == surname) & (n["gender"] != "x|"))
        gender = F.coalesce(gender, F.get(same, F.lit(0))["gender"])
    return F.struct(F.coalesce(gender, F.lit("x|")).alias("gender"), given.alias("given"), surname.alias("surname"))


def pattern_of(names: Column) -> Column:
    """The pattern of a text with these titled names: theirs without a title are entities too."""
    join = lambda part: F.array_join(F.array_distinct(F.filter(F.transform(names, lambda n: n[part]), lambda x: x != "")), "|")
    given = let(join("given"), lambda g: F.when(g == "", "").otherwise(F.concat(F.lit("(?:(?:"), g, F.lit(") )?"))))
    return F.concat(F.lit(rf"(?<!\w)(?:{_ANY}|(?<![\p{{L}}\p{{N}}])"), given, F.lit("(?:"), join("surname"), F.lit(r")(?![\p{L}\p{N}]))"))


def entities_of(text: Column, names: Column) -> Column:
    """The entities of a text in order (array<string>), empty for null."""
    plain = F.when(text.rlike(_MAY_HAVE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(names) > 0, F.regexp_extract_all(text, pattern_of(names), F.lit(0))).otherwise(plain)


def parts_of(e: Column, names: Column) -> Column:
    """(kind, e) of an entity: itself, or the surname and given name of a name."""

    def of(kind: Column) -> Column:
        one = lambda k, x: F.struct(k.alias("kind"), x.alias("e"))
        named = let(name_parts(e, names), lambda n: F.when(n["given"] == "", F.array(one(F.lit("surname"), n["surname"]))).otherwise(F.array(one(F.lit("surname"), n["surname"]), one(F.lit("given"), F.concat(n["gender"], n["given"])))))
        return F.when(kind == "name", named).otherwise(F.array(one(kind, e)))

    return let(kind_of(e), of)


def raised_attempts(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, attempt) of the distinct entities (kind, norm, sample) that need an attempt above zero.

    Two distinct entities with one surrogate, or a surrogate that is an entity, raise the attempt of
    the one with the greater normal form, until every surrogate is its own.
    """
    state = common.materialize(entities.withColumn("attempt", F.lit(0)), "entities")
    for _ in range(ROUNDS):
        own = surrogate(F.col("kind"), F.col("sample"), F.col("attempt"), key)
        made = common.materialize(state.select("kind", "norm", let(own, lambda x: normal(F.col("kind"), x)).alias("s")), "surrogates")
        first = made.groupBy("kind", "s").agg(F.min("norm").alias("least"), F.count("*").alias("n"))
        # a surrogate may clash with one of its own kind, or equal a true entity
        clash = first.where("n > 1").select("kind", "s", "least")
        true = made.select("kind", F.col("norm").alias("s")).join(first.select("kind", "s"), ["kind", "s"]).withColumn("true", F.lit(True))
        bad = made.join(clash, ["kind", "s"], "left").join(true, ["kind", "s"], "left").where((F.col("least").isNotNull() & (F.col("norm") != F.col("least"))) | F.col("true"))
        bad = common.materialize(bad.select("kind", "norm"), "clashes")
        if bad.isEmpty():
            break
        state = common.materialize(state.join(bad.withColumn("b", F.lit(1)), ["kind", "norm"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("b", F.lit(0))).drop("b"), "entities")
    else:
        raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")
    return state.where("attempt > 0").select("kind", "norm", "attempt")


def with_surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with entities in ``text`` replaced (n_chars follows, if there is such a column), and ``n_replaced``."""
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), titled_names(F.col("text")).alias("_names"))
    rows = rows.withColumn("_e", entities_of(F.col("_row.text"), F.col("_names")))

    def parts(rows: DataFrame, *keys: str) -> DataFrame:
        """kind, norm and e of all entities, names in their parts."""
        each = rows.where(F.size("_e") > 0).select(*keys, "_names", F.explode(F.array_distinct("_e")).alias("x"))
        return each.select(*keys, F.inline(parts_of(F.col("x"), F.col("_names")))).distinct().withColumn("norm", normal(F.col("kind"), F.col("e")))

    raised = raised_attempts(parts(rows).groupBy("kind", "norm").agg(F.min("e").alias("sample")), key)
    count = raised.count()

    def replaced(text: Column, e: Column, names: Column, attempts: Column | None) -> Column:
        split = F.when(F.size(names) > 0, F.split(text, pattern_of(names), -1)).otherwise(F.split(text, PATTERN, -1))
        number = (lambda k, x: F.coalesce(F.element_at(attempts, F.concat_ws("|", k, normal(k, x))), F.lit(0))) if attempts is not None else (lambda k, x: F.lit(0))
        made = lambda p: surrogate(p["kind"], p["e"], number(p["kind"], p["e"]), key)

        def put(x: Column) -> Column:
            """The surrogates of an entity's parts (a name's surname comes first) behind its title."""
            joined = lambda ps: F.when(F.size(ps) == 2, F.concat(F.substr(F.get(ps, F.lit(1)), F.lit(3)), F.lit(" "), F.get(ps, F.lit(0)))).otherwise(F.get(ps, F.lit(0)))
            return F.concat(F.regexp_extract(x, f"^{_TITLE}", 0), let(F.transform(parts_of(x, names), made), joined))

        new = F.transform(e, put)
        return F.array_join(F.zip_with(split, new, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")

    if count:
        few = F.broadcast(raised) if count <= BROADCAST_ROWS else raised
        rows = rows.withColumn("_id", F.xxhash64(F.col("_row.text")))
        per = parts(rows, "_id").join(few, ["kind", "norm"]).select("_id", F.concat_ws("|", "kind", "norm").alias("k"), "attempt").distinct().groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("_a"))
        rows = rows.join(F.broadcast(per) if count <= BROADCAST_ROWS and per.count() <= BROADCAST_ROWS else per, "_id", "left")
        attempts = F.col("_a")
    else:
        attempts = None
    text = F.when(F.size("_e") == 0, F.col("_row.text")).otherwise(replaced(F.col("_row.text"), F.col("_e"), F.col("_names"), attempts))
    rows = rows.select("_row", text.alias("_text"), F.size("_e").cast("long").alias("n_replaced"))
    keep = [F.col("_text").alias(c) if c == "text" else F.char_length("_text").cast("long").alias(c) if c == "n_chars" else F.col(f"_row.`{c}`") for c in columns]
    return rows.select(*keep, *([] if "n_replaced" in columns else ["n_replaced"]))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return with_surrogates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
