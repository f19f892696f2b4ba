"""Personal data replaced by surrogates.

Entities found: e-mail addresses, telephone, payment card, social security and IBAN numbers, IPv4 addresses, keys and
tokens, and names behind a title. Each gets a surrogate of its own type, made from a keyed hash (HMAC) of the entity: the
same entity, in any writing (upper case, other separators), gets the same surrogate in every document, and its
writing is kept: separators, case, length, script of each letter, the first digit of numbers, the Luhn check of cards
that pass it, octets of as many digits, domains reserved for examples and top-level domains.

Names: a title and one or two words. The words are entities of their own: a first name by the title's gender, and a family
name, each made from syllables of its script (Latin, Cyrillic; letters of other scripts are swapped for others), the
family name with the title's gender ending. So "Mrs. Olga Braun" and "Mrs. Braun" share a family name. Other mentions of a word
of a titled name in the same document, in the same writing, get its surrogate, too. Names that never stand behind a title
in a document are not looked for.

Collisions are checked over the whole corpus: a surrogate that equals any entity found, or that of another entity,
is made anew with the next attempt's hash until all differ: names with a further syllable for each attempt, others from ``LONGER``
attempts on with further characters, addresses with octets of any length. After ``ROUNDS`` attempts the job fails rather than leave a collision.
What is left of this is a table of the few entities with a later attempt: up to ``INLINE`` of them as a literal map,
more by a join on the entity.

The patterns run once over each text, those only whose mark it holds (an @, a digit, a title); rows are written with what
was found, and texts with entities are put together from there. Everything is built-in expressions.

The key is a parameter; the query takes it from the session's ``bytewright.surrogates.key``, where that is set.

Defined cases: null texts stay null and hold no entities; documents without
entities are returned as they are; repeated rows are treated alike; an empty table gives an empty result; other
columns are passed on by ``redact`` and ignored by the query; a text of any length is read whole; an address has at most
64 characters before its @, and of a domain at most 126 labels are read; 13 to 19 digits in a row are a card where they pass the Luhn check, 4 by 4 digits always.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewright.plans.columns import pick
from bytewright.plans.scratch import materialize
from bytewright.sources.tables import table

NAME = "op10_surrogates"
KEY, KEY_SETTING = "surrogate-key-1", "bytewright.surrogates.key"
INLINE, LONGER, ROUNDS = 500, 8, 64
_OCTET = "(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
_SECRET = "(?i:(?:api|access|secret)?[_-]?(?:key|token|secret|password|passwd|pwd))\\s?[=:]\\s?[\"']?"
_ISSUED = "AKIA(?=[0-9A-Z]{12})|(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|AIza)(?=[A-Za-z0-9_-]*\\d)(?=[A-Za-z0-9_-]{16})"
# Titles by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
OTHER = ("Dr", "Prof")
_TITLES = "|".join(sorted(MALE + FEMALE + OTHER, key=len, reverse=True))
#: Type and pattern, in order of precedence.
PATTERNS = {
    "secret": f"(?<![\\p{{L}}\\p{{N}}_])(?:{_SECRET}(?=[A-Za-z0-9+/_-]*\\d)[A-Za-z0-9+/_-]{{12,}}|(?:{_ISSUED})[A-Za-z0-9_-]+)",
    "email": "(?<![\\p{L}\\p{N}._%+-])[\\p{L}\\p{N}._%+-]{1,64}+@(?:[\\p{L}\\p{N}-]++\\.){1,126}\\p{L}{2,}",
    "iban": "(?<![\\p{L}\\p{N}])[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\\p{L}\\p{N}])",
    "card": "(?<![\\d+])(?:(?:\\d{4}[ -]?){3}\\d{4}|3\\d{3}[ -]?\\d{6}[ -]?\\d{5}|\\d{13,19})(?!\\d)",
    "ssn": "(?<![\\d-])\\d{3}-\\d{2}-\\d{4}(?![\\d-])",
    "ip": f"(?<![\\d.])(?:{_OCTET}\\.){{3}}{_OCTET}(?!\\d|\\.\\d)",
    "phone": "(?<![\\d+])(?:\\+\\d{1,3}[ .-]?)?(?:\\(\\d{2,4}\\)[ .-]?|\\d{3}[ .-])\\d{3}[ .-]?\\d{4}(?!\\d)|\\+\\d{1,3}(?:[ .-]?\\d{2,4}){3,5}(?!\\d)",
    "name": f"(?<!\\p{{L}})(?:{_TITLES})\\.? \\p{{Lu}}\\p{{L}}+(?: \\p{{Lu}}\\p{{L}}+)?",
}
ANY = "|".join(PATTERNS.values())
#: What a text must hold for patterns to fit: a digit, an @, a title.
_NEEDS = {"secret": "digit", "email": "at", "iban": "digit", "card": "digit", "ssn": "digit", "ip": "digit", "phone": "digit", "name": "title"}
# Syllables of names.
LATIN = {
    "stem": "mar jul kar vik ros el nat hel mir sil dor lor ben tam fran gret ver nor lid ad kon fel bruk hart wes gal dan rob tor vin sam her".split(),
    "mid": "an el in or et al is em ol ur en ar il ov ad er".split(),
    "f": "ina ella ia etta ena ora isa ana".split(), "m": "us ert an o in ard iel mund".split(), "family": "son berg mann ford ler ton ner well dal feld lin rup stad wick mar ers".split(),
}
CYRILLIC = {
    "stem": "мар юл кар вик роз ел нат хел мир сил дор лар бел там фед грет вер нор лид ад кон фил брук арт".split(),
    "mid": "ан ел ин ор ет ал ис ем ол ур ен ар ил ав ад ер".split(),
    "f": "ина елла ия ена ора иса ана уся".split(), "m": "ий ей ан он ин ард ил ир".split(), "family": "ов".split(),
}
#: Letters and digits that stand for each other, lower case.
ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyz",
    "0123456789",
    "àáâäåæçèéêëìíîïñòóôöøùúûüýß",
    "абвгдежзийклмнопрстуфхцчшщэюя",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "אבגדהוזחטיכלמנסעפצקרשת",
    "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "あいうえおかきくけこさしすせそたちつてとなにぬねの",
    "アイウエオカキクケコサシスセソタチツテトナニヌネノ",
    "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗",
    "김이박최정강조윤장임한오서신권황안송류홍",
)
_HEX = "0123456789abcdef"
_NAMES = ("given-f", "given-m", "family")
_EXAMPLE = "(?:^|\\.)(?:example\\.(?:com|net|org)|example|invalid|test)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _split(text: Column) -> Column:
    return F.when(F.char_length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _chars(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Each character (given with its 1-based position) put through ``body``."""
    return F.array_join(F.transform(_split(text), lambda c, i: body(c, i + 1)), "")


def _stripped(e: Column) -> Column:
    return F.regexp_replace(e, "[^\\p{L}\\p{N}]", "")


def type_of(e: Column) -> Column:
    """The type of what was found; null for digits that are no card."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(e.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return F.when((out == "card") & e.rlike("^\\d{13,19}$") & ~e.rlike("^\\d{16}$") & (_luhn(e) != 0), F.lit(None)).otherwise(out)


def _secret_head(e: Column) -> Column:
    return F.regexp_extract(e, f"^(?:{_SECRET}|{_ISSUED})", 0)


def norm_of(kind: Column, e: Column) -> Column:
    """What all writings of an entity have in common."""
    value = F.substring(e, F.char_length(_secret_head(e)) + 1, F.char_length(e))
    return F.when(kind == "secret", value).when(kind.isin("email", "ip", *_NAMES), F.lower(e)).otherwise(F.lower(_stripped(e)))


def _swap(c: Column, byte: Column, alphabets: Column) -> Column:
    """Another character of ``c``'s alphabet, in its case; what is in none stays. ``alphabets``: an array."""

    def of(a: Column) -> Column:
        new = F.substring(a, (byte % F.char_length(a) + 1).cast("int"), F.lit(1))
        return F.when(a.isNull(), c).when(c != F.lower(c), F.upper(new)).otherwise(new)

    return let(F.get(F.filter(alphabets, lambda a: F.instr(a, F.lower(c)) > 0), F.lit(0)), of)


def _luhn(digits: Column) -> Column:
    """Sum modulo 10 of the Luhn check, of digits whose last is the check digit."""
    n = F.char_length(digits)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (1 + (n - i) % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10


def _name(script: dict[str, list[str]], kind: Column, attempt: Column, byte: Callable[[Column], Column]) -> Column:
    """Syllables of a script: a stem, one more than ``attempt`` between, and an ending by kind."""
    of = lambda part, i: F.element_at(F.split(F.lit(" ".join(script[part])), " "), byte(i) % len(script[part]) + 1)
    between = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda k: of("mid", k + 4)), "")
    end = F.when(kind == "given-f", of("f", F.lit(2))).when(kind == "given-m", of("m", F.lit(2))).otherwise(of("family", F.lit(2)))
    return F.concat(of("stem", F.lit(1)), between, end)


def _hmac(key: str, message: Column) -> Column:
    """HMAC of SHA-512, as hexadecimal digits."""
    plain = key.encode()
    padded = (hashlib.sha512(plain).digest() if len(plain) > 128 else plain).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(x ^ c for x in padded)) for c in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 512))), 512)


def surrogate_of(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity, in the writing of ``norm``; of family names without the ending of a gender."""

    def made(stream: Column, bytes_: Column) -> Column:
        byte = lambda i: F.element_at(bytes_, ((i - 1) % 128 + 1).cast("int"))
        tail = F.substring(stream, 200, 12)
        host = F.substring_index(norm, "@", -1)
        kept = F.when(host.rlike(_EXAMPLE), host).otherwise(F.substring_index(host, ".", -1))  # of a domain
        # one text of which all characters are swapped: what is in no alphabet stays
        body = F.when(kind == "email", F.substring(norm, F.lit(1), F.char_length(norm) - F.char_length(kept))).when(kind.isin(*_NAMES) & (attempt >= 2), F.concat(norm, norm)).otherwise(norm)
        skip = F.when(kind.isin("card", "phone", "ssn"), 1).when(kind == "iban", 2).otherwise(0)
        hexadecimal = (kind == "secret") & F.lower(norm).rlike("^[0-9a-f]+$")
        alphabets = F.when(hexadecimal, F.lit(_HEX)).otherwise(F.lit(" ".join(ALPHABETS)))
        octets = F.transform(
            F.split(norm, "\\."),
            lambda o, i: F.when(attempt >= LONGER, byte(i + 1) % 255 + 1)
            .when(F.char_length(o) == 1, byte(i + 1) % 9 + 1)
            .when(F.char_length(o) == 2, byte(i + 1) % 90 + 10)
            .otherwise(byte(i + 1) % 156 + 100)
            .cast("string"),
        )

        def from_(s: Column) -> Column:
            email = F.when(attempt < LONGER, F.concat(s, kept)).otherwise(F.concat(F.substring_index(s, "@", 1), F.lit("."), tail, F.lit("@"), F.substring_index(s, "@", -1), kept))
            head = F.substring(s, F.lit(1), F.char_length(s) - 1)
            card = F.when(_luhn(norm) != 0, s).otherwise(F.concat(head, ((10 - _luhn(F.concat(head, F.lit("0")))) % 10).cast("string")))
            name = F.when(norm.rlike("^[а-яё]+$"), _name(CYRILLIC, kind, attempt, byte)).when(norm.rlike("^[a-zà-ÿ]+$"), _name(LATIN, kind, attempt, byte)).otherwise(s)
            whole = F.when(kind == "email", email).when(kind == "ip", F.array_join(octets, ".")).when(kind == "card", card).when(kind.isin(*_NAMES), name).otherwise(s)
            # a type without room for further characters inside gets them at its end
            more = F.when(kind.isin("secret", "iban"), tail).when(kind.isin("card", "phone", "ssn"), F.translate(tail, "abcdef", "012345")).otherwise("")
            return F.when(attempt >= LONGER, F.concat(whole, more)).otherwise(whole)

        return let(F.split(alphabets, " "), lambda all_: let(_chars(body, lambda c, i: F.when(i <= skip, c).otherwise(_swap(c, byte(i), all_))), from_))

    def of_stream(stream: Column) -> Column:
        bytes_ = F.transform(F.sequence(F.lit(1), F.lit(255), F.lit(2)), lambda i: F.conv(F.substring(stream, i, F.lit(2)), 16, 10).cast("int"))
        return let(bytes_, lambda b: made(stream, b))

    seed = F.concat_ws("|", kind, attempt.cast("string"), norm)
    stream = F.concat(_hmac(key, F.concat(seed, F.lit("|0"))), _hmac(key, F.concat(seed, F.lit("|1"))))
    return let(stream, of_stream)


def gender_of(e: Column) -> Column:
    title = F.regexp_extract(e, "^\\p{L}+", 0)
    return F.when(title.isin(*FEMALE), F.lit("f")).when(title.isin(*MALE), F.lit("m")).otherwise(F.lit(""))


def _with_gender(s: Column, kind: Column, gender: Column) -> Column:
    """A family name's surrogate with the ending of a woman's."""
    end = F.when(s.rlike("[а-яё]$"), F.lit("а")).when(s.rlike("[a-z]$"), F.lit("a")).otherwise(F.lit(""))
    return F.when((kind == "family") & (gender == "f"), F.concat(s, end)).otherwise(s)


def _written(kind: Column, e: Column, s: Column) -> Column:
    """Surrogate ``s`` in the writing of ``e``."""

    def like(c: Column, new: Column) -> Column:
        return F.when((c != F.lower(c)) & (new != ""), F.upper(new)).otherwise(new)

    same = let(_split(e), lambda old: _chars(s, lambda new, i: like(F.coalesce(F.get(old, i - 1), F.lit("")), new)))
    spread = F.concat(
        _chars(e, lambda c, i: F.when(c.rlike("[\\p{L}\\p{N}]"), like(c, F.substring(s, F.char_length(_stripped(F.substring(e, F.lit(1), i))), F.lit(1)))).otherwise(c)),
        F.substring(s, F.char_length(_stripped(e)) + 1, F.char_length(s)),
    )
    name = F.when((e == F.upper(e)) & (F.char_length(e) > 1), F.upper(s)).otherwise(F.initcap(s))
    return F.when(kind == "secret", F.concat(_secret_head(e), s)).when(kind.isin("email", "ip"), same).when(kind.isin(*_NAMES), name).otherwise(spread)


def _found(text: Column) -> Column:
    """What the patterns find, in turn. Only those are tried whose mark the text holds."""
    has = {"at": F.contains(text, F.lit("@")), "digit": text.rlike("[0-9]")}
    heads = [t for t in MALE + FEMALE + OTHER if not any(t != u and t.startswith(u) for u in MALE + FEMALE + OTHER)]
    has["title"] = reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in heads))
    none = F.array().cast("array<string>")
    out = none
    for marks in itertools.product((False, True), repeat=len(has)):
        held = {k for k, on in zip(has, marks, strict=True) if on}
        if held:
            fits = reduce(lambda a, b: a & b, (has[k] for k in held))
            out = F.when(fits, F.regexp_extract_all(text, F.lit("|".join(p for k, p in PATTERNS.items() if _NEEDS[k] in held)), F.lit(0))).otherwise(out)
    return F.coalesce(out, none)


def _words(found: Column) -> Column:
    """The words of titled names, each once: (word, rank, kind, gender), two-word names' roles first."""

    def of(e: Column) -> Column:
        words, g = F.split(F.regexp_replace(e, "^\\p{L}+\\.? ", ""), " "), gender_of(e)
        word = lambda w, rank, kind: F.struct(w.alias("word"), F.lit(rank).alias("rank"), kind.alias("kind"), g.alias("gender"))
        first = words[0]
        given = F.when((g == "f") | ((g == "") & F.lower(first).rlike("[aаяe]$")), F.lit("given-f")).otherwise(F.lit("given-m"))
        return F.when(F.size(words) == 2, F.array(word(first, 0, given), word(F.get(words, F.lit(1)), 0, F.lit("family")))).otherwise(F.array(word(first, 1, F.lit("family"))))

    names = F.filter(found, lambda e: e.rlike(f"^(?:{_TITLES})\\.? \\p{{Lu}}"))
    ranked = F.array_sort(F.flatten(F.transform(names, of)))
    return let(ranked, lambda a: F.filter(a, lambda x, i: (i == 0) | (x["word"] != F.get(a, i - 1)["word"])))


def _entities(found: Column) -> Column:
    """(kind, norm) of all that was found; names by their words."""
    typed = F.transform(found, lambda e: let(type_of(e), lambda k: F.struct(k.alias("kind"), norm_of(k, e).alias("norm"))))
    plain = F.filter(typed, lambda x: x["kind"].isNotNull() & (x["kind"] != "name"))
    return F.concat(plain, F.transform(_words(found), lambda w: F.struct(w["kind"].alias("kind"), F.lower(w["word"]).alias("norm"))))


def _tag(kind: Column, norm: Column) -> Column:
    return F.concat_ws("|", kind, norm)


def later_attempts(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(tag, attempt) of the entities (kind, norm) whose first surrogates collide."""
    all_ = materialize(entities.distinct(), "pii-entities")
    space = F.when(F.col("kind").isin(*_NAMES), F.lit("name")).otherwise(F.col("kind"))
    state = all_.withColumn("attempt", F.lit(0))
    taken = all_.select(space.alias("space"), F.lower("norm").alias("value")).distinct()
    for _ in range(ROUNDS):
        made = state.withColumn("base", surrogate_of(F.col("kind"), F.col("norm"), F.col("attempt"), key))
        values = F.array_distinct(F.array(F.col("base"), _with_gender(F.col("base"), F.col("kind"), F.lit("f"))))
        made = materialize(made.select("kind", "norm", "attempt", space.alias("space"), F.explode(F.transform(values, lambda v: F.lower(v))).alias("value")), "pii-made")
        # of the entities with one value, that of the least attempt and norm keeps it, unless it is an entity itself
        first = made.groupBy("space", "value").agg(F.min(F.struct("attempt", "kind", "norm")).alias("first"), F.count(F.lit(1)).alias("n"))
        used = first.join(taken, ["space", "value"], "left_semi").select("space", "value").withColumn("used", F.lit(True))
        bad = first.where("n > 1").join(used, ["space", "value"], "full")
        bad = materialize(bad.select("space", "value", "first", F.coalesce("used", F.lit(False)).alias("used")), "pii-values")
        if not bad.take(1):
            break
        again = made.join(bad, ["space", "value"]).where("used or first is null or not (first.kind = kind and first.norm = norm)").select("kind", "norm").distinct().withColumn("again", F.lit(1))
        state = materialize(state.join(again, ["kind", "norm"], "left").select("kind", "norm", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), "pii-attempts")
    else:
        raise RuntimeError(f"surrogates still collide after {ROUNDS} attempts: a format has too few values")
    return state.where("attempt > 0").select(_tag(F.col("kind"), F.col("norm")).alias("tag"), "attempt")


def redact(docs: DataFrame, key: str = KEY, inline: int = INLINE) -> DataFrame:
    """``docs`` with ``text`` replaced, and ``n_entities``."""
    names = docs.columns
    plain = [f"_{i}" for i in range(len(names))]
    text = F.col(plain[names.index("text")])
    held = materialize(docs.toDF(*plain).withColumn("_found", _found(text)).withColumn("_row", F.monotonically_increasing_id()), "pii-found")
    late = later_attempts(held.where(F.size("_found") > 0).select(F.explode(_entities(F.array_distinct("_found"))).alias("x")).select("x.*"), key)
    few = late.take(inline + 1)
    if len(few) > inline:
        tags = held.where(F.size("_found") > 0).select("_row", F.explode(_entities(F.array_distinct("_found"))).alias("x")).select("_row", _tag(F.col("x.kind"), F.col("x.norm")).alias("tag")).join(late, "tag").distinct()
        maps = tags.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("tag", "attempt"))).alias("_late"))
        held = held.join(maps, "_row", "left")
    elif few:
        held = held.withColumn("_late", F.create_map(*(F.lit(x) for row in few for x in row)))
    else:
        held = held.withColumn("_late", F.lit(None).cast("map<string,int>"))

    def made(x: Column) -> Column:
        tag = _tag(x["kind"], x["norm"])
        attempt = F.coalesce(F.try_element_at(F.col("_late"), tag), F.lit(0))
        return let(attempt, lambda a: surrogate_of(x["kind"], x["norm"], a, key))

    def of_word(w: Column, known: Column) -> Column:
        kind, word = w["kind"], w["word"]
        new = let(F.try_element_at(known, _tag(kind, F.lower(word))), lambda s: _written(kind, word, _with_gender(s, kind, w["gender"])))
        return F.struct(word.alias("word"), new.alias("made"))

    def rewritten(part: Column, words: Column) -> Column:
        """A piece of text with the words of titled names replaced."""
        pieces = F.transform(F.regexp_extract_all(part, F.lit("\\p{L}+|[^\\p{L}]+"), F.lit(0)), lambda t: F.coalesce(F.try_element_at(words, t), t))
        return F.when(F.size(words) > 0, F.array_join(pieces, "")).otherwise(part)

    def replaced(e: Column, words: Column, known: Column) -> Column:
        def of(kind: Column) -> Column:
            title = F.regexp_extract(e, "^\\p{L}+\\.? ", 0)
            name = F.concat(title, rewritten(F.substring(e, F.char_length(title) + 1, F.char_length(e)), words))
            other = let(norm_of(kind, e), lambda n: let(F.try_element_at(known, _tag(kind, n)), lambda s: _written(kind, e, s)))
            return F.when(kind.isNull(), e).when(kind == "name", name).otherwise(other)

        return let(type_of(e), of)

    each = F.array_distinct("_found")  # a text may repeat an entity very often

    def joined(words: Column, known: Column) -> Column:
        new = F.map_from_arrays(each, F.transform(each, lambda e: replaced(e, words, known)))
        return let(new, lambda new: F.array_join(F.transform(F.split(text, ANY, -1), lambda part, i: F.concat(rewritten(part, words), F.coalesce(F.try_element_at(new, F.get(F.col("_found"), i)), F.lit("")))), ""))

    def of_entities(all_: Column) -> Column:
        known = F.map_from_arrays(F.transform(all_, lambda x: _tag(x["kind"], x["norm"])), F.transform(all_, made))
        return let(known, lambda known: let(F.map_from_entries(F.transform(_words(each), lambda w: of_word(w, known))), lambda words: joined(words, known)))

    whole = F.when(F.size("_found") > 0, let(F.array_distinct(_entities(each)), of_entities)).otherwise(text)
    count = F.size(F.filter(F.col("_found"), lambda e: type_of(e).isNotNull())).cast("long")
    return held.select(*(whole if c == plain[names.index("text")] else F.col(c) for c in plain), count).toDF(*names, "n_entities")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_entities, and its text with surrogates."""
    key = spark.conf.get(KEY_SETTING, KEY)
    return redact(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), key).select("doc_id", "n_entities", "text")
