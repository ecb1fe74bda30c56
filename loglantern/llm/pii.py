"""Personal data replaced by surrogates, with DataFrame functions alone.

Mentions are found by patterns and reduced to entities: the same number written in two ways, or a name after two titles,
is one entity. Each different entity gets a surrogate from a keyed digest: of the same type, length, case, separators and
script, for names of the same gender. Surrogates are checked against each other and against all entities of the table;
those that collide are made anew until none does, or are permuted where a shape has no values left. So different entities stay different, and one entity has one
surrogate in all texts. A name that a text has after a title goes wherever else the text has it as a whole word with a
capital, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loglantern.llm.frames import plainly, written

KEY = "surrogates"
# Tries after which entities of a shape with too few values are permuted.
ATTEMPTS = 6

# What is found, in order of preference where two begin at one place. Fixed patterns (Java syntax).
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "card": r"(?<![\w.+-])(?:(?:[3-6]\d{3}|2(?:22[1-9]|2[3-9]\d|[3-6]\d{2}|7[01]\d|720))(?<a>[ -]?)\d{4}\k<a>\d{4}\k<a>\d{4}|3[47]\d{2}(?<b>[ -]?)\d{6}\k<b>\d{5})(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}(?:[ .-]?\(\d{2,4}\))?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}(?<c>[ .-])\d{3}\k<c>\d{4})(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "key": r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)",
    "secret": r"(?<!\w)(?i:password|passwd|secret|token|api_key|apikey)[ ]?[=:][ ]?[\x22']?[A-Za-z0-9+/_-]{8,}",
    "name": (
        r"(?<![\p{L}\p{N}_])(?:(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Srta)\.|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|господин|госпожа|Господин|Госпожа"
        r"|κύριος|κυρία|Κύριος|Κυρία) \p{Lu}[\p{L}]{1,30}(?: \p{Lu}[\p{L}]{1,30})?(?![\p{L}\p{N}_])"
    ),
}
_MALE = r"^(?:Mr|Sr|Herr|Monsieur|Señor|[гГ]осподин|[κΚ]ύριος)(?![\p{L}])"
_FEMALE = r"^(?:Mrs|Ms|Sra|Srta|Frau|Mme|Mlle|Madame|Señora|[гГ]оспожа|[κΚ]υρία)(?![\p{L}])"
_SECRET = r"^([A-Za-z_]+[ ]?[=:][ ]?[\x22']?)(.*)$"
_NAME = r"^(\S+ )(\S+)(?: (\S+))?$"
_WORD_EDGE = r"(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])"

# What surrogate names are made of, by script, and how those of women and men end. Fixed values.
_SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ka ke ki la le li lo ma me mi mo na ne ni no ra re ri ro sa se si ta te ti va ve vi".split(),
    "cyrillic": "ба бе би бо да де ди до га ге ка ке ки ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си та те ти ва ве ви".split(),
    "greek": "βα βε βι βο δα δε δι δο γα γε κα κε κι λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι τα τε τι".split(),
}
_ENDINGS = {
    "latin": {"f": "na", "m": "rt", "n": "l"},
    "cyrillic": {"f": "на", "m": "рт", "n": "л"},
    "greek": {"f": "να", "m": "ρος", "n": "ς"},
}
_DIGITS = ("card", "ssn", "phone")
# Group numbers would shift as patterns are joined, so groups that are referred to get names. No mention begins inside a
# word of Latin letters or digits: said once, ahead of all patterns, this passes over most places of a text.
ANY = f"(?<![A-Za-z0-9])(?:{'|'.join(PATTERNS.values())})"


def _single(kind: str) -> str:
    """What a mention of the kind matches as a whole."""
    return f"^(?:{PATTERNS[kind]})$"


# Each mention holds a digit, an @ or one of these; so most texts are told clean without the patterns.
_MARKS = (
    "AKIA Mr. Mrs. Ms. Dr. Prof. Sr. Sra. Srta. Herr Frau Mme Mlle Monsieur Madame Señor Señora"
    " осподин оспожа ύριος υρία"
).split()
# These count in any case.
_SECRET_MARKS = "password passwd secret token api_key apikey".split()


def _has_mention() -> Column:
    secret = [F.lower("text").contains(mark) for mark in _SECRET_MARKS]
    marked = reduce(lambda a, b: a | b, [*[F.col("text").contains(mark) for mark in _MARKS], *secret], F.col("text").rlike("[0-9@]"))
    return F.coalesce(marked & F.col("text").rlike(ANY), F.lit(False))


def _kind(mention: Column) -> Column:
    tests = [(kind, mention.rlike(_single(kind))) for kind in PATTERNS]
    return F.coalesce(*[F.when(test, F.lit(kind)) for kind, test in tests])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _part(kind: Column | str, norm: Column, shown: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), norm.alias("norm"), shown.alias("shown"))


def mentions(docs: DataFrame) -> DataFrame:
    """``_text`` (digest of the text), ``_at``, ``_mention``: each once for equal texts."""
    found = docs.filter(_has_mention()).select(
        F.md5(F.col("text").cast("binary")).alias("_text"), F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("_at", "_mention")
    )
    # Copies of a text meet as partial groups.
    return found.groupBy("_text", "_at").agg(F.first("_mention").alias("_mention"))


def parts(found: DataFrame) -> DataFrame:
    """Mentions cut into entities and what stays between them: ``kind``, ``norm`` and ``shown`` by ``_place``.

    What stays has a null kind. A name is its title, a given name if there are two words, and a surname.
    """
    m = F.col("_mention")
    title, one, two = (F.regexp_extract(m, _NAME, i) for i in (1, 2, 3))
    gender = F.when(title.rlike(_MALE), "m").when(title.rlike(_FEMALE), "f").otherwise("n")
    given = F.concat_ws(":", F.lit("given"), gender, _script(m))
    surname = F.concat_ws(":", F.lit("surname"), F.lit("n"), _script(m))
    stays = F.lit(None).cast("string")
    name = F.when(
        two != "",
        F.array(_part(stays, stays, title), _part(given, F.lower(one), one), _part(stays, stays, F.lit(" ")), _part(surname, F.lower(two), two)),
    ).otherwise(F.array(_part(stays, stays, title), _part(surname, F.lower(one), one)))
    value = F.regexp_extract(m, _SECRET, 2)
    secret = F.array(_part(stays, stays, F.regexp_extract(m, _SECRET, 1)), _part("secret", value, value))
    # The country code of a number stays, and numbers are one with and without it.
    national = F.regexp_replace(_digits(m), r"^1(?=\d{10}$)", "")
    norm = (
        F.when(F.col("_kind") == "email", F.lower(m))
        .when(F.col("_kind") == "phone", national)
        .when(F.col("_kind").isin(*_DIGITS), _digits(m))
        .when(F.col("_kind") == "iban", F.replace(m, F.lit(" "), F.lit("")))
        .otherwise(m)
    )
    listed = F.when(F.col("_kind") == "name", name).when(F.col("_kind") == "secret", secret).otherwise(F.array(_part(F.col("_kind"), norm, m)))
    kinds = found.withColumn("_kind", _kind(m))
    return kinds.select("_text", "_at", F.posexplode(listed).alias("_place", "_part")).select("_text", "_at", "_place", "_part.*")


def _number(i: Column, modulus: int, of: str = "_stream") -> Column:
    """The number below ``modulus`` at place ``i`` of the keyed stream."""
    at = F.pmod(i.cast("int"), F.lit(64)) * 4 + 1
    return F.pmod(F.conv(F.substring(F.col(of), at, F.lit(4)), 16, 10).cast("int"), F.lit(modulus))


def _letter(base: str, number: Column) -> Column:
    return F.substring(F.lit(base), number + 1, F.lit(1))


def _scrambled(text: Column, keep: Column, low: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Letters and digits beyond the first ``keep`` characters replaced by others of their class."""
    high, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(i < keep, c)
            .when(c.rlike("[a-z]"), _letter(low, _number(i, len(low))))
            .when(c.rlike("[A-Z]"), _letter(high, _number(i, 26)))
            .when(c.rlike("[0-9]"), _letter(digit, _number(i, 10)))
            .otherwise(c)
        )

    return F.concat_ws("", F.transform(F.split(text, ""), one))


def _luhn(digits: Column) -> Column:
    """Sum of the check of card numbers, modulo 10."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + F.when(x > 9, x - 9).otherwise(x)) % 10


def _card(norm: Column) -> Column:
    """The first digit stays, and the range of those with a 2; the check digit is right if and only if it was."""
    body = F.substring(_scrambled(norm, F.lit(1)), F.lit(1), F.length(norm) - 1)
    second = F.concat(F.lit("2"), (3 + _number(F.lit(62), 4)).cast("string"), F.substring(body, 3, 16))
    body = F.when(norm.startswith("2"), second).otherwise(body)
    right = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    wrong = F.pmod(right + 1 + _number(F.lit(63), 9), F.lit(10))
    return F.concat(body, F.when(_luhn(norm) == 0, right).otherwise(wrong).cast("string"))


def _ip(norm: Column) -> Column:
    """Numbers of as many digits."""

    def one(part: Column, i: Column) -> Column:
        size = F.length(part)
        return F.when(size == 1, _number(i, 10)).when(size == 2, 10 + _number(i, 90)).otherwise(100 + _number(i, 156)).cast("string")

    return F.concat_ws(".", F.transform(F.split(norm, r"\."), one))


def _email(norm: Column) -> Column:
    """Another local part and host of the same form below the same last label."""
    cut = F.regexp_extract(norm, r"^(.*)(\.[a-z]+)$", 1)
    return F.concat(_scrambled(cut, F.lit(0)), F.regexp_extract(norm, r"(\.[a-z]+)$", 1))


def _name(kind: Column) -> Column:
    """Syllables of the script, and the ending of the gender."""
    gender, script = F.split_part(kind, F.lit(":"), F.lit(2)), F.split_part(kind, F.lit(":"), F.lit(3))
    count = 2 + F.least(F.col("_attempt"), F.lit(20))

    def made(name: str) -> Column:
        syllables = F.array(*[F.lit(s) for s in _SYLLABLES[name]])
        body = F.transform(F.sequence(F.lit(0), count), lambda i: F.element_at(syllables, _number(i, len(_SYLLABLES[name])) + 1))
        ending = reduce(lambda c, g: c.when(gender == g, _ENDINGS[name][g]), "fmn", F)
        return F.concat(F.concat_ws("", body), ending)

    return reduce(lambda c, name: c.when(script == name, made(name)), _SYLLABLES, F)


def _made(entities: DataFrame, key: str) -> DataFrame:
    """``_surrogate`` of each entity at its ``_attempt``."""
    seed = F.concat_ws("\x1f", F.lit(key), "kind", "norm", F.col("_attempt").cast("string"))
    stream = F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(4)])
    kind, norm = F.col("kind"), F.col("norm")
    surrogate = (
        F.when(kind == "email", _email(norm))
        .when(kind == "ip", _ip(norm))
        .when(kind == "card", _card(norm))
        .when(kind.isin("key", "iban"), _scrambled(norm, F.lit(4)))
        .when((kind == "secret") & norm.rlike("^[0-9a-f]+$"), _scrambled(norm, F.lit(0), "abcdef"))
        .when(kind.isin("phone", "ssn", "secret"), _scrambled(norm, F.lit(0)))
        .otherwise(_name(kind))
    )
    return entities.withColumn("_stream", stream).withColumn("_surrogate", surrogate).drop("_stream")


def _shape(kind: Column, norm: Column) -> Column:
    """What all surrogates of an entity have in common with it: type, classes of characters, and what stays."""
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(norm, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    stays = (
        F.when(kind == "email", F.regexp_extract(norm, r"(\.[a-z]+)$", 1))
        .when(kind.isin("key", "iban"), F.substring(norm, 1, 4))
        .when(kind == "card", F.concat(F.substring(norm, F.lit(1), F.when(norm.startswith("2"), 2).otherwise(1)), (_luhn(norm) == 0).cast("string")))
        .otherwise("")
    )
    return F.concat_ws("\x1f", kind, classes, stays)


def _permuted(kind: Column, norm: Column, shape: Column, key: str) -> Column:
    """Another value of the same shape; no two of a shape have the same.

    Each character is shifted within its class by a keyed digest of what stands before it in the entity, so the
    characters can be told back one by one from the left: different entities have different values.
    """

    def shift(before: Column, modulus: int) -> Column:
        digest = F.sha2(F.concat_ws("\x1f", F.lit(key), shape, before), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(modulus)).cast("int")

    def shifted(text: Column, keep: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            out = F.when(i < keep, c)
            for class_, low, n in (("[0-9]", 48, 10), ("[a-z]", 97, 26), ("[A-Z]", 65, 26)):
                out = out.when(c.rlike(class_), F.char(low + F.pmod(F.ascii(c) - low + shift(F.substring(text, F.lit(1), i), n), F.lit(n))))
            return out.otherwise(c)

        return F.concat_ws("", F.transform(F.split(text, ""), one))

    def number(part: Column, i: Column) -> Column:
        before = F.concat_ws(".", F.slice(F.split(norm, r"\."), F.lit(1), i))
        size, x = F.length(part), part.cast("int")
        ranges = F.when(size == 1, F.pmod(x + shift(before, 10), F.lit(10))).when(size == 2, 10 + F.pmod(x - 10 + shift(before, 90), F.lit(90)))
        return ranges.otherwise(100 + F.pmod(x - 100 + shift(before, 156), F.lit(156))).cast("string")

    cut = F.regexp_extract(norm, r"^(.*)(\.[a-z]+)$", 1)
    body = F.substring(norm, F.lit(1), F.length(norm) - 1)
    new = shifted(body, F.when(norm.startswith("2"), 2).otherwise(1))
    # The check digit is as far from the right one as it was.
    check = F.pmod(F.substring(norm, -1, 1).cast("int") + _luhn(F.concat(body, F.lit("0"))) - _luhn(F.concat(new, F.lit("0"))), F.lit(10))
    return (
        F.when(kind == "ip", F.concat_ws(".", F.transform(F.split(norm, r"\."), number)))
        .when(kind == "email", F.concat(shifted(cut, F.lit(0)), F.regexp_extract(norm, r"(\.[a-z]+)$", 1)))
        .when(kind == "card", F.concat(new, check.cast("string")))
        .otherwise(shifted(norm, F.when(kind.isin("key", "iban"), 4).otherwise(0)))
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind``, ``norm`` and ``_surrogate`` of each different entity; no two of a type are alike.

    A surrogate that is taken, or is an entity itself, is made anew; of those with the same one the entity that tried less
    often, then the least, has it. Names get longer from try to try, so that rounds end. All others keep their shape, which
    has a fixed number of values: after ``ATTEMPTS`` tries all entities of the shape are permuted by the key instead. Those
    differ from each other by construction, but may be entities of the table, as there aren't enough other values.
    """
    type_ = F.split_part(F.col("kind"), F.lit(":"), F.lit(1))
    state = written(_made(entities.select("kind", "norm").distinct().withColumn("_attempt", F.lit(0)), key), "surrogates")
    known = state.select(type_.alias("_t"), F.col("norm").alias("_s")).distinct()
    permuted = None
    while True:
        named = state.withColumn("_type", type_)
        winners = named.groupBy("_type", F.lower("_surrogate").alias("_s")).agg(
            F.min(F.struct("_attempt", "kind", "norm")).alias("_first"), F.count("*").alias("_n")
        )
        lost = named.join(winners.filter("_n > 1").withColumnRenamed("_type", "_w"), (F.col("_type") == F.col("_w")) & (F.lower("_surrogate") == F.col("_s")))
        lost = lost.filter((F.col("kind") != F.col("_first.kind")) | (F.col("norm") != F.col("_first.norm"))).select("kind", "norm")
        real = named.join(known, (F.col("_type") == F.col("_t")) & (F.lower("_surrogate") == F.lower("_s")), "left_semi").select("kind", "norm")
        again = written(lost.union(real).distinct().select(F.col("kind").alias("_k"), F.col("norm").alias("_m")), "again")
        if again.isEmpty():
            done = state.select("kind", "norm", "_surrogate")
            return done if permuted is None else done.unionByName(permuted)
        marked = state.join(again, (F.col("kind") == F.col("_k")) & (F.col("norm") == F.col("_m")), "left")
        attempt = F.col("_attempt") + F.col("_k").isNotNull().cast("int")
        state = marked.select("kind", "norm", attempt.alias("_attempt"))
        spent = (F.col("_attempt") >= ATTEMPTS) & ~F.col("kind").contains(":")
        state = written(state.withColumn("_shape", F.when(~F.col("kind").contains(":"), _shape(F.col("kind"), F.col("norm")))).withColumn("_spent", spent), "tried")
        used_up = state.filter("_spent").select(F.col("_shape").alias("_u")).distinct()
        if not used_up.isEmpty():
            state = written(state.join(used_up, F.col("_shape") == F.col("_u"), "left"), "shaped")
            settled = state.filter(F.col("_u").isNotNull())
            settled = written(settled.select("kind", "norm", _permuted(F.col("kind"), F.col("norm"), F.col("_shape"), key).alias("_surrogate")), "permuted")
            permuted = settled if permuted is None else permuted.unionByName(settled)
            state = state.filter(F.col("_u").isNull())
        state = written(_made(state.select("kind", "norm", "_attempt"), key), "surrogates")


def _cased(shown: Column, surrogate: Column) -> Column:
    """A surrogate name in capitals if the name was, else with the first one."""
    return F.when((F.upper(shown) == shown) & (F.length(shown) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))


def _rendered(kind: Column, shown: Column, surrogate: Column) -> Column:
    """The surrogate as the mention was written: its separators, its case, its country code."""

    def digit(c: Column, i: Column) -> Column:
        after = F.length(_digits(F.substring(shown, i + 2, F.length(shown))))
        place = F.length(surrogate) - after
        return F.when(c.rlike("[0-9]") & (place > 0), F.substring(surrogate, place, F.lit(1))).otherwise(c)

    def cased(c: Column, i: Column) -> Column:
        return F.when(F.substring(shown, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)

    letters = F.split(surrogate, "")
    name = _cased(shown, surrogate)
    spaced = F.concat_ws(
        "",
        F.transform(
            F.split(shown, ""),
            lambda c, i: F.when(c == " ", c).otherwise(F.substring(surrogate, F.length(F.replace(F.substring(shown, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1))),
        ),
    )
    return (
        F.when(kind.isin(*_DIGITS), F.concat_ws("", F.transform(F.split(shown, ""), digit)))
        .when(kind == "email", F.concat_ws("", F.transform(letters, cased)))
        .when(kind == "iban", spaced)
        .when(kind.contains(":"), name)
        .otherwise(surrogate)
    )


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in its text, and ``n_entities``, the mentions that were replaced.

    Null texts stay null, empty ones and texts without mentions stay as they are, with 0 mentions; all other columns and
    repeated rows are kept. ``key`` decides all surrogates; another key gives others. A column ``n_entities`` that ``docs``
    already has is replaced.
    """
    docs = docs.drop("n_entities")
    original = docs.columns
    docs = plainly(docs, "text")
    names = docs.columns
    found = written(parts(mentions(docs)), "mentions")
    made = surrogates(found.filter(F.col("kind").isNotNull()), key).select(F.col("kind").alias("_k"), F.col("norm").alias("_m"), "_surrogate")
    replaced = found.join(made, (F.col("kind") == F.col("_k")) & (F.col("norm") == F.col("_m")), "left")
    shown = F.when(F.col("kind").isNull(), F.col("shown")).otherwise(_rendered(F.col("kind"), F.col("shown"), F.col("_surrogate")))
    named = F.when(F.col("kind").contains(":"), F.struct("norm", "_surrogate"))
    pieces = replaced.select("_text", "_at", "_place", shown.alias("_new"), named.alias("_named"))
    placed = F.sort_array(F.collect_list(F.struct("_place", "_new", "_named")))
    mended = pieces.groupBy("_text", "_at").agg(placed.alias("_placed"))
    mended = mended.select("_text", "_at", F.concat_ws("", F.transform("_placed", lambda p: p["_new"])).alias("_new"), F.transform("_placed", lambda p: p["_named"]).alias("_named"))
    # Mentions are numbered from 0, so that a mention's place in the list is its number.
    ordered = F.sort_array(F.collect_list(F.struct("_at", "_new", "_named")))
    whole = mended.groupBy("_text").agg(ordered.alias("_ordered"))
    # The names of a text, each with the surrogate of its first mention.
    names_ = F.filter(F.flatten(F.transform("_ordered", lambda p: p["_named"])), lambda n: n.isNotNull())
    whole = whole.select("_text", F.transform("_ordered", lambda p: p["_new"]).alias("_all"), names_.alias("_found"))
    keys = F.array_distinct(F.transform("_found", lambda n: n["norm"]))
    first = F.transform(keys, lambda k: F.element_at(F.transform("_found", lambda n: n["_surrogate"]), F.array_position(F.transform("_found", lambda n: n["norm"]), k).cast("int")))
    whole = whole.select("_text", "_all", F.map_from_arrays(keys, first).alias("_names"))
    # Texts without mentions aren't shuffled.
    has = _has_mention()
    keep = [F.col(f"`{c}`") for c in names]
    others = docs.filter(~has).select(*keep, F.lit(0).cast("long").alias("n_entities"))
    keyed = docs.filter(has).withColumn("_digest", F.md5(F.col("text").cast("binary"))).join(whole, F.col("_digest") == F.col("_text"))
    # Between mentions, words that are a name of the same text go too.
    keyed = keyed.withColumn("_gaps", F.split("text", ANY, -1))
    any_name = F.size("_names") > 0
    words = F.transform("_gaps", lambda gap: F.split(gap, _WORD_EDGE, -1))

    def known(word: Column) -> Column:
        return F.when(word.rlike(r"^\p{Lu}"), F.element_at("_names", F.lower(word)))

    def renamed(word: Column) -> Column:
        new = known(word)
        return F.when(new.isNull(), word).otherwise(_cased(word, new))

    keyed = keyed.withColumn("_words", F.when(any_name, words))
    again = F.aggregate("_words", F.lit(0), lambda n, gap: n + F.size(F.filter(gap, lambda w: known(w).isNotNull())))
    gaps = F.when(any_name, F.transform("_words", lambda gap: F.concat_ws("", F.transform(gap, renamed)))).otherwise(F.col("_gaps"))
    count = F.size("_gaps") - 1 + F.coalesce(again, F.lit(0))
    text = F.concat_ws("", F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.get("_all", i), F.lit("")))))
    done = keyed.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names], count.cast("long").alias("n_entities"))
    return others.union(done).toDF(*original, "n_entities")
