"""Surrogates for personal data, by DataFrame functions only.

Mail addresses, telephone numbers, IPv4 addresses, payment cards (13 to 19 digits with a right check
digit), US social security numbers, IBANs (with right check digits) and personal names are found in whole
texts. A name is what follows a title, a listed given name with the capitalised word behind it, or two
capitalised words behind a label such as `Name:`. Each distinct entity gets a keyed surrogate of its
type: digits for digits in the same layout (a telephone number keeps its country code), letters of the
same script, a given name of the same gender, the same letter case, right check digits where the
original has them.

Coreference: all mentions of an entity, however written, get the same surrogate. A name is its given name
and its surname: each has one surrogate in the whole corpus, so `John Smith`, `Mr. Smith` and `Anna Smith`
stay as related as they are, and in a text with a name its surname is found where it stands alone, too.
Two entities never share a surrogate, and no surrogate is a real entity (given names excepted: what is
given to one may be borne by another, the surname tells them apart): colliding candidates are drawn again.
Where a space is so crowded that forty draws leave some open, those take each other's values.

Defined results: a null text stays null, an empty one empty; a text without entities is returned as
it is. Repeated rows come back repeated; other columns pass through, whatever their names, but for
`n_entities`, which is replaced. Where two patterns match at one place the first listed wins; matches don't overlap.
"""

from __future__ import annotations

from functools import reduce
from secrets import token_hex

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The session setting that holds the key of the surrogates; set it where reruns are to agree.
KEY = "spark.millrace.pii.key"
# Titles and given names by gender, syllables for surnames, by script.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Madame", "Mme", "Mlle", "Frau", "Señora", "Sra", "Srta", "Госпожа"], "m": ["Mr", "Monsieur", "Herr", "Señor", "Sr", "Господин"], "n": ["Dr", "Prof"]}
GIVEN = {
    ("f", "latin"): [
        "Alice", "Anna", "Barbara", "Carmen", "Claire", "Elena", "Emma", "Eva", "Hannah", "Helen", "Ines", "Isabel", "Jane", "Julia", "Karen", "Laura", "Linda", "Lucia", "Maria", "Marie",
        "Martha", "Mary", "Nancy", "Petra", "Rosa", "Ruth", "Sarah", "Sofia", "Susan", "Ursula", "Olga", "Priya", "Fatima", "Aisha", "Yuki", "Mei", "Ingrid", "Chiara", "Leila", "Amina",
    ],
    ("m", "latin"): [
        "Adam", "Albert", "Alan", "Antonio", "Bernard", "Carlos", "Charles", "Daniel", "David", "Eric", "Felix", "Frank", "George", "Hans", "Henry", "Hugo", "Ivan", "Jack", "James", "John",
        "Jorge", "Karl", "Louis", "Luis", "Mark", "Michael", "Paul", "Peter", "Robert", "Thomas", "Wei", "Ahmed", "Mohammed", "Hiroshi", "Raj", "Sanjay", "Lars", "Giovanni", "Pavel", "Omar",
    ],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Татьяна"],
    ("m", "cyrillic"): ["Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Николай", "Олег", "Павел", "Сергей"],
}
SYLLABLES = {"latin": ["bar", "ber", "cor", "dal", "den", "fal", "gar", "hol", "jar", "kel", "lan", "mar", "nor", "pel", "ros", "sal"], "cyrillic": ["бар", "вел", "гор", "дан", "жел", "зор", "кал", "лев", "мар", "нов", "пол", "рад", "сол", "тор", "фед", "хол"]}
LABELS = ["Name", "Full name", "Contact", "Patient", "Employee", "Customer", "Attn", "Author", "Signed", "Имя", "Nombre", "Nom"]
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

_WORD = r"\p{Lu}\p{Ll}+(?:[-']\p{Lu}\p{Ll}+)?"
_TITLES = "|".join(t for kind in TITLES.values() for t in kind)
_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
#: Kinds in order of precedence. Every pattern starts behind a boundary, so no place is scanned twice.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}](?:[\p{L}\p{N}.-]*[\p{L}\p{N}])?\.\p{L}{2,}+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv4": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+(.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|\+\d{8,15})(?![\p{L}\p{N}]|-\d)",
    "card": r"(?<![\p{L}\p{N}-])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:(?:{_TITLES})\.? {_WORD}(?: {_WORD})?|(?:{_GIVEN}) {_WORD}|(?<=\b(?:{'|'.join(LABELS)}): ){_WORD} {_WORD})(?!\p{{L}})",
}
ANY = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(PATTERNS.values())})"
#: In texts with a name every capitalised word may be its surname.
WIDE = rf"{ANY}|(?<![\p{{L}}\p{{N}}]){_WORD}(?!\p{{L}})"


def _kind(value: Column) -> Column:
    chain = F.when(value.rlike(f"^(?:{_WORD})$"), "word")
    chain = reduce(lambda made, kind: made.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind), [k for k in PATTERNS if k not in ("phone", "name")], chain)
    # a label stands before the matched value, so names are told by their letters
    return chain.when(value.rlike(rf"^\p{{Lu}}[\p{{L}}.]+ "), "name").otherwise("phone")


def _luhn(digits: Column) -> Column:
    """Sum of a digit string's check digits, modulo 10."""
    chars = F.split(F.reverse(digits), "")
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, rf"^(?:{_TITLES})\.? ", "")


def _canonical(kind: Column, value: Column) -> Column:
    """What all ways of writing one entity share; of a name, its surname."""
    plus = F.when(value.startswith("+"), F.concat(F.lit("+"), _digits(value))).otherwise(_digits(value))
    surname = F.lower(F.element_at(F.split(_bare(value), " "), -1))
    return F.when(kind == "phone", plus).when(kind.isin("card", "ssn"), _digits(value)).when(kind == "iban", F.regexp_replace(value, " ", "")).when(kind.isin("name", "word"), surname).otherwise(F.lower(value))


def _sex(value: Column) -> Column:
    """f, m or n (unknown) by title or given name."""
    def starts(words: list[str]) -> Column:
        return value.rlike(rf"^(?:{'|'.join(words)})(?:\.? )")

    women = [n for (s, _), names in GIVEN.items() if s == "f" for n in names]
    men = [n for (s, _), names in GIVEN.items() if s == "m" for n in names]
    return F.when(starts(TITLES["f"] + women), "f").when(starts(TITLES["m"] + men), "m").otherwise("n")


def _number(hexes: Column, at: int) -> Column:
    """A number below 65536 from a hash's four hexadecimal digits at `at`."""
    return F.conv(F.substring(hexes, at, 4), 16, 10).cast("int")


def _pick(items: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (number % len(items) + 1).cast("int"))


def _candidate(key: str) -> Column:
    """The surrogate of (kind, canonical, sex, script) at draw `attempt`."""
    kind, canonical, attempt = F.col("kind"), F.col("canonical"), F.col("attempt")
    seed = F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"))
    hexes = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("#")), 256))
    stream = F.translate(hexes, "abcdef", "135790")
    n = F.length(canonical)
    code = F.when(kind == "phone", F.regexp_extract(canonical, COUNTRY, 0)).otherwise("")
    code = F.when(code == "", F.substring(canonical, 1, 1)).otherwise(code)
    # where all values of a length are taken, numbers grow by a digit every few draws
    more = F.greatest(F.lit(0), F.floor((attempt - 2) / 2)).cast("int")
    plain = F.concat(code, stream.substr(F.lit(1), n - F.length(code) + more))
    body = F.concat(F.substring(canonical, 1, 1), stream.substr(F.lit(1), n - 2))
    card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    ip = F.concat_ws(".", *((_number(hexes, i) % 254 + 1).cast("string") for i in (1, 5, 9, 13)))

    def like(text: Column, offset: int) -> Column:
        """A letter for a letter of the same script, a digit for a digit; other characters stay. Longer texts reuse the hash."""
        def one(c: Column, i: Column) -> Column:
            two = F.conv(F.substr(hexes, (i * 2 + offset) % 126 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 63).cast("int")
            def among(letters: str) -> Column:
                return F.substr(F.lit(letters), (two % len(letters) + 1).cast("int"), F.lit(1))

            return F.when(c.rlike(r"\d"), among("0123456789")).when(c.rlike(r"[a-z]"), among("abcdefghijklmnopqrstuvwxyz")).when(c.rlike(r"[A-Z]"), among("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike(r"\p{IsCyrillic}"), among("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike(r"\p{IsGreek}"), among("αβγδεζηθικλμνξοπρστυφχψω")).when(c.rlike(r"\p{IsLatin}"), among("abcdefghijklmnopqrstuvwxyz")).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    # a mail address keeps its top-level domain; ten letters at least make the user part wide enough
    user, host = F.substring_index(canonical, "@", 1), F.substring_index(canonical, "@", -1)
    wide = F.when(attempt > 2, F.concat(like(user, 0), F.substring(hexes, 101, 6))).otherwise(like(user, 0))
    email = F.concat(wide, F.lit("@"), like(F.regexp_replace(host, r"\.[^.]*$", ""), 31), F.lit("."), F.substring_index(host, ".", -1))
    iban_body = like(F.substring(canonical, 5, 64), 0)
    iban = F.concat(F.substring(canonical, 1, 2), F.lpad((98 - _mod97(F.concat(iban_body, F.substring(canonical, 1, 2), F.lit("00")))).cast("string"), 2, "0"), iban_body)

    def surname(script: str) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.least(F.lit(9), attempt + 1)), lambda i: _pick(SYLLABLES[script], F.conv(F.substr(hexes, (i * 4 + 9).cast("int"), F.lit(4)), 16, 10).cast("int")))
        return F.initcap(F.array_join(parts, ""))

    def given(names: list[str]) -> Column:
        """One listed name, and a double, then a longer one if those are taken."""
        picks = F.transform(F.sequence(F.lit(0), F.least(F.lit(9), F.floor(attempt / 3).cast("int"))), lambda i: _pick(names, F.conv(F.substr(hexes, (i * 4 + 5).cast("int"), F.lit(4)), 16, 10).cast("int")))
        return F.array_join(picks, "-")

    made = None
    for (sex, script), names in GIVEN.items():
        same = (F.col("script") == script) & ((F.col("sex") == sex) | (F.col("sex") == "n") & (F.lit(sex) == F.when(_number(hexes, 1) % 2 == 0, "f").otherwise("m")))
        made = F.when(same, given(names)) if made is None else made.when(same, given(names))
    last = F.when(F.col("script") == "cyrillic", surname("cyrillic")).otherwise(surname("latin"))
    return F.when(kind == "email", email).when(kind == "ipv4", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind == "surname", last).when(kind == "given", made).otherwise(plain)


def _mod97(text: Column) -> Column:
    digits = F.transform(F.split(F.upper(text), ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int")))
    return F.aggregate(digits, F.lit(0), lambda r, d: (r * F.when(d > 9, 100).otherwise(10) + F.coalesce(d, F.lit(0))) % 97)


def _iban_fits(canonical: Column) -> Column:
    return _mod97(F.concat(F.substring(canonical, 5, 64), F.substring(canonical, 1, 4))) == 1


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) for distinct entities (kind, canonical, sex, script); no two of a kind share a surrogate.

    Each round draws for the entities that are still open. A draw is refused if a smaller open entity
    has it too, if it was given before, or if it is an entity itself (other than a given name), its own value
    too. Names grow by a syllable a round, numbers by a digit every two rounds from the fourth on, so a crowded
    space always opens up: nothing keeps a real value.
    """
    entities = written(entities)
    real = entities.filter("kind <> 'given'").select("kind", F.lower("canonical").alias("key")).distinct()
    open_rows, given, attempt = entities, None, 0
    while True:
        drawn = open_rows.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", _candidate(key)).withColumn("key", F.lower("surrogate"))
        drawn = written(drawn)
        first = drawn.groupBy("kind", "key").agg(F.min("canonical").alias("canonical"))
        taken = real if given is None else real.unionByName(given.select("kind", F.lower("surrogate").alias("key")))
        good = written(first.join(taken, ["kind", "key"], "left_anti").join(drawn.drop("key"), ["kind", "canonical"]).select("kind", "canonical", "surrogate"))
        given = good if given is None else given.unionByName(good)
        open_rows = written(entities.join(given, ["kind", "canonical"], "left_anti"))
        attempt += 1
        if open_rows.isEmpty():
            return given


def _rendered(kind: Column, value: Column, surrogate: Column, given: Column) -> Column:
    """The surrogate in the way `value` is written: its digits in the same places (more at the end, if it is longer), title and letter case kept."""
    signs = F.when(kind == "phone", _digits(surrogate)).otherwise(surrogate)
    spread = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda acc, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(acc["s"], F.substr(signs, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i"))),
        lambda acc: F.concat(acc["s"], F.substr(signs, acc["i"])),
    )
    title = F.regexp_extract(value, rf"^(?:{_TITLES})\.? ", 0)
    cased = F.when((value == F.upper(value)) & (value != F.lower(value)), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spread).when(kind == "surname", F.concat(title, F.coalesce(F.concat(given, F.lit(" ")), F.lit("")), surrogate)).otherwise(cased)


def mentions(texts: DataFrame, pattern: str) -> DataFrame:
    """(content, pos, value, kind, canonical, given) of all matches in distinct texts (content, text); kind is null where a match is no entity."""
    each = texts.select("content", F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))).alias("pos", "value")).withColumn("kind", _kind(F.col("value")))
    each = each.withColumn("canonical", _canonical(F.col("kind"), F.col("value")))
    parts = F.split(_bare(F.col("value")), " ")
    each = each.withColumn("given", F.when((F.col("kind") == "name") & (F.size(parts) > 1), F.lower(parts[0])))
    # a capitalised word is a mention if it is the surname of a name in the same text
    own = F.collect_set(F.when(F.col("kind") == "name", F.col("canonical"))).over(Window.partitionBy("content"))
    fits = F.when(F.col("kind") == "card", _luhn(F.col("canonical")) == 0).when(F.col("kind") == "iban", _iban_fits(F.col("canonical"))).when(F.col("kind") == "word", F.array_contains("own", F.col("canonical"))).otherwise(True)
    each = each.withColumn("own", own).withColumn("kind", F.when(fits, F.when(F.col("kind").isin("name", "word"), "surname").otherwise(F.col("kind")))).drop("own")
    return each.filter("kind is not null") if pattern == WIDE else each


def replaced(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with `text_col` rewritten, and n_entities, the mentions replaced in it.

    Only mentions are shuffled to find surrogates, in a split-able join; the texts with mentions move
    once, the others never. One text's mentions are gathered by the text's own hash.
    """
    text = F.col("row")[text_col]
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    has = F.coalesce(text.rlike(ANY), F.lit(False))
    named = text.rlike(PATTERNS["name"])
    marked = rows.filter(has).withColumns({"content": F.md5(text), "named": named})

    def found(pattern: str) -> DataFrame:
        own = marked.filter(F.col("named") == F.lit(pattern == WIDE)).select("content", text.alias("text")).dropDuplicates(["content"])
        return mentions(own, pattern)

    told = written(found(ANY).unionByName(found(WIDE)))
    named_sex = F.min(F.nullif(_sex(F.col("value")), F.lit("n")))
    whole = told.filter("kind is not null").select("kind", "canonical", F.lit(None).cast("string").alias("value")).distinct()
    given = told.filter("given is not null").select(F.lit("given").alias("kind"), F.col("given").alias("canonical"), "value")
    entities = whole.unionByName(given).groupBy("kind", "canonical").agg(F.coalesce(named_sex, F.lit("n")).alias("sex"))
    script = F.when(F.col("canonical").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    table = written(surrogates(entities.withColumn("script", script), key))
    first = table.filter("kind = 'given'").select(F.col("canonical").alias("given"), F.col("surrogate").alias("given_new"))
    shown = told.join(table, ["kind", "canonical"], "left").join(first, "given", "left")
    new = F.when(F.col("surrogate").isNotNull(), _rendered(F.col("kind"), F.col("value"), F.col("surrogate"), F.col("given_new"))).otherwise(F.col("value"))
    each = shown.select("content", F.struct("pos", new.alias("new")).alias("x"), F.col("surrogate").isNotNull().cast("long").alias("is_new"))
    each = each.groupBy("content").agg(F.map_from_entries(F.collect_list("x")).alias("new"), F.sum("is_new").alias("number"))
    joined = marked.join(each, "content", "left")

    def filled(pattern: str) -> Column:
        """The text with each match's new form, or itself where it has none."""
        was = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.array_join(F.transform(F.split(text, pattern, -1), lambda gap, i: F.concat(gap, F.coalesce(F.try_element_at(F.col("new"), i), F.get(was, i), F.lit("")))), "")

    number = F.coalesce("number", F.lit(0))
    rewritten = F.when(number == 0, text).when(F.col("named"), filled(WIDE)).otherwise(filled(ANY))
    kept = [c for c in docs.columns if c != "n_entities"]
    out = joined.select(*(rewritten.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept), number.cast("long").alias("n_entities"))
    return rows.filter(~has).select(*(F.col("row")[c].alias(c) for c in kept), F.lit(0).cast("long").alias("n_entities")).unionByName(out)


def session_key(spark) -> str:
    """The secret key of the session: KEY in its conf, or one drawn at random for as long as the session lives."""
    if not spark.conf.get(KEY, ""):
        spark.conf.set(KEY, token_hex(32))
    return spark.conf.get(KEY)
