"""Operator 10: personal data, replaced by keyed surrogates of the same type and form.

Found: e-mail addresses, telephone numbers (after a +, or written like 555-123-4567), IPv4 addresses (not after a word like
version), payment cards (13 to 19 digits with a valid check digit), US social security numbers, IBANs with a valid check,
secrets assigned to a token, key or password, and names after a title. A surrogate is a keyed digest of the entity's canonical
form written in the form of the mention: digits for digits, letters for letters of the same case and script, separators as
they are. A telephone number keeps its country code. A name keeps its title; its last word gets a surrogate of its
own, the same with or without given names before it, and the first of those becomes a given name of the title's gender.

Distinctness and coreference: equal canonical forms get equal surrogates everywhere, and the surrogates of all
distinct entities are compared with each other and with all real entities; an entity that loses a collision is
keyed again until none is left. From the third time on its surrogate is longer than it by a character more each time,
so that there are always enough (an IPv4 address then becomes an IPv6 address of the documentation range, a number gets
digits after a hyphen, a full name a further given name). Only these losers are kept as a table; the rest follows from the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, marked, small

#: Titles by gender, and given names to use instead.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr"], "x": ["Dr", "Prof"]}
GIVEN = {
    "f": "Ada Alma Berta Carla Clara Dora Edith Elsa Emma Flora Greta Hilda Ida Irma Julia Klara Laura Lena Lydia Maria Marta Nora Olga Paula Rita Rosa Sara Selma Thea Vera Wanda Zita".split(),
    "m": "Adam Albert Anton Bruno Carl David Edgar Emil Felix Franz Georg Hans Hugo Ivan Jakob Karl Leo Lukas Martin Max Milo Nils Oskar Otto Paul Peter Robert Rudolf Simon Theo Victor Walter".split(),
    "x": "Alex Andrea Ariel Charlie Dana Eden Jamie Jean Jordan Kai Kim Lee Lou Luca Maxime Mika Morgan Nicola Noa Quinn Reese Remy Robin Rowan Sam Sasha Sidney Taylor Toni Val Yael Yuri".split(),
}
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
#: Before a secret: a keyword, alone or as a part of a name with '_' or '-', and an assignment.
_NAMED = r"(?<![A-Za-z0-9])(?i:token|api_key|apikey|key|secret|password|passwd)(?:[_-][A-Za-z0-9]{1,16}(?:[_-][A-Za-z0-9]{1,16})?)? {0,2}[:=] {0,2}[\"']?"
#: Java patterns by type, in order of precedence; none has a capturing group. Runs of up to 256 digits, and of groups after
#: what may begin an IBAN, are matched whole; parts_of() finds the cards and IBANs in them.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z][A-Za-z0-9-]{0,23}[A-Za-z0-9]",
    "secret": rf"(?<=[:= \"'])(?<=[:=] {{0,2}}[\"']?)(?<={_NAMED})[A-Za-z0-9_+/\-]{{8,}}={{0,2}}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,60}(?: ?[A-Z0-9]{1,3})?\b(?![A-Za-z0-9._%+-]{0,64}@|-[0-9]{2}-|\.[0-9]{1,3}\.[0-9])",
    "phone": r"(?<![\w.+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![\w.+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![\w-]|\.[0-9])",
    "card": r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,255}(?![\w-]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "ip": r"(?<![\w.])(?<!(?i:\b(?:version|release|build|ver|v)\.?) {0,2})(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\w|\.[0-9])",
    "name": rf"(?<=\b(?:{_TITLE})\.? )\p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+){{0,2}}",
}
ANY = "|".join(PATTERNS.values())
#: A text without any of these has no entity; spares most texts the full pattern.
CUE = rf"[@0-9]|\b(?:{_TITLE})\.? \p{{Lu}}|(?i:token|key|secret|passw(?:or)?d)(?:[_-][A-Za-z0-9]{{1,16}}){{0,2}} {{0,2}}[:=]"
#: Characters of an IBAN by country; what begins like one has its length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_COUNTRY = "|".join(f"(?:{c.replace(' ', '|')})(?: ?[A-Z0-9]){{{n - 2}}}" for n, c in IBAN_LENGTHS.items())
#: Calling codes by their first digits; all others have three.
_CALLING = r"\A(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_LOCAL_PHONE = r"\A(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}\z"
#: Times that an entity is keyed before its surrogates grow.
SAME_LENGTH = 3
_SSN = r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"
#: Forms that cards are written in; other groups of 13 to 19 digits are tried after them.
_USUAL = r"\A(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})\z"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _check_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1))),
        F.lit(0),
        lambda a, b: a + F.coalesce(b, F.lit(0)),
    )


def _iban_rest(value: Column) -> Column:
    """Remainder modulo 97 of an IBAN's digits; 1 where it is valid."""
    v = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4))
    number = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    return F.aggregate(F.split(F.array_join(number, ""), ""), F.lit(0).cast("long"), lambda a, c: (a * 10 + c.cast("long")) % 97)


def kind_of(value: Column) -> Column:
    """Type of a matched string but for names and secrets, which what precedes them tells; null if its check fails."""
    bare = {
        "email": value.contains("@"),
        "phone": value.startswith("+") | value.rlike(_LOCAL_PHONE),
        "ssn": value.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"),
        "ip": value.rlike(r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z"),
    }
    out = None
    for k, fits in bare.items():
        out = F.when(fits, k) if out is None else out.when(fits, k)
    card = value.rlike(r"\A[0-9](?:[ -]?[0-9]){12,}\z")
    iban = value.rlike(r"\A[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,}(?: ?[A-Z0-9]{1,3})?\z")
    return out.when(card, F.when((F.char_length(_digits(value)) < 20) & (_check_sum(_digits(value)) % 10 == 0), "card")).when(iban, F.when((F.char_length(F.replace(value, F.lit(" "), F.lit(""))) < 36) & (_iban_rest(value) == 1), "iban"))


def parts_of(value: Column) -> Column:
    """A run without a kind of its own, as an array of (kind, value) that joined give the run: the cards and IBANs that
    pass their checks, and what is between them with a null kind; also social security numbers that such a run took in. They begin where a group does, and end where one does or
    where the country's IBAN does. Overlaps go to an IBAN, then to a usual form of a card, then to the first and longest."""
    words = F.regexp_extract_all(value, F.lit(r"[A-Z0-9]+[ -]?"), F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.char_length(F.array_join(F.slice(words, F.lit(1), i), "")))

    def windows(s: Column, i: Column) -> Column:
        ends = F.transform(F.sequence(i + 1, F.least(F.size(words), i + 19)), lambda j: F.rtrim(F.rtrim(F.array_join(F.slice(words, i + 1, j - i), "")), F.lit("-")))
        ends = F.array_append(ends, F.regexp_extract(F.substr(value, s + 1), rf"\A(?:{_BY_COUNTRY})", 0))
        ends = F.filter(F.array_distinct(ends), lambda w: w.rlike(r"\A(?:[ -]?[A-Z0-9]){13,35}\z") | w.rlike(_SSN) & (F.substr(value, s, F.lit(1)) != "-") & (F.substr(value, s + 12, F.lit(1)) != "-"))
        return F.transform(ends, lambda w: F.struct(kind_of(w).alias("kind"), s.alias("s"), w.alias("w")))

    valid = F.filter(F.flatten(F.transform(starts, windows)), lambda x: x["kind"].isin("card", "iban", "ssn"))
    rank = lambda x: F.struct(F.when(x["kind"] == "iban", 0).when(x["w"].rlike(_USUAL), 1).when(x["kind"] == "ssn", 2).otherwise(3).alias("o"), x["s"].alias("s"), (-F.char_length(x["w"])).alias("l"), x["kind"].alias("kind"), x["w"].alias("w"))
    taken = F.array().cast("array<struct<s: int, e: int, kind: string, w: string>>")
    free = lambda acc, x: ~F.exists(acc, lambda t: (t["s"] < x["s"] - x["l"]) & (x["s"] < t["e"]))
    one = lambda x: F.struct(x["s"].alias("s"), (x["s"] - x["l"]).alias("e"), x["kind"].alias("kind"), x["w"].alias("w"))
    chosen = F.array_sort(F.aggregate(F.array_sort(F.transform(valid, rank)), taken, lambda acc, x: F.when(free(acc, x), F.array_append(acc, one(x))).otherwise(acc)))
    part = lambda kind, w: F.struct(kind.cast("string").alias("kind"), w.alias("value"))
    begin = F.struct(F.lit(0).alias("e"), F.array().cast("array<struct<kind: string, value: string>>").alias("parts"))
    gap = lambda acc, x: part(F.lit(None), F.substr(value, acc["e"] + 1, x["s"] - acc["e"]))
    put = lambda acc, x: F.struct(x["e"].alias("e"), F.concat(acc["parts"], F.array(gap(acc, x), part(x["kind"], x["w"]))).alias("parts"))
    rest = lambda acc: F.array_append(acc["parts"], part(F.lit(None), F.substr(value, acc["e"] + 1)))
    return F.filter(F.aggregate(chosen, begin, put, rest), lambda x: x["value"] != "")


def canonical(kind: Column, value: Column) -> Column:
    bare = F.when(kind.isin("phone", "card", "ssn"), _digits(value)).when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
    return bare.when(kind.isin("email", "name", "surname"), F.lower(value)).otherwise(value)


def _stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """128 hexadecimal digits that follow from the key and the entity."""
    seed = F.concat_ws("\u0000", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(F.sha2(F.concat(seed, F.lit("\u0001")).cast("binary"), 256), F.sha2(F.concat(seed, F.lit("\u0002")).cast("binary"), 256))


def _byte(stream: Column, i: Column) -> Column:
    """A number from 0 to 4095 of the stream, which starts again where it ends."""
    return F.conv(F.substr(stream, (i * 3) % 125 + 1, F.lit(3)), 16, 10).cast("int")


#: Letters that stand in for a letter of the same script and case, by first letter and number of them.
ALPHABETS = [("[a-z]", "a", 26), ("[A-Z]", "A", 26), ("[α-ω]", "α", 17), ("[Α-Ρ]", "Α", 17), ("[а-я]", "а", 32), ("[А-Я]", "А", 32), ("[א-ת]", "א", 27), ("[一-鿿]", "一", 2000), ("[가-힣]", "가", 2000), ("[぀-ゟ]", "あ", 80)]


#: Latin letters of made-up names, which alternate.
CONSONANTS, VOWELS = "bdfgklmnprstvz", "aeiou"


def _in_form(value: Column, stream: Column, spoken: bool = False) -> Column:
    """Digit for digit and letter for letter; other characters as they are. Letters outside ALPHABETS become plain
    Latin ones; hexadecimal strings stay hexadecimal. spoken: Latin consonants and vowels by turns."""
    hexadecimal = value.rlike(r"\A(?:[0-9a-f]{8,}|[0-9A-F]{8,})\z")

    def one(c, i):
        n = _byte(stream, i)
        out = F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
        if spoken:
            letter = F.when(i % 2 == 0, F.substr(F.lit(CONSONANTS), n % len(CONSONANTS) + 1, F.lit(1))).otherwise(F.substr(F.lit(VOWELS), n % len(VOWELS) + 1, F.lit(1)))
            out = out.when(c.rlike(r"[\p{IsLatin}&&\p{Lu}]"), F.upper(letter)).when(c.rlike(r"\p{IsLatin}"), letter)
        for pattern, first, size in ALPHABETS:
            wide = F.when(hexadecimal, 6).otherwise(size) if size == 26 else F.lit(size)
            out = out.when(c.rlike(pattern), _char(n % wide + ord(first)))
        out = out.when(c.rlike(r"\p{Ll}"), _char(n % 26 + 97)).when(c.rlike(r"\p{Lu}"), _char(n % 26 + 65))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _char(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def last_word(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def with_surrogates(df: DataFrame, key: str) -> DataFrame:
    """df (kind, value, canon, attempt, gender, last_attempt) with `made`: what stands for the entity, in the form of this
    mention. last_attempt is that of a name's last word."""
    kind, value, canon = F.col("kind"), F.col("value"), F.col("canon")
    more = F.greatest(F.col("attempt") - (SAME_LENGTH - 1), F.lit(0))
    df = df.withColumn("_stream", _stream(kind, canon, F.col("attempt"), key))
    # The host of an e-mail address follows from its own digest alone; it gets a reserved domain.
    host = F.when(kind == "email", F.substring_index(canon, "@", -1))
    df = df.withColumn("_host", F.when(kind == "email", F.translate(F.substring(_stream(F.lit("host"), host, F.col("attempt"), key), 1, 10), "0123456789", "ghijklmnop")))
    numeric = kind.isin("phone", "card", "ssn", "iban")
    local = F.concat(F.substring_index(canon, "@", 1), F.repeat(F.lit("a"), more))
    source = F.when(kind == "email", local).when(numeric, canon).when(kind == "secret", F.concat(F.repeat(F.lit("a"), more), value)).otherwise("")
    df = df.withColumn("_filled", _in_form(source, F.col("_stream")))
    filled, stream = F.col("_filled"), F.col("_stream")

    email = F.concat(filled, F.lit("@"), F.col("_host"), F.lit(".example"))
    email = F.when(value == F.upper(value), F.upper(email)).otherwise(email)
    ip = F.concat_ws(".", *((_byte(stream, F.lit(i)) % n + least).cast("string") for i, (n, least) in enumerate([(14, 240), (256, 0), (256, 0), (254, 1)])))
    ip = F.when(more > 0, F.concat(F.lit("2001:db8"), *(x for i in range(4) for x in (F.lit(":"), F.substring(stream, 20 + 4 * i, 4))), F.lit("::"))).otherwise(ip)
    # IBAN: country as it is, account in form, check digits made valid.
    plain = F.concat(F.substring(canon, 1, 2), F.lit("00"), F.substr(filled, F.lit(5)))
    # Cards keep their first digit and get a valid check digit; no social security number begins with 9.
    body = F.concat(F.substring(canon, 1, 1), F.substr(filled, F.lit(2), F.char_length(canon) - 2))
    df = df.withColumn("_plain", F.when(kind == "iban", plain).when(kind == "card", body))
    plain = F.col("_plain")
    code = F.when(value.startswith("+"), F.regexp_extract(canon, _CALLING, 0)).otherwise(F.substring(canon, 1, 1))
    digits = (
        F.when(kind == "phone", F.concat(code, F.substr(filled, F.char_length(code) + 1)))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substr(filled, F.lit(2))))
        .when(kind == "card", F.concat(plain, ((10 - _check_sum(F.concat(plain, F.lit("0"))) % 10) % 10).cast("string")))
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), F.lpad((98 - _iban_rest(plain)).cast("string"), 2, "0"), F.substr(plain, F.lit(5))))
    )
    # ... dealt out to the places of digits (of digits and letters in an IBAN) in the mention
    df = df.withColumn("_digits", digits)
    places = F.split(value, "")
    held = F.regexp_replace(value, r"[^0-9A-Z]", "")
    nth = F.transform(places, lambda c, i: F.when(c.rlike("[0-9A-Z]"), F.substr(F.col("_digits"), F.char_length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), r"[^0-9A-Z]", "")), F.lit(1))).otherwise(c))
    number = F.when(held == value, F.col("_digits")).otherwise(F.array_join(nth, ""))
    number = F.when(more > 0, F.concat(number, F.lit("-"), F.array_join(F.transform(F.sequence(F.lit(1), more), lambda i: (_byte(stream, i + 50) % 10).cast("string")), ""))).otherwise(number)

    # A name's last word stands for itself; the words before it follow from the whole name.
    is_name = kind.isin("name", "surname")
    named = F.when(is_name, last_word(value))
    last_try = F.coalesce(F.when(kind == "surname", F.col("attempt")).otherwise(F.col("last_attempt")), F.lit(0))
    grown = F.greatest(last_try - (SAME_LENGTH - 1), F.lit(0))
    df = df.withColumn("_last", _in_form(F.concat(named, F.repeat(F.lower(F.right(named, F.lit(1))), grown)), _stream(F.lit("surname"), F.lower(named), last_try, key), spoken=True))
    first = F.when((kind == "name") & value.contains(" "), F.substr(value, F.lit(1), F.char_length(value) - F.char_length(last_word(value)) - 1))
    given = F.element_at(F.array(*(F.array(*map(F.lit, GIVEN[g])) for g in "fmx")), F.when(F.col("gender") == "f", 1).when(F.col("gender") == "m", 2).otherwise(3))
    nth_given = lambda i: F.element_at(given, _byte(stream, i) % 32 + 1)
    latin = first.rlike(r"\A[\p{IsLatin}'’ -]+\z")
    rest = F.when(first.contains(" "), F.concat(F.lit(" "), _in_form(F.regexp_extract(first, r" (.*)", 1), stream, spoken=True))).otherwise("")
    further = F.array_join(F.transform(F.slice(F.sequence(F.lit(0), more), F.lit(2), F.greatest(more, F.lit(1))), lambda i: F.concat(F.lit(" "), nth_given(i + 50))), "")
    before = F.when(latin, F.concat(nth_given(F.lit(40)), further, rest)).otherwise(_in_form(F.concat(first, F.repeat(F.lower(F.right(first, F.lit(1))), more)), stream))
    name = F.when(first.isNull(), F.col("_last")).otherwise(F.concat(before, F.lit(" "), F.col("_last")))
    made = F.when(kind == "email", email).when(kind == "ip", ip).when(is_name, name).when(kind == "secret", filled).when(numeric, number)
    return df.withColumn("made", made).drop("_stream", "_host", "_filled", "_plain", "_digits", "_last")


def _settled(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """kind, canon, attempt of entities (kind, canon, value, gender, last_attempt), each with a surrogate that no other entity
    has, made or real. Surrogates grow with the attempts, so there are enough for all."""
    real = entities.select("kind", F.col("canon").alias("form"))
    settled, open_, attempt = None, entities.withColumn("attempt", F.lit(0)), 0
    while True:
        tried = scratch.write(with_surrogates(open_, key).select("kind", "canon", canonical(F.col("kind"), F.col("made")).alias("form")), "tried")
        taken = real if settled is None else real.union(settled.select("kind", "form"))
        winners = tried.groupBy("kind", "form").agg(F.min("canon").alias("canon")).join(taken, ["kind", "form"], "left_anti").withColumn("attempt", F.lit(attempt))
        settled = scratch.write(winners if settled is None else settled.unionByName(winners), "settled")
        attempt += 1
        open_ = scratch.write(entities.join(settled, ["kind", "canon"], "left_anti").withColumn("attempt", F.lit(attempt)), "collisions")
        if not open_.limit(1).count():
            return settled


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten and `entities`, an array of (kind, surrogate) in order of appearance.

    key must be kept secret: whoever has it can test guesses. A null text stays null; a text without entities stays as it is.
    Repeated rows, and rows that share an id, are rewritten each by its own text. All other columns are passed through,
    whatever their names, but one named `entities` is replaced. An empty table gives none. The same key gives the same
    surrogates for the same entities, so long as the set of entities that collide is the same. What the result reads, the
    mentions of each text, is a table in the shared folder; all others are deleted.
    """
    with Scratch(docs.sparkSession, "surrogates") as scratch:
        per_text = scratch.result(_mentions(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), key, scratch))
    columns = [c for c in docs.columns if c != "entities"]
    # the other columns in one of their own, so that no name of theirs can clash with one used here
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("whole"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    flagged = marked(whole, F.xxhash64("id", "th"), per_text.select(F.xxhash64("_pid", "_pth").alias("h")))
    empty = F.array().cast("array<struct<kind: string, surrogate: string>>")
    clean = flagged.filter("not maybe").select("whole.*", empty.alias("entities"))
    held = flagged.filter("maybe").join(per_text, F.col("id").eqNullSafe(F.col("_pid")) & (F.col("th") == F.col("_pth")), "left")
    woven = F.array_join(F.flatten(F.zip_with(F.split("text", ANY, -1), F.transform("ms", lambda m: m["put"]), lambda p, q: F.array(p, F.coalesce(q, F.lit(""))))), "")
    listed = F.transform(F.flatten("ms.own"), lambda m: F.struct(m["kind"].alias("kind"), m["put"].alias("surrogate")))
    text = F.when(F.col("ms").isNull(), F.col("text")).otherwise(woven)
    held = held.select(*(text.alias(c) if c == text_col else F.col(f"whole.`{c}`").alias(c) for c in columns), F.coalesce(listed, empty).alias("entities"))
    return clean.unionByName(held)


def _mentions(docs: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """_pid, _pth, ms: what is put for each match in each text (id, and hash of the text) that has an entity."""
    cued = docs.filter(F.col("text").rlike(CUE)).withColumn("th", F.xxhash64("text")).select("id", "th", "text")
    parts = cued.select("id", "th", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("values"), F.transform(F.split("text", ANY, -1), lambda p: F.right(p, F.lit(64))).alias("before")).filter("size(values) > 0")
    each = parts.select("id", "th", F.posexplode("values").alias("n", "value"), "before").withColumn("before", F.element_at("before", F.col("n") + 1))
    title = F.regexp_extract("before", rf"\b({_TITLE})\.? \z", 1)
    gender = F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m").otherwise("x")
    named = (title != "") & F.col("value").rlike(r"\A\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}\z")
    secret = F.col("value").rlike(r"\A[A-Za-z0-9_+/\-]{8,}={0,2}\z") & F.col("value").rlike(r"[0-9]|\A\S{16,}\z") & F.col("before").rlike(rf"{_NAMED}\z")
    kind = F.when(named, "name").otherwise(F.coalesce(kind_of(F.col("value")), F.when(secret, "secret")))
    each = each.select("id", "th", "n", "value", kind.alias("kind"), gender.alias("gender"))
    run = F.col("kind").isNull() & F.col("value").rlike(r"\A[A-Z0-9](?:[ -]?[A-Z0-9]){12,}\z")
    each = each.select("id", "th", "n", F.posexplode(F.when(run, parts_of(F.col("value"))).otherwise(F.array(F.struct("kind", "value")))).alias("m", "part"), "gender")
    each = each.select("id", "th", "n", "m", "part.value", "part.kind", "gender")
    # a name of one word is its last word
    each = each.withColumn("kind", F.when((F.col("kind") == "name") & ~F.col("value").contains(" "), "surname").otherwise(F.col("kind")))
    mentions = scratch.write(each.withColumn("canon", canonical(F.col("kind"), F.col("value"))), "mentions")

    # Collisions among the surrogates of all distinct entities, and with real ones; last words before whole names.
    found = mentions.filter("kind is not null").select("kind", "canon", "value", "gender")
    words = found.filter("kind = 'name'").select(F.lit("surname").alias("kind"), last_word(F.col("canon")).alias("canon"), last_word(F.col("value")).alias("value"), "gender")
    entities = scratch.write(found.unionByName(words).groupBy("kind", "canon").agg(F.min("value").alias("value"), F.min("gender").alias("gender")), "entities")
    none = F.lit(None).cast("int")
    first = _settled(entities.filter("kind <> 'name'").withColumn("last_attempt", none), key, scratch)
    tries = first.filter("kind = 'surname' and attempt > 0").select(F.col("canon").alias("w"), F.col("attempt").alias("last_attempt"))
    tries = small(scratch.write(tries, "last-words"))
    whole = entities.filter("kind = 'name'").join(tries, last_word(F.col("canon")) == F.col("w"), "left").drop("w")
    second = _settled(scratch.write(whole, "names"), key, scratch)
    again = first.unionByName(second).filter("attempt > 0").select(F.col("kind").alias("k"), F.col("canon").alias("c"), "attempt")
    again = small(scratch.write(again, "keyed-again"))

    # One gender per entity, so that a name after different titles stays one.
    gendered = small(scratch.write(entities.filter("kind = 'name'").select(F.col("canon").alias("gc"), F.col("gender").alias("g")), "genders"))
    known = mentions.join(again, (F.col("kind") == F.col("k")) & (F.col("canon") == F.col("c")), "left").join(gendered, (F.col("kind") == "name") & (F.col("canon") == F.col("gc")), "left")
    known = known.join(tries, (F.col("kind") == "name") & (last_word(F.col("canon")) == F.col("w")), "left")
    known = known.withColumns({"attempt": F.coalesce("attempt", F.lit(0)), "gender": F.coalesce("g", "gender")})
    kind = F.when(F.col("kind") == "surname", "name").otherwise(F.col("kind")).alias("kind")
    said = with_surrogates(known, key).select("id", "th", "n", F.struct("m", kind, F.coalesce("made", "value").alias("put")).alias("m"))
    said = said.groupBy("id", "th", "n").agg(F.array_sort(F.collect_set("m")).alias("own"))
    said = said.select("id", "th", F.struct("n", F.array_join(F.col("own.put"), "").alias("put"), F.filter("own", lambda m: m["kind"].isNotNull()).alias("own")).alias("m"))
    per_text = said.groupBy("id", "th").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    return per_text.filter(F.exists("ms", lambda m: F.size(m["own"]) > 0)).select(F.col("id").alias("_pid"), F.col("th").alias("_pth"), "ms")
