"""Text analysis for full-text search: tokens, stopwords and stems of Spanish and English.

Plain functions of strings, so they can be tested alone; operators run them inside one Arrow UDF.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

MAX_TERM_BYTES = 64
#: Characters that vanish: combining marks and the soft hyphen.
IGNORED = re.compile("[̀-ͯ­]")
WORD = re.compile(r"[^\W_]+")
ACRONYM = re.compile(r"(?<![^\W_])(?:[^\W\d_]\.){2,}(?:[^\W\d_](?![^\W_]))?")

#: The Spanish stopword list of the Snowball project, whole and in its published order.
SPANISH_WORDS = """
de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre
cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante
ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella
estar estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosostros vosostras os mío mía míos mías tuyo tuya
tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras esos esas
estoy estás está estamos estáis están esté estés estemos estéis estén estaré estarás estará estaremos estaréis estarán
estaría estarías estaríamos estaríais estarían estaba estabas estábamos estabais estaban estuve estuviste estuvo estuvimos
estuvisteis estuvieron estuviera estuvieras estuviéramos estuvierais estuvieran estuviese estuvieses estuviésemos
estuvieseis estuviesen estando estado estada estados estadas estad
he has ha hemos habéis han haya hayas hayamos hayáis hayan habré habrás habrá habremos habréis habrán habría habrías
habríamos habríais habrían había habías habíamos habíais habían hube hubiste hubo hubimos hubisteis hubieron hubiera
hubieras hubiéramos hubierais hubieran hubiese hubieses hubiésemos hubieseis hubiesen habiendo habido habida habidos habidas
soy eres es somos sois son sea seas seamos seáis sean seré serás será seremos seréis serán sería serías seríamos seríais
serían era eras éramos erais eran fui fuiste fue fuimos fuisteis fueron fuera fueras fuéramos fuerais fueran fuese fueses
fuésemos fueseis fuesen sintiendo sentido sentida sentidos sentidas siente sentid
tengo tienes tiene tenemos tenéis tienen tenga tengas tengamos tengáis tengan tendré tendrás tendrá tendremos tendréis
tendrán tendría tendrías tendríamos tendríais tendrían tenía tenías teníamos teníais tenían tuve tuviste tuvo tuvimos
tuvisteis tuvieron tuviera tuvieras tuviéramos tuvierais tuvieran tuviese tuvieses tuviésemos tuvieseis tuviesen
teniendo tenido tenida tenidos tenidas tened
"""
#: English function words.
ENGLISH_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now
"""


def strip_accents(word: str, keep: str = "ñ") -> str:
    return "".join(c if c in keep else unicodedata.normalize("NFD", c)[0] for c in word)


@functools.cache
def stopwords(language: str) -> frozenset[str]:
    if language == "english":
        return frozenset(ENGLISH_WORDS.split())
    if language != "spanish":
        raise ValueError(f"unknown language {language!r}")
    return frozenset(SPANISH_WORDS.split())


def _after(word: str, start: int, wanted) -> int:
    """Position just after the first letter from start on that is wanted, else the word's length."""
    return next((i + 1 for i in range(start, len(word)) if wanted(word[i])), len(word))


def _regions(word: str, vowels: str) -> tuple[int, int]:
    """Begin of R1 and R2: after the first non-vowel that follows a vowel, and again within R1."""
    r1 = _after(word, _after(word, 0, lambda c: c in vowels), lambda c: c not in vowels)
    r2 = _after(word, _after(word, r1, lambda c: c in vowels), lambda c: c not in vowels)
    return r1, r2


def _longest(word: str, endings, start: int = 0) -> str:
    """The longest of the endings that the word has within word[start:]."""
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= start), key=len, default="")


ES_VOWELS = "aeiouáéíóúü"
#: Fixed values of the Spanish stemmer.
ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
ES_GERUNDS_ACCENTED = "iéndo ándo ár ér ír".split()
ES_GERUNDS = "ando iendo ar er ir".split()
ES_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
ES_ACTION = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
ES_SWAPPED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
ES_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
ES_GU_VERBS = "en es éis emos".split()
ES_VERBS = """
arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá
eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an
aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis
abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos
""".split()


def _es_rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in ES_VOWELS:
        return _after(word, 2, lambda c: c in ES_VOWELS)
    if word[0] in ES_VOWELS:
        return _after(word, 2, lambda c: c not in ES_VOWELS)
    return 3


def stem_spanish(word: str) -> str:
    rv, (r1, r2) = _es_rv(word), _regions(word, ES_VOWELS)

    def ends(ending: str, start: int) -> bool:
        return word.endswith(ending) and len(word) - len(ending) >= start

    pronoun = _longest(word, ES_PRONOUNS, rv)
    if pronoun:
        rest = word[: -len(pronoun)]
        if found := _longest(rest, ES_GERUNDS_ACCENTED, rv):
            word = rest[: -len(found)] + strip_accents(found)
        elif _longest(rest, ES_GERUNDS, rv) or (rest.endswith("uyendo") and len(rest) - 5 >= rv):
            word = rest

    before = word
    ending = _longest(word, [*ES_PLAIN, *ES_ACTION, *ES_SWAPPED, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"])
    if ending and ends(ending, r1 if ending == "amente" else r2):
        word = word[: -len(ending)] + ES_SWAPPED.get(ending, "")
        cut = []
        if ending in ES_ACTION:
            cut = ["ic"]
        elif ending == "amente":
            if ends("iv", r2):
                word = word[:-2]
                cut = ["at"]
            else:
                cut = ["os", "ic", "ad"]
        elif ending == "mente":
            cut = ["ante", "able", "ible"]
        elif ending.startswith("idad"):
            cut = ["abil", "ic", "iv"]
        elif ending[:2] == "iv":
            cut = ["at"]
        if found := next((c for c in cut if ends(c, r2)), ""):
            word = word[: -len(found)]

    if word == before:
        found = _longest(word, ES_Y_VERBS, rv)
        if found and word[: -len(found)].endswith("u"):
            word = word[: -len(found)]
        elif found := _longest(word, [*ES_GU_VERBS, *ES_VERBS], rv):
            word = word[: -len(found)]
            if found in ES_GU_VERBS and word.endswith("gu"):
                word = word[:-1]

    found = _longest(word, ["os", "a", "o", "á", "í", "ó", "e", "é"], rv)
    if found:
        word = word[: -len(found)]
        if found in "eé" and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return "".join({"á": "a", "é": "e", "í": "i", "ó": "o", "ú": "u"}.get(c, c) for c in word)


EN_VOWELS = "aeiouy"
#: Fixed values of the English stemmer.
EN_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
EN_INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
EN_INVARIANT_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
EN_PREFIXES = ("gener", "commun", "arsen")
EN_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
EN_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _short_syllable(word: str) -> bool:
    v = EN_VOWELS
    if len(word) == 2:
        return word[0] in v and word[1] not in v
    return len(word) > 2 and word[-3] not in v and word[-2] in v and word[-1] not in v + "wxY"


def stem_english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EN_EXCEPTIONS:
        return EN_EXCEPTIONS[word]
    if word in EN_INVARIANT:
        return word
    word = re.sub(rf"(^|(?<=[{EN_VOWELS}]))y", "Y", word)
    r1, r2 = _regions(word, EN_VOWELS)
    prefix = next((p for p in EN_PREFIXES if word.startswith(p)), None)
    if prefix:
        r1 = len(prefix)
        r2 = _after(word, _after(word, r1, lambda c: c in EN_VOWELS), lambda c: c not in EN_VOWELS)

    def has_vowel(s: str) -> bool:
        return any(c in EN_VOWELS for c in s)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and has_vowel(word[:-2]):
        word = word[:-1]
    if word in EN_INVARIANT_1A:
        return word.lower()

    ending = _longest(word, ["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and has_vowel(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(EN_DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_syllable(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in EN_VOWELS:
        word = word[:-1] + "i"

    ending = _longest(word, EN_STEP2)
    if ending and len(word) - len(ending) >= r1:
        rest = word[: -len(ending)]
        if (ending != "li" or rest[-1:] in tuple("cdeghkmnrt")) and (ending != "ogi" or rest.endswith("l")):
            word = rest + EN_STEP2[ending]

    ending = _longest(word, EN_STEP3)
    if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
        word = word[: -len(ending)] + EN_STEP3[ending]

    ending = _longest(word, EN_STEP4)
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(ending)]

    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@dataclass(frozen=True)
class TextOptions:
    language: str = "spanish"
    stopwords: bool = True
    stem: bool = True


def _lower(text: str) -> str:
    """Lower-case ASCII and Latin-1 only, as other letters are left alone."""
    return "".join(c.lower() if c < "Ā" else c for c in text)


@functools.lru_cache(maxsize=200_000)
def _term(word: str, options: TextOptions) -> str:
    stop = _plain_stopwords(options.language) if options.stopwords else frozenset()
    if strip_accents(word) in stop:
        return ""
    if options.stem and not any(c.isdigit() for c in word):
        word = (stem_spanish if options.language == "spanish" else stem_english)(word)
    return strip_accents(word)


@functools.cache
def _plain_stopwords(language: str) -> frozenset[str]:
    return frozenset(map(strip_accents, stopwords(language)))


def tokenize(text: str | bytes | None, options: TextOptions = TextOptions()) -> list[str]:
    """Terms of a text, in order. Bytes that are not UTF-8 separate words."""
    if text is None:
        return []
    if isinstance(text, bytes):
        text = text.decode("utf-8", "replace").replace("�", " ")
    text = IGNORED.sub("", _lower(unicodedata.normalize("NFC", text)))
    text = ACRONYM.sub(lambda m: m.group().replace(".", "") + " ", text)
    out = []
    for word in WORD.findall(text):
        if len(word.encode()) <= MAX_TERM_BYTES and (term := _term(word, options)):
            out.append(term)
    return out
