"""Text functions as columns: folding, the tokenizers, token estimates, names and references."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Letters with marks, each a character of its own, and the letters without marks, from the Unicode tables."""
    pairs = []
    for code in range(0xC0, 0x2FFF):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.category(c).startswith("M"))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()

# Words that the tokenizers leave out.
STOP = [
    "the", "a", "an", "to", "for", "of", "in", "on", "and", "or", "with", "add",
    "create", "make", "fix", "update", "change", "new", "page", "file", "please",
    "can", "could", "would", "should", "that", "this", "these", "those", "your", "our",
    "le", "la", "les", "un", "une", "des", "de", "du", "et", "ou", "pour", "dans",
    "ajoute", "ajouter", "crée", "creer", "modifie", "modifier", "corrige", "il", "faut",
    "qui", "que", "quoi", "dont", "nos", "vos", "mes", "tes", "ses", "son", "sur",
    "par", "ces", "cet", "cette", "ce", "se", "sa", "ne", "pas", "plus", "peux",
    "peut", "nous", "vous", "est", "est-ce", "comme", "mais", "donc", "car", "leur",
    "leurs", "tout", "tous", "avec", "sans", "ton", "tes", "ver", "via",
    "créé", "créée", "déjà", "être", "où", "après", "très", "même", "général",
]
NOISE = (
    "type script app api src scripts lib core index route routes file files source sources code implementation function functions string number boolean facts return only containing identify explain explanation current existing find locate default module modules import imports imported direct directly handler handlers changes change before after which what where when how from into with without this that these those then than the and for not all any its has have does do can should would could will user agent system context path lines line name names test tests true false read write modify anything"
).split()
HISTORY_STOP = ["pourquoi", "why", "on", "a", "le", "la", "les", "de", "des", "du", "ce", "cette", "choisi", "utilise", "the", "did", "we", "use", "decision", "decide", "est", "un", "une", "do", "how", "was", "it", "is"]
REQUEST_STOP = (
    "avec dans pour sans sous vers chez entre depuis pendant quand comment pourquoi quel quelle quels quelles cette ceci cela celui celle ceux elles nous vous leur leurs mais donc alors aussi encore toujours jamais plus moins tres trop tout tous toute toutes etre avoir fait faire faut peut peux doit dois veux voudrais ajoute ajouter corrige corriger modifie modifier change changer supprime supprimer marche fonctionne probleme bug erreur about after again also because been before being could does doing each from have having here into more most much only other over same should some such than that their them then there these they this those through under until very were what when where which while will with would your"
).split()
# Fixed values of the estimate: letters and digits of one token, and what another sign costs.
LETTERS, DIGITS, SIGN = 6, 3, 0.8
#: White space of any kind, for classes of characters.
_BLANK = r"\t\n\x0B\f\r\p{Z}\x{FEFF}"


def _folded(words: list[str]) -> list[str]:
    return sorted({w.translate(str.maketrans(ACCENTED, PLAIN)) for w in words})


STOP_FOLDED = _folded(STOP)


def fold(text: Column) -> Column:
    """Text without accents and other marks."""
    return F.translate(F.regexp_replace(text, r"\p{M}+", ""), ACCENTED, PLAIN)


def _without(words: Column, left_out: list[str], shortest: int) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= shortest) & ~w.isin(left_out))


def tokens(text: Column, shortest: int = 3) -> Column:
    """Folded words of letters, digits and underscores with at least `shortest` characters, without stop words, repeats kept."""
    return _without(F.split(fold(F.lower(text)), "[^a-z0-9_]+", -1), STOP_FOLDED, shortest)


def _spaced(name: Column) -> Column:
    return F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")


def identifier_parts(name: Column) -> Column:
    """Words of an identifier: chargeCustomer, get_invoice and HTTPServer have two each. Parts have two characters or more and a letter."""
    apart = F.regexp_replace(_spaced(F.regexp_replace(name, r"[_\-./\\]+", " ")), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), rf"[{_BLANK}]+", -1), lambda w: (F.length(w) >= 2) & w.rlike("[a-z]"))


def navigation_terms(text: Column) -> Column:
    """Distinct folded words, identifiers cut, plurals made singular, without words that say nothing of code."""
    words = F.split(F.lower(_spaced(fold(text))), "[^a-z0-9]+", -1)
    one = F.transform(words, lambda w: F.when(w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when((F.length(w) > 4) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_distinct(_without(one, NOISE, 3))


def part_words(text: Column) -> Column:
    """Words of two characters or more; one with underscores is followed by its parts."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    with_parts = lambda w: F.when(w.contains("_"), F.concat(F.array(w), F.filter(F.split(w, "_", -1), lambda p: F.length(p) >= 2))).otherwise(F.array(w))
    return F.flatten(F.transform(found, with_parts))


def history_words(text: Column) -> Column:
    """Folded words of letters, digits and underscores in any script."""
    return F.regexp_extract_all(F.lower(fold(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def search_words(text: Column) -> Column:
    """Folded words of letters and digits in any script, as full-text search has them; repeats are kept."""
    return F.regexp_extract_all(F.lower(fold(text)), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def question_words(text: Column) -> Column:
    """Distinct history words without those of questions."""
    return F.array_distinct(_without(history_words(text), HISTORY_STOP, 1))


def request_words(text: Column) -> Column:
    """Distinct folded words of four characters or more that are worth a translation."""
    return F.array_distinct(_without(F.split(fold(F.lower(text)), "[^a-z0-9]+", -1), REQUEST_STOP, 4))


def token_estimate(text: Column) -> Column:
    """Estimated tokens: a word costs one for each 6 letters begun, a number one for each 3 digits begun, another sign 0.8, blanks
    nothing. Added up from left to right, as sums of 0.8 depend on it."""
    pieces = F.regexp_extract_all(text, F.lit(rf"\p{{L}}+|\p{{N}}+|[^{_BLANK}\p{{L}}\p{{N}}]"), F.lit(0))
    units = lambda w: F.length(w) + F.length(F.regexp_replace(w, r"[\x{0}-\x{FFFF}]", ""))
    cost = lambda w: F.when(w.rlike(r"^\p{L}"), F.ceil(units(w) / LETTERS).cast("double")).when(w.rlike(r"^\p{N}"), F.ceil(units(w) / DIGITS).cast("double")).otherwise(F.lit(SIGN))
    return F.ceil(F.aggregate(pieces, F.lit(0.0), lambda s, w: s + cost(w))).cast("long")


def normalised(text: Column) -> Column:
    """White space collapsed, without closing marks, lower case: equal for texts that say the same."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), "[.!;:, ]+$", ""))


def clean_name(name: Column) -> Column:
    """A name to show: one line of at most 80 characters without control characters and double quotes; null if nothing is left."""
    clean = F.substring(F.trim(F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1f\x7f"]+', " "), rf"[{_BLANK}]+", " ")), 1, 80)
    return F.when(F.length(clean) > 0, clean)


def short_reference(version: Column) -> Column:
    """Eight characters of the hash in `version:` and 64 hex digits; another id as it is."""
    return F.when(version.rlike("^version:[0-9a-f]{64}$"), F.substring(version, 9, 8)).otherwise(version)


def list_hash(items: Column) -> Column:
    """sha1 of a list, a line for each item."""
    return F.sha1(F.concat(F.array_join(items, "\n"), F.lit("\n")).cast("binary"))


def canonical_json(document: Column) -> Column:
    """The same JSON with keys in order at every level and without blanks."""
    return F.to_json(F.parse_json(document))


def is_instant(text: Column) -> Column:
    """An ISO date and time with a zone that exists in the calendar."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$") & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def module_words(path: Column, exports: Column, symbols: Column) -> Column:
    """Words of a module: of the segments of its path without extension, of its exports and of its symbols."""
    names = F.concat(F.split(F.regexp_replace(path, r"\.[a-z]+$", ""), r"[\\/]", -1), F.coalesce(exports, F.array().cast("array<string>")), F.coalesce(symbols, F.array().cast("array<string>")))
    return F.flatten(F.transform(names, identifier_parts))
