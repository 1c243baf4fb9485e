"""Problem 9: personal information inside free text, found through disguises and replaced by typed placeholders."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: disguises -------------------------------------------------------------------------------------

#: Cyrillic and Greek letters that look like Latin ones; they count as those only next to Latin letters or digits.
LOOKALIKES = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTYXaeopcyxijsdqwABEZHIKMNOPTYXo"))
#: Spelled digits by language (English, German, French, Spanish, Portuguese).
SPELLED = {
    "0": "zero oh null zéro cero", "1": "one eins un uno um", "2": "two zwei zwo deux dos dois", "3": "three drei trois tres três", "4": "four vier quatre cuatro quatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete sete", "8": "eight acht huit ocho oito", "9": "nine neun neuf nueve nove",
}
DIGIT_OF = {word: d for d, words in SPELLED.items() for word in words.split()}
AT_WORDS = "at|arroba|arobase|ät|собака"
DOT_WORDS = "dot|punkt|point|punto|ponto|точка"

_digit = "|".join(sorted(DIGIT_OF, key=len, reverse=True))
#: Transducers, each with a first character that can be searched for quickly.
_BREAKS = re.compile(
    r"[\r\n](?:"
    r"(?P<base64>(?:(?<=\r)\n)?(?:[A-Za-z0-9+/]{60,}={0,2}\r?\n)+[A-Za-z0-9+/]*={0,2}(?=[\r\n]|\Z))"
    r"|[\r\n>| \t]*)"
)
_SOFT = re.compile(r"=\r?\n[>| \t]*")
_ODD = re.compile("[\u00a0\u2002-\u200a\u202f\u3000\u200b-\u200d\u2060\ufeff\u00ad\uff01-\uff5e]")
_MARKED = re.compile("[A-Za-z][\u0300-\u036f]+")
_HAS_MARKS, _HAS_LOOKALIKES = re.compile("[\u0300-\u036f]"), re.compile("[\u0370-\u03ff\u0400-\u052f]")
_LOOKS = re.compile(rf"(?<=[A-Za-z0-9@.])[{''.join(LOOKALIKES)}]+(?=[A-Za-z0-9@.])|\b[{''.join(LOOKALIKES)}]+(?=[A-Za-z])|(?<=[A-Za-z])[{''.join(LOOKALIKES)}]+\b")
#: Spelled digits, perhaps among written ones.
_SPELLED = re.compile(rf"(?<![\w.-])(?:(?:{_digit})\b|\d{{1,4}}(?!\w))(?:(?:, |[ ,-])(?:(?:{_digit})\b|\d{{1,4}}(?!\w)))+", re.I)
_LEAST_SPELLED, _LEAST_DIGITS, _MOST_DIGITS = 3, 6, 15

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9_-]*[A-Za-z0-9])?"
_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
_BRACKET_DOT = rf"\s?{_OPEN}\s?(?:{DOT_WORDS}|\.)\s?{_CLOSE}\s?"
_turned = "|".join(w[::-1] for w in DOT_WORDS.split("|"))
#: Signs that may stand for @, and what a host looks like after each of them.
_AT = re.compile(rf"{_OPEN}\s?(?P<bracket>{AT_WORDS}|@)\s?{_CLOSE}|(?<=\s)(?P<word>{AT_WORDS})(?=\s)|@", re.I)
_AT_HINT = re.compile(rf"{_OPEN}\s?(?:{AT_WORDS}|{DOT_WORDS}|@|\.)\s?{_CLOSE}|(?<=\s)(?:{DOT_WORDS}|(?-i:AT|ARROBA))\s", re.I)
_BRACKET_HOST = re.compile(rf"{_LABEL}(?:(?:{_BRACKET_DOT}|\.){_LABEL})+(?![\w@])", re.I)
_WORD_HOST = re.compile(rf"{_LABEL}(?:\.{_LABEL})*\s+(?P<dot>{DOT_WORDS})\s+{_LABEL}(?:\s+(?P=dot)\s+{_LABEL})*(?![\w@])", re.I)
_ANY_DOT = re.compile(rf"{_BRACKET_DOT}|\s+(?:{DOT_WORDS})\s+|\.", re.I)
_TURNED_DOT = rf"\.|\s?{_CLOSE}\s?(?:{_turned}|\.)\s?{_OPEN}\s?"
_TURNED_LOCAL = re.compile(rf"\s*([\w%+-]+(?:(?:{_TURNED_DOT})[\w%+-]+)*)", re.I)
_TURNED_WORD_LOCAL = re.compile(rf"\s*([\w%+-]+(?:(?:{_TURNED_DOT}|\s+(?:{_turned})\s+)[\w%+-]+)*)", re.I)
_SPACES, _BRACKET_HOST_DOT = re.compile(r"\s*"), re.compile(_OPEN)

# ---- fixed values: identifiers -----------------------------------------------------------------------------------

_NOT_LOCAL = re.compile(r"[^\w.%+-]")
_BREAK, _NOT_TOKEN, _NOT_SPACE, _SPACE, _NOT_WORD = re.compile(r"[\r\n]"), re.compile(r"[\s<>]"), re.compile(r"\S"), re.compile(r"\s"), re.compile(r"[^\w-]")
_DOMAIN = re.compile(rf"@{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}(?![\w@])")
#: Identifiers of messages and parts are no mail addresses, whatever they look like.
_ID_HEADERS = ("message-id", "in-reply-to", "references", "content-id")
_PART_LINK = re.compile(r"(?:^|[^\w])[cm]id:", re.I)
_BETWEEN_IDS = re.compile(r"[^\s<>]*(?:>|&gt;)?[\s>|,]*(?:<|&lt;)?[\s]*[^\s<>]*\Z")

#: Whatever may hold a telephone or identity number.
_DIGITS = re.compile(r"[+(0-9][0-9(). /-]{4,}[0-9]")
PHONE = re.compile(
    r"(?<![\w.+@/=<-])(?:"
    r"(?:\+|00)1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}"
    r"|(?:\+|00)44 ?(?:\(0\) ?)?\d(?:[ -]?\d){9}"
    r"|(?:\+|00)33 ?(?:\(0\) ?)?\d(?:[ .-]?\d){8}"
    r"|(?:\+|00)49 ?(?:\(0\) ?)?(?:\d{2,5}[ /-]{0,3}\d{3,6}[ -]?\d{2,4})"
    r"|\+(?!1|44|33|49)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){2,4}"
    r"|\(0\d{1,4}\) ?\d{3,4}[ -]?\d{3,5}|\(\d{3}\) ?\d{3}[ .-]?\d{4}"
    r"|0\d{1,4} ?/ ?\d{3,6}[ -]?\d{2,4}"
    r"|0\d(?:[ .-]\d\d){4}|0\d\d \d{4} \d{4}|0\d{3} \d{3} \d{4}|0\d{4} \d{6}|0\d{10}"
    r"|\d{3}([.-])\d{3}\1\d{4}|\d{3} \d{3} \d{4}|1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}|1\d{10}"
    r")(?![\w@/]|[.-]\d|,\d)"
)

#: Shapes of identity numbers that few other numbers have: social security, tax, insurance, identity and passport numbers.
ID_SHAPE = re.compile(
    r"(?<![\w.+@/=<#-])(?:"
    r"\d{3}-\d\d-\d{4}|\d{3} \d\d \d{4}|\d\d \d{3} \d{3} \d{3}"
    r"|[A-Z]{2} \d\d \d\d \d\d [A-Z]|[A-Z]{2}\d{6}[A-Z]"
    r"|\d{8}-?[A-Z]|[A-Z]\d{8}|[A-Z]{2}\d{7}"
    r")(?![\w@/]|[-.,]\d)"
)
#: Shapes that many other numbers have count only right after one of ID_WORDS.
ID_GENERAL = re.compile(r"(?<![\w.+@/=<#-])(?:[A-Z]{1,3}[ -]?)?\d(?:[ .-]?\d){5,14}(?:[ -]?[A-Z])?(?![\w@/]|[-.,]\d)")
ID_WORDS = "secur sécur segur insuran passp passep pasap passapor steuer ausweis versicher sozial identit fiscal fiskal паспорт снилс 旅券 保険 番号".split()  # parts of words
ID_WHOLE_WORDS = ["tax", "taxpayer", "ssn", "nino", "dni", "nie", "nif", "nir", "cpf", "snils", "инн", "id no", "id number", "id card", "id nummer", "id-nummer"]
#: Between such a word and its number stand neither other numbers, sentences nor words for telephones; before a number of another kind stands one of OTHER_NUMBERS.
_LINK = re.compile(r"\.?(?:[^\d.;!?@\n]|\b(?:no|nr|num|n)\.)*[+(]?\Z", re.I)
PHONE_WORDS = ["tel", "telefon", "telephone", "telefono", "teléfono", "téléphone", "telefone", "phone", "fax", "mobile", "mobil", "móvil", "handy", "cell", "call", "ruf", "appel", "тел", "телефон", "電話"]
_PHONE_LINK = re.compile(r"[\s.:()-]*(?:(?:no|nr|number|nummer|is|ist|est|es|é|at|on|unter|au|al)[\s.:]+)?[+(]?\Z", re.I)
PHONE_GENERAL = re.compile(r"(?<![\w.+@/=<-])\+?\(?\d(?:[ ()./-]{0,2}\d){6,14}(?![\w@/]|[.-]\d|,\d)")
OTHER_NUMBERS = re.compile(
    r"\b(?:order|purchase|invoice|catalog(?:ue)?|lot|batch|ticket|serial|part|article|tracking|shipment|delivery|item|sku|bestell|auftrags?|rechnungs?|artikel|liefer|serien|chargen|facture|commande|colis|pedido|factura|referencia|lote|encomenda|fatura|заказ|накладн)\w*"
    r"\W{0,3}(?:no|nr|num|number|nummer|code|id|n°|nº|№|#)?\W{0,3}\Z",
    re.I,
)

_NUMBER = r"\d{1,4}(?:[a-hA-H](?!\w)|\s?(?:bis|ter|quater)\b)?"
_WORD = r"[A-ZÀ-ÖØ-ÞŠŽ][\w'’-]*"
_OF = r"(?: (?:de la|de los|de las|del|des|du|dos|das|do|da|de|di|della))?"
#: Words for streets: at the end after the number, before the name after the number, before name and number, at the end of the name.
STREETS = {
    "after": "Street St Avenue Ave Road Rd Lane Ln Drive Dr Close Terrace Way Court Ct Crescent Place Pl Square Sq Row Walk Hill Grove Gardens Mews Parade Boulevard Blvd".split(),
    "rue": "rue avenue boulevard impasse allée place chemin quai cours passage route square ruelle".split(),
    "calle": "Calle Plaza Avenida Paseo Camino Carrera Ronda Travesía Rua Praça Travessa Largo Alameda Estrada Via Viale Piazza Corso".split(),
    "strasse": "straße strasse str. gasse weg allee platz ring damm ufer steig pfad zeile chaussee".split(),
}
_CAPITALISED = re.compile(_WORD)
_HOUSE = re.compile(rf"(?<![\w.,:/#-]){_NUMBER},?\Z")
_BEFORE_RUE = re.compile(rf"(?<![\w.,:/#-]){_NUMBER},? \Z")
_AFTER_RUE = re.compile(rf"{_OF} (?:[dl]['’])?{_WORD}(?:-{_WORD})*")
_AFTER_CALLE = re.compile(rf"{_OF} {_WORD}(?: {_WORD})*+,? {_NUMBER}(?!\w)")
_AFTER_STRASSE = re.compile(rf" {_NUMBER}(?!\w)")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜ"

#: What stands in names of organisations after a personal name: legal forms, and words for what such an organisation is or does.
LEGAL_FORMS = "Ltd Limited GmbH AG KG OHG SE Inc Incorporated LLC LLP Co Corp Corporation Company PLC SA SARL SAS SL SRL SpA BV NV AB Oy ApS Ltda Lda".split()
ORGANISATION_WORDS = (
    "Institute Institut Instituto Istituto University Universität Université Universidad College School Schule Hochschule Lycée Academy Akademie Hospital Klinik Clinic Clinique Clínica "
    "Laboratory Laboratories Laboratoires Laboratorios Labs Foundation Stiftung Fondation Fundación Fundação Trust Society Société Association Verein Museum Library Bibliothek Theatre Gallery "
    "Group Gruppe Groupe Grupo Holding Holdings Partners Associates Consulting Consultants Advisors Solutions Services Systems Technologies Software Industries Works Werke Products Supplies Supply "
    "Logistics Logistik Freight Shipping Transport Transports Couriers Spedition Trading Handel Imports Exports Reagents Chemicals Pharma Pharmaceuticals Biotech Diagnostics Instruments Devices "
    "Bank Insurance Capital Ventures Media Press Verlag Publishing Books Motors Foods Travel Hotel Restaurant Bakery Brothers Bros Sons Söhne Fils Frères Hijos Hermanos Filhos Irmãos Stores Shop"
).split()
ORGANISATION = re.compile(
    rf" (?:(?:&|&amp;) {_WORD}|(?:(?:&|&amp;|and|und|et|y|e) )?(?:{_WORD} ){{0,2}}(?:{'|'.join(LEGAL_FORMS)})(?!\w)|(?:(?:&|&amp;|and|und|et|y|e) )?(?=[A-ZÀ-Þ])(?i:{'|'.join(ORGANISATION_WORDS)})(?!\w))"
)
_BETWEEN = re.compile(r" (?:[^\W\d_]\.? )?")

TYPES = ("email", "phone", "id_number", "address", "name")


class Meant:
    """A text as it is meant, and where each part of it stands in the source."""

    def __init__(self, source: str) -> None:
        self.source = self.text = source
        self.steps: list[tuple[list[int], list[int], list[int], list[int]]] = []

    def rewrite(self, pattern: re.Pattern, meaning) -> None:
        """One transducer: replace the matches of a pattern by their meaning, where they have one."""
        self.replace((*m.span(), new) for m in pattern.finditer(self.text) if (new := meaning(m)) is not None)

    def replace(self, spans: Iterable[tuple[int, int, str]]) -> None:
        """Replace spans, in order and without overlaps; the starts and ends of both sides are kept."""
        text, out, at, done = self.text, [], 0, 0
        starts, ends, from_, to = [], [], [], []
        for a, b, new in spans:
            out.append(text[done:a])
            at += a - done
            starts.append(at)
            from_.append(a)
            out.append(new)
            at += len(new)
            ends.append(at)
            to.append(b)
            done = b
        if starts:
            out.append(text[done:])
            self.text = "".join(out)
            self.steps.append((starts, ends, from_, to))

    def source_span(self, start: int, stop: int) -> tuple[int, int]:
        """Back through all steps; a span that touches a rewritten part takes all of its source."""
        for starts, ends, from_, to in reversed(self.steps):
            k = bisect_right(starts, start) - 1
            if k >= 0:
                # an empty meaning right before the span isn't part of it
                start = from_[k] if start < ends[k] else to[k] + start - ends[k]
            k = bisect_right(starts, stop - 1) - 1
            if k >= 0:
                stop = to[k] if stop - 1 < ends[k] else to[k] + stop - ends[k]
        return start, stop


def _break(m: re.Match) -> str:
    """A single line break, with the quote marks of the next line, is a space; a paragraph or a base64 block stays a break."""
    return " " if m.lastgroup is None and m.group().count("\n") <= 1 else "\n"


def _odd(m: re.Match) -> str:
    c = m.group()
    return " " if c.isspace() else chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else ""


def _spelled(m: re.Match) -> str | None:
    """Spelled digits as digits, if there are enough of them; ten are grouped the way telephone numbers are."""
    words = re.split(r"[ ,-]+", m.group().lower())
    digits = "".join(DIGIT_OF.get(w, w) for w in words)
    if sum(w in DIGIT_OF for w in words) < _LEAST_SPELLED or not _LEAST_DIGITS <= len(digits) <= _MOST_DIGITS:
        return None
    return f"{digits[:3]}-{digits[3:6]}-{digits[6:]}" if len(digits) == 10 else digits


def _disguised(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, stop, address) of addresses with at or dot in words or brackets; only whole addresses are rewritten.

    The sign decides what host may follow: a bracketed at any host, a bare word or @ one with disguised dots, a word in
    capitals also one with plain dots.
    """
    done = 0
    for m in _AT.finditer(text):
        if m.start() < done:
            continue
        at = _SPACES.match(text, m.end()).end()
        hosts = [h for p in (_BRACKET_HOST, _WORD_HOST) if (h := p.match(text, at)) and len(last := _ANY_DOT.split(h.group())[-1]) > 1 and last.isalpha()]
        host = max(hosts, key=lambda h: h.end(), default=None)
        if host is None:
            continue
        worded = host.re is _WORD_HOST
        plain = not worded and _BRACKET_HOST_DOT.search(host.group()) is None
        capitals = (m["word"] or "x").isupper()
        if plain and not m["bracket"] and not capitals:
            continue
        local = (_TURNED_WORD_LOCAL if worded else _TURNED_LOCAL).match(text[done : m.start()][::-1])
        done = host.end()
        if local and not (plain and capitals and not m["bracket"] and local.group(1).isupper()):
            name = _ANY_DOT.sub(".", local.group(1)[::-1])
            yield m.start() - local.end(), host.end(), f"{name}@{_ANY_DOT.sub('.', host.group())}"


def meant(source: str) -> Meant:
    out = Meant(source)
    if "=\n" in source or "=\r\n" in source:
        out.rewrite(_SOFT, lambda m: "")
    out.rewrite(_BREAKS, _break)
    if not source.isascii():
        out.rewrite(_ODD, _odd)
        if _HAS_MARKS.search(source):
            out.rewrite(_MARKED, lambda m: unicodedata.normalize("NFC", m.group()))
        if _HAS_LOOKALIKES.search(source):
            out.rewrite(_LOOKS, lambda m: "".join(LOOKALIKES[c] for c in m.group()))
    if _AT_HINT.search(out.text):
        out.replace(_disguised(out.text))
    return out


def _lower(text: str) -> str:
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is two characters
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return lower


def _run_start(text: str, stop: int, other: re.Pattern) -> int:
    """Where the run of characters before stop begins that `other` doesn't match, however long it is."""
    size = 64
    while True:
        low = max(0, stop - size)
        if m := other.search(text[low:stop][::-1]):
            return stop - m.start()
        if not low:
            return 0
        size *= 4


def _local_part(text: str, at: int) -> str:
    """What stands before an @: dots inside, but not at the ends and not two together."""
    local = text[_run_start(text, at, _NOT_LOCAL) : at]
    return "" if local.endswith(".") else local.rsplit("..", 1)[-1].lstrip(".")


def _is_identifier(text: str, start: int) -> bool:
    """True for what follows the name of an identifying header or a link to a part."""
    token = _run_start(text, start, _NOT_TOKEN)
    if _PART_LINK.search(text[token:start]):
        return True
    before = text[max(0, token - 1) : token]
    stop = _run_start(text, token - (before == "<"), _NOT_SPACE)
    lead = text[max(0, stop - 16) : stop].lower()
    if not lead.endswith(":"):
        lead = text[token : start].lower()
        lead = lead[: -len("&lt;")] if lead.endswith("&lt;") else lead
    return lead.rstrip(": \t").endswith(_ID_HEADERS) and ":" in lead


def _goes_on(view: Meant, start: int, stop: int) -> bool:
    """False for a name alone on its line, as in a signature: what follows on the next line isn't part of it."""
    a, b = view.source_span(stop, stop + 1)
    if "\n" not in view.source[a:b]:
        return True
    first, _ = view.source_span(start, stop)
    return view.source[_run_start(view.source, first, _BREAK) : first].strip(" \t>|-") != ""


class Finder:
    """Finds items of one text. One automaton looks for parts of names, words for streets and pairs of spelled digits."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        import ahocorasick

        kinds: dict[str, set[str]] = {}
        for part, kind in names:
            if part and part.strip():
                kinds.setdefault(unicodedata.normalize("NFC", part.strip()).lower(), set()).add(kind)
        for group, words in STREETS.items():
            for word in words:
                kinds.setdefault(word.lower(), set()).add(group)
        for first in DIGIT_OF:
            for second in DIGIT_OF:
                for between in (" ", "-", ", ", ","):
                    kinds.setdefault(f"{first}{between}{second}", set()).add("digits")
        for word in ID_WORDS:
            kinds.setdefault(word, set()).add("id")
        for word in ID_WHOLE_WORDS:
            kinds.setdefault(word, set()).add("id word")
        for word in PHONE_WORDS:
            kinds.setdefault(word, set()).add("phone word")
        self.anchors = ahocorasick.Automaton()
        for part, of in kinds.items():
            self.anchors.add_word(part, (len(part), frozenset(of)))
        self.anchors.make_automaton()

    def emails(self, text: str) -> Iterator[tuple[int, int]]:
        at, hidden = text.find("@"), -1
        while at >= 0:
            stop = at + 1
            if (domain := _DOMAIN.match(text, at)) and (local := _local_part(text, at)):
                start, stop = at - len(local), domain.end()
                chained = hidden >= 0 and _BETWEEN_IDS.match(text[hidden:start]) is not None
                if chained or _is_identifier(text, start):
                    hidden = stop
                else:
                    hidden = -1
                    if text[start - 1 : start] not in ("@", "/", "="):
                        yield start, stop
            at = text.find("@", stop)

    def numbers(self, text: str, words: list[tuple[int, str]]) -> Iterator[tuple[int, int, str]]:
        """Telephone and identity numbers: by their shape, or by the last of words (end, kind) if it leads to them."""
        for run in _DIGITS.finditer(text):
            a, b = run.span()
            low, high = max(0, a - 4), min(b + 5, len(text))
            k = bisect_right(words, (a, "~")) - 1
            led = words[k][1] if k >= 0 and (_LINK if words[k][1] == "id" else _PHONE_LINK).fullmatch(text, words[k][0], a) else ""
            taken: list[tuple[int, int]] = []
            free = lambda m: m is not None and all(m.end() <= x or y <= m.start() for x, y in taken)  # noqa: B023, E731
            if b - a >= 9:
                for m in PHONE.finditer(text, a, min(b + 3, len(text))):
                    taken.append(m.span())
                    yield m.start(), m.end(), "phone"
            if led == "id" and free(m := ID_GENERAL.search(text, low, high)):
                taken.append(m.span())
                yield a if words[k][0] > m.start() else m.start(), m.end(), "id_number"  # letters before the digits may be the word itself
            if led == "phone" and free(m := PHONE_GENERAL.search(text, max(0, a - 2), high)):
                taken.append(m.span())
                yield m.start(), m.end(), "phone"
            for m in ID_SHAPE.finditer(text, low, high):
                if free(m) and not OTHER_NUMBERS.search(text[_run_start(text, max(0, m.start() - 24), _SPACE) : m.start()]):
                    yield m.start(), m.end(), "id_number"

    @staticmethod
    def street_start(text: str, start: int, known: dict[int, int | None]) -> int | None:
        """Where a house number stands before the capitalised words before a street word; known: results of words already passed."""
        at, path = start, []
        while True:
            if text[at - 1 : at] != " " or at < 2:
                found = None
                break
            first = _run_start(text, at - 1, _SPACE)
            token = text[first : at - 1]
            if path and token.rstrip(",") in ("bis", "ter", "quater") and text[first - 1 : first] == " ":
                first = _run_start(text, first - 1, _SPACE)
                token = text[first : at - 1]
            if path and (m := _HOUSE.search(token)):
                listed = text[first - 2 : first] == ", " and text[first - 3 : first - 2].isdigit()
                found = None if listed and not m.start() else first + m.start()
                break
            if not _CAPITALISED.fullmatch(token):
                found = None
                break
            at = first
            if at in known:
                found = known[at]
                break
            path.append(at)
        known.update(dict.fromkeys(path, found))
        return found

    def anchored(self, view: Meant) -> tuple[list[tuple[int, int, str]], int, list[tuple[int, str]]]:
        """Addresses and names, the number of pairs of spelled digits, and the ends of words for identity or telephone numbers."""
        text, lower = view.text, _lower(view.text)
        found: list[tuple[int, int, str]] = []
        parts: list[tuple[int, int, frozenset]] = []
        known: dict[int, int | None] = {}
        digits, words = 0, []
        for last, (width, kinds) in self.anchors.iter(lower):
            start, stop = last + 1 - width, last + 1
            if "digits" in kinds:
                digits += 1
                continue
            if "id" in kinds:
                words.append((stop, "id"))
            before, after = lower[start - 1 : start], lower[stop : stop + 1]
            inside = after.isalnum() or after == "_"
            if "strasse" in kinds and not inside and (m := _AFTER_STRASSE.match(text, stop)):
                first = _run_start(text, start - (before == " "), _NOT_WORD)
                if first < start - (before == " ") and text[first] in _UPPER and (text[start].islower() or not (before.isalnum() or before == "_")):
                    found.append((first, m.end(), "address"))
            if inside or before.isalnum() or before == "_":
                continue
            if "id word" in kinds or "phone word" in kinds:
                words.append((stop, "phone" if "phone word" in kinds else "id"))
            if "after" in kinds and text[start].isupper() and (first := self.street_start(text, start, known)) is not None:
                found.append((first, stop, "address"))
            if "rue" in kinds and (b := _BEFORE_RUE.search(text[max(0, start - 16) : start])) and (m := _AFTER_RUE.match(text, stop)):
                found.append((start - len(b.group()), m.end(), "address"))
            if "calle" in kinds and text[start].isupper() and (m := _AFTER_CALLE.match(text, stop)):
                found.append((start, m.end(), "address"))
            if "given" in kinds or "family" in kinds:
                parts.append((start, stop, kinds))
        k = 0
        while k + 1 < len(parts):
            (a, b, first), (c, d, second) = parts[k], parts[k + 1]
            if c < b:  # one part inside another: the longer counts
                del parts[k if b - a < d - c else k + 1]
                continue
            if c - b <= 4:
                gap = text[b:c]
                western = "given" in first and "family" in second and _BETWEEN.fullmatch(gap) is not None
                listed = "family" in first and "given" in second and gap in (", ", ",")
                mail = text[a - 1 : a] in ("@", ".", "-", "+") or text[d : d + 1] == "@" or (text[d : d + 1] in (".", "-", "+") and text[d + 1 : d + 2].isalnum())
                if (western or listed) and not mail and not (western and ORGANISATION.match(text, d) and _goes_on(view, a, d)):
                    found.append((a, d, "name"))
                    k += 2
                    continue
            k += 1
        return found, digits, words

    def spans(self, source: str) -> list[tuple[int, int, str]]:
        """(start, stop, type) in the source, in order and without overlaps; of overlapping items the one that starts first, then the longer counts."""
        view = meant(source)
        found, digits, words = self.anchored(view)
        if digits >= _LEAST_SPELLED - 1:
            view.rewrite(_SPELLED, _spelled)
            found, _, words = self.anchored(view)
        found += self.numbers(view.text, words)
        found += [(a, b, "email") for a, b in self.emails(view.text)]
        found.sort(key=lambda x: (x[0], -x[1]))
        out, reached = [], 0
        for a, b, kind in found:
            if a >= reached:
                reached = b
                out.append((*view.source_span(a, b), kind))
        return out


def as_written(item: str) -> str:
    """Lower case, letters and digits only."""
    return "".join(c for c in item.lower() if c.isalnum())


def _names(name_parts: DataFrame) -> list[tuple[str, str]]:
    """The lists of names: a fixed table that goes to every worker, so its size is checked."""
    rows = name_parts.select("name_part", "part_kind").where("name_part IS NOT NULL").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("name_parts has more than 100,000 names; it must fit into every worker")
    return [(r[0], r[1]) for r in rows]


def personal_items(documents: DataFrame, name_parts: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, pii_type, found), distinct: every item in every text, as written, lower case, letters and digits only.

    Null and empty texts have no items; whole texts are searched, base64 blocks excepted.
    """
    names = _names(name_parts)
    memo: dict[str, Finder] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = memo.setdefault("finder", Finder(names))
        for batch in batches:
            rows, kinds, items = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    for kind, item in dict.fromkeys((kind, as_written(t[a:b])) for a, b, kind in finder.spans(t)):
                        rows.append(k)
                        kinds.append(kind)
                        items.append(item)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(items, pa.string())], [ident, "pii_type", "found"])

    kind = documents.schema[ident].dataType.simpleString()
    return documents.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, pii_type string, found string").distinct()


def redacted(documents: DataFrame, name_parts: DataFrame, pii_types: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, text, n_items) of every row: each item replaced by the placeholder of its type; types without one stay. Null texts stay null."""
    names = _names(name_parts)
    kinds = pii_types.select("pii_type", "placeholder").where(F.col("pii_type").isin(*TYPES)).groupBy("pii_type").agg(F.max("placeholder"))
    placeholders = {r[0]: r[1] for r in kinds.collect()}  # one row for each of TYPES
    memo: dict[str, Finder] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = memo.setdefault("finder", Finder(names))
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(1).to_pylist():
                out, done, n = [], 0, 0
                for a, b, kind in finder.spans(t) if t else ():
                    if placeholders.get(kind) is not None:
                        out += [t[done:a], placeholders[kind]]
                        done, n = b, n + 1
                texts.append("".join([*out, t[done:]]) if t is not None else None)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], [ident, text, "n_items"])

    kind = documents.schema[ident].dataType.simpleString()
    return documents.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, `{text}` string, n_items int")
