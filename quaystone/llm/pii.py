"""Personal information inside free text: found by anchor expansion, replaced by typed placeholders."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from quaystone.llm.common import map_texts

KINDS = ("email", "phone", "id_number", "address", "person")

#: Anchors by what they announce: at-signs, schemes, identifier cues, street types, words before, after and around a name. Matched
#: without letter case. A blank at an end stands for the end of a word.
CUES = {
    "mail": ["@", "(at)", "[at]", "{at}", "(a)", " at "],
    "id": [
        "rijksregister", "nationaal nummer", "national number", "national no", "numéro national", "numero national", "registre national", "nationalnummer", "ausweis", "identity document", "passport", "paspoort", "passeport", "reisepass", "rijbewijs", "permis de conduire", "driving licence", "driving license",
        "führerschein", "social security", "ssn", "national insurance", "codice fiscale", "insz", "niss", "bsn",
    ],
    "prefix_type": [
        "rue ", "avenue ", "av. ", "boulevard ", "boul. ", "bd ", "bd. ", "place ", "quai ", "chaussée ", "chaussee ", "chaussã©e ", "impasse ", "allée ", "allee ", "allã©e ", "chemin ", "route ", "square ", "cours ", "passage ", "ruelle ", "clos ", "sentier ", "venelle ", "esplanade ", "faubourg ", "drève ", "drã¨ve ",
        "cité ", "citã© ", "résidence ", "rã©sidence ", "rond-point ", "via ", "viale ", "piazza ", "corso ", "vicolo ", "calle ", "avenida ", "avda. ", "plaza ", "paseo ", "rua ", "travessa ", "ulica ", "ul. ",
    ],
    "suffix_type": [
        "straat", "str.", "laan", "weg", "dreef", "plein", "lei", "kaai", "kade", "baan", "hof", "gracht", "singel", "dijk", "markt", "vest", "straße", "strasse", "straãÿe", "straÿe", "gasse", "platz", "allee", "ufer", "damm", "chaussee", "ring", "steig", "stiege",
    ],
    "german_way": ["am ", "an der ", "an den ", "im ", "in der ", "in den ", "zum ", "zur ", "auf dem ", "auf der ", "unter den ", "unter der ", "hinter dem ", "hinter der ", "beim ", "bei der ", "vor dem "],
    "english_type": [
        " street", " st", " road", " rd", " lane", " ln", " close", " terrace", " way", " avenue", " ave", " drive", " court", " square", " row", " hill", " gardens", " crescent", " place", " mews", " walk", " grove", " quay", " yard", " parade", " green", " park", " gate", " wharf", " rise", " view", " vale",
    ],
    "residence": [
        "woon ", "woont ", "wonend ", "wonende ", "wohne ", "wohnt ", "wohnhaft ", "habite ", "habitant ", "demeurant ", "domicilié ", "domiciliée ", "live at ", "lives at ", "living at ", "live in ", "lives in ", "residing at ", "resides at ", "address:", "address is ", "adres:", "adres is ", "adresse:", "adresse :", "adresse est ", "anschrift:",
    ],
    "signed": [
        "contact:", "contact :", "kontakt:", "kontakt :", "getekend", "gezeichnet", "signed", "signé", "from:", "to:", "cc:", "von:", "van:", "aan:", "an:", "author:", "auteur:", "auteur :", "autor:", "name:", "naam:", "nom:", "nom :", "attn:", "t.a.v.", "z. hd.",
        "regards,", "sincerely,", "cheers,", "yours truly,", "groeten,", "groet,", "hoogachtend,", "cordialement,", "salutations,", "bien à vous,", "grüßen,", "grüßen\n", "grüße,", "hochachtungsvoll,",
    ],
    "spoke": [
        "spraken met", "spoke with", "spoke to", "speak to", "speak with", "parlé avec", "parlé à", "sprachen mit", "gesproken met", "gesprochen mit", "spreken met", "parler à", "sprechen mit", "please reach", "please contact", "please call", "please ask", "contacteer", "contactez", "veuillez contacter", "kontaktieren sie",
        "met with", "on behalf of", "namens", "au nom de", "im namen von", "my colleague", "my manager", "my brother", "my sister", "my friend", "my neighbour", "my neighbor", "my husband", "my wife", "my son", "my daughter", "our colleague", "mijn collega", "onze collega", "mon collègue", "ma collègue", "notre collègue", "mein kollege", "meine kollegin", "unser kollege", "unsere kollegin",
    ],
    "title": [
        "mevr.", "mevrouw", "dhr.", "de heer", "meneer", "m.", "mme", "mlle", "madame", "monsieur", "mr", "mrs", "ms", "miss", "dr", "prof", "frau", "herr", "sir", "señor", "señora", "sig.", "signora", "pan", "pani",
        "claimant", "treinbegeleider", "accompagnateur", "accompagnatrice", "zugbegleiter", "zugbegleiterin", "conductor,", "conductor", "doctor", "docteur", "doktor",
        "name is", "naam is", "nom est", "m'appelle", "m’appelle", "ich heiße", "name ist", "ik heet", "handed in by", "signed by", "written by", "reported by", "afgegeven door", "opgesteld door", "gemeld door", "remise par", "remis par", "rédigé par", "signé par", "abgegeben von", "verfasst von", "gemeldet von",
        "person is", "contactpersoon is", "personne de contact est", "personne de référence est", "ansprechpartner ist", "ansprechpartnerin ist",
    ],
    "subject": [
        " saw ", " told ", " said ", " says ", " wrote ", " asked ", " phoned ", " explained ", " complained ", " can be reached", " is reachable", " zag ", " zei ", " zegt ", " schreef ", " vroeg ", " belde ", " klaagde ", " is bereikbaar", " a vu ", " a dit ", " a écrit ", " a demandé ", " a expliqué ", " a déclaré ", " est joignable",
        " sah ", " sagte ", " schrieb ", " fragte ", " erklärte ", " ist erreichbar", " ist unter ",
    ],
}

_BLANK = r"[ \t  ]"
#: A letter, also one of UTF-8 read as a single-byte code page.
_LET = r"(?:[ÃÂ][\u0080-¿‰€‚ƒ„…†‡ˆŠ‹ŒŽ‘“”•–—˜™š›œžŸ]|\p{L}\p{M}*)"
_NAME_WORD = rf"{_LET}(?:{_LET}|['’]|­|​)*(?:[-‐‑]{_LET}(?:{_LET}|['’])*)*"
_TOKEN = regex.compile(rf"(?P<initial>\p{{Lu}}\.(?:-?\p{{Lu}}\.)*)|(?P<word>{_NAME_WORD})")
_GAP = regex.compile(rf"{_BLANK}+|{_BLANK}*\r?\n(?!{_BLANK}*\r?\n)")
_PARTICLES = {"van", "von", "vom", "de", "der", "den", "ter", "ten", "te", "du", "des", "le", "la", "zu", "zum", "zur", "op", "'t", "el", "al", "da", "di", "dos"}
#: Ordinary words that stand where a name in small letters might.
_NO_NAME = {
    "the", "de", "het", "een", "la", "le", "les", "une", "un", "der", "die", "das", "ein", "eine", "an", "a", "en", "et", "and", "und", "id", "ausweis", "carte", "kaart", "card", "is", "est", "ist", "was", "with", "met", "avec", "mit", "our", "ons", "notre", "unser",
    "on", "at", "in", "by", "who", "who's", "that", "dat", "que", "qui", "contact", "kontakt", "signed", "signé", "getekend", "gezeichnet", "mail", "tel", "gsm", "unit", "train", "trein", "zug", "flat",
    "mme", "mlle", "mevr", "mevrouw", "dhr", "heer", "meneer", "mr", "mrs", "ms", "miss", "dr", "prof", "frau", "herr", "madame", "monsieur", "claimant", "conductor", "treinbegeleider", "zugbegleiter", "zugbegleiterin",
    "l'accompagnateur", "l’accompagnateur", "l'accompagnatrice", "every", "each", "le", "dernier",
    "my", "his", "her", "your", "their", "this", "that", "some", "someone", "nobody", "everyone", "i", "we", "he", "she", "they", "it", "you", "mijn", "zijn", "haar", "onze", "deze", "iemand", "niemand", "ik", "wij", "hij", "zij", "mon", "ma", "mes", "son", "sa", "votre", "ce", "cette", "nous", "il", "elle", "ils", "mein", "meine", "sein",
    "seine", "ihr", "ihre", "unsere", "dieser", "jemand", "ich", "er", "sie", "wir", "please", "us", "ons", "uns",
}
_AFTER_NAME = regex.compile(r"\s*(?:[(<\[,.;:\n\r]|$|en\b|et\b|and\b|und\b|is\b|est\b|ist\b|a\b|hat\b|zag\b|maakte\b|told\b|left\b|sah\b|saw\b|filed\b|in\b|à\b|on\b|op\b|auf\b|sur\b|at\b|bei\b|bij\b)", regex.I)


def _is_name_word(word: str, relaxed: bool) -> bool:
    low = word.lower()
    if low in _NO_NAME or len(word) < 2:
        return False
    if relaxed:
        return True
    return word[0].isupper() or bool(regex.match(r"[dol]['’]\p{Lu}", word))


def parse_name(text: str, at: int, relaxed: bool = False) -> int | None:
    """End of the human name that begins at ``at``: given name or initials and surname, surname comma given name, or surname given name."""
    parts: list[str] = []  # I initial, P particle, W word
    pos, end, comma = at, None, False
    while parts[-5:] != ["P"] * 5:
        m = _TOKEN.match(text, pos)
        if m is None:
            break
        if m["initial"]:
            kind = "I"
        else:
            low = m["word"].lower()
            kind = "P" if low in _PARTICLES and not (comma and "W" in parts) else "W"
            if kind == "W" and not _is_name_word(m["word"], relaxed):
                break
        if comma and kind == "P":
            break
        parts.append(kind)
        words = parts.count("W")
        if comma:
            return m.end()
        if kind == "W" and (words == 2 or (words == 1 and parts[0] == "I")):
            return m.end()
        pos = m.end()
        if kind == "W" and words == 1 and text.startswith(",", pos):
            gap = _GAP.match(text, pos + 1)
            nxt = _TOKEN.match(text, gap.end() if gap else pos + 1)
            if not nxt or not (nxt["initial"] or _is_name_word(nxt["word"], relaxed)) or (nxt["word"] or "").lower() in _PARTICLES:
                break
            comma, pos = True, nxt.start()
            continue
        if kind == "I" and words == 1 and parts[0] != "W" and parts[0] != "I":
            return m.end()  # particles surname initial
        gap = _GAP.match(text, pos)
        if kind == "W" and words == 1 and gap and (nxt := _TOKEN.match(text, gap.end())) and nxt["initial"]:
            after = _GAP.match(text, nxt.end())
            follow = _TOKEN.match(text, after.end()) if after else None
            if not (follow and (follow["initial"] or follow["word"].lower() in _PARTICLES or _is_name_word(follow["word"], relaxed))):
                return nxt.end()  # surname initial
        if gap is None:
            break
        pos = gap.end()
    return end


_NUMBER = r"\d{1,4}(?:[A-Za-z](?![\p{L}\d]))?(?:[-/]\d{1,4}[A-Za-z]?(?![\p{L}\d])){0,2}(?: (?:bis|ter|quater)(?!\p{L}))?"
_BOX = r"(?:,? (?:bus|bte\.?|boîte|box|appt?\.?|apt\.?|Wohnung|Whg\.?|postbus) ?[\p{L}\d]{1,4}(?![\p{L}\d]))?"
_CAP = rf"(?!J['’]habite)(?=\p{{Lu}}|[ÃÂ]){_LET}(?:{_LET}|['’])*(?:[-‐]{_LET}(?:{_LET}|['’])*)*"
_PLACE = rf"(?=\p{{Lu}}|[ÃÂ]){_LET}+(?:['’-]{_LET}+)*(?: (?:(?:am|an der|aan de|aan den|op de|sur|sous|lez|les|upon|on|de|la|le) )?(?=\p{{Lu}}){_LET}+(?:['’-]{_LET}+)*(?![\p{{L}}:])){{0,2}}"
_JOIN = rf"(?:{_BLANK}*,{_BLANK}*|{_BLANK}+[-–]{_BLANK}+|{_BLANK}*,?{_BLANK}*\r?\n{_BLANK}*|{_BLANK}+)"
_POSTAL = rf"(?:{_JOIN}(?:[A-Z]{{1,3}}[-–] ?)?\d{{4,5}}{_BLANK}+{_PLACE})?"
_BRITISH = rf"(?:{_JOIN}{_PLACE}{_BLANK}+[A-Z]{{1,2}}\d[A-Z\d]?{_BLANK}?\d[A-Z]{{2}}(?![\p{{L}}\d])|{_JOIN}(?:[A-Z]{{1,3}}[-–] ?)?\d{{4,5}}{_BLANK}+{_PLACE}|(?:,{_BLANK}*|{_BLANK}+[-–]{_BLANK}+){_PLACE})?"
_FRENCH_TYPE = r"(?i:rue|avenue|av\.|boulevard|boul\.|bd\.?|place|quai|chauss\P{Zs}{1,2}e|impasse|all\P{Zs}{1,2}e|chemin|route|square|cours|passage|ruelle|clos|sentier|venelle|esplanade|faubourg|drève|cité|résidence|rond-point|(?-i:V)ia|(?-i:V)iale|(?-i:P)iazza|(?-i:C)orso|(?-i:V)icolo|(?-i:C)alle|(?-i:A)venida|(?-i:A)vda\.|(?-i:P)laza|(?-i:P)aseo|(?-i:R)ua|(?-i:T)ravessa|ulica|ul\.)"
_FRENCH_NAME = rf"(?: (?:de la|de l['’]|de|du|des|d['’]|aux?|à la|la|le|les|l['’]))*(?: ?{_CAP})(?: (?:(?:de la|de|du|des|d['’]|aux?|et|la|le|les|sur|en) )*{_CAP}){{0,3}}"
_NL_DE_SUFFIX = r"(?:[Ss]traat|[Ss]tr\.|[Ll]aan|[Ww]eg|[Dd]reef|[Pp]lein|[Ll]ei|[Kk]aai|[Kk]ade|[Ss]teenweg|[Bb]aan|[Hh]of|[Gg]racht|[Ss]ingel|[Dd]ijk|[Mm]arkt|[Vv]est|[Ss]tra(?:ß|ss|ÃŸ|Ÿ)e|[Gg]asse|[Pp]latz|[Aa]llee|[Uu]fer|[Dd]amm|[Cc]haussee|(?<!k)[Rr]ing|[Ss]teig|[Ss]tiege)"
_EN_TYPE = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Close|Terrace|Way|Avenue|Ave\.?|Drive|Court|Square|Row|Hill|Gardens|Crescent|Place|Mews|Walk|Grove|Quay|Yard|Parade|Green|Park|Gate|Wharf|Rise|View|Vale)"

_CAP_WORD = regex.compile(_CAP)
_TAIL = rf"{_NUMBER}{_BOX}{_POSTAL}"
_SUFFIX_TAIL = regex.compile(_TAIL)
#: rue du Lac 12, 1000 Place / 12 bis, rue du Lac, 1000 Place
_PREFIX_FORMS = (regex.compile(rf"{_FRENCH_TYPE}{_FRENCH_NAME},?{_BLANK}+{_TAIL}"), regex.compile(rf"{_NUMBER},?{_BLANK}+{_FRENCH_TYPE}{_FRENCH_NAME}{_BOX}{_POSTAL}"))
_GERMAN_WAY = regex.compile(rf"(?:Am|An der|An den|Im|In der|In den|Zum|Zur|Auf dem|Auf der|Unter den|Unter der|Hinter dem|Hinter der|Beim|Bei der|Vor dem){_BLANK}+{_CAP}(?:{_BLANK}+{_CAP})?{_BLANK}+{_TAIL}")
_FLAT = rf"(?:Flat|Unit|Apt\.?|Apartment|Suite|Room|Floor){_BLANK}+[\p{{L}}\d]{{1,4}},?{_BLANK}+"
_ENGLISH = regex.compile(rf"(?:{_FLAT})?{_NUMBER},?{_BLANK}+(?:{_CAP}{_BLANK}+){{1,4}}{_EN_TYPE}(?!\p{{L}}){_BRITISH}")
#: What stands before: a number that ends there, a flat that ends there.
_NUMBER_BEFORE = regex.compile(rf"(?<![\p{{L}}\d.,/-]){_NUMBER},?{_BLANK}+$")
_FLAT_BEFORE = regex.compile(rf"(?<!\p{{L}}){_FLAT}$")
#: Where somebody lives, any capitalised name with a number is an address, and so is a place on the next line.
_AT_HOME = regex.compile(rf"[ :]*(?:(?:in de|in het|op de|op het|aan de|aan het|au|à la|à|in der|im|in|an der|am|at|on) )?(?P<a>(?:{_FLAT})?{_NUMBER},?{_BLANK}+{_CAP}(?:{_BLANK}+{_CAP}){{0,4}}{_BRITISH}|(?!{_FLAT})(?:{_CAP}{_BLANK}+){{1,5}}{_TAIL})(?P<next>{_BLANK}*,?{_BLANK}*\r?\n{_BLANK}*(?P<place>{_PLACE}))?")
#: Words that begin a sentence, not a place.
_NO_PLACE = {"the", "a", "an", "and", "in", "on", "at", "i", "we", "he", "she", "they", "it", "my", "our", "de", "het", "een", "ik", "wij", "le", "la", "les", "un", "une", "je", "nous", "der", "die", "das", "ein", "eine", "ich", "wir", "please", "contact", "tel", "mail", "phone", "signed"}

_EMAIL = regex.compile(
    rf"(?P<local>[\p{{L}}\d](?:[\p{{L}}\d._%+'’-]*[\p{{L}}\d_+-])?)(?P<at>{_BLANK}*(?:@|\(at\)|\[at\]|\{{at\}}|\(a\)){_BLANK}*|{_BLANK}+(?:AT|at){_BLANK}+)(?P<domain>[\p{{L}}\d](?:[\p{{L}}\d-]*[\p{{L}}\d])?(?:(?P<dot>{_BLANK}*(?:\[dot\]|\(dot\)|\{{dot\}}|\[punt\]|\[point\]|\(point\)|\(punt\)){_BLANK}*|{_BLANK}+(?:DOT|dot){_BLANK}+|\.)[\p{{L}}\d](?:[\p{{L}}\d-]*[\p{{L}}\d])?)+)",
    regex.I,
)

_EXT = rf"(?:{_BLANK}*,?{_BLANK}*(?:ext\.?|extension|x|poste|toestel|tst\.?|Durchwahl|DW|app\.){_BLANK}*\d{{1,6}})?"
_PHONE = regex.compile(
    r"(?<![\p{L}\d.+/<-])(?:"
    r"(?:\+|00)[ ]?\d{1,3}(?:[ .\-/]?\(0\))?(?:[ .\-/]{0,1}\(?\d{1,5}\)?){1,7}"
    r"|\(\d{2,5}\)[ .\-]?\d{2,5}(?:[ .\-/]?\d{2,5}){1,4}"
    r"|[2-9]\d{2}[ .\-]\d{3}[ .\-]\d{4}"
    r"|1[ .\-]\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}"
    r"|0\d{1,4}[ ./\-]?\d{2,6}(?:[ .\-/]?\d{2,5}){0,4}"
    rf"){_EXT}(?![\p{{L}}\d]|[./-]\d)",
    regex.I,
)
#: Words right before a number, or one or two short words earlier, that make it a phone number; words that make it none.
_PHONE_WORDS = {"tel", "tél", "tã©l", "telefon", "telefoon", "telefoonnummer", "telefonnummer", "telephone", "téléphone", "gsm", "phone", "mobile", "mobil", "handy", "fax", "ring", "bel", "bellen", "appel", "appelez", "appeler", "call", "anruf", "anrufe", "anrufen", "rufen", "bereikbaar", "joignable", "reachable", "erreichbar", "nummer", "number", "numéro", "numero", "or", "of", "ou", "oder"}
_NO_PHONE_WORDS = {"token", "ticket", "dossier", "reference", "référence", "referentie", "version", "versie", "case", "zaak", "vorgang", "invoice", "factuur", "facture", "rechnung", "iban", "code", "key", "order", "commande", "bestelling", "account", "konto", "rekening", "compte", "row", "rij", "ligne", "zeile"}
_NUMBER_WORDS = {"n", "no", "nr", "nor", "ro"}
_WORDS = re.compile(r"[^\W\d_]+")
#: A run of digits, with what may stand between them.
_RUN = re.compile(r"\d(?:[ .\-/()<A-Z]{0,4}\d)+")
_PHONE_START = re.compile(r"[+(]|(?<!\d)\d")
_IBAN = regex.compile(r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?:[ -]?[A-Z\d]{4}){2,7}(?:[ -]?[A-Z\d]{1,4})?(?![\p{L}\d])")
_PAN = regex.compile(r"(?<![\p{L}\d.,/+-])\d(?:[ -]?\d){12,18}(?![\p{L}\d]|[.,/-]\d)")

_BIRTH = r"(?:\d{2}\.\d{2}\.\d{2}{b}?-{b}?\d{3}[.\-]\d{2}|\d{6}{b}?-{b}?\d{3}{b}?[-.]{b}?\d{2}|\d{2} \d{2} \d{2} \d{3} \d{2}|\d{11})".replace("{b}", _BLANK)
_CARD = r"(?:(?P<ssn>\d{3}-\d{2}-\d{4})|\d{3}-\d{7}-\d{2}|B \d{3} \d{6,7} \d{2}|[A-Z]{2}\d{7}<\d|[A-Z]\d{2}X\d{3}Z\d{2}|[A-Z]{2}\d{6,7})"
_ID = regex.compile(rf"(?<![\p{{L}}\d./<-])(?:(?P<birth>{_BIRTH})|(?P<card>{_CARD}))(?![\p{{L}}\d<]|[./-]\d)")
#: Shapes that are id numbers without a label.
_ID_PLAIN = regex.compile(r"\d{2}\.\d{2}\.\d{2} ?- ?\d{3}\.\d{2}|\d{3}-\d{7}-\d{2}|B \d{3} \d{6,7} \d{2}|[A-Z]{2}\d{7}<\d|[A-Z]\d{2}X\d{3}Z\d{2}|\d{6}-\d{3}-\d{2}")
_ID_LABEL = regex.compile(
    r"(?:rijksregister(?:nummer|nr\.?)?|nationaal (?:nummer|nr\.?)|national (?:number|no\.?|id)|num[eé]ro national|registre national|national-?nummer|(?:personal)?ausweis(?:nummer|nr\.?)?|(?:identiteits)?kaart|carte(?: d['’]identité)?|(?:id|identity|lost)? ?card|id|identity document|identiteit(?:sbewijs)?|"
    r"pass(?:port|eport)|paspoort|reisepass|rijbewijs|permis(?: de conduire)?|(?:driving )?licen[cs]e|f(?:ü|Ã¼)hrerschein|insz|niss|bsn|ssn|social security|numÃ©ro national)(?: (?:no|nr|nummer|number|n°)\.?)?[\s:#°.]*$",
    regex.I,
)
_ID_NAMED = regex.compile(r"(?i)(?:social security|passport|paspoort|passeport|reisepass|rijbewijs|permis de conduire|driving licence|führerschein|rijksregisternummer|numéro national|national number|ausweisnummer|identity document)(?:nummer| (?:no|nr|n°|number|nummer)\.?)?[\s:]+")
_ID_ANY = regex.compile(r"[A-Z\d](?=[A-Z\d<.\- ]*\d)[A-Z\d<]*(?:(?: ?[.\-] ?| )[A-Z\d<]*\d[A-Z\d<]*)*")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    by_word: dict[str, list[str]] = {}
    for kind, words in CUES.items():
        for w in words:
            by_word.setdefault(w, []).append(kind)
    for w, kinds in by_word.items():
        out.add_word(w, (w, tuple(kinds)))
    out.make_automaton()
    return out


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


#: Signs that stand for a blank or a hyphen, character by character, so that places stay the same.
_PLAIN = {c: " " for c in (0xA0, 0x2007, 0x2009, 0x202F)} | {0x2011: "-"}


def _emails(text: str, low: str, hits: list[tuple[int, str]]) -> Iterator[tuple[int, int]]:
    """Each at-sign is expanded to the left over the local part, then the whole address is matched from there."""
    worded_dot = "dot" in low
    for after, cue in hits:
        if cue == " at " and not worded_dot and text[after - 4 : after] != " AT ":
            continue
        left = after - len(cue)
        while left > 0 and text[left - 1] in " \t":
            left -= 1
        while left > 0 and (text[left - 1].isalnum() or text[left - 1] in "._%+'’-"):
            left -= 1
        while left < after and not text[left].isalnum():
            left += 1
        m = _EMAIL.match(text, left)
        if m is None:
            continue
        local, at, start = m["local"], m["at"], m.start()
        worded = at.strip().lower() == "at"
        if worded and not (at.strip() == "AT" and regex.search(r"\bDOT\b|\.", m["domain"])) and not regex.search(r"\bdot\b", m["domain"], regex.I):
            continue
        if worded and at.strip() == "at" and "." in m["domain"] and not regex.search(r"\bdot\b", m["domain"], regex.I):
            continue
        top = regex.split(r"[^\p{L}\d-]+", m["domain"])[-1]
        if len(top) < 2 or not any(c.isalpha() for c in top) or not local:
            continue
        end = m.end()
        # A full stop that ends the sentence is followed by a capitalised word, not by a domain label.
        plain = regex.match(r"[^.\s]+(?:\.[\p{L}\d-]+)+?(?=\.\p{Lu}\p{Ll}+\b)", m["domain"])
        if plain and m["domain"] != m["domain"].upper():
            end = m.start("domain") + plain.end()
        yield start, end


class _Before:
    """The words before a place, however far away; the words of a text are found once, when first asked for."""

    def __init__(self, text: str, low: str):
        self.text, self.low, self.words = text, low, None

    def last(self, at: int) -> list[tuple[str, bool]]:
        """The last three words before ``at``, nearest first, each with whether a digit stands between it and what follows."""
        if self.words is None:
            self.words = [(m.start(), m.end()) for m in _WORDS.finditer(self.text)]
        k, out = bisect.bisect_left(self.words, (at, 0)) - 1, []
        for first, end in reversed(self.words[max(0, k - 2) : k + 1]):
            if end > at:
                continue
            while at > end and not self.text[at - 1].isdigit():  # ends at the nearest digit
                at -= 1
            out.append((self.low[first:end], at > end))
            at = first
        return out

    def no_phone(self, at: int) -> bool:
        words = [w for w, _ in self.last(at)]
        return bool(words) and (words[0] in _NO_PHONE_WORDS or len(words) > 1 and words[0] in _NUMBER_WORDS and words[1] in _NO_PHONE_WORDS)

    def phone(self, at: int) -> bool:
        for word, digit in self.last(at):
            if digit or word in _PHONE_WORDS:
                return not digit
            if len(word) > 5:
                return False
        return False


def _luhn(digits: str) -> bool:
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def _accounts(text: str, a: int, b: int) -> Iterator[tuple[int, int, bool]]:
    """Bank accounts and payment cards, and whether their check digits hold; the boundary is where they do."""
    for m in _IBAN.finditer(text, a, b + 48):  # no form is longer
        if m.start() >= b:
            break
        parts = m.group(0)
        for end in range(len(parts), 14, -1):
            raw = regex.sub(r"[ -]", "", parts[:end])
            if parts[end - 1] not in " -" and 15 <= len(raw) <= 34 and int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1:
                yield m.start(), m.start() + end, True
                break
        else:
            yield m.start(), m.end(), False  # the form of an account, and so no phone number
    for m in _PAN.finditer(text, a, b + 32):
        if m.start() >= b:
            break
        digits = regex.sub(r"\D", "", m.group(0))
        if digits[0] in "3456" and len(digits) in (15, 16, 19) and regex.fullmatch(r"\d+|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{3})?|\d{4}[ -]\d{6}[ -]\d{5}", m.group(0)) and _luhn(digits):
            yield m.start(), m.end(), True


def _phones(text: str, a: int, b: int, before: _Before) -> Iterator[tuple[int, int]]:
    end = a
    for start in _PHONE_START.finditer(text, a, b):
        m = _PHONE.match(text, start.start()) if start.start() >= end else None
        if m is None:
            continue
        end = m.end()
        raw = m.group(0)
        main = regex.split(r"(?i)ext|x|poste|toestel|tst|durchwahl|dw|app", raw)[0]
        digits = regex.sub(r"\D", "", main)
        if before.no_phone(m.start()):
            continue
        world = raw[0] == "+" or raw.startswith("00")
        if not (8 <= len(digits) <= 15 if world else 9 <= len(digits) <= 12):
            continue
        if raw[0] in "23456789" and not before.phone(m.start()):
            continue
        if regex.fullmatch(r"0?\d[./-]\d{2}[./-]\d{4}.*", main) or regex.fullmatch(r"\(\d+\)[ .-]?\d+", main) and len(digits) < 9:
            continue
        if raw[0] == "0" and not world and regex.fullmatch(r"\d+", main.strip()) and (len(digits) not in (10, 11) or not before.phone(m.start()) and not text[m.end() : m.end() + 16].lstrip().lower().startswith(("anruf", "or ", "ou "))):
            if len(digits) not in (10, 11):
                continue
            if not regex.search(r"(?:[:/]|\b\p{L}{2,3})\s*$", text[max(0, m.start() - 8) : m.start()]):
                continue
        if raw.startswith("00") and regex.fullmatch(r"\d+", main.strip()) and len(digits) < 11:
            continue
        last = end
        while last > m.start() and not text[last - 1].isdigit():
            last -= 1
        yield m.start(), last


def _labelled(text: str, at: int) -> bool:
    """Whether an identifier's label stands before, with nothing but blanks and signs between."""
    while at > 0 and (text[at - 1].isspace() or text[at - 1] in ":#°."):
        at -= 1
    # No label is longer.
    return bool(_ID_LABEL.search(text, max(0, at - 64), at))


def _ids(text: str, a: int, b: int, before: _Before) -> Iterator[tuple[int, int]]:
    for m in _ID.finditer(text, a, b + 32):  # no form is longer
        if m.start() >= b:
            break
        labelled = _labelled(text, m.start())
        if m["birth"]:
            digits = regex.sub(r"\D", "", m.group(0))
            month, day = int(digits[2:4]), int(digits[4:6])
            if not (1 <= month % 20 <= 12 or labelled) or not (1 <= day <= 31 or labelled):
                continue
        if labelled or (_ID_PLAIN.fullmatch(m.group(0)) and not before.no_phone(m.start())):
            yield m.start(), m.end()


def _named_ids(text: str, hits: list[tuple[int, str]]) -> Iterator[tuple[int, int]]:
    """A label, then any number of at least six digits."""
    for after, cue in hits:
        m = _ID_NAMED.match(text, after - len(cue))
        any_id = _ID_ANY.match(text, m.end()) if m else None
        if any_id and sum(c.isdigit() for c in any_id.group(0)) >= 6:
            yield any_id.start(), any_id.end()


#: Letters of a street name, also of UTF-8 read as a single-byte code page.
_NAME_SIGNS = set("'’-‐‰€‚ƒ„…†‡ˆŠ‹ŒŽ‘“”•–—˜™š›œžŸ") | {chr(c) for c in range(0x80, 0xC0) if c != 0xA0}


def _capitals_before(text: str, at: int, most: int) -> list[int]:
    """Starts of up to ``most`` capitalised words that stand, parted by blanks only, before ``at``; nearest first."""
    out: list[int] = []
    while len(out) < most:
        end = at
        while end > 0 and text[end - 1] in " \t":
            end -= 1
        first = end
        while first > 0 and (text[first - 1].isalpha() or text[first - 1] in _NAME_SIGNS or unicodedata.combining(text[first - 1])):
            first -= 1
        if end == at or first == end or not _CAP_WORD.fullmatch(text, first, end):
            break
        out.append(first)
        at = first
    return out


def _number_before(text: str, at: int, pattern: regex.Pattern = _NUMBER_BEFORE) -> int | None:
    """Start of a house number (a flat) that ends at ``at`` but for blanks."""
    end = at
    while end > 0 and text[end - 1] in " \t":
        end -= 1
    m = pattern.search(text, max(0, end - 48), at) if end < at else None  # no form is longer
    return m.start() if m else None


def _addresses(text: str, hits: dict[str, list[tuple[int, str]]]) -> Iterator[tuple[int, int]]:
    """Street types and residence cues, expanded to the name, the number and the place beside them."""
    for after, cue in hits.get("prefix_type", ()):
        first = after - len(cue)
        if first and text[first - 1].isalpha():
            continue
        m = _PREFIX_FORMS[0].match(text, first)
        if m:
            yield m.start(), m.end()
        number = _number_before(text, first)
        m = _PREFIX_FORMS[1].match(text, number) if number is not None else None
        if m:
            yield m.start(), m.end()
    for after, cue in hits.get("suffix_type", ()):
        at = after
        while at < len(text) and text[at] in " \t":
            at += 1
        if at == after or at == len(text) or not text[at].isdigit() or (cue == "ring" and text[after - 5 : after - 4] == "k"):
            continue
        first = after - len(cue)
        if text[first:after].isupper() and len(cue) > 1:
            continue
        while first > 0 and (text[first - 1].isalpha() or text[first - 1] in _NAME_SIGNS or unicodedata.combining(text[first - 1])):
            first -= 1
        while first < after and text[first] in "'’-":
            first += 1
        m = _SUFFIX_TAIL.match(text, at)
        if m and (text[first].isupper() or text[first] in "ÃÂ"):
            yield min([first, *_capitals_before(text, first, 3)]), m.end()
    for after, cue in hits.get("german_way", ()):
        first = after - len(cue)
        if text[first].isupper() and not (first and text[first - 1].isalpha()) and (m := _GERMAN_WAY.match(text, first)):
            yield m.start(), m.end()
    for after, cue in hits.get("english_type", ()):
        first = after - len(cue)
        if not text[first + 1].isupper() or (after < len(text) and text[after].isalpha()):
            continue
        for start in reversed(_capitals_before(text, first + 1, 4)):
            number = _number_before(text, start)
            if number is not None:
                flat = _number_before(text, number, _FLAT_BEFORE)
                m = _ENGLISH.match(text, number if flat is None else flat)
                if m:
                    yield m.start(), m.end()
                    break
    for after, _ in hits.get("residence", ()):
        m = _AT_HOME.match(text, after)
        if m:
            place = m["place"] and m["place"].split()[0].lower() not in _NO_PLACE
            yield m.start("a"), m.end("place") if place else m.end("a")


_PREFIX = regex.compile(r"(?:[\s>*•#-]|\d{1,2}:\d{2}(?!\d)|\p{Lu}:(?=\s))+")
_BOUNDARY = regex.compile(r"[\n\r!?;>)\]}»”\"]|:(?=\s)|(?<!(?<!\p{L})\p{Lu})\.(?=\s)")


def _people(text: str, hits: list[tuple[int, str, list[str]]]) -> Iterator[tuple[int, int]]:
    def try_name(at: int, loose: bool) -> tuple[int, int] | None:
        while at < len(text) and (text[at] in " \t :,.\n\r" or text[at] in "​﻿"):
            at += 1
        end = parse_name(text, at)
        if end is None and loose:
            end = parse_name(text, at, relaxed=True)
            if end is not None and not _AFTER_NAME.match(text, end):
                end = None
        return (at, end) if end is not None else None

    boundaries: list[int] | None = None
    for after, cue, kinds in hits:
        first = after - len(cue)
        if first > 0 and (text[first - 1].isalpha() or text[first - 1].isdigit()) and cue[0].isalpha():
            continue
        whole = after >= len(text) or not text[after].isalpha() or cue.endswith((".", ":", " "))
        if "title" in kinds and whole:
            at = after + 1 if cue in ("mr", "mrs", "ms", "dr", "prof") and text.startswith(".", after) else after
            if cue == "m." and text[first] != "M":
                continue
            got = try_name(at, cue in _LOOSE and cue not in ("m.", "ms", "mr", "dr"))
            if got is None and cue in ("mme", "mr", "dr", "dhr.", "mevr.", "frau", "herr"):
                got = try_name(at, True)
            if got is None and cue == "m.":
                got = try_name(at, True)
            if got is None and cue == "m.":
                end = parse_name(text, first)
                got = (first, end) if end is not None else None
            if got:
                yield got
        elif "signed" in kinds:
            got = try_name(after, cue in _LOOSE)
            if got:
                yield got
        elif "spoke" in kinds and whole:
            got = try_name(after, cue in _LOOSE)
            while got:
                yield got
                more = _AND_MORE.match(text, got[1])
                got = try_name(more.end(), cue in _LOOSE) if more else None
        elif "subject" in kinds:
            if boundaries is None:
                boundaries = [m.end() for m in _BOUNDARY.finditer(text)]
            k = bisect.bisect_right(boundaries, first) - 1
            left = boundaries[k] if k >= 0 else 0
            start = p.end() if (p := _PREFIX.match(text, left)) else left
            end_of = first
            while end_of > start and text[end_of - 1] in " ,":
                end_of -= 1
            for relaxed in (False, True) if cue in _LOOSE else (False,):
                end = parse_name(text, start, relaxed)
                if end is not None and end == end_of:
                    yield start, end
                    break
            else:
                # The sentence before may lack its full stop: the name is what ends here, so words are tried from here to the left.
                found, at, words = None, end_of, 0
                while at > start and words < 3:  # no name has more than two words that are neither particle nor initial
                    w = at
                    while w > start and (text[w - 1].isalpha() or text[w - 1] in "'’-.­​" or unicodedata.combining(text[w - 1]) or text[w - 1] in _NAME_SIGNS):
                        w -= 1
                    if w == at or not (_is_name_word(text[w:at].strip("."), False) or text[w:at].lower() in _PARTICLES or _INITIALS.fullmatch(text, w, at)):
                        break
                    words += text[w:at].lower() not in _PARTICLES and not _INITIALS.fullmatch(text, w, at)
                    if parse_name(text, w) == end_of:
                        found = w
                    at = w
                    while at > start and text[at - 1] in " \t,":
                        at -= 1
                if found is not None:
                    yield found, end_of


#: Cues after (before) which a name in small letters is taken for one.
_LOOSE = {
    "contact:", "contact :", "kontakt:", "kontakt :", "getekend", "gezeichnet", "signed", "signé", "spraken met", "spoke with", "parlé avec", "sprachen mit", "gesproken met", "gesprochen mit",
    "mevr.", "mevrouw", "dhr.", "de heer", "meneer", "m.", "mme", "mlle", "madame", "monsieur", "mr", "mrs", "ms", "miss", "dr", "prof", "frau", "herr", "claimant", "treinbegeleider", "accompagnateur", "accompagnatrice", "zugbegleiter", "zugbegleiterin", "conductor,", "conductor", "handed in by", "person is", "name is",
    " saw ", " told ", " zag ", " a vu ", " sah ", " is bereikbaar", " est joignable", " ist unter ", " ist erreichbar", " is reachable", " can be reached",
}
_INITIALS = regex.compile(r"(?:\p{Lu}\.-?)+")
_AND_MORE = regex.compile(r"\s*(?:,|;)?\s*(?:en|et|and|und|or|ou|of|oder|&|,)\s+")


def find_pii(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every stretch, in order, without overlaps: the longest of overlapping stretches counts.

    Kinds are those of ``KINDS`` and ``account`` (bank accounts and payment cards with right check digits).
    """
    if not text:
        return []
    if not text.isascii():
        text = text.translate(_PLAIN)
    low = _lower(text)
    hits: dict[str, list[tuple[int, str]]] = {}
    names: list[tuple[int, str, tuple[str, ...]]] = []
    for end, (cue, kinds) in _automaton().iter(low):
        for kind in kinds:
            if kind in _NAME_CUES:
                names.append((end + 1, cue, kinds))
                break
            hits.setdefault(kind, []).append((end + 1, cue))
    found: list[tuple[int, int, str]] = []
    if "mail" in hits:
        found += [(a, b, "email") for a, b in _emails(text, low, hits["mail"])]
    before = _Before(text, low)
    numbers: list[tuple[int, int]] = []
    done = 0
    for run in _RUN.finditer(text):
        if sum(map(str.isdigit, run.group(0))) < 6:
            continue
        # Room for a plus sign, brackets and letters before.
        first, b = max(0, run.start() - 6), run.end()
        a = max(done, first)
        accounts = list(_accounts(text, first, b))
        found += [(x, y, "account") for x, y, right in accounts if right]
        phones = [(x, y) for x, y in _phones(text, a, b, before) if not any(c < y and x < d for c, d, _ in accounts)]
        found += [(x, y, "phone") for x, y in phones]
        numbers += _ids(text, first, b, before)
        done = max([run.end(), *[y for _, y in phones]])
    if "id" in hits:
        numbers += _named_ids(text, hits["id"])
    found += [(a, b, "id_number") for a, b in numbers]
    # The end of an id number is no house number.
    found += [(a, b, "address") for a, b in _addresses(text, hits) if not any(c < a < e for c, e in numbers)]
    if names:
        found += [(a, b, "person") for a, b in _people(text, names)]
    kept: list[tuple[int, int]] = []
    out = []
    for a, b, kind in sorted(set(found), key=lambda x: (x[0] - x[1], _RANK[x[2]], x[0])):
        while b > a and (text[b - 1].isspace() or text[b - 1] in ",;:"):
            b -= 1
        at = bisect.bisect_left(kept, (a, b))
        if b > a and (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
            kept.insert(at, (a, b))
            out.append((a, b, kind))
    return sorted(out)


_NAME_CUES = {"signed", "spoke", "title", "subject"}
_RANK = {k: i for i, k in enumerate((*KINDS, "account"))}


def mask(text: str | None) -> str | None:
    """The text with a typed placeholder in the place of every stretch."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find_pii(text):
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def pii_stretches(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pii_kind, pii_text: every stretch as it stands, once per document and kind.

    An Aho-Corasick automaton finds at-signs, schemes, identifier cues, street types and cues of names; runs of digits are anchors too.
    Deterministic local parsers expand each anchor to the whole address, number, account or name and validate it; no pattern is
    searched for in the whole text. Accounts are told apart and masked, but are none of the kinds reported here. Documents stream through Arrow batches; the result of a document never leaves its task but for
    the final removal of repeats. Defined cases: null and empty texts hold nothing; repeated documents count once per id; a null id
    stays null; whole texts are read, however long.
    """

    def over(keys: list, texts: list) -> Iterator[dict[str, list]]:
        out = [(d, k, t[a:b]) for d, t in zip(keys, texts) for a, b, k in find_pii(t) if k in KINDS]
        yield {c: [row[i] for row in out] for i, c in enumerate(("doc_id", "pii_kind", "pii_text"))}

    return map_texts(df, doc_id, text, "doc_id", over, {"pii_kind": "string", "pii_text": "string"}).distinct()


def masked_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with placeholders; null texts stay null. One row per input row, no shuffle of the result."""

    def over(keys: list, texts: list) -> Iterator[dict[str, list]]:
        yield {"doc_id": keys, "text": [mask(t) for t in texts]}

    return map_texts(df, doc_id, text, "doc_id", over, {"text": "string"})
