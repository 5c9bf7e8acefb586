"""Problem 10: personal information inside free text, found, typed and replaced by linked pseudonyms.

Mail addresses, phone numbers, numbers of persons and street addresses are found by their formats in English, German,
French and Spanish; names by titles, cues and a gazetteer of given names that is learned from the corpus itself (all
documents; a name must stand in cue positions at least `least` times, so the gazetteer has at most cues / least
entries). Matches are resolved left to right, longer and more certain types first, and never overlap.

Every item becomes a typed placeholder, and so do dates of birth. Numbers and dates are permuted within the valid
values of their format by a keyed Feistel network (pseudonyms.py): insurance, licence, tax and identity numbers stay
valid, and all notations of a phone number (+44, 0044, 0) get one pseudonym. Names, mail addresses and streets become
a keyed tag. Equal values get equal pseudonyms in all documents, whatever their spacing or case; without the key they
can't be turned back.

Defined results: null text gives no items and stays null; empty text stays empty; the whole text is scanned, whatever its
length; an item found several times in a text is one row. HTML spaces count as white space and are kept as written.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.llm.pseudonyms import birth_date, identity_number, national_part, phone_number
from loadweave.llm.pseudonyms import DNI_LETTERS, feistel, permute_format  # noqa: F401
from loadweave.session import spread, stage_table

NBSP = "&nbsp;"
#: one white space inside an item: blank, no-break space (as character or entity)
B = r"(?:[ \t ]|&nbsp;)"
#: separator of digit groups
S = rf"(?:{B}|[.\-/])"

#: the setting with the key of the pseudonyms; without it a session draws one of its own
KEY_SETTING = "spark.loadweave.pseudonym.key"

# ---------------------------------------------------------------- mail
_AT = rf"(?:@|{B}?[(\[]{B}?(?:at|arroba|arobase|ät){B}?[)\]]{B}?|{B}(?:at|arroba|arobase){B})"
_DOT = rf"(?:\.|{B}?[(\[]{B}?(?:dot|punkt|point|punto){B}?[)\]]{B}?|{B}(?:dot|punkt|point|punto){B})"
AT_SIGN = re.compile(_AT, re.I)
DOMAIN = re.compile(rf"[a-z0-9][a-z0-9-]*(?:{_DOT}[a-z0-9][a-z0-9-]*)*{_DOT}[a-z]{{2,}}(?![\w@-])", re.I)
LOCAL = re.compile(r"\w(?:[\w.+%-]*\w)?$")


AT_MARK = re.compile(r"@|[(\[]")
SPACES = (" ", "\t", "\xa0", NBSP)
AT_PLAIN = tuple(f" {w} " for w in ("at", "arroba", "arobase"))
AT_WORDS = tuple(f"{a}{w}{b}" for w in ("at", "arroba", "arobase") for a in SPACES for b in SPACES)


def _at_signs(text: str, low: str) -> Iterator[tuple[int, int]]:
    for m in AT_MARK.finditer(text):
        a = m.start()
        if text[a] == "@":
            yield a, a + 1
        else:
            a -= 6 if text.startswith(NBSP, max(0, a - 6)) else a > 0 and text[a - 1] in " \t\xa0"
            sign = AT_SIGN.match(text, a)
            if sign:
                yield sign.span()
    for word in AT_WORDS if any(x in low for x in SPACES[1:]) else AT_PLAIN:
        a = low.find(word)
        while a >= 0:
            yield a, a + len(word)
            a = low.find(word, a + 1)


def find_mail(text: str, low: str) -> Iterator[tuple[int, int]]:
    """From each at-sign, written or spelled, forwards to the domain and backwards to the local part."""
    for start, end in _at_signs(text, low):
        domain = DOMAIN.match(text, end)
        if domain:
            a = start
            while a and (text[a - 1].isalnum() or text[a - 1] in "_.+%-"):
                a -= 1
            local = LOCAL.search(text[a:start])
            if local:
                yield a + local.start(), domain.end()


# ---------------------------------------------------------------- phone
_NSN_UK = rf"(?:\d{{2}}{S}\d{{4}}{S}\d{{4}}|\d{{3}}{S}\d{{3}}{S}\d{{4}}|\d{{4}}{S}\d{{3}}{S}\d{{3}}|\d{{4}}{S}\d{{6}}|\d{{10}})"
_FR = rf"[1-9](?:{S}?\d{{2}}){{4}}"
_ES_REST = rf"\d{{2}}(?:{S}\d{{3}}{S}\d{{3}}|{S}\d{{2}}{S}\d{{2}}{S}\d{{2}}|{S}\d{{2}}{S}\d{{4}}|\d{{6}})"
_ES = rf"[5-9]{_ES_REST}"
_DE = rf"[1-9]\d{{1,4}}{B}?[/-]?{B}?(?:\d{{4,6}}{S}\d{{3,4}}|\d{{3}}{S}\d{{4,5}}|\d{{6,8}})"
PHONE = re.compile(
    r"(?:"
    rf"(?:\+|00)44{S}?(?:\(0\){B}?)?{_NSN_UK}"
    rf"|(?:\+|00)33{S}?(?:\(0\){B}?)?{_FR}"
    rf"|(?:\+|00)34{S}?{_ES}"
    rf"|(?:\+|00)49{S}?(?:\(0\){B}?)?{_DE}"
    rf"|\+\d{{1,3}}{S}?\(?\d{{1,4}}\)?(?:{S}\d{{2,4}}){{2,4}}"
    rf"|\(0\d{{2}}\){B}?\d{{4}}{S}\d{{4}}|\(0\d{{3,4}}\){B}?\d{{3,4}}{S}?\d{{3,4}}|\(0\d{{2,4}}\){B}?\d{{6,8}}|\(0\d{{2,4}}\){B}?\d{{4,5}}{S}\d{{3}}"
    rf"|0{_NSN_UK}"
    rf"|0{_FR}"
    rf"|0\d{{2,4}}(?:{B}|/|-|{B}/{B})\d{{5}}[ -]\d{{3}}|0\d{{2,4}}(?:{B}|/|-|{B}/{B})\d{{7,8}}|01[5-7]\d{S}?\d{{7,8}}"
    rf")(?![\w-]|[.,/]\d)"
)
PHONE_START = re.compile(r"[+(0](?<![\w.,:/#+-].)")
_ES_CUE = r"(?:tel(?:éfono|ef)?\.?|móvil|llam\w+|al|en el|whatsapp|contacto|phone|mobile|ring|call|number is|t)"
PHONE_ES = re.compile(rf"[5-9](?<![\w.,:/#+-].)(?:{_ES_REST})(?![\w-]|[.,/]\d)")
PHONE_ES_CUE = re.compile(rf"(?<![\w.,:/#+-]){_ES_CUE}{B}*:?{B}*$", re.I)
PHONE_GROUPS_ES = re.compile(r"\d{3} \d{3} \d{3}(?! \d)")

# ---------------------------------------------------------------- identity
NINO = re.compile(rf"(?<![\w-])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z](?:{B}|-)?\d{{2}}(?:{B}|-)?\d{{2}}(?:{B}|-)?\d{{2}}(?:{B}|-)?[A-D](?![\w-])", re.I)
UK_LICENCE = re.compile(r"(?<![\w-])[A-Z][A-Z9]{4}\d{6}[A-Z9]{2}\d[A-Z]{2}(?![\w-])", re.I)
_MONTH = r"(?:0[1-9]|1[0-2]|[2-9]\d)"
INSEE = re.compile(rf"[12](?<![\w-].)(?:\d{{2}}{_MONTH}(?:\d{{2}}|2[AB])\d{{8}}|{B}\d{{2}}{B}{_MONTH}{B}(?:\d{{2}}|2[AB]){B}\d{{3}}{B}\d{{3}}{B}?\d{{2}})(?![\w-])", re.I)
DNI = re.compile(rf"(?<![\w-])(?:\d{{8}}(?:{B}|-)?|[XYZ]-?\d{{7}}-?)[A-HJ-NP-TV-Z](?![\w-])", re.I)
_ID_WORD = (
    r"passports?|passeports?|pasaportes?|reisep[aä]ss\w*|personalausweis\w*|ausweis\w*|identity card|id card|carte (?:nationale )?d['’]identité|cni|"
    r"(?:driving |driver'?s )?licen[cs]e|führerschein\w*|permis(?: de conduire)?|permiso(?: de conducir)?|carn[eé](?: de conducir)?|"
    r"steuer-?id\w*|steueridentifikationsnummer|steuernummer|sozialversicherung\w*|rentenversicherung\w*|versicherungsnummer|tax (?:number|id|reference)|utr|numéro fiscal|"
    r"insurance|national insurance|nino|ni|insee|sécurité sociale|nir|seguridad social|nuss|dni|nie|nif"
)
_ID_LINK = rf"(?:{B}*(?:no|nr|num|núm|number|nummer|numéro|número|n°|nº|is|card|id)\b\.?°?)*[\s:.°#]*"
ID_CUED = re.compile(rf"(?<![\w-])(?:{_ID_WORD})(?![\w]){_ID_LINK}(?P<item>[A-Z0-9](?:(?:{B}|[-./])?[A-Z0-9]){{6,19}})(?![\w-])", re.I)

# ---------------------------------------------------------------- dates of birth
BIRTH_STEMS = ("birth", "born", "dob", "d.o.b", "geb", "né", "naiss", "nacid", "nacim")
BIRTH = re.compile(
    rf"(?<![\w-])(?:date of birth|birth ?date|born(?:{B}on)?|d\.?o\.?b\.?|geb(?:\.|oren(?:{B}am)?|urtsdatum)|née?{B}le|date de naissance|nacid[oa]{B}el|fecha de nacimiento)(?:{B}|:)*"
    rf"(?P<item>\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}(?P<sep>[./-])\d{{1,2}}(?P=sep)(?:\d{{4}}|\d{{2}}))(?!\d|[./-]\d)",
    re.I,
)

# ---------------------------------------------------------------- address
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_UK_KIND = r"(?:street|st|road|rd|avenue|ave|crescent|cres|close|mews|lane|ln|terrace|terr?|drive|dr|court|ct|gardens|gdns|place|pl|way|square|sq|hill|grove|row|walk|rise|view|green|park|parade|wharf|yard)"
_UK_POST = rf"[A-Z]{{1,2}}\d{{1,2}}[A-Z]?(?:{B})?\d[A-Z]{{2}}"
_GAP = rf"(?:,?{B}+|,?{B}*\n{B}*)"
UK_ADDRESS = re.compile(
    rf"\d(?<![\w.,:/#-].)\d{{0,3}}(?:[a-z]|-\d+)?{B}(?:[a-z][\w'’-]+{B}){{1,3}}?{_UK_KIND}\b\.?"
    rf"(?:{_GAP}(?:[a-z][\w'’-]+{_GAP}|[a-z][\w'’-]+{B}[a-z][\w'’-]+{_GAP})?{_UK_POST}\b)?",
    re.I,
)
UK_FLAT = re.compile(rf"(?<![\w.,:/#-])(?:flat|apt|apartment|unit|floor|suite|room){B}\d+[a-z]?{_GAP}$", re.I)
UK_TOWN = re.compile(rf",{B}({_CAP})(?={B}*(?:[.,;:!?)\n]|$))")
UK_TOWN_LOWER = re.compile(rf",{B}([a-z][a-z'’-]{{3,}})(?={B}*(?:[.,;:!?)\n]|$))")
_POST5 = r"\d{5}"
_TOWN5 = r"[A-ZÀ-ÖØ-Þa-zà-ÿ][\w'’-]+"
_DE_AT = rf"(?:Am|An{B}der|Im|Auf{B}dem|Zum|Zur)"
#: what follows 'Am' or 'Im' in a date
_DE_DATE = r"(?:Jan|Feb|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez|Mo|Di|Mi|Do|Fr|Sa|So|Januar|Jänner|Februar|März|April|Juni|Juli|August|September|Oktober|November|Dezember|(?:Mon|Diens|Donners|Frei|Sams|Sonn)tag|Mittwoch|Sonnabend|Jahr|Frühjahr|Frühling|Sommer|Herbst|Winter)\b"
DE_ADDRESS = re.compile(
    rf"(?<![\w-])(?:[A-ZÄÖÜa-zäöü][\wäöüß-]*(?:straße|strasse|str\.|allee|gasse|weg|platz|ring|ufer|damm|chaussee|steig|pfad)|{_CAP}{B}(?:Straße|Str\.|Allee|Gasse|Weg|Platz|Ring|Ufer|Damm)|{_DE_AT}{B}(?!{_DE_DATE}){_CAP}){B}?\d{{1,4}}(?:{B}?[a-z](?!\w))?(?!\w|[.:]\d)"
    rf"(?:,{B}?(?:\d+\.{B}?(?:OG|Stock|Etage)|EG|Whg\.?{B}?\d+|Wohnung{B}\d+))?(?:{_GAP}{_POST5}{B}{_TOWN5})?"
)
DE_ADDRESS_LOWER = re.compile(rf"(?<![\w-])[a-zäöü][\wäöüß-]*(?:straße|strasse|str\.|allee|gasse|weg|platz){B}\d{{1,4}}{B}?[a-z]?\b(?:{_GAP}{_POST5}{B}{_TOWN5})?")
_FR_KIND = r"(?:rue|impasse|chemin|allée|avenue|boulevard|bd|quai|place|cours|route|square|passage|sentier|ruelle|villa|faubourg)"
FR_ADDRESS = re.compile(
    rf"(?<![\w.:/#-])(?:(?:appt\.?|appartement|apt\.?|bât\.?|bâtiment|étage|esc\.?|lot){B}\w+{_GAP})*\d{{1,4}}{B}?(?:bis|ter|quater|[a-d](?!\w))?,?{B}{_FR_KIND}{B}(?:(?:de{B}la|de{B}l['’]|des|du|de|d['’]|la|le|les){B}?)?[A-ZÀ-ÖØ-Þa-zà-ÿ][\w'’]+(?:-[\w'’]+)*"
    rf"(?:,{B}?(?:\d+(?:er|e|ème){B}étage|appt\.?{B}\w+|bât\.?{B}\w+))*(?:{_GAP}{_POST5}{B}{_TOWN5})?",
    re.I,
)
_ES_KIND = r"(?:calle|c/|avenida|avda\.?|av\.|plaza|pza\.?|paseo|camino|travesía|ronda|carretera|glorieta)"
ES_ADDRESS = re.compile(
    rf"(?<![\w-]){_ES_KIND}{B}?(?:(?:de{B}las|de{B}los|de{B}la|del|de){B})?[A-ZÀ-ÖØ-Þa-zà-ÿ][\w'’-]+(?:{B}(?:de{B}|del{B}|la{B})?{_CAP})?,?{B}(?:n\.?[º°o]\.?{B}?|núm\.?{B}|número{B})?\d{{1,4}}(?:{B}?[a-z](?!\w))?(?![\w]|[.:]\d)"
    rf"(?:,{B}?(?:\d{{1,2}}\.?[ºª°]{B}?(?:[a-z]\b|izq(?:da)?\.?|dcha\.?)?|bajo(?:{B}[a-z]\b)?|ático|piso{B}\d+))?(?:{_GAP}{_POST5}{B}{_TOWN5})?",
    re.I,
)

# ---------------------------------------------------------------- names
TITLE = r"(?:Mrs|Mr|Ms|Miss|Mx|Dr|Prof|Sir|Lady|Frau|Herrn|Herr|Mme|Mlle|Madame|Monsieur|Mademoiselle|Sra|Srta|Sr|Señora|Señor|Don|Doña|D\.ª|Dª|Dña)"
_TITLES = rf"(?:(?:{TITLE}\.?|M\.|D\.){B}+)"
_L = r"A-Za-zÀ-ÖØ-öø-ÿ"
_PART = rf"[A-ZÀ-ÖØ-Þ][{_L}'’]+(?:-[A-ZÀ-ÖØ-Þ][{_L}'’]+)*"
_INI = rf"(?:[A-ZÀ-ÖØ-Þ]\.{B}?)"
_UPPER = r"[A-ZÀ-ÖØ-Þ]{3,}(?:-[A-ZÀ-ÖØ-Þ]{3,})*"
#: words that make a capitalised sequence a firm, body or street
NOT_PERSON = frozenset(
    """ltd limited plc llp inc gmbh ag kg mbh sarl sas sa sl trust lettings estates cooperative co-operative energy electrical metering elektro housing council association
    society group services solutions power grid networks office team desk depot street st road rd avenue ave crescent close mews lane terrace drive court way square substation
    transformer station company partners bank university college hospital stadtwerke werke energie énergie électricité electricidad energía comunidad cooperativa""".split()
)
#: words that open a sentence or follow a cue and are no names
NOT_NAME = frozenset(
    """the a an our your my his her their its this that these those we you i he she it they us them someone nobody everybody anyone who what when where why how if and or but so no not yes
    on in at from to for with by as of since after before between during while half order job batch code meter mpan household firmware visit mean page ticket engineer user agent best
    reading regards dear hello hi thanks thx cheers best kind yours sincerely please spoke left contact name signed site tel phone mobile email mail address account landlord tenant neighbour
    der die das ein eine einen einem einer dem den des wir ich sie er es uns ihr mein meine unser unsere und oder aber nicht kein keine zum zur vom bei mit nach seit von für auf an im in am um
    le la les un une des du de au aux nous vous je il elle ils elles mon ma mes notre votre ce cette ces et ou mais pas que qui pour avec sans sur sous dans depuis pendant après selon
    el los las lo una unos unas del al nosotros yo usted él ella mi su sus este esta y o pero no que quien para con sin sobre en desde durante tras según
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
    montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo""".split()
)
_NAME = rf"(?:{_UPPER},{B}{_PART}|{_PART}{B}(?:{_INI}{B}?)*{_PART}|{_INI}{B}?(?:{_INI}{B}?)?{_PART})"
TITLE_START = re.compile(r"(?:M(?:rs?|s|iss|me|lle|x|adame|onsieur|ademoiselle)?|Dr|Prof|Frau|Herrn?|S(?:ra?|rta|eñora?|ir)|Lady|D(?:\.ª|ª|oña|on|ña)?)\.?" rf"{B}")
TITLED = re.compile(rf"(?<![\w.]){_TITLES}+(?P<item>{_UPPER},{B}{_PART}|{_PART}(?:{B}(?:{_INI}{B}?)*{_PART})?|{_INI}{B}?(?:{_INI}{B}?)?{_PART})")
LISTED = re.compile(rf"(?P<item>[A-ZÀ-ÖØ-Þ](?<![\w-].)[A-ZÀ-ÖØ-Þ]{{2,}}(?:-[A-ZÀ-ÖØ-Þ]{{3,}})*,{B}[A-ZÀ-ÖØ-Þ][a-zà-ÿ][{_L}]*(?:-[A-ZÀ-ÖØ-Þ][{_L}]+)*)(?!\w)")
INITIALED = re.compile(rf"(?P<item>[A-ZÀ-ÖØ-Þ](?<![\w.@].)\.{B}?(?:[A-ZÀ-ÖØ-Þ]\.{B}?)?[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{{2,}}[{_L}]*(?:-[A-ZÀ-ÖØ-Þ][{_L}]+)*)(?!\w)")
PAIR = re.compile(rf"(?<![\w@.+-])(?P<given>[{_L}]{{2,}}){B}(?:[{_L}]\.{B}?)*(?P<family>[{_L}'’]{{3,}}(?:-[{_L}]{{3,}})*)(?![\w@])")
CUED = re.compile(
    rf"(?:(?:^|[\n>]|(?<=[.?!] )|(?<=: ))(?:Name|Full name|Signed|Tenant|Occupier|Customer|Client|Contact|Kunde|Kundin|Mieter|Mieterin|Ansprechpartner|Unterschrift|Locataire|Cliente|Inquilino|Inquilina|Titular|Nombre|Nom){B}?:{B}?)"
    rf"{_TITLES}*(?P<item>[{_L}]{{2,}}{B}(?:[{_L}]\.{B}?)*[{_L}'’]{{3,}}(?:-[{_L}]{{3,}})*|{_NAME})",
    re.M,
)
#: a tail that every lettered number of a person has
ID_TAIL = re.compile(rf"\d(?:\d(?:{B}|-)?[a-d](?![\w-])|\d{{5}}[a-z9]{{2}}\d[a-z]|\d{{6}}(?:{B}|-)?[a-z](?![\w-]))")
#: stems without which no cue for a number of a person stands in a text
ID_STEMS = ("passp", "passep", "pasap", "pass", "ausweis", "ident", "cni", "licen", "führersch", "permis", "carn", "steuer", "versicherung", "tax", "utr", "fiscal", "insur", "nino", "insee", "sécu", "segur", "nir", "nuss", "dni", "nie", "nif", "id card", "päss")
#: no stem lies deeper in its cue ("carte nationale d'" before "ident")
CUE_REACH = 24
#: a cue too short for a stem
ID_NI = re.compile(r"ni(?<![\w-]ni)(?!\w)")
FR_STEMS = ("rue ", "impasse ", "chemin ", "allée ", "avenue ", "boulevard ", "bd ", "quai ", "place ", "cours ", "route ", "square ", "passage ", "sentier ", "ruelle ", "villa ", "faubourg ")
ES_STEMS = ("calle", "c/", "avenida", "avda", "av.", "plaza", "pza", "paseo", "camino", "travesía", "ronda", "carretera", "glorieta")
DE_HINT = re.compile(rf"(?:str(?:aße|asse|\.)|allee|gasse|weg|platz|ring|ufer|damm|chaussee|steig|pfad){B}?\d")
DE_AT = re.compile(rf"(?:Am|Im|Zu[mr]|An{B}der|Auf{B}dem){B}[A-ZÀ-ÖØ-Þ][\w'’-]*{B}?\d")
LETTERS = re.compile(rf"[{_L}]+")

def words_back(text: str, at: int, words: int) -> int:
    """Start of the last `words` words before a place, whatever their length and the white space, colons and marks between and after them."""
    i = at
    for _ in range(words):
        while i and not text[i - 1].isalnum():
            i -= 1
        while i and (text[i - 1].isalnum() or text[i - 1] in "_.'’/-;&"):
            i -= 1
    return i


def cue_lines(text: str) -> bool:
    """Whether a cue word with a colon may stand in the text."""
    at = text.find(":")
    while at >= 0:
        before = text[words_back(text, at, 1) : at].rstrip()
        if before.endswith(("Name", "name", "Signed", "Tenant", "Occupier", "Customer", "Client", "Contact", "Kunde", "Kundin", "Mieter", "Mieterin", "Ansprechpartner", "Unterschrift", "Locataire", "Cliente", "Inquilino", "Inquilina", "Titular", "Nombre", "Nom", "nbsp;")):
            return True
        at = text.find(":", at + 1)
    return False


QUOTED = re.compile(rf"(?P<item>[{_L}]{{2,}}{B}(?:[{_L}]\.{B}?)*[{_L}'’]{{3,}}(?:-[{_L}]{{3,}})*){B}<[^<>\n]{{5,}}>")


def _spaces(s: str) -> str:
    return s.replace(NBSP, " ").replace(" ", " ")


def _words(s: str) -> list[str]:
    return re.findall(rf"[{_L}'’]+", _spaces(s))


def find_quoted(text: str) -> Iterator[re.Match]:
    """Names before a mail address in angle brackets."""
    at = text.find("<")
    while at >= 0:
        # from the mark, line or bracket before to the closing bracket, however far
        start = max(text.rfind(c, 0, at) for c in "<>\n") + 1
        end = text.find(">", at) + 1
        last = None
        for m in QUOTED.finditer(text, start, end or len(text)) if end else ():
            last = m
        if last is not None:
            yield last
        at = text.find("<", at + 1)


def cued_given_names(text: str) -> list[str]:
    """Given names in cue positions of a text: after 'Name:' and the like, before a quoted mail address, after SURNAME,."""
    out = []
    for found in (CUED.finditer(text) if cue_lines(text) else (), find_quoted(text)):
        for m in found:
            w = _words(re.sub(rf"^{_TITLES}+", "", m["item"]))
            if len(w) >= 2 and "," not in m["item"] and len(w[0]) > 1 and w[0].lower() not in NOT_NAME and not any(x.lower() in NOT_PERSON for x in w):
                out.append(w[0].lower())
    for m in LISTED.finditer(text):
        w = _words(m["item"].split(",")[1])
        if w and w[0].lower() not in NOT_NAME:
            out.append(w[0].lower())
    return out


def _person(item: str) -> bool:
    w = [x.lower() for x in _words(item) if len(x) > 1]
    return bool(w) and not any(x in NOT_PERSON for x in w) and w[-1] not in NOT_NAME and w[0] not in NOT_NAME


_NEXT_WORD = re.compile(rf"{B}*([{_L}-]+)")


def _before_org(text: str, end: int) -> bool:
    m = _NEXT_WORD.match(text, end)
    return bool(m) and m[1].lower() in NOT_PERSON


#: two capitalised words in a cue position are a name even if the given name is new
CAPITAL_PAIR = re.compile(rf"{_PART}{B}(?:{_INI}{B}?)*{_PART}$")
TITLE_FIRST, TITLE_LAST = re.compile(_TITLES), re.compile(rf"{_TITLES}$")
POST_END = re.compile(rf"{_UK_POST}$", re.I)
NO_PHONE = re.compile(r"(?:mpan|meter|order|code|batch|account|ref\w*|ticket|job|id|nr|no)[\s:.#]*$", re.I)


def _cued_numbers(text: str, low: str) -> Iterator[re.Match]:
    """Numbers after a cue word, matched from every word start from which a cue can reach its stem, to their own end."""
    at: set[int] = set()
    for stem in ID_STEMS:
        i = low.find(stem)
        while i >= 0:
            at.add(i)
            i = low.find(stem, i + 1)
    at.update(m.start() for m in ID_NI.finditer(low))
    done = set()
    for i in sorted(at):
        for j in range(max(0, i - CUE_REACH), i + 1):
            m = ID_CUED.match(text, j) if not j or not (text[j - 1].isalnum() or text[j - 1] in "_-") else None
            if m and m.span("item") not in done:
                done.add(m.span("item"))
                yield m


def find_items(text: str, given: frozenset[str]) -> list[tuple[int, int, str]]:
    """(start, end, type) of every item, in order, never overlapping."""
    taken: list[tuple[int, int, str]] = []
    used = bytearray(len(text))

    def take(a: int, b: int, kind: str) -> None:
        while b > a and (text[b - 1] in " \t\n,;:.!?" or kind == "name" and text[b - 1] in "'’"):
            if text[b - 1] == "." and kind == "address" and re.search(r"(?i)\b(?:str|avda|av|pza)\.$", text[a:b]):
                break
            b -= 1
        if b > a and not any(used[a:b]):
            used[a:b] = b"\x01" * (b - a)
            taken.append((a, b, kind))

    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for a, b in find_mail(text, low):
        take(a, b, "email")
    for rx in (NINO, UK_LICENCE, INSEE, DNI) if ID_TAIL.search(low) else (INSEE,):
        for m in rx.finditer(text):
            take(m.start(), m.end(), "identity")
    for m in _cued_numbers(text, low):
        a, b = m.span("item")
        # groups of a number may be spaced; stop before the first group without a digit, and ask for enough digits
        head = re.match(rf"(?:[A-Z0-9]*\d[A-Z0-9]*(?:{B}|[-./])?)+", text[a:b], re.I)
        if head:
            b = a + len(head[0].rstrip(" -./ \t"))
            digits = sum(c.isdigit() for c in text[a:b])
            if 5 <= digits and 7 <= len(re.sub(r"\W", "", text[a:b])) <= 16:
                take(a, b, "identity")
    for m in PHONE_START.finditer(text):
        m = PHONE.match(text, m.start())
        if m and (text[m.start()] in "+(" or not NO_PHONE.search(text, words_back(text, m.start(), 2), m.start())):
            take(m.start(), m.end(), "phone")
    for m in PHONE_ES.finditer(text):
        groups = PHONE_GROUPS_ES.match(text, m.start()) and not text[max(0, m.start() - 2) : m.start()].strip(" ").isdigit()
        if PHONE_ES_CUE.search(text, words_back(text, m.start(), 3), m.start()) or groups and not NO_PHONE.search(text, words_back(text, m.start(), 2), m.start()):
            take(m.start(), m.end(), "phone")
    plain = low.replace(NBSP, " ").replace("\xa0", " ").replace("\t", " ")
    forms = [FR_ADDRESS] if any(x in plain for x in FR_STEMS) else []
    forms += [ES_ADDRESS] if any(x in low for x in ES_STEMS) else []
    forms += [DE_ADDRESS, DE_ADDRESS_LOWER] if DE_HINT.search(low) or DE_AT.search(text) else []
    for rx in (*forms, UK_ADDRESS):
        for m in rx.finditer(text):
            a, b = m.span()
            if rx is UK_ADDRESS:
                flat = UK_FLAT.search(text, words_back(text, a, 2), a)
                a = flat.start() if flat else a
            if rx is UK_ADDRESS and not POST_END.search(m[0]):
                t = (UK_TOWN if m[0] != m[0].lower() else UK_TOWN_LOWER).match(text, b)
                b = t.end(1) if t else b
            take(a, b, "address")

    def name(a: int, b: int) -> None:
        if _person(text[a:b]) and not _before_org(text, b):
            take(a, b, "name")

    for m in LISTED.finditer(text):
        if _words(m["item"].split(",")[1])[:1] and _words(m["item"].split(",")[1])[0].lower() in given:
            name(*m.span("item"))
    for first in given.intersection(LETTERS.findall(low)):
        at = low.find(first)
        while at >= 0:
            m = PAIR.match(text, at)
            if m and m.end("given") == at + len(first) and m["family"].lower() not in NOT_NAME and (m["family"][0].isupper() or m["given"][0].islower()):
                name(*m.span())
            at = low.find(first, at + 1)
    for rx, found in ((CUED, CUED.finditer(text) if cue_lines(text) else ()), (QUOTED, find_quoted(text))):
        for m in found:
            a, b = m.span("item")
            w = _words(text[a:b])
            known = "," in text[a:b] or not w or w[0].lower() in given or re.match(_INI, text[a:b])
            # a title before or inside is left to the rule for titles
            titled = TITLE_FIRST.match(text, a) or TITLE_LAST.search(text, words_back(text, a, 2), a)
            if known or not titled and CAPITAL_PAIR.match(text[a:b]) and not text[b : b + 1].isalnum():
                name(a, b)
    for m in TITLE_START.finditer(text):
        if used[m.start()]:  # the letter belongs to a number or an address
            continue
        m = TITLED.match(text, m.start())
        if not m:
            continue
        a, b = m.span("item")
        if not _person(text[a:b]):
            # 'Mr Dunwick The' and the like: keep the first word
            first = re.match(_PART, text[a:b])
            b = a + first.end() if first else a
        # a single word after the title may be followed by an unrelated capital: two words only if the first is a given name
        two = re.match(rf"({_PART}){B}({_PART})$", text[a:b])
        if two and two[1].lower() not in given and two[1].split("-")[0].lower() not in given:
            b = a + len(two[1])
        if b > a:
            name(a, b)
    for m in INITIALED.finditer(text):
        name(*m.span("item"))
    return sorted(taken)


# ---------------------------------------------------------------- pseudonyms
def canonical_item(item: str, kind: str) -> str:
    """What makes two items the same value: spacing, case, and for mail the spelled-out signs do not matter; of a phone number only the national part counts."""
    s = _spaces(item).lower()
    if kind == "email":
        s = re.sub(_AT, "@", s, flags=re.I)
        return re.sub(_DOT, ".", s, flags=re.I)
    if kind == "phone":
        return "".join(s[i] for i in national_part(s))
    if kind == "identity":
        return re.sub(r"[\W_]", "", s)
    if kind == "name" and "," in s:
        s = " ".join(reversed([x.strip() for x in s.split(",", 1)]))
    return re.sub(r"[\s,]+", " ", s).strip()


def pseudonym(item: str, kind: str, key: bytes) -> str:
    """The typed placeholder. Numbers and dates keep their format, all else becomes a keyed tag."""
    written = _spaces(item)
    if kind == "phone":
        return f"[PHONE {phone_number(written, key)}]"
    if kind == "identity":
        new = iter(identity_number(canonical_item(item, kind).upper(), key))
        # the new digits and letters stand in the layout as written, so the format stays readable
        return f"[IDENTITY {''.join(next(new) if c.isalnum() else c for c in written)}]"
    date = birth_date(written, key) if kind == "date" else None
    return f"[{kind.upper()} {date or hmac.new(key, canonical_item(item, kind).encode(), hashlib.sha256).hexdigest()[:10]}]"


def find_birth_dates(text: str, low: str) -> Iterator[tuple[int, int]]:
    """Dates after a word for birth. They are replaced like the items, but are no type of the list of items."""
    if any(x in low for x in BIRTH_STEMS):
        for m in BIRTH.finditer(text):
            yield m.span("item")


def with_birth_dates(text: str, items: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    more = [(a, b, "date") for a, b in find_birth_dates(text, text.lower()) if not any(a < y and x < b for x, y, _ in items)]
    return sorted([*items, *more]) if more else items


def redact(text: str, items: list[tuple[int, int, str]], key: bytes) -> str:
    out, at = [], 0
    for a, b, kind in items:
        out += [text[at:a], pseudonym(text[a:b], kind, key)]
        at = b
    return "".join([*out, text[at:]])


def pseudonym_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING. Where none is set the session draws one, so its pseudonyms are linked with each other only."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING).encode()


# ---------------------------------------------------------------- distributed
def given_name_counts(documents: DataFrame, text_col: str = "text", least: int = 2) -> DataFrame:
    """(given, n): given names met in cue positions of all documents, each in at least `least` texts, counted with map-side combine."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [n for t in batch.column(0).to_pylist() if t for n in set(cued_given_names(t))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["given"])

    return spread(documents.select(F.col(text_col))).mapInArrow(names, "given string").groupBy("given").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def learn_given_names(documents: DataFrame, text_col: str = "text", least: int = 2, most: int = 50_000) -> frozenset[str] | DataFrame:
    """The given names of given_name_counts: at most `most` come to the driver as a set, more stay a written table."""
    counts = stage_table(given_name_counts(documents, text_col, least).select("given"), "given")
    rows = counts.limit(most + 1).collect()
    return counts if len(rows) > most else frozenset(r["given"] for r in rows)


def _names_by_text(rows: DataFrame, names: DataFrame, text_col: str) -> DataFrame:
    """Adds _given, the names of the table that are words of the text: all of the table that its items depend on."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {*LETTERS.findall(t.lower()), *(w.lower() for w in _words(t))} if t else ()
                keys += [k] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["_key", "given"])

    keyed = rows.withColumn("_key", F.md5(text_col))
    pairs = keyed.select("_key", text_col).mapInArrow(words, "_key string, given string").join(names, "given", "left_semi")
    return keyed.join(pairs.groupBy("_key").agg(F.collect_set("given").alias("_given")), "_key", "left").drop("_key")


def personal_items(documents: DataFrame, given: frozenset[str] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", key: bytes | None = None, redacted: bool = False) -> DataFrame:
    """One row per distinct item: doc_id, pii_type, pii_text; or with `redacted` one per document: doc_id, n_items, text.

    A set of given names travels to the tasks; a table of them (column given) is joined to the words of the texts.
    The key is that of pseudonym_key unless one is given; it stands in no file of this repository.
    """
    key = pseudonym_key(documents.sparkSession) if redacted and key is None else key
    gazetteer = learn_given_names(documents, text_col) if given is None else given
    joined = isinstance(gazetteer, DataFrame)
    table, gazetteer = (gazetteer, frozenset()) if joined else (None, gazetteer)

    def names_of(batch: pa.RecordBatch) -> list[frozenset[str]]:
        return [frozenset(x or ()) for x in batch.column(2).to_pylist()] if joined else [gazetteer] * batch.num_rows

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, texts = [], [], []
            for i, t, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), names_of(batch), strict=True):
                for kind, item in sorted({(k, t[a:b]) for a, b, k in find_items(t, names)}) if t else ():
                    ids.append(i)
                    kinds.append(kind)
                    texts.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=[id_col, "pii_type", "pii_text"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, texts = [], []
            for t, names in zip(batch.column(1).to_pylist(), names_of(batch), strict=True):
                found = with_birth_dates(t, find_items(t, names)) if t else []
                n.append(len(found))
                texts.append(redact(t, found, key) if t else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(texts, pa.string())], names=[id_col, "n_items", "text"])

    rows = spread(documents.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col)))
    if joined:
        rows = _names_by_text(rows, table, text_col)
    if redacted:
        return rows.mapInArrow(clean, f"{id_col} long, n_items int, text string")
    return rows.mapInArrow(items, f"{id_col} long, pii_type string, pii_text string")
