"""Personal information in free text: find it, replace it by keyed surrogates.

Detection is a pure function of one text and the list of known name parts, so
it runs in one pass without a shuffle. Offsets count code points.
"""

from __future__ import annotations


import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.session import cut

SPANS = "doc_id bigint, kind string, start_pos int, end_pos int, surface string, entity string"
#: More name parts than this are not sent to the executors in one piece.
MAX_NAME_PARTS = 500_000

#: Full-width forms read as their ASCII twins; one character stays one character.
_NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x2007: 0x20, 0x202F: 0x20, 0x2011: 0x2D, 0x2019: 0x27}

# Mailboxes
_AT = r"(?:@|[ \t]?[\[({<][ \t]?(?:at|AT|arroba|@)[ \t]?[\])}>][ \t]?)"
_DOT = r"(?:\.|[ \t]?[\[({<][ \t]?(?:dot|DOT|punto|punkt|\.)[ \t]?[\])}>][ \t]?)"
_LOCAL = r"(?<![\w.%+\-])[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_EMAIL = re.compile(rf"{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9_])")
_SPOKEN = re.compile(rf"{_LOCAL}(?: (?:at|AT|arroba|ARROBA) ){_LABEL}(?: (?:dot|DOT|punto|PUNTO|punkt) {_LABEL})+(?![A-Za-z0-9_])")
_AT_HINT = re.compile(r"@[A-Za-z0-9]|[\[({<][ \t]?(?:at|AT|arroba|@)[ \t]?[\])}>]")
_SPOKEN_HINT = re.compile(r" (?:dot|DOT|punto|PUNTO|punkt) ")

# Numbers
_EDGE, _STOP = r"(?<![\w.@#/+\-])", r"(?![\w@]|[.\-/,:]\d)"
_PHONE = re.compile(
    r"(?=[+(\d])(?:"
    + "|".join(
        (
            r"(?<![\w.@#/+])\+\d{1,3}(?:[ .\-/]?(?:\(\d{1,5}\)[ .\-/]?)?\d{1,12}){1,7}",
            _EDGE + r"00\d{2}(?:[ .\-/]\d{2,12}){1,6}",
            r"(?<![\w.@#/+\-])\(0?\d{2,5}\)[ .\-/]?\d{3,8}(?:[ .\-]\d{2,5}){0,3}",
            _EDGE + r"(?:1[\-. ])?\d{3}([\-.])\d{3}\1\d{4}",
            _EDGE + r"0\d{2,5}/\d{4,9}(?:-\d{1,5})?",
            _EDGE + r"0\d(?:[. ]\d{2}){4}",
            _EDGE + r"0\d{3,4}[ \-]\d{3}[ \-]?\d{3,4}",
            _EDGE + r"0\d{1,2}[ \-]\d{4}[ \-]\d{4}",
            _EDGE + r"1[3-9]\d{9}",
        )
    )
    + ")"
    + _STOP
)
# What announces a telephone number, in whatever layout it then comes.
_NUMBER_RUN = re.compile(r"(?=[+(\d])(?<![\w.@#/+\-(])[+(]?\d{2,5}\)?(?:[ .\-/]\d{2,5}){1,4}" + _STOP)
_CALL = re.compile(
    r"(?i)(?:\b(?:tel|phone|call|ring|mobile|cell|fax|telefon|handy|anrufen|tel[eé]fono|m[oó]vil|llamar)\b\.?(?: (?:number|nummer|no\.|me|us|him|her|them))?(?: (?:at|on|is|unter|al))?[:：]? ?|(?:电话|手机|致电)[:：]? ?)\Z"
)
_IDS = re.compile(
    r"(?=[A-Z\d])(?:(?<![\w.\-])\d{3}([\- ])\d{2}\1\d{4}(?![\w\-]|\.\d)"
    r"|(?<![A-Za-z0-9])[A-CEGHJ-PQRST-Z][A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9.\-])[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?![A-Za-z0-9]))"
)

# Addresses. Words that end, begin or surround street names.
_UP = r"[A-ZÀ-ÖØ-Þ][\w'\-]*"
_EN_STREET = "Street|St|Road|Rd|Lane|Ln|Court|Ct|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Close|Way|Square|Sq|Terrace|Place|Pl|Crescent|Gardens|Grove|Mews|Row|Hill|Parkway|Pkwy|Circle|Highway|Hwy"
_UNIT = r"(?:Apt|Apartment|Unit|Suite|Ste|Flat|Floor|Fl|Room|Rm|#)\.? ?\d+[A-Za-z]?"
_CODE = r"(?:[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}|\d{5}(?:-\d{4})?|[A-Z]{2} \d{5})"
_EN = re.compile(
    rf"(?=[\dAUSFR#])(?<![\w.\-/])(?:{_UNIT}, )?\d{{1,5}}[A-Za-z]?(?:-\d{{1,5}})? (?:[NSEW]\.? |North |South |East |West )?{_UP}(?: {_UP}){{0,2}}? (?:{_EN_STREET})\b"
    rf"(?:,? {_UNIT})?(?:, (?!{_UNIT}){_UP}(?: {_CODE}\b)?|,? {_CODE}\b)?",
)
_TAIL = rf"(?:, ?(?:\d{{4,5}} {_UP}|{_UP}(?: \d{{4,5}}\b)?))?"
_NUMBER = r"\d{1,4}(?: ?[a-h]\b)?"
_DE = re.compile(
    rf"(?<![\w\-])[A-ZÄÖÜ][\wäöüß\-]*?(?:str\.|straße|strasse|weg|platz|gasse|allee|ring|damm|ufer) {_NUMBER}{_TAIL}"
    rf"|(?<![\w\-])(?:[A-ZÄÖÜ][\wäöüß\-]*[ \-])(?:Str\.|Straße|Strasse|Weg|Platz|Gasse|Allee|Ring|Damm|Ufer) {_NUMBER}{_TAIL}"
    rf"|(?<![\w\-])(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|Unter den|Hinter der|Beim) [A-ZÄÖÜ][\wäöüß\-]+ {_NUMBER},? ?\d{{4,5}} {_UP}"
)
#: What every German address has, found fast, where the whole pattern would be tried at each word: an ending before a number, or a preposition.
_DE_HINTS = (re.compile(r" \d(?<=(?:tr\.|aße|sse|weg|atz|lee|ing|amm|fer) \d)"), re.compile(r"[AIZUHB](?:[mn]|uf|u[mr]|nter|inter|eim) [A-ZÄÖÜd]"))
_ES = re.compile(rf"(?=[CAPRV])(?<![\w/])(?:Calle|C/|C\.|Avda\.|Av\.|Avenida|Plaza|Pza\.|Paseo|P\.º|Camino|Carretera|Ctra\.|Ronda|Rue|Via) ?(?:de la |de los |de las |del |de )?{_UP}(?: (?:de |del |la )*{_UP}){{0,2}},? {_NUMBER}{_TAIL}")
_ZH = re.compile(r"([一-鿿]{1,12}?)(大街|大道|路|街|巷|胡同|弄)(\d{1,5})号(?:[一-鿿]?\d{1,4}(?:号楼|单元|栋|幢|楼|层|室|座|号))*")
_ZH_CUT = re.compile("[在于到址是住为至往给向]")

# Person names
_PARTICLE = r"(?:(?:van der|van den|van de|van|von der|von|zu|de la|de los|de las|de|del|della|di|da|dos|le|la|el|al|bin|ben|ter|ten|VAN DER|VAN DEN|VAN DE|VAN|VON|DE LA|DE LOS|DE|DEL|DI|DA|Van|Von|De la|De|Del|Di|Da|Mac|MAC|Mc|Le|La|El|Al|St\.) )"
_LATIN = r"(?:[A-ZÀ-ÖØ-Þ]'(?=[A-ZÀ-ÖØ-Þ]))?[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+)(?![A-Za-zÀ-ÿ])"
_WORD = rf"{_LATIN}(?:-{_LATIN})*"
_INIT = r"[A-ZÀ-ÖØ-Þ]\."
_GIVEN = rf"(?:{_WORD}|{_INIT}(?:[ \-]?{_INIT})*)"
_MIDDLE = rf"(?: {_INIT})*"
_FAMILY = rf"{_PARTICLE}?{_WORD}"
# Roles that people have, and what is done by, with or to people, in the languages of the texts.
_ROLE = (
    "owner|co-owner|author|co-author|reviewer|assignee|assigned to|contact|contact person|maintainer|manager|approver|reporter|editor|lead|team lead|committer|tester|engineer|developer|responsible|on call|on-call|"
    "from|to|cc|bcc|attn|signed|name|sender|recipient|autor|autorin|prüfer|prüferin|ansprechpartner|ansprechpartnerin|bearbeiter|bearbeiterin|verantwortlich|verantwortliche|zuständig|kontakt|gemeldet|"
    "autora|revisor|revisora|responsable|contacto|encargado|encargada|asignado a|remitente"
)
_BY = (
    "written|reviewed|reported|reported first|handled|handed over|fixed|found|raised|approved|merged|opened|requested|proposed|implemented|tested|confirmed|signed|signed off|authored|committed|suggested|noticed|debugged|maintained|owned"
)
_WITH = "talked|talk|spoke|speak|spoken|met|meet|chatted|paired|checked|agreed|worked|discussed|coordinate|coordinated|reviewed|reviewed together|sync|synced"
_TO = "ask|contact|ping|call|notify|inform|thank|remind|consult|email"
_TRIGGER = (
    rf"(?:(?i:(?<!\w)(?:(?:{_ROLE}|[a-z]+(?:ed|ed-off)-by): ?|(?:{_BY}) by |(?:{_WITH}) (?:to|with) |(?:please )?(?:{_TO}) |thanks to |hand(?:ed)? over to |@author |cc |"
    r"(?:geprüft|gemeldet|freigegeben|geschrieben|erstellt|übergeben) (?:von|an) |(?:rücksprache|besprochen|abgestimmt|gesprochen) mit |bitte vorher |bitte (?:an|bei|mit) |"
    r"(?:revisado|informado|aprobado|escrito) por |(?:consultar|hablar|coordinar|revisar) con |preguntar a ))"
    r"|(?:评审人|负责人|作者|联系人|审核人|提交人|报告人): ?|(?:请先联系|请联系|联系|咨询) ?|TODO\(|FIXME\(|\b(?:Dr|Mr|Mrs|Ms|Prof|Hr|Fr|Herr|Frau|Sr|Sra)\.? )"
)
_CUE = re.compile(rf"{_TRIGGER}(?:(?:Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Sr|Sra)\.? )?\Z")
#: What stands right before a name after a cue; most words do not, so the long pattern is tried seldom.
_LAST = frozenset(f"by to with {_TO.replace('|', ' ')} over author @author cc von an mit bei vorher por con a dr mr mrs ms prof hr fr herr frau sr sra {_ROLE.replace('|', ' ')}".split())

_LAST_WORD = re.compile(r"(@?[^\W\d_]+)\.?\Z")


def _cued(t: str, at: int) -> bool:
    """Whether a cue for a person ends at ``at``."""
    before = t[max(0, at - 60) : at]
    last = before.rstrip(" ")
    if not last or last[-1] not in ":(：" and not ("一" <= last[-1] <= "鿿"):
        word = _LAST_WORD.search(last)
        if not word or word[1].lower() not in _LAST:
            return False
    return bool(_CUE.search(before))


# Words that begin with a capital after a cue without being a person's.
_NO_NAME = frozenset(
    """Team Group Service Services Support Platform Module Release Branch Build Project Queue Desk List Board Office Operations Engineering Security Release Core System Server Ticket Issue Customer Customers Users The This That Our Your All Any
    Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Abteilung Gruppe Equipo Grupo""".split()
)
_OWNED = re.compile(rf"(?<![\w'\-.@])(?P<n>(?P<fam1>{_FAMILY}), (?P<giv1>{_GIVEN}{_MIDDLE})|(?P<giv2>{_GIVEN}{_MIDDLE}) (?P<fam2>{_FAMILY}))(?='s [a-z])")
_TURNED_HINT = re.compile(r"[A-Za-zÀ-ÿ], [A-ZÀ-ÖØ-Þ]")
_HAN = re.compile(r"([一-鿿]{1,8})[·・•]([一-鿿]{1,8})")


class Detector:
    """Finds the spans of one text; ``parts`` are known (name part, kind) pairs."""

    def __init__(self, parts: list[tuple[str, str]]):
        latin = [(p, k) for p, k in parts if p and re.match(r"[A-Za-zÀ-ÿ]", p)]
        self.given = {v for p, k in latin if k == "given" for v in (p, p.upper())}
        self.family = {v for p, k in latin if k == "family" for v in (p, p.upper())}
        self.han_given = sorted((p for p, k in parts if p and not re.match(r"[A-Za-zÀ-ÿ]", p) and k == "given"), key=len, reverse=True)
        self.han_family = sorted((p for p, k in parts if p and not re.match(r"[A-Za-zÀ-ÿ]", p) and k == "family"), key=len, reverse=True)
        # Any two neighbouring name-like words; what they are is looked up, so the pattern doesn't grow with the list.
        self.near = re.compile(rf"(?=[A-ZÀ-ÖØ-Þ])(?<![\w'\-.@])(?=(?P<n>(?P<giv>{_GIVEN})(?P<more>(?: {_WORD})??)(?P<mid>{_MIDDLE}) (?P<fam>{_FAMILY})))")
        self.turned = re.compile(rf"(?<![\w'\-.@])(?=(?P<n>(?P<fam>{_FAMILY}), (?P<giv>{_GIVEN}{_MIDDLE})))")

    def _known_given(self, s: str) -> bool:
        return any(x in self.given for x in re.split(r"[ \-]", s))

    def _known_family(self, s: str) -> bool:
        return s in self.family or any(x in self.family for x in re.split(r"[ \-]", s))

    def spans(self, text: str) -> list[tuple[str, int, int, str]]:
        """(kind, start, end, entity), without overlaps, in order."""
        t = text.translate(_NARROW) if not text.isascii() else text
        taken: list[tuple[int, int]] = []
        out: list[tuple[str, int, int, str]] = []

        def add(kind: str, a: int, b: int, entity: str) -> None:
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out.append((kind, a, b, entity))

        if _AT_HINT.search(t):
            for m in _EMAIL.finditer(t):
                if self._clone(t, m):
                    taken.append(m.span())
                else:
                    add("email", *m.span(), _email_entity(m[0]))
        if _SPOKEN_HINT.search(t):
            for m in _SPOKEN.finditer(t):
                add("email", *m.span(), _email_entity(m[0]))
        for rx in (_EN, _DE, _ES) if any(h.search(t) for h in _DE_HINTS) else (_EN, _ES):
            for m in rx.finditer(t):
                a = m.start()
                b = a + len(m[0].rstrip(" ,"))
                add("address", a, b, " ".join(m[0].casefold().split()))
        if "号" in t:
            for m in _ZH.finditer(t):
                name = m[1]
                cuts = list(_ZH_CUT.finditer(name))
                keep = len(name) - cuts[-1].end() if cuts else min(len(name), 2)
                if not keep:
                    keep = len(name)
                a = m.start() + len(name) - keep
                add("address", a, m.end(), t[a : m.end()])
        for m in _IDS.finditer(t):
            add("id_number", *m.span(), re.sub(r"[ \-]", "", m[0]).upper())
        for m in _PHONE.finditer(t):
            digits = re.sub(r"\D", "", m[0])
            if 8 <= len(digits) <= 15:
                b = m.end()
                while not t[b - 1].isdigit():
                    b -= 1
                add("phone", m.start(), b, _phone_entity(m[0]))
        for m in _NUMBER_RUN.finditer(t):
            if 9 <= m.end() - m.start() and 7 <= len(re.sub(r"\D", "", m[0])) <= 15 and _CALL.search(t, max(0, m.start() - 40), m.start()):
                add("phone", *m.span(), _phone_entity(m[0]))
        for kind, a, b, e in self.names(t):
            add(kind, a, b, e)
        return sorted(out, key=lambda x: x[1])

    @staticmethod
    def _clone(t: str, m: re.Match) -> bool:
        """A login before a host, as in ``git@host:path``, ``ssh://git@host/`` or ``https://user:pw@host``."""
        before, after = t[max(0, m.start() - 40) : m.start()], t[m.end() : m.end() + 2]
        if re.search(r"[a-z][a-z0-9+.\-]*://(?:[^\s/@]*:)?$", before, re.I):
            return True
        return bool(re.match(r":[\w~/.]", after)) and bool(re.match(r":(?:\d+/)?[\w~.\-]*[/.][\w.\-]", t[m.end() : m.end() + 120]))

    def names(self, t: str) -> Iterator[tuple[str, int, int, str]]:
        near, turned = list(self.near.finditer(t)), list(self.turned.finditer(t)) if _TURNED_HINT.search(t) else []
        known: list[tuple[str, int, int, str]] = []
        if near or turned:
            for m in turned:
                a, b = m.span("n")
                if _cued(t, a) and _nameable(m["n"]):
                    yield ("person_name", a, b, _name_entity(m["giv"], m["fam"]))
            end = 0
            for m in near:
                a, b = m.span("n")
                giv, fam, more = m["giv"], m["fam"], m["more"].strip()
                if a < end or more and more not in self.given:
                    continue
                name = ("person_name", a, b, _name_entity(f"{giv} {more}".strip() + m["mid"], fam))
                if _cued(t, a) and _nameable(m["n"]):
                    yield name
                elif not (self._known_given(giv) or self._known_family(fam)):
                    continue
                # A sentence word before a known given name is no part of the name.
                elif giv not in self.given and fam in self.given and fam not in self.family:
                    continue
                elif self._known_family(giv) and not self._known_given(giv) and not self._known_family(fam):
                    continue
                else:
                    known.append(name)
                end = b
            yield from known
            for m in turned:
                if self._known_family(m["fam"]) or self._known_given(m["giv"]):
                    yield ("person_name", *m.span("n"), _name_entity(m["giv"], m["fam"]))
        for m in _OWNED.finditer(t) if "'s " in t else ():
            yield ("person_name", *m.span("n"), _name_entity(m["giv1"] or m["giv2"], m["fam1"] or m["fam2"]))
        if not t.isascii():
            for m in _HAN.finditer(t):
                g = next((p for p in self.han_given if m[1].endswith(p)), m[1] if len(m[1]) <= 4 else m[1][-3:])
                f = next((p for p in self.han_family if m[2].startswith(p)), m[2] if len(m[2]) <= 4 else m[2][:4])
                yield ("person_name", m.start(2) - 1 - len(g), m.start(2) + len(f), _name_entity(g, f))


def _email_entity(s: str) -> str:
    s = re.sub(r"[ \t]*[\[({<]?[ \t]*\b(?:at|arroba)\b[ \t]*[\])}>]?[ \t]*(?=[a-z0-9])", "@", s.lower(), count=1) if "@" not in s else s.lower()
    return re.sub(r"[ \t]*[\[({<]?[ \t]*\b(?:dot|punto|punkt)\b[ \t]*[\])}>]?[ \t]*", ".", s)


def _phone_entity(s: str) -> str:
    s = re.sub(r"\(0\)", "", s)
    d = re.sub(r"\D", "", s)
    return "+" + (d if s.startswith("+") else d[2:]) if s.startswith(("+", "00")) else d


def _name_entity(given: str, family: str) -> str:
    """``family|given``, so that both orders of a name agree."""
    return " ".join(f"{family}|{given}".casefold().split())


def _nameable(s: str) -> bool:
    return not _NO_NAME.intersection(re.split(r"[ ,\-]+", s))


def detect(docs: DataFrame, name_parts: DataFrame) -> DataFrame:
    """One row per occurrence: (doc_id, kind, start_pos, end_pos, surface, entity).

    ``docs``: (doc_id, text); ``name_parts``: (name_part, part_kind), a list of
    known parts of person names, refused above MAX_NAME_PARTS. ``entity`` is
    the normal form in which different spellings of one thing agree. Null and
    empty texts have no rows; spans of a text do not overlap; whole texts are
    read, however long.
    """
    rows = name_parts.where("name_part is not null and part_kind is not null").select("name_part", "part_kind").distinct().limit(MAX_NAME_PARTS + 1).collect()
    if len(rows) > MAX_NAME_PARTS:
        raise ValueError(f"more than {MAX_NAME_PARTS} name parts")
    parts = sorted((r[0], r[1]) for r in rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Detector(parts)
        cols = ["doc_id", "kind", "start_pos", "end_pos", "surface", "entity"]
        for b in batches:
            out = []
            for i, text in zip(b["doc_id"], b["text"]):
                if text:
                    out += [(i, k, x, y, text[x:y], e) for k, x, y, e in found.spans(text)]
            yield pd.DataFrame(out, columns=cols)

    return docs.where("text is not null and text <> ''").select("doc_id", "text").mapInPandas(run, SPANS)


# Surrogates

_ONSET = "b br c d dr f g gr h j k l m n p pr qu r s st t tr v w z".split()
_NUCLEUS = "a e i o u ae ei ia".split()
_HAN_POOL = "安柏晨达恩芳格海嘉凯兰铭宁鹏清瑞森婷文欣雅泽书远航静怡博涵君诚立春秋松竹梅光明德高山云飞建国永平和美玉珍华"
# Given names whose ending tells the wrong gender.
_FEMALE = frozenset("carmen ingrid karen ruth esther heather elizabeth margaret astrid birgit doris iris judith kathrin katrin karin beatriz isabel raquel pilar dolores mercedes rosario consuelo inés agnes gertrud hannelore ingeborg sigrid erin megan lauren allison kim jean joan janet meredith".split())
_MALE = frozenset("luca andrea joshua nikita sasha mika borja elia ezra noah jonah micah nicola uwe helge hauke heinz-eva bela attila mustafa isa musa garcía".split())
# The words of an address that say what kind of place it is; they stay.
_KEPT = frozenset((_EN_STREET + "|apt|apartment|unit|suite|ste|flat|floor|fl|room|rm|north|south|east|west|n|s|e|w|calle|c|avda|av|avenida|plaza|pza|paseo|p|camino|carretera|ctra|ronda|rue|via|de|la|las|los|del|el|am|an|der|den|im|in|auf|dem|zum|zur|unter|hinter|beim|str|straße|strasse|weg|platz|gasse|allee|ring|damm|ufer").casefold().split("|"))
_TAILS = re.compile(r"(?i)(?<=\w)(?:straße|strasse|str|weg|platz|gasse|allee|ring|damm|ufer)$")
_PLACE = re.compile(r"\d+|[A-Za-zÀ-ÖØ-öø-ÿß]+(?:['\-][A-Za-zÀ-ÖØ-öø-ÿß]+)*|大街|大道|胡同|号楼|单元|[路街巷弄号楼栋幢层室座省市区县镇]|[一-鿿]|.", re.S)
_PARTICLES = re.compile(rf"(?i){_PARTICLE}")


@lru_cache(maxsize=200_000)
def _bits(key: bytes, kind: str, entity: str, attempt: int) -> int:
    said = f"{kind}\x00{entity}\x00{attempt}".encode()
    return int.from_bytes(b"".join(hmac.digest(key, said + bytes([i]), "sha512") for i in range(2)), "big")


@lru_cache(maxsize=100)
def _letters(key: bytes) -> dict[str, str]:
    """A keyed permutation of the letters: what initials become."""
    abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return dict(zip(abc, sorted(abc, key=lambda c: hmac.digest(key, b"letter" + c.encode(), "sha256"))))


def _letter(key: bytes, c: str) -> str:
    c = unicodedata.normalize("NFD", c.upper())[0]
    known = _letters(key)
    return known.get(c) or known["ABCDEFGHIJKLMNOPQRSTUVWXYZ"[ord(c) % 26]]


def _draw(n: int, pool) -> tuple[int, str]:
    n, i = divmod(n, len(pool))
    return n, pool[i]


def _latin_word(n: int, syllables: int, tail: str) -> tuple[int, str]:
    out = ""
    for _ in range(syllables):
        n, a = _draw(n, _ONSET)
        n, b = _draw(n, _NUCLEUS)
        out += a + b
    return n, (out + tail).capitalize()


def _cased(like: str, s: str) -> str:
    return s.upper() if like.isupper() and len(like) > 1 else s.lower() if like.islower() else s


def _digits(n: int, like: str) -> tuple[int, str]:
    out = ""
    for i, c in enumerate(like):
        n, d = _draw(n, "123456789" if i == 0 and c != "0" else "0123456789")
        out += chr(ord(d) + 0xFEE0) if ord(c) > 0xFF00 else d
    return n, out


def gender(given: str) -> str:
    """``f``, ``m`` or ``u`` (open) by a short list and the ending of a given name."""
    g = given.casefold()
    if g in _FEMALE:
        return "f"
    if g in _MALE:
        return "m"
    return "f" if g.endswith(("a", "ie", "ine", "elle", "ette")) else "u" if g.endswith(("e", "i", "y")) else "m"


_ENDS = {"f": ("a", "ia", "ina"), "m": ("n", "r", "ld", "s"), "u": ("i", "e", "y")}


def pieces(kind: str, surface: str, entity: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of the parts of a span that are replaced one by one.

    A name has its given names, initials and family names, each an entity of
    its own, so that ``J. Smith``, ``Smith, John`` and ``JOHN SMITH`` stay
    recognisable as one; particles, hyphens and the order stay. Everything
    else is one piece.
    """
    if kind != "person_name":
        return [(0, len(surface), kind, entity)]
    family = entity.partition("|")[0]
    comma, dot = surface.find(", "), re.search("[·・•]", surface)
    if dot:
        return [(0, dot.start(), "given", surface[: dot.start()]), (dot.end(), len(surface), "family", surface[dot.end() :])]
    a, b = (0, comma) if comma >= 0 and surface[:comma].casefold() == family else (len(surface) - len(family), len(surface))
    out = []
    m = _PARTICLES.match(surface, a, b)
    for w in re.finditer(r"(?:[^\W\d_]')?([^\s\-]+)", surface[m.end() if m and m.end() < b else a : b]):
        at = (m.end() if m and m.end() < b else a) + w.start(1)
        out.append((at, at + len(w[1]), "family", w[1].casefold()))
    x, y = (b + 1, len(surface)) if a == 0 and b < len(surface) else (0, a)
    for w in re.finditer(r"[^\s\-,.]+", surface[x:y]):
        out.append((x + w.start(), x + w.end(), "initial" if len(w[0]) == 1 else "given", w[0].casefold()))
    return sorted(out)


def surrogate(key: bytes, kind: str, entity: str, surface: str, attempt: int = 0) -> str:
    """A replacement for a piece that depends on its entity only, apart from its layout.

    Digits are drawn anew within the layout of numbers (the country prefix
    stays). Given names keep their gender, and their first letter follows the
    same keyed permutation as initials do. Names and addresses keep script and
    case, addresses also the words for the kind of place, their numbers'
    lengths, unit, postcode and town. Mailboxes of one domain stay in one
    domain, which ends in the reserved ``example``.
    """
    if attempt < 0:  # nothing free was found: made distinct by force
        return f"{surrogate(key, kind, entity, surface)}-{_bits(key, kind, entity, -1) & (2**64 - 1):016x}"
    n = _bits(key, kind, entity, attempt)
    han = bool(re.search("[一-鿿]", surface))
    if kind == "initial":
        return surface if han else _letter(key, surface)
    if kind == "given" or kind == "family":
        if han:
            s = ""
            for _ in range(len(surface) + (attempt > 3)):
                n, c = _draw(n, _HAN_POOL)
                s += c
            return s
        if kind == "family":
            n, end = _draw(n, ("n", "r", "l", "sen", "mar", "wick"))
            n, s = _latin_word(n, 2 + (attempt > 0), end)
        else:
            first = _letter(key, surface[0])
            n, mid = _draw(n, _NUCLEUS[:5]) if first not in "AEIOU" else _draw(n, ("l", "r", "n", "d", "m"))
            n, rest = _latin_word(n, 1 + (attempt > 0), "")
            n, end = _draw(n, _ENDS[gender(entity)])
            stem = first + mid + (rest if mid in "aeiou" else rest[-2:] + rest).lower()
            s = stem.rstrip("aeiou") + end if end[0] in "aeiouy" else stem + end
        return _cased(surface, s)
    if kind in ("phone", "id_number"):
        keep = len(re.match(r"\+?\d{1,2}(?=[ (])|\+1|\+|", surface)[0]) if kind == "phone" and surface.startswith("+") else 0
        out = []
        for i, ch in enumerate(surface):
            if i >= keep and ch.isdigit():
                n, d = _draw(n, "0123456789")
                out.append(chr(ord(d) + 0xFEE0) if ord(ch) > 0xFF00 else d)
            elif kind == "id_number" and ch.isalpha():
                n, d = _draw(n, "ABCD" if i == len(surface) - 1 and ch in "ABCD" else "ABCEGHJKLMNPRSTWXYZ" if ch not in "Xx" else "X")
                out.append(d)
            else:
                out.append(ch)
        return "".join(out)
    if kind == "email":
        local, _, domain = entity.partition("@")
        words = []
        for part in re.split(r"([._+\-])", local or "x"):
            if part and part not in "._+-":
                n, part = _latin_word(n, 2, "n")
            words.append(part)
        _, host = _latin_word(_bits(key, "domain", domain, 0), 2, "l")
        at = (re.search(r"[ \t]?[\[({<][ \t]?(?:at|arroba|@)[ \t]?[\])}>][ \t]?| (?:at|arroba) |@|＠", surface, re.I) or [" at "])[0]
        dot = (re.search(r"[ \t]?[\[({<][ \t]?(?:dot|punto|punkt|\.)[ \t]?[\])}>][ \t]?| (?:dot|punto|punkt) ", surface, re.I) or ["."])[0]
        s = "".join(words).lower() + at + f"{host}mail".lower() + dot + "example"
        return s.upper() if surface.isupper() else s
    out = []
    for m in _PLACE.finditer(surface):
        w = m[0]
        if w.isdigit():
            n, w = _digits(n, w)
        elif re.fullmatch("[一-鿿]", w) and w not in "路街巷弄号楼栋幢层室座省市区县镇":
            n, w = _draw(n, _HAN_POOL)
        elif w[0].isalpha() and ord(w[0]) < 0x2E80 and w.casefold() not in _KEPT:
            tail = _TAILS.search(w)
            if len(w) <= 2:
                fresh = ""
                for c in w:
                    n, d = _draw(n, "abcdefgh" if c.islower() else "ABCDEFGHJKLMNPRSTUWXY")
                    fresh += d
                w = fresh
            else:
                n, end = _draw(n, ("n", "r", "l", "nd", "m"))
                n, fresh = _latin_word(n, (2 if len(w) < 8 else 3) + (attempt > 0), end)
                w = _cased(w, fresh + (tail[0].lower() if tail else ""))
        out.append(w)
    return "".join(out)


def _same_form(kind: str, s: str) -> str:
    """The form in which surrogates and real entities of a kind are compared."""
    t = s.translate(_NARROW)
    if kind == "email":
        return _email_entity(t)
    if kind == "phone":
        return _phone_entity(t)
    if kind == "id_number":
        return re.sub(r"[ \-]", "", t).upper()
    return " ".join(s.casefold().split())


PIECES = "doc_id bigint, span_kind string, span_start int, span_end int, start_pos int, end_pos int, kind string, entity string, surface string"


def span_pieces(spans: DataFrame) -> DataFrame:
    """PIECES of every span: what is replaced, and where."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in PIECES.split(", ")]
        for b in batches:
            rows = []
            for i, k, x, y, s, e in zip(b["doc_id"], b["kind"], b["start_pos"], b["end_pos"], b["surface"], b["entity"]):
                rows += [(i, k, x, y, x + p, x + q, kind, ent, s[p:q]) for p, q, kind, ent in pieces(k, s, e)]
            yield pd.DataFrame(rows, columns=cols)

    return spans.select("doc_id", "kind", "start_pos", "end_pos", "surface", "entity").mapInPandas(run, PIECES)


def surrogates(parts: DataFrame, key: str, rounds: int = 6) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate is not their own.

    Two different entities of a kind must not get one surrogate, nor may a
    surrogate be an entity that really occurs. Entities are reduced to one row
    each before anything else; those whose surrogate collides draw again (of a
    group all but the first), ``rounds`` times at most; those that still
    collide (a layout with too few values) get attempt -1, which appends a
    keyed mark. Initials follow a permutation and never collide. The result is
    empty unless there were collisions.
    """
    ent = parts.where("kind <> 'initial'").groupBy("kind", "entity").agg(F.min("surface").alias("surface")).withColumn("attempt", F.lit(0))
    ent = cut(ent.withColumn("s", _form_udf(key)("kind", "entity", "surface", "attempt")))
    real = ent.select("kind", F.col("entity").alias("s"), F.lit(True).alias("real"))
    clash = (F.row_number().over(W.partitionBy("kind", "s").orderBy("attempt", "entity")) > 1) | F.col("real").isNotNull()
    for last in [False] * rounds + [True]:
        ranked = cut(ent.join(real, ["kind", "s"], "left").withColumn("again", clash).drop("real"))
        if ranked.where("again").isEmpty():
            break
        step = F.lit(-1) if last else F.col("attempt") + 1 + F.pmod(F.xxhash64("entity"), F.lit(1_000_000)).cast("int")
        more = ranked.where("again").withColumn("attempt", step)
        more = more.withColumn("s", _form_udf(key)("kind", "entity", "surface", "attempt"))
        ent = ranked.where("not again").unionByName(more).drop("again")
    return ent.where("attempt <> 0").select("kind", "entity", "attempt")


def _udf(key: str):
    secret = key.encode()

    @F.pandas_udf("string")
    def draw(kind: pd.Series, entity: pd.Series, surface: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(secret, k, e, s, int(a)) for k, e, s, a in zip(kind, entity, surface, attempt)], dtype=object)

    return draw


def _form_udf(key: str):
    secret = key.encode()

    @F.pandas_udf("string")
    def draw(kind: pd.Series, entity: pd.Series, surface: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([_same_form(k, surrogate(secret, k, e, s, int(a))) for k, e, s, a in zip(kind, entity, surface, attempt)], dtype=object)

    return draw


def redact(docs: DataFrame, name_parts: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_spans): every span replaced by ``[kind: surrogate]``, the rest untouched.

    One entity gets the same surrogate everywhere (under one ``key``), two
    entities never the same one, and none a real one. The texts are searched
    once; the spans found are written down. Documents without text keep what
    they have.
    """
    parts = cut(span_pieces(detect(docs, name_parts)))
    again = surrogates(parts, key)
    named = parts.join(again, ["kind", "entity"], "left").withColumn("s", _udf(key)("kind", "entity", "surface", F.coalesce("attempt", F.lit(0))))
    per_doc = named.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "span_start", "span_end", "span_kind", "s"))).alias("x"))

    @F.pandas_udf("string")
    def put(text: pd.Series, x: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, x):
            if t is None or found is None:
                out.append(t)
                continue
            done, at, open_ = [], 0, None
            for p in found:
                if open_ is not None and p["span_start"] != open_[0]:
                    done += [t[at : open_[1]], "]"]
                    at, open_ = open_[1], None
                if open_ is None:
                    done += [t[at : p["span_start"]], f"[{p['span_kind']}: "]
                    at, open_ = p["span_start"], (p["span_start"], p["span_end"])
                done += [t[at : p["start_pos"]], p["s"]]
                at = p["end_pos"]
            if open_ is not None:
                done += [t[at : open_[1]], "]"]
                at = open_[1]
            out.append("".join(done) + t[at:])
        return pd.Series(out, dtype=object)

    joined = docs.select("doc_id", "text").join(per_doc, "doc_id", "left")
    n = F.coalesce(F.size(F.array_distinct(F.transform("x", lambda p: p["span_start"]))), F.lit(0))
    return joined.select("doc_id", put("text", "x").alias("text"), F.greatest(n, F.lit(0)).alias("n_spans"))
