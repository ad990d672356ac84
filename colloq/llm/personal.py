"""Personal information in free text: finding it, and replacing it by typed placeholders.

Numbers and dates in a placeholder are pseudonyms from a keyed Feistel network: they keep the format they were written
in (separators, letters, country code, whether a check digit holds, a date stays a date), and one value gets one
pseudonym however and wherever it is written, so records stay linked and different values stay different. E-mail
addresses, postal addresses and names, which have no format to permute in, get a keyed token, which links them the same
way.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "address", "name")

# Country calling codes of one and two digits; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
BIRTH_WORDS = r"生年月日|誕生日|生まれ|\bborn(?: on)?|date of birth|\bd\.?o\.?b\b|birthday|geboren(?: am)?|geburtsdatum|\bnée?(?: le)?\b|date de naissance|fecha de nacimiento|nacid[oa] el|出生日期|생년월일"

# Full-width ASCII and the ideographic space, one character for one, so that positions stay.
_FOLD = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20}
_KANJI = {ord(c): str(i) for i, c in enumerate("〇一二三四五六七八九")} | {ord("零"): "0"}
_SEP = r"[\s.\-‐‑–—−ーｰ]"
_K = "〇零一二三四五六七八九"
_LATIN = "0-9A-Za-z_À-ɏ"
_FRENCH = re.compile(r"\b(?:le|la|les|est|une|des|du|de|numéro|demain|présente|avec|pour|et)\b|[éèêàç]", re.I)
_SPOKEN = "zero oh one two three four five six seven eight nine".split()
_SPOKEN_DIGIT = {w: str(max(0, i - 1)) for i, w in enumerate(_SPOKEN)}

# Words before a number that say whose it is.
ID_WORDS = (
    r"マイナンバー|個人番号|免許証|免許番号|運転免許|保険証|保険番号|被保険者|旅券|パスポート|年金番号|社会保障|納税者番号|住民票コード|在留カード"
    r"|social security|\bSSN\b|insurance (?:number|no)|passport|licen[cs]e (?:number|no)|tax (?:id|number|file|payer)|national (?:id|insurance)|\bid card"
    r"|steuer-?(?:id|nummer|identifikation)|sozialversicherung|personalausweis|reisepass|ausweisnummer|führerschein|sécurité sociale|passeport|numéro fiscal|permis de conduire"
    r"|\bdni\b|\bnie\b|\bnif\b|seguridad social|pasaporte|carné de conducir|身份证|身份證|护照|護照|社保|驾照|驾驶证|주민등록|여권|운전면허|보험증|أتاريخ|رقم الهوية|جواز|आधार|पासपोर्ट|บัตรประชาชน|หนังสือเดินทาง"
)
NO_PHONE = re.compile(r"(?:チケット|シリアル|ジョブ|会議ID|会議番号|注文|型番|製番|管理番号|伝票|ticket|serial|build|job|order|invoice|meeting id|version|release|seeds?|batch|run|box|room|raum|port|ip|チケット番号は|시리얼|티켓|工单|序列号)[^\d+(]{0,14}$", re.I)
PHONE_WORDS = re.compile(r"電話|連絡先|折り返し|番号が変わって|携帯|\btel\b|phone|call|ring|number|answers? at|reach|rufen|anruf|telefon|nummer|llame|teléfono|numéro|appel|téléphone|电话|電話|手机|전화|هاتف|फ़ोन|फोन|โทร", re.I)

_TLD = r"[A-Za-z]{2,12}"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9_%+'-]|\.(?=[A-Za-z0-9_%+'-]))*"
_AT = r"(?:\s?@\s?|\s?\(\s?at\s?\)\s?|\s?\[\s?at\s?\]\s?|\s?\{\s?at\s?\}\s?|\s*アットマーク\s*|\s*アット\s*)"
_DOT = r"(?:\s?\[\s?dot\s?\]\s?|\s?\(\s?dot\s?\)\s?|\s?\{\s?dot\s?\}\s?|\s+dot\s+|\s*ドット\s*)"
_EMAIL = re.compile(
    rf"(?<![A-Za-z0-9_.+@/-])(?:{_LOCAL}(?:{_DOT}{_LOCAL})*{_AT}[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)*(?:\.|{_DOT}){_TLD}"
    rf"|{_LOCAL}(?:{_DOT}{_LOCAL})*\s+at\s+[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}{_TLD})(?![A-Za-z0-9@_-])",
    re.I,
)
_NUMBER = re.compile(rf"(?<![0-9A-Za-z.+/#@_:-])(?:\+\s?\d{{1,3}}{_SEP}?)?(?:\(\d{{1,5}}\)|\d{{1,8}})(?:{_SEP}?\(?\d{{1,8}}\)?){{1,5}}(?![0-9A-Za-z@:])")
_KANJI_PHONE = re.compile(rf"(?<![{_K}])[{_K}]{{2,5}}(?:[のノ\-‐−ー・ ][{_K}]{{2,4}}){{2}}(?![{_K}])|(?<![{_K}])[〇零][{_K}]{{9,10}}(?![{_K}])")
_SPOKEN_PHONE = re.compile(rf"(?<![A-Za-z])(?:(?:plus|{'|'.join(_SPOKEN)})[ ,-]{{1,2}}){{8,13}}(?:{'|'.join(_SPOKEN)})(?![A-Za-z])", re.I)
_ID = re.compile(rf"(?:{ID_WORDS})[^0-9{_K}。.!?！？\n]{{0,24}}?((?:(?<![A-Za-z])(?-i:[A-Z]{{1,3}})[ -]?)?\d(?:{_SEP}?\d){{6,14}}(?-i:[A-Z])?(?![0-9A-Za-z])|[{_K}](?:[ \-−ー・の]?[{_K}]){{8,14}})", re.I)

_PREF = r"(?:[一-鿿]{1,3}[都道府県])"
_CITY = r"(?:[一-鿿]{1,4}(?:の[一-鿿]{1,2})?[市区郡町村])"
_N = r"[0-9一二三四五六七八九十]{1,4}"
_HY = r"\s?[\-‐‑–—−ー]\s?"
_BLDG = r"(?:\s?(?:[一-鿿ァ-ヺー]{1,10}(?:ビル|荘|館|寮|ハイツ|マンション|タワー|コーポ|アパート)|(?:コーポ|メゾン|ハイツ|マンション|アパート|グラン|パーク|ヴィラ|レジデンス|サン)[一-鿿ァ-ヺーA-Za-z]{0,10})\s?[0-9]{0,4}(?:号室|号|階|F)?|\s?[0-9]{1,4}(?:号室|階))"
_ADDRESS_JA = re.compile(rf"(?:〒\s?[0-9]{{3}}{_HY}?[0-9]{{4}}\s*)?(?:{_PREF}{_CITY}?|{_CITY})(?:{_CITY})?[一-鿿ぁ-んァ-ヺヶー]{{1,8}}?(?:{_N}丁目(?:\s?{_N}(?:番地?(?:の?{_N})?号?|{_HY}{_N}(?:号)?(?:{_HY}{_N})?)(?:\s?{_N}号)?)?|{_N}番地?(?:の{_N}|{_N}号)?|[0-9]{{1,4}}(?:{_HY}[0-9]{{1,4}}){{1,3}}){_BLDG}?")
_LEADS_JA = "昨日 今日 明日 本日 先日 先週 今週 来週 毎日 現在 今回 翌日 新住所 旧住所 住所 届先 宛先 会場 場所 勤務先 自宅 実家 本社 支社".split()
_STREET = r"(?:street|lane|avenue|court|row|road|drive|close|crescent|terrace|place|square|boulevard|mews|gardens|grove|hill|walk|st\.|ave\.|rd\.|blvd\.)"
_STOP = r"(?!(?:on|the|of|in|at|to|for|and|or|by|from|a|an|is|are|was|minutes?|tickets?|times?|items?|hours?|days?|weeks?)\b)"
_TOWN = r"(?:(?-i:[A-Z])[A-Za-z'-]+(?:[ -](?-i:[A-Z])[A-Za-z'-]+){0,2}|(?:(?:lower|upper|new|old|north|south|east|west|great|little|port|st|saint|fort|san|los) )?[a-z'-]{3,20})"
_ADDRESS_EN = re.compile(rf"(?<![0-9A-Za-z])(?:(?:flat|unit|apt\.?|apartment|suite|room) [0-9]{{1,4}}[a-z]?, )?[0-9]{{1,5}}[a-z]? (?:{_STOP}[A-Za-z'-]+ ){{1,3}}?{_STREET}(?![A-Za-z])(?:, (?:apt\.?|apartment|flat|unit|suite|room|no\.|#) ?[0-9]{{1,4}}[a-z]?)?(?:, (?!second\b|third\b|first\b|next\b|please\b|and\b|or\b|the\b|if\b|but\b){_TOWN})?(?:,? (?-i:[A-Z]{{2}}) [0-9]{{5}}(?:-[0-9]{{4}})?|,? (?-i:[A-Z]{{1,2}}[0-9][A-Z0-9]? ?[0-9][A-Z]{{2}}))?", re.I)
_ADDRESS_DE = re.compile(r"(?<![\w])(?:(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|Beim|Unter den|Alte|Neue|Alter|Neuer)\s[A-ZÄÖÜ][a-zäöüß-]+(?:\s[A-ZÄÖÜ][a-zäöüß-]+)?|[A-ZÄÖÜ][a-zäöüß-]+(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig|steg|chaussee|pfad)|[A-ZÄÖÜ][a-zäöüß-]+\s(?:Straße|Strasse|Weg|Gasse|Allee|Platz|Ring|Damm))\s[0-9]{1,4}\s?[a-z]?(?![a-z])(?:,?\s(?:D-)?[0-9]{5}\s[A-ZÄÖÜ][a-zäöüß-]+(?:\s(?:am|an der|bei)\s[A-ZÄÖÜ][a-zäöüß-]+)?)?")
_ADDRESS_ROMANCE = re.compile(r"(?<![\w])(?:[0-9]{1,4}(?:\s?(?:bis|ter))?,?\s(?:rue|avenue|boulevard|chemin|impasse|allée|quai|place)\s(?:de\s|du\s|des\s|de la\s|d'|l')?[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+){0,3}|(?:[Cc]alle|[Aa]venida|[Aa]vda\.|[Pp]laza|[Pp]aseo|[Cc]amino)\s(?:de\s|del\s|de la\s|de los\s)?[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+){0,2},?\s(?:n\.?º\s?)?[0-9]{1,4})(?:,?\s[0-9]{5}\s[A-ZÀ-Þ][\w'’-]+(?:[\s-][A-ZÀ-Þ][\w'’-]+){0,2})?")


# Names that a text itself introduces as such, whoever's they are.
_TWO = r"(?:[A-Z][a-z]{2,}\s){1,2}[A-Z][a-z]{2,}(?!\w)"
_INTRODUCED = re.compile(rf"(?<=\bmy name is\s){_TWO}|(?<=\bspoke with\s){_TWO}|(?<=\bspoke to\s){_TWO}|(?<=\btalked to\s){_TWO}|(?<=\btalked with\s){_TWO}|(?<![一-鿿])[一-鿿]{{2,3}}[ 　]?[一-鿿ぁ-ん]{{1,3}}?(?=と申します|という者です)|(?<=名前は)[一-鿿]{{2,3}}[ 　]?[一-鿿]{{1,3}}(?=です)")


@dataclass
class Names:
    """The parts of known names, by script."""

    family: set[str] = field(default_factory=set)
    given: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self._index: tuple | None = None
        self._all: set[str] | None = None
        self._made: dict[frozenset[str], list[re.Pattern]] = {}

    def _indexed(self) -> tuple[dict[str, set[str]], dict[str, list[int]]]:
        """First words of Latin parts to the parts, and first signs of the others to the lengths to look for."""
        if self._index is None:
            words: dict[str, set[str]] = {}
            lengths: dict[str, set[int]] = {}
            for part in self.family | self.given:
                for word in re.findall(rf"[{_LATIN}]+", part.lower())[:1]:
                    words.setdefault(word, set()).add(part)
                if not part[0].isascii():
                    lengths.setdefault(part[0], set()).add(len(part))
            self._index = words, {ch: sorted(n) for ch, n in lengths.items()}
        return self._index

    def within(self, text: str) -> frozenset[str]:
        """The parts that may stand in ``text``: a superset of those that do."""
        words, lengths = self._indexed()
        found: set[str] = set()
        if words:
            for word in set(re.findall(rf"[{_LATIN}]+", text.lower())):
                found |= words.get(word, set())
        if lengths:
            parts = self.family | self.given if self._all is None else self._all
            self._all = parts
            for i, ch in enumerate(text):
                for n in lengths.get(ch, ()):
                    if text[i : i + n] in parts:
                        found.add(text[i : i + n])
        return frozenset(found)

    def patterns_for(self, text: str) -> list[re.Pattern]:
        """:meth:`patterns` of the parts that may stand in ``text``; what it finds there is the same."""
        held = self.within(text)
        if held not in self._made:
            if len(self._made) >= 4096:
                self._made.clear()
            self._made[held] = Names(self.family & held, self.given & held).patterns()
        return self._made[held]

    def patterns(self) -> list[re.Pattern]:
        out = []
        any_of = lambda xs: "|".join(sorted(map(re.escape, xs), key=lambda x: (-len(x), x)))
        honor = r"(?:さん|様|氏|くん|君|先生|部長|課長|社長|殿|ちゃん)(?!付け|役|子|式)"
        for cls, guard in ((r"[ァ-ヺー・ヽヾ]", r"ァ-ヺー"), (r"[一-鿿々ヶ]", "")):
            fam, giv = ({x for x in xs if re.fullmatch(cls + "+", x)} for xs in (self.family, self.given))
            if not fam and not giv:
                continue
            before = f"(?<![{guard}])" if guard else r"(?<!コーポ)(?<!メゾン)(?<!ハイツ)(?<!ビル)(?<!市)(?<!県)(?<!町)"
            after = f"(?![{guard}])" if guard else r"(?!通(?!知|信|話|り|常|過)|町|市|県|区|坂[0-9０-９]|ビル|丁目|駅)"
            forms = [f"(?:{any_of(fam)})[ 　・]?(?:{any_of(giv)})", f"(?:{any_of(fam)})", f"(?:{any_of(giv)})"] if fam and giv else [f"(?:{any_of(fam or giv)})"]
            out.append(re.compile(f"{before}(?:{'|'.join(forms)}){after}"))
            out.append(re.compile(rf"(?<!{cls})(?:{cls}{{1,8}}[ 　・]{cls}{{1,8}})(?={honor})"))
        fam, giv = ({x for x in xs if re.fullmatch(r"[^\W\d_][^\W\d_'’.-]*(?:[ '’-][^\W\d_]+)*", x) and not re.search("[぀-鿿]", x)} for xs in (self.family, self.given))
        if fam or giv:
            f, g = any_of(fam) or "(?!)", any_of(giv) or "(?!)"
            out.append(re.compile(rf"(?<![{_LATIN}@.+/-])(?:(?:{g})\s(?:[A-Z]\.\s)?(?:{f})|(?:{f}),?\s(?:{g})|(?:[A-Z]\.\s){{1,2}}(?:{f})|(?:{f})|(?:{g}))(?![{_LATIN}@]|[-+][{_LATIN}]|\.[{_LATIN}])", re.I))
        out.append(_INTRODUCED)
        out.append(re.compile(r"(?<=\b(?:Mr|Ms|Dr)\.\s)(?:[A-Z][a-z]{2,}\s){1,2}[A-Z][a-z]{2,}(?!\w)|(?<=\bMrs\.\s)(?:[A-Z][a-z]{2,}\s){1,2}[A-Z][a-z]{2,}(?!\w)|(?<=\bProf\.\s)(?:[A-Z][a-z]{2,}\s){1,2}[A-Z][a-z]{2,}(?!\w)"))
        return out


def roster_parts(roster: DataFrame) -> DataFrame:
    """``part``, ``family`` (true or false): the distinct name parts of a list of people (``family_name``,
    ``given_name``, ``reading`` of both); null and blank ones are left out."""
    reading = F.split(F.trim(F.coalesce("reading", F.lit(""))), r"\s+")
    read = F.when(F.size(reading) == 2, reading)
    both = [(F.col("family_name"), True), (F.col("given_name"), False), (read[0], True), (read[1], False)]
    rows = roster.select(F.explode(F.array(*[F.struct(c.alias("part"), F.lit(f).alias("family")) for c, f in both])).alias("p")).select("p.*")
    plain = F.pandas_udf(lambda parts: parts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip()), "string")
    return rows.filter("part IS NOT NULL").select(plain("part").alias("part"), "family").filter("part <> ''").distinct()


def name_parts(roster: DataFrame) -> Names:
    """The parts of a list of people on the driver; for lists of a checked size."""
    rows = roster_parts(roster).collect()
    return Names({r.part for r in rows if r.family}, {r.part for r in rows if not r.family})


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text.translate(_FOLD).translate(_KANJI))


def is_phone(digits: str, plus: bool, grouped: bool, spoken_of: bool) -> bool:
    """Whether a digit string is a phone number in one of the numbering plans known here."""
    n = len(digits)
    if spoken_of and grouped and (n == 11 and digits[0] == "1" and digits[1] in "3456789" or n == 9 and digits[0] in "6789"):
        return True  # mobile numbers without a prefix
    if plus or digits.startswith("00") and grouped and digits[2:3] != "0":
        return 9 <= n <= 15
    if digits[:1] == "0":
        if n == 11 and digits[1] in "5789" and digits[2] == "0":
            return True
        if n == 10 and digits[1] != "0" and not (digits[1] in "5789" and digits[2] == "0"):
            return True
        return grouped and 10 <= n <= 12 and digits[1] != "0" and (spoken_of or digits.startswith("01632"))
    if n == 10:
        return digits[0] in "23456789" and digits[3] in "23456789" and digits[1:3] != "11"
    return n == 11 and digits[0] == "1" and grouped and digits[1] in "23456789" and digits[4] in "23456789"


def _lead(text: str, at: int) -> int:
    """How much of the start of a match is the end of a lead-in word that runs into it."""
    for word in _LEADS_JA:
        for k in range(len(word)):
            tail = word[k:]
            if text.startswith(tail, at) and text[max(0, at - k) : at] == word[:k] and re.match(r"[一-鿿][一-鿿の]*[市県都府道区]", text[at + len(tail) : at + len(tail) + 8]):
                return len(tail)
    return 0


# What a text must hold for patterns to be worth trying: signs that each of their matches has.
_HAS_DIGIT, _HAS_KANJI_DIGIT, _HAS_PLACE, _HAS_SPOKEN = re.compile(r"\d"), re.compile(f"[{_K}]"), re.compile("[都道府県市区郡町村]"), re.compile("|".join(_SPOKEN))
_YMD = r"(?P<y>(?:19|20)\d\d)(?:(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})|年\s?(?P<mj>\d{1,2})月\s?(?P<dj>\d{1,2})日?)"
_DMY = r"(?P<d2>\d{1,2})(?P<s2>[-/.])(?P<m2>\d{1,2})(?P=s2)(?P<y2>(?:19|20)\d\d)"
_DATE = re.compile(rf"(?<!\d)(?:{_YMD}|{_DMY})(?!\d)")
_BIRTH = re.compile(rf"(?:{BIRTH_WORDS})\D{{0,12}}?(?P<after>{_DATE.pattern})|(?P<before>{re.sub('P<', 'P<b', re.sub('P=', 'P=b', _DATE.pattern))})(?=\s?生まれ)", re.I)


def find_mentions(text: str, names: Names | list[re.Pattern], *, dates: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, type) of the mentions in ``text``, in order and apart. ``dates``: dates of birth are mentions too."""
    folded = text.translate(_FOLD)
    patterns = names.patterns_for(folded) if isinstance(names, Names) else names
    taken = bytearray(len(text))
    out: list[tuple[int, int, str]] = []

    def take(a: int, b: int, kind: str) -> None:
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a and not any(taken[a:b]):
            taken[a:b] = b"\x01" * (b - a)
            out.append((a, b, kind))

    low = folded.lower()
    if "@" in folded or "at" in low or "アット" in folded:
        for m in _EMAIL.finditer(folded):
            take(*m.span(), "email")
    has_digit = _HAS_DIGIT.search(folded) is not None
    if dates and has_digit:
        for m in _BIRTH.finditer(folded):
            take(*m.span("after" if m.group("after") else "before"), "date")
    if has_digit or _HAS_KANJI_DIGIT.search(text):
        for m in _ID.finditer(folded):
            take(*m.span(1), "id_number")
        if _HAS_PLACE.search(text):
            for m in _ADDRESS_JA.finditer(folded):
                a, b = m.span()
                take(a + _lead(folded, a), b, "address")
        if has_digit:
            for pattern in (_ADDRESS_EN, _ADDRESS_DE, _ADDRESS_ROMANCE):
                for m in pattern.finditer(folded):
                    take(*m.span(), "address")
            for m in _NUMBER.finditer(folded):
                a, b = m.span()
                if folded[b - 1] == ")" and "(" not in folded[a:b]:
                    b -= 1
                piece, before = folded[a:b], folded[max(0, a - 32) : a]
                d = _digits(piece)
                if is_phone(d, piece[0] == "+", len(piece) > len(d), bool(PHONE_WORDS.search(before))) and not NO_PHONE.search(before):
                    take(a, b, "phone")
        for m in _KANJI_PHONE.finditer(text):
            if is_phone(_digits(m.group()), False, True, False):
                take(*m.span(), "phone")
    if _HAS_SPOKEN.search(low):
        for m in _SPOKEN_PHONE.finditer(folded):
            take(*m.span(), "phone")
    for pattern in patterns:
        for m in pattern.finditer(folded):
            a, b = m.span()
            if folded.startswith("M. ", a) and _FRENCH.search(folded[max(0, a - 25) : a] + folded[b : b + 25]):
                a += 3  # a title there, an initial elsewhere
            take(a, b, "name")
    return sorted(out)


class Feistel:
    """A keyed permutation of digit strings of each length (alternating Feistel, addition modulo a power of ten)."""

    def __init__(self, key: bytes, rounds: int = 10) -> None:
        self.key, self.rounds = key, rounds

    def _round(self, i: int, n: int, half: str, width: int, tweak: str) -> int:
        mac = hmac.new(self.key, f"{i}|{n}|{tweak}|{half}".encode(), hashlib.sha256).digest()
        return int.from_bytes(mac[:16], "big") % 10**width

    def permute(self, digits: str, tweak: str = "", inverse: bool = False) -> str:
        n = len(digits)
        if n < 2:
            return digits
        u = n // 2
        a, b = digits[:u], digits[u:]
        for i in reversed(range(self.rounds)) if inverse else range(self.rounds):
            width = u if i % 2 == 0 else n - u
            if inverse:
                a, b = f"{(int(b) - self._round(i, n, a, width, tweak)) % 10**width:0{width}d}", a
            else:
                a, b = b, f"{(int(a) + self._round(i, n, b, width, tweak)) % 10**width:0{width}d}"
        return a + b


def home_code(text: str) -> str:
    """The country whose numbers stand without a country code in such a text, by its script."""
    for signs, code in (("[\u3040-\u30ff]", "81"), ("[\uac00-\ud7a3]", "82"), ("[\u4e00-\u9fff]", "86")):
        if re.search(signs, text):
            return code
    return "44"


def phone_parts(value: str, home: str = "81") -> tuple[str, str]:
    """Country code and national number, without the prefix for calls within the country. ``home``: the country of
    numbers that name none, but for those that only one numbering plan has."""
    plain = unicodedata.normalize("NFKC", value).translate(_KANJI)
    if re.search("[A-Za-z]{3}", plain):
        plain = "".join("+" if w == "plus" else _SPOKEN_DIGIT.get(w, "") for w in re.findall(r"[a-z]+", plain.lower()))
    plain = plain.strip().replace("(0)", "")
    d = re.sub(r"\D", "", plain)
    if plain.startswith("+") or d.startswith("00"):
        d = d.removeprefix("00")
        code = next((d[:n] for n in (1, 2) if d[:n] in SHORT_CODES), d[:3])
        return code, d[len(code) :]
    if d[:1] == "0":
        return home, d[1:]
    if len(d) == 11 and d[0] == "1" and d[1] in "23456789" and d[4] in "23456789":
        return "1", d[1:]
    if len(d) == 11 and d[0] == "1":
        return "86", d
    return {10: "1", 9: "34"}.get(len(d), home), d


def canonical(value: str, kind: str, home: str = "81") -> str:
    """What two ways of writing one value have in common."""
    plain = unicodedata.normalize("NFKC", value)
    if kind == "phone":
        return "+" + " ".join(phone_parts(value, home))
    if kind == "id_number":
        return re.sub(r"[^A-Z0-9]", "", plain.translate(_KANJI).upper())
    if kind == "date":
        return _date_of(plain)[0].isoformat() if _date_of(plain) else plain
    if kind == "email":
        plain = re.sub(r"\s*(?:\(at\)|\[at\]|\{at\}|アットマーク|アット|@|\bat\b)\s*", "@", plain, flags=re.I)
        plain = re.sub(r"\s*(?:\[dot\]|\(dot\)|\{dot\}|ドット|\bdot\b)\s*", ".", plain, flags=re.I)
    return re.sub(r"[\s・]+", "", plain).casefold()


FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def permute_date(day: date, cipher: Feistel, tweak: str = "date") -> date:
    """A keyed permutation of the days of two centuries; days outside stay. The digits are permuted until they are such
    a day again, which keeps it a permutation."""
    at = day.toordinal() - FIRST_DAY
    if not 0 <= at <= LAST_DAY - FIRST_DAY:
        return day
    while True:
        at = int(cipher.permute(f"{at:05d}", tweak))
        if at <= LAST_DAY - FIRST_DAY:
            return date.fromordinal(FIRST_DAY + at)


def _date_of(plain: str) -> tuple[date, re.Match] | None:
    if not (m := _DATE.search(plain)):
        return None
    g = m.groupdict()
    y, mo, d = (g["y"], g["m"] or g["mj"], g["d"] or g["dj"]) if g["y"] else (g["y2"], g["m2"], g["d2"])
    try:
        return date(int(y), int(mo), int(d)), m
    except ValueError:
        return None


def _new_date(value: str, cipher: Feistel) -> str:
    plain = value.translate(_FOLD)
    if not (found := _date_of(plain)):
        return "".join(cipher.permute(x, "no date") if x.isdigit() else x for x in re.split(r"(\d+)", plain))
    day, m = found
    new = permute_date(day, cipher)
    out, last = [], 0
    for name, number in sorted(((n, {"y": new.year, "m": new.month, "d": new.day}[n[0]]) for n in ("y", "m", "d", "mj", "dj", "y2", "m2", "d2") if m.group(n)), key=lambda x: m.start(x[0])):
        wide = 4 if name[0] == "y" else 2 if m.group(name).startswith("0") or len(m.group(name)) == 2 else 1
        out += [plain[last : m.start(name)], f"{number:0{wide}d}"]
        last = m.end(name)
    return "".join([*out, plain[last:]])


def _my_number(d: str) -> str:
    rest = sum(int(x) * (n + 1 if n <= 6 else n - 5) for n, x in enumerate(reversed(d), 1)) % 11
    return "0" if rest <= 1 else str(11 - rest)


def _iso_11_10(d: str) -> str:
    p = 10
    for x in d:
        s = (int(x) + p) % 10 or 10
        p = 2 * s % 11
    return str((11 - p) % 10)


def _mod_11_2(d: str) -> str:
    rest = sum(int(x) * pow(2, len(d) - i, 11) for i, x in enumerate(d)) % 11
    return "10X98765432"[rest]


# Identity numbers that end in a check: the form, how long the check is, and the check of what comes before it.
CHECKS: list[tuple[re.Pattern, int, Callable[[str], str]]] = [
    (re.compile(r"\d{12}"), 1, _my_number),
    (re.compile(r"[1-9]\d{10}"), 1, _iso_11_10),
    (re.compile(r"\d{8}[A-Z]"), 1, lambda d: "TRWAGMYFPDXBNJZSQVHLCKE"[int(d) % 23]),
    (re.compile(r"\d{17}[\dX]"), 1, _mod_11_2),
    (re.compile(r"[12]\d{14}"), 2, lambda d: f"{97 - int(d) % 97:02d}"),
]


def _day(digits: str) -> date | None:
    try:
        return date(int(digits[:4]), int(digits[4:6]), int(digits[6:]))
    except ValueError:
        return None


def check_of(number: str) -> tuple[int, Callable[[str], str]] | None:
    """(length, rule) of the check that a compact identity number ends in and that holds; null if there is none."""
    for form, n, rule in CHECKS:
        if form.fullmatch(number) and rule(number[:-n]) == number[-n:] and (rule is not _mod_11_2 or _day(number[6:14])):
            return n, rule
    return None


def _new_number(number: str, cipher: Feistel) -> str:
    """A compact identity number in the same format: letters stay, digits are permuted. If its check holds, so does the
    pseudonym's; if not, the pseudonym's doesn't either."""

    def permuted(text: str) -> str:
        digits, letters = re.sub(r"\D", "", text), re.sub(r"\d", "", text)
        new = iter(cipher.permute(digits, f"id|{len(text)}|{letters}"))
        return "".join(next(new) if ch.isdigit() else ch for ch in text)

    check = check_of(number)
    if check is None:
        while check_of(number := permuted(number)) is not None:
            pass
        return number
    n, rule = check
    body, form = number[:-n], next(f for f, k, r in CHECKS if r is rule)
    while True:
        if rule is _mod_11_2:  # the date of birth within stays a date
            rest = permuted(body[:6] + body[14:])
            body = rest[:6] + permute_date(_day(body[6:14]), cipher).strftime("%Y%m%d") + rest[6:]
        else:
            body = permuted(body)
        if form.fullmatch(body + rule(body)):
            return body + rule(body)


def pseudonym(value: str, kind: str, cipher: Feistel, home: str = "81") -> str:
    """A value of the same format for numbers and dates, a keyed token for the rest."""
    if kind == "date":
        return _new_date(value, cipher)
    if kind not in ("phone", "id_number"):
        return hmac.new(cipher.key, f"{kind}|{canonical(value, kind)}".encode(), hashlib.sha256).hexdigest()[:16]
    plain = unicodedata.normalize("NFKC", value).translate(_KANJI)
    if kind == "id_number":
        new = iter(_new_number(canonical(value, kind), cipher))
        return "".join(next(new) if re.match("[A-Za-z0-9]", ch) else ch for ch in plain)
    code, national = phone_parts(value, home)
    keep = min(1, max(0, len(national) - 2))
    national = national[:keep] + cipher.permute(national[keep:], f"phone|{code}|{national[:keep]}|{len(national)}")
    own = re.sub(r"\D", "", plain)
    if len(own) < len(national):
        return f"+{code} {national}"
    it = iter(own[: len(own) - len(national)] + national)
    return "".join(next(it) if ch.isdigit() else ch for ch in plain)


def redact(text: str, mentions: list[tuple[int, int, str]], cipher: Feistel) -> str:
    """``text`` with ``[TYPE:pseudonym]`` in place of each mention."""
    out, last, home = [], 0, home_code(text)
    for a, b, kind in mentions:
        out += [text[last:a], f"[{kind.upper()}:{pseudonym(text[a:b], kind, cipher, home)}]"]
        last = b
    return "".join([*out, text[last:]])


def _present_parts(rows: DataFrame, keys: list[str], parts: DataFrame) -> DataFrame:
    """``rows`` with ``__parts``: of a list of names too long for every task, those that may stand in the text. Candidates
    (words, and stretches of kana and Chinese characters) are joined with the list."""
    longest = parts.agg(F.max(F.length("part"))).first()[0] or 1
    other = re.compile("[^\x00-\u02ff]+")

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, t in zip(batch["__row"], batch["__text"], strict=True):
                folded = t.translate(_FOLD)
                found = set(re.findall(rf"[{_LATIN}]+", folded.lower()))
                for m in other.finditer(folded):
                    run = m.group()
                    found.update(run[i : i + n] for i in range(len(run)) for n in range(1, min(longest, len(run) - i) + 1))
                out.extend((row, c) for c in found)
            yield pd.DataFrame(out, columns=["__row", "word"])

    latin = F.regexp_extract(F.lower("part"), rf"[{_LATIN}]+", 0)
    index = parts.withColumn("word", F.when(F.ascii("part") < 128, latin).otherwise(F.col("part")))
    marked = rows.withColumn("__row", F.xxhash64(*keys, "__text"))
    texts = marked.select("__row", "__text").distinct()
    met = texts.mapInPandas(candidates, "__row long, word string").join(index, "word").groupBy("__row").agg(F.collect_set(F.struct("part", "family")).alias("__parts"))
    return marked.join(met, "__row", "left").drop("__row")


def personal_information(df: DataFrame, keys: list[str], text: str, names: Names | DataFrame, *, key: bytes, dates: bool = False, most_sent: int = 50_000) -> DataFrame:
    """Rows of ``df`` that mention personal information: the keys, ``redacted`` and ``mentions``, an array of
    (``pii_type``, ``start_char``, ``end_char``, ``pseudonym``) in order.

    Positions count code points, the end is exclusive. Null and empty texts, texts without a mention and rows with a null
    key give no row; repeated rows stay repeated. ``names``: the people known, as name parts or as a table
    (``family_name``, ``given_name``, ``reading``). A table of at most ``most_sent`` distinct parts is sent to all tasks;
    of a longer one each text is joined with the parts that occur in it. ``key``: the secret that pseudonyms depend on;
    who has it can undo them. ``dates``: dates of birth are mentions too (``pii_type`` 'date').
    """
    rows = df.filter(F.length(text) > 0).select(*keys, F.col(text).alias("__text")).dropna(subset=keys)
    known, joined = names, False
    if isinstance(names, DataFrame):
        parts = roster_parts(names)
        joined = parts.limit(most_sent + 1).count() > most_sent
        known = Names() if joined else name_parts(names)
        rows = _present_parts(rows, keys, parts) if joined else rows

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cipher = Feistel(key)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                k, t, mine = row[: len(keys)], row[len(keys)], known
                if joined and row[-1] is not None:
                    mine = Names({p["part"] for p in row[-1] if p["family"]}, {p["part"] for p in row[-1] if not p["family"]})
                if found := find_mentions(t, mine, dates=dates):
                    home = home_code(t)
                    out.append((*k, redact(t, found, cipher), [{"pii_type": p, "start_char": a, "end_char": b, "pseudonym": pseudonym(t[a:b], p, cipher, home)} for a, b, p in found]))
            yield pd.DataFrame(out, columns=[*keys, "redacted", "mentions"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, redacted string, mentions array<struct<pii_type: string, start_char: int, end_char: int, pseudonym: string>>"
    return rows.mapInPandas(scan, schema)
