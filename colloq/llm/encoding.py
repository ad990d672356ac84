"""Text read with a wrong character encoding: finding it and undoing it.

Records (lines and the parts of them that ASCII marks set apart) are joined with near-twins on what is left of them
once the non-ASCII characters are stripped, together with the pattern in which their non-ASCII bytes recur: a wrong
reading changes the characters but neither the ASCII text nor the pattern, so twins meet whatever the reading was, and
others hardly do. Twins are aligned character by character; the bytes of the clean one lie against the characters of the
garbled one, which gives the transformation. Where the reading takes bytes of neighbouring characters together there is
no such pattern; there the garbled record is undone under each pair of encodings and joined with the clean record that
it becomes. Transformations with enough witnesses are undone in all texts, wherever that gives more plausible characters
(how many documents a character occurs in, over the whole corpus) or words of one script and case.

Escape-coded Japanese (ISO-2022-JP read as ASCII, often with the escape signs lost) has no non-ASCII character to compare;
its stretches are found by their form and decoded where what comes out is plausible.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloq.session import checkpoint

# Encodings that a text may wrongly be read as, and those it may have been written in.
SINGLE_BYTE = ("latin-1", "cp1252", "mac_roman", "cp437", "cp1250", "cp1251", "cp1254", "cp850", "koi8_r", "iso8859_15")
MULTI_BYTE = ("cp932", "gbk", "big5", "cp949", "euc_jp")

# Code units of a multi-byte character, on bytes seen as latin-1 text.
_UNITS = {
    "utf-8": re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}"),
    "cp932": re.compile("[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]"),
    "euc_jp": re.compile("[\xa1-\xf4][\xa1-\xfe]|\x8e[\xa1-\xdf]"),
    "gbk": re.compile("[\x81-\xfe][\x40-\x7e\x80-\xfe]"),
    "cp949": re.compile("[\x81-\xfe][\x41-\x5a\x61-\x7a\x81-\xfe]"),
    "big5": re.compile("[\xa1-\xf9][\x40-\x7e\xa1-\xfe]"),
}
_LOSS = re.compile("[\x80-\x84\x86-\x9f�]")  # what no writer types: C1 controls and the replacement character
_HALF = re.compile("[\uff61-\uff9f]")

# Two-byte Japanese between its escape sequences, with or without the escape signs; a text may be cut within.
ESCAPED = "iso2022_jp>ascii"
ESCAPE_OPENS = r"\$[@B]"
_ESCAPED = re.compile(rf"\x1b?{ESCAPE_OPENS}((?:[\x21-\x7e]{{2}})+?)(?:(\x1b?\([BJ])|(?=\x1b?{ESCAPE_OPENS}|[\x21-\x7e]?$))", re.M)


@lru_cache(maxsize=None)
def _table(codec: str) -> dict[str, int]:
    """Characters of a single-byte encoding to their bytes; undefined bytes stand for themselves."""
    table = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)
        table.setdefault(ch, b)
    return table


@lru_cache(maxsize=None)
def _reading(codec: str) -> str:
    """The 256 characters that a single-byte encoding's bytes are read as."""
    back = {b: ch for ch, b in _table(codec).items()}
    return "".join(back.get(b, chr(b)) for b in range(256))


def garble(text: str, written: str, read: str) -> str | None:
    """``text`` written in one encoding and read as another; null where it can't be written so."""
    try:
        data = text.encode(written)
    except UnicodeEncodeError:
        return None
    if read in SINGLE_BYTE:
        return data.decode("latin-1").translate(_reading_map(read))
    return data.decode(read, errors="replace")


@lru_cache(maxsize=None)
def _reading_map(codec: str) -> dict[int, str]:
    return dict(enumerate(_reading(codec)))


@lru_cache(maxsize=None)
def _byte_map(codec: str) -> dict[int, int]:
    """Characters to their bytes; what is a byte by its number but no character of the encoding becomes none."""
    return {o: 0xFFFF for o in range(0x80, 0x100)} | {ord(ch): b for ch, b in _table(codec).items()}


@lru_cache(maxsize=100_000)
def _bytes_of(ch: str, codec: str) -> bytes | None:
    try:
        return ch.encode(codec)
    except UnicodeEncodeError:
        return None


class Plausibility:
    """Log share of the documents that contain a character; ASCII is neutral."""

    def __init__(self, counts: dict[str, int], documents: int) -> None:
        self.documents = max(documents, 1)
        self.floor = math.log(0.5 / self.documents)
        self.log = {ch: math.log((n + 0.5) / self.documents) for ch, n in counts.items()}

    def __call__(self, text: str) -> float:
        """Mean over the non-ASCII characters; 0 without any."""
        seen = [self.log.get(ch, self.floor) for ch in text if ch > "\x7f"]
        return sum(seen) / len(seen) if seen else 0.0

    def cost(self, text: str) -> float:
        """What the non-ASCII characters together cost; a text restored has fewer and likelier ones."""
        return -sum(self.log.get(ch, self.floor) for ch in text if ch > "\x7f")


def escaped_stretches(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """Stretches (start, end, decoded, certain) that can be read as escape-coded Japanese. Certain are those with an
    escape sign, and those in which at least half of three or more characters are kana or marks, whose first byte is
    one of ``!$%``; that does not come about by chance."""
    pos = 0
    while m := _ESCAPED.search(text, pos):
        pos = m.start() + 1
        body = m.group(1)
        try:
            decoded = b"".join((b"\x1b$B", body.encode("ascii"), b"\x1b(B")).decode("iso2022_jp")
        except UnicodeDecodeError:
            continue
        certain = m.group().startswith("\x1b") or len(decoded) >= 3 and 2 * sum(ch in "!$%" for ch in body[::2]) >= len(decoded)
        if certain or m.group(2) is not None or len(decoded) >= 3:
            pos = m.end()
            yield m.start(), m.end(), decoded, certain


def unescape(text: str, plausible: Plausibility) -> str | None:
    """``text`` with its escape-coded Japanese decoded; null if there is none. Stretches not certain by their form
    must be nearer to what all documents hold than to what none does."""
    out, last = [], 0
    for start, end, decoded, certain in escaped_stretches(text):
        if certain or plausible(decoded) > plausible.floor / 2:
            out.extend((text[last:start], decoded))
            last = end
    return "".join([*out, text[last:]]) if out else None


def _spans(text: str, written: str, read: str) -> Iterator[tuple[int, int, str, int]]:
    """Stretches (start, end, restored, units) of ``text`` that come from a text written so and read so."""
    units = _UNITS[written]
    if read in SINGLE_BYTE:
        yield from _decoded(text.translate(_byte_map(read)), lambda i: i, units, written, None, written in ("cp932", "gbk", "cp949", "big5"))
    else:
        for run in re.finditer(r"[^\x00-\x7f�][^\n�]*", text):
            data, at, starts = [], [], set()
            base = run.start()
            for k, ch in enumerate(run.group()):
                b = _bytes_of(ch, read)
                if b is None:
                    b = b"\x00"
                starts.add(len(at))
                data.append(b.decode("latin-1"))
                at.extend([base + k] * len(b))
            at.append(run.end())
            yield from _decoded("".join(data), at.__getitem__, units, written, starts, True)


def _decoded(data: str, place: Callable[[int], int], units: re.Pattern, written: str, starts: set[int] | None, far: bool) -> Iterator[tuple[int, int, str, int]]:
    """Chains of multi-byte characters in ``data``, adjacent or, if ``far`` (for encodings with ASCII trail bytes), with
    ASCII between. ``starts``: where a chain may begin; anywhere, if null."""
    try:
        found = list(_chains(data, units, written, starts, far))
    except UnicodeDecodeError:  # something in the pattern of a character is none: one by one
        found = _by_units(data, units, written, starts, far)
    for start, end, text, n in found:
        yield place(start), _end(place, end), text, n


def _chains(data: str, units: re.Pattern, written: str, starts: set[int] | None, far: bool) -> Iterator[tuple[int, int, str, int]]:
    """As :func:`_by_units`, decoding adjacent characters together."""
    many, start, end, pos, n = _runs(units), 0, 0, 0, 0
    out: list[str] = []
    while m := many.search(data, pos):
        between = data[end : m.start()]
        joins = bool(out) and (between == "" or far and between.isascii() and between.isprintable() and len(between) <= 40)
        if not joins and starts is not None and m.start() not in starts:
            pos = m.start() + 1
            continue
        text = m.group().encode("latin-1").decode(written)
        if joins:
            out.append(between + text)
        else:
            if out:
                yield start, end, "".join(out), n
            start, out, n = m.start(), [text], 0
        pos = end = m.end()
        n += len(text)
    if out:
        yield start, end, "".join(out), n


@lru_cache(maxsize=None)
def _runs(units: re.Pattern) -> re.Pattern:
    return re.compile(f"(?:{units.pattern})+")


def _by_units(data: str, units: re.Pattern, written: str, starts: set[int] | None, far: bool) -> Iterator[tuple[int, int, str, int]]:
    """Chains (start, end, decoded, characters) of adjacent characters, those that are none left out."""
    start = end = pos = 0
    out: list[str] = []
    n = 0
    while m := units.search(data, pos):
        between = data[end : m.start()]
        joins = bool(out) and (between == "" or far and between.isascii() and between.isprintable() and len(between) <= 40)
        if not joins and starts is not None and m.start() not in starts:
            pos = m.start() + 1
            continue
        try:
            ch = m.group().encode("latin-1").decode(written)
        except UnicodeDecodeError:
            pos = m.start() + 1
            continue
        if joins:
            out.append(between + ch)
        else:
            if out:
                yield start, end, "".join(out), n
            start, out, n = m.start(), [ch], 0
        pos = end = m.end()
        n += 1
    if out:
        yield start, end, "".join(out), n


def _end(place: Callable[[int], int], end: int) -> int:
    """The end in the text of a stretch of bytes: a character cut in two belongs to it."""
    return place(end - 1) + 1


@lru_cache(maxsize=100_000)
def _class(ch: str) -> str:
    """What a character may stand next to in a word: its script, and its case where it has one."""
    if ch.isspace():
        return " "
    kind = unicodedata.category(ch)
    if kind[0] == "L" or kind == "Mn":
        script = "a" if ch < "\x80" else {"LATIN": "a"}.get(unicodedata.name(ch, "?").split(" ")[0], unicodedata.name(ch, "?").split(" ")[0][:4])
        return script + ("U" if ch.isupper() else "l")
    return "s" if kind[0] == "S" or kind in ("Cc", "Co", "Cn") else "p"


def _breaks(text: str) -> int:
    """Places inside words where script or case change in a way that words don't."""
    out, before = 0, " "
    for ch in text:
        now = _class(ch)
        if before not in " p" and now not in " p" and before != now and not (before.endswith("U") and now.endswith("l") and before[:-1] == now[:-1]):
            out += 1
        before = now
    return out


@lru_cache(maxsize=100_000)
def _unassigned(ch: str) -> bool:
    return unicodedata.category(ch) in ("Cn", "Co")


def _mends_words(text: str, start: int, end: int, restored: str) -> bool:
    """Whether the words around a stretch are sounder with what it is restored to, and that is all letters."""
    before, after = text[max(0, start - 2) : start], text[end : end + 2]
    return all(_class(ch)[-1] in "Ul" for ch in restored) and _breaks(before + restored + after) < _breaks(before + text[start:end] + after)


def _undo(text: str, written: str, read: str, plausible: Plausibility, least_gain: float | None) -> str | None:
    """``text`` with the stretches of one rule restored: those that become at least ``least_gain`` more plausible or
    mend the words they stand in, or, with null, all; null if there are none."""
    out, last = [], 0
    for start, end, restored, units in _spans(text, written, read):
        if start < last or not _believable(text, start, end, units, written, read) or any(map(_unassigned, restored)):
            continue
        if least_gain is not None:
            gain = plausible(restored) - plausible(text[start:end]) if not restored.isascii() else least_gain
            # Three and four bytes in the pattern of UTF-8 don't come together by chance, several times less so.
            wide = sum(ch >= "\u0800" for ch in restored) if written == "utf-8" and read in SINGLE_BYTE else 0
            # Where many texts are garbled alike, counts say little.
            if gain < least_gain / max(1, wide) and not (written == "utf-8" and read in SINGLE_BYTE and plausible(restored) > plausible.floor / 2 and _mends_words(text, start, end, restored)):
                continue
        out.extend((text[last:start], restored))
        last = end
    return "".join([*out, text[last:]]) if out else None


def _leads(written: str, read: str, plausible: Plausibility) -> tuple[list[str], str]:
    """The characters of the corpus that a stretch under a rule can begin with, and the pattern it begins in. Both
    follow from the bytes alone: how often a character occurs says nothing here, as many texts may be damaged alike."""
    corpus = sorted(ch for ch in plausible.log if ch != "\ufffd")
    cls = lambda chars: "[" + "".join(map(re.escape, chars)) + "]" if chars else "(?!)"
    if read in SINGLE_BYTE:
        back = _reading(read)
        if written == "utf-8":
            first = list(back[0xC2:0xF5])
            return first, cls(first) + cls(back[0x80:0xC0])
        first = list(back[0x81:0xA0] + back[0xA1:0xFD])
        trail = cls(back[0x40:0x7F] + back[0x80:0xFD])
        return first, f"{cls(first)}{trail}{cls(first)}{trail}"
    if (written, read) == ("euc_jp", "cp932"):
        return [ch for ch in corpus if _HALF.match(ch)], "[\uff61-\uff9f]{2}"
    if written == "utf-8":
        first, single, then = [], [], []
        for ch in corpus:
            b = _bytes_of(ch, read)
            if not b:
                continue
            # The third byte, and with it the next unit's first or an ASCII sign.
            if 0x80 <= b[0] < 0xC0 and (len(b) == 1 or 0xC2 <= b[1] < 0xF5 or 0x40 <= b[1] < 0x7F):
                then.append(ch)
            if len(b) == 1 and 0xC2 <= b[0] < 0xF5 or len(b) > 1 and 0xE0 <= b[0] < 0xF5 and 0x80 <= b[1] < 0xC0:
                first.append(ch)
            elif len(b) == 2 and 0xC2 <= b[0] < 0xE0 and 0x80 <= b[1] < 0xC0:
                single.append(ch)
        return first + single, f"{cls(first)}{cls([*then, '\ufffd'])}|{cls(single)}{{4}}"
    # A character that is just one unit of the written encoding turns into one character, so a stretch of them gains
    # only if one of them does. All others are tried.
    first = []
    for ch in corpus:
        if (b := _bytes_of(ch, read)) is None:
            continue
        if len(b) == 2 and _UNITS[written].fullmatch(b.decode("latin-1")):
            try:
                if plausible.log.get(b.decode(written), plausible.floor) <= plausible.log[ch]:
                    continue
            except UnicodeDecodeError:
                continue
        first.append(ch)
    return first, cls(first)


def hints(rules: list[tuple[str, str]], plausible: Plausibility) -> tuple[str, list[tuple[str, str, str]]]:
    """What a line must hold for any rule to be worth trying, and the rules with what it must hold for each of them;
    lines without it can't change under the rule."""
    every, out = set(), []
    for written, read in rules:
        leads, pattern = _leads(written, read, plausible)
        every.update(leads)
        out.append((written, read, pattern))
    return "[" + "".join(map(re.escape, sorted(every))) + "]" if every else "(?!)", out


def restore(text: str, rules: tuple[str, list[tuple[str, str, str]]], plausible: Plausibility, *, least_gain: float = 0.5) -> tuple[str, list[str]]:
    """``text`` with each line restored by the rules (from :func:`hints`) that leave the fewest implausible
    characters, one or two at a time (a text may have been garbled twice over), as long as that makes it more plausible;
    and the rules used. Escape-coded stretches are decoded first."""
    used = []
    if (plain := unescape(text, plausible)) is not None:
        text, used = plain, [ESCAPED]
    gate = re.compile(rules[0])
    if not gate.search(text):
        return text, used
    compiled = [(w, r, re.compile(p)) for w, r, p in rules[1]]
    first = [rule for rule in compiled if rule[2].search(text)]
    if not first:
        return text, used
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if gate.search(line):
            lines[i], rule = _restore_line(line, first, compiled, plausible, least_gain)
            used.extend(r for r in rule if r not in used)
    return "\n".join(lines), used


def _cost(text: str, plausible: Plausibility) -> float:
    """What the characters of a line cost, and the places where its words change script or case."""
    return plausible.cost(text) + 2.0 * _breaks(text)


def _restore_line(text: str, first: list[tuple[str, str, re.Pattern]], rules: list[tuple[str, str, re.Pattern]], plausible: Plausibility, least_gain: float) -> tuple[str, list[str]]:
    """As :func:`restore`, of a line; ``first`` are the rules that anything of the text it is from can change under."""
    used: list[str] = []
    while True:
        found = []
        for written, read, need in rules if used else first:
            if not need.search(text):
                continue
            once = _undo(text, written, read, plausible, least_gain)
            if once is not None:
                found.append((_cost(once, plausible), once, [f"{written}>{read}"]))
            if read not in SINGLE_BYTE or written != "utf-8" or (inner := _undo(text, written, read, plausible, None)) is None:
                continue
            for w2, r2, need2 in rules:
                if (w2, r2) in ((written, read), (written, "cp1252"), (written, "latin-1")) and need2.search(inner) and (twice := _undo(inner, w2, r2, plausible, least_gain)) is not None:
                    found.append((_cost(twice, plausible), twice, [f"{written}>{read}", f"{w2}>{r2}"]))
        best = min(found, key=lambda x: (x[0], len(x[2]), x[2]), default=None)
        if best is None or best[0] >= _cost(text, plausible) - least_gain / 2:
            break
        text = best[1]
        used.extend(best[2])
    return text, used


def _believable(text: str, start: int, end: int, units: int, written: str, read: str) -> bool:
    """False where sound text could look the same: one unit in a legacy encoding, characters that are each one unit
    of the other encoding, and a few half-width kana inside a longer word of them."""
    if units < 2 and written != "utf-8":
        return False
    if read in SINGLE_BYTE:
        return True
    source = text[start:end]
    if not all(_HALF.match(ch) for ch in source):
        return units < sum(ch > "\x7f" for ch in source) or units > len(source) or units >= 4 or len(source) == 2 and units == 1
    return len(source) > 4 or not (start and _HALF.match(text[start - 1]) or end < len(text) and _HALF.match(text[end]))


# What sets parts of a line apart in a sound and in a garbled text alike; a label or mark at the head of a line.
_APART = re.compile(r"(?<=[.!?,;:])\s+|(?<=[\])])\s*")
_HEAD = re.compile(r"^(?:[\x00-\x7f]*?(?:: |\] |[-*#] )(?=[^\x00-\x7f]|\w))+")


def records(text: str) -> set[str]:
    """What of a text is compared: of its lines, without labels at their head, the parts that ASCII marks set apart, and
    of those each word that holds non-ASCII characters, with its neighbours; digits count alike."""
    out = set()
    for line in text.split("\n"):
        if not line.isascii():
            for part in _APART.split(_HEAD.sub("", re.sub("[0-9]+", "0", line)).strip()):
                if not part.isascii():
                    words = part.strip().split(" ")
                    out.update(" ".join(words[max(0, i - 1) : i + 2]) for i, w in enumerate(words) if not w.isascii())
    return out


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_ASCII = re.compile(r"[\x00-\x7f]+")


def _pattern(data: str) -> int:
    """A hash of the ASCII text of ``data`` and of which of its other characters are the same."""
    seen = dict.fromkeys(_ASCII.sub("", data))
    return _hash("pattern", data.translate({ord(ch): 0x100 + i for i, ch in enumerate(seen)}))


_READABLE = frozenset().union(*(_table(codec) for codec in SINGLE_BYTE))
BOTH_WAYS = ("utf-8", *MULTI_BYTE)  # encodings of which one may be read as another


LOSSY = (("latin-1", "utf-8"), ("cp1252", "utf-8"))
LOSSY_ASIAN = (*((w, "utf-8") for w in MULTI_BYTE), *(("utf-8", r) for r in MULTI_BYTE), ("euc_jp", "cp932"))


def clean_keys(record: str, lossy: bool = True) -> list[tuple[int, str]]:
    """(key, how) under which a record is met as the clean twin: by its pattern under each multi-byte encoding, as it is,
    and, if ``lossy``, as what a lossy reading leaves of it. Encodings of Chinese, Japanese and Korean are tried on
    records with a character of those."""
    out = {_hash("text", record): ""}
    asian = max(record) >= "\u2e80"
    for written in BOTH_WAYS if asian else BOTH_WAYS[:1]:
        if (data := _encoded(record, written)) is not None and len(data) != len(record):
            out.setdefault(_pattern(data), written)
    if lossy:
        for written, read in LOSSY_ASIAN if asian else LOSSY:
            if "\ufffd" in (left := garble(record, written, read) or ""):
                out.setdefault(_hash("lost", left), f"{written}>{read}")
    return list(out.items())


def garbled_keys(record: str) -> list[tuple[int, str]]:
    """(key, how) under which a record is met as the garbled twin. A reading that takes bytes together makes Chinese,
    Japanese or Korean characters of them."""
    if "\ufffd" in record:
        return [(_hash("lost", record), "lost")]
    out = []
    if all(ch < "\x80" or ch in _READABLE for ch in record):
        out.append((_pattern(record), "?"))
    for read in MULTI_BYTE if max(record) >= "\u2e80" else ():
        if (data := _encoded(record, read)) is None:
            continue
        for written in BOTH_WAYS:
            if written != read:
                try:
                    clean = data.encode("latin-1").decode(written)
                except UnicodeDecodeError:
                    continue
                if clean != record and not clean.isascii():
                    out.append((_hash("text", clean), f"{written}>{read}"))
    return out


def _encoded(text: str, codec: str) -> str | None:
    """The bytes of ``text``, each as a character; null if it can't be written so."""
    try:
        return text.encode(codec).decode("latin-1")
    except UnicodeEncodeError:
        return None


def align(clean: str, garbled: str, written: str) -> list[tuple[str, str, str]] | None:
    """Aligns two records character by character: of each non-ASCII character of ``clean`` its bytes and the characters of
    ``garbled`` that lie against them, one a byte; null if they don't fit."""
    out, at = [], 0
    for ch in clean:
        data = _encoded(ch, written)
        if data is None or len(piece := garbled[at : at + len(data)]) != len(data):
            return None
        if any(b != g for b, g in zip(data, piece, strict=True) if b < "\x80" or g < "\x80"):
            return None
        if ch > "\x7f":
            out.append((ch, data, piece))
        at += len(data)
    return out if at == len(garbled) and out else None


def infer(clean: str, garbled: str, written: str, how: str) -> list[str]:
    """The transformations that turn ``clean`` into ``garbled``: from their alignment those encodings whose table has
    each aligned character at its byte; for readings that take bytes together or lose some, the pair that ``how`` or
    ``written`` names."""
    if how != "?":
        rule = how if ">" in how else written
        return [rule] if garble(clean, *rule.split(">")) == garbled else []
    aligned = align(clean, garbled, written)
    if aligned is None:
        return []
    table = {(b, g) for _, data, piece in aligned for b, g in zip(data, piece, strict=True)}
    return [f"{written}>{codec}" for codec in SINGLE_BYTE if all(_table(codec).get(g) == ord(b) for b, g in table)]


def character_counts(docs: DataFrame, text: str) -> DataFrame:
    """In how many rows each non-ASCII character occurs, those certainly escape-coded included: ``ch``, ``n``; at most one row for
    each code point there is."""
    chars = F.array_distinct(F.split(F.regexp_replace(F.col(text), r"[\x00-\x7f]+", ""), ""))
    plain = docs.select(F.explode(chars).alias("ch")).filter("ch <> ''")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"ch": [ch for t in batch["__text"] for ch in {c for s in escaped_stretches(t) if s[3] for c in s[2]}.difference(t) if ch > "\x7f"]}, dtype=object)

    escaped = docs.select(F.col(text).alias("__text")).filter(F.col("__text").rlike(ESCAPE_OPENS)).mapInPandas(decode, "ch string")
    return plain.unionByName(escaped).groupBy("ch").agg(F.count("*").alias("n"))


def _twins(rows: pd.DataFrame) -> pd.DataFrame:
    one = rows[rows["clean"]].drop(columns="clean")
    other = rows[~rows["clean"] & rows["key"].isin(one["key"])].drop(columns="clean")
    both = one[one["key"].isin(other["key"])].merge(other, on="key", suffixes=("_c", "_g"))
    return both[both["id_c"] != both["id_g"]].drop(columns="key")[["id_c", "how_c", "score_c", "id_g", "how_g", "score_g"]]


def learn_rules(docs: DataFrame, text: str, plausible: Plausibility, *, least_gap: float = 1.0) -> DataFrame:
    """Transformations with their number of witnesses (pairs of twins): ``rule``, ``witnesses``.

    Each distinct record is looked at once. Twins meet by an equality of 8-byte keys, which only records that one
    reading turns into the other share, so no group of records is paired out. A garbled record has more characters than
    its clean twin; where it has as many, it must be less plausible by ``least_gap``.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"record": sorted({r for t in batch["__text"] for r in records(t)})}, dtype=object)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("key", "id", "how", "clean", "score")}
            for i, record in zip(batch["id"].tolist(), batch["record"], strict=True):
                score = plausible(record)
                for side, keys in ((True, clean_keys(record, lossy)), (False, garbled_keys(record))):
                    n = len(keys)
                    rows["key"].extend([k for k, _ in keys])
                    rows["how"].extend([how for _, how in keys])
                    rows["id"].extend([i] * n)
                    rows["clean"].extend([side] * n)
                    rows["score"].extend([score] * n)
            yield pd.DataFrame(rows)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by key: those of each key that has rows of both sides, paired."""
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            ends = held["key"].to_numpy() != held["key"].iloc[-1]
            yield _twins(held[ends])
            held = held[~ends]
        if held is not None:
            yield _twins(held)

    lossy = "\ufffd" in plausible.log
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own keeps the Python work spread
    source = docs.select(F.col(text).alias("__text")).filter(F.col("__text").rlike(r"[^\x00-\x7f]"))
    every = checkpoint(source.mapInPandas(split, "record string").repartition(parts, "record").distinct().select(F.xxhash64("record").alias("id"), "record"))
    keys = every.mapInPandas(emit, "key long, id long, how string, clean boolean, score double")
    met = keys.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(meet, "id_c long, how_c string, score_c double, id_g long, how_g string, score_g double")
    pairs = checkpoint(met.distinct())
    for name in ("c", "g"):
        pairs = pairs.join(every.toDF(f"id_{name}", f"record_{name}"), f"id_{name}")
    sure = (F.length("record_g") > F.length("record_c")) | (F.col("score_g") < F.col("score_c") - least_gap) | F.col("record_g").contains("\ufffd")
    witness = F.pandas_udf(lambda c, g, w, h: pd.Series([infer(*x) for x in zip(c, g, w, h, strict=True)], dtype=object), "array<string>")
    found = pairs.filter(sure).select("id_c", "id_g", F.explode(witness("record_c", "record_g", "how_c", "how_g")).alias("rule")).distinct()
    return found.groupBy("rule").agg(F.count("*").alias("witnesses"))


def lost_by(text: str, rules: list[tuple[str, str]]) -> str | None:
    """The learned transformation that the unreadable characters left in ``text`` come from: C1 controls from bytes read
    one by one, U+FFFD from a reading as UTF-8, of an encoding with one byte a character where they stand alone among
    letters, else of one with more."""
    if "\ufffd" not in text:
        return next((f"{w}>{r}" for w, r in rules if r == "latin-1"), next((f"{w}>{r}" for w, r in rules if r in SINGLE_BYTE), None))
    alone = len(re.findall(r"(?<!\ufffd)\ufffd(?!\ufffd)", text)) > text.count("\ufffd") / 2 and "\ufffd\ufffd\ufffd" not in text
    trails = re.search(r"\ufffd[\x40-\x7e]\ufffd", text) is not None  # second bytes that EUC encodings don't have
    order = sorted((w for w, r in rules if r == "utf-8"), key=lambda w: ((w in MULTI_BYTE) == alone, (w == "euc_jp") == trails))
    return f"{order[0]}>utf-8" if order else None


def repair_texts(docs: DataFrame, ident: str, text: str, *, least_witnesses: int = 2, least_gain: float = 0.5) -> DataFrame:
    """Texts that hold characters from a wrong reading, with what could be restored.

    Result, for affected rows only: ``ident``, ``repaired``, ``rules`` (transformations undone, in order, then the one
    that lost what is still unreadable; none if no transformation learned explains that) and ``complete`` (nothing
    unreadable is left). Null and empty texts and rows with a null ``ident`` are not affected; repeated rows come out once.
    The character counts and the witness counts go to the driver: at most one row for each code point and for each
    pair of encodings. ``least_witnesses``: pairs of lines a transformation must explain to be used.
    """
    source = docs.select(F.col(ident).alias("__id"), F.col(text).alias("__text")).filter(F.col("__id").isNotNull() & (F.length("__text") > 0))
    counted = source.agg(F.count("*")).first()[0]
    plausible = Plausibility({r.ch: r.n for r in character_counts(source, "__text").collect()}, counted)
    learned = learn_rules(source, "__text", plausible).filter(F.col("witnesses") >= least_witnesses).collect()
    every = sorted((r.rule.split(">")[0], r.rule.split(">")[1]) for r in learned)
    often = {r.rule: r.witnesses for r in learned}
    ranked = sorted(every, key=lambda r: (-often[f"{r[0]}>{r[1]}"], r))
    rules = [r for r in every if r[0] in _UNITS and r[1] != "utf-8"]

    hinted = hints(rules, plausible)

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t in zip(batch["__id"], batch["__text"], strict=True):
                mended, used = restore(t, hinted, plausible, least_gain=least_gain)
                lost = _LOSS.search(mended) is not None
                if lost and not any(rule.split(">")[1] in MULTI_BYTE for rule in used) and (rule := lost_by(mended, ranked)) is not None and rule not in used:
                    used = [*used, rule]  # else what was undone had itself lost bytes
                if used or lost or _LOSS.search(t):
                    out.append((i, mended, used, not lost))
            yield pd.DataFrame(out, columns=[ident, "repaired", "rules", "complete"])

    kind = docs.schema[ident].dataType.simpleString()
    odd = source.filter(F.col("__text").rlike(rf"[^\x00-\x7f]|{ESCAPE_OPENS}"))
    return odd.mapInPandas(mend, f"`{ident}` {kind}, repaired string, rules array<string>, complete boolean").distinct()
