"""Sentence boundaries in many languages and scripts.

Characters are tagged as the last of a sentence or as inside one by a linear-chain model (averaged structured
perceptron over sparse features, first-order transitions) with Viterbi decoding. It is trained here on a bounded sample
of the texts themselves: their own marks, read with care for abbreviations, numbers, quotations and brackets, say where
sentences end, and each text is learned both as it is and with its marks stripped, so that texts without marks, and
scripts that have none, are cut by what stands around a break. Characters that nothing could end a sentence at (inside
a word or a quotation) have their tag fixed, which leaves the decoder a few positions in a text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks, quotation pairs, abbreviations and words that go on after a quotation.
STRONG = "。．！？｡!?؟۔।॥…‼⁇⁈⁉"
ENDERS = STRONG + "."
PAIRS = {"「": "」", "『": "』", "（": "）", "(": ")", "［": "］", "[": "]", "【": "】", "《": "》", "〈": "〉", "“": "”", "‘": "’", "«": "»", "‹": "›", "„": "“", "‚": "‘", "｢": "｣", '"': '"', "〝": "〟"}
CLOSERS = set(PAIRS.values()) | {"”", "’"}
ABBREVIATIONS = set(
    "mr mrs ms dr prof sr sra srta st jr herr fr m mm mme mlle vs e.g i.e eg ie etc approx aprox ca bzw usw incl excl fig figs no nos nr nro núm num p pp vol ch sec min hr hrs "
    "bldg rm apt fl ver v inc ltd co corp dept est tel fax ext u.s u.k u.n a.m p.m am pm z.b d.h u.a o.ä s.o c.-à-d c.-a-d p.ej ej ee.uu p.ex ex cf al jan feb mar apr jun jul aug sep sept oct nov dec".split()
)
FINAL_TOO = {"p.m", "a.m", "etc", "u.s", "u.k", "inc", "ltd", "co", "corp", "min", "sec", "hr", "hrs", "jr", "usw", "al"}
GOES_ON_JA = re.compile(r"と(?!ころで|はいえ|にかく|もあれ|もかく|りあえず|くに|き)|って|で(?!は|も|すが|すから|すので)|だ(?!から|けど|が)|の|に|を|が|は(?!い)|も(?!う|し|ち|っと)|へ|や(?!は)|な(?:ど|ん)|、|，|,")
SAYS_ZH = re.compile(r"^[^。！？!?\n]{0,12}(?:说|說|道|问|問|喊|写|寫|表示|回答)[着道了过]?(?:[。！？!?]|$)")
THAI_FINAL = ("ครับ", "ค่ะ", "คะ", "นะ", "จ้ะ", "จ้า", "ฮะ", "ครับผม")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")


def _kind(ch: str) -> str:
    o = ord(ch)
    if o < 0x80:
        return "U" if ch.isupper() else "l" if ch.islower() else "0" if ch.isdigit() else ch
    if 0x3041 <= o <= 0x309F:
        return "h"
    if 0x30A0 <= o <= 0x30FF or 0xFF66 <= o <= 0xFF9F:
        return "k"
    if 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
        return "c"
    if 0xAC00 <= o <= 0xD7A3:
        return "g"
    if 0x0E00 <= o <= 0x0EFF or 0x1000 <= o <= 0x109F or 0x1780 <= o <= 0x17FF:
        return "t"
    if 0x0590 <= o <= 0x08FF:
        return "a"
    if 0x0900 <= o <= 0x0DFF:
        return "d"
    if ch.isupper():
        return "U"
    if ch.islower():
        return "l"
    return "0" if ch.isdigit() else ch


_CLOSED_BY = {o: {c, "”"} if o == "„" else {c} for o, c in PAIRS.items()}


def _match_pairs(line: str) -> dict[int, int]:
    """Opening to closing positions; marks without their other half, and apostrophes, are no pairs. Each mark is looked
    at once: for each closing sign the places in the stack of those it may close are kept, and outdated ones skipped."""
    stack: list[int] = []
    places: dict[str, list[tuple[int, int]]] = {}
    pairs: dict[int, int] = {}
    for i, ch in enumerate(line):
        if ch in CLOSERS:
            held = places.get(ch, [])
            while held and (held[-1][0] >= len(stack) or stack[held[-1][0]] != held[-1][1]):
                held.pop()
            if held:
                if ch == "’" and 0 < i < len(line) - 1 and line[i - 1].isalpha() and line[i + 1].isalpha():
                    continue
                k, opened = held.pop()
                pairs[opened] = i
                del stack[k:]
                continue
        if ch in PAIRS:
            for closer in _CLOSED_BY[ch]:
                places.setdefault(closer, []).append((len(stack), i))
            stack.append(i)
    return pairs


@dataclass(slots=True)
class Spot:
    """A place where a sentence may end: after ``at``, with what is around it."""

    at: int
    mark: str  # the marks at the end, without closing quotes
    opener: int  # where the quotation that closes here opens, or -1
    blank: str
    after: int


@lru_cache(maxsize=16)
def _scripts(line: str) -> tuple[bool, bool]:
    """Whether a line holds kana, and whether it holds Chinese characters."""
    return bool(re.search("[\u3040-\u30ff]", line)), bool(re.search("[\u3400-\u9fff]", line))


def _before(line: str, at: int, most: int = 200) -> str:
    """The last non-blank character before ``at``, looking back a bounded way."""
    return line[max(0, at - most) : at].rstrip()[-1:]


# Polite forms end a sentence wherever a noun or a quotation follows them, marked or not.
_POLITE = re.compile(r"(?:です|ます|ました|でした|ません|ましょう|でしょう|ください)$")


def _spots(line: str) -> list[Spot]:
    pairs = _match_pairs(line)
    inside = bytearray(len(line) + 1)
    for a, b in pairs.items():
        inside[a:b] = b"\x01" * (b - a)
    opens = {b: a for a, b in pairs.items()}
    unspaced = any(_kind(ch) in "hkct" for ch in line)
    bare = unspaced and not re.search(rf"[{STRONG}\s]", line.strip())
    out: list[Spot] = []
    n, i = len(line), 0
    while i < n:
        ch = line[i]
        if inside[i] or ch.isspace():
            i += 1
            continue
        j, mark, opener = i, "", -1
        if ch in ENDERS or i in opens:
            if i in opens:  # a quotation closes: what mark stands inside, before it?
                opener = opens[i]
                k = i - 1
                while k > opener and (line[k].isspace() or line[k] in CLOSERS):
                    k -= 1
                while k > opener and line[k] in ENDERS:
                    mark = line[k] + mark
                    k -= 1
                if j + 1 < n and line[j + 1] in STRONG:
                    mark, opener = "", -1
            while j + 1 < n and not inside[j + 1] and line[j + 1] in ENDERS:
                j += 1
            if ch in ENDERS or j > i:
                mark = line[i : j + 1].strip("".join(CLOSERS)) or mark
            while j + 1 < n and (j + 1) in opens and opens[j + 1] < i:
                j += 1
        k = j + 1
        while k < n and line[k].isspace():
            k += 1
        blank = line[j + 1 : k]
        if k >= n:
            break
        run_on = not mark and not blank and unspaced and not bare and _POLITE.search(line, max(0, j - 4), j + 1) and _kind(line[k]) in "ck「『"
        if mark or blank and (unspaced or len(blank) > 1 or "　" in blank) or bare and k == j + 1 or run_on:
            dots = opener < 0 and not blank and (mark == "." or mark == "．" and line[k].isalnum() or mark and set(mark) <= {"…"})
            latin = not mark and blank == " " and _kind(line[j]) in "Ul0" and _kind(line[k]) in "Ul0"
            if not dots and not latin and (mark or line[k] not in STRONG):
                out.append(Spot(j, mark, opener, blank, k))
        i = j + 1
    return out


def _word_before(line: str, at: int) -> str:
    m = re.search(r"[^\s,;:(（「“\"'‘「『]*$", line[max(0, at - 24) : at])
    return m.group().rstrip(".").lower() if m else ""


def teach(line: str, spots: list[Spot]) -> list[bool]:
    """Which spots end a sentence, by the marks; None of the training texts' labels come from elsewhere."""
    out, start = [], 0
    for s in spots:
        nxt, before = line[s.after], line[s.at]
        kind = _kind(nxt)
        if s.opener >= 0 and before in CLOSERS:
            end = _after_quote(line, s, start, kind)
        elif s.mark:
            end = _after_mark(line, s, kind)
        else:
            end = _at_blank(line, s)
        out.append(end)
        if end:
            start = s.after
    return out


def _after_quote(line: str, s: Spot, start: int, kind: str) -> bool:
    if not s.mark:
        return False
    rest = line[s.after : s.after + 16]
    alone = s.opener <= start
    japanese = line[s.opener] in "「『｢（" or _scripts(line)[0]
    if kind == "l" and not japanese or rest[0] in ",，、;:；：)）":
        return False
    if kind == "g":
        return bool(s.blank) and alone
    if kind in "ad":
        return False
    if kind == "t":
        return bool(s.blank) and alone
    if japanese:
        if GOES_ON_JA.match(rest):
            return False
        if rest[0] in "「『｢" and line[s.opener] in "「『｢":
            return s.mark[-1] not in "？?"
        return True
    if _scripts(line)[1] and not s.blank:
        return not (alone and SAYS_ZH.match(rest))
    return True


def _after_mark(line: str, s: Spot, kind: str) -> bool:
    mark = s.mark
    head = line[s.at - len(mark)] if s.at >= len(mark) else ""
    nxt = line[s.after]
    if set(mark) <= set("…."):
        if "…" in mark or len(mark) > 1:
            return bool(s.blank) and kind != "l" and _kind(head or " ") not in "hk" if s.blank else False
        if not s.blank:
            return False
        if head and _kind(head) in "gdacht":
            return True
        word = _word_before(line, s.at)
        tail = re.split(r"[^\w.à-]", word)[-1]
        if kind == "l" or nxt in ",;:)":
            return False
        if re.fullmatch(r"[^\W\d_]", tail) or tail in ABBREVIATIONS or re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", tail):
            return tail in FINAL_TOO and kind not in "0"
        return not (tail.isdigit() and len(tail) <= 2 and re.search(r"\b(?:am|vom|zum|bis|der|den|dem)\s+\d{1,2}\.$", line[max(0, s.at - 12) : s.at + 1]))
    if not s.blank:
        return not (set(mark) <= set("!?") and kind in "l0" and _kind(head or " ") in "Ul0") and nxt not in ",，、"
    return not (kind == "l" and _kind(head or " ") in "Ul0" and set(mark) <= set("!?"))


_FINAL_JA = re.compile(r"(?:です|ます|ました|でした|ません|ましょう|でしょう|ください|だった|である|たい|ない|すか|せんか|います|った|いた|した|んだ|よね|だね|ますよ|ですよ|ですね|ますね|だ|か)[♪]?$")


def _at_blank(line: str, s: Spot) -> bool:
    before = line[max(0, s.at - 15) : s.at + 1]
    if before.endswith(THAI_FINAL):
        return True
    if not s.blank:
        return bool(_POLITE.search(before)) and _kind(line[s.after]) in "ck「『"
    return _kind(before[-1]) in "hkc♪" and bool(_FINAL_JA.search(before))


def _features(line: str, s: Spot) -> list[str]:
    before, nxt = line[max(0, s.at - 7) : s.at + 1], line[s.after : s.after + 4]
    kind = _kind(nxt[0])
    blank = "n" if not s.blank else "3" if "　" in s.blank else "2" if len(s.blank) > 1 else "1"
    dot = set(s.mark) == {"."}
    mark = ("..." if len(s.mark) > 1 else ".") if dot else s.mark[-1:]
    head = line[s.at - len(s.mark)] if s.mark and s.opener < 0 and s.at >= len(s.mark) else line[s.at]
    hk = _kind(head)
    quote = line[s.opener] if s.opener >= 0 else ""
    prior = _before(line, s.opener) if s.opener >= 0 else ""
    alone = "" if s.opener < 0 else "s" if not prior else "e" if prior in ENDERS or prior in CLOSERS else ":" if prior in ":：,，、" else "m"
    out = [
        "b",
        f"m{mark}|{blank}|{kind}",
        f"m{mark}|{hk}|{kind}|{blank}|{quote}",
        f"m{mark}|{hk}|{kind}",
        f"q{quote}|{mark}|{alone}|{kind}|{blank}",
        f"q{quote}|{mark}|{alone}|{nxt[:2]}",
        f"q{quote}|{mark}|{nxt[:1]}",
        f"n2{bool(mark)}|{nxt[:2]}",
        f"n4{bool(mark)}{bool(quote)}|{nxt}",
        f"k{mark}|{kind}",
    ]
    if quote:
        go, says = bool(GOES_ON_JA.match(line[s.after : s.after + 8])), bool(SAYS_ZH.match(line[s.after : s.after + 16]))
        kana, han = _scripts(line)
        out.append(f"Q{quote in '「『｢（'}{kana}{han}|{bool(mark)}|{mark in '？?'}|{go}|{says}|{alone}|{kind}|{bool(s.blank)}")
        out.append(f"go{bool(GOES_ON_JA.match(line[s.after : s.after + 8]))}|{bool(mark)}|{mark in '？?'}|{nxt[0] in '「『'}")
        out.append(f"zh{bool(SAYS_ZH.match(line[s.after : s.after + 16]))}|{bool(mark)}|{alone in 'se'}|{hk}{kind}")
        out.append(f"qm{bool(mark)}|{kind}|{bool(s.blank)}")
    if dot and not quote:
        word = re.split(r"[^\w.à-]", _word_before(line, s.at))[-1]
        dated = bool(re.search(r"\b(?:am|vom|zum|bis|der|den|dem)\s+\d{1,2}\.$", line[max(0, s.at - 12) : s.at + 1]))
        out.append(f"D{len(s.mark)}|{len(word) == 1 and word.isalpha()}|{word in ABBREVIATIONS}|{word in FINAL_TOO}|{'.' in word}|{kind}|{hk in 'gdacht'}|{dated}")
        out += [f"w{word[-8:]}|{kind in 'l'}", f"a{word in ABBREVIATIONS}|{word in FINAL_TOO}|{kind}|{blank}", f"i{len(word) == 1 and word.isalpha()}|{kind}", f"d{word.isdigit() and len(word) < 3}|{kind}|{bool(re.search(r'(?:am|vom|zum) \d{1,2}$', line[max(0, s.at - 8) : s.at]))}", f"ab{word in ABBREVIATIONS and word not in FINAL_TOO}", f"abc{bool(re.fullmatch(r'(?:[^\W\d_]\.)+[^\W\d_]', word))}|{kind}"]
    if not mark:
        final = bool(_FINAL_JA.search(line[max(0, s.at - 6) : s.at + 1]))
        out += [f"x1{before[-1:]}|{blank}", f"x2{before[-2:]}|{blank}", f"x3{before[-3:]}|{blank}", f"x4{before[-4:]}", f"x2{before[-2:]}|{nxt[:1]}", f"xk{hk}|{kind}|{blank}", f"f{final}|{kind}|{blank}", f"th{before.endswith(THAI_FINAL)}|{blank}"]
    return out


def _viterbi(scores: list[float], steps: list[float]) -> list[bool]:
    """The best sequence of tags, given how much better a boundary is than none at each spot, and what the steps from tag
    to tag (00, 01, 10, 11) are worth."""
    if not scores:
        return []
    to0, to1, from10, from11 = steps
    inside, boundary = 0.0, scores[0]
    back: list[tuple[bool, bool]] = []
    for emit in scores[1:]:
        came = inside + to0 < boundary + from10, inside + to1 < boundary + from11
        back.append(came)
        inside, boundary = (boundary + from10 if came[0] else inside + to0), (boundary + from11 if came[1] else inside + to1) + emit
    tag = boundary > inside
    tags = [tag]
    for came in reversed(back):
        tag = came[tag]
        tags.append(tag)
    tags.reverse()
    return tags


class ChainModel:
    """Weights of a first-order chain over the tags inside (0) and boundary (1)."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = {} if weights is None else weights

    def decode(self, features: list[list[str]]) -> list[bool]:
        """The best tag sequence."""
        w = self.weights
        return _viterbi([sum([w.get(f, 0.0) for f in fs]) for fs in features], [w.get(t, 0.0) for t in ("t00", "t01", "t10", "t11")])


    @classmethod
    def train(cls, data: list[tuple[list[list[str]], list[bool]]], epochs: int = 30, margin: float = 4.0) -> ChainModel:
        """Weights under which the right tags win by ``margin`` at each spot, as far as ``epochs`` passes get."""
        number: dict[str, int] = {f"t{a}{b}": 2 * a + b for a in (0, 1) for b in (0, 1)}
        rows = [([[number.setdefault(f, len(number)) for f in fs] for fs in features], gold) for features, gold in data]
        weights, total = [0.0] * len(number), [0.0] * len(number)
        step = 0
        shuffle = random.Random(7)
        for _ in range(epochs):
            wrong = 0
            shuffle.shuffle(rows)
            for features, gold in rows:
                step += 1
                guess = _viterbi([sum([weights[f] for f in fs]) + (-margin if g else margin) for fs, g in zip(features, gold, strict=True)], weights[:4])
                if guess == gold:
                    continue
                wrong += 1
                for k, (g, p) in enumerate(zip(gold, guess, strict=True)):
                    if g != p:
                        d = 1.0 if g else -1.0
                        for f in features[k]:
                            weights[f] += d
                            total[f] += d * step
                    if k:
                        for f, d in ((2 * gold[k - 1] + g, 1.0), (2 * guess[k - 1] + p, -1.0)):
                            weights[f] += d
                            total[f] += d * step
            if not wrong:
                break
        step = max(step, 1)
        return cls({f: weights[i] - total[i] / (step + 1) for f, i in number.items() if weights[i] or total[i]})


def _stripped(line: str, spots: list[Spot], ends: list[bool], blank: str) -> tuple[str, set[int]]:
    """``line`` without the marks at its ends of sentences, ``blank`` between them; and where those ends now are."""
    out, last, places = [], 0, set()
    for s, end in zip(spots, ends, strict=True):
        if not end:
            continue
        out.append(line[last : s.at + 1].rstrip(ENDERS))
        places.add(sum(map(len, out)) - 1)
        out.append(blank)
        last = s.after
    out.append(line[last:].rstrip().rstrip(ENDERS))
    return "".join(out), places


def training_data(texts: list[str]) -> list[tuple[list[list[str]], list[bool]]]:
    """Each line as it is and with its marks stripped, as (features, tags) of its spots."""
    data: list[tuple[list[list[str]], list[bool]]] = []

    def learn(line: str, spots: list[Spot], tags: list[bool]) -> None:
        if spots:
            data.append(([_features(line, s) for s in spots], tags))

    for line in (m.group() for text in texts for m in _LINE.finditer(text)):
        spots = _spots(line)
        ends = teach(line, spots)
        learn(line, spots, ends)
        if any(_kind(ch) in "hkct" for ch in line):
            for blank in ("　", " ", ""):
                bare, places = _stripped(line, spots, ends, blank)
                again = _spots(bare)
                learn(bare, again, [s.at in places or _keeps(bare, s, places) for s in again])
    return data


def _keeps(line: str, s: Spot, places: set[int]) -> bool:
    """Ends in a stripped line that are not where a mark was: blanks and quotations that end one anyway."""
    return s.at not in places and bool(s.mark or s.blank) and teach(line, [s])[0] and not s.mark


def sentence_spans(text: str, model: ChainModel) -> list[tuple[int, int]]:
    """(start, end) of each sentence of ``text``: from its first to its last non-blank character, end exclusive."""
    out = []
    for m in _LINE.finditer(text):
        line, base = m.group(), m.start()
        spots = _spots(line)
        start = 0
        cuts = [s.at + 1 for s, end in zip(spots, model.decode([_features(line, s) for s in spots]), strict=True) if end]
        for cut in [*cuts, len(line)]:
            part = line[start:cut]
            if part.strip():
                lead = len(part) - len(part.lstrip())
                out.append((base + start + lead, base + start + len(part.rstrip())))
            start = cut
    return out


def fit_sentence_model(texts: DataFrame, text: str, sample: int = 8000, longest: int = 4000, most: int = 1_000_000) -> ChainModel:
    """A model fitted to at most ``sample`` distinct texts of at most ``longest`` characters and ``most`` characters in
    all, those with the smallest hash; the sample goes to the driver. The other texts are split all the same, and whole.
    Only about twice as many rows as are wanted are shuffled."""
    rows = texts.filter(F.length(text).between(1, longest)).select(F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    distinct = rows.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, 2.0 * sample / max(distinct, 1))
    few = rows.filter(F.col("h") <= F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else rows
    taken = [r.t for r in few.distinct().orderBy("h", "t").limit(sample).collect()]
    room = accumulate(map(len, taken))
    return ChainModel.train(training_data([t for t, upto in zip(taken, room, strict=True) if upto <= most]))


def split_sentences(df: DataFrame, keys: list[str], text: str, model: ChainModel) -> DataFrame:
    """One row per sentence: the keys, ``sent_ord`` (from 0), ``start_char``, ``end_char`` and ``sentence``.

    Positions count code points, the end is exclusive. Null and blank texts and rows with a null key have no sentences;
    a line break always ends one; repeated rows give repeated sentences. Other columns are dropped.
    """
    weights = model.weights

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = ChainModel(weights)
        for batch in batches:
            out = []
            for *key, t in batch.itertuples(index=False, name=None):
                out.extend((*key, n, a, b, t[a:b]) for n, (a, b) in enumerate(sentence_spans(t, chain)))
            yield pd.DataFrame(out, columns=[*keys, "sent_ord", "start_char", "end_char", "sentence"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.filter(F.length(text) > 0).select(*keys, text).dropna(subset=keys).mapInPandas(cut, f"{kinds}, sent_ord int, start_char int, end_char int, sentence string")
