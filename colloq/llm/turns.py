"""Raw transcript rows into clean speaker turns.

Speaker labels are normalised; within each transcript, variants are joined by union-find: labels with one number are
one speaker, and names join if they have the same initials and nearly the same letters, or the same words. Rows in which
no speech is left are dropped, and runs of one speaker become a turn.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloq.functions.text import is_finite
from colloq.operators.runs import mark_runs
from colloq.session import checkpoint

# Sound notes (what may stand alone in brackets), hesitations and listener noises.
SOUND_NOTES = (
    "laugh laughs laughter laughing chuckle chuckles cough coughs coughing sneeze sigh sighs applause clapping noise noises static "
    "music silence pause inaudible unintelligible indistinct crosstalk phone rings|phone ringing|ringing|door closes|door opens|door slams|"
    "background noise|background music|breath|breathing|beep|beeps|typing|click|clicks|throat clearing|clears throat|sniff|bgm|sound"
)
SOUND_NOTES_JA = "笑 笑い 笑い声 爆笑 苦笑 咳 咳払い くしゃみ ため息 拍手 雑音 騒音 無音 沈黙 間 音楽 聞き取れず 聞き取れない 聞き取り不能 不明瞭 電話の音 ドアの音 着信音 物音 紙の音 足音 呼び出し音 相槌 うなずき".split()
# Sounds that are no word of any language, and such that are also words or units ("er", "um", "mm").
HESITATIONS = "erm errm uhm uhmm umm ummm uhh uhhh hmm hmmm hmmmm mhmm".split()
WORDLIKE = "er err um uh ah ahh eh ehm hm mm mmm".split()
HESITATIONS_JA = "えーっと えーと えっと えーとー".split()
LONG_JA = "えー あのー そのー うーん うーむ んー んーと あー ああー まあー まぁー ふーん".split()
WORDLIKE_JA = "ええと えぇと あのう そのう".split()
LISTENER = r"m+[\s-]?h+m+|u+h+[\s-]?h+u+h+|a+h+[\s-]?h+a+h+|mm+"
LISTENER_JA = r"(?:うん)+|ふーん|ふうん|ふむ(?:ふむ)*|へえ+|へー+|ほう+|ほー+|うむ|ん+|はー+|ええっ?"
UNKNOWN = {"", "unknown", "unk", "none", "null", "nan", "na", "n/a", "speaker", "spk", "話者", "発言者", "不明", "話者不明", "?", "-", "??"}

_WORDS = "|".join(sorted({w for part in SOUND_NOTES.split("|") for w in ([part] if " " in part and part.count(" ") == 1 else part.split())}, key=len, reverse=True))
_SOUND = re.compile(
    rf"^[\W_]*(?:(?:{_WORDS})(?:[\s,/&]+(?:and\s+)?(?:{_WORDS}))*|(?:{'|'.join(sorted(SOUND_NOTES_JA, key=len, reverse=True))})|[぀-ヿ一-鿿]{{1,6}}の?音|[぀-ヿ一-鿿]{{0,4}}笑い?声?)[\W_]*$",
    re.I,
)
# Notes that are words one may write in brackets within a sentence: they go only where a clause begins or ends.
_PLAIN = re.compile(r"^[\W_]*(?:clicks?|static|silence|pause|beeps?|typing|sound|music|breath|noises?)[\W_]*$", re.I)
_BRACKETED = re.compile(r"\(\(([^()]{0,40})\)\)|\(([^()]{0,40})\)|\[([^\[\]]{0,40})\]|<([^<>]{0,40})>|\{([^{}]{0,40})\}|\*([^*]{1,40})\*|（([^（）]{0,40})）|【([^【】]{0,40})】|［([^［］]{0,40})］|〔([^〔〕]{0,40})〕|＜([^＜＞]{0,40})＞|〈([^〈〉]{0,40})〉")
_CLOCK = r"(?:\d{1,3}:)?\d{1,3}:\d{2}(?:[.,]\d{1,3})?"
_TIME = re.compile(rf"^\s*(?:[\[(<［（【]\s*({_CLOCK})(?:\s*(?:-|–|—|~|〜|-->|→)\s*{_CLOCK})?\s*[\])>］）】]\s*|({_CLOCK})\s*(?:(?:-->|[-–—~〜])\s*(?:{_CLOCK})?)?(?:\s+|$))[-–—:：]?\s*")
_NAME = r"(?:speaker|spk|話者|発言者|ｓｐｅａｋｅｒ|s)"
_NUMBERED = re.compile(r"^(?:speaker|spk|spkr|話者|発言者|s)[\s_\-#.:]*(\d{1,6})$")
_LABEL = re.compile(rf"^\s*(?:[\[<【［＜(（]\s*({_NAME}[\s_\-#＃]*\d{{1,6}})\s*[\]>】］＞)）]\s*[:：]?|({_NAME}[\s_\-#＃]*\d{{1,6}})\s*[:：>])\s*", re.I)
_NOTES = re.compile(r"[♪♫♬♩〜～]+")
_any = lambda words: "|".join(sorted(words, key=len, reverse=True))
_PAUSE = r"(?:\s*(?:\.\.\.|[…,.]))"
_EDGE = r"(?:(?<![^\s.,!?;:…()\[\]<>{}*\-–—（）【】、。！？：]))"
_NO_UNIT = r"(?<!\d)(?<!\d\s)"
# English ones in capitals are abbreviations. What may be a word is dropped between pauses only.
_HESITATE = re.compile(
    rf"(?<![\w'-])(?:(?:{_any(HESITATIONS)}|{_any(w.capitalize() for w in HESITATIONS)})(?![\w'-]){_PAUSE}*\s*|{_EDGE}(?!(?<=\d\s)mm)(?:{_any(WORDLIKE)}|{_any(w.capitalize() for w in WORDLIKE)})(?![\w'-])(?:{_PAUSE}+\s*|\s*$))"
)
_CLAUSE_JA = r"(?:(?<=[\s、。！？!?…（）「」『』【】\])>♪〜])|^)"
_PAUSE_JA = r"(?:[、。…・,]|\.\.\.)"
_HESITATE_JA = re.compile(rf"(?:{_any(HESITATIONS_JA)}){_PAUSE_JA}*\s*|(?:{_any(LONG_JA)})(?:{_PAUSE_JA}+\s*|\s+|$|(?=[（(【\[<♪）)]))|{_CLAUSE_JA}(?:{_any(LONG_JA)})|{_CLAUSE_JA}(?:{_any(WORDLIKE_JA)})(?:{_PAUSE_JA}+\s*|\s+|$)", re.M)
_LISTEN = re.compile(rf"{_EDGE}{_NO_UNIT}(?!(?-i:[A-Z]{{2,3}})(?![\w-]))(?<![\w'-])(?:{LISTENER})(?![\w'-])(?:\s*[.,!?…]+\s*|\s*$)", re.I)
_LISTEN_JA = re.compile(rf"^(?:{LISTENER_JA})$")
_SPEECH = re.compile(r"[^\W_]")


def _seconds(clock: str) -> float:
    out = 0.0
    for part in clock.replace(",", ".").split(":"):
        out = out * 60 + float(part)
    return out


def normal_label(label: str | None) -> str | None:
    """'SPEAKER_07' for any way to write a numbered label; other names trimmed; null for unknown ones."""
    if label is None:
        return None
    plain = unicodedata.normalize("NFKC", label).strip().strip("[]<>(){}【】「」:;. \t").strip()
    m = _NUMBERED.match(plain.lower())
    if m:
        return f"SPEAKER_{int(m.group(1)):02d}"
    return None if plain.lower() in UNKNOWN else plain


def parse_segment(text: str | None) -> tuple[float | None, str | None, str]:
    """(seconds at the head, label in the text, what is speech) of a raw row."""
    if not text:
        return None, None, ""
    rest, at, label = text, None, None
    while True:
        if m := _TIME.match(rest):
            at = _seconds(m.group(1) or m.group(2)) if at is None else at
        elif m := _LABEL.match(rest):
            label = normal_label(m.group(1) or m.group(2)) if label is None else label
        else:
            break
        rest = rest[m.end() :]
    return at, label, clean_speech(rest)


def clean_speech(text: str) -> str:
    """``text`` without sound notes, hesitations and listener noises.

    Sounds that may also be words (``er``, ``um``, ``mm``, ``そのう``) and listener noises go only between pauses: at a
    clause's edge and with a mark, or nothing, behind them. All capitals are abbreviations and stay, as do units after
    a number.
    """

    def bracket(m: re.Match) -> str:
        inside = next(g for g in m.groups() if g is not None)
        alone = _HESITATE_JA.sub("", _HESITATE.sub("", _LISTEN.sub("", inside)))
        if _PLAIN.match(inside) and re.search(r"\w\s*$", text[: m.start()]) and re.match(r"\s*\w", text[m.end() :]):
            return m.group()
        return "" if _SOUND.match(inside) or not _SPEECH.search(alone) or _LISTEN_JA.match(inside.strip("。、…. ")) else m.group()

    out = _BRACKETED.sub(bracket, text)
    out = _NOTES.sub("", out)
    out = _HESITATE_JA.sub("", _HESITATE.sub("", _LISTEN.sub("", out)))
    out = re.sub(r"[ \t　]+", " ", out).strip()
    bare = re.sub(r"[\s。、，,.!?！？…・]+", "", out)
    return out if _SPEECH.search(bare) and not _LISTEN_JA.match(bare) else ""


_HONORIFIC = re.compile(r"(?:さん|様|氏|くん|君|先生|殿)$")
_MOD, _BASE = 2**61 - 1, 1_000_003


def _tokens(name: str) -> list[str]:
    plain = _HONORIFIC.sub("", unicodedata.normalize("NFKC", name).casefold().strip())
    return [t for t in re.split(r"[\W_]+", plain) if t] or [plain]


def _one_letter_less(text: str) -> list[int]:
    """Hashes of ``text`` and of what is left of it without each of its letters, in one pass."""
    codes, n = [ord(c) + 1 for c in text], len(text)
    before, power = [0], [1]
    for c in codes:
        before.append((before[-1] * _BASE + c) % _MOD)
        power.append(power[-1] * _BASE % _MOD)
    whole = before[-1]
    tail = lambda i: (whole - before[i] * power[n - i]) % _MOD
    return [whole, *((before[i] * power[n - 1 - i] + tail(i + 1)) % _MOD for i in range(n))]


def name_keys(name: str, least_letters: int = 5) -> tuple[list[str], list[str]]:
    """Keys by which a name joins others: those any two names may share, and those that tie names with initials for
    words to names that have the words.

    Two names share a key if they have the same words in any order, the same letters once blanks and signs are gone, or,
    with the same initials and at least ``least_letters`` letters, differ in one letter (missing, added, replaced or
    swapped with the next).
    """
    tokens = sorted(_tokens(name))
    letters = "".join(_tokens(name))
    same = ["w" + "|".join(tokens), "l" + letters]
    if len(letters) >= least_letters and len(letters) > len(tokens):
        initials = "".join(t[0] for t in tokens)
        same += [f"d{initials}:{h:x}" for h in _one_letter_less("".join(tokens))]
    short = [i for i, t in enumerate(tokens) if len(t) == 1]
    if len(tokens) < 2 or len(short) == len(tokens):
        return same, []
    if short:
        return same, ["a" + "|".join(sorted(tokens))]
    return same, ["a" + "|".join(sorted([*tokens[:i], tokens[i][0], *tokens[i + 1 :]])) for i in range(len(tokens))]


def cluster_labels(labels: list[tuple[str, int]]) -> dict[str, str]:
    """Names of one transcript (with their counts) to the canonical name of their cluster, its most frequent, then
    smallest.

    Union-find over the keys of :func:`name_keys`, so nothing is compared pair by pair. A name with initials joins the
    names it may stand for only if they are one cluster. Numbered labels are what they are and join nothing.
    """
    parent = {name: name for name, _ in labels}

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holder: dict[str, str] = {}
    fuller: dict[str, set[str]] = {}
    initialled: dict[str, str] = {}
    for name in sorted(n for n in parent if not n.startswith("SPEAKER_")):
        same, ties = name_keys(name)
        for key in same:
            parent[find(name)] = find(holder.setdefault(key, name))
        if len(ties) == 1:
            initialled[name] = ties[0]
        for key in ties if len(ties) > 1 else ():
            fuller.setdefault(key, set()).add(name)
    for name, key in sorted(initialled.items()):
        if len(roots := {find(x) for x in fuller.get(key, ())}) == 1:
            parent[find(name)] = roots.pop()
    count = dict(labels)
    groups: dict[str, list[str]] = {}
    for name in parent:
        groups.setdefault(find(name), []).append(name)
    best = {root: min(names, key=lambda n: (-count[n], n)) for root, names in groups.items()}
    return {name: best[find(name)] for name in parent}


_PARSED = T.StructType([T.StructField("head_s", T.DoubleType()), T.StructField("label", T.StringType()), T.StructField("clean", T.StringType())])


@F.pandas_udf(_PARSED)
def _parse(speaker: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = []
    for s, t in zip(speaker, text, strict=True):
        at, inside, clean = parse_segment(t)
        rows.append((at, normal_label(s) or inside, clean))
    return pd.DataFrame(rows, columns=["head_s", "label", "clean"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_keys(names: pd.Series) -> pd.Series:
    return names.map(lambda n: [k for keys in name_keys(n) for k in keys])


def _cluster(pdf: pd.DataFrame) -> pd.DataFrame:
    to = cluster_labels(list(zip(pdf["label"], pdf["n"], strict=True)))
    return pd.DataFrame({"transcript": pdf["transcript"], "label": pdf["label"], "canonical": [to[x] for x in pdf["label"]]})


def _canonical_names(names: DataFrame) -> DataFrame:
    """``transcript``, ``label``, ``canonical`` of the names (``transcript``, ``label``, ``n``) that have a key in common
    with another one of their transcript; only those come to the union-find."""
    keys = names.select("transcript", "label", F.explode(_all_keys("label")).alias("key"))
    shared = keys.groupBy("transcript", "key").agg(F.count("*").alias("c")).filter("c > 1")
    linked = keys.join(shared, ["transcript", "key"], "left_semi").select("transcript", "label").distinct()
    kind = names.schema["transcript"].dataType
    schema = T.StructType([T.StructField("transcript", kind), T.StructField("label", T.StringType()), T.StructField("canonical", T.StringType())])
    return names.join(linked, ["transcript", "label"], "left_semi").groupBy("transcript").applyInPandas(_cluster, schema)


def clean_segments(df: DataFrame, transcript: str, ident: str, ordinal: str, *, bucket_s: float = 600.0) -> DataFrame:
    """Kept rows with ``at_s``, ``clean``, ``speaker`` (canonical, carried on from the row before where missing) and
    ``run``, which rows of one turn share. See :func:`speaker_turns` for the cases."""
    rows = df.select(F.col(transcript).alias("transcript"), F.col(ident).alias("ident"), F.col(ordinal).alias("ordinal"), "speaker", "start_s", "text").distinct()
    rows = rows.withColumn("p", _parse.asNondeterministic()("speaker", "text")).select("transcript", "ident", "ordinal", F.when(is_finite("start_s"), F.col("start_s")).otherwise(F.col("p.head_s")).alias("at_s"), "p.label", "p.clean")
    rows = rows.filter("clean <> '' AND transcript IS NOT NULL")
    rows = checkpoint(rows)  # parsed once; the names and the runs are both found in it
    names = rows.filter("label NOT LIKE 'SPEAKER!_%' ESCAPE '!'").groupBy("transcript", "label").agg(F.count("*").alias("n"))
    if not names.isEmpty():
        rows = rows.join(_canonical_names(names), ["transcript", "label"], "left").withColumn("canonical", F.coalesce("canonical", "label"))
    else:
        rows = rows.withColumn("canonical", F.col("label"))
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("at_s") / F.lit(bucket_s)), F.lit(2**62))).withColumn("at", F.coalesce("at_s", F.lit(float("inf"))))
    return mark_runs(rows, ["transcript"], "bucket", ["at", "ordinal", "ident"], "canonical").withColumnRenamed("label_filled", "speaker")


def speaker_turns(df: DataFrame, transcript: str = "file_id", ident: str = "segment_id", ordinal: str = "seg_ord") -> DataFrame:
    """Clean turns of each transcript: ``transcript``'s column, ``speaker``, ``first_id``, ``last_id``, ``start_s``,
    ``segments`` and ``text``.

    Rows are ordered by ``start_s`` or, where that is null or not finite, by the time mark at the head of ``text``;
    rows with neither come last, by ``ordinal``. Identical rows count once. Null and empty texts and texts of notes and
    noises only are dropped; a row without a label continues the kept row before it, and rows before a transcript's
    first label belong to no turn. Other columns are ignored.
    """
    kept = clean_segments(df, transcript, ident, ordinal).filter("run IS NOT NULL")
    at = F.struct("at", "ordinal", "ident")
    turns = kept.groupBy("transcript", "run").agg(F.first("speaker").alias("speaker"), F.min(at).alias("a"), F.max(at).alias("b"), F.min("at_s").alias("start_s"), F.count("*").alias("segments"), F.array_sort(F.collect_list(F.struct("at", "ordinal", "ident", "clean"))).alias("texts"))
    return turns.select(F.col("transcript").alias(transcript), "speaker", F.col("a.ident").alias("first_id"), F.col("b.ident").alias("last_id"), "start_s", "segments", F.array_join("texts.clean", " ").alias("text"))
