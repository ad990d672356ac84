import pytest

from colloq.llm.sentences import ChainModel, fit_sentence_model, sentence_spans, split_sentences, teach, training_data
from colloq.llm import sentences as S

# Texts with "|" where a sentence ends and the next one begins.
GOLD = [
    "障害指標は残りです。|次です！？|では始めます",
    "「今日は予算比較までにしましょう。」|「障害分割は間に合わない。」という声が出ました。|次です。",
    "「倉庫負荷を見た？」「まだです。」というやり取りが残っています。",
    "『なぜ物流評価なのか？』という題に直します。|件名は「Re: ASR vs. VAD!」でお願いします。",
    "（なお、顧客移行は対象外です。）|端末仕様は延期です（詳しくはNo.13を参照）。",
    "それは…監査費用としては難しいです。|えっ……顧客審査もですか！？|U.S.の班はvs.形式で比べました。|Ver.5.82より上です。",
    "Meet in bldg. 4, rm. 8, for ASR. |Is it really 96.1 percent?! |Mr. Tanfeld and Dr. Drossley agree.",
    "The call ends at 5 p.m. |Sharding is next. |The U.S. office put it at No. 17 on its list. |Hi, I'm Yrsa H. Drossley from here.",
    "She said “no. Not prefetch.” and left the room. |Someone asked, \"Who owns it?\" and nobody answered. |“Not today... maybe Friday.” |We could... maybe wait.",
    "(The demo was skipped.) |Some items, e.g. API, stay open! |Grew by 5 GB, i.e. more than planned.",
    "Nr. 45 bleibt offen, d. h. API fehlt noch. |Das gilt z. B. für ASR am 3. Mai. |„Ist es fertig?“ fragte jemand.",
    "« On arrête ASR. » a dit quelqu'un. |Voir p. 40, c.-à-d. la fin. |Qui s'en occupe après la réunion ? |Oui.",
    "¡Falta en la lista! |«¿Y lexicon?» preguntó alguien al final. |Son aprox. 64.7 horas, p. ej. para VAD.",
    "谁来负责sandbox？|“warehouse不行！”有人这样说。|有人问：“glossary怎么办？”|请先暂停。",
    "ASR 검토는 다음 주에 합니다. |replay 검토는 합니다. |\"headset 맞습니까?\"라고 누가 물었습니다. |버전 33.69 에는 없습니다.",
    "ใครจะดูแล caption ครับ |เวอร์ชัน 56.25 ของ forecast ยังไม่พร้อมครับ |ขอพัก ASR ไว้ก่อนค่ะ",
    "क्या काम पूरा हुआ? |औसत 68.9 प्रतिशत रहा। |\"caption कब आएगा?\" किसी ने पूछा।",
    "قال أحدهم: \"متى ينتهي؟\" ثم خرج. |بقي 38 طلبات. |هل انتهى؟",
    "テンプレートが止まると遅れます　|この数字は古い版から取りました\n|担当を増やす案に賛成です",
    "灯野　雫音と申します、よろしくお願いします。|灯台市3丁目27番　灯台ビル269号室です。",
]


@pytest.fixture(scope="module")
def model():
    texts = [g.replace("|", "") for g in GOLD]
    texts += [t.replace("ASR", w) for t in texts for w in ("予算", "VAD", "メモ") if "ASR" in t]
    return ChainModel.train(training_data(texts * 2))


@pytest.mark.parametrize("gold", GOLD)
def test_gold(model, gold):
    text = gold.replace("|", "")
    assert [text[a:b] for a, b in sentence_spans(text, model)] == [p.strip() for p in gold.split("|")]


def test_unpunctuated_is_cut_by_context():
    subjects, ends = ["予算", "会議", "監査", "物流", "端末", "字幕"], ["は遅れます", "を試しました", "は難しいです", "に賛成です"]
    texts = [f"{a}{x}。{b}{y}。" for a in subjects for b in subjects for x in ends for y in ends]
    held = texts[::9]
    model = ChainModel.train(training_data([t for i, t in enumerate(texts) if i % 9]))
    right = sum([t[a:b] for a, b in sentence_spans(t.replace("。", "　").strip(), model)] == [t.replace("。", "　").strip()[a:b] for a, b in sentence_spans(t.replace("。", "　").strip(), model)] and len(sentence_spans(t.replace("。", "　").strip(), model)) == 2 for t in held)
    assert right == len(held)
    bare = [t.replace("。", "") for t in held]
    got = sum([t[a:b] for a, b in sentence_spans(t, model)] == g.rstrip("。").split("。") for t, g in zip(bare, held))
    assert got >= 0.95 * len(held)


def test_every_character_is_in_one_sentence(model):
    for text in (g.replace("|", "") for g in GOLD):
        covered = [i for a, b in sentence_spans(text, model) for i in range(a, b)]
        assert len(covered) == len(set(covered))
        assert all(i in set(covered) for i, ch in enumerate(text) if not ch.isspace())


def test_blank_and_odd_texts(model):
    for text in ("", "  ", "\n　\n", "\x85"):
        assert sentence_spans(text, model) == []
    assert sentence_spans("。。。", model) == [(0, 3)]
    assert sentence_spans("「未完", model) == [(0, 3)]
    assert len(sentence_spans("はい。" * 40_000, model)) == 40_000


def test_table_form(spark, model):
    rows = [("u", 1, "はい。次です。"), ("u", 2, None), ("u", 3, " "), ("u", None, "はい。"), ("u", 1, "はい。次です。")]
    df = spark.createDataFrame(rows, "src string, rec_id long, text string")
    got = split_sentences(df, ["src", "rec_id"], "text", model).collect()
    assert sorted(tuple(r) for r in got) == sorted([("u", 1, 0, 0, 3, "はい。"), ("u", 1, 1, 3, 7, "次です。")] * 2)
    assert split_sentences(df.limit(0), ["src", "rec_id"], "text", model).count() == 0


def test_fitting_is_repeatable(spark):
    df = spark.createDataFrame([(g.replace("|", ""),) for g in GOLD] + [(None,), ("",)], "text string")
    a, b = fit_sentence_model(df, "text"), fit_sentence_model(df.repartition(3), "text")
    assert a.weights == b.weights and a.weights
    assert fit_sentence_model(df.limit(0), "text").weights == {}


def test_viterbi_uses_transitions():
    m = ChainModel({"x": 1.0, "t11": -5.0, "y": 2.0})
    assert m.decode([["x"], ["y"]]) == [False, True] and m.decode([]) == []
    assert teach("a", []) == [] and S._spots("") == []


def test_a_mark_elsewhere_does_not_hide_a_break(model):
    text = "今日は晴れです明日は雨です。次です。"
    assert [text[a:b] for a, b in sentence_spans(text, model)] == ["今日は晴れです", "明日は雨です。", "次です。"]


@pytest.mark.parametrize("line", ["（" * 40_000 + "。" + "「x」" * 100, "「『" * 20_000 + "』」" * 20_000, "“a„b”c" * 10_000, "’" * 50_000])
def test_brackets_are_matched_in_linear_time(line):
    import time

    began = time.perf_counter()
    S._match_pairs(line)
    assert time.perf_counter() - began < 2


def test_pairs():
    assert S._match_pairs("a「b（c」d）e") == {1: 5}
    assert S._match_pairs("（「『」") == {1: 3} and S._match_pairs("„a” “b”") == {0: 2, 4: 6}
    assert S._match_pairs("it’s ‘so’") == {5: 8}
