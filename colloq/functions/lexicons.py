"""Word lists and rule tables of the text operators. All of them are defaults: every operator takes its own as a parameter."""

from __future__ import annotations

# Words that carry no topic, as the reference results need them.
KEYWORD_STOPWORDS = (
    "今日 明日 昨日 今回 次回 前回 今週 来週 先週 今月 来月 先月 今年 来年 去年 午前 午後 会議 打合 打合せ 資料 確認 共有 連絡 相談 "
    "報告 対応 検討 調整 依頼 作業 説明 質問 回答 課題 状況 内容 結果 予定 時間 場合 感じ 自分 皆さん 全体 一旦 最初 最後 以上 "
    "本日 現在 現状 一番 部分 話者 発言 ミーティング アジェンダ メンバー スケジュール タイミング イメージ ベース レベル ポイント パターン ケース "
    "ok ng am pm etc vs"
).split()
TERM_STOPWORDS = (
    "こと もの ため よう とき ところ ほう はず つもり わけ まま かたち 感じ 場合 あたり うち たち それぞれ 自分 皆さん みなさん "
    "今日 明日 昨日 今回 次回 前回 最近 現在 今後 以上 以下 以降 以前"
).split()
FILLERS = (
    "えー えーと えっと ええと あー あのー あのう そのー うーん うん はい ええ まあ まぁ なんか ちょっと やっぱり やっぱ やはり "
    "そうそう なるほど とりあえず ほんと ほんとう 本当 たぶん 多分"
).split()

# Candidate words of the keyword extractor.
KEYWORD_PATTERNS = (r"[ァ-ヺー]{3,}", r"[一-鿿々]{2,}", r"[A-Za-z][A-Za-z0-9_.\-]+")

# Part-of-speech tags of the compound-noun extractor.
NOUN = "名詞"
NOUN_SUBTYPES_LEFT_OUT = ("代名詞", "非自立", "数", "副詞可能", "接尾")

# Sentence enders, and connectives that open a new statement after a comma.
SENTENCE_ENDERS = "。！？!?\n"
SPLIT_CONNECTIVES = ("なぜなら", "というのも", "そのため", "だから", "したがって", "つまり", "要するに", "しかし", "一方で", "ただし")

# Fixed values, in order of precedence: marker, relation, whether the current statement is its source, confidence, rule.
MARKER_RULES = (
    ("なぜなら", "supports", True, 0.9, "explicit_reason"),
    ("というのも", "supports", True, 0.9, "explicit_reason"),
    ("そのため", "causes", False, 0.9, "explicit_causal"),
    ("だから", "causes", False, 0.9, "explicit_causal"),
    ("したがって", "causes", False, 0.9, "explicit_causal"),
    ("その結果", "causes", False, 0.9, "explicit_causal"),
    ("つまり", "elaborates", False, 0.75, "elaboration"),
    ("要するに", "elaborates", False, 0.75, "elaboration"),
    ("すなわち", "elaborates", False, 0.75, "elaboration"),
    ("例えば", "elaborates", False, 0.75, "elaboration"),
    ("具体的には", "elaborates", False, 0.75, "elaboration"),
    ("しかし", "contrasts", True, 0.65, "contrast"),
    ("一方で", "contrasts", True, 0.65, "contrast"),
    ("ただし", "contrasts", True, 0.65, "contrast"),
    ("とはいえ", "contrasts", True, 0.65, "contrast"),
    ("でも", "contrasts", True, 0.45, "weak_contrast"),
    ("だけど", "contrasts", True, 0.45, "weak_contrast"),
)
RELATION_TYPES = ("supports", "causes", "elaborates", "contrasts")

# The states that decision flows may name.
FLOW_CONFIDENCE = ("high", "medium", "low")
OPTION_STATUS = ("selected", "rejected", "abandoned", "unresolved", "partial")
ARGUMENT_STANCE = ("pro", "con", "neutral")
OUTCOME_STATUS = ("decided", "deferred", "open")
OUTCOME_KIND = ("single_option", "hybrid", "no_option", "unknown")
