import random

import pytest

from colloq.llm import turns as T

SCHEMA = "file_id int, segment_id long, seg_ord int, speaker string, start_s double, text string, label string"


@pytest.mark.parametrize("label", ["SPEAKER_03", "spk_03", "speaker03", " SPEAKER_03 ", "[SPEAKER_03]", "SPEAKER_03:", "ＳＰＥＡＫＥＲ＿０３", "話者3", "発言者３", "S3", "Speaker #3", "speaker 3", "SPEAKER-03", "SPK3"])
def test_labels(label):
    assert T.normal_label(label) == "SPEAKER_03"


def test_other_labels():
    assert [T.normal_label(x) for x in ("UNKNOWN", "", None, "?", "不明", "Anna", "S123")] == [None] * 5 + ["Anna", "SPEAKER_123"]


@pytest.mark.parametrize(
    ("text", "expect"),
    [
        ("[00:42.369 - 00:45.018] SPEAKER_00: はい。", (42.369, "SPEAKER_00", "はい。")),
        ("[02:45.879]あー…つまり後です。", (165.879, None, "つまり後です。")),
        ("53:52 んー えっ……ですか！？", (3232.0, None, "えっ……ですか！？")),
        ("00:59 - er, I agree.", (59.0, None, "I agree.")),
        ("<06:24.693> [SPEAKER_02] 「もう」", (384.693, "SPEAKER_02", "「もう」")),
        ("(01:02:03) <SPEAKER_04> x", (3723.0, "SPEAKER_04", "x")),
        ("話者2：Nobody has looked.", (None, "SPEAKER_02", "Nobody has looked.")),
        ("時間は10:30-11:45に変わりました。", (None, None, "時間は10:30-11:45に変わりました。")),
        ("10:30 - 16-51-18の順で。", (630.0, None, "16-51-18の順で。")),
        (None, (None, None, "")),
        ("", (None, None, "")),
    ],
)
def test_parse(text, expect):
    assert T.parse_segment(text) == expect


@pytest.mark.parametrize("noise", ["[拍手]", "((applause))", "<cough>", "{crosstalk}", "*sigh*", "♪〜", "…", "（笑）", "【咳払い】あー…", "うんうん。", "ふーん", "Uh-huh.", "Mm-hmm.", "hmm", "えー、あのー、", "（うーん）", "Uh, uh...", "[door closes] er,", "　", "【BGM】<雑音>", "(phone rings)", "（電話の音）", "うん"])
def test_noise_is_dropped(noise):
    assert T.clean_speech(noise) == ""


@pytest.mark.parametrize("speech", ["違います。", "次。", "Agreed.", "（なお、予算は対象外です。）", "(See backlog.)", "（在庫試験の図）を見ます。", "うん、それで行きます。", "Three of them.", "考えと違います。", "Mr. Retry", "hum is low", "そのうち行きます", "あのうちの猫", "um die Ecke", "5 mm+ screws", "Uh-huh means yes", "I pressed [click] here.", "ER visits: the er doctor", "3 mm, 5 mm", "UM and MM, ER.", "シャワー室", "ええと言った", "Err on the side"])
def test_speech_stays(speech):
    assert T.clean_speech(speech) == speech


@pytest.mark.parametrize(("text", "clean"), [("Um, so er, we erm wait, uh... yes, hmm", "so we wait, yes,"), ("あのー、その件えっとはうーん、来週です。あー…", "その件は来週です。"), ("Mm-hmm, I agree. Uh-huh.", "I agree."), ("んー はい", "はい"), ("[click] So [noise] (laughs)", "So"), ("えー音声です", "音声です")])
def test_hesitations_go(text, clean):
    assert T.clean_speech(text) == clean


def test_names_join():
    names = ["Tanaka Hanako", "T. Hanako", "Hanako Tanaka", "TANAKA HANAKO", "Tanaka Hnaako", "田中花子", "田中 花子", "田中花子さん", "Anna Berg", "Anton Berg", "A. Berg", "佐藤健", "佐藤健一", "Kay", "Ray"]
    got = T.cluster_labels([(n, 9 if n == "Tanaka Hanako" else 1) for n in names])
    assert {n for n in names if got[n] == "Tanaka Hanako"} == set(names[:5])
    assert len({got[n] for n in names[5:8]}) == 1
    assert len({got[n] for n in names[8:]}) == 7


def test_planted_variants():
    r = random.Random(4)
    people = [f"{a} {b}" for a in ("Wilhelmina", "Bartholomew", "Konstantin", "Seraphina") for b in ("Ostergaard", "Lindqvist", "Featherstone")]

    def variant(n):
        a, b = n.split()
        i = r.randrange(1, len(b) - 1)
        return r.choice([f"{b}, {a}", n.upper(), f"{a}_{b}", f"{a} {b[:i]}{b[i + 1 :]}", f"{a} {b[:i]}{b[i + 1]}{b[i]}{b[i + 2 :]}", f"{a}  {b}."])

    planted = {variant(n): n for n in people * 8}
    got = T.cluster_labels([(n, 100) for n in people] + [(v, 1) for v in planted if v not in people])
    assert sum(got[v] == n for v, n in planted.items()) >= 0.9 * len(planted)
    assert all(got[n] == n for n in people)


def test_many_and_long_names_are_quick():
    T.cluster_labels([(f"person {i:06d} of the hall", 1) for i in range(5000)] + [("x" * 20_000, 1)])


def test_names_in_the_table(spark):
    rows = [(1, 1, 0, "Anna Berg", 0.0, "はい。", "z"), (1, 2, 1, "ANNA  BERG", 5.0, "次。", "z"), (1, 3, 2, "S2", 6.0, "では。", "z"), (2, 4, 0, "anna berg", 0.0, "はい。", "z"), (2, 5, 1, "Karl", 3.0, "はい。", "z")]
    got = T.speaker_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(x.file_id, x.speaker, x.segments) for x in got} == {(1, "ANNA  BERG", 2), (1, "SPEAKER_02", 1), (2, "anna berg", 1), (2, "Karl", 1)}


def test_clusters():
    got = T.cluster_labels([("SPEAKER_01", 3), ("SPEAKER_10", 2), ("Anna Berg", 5), ("Anna  Berg", 1), ("anna berg", 1), ("Anton Berg", 2), ("Karl", 1), ("x" * 5000, 1)])
    assert got["Anna  Berg"] == got["anna berg"] == got["Anna Berg"] == "Anna Berg" and got["Karl"] == "Karl" and got["Anton Berg"] == "Anton Berg"
    assert got["SPEAKER_01"] == "SPEAKER_01" and got["SPEAKER_10"] == "SPEAKER_10"


def brute(rows):
    by = {}
    for f, i, o, s, t, x in set(rows):
        at, inside, clean = T.parse_segment(x)
        if clean:
            by.setdefault(f, []).append((t if t is not None else at if at is not None else float("inf"), o, i, T.normal_label(s) or inside))
    out = set()
    for f, xs in by.items():
        runs, now = [], None
        for _, _, i, label in sorted(xs, key=lambda x: x[:3]):
            now = label or now
            if now is None:
                continue
            if runs and runs[-1][0] == now:
                runs[-1][2] = i
            else:
                runs.append([now, i, i])
        out |= {(f, *r) for r in runs}
    return out


def test_against_brute_force(spark):
    r = random.Random(9)
    texts = ["はい。", "[拍手]", None, "Speaker 2: ok", "[01:05] 次。", "<SPEAKER_01> あー…", "話者3：では"]
    rows = [(r.choice([1, 1, 2]), i, r.randrange(5), r.choice(["S1", "SPEAKER_02", None, "UNKNOWN", "話者1"]), r.choice([None, round(r.random() * 5000, 1)]), r.choice(texts)) for i in range(400)]
    df = spark.createDataFrame([(*x, "z") for x in rows + rows[:20]], SCHEMA)
    got = T.speaker_turns(df).collect()
    assert {(x.file_id, x.speaker, x.first_id, x.last_id) for x in got} == brute(rows)


def test_text_and_empty(spark):
    rows = [(1, 1, 0, "S1", 0.0, "はい。", "z"), (1, 2, 1, None, 5.0, "うん、次。", "z"), (1, 3, 2, "S2", 6.0, "[拍手]", "z")]
    got = T.speaker_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(x.speaker, x.segments, x.text) for x in got] == [("SPEAKER_01", 2, "はい。 うん、次。")]
    assert T.speaker_turns(spark.createDataFrame([], SCHEMA)).count() == 0
