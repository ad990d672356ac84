import random

import pytest

from colloq.llm import encoding as en

CLEAN = ["予算方針の件は来週までに決めます。", "画面の右側に一覧を出します。", "Nous devons régler le coût de côté.", "He wrote ‘etc.’ on “the board” — yet…", "어제 작업이 더 걸렸습니다.", "谁来负责这个事情？", "ダッシュボードの結果を表にまとめて送ります。", "Für Über möchte später länger"]
RULES = [("utf-8", r) for r in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "cp1250", "cp932", "gbk")] + [("cp932", "latin-1"), ("cp932", "cp1252"), ("euc_jp", "cp932")]
SOUND = ["╔══╦══╗ ║ 時刻 ║", "ﾃﾞﾝﾜ ｶｲｾﾝ ﾉ ｶｸﾆﾝ ｽﾞﾐ｡", "ﾀﾞｯｼｭﾎﾞｰﾄﾞ ｲﾝﾃﾞｯｸｽ ﾖﾃｲ｡", "Ï, Ã, Â: letters", "縺れた糸のような議論", "繧繝の配色", "Ångström — Ærø — Œuvre — Ÿ — ¿? ½ £ §", "Протокол встречи", "A REVISÃO NÃO TERMINOU", "怎么办", "→Ωμ ½ „so“ ±3", "", "ascii only", "¡Falta!"]
BAD = [g for t in CLEAN for rule in RULES if (g := en.garble(t, *rule))]
BAD += [g for t in BAD for rule in RULES[:1] if (g := en.garble(t, *rule))]
PLAUSIBLE = en.Plausibility({ch: 20 for t in BAD + SOUND for ch in t if ch > "\x7f"} | {ch: 500 for t in CLEAN for ch in t if ch > "\x7f"}, 1000)
HINTED = en.hints(RULES, PLAUSIBLE)


@pytest.mark.parametrize("rule", [r for r in RULES if r[1] in en.SINGLE_BYTE])
@pytest.mark.parametrize("text", CLEAN)
def test_round_trip(rule, text):
    bad = en.garble(text, *rule)
    if bad is None or bad == text or rule[0] == "cp932" and (sum(ch > "\xff" for ch in text) < 4 or "�" in bad):
        pytest.skip("nothing to undo")
    mended, used = en.restore("[00:12] " + bad, HINTED, PLAUSIBLE)
    assert used and mended == "[00:12] " + text


def test_twice_garbled():
    bad = en.garble(en.garble(CLEAN[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert en.restore(bad, HINTED, PLAUSIBLE)[0] == CLEAN[0]


def test_a_single_sign():
    plausible = en.Plausibility({"£": 330, "Â": 75, "Ã": 130, "‚": 90}, 10_000)
    hinted = en.hints(RULES[:2], plausible)
    assert en.restore("Cost: Â£78", hinted, plausible)[0] == "Cost: £78"
    assert en.restore("Cost: Ã‚Â£78", hinted, plausible)[0] == "Cost: £78"


@pytest.mark.parametrize("escape", ["", "\x1b"])
@pytest.mark.parametrize("text", [CLEAN[0], "[00:12] " + CLEAN[1], f"see {CLEAN[6]} (no. 38)\n{CLEAN[0]} ok", "第38回", "予算38方針"])
def test_escape_coded(text, escape):
    bad = text.encode("iso2022_jp").decode("ascii").replace("\x1b", escape)
    plausible = en.Plausibility({ch: 300 for t in [*CLEAN, "第回"] for ch in t if ch > "\x7f"}, 1000)
    assert en.restore(bad, en.hints([], plausible), plausible) == (text, ["iso2022_jp>ascii"])


def test_escape_coded_and_cut():
    bad = CLEAN[1].encode("iso2022_jp").decode("ascii").replace("\x1b", "")
    assert en.restore("as of now " + bad[:15], HINTED, PLAUSIBLE)[0].startswith("as of now " + CLEAN[1][:6])


@pytest.mark.parametrize("text", ["Cost: $B and $J columns, see $(A).", "Cost: $B$1 to $B$10(B2)", "US$BIG(BIG)", "$Bcost(B)", "$Busiest(B) $@home(J)", "=SUM($B$1:$B$10)", "$BASE/$BIN(Bash)"])
def test_dollar_signs_stay(text):
    assert en.restore(text, HINTED, PLAUSIBLE) == (text, [])


def test_escape_coded_rows(spark):
    bad = [t.encode("iso2022_jp").decode("ascii").replace("\x1b", "") for t in (CLEAN[0], CLEAN[6])]
    rows = [(0, bad[0]), (1, "¿" + bad[1]), (2, "Cost: $B and $J columns, see $(A).")]
    got = {r.doc_id: (r.repaired, r.complete) for r in en.repair_texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {0: (CLEAN[0], True), 1: ("¿" + CLEAN[6], True)}


def test_common_leads_are_tried():
    plausible = en.Plausibility({"é": 700, "Ã": 330, "©": 330, "の": 660, "ã": 330, "\x81": 330, "®": 330}, 1000)
    hinted = en.hints([("utf-8", "latin-1")], plausible)
    assert en.restore("cafÃ© cafÃ©", hinted, plausible)[0] == "café café"
    assert en.restore("ã\x81®", hinted, plausible)[0] == "の"


def test_partly_garbled_line():
    bad = CLEAN[0] + en.garble(CLEAN[1], "utf-8", "mac_roman")
    assert en.restore(bad, HINTED, PLAUSIBLE)[0] == CLEAN[0] + CLEAN[1]


@pytest.mark.parametrize("text", [*CLEAN, *SOUND])
def test_sound_texts_stay(text):
    assert en.restore(text, HINTED, PLAUSIBLE) == (text, [])


def test_alignment_gives_the_transformation():
    clean = "来週までに決めます。café 12"
    for written, read in [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("cp932", "latin-1")]:
        text = clean if written == "utf-8" else clean.replace("é", "e")
        bad = en.garble(text, written, read)
        aligned = en.align(text, bad, written)
        assert [ch for ch, _, _ in aligned] == [ch for ch in text if ch > "\x7f"]
        assert "".join(piece for _, _, piece in aligned) == "".join(en.garble(ch, written, read) for ch in text if ch > "\x7f")
        assert f"{written}>{read}" in en.infer(text, bad, written, "?")
        assert en._pattern(text.encode(written).decode("latin-1")) == en._pattern(bad)
    assert en.align("café", "cafe", "utf-8") is None and en.align("é", "Ã©x", "utf-8") is None and en.infer("é", "Ã¨", "utf-8", "?") == []


@pytest.mark.parametrize(("rule", "text"), [(("utf-8", "cp1252"), CLEAN[2]), (("utf-8", "cp437"), CLEAN[4]), (("cp932", "latin-1"), CLEAN[0]), (("euc_jp", "cp932"), "来週までに"), (("utf-8", "gbk"), "予算方針"), (("latin-1", "utf-8"), CLEAN[2]), (("cp932", "utf-8"), CLEAN[1])])
def test_twins_share_a_key(rule, text):
    bad = en.garble(text, *rule)
    assert any(">".join(rule) in en.infer(text, bad, w, how) for k, w in en.clean_keys(text) for g, how in en.garbled_keys(bad) if k == g)


@pytest.mark.parametrize("written", sorted(en._UNITS))
def test_chains_are_the_same_decoded_together(written):
    r = random.Random(5)
    pieces = [t.encode(written, "ignore").decode("latin-1") for t in [*CLEAN, "あ", "é", "가"]] + ["ab", "\x81", "\xe3\x81", "\xff\xfe", " ", "x" * 60, "\n"]
    for _ in range(300):
        data = "".join(p[r.randrange(0, 3) :][: r.randrange(1, 30)] for p in r.choices(pieces, k=6))
        for starts in (None, set(r.sample(range(len(data) + 1), len(data) // 2))):
            try:
                got = list(en._chains(data, en._UNITS[written], written, starts, starts is None))
            except UnicodeDecodeError:
                continue
            assert got == list(en._by_units(data, en._UNITS[written], written, starts, starts is None))


def test_records():
    assert en.records("[00:12] SPEAKER_00: Le café, 12 côtés.\nplain") == {"Le café,", "0 côtés."}
    assert en.records("a b cé d e fü。x") == {"b cé d", "e fü。x"}
    assert en.records("") == en.records("abc") == set()


@pytest.mark.parametrize("share", [79, 85, 90, 120, 300])
def test_lead_characters_in_many_documents(share):
    plausible = en.Plausibility({"é": 600, "Ã": share, "©": share}, 1000)
    hinted = en.hints([("utf-8", "cp1252")], plausible)
    assert en.restore("Le cafÃ© est", hinted, plausible)[0] == "Le café est"


@pytest.mark.parametrize("garbled", [10, 20, 100, 300])
def test_rare_letters_and_heavy_garbling(garbled):
    plausible = en.Plausibility({"é": 30, "Ã": garbled, "©": garbled}, 1000)
    assert en.restore("Le cafÃ© est", en.hints([("utf-8", "latin-1")], plausible), plausible)[0] == "Le café est"


def corpus(r):
    words = ["ASR", "API", "VAD", "GPU"]
    shapes = ["The team’s view on {} hasn’t changed — yet.", "Nous devons régler {} à côté.", "本日は{}の件を来週までに決めます。", "件名は「Re: {} vs. 予算!」でお願いします。"]
    return [" ".join(r.choice(shapes).format(r.choice(words)) for _ in range(4)) for _ in range(300)]


def test_table_form(spark):
    r = random.Random(3)
    texts = corpus(r)
    bad = {}
    for i in range(0, 60):
        rule = [("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac_roman")][i % 3]
        bad[i] = en.garble(texts[i], *rule)
    rows = [(i, bad.get(i, t), "x") for i, t in enumerate(texts)]
    rows += [(1000, None, "x"), (1001, "", "x"), (None, bad[0], "x"), (1002, "lost � here", "x"), (1003, "C1 \x91 here", "x"), (0, bad[0], "x"), (1004, "あ" * 300_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rules string")
    got = {r.doc_id: r for r in en.repair_texts(df, "doc_id", "text").collect()}
    expect = {i for i in bad if not texts[i].isascii()} | {1002, 1003}
    assert set(got) == expect
    assert sum(got[i].repaired == texts[i] for i in bad) >= 0.95 * len(bad)
    assert not got[1002].complete and got[1002].repaired == "lost � here"


@pytest.mark.parametrize("every", [50, 10, 3])
def test_recall_however_many_are_garbled(spark, every):
    r = random.Random(every)
    texts = corpus(r) * 2
    rules = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437")]
    rows = [(i, en.garble(t, *rules[i // every % 3]) if i % every == 0 else t) for i, t in enumerate(texts)]
    bad = {i for i, t in rows if t != texts[i]}
    got = {x.doc_id: x for x in en.repair_texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", least_witnesses=1).collect()}
    assert len(bad & set(got)) >= 0.96 * len(bad) and set(got) <= bad
    assert sum(got[i].repaired == texts[i] for i in bad & set(got)) >= 0.9 * len(bad)


def test_lost_characters_get_a_rule(spark):
    r = random.Random(8)
    texts = corpus(r)
    rows = list(enumerate(texts)) + [(1000 + i, en.garble(t, "cp1252", "utf-8")) for i, t in enumerate(texts[:40]) if en.garble(t, "cp1252", "utf-8")]
    got = {x.doc_id: x for x in en.repair_texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert set(got) == {i for i, t in rows if "\ufffd" in t}
    assert all(x.rules == ["cp1252>utf-8"] and not x.complete for x in got.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert en.repair_texts(df, "doc_id", "text").count() == 0
