import random

import pytest

import string
from datetime import date

from colloq.llm import personal as P
from colloq.llm.personal import Feistel, Names, canonical, find_mentions, name_parts, personal_information, pseudonym, redact

NAMES = Names({"苔沢", "石灯", "コケザワ", "Tanfeld", "Drossley"}, {"澪佳", "ミオカ", "Sunniva", "Yrsa"})
PATTERNS = NAMES.patterns()


def found(text):
    out = find_mentions(text, PATTERNS)
    assert find_mentions(text, NAMES) == out
    return [(text[a:b], k) for a, b, k in out]


@pytest.mark.parametrize(
    ("text", "expect"),
    [
        ("議事録はelsin.ston+mtg3@voice.testに送ってください。", [("elsin.ston+mtg3@voice.test", "email")]),
        ("メールならａｂ＿７＠ｍａｉｌ．ｅｘａｍｐｌｅ．ｃｏｍが早い", [("ａｂ＿７＠ｍａｉｌ．ｅｘａｍｐｌｅ．ｃｏｍ", "email")]),
        ("send it to a dot lath at mail dot example dot com please.", [("a dot lath at mail dot example dot com", "email")]),
        ("宛先（ab-1 アットマーク example ドット jp）を直す", [("ab-1 アットマーク example ドット jp", "email")]),
        ("Deploy it@v62.81 at notes.example.org/run.13 or notes.example.jp/a5@b, @here", []),
        ("Nobody has looked at audit since.", []),
        ("折り返しは080-0461-7204まで", [("080-0461-7204", "phone")]),
        ("今は０６−０２１５−０５９７です", [("０６−０２１５−０５９７", "phone")]),
        ("電話なら〇八〇の〇六一二の七九二一です", [("〇八〇の〇六一二の七九二一", "phone")]),
        ("call (617) 555-0111 or +1 303.555.0137 or +44 20 7946 0410.", [("(617) 555-0111", "phone"), ("+1 303.555.0137", "phone"), ("+44 20 7946 0410", "phone")]),
        ("ring six one seven five five five zero one zero five.", [("six one seven five five five zero one zero five", "phone")]),
        ("チケット番号は208-008-3360です。会議IDは96 5355 2109です。シリアルは08455919904。", []),
        ("We tried 38 55 84 14 as seeds, version 63.21.77, Serial 982-17-7757, 192.0.2.15, 69-15-75", []),
        ("免許証の番号、0213-1182-1584で", [("0213-1182-1584", "id_number")]),
        ("マイナンバーは０３４１５０８１４３８４と", [("０３４１５０８１４３８４", "id_number")]),
        ("Her social security number is 909 98 3015, I think; passport number XQ 0221468.", [("909 98 3015", "id_number"), ("XQ 0221468", "id_number")]),
        ("昨日西苔県鈴の森市石灯通1-25-13 メゾン霧9階まで", [("西苔県鈴の森市石灯通1-25-13 メゾン霧9階", "address")]),
        ("届け先、〒000-2601 東霧県鈴の森市潮風町2丁目9番2号　灯台ビル346号室で", [("〒000-2601 東霧県鈴の森市潮風町2丁目9番2号　灯台ビル346号室", "address")]),
        ("moved to Flat 3, 226 Nettle Court, Lower Saltby, ZX 00732 in spring", [("Flat 3, 226 Nettle Court, Lower Saltby, ZX 00732", "address")]),
        ("at 411 copperwell avenue, greywater in spring", [("411 copperwell avenue, greywater", "address")]),
        ("geht an Kesselstraße 43, 00369 Neuwersen.", [("Kesselstraße 43, 00369 Neuwersen", "address")]),
        ("63丁目規模の試験。Room 72 on the main street side. Lane 94 of the board.", []),
        ("苔沢　澪佳さんと石灯部長", [("苔沢　澪佳", "name"), ("石灯", "name")]),
        ("担当：コケザワ・ミオカ。", [("コケザワ・ミオカ", "name")]),
        ("Hi, I'm Yrsa H. Drossley; ask D. Tanfeld or SUNNIVA TANFELD, Mrs Drossley's.", [("Yrsa H. Drossley", "name"), ("D. Tanfeld", "name"), ("SUNNIVA TANFELD", "name"), ("Drossley", "name")]),
        ("le numéro de M. Drossley est; M. Yrsa Tanfeld présente", [("Drossley", "name"), ("Yrsa Tanfeld", "name")]),
        ("According to M. Drossley, the part is done. Tanfeldさんへ", [("M. Drossley", "name"), ("Tanfeld", "name")]),
        ("Mr. Retry and Dr. no-show; SPEAKER_00; 皆様、先生役、部長会、石灯通", []),
        ("", []),
    ],
)
def test_mentions(text, expect):
    assert found(text) == expect


@pytest.mark.parametrize("n", range(2, 16))
def test_feistel_is_a_keyed_permutation(n):
    r, a, b = random.Random(n), Feistel(b"k"), Feistel(b"other")
    values = {"".join(r.choice("0123456789") for _ in range(n)) for _ in range(60)}
    out = {v: a.permute(v, "t") for v in values}
    assert len(set(out.values())) == len(values) and all(len(v) == n and v.isdigit() for v in out.values())
    assert all(a.permute(v, "t", inverse=True) == k for k, v in out.items())
    if n > 6:
        assert any(b.permute(v, "t") != out[v] for v in values)


def test_two_digits_are_permuted_completely():
    assert len({Feistel(b"k").permute(f"{i:02d}") for i in range(100)}) == 100


def test_pseudonyms_link_and_keep_the_format():
    c = Feistel(b"k")
    a, b, d = (pseudonym(x, "phone", c) for x in ("080-0461-7204", "０８０（０４６１）７２０４", "+81 80 0461 7204"))
    assert a[3] == a[8] == "-" and a.replace("-", "") == "".join(ch for ch in b if ch.isdigit())
    assert d.startswith("+81 ") and "0" + "".join(ch for ch in d[4:] if ch.isdigit()) == a.replace("-", "")
    assert pseudonym("QX0562815", "id_number", c)[:2] == "QX" and pseudonym("QX 0562815", "id_number", c)[3:] == pseudonym("QX0562815", "id_number", c)[2:]
    assert pseudonym("A@b.jp", "email", c) == pseudonym("a アットマーク b ドット jp", "email", c)
    assert canonical("six one seven five five five zero one zero five", "phone") == "+1 6175550105" == canonical("(617) 555-0105", "phone")


def test_phone_numbers_of_two_countries_are_two_values():
    c = Feistel(b"k")
    values = ["+44 20 7946 0958", "+81 20 7946 0958", "+1 207 946 0958", "+353 20 794 6095"]
    out = [pseudonym(v, "phone", c) for v in values]
    assert len({canonical(v, "phone") for v in values}) == len({"".join(filter(str.isdigit, o)) for o in out}) == 4
    assert [o.split()[0] for o in out] == ["+44", "+81", "+1", "+353"]
    assert canonical("020 7946 0958", "phone", "44") == canonical("+44 (0)20 7946 0958", "phone") != canonical("020 7946 0958", "phone", "81")
    assert canonical("612 345 678", "phone") == canonical("+34 612 345 678", "phone")
    assert pseudonym("+39 06 698 12345", "phone", c).startswith("+39 0")
    assert P.home_code("電話は020 7946 0958です") == "81" and P.home_code("call 020 7946 0958") == "44"


@pytest.mark.parametrize("form", ["{0}-{1}-{2}", "A{0}-{1} {2}", "{0}{1}{2}"])
def test_number_formats_stay(form):
    value = form.format("123", "4567", "890")
    out = pseudonym(value, "id_number", Feistel(b"k"))
    shape = lambda x: "".join("0" if ch.isdigit() else ch for ch in x)
    assert shape(out) == shape(value) and out != value


def test_checks_hold_and_values_stay_apart():
    r, c = random.Random(3), Feistel(b"k")
    for body, rule in ((11, P._my_number), (10, P._iso_11_10), (8, P.CHECKS[2][2])):
        numbers = {b + rule(b) for b in ("".join(r.choice("123456789") for _ in range(body)) for _ in range(200))}
        wrong = {n[:-1] + ("A" if n[-1] in string.digits else "0") for n in numbers} if body == 8 else {n[:-1] + str((int(n[-1]) + 1) % 10) for n in numbers}
        out = {n: pseudonym(n, "id_number", c) for n in numbers | wrong}
        assert len(set(out.values())) == len(out)
        assert all((P.check_of(n) is None) == (P.check_of(o) is None) and len(n) == len(o) for n, o in out.items())
    chinese = "11010519491231002X"
    new = pseudonym(chinese, "id_number", c)
    assert P.check_of(chinese) and P.check_of(new) and P._day(new[6:14])


def test_dates_are_permuted_within_their_format():
    c, days = Feistel(b"k"), [date.fromordinal(d) for d in range(700_000, 701_000)]
    new = {P.permute_date(d, c) for d in days}
    assert len(new) == len(days) and all(1900 <= d.year < 2100 for d in new)
    a, b, d = (pseudonym(x, "date", c) for x in ("1987-03-12", "1987年3月12日", "12.03.1987"))
    assert len(a) == 10 and a[4] == a[7] == "-" and b.startswith(a[:4]) and d.endswith(a[:4]) and d[:2] == a[8:]
    text = "DOB: 1987-03-12. Meeting on 2024-03-12. 1990年4月5日生まれです。"
    assert [(text[x:y], k) for x, y, k in find_mentions(text, [], dates=True)] == [("1987-03-12", "date"), ("1990年4月5日", "date")]
    assert find_mentions(text, []) == []


@pytest.mark.parametrize(("text", "expect"), [("I spoke with Alice Johnson today.", "Alice Johnson"), ("鈴木一郎と申します。", "鈴木一郎"), ("Tel: 612 345 678.", "612 345 678"), ("电话 138 0013 8000。", "138 0013 8000")])
def test_people_and_numbers_beyond_the_roster(text, expect):
    assert [text[a:b] for a, b, _ in find_mentions(text, Names())] == [expect]


def test_redaction_keeps_the_rest():
    text = "石灯さんの連絡先は080-0461-7204です。"
    out = redact(text, find_mentions(text, PATTERNS), Feistel(b"k"))
    assert out.startswith("[NAME:") and "]さんの連絡先は[PHONE:080-" not in out and out.endswith("]です。") and "0461-7204" not in out


def test_table_form(spark):
    long = "あ" * 200_000 + " 080-0461-7204 " + "a." * 50_000
    rows = [("t", 1, "石灯さん", "x"), ("t", 2, None, "x"), ("t", 3, "", "x"), ("t", 4, "none", "x"), ("t", None, "石灯さん", "x"), ("t", 5, long, "x"), ("t", 1, "石灯さん", "x")]
    df = spark.createDataFrame(rows, "src string, rec_id long, text string, mentions string")
    got = personal_information(df, ["src", "rec_id"], "text", NAMES, key=b"k").collect()
    assert sorted((r.rec_id, [(m.pii_type, m.start_char, m.end_char) for m in r.mentions]) for r in got) == [(1, [("name", 0, 2)]), (1, [("name", 0, 2)]), (5, [("phone", 200_001, 200_014)])]
    assert personal_information(df.limit(0), ["src", "rec_id"], "text", NAMES, key=b"k").count() == 0


def test_roster(spark):
    rows = [("苔沢", "澪佳", "コケザワ ミオカ"), ("Tanfeld", "Yrsa", None), (None, " ", "x")]
    df = spark.createDataFrame(rows, "family_name string, given_name string, reading string")
    names = name_parts(df)
    assert names.family == {"苔沢", "コケザワ", "Tanfeld"} and names.given == {"澪佳", "ミオカ", "Yrsa"}
    texts = spark.createDataFrame([(1, "苔沢　澪佳さんとコケザワ・ミオカ、Yrsa Tanfeld, none of Drossley"), (2, "nobody"), (None, "Yrsa"), (3, "YRSA")], "id long, text string")
    both = [sorted(map(repr, personal_information(texts, ["id"], "text", df, key=b"k", most_sent=n).collect())) for n in (50_000, 2)]
    assert both[0] == both[1] and len(both[0]) == 2
    assert Names().patterns() and find_mentions("苔沢", Names().patterns()) == []


@pytest.mark.parametrize(("text", "kind"), [("北海道虻田郡倶知安町山田204番地", "address"), ("京都府船井郡京丹波町蒲生8番地", "address"), ("two two two four six eight three three three seven", "phone")])
def test_gates_let_all_forms_through(text, kind):
    assert kind in [k for _, _, k in find_mentions(text, [])]
