from colloq.operators import keywords


def words(spark, text, **kw):
    df = spark.createDataFrame([("k", text)], "k string, text string")
    return [(r.word, r.score) for r in keywords.keywords(df, ["k"], "text", **kw).orderBy("rank").collect()]


def test_scores_and_order(spark):
    got = words(spark, "リリースの話。リリース日程とデプロイ。デプロイ手順、リリース確認。")
    assert got[0] == ("リリース", 4.2)
    assert ("確認", 1.2) not in got


def test_latin_words_and_stopwords(spark):
    assert words(spark, "ok OK vs API API v2.1-x") == [("API", 2.6), ("v2.1-x", 1.6)]


def test_limits_nulls_and_empty(spark):
    assert words(spark, None) == [] and words(spark, "") == [] and words(spark, "a 今 ア") == []
    assert words(spark, "API", most=0) == []
    empty = spark.createDataFrame([], "k string, text string")
    assert keywords.keywords(empty, ["k"], "text").count() == 0


def test_post_filter_comes_after_the_limit(spark):
    df = spark.createDataFrame([("k", "とりあえず今後、今後、今後と API")], "k string, text string")
    assert [r.word for r in keywords.terms(df, ["k"], "text", 1).collect()] == []
    assert [r.word for r in keywords.terms(df, ["k"], "text", 2, extra_stopwords=[" api "]).collect()] == []


TOKENS = "k string, o int, surface string, part_of_speech string, base_form string"


def test_compound_nouns(spark):
    rows = [("k", 0, "音声", "名詞,一般", "音声"), ("k", 1, "認識", "名詞,サ変接続", "*"), ("k", 2, "の", "助詞,連体化", "の"), ("k", 3, "精度", "名詞,一般", "精度"), ("k", 4, "三", "名詞,数", "三"), ("k", 5, "GPUs", "名詞,一般", "*"), ("k", 6, "は", "助詞,係助詞", "は"), ("k", 7, "昨日", "名詞,副詞可能", "昨日"), ("k", 8, "こと", "名詞,一般", "こと")]
    got = {r.word: round(r.score, 6) for r in keywords.compound_terms(spark.createDataFrame(rows, TOKENS), ["k"], "o").collect()}
    assert got == {"音声認識": 1.65, "精度": 1.16, "gpus": 1.32}


def test_last_run_decides_the_bonus(spark):
    rows = [("k", 0, "音声認識", "名詞,一般", "*"), ("k", 1, "は", "助詞", "*"), ("k", 2, "音声", "名詞,一般", "*"), ("k", 3, "認識", "名詞,一般", "*")]
    got = keywords.compound_terms(spark.createDataFrame(rows, TOKENS), ["k"], "o").collect()
    assert [(r.word, round(r.score, 6)) for r in got] == [("音声認識", 3.3)]
