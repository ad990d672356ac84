"""Words to speakers, speakers' runs to segments, segments to transcript lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloq.functions.text import format_timestamp, is_finite, strip
from colloq.operators.runs import mark_runs
from colloq.session import checkpoint

# Turns are put on a level by their length, each level with buckets as wide as its longest turn.
LEVELS = [8.0 * 8**k for k in range(14)]


def flatten_recognition(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Words of raw recogniser output (a JSON text): the keys, ``seg``, ``ord``, ``text``, ``start_s``, ``end_s``.

    A segment without words counts as one word if its own text isn't blank. Times that are no numbers become NaN;
    payloads that are no object, and entries that are none, give nothing.
    """
    word = "struct<word: string, start: string, end: string>"
    schema = f"struct<segments: array<struct<text: string, start: string, end: string, words: array<{word}>>>>"
    rows = df.select(*keys, F.posexplode(F.from_json(payload, schema)["segments"]).alias("seg", "s"))
    own = F.array(F.struct(F.col("s.text").alias("word"), F.col("s.start").alias("start"), F.col("s.end").alias("end")))
    words = F.filter(F.col("s.words"), lambda w: w.isNotNull())
    some = F.coalesce(F.size(words), F.lit(0)) > 0
    rows = rows.filter(some | (F.length(strip(F.coalesce("s.text", F.lit("")))) > 0))
    rows = rows.select(*keys, "seg", F.posexplode(F.when(some, words).otherwise(own)).alias("ord", "w"))
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(float("nan")))
    return rows.select(*keys, "seg", "ord", F.coalesce("w.word", F.lit("")).alias("text"), number("w.start").alias("start_s"), number("w.end").alias("end_s"))


def clean_words(words: DataFrame) -> DataFrame:
    """Words with trimmed, non-empty text and finite times; an end before the start is raised to it."""
    kept = words.withColumn("text", strip("text")).filter((F.length("text") > 0) & is_finite("start_s") & is_finite("end_s"))
    return kept.withColumn("end_s", F.greatest("start_s", "end_s"))


def clean_turns(turns: DataFrame, least_seconds: float = 0.0) -> DataFrame:
    """Turns with finite times that last at least ``least_seconds``."""
    return turns.filter(is_finite("start_s") & is_finite("end_s") & (F.col("end_s") - F.col("start_s") >= least_seconds))


WORD = ["file_id", "word_ord", "ws", "we"]


def _rank(overlap: Column, gap: Column, ts: str, te: str, speaker: str) -> Column:
    """What turns are compared by: most overlap, smallest gap, then the first by (start, end, speaker)."""
    return F.struct((-overlap - F.lit(0.0)).alias("o"), gap.alias("g"), F.col(ts).alias("ts"), F.col(te).alias("te"), F.col(speaker).alias("speaker"))


def _touching(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Words with each turn that overlaps or touches them. A turn lies in at most two buckets of its level, and words
    look only at levels and stretches where their recording has turns."""
    level = F.expr("CASE " + " ".join(f"WHEN te - ts <= {w!r}D THEN {k}" for k, w in enumerate(LEVELS)) + f" ELSE {len(LEVELS)} END")
    width = F.element_at(F.array(*[F.lit(w) for w in LEVELS], F.lit(float("inf"))), F.col("level") + 1)
    t = turns.withColumn("level", level).withColumn("width", width)
    reach = t.groupBy("file_id", "level", "width").agg(F.min("ts").alias("lo"), F.max("te").alias("hi"))
    cell = lambda c: F.floor(c / F.col("width")).cast("bigint")
    t = t.withColumn("cell", F.explode(F.sequence(cell(F.col("ts")), cell(F.col("te")))))
    probe = words.join(reach, "file_id").filter("we >= lo AND ws <= hi")
    probe = probe.withColumn("cell", F.explode(F.sequence(cell(F.greatest("ws", "lo")), cell(F.least("we", "hi")))))
    pairs = probe.join(t.select("file_id", "level", "cell", "ts", "te", "speaker"), ["file_id", "level", "cell"]).filter("we >= ts AND ws <= te")
    return pairs.select(*WORD, _rank(F.least("we", "te") - F.greatest("ws", "ts"), F.lit(0.0), "ts", "te", "speaker").alias("r"))


def _neighbours(words: DataFrame, turns: DataFrame, bucket: float = 3600.0) -> DataFrame:
    """Words with the last turn that ends before them and the first one that begins after them, without the words that
    have none. Each is found in a window over one stretch of time of a recording; what lies in earlier or later
    stretches comes from one row for each of them."""
    cell = lambda c: F.floor(F.col(c) / F.lit(bucket)).cast("bigint")
    pair = F.struct("ts", "te", "speaker")

    def sweep(edge: str, asked: str, forward: bool) -> DataFrame:
        events = turns.groupBy("file_id", F.col(edge).alias("time")).agg(F.min(pair).alias("t")).withColumn("cell", cell("time"))
        asks = words.withColumn("time", F.col(asked)).withColumn("cell", cell("time"))
        last = events.groupBy("file_id", "cell").agg((F.max_by if forward else F.min_by)("t", "time").alias("c"))
        cells = last.unionByName(asks.select("file_id", "cell").distinct(), allowMissingColumns=True).groupBy("file_id", "cell").agg(F.max("c").alias("c"))
        # Backwards is forwards in descending order: a frame to the end of the window would be summed anew for each row.
        way = F.asc if forward else F.desc
        order = W.partitionBy("file_id").orderBy(way("cell")).rowsBetween(W.unboundedPreceding, -1)
        cells = cells.select("file_id", "cell", F.last("c", ignorenulls=True).over(order).alias("c")).filter("c IS NOT NULL")
        here = W.partitionBy("file_id", "cell").orderBy(way("time"), F.col("word_ord").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
        both = events.unionByName(asks, allowMissingColumns=True).withColumn("n", F.last("t", ignorenulls=True).over(here)).filter("word_ord IS NOT NULL")
        return both.join(cells, ["file_id", "cell"], "left").select(*WORD, F.coalesce("n", "c").alias("n")).filter("n IS NOT NULL")

    pairs = sweep("te", "ws", True).unionByName(sweep("ts", "we", False))
    gap = F.greatest(F.lit(0.0), F.col("n.ts") - F.col("we"), F.col("ws") - F.col("n.te"))
    overlap = F.greatest(F.lit(0.0), F.least("we", "n.te") - F.greatest("ws", "n.ts"))
    return pairs.select(*WORD, _rank(overlap, gap, "n.ts", "n.te", "n.speaker").alias("r"))


def assign_speakers(words: DataFrame, turns: DataFrame, *, least_seconds: float = 0.0, fallback: str = "SPEAKER_00") -> DataFrame:
    """Each clean word of a recording with the speaker of its best turn: most overlap, then smallest gap, then the
    turn that is first by (start, end, speaker).

    ``words``: ``file_id``, ``word_ord`` (unique in the recording), ``text``, ``start_s``, ``end_s``; ``turns``:
    ``file_id``, ``speaker``, ``start_s``, ``end_s``. Words of a recording without usable turns get ``fallback``.
    Identical rows count once; turns without a speaker and words without an ordinal are left out. Result: the words' columns, cleaned, and ``speaker``.
    """
    w = clean_words(words.select("file_id", "word_ord", "text", "start_s", "end_s").filter("word_ord IS NOT NULL").distinct())
    t = clean_turns(turns, least_seconds).filter("speaker IS NOT NULL").select("file_id", F.col("start_s").alias("ts"), F.col("end_s").alias("te"), "speaker").distinct()
    w, t = checkpoint(w.withColumnsRenamed({"start_s": "ws", "end_s": "we"})), checkpoint(t)  # each is looked at from several sides
    asked = w.select(*WORD)
    far = F.lit(float("inf"))
    none = w.withColumns({"ts": far, "te": far, "speaker": F.lit(fallback)}).select(*WORD, _rank(-far, far, "ts", "te", "speaker").alias("r"), "text")
    # The text goes along once; a word's other rows are times only.
    every = _touching(asked, t).unionByName(_neighbours(asked, t)).unionByName(none, allowMissingColumns=True)
    best = every.groupBy("file_id", "word_ord").agg(F.max("text").alias("text"), F.max("ws").alias("start_s"), F.max("we").alias("end_s"), F.min("r")["speaker"].alias("speaker"))
    return best.select("file_id", "word_ord", "text", "start_s", "end_s", "speaker")


def speaker_segments(assigned: DataFrame, *, bucket: float = 600.0) -> DataFrame:
    """Runs of one speaker's words, in order of (start, end, ordinal): ``file_id``, ``speaker``, ``start_s`` (of the
    first word), ``end_s`` (of the last word), ``words`` and ``text`` (joined without blanks)."""
    rows = checkpoint(assigned.withColumn("bucket", F.floor(F.col("start_s") / F.lit(bucket)).cast("bigint")))
    rows = mark_runs(rows, ["file_id"], "bucket", ["start_s", "end_s", "word_ord"], "speaker")
    at = F.struct("start_s", "end_s", "word_ord")
    runs = rows.groupBy("file_id", "run").agg(F.first("speaker").alias("speaker"), F.min("start_s").alias("start_s"), F.max(at).alias("last"), F.count("*").alias("words"), F.array_sort(F.collect_list(F.struct("start_s", "end_s", "word_ord", "text"))).alias("parts"))
    return runs.select("file_id", "speaker", "start_s", F.col("last.end_s").alias("end_s"), "words", F.array_join("parts.text", "").alias("text")).filter(F.length("text") > 0)


def transcript_lines(segments: DataFrame) -> DataFrame:
    """``line``: ``[start - end] speaker: text`` of each segment, with ``file_id`` and ``start_s`` to order by."""
    line = F.concat(F.lit("["), format_timestamp(F.col("start_s")), F.lit(" - "), format_timestamp(F.col("end_s")), F.lit("] "), F.col("speaker"), F.lit(": "), F.col("text"))
    return segments.select("file_id", "start_s", line.alias("line"))
