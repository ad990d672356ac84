"""Change logs: current rows, counters, order and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloq.functions.text import path_stem
from colloq.operators.runs import nth_free, running_total

# Order of processing states; others come last.
STATE_ORDER = {"PROCESSING": 0, "QUEUED": 1, "PENDING": 1, "ERROR": 2, "DONE": 3}


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the largest ``version`` of each key (insert if absent, else replace); combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def state_rank(state: Column, order: dict[str, int] | None = None) -> Column:
    rank = F.lit(99)
    for name, n in (order or STATE_ORDER).items():
        rank = F.when(F.upper(state) == name, n).otherwise(rank)
    return rank


def changes_after(df: DataFrame, version: str, seen: int) -> DataFrame:
    """What a reader of a snapshot with version ``seen`` has still to be told, in order."""
    return df.filter(F.col(version) > seen)


def pending(df: DataFrame, version: str, event: str, seen: int, most: int = 100) -> DataFrame:
    """What a reader with version ``seen`` is sent: the changes since, or, if they are more than ``most``, a single row
    with the event 'reset', the latest version and nothing else, upon which it takes a new snapshot."""
    rows = changes_after(df, version, seen)
    few, last = rows.agg(F.count("*") <= most, F.max(version)).first()
    if few:
        return rows
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.sparkSession.range(1).select(*[(F.lit(last) if c == version else F.lit("reset") if c == event else F.lit(None)).cast(kinds[c]).alias(c) for c in df.columns])


def replay(status: DataFrame, finals: DataFrame, keywords: DataFrame, graphs: DataFrame, most: int = 100) -> DataFrame:
    """What a reader that comes back is sent: ``session``, ``part``, ``n``, ``message`` (a JSON text), to be taken in
    order of ``part`` and ``n``. First the session's status, then its last ``most`` final messages in order, then its
    keywords and, if it shows any node, its graph.

    ``status``: ``session``, ``state``; ``finals``: ``session``, ``seq``, ``utterance_id``, ``text``, ``t0``, ``t1``;
    ``keywords``: ``session``, ``word``, ``score``, ``rank``; ``graphs``: ``session``, ``seq``, ``nodes``, ``edges``.
    """
    say = lambda df, part, n, kind, *fields: df.select("session", F.lit(part).alias("part"), n.cast("bigint").alias("n"), F.to_json(F.struct(F.lit(kind).alias("type"), *fields)).alias("message"))
    last = last_rows(finals, ["session"], ["seq"], most)
    best = keywords.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word", "score"))), lambda x: F.struct(x["word"].alias("word"), x["score"].alias("score"))).alias("keywords"))
    parts = [
        say(status, 0, F.lit(0), "status", "state"),
        say(last, 1, F.col("seq"), "final", "utterance_id", "text", "t0", "t1"),
        say(best, 2, F.lit(0), "keywords", "keywords"),
        say(graphs.filter(F.size("nodes") > 0), 3, F.lit(0), "graph", "seq", "nodes", "edges"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def session_ids(starts: DataFrame, started: str, taken: DataFrame) -> DataFrame:
    """``session_id`` of each start: the minute (``20240131_0905``), and for others of the same minute, or if ``taken``
    (``session_id``) has it, with the next number (``_2``, ``_3``, ...) that is free. ``ord``: a whole number, unique."""
    minute = starts.withColumn("__minute", F.date_format(started, "yyyyMMdd_HHmm"))
    held = taken.select(F.regexp_extract("session_id", r"^(\d{8}_\d{4})(?:_([1-9]\d*))?$", 1).alias("__minute"), F.regexp_extract("session_id", r"^(\d{8}_\d{4})(?:_([1-9]\d*))?$", 2).alias("__k")).filter("__minute <> ''")
    held = held.select("__minute", F.coalesce(F.expr("try_cast(__k AS BIGINT)"), F.lit(1)).alias("__k"))
    rows = running_total(minute.withColumn("__one", F.lit(1)), ["__minute"], "ord", "__one", "__nth").withColumn("__nth", F.col("__nth") + 1)
    found = nth_free(rows, held, ["__minute"], "__nth", "__k", "__free")
    name = F.when(F.col("__free") == 1, F.col("__minute")).otherwise(F.concat_ws("_", "__minute", F.col("__free").cast("string")))
    return found.withColumn("session_id", name).select(*starts.columns, "session_id")


def running_count(df: DataFrame, keys: list[str], order: str, name: str = "completed") -> DataFrame:
    """Each row with how many rows of its key there are up to it by ``order`` (a whole number, unique in the key)."""
    rows = running_total(df.withColumn("__one", F.lit(1)), keys, order, "__one", "__before", width=10_000)
    return rows.withColumn(name, (F.col("__before") + 1).cast("int")).drop("__one", "__before")


def last_rows(df: DataFrame, keys: list[str], order: list[str], most: int = 100) -> DataFrame:
    """The last ``most`` rows of each key by ``order``, numbered from the last."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("from_last", F.row_number().over(w)).filter(F.col("from_last") <= most)


def history(outputs: DataFrame, sources: DataFrame, path: str, extensions: tuple[str, ...] = (".mp3", ".wav", ".m4a")) -> DataFrame:
    """Finished results matched with the source of the same stem: ``stem``, ``output_path``, ``source_path``; of several
    sources the one whose extension comes first in ``extensions``."""
    ext = F.lower(F.regexp_extract(F.col(path), r"\.[^./]*$", 0))
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), ext)
    found = sources.filter(rank > 0).groupBy(path_stem(F.col(path)).alias("stem")).agg(F.min(F.struct(rank.alias("rank"), F.col(path).alias("p")))["p"].alias("source_path"))
    return outputs.select(path_stem(F.col(path)).alias("stem"), F.col(path).alias("output_path")).join(found, "stem")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """``unique_name``: a name nobody else has. The first row by ``order`` (a whole number, unique) of each name keeps
    it; the others get the next of name_2, name_3, ... that no row has as its own name. The suffix goes before the
    extension. Null names stay null."""
    split = {"__stem": F.regexp_replace(F.col(name), r"(?<=[^/])\.[^./]*$", ""), "__ext": F.regexp_extract(F.col(name), r"(?<=[^/])\.[^./]*$", 0)}
    rows = running_total(df.filter(F.col(name).isNotNull()).withColumn("__one", F.lit(1)), [name], order, "__one", "__nth").drop("__one").withColumns(split)
    numbered = r"^(.*)_([1-9][0-9]{0,17})$"
    taken = rows.select(F.regexp_extract("__stem", numbered, 1).alias("__stem"), "__ext", F.regexp_extract("__stem", numbered, 2).alias("__k")).filter("__k <> ''").select("__stem", "__ext", F.col("__k").cast("bigint").alias("__k"))
    again = nth_free(rows.filter("__nth > 0"), taken, ["__stem", "__ext"], "__nth", "__k", "__free", first=2)
    again = again.withColumn("unique_name", F.concat("__stem", F.lit("_"), F.col("__free").cast("string"), "__ext"))
    first = rows.filter("__nth = 0").withColumn("unique_name", F.col(name))
    columns = [*df.columns, "unique_name"]
    bare = df.filter(F.col(name).isNull()).withColumn("unique_name", F.lit(None).cast("string"))
    return first.select(columns).unionByName(again.select(columns)).unionByName(bare)
