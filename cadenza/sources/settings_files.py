"""Layered settings files: comments, continuations, includes, fragments, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.settings import typed

from .files import relative
from .shared import cut

INCLUDE = r'^\s*INCLUDE\s+"([^"]+)"'
#: A definition's first line.
START = r"^\s*([A-Za-z_]\w*)\s*=\s*(.*)$"
#: A quoted fragment, whose end may be missing; a name; anything else.
TOKEN = r'"(?:[^"\\]|\\.)*+(?:"|\\?$)|[A-Za-z_]\w*+|[^"A-Za-z_]++'
#: Stands for a walk that meets itself.
CYCLE = "\0"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the text files below a folder; the file is its path below it."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(relative(F.col("_metadata.file_path"), path).alias("file"), "value")


def lines_of(files: DataFrame) -> DataFrame:
    """(file, linenum, line) of files (file, value); what follows the last line end is a line only if it is not empty."""
    text = F.regexp_replace("value", r"\r?\n\z", "")
    return files.filter("value != ''").select("file", F.posexplode(F.split(text, r"\r?\n")).alias("linenum", "line")).withColumn("linenum", F.col("linenum") + 1)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, linenum, line) of the text files below a folder."""
    return lines_of(whole_files(spark, path))


def _resolved(folder: Column, include: Column) -> Column:
    """A path relative to a folder, without ``.`` and ``..`` parts."""
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(F.concat_ws("/", folder, include), "/"), F.array().cast("array<string>"), step), "/")


def include_edges(lines: DataFrame) -> DataFrame:
    """(file, linenum, include): which line of a file includes which other file.

    An include is looked up beside the file that has it, then from the top.
    """
    named = lines.withColumn("_i", F.regexp_extract("line", INCLUDE, 1)).filter("_i != ''")
    both = F.array(_resolved(F.regexp_extract("file", "^(.*)/[^/]*$", 1), F.col("_i")), _resolved(F.lit(""), F.col("_i")))
    asked = named.select("file", "linenum", F.posexplode(both).alias("_rank", "include"))
    found = asked.join(lines.select(F.col("file").alias("include")).distinct(), "include", "left_semi")
    return found.groupBy("file", "linenum").agg(F.min_by("include", "_rank").alias("include"))


def include_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(song, file, at, seen): every file that a root (file) reaches, once, by the first way in reading order.

    ``at`` holds the line numbers that lead to it. Ways double in length every round, so a
    chain of n includes takes log n rounds on the file graph, whatever the lines. Of two ways the
    one that comes first in reading order stays, which is enough as long as no way meets itself; a root that reaches a
    cycle is walked level by level instead, and there a level has a row per file.
    """
    ways = edges.select("file", "include", F.array(F.col("linenum").cast("int")).alias("at"), F.array("file", "include").alias("seen"))
    ways = ways.withColumn("include", F.when(F.col("file") == F.col("include"), F.lit(CYCLE)).otherwise(F.col("include")))
    first = lambda df, *keys: df.groupBy(*keys).agg(F.min(F.struct("at", "seen")).alias("w")).select(*keys, "w.at", "w.seen")
    now = cut(first(ways, "file", "include"))
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file", "include", "at").cast("decimal(38,0)"))).first()
    before = None
    while (size := state(now)) != before:
        before = size
        on = now.select(F.col("file").alias("include"), F.col("include").alias("_end"), F.col("at").alias("_at"), F.col("seen").alias("_seen"))
        longer = now.join(on, "include").withColumn("_rest", F.slice("_seen", F.lit(2), F.size("_seen")))
        meets = (F.col("_end") == CYCLE) | F.arrays_overlap("seen", "_rest")
        longer = longer.select("file", F.when(meets, F.lit(CYCLE)).otherwise(F.col("_end")).alias("include"), F.when(meets, F.array().cast("array<int>")).otherwise(F.concat("at", "_at")).alias("at"), F.when(meets, F.array().cast("array<string>")).otherwise(F.concat("seen", "_rest")).alias("seen"))
        now = cut(first(now.unionByName(longer), "file", "include"))
    start = roots.select(F.col("file").alias("song"), "file", F.array().cast("array<int>").alias("at"), F.array("file").alias("seen")).distinct()
    cyclic = now.filter(F.col("include") == CYCLE).select("file").distinct()
    plain = start.join(cyclic, "file", "left_anti")
    reached = plain.select("song", "file").join(now, "file").select("song", F.col("include").alias("file"), "at", "seen")
    out = plain.unionByName(reached)
    level = cut(start.join(cyclic, "file", "left_semi"))
    walked = level
    while not level.isEmpty():
        met = level.join(edges.withColumnRenamed("linenum", "_n").withColumnRenamed("include", "_to"), "file").filter(~F.array_contains("seen", F.col("_to")))
        level = cut(first(met.select("song", F.col("_to").alias("file"), F.concat("at", F.array(F.col("_n").cast("int"))).alias("at"), F.concat("seen", F.array("_to")).alias("seen")), "song", "file"))
        walked = walked.unionByName(level)
    return out.unionByName(first(walked, "song", "file"))


def inline_includes(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """(song, order, line): the lines of each root file with its includes in their places.

    ``order`` is the path of line numbers that leads to a line. A file is read once per
    root, at its first include; the include line itself is a comment. Lines are joined once, with the files that each root reaches.
    """
    reach = include_closure(cut(include_edges(lines)), roots)
    line = F.when(F.col("line").rlike(INCLUDE), F.concat(F.lit("-- "), "line")).otherwise(F.col("line"))
    return lines.join(reach, "file").select("song", F.concat("at", F.array(F.col("linenum").cast("int"))).alias("order"), line.alias("line"))


def definitions(flat: DataFrame) -> DataFrame:
    """(song, n, key, raw): the logical lines that define a key; n is the place of the first line in its song.

    A definition's first line opens a logical line, a blank one ends it, comments in between are passed over and
    trailing backslashes removed.
    """
    rows = flat.withColumn("n", F.row_number().over(W.partitionBy("song").orderBy("order")))
    rows = rows.filter(~F.col("line").rlike(r"^\s*--")).withColumn("_start", F.col("line").rlike(START)).withColumn("_blank", F.col("line").rlike(r"^\s*$"))
    upto = W.partitionBy("song").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum((F.col("_start") | F.col("_blank")).cast("int")).over(upto)).filter("not _blank")
    part = F.regexp_replace(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s*\\$", "")
    whole = rows.groupBy("song", "_run").agg(F.min("n").alias("n"), F.max("_start").alias("_start"), F.array_sort(F.collect_list(F.struct("n", part.alias("p")))).alias("a")).filter("_start")
    text = F.array_join(F.transform("a", lambda x: x.p), " ")
    return whole.select("song", "n", F.regexp_extract(text, START, 1).alias("key"), F.regexp_replace(F.regexp_extract(text, START, 2), r"\s+$", "").alias("raw"))


def combined(raw: Column) -> Column:
    """The text of quoted and bare fragments: quotes go, a bare fragment keeps one space behind it."""
    part = F.regexp_extract_all(raw, F.lit(r'"(?:[^"\\]|\\.)*+(?:"|\\?$)|[^\s"]\S*\s?'), F.lit(0))
    return F.array_join(F.transform(part, _bare), "")


def _bare(x: Column) -> Column:
    """A fragment without its quotes."""
    closed = x.rlike(r'^"(?:[^"\\]|\\.)*"$')
    return F.when(closed, F.substring(x, F.lit(2), F.length(x) - 2)).when(x.startswith('"'), F.substring(x, F.lit(2), F.length(x))).otherwise(x)


def _shown(v: Column) -> tuple[Column, Column]:
    """(whether a value is a text, how it is written where it is not)."""
    whole, real, hexa = v.rlike(r"^[+-]?\d+$"), v.rlike(r"^[+-]?\d+\.\d*$"), v.rlike("^0[xX][0-9A-Fa-f]+$")
    flag = F.upper(v).isin("TRUE", "WAHR", "FALSE", "FALSCH")
    sign = F.when(v.startswith("-"), "-").otherwise("")
    digits = lambda x: F.regexp_replace(x, r"^[+-]?0*(?=\d)", "")
    plain = F.when(flag, F.when(F.upper(v).isin("TRUE", "WAHR"), "True").otherwise("False")).when(hexa, F.conv(F.substring(v, F.lit(3), F.length(v)), 16, 10))
    plain = plain.when(whole, F.when(digits(v) == "0", "0").otherwise(F.concat(sign, digits(v))))
    return ~(whole | real | hexa | flag), plain.otherwise(F.concat(sign, digits(F.regexp_replace(F.regexp_replace(v, r"(\.\d*?)0+$", "$1"), r"\.$", ".0"))))


def _tagged(k: int):
    return lambda s, i: F.struct(F.lit(k).alias("k"), i.alias("i"), s.alias("s"))


def evaluate(defs: DataFrame) -> DataFrame:
    """(song, n, key, value_text) of definitions: names are replaced by the value that they have before the definition.

    Which definition a name means is an as-of lookup. What a definition is made of is a list of
    texts and places of other definitions. In every round a place becomes the value there, if that is known,
    or what the definition there is made of, if that cannot be but a text; so the reach of the
    latter doubles, and a text that is extended a thousand times takes ten rounds. Numbers and truth values are written plainly where
    they are inserted, so they must be known first.
    """
    part = defs.select("song", "n", F.posexplode(F.regexp_extract_all("raw", F.lit(TOKEN), F.lit(0))).alias("i", "t"))
    name = F.col("t").rlike(r"^[A-Za-z_]")
    asked = part.select("song", F.when(name, F.col("t")).alias("key"), "n", F.lit(1).alias("_ask"), "i", "t")
    known = defs.select("song", "key", "n", F.lit(0).alias("_ask"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("t"))
    asof = W.partitionBy("song", "key").orderBy(F.col("n"), F.col("_ask").desc()).rowsBetween(W.unboundedPreceding, 0)  # a definition is not before itself
    ref = F.when(F.col("key").isNotNull(), F.last(F.when(F.col("_ask") == 0, F.col("n")), ignorenulls=True).over(asof))
    part = asked.unionByName(known).withColumn("ref", ref).filter("_ask = 1").drop("_ask", "key")
    own = W.partitionBy("song", "n").orderBy("i")
    part = part.withColumns({"_p": F.lag("t").over(own), "_pr": F.lag("ref").over(own), "_q": F.lead("t").over(own)})
    quoted = lambda c: F.coalesce(F.col(c).startswith('"'), F.lit(False))
    free = F.col("_p").isNull() | quoted("_p") | F.col("_p").rlike(r"\s$")
    after = F.col("_q").isNull() | F.col("_q").rlike(r"^\s")
    glued = F.when(F.col("ref").isNotNull(), ~(free & after)).when(quoted("t"), ~(free & (F.col("_pr").isNull()))).otherwise(False)
    runs = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"\S+\s?"), F.lit(0)), "")
    behind_name = F.col("_p").rlike("^[A-Za-z_]") & F.col("_pr").isNull()
    text = F.when(quoted("t"), _bare(F.col("t"))).when(name, F.col("t")).otherwise(F.concat(F.when(behind_name, F.regexp_extract("t", r"^(\s?)", 1)).otherwise(""), runs("t")))
    gap = F.regexp_extract(F.coalesce("_q", F.lit("")), r"^(\s?)", 1)
    piece = F.struct(F.when(F.col("ref").isNull(), text).alias("text"), "ref", gap.alias("gap"))
    raw = F.struct(F.when(F.col("ref").isNull(), F.col("t")).alias("text"), "ref", F.lit("").alias("gap"))
    made = part.groupBy("song", "n").agg(
        F.max(glued).alias("glued"), F.array_sort(F.collect_list(F.struct("i", piece.alias("s"), raw.alias("r")))).alias("a"),
        F.max(F.when(F.col("ref").isNull(), text).rlike(r"[^0-9A-Za-z+.\-]")).alias("_odd"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    text_only = F.coalesce("_odd", F.lit(False)) & ~F.col("glued")
    made = made.select("song", "n", text_only.alias("text_only"), F.transform("a", lambda x: x.r).alias("raw"), F.when(~F.col("glued"), F.transform("a", lambda x: x.s)).alias("made"))
    known = lambda c: ~F.exists(c, lambda s: s.ref.isNotNull())
    joined = lambda c: F.array_join(F.transform(c, lambda s: s.text), "")
    value = F.when(known("raw"), combined(joined("raw"))).when(known("made"), joined("made"))
    made = cut(made.withColumn("v", value))
    pending = made.filter("v is null")
    empty = defs.select("song", "n").join(made, ["song", "n"], "left_anti").withColumn("v", F.lit(""))  # a definition of nothing has no token
    done = cut(made.filter("v is not null").select("song", "n", "v").unionByName(empty))
    while not pending.isEmpty():
        there = done.select("song", F.col("n").alias("ref"), "v", none(pending.schema["made"].dataType).alias("m"))
        there = there.unionByName(pending.filter("text_only").select("song", F.col("n").alias("ref"), none("string").alias("v"), F.col("made").alias("m")))
        both = F.concat(*(F.transform(F.coalesce(c, F.array().cast(pending.schema[c].dataType)), _tagged(k)) for k, c in enumerate(("raw", "made"))))
        place = pending.select("song", "n", "text_only", F.explode(both).alias("x")).select("song", "n", "text_only", "x.*", F.col("x.s.ref").alias("ref"))
        met = place.join(there, ["song", "ref"], "left")
        is_text, plain = _shown(F.col("v"))
        in_raw = F.when(is_text, F.concat(F.lit('"'), "v", F.lit('"'))).otherwise(plain)
        in_made = F.when(~is_text, F.concat(plain, "s.gap")).when(~F.col("v").rlike(r'(?<!\\)"'), F.col("v"))  # a bare quote in a text cuts it anew, which only the raw form tells
        shown = F.when(F.col("k") == 0, in_raw).otherwise(in_made)
        put = F.when(shown.isNotNull(), F.array(F.struct(shown.alias("text"), none("int").alias("ref"), F.lit("").alias("gap"))))
        put = put.when(F.col("m").isNotNull() & (F.col("k") == 1), F.col("m")).otherwise(F.array("s"))
        made = met.groupBy("song", "n", "text_only").agg(F.array_sort(F.collect_list(F.struct("k", "i", put.alias("p")))).alias("a"))
        of = lambda k: F.flatten(F.transform(F.filter("a", lambda x: x.k == k), lambda x: x.p))
        made = made.select("song", "n", "text_only", of(0).alias("raw"), F.when(F.exists("a", lambda x: x.k == 1), of(1)).alias("made"))
        made = cut(made.withColumn("v", value))
        done = cut(done.unionByName(made.filter("v is not null").select("song", "n", "v")))
        pending = made.filter("v is null")
    return defs.join(done, ["song", "n"]).select("song", "n", "key", F.replace(F.col("v"), F.lit('\\"'), F.lit('"')).alias("value_text"))


def read_settings(spark: SparkSession, path: str, roots: DataFrame | None = None) -> DataFrame:
    """Settings (song, key, line, value_text, value_type, ...) of root files; all files are roots by default."""
    return settings_of(file_lines(spark, path), roots)


def settings_of(lines: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The settings of lines (file, linenum, line) that have been read already.

    A key's line is its place among the lines of its song, includes in their places.
    """
    lines = cut(lines)
    roots = lines.select("file").distinct() if roots is None else roots
    got = evaluate(cut(definitions(inline_includes(lines, roots))))
    return typed(got.select("song", "key", F.col("n").cast("long").alias("line"), "value_text"))
