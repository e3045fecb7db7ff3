"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are alike when they are equal or one character edit (substitution, insertion, deletion) apart. Such lines
agree in the first or in the last half of their characters, so lines that share no half with a different line are left
out, and the rest of the others, which holds the edit, is halved the same way twice more, and in long lines as often as
it takes until the rest is short. For the short middles that are still shared, all variants within the edit bound are emitted as hashed keys: the text itself, without each of its
characters, and with each of them open. What shares a variant is one edit apart, which a comparison of the
whole lines then confirms; groups of equal variants are only aggregated, never paired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: The edit bound follows the length: shorter lines are alike when equal only, since an edit makes another word of them.
NEAR_CHARS = 24
#: Halvings of all lines before characters are left out.
HALVINGS = 3
#: Middles that are longer after these are halved on: all variants of n characters are n^2 characters to hash.
LAST_CHARS = 8_192
#: Spark's Levenshtein distance takes quadratic time even under a bound; longer lines are compared by ``one_edit``.
LEVENSHTEIN_CHARS = 512
SALTS = 64
#: Rows of longs that are broadcast at most (16 MB); beyond it the same join shuffles.
SMALL_ROWS = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows have been counted to be few."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def line_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, own, at, line, h) for each line of ``docs``; own is the whole text's hash, h the line's."""
    lines = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("own"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return lines.withColumn("h", F.xxhash64("line"))


def ways(context: Column, text: Column) -> list[tuple[Column, Column]]:
    """(context, middle) pairs: the first or the last half of ``text`` goes into the context, the rest is the middle.
    Of texts one edit apart, one pair has the same context and middles one edit apart."""
    n = F.length(text)
    found = []
    for h in (F.floor(n / 2).cast("int"), F.greatest(F.floor((n - 1) / 2), F.lit(0)).cast("int")):
        found.append((F.xxhash64(context, F.lit("l"), h, F.substring(text, F.lit(1), h)), F.substring(text, h + 1, n)))
        found.append((F.xxhash64(context, F.lit("r"), h, F.substring(text, n - h + 1, h)), F.substring(text, F.lit(1), n - h)))
    return found


def halves(context: Column, text: Column) -> Column:
    return F.array_distinct(F.array(*(F.struct(c.alias("context"), m.alias("middle")) for c, m in ways(context, text))))


def half_contexts(context: Column, text: Column) -> Column:
    """The contexts of ``halves`` alone, without the middles."""
    return F.array_distinct(F.array(*(c for c, _ in ways(context, text))))


def halved(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(halves(F.col("context"), F.col(text))).alias("v")).select(*keep, "v.*")


def in_shared(rows: DataFrame) -> DataFrame:
    """The ``rows`` whose context two different lines have; a context with most rows is spread by a salt."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("context", "salt").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    both = part.groupBy("context").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list("salt").alias("salts")).where("lo <> hi")
    return salted.join(both.select("context", F.explode("salts").alias("salt")), ["context", "salt"]).select(*rows.columns)


def short_middles(rows: DataFrame) -> DataFrame:
    """``rows`` (h, context, middle) with middles of LAST_CHARS at most, longer ones halved on. Those of just LAST_CHARS go
    both ways, since of two middles one edit apart one may be a character longer."""
    done = []
    while (rows.agg(F.max(F.length("middle"))).first()[0] or 0) > LAST_CHARS:
        done.append(rows.where(F.length("middle") <= LAST_CHARS))
        rows = written(in_shared(halved(rows.where(F.length("middle") >= LAST_CHARS), "middle", "h")), "halves")
    return reduce(DataFrame.unionByName, done, rows)


def one_edit(a: Column, b: Column) -> Column:
    """Whether different texts are one edit apart: bisection finds their common prefix, and what follows it is compared."""
    least = F.least(F.length(a), F.length(b))
    agree = lambda n: (n <= least) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    step = lambda k: F.pow(F.lit(2), k).cast("int")
    same = F.aggregate(F.sequence(F.lit(29), F.lit(0)), F.lit(0), lambda n, k: F.when(agree(n + step(k)), n + step(k)).otherwise(n))
    rest = lambda x, n: F.substring(x, n + 1, F.length(x))
    close = lambda n: (rest(a, n + 1) == rest(b, n + 1)) | (rest(a, n + 1) == rest(b, n)) | (rest(a, n) == rest(b, n + 1))
    return F.exists(F.array(same), close)


def last_variants(text: Column, context: Column) -> Column:
    """Array of (group, role): role s for a place where the character may differ, d for a text one character shorter,
    w for the text itself."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.expr("cast(array() as array<int>)"))
    before = lambda i: F.substring(text, F.lit(1), i - 1)
    after = lambda i: F.substring(text, i + 1, F.length(text))
    tag = lambda x, role: F.struct(x.alias("group"), F.lit(role).alias("role"))
    return F.concat(
        F.array(tag(F.xxhash64(context, F.lit("d"), text), "w")),
        F.transform(places, lambda i: tag(F.xxhash64(context, F.lit("s"), i, before(i), after(i)), "s")),
        F.transform(places, lambda i: tag(F.xxhash64(context, F.lit("d"), F.concat(before(i), after(i))), "d")),
    )


def near_lines(docs: DataFrame, key: str, text: str, lines: DataFrame, firsts: DataFrame, near_chars: int) -> DataFrame:
    """The h of lines that have an earlier line one edit apart. ``lines``: (h, contexts); ``firsts``: (h, first)."""
    marks = lines.select("h", F.explode("contexts").alias("context"))
    common = written(marks.groupBy("context").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("context"), "contexts")
    some = written(marks.join(few(common), "context", "left_semi").select("h").distinct().join(firsts, "h"), "lines")
    fit = line_rows(docs, key, text).where(F.length("line") >= near_chars).select("h", "line")
    texts = written(fit.join(few(some.select("h")), "h", "left_semi").dropDuplicates(["h"]).join(some, "h"), "texts")
    narrow = texts.select("h", F.lit(0).cast("long").alias("context"), F.col("line").alias("middle"))
    for _ in range(HALVINGS):
        narrow = written(in_shared(halved(narrow, "middle", "h")), "halves")
    narrow = short_middles(narrow).join(some, "h")
    marks = narrow.select("h", "first", F.explode(last_variants(F.col("middle"), F.col("context"))).alias("g")).select("h", "first", "g.*")
    # a group of role s is pairwise one edit apart; in the others the whole text is one edit from each longer one
    least = lambda role: F.min(F.when(F.col("role") == role, F.struct("first", "h"))).alias(role)
    lows = marks.groupBy("group").agg(least("s"), least("d"), least("w"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi")
    spread = marks.select("group", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int").alias("salt"), "h", "first", "role")
    salts = spread.groupBy("group", "salt").agg(F.count("*").alias("n")).groupBy("group").agg(F.collect_list("salt").alias("salts"))
    lows = lows.join(salts, "group").select("group", "s", "d", "w", F.explode("salts").alias("salt"))
    partner = F.when(F.col("role") == "s", F.col("s")).when(F.col("role") == "d", F.col("w")).otherwise(F.col("d"))
    pairs = spread.join(lows, ["group", "salt"]).withColumn("partner", partner).where("partner.first < first").select("h", F.col("partner.h").alias("other")).distinct()
    line = texts.select("h", "line")
    checked = pairs.join(line, "h").join(line.toDF("other", "other_line"), "other")
    a, b = F.col("line"), F.col("other_line")
    short = F.greatest(F.length(a), F.length(b)) <= LEVENSHTEIN_CHARS
    return checked.where(F.when(short, F.levenshtein(a, b, 1) >= 0).otherwise(one_edit(a, b))).select("h").distinct()


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", near_chars: int = NEAR_CHARS) -> DataFrame:
    """(key, own, at) of the lines to drop: those with an equal line earlier, or an earlier line one edit apart."""
    rows = line_rows(docs, key, text).where("line <> ''")
    start = F.when(F.length("line") >= near_chars, half_contexts(F.lit(0).cast("long"), F.col("line"))).otherwise(F.expr("cast(array() as array<long>)"))
    lines = written(rows.select("h", F.struct("key", "own", "at").alias("place"), start.alias("contexts")), "lines")
    fit = lines.select("h", "place")
    salted = fit.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("h", "salt").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    whole = part.groupBy("h").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    whole = written(whole, "firsts")
    again = salted.join(whole.where("n > 1").select("h", "first", F.explode("salts").alias("salt")), ["h", "salt"]).where("place > first").select("place.*")
    near = near_lines(docs, key, text, lines, whole.select("h", "first"), near_chars).join(whole, "h").select("first.*")
    return again.unionByName(near).distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", near_chars: int = NEAR_CHARS) -> DataFrame:
    """``docs`` with lines dropped that repeat an earlier one, exactly or but for one character.

    Lines are parted by \\n; earlier means a smaller (key, hash of the whole text, line number). A line goes if any
    earlier line, dropped or not, is equal to it, or is one edit apart and both have ``near_chars`` characters or more (1:
    the bound holds for all lines). Empty lines stay, an empty table gives an empty result. Null texts stay null, a text that loses all lines is empty, no row goes. Rows with one key and different
    texts are documents of their own; rows that agree in both are alike and lose the same lines. Lines of any length are
    compared whole. Adds n_lines and n_dropped, in place of columns of these names; other columns stay.
    """
    rows = docs.drop("n_lines", "n_dropped")
    key_, own_, gone_ = (fresh(rows, x) for x in ("_key", "_own", "_gone"))
    gone = dropped_lines(docs, key, text, near_chars).groupBy("key", "own").agg(F.collect_set("at")).toDF(key_, own_, gone_)
    joined = rows.join(gone, rows[key].eqNullSafe(F.col(key_)) & (F.xxhash64(rows[text]) == F.col(own_)), "left").drop(key_, own_)
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone_, i)), "\n")
    numbers = {"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_dropped": F.coalesce(F.size(gone_), F.lit(0)).cast("long")}
    return joined.withColumns(numbers).withColumn(text, F.when(F.col(gone_).isNull(), F.col(text)).otherwise(kept)).drop(gone_)


#: Independent of the variants: lines one edit apart agree in their first or in their last half.
ORACLE = f"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
fit AS (SELECT line, doc_id, pos FROM l WHERE line <> ''),
firsts AS (SELECT line, min(row(doc_id, pos)) AS first FROM fit GROUP BY line),
halves AS (SELECT line, first, h, part, CASE part WHEN 'l' THEN left(line, h) ELSE right(line, h) END AS half FROM
  (SELECT *, unnest(list_distinct([length(line) // 2, (length(line) - 1) // 2])) AS h FROM firsts WHERE length(line) >= {NEAR_CHARS}), (VALUES ('l'), ('r')) AS p(part)),
pairs AS (SELECT DISTINCT a.line AS x, b.line AS y FROM halves a JOIN halves b ON a.h = b.h AND a.part = b.part AND a.half = b.half
  WHERE b.first < a.first AND a.line <> b.line AND abs(length(a.line) - length(b.line)) <= 1),
long_pairs AS (SELECT x, y, coalesce(list_position(list_transform(range(1, 1 + least(length(x), length(y))), lambda i : substr(x, i, 1) = substr(y, i, 1)), false), 1 + least(length(x), length(y))) AS p FROM pairs WHERE length(x) > 4096),
near AS (SELECT x AS line FROM pairs WHERE length(x) <= 4096 AND levenshtein(x, y) <= 1
  UNION SELECT x FROM long_pairs WHERE substr(x, p + 1) = substr(y, p + 1) OR substr(x, p + 1) = substr(y, p) OR substr(x, p) = substr(y, p + 1)),
gone AS (SELECT doc_id, pos FROM fit JOIN firsts USING (line) WHERE row(doc_id, pos) > first
  UNION SELECT first[1], first[2] FROM firsts WHERE line IN (SELECT line FROM near)),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, kept.text FROM documents d LEFT JOIN kept USING (doc_id)
"""
