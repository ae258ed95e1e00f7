"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so that a question and a re-parameterised copy of it have the same
template. Windows of templates are hash-joined with those of the benchmark. Where windows of a document and an item line up,
their slot values must agree: one value of the item always became the same value of the document, and no two became one;
windows with a slot that breaks this don't count. All of it is built-in functions: one regular expression takes a text
apart, and a token's type follows from the token itself and its neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, written

#: Tokens of a window, and the plain ones that its template needs to tell anything. Windows with fewer must be equal in their slots too.
WINDOW, LEAST_PLAIN = 10, 5
#: A leak: this percentage of an item's windows, or so many of them, or so many verbatim ones in a row (WINDOW + 3 = 13 tokens).
LEAST_PERCENT, LEAST_WINDOWS, LEAST_RUN = 30, 12, 4
#: Windows of the benchmark that are broadcast at most (16 bytes each and their slots); more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
#: A number with its separators, or a run of letters and other digits.
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|(?:\p{L}|[^\P{N}0-9])+"
#: Words that are numbers (not "one", which is as often a pronoun).
NUMBER_WORDS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()
#: Words that are neither names with a capital letter, as they often start a sentence, nor units after a number.
NO_NAMES = (
    "a an and are as at but by can did do does each every find for from given had has have he her his how i if in is it its let my no not of on one or our she so some "
    "that the their then there these they this to was we were what when where which who why will with you your"
).split()


def _starts_with_digit(w: Column) -> Column:
    return (w >= F.lit("0")) & (w < F.lit(":"))


def _shape(w: Column) -> Column:
    """What a token looks like: n for a number, s for a word that is no name and no unit (S in capitals), A for capitals only, a for some, '' for none."""
    low, high = F.lower(w), F.upper(w) == w
    # Most tokens have no capital letter: they are told first.
    small = F.when(_starts_with_digit(w) | w.isin(*NUMBER_WORDS), "n").when(w.isin(*NO_NAMES), "s").otherwise("")
    stop = F.when(high & (F.length(w) > 1), "S").otherwise("s")
    return F.when(low == w, small).when(low.isin(*NUMBER_WORDS), "n").when(low.isin(*NO_NAMES), stop).otherwise(F.when(high, "A").otherwise("a"))


def _typed() -> Column:
    """The tokens of _raw with their types, from _shape: those of a slot begin with it, and the rest is its value.

    A number is written in digits or as a word; a unit is any word right behind a number; a name has a capital letter (one
    in capitals only is none if the token before or behind is so too: that is shouting).
    """
    at = lambda i: F.coalesce(F.get("_shape", i), F.lit(""))

    def typed(w: Column, i: Column) -> Column:
        own, low, number = F.get("_shape", i), F.lower(w), at(i - 1) == "n"
        loud = lambda j: at(j).isin("A", "S")
        name = (own == "a") | ((own == "A") & ~loud(i - 1) & ~loud(i + 1))
        # Plain tokens, which most are, go as they are.
        slot = F.when(own == "n", F.concat(F.lit(NUMBER), low)).when(number, F.concat(F.lit(UNIT), low)).when(name, F.concat(F.lit(NAME), low)).otherwise(low)
        return F.when((own == "") & ~number, w).when(own.isin("s", "S"), low).otherwise(slot)

    return F.transform("_raw", typed)


def _is_slot(token: Column) -> Column:
    return token < F.lit("\x04")


def _templates(df: DataFrame, *columns: str) -> DataFrame:
    """_tokens; _plain, the hash of each with slots by their type; and _slot_at, the places of slots."""
    out = df.select(*columns, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0)).alias("_raw"))
    out = out.withColumn("_shape", F.transform("_raw", _shape))
    out = out.select(*columns, _typed().alias("_typed"))
    # A name of several parts is one slot, known by the first.
    first = lambda w, i: ~(w.startswith(NAME) & F.coalesce(F.get("_typed", i - 1).startswith(NAME), F.lit(False)))
    out = out.select(*columns, F.filter("_typed", first).alias("_tokens"))
    out = out.withColumn("_slot_at", F.array_compact(F.transform("_tokens", lambda w, i: F.when(_is_slot(w), i))))
    return out.withColumn("_plain", F.transform("_tokens", lambda w: F.xxhash64(F.when(_is_slot(w), F.substring(w, 1, 1)).otherwise(w))))


def _template(at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *(F.get("_plain", at + k) for k in range(n)))


def _hash(at: Column, n: int) -> Column:
    """The hash of n tokens from a place on: of their template, or of the tokens themselves if too few of them are plain."""
    whole = F.xxhash64(F.lit(-n), *(F.get("_tokens", at + k) for k in range(n)))
    return F.when(n - F.size(_slots(at, F.lit(n))) >= min(n, LEAST_PLAIN), _template(at, n)).otherwise(whole)


def _windows(n: int) -> Column:
    """The hash of each window. Only texts in which some window has too few plain tokens pay for counting them."""
    starts = F.slice("_plain", 1, F.greatest(F.size("_plain") - (n - 1), F.lit(0)))
    dense = n - min(n, LEAST_PLAIN)
    crowded = F.exists(F.transform("_slot_at", lambda p, j: F.coalesce(F.get("_slot_at", j + dense) - p < n, F.lit(False))), lambda x: x)
    return F.when(crowded, F.transform(starts, lambda h, i: _hash(i, n))).otherwise(F.transform(starts, lambda h, i: _template(i, n)))


def _slots(at: Column, n: Column) -> Column:
    return F.filter(F.slice("_tokens", at + 1, n), _is_slot)


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, n, at, hash, item_slots, item_windows of each window; an item shorter than a window is one window."""
    items = _templates(benchmark.filter("item_id IS NOT NULL").select("item_id", "text").distinct(), "item_id").filter("size(_tokens) > 0")
    items = items.withColumn("n", F.least(F.size("_tokens"), F.lit(window))).withColumn("item_windows", F.expr("CAST(size(_tokens) - n + 1 AS bigint)"))
    each = items.withColumn("at", F.explode(F.expr("sequence(0, size(_tokens) - n)")))
    by_length = [F.when(F.col("n") == n, _hash(F.col("at"), n)) for n in range(1, window + 1)]
    return each.select("item_id", "n", "at", F.coalesce(*by_length).alias("hash"), _slots(F.col("at"), F.col("n")).alias("item_slots"), "item_windows")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """_row, doc_id, item_id, n_windows, item_windows, n_slots, n_changed, longest_run, kind of each leaked item of each row of docs.

    kind is exact if one run of windows without a changed value covers the item, reparameterised if a value has changed, else
    partial. Windows line up if they are equally far
    from each other in both texts; those that hold a contradictory slot value don't count. longest_run is the most
    neighbouring windows without a changed value. Null and empty texts have no window; items without a word and items with
    a null id are ignored, repeated items count once; repeated rows are judged alike; empty tables give an empty result; a
    text may be of any length. Columns other than doc_id, item_id and text are ignored. The texts are written once with
    their places, so docs is read once.
    """
    return _leaks(written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")), "texts"), benchmark, window, broadcast_windows)


def _leaks(numbered: DataFrame, benchmark: DataFrame, window: int, broadcast_windows: int) -> DataFrame:
    items = written(item_windows(benchmark, window), "benchmark")
    few = items.count() <= broadcast_windows
    rows = _templates(numbered, "_row", "doc_id")
    parts = []
    # One length, unless the benchmark has items shorter than a window; at most `window` lengths.
    for n in sorted(r["n"] for r in items.select("n").distinct().collect()) or [window]:
        # Outer, so that no filter on the array's size is inferred and pushed below the columns that it is made of.
        each = rows.select("_row", "doc_id", "_tokens", _windows(n).alias("_windows")).select("_row", "doc_id", "_tokens", F.posexplode_outer("_windows").alias("doc_at", "hash"))
        of = items.filter(F.col("n") == n)
        columns = ["_row", "doc_id", "item_id", "item_windows", "n", "at", "doc_at", "item_slots"]
        if few:
            # Windows meet the broadcast items where they are made, and only the slots of those that match leave the task.
            met = each.join(F.broadcast(of), "hash").select(*columns, _slots(F.col("doc_at"), F.col("n")).alias("doc_slots"))
        else:
            # Only ids, places and hashes are shuffled: a text's tokens with each window would grow with the square of its
            # length. A window that many texts share is a hot key of the join, which adaptive execution splits.
            met = each.drop("_tokens").join(of, "hash").select(*columns)
        parts.append(met)
    met = written(reduce(DataFrame.unionByName, parts), "leaks")
    if not few:
        met = written(_with_slots(met, numbered), "slots")
    met = met.withColumn("offset", F.col("doc_at") - F.col("at"))
    line = ["_row", "item_id", "offset"]
    pairs = met.select(*line, "at", F.explode(F.arrays_zip(F.col("item_slots").alias("v"), F.col("doc_slots").alias("u"))).alias("p")).select(*line, "at", "p.v", "p.u")
    values = pairs.select(*line, "v", "u").distinct()
    one_way = values.groupBy(*line, "v").agg(F.count(F.lit(1)).alias("_to"))
    other_way = values.groupBy(*line, "u").agg(F.count(F.lit(1)).alias("_from"))
    judged = values.join(one_way, [*line, "v"]).join(other_way, [*line, "u"]).select(*line, "v", "u", ((F.col("_to") > 1) | (F.col("_from") > 1)).alias("_broken"))
    slots = judged.filter("NOT _broken").groupBy(*line).agg(F.count(F.lit(1)).alias("n_slots"), F.sum(F.when(F.col("v") != F.col("u"), 1).otherwise(0)).alias("n_changed"))
    held = pairs.join(judged, [*line, "v", "u"]).groupBy(*line, "at").agg(F.max("_broken").alias("_broken"), F.max(F.col("v") != F.col("u")).alias("_changed"))
    good = met.select(*line, "at", "doc_id", "item_windows").dropDuplicates([*line, "at"]).join(held, [*line, "at"], "left").filter("NOT coalesce(_broken, false)")
    place = F.col("at") - F.row_number().over(Window.partitionBy(*line, "_same").orderBy("at"))
    runs = good.withColumn("_same", ~F.coalesce("_changed", F.lit(False))).withColumn("_island", place)
    runs = runs.groupBy(*line, "_same", "_island").agg(F.count(F.lit(1)).alias("_n"), F.first("doc_id").alias("doc_id"), F.max("item_windows").alias("item_windows"))
    lines = runs.groupBy(*line).agg(F.first("doc_id").alias("doc_id"), F.max("item_windows").alias("item_windows"), F.sum("_n").alias("n_windows"), F.max(F.when(F.col("_same"), F.col("_n")).otherwise(0)).alias("longest_run"))
    lines = lines.join(slots, line, "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    out = lines.groupBy("_row", "item_id").agg(F.first("doc_id").alias("doc_id"), F.max("item_windows").alias("item_windows"), total("n_windows"), total("n_slots"), total("n_changed"), F.max("longest_run").alias("longest_run"))
    out = out.filter((100 * F.col("n_windows") >= LEAST_PERCENT * F.col("item_windows")) | (F.col("n_windows") >= LEAST_WINDOWS) | (F.col("longest_run") >= LEAST_RUN))
    return out.withColumn("kind", F.when(F.col("n_changed") > 0, "reparameterised").when(F.col("longest_run") >= F.col("item_windows"), "exact").otherwise("partial"))


def _with_slots(met: DataFrame, numbered: DataFrame) -> DataFrame:
    """met with doc_slots, from the texts of the rows that met an item: each text is joined once."""
    asked = met.groupBy("_row").agg(F.collect_list(F.struct(*(c for c in met.columns if c != "_row"))).alias("_asked"))
    of = _templates(numbered.select("_row", "text").join(asked, "_row"), "_row", "_asked")
    told = F.transform("_asked", lambda x: F.struct(x.alias("x"), _slots(x["doc_at"], x["n"]).alias("doc_slots")))
    return of.select("_row", told.alias("_told")).select("_row", F.explode_outer("_told").alias("t")).select("_row", "t.x.*", "t.doc_slots")


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no item of the benchmark leaks.

    Rows are told by their places, not by doc_id, so rows of one id are judged each by its own text; null and empty texts
    stay, repeated rows go or stay together, an empty table gives an empty result, and docs may have any other columns.
    """
    rows = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "rows")
    found = _leaks(rows.select("_row", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text")), benchmark, window, BROADCAST_WINDOWS)
    bad = written(found.select("_row").distinct(), "leaked")
    return rows.join(bad, "_row", "left_anti").select("_doc.*")


def op5_decontam(spark, sf_dir: str) -> DataFrame:
    """Each document and item of benchmark that leaks into it, by whole texts. Null and empty texts and items have no window, repeated rows are judged alike, empty tables give an empty result; see leaks."""
    found = leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", *(F.col(c).cast("long").alias(c) for c in ("n_windows", "item_windows", "n_slots", "n_changed", "longest_run")), "kind")


def _sql_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


#: Tokens as SQL takes them: separators inside numbers are put away (each rule twice, as matches don't overlap), numbers set
#: apart, and the text cut at everything else.
_SQL_CUT = "coalesce(text, '')"
for _put, _sep in ((4, "."), (5, ",")) * 2:
    _SQL_CUT = f"regexp_replace({_SQL_CUT}, '([0-9])[{_sep}]([0-9])', '\\1' || chr({_put}) || '\\2', 'g')"
_SQL_CUT = f"regexp_replace({_SQL_CUT}, '([0-9][0-9\\x04\\x05]*)', ' \\1 ', 'g')"
_SQL_CUT = f"list_filter(string_split_regex({_SQL_CUT}, '[^\\p{{L}}\\p{{N}}\\x04\\x05]+'), lambda w: w <> '')"
_SQL_SHAPE = f"""list_transform(ws, lambda w: CASE WHEN ascii(w) BETWEEN 48 AND 57 OR lower(w) IN {_sql_list(NUMBER_WORDS)} THEN 'n' WHEN lower(w) IN {_sql_list(NO_NAMES)} THEN CASE WHEN upper(w) = w AND length(w) > 1 THEN 'S' ELSE 's' END
  WHEN lower(w) <> w AND upper(w) = w THEN 'A' WHEN lower(w) <> w THEN 'a' ELSE '' END)"""
_SQL_TYPED = f"""list_transform(ws, lambda w, i: CASE WHEN sh[i] = 'n' THEN chr(2) || replace(replace(lower(w), chr(4), '.'), chr(5), ',')
  WHEN lower(sh[i]) <> 's' AND i > 1 AND sh[i - 1] = 'n' THEN chr(3) || lower(w)
  WHEN sh[i] = 'a' OR (sh[i] = 'A' AND (i = 1 OR sh[i - 1] NOT IN ('A', 'S')) AND (i = len(sh) OR sh[i + 1] NOT IN ('A', 'S'))) THEN chr(1) || lower(w) ELSE lower(w) END)"""
#: Names right behind names go.
_SQL_TOKENS = "list_filter(ty, lambda w, i: NOT (w[1] = chr(1) AND i > 1 AND ty[i - 1][1] = chr(1)))"
#: The text that stands for a window of the tokens x: types for values, if enough tokens are plain.
_SQL_WIN = f"""md5(array_to_string(CASE WHEN len(list_filter(x, lambda w: w >= chr(4))) >= least(n, {LEAST_PLAIN}) THEN list_transform(x, lambda w: CASE WHEN w < chr(4) THEN w[1] ELSE w END) ELSE x END, ' '))"""
_SQL_TEN = f"list(w) OVER (PARTITION BY {{}} ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)"
OP5_SQL = f"""
WITH da AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_CUT} AS ws FROM documents), db AS (SELECT *, {_SQL_SHAPE} AS sh FROM da), dc AS (SELECT r, doc_id, {_SQL_TYPED} AS ty FROM db), dt AS (SELECT r, doc_id, {_SQL_TOKENS} AS tok FROM dc),
ba AS (SELECT DISTINCT item_id, {_SQL_CUT} AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE item_id IS NOT NULL), bb AS (SELECT *, {_SQL_SHAPE} AS sh FROM ba), bc AS (SELECT item_id, {_SQL_TYPED} AS ty FROM bb), bd AS (SELECT item_id, {_SQL_TOKENS} AS tok FROM bc),
bt AS (SELECT row_number() OVER () AS b, item_id, tok, least(len(tok), {WINDOW}) AS n FROM bd WHERE len(tok) > 0),
bu AS (SELECT b, item_id, n, len(tok) - n + 1 AS item_windows, unnest(tok) AS w, unnest(range(len(tok))) AS p FROM bt),
bx AS (SELECT item_id, n, item_windows, p, {_SQL_TEN.format("b")} AS x FROM bu),
b AS (SELECT item_id, n, p, item_windows, {_SQL_WIN} AS win, list_filter(x, lambda w: w < chr(4)) AS bs FROM bx WHERE len(x) = n),
du AS (SELECT r, unnest(tok) AS w, unnest(range(len(tok))) AS p FROM dt),
dx AS (SELECT r, n, p, ten[1:n] AS x FROM (SELECT r, p, {_SQL_TEN.format("r")} AS ten FROM du), (SELECT DISTINCT n FROM b) AS lens WHERE len(ten) >= n),
dw AS (SELECT r, n, p, {_SQL_WIN} AS win, list_filter(x, lambda w: w < chr(4)) AS ds FROM dx),
met AS (SELECT DISTINCT dw.r, b.item_id, b.item_windows, b.p, dw.p - b.p AS off, bs, ds FROM dw JOIN b ON dw.n = b.n AND dw.win = b.win),
pr AS (SELECT r, item_id, off, p, unnest(bs) AS v, unnest(ds) AS u FROM met),
jd AS (SELECT *, count(*) OVER (PARTITION BY r, item_id, off, v) > 1 OR count(*) OVER (PARTITION BY r, item_id, off, u) > 1 AS broken FROM (SELECT DISTINCT r, item_id, off, v, u FROM pr)),
hd AS (SELECT r, item_id, off, p, bool_or(broken) AS broken, bool_or(v <> u) AS changed FROM pr JOIN jd USING (r, item_id, off, v, u) GROUP BY ALL),
gd AS (SELECT met.r, met.item_id, met.off, met.p, item_windows, coalesce(changed, false) AS changed FROM met LEFT JOIN hd USING (r, item_id, off, p) WHERE NOT coalesce(broken, false)),
ru AS (SELECT r, item_id, off, max(n) AS longest FROM (SELECT r, item_id, off, count(*) AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY r, item_id, off ORDER BY p) AS k FROM gd WHERE NOT changed) GROUP BY r, item_id, off, k) GROUP BY ALL),
sl AS (SELECT r, item_id, off, count(*) AS n_slots, count(*) FILTER (v <> u) AS n_changed FROM jd WHERE NOT broken GROUP BY ALL),
ln AS (SELECT r, item_id, off, max(item_windows) AS item_windows, count(*) AS n_windows FROM gd GROUP BY ALL),
o AS (SELECT r, item_id, CAST(sum(n_windows) AS BIGINT) AS n_windows, CAST(max(item_windows) AS BIGINT) AS item_windows, CAST(sum(coalesce(n_slots, 0)) AS BIGINT) AS n_slots,
  CAST(sum(coalesce(n_changed, 0)) AS BIGINT) AS n_changed, CAST(max(coalesce(longest, 0)) AS BIGINT) AS longest_run FROM ln LEFT JOIN sl USING (r, item_id, off) LEFT JOIN ru USING (r, item_id, off) GROUP BY r, item_id)
SELECT doc_id, item_id, n_windows, item_windows, n_slots, n_changed, longest_run, CASE WHEN n_changed > 0 THEN 'reparameterised' WHEN longest_run >= item_windows THEN 'exact' ELSE 'partial' END AS kind
FROM o JOIN dt USING (r) WHERE 100 * n_windows >= {LEAST_PERCENT} * item_windows OR n_windows >= {LEAST_WINDOWS} OR longest_run >= {LEAST_RUN}
"""
