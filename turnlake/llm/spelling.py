"""Spelling variants of a vocabulary: words one code point apart, found without pairs of words.

A word with one place left open is a wildcard group (place, what stands before it, what stands behind): its words differ
by replacing that place, and a group has no more words than the alphabet has letters. Each member reads off the group's
size and its two most frequent words, so it knows how many replacements it has there and which other word is the most
frequent. A word with one place deleted joins the vocabulary; a hit tells both words of each other. Counts and best words
of a word are then summed up over its groups and hits.

A word of m letters has m groups and m deletions. Of words of more than LONG letters these are no texts but hashes of 127
bits, each made from the one of the whole word, so that they take room in proportion to the word, not to its square.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, documents, forget, written
from .url_filters import LOWER, UPPER

#: Fixed by the data's contract: what a run is, and which of them lose a letter.
RUN_CLASS, DELETED = "A-Za-z\\u00C0-\\u00FF", 31
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Letters of words whose groups are texts at most.
LONG = 64
#: Hashes are polynomials of the letters at BASE, modulo a prime.
PRIME, BASE = (1 << 127) - 1, 0x3C6EF372FE94F82BA54FF53A5F1D36F1
#: Hashes that are sent on at a time.
HASHES_AT_ONCE = 20_000


def runs_of(text: Column, least: int = LEAST_LENGTH) -> Column:
    """The maximal runs of at least so many letters in a text, in order, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"[{RUN_CLASS}]{{{least},}}"), F.lit(0))


def without(word: Column, place: Column) -> Column:
    """word without the code point at a place, from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of docs (doc_id, text): runs, of which a hash of the document's id and the run deletes a letter from one in DELETED.

    A null text has no runs; a null id counts as the text ''; repeated rows count again; an empty table gives an empty
    result; other columns are ignored. A run that is too short can't become a word, so it is passed over from the start.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs_of(F.col("text"), least_length)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    hashed = runs.select("run", h.alias("h"))
    word = F.when(F.col("h") % DELETED == 0, without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _rank(n: Column, word: Column) -> Column:
    """Less for more frequent words, of equals for the lesser in code-point order."""
    return F.struct((-n).alias("less"), word.alias("word"))


def replacements(words: DataFrame) -> DataFrame:
    """word, near, best: of each wildcard group with other words, how many there are and the most frequent of them."""
    place = F.explode(F.sequence(F.lit(0), F.length("word") - 1))
    open_ = words.select("word", "n", place.alias("place"))
    # One sign that no word has stands for the open place, so the key is place, prefix and suffix in one.
    key = F.concat(F.substring(F.col("word"), F.lit(1), F.col("place")), F.lit("*"), F.substring(F.col("word"), F.col("place") + 2, F.length("word")))
    rows = open_.select(key.alias("key"), "word", "n")
    return _others(rows)


def _others(rows: DataFrame) -> DataFrame:
    """word, near, best from rows (key, word, n) of groups: for each word how many others its group has, and the most frequent of them."""
    order = Window.partitionBy("key").orderBy(F.desc("n"), "word")
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.struct("n", "word")
    groups = rows.select("word", F.count(F.lit(1)).over(Window.partitionBy("key")).alias("size"), F.first(top).over(all_).alias("one"), F.nth_value(top, 2).over(all_).alias("two")).filter("size > 1")
    other = F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one"))
    return groups.select("word", (F.col("size") - 1).alias("near"), _rank(other["n"], other["word"]).alias("best"))


def deletions(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, near, best, for both words of each hit of a word's deletions in the vocabulary."""
    cut = F.array_distinct(F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda k: without(F.col("word"), k)))
    longer = words.filter(F.length("word") > least_length).select(F.explode(cut).alias("short"), F.col("word").alias("long"), F.col("n").alias("long_n"))
    return _told(longer.join(words.select(F.col("word").alias("short"), F.col("n").alias("short_n")), "short"))


def _told(hits: DataFrame) -> DataFrame:
    """word, near, best for both words of hits (short, short_n, long, long_n)."""
    both = F.array(F.struct(F.col("long").alias("word"), _rank(F.col("short_n"), F.col("short")).alias("best")), F.struct(F.col("short").alias("word"), _rank(F.col("long_n"), F.col("long")).alias("best")))
    return hits.select(F.explode(both).alias("x")).select("x.word", F.lit(1).cast("long").alias("near"), "x.best")


def _hashes(word: str, only_whole: bool):
    """(kind, hash) of a word: w, the whole; g, with each place open; d, with each place deleted (each hash once)."""
    letters, up = [ord(c) for c in word], [1]
    for _ in letters:
        up.append(up[-1] * BASE % PRIME)
    before = [0]
    for c, u in zip(letters, up, strict=False):
        before.append((before[-1] + c * u) % PRIME)
    whole = before[-1]
    yield "w", whole
    if only_whole:
        return
    for c, u in zip(letters, up, strict=False):
        yield "g", (whole - c * u) % PRIME
    behind, last = 0, None
    for k in range(len(letters) - 1, -1, -1):
        # Deleting any letter of a run of equal ones gives the same word.
        if letters[k] != last:
            yield "d", (before[k] + behind * up[k]) % PRIME
        behind, last = (letters[k] + behind * BASE) % PRIME, letters[k]


def long_near(words: DataFrame) -> DataFrame:
    """word, near, best of the pairs whose longer word has more than LONG letters. Words go by numbers in their order, and are named again at the end."""
    bounded_batches(words.sparkSession)
    few = words.filter(F.length("word") >= LONG)
    numbered = written(few.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "long")

    def run(batches):
        def sent(rows):
            kind, key, id_, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(key, pa.binary()), pa.array(id_, pa.int64()), pa.array(n, pa.int64())], names=["kind", "key", "id", "n"])

        rows = []
        for batch in batches:
            for word, n, id_ in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "id")), strict=True):
                for kind, h in _hashes(word, len(word) <= LONG):
                    rows.append((kind, (len(word) - (kind == "d")).to_bytes(8) + h.to_bytes(16), id_, n))
                    if len(rows) >= HASHES_AT_ONCE:
                        yield sent(rows)
                        rows = []
        if rows:
            yield sent(rows)

    keys = written(numbered.mapInArrow(run, "kind string, key binary, id long, n long"), "hashes")
    groups = _others(keys.filter("kind = 'g'").select("key", F.col("id").alias("word"), "n"))
    short = keys.filter("kind = 'w'").select("key", F.col("id").alias("short"), F.col("n").alias("short_n"))
    hits = keys.filter("kind = 'd'").select("key", F.col("id").alias("long"), F.col("n").alias("long_n")).join(short, "key")
    near = groups.unionByName(_told(hits)).groupBy("word").agg(F.sum("near").alias("near"), F.min("best").alias("best"))
    named = lambda c: numbered.select(F.col("id").alias(c), F.col("word").alias(f"_{c}"))
    near = near.select("word", "near", F.col("best.less").alias("less"), F.col("best.word").alias("best")).join(named("word"), "word").join(named("best"), "best")
    out = written(near.select(F.col("_word").alias("word"), "near", F.struct("less", F.col("_best").alias("word")).alias("best")), "long_near")
    forget(numbered, keys)
    return out


def forms(words: DataFrame, least_length: int = LEAST_LENGTH, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form and form_n of a vocabulary (word, n) with each word once.

    form is the near word of largest n, of equals the least in code-point order, if that n is `times` the word's or more;
    form_n is its n. Words shorter than least_length take part, but lose no letter to become a shorter one.
    """
    short = words.filter(F.length("word") <= LONG)
    near = replacements(short).unionByName(deletions(short, least_length)).unionByName(long_near(words))
    near = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.word").alias("_form"), (-F.col("best.less")).alias("_n"))
    ok = F.col("_n") >= times * F.col("n")
    return out.select("word", "n", "n_near", F.when(ok, F.col("_form")).alias("form"), F.when(ok, F.col("_n")).alias("form_n"))


def roots(found: DataFrame, times: int = TIMES) -> DataFrame:
    """found (word, n, n_near, form, form_n) with root: the last of the forms from word on, or word itself.

    Every form is `times` as frequent as its word, so a chain has at most log(largest n) steps; each round doubles the
    steps that are known. `found` is read several times: it should be a written table.
    """
    steps, reach, most = 0, 1, found.agg(F.max("form_n")).first()[0] or 0
    while reach * times <= most:
        steps, reach = steps + 1, reach * times
    links = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    known, made = 1, []
    while known < steps:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
        made.append(links)
        known *= 2
    forget(*made[:-1])
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of docs; see vocabulary, forms and roots. The vocabulary and the forms are written once."""
    words = written(vocabulary(docs), "words")
    found = written(forms(words), "forms")
    forget(words)
    return roots(found).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Words of all whole texts of documents; null texts have none, repeated rows count, an empty table gives an empty result."""
    return variants(documents(spark, sf_dir))


OP13_SQL = f"""
WITH RECURSIVE steps AS (SELECT n, n AS c, 0 AS k FROM range(256) AS r(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
tok AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
one AS (SELECT id, run, count(*) AS k, regexp_extract_all(hex(encode(id || ':' || run)), '..') AS x FROM tok WHERE length(run) >= {LEAST_LENGTH} GROUP BY id, run),
hsh AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(x, lambda e: CAST('0x' || e AS BIGINT))), lambda a, e: xor(tab.t[(xor(a, e) & 255) + 1], a >> 8))) AS h FROM one, tab),
wrd AS (SELECT CASE WHEN h % {DELETED} = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM hsh),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM wrd WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
op AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
cut AS (SELECT word, n, i, left(word, CAST(i AS INTEGER)) AS a, substr(word, CAST(i AS INTEGER) + 2) AS b FROM op),
del AS (SELECT DISTINCT c.word, a || b AS short FROM cut c),
nr AS (SELECT x.word, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT d.word, s.word, s.n FROM del d JOIN v s ON s.word = d.short
  UNION ALL SELECT s.word, l.word, l.n FROM del d JOIN v s ON s.word = d.short JOIN v l ON l.word = d.word),
bst AS (SELECT word, count(*) AS k, max(m) AS m, min(struct_pack(less := -m, other := other)).other AS other FROM nr GROUP BY word),
fm AS (SELECT v.word, v.n, CAST(coalesce(k, 0) AS BIGINT) AS n_near, CASE WHEN m >= {TIMES} * v.n THEN other END AS form, CASE WHEN m >= {TIMES} * v.n THEN m END AS form_n FROM v LEFT JOIN bst USING (word)),
up AS (SELECT word, word AS spot, 0 AS k FROM fm UNION ALL SELECT up.word, fm.form, k + 1 FROM up JOIN fm ON fm.word = up.spot WHERE fm.form IS NOT NULL),
rt AS (SELECT word, arg_max(spot, k) AS root FROM up GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM fm JOIN rt USING (word)
"""
