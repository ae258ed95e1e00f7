"""Secret scans with multipart credential linking.

Strong patterns (assignments, access ids, hex runs) are reported wherever they match. Weak parts (identifiers, blobs,
endpoints) are reported only where complementary parts co-occur: the spans are interval-joined within scopes of SCOPE
characters, and a weak part stays if the parts near it complete a credential. All of it is built-in functions: splitting
a text at a pattern gives the gaps between matches, and running sums of gaps and lengths give the places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, written

#: The patterns of the strong kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of 20 or 24 characters and more is what the open-ended runs leave once shorter ones are dropped.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i)(user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}"""
BLOB = r"[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""(?i)(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\x20\x09-\x0D"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,}"""

#: kind, pattern, lower-case texts of which a match has one, role, strong. The order is that of spans with equal starts.
KINDS = (
    ("assign", ASSIGN, ("passw", "secret", "token", "api"), "secret", True),
    ("access", ACCESS, ("akia",), "identifier", True),
    ("hex", HEX, (), "secret", True),
    ("ident", IDENT, ("user", "login", "account", "client", "access"), "identifier", False),
    ("blob", BLOB, (), "secret", False),
    ("endpoint", ENDPOINT, ("://", "host", "endpoint", "server"), "endpoint", False),
)
ASSIGN_LEAST = 6
SCOPE = 400


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _has(kind: int) -> Column:
    _, pattern, hints, _, _ = KINDS[kind]
    found = _text().rlike(pattern)
    for k, hint in enumerate(hints):
        hinted = F.contains(F.lower(_text()), F.lit(hint)) if not k else hinted | F.contains(F.lower(_text()), F.lit(hint))
    return hinted & found if hints else found


def _matches(kind: int) -> Column:
    """For each match of a kind: its number, the kind, the characters between it and the match before, its length, and whether it counts."""
    name, pattern, _, _, _ = KINDS[kind]
    parts = [F.split(_text(), pattern, -1).alias("gap"), F.regexp_extract_all(_text(), F.lit(pattern), F.lit(0)).alias("all")]
    if name == "assign":
        parts.append(F.regexp_extract_all(_text(), F.lit(pattern), F.lit(2)).alias("value"))
    zipped = F.filter(F.arrays_zip(*parts), lambda e: e["all"].isNotNull())

    def row(e: Column, i: Column) -> Column:
        ok = F.lit(True)
        if name == "assign":
            ok = F.length(e["value"]) >= ASSIGN_LEAST
        elif name == "blob":
            ok = e["all"].rlike("[0-9]") & e["all"].rlike("[G-Zg-z+/]")
        return F.struct(i.alias("i"), F.lit(kind).alias("kind"), F.length(e["gap"]).alias("gap"), F.length(e["all"]).alias("len"), ok.alias("ok"))

    none = F.array().cast("array<struct<i:int,kind:int,gap:int,len:int,ok:boolean>>")
    return F.when(_has(kind), F.transform(zipped, row)).otherwise(none)


def found_matches() -> Column:
    return F.concat(*map(_matches, range(len(KINDS))))


def linked_spans(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """From rows (_row, _found): _row, kind, start, end of every strong span, and of each weak one that the parts near it complete."""
    order = Window.partitionBy("_row", "kind").orderBy("i")
    each = rows.select("_row", F.explode("_found").alias("m")).select("_row", "m.*")
    end = F.sum(F.col("gap") + F.col("len")).over(order)
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).filter("ok").select("_row", "kind", "start", "end")
    roles = {"identifier": 1, "secret": 2, "endpoint": 4}
    role = F.element_at(F.array(*(F.lit(roles[k[3]]) for k in KINDS)), F.col("kind") + 1)
    strong = F.element_at(F.array(*(F.lit(k[4]) for k in KINDS)), F.col("kind") + 1)
    weak = each.filter(~strong).select("_row", "kind", "start", "end", role.alias("role"))
    # A part stands in all the scope cells that it covers and in one more at either end, a weak span in all that it covers: as many as its length needs.
    first, last = F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope)
    parts = each.select(F.col("_row"), F.explode(F.sequence(first - 1, last + 1)).alias("cell"), F.col("start").alias("_s"), F.col("end").alias("_e"), role.alias("_role"))
    weak = weak.withColumn("cell", F.explode(F.sequence(first, last)))
    near = (F.col("_s") - F.col("end") <= scope) & (F.col("start") - F.col("_e") <= scope) & (F.col("role") != F.col("_role"))
    seen = weak.join(parts, ["_row", "cell"]).filter(near).groupBy("_row", "kind", "start", "end", "role").agg(F.bit_or("_role").alias("near"))
    # An identifier needs a secret; a secret needs an identifier or an endpoint; an endpoint needs both of the others.
    enough = F.when(F.col("role") == 1, F.col("near").bitwiseAND(2) > 0).when(F.col("role") == 2, F.col("near").bitwiseAND(5) > 0).otherwise(F.col("near").bitwiseAND(3) == 3)
    return each.filter(strong).unionByName(seen.filter(enough).select("_row", "kind", "start", "end"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and spans (array of kind, start, end; by start, then kind) of each row; places are in code points, end exclusive.

    Null and empty texts have no spans; repeated rows are scanned alike; a text may be of any length; an empty table gives
    an empty result; columns other than doc_id and text are ignored. The matches of all rows are written once to the
    shared folder, so the text is scanned once.
    """
    rows = written(docs.select("doc_id", found_matches().alias("_found"), F.monotonically_increasing_id().alias("_row")), "secrets")
    spans = linked_spans(rows, scope).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    out = rows.select("_row", "doc_id").join(spans, "_row", "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def redact_secrets(docs: DataFrame, scope: int = SCOPE, mark: str = "<secret>") -> DataFrame:
    """docs with each reported span of text replaced by mark (overlapping spans by one); rows without a span stay as they are.

    Only rows with a match are written and joined; the others pass by. Null texts stay null.
    """
    any_match = _has(0)
    for k in range(1, len(KINDS)):
        any_match = any_match | _has(k)
    names = docs.columns
    hits = written(docs.filter(any_match).select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_doc"), found_matches().alias("_found"), F.monotonically_increasing_id().alias("_row")), "redact")
    order = Window.partitionBy("_row").orderBy("start", "end")
    so_far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = linked_spans(hits, scope).withColumn("_open", so_far)
    spans = spans.withColumn("_new", F.when(F.col("_open").isNull() | (F.col("start") > F.col("_open")), 1).otherwise(0))
    spans = spans.withColumn("_run", F.sum("_new").over(order)).groupBy("_row", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.withColumn("_from", F.coalesce(F.lag("end").over(Window.partitionBy("_row").orderBy("start")), F.lit(0)))
    spans = spans.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "_from"))).alias("_cut"))
    text = F.col("_doc")["text"]
    kept = F.concat(F.array_join(F.transform("_cut", lambda c: F.concat(F.substring(text, (c["_from"] + 1).cast("int"), (c["start"] - c["_from"]).cast("int")), F.lit(mark))), ""), F.substring(text, (F.element_at("_cut", -1)["end"] + 1).cast("int"), F.length(text)))
    done = hits.join(spans, "_row", "left").withColumn("_text", F.when(F.col("_cut").isNull(), text).otherwise(kept))
    done = done.select(*(F.col("_text").alias("text") if c == "text" else F.col("_doc")[c].alias(c) for c in names))
    return docs.filter(~any_match).unionByName(done)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Spans of each whole text of documents. A null text has none, repeated rows are scanned each, texts may be of any length, an empty table gives an empty result."""
    out = scan_secrets(documents(spark, sf_dir))
    name = F.array(*(F.lit(k[0]) for k in KINDS))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k][0]}")

    counts = [count(k) for k in range(3)]
    return out.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_kind(kind: int) -> str:
    name, pattern, _, role, strong = KINDS[kind]
    p = "'" + pattern.replace("'", "''") + "'"
    ok = {"assign": f"length(regexp_extract(m, {p}, 2)) >= {ASSIGN_LEAST}", "blob": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[G-Zg-z+/]')"}.get(name, "true")
    return f"""SELECT r, {kind} AS kind, '{role}' AS role, {strong} AS strong, e - length(m) AS s, e, {ok} AS ok FROM (SELECT r, m, i, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e
  FROM (SELECT r, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (SELECT r, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gs FROM d WHERE regexp_matches(t, {p}))))"""


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(_sql_kind(k) for k in range(len(KINDS)))}),
b AS (SELECT r, kind, role, strong, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM a WHERE ok),
w AS (SELECT x.r, x.kind, x.s, x.e, x.role, list_distinct(list(y.role)) AS near FROM b x JOIN b y ON x.r = y.r AND x.role <> y.role AND y.s - x.e <= {SCOPE} AND x.s - y.e <= {SCOPE} WHERE NOT x.strong GROUP BY ALL),
k AS (SELECT r, kind, s, e FROM b WHERE strong UNION ALL SELECT r, kind, s, e FROM w WHERE CASE role WHEN 'identifier' THEN list_contains(near, 'secret') WHEN 'secret' THEN len(near) > 0 ELSE len(near) = 2 END),
n AS (SELECT r, kind, s, e, (['{"', '".join(x[0] for x in KINDS)}'])[kind + 1] || ':' || s || ':' || e AS x FROM k),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY s, kind) AS spans FROM n GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""
