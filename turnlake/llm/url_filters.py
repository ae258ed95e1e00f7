"""URL filters: rules for hosts and path prefixes, and a tree of path templates that judges what no rule fits.

Rules label the urls that they fit. Per host, paths become a tree of templates: digits in a segment count as one digit sign,
a segment stays in the tree if enough of its parent's urls have it, and the others are the wildcard `*`. Siblings whose
continuations are distributed like those of all siblings, and whose labels are too, become one branch. A template's
purity is its share of blocked among labelled urls, smoothed by its parent's, up to the host's and that of all urls;
templates of a high purity are rejected.

Urls are counted by their shapes first, so no host's urls are ever gathered; keys of many shapes or urls are joined by
broadcast, of which there are fewer than HOT_PARTS.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, join_hot, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """allow or block the urls of a host and its subdomains whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: Segments that a template tells apart; what follows is one sign.
LEVELS = 3
#: A segment is a branch of its own from so many urls on, and from one in so many of its parent's.
BRANCH_LEAST, BRANCH_PARTS = 20, 100
#: Siblings are alike if at most this share of a branch's urls goes on otherwise than all siblings' do (in percent).
APART_PERCENT = 25
#: and if the share of blocked labels is within so many standard errors.
ERRORS = 3.0
#: Urls of the parent's purity that count beside a template's own labels, and the purity from which a template is rejected.
PARENT_WEIGHT, REJECT = 10.0, 0.7


def host_of(url: Column) -> Column:
    """From behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; '' for null and urls without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; '' for null and urls without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def rule_of(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """The longest rule that fits, of equals the first, as a struct of name and verdict; null if none fits."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: len(r.name)):
        out = F.when(fits(r, host, path), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


SEGMENTS, BRANCHES, MERGED = ([f"{x}{k}" for k in range(1, LEVELS + 1)] for x in "stm")
SHAPE, TEMPLATE = ["host", *SEGMENTS, "more"], ["host", *BRANCHES, "more"]


def shape_of(host: Column, path: Column) -> list[Column]:
    """The host, the first segments (`/` and the text, each run of digits as `#`; '' behind the last), and whether more follow."""
    parts = F.split(path, "/")
    sign = lambda k: F.coalesce(F.concat(F.lit("/"), F.regexp_replace(F.get(parts, F.lit(k)), "[0-9]+", "#")), F.lit(""))
    return [host.alias("host"), *(sign(k).alias(s) for k, s in enumerate(SEGMENTS, 1)), F.when(F.size(parts) > LEVELS + 1, "/..").otherwise("").alias("more")]


def branched(shapes: DataFrame) -> DataFrame:
    """shapes (SHAPE, n, labelled, blocked) with BRANCHES: the segment where it is a branch, else `/*`; '' behind the last.

    It goes level by level, as the parent of a segment is a template. A parent has at most BRANCH_PARTS branches.
    """
    out, parent, total = shapes, ["host"], shapes.count()
    for segment, branch in zip(SEGMENTS, BRANCHES, strict=True):
        counts = written(out.filter(F.col(segment) != "").groupBy(*parent, segment).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_shapes")), "segments")
        parents = written(counts.groupBy(*parent).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_kids")), "parents")
        often = join_hot(counts.filter(F.col("_n") >= BRANCH_LEAST), parents, parent, "_kids", counts.count())
        kept = often.filter(F.col("_n") * BRANCH_PARTS >= F.col("_all")).select(*parent, segment, "_shapes", F.col(segment).alias(branch))
        kept = written(kept, "branches")
        placed = join_hot(out, kept, [*parent, segment], "_shapes", total, "left")
        placed = written(placed.withColumn(branch, F.coalesce(branch, F.when(F.col(segment) == "", "").otherwise("/*"))), "placed")
        forget(counts, parents, kept, *([out] if out is not shapes else []))
        out, parent = placed, [*parent, branch]
    return out


def merged(templates: DataFrame) -> DataFrame:
    """templates (TEMPLATE, n, labelled, blocked) with MERGED: `/~` for branches that are like all their siblings, else the branch.

    A host has at most (BRANCH_PARTS + 1) ** LEVELS templates, however many urls it has, so they are windows of one task.
    """
    out, parent = templates, ["host"]
    for k, (branch, name) in enumerate(zip(BRANCHES, MERGED, strict=True)):
        tail = F.concat(*(F.col(c) for c in [*BRANCHES[k + 1 :], "more"]))
        # What ends here is no branch, but counts apart from the others.
        up = [*parent, "_end"]
        over = lambda *more: Window.partitionBy(*up, *more)  # noqa: B023, E731
        wide = lambda c: c.cast("decimal(38,0)")
        rows = out.withColumn("_end", F.col(branch) == "").withColumn("_tail", tail)
        rows = rows.withColumns({"_N": F.sum("n").over(over()), "_L": F.sum("labelled").over(over()), "_B": F.sum("blocked").over(over())})
        rows = rows.withColumns({"_n": F.sum("n").over(over(branch)), "_l": F.sum("labelled").over(over(branch)), "_b": F.sum("blocked").over(over(branch))})
        rows = rows.withColumn("_Nt", F.sum("n").over(over("_tail")))
        cell = over(branch, "_tail")
        rows = rows.withColumns({"_nt": F.sum("n").over(cell), "_r": F.row_number().over(cell.orderBy(*TEMPLATE))})
        once = lambda c: F.sum(F.when(F.col("_r") == 1, c)).over(over(branch))  # noqa: B023, E731
        apart = F.abs(wide(F.col("_nt")) * wide(F.col("_N")) - wide(F.col("_Nt")) * wide(F.col("_n")))
        rows = rows.withColumns({"_apart": once(apart), "_seen": once(F.col("_Nt"))})
        # Twice the total variation, times both counts, in whole numbers.
        distance = F.col("_apart") + wide(F.col("_n")) * wide(F.col("_N") - F.col("_seen"))
        same_tails = distance * 100 <= 2 * APART_PERCENT * (wide(F.col("_N")) * wide(F.col("_n")))
        share = (F.col("_B") + 1.0) / (F.col("_L") + 2.0)
        off = F.col("_b") - F.col("_l") * share
        same_labels = (F.col("_l") == 0) | (off * off <= ERRORS * ERRORS * (F.col("_l") * (share * (1.0 - share))))
        out = rows.withColumn(name, F.when((F.col(branch) != "") & same_tails & same_labels, "/~").otherwise(F.col(branch)))
        out = out.select(*templates.columns, *MERGED[: k + 1])
        parent = [*parent, name]
    return out


def purities(templates: DataFrame, labelled: int, blocked: int) -> DataFrame:
    """templates with purity: blocked among labelled urls of the merged template, smoothed by its parents up to the host and all urls.

    All urls count as half blocked at most, so that a host without labels is not rejected for the labels of others.
    """
    p = F.lit(min(0.5, (blocked + 1.0) / (labelled + 2.0)))
    keys = ["host", *MERGED, "more"]
    for k in range(1, len(keys) + 1):
        over = Window.partitionBy(*keys[:k])
        p = (F.sum("blocked").over(over) + PARENT_WEIGHT * p) / (F.sum("labelled").over(over) + PARENT_WEIGHT)
    return templates.withColumn("purity", p)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each of pages (page_id, url), and the reason of the verdict: rule, template or none.

    Where no rule fits, urls of templates whose purity is REJECT or more are blocked and all others allowed. A null url and
    one without `://` have an empty host and path; they are judged as one template of the empty host. Texts may be of any
    length; repeated and null page ids are rows like any other; an empty table gives an empty result; other columns are
    ignored. The rules are constants of the plan.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_rule", rule_of(rules, F.col("host"), F.col("path")) if rules else F.lit(None).cast("struct<name:string,verdict:string>"))
    known, blocked = F.col("_rule").isNotNull().cast("long"), F.coalesce(F.col("_rule.verdict") == "block", F.lit(False)).cast("long")
    shapes = rows.select(*shape_of(F.col("host"), F.col("path")), known.alias("labelled"), blocked.alias("blocked"))
    shapes = written(shapes.groupBy(*SHAPE).agg(F.count(F.lit(1)).alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "shapes")
    placed = branched(shapes)
    sums = shapes.agg(F.sum("n"), F.sum("labelled"), F.sum("blocked")).first()
    templates = placed.groupBy(*TEMPLATE).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.count(F.lit(1)).alias("_shapes"))
    judged = purities(merged(templates.select(*TEMPLATE, "n", "labelled", "blocked", "_shapes")), sums[1] or 0, sums[2] or 0)
    bad = written(judged.filter(F.col("purity") >= REJECT).select(*TEMPLATE, "_shapes"), "rejected")
    few = written(join_hot(placed.filter(F.col("labelled") < F.col("n")), bad, TEMPLATE, "_shapes", placed.count()).select(*SHAPE, "n", F.lit("block").alias("_bad")), "rejected_shapes")
    forget(shapes, placed, bad)
    free = rows.filter("_rule IS NULL").select("page_id", "host", "path", *shape_of(F.col("host"), F.col("path"))[1:])
    free = join_hot(free, few, SHAPE, "n", sums[0] or 0, "left")
    found = free.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("_bad", F.lit("allow")).alias("verdict"), F.when(F.col("_bad").isNull(), "none").otherwise("template").alias("reason"))
    return rows.filter("_rule IS NOT NULL").select("page_id", "host", "path", F.col("_rule.name").alias("rule"), F.col("_rule.verdict").alias("verdict"), F.lit("rule").alias("reason")).unionByName(found)


def op12_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every url of pages, by RULES and the templates that they label; null urls and repeated pages stay, an empty table gives an empty result."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def judge_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same as DuckDB SQL over pages."""
    fit = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    cases = lambda of: "CASE " + " ".join(f"WHEN {fit(r)} THEN '{of(r)}'" for r in sorted(rules, key=lambda r: -len(r.name))) + " END"
    signs = ", ".join(f"coalesce('/' || regexp_replace(x[{k + 1}], '[0-9]+', '#', 'g'), '') AS {s}" for k, s in enumerate(SEGMENTS, 1))
    parts = [f"""u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {cases(lambda r: r.name)} AS rule, {cases(lambda r: r.verdict)} AS known, string_split(path, '/') AS x FROM u),
g AS (SELECT *, {signs}, CASE WHEN len(x) > {LEVELS + 1} THEN '/..' ELSE '' END AS more FROM r),
l0 AS (SELECT {", ".join(SHAPE)}, count(*) AS n, count(rule) AS labelled, count(*) FILTER (known = 'block') AS blocked FROM g GROUP BY ALL)"""]
    parent = ["host"]
    for k, (s, t) in enumerate(zip(SEGMENTS, BRANCHES, strict=True), 1):
        up = ", ".join(parent)
        branch = f"sum(n) OVER (PARTITION BY {up}, {s}) >= {BRANCH_LEAST} AND sum(n) OVER (PARTITION BY {up}, {s}) * {BRANCH_PARTS} >= sum(n) FILTER ({s} <> '') OVER (PARTITION BY {up})"
        parts.append(f"l{k} AS (SELECT *, CASE WHEN {s} = '' THEN '' WHEN {branch} THEN {s} ELSE '/*' END AS {t} FROM l{k - 1})")
        parent.append(t)
    parts.append(f"v0 AS (SELECT {', '.join(TEMPLATE)}, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM l{LEVELS} GROUP BY ALL)")
    parent = ["host"]
    for k, (t, m) in enumerate(zip(BRANCHES, MERGED, strict=True), 1):
        up = ", ".join([*parent, f"({t} = '')"])
        tail = " || ".join([*BRANCHES[k:], "more"])
        parts.append(f"c{k} AS (SELECT {', '.join(parent)}, {t}, {t} = '' AS e, {tail} AS tail, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM v{k - 1} GROUP BY ALL)")
        on = ", ".join([*parent, "e"])
        parts.append(f"d{k} AS (SELECT *, sum(n) OVER (PARTITION BY {on}) AS nn, sum(labelled) OVER (PARTITION BY {on}) AS ll, sum(blocked) OVER (PARTITION BY {on}) AS bb, sum(n) OVER (PARTITION BY {on}, {t}) AS nc, sum(labelled) OVER (PARTITION BY {on}, {t}) AS lc, sum(blocked) OVER (PARTITION BY {on}, {t}) AS bc, sum(n) OVER (PARTITION BY {on}, tail) AS nt FROM c{k})")
        parts.append(f"f{k} AS (SELECT {', '.join(parent)}, {t}, any_value(nn) AS nn, any_value(ll)::DOUBLE AS ll, any_value(bb)::DOUBLE AS bb, any_value(nc) AS nc, any_value(lc)::DOUBLE AS lc, any_value(bc)::DOUBLE AS bc, sum(abs(n * nn - nt * nc)) + any_value(nc) * (any_value(nn) - sum(nt)) AS apart FROM d{k} GROUP BY {', '.join(parent)}, {t})")
        parts.append(f"h{k} AS (SELECT *, (bb + 1.0::DOUBLE) / (ll + 2.0::DOUBLE) AS q FROM f{k})")
        alike = f"apart * 100 <= {2 * APART_PERCENT} * (nn * nc) AND (lc = 0 OR (bc - lc * q) * (bc - lc * q) <= {ERRORS * ERRORS}::DOUBLE * (lc * (q * (1.0::DOUBLE - q))))"
        parts.append(f"v{k} AS (SELECT v.*, CASE WHEN {t} <> '' AND {alike} THEN '/~' ELSE {t} END AS {m} FROM v{k - 1} v JOIN h{k} USING ({', '.join([*parent, t])}))")
        parent.append(m)
    p, keys = "(SELECT least(0.5::DOUBLE, (sum(blocked) + 1.0::DOUBLE) / (sum(labelled) + 2.0::DOUBLE)) FROM l0)", ["host", *MERGED, "more"]
    for k in range(1, len(keys) + 1):
        over = f"OVER (PARTITION BY {', '.join(keys[:k])})"
        parts.append(f"p{k} AS (SELECT *, (sum(blocked) {over} + {PARENT_WEIGHT}::DOUBLE * {p}) / (sum(labelled) {over} + {PARENT_WEIGHT}::DOUBLE) AS q{k} FROM {f'p{k - 1}' if k > 1 else f'v{LEVELS}'})")
        p = f"q{k}"
    parts.append(f"bad AS (SELECT {', '.join(SHAPE)} FROM l{LEVELS} SEMI JOIN (SELECT * FROM p{len(keys)} WHERE {p} >= {REJECT}::DOUBLE) USING ({', '.join(TEMPLATE)}))")
    got = "CASE WHEN b.bad THEN 'block' ELSE 'allow' END"
    return f"WITH {', '.join(parts)} SELECT page_id, host, path, rule, coalesce(known, {got}) AS verdict, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN b.bad THEN 'template' ELSE 'none' END AS reason FROM g LEFT JOIN (SELECT *, true AS bad FROM bad) b USING ({', '.join(SHAPE)})"


OP12_SQL = judge_sql()
