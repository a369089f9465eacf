"""URL filter by a path-template tree.

Each host has a tree of path segments. Segments that are variable by their
spelling (runs of digits, long hexadecimal names) become placeholders. Then,
level by level, branches whose share of blocked labels can't be told from that
of all their siblings (a two-sided test) are merged into one wildcard; branches
that differ stay. A template's purity is its share of blocked labels, smoothed
towards that of its parent (the host's towards the share of all labels), and
templates of at least ``reject`` are blocked.

Labels come from rules: a rule is a host and a path prefix, fits the host and
its subdomains, and the longest rule that fits decides the pages it fits; the
pages of a host that rules decide are what its other pages are judged by.

Everything is DataFrame functions: pages are reduced to distinct (host,
segments) before the tree is built, and one join brings verdicts back; shapes
that many pages have are joined by broadcast. The tree has as many levels as the
deepest path; a level works on the paths that reach it.

Segments are told apart by their first character, so no spelling can be taken for
a mark: ``=`` and the text, ``#`` and the text with each run of digits as 0, ``%`` for a
hexadecimal name. ``*`` is the wildcard and ``$`` the end of a path.

Defined results: a null url, or one without ``://``, has empty host and path, no
rule, and the verdict of the empty host's tree; an empty path is a template of
its own; repeated rows are judged each; an empty table gives no rows; urls of any
length are judged by all their segments; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

#: The rules (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
Z = 1.96
PRIOR = 4.0
REJECT = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments, tagged; variable ones are generalised by their spelling."""
    found = F.filter(F.split(path, "/"), lambda x: x != "")
    kind = lambda x: F.when(F.regexp_like(x, F.lit("^[0-9a-f]{8,}$")), "%").when(F.regexp_like(x, F.lit("[0-9]")), F.concat(F.lit("#"), F.regexp_replace(x, "[0-9]+", "0"))).otherwise(F.concat(F.lit("="), x))
    return F.transform(found, kind)


def smoothed(blocked: Column, labelled: Column, towards: Column, prior: float = PRIOR) -> Column:
    return (blocked + towards * prior) / (labelled + prior)


def template_tree(groups: DataFrame, z: float = Z) -> DataFrame:
    """Templates and their purity for rows (host, segments, labelled, blocked), one a distinct path shape.

    A level costs a few aggregates and joins of the shapes that reach it, never
    of pages, and is written out, so that plans don't grow from level to level.
    A shape that is alone under its template has no siblings to differ from at any
    deeper level, so its other levels are computed at once; levels end when all shapes are alone.
    """
    total = groups.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).first()
    share = (total["b"] + 1.0) / (total["n"] + 2.0)
    hosts = groups.groupBy("host").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    hosts = hosts.select("host", smoothed(F.col("b"), F.col("n"), F.lit(share)).alias("purity"))
    rows = groups.join(hosts, "host").select("host", "segments", "labelled", "blocked", F.lit("").alias("template"), "purity")
    rows, done = materialize(rows, "level"), None
    level = 0
    while done is None or not rows.isEmpty():
        level += 1
        rows = rows.withColumn("segment", F.coalesce(F.try_element_at("segments", F.lit(level)), F.lit("$")))
        branch = rows.groupBy("host", "template", "segment").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"), F.count("*").alias("m"))
        parent = branch.groupBy("host", "template").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"), F.sum("m").alias("shapes"))
        p = F.when(F.col("pn") > 0, F.col("pb") / F.col("pn"))
        differs = F.abs(F.col("b") / F.nullif(F.col("n"), F.lit(0)) - p) > z * F.sqrt(p * (1 - p) / F.nullif(F.col("n"), F.lit(0)))
        named = F.when(F.coalesce(differs, F.lit(False)) | (F.col("segment") == "$"), F.col("segment")).otherwise("*")
        kept = materialize(branch.join(parent, ["host", "template"]).withColumn("name", named).select("host", "template", "segment", "name", "n", "b", "shapes"), "branches")
        merged = kept.groupBy("host", "template", "name").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        step = kept.select("host", "template", "segment", "name", "shapes").join(merged, ["host", "template", "name"])
        template = F.concat("template", F.lit("/"), "name").alias("template")
        rows = rows.join(step, ["host", "template", "segment"]).select("host", "segments", "labelled", "blocked", template, smoothed(F.col("b"), F.col("n"), F.col("purity")).alias("purity"), "segment", "shapes")
        rows = materialize(rows, "level")
        rest = F.size("segments") - level
        alone = F.col("shapes") == 1
        deeper = F.aggregate(F.sequence(F.lit(0), F.greatest(rest, F.lit(0))), F.col("purity"), lambda x, _: smoothed(F.col("blocked"), F.col("labelled"), x))
        ended = rows.filter("segment = '$'").select("host", "segments", "template", "purity")
        ended = ended.unionAll(rows.filter(alone & (F.col("segment") != "$")).select("host", "segments", F.concat("template", F.repeat(F.lit("/*"), rest), F.lit("/$")), deeper))
        done = ended if done is None else done.unionAll(ended)
        rows = rows.filter(~alone & (F.col("segment") != "$")).drop("segment", "shapes")
    return done


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template for every page."""
    host, path = parsed(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, told = rule_of(F.col("host"), F.col("path"), rules)
    df = df.select("*", rule.alias("rule"), told.alias("told"), segments(F.col("path")).alias("segments"))
    groups = df.groupBy("host", "segments").agg(F.count("told").alias("labelled"), F.count_if(F.col("told") == "block").alias("blocked"), F.count("*").alias("pages"))
    groups = materialize(groups, "paths")
    tree = materialize(template_tree(groups).join(groups.select("host", "segments", "pages"), ["host", "segments"]), "tree")
    verdict = F.coalesce(F.col("told"), F.when(F.col("purity") >= reject, F.lit("block")).otherwise("allow"))
    return join_hot(df, tree, ["host", "segments"], "pages").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")


def judge_sql(rules: list[tuple[str, str]] = RULES, z: float = Z, prior: float = PRIOR, reject: float = REJECT) -> str:
    """The same as one DuckDB query over the view ``pages``: a level of the tree a step of the recursion."""
    rule, told = "NULL", "NULL"
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}')"
        rule, told = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {told} END"
    return f"""WITH RECURSIVE u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT page_id, host, path, {rule} AS rule, {told} AS told,
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^[0-9a-f]{{8,}}$') THEN '%' WHEN regexp_matches(x, '[0-9]') THEN '#' || regexp_replace(x, '[0-9]+', '0', 'g') ELSE '=' || x END) AS segments FROM h),
g AS (SELECT host, segments, count(told) AS labelled, count(*) FILTER (told = 'block') AS blocked FROM d GROUP BY ALL),
a AS (SELECT (coalesce(sum(blocked), 0) + 1.0) / (coalesce(sum(labelled), 0) + 2.0) AS share FROM g),
hosts AS (SELECT host, (sum(blocked) + (SELECT share FROM a) * {prior}) / (sum(labelled) + {prior}) AS purity FROM g GROUP BY host),
tree AS (
  SELECT 0 AS level, host, segments, CAST(labelled AS DOUBLE) AS labelled, CAST(blocked AS DOUBLE) AS blocked, '' AS template, CAST(purity AS DOUBLE) AS purity FROM g JOIN hosts USING (host)
  UNION ALL
  SELECT level, host, segments, labelled, blocked, template || '/' || name,
    (sum(blocked) OVER (PARTITION BY host, template, name) + purity * {prior}) / (sum(labelled) OVER (PARTITION BY host, template, name) + {prior})
  FROM (SELECT *, CASE WHEN segment = '$' OR coalesce(abs(b / nullif(n, 0) - p) > {z} * sqrt(p * (1 - p) / nullif(n, 0)), false) THEN segment ELSE '*' END AS name
    FROM (SELECT *, CASE WHEN sum(labelled) OVER w > 0 THEN sum(blocked) OVER w / sum(labelled) OVER w END AS p, sum(labelled) OVER s AS n, sum(blocked) OVER s AS b
      FROM (SELECT * REPLACE (level + 1 AS level), coalesce(segments[level + 1], '$') AS segment FROM tree WHERE level <= len(segments))
      WINDOW w AS (PARTITION BY host, template), s AS (PARTITION BY host, template, segment)))
)
SELECT page_id, d.host, path, rule, coalesce(told, CASE WHEN purity >= {reject} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM d JOIN tree r ON d.host = r.host AND d.segments = r.segments AND r.level = len(r.segments) + 1"""
