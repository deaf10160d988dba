"""URL filter by a path-template tree (DataFrame functions only).

The path of a URL is split into segments; the tree of one host has a node per prefix of
templates.  Level by level, a node with more than ``max_children`` different segments is
variable: a segment keeps its text only if it holds at least ``min_share`` of the node's
pages, else it becomes its shape (digit runs written <n>); where there are too many shapes
as well, a wildcard.  Levels go on to the last segment of the longest path.

On every level, sibling branches whose labelled share of bad pages lies within z standard
errors of the share of all pages below their parent (one-sample z test) become one branch.  A template is
rejected when its bad share, smoothed by ``strength`` pages of the corpus's own share,
is above ``max_bad``.  Explicit rules (host suffix and path prefix, longest first) go before.

Tables are long, one row per (host, prefix), so neither their columns nor the plans grow with
the levels.  Every step is an aggregate and an equi-join on (host, prefix) over distinct paths,
so repeated pages are counted before the shuffle.  `sql` is written out for ``DEPTH`` levels, as
many as the given tables have; it agrees with `judge` where no path has more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcycle.llm.common import ascii_lower, shared_dir, written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
DEPTH, MAX_CHILDREN, MIN_SHARE, Z, STRENGTH, MAX_BAD = 3, 8, 0.05, 1.96, 20.0, 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null or a URL without ://."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, "(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, "(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does.  A rule is
    host + path; its host fits itself and every subdomain, its path is a prefix."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = text.index("/")
        name, start = text[:at], text[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def _shape(seg: Column) -> Column:
    return F.regexp_replace(seg, "[0-9]+", "<n>")


def templates(paths: DataFrame, max_children: int = MAX_CHILDREN, min_share: float = MIN_SHARE) -> DataFrame:
    """Adds the template to rows with host, path and pages, one per host and path: its segments,
    each after a slash; empty for an empty path.

    Level by level, only paths with a segment left go on.  Where a node has at most
    ``max_children`` different rests below it, so has every node under it, and all of them
    keep their text: those paths are done at once."""
    spark, node_of, level = paths.sparkSession, ["host", "prefix"], 0
    own = paths.columns
    rest = F.when(F.col("path") == "", F.lit(None)).otherwise(F.regexp_replace("path", "^/", ""))
    df = written(paths.select(*own, F.lit("").alias("prefix"), rest.alias("rest")), "level0")
    folder = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}/ended"
    while True:  # tables are written, as each is read several times
        level += 1
        wide = (df.where("rest is not null").select(*node_of, "rest").distinct().groupBy(*node_of)
                .agg(F.count(F.lit(1)).alias("rests")).where(F.col("rests") > max_children).select(*node_of))
        wide = written(wide.withColumn("wide", F.lit(True)), f"wide{level}")
        df = written(df.join(wide, node_of, "left").withColumn(
            "wide", F.coalesce("wide", F.lit(False)) & F.col("rest").isNotNull()), f"level{level}")
        ended = df.where(~F.col("wide")).select(*own, F.concat("prefix", F.when(F.col("rest").isNull(), "").otherwise(
            F.concat(F.lit("/"), "rest"))).alias("template"))
        ended.write.mode("append").option("compression", "zstd").parquet(folder)
        df = df.where("wide").select(
            *own, "prefix", F.substring_index("rest", "/", 1).alias("seg"),
            F.expr("CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/') + 1) END").alias("rest"))
        seen = written(df.groupBy(*node_of, "seg").agg(F.sum("pages").alias("n")), f"seen{level}")
        node = seen.groupBy(*node_of).agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("kinds"))
        shapes = (seen.select(*node_of, _shape(F.col("seg")).alias("shape")).distinct()
                  .groupBy(*node_of).agg(F.count(F.lit(1)).alias("shapes")))
        t = (F.when((F.col("kinds") <= max_children) | (F.col("n") >= F.lit(min_share) * F.col("all_n")), F.col("seg"))
             .when(F.col("shapes") <= max_children, _shape(F.col("seg"))).otherwise(F.lit("*")))
        named = written(seen.join(node, node_of).join(shapes, node_of).select(*node_of, "seg", t.alias("t")),
                        f"named{level}")
        df = written(df.join(named, [*node_of, "seg"])
                     .select(*own, F.concat("prefix", F.lit("/"), "t").alias("prefix"), "rest"), f"next{level}")
        if df.isEmpty():
            return spark.read.schema(ended.schema).parquet(folder)


def purity(stats: DataFrame, z: float = Z, strength: float = STRENGTH) -> DataFrame:
    """From (host, template, labelled, bad), one row per template: (host, template, bad_share),
    smoothed, after similar siblings are merged.  A branch is judged by the pages below it and
    below its parent, so all levels are judged at once: one row per template and prefix."""
    stats = written(stats, "stats")
    seg = F.when(F.col("template") == "", F.array().cast("array<string>")).otherwise(
        F.split(F.expr("substr(template, 2)"), "/", -1))
    upto = lambda i: F.concat_ws("/", F.lit(""), F.slice("seg", F.lit(1), i))
    level = F.col("level")
    at = (stats.withColumn("seg", seg).withColumn("level", F.explode(F.sequence(F.lit(0), F.size("seg"))))
          .select("host", "template", "labelled", "bad", "level", upto(level).alias("prefix"),
                  upto(F.greatest(level - 1, F.lit(0))).alias("parent"), F.get("seg", level - 1).alias("t")))
    at = written(at, "prefixes")
    node = written(at.groupBy("host", "level", "prefix", "parent")
                   .agg(F.sum("labelled").alias("bn"), F.sum("bad").alias("bb")), "nodes")
    over = node.select("host", (F.col("level") + 1).alias("level"), F.col("prefix").alias("parent"),
                       F.col("bn").alias("pn"), F.col("bb").alias("pb"))
    share = F.when(F.col("pn") > 0, F.col("pb") / F.col("pn")).otherwise(F.lit(0.0))
    spread = F.when(F.col("bn") > 0, F.sqrt(share * (1 - share) / F.col("bn"))).otherwise(F.lit(0.0))
    off = F.when(F.col("bn") > 0, F.abs(F.col("bb") / F.col("bn") - share)).otherwise(F.lit(0.0))
    alike = written(node.join(over, ["host", "level", "parent"]).where(off <= F.lit(z) * spread)
                    .select("host", "level", "prefix", F.lit("~").alias("one")), "alike")
    named = (at.join(alike, ["host", "level", "prefix"], "left")
             .groupBy("host", "template", "labelled", "bad")
             .agg(F.array_sort(F.collect_list(F.struct("level", F.coalesce("one", "t").alias("m")))).alias("ms"))
             .select("host", "template", "labelled", "bad", F.concat_ws("/", F.lit(""), F.col("ms.m")).alias("merged")))
    total = F.sum("labelled")   # of the corpus: one row
    prior = stats.agg(F.when(total > 0, F.sum("bad") / total).otherwise(F.lit(0.0)).alias("prior"))
    named = written(named, "merged")
    sums = named.groupBy("host", "merged").agg(F.sum("labelled").alias("mn"), F.sum("bad").alias("mb"))
    sums = sums.withColumn("prior", prior.scalar())
    smooth = (F.col("mb") + F.lit(strength) * F.col("prior")) / (F.col("mn") + F.lit(strength))
    return named.join(sums, ["host", "merged"]).select("host", "template", smooth.alias("bad_share"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD, **tree) -> DataFrame:
    """One row per page: page_id, host, path, rule, template, bad_share, verdict.

    `labels` is (page_id, bad); several labels of one page count as bad if one is.  A null
    URL or one without :// has host and path '' and is judged like any other; a page whose
    template has no label gets the corpus's own share; repeated pages count as often as they
    are there; no label at all rejects nothing; null page_ids carry no label."""
    host, path = split_url(F.col("url"))
    p = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    known = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad")).alias("k")
    p = (p.alias("p").join(known, F.col("p.page_id") == F.col("k.page_id"), "left")
         .select("p.*", F.col("k.bad").alias("bad")))
    p = written(p, "pages")
    paths = p.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("labelled"),
                                          F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    paths = templates(paths, **tree)
    share = purity(paths.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    of_path = written(paths.select("host", "path", "template").join(written(share, "purity"), ["host", "template"]), "shares")
    p = p.select("page_id", "host", "path").join(of_path, ["host", "path"])
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_share") > max_bad, "block").otherwise("allow")
    return p.select("page_id", "host", "path", rule.alias("rule"),
                    F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"), "bad_share",
                    F.coalesce(said, own).alias("verdict"))


def sql(depth: int = DEPTH) -> str:
    """DuckDB SQL of the query's columns."""
    lv = [f"t{i}" for i in range(1, depth + 1)]
    eq = lambda a, b, ks: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in ks)
    parts = [r"""u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS a FROM pages),
u1 AS (SELECT page_id, CASE WHEN a > 0 THEN substr(url, a + 3) ELSE '' END AS rest FROM u),
u2 AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u1),
k AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
      FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
d0 AS (SELECT u2.page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, bad,
         CASE WHEN path = '' THEN [] ELSE string_split(regexp_replace(path, '^/', ''), '/') END AS seg
       FROM u2 LEFT JOIN k ON u2.page_id = k.page_id)"""]
    keys = ["host"]
    for i in range(1, depth + 1):
        ks, s = ", ".join(keys), f"s{i}"
        shape = f"regexp_replace({s}, '[0-9]+', '<n>', 'g')"
        parts += [f"e{i} AS (SELECT *, seg[{i}] AS {s} FROM d{i - 1})",
                  f"seen{i} AS (SELECT {ks}, {s}, count(*) AS n FROM e{i} WHERE {s} IS NOT NULL GROUP BY {ks}, {s})",
                  f"node{i} AS (SELECT {ks}, sum(n) AS pages, count(*) AS kinds, count(DISTINCT {shape}) AS shapes "
                  f"FROM seen{i} GROUP BY {ks})",
                  f"d{i} AS (SELECT e.*, CASE WHEN e.{s} IS NULL THEN NULL WHEN o.kinds <= {MAX_CHILDREN} OR "
                  f"x.n >= {MIN_SHARE} * o.pages THEN e.{s} WHEN o.shapes <= {MAX_CHILDREN} THEN "
                  f"{shape.replace(s, 'e.' + s)} ELSE '*' END AS t{i} FROM e{i} e LEFT JOIN seen{i} x ON "
                  f"{eq('e', 'x', [*keys, s])} LEFT JOIN node{i} o ON {eq('e', 'o', keys)})"]
        keys.append(f"t{i}")
    ts = ", ".join(lv)
    parts.append(f"m{depth + 1} AS (SELECT host, {ts}, count(bad)::DOUBLE AS labelled, coalesce(sum(bad), 0)::DOUBLE AS bad, "
                 + ", ".join(f"t{i} AS m{i}" for i in range(1, depth + 1)) + f" FROM d{depth} GROUP BY host, {ts})")
    for i in range(depth, 0, -1):
        par = ", ".join(["host", *[f"m{j}" for j in range(1, i)]])
        parts += [f"w{i} AS (SELECT *, sum(labelled) OVER (PARTITION BY {par}, m{i}) AS bn, sum(bad) OVER (PARTITION BY "
                  f"{par}, m{i}) AS bb, sum(labelled) OVER (PARTITION BY {par}) AS pn, sum(bad) OVER (PARTITION BY {par}) "
                  f"AS pb FROM m{i + 1})",
                  f"v{i} AS (SELECT *, CASE WHEN pn > 0 THEN pb / pn ELSE 0 END AS sh FROM w{i})",
                  f"m{i} AS (SELECT * EXCLUDE (bn, bb, pn, pb, sh, m{i}), CASE WHEN m{i} IS NOT NULL AND "
                  f"(CASE WHEN bn > 0 THEN abs(bb / bn - sh) ELSE 0 END) <= {Z} * "
                  f"(CASE WHEN bn > 0 THEN sqrt(sh * (1 - sh) / bn) ELSE 0 END) THEN '~' ELSE m{i} END AS m{i} FROM v{i})"]
    ms = ", ".join(["host", *[f"m{i}" for i in range(1, depth + 1)]])
    parts.append(f"pr AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(bad) / sum(labelled) ELSE 0 END AS p FROM m1)")
    parts.append(f"q AS (SELECT host, {ts}, (sum(bad) OVER g + {STRENGTH} * p) / (sum(labelled) OVER g + {STRENGTH}) AS share "
                 f"FROM m1, pr WINDOW g AS (PARTITION BY {ms}))")
    whens = {"rule": "", "verdict": ""}
    for what, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        at = text.index("/")
        cond = f"(d.host = '{text[:at]}' OR ends_with(d.host, '.{text[:at]}')) AND starts_with(path, '{text[at:]}')"
        whens["rule"] += f" WHEN {cond} THEN '{text}'"
        whens["verdict"] += f" WHEN {cond} THEN '{what}'"
    return ("WITH " + ",\n".join(parts) + f"\nSELECT page_id, d.host, path, CASE{whens['rule']} END AS rule, "
            f"CASE{whens['verdict']} WHEN share > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict "
            f"FROM d{depth} d JOIN q ON {eq('d', 'q', ['host', *lv])}")
