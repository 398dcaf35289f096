"""URL filters: rules by host and path, and a path-template tree for what no rule decides.

Each host has a tree of path segments. Segments with numbers become typed wildcards; where a node has many children that are
each rare, those become one wildcard; siblings whose shares of bad labels do not differ significantly are merged;
those without labels show no likeness and stay. Labels are the verdicts of rules, on whichever pages they fit, so that they
differ within a host. A template is rejected when its share of bad labels, smoothed, is high: it is drawn towards that of its
shapes on hosts of the same registered domain, this towards that of its shapes on all hosts, and this towards that of all
labelled pages, so that a template without labels of its own is judged by those like it. Everything is counted on
distinct templates, so that a host with a third of all pages is summed up before it is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._shared import looked_up, materialised


@dataclass(frozen=True)
class Rule:
    """Hosts that are `host` or end in "." and it, with paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: Segments of a template (what follows them is one more); children from which rare ones are a wildcard, and the share that is rare.
DEPTH, CHILDREN, RARE = 4, 16, 0.02
#: Labels that a share counts as where it smooths another, standard errors that differ, and the share that is rejected.
STRENGTH, ERRORS, REJECTED = 8.0, 1.96, 0.6
NUMBER, CODE = "{n}", "{x}"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    rest = F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The place of the longest fitting rule among rules, null without one; of equally long ones the first."""
    out = F.lit(None).cast("int")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        place = next(i for i, r in enumerate(rules) if r == rule)
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, place).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """A path's segments, digits in them as {n}, long codes as {x}; from the DEPTH-th on as one."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", DEPTH + 1)
    typed = lambda s: F.when(s.rlike("^(?=[0-9A-Za-z_-]*[0-9])(?=[0-9A-Za-z_-]*[A-Za-z])[0-9A-Za-z_-]{16,}$"), CODE).otherwise(F.regexp_replace(s, "[0-9]+", NUMBER))
    return F.transform(parts, typed)


def domain_of(host: Column) -> Column:
    """The last two labels of a host; the whole of a shorter one."""
    return F.substring_index(host, ".", -2)


def templates(pages: DataFrame, strength: float = STRENGTH, errors: float = ERRORS) -> DataFrame:
    """pages (host, shape array, bad: 1, 0 or null for no label) to (host, shape, template, purity): a row for each distinct host and shape.

    purity is the smoothed share of bad labels. Without any label it is 0.
    """
    known = pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = known.withColumn("template", F.lit(""))
    for depth in range(DEPTH + 1):
        here = F.get("shape", F.lit(depth))
        children = known.where(here.isNotNull()).groupBy("host", "template", here.alias("child")).agg(F.sum("n").alias("n"))
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("total"))
        # a wide node's frequent children keep their names
        wide = nodes.where(F.col("children") >= CHILDREN)
        named = children.join(wide, ["host", "template"]).where(F.col("n") >= RARE * F.col("total")).select("host", "template", F.col("child").alias("named"))
        known = known.withColumn("child", here).join(wide.select("host", "template", F.lit(True).alias("wide")), ["host", "template"], "left")
        known = known.join(named.withColumnRenamed("named", "child").withColumn("frequent", F.lit(True)), ["host", "template", "child"], "left")
        step = F.when(F.col("wide") & F.col("frequent").isNull(), "*").otherwise(F.col("child"))
        known = known.withColumn("template", F.when(F.col("child").isNotNull(), F.concat("template", F.lit("/"), step)).otherwise(F.col("template"))).drop("child", "wide", "frequent")
        known = materialised(known, f"templates-{depth}")
    each = known.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    # siblings differ in one segment; those whose share of bad labels is like that of all of them count as one
    merged = each.withColumn("branch", F.col("template"))
    for depth in range(1, DEPTH + 2):
        parts = F.split("branch", "/")
        sibling = F.when(F.size(parts) > depth, F.array_join(F.concat(F.slice(parts, 1, depth), F.array(F.lit("*")), F.slice(parts, F.lit(depth + 2), F.size(parts))), "/")).otherwise(F.col("branch"))
        merged = merged.withColumn("sibling", sibling)
        branches = merged.groupBy("host", "sibling", "branch").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        pooled = branches.groupBy("host", "sibling").agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"), F.count("*").alias("branches"))
        p = F.col("all_b") / F.greatest(F.col("all_l"), F.lit(1))
        far = F.abs(F.col("b") / F.greatest(F.col("l"), F.lit(1)) - p) > errors * F.sqrt(p * (1 - p) / F.greatest(F.col("l"), F.lit(1)))
        moved = branches.join(pooled, ["host", "sibling"]).select("host", "branch", F.when((F.col("branches") > 1) & (F.col("l") > 0) & ~far, F.col("sibling")).otherwise(F.col("branch")).alias("to"))
        merged = merged.join(moved, ["host", "branch"]).select("host", "template", "labelled", "bad", F.col("to").alias("branch"))
        merged = materialised(merged, f"branches-{depth}")
    branch = merged.groupBy("host", "branch").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    every = branch.agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))  # one row
    # a branch's shapes, on this host's domain and on all hosts; whole numbers alone are summed
    counted = known.select("host", "shape", "template", domain_of(F.col("host")).alias("domain"), "labelled", "bad")
    sums = lambda prefix, *by: counted.groupBy(*by).agg(F.sum("labelled").alias(f"{prefix}_l"), F.sum("bad").alias(f"{prefix}_b"))
    like = counted.join(merged.select("host", "template", "branch"), ["host", "template"]).join(sums("domain", "domain", "shape"), ["domain", "shape"]).join(sums("shape", "shape"), "shape")
    like = like.groupBy("host", "branch").agg(*[F.sum(f"{p}_{k}").alias(f"{p}_{k}") for p in ("domain", "shape") for k in ("l", "b")])
    share = lambda b, l, towards: (F.col(b) + strength * towards) / (F.col(l) + strength)  # noqa: E731, E741
    prior = F.col("all_b") / F.greatest(F.col("all_l"), F.lit(1))
    purity = share("b", "l", share("domain_b", "domain_l", share("shape_b", "shape_l", prior)))
    pure = branch.join(like, ["host", "branch"]).join(F.broadcast(every)).select("host", "branch", purity.alias("purity"))
    return known.join(merged.select("host", "template", "branch"), ["host", "template"]).join(pure, ["host", "branch"]).select("host", "shape", F.col("branch").alias("template"), "purity")


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelling: tuple[Rule, ...] = (), rejected: float = REJECTED, id_column: str = "page_id", url_column: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity): a row for each row of pages; other columns are ignored.

    rule is the longest that fits, by host and path together; its verdict holds. Other pages are judged by their template:
    block from a purity of `rejected` on, else allow. Labels are the verdicts of the rules, and of labelling, which are
    rules that label pages without judging them, where no other fits; then those of labels (id, bad: 0 or 1; the larger of
    several), which judge no page by themselves either. Null urls and those without :// have an empty host and path and
    are judged together. Repeated rows and null ids give rows of their own; an empty table gives none.
    """
    url = F.col(url_column).cast("string")
    each = pages.select(F.col(id_column).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    each = each.withColumn("place", ruled(F.col("host"), F.col("path"), rules)).withColumn("shape", segments(F.col("path")))
    if labels is not None:
        each = each.join(labels.select(F.col("id").cast("long").alias("page_id"), F.col("bad").cast("int").alias("told")).groupBy("page_id").agg(F.max("told").alias("told")), "page_id", "left")
    each = materialised(each, "urls")
    verdicts, names = (F.array(*[F.lit(getattr(r, k)) for r in rules]) for k in ("verdict", "name"))
    marks = F.array(*[F.lit(int(r.verdict == "block")) for r in (*rules, *labelling)])
    bad = F.get(marks, F.coalesce("place", ruled(F.col("host"), F.col("path"), labelling) + len(rules)))
    bad = F.coalesce(bad, "told") if labels is not None else bad
    found = materialised(templates(each.select("host", "shape", bad.alias("bad"))), "templates")
    by_tree = F.when(F.col("purity") >= rejected, "block").otherwise("allow")
    # a host that a third of all pages have meets its templates in many tasks
    out = looked_up(each, found, ["host", "shape"], F.hash("page_id"))
    return out.select("page_id", "host", "path", F.get(names, F.col("place")).alias("rule"), F.when(F.col("place").isNotNull(), F.get(verdicts, F.col("place"))).otherwise(by_tree).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def oracle_sql() -> str:
    """The rows of judged() in DuckDB SQL."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    ordered = sorted(range(len(RULES)), key=lambda i: (-len(RULES[i].name), i))
    place = "CASE " + " ".join(f"WHEN (host = {quoted(RULES[i].host)} OR ends_with(host, {quoted('.' + RULES[i].host)})) AND starts_with(path, {quoted(RULES[i].path)}) THEN {i}" for i in ordered) + " END"
    verdicts, names = ("[" + ", ".join(quoted(getattr(r, k)) for r in RULES) + "]" for k in ("verdict", "name"))
    typed = f"CASE WHEN regexp_full_match(s, '[0-9A-Za-z_-]{{16,}}') AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') THEN '{CODE}' ELSE regexp_replace(s, '[0-9]+', '{NUMBER}', 'g') END"
    ctes = [
        f"""u AS (SELECT *, {place} AS place, list_transform(CASE WHEN len(parts) <= {DEPTH + 1} THEN parts ELSE list_append(parts[1:{DEPTH}], array_to_string(parts[{DEPTH + 1}:], '/')) END, lambda s: {typed}) AS shape FROM (
            SELECT page_id, host, path, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM (
                SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)))""",
        f"k0 AS (SELECT host, shape, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad, '' AS template FROM (SELECT host, shape, CASE WHEN place IS NOT NULL THEN CASE WHEN {verdicts}[place + 1] = 'block' THEN 1 ELSE 0 END END AS bad FROM u) GROUP BY host, shape)",
    ]
    for d in range(DEPTH + 1):
        ctes += [
            f"c{d} AS (SELECT host, template, shape[{d + 1}] AS child, sum(n) AS n FROM k{d} WHERE len(shape) > {d} GROUP BY ALL)",
            f"w{d} AS (SELECT host, template, sum(n) AS total FROM c{d} GROUP BY ALL HAVING count(*) >= {CHILDREN})",
            f"f{d} AS (SELECT host, template, child FROM c{d} JOIN w{d} USING (host, template) WHERE n >= {RARE} * total)",
            f"""k{d + 1} AS (SELECT k.host, k.shape, k.n, k.labelled, k.bad, CASE WHEN len(k.shape) <= {d} THEN k.template ELSE k.template || '/' || CASE WHEN w.total IS NOT NULL AND f.child IS NULL THEN '*' ELSE k.shape[{d + 1}] END END AS template
                FROM k{d} k LEFT JOIN w{d} w ON k.host = w.host AND k.template = w.template LEFT JOIN f{d} f ON k.host = f.host AND k.template = f.template AND k.shape[{d + 1}] = f.child)""",
        ]
    ctes.append(f"m0 AS (SELECT host, template, sum(labelled) AS labelled, sum(bad) AS bad, template AS branch FROM k{DEPTH + 1} GROUP BY host, template)")
    for d in range(1, DEPTH + 2):
        ctes += [
            f"s{d} AS (SELECT *, CASE WHEN len(string_split(branch, '/')) > {d} THEN array_to_string(list_concat(string_split(branch, '/')[1:{d}], ['*'], string_split(branch, '/')[{d + 2}:]), '/') ELSE branch END AS sibling FROM m{d - 1})",
            f"b{d} AS (SELECT host, sibling, branch, sum(labelled) AS l, sum(bad) AS b FROM s{d} GROUP BY ALL)",
            f"""t{d} AS (SELECT host, branch, CASE WHEN branches > 1 AND l > 0 AND NOT abs(b / greatest(l, 1) - p) > {ERRORS}::DOUBLE * sqrt(p * (1 - p) / greatest(l, 1)) THEN sibling ELSE branch END AS to_
                FROM (SELECT *, sum(b) OVER (PARTITION BY host, sibling) / greatest(sum(l) OVER (PARTITION BY host, sibling), 1) AS p, count(*) OVER (PARTITION BY host, sibling) AS branches FROM b{d}))""",
            f"m{d} AS (SELECT host, template, labelled, bad, to_ AS branch FROM m{d - 1} JOIN t{d} USING (host, branch))",
        ]
    last = f"m{DEPTH + 1}"
    ctes += [
        f"z AS (SELECT host, branch, sum(labelled) AS l, sum(bad) AS b FROM {last} GROUP BY ALL)",
        f"e AS (SELECT shape, sum(labelled) AS l, sum(bad) AS b FROM k{DEPTH + 1} GROUP BY shape)",
        f"q AS (SELECT *, regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain FROM k{DEPTH + 1})",
        "d AS (SELECT domain, shape, sum(labelled) AS l, sum(bad) AS b FROM q GROUP BY ALL)",
        f"y AS (SELECT q.host, m.branch, sum(d.l) AS dl, sum(d.b) AS db, sum(e.l) AS el, sum(e.b) AS eb FROM q JOIN {last} m ON q.host = m.host AND q.template = m.template JOIN d ON q.domain = d.domain AND q.shape = d.shape JOIN e ON q.shape = e.shape GROUP BY ALL)",
        f"""p AS (SELECT z.host, z.branch, (b + {STRENGTH}::DOUBLE * ((db + {STRENGTH}::DOUBLE * ((eb + {STRENGTH}::DOUBLE * prior) / (el + {STRENGTH}::DOUBLE))) / (dl + {STRENGTH}::DOUBLE))) / (l + {STRENGTH}::DOUBLE) AS purity
            FROM z JOIN y ON z.host = y.host AND z.branch = y.branch, (SELECT sum(b) / greatest(sum(l), 1) AS prior FROM z))""",
        f"t AS (SELECT k.host, k.shape, m.branch AS template, purity FROM k{DEPTH + 1} k JOIN {last} m ON k.host = m.host AND k.template = m.template JOIN p ON m.host = p.host AND m.branch = p.branch)",
    ]
    return f"""WITH {", ".join(ctes)}
        SELECT page_id, u.host, path, {names}[place + 1] AS rule, CASE WHEN place IS NOT NULL THEN {verdicts}[place + 1] WHEN purity >= {REJECTED} THEN 'block' ELSE 'allow' END AS verdict, template, round(purity, 6) AS purity
        FROM u LEFT JOIN t ON u.host = t.host AND u.shape = t.shape"""
