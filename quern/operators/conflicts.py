"""Inputs, their claims on output paths, conflicts between them, and the plan of writes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.paths import comparable, folder, output_claims, stem
from quern.shared import spread, written


def first_of_each(inputs: DataFrame) -> DataFrame:
    """inputs (idx, path) with one row per comparable path, the first."""
    order = Window.partitionBy(comparable(F.col("path"))).orderBy("idx")
    return inputs.withColumn("__no", F.row_number().over(order)).where("__no = 1").drop("__no")


def without_earlier_outputs(inputs: DataFrame, mode: str) -> DataFrame:
    """inputs (idx, path, format, scanned) without scanned ones that another input would write; named ones stay."""
    claims = inputs.select(F.col("idx").alias("by"), F.explode(output_claims(F.col("path"), F.col("format"), mode)).alias("claim"), comparable(F.col("path")).alias("own"))
    # an input's claim on its own path is no reason to leave it out
    claims = claims.where("claim <> own").select("claim").distinct()
    scanned = inputs.where("scanned").withColumn("claim", comparable(F.col("path")))
    return inputs.where(~F.col("scanned")).unionByName(scanned.join(claims, "claim", "left_anti").drop("claim"))


def expanded(inputs: DataFrame, mode: str) -> DataFrame:
    """Inputs without earlier outputs and repeats, in order of their paths."""
    return first_of_each(without_earlier_outputs(inputs, mode)).orderBy(comparable(F.col("path")))


def conflicting(inputs: DataFrame, mode: str) -> DataFrame:
    """(idx, reason) of inputs (idx, path, format) that may not run; idx is unique and orders them, of any type.

    reason: same-file (an earlier input has the path), claimed (an earlier input that runs claims one of its outputs) or
    replaces (one of its outputs is another input). An input that may not run claims nothing, so inputs are decided in order.

    All claims of an input share its folder and stem. Of a group's inputs with the same claims only the first can run, so
    that a fold over one row for each distinct list of claims, some dozens at most, finds those that run; every input then
    meets the few that do. No row holds a group's inputs.
    """
    claims = output_claims(F.col("path"), F.col("format"), mode)
    each = inputs.select("idx", comparable(F.col("path")).alias("own"), claims.alias("claims"), folder(F.col("path")).alias("dir"), stem(F.col("path")).alias("stem"))
    first = Window.partitionBy("own").orderBy("idx")
    each = each.withColumn("__no", F.row_number().over(first))
    repeats = each.where("__no > 1").select("idx", F.lit("same-file").alias("reason"))
    firsts = each.where("__no = 1").drop("__no")
    group = ["dir", "stem"]
    # claims of a group that are inputs: as few as its formats have names
    claimed = firsts.select(*group, F.explode("claims").alias("claim")).distinct()
    there = claimed.join(firsts.select(F.col("own").alias("claim")), "claim", "left_semi").groupBy(*group).agg(F.collect_set("claim").alias("there"))
    known = firsts.join(there, group, "left").withColumn("there", F.coalesce("there", F.array().cast("array<string>")))
    replaced = F.filter("claims", lambda c: (c != F.col("own")) & F.array_contains("there", c))
    heads = known.where(F.size(replaced) == 0).groupBy(*group, "claims").agg(F.min("idx").alias("idx"))
    kind = dict(inputs.dtypes)["idx"]
    free = lambda acc, r: ~F.exists(acc, lambda x: F.arrays_overlap(x["claims"], r["claims"]))
    runs = F.aggregate("rows", F.array().cast(f"array<struct<idx:{kind},claims:array<string>>>"), lambda acc, r: F.when(free(acc, r), F.array_append(acc, r)).otherwise(acc))
    running = heads.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("idx", "claims"))).alias("rows")).select(*group, runs.alias("running"))
    taken = lambda c: F.exists("running", lambda x: (x["idx"] < F.col("idx")) & F.array_contains(x["claims"], c))
    # the first claim in order that clashes gives the reason
    clashes = F.transform("claims", lambda c: F.when(taken(c), "claimed").when((c != F.col("own")) & F.array_contains("there", c), "replaces"))
    found = known.join(running, group, "left").select("idx", F.get(F.array_compact(clashes), F.lit(0)).alias("reason"))
    return found.where("reason IS NOT NULL").unionByName(repeats)


def write_plan(outputs: DataFrame, existing: DataFrame, in_place: bool, overwrite: bool) -> DataFrame:
    """outputs (file, ord, path, is_input, unchanged) and existing paths to (file, action, blocked_path).

    An output on the input blocks unless it is unchanged or in_place is set, and comes before any other existing path, of
    which the first is reported unless overwrite is set. Else the file is written; writes counts its outputs to write.
    """
    there = existing.select(F.col("path")).distinct().withColumn("exists", F.lit(True))
    each = outputs.join(there, "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    on_input = F.col("exists") & F.col("is_input")
    skip = on_input & F.col("unchanged")
    by_input = on_input & ~F.col("unchanged") & F.lit(not in_place)
    by_other = F.col("exists") & ~F.col("is_input") & F.lit(not overwrite)
    first = lambda c: F.min(F.when(c, F.struct("ord", "path")))["path"]
    plan = each.groupBy("file").agg(first(by_input).alias("a"), first(by_other).alias("b"), F.count_if(~skip).alias("writes"))
    action = F.when(F.col("a").isNotNull(), "blocked-input").when(F.col("b").isNotNull(), "blocked-exists").otherwise("write")
    return plan.select("file", action.alias("action"), F.coalesce("a", "b").alias("blocked_path"), F.when(action == "write", F.col("writes")).otherwise(0).cast("long").alias("writes"))


_GROUP = ["folder", "base", "ext"]


def _name_parts(names: DataFrame, ignore_case: bool) -> DataFrame:
    """names (idx, folder, name, mine) with key, base, ext and count: "a (3).png" is the count 3 of "a" and ".png"; other names are their own base with count 0.

    A count is written as it is counted: of "a (03)" and a count of more than nine digits the whole is the base.
    """
    stem_of, ext = F.regexp_replace("name", "(?<=.)\\.[^.]*$", ""), F.regexp_extract("name", "(?<=.)(\\.[^.]*)$", 1)
    pattern = "(?s)^(.*) \\(([1-9]\\d{0,8})\\)$"
    counted = F.regexp_extract(stem_of, pattern, 2)
    base = F.when(counted != "", F.regexp_extract(stem_of, pattern, 1)).otherwise(stem_of)
    count = F.when(counted != "", counted.cast("long")).otherwise(F.lit(0).cast("long"))
    key = lambda c: F.lower(c) if ignore_case else c
    return names.select("idx", "folder", "name", "mine", base.alias("shown"), key(base).alias("base"), key(ext).alias("ext"), ext.alias("shown_ext"), count.alias("count"))


def free_names(names: DataFrame, existing: DataFrame | None = None, ignore_case: bool = False) -> DataFrame:
    """names (idx, folder, name) with free_name: the name itself if it is free in its folder, else with the next count that is.

    existing (folder, name): what is there already. Names are decided by idx, and one that is given counts as taken;
    ignore_case: by their lower-case form. Null folders are one folder; null names stay null.

    Which counts of a base are taken in the end does not depend on the order, so that they fall into stretches that sorted
    counts and a running maximum tell apart. A name alone in its stretch keeps its count, and where all of a stretch ask for
    one count their ranks are the counts; other stretches are walked, with a forest of next free counts, in near-linear time.
    """
    mine = names.where("name IS NOT NULL").select("idx", "folder", "name", F.lit(True).alias("mine"))
    parts = _name_parts(mine, ignore_case)
    if existing is not None:
        there = existing.where("name IS NOT NULL").select(F.lit(None).cast(names.schema["idx"].dataType).alias("idx"), "folder", "name", F.lit(False).alias("mine"))
        parts = parts.unionByName(_name_parts(there, ignore_case).dropDuplicates([*_GROUP, "count"]))
    # null folders are one folder, in joins too
    parts = written(parts.withColumn("folder", F.struct(F.col("folder").isNull().alias("none"), F.coalesce("folder", F.lit("")).alias("folder"))), "names")
    rows = parts.count()
    # a row for each count that is asked for: windows hold these, not a base's names
    counts = parts.groupBy(*_GROUP, "count").agg(F.count("*").alias("n"))
    by_count = Window.partitionBy(*_GROUP).orderBy("count")
    earlier = F.coalesce(F.sum("n").over(by_count.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = counts.withColumn("__gap", F.col("count") - earlier)
    gaps = gaps.withColumn("__stretch", F.max("__gap").over(by_count.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = [*_GROUP, "__stretch"]
    whole = Window.partitionBy(*stretch)
    told = gaps.withColumn("__mixed", F.max("count").over(whole) > F.min("count").over(whole)).drop("n", "__gap")
    sized = parts.join(told, [*_GROUP, "count"])
    turn = F.row_number().over(Window.partitionBy(*_GROUP, "count").orderBy("mine", "idx", "shown", "shown_ext")) - 1
    same = spread(sized.where("NOT __mixed"), rows, *_GROUP, "count").select("idx", "folder", "shown", "shown_ext", "mine", (F.col("count") + turn).alias("given"))

    def walk(table: pa.Table) -> pa.Table:
        number = table.column("count")
        counted = pc.if_else(pc.greater(number, 0), pc.binary_join_element_wise(" (", pc.cast(number, pa.string()), ")", ""), "")
        table = table.append_column("name", pc.binary_join_element_wise(table.column("shown"), counted, table.column("shown_ext"), ""))
        table = table.sort_by([("mine", "ascending"), ("idx", "ascending"), ("name", "ascending")])
        wanted, given, after = table.column("count").to_numpy(), np.empty(table.num_rows, np.int64), {}

        def free(c: int) -> int:
            path = []
            while c in after:
                path.append(c)
                c = after[c]
            for p in path:
                after[p] = c
            return c

        for k, want in enumerate(wanted.tolist()):
            given[k] = c = free(want)
            after[c] = c + 1
        return table.select(["idx", "folder", "shown", "shown_ext", "mine"]).append_column("given", pa.array(given))

    mixed = spread(sized.where("__mixed"), rows, *_GROUP).select(*stretch, "idx", "shown", "shown_ext", "mine", "count")
    walked = mixed.groupBy(*stretch).applyInArrow(walk, same.schema)
    out = same.unionByName(walked).where("mine")
    name = F.concat("shown", F.when(F.col("given") > 0, F.concat(F.lit(" ("), F.col("given").cast("string"), F.lit(")"))).otherwise(F.lit("")), "shown_ext")
    return out.select("idx", F.when(~F.col("folder.none"), F.col("folder.folder")).alias("folder"), name.alias("free_name")).unionByName(names.where("name IS NULL").select("idx", "folder", F.lit(None).cast("string").alias("free_name")))


def finder_names(names: DataFrame, existing: DataFrame | None = None, ignore_case: bool = True) -> DataFrame:
    """free_names() as macOS counts: "a.png", then "a 2.png" and "a 3.png"; a count in a name that is given is not read.

    "a 2.png" may be what is counted of "a.png" or a name of its own, so that names whose stems differ in trailing counts alone are decided together, in order.
    """
    at = names.schema["idx"].dataType
    mine = names.where("name IS NOT NULL").select("idx", "folder", "name", F.lit(True).alias("mine"))
    rows = mine if existing is None else mine.unionByName(existing.where("name IS NOT NULL").select(F.lit(None).cast(at).alias("idx"), "folder", "name", F.lit(False).alias("mine")))
    stem_of, ext = F.regexp_replace("name", "(?<=.)\\.[^.]*$", ""), F.regexp_extract("name", "(?<=.)(\\.[^.]*)$", 1)
    key = lambda c: F.lower(c) if ignore_case else c
    rows = rows.withColumn("stem", stem_of).withColumn("ext", ext).withColumn("__root", key(F.concat(F.regexp_replace("stem", "( \\d+)+$", ""), F.col("ext"))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("mine", "ascending"), ("idx", "ascending")])
        form = str.lower if ignore_case else str
        taken, following, given = set(), {}, []
        for name, stem_, ext_, mine_ in zip(*(table.column(c).to_pylist() for c in ("name", "stem", "ext", "mine")), strict=True):
            count, start = following.get(form(stem_ + "/" + ext_), 2), name
            while form(name) in taken and mine_:
                name, count = f"{stem_} {count}{ext_}", count + 1
            if name != start:
                following[form(stem_ + "/" + ext_)] = count
            taken.add(form(name))
            given.append(name)
        return table.select(["idx", "folder", "mine"]).append_column("free_name", pa.array(given, pa.string()))

    done = rows.groupBy("folder", "__root").applyInArrow(run, rows.select("idx", "folder", "mine", F.col("name").alias("free_name")).schema)
    return done.where("mine").drop("mine").unionByName(names.where("name IS NULL").select("idx", "folder", F.lit(None).cast("string").alias("free_name")))
