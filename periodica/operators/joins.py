"""Nearest, backward, range, set and hierarchy joins without theta plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.session import cut_lineage


def align_components(total: DataFrame, parts: DataFrame, period: str) -> DataFrame:
    """Component rows on the periods of the total; an empty result is an error for the caller."""
    return parts.join(total, period, "inner")


def outer_pair(a: DataFrame, b: DataFrame, on: list[str], left: str, right: str) -> DataFrame:
    return a.withColumnRenamed("value", left).join(b.withColumnRenamed("value", right), on, "full")


def nearest_prior(df: DataFrame, keys: list[str], period: str, value: str, months: int = 12, tolerance: int = 30) -> DataFrame:
    """Value nearest to ``months`` before, at most ``tolerance`` days away.

    Days fall into buckets of twice the tolerance, so a target meets its
    candidates in at most two buckets by an equality join. On a tie the later
    date wins.
    """
    size = 2 * tolerance + 1
    left = df.select(*keys, period, F.add_months(period, -months).alias("_t"))
    lo = F.floor((F.unix_date("_t") - tolerance) / size)
    hi = F.floor((F.unix_date("_t") + tolerance) / size)
    left = left.withColumn("_b", F.explode(F.array_distinct(F.array(lo, hi))))
    right = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(period).alias("_d"), F.col(value).alias("_v"), F.floor(F.unix_date(period) / size).alias("_b")
    )
    gap = F.abs(F.datediff("_d", "_t"))
    best = left.join(right, [*keys, "_b"]).where(gap <= tolerance).groupBy(*keys, period).agg(
        F.min_by("_v", F.struct(gap, -F.unix_date("_d"))).alias("prior")
    )
    return df.join(best, [*keys, period], "left")


def unpivot_weights(weights: DataFrame, key: str, prefix: str = "weight_") -> DataFrame:
    """``weight_YYYY`` columns to validity intervals [year, next year)."""
    cols = [x for x in weights.columns if x.startswith(prefix) and x[len(prefix):].isdigit()]
    long = weights.select(key, *[F.col(x).cast("double").alias(x) for x in cols]).unpivot(key, cols, "_c", "weight")
    long = long.where("weight is not null").withColumn("from_year", F.substring("_c", len(prefix) + 1, 9).cast("int"))
    w = Window.partitionBy(key).orderBy("from_year")
    return long.select(key, "from_year", F.lead("from_year").over(w).alias("to_year"), "weight")


def weight_for_year(df: DataFrame, weights: DataFrame, key: str, period: str) -> DataFrame:
    """Weight of the latest year not after the row's; 0 before the first.

    A key has one weight per year, so the interval join is an equality join on
    the key with a short list behind it.
    """
    spans = weights.groupBy(key).agg(F.collect_list(F.struct("from_year", "to_year", "weight")).alias("_w"))
    year = F.year(period)
    hit = F.filter("_w", lambda w: (w["from_year"] <= year) & (w["to_year"].isNull() | (year < w["to_year"])))
    return df.join(spans, key, "left").withColumn("weight", F.coalesce(F.try_element_at(hit, F.lit(1))["weight"], F.lit(0.0))).drop("_w")


def backward_asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: str, name: str, long_right: bool = False) -> DataFrame:
    """Last right value at or before each left time.

    ``right`` holds one row per key and time, few beside ``left``. Each row is valid
    until the next; validity meets the left rows on the key and the month, so
    left rows are neither sorted nor gathered by key. ``long_right`` says that ``right``
    grows with its keys: it is then never broadcast, as its size is measured before
    the months multiply it.
    """
    month = lambda at: F.trunc(at, "MM")
    last = left.agg(F.max(left_at).alias("m")).scalar()
    r = right.where(F.col(value).isNotNull()).select(*keys, F.col(right_at).alias("_from"), F.col(value).alias(name))
    r = r.withColumn("_to", F.lead("_from").over(Window.partitionBy(*keys).orderBy("_from")))
    end = F.greatest(month(F.col("_from")), month(F.coalesce(F.col("_to"), last)))
    r = r.withColumn("_month", F.explode(F.sequence(month(F.col("_from")), end, F.expr("interval 1 month"))))
    r = r.hint("merge") if long_right else r
    l = left.withColumn("_month", month(F.col(left_at)))
    meets = [l[k].eqNullSafe(r[k]) for k in [*keys, "_month"]] + [l[left_at] >= r["_from"], r["_to"].isNull() | (l[left_at] < r["_to"])]
    return l.join(r, meets, "left").select(*[l[c] for c in left.columns], name)


def nearest_day(days: DataFrame, day: str, selected: Column) -> DataFrame:
    """Day closest to the selected one; the earlier wins a tie."""
    return days.agg(F.min_by(day, F.struct(F.abs(F.datediff(F.col(day), selected)), F.col(day))).alias("nearest"))


def common_days(df: DataFrame, area: str, day: str, areas: int | Column) -> DataFrame:
    return df.groupBy(day).agg(F.countDistinct(area).alias("_n")).where(F.col("_n") == areas).select(day)


def nearest_both_sides(df: DataFrame, day: str, selected: Column, valid: Column) -> DataFrame:
    d = F.col(day)
    return df.where(valid).agg(F.max(F.when(d <= selected, d)).alias("before"), F.min(F.when(d >= selected, d)).alias("after"))


def attach_dimension(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Dictionary join; the planner broadcasts the dimension when its measured size allows."""
    return df.join(dim, on, "left")


def substring_match(tokens: DataFrame, names: DataFrame, token: str, name: str, order: str, width: int = 3) -> DataFrame:
    """First name (by ``order``) that contains each token.

    Names are indexed by their short character grams, a token looks only
    under its own rarest gram, and the full test runs on those rows.
    """
    n = names.select(F.col(name).alias("_name"), F.col(order).alias("_order")).where("_name is not null")
    grams = n.withColumn("_len", F.explode(F.sequence(F.lit(1), F.lit(width)))).where(F.length("_name") >= F.col("_len"))
    grams = grams.withColumn(
        "_g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_name") - F.col("_len") + 1),
                                                     lambda i: F.substring(F.col("_name"), i, F.col("_len")))))
    ).select("_g", "_name", "_order")
    grams = cut_lineage(grams, "grams")  # counted first, then looked up
    size = F.least(F.lit(width), F.length("_token"))
    t = tokens.select(F.col(token).alias("_token")).where("_token <> ''").distinct().withColumn(
        "_g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_token") - size + 1), lambda i: F.substring(F.col("_token"), i, size))))
    )
    df = grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    rare = t.join(df, "_g", "left").groupBy("_token").agg(F.min_by("_g", F.struct(F.coalesce("_df", F.lit(0)), F.col("_g"))).alias("_g"))
    hits = rare.join(grams, "_g").where(F.expr("instr(_name, _token) > 0"))
    return hits.groupBy(F.col("_token").alias(token)).agg(F.min_by("_name", "_order").alias("matched"), F.min("_order").alias("matched_order"))


def name_match(tokens: DataFrame, names: DataFrame, token: str, name: str, order: str, normalise) -> DataFrame:
    """Substring match on the raw names, then on normalised ones for the rest."""
    raw = substring_match(tokens, names, token, name, order)
    rest = tokens.select(token).distinct().join(raw, token, "left_anti").withColumn("_n", normalise(F.col(token)))
    soft = names.select(normalise(F.col(name)).alias("_norm"), name, order)
    found = substring_match(rest, soft, "_n", "_norm", order).select("_n", "matched_order")
    second = rest.join(found, "_n").join(names.select(F.col(order).alias("matched_order"), F.col(name).alias("matched")), "matched_order")
    return raw.withColumn("pass", F.lit("exact")).unionByName(second.select(token, "matched", "matched_order").withColumn("pass", F.lit("normalised")))


def decorate(base: DataFrame, key: str, parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """Left join of several snapshots with a presence flag for each."""
    out = base
    for part, flag in parts:
        out = out.join(part.withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return out


def first_days_count(df: DataFrame, key: str, day: str, days: int, cutoff: Column) -> DataFrame:
    """Rows in the first ``days`` days of each key up to the cut-off.

    One row per (key, day) is formed first, so the first day travels with it.
    """
    daily = df.where(F.col(day) <= cutoff).groupBy(key, day).agg(F.count(F.lit(1)).alias("_n"))
    first = F.min(day).over(Window.partitionBy(key))
    return (
        daily.withColumn("first_day", first).groupBy(key, "first_day")
        .agg(F.sum(F.when(F.datediff(day, "first_day") < days, F.col("_n")).otherwise(0)).alias("count_first_days"))
    )


def dense_grid(df: DataFrame, key: str, slots: DataFrame, slot: str, value: str) -> DataFrame:
    """Every key on every slot of the calendar, absent cells as 0.

    ``slots`` is one row holding the calendar as an array column, so the grid
    comes from exploding it, not from a cross join.
    """
    grid = df.select(key).distinct().withColumn(slot, F.explode(slots.scalar()))
    return grid.join(df, [key, slot], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def null_safe_on(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def lost_keys(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    return before.join(after, null_safe_on(before, after, keys), "left_anti").select(*[before[k] for k in keys])


def changed_rows(stored: DataFrame, incoming: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Incoming rows that are new or whose payload differs from the stored one."""
    s = stored.select(*keys, F.col(payload).alias("_old"), F.lit(True).alias("_known"))
    j = incoming.join(s, keys, "left")
    return j.where(F.col("_known").isNull() | ~F.col(payload).eqNullSafe(F.col("_old"))).drop("_old", "_known")


def latest_attach(catalog: DataFrame, history: DataFrame, key: str, day: str, keep: list[str]) -> DataFrame:
    last = history.groupBy(key).agg(F.max_by(F.struct(day, *keep), day).alias("_r")).select(key, "_r.*")
    return catalog.join(last, key, "left")


def closure(edges: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """All (ancestor, descendant, depth) pairs of a hierarchy.

    ``reach`` holds the pairs at most ``span`` steps apart and ``jump`` those that a walk
    of exactly ``span`` steps joins. A pair further apart, up to twice the span, has a
    jump as the last part of its shortest path, so a pair of a tree is made once and
    a tree of depth d needs about log2(d) rounds. Each round is written to the shared
    folder to cut the plan. A key that reaches itself is a cycle and raises.
    """
    step = edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant"), F.lit(1).alias("depth")).distinct()
    reach = cut_lineage(step, "closure")
    jump, span = reach.select(F.col("ancestor").alias("_m"), F.col("descendant").alias("_d")), 1
    while True:
        if reach.where("ancestor = descendant").limit(1).count():
            raise ValueError("hierarchy contains a cycle")
        if jump.isEmpty():
            return reach
        # A key's jumps stream past its few ancestors; rows are never broadcast, as either side grows with the keys.
        longer = jump.join(reach.hint("merge"), jump["_m"] == reach["descendant"]).select(
            "ancestor", F.col("_d").alias("descendant"), (F.col("depth") + span).alias("depth"))
        reach_next = cut_lineage(reach.unionByName(longer).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")), "closure")
        near = jump.select(F.col("_m").alias("_a"), F.col("_d").alias("_via")).hint("merge")
        jump = cut_lineage(jump.join(near, jump["_m"] == near["_via"]).select(F.col("_a").alias("_m"), "_d").distinct(), "closure")
        reach, span = reach_next, 2 * span


def footprints(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Each node with itself and everything below it, one row per member."""
    below = closure(edges).select(F.col("ancestor").alias("scope"), F.col("descendant").alias("member"))
    return nodes.select(F.col(node).alias("scope"), F.col(node).alias("member")).unionByName(below).distinct()


def set_relations(members: DataFrame, within: list[str]) -> DataFrame:
    """Pairs of scopes that share a member: contained, equal or crossing.

    Scopes meet through shared members, never pairwise in a group; the number
    of pairs is bounded by how deeply scopes nest.
    """
    size = members.groupBy(*within, "scope").agg(F.count(F.lit(1)).alias("size"))
    m = members.join(size, [*within, "scope"])
    a = m.select(*within, "member", F.col("scope").alias("a"), F.col("size").alias("na"))
    b = m.select(*within, "member", F.col("scope").alias("b"), F.col("size").alias("nb"))
    shared = a.join(b, [*within, "member"]).where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    out = shared.groupBy(*within, "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("overlap"))
    kind = F.when((F.col("overlap") == F.col("na")) & (F.col("na") == F.col("nb")), "equal").when(
        F.col("overlap") == F.col("na"), "contained").otherwise("crossing")
    return out.withColumn("relation", kind)


def merge_frames(frames: list[DataFrame], key: str, period: str, value: str, keep: str = "last") -> DataFrame:
    """Long union of several frames; a repeated (key, period) keeps one frame's value."""
    ranked = [f.select(key, period, value).withColumn("_o", F.lit(i)) for i, f in enumerate(frames)]
    union = reduce(lambda a, b: a.unionByName(b), ranked)
    pick = F.max_by if keep == "last" else F.min_by
    return union.groupBy(key, period).agg(pick(value, "_o").alias(value))


def align_pairs(series: DataFrame, pairs: DataFrame, strict: bool) -> DataFrame:
    """Points of each (target, candidate) pair on common times, or on the common range.

    The range form returns both sides' own points, tagged by ``side``.
    """
    s = series.where(F.col("value").isNotNull())
    side = lambda n: s.select(F.col("series").alias(n), "ts", F.col("value"))
    t = pairs.join(side("target"), "target")
    c = pairs.join(side("candidate"), "candidate")
    if strict:
        return t.withColumnRenamed("value", "x").join(c.withColumnRenamed("value", "y"), ["target", "candidate", "ts"])
    span = s.groupBy("series").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    sp = lambda n: span.select(F.col("series").alias(n), F.col("a").alias(f"a_{n}"), F.col("b").alias(f"b_{n}"))
    common = pairs.join(sp("target"), "target").join(sp("candidate"), "candidate").select(
        "target", "candidate", F.greatest("a_target", "a_candidate").alias("_from"), F.least("b_target", "b_candidate").alias("_to"))
    both = t.withColumn("side", F.lit("target")).unionByName(c.withColumn("side", F.lit("candidate")))
    return both.join(common, ["target", "candidate"]).where(F.col("ts").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
