"""Non-overlapping choice of reporting scopes and conservative totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from periodica.operators.joins import set_relations
from periodica.operators.quality import QualityError
from periodica.session import cut_lineage


def scope_winners(rows: DataFrame) -> DataFrame:
    """One disclosure per scope, or a conflict when equals disagree.

    ``rows``: scope, basis_rank, basis, period, end_day, estimated, amount,
    complete. The winner has the best basis, the newest end and is measured
    rather than estimated.
    """
    rank = [F.col("basis_rank").desc(), F.col("end_day").desc_nulls_last(), F.col("estimated").asc(), F.col("amount").desc()]
    w = Window.partitionBy("scope")
    r = rows.withColumn("_rn", F.row_number().over(w.orderBy(*rank)))
    first = lambda c: F.first(c).over(w.orderBy(*rank).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    differs = (F.col("_rn") > 1) & F.col("period").isNotNull() & (F.col("period") == first("period")) & (F.col("basis") == first("basis")) & ~F.col("amount").eqNullSafe(first("amount"))
    r = r.withColumn("_c", F.max(differs.cast("int")).over(w))
    return r.where("_rn = 1").withColumn("conflict", F.coalesce(F.col("_c") == 1, F.lit(False))).drop("_rn", "_c")


def select_scopes(winners: DataFrame, members: DataFrame) -> DataFrame:
    """Status of each scope: chosen, contained, split, crossing or conflict.

    Equal or crossing scopes are set aside. Among the rest, which only nest, a
    complete scope whose same-period parts cover it is split; a scope is chosen
    when it is not split and lies in no larger unsplit scope.
    """
    winners, members = cut_lineage(winners, "scopes"), cut_lineage(members, "members")
    free = winners.where(~F.col("conflict")).select("scope", "basis", "period", "complete")
    rel = cut_lineage(set_relations(members.join(free.select("scope"), "scope", "left_semi"), []), "relations")
    bad = rel.where("relation <> 'contained'").select(F.explode(F.array("a", "b")).alias("scope")).distinct()
    ok = free.join(bad, "scope", "left_anti")
    nest = rel.where("relation = 'contained'").select(F.col("a").alias("part"), F.col("b").alias("whole"))
    p = ok.select(F.col("scope").alias("part"), F.col("basis").alias("pb"), F.col("period").alias("pp"))
    q = ok.select(F.col("scope").alias("whole"), "basis", "period", "complete")
    nest = cut_lineage(nest.join(p, "part").join(q, "whole"), "nesting")
    same = nest.where((F.col("pb") == F.col("basis")) & (F.col("pp") == F.col("period")) & F.col("complete"))
    cover = same.join(members.withColumnRenamed("scope", "part"), "part").groupBy("whole").agg(F.countDistinct("member").alias("covered"))
    size = members.groupBy(F.col("scope").alias("whole")).agg(F.countDistinct("member").alias("size"))
    split = cover.join(size, "whole").where("covered = size").select(F.col("whole").alias("scope"))
    unsplit = ok.join(split, "scope", "left_anti").select("scope")
    inside = nest.join(unsplit.withColumnRenamed("scope", "whole"), "whole", "left_semi").select(F.col("part").alias("scope")).distinct()
    tag = lambda df, name: df.select("scope", F.lit(True).alias(name))
    out = winners.join(tag(bad, "_bad"), "scope", "left").join(tag(inside, "_in"), "scope", "left").join(tag(split, "_split"), "scope", "left")
    status = F.when(F.col("conflict"), "conflict").when(F.col("_bad"), "crossing").when(F.col("_in"), "contained").when(F.col("_split"), "split").otherwise("chosen")
    return out.withColumn("status", status).drop("_bad", "_in", "_split")


def total_scopes(chosen: DataFrame, period: str, whole_basis: str) -> DataFrame:
    """Sum of whole-asset amounts of one period; unlike gas units give no total."""
    rows = chosen.where((F.col("status") == "chosen") & (F.col("period") == period) & (F.col("basis") == whole_basis) & F.col("amount").isNotNull())
    mixed = (F.countDistinct("unit") > 1) & (F.count_if(F.col("unit").contains("立方")) > 0)
    return rows.agg(F.when(~mixed, F.sum("amount")).alias("total"), F.count(F.lit(1)).alias("scopes"))


def asset_card(rows: DataFrame) -> DataFrame:
    """Totals per product over distinct scopes; ``rows`` are (scope, product, amount, year)."""
    once = rows.groupBy("scope", "product").agg(F.max("amount").alias("amount"), F.max("year").alias("year"), (F.min("amount") != F.max("amount")).alias("_c"))
    return once.groupBy("product").agg(
        F.sum("amount").alias("total"), F.count("amount").alias("summed"), F.count(F.lit(1)).alias("records"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.coalesce(F.bool_or("_c"), F.lit(False)).alias("conflict"))


def require_no_conflict(card: DataFrame) -> None:
    if card.where("conflict").limit(1).count():
        raise QualityError("one scope and product has different amounts")


def producing_share(states: DataFrame) -> DataFrame:
    """Share of scopes that only produce, and of those still to be confirmed."""
    per = states.groupBy("scope").agg(F.count_distinct("state").alias("k"), F.min("state").alias("s"), F.count_if(F.col("state").isin("unknown", "historical_unverified")).alias("u"))
    n = F.count(F.lit(1))
    return per.agg(n.alias("scopes"), (F.count_if((F.col("k") == 1) & (F.col("s") == "producing")) / n * 100).alias("producing_pct"),
                   (F.count_if((F.col("k") != 1) | (F.col("u") > 0)) / n * 100).alias("pending_pct"))
