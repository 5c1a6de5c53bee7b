"""Peer baskets: selection, weights and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnlens.operators.pit import active, top_rows, visible


def active_members(baskets: DataFrame, members: DataFrame, cutoff: str | Column, min_members: int = 3) -> DataFrame:
    """Members of each target's newest visible basket, the target itself left out.

    A basket is dropped when fewer than ``min_members`` are visible; that count comes before the filter on activity
    and weight.
    """
    current = top_rows(
        active(visible(baskets, cutoff), cutoff),
        ["target_security_id"],
        [F.col("event_date").desc(), F.col("peer_basket_id").asc()],
    ).select("target_security_id", "peer_basket_id", "basket_name", "basket_version")
    seen = (
        visible(members, cutoff)
        .join(current, "peer_basket_id")
        .where(F.col("peer_security_id") != F.col("target_security_id"))
    )
    counts = seen.groupBy("target_security_id").agg(F.count("*").alias("visible_members"))
    enough = counts.where(F.col("visible_members") >= min_members).select("target_security_id")
    return seen.join(enough, "target_security_id", "left_semi")


def normalised_weights(members: DataFrame, cutoff: str | Column) -> DataFrame:
    """Weights of members active at the cutoff with positive weight, scaled to one per target."""
    live = active(members, cutoff).where(F.col("weight") > 0)
    totals = live.groupBy("target_security_id").agg(
        F.sum("weight").alias("_total"), F.count("*").alias("active_members")
    )
    return (
        live.join(totals, "target_security_id")
        .withColumn("weight", F.col("weight") / F.col("_total"))
        .select("target_security_id", "basket_name", "basket_version", "peer_security_id", "weight", "active_members")
    )


def basket_compositions(weights: DataFrame) -> DataFrame:
    """Target to composition: targets whose weighted members coincide share one composition.

    Generated baskets of one industry differ only by the left-out target, so the returns of a few compositions
    serve any number of targets.
    """
    member = F.struct("peer_security_id", F.round("weight", 12))
    digest = weights.groupBy("target_security_id", "basket_name", "basket_version").agg(
        F.count("*").alias("_n"),
        F.sum(F.xxhash64(member).cast("decimal(38,0)")).alias("_sum"),
        F.sum(F.xxhash64(F.lit("second"), member).cast("decimal(38,0)")).alias("_sum2"),
    )
    name = F.concat_ws("_", F.lit("peer:"), "_n", "_sum", "_sum2")
    return digest.select("target_security_id", "basket_name", "basket_version", name.alias("series_key"))


def basket_returns(weights: DataFrame, compositions: DataFrame, returns: DataFrame) -> DataFrame:
    """Weighted return per composition on the days when every active member has one."""
    shown_by = compositions.groupBy("series_key").agg(F.min("target_security_id").alias("target_security_id"))
    parts = weights.join(shown_by, "target_security_id").select(
        "series_key", F.col("peer_security_id").alias("security_id"), "weight", "active_members"
    )
    moves = returns.where(F.col("return_bps").isNotNull()).select("security_id", "event_date", "return_bps")
    return (
        parts.join(moves, "security_id")
        .groupBy("series_key", "event_date")
        .agg(
            F.sum(F.col("weight") * F.col("return_bps")).alias("value"),
            F.count("*").alias("_present"),
            F.max("active_members").alias("_needed"),
        )
        .where(F.col("_present") == F.col("_needed"))
        .select("series_key", "event_date", "value", F.lit(None).cast("date").alias("prev_date"))
    )


def _heads(candidates: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """First ``n`` candidates of each group with their place."""
    named = candidates.where(F.col(group).isNotNull())
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    heads = named.withColumn("place", place).where(F.col("place") <= n)
    return heads.select(
        group, F.col("security_id").alias("peer_security_id"), F.col("ticker").alias("peer_ticker"), "place"
    )


def _equal_weights(chosen: DataFrame, min_peers: int) -> DataFrame:
    counts = chosen.groupBy("target_security_id").agg(F.count("*").alias("peer_count"))
    return (
        chosen.join(counts.where(F.col("peer_count") >= min_peers), "target_security_id")
        .withColumn("weight", 1.0 / F.col("peer_count"))
    )


def liquid_peers(candidates: DataFrame, max_peers: int = 20, min_peers: int = 3) -> DataFrame:
    """Best-covered peers of the same industry, or of the sector when the industry has too few.

    Every target of a group picks from the same ranking, so the group's first ``max_peers + 1`` rows are enough for
    all its targets and no pair outside them is formed.
    """
    order = [F.col("price_bar_count").desc(), F.col("ticker").asc()]
    target = candidates.select(F.col("security_id").alias("target_security_id"), "ticker", "industry", "sector")
    sizes = candidates.where(F.col("industry").isNotNull()).groupBy("industry").agg(F.count("*").alias("_n"))
    pooled = target.join(sizes, "industry", "left").withColumn(
        "by_industry", F.coalesce(F.col("_n") - 1 >= min_peers, F.lit(False)) | F.col("sector").isNull()
    )
    parts = []
    for group, wanted in (("industry", F.col("by_industry")), ("sector", ~F.col("by_industry"))):
        heads = _heads(candidates, group, order, max_peers + 1)
        parts.append(
            pooled.where(wanted)
            .join(heads, group)
            .where(F.col("target_security_id") != F.col("peer_security_id"))
            .select("target_security_id", "ticker", "peer_security_id", "peer_ticker", "place")
        )
    ranked = top_rows(parts[0].unionByName(parts[1]), ["target_security_id"], [F.col("place").asc()], max_peers)
    return _equal_weights(ranked.drop("place"), min_peers)


def close_peers(securities: DataFrame, max_peers: int = 20, min_peers: int = 3) -> DataFrame:
    """Same subindustry first, then the rest of the sector, each alphabetical.

    A sector's first ``2 * max_peers + 1`` tickers always hold enough names outside the target's own subindustry
    whenever the subindustry alone does not fill the basket.
    """
    order = [F.col("ticker").asc()]
    target = securities.select(
        F.col("security_id").alias("target_security_id"), "ticker", "sector", "subindustry"
    )
    near = (
        target.join(_heads(securities, "subindustry", order, max_peers + 1), "subindustry")
        .where(F.col("peer_ticker") != F.col("ticker"))
        .select("target_security_id", "ticker", "peer_security_id", "peer_ticker", F.lit(0).alias("tier"))
    )
    sector_heads = top_rows(securities, ["sector"], order, 2 * max_peers + 1).select(
        "sector",
        F.col("subindustry").alias("peer_subindustry"),
        F.col("security_id").alias("peer_security_id"),
        F.col("ticker").alias("peer_ticker"),
    )
    wide = (
        target.join(sector_heads, "sector")
        .where((F.col("peer_ticker") != F.col("ticker")) & (F.col("peer_subindustry") != F.col("subindustry")))
        .select("target_security_id", "ticker", "peer_security_id", "peer_ticker", F.lit(1).alias("tier"))
    )
    ranked = top_rows(
        near.unionByName(wide), ["target_security_id"], [F.col("tier").asc(), F.col("peer_ticker").asc()], max_peers
    )
    return _equal_weights(ranked, min_peers)


def listed_peers(targets: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """Curated peer lists: unknown tickers and the target itself drop out, the rest weigh the same."""
    listed = targets.select(
        F.col("security_id").alias("target_security_id"), "ticker", F.explode("peers").alias("peer_ticker")
    ).where(F.col("peer_ticker") != F.col("ticker"))
    known = ticker_map.select(F.col("ticker").alias("peer_ticker"), F.col("security_id").alias("peer_security_id"))
    return _equal_weights(listed.join(known, "peer_ticker"), 1)
