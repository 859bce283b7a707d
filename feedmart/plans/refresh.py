"""The whole batch: canonical rows of all sources to a published snapshot."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..operators import groups as G
from ..operators import health as H
from ..operators import rows as R
from ..sources import snapshot as S
from .blocks import shard_best
from .browse import publish_keys
from .grams import holding
from .index import build_index
from .lineage import cut


@dataclass
class Refresh:
    events: DataFrame
    postings: DataFrame
    status: DataFrame
    report: DataFrame
    meta: DataFrame
    rejects: DataFrame
    refused: str | None


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources in registry order, which ``source_order`` keeps."""
    out = None
    for i, df in enumerate(frames):
        df = df.withColumn("source_order", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def land(frames: dict[str, DataFrame], seen: str, addresses: dict[str, str]) -> DataFrame:
    """Canonical rows of scanned sources: rows with a ``problem`` stay behind, those without an address of their own get the source's and their id."""
    out = []
    for name, df in frames.items():
        rows = df.filter("problem is null") if "problem" in df.columns else df
        own = F.concat(F.lit(addresses[name]), "source_id") if name in addresses else F.col("canonical_url")
        link = F.coalesce(F.nullif("canonical_url", F.lit("")), own) if "canonical_url" in df.columns else own
        rows = rows.withColumns({"canonical_url": link, "source_url": link, "last_seen_at": F.lit(seen), "ingest_seq": F.xxhash64("source_id")})
        out.append(R.to_canonical(rows, name))
    return union_sources(out)


def run_refresh(canonical: DataFrame, registry: DataFrame, prior: DataFrame, prior_time: datetime | None, today: date | str, now: datetime, failed: DataFrame | None = None, strict: bool = False, cap: int = L.SOURCE_CAP) -> Refresh:
    """Validate, drop past, cap, collapse, dedupe, drop cancelled, recover, gate, order and index.

    The order of collapse, dedupe and the cancelled filter is part of the
    result: a cancelled row may win its group and then vanish with it.
    ``failed`` lists ``name, error`` of sources whose payloads could not be read.
    """
    marked = cut(canonical.withColumn("problems", R.problems([r["name"] for r in registry.select("name").collect()])))  # the registry's names
    rejects = marked.filter(F.size("problems") > 0)
    fresh = R.drop_past(marked.filter(F.size("problems") == 0).drop("problems"), today)
    metrics = G.run_metrics(marked, today)
    capped, over = G.cap_per_key(fresh, n=cap)
    collapsed, collapse_stats = G.collapse_multi_day(capped)
    collapsed = cut(collapsed)
    winners, dedupe_stats = G.dedupe(collapsed, registry)
    winners = cut(R.drop_cancelled(winners))
    published = S.with_tags(S.to_published(winners), winners)
    status = registry.select("name").join(metrics.withColumnRenamed("source_name", "name"), "name", "left").na.fill(0)
    lost = failed if failed is not None else status.select("name", F.lit("").alias("error")).limit(0)
    status = status.join(lost, "name", "left").withColumn("ok", F.col("error").isNull()).withColumn("duration_ms", F.lit(None).cast("long"))
    status = H.mark_degraded(status, registry)
    overflow = over.select(F.col("source_name").alias("name"), F.col("reason").alias("_over"))
    status = status.join(overflow, "name", "left")
    status = status.withColumn("degraded", F.col("degraded") | F.col("_over").isNotNull()).withColumn("degraded_reason", F.nullif(F.concat_ws("; ", "degraded_reason", "_over"), F.lit(""))).drop("_over")
    age = None if prior_time is None else round(max(0.0, (now - prior_time).total_seconds() / 3600), 1)
    every, status = H.recover(published, prior, status, today, age)
    status, every = cut(status), cut(every)
    refused = H.refuse_empty(every, status) or H.quality_gate(status, strict).first()["reason"]
    placed = G.with_position(every.withColumn("_o", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(publish_keys())])), ["_o"]).drop("_o")
    postings = build_index(placed, pos="pos")
    duplicates = dedupe_stats.first()["duplicates_removed"]
    report = H.status_report(status, every.count(), duplicates, str(now), refused if refused and refused.endswith(("failed", "events")) else None, bool(refused))
    return Refresh(placed.drop("pos"), postings, status, report, S.snapshot_meta(status, str(now)), rejects, refused)


def publish_refresh(run: Refresh, path: str, run_id: str) -> str | None:
    """Publishes a run unless it was refused; its status is written either way."""
    S.write_status(run.report, f"{path}/status/{run_id}")
    if run.refused:
        return None
    return S.publish({"events": run.events, "index": run.postings, "meta": run.meta}, path, run_id)


def eval_golden(queries: DataFrame, blocks: DataFrame, events: DataFrame, n: int = 10) -> DataFrame:
    """``query_id, id, rank, score``: the plain weighted look-up against which a snapshot's golden queries are judged.

    ``blocks`` are those of ``impact_blocks``, best stored by ``store_blocks``;
    ``events`` has ``id, title`` and ``pos``, the position in the index. Titles
    that hold a query as it is are found by their runs of bytes; queries and blocks meet in
    shards of positions, of which each hands on a query's ``n`` best.
    """
    from ..functions import text as X

    asked = queries.select("query_id", F.lower("query").alias("low"), X.tokenize("query").alias("tokens")).filter(F.size("tokens") > 0)
    asked = cut(asked)
    titles = events.select("pos", "title")
    held = holding(asked, titles, "query_id", "low", "pos", F.lower("title"))
    bonus = cut(held.join(asked.select("query_id", (F.size("tokens") * L.TITLE_PHRASE).alias("points")), "query_id"))
    scores = shard_best(asked.select("query_id", F.explode("tokens").alias("token"), F.lit(1.0).alias("factor")), blocks, n, events, bonus)
    best = scores.withColumn("_n", F.rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).filter(F.col("_n") <= n).drop("_n")  # ties with the last stay until their ids are known
    return G.with_rank(best.join(events.select("pos", "id"), "pos"), ["query_id"], [F.col("score").desc(), "id"]).filter(F.col("rank") <= n).select("query_id", "id", "rank", "score")
