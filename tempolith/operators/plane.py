"""Proposals, factor similarity, the evidence graph and the context bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys

#: The kinds of proposals.
PROPOSAL_KINDS = ("factor", "experiment", "strategy", "paper", "review")
SUSPECT_ABOVE = 0.7


def proposal_error(kinds: tuple[str, ...] = PROPOSAL_KINDS) -> Column:
    """The first field that a proposal row gets wrong, null if none."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "kind")
        .when(empty("submitted_by"), "submitted_by")
        .when(empty("summary"), "summary")
        .when((F.col("kind") == "factor") & empty("factor_name"), "factor_name")
        .when((F.col("kind") == "experiment") & empty("experiment_fingerprint"), "experiment_fingerprint")
    )


def _json_text(c: Column) -> Column:
    """A JSON string with <, > and & escaped."""
    text = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x")))
    text = F.substring(text, F.lit(6), F.char_length(text) - 6)
    for char, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def canonical_proposal() -> Column:
    """The proposal's JSON in fixed field order; detail as it is, null without one."""
    parts = []
    for i, name in enumerate(("kind", "submitted_by", "factor_name", "experiment_fingerprint", "summary")):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{name}":'), _json_text(F.col(name))]
    return F.concat(*parts, F.lit(',"detail":'), F.coalesce(F.col("detail"), F.lit("null")), F.lit("}"))


def with_fingerprint(proposals: DataFrame) -> DataFrame:
    return proposals.withColumn("payload", canonical_proposal()).withColumn("fingerprint", F.sha2("payload", 256))


def submit(proposals: DataFrame, latest: DataFrame) -> DataFrame:
    """Ledger writes for valid proposals whose content is not yet the latest of its key."""
    valid = with_fingerprint(proposals.where(proposal_error().isNull()))
    rows = valid.select(F.concat(F.lit("proposal:"), "fingerprint").alias("logical_key"), F.col("payload").cast("binary").alias("payload"), keys.agent_source("submitted_by").alias("source"))
    return changed(rows.dropDuplicates(["logical_key"]), latest)


def changed(incoming: DataFrame, latest: DataFrame) -> DataFrame:
    """incoming (logical_key, payload, ...) without rows equal to the latest version of their key."""
    return incoming.join(latest.select("logical_key", "payload"), ["logical_key", "payload"], "left_anti")


def correlations(series: DataFrame) -> DataFrame:
    """Similarity edges of all pairs of series (factor, at, value): Pearson's correlation over common instants.

    Series of fewer than two common instants, of unequal lengths or without variance have none.
    The factor table is a bounded catalog: its pairs are what is asked for.
    """
    a, b = series.toDF("factor_a", "at", "x"), series.toDF("factor_b", "at", "y")
    size = series.groupBy("factor").agg(F.count("*").alias("n"))
    pairs = a.join(b, "at").where("factor_a < factor_b").groupBy("factor_a", "factor_b")
    stats = pairs.agg(F.count("*").alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cov"))
    whole = stats.join(size.toDF("factor_a", "na"), "factor_a").join(size.toDF("factor_b", "nb"), "factor_b")
    good = whole.where("n >= 2 and n = na and n = nb and vx > 0 and vy > 0")
    r = F.col("cov") / F.sqrt(F.col("vx") * F.col("vy"))
    return good.select("factor_a", "factor_b", r.alias("correlation"), (r > SUSPECT_ABOVE).alias("suspect"))


def suspect_duplicates(edges: DataFrame, admitted: DataFrame, key: Column | None = None) -> DataFrame:
    """(factor, rival): for each factor not admitted the first suspect neighbour, in key order, that is.

    key: the key of an edge, by default that of the unordered pair.
    """
    key = keys.pair_key("factor_a", "factor_b") if key is None else key
    both = edges.where("suspect").select("factor_a", "factor_b", key.alias("key"))
    sides = both.select(F.col("factor_a").alias("factor"), F.col("factor_b").alias("rival"), "key").union(both.select("factor_b", "factor_a", "key"))
    known = admitted.select(F.col("factor").alias("rival")).distinct()
    open_ = sides.join(known, "rival", "left_semi").join(admitted.select("factor").distinct(), "factor", "left_anti")
    return open_.groupBy("factor").agg(F.min_by("rival", "key").alias("rival"))


def edge_targets(latest: DataFrame, family: str, source: str) -> DataFrame:
    """Distinct ends of a source's edges, in order."""
    prefix = f"{keys.EDGE_PREFIXES[family]}{source}:"
    hit = latest.where(F.col("logical_key").startswith(prefix))
    return hit.select(F.expr(f"substring(logical_key, {len(prefix) + 1})").alias("target")).distinct().orderBy("target")


def evidence_paths(factors: DataFrame, edges: dict[str, DataFrame], objects: dict[str, DataFrame]) -> DataFrame:
    """One row a path from each factor: experiment, strategy, paper, review and their objects, null where the chain ends.

    edges: frames (src, dst) for factor, experiment, strategy, paper; objects: frames (name, body)
    for experiment, strategy, paper, review.
    """
    path = factors.select("factor")
    hops = (("factor", "factor", "experiment"), ("experiment", "experiment", "strategy"), ("strategy", "strategy", "paper"), ("paper", "paper", "review"))
    for family, src, dst in hops:
        e = edges[family].select(F.col("src").alias(src), F.col("dst").alias(dst)).distinct()
        o = objects[dst].select(F.col("name").alias(dst), F.col("body").alias(f"{dst}_body"))
        path = path.join(e, src, "left").join(o, dst, "left")
    return path.select("factor", *[c for d in ("experiment", "strategy", "paper", "review") for c in (d, f"{d}_body")])


def evidence_chain(factors: DataFrame, edges: dict[str, DataFrame], objects: dict[str, DataFrame]) -> DataFrame:
    """(factor, experiments): nested arrays of structs down to reviews, each level in name order."""
    p = evidence_paths(factors, edges, objects)
    papers = p.groupBy("factor", "experiment", "experiment_body", "strategy", "strategy_body", "paper", "paper_body").agg(
        F.sort_array(F.collect_list(F.when(F.col("review_body").isNotNull(), F.struct("review", "review_body")))).alias("reviews")
    )
    strategies = papers.groupBy("factor", "experiment", "experiment_body", "strategy", "strategy_body").agg(
        F.sort_array(F.collect_list(F.when(F.col("paper").isNotNull(), F.struct("paper", "paper_body", "reviews")))).alias("papers")
    )
    experiments = strategies.groupBy("factor", "experiment", "experiment_body").agg(
        F.sort_array(F.collect_list(F.when(F.col("strategy").isNotNull(), F.struct("strategy", "strategy_body", "papers")))).alias("strategies")
    )
    return experiments.groupBy("factor").agg(
        F.sort_array(F.collect_list(F.when(F.col("experiment").isNotNull(), F.struct("experiment", "experiment_body", "strategies")))).alias("experiments")
    )


def evidence_degraded(factors: DataFrame, edges: dict[str, DataFrame], objects: dict[str, DataFrame]) -> DataFrame:
    """(factor, level, name, problem): hops that are missing and ends whose object is."""
    p = evidence_paths(factors, edges, objects)
    parts = [p.where("experiment is null").select("factor", F.lit("factor").alias("level"), F.col("factor").alias("name"), F.lit("no_edge").alias("problem"))]
    for level, nxt in (("experiment", "strategy"), ("strategy", "paper")):
        parts.append(p.where(f"{level} is not null and {nxt} is null").select("factor", F.lit(level), F.col(level), F.lit("no_edge")))
    for level in ("experiment", "strategy", "paper", "review"):
        parts.append(p.where(f"{level} is not null and {level}_body is null").select("factor", F.lit(level), F.col(level), F.lit("no_object")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def search_experiments(experiments: DataFrame, keyword: str, text_col: str = "hypothesis_summary") -> DataFrame:
    """Experiments whose summary holds the keyword, in any case."""
    return experiments.where(F.contains(F.lower(text_col), F.lower(F.lit(keyword))))


def context_bundle(contracts: DataFrame, experiments: DataFrame, strategies: DataFrame, redlines: DataFrame, as_of_nanos: int) -> DataFrame:
    """One row: what an agent may see as of an instant, ordered lists and a digest of all of it."""
    listed = lambda df, key, name: df.agg(F.sort_array(F.collect_list(F.struct(key, *[c for c in df.columns if c != key]))).alias(name))
    one = listed(contracts, "type_id", "dataset_contracts").crossJoin(listed(experiments, "experiment_fingerprint", "factors_tested"))  # single rows
    one = one.crossJoin(listed(strategies, "name", "strategy_states")).crossJoin(listed(redlines, "id", "risk_redlines"))
    one = one.select(F.lit(as_of_nanos).cast("long").alias("as_of_nanos"), "*")
    one = one.withColumn("contracts_digest", F.sha2(F.to_json("dataset_contracts"), 256)).withColumn("risk_redlines_digest", F.sha2(F.to_json("risk_redlines"), 256))
    return one.withColumn("context_fingerprint", F.sha2(F.to_json(F.struct(*one.columns)), 256))
