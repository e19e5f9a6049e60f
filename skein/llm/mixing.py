"""Mixing sources to target shares of tokens, by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.layout import cut

#: Relative miss of a source's tokens at which the iterations end, and rounds that are never needed.
CLOSE, MOST_ROUNDS = 1e-9, 300


def normal_source(column):
    """Source names that differ only in letter case, outer white space or what joins their words are one."""
    bare = F.regexp_replace(F.lower(column), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(bare, r"(?U)[\s\-_]+", "_")


def balance(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """Solve the dual for every source; returns its report rows, one per target.

    sizes has (source, n_tokens, documents): a histogram of documents by size. Rates r(n) = min(max_passes,
    exp(b n / mean)) tilt the documents of a source so that their tokens meet the target: b is the multiplier of the
    token constraint, and the gradient of the dual is the goal less the tokens at b. Each round is one distributed
    aggregation that returns a row per source, the tokens at the current multipliers, their derivative, for Newton's step,
    kept inside the bracket, and how many documents are still below max_passes. Where none is and the gradient is still
    positive, it stays so however far b grows: the dual has no finite solution, and the source is short; so is one without
    documents, whose gradient is its goal. Rounds go on until every source meets its goal, is short, or its bracket cannot
    shrink; an unmet bound on their number raises.
    """
    spark = sizes.sparkSession
    limits = sizes.groupBy("source").agg(F.sum("documents").alias("documents"), F.sum(F.col("documents") * F.col("n_tokens")).alias("tokens"))
    state: dict[str, dict] = {}
    for r in limits.join(targets, "source", "right").collect():
        have, goal = float(r["tokens"] or 0), float(r["goal"])
        short = goal > 0 and not have
        state[r["source"]] = r.asDict() | {"have": have, "docs": float(r["documents"] or 0), "short": short, "mean": have / float(r["documents"]) if have else 1.0, "b": 0.0, "low": -math.inf, "high": math.inf, "rounds": 0, "done": short or goal <= 0}
    for _ in range(MOST_ROUNDS):
        live = {k: s for k, s in state.items() if not s["done"]}
        if not live:
            return [s | {"slope": s["b"] / s["mean"]} for s in state.values()]
        now = spark.createDataFrame([(k, s["b"] / s["mean"], float(s["max_passes"])) for k, s in live.items()], "source string, slope double, top double")
        tilt = F.exp(F.least(F.col("slope") * F.col("n_tokens"), F.lit(50.0)))
        rate = F.least(F.col("top"), tilt)
        weight = F.col("documents") * F.col("n_tokens")
        got = sizes.join(now, "source").groupBy("source").agg(F.sum(weight * rate).alias("tokens"), F.sum(F.when(tilt < F.col("top"), weight * F.col("n_tokens") * rate).otherwise(0.0)).alias("bend"), F.sum(F.when(tilt < F.col("top"), F.col("documents")).otherwise(0)).alias("below"))
        for r in got.collect():
            step_to(state[r["source"]], r["tokens"], r["bend"], r["below"])
    raise RuntimeError(f"the mix is not balanced after {MOST_ROUNDS} rounds")


def step_to(s: dict, tokens: float, bend: float, below: int) -> None:
    """Move a source's multiplier by Newton's step, by half the bracket, or outwards where one side is still open.

    A goal that all documents max_passes times reach or miss by no more than CLOSE is only met from above: the multiplier
    moves outwards until the gradient turns or no document is below max_passes, which tells the short ones exactly.
    """
    s["rounds"] += 1
    goal = float(s["goal"])
    miss, b = tokens - goal, s["b"]
    s["low" if miss < 0 else "high"] = b
    met = abs(miss) <= CLOSE * goal
    edge = met and miss < 0 and s["have"] * s["max_passes"] - goal <= CLOSE * goal
    s["short"] = miss < 0 and not below
    if s["short"] or (met and not edge) or s["high"] - s["low"] <= 1e-13 * max(1.0, abs(b)):
        s["done"] = True
        return
    step = b - miss * s["mean"] / bend if bend > 0 else math.inf
    outwards = b + math.copysign(max(1.0, abs(b)), -miss)
    if edge and not math.isfinite(s["high"]):
        s["b"] = outwards
        return
    closed = math.isfinite(s["low"]) and math.isfinite(s["high"])
    s["b"] = step if s["low"] < step < s["high"] and (closed or abs(step - b) <= abs(outwards - b)) else (s["low"] + s["high"]) / 2 if closed else outwards


def mix_plan(documents: DataFrame, targets: DataFrame, ident: str | None = None, source: str = "source", tokens: str = "n_tokens") -> tuple[DataFrame, DataFrame]:
    """(plan, sized): per target source the fitted tilt, and the documents as (_id, _key, _n).

    plan: source (as in targets), key, target_share, max_passes, goal, have, documents, short, slope, rounds.
    """
    sized = documents.select((F.col(ident) if ident else F.lit(None)).alias("_id"), normal_source(F.col(source)).alias("_key"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("_n"))
    histogram = cut(sized.groupBy(F.col("_key").alias("source"), F.col("_n").alias("n_tokens")).agg(F.count("*").alias("documents")))
    everything = histogram.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("documents")), F.lit(0)).alias("everything"))
    share = F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0))
    wanted = targets.where(F.col("source").isNotNull()).groupBy(normal_source(F.col("source")).alias("source")).agg(
        F.min(F.col("source")).alias("name"), F.sum(share).alias("target_share"), F.max(F.greatest(F.coalesce(F.col("max_passes"), F.lit(0)), F.lit(0))).cast("int").alias("max_passes"))
    wanted = wanted.crossJoin(everything).withColumn("goal", F.col("target_share") * F.col("everything"))  # one row on the right
    rows = [(s["name"], s["source"], float(s["target_share"]), int(s["max_passes"]), float(s["goal"]), float(s["have"]), int(s["docs"]), bool(s["short"]), float(s["slope"]), int(s["rounds"])) for s in balance(histogram.where("n_tokens > 0 and source is not null"), wanted)]
    schema = "source string, key string, target_share double, max_passes int, goal double, have double, documents long, short boolean, slope double, rounds int"
    return documents.sparkSession.createDataFrame(rows, schema), sized


#: Documents for each part that equal sizes of a source are split into while fractions of copies are given out.
PART = 1_000_000


def copies_of(used: DataFrame, parts: int) -> DataFrame:
    """Adds copies to (_id, _key, _n, rate): the rate rounded up or down so that a source's copies add up to its rates.

    Rates depend on the size only. In the order of sizes the running sum of a source's fractions tells, at each size,
    how many of its documents get one copy more; so the tokens of the mix differ from those of the rates by no more than
    about one largest document. Among the documents of a size a hash of the id decides. The sums run over
    sizes, the documents of a size are split into `parts` by their hash, and no document's row meets more than its part.
    """
    mark = F.pmod(F.xxhash64(F.lit("mix"), F.col("_id")), F.lit(1 << 40))
    rows = used.withColumn("_h", mark).withColumn("_part", F.pmod("_h", F.lit(parts))).withColumn("_f", F.col("rate") - F.floor("rate"))
    cells = rows.where("_f > 0").groupBy("_key", "_n", "_part").agg(F.count("*").alias("_m"), F.first("_f").alias("_f"))
    sizes = cells.groupBy("_key", "_n").agg(F.sum(F.col("_m") * F.col("_f")).alias("_s"))
    until = Window.partitionBy("_key").orderBy("_n")
    sizes = sizes.select("_key", "_n", (F.sum("_s").over(until) - F.col("_s")).alias("_before"))
    inside = Window.partitionBy("_key", "_n").orderBy("_part")
    start = F.col("_before") + (F.sum("_m").over(inside) - F.col("_m")) * F.col("_f")
    given = cells.join(sizes, ["_key", "_n"]).withColumn("_from", start + 0.5).select("_key", "_n", "_part", (F.floor(F.col("_from") + F.col("_m") * F.col("_f")) - F.floor("_from")).alias("_given"))
    place = F.row_number().over(Window.partitionBy("_key", "_n", "_part").orderBy("_h", "_id"))
    more = F.coalesce(F.col("_given") >= F.col("_place"), F.lit(False)).cast("int")
    return rows.withColumn("_place", place).join(given, ["_key", "_n", "_part"], "left").withColumn("copies", (F.floor("rate") + more).cast("int"))


def mix_sources(documents: DataFrame, targets: DataFrame, ident: str, source: str = "source", tokens: str = "n_tokens") -> tuple[DataFrame, DataFrame]:
    """(copies, report) of a mix as large as the corpus whose shares of tokens meet the targets.

    copies: id, source, n_tokens, copies for every document of a target source: the tilted rate rounded up or down
    (see copies_of), never above max_passes. report: a row per target with target_share, goal, have, mixed,
    share (of the mix really reached), short (all its documents max_passes times are fewer tokens than the goal),
    largest (tokens of its largest document), within (mixed is within two largest documents of the goal, or the
    source is short and wholly used), and the Newton rounds.

    Defined results: documents of other or null sources are counted in the size of the mix but not used; null ids
    share one hash; documents without tokens take no part; targets that normalise to one name are added up;
    null shares and passes count as 0; a target without documents is short unless its goal is 0.
    """
    plan, sized = mix_plan(documents, targets, ident, source, tokens)
    rules = plan.select(F.col("key").alias("_key"), F.col("source").alias("_name"), "slope", "short", "max_passes", "goal")
    top = F.col("max_passes").cast("double")
    rate = F.when(F.col("short"), top).when(F.col("goal") <= 0, 0.0).otherwise(F.least(top, F.exp(F.least(F.col("slope") * F.col("_n"), F.lit(50.0)))))
    used = sized.where("_n > 0").join(rules, "_key").select("_id", "_key", "_name", "_n", rate.alias("rate"))
    total = plan.agg(F.sum("documents")).first()[0] or 0
    copies = copies_of(used, 1 + total // PART).select(F.col("_id").alias(ident), F.col("_name").alias("source"), F.col("_n").alias("n_tokens"), "copies")
    mixed = copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed"), F.max("n_tokens").alias("largest"))
    whole = mixed.agg(F.sum("mixed").alias("whole"))
    report = plan.drop("key", "slope").join(mixed, "source", "left").crossJoin(whole)  # one row on the right
    report = report.withColumn("mixed", F.coalesce("mixed", F.lit(0))).withColumn("largest", F.coalesce("largest", F.lit(0)))
    met = F.when(F.col("short"), F.col("mixed") == F.col("have") * F.col("max_passes")).otherwise(F.abs(F.col("mixed") - F.col("goal")) <= 2 * F.col("largest") + 1e-6 * F.col("goal"))
    report = report.select("source", "target_share", "max_passes", "documents", "goal", "have", "mixed", F.coalesce(F.try_divide(F.col("mixed"), F.col("whole")), F.lit(0.0)).alias("share"), "short", "largest", met.alias("within"), "rounds")
    return copies, report


def short_sources(documents: DataFrame, targets: DataFrame, source: str = "source", tokens: str = "n_tokens") -> DataFrame:
    """The targets that cannot be met within their passes: those whose dual, solved by balance(), has no finite solution."""
    return mix_plan(documents, targets, None, source, tokens)[0].where("short").select("source")
