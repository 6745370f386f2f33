"""One view of rule findings, proven operations and opinions: what is confirmed, assessed, pending or left out, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.catalogue import canonical, direction_references, direction_targets, purpose_label
from cairn.functions.rules import PROFILES, profiles
from cairn.operators.steps import settled

# Texts of rows that aren't confirmed.
OPEN_ALGORITHM, TO_REVIEW, ASSESSED = "算法待确认", "待复核", "AI研判"
# Bases on which an opinion may be adopted.
BASES = ["known_api", "parameter_flow", "implementation"]
TEMPLATE = "uninstantiated_template"
ADOPTED = "evidence_based_ai_judgment"


def proven(levels: Column) -> Column:
    """Whether the claims about algorithm, operation and quantum class all have the highest grade; levels maps a claim to its grade."""
    return F.forall(F.array(*[F.coalesce(levels[c], F.lit("")) == "E3" for c in ("ALGORITHM", "OPERATION_TYPE", "QUANTUM_CLASS")]), lambda x: x)


def adoption(opinion_algorithm: Column, row_algorithm: Column, kind: Column, conflict: Column, gaps: Column, valid: Column, anchored: Column, basis: Column, scope_reason: Column) -> Column:
    """Why an opinion is adopted or not: the first test that it fails, in a fixed order."""
    mine, theirs = canonical(opinion_algorithm), canonical(row_algorithm)
    differs = ~theirs.isin("unknown", OPEN_ALGORITHM) & (mine != "unknown") & (theirs != mine)
    return (
        F.when(F.coalesce(scope_reason, F.lit("")) != "", scope_reason)
        .when((kind == "questions_static") | F.coalesce(conflict, F.lit(False)) | differs, "conflicting_evidence")
        .when(F.coalesce(gaps, F.lit(0)) > 0, "missing_implementation")
        .when(mine == "unknown", "algorithm_unknown")
        .when(~(F.coalesce(valid, F.lit(False)) & F.coalesce(anchored, F.lit(False))), "evidence_not_anchored")
        .when(~F.coalesce(basis.isin(BASES), F.lit(False)), "insufficient_basis")
        .otherwise(ADOPTED)
    )


def paired(operations: DataFrame, findings: DataFrame) -> DataFrame:
    """operation_id and finding_id where an operation joins the one finding at its place, or the one with its call.

    The first operation by id takes the only finding of its place and
    algorithm; with several none can be told apart. Templates that find none
    there then take the only one left with their call in the same way. All
    keys hold the place, so rows are dealt by it once and both steps are
    windows in it; an id stands at one place. Null keys meet nothing.
    """
    place = ["source_id", "line"]
    template = (F.col("context_kind") == TEMPLATE).alias("template")
    theirs = findings.select(*place, "algorithm", F.col("resolved_api").alias("api"), "finding_id", F.lit(None).cast(operations.schema["operation_id"].dataType).alias("operation_id"), F.lit(False).alias("template"), F.lit(1).alias("found"))
    ours = operations.select(*place, "algorithm", "api", F.lit(None).cast(findings.schema["finding_id"].dataType).alias("finding_id"), "operation_id", template, F.lit(0).alias("found"))
    rows = theirs.unionByName(ours).where("source_id is not null and line is not null")
    # a number of the place comes first: sorting compares it, and names only within a place
    rows = rows.withColumn("place", F.xxhash64(*place)).repartition("place")
    same, called = Window.partitionBy("place", *place, "algorithm"), Window.partitionBy("place", *place, "api")
    rows = rows.withColumns({"n": F.sum("found").over(same), "first": F.min("operation_id").over(same)})
    direct = (F.col("n") == 1) & F.col("first").isNotNull() & ((F.col("found") == 1) | (F.col("operation_id") == F.col("first")))
    rows = rows.withColumn("direct", direct).withColumn("free", ~F.col("direct") & F.col("api").isNotNull() & ((F.col("found") == 1) | F.col("template") & (F.col("n") <= 1)))
    rows = rows.withColumns({"m": F.sum(F.when(F.col("free"), F.col("found"))).over(called), "second": F.min(F.when(F.col("free"), F.col("operation_id"))).over(called)})
    taker = F.when(F.col("direct"), F.col("first")).when(F.col("free") & (F.col("m") == 1), F.col("second"))
    return rows.where("found = 1").select(taker.alias("operation_id"), "finding_id").where("operation_id is not null")


def integrate_operations(findings: DataFrame, operations: DataFrame) -> DataFrame:
    """Confirmed and pending rows of findings (finding_id, source_id, line, algorithm, resolved_api) and operations.

    operations has operation_id, source_id, line, algorithm, api,
    operation_type, levels (claim -> grade), risk_category and context_kind,
    and may have context_id and evidence_scope: that of a policy makes its
    purpose a configuration. Operations of sources without a row in findings
    are the caller's to leave out.
    A proven operation that isn't quantum-vulnerable is neutral and gives no
    row; one of an algorithm without a profile neither. Others join the one
    finding at their place; templates that find none there then join the one
    with their call that is still free, and each of the rest is a row of its
    own: confirmed if proven, else pending.
    """
    spark = findings.sparkSession
    known = profiles(spark).select(F.col("algorithm").alias("_known"))
    ops = operations.withColumns({"proven": proven(F.col("levels")), "algorithm": canonical(F.coalesce("algorithm", F.lit("unknown")))})
    ops = ops.join(F.broadcast(known), F.lower("algorithm") == F.lower("_known"), "left")  # eleven rows
    neutral = F.col("proven") & ((F.coalesce("risk_category", F.lit("")) != "quantum_vulnerable") | F.col("_known").isNull())
    ops = ops.where(~neutral).drop("_known")
    rows = findings.withColumn("algorithm", canonical(F.col("algorithm")))
    may = ops.where(F.col("proven") | (F.col("context_kind") == TEMPLATE))
    taken = settled(paired(may, rows))
    kind = F.when(F.coalesce(F.col("levels")["OPERATION_TYPE"], F.lit("")) == "E3", F.col("operation_type")).otherwise("unknown")
    if "evidence_scope" in ops.columns:
        kind = F.when(F.col("evidence_scope") == "algorithm_policy", "configuration").otherwise(kind)
    context = F.col("context_id") if "context_id" in ops.columns else F.lit(None).cast("string")
    facts = ops.select("operation_id", kind.alias("_kind"), "proven", context.alias("context_id"))
    # what is known of operations joins the pairs, not all findings: most have no operation, and all nulls would go to one task
    old = findings.join(taken.join(facts, "operation_id"), "finding_id", "left")
    old = old.select("finding_id", "source_id", "line", "algorithm", F.coalesce("_kind", F.lit("unknown")).alias("purpose_code"), F.lit("confirmed").alias("verification_status"), F.when(F.col("operation_id").isNull(), "rule").otherwise("rule,cross_file").alias("origin"), "operation_id", "context_id")
    new = ops.join(taken, "operation_id", "left_anti").select(
        F.concat(F.lit("operation-"), F.substring(F.sha2(F.col("operation_id").cast("string"), 256), 1, 24)).alias("finding_id"), "source_id", "line",
        F.when(F.col("algorithm") == "unknown", OPEN_ALGORITHM).otherwise(F.col("algorithm")).alias("algorithm"), kind.alias("purpose_code"),
        F.when(F.col("proven"), "confirmed").otherwise("pending").alias("verification_status"), F.lit("cross_file").alias("origin"), "operation_id", context.alias("context_id"),
    )
    return old.unionByName(new)


def neutral_operations(operations: DataFrame) -> DataFrame:
    """Operations that are proven not to be vulnerable; opinions that support only these say nothing."""
    return operations.where(proven(F.col("levels")) & (F.coalesce("risk_category", F.lit("")) != "quantum_vulnerable"))


def placed_opinions(free: DataFrame, pending: DataFrame) -> DataFrame:
    """opinion_id, row_id and made: the row at an opinion's place that it attaches to, or the new row that it makes.

    Opinions come in order. One with a context meets the rows at its place
    that have this context, one without meets all; it attaches if that is
    exactly one row, and makes a row with its context otherwise, which later
    opinions meet in turn. What happens before an opinion comes down to few
    facts of its place, so that no opinion waits for another:

    - with a context that no row has, the first one makes the row of all
      others; with one that several rows have, each makes a row of its own;
    - without a context, opinions attach while their place has one row: the
      first that is there or is made, until another one is made.
    """
    place = ["source_id", "line"]
    here = pending.groupBy(*place).agg(F.count(F.lit(1)).alias("there"), F.min("finding_id").alias("only"))
    same = pending.where("context_id is not null").groupBy(*place, "context_id").agg(F.count(F.lit(1)).alias("alike"), F.min("finding_id").alias("like"))
    o = free.select("opinion_id", *place, "context_id")
    o = o.join(here, place, "left").join(same, [*place, "context_id"], "left").fillna(0, ["there", "alike"])
    first = o.where("context_id is not null").groupBy(*place, "context_id").agg(F.min("opinion_id").alias("first_alike"))
    o = o.join(first, [*place, "context_id"], "left")
    makes = F.col("context_id").isNotNull() & ((F.col("alike") > 1) | ((F.col("alike") == 0) & (F.col("opinion_id") == F.col("first_alike"))))
    o = settled(o.withColumn("makes", makes))
    opening = o.groupBy(*place).agg(F.min("opinion_id").alias("first"), F.max("there").alias("n"))
    # where no row is, the first opinion's is the one that later ones meet; the next one that is made ends that
    ends = o.join(opening.select(*place, "first", "n"), place).where("makes and (n > 0 or opinion_id > first)").groupBy(*place).agg(F.min("opinion_id").alias("second"))
    o = o.join(opening.drop("n"), place).join(ends, place, "left")
    alone = ((F.col("there") == 1) | ((F.col("there") == 0) & (F.col("opinion_id") > F.col("first")))) & (F.col("second").isNull() | (F.col("opinion_id") < F.col("second")))
    name = lambda c: F.concat(F.lit("candidate-"), F.col(c).cast("string"))
    to = F.when(F.col("context_id").isNull(), F.when(alone, F.when(F.col("there") == 1, F.col("only")).otherwise(name("first"))))
    to = to.when(F.col("alike") == 1, F.col("like")).when((F.col("alike") == 0) & (F.col("opinion_id") != F.col("first_alike")), name("first_alike"))
    return o.select("opinion_id", F.coalesce(to, name("opinion_id")).alias("row_id"), to.isNull().alias("made"))


def attached(rows: DataFrame, opinions: DataFrame, neutral: DataFrame | None = None, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """rows with a row for each opinion that no row is for, and the links: row_id, the opinion, the reason and whether it is adopted.

    opinions has opinion_id, kind, algorithm, purpose, refs (operation or
    finding ids), source_id, line, conflict, gaps, valid, anchored, basis and
    scope_reason, and may have context_id. Abstentions, opinions out of scope
    without a reference, new candidates of algorithms that are no risk, and
    support for operations in neutral alone attach to nothing; those without a
    row to refer to neither, if sources (source_id) hasn't their source. An
    opinion goes to the rows that it refers to, without any to that of its
    place as placed_opinions() says. What it says is adopted by adoption(): a
    pending row becomes assessed with the opinion's algorithm and purpose.

    A row's opinions are judged in the order of their ids, each against the
    algorithm that those before it have left. Only a pending row without an
    algorithm can get one, from the first opinion that is adopted, so this is
    decided by one aggregate.
    """
    if "context_id" not in opinions.columns:
        opinions = opinions.withColumn("context_id", F.lit(None).cast("string"))
    if "context_id" not in rows.columns:
        rows = rows.withColumn("context_id", F.lit(None).cast("string"))
    live = opinions.where((F.col("kind") != "abstain") & ~((F.coalesce("scope_reason", F.lit("")) != "") & (F.size("refs") <= 0)) & ~harmless())
    if neutral is not None:
        refs = live.where("kind = 'supports_static'").select("opinion_id", F.explode("refs").alias("ref"))
        known = neutral.select(F.col("operation_id").cast("string").alias("ref"), F.lit(1).alias("_one"))
        only = refs.join(known, "ref", "left").groupBy("opinion_id").agg(F.count(F.lit(1)).alias("n"), F.count("_one").alias("neutral")).where("n = neutral")
        live = live.join(only, "opinion_id", "left_anti")
    # rows, opinions and links are read several times below
    rows, live = settled(rows), settled(live)
    named = rows.select(F.col("finding_id").alias("row_id"), F.col("finding_id").alias("ref")).unionByName(rows.where("operation_id is not null").select(F.col("finding_id").alias("row_id"), F.col("operation_id").cast("string").alias("ref")))
    by_ref = settled(live.select("opinion_id", F.explode("refs").alias("ref")).join(named, "ref").select("opinion_id", "row_id").distinct())
    free = live.join(by_ref, "opinion_id", "left_anti")
    if sources is not None:
        free = free.join(sources.select("source_id").distinct(), "source_id", "left_semi")
    at_place = settled(placed_opinions(free, rows.where("verification_status = 'pending'")))
    made = free.join(at_place.where("made"), "opinion_id").select(
        F.col("row_id").alias("finding_id"), "source_id", "line",
        F.when(F.col("algorithm") == "unknown", OPEN_ALGORITHM).otherwise(canonical(F.col("algorithm"))).alias("algorithm"), F.lit("unknown").alias("purpose_code"), F.lit("pending").alias("verification_status"), F.lit("ai").alias("origin"), F.lit(None).cast(rows.schema["operation_id"].dataType).alias("operation_id"), "context_id",
    )
    links = by_ref.unionByName(at_place.select("opinion_id", "row_id"))
    everything = rows.unionByName(settled(made), allowMissingColumns=True)  # both are kept already
    said = links.join(everything.select(F.col("finding_id").alias("row_id"), F.col("algorithm").alias("row_algorithm"), (F.col("verification_status") == "pending").alias("_pending")), "row_id").join(live, "opinion_id")
    judged = lambda theirs: adoption(F.col("algorithm"), theirs, F.col("kind"), F.col("conflict"), F.col("gaps"), F.col("valid"), F.col("anchored"), F.col("basis"), F.col("scope_reason"))
    said = settled(said.withColumn("reason", judged(F.col("row_algorithm"))))
    open_ = F.col("_pending") & F.col("row_algorithm").isin("unknown", OPEN_ALGORITHM) & (F.col("reason") == ADOPTED)
    set_ = said.where(open_).groupBy("row_id").agg(F.min("opinion_id").alias("_by"), F.min_by(canonical(F.col("algorithm")), "opinion_id").alias("_set"))
    said = said.join(set_, "row_id", "left").withColumn("row_algorithm", F.when(F.col("opinion_id") > F.col("_by"), F.col("_set")).otherwise(F.col("row_algorithm"))).drop("_by", "_set", "_pending")
    said = said.withColumn("reason", judged(F.col("row_algorithm"))).withColumn("ok", F.col("reason") == ADOPTED)
    return everything, said


def attach_opinions(rows: DataFrame, opinions: DataFrame, neutral: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """rows with opinion_count, adopted, reasons, last_reason, review_required and purpose, and a row for each opinion that no row is for, as attached() links them."""
    everything, said = attached(rows, opinions, neutral, sources)
    last = F.max_by(F.struct("purpose", canonical(F.col("algorithm")).alias("algorithm")), F.when(F.col("ok"), F.col("opinion_id")))
    sums = said.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("opinion_count"), F.max("ok").alias("adopted"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.max_by("reason", "opinion_id").alias("last_reason"),
        F.max((F.col("kind") == "questions_static") | (F.col("reason") == "conflicting_evidence")).alias("review_required"), last.alias("_said"),
    )
    out = everything.join(sums, F.col("finding_id") == F.col("row_id"), "left").withColumn("adopted", F.coalesce("adopted", F.lit(False)))
    turned = F.col("adopted") & (F.col("verification_status") == "pending")
    static, inferred = F.col("purpose_code"), F.when(F.col("adopted"), F.col("_said.purpose")).otherwise("unknown")
    effective = F.when(turned, inferred).when(static == "unknown", inferred).otherwise(static)
    purpose_origin = F.when((inferred != "unknown") & ((static == "unknown") | turned), "ai").when(static != "unknown", "static").otherwise("unknown")
    return out.select(
        "finding_id", "source_id", "line", F.when(turned, F.col("_said.algorithm")).otherwise(F.col("algorithm")).alias("algorithm"), effective.alias("purpose_code"), purpose_origin.alias("purpose_origin"),
        F.when(turned, "ai_assessed").otherwise(F.col("verification_status")).alias("verification_status"),
        F.when(F.col("opinion_count").isNotNull() & (F.col("origin") != "ai"), F.concat(F.col("origin"), F.lit(",ai"))).otherwise(F.col("origin")).alias("origin"),
        "operation_id", "context_id", F.coalesce("opinion_count", F.lit(0)).alias("opinion_count"), "adopted", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), "last_reason", F.coalesce("review_required", F.lit(False)).alias("review_required"),
    )


def harmless() -> Column:
    """Whether an opinion is a new candidate of an algorithm that is no risk."""
    return (F.col("kind") == "new_candidate") & (F.col("algorithm") != "unknown") & ~F.lower(canonical(F.col("algorithm"))).isin([name.lower() for _, name, *_ in PROFILES])


def left_out(opinions: DataFrame) -> DataFrame:
    """Numbers of opinions that make no row: abstained, out of scope, and of algorithms that are no risk."""
    out_of_scope = (F.coalesce("scope_reason", F.lit("")) != "") & (F.size("refs") <= 0)
    said = F.col("kind") != "abstain"
    return opinions.agg(F.count_if(~said).alias("abstained"), F.count_if(said & out_of_scope).alias("scope_excluded"), F.count_if(said & ~out_of_scope & harmless()).alias("non_risks"))


def integrated_assets(rows: DataFrame) -> DataFrame:
    """One row for each status, source and algorithm, with the targets of all its purposes; pending ones have none."""
    code = F.col("purpose_code")
    g = rows.groupBy("verification_status", "source_id", "algorithm").agg(
        F.count(F.lit(1)).alias("finding_count"), F.array_sort(F.collect_set("purpose_code")).alias("purpose_codes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(direction_targets(code))))).alias("_targets"),
        F.when(F.max(F.col("purpose_origin") == "ai"), "ai").otherwise("static").alias("purpose_origin"),
    )
    known = F.array_except("purpose_codes", F.array(F.lit("unknown")))
    none = F.array().cast("array<string>")
    purpose = F.when(F.size(known) > 1, F.array_join(F.array_sort(F.array_distinct(F.transform("purpose_codes", purpose_label))), " / ")).otherwise(purpose_label(F.coalesce(F.get(known, 0), F.lit("unknown"))))
    return g.withColumn("purpose", purpose).withColumn("targets", F.when(F.col("verification_status") == "pending", none).otherwise(F.col("_targets"))).drop("_targets")


def integrated_migrations(rows: DataFrame) -> DataFrame:
    """One row for each algorithm and purpose that is confirmed or assessed, with what to look at."""
    g = rows.where("verification_status in ('confirmed', 'ai_assessed')").groupBy("verification_status", "algorithm", "purpose_code").agg(F.count(F.lit(1)).alias("finding_count"), F.countDistinct("source_id").alias("affected_files"))
    return g.withColumns({"targets": direction_targets(F.col("purpose_code")), "references": F.transform(direction_references(F.col("algorithm"), F.col("purpose_code")), lambda r: r["label"])})


def change_counters(rows: DataFrame, baseline: int | Column) -> DataFrame:
    """How the view differs from the findings alone: one row of counters."""
    base = F.lit(baseline) if isinstance(baseline, int) else baseline
    status = F.col("verification_status")
    return rows.agg(
        base.cast("long").alias("baseline"), F.count_if((status == "confirmed") & (F.col("origin").startswith("cross_file"))).alias("new_confirmed"), F.count_if((status == "confirmed") & (F.col("purpose_code") != "unknown")).alias("purpose_completed"),
        F.count_if(status == "pending").alias("pending"), F.count_if(status == "ai_assessed").alias("ai_assessed"), F.count_if("review_required").alias("review_required"), F.count_if(status == "confirmed").alias("confirmed"),
    )


def first_seen(rows: DataFrame, key: list[str], order: str, **lists: str) -> DataFrame:
    """For each key the distinct values of columns in the order in which they first occur."""
    values = [F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))), lambda x: x["v"])).alias(name) for name, c in lists.items()]
    return rows.groupBy(*key).agg(*values)
