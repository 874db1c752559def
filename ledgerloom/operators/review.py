"""Human review as a fold over events, and the checks and audit of its results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import present
from ledgerloom.operators.ledger import DOC, KEY, ORDER

PAGE = [DOC, "page_index"]


def last_edits(events: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The last non-empty value entered per row and field (E1): key, field_name, value."""
    key = key or KEY
    edits = events.where("action = 'edit' and value <> ''")
    return edits.groupBy(*key, "field_name").agg(F.max_by("value", "ord").alias("value"))


def apply_review(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates after accept, reject, mark_duplicate and edit events.

    The last decision on a row stands. Accepting promotes each field's last edit before the decision, else
    its suggestion, to final text; accepting and rejecting clear duplicate_of. A row cannot be a duplicate of
    itself; such an event is ignored. Rows without decisions are unchanged.
    """
    own = (F.col("related_page_index") == F.col("page_index")) & (F.col("related_row_index") == F.col("row_index"))
    decisions = events.where(F.col("action").isin("accept", "reject") | ((F.col("action") == "mark_duplicate") & ~own))
    last = decisions.groupBy(*KEY).agg(F.max(F.struct("ord", "action", "related_page_index", "related_row_index")).alias("d"))
    edits = events.where("action = 'edit' and value <> ''").join(last, KEY).where("ord < d.ord")
    # An earlier decision on the row used up the edits before it.
    spent = decisions.where(F.col("action").isin("accept", "reject")).select(*KEY, F.col("ord").alias("spent"))
    edits = edits.select(*KEY, "field_name", "ord", "value", F.col("d.ord").alias("_at")).join(spent, KEY, "left")
    edits = edits.groupBy(*KEY, "field_name", "ord", "value", "_at").agg(F.max(F.when(F.col("spent") < F.col("_at"), F.col("spent"))).alias("spent"))
    edits = edits.where("spent is null or ord > spent").groupBy(*KEY, "field_name").agg(F.max_by("value", "ord").alias("value"))
    corrections = edits.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("field_name", "value"))).alias("corrections"))
    df = candidates.join(last, KEY, "left").join(corrections, KEY, "left")
    action = F.coalesce(F.col("d.action"), F.lit(""))
    accepted = F.transform_values("fields", lambda n, v: v.withField("final_text", F.coalesce(F.try_element_at("corrections", n), v["suggested_text"])))
    changes = {
        "fields": F.when(action == "accept", accepted).otherwise(F.col("fields")),
        "status": F.when(action == "accept", "accepted").when(action == "reject", "rejected").when(action == "mark_duplicate", "duplicate").otherwise(F.col("status")),
        "duplicate_of": F.when(action == "mark_duplicate", F.struct(F.col("d.related_page_index").alias("page_index"), F.col("d.related_row_index").alias("row_index")))
        .when(action.isin("accept", "reject"), F.lit(None)).otherwise(F.col("duplicate_of")),
    }
    return df.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in candidates.columns])


def renumber(candidates: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """review_order as 0, 1, ... inside each page (W8), by the given order or the present one."""
    order = order or [F.coalesce("review_order", "row_index"), F.col("row_index"), F.col(ORDER)]
    return candidates.withColumn("review_order", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)) - 1)


def move_rows(candidates: DataFrame, moves: DataFrame) -> DataFrame:
    """Candidates with some rows moved to a position of their page (E4): moves hold key, target and, where a page has several, ord.

    Moves of a page run one after the other over the page's list of rows: a row is taken out and put back at
    its target, at the end where that lies beyond. Rows of one key move together, unknown keys move nothing.
    """
    if "ord" not in moves.columns:
        moves = moves.withColumn("ord", F.lit(0))
    steps = moves.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ord", "row_index", "target"))).alias("_moves"))
    rows = renumber(candidates).groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("review_order", "row_index"))), lambda r: r["row_index"]).alias("_rows"))

    def step(rows: Column, move: Column) -> Column:
        left, own = F.filter(rows, lambda r: r != move["row_index"]), F.filter(rows, lambda r: r == move["row_index"])
        return F.concat(F.slice(left, 1, move["target"]), own, F.slice(left, move["target"] + 1, F.size(left)))

    order = rows.join(steps, PAGE).select(*PAGE, F.array_distinct(F.aggregate("_moves", F.col("_rows"), step)).alias("_order"))
    df = candidates.join(order, PAGE, "left").withColumn("_place", F.array_position("_order", F.col("row_index")))
    present_order = [F.coalesce("review_order", "row_index"), F.col("row_index"), F.col(ORDER)]
    return renumber(df, [F.col("_place"), *present_order]).select(*candidates.columns)


def merge_rows(candidates: DataFrame, merges: DataFrame) -> DataFrame:
    """Candidates with pairs of rows merged into the first (E5).

    merges hold key and second_row of the same page. Texts of a field that both have are joined by ' | ',
    confidence is the lower, sources are united, final texts are cleared; the row is unreviewed again.
    """
    field = candidates.schema["fields"].dataType.valueType
    pair = merges.select(*KEY, "second_row")
    second = candidates.select(*PAGE, F.col("row_index").alias("second_row"), F.col("fields").alias("_other"), F.col("parser_id").alias("_other_parser"))
    gone = merges.select(*PAGE, F.col("second_row").alias("row_index"))
    df = candidates.join(gone, KEY, "left_anti").join(pair, KEY, "left").join(second, [*PAGE, "second_row"], "left")
    join = lambda a, b: present(F.concat_ws(" | ", present(a), present(b)))

    def both(_: Column, a: Column, b: Column) -> Column:
        one, other = F.coalesce(a, b), F.coalesce(b, a)
        pairwise = a.isNotNull() & b.isNotNull()
        return F.struct(
            F.when(pairwise, F.concat(a["raw_text"], F.lit(" | "), b["raw_text"])).otherwise(one["raw_text"]).alias("raw_text"),
            F.when(pairwise, join(a["suggested_text"], b["suggested_text"])).otherwise(one["suggested_text"]).alias("suggested_text"),
            F.lit(None).cast("string").alias("final_text"),
            F.when(pairwise, join(a["secondary_text"], b["secondary_text"])).otherwise(one["secondary_text"]).alias("secondary_text"),
            F.least(one["confidence"], other["confidence"]).alias("confidence"),
            F.array_distinct(F.concat(F.coalesce(one["source_block_indices"], F.array().cast("array<int>")), F.coalesce(other["source_block_indices"], F.array().cast("array<int>")))).alias("source_block_indices"),
        ).cast(field)

    merged = F.col("_other").isNotNull()
    changes = {
        "fields": F.when(merged, F.map_zip_with("fields", "_other", both)).otherwise(F.col("fields")),
        "parser_id": F.when(merged, F.concat(F.lit("review:merge:"), F.concat_ws("+", "parser_id", "_other_parser"))).otherwise(F.col("parser_id")),
        "status": F.when(merged, "unreviewed").otherwise(F.col("status")),
        "duplicate_of": F.when(merged, F.lit(None)).otherwise(F.col("duplicate_of")),
    }
    return renumber(df.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in candidates.columns]))


def split_rows(candidates: DataFrame, splits: DataFrame) -> DataFrame:
    """Candidates with fields of some rows moved into new rows of their page (E6): splits hold key and names.

    The new row's index follows the page's largest (A24). A split that takes no field, or all, is ignored;
    both rows are unreviewed.
    """
    most = Window.partitionBy(*PAGE)
    df = candidates.join(splits.select(*KEY, "names"), KEY, "left").withColumn("_most", F.max("row_index").over(most))
    taken = F.array_intersect("names", F.map_keys("fields"))
    valid = (F.size(taken) > 0) & (F.size(taken) < F.size(F.map_keys("fields")))
    df = df.withColumn("_split", F.coalesce(valid, F.lit(False)))
    order = Window.partitionBy(*PAGE, "_split").orderBy("row_index", ORDER)
    df = df.withColumn("_new", F.col("_most") + F.row_number().over(order))
    keep = F.map_filter("fields", lambda n, _: ~F.array_contains("names", n))
    move = F.map_filter("fields", lambda n, _: F.array_contains("names", n))
    after = F.coalesce("review_order", "row_index").cast("double")
    change = lambda c, **to: to[c].alias(c) if c in to else F.col(c)
    fresh = {"status": F.when(F.col("_split"), "unreviewed").otherwise(F.col("status")), "duplicate_of": F.when(F.col("_split"), F.lit(None)).otherwise(F.col("duplicate_of"))}
    old = df.select(*[change(c, fields=F.when(F.col("_split"), keep).otherwise(F.col("fields")), **fresh) for c in candidates.columns], after.alias("_place"))
    new = df.where("_split").select(
        *[change(c, fields=move, row_index=F.col("_new").cast("int"), parser_id=F.concat(F.lit("review:split:"), "parser_id"), **fresh) for c in candidates.columns], (after + 0.5).alias("_place")
    )
    return renumber(old.unionByName(new), [F.col("_place"), F.col("row_index")]).select(*candidates.columns)


def add_rows(candidates: DataFrame, added: DataFrame) -> DataFrame:
    """Candidates with missing rows added at the end of their page (E7); a taken key is replaced by the next free row index."""
    key_taken = added.join(candidates.select(*KEY), KEY, "left_semi")
    free = added.join(candidates.select(*KEY), KEY, "left_anti")
    most = candidates.groupBy(*PAGE).agg(F.max("row_index").alias("_most"))
    order = Window.partitionBy(*PAGE).orderBy("row_index", ORDER)
    moved = key_taken.join(most, PAGE).withColumn("row_index", (F.col("_most") + F.row_number().over(order)).cast("int")).drop("_most")
    return renumber(candidates.unionByName(free.unionByName(moved).withColumn("review_order", F.lit(1 << 30))))


def manual_fields(text: Column | str) -> Column:
    """Field map of 'name=value;name=value' (F46); null where a part is empty or has no '='."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.transform(F.filter(F.split(text, ";"), lambda p: F.trim(p) != ""), lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))).alias("key"), F.trim(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value")))
    ok = (F.size(parts) > 0) & F.forall(parts, lambda p: (p["key"] != "") & (p["value"] != ""))
    distinct = F.size(F.array_distinct(F.transform(parts, lambda p: p["key"]))) == F.size(parts)
    return F.when(ok & distinct, F.map_from_entries(parts))


def snapshot_faults(candidates: DataFrame) -> DataFrame:
    """What is wrong with a snapshot (M11, J16, J17): key and fault duplicate_key, duplicate_order or unknown_duplicate_of. Empty means sound."""
    keys = candidates.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY, F.lit("duplicate_key").alias("fault"))
    orders = candidates.where("review_order is not null").groupBy(*PAGE, "review_order").agg(F.count(F.lit(1)).alias("n"), F.max("row_index").alias("row_index")).where("n > 1")
    orders = orders.select(*KEY, F.lit("duplicate_order").alias("fault"))
    refs = candidates.where("duplicate_of is not null").select(*KEY, F.col("duplicate_of.page_index").alias("_p"), F.col("duplicate_of.row_index").alias("_r"))
    known = candidates.select(F.col(DOC), F.col("page_index").alias("_p"), F.col("row_index").alias("_r"))
    lost = refs.join(known, [DOC, "_p", "_r"], "left_anti").select(*KEY, F.lit("unknown_duplicate_of").alias("fault"))
    return keys.unionByName(orders).unionByName(lost)


def audit(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that a review changed, with both states as JSON (M9): key, before_json, after_json; an added or removed row has null on one side."""
    state = lambda df, name: df.select(*KEY, F.to_json(F.struct(*columns)).alias(name))
    both = state(before, "before_json").join(state(after, "after_json"), KEY, "full_outer")
    return both.where(~F.col("before_json").eqNullSafe(F.col("after_json")))


REVIEWED = ("status", "duplicate_of", "review_order", "fields")


def affected_pages(candidates: DataFrame, operations: DataFrame) -> DataFrame:
    """Pages that a structure review touches (U6): those of its candidates and of its operations."""
    return candidates.select(*PAGE).union(operations.select(*PAGE)).distinct()


def save_review(stored: DataFrame, reviewed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(after, events, unknown) of saving reviewed rows over the stored ones.

    after is the stored table with the reviewed rows in place; events are candidate_updated rows with both
    states as JSON where one changed; unknown are reviewed keys that are not stored: where there is one,
    nothing may be saved, so after and events leave such rows out. reviewed holds a key once.
    """
    from ledgerloom.operators.runs import upsert

    keys = stored.select(*KEY).distinct()
    known, unknown = reviewed.join(keys, KEY, "left_semi"), reviewed.join(keys, KEY, "left_anti").select(*KEY)
    changed = audit(stored.join(known.select(*KEY), KEY, "left_semi"), known, list(REVIEWED))
    return upsert(stored, known, KEY), changed.withColumn("action", F.lit("candidate_updated")), unknown


def _page_states(candidates: DataFrame, name: str) -> DataFrame:
    """All rows of each page as one JSON text, in review order; a page is bounded."""
    columns = ["page_index", "row_index", "parser_id", *REVIEWED]
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce("review_order", "row_index").alias("o"), F.col("row_index").alias("r"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("j"))))
    return candidates.groupBy(*PAGE).agg(F.concat(F.lit('{"candidates":['), F.array_join(F.transform(rows, lambda x: x["j"]), ","), F.lit("]}")).alias(name))


def save_structure_review(stored: DataFrame, reviewed: DataFrame, operations: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(after, events, faults) of replacing whole pages by their reviewed rows.

    after is the stored table without the affected pages, and the reviewed rows. events hold the page, the row (-1
    for a whole page), action and both states of the page as JSON: one for each operation (page, row_index,
    action), else a structure_snapshot of every page that changed. faults are those of snapshot_faults in
    the reviewed rows: where there is one, nothing may be saved.
    """
    pages = affected_pages(reviewed, operations) if operations is not None else reviewed.select(*PAGE).distinct()
    after = stored.join(pages, PAGE, "left_anti").unionByName(reviewed)
    none = F.lit('{"candidates":[]}')
    states = pages.join(_page_states(stored, "before_json"), PAGE, "left").join(_page_states(reviewed, "after_json"), PAGE, "left")
    states = states.withColumns({c: F.coalesce(c, none) for c in ("before_json", "after_json")})
    if operations is not None:
        events = operations.select(*PAGE, F.coalesce("row_index", F.lit(-1)).alias("row_index"), "action").join(states, PAGE)
    else:
        events = states.where("before_json <> after_json").select(*PAGE, F.lit(-1).alias("row_index"), F.lit("structure_snapshot").alias("action"), "before_json", "after_json")
    return after, events, snapshot_faults(reviewed)
