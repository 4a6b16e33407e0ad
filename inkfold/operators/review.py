"""Second opinions on reading order: windows, recorded answers, candidate edits, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Ranks of edits in a window, reasons for which a pass is skipped, modes of the tree.
EDIT_RANK = {"move_before": 0, "move_after": 1, "reparent": 2, "merge_flow": 3, "flag_break": 4}
SKIP_REASONS = ("no_llm_configured", "timeout", "clean_single_column", "no_geometry", "budget_exhausted")
SCHEMA, VERIFIER = "inkfold-arrangement/1", "inkfold-verifier/1"


def tree_mode(requested: Column, configured: Column) -> Column:
    """Whether a tree is made: a request can opt out, and in where the setting is off; it never makes more of a tree."""
    return F.when(~requested, "off").when(requested & (configured == "off"), "build").otherwise(configured)


def band_windows(nodes: DataFrame, keys: list[str], order: str, band: str, cap: int = 48) -> DataFrame:
    """Nodes of a run with window: at most ``cap`` together, cut where the band changes last within that, or hard in a band that is
    longer. A fold over the run's bands in the JVM; a run is one page's nodes."""
    run = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(band).alias("b")))).alias("n"))
    # state: where the window starts, where the band changed last, all cuts
    turn = "if(i > s.at and not (get(n, i).b <=> get(n, i - 1).b), i, s.turn)"
    cut = f"if({turn} > s.at, {turn}, i)"
    step = f"(s, i) -> if(i - s.at = {cap}, struct({cut} as at, {cut} as turn, concat(s.cuts, array({cut})) as cuts), struct(s.at as at, {turn} as turn, s.cuts as cuts))"
    cut = run.withColumn("cuts", F.expr(f"aggregate(sequence(0, size(n) - 1), struct(0 as at, 0 as turn, cast(array() as array<int>) as cuts), {step}).cuts"))
    rows = cut.select(*keys, F.posexplode("n").alias("i", "x"), "cuts")
    window = F.size(F.filter("cuts", lambda c: c <= F.col("i")))
    return rows.select(*keys, F.col("x.o").alias(order), F.col("x.b").alias(band), window.alias("window"))


def unfenced(text: Column) -> Column:
    """Text without one code fence around it."""
    t = T.strip(text)
    inner = F.regexp_extract(t, r"(?s)\A```[^\n]*\n(.*)```\z", 1)
    return F.when(t.rlike(r"(?s)\A```[^\n]*\n.*```\z"), T.strip(inner)).otherwise(t)


def parsed_samples(samples: DataFrame, text: str = "text") -> DataFrame:
    """Adds ops (null where discarded) and discarded: not_json for what is not one JSON object, bad_schema for one that is no list of
    known edits; an answer is taken whole or not at all."""
    v = F.try_parse_json(unfenced(F.col(text)))
    s = samples.withColumn("_v", v)
    s = s.withColumns({"_object": F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)), "_ops": F.try_variant_get("_v", "$.ops", "array<struct<op:string,node:bigint,ref:bigint,confidence:double>>")})
    known = lambda o: o["op"].isin(*EDIT_RANK) & o["node"].isNotNull() & (o["confidence"].isNull() | o["confidence"].between(0, 1))
    good = F.coalesce(F.forall("_ops", lambda o: F.coalesce(known(o), F.lit(False))), F.lit(False))
    s = s.withColumn("discarded", F.when(~F.col("_object"), "not_json").when(~good, "bad_schema"))
    return s.withColumn("ops", F.when(F.col("discarded").isNull(), F.col("_ops"))).drop("_v", "_object", "_ops")


def replayed(payloads: DataFrame, answers: DataFrame) -> DataFrame:
    """Recorded answers (payload_sha256, sample_ix, text) for windows, by the hash of what was asked (column payload)."""
    asked = payloads.withColumn("payload_sha256", F.sha2("payload", 256))
    return asked.join(answers, "payload_sha256", "left")


def candidate_order(ops: DataFrame, keys: list[str]) -> DataFrame:
    """One of each edit (op, node, ref), the first by sample and place, with pos: by page, rank of the edit, node, reference."""
    first = Window.partitionBy(*keys, "op", "node", "ref").orderBy("sample_ix", "op_ix")
    one = ops.withColumn("_f", F.row_number().over(first)).where("_f = 1").drop("_f")
    rank = F.coalesce(*(F.when(F.col("op") == k, F.lit(r)) for k, r in EDIT_RANK.items()))
    w = Window.partitionBy(*keys).orderBy("page", rank, "node", F.coalesce("ref", F.lit(-1)))
    return one.withColumn("pos", F.row_number().over(w) - 1)


def ascii_json(json: Column) -> Column:
    """JSON with all characters beyond ASCII escaped, those beyond 16 bits as two."""
    esc = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    point = lambda c: F.ascii(c).cast("long")
    high = lambda c: F.floor((point(c) - 0x10000) / 1024).cast("long")
    pair = lambda c: F.concat(esc(high(c) + 0xD800), esc(F.pmod(point(c) - 0x10000, F.lit(1024)) + 0xDC00))
    one = lambda c: F.when(point(c) < 128, c).when(point(c) < 0x10000, esc(point(c))).otherwise(pair(c))
    return F.when(json.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(json, ""), one), "")).otherwise(json)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON of the fields in order of their names, without nulls, in ASCII. Structs among them are to have ordered fields."""
    return ascii_json(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))))


def artifact(doc_id: Column, sha256_tree: Column, status: Column, reason: Column, model_id: Column, samples: Column, accepted: Column, review: Column) -> Column:
    """The canonical record of a pass: one that ran tells its model, samples and edits; one that was skipped a reason of the known ones
    (no_llm_configured for any other); one that failed its error's name."""
    ran, skipped = status == "ran", status == "skipped"
    known = F.when(reason.isin(*SKIP_REASONS), reason).otherwise("no_llm_configured")
    return canonical_json(
        {
            "schema": F.lit(SCHEMA),
            "verifier_version": F.lit(VERIFIER),
            "doc_id": doc_id,
            "sha256_tree": sha256_tree,
            "status": F.when(ran | skipped, status).otherwise(F.concat(F.lit("error:"), reason)),
            "reason": F.when(skipped, known),
            "model_id": F.when(ran, model_id),
            "samples": F.when(ran, samples),
            "accepted_ops": F.when(ran, accepted),
            "review_queue": F.when(ran, review),
        }
    )


def violations(nodes: DataFrame, flow: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, violation) of trees: ids that are no pre-order, roots, references and edges that do not hold; none for a sound tree.
    nodes: keys, id, parent, kind; flow: keys, src, dst. Claims are looked at by ``joins.claims_exact``."""
    item = F.struct("id", "parent", "kind")
    t = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("n"))
    ids = F.transform("n", lambda x: x["id"])
    # the parent of each node must be on the path to the node before it
    walk = F.expr("aggregate(n, struct(cast(array() as array<bigint>) as path, true as fine), (s, x) -> struct(if(x.parent is null, array(x.id), concat(slice(s.path, 1, cast(array_position(s.path, x.parent) as int)), array(x.id))) as path, s.fine and if(x.parent is null, size(s.path) = 0, array_position(s.path, x.parent) > 0) as fine)).fine")
    of = lambda k: F.transform(F.filter("n", lambda x: x["kind"] == k), lambda x: x["id"])
    top = F.filter("n", lambda x: x["parent"] == 0)
    checks = [
        ("I1:id_index", ids != F.transform(F.sequence(F.lit(1), F.size("n")), lambda i: (i - 1).cast("long"))),
        ("I1:preorder", ~walk),
        ("I2:document_root", of("document") != F.array(F.lit(0).cast("long"))),
        ("I2:root_children", F.transform(top, lambda x: x["kind"]) != F.array(F.lit("body"), F.lit("furniture"))),
        ("I2:parent_ref", F.exists("n", lambda x: (x["id"] != 0) & (x["parent"].isNull() | ~F.array_contains(ids, x["parent"])))),
    ]
    shape = t.select(*keys, F.explode(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks)), lambda v: v.isNotNull())).alias("violation"))
    kinds = nodes.select(*keys, "id", "kind")
    e = flow.join(kinds.select(*keys, F.col("id").alias("src"), F.col("kind").alias("_s")), [*keys, "src"], "left").join(kinds.select(*keys, F.col("id").alias("dst"), F.col("kind").alias("_d")), [*keys, "dst"], "left")
    again = F.row_number().over(Window.partitionBy(*keys, "dst").orderBy("src")) > 1
    fine = (F.col("src") < F.col("dst")) & (F.coalesce("_s", F.lit("")) == "paragraph") & (F.coalesce("_d", F.lit("")) == "paragraph")
    bad = e.withColumn("_again", again).where(~fine | F.col("_again")).select(*keys, F.lit("I4:flow").alias("violation")).distinct()
    return shape.unionByName(bad)
