"""Queries on identity, references, dates, queues, merges and audits, over data that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.functions import text
from veritrail.operators import evidence, identity, merge, queue, relational, research, resolution, segments, temporal
from veritrail.streaming import frames

from veritrail.plans.text_queries import _TYPE, SEG

NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_latest_order(spark, d):
    out = relational.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_totalprice"), F.desc("o_orderkey")])
    return out.select("o_custkey", "o_orderkey", "o_orderstatus")


def q_ambiguous_latest(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"), "l_suppkey")
    return relational.ambiguous_latest(li, ["l_partkey"], "day", "l_suppkey")


def q_foreign_keys(spark, d):
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "labels", "documents")}
    pairs = [("lineitem.order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem.part", "lineitem", "l_partkey", "part", "p_partkey"), ("lineitem.supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders.customer", "orders", "o_custkey", "customer", "c_custkey"), ("customer.nation", "customer", "c_nationkey", "nation", "n_nationkey"), ("supplier.nation", "supplier", "s_nationkey", "nation", "n_nationkey"), ("nation.region", "nation", "n_regionkey", "region", "r_regionkey"), ("labels.document", "labels", "doc_id", "documents", "doc_id")]
    return relational.missing_parents([(n, t[a], b, t[c], e) for n, a, b, c, e in pairs])


def q_orphan_customers(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def q_returned_orders(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(returned, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def q_label_sync(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return relational.symmetric_difference(docs, table(spark, d, "labels").select("doc_id"), "doc_id")


def q_text_conflicts(spark, d):
    return relational.conflicts(table(spark, d, "documents").withColumn("opening", F.left("text", F.lit(12))), ["opening"], "text")


def q_near_purchase(spark, d):
    e = table(spark, d, "events")
    out = relational.within_rows(e, "user_id", "event_id", F.col("event_type") == "purchase", 2, "near_purchase")
    return out.where("near_purchase").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def q_as_of_value(spark, d):
    e = table(spark, d, "events")
    asked = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    seen = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("since"), "value")
    out = relational.as_of(asked, seen, "user_id", "ts", "since", "value")
    return out.select("event_id", "user_id", F.round(F.col("as_of_value") * 1e6).cast("long").alias("value_e6"))


def q_check_examples(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("check"), F.col("p_partkey").alias("ref"))
    return relational.first_examples(p, "check", "ref", 5)


def q_resolve_parts(spark, d):
    """Parts cited by brand and size: none, one or several."""
    key = F.concat_ws("/", F.col("p_brand"), F.col("p_size").cast("string"))
    parts = table(spark, d, "part").select(key.alias("key"), F.col("p_partkey").alias("target"))
    cited = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), F.concat_ws("/", F.col("p_brand"), (F.col("p_size") + F.col("l_orderkey") % 3).cast("string")).alias("key"))
    return resolution.resolve(cited, parts, "ref", "key", "target").select("ref", "matches", "status", "resolved_target")


_CITE_SPARK = "concat('Por la cual se ', CASE o_orderkey % 5 WHEN 0 THEN 'modifica' WHEN 1 THEN 'deroga' WHEN 2 THEN 'adiciona' WHEN 3 THEN 'sustituye' ELSE 'cita' END, ' el Artículo ', CAST(o_orderkey % 90 + 1 AS STRING), ' de la Ley ', CAST(o_custkey % 300 + 1 AS STRING), ' de ', CAST(1990 + o_custkey % 30 AS STRING), ' y el Decreto ', CAST(o_orderkey % 1000 AS STRING), ' de ', CAST(2000 + o_orderkey % 20 AS STRING), '.')"
_CITE_DUCK = _CITE_SPARK.replace("STRING", "VARCHAR")


def _citations(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("text_id"), F.expr(_CITE_SPARK).alias("text"))


def q_mentions(spark, d):
    return resolution.mentions(_citations(spark, d)).withColumn("mention_no", F.col("mention_no").cast("long")).withColumn("year", F.col("year").cast("long"))


def q_relation_triggers(spark, d):
    return _citations(spark, d).select("text_id", resolution.trigger_type(F.col("text")).alias("relation"))


def q_mention_states(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("mention"), F.when(F.col("l_linenumber") % 4 == 3, "unresolved").when(F.col("l_quantity") > 48, "ambiguous").otherwise("resolved").alias("status"), F.when(F.col("l_tax") < 0.07, F.col("l_suppkey") % 2).alias("target"), (F.col("l_discount") > 0.095).alias("review"))
    return resolution.resolution_state(rows, "mention")


def q_promotions(spark, d):
    o = table(spark, d, "orders")
    relations = o.select(F.col("o_orderkey").alias("ref"), F.lit(0.9).alias("relation_confidence"), F.lit("modifies").alias("relation_type"))
    resolved = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("ref"), F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "unresolved").otherwise("ambiguous").alias("status"), F.lit(0.8).alias("resolution_confidence"))
    return resolution.promote(relations, resolved, "ref").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence") * 10).cast("long").alias("confidence_x10"))


_NAME_SPARK = "CASE o_orderkey % 8 WHEN 0 THEN concat('ley_', lpad(CAST(o_custkey AS STRING), 5, '0'), '_', CAST(1990 + o_custkey % 30 AS STRING), '.htm') WHEN 1 THEN concat('decreto_', CAST(o_custkey AS STRING), '_2001.htm') WHEN 2 THEN concat('resolucion_dian_', lpad(CAST(o_custkey AS STRING), 6, '0'), '_2010.htm') WHEN 3 THEN concat('oficio_dian_', CAST(o_custkey AS STRING), '_2015.htm') WHEN 4 THEN concat('c-', CAST(o_custkey AS STRING), '_1999.htm') WHEN 5 THEN concat('conpes_dnp_', CAST(o_custkey AS STRING), '_2008.htm') WHEN 6 THEN 'oficio_dian_sin.htm' ELSE 'index.htm' END"


def _names(spark, d):
    fam = table(spark, d, "orders").select(F.col("o_orderkey").alias("document"), F.expr(_NAME_SPARK).alias("name")).select("document", F.inline(F.array(identity.source_family(F.col("name")))))
    issuer = F.when(F.col("doc_type").isin("OFICIO", "RESOLUCION"), "DIAN").when(F.col("doc_type") == "CONPES", "DNP").when(F.col("doc_type") == "SENTENCIA_C", "CORTE")
    return fam.select("document", "family", "doc_type", "number", "year", identity.canonical_key(F.col("doc_type"), F.col("number"), F.col("year"), issuer).alias("key"))


def q_source_families(spark, d):
    return _names(spark, d).groupBy("family", "doc_type").agg(F.count(F.lit(1)).alias("n"), F.count("number").alias("with_number"), F.countDistinct("key").alias("keys"))


def q_key_collisions(spark, d):
    return identity.key_collisions(_names(spark, d))


def q_spanish_dates(spark, d):
    """Dates written out in Spanish and read back; every seventh names a day that does not exist."""
    o = table(spark, d, "orders")
    month = F.element_at(F.array(*[F.lit(m) for m in text.MONTHS]), F.month("o_orderdate"))
    day = F.when(F.col("o_orderkey") % 7 == 0, F.lit("31 de Febrero")).otherwise(F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit(" de "), F.initcap(month)))
    written = F.concat(day, F.when(F.col("o_orderkey") % 2 == 0, " de ").otherwise(" del "), F.year("o_orderdate").cast("string"))
    return o.select("o_orderkey", text.spanish_date(written).alias("read"))


def q_date_roles(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), F.when(F.col("l_linenumber") % 2 == 0, "issued_date").otherwise("publication_date").alias("role"), F.to_date("l_shipdate").alias("value"), (F.col("l_returnflag") == "R").alias("is_trusted"))
    return temporal.resolve_roles(c)


def q_effect_at(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), F.when(F.col("l_returnflag") == "R", "repealed").otherwise("enters_into_force").alias("event_type"), F.to_date("l_shipdate").alias("starts"), F.when(F.col("l_linestatus") == "F", F.date_add(F.to_date("l_shipdate"), 400)).alias("ends"), (F.col("l_tax") > 0.078).alias("ambiguous_start"))
    return temporal.effect_at(e, F.lit("1997-06-01").cast("date"), ["repealed"])


def _queue(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("https://h/"), F.col("event_id").cast("string")).alias("url"), F.when(F.col("event_id") % 10 == 0, "index").otherwise("document").alias("item_type"), (F.col("user_id") % 4).alias("depth"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "done").otherwise("pending").alias("status"),
        F.when(F.col("event_type") != "signup", F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("due"), F.col("ts").alias("first_seen"), F.col("ts").alias("started"), (F.col("event_id") % 12).alias("attempts"),
    )


def q_queue_head(spark, d):
    return queue.head(_queue(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp"), 100).select("url", "item_type", "depth", "status")


def q_queue_advance(spark, d):
    q = queue.fail_stale(_queue(spark, d), F.lit(NOW).cast("timestamp"), 86_400)
    outcomes = q.where("attempts % 3 <> 0").select("url", (F.col("attempts") % 3 == 1).alias("ok"))
    out = queue.advance(q, outcomes, F.lit(NOW).cast("timestamp"))
    return out.groupBy("status", "attempts").agg(F.count(F.lit(1)).alias("n"), F.sum(F.unix_timestamp("due")).alias("due_sum"))


def q_queue_status(spark, d):
    return _queue(spark, d).groupBy("item_type", "status").count().withColumnRenamed("count", "n")


def q_insert_new(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    old, new = o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 2 = 0")
    return merge.insert_new(old, new.union(new.withColumn("o_totalprice", F.col("o_totalprice") + 1)), "o_orderkey").select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


def q_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    new = c.where("c_custkey % 2 = 0").select((F.col("c_custkey") + 500).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.when(F.col("c_custkey") % 4 == 0, F.col("cents") + 1).alias("cents"))
    return merge.upsert(c, new, "c_custkey", ["cents"])


def q_differing_payloads(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return merge.differing(o, o.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus"))), "o_orderkey", "o_orderstatus")


def q_round_robin(spark, d):
    tasks = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return research.round_robin(tasks.withColumn("task", F.col("turn")), "conv_id", "task").select("conv_id", "task", F.col("turn").cast("long").alias("round"))


def q_budget_cut(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.concat_ws(":", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string")).alias("ref"))
    return research.within_budget(li, "l_suppkey", "ref", 5).groupBy("l_suppkey").agg(F.sum(F.col("selected").cast("long")).alias("selected"), F.sum((~F.col("selected")).cast("long")).alias("left_out"))


def q_execution_coverage(spark, d):
    li = table(spark, d, "lineitem")
    outcome = F.when(F.col("l_quantity") < 3, "blocked").when(F.col("l_quantity") < 6, "budget_exhausted").when(F.col("l_quantity") > 46, F.lit(None)).when(F.col("l_tax") > 0.04, "hits").otherwise("no_hits")
    steps = li.select(F.col("l_orderkey").alias("aspect"), (F.col("l_linenumber") % 3).alias("task"), F.col("l_linenumber").alias("round"), outcome.alias("outcome"))
    return research.execution_status(steps, "aspect", "task")


def _graph(spark, d):
    """Parts and the suppliers that deliver them; suppliers are the nodes below zero, so that no number of parts makes two nodes one."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b")).distinct()


def q_one_hop(spark, d):
    return research.one_hop(_graph(spark, d), table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("node")))


def q_edge_relevance(spark, d):
    chosen = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("node")).union(table(spark, d, "supplier").where("s_nationkey < 8").select((-1 - F.col("s_suppkey")).alias("node")))
    return research.edge_relevance(_graph(spark, d), chosen).groupBy("relevance").agg(F.count(F.lit(1)).alias("n"))


def q_answer_sessions(spark, d):
    """Turns grouped under the user's question that they answer."""
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, d, "conversations").withColumn("question", F.sum((F.col("role") == "user").cast("long")).over(by))
    return c.groupBy("conv_id", "question").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text").cast("long")).alias("chars"))


def _frames(spark, d):
    """Events as polled frames: content, readable time (every 13th has none) and how sure it is."""
    e = table(spark, d, "events")
    return e.select("event_id", F.col("ts").alias("polled_at"), F.when(F.col("event_id") % 13 > 0, F.col("ts")).alias("frame_ts"), F.when(F.col("event_id") % 13 > 0, F.lit(1.0) - F.col("user_id") % 10 / 10).alias("confidence"), F.sha2(F.concat_ws("|", "event_type", "props", (F.col("event_id") / 50).cast("int").cast("string")), 256).alias("frame_sha"))


def q_rolling_window(spark, d):
    """Frames of the last six hours, each content once."""
    good, _ = frames.split_untrusted(_frames(spark, d), 0.3)
    return frames.retained(frames.first_sight(good), 6).select("event_id", "frame_sha")


def q_rejected_frames(spark, d):
    """Frames without a readable time or of too little confidence, by reason."""
    _, bad = frames.split_untrusted(_frames(spark, d), 0.3)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def q_frame_cycles(spark, d):
    out = frames.cycle_counts(_frames(spark, d), 0.3)
    return out.select(F.unix_timestamp("cycle.start").alias("cycle"), "frames", "contents", "repeats", "rejected")


def q_thresholds(spark, d):
    """Amounts against a limit, with exact margins in canonical text."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    margin = F.lit(25000).cast("decimal(18,2)") - F.col("amount")
    return li.select("l_orderkey", "l_linenumber", (F.col("amount") < 25000).alias("passes"), text.decimal_text(margin).alias("margin"))


def q_contained_spans(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("text_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_id"), (F.col("l_partkey") % 997).alias("start"), (F.col("l_partkey") % 997 + F.col("l_quantity").cast("int")).alias("end"))
    out = evidence.contained_spans(li.where("end - start < 5"), li.where("end - start > 45"), "text_id")
    return out.groupBy("text_id").agg(F.count(F.lit(1)).alias("contained"), F.countDistinct("inner_id").alias("mentions"))


def q_anchor_context(spark, d):
    """Context of every segment among its neighbours of one type."""
    typed = segments.classify(segments.segments(table(spark, d, "documents")))
    return evidence.expand_anchor(typed, F.lit(True), "segment_type", 4)


def q_document_lifecycle(spark, d):
    c = table(spark, d, "customer")
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum((F.col("o_orderpriority") == "1-URGENT").cast("long")).alias("manifestations"), F.sum((F.col("o_orderstatus") == "P").cast("long")).alias("bindings"), F.sum((F.col("o_totalprice") > 300_000).cast("long")).alias("evidence"), F.sum((F.col("o_totalprice") > 450_000).cast("long")).alias("invalid_evidence"), F.sum((F.col("o_totalprice") > 350_000).cast("long")).alias("primary_evidence"))
    joined = c.select("c_custkey", (F.col("c_nationkey") % 3).alias("primary_keys")).join(orders, "c_custkey", "left").fillna(0)
    return evidence.lifecycle(joined).groupBy("lifecycle").agg(F.count(F.lit(1)).alias("n"))


def q_authority_states(spark, d):
    li = table(spark, d, "lineitem")
    signals = li.select(F.col("l_orderkey").alias("authority"), F.when(F.col("l_tax") > 0.03, F.when(F.col("l_returnflag") == "R", "guidance").otherwise("norm")).alias("function"), F.when(F.col("l_discount") > 0.02, F.col("l_linestatus")).alias("family"), F.when(F.col("l_quantity") > 10, F.lit("ISSUER")).alias("issuer"), (F.col("l_quantity") > 49).alias("review"))
    return evidence.authority_state(signals, "authority")


def q_doctor_report(spark, d):
    docs, labels, pages = table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "pages")
    checks = [
        ("FK-LABEL", "ERROR", labels.join(docs, "doc_id", "left_anti"), "doc_id"),
        ("LEN-001", "ERROR", docs.where(F.length("text") != F.col("n_chars")), "doc_id"),
        ("DUP-TEXT", "WARN", docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "doc_id"),
        ("PAGE-END", "WARN", pages.where(~F.col("html").endswith("</html>")), "page_id"),
        ("PAGE-URL", "ERROR", pages.where(~F.col("url").rlike("^https?://")), "page_id"),
    ]
    return evidence.doctor_report(checks)


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_QUEUE = "que AS (SELECT 'https://h/' || event_id AS url, CASE WHEN event_id % 10 = 0 THEN 'index' ELSE 'document' END AS item_type, user_id % 4 AS depth, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'running' WHEN 'view' THEN 'done' ELSE 'pending' END AS status, CASE WHEN event_type <> 'signup' THEN ts + INTERVAL 7 DAY END AS due, ts AS first_seen, ts AS started, event_id % 12 AS attempts FROM events)"
_GRAPH = "g AS (SELECT DISTINCT l_partkey AS a, -1 - l_suppkey AS b FROM lineitem)"
_NAMES = rf"""n0 AS (SELECT o_orderkey AS document, {_NAME_SPARK.replace("STRING", "VARCHAR")} AS name FROM orders), n AS (SELECT document, CASE WHEN regexp_matches(name, '^(ley|decreto|resolucion)_') THEN 'NORMATIVE_ACT' WHEN starts_with(name, 'oficio_dian_') THEN 'DIAN_OFICIO' WHEN starts_with(name, 'c-') THEN 'CORTE_CONSTITUCIONAL_SENTENCIA_C' WHEN starts_with(name, 'conpes_') THEN 'CONPES' ELSE 'UNKNOWN' END AS family,
CASE WHEN regexp_matches(name, '^(ley|decreto|resolucion)_') THEN upper(regexp_extract(name, '^([a-z]+)_', 1)) WHEN regexp_matches(name, '^oficio_dian_[0-9]') THEN 'OFICIO' WHEN starts_with(name, 'c-') THEN 'SENTENCIA_C' WHEN starts_with(name, 'conpes_') THEN 'CONPES' END AS doc_type,
CASE WHEN starts_with(name, 'index') THEN NULL ELSE nullif(regexp_replace(regexp_extract(name, '([0-9]+)_[0-9]+[.]htm$', 1), CASE WHEN regexp_matches(name, '^(ley|decreto|resolucion)_') THEN '^0+([0-9])' ELSE '^()$' END, '\1'), '') END AS number, CASE WHEN regexp_matches(name, '_[0-9]+[.]htm$') THEN regexp_extract(name, '_([0-9]+)[.]htm$', 1) END AS year FROM n0),
k AS (SELECT *, CASE WHEN number IS NOT NULL THEN 'CO:' || CASE doc_type WHEN 'OFICIO' THEN 'DIAN:' WHEN 'RESOLUCION' THEN 'DIAN:' WHEN 'CONPES' THEN 'DNP:' WHEN 'SENTENCIA_C' THEN 'CORTE:' ELSE '' END || doc_type || ':' || number || ':' || year END AS key FROM n)"""

_FRAMES = "WITH f AS (SELECT event_id, ts, CASE WHEN event_id % 13 > 0 THEN ts END AS frame_ts, CASE WHEN event_id % 13 > 0 THEN 1.0::DOUBLE - user_id % 10 / 10 END AS confidence, sha256(event_type || '|' || props || '|' || CAST(floor(event_id / 50) AS INT)) AS frame_sha FROM events)"

ORACLES = {
    "latest_order": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) = 1",
    "ambiguous_latest": "SELECT l_partkey, count(DISTINCT l_suppkey) AS identities FROM (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE) DESC) AS r FROM lineitem) WHERE r = 1 GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1",
    "foreign_keys": " UNION ALL ".join(
        f"SELECT '{n}' AS relation, count(*) AS missing, count(DISTINCT {b}) AS distinct_missing FROM {a} WHERE {b} IS NOT NULL AND {b} NOT IN (SELECT {e} FROM {c})"
        for n, a, b, c, e in [("lineitem.order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem.part", "lineitem", "l_partkey", "part", "p_partkey"), ("lineitem.supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders.customer", "orders", "o_custkey", "customer", "c_custkey"), ("customer.nation", "customer", "c_nationkey", "nation", "n_nationkey"), ("supplier.nation", "supplier", "s_nationkey", "nation", "n_nationkey"), ("nation.region", "nation", "n_regionkey", "region", "r_regionkey"), ("labels.document", "labels", "doc_id", "documents", "doc_id")]
    ),
    "orphan_customers": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "returned_orders": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1",
    "label_sync": "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL",
    "text_conflicts": "SELECT left(text, 12) AS opening, count(*) AS observations, count(DISTINCT text) AS variants FROM documents GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT text) > 1",
    "near_purchase": "SELECT event_type, count(*) AS n FROM (SELECT event_type, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS b FROM events) WHERE b GROUP BY 1",
    "as_of_value": "SELECT p.event_id, p.user_id, CAST(round((SELECT v.value FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts ORDER BY v.ts DESC, v.value DESC LIMIT 1) * 1e6) AS BIGINT) AS value_e6 FROM events p WHERE p.event_type = 'purchase'",
    "check_examples": "SELECT p_brand AS \"check\", count(*) AS failures, array_to_string(list_sort(list(p_partkey) FILTER (r <= 5)), ',') AS examples FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) GROUP BY 1",
    "resolve_parts": "WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS ref, p_brand || '/' || CAST(p_size + l_orderkey % 3 AS VARCHAR) AS key FROM lineitem JOIN part ON l_partkey = p_partkey), t AS (SELECT p_brand || '/' || p_size AS key, p_partkey AS target FROM part) SELECT ref, count(target) AS matches, CASE count(target) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN count(target) = 1 THEN min(target) END AS resolved_target FROM c LEFT JOIN t USING (key) GROUP BY ref",
    "mentions": f"WITH x AS (SELECT o_orderkey AS text_id, strip_accents(lower({_CITE_DUCK})) AS s FROM orders), m AS (SELECT text_id, unnest(l) AS raw, unnest(range(len(l))) AS mention_no FROM (SELECT text_id, regexp_extract_all(s, '(?:articulo [0-9]+ (?:de la|del) )?(?:ley|decreto|resolucion|circular) [0-9]{{1,6}} de [0-9]{{4}}') AS l FROM x)) SELECT text_id, mention_no, raw, CASE WHEN starts_with(raw, 'articulo') THEN 'article' ELSE 'document' END AS mention_type, nullif(regexp_extract(raw, '^articulo ([0-9]+) ', 1), '') AS article, upper(regexp_extract(raw, '(ley|decreto|resolucion|circular) ', 1)) AS doc_type, CAST(regexp_extract(raw, '([0-9]+) de [0-9]+$', 1) AS BIGINT) AS number, CAST(right(raw, 4) AS BIGINT) AS year FROM m",
    "relation_triggers": "SELECT o_orderkey AS text_id, CASE o_orderkey % 5 WHEN 0 THEN 'modifies' WHEN 1 THEN 'repeals' WHEN 2 THEN 'adds' WHEN 3 THEN NULL END AS relation FROM orders",
    "mention_states": "SELECT l_orderkey AS mention, CASE WHEN bool_or(l_discount > 0.095) THEN 'requires_review' WHEN bool_or(l_linenumber % 4 <> 3 AND l_quantity > 48) THEN 'ambiguous' WHEN bool_or(l_linenumber % 4 = 3) THEN 'unresolved' WHEN count(DISTINCT CASE WHEN l_tax < 0.07 THEN l_suppkey % 2 END) > 1 THEN 'ambiguous' WHEN count(CASE WHEN l_tax < 0.07 THEN 1 END) = 0 THEN 'inconsistent_target' ELSE 'resolved' END AS state FROM lineitem GROUP BY 1",
    "promotions": "SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'missing_resolution' WHEN o_orderstatus = 'F' THEN 'promoted' WHEN o_orderstatus = 'O' THEN 'skipped_unresolved' ELSE 'skipped_ambiguous' END AS outcome, count(*) AS n, CASE WHEN outcome = 'promoted' THEN count(*) * 8 END AS confidence_x10 FROM orders GROUP BY 1",
    "source_families": f"WITH {_NAMES} SELECT family, doc_type, count(*) AS n, count(number) AS with_number, count(DISTINCT key) AS keys FROM k GROUP BY 1, 2",
    "key_collisions": f"WITH {_NAMES} SELECT key, count(DISTINCT document) AS documents FROM k WHERE key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT document) > 1",
    "spanish_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS read FROM orders",
    "date_roles": "SELECT l_orderkey AS document, CASE WHEN l_linenumber % 2 = 0 THEN 'issued_date' ELSE 'publication_date' END AS role, count(*) AS candidates, count(*) FILTER (l_returnflag = 'R') AS trusted, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 1 THEN 'resolved' WHEN count(*) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 1 THEN max(CAST(l_shipdate AS DATE)) FILTER (l_returnflag = 'R') END AS value FROM lineitem GROUP BY 1, 2",
    "effect_at": "WITH e AS (SELECT l_orderkey AS document, l_returnflag = 'R' AS term, CAST(l_shipdate AS DATE) AS s, CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + 400 END AS e, l_tax > 0.078 AS amb FROM lineitem), g AS (SELECT document, bool_or(amb) AS amb, bool_or(term AND s <= DATE '1997-06-01') AS ended, count(DISTINCT s) FILTER (NOT term) AS ns, min(s) FILTER (NOT term) AS s, count(DISTINCT e) FILTER (NOT term) AS ne, min(e) FILTER (NOT term) AS e FROM e GROUP BY 1) SELECT document, CASE WHEN amb THEN 'ambiguous' WHEN ended THEN 'resolved' WHEN ns > 1 THEN 'ambiguous' WHEN ns = 1 AND DATE '1997-06-01' < s THEN 'resolved' WHEN ns = 1 AND ne = 1 THEN 'resolved' WHEN ne > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state, CASE WHEN amb THEN NULL WHEN ended THEN false WHEN ns > 1 THEN NULL WHEN ns = 1 AND DATE '1997-06-01' < s THEN false WHEN ns = 1 AND ne = 1 THEN DATE '1997-06-01' <= e END AS in_effect FROM g",
    "queue_head": f"WITH {_QUEUE} SELECT url, item_type, depth, status FROM que WHERE status IN ('pending', 'done', 'error') AND (due IS NULL OR due <= TIMESTAMP '2024-01-20') ORDER BY CASE WHEN item_type = 'index' THEN 0 ELSE 1 END, depth, due NULLS FIRST, first_seen, url LIMIT 100",
    "queue_advance": f"WITH {_QUEUE}, s AS (SELECT url, attempts, status = 'running' AND epoch(TIMESTAMP '{NOW}') - floor(epoch(started)) > 86400 AS stale, status, due FROM que), t AS (SELECT attempts, CASE WHEN stale THEN 'error' ELSE status END AS status, CASE WHEN stale THEN TIMESTAMP '{NOW}' ELSE due END AS due FROM s) SELECT CASE attempts % 3 WHEN 0 THEN status WHEN 1 THEN 'done' ELSE 'error' END AS status, CASE WHEN attempts % 3 = 0 THEN attempts ELSE attempts + 1 END AS attempts, count(*) AS n, CAST(sum(CASE attempts % 3 WHEN 0 THEN floor(epoch(due)) WHEN 1 THEN epoch(TIMESTAMP '{NOW}') + 604800 ELSE epoch(TIMESTAMP '{NOW}') + least(21600, 60 * pow(2, least(attempts, 8))) END) AS BIGINT) AS due_sum FROM t GROUP BY 1, 2",
    "queue_status": f"WITH {_QUEUE} SELECT item_type, status, count(*) AS n FROM que GROUP BY 1, 2",
    "insert_new": "SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0",
    "upsert": "WITH c AS (SELECT c_custkey, c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer), n AS (SELECT c_custkey + 500 AS k, 'NEW' AS m, CASE WHEN c_custkey % 4 = 0 THEN cents + 1 END AS v FROM c WHERE c_custkey % 2 = 0) SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NOT NULL THEN c_mktsegment ELSE m END AS c_mktsegment, coalesce(v, cents) AS cents FROM c FULL JOIN n ON c_custkey = k",
    "differing_payloads": "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 AND o_orderstatus <> 'X'",
    "round_robin": "SELECT conv_id, turn AS task, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM conversations",
    "budget_cut": "SELECT l_suppkey, least(count(*), 5) AS selected, greatest(count(*) - 5, 0) AS left_out FROM lineitem GROUP BY 1",
    "execution_coverage": "WITH s AS (SELECT l_orderkey AS aspect, l_linenumber % 3 AS task, l_linenumber AS round, CASE WHEN l_quantity < 3 THEN 'blocked' WHEN l_quantity < 6 THEN 'budget_exhausted' WHEN l_quantity > 46 THEN NULL WHEN l_tax > 0.04 THEN 'hits' ELSE 'no_hits' END AS outcome FROM lineitem), l AS (SELECT aspect, task, outcome FROM s QUALIFY row_number() OVER (PARTITION BY aspect, task ORDER BY round DESC, outcome DESC NULLS LAST) = 1) SELECT aspect, count(*) AS tasks, CASE WHEN count(outcome) = 0 THEN 'not_started' WHEN bool_or(outcome = 'blocked') THEN 'blocked' WHEN bool_or(outcome = 'budget_exhausted') THEN 'budget_exhausted' WHEN count(outcome) < count(*) THEN 'partial' ELSE 'complete' END AS execution FROM l GROUP BY aspect",
    "one_hop": f"WITH {_GRAPH}, k AS (SELECT p_partkey AS node FROM part WHERE p_size = 7), t AS (SELECT b AS node FROM g WHERE a IN (SELECT node FROM k) UNION SELECT a FROM g WHERE b IN (SELECT node FROM k)) SELECT node FROM t WHERE node NOT IN (SELECT node FROM k)",
    "edge_relevance": f"WITH {_GRAPH}, s AS (SELECT p_partkey AS node FROM part WHERE p_size < 10 UNION SELECT -1 - s_suppkey FROM supplier WHERE s_nationkey < 8), e AS (SELECT (a IN (SELECT node FROM s))::INT + (b IN (SELECT node FROM s))::INT AS k FROM g) SELECT CASE k WHEN 2 THEN 'selected_authorities' WHEN 1 THEN 'document_scope_conservative' ELSE 'irrelevant' END AS relevance, count(*) AS n FROM e GROUP BY 1",
    "answer_sessions": "WITH q AS (SELECT conv_id, text, CAST(sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS question FROM conversations) SELECT conv_id, question, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM q GROUP BY 1, 2",
    "rolling_window": f"{_FRAMES}, g AS (SELECT * FROM f WHERE confidence >= 0.3 QUALIFY row_number() OVER (PARTITION BY frame_sha ORDER BY frame_ts, event_id) = 1) SELECT event_id, frame_sha FROM g WHERE frame_ts > (SELECT max(frame_ts) FROM g) - INTERVAL 6 HOUR",
    "rejected_frames": f"{_FRAMES} SELECT CASE WHEN frame_ts IS NULL THEN 'unreadable_time' ELSE 'low_confidence' END AS reason, count(*) AS n FROM f WHERE frame_ts IS NULL OR confidence < 0.3 GROUP BY 1",
    "frame_cycles": f"{_FRAMES} SELECT CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS cycle, count(*) AS frames, count(DISTINCT frame_sha) FILTER (confidence >= 0.3) AS contents, count(*) FILTER (confidence >= 0.3) - count(DISTINCT frame_sha) FILTER (confidence >= 0.3) AS repeats, count(*) - count(*) FILTER (confidence >= 0.3) AS rejected FROM f GROUP BY 1",
    "thresholds": r"WITH m AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount FROM lineitem) SELECT l_orderkey, l_linenumber, amount < 25000 AS passes, regexp_replace(regexp_replace(CAST(CAST(25000 - amount AS DECIMAL(18, 2)) AS VARCHAR), '([.][0-9]*?)0+$', '\1'), '[.]$', '') AS margin FROM m",
    "contained_spans": "WITH s AS (SELECT l_suppkey AS text_id, l_orderkey * 10 + l_linenumber AS span_id, l_partkey % 997 AS a, l_partkey % 997 + CAST(l_quantity AS INT) AS b FROM lineitem) SELECT i.text_id, count(*) AS contained, count(DISTINCT i.span_id) AS mentions FROM s i JOIN s o ON i.text_id = o.text_id AND i.a >= o.a AND i.b <= o.b AND i.span_id <> o.span_id WHERE i.b - i.a < 5 AND o.b - o.a > 45 GROUP BY 1",
    "anchor_context": f"WITH {SEG}, t AS (SELECT doc_id, seq, {_TYPE} AS k FROM seg), m AS (SELECT *, CASE WHEN k IS NOT DISTINCT FROM lag(k) OVER w THEN 0 ELSE 1 END AS b FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY seq)), r AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM m), n AS (SELECT r.doc_id, a.seq AS anchor, r.seq, r.seq > a.seq AS f, row_number() OVER (PARTITION BY r.doc_id, a.seq ORDER BY r.seq < a.seq, abs(r.seq - a.seq)) AS k, count(*) OVER (PARTITION BY r.doc_id, a.seq) > 4 AS omitted FROM r JOIN r a ON r.doc_id = a.doc_id AND r.run = a.run WHERE r.seq <> a.seq) SELECT doc_id, CAST(anchor AS INT) AS anchor, CAST(seq AS INT) AS seq, CASE WHEN f THEN 'forward' ELSE 'back' END AS side, omitted FROM n WHERE k <= 4",
    "document_lifecycle": "WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS m, count(*) FILTER (o_orderstatus = 'P') AS b, count(*) FILTER (o_totalprice > 300000) AS e, count(*) FILTER (o_totalprice > 450000) AS i, count(*) FILTER (o_totalprice > 350000) AS p FROM orders GROUP BY 1) SELECT CASE WHEN coalesce(m, 0) > 0 THEN 'retain_manifestation' WHEN coalesce(b, 0) > 0 THEN 'retain_active' WHEN c_nationkey % 3 <> 1 THEN 'retain_conflict' WHEN e > 0 AND (i > 0 OR p = 0) THEN 'retain_conflict' WHEN e > 0 THEN 'retain_provenance' ELSE 'stale' END AS lifecycle, count(*) AS n FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY 1",
    "authority_states": "WITH s AS (SELECT l_orderkey AS authority, CASE WHEN l_tax > 0.03 THEN CASE WHEN l_returnflag = 'R' THEN 'guidance' ELSE 'norm' END END AS f, CASE WHEN l_discount > 0.02 THEN l_linestatus END AS fam, CASE WHEN l_quantity > 10 THEN 'ISSUER' END AS iss, l_quantity > 49 AS rev FROM lineitem) SELECT authority, CASE WHEN count(DISTINCT f) = 1 THEN min(f) ELSE 'unknown' END AS function, CASE WHEN count(DISTINCT iss) > 1 OR count(DISTINCT fam) > 1 OR count(DISTINCT f) > 1 OR bool_or(rev) THEN 'ambiguous' WHEN count(f) = 0 THEN 'unknown' WHEN count(iss) = 0 OR count(fam) = 0 THEN 'partial' ELSE 'resolved' END AS state FROM s GROUP BY 1",
    "doctor_report": " UNION ALL ".join(f"SELECT '{c}' AS check_id, CASE WHEN count(*) > 0 THEN '{v}' ELSE 'OK' END AS severity, count(*) AS failures, CAST(min(CAST(k AS VARCHAR)) AS VARCHAR) AS first_failure FROM ({q})" for c, v, q in [("FK-LABEL", "ERROR", "SELECT doc_id AS k FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"), ("LEN-001", "ERROR", "SELECT doc_id AS k FROM documents WHERE length(text) <> n_chars"), ("DUP-TEXT", "WARN", "SELECT min(doc_id) AS k FROM documents GROUP BY text HAVING count(*) > 1"), ("PAGE-END", "WARN", "SELECT page_id AS k FROM pages WHERE NOT ends_with(html, '</html>')"), ("PAGE-URL", "ERROR", "SELECT page_id AS k FROM pages WHERE NOT regexp_matches(url, '^https?://')")]),
}
