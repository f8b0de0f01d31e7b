"""P-*, X-*, U-*, J-7 to J-9: batch algebra and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions.vec import rnd
from latticework.operators import batch as B
from latticework.operators import filters as P
from latticework.plans.proxies import LINE, RESPONSES, TOKENS, r, responses, tokens
from latticework.sources.tables import table


def orders(spark, d):
    """(pos, o_orderkey, o_custkey, o_totalprice, o_orderpriority) in key order."""
    return B.with_position(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), "o_orderkey")


ORDERS = "ob AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders)"


def small(spark, d):
    return B.with_position(table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


SMALL = "nb AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_nationkey, n_name, n_regionkey FROM nation)"


def _p02(spark, d):
    popped, rest = B.pop(orders(spark, d), ["o_totalprice"])
    return popped.join(rest.select("pos", "o_custkey"), "pos")


def _p09(spark, d):
    return P.some_rows(table(spark, d, "orders", "o_orderkey", "o_custkey"), 100, "o_orderkey", 42)


def _p17(spark, d):
    rows = responses(spark, d).select("g", "ord", "s", "len")
    return P.by_accuracy_and_length(rows, "g", "s", "len", 20.0, 30.0, 49, 2).select("g", "ord", "passes")


def _p18(spark, d):
    return P.varied_groups(responses(spark, d), "g", "s").select("g", "ord")


def _p19(spark, d):
    rows = P.varied_groups(responses(spark, d).select("g", "ord", "s"), "g", "s")
    return P.fill_up([rows.where("g % 3 = 0"), rows.where("g % 3 = 1"), rows.where("g % 3 = 2")], "g", 200, "g").select("g", "ord")


def _p21(spark, d):
    packed = tokens(spark, d).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("pos", F.floor("v").cast("int").alias("v"), "m"))).alias("x"))
    return packed.select("g", F.array_join(P.unmasked(F.col("x")["v"], F.col("x")["m"]), ",").alias("ids"))


def _p22(spark, d):
    files = table(spark, d, "relation", F.col("attributes.chunk_id").alias("file"))
    return P.of_sources(table(spark, d, "entity", "id", "source"), files)


def _j07(spark, d):
    p = table(spark, d, "orders", F.col("o_orderkey").alias("uid"), "o_orderpriority")
    g = responses(spark, d).select(F.col("g").alias("uid"), "ord")
    return B.align(p, g).select("uid", F.col("prompt.o_orderpriority").alias("priority"), F.col("generated.ord").alias("ord"))


def _j08(spark, d):
    o = orders(spark, d)
    return B.union_columns(o.select("pos", "o_orderkey", "o_custkey"), o.select("pos", "o_orderkey", "o_totalprice"))


def _j08b(spark, d):
    o = orders(spark, d)
    return B.conflicts(o.select("pos", "o_orderkey", "o_custkey"), o.select("pos", F.when(F.col("pos") % 10 == 0, -1).otherwise(F.col("o_orderkey")).alias("o_orderkey"), "o_custkey"))


def _j09(spark, d):
    rows = responses(spark, d).select("g", "ord", "s")
    target = responses(spark, d).select("g", (F.col("g") * 100 - F.col("ord")).alias("at"))
    return B.reorder_to(rows, target, "g", "ord", "at").select("g", "ord", "new_pos")


def _x03(spark, d):
    e = B.with_position(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id")
    return B.unfold_chunks(e, ["embedding"], 4).select("pos", "vec_id", rnd(F.get("embedding", 0).cast("double")).alias("first"), F.size("embedding").alias("n"))


def _x04(spark, d):
    folded = B.fold(orders(spark, d).select("pos", "o_orderkey"), 3)
    return B.unfold(folded.where("size(rows) = 3").withColumn("pos", F.col("pos")))


def _x10(spark, d):
    rows = B.split(orders(spark, d).select("pos", "o_orderkey"), 16)
    return B.collate(rows, "part").select("part", F.array_join("o_orderkey", ",").alias("keys"))


def _x11(spark, d):
    e = table(spark, d, "orders", "o_orderkey").select("o_orderkey", F.sequence(F.lit(1), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("a"))
    return e.select("o_orderkey", F.array_join(B.pad_array(F.col("a"), 6, F.lit(0)), ",").alias("r"), F.array_join(B.pad_array(F.col("a"), 6, F.lit(0), True), ",").alias("l"))


def _x12(spark, d):
    e = table(spark, d, "orders", "o_orderkey").select("o_orderkey", F.sequence(F.lit(1), (F.col("o_orderkey") % 9 + 1).cast("int")).alias("a"))
    return e.select("o_orderkey", *[F.array_join(B.truncate_array(F.col("a"), 5, h), ",").alias(h) for h in ("left", "right", "middle")])


def _x17(spark, d):
    o = orders(spark, d).select("pos", "o_orderkey")
    n = o.count()
    moved = o.withColumn("source", F.col("pos")).withColumn("pos", (F.col("pos") * 7919) % n)
    return B.restore(moved, "source")


def _x21(spark, d):
    rows = responses(spark, d).select("g", "ord", F.col("flag"))
    return B.sample_lists(rows, "g", "ord", "flag").select("g", F.array_join("texts", "").alias("texts"))


def _u04(spark, d):
    n = small(spark, d)
    return B.concat(n.select("pos", "n_nationkey"), n.select("pos", "n_nationkey", "n_name"))


def _u06(spark, d):
    rows = table(spark, d, "qa_task", "task_id", "query", "loaded_at")
    return B.first_of_duplicates(rows, ["task_id"], "loaded_at").select("task_id", F.length("query").cast("int").alias("n"))


def _u07(spark, d):
    rows = table(spark, d, "qa_task", "task_id", "query").withColumn("prompt", F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("content")))))
    return B.first_of_duplicates(rows, ["prompt"], "task_id").select("task_id")


QUERIES = {
    "proj01_select": lambda s, d: B.select_columns(orders(s, d), ["pos", "o_custkey"]),
    "proj02_pop": _p02,
    "proj03_rename": lambda s, d: B.rename(small(s, d), ["n_name"], ["name"]),
    "proj04_gather": lambda s, d: B.gather(small(s, d), [3, 3, 0, 24, 7]),
    "proj04_boolean_mask": lambda s, d: B.keep(orders(s, d), F.col("o_totalprice") > 100000).select("pos", "o_orderkey"),
    "proj05_slice": lambda s, d: B.slice_rows(orders(s, d), -500, -3, 7).select("pos", "o_orderkey"),
    "proj06_index_select": lambda s, d: B.gather(B.with_position(table(s, d, "embeddings", "vec_id", F.size("embedding").alias("n")), "vec_id"), [5, 1, 5]),
    "proj07_split_columns": lambda s, d: B.select_columns(orders(s, d), ["pos", "o_orderkey", "o_custkey"]).join(B.pop(orders(s, d), ["o_totalprice"])[0], "pos"),
    "proj08_prompt_length": lambda s, d: P.within_length(table(s, d, "documents", "doc_id", "text"), "text", 120).select("doc_id"),
    "proj09_some_rows": _p09,
    "proj10_labelled": lambda s, d: P.labelled(table(s, d, "documents", "doc_id", "lang"), "lang"),
    "proj11_between_dates": lambda s, d: P.between_dates(table(s, d, "orders", "o_orderkey", "o_orderdate"), "o_orderdate", "1995-01-01", "1996-01-01").select("o_orderkey"),
    "proj12_known": lambda s, d: P.known(table(s, d, "relation", "id", F.col("source_id")), table(s, d, "entity_root", F.col("id").alias("source_id")), "source_id"),
    "proj13_chart_chunks": lambda s, d: table(s, d, "relation", "id", F.col("attributes.chunk_id").alias("c")).where(P.from_charts(F.col("c"))),
    "proj14_resolved_endpoints": lambda s, d: P.known(P.known(table(s, d, "relation", "id", "source_id", "target_id"), table(s, d, "entity", F.col("id").alias("source_id")), "source_id"), table(s, d, "entity", F.col("id").alias("target_id")), "target_id").select("id"),
    "proj15_named": lambda s, d: P.named(table(s, d, "entity", "record_id", "name")).select("record_id"),
    "proj16_no_loops": lambda s, d: P.no_loops(table(s, d, "relation", "id", "source_id", "target_id")).select("id"),
    "proj17_accuracy_and_length": _p17,
    "proj18_varied_groups": _p18,
    "proj19_fill_up": _p19,
    "proj20_unprocessed": lambda s, d: P.unprocessed(table(s, d, "customer", "c_custkey"), table(s, d, "orders", F.col("o_custkey").alias("c_custkey")), "c_custkey"),
    "proj21_unmasked": _p21,
    "proj22_entities_of_sources": _p22,
    "j07_align": _j07,
    "j08_union_columns": _j08,
    "j08_conflicts": _j08b,
    "j09_reorder_to": _j09,
    "x01_repeat_interleaved": lambda s, d: B.repeat(small(s, d), 3).select("pos", "n_nationkey"),
    "x01_repeat_tiled": lambda s, d: B.repeat(small(s, d), 3, False).select("pos", "n_nationkey"),
    "x02_repeat_each": lambda s, d: B.repeat_each(small(s, d), "n_regionkey").select("pos", "n_nationkey", "rep"),
    "x03_unfold_chunks": _x03,
    "x04_fold_unfold": _x04,
    "x05_chunk": lambda s, d: B.chunk(small(s, d), 5).select("pos", "chunk"),
    "x06_split": lambda s, d: B.split(orders(s, d), 7).select("pos", "part"),
    "x07_pad_to_divisor": lambda s, d: B.pad_to_divisor(small(s, d), 16).select("pos", "n_nationkey", "is_pad"),
    "x08_padding": lambda s, d: B.padding(small(s, d), 4, False).select("pos", "n_nationkey"),
    "x09_mini_batches": lambda s, d: B.mini_batches(small(s, d), 4, 2).select("pos", "epoch", "batch"),
    "x10_collate": _x10,
    "x11_pad_arrays": _x11,
    "x12_truncate_arrays": _x12,
    "x17_restore": _x17,
    "x21_sample_lists": _x21,
    "x22_replicate": lambda s, d: B.repeat(table(s, d, "region", "r_regionkey", F.col("r_regionkey").alias("pos")), 20, False).groupBy("r_regionkey").agg(F.count(F.lit(1)).alias("n")),
    "o11_reorder": lambda s, d: B.reorder(small(s, d), list(range(24, -1, -1))).select("pos", "n_nationkey"),
    "u04_concat": _u04,
    "u05_union_by_name": lambda s, d: table(s, d, "entity_root", "id", "name").unionByName(table(s, d, "entity", "id", "level"), allowMissingColumns=True),
    "u06_first_of_duplicates": _u06,
    "u07_distinct_prompts": _u07,
    "s11_share_of_rows": lambda s, d: B.share_of(table(s, d, "orders", "o_orderkey", "o_custkey"), 0.75, 1.0, "o_orderkey").select("o_orderkey"),
}


def _o(x):
    return f"WITH {ORDERS} {x}"


def _n(x):
    return f"WITH {SMALL} {x}"


SQL = {
    "proj01_select": _o("SELECT pos, o_custkey FROM ob"),
    "proj02_pop": _o("SELECT pos, o_totalprice, o_custkey FROM ob"),
    "proj03_rename": _n("SELECT pos, n_nationkey, n_name AS name, n_regionkey FROM nb"),
    "proj04_gather": _n("SELECT CAST(i.p AS BIGINT) AS pos, n_nationkey, n_name, n_regionkey FROM nb JOIN (VALUES (3, 0), (3, 1), (0, 2), (24, 3), (7, 4)) i(pos, p) USING (pos)"),
    "proj04_boolean_mask": _o("SELECT pos, o_orderkey FROM ob WHERE o_totalprice > 100000"),
    "proj05_slice": _o("SELECT (pos - (n - 500)) // 7 AS pos, o_orderkey FROM ob, (SELECT count(*) AS n FROM ob) WHERE pos >= n - 500 AND pos < n - 3 AND (pos - (n - 500)) % 7 = 0"),
    "proj06_index_select": "WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings) SELECT CAST(i.p AS BIGINT) AS pos, vec_id, n FROM e JOIN (VALUES (5, 0), (1, 1), (5, 2)) i(pos, p) USING (pos)",
    "proj07_split_columns": _o("SELECT pos, o_orderkey, o_custkey, o_totalprice FROM ob"),
    "proj08_prompt_length": r"SELECT doc_id FROM documents WHERE text IS NOT NULL AND len(list_filter(regexp_split_to_array(text, '[\s\x0b]+'), lambda x: x <> '')) <= 120",
    "proj09_some_rows": "SELECT o_orderkey, o_custkey FROM orders ORDER BY (o_orderkey * 2654435761 + 42 * 40503) % 4294967296, o_orderkey LIMIT 100",
    "proj10_labelled": "SELECT doc_id, lang FROM documents WHERE length(lang) > 0",
    "proj11_between_dates": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'",
    "proj12_known": "SELECT source_id, id FROM relation WHERE source_id IN (SELECT id FROM entity_root)",
    "proj13_chart_chunks": "SELECT id, attributes.chunk_id AS c FROM relation WHERE contains(attributes.chunk_id, 'chart')",
    "proj14_resolved_endpoints": "SELECT id FROM relation WHERE source_id IN (SELECT id FROM entity) AND target_id IN (SELECT id FROM entity)",
    "proj15_named": r"SELECT record_id FROM entity WHERE regexp_replace(name, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') <> ''",
    "proj16_no_loops": "SELECT id FROM relation WHERE source_id <> target_id",
    "proj17_accuracy_and_length": f"""WITH {RESPONSES}, x AS (SELECT g, ord, s, len, avg(s) OVER (PARTITION BY g) BETWEEN 20 AND 30 AND max(len) OVER (PARTITION BY g) < 49 AS passes FROM sc)
        SELECT g, ord, passes FROM x ORDER BY passes DESC, g, ord LIMIT (SELECT count(*) // 2 FROM x)""",
    "proj18_varied_groups": f"WITH {RESPONSES}, x AS (SELECT g, ord, stddev_pop(s) OVER (PARTITION BY g) AS sd, count(*) OVER (PARTITION BY g) AS n FROM sc) SELECT g, ord FROM x WHERE sd > 0 OR n = 1",
    "proj19_fill_up": f"""WITH {RESPONSES}, x AS (SELECT g, ord, stddev_pop(s) OVER (PARTITION BY g) AS sd, count(*) OVER (PARTITION BY g) AS n FROM sc),
        k AS (SELECT DISTINCT g FROM x WHERE (sd > 0 OR n = 1) AND g % 3 = 0 ORDER BY g LIMIT 200) SELECT g, ord FROM x WHERE g IN (SELECT g FROM k)""",
    "proj20_unprocessed": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "proj21_unmasked": f"WITH {TOKENS} SELECT g, coalesce(string_agg(CAST(CAST(floor(v) AS INTEGER) AS VARCHAR), ',' ORDER BY pos) FILTER (m = 1), '') AS ids FROM tk GROUP BY g",
    "proj22_entities_of_sources": r"SELECT DISTINCT f.file, e.id FROM (SELECT DISTINCT attributes.chunk_id AS file FROM relation) f JOIN (SELECT id, unnest(source) AS file FROM entity) e USING (file)",
    "j07_align": f"WITH {RESPONSES} SELECT g AS uid, o_orderpriority AS priority, ord FROM sc JOIN orders ON o_orderkey = g",
    "j08_union_columns": _o("SELECT pos, o_orderkey, o_custkey, o_totalprice FROM ob"),
    "j08_conflicts": _o("SELECT 'o_orderkey' AS column, count(*) AS rows FROM ob WHERE pos % 10 = 0 UNION ALL SELECT 'o_custkey', 0"),
    "j09_reorder_to": f"WITH {RESPONSES}, n AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM sc) SELECT g, ord, g * 100 - (n + 1 - ord) AS new_pos FROM n",
    "x01_repeat_interleaved": _n("SELECT pos * 3 + k AS pos, n_nationkey FROM nb, (SELECT unnest([0, 1, 2]) AS k)"),
    "x01_repeat_tiled": _n("SELECT k * (SELECT count(*) FROM nb) + pos AS pos, n_nationkey FROM nb, (SELECT unnest([0, 1, 2]) AS k)"),
    "x02_repeat_each": _n("SELECT pos, n_nationkey, CAST(unnest(range(n_regionkey)) AS INTEGER) AS rep FROM nb"),
    "x03_unfold_chunks": f"""WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id, embedding FROM embeddings)
        SELECT pos * 4 + k AS pos, vec_id, {r("CAST(embedding[k * 16 + 1] AS DOUBLE)")} AS first, CAST(16 AS INTEGER) AS n FROM e, (SELECT unnest([0, 1, 2, 3]) AS k)""",
    "x04_fold_unfold": _o("SELECT pos, o_orderkey FROM ob WHERE pos // 3 < (SELECT count(*) // 3 FROM ob)"),
    "x05_chunk": _n("SELECT pos, CAST(pos // 5 AS INTEGER) AS chunk FROM nb"),
    "x06_split": _o("SELECT pos, CAST(pos // 7 AS INTEGER) AS part FROM ob"),
    "x07_pad_to_divisor": _n("SELECT pos, n_nationkey, FALSE AS is_pad FROM nb UNION ALL SELECT pos + 25, n_nationkey, TRUE FROM nb WHERE pos < 7"),
    "x08_padding": _n("SELECT pos, n_nationkey FROM nb UNION ALL SELECT 25 + k, n_nationkey FROM nb, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE pos = 24"),
    "x09_mini_batches": _n("SELECT pos, CAST(k AS INTEGER) AS epoch, CAST(pos // 4 AS INTEGER) AS batch FROM nb, (SELECT unnest([0, 1]) AS k)"),
    "x10_collate": _o("SELECT CAST(pos // 16 AS INTEGER) AS part, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY pos) AS keys FROM ob GROUP BY 1"),
    "x11_pad_arrays": """WITH e AS (SELECT o_orderkey, range(1, o_orderkey % 5 + 2) AS a FROM orders), z AS (SELECT *, list_transform(range(6 - len(a)), lambda i: CAST(0 AS BIGINT)) AS f FROM e)
        SELECT o_orderkey, array_to_string(list_concat(a, f), ',') AS r, array_to_string(list_concat(f, a), ',') AS l FROM z""",
    "x12_truncate_arrays": """WITH e AS (SELECT o_orderkey, range(1, o_orderkey % 9 + 2) AS a FROM orders)
        SELECT o_orderkey, array_to_string(CASE WHEN len(a) <= 5 THEN a ELSE a[len(a) - 4 :] END, ',') AS "left", array_to_string(a[1 : 5], ',') AS "right",
               array_to_string(CASE WHEN len(a) <= 5 THEN a ELSE list_concat(a[1 : 2], a[len(a) - 2 :]) END, ',') AS middle FROM e""",
    "x17_restore": _o("SELECT pos, o_orderkey FROM ob"),
    "x21_sample_lists": f"WITH {RESPONSES} SELECT g, string_agg(flag, '' ORDER BY ord) AS texts FROM sc GROUP BY g",
    "x22_replicate": "SELECT r_regionkey, CAST(20 AS BIGINT) AS n FROM region",
    "o11_reorder": _n("SELECT 24 - pos AS pos, n_nationkey FROM nb"),
    "u04_concat": _n("SELECT pos, n_nationkey, NULL AS n_name FROM nb UNION ALL SELECT pos + 25, n_nationkey, n_name FROM nb"),
    "u05_union_by_name": "SELECT id, name, CAST(NULL AS INTEGER) AS level FROM entity_root UNION ALL SELECT id, NULL, level FROM entity",
    "u06_first_of_duplicates": "SELECT task_id, CAST(length(any_value(query)) AS INTEGER) AS n FROM qa_task GROUP BY task_id",
    "u07_distinct_prompts": "SELECT min(task_id) AS task_id FROM qa_task GROUP BY query",
    "s11_share_of_rows": _o("SELECT o_orderkey FROM ob WHERE pos >= (SELECT round(0.75 * count(*)) FROM ob)"),
}
