"""O-*, J-10 to J-16, G-10 to G-13, G-24, G-25, A-6 to A-9: retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.vec import rnd
from latticework.operators import graph as G
from latticework.operators import retrieval as R
from latticework.plans.proxies import r
from latticework.sources.tables import table


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries are the vectors whose id is divisible by 100; items are all vectors."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _o01(spark, d):
    q, x = _vectors(spark, d)
    return R.top_k(q, x, 5)


def _o02(spark, d):
    q, x = _vectors(spark, d)
    return R.union_top_k([R.top_k(q, x.where(F.col("label") % 3 == i), 5) for i in range(3)], 5)


def _o14(spark, d):
    q, x = _vectors(spark, d)
    return R.top_k(q, x, 5, "dot")


def _o04(spark, d):
    q, x = _vectors(spark, d)
    wide = R.top_k(q, x, 20).select("qid", "id")
    mean = x.groupBy("label").agg(F.max("id").alias("anchor"))
    near = R.top_k(q, x.join(mean, x.id == mean.anchor, "left_semi"), 3)
    return near.join(wide, ["qid", "id"], "left_anti").select("qid", "id", "rank")


def _j10(spark, d):
    q, x = _vectors(spark, d)
    return R.candidate_links(R.top_k(q, x, 5), 0.8)


def _names(spark, d):
    return table(spark, d, "entity", F.col("record_id").alias("id"), F.regexp_extract_all(F.lower("name"), F.lit(R.WORDS), 0).alias("tokens"))


def _j11(spark, d):
    return R.token_links(_names(spark, d), 0.8)


def _j11b(spark, d):
    return token_set_classes(_names(spark, d), 0.8)


def token_set_classes(names, least):
    """(node, component): every record of ``names`` (id, tokens) that has tokens, with the smallest id of its class; equal
    sets are in one class, and sets linked by a similarity of at least ``least``."""
    labels = G.components(R.token_links(names, least)).select(F.col("node").alias("rep"), "component")
    rows = R.token_classes(names).join(labels, "rep", "left")
    return rows.select(F.col("id").alias("node"), F.coalesce("component", "rep").alias("component"))


def _gold(spark, d):
    q, x = _vectors(spark, d)
    labels = x.select("id", "label")
    return q.select("qid").join(labels.select(F.col("id").alias("qid"), F.col("label").alias("l")), "qid").join(labels, F.col("l") == F.col("label")).where("qid <> id").select("qid", "id")


def _ranked(spark, d):
    q, x = _vectors(spark, d)
    found = R.top_k(q, x, 6).where("qid <> id")
    return R.ranks(found.withColumn("rank", F.col("rank") - 1), _gold(spark, d))


def _round(df, *plain):
    return df.select(*[F.col(c) if c in plain else rnd(F.col(c)).alias(c) for c in df.columns])


def _g24(spark, d):
    return _round(R.query_metrics(_ranked(spark, d)), "qid")


def _kind(spark, d):
    return F.concat(F.lit("kind"), (F.col("qid") / 100 % 3).cast("int"))


def _a09(spark, d):
    return _round(R.macro(R.query_metrics(_ranked(spark, d)), _kind(spark, d)), "kind", "queries", "overall")


def _g11(spark, d):
    e = table(spark, d, "entity", "record_id", F.concat("name", F.lit(" "), F.coalesce(F.col("attributes.description"), F.lit(""))).alias("t"))
    return e.select("record_id", F.array_join(R.hashed_embedding(F.col("t")).cast("array<int>"), ",").alias("v")).distinct()


def _entities(spark, d):
    e = table(spark, d, "entity", "record_id", F.col("attributes.embedding").alias("vector"), "source", "level").dropDuplicates(["record_id"])
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v))
    return e.where(~bad).withColumnRenamed("record_id", "id")


def _g12(spark, d):
    x = _entities(spark, d)
    q = x.where("id % 100 = 0").select(F.col("id").alias("qid"), "vector")
    x = x.withColumn("layer", R.layer_of(F.col("level"), 3))
    found = R.union_top_k([R.top_k(q, x.where(F.col("layer") == i), 10, digits=4) for i in range(4)], 10)
    return R.sources_of(found, x).select("qid", F.array_join("sources", ",").alias("sources"))


def _g13(spark, d):
    q, x = _vectors(spark, d)
    found = R.top_k(q, x, 3).groupBy("qid").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return q.select("qid").join(found, "qid", "left").select("qid", F.array_join(F.coalesce("ids", F.array().cast("array<bigint>")), ",").alias("ids"))


def _o15(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return R.bm25(docs, table(spark, d, "eval_item", F.col("item_id").alias("qid"), "text"))


QUERIES = {
    "o01_cosine_top_k": _o01,
    "o02_partial_final_top_k": _o02,
    "o03_relation_top_k": lambda s, d: R.top_k(_vectors(s, d)[0], _vectors(s, d)[1], 3),
    "o04_rerank": _o04,
    "o14_inner_product_top_k": _o14,
    "o15_bm25": _o15,
    "j10_similar_vectors": _j10,
    "j11_similar_token_sets": _j11,
    "j11_token_set_classes": _j11b,
    "j13_gold_hits": lambda s, d: _ranked(s, d).groupBy("qid").agg(F.sum("rel").alias("hits")),
    "j14_rerank_join": lambda s, d: _o01(s, d).join(table(s, d, "documents", F.col("doc_id").alias("id"), "n_chars"), "id").select("qid", "id", "n_chars"),
    "j15_load_documents": lambda s, d: _o15(s, d).join(table(s, d, "documents", "doc_id", "lang"), "doc_id").select("qid", "doc_id", "lang"),
    "j16_search_ids": lambda s, d: table(s, d, "relation", "id", "source_id").join(table(s, d, "entity_root", F.regexp_replace("id", "(.{8})(.{4})", "$1-$2-").alias("dashed")), F.col("source_id") == F.replace("dashed", F.lit("-"), F.lit(""))).select("id"),
    "g11_hashed_embedding": _g11,
    "g12_graph_search": _g12,
    "g13_batch_retrieval": _g13,
    "g24_retrieval_metrics": _g24,
    "g25_evaluation": lambda s, d: _round(R.macro(R.query_metrics(_ranked(s, d))), "queries"),
    "a06_micro_scores": lambda s, d: _round(R.micro(_ranked(s, d), 5), "tp", "fp", "fn"),
    "a07_macro_scores": lambda s, d: _round(R.macro(R.query_metrics(_ranked(s, d), (5,))), "queries"),
    "a08_scores_by_kind": lambda s, d: _a09(s, d).where("overall = 0").drop("overall"),
    "a09_grouping_sets": _a09,
}

_SIM = "floor(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE"


def _top(k: int, where: str = "TRUE", sim: str = _SIM) -> str:
    return f"""SELECT qid, id, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM
        (SELECT a.vec_id AS qid, b.vec_id AS id, {sim} AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND {where})) WHERE rank <= {k}"""


_RANKED = f"""top AS ({_top(6)}), fd AS (SELECT qid, id, rank - 1 AS rank FROM top WHERE qid <> id),
    gd AS (SELECT a.vec_id AS qid, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    gs AS (SELECT qid, count(*) AS gold FROM gd GROUP BY qid),
    rk AS (SELECT coalesce(fd.qid, gs.qid) AS qid, fd.id, rank, CASE WHEN gd.id IS NOT NULL THEN 1 ELSE 0 END AS rel, coalesce(gold, 0) AS gold
           FROM fd LEFT JOIN gd ON gd.qid = fd.qid AND gd.id = fd.id FULL JOIN gs ON gs.qid = fd.qid),
    rh AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS hit FROM rk)"""


def _dcg(k):
    return f"sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END)"


def _qm(ks=(1, 3, 5)) -> str:
    parts = []
    for k in ks:
        c = f"sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END)"
        parts.append(f"{c} / {k} AS p{k}, coalesce({c} / nullif(max(gold), 0), 0) AS r{k}, CASE WHEN {c} > 0 THEN {_dcg(k)} / list_sum(list_transform(range(1, CAST({c} AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg{k}")
    return f"""qm AS (SELECT qid, {', '.join(parts)}, coalesce(coalesce(sum(CASE WHEN rel = 1 THEN hit / rank END), 0) / nullif(max(gold), 0), 0) AS map,
        CASE WHEN max(gold) > 0 THEN coalesce(1 / min(CASE WHEN rel = 1 THEN rank END), 0) ELSE 0 END AS mrr FROM rh GROUP BY qid)"""


_NAMES = [f"{m}{k}" for k in (1, 3, 5) for m in ("p", "r", "ndcg")] + ["map", "mrr"]
_AVG = ", ".join(f"{r(f'avg({c})')} AS {c}" for c in _NAMES)
_BM = """tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY doc_id, term),
    dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id), st AS (SELECT count(*) AS n, avg(dl) AS av FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    qt AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM eval_item),
    sc AS (SELECT qid, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / av))) AS s
           FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY qid, tf.doc_id),
    bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT qid, doc_id, floor(s * 10000.0 + 0.5) / 10000.0 AS score FROM sc))"""
_TOKENSETS = """ts AS (SELECT min(id) AS id, x FROM (SELECT record_id AS id, list_sort(list_distinct(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+'))) AS x FROM entity) WHERE len(x) > 0 GROUP BY x),
    jl AS (SELECT a.id AS a, b.id AS b FROM ts a JOIN ts b ON a.id < b.id WHERE len(list_intersect(a.x, b.x)) >= 0.8 * (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x))) - 1e-9)"""
_ENT = "en AS (SELECT record_id AS id, any_value(attributes.embedding) AS embedding, any_value(source) AS source, any_value(level) AS level FROM entity WHERE len(attributes.embedding) = 64 AND len(list_filter(attributes.embedding, lambda v: v IS NULL OR isnan(v))) = 0 GROUP BY record_id)"

SQL = {
    "o01_cosine_top_k": _top(5),
    "o02_partial_final_top_k": _top(5),
    "o03_relation_top_k": _top(3),
    "o04_rerank": f"""WITH w AS ({_top(20)}), n AS ({_top(3, "b.vec_id IN (SELECT max(vec_id) FROM embeddings GROUP BY label)")}) SELECT qid, id, rank FROM n ANTI JOIN w USING (qid, id)""",
    "o14_inner_product_top_k": _top(5, sim="floor(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE"),
    "o15_bm25": f"WITH {_BM} SELECT qid, doc_id, score, rank FROM bm WHERE rank <= 5",
    "j10_similar_vectors": f"WITH t AS ({_top(5)}) SELECT DISTINCT least(qid, id) AS a, greatest(qid, id) AS b FROM t WHERE sim >= 0.8 AND qid <> id",
    "j11_similar_token_sets": f"WITH {_TOKENSETS} SELECT a, b FROM jl",
    "j11_token_set_classes": f"""WITH RECURSIVE {_TOKENSETS}, ed AS (SELECT a AS x, b AS y FROM jl UNION SELECT b, a FROM jl), w AS (SELECT DISTINCT x AS s, x AS node FROM ed UNION SELECT w.s, ed.y FROM w JOIN ed ON ed.x = w.node)
        , lb AS (SELECT node, min(s) AS component FROM w GROUP BY node), al AS (SELECT DISTINCT record_id, list_sort(list_distinct(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+'))) AS x FROM entity)
        SELECT record_id AS node, coalesce(component, ts.id) AS component FROM al JOIN ts USING (x) LEFT JOIN lb ON lb.node = ts.id""",
    "j13_gold_hits": f"WITH {_RANKED} SELECT qid, CAST(sum(rel) AS BIGINT) AS hits FROM rk GROUP BY qid",
    "j14_rerank_join": f"WITH t AS ({_top(5)}) SELECT qid, id, n_chars FROM t JOIN documents ON doc_id = id",
    "j15_load_documents": f"WITH {_BM} SELECT qid, doc_id, lang FROM bm JOIN documents USING (doc_id) WHERE rank <= 5",
    "j16_search_ids": "SELECT id FROM relation WHERE source_id IN (SELECT id FROM entity_root)",
    "g11_hashed_embedding": r"""WITH x AS (SELECT DISTINCT record_id, name, coalesce(attributes.description, '') AS e FROM entity),
        t AS (SELECT record_id, list_transform(list_filter(regexp_split_to_array(lower(coalesce(name || ' ' || e, '')), '[\s\x0b]+'), lambda w: w <> ''), lambda w: CAST(('0x' || substr(md5(w), 1, 8))::UBIGINT % 16 AS INTEGER)) AS p FROM x)
        SELECT record_id, array_to_string(list_transform(range(16), lambda i: len(list_filter(p, lambda q: q = i))), ',') AS v FROM t""",
    "g12_graph_search": f"""WITH {_ENT}, s AS (SELECT a.id AS qid, b.id, b.source, floor(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0) * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS sim
            FROM en a, en b WHERE a.id % 100 = 0),
        t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN isnan(sim) THEN 0 ELSE sim END DESC, id) AS k FROM s) WHERE k <= 10),
        u AS (SELECT DISTINCT qid, unnest(source) AS src FROM t) SELECT qid, string_agg(src, ',' ORDER BY src) AS sources FROM u WHERE src IS NOT NULL GROUP BY qid""",
    "g13_batch_retrieval": f"WITH t AS ({_top(3)}) SELECT qid, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM t GROUP BY qid",
    "g24_retrieval_metrics": f"WITH {_RANKED}, {_qm()} SELECT qid, {', '.join(f'{r(c)} AS {c}' for c in _NAMES)} FROM qm",
    "g25_evaluation": f"WITH {_RANKED}, {_qm()} SELECT {_AVG}, count(*) AS queries FROM qm",
    "a06_micro_scores": f"""WITH {_RANKED}, p AS (SELECT qid, max(gold) AS gold, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS tp, count(CASE WHEN rank <= 5 THEN id END) AS n FROM rk GROUP BY qid),
        s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n) - sum(tp) AS BIGINT) AS fp, CAST(sum(gold) - sum(tp) AS BIGINT) AS fn FROM p), x AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM s)
        SELECT tp, fp, fn, {r('p')} AS precision, {r('r')} AS recall, {r('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} AS f1 FROM x""",
    "a07_macro_scores": f"WITH {_RANKED}, {_qm((5,))} SELECT {', '.join(f'{r(f"avg({c})")} AS {c}' for c in ('p5', 'r5', 'ndcg5', 'map', 'mrr'))}, count(*) AS queries FROM qm",
    "a08_scores_by_kind": f"WITH {_RANKED}, {_qm()} SELECT 'kind' || CAST(qid // 100 % 3 AS INTEGER) AS kind, {_AVG}, count(*) AS queries FROM qm GROUP BY 1",
    "a09_grouping_sets": f"WITH {_RANKED}, {_qm()}, k AS (SELECT *, 'kind' || CAST(qid // 100 % 3 AS INTEGER) AS kind FROM qm) SELECT kind, {_AVG}, count(*) AS queries, CAST(grouping(kind) AS INTEGER) AS overall FROM k GROUP BY GROUPING SETS ((kind), ())",
}
