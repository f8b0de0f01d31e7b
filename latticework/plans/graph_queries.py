"""A-1 to A-5, J-1 to J-6, J-12, U-*, G-*, M-1 to M-9, O-5 to O-8: the graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from latticework.functions.vec import cosine, doubles, mean_vector, rnd
from latticework.operators import graph as G
from latticework.plans.proxies import r
from latticework.session import materialize
from latticework.sources.tables import table


def _rel(s, d):
    return G.flat_relations(table(s, d, "relation", "id", "source_id", "target_id", "type", "attributes", "layer", "created_at")).distinct()


def _nodes(s, d):
    return G.nodes(table(s, d, "entity", "id", "name", "level"), table(s, d, "entity_root", "id", "name", "level"))


def _edges(s, d):
    return G.out_edges(_rel(s, d), _nodes(s, d))


REL = "rl AS (SELECT DISTINCT id, source_id, target_id, type, attributes.description AS description, attributes.keywords AS keywords, attributes.chunk_id AS chunk_id, layer, created_at FROM relation)"
NODES = "nd AS (SELECT id, min(name) AS name, min(coalesce(level, -1)) AS level FROM (SELECT id, name, level FROM entity UNION ALL SELECT id, name, level FROM entity_root) GROUP BY id)"
EDGES = f"""{REL}, {NODES}, ed AS (SELECT source_id AS cur, target_id AS next, rl.id AS key, chunk_id AS source,
    CASE WHEN s.level = t.level THEN 'horizontal' WHEN t.level > s.level THEN 'vertical_down' ELSE 'vertical_up' END AS move, t.level - s.level AS rise
    FROM rl JOIN nd s ON s.id = source_id JOIN nd t ON t.id = target_id)"""
STRIP = r"regexp_replace(description, '^\s+|\s+$', '', 'g')"


def _named(s, d):
    """Entities with a plain name key, so that names repeat."""
    e = table(s, d, "entity", "record_id", "id", "name", "source").distinct()
    return e.select(F.col("record_id").alias("ord"), "id", F.lower(F.trim("name")).alias("name"), "source")


_NAMED = "en AS (SELECT DISTINCT record_id AS ord, id, lower(trim(name, ' ')) AS name, source FROM entity)"


def _j01(s, d):
    names = _named(s, d).select(F.col("id").alias("source_id"), "name")
    asked = _rel(s, d).join(names, "source_id").select("id", "name", "chunk_id")
    return G.resolve_by_name(asked, _named(s, d))


def _j03(s, d):
    up = _nodes(s, d).where("level = 0").agg(F.min("id").alias("new"))
    id_map = _nodes(s, d).where("level = 0").select(F.col("id").alias("old")).join(up, F.lit(True)).where("old <> new")
    return G.remap(_rel(s, d).select("id", "source_id", "target_id"), id_map)


def _j06(s, d):
    src = F.when(F.col("gt_sources").startswith("["), F.from_json("gt_sources", "array<string>")).otherwise(F.split("gt_sources", r"\s*,\s*"))
    return table(s, d, "qa_task", "task_id", "gt_sources").select("task_id", F.explode(src).alias("ref")).select("task_id", G.page_of(F.col("ref")).alias("page")).distinct()


def _chain(s, d):
    """Edges between neighbouring records of the same lower-case name."""
    n = table(s, d, "entity", "record_id", F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    return n.select(F.col("record_id").alias("a"), F.lead("record_id").over(Window.partitionBy("name").orderBy("record_id")).alias("b")).where("b is not null")


_CHAIN = "ch AS (SELECT DISTINCT record_id, lower(trim(name, ' ')) AS name FROM entity WHERE trim(name, ' ') <> '')"


def _u13(s, d):
    e = table(s, d, "entity", F.col("record_id").alias("id"), "level").groupBy("id").agg(F.min(F.coalesce("level", F.lit(-1))).alias("level"))
    return G.merge_components(e, G.components(_chain(s, d)))


def _json(s, d):
    docs = table(s, d, "documents", "doc_id", "text")
    body = F.regexp_extract("text", r'(?s)(\{"entities": \[.*?\]\})', 1)
    return G.extracted(docs.where(F.col("text").contains('{"entities"')), body, "doc_id")


def _g06(s, d):
    _, left = G.delete_entities(_rel(s, d), _nodes(s, d), table(s, d, "entity_root", "id"))
    return left.select("id")


def _g08(s, d):
    found = _json(s, d)
    new = G.upsert_by_name(found, "doc_id").select("name", "level")
    old = table(s, d, "entity", F.trim("name").alias("name"), F.coalesce("level", F.lit(-1)).alias("level")).where("name <> ''")
    return old.unionByName(new).groupBy("name").agg(F.min("level").alias("level"), F.count(F.lit(1)).alias("n"))


def _g15(s, d):
    return G.relation_chunk(_rel(s, d), _rel(s, d).where("source_id is not null and target_id is not null").select(F.col("target_id").alias("a"), F.col("source_id").alias("b")).distinct())


def _g17(s, d):
    w = G.weighted_edges(_edges(s, d), True)
    return G.page_rank(w, _nodes(s, d)).select("id", rnd(F.col("score"), 6).alias("score"))


def _vectors(s, d):
    """(id, vector) of the entities with a whole embedding."""
    v = table(s, d, "entity", "id", F.col("attributes.embedding").alias("vector")).where(F.size("vector") == 64)
    return v.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))


def _m07(s, d):
    scores = G.degrees(_edges(s, d), _nodes(s, d)).select("id", (F.col("degree") / 100).alias("score"))
    moves = {"horizontal": 1.0, "vertical_down": 1.3, "vertical_up": 0.7}
    w = G.weighted_edges(_edges(s, d), True, moves, ["chart_00001_01", "paragraph_00002_02"], _vectors(s, d), 0.5, scores, 2.0)
    return w.select("key", rnd(F.col("w")).alias("w"))


def _m08(s, d):
    anchor = _vectors(s, d).orderBy("id", "vector").limit(1).first()
    scores = materialize(_g17(s, d), "scores")
    w = G.sampling_edges(_edges(s, d), scores, 20.0, ["chart_00001_01"], _vectors(s, d), list(anchor.vector) if anchor else None, 0.5)
    return w.select("key", rnd(F.col("w")).alias("w"))


def _seeds(s, d):
    return G.seeds(_edges(s, d), _nodes(s, d), 400)


def _branches(s, d):
    return G.sample_branches(G.sampling_edges(_edges(s, d), _g17(s, d), 20.0), _seeds(s, d))


def _paths(s, d):
    return G.path_pool(G.accepted_branches(_branches(s, d), _vectors(s, d), 0.45), 2)


def _m01(s, d):
    """Cosine of the two ends of every relation between entities."""
    v = table(s, d, "entity", "id", F.col("attributes.embedding").alias("v")).where(F.size("v") == 64).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x))).dropDuplicates(["id"])
    a, b = v.select(F.col("id").alias("source_id"), doubles(F.col("v")).alias("x")), v.select(F.col("id").alias("target_id"), doubles(F.col("v")).alias("y"))
    sim = cosine(F.col("x"), F.col("y"), 1e-12)
    return _rel(s, d).join(a, "source_id").join(b, "target_id").select("id", rnd(sim).alias("sim"), rnd(G.similarity_multiplier(sim, 0.5)).alias("multiplier"))


def _m03(s, d):
    e = table(s, d, "embeddings", "label", "embedding", "vec_id")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("a"), F.max_by("embedding", "vec_id").alias("b"))
    mean = mean_vector(F.array(doubles(F.col("a")), doubles(F.col("b"))), 64)
    return first.select("label", rnd(F.get(mean, 0)).alias("x0"), rnd(F.get(mean, 63)).alias("x63"))


def _m09(s, d):
    rows = _edges(s, d).where("source is not null").groupBy("cur").agg(F.array_sort(F.collect_set("source")).alias("all"))
    path = F.transform("all", lambda x: F.struct(x.alias("source")))
    used = F.filter("all", lambda x, i: i % 2 == 0)
    return rows.select("cur", G.difficulty(F.array(path), used, F.size("all")).alias("difficulty"))


def _g21(s, d):
    rows = table(s, d, "entity", "record_id", F.array_distinct(F.filter("source", lambda x: x.isNotNull())).alias("all")).where("all is not null").distinct()
    return rows.select("record_id", F.array_join(G.packed_evidence(F.array_sort("all"), 4), ",").alias("evidence"))


def _g22(s, d):
    rows = table(s, d, "entity", "record_id", "type", F.array_sort(F.array_distinct(F.filter("source", lambda x: x.isNotNull()))).alias("pool")).where("pool is not null").distinct()
    said = F.array(*map(F.lit, ("FactCheck", "Manipulation", "Comparison", "Trend", "Analysis", "Causal", "trend")))
    kind = F.get(said, (F.col("record_id") % 8).cast("int"))  # the last of eight has none
    charts = F.filter("pool", lambda x: x.contains("chart"))
    shown = F.map_from_arrays(charts, F.transform(charts, lambda x, i: i + 1))
    cited = F.concat(F.array(F.lit("chart_of_none")), F.reverse("pool"))
    evidence = F.when(F.col("record_id") % 3 == 0, F.array(F.lit("outside"))).otherwise(F.concat(F.array(F.lit("outside")), F.reverse(F.slice("pool", 1, 2))))
    out = G.validated_answer(kind, evidence, F.col("pool"), cited, shown)
    numbered = F.transform(out["charts"], lambda x: F.concat_ws(":", x["chunk_id"], x["image_index"].cast("string")))
    return rows.select("record_id", out["kind"].alias("kind"), F.array_join(out["evidence"], ",").alias("evidence"), F.array_join(numbered, ",").alias("charts"))


QUERIES = {
    "a01_merged_paragraphs": lambda s, d: G.merged_paragraphs(table(s, d, "documents", "doc_id", "chunk_id", "text")).select("paragraph", F.md5("text").alias("digest")),
    "a02_page_index": lambda s, d: table(s, d, "documents", "chunk_id").groupBy(G.page_of(F.col("chunk_id")).alias("page")).agg(F.array_join(F.array_sort(F.collect_set("chunk_id")), ",").alias("ids")),
    "a04_source_frequency": lambda s, d: G.source_frequency(_edges(s, d)),
    "a05_out_degree": lambda s, d: G.degrees(_edges(s, d), _nodes(s, d)),
    "a32_repair_report": lambda s, d: G.repair_report(_rel(s, d)),
    "j01_resolve_by_name": _j01,
    "j02_relations_with_ends": lambda s, d: G.with_ends(_rel(s, d), _nodes(s, d)).select("id", "source_name", "source_level", "target_name", "target_level"),
    "j03_remap": _j03,
    "j04_incident": lambda s, d: G.incident(_rel(s, d), table(s, d, "entity_root", "id")),
    "j05_pages": lambda s, d: G.pages(table(s, d, "documents", "chunk_id"), table(s, d, "chart_entry", "ori_id", "qa_ids")).select("page", *[F.array_join(c, ",").alias(c) for c in ("charts", "texts", "qas")]),
    "j06_pages_of_tasks": _j06,
    "j12_within_layer": lambda s, d: G.within_layer(_rel(s, d), _nodes(s, d).where("level = 1")).select("id"),
    "u01_first_statements": lambda s, d: G.first_statements(_rel(s, d), ["created_at", "id"]).select("id"),
    "u02_structural_repair": lambda s, d: G.first_statements(_rel(s, d), ["created_at", "id"], True).select("id"),
    "u03_merged_sources": lambda s, d: G.merged_sources(_named(s, d), "name").select("name", F.array_join("source", ",").alias("source")),
    "u08_ordered_unique": lambda s, d: table(s, d, "entity", "record_id", F.array_join(F.array_distinct(F.filter("source", lambda x: x.isNotNull())), ",").alias("source")).distinct(),
    "u09_path_pool": lambda s, d: _paths(s, d).select("center", F.size("paths").alias("n"), "signature"),
    "u10_prefixes": lambda s, d: _branches(s, d).select("center", "branch", G.is_prefix(F.slice("path", 1, 1), F.col("path")).alias("starts")),
    "u11_set_operations": lambda s, d: table(s, d, "entity", "record_id", F.col("source").alias("a"), F.col("attributes.source").alias("b")).where("a is not null and b is not null").distinct().select("record_id", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_except("a", "b")).alias("extra"), (F.size(F.array_except("b", "a")) == 0).alias("covered")),
    "u12_components": lambda s, d: G.components(_chain(s, d)),
    "u13_merge_components": _u13,
    "g01_extracted_entities": lambda s, d: _json(s, d).select("doc_id", "ord", "name", "type", "level"),
    "g02_upsert_by_name": lambda s, d: G.upsert_by_name(_json(s, d), "doc_id").select("name", "level", "type", "mentions"),
    "g03_idempotent_add": lambda s, d: table(s, d, "entity", "id").distinct(),
    "g04_edge_labels": lambda s, d: G.within_layer(_rel(s, d), _nodes(s, d)).select("id", G.edge_label(F.col("keywords"), F.col("type")).alias("label")),
    "g05_remove_relations": lambda s, d: _rel(s, d).join(_rel(s, d).where("layer = 1").select("id"), "id", "left_anti").select("id"),
    "g06_delete_cascade": _g06,
    "g07_routed": lambda s, d: G.routed(_rel(s, d), _nodes(s, d)).select("id", "route"),
    "g08_merge_graphs": _g08,
    "g09_merge_entities": lambda s, d: G.remap(_rel(s, d).select("id", "source_id", "target_id"), _u13s(s, d)).where("source_id <> target_id").select("id", "source_id", "target_id"),
    "g10_resolution": lambda s, d: G.components(_resolved(s, d)),
    "g14_breadth_first": lambda s, d: G.breadth_first(_edges(s, d), table(s, d, "entity_root", "id"), 2),
    "g15_relation_chunk": _g15,
    "g16_out_edges": lambda s, d: _edges(s, d).select("cur", "next", "key", "move"),
    "g17_page_rank": _g17,
    "g17_random_walks": lambda s, d: G.random_walks(G.weighted_edges(_edges(s, d), vectors=_vectors(s, d), gamma=0.5), _seeds(s, d), 12),
    "g18_branches": lambda s, d: _branches(s, d).select("center", "branch", F.size("path").alias("hops")),
    "g19_sampled_paths": lambda s, d: _paths(s, d).select("center", F.size("sources").alias("sources")),
    "g20_pool_assignments": lambda s, d: G.pooled_assignments(_paths(s, d).select("center"), 3),
    "g21_packed_evidence": _g21,
    "g22_validated_answers": _g22,
    "m01_end_similarity": _m01,
    "m03_branch_vectors": _m03,
    "m04_source_rarity": lambda s, d: G.source_frequency(_edges(s, d)).select("source", rnd(G.rarity(F.col("n"))).alias("rarity")),
    "m05_level_weight": lambda s, d: _edges(s, d).select("key", rnd(G.level_weight(F.col("move"), F.col("rise"))).alias("w")),
    "m06_novelty": lambda s, d: _edges(s, d).select("key", rnd(G.novelty(F.col("source"), F.array(F.lit("chart_00001_01"), F.lit("paragraph_00002_02")))).alias("w")),
    "m07_edge_weights": _m07,
    "m08_sampling_weights": _m08,
    "m09_difficulty": _m09,
    "o05_seed_nodes": lambda s, d: G.seeds(_edges(s, d), _nodes(s, d), 400),
    "o06_start_nodes": lambda s, d: _g17(s, d).orderBy(F.col("score").desc(), "id").limit(300).select("id"),
    "o07_ordered_nodes": lambda s, d: _nodes(s, d).join(G.degrees(_edges(s, d), _nodes(s, d)), "id").select("id", F.row_number().over(Window.partitionBy("level").orderBy(F.col("degree").desc(), "id")).alias("place")),
    "o08_weighted_choice": lambda s, d: G.weighted_edges(_edges(s, d)).groupBy("cur").agg(F.max_by("next", G.chosen_edge(F.col("w"), "cur", "key")).alias("next")),
}


def _u13s(s, d):
    """The merge map over ids instead of record numbers."""
    ids = table(s, d, "entity", "record_id", "id").distinct()
    m = _u13(s, d)
    return m.join(ids.select(F.col("record_id").alias("old"), F.col("id").alias("o")), "old").join(ids.select(F.col("record_id").alias("new"), F.col("id").alias("n")), "new").select(F.col("o").alias("old"), F.col("n").alias("new"))


def _resolved(s, d):
    names = table(s, d, "entity", F.col("record_id").alias("id"), F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    return resolved(names)


def resolved(names, least=0.6, most_turns=8):
    """(a, b): links between records of ``names`` (id, name), whose components are the entities: equal names, and
    candidate pairs of similar names confirmed by the name rule that stands for the model's verdict.

    Every spelling is judged, also those of one token set; the smallest id stands for its spelling and each other record
    is linked to it. Candidates are found in blocks (``candidate_blocks``). A block's members are judged against one of
    them first, then by turns against others while many pairs are open; pairs whose records are one entity by then need
    no link of their own, all others of a block are judged.
    """
    from latticework.operators import retrieval as R

    names = materialize(names, "names")
    spellings = names.groupBy("name").agg(F.min("id").alias("id"))
    copies = names.join(spellings.withColumnRenamed("id", "at"), "name").where("id <> at").select(F.col("at").alias("a"), F.col("id").alias("b"))
    sides = materialize(R.name_sides(spellings), "sides")
    blocks = materialize(R.candidate_blocks(sides, least), "blocks")
    first = blocks.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    known = G.components(R.judged(first.unionByName(R.long_pairs(sides, least)), sides, least))
    links = copies.unionByName(known.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
    held = blocks.select("block", "id", "n", "c").join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    for turn in range(most_turns):
        held, rows, pairs = R.undecided(held)
        if pairs <= 4 * rows:
            break
        found = materialize(R.judged(R.lead_pairs(held, turn, least), sides, least), "found")
        links = links.unionByName(found)
        label = held.select("id", "component").distinct()
        ends = found.join(label.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(label.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
        joined = G.components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("to"))
        held = held.join(joined, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")
    return links.unionByName(R.judged(R.cross_pairs(held, least), sides, least))


def _level(move, rise):
    return f"CASE {move} WHEN 'vertical_down' THEN 1 + 0.35 * {rise} WHEN 'vertical_up' THEN 0.85 ELSE 1.0 END"


_FREQ = "fq AS (SELECT source, count(*) AS n FROM ed WHERE source IS NOT NULL GROUP BY source)"
_RAR = "coalesce(1 / sqrt(greatest(n, 1)), 1.0)"


def _rank_sql() -> str:
    steps = [f"s0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS score FROM nd)"]
    for i in range(10):
        steps.append(f"f{i} AS MATERIALIZED (SELECT next AS id, sum(p * score) AS f FROM pr JOIN s{i} ON cur = id GROUP BY next)")
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT nd.id, 0.82::DOUBLE * (coalesce(f, 0) + (1 - (SELECT coalesce(sum(f), 0) FROM f{i})) / (SELECT count(*) FROM nd)) + 0.18::DOUBLE / (SELECT count(*) FROM nd) AS score FROM nd LEFT JOIN f{i} USING (id))")
    return f"""WITH {EDGES}, {_FREQ}, we AS (SELECT cur, next, greatest({_level('move', 'rise')} * {_RAR}, 1e-12)::DOUBLE AS w FROM ed LEFT JOIN fq USING (source)),
        pr AS MATERIALIZED (SELECT cur, next, sum(w) / any_value(t) AS p FROM we JOIN (SELECT cur, sum(w) AS t FROM we GROUP BY cur) USING (cur) GROUP BY cur, next), {', '.join(steps)}"""


_SIG = f"least(source_id, target_id) AS x, greatest(source_id, target_id) AS y, {STRIP} AS z, chunk_id AS c"
_EXT = r"""ex AS (SELECT doc_id, json_transform(regexp_extract(text, '(?s)(\{"entities": \[.*?\]\})', 1), '{"entities": [{"entity_name": "VARCHAR", "entity_type": "VARCHAR", "level": "INTEGER"}]}').entities AS e
    FROM documents WHERE contains(text, '{"entities"') AND json_valid(regexp_extract(text, '(?s)(\{"entities": \[.*?\]\})', 1)) AND regexp_extract(text, '(?s)(\{"entities": \[.*?\]\})', 1) <> ''),
    fo AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, trim(e[i].entity_name) AS name, coalesce(e[i].entity_type, 'related') AS type, coalesce(e[i].level, 1) - 1 AS level
    FROM (SELECT doc_id, e, unnest(range(1, len(e) + 1)) AS i FROM ex) WHERE trim(e[i].entity_name) <> '')"""
_DEG = "dg AS (SELECT nd.id, count(ed.cur) AS degree FROM nd LEFT JOIN ed ON ed.cur = nd.id GROUP BY nd.id)"


_VEC = "v AS (SELECT id, CAST(any_value(attributes.embedding) AS DOUBLE[]) AS v FROM entity WHERE len(attributes.embedding) = 64 AND len(list_filter(attributes.embedding, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY id)"
_NEAR = "(1 + 0.5 * greatest(coalesce(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)) + 1e-12), 0), 0))"
_NEW = "(CASE WHEN source IS NOT NULL AND source NOT IN ({}) THEN 1.5 ELSE 1.0 END)"


def _e(body: str) -> str:
    return f"WITH {EDGES} {body}"


def _q(body: str) -> str:
    return f"WITH {REL} {body}"


_U13 = f"""{_CHAIN}, cc AS (SELECT record_id, min(record_id) OVER (PARTITION BY name) AS c, count(*) OVER (PARTITION BY name) AS k FROM ch),
    lv AS (SELECT record_id, min(coalesce(level, -1)) AS level FROM entity GROUP BY record_id),
    bs AS (SELECT *, first_value(record_id) OVER (PARTITION BY c ORDER BY level, record_id) AS new FROM cc JOIN lv USING (record_id) WHERE k > 1),
    mp AS (SELECT record_id AS old, new FROM bs WHERE record_id <> new)"""

SQL = {
    "a01_merged_paragraphs": "SELECT chunk_id AS paragraph, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY doc_id), '')) AS digest FROM documents WHERE starts_with(chunk_id, 'paragraph_') GROUP BY chunk_id",
    "a02_page_index": "SELECT split_part(chunk_id, '_', 2) AS page, string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) AS ids FROM documents GROUP BY 1",
    "a04_source_frequency": _e(f", {_FREQ} SELECT source, n FROM fq"),
    "a05_out_degree": _e(f", {_DEG} SELECT id, degree FROM dg"),
    "a32_repair_report": _q(f""", s AS (SELECT {_SIG}, layer FROM rl), a AS (SELECT count(*) AS n FROM s GROUP BY x, y, z, c HAVING count(*) > 1), b AS (SELECT count(*) AS n FROM s GROUP BY x, y, z, c, layer HAVING count(*) > 1)
        SELECT 'semantic' AS kind, count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS removed FROM a UNION ALL SELECT 'structural', count(*), CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM b"""),
    "j01_resolve_by_name": _q(f""", {_NAMED}, k AS (SELECT rl.id, n.name, chunk_id FROM rl JOIN en n ON n.id = source_id), c AS (SELECT name, count(*) AS n, min_by(id, ord) AS lone FROM en GROUP BY name),
        h AS (SELECT name, ch, min_by(id, ord) AS held FROM (SELECT name, ord, id, unnest(source) AS ch FROM en) GROUP BY name, ch)
        SELECT k.id, CASE WHEN c.n = 1 THEN lone ELSE held END AS entity_id FROM k LEFT JOIN c ON c.name = k.name LEFT JOIN h ON h.name = k.name AND h.ch = k.chunk_id"""),
    "j02_relations_with_ends": f"WITH {REL}, {NODES} SELECT rl.id, s.name AS source_name, s.level AS source_level, t.name AS target_name, t.level AS target_level FROM rl JOIN nd s ON s.id = source_id JOIN nd t ON t.id = target_id",
    "j03_remap": f"WITH {REL}, {NODES}, m AS (SELECT id AS old, (SELECT min(id) FROM nd WHERE level = 0) AS new FROM nd WHERE level = 0) SELECT rl.id, coalesce(a.new, source_id) AS source_id, coalesce(b.new, target_id) AS target_id FROM rl LEFT JOIN m a ON a.old = source_id LEFT JOIN m b ON b.old = target_id",
    "j04_incident": _q("SELECT DISTINCT n.id AS node, rl.id FROM rl JOIN entity_root n ON n.id = source_id OR n.id = target_id"),
    "j05_pages": """WITH p AS (SELECT DISTINCT split_part(chunk_id, '_', 2) AS page, chunk_id FROM documents), c AS (SELECT page, string_agg(chunk_id, ',' ORDER BY chunk_id) AS charts FROM p WHERE contains(chunk_id, 'chart') GROUP BY page),
        t AS (SELECT page, string_agg(chunk_id, ',' ORDER BY chunk_id) AS texts FROM p WHERE NOT contains(chunk_id, 'chart') GROUP BY page),
        q AS (SELECT page, string_agg(q, ',' ORDER BY q) AS qas FROM (SELECT DISTINCT ori_id AS page, unnest(qa_ids) AS q FROM chart_entry) WHERE q IS NOT NULL GROUP BY page)
        SELECT coalesce(c.page, t.page) AS page, charts, texts, qas FROM c FULL JOIN t ON c.page = t.page LEFT JOIN q ON q.page = coalesce(c.page, t.page)""",
    "j06_pages_of_tasks": r"""WITH x AS (SELECT task_id, unnest(CASE WHEN starts_with(gt_sources, '[') THEN CAST(json_extract_string(gt_sources, '$[*]') AS VARCHAR[]) ELSE regexp_split_to_array(gt_sources, '\s*,\s*') END) AS ref FROM qa_task)
        SELECT DISTINCT task_id, nullif(split_part(ref, '_', 2), '') AS page FROM x""",
    "j12_within_layer": f"WITH {REL}, {NODES} SELECT rl.id FROM rl WHERE source_id IN (SELECT id FROM nd WHERE level = 1) AND target_id IN (SELECT id FROM nd WHERE level = 1)",
    "u01_first_statements": _q(f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id), {STRIP}, chunk_id ORDER BY created_at NULLS FIRST, id) AS k FROM rl) WHERE k = 1"),
    "u02_structural_repair": _q(f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id), {STRIP}, chunk_id, layer ORDER BY created_at NULLS FIRST, id) AS k FROM rl) WHERE k = 1"),
    "u03_merged_sources": f"WITH {_NAMED}, x AS (SELECT DISTINCT name, unnest(source) AS s FROM en) SELECT name, string_agg(s, ',' ORDER BY s) AS source FROM x WHERE s IS NOT NULL GROUP BY name",
    "u11_set_operations": """WITH x AS (SELECT DISTINCT record_id, source AS a, attributes.source AS b FROM entity WHERE source IS NOT NULL AND attributes.source IS NOT NULL),
        y AS (SELECT record_id, list_distinct(list_transform(a, lambda v: coalesce(v, '~'))) AS a, list_distinct(list_transform(b, lambda v: coalesce(v, '~'))) AS b FROM x)
        SELECT record_id, CAST(len(list_filter(a, lambda v: list_contains(b, v))) AS INTEGER) AS "both", CAST(len(list_filter(a, lambda v: NOT list_contains(b, v))) AS INTEGER) AS extra,
               len(list_filter(b, lambda v: NOT list_contains(a, v))) = 0 AS covered FROM y""",
    "u12_components": f"WITH {_CHAIN}, x AS (SELECT record_id, min(record_id) OVER (PARTITION BY name) AS component, count(*) OVER (PARTITION BY name) AS k FROM ch) SELECT record_id AS node, component FROM x WHERE k > 1",
    "u13_merge_components": f"WITH {_U13} SELECT old, new FROM mp",
    "g01_extracted_entities": f"WITH {_EXT} SELECT doc_id, ord, name, type, level FROM fo",
    "g02_upsert_by_name": f"WITH {_EXT} SELECT name, min(level) AS level, arg_min(type, doc_id * 1000 + ord) AS type, count(*) AS mentions FROM fo GROUP BY name",
    "g03_idempotent_add": "SELECT DISTINCT id FROM entity",
    "g04_edge_labels": f"WITH {REL}, {NODES} SELECT rl.id, coalesce(keywords[1], type) AS label FROM rl WHERE source_id IN (SELECT id FROM nd) AND target_id IN (SELECT id FROM nd)",
    "g05_remove_relations": _q("SELECT id FROM rl WHERE id NOT IN (SELECT id FROM rl WHERE layer = 1)"),
    "g06_delete_cascade": _q("SELECT id FROM rl WHERE coalesce(source_id, '') NOT IN (SELECT id FROM entity_root) AND coalesce(target_id, '') NOT IN (SELECT id FROM entity_root)"),
    "g07_routed": f"WITH {REL}, {NODES} SELECT rl.id, CASE WHEN s.level = t.level THEN 'horizontal' ELSE 'vertical' END AS route FROM rl JOIN nd s ON s.id = source_id JOIN nd t ON t.id = target_id",
    "g08_merge_graphs": f"WITH {_EXT}, n AS (SELECT name, min(level) AS level FROM fo GROUP BY name), u AS (SELECT trim(name, ' ') AS name, coalesce(level, -1) AS level FROM entity WHERE trim(name, ' ') <> '' UNION ALL SELECT name, level FROM n) SELECT name, min(level) AS level, count(*) AS n FROM u GROUP BY name",
    "g09_merge_entities": f"""WITH {REL}, {_U13}, im AS (SELECT o.id AS old, n.id AS new FROM mp JOIN (SELECT DISTINCT record_id, id FROM entity) o ON o.record_id = mp.old JOIN (SELECT DISTINCT record_id, id FROM entity) n ON n.record_id = mp.new),
        x AS (SELECT rl.id, coalesce(a.new, source_id) AS source_id, coalesce(b.new, target_id) AS target_id FROM rl LEFT JOIN im a ON a.old = source_id LEFT JOIN im b ON b.old = target_id) SELECT * FROM x WHERE source_id <> target_id""",
    "g14_breadth_first": _e("""SELECT start, id, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT id AS start, id, 0 AS hop FROM entity_root UNION ALL SELECT r.id, ed.next, 1 FROM entity_root r JOIN ed ON cur = r.id
        UNION ALL SELECT r.id, b.next, 2 FROM entity_root r JOIN ed a ON a.cur = r.id JOIN (SELECT DISTINCT cur, next FROM ed) b ON b.cur = a.next) GROUP BY start, id"""),
    "g15_relation_chunk": _q(""", p AS (SELECT DISTINCT target_id AS a, source_id AS b FROM rl WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
        f AS (SELECT source_id AS a, target_id AS b, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY created_at NULLS FIRST, id) AS k FROM rl WHERE chunk_id IS NOT NULL) WHERE k = 1)
        SELECT p.a, p.b, chunk_id FROM p LEFT JOIN f ON f.a = p.a AND f.b = p.b"""),
    "g16_out_edges": _e("SELECT cur, next, key, move FROM ed"),
    "g17_page_rank": _rank_sql() + f" SELECT id, {r('score', 6)} AS score FROM s10",
    "m04_source_rarity": _e(f", {_FREQ} SELECT source, {r(_RAR)} AS rarity FROM fq"),
    "m05_level_weight": _e(f"SELECT key, {r(_level('move', 'rise'))} AS w FROM ed"),
    "m06_novelty": _e(f"SELECT key, {r('''CASE WHEN source IS NOT NULL AND source NOT IN ('chart_00001_01', 'paragraph_00002_02') THEN 1.5 ELSE 1.0 END''')} AS w FROM ed"),
    "m07_edge_weights": _e(f", {_FREQ}, {_DEG}, {_VEC} SELECT key, {r(f'''(CASE move WHEN 'vertical_down' THEN 1.3 WHEN 'vertical_up' THEN 0.7 ELSE 1.0 END)::DOUBLE * ({_level('move', 'rise')})::DOUBLE * {_RAR} * {_NEW.format("'chart_00001_01', 'paragraph_00002_02'")}::DOUBLE * {_NEAR} * (1 + 2 * (degree / 100)::DOUBLE)''')} AS w FROM ed LEFT JOIN fq USING (source) JOIN dg ON dg.id = next LEFT JOIN v a ON a.id = cur LEFT JOIN v b ON b.id = next"),
    "m08_sampling_weights": _rank_sql() + f", {_VEC} SELECT key, {r(f'''(1 + 20 * {r('score', 6)}) * {_level('move', 'rise')} * {_NEW.format("'chart_00001_01'")} * {_NEAR}''')} AS w FROM ed JOIN s10 ON s10.id = next LEFT JOIN (SELECT v FROM v ORDER BY id LIMIT 1) a ON TRUE LEFT JOIN v b ON b.id = next",
    "m09_difficulty": _e(""", a AS (SELECT cur, list_sort(list_distinct(list(source))) AS s FROM ed WHERE source IS NOT NULL GROUP BY cur),
        b AS (SELECT cur, s, list_filter(s, lambda v, i: i % 2 = 1) AS u FROM a)
        SELECT cur, CAST(len(list_filter(u, lambda v: contains(v, 'chart'))) + list_position(s, u[len(u)]) + least(greatest(len(s), 1), 3) AS INTEGER) AS difficulty FROM b"""),
    "m01_end_similarity": _q(f""", v AS (SELECT id, any_value(attributes.embedding) AS v FROM entity WHERE len(attributes.embedding) = 64 AND len(list_filter(attributes.embedding, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY id),
        s AS (SELECT rl.id, list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) / (sqrt(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(a.v AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.v AS DOUBLE[]), CAST(b.v AS DOUBLE[]))) + 1e-12) AS sim
              FROM rl JOIN v a ON a.id = source_id JOIN v b ON b.id = target_id) SELECT id, {r('sim')} AS sim, {r('1 + 0.5 * greatest(sim, 0)')} AS multiplier FROM s"""),
    "m03_branch_vectors": f"""WITH e AS (SELECT label, min_by(embedding, vec_id) AS a, max_by(embedding, vec_id) AS b FROM embeddings GROUP BY label)
        SELECT label, {r('(CAST(a[1] AS DOUBLE) + CAST(b[1] AS DOUBLE)) / 2')} AS x0, {r('(CAST(a[64] AS DOUBLE) + CAST(b[64] AS DOUBLE)) / 2')} AS x63 FROM e""",
    "g21_packed_evidence": """WITH x AS (SELECT DISTINCT record_id, list_sort(list_distinct(source)) AS s FROM entity WHERE source IS NOT NULL)
        SELECT record_id, array_to_string(list_concat(list_filter(s, lambda v: contains(v, 'chart')), list_filter(s, lambda v: NOT contains(v, 'chart')))[1 : 4], ',') AS evidence FROM x""",
    "g22_validated_answers": """WITH x AS (SELECT DISTINCT record_id, type, list_sort(list_distinct(source)) AS s FROM entity WHERE source IS NOT NULL)
        SELECT record_id, CASE record_id % 8 WHEN 0 THEN 'FactCheck' WHEN 1 THEN 'Manipulation' WHEN 3 THEN 'Trend' WHEN 4 THEN 'Analysis' ELSE 'Comparison' END AS kind,
               CASE WHEN record_id % 3 = 0 THEN array_to_string(s, ',') WHEN len(s) > 1 THEN s[2] || ',' || s[1] ELSE array_to_string(s, ',') END AS evidence,
               array_to_string(list_reverse(list_transform(list_filter(s, lambda v: contains(v, 'chart')), lambda v, i: v || ':' || i)), ',') AS charts FROM x""",
    "o05_seed_nodes": _e(f", {_DEG} SELECT id, degree FROM dg ORDER BY degree DESC, id LIMIT 400"),
    "o06_start_nodes": _rank_sql() + f" SELECT id FROM (SELECT id, {r('score', 6)} AS score FROM s10) ORDER BY score DESC, id LIMIT 300",
    "o07_ordered_nodes": _e(f", {_DEG} SELECT id, CAST(row_number() OVER (PARTITION BY level ORDER BY degree DESC, id) AS INTEGER) AS place FROM dg JOIN nd USING (id)"),
}
