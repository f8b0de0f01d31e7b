"""Layered knowledge graph: building, upsert, resolution, repair, traversal and walks.

Entities are rows (id, name, type, level, source), relations rows (id, source_id, target_id, type, description,
keywords, chunk_id). Dictionaries become joins: every look-up is an equi join on ids or names whose other side is
pre-aggregated to one row per key, so a name or id that holds very many rows cannot multiply them. Iterations write
their state to the shared folder between rounds. Null ids never match; empty tables stay empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.vec import cosine, doubles, mean_vector
from latticework.session import materialize

C = F.col


def flat_relations(relation: DataFrame) -> DataFrame:
    """The nested relation table as flat columns."""
    a = C("attributes")
    return relation.select("id", "source_id", "target_id", "type", a["description"].alias("description"), a["keywords"].alias("keywords"), a["chunk_id"].alias("chunk_id"), "layer", "created_at")


def nodes(entity: DataFrame, root: DataFrame) -> DataFrame:
    """(id, name, level): entities and root nodes, one row per id; a missing level is -1."""
    rows = entity.select("id", "name", "level").unionByName(root.select("id", "name", "level"))
    return rows.groupBy("id").agg(F.min("name").alias("name"), F.min(F.coalesce("level", F.lit(-1))).alias("level"))


# --- building -------------------------------------------------------------------------------------------------------

EXTRACTION = (
    "entities array<struct<entity_name:string,entity_type:string,entity_description:string,level:int>>,"
    "relationships array<struct<source_entity:string,target_entity:string,relation_type:string,relationship_description:string,relationship_keywords:array<string>>>"
)


def extracted(docs: DataFrame, json: Column, chunk: str = "chunk_id") -> DataFrame:
    """(chunk, ord, name, type, description, level) of every named entity of an extraction.

    Levels count from 0 in the graph (one less than in the extraction, 1 where missing); a missing type is ``related``.
    Text that is no JSON gives no entities.
    """
    rows = docs.select(chunk, F.posexplode(F.from_json(json, EXTRACTION)["entities"]).alias("ord", "e"))
    name = F.regexp_replace(C("e")["entity_name"], r"^\s+|\s+$", "")
    return rows.select(chunk, "ord", name.alias("name"), F.coalesce(C("e")["entity_type"], F.lit("related")).alias("type"), C("e")["entity_description"].alias("description"), (F.coalesce(C("e")["level"], F.lit(1)) - 1).alias("level")).where(C("name") != "")


def upsert_by_name(found: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """One entity per name: id from the name's hash, smallest level, first type, union of sources (sorted)."""
    return found.groupBy("name").agg(
        F.min("level").alias("level"), F.min_by("type", F.struct(chunk, "ord")).alias("type"), F.array_sort(F.collect_set(chunk)).alias("source"), F.count(F.lit(1)).alias("mentions")
    ).withColumn("id", F.md5("name"))


def resolve_by_name(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, entity_id): the entity a relation's ``name`` means.

    ``relations`` has (id, name, chunk_id), ``entities`` (ord, id, name, source). One entity of the name: it; several:
    the first by ``ord`` whose source holds the chunk, else none; none: null.
    """
    single = entities.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "ord").alias("only"))
    held = entities.select("name", "ord", "id", F.explode("source").alias("chunk_id")).groupBy("name", "chunk_id").agg(F.min_by("id", "ord").alias("held"))
    out = relations.join(single, "name", "left").join(held, ["name", "chunk_id"], "left")
    return out.select(C("id"), F.when(C("n") == 1, C("only")).otherwise(C("held")).alias("entity_id"))


def with_ends(relations: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Relations with both ends' names and levels; a relation with an unknown end is dropped."""
    s = nodes_.select(C("id").alias("source_id"), C("name").alias("source_name"), C("level").alias("source_level"))
    t = nodes_.select(C("id").alias("target_id"), C("name").alias("target_name"), C("level").alias("target_level"))
    return relations.join(s, "source_id").join(t, "target_id")


def routed(relations: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Adds ``route``: horizontal within a level, vertical across levels."""
    return with_ends(relations, nodes_).withColumn("route", F.when(C("source_level") == C("target_level"), "horizontal").otherwise("vertical"))


def edge_label(keywords: Column, kind: Column) -> Column:
    """The first keyword, else the type."""
    return F.coalesce(F.get(keywords, 0), kind)


def within_layer(relations: DataFrame, layer_nodes: DataFrame) -> DataFrame:
    """Relations both of whose ends are in ``layer_nodes``."""
    ids = layer_nodes.select("id").distinct()
    return relations.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def incident(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, id): the relations at either end of each node, as the union of two equi joins."""
    n = ids.select(C("id").alias("node")).distinct()
    out = relations.select("id", C("source_id").alias("node")).unionByName(relations.select("id", C("target_id").alias("node")))
    return out.join(n, "node", "left_semi").distinct()


def delete_entities(relations: DataFrame, nodes_: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, relations) without the entities of ``gone`` and everything attached to them."""
    g = gone.select("id").distinct()
    left = relations.join(g.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(g.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes_.join(g, "id", "left_anti"), left


def remap(relations: DataFrame, id_map: DataFrame) -> DataFrame:
    """Ends replaced by ``id_map`` (old, new); unmapped ends stay. ``id_map`` has one row per old id."""
    s = id_map.select(C("old").alias("source_id"), C("new").alias("_s"))
    t = id_map.select(C("old").alias("target_id"), C("new").alias("_t"))
    out = relations.join(s, "source_id", "left").join(t, "target_id", "left")
    return out.withColumn("source_id", F.coalesce("_s", "source_id")).withColumn("target_id", F.coalesce("_t", "target_id")).drop("_s", "_t").select(relations.columns)


# --- duplicates and repair ------------------------------------------------------------------------------------------


def signature(directed: bool = False) -> list[Column]:
    """What makes two relations the same statement: unordered ends, stripped description and chunk, whatever the type."""
    strip = F.regexp_replace("description", r"^\s+|\s+$", "")
    ends = [C("source_id"), C("target_id")] if directed else [F.least("source_id", "target_id"), F.greatest("source_id", "target_id")]
    return [*ends, strip, C("chunk_id")]


def first_statements(relations: DataFrame, order: list[str], structural: bool = False) -> DataFrame:
    """The first relation of each signature (nulls are equal); with ``structural`` the layer counts too."""
    keys = signature() + ([C("layer")] if structural else [])
    return relations.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def repair_report(relations: DataFrame) -> DataFrame:
    """(kind, groups, removed): how many signatures occur more than once and how many relations a repair removes."""
    def counted(kind: str, keys: list[Column]) -> DataFrame:
        named = relations.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
        g = named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(C("n") - 1), F.lit(0)).alias("removed")).select(F.lit(kind).alias("kind"), "groups", "removed")

    return counted("semantic", signature()).unionByName(counted("structural", [*signature(), C("layer")]))


def merged_sources(entities: DataFrame, by: str) -> DataFrame:
    """(by, source): the union of the sources of each group, sorted."""
    return entities.select(by, F.explode("source").alias("s")).where("s is not null").distinct().groupBy(by).agg(F.array_sort(F.collect_list("s")).alias("source"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges`` (a, b).

    Each round takes the smallest label among a node's neighbours, then follows the label's own label, so rounds
    grow with the logarithm of a chain. State is written to the shared folder; only its count of changes comes to the
    driver. Labels travel along edges, never whole components.
    """
    both = edges.select(C("a").alias("node"), C("b").alias("other")).unionByName(edges.select(C("b").alias("node"), C("a").alias("other")))
    both = materialize(both.where(C("node").isNotNull() & C("other").isNotNull()).distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(C("node"), F.min("other")).alias("component")), "labels")
    for _ in range(most_rounds):
        offer = both.join(labels.select(C("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("o"))
        stepped = labels.join(offer, "node").select("node", F.least("component", "o").alias("c"), C("component").alias("was"))
        up = labels.select(C("node").alias("c"), C("component").alias("cc"))
        moved = stepped.join(up, "c", "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("component"), "was")
        moved = materialize(moved, "labels")
        labels = moved.select("node", "component")
        if moved.where(C("component") < C("was")).isEmpty():
            return labels
    raise RuntimeError("labels did not settle")


def merge_components(nodes_: DataFrame, labels: DataFrame) -> DataFrame:
    """(old, new): each member of a component mapped to its member of the smallest level (then id)."""
    members = labels.select(C("node").alias("id"), "component").join(nodes_.select("id", "level"), "id")
    base = members.groupBy("component").agg(F.min_by("id", F.struct("level", "id")).alias("new"))
    return members.join(base, "component").select(C("id").alias("old"), "new").where("old <> new")


# --- traversal ------------------------------------------------------------------------------------------------------


def out_edges(relations: DataFrame, nodes_: DataFrame) -> DataFrame:
    """(cur, next, key, source, move): out-edges with the move they make."""
    rows = with_ends(relations, nodes_)
    move = F.when(C("source_level") == C("target_level"), "horizontal").when(C("target_level") > C("source_level"), "vertical_down").otherwise("vertical_up")
    return rows.select(C("source_id").alias("cur"), C("target_id").alias("next"), C("id").alias("key"), C("chunk_id").alias("source"), move.alias("move"), (C("target_level") - C("source_level")).alias("rise"))


def degrees(edges: DataFrame, nodes_: DataFrame) -> DataFrame:
    """(id, degree): out-edges of every node, 0 included."""
    return nodes_.select("id").join(edges.groupBy(C("cur").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "id", "left").fillna(0, ["degree"])


def source_frequency(edges: DataFrame) -> DataFrame:
    """(source, n): out-edges that cite each chunk."""
    return edges.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def seeds(edges: DataFrame, nodes_: DataFrame, n: int = 400) -> DataFrame:
    """The ``n`` nodes of highest out-degree (then smallest id)."""
    return degrees(edges, nodes_).orderBy(C("degree").desc(), "id").limit(n)


def breadth_first(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """(start, id, hop): nodes within ``hops`` out-edges of each start, the start at hop 0. A frontier join per hop."""
    steps = materialize(edges.select("cur", "next").distinct(), "steps")
    seen = starts.select(C("id").alias("start"), "id", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        new = frontier.join(steps, C("id") == C("cur")).select("start", C("next").alias("id")).distinct()
        frontier = materialize(new.join(seen, ["start", "id"], "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def relation_chunk(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, chunk_id): the chunk of the first relation from a to b that has one, null if none."""
    first = relations.where("chunk_id is not null").groupBy(C("source_id").alias("a"), C("target_id").alias("b")).agg(F.min_by("chunk_id", F.struct("created_at", "id")).alias("chunk_id"))
    return pairs.select("a", "b").join(first, ["a", "b"], "left")


# --- weights and walks ----------------------------------------------------------------------------------------------


def rarity(n: Column) -> Column:
    """1 / sqrt(max(1, n)), 1 where unknown."""
    return F.coalesce(1 / F.sqrt(F.greatest(n, F.lit(1))), F.lit(1.0))


def level_weight(move: Column, rise: Column, down: bool = True, strength: float = 1.0) -> Column:
    if not down:
        return F.lit(1.0)
    return F.when(move == "vertical_down", 1 + 0.35 * rise * strength).when(move == "vertical_up", 0.85).otherwise(1.0)


def novelty(source: Column, used: Column, gain: float = 0.5) -> Column:
    """1 + gain for a source that ``used`` (an array) does not hold, 1 for a known or missing one."""
    return F.when(source.isNotNull() & ~F.array_contains(used, source), 1 + gain).otherwise(1.0)


def similarity_multiplier(similarity: Column, gamma: float) -> Column:
    return 1 + gamma * F.greatest(similarity, F.lit(0.0))


def _attracted(edges: DataFrame, scores: DataFrame | None, beta: float) -> DataFrame:
    """Adds ``_pull``: 1 + beta times the score of the node that an edge leads to, 1 where it has none."""
    if scores is None or not beta:
        return edges.withColumn("_pull", F.lit(1.0))
    return edges.join(scores.select(C("id").alias("next"), C("score").alias("_s")), "next", "left").withColumn("_pull", 1 + beta * F.coalesce("_s", F.lit(0.0))).drop("_s")


def weighted_edges(
    edges: DataFrame, down: bool = False, moves: dict[str, float] | None = None, used: list[str] | None = None, vectors: DataFrame | None = None,
    gamma: float = 0.0, scores: DataFrame | None = None, beta: float = 0.0,
) -> DataFrame:
    """Adds ``w``, the weight of an edge in ranking, at least 1e-12: move times level times rarity of the source, times the
    novelty of the source beside those ``used``, the similarity of the two ends' ``vectors`` (id, vector) and the pull of ``scores``
    (id, score). A factor without its data is 1, as is the novelty without ``used`` and the similarity of a missing vector.
    """
    moves = moves or {"horizontal": 1.0, "vertical_down": 1.0, "vertical_up": 1.0}
    kind = reduce(lambda c, kv: F.when(C("move") == kv[0], kv[1]).otherwise(c), moves.items(), F.lit(1.0))
    rows = _attracted(edges.join(source_frequency(edges), "source", "left"), scores, beta)
    near = F.lit(1.0)
    if vectors is not None and gamma:
        v = vectors.groupBy("id").agg(F.min("vector").alias("vector"))
        rows = rows.join(v.select(C("id").alias("cur"), C("vector").alias("_x")), "cur", "left").join(v.select(C("id").alias("next"), C("vector").alias("_y")), "next", "left")
        near = similarity_multiplier(cosine(doubles(C("_x")), doubles(C("_y")), 1e-12), gamma)
    new = F.lit(1.0) if used is None else novelty(C("source"), F.array(*map(F.lit, used)).cast("array<string>"))
    w = kind * level_weight(C("move"), C("rise"), down) * rarity(C("n")) * new * near * C("_pull")
    return rows.withColumn("w", F.greatest(w, F.lit(1e-12))).drop("n", "_x", "_y", "_pull")


def sampling_edges(edges: DataFrame, scores: DataFrame | None = None, beta: float = 0.0, used: list[str] | None = None, vectors: DataFrame | None = None, anchor: list[float] | None = None, gamma: float = 0.0) -> DataFrame:
    """Adds ``w``, the weight of an edge in sampling, at least 1e-12: the pull of ``scores``, downward levels, the novelty of the
    source and the similarity of the next node's vector to ``anchor``. What ranking has counted already is left out.
    """
    rows, near = _attracted(edges, scores, beta), F.lit(1.0)
    if anchor is not None and vectors is not None and gamma:
        v = vectors.groupBy("id").agg(F.min("vector").alias("_y"))
        rows = rows.join(v.select(C("id").alias("next"), "_y"), "next", "left")
        near = similarity_multiplier(cosine(doubles(C("_y")), F.array(*map(F.lit, map(float, anchor))), 1e-12), gamma)
    new = novelty(C("source"), F.array(*map(F.lit, used or [])).cast("array<string>"))
    return rows.withColumn("w", F.greatest(C("_pull") * level_weight(C("move"), C("rise"), True) * new * near, F.lit(1e-12))).drop("_y", "_pull")


def page_rank(edges: DataFrame, nodes_: DataFrame, restart: float = 0.18, steps: int = 10) -> DataFrame:
    """(id, score): power iteration over out-edges weighted by ``w``, restarting evenly on all nodes.

    Nodes without out-edges hand their score back to the restart. Each step is one join and one aggregation, written
    to the shared folder, so neither the step nor its total is computed twice.
    """
    ids = materialize(nodes_.select("id").distinct(), "nodes")
    n = ids.count()
    if not n:
        return ids.withColumn("score", F.lit(0.0))
    edges = materialize(edges.select("cur", "next", "w"), "weights")
    total = edges.groupBy("cur").agg(F.sum("w").alias("t"))
    p = materialize(edges.groupBy("cur", "next").agg(F.sum("w").alias("w")).join(total, "cur").select("cur", "next", (C("w") / C("t")).alias("p")), "steps")
    score = ids.withColumn("score", F.lit(1.0 / n))
    for _ in range(steps):
        flow = materialize(p.join(score, C("cur") == C("id")).groupBy(C("next").alias("id")).agg(F.sum(C("p") * C("score")).alias("f")), "flow")
        moved = flow.agg(F.coalesce(F.sum("f"), F.lit(0.0)).alias("x")).scalar()
        score = ids.join(flow, "id", "left").select("id", ((1 - restart) * (F.coalesce("f", F.lit(0.0)) + (1 - moved) / n) + restart / n).alias("score"))
    return score


def chosen_edge(weight: Column, *key: Column | str) -> Column:
    """Sort key of a weighted choice without replacement: log(u) / w with u from a hash of ``key``; the largest wins."""
    u = (F.pmod(F.xxhash64(*key), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    return F.ln(u) / weight


def random_walks(edges: DataFrame, starts: DataFrame, walks: int = 3, length: int = 10, restart: float = 0.18, seed: int = 7, gain: float = 0.5) -> DataFrame:
    """(id, visits, score): Monte-Carlo visits of ``walks`` seeded walks from each start.

    A walk counts the node it is at ``length`` times. After each count it restarts with probability ``restart``, or where it cannot
    go on; else all walks are joined with the out-edges of their node and each keeps one by a seeded weighted choice. Sources that
    a walk has not cited since its start are ``gain`` more likely; a restart forgets them. An even share of starts takes
    the place of a random start for each walk.
    """
    edges = materialize(edges.select("cur", "next", "key", "source", "w"), "weights")
    none = F.array().cast("array<string>")
    w = starts.select(C("id").alias("home")).distinct().withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(walks)))).withColumn("at", C("home")).withColumn("used", none)
    # one list of out-edges per node would be unbounded for a hub; the choice is an aggregation instead
    visits = w.select(C("at").alias("id"))
    for step in range(length - 1):
        weight = C("w") * novelty(C("source"), C("used"), gain)
        moving = w.where(F.pmod(F.xxhash64("home", "walk", F.lit(seed * 2000 + step)), F.lit(1000)) >= int(restart * 1000))
        nxt = moving.join(edges, C("at") == C("cur")).groupBy("home", "walk").agg(
            F.max_by(F.struct("next", "source"), chosen_edge(weight, C("home"), C("walk"), C("key"), F.lit(seed * 1000 + step))).alias("to")
        )
        went = C("to").isNotNull()
        cited = F.when(C("to")["source"].isNull(), C("used")).otherwise(F.array_distinct(F.array_append("used", C("to")["source"])))
        w = w.join(nxt, ["home", "walk"], "left").select("home", "walk", F.when(went, C("to")["next"]).otherwise(C("home")).alias("at"), F.when(went, cited).otherwise(none).alias("used"))
        w = materialize(w, "walks")
        visits = visits.unionByName(w.select(C("at").alias("id")))
    counted = visits.groupBy("id").agg(F.count(F.lit(1)).alias("visits"))
    all_visits = counted.agg(F.sum("visits").alias("x")).scalar()
    return counted.withColumn("score", C("visits") / all_visits)


def sample_branches(edges: DataFrame, centers: DataFrame, branches: int = 3, hops: int = 3, seed: int = 11) -> DataFrame:
    """(center, branch, path): branches from each center along weighted out-edges.

    A branch visits no node twice and cites no source twice; ``path`` holds (cur, next, source, key). Branches end where
    nothing is left to choose. Paths are bounded by ``hops``.
    """
    edges = materialize(edges.select("cur", "next", "source", "key", "w"), "weights")
    step_type = "array<struct<cur:string,next:string,source:string,key:string>>"
    b = centers.select(C("id").alias("center")).distinct().withColumn("branch", F.explode(F.sequence(F.lit(1), F.lit(branches)))).withColumn("at", C("center")).withColumn("path", F.expr(f"cast(array() as {step_type})"))
    for hop in range(hops):
        e = edges.select("cur", "next", "source", "key", "w")
        seen = F.array_append(C("path")["cur"], C("at"))
        fresh = ~F.array_contains(seen, C("next")) & (C("source").isNull() | ~F.array_contains(C("path")["source"], C("source")) | (F.size("path") == 0))
        moves = b.join(e, C("at") == C("cur")).where(fresh).groupBy("center", "branch").agg(
            F.max_by(F.struct("cur", "next", "source", "key"), chosen_edge(C("w"), C("center"), C("branch"), C("key"), F.lit(seed * 1000 + hop))).alias("s")
        )
        grown = b.join(moves, ["center", "branch"], "left")
        b = materialize(grown.select("center", "branch", F.coalesce(C("s")["next"], C("at")).alias("at"), F.when(C("s").isNotNull(), F.array_append("path", C("s"))).otherwise(C("path")).alias("path")), "branches")
    return b.where(F.size("path") > 0).select("center", "branch", "path")


def path_signature(paths: Column) -> Column:
    """Order-free signature of an array of branches."""
    edges = F.transform(F.flatten(paths), lambda e: F.concat_ws("|", e["cur"], e["next"], e["source"], e["key"]))
    return F.array_join(F.array_sort(F.array_distinct(edges)), "||")


def is_prefix(a: Column, b: Column) -> Column:
    """Whether branch ``a`` is the start of branch ``b``."""
    return F.slice(b, F.lit(1), F.greatest(F.size(a), F.lit(1))) == a


def accepted_branches(branches: DataFrame, vectors: DataFrame | None = None, tau: float | None = None, chart_end: bool = False, dim: int = 64) -> DataFrame:
    """The branches (center, branch, path) that may stand together: of those with one end node the first, with ``chart_end`` only
    those whose last source is a chart, and with ``tau`` only those whose mean vector is that similar to the center's first
    branch. A branch without vectors is kept.
    """
    end = F.element_at("path", -1)
    rows = branches.where(F.size("path") > 0)
    if chart_end:
        rows = rows.where(F.coalesce(end["source"].contains("chart"), F.lit(False)))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("center", end["next"]).orderBy("branch"))).where("_r = 1").drop("_r")
    if tau is None or vectors is None:
        return rows
    rows = materialize(rows, "branches")
    of_node = vectors.groupBy("id").agg(F.min("vector").alias("vector"))
    nodes_of = rows.select("center", "branch", F.explode(F.array_distinct(F.array_append(C("path")["next"], C("center")))).alias("id"))
    mean = nodes_of.join(of_node, "id").groupBy("center", "branch").agg(mean_vector(F.collect_list(doubles(C("vector"))), dim).alias("v"))  # of a branch's few nodes
    mean = materialize(mean, "means")
    first = rows.groupBy("center").agg(F.min("branch").alias("branch")).join(mean, ["center", "branch"]).select("center", C("v").alias("_f"))
    judged = rows.join(mean, ["center", "branch"], "left").join(first, "center", "left")
    return judged.where(F.coalesce(cosine(C("v"), C("_f"), 1e-12) >= tau, F.lit(True))).drop("v", "_f")


def path_pool(branches: DataFrame, least_sources: int = 1, least_charts: int = 0) -> DataFrame:
    """(center, paths, sources, signature): each center's branches without those that start another, deduplicated by
    signature over all centers (the smallest center stays), with at least ``least_sources`` distinct sources, of which
    at least ``least_charts`` are charts."""
    per = branches.groupBy("center").agg(F.array_sort(F.collect_set("path")).alias("all"))
    kept = F.filter("all", lambda a: ~F.exists("all", lambda b: (F.size(b) > F.size(a)) & (F.slice(b, F.lit(1), F.size(a)) == a)))
    pool = per.withColumn("paths", kept).withColumn("sources", F.array_distinct(F.filter(F.flatten("paths")["source"], lambda s: s.isNotNull())))
    pool = pool.where((F.size("sources") >= least_sources) & (F.size(F.filter("sources", lambda s: s.contains("chart"))) >= least_charts))
    pool = pool.withColumn("signature", F.md5(path_signature(C("paths"))))
    return pool.withColumn("_r", F.row_number().over(Window.partitionBy("signature").orderBy("center"))).where("_r = 1").select("center", "paths", "sources", "signature")


def pooled_assignments(pool: DataFrame, uses: int) -> DataFrame:
    """Each path of a pool as often as its reuse budget allows, numbered round by round."""
    return pool.withColumn("use", F.explode(F.sequence(F.lit(1), F.lit(uses))))


def packed_evidence(sources: Column, most: int = 6) -> Column:
    """Chart sources first, at most ``most``."""
    is_chart = lambda s: s.contains("chart")
    return F.slice(F.concat(F.filter(sources, is_chart), F.filter(sources, lambda s: ~is_chart(s))), 1, most)


#: Kinds of questions.
QUERY_TYPES = ("FactCheck", "Manipulation", "Comparison", "Trend", "Analysis")


def validated_answer(kind: Column, evidence: Column, pool: Column, charts: Column | None = None, index: Column | None = None) -> Column:
    """A struct of the kind (``Comparison`` if unknown or null), the evidence within the pool in its own order (the pool if none is)
    and, of the cited ``charts`` (chunk ids), those in the ``index`` of shown images (chunk id to number), with their number."""
    inside = F.filter(F.coalesce(evidence, F.array().cast("array<string>")), lambda x: F.coalesce(F.array_contains(pool, x), F.lit(False)))
    fields = [F.when(kind.isin(*QUERY_TYPES), kind).otherwise("Comparison").alias("kind"), F.when(F.size(inside) > 0, inside).otherwise(pool).alias("evidence")]
    if charts is not None and index is not None:
        known = F.filter(F.coalesce(charts, F.array().cast("array<string>")), lambda x: x.isNotNull() & F.array_contains(F.map_keys(index), x))
        fields.append(F.transform(known, lambda x: F.struct(x.alias("chunk_id"), F.element_at(index, x).alias("image_index"))).alias("charts"))
    return F.struct(*fields)


def difficulty(paths: Column, used: Column, subjective: Column) -> Column:
    """Charts used, plus the furthest hop at which used evidence stands, plus a rating bounded to 1..3 (2 if missing).

    The furthest hop is that of the last source, by first places, that is used: a pass over each path, none for each source.
    """
    charts = F.size(F.filter(used, lambda s: s.contains("chart")))
    sources = lambda b: F.transform(b, lambda e: e["source"])
    last = lambda b: F.try_element_at(F.array_intersect(F.array_compact(sources(b)), used), F.lit(-1))
    hop = lambda b: F.coalesce(F.array_position(sources(b), last(b)), F.lit(0))
    far = F.coalesce(F.array_max(F.transform(paths, hop)), F.lit(0))
    return (charts + far + F.coalesce(F.least(F.greatest(subjective, F.lit(1)), F.lit(3)), F.lit(2))).cast("int")


# --- pages ----------------------------------------------------------------------------------------------------------


def page_of(chunk: Column) -> Column:
    """The page token of a chunk id."""
    return F.get(F.split(chunk, "_"), 1)


def merged_paragraphs(docs: DataFrame, key: str = "chunk_id", text: str = "text", order: str = "doc_id") -> DataFrame:
    """(paragraph, text): fragments of a paragraph joined by a blank line in order; other ids are dropped."""
    rows = docs.where(C(key).startswith("paragraph_"))
    return rows.groupBy(C(key).alias("paragraph")).agg(F.array_sort(F.collect_list(F.struct(C(order).alias("o"), C(text).alias("t")))).alias("x")).select("paragraph", F.array_join(C("x")["t"], "\n\n").alias("text"))


def pages(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(page, charts, texts, qas): full outer join of the pages' charts and texts, with the questions of each page."""
    page = page_of(C("chunk_id")).alias("page")
    charts = docs.where(C("chunk_id").contains("chart")).groupBy(page).agg(F.array_sort(F.collect_set("chunk_id")).alias("charts"))
    texts = docs.where(~C("chunk_id").contains("chart")).groupBy(page).agg(F.array_sort(F.collect_set("chunk_id")).alias("texts"))
    qas = entries.select(C("ori_id").alias("page"), F.explode("qa_ids").alias("q")).distinct().groupBy("page").agg(F.array_sort(F.collect_list("q")).alias("qas"))
    return charts.join(texts, "page", "full").join(qas, "page", "left")
