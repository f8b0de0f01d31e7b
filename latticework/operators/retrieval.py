"""Vector and term retrieval, similarity joins and retrieval metrics.

A stated query set is matched against all rows in blocks: queries and items travel as packed matrices, a block of
queries meets a block of items in one task, and each block pair keeps its best ``k`` only. Query blocks are broadcast
while their size is within a checked bound; beyond it items are shuffled to the query blocks by block number.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import text as T
from latticework.session import materialize

BLOCK = 1024

#: Words: runs of letters and digits of any script.
WORDS = r"[\p{L}\p{N}]+"

#: Query vectors that are broadcast at most (8 bytes a value).
BROADCAST_QUERIES = 8_192


#: (term, query) entries of a query set that are broadcast at most.
BROADCAST_TERMS = 100_000

#: Scores (documents of a block times queries) that are held at once.
SCORES = 4_000_000


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, dim))


def top_k(queries: DataFrame, items: DataFrame, k: int, metric: str = "cosine", digits: int = 6, dim: int = 64, most: int = BROADCAST_QUERIES) -> DataFrame:
    """(qid, id, sim, rank): the ``k`` best items of each query; ties, after rounding to ``digits``, by smaller id.

    ``queries`` has (qid, vector), ``items`` (id, vector). Null vectors and those of another length take no part; a zero
    vector has cosine 0. Empty sides give no rows; repeated rows repeat.
    """
    ok = lambda df: df.where(F.size("vector") == dim)
    queries, items = ok(queries.select("qid", "vector")), ok(items.select("id", "vector"))
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    numbered = queries.withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    packed = numbered.groupBy("b").agg(F.collect_list(F.struct("qid", "vector")).alias("qs"))  # about BLOCK each
    scale = float(10**digits)

    def unit(x: np.ndarray) -> np.ndarray:
        if metric == "dot":
            return x
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        sims = np.floor(q @ x.T * scale + 0.5) / scale
        order = np.argsort(ids, kind="stable")
        sims, ids = sims[:, order], ids[order]
        kept = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(qids)), kept.shape[1])
        return pd.DataFrame({"qid": qids[rows], "id": ids[kept.ravel()], "sim": sims[rows, kept.ravel()]})

    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {items.schema['id'].dataType.simpleString()}, sim double"
    if n <= most:
        rows = queries.toPandas()
        held = queries.sparkSession.sparkContext.broadcast((rows["qid"].to_numpy(), unit(_matrix(rows["vector"], dim))))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, q = held.value
            kept = None  # the best of the task so far; only these leave it
            for b in batches:
                for start in range(0, len(b) if len(qids) else 0, BLOCK):
                    part = b.iloc[start : start + BLOCK]
                    found = best(qids, q, part["id"].to_numpy(), unit(_matrix(part["vector"], dim)))
                    kept = found if kept is None else _best_of(pd.concat([kept, found]), "qid", "sim", "id", k)
            if kept is not None:
                yield kept

        found = items.mapInPandas(scan, kinds)
    else:
        cell = F.floor(F.rand(3) * F.lit(max(1, items.count() // BLOCK))).cast("int")
        item_blocks = items.withColumn("c", cell).groupBy("c").agg(F.collect_list(F.struct("id", "vector")).alias("xs"))
        meet = item_blocks.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "b")

        def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for qs, xs in zip(b["qs"], b["xs"], strict=True):
                    q, x = pd.DataFrame(list(qs)), pd.DataFrame(list(xs))
                    yield best(q["qid"].to_numpy(), unit(_matrix(q["vector"], dim)), x["id"].to_numpy(), unit(_matrix(x["vector"], dim)))

        found = meet.select("qs", "xs").mapInPandas(pairs, kinds)
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best_of(rows: pd.DataFrame, query: str, score: str, row: str, k: int) -> pd.DataFrame:
    """The ``k`` rows of the highest score of each query, ties by smaller id."""
    rows = rows.sort_values([query, score, row], ascending=[True, False, True], kind="stable")
    return rows[rows.groupby(query, sort=False).cumcount() < k]


def candidate_links(found: DataFrame, least: float) -> DataFrame:
    """(a, b): distinct unordered pairs of a top-k result (which counts the query itself) of at least ``least``."""
    pairs = found.where((F.col("sim") >= least) & (F.col("qid") != F.col("id")))
    return pairs.select(F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b")).distinct()


def layer_of(level: Column, last: int) -> Column:
    """The layer of an entity: its level, or the last layer if that is unknown or no layer."""
    return F.when((level >= 0) & (level <= last), level).otherwise(F.lit(last))


def union_top_k(layers: list[DataFrame], k: int) -> DataFrame:
    """The ``k`` best over the per-layer results of each query."""
    rows = layers[0]
    for x in layers[1:]:
        rows = rows.unionByName(x)
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), "id")
    return rows.drop("rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sources_of(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, sources): the union of the sources of the found entities, sorted."""
    held = entities.select("id", F.explode("source").alias("src"))
    return found.select("qid", "id").join(held, "id").groupBy("qid").agg(F.array_sort(F.collect_set("src")).alias("sources"))


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term): lower-case runs of letters and digits; null texts have none."""
    return df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORDS), 0)).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = 0.9, b: float = 0.4, digits: int = 4, most: int = BROADCAST_TERMS) -> DataFrame:
    """(qid, doc_id, score, rank): the ``k`` documents of the highest BM25 score for each query.

    ``docs`` has (doc_id, text), ``queries`` (qid, text). Term statistics cover all documents; each distinct query term
    counts once; ties by smaller doc_id. While the queries' (term, query) entries are within ``most`` those entries are
    broadcast and documents are scored in blocks, each task keeping its best ``k`` per query; beyond it postings of
    query terms are joined with the queries. Words are runs of letters and digits of any script.
    """
    found = F.regexp_extract_all(F.lower("text"), F.lit(WORDS), 0)
    words = docs.select("doc_id", found.alias("w")).where(F.size("w") > 0)
    total = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avg")).first()
    n, avg = float(total.n or 0), float(total.avg or 1)
    asked = terms(queries, "qid", "text").distinct()
    held_by = words.select(F.explode(F.array_distinct("w")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    df = held_by.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    by_score = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id")
    scale = 10.0**digits
    if asked.limit(most + 1).count() <= most:
        pairs = asked.join(df.withColumn("idf", idf), "term").select("qid", "term", "idf").toPandas().sort_values(["term", "qid"])
        qids = np.array(sorted(set(pairs["qid"])))
        spots = np.searchsorted(qids, pairs["qid"].to_numpy()) if len(pairs) else np.zeros(0, dtype=np.int64)
        terms_, first = np.unique(pairs["term"].to_numpy(dtype=object), return_index=True) if len(pairs) else (np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64))
        # sparse: for each term the place of its entries; as many entries as were counted
        places = {t: (int(i), int(j)) for t, i, j in zip(terms_, first, [*first[1:], len(pairs)], strict=True)}
        held = queries.sparkSession.sparkContext.broadcast((places, qids, spots, pairs["idf"].to_numpy(dtype=np.float64)))

        def score_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            places, qids, spots, idfs = held.value
            small = len(places) * len(qids) <= SCORES  # then one dense matrix is as good as the entries
            rows = max(1, min(2048 if small else 256, SCORES // max(1, len(qids), len(places) if small else 1)))
            number = {t: i for i, t in enumerate(places)}
            start = np.array([p for p, _ in places.values()], dtype=np.int64)
            length = np.array([z - p for p, z in places.values()], dtype=np.int64)
            if small:
                weights = np.zeros((len(places), len(qids)))
                weights[np.repeat(np.arange(len(places)), length), spots] = idfs
            kept = None  # the best of the task so far; only these leave it
            for whole in batches:
                for begin in range(0, len(whole) if len(qids) else 0, rows):
                    block = whole.iloc[begin : begin + rows]
                    doc, term, value = [], [], []
                    for i, found in enumerate(block["w"]):
                        dl = len(found)
                        for t, f in Counter(found).items():
                            if (n_ := number.get(t)) is not None:
                                doc.append(i)
                                term.append(n_)
                                value.append(f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avg)))
                    if not doc:
                        continue
                    doc, term, value = np.array(doc), np.array(term), np.array(value)
                    if small:
                        x = np.zeros((len(block), len(places)))
                        x[doc, term] = value
                        scores = x @ weights
                    else:
                        each = length[term]
                        entry = np.arange(each.sum()) + np.repeat(start[term] - np.cumsum(each) + each, each)
                        at = np.repeat(doc * len(qids), each) + spots[entry]
                        scores = np.bincount(at, np.repeat(value, each) * idfs[entry], len(block) * len(qids)).reshape(len(block), -1)
                    scores = np.floor(scores * scale + 0.5) / scale
                    order = np.argsort(block["doc_id"].to_numpy(), kind="stable")
                    ids, scores = block["doc_id"].to_numpy()[order], scores[order]
                    top = np.argsort(-scores, axis=0, kind="stable")[:k]
                    q = np.broadcast_to(np.arange(len(qids)), top.shape).ravel()
                    found = pd.DataFrame({"qid": qids[q], "doc_id": ids[top.ravel()], "score": scores[top.ravel(), q]})
                    found = found[found["score"] > 0]
                    kept = _best_of(found if kept is None else pd.concat([kept, found]), "qid", "score", "doc_id", k)
            if kept is not None:
                yield kept

        found = words.mapInPandas(score_blocks, f"qid {queries.schema['qid'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
        return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    tf = terms(docs, "doc_id", "text").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    sizes = words.select("doc_id", F.size("w").alias("dl"))
    postings = tf.join(asked.select("term").distinct(), "term", "left_semi")
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avg))
    weighted = postings.join(df, "term").join(sizes, "doc_id").select("term", "doc_id", weight.alias("w"))
    score = asked.join(weighted, "term").groupBy("qid", "doc_id").agg(F.sum("w").alias("s"))
    score = score.withColumn("score", F.floor(F.col("s") * scale + 0.5) / scale).drop("s").where("score > 0")
    return score.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def token_classes(texts: DataFrame) -> DataFrame:
    """(id, rep): every record of ``texts`` (id, tokens) with the smallest id of its token set; records without tokens give none."""
    sets = texts.withColumn("tokens", F.array_sort(F.array_distinct("tokens"))).where(F.size("tokens") > 0)
    reps = sets.groupBy("tokens").agg(F.min("id").alias("rep"))
    return sets.join(reps, "tokens").select("id", "rep").distinct()


def token_links(texts: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b): pairs of distinct token sets with Jaccard similarity of at least ``least``, found without loss.

    ``texts`` has (id, tokens). Sets are sorted by global rarity; two sets that are similar enough share a token within
    their first ``n - ceil(least n) + 1``, so an equi join on those rare tokens meets every such pair. Equal sets are
    one class (``token_classes``); here the smallest id stands for it.
    """
    reps = texts.withColumn("tokens", F.array_sort(F.array_distinct("tokens"))).where(F.size("tokens") > 0).groupBy("tokens").agg(F.min("id").alias("id"))
    rarity = reps.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    ranked = reps.select("id", F.explode("tokens").alias("t")).join(rarity, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("x"))
    ranked = ranked.select("id", F.col("x")["t"].alias("x")).withColumn("n", F.size("x"))
    prefix = F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)) + 1
    keys = ranked.select("id", "n", "x", F.explode(F.slice("x", F.lit(1), prefix.cast("int"))).alias("t"))
    right = keys.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("x").alias("xb"), "t")
    near = (F.col("id") < F.col("b")) & (F.col("n") >= F.col("nb") * least - 1e-9) & (F.col("nb") >= F.col("n") * least - 1e-9)
    common = F.size(F.array_intersect("x", "xb"))
    met = keys.join(right, "t").where(near).select(F.col("id").alias("a"), "b", "x", "xb", "n", "nb").dropDuplicates(["a", "b"])
    return met.where(common >= F.lit(least) * (F.col("n") + F.col("nb") - common) - 1e-9).select("a", "b")


#: Words of a name up to which its candidates are those that share enough words with it as a set; beyond it they are found by rare words.
FEW_WORDS = 8


def name_sides(spellings: DataFrame) -> DataFrame:
    """(id, name, w, n, chars, digits): what judging a pair of ``spellings`` (id, name) needs of either; names without a word give no row."""
    pairs = F.filter(T.bigrams(F.col("name")), lambda p: p.rlike(r"\d"))
    w = F.array_sort(F.array_distinct(F.regexp_extract_all("name", F.lit(WORDS), 0)))
    sides = spellings.select("id", "name", w.alias("w"), T.characters(F.col("name")).alias("chars"), F.array_sort(pairs).alias("digits"))
    return sides.withColumn("n", F.size("w")).where("n > 0")


def candidate_blocks(sides: DataFrame, least: float, most: int = FEW_WORDS) -> DataFrame:
    """(block, id, n, c, lead): names of at most ``most`` words that have ``c`` words in common and equal digits.

    Two names with a Jaccard similarity of at least ``least`` and ``c`` common words have each at most c / least words, so
    each meets the other in the block of these words; in a block sizes alone tell whether a pair is similar enough. ``lead``
    has the fewest words; members too large to be similar to it are similar to none. Blocks are told apart by a hash: names
    that meet by chance are judged as all others.
    """
    ways = [(n, list(x)) for n in range(1, most + 1) for c in range(math.ceil(least * n - 1e-9), n + 1) for x in combinations(range(n), c)]
    ways = sides.sparkSession.createDataFrame(ways, "n int, at array<int>")
    block = F.xxhash64(F.transform("at", lambda i: F.get("w", i)), "digits")
    met = sides.select("id", "w", "n", "digits").join(F.broadcast(ways), "n").select(block.alias("block"), "id", "n", F.size("at").alias("c"))
    met = materialize(met, "met")
    leads = met.groupBy("block").agg(F.min(F.struct("n", "id")).alias("l"), F.count(F.lit(1)).alias("m")).where("m > 1").select("block", F.col("l.n").alias("ln"), F.col("l.id").alias("lead"))
    return met.join(leads, "block").where(_sizes_fit("n", "ln", "c", least) | (F.col("id") == F.col("lead"))).select("block", "id", "n", "c", "lead")


def _sizes_fit(a: str, b: str, common: str, least: float) -> Column:
    return F.col(common) >= F.lit(least) * (F.col(a) + F.col(b) - F.col(common)) - 1e-9


def long_pairs(sides: DataFrame, least: float, most: int = FEW_WORDS) -> DataFrame:
    """(a, b): candidate pairs of which at least one name has more than ``most`` words."""
    sets = sides.where(F.col("n") >= math.ceil(least * (most + 1) - 1e-9)).select("id", F.col("w").alias("tokens"), "n")
    if sets.where(F.col("n") > most).isEmpty():
        return sides.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    same = token_classes(sets.select("id", "tokens"))
    long = sets.where(F.col("n") > most).select(F.col("id").alias("rep")).join(same, "rep", "left_semi").select("rep").distinct()
    links = token_links(sets.select("id", "tokens"), least)
    links = links.unionByName(same.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct())
    of = lambda rep, id_: same.select(F.col("rep").alias(rep), F.col("id").alias(id_))
    held = links.join(long.withColumnRenamed("rep", "a"), "a", "left_semi").unionByName(links.join(long.withColumnRenamed("rep", "b"), "b", "left_semi")).distinct()
    pairs = held.join(of("a", "i"), "a").join(of("b", "j"), "b").where("i <> j")
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def undecided(held: DataFrame) -> tuple[DataFrame, int, int]:
    """The blocks of ``held`` (block, id, n, c, component) of more than one component, their rows and at most so many pairs across components."""
    parts = held.groupBy("block", "component").agg(F.count(F.lit(1)).alias("m"))
    open_ = parts.groupBy("block").agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("within")).where("k > 1")
    open_ = materialize(open_.select("block", "rows", ((F.col("rows") * F.col("rows") - F.col("within")) / 2).cast("bigint").alias("pairs")), "open")
    total = open_.agg(F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs")).first()
    return materialize(held.join(open_.select("block"), "block"), "held"), total.rows or 0, total.pairs or 0


def lead_pairs(held: DataFrame, turn: int, least: float) -> DataFrame:
    """(a, b): of each block a member of a component drawn by ``turn``, with all members of the others."""
    leads = held.groupBy("block").agg(F.min(F.struct(F.xxhash64("component", F.lit(turn)).alias("h"), "n", "id", "component")).alias("l"))
    leads = leads.select("block", F.col("l.n").alias("ln"), F.col("l.id").alias("lead"), F.col("l.component").alias("lc"))
    met = held.join(leads, "block").where((F.col("component") != F.col("lc")) & _sizes_fit("n", "ln", "c", least))
    return met.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b"))


def cross_pairs(held: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of a block of ``held`` (block, id, n, c, component) that are of two components and similar enough."""
    right = held.select("block", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    met = held.withColumnRenamed("id", "a").join(right, "block").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("cb")) & _sizes_fit("n", "nb", "c", least))
    return met.select("a", "b")


def judged(pairs: DataFrame, sides: DataFrame, least: float) -> DataFrame:
    """(a, b): the distinct ``pairs`` (a, b) that are similar enough and alike by the name rule."""
    x = sides.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("name", "w", "n", "chars", "digits")])
    y = sides.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("name", "w", "n", "chars", "digits")])
    common = F.size(F.array_intersect("w_a", "w_b"))
    close = common >= F.lit(least) * (F.col("n_a") + F.col("n_b") - common) - 1e-9
    alike = T.alike(F.col("name_a"), F.col("name_b"), F.col("chars_a"), F.col("chars_b"))
    return pairs.distinct().join(x, "a").join(y, "b").where(F.col("digits_a") == F.col("digits_b")).where(close).where(alike).select("a", "b")


def ranks(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, rank, rel, gold): each retrieved row with its relevance and the number of its query's gold documents.

    ``found`` has (qid, id, rank), ``gold`` (qid, id). Queries of ``gold`` without a result keep one row with rank null.
    """
    g = gold.select("qid", "id").distinct()
    sizes = g.groupBy("qid").agg(F.count(F.lit(1)).alias("gold"))
    hits = found.join(g.withColumn("rel", F.lit(1)), ["qid", "id"], "left").select("qid", "rank", "id", F.coalesce("rel", F.lit(0)).alias("rel"))
    return sizes.join(hits, "qid", "full").select("qid", "rank", "id", F.coalesce("rel", F.lit(0)).alias("rel"), F.coalesce("gold", F.lit(0)).alias("gold"))


def query_metrics(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per query: P@k (over k), R@k (over the gold), NDCG@k (ideal of the retrieved relevances), AP, MRR.

    A document retrieved twice counts once in P and R, twice in AP; without gold, or without results, all are 0.
    """
    w = Window.partitionBy("qid").orderBy("rank")
    first = F.row_number().over(Window.partitionBy("qid", "id").orderBy("rank")) == 1
    rows = ranked.withColumn("hit", F.sum("rel").over(w)).withColumn("new", F.when(first, F.col("rel")).otherwise(0))
    aggs = []
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.sum(F.when(inside, F.col("new")).otherwise(0)).alias(f"h{k}"), F.sum(F.when(inside, F.col("rel")).otherwise(0)).alias(f"c{k}"),
                 F.sum(F.when(inside, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"d{k}")]
    per = rows.groupBy("qid").agg(
        F.max("gold").alias("gold"), *aggs,
        F.coalesce(F.sum(F.when(F.col("rel") == 1, F.col("hit") / F.col("rank"))), F.lit(0.0)).alias("ap"),
        F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"),
    )
    ideal = lambda c: F.aggregate(F.sequence(F.lit(1), F.greatest(c, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    g = F.when(F.col("gold") > 0, F.col("gold"))
    out = [F.col("qid")]
    for k in ks:
        out += [(F.col(f"h{k}") / k).alias(f"p{k}"), F.coalesce(F.col(f"h{k}") / g, F.lit(0.0)).alias(f"r{k}"),
                F.when(F.col(f"c{k}") > 0, F.col(f"d{k}") / ideal(F.col(f"c{k}"))).otherwise(0.0).alias(f"ndcg{k}")]
    return per.select(*out, F.coalesce(F.col("ap") / g, F.lit(0.0)).alias("map"), F.when(F.col("gold") > 0, F.col("mrr")).otherwise(0.0).alias("mrr"))


def macro(metrics: DataFrame, kind: Column | None = None) -> DataFrame:
    """Mean of each metric over all queries, and per kind in the same pass (grouping sets) if ``kind`` is given."""
    names = [c for c in metrics.columns if c != "qid"]
    aggs = [F.avg(c).alias(c) for c in names] + [F.count(F.lit(1)).alias("queries")]
    if kind is None:
        return metrics.agg(*aggs)
    rows = metrics.withColumn("kind", kind)
    return rows.groupingSets([["kind"], []], "kind").agg(*aggs, F.grouping("kind").cast("int").alias("overall"))


def micro(ranked: DataFrame, k: int) -> DataFrame:
    """Micro precision, recall and F1 of the first ``k`` results over all queries; 0 where undefined."""
    hits = ranked.select("qid", "gold", F.when(F.col("rank") <= k, F.col("id")).alias("id"), F.when(F.col("rank") <= k, F.col("rel")).otherwise(0).alias("rel"))
    once = hits.groupBy("qid", "id").agg(F.max("gold").alias("gold"), F.max("rel").alias("rel"))
    per = once.groupBy("qid").agg(F.max("gold").alias("gold"), F.sum("rel").alias("tp"), F.count("id").alias("n"))
    s = per.agg(F.sum("tp").alias("tp"), (F.sum("n") - F.sum("tp")).alias("fp"), (F.sum("gold") - F.sum("tp")).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0)
    return s.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def hashed_embedding(text: Column, dim: int = 16) -> Column:
    """A deterministic bag-of-words vector, as the offline stand-in for an encoder: token counts by bucket of the word's digest."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")
    place = F.transform(words, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(place, lambda p: p == i)).cast("double"))
