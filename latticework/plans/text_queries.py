"""T-*, JS-*, X-13 to X-23, E-*, F-10 and file rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from latticework.functions import jsonfix as J
from latticework.functions import text as T
from latticework.functions.vec import rnd
from latticework.operators import environment as E
from latticework.operators import graph as G
from latticework.operators import partition as X
from latticework.operators import plugins as PL
from latticework.plans import graph_queries as GQ
from latticework.plans.proxies import RESPONSES, r, responses
from latticework.sources import readers as S
from latticework.sources.tables import table


def qa(s, d):
    """Tasks, repeated rows once."""
    return table(s, d, "qa_task", "task_id", "query", "answer", "gt_sources", "start_candidates").distinct()


QA = "qa AS (SELECT DISTINCT task_id, query, answer, gt_sources, start_candidates FROM qa_task)"


def _pairs(s, d):
    """Names of the two ends of each relation, in printable ASCII (DuckDB's edit distance counts bytes)."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^ -~]", "")
    return G.with_ends(GQ._rel(s, d), GQ._nodes(s, d)).select("id", plain("source_name").alias("a"), plain("target_name").alias("b")).where("a is not null and b is not null")


_PAIRS = f"{GQ.REL}, {GQ.NODES}, pr AS (SELECT rl.id, regexp_replace(lower(s.name), '[^ -~]', '', 'g') AS a, regexp_replace(lower(t.name), '[^ -~]', '', 'g') AS b FROM rl JOIN nd s ON s.id = source_id JOIN nd t ON t.id = target_id WHERE s.name IS NOT NULL AND t.name IS NOT NULL)"


def _tagged(s, d):
    n = F.col("task_id") % 4
    return qa(s, d).where("answer is not null").select("task_id", F.concat(F.lit("<think>x</think> Step  <answer>old</answer> then <answer> "), F.when(n == 0, F.lit("The ")).otherwise(F.lit("")), F.regexp_replace("answer", "[<>]", ""), F.lit("</answer>")).alias("t"), F.array(F.regexp_replace("answer", "[<>]", "")).alias("gold"))


_TAGGED = f"""{QA}, tg AS (SELECT task_id, '<think>x</think> Step  <answer>old</answer> then <answer> ' || CASE WHEN task_id % 4 = 0 THEN 'The ' ELSE '' END || regexp_replace(answer, '[<>]', '', 'g') || '</answer>' AS t,
    regexp_replace(answer, '[<>]', '', 'g') AS gold FROM qa WHERE answer IS NOT NULL)"""
_STRIP = r"regexp_replace({x}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"
_EDGE = r"'(^|[^\p{{L}}\p{{N}}_])(?:a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \2', 'g'"  # RE2's \b knows ASCII letters only
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), " + _EDGE + r"), " + _EDGE + r"), '\s+', ' ', 'g'), ' ')"


def _n(x):
    return _NORM.format(x=x)


def _t05(s, d):
    n, body = F.col("task_id") % 4, F.regexp_replace(F.coalesce("answer", F.lit("")), "[<>]", "")
    think, answer = F.concat(F.lit("<think> "), F.coalesce("gt_sources", F.lit("")), F.lit("\n</think>\n")), F.concat(F.lit("<answer>"), body, F.lit(" , UP,,Left a</answer> "))
    seen, after = F.lit("so <observation>o\n</observation> "), F.lit("<prediction>p</prediction> x")
    t = F.when(n == 0, F.concat(seen, think, after)).when(n == 1, F.concat(seen, answer, think, after)).otherwise(F.concat(seen, think, answer, after))
    x = qa(s, d).select("task_id", T.world_model(t).alias("x")).select("task_id", "x.*")
    return x.withColumn("actions", F.array_join("actions", "|"))


def _t06(s, d):
    n = F.col("event_id") % 5
    arg = F.when(n == 0, F.lit("  New   York 3 ")).when(n == 1, F.lit("")).when(n == 2, F.lit(" 7x")).otherwise(F.concat(F.lit("\t"), F.col("event_id").cast("string"), F.lit(" ")))
    e = table(s, d, "events", "event_id", F.concat(F.lit(" "), F.initcap("event_type"), arg).alias("a"))
    return e.select("event_id", T.action_parts(F.col("a")).alias("x")).select("event_id", "x.*")


def _t10(s, d):
    t = F.concat("answer", F.lit(" #### 1,0"), F.col("task_id").cast("string"))
    return qa(s, d).where("answer is not null").select("task_id", T.final_number(t).alias("strict"), T.final_number(F.col("answer"), False).alias("flexible"))


def _t11(s, d):
    o = table(s, d, "orders", "o_orderkey")
    return o.select("o_orderkey", T.boxed_column(F.concat(F.lit("so \\boxed{1} or \\boxed{\\frac{1}{"), F.col("o_orderkey").cast("string"), F.lit("}} end"))).alias("x"))


def _t12(s, d):
    o = table(s, d, "orders", "o_orderkey")
    k = F.col("o_orderkey").cast("string")
    return o.select("o_orderkey", T.math_score(F.concat(F.lit("\\boxed{x = "), k, F.lit("/7 }")), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("\\dfrac{"), k, F.lit("}{7}"))).otherwise(F.lit("3"))).alias("score"))


def _boxes(s, d):
    o = table(s, d, "orders", "o_orderkey")
    k = F.col("o_orderkey")
    pts = F.array(*[F.struct(((k * m) % 100).cast("double").alias("x"), ((k * m * 7) % 90).cast("double").alias("y")) for m in (3, 11, 29)])
    box = F.array(*[x.cast("double") for x in ((k % 50), (k % 40), (k % 50) + 30, (k % 40) + 25)])
    return o.select("o_orderkey", pts.alias("p"), box.alias("b"))


def _t24(s, d):
    rows = table(s, d, "eval_item", "item_id", "text").select("item_id", F.array(F.concat(F.lit("T"), F.col("item_id").cast("string"), F.lit("\n"), F.col("text")), F.col("text")).alias("x"))
    return rows.select("item_id", T.passages(F.col("x")).alias("t"))


def _t26(s, d):
    c = F.array(F.struct(F.lit("text").alias("type"), F.col("query").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("i").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("!").alias("text")))
    return qa(s, d).select("task_id", T.text_parts(c).alias("t"))


def _t27(s, d):
    o = table(s, d, "orders", "o_orderkey")
    p = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("o_orderkey") % 9 - 1).cast("int")
    return o.select("o_orderkey", rnd(T.step_score(p, (F.col("o_orderkey") % 7 - 1).cast("int"), F.lit(8))).alias("score"))


def _t32(s, d):
    t = F.concat(F.lit("a <code> x = 1 </code> b <interpreter>"), F.regexp_replace(F.coalesce("answer", F.lit("")), "[<>]", ""), F.lit("</interpreter><answer>z</answer>"))
    return qa(s, d).select("task_id", T.transcript_parts(t).alias("p")).select("task_id", F.size("p").alias("n"), F.col("p")[1]["kind"].alias("kind"), F.col("p")[2]["body"].alias("last"))


def _js01(s, d):
    e = table(s, d, "events", "event_id", "props")
    t = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("<think>{no}</think>"), F.col("props"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.expr("left(props, length(props) - 1)")).otherwise(F.lit("nothing here"))
    return e.select("event_id", F.get_json_object(J.parsed_column(t), "$.k").cast("int").alias("k"))


def _x13(s, d):
    rows = responses(s, d).select((F.col("g") / 100).cast("bigint").alias("batch"), (F.col("g") * 100 + F.col("ord")).alias("row"), "len")
    return X.partitioned(rows, "batch", "row", "len", 4)


def _x14(s, d):
    rows = responses(s, d).select((F.col("g") / 100).cast("bigint").alias("batch"), (F.col("g") * 100 + F.col("ord")).alias("row"), "len")
    return X.partitioned(rows, "batch", "row", "len", 4, "greedy")


def _x20(s, d):
    t = F.concat(F.lit("Look <image>"), F.col("query"), F.lit("<video> end"))
    p = qa(s, d).select("task_id", X.media_parts(t).alias("p"))
    return p.select("task_id", F.size("p").alias("n"), F.array_join(F.transform("p", lambda x: x["type"]), ",").alias("kinds"))


def _x23(s, d):
    o = table(s, d, "orders", "o_orderkey")
    opts = X.shuffled_options(F.array(F.lit("w"), F.lit("x"), F.lit("y"), F.lit("z")), F.col("o_orderkey"))
    return o.select("o_orderkey", F.array_join(opts, "").alias("options"), X.gold_letter(opts, F.lit("w")).alias("gold"))


def _f10(s, d):
    rows = qa(s, d).select(
        "task_id", F.lit("chart_facts").alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.concat("query", F.lit(" Answer:")).alias("content"))).alias("prompt"),
        F.lit("facts").alias("ability"), F.struct(F.lit("rule").alias("style"), F.col("answer").alias("ground_truth")).alias("reward_model"),
    )
    return rows.select("task_id", "data_source", F.get("prompt", 0)["content"].alias("content"), "ability", F.col("reward_model.ground_truth").alias("ground_truth"))


def _f10b(s, d):
    return qa(s, d).select("task_id", F.expr("stack(2, 'chosen', query, 'rejected', answer) as (kind, response)"))


def _episodes(s, d):
    """A scripted episode per root node: start there, search and move along its first named edge, return, stop."""
    names = GQ._nodes(s, d).select("id", "name")
    edges = GQ._edges(s, d).select("cur", "next", "source")
    firsts = edges.where("source is not null").join(names.select(F.col("id").alias("next"), F.col("name").alias("nn")).where("nn is not null"), "next").groupBy("cur").agg(F.min(F.struct("nn", "source")).alias("f"))
    roots = table(s, d, "entity_root", F.col("id").alias("cur"), F.col("name").alias("root")).join(firsts, "cur")
    tasks = roots.select(F.col("cur").alias("episode"), F.array("root").alias("candidates"), F.array("f.source").alias("gold"))
    script = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(a).alias("action"), x.alias("arg")) for i, (a, x) in enumerate((("START", F.lit("?")), ("EDGE_SEARCH", F.col("f.nn")), ("EDGE_SEARCH", F.col("f.nn")), ("MOVE", F.col("f.nn")), ("BACKWARD", F.col("root")), ("FLY", F.lit("x")), ("STOP", F.lit("done"))))])
    actions = roots.select(F.col("cur").alias("episode"), F.explode(script).alias("x")).select("episode", "x.*")
    return actions, tasks, edges, names


def _e02(s, d):
    return E.replay(*_episodes(s, d), 7).select("episode", "step", "action", "executed", "reward")


def _e08(s, d):
    return _e02(s, d).groupBy("episode").agg(F.sum("reward").alias("total"), F.count_if("executed").alias("executed"))


def _e09(s, d):
    return E.observation(GQ._edges(s, d), GQ._nodes(s, d).where("name is not null")).select("id", F.size("relations").alias("n"), F.get("relations", 0)["neighbour"].alias("first"))


def _e10(s, d):
    o = E.observation(GQ._edges(s, d), GQ._nodes(s, d).where("name is not null"))
    x = E.rendered(F.col("relations"), F.array(F.get("relations", 0)["source"]))
    return o.select("id", F.md5(x["searchable"]).alias("searchable"), F.md5(x["forbidden"]).alias("forbidden"))


def _e01(s, d):
    tasks = qa(s, d).select("task_id")
    return E.task_draw(tasks, table(s, d, "events", F.col("event_id").alias("seed")), tasks.count(), "task_id")


def _f03(s, d):
    return PL.rewarded(qa(s, d).select("task_id", "answer", F.lower("query").alias("gold")), "exact", "answer", "gold").select("task_id", "reward")


def _f06(s, d):
    return PL.chunked(table(s, d, "eval_item", "item_id", "text"), "item_id", "text", lambda t: t.split("? ")).select("item_id", "chunk", F.length("content").alias("n"))


QUERIES = {
    "e01_task_draw": _e01,
    "f03_registered_reward": _f03,
    "f06_pluggable_chunker": _f06,
    "t01_digit_in_difference": lambda s, d: _pairs(s, d).select("id", T.digit_in_difference(F.col("a"), F.col("b")).alias("x")),
    "t02_names_alike": lambda s, d: _pairs(s, d).select("id", T.names_alike(F.col("a"), F.col("b")).alias("x")),
    "t03_entity_text": lambda s, d: table(s, d, "entity", "record_id", F.concat(F.col("name"), F.lit(" "), F.col("attributes.description")).alias("t")).distinct(),
    "t04_think_and_answer": lambda s, d: _tagged(s, d).select("task_id", T.think_and_answer(F.col("t")).alias("x")).select("task_id", "x.*"),
    "t05_world_model": _t05,
    "t06_action_parts": _t06,
    "t07_answer_normal": lambda s, d: qa(s, d).select("task_id", T.answer_normal(F.col("query")).alias("x")),
    "t08_exact_match": lambda s, d: _tagged(s, d).select("task_id", T.exact_match(T.last_tag(F.col("t")), F.col("gold")).alias("em"), T.contained_match(F.col("t"), F.col("gold")).alias("sub")),
    "t09_tag_score": lambda s, d: _tagged(s, d).select("task_id", T.tag_score(F.col("t"), F.col("gold"), 1).alias("score")),
    "t10_final_number": _t10,
    "t11_boxed": _t11,
    "t12_math_normal": _t12,
    "t15_weighted_format": lambda s, d: _tagged(s, d).select("task_id", rnd(0.9 * T.tag_score(F.col("t"), F.col("gold")) + 0.1 * F.col("t").rlike("(?s)<think>.*</think>.*").cast("double")).alias("score")),
    "t16_choice_letter": lambda s, d: table(s, d, "orders", "o_orderkey").select("o_orderkey", T.choice_letter(F.concat(F.lit("so answer:  $"), F.substr(F.lit("abcdx"), (F.col("o_orderkey") % 5 + 1).cast("int"), F.lit(1)))).alias("x")),
    "t17_tool_reward": lambda s, d: responses(s, d).select("g", "ord", rnd(T.tool_reward(F.col("s") - 25.5, F.col("len"))).alias("x")),
    "t18_overlong_penalty": lambda s, d: responses(s, d).select("g", "ord", rnd(T.overlong_penalty(F.col("len"), 45, 20)).alias("x")),
    "t19_dispatch": lambda s, d: responses(s, d).select("g", "ord", rnd(T.scored(F.col("flag"), {"A": F.col("s"), "N": -F.col("s"), "R": F.lit(0.5)})).alias("x")),
    "t20_character_count": lambda s, d: qa(s, d).select("task_id", T.character_count(F.col("query"), "e").alias("n")),
    "t21_cleaned_title": lambda s, d: qa(s, d).select("task_id", T.cleaned_title(F.concat(F.lit(" A [title] b [x] "), F.col("query"))).alias("x")),
    "t24_passages": _t24,
    "t25_path_text": lambda s, d: GQ._edges(s, d).select("key", T.path_text(F.array(F.struct("cur", "next", "source"))).alias("x")),
    "t26_text_parts": _t26,
    "t27_step_score": _t27,
    "t28_boxed_verify": lambda s, d: table(s, d, "orders", "o_orderkey").select("o_orderkey", T.math_score(F.concat(F.lit("\\boxed{"), F.col("o_orderkey").cast("string"), F.lit(".0}")), F.col("o_orderkey").cast("string")).alias("score")),
    "t29_answer_cascade": lambda s, d: qa(s, d).where("answer is not null").select("task_id", T.answer_cascade(F.concat(F.lit("<tool_response>r</tool_response> <b>"), F.regexp_replace("answer", "[<>]", ""), F.lit("</b> end"))).alias("x"), T.balanced_tags(F.lit("<think></think><answer>")).alias("ok")),
    "t30_point_reward": lambda s, d: _boxes(s, d).select("o_orderkey", rnd(T.ranked_point_reward(F.col("p"), F.col("b"))).alias("x")),
    "t31_three_in_line": lambda s, d: _boxes(s, d).select("o_orderkey", T.any_three_in_line(F.col("p")).alias("x")),
    "t32_transcript": _t32,
    "t33_sized_box": lambda s, d: _boxes(s, d).select("o_orderkey", F.array_join(T.sized_box(F.col("b"), 80, 60, 40), ",").alias("x")),
    "js01_parsed": _js01,
    "js02_closed": lambda s, d: table(s, d, "events", "event_id", F.expr("left(props, length(props) - 1)").alias("t")).select("event_id", F.get_json_object(J.parsed_column(F.col("t")), "$.k").cast("int").alias("k")),
    "js03_listed": lambda s, d: qa(s, d).select("task_id", F.array_join(J.listed(F.col("gt_sources")), "|").alias("sources"), F.array_join(J.wrapped(F.col("start_candidates")), "|").alias("starts")),
    "js05_verdicts": lambda s, d: table(s, d, "events", "event_id").select("event_id", J.verdicts(F.concat(F.lit('{"Pair 1": "'), F.when(F.col("event_id") % 2 == 0, F.lit(" YES ")).otherwise(F.lit("no")), F.lit('"}')), F.lit(1)).alias("yes")),
    "x13_differencing": _x13,
    "x14_greedy": _x14,
    "x15_imbalance": lambda s, d: X.imbalance(_x13(s, d), "batch", "row", "len", 4),
    "x16_micro_batches": lambda s, d: X.micro_batches(responses(s, d).select((F.col("g") / 100).cast("bigint").alias("batch"), "len"), "batch", "len", 300),
    "x16_workload": lambda s, d: responses(s, d).select("g", "ord", X.workload(F.col("len")).alias("w")),
    "x18_zigzag": lambda s, d: X.zigzag(responses(s, d).select("g", "ord", "len"), "g", "len", "ord").select("g", "ord", "place"),
    "x19_token_chunks": lambda s, d: X.token_chunks(table(s, d, "documents", "doc_id", "text"), "doc_id", "text", 96, 16).select("doc_id", "chunk", "start", F.md5("content").alias("digest")),
    "x20_media_parts": _x20,
    "x23_shuffled_options": _x23,
    "f10_preference_rows": _f10b,
    "f10_sample_rows": _f10,
    "e02_replay": _e02,
    "e08_episode_totals": _e08,
    "e09_observation": _e09,
    "e10_rendered": _e10,
    "s06_file_kinds": lambda s, d: table(s, d, "chart_entry", "ori_id", F.explode("image_paths").alias("p")).distinct().select("ori_id", "p", S.is_image(F.col("p")).alias("image"), S.is_text(F.col("p")).alias("text")),
    "s08_task_columns": lambda s, d: S.task_columns(qa(s, d)).select("task_id", F.size("gt_sources").alias("n"), F.size("start_candidates").alias("starts")),
    "k08_flattened": lambda s, d: S.flattened(table(s, d, "relation", "id", "attributes").distinct()).select("id", F.col("attributes/description").alias("description"), F.col("attributes/chunk_id").alias("chunk_id")),
    "k09_generation_sample": lambda s, d: qa(s, d).orderBy(F.pmod(F.col("task_id") * 2654435761 + 42, F.lit(4294967296)), "task_id").limit(50).select("task_id"),
}


def _q(body):
    return f"WITH {QA} {body}"


_BG = "list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)))"
_X, _Y = _BG.format(x="a"), _BG.format(x="b")
_DIFF = f"len(list_filter(list_concat(list_filter({_X}, lambda p: NOT list_contains({_Y}, p)), list_filter({_Y}, lambda p: NOT list_contains({_X}, p))), lambda p: regexp_matches(p, '[0-9]'))) > 0"
_CA, _CB = "list_distinct(string_split(a, ''))", "list_distinct(string_split(b, ''))"
_LAST = r"trim(list_last(regexp_extract_all(t, '(?s)<answer>(.*?)</answer>', 1)), ' ')"
_K = "o_orderkey"
_PTS = f"bx AS (SELECT {_K}, list_transform([3, 11, 29], lambda m: CAST({_K} * m % 100 AS DOUBLE)) AS px, list_transform([3, 11, 29], lambda m: CAST({_K} * m * 7 % 90 AS DOUBLE)) AS py, {_K} % 50 AS x1, {_K} % 40 AS y1, {_K} % 50 + 30 AS x2, {_K} % 40 + 25 AS y2 FROM orders)"
_EP = f"""{GQ.EDGES}, nm AS (SELECT id, name FROM nd WHERE name IS NOT NULL), fe AS (SELECT cur, min({{'nn': nm.name, 'source': source}}) AS f FROM ed JOIN nm ON nm.id = next WHERE source IS NOT NULL GROUP BY cur),
    rt AS (SELECT r.id AS episode, r.name AS root, f.nn AS nn, f.source AS gold FROM entity_root r JOIN fe ON cur = r.id)"""


def _side(lo, hi, most):
    l, h = f"greatest({lo}, 0)", f"least({hi}, {most})"
    low = f"greatest(0, least({l} - greatest(0, 40 - ({h} - {l})) // 2, {most} - 40))"
    return low, f"least({most}, greatest({h}, {low} + 40))"


_B1, _B3 = _side("x1", "x2", 80)
_B2, _B4 = _side("y1", "y2", 60)

SQL = {
    "e01_task_draw": _q(", t AS (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS p, count(*) OVER () AS n FROM qa) SELECT event_id AS seed, task_id FROM events JOIN t ON p = event_id * 2654435761 % n"),
    "f06_pluggable_chunker": "SELECT item_id, CAST(i - 1 AS INTEGER) AS chunk, CAST(length(p[i]) AS INTEGER) AS n FROM (SELECT item_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT item_id, string_split(text, '? ') AS p FROM eval_item))",
    "t01_digit_in_difference": f"WITH {_PAIRS} SELECT id, {_DIFF} AS x FROM pr",
    "t02_names_alike": f"""WITH {_PAIRS}, c AS (SELECT *, greatest(len({_CA}), len({_CB})) AS m, len(list_filter({_CA}, lambda p: list_contains({_CB}, p))) AS k FROM pr)
        SELECT id, NOT ({_DIFF}) AND (levenshtein(a, b) <= least(length(a), length(b)) // 2 OR CASE WHEN m < 4 THEN k > 1 ELSE k / m >= 0.8 END) AS x FROM c""",
    "t03_entity_text": "SELECT DISTINCT record_id, name || ' ' || attributes.description AS t FROM entity",
    "t04_think_and_answer": rf"WITH {_TAGGED} SELECT task_id, regexp_extract(t, '(?s)^(.*?)\s*<answer>(.*?)</answer>', 1) AS thought, trim(regexp_extract(t, '(?s)^(.*?)\s*<answer>(.*?)</answer>', 2), ' ') AS answer FROM tg",
    "t05_world_model": _q(f"""SELECT task_id, task_id % 4 > 1 AS format_correct, CASE WHEN task_id % 4 > 1 THEN 'o' ELSE '' END AS observation, CASE WHEN task_id % 4 > 1 THEN 'p' ELSE '' END AS prediction,
        CASE WHEN task_id % 4 > 1 THEN {_STRIP.format(x="coalesce(gt_sources, '')")} ELSE '' END AS think, CASE WHEN task_id % 4 > 1 THEN array_to_string(a[1 : 3], '|') ELSE '' END AS actions,
        CASE WHEN task_id % 4 < 2 THEN '' WHEN len(a) > 3 THEN array_to_string(a[1 : 3], ',') ELSE {_STRIP.format(x="b")} END AS answer
        FROM (SELECT *, list_filter(list_transform(string_split(b, ','), lambda v: lower({_STRIP.format(x="v")})), lambda v: v <> '') AS a
              FROM (SELECT *, regexp_replace(coalesce(answer, ''), '[<>]', '', 'g') || ' , UP,,Left a' AS b FROM qa))"""),
    "t06_action_parts": "SELECT event_id, upper(event_type[1]) || lower(event_type[2:]) AS verb, CASE event_id % 5 WHEN 0 THEN 'New   York 3' WHEN 1 THEN NULL WHEN 2 THEN '7x' ELSE CAST(event_id AS VARCHAR) END AS arg, CAST(CASE WHEN event_id % 5 > 2 THEN event_id END AS INTEGER) AS number FROM events",
    "t07_answer_normal": _q(f"SELECT task_id, {_n('query')} AS x FROM qa"),
    "t08_exact_match": f"WITH {_TAGGED} SELECT task_id, {_n(_LAST)} = {_n('gold')} AS em, contains({_n('t')}, {_n('gold')}) AS sub FROM tg",
    "t09_tag_score": f"WITH {_TAGGED} SELECT task_id, CASE WHEN {_n(_LAST)} = {_n('gold')} THEN CASE WHEN len(regexp_extract_all(t, '<answer>')) > 1 THEN 0.25 ELSE 1.0 END ELSE 0.0 END::DOUBLE AS score FROM tg",
    "t10_final_number": _q(r"""SELECT task_id, replace(replace(list_last(regexp_extract_all(right(answer || ' #### 1,0' || task_id, 300), '#### (-?[0-9.,]+)', 1)), ',', ''), '$', '') AS strict,
        coalesce(list_last(list_filter(regexp_extract_all(right(answer, 300), '(-?[0-9.,]+)', 1), lambda x: x <> '' AND x <> '.')), regexp_extract_all(right(answer, 300), '(-?[0-9.,]+)', 1)[1]) AS flexible FROM qa WHERE answer IS NOT NULL"""),
    "t11_boxed": r"SELECT o_orderkey, '\frac{1}{' || o_orderkey || '}' AS x FROM orders",
    "t12_math_normal": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM orders",
    "t15_weighted_format": f"WITH {_TAGGED} SELECT task_id, {r(f'0.9 * CASE WHEN {_n(_LAST)} = {_n("gold")} THEN 1.0 ELSE 0.0 END + 0.1')} AS score FROM tg",
    "t16_choice_letter": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN substr('ABCD', CAST(o_orderkey % 5 + 1 AS INTEGER), 1) ELSE '' END AS x FROM orders",
    "t17_tool_reward": f"WITH {RESPONSES} SELECT g, ord, {r('CASE WHEN s - 25.5 < 0 THEN least(-0.6, s - 25.5 + (len - 2) / 2 * 0.1) ELSE s - 25.5 END')} AS x FROM sc",
    "t18_overlong_penalty": f"WITH {RESPONSES} SELECT g, ord, {r('least(-(len - 25) / 20 * 1.0, 0)')} AS x FROM sc",
    "t19_dispatch": f"WITH {RESPONSES} SELECT g, ord, {r('''CASE flag WHEN 'A' THEN s WHEN 'N' THEN -s ELSE 0.5 END''')} AS x FROM sc",
    "t20_character_count": _q("SELECT task_id, CAST(length(query) - length(replace(query, 'e', '')) AS INTEGER) AS n FROM qa"),
    "t21_cleaned_title": _q(r"SELECT task_id, replace(regexp_replace(replace(trim(' A [title] b [x] ' || query, ' '), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS x FROM qa"),
    "t24_passages": "SELECT item_id, 'Doc 1 (Title: T' || item_id || ') ' || text || chr(10) || 'Doc 2 (Title: ' || text || ') ' AS t FROM eval_item",
    "t25_path_text": f"WITH {GQ.EDGES} SELECT key, cur || ' -> ' || next || coalesce(' [' || source || ']', '') AS x FROM ed",
    "t26_text_parts": _q("SELECT task_id, coalesce(query, '') || '!' AS t FROM qa"),
    "t27_step_score": f"""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 9 - 1 END AS p, o_orderkey % 7 - 1 AS g FROM orders)
        SELECT o_orderkey, {r('CASE WHEN p IS NULL OR p >= 8 THEN -1.0 WHEN p = g THEN 1.0 WHEN p = -1 OR g = -1 THEN -1.0 ELSE 1 - abs(p - g) / 8 END')} AS score FROM x""",
    "t28_boxed_verify": "SELECT o_orderkey, 1.0::DOUBLE AS score FROM orders",
    "t29_answer_cascade": _q(r"SELECT task_id, trim(regexp_replace(answer, '[<>]', '', 'g') || ' end', ' ') AS x, FALSE AS ok FROM qa WHERE answer IS NOT NULL"),
    "t30_point_reward": f"""WITH {_PTS}, k AS (SELECT {_K}, list_position(list_transform([1, 2, 3], lambda i: px[i] >= x1 AND px[i] <= x2 AND py[i] >= y1 AND py[i] <= y2), TRUE) AS k FROM bx)
        SELECT {_K}, {r('CASE WHEN coalesce(k, 0) > 0 THEN 1 / sqrt(3 * k) ELSE -1.0 / 3 END')} AS x FROM k""",
    "t31_three_in_line": f"WITH {_PTS} SELECT {_K}, (px[2] - px[1]) * (py[3] - py[1]) - (py[2] - py[1]) * (px[3] - px[1]) = 0 AS x FROM bx",
    "t32_transcript": _q("SELECT task_id, CAST(3 AS INTEGER) AS n, 'interpreter' AS kind, 'z' AS last FROM qa"),
    "t33_sized_box": f"WITH {_PTS} SELECT {_K}, concat_ws(',', {_B1}, {_B2}, {_B3}, {_B4}) AS x FROM bx",
    "js01_parsed": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events",
    "js02_closed": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "js03_listed": _q(r"""SELECT task_id, array_to_string(list_filter(list_transform(CASE WHEN starts_with(trim(gt_sources, ' '), '[') THEN CAST(json_extract_string(gt_sources, '$[*]') AS VARCHAR[]) ELSE string_split(gt_sources, ',') END, lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS sources,
        coalesce(array_to_string(CASE WHEN starts_with(trim(start_candidates, ' '), '[') THEN CAST(json_extract_string(start_candidates, '$[*]') AS VARCHAR[]) ELSE [trim(start_candidates, ' ')] END, '|'), '') AS starts FROM qa"""),
    "js05_verdicts": "SELECT event_id, event_id % 2 = 0 AS yes FROM events",
    "x16_micro_batches": f"WITH {RESPONSES} SELECT g // 100 AS batch, CAST(ceil(sum(len) / 300) AS BIGINT) AS n FROM sc GROUP BY 1",
    "x16_workload": f"WITH {RESPONSES} SELECT g, ord, 24576 * len + len * len AS w FROM sc",
    "x18_zigzag": f"""WITH {RESPONSES}, i AS (SELECT g, ord, row_number() OVER (PARTITION BY g ORDER BY len, ord) - 1 AS i, (count(*) OVER (PARTITION BY g) + 1) // 2 AS h FROM sc)
        SELECT g, ord, CAST(CASE WHEN i % 2 = 0 THEN h - 1 - i // 2 ELSE h + (i - 1) // 2 END AS INTEGER) AS place FROM i""",
    "x19_token_chunks": r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\x0b]+'), lambda x: x <> '') AS t FROM documents),
        c AS (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 16 - 1, 0) + 1, 80)) AS start FROM t WHERE len(t) > 0)
        SELECT doc_id, CAST(start // 80 AS INTEGER) AS chunk, CAST(start AS INTEGER) AS start, md5(array_to_string(t[start + 1 : start + 96], ' ')) AS digest FROM c""",
    "x20_media_parts": _q("SELECT task_id, CAST(5 AS INTEGER) AS n, 'text,image,text,video,text' AS kinds FROM qa"),
    "x23_shuffled_options": """WITH x AS (SELECT o_orderkey, i, (CAST(o_orderkey AS HUGEINT) * 7919 + i * 104729 + 3) * 2654435761 % 4294967296 AS k FROM orders, (SELECT unnest([1, 2, 3, 4]) AS i)),
        y AS (SELECT o_orderkey, string_agg(substr('wxyz', i, 1), '' ORDER BY k) AS options FROM x GROUP BY o_orderkey) SELECT o_orderkey, options, substr('ABCD', CAST(instr(options, 'w') AS INTEGER), 1) AS gold FROM y""",
    "f10_preference_rows": _q("SELECT task_id, 'chosen' AS kind, query AS response FROM qa UNION ALL SELECT task_id, 'rejected', answer FROM qa"),
    "f10_sample_rows": _q("SELECT task_id, 'chart_facts' AS data_source, query || ' Answer:' AS content, 'facts' AS ability, answer AS ground_truth FROM qa"),
    "e02_replay": f"""WITH {_EP} SELECT episode, CAST(step AS INTEGER) AS step, action, action <> 'FLY' AS executed, CAST(reward AS DOUBLE) AS reward FROM rt,
        (VALUES (0, 'START', 0.0), (1, 'EDGE_SEARCH', 7.0), (2, 'EDGE_SEARCH', 4.0), (3, 'MOVE', 7.0), (4, 'BACKWARD', 5.0), (5, 'FLY', 4.0), (6, 'STOP', 5.0)) a(step, action, reward)""",
    "e08_episode_totals": f"WITH {_EP} SELECT episode, 32.0::DOUBLE AS total, CAST(6 AS BIGINT) AS executed FROM rt",
    "e09_observation": f"WITH {GQ.EDGES}, o AS (SELECT cur, nd.name, row_number() OVER (PARTITION BY cur ORDER BY nd.name, key) AS k FROM ed JOIN nd ON nd.id = next WHERE nd.name IS NOT NULL) SELECT cur AS id, CAST(count(*) AS INTEGER) AS n, min(name) AS first FROM o GROUP BY cur",
    "e10_rendered": f"""WITH {GQ.EDGES}, o AS (SELECT cur, nd.name AS n, move, source FROM ed JOIN nd ON nd.id = next WHERE nd.name IS NOT NULL),
        p AS (SELECT *, first_value(source) OVER (PARTITION BY cur ORDER BY n, move, source NULLS FIRST) AS s0 FROM o)
        SELECT cur AS id, md5(coalesce(string_agg(n, '; ' ORDER BY n, move, source NULLS FIRST) FILTER (s0 IS NULL OR source IS NULL OR source <> s0), '')) AS searchable,
               md5(coalesce(string_agg(n, '; ' ORDER BY n, move, source NULLS FIRST) FILTER (source = s0), '')) AS forbidden FROM p GROUP BY cur""",
    "s06_file_kinds": "SELECT ori_id, p, regexp_matches(lower(p), '\\.(png|jpg|jpeg|gif|bmp)$') AS image, regexp_matches(lower(p), '\\.txt$') AS text FROM (SELECT DISTINCT ori_id, unnest(image_paths) AS p FROM chart_entry) WHERE p IS NOT NULL".replace("\\\\", "\\"),
    "s08_task_columns": _q("SELECT task_id, CAST(CASE WHEN gt_sources IS NULL THEN 0 WHEN starts_with(gt_sources, '[') THEN json_array_length(gt_sources) ELSE len(string_split(gt_sources, ',')) END AS INTEGER) AS n, CAST(CASE WHEN start_candidates IS NULL THEN 0 WHEN starts_with(start_candidates, '[') THEN json_array_length(start_candidates) ELSE 1 END AS INTEGER) AS starts FROM qa"),
    "k08_flattened": "SELECT DISTINCT id, attributes.description AS description, attributes.chunk_id AS chunk_id FROM relation",
    "k09_generation_sample": _q("SELECT task_id FROM qa ORDER BY (task_id * 2654435761 + 42) % 4294967296, task_id LIMIT 50"),
}
