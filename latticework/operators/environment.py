"""Replay of navigation episodes over the graph, one join per step for all episodes at once.

An episode's state is a row: where it is, what it has visited and revealed, and whether it has stopped. Step k joins all
states with the actions of step k and with the out-edges of the place each is at, so the graph is never broadcast.
Arrays in the state are bounded by the number of steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.text import answer_normal, world_model
from latticework.session import materialize

C = F.col

# Rewards.
ILLEGAL, STEP, RETRIEVE, MOVED, SUCCESS = -1.0, 0.0, 2.0, 2.0, 5.0


def task_draw(tasks: DataFrame, seeds: DataFrame, n: int, order: str) -> DataFrame:
    """(seed, ...): the task of each seed, by its remainder."""
    from latticework.operators.batch import with_position

    return seeds.withColumn("_p", F.pmod(C("seed").cast("bigint") * 2654435761, F.lit(n))).join(with_position(tasks, order, name="_p"), "_p").drop("_p")


def replay(actions: DataFrame, tasks: DataFrame, edges: DataFrame, names: DataFrame, steps: int) -> DataFrame:
    """(episode, step, action, executed, reward, current, revealed): the replay of ``steps`` steps.

    ``actions`` has (episode, step, action, arg), ``tasks`` (episode, candidates, gold), ``edges`` (cur, next, source),
    ``names`` (id, name). Actions: START name, EDGE_SEARCH neighbour, MOVE neighbour, BACKWARD name, STOP answer; others
    are illegal. START takes a candidate name, or the first candidate; a search reveals the edge's source and pays once
    for a gold one, any other search costs 1; a move reveals and pays; every step at which all gold sources are revealed
    pays the success again. Nothing is executed after STOP.

    If ``actions`` has an integer column ``number``, MOVE takes the neighbour of that number modulo the neighbours, in order of name,
    and without number and name a pseudo-random one. STOP needs an answer. If ``tasks`` has the column ``answer``, the last
    answer is judged by the exact match of normalised texts once all gold sources are revealed, pays the success when right, and
    ``answered`` tells so.
    """
    strings = F.array().cast("array<string>")
    numbered, judged = "number" in actions.columns, "answer" in tasks.columns
    number = C("number") if numbered else F.lit(None).cast("int").alias("number")
    actions = materialize(actions.select("episode", "step", "action", "arg", number), "actions")
    names = materialize(names.select("id", "name"), "names")
    named = materialize(names.where("name is not null").groupBy("name").agg(F.min("id").alias("to_id")), "names")
    one = edges.join(names.select(C("id").alias("next"), C("name").alias("next_name")), "next").groupBy("cur", "next_name").agg(F.min(F.struct("next", "source")).alias("edge"))
    one = materialize(one, "edges")
    if numbered:
        by_name = Window.partitionBy("cur").orderBy("next_name")
        places = materialize(one.withColumn("place", (F.row_number().over(by_name) - 1).cast("long")), "places")
        fans = materialize(one.groupBy(C("cur").alias("current")).agg(F.count(F.lit(1)).alias("fan")), "fans")
    answers = tasks.select("episode", "answer" if judged else F.lit(None).cast("string").alias("answer"))
    state = tasks.select("episode", "candidates", F.array_distinct(F.coalesce("gold", strings)).alias("gold"), F.lit(None).cast("string").alias("current"), strings.alias("visited"), strings.alias("revealed"), F.lit(False).alias("stopped"))
    log = None
    for k in range(steps):
        a = actions.where(C("step") == k).select("episode", C("action").alias("act"), "arg", "number")
        s = state.join(a, "episode", "left")
        if numbered:
            drawn = F.coalesce(C("number").cast("long"), F.pmod(F.xxhash64("episode", F.lit(k)), F.lit(1 << 30)))
            by_place = (C("act") == "MOVE") & (C("number").isNotNull() | C("arg").isNull())
            s = s.join(fans, "current", "left").withColumn("place", F.when(by_place, F.pmod(drawn, C("fan"))))
            s = s.join(places.select(C("cur").alias("current"), "place", C("next_name").alias("there")), ["current", "place"], "left")
            s = s.withColumn("arg", F.when(by_place, C("there")).otherwise(C("arg"))).drop("fan", "place", "there")
        s = s.withColumn("start_name", F.when(F.array_contains("candidates", C("arg")), C("arg")).otherwise(F.get("candidates", 0)))
        s = s.join(named.select(C("name").alias("start_name"), C("to_id").alias("start_id")), "start_name", "left")
        s = s.join(named.select(C("name").alias("arg"), C("to_id").alias("back_id")), "arg", "left")
        s = s.join(one.select(C("cur").alias("current"), C("next_name").alias("arg"), "edge"), ["current", "arg"], "left")
        live = ~C("stopped") & C("act").isNotNull()
        start = live & (C("act") == "START") & C("start_id").isNotNull()
        search = live & (C("act") == "EDGE_SEARCH") & C("edge.source").isNotNull()
        move = live & (C("act") == "MOVE") & C("edge.next").isNotNull()
        back = live & (C("act") == "BACKWARD") & F.array_contains("visited", C("back_id"))
        stop = live & (C("act") == "STOP") & C("arg").isNotNull()
        fresh = search & F.array_contains("gold", C("edge.source")) & ~F.array_contains("revealed", C("edge.source"))
        yes = lambda c: F.coalesce(c, F.lit(False))
        start, search, move, back, stop, fresh = map(yes, (start, search, move, back, stop, fresh))
        done = start | search | move | back | stop
        paid = (
            F.when(start, 0.0).when(fresh, STEP + RETRIEVE).when(search, STEP + ILLEGAL).when(move, STEP + MOVED).when(back | stop, STEP)
            .when(yes(live & (C("act") == "EDGE_SEARCH")), 2 * ILLEGAL).otherwise(ILLEGAL)
        )
        seen = F.when(search | move, F.array_distinct(F.array_append("revealed", C("edge.source")))).otherwise(C("revealed"))
        s = s.withColumns({
            "executed": done,
            "now": F.when(start, C("start_id")).when(move, C("edge.next")).when(back, C("back_id")).otherwise(C("current")),
            "shown": F.filter(seen, lambda x: x.isNotNull()),
        })
        s = s.withColumn("success", F.size(F.array_except("gold", "shown")) == 0)
        s = s.withColumn("reward", F.when(C("act").isNotNull(), paid + F.when(C("success"), SUCCESS).otherwise(0.0)))
        if judged:
            s = s.join(answers, "episode", "left")
            s = s.withColumn("answered", yes(stop & C("success") & (answer_normal(C("arg")) == answer_normal(C("answer")))))
            s = s.withColumn("reward", C("reward") + F.when(C("answered"), SUCCESS).otherwise(0.0)).drop("answer")
        s = s.withColumn("been", F.when(C("executed") & C("now").isNotNull(), F.array_distinct(F.array_append("visited", C("now")))).otherwise(C("visited")))
        s = materialize(s.withColumn("ended", C("stopped") | stop), "step")
        rows = s.where("act is not null").select("episode", F.lit(k).alias("step"), C("act").alias("action"), "executed", "reward", C("now").alias("current"), F.size("shown").alias("revealed"), *(["answered"] if judged else []))
        log = rows if log is None else log.unionByName(rows)
        state = s.select("episode", "candidates", "gold", C("now").alias("current"), C("been").alias("visited"), C("shown").alias("revealed"), C("ended").alias("stopped"))
    return log


def observation(edges: DataFrame, names: DataFrame, most: int | None = None) -> DataFrame:
    """(id, relations): what can be seen from each node, every (neighbour, move, source) in order of name.

    With ``most`` the list is cut to what a prompt can show, by a grouped top-k before it is collected.
    """
    rows = edges.join(names.select(C("id").alias("next"), C("name").alias("neighbour")), "next")
    if most is not None:
        place = F.row_number().over(Window.partitionBy("cur").orderBy("neighbour", "key"))
        rows = rows.withColumn("_r", place).where(C("_r") <= most)
    return rows.groupBy(C("cur").alias("id")).agg(F.array_sort(F.collect_list(F.struct("neighbour", "move", "source"))).alias("relations"))


def rendered(relations: Column, revealed: Column) -> Column:
    """(searchable, forbidden): neighbours whose source is still hidden, and those already revealed, joined."""
    hidden = lambda x: ~F.coalesce(F.array_contains(revealed, x["source"]), F.lit(False))
    names = lambda rs: F.array_join(F.transform(rs, lambda x: x["neighbour"]), "; ")
    return F.struct(names(F.filter(relations, hidden)).alias("searchable"), names(F.filter(relations, lambda x: ~hidden(x))).alias("forbidden"))


def turn_record(replies: DataFrame, log: DataFrame, limit: int, longest: int, format_reward: float = 0.5) -> DataFrame:
    """One row per turn of ``replies`` (episode, step, reply) beside the replay's ``log``: ``valid`` (the reply names an action),
    ``effective`` (it was executed), ``formatted`` (valid, in the whole format), ``reward`` with the format's own, ``done`` and ``last``.

    A turn is the last if the episode stops at it, at turn ``limit``, or if its reply has more than ``longest`` characters. A
    turn without a log row failed: its reward is 0 and it ends the episode.
    """
    said = world_model(C("reply"))
    rows = replies.select("episode", "step", "reply", F.size(said["actions"]).alias("_n"), said["format_correct"].alias("_f"))
    rows = rows.join(log.select("episode", "step", "action", "executed", C("reward").alias("_r")), ["episode", "step"], "left")
    failed = C("_r").isNull()
    valid = (C("_n") > 0) & ~failed
    formatted = valid & C("_f")
    done = failed | ((C("action") == "STOP") & C("executed"))
    return rows.select(
        "episode", "step", valid.alias("valid"), F.coalesce("executed", F.lit(False)).alias("effective"), formatted.alias("formatted"),
        F.when(failed, 0.0).otherwise(C("_r") + F.when(formatted, format_reward).otherwise(0.0)).alias("reward"),
        done.alias("done"), (done | (C("step") + 1 >= limit) | (F.length("reply") > longest)).alias("last"),
    )
