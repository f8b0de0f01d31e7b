"""Keys and groups as larger tables have them."""

import random
import time

from latticework.operators import graph as G
from latticework.operators import partition as X
from latticework.plans import graph_queries as Q
from pyspark.sql import functions as F


def test_shuffled_options_of_any_key(spark):
    def want(key):
        products = [(key * 7919 + i * 104729 + 3) * 2654435761 for i in range(1, 5)]
        rest = [abs(x) % 2**32 * (-1 if x < 0 else 1) for x in products]
        return "".join(o for _, o in sorted(zip(rest, "wxyz", strict=True)))

    keys = [0, 1, -14, -30, -52, -53, 438_000, 440_000, 8_999_999, 10**12, -(10**12), 2**40, -(2**40), 2**63 - 1, -(2**63)]
    options = X.shuffled_options(F.array(*map(F.lit, "wxyz")), F.col("k"))
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", F.array_join(options, "").alias("o")).collect()
    assert {r.k: r.o for r in got} == {k: want(k) for k in keys}


def test_difficulty_equals_brute_force(spark):
    random.seed(4)
    some = lambda n: [random.choice(["chart_1", "chart_2", "p_1", "p_2", "p_3", "p_4", None]) for _ in range(random.randint(0, n))]
    rows = [(i, [[(x,) for x in some(6)] for _ in range(random.randint(0, 3))], some(4), random.choice([0, 2, 9])) for i in range(200)]
    rows += [(200, None, ["chart_1"], 1), (201, [None, [("chart_1",)]], ["chart_1"], 1)]

    def want(paths, used, rated):
        far = [b.index((u,)) + 1 for b in paths or [] if b for u in used if u is not None and (u,) in b]
        return sum(u is not None and "chart" in u for u in used) + max(far, default=0) + min(max(rated, 1), 3)

    df = spark.createDataFrame(rows, "i int, paths array<array<struct<source:string>>>, used array<string>, rated int")
    got = {r.i: r.d for r in df.select("i", G.difficulty(F.col("paths"), F.col("used"), F.col("rated")).alias("d")).collect()}
    assert got == {i: want(*r) for i, *r in rows}


def test_difficulty_of_a_hub(spark):
    """50,000 sources of one node; a search of the path for each of them took 135 s."""
    n = 50_000
    whole = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.format_string("chart_%06d", x))
    df = spark.range(1).select(whole.alias("all")).cache()
    df.count()
    began = time.monotonic()
    path = F.transform("all", lambda x: F.struct(x.alias("source")))
    got = df.select(G.difficulty(F.array(path), F.filter("all", lambda x, i: i % 2 == 0), F.size("all")).alias("d")).first().d
    assert got == n // 2 + n - 1 + 3 and time.monotonic() - began < 20


def _alike(a, b):
    digits = lambda s: {s[i : i + 2] for i in range(len(s) - 1) if any(c in "0123456789" for c in s[i : i + 2])}
    x, y = set(a.split()), set(b.split())
    if digits(a) != digits(b) or len(x & y) < 0.6 * len(x | y) - 1e-9:
        return False
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        last = row
        row = [i + 1]
        for j, d in enumerate(b):
            row.append(min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1))
    common, most = len({*a} & {*b}), max(len({*a}), len({*b}))
    return row[-1] <= min(len(a), len(b)) // 2 or (common > 1 if most < 4 else common / most >= 0.8)


def test_resolution_equals_brute_force_in_any_number_of_turns(spark):
    rng = random.Random(5)
    short = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(5)]
    far = ["".join(chr(rng.randint(97, 122)) for _ in range(9)) for _ in range(40)] + ["q" * 30, "jkvwxyz" * 6]
    names = [f"{x} of the {y}" for x in far for y in ("up", "panel 7")] + [" ".join(rng.choices(short, k=rng.randint(1, 12))) + rng.choice(["", " 1", " 12"]) for _ in range(150)]
    first = {}
    for i, name in enumerate(names):
        first.setdefault(name, i)
    label = list(range(len(names)))
    pairs = [(i, first[n]) for i, n in enumerate(names) if first[n] != i]
    pairs += [(i, j) for a, i in first.items() for b, j in first.items() if i < j and _alike(a, b)]
    for _ in names:
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    want = {i: label[i] for p in pairs for i in p}
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    for turns in (0, 8):
        assert {r.node: r.component for r in G.components(Q.resolved(df, most_turns=turns)).collect()} == want


def test_resolution_of_one_template_makes_few_links(spark):
    """400 names of three words in common are 79,800 similar pairs; as many links were made."""
    names = [(i, "".join(chr(97 + (i // 20**k) % 20) for k in range(4)) + " institute of health") for i in range(400)]
    links = Q.resolved(spark.createDataFrame(names, "id bigint, name string"))
    assert links.count() < 1000
    assert {r.component for r in G.components(links).collect()} == {0}
