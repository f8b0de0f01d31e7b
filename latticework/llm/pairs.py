"""Broken prompt and response pairs, each with the kind of its defect.

Refusals are found by what makes them boilerplate: the openings of their clauses recur across unrelated prompts, carry
nothing of the prompt, and stand in answers that hold no data and no bare answer. Openings are clustered by MinHash with
verified similarity and the recurrence of a whole cluster counts, in any language and wording. The other kinds follow from
checks of the pair alone: emptiness, copying, language and termination.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.graph import components
from latticework.session import materialize

#: Words of an opening (of Chinese, characters), and the least number that an opening has at all.
OPENING_WORDS, LEAST_WORDS = 5, 3
OPENING_HAN, LEAST_HAN = 10, 6

#: Least similarity of two openings of a cluster, by their character 4-grams.
SIMILARITY = 0.8

#: MinHash: bands of rows. Two openings of that similarity meet in no band with a chance of 1e-7.
BANDS, ROWS = 40, 5

#: Prompts across which the openings of a cluster must recur, and the least share of their answers that say nothing else.
RECURS, SHARE = 5, 0.8

# Fixed values -------------------------------------------------------------------------------------------------------

#: Contents that stand for no answer (lower case, without wrapping).
PLACEHOLDERS = frozenset(
    "na n/a #n/a n.a. nan null nil tbd todo blank empty missing undefined no answer (no answer) <blank> answer a response none given "
    "no response not available".split()
    + ["no answer", "(no answer)", "<no answer>", "no response", "not available", "<blank>", "<empty>", "[blank]", "[empty]", "none given", "not answered"]
) - {"no", "not", "given", "(no", "answer)", "none"}

#: Common words by language, enough to tell sentences apart.
LANGUAGE_WORDS = {
    "en": "the of and in is are was were that does did do has have had what which whose who how when on between for more by from than a an at to as not with while both they it its their there this or but would yes neither none above below less whether too so before after about into over some most",
    "es": "el la los las de del que en es y más menos una un por con según entre sí no para al se su sus lo como pero fue son está porque cuando qué cuál mayor cada",
    "fr": "le la les l d des du de que qui est sont et plus moins une un par dans pour selon oui non sur à au aux se sa ses pas car elle il ne ce cette avec contre chez était",
    "de": "der die das den dem des und ist sind in im von vom zu zum zur dass mehr weniger als ein eine einer einem für nicht laut ja nein mit auf bei sich wird werden hat haben denn etwa gegenüber wie was ich kann",
    "it": "il lo gli di del della delle dei che è più meno una un per con secondo tra sì non sono nel nella al alla si suo sua come ma perché quando quale anche",
    "pt": "os da dos das que em é mais menos uma um por com segundo entre sim não são na nas ao sua como mas porque quando qual também",
    "nl": "de het een van en in is zijn dat die op te met voor niet als meer minder dan volgens tussen ja nee ook maar omdat wanneer welke bij wordt",
}
_WORDS_OF = {k: frozenset(v.split()) for k, v in LANGUAGE_WORDS.items()}
_COMMON = frozenset().union(*(_WORDS_OF[k] for k in ("en", "es", "fr", "de")))
#: Scripts that tell a language.
SCRIPTS = {"ja": "ぁ-ヿ", "ko": "가-힣", "ru": "Ѐ-ӿ", "el": "Ͱ-Ͽ", "ar": "؀-ۿ", "he": "֐-׿", "hi": "ऀ-ॿ", "th": "฀-๿"}
_SCRIPTS = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
_OTHER_SCRIPT = re.compile(f"[{''.join(SCRIPTS.values())}]")
_SPOKEN_IN = {w: tuple(k for k, known in _WORDS_OF.items() if w in known) for w in frozenset().union(*_WORDS_OF.values())}
#: Answers of one word that belong to one language.
YES_NO = {"sí": "es", "oui": "fr", "non": "fr", "ja": "de", "nein": "de", "yes": "en", "是": "zh", "否": "zh", "是的": "zh", "不是": "zh"}

#: Openings of refusals that are known beforehand. They stand for clusters that recur, so that small tables are served too;
#: with none of them (``known=()``) clusters must show by recurring alone.
KNOWN = (
    "i cannot answer this question", "i can't answer that", "i cannot help with that", "i can't help with that", "i am unable to assist", "i'm unable to help with",
    "i'm not able to provide", "i am not able to answer", "i won't be able to", "i must decline to answer", "i have to pass on", "i don't feel comfortable answering",
    "i would rather not say", "as an ai language model", "my guidelines do not let", "i am not permitted to", "it would not be appropriate",
    "no puedo responder a esta", "no puedo contestar", "no puedo ayudar con eso", "lamento no poder ayudar con", "no me está permitido responder", "prefiero no opinar sobre este", "como modelo de lenguaje",
    "je ne peux pas répondre", "je ne suis pas en", "je préfère ne pas me", "en tant que modèle de", "il m'est impossible de répondre",
    "ich kann diese frage nicht", "ich kann dazu nichts sagen", "dabei kann ich ihnen nicht", "leider darf ich dazu nichts", "als sprachmodell kann ich darauf",
    "我无法回答这个问题", "我不能提供帮助", "我不能对此发表意见", "我不便回答", "作为语言模型",
)

#: Words that join a clause to what stands before it; an opening starts after them.
CONNECTIVES = frozenset("but however and so yet still pero mais cependant aber jedoch doch".split())

_INVISIBLE = re.compile("[\\u00ad\\u034f\\u061c\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\ufeff]")
_WRAPS = (
    (re.compile(r"^```\w*\s*"), re.compile(r"\s*```$")),
    (re.compile(r"^\{\s*\"(?:answer|response|output|result)\"\s*:\s*\""), re.compile(r"\"\s*\}$")),
    (re.compile(r"^\[\s*\""), re.compile(r"\"\s*\]$")),
    (re.compile(r"^<(?:answer|p|response|output|b|div|span)>\s*", re.I), re.compile(r"\s*</(?:answer|p|response|output|b|div|span)>$", re.I)),
    (re.compile(r"^\*\*\s*"), re.compile(r"\s*\*\*$")),
    (re.compile(r"^[\"“«]\s*"), re.compile(r"\s*[\"”»]$")),
    (re.compile(r"^\((?=.)"), re.compile(r"\)$")),
)
_LABEL = re.compile(r"^(?:a|answer|antwort|respuesta|réponse|response|回答|答案)\s*[:：]\s*", re.I)
_COPY_LABEL = re.compile(r"^(?:>+|q\s*[:：]|question\s*[:：]|query\s*[=:：]|prompt\s*[=:：]|frage\s*:|pregunta\s*:)\s*", re.I)
_HAN = re.compile(r"[一-鿿]")
_BETWEEN_HAN = re.compile(r"(?<=[一-鿿]) (?=[一-鿿])")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[一-鿿]|[^\W_]+(?:'[^\W_]+)?")
_CLAUSE = re.compile(r"[.!?;:。！？；：]+\s*|,\s+|，|(?<=[一-鿿]),(?=[一-鿿])")
_END = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
_CUT = re.compile(r"(?:\.\.+|…|\[[.…\s]+\]|[,;:，；：、]|\s[-–—])[\"'”’»)\]*_]*$")
_VERB = re.compile(
    r"\b(?:is|are|was|were|shows?|reports?|has|have|had|did|does|do|stands?|gives?|rose|fell|ranks?|reaches|because|that|while|compared|against|asked|declined|says?"
    r"|liegt|ist|sind|dass|denn|es|porque|est|car|sont)\b|[是为而因]",
    re.I,
)
#: An unfinished start: a share of somebody, or a verdict with more to come.
_STARTED = re.compile(r"^(?:\d[\d.,]*\s*[%％]?\s+(?:of|der|des|de|los|las|del)\b|(?:about|nearly|some|only|etwa|environ|cerca)\s+\d|(?:yes|no|oui|non|ja|nein|sí)[,.]\s+\S)", re.I)


def unwrapped(answer: str) -> tuple[str, bool]:
    """The content of an answer without wrapping and label, and whether a wrapping was opened but not closed."""
    s, unclosed = answer.strip(), False
    if s[:1].isalnum() and not _LABEL.match(s):  # no wrapping starts with a letter or digit
        return s, False
    for _ in range(6):
        before = s
        for start, end in _WRAPS:
            m = start.search(s)
            if not m:
                continue
            rest = s[m.end() :]
            e = end.search(rest)
            if e:
                s = rest[: e.start()]
            elif start.pattern not in (r"^\*\*\s*",) or "**" not in rest:
                if start.pattern == r"^\((?=.)" and ")" in rest or start.pattern.startswith(r"^[\"") and re.search(r"[\"”»]", rest):
                    continue
                s, unclosed = rest, True
        s = _LABEL.sub("", s.strip())
        if s == before:
            break
    return s.strip(), unclosed


def plain(text: str | None) -> str:
    """NFKC text with plain apostrophes, without invisible characters."""
    if not text or text.isascii():
        return text or ""
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", text or "")).replace("’", "'").replace("‘", "'")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.casefold())


def language(text: str) -> str | None:
    """The language whose script or common words prevail; None where nothing tells."""
    plain_letters = text.isascii()
    if not plain_letters:
        letters = len(_LETTER.findall(text))
        if _OTHER_SCRIPT.search(text):
            for k, script in _SCRIPTS.items():
                if len(script.findall(text)) * 3 > letters:
                    return k
        if len(_HAN.findall(text)) * 3 > letters:
            return "zh"
    folded = text.casefold()
    found = _WORD.findall(folded)
    if len(found) == 1:
        return YES_NO.get(found[0])
    score = dict.fromkeys(_WORDS_OF, 0.0)
    for w in found:
        for k in _SPOKEN_IN.get(w, ()):
            score[k] += 1
    if found and found[0] in YES_NO and YES_NO[found[0]] in score:
        score[YES_NO[found[0]]] += 1
    if not plain_letters:
        for k, marks in (("es", "ñ¿¡"), ("fr", "çœèêàùî"), ("de", "äöüß"), ("pt", "ãõ"), ("it", "ìò")):
            score[k] += 0.5 * min(2, sum(map(folded.count, marks)))
    top = max(score.values())
    best = [k for k, v in score.items() if v == top]
    return best[0] if top > 0 and len(best) == 1 else None


def is_empty(answer: str | None) -> bool:
    bare = plain(answer).strip()
    s, _ = unwrapped(bare)
    return not re.search(r"[^\W_]", s) or s.casefold().strip(" .!") in PLACEHOLDERS or bare.casefold() in PLACEHOLDERS


def is_copy(query: str, answer: str) -> bool:
    """Whether the answer gives back its query, or the start of it, once or more often, and nothing else."""
    s = plain(answer)
    for _ in range(3):
        s = _COPY_LABEL.sub("", unwrapped(s)[0])
    q, a = tokens(re.sub(r"<[^<>]{1,20}>", " ", plain(query))), tokens(re.sub(r"<[^<>]{1,20}>", " ", s))
    while a and a[-1] in ("answer", "a", "antwort", "respuesta", "réponse") and (not q or q[-1] != a[-1]):
        a.pop()
    if len(q) < 4 or len(a) < len(q):
        return len(q) >= 4 and len(a) >= max(4, round(0.9 * len(q))) and a == q[: len(a)]
    return all(w == q[i % len(q)] for i, w in enumerate(a))


def is_truncated(answer: str) -> bool:
    """Whether the answer stops before what it says is finished; bare names, numbers and short phrases do not."""
    text = plain(answer).strip()
    s, unclosed = unwrapped(text)
    if unclosed or _CUT.search(s) or _CUT.search(text):
        return True
    if _END.search(s) or re.search(r"[%％]$", s):
        return False
    n = len(tokens(s))
    if len(_HAN.findall(s)) > 4:
        return bool(re.search("[，。的因为是]", s)) and n > 6
    return n > 7 or bool(_STARTED.search(s)) or (n > 2 and bool(_VERB.search(s)))


def clauses(query_words: set[str], content: str) -> tuple[list[str], list[str]]:
    """(openings, short): the first words of each clause that say nothing of the query and hold no number, and the clauses of
    fewer words whole. ``query_words`` are the query's words but for common ones."""
    out, short = [], []
    for clause in _CLAUSE.split(content):
        words = tokens(clause)
        if len(words) > 1 and words[0] in CONNECTIVES:
            words = words[1:]
        if not words:
            continue
        han = bool(_HAN.match(words[0]))
        if len(words) < (LEAST_HAN if han else LEAST_WORDS):
            short.append(" ".join(words))
            continue
        words = words[: OPENING_HAN if han else OPENING_WORDS]
        if not any(w in query_words or any(c.isdigit() for c in w) for w in words):
            out.append(_BETWEEN_HAN.sub("", " ".join(words)))
    return list(dict.fromkeys(out)), list(dict.fromkeys(short))


def openings(query: str, answer: str) -> list[str]:
    """The openings of an answer's clauses that carry nothing of the query."""
    asked = {w for w in tokens(plain(query)) if not _HAN.match(w)} - _COMMON
    return clauses(asked, unwrapped(plain(answer))[0])[0]


def is_whole(opening: Column) -> Column:
    """Whether an opening is long enough for its recurring to tell anything: short phrases are answers."""
    return opening.rlike("^[一-鿿]") | (F.size(F.split(opening, " ")) >= OPENING_WORDS)


def hash_text(s: str) -> int:
    """64-bit hash of the UTF-8 bytes, the same in all workers."""
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def grams(text: str) -> frozenset[str]:
    """Character 4-grams; of a shorter text, the text."""
    return frozenset(text[i : i + 4] for i in range(max(1, len(text) - 3)))


def jaccard(x: frozenset, y: frozenset) -> float:
    return len(x & y) / len(x | y)


def similar(a: str, b: str) -> bool:
    """Verified similarity of two openings: Jaccard of their character 4-grams."""
    return jaccard(grams(a), grams(b)) >= SIMILARITY


_RNG = np.random.default_rng(11)
_A, _B = (_RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_A |= np.uint64(1)
_MIX = _RNG.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def band_keys(text: str) -> np.ndarray:
    """The key of each band: the MinHash values of its rows, combined."""
    g = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in grams(text)], dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = g[:, None] * _A + _B
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        low = (h ^ (h >> np.uint64(29))).min(axis=0).reshape(BANDS, ROWS)
        return ((low * _MIX).sum(axis=1, dtype=np.uint64) ^ np.arange(BANDS, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


class Bucket:
    """The openings of one bucket in clusters around leaders; ``add`` gives the links of a new member.

    A member is compared with the leaders only. Another member similar to it (distance d of at most 0.2) whose leader lies
    within d of that one shows in a similarity to that leader of at least 1 - 2 d, and only the members of such leaders are
    compared, so no pair of the bucket is missed. The links are one for each cluster that a member joins.
    """

    def __init__(self) -> None:
        self.around: list[list[tuple[str, frozenset]]] = []

    def add(self, opening: str) -> list[str]:
        x = grams(opening)
        links, home = [], None
        for members in self.around:
            leader, y = members[0]
            if min(len(x), len(y)) < (2 * SIMILARITY - 1) * max(len(x), len(y)):
                continue
            j = jaccard(x, y)
            if j >= SIMILARITY:
                links.append(leader)
                home = home if home is not None else members
            elif j >= 2 * SIMILARITY - 1 - 1e-9:
                links += [o for o, z in members[1:] if jaccard(x, z) >= SIMILARITY][:1]
        if home is None:
            self.around.append([(opening, x)])
        else:
            home.append((opening, x))
        return links


def cluster_openings(distinct: DataFrame) -> DataFrame:
    """(opening, cluster): the openings of one cluster are linked by verified similarity.

    Openings meet in the buckets of MinHash bands; within a bucket every similar pair is found, see ``Bucket``. A bucket is
    read in order, not collected; its links number at most its members times the clusters each joins. Null openings are left out.
    """
    distinct = distinct.where("opening is not null").select("opening").distinct()

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first in range(0, len(b), 500):
                part = b["opening"].iloc[first : first + 500]
                if len(part):
                    yield pd.DataFrame({"key": np.concatenate([band_keys(x) for x in part]), "opening": np.repeat(part.to_numpy(), BANDS)})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, bucket = None, Bucket()
        for b in batches:
            rows = []
            for key, opening in zip(b["key"], b["opening"], strict=True):
                if key != at:
                    at, bucket = key, Bucket()
                rows += [(opening, other) for other in bucket.add(opening)]
            yield pd.DataFrame(rows, columns=["a", "b"])

    buckets = distinct.mapInPandas(spread, "key bigint, opening string").repartition("key").sortWithinPartitions("key", "opening")
    edges = materialize(buckets.mapInPandas(link, "a string, b string").distinct(), "links")
    if edges.isEmpty():
        return distinct.select("opening", F.col("opening").alias("cluster"))
    labels = components(edges).withColumnRenamed("node", "opening")
    return distinct.join(labels, "opening", "left").select("opening", F.coalesce("component", "opening").alias("cluster"))


#: Kinds in the order in which they count.
KINDS = ("empty", "copied_question", "refusal", "other_language", "truncated")

_CHECKED = "task_id bigint, prompt bigint, kind tinyint, data boolean, whole bigint, openings array<string>, short array<bigint>"


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["task_id", "prompt", "kind", "data", "whole", "openings", "short"]
    asked_of: dict[str, tuple] = {}
    for b in batches:
        rows = []
        for task, query, answer in zip(b["task_id"], b["query"], b["answer"], strict=True):
            query = query or ""
            if query not in asked_of:
                if len(asked_of) > 50_000:
                    asked_of.clear()
                q = plain(query)
                words = tokens(q)
                asked_of[query] = hash_text(" ".join(words)), {w for w in words if not _HAN.match(w)} - _COMMON, set(re.findall(r"\d+", q)), language(q)
            prompt, asked, numbers, ql = asked_of[query]
            if is_empty(answer):
                rows.append((task, prompt, 0, False, None, [], []))
                continue
            if is_copy(query, answer):
                rows.append((task, prompt, 1, False, None, [], []))
                continue
            content = unwrapped(plain(answer))[0]
            data = bool(re.search("[%％]", content)) or any(x not in numbers for x in re.findall(r"\d+", content))
            al = language(content)
            differs = ql is not None and al is not None and ql != al
            if differs and len(tokens(content)) == 1:
                differs = not (ql in ("en", "es") and content.casefold().strip(".") == "no")
            said, short = clauses(asked, content)
            whole = hash_text(short[0]) if len(short) == 1 and not said and len(_CLAUSE.split(content.rstrip(".!。！ "))) == 1 else None
            kind = 3 if differs else 4 if is_truncated(answer) else None
            rows.append((task, prompt, kind, data, whole, said, [] if data or not said else [hash_text(x) for x in short]))
        out = pd.DataFrame(rows, columns=columns)
        out["kind"], out["whole"] = out["kind"].astype("Int8"), out["whole"].astype("Int64")
        yield out


def refusal_openings(said: DataFrame, known: Sequence[str] = KNOWN) -> DataFrame:
    """The openings that refuse, of ``said`` (opening, prompt, free): one row for each answer's opening.

    ``free`` says that the answer holds no data and no bare answer. A cluster refuses if whole openings of it stand in free
    answers to at least ``RECURS`` prompts, and at least ``SHARE`` of all answers that hold them are free; or if it holds one
    of ``known``.
    """
    seen = said.groupBy("opening", "prompt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("free").cast("long")).alias("f"))
    seen = materialize(seen, "openings")
    given = said.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(known)], "opening string")
    candidates = seen.where("f > 0").select("opening").unionByName(given)  # others refuse nothing
    clusters = materialize(cluster_openings(candidates), "clusters")
    spread = clusters.where(is_whole(F.col("opening"))).join(seen, "opening").groupBy("cluster", "prompt").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    recurring = spread.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.count_if(F.col("f") > 0).alias("prompts"))
    refusing = recurring.where((F.col("prompts") >= RECURS) & (F.col("f") >= SHARE * F.col("n"))).select("cluster")
    refusing = refusing.unionByName(clusters.join(given, "opening", "left_semi").select("cluster")).distinct()
    return clusters.join(refusing, "cluster", "left_semi").select("opening")


def defective_pairs(tasks: DataFrame, known: Sequence[str] = KNOWN) -> DataFrame:
    """(task_id, defect) of every defective pair of ``tasks`` (task_id, query, answer); repeated rows count once.

    ``defect`` is the first that holds of empty, copied_question, refusal, other_language, truncated; of rows with one task_id
    and other contents, the first that holds of any. A null query is an empty one: nothing can copy it and no language is told.
    Null answers are empty; texts of any length are read whole. Rows without a task_id are one task. An
    empty table gives no rows; other columns are not read.
    """
    checked = tasks.select("task_id", "query", "answer").mapInPandas(_check, _CHECKED)
    checked = materialize(checked, "pairs")
    # clauses that recur as whole answers are bare answers: yes, no, neither, a name
    bare = checked.where("whole is not null").select("whole", "prompt").distinct().groupBy("whole").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RECURS)
    some = checked.where(F.size("openings") > 0)
    short = some.where("not data").select("task_id", F.explode("short").alias("whole"))
    answering = short.join(bare, "whole", "left_semi").select(F.col("task_id").alias("t")).distinct().withColumn("answers", F.lit(True))
    said = some.join(answering, F.col("task_id").eqNullSafe(F.col("t")), "left").select("task_id", "prompt", F.explode("openings").alias("opening"), (~F.col("data") & F.col("answers").isNull()).alias("free"))
    said = materialize(said, "said")
    refusing = said.where("free").join(refusal_openings(said, known), "opening", "left_semi").select("task_id", F.lit(2).cast("tinyint").alias("kind"))
    first = checked.where("kind is not null").select("task_id", "kind").unionByName(refusing).groupBy("task_id").agg(F.min("kind").alias("kind"))
    return first.select("task_id", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("defect"))
