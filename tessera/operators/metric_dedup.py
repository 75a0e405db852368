"""Semantic deduplication of metric descriptions.

Similarity of two texts is a cosine of vectors where vectors are given, else
the cosine of TF-IDF weights fitted on just these two texts, else the overlap
of their word sets. Merging is first-fit: the first description that isn't used
yet takes in all later ones that are similar to its own text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as a
from tessera.functions import text as t
from tessera.workdir import checkpointed, ranked

_TOKEN = re.compile(r"\b\w\w+\b")


def stop_words() -> frozenset[str]:
    """Spark's English list; another list can be handed to the functions below."""
    return frozenset(StopWordsRemover.loadDefaultStopWords("english"))


def word_overlap(x: Column, y: Column) -> Column:
    """Common share of the lower-cased word sets; 0 if one is empty."""
    return a.jaccard(F.array_distinct(t.words(F.lower(x))), F.array_distinct(t.words(F.lower(y))))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once for a row; inside a lambda it would be computed anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _terms(x: Column, stops: Column) -> Column:
    kept = F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"\b(\w\w+)\b"), F.lit(1)), lambda w: ~F.array_contains(stops, w))
    return _once(kept, lambda k: F.concat(k, a.ngrams(k, 2)))


def tfidf_cosine(x: Column, y: Column, stops: frozenset[str] | set[str]) -> Column:
    """TF-IDF cosine of words and word pairs, fitted on the two texts; null if neither has a term.

    A term of both texts weighs 1, a term of one ln(3/2) + 1.
    """
    listed = F.array(*[F.lit(w) for w in sorted(stops)]) if stops else F.array().cast("array<string>")
    some = lambda s: F.when((F.size(s["p"]) == 0) & (F.size(s["r"]) == 0), None).otherwise(_weighted_cosine(s["p"], s["r"]))
    return _once(F.struct(_terms(x, listed).alias("p"), _terms(y, listed).alias("r")), some)


def _weighted_cosine(p: Column, r: Column) -> Column:
    count = lambda terms, w: F.size(F.filter(terms, lambda v: v == w))
    single = float(math.log(3 / 2) + 1) ** 2

    def cosine(shared: Column) -> Column:
        both = a.total(F.transform(shared, lambda w: count(p, w) * count(r, w)))
        square = lambda terms: a.total(F.transform(F.array_distinct(terms), lambda w: F.when(F.array_contains(shared, w), 1.0).otherwise(single) * count(terms, w) * count(terms, w)))
        return F.coalesce(F.try_divide(both, F.sqrt(square(p) * square(r))), F.lit(0.0))

    return _once(F.array_intersect(p, r), cosine)


def similarity(x: Column, y: Column, stops, x_vector: Column | None = None, y_vector: Column | None = None) -> Column:
    """0 if a text is empty; the cosine of vectors where both are there, else of TF-IDF, or word overlap where no term is left."""
    empty = (F.coalesce(F.trim(x), F.lit("")) == "") | (F.coalesce(F.trim(y), F.lit("")) == "")
    by_vector = [] if x_vector is None or y_vector is None else [F.when(x_vector.isNotNull() & y_vector.isNotNull(), a.cosine(x_vector, y_vector))]
    return F.when(empty, 0.0).otherwise(F.coalesce(*by_vector, tfidf_cosine(x, y, stops), word_overlap(x, y)))


def is_similar(general: Column, specific: Column, combined: Column, general_least: float = 0.7, least: float = 0.7) -> Column:
    return (general >= general_least) | (0.6 * general + 0.2 * specific + 0.2 * combined >= least)


def longest(column: str, order: list[str]) -> Column:
    """The longest text of a group, the first in ``order`` among equals."""
    return F.min(F.struct((-F.length(column)).alias("size"), *order, F.col(column).alias("text")))["text"]


# The greedy pass works in plain Python on one group at a time.


def text_similarity(x: str, y: str, stops: frozenset[str]) -> float:
    if not x.strip() or not y.strip():
        return 0.0
    bags = []
    for text in (x, y):
        kept = [w for w in _TOKEN.findall(text.lower()) if w not in stops]
        bags.append(Counter(kept + [f"{p} {q}" for p, q in zip(kept, kept[1:], strict=False)]))
    p, q = bags
    if not p and not q:
        u, v = set(x.lower().split()), set(y.lower().split())
        return len(u & v) / len(u | v) if u and v else 0.0
    rare = math.log(3 / 2) + 1
    norm = lambda one, other: math.sqrt(sum((n * (1.0 if w in other else rare)) ** 2 for w, n in one.items()))
    size = norm(p, q) * norm(q, p)
    return sum(n * q[w] for w, n in p.items() if w in q) / size if size else 0.0


def first_fit(items: list[tuple[str, str]], similar: Callable[[str, str], float], general_least: float, least: float) -> list[tuple[str, list[str]]]:
    """Merge (general, specific) descriptions in order; gives (general, specifics) of each merged one."""
    used, out = [False] * len(items), []
    for k, (general, specific) in enumerate(items):
        if used[k]:
            continue
        best, specifics = general, [specific] if specific else []
        for j in range(k + 1, len(items)):
            if used[j]:
                continue
            g, s = items[j]
            near = similar(general, g)
            if near >= general_least or 0.6 * near + 0.2 * similar(specific, s) + 0.2 * similar(f"{general} {specific}", f"{g} {s}") >= least:
                used[j] = True
                best = g if len(g) > len(best) else best
                if s and s not in specifics:
                    specifics.append(s)
        out.append((best, specifics))
    return out


def vector_similarity(encode: Callable[[list[str]], list], fallback: Callable[[str, str], float]) -> Callable[[str, str], float]:
    """Cosine of encoded texts, each encoded once; ``fallback`` where a text is empty or can't be encoded."""
    known: dict[str, np.ndarray | None] = {}

    def vector(text: str):
        if text not in known:
            try:
                known[text] = np.asarray(encode([text])[0], dtype=float)
            except Exception:
                known[text] = None
        return known[text]

    def similar(x: str, y: str) -> float:
        if not x.strip() or not y.strip():
            return 0.0
        u, v = vector(x), vector(y)
        size = 0.0 if u is None or v is None else float(np.linalg.norm(u) * np.linalg.norm(v))
        return float(u @ v) / size if size else fallback(x, y)

    return similar


def deduplicate(metrics: DataFrame, group: str, order: list[str], general_least: float = 0.7, least: float = 0.7, stops: frozenset[str] | None = None, encode: Callable[[list[str]], list] | None = None) -> DataFrame:
    """(group, position, general, specifics): merged descriptions of each group, in order of ``order``.

    Rows whose two descriptions are empty are left out. With ``encode`` (texts
    to vectors) similarity is the cosine of vectors first.
    """
    stops = stop_words() if stops is None else stops

    by_text = lambda x, y: text_similarity(x, y, stops)

    def merged(items: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
        cache: dict[tuple[str, str], float] = {}
        measure = vector_similarity(encode, by_text) if encode else by_text

        def similar(x: str, y: str) -> float:
            if (x, y) not in cache:
                cache[x, y] = measure(x, y)
            return cache[x, y]

        return first_fit(items, similar, general_least, least)

    def f(frames):
        """Groups stand together; the last one of a batch may go on in the next."""
        own, items = None, []
        for frame in frames:
            out = []
            for grp, general, specific in zip(frame["grp"].tolist(), frame["general"].tolist(), frame["specific"].tolist(), strict=True):
                if items and grp != own:
                    out += [(own, n, *m) for n, m in enumerate(merged(items))]
                    items = []
                own = grp
                items.append((general, specific))
            yield pd.DataFrame(out, columns=["grp", "position", "general", "specifics"])
        yield pd.DataFrame([(own, n, *m) for n, m in enumerate(merged(items))], columns=["grp", "position", "general", "specifics"])

    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = metrics.select(F.col(group).cast("string").alias("grp"), *order, blank("general"), blank("specific")).where("general <> '' OR specific <> ''")
    dealt = rows.repartition("grp").sortWithinPartitions("grp", *[F.col(c).asc_nulls_last() for c in order])
    return dealt.select("grp", "general", "specific").mapInPandas(f, "grp string, position int, general string, specifics array<string>")


def flatten(merged: DataFrame) -> DataFrame:
    """One row for each specific description; a metric without one gives an empty one."""
    return merged.select("grp", "position", "general", F.posexplode_outer("specifics").alias("n", "specific")).withColumns({"specific": F.coalesce("specific", F.lit("")), "n": F.coalesce("n", F.lit(0))})


# First-fit over one long list. What takes in what depends on all earlier
# descriptions, but only through those that are similar: a description stands for
# itself unless an earlier similar one does, and joins the first that does.


def _bag(text: str, stops: frozenset[str]) -> tuple[str, Counter]:
    """(kind, terms) as ``text_similarity`` counts them; texts of different kinds have no similarity."""
    if not text.strip():
        return "none", Counter()
    kept = [w for w in _TOKEN.findall(text.lower()) if w not in stops]
    terms = Counter(kept + [f"{p} {q}" for p, q in zip(kept, kept[1:], strict=False)])
    return ("terms", terms) if terms else ("words", Counter(set(text.lower().split())))


def least_general(general_least: float, least: float) -> float:
    """No pair of descriptions is similar whose general texts are less similar than this."""
    return min(general_least, (least - 0.4) / 0.6)


def candidates(items: DataFrame, bound: float, stops: frozenset[str]) -> DataFrame:
    """(a, b) with a < b: pairs of items (n, general) whose general texts may have a similarity of ``bound``.

    The similarity is at most the cosine of the term counts. Terms are in order
    of rarity; those after which the rest of a text is too short for the bound
    are its prefix, and two texts above the bound share a term of both prefixes.
    With a bound of 0 or less all items share a term.
    """

    def spread(frames):
        for frame in frames:
            out = [(n, f"{kind}:{term}", count) for n, text in frame[["n", "general"]].itertuples(index=False) for kind, bag in [_bag(text, stops)] for term, count in bag.items()]
            yield pd.DataFrame(out, columns=["n", "term", "count"])

    if bound <= 0:
        prefix = items.select("n", F.lit("").alias("term"))
    else:
        terms = checkpointed(items.select("n", "general").mapInPandas(spread, "n long, term string, count int"))
        rarity = terms.groupBy("term").agg(F.count("*").alias("texts"))
        entry = F.struct("texts", "term", (F.col("count") * F.col("count")).alias("square"))
        listed = terms.join(rarity, "term").groupBy("n").agg(F.array_sort(F.collect_list(entry)).alias("t"))
        rest = lambda i: F.aggregate(F.slice("t", i + 1, F.size("t")), F.lit(0), lambda s, x: s + x["square"])
        whole = F.aggregate("t", F.lit(0), lambda s, x: s + x["square"])
        within = F.filter("t", lambda x, i: rest(i) >= whole * (bound**2 * (1 - 1e-9)))
        prefix = checkpointed(listed.select("n", F.explode(F.transform(within, lambda x: x["term"])).alias("term")))
    left, right = prefix.select(F.col("n").alias("a"), "term"), prefix.select(F.col("n").alias("b"), "term")
    return left.join(right, "term").where("a < b").select("a", "b").distinct()


def similar_pairs(items: DataFrame, general_least: float, least: float, stops: frozenset[str]) -> DataFrame:
    """(a, b) with a < b: pairs of items (n, general, specific) that first-fit would merge."""
    pairs = candidates(items, least_general(general_least, least), stops)
    side = lambda name: items.select(F.col("n").alias(name), F.col("general").alias(f"g{name}"), F.col("specific").alias(f"s{name}"))
    whole = pairs.join(side("a"), "a").join(side("b"), "b")

    def check(frames):
        for frame in frames:
            keep = []
            for ga, sa, gb, sb in frame[["ga", "sa", "gb", "sb"]].itertuples(index=False):
                near = text_similarity(ga, gb, stops)
                keep.append(near >= general_least or 0.6 * near + 0.2 * text_similarity(sa, sb, stops) + 0.2 * text_similarity(f"{ga} {sa}", f"{gb} {sb}", stops) >= least)
            yield frame.loc[keep, ["a", "b"]]

    return whole.mapInPandas(check, "a long, b long")


def owners(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, owner): the item that takes in each item n, itself for those that stand; ``edges`` (a, b), a < b, are similar.

    Each round settles every item whose earlier similar ones are all settled.
    """
    edges = checkpointed(edges)
    open_items, open_edges, standing = checkpointed(items.select("n")), edges, None
    while not open_items.isEmpty():
        first = checkpointed(open_items.join(open_edges.select(F.col("b").alias("n")), "n", "left_anti"))
        standing = first if standing is None else checkpointed(standing.unionByName(first))
        taken = open_edges.join(first.withColumnRenamed("n", "a"), "a", "left_semi").select(F.col("b").alias("n")).distinct()
        open_items = checkpointed(open_items.join(first.unionByName(taken), "n", "left_anti"))
        left = open_items.select(F.col("n").alias("a")), open_items.select(F.col("n").alias("b"))
        open_edges = checkpointed(open_edges.join(left[0], "a", "left_semi").join(left[1], "b", "left_semi"))
    if standing is None:
        return items.select("n", F.col("n").alias("owner"))
    joined = edges.join(standing.withColumnRenamed("n", "a"), "a", "left_semi").join(standing.withColumnRenamed("n", "b"), "b", "left_anti")
    return standing.select("n", F.col("n").alias("owner")).unionByName(joined.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("owner")).select("n", "owner"))


def fold_all(items: DataFrame, order: list[str], general_least: float, least: float, stops: frozenset[str]) -> DataFrame:
    """(position, general, specifics) of rows with ``order``, general and specific: ``first_fit`` over all of them as a Spark job."""
    numbered = checkpointed(ranked(items, *order, name="n").select("n", "general", "specific"))
    owned = checkpointed(owners(numbered, similar_pairs(numbered, general_least, least, stops)).join(numbered, "n"))
    best = owned.groupBy("owner").agg(longest("general", ["n"]).alias("general"))
    told = owned.where("specific <> ''").groupBy("owner", "specific").agg(F.min("n").alias("n")).groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "specific"))), lambda x: x["specific"]).alias("specifics"))
    joined = best.join(told, "owner", "left").select("owner", "general", F.coalesce("specifics", F.array().cast("array<string>")).alias("specifics"))
    return ranked(joined, "owner", name="position").select(F.col("position").cast("int").alias("position"), "general", "specifics")


def deduplicate_all(merged: DataFrame, general_least: float = 0.65, least: float = 0.75, stops: frozenset[str] | None = None) -> DataFrame:
    """One list over all groups: exact repeats are folded first, then ``fold_all`` takes the distinct ones."""
    flat = flatten(merged)
    distinct = flat.groupBy("general", "specific").agg(F.min(F.struct("grp", "position", "n")).alias("first")).where("general <> '' OR specific <> ''")
    rows = distinct.select("general", "specific", F.col("first.grp").alias("o1"), F.col("first.position").alias("o2"), F.col("first.n").alias("o3"))
    return fold_all(rows, ["o1", "o2", "o3"], general_least, least, stop_words() if stops is None else stops).select(F.lit("all").alias("grp"), "position", "general", "specifics")
