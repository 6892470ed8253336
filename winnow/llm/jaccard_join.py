"""Exact joins of texts by the Jaccard similarity of their shingle sets: a grouped prefix join.

One pass shingles the texts. Texts with the same set are one node. Nodes with the same prefix and the same
size are one group, and a group takes part in the join as one row for each shingle of its prefix that another
group has, too. Groups that meet on a shingle are filtered by what all members have in common: their size, the
places of the shingle in both prefixes, and how many shingles of the prefixes both have. Pairs of groups that
are left are expanded to their members. A member has a signature of parities, in which two sets differ in as many bits
at most as they have shingles apart; what that leaves is compared on the whole sets. No filter loses a similar pair.

What is asked for are the classes that links make, so pairs inside one class need not be looked at. Rounds
come first that cost one pair a row: in each shingle's list, and in each group, one member is compared
with all others of other classes, and what is similar becomes one class. Rounds end when the lists
hold hardly more pairs than rows, or a round settles little; then every pair of different classes that is
left in any list is filtered and compared. A list of near copies thus costs its length, not its square, and the
result is that of comparing all pairs. A caller may name pairs of texts to be looked at before the rounds (near
fingerprints, in :mod:`simhash`): those that are similar are links like any other, and the rounds start from their classes. Large lists are joined by sort and merge, which Spark splits where they are skewed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm._common import discard, materialise, table
from winnow.llm.components import connected_components
from winnow.llm.near_copies import SHINGLE, SIMILAR, _many, _may, close, common_shingles, in_slots, signatures, slots_of, verified

ROUNDS = 8  # at most, of one pair a row
WORTH = 4  # rounds go on while lists hold more than so many pairs a row
GAIN = 0.8  # and while one leaves at most this share of them

Candidates = Callable[[DataFrame], DataFrame]  # from (t, text) to pairs (a, b) of t


def _labelled(nodes: DataFrame, classes: DataFrame | None) -> DataFrame:
    """``nodes`` (node, ...) with ``c``, the class of each."""
    if classes is None:
        return nodes.withColumn("c", F.col("node"))
    return nodes.join(classes, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _apart(x: str, y: str):
    """Whether two groups have members of different classes."""
    return (F.col(f"{x}.low") != F.col(f"{y}.low")) | (F.col(f"{x}.high") != F.col(f"{y}.high")) | (F.col(f"{x}.low") != F.col(f"{x}.high"))


def _cross_pairs(rows: DataFrame) -> int:
    """How many pairs of different classes the lists of ``rows`` (h, d) hold."""
    by = rows.groupBy("h", "d.low", "d.high").agg(F.count("*").cast("double").alias("k")).withColumn("same", F.when(F.col("low") == F.col("high"), F.col("k") * F.col("k")).otherwise(F.col("k")))
    lists = by.groupBy("h").agg(((F.sum("k") * F.sum("k") - F.sum("same")) / 2).alias("pairs"))
    return int(lists.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs")).first()["pairs"])


def _stars(rows: DataFrame, at: int, similar: tuple[int, int]) -> DataFrame:
    """(a, b): in each list, one group's representative and those of all groups of other classes. The first time it is the group that stands in the most rows of other groups."""
    if at == 0:
        meets = rows.join(rows.groupBy("h").agg(F.count("*").alias("rows")), "h").groupBy(F.col("d.rep").alias("rep")).agg(F.sum("rows").alias("order"))
        rows = rows.join(meets, F.col("d.rep") == F.col("rep")).select("h", "d", "order")
    else:
        rows = rows.withColumn("order", F.xxhash64(F.lit(at), "d.rep"))
    leaders = rows.groupBy("h").agg(F.max(F.struct("order", "d")).alias("m"), F.min("d.low").alias("low"), F.max("d.high").alias("high")).where("low != high").select("h", F.col("m.d").alias("leader"))
    led = rows.join(leaders, "h").where((F.col("d.rep") != F.col("leader.rep")) & _apart("d", "leader") & _may("d", "leader", similar))
    return led.select(F.col("leader.rep").alias("a"), F.col("d.rep").alias("b"))


def _inside(members: DataFrame, at: int) -> DataFrame:
    """(a, b): in each group of more than one class, one member and those of other classes."""
    leaders = members.groupBy("rep").agg(F.max(F.struct(F.xxhash64(F.lit(at), "node").alias("order"), "node", "c")).alias("leader"), F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("rep", "leader")
    return members.join(leaders, "rep").where(F.col("c") != F.col("leader.c")).select(F.col("leader.node").alias("a"), F.col("node").alias("b"))


def _left_over(rows: DataFrame, members: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(a, b): all pairs of nodes of different classes whose groups pass the filters, or are one."""
    mixed = rows.groupBy("h").agg(F.min("d.low").alias("low"), F.max("d.high").alias("high")).where("low != high").select("h")
    some = materialise(rows.join(mixed, "h", "left_semi"))
    a, b = some.select("h", F.col("d").alias("x")), some.select("h", F.col("d").alias("y"))
    met = a.join(b, (a.h == b.h) & (F.col("x.rep") < F.col("y.rep")) & _apart("x", "y") & _may("x", "y", similar)).select(F.col("x.rep").alias("p"), F.col("y.rep").alias("q")).distinct()
    lists = materialise(some.groupBy(F.col("d.rep").alias("rep")).agg(F.first("d.n").alias("n"), F.collect_list("h").alias("hs")))
    met = met.join(lists.toDF("p", "p_n", "p_hs"), "p").join(lists.toDF("q", "q_n", "q_hs"), "q")
    groups = materialise(met.where(_many(F.size(F.array_intersect("p_hs", "q_hs")), F.col("p_n"), F.col("q_n"), similar)).select("p", "q"))
    x, y = members.select(F.col("rep").alias("p"), F.col("node").alias("a"), F.col("c").alias("a_c")), members.select(F.col("rep").alias("q"), F.col("node").alias("b"), F.col("c").alias("b_c"))
    across = groups.join(x, "p").join(y, "q").where("a_c != b_c").select("a", "b")
    y = y.withColumnRenamed("q", "p")
    inside = x.join(y, "p").where("a < b AND a_c != b_c").select("a", "b")
    out = materialise(across.unionByName(inside).distinct())
    for done in (some, lists, groups):
        discard(done)
    return out


def _first_links(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, members: DataFrame, texts: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """(a, b): the nodes of those ``pairs`` (a, b) of texts that are similar. Nodes that share no shingle of their prefixes with others are not among ``members`` and can't be."""
    of = materialise(sets.select("t", "s").distinct().join(nodes.select("s", "node"), "s").select("t", "node"))
    named = pairs.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    todo = materialise(close(named, members, similar))
    links = verified(todo, texts, size, similar)
    for done in (of, todo):
        discard(done)
    return links


def node_classes(sets: DataFrame, texts: DataFrame, size: int, similar: tuple[int, int], first: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(s, node) of all sets (t, n, s, g, bits, prefix), and (node, component) of the nodes that links join to others.

    A node is named by the smallest t of its set. The similar ones of ``first`` (a, b), pairs of t, are the classes that rounds start from.
    """
    nodes = materialise(sets.where("n > 0").groupBy("s").agg(F.min("t").alias("node"), F.first("n").alias("n"), F.first("g").alias("g"), F.first("bits").alias("bits")))
    groups = materialise(nodes.groupBy("g").agg(F.min("node").alias("rep"), (F.count("*") > 1).alias("many")))
    prefix = sets.select("g", "n", F.posexplode("prefix").alias("pos", "h"))
    shared = prefix.groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low != high").select("h")
    shared = materialise(shared)
    held = in_slots(slots_of(shared.select(F.col("h").alias("v"))))
    places = prefix.where(held("h")).distinct().join(shared, "h", "left_semi")
    places = materialise(places.join(groups, "g").select("h", "rep", "n", "pos"))
    live = places.select("rep").unionByName(groups.where("many").select("rep")).distinct()
    members = materialise(nodes.join(groups, "g").join(live, "rep", "left_semi").select("node", "rep", "n", "bits"))
    classes, pairs, total = None, None, places.count()
    if first is not None:
        links = _first_links(first, sets, nodes, members, texts, size, similar)
        classes = connected_components(links)
        discard(links)
    for at in range(ROUNDS + 1):
        labelled = materialise(_labelled(members.select("node", "rep"), classes))
        spread = labelled.groupBy("rep").agg(F.min("c").alias("low"), F.max("c").alias("high"))
        rows = materialise(places.join(spread, "rep").select("h", F.struct("rep", "n", "pos", "low", "high").alias("d")))
        before, pairs = pairs, _cross_pairs(rows) if classes is not None else None
        last = pairs is not None and (at == ROUNDS or pairs <= WORTH * total or before is not None and pairs > GAIN * before)
        met = _left_over(rows, labelled, similar) if last else materialise(_stars(rows, at, similar).unionByName(_inside(labelled, at)).distinct())
        todo = materialise(close(met, members, similar))
        links = verified(todo, texts, size, similar)
        known = links if classes is None else links.unionByName(classes.select(F.col("node").alias("a"), F.col("component").alias("b")))
        after = connected_components(known)
        for done in (labelled, rows, met, todo, links, *([classes] if classes is not None else [])):
            discard(done)
        classes = after
        if last:
            break
    for done in (groups, shared, places, members):
        discard(done)
    return nodes.select("s", "node"), classes


def text_classes(docs: DataFrame, size: int, similar: tuple[int, int], candidates: Candidates | None = None) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with t, (t, n, class)): t names a text; a text's number of shingles and, if it has any, its class. Pairs of ``candidates`` are looked at first."""
    named = docs.withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = named.select("t", "text")
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))
    sets = materialise(signatures(texts, size, similar, common))
    nodes, classes = node_classes(sets, texts, size, similar, candidates(texts) if candidates else None)
    of = sets.select("t", "n", "s").distinct().join(nodes, "s", "left").join(classes, "node", "left")
    out = materialise(of.select("t", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("class")))
    discard(sets)
    return named, out


def near_copy_groups(docs: DataFrame, size: int = SHINGLE, similar: tuple[int, int] = SIMILAR, candidates: Candidates | None = None) -> DataFrame:
    """(key, group long) for each row of ``docs`` (key, text): rows linked by similar texts have one group.

    A null or empty text, and one without words, is a copy of the others of that kind. Repeated rows
    come out as often as they went in; empty input gives no rows.
    """
    named, classes = text_classes(docs.select("key", "text"), size, similar, candidates)
    return named.select("key", "t").join(classes, "t").select("key", F.coalesce("class", F.lit(0)).alias("group"))


def jaccard_groups(docs: DataFrame, id_col: str, text_col: str, size: int = 3, similar: tuple[int, int] = (9, 10)) -> DataFrame:
    """(id, n, component) for each row of ``docs``: its number of distinct shingles and the smallest id of its class.

    A null or empty text and one without words have no shingles and are linked with nothing. A null id keeps its row and
    takes the component of its class; a class of null ids only, and a text without words that has none, have a null component.
    Repeated rows come out as often as they went in; empty input gives no rows.
    """
    named, classes = text_classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), size, similar)
    least = named.groupBy("t").agg(F.min("id").alias("least"))
    of = materialise(classes.join(least, "t"))
    first = of.where("class is not null").groupBy("class").agg(F.min("least").alias("component"))
    of = of.join(first, "class", "left").select("t", F.col("n").cast("long").alias("n"), "component")
    return named.select("id", "t").join(of, "t").select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles and component of every document, linked at a similarity of 0.9."""
    groups = jaccard_groups(table(spark, sf_dir, "documents"), "doc_id", "text")
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


#: All pairs of distinct texts that share a shingle, counted.
OP12_SQL = """WITH RECURSIVE w AS (SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] END) AS g FROM w),
d AS MATERIALIZED (SELECT doc_id, len(g) AS n, list_sort(g) AS g FROM g), s AS MATERIALIZED (SELECT g, any_value(n) AS n, min(doc_id) AS id FROM d WHERE n > 0 GROUP BY g),
e AS MATERIALIZED (SELECT id, n, unnest(g) AS h FROM s), p AS (SELECT a.id AS a, b.id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.id <> b.id GROUP BY a.id, b.id),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * shared >= 90 * (n - shared)), r AS (SELECT id, id AS other FROM s UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT id, min(other) AS component FROM r GROUP BY id)
SELECT doc_id, d.n AS n_shingles, CASE WHEN d.n = 0 THEN doc_id ELSE component END AS component_id FROM d LEFT JOIN s ON d.g = s.g LEFT JOIN c ON s.id = c.id"""
