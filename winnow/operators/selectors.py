"""Greedy subset selectors over a distributed pool.

A selector picks one row at a time, each pick depending on the ones before. The pool
stays in Spark. A round settles up to ``STEPS`` picks of every class with a few jobs: the best rows of each
class come to the driver, which picks among them as if they were all; then every task repeats these picks over
its own rows and names the best row of each step, and a step counts as long as all steps before it
were guessed right. The first wrong guess is replaced by the row found. So picks are exact and a
round settles one at least. Scores are doubles and ties go to the smallest id.

A pool is kept in tables that are dealt by id in the same way, so that they are joined without a shuffle:
vectors and what never changes, written once; a few numbers a row, written anew in a round; and for a rule that keeps
columns (one number a pick) a table that each round adds its own columns to. So what is written grows with rows and
picks. Candidates are found by their scores: a task keeps the best of all its batches, lists are merged in two
steps, and only then are the vectors of ``AHEAD`` rows a class fetched (fewer if they take more than ``AHEAD_BYTES``), whatever the pool's size.

Pools are (id, x array<double>) and, for several classes, a class column; results are
(class, id, pick_no from 1) and what a selector traces. A class with fewer rows than ``n`` is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions import vectors as V
from winnow.functions.order import seeded
from winnow.operators import pairs
from winnow.operators.sampling import n_per_class
from winnow.sources.scratch import Dealt, scope

AHEAD, AHEAD_BYTES, STEPS = 4096, 64 << 20, 64
TILE = 1024  # rows of a batch that a task works on at a time, however many Spark sends
GAIN_FLOOR = 1e-10
TABLE_BYTES = 128 << 20  # of vectors in one part of a pool


def _check(pool: DataFrame, cls: str, n: int) -> None:
    short = pool.groupBy(cls).agg(F.count("*").alias("n")).where(F.col("n") < n).first()
    if short:
        raise ValueError(f"n={n} exceeds the {short['n']} rows of class {short[0]}")


@dataclass
class Rows:
    """Some rows of a pool and what a selector knows of them."""

    id: np.ndarray
    x: np.ndarray
    taken: np.ndarray
    numbers: dict[str, np.ndarray]
    old: np.ndarray  #: columns of earlier rounds
    new: np.ndarray  #: columns of this round

    @staticmethod
    def of(t: pa.RecordBatch | pa.Table, names: list[str]) -> Rows:
        array = lambda c: np.array(t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c])
        old = pairs.matrix(t["col"]) if "col" in t.schema.names else np.zeros((t.num_rows, 0))
        return Rows(array("id"), pairs.matrix(t["x"]), array("taken").astype(bool), {c: array(c).astype(np.float64) for c in names}, old, np.zeros((t.num_rows, STEPS)))

    def at(self, i: int) -> dict:
        return {"id": int(self.id[i]), "x": self.x[i], "old": self.old[i], "new": self.new[i].copy(), **{c: float(v[i]) for c, v in self.numbers.items()}}

    def best(self, score: np.ndarray) -> int:
        """The row with the highest score that isn't taken, ties to the smallest id; -1 if all are."""
        left = np.flatnonzero(~self.taken)
        if not len(left):
            return -1
        top = left[score[left] == score[left].max()]
        return int(top[np.argmin(self.id[top])])


class Rule:
    """How a selector scores rows and what a pick changes."""

    fixed: list[str] = []  #: numbers of a row that stay
    moving: list[str] = []
    keeps = False  #: whether a row has a column for each pick

    def score(self, rows: Rows, t: int) -> np.ndarray:
        raise NotImplementedError

    def against(self, rows: Rows, picks: list[dict]) -> np.ndarray:
        """What rows have with some picks that no pick in between changes: a column each, by one product of matrices."""
        raise NotImplementedError

    def apply(self, rows: Rows, pick: dict, column: np.ndarray, j: int) -> None:
        """The ``j``-th pick of a round is taken."""
        raise NotImplementedError

    def ends(self, pick: dict) -> bool:
        return False

    def step(self, rows: Rows, pick: dict, column: np.ndarray, j: int) -> None:
        self.apply(rows, pick, column, j)
        rows.taken |= rows.id == pick["id"]

    @property
    def names(self) -> list[str]:
        return self.fixed + self.moving


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m, np.float64).ravel()))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            yield batch.slice(at, TILE)


def _by_class(t: pa.RecordBatch | pa.Table, names: list[str]) -> Iterator[tuple[int, Rows]]:
    k = np.asarray(t["k"])
    for one in np.unique(k):
        yield int(one), Rows.of(t.filter(pa.array(k == one)), names)


@dataclass
class Pool:
    """The tables of a pool, dealt by id alike."""

    rule: Rule
    vectors: Dealt  #: k, id, x, the rule's fixed numbers
    numbers: Dealt  #: id, taken, the rule's moving numbers
    columns: Dealt | None = None  #: id, round, col
    ahead: int = AHEAD
    rounds: int = 0
    classes: list[int] = field(default_factory=list)

    @staticmethod
    def of(state: DataFrame, rule: Rule) -> Pool:
        """From (k, id, x, numbers)."""
        shape = state.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d")).first()
        width = 8 * max(1, shape["d"])
        parts = max(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shape["n"] * width // TABLE_BYTES))
        whole = Dealt(state, "id", parts)
        vectors = Dealt(whole.read().select("k", "id", "x", *rule.fixed), "id", parts)
        numbers = Dealt(whole.read().select("id", F.lit(False).alias("taken"), *rule.moving), "id", parts)
        classes = [r["k"] for r in vectors.read().select("k").distinct().collect()]
        whole.drop()
        return Pool(rule, vectors, numbers, ahead=max(STEPS, min(AHEAD, AHEAD_BYTES // width)), classes=classes)

    def read(self, columns: bool) -> DataFrame:
        """Rows with their numbers, and ``col``, the numbers of all picks so far, if asked for; no shuffle."""
        out = self.vectors.read().join(self.numbers.read().hint("shuffle_hash"), "id")
        if columns and self.columns:
            by_round = F.array_sort(F.collect_list(F.struct("round", "col")))
            col = self.columns.read().groupBy("id").agg(F.flatten(F.transform(by_round, lambda e: e["col"])).alias("col"))
            out = out.join(col.hint("shuffle_hash"), "id")
        return out

    def best(self, t: int) -> dict[int, Rows]:
        """The best rows of each class for the next pick."""
        rule, most = self.rule, self.ahead

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in _tiles(batches):
                for one, rows in _by_class(batch, rule.names):
                    ids, score = rows.id[~rows.taken], rule.score(rows, t)[~rows.taken]
                    if one in kept:
                        ids, score = np.concatenate([kept[one][0], ids]), np.concatenate([kept[one][1], score])
                    by = np.lexsort((ids, -score))[:most]
                    kept[one] = ids[by], score[by]
            for one, (ids, score) in kept.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), one, np.int32)), pa.array(ids), pa.array(score)], ["k", "id", "score"])

        found = self.read(False).mapInArrow(local, "k int, id long, score double").withColumn("_g", F.shiftright(F.spark_partition_id(), 8))
        for by in (["k", "_g"], ["k"]):
            found = found.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))).where(F.col("_r") <= most)
        return self.fetched(found.select("id"))

    def fetched(self, ids: DataFrame) -> dict[int, Rows]:
        """Some rows, with all that is known of them; ``ids``: (id), ``ahead`` a class at most."""
        table = self.read(True).join(F.broadcast(ids), "id", "left_semi").toArrow()
        return dict(_by_class(table, self.rule.names)) if table.num_rows else {}

    def checked(self, guesses: dict[int, list[dict]], t: int) -> dict[tuple[int, int], tuple[int, float]]:
        """The best row of each class at each step, as (id, score), if all steps before it are as guessed."""
        rule, sent = self.rule, self.vectors.spark.sparkContext.broadcast(guesses)

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for batch in _tiles(batches):
                for one, rows in _by_class(batch, rule.names):
                    picks = sent.value.get(one, [])
                    with_all = rule.against(rows, picks[:-1])
                    for j in range(len(picks)):
                        if j:
                            rule.step(rows, picks[j - 1], with_all[:, j - 1], j - 1)
                        score = rule.score(rows, t + j)
                        i = rows.best(score)
                        if i >= 0:
                            best[one, j] = max(best.get((one, j), (-np.inf, 0)), (float(score[i]), -int(rows.id[i])))
            values = [(one, j, -minus, score) for (one, j), (score, minus) in best.items()]
            columns = [[v[c] for v in values] for c in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.float64()))], ["k", "step", "id", "score"])

        steps = self.read(True).mapInArrow(check, "k int, step int, id long, score double")
        found = steps.groupBy("k", "step").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("r")).select("k", "step", "r.*").collect()
        return {(r["k"], r["step"]): (-r["minus"], r["score"]) for r in found}

    def take(self, picks: dict[int, list[dict]]) -> None:
        """The numbers after some picks, and their columns."""
        rule, width = self.rule, max(map(len, picks.values()), default=0)
        sent = self.vectors.spark.sparkContext.broadcast(picks)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _tiles(batches):
                for one, rows in _by_class(batch, rule.names):
                    mine = sent.value.get(one, [])
                    with_all = rule.against(rows, mine)
                    for j, pick in enumerate(mine):
                        rule.step(rows, pick, with_all[:, j], j)
                    columns = {"id": pa.array(rows.id), "taken": pa.array(rows.taken), **{c: pa.array(rows.numbers[c]) for c in rule.moving}}
                    if rule.keeps:
                        columns["col"] = _lists(rows.new[:, :width])
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        after = self.read(True).mapInArrow(step, "id long, taken boolean" + "".join(f", {c} double" for c in rule.moving) + (", col array<double>" if rule.keeps else ""))
        if rule.keeps:
            # written once and told apart: numbers are replaced, columns added
            both = Dealt(after, "id", self.vectors.parts, dealt=True)
            numbers = Dealt(both.read().drop("col"), "id", self.vectors.parts, dealt=True)
            added = both.read().select("id", F.lit(self.rounds).alias("round"), "col")
            self.columns = self.columns.add(added) if self.columns else Dealt(added, "id", self.vectors.parts, dealt=True)
            both.drop()
        else:
            numbers = Dealt(after, "id", self.vectors.parts, dealt=True)
        self.numbers.drop()
        self.numbers, self.rounds = numbers, self.rounds + 1

    def drop(self) -> None:
        for t in (self.vectors, self.numbers, self.columns):
            if t:
                t.drop()


def _greedy(state: DataFrame, n: int, rule: Rule, start: dict[int, dict] | None = None, fill: str | None = None) -> dict[int, list[dict]]:
    """The picks of each class in order. ``state``: (k, id, x, numbers). Where the rule ends, the rest is filled by the highest ``fill``, if given."""
    pool = Pool.of(state, rule)
    picks: dict[int, list[dict]] = {k: [] for k in pool.classes}
    t, live = 0, set(picks)
    if start:
        for one, pick in start.items():
            picks[one].append(pick)
        pool.take({one: [p] for one, p in start.items()})
        t = 1
    while live and t < n:
        guesses: dict[int, list[dict]] = {}
        found_rows = pool.best(t)
        for one, rows in found_rows.items():
            if one in live:
                guesses[one] = []
                for j in range(min(STEPS, n - t, len(rows.id))):
                    i = rows.best(rule.score(rows, t + j))
                    guesses[one].append(rows.at(i))
                    if rule.ends(guesses[one][-1]):
                        break
                    rule.step(rows, guesses[one][-1], rule.against(rows, guesses[one][-1:])[:, 0], j)
        found = pool.checked(guesses, t)
        right = {one: next((j for j, g in enumerate(guessed) if found[one, j][0] != g["id"]), len(guessed)) for one, guessed in guesses.items()}
        missed = [found[one, right[one]][0] for one in guesses if right[one] < len(guesses[one])]
        fetched = pool.fetched(pool.vectors.spark.createDataFrame([(i,) for i in missed], "id long")) if missed else {}
        settled: dict[int, list[dict]] = {}
        for one, guessed in guesses.items():
            settled[one] = guessed[: right[one]]
            if right[one] < len(guessed):  # the row that was not among the best, brought to where the others are
                rows = fetched[one]
                with_all = rule.against(rows, settled[one])
                for j, pick in enumerate(settled[one]):
                    rule.step(rows, pick, with_all[:, j], j)
                settled[one] = [*settled[one], rows.at(0)]
            if settled[one] and rule.ends(settled[one][-1]):
                settled[one].pop()
                live.discard(one)
        # classes go on together: as many steps as the slowest that goes on has settled
        m = min((len(settled[one]) for one in live), default=max(map(len, settled.values()), default=0))
        for one in settled:
            settled[one] = settled[one][:m] if one in live else settled[one]
            picks[one] += settled[one]
        t += m
        if live and t < n:
            pool.take(settled)
    if fill:
        for one, ps in picks.items():
            if len(ps) < n:
                done = {p["id"] for p in ps}
                more = pool.vectors.read().where(F.col("k") == one).orderBy(F.col(fill).desc(), "id").limit(n).select("id").collect()
                ps += [{"id": r["id"]} for r in more if r["id"] not in done][: n - len(ps)]
    pool.drop()
    return picks


def _classes(pool: DataFrame, cls: str) -> tuple[DataFrame, list]:
    """``pool`` with ``k``, the number of its class, and the classes by number."""
    values = [r[0] for r in pool.select(cls).distinct().orderBy(cls).collect()]
    k = F.lit(-1)
    for i, v in enumerate(values):
        k = F.when(F.col(cls).eqNullSafe(F.lit(v)), i).otherwise(k)
    return pool.withColumn("k", k), values


def _frame(pool: DataFrame, cls: str, values: list, picks: dict[int, list[dict]], traces: dict[str, dict[int, list[float]]] | None = None) -> DataFrame:
    kind = pool.schema[cls].dataType.simpleString()
    traces = traces or {}
    rows = [(values[one], p["id"], i + 1, *(v[one][i] for v in traces.values())) for one, ps in picks.items() for i, p in enumerate(ps)]
    return pool.sparkSession.createDataFrame(rows, f"{cls} {kind}, id long, pick_no int" + "".join(f", {c} double" for c in traces))


def _one_class(pool: DataFrame, cls: str | None) -> tuple[DataFrame, str]:
    return (pool, cls) if cls else (pool.withColumn("cls", F.lit(0)), "cls")


class Herding(Rule):
    fixed, moving = ["a", "kxx"], ["b"]

    def __init__(self, kernel: str, degree: int, sigma: float | None):
        self.options = (kernel, degree, sigma)

    def score(self, rows: Rows, t: int) -> np.ndarray:
        v = rows.numbers
        return v["a"] - (v["b"] + 0.5 * v["kxx"]) / (t + 1)

    def against(self, rows: Rows, picks: list[dict]) -> np.ndarray:
        return _kernel_with(rows, picks, *self.options)

    def apply(self, rows: Rows, pick: dict, column: np.ndarray, j: int) -> None:
        rows.numbers["b"] = rows.numbers["b"] + column


def _kernel_with(rows: Rows, picks: list[dict], kernel: str, degree: int, sigma: float | None) -> np.ndarray:
    if not picks or not len(rows.id):
        return np.zeros((len(rows.id), len(picks)))
    return pairs.kernel_matrix(rows.x, np.stack([p["x"] for p in picks]), kernel, degree, sigma)


def herding(pool: DataFrame, reference: DataFrame, n: int, cls: str | None = None, kernel: str = "poly", degree: int = 3, sigma: float | None = None) -> DataFrame:
    """Kernel herding: at pick t the row with the largest A(x) - (B(x) + k(x, x) / 2) / t.

    A(x) is the mean kernel to the reference (of the same class), B(x) the sum over earlier picks.
    ``mmd2``: the biased MMD^2 of the picks so far to the reference.
    """
    pool, c = _one_class(pool, cls)
    _check(pool, c, n)
    k = lambda a, b: V.kernel(a, b, kernel, degree, sigma)
    rows, values = _classes(affinity(pool, reference, cls, kernel, degree, sigma), c)
    state = rows.select("k", "id", "x", F.col("affinity").alias("a"), k(F.col("x"), F.col("x")).alias("kxx"), F.lit(0.0).alias("b"))
    with scope(pool.sparkSession):
        picks = _greedy(state, n, Herding(kernel, degree, sigma))
    own = {}
    for i, v in enumerate(values):
        r = reference if cls is None else reference.where(F.col(cls).eqNullSafe(F.lit(v)))
        own[i] = pairs.mean_kernel(r, kernel, degree, sigma)
    trace: dict[int, list[float]] = {}
    for one, ps in picks.items():
        among, to = 0.0, 0.0
        trace[one] = []
        for t, p in enumerate(ps, 1):
            among, to = among + p["kxx"] + 2 * p["b"], to + p["a"]
            trace[one].append(among / t**2 + own[one] - 2 * to / t)
    return _frame(pool, c, values, picks, {"mmd2": trace})


def affinity(pool: DataFrame, reference: DataFrame, cls: str | None = None, kernel: str = "poly", degree: int = 3, sigma: float | None = None) -> DataFrame:
    """``pool`` with ``affinity``: the mean kernel to the reference rows, of the same class if ``cls`` is given."""
    if cls is None:
        means = pairs.kernel_means(pool, reference, kernel, degree, sigma)
    else:
        means = None
        for r in pool.select(cls).distinct().collect():
            one = pairs.kernel_means(pool.where(F.col(cls).eqNullSafe(F.lit(r[0]))), reference.where(F.col(cls).eqNullSafe(F.lit(r[0]))), kernel, degree, sigma)
            means = one if means is None else means.unionByName(one)
        if means is None:
            return pool.withColumn("affinity", F.lit(None).cast("double"))
    return pool.join(means.withColumnRenamed("mean", "affinity"), "id")


class Farthest(Rule):
    moving = ["d"]

    def score(self, rows: Rows, t: int) -> np.ndarray:
        return rows.numbers["d"]

    def against(self, rows: Rows, picks: list[dict]) -> np.ndarray:
        if not picks or not len(rows.id):
            return np.zeros((len(rows.id), len(picks)))
        # differences, not products: the same number wherever and with however many others it is computed
        return np.stack([np.sqrt(np.square(rows.x - p["x"]).sum(1)) for p in picks], 1)

    def apply(self, rows: Rows, pick: dict, column: np.ndarray, j: int) -> None:
        rows.numbers["d"] = np.minimum(rows.numbers["d"], column)


def kcenter(pool: DataFrame, n: int, cls: str | None = None, seed: int = 0) -> DataFrame:
    """Farthest first: a seeded start, then always the row farthest from all picks."""
    pool, c = _one_class(pool, cls)
    _check(pool, c, n)
    rows, values = _classes(pool, c)
    first = rows.groupBy("k").agg(F.min_by(F.struct("id", "x"), F.struct(seeded(seed, "id"), "id")).alias("r")).collect()
    start = {r["k"]: {"id": r["r"]["id"], "x": np.array(r["r"]["x"])} for r in first}
    with scope(pool.sparkSession):
        picks = _greedy(rows.select("k", "id", "x", F.lit(float("inf")).alias("d")), n, Farthest(), start)
    return _frame(pool, c, values, picks)


class Volume(Rule):
    """Columns of an incremental Cholesky factor; what earlier rounds have in common with a round's picks is one product of matrices."""

    fixed, moving, keeps = ["q", "root"], ["gain"], True

    def __init__(self, kernel: str, degree: int, sigma: float | None):
        self.options = (kernel, degree, sigma)

    def score(self, rows: Rows, t: int) -> np.ndarray:
        return rows.numbers["gain"]

    def against(self, rows: Rows, picks: list[dict]) -> np.ndarray:
        out = _kernel_with(rows, picks, *self.options)
        if out.size:
            v = rows.numbers
            out = out * (v["q"] / v["root"])[:, None] * np.array([p["q"] / p["root"] for p in picks])
            if rows.old.shape[1]:
                out -= rows.old @ np.stack([p["old"] for p in picks], 1)
        return out

    def apply(self, rows: Rows, pick: dict, column: np.ndarray, j: int) -> None:
        v = rows.numbers
        e = (column - rows.new[:, :j] @ pick["new"][:j]) / pick["gain"] ** 0.5
        v["gain"] = v["gain"] - e * e
        rows.new[:, j] = e

    def ends(self, pick: dict) -> bool:
        return pick["gain"] < GAIN_FLOOR


def dpp(pool: DataFrame, n: int, cls: str | None = None, quality: str | None = None, kernel: str = "rbf", degree: int = 3, sigma: float | None = None, reference: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Greedy determinantal picks by incremental Cholesky, and (class -> picks made by volume) for classes whose volume ran out.

    ``quality``: a column of finite numbers of at least 0, scaled to a maximum of 1 in each class; none: 1 for all;
    ``real_affinity``: the mean kernel to ``reference`` (of the same class), at least 0.
    When the best gain falls under ``GAIN_FLOOR`` the rest is filled by quality.
    ``logdet``: the log determinant of the picks so far; ``gain``: the pick's own; both null for rows that fill up.
    """
    pool, c = _one_class(pool, cls)
    _check(pool, c, n)
    k = lambda a, b: V.kernel(a, b, kernel, degree, sigma)
    if quality == "real_affinity":
        if reference is None:
            raise ValueError("real_affinity needs a reference")
        pool = affinity(pool.drop("affinity"), reference, cls, kernel, degree, sigma).withColumn("affinity", F.greatest("affinity", F.lit(0.0)))
        quality = "affinity"
    if quality:
        q = F.col(quality).cast("double")
        if pool.where(q.isNull() | F.isnan(q) | (q < 0) | (q == float("inf"))).limit(1).count():
            raise ValueError("quality must be finite and at least 0")
        top = pool.groupBy(F.col(c).alias("_c")).agg(F.greatest(F.max(q), F.lit(1e-12)).alias("_m"))
        pool = pool.join(top, F.col(c).eqNullSafe(F.col("_c"))).withColumn("_q", q / F.col("_m")).drop("_c", "_m")
    else:
        pool = pool.withColumn("_q", F.lit(1.0))
    rows, values = _classes(pool, c)
    root = F.sqrt(F.greatest(k(F.col("x"), F.col("x")), F.lit(1e-12)))
    state = rows.select("k", "id", "x", F.col("_q").alias("q"), root.alias("root"), (F.col("_q") * F.col("_q")).alias("gain"))
    with scope(pool.sparkSession):
        picks = _greedy(state, n, Volume(kernel, degree, sigma), fill="q")
    gains, logdet, ended = {}, {}, {}
    for one, ps in picks.items():
        own = [p["gain"] for p in ps if "gain" in p]
        gains[one] = own + [None] * (n - len(own))
        logdet[one] = [*np.cumsum(np.log(own)).tolist(), *[None] * (n - len(own))]
        if len(own) < n:
            ended[values[one]] = len(own)
    return _frame(pool, c, values, picks, {"gain": gains, "logdet": logdet}), ended


def random_pick(pool: DataFrame, n: int, cls: str | None = None, seed: int = 0) -> DataFrame:
    """The control: ``n`` rows of each class in the seeded order."""
    pool, c = _one_class(pool, cls)
    chosen = n_per_class(pool.select(c, "id"), c, n, seed)
    return chosen.withColumn("pick_no", F.row_number().over(Window.partitionBy(c).orderBy(seeded(seed, "id"), "id")))


def top_scores(scores: DataFrame, score: str, n: int, descending: bool = True) -> DataFrame:
    """The ``n`` best rows by a score, ties by id."""
    return scores.orderBy(F.col(score).desc() if descending else F.col(score), "id").limit(n)


def knn_rank(pool: DataFrame, reference: DataFrame, k: int = 5) -> DataFrame:
    """(id, score): the mean distance to the ``k`` nearest reference vectors; lower is more real."""
    near = pairs.nearest(pool, reference, k)
    total = F.aggregate("near", F.lit(0.0), lambda s, e: s + e["d"])
    return near.select("id", (total / F.size("near")).alias("score"))


def logged(picks: DataFrame, every: int, n: int) -> DataFrame:
    """The picks, and what they trace, at every so many picks and at the last."""
    return picks.where((F.col("pick_no") % every == 0) | (F.col("pick_no") == n))


SELECTORS = {
    "herding": lambda pool, reference, n, **o: herding(pool, reference, n, **o),
    "dpp": lambda pool, reference, n, **o: dpp(pool, n, **o)[0],
    "kcenter": lambda pool, reference, n, **o: kcenter(pool, n, **o),
    "random": lambda pool, reference, n, **o: random_pick(pool, n, **o),
}


def select(name: str, pool: DataFrame, reference: DataFrame, n: int, **options) -> DataFrame:
    """By name, on the rows of ``pool`` that a gate has kept."""
    if name not in SELECTORS:
        raise ValueError(f"unknown selector: {name}")
    return SELECTORS[name](pool, reference, n, **options)
