"""Consensus of annotators: a classifier on item features and annotators' confusion matrices, fitted together by EM.

Both fields (level and function) are tasks of one run. E step: an item's posterior is the classifier's prior times,
for each annotator, the chance of the label given under that annotator's confusion matrix. M step: confusion matrices
from the posteriors' sums, shrunk towards the annotator's accuracy with the errors spread as in the whole corpus;
and the classifier, a multinomial logistic model with an L2 penalty on hashed features, fitted to the posteriors.

The items, with their labels as arrays, are written once. A round is one pass over them: posteriors and, from these,
expected counts per annotator, summed within each task and then in one small shuffle. The annotators' tables are sent to
the tasks while they have at most ``TABLE_CELLS`` cells; beyond that the same rounds run as joins (``_rounds_joined``).
The classifier's items are chosen once, by hash. Rounds end when no annotator's accuracy moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import is_blank, strip
from rankloom.session import cut

#: Rounds of EM at most, and the move of an accuracy that counts; items on which the classifier is fitted; L2 penalty; weight of an annotator's shrunken matrix, in labels.
ROUNDS, TOLERANCE, SAMPLE_ITEMS, PENALTY, SHRINK = 10, 2e-3, 20_000, 1.0, 6.0
#: Classes of a task with a column of their own; rarer ones share the last column, within which a node's commonest label wins.
MOST_CLASSES = 64
#: Annotators x classes x classes that are sent to tasks.
TABLE_CELLS = 4_000_000
FEATURES = ("original_level", "original_function", "region", "sub_industry", "archetype")
#: Weights that the values of one feature are hashed to.
FEATURE_BUCKETS = 512
TASKS = ("level", "func")


def standing_verdicts(df: DataFrame) -> DataFrame:
    """``node_id, analyst, level, func, at``: each analyst's latest non-empty verdict on a node.

    Analysts are told by ``analyst_id`` without case and outer blanks; rows without node or analyst are left out. Of equal
    times the largest ``correction_id`` stands. ``func`` is the function without case and blanks. A time that can't be read is the earliest.
    """
    func = F.when(~is_blank("corrected_function"), F.lower(F.regexp_replace("corrected_function", r"(?U)\s+", "")))
    rows = df.select(
        "correction_id", "node_id", F.lower(strip("analyst_id")).alias("analyst"), F.col("corrected_level").cast("int").alias("level"), func.alias("func"),
        strip("timestamp").try_cast("timestamp").alias("at") if dict(df.dtypes)["timestamp"] == "string" else F.col("timestamp").alias("at"),
        *[F.lower(strip(F.col(c).cast("string"))).alias(f"x_{c}") for c in FEATURES],
    )
    return (
        rows.filter("node_id is not null and analyst <> '' and (level is not null or func is not null)")
        .groupBy("node_id", "analyst")
        .agg(F.max_by(F.struct("level", "func", *[f"x_{c}" for c in FEATURES]), F.struct("at", "correction_id")).alias("v"))
        .select("node_id", "analyst", "v.*")
    )


@dataclass
class Consensus:
    """``items``: node_id, n_analysts, corrected_level, corrected_function, *_confidence, *_agreement. ``analysts``: analyst, field, n_labels, reliability."""

    items: DataFrame
    analysts: DataFrame


def _fit_softmax(x: np.ndarray, q: np.ndarray, width: int, w: np.ndarray, steps: int = 60) -> np.ndarray:
    """Penalised multinomial logistic weights (features x classes) on one-hot rows ``x`` (indices) and soft labels ``q``."""
    n, m, v = len(x), np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = w[x].sum(axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = PENALTY * w / n
        d = (p - q) / n
        for j in range(x.shape[1]):
            np.add.at(g, x[:, j], d)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def _prior(weights: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Log prior of each class under the classifier; classes the task doesn't have are out."""
    z = weights[x].sum(axis=1)
    z[:, size:] = -1e9
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class _Model:
    """Weights of the classifier and log likelihoods (task, annotator, label, class), or None before the first round, when the votes' shares are the posteriors."""

    sizes: list[int]
    k: int
    weights: list[np.ndarray]
    like: list[np.ndarray] | None = None

    def posteriors(self, t: int, row: np.ndarray, a: np.ndarray, c: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of each item (``x``: its features) its classes' posteriors, from labels ``c`` of annotators ``a`` on items ``row`` (rising)."""
        z = np.zeros((len(x), self.k))
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            z[row[first]] = np.add.reduceat(np.eye(self.k)[c] if self.like is None else self.like[t][a, c], first)
        if self.like is None:
            return z / np.maximum(z.sum(1, keepdims=True), 1)
        z += _prior(self.weights[t], x, self.sizes[t])
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _flat(labels, x) -> tuple:
    """Labels of many items as arrays: task -> (row, annotator, class); features as a matrix."""
    n = np.array([len(l) for l in labels], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    flat = np.array([v for l in labels for v in l], np.int64)  # task, annotator and class in one number
    out = []
    for t in range(len(TASKS)):
        mine = flat % 2 == t
        out.append((row[mine], flat[mine] // 2 // 128, flat[mine] // 2 % 128))
    return out, np.array([list(v) for v in x], np.int64).reshape(len(n), 1 + len(FEATURES))


def _count(q: np.ndarray, row: np.ndarray, a: np.ndarray, c: np.ndarray, n_annotators: int) -> np.ndarray:
    """Expected counts (annotator, label, class)."""
    k = q.shape[1]
    return np.stack([np.bincount(a * k + c, q[row, j], n_annotators * k) for j in range(k)], 1).reshape(n_annotators, k, k)


def _m_step(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods and accuracies from expected counts (annotator, label, class)."""
    k = e.shape[1]
    err = e.sum(0) + 0.1
    np.fill_diagonal(err, 0)
    if k > 1:
        err /= np.maximum(err.sum(0, keepdims=True), 1e-9)
    acc = (np.einsum("acc->a", e) + 2.0) / (e.sum((1, 2)) + 3.0)
    eye = np.eye(k)
    top = e + SHRINK * (eye * acc[:, None, None] + (1 - eye) * (1 - acc)[:, None, None] * err) + 1e-6
    return np.log(top / (e.sum(1)[:, None, :] + SHRINK + 1e-3)), acc


def _rounds_sent(nodes: DataFrame, n_annotators: int, sizes: list[int], k: int, width: int, rounds: int, sample_items: int, total: int) -> tuple[DataFrame, DataFrame]:
    """EM with the annotators' tables sent to the tasks. Returns ``node_id, field, q`` and ``a, field, right, n``."""
    spark = nodes.sparkSession
    model = _Model(sizes, k, [np.zeros((width, k)) for _ in TASKS])
    share = int(min(1.0, sample_items / max(1, 2 * total)) * 1_000_000)
    picked = nodes.filter(F.pmod(F.xxhash64("node_id"), F.lit(1_000_000)) < share).limit(sample_items).select("labels", "x").toPandas()
    sample, sample_x = _flat(picked["labels"], picked["x"])
    columns = [f"s{i}" for i in range(k)]

    def expected(b):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = [0.0] * len(TASKS)
            for pdf in batches:
                labels, x = _flat(pdf["labels"], pdf["x"])
                for t, (row, a, c) in enumerate(labels):
                    if len(row):
                        sums[t] = sums[t] + _count(b.value.posteriors(t, row, a, c, x), row, a, c, n_annotators)
            for t, e in enumerate(sums):
                if not np.isscalar(e):
                    flat = e.reshape(-1, k)
                    used = np.flatnonzero(flat.sum(1) > 0)
                    yield pd.DataFrame({"t": t, "key": used} | {s: flat[used, j] for j, s in enumerate(columns)})

        return run

    before = None
    for _ in range(rounds):
        b = spark.sparkContext.broadcast(model)
        got = nodes.select("labels", "x").mapInPandas(expected(b), "t int, key long, " + ", ".join(f"{s} double" for s in columns)).groupBy("t", "key").agg(*[F.sum(s).alias(s) for s in columns]).toPandas()
        likes, accs, last = [], [], []
        weights = []
        for t in range(len(TASKS)):
            e = np.zeros((n_annotators * k, k))
            mine = got[got["t"] == t]
            e[mine["key"].to_numpy()] = mine[columns].to_numpy()
            e = e.reshape(n_annotators, k, k)
            row, a, c = sample[t]
            has = np.unique(row)
            q = model.posteriors(t, row, a, c, sample_x)
            weights.append(_fit_softmax(sample_x[has], q[has], width, model.weights[t]) if len(has) else model.weights[t])
            like, acc = _m_step(e)
            likes.append(like)
            accs.append(acc)
            last.append(e)
        model = _Model(sizes, k, weights, likes)
        moved = 1.0 if before is None else max(float(np.abs(x - y).max(initial=0.0)) for x, y in zip(accs, before))
        before = accs
        if moved < TOLERANCE:
            break
    b = spark.sparkContext.broadcast(model)

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            labels, x = _flat(pdf["labels"], pdf["x"])
            for t, (row, a, c) in enumerate(labels):
                q = b.value.posteriors(t, row, a, c, x)
                has = np.unique(row)
                yield pd.DataFrame({"node_id": pdf["node_id"].to_numpy()[has], "field": TASKS[t], "q": list(q[has])})

    rows = [(int(i), TASKS[t], float(np.trace(e[i])), float(e[i].sum())) for t, e in enumerate(last) for i in range(n_annotators) if e[i].sum() > 0]
    return nodes.select("node_id", "labels", "x").mapInPandas(final, "node_id string, field string, q array<double>"), spark.createDataFrame(rows, "a long, field string, right double, n double")


def _rounds_joined(nodes: DataFrame, numbers: DataFrame, sizes: list[int], k: int, width: int, rounds: int, sample_items: int, total: int) -> tuple[DataFrame, DataFrame]:
    """The same EM for annotators of any number: their tables stay tables, joined to the labels in each round."""
    spark = nodes.sparkSession
    labels = cut(numbers.select("node_id", F.explode("numbers").alias("l")).select("node_id", F.expr("cast(l % 2 as int) t"), F.expr("l div 256 a"), F.expr("cast(l div 2 % 128 as int) c")))
    at = [F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(k)]
    array = F.array(*[f"s{i}" for i in range(k)])
    votes = labels.groupBy("node_id", "t").agg(*[F.avg((F.col("c") == i).cast("double")).alias(f"s{i}") for i in range(k)])
    q = cut(votes.select("node_id", "t", array.alias("q")))
    weights = [np.zeros((width, k)) for _ in TASKS]
    share = int(min(1.0, sample_items / max(1, 2 * total)) * 1_000_000)
    for _ in range(rounds):
        e = cut(labels.join(q, ["node_id", "t"]).groupBy("t", "a", "c").agg(*at).select("t", "a", "c", array.alias("e")))
        spread = {}
        for r in e.groupBy("t", "c").agg(F.array(*[F.sum(F.col("e")[i]) for i in range(k)]).alias("e")).collect():  # classes squared
            spread[r["t"], r["c"]] = np.array(r["e"])
        err = {t: np.array([spread.get((t, c), np.zeros(k)) for c in range(k)]) + 0.1 for t in range(len(TASKS))}
        for m in err.values():
            np.fill_diagonal(m, 0)
            m /= np.maximum(m.sum(0, keepdims=True), 1e-9)
        errors = spark.createDataFrame([(t, c, m[c].tolist()) for t, m in err.items() for c in range(k)], "t int, c int, err array<double>")
        total_of = F.aggregate("e", F.lit(0.0), lambda x, y: x + y)
        per = e.groupBy("t", "a").agg(((F.sum(F.get("e", F.col("c"))) + 2.0) / (F.sum(total_of) + 3.0)).alias("acc"), F.array(*[F.sum(F.col("e")[i]) for i in range(k)]).alias("per"))
        ll = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.log((F.get("e", i) + SHRINK * F.when(i == F.col("c"), F.col("acc")).otherwise((1 - F.col("acc")) * F.get("err", i)) + 1e-6) / (F.get("per", i) + SHRINK + 1e-3)))
        like = e.join(per, ["t", "a"]).join(F.broadcast(errors), ["t", "c"]).select("t", "a", "c", ll.alias("q"))
        picked = q.join(nodes.filter(F.pmod(F.xxhash64("node_id"), F.lit(1_000_000)) < share).select("node_id", "x"), "node_id").limit(2 * sample_items).toPandas()
        for t in range(len(TASKS)):
            mine = picked[picked["t"] == t]
            if len(mine):
                weights[t] = _fit_softmax(np.array([list(v) for v in mine["x"]], np.int64), np.array([list(v) for v in mine["q"]]), width, weights[t])
        frozen = [w.copy() for w in weights]

        @F.pandas_udf("array<double>")
        def posterior(t: pd.Series, x: pd.Series, z: pd.Series) -> pd.Series:
            out = []
            for i, f, g in zip(t, x, z):
                v = np.asarray(g) + _prior(frozen[i], np.array([f]), sizes[i])[0]
                p = np.exp(v - v.max())
                out.append(p / p.sum())
            return pd.Series(out, dtype=object)

        gain = labels.join(like, ["t", "a", "c"]).groupBy("node_id", "t").agg(*at).select("node_id", "t", array.alias("z"))
        q = cut(gain.join(nodes.select("node_id", "x"), "node_id").select("node_id", "t", posterior("t", "x", "z").alias("q")))
    field = F.element_at(F.array(*[F.lit(t) for t in TASKS]), F.col("t") + 1)
    rates = e.groupBy("a", field.alias("field")).agg(F.sum(F.get("e", F.col("c"))).alias("right"), F.sum(total_of).alias("n"))
    return q.select("node_id", field.alias("field"), "q"), rates


def reach_consensus(df: DataFrame, least_analysts: int = 3, rounds: int = ROUNDS, sample_items: int = SAMPLE_ITEMS, table_cells: int = TABLE_CELLS) -> Consensus:
    """Consensus of every node judged by at least ``least_analysts`` analysts. Needs the columns of the corrections table;
    others are ignored. All verdicts, those on other nodes too, tell about the analysts. An empty table gives empty results."""
    spark = df.sparkSession
    verdicts = cut(standing_verdicts(df))
    # classes: the commonest of each task; rarer ones share the last
    index, sizes = [], []
    for t, f in enumerate(TASKS):
        top = [r[0] for r in verdicts.filter(F.col(f).isNotNull()).groupBy(F.col(f).cast("string").alias("y")).count().orderBy(F.desc("count"), "y").limit(MOST_CLASSES + 1).collect()]
        own = top if len(top) <= MOST_CLASSES else top[: MOST_CLASSES - 1]
        index += [(t, y, i) for i, y in enumerate(sorted(own))]
        sizes.append(len(own) + (len(top) > MOST_CLASSES))
    k = max([1, *sizes])
    class_of = lambda t, y: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for tt, y_, i in index if tt == t for v in (y_, i)]), y), F.lit(sizes[t] - 1)) if sizes[t] else F.lit(None).cast("int")
    analysts = cut(verdicts.select("analyst").distinct().withColumn("a", F.monotonically_increasing_id()))
    n_analysts = analysts.count()
    sent = n_analysts * k * k <= table_cells
    if sent:  # few enough to number without gaps
        analysts = spark.createDataFrame([(r[0], i) for i, r in enumerate(sorted(analysts.select("analyst").collect()))], "analyst string, a long")
    feature = lambda i, c: (F.pmod(F.xxhash64(f"x_{c}"), F.lit(FEATURE_BUCKETS)) + 1 + i * FEATURE_BUCKETS).cast("int")
    width = 1 + len(FEATURES) * FEATURE_BUCKETS
    number = lambda t, f: F.when(F.col(f).isNotNull(), (F.col("a") * 128 + class_of(t, F.col(f).cast("string"))) * 2 + t)
    numbers = verdicts.join(F.broadcast(analysts) if sent else analysts, "analyst").select("node_id", *[f"x_{c}" for c in FEATURES], F.array_compact(F.array(*[number(t, f) for t, f in enumerate(TASKS)])).alias("numbers"))
    labels = F.flatten(F.collect_list("numbers")) if sent else F.lit(None).cast("array<long>")  # no longer than the annotators, whose number is checked
    nodes = cut(
        numbers.groupBy("node_id")
        .agg(F.count(F.lit(1)).alias("n_analysts"), labels.alias("labels"), *[F.mode(f"x_{c}", True).alias(f"x_{c}") for c in FEATURES])
        .select("node_id", "n_analysts", "labels", F.array(F.lit(0), *[feature(i, c) for i, c in enumerate(FEATURES)]).alias("x"))
    )
    total = nodes.count()
    q, rates = _rounds_sent(nodes, n_analysts, sizes, k, width, rounds, sample_items, total) if sent else _rounds_joined(nodes, numbers, sizes, k, width, rounds, sample_items, total)

    best = q.select("node_id", "field", F.array_max("q").alias("conf"), (F.array_position("q", F.array_max("q")) - 1).cast("int").alias("c"))
    cast = verdicts.join(nodes.filter(F.col("n_analysts") >= least_analysts).select("node_id", "n_analysts"), "node_id")
    given = F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), class_of(t, F.col(f).cast("string")).alias("c"), F.col(f).cast("string").alias("y"))) for t, f in enumerate(TASKS)])
    shares = cast.select("node_id", "n_analysts", F.explode(F.array_compact(given)).alias("g")).groupBy("node_id", "n_analysts", "g.field", "g.c", "g.y").agg(F.count(F.lit(1)).alias("n"))
    # of a class the label itself; of the shared class the node's commonest label in it
    shares = shares.groupBy("node_id", "n_analysts", "field", "c").agg(F.max_by("y", F.struct("n", "y")).alias("y"), F.sum("n").alias("n"))
    names = spark.createDataFrame([(TASKS[t], i, y) for t, y, i in index] or [("level", 0, "")], "field string, c int, name string")
    whole = shares.groupBy("node_id", "n_analysts", "field").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("y", "n")))).alias("of"), F.sum("n").alias("m"))  # at most a class each
    best = whole.join(best, ["node_id", "field"]).join(F.broadcast(names), ["field", "c"], "left")
    vote = F.try_element_at("of", F.col("c"))
    best = best.select("node_id", "n_analysts", "field", F.coalesce(vote["y"], F.col("name")).alias("y"), F.round("conf", 6).alias("conf"), F.round(F.coalesce(vote["n"], F.lit(0)) / F.col("m"), 6).alias("agree"))
    spelt = (
        df.filter(~is_blank("corrected_function")).groupBy("corrected_function").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.lower(F.regexp_replace("corrected_function", r"(?U)\s+", "")).alias("fy")).agg(F.max_by("corrected_function", F.struct("n", "corrected_function")).alias("corrected_function"))
    )
    at = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    items = best.groupBy("node_id").agg(
        F.max("n_analysts").alias("n_analysts"), at("level", "y").cast("int").alias("corrected_level"), at("func", "y").alias("fy"),
        at("level", "conf").alias("level_confidence"), at("func", "conf").alias("function_confidence"), at("level", "agree").alias("level_agreement"), at("func", "agree").alias("function_agreement"),
    )
    reliability = rates.join(analysts, "a").select("analyst", "field", F.round(F.col("right") / F.col("n"), 6).alias("reliability"), F.round("n").cast("long").alias("n_labels"))
    return Consensus(items.join(spelt, "fy", "left").drop("fy"), reliability)
